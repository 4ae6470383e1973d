"""N-gram Jaccard join by PartEnum signatures (operator 2).

A document's set holds its distinct n-word shingles. Two sets whose Jaccard
similarity is at least num / den differ in at most

    k = (den - num) / num * (size of the smaller)

shingles. Sizes are cut into bands, each as wide as the similarity allows, so
that linked sets are in the same band or in neighbours; a pair goes by the band
of its smaller set, so a set is given signatures for its own band and for the
one below. For a band with bound k the
shingle domain is hashed into n1 groups of n2 parts. At most k // (k2 + 1) of
the groups differ in more than k2 shingles, so a linked pair has groups with
at most k2, and there some n2 - k2 parts without any difference: the subsets
of n2 - k2 parts are enumerated, one signature each (group, subset, the
shingles in it), and the pair shares one. Small bounds take n2 = 3, k2 = 1,
large ones n2 = 1, k2 = 0, which needs the fewest signatures.

Signatures of few shingles are shared by documents that have little else in
common. There are `spare` more groups than needed, so a linked pair shares more
than `spare` signatures, and each set leaves its `spare` weakest ones out. Weak
is told by the signature alone (its number of shingles, then its hash): of the
signatures that a pair shares, either set leaves out only those below its own
threshold, hence both together at most `spare`, and one is left.

Documents with one signature are not paired with each other. Each is compared
with the first of them (the pivot), which gives exact distances and links, and
components of these. Two documents that share a signature share a pivot, so
what is left are links among the partners of one pivot that are in different
components. Partners are cut into blocks of similar distance to the pivot;
Jaccard distance is a metric, so only blocks whose distances are within
1 - num / den can hold a link. A task compares two blocks at a time by matrix
products and emits trees of links, never pairs. No link is lost, and a group
of thousands of copies costs about one comparison for each.

A pivot with many partners is no hot key: its partners are dealt into SHARES by
hash, each with a copy of the pivot's text where it has any, and its blocks
come from counts (aggregated with partial results), not from a window over the
pivot. Joins on the pivot read staged tables, so that skewed ones are split.

Joins with texts are merge joins at every size: ids of candidates are no small
side at full size, and the plan should not depend on a threshold.

Equal sets are one member from the start. Only ids, signatures and (for
documents with a candidate) texts are shuffled. Intermediate tables are removed
from the shared folder as soon as what follows them is written.

Defined cases: a null or empty text, or one of blanks, has an empty set and is
linked with nothing; texts of fewer than n words have their whole sequence as
one shingle; rows of equal or null keys are rows of their own (component_id is
the least key in the component; null where all are null); an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import _common as C
from . import _words as words
from .components import components

BATCH = 2 << 20
SMALL_BOUND = 24
SPARE = 4  # one group in so many is spare
SEEN = 200_000  # names of sets that a task remembers, to sign copies once
SHARES = 64  # parts of a pivot's partners, each with the pivot's text
BLOCK = 1024
BINS = 64  # distances to a pivot that tell blocks apart


class Scheme:
    """Bands and PartEnum parameters for similarity num / den."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("a similarity over 0, at most 1")
        self.num, self.den = num, den
        self.low, self.high = [1], [den // num]

    def band(self, sizes: np.ndarray) -> np.ndarray:
        while len(sizes) and self.high[-1] < sizes.max():
            self.low.append(self.high[-1] + 1)
            self.high.append(self.low[-1] * self.den // self.num)
        return np.searchsorted(np.array(self.high), sizes)

    def top(self, band: int) -> int:
        self.band(np.array([1]))
        while len(self.high) <= band:
            self.low.append(self.high[-1] + 1)
            self.high.append(self.low[-1] * self.den // self.num)
        return self.high[band]

    def bound(self, band: int) -> int:
        """Greatest Hamming distance of linked sets whose smaller one is in
        the band: (1 - j) / j times its size."""
        return (self.den - self.num) * self.top(band) // self.num

    def parameters(self, k: int) -> tuple[int, int, int, int]:
        """(groups, parts, parts left out, spare groups)."""
        if k <= SMALL_BOUND:
            parts, out = 3, 1
        else:
            parts, out = 1, 0
        spare = k // (SPARE * (out + 1))
        return k // (out + 1) + 1 + spare, parts, out, spare


def _cell_sums(cell: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Sum of h over each cell, modulo 2**64 (two exact halves)."""
    low = np.bincount(cell, (h & np.uint64(0xFFFFFFFF)).astype(np.float64), n).astype(np.uint64)
    high = np.bincount(cell, (h >> np.uint64(32)).astype(np.float64), n).astype(np.uint64)
    return low + (high << np.uint64(32))


def signatures(h: np.ndarray, doc: np.ndarray, sizes: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set) of sets given as (hash, set), sorted by set."""
    found: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    bands = scheme.band(sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for step in (0, 1):  # as the smaller set of a pair, or one of its band; as the larger one
        for band in np.unique(bands[sizes > 0]):
            tag = int(band) - step
            k = scheme.bound(tag) if tag >= 0 else 0
            if k == 0:  # only equal sets are linked
                continue
            n1, n2, out, spare = scheme.parameters(k)
            reach = scheme.top(tag) * scheme.den // scheme.num
            members = np.flatnonzero((bands == band) & (sizes > 0) & (sizes <= reach))
            if not len(members):
                continue
            count = sizes[members]
            unit = np.repeat(np.arange(len(members)), count)
            x = h[np.concatenate([np.arange(starts[m], starts[m + 1]) for m in members])]
            spread = words.mix(x + np.uint64(0x632BE59BD9B4E019))
            cell = unit * (n1 * n2) + (spread % np.uint64(n1 * n2)).astype(np.int64)
            sums = _cell_sums(cell, x, len(members) * n1 * n2).reshape(len(members), n1, n2)
            held = np.bincount(cell, minlength=len(members) * n1 * n2).reshape(len(members), n1, n2)
            if out:  # all subsets of n2 - 1 parts
                sums = sums.sum(axis=2, keepdims=True, dtype=np.uint64) - sums
                held = held.sum(axis=2, keepdims=True) - held
            places = np.arange(n1 * n2, dtype=np.uint64).reshape(1, n1, n2)
            salt = np.uint64(tag * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
            names = words.mix(words.mix(sums + held.astype(np.uint64)) + places * np.uint64(0x9E3779B97F4A7C15) + salt).reshape(len(members), -1)
            emit = np.ones(names.shape, bool)
            if spare:  # by shingles, then name: what is left out depends on the signature alone
                rank = (np.minimum(held.reshape(names.shape), 255).astype(np.uint64) << np.uint64(56)) | (names >> np.uint64(8))
                emit = rank >= np.partition(rank, spare, axis=1)[:, spare : spare + 1]
            found.append(names[emit])
            owner.append(np.broadcast_to(members[:, None], names.shape)[emit])
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(owner)


def _sets(batch: pa.RecordBatch, n: int):
    """(hash, row, sizes) of a batch whose second column is the text."""
    texts = batch.column(1).to_pylist()
    h, doc = words.shingles(texts, n)
    return h, doc, np.bincount(doc, minlength=len(texts))


def _names(h: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """A 128-bit name for each set."""
    ends = np.cumsum(sizes)
    return [hashlib.blake2b(h[e - s : e].tobytes(), digest_size=16).digest() for s, e in zip(sizes, ends)]


def shingle_sets(rows: DataFrame, n: int) -> DataFrame:
    """rows: _id, _key, _text (binary). Returns _id, _key, n_shingles and the
    set's name as two longs."""

    def one(batch: pa.RecordBatch) -> dict:
        h, _, sizes = _sets(batch, n)
        named = np.frombuffer(b"".join(_names(h, sizes)), "<i8").reshape(-1, 2)
        return {"_id": batch.column(0), "_key": batch.column(2), "n_shingles": sizes, "_k1": named[:, 0].copy(), "_k2": named[:, 1].copy()}

    return _mapped(rows.select("_id", "_text", "_key"), one, "_id long, _key long, n_shingles long, _k1 long, _k2 long")


def _mapped(rows: DataFrame, one, schema: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in C.sliced(batches, "_text", BATCH):
            out = one(batch)
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, f.type) for f in arrow for v in (out[f.name],)], schema=arrow)

    return rows.mapInArrow(run, schema)


def signature_rows(rows: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """sig, _id. A set that a task has met before is not signed again: its
    signatures would be the same. Which copy is signed does not matter, ids
    are mapped to the set's least id afterwards."""

    def run(batches):
        scheme, seen = Scheme(num, den), set()
        for batch in C.sliced(batches, "_text", BATCH):
            h, doc, sizes = _sets(batch, n)
            fresh = np.zeros(len(sizes), bool)
            for i, name in enumerate(_names(h, sizes)):
                if name not in seen:
                    fresh[i] = True
                    if len(seen) < SEEN:
                        seen.add(name)
            pick = fresh[doc]
            position = np.cumsum(fresh) - 1
            sig, owner = signatures(h[pick], position[doc[pick]], sizes[fresh], scheme)
            ids = np.asarray(batch.column(0))[fresh]
            for i in range(0, len(sig), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(sig[i : i + 100_000].view(np.int64)), pa.array(ids[owner[i : i + 100_000]], pa.int64())], names=["sig", "_id"])

    return rows.mapInArrow(run, "sig long, _id long")


def star_pairs(rows: DataFrame, sets: DataFrame, same: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(x, p): members with a signature in common with p, the pivot of the
    signature; one id for each distinct set. A set may be signed under another
    id than its least, so p may be above x: the ends are not swapped, else the
    members of one signature would be spread over several pivots."""
    by = W.partitionBy("sig").orderBy("_id")
    # The first of the ordered rows is known at once: nothing is held back.
    shared = signature_rows(rows, n, num, den).withColumn("p", F.first("_id").over(by.rowsBetween(W.unboundedPreceding, W.currentRow)))
    signed = C.staged(shared.where("_id <> p").select(F.col("_id").alias("x"), "p").distinct(), "signed-pairs")
    # Copies of one set go by its first id.
    first = sets.join(same, ["_k1", "_k2"]).where("_id <> _rep").select("_id", "_rep")
    pairs = signed
    for c in ("x", "p"):
        pairs = pairs.join(first.withColumnRenamed("_id", c), c, "left").withColumn(c, F.coalesce("_rep", c)).drop("_rep")
    out = C.staged(pairs.where("x <> p").select("x", "p").distinct(), "star-pairs")
    C.free(signed)
    return out


def _shares(n, most: int, member: str):
    """The share of a member, where `n` members are dealt out by hash."""
    return F.pmod(F.xxhash64(member), F.ceil(n / F.lit(most)))


def compare(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """x, p, d (Jaccard distance), linked, for pairs of ids; texts: _id, _text.
    The texts of a share of a pivot's partners stream past it."""
    partners = pairs.select(F.col("x").alias("_id"), "p", F.pmod(F.xxhash64("x"), F.lit(SHARES)).alias("s"))
    pivots = partners.select(F.col("p").alias("_id"), "p", "s").distinct()
    rows = texts.join(partners.union(pivots).hint("merge"), "_id").select("_id", "_text", "p", "s")
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "p", "s").sortWithinPartitions("p", "s", F.col("_id") != F.col("p"))

    def run(batches):
        pivot, own = None, None
        for batch in C.sliced(batches, "_text", BATCH):
            h, doc, sizes = _sets(batch, n)
            ids, ps = np.asarray(batch.column(0)), np.asarray(batch.column(2))
            ends = np.cumsum(sizes)
            out = []
            for i in range(len(ids)):
                s = h[ends[i] - sizes[i] : ends[i]]
                if ids[i] == ps[i]:
                    pivot, own = ids[i], s
                    continue
                if pivot != ps[i]:
                    raise ValueError("a pair without its pivot")
                both = len(np.intersect1d(own, s, assume_unique=True))
                either = len(own) + len(s) - both
                out.append((ids[i], pivot, 1.0 - both / either, den * both >= num * either))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.bool_()))], names=["x", "p", "d", "linked"])

    return C.staged(rows.mapInArrow(run, "x long, p long, d double, linked boolean"), "compared")


def _labelled(table: DataFrame, column: str, labels: DataFrame, name: str) -> DataFrame:
    """table with the component of `column`, itself where it has no links."""
    return table.join(labels.select(F.col("node").alias(column), F.col("component").alias(name)), column, "left").withColumn(name, F.coalesce(name, column))


def linked_pairs(sets: list[np.ndarray], half: int, num: int, den: int) -> np.ndarray:
    """Boolean matrix of the links between sets (sorted hashes): of all with
    all, or of the first `half` with the others. Intersections are products
    of 0/1 matrices over the shingles that several sets hold."""
    m = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    x, who = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    order = np.argsort(x, kind="stable")
    x, who = x[order], who[order]
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    shared = np.diff(np.concatenate([starts, [len(x)]])) > 1
    feature = np.repeat(np.cumsum(shared) - 1, np.diff(np.concatenate([starts, [len(x)]])))
    keep = np.repeat(shared, np.diff(np.concatenate([starts, [len(x)]])))
    feature, who = feature[keep], who[keep]
    left, right = (slice(0, half), slice(half, m)) if half else (slice(0, m), slice(0, m))
    both = np.zeros((half or m, m - half), np.float32)
    n = int(shared.sum())
    for i in range(0, n, 512):
        low, high = np.searchsorted(feature, [i, min(n, i + 512)])
        part = np.zeros((m, min(n, i + 512) - i), np.float32)
        part[who[low:high], feature[low:high] - i] = 1
        both += part[left] @ part[right].T
    inter = both.astype(np.int64)
    return den * inter >= num * (sizes[left][:, None] + sizes[right][None, :] - inter)


def forest(linked: np.ndarray, half: int) -> list[tuple[int, int]]:
    """(member, root) for every member that a link joins to another."""
    m = linked.shape[0] + linked.shape[1] if half else linked.shape[0]
    near = np.zeros((m, m), bool)
    if half:
        near[:half, half:], near[half:, :half] = linked, linked.T
    else:
        near = linked | linked.T
    new, out = np.ones(m, bool), []
    for root in range(m):
        if not new[root]:
            continue
        new[root] = False
        todo = [root]
        while todo:
            found = np.flatnonzero(near[todo.pop()] & new)
            new[found] = False
            todo += found.tolist()
            out += [(i, root) for i in found.tolist()]
    return out


def around_pivots(star: DataFrame, labels: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(a, b): links among the partners of each pivot, as trees. Partners are
    cut into blocks of about BLOCK: one for a pivot with few partners, else by
    their distance to the pivot and, where a distance has many, by hash. Two
    blocks whose distances lie further apart than a link allows are not
    compared. A task holds two blocks at a time, and emits trees, not pairs.
    Partners that are one component already are left alone."""
    near = _labelled(star.select("p", "x", "d"), "x", labels, "c")
    mixed = near.groupBy("p").agg(F.min("c").alias("_low"), F.max("c").alias("_high"), F.count("*").alias("_n")).where("_low <> _high").select("p", "_n")
    mixed = C.staged(mixed, "mixed-pivots")
    binned = C.staged(near.join(mixed, "p").select("p", "x", "d", F.when(F.col("_n") <= BLOCK, 0).otherwise(F.floor(F.col("d") * BINS)).cast("long").alias("bin")), "binned")
    counts = C.staged(binned.groupBy("p", "bin").agg(F.count("*").alias("_n")), "bins")
    near = C.staged(binned.join(counts, ["p", "bin"]).select("p", "x", "d", (F.col("bin") * F.lit(1 << 40) + _shares(F.col("_n"), BLOCK, "x")).alias("k")), "around")
    C.free(binned, mixed, counts)
    margin = 1.0 - num / den + 1e-9
    blocks = near.groupBy("p", "k").agg(F.min("d").alias("low"), F.max("d").alias("high"))
    other = blocks.select("p", F.col("k").alias("j"), F.col("low").alias("_low"))
    duels = blocks.join(other, "p").where((F.col("j") == F.col("k")) | (F.col("j") > F.col("k")) & (F.col("_low") - F.col("high") <= margin)).select("p", "k", "j")
    # Both blocks of a duel; a block with itself comes once.
    sides = duels.withColumn("side", F.explode(F.when(F.col("k") == F.col("j"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    sides = sides.select("p", F.when(F.col("side") == 0, F.col("k")).otherwise(F.col("j")).alias("k"), "side", F.struct(F.col("p").alias("p"), F.col("k").alias("i"), F.col("j").alias("j")).alias("duel"))
    rows = near.select("p", "k", F.col("x").alias("_id")).join(sides, ["p", "k"]).select("_id", "duel", "side")
    rows = texts.join(rows.hint("merge"), "_id").select("_id", "_text", "duel.p", "duel.i", "duel.j", "side")
    parts = int(star.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "p", "i", "j").sortWithinPartitions("p", "i", "j", "side", "_id")

    def run(batches):
        key, ids, sets, half = None, [], [], 0

        def done():
            if len(ids) < 2 or key[1] != key[2] and not 0 < half < len(ids):
                return None
            split = half if key[1] != key[2] else 0
            out = forest(linked_pairs(sets, split, num, den), split)
            return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in out], pa.int64()), pa.array([ids[j] for _, j in out], pa.int64())], names=["a", "b"])

        for batch in C.sliced(batches, "_text", BATCH):
            h, _, sizes = _sets(batch, n)
            ends = np.cumsum(sizes)
            columns = [np.asarray(batch.column(c)) for c in (0, 2, 3, 4, 5)]
            for r, (i, *now, side) in enumerate(zip(*(c.tolist() for c in columns))):
                if tuple(now) != key:
                    out = done() if key else None
                    if out is not None:
                        yield out
                    key, ids, sets, half = tuple(now), [], [], 0
                ids.append(i)
                sets.append(h[ends[r] - sizes[r] : ends[r]].copy())
                half += side == 0
        out = done() if key else None
        if out is not None:
            yield out

    out = C.staged(rows.mapInArrow(run, "a long, b long").distinct(), "around-links")
    C.free(near)
    return out


def link(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Components of the linked ids: links with pivots, then among what is
    around each pivot."""
    star = compare(pairs, texts, n, num, den)
    labels = components(star.where("linked").select(F.col("x").alias("a"), F.col("p").alias("b")))
    more = around_pivots(star, labels, texts, n, num, den)
    C.free(star)
    if not more.isEmpty():
        labels = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    C.free(more)
    return labels


def _members(rows: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(_id, _key, n_shingles, _k1, _k2 of each row; _k1, _k2, _least, _c of
    each distinct set: its least key and its component's least id).
    rows: _id, _key, _text."""
    texts = rows.select("_id", "_text")
    sets = C.staged(shingle_sets(rows, n), "sets")
    same = sets.where("n_shingles > 0").groupBy("_k1", "_k2").agg(F.min("_id").alias("_rep"), F.min("_key").alias("_least"))
    same = C.staged(same, "distinct-sets")
    pairs = star_pairs(texts, sets, same, n, num, den)
    some = pairs.select(F.col("x").alias("_id")).union(pairs.select("p")).distinct()
    candidates = C.staged(texts.join(some.hint("merge"), "_id", "left_semi"), "candidates")
    labels = link(pairs, candidates, n, num, den)
    C.free(pairs, candidates)
    return sets, _labelled(same, "_rep", labels, "_c")


def _keyed(df: DataFrame, key: str, text: str) -> tuple[DataFrame, bool]:
    """(rows with _id, _key and _text, whether keys are no ids: some are null
    or repeated)."""
    rows = df.select(F.col(key).cast("long").alias("_key"), C.text_of(text).cast("binary").alias("_text"))
    odd = bool(rows.groupBy("_key").count().where("_key is null or count > 1").limit(1).count())
    return rows.withColumn("_id", F.col("_key")), odd


def join(df: DataFrame, n: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id: for each row the size of its set and the
    least key that links lead to."""
    rows, odd = _keyed(df, key, text)
    if odd:  # rows without a key of their own are numbered, once and for all
        rows = C.staged(rows.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    sets, labelled = _members(rows, n, num, den)
    if odd:
        least = labelled.groupBy("_c").agg(F.min("_least").alias("component_id"))
        labelled = labelled.join(least, "_c")
    else:
        labelled = labelled.withColumn("component_id", F.col("_c"))
    return sets.join(labelled.select("_k1", "_k2", "component_id", F.lit(True).alias("_set")), ["_k1", "_k2"], "left").select(
        F.col("_key").alias(key), "n_shingles", F.when(F.col("_set") & (F.col("n_shingles") > 0), F.col("component_id")).otherwise(F.col("_key")).alias("component_id")
    )


def first_of_each(df: DataFrame, n: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df, one of each component: that of the least key (of rows
    with equal keys, one of them; rows without a key come last). Rows with an
    empty set all stay. Rows move once, in the anti-join with the ids to drop."""
    rows, odd = _keyed(df, key, text)
    own = f"id-{uuid.uuid4().hex}"
    if odd:
        df = C.staged(df.withColumn(own, F.monotonically_increasing_id()), "numbered")
        rows = df.select(F.col(own).alias("_id"), F.col(key).cast("long").alias("_key"), C.text_of(text).cast("binary").alias("_text"))
    sets, labelled = _members(rows, n, num, den)
    members = sets.join(labelled.select("_k1", "_k2", "_c"), ["_k1", "_k2"]).select("_id", "_key", "_c")
    if odd:
        heads = members.groupBy("_c").agg(F.min_by("_id", F.struct(F.col("_key").isNull(), "_key", "_id")).alias("_head"))
        members = members.join(heads, "_c").withColumn("_c", F.col("_head"))
    drop = C.staged(members.where("_id <> _c").select(F.col("_id").alias(own)), "dropped")
    C.free(sets)
    if odd:
        return df.join(drop.hint("merge"), own, "left_anti").drop(own)
    return df.join(drop.hint("merge"), F.col(key).cast("long") == drop[own], "left_anti")


def op2_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return join(docs, n=4, num=85, den=100)
