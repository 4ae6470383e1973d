import hashlib
import random
import zlib

import public_tokenizers as P
import pytest

from tidewell.llm import byte_bpe, media, token_counts

WILD = ["", " ", "  ", "a", "Hello  world", "  lead and trail  ", "tab\tnew\n\nline\r\n x", "<s> </s><|endoftext|>", "ﬁ①é▁x ▁▁y", "don't we'll 'tis 123 4567", "\x1c\x1d\x85  　z", "ñandú ÉTÉ straße ΣΑΣ 日本語テキスト 👩‍👩‍👧", "x" * 300, " " * 300, "a b" * 50]


def wild(n, seed=5):
    rng = random.Random(seed)
    atoms = ["the", " ", "  ", "\n", "\t", "'ll", "é", "日本", "42", "!!", "a" * 40, "▁", "\x1c", "\xa0", " " * 37, "ZZ"]
    return WILD + ["".join(rng.choice(atoms) for _ in range(rng.randrange(1, 400))) for _ in range(n)]


def rows(spark, texts):
    data = [(i, t, "en", f"s{i % 3}", len(t) if t else 0, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, n_tokens string")


def test_counts_equal_the_library(spark):
    import sentencepiece

    model = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = wild(60) + [None, None]
    got = {r.doc_id: r for r in token_counts.token_counts(rows(spark, texts), model, (10, 4096)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i].n_tokens == len(sp.encode(t or "")), repr(t)
        assert got[i].n_bytes == len((t or "").encode())


def test_every_prefix_and_budget():
    import sentencepiece

    model = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    c = token_counts.PrefixCounter(model)
    for t in wild(12, 9):
        t = t[:120]
        table = c.table(t)
        exact = [len(sp.encode(t[:i])) for i in range(len(t) + 1)]
        assert [c.prefix(t, i, table) for i in range(len(t) + 1)] == exact, repr(t)
        for budget in (0, 1, 5, 17, 1000):
            best = max(i for i in range(len(t) + 1) if exact[i] <= budget)
            assert c.fits(t, budget, table) == best, (repr(t), budget)


def test_prefix_table_and_empty(spark):
    model = P.path("piece_bpe_32k.model")
    r = token_counts.prefix_table(rows(spark, ["one two"]), model).first()
    assert r.prefix_chars == [3, 7] and r.prefix_tokens[-1] == r.n_tokens
    assert token_counts.token_counts(rows(spark, ["x"]).limit(0), model).count() == 0


@pytest.mark.parametrize("chunk,overlap", [(8, 3), (32, 8), (64, 40), (16384, 256)])
def test_chunks_resynchronise(chunk, overlap):
    import tiktoken

    e = byte_bpe.encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    for t in wild(60, chunk):
        want = e.library.encode_ordinary(t)
        got = e.encode(t, chunk, overlap)
        assert list(memoryview(got).cast("I")) == want, repr(t)
        assert e.decode(got).decode() == t


def test_round_trip_with_dealt_out_texts(spark):
    e = byte_bpe.encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    texts = wild(20) + [None, ("lorem ipsum " * 900), " " * 9000, "x" * 7000 + "\n" + "y " * 3000]
    args = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN
    for spread in (2500, 1 << 20):
        got = {r.doc_id: bytes(r.ids) for r in byte_bpe.encode(rows(spark, texts), *args, spread=spread).collect()}
        for i, t in enumerate(texts):
            assert list(memoryview(got[i]).cast("I")) == e.library.encode_ordinary(t or ""), (spread, i)
    out = {r.doc_id: r for r in byte_bpe.digests(rows(spark, texts), *args).collect()}
    for i, t in enumerate(texts):
        assert out[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
        assert out[i].n_tokens == len(e.library.encode_ordinary(t or ""))
    assert byte_bpe.digests(rows(spark, ["x"]).limit(0), *args).count() == 0


def test_media_round_trip(spark, tmp_path):
    texts = wild(20) + [None, "", "same", "same", "x" * 64]
    folder = f"file://{tmp_path}/m"
    stored = media.store(rows(spark, texts), folder).persist()
    out = {r.doc_id: r for r in media.with_features(media.with_metadata(stored, folder), folder).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        r = out[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.height * r.width == len(payload)
    assert out[len(texts) - 2].media_sha256 == out[len(texts) - 3].media_sha256
    stored.unpersist()


def test_shards_are_readable_tar(spark, tmp_path):
    import io
    import tarfile

    w = media.ShardWriter(f"file://{tmp_path}/s")
    data = media.to_png(b"a" * 128)
    digest = hashlib.sha256(data).digest()
    at = w.add(digest, data)
    assert w.add(digest, data) == at
    name = w.close()
    raw = (tmp_path / "s" / name).read_bytes()
    assert raw[at : at + len(data)] == data
    with tarfile.open(fileobj=io.BytesIO(raw)) as t:
        assert t.getnames() == [digest.hex() + ".png"]
    assert media.from_png(data) == b"a" * 128


def test_empty_media(spark, tmp_path):
    assert media.store(rows(spark, ["x"]).limit(0), f"file://{tmp_path}/e").count() == 0


def test_long_segments_are_encoded_once():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    c = token_counts.PrefixCounter(P.path("piece_bpe_32k.model"))
    seen = []

    class Counted:
        def __getattr__(self, name):
            return getattr(sp, name)

        def encode(self, s, **more):
            seen.append(len(s))
            return sp.encode(s, **more)

    c.model = Counted()
    rng = random.Random(4)
    for atoms in ("日本語漢字仮名交文", "abcdefABCDEF0123+/="):
        t = "".join(rng.choice(atoms) for _ in range(2000))
        exact = [len(sp.encode(t[:i])) for i in range(len(t) + 1)]
        seen.clear()
        assert c.fits(t, 100) == max(i for i in range(len(t) + 1) if exact[i] <= 100)
        assert sum(seen) < 100 * len(t)


def test_counts_at_every_prefix(spark):
    import sentencepiece

    model = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = [t[:150] for t in wild(10, 3)] + [None]
    got = {r.doc_id: r.prefix_counts for r in token_counts.prefix_table(rows(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        assert got[i] == [len(sp.encode((t or "")[:k])) for k in range(len(t or "") + 1)], repr(t)
