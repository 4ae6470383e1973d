"""Tables of a catalogue: bucketed and sorted files, columns that are added with
defaults, and what each role may see as views.

A table is created `CLUSTERED BY` its key into buckets and sorted inside of
them, so that joins and look-ups by the key need no shuffle; columns are added
with a default that old files answer with, without being rewritten. A row policy
is a view a role: the rows and columns that the role reads. Spark's session
catalogue knows no grants; where a metastore does, they go on these views and not
on the table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Policy:
    """What a role reads: `where` chooses rows ("" for all), `columns` columns
    (none for all), `masked` gives expressions in place of columns."""

    role: str
    where: str = ""
    columns: tuple[str, ...] = ()
    masked: tuple[tuple[str, str], ...] = ()


def create(spark: SparkSession, name: str, columns: dict[str, str], key: str, location: str, buckets: int = 64, sort: str | None = None) -> None:
    """An empty table, unless it is there."""
    fields = ", ".join(f"`{c}` {t}" for c, t in columns.items())
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({fields}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{sort or key}`) INTO {int(buckets)} BUCKETS LOCATION '{location}'")


def migrate(spark: SparkSession, name: str, columns: dict[str, tuple[str, str | None]]) -> list[str]:
    """Add the columns (name -> type and default as SQL, None: null) that the
    table lacks; what was added. Running it again adds nothing."""
    have = {c.lower() for c in spark.table(name).columns}
    new = {c: d for c, d in columns.items() if c.lower() not in have}
    for c, (kind, default) in new.items():
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS (`{c}` {kind}" + (f" DEFAULT {default})" if default is not None else ")"))
    return list(new)


def insert(df: DataFrame, name: str) -> None:
    """Append rows by column name; columns that df lacks take their default.
    Rows are dealt out by bucket first, so that a bucket is one file."""
    spark = df.sparkSession
    table = spark.table(name)
    buckets = spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name in ('Num Buckets', 'Bucket Columns')").collect()
    told = {r["col_name"]: r["data_type"] for r in buckets}
    key = told["Bucket Columns"].strip("[]`")
    columns = [c for c in table.columns if c in df.columns]
    view = f"_insert_{abs(hash((name, id(df))))}"
    df.select(*columns).repartition(int(told["Num Buckets"]), key).createOrReplaceTempView(view)
    try:
        spark.sql(f"INSERT INTO {name} ({', '.join(f'`{c}`' for c in columns)}) SELECT {', '.join(f'`{c}`' for c in columns)} FROM {view}")
    finally:
        spark.catalog.dropTempView(view)


def apply_policies(spark: SparkSession, name: str, policies: list[Policy]) -> dict[str, str]:
    """Make or replace the view of each role; role -> its view's name."""
    out = {}
    for p in policies:
        masks = dict(p.masked)
        shown = [f"{masks[c]} AS `{c}`" if c in masks else f"`{c}`" for c in (p.columns or spark.table(name).columns)]
        view = f"{name}_for_{p.role}"
        spark.sql(f"CREATE OR REPLACE VIEW {view} AS SELECT {', '.join(shown)} FROM {name}" + (f" WHERE {p.where}" if p.where else ""))
        out[p.role] = view
    return out


def drop(spark: SparkSession, name: str, roles: list[str] = ()) -> None:
    """Forget a table and its views; the files stay."""
    for role in roles:
        spark.sql(f"DROP VIEW IF EXISTS {name}_for_{role}")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
