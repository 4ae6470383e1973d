"""Tables, added columns and what roles see."""

from pyspark.sql import functions as F

from tidewell.operators import ddl


def test_tables(spark, tmp_path):
    ddl.create(spark, "leads", {"id": "bigint", "title": "string", "balance": "double"}, "id", f"file://{tmp_path}/leads", 4)
    ddl.create(spark, "leads", {"id": "bigint"}, "id", f"file://{tmp_path}/leads", 4)  # there already
    rows = spark.range(100).select("id", F.concat(F.lit("t"), "id").alias("title"), (F.col("id") - 50.0).alias("balance"))
    ddl.insert(rows.where("id < 50"), "leads")
    assert ddl.migrate(spark, "leads", {"status": ("string", "'NEW'"), "notes": ("string", None), "title": ("string", "'x'")}) == ["status", "notes"]
    assert ddl.migrate(spark, "leads", {"status": ("string", "'NEW'")}) == []
    ddl.insert(rows.where("id >= 50").withColumn("status", F.lit("OLD")), "leads")
    ddl.insert(rows.where("id = 0").withColumn("id", F.col("id") + 1000), "leads")  # takes the default
    got = {r.id: (r.title, r.status, r.notes) for r in spark.table("leads").collect()}
    assert got == {i: (f"t{i}", "NEW" if i < 50 else "OLD", None) for i in range(100)} | {1000: ("t0", "NEW", None)}
    # Joins by the key need no shuffle.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = spark.table("leads").alias("a").join(spark.table("leads").alias("b"), "id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan
    views = ddl.apply_policies(spark, "leads", [ddl.Policy("reader", "balance >= 0", ("id", "title"), (("title", "'***'"),)), ddl.Policy("owner")])
    seen = spark.table(views["reader"])
    assert seen.columns == ["id", "title"] and seen.count() == 50 and {r.title for r in seen.collect()} == {"***"}
    assert spark.table(views["owner"]).count() == 101
    ddl.drop(spark, "leads", ["reader", "owner"])
    assert not spark.catalog.tableExists("leads")
