from pyspark.sql import functions as F

from lodestone.llm import components, vector_dedup
from lodestone.llm._common import Tables


def broadcasts(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_what_grows_with_the_table_is_not_broadcast(spark, monkeypatch):
    # op5 at 6 GB: files that were small by their encoding were broadcast, 1.5 million rows of a hub's neighbours among them
    seen = []
    write = Tables.__call__
    monkeypatch.setattr(Tables, "__call__", lambda self, df, name: seen.append((name, broadcasts(df))) or write(self, df, name))
    rows = spark.range(60).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.col("id") / 1e4, F.lit(0.5)).alias("embedding"), F.lit(1).alias("label"))
    out = vector_dedup.near_duplicates(rows)
    assert [r["n_links"] for r in out.collect()] == [59] * 60
    assert {"stars", "nodes", "found", "links", "info"} <= {name for name, _ in seen}
    assert not [x for x in seen if x[1]] and not broadcasts(out)


def test_a_salted_hub_is_not_broadcast(spark):
    rows = spark.range(9).select((F.col("id") % 1).alias("u"), F.col("id").alias("v"))
    for salts in (1, 4):
        got = components._to_least(rows, rows.groupBy("u").agg(F.min("v").alias("m")), salts)
        assert got.count() == 9 and not broadcasts(got)
