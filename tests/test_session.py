from __future__ import annotations

from pyspark.sql import functions as F

from siltwork.session import bounded_broadcast


def hinted(df) -> bool:
    return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()


def test_a_side_is_broadcast_only_within_its_bounds(spark):
    df = spark.range(50).select("id", F.repeat(F.lit("я"), 100).alias("t"), F.array("id").alias("a"), F.create_map(F.lit("k"), "id").alias("m"), F.lit(None).cast("string").alias("n"))
    assert hinted(bounded_broadcast(df, 50)) and not hinted(bounded_broadcast(df, 49))
    assert not hinted(bounded_broadcast(df, 50, max_bytes=10_000)) and hinted(bounded_broadcast(df, 50, max_bytes=20_000))
    assert hinted(bounded_broadcast(df.limit(0)))
