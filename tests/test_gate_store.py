from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from siltwork.operators import dataset, etl, feedback, model_calls, similarity
from siltwork.operators.versions import VersionStore
from siltwork.sources import readers, sinks

T = datetime.datetime(2024, 5, 1)


def test_gate_of_synthetic_rows(spark):
    rows = [("1", True, "okc", "okc", 0.9, 0.4), ("2", True, "okc", "house", 0.8, 0.4), ("3", False, "okc", "okc", 0.2, 0.9), ("4", True, None, "oos", 0.5, 0.4)]
    gate = spark.createDataFrame(rows, "id string, is_valid boolean, domain string, label string, cosine double, ratio double")
    strict = similarity.synthetic_gate(gate, found=F.col("label"), confidence=F.lit(0.7)).collect()
    assert [(r["id"], r["domain"], r["confidence"], r["source"]) for r in strict] == [("1", "okc", 0.7, "synthetic_validated")]
    loose = {r["id"]: (r["domain"], r["relabelled"]) for r in similarity.synthetic_gate(gate, found=F.col("label"), strict=False).collect()}
    assert loose == {"1": ("okc", False), "2": ("house", True), "3": ("okc", False), "4": ("oos", True)}
    trusted = similarity.synthetic_gate(gate).collect()
    assert {(r["id"], r["confidence"]) for r in trusted} == {("1", 1.0), ("2", 1.0), ("4", 1.0)}
    s = similarity.gate_statistics(gate, passed=F.col("is_valid") & (F.col("label") == F.col("domain")), relabelled=F.col("label") != F.col("domain")).first()
    assert (s["total"], s["passed"], s["relabelled"], s["low_similarity"], s["many_changes"], s["pass_rate"]) == (4, 1, 1, 1, 1, 0.25)
    assert similarity.synthetic_gate(gate.limit(0)).count() == 0


def test_drop_invalid(spark):
    df = spark.createDataFrame([(1, (True,)), (2, (False,)), (3, (None,)), (4, None)], "id long, quality_metrics struct<is_valid: boolean>")
    assert [r["id"] for r in similarity.drop_invalid(df).orderBy("id").collect()] == [1, 3, 4]


def test_seeds_and_defaults(spark):
    df = spark.createDataFrame([(i, "t", "a" if i % 2 else "", "b") for i in range(90)] + [(91, "", "a", "b"), (92, "t", None, "unknown"), (93, None, "a", "b")], "row_id long, text string, domain_true string, domain_id string")
    got = {(r["domain"], r["turn"]): r["row_id"] for r in dataset.augmentation_seeds(df, per_domain=3).collect()}
    assert got == {("a", 1): 1, ("a", 2): 3, ("a", 3): 5, ("b", 1): 0, ("b", 2): 2, ("b", 3): 4}
    d = spark.createDataFrame([("", "x", 0.0, 0.7), (None, None, None, None)], "a string, b string, c double, s double")
    out = d.select(model_calls.answer_defaults((F.col("a"), F.col("b")), (F.col("c"), F.col("s"))).alias("d")).select("d.*").collect()
    assert [tuple(r) for r in out] == [("x", 0.7), ("oos", 0.5)]


def test_cache_put_and_keys(spark):
    old = spark.createDataFrame([("k", "a", T), ("m", "b", T)], "key string, result string, ts timestamp")
    new = spark.createDataFrame([("k", "z", T + datetime.timedelta(1)), (None, "q", T), ("n", "c", T)], "key string, result string, ts timestamp")
    assert {(r["key"], r["result"]) for r in model_calls.cache_put(old, new).collect()} == {("k", "z"), ("m", "b"), ("n", "c")}
    keys = spark.createDataFrame([("t", "c" * 200), ("t", ""), (None, None)], "t string, c string").select(model_calls.label_key(F.col("t"), ("y", "x"), F.col("c")).alias("k")).collect()
    assert [r["k"] for r in keys] == ["t|x,y|" + "c" * 100, "t|x,y", "|x,y"]


def test_queue(spark):
    df = spark.createDataFrame([(1, "pending", 0.6), (2, "pending", 0.1), (3, "approved", 0.0), (4, "pending", None), (5, "pending", 0.45)], "review_id long, status string, confidence double")
    df = df.withColumn("created_at", F.lit(T)).withColumn("priority", feedback.priority_of(F.col("confidence")))
    assert [r["review_id"] for r in feedback.queue_order(df, 3).collect()] == [2, 4, 5]
    s = {(r["kind"], r["name"]): r["n"] for r in feedback.queue_statistics(df, statuses=("pending", "skipped"), priorities=("critical", "low")).collect()}
    assert s == {("all", ""): 5, ("status", "pending"): 4, ("status", "skipped"): 0, ("priority", "critical"): 3, ("priority", "low"): 0}


def test_versions_have_status_names_and_bytes(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path / "store"))
    assert store.statistics().first()["n_versions"] == 0
    df = spark.createDataFrame([(1, "a"), (2, "b")], "row_id long, text string")
    one = store.commit(df, as_of=T)
    two = store.commit(df.limit(1), as_of=T + datetime.timedelta(hours=1))
    store.add_tag(two, "production", as_of=T + datetime.timedelta(hours=2))
    store.add_tag(two, "production", as_of=T + datetime.timedelta(hours=3))
    store.set_status(two, "active", as_of=T + datetime.timedelta(hours=4))
    assert [r["tag"] for r in store.listed().collect()] == [two, one]
    assert [r["tag"] for r in store.listed(status="active", name="production").collect()] == [two]
    assert store.versions().where(F.col("tag") == two).first()["tags"] == ["production"]
    assert store.archive(keep=1, as_of=T + datetime.timedelta(hours=5)) == 1 and store.archive(keep=1, as_of=T) == 0
    s = store.statistics().first()
    assert s["by_status"] == {"active": 1, "archived": 1} and s["n_rows"] == 3 and s["n_bytes"] > 0 and s["latest"] == two
    store.export(one, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / one)).count() == 2
    with pytest.raises(KeyError):
        store.set_status("v9.9.9", "active", as_of=T)


def test_lines_that_cant_be_read_are_counted(spark):
    rows = [(1, '{"a": 1}'), (1, '{"a": 1'), (1, "[1]"), (1, " "), (2, None), (2, '{"b": {"c": [1, null]}}'), (None, "x")]
    got = {r["file_id"]: (r["n_lines"], r["n_errors"]) for r in etl.ingest_errors(spark.createDataFrame(rows, "file_id long, payload string")).collect()}
    assert got == {1: (3, 2), 2: (1, 0), None: (1, 1)}


def test_reports(spark):
    counts = spark.createDataFrame([("a", "a", 5, 1), ("a", "b", 3, 0), ("b", "a", 4, 2), ("c", "c", 1, 0)], "predicted string, corrected string, n long, recent long")
    assert {(r["predicted"], r["n"], r["corrections"]) for r in feedback.corrections_by_domain(counts).collect()} == {("a", 8, 3), ("b", 4, 4), ("c", 1, 0)}
    assert [(r["predicted"], r["n"]) for r in feedback.top_corrections(counts, 1).collect()] == [("b", 4)]
    m = spark.createDataFrame([("u", T), ("u", T - datetime.timedelta(days=3)), ("v", T - datetime.timedelta(days=2)), (None, T)], "user string, at timestamp")
    assert [(r["user"], r["n"]) for r in feedback.active_users(m, user=F.col("user"), at=F.col("at"), as_of=T + datetime.timedelta(hours=1)).collect()] == [("u", 2)]
    w = spark.createDataFrame([("u", "x", 0.5), ("v", "x", 0.25), ("v", "y", 0.6)], "user string, domain string, weight double")
    assert [r["domain"] for r in feedback.top_preferences(w, 1).collect()] == ["x"]


def test_sinks(spark, tmp_path):
    df = spark.range(25).select("id", (F.col("id") % 3).cast("string").alias("domain"))
    sinks.write_sharded(df, str(tmp_path / "parts"), rows=10, order="id", whole=str(tmp_path / "whole"))
    assert spark.read.json(str(tmp_path / "parts")).groupBy("shard").count().count() == 3 and spark.read.json(str(tmp_path / "whole")).count() == 25
    assert len(sinks.list_chunks(spark, str(tmp_path / "parts" / "shard=*"))) == 3 and sinks.list_chunks(spark, str(tmp_path / "none*")) == []
    path = str(tmp_path / "rows")
    assert sinks.write_or_delete(df, path) and sinks.exists(spark, path)
    assert not sinks.write_or_delete(df.limit(0), path) and not sinks.exists(spark, path)
    sinks.write_metadata(df.agg(F.count("*").alias("n_rows")), dataset.distributions(df, ("domain",)), str(tmp_path / "meta"))
    (file,) = [f for f in (tmp_path / "meta").iterdir() if f.name.startswith("part-")]
    assert json.loads(file.read_text()) == {"n_rows": 25, "distributions": {"domain": {"0": 9, "1": 8, "2": 8}}}
    (tmp_path / "queue.jsonl").write_text('{"a": 1}\n{"broken\n\n{"a": 2}\n{"a": 3}\n')
    assert [r["a"] for r in readers.read_queue(spark, str(tmp_path / "queue.jsonl"), 2).collect()] == [1, 2]
