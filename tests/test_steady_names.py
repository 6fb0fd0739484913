from __future__ import annotations

import json
import random

from siltwork.operators.schema_drift import feed_names, unified_records


def table(spark, files):
    """files: list of (feed, [objects]); a None feed stands for lines without file."""
    fs = [(i, feed, f"2024-01-{i + 1:02d}") for i, (feed, _) in enumerate(files) if feed]
    ls = [(100 * i + k, i if feed else None, k, json.dumps(x, ensure_ascii=False)) for i, (feed, xs) in enumerate(files) for k, x in enumerate(xs)]
    f = spark.createDataFrame(fs, "file_id long, feed string, period string").selectExpr("file_id", "feed", "cast(period as timestamp) period_start")
    out = unified_records(f, spark.createDataFrame(ls, "line_id long, file_id long, line_no int, payload string"))
    return {r["line_id"]: r.asDict() for r in out.collect()}


TEXTS = ["не работает лифт во дворе", "Когда починят свет?", "нет воды второй день", "спасибо за ответ"]


def test_a_rename_in_one_feed_merges_nothing_elsewhere(spark):
    one = [{"text": t, "n": i} for i, t in enumerate(TEXTS)]
    two = [{"msg": t + "!", "n": i} for i, t in enumerate(TEXTS)]
    both = [{"text": t, "msg": "ответ: " + t} for t in TEXTS]
    rows = table(spark, [("f", one), ("f", two), ("g", both), (None, [{"late": 5, "text": "x"}])])
    assert {rows[i]["msg"] or rows[i]["text"] for i in (0, 100)} == {TEXTS[0], TEXTS[0] + "!"}
    assert (rows[0]["msg"] is None) == (rows[100]["msg"] is None)  # one column in the feed of the rename
    assert all((rows[200 + i]["text"], rows[200 + i]["msg"]) == (t, "ответ: " + t) for i, t in enumerate(TEXTS))
    assert (rows[300]["late"], rows[300]["text"]) == (5, "x")


def test_metadata_that_is_no_object_stays(spark):
    rows = table(spark, [("f", [{"a": 1, "metadata": {"k": 1}}, {"a": 2, "metadata": "web form"}, {"a": 3, "metadata": ["x", 1]}, {"a": 4, "metadata": '{"k": 2}'}])])
    assert [rows[i]["metadata"] for i in range(4)] == [None, "web form", '["x", 1]', None]
    assert [rows[i]["metadata__k"] for i in range(4)] == [1, None, None, 2]


def test_feed_names():
    assert feed_names({0: {"a"}, 1: {"b"}, 3: {"b"}}, {1: {"b": "a"}}, {"a": 5, "b": 2}) == {(1, "b"): "a", (3, "b"): "a"}
    # `a` comes back beside `b`, so `b` is the name of the first one's whole history.
    assert feed_names({0: {"a"}, 1: {"b"}, 2: {"a", "b"}}, {1: {"b": "a"}}, {"a": 5, "b": 2}) == {(0, "a"): "b"}
    rnd = random.Random(3)
    for _ in range(300):
        fields = {at: set(rnd.sample("abcdef", rnd.randint(1, 5))) for at in range(6) if rnd.random() < 0.9}
        renames = {}
        for at in fields:
            gone, new = sorted(fields.get(at - 1, set()) - fields[at]), sorted(fields[at] - fields.get(at - 1, set()))
            renames[at] = {b: a for a, b in zip(gone, new) if at - 1 in fields and rnd.random() < 0.7}
        found = feed_names(fields, renames, {c: rnd.randint(1, 9) for c in "abcdef"})
        for at, own in fields.items():
            assert len({found.get((at, f), f) for f in own}) == len(own)
