from __future__ import annotations

import json

from siltwork.operators.schema_drift import (
    field_features, file_changes, flood, majority_type, name_similarity, parse_line, schema_changes, tied_names, unified_records, value_features,
)

SCHEMA_F = "file_id long, feed string, period_start timestamp"
SCHEMA_L = "line_id long, file_id long, line_no int, payload string"


def tables(spark, files):
    """files: list of (feed, day, [objects or raw strings])."""
    fs = [(i, feed, f"2024-01-{day:02d}") for i, (feed, day, _) in enumerate(files)]
    ls, n = [], 0
    for i, (_, _, lines) in enumerate(files):
        for k, x in enumerate(lines):
            ls.append((n, i, k, x if x is None or isinstance(x, str) else json.dumps(x, ensure_ascii=False)))
            n += 1
    f = spark.createDataFrame(fs, "file_id long, feed string, period string").selectExpr("file_id", "feed", "cast(period as timestamp) period_start")
    return f, spark.createDataFrame(ls, SCHEMA_L)


def changes(spark, files):
    return {tuple(r) for r in schema_changes(*tables(spark, files)).collect()}


TEXTS = ["не работает лифт во дворе", "Когда починят свет?", "нет воды второй день", "спасибо за ответ"]


def test_rename_add_remove_retype(spark):
    a = [{"text": t, "uid": f"u-{i:05d}", "metadata": {"duration_s": 60 * i + 5, "locale": "ru"}} for i, t in enumerate(TEXTS)]
    b = [{" Message ": t + "!", "UID": 100 + i, "metadata": json.dumps({"dur": 61 * i + 9, "flag": True})} for i, t in enumerate(TEXTS)]
    got = changes(spark, [("f", 1, a), ("f", 2, [*b, '{"broken', None, "[1]", "17"])])
    assert (1, "renamed", "text", "message") in got
    assert (1, "renamed", "metadata.duration_s", "metadata.dur") in got
    assert (1, "removed", "metadata.locale", "") in got and (1, "added", "", "metadata.flag") in got
    assert (1, "retyped", "uid", "uid") in got and (1, "retyped", "metadata", "metadata") in got
    assert len(got) == 6


def test_rename_with_retype_and_order(spark):
    a = [{"ts": f"2024-01-01T10:00:{i:02d}Z", "n": i} for i in range(5)]
    b = [{"timestamp": 1704103200 + i, "n": i} for i in range(5)]
    # Another feed tells that `timestamp` may hold text as well.
    c = [{"timestamp": f"2024-02-01T11:20:{i:02d}Z", "n": i} for i in range(40)]
    got = changes(spark, [("f", 2, b), ("f", 1, a), ("g", 1, c)])
    assert got == {(0, "renamed", "ts", "timestamp"), (0, "retyped", "timestamp", "timestamp")}


def test_nulls_are_absent_and_empty_files(spark):
    got = changes(spark, [("f", 1, [{"a": 1, "b": None}]), ("f", 2, [{"a": 2, "b": "now"}]), ("f", 3, []), ("f", 4, [{"a": 1}])])
    assert got == {(1, "added", "", "b"), (2, "removed", "a", ""), (2, "removed", "b", ""), (3, "added", "", "a")}


def test_empty_tables(spark):
    f, lines = tables(spark, [("f", 1, [{"a": 1}])])
    assert schema_changes(f.limit(0), lines).count() == 0
    assert schema_changes(f, lines.limit(0)).count() == 0
    assert unified_records(f, lines.limit(0)).columns == ["line_id", "file_id", "line_no", "rest"]


def test_unified_table(spark):
    a = [{"text": t, "n": i, "metadata": {"x": [1, 2], "mix": 1}} for i, t in enumerate(TEXTS)]
    b = [{"msg": t + "?", "n": i + 0.5, "metadata": {"x": [2, 3], "mix": "one"}} for i, t in enumerate(TEXTS)]
    out = unified_records(*tables(spark, [("f", 1, a), ("f", 2, [*b, "oops"])]))
    assert dict(out.dtypes) == {"line_id": "bigint", "file_id": "bigint", "line_no": "int", "metadata__mix": "string", "metadata__x": "string", "n": "double", "msg": "string", "rest": "map<string,string>"}
    rows = out.orderBy("line_id").collect()
    assert len(rows) == 8 and rows[0]["msg"] == TEXTS[0] and rows[7]["n"] == 3.5 and rows[0]["metadata__x"] == "[1, 2]"


def test_pieces():
    assert parse_line('{"A ": null, "metadata": "no json"}') == {"metadata": "no json"}
    assert parse_line('{"metadata": "{\\"K\\": 1}"}') == {"metadata": '{"K": 1}', "metadata.k": 1}
    assert majority_type({"t:string": 2, "t:integer": 2}) == "string"
    assert name_similarity("metadata.dur", "metadata.duration_s") >= 0.8 > name_similarity("metadata.geo", "metadata.lang")
    near = flood({"x": value_features("2024-01-01")}, {"y": value_features("2024-02-03")}, {})[("x", "y")]
    far = flood({"x": value_features("2024-01-01")}, {"y": value_features({"k": ["слово"]})}, {})[("x", "y")]
    assert near > far


def profile(lines):
    values: dict[str, list] = {}
    for line in lines:
        for field, value in parse_line(json.dumps(line)).items():
            values.setdefault(field, []).append(value)
    return {f: field_features(v) for f, v in values.items()}


def test_nothing_is_renamed_unless_scores_flow():
    old = profile([{"text": t, "n": i} for i, t in enumerate(TEXTS)])
    new = profile([{"msg": t + "!", "n": i} for i, t in enumerate(TEXTS)])
    assert ("renamed", "text", "msg") in file_changes(old, new, {})
    assert {x[0] for x in file_changes(old, new, {}, propagation=0.0)} == {"removed", "added"}


def test_nested_keys_flow_into_their_fields():
    # Values have nothing in common; what ties the two objects is their keys, one of them renamed,
    # and that takes more than one round. A third field has as likely a name, and no such keys.
    old = profile([{"spot": {"district": w, "zone": i, "lat": i + 0.5}} for i, w in enumerate(("Плёс", "Юг", "Север"))])
    new = profile([{"where": {"district": w, "zone": w, "latitude": w}, "whence": {"p": w, "q": w, "r": w}} for w in ("QQ-1", "ZZ-2", "KK-3")])
    whole, once = flood(old, new, {}), flood(old, new, {}, rounds=2)
    assert whole["spot", "where"] > whole["spot", "whence"] and whole["spot", "where"] > once["spot", "where"] + 0.01
    assert ("renamed", "spot", "where") in file_changes(old, new, {}, threshold=0.25)
    assert ("renamed", "spot", "where") not in file_changes(old, new, {}, threshold=0.25, propagation=0.0)


def test_flooding_settles_and_stays_in_bounds():
    old = profile([{"a": {"k": 1, "m": "x"}, "b": "один два", "metadata": {"c": 5}}])
    new = profile([{"d": {"k": 2, "n": "y"}, "e": "один три", "metadata": {"f": 6}}])
    scores = flood(old, new, {})
    assert scores == flood(old, new, {}, rounds=300) and all(0 <= s <= 1 for s in scores.values())
    assert ("metadata", "metadata") not in scores and ("b", "metadata.f") not in scores


def test_stray_values_stand_in_rest(spark):
    rows = [{"n": i, "share": f"0.{i + 1}", "flag": bool(i % 2)} for i in range(18)]
    rows += [{"n": "many", "share": 0.5, "flag": "yes"}, {"n": 2**70, "share": "half", "flag": {"x": None}, "file_id": "mine", "FILE.ID ": "\ud800"}]
    out = unified_records(*tables(spark, [("f", 1, rows)]))
    kinds = dict(out.dtypes)
    assert (kinds["n"], kinds["share"], kinds["flag"], kinds["file_id_2"], kinds["file__id"]) == ("bigint", "double", "boolean", "string", "string")
    got = out.orderBy("line_no").collect()
    assert got[3]["n"] == 3 and got[3]["share"] == 0.4 and got[3]["rest"] is None and got[18]["flag"] is True
    assert got[18]["rest"] == {"n": '"many"'} and got[19]["rest"] == {"n": str(2**70), "share": '"half"', "flag": '{"x": null}'}
    assert got[19]["file_id"] == 0 and got[19]["file_id_2"] == "mine"


def test_names_of_one_meaning_are_tied_over_feeds(spark):
    same = [{"text": t + f" {i}", "user": f"u-{i:05d}"} for i, t in enumerate(TEXTS * 3)]
    other = [{"utterance": t + f" {i}", "uid": f"u-{i + 4:05d}"} for i, t in enumerate(TEXTS * 3)]
    out = unified_records(*tables(spark, [("f", 1, same), ("g", 1, other)]))
    assert set(out.columns) == {"line_id", "file_id", "line_no", "text", "uid", "rest"}
    p = {"a": field_features(["один два"]), "b": field_features(["один два"]), "c": field_features(["один два"])}
    assert tied_names(p, {}, []) == {"b": "a", "c": "a"}
    assert tied_names(p, {"a": {"b"}, "b": {"a"}}, [("b", "c")]) == {"c": "b"} and tied_names(p, {}, [], prefer=("z", "c")) == {"a": "c", "b": "c"}


def test_a_hot_file_is_read_in_parts(spark):
    lines = [(i, 1 if i % 3 else i, 0, json.dumps({"a": i, "b": TEXTS[i % 4]})) for i in range(300)]
    files = spark.createDataFrame([(i, "f", f"2024-01-{i % 28 + 1:02d}") for i in range(300)], "file_id long, feed string, period string").selectExpr("file_id", "feed", "cast(period as timestamp) period_start")
    from siltwork.operators import schema_drift

    held, schema_drift._HELD = schema_drift._HELD, 10
    try:
        table, everywhere = schema_drift.field_profiles(spark.createDataFrame(lines, SCHEMA_L))
    finally:
        schema_drift._HELD = held
    got = {(r["file_id"], r["field"]): (r["kind"], r["profile"]["t:integer" if r["field"] == "a" else "t:string"]) for r in table.collect()}
    assert got[1, "a"] == ("integer", 200.0) and got[3, "b"] == ("string", 1.0) and len(got) == 2 * 101
    assert everywhere["a"]["t:integer"] == 300 and schema_changes(files, spark.createDataFrame(lines, SCHEMA_L)).count() > 0
