from __future__ import annotations

import json

from pyspark.sql import functions as F

from siltwork.llm import formatting_duplicates
from siltwork.llm.formatting_duplicates import canonical_json, collapse_duplicates, duplicate_members, merkle_json


def groups(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    pairs = {(r["first_id"], r["id"]) for r in duplicate_members(df, id_col="id", text_col="t").collect()}
    copies = {r["first_id"]: r["copies"] for r in collapse_duplicates(df, id_col="id", text_col="t").collect()}
    assert all(n == 1 + sum(a == first for a, _ in pairs) for first, n in copies.items())
    return pairs


def test_prose_around_an_object_counts(spark):
    texts = ['Прошу отменить {"дом": "5"}', 'Прошу принять {"дом": "5"} срочно', '{"дом": "5", "кв": 1} и {"дом": "6"}', '{"дом": "5", "кв": 1}', '- {"кв": 1, "Дом": "5"}.', "Дом: 5; кв: 1"]
    assert groups(spark, texts) == {(3, 4), (3, 5)}


def nested(depth, turn, value="Ёлка 1"):
    out = {"a": value, "b": [1.50, None, True]}
    for i in range(depth):
        items = [("x", out), ("y", f"T-{i}"), ("z", [{"p": i, "q": "w"}])]
        out = dict(items[::-1] if turn else items)
    return out


def test_members_are_unordered_at_any_depth(spark):
    texts = [json.dumps(nested(n, turn), ensure_ascii=turn, indent=turn or None) for n in (2, 7, 40) for turn in (False, True)]
    texts.append(json.dumps(nested(7, True, "other")))
    texts.append(json.dumps({"a": nested(7, True)}))
    texts.append(json.dumps({"a": json.dumps(nested(7, False))}))  # an object in a string counts as the object
    assert groups(spark, texts) == {(0, 1), (2, 3), (4, 5), (7, 8)}


def test_canonical_json_takes_whole_objects_only():
    same = str.lower
    assert canonical_json('{"a": {"c": 1, "b": [2, 1]}}', same) == canonical_json("{'A':{\"b\":[2,1],\"c\":1}} ", same) is not None
    assert canonical_json('{"a": [1, 2]}', same) != canonical_json('{"a": [2, 1]}', same)
    assert canonical_json('{"a": 1, "a": 2}', same) != canonical_json('{"a": 2}', same)
    for bad in ("", "{}", "[]", '[{"a": 1}]', '{"a": 1} x', '{"a": 1}}', '{"a" 1}', '{"a": 1,}', '{"a": }', "{a: 1}", '{"a": b}', '{"a": [1 2]}', '{"a": [1,]}', '{"a": 1', '{"a": "\\x"}'):
        assert canonical_json(bad, same) is None
    deep = '{"a":' * 50_000 + "1" + "}" * 50_000
    assert canonical_json(deep, same).count("fields") == 50_000


def test_every_node_is_hashed_from_its_children():
    leaf = formatting_duplicates._hash
    field = lambda name, value: leaf(leaf(name) + value)
    root = lambda *children: leaf("fields\x1f" + "".join(sorted(children)))
    digest, _ = merkle_json('{"a": {"c": 1, "b": "x"}, "d": [2, null]}', str.lower)
    assert digest == root(field("a", root(field("c", leaf("1")), field("b", leaf("x")))), field("d", leaf("list\x1f" + leaf("2") + leaf("\x00"))))


def test_structures_that_share_a_digest_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(formatting_duplicates, "digest", lambda c: F.unhex(F.substring(F.md5(c), 1, 2)))
    texts = [f"слово {i // 2}" if i % 2 else f"СЛОВО, {i // 2}!" for i in range(600)]
    assert groups(spark, texts) == {(i, i + 1) for i in range(0, 600, 2)}
