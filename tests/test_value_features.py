from __future__ import annotations

import json

from siltwork.operators.schema_drift import file_changes, parse_line, type_name, value_features

OPENING = "настоящим сообщаем вам " * 30
TAILS = {"first": "вывоз мебели и мусора со двора " * 40, "second": "квитанция за электричество оплачена банком " * 40}


def profile(lines):
    out: dict[str, dict] = {}
    for line in lines:
        for field, value in parse_line(json.dumps(line)).items():
            p = out.setdefault(field, {})
            for k, n in [(f"t:{type_name(value)}", 1), *value_features(value).items()]:
                p[k] = p.get(k, 0) + n
    return out


def test_long_values_are_read_whole():
    old = profile([{"aa": OPENING + TAILS["first"], "bb": OPENING + TAILS["second"]}] * 5)
    new = profile([{"xx": OPENING + TAILS["second"], "yy": OPENING + TAILS["first"]}] * 5)
    assert set(file_changes(old, new, {})) == {("renamed", "aa", "yy"), ("renamed", "bb", "xx")}


def test_every_leaf_number_and_key_counts():
    assert value_features(["одно"] * 64 + ["два"]) != value_features(["одно"] * 64 + ["три"])
    assert value_features("1 " * 8 + "5000000") != value_features("1 " * 8 + "5")
    long = "k" * 40
    assert value_features({long + "a": 1}) != value_features({long + "b": 1})
    assert value_features("9" * 400)["n18"] == 1
