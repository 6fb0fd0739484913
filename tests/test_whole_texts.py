from __future__ import annotations

import math
import re
from collections import Counter

from siltwork.plans import queries

ORIGINALS = ["Передать показания счётчика за воду", "Не работает лифт в подъезде", "Где оплатить квитанцию?", "12", None]
VARIANTS = [["передать показания счётчика за ВОДУ", "Сообщить показания счётчика воды", "Ёж 7"], ["Лифт в подъезде не работает"], ["Где оплатить квитанцию!", None], ["13", "?"], ["нет"]]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def terms(text):
    w = re.findall(r"\w{2,}", text.lower())
    return Counter([*w, *(f"{x} {y}" for x, y in zip(w, w[1:]))])


def cosine(a, b, corpus):
    docs = [terms(t) for t in [*corpus, a, b]]
    idf = lambda t: math.log((1 + len(docs)) / (1 + sum(t in d for d in docs))) + 1
    va, vb = ({t: n * idf(t) for t, n in d.items()} for d in docs[-2:])
    norms = math.sqrt(sum(x * x for x in va.values()) * sum(x * x for x in vb.values()))
    return sum(x * vb.get(t, 0) for t, x in va.items()) / norms if norms else 0.0


def test_gate_and_distance_of_whole_texts(spark, tmp_path):
    rows = list(zip(range(len(ORIGINALS)), ORIGINALS, VARIANTS))
    spark.createDataFrame(rows, "aug_id long, original_text string, variants array<string>").write.parquet(str(tmp_path / "augmentation_result.parquet"))
    pairs = {f"{i}-{k}": (a, b) for i, a, vs in rows if a is not None for k, b in enumerate(vs) if b is not None}
    got = {r["id"]: (r["distance"], r["ratio"]) for r in queries.levenshtein_pairs(spark, str(tmp_path)).collect()}
    want, issues = {}, Counter()
    for i, (a, b) in pairs.items():
        d = distance(a.lower(), b.lower())
        ratio = d / max(len(a), len(b))
        want[i] = (d, round(ratio, 6))
        c = cosine(a, b, [t for t in ORIGINALS if t is not None])
        issues[",".join(x for x, on in (("high similarity", c > 0.95), ("low similarity", c < 0.3), ("few changes", d < 3), ("many changes", ratio > 0.8)) if on)] += 1
    assert got == want
    assert {r["issues"]: r["n"] for r in queries.quality_gate(spark, str(tmp_path)).collect()} == dict(issues)
