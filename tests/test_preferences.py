from __future__ import annotations

import random
from fractions import Fraction

from pyspark.sql import functions as F

from siltwork.operators import feedback


def loop(domains):
    """Exact weights of one user's domains, oldest message first."""
    w: dict[str, Fraction] = {}
    for d in domains:
        first = not w
        w = {k: v / 2 for k, v in w.items()}
        w[d] = w.get(d, 0) + (1 if first else Fraction(1, 2))
    return w


def test_preferences_over_all_messages(spark):
    rnd = random.Random(5)
    users = {"long": ["view"] * 30 + ["purchase"] * 30 + ["click"] * 40, "longer": ["b", "a", "c"] + ["d"] * 1500, "one": ["x"], "tie": ["a", "a", "a", "b"], "late tie": ["a", "a", "b", *"c" * 50]}
    users |= {f"r{i}": [rnd.choice("abcde"[: rnd.randint(1, 5)]) for _ in range(rnd.randint(1, 90))] for i in range(40)}
    rows = [(i, u, d) for u, ds in users.items() for i, d in enumerate(ds)]
    df = spark.createDataFrame(rows, "id int, user string, domain string").withColumn("at", F.timestamp_seconds(F.floor(F.col("id") / 2)))
    weights = feedback.preferences(df, user="user", domain="domain", at="at", id_col="id")
    got = {(r["user"], r["domain"]): r["weight"] for r in weights.collect()}
    exact = {u: loop(ds) for u, ds in users.items()}
    assert set(got) == {(u, d) for u, w in exact.items() for d in w}
    assert all(abs(got[u, d] - float(x)) < 1e-12 for u, w in exact.items() for d, x in w.items())
    top: dict[str, list] = {}
    for r in feedback.preferred_domains(weights).orderBy("user", "turn").collect():
        top.setdefault(r["user"], []).append(r["domain"])
    assert top == {u: sorted(w, key=lambda d: (-w[d], d))[:3] for u, w in exact.items()}
    assert top["long"] == ["click", "purchase", "view"] and top["longer"] == ["d", "c", "a"]
