"""Near-duplicates: every pair that brute force finds, and few bytes on the way."""

from __future__ import annotations

import math
import os
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from siltwork.operators import similarity
from siltwork.operators.near_pairs import near_pairs
from siltwork.session import ensure_checkpoint_dir


def _texts(n: int, length: tuple[int, int], seed: int = 3) -> list[str]:
    """Texts of common and rare words, most of them with near copies, some far shorter."""
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        words = [f"слово{int(rng.paretovariate(0.4)) % 3000}" for _ in range(rng.randint(*length))]
        out.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = words.copy()
            for _ in range(rng.randint(0, max(1, len(copy) // 15))):
                copy[rng.randrange(len(copy))] = f"word{rng.randrange(200)}"
            out.append(", ".join(copy))
    return list(dict.fromkeys(out))[:n]


def _brute(texts: dict[int, str], threshold: float) -> set[tuple[int, int]]:
    bags = {}
    for i, t in texts.items():
        w = re.findall(r"\w{2,}", t.lower())
        if w:
            bags[i] = Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    df = Counter(t for bag in bags.values() for t in bag)
    vectors = {}
    for i, bag in bags.items():
        v = {t: n * (math.log((1 + len(bags)) / (1 + df[t])) + 1) for t, n in bag.items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        vectors[i] = {t: x / length for t, x in v.items()}
    ids = sorted(vectors)
    return {(a, b) for a in ids for b in ids if a < b and sum(x * vectors[b].get(t, 0.0) for t, x in vectors[a].items()) >= threshold - 1e-9}


def test_all_pairs_and_no_other(spark):
    texts = dict(enumerate([*_texts(220, (3, 60)), *_texts(60, (300, 700), 4), "", "?", "лифт", "Лифт!", "one same", *[f"жду лифт {k % 7}" + "!" * k for k in range(40)]]))
    df = spark.createDataFrame(list(texts.items()), "id long, t string").repartition(3)
    rows = df.select("id", similarity.words(F.col("t")).alias("words"))
    for threshold in (0.95, 0.6):
        want = _brute(texts, threshold)
        assert len(want) > 100
        for max_terms in (4_000_000, 0):  # frequencies as one array, and joined
            found = [(r["a"], r["b"]) for r in near_pairs(rows, threshold=threshold, max_terms=max_terms).collect()]
            assert len(found) == len(set(found)) and set(found) == want


def test_no_texts(spark):
    for rows in ([], [("a", None)], [("a", "?"), ("b", "")]):
        df = spark.createDataFrame(rows, "id string, t string")
        classes, links = similarity.duplicate_links(df, id_col="id", text_col="t")
        assert classes.count() == len([t for _, t in rows if t is not None]) and links.count() == 0


def test_bytes_on_disk(spark):
    """What is shuffled and kept is a few times the texts, not a row for each term of a text."""
    texts = _texts(3000, (60, 120), 5)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    folder = sc._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    local = [d.getPath() for d in sc._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    size = lambda: {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for top in [folder, *local] for d, _, names in os.walk(top) for f in names}
    before = size()
    similarity.near_duplicates(df, id_col="id", text_col="t").write.format("noop").mode("overwrite").save()
    grown = sum(n for f, n in size().items() if f not in before)
    assert grown < 6 * sum(len(t.encode()) for t in texts), grown / sum(len(t.encode()) for t in texts)
