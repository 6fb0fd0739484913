from __future__ import annotations

from pyspark.sql import functions as F

from siltwork.llm.sentences import Statistics, candidates, certain, corpus_statistics


def test_rare_words_keep_all_kinds_in_a_large_corpus(spark):
    common = F.repeat(F.lit("слово конец.\n"), F.lit(50_000))
    rare = F.lit("пришёл редкая.\n" * 12 + "это редкая. потом\n" * 3)
    df = spark.range(40).select(F.when(F.col("id") == 7, F.concat(common, rare)).otherwise(common).alias("t"))
    stats = corpus_statistics(df)
    assert stats.counts["e", "конец"] == 2_000_000
    assert (stats.counts["e", "редкая"], stats.counts["i", "редкая"], stats.ends("редкая")) == (12, 3, 0.8)


def test_counts_of_the_asked_words_are_the_whole_ones(spark):
    from siltwork.llm.sentences import line_statistics, sample_words

    texts = [f"Слово{i % 7} стоит тут. Потом слово{i % 5}. и ещё т. д.\nКонец строки{i % 3}." for i in range(60)]
    whole = sum(map(line_statistics, texts), start=type(line_statistics(""))())
    words = sample_words(texts[:10])
    got = corpus_statistics(spark.createDataFrame([(t,) for t in texts], "t string"), words)
    assert got.counts == {k: n for k, n in whole.items() if k[1] in words} and len(got.counts) > 5
    for t in texts[:10]:
        for line in t.split("\n"):
            for c in candidates(line):
                assert certain(c, False, got) == certain(c, False, Statistics(dict(whole)))
