"""Text similarity: edit distance, TF-IDF cosine, the gate of synthetic texts, near-duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltwork.config import QualityConfig
from siltwork.operators.near_pairs import near_pairs
from siltwork.session import bounded_broadcast, materialised


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """Edit distance by the longer length; two empty texts give 0."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / longest)


def words(text: Column) -> Column:
    """Words of two or more letters, digits or underscores in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def terms(text: Column) -> Column:
    """The words of a text, and pairs of neighbours."""
    own = words(text)
    pairs = F.zip_with(F.slice(own, F.lit(1), F.greatest(F.size(own) - 1, F.lit(0))), F.slice(own, F.lit(2), F.greatest(F.size(own) - 1, F.lit(0))), lambda x, y: F.concat(x, F.lit(" "), y))
    return F.when(F.size(own) < 2, own).otherwise(F.concat(own, pairs))


def term_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``term``, ``tf`` of every text."""
    return df.select(F.col(id_col).alias("id"), F.explode(terms(F.col(text_col))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, max_features: int | None = 5000) -> DataFrame:
    """``term``, ``df``, ``tf`` of the most frequent terms of a corpus (ties: alphabetical)."""
    terms_ = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
    return terms_ if max_features is None else terms_.orderBy(F.desc("tf"), "term").limit(max_features)


def tfidf(counts: DataFrame, n_docs: int, vocab: DataFrame) -> DataFrame:
    """``id``, ``term``, ``weight``: tf times smoothed idf, of length one for each text."""
    idf = vocab.select("term", (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    raw = counts.join(bounded_broadcast(idf), "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    # The terms of one text come together once, for its length; no second shuffle brings it back.
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("id")))
    return raw.select("id", "term", (F.col("w") / norm).alias("weight"))


def pair_cosine(pairs: DataFrame, *, id_col: str = "id", a: str = "a", b: str = "b", corpus: DataFrame | None = None, corpus_text: str = "text") -> DataFrame:
    """``id``, ``cosine`` of each pair, as if TF-IDF were fitted on the corpus and the pair.

    The corpus is counted once; a pair adds its own texts to the counts of its terms. A pair with
    a text without terms has cosine 0; with neither terms nor corpus, 0.5.
    """
    both = pairs.select(F.col(id_col).alias("id"), terms(F.col(a)).alias("ta"), terms(F.col(b)).alias("tb"))
    n = 0
    long = both.select("id", F.explode(F.concat(F.transform("ta", lambda t: F.struct(t.alias("term"), F.lit(1).alias("a"), F.lit(0).alias("b"))),
                                                F.transform("tb", lambda t: F.struct(t.alias("term"), F.lit(0).alias("a"), F.lit(1).alias("b"))))).alias("x"))
    tf = long.groupBy("id", "x.term").agg(F.sum("x.a").alias("fa"), F.sum("x.b").alias("fb"))
    if corpus is not None:
        texts = corpus.select(F.col(corpus_text).alias("t")).where("t IS NOT NULL")
        n = texts.count()
        df = texts.select(F.explode(F.array_distinct(terms(F.col("t")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        tf = tf.join(df, "term", "left")
    else:
        tf = tf.withColumn("df", F.lit(0))
    seen = F.coalesce("df", F.lit(0)) + (F.col("fa") > 0).cast("int") + (F.col("fb") > 0).cast("int")
    idf = F.log((3.0 + n) / (1.0 + seen)) + 1.0
    wa, wb = F.col("fa") * idf, F.col("fb") * idf
    sums = tf.groupBy("id").agg(F.sum(wa * wb).alias("ab"), F.sum(wa * wa).alias("aa"), F.sum(wb * wb).alias("bb"))
    cos = F.when(F.col("aa").isNull(), F.lit(0.5 if corpus is None else 0.0)).when((F.col("aa") > 0) & (F.col("bb") > 0), F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).otherwise(0.0)
    return both.select("id").join(sums, "id", "left").select("id", cos.alias("cosine"))


def quality_gate(pairs: DataFrame, cosine: DataFrame, *, id_col: str = "id", a: str = "a", b: str = "b", config: QualityConfig = QualityConfig()) -> DataFrame:
    """Similarity of original ``a`` and synthetic ``b``, the issues found, and whether there is none."""
    la, lb = F.lower(F.col(a)), F.lower(F.col(b))
    out = pairs.withColumnRenamed(id_col, "id").join(cosine, "id").withColumn("levenshtein", F.levenshtein(la, lb)).withColumn("ratio", levenshtein_ratio(la, lb))
    checks = [
        F.when(F.col("cosine") > config.max_cosine, "high similarity"), F.when(F.col("cosine") < config.min_cosine, "low similarity"),
        F.when(F.col("levenshtein") < config.min_changes, "few changes"), F.when(F.col("ratio") > config.max_ratio, "many changes"),
    ]
    return out.withColumn("issues", F.array_compact(F.array(*checks))).withColumn("is_valid", F.size("issues") == 0)


def synthetic_gate(gate: DataFrame, *, domain: str = "domain", found: Column | None = None, confidence: Column | None = None, strict: bool = True) -> DataFrame:
    """Synthetic rows that pass, from the result of ``quality_gate`` with an expected ``domain``.

    ``found``: label of the synthetic text as classified again, with its ``confidence``; without it
    the expected domain stands with confidence 1. Strict: rows with issues or another label than
    expected are dropped; else they are kept, under the label found. ``relabelled`` tells where that
    differs. A null expected domain is unlike any label.
    """
    rows = gate.withColumn("expected", F.col(domain)).withColumn("found", F.col(domain) if found is None else found)
    rows = rows.withColumn("relabelled", ~F.col("found").eqNullSafe(F.col("expected")))
    rows = rows.withColumn("confidence", F.lit(1.0) if confidence is None else confidence).withColumn(domain, F.col("found"))
    rows = rows.drop("found", "expected").withColumn("source", F.lit("synthetic_validated"))
    return rows.where(F.col("is_valid") & ~F.col("relabelled")) if strict else rows


def gate_statistics(gate: DataFrame, *, passed: Column, relabelled: Column, config: QualityConfig = QualityConfig()) -> DataFrame:
    """One row: ``total``, ``passed``, ``relabelled`` (another label, of rows without issues),
    ``low_similarity``, ``high_similarity``, ``many_changes`` (a row may count in several), and the
    rates of the first two by the total, null for an empty table."""
    out = gate.agg(
        F.count("*").alias("total"), F.count_if(passed).alias("passed"), F.count_if(relabelled & F.col("is_valid")).alias("relabelled"),
        F.count_if(F.col("cosine") < config.min_cosine).alias("low_similarity"), F.count_if(F.col("cosine") > config.max_cosine).alias("high_similarity"),
        F.count_if(F.col("ratio") > config.max_ratio).alias("many_changes"),
    )
    return out.withColumn("pass_rate", F.try_divide("passed", "total")).withColumn("relabel_rate", F.try_divide("relabelled", "total"))


def drop_invalid(df: DataFrame, metrics: str = "quality_metrics") -> DataFrame:
    """Rows without those whose ``metrics.is_valid`` is false; where it is missing the row stays."""
    return df.where(F.coalesce(F.col(f"`{metrics}`.is_valid"), F.lit(True)))


def duplicate_links(df: DataFrame, *, id_col: str, text_col: str, threshold: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """(``t``, ``class_id``, ``copies`` of every distinct text; ``a``, ``b`` of every two classes
    whose TF-IDF cosine is at least ``threshold``).

    Vectors are fitted on all distinct texts with all their terms; ``near_pairs`` finds the pairs.
    Links are between classes, so copies of a text cost nothing. Texts without terms link to
    nothing; null texts are in no class; an empty table gives two empty tables.
    """
    base = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t")).where("t IS NOT NULL")
    classes = materialised(base.groupBy("t").agg(F.min("id").alias("class_id"), F.count("*").alias("copies")))
    return classes, near_pairs(classes.select(F.col("class_id").alias("id"), words(F.col("t")).alias("words")), threshold=threshold)


def near_duplicates(df: DataFrame, *, id_col: str, text_col: str, threshold: float = 0.95) -> DataFrame:
    """``id``, ``class_id``, ``n_links``: class of equal texts and number of other classes that
    ``duplicate_links`` ties to it. Null texts have no row."""
    classes, links = duplicate_links(df, id_col=id_col, text_col=text_col, threshold=threshold)
    base = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t")).where("t IS NOT NULL")
    ends = links.select(F.col("a").alias("class_id")).unionAll(links.select(F.col("b").alias("class_id"))).groupBy("class_id").agg(F.count("*").alias("n_links"))
    # Texts meet their class by digest, so that they aren't shuffled again.
    digest = F.unhex(F.sha2("t", 256)).alias("digest")
    linked = classes.select("class_id", digest).join(ends, "class_id", "left")
    return base.select("id", digest).join(linked, "digest").select("id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def duplicate_share(df: DataFrame, *, id_col: str, text_col: str, threshold: float = 0.95) -> DataFrame:
    """One row, ``dup``: pairs of rows with equal or near-equal texts, by the number of rows with a
    text (null for none). Pairs are counted by class, never listed."""
    classes, links = duplicate_links(df, id_col=id_col, text_col=text_col, threshold=threshold)
    size = lambda c: classes.select(F.col("class_id").alias(c), F.col("copies").alias("n" + c))
    between = links.join(size("a"), "a").join(size("b"), "b").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("between"))
    within = classes.agg(F.sum(F.col("copies") * (F.col("copies") - 1) / 2).alias("within"), F.sum("copies").alias("n"))
    return within.crossJoin(F.broadcast(between)).select(F.try_divide(F.col("within") + F.col("between"), "n").alias("dup"))  # two tables of one row
