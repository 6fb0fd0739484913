"""Queries of the training-data operators over the tables of TESTDATA.md, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.functions.text import DOMAINS, canonical_domain
from siltwork.llm.capping import cap_contributors, valid_score
from siltwork.llm.consensus import annotation_votes, consensus
from siltwork.llm.encoding import encode_corpus
from siltwork.llm.formatting_duplicates import collapse_duplicates, duplicate_members
from siltwork.llm.grouped_splits import grouped_split, related_users, user_groups
from siltwork.llm.leakage import find_leaks
from siltwork.llm.personal_data import personal_occurrences, redact_texts
from siltwork.llm.sentences import sentences
from siltwork.session import checkpointed, table


def _consensus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    votes = annotation_votes(table(spark, sf_dir, "validation_result"), table(spark, sf_dir, "review_item"))
    items = table(spark, sf_dir, "validation_result").select(F.col("id").alias("item")).distinct()
    return consensus(votes.join(items, "item", "left_semi"), classes=DOMAINS)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domain of every validated item."""
    items, _ = _consensus(spark, sf_dir)
    return items.select(F.col("item").alias("id"), F.coalesce("label", F.lit("oos")).alias("domain"))


def p1_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain, its probability and the agreement of the labels of every item."""
    return _consensus(spark, sf_dir)[0].withColumnRenamed("item", "id")


def p1_annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability and community of every labeller run and reviewer."""
    return _consensus(spark, sf_dir)[1]


#: Key of the pseudonyms in the queries below; a real one comes from the caller.
DEMO_KEY = b"siltwork demo key"


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every personal datum in the texts of records and review items."""
    out = None
    for name, key in (("processed_record", "row_id"), ("review_item", "review_id")):
        found = personal_occurrences(table(spark, sf_dir, name).select(key, "text"), id_col=key)
        found = found.select(F.lit(name).alias("tbl"), "rec_id", "kind", "occ")
        out = found if out is None else out.unionByName(found)
    return out


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same texts with typed placeholders and linked pseudonyms."""
    out = None
    for name, key in (("processed_record", "row_id"), ("review_item", "review_id")):
        texts = redact_texts(table(spark, sf_dir, name).select(key, "text"), key=DEMO_KEY, id_col=key)
        texts = texts.select(F.lit(name).alias("tbl"), "rec_id", "text")
        out = texts if out is None else out.unionByName(texts)
    return out


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record that repeats another but for formatting, with the first of its group."""
    df = table(spark, sf_dir, "processed_record").select("row_id", "text")
    return duplicate_members(df, id_col="row_id", text_col="text").select(
        F.col("first_id").alias("first_row_id"), F.col("id").alias("row_id")
    )


def p4_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each distinct record, with its number of copies."""
    df = table(spark, sf_dir, "processed_record").select("row_id", "text")
    return collapse_duplicates(df, id_col="row_id", text_col="text").select(
        F.col("first_id").alias("first_row_id"), "copies"
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of users whose records must land in the same split."""
    records = table(spark, sf_dir, "processed_record").select("row_id", "user_id", "text")
    return related_users(records, table(spark, sf_dir, "augmentation_result"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that augmented texts tie: first user and size of the group of each."""
    records = table(spark, sf_dir, "processed_record").select("row_id", "user_id", "text")
    users = checkpointed(user_groups(records, table(spark, sf_dir, "augmentation_result")))
    groups = users.groupBy("component").agg(F.min("user").alias("first_user"), F.count("*").alias("n_users"))
    return users.join(groups, "component").select(F.col("user").alias("user_id"), "first_user", "n_users")


def p5_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split of every record: 80 % train, 10 % validation, 10 % test, no group divided."""
    records = table(spark, sf_dir, "processed_record").select("row_id", "user_id", "text")
    labels = table(spark, sf_dir, "classification_result").groupBy("row_id").agg(
        F.min(canonical_domain(F.col("domain_true"))).alias("label")
    )
    return grouped_split(
        records, table(spark, sf_dir, "augmentation_result"), labels,
        proportions={"train": 0.8, "validation": 0.1, "test": 0.1}, classes=DOMAINS,
    )


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each split its share of the records, to a hundredth, and how many of its groups are divided."""
    rows = p5_split(spark, sf_dir).groupBy("group").agg(F.count("*").alias("n"), F.min("split").alias("split"), F.max("split").alias("other"))
    per = rows.groupBy("split").agg(F.sum("n").alias("n"), F.count_if(F.col("split") != F.col("other")).alias("n_divided"))
    total = per.agg(F.sum("n").alias("total"))
    return per.crossJoin(F.broadcast(total)).select("split", F.round(F.col("n") / F.col("total"), 2).alias("share"), "n_divided")  # three rows and one


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows kept if no domain has more than 12 % of all rows."""
    df = table(spark, sf_dir, "classification_result").select("result_id", "domain_id", "confidence")
    return cap_contributors(
        df, contributor=canonical_domain(F.col("domain_id")), score=valid_score(F.col("confidence")),
        tie="result_id", max_share="0.12",
    ).select("result_id")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return encode_corpus(table(spark, sf_dir, "documents"), keep_cols=["doc_id"])


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the held-out items they share a passage with, letter for letter."""
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"), max_edits=0)
    return leaks.select("doc_id", "item_id")


def p9_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks with up to a tenth of a passage's characters edited: run of identical words and least distance."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"), edit_share=0.1)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every document, by position."""
    return sentences(table(spark, sf_dir, "documents").select("doc_id", "text"), id_col="doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_items": p1_items,
    "p1_annotators": p1_annotators,
    "p3_found": p3_found,
    "p3_redacted": p3_redacted,
    "p4_found": p4_found,
    "p4_copies": p4_copies,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p5_split": p5_split,
    "p5_shares": p5_shares,
    "p6_found": p6_found,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_near": p9_near,
    "p10_found": p10_found,
}

_LABEL = r"regexp_replace(lower(domain_id), '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')"
_NORM = r"array_to_string(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+'), ' ')"
_CANON = rf"""
    segs AS (
        SELECT row_id, text, {_NORM.format("text")} AS words,
               list_filter(regexp_split_to_array(text, '[;|\r\n]+'), lambda s: regexp_matches(s, '[\p{{L}}\p{{N}}]')) AS seg,
               CASE WHEN json_valid(text) AND json_type(try_cast(text AS JSON)) = 'OBJECT' THEN try_cast(text AS JSON) END AS js
        FROM processed_record WHERE regexp_matches(text, '[\p{{L}}\p{{N}}]')),
    forms AS (
        SELECT row_id, words, CASE
            WHEN js IS NOT NULL THEN array_to_string(list_sort(list_transform(json_keys(js),
                lambda k: {_NORM.format("k")} || chr(30) || {_NORM.format("json_extract_string(js, '$.\"' || k || '\"')")})), chr(31))
            WHEN len(seg) >= 2 AND len(list_filter(seg, lambda s: regexp_matches(s, '(?s)^[^:]*[\p{{L}}\p{{N}}][^:]*:'))) = len(seg)
            THEN array_to_string(list_sort(list_transform(seg,
                lambda s: {_NORM.format("split_part(s, ':', 1)")} || chr(30) || {_NORM.format("substr(s, instr(s, ':') + 1)")})), chr(31))
            END AS fields FROM segs),
    lists AS (SELECT words, min(fields) AS as_fields FROM forms WHERE fields IS NOT NULL GROUP BY words),
    canon AS (SELECT f.row_id, coalesce(l.as_fields, f.words) AS c FROM forms f LEFT JOIN lists l USING (words))"""
_GRAMS = """list_transform(range(1, len({u}) - {n} + 2), lambda i: array_to_string({u}[i:i + {n} - 1], ' '))"""
_WORDS = r"regexp_extract_all(replace(lower(text), 'ё', 'е'), '[\p{L}\p{N}]+')"

_TIES = r"""WITH RECURSIVE norm AS (
            SELECT nullif(lower(regexp_replace(user_id, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')), '') AS u,
                lower(trim(regexp_replace(text, '[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+', ' ', 'g'))) AS t
            FROM processed_record WHERE text IS NOT NULL),
        aug AS (
            SELECT DISTINCT aug_id, lower(trim(regexp_replace(x, '[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+', ' ', 'g'))) AS t
            FROM (SELECT aug_id, unnest(list_concat([original_text], coalesce(variants, []))) AS x FROM augmentation_result)
            WHERE x IS NOT NULL),
        borne AS (SELECT DISTINCT aug_id, t FROM aug WHERE t IN (SELECT t FROM norm)),
        home AS (SELECT t, 'g' || min(aug_id) AS h FROM borne GROUP BY t),
        e AS (
            SELECT h AS a, 'g' || aug_id AS b FROM borne JOIN home USING (t)
            UNION SELECT 'u' || u, h FROM norm JOIN home USING (t) WHERE u IS NOT NULL),
        link AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        reach AS (SELECT a AS s, a AS n FROM link WHERE a LIKE 'u%' UNION SELECT s, b FROM reach JOIN link ON a = n)"""

SQL: dict[str, str] = {
    "p4_found": f"""
        WITH {_CANON}, firsts AS (SELECT row_id, min(row_id) OVER (PARTITION BY c) AS first_row_id FROM canon)
        SELECT first_row_id, row_id FROM firsts WHERE row_id <> first_row_id""",
    "p4_copies": f"WITH {_CANON} SELECT min(row_id) AS first_row_id, count(*) AS copies FROM canon GROUP BY c",
    "p5_found": f"""
        {_TIES}
        SELECT DISTINCT substr(s, 2) AS user_a, substr(n, 2) AS user_b FROM reach WHERE n LIKE 'u%' AND substr(s, 2) < substr(n, 2)""",
    "p5_groups": f"""
        {_TIES}
        SELECT substr(s, 2) AS user_id, min(substr(n, 2)) AS first_user, count(*) AS n_users FROM reach WHERE n LIKE 'u%' GROUP BY s""",
    "p5_shares": "SELECT split, share::DOUBLE AS share, 0::BIGINT AS n_divided FROM (VALUES ('train', 0.8), ('validation', 0.1), ('test', 0.1)) t(split, share)",
    "p6_found": f"""
        WITH x AS (SELECT result_id, CASE WHEN {_LABEL} IN {DOMAINS} THEN {_LABEL} ELSE 'oos' END AS d,
                CASE WHEN confidence BETWEEN 0 AND 1 AND NOT isnan(confidence) THEN confidence END AS s FROM classification_result),
        r AS (SELECT result_id, row_number() OVER (PARTITION BY d ORDER BY s DESC NULLS LAST, result_id) AS rn,
                count(*) OVER () AS n FROM x)
        SELECT result_id FROM r WHERE rn <= n * 12 // 100""",
    "p9_found": rf"""
        WITH item AS (SELECT item_id, {_WORDS} AS w, array_to_string({_WORDS}, '') AS s FROM eval_item),
        kind AS (SELECT *, 2 * len(regexp_extract_all(s, '\p{{Han}}')) > len(s) AS han FROM item),
        grams AS (
            SELECT item_id, unnest({_GRAMS.format(u="w", n=8)}) AS g FROM kind WHERE NOT han AND len(w) >= 8
            UNION SELECT item_id, unnest({_GRAMS.format(u="string_split(s, '')", n=16)}) FROM kind WHERE han AND len(s) >= 16),
        doc AS (SELECT doc_id, {_WORDS} AS w, string_split(array_to_string({_WORDS}, ''), '') AS c FROM documents WHERE text IS NOT NULL),
        found AS (
            SELECT doc_id, unnest({_GRAMS.format(u="w", n=8)}) AS g FROM doc WHERE len(w) >= 8
            UNION SELECT doc_id, unnest({_GRAMS.format(u="c", n=16)}) FROM doc WHERE len(c) >= 16)
        SELECT DISTINCT doc_id, item_id FROM found JOIN grams USING (g)""",
}
