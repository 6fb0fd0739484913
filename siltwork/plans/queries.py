"""Queries of the core operators over the test tables, and the SQL they are checked against."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.config import WriterConfig
from siltwork.functions.taxonomy import is_stop_word, normalise_label, rule_label, soft_candidates, validate_domain
from siltwork.functions.text import DOMAINS, canonical_domain
from siltwork.operators import dataset, etl, feedback, labels, model_calls, similarity, versions
from siltwork.operators.model_calls import cache_key, latest_entries, rule_classification
from siltwork.operators.model_calls import cache_statistics as model_cache_statistics
from siltwork.operators.schema_drift import schema_changes, unified_records
from siltwork.operators.timestamps import normalise_timestamps
from siltwork.plans.sql import SQL  # noqa: F401 - part of the interface
from siltwork.session import materialised, table
from siltwork.sources import readers, sinks

AS_OF = datetime.datetime(2024, 12, 31)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instant of every readable timestamp of processed_record."""
    df = table(spark, sf_dir, "processed_record").select("row_id", "ts", "source")
    zones = table(spark, sf_dir, "source_zone")
    return normalise_timestamps(df, zones).where("ts_us IS NOT NULL").select("row_id", "ts_us")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of a file's fields against the file before it."""
    return schema_changes(table(spark, sf_dir, "raw_file"), table(spark, sf_dir, "raw_line"))


#: Names under which fields of one meaning stand in the table of raw lines.
_NAMES = ("text", "user_id", "ts", "metadata.channel", "metadata.duration_s", "metadata.is_mobile", "metadata.lang", "metadata.priority", "metadata.session_id", "metadata.tags")


def p2_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All readable raw lines as one table with steady columns, under the names of the records."""
    return unified_records(table(spark, sf_dir, "raw_file"), table(spark, sf_dir, "raw_line"), prefer=_NAMES)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "processed_record")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classification results with a canonical domain and a confidence that is a number or null."""
    df = table(spark, sf_dir, "classification_result")
    ok = ~F.isnan("confidence") & F.col("confidence").between(0, 1)
    return df.withColumn("domain", validate_domain(F.col("domain_id"))).withColumn("conf", F.when(ok, F.col("confidence")))


def etl_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised records, one for each text."""
    out = etl.process_records(_records(spark, sf_dir).select("row_id", "text", "user_id", "source"))
    return out.select("row_id", "text", "user_id", "source")


def etl_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows read, kept, filtered, and duplicates."""
    return etl.etl_statistics(_records(spark, sf_dir).select("row_id", "text"))


def etl_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields found under their many names: orders with padded, capital headers as raw rows."""
    raw = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias(" ROW_ID"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("Query_Text "),
        F.col("o_orderstatus").alias("Message"), F.col("o_custkey").alias("CID"), F.col("o_totalprice").alias("price"),
    )
    raw = etl.normalise_headers(raw)
    return raw.select("row_id", etl.extract_text(raw).alias("text"), etl.extract_user(raw).alias("user_id"), F.size(etl.extract_metadata(raw, ("row_id",))).cast("long").alias("n_metadata"))


def etl_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the records' metadata: keys with numbers of rows and of distinct values."""
    rows = _records(spark, sf_dir).select(F.explode("metadata").alias("key", "value"))
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"))


def etl_domain_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule labels of the normalised records, counted."""
    return etl_records(spark, sf_dir).groupBy(rule_label(F.col("text")).alias("label")).agg(F.count("*").alias("n"))


def labels_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of labels and what they stand for."""
    df = table(spark, sf_dir, "classification_result")
    return df.groupBy("domain_id", normalise_label(F.col("domain_id")).alias("normal"), validate_domain(F.col("domain_id")).alias("domain")).agg(F.count("*").alias("n"))


def labels_stop_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that are nothing but a stop word."""
    return _records(spark, sf_dir).where(is_stop_word(F.col("text"))).select("row_id", "text")


def labels_soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints for each record."""
    return _records(spark, sf_dir).select("row_id", F.array_join(soft_candidates(F.coalesce("text", F.lit("")), 3), ",").alias("hints"))


def labels_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label and confidence by rules alone."""
    c = rule_classification(F.coalesce("text", F.lit("")))
    return _records(spark, sf_dir).select("row_id", c["label"].alias("label"), c["confidence"].alias("confidence"))


def labels_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain after a confident best candidate has replaced it."""
    o = labels.override_by_candidate(F.col("domain_id"), F.col("conf"), F.col("top_candidates"))
    return _results(spark, sf_dir).select("result_id", o["domain"].alias("domain"), o["confidence"].alias("confidence"))


def low_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that are too uncertain."""
    return _results(spark, sf_dir).where("conf < 0.5").select("result_id", "domain", "conf")


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "validation_result").groupBy("id").agg(F.max("all_predictions").alias("p"))
    return v.select("id", F.posexplode("p").alias("turn", "x")).select("id", "turn", validate_domain(F.col("x.domain")).alias("label"), F.col("x.confidence").alias("confidence"), F.col("x.temperature").alias("model"))


def consensus_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final label of every item by votes and rules."""
    rules = table(spark, sf_dir, "validation_result").groupBy("id").agg(F.min("text").alias("t")).select("id", rule_label(F.col("t")).alias("rule"))
    return labels.consensus_labels(_votes(spark, sf_dir), rules)


def ensemble_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plurality of the labeller runs, the initial label left out."""
    return labels.ensemble_labels(_votes(spark, sf_dir).where("model <> 'initial'"))


def _calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = F.col("domain") == validate_domain(F.col("domain_true"))
    return labels.calibration_table(_results(spark, sf_dir), label=F.col("domain"), confidence=F.col("conf"), correct=right)


def calibration_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of right results by domain and tenth of confidence."""
    return _calibration(spark, sf_dir)


def calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of every result as calibrated."""
    out = labels.calibrate(_results(spark, sf_dir), _calibration(spark, sf_dir), label=F.col("domain"), confidence=F.col("conf"))
    return out.select("result_id", "calibrated")


def confidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of confidence by domain."""
    return labels.confidence_summary(_results(spark, sf_dir), label=F.col("domain"), confidence=F.col("conf"), valid=F.col("conf") >= 0.5)


def confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent confusions."""
    return labels.confusions(_results(spark, sf_dir), predicted=F.col("domain"), truth=validate_domain(F.col("domain_true")))


def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the reason why they can't be written."""
    df = table(spark, sf_dir, "classification_result")
    return df.groupBy(dataset.reject_reason(F.col("text"), F.col("domain_id")).alias("reason")).agg(F.count("*").alias("n"))


def _fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).where(dataset.reject_reason(F.col("text"), F.col("domain_id")).isNull()).select("result_id", "text", "domain", "conf")


def balanced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and copies of a balanced data set."""
    return dataset.balance(_fit(spark, sf_dir), id_col="result_id").select("result_id", "domain", F.col("copy").cast("long").alias("copy"))


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training and evaluation rows."""
    return dataset.stratified_split(_fit(spark, sf_dir), id_col="result_id", config=WriterConfig(eval_fraction=0.1)).select("result_id", "domain", "split")


def dataset_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the labelled rows."""
    return dataset.dataset_statistics(_fit(spark, sf_dir), confidence="conf")


def dataset_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their quality score, with equal and near-equal pairs of texts by rows."""
    fit = _fit(spark, sf_dir)
    share = similarity.duplicate_share(fit, id_col="result_id", text_col="text")
    stats = dataset.dataset_statistics(fit, confidence="conf").crossJoin(F.broadcast(share))  # two tables of one row
    return dataset.dataset_score(stats, F.col("dup")).select("n_rows", "score", "issues")


def source_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by source."""
    return _records(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))


def output_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as they are written."""
    return sinks.output_rows(_results(spark, sf_dir).select("text", "domain_true", "domain_id")).groupBy("label").agg(F.count("*").alias("n"))


def sharded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of 777 rows: first and last row of each."""
    out = sinks.with_shard(table(spark, sf_dir, "classification_result").select("result_id"), 777, "result_id")
    return out.groupBy("shard").agg(F.count("*").alias("n"), F.min("result_id").alias("first"), F.max("result_id").alias("last"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each variant with its original; an id made of both."""
    df = table(spark, sf_dir, "augmentation_result").where("original_text IS NOT NULL")
    df = df.select("aug_id", F.col("original_text").alias("a"), F.posexplode("variants").alias("i", "b")).where("b IS NOT NULL")
    return df.select(F.concat_ws("-", F.col("aug_id").cast("string"), F.col("i").cast("string")).alias("id"), "a", "b")


def levenshtein_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit distance in code points, absolute and relative, of originals and variants in lower case."""
    p = _pairs(spark, sf_dir).withColumn("a", F.lower("a")).withColumn("b", F.lower("b"))
    return p.select("id", F.levenshtein("a", "b").alias("distance"), F.round(similarity.levenshtein_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5000 most frequent terms of the documents."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return similarity.vocabulary(similarity.term_counts(docs, "doc_id", "text")).select("term", "df", "tf")


def tfidf_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of terms and heaviest weight of each document's vector."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    counts = materialised(similarity.term_counts(docs, "doc_id", "text"))  # texts are taken apart once
    w = similarity.tfidf(counts, docs.count(), similarity.vocabulary(counts))
    return w.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("n_terms"), F.round(F.max("weight"), 6).alias("top"))


def pair_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of originals and variants against all records as corpus."""
    out = similarity.pair_cosine(_pairs(spark, sf_dir), corpus=_records(spark, sf_dir))
    return out.select("id", F.round("cosine", 6).alias("cosine"))


def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants by the issues that the gate finds, with the original texts as corpus."""
    p = _pairs(spark, sf_dir)
    originals = table(spark, sf_dir, "augmentation_result").select(F.col("original_text").alias("text"))
    gate = similarity.quality_gate(p, similarity.pair_cosine(p, corpus=originals))
    return gate.groupBy(F.array_join("issues", ",").alias("issues"), "is_valid").agg(F.count("*").alias("n"))


def _gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants with the domain of their original, as the gate of similarity sees them."""
    df = table(spark, sf_dir, "augmentation_result")
    domains = df.select(F.col("aug_id").cast("string").alias("aug"), canonical_domain(F.col("domain")).alias("domain"))
    domains = domains.groupBy("aug").agg(F.min("domain").alias("domain"))
    p = _pairs(spark, sf_dir).withColumn("aug", F.substring_index("id", "-", 1)).join(domains, "aug").drop("aug")
    return similarity.quality_gate(p, similarity.pair_cosine(p, corpus=df.select(F.col("original_text").alias("text"))))


def synthetic_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants that pass the gate and keep their domain when labelled again by rules."""
    c = rule_classification(F.col("b"))
    out = similarity.synthetic_gate(_gate(spark, sf_dir), found=c["label"], confidence=c["confidence"])
    return out.select("id", "domain", "confidence", "source")


def synthetic_relabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without strictness: all variants, under the label found, by outcome."""
    c = rule_classification(F.col("b"))
    out = similarity.synthetic_gate(_gate(spark, sf_dir), found=c["label"], confidence=c["confidence"], strict=False)
    return out.groupBy("domain", "relabelled", "is_valid").agg(F.count("*").alias("n"))


def gate_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters and rates of the strict gate."""
    gate = _gate(spark, sf_dir)
    other = rule_classification(F.col("b"))["label"] != F.col("domain")
    return similarity.gate_statistics(gate, passed=F.col("is_valid") & ~other, relabelled=other)


def valid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validated items without those found invalid."""
    df = table(spark, sf_dir, "validation_result").withColumn("quality_metrics", F.struct("is_valid", "validation_issues"))
    return similarity.drop_invalid(df).groupBy("final_domain").agg(F.count("*").alias("n"))


def augmentation_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thirty seeds of each label."""
    return dataset.augmentation_seeds(table(spark, sf_dir, "classification_result"), id_col="result_id").select("result_id", "domain", "turn")


def dataset_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit rows by domain, records by source, as the metadata of a data set tells them."""
    sources = dataset.distributions(_records(spark, sf_dir), ("source",))
    return dataset.distributions(_fit(spark, sf_dir), ("domain",)).unionByName(sources)


def labeler_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and low confidence among the results."""
    return model_calls.labeler_rates(_results(spark, sf_dir), confidence=F.col("conf"), error=F.coalesce(F.col("reasoning").startswith("Error"), F.lit(False)))


def augmenter_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants and failures of the augmentation."""
    return model_calls.augmenter_rates(table(spark, sf_dir, "augmentation_result"))


def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the answer for a review item depends on: text, labels and the notes as context."""
    key = model_calls.label_key(F.col("text"), DOMAINS, F.col("notes"))
    return table(spark, sf_dir, "review_item").select("review_id", F.md5(key).alias("key"))


def cache_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache of results with the reviews as later answers, by answer."""
    old = table(spark, sf_dir, "classification_result").where("text IS NOT NULL").select(cache_key(F.col("text")).alias("key"), validate_domain(F.col("domain_id")).alias("result"), F.col("classified_at").alias("ts"))
    new = table(spark, sf_dir, "review_item").where("text IS NOT NULL AND review_timestamp IS NOT NULL").select(
        cache_key(F.col("text")).alias("key"), validate_domain(F.coalesce("corrected_domain", "predicted_domain")).alias("result"), F.col("review_timestamp").alias("ts")
    )
    return model_calls.cache_put(old, new).groupBy("result").agg(F.count("*").alias("n"), F.max("ts").alias("latest"))


_STATUSES = ("pending", "in_review", "approved", "corrected", "skipped", "rejected")
_PRIORITIES = ("critical", "high", "medium", "low")


def queue_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review items in all, by status and by priority."""
    return feedback.queue_statistics(table(spark, sf_dir, "review_item"), statuses=_STATUSES, priorities=_PRIORITIES)


def queue_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next 25 pending items (the number is the feature)."""
    df = table(spark, sf_dir, "review_item").where("NOT isnan(confidence)")
    return feedback.queue_order(df, 25).select("review_id", feedback.priority_of(F.col("confidence")).alias("priority"))


def ingest_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each raw file, and how many of them can't be read."""
    return etl.ingest_errors(table(spark, sf_dir, "raw_line"))


def etl_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of raw orders that are no field of their own, packed into metadata: entries by key."""
    raw = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("Priority "), F.col("o_custkey").alias(" cid"), F.nullif("o_orderstatus", F.lit("P")).alias("STATUS"))
    raw = etl.normalise_headers(raw)
    rows = raw.select(F.explode(etl.extract_metadata(raw, ("row_id",))).alias("key", "value"))
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"))


def balanced_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a balanced data set whose domains are cut at 200 rows, by domain and copy."""
    out = dataset.balance(_fit(spark, sf_dir), id_col="result_id", config=WriterConfig(max_per_domain=200))
    return out.groupBy("domain", F.col("copy").cast("long").alias("copy")).agg(F.count("*").alias("n"), F.sum("result_id").alias("ids"))


def review_queue_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncertain results for which a queue of 1500 items has room (the room is the feature)."""
    queued = table(spark, sf_dir, "review_item").select("text").where("text IS NOT NULL").distinct()
    rows = _results(spark, sf_dir).select("result_id", "text", "conf")
    return feedback.review_batch(rows, queued, confidence="conf", id_col="result_id", capacity=1500).select("result_id", "conf", "item")


def feedback_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections of each predicted label."""
    return feedback.corrections_by_domain(_counts(spark, sf_dir))


def feedback_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent corrections."""
    return feedback.top_corrections(_counts(spark, sf_dir))


def context_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users active in the last two days of January."""
    return feedback.active_users(table(spark, sf_dir, "events"), user=F.col("user_id"), at=F.col("ts"), as_of=datetime.datetime(2024, 1, 30), hours=48)


def context_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of events that users prefer in all."""
    return feedback.top_preferences(_preferences(spark, sf_dir)).select("domain", F.round("weight", 6).alias("weight"))


def answer_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and confidence of results with defaults for what is missing."""
    d = model_calls.answer_defaults((F.col("domain_id"), F.col("domain_true")), (F.col("confidence"), F.col("top_candidates")[0]["score"]))
    return table(spark, sf_dir, "classification_result").select("result_id", d["label"].alias("label"), d["confidence"].alias("confidence"))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of equal texts of each document and its number of near-duplicate classes."""
    out = similarity.near_duplicates(table(spark, sf_dir, "documents"), id_col="doc_id", text_col="text")
    return out.select(F.col("id").alias("doc_id"), "class_id", "n_links")


def review_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncertain results whose text isn't in review yet (the queue has room for all)."""
    queued = table(spark, sf_dir, "review_item").select("text").where("text IS NOT NULL").distinct()
    rows = _results(spark, sf_dir).select("result_id", "text", "conf")
    return feedback.review_batch(rows, queued, confidence="conf", id_col="result_id", capacity=1_000_000)


def reviewed_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest reviewed label of every item."""
    df = table(spark, sf_dir, "review_item").where("status IN ('approved', 'corrected')")
    label = validate_domain(F.coalesce("corrected_domain", "predicted_domain"))
    return df.groupBy("id").agg(F.max_by(label, F.struct("review_timestamp", "review_id")).alias("label"), F.lit(1.0).alias("confidence"))


def _opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "review_item").where("status IN ('approved', 'corrected')")
    return df.select("review_id", "text", canonical_domain(F.col("predicted_domain")).alias("predicted"), canonical_domain(F.coalesce("corrected_domain", "predicted_domain")).alias("corrected"), F.col("review_timestamp").alias("at"))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.feedback_statistics(_opinions(spark, sf_dir), predicted=F.col("predicted"), corrected=F.col("corrected"), at=F.col("at"), as_of=AS_OF)


def feedback_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opinions by predicted and corrected label."""
    return _counts(spark, sf_dir)


def feedback_retrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether it is time to train again."""
    return feedback.should_retrain(_counts(spark, sf_dir))


def feedback_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusions to warn of."""
    return feedback.prompt_warnings(_counts(spark, sf_dir))


def feedback_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest clear examples of each domain."""
    return feedback.dynamic_examples(_opinions(spark, sf_dir), text=F.col("text"), corrected=F.col("corrected"), at=F.col("at"), as_of=AS_OF)


def context_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten latest events of each user."""
    out = feedback.last_messages(table(spark, sf_dir, "events"), user="user_id", at="ts", id_col="event_id")
    return out.select("user_id", "turn", "event_id")


def context_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decayed preferences of users for kinds of events."""
    out = feedback.preferences(table(spark, sf_dir, "events"), user="user_id", domain="event_type", at="ts", id_col="event_id")
    return out.select("user", "domain", F.round("weight", 6).alias("weight"))


def context_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users, active users, messages."""
    return feedback.context_statistics(table(spark, sf_dir, "events"), user=F.col("user_id"), at=F.col("ts"), as_of=datetime.datetime(2024, 1, 30))


def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a fresh answer for their text in the results of the last 90 days."""
    cache = table(spark, sf_dir, "classification_result").where("text IS NOT NULL").select(cache_key(F.col("text"), F.lit("v1")).alias("key"), F.coalesce("domain_id", F.lit("")).alias("result"), F.col("classified_at").alias("ts"))
    last = latest_entries(cache, as_of=AS_OF, hours=24 * 90)
    rows = _records(spark, sf_dir).where("text IS NOT NULL").select("row_id", cache_key(F.col("text"), F.lit("v1")).alias("key"))
    return rows.join(last, "key").select("row_id", "result")


def scan_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of the last week."""
    return readers.recent(table(spark, sf_dir, "classification_result"), "classified_at", as_of=AS_OF).select("result_id", "domain_id")


def scan_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of March 2024 by domain."""
    part = readers.between(table(spark, sf_dir, "classification_result"), "classified_at", datetime.datetime(2024, 3, 1), datetime.datetime(2024, 4, 1))
    return part.groupBy(validate_domain(F.col("domain_id")).alias("domain")).agg(F.count("*").alias("n"))


def version_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags made of part numbers, read and stepped."""
    tag = F.concat(F.lit("v"), (F.col("p_partkey") % 7).cast("string"), F.lit("."), F.col("p_size").cast("string"))
    v = versions.parse_version(F.col("tag"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 11 == 0, "vX").otherwise(tag).alias("tag"))
    return rows.select("p_partkey", v["major"].alias("major"), v["minor"].alias("minor"), v["patch"].alias("patch"), versions.next_version(F.col("tag"), "patch").alias("next_patch"), versions.next_version(F.col("tag"), "major").alias("next_major"))


def metadata_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of metadata that differ between a reviewed item and its record."""
    a = _records(spark, sf_dir).where("row_id IS NOT NULL").select("row_id", "metadata")
    b = table(spark, sf_dir, "review_item").where("metadata IS NOT NULL").groupBy("row_id").agg(F.max_by("metadata", "review_id").alias("metadata"))
    a = a.join(b.select("row_id"), "row_id", "left_semi")
    out = versions.map_difference(a, b, key="row_id", entries="metadata")
    return out.select("row_id", "name", F.col("old").alias("old_value"), F.col("new").alias("new_value"))


def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Originals and variants in one bag, by domain."""
    df = table(spark, sf_dir, "augmentation_result")
    originals = df.select(F.col("original_text").alias("text"), "domain", F.lit("original").alias("kind"))
    made = df.select(F.explode("variants").alias("text"), "domain")
    return originals.unionByName(made, allowMissingColumns=True).groupBy("domain", F.coalesce("kind", F.lit("variant")).alias("kind")).agg(F.count("*").alias("n"))


def label_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True labels against those of the keyword rules, where these decide."""
    rows = _results(spark, sf_dir).where("text IS NOT NULL")
    return labels.label_accuracy(rows, given=validate_domain(F.col("domain_true")), found=rule_label(F.col("text")))


def validation_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of validated items with consensus, rule match and validity."""
    return labels.validation_rates(table(spark, sf_dir, "validation_result"))


def problem_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 most doubtful items."""
    one = table(spark, sf_dir, "validation_result").groupBy("id").agg(F.min("consensus_ratio").alias("ratio"), F.min("final_confidence").alias("confidence"), F.bool_and(F.coalesce("is_valid", F.lit(False))).alias("is_valid"))
    return labels.problem_items(one, id_col="id", confidence="confidence", ratio="ratio")


def cache_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers by age."""
    cache = table(spark, sf_dir, "classification_result").select(cache_key(F.col("text")).alias("key"), F.col("classified_at").alias("ts"))
    return model_cache_statistics(cache, as_of=AS_OF, hours=24 * 90)


def feedback_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples as text for a prompt."""
    return feedback.example_texts(feedback_examples(spark, sf_dir))


def _preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.preferences(table(spark, sf_dir, "events"), user="user_id", domain="event_type", at="ts", id_col="event_id")


def context_preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three preferred kinds of events of each user."""
    return feedback.preferred_domains(_preferences(spark, sf_dir))


def context_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a prompt would say about each user."""
    return feedback.context_prompts(table(spark, sf_dir, "events"), _preferences(spark, sf_dir), user="user_id", text="event_type", at="ts", id_col="event_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q
    for q in (
        p2_found, p2_table, p7_found, etl_records, etl_statistics, etl_columns, etl_metadata, etl_domain_distribution, labels_normalised,
        labels_stop_words, labels_soft, labels_rules, labels_override, low_confidence, consensus_labels, ensemble_labels, calibration_table,
        calibrated, confidence_summary, confusions, quality_filter, balanced_rows, stratified_split, dataset_statistics, dataset_score,
        source_distribution, output_rows, sharded_rows, levenshtein_pairs, term_statistics, tfidf_norms, pair_cosine, quality_gate, near_duplicates,
        review_batch, reviewed_export, feedback_statistics, feedback_retrain, feedback_warnings, feedback_examples, context_last, context_preferences,
        context_statistics, cache_lookup, scan_recent, scan_between, version_tags, metadata_difference, union_all, label_accuracy, validation_rates,
        problem_items, cache_statistics, feedback_prompts, context_preferred, context_prompts, synthetic_gate, synthetic_relabelled, gate_statistics,
        valid_rows, augmentation_seeds, dataset_distributions, labeler_rates, augmenter_rates, cache_keys, cache_merge, queue_statistics, queue_next,
        answer_defaults, ingest_errors, etl_packed, balanced_capped, review_queue_full, feedback_domains, feedback_top, context_active, context_top,
    )
}

