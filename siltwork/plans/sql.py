"""The core queries in DuckDB's SQL, over the same tables."""

from __future__ import annotations

from siltwork.functions.taxonomy import KEYWORDS, STOP_WORDS
from siltwork.functions.text import DOMAINS

_WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


def _domain(c: str) -> str:
    return f"CASE WHEN lower({_strip(c)}) IN {DOMAINS} THEN lower({_strip(c)}) ELSE 'oos' END"


def _hits(t: str) -> str:
    """Columns h0..h4: keyword hits of each label in a text."""
    return ", ".join(
        "(" + " + ".join(f"contains(lower({t}), '{w}')::INT" for w in words) + f") AS h{i}" for i, words in enumerate(KEYWORDS.values())
    )


def _ranked(n: int = len(KEYWORDS)) -> str:
    """List of (hits, -order, label) of the labels hit, best first."""
    items = ", ".join(f"{{'h': h{i}, 'o': {-i}, 'l': '{label}'}}" for i, label in enumerate(KEYWORDS))
    return f"list_reverse_sort(list_filter([{items}], lambda x: x.h > 0))"


_RULE = "CASE WHEN len(r) = 1 THEN r[1].l WHEN len(r) > 1 AND r[1].h >= 2 AND r[1].h > 2 * r[2].h THEN r[1].l END"
_CONF = "CASE WHEN confidence BETWEEN 0 AND 1 AND NOT isnan(confidence) THEN confidence END"
_RES = f"res AS (SELECT *, {_domain('domain_id')} AS domain, {_CONF} AS conf FROM classification_result)"
_REASON = f"""CASE WHEN text IS NULL OR text = '' THEN 'empty text' WHEN domain_id IS NULL OR domain_id = '' THEN 'no domain'
    WHEN length({_strip('text')}) < 3 THEN 'short text' WHEN length(text) > 5000 THEN 'long text' END"""
_FIT = f"{_RES}, fit AS (SELECT result_id, text, domain, conf FROM res WHERE {_REASON} IS NULL)"
_FALLBACK = "coalesce(text, CASE WHEN length(user_id) >= 5 THEN user_id END, CASE WHEN length(source) >= 5 THEN source END)"


def _clean(t: str) -> str:
    return f"""clean AS (
    SELECT row_id, user_id, source, CASE WHEN length(t) >= 3 THEN t END AS text FROM (
        SELECT row_id, user_id, source, substr(trim(regexp_replace({t}, '{_WS}+', ' ', 'g')), 1, 1000) AS t FROM processed_record))"""


_FIRST = f"""{_clean(_FALLBACK)}, kept AS (
    SELECT row_id, text, user_id, source FROM clean WHERE text IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY text ORDER BY row_id NULLS LAST) = 1)"""
_VOTES = f"""
    one AS (SELECT id, max(all_predictions) AS p, min(text) AS t FROM validation_result GROUP BY id),
    votes AS (SELECT id, i AS turn, {_domain('p[i].domain')} AS label, p[i].confidence AS confidence, p[i].temperature AS model
        FROM (SELECT id, p, unnest(range(1, len(p) + 1)) AS i FROM one))"""
_PLURALITY = """
    per AS (SELECT id, label, count(*) AS n, min(turn) AS f, sum(confidence) AS s, count(confidence) AS m FROM {votes} GROUP BY id, label),
    best AS (SELECT id, label, n, s / m AS own, sum(n) OVER (PARTITION BY id) AS total, sum(s) OVER (PARTITION BY id) / sum(m) OVER (PARTITION BY id) AS mean
        FROM per QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, f, label DESC) = 1)"""
_ITEMS = "SELECT result_id, md5('42:' || result_id) AS o, domain FROM fit"
_OPINIONS = f"""op AS (
    SELECT review_id, text, {_domain('predicted_domain')} AS predicted, {_domain('coalesce(corrected_domain, predicted_domain)')} AS corrected,
        review_timestamp AS seen FROM review_item WHERE status IN ('approved', 'corrected')),
    counts AS (SELECT predicted, corrected, count(*) AS n, count(*) FILTER (seen >= TIMESTAMP '2024-12-24') AS recent FROM op GROUP BY 1, 2)"""
# Edit distance in code points, which DuckDB's own function doesn't count: the table of distances by
# its diagonals, each from the two before it.
_EDITS = """
    chars AS (SELECT id, string_split(lower(a), '') AS x, string_split(lower(b), '') AS y FROM pairs),
    sized AS (SELECT id, list_filter(x, lambda c: c <> '') AS x, list_filter(y, lambda c: c <> '') AS y FROM chars),
    steps AS (
        SELECT id, x, y, len(x) AS n, len(y) AS m, 0::BIGINT AS k, [0::BIGINT] || list_transform(range(len(x)), lambda i: 1000000::BIGINT) AS now,
            list_transform(range(len(x) + 1), lambda i: 1000000::BIGINT) AS old FROM sized
        UNION ALL
        SELECT id, x, y, n, m, k + 1, list_transform(range(n + 1), lambda i: CASE
            WHEN i > k + 1 OR k + 1 - i > m THEN 1000000 WHEN i = 0 OR i = k + 1 THEN k + 1
            ELSE least(now[i + 1] + 1, now[i] + 1, old[i] + (x[i] <> y[k + 1 - i])::BIGINT) END), now
        FROM steps WHERE k < n + m),
    edits AS (SELECT id, now[n + 1] AS d, CASE WHEN greatest(n, m) = 0 THEN 0 ELSE now[n + 1] / greatest(n, m) END AS ratio FROM steps WHERE k = n + m)"""
_PAIRS = """pairs AS (
    SELECT id, a, b FROM (SELECT aug_id || '-' || (i - 1) AS id, original_text AS a, variants[i] AS b
        FROM (SELECT *, unnest(range(1, len(variants) + 1)) AS i FROM augmentation_result WHERE original_text IS NOT NULL)) WHERE b IS NOT NULL)"""
_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def _terms(t: str) -> str:
    w = _WORDS.format(t)
    return f"list_concat({w}, list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"


_DOC_TF = f"""tf AS (SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, unnest({_terms('text')}) AS term FROM documents WHERE text IS NOT NULL) GROUP BY 1, 2),
    vocab AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM tf GROUP BY term ORDER BY 3 DESC, 1 LIMIT 5000)"""
_COSINE = """
    ta AS (SELECT id, term, count(*) AS fa FROM (SELECT id, unnest({a}) AS term FROM {p}) GROUP BY 1, 2),
    tb AS (SELECT id, term, count(*) AS fb FROM (SELECT id, unnest({b}) AS term FROM {p}) GROUP BY 1, 2),
    w AS (SELECT coalesce(ta.id, tb.id) AS id, coalesce(fa, 0) AS fa, coalesce(fb, 0) AS fb,
            ln((3.0 + (SELECT n FROM size)) / (1.0 + coalesce(df, 0) + (fa IS NOT NULL)::INT + (fb IS NOT NULL)::INT)) + 1 AS idf
        FROM ta FULL JOIN tb ON ta.id = tb.id AND ta.term = tb.term LEFT JOIN corpus ON corpus.term = coalesce(ta.term, tb.term)),
    cs AS (SELECT id, sum(fa * fb * idf * idf) AS ab, sum(fa * fa * idf * idf) AS aa, sum(fb * fb * idf * idf) AS bb FROM w GROUP BY id),
    cosine AS (SELECT p.id, CASE WHEN aa IS NULL THEN {none} WHEN aa > 0 AND bb > 0 THEN ab / sqrt(aa * bb) ELSE 0 END AS cosine FROM {p} p LEFT JOIN cs USING (id))"""
_STATS = """dist AS (SELECT domain, count(*) AS n, sum(length(text)) AS chars, sum(conf) AS cs, count(conf) AS cn FROM fit GROUP BY domain),
    stats AS (SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_domains, sum(chars) / sum(n) AS avg_length, sum(cs) / sum(cn) AS avg_confidence,
        stddev_pop(n) / avg(n) AS imbalance FROM dist)"""

_GATE = f"""{_PAIRS}, {_EDITS}, size AS (SELECT count(*) AS n FROM augmentation_result WHERE original_text IS NOT NULL),
        corpus AS (SELECT term, count(*) AS df FROM (
            SELECT unnest(list_distinct({_terms('original_text')})) AS term FROM augmentation_result WHERE original_text IS NOT NULL) GROUP BY term),
        {_COSINE.format(p="pairs", a=_terms("a"), b=_terms("b"), none="0")},
        dom AS (SELECT aug_id::VARCHAR AS aug, min({_domain('domain')}) AS domain FROM augmentation_result GROUP BY 1),
        h AS (SELECT id, split_part(id, '-', 1) AS aug, lower({_strip('b')}) IN {STOP_WORDS} AS stop, {_hits('b')} FROM pairs),
        x AS (SELECT id, aug, stop, {_ranked()} AS r FROM h), y AS (SELECT *, {_RULE} AS rule FROM x),
        lab AS (SELECT id, aug, CASE WHEN stop THEN 'oos' ELSE coalesce(rule, r[1].l, 'oos') END AS found,
            (CASE WHEN stop THEN 0.95 WHEN rule IS NOT NULL THEN 0.9 WHEN len(r) > 0 THEN 0.5 ELSE 0 END)::DOUBLE AS conf FROM y),
        gate AS (SELECT edits.id, cosine, ratio, NOT (cosine > 0.95 OR cosine < 0.3 OR d < 3 OR ratio > 0.8) AS ok, found, conf, domain
            FROM edits JOIN cosine USING (id) JOIN lab USING (id) JOIN dom USING (aug))"""

_LINKS = f"""
        tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({_terms('text')}) AS term FROM cls) GROUP BY 1, 2),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(DISTINCT id) AS n FROM tf),
        raw AS (SELECT id, term, tf * (ln((1.0 + n) / (1.0 + df)) + 1) AS w FROM tf JOIN df USING (term), n),
        v AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM raw),
        links AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.term = b.term AND a.id <> b.id GROUP BY 1, 2 HAVING sum(a.w * b.w) >= 0.95 - 1e-9)"""

SQL: dict[str, str] = {
    "synthetic_gate": f"WITH RECURSIVE {_GATE} SELECT id, domain, conf AS confidence, 'synthetic_validated' AS source FROM gate WHERE ok AND found = domain",
    "synthetic_relabelled": f"WITH RECURSIVE {_GATE} SELECT found AS domain, found <> gate.domain AS relabelled, ok AS is_valid, count(*) AS n FROM gate GROUP BY 1, 2, 3",
    "gate_statistics": f"""WITH RECURSIVE {_GATE}, c AS (SELECT count(*) AS total, count(*) FILTER (ok AND found = domain) AS passed, count(*) FILTER (ok AND found <> domain) AS relabelled,
            count(*) FILTER (cosine < 0.3) AS low_similarity, count(*) FILTER (cosine > 0.95) AS high_similarity, count(*) FILTER (ratio > 0.8) AS many_changes FROM gate)
        SELECT *, passed / total AS pass_rate, relabelled / total AS relabel_rate FROM c""",
    "ingest_errors": """SELECT file_id, count(*) AS n_lines, count(*) FILTER (NOT (json_valid(payload) AND json_type(try_cast(payload AS JSON)) = 'OBJECT')) AS n_errors
        FROM raw_line WHERE trim(payload) <> '' GROUP BY 1""",
    "etl_packed": """SELECT 'priority' AS key, count(o_orderpriority) AS n, count(DISTINCT o_orderpriority) AS n_values FROM orders
        UNION ALL SELECT 'status', count(nullif(o_orderstatus, 'P')), count(DISTINCT nullif(o_orderstatus, 'P')) FROM orders""",
    "balanced_capped": f"""WITH {_FIT}, x AS ({_ITEMS}), r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY o, result_id) AS rn, count(*) OVER (PARTITION BY domain) AS n FROM x),
        t AS (SELECT least(200, sum(n) // count(*)) AS target FROM (SELECT domain, count(*) AS n FROM fit GROUP BY domain)),
        g AS (SELECT *, CASE WHEN n < 5 THEN n ELSE target END AS goal FROM r, t),
        c AS (SELECT result_id, domain, unnest(range(1, ((goal - rn) // n + 2)::BIGINT)) AS copy FROM g WHERE rn <= goal)
        SELECT domain, copy, count(*) AS n, sum(result_id)::BIGINT AS ids FROM c GROUP BY 1, 2""",
    "review_queue_full": f"""WITH {_RES}, one AS (SELECT text, min({{'c': conf, 'r': result_id}}) AS m FROM res
            WHERE conf < 0.5 AND text IS NOT NULL AND text NOT IN (SELECT text FROM review_item WHERE text IS NOT NULL) GROUP BY text),
        k AS (SELECT m.r AS result_id, m.c AS conf, left(md5(text), 16) AS item, row_number() OVER (ORDER BY m.c, m.r) AS place FROM one)
        SELECT result_id, conf, item FROM k WHERE place <= 1500 - (SELECT count(DISTINCT text) FROM review_item WHERE text IS NOT NULL)""",
    "feedback_domains": f"""WITH {_OPINIONS}, d AS (SELECT predicted, sum(n)::BIGINT AS n, coalesce(sum(n) FILTER (predicted <> corrected), 0)::BIGINT AS corrections FROM counts GROUP BY 1)
        SELECT *, corrections / n AS rate FROM d""",
    "feedback_top": f"WITH {_OPINIONS} SELECT predicted, corrected, n FROM counts WHERE predicted <> corrected ORDER BY n DESC, predicted, corrected LIMIT 10",
    "context_active": """SELECT user_id AS user, count(*) AS n, max(ts) AS last FROM events WHERE user_id IS NOT NULL GROUP BY user_id HAVING max(ts) > TIMESTAMP '2024-01-28'""",
    "context_top": "WITH p AS ({}) SELECT domain, round(sum(weight), 6) AS weight FROM p GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "valid_rows": "SELECT final_domain, count(*) AS n FROM validation_result WHERE is_valid IS NOT FALSE GROUP BY 1",
    "augmentation_seeds": """WITH s AS (SELECT result_id, coalesce(nullif(domain_true, ''), nullif(domain_id, '')) AS domain FROM classification_result WHERE text <> '')
        SELECT result_id, domain, row_number() OVER (PARTITION BY domain ORDER BY result_id)::INT AS turn FROM s WHERE domain <> 'unknown' QUALIFY turn <= 30""",
    "dataset_distributions": f"""WITH {_FIT} SELECT 'domain' AS field, domain AS value, count(*) AS n FROM fit GROUP BY 2
        UNION ALL SELECT 'source', source, count(*) FROM processed_record GROUP BY 2""",
    "labeler_rates": f"""WITH {_RES}, c AS (SELECT count(*) AS total, count(*) FILTER (starts_with(reasoning, 'Error')) AS errors, count(*) FILTER (conf < 0.5) AS low_confidence FROM res)
        SELECT *, errors / total AS error_rate, low_confidence / total AS low_rate FROM c""",
    "augmenter_rates": """WITH c AS (SELECT count(*) AS total, coalesce(sum(len(variants)), 0)::BIGINT AS generated, count(*) FILTER (NOT coalesce(success, false)) AS errors FROM augmentation_result)
        SELECT *, generated / total AS variants_per_seed, errors / total AS error_rate FROM c""",
    "cache_keys": f"""SELECT review_id, md5(concat_ws('|', coalesce(text, ''), '{",".join(sorted(DOMAINS))}', nullif(left(notes, 100), ''))) AS key FROM review_item""",
    "cache_merge": f"""WITH a AS (SELECT text, {_domain('domain_id')} AS result, classified_at AS ts FROM classification_result WHERE text IS NOT NULL
            UNION ALL SELECT text, {_domain('coalesce(corrected_domain, predicted_domain)')}, review_timestamp FROM review_item WHERE text IS NOT NULL AND review_timestamp IS NOT NULL),
        l AS (SELECT result, ts FROM a QUALIFY row_number() OVER (PARTITION BY text ORDER BY ts DESC NULLS LAST, result DESC) = 1)
        SELECT result, count(*) AS n, max(ts) AS latest FROM l GROUP BY 1""",
    "queue_statistics": """WITH s AS (SELECT unnest(['pending', 'in_review', 'approved', 'corrected', 'skipped', 'rejected']) AS name), p AS (SELECT unnest(['critical', 'high', 'medium', 'low']) AS name)
        SELECT 'all' AS kind, '' AS name, count(*) AS n, avg(confidence) AS avg_confidence FROM review_item
        UNION ALL SELECT 'status', name, count(review_id), avg(confidence) FROM s LEFT JOIN review_item ON status = name GROUP BY 2
        UNION ALL SELECT 'priority', name, count(review_id), avg(confidence) FROM p LEFT JOIN review_item ON priority = name GROUP BY 2""",
    "queue_next": """WITH q AS (SELECT *, CASE WHEN confidence < 0.3 THEN 'critical' WHEN confidence < 0.5 THEN 'high' WHEN confidence < 0.7 THEN 'medium' WHEN confidence >= 0.7 THEN 'low' ELSE 'critical' END AS p
            FROM review_item WHERE status = 'pending' AND NOT isnan(confidence))
        SELECT review_id, p AS priority FROM q ORDER BY list_position(['critical', 'high', 'medium', 'low'], p), confidence NULLS LAST, created_at NULLS LAST, review_id LIMIT 25""",
    "answer_defaults": """SELECT result_id, coalesce(nullif(domain_id, ''), nullif(domain_true, ''), 'oos') AS label,
        coalesce(nullif(confidence, 0), nullif(top_candidates[1].score, 0), 0.5) AS confidence FROM classification_result""",
    "etl_records": f"WITH {_FIRST} SELECT row_id, text, user_id, source FROM kept",
    "etl_statistics": f"""WITH {_clean("text")} SELECT count(*) AS total, count(DISTINCT text) AS processed, count(*) FILTER (text IS NULL) AS filtered,
        count(text) - count(DISTINCT text) AS duplicates FROM clean""",
    "etl_columns": """SELECT o_orderkey AS row_id, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END, o_orderstatus) AS text,
        o_custkey::VARCHAR AS user_id, (o_totalprice IS NOT NULL)::BIGINT AS n_metadata FROM orders""",
    "etl_metadata": """SELECT key, count(*) AS n, count(DISTINCT value) AS n_values FROM (
        SELECT e.key AS key, e.value AS value FROM (SELECT unnest(map_entries(metadata)) AS e FROM processed_record)) GROUP BY key""",
    "etl_domain_distribution": f"""WITH {_FIRST}, h AS (SELECT {_hits('text')} FROM kept), x AS (SELECT {_ranked()} AS r FROM h)
        SELECT {_RULE} AS label, count(*) AS n FROM x GROUP BY 1""",
    "labels_normalised": f"""SELECT domain_id, CASE WHEN domain_id IS NULL OR domain_id = '' THEN 'oos' ELSE lower({_strip('domain_id')}) END AS normal,
        {_domain('domain_id')} AS domain, count(*) AS n FROM classification_result GROUP BY 1, 2, 3""",
    "labels_stop_words": f"SELECT row_id, text FROM processed_record WHERE lower({_strip('text')}) IN {STOP_WORDS}",
    "labels_soft": f"""WITH h AS (SELECT row_id, {_hits("coalesce(text, '')")} FROM processed_record), x AS (SELECT row_id, list_transform({_ranked()}, lambda x: x.l) AS r FROM h)
        SELECT row_id, CASE WHEN len(r) = 0 THEN '{",".join(DOMAINS)}' ELSE array_to_string(list_concat(r, list_filter({list(DOMAINS)}, lambda d: NOT list_contains(r, d)))[1:3], ',') END AS hints FROM x""",
    "labels_rules": f"""WITH h AS (SELECT row_id, lower({_strip("coalesce(text, '')")}) IN {STOP_WORDS} AS stop, {_hits("coalesce(text, '')")} FROM processed_record),
        x AS (SELECT row_id, stop, {_ranked()} AS r FROM h), y AS (SELECT *, {_RULE} AS rule FROM x)
        SELECT row_id, CASE WHEN stop THEN 'oos' ELSE coalesce(rule, r[1].l, 'oos') END AS label,
            (CASE WHEN stop THEN 0.95 WHEN rule IS NOT NULL THEN 0.9 WHEN len(r) > 0 THEN 0.5 ELSE 0 END)::DOUBLE AS confidence FROM y""",
    "labels_override": f"""WITH {_RES}, b AS (SELECT result_id, domain, conf, list_sort(list_transform(list_filter(top_candidates, lambda c: c.label IS NOT NULL),
            lambda c: {{'s': -coalesce(CASE WHEN isnan(c.score) THEN 0 ELSE c.score END, 0), 'l': {_domain('c.label')}}}))[1] AS best FROM res)
        SELECT result_id, CASE WHEN -best.s >= 0.7 AND best.l <> 'oos' THEN best.l ELSE domain END AS domain,
            CASE WHEN -best.s >= 0.7 AND best.l <> 'oos' THEN -best.s ELSE conf END AS confidence FROM b""",
    "low_confidence": f"WITH {_RES} SELECT result_id, domain, conf FROM res WHERE conf < 0.5",
    "consensus_labels": f"""WITH {_VOTES}, {_PLURALITY.format(votes="votes")},
        h AS (SELECT id, {_hits('t')} FROM one), x AS (SELECT id, {_ranked()} AS r FROM h), rules AS (SELECT id, {_RULE} AS rule FROM x),
        j AS (SELECT rules.id, rule, coalesce(label, 'oos') AS winner, coalesce(n / total, 0) AS ratio, coalesce(mean, 0) AS mean FROM rules LEFT JOIN best USING (id)),
        c AS (SELECT *, CASE WHEN rule = winner THEN least(1.0, mean + 0.1) ELSE mean END AS conf FROM j)
        SELECT id, coalesce(rule, winner) AS final_domain, conf AS final_confidence, ratio AS consensus_ratio, ratio >= 0.67 AS consensus_achieved,
            rule = winner AS rule_match, ratio >= 0.67 AND conf >= 0.5 AS is_valid FROM c""",
    "ensemble_labels": f"""WITH {_VOTES}, v2 AS (SELECT * FROM votes WHERE model <> 'initial'), {_PLURALITY.format(votes="v2")}
        SELECT id, label, own AS confidence, n / total AS ratio, n / total >= 0.67 AS agreed FROM best WHERE total >= 2""",
    "calibration_table": f"""WITH {_RES} SELECT domain, floor(conf * 10)::INT AS bucket, count(*) AS n, avg((domain = {_domain('domain_true')})::INT) AS accuracy
        FROM res WHERE conf IS NOT NULL GROUP BY 1, 2""",
    "calibrated": f"""WITH {_RES}, t AS (SELECT domain, floor(conf * 10)::INT AS bucket, avg((domain = {_domain('domain_true')})::INT) AS accuracy
        FROM res WHERE conf IS NOT NULL GROUP BY 1, 2)
        SELECT result_id, coalesce(accuracy, conf) AS calibrated FROM res LEFT JOIN t ON t.domain = res.domain AND t.bucket = floor(conf * 10)::INT""",
    "confidence_summary": f"""WITH {_RES} SELECT domain, count(*) AS n, count(*) FILTER (conf >= 0.5) AS n_valid, avg(conf) AS mean, quantile_cont(conf, 0.5) AS median,
        stddev_pop(conf) AS std, min(conf) AS low, max(conf) AS high FROM res GROUP BY domain""",
    "confusions": f"""WITH {_RES}, t AS (SELECT domain AS predicted, {_domain('domain_true')} AS truth FROM res)
        SELECT predicted, truth, count(*) AS n FROM t WHERE predicted <> truth GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10""",
    "quality_filter": f"SELECT {_REASON} AS reason, count(*) AS n FROM classification_result GROUP BY 1",
    "balanced_rows": f"""WITH {_FIT}, x AS ({_ITEMS}), r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY o, result_id) AS rn, count(*) OVER (PARTITION BY domain) AS n FROM x),
        t AS (SELECT list_sort(list(n))[count(*) // 2 + 1] AS target FROM (SELECT domain, count(*) AS n FROM fit GROUP BY domain)),
        g AS (SELECT *, CASE WHEN n < 5 THEN n ELSE target END AS goal FROM r, t)
        SELECT result_id, domain, unnest(range(1, ((goal - rn) // n + 2)::BIGINT)) AS copy FROM g WHERE rn <= goal""",
    "stratified_split": f"""WITH {_FIT}, x AS ({_ITEMS}), r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY o, result_id) AS rn FROM x),
        s AS (SELECT domain, count(*) AS n, CASE WHEN count(*) <= 1 THEN 0 ELSE greatest(1, floor(count(*) * 0.1)) END AS take FROM fit GROUP BY domain),
        m AS (SELECT *, greatest(50, floor(sum(n) OVER () * 0.1)) - sum(take) OVER () AS missing, greatest(0, n - take - 1) AS room FROM s),
        c AS (SELECT *, coalesce(sum(room) OVER (ORDER BY n - take DESC, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m),
        q AS (SELECT domain, take + greatest(0, least(room, missing - before)) AS quota FROM c)
        SELECT result_id, r.domain, CASE WHEN rn <= quota THEN 'eval' ELSE 'train' END AS split FROM r JOIN q USING (domain)""",
    "dataset_statistics": f"WITH {_FIT}, {_STATS} SELECT * FROM stats",
    "dataset_score": f"""WITH {_FIT}, {_STATS}, cls AS (SELECT text, min(result_id) AS id, count(*) AS copies FROM fit GROUP BY text), {_LINKS},
        d AS (SELECT ((SELECT sum(copies * (copies - 1) / 2) FROM cls) + (SELECT coalesce(sum(x.copies * y.copies), 0) / 2 FROM links JOIN cls x ON x.id = a JOIN cls y ON y.id = b))
            / (SELECT sum(copies) FROM cls) AS dup)
        SELECT n_rows, greatest(0.0, least(1.0, 1 - 0.3 * dup - least(0.2 * imbalance, 0.3) - 0.2 * (1 - avg_confidence))) AS score,
            array_to_string(list_filter([CASE WHEN dup > 0.05 THEN 'duplicates' END, CASE WHEN imbalance > 1 THEN 'imbalance' END,
                CASE WHEN avg_length < 10 THEN 'short texts' END, CASE WHEN avg_length > 500 THEN 'long texts' END], lambda x: x IS NOT NULL), ',') AS issues FROM stats, d""",
    "source_distribution": "SELECT source, count(*) AS n FROM processed_record GROUP BY source",
    "output_rows": "SELECT coalesce(nullif(domain_true, ''), nullif(domain_id, ''), 'unknown') AS label, count(*) AS n FROM classification_result GROUP BY 1",
    "sharded_rows": """SELECT ((rn - 1) // 777 + 1)::INT AS shard, count(*) AS n, min(result_id) AS first, max(result_id) AS last
        FROM (SELECT result_id, row_number() OVER (ORDER BY result_id) AS rn FROM classification_result) GROUP BY 1""",
    "levenshtein_pairs": f"WITH RECURSIVE {_PAIRS}, {_EDITS} SELECT id, d::INT AS distance, round(ratio, 6) AS ratio FROM edits",
    "term_statistics": f"WITH {_DOC_TF} SELECT term, df, tf FROM vocab",
    "tfidf_norms": f"""WITH {_DOC_TF}, n AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL),
        w AS (SELECT id, tf.tf * (ln((1.0 + n) / (1.0 + df)) + 1) AS w FROM tf JOIN vocab USING (term), n)
        SELECT id AS doc_id, count(*) AS n_terms, round(max(w) / sqrt(sum(w * w)), 6) AS top FROM w GROUP BY id""",
    "pair_cosine": f"""WITH {_PAIRS}, size AS (SELECT count(*) AS n FROM processed_record WHERE text IS NOT NULL),
        corpus AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_terms('text')})) AS term FROM processed_record WHERE text IS NOT NULL) GROUP BY term),
        {_COSINE.format(p="pairs", a=_terms("a"), b=_terms("b"), none="0")}
        SELECT id, round(cosine, 6) AS cosine FROM cosine""",
    "quality_gate": f"""WITH RECURSIVE {_PAIRS}, {_EDITS}, size AS (SELECT count(*) AS n FROM augmentation_result WHERE original_text IS NOT NULL),
        corpus AS (SELECT term, count(*) AS df FROM (
            SELECT unnest(list_distinct({_terms('original_text')})) AS term FROM augmentation_result WHERE original_text IS NOT NULL) GROUP BY term),
        {_COSINE.format(p="pairs", a=_terms("a"), b=_terms("b"), none="0")},
        i AS (SELECT array_to_string(list_filter([CASE WHEN cosine > 0.95 THEN 'high similarity' END, CASE WHEN cosine < 0.3 THEN 'low similarity' END,
            CASE WHEN d < 3 THEN 'few changes' END, CASE WHEN ratio > 0.8 THEN 'many changes' END], lambda x: x IS NOT NULL), ',') AS issues
            FROM edits JOIN cosine USING (id))
        SELECT issues, issues = '' AS is_valid, count(*) AS n FROM i GROUP BY 1, 2""",
    "near_duplicates": f"""WITH cls AS (SELECT text, min(doc_id) AS id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text), {_LINKS},
        c AS (SELECT a AS id, count(*) AS n_links FROM links GROUP BY a)
        SELECT doc_id, cls.id AS class_id, coalesce(n_links, 0) AS n_links FROM documents JOIN cls USING (text) LEFT JOIN c ON c.id = cls.id""",
    "review_batch": f"""WITH {_RES}, one AS (SELECT text, min({{'c': conf, 'r': result_id}}) AS m FROM res
            WHERE conf < 0.5 AND text IS NOT NULL AND text NOT IN (SELECT text FROM review_item WHERE text IS NOT NULL) GROUP BY text)
        SELECT m.r AS result_id, text, m.c AS conf, left(md5(text), 16) AS item FROM one""",
    "reviewed_export": f"""SELECT id, {_domain('coalesce(corrected_domain, predicted_domain)')} AS label, 1.0::DOUBLE AS confidence FROM review_item
        WHERE status IN ('approved', 'corrected') QUALIFY row_number() OVER (PARTITION BY id ORDER BY review_timestamp DESC NULLS LAST, review_id DESC) = 1""",
    "feedback_statistics": f"WITH {_OPINIONS} SELECT * FROM counts",
    "feedback_retrain": f"""WITH {_OPINIONS}, s AS (SELECT sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (predicted <> corrected), 0)::BIGINT AS corrections,
            coalesce(sum(recent) FILTER (predicted <> corrected), 0)::BIGINT AS recent FROM counts)
        SELECT *, corrections / total AS rate, recent > 20 OR corrections / total > 0.3 AS retrain FROM s""",
    "feedback_warnings": f"""WITH {_OPINIONS}, w AS (SELECT *, sum(n) OVER () AS s FROM counts WHERE predicted <> corrected)
        SELECT predicted, corrected, n, predicted || ' is often ' || corrected AS warning FROM w WHERE s >= 10 AND n >= 3""",
    "feedback_examples": f"""WITH {_OPINIONS}, c AS (SELECT text, min(corrected) AS domain, max(seen) AS last FROM op
            WHERE seen >= TIMESTAMP '2024-12-01' AND length(trim(text)) BETWEEN 5 AND 200 GROUP BY text HAVING min(corrected) = max(corrected))
        SELECT domain, row_number() OVER (PARTITION BY domain ORDER BY last DESC, text)::INT AS turn, text FROM c QUALIFY turn <= 3""",
    "context_last": """SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INT AS turn, event_id FROM events
        WHERE user_id IS NOT NULL QUALIFY turn <= 10""",
    "context_preferences": """WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k,
            count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE user_id IS NOT NULL)
        SELECT user_id AS user, event_type AS domain, round(sum(CASE WHEN k = n THEN pow(2.0, 1 - n) ELSE pow(2.0, -k) END), 6) AS weight
        FROM r GROUP BY 1, 2""",
    "context_statistics": """SELECT count(*) AS users, count(*) FILTER (l > TIMESTAMP '2024-01-29') AS active, sum(n)::BIGINT AS messages
        FROM (SELECT user_id, count(*) AS n, max(ts) AS l FROM events WHERE user_id IS NOT NULL GROUP BY user_id)""",
    "cache_lookup": """WITH c AS (SELECT md5(text || '|v1') AS key, coalesce(domain_id, '') AS result FROM classification_result
            WHERE text IS NOT NULL AND classified_at >= TIMESTAMP '2024-12-31' - INTERVAL 2160 HOUR
            QUALIFY row_number() OVER (PARTITION BY text ORDER BY classified_at DESC, coalesce(domain_id, '') DESC) = 1)
        SELECT row_id, result FROM processed_record JOIN c ON md5(text || '|v1') = key""",
    "scan_recent": "SELECT result_id, domain_id FROM classification_result WHERE classified_at >= TIMESTAMP '2024-12-24'",
    "scan_between": f"""SELECT {_domain('domain_id')} AS domain, count(*) AS n FROM classification_result
        WHERE classified_at >= TIMESTAMP '2024-03-01' AND classified_at < TIMESTAMP '2024-04-01' GROUP BY 1""",
    "version_tags": """WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE p_partkey % 7 END AS a, CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE p_size END AS b FROM part)
        SELECT p_partkey, a::INT AS major, b::INT AS minor, 0 AS patch, 'v' || a || '.' || b || '.1' AS next_patch, 'v' || (a + 1) || '.0.0' AS next_major FROM t""",
    "metadata_difference": """WITH r AS (SELECT row_id, arg_max(metadata, review_id) AS metadata FROM review_item WHERE metadata IS NOT NULL GROUP BY row_id),
        a AS (SELECT row_id, e.key AS name, e.value AS v FROM (SELECT row_id, unnest(map_entries(metadata)) AS e FROM processed_record WHERE row_id IN (SELECT row_id FROM r))),
        b AS (SELECT row_id, e.key AS name, e.value AS v FROM (SELECT row_id, unnest(map_entries(metadata)) AS e FROM r))
        SELECT coalesce(a.row_id, b.row_id) AS row_id, coalesce(a.name, b.name) AS name, a.v AS old_value, b.v AS new_value
        FROM a FULL JOIN b ON a.row_id = b.row_id AND a.name = b.name WHERE a.v IS DISTINCT FROM b.v""",
    "union_all": """SELECT domain, kind, count(*) AS n FROM (SELECT domain, 'original' AS kind FROM augmentation_result
        UNION ALL SELECT domain, 'variant' FROM (SELECT domain, unnest(variants) AS v FROM augmentation_result)) GROUP BY 1, 2""",
    "label_accuracy": f"""WITH h AS (SELECT {_domain('domain_true')} AS t, {_hits('text')} FROM classification_result WHERE text IS NOT NULL),
        x AS (SELECT t, {_ranked()} AS r FROM h), y AS (SELECT t = {_RULE} AS ok FROM x)
        SELECT count(ok) AS n, count(*) FILTER (ok) AS n_correct, count(*) FILTER (NOT ok) AS n_relabelled, count(*) FILTER (ok) / count(ok) AS accuracy FROM y""",
    "validation_rates": """SELECT count(*) AS n, count(*) FILTER (consensus_achieved) / count(*) AS consensus_rate, count(*) FILTER (rule_match) / count(*) AS rule_rate,
        count(*) FILTER (is_valid) / count(*) AS valid_rate FROM validation_result""",
    "problem_items": """SELECT id, min(consensus_ratio) AS ratio, min(final_confidence) AS confidence FROM validation_result GROUP BY id
        HAVING NOT bool_and(coalesce(is_valid, false)) ORDER BY 2 NULLS FIRST, 3 NULLS FIRST, 1 LIMIT 20""",
    "cache_statistics": """SELECT count(*) AS entries, count(DISTINCT coalesce(text, '')) AS keys,
        count(*) FILTER (classified_at >= TIMESTAMP '2024-12-31' - INTERVAL 2160 HOUR) AS fresh,
        count(*) FILTER (NOT coalesce(classified_at >= TIMESTAMP '2024-12-31' - INTERVAL 2160 HOUR, false)) AS expired FROM classification_result""",
    "feedback_prompts": "WITH e AS ({}) SELECT domain, string_agg('Example ' || turn || ': ' || text || ' -> ' || domain, chr(10) ORDER BY turn) AS prompt FROM e GROUP BY domain",
    "context_preferred": "WITH p AS ({}) SELECT \"user\", row_number() OVER (PARTITION BY \"user\" ORDER BY weight DESC, domain)::INT AS turn, domain FROM p QUALIFY turn <= 3",
    "context_prompts": """WITH p AS ({}), t AS (SELECT "user", domain, row_number() OVER (PARTITION BY "user" ORDER BY weight DESC, domain) AS k FROM p QUALIFY k <= 3),
        d AS (SELECT "user", string_agg(domain, ',' ORDER BY k) AS domains FROM t GROUP BY 1),
        m AS (SELECT user_id AS "user", left(event_type, 100) AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events QUALIFY k IN (2, 3)),
        r AS (SELECT "user", string_agg(x, ' | ' ORDER BY k DESC) AS recent FROM m GROUP BY 1)
        SELECT d."user", coalesce(recent, '') AS recent, domains FROM d LEFT JOIN r USING ("user")""",
}
SQL["feedback_prompts"] = SQL["feedback_prompts"].format(SQL["feedback_examples"])
for _name in ("context_preferred", "context_prompts", "context_top"):
    SQL[_name] = SQL[_name].format(SQL["context_preferences"].replace("round(sum(", "(sum(").replace(", 6) AS weight", ") AS weight"))
