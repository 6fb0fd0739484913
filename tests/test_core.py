from __future__ import annotations

import datetime
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from siltwork.config import EtlConfig, WriterConfig
from siltwork.functions.taxonomy import is_stop_word, normalise_label, rule_label, soft_candidates, validate_domain
from siltwork.functions.text import DOMAINS
from siltwork.operators import dataset, etl, feedback, labels, similarity, versions
from siltwork.operators.model_calls import augment, classify, latest_entries, response_json, response_lines, rule_classification
from siltwork.operators.ranking import ranked_within
from siltwork.pipeline import Pipeline
from siltwork.sources import readers, sinks
from siltwork.streaming import records as streaming


def one(spark, expr, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_taxonomy(spark):
    assert one(spark, normalise_label, "HOUSE", " okc ", "", None, "Foo") == ["house", "okc", "oos", "oos", "foo"]
    assert one(spark, validate_domain, "HOUSE", "foo", None) == ["house", "oos", "oos"]
    assert one(spark, is_stop_word, " Хватит ", "хватит уже!", None) == [True, False, False]
    assert one(spark, rule_label, "вывоз дивана", "тариф", "квитанция и тариф", "ничего", None) == ["utilizer", None, None, None, None]
    assert one(spark, rule_label, "показания водосчетчика: квитанция за электричество, тариф")[0] == "house"
    assert one(spark, soft_candidates, "", "метро и диван", None)[0] == list(DOMAINS)[:6]
    assert one(spark, soft_candidates, "метро и диван")[0][:2] == ["utilizer", "okc"]


def test_etl_fields(spark):
    df = spark.createDataFrame(
        [(1, None, "  второй  текст ", "u1", 5), (2, "", "никогда", None, 6), (3, "ab", "x", "u", 7), (4, "второй текст", None, None, None)],
        "Row_Id int, ` Text` string, Message string, UID string, other int",
    )
    out = {r["row_id"]: r for r in etl.process_records(df, source="s").collect()}
    assert set(out) == {1} and out[1]["text"] == "второй текст" and out[1]["user_id"] == "u1" and out[1]["metadata"] == {"other": "5"}
    assert etl.process_records(df, config=EtlConfig(deduplicate=False)).count() == 2
    stats = etl.etl_statistics(df.select("Row_Id", " Text")).first()
    assert (stats["total"], stats["processed"], stats["filtered"], stats["duplicates"]) == (4, 1, 3, 0)
    long = spark.createDataFrame([(1, "я" * 1001)], "row_id int, text string")
    assert len(etl.process_records(long).first()["text"]) == 1000
    assert etl.process_records(long.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, 2)], "a int, b int").toDF("A", "a ")
    assert etl.normalise_headers(twice).columns == ["a"]


def test_ranking_matches_window(spark):
    rows = [(i, None if i % 50 == 0 else "big" if i % 3 else f"g{i % 7}", i * 37 % 101) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, g string, rank int")
    got = {r["id"]: r["pos"] for r in ranked_within(df, F.col("g"), [F.col("rank").desc(), F.col("id")], "pos").collect()}
    by = {}
    for i, g, s in rows:
        by.setdefault(g, []).append((-s, i))
    want = {i: k + 1 for v in by.values() for k, (_, i) in enumerate(sorted(v))}
    assert got == want
    assert ranked_within(df.limit(0), F.col("g"), [F.col("id")]).count() == 0


def test_balance_and_split(spark):
    rows = [(i, "house" if i < 100 else "okc" if i < 130 else "oos" if i < 140 else "payments") for i in range(142)]
    df = spark.createDataFrame(rows, "row_id int, domain string")
    sizes = {r["domain"]: r["count"] for r in dataset.balance(df).groupBy("domain").count().collect()}
    assert sizes == {"house": 30, "okc": 30, "oos": 30, "payments": 2}  # the upper median; a tiny domain stays
    copies = dataset.balance(df).where("domain = 'oos'").groupBy("row_id").count().collect()
    assert {r["count"] for r in copies} == {3}
    split = dataset.stratified_split(df, config=WriterConfig(eval_fraction=0.1, min_eval=20))
    assert split.count() == 142 and split.where("split = 'eval'").count() == 20
    assert split.where("split = 'train'").select("domain").distinct().count() == 4
    assert dataset.balance(df.limit(0)).count() == 0 and dataset.stratified_split(df.limit(0)).count() == 0
    assert dataset.eval_sizes({"house": 2, "payments": 2, "okc": 1}, WriterConfig(eval_fraction=0.2)) == {"house": 1, "payments": 1, "okc": 0}


def test_eval_sizes_against_loop():
    import random

    rnd = random.Random(7)
    for _ in range(200):
        sizes = {f"d{k}": rnd.randint(1, 80) for k in range(rnd.randint(1, 6))}
        config = WriterConfig(eval_fraction=rnd.choice([0.05, 0.1, 0.3]), min_eval=rnd.choice([5, 50]))
        take = dataset.eval_sizes(sizes, config)
        assert all(0 <= take[d] < max(2, n) for d, n in sizes.items())
        want = max(config.min_eval, int(sum(sizes.values()) * config.eval_fraction))
        assert sum(take.values()) >= min(want, sum(n - 1 for n in sizes.values()))


def test_similarity_golden(spark):
    a = "передать показания счетчика"
    rows = [(1, a, "передать показания счётчика"), (2, a, "подать данные с прибора учета"), (3, a, "купить хлеб в магазине"), (4, a, "передать показа"), (5, "", "")]
    pairs = spark.createDataFrame(rows, "id int, a string, b string")
    gate = {r["id"]: r for r in similarity.quality_gate(pairs, similarity.pair_cosine(pairs)).collect()}
    assert [round(gate[i]["cosine"], 4) for i in range(1, 6)] == [0.4316, 0.0, 0.0, 0.1506, 0.5]
    assert [gate[i]["levenshtein"] for i in range(1, 6)] == [1, 22, 22, 12, 0]
    assert [round(gate[i]["ratio"], 4) for i in range(1, 6)] == [0.0370, 0.7586, 0.8148, 0.4444, 0.0]
    assert gate[1]["issues"] == ["few changes"] and gate[3]["issues"] == ["low similarity", "many changes"] and not gate[4]["is_valid"]


def test_near_duplicates(spark):
    base = "лифт в нашем доме не работает уже третий день и никто не приходит чинить его совсем " * 3
    df = spark.createDataFrame([(1, base), (2, base), (3, base + "точка"), (4, "совсем другое дело"), (5, None), (6, "?")], "id int, text string")
    out = {r["id"]: (r["class_id"], r["n_links"]) for r in similarity.near_duplicates(df, id_col="id", text_col="text").collect()}
    assert out == {1: (1, 1), 2: (1, 1), 3: (3, 1), 4: (4, 0), 6: (6, 0)}


def test_votes(spark):
    votes = spark.createDataFrame(
        [("a", "okc", 0.5, 0), ("a", "house", 0.9, 1), ("b", "okc", 0.6, 0), ("b", "okc", 0.8, 1), ("b", "oos", None, 2), ("c", None, 0.3, 0)],
        "id string, label string, confidence double, turn int",
    )
    out = {r["id"]: r for r in labels.count_votes(votes).collect()}
    assert out["a"]["winner"] == "okc" and out["a"]["total_votes"] == 2  # a tie: the first seen
    assert out["b"]["winner_votes"] == 2 and out["b"]["mean_confidence"] == pytest.approx(0.7) and "c" not in out
    rules = spark.createDataFrame([("a", "house"), ("b", "okc"), ("c", None)], "id string, rule string")
    final = {r["id"]: r for r in labels.consensus_labels(votes, rules).collect()}
    assert final["a"]["final_domain"] == "house" and not final["a"]["consensus_achieved"]
    assert final["b"]["final_confidence"] == pytest.approx(0.8) and not final["b"]["consensus_achieved"]  # 2 of 3 is under 0.67
    assert final["c"]["final_domain"] == "oos" and final["c"]["consensus_ratio"] == 0.0


def test_calibration(spark):
    df = spark.createDataFrame([("okc", 1.0, True), ("okc", 1.0, False), ("okc", 0.31, True), ("oos", None, True)], "d string, c double, ok boolean")
    table = labels.calibration_table(df, label=F.col("d"), confidence=F.col("c"), correct=F.col("ok"))
    assert {(r["bucket"], r["accuracy"]) for r in table.collect()} == {(10, 0.5), (3, 1.0)}
    out = labels.calibrate(df, table, label=F.col("d"), confidence=F.col("c")).collect()
    assert [r["calibrated"] for r in out] == [0.5, 0.5, 1.0, None]


def test_versions(spark, tmp_path):
    assert one(spark, lambda c: F.to_json(versions.parse_version(c)), "v1.2.3", "1.2", "vX", None) == [
        '{"major":1,"minor":2,"patch":3}', '{"major":1,"minor":2,"patch":0}', '{"major":0,"minor":0,"patch":0}', '{"major":0,"minor":0,"patch":0}',
    ]
    assert one(spark, versions.next_version, "v1.2.3", None) == ["v1.3.0", "v1.0.0"]
    store = versions.VersionStore(spark, str(tmp_path / "store"))
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    now = datetime.datetime(2024, 1, 1)
    assert store.commit(df, as_of=now, metadata={"k": "1", "same": "x"}) == "v1.0.0"
    assert store.commit(df.limit(1), as_of=now + datetime.timedelta(days=1), metadata={"k": "2", "same": "x"}) == "v1.1.0"
    assert [r["tag"] for r in store.versions().collect()] == ["v1.1.0", "v1.0.0"]
    assert store.checkout("v1.0.0").count() == 2
    assert [tuple(r) for r in store.compare("v1.0.0", "v1.1.0").collect()] == [("k", "1", "2")]
    assert versions.content_hash(df) == versions.content_hash(df.orderBy(F.desc("id")).repartition(3)) != versions.content_hash(df.limit(1))
    with pytest.raises(ValueError):
        store.commit(df, tag="v1.0.0", as_of=now)
    assert [r["tag"] for r in store.archived(keep=1).collect()] == ["v1.0.0"]
    assert tuple(store.statistics().first())[:3] == (2, 3, "v1.1.0")


def test_feedback_and_context(spark):
    rows = [(i, "u" if i % 2 else None, "ab"[i % 3 == 0], datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=i)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, user string, domain string, at timestamp")
    got = {r["domain"]: r["weight"] for r in feedback.preferences(df, user="user", domain="domain", at="at", id_col="id").collect()}
    weights: dict[str, float] = {}
    for _, u, d, _ in rows:
        if u:
            weights = {k: v / 2 for k, v in weights.items()} if weights else {}
            weights[d] = weights.get(d, 0) + (0.5 if weights else 1.0)
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in weights.items()}
    assert feedback.last_messages(df, user="user", at="at", id_col="id", n=3).count() == 3
    ops = spark.createDataFrame([("текст раз", "a", 1), ("текст раз", "b", 2), ("текст два", "a", 3), ("кот", "a", 4)], "t string, c string, d int")
    ops = ops.withColumn("at", F.timestamp_micros(F.col("d").cast("long")))
    out = feedback.dynamic_examples(ops, text=F.col("t"), corrected=F.col("c"), at=F.col("at"), as_of=datetime.datetime(1970, 1, 5))
    assert [r["text"] for r in out.collect()] == ["текст два"]


def test_model_calls(spark):
    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "хватит"), (4, None), (5, "a")], "row_id int, text string")

    def model(texts):
        if "bad" in texts:
            raise RuntimeError
        return [("okc", 0.8)] * len(texts)

    out = {r["id"]: (r["label"], r["confidence"]) for r in classify(df, model, batch=1).collect()}
    assert out == {1: ("okc", 0.8), 2: ("oos", 0.0), 3: ("oos", 0.95), 4: ("oos", 0.0), 5: ("okc", 0.8)}
    seeds = spark.createDataFrame([("t", "okc")], "text string, domain string")
    made = augment(seeds, lambda ts, ds: [["- t", "x", "x", "", "y", "z", "w"]], variants=2).collect()
    assert [r["variant"] for r in made] == ["x", "y"]
    assert one(spark, response_lines, "- a\n• a\n\n b\nc\nd\ne") == [["a", "b", "c", "d"]]
    assert one(spark, lambda c: response_json(c, "k string")["k"], 'ok {"k": "v"} end', "none") == ["v", None]
    cache = spark.createDataFrame([("k", "old", "2024-01-01 00:00:00"), ("k", "new", "2024-01-01 10:00:00"), ("x", "stale", "2023-01-01 00:00:00")], "key string, result string, ts string")
    fresh = latest_entries(cache.withColumn("ts", F.col("ts").cast("timestamp")), as_of=datetime.datetime(2024, 1, 1, 12))
    assert [tuple(r) for r in fresh.collect()] == [("k", "new")]
    assert one(spark, lambda c: rule_classification(c)["label"], "хватит", "вывоз мебели", "???", None) == ["oos", "utilizer", "oos", "oos"]


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("text;domain\nпривет, мир;okc\n".encode("cp1251"))
    assert [tuple(r) for r in readers.read_any(spark, str(tmp_path / "a.csv")).collect()] == [("привет, мир", "okc")]
    (tmp_path / "b.csv").write_bytes(b"\xef\xbb\xbf" + "text,n\n\"да, нет\",1\n".encode())
    assert readers.read_any(spark, str(tmp_path / "b.csv")).first()["text"] == "да, нет"
    (tmp_path / "c.json").write_text(json.dumps({"data": [{"text": "a"}, {"text": "b"}]}))
    assert readers.read_any(spark, str(tmp_path / "c.json")).count() == 2
    (tmp_path / "d.jsonl").write_text('{"text": "a"}\n\n{"broken\n{"text": "b"}\n')
    assert {r["text"] for r in readers.read_any(spark, str(tmp_path / "d.jsonl")).collect()} == {"a", "b"}
    with zipfile.ZipFile(tmp_path / "e.xlsx", "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>text</t></si><si><t>привет</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>5</v></c></row></sheetData></worksheet>')
    assert [tuple(r) for r in readers.read_any(spark, str(tmp_path / "e.xlsx")).collect()] == [("привет", "5")]
    with pytest.raises(ValueError):
        readers.read_any(spark, "x.doc")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}", "okc") for i in range(10)], "id int, text string, domain_id string")
    sinks.write_sharded(df, str(tmp_path / "s"), rows=4, order="id")
    back = spark.read.json(str(tmp_path / "s"))
    assert {(r["shard"], r["count"]) for r in back.groupBy("shard").count().collect()} == {(1, 4), (2, 4), (3, 2)}
    rows = sinks.output_rows(df.withColumn("domain_true", F.lit("")))
    assert rows.columns == ["text", "label"] and rows.first()["label"] == "okc"
    sinks.export(df.withColumn("a", F.array("id")), str(tmp_path / "x"), "csv")
    assert spark.read.csv(str(tmp_path / "x"), header=True).count() == 10
    with pytest.raises(ValueError):
        sinks.export(df, str(tmp_path / "y"), "doc")


def test_streams(spark, tmp_path):
    schema = "text string, user_id string, domain string, ts timestamp"
    rows = [("один  раз", "u", "okc", "2024-01-01T10:00:00"), ("один раз", "u", "house", "2024-01-01T10:01:00"), ("x", "v", "okc", "2024-01-01T10:02:00")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(dict(zip(("text", "user_id", "domain", "ts"), r)), ensure_ascii=False) for r in rows))
    source = spark.readStream.schema(schema).json(str(tmp_path / "in"))

    def run(df, name, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    assert [r["text"] for r in run(streaming.clean_stream(source), "clean", "append")] == ["один раз"]
    assert sum(r["n"] for r in run(streaming.windowed_counts(source, at="ts", key="domain"), "counts", "complete")) == 3
    prefs = {(r["user"], r["domain"]): r["weight"] for r in run(streaming.user_preferences(source), "prefs", "update")}
    assert prefs == {("u", "okc"): 0.5, ("u", "house"): 0.5, ("v", "okc"): 1.0}


def test_pipeline(spark, tmp_path):
    lines = ["text,domain"] + [f"вывоз мебели номер {i},utilizer" for i in range(8)] + [f"расписание метро {i},okc" for i in range(6)] + ["??,oos"]
    (tmp_path / "in.csv").write_text("\n".join(lines), encoding="utf-8")
    for leak_safe in (False, True):
        p = Pipeline(spark, str(tmp_path / f"out{leak_safe}"), writer=WriterConfig(min_eval=2, leak_safe=leak_safe))
        tag = p.run(str(tmp_path / "in.csv"), as_of=datetime.datetime(2024, 1, 1))
        assert tag == "v1.0.0" and p.load(tag, "eval").count() >= 2 and p.statistics(tag).first()["n_domains"] == 2
        if leak_safe:
            shared = p.load(tag, "eval").select("text").intersect(p.load(tag, "train").select("text"))
            assert shared.count() == 0
