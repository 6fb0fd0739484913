from __future__ import annotations

import datetime
import itertools
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltwork.functions.text import DOMAINS
from siltwork.llm import personal_data as pd_
from siltwork.llm.capping import cap_contributors, valid_score
from siltwork.llm.consensus import Communities, annotation_votes, consensus, digamma
from siltwork.llm.encoding import DEFAULT_VOCABULARY, Encoder, RankQueue, encode_corpus, load_vocabulary
from siltwork.llm.formatting_duplicates import collapse_duplicates, duplicate_members
from siltwork.llm.grouped_splits import components, grouped_split, related_users, user_groups
from siltwork.llm.leakage import find_leaks, myers_distance, normal_words
from siltwork.llm.sentences import sentences


# --- 1 consensus ---------------------------------------------------------------------------------


def votes_of(spark, rows):
    return spark.createDataFrame(rows, "item string, annotator string, label string, weight double")


def test_digamma():
    assert digamma([1.0, 0.5, 10.0]) == pytest.approx([-0.5772156649, -1.9635100260, 2.2517525890], abs=1e-8)


def test_consensus_finds_the_dependable(spark):
    rnd = random.Random(3)
    truth = {f"i{k}": rnd.choice("abc") for k in range(400)}
    rows = []
    for item, t in truth.items():
        for who, care in (("good1", 0.95), ("good2", 0.9), ("bad1", 0.3), ("bad2", 0.3), ("bad3", 0.3)):
            rows.append((item, who, t if rnd.random() < care else rnd.choice("abc"), 1.0))
        # A liar who always turns the label round is as telling as a good annotator.
        rows.append((item, "liar", {"a": "b", "b": "c", "c": "a"}[t], 1.0))
    items, people = consensus(votes_of(spark, rows), classes=("a", "b", "c"))
    got = {r["item"]: r for r in items.collect()}
    assert sum(got[i]["label"] == t for i, t in truth.items()) >= 385
    care = {r["annotator"]: r["reliability"] for r in people.collect()}
    assert care["good1"] > 0.85 > 0.6 > care["bad1"] and care["liar"] < 0.2
    assert all(0 <= r["agreement"] <= 1 and r["n_labels"] == 6 for r in got.values())


def test_consensus_cases(spark):
    rows = [("x", "r", "a", None), ("x", "r", "a", 1.0), ("y", None, "a", 1.0), ("z", "r", "?", 1.0), ("z", None, None, None)]
    items, people = consensus(votes_of(spark, rows), classes=("a", "b"))
    got = {r["item"]: r for r in items.collect()}
    assert got["x"]["label"] == "a" and got["z"]["label"] is None and got["y"]["agreement"] is None
    assert {r["annotator"] for r in people.collect()} == {"r", ""}
    empty, nobody = consensus(votes_of(spark, []), classes=("a", "b"))
    assert empty.count() == 0 and nobody.count() == 0
    with pytest.raises(ValueError):
        consensus(votes_of(spark, rows), classes=("a", "b"), max_annotators=1)


def test_weights_add_up_and_conflicts_count(spark):
    rows = [(f"i{k}", w, "a" if k % 2 else "b", 1.0) for k in range(30) for w in ("x", "y")]
    rows += [("q", "x", "a", 1.0), ("q", "x", "b", 2.0), ("q", "x", "b", 1.0), ("r", "y", "a", 1.0), ("r", "y", "a", None)]
    items, people = consensus(votes_of(spark, rows), classes=("a", "b"))
    got = {r["item"]: r for r in items.collect()}
    assert (got["q"]["label"], got["q"]["n_labels"], got["r"]["label"], got["r"]["n_labels"], got["r"]["agreement"]) == ("b", 4, "a", 2, 1.0)
    with pytest.warns(UserWarning, match="not settled"):
        consensus(votes_of(spark, rows), classes=("a", "b"), rounds=1)


def test_annotation_votes(spark):
    p = "array<struct<domain string, confidence double, temperature string, run int>>"
    v = spark.createDataFrame(
        [("1", [("OKC ", 0.5, "0.3", 1)], {"okc": 1}), ("1", [("OKC ", 0.5, "0.3", 1)], None), ("2", None, {"House": 2, "okc": 1}), ("3", None, None)],
        f"id string, all_predictions {p}, consensus_votes map<string,int>",
    )
    t = datetime.datetime(2024, 1, 1)
    r = spark.createDataFrame(
        [(1, "1", "a", "house", None, "approved", t), (2, "1", "a", "house", "oos", "corrected", t + datetime.timedelta(1)), (3, "1", "b", "house", None, "pending", t)],
        "review_id long, id string, reviewer_id string, predicted_domain string, corrected_domain string, status string, review_timestamp timestamp",
    )
    got = {(x["item"], x["annotator"], x["label"], x["weight"]) for x in annotation_votes(v, r).where("label IS NOT NULL").collect()}
    assert got == {("1", "run:0.3", "okc", 1.0), ("2", "run:?", "house", 2.0), ("2", "run:?", "okc", 1.0), ("1", "reviewer:a", "oos", 1.0)}
    assert Communities(2, 6, (0.9, 0.5), 8.0, 20.0).reliability().shape == (2,)


# --- 3 personal data -----------------------------------------------------------------------------

TEXTS = [
    ("Мой телефон +7 (593) 877-56-68, звоните", ["phone"]), ("тел. 8 580 064 11 73 лицевой счёт 409383221384", ["phone"]), ("Call 2025550185", ["phone"]),
    ("My number is +44 7700 900193", ["phone"]), ("звоните +49 30 23125 253", ["phone"]), ("пишите: zoya+dom@pochta.example", ["email"]),
    ("почта gremyach429 собака dom-7 точка example", ["email"]), ("mail me: a_b(at)mail(dot)test", ["email"]), ("картинка plan@2x.png, бот @gorod_otvet", []),
    ("СНИЛС 009-031-027 93", ["id_number"]), ("паспорт серия 0061 номер 908921", ["id_number"]), ("ИНН 008147654147 и полис ОМС 0000 6159 8453 6948", ["id_number", "id_number"]),
    ("passport ZZ 4812486; SSN 000-98-0565; ID card no. ZZ9616582", ["id_number"] * 3), ("штрихкод 4099205646197, заявка ZK-2024-20914, объект 77:06:36394:11", []),
    ("Живу: наб. Кружевная, д. 75, кв. 160", ["address"]), ("Дом стоит на ежевичной 127 кв 105", ["address"]), ("Ручейная ул., 66", ["address"]), ("I live at flat 161, 27 Foxglove Lane", ["address"]),
    ("улица Каменная перекрыта, договор 225", []), ("улица Тихая\nверсия 4.11.2", []), ("остановка «Улица Рябиновая», столб 1", []),
    ("Заявитель Овсюговская Анна Олеговна", ["name"]), ("со слов глеба уваренцева", ["name"]), ("Это М. З. Сырочягин", ["name"]), ("Цапелушин Р. И. просит", ["name"]), ("My name is R. Quillfeather", ["name"]),
    ("Yours, Draxton, Silas", ["name"]), ("магазин «Анна и Глеб» закрыт, библиотека имени Грибного Короля", []), ("", []), (None, []),
]


@pytest.mark.parametrize(("text", "kinds"), TEXTS)
def test_personal_kinds(text, kinds):
    assert [k for _, _, k in pd_.find_personal(text)] == kinds


@given(st.text("0123456789", max_size=24), st.binary(min_size=1, max_size=8))
def test_feistel_round_trip(digits, key):
    new = pd_.feistel(digits, key)
    assert len(new) == len(digits) and pd_.feistel(new, key, inverse=True) == digits


def test_feistel_is_a_permutation_and_checks_stay_valid():
    assert len({pd_.feistel(f"{i:03d}", b"k") for i in range(1000)}) == 1000
    assert len({pd_.feistel(str(i), b"k") for i in range(10)}) == 10
    body = "112233445"
    new = pd_.permute_number(body + pd_.snils_check(body), b"k", "id_number")
    assert new[9:] == pd_.snils_check(new[:9]) and pd_.snils_check("112233445") == "95"
    assert pd_.permute_number(new, b"k", "id_number", inverse=True)[:9] == body
    assert pd_.inn_check("5001007322")[:2] == "59" and pd_.luhn_check("7992739871") == "3"
    first, last = datetime.date(1950, 1, 1), datetime.date(1950, 2, 9)
    days = [first + datetime.timedelta(i) for i in range(40)]
    assert sorted(pd_.permute_date(d, b"k", first, last) for d in days) == days
    assert all(pd_.permute_date(pd_.permute_date(d, b"k", first, last), b"k", first, last, inverse=True) == d for d in days)


def test_redaction_links_equal_values():
    a, b = pd_.redact("тел. 8 580 064 11 73, ждём", b"k"), pd_.redact("звоните 8(580)0641173", b"k")
    digits = lambda s: "".join(c for c in s if c.isdigit())
    assert a.startswith("тел. [phone +7 ") and a.endswith("], ждём") and digits(a) == digits(b) != "75800641173"
    assert pd_.redact("Анна Олеговна", b"k") == pd_.redact("АННА  ОЛЕГОВНА", b"k") and pd_.redact(None, b"k") is None


def test_personal_operators(spark):
    df = spark.createDataFrame([(1, "тел. 85800641173 и 85800641174", "x"), (None, "тел. 85800641173", "y"), (3, None, "z"), (4, "", "q"), (5, "я" * 100_000, "w")], "k long, text string, kind string")
    got = [tuple(r) for r in pd_.personal_occurrences(df, id_col="k").collect()]
    assert [(a, b, c) for a, b, c, _, _ in got] == [(1, "phone", 1), (1, "phone", 2), (None, "phone", 1)]
    assert pd_.redact_texts(df, key=b"k", id_col="k").count() == 5
    assert pd_.personal_occurrences(df.limit(0), id_col="k").count() == 0


# --- 4 formatting duplicates ---------------------------------------------------------------------


def test_formatting_duplicates(spark):
    rows = [
        (5, "Нет света!"), (2, "  нет СВЕТА "), (9, "«Нет — света»"), (7, "нет света"), (3, "света нет"), (1, None), (4, "  ?! "), (6, ""),
        (20, "Раздел: ЖКУ; Прибор: газа; Итог: 5"), (21, "итог : 5 | раздел: жку | прибор: газа"), (22, '{"Прибор": "газа", "Итог": 5, "Раздел": "ЖКУ"}'),
        (23, "Раздел: газа; Прибор: ЖКУ; Итог: 5"), (24, "Раздел ЖКУ Прибор газа Итог 5"), (25, "Раздел: ЖКУ\nИтог: 5\nПрибор: газа"),
        (30, '{"a": {"x": 1, "y": [1, 2]}, "b": null}'), (31, '{"b": null, "a": {"y": [1, 2], "x": 1}}'), (32, '{"b": null, "a": {"y": [2, 1], "x": 1}}'),
        (40, "слово " * 30_000), (41, "СЛОВО, " * 30_000),
    ]
    df = spark.createDataFrame([(*r, "c") for r in rows], "id long, text string, canon string")
    got = {tuple(r) for r in duplicate_members(df, id_col="id", text_col="text").collect()}
    assert got == {(2, 5), (2, 7), (2, 9), (20, 21), (20, 22), (20, 24), (20, 25), (30, 31), (40, 41)}
    copies = {r["first_id"]: r["copies"] for r in collapse_duplicates(df, id_col="id", text_col="text").collect()}
    assert copies == {2: 4, 3: 1, 20: 5, 23: 1, 30: 2, 32: 1, 40: 2}
    assert duplicate_members(df.limit(0), id_col="id", text_col="text").count() == 0
    hot = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "Горячий ключ").otherwise(F.concat(F.lit("текст "), F.col("id") % 900)).alias("text"))
    assert duplicate_members(hot, id_col="id", text_col="text").count() == 3000 - hot.select("text").distinct().count()


# --- 5 grouped splits ----------------------------------------------------------------------------


def test_components_against_union_find(spark):
    rnd = random.Random(5)
    for n, m in ((60, 40), (60, 90), (30, 200)):
        edges = [(f"n{rnd.randrange(n)}", f"n{rnd.randrange(n)}") for _ in range(m)] + [(f"n{i}", f"n{i + 1}") for i in range(100, 130)] + [("loop", "loop"), (None, "n1")]
        root: dict[str, str] = {}

        def find(x):
            root.setdefault(x, x)
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            if a:
                root[find(a)] = find(b)
        out = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
        assert set(out) == set(root)
        for a, b in itertools.combinations(out, 2):
            assert (out[a] == out[b]) == (find(a) == find(b))
        # The graph of labels searched like the first one, nothing broadcast, nothing solved in one task.
        again = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges[:60], "a string, b string"), small=0).collect()}
        part = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges[:60], "a string, b string")).collect()}
        assert again == part
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def fixture_records(spark):
    rec = [
        (1, " U1 ", "Текст  один"), (2, "u2", "вариант один"), (3, "u3", "текст два"), (4, None, "мост"), (5, "u4", "другой"), (6, "u5", "сам по себе"),
        (7, "", "текст ОДИН"), (8, "u6", None), (9, "u7", "край"), (10, "u1", "ещё запись"),
    ]
    aug = [
        (1, "текст один", ["вариант один", None]), (2, "текст два", None), (3, "вариант один", ["мост"]), (4, "мост", ["другой"]), (4, "мост", ["другой"]),
        (5, "край", ["без записи"]), (6, "без записи", ["сам по себе"]), (7, None, []),
    ]
    return (
        spark.createDataFrame(rec, "row_id long, user_id string, text string"),
        spark.createDataFrame(aug, "aug_id long, original_text string, variants array<string>"),
    )


def test_related_users(spark):
    rec, aug = fixture_records(spark)
    got = {tuple(r) for r in related_users(rec, aug).collect()}
    # u1-u2 by row 1, u2-u4 over a record without user; a text no record bears ties nothing.
    assert got == {("u1", "u2"), ("u1", "u4"), ("u2", "u4")}
    assert {tuple(r) for r in related_users(rec, aug, part=1).collect()} == got
    groups = user_groups(rec, aug).collect()
    assert len(groups) == len({r["user"] for r in groups}) and len({r["component"] for r in groups if r["user"] in ("u1", "u2", "u4")}) == 1
    assert related_users(rec.limit(0), aug).count() == 0 and related_users(rec, aug.limit(0)).count() == 0


def test_grouped_split(spark):
    rec, aug = fixture_records(spark)
    labels = spark.createDataFrame([(1, "a"), (6, "b")], "row_id long, label string")
    out = {r["row_id"]: (r["group"], r["split"]) for r in grouped_split(rec, aug, labels, proportions={"train": 0.5, "test": 0.5}, classes=("a", "b")).collect()}
    assert len(out) == 10 and len({out[i] for i in (1, 2, 4, 5, 7, 10)}) == 1 and len({g for g, _ in out.values()}) == 5
    many = spark.range(6000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 10 == 0, "hot").otherwise(F.concat(F.lit("u"), F.col("id") % 2500)).alias("user_id"), F.lit("x").alias("text"))
    lab = many.select("row_id", F.when(F.col("row_id") % 4 == 0, "a").otherwise("b").alias("label"))
    split = grouped_split(many, aug, lab, proportions={"train": 8, "validation": 1, "test": 1}, classes=("a", "b"))
    assert split.groupBy("group").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    share = {r["split"]: r["count"] / 6000 for r in split.groupBy("split").count().collect()}
    assert share == {"train": pytest.approx(0.8, abs=0.03), "validation": pytest.approx(0.1, abs=0.03), "test": pytest.approx(0.1, abs=0.03)}
    assert grouped_split(rec.limit(0), aug, labels, proportions={"a": 1}).count() == 0
    with pytest.raises(ValueError):
        grouped_split(rec, aug, labels, proportions={"a": 0})


# --- 6 capping -----------------------------------------------------------------------------------


def test_capping(spark):
    nan = float("nan")
    rows = [(i, "big" if i % 3 else None if i % 2 else "small", [0.5, nan, None, 2.0, -1.0, 0.9, 0.5][i % 7], "r") for i in range(700)]
    df = spark.createDataFrame(rows, "id long, domain string, confidence double, rank string")
    out = cap_contributors(df, contributor=F.col("domain"), score=valid_score(F.col("confidence")), tie="id", max_share="0.12")
    assert out.columns == df.columns
    by = defaultdict(list)
    for i, d, c, _ in rows:
        ok = c is not None and 0 <= c <= 1
        by[d].append((-c if ok else 1, i))
    want = {i for v in by.values() for _, i in sorted(v)[:84]}
    assert {r["id"] for r in out.collect()} == want
    cap = lambda d, **o: cap_contributors(d, contributor=F.col("domain"), score=F.col("confidence"), tie="id", **o).count()
    assert cap(df, max_rows=2) == 6 and cap(df, max_rows=0) == 0 and cap(df.limit(0), max_share="0.5") == 0
    assert cap(df.unionAll(df), max_rows=10**6) == 1400
    with pytest.raises(ValueError):
        cap(df)


# --- 8 encoding ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    return Encoder(*load_vocabulary(DEFAULT_VOCABULARY))


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_encoding_equals_library(encoder, reference, text):
    assert encoder(text) == reference(text)


def test_long_and_special_texts(encoder, reference):
    for text in ("a" * 20_000, "абв" * 5_000, "<|endoftext|> x", "aaaa aaa  \n\n \t x's", "=" * 3_333 + "🚰" * 777, "", None):
        assert encoder(text) == reference(text or "")


def test_rank_queue():
    q, rnd = RankQueue(50_000), random.Random(1)
    items = [(rnd.randrange(50_000), rnd.randrange(100)) for _ in range(3000)] + [(49_999, 1), (0, 5), (0, 3)]
    for x in items:
        q.push(*x)
    assert [q.pop() for _ in items] == sorted(items) and q.pop() is None


def test_encode_corpus(spark):
    df = spark.createDataFrame([(1, "Hello world", "i"), (2, None, "j"), (3, "", None), (1, "Hello world", "i")], "doc_id long, text string, ids string")
    out = encode_corpus(df, keep_cols=["doc_id"])
    assert sorted((r["doc_id"], r["ids"]) for r in out.collect()) == [(1, [15496, 995]), (1, [15496, 995]), (2, []), (3, [])]
    assert encode_corpus(df).columns == ["doc_id", "ids"] and encode_corpus(df.limit(0)).count() == 0


# --- 9 leakage -----------------------------------------------------------------------------------


@given(st.text("ab", min_size=1, max_size=8), st.text("abc", max_size=14))
def test_myers_against_table(pattern, text):
    row = [0] * (len(text) + 1)
    for p in pattern:
        new = [row[0] + 1]
        for j, c in enumerate(text):
            new.append(min(row[j] + (p != c), row[j + 1] + 1, new[j] + 1))
        row = new
    assert myers_distance(pattern, text) == min(row)


def test_leaks_against_brute_force(spark):
    rnd = random.Random(2)
    word = lambda: rnd.choice("аня боб вес год дом ёж жук зал игра кот лес мир нос".split())
    items = [(i, " ".join(word() for _ in range(14))) for i in range(30)] + [(50, None), (51, "мало слов"), (52, "借助临时拨款质检窗口清点余煤数量因此水文站依照")]
    docs = [(i, " ".join(word() for _ in range(40))) for i in range(60)]
    docs += [(100 + i, f"Начало: {t.upper().replace(' ', ', ').replace('Ё', 'Е')}! конец") for i, t in items[:5]]
    docs += [(200, "前言：借助 临时拨款，质检窗口清点余煤数量（因此）水文站。"), (201, "借助临时拨款质检窗口"), (202, None), (203, "")]
    found = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in found.where("distance = 0").collect()}
    grams = lambda t: {tuple(w[i : i + 8]) for w in [normal_words(t or "")] for i in range(len(w) - 7)}
    want = {(d, i) for d, t in docs for i, u in items if grams(t) & grams(u)} | {(200, 52)}
    assert got == want


def test_leaks_with_an_edit_and_blocks(spark):
    item = "сводная ведомость собирает редкие отзывы причём дежурный аналитик молчит"
    items = spark.createDataFrame([(1, item), (2, "совсем другой набор слов который нигде больше не встречается тут")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "и сводная ведомость собирает редкие отзывы причем дежурный аналитик"), (2, "сводная ведомость собирает редкие отзывы, притом дежурный аналитик"), (3, "ничего")], "doc_id long, text string")
    out = {(r["doc_id"], r["item_id"], r["distance"]) for r in find_leaks(docs, items, block_chars=60).collect()}
    assert (1, 1, 0) in out and len(out) == 1
    typo = spark.createDataFrame([(1, "сводная ведомость собирает редкие отзывы причём дежурнй аналитик")], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["distance"]) for r in find_leaks(typo, items).collect()] == [(1, 1, 1)]
    assert find_leaks(docs.limit(0), items).count() == 0 and find_leaks(docs, items.limit(0)).count() == 0


# --- 10 sentences --------------------------------------------------------------------------------


def corpus() -> list[list[str]]:
    rnd = random.Random(4)
    ru = ["Лифт опять стоит.", "Живу на ул. Кленовая, д. 7.", "Когда починят свет?", "Мастер Е. Г. Пыжов ушёл в 8.30.", "Нужны трубы, краны и т. д.", "Спасибо за помощь!", "Ну... не знаю, что сказать.", "Сколько можно ждать...",
          "«Где же мастер?» — спросили соседи.", "(Говорят, заменят.)", "Соседи снизу молчат."]
    en = ["Dr. Smith paid the fee.", "We need pipes, taps, etc.", "Is the lift closed again?!", "“Where is it?” the driver asked.", "The fee was 3.50 by approx. noon.", "Nobody told us.", "Please call back!"]
    zh = ["水泵什么时候修好？", "他说：“等等！马上就好。”然后挂了电话。", "收银员已经同意了。", "（听说要换电梯。）"]
    out = []
    for _ in range(260):
        s = rnd.choice([ru, ru, en, zh])
        out.append([rnd.choice(s) for _ in range(rnd.randint(2, 7))])
    return out


def test_sentences_held_out(spark):
    docs, rows, want = corpus(), [], set()
    rnd = random.Random(9)
    for i, parts in enumerate(docs):
        glue = rnd.choice(["\n", " ", " ", "\r\n"]) if parts[0].isascii() or ord(parts[0][0]) < 0x3000 else rnd.choice(["\n", ""])
        text, at = "", 0
        for p in parts:
            at = len(text)
            want.add((i, at, at + len(p)))
            text += p + glue
        rows.append((i, text, 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, start_pos int")
    got = {tuple(r) for r in sentences(df, id_col="doc_id").collect()}
    hit = len(got & want)
    assert hit / len(got) > 0.97 and hit / len(want) > 0.97


def test_sentence_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "Заголовок\n\nстрока без точки"), (5, "1) Первый пункт. Второй. \n2. Третий пункт"), (6, "ช่างตกลงแล้ว รอมา 7 วันแล้ว กรุณาโทร"), (None, "Да."), (7, "а" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = defaultdict(list)
    texts = dict(rows)
    for d, a, b in [tuple(r) for r in sentences(df, id_col="doc_id").collect()]:
        out[d].append(texts[d][a:b])
    assert set(out) == {4, 5, 6, 7, None}
    assert out[4] == ["Заголовок", "строка без точки"] and out[5][-1] == "2. Третий пункт" and out[5][0].startswith("1) Первый")
    assert out[6] == ["ช่างตกลงแล้ว", "รอมา 7 วันแล้ว", "กรุณาโทร"] and out[None] == ["Да."]
    assert sentences(df.limit(0), id_col="doc_id").count() == 0


def test_names_of_domains():
    assert DOMAINS[0] == "house"
