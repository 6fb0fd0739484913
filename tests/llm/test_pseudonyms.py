from __future__ import annotations

import datetime
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltwork.llm import personal_data as pd_

KEY = b"a key"
ten = st.text("0123456789", min_size=10, max_size=10)


@pytest.mark.parametrize(
    ("kind", "spellings"),
    [
        ("phone", ("+7 912 345-67-89", "8 912 345 67 89", "8(912)3456789", "79123456789", "+ 7 (912) 345-67-89")),
        ("phone", ("(202) 555-0185", "202-555-0185", "+1 202 555 0185", "2025550185")),
        ("phone", ("+49 30 23125 253", "+4930 23125253")),
        ("id_number", ("009-031-027 93", "00903102793", "009 031 027 93")),
        ("id_number", ("ab 1234567", "AB1234567")),
        ("date", ("12.03.1985", "12/03/1985", "1985-03-12", "12 марта 1985")),
        ("email", ("Zoya@pochta.example", "zoya(at)pochta(dot)example", "zoya собака pochta точка example")),
        ("name", ("Овсюговская Анна Олеговна", "АННЫ ОЛЕГОВНЫ ОВСЮГОВСКОЙ", "анной олеговной овсюговской")),
        ("name", ("Павел Уваренцев", "Павла Уваренцева", "Павлом Уваренцевым")),
        ("address", ("ул. Кленовая, д. 7, кв. 5", "улице Кленовой дом 7 квартира 5", "УЛ КЛЕНОВАЯ 7 КВ 5")),
    ],
)
def test_spellings_are_linked(kind, spellings):
    assert len({pd_.pseudonym(s, kind, KEY) for s in spellings}) == 1
    assert pd_.pseudonym(spellings[0], kind, KEY) != pd_.pseudonym(spellings[0], kind, b"another key")


@settings(max_examples=300, deadline=None)
@given(st.text("0123456789", min_size=5, max_size=18), st.sampled_from(["", "+", "A", "QZ"]))
def test_every_number_comes_back(digits, head):
    kind = "phone" if head in ("", "+") else "id_number"
    number = pd_.canonical_number(head + digits, kind)
    new = pd_.permute_value(number, kind, KEY)
    assert len(new) == len(number) and new[:1].isalpha() == number[:1].isalpha() and new.startswith("+") == number.startswith("+")
    assert pd_.permute_value(new, kind, KEY, inverse=True) == number
    shown = f"x [{kind} {pd_.pretty(new, kind)}] y"
    assert pd_.restore(shown, KEY) == f"x {pd_.pretty(number, kind)} y"


@settings(max_examples=300, deadline=None)
@given(st.sampled_from([9, 10, 11, 12, 16]), st.data())
def test_checked_and_unchecked_numbers_stay_apart(size, data):
    digits = data.draw(st.text("0123456789", min_size=size, max_size=size))
    new = pd_.permute_number(digits, KEY, "id_number")
    assert len(new) == size and pd_.is_checked(new) == pd_.is_checked(digits)
    assert pd_.permute_number(new, KEY, "id_number", inverse=True) == digits


def test_formats_are_permuted_within_themselves():
    assert sorted(pd_.permute_lettered(f"{c}{i}", KEY) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for i in range(10)) == sorted(f"{c}{i}" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for i in range(10))
    days = [datetime.date(1985, 1, 1) + datetime.timedelta(i) for i in range(500)]
    new = [pd_.permute_value(d.isoformat(), "date", KEY) for d in days]
    assert len(set(new)) == 500 and [pd_.permute_value(x, "date", KEY, inverse=True) for x in new] == [d.isoformat() for d in days]
    phones = ["+1" + "2025550185", "+7" + "9123456789", "+4930231252", "+71234", "+0123"]
    for p in phones:
        q = pd_.permute_value(p, "phone", KEY)
        assert pd_.permute_value(q, "phone", KEY, inverse=True) == p and q[:2] == p[:2] or p[1] not in "17" or p == "+71234"


def test_nothing_stays_in_clear():
    text = "тел. +7 912 345-67-89, passport AB 1234567, родилась 12.03.1985, СНИЛС 009-031-027 93, Анна Олеговна, a@b.example, ул. Кленовая, д. 7"
    new = pd_.redact(text, KEY)
    assert not re.search(r"912|345|AB ?1|1985|009-031|Анна|@|Кленовая", new) and new.count("[") == 7
    assert len(re.search(r"\[name ([0-9a-f]+)\]", new).group(1)) == 32
    assert "1985-03-12" in pd_.restore(new, KEY) and "009-031-027 93" in pd_.restore(new, KEY)
    assert pd_.redact("оплатил 12.03.2024, счёт 409383221384", KEY) == "оплатил 12.03.2024, счёт 409383221384"
    assert pd_.redact("родился 31.02.1985", KEY) == "родился 31.02.1985"


def test_check_digits_decide_where_no_word_does():
    kinds = lambda t: [k for _, _, k in pd_.find_personal(t)]
    assert kinds("номер 009-031-027 93") == ["id_number"] and kinds("номер 009-031-027 94") == []
    assert kinds("СНИЛС 009-031-027 94") == ["id_number"]


@pytest.mark.parametrize("unit", ["12 ab ", "1 b street ", "x@a.", "Анна Олеговна, ", "8 912 345 67 89; ", "а-", "%%%%", "улица ", "а" * 50 + " ", "А. "])
def test_long_lines_take_linear_time(unit):
    def took(n):
        text = (unit * (n // len(unit) + 1))[:n]
        began = time.process_time()
        pd_.find_personal(text, dates=True)
        return time.process_time() - began

    took(20_000)
    assert took(400_000) < 40 * max(took(40_000), 0.01)


@pytest.mark.parametrize("key", [b"", b"x" * 65])
def test_unfit_keys(spark, key):
    with pytest.raises(ValueError):
        pd_.redact_texts(spark.createDataFrame([(1, "x")], "k long, text string"), key=key, id_col="k")
