"""Labels, their aliases, the words that hint at them, and expressions over them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltwork.functions.text import DOMAINS, strip_ws

# Sub-strings (of the lower-cased text) that hint at a label.
KEYWORDS: dict[str, tuple[str, ...]] = {
    "house": (
        "показан", "водосч", "счетчик", "счётчик", "электр", "квитанц", "жкх", "тариф", "оплат", "передать показания",
        "передай показания", "воды", "джу", "дж у", "джуу", "дж уу",
    ),
    "utilizer": (
        "утилиз", "забер", "вывоз", "мебел", "шкаф", "диван", "холодильн", "стар", "заберите", "забрать", "перевезти",
        "утилизация", "телевизор",
    ),
    "okc": (
        "метро", "станц", "перекрыт", "расписан", "транспорт", "закрыт", "поезд", "маршрут", "работает ли", "новость", "инфо",
        "график", "сколько", "как работает", "где найти", "что такое", "как получить", "стоимост", "цена", "тариф", "расскажи",
        "объясни", "подскажи",
    ),
    "payments": (
        "оплат", "пополн", "внести", "заплат", "перевест", "доплат", "карт", "питан", "школ", "детск", "сад", "кружок", "секци",
        "баланс", "счет", "деньги", "руб", "оплачу", "заплачу",
    ),
    "boltalka": ("шутк", "расскажи", "привет", "пока", "как дела", "анекдот", "поговорим", "спасибо", "не смешно", "тест"),
}
# Texts that are not classified.
STOP_WORDS = (
    "хватит", "перестань", "достаточно", "стоп", "прекрати", "остановись", "хватит уже", "перестаньте", "прекратите",
)


def or_chain(*cols: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def normalise_label(c: Column) -> Column:
    """Stripped and lower-cased label; null and empty give ``oos``."""
    return F.when(c.isNull() | (c == ""), F.lit("oos")).otherwise(F.lower(strip_ws(c)))


def validate_domain(c: Column) -> Column:
    """The label if it is canonical once normalised, else ``oos``."""
    label = normalise_label(c)
    return F.when(label.isin(*DOMAINS), label).otherwise(F.lit("oos"))


def is_stop_word(text: Column) -> Column:
    """Whether the whole text, trimmed and lower-cased, is a stop word; null is none."""
    return F.coalesce(F.lower(strip_ws(text)).isin(*STOP_WORDS), F.lit(False))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def keyword_hits(text: Column, keywords: dict[str, tuple[str, ...]] = KEYWORDS) -> Column:
    """Array of (hits, -order, label), best first, of the labels with any keyword in the text."""

    def rows(low: Column) -> Column:
        found = [
            F.struct(
                reduce(lambda a, b: a + b, [low.contains(w).cast("int") for w in words]).alias("hits"),
                F.lit(-i).alias("turn"), F.lit(label).alias("label"),
            )
            for i, (label, words) in enumerate(keywords.items())
        ]
        return F.sort_array(F.filter(F.array(*found), lambda x: x["hits"] > 0), asc=False)

    return let(F.lower(text), rows)


def decided_label(hits: Column) -> Column:
    """The only label hit, or the best with at least two hits and more than twice those of the
    second; else null."""
    top, second = F.get(hits, F.lit(0)), F.get(hits, F.lit(1))
    return F.when(F.size(hits) == 1, top["label"]).when(
        (top["hits"] >= 2) & (top["hits"] > 2 * second["hits"]), top["label"]
    )


def rule_label(text: Column, keywords: dict[str, tuple[str, ...]] = KEYWORDS) -> Column:
    """The label that the keywords of a text decide, or null."""
    return let(keyword_hits(text, keywords), decided_label)


def soft_candidates(text: Column, k: int = 5, include_oos: bool = True) -> Column:
    """Up to ``k`` labels as hints: by hits, then all others in canonical order; a blank text and
    one without any hit give the whole canonical list."""
    every = F.array(*[F.lit(x) for x in DOMAINS if include_oos or x != "oos"])

    def ranked(hits: Column) -> Column:
        labels = F.transform(hits, lambda x: x["label"])
        return F.when(F.size(labels) == 0, every).otherwise(F.slice(F.concat(labels, F.array_except(every, labels)), 1, k))

    return F.coalesce(let(keyword_hits(text), ranked), every)
