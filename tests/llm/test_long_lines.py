from __future__ import annotations

import time

import pytest

from siltwork.llm.sentences import Model, _pairs, candidates, split_sentences


def test_outermost_spans():
    line = "a «b (c) d» e (f “g) h” \"i\" j) (k"
    spans = list(zip(*_pairs(line)))
    assert [line[a : b + 1] for a, b in spans] == ["«b (c) d»", "(f “g)", '"i"']


def test_words_around_a_candidate():
    (c,) = candidates("Живу на ул. Кленовой")
    assert (c.before, c.earlier, c.after, c.mark, c.spaced) == ("ул", "на", "Кленовой", ".", True)
    assert [c.before for c in candidates("水泵什么时候修好？他说等等。走")] == ["修好", "等等"]
    assert candidates("1) Первый") == [] and candidates("  Всё.  ") == []


@pytest.mark.parametrize("unit", ["Вот так. ", "“Да. ", "а.Б", "(x. ", "« ", "что ", "?!", ". "])
def test_a_long_line_takes_linear_time(unit):
    model = Model().fit([[1, 2]], [1])

    def took(n):
        began = time.process_time()
        split_sentences(unit * (n // len(unit)), model)
        return time.process_time() - began

    took(10_000)
    assert took(300_000) < 40 * max(took(30_000), 0.01)
