"""Sentence boundaries across languages and scripts, by a maximum-entropy classifier.

Candidates are runs of sentence marks with their closing quotes and brackets. What happens at
line breaks is certain, and gives statistics of the whole corpus: words that end lines, words
that begin them, and words that never do though a full stop follows or precedes them. Candidates
that these statistics and letter case make certain train a logistic model on neighbouring words,
case, length, digits and script; each is used twice, once without case, so that the model also
decides texts in lower case. The model then classifies every candidate of every text.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LINES = re.compile(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
_MARKS = re.compile(r"[.!?…。．！？؟।॥۔]+")
_FULL = "。．！？"
# Opening quotes and brackets and what closes them.
_CLOSE = {"“": "”", "„": "“", "«": "»", "‹": "›", "(": ")", "（": "）", "[": "]", "「": "」", "『": "』", "【": "】", "《": "》", "〈": "〉"}
_CLOSERS = set(_CLOSE.values()) | {"”", '"', "’", "'"}
_BRACKETS = set(")）]】")
_LIST_NUMBER = re.compile(r"\s*(?:\(?\d{1,3}|[^\W\d_])[.)]$")
_THAI = re.compile(r"[฀-๿]")
_SPACES = re.compile(r"\s+")
_BITS = 16


def _script(c: str) -> str:
    o = ord(c)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "L"
    if 0x400 <= o < 0x530:
        return "C"
    if 0x3040 <= o < 0x3100 or 0x3400 <= o < 0xA000 or 0x20000 <= o < 0x32000:
        return "H"
    return str(o >> 7)


@dataclass(slots=True)
class Candidate:
    """A place (``end``) where a sentence of a line may end."""

    mark: str
    end: int
    before: str
    earlier: str
    after: str
    closer: str
    spaced: bool


_QUOTES = re.compile("[“”„«»‹›()（）[\\]「」『』【】《》〈〉\"]")


def _pairs(line: str) -> tuple[list[int], list[int]]:
    """Begins and ends of the outermost quoted and bracketed spans of a line; what is never closed
    is no span."""
    stack: list[tuple[str, int]] = []  # closing mark that is waited for, place of the opening one
    waiting: Counter = Counter()
    spans: list[tuple[int, int]] = []
    for m in _QUOTES.finditer(line):
        c, i = m.group(), m.start()
        if waiting[c]:
            while True:
                mark, begin = stack.pop()
                waiting[mark] -= 1
                if mark == c:
                    break
            while spans and spans[-1][0] > begin:
                spans.pop()
            spans.append((begin, i))
        elif c == '"' or c in _CLOSE:
            mark = _CLOSE.get(c, c)
            stack.append((mark, i))
            waiting[mark] += 1
    return [x for x, _ in spans], [x for _, x in spans]


#: Of a longer word the features know only as many characters, from its end (before a mark) or its
#: beginning (after it); so a line without white space is no burden.
WORD = 40


def _word_before(line: str, at: int) -> tuple[int, str]:
    """The run without white space that ends at ``at``, without opening marks; its start."""
    near = line[max(0, at - WORD) : at]
    if not near or near[-1].isspace():
        return at, ""
    i = at - min(len(near.rsplit(None, 1)[-1]), 2 if _script(near[-1]) == "H" else WORD)
    return i, line[i:at].lstrip("«“„(\"'¿¡（「『[")


def _back(line: str, at: int) -> int:
    """The end of the last visible character before ``at``, 0 if there is none."""
    while at > 0:
        near = line[max(0, at - 64) : at]
        seen = len(near.rstrip())
        at -= len(near) - seen
        if seen:
            break
    return at


def _on(line: str, at: int) -> int:
    """The place of the first visible character from ``at`` on."""
    while at < len(line):
        near = line[at : at + 64]
        seen = len(near.lstrip())
        at += len(near) - seen
        if seen:
            break
    return at


def candidates(line: str) -> list[Candidate]:
    """Places within a line (its end apart) where a sentence may end."""
    out: list[Candidate] = []
    n, full = len(line), len(line.rstrip())
    lead = n - len(line.lstrip())
    pairs: tuple[list[int], list[int]] | None = None
    for m in _MARKS.finditer(line):
        a, e = m.span()
        closer = ""
        if pairs is None:
            pairs = _pairs(line)
        at = bisect.bisect_left(pairs[0], a) - 1
        last = pairs[1][at] if at >= 0 and a < pairs[1][at] else -1
        while e < n and line[e] in _CLOSERS and (last < 0 or e <= last):
            closer = line[e]
            e += 1
        if e <= last or e >= full:
            continue
        mark = m.group()
        spaced = line[e].isspace()
        if not spaced:
            if mark[-1] not in _FULL and not (mark[-1] == "…" and _script(line[e]) == "H"):
                lower_before = a > 1 and line[a - 1].islower() and line[a - 2].isalpha() or (a and line[a - 1] in _CLOSERS)
                starts = line[e].isupper() or line[e] in "«“„¿¡("
                if not (starts and (lower_before or mark[-1] in "!?…؟।")) and not (mark[-1] in "!?؟।" and line[e].isalpha()):
                    continue
        if e - lead <= 5 and _LIST_NUMBER.fullmatch(line[lead:e]):
            continue
        begin, before = _word_before(line, a)
        earlier = _word_before(line, _back(line, begin))[1]
        k = _on(line, e) if spaced else e
        rest = line[k : k + WORD]
        word = rest[:2] if _script(rest[:1] or " ") == "H" else _SPACES.split(rest, maxsplit=1)[0]
        out.append(Candidate(mark, e, before, earlier, word, closer, spaced))
    return out


def _first(word: str) -> str:
    """The kind of the first letter or digit of a word."""
    for c in word[:4]:
        if c.isupper():
            return "U"
        if c.islower():
            return "l"
        if c.isdigit():
            return "9"
        if c.isalpha():
            return "x"
    return "p"


def _plain(word: str) -> str:
    """A word as the statistics know it: lower case, bare of outer marks; numbers are alike."""
    word = word.lower().strip("«»“”„\"'()（）「」[]¿¡,;:")
    return "#" if word[:1].isdigit() or word[-1:].isdigit() else word


def feature_names(c: Candidate, cased: bool) -> list[str]:
    """Features; without ``cased`` nothing tells capitals from small letters."""
    before, earlier, after = _plain(c.before), _plain(c.earlier), _plain(c.after)
    mark = "…" if c.mark in ("...", "…", "……", "..") else c.mark[-1]
    first = _first(c.after)
    if first == "l" or (first == "U" and not cased):
        first = "l" if cased else "c"
    near = (c.before[-1:] or " ", c.after[:1] or " ")
    single = len(before) == 1 and before.isalpha()
    shape = "I" if single and (not cased or c.before[-1:].isupper()) else "i" if single else str(min(6, len(before)))
    return [
        "b", f"m{mark}", f"p{mark}{before}", f"q{mark}{earlier} {before}", f"n{mark}{after}", f"f{mark}{first}",
        f"l{mark}{shape}", f"o{mark}{'.' in before}", f"c{mark}{c.closer}", f"cf{c.closer}{first}", f"s{mark}{_script(near[0])}{_script(near[1])}",
        f"w{mark}{c.spaced}{first}", f"pf{mark}{before}{first}", f"sf{mark}{shape}{first}", f"#{mark}{before == '#'}{after}", f"k{len(c.mark)}{mark}{first}",
    ]


def _code(name: str) -> int:
    return zlib.crc32(name.encode()) & ((1 << _BITS) - 1)


def features(c: Candidate, cased: bool) -> list[int]:
    """Hashed features."""
    return [_code(x) for x in feature_names(c, cased)]


_START = re.compile(r"(?:^\s*(?:\(?\d{1,3}[.)]\s*)?(?:[^\W\d_][\w-]{1,20}:\s+)?|[!?]\s+)[«“„¿¡(\"]*([^\W\d_])")


def is_lower(text: str) -> bool:
    """Whether sentences begin with small letters here: most first letters of lines (after list
    number and speaker) and after exclamation and question marks are small."""
    small = large = 0
    for line in _LINES.split(text):
        for c in _START.findall(line):
            small += c.islower()
            large += c.isupper()
    return small > large


def line_statistics(text: str) -> Counter:
    """What lines tell: (kind, word) counts.

    ``e``: a full stop after the word ends a line; ``i``: it is followed by more; ``b``: the word
    begins a line; ``a``: it comes after a sentence mark within a line.
    """
    out: Counter = Counter()
    for line in _LINES.split(text):
        words = line.split()
        if len(words) < 2:
            continue
        last = words[-1].rstrip("»”\")）")
        if last.endswith(".") and not last.endswith(".."):
            out["e", _plain(last[:-1])] += 1
        out["b", _plain(words[0])] += 1
        for x, y in zip(words, words[1:]):
            if x[-1] in ".!?…»”\")":
                out["a", _plain(y)] += 1
                if x[-1] == "." and not x.endswith(".."):
                    out["i", _plain(x[:-1])] += 1
    return out


@dataclass
class Statistics:
    """Corpus counts of ``line_statistics``, of words frequent enough to tell anything."""

    counts: dict[tuple[str, str], int] = field(default_factory=dict)

    def ends(self, word: str) -> float | None:
        """Share of its full stops that end a line; None if the word is too rare."""
        e, i = self.counts.get(("e", word), 0), self.counts.get(("i", word), 0)
        return e / (e + i) if e + i >= 12 else None

    def begins(self, word: str) -> float | None:
        """How often it begins lines against how often it follows marks within lines."""
        b, a = self.counts.get(("b", word), 0), self.counts.get(("a", word), 0)
        return b / (a + b) if a + b >= 12 else None


def certain(c: Candidate, lower: bool, stats: Statistics) -> int | None:
    """1 or 0 where a candidate is certainly (no) boundary, else None."""
    first = _first(c.after)
    if c.mark[-1] in _FULL or (c.mark[-1] == "…" and not c.spaced and first == "x"):
        if c.closer and c.closer not in _BRACKETS:
            return 0
        return 0 if c.mark[-1] == "…" else 1
    if c.mark[-1] in "।॥؟۔":
        return 0 if c.closer and c.closer not in _BRACKETS else 1
    if first == "l" and not lower:
        return 0
    begins = stats.begins(_plain(c.after))
    if c.mark[-1] in "!?":
        if c.closer and c.closer not in _BRACKETS and first in "xlp":
            return 0
        return 1 if first in "Ux" and not lower else None
    starts = first == "x" or (first == "U" and not lower)  # a capital, or a script without capitals
    if c.mark != ".":
        return 1 if starts and (begins or 0) > 0.02 else None
    if c.closer in _BRACKETS:
        return 1 if starts else None
    before, earlier = _plain(c.before), _plain(c.earlier)
    if first in "9" and len(before) <= 5 and (stats.ends(before) or 0) < 0.01:
        return 0
    if len(before) == 1 and before.isalpha():
        if c.before[-1:].isupper():
            return 0
        ends = stats.ends(before)
        if len(earlier.rstrip(".")) == 1 and earlier.rstrip(".").isalpha() and first == "U" and (ends or 0) > 0.02:
            return 1
    if begins is not None and begins < 0.002:
        return 0
    ends = stats.ends(before)
    if ends is None:
        return 1 if starts and len(before) > 5 and (begins or 0) > 0.05 else None
    if ends < 0.004:
        return 0
    return 1 if ends > 0.03 and starts and (begins is None or begins > 0.02) else None


class Model:
    """Logistic (two-class maximum-entropy) model on hashed features."""

    def __init__(self) -> None:
        self.weights = np.zeros(1 << _BITS)
        #: Weights by name, and decisions by candidate, as they are asked for.
        self.known: dict[str, float] = {}
        self.decided: dict[tuple, bool] = {}

    def fit(self, rows: list[list[int]], labels: list[int], rounds: int = 150, rate: float = 0.5, decay: float = 1e-6) -> Model:
        """Full-batch gradient steps with a rate for each weight; equal rows count by number."""
        if not rows:
            self.weights[zlib.crc32(b"b") & ((1 << _BITS) - 1)] = 1.0
            return self
        merged = Counter((tuple(r), y) for r, y in zip(rows, labels))
        x = np.array([r for r, _ in merged], np.int64)
        y = np.array([v for _, v in merged], float)
        n = np.sqrt(np.array(list(merged.values()), float))
        total, seen = n.sum(), np.full(1 << _BITS, 1e-8)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-self.weights[x].sum(1)))
            g = np.bincount(x.ravel(), np.repeat(n * (p - y), x.shape[1]), 1 << _BITS) / total + decay * self.weights
            seen += g * g
            self.weights -= rate * g / np.sqrt(seen)
        return self

    def decides(self, c: Candidate, cased: bool) -> bool:
        """Whether a candidate is a boundary; words in the same company are met again and again."""
        key = (c.mark, c.before, c.earlier, c.after, c.closer, c.spaced, cased)
        found = self.decided.get(key)
        if found is None:
            if len(self.decided) > 200_000:
                self.decided.clear()
            found = self.decided[key] = self.is_boundary(feature_names(c, cased))
        return found

    def is_boundary(self, names: list[str]) -> bool:
        """Whether the features speak for a boundary."""
        known, total = self.known, 0.0
        for x in names:
            w = known.get(x)
            if w is None:
                if len(known) > 200_000:
                    known.clear()
                w = known[x] = float(self.weights[_code(x)])
            total += w
        return total > 0


def training_rows(texts: list[str], stats: Statistics) -> tuple[list[list[int]], list[int]]:
    """Features of the certain candidates of some texts, with and without case, and labels."""
    rows, labels = [], []
    for text in texts:
        lower = is_lower(text)
        for line in _LINES.split(text):
            for c in candidates(line):
                y = certain(c, lower, stats)
                if y is not None:
                    rows += [features(c, not lower), features(c, False)]
                    labels += [y, y]
    return rows, labels


def split_sentences(text: str | None, model: Model) -> list[tuple[int, int]]:
    """(start, end) of each sentence in code points, without white space at either end.

    Null, empty and blank texts have none. A line break always ends a sentence. In Thai a space
    does, unless a numeral stands next to it.
    """
    out: list[tuple[int, int]] = []
    if not text:
        return out
    lower = is_lower(text)

    def add(a: int, b: int) -> None:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))

    begin = 0
    for m in [*_LINES.finditer(text), None]:
        end = m.start() if m else len(text)
        line = text[begin:end]
        if line.strip():
            cuts = {c.end for c in candidates(line) if model.decides(c, not lower)}
            if _THAI.search(line):
                for s in _SPACES.finditer(line):
                    left, right = line[s.start() - 1 : s.start()], line[s.end() : s.end() + 1]
                    thai = _THAI.match(left) or _THAI.match(right)
                    if thai and not (left.isnumeric() or right.isnumeric()):
                        cuts.add(s.start())
            at = 0
            for cut in sorted(cuts):
                add(begin + at, begin + cut)
                at = cut
            add(begin + at, end)
        begin = m.end() if m else end
    return out


# --- Operators --------------------------------------------------------------------------------


def corpus_statistics(texts: DataFrame, words: Iterable[str] | None = None) -> Statistics:
    """Line statistics of the column ``t`` over all rows: exact counts of all words, or of ``words``
    in every kind. What reaches the driver is these, however large the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total: Counter = Counter()
            for t in b.column(0):
                total.update(line_statistics(t.as_py()))
            keys = list(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in keys], pa.string()), pa.array([w for _, w in keys], pa.string()), pa.array([total[k] for k in keys], pa.int64())],
                names=["kind", "word", "n"],
            )

    counts = texts.select("t").mapInArrow(run, "kind string, word string, n long")
    if words is not None:
        wanted = texts.sparkSession.createDataFrame(pa.table({"word": pa.array(sorted(words), pa.string())}))
        counts = counts.join(F.broadcast(wanted), "word", "left_semi")
    rows = counts.groupBy("kind", "word").agg(F.sum("n").alias("n")).collect()
    return Statistics({(r["kind"], r["word"]): r["n"] for r in rows})


def sample_words(texts: list[str]) -> set[str]:
    """The words whose statistics ``certain`` asks for in some texts."""
    return {_plain(w) for t in texts for line in _LINES.split(t) for c in candidates(line) for w in (c.after, c.before)}


def fit_model(texts: DataFrame, *, sample_rows: int = 4000, sample_chars: int = 20_000) -> Model:
    """The classifier, from the ``sample_rows`` texts of least hash that have up to ``sample_chars``
    characters. This bound is for training alone; the words of these texts are counted over every
    text, and splitting covers every text whole.
    """
    rows = texts.where(F.length("t") <= sample_chars).orderBy(F.xxhash64("t"), "t").limit(sample_rows).select("t").collect()
    chosen = [r["t"] for r in rows]
    return Model().fit(*training_rows(chosen, corpus_statistics(texts, sample_words(chosen))))


def sentences(df: DataFrame, *, id_col: str, text_col: str = "text", sample_rows: int = 4000, sample_chars: int = 20_000) -> DataFrame:
    """``id_col``, ``start_pos``, ``end_pos``: a row for each sentence of each text.

    The classifier is trained on at most ``sample_rows`` texts of at most ``sample_chars`` characters.

    Null, empty and blank texts have no row; repeated rows each have theirs; null ids are passed
    on; an empty table gives an empty table; other columns don't matter.
    """
    source = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t")).where("t IS NOT NULL AND t <> ''")
    model = fit_model(source, sample_rows=sample_rows, sample_chars=sample_chars)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, starts, ends = [], [], []
            for i, t in enumerate(b.column(1)):
                for s, e in split_sentences(t.as_py(), shared.value):
                    row.append(i)
                    starts.append(s)
                    ends.append(e)
            ids = b.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=[id_col, "start_pos", "end_pos"])

    return source.mapInArrow(run, f"`{id_col}` {kind}, start_pos long, end_pos long")
