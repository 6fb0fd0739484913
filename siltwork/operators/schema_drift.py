"""Schemas that drift between files: a consistent table, and every change, by similarity flooding.

Lines are brought together by file (a hot file in several parts), and every field of every file
becomes a profile of bounded size: how often each type, and a hashed histogram of words, shapes,
magnitudes, lengths and nested keys of its values. Two consecutive files of a feed are two schema
graphs: containers, fields, nested keys, names, types and values are nodes, with labelled edges
between them. In the pairwise connectivity graph only pairs of literals (names, types, value
buckets) have a score to begin with; pairs of fields, keys and containers have none, and get
theirs from what flows along the edges until it settles. The best consistent pairs of a field that
vanished and one that appeared are renames. The same flooding over the names of all files ties
names of one meaning together in the table.
"""

from __future__ import annotations

import functools
import json
import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltwork.operators.ranking import ranked_within
from siltwork.session import bounded_broadcast, materialised

TYPES = ("string", "integer", "number", "boolean", "array", "object")
_YES_NO = {"true", "false", "yes", "no", "y", "n", "да", "нет", "0", "1"}
_YES = {"true", "yes", "y", "да", "1"}
#: Half of a surrogate pair, perhaps without the other one.
_HALF = re.compile(r"\\u[dD][89a-fA-F]")
#: Last characters of text that may read as a boolean or a number.
_ENDS = set("0123456789") | {c for x in _YES_NO for c in (x[-1], x[-1].upper())} | set(" \t\r\n\xa0")
_WORD = re.compile(r"[^\W\d_]{2,}")
_NUMBER = re.compile(r"\d+(?:\.\d+)?")
_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")
_INTEGER = re.compile(r"-?(?:0|[1-9][0-9]{0,17})")
_DECIMAL = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?")
_BUCKETS = 64
#: Feature of metadata that is no object; no histogram begins like this.
_PLAIN = "x:plain"
#: Stands for the file of lines without one.
_NO_FILE = -(2**63)
#: Lines of one file whose values are held at once.
_HELD = 20_000


def type_name(value: object) -> str:
    """The JSON type of a value that is not null."""
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "integer"
    if isinstance(value, float):
        return "number"
    return "string" if isinstance(value, str) else "array" if isinstance(value, list) else "object"


def clean_name(name: str) -> str:
    """A field's name, trimmed and in lower case."""
    return name.strip().lower()


def _leaves(value: object) -> Iterable[object]:
    if isinstance(value, dict):
        for v in value.values():
            yield from _leaves(v)
    elif isinstance(value, list):
        for v in value:
            yield from _leaves(v)
    elif value is not None:
        yield value


def _by_type(values: list) -> dict[str, list]:
    out: dict[str, list] = defaultdict(list)
    for kind in set(map(type, values)):
        out[type_name(kind())] += [v for v in values if type(v) is kind]
    return out


def _text(leaf: object) -> str:
    return leaf.lower() if isinstance(leaf, str) else "true" if leaf is True else "false" if leaf is False else str(leaf).lower()


@functools.lru_cache(maxsize=100_000)
def _bucket(kind: str, what: str) -> str:
    return f"{kind}{zlib.crc32(what.encode('utf-8', 'surrogatepass')) % _BUCKETS}"


def as_boolean(value: object) -> bool | None:
    """What a value says as a boolean, else None."""
    if isinstance(value, bool):
        return value
    text = value.strip().lower() if isinstance(value, str) else str(value) if isinstance(value, int) else ""
    return text in _YES if text in _YES_NO else None


def as_integer(value: object) -> int | None:
    """What a value says as an integer of 64 bits, else None; text only in the plain notation."""
    if isinstance(value, str) and _INTEGER.fullmatch(value):
        value = int(value)
    ok = isinstance(value, int) and not isinstance(value, bool) and -(2**63) <= value < 2**63
    return value if ok else None


def as_number(value: object) -> float | None:
    """What a value says as a number, else None; integers only where a double holds them exactly."""
    if isinstance(value, str) and len(value) <= 300 and _DECIMAL.fullmatch(value):
        return float(value)
    if isinstance(value, float):
        return value
    exact = isinstance(value, int) and not isinstance(value, bool) and abs(value) <= 2**53
    return float(value) if exact else None


def field_features(values: list) -> dict[str, float]:
    """Profile of the values of a field (none of them null), additive over parts of its lines.

    ``t:`` types, ``v:`` values that read as boolean, integer or number, ``k:`` nested keys and
    ``kt:`` their types; ``w n s l b c``: words, magnitudes, shapes, lengths, yes/no and number of
    leaves, each with the number of leaves (values) as its weight in all. Values are read whole.
    """
    out: dict[str, float] = defaultdict(float)
    texts: list[str] = []
    for kind, found in _by_type(values).items():
        out["t:" + kind] += len(found)
        if kind == "array" or kind == "object":
            for value in found:
                if kind == "object":
                    for k, v in value.items():
                        k = clean_name(k)
                        out["k:" + k] += 1 / len(value)
                        if v is not None:
                            out[f"kt:{type_name(v)}:{k}"] += 1 / len(value)
                leaves = [_text(x) for x in _leaves(value)]
                texts += leaves
                out["c" + str(min(6, len(leaves)))] += 1
            continue
        out["c1"] += len(found)
        texts += [x.lower() for x in found] if kind == "string" else map(_text, found)
        short = [x for x in found if len(x) <= 300 and (x[-1:] in _ENDS)] if kind == "string" else found
        for reading, read in (("boolean", as_boolean), ("integer", as_integer), ("number", as_number)):
            out["v:" + reading] += sum(read(x) is not None for x in short)
    if not texts:
        return dict(out)
    # One search over all values: neither words nor numbers reach across the separator.
    joined = "\x1f".join(texts)
    if joined.count("\x1f") != len(texts) - 1:
        joined = "\x1f".join(t.replace("\x1f", " ") for t in texts)
    shapes = Counter(_LETTERS.sub("a", _DIGITS.sub("9", joined)).split("\x1f"))
    for shape, n in shapes.items():
        out[_bucket("s", shape)] += n
    for kind, found, none, weigh in (
        ("w", _WORD.findall(joined), sum(n for s, n in shapes.items() if "a" not in s), lambda w: _bucket("w", w)),
        ("n", _NUMBER.findall(joined), sum(n for s, n in shapes.items() if "9" not in s), _magnitude),
    ):
        if found:
            share = (len(texts) - none) / len(found)
            for what, n in Counter(found).items():
                out[weigh(what)] += n * share
        out[kind + "-"] += none
    for size, n in Counter(map(len, texts)).items():
        out[f"l{min(9, size.bit_length())}"] += n
    yes_no = sum(map(_YES_NO.__contains__, texts))
    out["b1"] += yes_no
    out["b0"] += len(texts) - yes_no
    return {k: n for k, n in out.items() if n}


@functools.lru_cache(maxsize=100_000)
def _magnitude(number: str) -> str:
    x = float(number)
    return f"n{max(-3, min(18, math.floor(2 * math.log10(min(x, 1e9)) if x > 0 else -3)))}"


def value_features(value: object) -> dict[str, float]:
    """The features of one value."""
    return field_features([value])


def opened(value: object) -> dict | None:
    """The object that a value is or, as text, holds; else None."""
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return None
    return value if isinstance(value, dict) else None


def _json_text(value: object) -> str:
    """A value as JSON; half a surrogate pair, which no text can hold, as a question mark."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def parse_line(payload: str | None) -> dict[str, object] | None:
    """Fields of a line by path (``x``, ``metadata.x``), or null if it is no readable object."""
    try:
        record = json.loads(payload) if payload else None
    except (ValueError, RecursionError):
        return None
    if not isinstance(record, dict):
        return None
    if _HALF.search(payload):
        record = json.loads(_json_text(record))
    out: dict[str, object] = {}
    for name, value in record.items():
        key = clean_name(name)
        if value is not None:
            out[key] = value
        if key == "metadata":
            inner = opened(value)
            if inner is not None:
                out.update({f"metadata.{clean_name(k)}": v for k, v in inner.items() if v is not None})
    return out


# --- Profiles of fields -----------------------------------------------------------------------

_PROFILE = "file_id long, field string, profile map<string,double>"


def _profile_rows(rows: list[tuple[int | None, str, dict[str, float]]]) -> pa.RecordBatch:
    offsets = np.cumsum([0, *[len(c) for _, _, c in rows]], dtype=np.int32)
    keys = pa.array([k for _, _, c in rows for k in c], pa.string())
    items = pa.array([float(n) for _, _, c in rows for n in c.values()], pa.float64())
    columns = [pa.array([f for f, _, _ in rows], pa.int64()), pa.array([x for _, x, _ in rows], pa.string()), pa.MapArray.from_arrays(pa.array(offsets), keys, items)]
    return pa.RecordBatch.from_arrays(columns, names=["file_id", "field", "profile"])


def _profile_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Profiles of lines that come sorted by file; at the end, without file, sums by field."""
    whole: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    values: dict[str, list] = defaultdict(list)
    rows: list[tuple[int | None, str, dict]] = []
    held, at = 0, None

    def close() -> None:
        for field, found in values.items():
            c = field_features(found)
            if field == "metadata" and (plain := sum(opened(v) is None for v in found)):
                c[_PLAIN] = plain
            rows.append((at, field, c))
            w = whole[field]
            for k, n in c.items():
                w[k] += n
        values.clear()

    for b in batches:
        for file_id, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if file_id != at or held >= _HELD:
                close()
                held, at = 0, file_id
            record = parse_line(payload)
            if record is not None:
                held += 1
                for field, value in record.items():
                    values[field].append(value)
            if len(rows) >= 2000:
                yield _profile_rows(rows)
                rows = []
    close()
    yield _profile_rows(rows)
    yield _profile_rows([(None, field, c) for field, c in whole.items()])


def _type_of(profile: Column) -> Column:
    """``majority_type`` of a profile column."""
    n = [F.coalesce(F.element_at(profile, f"t:{t}"), F.lit(0.0)) for t in TYPES]
    best = F.greatest(*n)
    return F.coalesce(*[F.when(x == best, t) for t, x in zip(TYPES, n)])


def field_profiles(lines: DataFrame, *, hot_share: int = 200, max_names: int = 10_000) -> tuple[DataFrame, dict[str, dict[str, float]]]:
    """(``file_id``, ``field``, ``kind``, ``profile`` of every field of every file; profile by name
    over all files).

    Unreadable lines are ignored; a field is in a file if any line has a value other than null.
    ``kind`` is its type. Lines are shuffled once, by file. A file with more than one in
    ``hot_share`` of all lines, of which there can be at most ``hot_share``, goes to several tasks,
    whose parts of its profiles are summed. Names reach the driver; more than ``max_names`` are a
    ValueError.
    """
    spark = lines.sparkSession
    lines = lines.select(F.coalesce(F.col("file_id").cast("long"), F.lit(_NO_FILE)).alias("file_id"), "payload")
    limit = max(_HELD, lines.count() // hot_share)
    hot = [r["file_id"] for r in lines.groupBy("file_id").count().where(F.col("count") > limit).collect()]  # at most hot_share
    part = F.when(F.col("file_id").isin(hot), F.pmod(F.xxhash64("payload"), F.lit(hot_share))).otherwise(0) if hot else F.lit(0)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_file = lines.repartition(tasks, "file_id", part).sortWithinPartitions("file_id")
    parts = materialised(by_file.mapInArrow(_profile_batches, _PROFILE))
    repeated = parts.where(F.col("file_id").isin(hot)) if hot else None
    sums = lambda df, *by: (
        df.select(*by, F.explode("profile").alias("feature", "n")).groupBy(*by, "feature").agg(F.sum("n").alias("n"))
        .groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("feature", "n"))).alias("profile"))
    )
    single = parts.where(F.col("file_id").isNotNull())
    if hot:
        single = single.where(~F.col("file_id").isin(hot)).unionByName(sums(repeated, "file_id", "field"))
    names = sums(parts.where("file_id IS NULL"), "field").limit(max_names + 1).collect()
    if len(names) > max_names:
        raise ValueError(f"more than {max_names} field names")
    profiles = single.withColumn("kind", _type_of(F.col("profile")))
    return (materialised(profiles) if hot else profiles), {r["field"]: r["profile"] for r in names}


def majority_type(profile: dict[str, float]) -> str:
    """The type of most values; of equally frequent ones the first in ``TYPES``."""
    return max(TYPES, key=lambda t: (profile.get(f"t:{t}", 0), -TYPES.index(t)))


# --- Flooding ---------------------------------------------------------------------------------


def name_similarity(a: str, b: str) -> float:
    """0..1: common trigrams, one name beginning or ending the other, or words in common."""
    a, b = a.rpartition(".")[2], b.rpartition(".")[2]
    if a == b:
        return 1.0
    grams = lambda s: {f"##{s}#"[i : i + 3] for i in range(len(s) + 1)}
    x, y = grams(a), grams(b)
    best = 2 * len(x & y) / (len(x) + len(y))
    short, long = sorted((a, b), key=len)
    if len(short) >= 2 and (long.startswith(short) or long.endswith(short)):
        best = max(best, 0.8)
    words = set(re.split(r"[_\W]+", a)) & set(re.split(r"[_\W]+", b)) - {"", "id"}
    if words:
        best = max(best, 0.7)
    if len(short) >= 2 and short[0] == long[0] and re.search(".*".join(map(re.escape, short)), long):
        best = max(best, 0.6)
    return best


#: Share of each kind of literal in what flows from values to a pair of fields.
_KINDS = {"w": 0.3, "n": 0.25, "s": 0.2, "l": 0.15}
#: Coefficients of propagation into a pair of fields: from values, names, and the containers. They
#: sum to one, so scores have an absolute scale and the iteration contracts.
_VALUES, _NAMES, _CONTAINER = 0.7, 0.22, 0.08
#: Weight of values seen under a name in all files, against those of the file itself.
_ELSEWHERE = 0.9
_CODES = {
    **{f"{k}{i}": None for k in "ws" for i in range(_BUCKETS)}, **{f"n{i}": None for i in range(-6, 19)}, **{f"l{i}": None for i in range(10)},
    "w-": None, "n-": None, "b0": None, "b1": None, **{f"c{i}": None for i in range(7)},
}
_CODES = {k: i for i, k in enumerate(_CODES)}
_OF_KIND = {kind: np.array([i for k, i in _CODES.items() if k[0] == kind]) for kind in "wnslbc"}


def _literals(profiles: list[dict[str, float]]) -> np.ndarray:
    """A row of shares for each profile, of every kind of literal in the values."""
    out = np.zeros((len(profiles), len(_CODES)))
    for i, p in enumerate(profiles):
        for k, n in p.items():
            at = _CODES.get(k)
            if at is not None:
                out[i, at] = n
    for at in _OF_KIND.values():
        total = out[:, at].sum(1, keepdims=True)
        out[:, at] /= np.where(total > 0, total, 1)
    return out


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What flows from the literals that one field shares with each of some others."""
    low = np.minimum(a, b)
    flags = np.minimum(low[:, _OF_KIND["b"]].sum(1), low[:, _OF_KIND["c"]].sum(1))
    return sum(w * low[:, _OF_KIND[k]].sum(1) for k, w in _KINDS.items()) + 0.1 * flags


def _keys(profile: dict[str, float]) -> dict[str, tuple[float, str]]:
    """Share and type of each nested key."""
    total = sum(n for f, n in profile.items() if f.startswith("k:"))
    best: dict[str, tuple[float, str]] = {}
    for f, n in profile.items():
        if f.startswith("kt:"):
            kind, key = f[3:].split(":", 1)
            best[key] = max(best.get(key, (0.0, "")), (n, kind))
    return {f[2:]: (n / total, best.get(f[2:], (0.0, ""))[1]) for f, n in profile.items() if f.startswith("k:")}


def _container(field: str) -> int:
    """0: metadata, which can only go on as itself; 1: fields of the record; 2: those of metadata."""
    return 0 if field == "metadata" else 2 if field.startswith("metadata.") else 1


def flood(
    left: dict[str, dict], right: dict[str, dict], shared: dict[str, dict], *, kept: tuple[int, int] = (0, 0),
    threshold: float = 0.0, rounds: int = 100, propagation: float = 1.0,
) -> dict[tuple[str, str], float]:
    """Scores, 0..1, of pairs of fields (profiles by field) of two schemas, after flooding.

    ``shared``: profile by name over all files, which tells that two names carry alike values
    elsewhere, also where a type changed here. ``kept``: fields of the record and of metadata that
    go on under their name. ``propagation`` scales all coefficients; at 0 nothing flows, and no
    pair of fields has a score. Pairs that can't reach ``threshold`` even if everything flooded
    into them are left out of the graph, so a wide schema doesn't make a dense one.
    """
    la, lb = list(left), list(right)
    pa_, pb = [left[a] for a in la], [right[b] for b in lb]
    here = _literals(pa_), _literals(pb)
    there = _literals([shared.get(a, left[a]) for a in la]), _literals([shared.get(b, right[b]) for b in lb])
    keys_a, keys_b = [_keys(p) for p in pa_], [_keys(p) for p in pb]
    in_b = np.array([_container(b) for b in lb])
    nested_b = np.array([bool(k) for k in keys_b], bool)
    ends: list[tuple[int, int]] = []
    own, names = [], []  # what flows into each pair of fields: from its values, here and elsewhere; from its names
    for i, a in enumerate(la):
        at = np.flatnonzero(in_b == _container(a)) if _container(a) else np.zeros(0, int)
        if not len(at):
            continue
        values, also = _common(here[0][i], here[1][at]), _ELSEWHERE * _common(there[0][i], there[1][at])
        most = np.where(nested_b[at] & bool(keys_a[i]), 1.0, np.maximum(values, also))
        for j, v, e, m in zip(at, values, also, most):
            if propagation * (_VALUES * m + _NAMES + _CONTAINER) < threshold:
                continue
            name = name_similarity(a, lb[j])
            if propagation * (_VALUES * m + _NAMES * name + _CONTAINER) >= threshold:
                ends.append((i, int(j)))
                own.append((v, e))
                names.append(name)
    n = len(ends)
    if not n:
        return {}
    own_values, elsewhere = np.array(own).T
    names_ = np.array(names)
    # Pairs of nested keys: each key with the likest of the other side, by name and type.
    parent, share, literal = [], [], []
    for p, (i, j) in enumerate(ends):
        for k, (w, kind) in keys_a[i].items():
            if keys_b[j]:
                alike = lambda m: 0.5 * name_similarity(k, m) + 0.2 * (keys_b[j][m][1] == kind)  # noqa: E731, B023
                m = max(sorted(keys_b[j]), key=alike)
                parent.append(p)
                share.append(min(w, keys_b[j][m][0]))
                literal.append(alike(m))
    parent_, share_, literal_ = np.array(parent, int), np.array(share), np.array(literal)
    nested = np.bincount(parent_, minlength=n) > 0 if len(parent_) else np.zeros(n, bool)
    box = np.array([_container(la[i]) for i, _ in ends])
    start = np.array([i for i, _ in ends])
    size = {c: max(1, kept[c - 1] + max(sum(_container(a) == c for a in la), int((in_b == c).sum()))) for c in (1, 2)}
    fields, keys, boxes = np.zeros(n), np.zeros(len(parent_)), np.zeros(3)
    for _ in range(rounds):
        inner = np.bincount(parent_, share_ * keys, n) if len(parent_) else np.zeros(n)
        values = np.maximum(own_values, np.where(nested, 0.5 * inner + 0.5 * own_values, 0.0))
        new = propagation * (_VALUES * np.maximum(values, elsewhere) + _NAMES * names_ + _CONTAINER * boxes[box])
        new_keys = literal_ + 0.3 * propagation * fields[parent_] if len(parent_) else keys
        best = np.zeros(len(la))
        np.maximum.at(best, start, fields)
        new_boxes = np.array([0.0, *[(kept[c - 1] + sum(best[i] for i, a in enumerate(la) if _container(a) == c)) / size[c] for c in (1, 2)]])
        moved = max(np.abs(new - fields).max(), np.abs(new_boxes - boxes).max(), np.abs(new_keys - keys).max() if len(keys) else 0.0)
        fields, keys, boxes = new, new_keys, new_boxes
        if moved < 1e-9:
            break
    return {(la[i], lb[j]): float(s) for (i, j), s in zip(ends, fields)}


def correspondences(score: dict[tuple[str, str], float], threshold: float) -> dict[str, str]:
    """The stable selection: pairs by falling score, each field once, as far as the score, weighed by
    its ratio to the best one that either field has, reaches the threshold."""
    best_a: dict[str, float] = defaultdict(float)
    best_b: dict[str, float] = defaultdict(float)
    for (a, b), s in score.items():
        best_a[a], best_b[b] = max(best_a[a], s), max(best_b[b], s)
    out: dict[str, str] = {}
    taken: set[str] = set()
    for s, a, b in sorted(((s, a, b) for (a, b), s in score.items() if s > 0), key=lambda x: (-x[0], x[1], x[2])):
        if a not in out and b not in taken and s * s / max(best_a[a], best_b[b]) >= threshold:
            out[a] = b
            taken.add(b)
    return out


def renamed_fields(gone: dict[str, dict], new: dict[str, dict], shared: dict[str, dict], kept: tuple[int, int], threshold: float, propagation: float = 1.0) -> dict[str, str]:
    """New name by old one of the fields that go on under another name."""
    if not gone or not new:
        return {}
    return correspondences(flood(gone, new, shared, kept=kept, threshold=threshold, propagation=propagation), threshold)


def file_changes(left: dict[str, dict], right: dict[str, dict], shared: dict[str, dict], threshold: float = 0.48, propagation: float = 1.0) -> list[tuple[str, str, str]]:
    """(kind, old field, new field) for each change between two files."""
    gone, new = {f: p for f, p in left.items() if f not in right}, {f: p for f, p in right.items() if f not in left}
    kept = tuple(sum(f in right and _container(f) == c for f in left) for c in (1, 2))
    renamed = renamed_fields(gone, new, shared, kept, threshold, propagation)
    back = {b: a for a, b in renamed.items()}
    out = [("renamed", a, b) for a, b in renamed.items()]
    out += [("removed", a, "") for a in gone if a not in renamed]
    out += [("added", "", b) for b in new if b not in back]
    for b in right:
        a = back.get(b, b)
        if a in left and majority_type(left[a]) != majority_type(right[b]):
            out.append(("retyped", b, b))
    return out


# --- Changes ----------------------------------------------------------------------------------


def _file_order(files: DataFrame) -> DataFrame:
    """``file_id``, ``feed``, ``at``: each file once, with its place (from 1) in its feed, by its
    earliest period. A feed of any size is ranked over several tasks."""
    once = files.where("file_id IS NOT NULL").groupBy(F.col("file_id").cast("long").alias("file_id")).agg(F.min(F.struct("period_start", "feed")).alias("f"))
    ranked = ranked_within(once.select("file_id", "f.*"), F.col("feed"), [F.col("period_start"), F.col("file_id")], "at")
    return ranked.select("file_id", "feed", "at")


def _sides(order: DataFrame, profiles: DataFrame) -> DataFrame:
    """``file_id``, ``prev``, ``field``, ``was``, ``kind``: fields of each file and of the one before."""
    earlier = order.select(F.col("file_id").alias("prev"), F.col("feed").alias("g"), (F.col("at") + 1).alias("next"))
    before = bounded_broadcast(materialised(order.join(earlier, order.feed.eqNullSafe(F.col("g")) & (F.col("at") == F.col("next"))).select("file_id", "prev")))
    old = before.join(profiles.select(F.col("file_id").alias("prev"), "field", F.col("kind").alias("was")), "prev")
    new = before.join(profiles.select("file_id", "field", "kind"), "file_id")
    return old.withColumn("kind", F.lit(None).cast("string")).unionByName(new.withColumn("was", F.lit(None).cast("string"))).groupBy("file_id", "prev", "field").agg(
        F.max("was").alias("was"), F.max("kind").alias("kind")
    )


def schema_changes(
    files: DataFrame, lines: DataFrame, *, threshold: float = 0.48, max_names: int = 10_000,
    profiles: tuple[DataFrame, dict] | None = None, order: DataFrame | None = None,
) -> DataFrame:
    """``file_id``, ``change_kind``, ``old_field``, ``new_field`` of each file against the one before.

    ``files``: ``file_id``, ``feed``, ``period_start``; the order in a feed is by period and then
    id. ``lines``: ``file_id`` and ``payload``, a JSON object. A repeated row of ``files`` counts
    once (earliest period); files without feed form one feed; a file without any readable line
    has no fields; lines of unknown files are ignored. More than ``max_names`` different names are
    a ValueError. Empty tables give an empty table. ``profiles`` and ``order``: where the caller
    has them.

    What reaches one task of the flooding is the fields that vanished from or appeared in one file.
    """
    table, everywhere = field_profiles(lines, max_names=max_names) if profiles is None else profiles
    order = _file_order(files) if order is None else order
    sides = materialised(_sides(order, table))
    inner = F.col("field").startswith("metadata.")
    kept = sides.where("was IS NOT NULL AND kind IS NOT NULL")
    moved = sides.where("(was IS NULL) <> (kind IS NULL)")
    per_file = moved.groupBy("file_id").agg(F.count_if(F.col("was").isNotNull()).alias("n_gone"), F.count_if(F.col("kind").isNotNull()).alias("n_new"))
    both = per_file.where("n_gone > 0 AND n_new > 0").select("file_id")
    counts = kept.groupBy("file_id").agg(F.count_if(~inner & (F.col("field") != "metadata")).alias("kept_fields"), F.count_if(inner).alias("kept_inner"))
    owner = moved.withColumn("of", F.when(F.col("was").isNull(), F.col("file_id")).otherwise(F.col("prev")))
    rows = owner.join(both, "file_id", "left_semi").join(counts, "file_id", "left")
    rows = rows.join(table.select(F.col("file_id").alias("of"), "field", "profile"), ["of", "field"])
    shared = lines.sparkSession.sparkContext.broadcast(everywhere)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [])
            for file_id, fields, n, m in zip(*(b.column(c).to_pylist() for c in ("file_id", "fields", "kept_fields", "kept_inner"))):
                gone = {f["field"]: dict(f["profile"]) for f in fields if f["gone"]}
                new = {f["field"]: dict(f["profile"]) for f in fields if not f["gone"]}
                for x in renamed_fields(gone, new, shared.value, (n, m), threshold).items():
                    for column, value in zip(out, (file_id, *x)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], names=["file_id", "a", "b"])

    groups = rows.groupBy("file_id").agg(
        F.collect_list(F.struct("field", F.col("was").isNotNull().alias("gone"), "profile")).alias("fields"),
        F.coalesce(F.max("kept_fields"), F.lit(0)).alias("kept_fields"), F.coalesce(F.max("kept_inner"), F.lit(0)).alias("kept_inner"),
    )
    renamed = materialised(groups.mapInArrow(match, "file_id long, a string, b string"))
    none = F.lit("")
    ends = renamed.select("file_id", F.col("a").alias("field"), F.lit(True).alias("is_old"), "b").unionByName(
        renamed.select("file_id", F.col("b").alias("field"), F.lit(False).alias("is_old"), F.col("a").alias("b"))
    )
    ends = bounded_broadcast(ends)
    named = moved.withColumn("is_old", F.col("was").isNotNull()).join(ends, ["file_id", "field", "is_old"], "left")
    lost = named.where("b IS NULL AND was IS NOT NULL").select("file_id", F.lit("removed").alias("change_kind"), F.col("field").alias("old_field"), none.alias("new_field"))
    come = named.where("b IS NULL AND kind IS NOT NULL").select("file_id", F.lit("added").alias("change_kind"), none.alias("old_field"), F.col("field").alias("new_field"))
    moves = renamed.select("file_id", F.lit("renamed").alias("change_kind"), F.col("a").alias("old_field"), F.col("b").alias("new_field"))
    # The kinds of a renamed field stand in two rows: under its old name, and under its new one.
    pairs = named.where("b IS NOT NULL").select("file_id", F.when(F.col("is_old"), F.col("b")).otherwise(F.col("field")).alias("field"), "was", "kind")
    pairs = pairs.groupBy("file_id", "field").agg(F.max("was").alias("was"), F.max("kind").alias("kind"))
    retyped = kept.select("file_id", "field", "was", "kind").unionByName(pairs).where("was <> kind")
    retyped = retyped.select("file_id", F.lit("retyped").alias("change_kind"), F.col("field").alias("old_field"), F.col("field").alias("new_field"))
    return lost.unionByName(come).unionByName(moves).unionByName(retyped)


# --- One table --------------------------------------------------------------------------------


def feed_names(fields: dict[int, set[str]], renames: dict[int, dict[str, str]], files: dict[str, int]) -> dict[tuple[int, str], str]:
    """Steady name by (file, field) of one feed, of the fields that get another name than theirs.

    ``fields`` by position of the file; ``renames``: old name by new one, by position; ``files``:
    in how many files of all feeds a name is. A field goes on into the next file under its name or
    the one that a rename gives it, and after a pause under its last name, so it is at most one
    name in each file. It is called by the one of its names that most files use and that no file
    of its own holds beside it; if there is none, each file keeps its name. So no two fields of a
    file, and of a line, ever share a steady name.
    """
    histories: list[list[tuple[int, str]]] = []
    current: dict[str, int] = {}
    ended: dict[str, int] = {}
    last = None
    for at in sorted(fields):
        if last is not None and at != last + 1:
            ended.update(current)
            current = {}
        back = renames.get(at, {})
        before = {f: back.get(f, f) for f in sorted(fields[at])}
        ended.update({f: h for f, h in current.items() if f not in before.values()})
        now = {}
        for f, old in before.items():
            h = current.get(old)
            if h is None:
                h = ended.pop(f, None)
            if h is None:
                h = len(histories)
                histories.append([])
            histories[h].append((at, f))
            now[f] = h
        current, last = now, at
    out: dict[tuple[int, str], str] = {}
    taken: set[tuple[int, str]] = set()
    for history in sorted(histories, key=lambda h: (-len(h), h)):
        names = {f for _, f in history}
        if len(names) == 1:
            continue
        for name in sorted(names, key=lambda f: (-files.get(f, 0), f)):
            if all(f == name or (name not in fields[at] and (at, name) not in taken) for at, f in history):
                taken |= {(at, name) for at, _ in history}
                out |= {(at, f): name for at, f in history if f != name}
                break
    return out


def tied_names(profiles: dict[str, dict[str, float]], together: dict[str, set[str]], tied: Iterable[tuple[str, str]], *, threshold: float = 0.5, prefer: tuple[str, ...] = ()) -> dict[str, str]:
    """Name by name, of the names that stand for one meaning in all files; others are left out.

    Pairs that a rename ties (``tied``) come first, then those whose flooded score, by the values
    of all files and by name, reaches ``threshold``, best first. Two groups of names are joined
    only if no file holds (``together``) a name of each. A group is called by the first of its
    names that ``prefer`` has, else by its least one, so the name doesn't hang on counts.
    """
    names = sorted(profiles)
    score = flood({n: profiles[n] for n in names}, {n: profiles[n] for n in names}, {}, threshold=threshold)
    pairs = {(a, b): s for (a, b), s in score.items() if a < b and s >= threshold}
    for a, b in tied:
        pairs[min(a, b), max(a, b)] = 2.0
    group = {n: n for n in names}
    members = {n: {n} for n in names}
    rivals = {n: set(together.get(n, ())) for n in names}
    for a, b in sorted(pairs, key=lambda p: (-pairs[p], p)):
        x, y = group.get(a, a), group.get(b, b)
        if x == y or x not in members or y not in members or members[x] & rivals[y]:
            continue
        low, high = min(x, y), max(x, y)
        for n in members[high]:
            group[n] = low
        members[low] |= members.pop(high)
        rivals[low] |= rivals.pop(high)
    called = {g: min(own, key=lambda n: (prefer.index(n) if n in prefer else len(prefer), n)) for g, own in members.items()}
    return {n: called[g] for n, g in group.items() if n != called[g]}


def _together(fields: DataFrame, names: list[str]) -> dict[str, set[str]]:
    """For each name those that some file holds beside it: one row of bits for each name and task,
    joined by name before they reach the driver."""
    at = fields.sparkSession.sparkContext.broadcast({n: i for i, n in enumerate(names)})
    size = len(names)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((size, size), bool)
        for b in batches:
            for own in b.column(0).to_pylist():
                i = [at.value[n] for n in own]
                seen[np.ix_(i, i)] = True
        rows = np.flatnonzero(seen.any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows.astype(np.int32)), pa.array([np.packbits(seen[i]).tobytes() for i in rows], pa.binary())], names=["i", "bits"]
        )

    def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [key[0]], "bits": [np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in rows["bits"]]).tobytes()]})

    sets = fields.groupBy("file_id").agg(F.collect_set("name").alias("own")).select("own")
    found = sets.mapInArrow(pairs, "i int, bits binary").groupBy("i").applyInPandas(join, "i int, bits binary").collect()  # a row for each name
    out: dict[str, set[str]] = {n: set() for n in names}
    for r in found:
        bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=size)
        out[names[r["i"]]] |= {names[j] for j in np.flatnonzero(bits)} - {names[r["i"]]}
    return out


def steady_names(order: DataFrame, changes: DataFrame, profiles: DataFrame, everywhere: dict[str, dict], *, fit: float = 0.9, prefer: tuple[str, ...] = (), max_names: int = 10_000) -> tuple[DataFrame, dict[str, str], dict[str, str]]:
    """(``file_id``, ``field``, ``steady`` of the fields that go on under another name in their
    feed; name by steady name of those of one meaning; Spark type by final name).

    Names are given in each feed by itself first, see ``feed_names``, then tied over all feeds, see
    ``tied_names``. Only distinct names and sums by name reach the driver. A column is boolean,
    bigint or double if a share of ``fit`` of its values reads so, else string.
    """
    used = {r["field"]: r["count"] for r in profiles.groupBy("field").count().limit(max_names + 1).collect()}
    none = F.lit(None).cast("string")
    renames = changes.where("change_kind = 'renamed'").select("file_id", F.col("old_field").alias("old"), F.col("new_field").alias("new"))
    rows = profiles.select("file_id", none.alias("old"), F.col("field").alias("new")).unionByName(renames)
    # A feed in which no field is renamed keeps its names.
    some = order.join(renames.select("file_id").distinct(), "file_id", "left_semi").select("feed").distinct().withColumnRenamed("feed", "g")
    moving = order.join(bounded_broadcast(some), order.feed.eqNullSafe(F.col("g")), "left_semi")

    def name(feed: pd.DataFrame) -> pd.DataFrame:
        fields: dict[int, set[str]] = defaultdict(set)
        moved: dict[int, dict[str, str]] = defaultdict(dict)
        ids = dict(zip(feed["at"], feed["file_id"]))
        for at, old, new in zip(feed["at"], feed["old"], feed["new"]):
            if old is None:
                fields[at].add(new)
            else:
                moved[at][new] = old
        found = feed_names(fields, moved, used)
        return pd.DataFrame([(ids[at], f, s) for (at, f), s in found.items()], columns=["file_id", "field", "steady"])

    steady = materialised(rows.join(moving, "file_id").groupBy("feed").applyInPandas(name, "file_id long, field string, steady string"))
    named = profiles.join(bounded_broadcast(steady), ["file_id", "field"], "left").select("file_id", F.coalesce("steady", "field").alias("name"))
    names = sorted(used)
    distinct = {(r["old"], r["new"]) for r in renames.select("old", "new").distinct().limit(max_names * 10 + 1).collect()}
    if len(distinct) > max_names * 10:
        raise ValueError(f"more than {max_names * 10} pairs of names")
    ties = tied_names(everywhere, _together(named, names), distinct, prefer=prefer)
    reading = {k: F.sum(F.coalesce(F.element_at("profile", k), F.lit(0.0))).alias(k.replace(":", "_")) for k in [f"t:{t}" for t in TYPES] + ["v:boolean", "v:integer", "v:number", _PLAIN]}
    sums = profiles.join(bounded_broadcast(steady), ["file_id", "field"], "left").groupBy(F.coalesce("steady", "field").alias("name")).agg(*reading.values()).collect()
    totals: dict[str, Counter] = defaultdict(Counter)
    for r in sums:
        totals[ties.get(r["name"], r["name"])].update({k: r[k] for k in r.asDict() if k != "name"})
    types = {}
    for n, c in totals.items():
        if n == "metadata":
            # Its members have columns of their own; what is no object stays text.
            if c["x_plain"]:
                types[n] = "string"
            continue
        least = fit * sum(c[f"t_{t}"] for t in TYPES)
        boolean = c["v_boolean"] >= least and 2 * c["t_boolean"] >= least
        types[n] = "boolean" if boolean else "bigint" if c["v_integer"] >= least else "double" if c["v_number"] >= least else "string"
    return steady, ties, types


def _column_names(fields: list[str], taken: set[str]) -> list[str]:
    """A column name for each field: its path with ``__`` for the dot; numbered where it is taken."""
    out = []
    for f in fields:
        base = name = re.sub(r"\W", "_", f.replace(".", "__")) or "_"
        k = 2
        while name in taken:
            name, k = f"{base}_{k}", k + 1
        taken.add(name)
        out.append(name)
    return out


_READ = {"boolean": as_boolean, "bigint": as_integer, "double": as_number}


def unified_records(files: DataFrame, lines: DataFrame, *, threshold: float = 0.48, fit: float = 0.9, prefer: tuple[str, ...] = (), max_names: int = 10_000) -> DataFrame:
    """One table with steady columns from all readable lines: ``line_id``, ``file_id``, ``line_no``,
    a column for each steady field, called by its path with ``__`` for the dot, and ``rest``.

    A column is boolean, bigint or double if a share of ``fit`` of its values reads so (text in
    plain notation and integers within 64 bits count), else a string, with arrays and objects as
    JSON text. A value that its column can't hold stands in ``rest``, a map from the steady name to
    its JSON text, so that no value is lost; ``rest`` is null where there is none. No two fields of
    a line share a steady name; of names of one meaning the first in ``prefer`` stands. ``metadata`` is a column, of text, only where it is no object.
    Lines without file or of unknown files take part under their names. A column whose name is
    taken (``line_id``) gets a number. Unreadable lines have no row. Empty tables give the id
    columns and ``rest``.
    """
    profiles, everywhere = field_profiles(lines, max_names=max_names)
    order = _file_order(files)
    changes = schema_changes(files, lines, threshold=threshold, max_names=max_names, profiles=(profiles, everywhere), order=order)
    steady, ties, types = steady_names(order, materialised(changes), profiles, everywhere, fit=fit, prefer=prefer, max_names=max_names)
    fields = sorted(types)
    columns = _column_names(fields, {"line_id", "file_id", "line_no", "rest"})
    arrow = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str | None, dict[str, str]] = {None: {}}
        place = {f: i for i, f in enumerate(fields)}
        readers = [_READ.get(types[f]) for f in fields]
        for b in batches:
            kept: list[int] = []
            values: list[list] = [[] for _ in fields]
            rest: list[list[tuple[str, str]] | None] = []
            for i, (payload, text) in enumerate(zip(b.column(3).to_pylist(), b.column(4).to_pylist())):
                record = parse_line(payload)
                if record is None:
                    continue
                kept.append(i)
                if text not in own:
                    own[text] = json.loads(text)
                row: list = [None] * len(fields)
                left = []
                for field, value in record.items():
                    if field == "metadata" and opened(value) is not None:
                        continue
                    name = own[text].get(field, field)
                    name = ties.get(name, name)
                    at = place[name]
                    read = readers[at]
                    fits = (value if isinstance(value, str) else _json_text(value)) if read is None else read(value)
                    if fits is None:
                        left.append((name, _json_text(value)))
                    else:
                        row[at] = fits
                for column, value in zip(values, row):
                    column.append(value)
                rest.append(left or None)
            ids = [b.column(i).take(pa.array(kept, pa.int64())) for i in range(3)]
            yield pa.RecordBatch.from_arrays(
                [*ids, *[pa.array(v, arrow[types[f]]) for v, f in zip(values, fields)], pa.array(rest, pa.map_(pa.string(), pa.string()))],
                names=["line_id", "file_id", "line_no", *columns, "rest"],
            )

    schema = ", ".join(["line_id long, file_id long, line_no int", *[f"`{c}` {types[f]}" for c, f in zip(columns, fields)], "rest map<string,string>"])
    by_file = steady.groupBy("file_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("field", "steady")))).alias("names"))
    rows = lines.select(F.col("line_id").cast("long"), F.col("file_id").cast("long"), F.col("line_no").cast("int"), "payload")
    rows = rows.join(bounded_broadcast(by_file), "file_id", "left")
    return rows.select("line_id", "file_id", "line_no", "payload", "names").mapInArrow(run, schema)
