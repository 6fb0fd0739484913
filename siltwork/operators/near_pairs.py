"""Pairs of texts with a TF-IDF cosine of at least a threshold, without a row for each term of a text.

A word travels as a hash of 64 bits, a text as the array of its words; pairs of neighbours are made
of the hashes where they are needed. Terms of one text only are in no vocabulary: they count for a
text's length and for nothing else.

Candidates come from a prefix filter: a text is posted under its rarest terms until the rest can
no longer reach the threshold. A posting carries a sketch of its text: the terms are dealt into
cells, and a cell holds the length of what fell into it. By Cauchy and Schwarz the product of two
sketches is no less than that of the texts, so that a pair is dropped in the list where it is met,
before it is written anywhere. What is left is verified on whole vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltwork.session import bounded_broadcast, checkpointed, materialised

_PART_WORDS = 250_000  # words that are looked at together
_PART_ROWS = 20_000  # postings that are compared together, if no list is longer
_PART_CELLS = 4_000_000  # numbers of a block of products
_BLOCK_BYTES = 24 << 20  # of vectors; a cell has those of two blocks
_CELLS = 64  # of the smallest sketch; longer texts have up to eight times as many
_MIX = tuple(map(np.uint64, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 29, 32)))

#: Texts in a row: ids, and for each term its text's number, hash, count and document frequency.
Part = tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hash of two neighbours."""
    a, b, c, s, t = _MIX
    with np.errstate(over="ignore"):
        h = (x * a) ^ ((y + b) * c)
        h = (h ^ (h >> t)) * b
        return h ^ (h >> s)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, text, term, count) of parts of texts; terms ascend within a text."""
    for b in batches:
        ids, lists = b.column(0), b.column(1)
        first = lists.offsets.to_numpy().astype(np.int64)
        words = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
        low = 0
        while low < len(ids):
            high = max(low + 1, int(np.searchsorted(first, first[low] + _PART_WORDS, "right")) - 1)
            w = words[first[low] : first[high]]
            text = np.repeat(np.arange(high - low), np.diff(first[low : high + 1]))
            both = np.flatnonzero(text[1:] == text[:-1])
            term, text = np.concatenate((w, _mixed(w[both], w[both + 1]))), np.concatenate((text, text[both]))
            order = np.lexsort((term, text))
            term, text = term[order], text[order]
            new = np.ones(len(term), bool)
            new[1:] = (term[1:] != term[:-1]) | (text[1:] != text[:-1])
            start = np.flatnonzero(new)
            yield ids.slice(low, high - low), text[start], term[start], np.diff(np.append(start, len(term)))
            low = high


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``term`` and in how many texts it is, by part; under a null term the texts that have any."""
    for _, text, term, _ in _bags(batches):
        terms, n = np.unique(term, return_counts=True)
        some = len(np.unique(text))
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([some], pa.int64())], names=["term", "df"])
        yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n.astype(np.int64))], names=["term", "df"])


class Vocabulary:
    """Document frequencies of the terms that more than one text has."""

    def __init__(self, terms: np.ndarray, df: np.ndarray) -> None:
        order = np.argsort(terms.view(np.uint64))
        self.terms, self.df = terms.view(np.uint64)[order], df[order].astype(np.int32)

    def of(self, terms: np.ndarray) -> np.ndarray:
        if not len(self.terms):
            return np.ones(len(terms), np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, self.df[at], 1).astype(np.int64)


def _known(batches: Iterator[pa.RecordBatch], vocab: Vocabulary) -> Iterator[Part]:
    for ids, text, term, tf in _bags(batches):
        yield ids, text, term, tf, vocab.of(term)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[Part]:
    """Parts of rows (id, terms, counts, frequencies)."""
    for b in batches:
        term, tf, df = (b.column(k).flatten().to_numpy(zero_copy_only=False) for k in (1, 2, 3))
        text = np.repeat(np.arange(b.num_rows), np.diff(b.column(1).offsets.to_numpy()))
        order = np.lexsort((term.view(np.uint64), text))
        yield b.column(0), text[order], term.view(np.uint64)[order], tf[order], df[order]


def _weights(part: Part, n: int) -> np.ndarray:
    """tf times smoothed idf, of length one for each text."""
    ids, text, _, tf, df = part
    w = tf * (np.log((1.0 + n) / (1.0 + df)) + 1.0)
    return w / np.sqrt(np.bincount(text, w * w, len(ids)))[text]


def _sketches(text: np.ndarray, term: np.ndarray, square: np.ndarray, n: int) -> list[bytes]:
    """By text: scale and error (four bytes each), and a byte for each cell."""
    size = np.bincount(text, minlength=n)
    cells = _CELLS << np.minimum(3, np.maximum(0, np.ceil(np.log2(np.maximum(1, size) / (2 * _CELLS))))).astype(int)
    out: list[bytes] = [b""] * n
    # Upper bits tell the cell: the lower half of the cells folds onto it by the last bit of its number.
    spread = (term * _MIX[0]) >> np.uint64(64 - 9)
    for c in np.unique(cells).tolist():
        own = np.flatnonzero(cells == c)
        row = np.full(n, -1)
        row[own] = np.arange(len(own))
        mine = row[text] >= 0
        cell = row[text[mine]] * c + (spread[mine] % np.uint64(c)).astype(np.int64)
        length = np.sqrt(np.bincount(cell, square[mine], len(own) * c)).reshape(len(own), c)
        scale = np.maximum(length.max(1), 1e-9).astype(np.float32) / np.float32(255)
        code = np.clip(np.rint(length / scale[:, None]), 0, 255).astype(np.uint8)
        error = np.sqrt(((length - code * scale[:, None].astype(float)) ** 2).sum(1)) * 1.001 + 1e-6
        head = np.stack((scale, error.astype(np.float32)), 1).view(np.uint8)
        for k, x in zip(own.tolist(), np.concatenate((head, code), 1)):
            out[k] = x.tobytes()
    return out


def _postings(parts: Iterator[Part], n: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """``term``, ``id``, ``sketch``: each text under the terms of its prefix that others have as well."""
    for part in parts:
        ids, text, term, _, df = part
        w = _weights(part, n)
        square = w * w
        order = np.lexsort((term, df, text))
        by, s = text[order], square[order]
        total = np.cumsum(s[::-1])[::-1]
        first = np.searchsorted(by, np.arange(len(ids) + 1))
        rest = total - np.append(total, 0.0)[first[1:]][by]
        chosen = order[(rest >= threshold * threshold - 1e-9) & (df[order] > 1)]
        posted = np.unique(text[chosen])
        # Only texts that are posted at all need a sketch.
        place = np.full(len(ids), -1)
        place[posted] = np.arange(len(posted))
        mine = place[text] >= 0
        sketches = pa.array(_sketches(place[text[mine]], term[mine], square[mine], len(posted)), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(term[chosen].view(np.int64)), ids.take(pa.array(text[chosen])), sketches.take(pa.array(place[text[chosen]]))],
            names=["term", "id", "sketch"],
        )


def _vectors(parts: Iterator[Part], n: int) -> Iterator[pa.RecordBatch]:
    """``id``, ``terms``, ``weights``: the terms that others have as well, ascending, as bytes."""
    for part in parts:
        ids, text, term, _, df = part
        w = _weights(part, n)
        shared = df > 1
        text, term, w = text[shared], term[shared], w[shared]
        first = np.searchsorted(text, np.arange(len(ids) + 1)).tolist()
        cut = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(first, first[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([ids, cut(term), cut(w)], names=["id", "terms", "weights"])


def _folded(x: np.ndarray, cells: int) -> np.ndarray:
    """Sketches of more cells as if they had been made with fewer."""
    while x.shape[1] > cells:
        half = x.shape[1] // 2
        x = np.sqrt(x[:, :half] ** 2 + x[:, half:] ** 2)
    return x


def _met(lists: np.ndarray, sketches: pa.Array, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose lists meet (``lists``: first row of each, and the end) and whose sketches allow it."""
    n = len(sketches)
    _, offsets, values = sketches.buffers()
    first = np.frombuffer(offsets, np.int32)[sketches.offset : sketches.offset + n + 1].astype(np.int64)
    data, size = np.frombuffer(values, np.uint8), np.diff(first) - 8
    least = np.float32(threshold - 1e-4)
    base, error, wide, where = np.zeros((n, _CELLS), np.float32), np.zeros(n, np.float32), {}, np.zeros(n, int)
    for c in np.unique(size).tolist():
        own = np.flatnonzero(size == c)
        raw = data[first[own][:, None] + np.arange(8 + c)]
        head = np.ascontiguousarray(raw[:, :8]).view(np.float32)
        wide[c] = raw[:, 8:] * head[:, :1]
        error[own], where[own] = head[:, 1], np.arange(len(own))
        base[own] = _folded(wide[c], _CELLS)
    left, right = [], []

    def keep(product: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return product + a + b + a * b >= least

    start, length = lists[:-1], np.diff(lists)
    for m in range(2, 17):  # short lists of one length together
        rows = start[length == m]
        i, j = np.triu_indices(m, 1)
        for part in np.split(rows, np.arange(4096, len(rows), 4096)):
            x, e = base[part[:, None] + np.arange(m)], error[part[:, None] + np.arange(m)]
            which, k = np.nonzero(keep(np.matmul(x, x.transpose(0, 2, 1))[:, i, j], e[:, i], e[:, j]))
            left.append(part[which] + i[k])
            right.append(part[which] + j[k])
    for s, m in zip(start[length > 16].tolist(), length[length > 16].tolist()):
        step = max(1, _PART_CELLS // m)
        for k in range(0, m, step):
            x, e = base[s + k : s + min(m, k + step)], error[s + k : s + min(m, k + step)]
            i, j = np.nonzero(keep(x @ base[s + k : s + m].T, e[:, None], error[s + k : s + m]))
            i, j = i[i < j], j[i < j]
            i, j = i + s + k, j + s + k
            left.append(i)
            right.append(j)
            left[-1], right[-1] = _wide(left[-1], right[-1], size, wide, where, error, keep)
    a, b = (np.concatenate(x) if x else np.zeros(0, int) for x in (left, right))
    return _wide(a, b, size, wide, where, error, keep)


def _wide(a: np.ndarray, b: np.ndarray, size: np.ndarray, wide: dict[int, np.ndarray], where: np.ndarray, error: np.ndarray, keep: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of rows those that stay when compared by as many cells as both have."""
    ok = np.ones(len(a), bool)
    for c in wide:
        for d in wide:
            if min(c, d) == _CELLS:
                continue
            at = np.flatnonzero((size[a] == c) & (size[b] == d))
            for part in np.split(at, np.arange(10_000, len(at), 10_000)):
                x, y = _folded(wide[c][where[a[part]]], min(c, d)), _folded(wide[d][where[b[part]]], min(c, d))
                ok[part] = keep(np.einsum("ij,ij->i", x, y), error[a[part]], error[b[part]])
    return a[ok], b[ok]


def _pairs(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """``a``, ``b`` of texts that meet in a list; rows come ordered by term."""

    def found(held: list[pa.RecordBatch], whole: bool) -> tuple[pa.RecordBatch | None, pa.RecordBatch | None]:
        b = pa.concat_batches(held)
        term = b.column(0).to_numpy()
        ends = np.flatnonzero(np.diff(term)) + 1
        end = b.num_rows if whole else int(ends[-1]) if len(ends) else 0
        lists = np.concatenate(([0], ends[ends < end], [end]))
        rest = b.slice(end) if end < b.num_rows else None
        if end == 0 or len(lists) > end:  # no list is complete, or none has two rows
            return None, rest
        i, j = _met(lists, b.column(2), threshold)
        pairs = [b.column(1).take(pa.array(x)) for x in (i, j)]
        return pa.RecordBatch.from_arrays(pairs, names=["a", "b"]), rest

    held: list[pa.RecordBatch] = []
    size, enough = 0, _PART_ROWS
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= enough:
            out, rest = found(held, False)
            held, size = ([rest], rest.num_rows) if rest is not None else ([], 0)
            enough = max(_PART_ROWS, 2 * size)  # a long list is put together a few times only
            if out is not None:
                yield out
    if held:
        out, _ = found(held, True)
        if out is not None:
            yield out


def _verified(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """``a``, ``b`` of pairs that reach the threshold. Rows come by cell: first the vectors (``a``,
    ``terms``, ``weights``) that the cell's pairs need, then the pairs, which have a ``b``."""
    cell, terms, weights = None, {}, {}
    for batch in batches:
        a, b = [], []
        for at, x, y, t, w in zip(*(c.to_pylist() for c in batch.columns)):
            if at != cell:
                cell, terms, weights = at, {}, {}
            if y is None:
                terms[x], weights[x] = np.frombuffer(t, np.uint64), np.frombuffer(w, np.float64)
                continue
            own, other = terms[x], terms[y]
            if not len(own):
                continue
            place = np.minimum(own.searchsorted(other), len(own) - 1)
            same = own[place] == other
            if weights[x][place[same]] @ weights[y][same] >= threshold - 1e-9:
                a.append(x)
                b.append(y)
        kind = batch.schema.field(1).type
        yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], names=["a", "b"])


def _verify(pairs: DataFrame, homes: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """Pairs that reach the threshold. Texts are dealt into blocks, pairs into the cells of two blocks,
    and a vector goes once to every cell that needs it, however many pairs it has there. Partners
    mostly share a home, and so a block."""
    kind = pairs.schema["a"].dataType.simpleString()
    size = vectors.agg(F.sum(F.octet_length("terms") + F.octet_length("weights"))).first()[0] or 0
    blocks = 1 + size // _BLOCK_BYTES
    block = lambda c: homes.select(F.col("id").alias(c), F.pmod("home", F.lit(blocks)).alias("block_" + c))
    cells = pairs.join(block("a"), "a").join(block("b"), "b").select((F.col("block_a") * blocks + F.col("block_b")).alias("cell"), "a", "b")
    cells = materialised(cells)
    need = cells.select("cell", F.col("a").alias("id")).unionAll(cells.select("cell", F.col("b").alias("id"))).distinct()
    sent = need.join(vectors, "id").select("cell", F.col("id").alias("a"), F.lit(None).cast(kind).alias("b"), "terms", "weights")
    rows = sent.unionByName(cells, allowMissingColumns=True).repartition("cell").sortWithinPartitions("cell", F.col("b").isNotNull())
    return rows.mapInArrow(lambda batches: _verified(batches, threshold), f"a {kind}, b {kind}")


def near_pairs(words: DataFrame, *, threshold: float, max_terms: int = 4_000_000) -> DataFrame:
    """``a``, ``b`` (a < b) of every two texts whose TF-IDF cosine is at least ``threshold``.

    ``words``: ``id`` and ``words``, the array of a text's words, one row for each of different
    texts; read three times. Document frequencies of up to ``max_terms`` terms that texts share go
    to the workers as one array; more are joined.
    """
    kind = words.schema["id"].dataType.simpleString()
    hashed = words.select("id", word_hashes(F.col("words")).alias("words"))
    counted = hashed.mapInArrow(_frequencies, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    known = materialised(counted.where("df > 1 OR term IS NULL"))
    n = (known.where("term IS NULL").agg(F.sum("df")).first()[0]) or 0
    vocab = known.where("term IS NOT NULL")
    shared = None
    if vocab.count() <= max_terms:
        table = vocab.toArrow()
        shared = words.sparkSession.sparkContext.broadcast(Vocabulary(table["term"].to_numpy(), table["df"].to_numpy()))

    def mapped(rows: DataFrame, run: Callable[[Iterator[Part]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        if shared is not None:
            return rows.mapInArrow(lambda batches: run(_known(batches, shared.value)), schema)
        bags = rows.mapInArrow(_exploded, f"id {kind}, term bigint, tf bigint").join(vocab, "term", "left").withColumn("df", F.coalesce("df", F.lit(1)).cast("long"))
        bag = bags.groupBy("id").agg(F.collect_list(F.struct("term", "tf", "df")).alias("bag"))
        lists = bag.select("id", *[F.col(f"bag.{c}").alias(c) for c in ("term", "tf", "df")])
        return lists.mapInArrow(lambda batches: run(_joined(batches)), schema)

    postings = mapped(hashed, lambda parts: _postings(parts, n, threshold), f"term bigint, id {kind}, sketch binary")
    lists = postings.repartition("term").sortWithinPartitions("term")
    met = lists.mapInArrow(lambda batches: _pairs(batches, threshold), f"a {kind}, b {kind}")
    pairs = materialised(met.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ends = pairs.unionAll(pairs.select("b", "a")).groupBy(F.col("a").alias("id")).agg(F.min("b").alias("other"))
    homes = materialised(ends.select("id", F.xxhash64(F.least("id", "other")).alias("home")))
    some = words.join(bounded_broadcast(homes.select("id"), 500_000), "id", "left_semi").select("id", word_hashes(F.col("words")).alias("words"))
    vectors = materialised(mapped(some, lambda parts: _vectors(parts, n), f"id {kind}, terms binary, weights binary"))
    return checkpointed(_verify(pairs, homes, vectors, threshold))


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id``, ``term``, ``tf`` of every text."""
    for ids, text, term, tf in _bags(batches):
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(text)), pa.array(term.view(np.int64)), pa.array(tf.astype(np.int64))], names=["id", "term", "tf"])
