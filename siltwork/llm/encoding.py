"""Encoding a corpus with a public byte-level BPE vocabulary.

Pre-tokens are merged through a rank queue: a bucket for each merge rank holds the positions (in
a linked list of tokens) whose pair has that rank, and a bitmap of three levels finds the lowest
non-empty rank by find-first-set. An entry whose pair has changed since is stale and skipped, so
a pre-token of n bytes costs O(n log n), however long it is. Short pre-tokens repeat and are
remembered, up to a bound, by each Python worker.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: The pattern that splits text before the merges. (Fixed value of the vocabulary.)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> list[str]:
    """The printable character by which the vocabulary file writes each byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [], 256
    for b in range(256):
        if b in printable:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class RankQueue:
    """Positions by rank, smallest rank and then smallest position first."""

    def __init__(self, ranks: int) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * (ranks // 64 + 1)
        self.mid = [0] * (len(self.low) // 64 + 1)
        self.top = 0

    def push(self, rank: int, at: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [at]
            word, group = rank >> 6, rank >> 12
            self.low[word] |= 1 << (rank & 63)
            self.mid[group] |= 1 << (word & 63)
            self.top |= 1 << group
        else:
            heapq.heappush(bucket, at)

    def pop(self) -> tuple[int, int] | None:
        if not self.top:
            return None
        group = (self.top & -self.top).bit_length() - 1
        bits = self.mid[group]
        word = group << 6 | (bits & -bits).bit_length() - 1
        bits = self.low[word]
        rank = word << 6 | (bits & -bits).bit_length() - 1
        bucket = self.buckets[rank]
        at = heapq.heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.low[word] &= ~(1 << (rank & 63))
            if not self.low[word]:
                self.mid[group] &= ~(1 << (word & 63))
                if not self.mid[group]:
                    self.top &= ~(1 << group)
        return rank, at


class Encoder:
    """Ids of a text by a vocabulary: merges as (left id, right id) -> (rank, id)."""

    def __init__(self, byte_ids: list[int], merges: dict[tuple[int, int], tuple[int, int]], keep: int = 200_000) -> None:
        self.byte_ids, self.merges, self.keep = byte_ids, merges, keep
        self.queue = RankQueue(len(merges) + 1)
        self.known: dict[str, tuple[int, ...]] = {}
        self.split = regex.compile(PATTERN).findall

    def merge(self, token: bytes) -> list[int]:
        ids = [self.byte_ids[b] for b in token]
        n, merges, queue = len(ids), self.merges, self.queue
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for i in range(n - 1):
            if (m := merges.get((ids[i], ids[i + 1]))) is not None:
                queue.push(m[0], i)
        while (entry := queue.pop()) is not None:
            rank, i = entry
            j = after[i]
            if ids[i] < 0 or j >= n:
                continue
            m = merges.get((ids[i], ids[j]))
            if m is None or m[0] != rank:
                continue
            ids[i], ids[j] = m[1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (m := merges.get((ids[i], ids[k]))) is not None:
                    queue.push(m[0], i)
            h = before[i]
            if h >= 0 and (m := merges.get((ids[h], ids[i]))) is not None:
                queue.push(m[0], h)
        return [x for x in ids if x >= 0]

    def __call__(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        known, add = self.known, out.extend
        for word in self.split(text):
            ids = known.get(word)
            if ids is None:
                ids = tuple(self.merge(word.encode("utf-8", "surrogatepass")))
                if len(word) <= 64:
                    if len(known) >= self.keep:
                        known.clear()
                    known[word] = ids
            add(ids)
        return out


def load_vocabulary(path: str) -> tuple[list[int], dict[tuple[int, int], tuple[int, int]]]:
    """Byte ids and merges of a vocabulary file in the JSON form of byte-level BPE."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocab = model["vocab"]
    merges = {}
    for rank, pair in enumerate(model["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
    return [vocab[c] for c in byte_alphabet()], merges


#: The encoder of the vocabulary last used by this Python worker.
_encoders: dict[str, Encoder] = {}


def encode_corpus(
    df: DataFrame, *, text_col: str = "text", out_col: str = "ids", keep_cols: list[str] | None = None,
    vocabulary: str = DEFAULT_VOCABULARY,
) -> DataFrame:
    """``keep_cols`` (default: all but the text) and ``out_col``, the token ids of each text.

    The vocabulary (read once, on the driver; its size is fixed) reaches the workers as a
    broadcast variable. No special token is added, and strings that look like one are ordinary
    text. Null and empty texts give an empty list; rows are neither dropped nor merged; an empty
    table gives an empty table; a column already called ``out_col`` is replaced.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(load_vocabulary(vocabulary))
    keep = [c for c in (keep_cols if keep_cols is not None else df.columns) if c not in (out_col, *([text_col] if keep_cols is None else []))]
    source = df.select(F.col(f"`{text_col}`").alias("__sw_text"), *[F.col(f"`{c}`") for c in keep])
    schema = T.StructType([*source.schema.fields[1:], T.StructField(out_col, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(vocabulary)
        if encoder is None:
            _encoders.clear()
            encoder = _encoders[vocabulary] = Encoder(*shared.value)
        for b in batches:
            # Long texts: a batch is cut so that its ids stay far below the limits of Arrow.
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                lists = [np.asarray(encoder(x.as_py()), np.int32) for x in part.column(0)]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
                flat = pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.ListArray.from_arrays(pa.array(ends), flat)], names=[*part.schema.names[1:], out_col]
                )

    return source.mapInArrow(run, schema)
