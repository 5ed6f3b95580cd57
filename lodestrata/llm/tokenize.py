"""Encoding of whole texts with a public byte-level BPE vocabulary (problem 8).

Each text is cut into words by the vocabulary's own pattern. A word that is not
a token itself is merged over a contiguous array: part boundaries with the rank
of the pair that starts at each of them. The smallest rank is found by a scan,
its boundary deleted and the two neighbouring ranks refreshed, until no pair
has a rank. Long words, for which repeated scans would be quadratic, keep the
same boundaries in a heap. Words recur, so the ids of each are remembered.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NONE = 1 << 60
#: Words of more bytes than this are merged over a heap.
SCAN_BYTES = 256
#: Words remembered per worker; the memory is bounded, the results don't depend on it.
REMEMBERED = 400_000
_loaded: dict[str, "Encoder"] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.words = ranks, regex.compile(pattern)
        self.known: dict[str, list[int]] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> "Encoder":
        """One encoder per worker process and vocabulary."""
        if path not in _loaded:
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
            _loaded[path] = cls(ranks, pattern)
        return _loaded[path]

    def merge(self, word: bytes) -> list[int]:
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        return self._merge_scan(word) if len(word) <= SCAN_BYTES else self._merge_heap(word)

    def _merge_scan(self, word: bytes) -> list[int]:
        rank = self.ranks.get
        n = len(word)
        starts = list(range(n + 1))
        pair = [rank(word[i : i + 2], _NONE) for i in range(n - 1)] + [_NONE, _NONE]
        while True:
            low = min(pair)
            if low == _NONE:
                break
            i = pair.index(low)
            del starts[i + 1]
            del pair[i + 1]
            pair[i] = rank(word[starts[i] : starts[i + 2]], _NONE) if i + 2 < len(starts) else _NONE
            if i:
                pair[i - 1] = rank(word[starts[i - 1] : starts[i + 1]], _NONE)
        return [self.ranks[word[a:b]] for a, b in zip(starts, starts[1:])]

    def _merge_heap(self, word: bytes) -> list[int]:
        rank, n = self.ranks.get, len(word)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        alive = bytearray([1]) * n

        def pair(i: int) -> int:
            j = after[i]
            return rank(word[i : after[j]], _NONE) if j < n else _NONE

        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(word[i : i + 2], _NONE)) != _NONE]
        heapq.heapify(heap)
        while heap:
            r, i, end = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if not alive[i] or j >= n or after[j] != end or pair(i) != r:
                continue
            alive[j] = 0
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (r := pair(k)) != _NONE:
                    heapq.heappush(heap, (r, k, after[after[k]]))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[word[i : after[i]]])
            i = after[i]
        return out

    def encode(self, text: str) -> list[int]:
        known, merge, ids = self.known, self.merge, []
        for word in self.words.findall(text):
            got = known.get(word)
            if got is None:
                got = merge(word.encode("utf-8", "replace"))
                if len(word) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[word] = got
            ids += got
        return ids


def encode_texts(df: DataFrame, id_col: str, text_col: str, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """Ids of every row: ``id_col`` and ``ids`` (array of int), without special tokens.

    Null and empty texts have an empty list. Texts that hold the spelling of a
    special token are ordinary text. Every row gives one row, repeats included;
    ids may be null. Other columns are not read.
    """
    path, pat = vocabulary or default_vocabulary(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.load(path, pat)
        for batch in batches:
            ids = [encoder.encode(t) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["key", "ids"])

    src = df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    out = T.StructType([T.StructField("key", src.schema["key"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return src.mapInArrow(run, out).select(F.col("key").alias(id_col), "ids")


def token_counts(df: DataFrame, id_col: str, text_col: str, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """``id_col`` and ``n_tokens`` of every row; 0 for null and empty texts."""
    path, pat = vocabulary or default_vocabulary(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.load(path, pat)
        for batch in batches:
            n = [len(encoder.encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["key", "n_tokens"])

    src = df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    out = T.StructType([T.StructField("key", src.schema["key"].dataType), T.StructField("n_tokens", T.LongType())])
    return src.mapInArrow(run, out).select(F.col("key").alias(id_col), "n_tokens")
