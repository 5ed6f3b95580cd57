"""Splitting oversized texts at natural boundaries (problem 1).

Recursive bisection: a text is cut at the boundary of the strongest kind that it
has (blank line, sentence end, whitespace, else any code point), of these the
one nearest to its middle. The halves are cut again while they exceed the limit
less the overlap, or, where that would break a paragraph that fits, the limit.
Every piece but the first then gets up to the overlap of the text before it, as
far as the limit allows. The boundaries of a text are found once; each bisection
looks them up by binary search, so a text of n characters costs O(n) plus
O(log n) for a piece. The level of a text is the weakest kind that it was cut at.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WS = " \t\r\n"
_BLANK = re.compile(r"(?:\r\n|\n|\r(?!\n))[ \t]*(?:\r\n|\n|\r(?!\n))[ \t\r\n]*")
_SENTENCE = re.compile(r"(?<=[.!?])[ \t\r\n]+")
_SPACE = re.compile(r"[ \t\r\n]+")
LEVELS = ("paragraph", "sentence", "word", "forced")


def boundaries(text: str) -> list[list[int]]:
    """Offsets at which a following piece may start, strongest level first."""
    return [[m.end() for m in rx.finditer(text) if 0 < m.end() < len(text)] for rx in (_BLANK, _SENTENCE, _SPACE)]


def split_spans(text: str, limit: int, overlap: int) -> tuple[str, list[tuple[int, int, int]]]:
    """The level of the weakest cut, and (start with overlap, start, end) of each piece.

    The spans start..end tile the text, but for whitespace at the ends of a span that
    exceeds the limit by it alone. Texts within the limit are one piece; of a longer
    one without anything but whitespace, as much as the limit holds is.
    """
    n = len(text)
    if n <= limit:
        return LEVELS[0], [(0, 0, n)]
    cuts, room, cores, weakest = boundaries(text), limit - overlap, [], 0
    stack = [(0, n)]
    while stack:
        lo, hi = stack.pop()
        at, level = _strongest(cuts, lo, hi)
        if hi - lo <= (limit if lo == 0 or level else room):
            cores.append((lo, hi))
            continue
        if level:
            a, b = _trimmed(text, lo, hi)
            if b - a <= limit:
                if a < b:
                    cores.append((a, b))
                continue
        weakest = max(weakest, level)
        stack += [(at, hi), (lo, at)]
    spans = []
    for lo, hi in cores or [(0, limit)]:
        start = lo
        if lo and overlap:
            reach = max(0, lo - min(overlap, limit - (hi - lo)))
            words = cuts[2]
            k = bisect_left(words, reach)
            start = words[k] if k < len(words) and words[k] < lo else reach
        spans.append((start, lo, hi))
    return LEVELS[weakest], spans


def _trimmed(text: str, lo: int, hi: int) -> tuple[int, int]:
    while lo < hi and text[lo] in WS:
        lo += 1
    while lo < hi and text[hi - 1] in WS:
        hi -= 1
    return lo, hi


def _strongest(cuts: list[list[int]], lo: int, hi: int) -> tuple[int, int]:
    """(offset, level) of the boundary of the strongest kind within lo..hi that is nearest to its middle; else the middle."""
    mid = (lo + hi) // 2
    for level, offsets in enumerate(cuts):
        a, b = bisect_right(offsets, lo), bisect_left(offsets, hi)
        if a < b:
            k = bisect_left(offsets, mid, a, b)
            return min((offsets[j] for j in (k - 1, k) if a <= j < b), key=lambda x: abs(x - mid)), level
    return mid, len(cuts)


PIECES = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("page_ordinal", T.LongType()),
        T.StructField("text_key", T.StringType()),
        T.StructField("cut_level", T.StringType()),
        T.StructField("piece_no", T.IntegerType()),
        T.StructField("n_pieces", T.IntegerType()),
        T.StructField("start_at", T.IntegerType()),
        T.StructField("overlap", T.IntegerType()),
        T.StructField("piece", T.StringType()),
    ]
)


def _pieces(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for *place, text in zip(*(c.to_pylist() for c in batch.columns)):
                level, spans = split_spans(text, limit, overlap)
                for k, (start, core, end) in enumerate(spans):
                    rows.append((*place, level, k + 1, len(spans), start, core - start, text[start:end]))
                    size += end - start
                if size > 4_000_000:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=PIECES.fieldNames())

    return run


def split_oversized(df: DataFrame, id_col: str, text_col: str, limit: int = 2000, overlap: int = 200, file_col: str | None = None, ordinal_col: str | None = None) -> DataFrame:
    """Pieces of every text of more than ``limit`` code points: ``PIECES``.

    * Pieces have at most ``limit`` code points, come in reading order and share up to
      ``overlap`` of them with the piece before; they never cross rows.
    * Null, empty and shorter texts give no rows, nor does an empty table; exact
      repeats of id, text, file and ordinal give one set of pieces. Null ids are kept.
    * With ``file_col`` or ``ordinal_col`` the rows come in reading order: by file, ordinal,
      id, ``text_key`` and ``piece_no``, nulls last in each; without both in no order.
    * ``text_key`` is a hash of the whole text: it tells the texts of one id apart.
    * Only the columns named are read, whatever else ``df`` has; fields not named are null.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    named = lambda c, kind: (F.col(c) if c else F.lit(None)).cast(kind)
    long = df.select(
        F.col(id_col).cast("string").alias("id"), named(file_col, "string").alias("source_file"), named(ordinal_col, "bigint").alias("page_ordinal"), F.sha2(F.col(text_col), 256).alias("text_key"), F.col(text_col).alias("text")
    )
    long = long.where(F.length("text") > limit).distinct()
    if file_col or ordinal_col:
        long = long.orderBy(*[F.col(c).asc_nulls_last() for c in ("source_file", "page_ordinal", "id", "text_key")])
    return long.mapInArrow(_pieces(limit, overlap), PIECES)
