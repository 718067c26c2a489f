"""Splitting texts above a size limit at natural boundaries, with an overlap.

Every position between two characters has a boundary strength. A sparse table over the strengths answers "strongest
boundary in this window, the rightmost one of equals" in constant time; each piece ends at the answer for the window
of lengths it may have, and the next piece starts ``overlap`` characters before that end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strength of a cut after what the pattern matches. Later entries win over weaker earlier ones.
BOUNDARIES = (
    (1, r"[　-〿぀-ヿ㐀-鿿豈-﫿가-힯฀-๿]"),  # scripts without spaces
    (2, r"\s+"),
    (3, r"[,;:)\]}、，；：]+\s*"),
    (4, r"(?:[.!?…؟۔।]+[\"'”’)\]]*(?=\s|$)\s*|[。！？｡]+[」』”’）]*\s*)"),
    (5, r"(?:\r\n|\r|\n| )[^\S\r\n]*"),
    (6, r"(?:\r\n|\r|\n)[^\S\r\n]*(?:(?:\r\n|\r|\n)[^\S\r\n]*)+| "),
    (7, r"(?:\r\n|\r|\n)\s*(?=#{1,6}\s)"),
)
_PATTERNS = [(s, re.compile(p)) for s, p in BOUNDARIES]
NEVER = -1
BLOCK = 1 << 16
#: Marks that belong to the character before them, joiners and variation selectors.
_BOUND = re.compile(r"[\u0300-\u036f\u0483-\u0489\u0591-\u05bd\u064b-\u065f\u0900-\u0903\u093a-\u094f\u0e31\u0e34-\u0e3a\u0e47-\u0e4e\u1ab0-\u1aff\u1dc0-\u1dff\u200d\u20d0-\u20ff\u3099\u309a\ufe00-\ufe0f\ufe20-\ufe2f\U0001f3fb-\U0001f3ff]")


def strengths(text: str) -> np.ndarray:
    """strength[i] of a cut before character i, for 0 <= i <= len(text); ``NEVER`` inside a character with its marks."""
    out = np.zeros(len(text) + 1, dtype=np.int8)
    for strength, pattern in _PATTERNS:
        ends = [m.end() for m in pattern.finditer(text)]
        if ends:
            out[ends] = np.maximum(out[ends], strength)
    if not text.isascii():
        for m in _BOUND.finditer(text):
            out[m.start()] = NEVER
            if m[0] == "‍":
                out[m.end()] = NEVER
    for m in re.finditer("\r\n", text):
        out[m.start() + 1] = NEVER
    return out


def sparse_table(strength: np.ndarray) -> list[np.ndarray]:
    """level[k][i] is the position of the strongest of strength[i : i + 2**k], the rightmost of equals."""
    levels = [np.arange(len(strength))]
    span = 1
    while 2 * span <= len(strength):
        below = levels[-1]
        left, right = below[: len(below) - span], below[span:]
        levels.append(np.where(strength[right] >= strength[left], right, left))
        span *= 2
    return levels


def strongest(strength: np.ndarray, levels: list[np.ndarray], first: int, last: int) -> int:
    """Position of the strongest cut in first..last, both included; the rightmost of equals."""
    k = (last - first + 1).bit_length() - 1
    left, right = int(levels[k][first]), int(levels[k][last - (1 << k) + 1])
    return right if strength[right] >= strength[left] else left


def split(text: str, limit: int, overlap: int, least: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of ``text``: at most ``limit`` long, neighbours share ``overlap`` code points, and as
    many more as it takes to begin with a whole character, each but the last at least ``least`` long. Together they
    cover the text; a text within the limit is one piece."""
    if len(text) <= limit:
        return [(0, len(text))]
    strength = strengths(text)
    base, levels, pieces, start = 0, [], [], 0
    while len(text) - start > limit:
        if not levels or start + limit >= base + len(levels[0]):
            base = start  # the table covers a block at a time, so a text of any length needs no more
            levels = sparse_table(strength[base : base + BLOCK + limit])
        end = base + strongest(strength[base:], levels, start + least - base, start + limit - base)
        pieces.append((start, end))
        before, start = start, end - overlap
        while start > before + 1 and strength[start] == NEVER:
            start -= 1  # to the first code point of a character
        if strength[start] == NEVER:
            start = end - overlap  # one character longer than a piece
    pieces.append((start, len(text)))
    return pieces


def split_long(df: DataFrame, text: str, keys: list[str], limit: int = 1200, overlap: int = 120, least: int = 600) -> DataFrame:
    """One row per piece of each text: ``keys``, piece (from 0), pieces, start, n_chars, piece_text.

    Sizes are in code points. A null text gives no row, an empty one a single empty piece. Each text is cut on its own,
    so copies give the same pieces again. Other columns are not carried, so their names can't clash; ``keys`` must not
    be among the result's names.
    """
    if not 0 <= overlap < least <= limit:
        raise ValueError("0 <= overlap < least <= limit must hold")
    rows = df.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("_text"))
    schema = rows.select(*keys, F.lit(0).alias("piece"), F.lit(0).alias("pieces"), F.lit(0).alias("start"), F.lit(0).alias("n_chars"), F.lit("").alias("piece_text")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = None
        for batch in batches:
            row, piece, pieces, start, size, out = [], [], [], [], [], []
            for i, t in enumerate(batch.column(len(keys)).to_pylist()):
                spans = split(t, limit, overlap, least)
                for k, (a, b) in enumerate(spans):
                    row.append(i), piece.append(k), pieces.append(len(spans)), start.append(a), size.append(b - a), out.append(t[a:b])
            cols = [batch.column(j).take(pa.array(row, pa.int64())) for j in range(len(keys))]
            cols += [pa.array(x, pa.int32()) for x in (piece, pieces, start, size)] + [pa.array(out, pa.string())]
            target = target or pa.schema([batch.schema.field(j) for j in range(len(keys))] + [pa.field(n, t) for n, t in (("piece", pa.int32()), ("pieces", pa.int32()), ("start", pa.int32()), ("n_chars", pa.int32()), ("piece_text", pa.string()))])
            yield pa.RecordBatch.from_arrays(cols, schema=target)

    return rows.mapInArrow(work, schema)


def latest_chunks(chunks: DataFrame) -> DataFrame:
    """Of each (memory_uid, chunk_ordinal) the row with the latest ``indexed_at``; of equals the one with the greatest
    heading and text. A null time counts as the earliest. Keys are near unique, so no group is large."""
    key = ["memory_uid", "chunk_ordinal"]
    rest = ["indexed_at", "chunk_heading", "chunk_text", "status", "file_path"]
    return chunks.groupBy(*key).agg(F.max(F.struct(*rest)).alias("_r")).select(*key, "_r.*")
