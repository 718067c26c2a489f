"""Evaluation texts inside training texts.

Texts become runs of normalised words. All word n-grams of the test items form a hash set that every task gets; items
of more than ``PART_CHARS`` characters together come in several such sets, each scanned by itself. Each training text
is scanned once a set, all its windows hashed together, and a window whose hash is in the set counts only if its words
equal those of a test item.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 12
PART_CHARS = 8_000_000  # with n-grams of 12 words and six characters a word, a set takes about 80 MB in a worker
#: Odd multipliers of the rolling hash.
_MULTIPLY, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_WORD = re.compile(r"[^\W_]+")
_FORMAT = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0xAD, 0xAD), (0x600, 0x605), (0x61C, 0x61C), (0x6DD, 0x6DD), (0x70F, 0x70F), (0x890, 0x891), (0x8E2, 0x8E2), (0x180E, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x206F), (0xFEFF, 0xFEFF), (0xFFF9, 0xFFFB), (0x110BD, 0x110BD), (0x110CD, 0x110CD), (0x13430, 0x1343F), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0001, 0xE0001), (0xE0020, 0xE007F))) + "]")  # category Cf


def normal(text: str) -> str:
    """Without format characters, NFKC, case folded."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKC", _FORMAT.sub("", text)).casefold()
    return _FORMAT.sub("", unicodedata.normalize("NFKC", text))


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits of the normalised text, in order."""
    return _WORD.findall(normal(text))


def _window_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every n consecutive ids, all windows at once."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * _MULTIPLY
    x ^= x >> np.uint64(29)
    out = np.zeros(len(ids) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = (out * _MIX) + x[i : i + len(out)]
    return out ^ (out >> np.uint64(31))


class Grams:
    """The n-grams of the test items: vocabulary, the items' words in one row, and the sorted hashes of its windows with
    their places; 24 bytes an n-gram besides the words."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.n, self.vocabulary = n, {}
        flat, owner = [], []
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            flat += [*ids, -1]
            owner += [item] * (len(ids) + 1)
        self.flat, self.owner = np.array(flat, dtype=np.int32), np.array(owner, dtype=np.int64)
        self.places = _clear(self.flat, n)
        hashes = _window_hashes(self.flat, n)[self.places] if len(self.places) else np.zeros(0, dtype=np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.places = hashes[order], self.places[order]

    def scan(self, texts: list[str | None]) -> dict[int, list[tuple[int, int, int]]]:
        """{row: [(item, first word, last word)]} of the texts that hold an n-gram of an item."""
        n, get = self.n, self.vocabulary.get
        ids, starts = [], []
        for t in texts:
            starts.append(len(ids))
            if t:
                ids.extend(get(w, -1) for w in words(t))
            ids.append(-1)
        flat, found = np.array(ids, dtype=np.int32), {}
        clear = _clear(flat, n)
        if not len(clear) or not len(self.hashes):
            return found
        hashes = _window_hashes(flat, n)[clear]
        first, last = np.searchsorted(self.hashes, hashes, side="left"), np.searchsorted(self.hashes, hashes, side="right")
        hit = np.flatnonzero(last > first)
        rows = np.searchsorted(np.array(starts), clear[hit], side="right") - 1
        for p, r, a, b in zip(clear[hit].tolist(), rows.tolist(), first[hit].tolist(), last[hit].tolist(), strict=True):
            window = flat[p : p + n]
            for at in self.places[a:b].tolist():
                if np.array_equal(self.flat[at : at + n], window):
                    found.setdefault(r, []).append((int(self.owner[at]), p - starts[r], p - starts[r] + n - 1))
        return found


def _clear(flat: np.ndarray, n: int) -> np.ndarray:
    """Where windows of n known words begin; -1 stands for other words and ends a text."""
    unknown = np.concatenate([[0], np.cumsum(flat < 0)])
    return np.flatnonzero(unknown[n:] == unknown[:-n]) if len(flat) >= n else np.zeros(0, dtype=np.int64)


@lru_cache(maxsize=2)
def _grams(items: tuple[tuple[int, str], ...], n: int) -> Grams:
    return Grams(list(items), n)


def _spans(hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(item, first, last) with the overlapping windows of an item merged."""
    out = []
    for item, a, b in sorted(hits):
        if out and out[-1][0] == item and a <= out[-1][2] + 1:
            out[-1] = (item, out[-1][1], max(b, out[-1][2]))
        else:
            out.append((item, a, b))
    return out


def leaks(corpus: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, n: int = WORDS, part_chars: int = PART_CHARS) -> DataFrame:
    """(item_id, doc_id, first_word, last_word): every passage of at least ``n`` consecutive words that an item and a
    text share, as the longest run of words that items' n-grams cover.

    Null, empty and short texts or items give no rows; texts under several keys are found under each; repeated rows
    give repeated passages. Both keys must be longs. Other columns are never read. Items are dealt over as many sets as
    keep each within about ``part_chars`` characters, an item whole in one set; the result is the same for any number.
    """
    known = items.where(F.col(item_text).isNotNull()).select(F.col(item_key).alias("i"), F.col(item_text).alias("t")).distinct()
    size = known.agg(F.sum(F.length("t"))).first()[0] or 0
    parts = max(1, -(-size // part_chars))
    docs = corpus.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("d"), F.col(text).alias("t"))
    out = None
    for part in range(parts):
        held = known.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part) if parts > 1 else known
        found = _scanned(docs, tuple(sorted((r.i, r.t) for r in held.collect())), n)  # about part_chars characters
        out = found if out is None else out.unionByName(found)
    return out


def _scanned(docs: DataFrame, items: tuple[tuple[int, str], ...], n: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = _grams(shared.value, n)
        for batch in batches:
            ids = batch["d"].tolist()
            out = [(item, ids[r], a, b) for r, hits in grams.scan(batch["t"].tolist()).items() for item, a, b in _spans(hits)]
            yield pd.DataFrame(out, columns=["item_id", "doc_id", "first_word", "last_word"]).astype({"item_id": "int64", "doc_id": "int64", "first_word": "int32", "last_word": "int32"})

    return docs.mapInPandas(work, "item_id long, doc_id long, first_word int, last_word int")


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words first..last of each span and what stands between them.

    Word positions are those of ``words``; they are found in the text by normalising it character by character, so a
    text in which normalising joins or parts words across characters keeps at most the odd neighbour too few.
    """
    at, inside = [], False
    for i, c in enumerate(text):
        n = normal(c)
        if not n:
            continue
        if _WORD.fullmatch(n):
            if not inside:
                at.append([i, i + 1])
            at[-1][1] = i + 1
            inside = True
        else:
            inside = False
    keep, last = [], 0
    for a, b in sorted(spans):
        if a < len(at):
            begin, end = at[a][0], at[min(b, len(at) - 1)][1]
            keep.append(text[last : max(last, begin)])
            last = max(last, end)
    return "".join(keep) + text[last:]


def cleaned(corpus: DataFrame, key: str, text: str, found: DataFrame, most_share: float = 0.5) -> DataFrame:
    """(doc_id, kept_text, removed_spans, dropped) of each affected text: leaked passages are cut out; where more than
    ``most_share`` of the characters would go, the text is dropped whole (``kept_text`` null)."""
    spans = found.groupBy("doc_id").agg(F.collect_set(F.struct("first_word", "last_word")).alias("spans"))  # spans of one text
    rows = corpus.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t")).join(spans, "doc_id")

    @F.pandas_udf("string")
    def cut_out(t: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([without_spans(x, [(y["first_word"], y["last_word"]) for y in ss]) for x, ss in zip(t, s, strict=True)])

    out = rows.withColumn("kept", cut_out("t", "spans"))
    gone = F.length("kept") < F.length("t") * (1 - most_share)
    return out.select("doc_id", F.when(~gone, F.col("kept")).alias("kept_text"), F.size("spans").alias("removed_spans"), gone.alias("dropped"))
