from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanlode.llm import chunk_split as cs
from tests.conftest import rows

KEY = "memory_uid string, chunk_ordinal int, chunk_heading string, chunk_text string, indexed_at timestamp, status string, file_path string, piece string, _text string"


def check(text, limit, overlap, least):
    spans = cs.split(text, limit, overlap, least)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(0 <= b - a <= limit for a, b in spans)
    strength = cs.strengths(text)
    for a, b in zip(spans, spans[1:]):  # the overlap, and what it takes to begin with a whole character
        exact = a[1] - overlap
        assert b[0] == exact or b[0] < exact and strength[b[0]] != cs.NEVER and (strength[b[0] + 1 : exact + 1] == cs.NEVER).all()
        assert strength[b[0]] != cs.NEVER or (strength[a[0] + 1 : exact + 1] == cs.NEVER).all()
    assert len(spans) == 1 or all(b - a >= least for a, b in spans[:-1])
    return spans


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n,#é́‍\r漢。", max_size=300))
def test_pieces_cover_and_overlap(text):
    spans = check(text, 40, 8, 20)
    strength = cs.strengths(text)
    for a, b in spans[:-1]:  # the strongest boundary of the window, the rightmost of equals
        window = strength[a + 20 : a + 41]
        assert b == a + 20 + len(window) - 1 - int(np.argmax(window[::-1]))


def test_natural_boundaries_win():
    text = "word " * 100 + "\n\n" + "more words. " * 100
    assert cs.split(text, 600, 50, 300)[0][1] == 502
    assert cs.split("x" * 1000, 400, 40, 200)[0] == (0, 400)
    assert cs.split("é" * 500, 400, 40, 200)[0][1] % 2 == 0


def test_pieces_begin_with_whole_characters():
    for unit in ("e\u0301", "क\u093f", "👩\u200d💻", "\r\n", "o\u0302\u0323"):
        text = unit * 700
        spans = check(text, 400, 41, 200)
        assert len(spans) > 2 and all(a % len(unit) == 0 for a, _ in spans)
    check("a" + "\u0301" * 3000, 400, 41, 200)


def test_very_long_text():
    text = ("Sentence number one goes here. " * 40 + "\n\n") * 1500
    assert len(text) > 1_500_000
    check(text, 1200, 120, 600)


def test_latest_revision_nulls_copies_and_clashing_columns(spark):
    t = datetime(2025, 1, 1), datetime(2025, 2, 1)
    long, short = "word " * 400, "short"
    data = [("a", 0, "h", short, t[0], None, None, "x", "y"), ("a", 0, "h", long, t[1], "s", None, "x", "y"), ("a", 0, "h", long, t[1], "s", None, "x", "y"), ("a", 1, None, short, t[0], None, "p", "x", "y"), ("b", 0, None, None, t[0], None, None, None, None), ("c", 0, "", "", None, None, None, None, None)]
    latest = cs.latest_chunks(spark.createDataFrame(data, KEY))
    assert latest.count() == 4
    got = cs.split_long(latest, "chunk_text", ["memory_uid", "chunk_ordinal"])
    assert rows(got, "memory_uid", "chunk_ordinal", "piece", "pieces") == [("a", 0, 0, 2), ("a", 0, 1, 2), ("a", 1, 0, 1), ("c", 0, 0, 1)]
    assert cs.split_long(latest.limit(0), "chunk_text", ["memory_uid"]).collect() == []
    with pytest.raises(ValueError):
        cs.split_long(latest, "chunk_text", ["memory_uid"], 100, 60, 50)
