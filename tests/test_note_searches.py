import math
import random

from spanlode.operators import notes
from tests.conftest import rows

CHUNKS = "memory_uid string, chunk_ordinal int, status string, file_status string, title string, chunk_heading string, chunk_text string, symbol_text string"


def chunks(spark, data):
    return spark.createDataFrame([(u, o, "active", "active", t, "", x, None) for u, o, t, x in data], CHUNKS)


def asked(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def test_groups_and_blocks_give_what_all_pairs_give(spark, monkeypatch):
    """Many groups of chunks and blocks of queries, ties among them, against every score by itself."""
    monkeypatch.setattr(notes, "GROUP", 7)
    monkeypatch.setattr(notes, "BLOCK", 2)
    r, words = random.Random(4), "ab cd ef gh ij kl straße 42".split()
    data = [(f"u{i // 3:02}", i % 3, r.choice(words), " ".join(r.choices(words, k=r.randint(0, 5)))) for i in range(60)]
    texts = ["ab, cd!", "CD ab", "ef", "none", "", "Straße 42 ab", "gh ij kl ef"]
    found = {t: sum(t in f"{a} {b}".split() for _, _, a, b in data) for t in words}
    want = []
    for q, text in enumerate(texts):
        terms = {t for t in text.lower().replace(",", "").replace("!", "").split() if found.get(t)}
        scores = []
        for uid, at, *fields in data:
            held = sum(b * math.sqrt(f.split().count(t)) / math.sqrt(len(f.split())) * (1 + math.log(60 / found[t])) ** 2 for t in terms for b, f in zip((2.0, 1.0), fields) if t in f.split())
            scores += [(-round(held, 6), uid, at)] * (held > 0)
        best = {}
        for s, uid, at in sorted(scores)[:5]:
            best.setdefault(uid, (q, uid, at, -s))
        want += best.values()
    got = rows(notes.searches(chunks(spark, data), asked(spark, texts), 5), "query_id", "memory_uid", "chunk_ordinal", "score")
    assert [x[:3] for x in got] == [x[:3] for x in sorted(want)] and all(abs(x[3] - y[3]) < 2e-6 for x, y in zip(got, sorted(want)))


def test_scores_of_chunks_are_not_exchanged(spark):
    df = notes.searches(chunks(spark, [("a", 0, "x", "y")]), asked(spark, ["x"]))
    exchanges = [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "hashpartitioning(asked" in x]
    assert exchanges and not any("chunk_ordinal" in x for x in exchanges)
