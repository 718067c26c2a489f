import sys
import unicodedata

from spanlode.llm import leakage
from tests.conftest import rows

ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
DOCS = "doc_id long, text string, item_id long, gram string"


def test_format_characters_are_all_known():
    assert all(bool(leakage._FORMAT.match(chr(i))) == (unicodedata.category(chr(i)) == "Cf") for i in range(sys.maxunicode + 1))


def docs(spark):
    wide = "".join(chr(ord(c) + 0xFEE0) if c != " " else "\u3000" for c in ITEM)
    data = [
        (1, f"before {ITEM} after"), (2, ITEM.upper().replace(" ", "_ -- ")), (3, "x " + wide), (4, ITEM.replace("seven", "se\u00adven\u200b")),
        (5, " ".join(ITEM.split()[:11])), (6, "y " + " ".join(ITEM.split()[:12])), (7, None), (8, ""), (9, ITEM.replace("six", "6")), (1, f"before {ITEM} after"), (10, ("filler " * 50_000) + ITEM),
    ]
    return spark.createDataFrame([(*d, 0, "g") for d in data], DOCS)


def test_passages_are_the_same_for_any_number_of_sets(spark):
    items = spark.createDataFrame([(70, ITEM), (71, ITEM + " shared"), (72, None), (73, "short text"), (70, ITEM)], "item_id long, text string")
    want = sorted((i, d) for i in (70, 71) for d in (1, 2, 3, 4, 6, 10))
    by_set = leakage.leaks(docs(spark), "doc_id", "text", items, "item_id", "text")
    assert rows(by_set.select("item_id", "doc_id").distinct(), "item_id", "doc_id") == want
    in_parts = leakage.leaks(docs(spark), "doc_id", "text", items, "item_id", "text", part_chars=70)
    assert sorted(in_parts.collect()) == sorted(by_set.collect())
    assert by_set.where("doc_id = 1").count() == 4  # delivered twice, found twice, whatever the number of sets


def test_scan_equals_brute_force():
    import random

    rng = random.Random(5)
    items = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 30)))) for i in range(20)]
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 60))) for _ in range(60)]
    got = {(r, *hit) for r, hits in leakage.Grams(items, 4).scan(texts).items() for hit in hits}
    want = set()
    for r, t in enumerate(texts):
        w = t.split()
        for i, x in items:
            y = x.split()
            held = {tuple(y[k : k + 4]) for k in range(len(y) - 3)}
            want |= {(r, i, k, k + 3) for k in range(len(w) - 3) if tuple(w[k : k + 4]) in held}
    assert got == want and want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert leakage.leaks(docs(spark), "doc_id", "text", none, "item_id", "text").collect() == []
    items = spark.createDataFrame([(70, ITEM)], "item_id long, text string")
    assert leakage.leaks(docs(spark).limit(0), "doc_id", "text", items, "item_id", "text").collect() == []


def test_cleaning(spark):
    items = spark.createDataFrame([(70, ITEM)], "item_id long, text string")
    d = docs(spark).where("doc_id in (1, 10)").distinct()
    got = {r.doc_id: r for r in leakage.cleaned(d, "doc_id", "text", leakage.leaks(d, "doc_id", "text", items, "item_id", "text")).collect()}
    assert got[1].dropped and got[1].kept_text is None
    assert got[10].kept_text.strip() == ("filler " * 50_000).strip()
