"""Files that nobody wrote by hand for their project: generated, minified, vendored or data stored as code.

Every file becomes a set of hashed five-token shingles in which identifiers, short strings and small numbers are masked.
Phrases without a literal are the language's and everybody's, so the set keeps the shingles that hold one. A file that
has too few of those keeps all if it repeats itself, and else is described by its shingles unmasked: masked, there would
be too little to tell it by. A file made of literals has its literals masked, or nothing if it is short. Files with the
same set are one class. Classes meet through MinHash bands, each band's members against some of them at a time and at
the end those that missed each other, and a meeting counts only if the exact Jaccard similarity of the two sets is at
least 0.8; connected classes form a family. A family of several files that are made of literals is data; another whose
files lie in several projects is a vendored copy; one that repeats the same masked phrases over and over, or that recurs
under other names within one project, is the output of a tool. Files that do nothing but name, import and export
modules are alike everywhere and form no family.

What has no family is found by other means, tests of each file by itself that neither come from nor follow a family: a
lone file of many literals, hashes of known third-party files, notices of generators and headers of releases in
comments, and the layout of minified scripts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlode.llm import lexers
from spanlode.llm.syntax import language_of
from spanlode.plans.runtime import cut, salt_of, written

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 32, 6  # a pair of similarity s shares a band in 1 - (1 - s ** ROWS) ** BANDS of all cases: 99.994 % at 0.8
SHORT_STRING = 6  # with its quotes; shorter strings and numbers of up to two digits are masked
LEAST_LITERAL_SHINGLES = 10  # from which only shingles with a literal count
LEAST_TOKENS = 60  # under which a file that repeats itself, or is made of literals, is described unmasked
SALTS = 16
SMALL_BAND, STEP = 256, 8  # members left of a band that all meet at once; growth of the pivots of a larger one by round
HOT_PIVOT = 5_000  # meetings of one class in a round from which they are dealt over SALTS parts
REPEATS = 4.0  # tokens per different phrase from which a file repeats itself
LEAST_LITERAL_BYTES = 400
LITERAL_TOKENS, LITERAL_BYTES = 0.6, 0.7
MINIFIED_TOKENS_A_LINE, MINIFIED_NAME = 60, 3.8
SEPARATORS = frozenset(",:;-()[]{}")
BLOCK = 2_000  # shingles hashed at once

_DRAWN = np.random.Generator(np.random.PCG64(20240229))
_A = _DRAWN.integers(0, 2**63, BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_B = _DRAWN.integers(0, 2**63, BANDS * ROWS).astype(np.uint64)
_WEIGHTS = np.array([pow(1000003, i, 2**32) for i in range(SHINGLE)], dtype=np.uint64)
_BAND_WEIGHTS = np.array([pow(6364136223846793005, i, 2**64) for i in range(ROWS)], dtype=np.uint64)

#: What generators write at the start of a comment line, in any case.
NOTICES = (
    r"code generated by .{1,80}do not edit",
    r"@generated\b",
    r"</?auto-?generated\b",
    r"auto-?generated(?: file)?[.:]",
    r"auto(?:matically)?[- ]?generated (?:by|from|file|code)\b",
    r"(?:this|the following) (?:file|code|source|module|class)(?: is| was| has been)? (?:auto(?:matically)?[- ]?)?(?:generated|produced|emitted|created) (?:by|from)\b",
    r"generated (?:by|from|with) .{1,80}(?:do not (?:edit|modify)|not edit|modify)",
    r"do not (?:edit|modify)(?: by hand)?[:;.! -]+.{0,20}(?:produced|generated|emitted) (?:by|from)\b",
    r"(?:machine|tool)[- ](?:written|generated|made) (?:by|from)\b",
    r"built by .{1,80}(?:edits?|changes?) .{0,40}(?:not survive|lost|overwritten)",
    r"fichier (?:produit|généré|créé) par\b",
    r"diese (?:datei|klasse) wurde (?:automatisch |maschinell )?(?:von|mit|durch|aus)? ?.{0,60}(?:erzeugt|generiert|erstellt)",
    r"est[ea] (?:archivo|fichero|clase) (?:fue|ha sido|es) generad[oa]\b",
    r"compiled by .{1,60} from\b",
)
_COMMENT = r"^[ \t﻿]*(?://+[!/]?|#+!?|/\*+!?|\*+|<!--|--|\"\"\"|''')?[ \t]*"
_NOTICE = re.compile(_COMMENT + "(?:" + "|".join(NOTICES) + ")|^[ \t]*@(?:javax?\\.annotation\\.(?:processing\\.)?|jakarta\\.annotation\\.)?Generated\\b", re.M | re.I)
#: Without one of these no notice can match.
_WORDS = ("generated", "produced", "produit", "erzeugt", "generiert", "written", "machine", "survive", "lost", "overwritten", "généré", "generad", "emitted", "compiled by", "créé", "erstellt", "created")
#: A line that names a release and its rights, as third-party headers have it.
_RELEASE, _RIGHTS = re.compile(r"\b\w[\w.-]* (?:- )?(?:v|release |version )?\d+\.\d+(?:\.\d+)+\b", re.I), re.compile(r"licen[cs]e|copyright|\(c\)|©|redistribut", re.I)


#: Lines that name, import and export modules, by language; what a file has besides is its own.
MARKER_LINES = {
    "go": r"package \w+|import .*|\)|(?:[\w.]+\s+)?\"[^\"]*\"",
    "java": r"(?:package|import) .*;",
    "rust": r"(?:pub(?:\([^)]*\))? )?(?:mod \w+;|use [^;]*;?|extern crate .*;)|[\w:, {}]*[},;]+|#!?\[.*\]",
    "python": r"from\s+[\w.]+\s+import\s.*|import\s.*|__\w+__\s*=.*|[\])]|[\w, ]+,|(?:\"[^\"]*\"|'[^']*'),?",
    "javascript": r"export \*.*|export (?:type )?\{[^}]*\}?.*|import .*|\}? ?from .*|[\w, ]+,|['\"]use strict['\"];?",
}
MARKER_LINES["typescript"] = MARKER_LINES["javascript"]
_MARKER = {k: re.compile(rf"\s*(?:(?:{v})\s*)?(?://.*|#[^!\[].*)?" if k != "python" else rf"\s*(?:(?:{v})\s*)?(?:#.*)?") for k, v in MARKER_LINES.items()}
_BLOCKS = re.compile(r"/\*[\s\S]*?\*/|\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''")


def is_marker(name: str, text: str) -> bool:
    """Whether the file does nothing but name, import and export modules."""
    return all(_MARKER[name].fullmatch(line) for line in _BLOCKS.sub("", text).split("\n"))


class _Tokens(dict):
    """Token texts to (hash, separator, class), the class in the lowest two bits: 0 other, 1 literal, 2 identifier, 3 small number or
    short string; above them a bit for separators. Texts that aren't in the table yet are added."""

    def __init__(self, name: str):
        super().__init__()
        self.fixed, self.words = lexers.language(name).fixed, lexers.words(name)

    def __missing__(self, text: str) -> int:
        c = text[0]
        if text in self.fixed:
            kind = 0
        elif c.isalpha() and not (len(text) > 1 and text[-1] in "\"'") or c in "_$#" and len(text) > 1:
            kind = 2
        elif c.isdigit() and len(text) <= 2 or c in "\"'`" and len(text) <= SHORT_STRING:
            kind = 3
        elif c in "\"'`" or c.isdigit() or text[-1] in "\"'#" and len(text) > 1:
            kind = 1
        else:
            kind = 0
        hashed = 1 if kind == 2 else 2 if kind == 3 else zlib.crc32(text.encode())
        if len(self) > 300_000:
            self.clear()
        n = self[text] = hashed << 3 | (text in SEPARATORS) << 2 | kind
        return n


_TABLES: dict[str, _Tokens] = {}


def _in_string(lang: lexers.Language, text: str, at: int) -> bool:
    """Whether the position lies in a string of the program; a text that is
    a statement of its own is documentation."""
    first = True
    for m in lang.pattern.finditer(text):
        word = m[1]
        if not word or word.isspace() or word.startswith("/*"):
            continue
        if m.start(1) > at:
            return False
        if m.start(1) <= at < m.end(1):
            alone = text.rfind("\n", 0, m.start(1)) == m.start(1) - 1 and text[m.end(1) : m.end(1) + 1] in ("", "\n")
            return word[-1] in "\"'`" and not (first or alone and word[:3] in ('"""', "'''"))
        first = False
    return False


def has_notice(name: str, text: str) -> bool:
    """Whether a comment of the file, or an annotation, says that a tool wrote the file."""
    low = text.lower()
    if not any(w in low for w in _WORDS):
        return False
    lang = lexers.language(name)
    return any(not _in_string(lang, text, m.end() - 1) for m in _NOTICE.finditer(text))


def third_party_header(text: str) -> bool:
    """Whether the comment that opens the file names a release and its rights; a project's own header has no release."""
    top = []
    for line in text.lstrip().split("\n", 6)[:6]:
        if not re.match(r"\s*(?://|#|/?\*)", line):
            break
        top.append(line)
    head = "\n".join(top)
    return bool(_RELEASE.search(head) and _RIGHTS.search(head))


def band_hashes(shingles: np.ndarray) -> np.ndarray:
    """The MinHash bands of a set of 32-bit shingles."""
    least = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(shingles), BLOCK):
        hashed = shingles[at : at + BLOCK].astype(np.uint64)[:, None] * _A
        hashed += _B
        np.minimum(least, hashed.min(axis=0), out=least)
    least = (least >> np.uint64(32)).reshape(BANDS, ROWS)
    bands = (least * _BAND_WEIGHTS).sum(axis=1, dtype=np.uint64) * np.uint64(31) + np.arange(BANDS, dtype=np.uint64)
    return bands.view(np.int64)


class Features(NamedTuple):
    """What is known of one file: see ``features``."""

    tokens: int = 0
    phrases: int = 0
    plain: bool = False
    marker: bool = False
    literal_only: bool = False
    minified: bool = False
    notice: bool = False
    header: bool = False
    literals: bool = False
    shingles: np.ndarray = np.zeros(0, dtype=np.int32)
    bands: np.ndarray = np.zeros(0, dtype=np.int64)


def _shingled(hashes: np.ndarray) -> np.ndarray:
    """A 32-bit hash of every five consecutive tokens; a shorter text is filled up to one."""
    if len(hashes) < SHINGLE:
        hashes = np.concatenate([hashes, np.zeros(SHINGLE - len(hashes), dtype=np.uint64)])
    mixed = np.zeros(len(hashes) - SHINGLE + 1, dtype=np.uint64)
    for i in range(SHINGLE):
        mixed += hashes[i : i + len(mixed)] * _WEIGHTS[i]
    mixed ^= mixed >> np.uint64(33)
    mixed *= np.uint64(0xFF51AFD7ED558CCD)
    return (mixed >> np.uint64(32)).astype(np.uint32)


def _distinct(shingles: np.ndarray) -> np.ndarray:
    shingles = np.sort(shingles)
    first = np.ones(len(shingles), dtype=bool)
    np.not_equal(shingles[1:], shingles[:-1], out=first[1:])
    return shingles[first]


def _total_length(words: list[str], chosen: np.ndarray) -> int:
    return sum(map(len, map(words.__getitem__, np.flatnonzero(chosen).tolist())))


def features(name: str, content: bytes) -> Features:
    """The file's set of shingles and its bands, tokens, different phrases, and whether it is described ``plain``
    (unmasked), a ``marker``, ``literals`` by share, ``literal_only`` by size too, ``minified``, or has a ``notice`` or a
    third-party ``header``."""
    text = content.decode("utf-8", "replace").removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    table = _TABLES.get(name) or _TABLES.setdefault(name, _Tokens(name))
    words = list(filter(None, table.words.findall(text)))
    notice, header = has_notice(name, text), third_party_header(text)
    if not words:
        return Features(notice=notice, header=header)
    codes = np.fromiter(map(table.__getitem__, words), np.int64, len(words))
    kinds = (codes & 3).astype(np.int8)
    long_literal = kinds == 1
    literal = long_literal | (kinds == 3)
    separators = np.count_nonzero(codes & 4)
    share = np.count_nonzero(literal) / max(1, len(codes) - separators)
    literal_bytes = _total_length(words, literal)
    literals = share >= LITERAL_TOKENS or literal_bytes >= LITERAL_BYTES * max(1, len(text))
    only = literals and literal_bytes >= LEAST_LITERAL_BYTES
    minified = False
    if name in ("javascript", "typescript") and not only and len(codes) > MINIFIED_TOKENS_A_LINE * (text.count("\n") + 1):
        named = kinds == 2
        n = np.count_nonzero(named)
        minified = len(codes) >= 200 and n > 0 and _total_length(words, named) / n < MINIFIED_NAME
    hashes = (codes >> 3).astype(np.uint64)
    mixed = _shingled(np.where(literal, np.uint64(3), hashes) if literals else hashes)
    shingles = _distinct(mixed)
    phrases, plain = len(shingles), len(codes) < LEAST_TOKENS
    if not literals:
        held = np.concatenate([[0], np.cumsum(long_literal)])
        own = _distinct(mixed[held[SHINGLE:] > held[:-SHINGLE]]) if len(codes) >= SHINGLE else mixed[:0]
        if len(own) >= LEAST_LITERAL_SHINGLES and len(codes) >= LEAST_TOKENS:
            shingles = own
        else:
            plain |= len(codes) < REPEATS * phrases
    if plain:
        whole = np.array([zlib.crc32(w.encode()) for w in words], dtype=np.uint64)
        shingles = _distinct(_shingled(whole))
    marker = is_marker(name, text)
    return Features(len(codes), phrases, plain, marker, only, minified, notice, header, literals, shingles.view(np.int32), band_hashes(shingles))


def described(files: DataFrame) -> DataFrame:
    """One row per row of ``files`` (file_id, project_id, path, content) of a known extension with its features."""
    rows = files.where(F.col("file_id").isNotNull()).select(
        "file_id", F.coalesce("project_id", F.lit(-1)).alias("project_id"), F.xxhash64("path").alias("place"), language_of(F.col("path")).alias("language"), F.sha2("content", 256).alias("sha"), "content"
    )
    rows = rows.where(F.col("language").isNotNull())
    flags = ("plain", "marker", "literal_only", "minified", "notice", "header", "literals")
    schema = f"file_id long, project_id long, place long, language string, sha string, tokens int, phrases int, {', '.join(f'{f} boolean' for f in flags)}, shingles array<int>, bands array<long>"
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), *[pa.bool_() for _ in flags], pa.list_(pa.int32()), pa.list_(pa.int64())]
    out = pa.schema(list(zip([f.split()[0] for f in schema.split(", ")], types, strict=True)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(name, c.as_py() or b"") for name, c in zip(batch.column(3).to_pylist(), batch.column(5), strict=True)]
            cols = [batch.column(i).cast(out.field(i).type) for i in range(5)]
            cols += [pa.array([f[i] for f in found], out.field(5 + i).type) for i in range(len(Features._fields))]
            yield pa.RecordBatch.from_arrays(cols, schema=out)

    return rows.mapInArrow(work, schema)


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(class_id, pivot, share, n, similar): the exact Jaccard similarity of pairs of classes and the size of the first
    one's set. The meetings of a pivot that has many are dealt over parts, and its set goes to each of them."""
    hot = pairs.groupBy("pivot").agg(F.count("*").alias("meetings")).select(F.col("pivot").alias("p"), F.when(F.col("meetings") > HOT_PIVOT, SALTS).otherwise(1).alias("parts"))
    met = pairs.join(hot, F.col("pivot") == F.col("p")).select("class_id", "pivot", F.pmod(F.xxhash64("class_id"), F.col("parts")).alias("salt"))
    left = sets.select(F.col("class_id"), F.col("shingles").alias("x"))
    right = sets.join(hot, F.col("class_id") == F.col("p")).select(F.col("p").alias("pivot"), F.col("shingles").alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("salt"))
    both = met.join(left, "class_id").join(right, ["pivot", "salt"]).withColumn("common", F.size(F.array_intersect("x", "y")))
    either = F.size("x") + F.size("y") - F.col("common")
    return both.select("class_id", "pivot", (F.col("common") / either).alias("share"), F.size("x").alias("n"), (F.col("common") >= SIMILAR * either).alias("similar"))


def _clusters(rows: DataFrame) -> DataFrame:
    """(class_id, family): classes connected by pairs that share a band and are similar; classes without such a pair have no row.

    In every round each band's members meet some of themselves, the pivots: one in the first, ``STEP`` times as many in
    each round after it, and from the second all of them where no more than ``SMALL_BAND`` are left. Pivots and members
    similar to one leave, the others go on until none are left. Bands so end after two rounds, and larger ones of n
    classes that aren't alike after log(n) to the base ``STEP``: each round's plans and jobs stay in the driver's memory.
    Hardly more pairs meet than have to, since each member left unlike all others must have met them. Only classes that share a band with another are carried on,
    and only theirs are the sets that get exchanged. What never met is one member that left with a pivot and one that
    was unlike it: such pairs meet at the end, unless they are of one family by then or can't be similar by their sizes
    or by their distances to the pivot (Jaccard distance keeps the triangle inequality)."""
    banded = rows.select("class_id", F.explode(F.transform("bands", lambda b: F.xxhash64(b, "language"))).alias("band"))
    first = banded.groupBy("band").agg(F.min("class_id").alias("least"), F.max("class_id").alias("most")).where(F.col("least") < F.col("most"))
    members = cut(banded.join(first.select("band"), "band", "left_semi").distinct())  # copies of a file end here
    needed = members.select("class_id").distinct()
    sets = cut(rows.select("class_id", "shingles").join(needed, "class_id", "left_semi").groupBy("class_id").agg(F.max("shingles").alias("shingles")))
    met_all, wanted = None, 1
    while True:
        size = members.groupBy("band").agg(F.min("class_id").alias("least"), F.count("*").alias("n"))
        sized = members.join(size, "band")
        chosen = F.pmod(F.xxhash64("class_id", "band", F.lit(wanted)), F.col("n")) < wanted - 1
        chosen |= F.col("n") <= (SMALL_BAND if wanted > 1 else 1)
        sized = sized.withColumn("chosen", (F.col("class_id") == F.col("least")) | chosen)
        pivots = sized.where("chosen").select("band", F.col("class_id").alias("pivot"))
        met = cut(sized.select("class_id", "band", "chosen").join(pivots, "band").where((F.col("class_id") != F.col("pivot")) & (~F.col("chosen") | (F.col("class_id") > F.col("pivot")))))
        judged = cut(_compared(met.select("class_id", "pivot").distinct(), sets))
        met_all = judged if met_all is None else met_all.unionByName(judged)
        told = met.where(~F.col("chosen")).join(judged.select("class_id", "pivot", "similar"), ["class_id", "pivot"])
        members = cut(told.groupBy("class_id", "band").agg(F.max("similar").alias("leaves")).where(~F.col("leaves")).select("class_id", "band"))
        if members.isEmpty():
            break
        wanted *= STEP
    reach = 1 - SIMILAR + 1e-9
    close = cut(met_all.where("similar").distinct())
    links = close.select(F.col("class_id").alias("a"), F.col("pivot").alias("b"))
    family = _families(links)
    stayed = met_all.where(~F.col("similar") & (F.col("share") >= SIMILAR - reach)).select(F.col("class_id").alias("b"), "pivot", F.col("share").alias("b_share"), F.col("n").alias("b_n")).distinct()
    own = stayed.join(family.select(F.col("class_id").alias("b"), F.col("family").alias("b_family")), "b", "left")
    apart = own.join(family.select(F.col("class_id").alias("pivot"), "family"), "pivot").where(~F.col("family").eqNullSafe(F.col("b_family")))
    apart = apart.select("b", "pivot", "b_share", "b_n", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    left = close.select(F.col("class_id").alias("a"), "pivot", "share", "n", salt_of("class_id", salts=SALTS).alias("salt"))  # one class can be the pivot of many
    may = (F.col("share") - F.col("b_share") <= reach) & (F.least("n", "b_n") >= SIMILAR * F.greatest("n", "b_n"))
    late = left.join(apart, ["pivot", "salt"]).where(may).select(F.col("a").alias("class_id"), F.col("b").alias("pivot")).distinct()
    more = cut(_compared(late, sets).where("similar").select(F.col("class_id").alias("a"), F.col("pivot").alias("b")))
    return family if more.isEmpty() else _families(links.unionByName(more))


def _families(links: DataFrame) -> DataFrame:
    """(class_id, family): the smallest class each class is connected to; classes without links have no row.
    Rounds write tables: what a checkpoint would tell the optimiser of its columns doubles with every round."""
    edges = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("family")))
    while True:
        seen = edges.join(labels.select(F.col("a").alias("b"), F.col("family").alias("other")), "b").groupBy("a").agg(F.min("other").alias("other"))
        jump = labels.select(F.col("a").alias("family"), F.col("family").alias("root"))
        grown = labels.join(seen, "a").join(jump, "family", "left")
        grown = written(grown.select("a", F.least("family", "other", F.coalesce("root", F.col("family"))).alias("now"), "family"))
        labels = grown.select("a", F.col("now").alias("family"))
        if grown.where(F.col("now") != F.col("family")).isEmpty():
            return labels.withColumnRenamed("a", "class_id")


def origins(files: DataFrame, known: DataFrame) -> DataFrame:
    """(file_id, kind): files that aren't hand-written, once per kind: ``vendored``, ``generated`` and ``data`` by family,
    ``known``, ``notice``, ``header``, ``literals`` and ``minified`` by the file itself.

    Files of unknown extension and null ids are left out; null and empty contents are never named. Redelivered rows
    and a file that comes back under its path in its project count as one file. Files of any size have a family if they
    have a like; only those that name, import and export modules and do nothing else have none. Files described unmasked
    are copies if their family lies in several projects; within one project that says nothing. A file of literals that
    has no other of its shape is named from ``LEAST_LITERAL_BYTES`` on, so that short lists kept by hand stay. ``known``
    has sha256.
    """
    rows = cut(described(files).withColumn("class_id", F.xxhash64("language", "shingles")))
    counted = rows.where((F.col("tokens") > 0) & ~F.col("marker"))
    per_class = counted.groupBy("class_id").agg(
        F.min("project_id").alias("p0"), F.max("project_id").alias("p1"), F.min("place").alias("f0"), F.max("place").alias("f1"),
        F.max("tokens").alias("tokens"), F.max("phrases").alias("phrases"), F.min("literals").alias("literals"), F.max("plain").alias("plain"),
    )
    per_class = cut(per_class)
    family = _clusters(counted.select("class_id", "language", "bands", "shingles"))
    placed = per_class.join(family, "class_id", "left").withColumn("family", F.coalesce("family", "class_id"))
    whole = placed.groupBy("family").agg((F.min("p0") < F.max("p1")).alias("several_projects"), (F.min("f0") < F.max("f1")).alias("several_places"), F.min("literals").alias("of_literals"), F.max("plain").alias("of_plain"))
    judged = placed.join(whole, "family").withColumn("repeats", F.col("tokens") >= REPEATS * F.col("phrases"))
    blobs = F.when(F.col("several_projects") | F.col("several_places"), "data")
    kind = F.when(F.col("of_plain"), F.when(F.col("several_projects"), F.when(F.col("of_literals"), "data").otherwise("vendored"))).when(F.col("of_literals"), blobs).when(F.col("repeats"), "generated").when(F.col("several_projects"), "vendored").when(F.col("several_places"), "generated")
    by_class = judged.select("class_id", kind.alias("kind")).where(F.col("kind").isNotNull())
    clustered = counted.select("file_id", "class_id").join(by_class, "class_id").select("file_id", "kind")
    single = rows.select("file_id", F.explode(F.filter(F.array(
        F.when(F.col("literal_only"), "literals"), F.when(F.col("notice"), "notice"), F.when(F.col("header"), "header"), F.when(F.col("minified"), "minified")), lambda k: k.isNotNull())).alias("kind"))
    listed = known.where(F.col("sha256") != "").select(F.lower("sha256").alias("sha")).distinct()
    listed = rows.where(F.col("tokens") > 0).join(listed, "sha", "left_semi").select("file_id", F.lit("known").alias("kind"))
    return clustered.unionByName(single).unionByName(listed).distinct()
