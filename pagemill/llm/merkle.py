"""Document fingerprints: Merkle trees over sections, paragraphs and short pieces of text.

A fingerprint reads `root.section.section...`; a section reads `hash~size(paragraph paragraph...)`, a paragraph
`hash~size:pieces`, sizes in characters; a piece has four signs of its hash and one of its length. Equal texts have equal roots;
unequal branches lead to the edits; the share of characters in equal branches is the likeness of two texts. Paragraphs and
pieces end where the text itself says so, so an edit moves few others.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import slices, table

#: A paragraph ends with its line, but no earlier than after so many characters.
PARAGRAPH = re.compile(r".{32,}?(?:\n+|$)|.+", re.DOTALL)
#: A section ends after an empty line, and after one paragraph in so many, by its hash.
PARAGRAPHS = 8
#: A piece has SHORTEST to LONGEST characters, and a space if it ends with one of ENDS and a space, where there is one.
SHORTEST, LONGEST, ENDS = 8, 63, "dnstrey.,;:!?"
PIECE = re.compile(rf".{{{SHORTEST},{LONGEST}}}?(?:(?<=[{ENDS}]) |$)|.{{{LONGEST}}}|.+", re.DOTALL)
#: The first HEAD characters of a text are cut in parts of PART, so that the shortest texts have several pieces too.
HEAD, PART = 24, 4
#: Rows of a range of ids that one task orders, about; ranges at most.
RANGE_ROWS, MAX_RANGES = 4_000, 10_000
#: Rows of one id, or without one, are dealt out in so many parts by a hash of their texts.
PARTS = 64
_SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
_PAIRS = [a + b for a in _SIGNS for b in _SIGNS]
_LENGTH = {c: i + 1 for i, c in enumerate(_SIGNS)}
PIECE_SIGNS = 5


def pieces_of(text: str, first: bool) -> list[str]:
    head = [text[i : i + PART] for i in range(0, min(len(text), HEAD), PART)] if first else []
    return head + PIECE.findall(text, HEAD if first else 0)


def fingerprint(text: str) -> str:
    sections, paragraphs, size = [], [], 0

    def close() -> None:
        nonlocal size
        if paragraphs:
            inside = " ".join(paragraphs)
            sections.append(f"{xxh3_64_intdigest(inside):016x}~{size}({inside})")
            paragraphs.clear()
            size = 0

    for p in PARAGRAPH.findall(text):
        signs = []
        for x in pieces_of(p, not sections and not paragraphs):
            h = xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"))
            signs += (_PAIRS[h & 4095], _PAIRS[h >> 12 & 4095], _SIGNS[len(x) - 1])
        h = xxh3_64_intdigest(p.encode("utf-8", "surrogatepass"))
        paragraphs.append(f"{h:016x}~{len(p)}:{''.join(signs)}")
        size += len(p)
        if h % PARAGRAPHS == 0 or p.endswith("\n\n"):
            close()
    close()
    root = hashlib.blake2b(" ".join(s[: s.index("(")] for s in sections).encode(), digest_size=16).hexdigest()
    return ".".join([root, *sections])


#: A node: its label (hash and size) and what is below it.
Section = tuple[str, str]


def root_of(fp: str) -> str:
    return fp.split(".", 1)[0]


def sections_of(fp: str) -> list[Section]:
    return [tuple(s[:-1].split("(", 1)) for s in fp.split(".")[1:]]


def paragraphs_of(inside: str) -> list[Section]:
    return [tuple(p.split(":", 1)) for p in inside.split(" ")]


def size_of(label: str) -> int:
    return int(label[label.index("~") + 1 :])


def parsed(fp: str) -> list[tuple[str, list[Section]]]:
    """(section's label, [(paragraph's label, pieces)]) of a fingerprint."""
    return [(label, paragraphs_of(inside)) for label, inside in sections_of(fp)]


def unequal(a: list[Section], b: list[Section]) -> tuple[list[Section], list[Section], int]:
    """Nodes of either side that the other side doesn't have, as often as it has more of them; and the size of those both have."""
    one, other = Counter(label for label, _ in a), Counter(label for label, _ in b)
    both = one & other
    size = sum(size_of(label) * n for label, n in both.items())

    def left(nodes: list[Section]) -> list[Section]:
        held = Counter(both)
        out = []
        for node in nodes:
            if held[node[0]] > 0:
                held[node[0]] -= 1
            else:
                out.append(node)
        return out

    return left(a), left(b), size


def likeness(a: str, b: str) -> float:
    """Share of the characters of both that are in equal branches, 0 to 1; 1 if the roots are equal.

    Equal sections, then equal paragraphs of unequal sections, then equal pieces of unequal paragraphs count, wherever they
    stand, so that only unequal branches are looked into.
    """
    if root_of(a) == root_of(b):
        return 1.0
    one, other = sections_of(a), sections_of(b)
    total = sum(size_of(label) for label, _ in one) + sum(size_of(label) for label, _ in other)
    one, other, common = unequal(one, other)
    one, other, size = unequal([p for _, x in one for p in paragraphs_of(x)], [p for _, x in other for p in paragraphs_of(x)])
    common += size
    x, y = (Counter(s[i : i + PIECE_SIGNS] for _, s in side for i in range(0, len(s), PIECE_SIGNS)) for side in (one, other))
    common += sum(min(n, y[k]) * _LENGTH[k[-1]] for k, n in x.items() if k in y)
    return min(1.0, 2 * common / total) if total else 0.0


def differences(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) of a whose branch b doesn't have; sections and paragraphs that b has anywhere are skipped whole."""
    if root_of(a) == root_of(b):
        return []
    mine, theirs = sections_of(a), sections_of(b)
    known = {label for label, _ in theirs}
    left = [(i, x) for i, (label, x) in enumerate(mine) if label not in known]
    if not left:
        return []
    paragraphs = {label for _, x in theirs for label, _ in paragraphs_of(x)}
    return [(i, j) for i, x in left for j, (label, _) in enumerate(paragraphs_of(x)) if label not in paragraphs]


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by the beginning of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def hot_part(text: str) -> Column:
    """The part of a row among those of one id: by a hash of its text, by which they are also in order."""
    return F.least(F.floor((F.xxhash64(text) / F.lit(float(1 << 63)) + 1) / 2 * PARTS), F.lit(PARTS - 1)).cast("int")


def with_next(docs: DataFrame, key: str, make, schema: str) -> DataFrame:
    """make([(key, text, text of the next row)]) of each row; the first row follows the last.

    key is a number. Rows are in order of key, null keys last; rows of one key in order of a hash of their texts. Rows are dealt
    out by ranges of the key, ids that many rows have (null among them) by ranges of that hash too. Each range also gets the
    first row of the next range that has rows, marked as a guest, so that no range needs another and nothing but the ranges'
    bounds passes the driver.
    """
    if docs.schema[key].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{key} must be an integer")
    docs = docs.select(F.col(key).cast("long").alias("_key"), F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.select(F.col("_key").cast("double").alias("_id"))
    wanted = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MAX_RANGES, ids.count() // RANGE_ROWS))
    cuts = ids.stat.approxQuantile("_id", [i / wanted for i in range(1, wanted)], min(0.01, 0.25 / wanted)) if wanted > 1 else []
    inner = sorted(set(cuts))
    # an id that is a cut several times has the rows of several ranges; so may have the null id, which is no number
    hot = sorted(int(x) for x in inner if cuts.count(x) > 1)
    keyed = docs.withColumn("_id", F.col("_key").cast("double"))
    if inner:
        keyed = Bucketizer(splits=[-float("inf"), *inner, float("inf")], inputCol="_id", outputCol="_in").transform(keyed)
    else:
        keyed = keyed.withColumn("_in", F.when(F.col("_id").isNotNull(), 0.0))
    of = F.coalesce(F.col("_in").cast("int"), F.lit(len(inner) + 1))
    split = F.col("_key").isNull() | F.col("_key").isin(hot)
    placed = keyed.select("_key", "text", F.xxhash64("text").alias("_order"), of.alias("_of"), F.when(split, hot_part("text")).otherwise(PARTS).alias("_part"))  # after the parts of the hot id that begins a range
    first = F.struct("_key", "_order")
    firsts = placed.groupBy("_of", "_part").agg(F.min(first).alias("_first"))  # a row for each range, PARTS for a hot one
    order = Window.orderBy("_of", "_part")
    numbered = firsts.select("_of", "_part", "_first", (F.row_number().over(order) - 1).alias("_range"), F.count("*").over(Window.partitionBy()).alias("_n"))
    bounds = numbered.select("_of", "_part", "_range", "_first", F.pmod(F.col("_range") - 1, "_n").cast("int").alias("_host"))
    ranged = placed.join(F.broadcast(bounds), ["_of", "_part"])
    guests = ranged.where((F.col("_key").eqNullSafe(F.col("_first._key"))) & (F.col("_order") == F.col("_first._order")))
    guests = guests.groupBy("_host").agg(F.first("_key").alias("_key"), F.first("_order").alias("_order"), F.min("text").alias("text"))
    guests = guests.select("_key", "text", "_order", F.col("_host").alias("_range"), F.lit(1).alias("_guest"))
    both = ranged.select("_key", "text", "_order", "_range", F.lit(0).alias("_guest")).unionByName(guests)
    # each partition gets the ranges of its own number, so that none has several while others have none
    dealt = both.repartitionById(wanted, F.col("_range").cast("int")).sortWithinPartitions("_range", "_guest", F.asc_nulls_last("_key"), "_order", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in slices(batches, "text"):
            rows = []
            for k, text, of, guest in zip(*(batch.column(c).to_pylist() for c in ("_key", "text", "_range", "_guest")), strict=True):
                if held and held[2] == of:
                    rows.append((held[0], held[1], text))
                held = None if guest else (k, text, of)
            if rows:
                yield make(rows)

    return dealt.mapInArrow(run, schema)


def fingerprints(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_chars, edited_sha256, both fingerprints, their likeness, the likeness to the next row, and in how many paragraphs the edited text differs.

    Null texts count as empty. Rows without an id come last; rows of one id follow each other in an order of their own.
    """
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_differences"]

    def make(rows: list[tuple]) -> pa.RecordBatch:
        out, last = [], ("", "")
        for k, text, following in rows:
            after = edited(text, following)
            own = last[1] if last[0] == text and last[1] else fingerprint(text)
            changed, beside = fingerprint(after), fingerprint(following)
            out.append((k, len(text), hashlib.sha256(after.encode("utf-8", "surrogatepass")).hexdigest(), own, changed, likeness(own, changed), likeness(own, beside), len(differences(changed, own))))
            last = (following, beside)
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return with_next(docs, key, make, f"{key} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_differences long")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
