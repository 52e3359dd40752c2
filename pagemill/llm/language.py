"""Language identification by bit-sliced Bloom filters of character n-grams.

Row i of the bit matrix is a bit mask of languages. An n-gram's k rows, ANDed, are the languages that contain it (besides
false positives); the bits of all n-grams of a text, counted for each language and corrected for the filters' false
positives, decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fold_of, sample_by_hash, slices, table

#: Labelled rows of a language that its filter is learned from, at most (in expectation); languages, the most frequent ones, at most.
MAX_TRAIN, MAX_LANGUAGES = 4_000, 1_024
#: n-grams that a language's filter holds, at most; share of the language's rows that must have one.
MAX_GRAMS, LEAST_SHARE = 4_000, 0.02
#: Rows of the bit matrix (a power of two) and rows that an n-gram sets.
SLICES, HASHES = 1 << 17, 3
#: Numbers of characters of the n-grams.
ORDERS = (3, 4)
#: n-grams that a filter holds at least to be evidence; share of a text's n-grams that some language has, below which it is foreign.
LEAST_GRAMS, LEAST_KNOWN = 200, 0.05
#: n-grams that a task holds before it passes their counts on.
HELD = 1_000_000
#: Characters whose n-grams are looked up at once.
CHARACTERS = 1 << 18

_LETTERS: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which code points are letters."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTERS


def codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, runs of others than letters as one space, a space at either end."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = letters()[raw]
    out = np.where(is_letter, raw, np.uint32(32))
    keep = is_letter.copy()
    keep[0] = True
    keep[1:] |= is_letter[:-1]
    return out[keep]


def grams(c: np.ndarray, order: int) -> np.ndarray:
    """A 64-bit hash of each n-gram; equal n-grams have equal hashes."""
    out = np.zeros(max(0, len(c) - order + 1), dtype=np.uint64)
    for i in range(order):
        out = out * np.uint64(0x1F123BB5) + c[i : len(c) - order + 1 + i].astype(np.uint64)
    out = (out ^ np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(29))


def blocks_of_grams(text: str) -> Iterator[np.ndarray]:
    """The hashes of a text's n-grams, those that begin in the same CHARACTERS characters together."""
    c = codes(text)
    for start in range(0, len(c), CHARACTERS):
        yield np.concatenate([grams(c[start : start + CHARACTERS + n - 1], n) for n in ORDERS])


def all_grams(text: str) -> np.ndarray:
    return np.concatenate(list(blocks_of_grams(text)))


def mixed(hashes: np.ndarray) -> np.ndarray:
    out = hashes * np.uint64(0xFF51AFD7ED558CCD)
    out = (out ^ (out >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return out ^ (out >> np.uint64(33))


def rows_of(mixed_: np.ndarray, k: int) -> np.ndarray:
    """The k-th row of each n-gram: bits of their own of one well-mixed hash, so that the rows tell nothing of each other."""
    return (mixed_ >> np.uint64(64 // HASHES * k)).astype(np.int64) & (SLICES - 1)


@dataclass(frozen=True)
class Filters:
    """languages in order; bits: (words of 64 languages, SLICES) masks; false: chance that a foreign n-gram passes; default: for texts without a known n-gram; held: n-grams in each filter."""

    languages: tuple[str, ...]
    bits: np.ndarray
    false: np.ndarray
    default: str | None
    held: np.ndarray

    def lookup(self, hashes: np.ndarray, word: int) -> np.ndarray:
        at = mixed(hashes)
        out = self.bits[word][rows_of(at, 0)]
        for k in range(1, HASHES):
            out = out & self.bits[word][rows_of(at, k)]
        return out

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """n-grams that each language contains, by its filter."""
        out = []
        for word in range(len(self.bits)):
            masks = self.lookup(hashes, word)
            masks = masks[masks != 0]
            for bit in range(min(64, len(self.languages) - 64 * word)):
                out.append(int(np.count_nonzero(masks & np.uint64(1 << bit))))
        return np.array(out, dtype=np.float64)

    def evidence(self, text: str) -> tuple[int, np.ndarray]:
        """The number of n-grams of a text, and of those that each language has, corrected for false positives."""
        n, hits = 0, np.zeros(len(self.languages))
        for h in blocks_of_grams(text):
            n, hits = n + len(h), hits + self.counts(h)
        return n, np.clip((hits - n * self.false) / (1 - self.false), 0, None)

    def keeps(self, text: str | None, lang: str | None) -> bool:
        """Whether a text has letters and is in a learned language. Without evidence (no language, or not the row's, could be learned) letters decide."""
        if not any(x.isalpha() for x in text or ""):
            return False
        learned = self.held >= LEAST_GRAMS
        if not learned.any() or lang is not None and not any(x == lang and y for x, y in zip(self.languages, learned, strict=True)):
            return True
        n, true = self.evidence(text)
        return bool(true.max() >= LEAST_KNOWN * n)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language, and its share of the corrected counts above the next language's, between 0 and 1."""
        if not self.languages or not any(x.isalpha() for x in text or ""):
            return ("und", 0.0)
        _, true = self.evidence(text)
        best = int(np.argmax(true))
        if true[best] <= 0:
            return (self.default or "und", 0.0)
        second = float(np.partition(true, -2)[-2]) if len(true) > 1 else 0.0
        return (self.languages[best], float(1 - second / (true[best] + 1e-9)))


def learn(docs: DataFrame, *, max_train: int = MAX_TRAIN) -> Filters:
    """Learns filters from the text and lang of docs (doc_id, text, lang). Rows where one of the three is null take no part.

    There are at most MAX_LANGUAGES filters, for the languages with most rows (ties: by name), of at most MAX_GRAMS n-grams each.
    """
    known = docs.select("doc_id", "text", "lang").where("doc_id is not null and text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()}
    if not sizes:
        return Filters((), np.zeros((1, SLICES), np.uint64), np.zeros(0), None, np.zeros(0))
    train = sample_by_hash(known.where(F.col("lang").isin(*sizes)), "doc_id", max_train, "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """n-grams and the number of this task's rows that have them; -1 for all rows, in pieces of bounded size."""
        held: dict[str, list[np.ndarray]] = {}

        def flush():
            for lang, parts in held.items():
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(keys) + 1)), pa.array(np.append(keys.view(np.int64), 0)), pa.array(np.append(n, len(parts)).astype(np.int64)), pa.array(np.append(np.zeros(len(keys), bool), True))], names=["lang", "gram", "n", "total"])
            held.clear()

        size = 0
        for batch in slices(batches, "text"):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                h = np.unique(all_grams(text))
                held.setdefault(lang, []).append(h)
                size += len(h)
                if size > HELD:
                    yield from flush()
                    size = 0
        yield from flush()

    schema = "lang string, gram long, n long, total boolean"
    counts = train.select("text", "lang").mapInArrow(count, schema).groupBy("lang", "gram", "total").agg(F.sum("n").alias("n"))
    totals = counts.where("total").select(F.col("lang").alias("of"), F.col("n").alias("rows"))
    kept = counts.where("not total").join(F.broadcast(totals), F.col("lang") == F.col("of")).where(F.col("n") >= F.greatest(F.lit(2), F.col("rows") * LEAST_SHARE))
    # the rank window sees at most what passes the share, which is bounded by a text's length / LEAST_SHARE
    top = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= MAX_GRAMS)
    languages = tuple(sorted(sizes))
    bits = np.zeros(((len(languages) + 63) // 64, SLICES), dtype=np.uint64)
    fill, held = np.zeros(len(languages)), np.zeros(len(languages))
    by_lang: dict[str, list[int]] = {}
    for r in top.select("lang", "gram").collect():
        by_lang.setdefault(r["lang"], []).append(r["gram"])
    for i, lang in enumerate(languages):
        hashes = mixed(np.array(by_lang.get(lang, []), dtype=np.int64).view(np.uint64))
        rows = np.unique(np.concatenate([rows_of(hashes, k) for k in range(HASHES)]))
        bits[i // 64][rows] |= np.uint64(1 << (i % 64))
        fill[i], held[i] = len(rows) / SLICES, len(hashes)
    return Filters(languages, bits, fill**HASHES, max(sizes, key=lambda x: (sizes[x], x)), held)


def predict(docs: DataFrame, filters: Filters, key: str = "doc_id") -> DataFrame:
    """key, lang_pred and score of each row; lang_pred is `und` for null texts and texts without a letter."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [filters.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([x for x, _ in found], pa.string()), pa.array([min(1.0, max(0.0, s)) for _, s in found], pa.float64())], names=[key, "lang_pred", "score"])

    return docs.select(key, "text").mapInArrow(run, f"{key} {kind}, lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = learn(docs.where(fold_of("doc_id", 4) != 2))
    return predict(docs, filters).select("doc_id", F.coalesce(fold_of("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows that have no language: null texts, texts without a letter, and texts that the filters hardly know.

    Rows of any id, repeated ones too, stay or go by their text; all columns stay. Where a row's own language has too few
    texts to be learned, and where none could be learned (an empty table, no lang at all), letters decide.
    """
    filters = learn(docs)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield batch.filter(pa.array([filters.keeps(t, lang) for t, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
