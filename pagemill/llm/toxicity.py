"""Toxicity by a weighted lexicon.

Texts are folded (case, homoglyphs, accents, digit and sign substitutions), an Aho-Corasick automaton finds the
lexicon's terms in one pass, phrases that excuse a term take its weight back, and the sum is divided by the length.
The lexicon, its weights, the exception phrases and the threshold are learned from labelled rows.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, most_frequent, sample_by_hash, slices, table, written

#: Labelled rows that a lexicon is learned from, at most (in expectation).
MAX_TRAIN = 30_000
#: Terms that are counted in clean rows, and that a lexicon keeps, at most.
MAX_CANDIDATES, MAX_TERMS, MAX_EXCEPTIONS = 50_000, 2_000, 2_000
#: Different terms that a task counts at a time.
HELD = 100_000
#: Lengths of a term in characters, without the space before it.
SHORTEST, LONGEST = 4, 12
#: Words that a text's length counts as having besides its own, so that short texts need more than a chance hit.
EXTRA_WORDS = 20.0
#: Bins of log density from which the threshold is chosen.
BINS, LOWEST, HIGHEST = 400, -9.0, 3.0

HOMOGLYPHS = dict(zip("аеорсухіѕјкмтвнгԁԛԝһαοεικνρτυχβη", "aeopcyxisjkmtbhrdqwhaoeikvptuxbn", strict=True))
SUBSTITUTES = dict(zip("0134578@$", "oieastbas", strict=True))


class Folding(dict):
    """A table for str.translate that fills itself: letters to their plain lower-case form, other characters to a space."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        folded = "".join(HOMOGLYPHS.get(x, SUBSTITUTES.get(x, x)) for x in plain)
        out = folded if folded and all(x.isalnum() for x in folded) else "" if unicodedata.category(c) in ("Mn", "Cf") else " "
        self[code] = out
        return out


FOLDING = Folding()


def fold(text: str | None) -> str:
    """Plain lower-case words with a space before and after each."""
    return f" {' '.join((text or '').translate(FOLDING).split())} "


def grams(words: Iterable[str]) -> set[str]:
    """Beginnings of words, each with the space before it; the space after a word counts as its last character."""
    out = set()
    for w in set(words):
        if len(w) >= SHORTEST:
            w = f" {w} "
            out.update(w[: n + 1] for n in range(SHORTEST, min(LONGEST, len(w) - 1) + 1))
    return out


@dataclass(frozen=True)
class Lexicon:
    """Weights of terms, phrases that take a term's weight back, and the density that scores one half."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: dict[str, float] = field(default_factory=dict)
    threshold: float = 1.0

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.weights:
            return None
        out = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            out.add_word(term, weight)
        for phrase, weight in self.exceptions.items():
            out.add_word(phrase, self.weights.get(phrase, 0.0) - weight)
        out.make_automaton()
        return out


def density(automaton: ahocorasick.Automaton | None, text: str | None) -> tuple[float, int]:
    """Weight of the terms found for each word of the text, and their number."""
    if automaton is None or not text:
        return 0.0, 0
    folded, found = fold(text), 0
    total = 0.0
    for _, weight in automaton.iter(folded):
        total += weight
        found += weight > 0
    return max(0.0, total) / (folded.count(" ") - 1 + EXTRA_WORDS), found


def score_of(x: float, threshold: float) -> float:
    """0 without a hit, one half at the threshold, towards 1 above it."""
    return x * x / (x * x + threshold * threshold)


def phrases(folded: str, automaton: ahocorasick.Automaton) -> set[tuple[str, str]]:
    """The word found with the word before it, and with the word after it; with the term."""
    out = set()
    for end, term in automaton.iter(folded):
        start = end - len(term) + 1
        stop = folded.find(" ", start + 1)
        before = folded.rfind(" ", 0, start)
        after = folded.find(" ", stop + 1)
        if before >= 0:
            out.add((folded[before : stop + 1], term))
        if after >= 0:
            out.add((folded[start : after + 1], term))
    return out


def diverse(toxic: DataFrame, finder: ahocorasick.Automaton) -> set[str]:
    """Terms that stand between other words in at least half of the rows that have them.

    This leaves out what only recurs with copies of a text.
    """

    def run(batches):
        for batch in slices(batches, "text"):
            rows = set()
            for i, text in enumerate(batch.column("text").to_pylist()):
                folded, seen = fold(text), set()
                for end, term in finder.iter(folded):
                    if term not in seen:
                        seen.add(term)
                        start = end - len(term) + 1
                        rows.add((i, term, f"{folded[folded.rfind(' ', 0, start) + 1 : start]} {folded[end + 1 : end + 20]}"))
            yield pa.RecordBatch.from_pydict({"term": [r[1] for r in rows], "beside": [r[2] for r in rows]}, schema=pa.schema([("term", pa.string()), ("beside", pa.string())]))

    counts = toxic.mapInArrow(run, "term string, beside string").groupBy("term", "beside").count().groupBy("term").agg(F.sum("count").alias("n"), F.count("*").alias("kinds"))
    return {r["term"] for r in counts.where("kinds >= 3 and 2 * kinds >= n").select("term").collect()}


def learn(docs: DataFrame, labels: DataFrame, *, max_train: int = MAX_TRAIN, folds: int = 5, exceptions: Iterable[str] = ()) -> Lexicon:
    """Learns a lexicon from labelled rows outside the held-out fold (crc32 of the id modulo `folds` is 0).

    docs has doc_id and text, labels doc_id and toxic. Null ids, texts and labels take no part; a document with several
    labels is toxic if one of them says so. Without toxic rows the lexicon is empty and every score is 0. `exceptions`
    are further phrases that never count.

    Bounds: candidate terms are the MAX_CANDIDATES that most toxic rows have, the lexicon keeps the MAX_TERMS that stand out
    most, and MAX_EXCEPTIONS phrases that most clean rows have.
    """
    known = labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null").where(fold_of("doc_id", folds) != 0)
    known = sample_by_hash(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id", max_train)
    train = written(docs.select("doc_id", "text").where("text is not null").join(F.broadcast(known), "doc_id").select("text", "toxic"))
    sizes = {r["toxic"] > 0: r["n"] for r in train.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(True, 0), sizes.get(False, 0)
    if not n1:
        return Lexicon()

    def count(make):
        """Rows of either kind that have each key; a task passes its counts on before it holds too many."""
        schema = pa.schema([("key", pa.string()), ("one", pa.int64()), ("none", pa.int64())])

        def run(batches):
            held = {1: Counter(), 0: Counter()}

            def flush():
                for toxic, counts in held.items():
                    n = pa.array(list(counts.values()), pa.int64())
                    zero = pa.array(np.zeros(len(n), dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), n if toxic else zero, zero if toxic else n], schema=schema)
                    counts.clear()

            for batch in slices(batches, "text"):
                for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                    held[int(bool(toxic))].update(make(text))
                    if len(held[0]) + len(held[1]) > HELD:
                        yield from flush()
            yield from flush()

        return run

    def counted(df: DataFrame, make) -> DataFrame:
        return df.mapInArrow(count(make), "key string, one long, none long").groupBy("key").agg(F.sum("one").alias("one"), F.sum("none").alias("none"))

    least = max(3, n1 // 400)
    common = written(counted(train.where("toxic > 0"), lambda t: grams(fold(t).split())).where(F.col("one") >= least))
    candidates = {r["key"] for r in most_frequent(common, "one", MAX_CANDIDATES).select("key").collect()}
    rows = counted(train, lambda t: grams(fold(t).split()) & candidates).collect()
    ratio = {r["key"]: math.log((r["one"] + 0.5) / (n1 + 1)) - math.log((r["none"] + 0.5) / (n0 + 1)) for r in rows}
    ones, nones = {r["key"]: r["one"] for r in rows}, {r["key"]: r["none"] for r in rows}
    # A term stands out clearly, isn't just the beginning of a longer one, and no shorter term finds as much.
    longest: dict[str, int] = {}
    for k in ones:
        if len(k) - 1 > SHORTEST:
            longest[k[:-1]] = max(longest.get(k[:-1], 0), ones[k])
    apart = {k for k in ones if ratio[k] >= 3.0 and nones[k] * n1 <= 0.05 * ones[k] * n0}
    weights: dict[str, float] = {}
    for k in sorted(apart, key=lambda k: (len(k), k)):
        if longest.get(k, 0) >= 0.9 * ones[k] and any(x[:-1] == k and ones[x] >= 0.9 * ones[k] for x in apart):
            continue
        if not any(k[:n] in weights for n in range(SHORTEST + 1, len(k))):
            weights[k] = ratio[k]
    weights = dict(sorted(weights.items(), key=lambda x: (-x[1] * math.sqrt(ones[x[0]]), x[0]))[:MAX_TERMS])
    if not weights:
        return Lexicon()

    finder = ahocorasick.Automaton()
    for term in weights:
        finder.add_word(term, term)
    finder.make_automaton()
    apart = diverse(train.where("toxic > 0"), finder)
    weights = {k: w for k, w in weights.items() if k in apart}
    if not weights:
        return Lexicon()
    finder = ahocorasick.Automaton()
    for term in weights:
        finder.add_word(term, term)
    finder.make_automaton()
    excused = written(counted(train, lambda t: {f"{p}\t{w}" for p, w in phrases(fold(t), finder)}).where((F.col("none") >= 5) & (F.col("one") * n0 < F.col("none") * n1)))
    excuses = {(p := r["key"].split("\t"))[0]: weights[p[1]] for r in most_frequent(excused, "none", MAX_EXCEPTIONS).collect()}
    for phrase in exceptions:
        excuses |= {fold(phrase): sum(w for _, term in finder.iter(fold(phrase)) for w in [weights[term]])}
    lexicon = Lexicon(weights, {p: w for p, w in excuses.items() if w > 0})

    def binned(batches):
        automaton = lexicon.automaton()
        out: Counter = Counter()
        for batch in slices(batches, "text"):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                x = density(automaton, text)[0]
                out[int(toxic > 0), -1 if x <= 0 else min(BINS - 1, max(0, int((math.log(x) - LOWEST) / (HIGHEST - LOWEST) * BINS)))] += 1
        yield pa.RecordBatch.from_pydict({"toxic": [k[0] for k in out], "bin": [k[1] for k in out], "n": list(out.values())}, schema=pa.schema([("toxic", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())]))

    bins = np.zeros((2, BINS))
    for r in train.mapInArrow(binned, "toxic int, bin int, n long").groupBy("toxic", "bin").agg(F.sum("n").alias("n")).collect():
        if r["bin"] >= 0:
            bins[r["toxic"], r["bin"]] += r["n"]
    below, above = np.concatenate([[0], np.cumsum(bins[1])]), bins[0].sum() - np.concatenate([[0], np.cumsum(bins[0])])
    errors = below + above  # of a threshold at the lower edge of each bin
    best = np.flatnonzero(errors == errors.min())
    return Lexicon(lexicon.weights, lexicon.exceptions, math.exp(LOWEST + float(best.mean()) * (HIGHEST - LOWEST) / BINS))


def score(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id") -> DataFrame:
    """key, score, predicted, n_hits of each row. Null and empty texts score 0."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in slices(batches, "text"):
            found = [density(automaton, t) for t in batch.column("text").to_pylist()]
            scores = [score_of(x, lexicon.threshold) for x, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array([n for _, n in found], pa.int64())], names=[key, "score", "predicted", "n_hits"])

    return docs.select(key, "text").mapInArrow(run, f"{key} {kind}, score double, predicted int, n_hits long")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = learn(docs, table(spark, sf_dir, "labels"))
    return score(docs, lexicon).select("doc_id", F.coalesce(fold_of("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted", "n_hits")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows that score one half or more; columns and clean rows stay as they are.

    Null and empty texts score 0 and stay. Rows of any id, null and repeated ones too, stay or go by their text; without toxic
    labels for rows of docs all stay.
    """
    lexicon = learn(docs, table(spark, sf_dir, "labels"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in slices(batches, "text"):
            yield batch.filter(pa.array([score_of(density(automaton, t)[0], lexicon.threshold) < 0.5 for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
