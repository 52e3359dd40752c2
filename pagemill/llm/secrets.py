"""Secret scans: fixed patterns, and character Markov models that tell random strings from ordinary identifiers.

Two models of character pairs, one trained on random strings and one on ordinary words and identifiers, give each
candidate string a log-likelihood ratio; strings that are clearly likelier as random are reported besides the patterns'.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import sample_by_hash, slices, table

#: Documents that ordinary strings and the patterns' values are taken from for training, at most (in expectation).
MAX_TRAIN = 4_000
#: Random strings that are made for training, besides the values that the patterns find.
MADE = 4_000
#: Characters that a candidate has at least, and nats a character by which it must be likelier as a random string.
SHORTEST, LEAST_RATIO = 16, 1.0

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the longest runs; shorter ones fail anyway
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}")
WORD, _DIGIT = re.compile(r"[A-Za-z0-9+/_=-]{3,}"), re.compile(r"[0-9]")
_LETTER = re.compile(r"[A-Za-z]")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_INDEX = np.full(256, len(ALPHABET), dtype=np.int64)
_INDEX[list(ALPHABET.encode())] = np.arange(len(ALPHABET))

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the patterns' matches, leftmost and not overlapping within a kind; by start, then kind."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda x: (x[0], x[2]))]


def outside(text: str, pattern: re.Pattern, spans: list[Span], least: int) -> Iterator[tuple[int, int]]:
    """(start, end) of what the spans, which ascend, leave of the pattern's matches, if it has `least` characters. One pass over both."""
    i, covered = 0, 0
    for m in pattern.finditer(text):
        at = m.start()
        while at < m.end():
            while i < len(spans) and spans[i][0] <= at:
                covered = max(covered, spans[i][1])
                i += 1
            at = max(at, covered)
            stop = min(m.end(), spans[i][0]) if i < len(spans) else m.end()
            if stop - at >= least:
                yield at, stop
            at = max(at, stop)


def joined(spans: Iterable[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


@dataclass(frozen=True)
class Models:
    """ratio[a, b]: log-likelihood of b after a in random strings, less that in ordinary ones; the last row begins a string."""

    ratio: np.ndarray

    def score(self, s: str) -> float:
        """Nats a character by which s is likelier as a random string."""
        x = _INDEX[np.frombuffer(s.encode("ascii", "replace"), dtype=np.uint8)]
        before = np.concatenate([[len(ALPHABET)], x[:-1]])
        return float(self.ratio[before, x].mean()) if len(x) else 0.0


def add_pairs(counts: np.ndarray, strings: Iterable[str]) -> None:
    """Counts which character follows which, and which begins a string. Strings are ASCII and hold no line feed."""
    x = _INDEX[np.frombuffer(("\n" + "\n".join(strings)).encode(), dtype=np.uint8)]
    n = len(ALPHABET) + 1
    counts += np.bincount(x[:-1] * n + x[1:], minlength=n * n).reshape(n, n)


def no_pairs() -> np.ndarray:
    return np.zeros((len(ALPHABET) + 1, len(ALPHABET) + 1))


def made_strings(seed: int = 7) -> list[str]:
    """Random strings over the alphabets that keys and digests use."""
    rng = np.random.default_rng(seed)
    kinds = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", ALPHABET[:62], ALPHABET[:64])
    return ["".join(rng.choice(list(kinds[i % len(kinds)]), size=int(rng.integers(16, 65)))) for i in range(MADE)]


def fit(random: np.ndarray, ordinary: np.ndarray) -> Models:
    """Both models from counts of pairs, the pairs' frequencies drawn towards the single characters'."""

    def logs(counts: np.ndarray) -> np.ndarray:
        counts = counts.copy()
        counts[:, -1] = 0  # ends of strings
        single = (counts.sum(0) + 1) / (counts.sum() + len(counts))
        return np.log((counts + 20 * single) / (counts.sum(1, keepdims=True) + 20))

    return Models(logs(random) - logs(ordinary))


def samples(text: str) -> Iterator[tuple[str, int]]:
    """(string, 1 if random) of a text: the patterns' values are random; words, numbers and identifiers made of words are ordinary.

    Long strings of both digits and letters may be either, and are none.
    """
    spans = base_spans(text)
    for start, end, kind in spans:
        yield (ASSIGN.fullmatch(text[start:end])[2] if kind == "assign" else text[start:end]), 1
    last = ""
    for start, end in outside(text, WORD, spans, 3):
        said = text[start:end]
        if len(said) < SHORTEST or said.isdigit() or not _DIGIT.search(said):
            yield said, 0
            if last:  # an identifier as programs have them, with a year or a version
                yield f"{last}{'_-/'[start % 3]}{said}{'_-/'[end % 3]}{1990 + start % 40 if start % 2 else end % 10}", 0
            last = said


def learn(docs: DataFrame, key: str = "doc_id", *, max_train: int = MAX_TRAIN) -> Models:
    """Models from a bounded sample of docs, labelled by `samples`.

    Made-up random strings are added, so that the models also exist for tables without secrets and empty tables.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (no_pairs(), no_pairs())
        for batch in slices(batches, "text"):
            for text in batch.column("text").to_pylist():
                some = set(samples(text))
                for random in (0, 1):
                    add_pairs(held[random], [s for s, r in some if r == random])
        for random, c in enumerate(held):
            a, b = np.nonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([random] * len(a), pa.int32()), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(c[a, b].astype(np.int64))], names=["random", "a", "b", "n"])

    train = sample_by_hash(docs.select(key, "text").where("text is not null"), key, max_train).select("text")
    counts = (no_pairs(), no_pairs())
    for r in train.mapInArrow(count, "random int, a int, b int, n long").groupBy("random", "a", "b").sum("n").collect():
        counts[r["random"]][r["a"], r["b"]] += r["sum(n)"]
    add_pairs(counts[1], made_strings())
    return fit(counts[1], counts[0])


def find(text: str | None, models: Models | None) -> tuple[list[Span], list[Span]]:
    """The patterns' spans, and all spans: the former and, in what they leave of the text, strings likelier to be random (kind `markov`).

    Strings without a letter are numbers or rules, and never random.
    """
    base = base_spans(text) if text else []
    if models is None or not text:
        return base, base
    more = [(start, end, "markov") for start, end in outside(text, CANDIDATE, base, SHORTEST) if _LETTER.search(text, start, end) and models.score(text[start:end]) >= LEAST_RATIO]
    order = {k: i for i, k in enumerate((*KINDS, "markov"))}
    return base, sorted(base + more, key=lambda x: (x[0], order[x[2]]))


def scan(docs: DataFrame, models: Models, key: str = "doc_id") -> DataFrame:
    """key, counts of each pattern, a digest of the patterns' spans, all spans as text; null texts count as empty."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [find(t, models) for t in batch.column("text").to_pylist()]
            numbers = [pa.array([sum(k == kind for _, _, k in base) for base, _ in found], pa.int64()) for kind in KINDS]
            digests = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(key), *numbers, pa.array(digests), pa.array([joined(x) for _, x in found])], names=[key, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(key, "text").mapInArrow(run, f"{key} {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str, spans: Iterable[Span], mark: str = "[secret]") -> str:
    """The text with each stretch that spans cover replaced by the mark."""
    out, at = [], 0
    for start, end, _ in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, learn(docs))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with every secret replaced by a mark, and n_chars (null or not) set to match where the text changes; no row goes.

    docs needs doc_id, text and n_chars; other columns stay, null and empty texts too, rows of equal ids are handled each by itself.
    """
    models = learn(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            old = batch.column("text").to_pylist()
            new = [redacted(t, s) if t and (s := find(t, models)[1]) else t for t in old]
            sizes = [n if a is b else len(b) for a, b, n in zip(old, new, batch.column("n_chars").to_pylist(), strict=True)]
            columns = {"text": pa.array(new, batch.schema.field("text").type), "n_chars": pa.array(sizes, batch.schema.field("n_chars").type)}
            yield pa.RecordBatch.from_arrays([columns.get(c, batch.column(c)) for c in batch.schema.names], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
