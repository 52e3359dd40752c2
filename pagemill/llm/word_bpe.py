"""Word BPE by a minimal acyclic transducer.

Frequent words are compiled with their ids into an automaton with shared prefixes and suffixes, whose file each worker maps
into memory. The distinct words of a batch walk through it together; those that it doesn't hold are merged by the vocabulary's
own rules, so ids are exact.
"""

from __future__ import annotations

import atexit
import json
import mmap
import os
import shutil
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import most_frequent, slices, table, written
from .packing import plain_bytes, tokenizer_path

TOKENIZER = "word_bpe_49k.json"
#: Words that an automaton holds, at most.
MAX_WORDS = 1 << 16
#: A task leaves out words below this share of its own words. A word above the share in the corpus is above it in some task.
LEAST_SHARE = 2e-6
#: Distinct words that a task counts, or rare ones whose ids it remembers, at a time.
REMEMBERED = 200_000


def plain(text: str) -> str:
    """Upper-case ASCII letters lowered, as the tokenizer would; texts that may hold special tokens stay as they are."""
    if "<|" in text:
        return text
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def words(text: str | None) -> list[str]:
    """What stands between blanks and line feeds. The tokenizer never joins anything over those."""
    return [w for w in plain(text or "").replace("\n", " ").split(" ") if w]


def compiled(entries: dict[str, Iterable[int]]) -> bytes:
    """The automaton of words with their ids.

    Equal ends are shared (states with equal rest are one). An arc carries how many words come before those that pass it;
    the sum along a word is its number, by which its ids are found.
    """
    items = sorted((w.encode("utf-8", "surrogatepass"), list(ids)) for w, ids in entries.items())
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []
    sizes: list[int] = []

    def closed(final: bool, arcs: list[tuple[int, int]]) -> int:
        key = (final, tuple(arcs))
        if key not in register:
            register[key] = len(states)
            states.append(key)
            sizes.append(final + sum(sizes[t] for _, t in arcs))
        return register[key]

    # states of the last word that may still get arcs: [final, arcs, label of the arc that leads on]
    path: list[list] = [[False, [], -1]]

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, arcs, _ = path.pop()
            path[-1][1].append((path[-1][2], closed(final, arcs)))

    last = b""
    for word, _ in items:
        shared = len(os.path.commonprefix([last, word]))
        close(shared)
        for b in word[shared:]:
            path[-1][2] = b
            path.append([False, [], -1])
        path[-1][0] = True
        last = word
    close(0)
    root = closed(path[0][0], path[0][1])

    keys, targets, before = [], [], []
    for number, (final, arcs) in enumerate(states):
        n = int(final)
        for label, target in arcs:
            keys.append(number << 8 | label)
            targets.append(target)
            before.append(n)
            n += sizes[target]
    bounds = np.cumsum([0, *(len(ids) for _, ids in items)])
    header = np.array([root, len(states), len(targets), len(items), bounds[-1], 0], dtype="<u8").tobytes()
    numbers = [np.array(x, dtype="<u4").tobytes() for x in (targets, before, bounds, [i for _, ids in items for i in ids])]
    return header + np.array(keys, dtype="<u8").tobytes() + b"".join(numbers) + bytes(final for final, _ in states)


class Transducer:
    """Reads what `compiled` made, from memory or a mapped file.

    An arc's key is its state and its byte; keys ascend, so that many words find their next arcs by one search.
    """

    def __init__(self, data: bytes | mmap.mmap):
        header = np.frombuffer(data, "<u8", 6)
        self.root, n_states, n_arcs, n_words, n_ids = (int(x) for x in header[:5])
        at = header.nbytes

        def numbers(n: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.keys, self.targets, self.before = numbers(n_arcs, "<u8"), numbers(n_arcs, "<u4"), numbers(n_arcs, "<u4")
        self.bounds, self.ids, self.finals = numbers(n_words + 1, "<u4"), numbers(n_ids, "<u4"), numbers(n_states, "u1")

    @classmethod
    def mapped(cls, path: str) -> Transducer:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def lookup(self, some: list[str]) -> list[bytes | None]:
        """Ids of each word as little-endian unsigned 32-bit integers; None for a word that it doesn't hold."""
        coded = [w.encode("utf-8", "surrogatepass") for w in some]
        sizes = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
        text, begins = np.frombuffer(b"".join(coded), np.uint8), np.cumsum(sizes) - sizes
        states, numbers, found = np.full(len(some), self.root, dtype=np.uint64), np.zeros(len(some), np.int64), np.ones(len(some), bool)
        walking, depth = np.flatnonzero(sizes), 0
        while len(walking):
            key = states[walking] << np.uint64(8) | text[begins[walking] + depth]
            at = np.searchsorted(self.keys, key)
            there = at < len(self.keys)
            there[there] = self.keys[at[there]] == key[there]
            found[walking[~there]] = False
            walking, at = walking[there], at[there]
            states[walking] = self.targets[at]
            numbers[walking] += self.before[at]
            depth += 1
            walking = walking[sizes[walking] > depth]
        found[found] = self.finals[states[found].astype(np.int64)] > 0
        numbers[~found] = 0
        ids = memoryview(self.ids).cast("B")
        some_found, lows, highs = found.tolist(), (4 * self.bounds[numbers].astype(np.int64)).tolist(), (4 * self.bounds[np.minimum(numbers + 1, len(self.bounds) - 1)].astype(np.int64)).tolist()
        return [bytes(ids[a:b]) if f else None for f, a, b in zip(some_found, lows, highs, strict=True)]


def frequent(docs: DataFrame, limit: int = MAX_WORDS) -> list[str]:
    """The most frequent words of all texts, at most `limit`; which ones changes speed, never ids."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            least = max(2, LEAST_SHARE * held.total())
            some = [(w, n) for w, n in held.items() if n >= least]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], names=["word", "n"])

        for batch in slices(batches, "text"):
            for text in batch.column("text").to_pylist():
                held.update(words(text))
            if len(held) > REMEMBERED:
                yield flush()
        yield flush()

    counts = docs.select("text").where("text is not null").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"] for r in most_frequent(written(counts), "n", limit).select("word").collect()]


class Merger:
    """Merges words of Latin script as the vocabulary file says.

    Ids are merge ranks here, so a rank encoder does it, with END for the end of a word. All other words, and those with END
    or parts of special tokens, are left to the tokenizers library.
    """

    END = "\0"
    #: Below it every character is composed and no library's character classes are older than it.
    LATIN = "\u0250"
    SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    BETWEEN = regex.compile(r"[^\S\n]+")

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        special, of, suffix = {t["content"] for t in said["added_tokens"]}, plain_bytes(), said["model"]["end_of_word_suffix"]
        ranks = {}
        for token, i in said["model"]["vocab"].items():
            if token not in special:
                whole = token.removesuffix(suffix)
                ranks[bytes(of[c] for c in whole) + (self.END.encode() if whole != token else b"")] = i
        self.encoding = tiktoken.Encoding("words", pat_str=r"\n|[^\x00\n]*\x00", mergeable_ranks=ranks, special_tokens={})
        self.line = ranks[b"\n"]

    def foreign(self, word: str) -> bool:
        """Whether a word is left to the library."""
        return not word.isascii() and max(word) >= self.LATIN or self.END in word or "<|" in word

    def merged(self, some: list[str]) -> list[bytes | None]:
        """Ids of each word; None for those that are left to the library. All words are split, then merged, by one call."""
        own = [w for w in some if not self.foreign(w)]
        # END after each piece; what stands between pieces is white space, and no part of any
        said = self.BETWEEN.sub("", self.SPLIT.sub(r"\g<0>\0", "\n".join(own).lower()))
        ids = self.encoding.encode_to_numpy(f"{said}\n").astype("<u4")
        ends = np.flatnonzero(ids == self.line).tolist()
        data = ids.tobytes()
        found = iter([data[4 * a + 4 : 4 * b] for a, b in zip([-1, *ends], ends, strict=False)])
        return [None if self.foreign(w) else next(found) for w in some]


class Codec:
    """Encodes and decodes with a vocabulary file; a transducer, if given, saves merging its words."""

    def __init__(self, path: str, transducer: Transducer | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.tokens = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.transducer, self.merger = transducer, Merger(path)
        self.known: dict[str, bytes] = {}

    def merged(self, some: list[str]) -> list[bytes]:
        """Ids of words by the vocabulary's merges."""
        out = self.merger.merged(some)
        left = [i for i, b in enumerate(out) if b is None]
        for i, e in zip(left, self.tokenizer.encode_batch([some[i] for i in left], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, dtype="<u4").tobytes()
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [words(t) for t in texts]
        distinct = list(set().union(*split))
        ids = dict(zip(distinct, self.transducer.lookup(distinct) if self.transducer else [None] * len(distinct), strict=True))
        rare = [w for w, b in ids.items() if b is None]
        unseen = [w for w in rare if w not in self.known]
        if len(self.known) + len(unseen) > REMEMBERED:
            self.known.clear()
            unseen = rare
        self.known.update(zip(unseen, self.merged(unseen), strict=True))
        ids.update((w, self.known[w]) for w in rare)
        get = ids.__getitem__
        return [b"".join(map(get, ws)) for ws in split]

    def decode(self, ids: bytes) -> str:
        """The tokens with a blank between them, special ones included: this vocabulary's file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


def encode_documents(docs: DataFrame, *, tokenizer: str | None = None, lexicon: int = MAX_WORDS, key: str = "doc_id") -> DataFrame:
    """key, ids (little-endian unsigned 32-bit integers) and decoded text of each row; null texts count as empty."""
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    path = tokenizer or tokenizer_path(TOKENIZER)
    codec = Codec(path)
    common = frequent(docs, lexicon)
    automaton = compiled({w: np.frombuffer(b, dtype="<u4") for w, b in zip(common, codec.merged(common), strict=True)})
    # the driver hands the file to every executor when its first task asks, so it stays until the driver ends
    top, name = tempfile.mkdtemp(prefix="words-"), f"words-{uuid.uuid4().hex}.bin"
    atexit.register(shutil.rmtree, top, ignore_errors=True)
    with open(os.path.join(top, name), "wb") as f:
        f.write(automaton)
    spark.sparkContext.addFile(os.path.join(top, name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(tokenizer or tokenizer_path(TOKENIZER), Transducer.mapped(SparkFiles.get(name)))
        for batch in slices(batches, "text"):
            ids = codec.encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(ids, pa.binary()), pa.array([codec.decode(b) for b in ids], pa.string())], names=[key, "ids", "decoded"])

    return docs.select(key, "text").mapInArrow(run, f"{key} {kind}, ids binary, decoded string")


def op9_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_documents(table(spark, sf_dir, "documents"))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
