"""Packs token sequences: long texts are cut, and pieces go to the sequence of lowest cost that has room.

Packing needs no shuffle: each task packs the documents of its own input, block by block, so memory is bounded, a lost task
can run again by itself, and a block wastes less than one sequence.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table

#: Tokens of a sequence, and tokens of the documents that are packed together, at least.
CAPACITY, BLOCK_TOKENS = 1024, 1 << 21
#: Cost of a piece: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Token id after each document.
END = 0
TOKENIZER = "byte_bpe_50k.json"

#: A piece: (document, start, length, sequence, offset).
Piece = tuple[int, int, int, int, int]


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[Piece]:
    """Pieces that hold each token of each document once.

    A document's full sequences come first and stand alone. The rests go, longest first (ties: earliest document), to the
    sequence of lowest cost that has room; a rest that fits nowhere is cut to fill the sequences with most room. There are
    as many sequences as the rests need, so less than one sequence's worth of room is left over.
    """
    pieces: list[Piece] = []
    n_sequences = 0
    rests = []
    for doc, length in enumerate(lengths):
        full = length // capacity
        pieces += [(doc, i * capacity, capacity, n_sequences + i, 0) for i in range(full)]
        n_sequences += full
        if length % capacity:
            rests.append((length % capacity, doc, full * capacity))
    rests.sort(key=lambda x: (-x[0], x[1]))
    n = -(-sum(x[0] for x in rests) // capacity)
    costs, room = np.zeros(n), np.full(n, capacity)
    for length, doc, start in rests:
        while length:
            fits = room >= length
            k = int(np.argmin(np.where(fits, costs, np.inf))) if fits.any() else int(np.argmax(room))
            part = min(length, int(room[k]))
            pieces.append((doc, start, part, n_sequences + k, capacity - int(room[k])))
            costs[k] += cost(part)
            room[k] -= part
            start, length = start + part, length - part
    return pieces


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def plain_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids as the tokenizers library gives them for a byte-level vocabulary file, special tokens in a text included.

    The vocabulary's ids are its merge ranks, so a rank encoder gives the same ids several times as fast.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        special = {t["content"]: t["id"] for t in said["added_tokens"]}
        of = plain_bytes()
        ranks = {bytes(of[c] for c in token): i for token, i in said["model"]["vocab"].items() if token not in special}
        self.encoding = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str | None) -> np.ndarray:
        return self.encoding.encode_to_numpy(text or "", allowed_special="all", disallowed_special=())


SCHEMA = "doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, *, tokenizer: str | None = None, capacity: int = CAPACITY, block_tokens: int = BLOCK_TOKENS, key: str = "doc_id") -> DataFrame:
    """A row for each piece; sequence_id is unique over all tasks, offsets in a sequence have no gaps.

    Null texts count as empty; every document, also an empty or repeated one, has the id END at its end.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer or tokenizer_path())
        at = TaskContext.get().partitionId() << 33
        keys: list = []
        ids: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal at, held
            pieces = pack([len(x) for x in ids], capacity)
            rows = [(keys[d], start, n, zlib.crc32(ids[d][start : start + n].tobytes()), len(ids[d]), at + s, offset) for d, start, n, s, offset in pieces]
            at += 1 + max((p[3] for p in pieces), default=-1)
            keys.clear(), ids.clear()
            held = 0
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(columns[0], key_type), *(pa.array(c, pa.int64()) for c in columns[1:])], names=names)

        key_type = pa.int64()
        for batch in slices(batches, "text"):
            key_type = batch.schema.field(key).type
            for k, text in zip(batch.column(key).to_pylist(), batch.column("text").to_pylist(), strict=True):
                keys.append(k)
                ids.append(np.append(encoder.ids(text), np.uint32(END)).astype("<u4"))
                held += len(ids[-1])
                if held >= block_tokens:
                    yield flush()
        if keys:
            yield flush()

    return docs.select(key, "text").mapInArrow(run, SCHEMA.format(kind=kind))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all docs."""
    return pack_documents(docs)
