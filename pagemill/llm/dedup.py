"""Near duplicates by bottom-k sketches from one hash function.

A document's set holds the hashes of its distinct word shingles; the smallest K of them are its sketch. Documents with equal
sets are one class. Inverted lists of the smallest retained values bring classes together; within a list, sketches estimate
the similarity of unions, and what may reach the threshold is verified on full sets.

Links are wanted for their components, so a list first passes on a spanning forest of its likeliest pairs, not all of them.
After those are verified, lists that still hold several components are looked through on full sets, and pass on a link for
each two components that they join. Lists of shared passages stay out of the way:
a value that very many classes retain is a key only for classes that consist of such values for the most part. Long lists are
cut by size, since linked sets are of like size, and then in cells of two chunks that meet each other.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh128_digest

from .common import join_sized, slices, table, written

#: Words of a shingle; links need so many hundredths of the union in common, in op7 and in the pipeline's stage.
SHINGLE, SIMILAR, STAGE_SIMILAR = 5, 85, 80
#: Values that a sketch retains; those that are keys of inverted lists; those among which a key is looked for.
K, KEYS, AMONG = 128, 12, 32
#: A value that more classes have as a key is common.
COMMON = 256
#: Lists of more classes, or with more shingles, are cut by size, and then in chunks of so many.
LONG, LONG_SHINGLES, CHUNK, CHUNK_SHINGLES = 1_024, 1_000_000, 768, 500_000
#: Standard deviations that an estimate may lie below the threshold before a pair is left out (a chance of about 1e-7).
DEVIATIONS = 5.2
#: Rows, and columns, of a cell's matrices that are worked on at a time.
ROWS, COLUMNS = 128, 1024
#: Distinct words whose hashes a task remembers.
REMEMBERED = 150_000
_M = np.uint64(0xFF51AFD7ED558CCD)


class Shingler:
    """Sets of shingle hashes, ascending, below 2**63."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.known = size, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and white space alone
        if not words:
            return np.zeros(0, dtype=np.int64)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        size = min(self.size, len(h))
        x = np.full(len(h) - size + 1, size, dtype=np.uint64)
        for i in range(size):
            x = (x ^ h[i : len(h) - size + 1 + i]) * _M
            x ^= x >> np.uint64(32)
        return np.unique(x >> np.uint64(1)).astype(np.int64)


def sketches(docs: DataFrame, key: str) -> DataFrame:
    """id, n (size of the set), digest of the set, and sketch of each row; digest and sketch are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for batch in slices(batches, "text"):
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([xxh128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary()),
                    pa.array([short(x) if len(x) else None for x in sets], pa.binary()),
                ],
                names=["id", "n", "digest", "sketch"],
            )

    return docs.select(F.col(key).cast("long").alias("id"), "text").mapInArrow(run, "id long, n long, digest binary, sketch binary")


def short(values: np.ndarray) -> bytes:
    """The smallest K values, cut to 32 bits each, as bytes."""
    return (values[:K] >> 31).astype("<u4").tobytes()


def candidates(ids: np.ndarray, sizes: np.ndarray, sketches_: list[np.ndarray], parts: np.ndarray | None, similar: int) -> Iterator[tuple[int, int]]:
    """Pairs of a list as (smaller id, larger id).

    Without parts: a spanning forest of the pairs that may reach the threshold by their sketches, the likeliest first. With
    parts, full sets stand in for sketches: pairs that reach the threshold, enough to join all parts that such pairs join.
    """
    g = len(ids)
    if g < 2:
        return
    lengths = np.array([len(s) for s in sketches_])
    _, at, counts = np.unique(np.concatenate(sketches_), return_inverse=True, return_counts=True)
    members = np.repeat(np.arange(g), lengths)
    several = counts[at] > 1
    number = np.cumsum(counts > 1) - 1
    rows, columns, width = members[several], number[at[several]], int((counts > 1).sum())
    shared = np.zeros((g, g), dtype=np.float32)
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    for start in range(0, width, COLUMNS):
        lo, hi = np.searchsorted(columns, [start, start + COLUMNS])
        m = np.zeros((g, min(COLUMNS, width - start)), dtype=np.float32)
        m[rows[lo:hi], columns[lo:hi] - start] = 1
        shared += m @ m.T
    # values up to the smaller of both last values are a sample of the union; whole sets end nowhere
    last = np.array([float(s[-1]) if n > len(s) else math.inf for s, n in zip(sketches_, sizes, strict=True)])
    below = np.stack([np.searchsorted(s, last, side="right") for s in sketches_], axis=1).astype(np.float32)  # [i, j]: of j's, up to i's last
    p = similar / 100

    def likeness(part: slice) -> tuple[np.ndarray, np.ndarray]:
        """Of some rows: the likeness to all by their sample, and whether the pair may reach the threshold (with parts: does)."""
        own = np.where(last[part, None] <= last[None, :], lengths[part, None], below[:, part].T)  # i's values in the sample
        other = np.where(last[None, :] <= last[part, None], lengths[None, :], below[part])  # j's
        sample = own + other - shared[part]
        if parts is None:
            union = (sizes[part, None] + sizes[None, :]) / (1 + p)
            slack = DEVIATIONS * np.sqrt(p * (1 - p) / sample * np.clip(1 - sample / union, 0, None))
            fits = shared[part] / sample >= p - slack - 1e-3
        else:
            fits = 100 * shared[part].astype(np.float64) >= similar * sample.astype(np.float64)
            fits &= parts[part, None] != parts[None, :]
        fits &= 100 * np.minimum(sizes[part, None], sizes[None, :]) >= similar * np.maximum(sizes[part, None], sizes[None, :])
        fits[np.arange(fits.shape[0]), np.arange(part.start, part.stop)] = False
        return shared[part] / sample, fits

    blocks = [slice(i, min(i + ROWS, g)) for i in range(0, g, ROWS)]  # so that few matrices of all pairs are held
    if parts is not None:
        above = {int(x): int(x) for x in parts}

        def top(x: int) -> int:
            while above[x] != x:
                above[x] = x = above[above[x]]
            return x

        for block in blocks:
            for i, j in zip(*np.nonzero(likeness(block)[1]), strict=True):
                i += block.start
                x, y = top(int(parts[i])), top(int(parts[j]))
                if x != y:
                    above[max(x, y)] = min(x, y)
                    yield (int(ids[i]), int(ids[j])) if ids[i] < ids[j] else (int(ids[j]), int(ids[i]))
        return
    likely = np.empty((g, g), dtype=np.float32)
    for block in blocks:
        like, fits = likeness(block)
        likely[block] = np.where(fits, like, -1.0)
    left = (likely >= 0).any(axis=1)
    best, by = np.full(g, -1.0, dtype=np.float32), np.zeros(g, dtype=np.int64)
    while left.any():
        i = int(np.argmax(np.where(left, best, -2.0)))
        if best[i] >= 0:
            j = int(by[i])
            yield (int(ids[i]), int(ids[j])) if ids[i] < ids[j] else (int(ids[j]), int(ids[i]))
        left[i] = False
        better = likely[i] > best
        best[better], by[better] = likely[i][better], i


def members_of_lists(classes: DataFrame, similar: int) -> DataFrame:
    """cell and id: the lists, or parts of long ones, that each class is in; of lists with two classes at least."""
    firsts = classes.select("id", "n", F.posexplode(F.slice("keys", 1, KEYS)).alias("at", "value"))
    common = written(firsts.groupBy("value").count().where(F.col("count") > COMMON).select("value"))
    if common.limit(1).count():
        # classes with a common value among their first: their first values that aren't, and the common ones if most are
        early = written(join_sized(firsts, common, ["value"]).select("id", "value"))
        touched = written(early.select("id").distinct())
        rest = join_sized(firsts, touched, ["id"], "left_anti").select("value", "id", "n")
        mixed = written(join_sized(classes.select("id", "n", "keys"), touched, ["id"], "left_semi"))
        late = join_sized(mixed.select("id", F.explode(F.slice("keys", KEYS + 1, AMONG)).alias("value")), common, ["value"]).select("id", "value")
        hits = early.unionByName(late).groupBy("id").agg(F.collect_set("value").alias("hits"))  # AMONG at most
        rare = F.array_except("keys", "hits")
        frequent = F.array_intersect(F.slice("keys", 1, KEYS), "hits")
        chosen = F.concat(F.slice(rare, 1, KEYS), F.when(2 * F.size(rare) < F.size("keys"), frequent).otherwise(F.array().cast("array<long>")))
        keys = rest.unionByName(mixed.join(hits, "id").select(F.explode(chosen).alias("value"), "id", "n"))
    else:
        keys = firsts.select("value", "id", "n")
    return cells_of(written(keys), similar)


def cells_of(keys: DataFrame, similar: int) -> DataFrame:
    """cell and id of lists with two members at least, of keys (value, id, n): short lists are cells, long ones are cut.

    Members of long lists are told apart by a join that deals out hot values, so the join by value has short lists alone.
    """
    lists = keys.groupBy("value").agg(F.count("*").alias("members"), F.sum("n").alias("shingles")).where("members > 1")
    is_long = (F.col("members") > LONG) | (F.col("shingles") > LONG_SHINGLES)
    lists = written(lists.select("value", is_long.alias("long")))
    cut_up = lists.where("long").select("value")
    rest = join_sized(keys, cut_up, ["value"], "left_anti")
    plain = rest.join(lists.where("not long").select("value"), "value", "left_semi").select(F.xxhash64("value").alias("cell"), "id")
    long = join_sized(keys, cut_up, ["value"], "left_semi")
    band = F.floor(F.log("n") / math.log(100 / similar)).cast("int")
    banded = long.select("value", "id", "n", F.explode(F.array(band, band + 1)).alias("band"))
    chunks = F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("n") / CHUNK_SHINGLES)).cast("int")
    sizes = banded.groupBy("value", "band").agg(chunks.alias("chunks"))
    cut = join_sized(banded, sizes, ["value", "band"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = met.select(F.xxhash64("value", "band", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("cell"), "id")
    return plain.unionByName(cells)


def prefixes(sets: DataFrame, similar: int) -> DataFrame:
    """value, id and n: the smallest values of each full set (id, n, sketch), so many that linked sets have one in common.

    Linked sets share `similar` hundredths of the larger one at least; what a set has besides its smallest values is less.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "sketch"):
            sizes = batch.column("n").to_pylist()
            lengths = np.array([n - -(-similar * n // 100) + 1 for n in sizes], dtype=np.int64)
            values = [np.frombuffer(s, dtype="<i8", count=k) for s, k in zip(batch.column("sketch").to_pylist(), lengths.tolist(), strict=True)]
            ids, ns = (np.repeat(np.array(c, dtype=np.int64), lengths) for c in (batch.column("id").to_pylist(), sizes))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(values)), pa.array(ids), pa.array(ns)], names=["value", "id", "n"])

    return sets.select("id", "n", "sketch").mapInArrow(run, "value long, id long, n long")


def pairs_in_lists(members: DataFrame, classes: DataFrame, between: bool, similar: int) -> DataFrame:
    """a and b of the pairs that `candidates` finds in each list. classes: id, n, sketch; if `between`, with full sets as sketches, and part."""
    rows = members.join(classes, "id")
    if not between:
        rows = rows.withColumn("part", F.lit(None).cast("long"))
    rows = rows.repartition("cell").sortWithinPartitions("cell", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple[int, int]] = []

        def close() -> None:
            if len(held) > 1:
                ids, sizes, sketched, part = zip(*held, strict=True)
                known = np.array(part) if between else None
                if known is None or (known != known[0]).any():
                    out.extend(candidates(np.array(ids), np.array(sizes), list(sketched), known, similar))
            held.clear()

        cell = None
        for batch in slices(batches, "sketch"):
            for c, i, n, sketch, part in zip(*(batch.column(x).to_pylist() for x in ("cell", "id", "n", "sketch", "part")), strict=True):
                if c != cell:
                    close()
                    cell = c
                held.append((i, n, np.frombuffer(sketch, dtype="<i8" if between else "<u4"), part))
            if out:
                yield to_batch(out)
                out.clear()
        close()
        if out:
            yield to_batch(out)

    def to_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
        some = np.array(sorted(set(found)), dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(some[:, 0]), pa.array(some[:, 1])], names=["a", "b"])

    return rows.select("cell", "id", "n", "sketch", "part").mapInArrow(run, "a long, b long").where("a <> b").distinct()


def full_sets(docs: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """id and set (ascending 64-bit integers as bytes) of the documents of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([shingles(t).tobytes() for t in batch.column("text").to_pylist()], pa.binary())], names=["id", "set"])

    texts = docs.select(F.col(key).cast("long").alias("id"), "text")
    return join_sized(texts, ids, ["id"], "left_semi").mapInArrow(run, "id long, set binary")


def verified(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """The pairs whose full sets have `similar` hundredths of their union in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "set_a", "set_b"):
            linked = []
            for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True):
                p, q = np.frombuffer(x, dtype="<i8"), np.frombuffer(y, dtype="<i8")
                common = len(np.intersect1d(p, q, assume_unique=True))
                linked.append(100 * common >= similar * (len(p) + len(q) - common) and common > 0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    one, other = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    return pairs.join(other, "b").join(one, "a").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id and part of each end of a link: part is the smallest id that links reach.

    Each round takes the smallest part of the neighbours, then the part of that part twice, so long chains shorten fast.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct())
    parts = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("part")))
    while True:
        near = both.join(parts, F.col("b") == F.col("id")).groupBy(F.col("a").alias("id")).agg(F.min("part").alias("near"))
        new = parts.join(near, "id").select("id", F.least("part", "near").alias("part"), F.col("part").alias("old"))
        for _ in range(2):
            up = new.select(F.col("id").alias("part"), F.col("part").alias("up"))
            new = new.join(up, "part").select("id", F.col("up").alias("part"), "old")
        new = written(new)
        parts = new.select("id", "part")
        if not new.where("part <> old").limit(1).count():
            return parts


def classes_of(every: DataFrame) -> DataFrame:
    """A row for each set of `sketches`: digest, id (its smallest, which stands for it), n, sketch, number of copies and keys."""
    some = every.where("id is not null and digest is not null")
    found = some.groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("copies"))

    def with_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.frombuffer(s, dtype="<u4")[:AMONG].astype(np.int64) for s in batch.column("sketch").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int64()))], names=[*batch.schema.names, "keys"])

    return written(found.mapInArrow(with_keys, "digest binary, id long, n long, sketch binary, copies long, keys array<long>"))


def sets_of(docs: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """`full_sets`, written; rows of one id with equal sets once. Sets are compared only where an id has several rows."""
    sets = written(full_sets(docs, key, ids))
    repeated = sets.groupBy("id").count().where("count > 1").select("id")
    if repeated.limit(1).count():
        some = written(repeated)
        once = join_sized(sets, some, ["id"], "left_semi").distinct()
        sets = written(join_sized(sets, some, ["id"], "left_anti").unionByName(once))
    return sets


def as_cells(sets: DataFrame, part: Column) -> DataFrame:
    """Sets as `pairs_in_lists` takes them between parts."""
    return sets.select("id", (F.octet_length("set") / 8).cast("long").alias("n"), F.col("set").alias("sketch"), part.alias("part"))


def exact_parts(docs: DataFrame, key: str, classes: DataFrame, similar: int) -> DataFrame:
    """id and part of linked classes, by full sets alone: lists of all values of the sets' prefixes, cut in the same cells.

    No chance and no bound of candidates is in it, but it moves a set for each value of its prefix: a means to check on the
    sketches, and for corpora that are small enough.
    """
    sets = sets_of(docs, key, classes.select("id"))
    whole = written(as_cells(sets, F.col("id")))
    cells = written(cells_of(written(prefixes(whole, similar)), similar).distinct())
    return components(written(pairs_in_lists(cells, whole, True, similar)))


def likely_parts(docs: DataFrame, key: str, classes: DataFrame, similar: int) -> DataFrame:
    """id and part of linked classes, by sketches and then full sets."""
    members = written(members_of_lists(classes, similar).distinct())
    likely = written(pairs_in_lists(members, classes.select("id", "n", "sketch"), False, similar))
    ends = written(likely.select(F.col("a").alias("id")).union(likely.select("b")).distinct())
    sets = sets_of(docs, key, ends)
    links = written(verified(likely, sets, similar))
    parts = components(links)
    # what the forest left open: lists of several parts, of classes that have a likely pair at all
    alone = ends.join(parts.select("id"), "id", "left_anti").select("id", F.col("id").alias("part"))
    of = written(parts.unionByName(alone))
    held = written(members.join(of, "id"))
    several = held.groupBy("cell").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("cell")
    left = written(held.join(several, "cell", "left_semi").select("cell", "id"))
    found = written(pairs_in_lists(left, as_cells(sets.join(of, "id"), F.col("part")), True, similar))
    return components(written(links.unionByName(found))) if found.limit(1).count() else parts


def near_duplicates(docs: DataFrame, key: str = "doc_id", *, similar: int = SIMILAR, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row; sets are linked that have `similar` hundredths of their union in common.

    Null and empty texts have empty sets and are linked with nothing; so are rows with a null id, whose component is null and
    which are kept. Rows with one id are one document: they are linked with each other. With `exact`, full sets are joined
    by their prefixes instead of sketches.
    """
    every = written(sketches(docs, key))
    classes = classes_of(every)
    parts = (exact_parts if exact else likely_parts)(docs, key, classes, similar)
    # back to documents: only classes with copies and only parts of several classes need a join
    copied = classes.where("copies > 1").select("digest", F.col("id").alias("class"))
    out = join_sized(every.select("id", "n", "digest"), copied, ["digest"], "left").withColumn("class", F.coalesce("class", "id"))
    out = join_sized(out, parts.select(F.col("id").alias("class"), "part"), ["class"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("part", "class"))
    kept = F.coalesce(F.col("id") == component, F.lit(True))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each group of linked rows, that of the smallest id; columns stay, texts without words stay too.

    Where ids are null or repeated, rows are told apart by numbers of their own, so such rows are copies of each other like
    any others; a null id counts as the largest.
    """
    columns = docs.columns
    if not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count():
        gone = written(near_duplicates(docs, similar=STAGE_SIMILAR).where("not kept").select("doc_id"))
        return join_sized(docs, gone, ["doc_id"], "left_anti").select(*columns)
    row = f"_row_{uuid.uuid4().hex}"
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()))
    found = written(near_duplicates(rows.select(row, "text"), row, similar=STAGE_SIMILAR).join(rows.select(row, "doc_id"), row))
    firsts = written(found.groupBy("component_id").agg(F.min_by(row, F.struct(F.col("doc_id").isNull(), "doc_id", row)).alias("first"), F.count("*").alias("n")).where("n > 1"))
    gone = written(join_sized(found, firsts, ["component_id"]).where(F.col(row) != F.col("first")).select(row))
    return join_sized(rows, gone, [row], "left_anti").select(*columns)
