"""Exact top-k search over blocks of documents.

Rows are vectors of integers; a component is a term with a weight of either sign. Each block of rows keeps, for each term, the
largest and smallest weight. For a query the sum over its terms of the larger product bounds the scores in a block. Blocks are
taken in order of that bound and scored through their own rows, until no block left can reach the k-th score.

Blocks of neighbouring ids make ranges, queries of neighbouring ids groups. Only the blocks' weights meet all groups at first.
Each group then meets the few ranges that most of its queries have their highest bound in, which gives them a k-th score, and
after that those ranges alone whose bounds reach one of these scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Rows of a block; blocks of a range, which one task searches at a time; queries of a group, which it searches for.
BLOCK, RANGE_BLOCKS, GROUP = 256, 32, 512
#: Ranges whose blocks' weights are sent together; ranges that a group meets first; parts that a range's meetings are dealt out in, in all at least.
PACK, FIRST, PARTS = 64, 16, 64
K = 5
#: Integers up to here are exact as doubles.
EXACT = float(1 << 53)
#: Scores beyond a long count as the nearest one.
LONG = (1 << 63) - 1


def quantised(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """key and q: floor(256 * x) of each component as double. Rows with a null key, vector or component, or one that isn't finite, go."""
    x = F.transform(F.col(vector), lambda v: F.floor(v.cast("double") * 256).cast("long"))
    sound = F.forall(F.col(vector), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return vectors.select(key, vector).where(F.col(key).isNotNull() & F.col(vector).isNotNull()).where(sound).select(F.col(key).cast("long").alias("id"), x.alias("q"))


def in_long(scores: np.ndarray) -> np.ndarray:
    return np.clip(scores, -LONG, LONG) if scores.dtype == object else scores


def weights(rows: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The largest and smallest weight of each term, for each block of rows."""
    starts = range(0, len(rows), block)
    return np.array([rows[i : i + block].max(0) for i in starts]), np.array([rows[i : i + block].min(0) for i in starts])


def bounds_of(queries: np.ndarray, highs: np.ndarray, lows: np.ndarray) -> np.ndarray:
    """[query, block]: what no score in the block exceeds."""
    return in_long(np.maximum(queries, 0) @ highs.T + np.minimum(queries, 0) @ lows.T)


def search(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int = K, block: int = BLOCK, floors: list | None = None) -> tuple[list[tuple[int, int, int]], int]:
    """(query, id, score) of each query's k best rows other than itself, ties to the smaller id; and the number of blocks scored.

    ids ascend. A block is left out only if its bound is below the k-th score, or equal and its smallest id comes later. floors
    has, for each query, (-score, id) of a k-th best row that is known from elsewhere, or None; what comes after it is left out.
    """
    highs, lows = weights(rows, block)
    bounds = bounds_of(queries, highs, lows)
    orders = np.argsort(-bounds, axis=1, kind="stable")
    out, scored = [], 0
    for n, q in enumerate(queries):
        own, best = query_ids[n], []  # (-score, id), at most k
        floor = floors[n] if floors else None
        for b in orders[n]:
            start = int(b) * block
            last = best[-1] if len(best) == k else None
            last = min(last, floor) if last and floor else last or floor
            if last and (-bounds[n, b], ids[start]) > last:
                if -bounds[n, b] > last[0]:
                    break
                continue
            scored += 1
            scores = in_long(rows[start : start + block] @ q)
            some = ids[start : start + block]
            other = some != own
            if not other.all():
                scores, some = scores[other], some[other]
            if len(scores) > k:
                near = scores >= np.partition(scores, -k)[-k] if scores.dtype != object else np.ones(len(scores), bool)
                scores, some = scores[near], some[near]
            best = sorted([*best, *zip((-scores).tolist(), some.tolist(), strict=True)])[:k]
        out += [(int(own), int(i), int(-s)) for s, i in best]
    return out, scored


def of_bytes(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<i8").reshape(-1, max(1, width))


def exact(*tables: np.ndarray) -> list[np.ndarray]:
    """The tables as doubles, if their products' sums are exact so, else as Python's integers; the first ones are queries."""
    largest = [max((int(np.abs(t.astype(np.float64)).max(initial=0)) for t in some), default=0) for some in (tables[:1], tables[1:])]
    kind = np.float64 if max(largest[0], 1) * max(largest[1], 1) * max(1, tables[0].shape[1]) < EXACT else object
    return [t.astype(kind) for t in tables]


def packed(rows: DataFrame, width: int, size: int, number: str) -> DataFrame:
    """Rows (id, q), in order within a partition, as tables of at most `size`: number, ids and rows, with the blocks' weights."""
    block = BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_ids: list[int] = []
        held: list[list[int]] = []
        at = TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            nonlocal at
            flat = np.zeros((len(held), width), dtype="<i8")
            for i, q in enumerate(held):
                flat[i, : len(q)] = q
            columns = [np.array(held_ids, dtype="<i8"), flat, *weights(flat, block)]
            held_ids.clear(), held.clear()
            at += 1
            return pa.RecordBatch.from_arrays([pa.array([at - 1], pa.int64()), *(pa.array([c.astype("<i8").tobytes()], pa.binary()) for c in columns)], names=[number, "ids", "rows", "highs", "lows"])

        for batch in batches:
            for i, q in zip(batch.column("id").to_pylist(), batch.column("q").to_pylist(), strict=True):
                held_ids.append(i)
                held.append(q)
                if len(held) == size:
                    yield flush()
        if held:
            yield flush()

    return written(rows.mapInArrow(run, f"{number} long, ids binary, rows binary, highs binary, lows binary"))


def packs_of(ranges: DataFrame, n: int) -> DataFrame:
    """The weights of the blocks of PACK ranges together: pack, and of each block its range."""
    most = PACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None

        def flush() -> pa.RecordBatch:
            columns = [b"".join(x) for x in zip(*(x[1:] for x in held), strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), *(pa.array([c], pa.binary()) for c in columns)], names=["pack", "of", "highs", "lows"])

        for batch in batches:
            for pack, of, blocks, highs, lows in zip(*(batch.column(c).to_pylist() for c in ("pack", "range", "blocks", "highs", "lows")), strict=True):
                if held and (pack != at or len(held) == most):
                    yield flush()
                at = pack
                held.append((pack, np.full(blocks, of, dtype="<i8").tobytes(), highs, lows))
        if held:
            yield flush()

    dealt = ranges.select("range", F.ceil(F.octet_length("ids") / (8 * BLOCK)).cast("int").alias("blocks"), "highs", "lows", F.pmod(F.xxhash64("range"), F.lit(n)).cast("int").alias("pack"))
    return dealt.repartition(n, "pack").sortWithinPartitions("pack").mapInArrow(run, "pack int, of binary, highs binary, lows binary")


class Meetings(NamedTuple):
    """Results (query_id, vec_id, score) of the first and of the other meetings; groups and ranges that meet; and how many could."""

    first: DataFrame
    others: DataFrame
    seeds: DataFrame
    rest: DataFrame
    ranges: int
    groups: int


def meetings(rows: DataFrame, queries: DataFrame, k: int) -> Meetings | None:
    """Searches rows (id, q) for the queries (id, q)."""
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("width")).first()
    block, first_ranges = BLOCK, FIRST
    n, width, n_queries = size["n"] or 0, size["width"] or 0, queries.count()
    if not width or not n_queries:
        return None
    wanted, groups = max(1, math.ceil(n / (BLOCK * RANGE_BLOCKS))), max(1, math.ceil(n_queries / GROUP))
    # rows of one id are dealt out too
    ranges = packed(rows.repartitionByRange(wanted, "id", F.xxhash64("q")).sortWithinPartitions("id"), width, BLOCK * RANGE_BLOCKS, "range")
    asked = packed(queries.repartitionByRange(groups, "id").sortWithinPartitions("id"), width, GROUP, "g").select("g", F.col("ids").alias("query_ids"), F.col("rows").alias("queries"))
    n_ranges = ranges.count()
    n_packs = max(1, math.ceil(n_ranges / PACK))
    packs = written(packs_of(ranges, n_packs))

    def bounded(groups_: DataFrame, floors: bool) -> DataFrame:
        """g and range: where a group's bounds reach a floor; without floors, each query's best range of a pack, with the bound."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    own = np.frombuffer(row["query_ids"], dtype="<i8")
                    bounds = bounds_of(*exact(*(of_bytes(row[c], width) for c in ("queries", "highs", "lows"))))
                    blocks_of = np.frombuffer(row["of"], dtype="<i8")
                    starts = np.flatnonzero(np.concatenate([[True], blocks_of[1:] != blocks_of[:-1]]))
                    of, best = blocks_of[starts], np.maximum.reduceat(bounds, starts, axis=1)  # best: of each query, for each range
                    if floors:
                        least = of_floors(row, own)
                        reach = np.array([np.ones(len(of), bool) if f is None else best[i] >= -f[0] for i, f in enumerate(least)]).any(0)
                        of, asking, top = of[reach], np.zeros(int(reach.sum()), np.int64), np.zeros(int(reach.sum()))
                    else:
                        at = best.argmax(1)
                        of, asking, top = of[at], own, best[np.arange(len(own)), at]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(of), row["g"])), pa.array(of, pa.int64()), pa.array(asking, pa.int64()), pa.array(top.astype(np.float64))], names=["g", "range", "query_id", "bound"])

        pairs = groups_.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(n_packs - 1)))).repartition(F.col("g"), F.col("pack"))
        return pairs.join(packs, "pack").mapInArrow(run, "g long, range long, query_id long, bound double")

    def scored(pairs: DataFrame, groups_: DataFrame) -> DataFrame:
        """Rows that the groups (g, queries, floors) find in the ranges that they meet (g, range)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    own = np.frombuffer(row["query_ids"], dtype="<i8")
                    b, a = exact(of_bytes(row["queries"], width), of_bytes(row["rows"], width))
                    found, _ = search(np.frombuffer(row["ids"], dtype="<i8"), a, own, b, k, block, floors=of_floors(row, own))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else ((), (), ()))], names=["query_id", "vec_id", "score"])

        # a range meets its groups in several tasks where there are few ranges; a task holds one range and one group at a time
        parts = max(1, math.ceil(PARTS / n_ranges))
        part = F.pmod(F.xxhash64("g"), F.lit(parts)).cast("int")
        left = pairs.join(groups_, "g").withColumn("part", part)
        right = ranges.select("range", "ids", "rows", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
        return left.join(right.hint("merge"), ["range", "part"]).mapInArrow(run, "query_id long, vec_id long, score long")

    none = asked.withColumn("floors", F.array().cast("array<struct<id:bigint,less:bigint,at:bigint>>"))
    best = bounded(none, False).groupBy("g", "query_id").agg(F.max_by("range", F.struct("bound", "range")).alias("range"))
    votes = best.groupBy("g", "range").agg(F.count("*").alias("votes"))
    first = Window.partitionBy("g").orderBy(F.desc("votes"), "range")
    seeds = written(votes.withColumn("n", F.row_number().over(first)).where(F.col("n") <= FIRST).select("g", "range"))
    found = written(scored(seeds, none))
    # the k-th best that a query has so far; a group has GROUP queries at most
    kth = ranked(found, k).where(F.col("rank") == k).select("query_id", F.struct(F.col("query_id").alias("id"), (-F.col("score")).alias("less"), F.col("vec_id").alias("at")).alias("floor"))
    known = asked.select("g", "query_ids").mapInArrow(members, "g long, query_id long")
    known = known.join(kth, "query_id").groupBy("g").agg(F.collect_list("floor").alias("floors"))
    floored = written(asked.join(known, "g", "left"))
    rest = written(bounded(floored, True).select("g", "range").join(seeds, ["g", "range"], "left_anti"))
    return Meetings(found, scored(rest, floored), seeds, rest, n_ranges, asked.count())


def of_floors(row: dict, own: np.ndarray) -> list:
    known = {f["id"]: (f["less"], f["at"]) for f in row["floors"] or []}
    return [known.get(int(i)) for i in own]


def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """g and query_id of the queries of groups."""
    for batch in batches:
        for g, ids in zip(batch.column("g").to_pylist(), batch.column("query_ids").to_pylist(), strict=True):
            own = np.unique(np.frombuffer(ids, dtype="<i8"))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), g)), pa.array(own)], names=["g", "query_id"])


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query with their rank. Tasks keep k rows of a query before they pass any on."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, is_query: Column, *, key: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best rows by integer inner product, ties to the smaller id.

    is_query is a condition on the column id, which is the key.

    A repeated row counts as often as it is there, but never for a query of its own id. Rows shorter than others count as
    having zeros; scores beyond a long become the nearest one. Rows without a key or with a component that is null or not
    finite take no part.
    """
    rows = quantised(vectors, key, vector)
    met = meetings(rows, rows.where(is_query), k)
    if met is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return ranked(met.first.unionByName(met.others), k)


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


ORACLE_SQL = """
with v as (
 select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q from embeddings
 where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
 select a.vec_id as query_id, b.vec_id as vec_id, cast(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) as bigint) as score
 from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
"""
