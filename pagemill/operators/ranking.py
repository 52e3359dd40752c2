"""Candidates of a recognised region: agreement, ranking, guards and routing.

Similarity of two texts is difflib's ratio, which no built-in function gives; it runs on Arrow batches and depends on the
order of its arguments.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as T

#: Texts that a task holds prepared for comparison at once.
PREPARED = 1_000
#: Texts whose subsequences are found together.
TOGETHER = 32
#: Characters of the n-grams by which texts with popular characters are told apart.
GRAM = 4


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def consensus(candidates: DataFrame, by_value: bool = False) -> DataFrame:
    """cand_seq and consensus: what a candidate (page_id, box_id, cand_seq, text) shares with the others of its region.

    By position all others count, on compact texts; by value only those with another text, as they are. Empty texts share
    nothing. A region has a handful of candidates, one for each engine and image variant.
    """
    key = ["page_id", "box_id"]
    own = candidates.select(*key, "cand_seq", (F.coalesce("text", F.lit("")) if by_value else T.compact(F.col("text"))).alias("t"))
    other = own.select(*key, F.col("cand_seq").alias("other_seq"), F.col("t").alias("o"))
    differ = (F.col("t") != F.col("o")) if by_value else (F.col("cand_seq") != F.col("other_seq"))
    filled = (F.col("t") != "") if by_value else (F.col("t") != "") & (F.col("o") != "")
    sums = own.join(other, key).where(differ & filled).withColumn("ratio", similarity("t", "o")).groupBy(*key, "cand_seq").agg(F.sum("ratio").alias("consensus"))
    return candidates.join(sums, [*key, "cand_seq"], "left").withColumn("consensus", F.coalesce("consensus", F.lit(0.0)))


def rank(candidates: DataFrame, consensus_column: str | None = "consensus") -> DataFrame:
    """composite and rank of each candidate; the composite is rounded to 4 digits before ranking, the earliest wins ties."""
    agree = F.col(consensus_column) if consensus_column else F.lit(0.0)
    conf = F.coalesce("conf", F.lit(0.0))
    out = T.with_quality(candidates, F.col("text"), conf).drop(*[c for c in T.QUALITY if c not in ("quality_score", "noise_score")])
    out = out.withColumn("_score", T.heuristic_score(F.col("text")))
    composite = F.round(F.col("_score") + agree * 4.5 + conf * 10.0 + F.col("quality_score") * 8.0 - F.col("noise_score") * 3.0, 4)
    out = out.withColumns({"score": F.round("_score", 4), "composite": composite}).drop("_score")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("page_id", "box_id").orderBy(F.desc("composite"), "cand_seq")))


def pick_result(candidates: DataFrame, confidence: bool = True) -> DataFrame:
    """The candidate of each region with the largest sum of score, consensus by value and, if wanted, confidence; the earliest wins ties."""
    total = T.heuristic_score(F.col("text")) + F.col("consensus") + (F.coalesce("conf", F.lit(0.0)) if confidence else F.lit(0.0))
    order = Window.partitionBy("page_id", "box_id").orderBy(F.desc("total"), "cand_seq")
    return consensus(candidates, by_value=True).withColumn("total", total).withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def available(names: list[str], make: Callable[[str], object], *, allow_missing: bool = False, least: int = 1) -> tuple[dict[str, object], list[str]]:
    """Engines by name, made by `make`, and what went wrong with the others. Raises if one is missing, unless that is allowed, or if fewer than `least` are there."""
    found, errors = {}, []
    for name in names:
        try:
            found[name] = make(name)
        except Exception as e:  # noqa: BLE001  a missing engine is an entry of errors
            if not allow_missing:
                raise
            errors.append(f"{name}: {e}")
    if len(found) < max(1, least):
        raise RuntimeError(f"{max(1, least)} engines are needed, {len(found)} are there ({'; '.join(errors) or 'none named'})")
    return found, errors


def ensemble(results: DataFrame) -> DataFrame:
    """One result of each region from all engines': text, conf, latency_ms and what speaks for it (selected, candidates, errors).

    results: page_id, box_id, cand_seq, engine, text, conf, latency_ms, error; rows with an error have no text. A region whose
    engines all failed has an empty text of confidence 0.
    """
    key = ["page_id", "box_id"]
    entry = F.struct("cand_seq", "engine", F.round("conf", 4).alias("conf"), F.round("latency_ms", 2).alias("latency_ms"), F.round(T.heuristic_score(F.col("text")), 4).alias("score"))
    failed = F.struct("cand_seq", "engine", "error")
    told = results.groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("error").isNull(), entry))), lambda x: x.dropFields("cand_seq")).alias("candidates"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), failed))), lambda x: x.dropFields("cand_seq")).alias("errors"),
        F.sum("latency_ms").alias("latency_ms"),
    )
    best = pick_result(results.where("error is null")).select(*key, "text", "conf", F.col("engine").alias("selected"))
    out = told.join(best, key, "left")
    return out.select(*key, F.coalesce("text", F.lit("")).alias("text"), F.coalesce("conf", F.lit(0.0)).alias("conf"), F.lit("ensemble").alias("engine"), "latency_ms", "selected", "candidates", "errors")


#: Errors of a region's calls that are kept (a fixed value).
MOST_ERRORS = 32


def call_statistics(calls: DataFrame) -> DataFrame:
    """attempted_calls, candidates_added and the first errors of each region's calls (page_id, box_id, cand_seq, engine, variant, text, error).

    A call adds a candidate unless it failed or repeats an engine's text, white space and case aside.
    """
    key = ["page_id", "box_id"]
    added = first_of_signature(calls.where("error is null")).groupBy(*key).agg(F.count("*").alias("added"))
    failed = F.when(F.col("error").isNotNull(), F.struct("cand_seq", "engine", "variant", "error"))
    told = calls.groupBy(*key).agg(F.count("*").alias("attempted_calls"), F.transform(F.slice(F.array_sort(F.collect_list(failed)), 1, MOST_ERRORS), lambda x: x.dropFields("cand_seq")).alias("errors"))
    return told.join(added, key, "left").select(*key, "attempted_calls", F.coalesce("added", F.lit(0)).cast("long").alias("candidates_added"), "errors")


def first_of_signature(candidates: DataFrame) -> DataFrame:
    """Candidates without those that repeat an engine's text, white space and case aside."""
    order = Window.partitionBy("page_id", "box_id", "engine", T.compact(F.col("text"))).orderBy("cand_seq")
    return candidates.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def keep_text_guard(weight: Column, original_weight: Column, ratio: float) -> Column:
    """Whether masking lost too much text, so that the original stands."""
    return weight < (original_weight * min(1.0, max(0.1, ratio))).cast("int")


def engine_for(label: Column, handwriting: Column, handwritten: str, printed: str, default: str) -> Column:
    low = F.lower(label)
    by_hand = handwriting | low.contains("hand") | low.contains("answer")
    in_print = low.contains("printed") | low.contains("text") | low.contains("question")
    return F.when(by_hand, handwritten).when(in_print, printed).otherwise(default)


def retry_low_confidence(conf: Column, engine: Column, threshold: float, fallback: str) -> Column:
    return F.when((conf < threshold) & (F.lower(engine) != fallback.lower()), fallback.lower())


def retry_language(hint: Column, engine: Column, english: str, korean: str, mixed: str) -> Column:
    target = F.when(F.lower(hint) == "eng", english).when(F.lower(hint) == "kor", korean).when(F.lower(hint) == "mixed", mixed)
    return F.when(F.lower(target) != F.lower(engine), target)


def boosted(conf: Column, noise: Column, least_conf: float, most_noise: float, always: bool = False) -> Column:
    return F.lit(always) | (conf < least_conf) | (noise >= most_noise)


def tesseract_languages(name: Column) -> Column:
    """`tesseract_<a>_<b>` means languages a+b."""
    return F.when(name.startswith("tesseract_"), F.replace(F.regexp_replace(name, "^tesseract_", ""), F.lit("_"), F.lit("+")))


def with_fallbacks(engines: Column, fallbacks: Column) -> Column:
    """Configured engines as they are, then those fallbacks that are new; blanks go."""
    filled = [F.filter(x, lambda e: T.strip(e) != "") for x in (engines, fallbacks)]
    return F.concat(filled[0], F.array_except(filled[1], filled[0]))


def best_match(left: DataFrame, right: DataFrame, least: float, band: int | None = None) -> DataFrame:
    """The most similar text of the page for each text (page_id, seq, text); null match below `least`; ties to the first.

    A band keeps pairs whose lengths differ by no more, before the costly comparison.
    """
    r = right.select("page_id", F.col("seq").alias("r_seq"), F.col("text").alias("match"))
    pairs = left.join(r, "page_id")
    if band is not None:
        pairs = pairs.where(F.abs(F.length("text") - F.length("match")) <= band)
    scored = pairs.withColumn("ratio", similarity("text", "match"))
    top = scored.withColumn("_n", F.row_number().over(Window.partitionBy("page_id", "seq").orderBy(F.desc("ratio"), "r_seq"))).where("_n = 1")
    best = top.where(F.col("ratio") >= least).select("page_id", "seq", "match", F.round("ratio", 4).alias("ratio"))
    return left.join(best, ["page_id", "seq"], "left")


class Known:
    """A text that others are compared with, as SequenceMatcher(None, other, text) sees it: with how many characters from each place a match may begin.

    Of texts of 200 characters and more that's none where a character is popular; those only lengthen matches.
    """

    def __init__(self, text: str):
        self.text = text
        popular = SequenceMatcher(None, "", text).bpopular
        self.reach = [0] * (len(text) + 1)
        for j in range(len(text) - 1, -1, -1):
            if text[j] not in popular:
                self.reach[j] = self.reach[j + 1] + 1
        self.places = [j for j, n in enumerate(self.reach) if n]
        self.far = [(j, text[j : j + GRAM]) for j in self.places if self.reach[j] >= GRAM]
        self.whole = not popular

    def starts(self, grams: set[str]) -> list[int]:
        """Where matches of GRAM characters and more may begin, by the other text's n-grams."""
        return [j for j, g in self.far if g in grams]

    def longest(self, other: str, lo: int, hi: int, b_lo: int, b_hi: int, starts: list[int]) -> tuple[int, int, int]:
        """What find_longest_match gives, by searching for the pieces of text in the other; short ones only if there are no others."""
        size, at, to = self._found(other[lo:hi], starts, b_lo, b_hi, GRAM)
        if not size:
            size, at, to = self._found(other[lo:hi], self.places, b_lo, b_hi, 1)
        i, j, k = (lo + at, to, size) if size else (lo, b_lo, 0)
        if not self.whole:
            while i > lo and j > b_lo and other[i - 1] == self.text[j - 1]:
                i, j, k = i - 1, j - 1, k + 1
            while i + k < hi and j + k < b_hi and other[i + k] == self.text[j + k]:
                k += 1
        return i, j, k

    def _found(self, part: str, places: list[int], b_lo: int, b_hi: int, least: int) -> tuple[int, int, int]:
        """Length of the longest match of `least` characters that begins at one of the places (0: none), where in the part and where in the text; the first of equals."""
        text = self.text
        size = at = to = 0
        for j in places[bisect_left(places, b_lo) : bisect_left(places, b_hi)]:
            most, k = min(self.reach[j], b_hi - j), size or least
            if k > most or text[j : j + k] not in part:
                continue
            while k < most and text[j : j + k + 1] in part:
                k += 1
            i = part.index(text[j : j + k])
            if k > size or i < at:
                size, at, to = k, i, j
        return size, at, to


def grams_of(text: str) -> set[str]:
    return {text[x : x + GRAM] for x in range(len(text) - GRAM + 1)}


def ratio_from(other: str, known: Known, least: float, grams: set[str]) -> float | None:
    """difflib's ratio of both texts; null as soon as what is left to compare can't bring it to `least`. Largest parts come first.

    grams: the other text's n-grams.
    """
    total = len(other) + len(known.text)
    if not total:
        return 1.0
    matched, left = 0, min(len(other), len(known.text))
    todo, starts = [(-left, 0, len(other), 0, len(known.text))], known.starts(grams)
    while todo:
        if 2.0 * (matched + left) / total < least:
            return None
        most, a, a_end, b, b_end = heappop(todo)
        left += most
        i, j, k = known.longest(other, a, a_end, b, b_end, starts)
        if k:
            matched += k
            for part in ((a, i, b, j), (i + k, a_end, j + k, b_end)):
                most = min(part[1] - part[0], part[3] - part[2])
                if most > 0:
                    heappush(todo, (-most, *part))
                    left += most
    ratio = 2.0 * matched / total
    return ratio if ratio >= least else None


class Subsequences:
    """Lengths of the longest common subsequences of a text and several others, all of them in one integer's bits (of one more for each, which stays empty)."""

    def __init__(self, texts: list[str]):
        self.lengths, self.masks, self.full, self.starts, at = [len(t) for t in texts], {}, 0, [], 0
        for t in texts:
            self.starts.append(at)
            for x, c in enumerate(t, at):
                self.masks[c] = self.masks.get(c, 0) | 1 << x
            self.full |= ((1 << len(t)) - 1) << at
            at += len(t) + 1

    def of(self, other: str) -> list[int]:
        v, full, masks = self.full, self.full, self.masks
        for c in other:
            if c in masks:
                u = v & masks[c]
                v = ((v + u) | (v - u)) & full
        return [n - ((v >> at) & ((1 << n) - 1)).bit_count() for n, at in zip(self.lengths, self.starts, strict=True)]


class Pieces:
    """How much of texts with popular characters another text can match.

    A match holds one of the text's rare characters, each in common with the other, or begins both texts. If it has GRAM
    characters or more, all its n-grams are in the other text: it lies in a stretch of such n-grams that has a rare character.
    """

    def __init__(self, known: list[Known], row: dict[str, int]):
        self.grams: dict[str, int] = {}
        ids, rare, of = [], [], []
        self.rare = np.zeros((len(row), len(known)), dtype=np.int32)
        self.first = np.array([k.places[0] if k.places else len(k.text) for k in known], dtype=np.int64)
        for at, k in enumerate(known):
            n, t = len(k.text), k.text
            ids += [self.grams.setdefault(t[x : x + GRAM], len(self.grams) + 1) if x + GRAM <= n else 0 for x in range(n + 1)]  # a gap behind each text
            rare += [x > 0 for x in k.reach]
            of += [at] * (n + 1)
            for j in k.places:
                self.rare[row[t[j]], at] += 1
        self.ids, self.of = np.array(ids, dtype=np.int64), np.array(of, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(rare)])

    def bounds(self, grams: set[str], rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Characters that matches have together, at most; from the other's n-grams and its counts of characters by their rows."""
        present = np.zeros(len(self.grams) + 1, dtype=bool)
        present[[self.grams[g] for g in grams if g in self.grams]] = True
        has = present[self.ids]
        inside = np.zeros(len(has) + 2, dtype=bool)
        inside[1:-1] = has
        for back in range(1, GRAM):
            inside[1 + back : -1] |= has[:-back]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, stops = edges[::2], edges[1::2]
        held = self.before[stops] > self.before[starts]
        long = np.bincount(self.of[starts[held]], (stops - starts)[held], len(self.first)).astype(np.int64)
        return long + (GRAM - 1) * np.minimum(self.rare[rows], counts[:, None]).sum(axis=0) + self.first


class Block:
    """Texts prepared for comparison at once, with bounds of their ratios to a text."""

    def __init__(self, texts: list[str]):
        self.known = [Known(t) for t in texts]
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.row = {c: i for i, c in enumerate(sorted({c for t in texts for c in t}))}
        self.counts = np.zeros((len(self.row), len(texts)), dtype=np.int32)
        for at, t in enumerate(texts):
            for c, n in Counter(t).items():
                self.counts[self.row[c], at] = n
        # where popular characters are left out, ratios are far below what subsequences allow
        popular = [at for at, k in enumerate(self.known) if not k.whole]
        self.popular, self.pieces = np.array(popular, dtype=np.int64), Pieces([self.known[at] for at in popular], self.row) if popular else None
        whole = sorted((at for at, k in enumerate(self.known) if k.whole), key=lambda at: len(texts[at]))
        self.groups = [(np.array(some), Subsequences([texts[at] for at in some])) for some in (whole[x : x + TOGETHER] for x in range(0, len(whole), TOGETHER))]

    def bounds(self, other: str, least: float, grams: set[str]) -> np.ndarray:
        """What the ratio to each text can't exceed: by common characters, then by subsequences or pieces where that reaches `least`."""
        found = {self.row[c]: n for c, n in Counter(other).items() if c in self.row}
        rows, counts = np.array(list(found), dtype=np.int64), np.array(list(found.values()), dtype=np.int64)
        shared = np.minimum(self.counts[rows], counts[:, None]).sum(axis=0)
        total = len(other) + self.lengths
        out = np.where(total > 0, 2.0 * shared / np.maximum(total, 1), 1.0)
        for some, subsequences in self.groups:
            if other and (out[some] >= least).any():
                out[some] = 2.0 * np.array(subsequences.of(other)) / total[some]
        if self.pieces and (out[self.popular] >= least).any():
            most = np.minimum(shared[self.popular], self.pieces.bounds(grams, rows, counts))
            out[self.popular] = 2.0 * most / total[self.popular]
        return out


def best_of_all(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """left with match and ratio: the most similar of all texts of right (seq, text) for each text; null below `least`; ties to the first.

    right has few rows, which every task holds. Pairs that can't reach `least` or the best so far, by their characters, their
    common subsequences or what a comparison has left, are given up: results are those of comparing all.
    """
    known = [r["text"] for r in right.where("text is not null").orderBy("seq").select("text").collect()]
    spark = left.sparkSession

    @F.pandas_udf("match string, ratio double")
    def find(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        first = Block(known[:PREPARED])
        for texts in columns:
            best = [(least, len(known))] * len(texts)
            for start in range(0, len(known), PREPARED):
                block = Block(known[start : start + PREPARED]) if start else first
                for n, text in enumerate(texts):
                    if text is None:
                        continue
                    grams = grams_of(text)
                    bounds = block.bounds(text, best[n][0], grams)
                    for at in np.argsort(-bounds, kind="stable").tolist():
                        if bounds[at] < best[n][0]:
                            break
                        ratio = ratio_from(text, block.known[at], best[n][0], grams)
                        if ratio is not None and (ratio > best[n][0] or start + at < best[n][1]):
                            best[n] = (ratio, start + at)
            found = [(known[at], ratio) if at < len(known) else (None, None) for ratio, at in best]
            yield pd.DataFrame({"match": pd.Series([x for x, _ in found], dtype=object), "ratio": pd.Series([x for _, x in found], dtype="float64")})

    # a comparison costs far more than moving its text: small tables too are dealt out to all tasks
    dealt = left.repartition(4 * spark.sparkContext.defaultParallelism)
    return dealt.withColumn("_best", find("text")).select(*left.columns, F.col("_best.match").alias("match"), F.round("_best.ratio", 4).alias("ratio"))


def consistent(chosen: DataFrame, least_similarity: float, conf_margin: float, score_margin: float) -> DataFrame:
    """Whether the original text stands (column reverted) against a chosen one that is unlike it and hardly better.

    chosen has text, conf, original_text and original_conf. Where either text is empty they count as alike.
    """
    bare = [F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "") for c in ("text", "original_text")]
    like = F.when((bare[0] != "") & (bare[1] != ""), similarity(*bare)).otherwise(1.0)
    out = chosen.withColumn("similarity", like)
    score_gap = T.heuristic_score(F.col("text")) - T.heuristic_score(F.col("original_text"))
    unlike = F.col("similarity") < min(1.0, max(0.0, least_similarity))
    return out.withColumn("reverted", unlike & (F.col("conf") - F.col("original_conf") < max(0.0, conf_margin)) & (score_gap < score_margin))
