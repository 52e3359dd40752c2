"""Hints for a language model that corrects a page: what suspect lines and tokens probably read.

Lines and tokens meet the page's own canonical lines and words only, which stand in the same row, so nothing is shuffled or
joined here. The likeness of two strings is difflib's ratio; it runs on Arrow batches. Ties go to the first.
"""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..functions import text as T

#: Least confidence of unsuspected blocks and of canonical ones; least likeness of lines and of tokens.
SURE, CANONICAL, LINE_LIKENESS, TOKEN_LIKENESS = 0.72, 0.8, 0.45, 0.62
#: Shortest keys of lines and of canonical lines of blocks; most difference of tokens' lengths; tokens looked up.
LINE, OWN_LINE, BAND, TOKENS = 6, 10, 4, 120
#: Entries that a page's hints hold at most.
MOST = {"suspect_block_ids": 40, "rewrite_hints": 40, "token_replacements": 80, "unresolved_lines": 60, "unresolved_tokens": 120, "canonical_lines": 40}
#: Rules that go with the hints.
RULES = (
    "Prefer question_chunks.text and question_chunks.option_candidates as canonical references.",
    "When raw_line roughly matches suggested_line, normalize raw_line to suggested_line without changing meaning.",
    "Use token_replacements only when surrounding context agrees.",
    "Do not invent new options; keep options from OCR candidates verbatim.",
    "For unresolved_lines and unresolved_tokens, infer only from nearby context; keep raw OCR when uncertain.",
)


@F.pandas_udf(ArrayType(StructType([StructField("at", IntegerType()), StructField("ratio", DoubleType())])))
def closest(some: pd.Series, known: pd.Series, band: pd.Series) -> pd.Series:
    """For each string of a page the place (0-based) of the likest known one, the first of several, and the ratio.

    Lengths of both may differ by `band` at most, unless it is negative. Without anything alike the place is null, the ratio 0.
    """

    def best(keys: list[str], others: list[str], most: int) -> list[dict]:
        found = [(0.0, None)] * len(keys)
        matcher = SequenceMatcher(None)
        for at, other in enumerate(others):
            matcher.set_seq2(other)
            for i, key in enumerate(keys):
                if most >= 0 and abs(len(key) - len(other)) > most:
                    continue
                matcher.set_seq1(key)
                # upper bounds first: they cost little, and leave the result as it is
                if matcher.real_quick_ratio() > found[i][0] and matcher.quick_ratio() > found[i][0] and (ratio := matcher.ratio()) > found[i][0]:
                    found[i] = (ratio, at)
        return [{"at": at, "ratio": ratio} for ratio, at in found]

    return pd.Series([best(list(k), list(o), int(b)) for k, o, b in zip(some, known, band, strict=True)], dtype=object)


def _keyed(lines: Column, least: int) -> Column:
    """Lines with their keys, if these have `least` characters."""
    return F.filter(F.transform(lines, lambda x: F.struct(x.alias("line"), T.normalised(x).alias("key"))), lambda x: F.length(x["key"]) >= least)


def _each(rows: Column, texts: Callable[[Column], Column]) -> Column:
    return F.flatten(F.transform(rows, texts))


def _matched(rows: str, found: str, known: str, least: float) -> Column:
    """Rows with ratio, and with match and match_key where the ratio is high enough."""

    def one(x: Column, i: Column) -> Column:
        f = F.get(F.col(found), i)
        match = F.when(f["ratio"] >= least, F.get(F.col(known), f["at"]))
        return F.struct(x.alias("of"), match["line"].alias("match"), match["key"].alias("match_key"), F.round(f["ratio"], 4).alias("ratio"))

    return F.transform(F.col(rows), one)


def _listed(name: str, rows: Column, **fields: Callable[[Column], Column]) -> Column:
    return F.transform(F.slice(rows, 1, MOST[name]), lambda x: F.struct(*[f(x).alias(k) for k, f in fields.items()])).alias(name)


def hints(of: DataFrame) -> DataFrame:
    """of with the column hints (a struct). of: `questions.pages` of diagnosed blocks, which have the column suspect.

    A block without confidence is suspect. Pages without suspect blocks have empty lists. Canonical lines are those of
    questions, then those of blocks that were recognised with confidence, each once by its key.
    """
    suspects = F.filter("blocks", lambda b: b["suspect"] | (F.coalesce(b["conf"], F.lit(0.0)) < SURE))
    page = of.withColumn("_suspects", suspects)
    asked = _keyed(_each(F.col("questions"), lambda q: T.nonempty_lines(q["text"])), LINE)
    sure = F.filter("blocks", lambda b: b["conf"] >= CANONICAL)
    own = _keyed(_each(sure, lambda b: T.nonempty_lines(b["txt"])), OWN_LINE)
    words = _each(F.col("questions"), lambda q: _each(F.concat(F.array(q["text"]), q["option_candidates"]), T.lexicon_tokens))
    page = page.withColumns({
        "_known": F.concat(asked, own), "_words": _keyed(words, 2),
        "_lines": _each(F.col("_suspects"), lambda b: F.transform(_keyed(T.nonempty_lines(b["txt"]), LINE), lambda x: F.struct(b["block_id"].alias("block_id"), x["line"].alias("line"), x["key"].alias("key")))),
        "_tokens": F.transform(_each(F.col("_suspects"), lambda b: T.noisy_tokens(b["txt"])), lambda x: F.struct(x.alias("line"), F.lower(x).alias("low"))),
    })
    key = lambda x: x["key"]
    noisy = F.slice(T.first_by(F.col("_tokens"), lambda x: x["low"]), 1, TOKENS)
    page = page.withColumns({"_known": T.first_by(F.col("_known"), key), "_words": T.first_by(F.col("_words"), key), "_tokens": _keyed(F.transform(noisy, lambda x: x["line"]), 2)})
    page = page.withColumns({
        "_like": closest(F.transform("_lines", key), F.transform("_known", key), F.lit(-1)),
        "_like_token": closest(F.transform("_tokens", key), F.transform("_words", key), F.lit(BAND)),
    })
    page = page.withColumns({"_lines": _matched("_lines", "_like", "_known", LINE_LIKENESS), "_tokens": _matched("_tokens", "_like_token", "_words", TOKEN_LIKENESS)})
    found, missed = F.filter("_lines", lambda x: x["match"].isNotNull()), F.filter("_lines", lambda x: x["match"].isNull())
    rewritten = T.first_by(F.filter(found, lambda x: x["match_key"] != x["of"]["key"]), lambda x: F.struct(x["of"]["key"], x["match_key"]))
    open_lines = T.first_by(missed, lambda x: F.struct(x["of"]["block_id"], x["of"]["key"]))
    replaced = F.filter("_tokens", lambda x: x["match_key"] != x["of"]["key"])
    open_tokens = F.filter("_tokens", lambda x: x["match"].isNull())
    block, line, match, ratio = (lambda x: x["of"]["block_id"]), (lambda x: x["of"]["line"]), (lambda x: x["match"]), (lambda x: x["ratio"])
    body = F.struct(
        F.array(*map(F.lit, RULES)).alias("rules"),
        F.transform(F.slice("_suspects", 1, MOST["suspect_block_ids"]), lambda b: b["block_id"]).alias("suspect_block_ids"),
        _listed("rewrite_hints", rewritten, block_id=block, raw_line=line, suggested_line=match, similarity=ratio),
        _listed("token_replacements", replaced, raw_token=line, suggested_token=match, similarity=ratio),
        _listed("unresolved_lines", open_lines, block_id=block, raw_line=line, best_similarity=ratio),
        _listed("unresolved_tokens", open_tokens, raw_token=line, best_similarity=ratio),
        F.transform(F.slice("_known", 1, MOST["canonical_lines"]), lambda x: x["line"]).alias("canonical_lines"),
    )
    return page.select(*of.columns, body.alias("hints"))


def cleanup_hints(of: DataFrame) -> DataFrame:
    """page_id and hints (JSON) of each page; see `hints`."""
    return hints(of).select("page_id", F.to_json("hints", {"ignoreNullFields": "false"}).alias("hints"))
