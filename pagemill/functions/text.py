"""Text measures and extraction as column expressions.

White space is Unicode's, as in `(?U)\\s`; letters and digits are Unicode's in `alnum`, ASCII and Hangul elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HANGUL = "\\uAC00-\\uD7A3"
#: A question's number: up to three digits and a dot or comma, before white space, the end, a letter or an opening bracket.
NUMBER = rf"(?<![0-9])([0-9]{{1,3}})[.,](?=(?U:\s)|$|[A-Za-z{HANGUL}(\[])"
#: Signs that recognition errors leave behind (fixed values).
SUSPICIOUS = r"|\[\]{}<>@#$%^&*=+~`"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it, also within functions of an array's elements."""
    return F.get(F.transform(F.array(value), f), 0)


def first_by(rows: Column, key: Callable[[Column], Column]) -> Column:
    """Of an array's elements with one key, the first."""
    return let(rows, lambda r: let(F.transform(r, key), lambda keys: F.filter(r, lambda _, i: F.array_position(keys, F.get(keys, i)) == i + 1)))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def count_chars(c: Column, members: str) -> Column:
    """How many characters of a class: what is left without all others, which is cheaper than listing matches."""
    return F.length(F.regexp_replace(c, f"[^{members}]+", ""))


def count_space(c: Column) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, r"(?U)\s+", ""))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def normalised(c: Column) -> Column:
    """For comparison: without a leading number, white space and signs, lower-cased."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"^(?U:\s)*[0-9]{1,3}[.,](?U:\s)*", ""), rf"[^0-9A-Za-z{HANGUL}]", ""))


def compact(c: Column) -> Column:
    """Lower-cased, white space as single blanks."""
    return F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), r"(?U)\s+", " ")


def answer_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), rf"[^0-9A-Za-z{HANGUL}]+", "")


def nonempty_lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|[\n\r\u000B\u000C\u001C-\u001E\u0085\u2028\u2029]"), strip), lambda x: x != "")


#: What `with_quality` adds.
QUALITY = ("char_count", "token_count", "alnum_ratio", "symbol_ratio", "word_ratio", "hangul_count", "latin_count", "digit_count", "quality_score", "noise_score", "suspect", "suspect_reasons")


def with_quality(df: DataFrame, text: Column, conf: Column) -> DataFrame:
    """Counts, ratios and scores of recognised text, and why it looks wrong. Ratios are rounded to 4 digits after the reasons are found.

    Each step only uses columns of the one before, so that the text is stripped and counted once however often counts are used.
    """
    t, own = F.col("_text"), df.columns
    out = df.withColumns({"_text": strip(F.coalesce(text, F.lit(""))), "_low": F.coalesce(conf < 0.5, F.lit(False))})
    out = out.withColumns({
        "char_count": F.length(t) - count_space(t), "token_count": F.when(t == "", 0).otherwise(F.size(F.split(t, r"(?U)\s+"))),
        "_alnum": count_chars(t, r"\p{L}\p{N}"), "_symbols": count_chars(t, SUSPICIOUS), "_words": count(t, rf"[A-Za-z]{{2,}}|[{HANGUL}]{{2,}}"),
        "hangul_count": count_chars(t, HANGUL), "latin_count": count_chars(t, "A-Za-z"), "digit_count": count_chars(t, "0-9"),
    })
    chars, tokens = F.col("char_count"), F.col("token_count")
    out = out.withColumns({"_alnum": F.col("_alnum") / F.greatest(F.lit(1), chars), "_symbols": F.col("_symbols") / F.greatest(F.lit(1), chars), "_words": F.col("_words") / F.greatest(F.lit(1), tokens)})
    alnum, symbols, words, low = (F.col(c) for c in ("_alnum", "_symbols", "_words", "_low"))
    out = out.withColumn("_score", clamp(F.lit(0.58) * alnum + F.lit(0.22) * words + F.lit(0.20) * (F.lit(1.0) - symbols), 0.0, 1.0))
    score = F.col("_score")
    noise = clamp(F.lit(1.0) - score + F.lit(0.60) * symbols + F.when(low, 0.25).otherwise(0.0), 0.0, 2.0)
    reasons = F.array_compact(
        F.array(
            F.when((score < 0.45) & (chars >= 12), "low_quality_score"),
            F.when((symbols > 0.18) & (chars >= 12), "high_symbol_ratio"),
            F.when((words < 0.2) & (tokens >= 6), "few_word_tokens"),
            F.when(low, "low_confidence"),
        )
    )
    out = out.withColumns({"alnum_ratio": F.round(alnum, 4), "symbol_ratio": F.round(symbols, 4), "word_ratio": F.round(words, 4), "quality_score": F.round(score, 4), "noise_score": F.round(noise, 4), "suspect_reasons": reasons})
    return out.withColumn("suspect", F.size("suspect_reasons") > 0).select(*[c for c in own if c not in QUALITY], *QUALITY)


def heuristic_score(c: Column) -> Column:
    """Letters and digits, some of the white space and length, less signs that text rarely has; 0 of nothing."""
    t = F.coalesce(c, F.lit(""))
    return count_chars(t, r"\p{L}\p{N}") + F.lit(0.3) * count_space(t) - F.lit(0.5) * count_chars(t, "@#$%^&*<>") + F.lit(0.01) * F.length(t)


def score_to_confidence(score: Column) -> Column:
    return clamp((score + 5.0) / 60.0, 0.01, 0.99)


def merge_confidence(heuristic: Column, native: Column) -> Column:
    mixed = F.lit(0.65) * clamp(native, 0.0, 1.0) + F.lit(0.35) * heuristic
    return clamp(F.when(native.isNull(), heuristic).otherwise(mixed), 0.01, 0.99)


def language_hint(c: Column) -> Column:
    t = F.coalesce(c, F.lit(""))
    hangul, latin = count_chars(t, HANGUL), count_chars(t, "A-Za-z")
    return F.when(latin > F.greatest(F.lit(3), hangul * 2), "eng").when(hangul > F.greatest(F.lit(3), latin * 2), "kor").otherwise("mixed")


def text_weight(c: Column) -> Column:
    return count_chars(F.coalesce(c, F.lit("")), f"A-Za-z{HANGUL}0-9")


#: Phrases of instructions (fixed values).
INSTRUCTIONS = ("보기 안에서", "빈칸", "바르게 배열")


def role(c: Column) -> Column:
    t = F.coalesce(c, F.lit(""))
    cue = F.lit(False)
    for x in INSTRUCTIONS:
        cue = cue | t.contains(x)
    options = (t.contains("[") & t.contains("]")) | (t.contains(")") & (count(t, r"\(") >= 2))
    return F.when(strip(t) == "", "misc").when(cue, "instruction").when(options, "options").when(t.contains("?") | t.endswith("."), "prompt").otherwise("misc")


def kind(engine: Column) -> Column:
    return F.when(F.lower(F.coalesce(engine, F.lit(""))).contains("trocr"), "handwriting").otherwise("printed")


def question_numbers(c: Column) -> Column:
    """Distinct numbers in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(NUMBER), F.lit(1)), lambda x: x.cast("int")))


def question_pieces(c: Column) -> Column:
    """(number, text) of each stretch from one question's number to the next; what comes before the first is dropped."""
    t = strip(F.coalesce(c, F.lit("")))
    pieces = F.split(t, f"(?={NUMBER})")
    starts = F.filter(pieces, lambda p: p.rlike(f"^{NUMBER}"))
    return F.transform(starts, lambda p: F.struct(F.regexp_extract(p, NUMBER, 1).cast("int").alias("number"), strip(p).alias("text")))


def option_candidates(c: Column) -> Column:
    """Alternatives inside brackets, braces and parentheses (in this order), each once, whatever its case."""
    t = F.coalesce(c, F.lit(""))
    groups = F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in (r"\[([^\[\]\n]{2,120})[\]}]", r"\{([^{}\n]{2,120})[}\]]", r"\(([^()\n]{2,120})\)")])
    groups = F.filter(F.transform(groups, strip), lambda g: (g != "") & ~g.rlike(r"^[0-9]+[.)]?$"))

    def parts(g: Column, pattern: str) -> Column:
        return F.filter(F.transform(F.split(g, pattern), strip), lambda p: p != "")

    def split_group(g: Column) -> Column:
        signs, words = parts(g, r"(?U)\s*[,|/·ㆍ]\s*"), parts(g, r"(?U)\s+(?:or|OR|또는)\s+")
        none = F.array().cast("array<string>")
        return let(signs, lambda x: F.when(F.size(x) >= 2, x).otherwise(let(words, lambda y: F.when(F.size(y) >= 2, y).otherwise(none))))

    bare = F.filter(F.transform(F.flatten(F.transform(groups, split_group)), lambda p: F.regexp_replace(p, "^['\"“”‘’`]+|['\"“”‘’`]+$", "")), lambda p: p != "")
    return first_by(bare, compact)


def noisy_tokens(c: Column) -> Column:
    """Tokens with signs of recognition errors, or of both scripts, each once, whatever its case."""
    tokens = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"([A-Za-z0-9{HANGUL}{{}}\[\]|`~^_+-]{{2,32}})"), F.lit(1))
    noisy = F.filter(tokens, lambda t: (F.length(normalised(t)) >= 2) & (t.rlike(r"[{}\[\]|`~^]") | (t.rlike("[A-Za-z]") & t.rlike(f"[{HANGUL}]"))))
    return first_by(noisy, F.lower)


def lexicon_tokens(c: Column) -> Column:
    """Words, each once by its normalised form."""
    tokens = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"([A-Za-z{HANGUL}]{{2,24}})"), F.lit(1))
    return first_by(tokens, F.lower)


def preview(c: Column, n: int = 180) -> Column:
    return F.substring(F.replace(c, F.lit("\n"), F.lit(" ")), 1, n)


def block_id(pos: Column, letter: str = "b") -> Column:
    """Three digits at least; lpad would cut longer numbers."""
    number = F.when(F.length(pos.cast("string")) < 3, F.lpad(pos.cast("string"), 3, "0")).otherwise(pos.cast("string"))
    return F.concat(F.lit(letter), number) if letter else number


def block_index(c: Column) -> Column:
    """The 1-based position in a block id of three digits; null for others."""
    return F.when(strip(c).rlike("^b[0-9]{3}$"), F.substring(strip(c), 2, 3).cast("int"))


def stage_file_name(c: Column) -> Column:
    return F.translate(c, "/ ", "__")


def base_name(path: Column) -> Column:
    """The last part of a path; slashes at its end aside."""
    return F.regexp_extract(F.regexp_replace(path, "/+$", ""), "[^/]*$", 0)


def append_note(note: Column, more: str) -> Column:
    """The note with `more` after a semicolon, unless it says so already."""
    old = F.coalesce(note, F.lit(""))
    return F.when(old.contains(more), old).when(strip(old) == "", F.lit(more)).otherwise(F.concat(old, F.lit(f"; {more}")))


def ngrams(tokens: Column, most: int = 3) -> Column:
    """Joined runs of one to `most` tokens, by start, then length."""

    def runs(w: Column) -> Column:
        n = F.size(w)
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n)), lambda i: F.transform(F.sequence(F.lit(1), F.lit(most)), lambda k: F.when(i + k - 1 <= n, F.array_join(F.slice(w, i, k), ""))))

    return F.array_compact(F.flatten(let(tokens, runs)))
