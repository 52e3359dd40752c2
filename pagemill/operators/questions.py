"""Questions of a page from its text blocks (page_id, pos, conf, txt and box)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import geometry

#: An option text further than this from every question belongs to none.
FARTHEST = 520.0
#: A question is anchored by a block whose id has three digits; blocks further down anchor none.
LAST_ANCHOR = 999


def ordered(value: Column, *by: str) -> Column:
    """An aggregate: the values as an array in order of the `by` columns."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*by, value.alias("value")))), lambda x: x["value"])


def pieces(blocks: DataFrame) -> DataFrame:
    """A row for each piece of a block that a question's number begins: question_no, piece, nth."""
    found = blocks.where(T.strip(F.col("txt")) != "").select("page_id", "pos", "conf", F.posexplode(T.question_pieces(F.col("txt"))).alias("nth", "p"))
    return found.select("page_id", "pos", "conf", "nth", F.col("p.number").alias("question_no"), F.col("p.text").alias("piece")).where("piece <> ''")


BLOCK = ("pos", "conf", "txt", *geometry.BOX)


def pages(blocks: DataFrame, *more: str) -> DataFrame:
    """A row for each page: its blocks in order (with block_id, and `more` columns) and its questions.

    A block is read once, for its pieces and options; what blocks of a page have to do with each other is then told from the
    page's own arrays, so there is one shuffle and no join. Questions come by number: joined text, block ids, least confidence,
    options (each once, case counts) and context. Options of a block that begins no question go to the nearest question's, by
    the first block of the question, unless all are too far; a block that begins several questions gives its options to the
    last.
    """
    read = blocks.select("page_id", *BLOCK, *more, T.block_id(F.col("pos")).alias("block_id"), T.strip(F.col("txt")).alias("stripped"))
    read = read.withColumn("pieces", F.when(F.col("stripped") != "", T.question_pieces(F.col("stripped"))).otherwise(F.array().cast("array<struct<number:int,text:string>>")))
    said = F.transform("pieces", lambda p: F.struct(p["number"].alias("number"), p["text"].alias("text"), T.option_candidates(p["text"]).alias("options")))
    read = read.withColumns({"pieces": F.filter(said, lambda p: p["text"] != ""), "options": T.option_candidates(F.col("txt"))})
    held = read.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", *[c for c in read.columns if c not in ("page_id", "pos")]))).alias("blocks"))
    found = F.flatten(F.transform("blocks", lambda b: F.transform(b["pieces"], lambda p: F.struct(b["pos"].alias("pos"), b["block_id"].alias("block_id"), b["conf"].alias("conf"), p["number"].alias("number"), p["text"].alias("text"), p["options"].alias("options")))))

    def asked(pieces: Column) -> Column:
        """The questions of a page's pieces."""
        numbers = F.array_distinct(F.transform(pieces, lambda p: p["number"]))  # by first appearance
        return T.let(numbers, lambda n: T.let(anchors_of(n), lambda a: T.let(offers_of(n, a), lambda o: F.transform(F.array_sort(n), lambda x: question(x, pieces, o)))))

    def anchors_of(numbers: Column) -> Column:
        return F.transform(numbers, lambda n: F.get(F.filter("blocks", lambda b: F.exists(b["pieces"], lambda p: p["number"] == n)), 0))

    def offers_of(numbers: Column, anchors: Column) -> Column:
        some = F.filter("blocks", lambda b: F.size(b["options"]) > 0)
        return F.transform(some, lambda b: F.struct(owner(b, numbers, anchors).alias("number"), b["options"].alias("options"), b["stripped"].alias("text")))

    def owner(b: Column, numbers: Column, anchors: Column) -> Column:
        """Of the questions that the block begins, the one seen last; without any the nearest one, at equal costs the one seen first."""
        seen = F.array_max(F.transform(b["pieces"], lambda p: F.array_position(numbers, p["number"]))).cast("int")
        costs = F.transform(anchors, lambda a, i: F.struct(F.when(a["pos"] <= LAST_ANCHOR, geometry.proximity_of(a, b)).alias("cost"), i.alias("i")))
        nearest = T.let(F.array_min(F.filter(costs, lambda c: c["cost"].isNotNull())), lambda best: F.when(best["cost"] <= FARTHEST, F.get(numbers, best["i"])))
        return F.when(F.size(b["pieces"]) > 0, F.get(numbers, seen - 1)).otherwise(nearest)

    def question(n: Column, pieces: Column, offers: Column) -> Column:
        own, given = F.filter(pieces, lambda p: p["number"] == n), F.filter(offers, lambda o: o["number"] == n)

        def made(own: Column, given: Column, text: Column) -> Column:
            return F.struct(
                n.alias("question_no"), text.alias("text"), F.array_distinct(F.transform(own, lambda p: p["block_id"])).alias("block_ids"), F.array_min(F.transform(own, lambda p: p["conf"])).alias("confidence_min"),
                F.array_distinct(F.concat(F.flatten(F.transform(own, lambda p: p["options"])), F.flatten(F.transform(given, lambda o: o["options"])))).alias("option_candidates"),
                T.strip(F.array_join(F.concat(F.array(text), F.transform(given, lambda o: o["text"])), "\n")).alias("context_text"),
            )

        return T.let(own, lambda x: T.let(given, lambda y: T.let(T.strip(F.array_join(F.transform(x, lambda p: p["text"]), "\n")), lambda t: made(x, y, t))))

    return held.select("page_id", "blocks", T.let(found, asked).alias("questions"))


def chunks(blocks: DataFrame) -> DataFrame:
    """Questions of each page; see `pages`."""
    return pages(blocks).select("page_id", F.explode("questions").alias("q")).select("page_id", "q.*")


def compose(of: DataFrame) -> DataFrame:
    """A page's text: its questions and what no question took, or all blocks if it has no question; with the coverage. of: `pages`."""
    taken = F.array_distinct(F.flatten(F.transform("questions", lambda q: q["block_ids"])))
    every = of.withColumn("_filled", F.filter("blocks", lambda b: b["stripped"] != ""))
    every = every.withColumn("_rest", T.let(taken, lambda ids: F.filter("_filled", lambda b: ~F.array_contains(ids, b["block_id"]))))
    asked = F.filter("questions", lambda q: T.strip(q["text"]) != "")
    every = every.select(
        "page_id",
        F.array_join(F.transform("_filled", lambda b: b["stripped"]), "\n").alias("page_dump_text"),
        F.array_join(F.transform(asked, lambda q: q["text"]), "\n\n").alias("question_chunk_text"),
        F.transform("_rest", lambda b: b["block_id"]).alias("uncaptured_block_ids"),
        F.transform("_rest", lambda b: b["stripped"]).alias("rest"),
    )
    solid = [T.count(F.col(c), r"(?U)\S") for c in ("question_chunk_text", "page_dump_text")]
    asked_any, rest = F.col("question_chunk_text") != "", F.size("rest") > 0
    mode = F.when(asked_any & rest, "hybrid").when(asked_any, "question_chunks").otherwise("page_dump")
    chosen = F.when(asked_any & rest, F.concat("question_chunk_text", F.lit("\n\n"), F.array_join("rest", "\n"))).when(asked_any, F.col("question_chunk_text")).otherwise(F.col("page_dump_text"))
    return every.select("page_id", chosen.alias("selected_text"), mode.alias("mode"), "page_dump_text", "question_chunk_text", "uncaptured_block_ids", (solid[0] / F.greatest(F.lit(1), solid[1])).alias("coverage_ratio"))


def diagnose(blocks: DataFrame) -> DataFrame:
    """Quality of each block, with what its size and numbers add to noise and reasons."""
    out = T.with_quality(blocks, F.col("txt"), F.col("conf")).withColumn("question_numbers", T.question_numbers(F.col("txt"))).withColumn("box_area", geometry.area())
    several = F.size("question_numbers") > 1
    large = (F.col("box_area") > 250000) & (F.col("char_count") > 80) & (F.size("question_numbers") == 0)
    over = F.col("char_count") > 180
    extra = F.array_compact(F.array(F.when(several, "multiple_question_numbers_in_one_box"), F.when(large, "large_box_without_question_no"), F.when(over, "oversized_ocr_block")))
    noise = F.col("noise_score") + F.when(several, 0.2).otherwise(0.0) + F.when(large, 0.2).otherwise(0.0) + F.when(over, 0.15).otherwise(0.0)
    out = out.withColumns({"suspect_reasons": F.concat("suspect_reasons", extra), "noise_score": F.round(F.least(F.lit(2.0), noise), 4), "block_id": T.block_id(F.col("pos")), "text_preview": T.preview(F.col("txt"))})
    return out.withColumn("suspect", F.size("suspect_reasons") > 0)


def worst(diagnosed: DataFrame, most: int = 12) -> DataFrame:
    """A page's suspect blocks with most noise, ties in order of the page; rank from 1."""
    order = Window.partitionBy("page_id").orderBy(F.desc("noise_score"), "pos")
    return diagnosed.where("suspect").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def page_report(diagnosed: DataFrame, composed: DataFrame, most: int = 12) -> DataFrame:
    """A row for each page of what `diagnose` and `compose` say: counts, numbers, texts, the blocks, and the `most` noisiest suspect ones."""
    block = F.struct("pos", "block_id", *geometry.BOX, F.round("box_area", 2).alias("box_area"), "conf", "question_numbers", F.col("txt").alias("text"), "text_preview", *T.QUALITY)
    noisy = F.when(F.col("suspect"), F.struct((-F.col("noise_score")).alias("less"), "pos", "block_id", "noise_score", "quality_score", "suspect_reasons", "question_numbers", "text_preview"))
    by_page = diagnosed.groupBy("page_id").agg(
        F.count("*").alias("box_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("question_numbers")))).alias("detected_question_numbers"),
        F.array_sort(F.collect_list(block)).alias("box_diagnostics"),
        F.transform(F.slice(F.array_sort(F.collect_list(noisy)), 1, most), lambda x: x.dropFields("less", "pos")).alias("suspect_boxes"),
    )
    asked = F.size(F.filter(F.split("question_chunk_text", "\n\n"), lambda x: T.strip(x) != ""))
    return by_page.join(composed, "page_id").select(
        "page_id", F.col("mode").alias("selected_mode"), F.round("coverage_ratio", 4).alias("coverage_ratio"), asked.alias("question_chunk_count"), "box_count", "uncaptured_block_ids",
        "detected_question_numbers", "selected_text", "question_chunk_text", "page_dump_text", "box_diagnostics", "suspect_boxes",
    )


def with_formulas(regions: DataFrame, prefix: str = "FORMULA") -> DataFrame:
    """Texts of a page in reading order, formulas as numbered placeholders with a map to their boxes; regions has kind, text and box."""
    placed = regions.join(geometry.lines(regions), ["page_id", "det_seq"])
    order = Window.partitionBy("page_id").orderBy("reading_rank").rowsBetween(Window.unboundedPreceding, 0)
    is_formula = F.col("kind") == "formula"
    number = F.sum(is_formula.cast("int")).over(order)
    token = F.concat(F.lit(f"[{prefix}_"), number.cast("string"), F.lit("]"))
    said = placed.withColumn("piece", F.when(is_formula, token).otherwise(T.strip(F.coalesce("text", F.lit(""))))).where("piece <> ''")
    formula = F.when(is_formula, F.struct("reading_rank", F.col("piece").alias("key"), F.array(*geometry.BOX).alias("value")))
    return said.groupBy("page_id").agg(
        F.array_join(ordered(F.col("piece"), "reading_rank"), "\n").alias("merged_text"),
        F.count(F.when(is_formula, 1)).alias("formula_count"),
        F.map_from_entries(F.transform(F.array_sort(F.collect_list(formula)), lambda x: F.struct(x["key"], x["value"]))).alias("formula_map"),
    )
