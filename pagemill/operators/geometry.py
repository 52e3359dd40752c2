"""Boxes of a page: arithmetic, overlap suppression, lines and reading order, markers in text and options.

Boxes are columns x1, y1, x2, y2 beside page_id and det_seq. What a page needs in sequence is a fold over the page's own sorted
array, so pages run in parallel and a page's boxes are the only thing held together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOX = ("x1", "y1", "x2", "y2")


def area(x1: str = "x1", y1: str = "y1", x2: str = "x2", y2: str = "y2") -> Column:
    return F.greatest(F.lit(0.0), F.col(x2) - F.col(x1)) * F.greatest(F.lit(0.0), F.col(y2) - F.col(y1))


def iou_sql(a: str, b: str) -> str:
    """Intersection over union of two structs, as an expression; areas are at least 1e-6."""
    w = f"greatest(0D, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1))"
    h = f"greatest(0D, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
    size = "greatest(1e-6D, ({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1))"
    return f"(case when {w} * {h} <= 0 then 0D else ({w} * {h}) / ({size.format(a)} + {size.format(b)} - {w} * {h}) end)"


def expand(df: DataFrame, pad: int, width: int, height: int) -> DataFrame:
    """Boxes cut to whole numbers towards zero, padded and kept on the page."""
    i = {c: F.col(c).cast("int") for c in BOX}
    return df.withColumns({"x1": F.greatest(F.lit(0), i["x1"] - pad), "y1": F.greatest(F.lit(0), i["y1"] - pad), "x2": F.least(F.lit(width), i["x2"] + pad), "y2": F.least(F.lit(height), i["y2"] + pad)})


def clip(df: DataFrame, width: float, height: float) -> DataFrame:
    """Boxes kept on the page; without those that have nothing there."""

    def on(c: str, most: float) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(float(most)), F.col(c)))

    out = df.withColumns({"x1": on("x1", width), "y1": on("y1", height), "x2": on("x2", width), "y2": on("y2", height)})
    return out.where("x2 > x1 and y2 > y1")


def polygons_to_boxes(df: DataFrame, polygon: str = "polygon", min_area: float = 20.0) -> DataFrame:
    """The upright box around each polygon (array of x, y); areas below min_area go."""
    xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    out = df.withColumns({"x1": F.array_min(xs), "y1": F.array_min(ys), "x2": F.array_max(xs), "y2": F.array_max(ys)})
    return out.where(area() >= min_area)


def size_filter(df: DataFrame, page_area: float, min_area: float, max_ratio: float, min_width: float, min_height: float) -> DataFrame:
    """Boxes whose area and sides lie in bounds."""
    a = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return df.where((a >= min_area) & (a <= max(1.0, max_ratio * page_area)) & (F.col("x2") - F.col("x1") >= min_width) & (F.col("y2") - F.col("y1") >= min_height))


def first_by_centre(df: DataFrame, most: int) -> DataFrame:
    """The first boxes of a page by vertical centre, then left edge; rank from 1."""
    order = Window.partitionBy("page_id").orderBy((F.col("y1") + F.col("y2")) / 2, "x1", "det_seq")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def suppress(df: DataFrame, threshold: float = 0.5, most: int | None = None) -> DataFrame:
    """Boxes that overlap no larger kept box by more than the threshold; the largest `most` of them.

    Largest first, ties by det_seq.
    """
    box = F.struct((-area()).alias("less"), "det_seq", *BOX)
    pages = df.groupBy("page_id").agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    kind = "array<struct<less:double,det_seq:int,x1:double,y1:double,x2:double,y2:double>>"
    fold = f"aggregate(boxes, cast(array() as {kind}), (kept, b) -> if(exists(kept, k -> {iou_sql('k', 'b')} > {threshold}D), kept, array_append(kept, b)))"
    pages = pages.select("page_id", F.expr(fold).alias("kept"))
    if most is not None:
        pages = pages.withColumn("kept", F.slice("kept", 1, most))
    return pages.select("page_id", F.posexplode("kept").alias("rank", "b")).select("page_id", (F.col("rank") + 1).alias("rank"), "b.det_seq", *[f"b.{c}" for c in BOX])


def merged(groups: list[DataFrame], threshold: float = 0.5, most: int = 400) -> DataFrame:
    """Boxes of several sources without those that overlap a larger one; the largest `most` of a page. Ties go to the earlier source."""
    every = None
    for i, g in enumerate(groups):
        some = g.select("page_id", F.struct(F.lit(i).alias("source"), F.col("det_seq").alias("seq")).alias("of"), *BOX)
        every = some if every is None else every.unionByName(some)
    numbered = every.withColumn("det_seq", F.row_number().over(Window.partitionBy("page_id").orderBy("of")))
    return suppress(numbered, threshold, most).drop("det_seq")


def detected(polygons: DataFrame, pages: DataFrame, *, min_area: float = 20.0, threshold: float = 0.4, most: int = 400) -> DataFrame:
    """Boxes of a detector's polygons (page_id, det_seq, polygon): around them, kept on the page (page_id, width, height), without overlaps, the largest `most`."""
    on = polygons_to_boxes(polygons, min_area=min_area).join(pages.select("page_id", "width", "height"), "page_id")

    def inside(c: str, side: str) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.col(side).cast("double"), F.col(c)))

    kept = on.withColumns({"x1": inside("x1", "width"), "y1": inside("y1", "height"), "x2": inside("x2", "width"), "y2": inside("y2", "height")}).where("x2 > x1 and y2 > y1")
    return suppress(kept.select("page_id", "det_seq", *BOX), threshold, most)


def plugin_boxes(found: dict[str, DataFrame], enabled: list[str], pages: DataFrame, **options: float) -> DataFrame:
    """Boxes of the enabled plugins' polygons, in the order of `enabled`: plugin, rank within it, det_seq over all."""
    every = None
    for i, name in enumerate(enabled):
        some = detected(found[name], pages, **options).select("page_id", F.lit(i).alias("_i"), F.lit(name).alias("plugin"), "rank", *BOX)
        every = some if every is None else every.unionByName(some)
    if every is None:
        return pages.sparkSession.createDataFrame([], "page_id long, det_seq int, plugin string, rank int, x1 double, y1 double, x2 double, y2 double")
    seq = F.row_number().over(Window.partitionBy("page_id").orderBy("_i", "rank"))
    return every.select("page_id", seq.alias("det_seq"), "plugin", "rank", *BOX)


def option_blocks(options: DataFrame, texts: DataFrame, markers: DataFrame, priority: tuple[str, ...] | None = None) -> DataFrame:
    """idx, text, mark, markers and reason of each option box (page_id, det_seq, box).

    The text is that of the same place (page_id, idx, text), empty where there are fewer texts than options. Marks come by the
    first appearance of their label.
    """
    place = Window.partitionBy("page_id").orderBy("det_seq")
    placed = options.select("page_id", "det_seq", *BOX).withColumn("idx", F.row_number().over(place))
    order = marker_order(markers).select("page_id", F.col("det_seq").alias("marker_seq"), "rank")
    held = centred_in(placed, markers.where(is_marker())).join(order, ["page_id", "marker_seq"], "left")
    mark = F.when(F.col("marker").isNotNull(), F.struct("rank", mark_of(F.col("marker")).alias("mark")))
    out = held.groupBy("page_id", "idx").agg(F.transform(F.array_sort(F.collect_list(mark)), lambda x: x["mark"]).alias("markers"))
    final, reason = resolve_marks(F.col("markers"), priority or PRIORITY)
    out = out.join(texts.select("page_id", "idx", "text"), ["page_id", "idx"], "left")
    return out.select("page_id", "idx", F.coalesce("text", F.lit("")).alias("text"), final.alias("mark"), "markers", reason.alias("reason"))


def lines(df: DataFrame, threshold: float = 0.5, by_centre: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """line_no and reading_rank (both from 1) of each box, with the columns `carry`.

    Boxes come by top, then left edge (or by vertical centre). A box joins the line whose running centre is within threshold
    times its running height; both then move halfway to the box's own. Lines read from left to right.
    """
    centre, height = (F.col("y1") + F.col("y2")) / 2, F.greatest(F.lit(1.0), F.col("y2") - F.col("y1"))
    first = centre if by_centre else F.col("y1")
    row = F.struct(F.lit(0).alias("_"), *carry)
    kept = df.select(row.alias("row")).schema["row"].dataType.simpleString()
    pages = df.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(first.alias("first"), F.col("x1").alias("left"), "det_seq", centre.alias("cy"), height.alias("h"), row.alias("row")))).alias("boxes"))
    start = f"named_struct('cy', cast(null as double), 'ch', cast(null as double), 'line', 0, 'out', cast(array() as array<struct<line:int,left:double,at:int,det_seq:int,row:{kept}>>))"
    same = f"s.cy is not null and abs(b.cy - s.cy) <= s.ch * {threshold}D"
    line = f"if({same}, s.line, s.line + 1)"
    step = (
        f"named_struct('cy', if({same}, (s.cy + b.cy) / 2, b.cy), 'ch', if({same}, (s.ch + b.h) / 2, b.h), 'line', {line}, "
        f"'out', array_append(s.out, named_struct('line', {line}, 'left', b.left, 'at', size(s.out), 'det_seq', b.det_seq, 'row', b.row)))"
    )
    folded = pages.select("page_id", F.array_sort(F.expr(f"aggregate(boxes, {start}, (s, b) -> {step}, s -> s.out)")).alias("out"))
    return folded.select("page_id", F.posexplode("out").alias("rank", "b")).select("page_id", "b.det_seq", F.col("b.line").alias("line_no"), (F.col("rank") + 1).alias("reading_rank"), *[F.col(f"b.row.{c}").alias(c) for c in carry])


def intersecting(text: DataFrame, markers: DataFrame) -> DataFrame:
    """Pairs of a text box and a marker of its page that overlap; touching edges don't."""
    m = markers.select("page_id", F.col("det_seq").alias("marker_seq"), *[F.col(c).alias(f"m_{c}") for c in BOX], F.col("label").alias("marker"))
    meet = (F.col("x1") < F.col("m_x2")) & (F.col("x2") > F.col("m_x1")) & (F.col("y1") < F.col("m_y2")) & (F.col("y2") > F.col("m_y1"))
    return text.join(m, "page_id").where(meet)


def centred_in(options: DataFrame, markers: DataFrame) -> DataFrame:
    """Options with the markers whose centre they hold, edges included; options without one stay, with null marker_seq."""
    m = markers.select("page_id", F.col("det_seq").alias("marker_seq"), ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"), F.col("label").alias("marker"))
    o, m = options.alias("o"), m.alias("m")
    hold = (F.col("o.page_id") == F.col("m.page_id")) & F.col("cx").between(F.col("x1"), F.col("x2")) & F.col("cy").between(F.col("y1"), F.col("y2"))
    return o.join(m, hold, "left").select("o.*", "marker_seq", "marker")


#: Boxes that share less of the narrower one's width are in different columns, and so much further apart (fixed values).
SHARED, APART = 0.2, 260.0


def proximity_of(anchor: Column, box: Column) -> Column:
    """Distance of a box's centre from an anchor's, and more if they hardly share a column; both are structs."""
    shared = F.greatest(F.lit(0.0), F.least(anchor["x2"], box["x2"]) - F.greatest(anchor["x1"], box["x1"]))
    narrow = F.greatest(F.lit(1.0), F.least(anchor["x2"] - anchor["x1"], box["x2"] - box["x1"]))
    gap = F.abs((box["y1"] + box["y2"]) / 2 - (anchor["y1"] + anchor["y2"]) / 2)
    return gap + F.when(shared / narrow >= SHARED, 0.0).otherwise(APART)


def is_marker() -> Column:
    return F.col("label").startswith("marker")


def marker_order(df: DataFrame) -> DataFrame:
    """Markers by their label's first appearance on the page, then by det_seq; rank from 1."""
    page = Window.partitionBy("page_id")
    first = F.min("det_seq").over(Window.partitionBy("page_id", "label"))
    return df.where(is_marker()).withColumn("first", first).withColumn("rank", F.row_number().over(page.orderBy("first", "det_seq"))).drop("first")


#: Labels that show that a page was recognised at all (fixed values).
KNOWN = ("text_region", "text", "formula_region", "option_block", "marker")


def select_text(df: DataFrame) -> DataFrame:
    """A page's text_region boxes; without any its text boxes; without those all boxes if one has a known label; else none."""
    page = Window.partitionBy("page_id")

    def has(c: Column) -> Column:
        return F.max(c.cast("int")).over(page) == 1

    out = df.withColumns({"_r": has(F.col("label") == "text_region"), "_t": has(F.col("label") == "text"), "_k": has(F.col("label").isin(*KNOWN))})
    return out.where(F.when(F.col("_r"), F.col("label") == "text_region").when(F.col("_t"), F.col("label") == "text").otherwise(F.col("_k"))).drop("_r", "_t", "_k")


def choose_source(own: DataFrame, plugin: DataFrame, strategy: str) -> DataFrame:
    """Which boxes a page takes, detector's own or the plugins', and the name of the choice; one row for each box taken.

    Strategies: plugins_only (own where plugins found none), merge (both), yolo_only, yolo_then_plugins.
    """
    both = own.withColumn("source", F.lit("own")).unionByName(plugin.withColumn("source", F.lit("plugin")))
    page = Window.partitionBy("page_id")
    n_own, n_plugin = (F.sum((F.col("source") == s).cast("int")).over(page) for s in ("own", "plugin"))
    is_own = F.col("source") == "own"
    if strategy == "plugins_only":
        tag = F.when(n_plugin > 0, "plugins_only").otherwise("plugins_only_fallback_yolo")
        take = F.when(n_plugin > 0, ~is_own).otherwise(is_own)
    elif strategy == "merge":
        tag, take = F.lit("merge"), F.lit(True)
    elif strategy == "yolo_only":
        tag, take = F.lit("yolo_only"), is_own
    elif strategy == "yolo_then_plugins":
        tag = F.when(n_own > 0, "yolo_then_plugins_yolo").otherwise("yolo_then_plugins_plugin")
        take = F.when(n_own > 0, is_own).otherwise(~is_own)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return both.withColumns({"choice": tag, "_take": take}).where("_take").drop("_take")


def fallback_grid(pages: DataFrame, columns: int = 2, rows: int = 4, margin: int = 8, *, enabled: bool = True, mode: str = "columns") -> DataFrame:
    """columns x rows boxes of each page (page_id, width, height), numbered by row, then column; without empty ones.

    In mode `full` a page has one box, empty or not; disabled it has none.
    """
    if mode.lower() == "full" or not enabled:
        whole = {"x1": F.lit(float(margin)), "y1": F.lit(float(margin)), "x2": (F.col("width") - margin).cast("double"), "y2": (F.col("height") - margin).cast("double")}
        return pages.where(F.lit(enabled)).withColumns(whole).select("page_id", F.lit(1).alias("det_seq"), *BOX)
    columns, rows = max(1, columns), max(1, rows)
    grid = pages.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    w, h = F.col("width") / columns, F.col("height") / rows

    def at(edge: Column) -> Column:
        return edge.cast("int").cast("double")

    out = grid.withColumns({"x1": at(F.col("column") * w) + margin, "y1": at(F.col("row") * h) + margin, "x2": at((F.col("column") + 1) * w) - margin, "y2": at((F.col("row") + 1) * h) - margin})
    return out.where("x2 > x1 and y2 > y1").withColumn("det_seq", F.col("row") * columns + F.col("column") + 1).select("page_id", "det_seq", *BOX)


#: Marks in order of preference (fixed values).
PRIORITY = ("X", "O", "V", "CHECK", "STAR")


def mark_of(label: Column) -> Column:
    return F.regexp_replace(F.upper(label), "^MARKER_", "")


def resolve_marks(marks: Column, priority: tuple[str, ...] = PRIORITY) -> tuple[Column, Column]:
    """Final mark and reason of an array of marks: the first preferred one that is there, else the last; NONE of none."""
    wanted = F.array(*map(F.lit, priority))
    preferred = F.get(F.filter(wanted, lambda p: F.array_contains(marks, p)), 0)
    none = F.size(marks) == 0
    final = F.when(none, "NONE").when(preferred.isNotNull(), preferred).otherwise(F.get(marks, F.size(marks) - 1))
    reason = F.when(none, "no_marker").when(preferred.isNotNull(), F.concat(F.lit("priority_match:"), preferred)).otherwise("fallback_last_marker")
    return final, reason
