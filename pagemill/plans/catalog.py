"""All queries over the test tables, with equivalent SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import documents, geometry, hints, images, prompts, questions, ranking
from ..sources import files
from ..sources.adapters import WITH, blocks, boxes, table

FLAGSHIP = "reading_order"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function by its name; sql, if given, gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_BOX = "page_id, det_seq, x1, y1, x2, y2"


def _id(pos: str) -> str:
    """Three digits at least; lpad alone would cut longer numbers."""
    return f"'b' || lpad(cast({pos} as varchar), cast(greatest(3, len(cast({pos} as varchar))) as int), '0')"


# -- boxes --------------------------------------------------------------------------------------------------------------


@query(f"{WITH} select * from wb_boxes")
def page_boxes(spark, sf):
    return boxes(spark, sf)


@query(f"{WITH} select page_id, det_seq, greatest(0, cast(x1 as int) - 4) as x1, greatest(0, cast(y1 as int) - 4) as y1, least(300, cast(x2 as int) + 4) as x2, least(120, cast(y2 as int) + 4) as y2 from wb_boxes")
def expanded_boxes(spark, sf):
    return geometry.expand(boxes(spark, sf), 4, 300, 120).select(*_BOX.split(", "))


@query(f"""{WITH}, c as (select page_id, det_seq, greatest(0.0, least(200.0, x1)) as x1, greatest(0.0, least(80.0, y1)) as y1, greatest(0.0, least(200.0, x2)) as x2, greatest(0.0, least(80.0, y2)) as y2 from wb_boxes)
select * from c where x2 > x1 and y2 > y1""")
def clipped_boxes(spark, sf):
    return geometry.clip(boxes(spark, sf), 200, 80).select(*_BOX.split(", "))


@query(f"{WITH} select {_BOX} from wb_boxes where (x2 - x1) * (y2 - y1) >= 2000")
def polygon_boxes(spark, sf):
    corner = [F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x2", "y1"), ("x2", "y2"), ("x1", "y2"), ("x1", "y1"))]
    polygons = boxes(spark, sf).select("page_id", "det_seq", F.array(*corner).alias("polygon"))
    return geometry.polygons_to_boxes(polygons, min_area=2000).select(*_BOX.split(", "))


@query(f"""{WITH} select {_BOX} from wb_boxes where (x2 - x1) * (y2 - y1) between 1000 and greatest(1.0, 0.2 * 36000) and x2 - x1 >= 60 and y2 - y1 >= 17""")
def sized_boxes(spark, sf):
    return geometry.size_filter(boxes(spark, sf), 36000, 1000, 0.2, 60, 17).select(*_BOX.split(", "))


@query(f"""{WITH}, r as (select page_id, det_seq, row_number() over (partition by page_id order by (y1 + y2) / 2, x1, det_seq) as rank from wb_boxes) select page_id, det_seq, rank from r where rank <= 3""")
def first_boxes_by_centre(spark, sf):
    return geometry.first_by_centre(boxes(spark, sf), 3).select("page_id", "det_seq", "rank")


_IOU = "(case when {w} * {h} <= 0 then 0.0 else {w} * {h} / (greatest(1e-6, ({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1)) + greatest(1e-6, ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1)) - {w} * {h}) end)"


def _iou(a: str, b: str) -> str:
    w, h = (f"greatest(0.0, least({a}.{hi}, {b}.{hi}) - greatest({a}.{lo}, {b}.{lo}))" for lo, hi in (("x1", "x2"), ("y1", "y2")))
    return _IOU.format(a=a, b=b, w=w, h=h)


@query(f"{WITH} select a.page_id, a.det_seq as a, b.det_seq as b, round({_iou('a', 'b')}, 6) as iou from wb_boxes a join wb_boxes b on a.page_id = b.page_id and a.det_seq < b.det_seq where {_iou('a', 'b')} > 0.4")
def overlapping_pairs(spark, sf):
    b = boxes(spark, sf)
    of = [F.struct(*geometry.BOX).alias(n) for n in "ab"]
    one, other = b.select("page_id", F.col("det_seq").alias("s"), of[0]), b.select("page_id", F.col("det_seq").alias("t"), of[1])
    pairs = one.join(other, "page_id").where("s < t").withColumn("iou", F.expr(geometry.iou_sql("a", "b"))).where("iou > 0.4")
    return pairs.select("page_id", F.col("s").alias("a"), F.col("t").alias("b"), F.round("iou", 6).alias("iou"))


def _suppress_sql(most: int) -> str:
    return f"""{WITH},
r as (select *, row_number() over (partition by page_id order by (x2 - x1) * (y2 - y1) desc, det_seq) as k from wb_boxes),
walk as (
 select page_id, k, [{{'k': k, 'det_seq': det_seq, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] as kept from r where k = 1
 union all
 select r.page_id, r.k, case when len(list_filter(w.kept, lambda z: {_iou('z', 'r')} > 0.5)) > 0 then w.kept
  else list_append(w.kept, {{'k': r.k, 'det_seq': r.det_seq, 'x1': r.x1, 'y1': r.y1, 'x2': r.x2, 'y2': r.y2}}) end
 from walk w join r on r.page_id = w.page_id and r.k = w.k + 1),
ends as (select page_id, arg_max(kept, k) as kept from walk group by page_id),
flat as (select page_id, unnest(kept) as b from ends),
placed as (select page_id, row_number() over (partition by page_id order by b.k) as rank, b.det_seq as det_seq from flat)
select page_id, rank, det_seq from placed where rank <= {most}"""


@query(_suppress_sql(1000))
def suppressed_boxes(spark, sf):
    return geometry.suppress(boxes(spark, sf)).select("page_id", "rank", "det_seq")


@query(_suppress_sql(4))
def largest_suppressed_boxes(spark, sf):
    return geometry.suppress(boxes(spark, sf), most=4).select("page_id", "rank", "det_seq")


def _lines_sql(first: str, threshold: float, source: str = "wb_boxes") -> str:
    return f"""
r as (select *, (y1 + y2) / 2 as cy, greatest(1.0, y2 - y1) as h, row_number() over (partition by page_id order by {first}, x1, det_seq) as k from {source}),
walk as (
 select page_id, k, det_seq, x1, cy as ly, h as lh, 1 as line_no from r where k = 1
 union all
 select r.page_id, r.k, r.det_seq, r.x1,
  case when abs(r.cy - w.ly) <= w.lh * {threshold} then (w.ly + r.cy) / 2 else r.cy end,
  case when abs(r.cy - w.ly) <= w.lh * {threshold} then (w.lh + r.h) / 2 else r.h end,
  case when abs(r.cy - w.ly) <= w.lh * {threshold} then w.line_no else w.line_no + 1 end
 from walk w join r on r.page_id = w.page_id and r.k = w.k + 1),
placed as (select page_id, det_seq, line_no, row_number() over (partition by page_id order by line_no, x1, k) as reading_rank from walk)"""


@query(f"{WITH}, {_lines_sql('y1', 0.5)} select page_id, det_seq, line_no, reading_rank from placed")
def reading_order(spark, sf):
    return geometry.lines(boxes(spark, sf))


@query(f"{WITH}, {_lines_sql('(y1 + y2) / 2', 0.6)} select page_id, det_seq, line_no, reading_rank from placed")
def reading_order_by_centre(spark, sf):
    return geometry.lines(boxes(spark, sf), 0.6, by_centre=True)


@query(f"""{WITH} select t.page_id, t.det_seq, m.det_seq as marker_seq from wb_boxes t join wb_boxes m on t.page_id = m.page_id
where t.label = 'text_region' and m.label like 'marker%' and t.x1 < m.x2 and t.x2 > m.x1 and t.y1 < m.y2 and t.y2 > m.y1""")
def markers_on_text(spark, sf):
    b = boxes(spark, sf)
    return geometry.intersecting(b.where("label = 'text_region'"), b.where(geometry.is_marker())).select("page_id", "det_seq", "marker_seq")


@query(f"""{WITH}, m as (select page_id, det_seq, label, min(det_seq) over (partition by page_id, label) as first from wb_boxes where label like 'marker%')
select page_id, det_seq, label, row_number() over (partition by page_id order by first, det_seq) as rank from m""")
def marker_order(spark, sf):
    return geometry.marker_order(boxes(spark, sf)).select("page_id", "det_seq", "label", "rank")


@query(f"""{WITH}, f as (select page_id, det_seq, label, (x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy, min(det_seq) over (partition by page_id, label) as first from wb_boxes where label like 'marker%'),
j as (select o.page_id, o.det_seq, regexp_replace(upper(f.label), '^MARKER_', '') as mark, f.first, f.det_seq as m from wb_boxes o left join f on f.page_id = o.page_id and f.cx between o.x1 and o.x2 and f.cy between o.y1 and o.y2 where o.label = 'option_block'),
g as (select page_id, det_seq, coalesce(string_agg(mark, ',' order by first, m), '') as marks from j group by page_id, det_seq),
p as (select *, case when list_contains(string_split(marks, ','), 'X') then 'X' when list_contains(string_split(marks, ','), 'O') then 'O' when list_contains(string_split(marks, ','), 'V') then 'V' when list_contains(string_split(marks, ','), 'CHECK') then 'CHECK' when list_contains(string_split(marks, ','), 'STAR') then 'STAR' end as best from g)
select page_id, det_seq, marks, case when marks = '' then 'NONE' else coalesce(best, string_split(marks, ',')[-1]) end as mark,
 case when marks = '' then 'no_marker' when best is not null then 'priority_match:' || best else 'fallback_last_marker' end as reason from p""")
def option_marks(spark, sf):
    b = boxes(spark, sf)
    order = geometry.marker_order(b).select("page_id", F.col("det_seq").alias("marker_seq"), "rank")
    held = geometry.centred_in(b.where("label = 'option_block'"), b.where(geometry.is_marker())).join(order, ["page_id", "marker_seq"], "left")
    mark = F.when(F.col("marker").isNotNull(), F.struct("rank", geometry.mark_of(F.col("marker")).alias("mark")))
    out = held.groupBy("page_id", "det_seq").agg(F.transform(F.array_sort(F.collect_list(mark)), lambda x: x["mark"]).alias("m"))
    final, reason = geometry.resolve_marks(F.col("m"))
    return out.select("page_id", "det_seq", F.array_join("m", ",").alias("marks"), final.alias("mark"), reason.alias("reason"))


@query(f"""{WITH}, w as (select *, max(case when label = 'text_region' then 1 else 0 end) over (partition by page_id) as r, max(case when label = 'text' then 1 else 0 end) over (partition by page_id) as t,
 max(case when label in ('text_region', 'text', 'formula_region', 'option_block', 'marker') then 1 else 0 end) over (partition by page_id) as k from wb_boxes)
select page_id, det_seq, label from w where case when r = 1 then label = 'text_region' when t = 1 then label = 'text' else k = 1 end""")
def selected_text_boxes(spark, sf):
    return geometry.select_text(boxes(spark, sf)).select("page_id", "det_seq", "label")


_OWN, _PLUGIN = "label = 'text_region'", "label = 'formula_region'"


@query(f"""{WITH}, b as (select page_id, det_seq, case when {_OWN} then 'own' else 'plugin' end as source from wb_boxes where {_OWN} or {_PLUGIN}),
n as (select *, sum(case when source = 'own' then 1 else 0 end) over (partition by page_id) as o, sum(case when source = 'plugin' then 1 else 0 end) over (partition by page_id) as p from b)
select 'plugins_only' as strategy, page_id, det_seq, source, case when p > 0 then 'plugins_only' else 'plugins_only_fallback_yolo' end as choice from n where case when p > 0 then source = 'plugin' else source = 'own' end
union all select 'merge', page_id, det_seq, source, 'merge' from n
union all select 'yolo_only', page_id, det_seq, source, 'yolo_only' from n where source = 'own'
union all select 'yolo_then_plugins', page_id, det_seq, source, case when o > 0 then 'yolo_then_plugins_yolo' else 'yolo_then_plugins_plugin' end from n where case when o > 0 then source = 'own' else source = 'plugin' end""")
def chosen_sources(spark, sf):
    b = boxes(spark, sf).select("page_id", "det_seq", "label")
    own, plugin = b.where(_OWN).drop("label"), b.where(_PLUGIN).drop("label")
    out = [geometry.choose_source(own, plugin, s).withColumn("strategy", F.lit(s)) for s in ("plugins_only", "merge", "yolo_only", "yolo_then_plugins")]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("""with g as (select o_orderkey as page_id, 100 + o_custkey % 50 as width, 80 + o_custkey % 30 as height, r, c from orders, range(4) a(r), range(2) b(c)),
b as (select page_id, r * 2 + c + 1 as det_seq, trunc(c * (width / 2)) + 8 as x1, trunc(r * (height / 4)) + 8 as y1, trunc((c + 1) * (width / 2)) - 8 as x2, trunc((r + 1) * (height / 4)) - 8 as y2 from g)
select page_id, cast(det_seq as int) as det_seq, x1, y1, x2, y2 from b where x2 > x1 and y2 > y1""")
def fallback_grids(spark, sf):
    sizes = table(spark, sf, "orders").select(F.col("o_orderkey").alias("page_id"), (100 + F.col("o_custkey") % 50).alias("width"), (80 + F.col("o_custkey") % 30).alias("height"))
    return geometry.fallback_grid(sizes)


@query(f"{WITH} select page_id, label, count(*) as n, min(det_seq) as first_seq, string_agg(cast(det_seq as varchar), ',' order by det_seq) as seqs from wb_boxes group by page_id, label")
def boxes_by_label(spark, sf):
    seqs = F.array_join(F.transform(F.array_sort(F.collect_list("det_seq")), lambda x: x.cast("string")), ",")
    return boxes(spark, sf).groupBy("page_id", "label").agg(F.count("*").alias("n"), F.min("det_seq").alias("first_seq"), seqs.alias("seqs"))


@query(f"""{WITH} select page_id, case when sum(case when {_OWN} then 1 else 0 end) > 0 then 'own' else 'plugin' end as source, sum(case when {_OWN} then 1 else 0 end) as own_count, sum(case when {_PLUGIN} then 1 else 0 end) as plugin_count from wb_boxes group by page_id""")
def source_summary(spark, sf):
    own, plugin = F.sum(F.expr(f"int({_OWN})")), F.sum(F.expr(f"int({_PLUGIN})"))
    return boxes(spark, sf).groupBy("page_id").agg(F.when(own > 0, "own").otherwise("plugin").alias("source"), own.alias("own_count"), plugin.alias("plugin_count"))


@query(f"""{WITH}, u as (select 0 as r, page_id, det_seq, conf from wb_boxes where label not like 'marker%' union all select 1, page_id, det_seq, conf from wb_boxes where label like 'marker%')
select page_id, det_seq, row_number() over (partition by page_id order by r, det_seq) as seq from u where conf is null or conf >= 0.6""")
def two_detectors(spark, sf):
    from pyspark.sql import Window

    b = boxes(spark, sf)
    both = b.where(~geometry.is_marker()).withColumn("r", F.lit(0)).unionByName(b.where(geometry.is_marker()).withColumn("r", F.lit(1)))
    kept = both.where("conf is null or conf >= 0.6")
    return kept.select("page_id", "det_seq", F.row_number().over(Window.partitionBy("page_id").orderBy("r", "det_seq")).alias("seq"))


@query("select l_partkey, coalesce(case l_partkey % 6 when 0 then 'text_region' when 1 then 'marker' when 2 then 'option_block' when 3 then 'formula_region' end, 'class_' || (l_partkey % 6)) as name, count(*) as n from lineitem group by 1, 2")
def class_names(spark, sf):
    names = {0: "text_region", 1: "marker", 2: "option_block", 3: "formula_region"}
    return table(spark, sf, "lineitem").groupBy("l_partkey", files.class_name((F.col("l_partkey") % 6).cast("int"), names).alias("name")).agg(F.count("*").alias("n"))


@query(f"""{WITH}, l as (select page_id, det_seq as idx, substr(label, 1, 1) as char, cast(x1 as int) as x1, cast(200 - y2 as int) as y1, cast(x2 as int) as x2, cast(200 - y1 as int) as y2 from wb_boxes where det_seq % 5 <> 0)
select page_id, char, x1, 200 - y2 as y1, x2, 200 - y1 as y2 from l""")
def character_boxes(spark, sf):
    b = boxes(spark, sf)
    number = [F.col("x1"), 200 - F.col("y2"), F.col("x2"), 200 - F.col("y1")]
    line = F.concat_ws(" ", F.substring("label", 1, 1), *[F.when(F.col("det_seq") % 5 == 0, "x").otherwise(n.cast("int").cast("string")) for n in number], F.lit("0"))
    return files.character_boxes(b.select("page_id", line.alias("line"), F.lit(200).alias("height")))


@query(f"{WITH} select page_id, det_seq, cast(floor((det_seq - 1) / 4) as int) as row, (det_seq - 1) % 4 as column from wb_boxes")
def gallery(spark, sf):
    return files.gallery_cells(boxes(spark, sf).select("page_id", "det_seq", (F.col("det_seq") - 1).alias("idx")), 4).drop("idx")


# -- text ---------------------------------------------------------------------------------------------------------------

_SYMBOLS = r"[|\[\]{}<>@#$%^&*=+~`]"


def _n(column: str, pattern: str) -> str:
    return f"len(regexp_extract_all({column}, '{pattern}'))"


def _r4(x: str) -> str:
    """Rounds the shortest decimal form of a double, half away from zero."""
    return f"cast(round(cast(cast({x} as varchar) as decimal(38, 18)), 4) as double)"


def _quality_sql(source: str, keys: str, text: str, conf: str) -> str:
    return f"""
qa as (select {keys}, regexp_replace({text}, '^\\s+|\\s+$', '', 'g') as t, {conf} as conf from {source}),
qb as (select {keys}, conf, {_n('t', '[^\\s]')} as chars, {_n('t', '[^\\s]+')} as tokens, {_n('t', '[\\p{L}\\p{N}]')} as an, {_n('t', _SYMBOLS)} as sy, {_n('t', '[A-Za-z]{2,}|[가-힣]{2,}')} as wo, {_n('t', '[A-Za-z]')} as latin_count, {_n('t', '[0-9]')} as digit_count from qa),
qc as (select *, cast(an as double) / greatest(1, chars) as a, cast(sy as double) / greatest(1, chars) as s, cast(wo as double) / greatest(1, tokens) as w from qb),
qd as (select *, greatest(cast(0 as double), least(cast(1 as double), cast(0.58 as double) * a + cast(0.22 as double) * w + cast(0.20 as double) * (cast(1 as double) - s))) as q from qc),
qe as (select *, greatest(cast(0 as double), least(cast(2 as double), cast(1 as double) - q + cast(0.60 as double) * s + case when conf < 0.5 then cast(0.25 as double) else cast(0 as double) end)) as z,
 concat_ws(',', case when q < 0.45 and chars >= 12 then 'low_quality_score' end, case when s > 0.18 and chars >= 12 then 'high_symbol_ratio' end, case when w < 0.2 and tokens >= 6 then 'few_word_tokens' end, case when conf < 0.5 then 'low_confidence' end) as reasons from qd)"""


@query(f"with {_quality_sql('documents', 'doc_id', 'text', '(doc_id % 10) / 10.0')} select doc_id, chars as char_count, tokens as token_count, {_r4('a')} as alnum_ratio, {_r4('s')} as symbol_ratio, {_r4('w')} as word_ratio, latin_count, digit_count, {_r4('q')} as quality_score, {_r4('z')} as noise_score, reasons <> '' as suspect, reasons as suspect_reasons from qe")
def text_quality(spark, sf):
    out = T.with_quality(table(spark, sf, "documents").select("doc_id", "text"), F.col("text"), (F.col("doc_id") % 10) / 10.0)
    return out.drop("text", "hangul_count").withColumn("suspect_reasons", F.array_join("suspect_reasons", ","))


@query(f"""with s as (select doc_id, ({_n('text', '[\\p{L}\\p{N}]')} + cast(0.3 as double) * {_n('text', '[\\s]')}) - cast(0.5 as double) * {_n('text', '[@#$%^&*<>]')} + cast(0.01 as double) * length(text) as score, case when doc_id % 3 = 0 then null else (doc_id % 13) / 10.0 end as native from documents),
c as (select *, greatest(0.01, least(0.99, (score + 5.0) / 60.0)) as h from s)
select doc_id, {_r4('score')} as score, {_r4('h')} as heuristic, round(greatest(0.01, least(0.99, case when native is null then h else cast(0.65 as double) * greatest(0.0, least(1.0, native)) + cast(0.35 as double) * h end)), 4) as merged from c""")
def text_confidence(spark, sf):
    score = T.heuristic_score(F.col("text"))
    h = T.score_to_confidence(score)
    native = F.when(F.col("doc_id") % 3 != 0, (F.col("doc_id") % 13) / 10.0)
    return table(spark, sf, "documents").select("doc_id", F.round(score, 4).alias("score"), F.round(h, 4).alias("heuristic"), F.round(T.merge_confidence(h, native), 4).alias("merged"))


@query(f"""{WITH}, c as (select *, {_n('txt', '[A-Za-z]')} as latin, {_n('txt', '[가-힣]')} as hangul from wb_blocks)
select page_id, pos, case when latin > greatest(3, hangul * 2) then 'eng' when hangul > greatest(3, latin * 2) then 'kor' else 'mixed' end as hint, {_n('txt', '[A-Za-z가-힣0-9]')} as weight,
 case when trim(txt) = '' then 'misc' when contains(txt, '[') and contains(txt, ']') then 'options' when contains(txt, ')') and {_n('txt', '\\(')} >= 2 then 'options' when contains(txt, '?') or ends_with(txt, '.') then 'prompt' else 'misc' end as role,
 case when pos % 2 = 0 then 'handwriting' else 'printed' end as kind from c""")
def text_roles(spark, sf):
    t, engine = F.col("txt"), F.when(F.col("pos") % 2 == 0, "TrOCR").otherwise("tesseract")
    return blocks(spark, sf).select("page_id", "pos", T.language_hint(t).alias("hint"), T.text_weight(t).alias("weight"), T.role(t).alias("role"), T.kind(engine).alias("kind"))


@query(f"""{WITH} select page_id, pos, lower(regexp_replace(regexp_replace(txt, '^\\s*[0-9]{{1,3}}[.,]\\s*', ''), '[^0-9A-Za-z가-힣]', '', 'g')) as normalised,
 regexp_replace(lower(trim(txt)), '\\s+', ' ', 'g') as compact, regexp_replace(lower(txt), '[^0-9A-Za-z가-힣]+', '', 'g') as answer_key, substr(txt, 1, 12) as preview, {_id('pos')} as block_id,
 translate(txt, '/ ', '__') as stage_name from wb_blocks""")
def text_keys(spark, sf):
    t = F.col("txt")
    return blocks(spark, sf).select("page_id", "pos", T.normalised(t).alias("normalised"), T.compact(t).alias("compact"), T.answer_key(t).alias("answer_key"), T.preview(t, 12).alias("preview"), T.block_id(F.col("pos")).alias("block_id"), T.stage_file_name(t).alias("stage_name"))


@query("""with l as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') as lines from documents) select doc_id, len(lines) as n, lines[1] as first_line from l""")
def text_lines(spark, sf):
    lines = T.nonempty_lines(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(lines).alias("n"), F.get(lines, 0).alias("first_line"))


@query(f"""with l as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') as lines from documents), u as (select doc_id, unnest(lines) as text, unnest(range(1, len(lines) + 1)) as i from l)
select doc_id, {_id('i')} as id, text from u""")
def line_blocks(spark, sf):
    out = table(spark, sf, "documents").select("doc_id", F.explode(documents.blocks_of_lines(F.col("text"))).alias("b"))
    return out.select("doc_id", "b.id", "b.text")


#: The blocks' numbers stand between blanks or at the end, so plain patterns find them here.
_PIECES = """
pa as (select page_id, pos, conf, string_split(regexp_replace(regexp_replace(' ' || trim(txt), '([^0-9])([0-9]{1,3})([.,])$', '\\1' || chr(1) || '\\2\\3'), ' ([0-9]{1,3})[.,] ', chr(1) || '\\1. ', 'g'), chr(1)) as ps from wb_blocks where trim(txt) <> ''),
pb as (select page_id, pos, conf, unnest(ps[2:]) as piece, unnest(range(0, len(ps) - 1)) as nth from pa),
pc as (select page_id, pos, conf, nth, cast(regexp_extract(piece, '^([0-9]+)', 1) as int) as question_no, trim(piece) as piece from pb)"""


@query(f"{WITH}, {_PIECES}, g as (select page_id, pos, question_no, min(nth) as nth from pc group by all) select page_id, pos, string_agg(cast(question_no as varchar), ',' order by nth) as numbers from g group by page_id, pos")
def question_numbers(spark, sf):
    n = T.question_numbers(F.col("txt"))
    return blocks(spark, sf).where(F.size(n) > 0).select("page_id", "pos", F.array_join(F.transform(n, lambda x: x.cast("string")), ",").alias("numbers"))


@query(f"{WITH}, {_PIECES} select page_id, pos, nth, question_no, piece from pc")
def question_pieces(spark, sf):
    return questions.pieces(blocks(spark, sf)).drop("conf")


_MERGED = f"""{_PIECES},
qm as (select page_id, question_no, string_agg(piece, chr(10) order by pos, nth) as text, min(conf) as confidence_min, min(pos) as anchor from pc group by page_id, question_no),
qi as (select page_id, question_no, string_agg({_id('pos')}, ',' order by pos) as block_ids from (select distinct page_id, question_no, pos from pc) d group by page_id, question_no)"""


def _placed(spark, sf) -> DataFrame:
    """Blocks with the boxes of the same places."""
    b = boxes(spark, sf).select("page_id", F.col("det_seq").alias("pos"), *geometry.BOX, "label")
    return blocks(spark, sf).join(b, ["page_id", "pos"])


@query(f"{WITH}, {_MERGED} select page_id, question_no, text, block_ids, confidence_min from qm join qi using (page_id, question_no)")
def question_chunks(spark, sf):
    return questions.chunks(_placed(spark, sf)).select("page_id", "question_no", "text", F.array_join("block_ids", ",").alias("block_ids"), "confidence_min")


def _options_sql(name: str, source: str, keys: str, text: str) -> str:
    """A list l of alternatives inside brackets for each row of source, in clauses that begin with the name."""
    found = [rf"regexp_extract_all({text}, '{p}', 1)" for p in (r"\[([^\[\]\n]{{2,120}})[\]}}]", r"\{{([^{{}}\n]{{2,120}})[}}\]]", r"\(([^()\n]{{2,120}})\)")]
    found = [x.replace("{{", "{").replace("}}", "}") for x in found]

    def parts(pattern: str) -> str:
        return f"list_filter(list_transform(regexp_split_to_array(g, '{pattern}'), lambda x: trim(x)), lambda x: x <> '')"

    signs, words = parts(r"\s*[,|/·ㆍ]\s*"), parts(r"\s+(?:or|OR|또는)\s+")
    split = f"case when len({signs}) >= 2 then {signs} when len({words}) >= 2 then {words} else [] end"
    quotes = "['\"“”‘’`]+".replace("'", "''")
    compact = r"lower(regexp_replace(trim({0}), '\s+', ' ', 'g'))"
    return f"""
{name}_a as (select {keys}, list_filter(list_transform(list_concat({found[0]}, list_concat({found[1]}, {found[2]})), lambda g: trim(g)), lambda g: g <> '' and not regexp_matches(g, '^[0-9]+[.)]?$')) as gs from {source}),
{name}_b as (select {keys}, list_filter(list_transform(flatten(list_transform(gs, lambda g: {split})), lambda x: regexp_replace(x, '^{quotes}|{quotes}$', '', 'g')), lambda x: x <> '') as l from {name}_a),
{name}_c as (select {keys}, l, list_transform(l, lambda x: {compact.format('x')}) as k from {name}_b),
{name} as (select {keys}, list_filter(l, lambda x, i: list_position(k, {compact.format('x')}) = i) as l from {name}_c)"""


@query(f"""{WITH}, {_MERGED}, {_options_sql('po', 'pc', 'page_id, pos, nth, question_no', 'piece')}, {_options_sql('bo', 'wb_blocks', 'page_id, pos, txt', 'txt')},
sn as (select page_id, question_no, min(pos) as anchor, row_number() over (partition by page_id order by min(pos * 1000 + nth)) as seen from pc group by page_id, question_no),
ow as (select p.page_id, p.pos, arg_max(p.question_no, s.seen) as owner from pc p join sn s using (page_id, question_no) group by p.page_id, p.pos),
fr as (select o.page_id, o.pos, b.x1, b.y1, b.x2, b.y2 from bo o left join ow on ow.page_id = o.page_id and ow.pos = o.pos join wb_boxes b on b.page_id = o.page_id and b.det_seq = o.pos where ow.owner is null and len(o.l) > 0),
co as (select f.page_id, f.pos, s.question_no, s.seen, abs((f.y1 + f.y2) / 2 - (a.y1 + a.y2) / 2) + case when greatest(0.0, least(a.x2, f.x2) - greatest(a.x1, f.x1)) / greatest(1.0, least(a.x2 - a.x1, f.x2 - f.x1)) >= 0.2 then 0 else 260 end as cost
 from fr f join sn s on s.page_id = f.page_id and s.anchor <= 999 join wb_boxes a on a.page_id = s.page_id and a.det_seq = s.anchor),
nr as (select page_id, pos, question_no from (select *, row_number() over (partition by page_id, pos order by cost, seen) as k from co) t where k = 1 and cost <= 520),
gi as (select o.page_id, coalesce(ow.owner, nr.question_no) as question_no, o.pos, o.l, trim(o.txt) as t from bo o left join ow on ow.page_id = o.page_id and ow.pos = o.pos left join nr on nr.page_id = o.page_id and nr.pos = o.pos where len(o.l) > 0),
gs as (select page_id, question_no, flatten(list(l order by pos)) as l, string_agg(t, chr(10) order by pos) as t from gi where question_no is not null group by page_id, question_no),
os as (select page_id, question_no, flatten(list(l order by pos, nth)) as l from po group by page_id, question_no),
al as (select q.page_id, q.question_no, list_concat(os.l, coalesce(gs.l, [])) as l, trim(q.text) || coalesce(chr(10) || gs.t, '') as context_text from qm q join os using (page_id, question_no) left join gs using (page_id, question_no))
select page_id, question_no, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') as options, context_text from al""")
def question_options(spark, sf):
    """Options and context, with those of the blocks that are nearest."""
    out = questions.chunks(_placed(spark, sf))
    return out.select("page_id", "question_no", F.array_join("option_candidates", "|").alias("options"), "context_text")


@query(f"""{WITH}, {_MERGED},
tk as (select distinct page_id, pos from pc),
bl as (select w.page_id, w.pos, trim(w.txt) as t, tk.pos is not null as taken from wb_blocks w left join tk on tk.page_id = w.page_id and tk.pos = w.pos where trim(w.txt) <> ''),
du as (select page_id, string_agg(t, chr(10) order by pos) as dump, string_agg(t, chr(10) order by pos) filter (where not taken) as rest, string_agg({_id('pos')}, ',' order by pos) filter (where not taken) as ids from bl group by page_id),
qt as (select page_id, string_agg(text, chr(10) || chr(10) order by question_no) as q from qm group by page_id),
al as (select p.page_id, coalesce(dump, '') as dump, coalesce(rest, '') as rest, coalesce(ids, '') as ids, coalesce(q, '') as q from (select distinct page_id from wb_blocks) p left join du using (page_id) left join qt using (page_id))
select page_id, case when q <> '' and rest <> '' then 'hybrid' when q <> '' then 'question_chunks' else 'page_dump' end as mode,
 case when q <> '' and rest <> '' then q || chr(10) || chr(10) || rest when q <> '' then q else dump end as selected_text, ids as uncaptured,
 round(cast({_n('q', '[^\\s]')} as double) / greatest(1, {_n('dump', '[^\\s]')}), 4) as coverage_ratio from al""")
def composed_pages(spark, sf):
    out = questions.compose(questions.pages(_placed(spark, sf)))
    return out.select("page_id", "mode", "selected_text", F.array_join("uncaptured_block_ids", ",").alias("uncaptured"), F.round("coverage_ratio", 4).alias("coverage_ratio"))


_DIAGNOSED = f"""{_PIECES}, {_quality_sql('wb_blocks', 'page_id, pos', 'txt', 'conf')},
nu as (select page_id, pos, count(distinct question_no) as n from pc group by page_id, pos),
dg as (select qe.page_id, qe.pos, {_r4('q')} as quality_score, round(least(2.0, {_r4('z')} + case when coalesce(n, 0) > 1 then cast(0.2 as double) else 0 end), 4) as noise_score,
 concat_ws(',', nullif(reasons, ''), case when coalesce(n, 0) > 1 then 'multiple_question_numbers_in_one_box' end) as reasons from qe left join nu on nu.page_id = qe.page_id and nu.pos = qe.pos)"""


@query(f"{WITH}, {_DIAGNOSED} select page_id, pos, quality_score, noise_score, reasons from dg")
def diagnosed_blocks(spark, sf):
    return questions.diagnose(_placed(spark, sf)).select("page_id", "pos", "quality_score", "noise_score", F.array_join("suspect_reasons", ",").alias("reasons"))


@query(f"{WITH}, {_DIAGNOSED}, rk as (select page_id, pos, noise_score, row_number() over (partition by page_id order by noise_score desc, pos) as rank from dg where reasons <> '') select * from rk where rank <= 2")
def worst_blocks(spark, sf):
    return questions.worst(questions.diagnose(_placed(spark, sf)), 2).select("page_id", "pos", "noise_score", "rank")


@query(f"""{WITH}, rg as (select b.page_id, b.det_seq, case when label = 'formula_region' then 'formula' else 'text' end as kind, txt, x1, y1, x2, y2 from wb_boxes b join wb_blocks w on w.page_id = b.page_id and w.pos = b.det_seq),
{_lines_sql('y1', 0.5, 'rg')},
nn as (select p.page_id, p.reading_rank, g.kind, trim(g.txt) as t, sum(case when g.kind = 'formula' then 1 else 0 end) over (partition by p.page_id order by p.reading_rank) as k from placed p join rg g on g.page_id = p.page_id and g.det_seq = p.det_seq),
pp as (select page_id, reading_rank, kind, case when kind = 'formula' then '[FORMULA_' || k || ']' else t end as piece from nn)
select page_id, string_agg(piece, chr(10) order by reading_rank) as merged_text, count(*) filter (where kind = 'formula') as formula_count from pp where piece <> '' group by page_id""")
def formula_pages(spark, sf):
    regions = _placed(spark, sf).select("page_id", F.col("pos").alias("det_seq"), *geometry.BOX, F.col("txt").alias("text"), F.when(F.col("label") == "formula_region", "formula").otherwise("text").alias("kind"))
    return questions.with_formulas(regions).drop("formula_map")


@query(f"{WITH}, {_options_sql('bo', 'wb_blocks', 'page_id, pos', 'txt')} select page_id, pos, array_to_string(l, '|') as options from bo where len(l) > 0")
def option_candidates(spark, sf):
    o = T.option_candidates(F.col("txt"))
    return blocks(spark, sf).where(F.size(o) > 0).select("page_id", "pos", F.array_join(o, "|").alias("options"))


@query(f"""{WITH}, t as (select page_id, pos, unnest(regexp_extract_all(txt, '[A-Za-z]{{2,24}}')) as w from wb_blocks), d as (select page_id, pos, lower(w) as w from t group by all) select page_id, pos, count(*) as n from d group by page_id, pos""")
def lexicon_sizes(spark, sf):
    w = T.lexicon_tokens(F.col("txt"))
    return blocks(spark, sf).where(F.size(w) > 0).select("page_id", "pos", F.size(w).cast("long").alias("n"))


@query(f"""{WITH}, t as (select page_id, pos, regexp_extract_all(txt, '([A-Za-z0-9가-힣{{}}\\[\\]|`~^_+-]{{2,32}})', 1) as l from wb_blocks),
n as (select page_id, pos, list_filter(l, lambda x: len(regexp_replace(regexp_replace(x, '^[0-9]{{1,3}}[.,]', ''), '[^0-9A-Za-z가-힣]', '', 'g')) >= 2 and (regexp_matches(x, '[{{}}\\[\\]|`~^]') or (regexp_matches(x, '[A-Za-z]') and regexp_matches(x, '[가-힣]')))) as l from t),
k as (select *, list_transform(l, lambda x: lower(x)) as k from n)
select page_id, pos, array_to_string(list_filter(l, lambda x, i: list_position(k, lower(x)) = i), ' ') as tokens from k where len(l) > 0""")
def noisy_tokens(spark, sf):
    n = T.noisy_tokens(F.col("txt"))
    return blocks(spark, sf).where(F.size(n) > 0).select("page_id", "pos", F.array_join(n, " ").alias("tokens"))


# -- candidates ---------------------------------------------------------------------------------------------------------


def _candidates(spark, sf) -> DataFrame:
    """Turns of a conversation as candidates of one region."""
    c = table(spark, sf, "conversations")
    conf = (F.col("conv_id") * 7 + F.col("turn") * 3) % 10 / 10.0
    return c.select(F.col("conv_id").alias("page_id"), F.lit(1).alias("box_id"), F.struct("turn", "role", "text").alias("cand_seq"), F.col("role").alias("engine"), "text", conf.alias("conf"))


_CANDIDATES = "cd as (select conv_id as page_id, 1 as box_id, turn, role, text, ((conv_id * 7 + turn * 3) % 10) / 10.0 as conf from conversations)"


@query(f"""with {_CANDIDATES}, {_quality_sql('cd', 'page_id, turn, role, text', 'text', 'conf')},
sc as (select *, ({_n('text', '[\\p{L}\\p{N}]')} + cast(0.3 as double) * {_n('text', '[\\s]')}) - cast(0.5 as double) * {_n('text', '[@#$%^&*<>]')} + cast(0.01 as double) * length(text) as score, {_r4('q')} as q4, {_r4('z')} as z4 from qe),
cm as (select *, {_r4('score + cast(0 as double) * 4.5 + conf * cast(10 as double) + q4 * 8 - z4 * 3')} as composite from sc),
rk as (select *, row_number() over (partition by page_id order by composite desc, turn, role, text) as rank from cm)
select page_id, turn, role, composite, rank from rk where rank <= 20""")
def ranked_candidates(spark, sf):
    out = ranking.rank(_candidates(spark, sf), None).where("rank <= 20")
    return out.select("page_id", "cand_seq.turn", "cand_seq.role", "composite", "rank")


@query()
def agreed_candidates(spark, sf):
    """With consensus, of which SQL has no measure."""
    out = ranking.rank(ranking.consensus(_candidates(spark, sf))).where("rank = 1")
    return out.select("page_id", "cand_seq.turn", F.round("consensus", 4).alias("consensus"), "composite")


@query()
def picked_results(spark, sf):
    return ranking.pick_result(_candidates(spark, sf)).select("page_id", "cand_seq.turn", F.round("total", 4).alias("total"))


@query(f"with {_CANDIDATES}, r as (select *, row_number() over (partition by page_id, role, regexp_replace(lower(trim(text)), '\\s+', ' ', 'g') order by turn, role, text) as n from cd) select page_id, turn, role from r where n = 1")
def distinct_candidates(spark, sf):
    return ranking.first_of_signature(_candidates(spark, sf)).select("page_id", "cand_seq.turn", "cand_seq.role")


@query("""select event_id, case when event_type = 'error' or contains(event_type, 'hand') then 'trocr' when contains(event_type, 'view') then 'tesseract' else 'easyocr' end as engine,
 case when value < 50 and event_type <> 'click' then 'click' end as retry, value < 20 or event_id % 7 >= 5 as boosted, (event_id % 90) < trunc((event_id % 100) * 0.7) as guarded from (select event_id, event_type, coalesce(value, 0) as value from events) t""")
def routed_events(spark, sf):
    e = table(spark, sf, "events").withColumn("value", F.coalesce("value", F.lit(0.0)))
    label = F.replace(F.col("event_type"), F.lit("view"), F.lit("text"))
    return e.select(
        "event_id",
        ranking.engine_for(label, F.col("event_type") == "error", "trocr", "tesseract", "easyocr").alias("engine"),
        ranking.retry_low_confidence(F.col("value"), F.col("event_type"), 50.0, "CLICK").alias("retry"),
        ranking.boosted(F.col("value"), F.col("event_id") % 7, 20.0, 5.0).alias("boosted"),
        ranking.keep_text_guard(F.col("event_id") % 90, F.col("event_id") % 100, 0.7).alias("guarded"),
    )


@query(f"""{WITH}, h as (select page_id, pos, case when {_n('txt', '[A-Za-z]')} > 3 then 'eng' else 'mixed' end as hint, case when pos % 2 = 0 then 'tesseract' else 'tesseract_kor_eng' end as engine from wb_blocks)
select page_id, pos, case when hint = 'eng' then 'tesseract_eng' when engine <> 'tesseract_kor_eng' then 'tesseract_kor_eng' end as retry, case when pos % 2 = 1 then 'kor+eng' end as languages from h""")
def language_retries(spark, sf):
    t, engine = F.col("txt"), F.when(F.col("pos") % 2 == 0, "tesseract").otherwise("tesseract_kor_eng")
    return blocks(spark, sf).select("page_id", "pos", ranking.retry_language(T.language_hint(t), engine, "tesseract_eng", "tesseract_kor", "tesseract_kor_eng").alias("retry"), ranking.tesseract_languages(engine).alias("languages"))


@query("select c_custkey, case c_custkey % 3 when 0 then 'a,b,a,c' when 1 then 'd,a,b,c' else 'b,c,a' end as engines from customer")
def engine_lists(spark, sf):
    k = F.col("c_custkey") % 3
    own = F.when(k == 0, F.array(F.lit("a"), F.lit("b"), F.lit("a"))).when(k == 1, F.array(F.lit("d"), F.lit(" "))).otherwise(F.array(F.lit("b"), F.lit("c")))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(ranking.with_fallbacks(own, F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit(""))), ",").alias("engines"))


@query()
def matched_lines(spark, sf):
    """The most similar benchmark text of each of the conversations' turns: whole texts, all of them compared."""
    left = table(spark, sf, "conversations").select((F.col("conv_id") % 8).alias("page_id"), "conv_id", "turn", "text")
    right = table(spark, sf, "benchmark").select(F.col("item_id").alias("seq"), "text")
    return ranking.best_of_all(left, right, 0.45).select("page_id", "conv_id", "turn", "match", "ratio")


@query("select l_orderkey, avg(case when l_discount >= 0.02 then l_quantity / 100 end) as native_conf from lineitem group by l_orderkey")
def native_confidence(spark, sf):
    conf = F.when(F.col("l_discount") >= 0.02, F.col("l_quantity")).otherwise(-1.0)
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.avg(F.when(conf >= 0, F.col("l_quantity") / 100)).alias("native_conf"))


# -- documents and traces -----------------------------------------------------------------------------------------------


def _documents(spark, sf) -> DataFrame:
    """JSON documents of orders: an item for each line, some without a number, some not JSON at all."""
    li = table(spark, sf, "lineitem")
    no = F.when(F.col("l_partkey") % 7 == 0, F.lit("?")).otherwise((F.col("l_partkey") % 9).cast("string"))
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", no.alias("no"), F.concat(F.lit("n"), F.col("l_linenumber").cast("string")).alias("notes"))
    grouped = li.groupBy(F.col("l_orderkey").alias("page_id")).agg(F.array_sort(F.collect_list(item)).alias("i"))
    body = F.to_json(F.struct(F.transform("i", lambda x: F.struct(x["no"].alias("no"), x["notes"].alias("notes"))).alias("items")))
    return grouped.select("page_id", F.when(F.col("page_id") % 11 == 0, "{broken").otherwise(body).alias("corrected"))


_ITEMS = "it as (select l_orderkey as page_id, case when l_partkey % 7 = 0 then null else cast(l_partkey % 9 as int) end as no, l_linenumber, l_partkey, l_suppkey, l_quantity from lineitem where l_orderkey % 11 <> 0)"


@query(f"""with {_ITEMS}, n as (select distinct page_id, no from it where no is not null), g as (select page_id, string_agg(cast(no as varchar), ',' order by no) as numbers, list(no) as l from n group by page_id)
select p.page_id, coalesce(numbers, '') as numbers, array_to_string(list_sort(list_filter([1, 2, 3], lambda x: not list_contains(coalesce(l, []), x))), ',') as missing from (select distinct l_orderkey as page_id from lineitem) p left join g using (page_id)""")
def item_numbers(spark, sf):
    def joined(c):
        return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")

    j = F.col("corrected")
    return _documents(spark, sf).select("page_id", joined(documents.item_numbers(j)).alias("numbers"), joined(documents.missing_numbers(F.array(F.lit(1), F.lit(2), F.lit(3)), j)).alias("missing"))


@query(f"""with {_ITEMS} select page_id, string_agg(coalesce(cast(no as varchar), '?') || ':n' || l_linenumber, ' ' order by coalesce(no, 1000000000), l_linenumber, l_partkey, l_suppkey, l_quantity) as items from it group by page_id""")
def ordered_items(spark, sf):
    out = _documents(spark, sf).withColumn("items", documents.by_number(documents.items(F.col("corrected")))).where("items is not null")
    return out.select("page_id", F.array_join(F.transform("items", lambda x: F.concat(x["no"], F.lit(":"), x["notes"])), " ").alias("items"))


@query(f"""{WITH}, {_PIECES}, qs as (select distinct page_id, question_no as no from pc), hv as (select page_id, question_no as no, max(pos) as pos from pc where pos % 2 = 0 group by all)
select q.page_id, q.no, case when h.pos is null then 'auto_added_missing_question_from_pipeline' else 'block ' || h.pos end as note from qs q left join hv h on h.page_id = q.page_id and h.no = q.no""")
def completed_items(spark, sf):
    p = questions.pieces(blocks(spark, sf))
    found = p.where("pos % 2 = 0").select("page_id", F.col("question_no").alias("no"), F.col("pos").alias("seq"), F.concat(F.lit("block "), F.col("pos").cast("string")).alias("note"))
    return documents.add_missing(found, p.select("page_id", "question_no").distinct())


def _pages(spark, sf) -> DataFrame:
    """Pages of diagnosed blocks with questions and hints."""
    b = _placed(spark, sf).withColumn("engine", F.when(F.col("pos") % 2 == 0, "TrOCR").otherwise("tesseract"))
    return hints.hints(questions.pages(questions.diagnose(b), "suspect", "engine"))


_ROLE = f"case when contains(txt, '[') and contains(txt, ']') then 'options' when contains(txt, ')') and {_n('txt', '[(]')} >= 2 then 'options' when contains(txt, '?') or ends_with(txt, '.') then 'prompt' else 'misc' end"


@query(f"""{WITH}, {_PIECES},
nb as (select page_id, string_agg(cast(no as varchar), ',' order by no) as numbers from (select distinct page_id, question_no as no from pc) t group by page_id),
fn as (select page_id, pos, arg_min(question_no, nth) as no from pc group by page_id, pos),
bl as (select w.page_id, 1 as part, w.pos, {_id('w.pos')} || ' ' || case when w.pos % 2 = 0 then 'handwriting' else 'printed' end || ' ' || {_ROLE} || ' ' || coalesce(cast(fn.no as varchar), '-') || ' ' || trim(txt) as said
 from wb_blocks w left join fn on fn.page_id = w.page_id and fn.pos = w.pos where trim(txt) <> ''),
mf as (select page_id, det_seq, min(det_seq) over (partition by page_id, label) as first from wb_boxes where label like 'marker%'),
mk as (select page_id, 2 as part, row_number() over (partition by page_id order by first, det_seq) as pos from mf),
al as (select * from bl union all select page_id, part, pos, replace({_id('pos')}, 'b', 'm') || ' mark misc - ' from mk),
ag as (select page_id, string_agg(said, chr(10) order by part, pos) as blocks from al group by page_id)
select p.page_id, coalesce(blocks, '') as blocks, coalesce(numbers, '') as expected, coalesce(numbers, '') as detected, 'page.png' as source from (select distinct page_id from wb_blocks) p left join ag using (page_id) left join nb using (page_id)""")
def model_payloads(spark, sf):
    """What a model gets of each page: blocks, marks and numbers as read back from the JSON."""
    b = boxes(spark, sf)
    out = documents.payload(_pages(spark, sf), b.where(geometry.is_marker()), F.concat(F.lit("/scans/"), F.col("page_id").cast("string"), F.lit("/page.png")))
    block = "struct<id:string,kind:string,role:string,text:string,question_no:int>"
    read = out.withColumn("p", F.from_json("payload", f"struct<source:string,blocks:array<{block}>,expected_question_nos:array<int>,detected_question_nos_from_blocks:array<int>>"))

    def numbers(c: str) -> F.Column:
        return F.array_join(F.transform(c, lambda n: n.cast("string")), ",")

    said = F.transform("p.blocks", lambda x: F.concat_ws(" ", x["id"], x["kind"], x["role"], F.coalesce(x["question_no"].cast("string"), F.lit("-")), x["text"]))
    return read.select("page_id", F.array_join(said, "\n").alias("blocks"), numbers("p.expected_question_nos").alias("expected"), numbers("p.detected_question_nos_from_blocks").alias("detected"), "p.source")


@query(r"""select item_id, 'user' as first_role, 'You are an OCR post-processing specialist.' || chr(10) || 'Domain: school pages' || chr(10) || 'Style: concise' || chr(10) || 'Rules:' || chr(10)
|| '- Preserve original meaning' || chr(10) || '- Do not add new facts' || chr(10) || '- Fix only OCR mistakes and spacing' || chr(10) || chr(10) || '[OCR]' || chr(10) || text || chr(10) || chr(10) || '[OUTPUT]' || chr(10) as prompt from benchmark""")
def basic_prompts(spark, sf):
    m = prompts.messages(table(spark, sf, "benchmark"), prompts.settings({"domain": "school pages"}, template={"domain": "else"}))
    return m.select("item_id", F.get("messages", 0)["role"].alias("first_role"), F.get("messages", 0)["content"].alias("prompt"))


@query()
def workbook_prompts(spark, sf):
    """Chats that ask for pages as structured items; tests hold them against a plain version."""
    config = {"prompt_mode": "workbook_json"}
    m = prompts.messages(documents.payload(_pages(spark, sf)).withColumn("text", F.lit("")), config)
    return m.select("page_id", F.size("messages").alias("n"), F.length(F.get("messages", 1)["content"]).alias("characters"))


@query(f"""{WITH}, {_DIAGNOSED},
tq as (select page_id, count(distinct question_no) as n, string_agg(distinct cast(question_no as varchar), ',' order by cast(question_no as varchar)) as numbers from pc group by page_id),
ss as (select page_id, pos, row_number() over (partition by page_id order by noise_score desc, pos) as k from dg where reasons <> ''),
sa as (select page_id, string_agg({_id('pos')}, ',' order by k) as suspects from ss where k <= 12 group by page_id)
select p.page_id, box_count, coalesce(n, 0) as question_chunk_count, coalesce(numbers, '') as numbers, coalesce(suspects, '') as suspects from (select page_id, count(*) as box_count from wb_blocks group by page_id) p left join tq using (page_id) left join sa using (page_id)""")
def page_reports(spark, sf):
    """Counts, numbers and noisiest blocks of each page."""
    d = questions.diagnose(_placed(spark, sf))
    out = questions.page_report(d, questions.compose(questions.pages(_placed(spark, sf))))
    numbers = F.array_join(F.array_sort(F.transform("detected_question_numbers", lambda n: n.cast("string"))), ",")
    asked = F.when(F.col("question_chunk_text") == "", 0).otherwise(F.col("question_chunk_count")).cast("long")
    return out.select("page_id", "box_count", asked.alias("question_chunk_count"), numbers.alias("numbers"), F.array_join(F.transform("suspect_boxes", lambda x: x["block_id"]), ",").alias("suspects"))


@query(f"""{WITH}, o as (select page_id, det_seq, x1, y1, x2, y2, row_number() over (partition by page_id order by det_seq) as idx from wb_boxes where label = 'option_block'),
t as (select page_id, pos as idx, txt from wb_blocks where pos % 3 <> 0),
f as (select page_id, det_seq, label, (x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy, min(det_seq) over (partition by page_id, label) as first from wb_boxes where label like 'marker%'),
j as (select o.page_id, o.idx, regexp_replace(upper(f.label), '^MARKER_', '') as mark, f.first, f.det_seq as m from o left join f on f.page_id = o.page_id and f.cx between o.x1 and o.x2 and f.cy between o.y1 and o.y2),
g as (select page_id, idx, coalesce(string_agg(mark, ',' order by first, m), '') as marks from j group by page_id, idx)
select g.page_id, cast(g.idx as int) as idx, coalesce(t.txt, '') as text, marks from g left join t on t.page_id = g.page_id and t.idx = g.idx""")
def option_texts(spark, sf):
    """Option boxes with the texts of their places, and the marks in them."""
    b = boxes(spark, sf)
    texts = blocks(spark, sf).where("pos % 3 <> 0").select("page_id", F.col("pos").alias("idx"), F.col("txt").alias("text"))
    return geometry.option_blocks(b.where("label = 'option_block'"), texts, b).select("page_id", "idx", "text", F.array_join("markers", ",").alias("marks"))


@query(f"""{WITH}, c as (select page_id, sum(case when label = 'option_block' then 1 else 0 end) as o, sum(case when label = 'formula_region' then 1 else 0 end) as f, count(*) as n from wb_boxes group by page_id),
t as (select page_id, max(case when trim(txt) <> '' then 1 else 0 end) as said from wb_blocks group by page_id)
select c.page_id, said = 1 as has_raw_text, c.page_id % 3 <> 0 as has_corrected, cast(o as int) as option_count, cast(f as int) as formula_count, cast(n as int) as ocr_records from c join t using (page_id)""")
def assembled_documents(spark, sf):
    """The final document of each page, written as JSON, and what an evaluation reads of it."""
    b, placed = boxes(spark, sf), _placed(spark, sf)
    page = questions.pages(placed)
    regions = placed.select("page_id", F.col("pos").alias("det_seq"), *geometry.BOX, F.col("txt").alias("text"), F.when(F.col("label") == "formula_region", "formula").otherwise("text").alias("kind"))
    texts = blocks(spark, sf).select("page_id", F.col("pos").alias("idx"), F.col("txt").alias("text"))
    options = geometry.option_blocks(b.where("label = 'option_block'"), texts, b).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("idx", "text", "mark", "markers", "reason"))).alias("options"))
    records = page.select("page_id", F.transform("blocks", lambda x: F.struct(x["block_id"].alias("box_id"), x["txt"].alias("text"), x["conf"].alias("conf"))).alias("ocr_records"), F.transform("questions", lambda q: q.dropFields("text", "context_text")).alias("question_chunks"))
    parts = questions.compose(page).select("page_id", F.col("selected_text").alias("raw_text")).join(records, "page_id").join(questions.with_formulas(regions).select("page_id", "formula_map"), "page_id", "left").join(options, "page_id", "left")
    final = documents.assembled(parts.withColumn("corrected", F.when(F.col("page_id") % 3 != 0, "{}").otherwise("")))
    return documents.evaluate(final.select("page_id", F.from_json("document", documents.READ).alias("d")).select("page_id", "d.*"))


@query()
def ensemble_results(spark, sf):
    """One result of each conversation's turns, some of which fail; tests hold it against a plain version."""
    c = _candidates(spark, sf).withColumn("latency_ms", F.length("text") / 10.0).withColumn("error", F.when(F.col("cand_seq.turn") % 3 == 0, "timeout"))
    return ranking.ensemble(c).select("page_id", "selected", F.length("text").alias("n_chars"), F.size("candidates").alias("candidates"), F.size("errors").alias("errors"))


@query(f"""with {_CANDIDATES}, r as (select *, turn % 3 = 0 as failed from cd),
s as (select page_id, count(distinct role || chr(1) || regexp_replace(lower(trim(text)), '\\s+', ' ', 'g')) as added from r where not failed group by page_id)
select r.page_id, count(*) as attempted_calls, coalesce(max(s.added), 0) as candidates_added, cast(least(32, sum(case when failed then 1 else 0 end)) as int) as errors from r left join s on s.page_id = r.page_id group by r.page_id""")
def call_statistics(spark, sf):
    c = _candidates(spark, sf).withColumn("variant", F.lit("as_is")).withColumn("error", F.when(F.col("cand_seq.turn") % 3 == 0, "timeout"))
    return ranking.call_statistics(c).select("page_id", "attempted_calls", "candidates_added", F.size("errors").alias("errors"))


@query("select event_type as plugin, user_id as page_id, count(*) as n from events where event_id % 2 = 0 group by all")
def plugin_error_maps(spark, sf):
    """Errors of plugins by page, as a map without the plugins that have none; read back as rows."""
    found = table(spark, sf, "events").groupBy(F.col("user_id").alias("page_id"), F.col("event_type").alias("plugin")).agg(F.array_sort(F.collect_list(F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")))).alias("errors"))
    return files.plugin_errors(found).select("page_id", F.explode("plugin_errors").alias("plugin", "errors")).select("plugin", "page_id", F.size("errors").cast("long").alias("n"))


@query()
def plugin_text_boxes(spark, sf):
    """Boxes of two plugins' polygons, each on its own cleared of overlaps; tests hold the chain against a plain version."""
    corner = [F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x2", "y1"), ("x2", "y2"), ("x1", "y2"), ("x1", "y1"))]
    found = boxes(spark, sf).select("page_id", "det_seq", F.array(*corner).alias("polygon"))
    size = found.select("page_id").distinct().withColumns({"width": F.lit(300), "height": F.lit(100)})
    return geometry.plugin_boxes({"a": found.where("det_seq % 2 = 0"), "b": found.where("det_seq % 2 = 1"), "c": found}, ["b", "a"], size, min_area=500.0, most=3)


@query("""select o_orderkey as page_id, o_orderpriority <> '' as has_raw_text, o_orderkey % 3 <> 0 as has_corrected, coalesce(n, 0) as option_count, cast(o_orderkey % 2 as int) as formula_count, 0 as ocr_records
from orders left join (select l_orderkey, count(*) as n from lineitem group by 1) l on l_orderkey = o_orderkey""")
def evaluation(spark, sf):
    o = table(spark, sf, "orders")
    options = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("options"))
    final = o.join(options, o.o_orderkey == options.l_orderkey, "left").select(
        F.col("o_orderkey").alias("page_id"), F.col("o_orderpriority").alias("raw_text"), F.when(F.col("o_orderkey") % 3 != 0, "x").alias("corrected"), "options",
        F.when(F.col("o_orderkey") % 2 == 1, F.create_map(F.lit("[FORMULA_1]"), F.lit(1))).alias("formula_map"), F.array().alias("ocr_records"),
    )
    return documents.evaluate(final)


@query("""with e as (select event_type, event_id, value, row_number() over (partition by event_type order by ts desc, event_id desc) as n from events)
select event_type as stage_name, event_id, value as latency_ms, case event_type when 'click' then 'Input' when 'view' then 'Output' else 'other' end as stage_label from e where n = 1""")
def latest_stages(spark, sf):
    e = table(spark, sf, "events").select(F.struct("ts", "event_id").alias("log_seq"), F.col("event_type").alias("stage_name"), "event_id", F.col("value").alias("latency_ms"))
    return files.labelled(files.latest_by_stage(e), {"click": "Input", "view": "Output"}).select("stage_name", "event_id", "latency_ms", "stage_label")


@query("select user_id, string_agg(distinct event_type, ',' order by event_type) as kinds, count(distinct event_type) as n from events group by user_id")
def kinds_of_user(spark, sf):
    kinds = F.array_sort(F.collect_set("event_type"))
    return table(spark, sf, "events").groupBy("user_id").agg(F.array_join(kinds, ",").alias("kinds"), F.size(kinds).cast("long").alias("n"))


@query("""with t as (select conv_id, turn, role, text, string_split(text, ' ') as w from conversations)
select conv_id, turn, role, len(text) as n_chars, array_to_string(flatten(list_transform(range(1, len(w) + 1), lambda i: list_filter([w[i],
 case when i + 1 <= len(w) then w[i] || w[i + 1] end, case when i + 2 <= len(w) then w[i] || w[i + 1] || w[i + 2] end], lambda x: x is not null))), ' ') as grams from t""")
def token_ngrams(spark, sf):
    """Runs of one to three tokens of whole texts."""
    grams = T.ngrams(F.split("text", " "))
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars"), F.array_join(grams, " ").alias("grams"))


@query("select doc_id, case when doc_id % 2 = 0 then 'seen; checked' when doc_id % 3 = 0 then 'checked twice' else 'checked' end as note from documents")
def notes(spark, sf):
    old = F.when(F.col("doc_id") % 2 == 0, "seen").when(F.col("doc_id") % 3 == 0, "checked twice")
    return table(spark, sf, "documents").select("doc_id", T.append_note(old, "checked").alias("note"))


@query()
def final_documents(spark, sf):
    """Corrected documents, repaired by the questions of their pages; tests hold the repair against examples."""
    b = _placed(spark, sf)
    out = documents.finish(_documents(spark, sf).withColumn("corrected", F.when(F.col("page_id") % 5 != 0, F.col("corrected"))), questions.chunks(b))
    return out.select("page_id", F.size(documents.items(F.col("document"))).alias("items"), F.length("document").alias("characters"))


@query()
def guarded_candidates(spark, sf):
    c = _candidates(spark, sf).select("page_id", "cand_seq.turn", "cand_seq.role", "text", "conf")
    first = c.where("turn = 1").groupBy("page_id").agg(F.min("text").alias("original_text"), F.min("conf").alias("original_conf"))
    out = ranking.consistent(c.where("turn > 1").join(first, "page_id"), 0.5, 0.3, 20.0)
    return out.select("page_id", "turn", "role", F.round("similarity", 4).alias("similarity"), "reverted")


@query()
def cleanup_hints(spark, sf):
    """Hints for each page; tests hold them against a plain version."""
    return hints.cleanup_hints(questions.pages(questions.diagnose(_placed(spark, sf)), "suspect")).select("page_id", F.length("hints").alias("characters"), F.get_json_object("hints", "$.suspect_block_ids").alias("suspect_block_ids"))


# -- images -------------------------------------------------------------------------------------------------------------


def _pixmap(width: int, height: int, colour: Callable) -> F.Column:
    """An image whose pixel i has the six hexadecimal digits colour(i)."""
    head = F.lit(f"P6 {width} {height} 255\n".encode())
    return F.concat(head, F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), colour), "")))


@query("""with px as (select p_partkey, (p_partkey * 37 + i * 11) % 256 as r, (p_partkey * 17 + i * 29) % 256 as g, (p_partkey * 7 + i * 53) % 256 as b from part, range(96) t(i)),
c as (select *, greatest(r, g, b) as v, greatest(r, g, b) - least(r, g, b) as s from px)
select p_partkey, cast(sum(case when r = v and (60 * abs(g - b) < 31 * s or s = 0) and 510 * s >= 139 * greatest(v, 1) and v >= 35 then 1 else 0 end) as bigint) as red from c group by p_partkey""")
def red_ink_counts(spark, sf):
    """Pixels of red ink in an image for each part."""

    def colour(i):
        return F.concat(*[F.lpad(F.hex((F.col("p_partkey") * a + i * b) % 256), 2, "0") for a, b in ((37, 11), (17, 29), (7, 53))])

    drawn = table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), _pixmap(12, 8, colour).alias("content"))
    return images.apply(drawn, lambda image: [{"red": int(images.red_ink(image).sum())}], "red long").select(F.col("page_id").alias("p_partkey"), "red")


_MARKS = """cast(2 + 20 * j as double) as x1, cast(2 + (p_partkey + j) % 4 as double) as y1, cast(2 + 20 * j + 4 + (p_partkey * (j + 3)) % 9 as double) as x2,
cast(2 + (p_partkey + j) % 4 + 7 + (p_partkey * (j + 1)) % 8 as double) as y2 from part, range(3) t(j)"""


def _marked(spark, sf) -> DataFrame:
    """An image for each part, of three dark rectangles. Drawing and reading cost far more than moving a key, so keys are dealt out to all tasks."""
    p = F.col("p_partkey")

    def row(y):
        parts = []
        for j in range(3):
            top = 2 + (p + j) % 4
            wide = F.when((y >= top) & (y < top + 7 + (p * (j + 1)) % 8), 4 + (p * (j + 3)) % 9).otherwise(0).cast("int")
            parts += [F.lit("F0F0F0" * 2), F.repeat(F.lit("202020"), wide), F.repeat(F.lit("F0F0F0"), 18 - wide)]
        return F.concat(*parts)

    pixels = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(23)), row), ""))
    keys = table(spark, sf, "part").select("p_partkey").repartition(4 * spark.sparkContext.defaultParallelism)
    return keys.select(p.alias("page_id"), F.concat(F.lit(b"P6 60 24 255\n"), pixels).alias("content"))


@query(f"select p_partkey, {_MARKS}")
def mark_boxes(spark, sf):
    """Boxes of the marks of an image for each part, found again by threshold and connected regions."""

    def kernel(image):
        found = images.mark_boxes(images.marks(images.grey(image), "otsu", blur=1), max_ratio=1.0)
        return [dict(zip(("x1", "y1", "x2", "y2"), box, strict=True)) for box in found]

    return images.apply(_marked(spark, sf), kernel, "x1 double, y1 double, x2 double, y2 double").select(F.col("page_id").alias("p_partkey"), "x1", "y1", "x2", "y2")


@query(f"""with recursive m as (select p_partkey as page_id, {_MARKS}), b as (select *, row_number() over (partition by page_id order by (y1 + y2) / 2, x1) as det_seq from m),
{_lines_sql('(y1 + y2) / 2', 0.6, 'b')}
select page_id, det_seq, x1, y1, x2, y2, line_no, reading_rank, case when det_seq <= 2 then cast(det_seq as varchar) else '' end as label, case when reading_rank <= 2 then cast(reading_rank as varchar) else '' end as reading_label,
 cast((reading_rank - 1) // 2 as int) as row, (reading_rank - 1) % 2 as column from placed join b using (page_id, det_seq)""")
def character_marks(spark, sf):
    """The marks of an image for each part in reading order, with labels and places in a gallery of two columns."""
    return images.characters(_marked(spark, sf), {"threshold_mode": "otsu", "blur_kernel": 1, "max_area_ratio": 1.0, "label_limit": 2, "gallery_columns": 2})


@query(f"""with b as (select p_partkey as page_id, j + 1 as box_id, greatest(0, 2 + 20 * j - 1) as l, greatest(0, 1 + (p_partkey + j) % 4) as t, least(60, 20 * j + 13) as r, least(24, 12 + p_partkey % 20) as b from part, range(3) g(j)),
px as (select page_id, box_id, y, x, coalesce((select max(1) from range(3) m(j) where x >= 2 + 20 * j and x < 6 + 20 * j + (page_id * (j + 3)) % 9 and y >= 2 + (page_id + j) % 4 and y < 9 + (page_id + j) % 4 + (page_id * (j + 1)) % 8), 0) as dark, r - l as w, b - t as h
 from b, range(60) u(x), range(24) v(y) where x >= l and x < r and y >= t and y < b)
select page_id, box_id, hex(encode('P6 ' || max(w) || ' ' || max(h) || ' 255' || chr(10))) || string_agg(case dark when 1 then '202020' else 'F0F0F0' end, '' order by y, x) as crop from px group by page_id, box_id""")
def page_crops(spark, sf):
    """A padded crop for each of three boxes on an image for each part."""
    j, p = F.col("box_id") - 1, F.col("page_id")
    edges = {"x1": 2.7 + 20 * j, "y1": 2 + (p + j) % 4, "x2": 12.9 + 20 * j, "y2": 11 + p % 20}
    asked = table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("box_id")).withColumns(edges)
    return images.crops(_marked(spark, sf), asked, 1).select("page_id", "box_id", F.hex("crop").alias("crop"))
