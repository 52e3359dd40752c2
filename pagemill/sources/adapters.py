"""Page-shaped inputs derived from the test tables, by the same SQL in Spark and elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_ORDER = "partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"

BOXES = f"""
select page_id, det_seq, cast(x1 as double) as x1, cast(y1 as double) as y1, cast(x1 + w as double) as x2, cast(y1 + h as double) as y2, label, conf from (
 select l_orderkey as page_id, row_number() over ({_ORDER}) as det_seq,
  (l_partkey * 37) % 240 as x1, (l_suppkey * 53 + l_linenumber * 11) % 90 as y1, 40 + 4 * cast(l_quantity as bigint) as w, 14 + (l_partkey % 5) * 3 as h,
  round(0.5 + l_discount * 4, 4) as conf,
  case when l_returnflag = 'A' then 'option_block'
   when l_returnflag = 'R' then case l_partkey % 6 when 0 then 'marker_x' when 1 then 'marker_o' when 2 then 'marker_v' when 3 then 'marker_check' when 4 then 'marker_star' else 'marker' end
   when l_suppkey % 8 = 0 then 'formula_region' else 'text_region' end as label
 from lineitem) t0
"""

BLOCKS = f"""
select page_id, pos, conf, case kind
  when 0 then qno || '. ' || nm || ' [' || ty || ' / ' || br || ']'
  when 1 then qno || '. ' || nm || ' (' || lower(ty) || ', ' || ty || ', ' || nm || ')'
  when 2 then 'Read ' || nm || ' {{' || br || ' or ' || ty || '}}'
  when 3 then 'intro ' || nm || ' ' || qno || '. ' || br || ' ' || (qno + 1) || '. ' || ty || ' [a|b]'
  when 4 then '|{{}}@#$% ' || nm || ' ~^'
  when 5 then ''
  else nm || ' is ' || br || '.' end as txt
from (select l_orderkey as page_id, row_number() over ({_ORDER}) as pos, 1 + (l_partkey % 4) as qno,
  (l_suppkey + l_linenumber) % 7 as kind, round(0.3 + l_discount * 6, 4) as conf, p_name as nm, p_brand as br, p_type as ty
 from lineitem join part on p_partkey = l_partkey) t0
""".replace("{{", "{").replace("}}", "}")

#: For oracles: `with` clauses that name the inputs.
WITH = f"with recursive wb_boxes as ({BOXES}), wb_blocks as ({BLOCKS})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    text = text.replace("{", "{{").replace("}", "}}").replace("from lineitem", "from {lineitem}").replace("join part", "join {part}")
    return spark.sql(text, lineitem=table(spark, sf_dir, "lineitem"), part=table(spark, sf_dir, "part"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, det_seq, x1, y1, x2, y2, label, conf."""
    return _sql(spark, sf_dir, BOXES)


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, pos, conf, txt."""
    return _sql(spark, sf_dir, BLOCKS)
