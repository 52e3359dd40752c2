"""Readers and writers of pages, traces, path lists and character boxes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from time import perf_counter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

TRACE = "stage_name string, timestamp string, latency_ms double, meta string, artifacts map<string,string>"


def pages(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, content and page_id (of the path) of each image file."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.xxhash64("path").alias("page_id"), "path", "content")


def listed_paths(spark: SparkSession, path: str) -> DataFrame:
    """path of each line of a list of files; blank lines go."""
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")


def plugin_errors(found: DataFrame) -> DataFrame:
    """page_id and plugin_errors: a map of the plugins that have errors to these. found: page_id, plugin, errors."""
    some = F.when(F.size(F.coalesce("errors", F.array().cast("array<string>"))) > 0, F.struct(F.col("plugin").alias("key"), F.col("errors").alias("value")))
    return found.groupBy("page_id").agg(F.map_from_entries(F.array_sort(F.collect_list(some))).alias("plugin_errors"))


#: Boxes and characters of a page that a trace shows (fixed values).
TRACED = {"boxes": 200, "chars": 400}


def traced(pages_: DataFrame) -> DataFrame:
    """Pages with the arrays boxes and chars, where they have them, cut to what a trace shows."""
    return pages_.withColumns({c: F.slice(c, 1, n) for c, n in TRACED.items() if c in pages_.columns})


def recognise(pages_: DataFrame, engine: Callable[[], Callable[[bytes], Iterator[dict]]], schema: str) -> DataFrame:
    """Rows that an engine finds on each page: `engine` makes, once a task, a function from image to rows. Failures become `errors`.

    Each row has the milliseconds that its page took.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = engine()
        for df in batches:
            rows = []
            for page, content in zip(df["page_id"], df["content"], strict=True):
                began, own = perf_counter(), []
                try:
                    own = [{"errors": None, **r} for r in find(content)]
                except Exception as e:  # noqa: BLE001  one page's failure is that page's row
                    own = [{"errors": [f"{type(e).__name__}: {e}"]}]
                took = (perf_counter() - began) * 1000
                rows += [{"page_id": page, "latency_ms": took, **r} for r in own]
            yield pd.DataFrame(rows, columns=names).astype(object).where(lambda x: x.notna(), None)

    full = f"page_id long, errors array<string>, latency_ms double, {schema}"
    names = [part.strip().split(" ")[0] for part in full.split(",")]
    return pages_.select("page_id", "content").mapInPandas(run, full)


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Events of a trace; blank lines are skipped."""
    return spark.read.schema(TRACE).json(path)


def write_trace(events: DataFrame, path: str) -> None:
    events.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def with_artifacts(events: DataFrame, root: str) -> DataFrame:
    """Events (log_seq, stage_name, text, json, image) with the map artifacts: a name under root for each part that is there.

    `write_artifacts` puts the parts there.
    """
    place = F.concat(F.lit(f"{root.rstrip('/')}/"), F.format_string("%06d", F.col("log_seq").cast("long")), F.lit("_"), T.stage_file_name(F.col("stage_name")))
    parts = [F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("key"), F.concat(place, F.lit(f".{end}")).alias("value"))) for c, end in ARTIFACTS.items()]
    return events.withColumn("artifacts", F.map_from_entries(F.array_compact(F.array(*parts))))


#: Parts of an event and the endings of their names (fixed values).
ARTIFACTS = {"text": "txt", "json": "json", "image": "png"}


def write_artifacts(events: DataFrame, path: str) -> None:
    """The parts of events that `with_artifacts` named, as a table of name and content: files of their own would be too many."""
    named = events.select(F.explode("artifacts").alias("part", "name"), *ARTIFACTS)
    content = F.coalesce(*[F.when(F.col("part") == c, F.col(c).cast("binary")) for c in ARTIFACTS])
    named.select("name", content.alias("content")).write.mode("overwrite").parquet(path)


#: Settings of a detector where the caller's have none (fixed values).
DETECTOR = {"model": "yolov8n.pt", "conf": 0.25, "imgsz": 1024, "device": None, "classes": None, "max_det": 300, "crop_padding": 6, "line_thresh": 0.5}


def detector_options(config: dict, accelerated: Callable[[], bool] = lambda: False) -> dict:
    """A detector's settings: defaults, numbers of their defaults' types, and the processor for a device that isn't there.

    accelerated says whether other devices than the processor and `mps` can be used; it is asked only where one is named.
    """
    out = {k: config.get(k, v) if v is None or isinstance(v, str) else type(v)(config.get(k, v)) for k, v in DETECTOR.items()}
    named = out["device"] is not None and str(out["device"]).strip().lower() not in ("cpu", "mps", "")
    return {**out, "device": "cpu" if named and not accelerated() else out["device"]}


def class_name(index: Column, names: dict[int, str]) -> Column:
    """The name of a detector's class, or class_<i> for one without."""
    known = F.create_map(*[x for i, n in names.items() for x in (F.lit(i), F.lit(n))])
    return F.coalesce(known[index], F.concat(F.lit("class_"), index.cast("string")))


def character_boxes(lines: DataFrame) -> DataFrame:
    """Boxes of `char x1 y1 x2 y2 page` lines (page_id, line, height), with y turned downwards; other lines go."""
    parts = F.split(F.trim("line"), r"\s+")
    n = [F.get(parts, i).try_cast("int") for i in range(1, 5)]
    out = lines.select("page_id", F.get(parts, 0).alias("char"), n[0].alias("x1"), (F.col("height") - n[3]).alias("y1"), n[2].alias("x2"), (F.col("height") - n[1]).alias("y2"), F.size(parts).alias("n"))
    return out.where("n >= 5 and x1 is not null and y1 is not null and x2 is not null and y2 is not null").drop("n")


def gallery_cells(boxes: DataFrame, columns: int) -> DataFrame:
    """Row and column of each box (0-based idx) in a gallery."""
    return boxes.withColumn("row", F.floor(F.col("idx") / columns).cast("int")).withColumn("column", (F.col("idx") % columns).cast("int"))


def latest_by_stage(events: DataFrame) -> DataFrame:
    """The last event, in order of log_seq, of each named stage."""
    named = events.where("stage_name is not null and stage_name <> ''")
    last = named.groupBy("stage_name").agg(F.max(F.struct("log_seq", *[c for c in events.columns if c not in ("stage_name", "log_seq")])).alias("e"))
    return last.select("stage_name", "e.*")


def labelled(events: DataFrame, labels: dict[str, str], default: str = "other") -> DataFrame:
    """stage_label of each event, from a small table."""
    known = events.sparkSession.createDataFrame(list(labels.items()), "stage_name string, stage_label string")
    return events.join(F.broadcast(known), "stage_name", "left").withColumn("stage_label", F.coalesce("stage_label", F.lit(default)))
