"""Document quality by hierarchical empirical Bayes.

A document's own evidence is a log-likelihood ratio over binned text features. Sites form a hierarchy, host and path: labelled
documents count for their site as they are, unlabelled ones by what their evidence says, and less. A host's rate is drawn
towards the global rate and a path's towards its host's, the more the fewer documents it has; how strongly is estimated from
how much the sites differ. A document's posterior joins its path's rate with its own evidence.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_sized, sample_by_hash, slices, table, written

#: Labelled rows that the evidence is learned from, at most (in expectation). Sites' counts take all rows.
MAX_TRAIN = 40_000
#: Parts of the labelled rows; a labelled document's evidence comes from the other parts, not from its own label.
FOLDS = 2
#: Bins of a feature, and rows that a bin counts as having besides its own, at the global rate.
BINS, EXTRA = 24, 4.0
#: What an unlabelled document counts for its site, next to a labelled one.
SOFT = 0.1
#: Bounds of the strength of a prior, in documents.
WEAKEST, STRONGEST = 2.0, 10_000.0
#: Evidence of a single feature and of a document, in nats, is cut to this.
MOST_FEATURE, MOST = 4.0, 12.0

FEATURES = ("words", "letters", "capitals", "digits", "spaces", "signs", "marks", "other", "mean_word", "distinct", "lines", "repeated_lines", "line_length", "ends")
_CLASS = np.full(256, 6, dtype=np.int64)
for _chars, _k in ((b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b" \t\r\n\x0b\x0c", 3), (b".,;:!?'\"()-", 4), (b"#$%&*+/<=>@[\\]^_`{|}~", 5)):
    _CLASS[list(_chars)] = _k


def features(text: str) -> list[float]:
    """Numbers that tell prose from junk; of the empty text, zeros."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(raw):
        return [0.0] * len(FEATURES)
    kinds = np.bincount(_CLASS, weights=np.bincount(raw, minlength=256), minlength=7) / len(raw)
    words, lines = text.split(), text.split("\n")
    distinct = len(set(lines))
    ends = sum(w[-1] in ".!?" for w in words) / max(1, len(words))
    return [
        math.log1p(len(words)), kinds[0] + kinds[6], kinds[1], kinds[2], kinds[3], kinds[5], kinds[4], kinds[6],
        (len(raw) - kinds[3] * len(raw)) / max(1, len(words)), len(set(words)) / max(1, len(words)) * math.log1p(len(words)),
        math.log1p(len(lines)), 1 - distinct / len(lines), math.log1p(len(raw) / len(lines)), ends,
    ]


@dataclass(frozen=True)
class Evidence:
    """edges and log-likelihood ratios of each feature's bins, and the global rate of good documents."""

    edges: tuple[np.ndarray, ...]
    ratios: tuple[np.ndarray, ...]
    rate: float

    def of(self, x: list[float]) -> float:
        """From a text's features."""
        total = sum(float(r[np.searchsorted(e, v, side="right")]) for e, r, v in zip(self.edges, self.ratios, x, strict=True))
        return max(-MOST, min(MOST, total))


def fit(x: np.ndarray, good: np.ndarray) -> Evidence:
    """Learns from features and labels (0 or 1); bins hold equally many rows."""
    if not len(good):
        return Evidence(tuple(np.zeros(0) for _ in FEATURES), tuple(np.zeros(1) for _ in FEATURES), 0.5)
    rate = (good.sum() + 1) / (len(good) + 2)
    edges, ratios = [], []
    for column in x.T:
        e = np.unique(np.quantile(column, np.arange(1, BINS) / BINS))
        at = np.searchsorted(e, column, side="right")
        one = np.bincount(at, weights=good, minlength=len(e) + 1) + EXTRA * rate
        none = np.bincount(at, weights=1 - good, minlength=len(e) + 1) + EXTRA * (1 - rate)
        edges.append(e)
        ratios.append(np.clip(np.log(one / one.sum()) - np.log(none / none.sum()), -MOST_FEATURE, MOST_FEATURE))
    # features tell much the same, so their sum says too much; one factor brings it back to the labels' scale
    total = np.sum([r[np.searchsorted(e, c, side="right")] for e, r, c in zip(edges, ratios, x.T, strict=True)], axis=0)
    prior = math.log(rate / (1 - rate))
    loss = {f: float(np.logaddexp(0, np.where(good > 0, -1, 1) * (prior + f * total)).sum()) for f in np.arange(0.1, 1.55, 0.05)}
    factor = min(loss, key=loss.get)
    return Evidence(tuple(edges), tuple(r * factor for r in ratios), float(rate))


def learn_evidence(train: DataFrame) -> list[Evidence]:
    """Evidence from rows with text, good (0 or 1) and fold, of which there is a bounded number: from all, and for each fold from the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array([features(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64())), batch.column("good"), batch.column("fold")], names=["x", "good", "fold"])

    known = train.select("text", F.col("good").cast("int").alias("good"), "fold").mapInArrow(run, "x array<double>, good int, fold int").toPandas()
    x, good, fold = np.array(known["x"].tolist()).reshape(-1, len(FEATURES)), known["good"].to_numpy(), known["fold"].to_numpy()
    return [fit(x, good), *(fit(x[fold != f], good[fold != f]) for f in range(FOLDS))]


def strength(groups: DataFrame, rate: Column) -> Column:
    """Rows that a prior counts for, by the method of moments: how much rates of groups differ beyond chance.

    groups has n (rows) and good (of them) of each group; rate is what they are drawn towards.
    """
    spread = F.sum(F.col("n") * (F.col("good") / F.col("n") - rate) ** 2) / F.sum("n")
    chance = F.sum(rate * (1 - rate)) / F.sum("n")
    within = F.sum(F.col("n") * rate * (1 - rate)) / F.sum("n")
    beyond = spread - chance
    return F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), F.when(beyond > 0, within / beyond - 1).otherwise(F.lit(STRONGEST))))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, *, max_train: int = MAX_TRAIN, key: str = "doc_id") -> DataFrame:
    """key, score, predicted, evidence, host_rate and path_rate of each row.

    host and path are expressions over docs; nulls are a site of their own. labels has key and quality; null ids and labels
    take no part, of several labels of a document the lowest counts. A labelled document doesn't count for its own site's
    rate. Null texts count as empty. Site tables hold a row for each path and are joined, never collected.
    """
    kind = docs.schema[key].dataType.simpleString()
    known = labels.select(F.col(key).alias("_key"), F.col("quality").alias("_label")).where(F.col("_key").isNotNull() & F.col("_label").isNotNull())
    known = known.groupBy("_key").agg((F.min("_label") > 0).cast("int").alias("_label"))
    some = sample_by_hash(known, "_key", max_train)
    own = docs.select(F.col(key).alias("_key"), F.coalesce("text", F.lit("")).alias("text"))
    fold = F.pmod(F.xxhash64(F.lit("fold"), "_key"), F.lit(FOLDS)).cast("int")
    evidence = learn_evidence(own.join(F.broadcast(some), "_key").select("text", F.col("_label").alias("good"), fold.alias("fold")))
    prior = math.log(evidence[0].rate / (1 - evidence[0].rate))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            known_features = [features(t or "") for t in batch.column("text").to_pylist()]
            found = pa.array([[e.of(x) for e in evidence] for x in known_features], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_host"), batch.column("_path"), found], names=["_key", "_host", "_path", "_evidence"])

    site = docs.select(F.col(key).alias("_key"), "text", F.coalesce(host.cast("string"), F.lit("")).alias("_host"), F.coalesce(path.cast("string"), F.lit("")).alias("_path"))
    scored = site.mapInArrow(run, f"_key {kind}, _host string, _path string, _evidence array<double>")
    scored = join_sized(scored, known, ["_key"], "left").withColumn("evidence", F.get("_evidence", F.when(F.col("_label").isNotNull(), fold + 1).otherwise(0))).drop("_evidence")
    soft = 1 / (1 + F.exp(-(F.lit(prior) + F.col("evidence"))))
    scored = scored.withColumn("_n", F.when(F.col("_label").isNotNull(), 1.0).otherwise(SOFT)).withColumn("_good", F.col("_n") * F.coalesce(F.col("_label").cast("double"), soft))
    scored = written(scored)

    paths = scored.groupBy("_host", "_path").agg(F.sum("_n").alias("n"), F.sum("_good").alias("good"))
    paths = written(paths)
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = hosts.agg((F.sum("good") + 1) / (F.sum("n") + 2)).first()[0]
    if total is None:
        total = 0.5
    of_host = hosts.agg(strength(hosts, F.lit(total))).first()[0] or STRONGEST
    hosts = hosts.select("_host", F.col("n").alias("host_n"), F.col("good").alias("host_good"))
    sites = paths.join(hosts, "_host")
    host_rate = (F.col("host_good") + of_host * total) / (F.col("host_n") + of_host)
    sites = sites.withColumn("_host_rate", host_rate)
    of_path = sites.agg(strength(sites, F.col("_host_rate"))).first()[0] or STRONGEST

    # without the document's own label
    out = join_sized(scored, sites.select("_host", "_path", "n", "good", "host_n", "host_good"), ["_host", "_path"], "left")
    n, good = F.when(F.col("_label").isNotNull(), F.col("_n")).otherwise(0.0), F.when(F.col("_label").isNotNull(), F.col("_good")).otherwise(0.0)
    out = out.withColumn("host_rate", (F.col("host_good") - good + of_host * total) / (F.col("host_n") - n + of_host))
    out = out.withColumn("path_rate", (F.col("good") - good + of_path * F.col("host_rate")) / (F.col("n") - n + of_path))
    rate = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("path_rate")))
    out = out.withColumn("score", 1 / (1 + F.exp(-(F.log(rate / (1 - rate)) + F.col("evidence")))))
    predicted = (F.col("score") >= 0.5).cast("int")
    return out.select(F.col("_key").alias(key), "score", predicted.alias("predicted"), "evidence", "host_rate", "path_rate")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources stand for hosts, a source's languages for its paths."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))
