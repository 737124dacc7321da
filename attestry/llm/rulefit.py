"""Quality classifier: a sparse rule ensemble.

Statistics of each whole text are columns. Boosted trees on a bounded labelled sample give paths, each path is a
conjunctive rule over the statistics, a lasso logistic model weighs the rules, and those that keep a weight are
compiled into one Spark column expression that scores every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .boosting import Rule, applies, boost, lasso, logistic, rule_column, rules
from .langid import held_out
from .scratch import written

#: Labelled rows that the model is fitted on: beyond this number a hash of doc_id draws about so many.
TRAIN_ROWS = 20_000
TREES, PENALTY = 25, 0.0005
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "stop": b".,;:?",
    "shout": b"!",
    "symbol": b"#*$%&|<>",
    "bracket": b"()[]{}\"'/\\=+_~^`@-",
    "line": b"\n",
}
STATISTICS = ["log_words", "word_length", *(f"{k}_share" for k in _CLASSES), "beyond_ascii", "long_words", "distinct_words", "repeated_windows", "repeated_lines", "mean_line"]


def text_features(docs: DataFrame) -> DataFrame:
    """(doc_id, STATISTICS as doubles) of the whole texts of `docs` (doc_id, text). A null or empty text has 0 in each."""
    table = np.zeros(256, dtype=np.int64)
    for k, chars in enumerate(_CLASSES.values()):
        table[list(chars)] = k + 1
    table[128:] = len(_CLASSES) + 1
    kinds = len(_CLASSES) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.utf8(batch.column(1))
            for lo, hi in K.slices(offsets):
                own, rows = offsets[lo : hi + 1], hi - lo
                size = np.diff(own).astype(float)
                h, starts, ends, bounds = K.words(data, own, lower=True)
                n = np.diff(bounds).astype(float)
                row = np.repeat(np.arange(rows), np.diff(own))
                kind = np.bincount(row * kinds + table[data[own[0] : own[-1]]], minlength=rows * kinds).reshape(rows, kinds)
                grams, at = K.ngrams(h, bounds, 3)
                gram_bounds = np.searchsorted(at, bounds)
                lines, line_bounds = _lines(data, own)
                distinct = lambda v, b: np.array([len(np.unique(v[x:y])) for x, y in zip(b[:-1], b[1:], strict=True)], dtype=float)
                per = lambda a, b: a / np.maximum(b, 1)
                n_grams, n_lines = np.diff(gram_bounds).astype(float), np.diff(line_bounds).astype(float)
                chars = K.row_sums(ends - starts, bounds) if len(h) else np.zeros(rows)
                long = K.row_sums((ends - starts > 12).astype(np.int64), bounds) if len(h) else np.zeros(rows)
                columns = [np.log1p(n), per(chars, n), *(per(kind[:, k + 1], size) for k in range(kinds - 1)), per(long, n), per(distinct(h, bounds), n), per(n_grams - distinct(grams, gram_bounds), n_grams), per(n_lines - distinct(lines, line_bounds), n_lines), np.log1p(per(n, n_lines))]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], *(pa.array(np.asarray(c, dtype=float)) for c in columns)], names=["doc_id", *STATISTICS])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(K.task(run), "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the \\n-cut lines that hold anything, and row bounds."""
    breaks = np.zeros(256, dtype=bool)
    breaks[10] = True
    h, _, _, bounds = K.words(data, offsets, apart=breaks)
    return h, bounds


@dataclass(frozen=True)
class RuleModel:
    bias: float
    weighted: list[tuple[Rule, float]]

    def score(self) -> Column:
        """Between 0 and 1, over the columns STATISTICS."""
        margin = F.lit(self.bias)
        for rule, weight in self.weighted:
            margin = margin + F.when(rule_column(rule, STATISTICS), F.lit(weight)).otherwise(F.lit(0.0))
        return logistic(margin)


def fit(stats: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> RuleModel:
    """The model of `labels` (doc_id, quality) on `stats` (text_features). Without any label it scores 0.5 throughout."""
    labelled = stats.join(labels.filter("quality IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("_y")), "doc_id")
    n = labels.filter("quality IS NOT NULL").count()
    if n > rows:
        labelled = labelled.filter(F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 30)) < int(rows / n * (1 << 30)))
    got = labelled.orderBy("doc_id", "_y").select(*STATISTICS, "_y").toPandas().to_numpy(dtype=float)
    x, y = got[:, :-1], (got[:, -1] > 0).astype(float)
    if not len(y):
        return RuleModel(0.0, [])
    _, trees = boost(x, y, TREES)
    found = rules(trees)
    if not found:
        share = (y.sum() + 0.5) / (len(y) + 1)
        return RuleModel(float(np.log(share / (1 - share))), [])
    bias, weights = lasso(np.stack([applies(r, x) for r in found], axis=1).astype(float), y, PENALTY)
    return RuleModel(bias, [(r, float(w)) for r, w in zip(found, weights, strict=True) if abs(w) > 1e-6])


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    stats = written(text_features(spark.read.parquet(f"{sf_dir}/documents.parquet")), "statistics")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out(F.col("doc_id")))
    scored = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), fit(stats, labels).score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
