"""Robust multivariate outliers: minimum covariance determinant estimates for each language and source.

All of it is DataFrame expressions. Five statistics of each text are transformed to a vector; for each group the
C-steps of the minimum covariance determinant run as aggregations: means and covariances of the current half, a
Cholesky factor as column expressions, Mahalanobis distances, and the next half by a histogram of distances. A text
goes where its squared distance, scaled down so that the group's median doesn't exceed the chi-squared median, is beyond CUTOFF.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

WORD_BREAK = r"[\x20\x09-\x0D]+"
#: Steps, and rows that a group needs for estimates of its own.
STEPS, LEAST_ROWS = 4, 200
#: Squared distance beyond which a text goes: the chi-squared quantile of 5 degrees of freedom at 1 - 1e-9.
CUTOFF = 51.5
MEDIAN = 4.351
#: Added to the variances: the spread below which a statistic isn't told apart.
FLOORS = (0.1, 0.05, 0.3, 0.1, 0.1)
FINE = 16  # histogram bins for each doubling of a squared distance
X = [f"x{i}" for i in range(5)]
PAIRS = [(i, j) for i in range(5) for j in range(i + 1)]


def text_statistics(docs: DataFrame) -> DataFrame:
    """`docs` (text, ...) without text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (longs).

    A null text has none of anything. Words are runs of anything but \\x20 and \\x09-\\x0D; n_dup_lines counts
    \\n-cut lines with a word that equal an earlier one; n_repeat_words counts the words in 3-word windows that the
    text has twice or more.
    """
    rest = [c for c in docs.columns if c != "text"]
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(
        *rest,
        F.array_remove(F.split(text, WORD_BREAK), "").alias("_w"),
        F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("_l"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
    )
    grams = own.select(
        *rest,
        "n_symbols",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        # windows as hashes of their words' hashes
        F.when(F.size("_w") >= 3, F.expr("transform(_w, x -> xxhash64(x))")).otherwise(F.array().cast("array<long>")).alias("_h"),
    )
    windows = F.expr("zip_with(zip_with(_h, slice(_h, 2, greatest(size(_h) - 1, 0)), (x, y) -> xxhash64(x, y)), slice(_h, 3, greatest(size(_h) - 2, 0)), (x, y) -> if(y is null, null, xxhash64(x, y)))")
    grams = grams.withColumn("_g", windows)
    grams = grams.withColumn("_g", F.expr("slice(_g, 1, greatest(size(_g) - 2, 0))"))
    twice = grams.withColumn("_some", F.size(F.array_distinct("_g")) < F.size("_g"))
    ordered = twice.withColumn("_s", F.when(F.col("_some"), F.expr("sort_array(transform(_g, (h, i) -> struct(h, i)))")))
    # a window stands again if it equals a neighbour in sorted order
    again = F.expr("sort_array(transform(filter(_s, (x, k) -> (k > 0 and x.h = get(_s, k - 1).h) or (k + 1 < size(_s) and x.h = get(_s, k + 1).h)), x -> x.i))")
    covered = F.expr("aggregate(_p, struct(0L as n, -3 as last), (a, p) -> struct(a.n + least(3, p - a.last) as n, p as last)).n")
    return ordered.withColumn("_p", again).select(*rest, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.when(F.col("_some"), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"))


def _vector() -> list[Column]:
    """The statistics, transformed: logs of sizes and rates, and square roots of shares."""
    words, chars = F.col("n_words"), F.col("word_chars")
    columns = [F.log1p(words), F.log((chars + 1) / (words + 1)), F.log((F.col("n_symbols") + 1) / (chars + 20)), F.sqrt(F.col("n_dup_lines") / (words + 1)), F.sqrt(F.col("n_repeat_words") / (words + 1))]
    return [c.cast("double").alias(x) for c, x in zip(columns, X, strict=True)]


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Means m0 .. and the Cholesky factor l00, l10 .. of the (floored) covariance, by group, and its log determinant."""
    own = rows.groupBy(*keys).agg(F.count("*").alias("n"), *(F.avg(x).alias(f"m{i}") for i, x in enumerate(X)), *(F.avg(F.col(X[i]) * F.col(X[j])).alias(f"p{i}{j}") for i, j in PAIRS))
    for i, j in PAIRS:
        cov = F.col(f"p{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")
        cov = F.greatest(cov, F.lit(0.0)) + FLOORS[i] ** 2 if i == j else cov
        left = cov - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        own = own.withColumn(f"l{i}{j}", F.sqrt(F.greatest(left, F.lit(FLOORS[i] ** 2 / 4))) if i == j else left / F.col(f"l{j}{j}"))
    det = sum((F.log(f"l{i}{i}") for i in range(5)), F.lit(0.0))
    return own.select(*keys, *(f"m{i}" for i in range(5)), *(f"l{i}{j}" for i, j in PAIRS), det.alias("det"))


def _distances(rows: DataFrame, estimates: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` with d2, the squared Mahalanobis distance by their group's estimates."""
    out, z = rows.join(estimates, keys), []
    for i in range(5):
        out = out.withColumn(f"z{i}", (F.col(X[i]) - F.col(f"m{i}") - sum((F.col(f"l{i}{j}") * F.col(f"z{j}") for j in range(i)), F.lit(0.0))) / F.col(f"l{i}{i}"))
        z.append(F.col(f"z{i}") * F.col(f"z{i}"))
    return out.select(*rows.columns, "det", sum(z, F.lit(0.0)).alias("d2"))


def _bin() -> Column:
    return F.floor(FINE * F.log2(F.col("d2") + 1e-6)).cast("long")


def _half(n: Column) -> Column:
    """Rows of a group of n that the covariance is estimated on: as few as five dimensions allow, so that almost half of a group may be junk."""
    return F.floor((n + len(X) + 1) / 2)


def _edges(rows: DataFrame, keys: list[str], rank: Callable[[Column], Column]) -> DataFrame:
    """(keys, edge): the histogram bin of d2 that holds the row of that rank in each group, told from the group's rows (all of them, if fewer). Counts meet by (group, bin), a few hundred to a group."""
    from pyspark.sql import Window

    bins = rows.groupBy(*keys, _bin().alias("bin")).agg(F.count("*").alias("n"))
    upto, whole = Window.partitionBy(*keys).orderBy("bin"), Window.partitionBy(*keys)
    running = bins.select(*keys, "bin", F.sum("n").over(upto).alias("upto"), F.sum("n").over(whole).alias("all"))
    return running.filter(F.col("upto") >= F.least(rank(F.col("all")), F.col("all"))).groupBy(*keys).agg(F.min("bin").alias("edge"))


def outliers(stats: DataFrame, groups: list[str], steps: int = STEPS) -> DataFrame:
    """`stats` (the five statistics, the group columns, ...) with distance2, its scaled squared distance.

    Groups with fewer than LEAST_ROWS rows share the estimates of all rows together, and a null group value is a
    value. Two starts run side by side, the classical estimates and ones scaled by each statistic's own spread
    around the group's trimmed centre; the smaller determinant is taken. Rows without words are judged as the rest.
    """
    rest = stats.columns
    sized = stats.groupBy(*groups).agg(F.count("*").alias("_n"))
    label = F.to_json(F.struct(*groups), {"ignoreNullFields": "false"})
    named = sized.select(label.alias("_label"), F.when(F.col("_n") >= LEAST_ROWS, label).otherwise(F.lit("all")).alias("_group"))
    vectors = stats.select("*", label.alias("_label"), *_vector()).join(named, "_label").drop("_label")
    vectors = written(vectors, "vectors")
    trained = vectors.select(F.explode(F.array_distinct(F.array("_group", F.lit("all")))).alias("g"), *X)
    trained = trained.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("start"))
    keys = ["g", "start"]
    # the second start leaves out what is far from the centre in any one statistic
    centre = trained.groupBy(*keys).agg(*(F.avg(x).alias(f"c{x}") for x in X), *(F.stddev_pop(x).alias(f"d{x}") for x in X))
    centre = written(centre, "centre")
    near = trained.join(F.broadcast(centre) if _few(centre) else centre, keys).filter((F.col("start") == 0) | F.forall(F.array(*(F.abs(F.col(x) - F.col(f"c{x}")) <= F.greatest(F.col(f"d{x}"), F.lit(1e-9)) for x in X)), lambda v: v))
    estimates = written(_moments(near.select(*keys, *X), keys), "estimates")
    for _ in range(steps):
        far = _distances(trained, F.broadcast(estimates) if _few(estimates) else estimates, keys)
        edges = written(_edges(far, keys, _half), "edges")
        kept = far.join(F.broadcast(edges) if _few(edges) else edges, keys).filter(_bin() <= F.col("edge"))
        estimates = written(_moments(kept, keys), "estimates")
    best = estimates.groupBy("g").agg(F.min(F.struct("det", "start")).alias("b")).select("g", F.col("b.start").alias("start"))
    chosen = written(estimates.join(best, ["g", "start"]).drop("start").withColumnRenamed("g", "_group"), "chosen")
    far = _distances(vectors, F.broadcast(chosen) if _few(chosen) else chosen, ["_group"])
    middle = written(_edges(far, ["_group"], lambda n: F.ceil(n / 2)).select("_group", F.pow(2.0, (F.col("edge") + 0.5) / FINE).alias("middle")), "middle")
    scaled = far.join(F.broadcast(middle) if _few(middle) else middle, "_group")
    return scaled.select(*rest, (F.col("d2") * MEDIAN / F.greatest("middle", F.lit(MEDIAN))).alias("distance2"))


def _few(table: DataFrame, bound: int = 50_000) -> bool:
    """Whether a written table of group estimates (some 200 bytes a row) may be broadcast: 10 MB at most."""
    return table.limit(bound + 1).count() <= bound


def judge(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """`docs` (doc_id, text, lang, source, ...) judged: doc_id, n_words, the four statistics, distance2, base_failed, kept.

    One row for each input row. base_failed: fewer than 50 words, or more than half of them in repeated windows;
    kept: not base_failed, and distance2 within the cutoff. The estimates come from the rows that pass the base rules.
    """
    stats = text_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", "text"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = written(stats.withColumn("base_failed", failed), "statistics")
    fine = outliers(stats.filter("not base_failed"), ["lang", "source"])
    both = fine.unionByName(stats.filter("base_failed").withColumn("distance2", F.lit(None).cast("double")))
    return both.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "distance2", "base_failed", (~F.col("base_failed") & (F.col("distance2") <= cutoff)).alias("kept"))


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
