"""URL filters: rules first, gradient-boosted trees on lexical features for the rest.

The trees are trained from labelled URLs: those that a block rule or a listed host term decides are labelled block,
all others allow. Features are length, depth, ratios, entropy, parameter counts and statistics of the host's suffix
over the whole table; the trees are compiled into one column expression.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import boost, logistic, tree_column
from .scratch import written

#: (verdict, host and path). A rule fits its host and all subdomains, if the path starts with the rule's; the longest wins.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
#: Parts of host names that label a URL for training.
TERMS = ["adult", "casino", "porn", "xxx"]
#: URLs that the trees are fitted on: beyond this number a hash of the URL draws about so many.
TRAIN_ROWS = 20_000
TREES, DEPTH, THRESHOLD = 40, 4, 0.5
LEXICAL = ["length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digits", "hyphens", "entropy", "host_entropy", "parameters", "query_length", "fragment", "secure", "last_number"]
SUFFIX = ["suffix_count", "suffix_block_share", "domain_count", "domain_block_share"]


def host(url: Column) -> Column:
    found = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    which, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        of, _, begins = text.partition("/")
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(f"/{begins}")
        which, verdict = F.when(fits, F.lit(text)).otherwise(which), F.when(fits, F.lit(says)).otherwise(verdict)
    return which, verdict


def _entropy(text: str) -> float:
    if not text:
        return 0.0
    _, n = np.unique(np.frombuffer(text.encode(), dtype=np.uint8), return_counts=True)
    p = n / n.sum()
    return float(-(p * np.log2(p)).sum())


def lexical(pages: DataFrame) -> DataFrame:
    """`pages` (url, host, path, ...) with the LEXICAL features as doubles."""

    def of(url: str, host: str, path: str) -> list[float]:
        query, fragment = url.partition("?")[2].partition("#")[0], url.partition("#")[2]
        digits = sum(c.isdigit() for c in url)
        last = path.rstrip("/").rpartition("/")[2]
        number = "".join(c for c in last if c.isdigit())
        return [len(url), len(host), len(path), path.count("/"), host.count(".") + 1, digits / max(1, len(url)), sum(c.isdigit() for c in host), url.count("-"), _entropy(url), _entropy(host), query.count("&") + 1 if query else 0, len(query), len(fragment), url.startswith("https"), len(number)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [of(u or "", h, p) for u, h, p in zip(frame["url"], frame["host"], frame["path"], strict=True)]
            yield pd.concat([frame.reset_index(drop=True), pd.DataFrame(got, columns=LEXICAL, dtype=float)], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    return pages.mapInPandas(run, f"{schema}, " + ", ".join(f"{f} double" for f in LEXICAL))


def _with_statistics(urls: DataFrame) -> DataFrame:
    """`urls` with the SUFFIX features: log count and (smoothed) block share of its suffix and domain over all other hosts, so that no label of a host reaches its own rows.

    Counts are combined by host first and joined to the hosts, so that a common suffix meets one row for each host.
    """
    hosts = written(urls.groupBy("host", "domain", "suffix").agg(F.count("*").alias("n"), F.sum("labelled").alias("b")), "hosts")
    out = hosts
    for by in ("suffix", "domain"):
        whole = hosts.groupBy(by).agg(F.sum("n").alias(f"{by}_n"), F.sum("b").alias(f"{by}_b"))
        out = out.join(whole, by)
        out = out.withColumn(f"{by}_count", F.log1p(F.col(f"{by}_n") - F.col("n"))).withColumn(f"{by}_block_share", (F.col(f"{by}_b") - F.col("b") + 1) / (F.col(f"{by}_n") - F.col("n") + 2))
    return urls.join(out.select("host", *SUFFIX), "host")


def held_out(host: Column) -> Column:
    """A fifth of the hosts, none of whose URLs the trees are trained on."""
    return F.pmod(F.xxhash64(F.lit("held"), host), F.lit(5)) == 0


def held_out_quality(scored: DataFrame) -> DataFrame:
    """(blocks, found, blocked) of filter_urls()'s rows on held-out hosts without a rule: those labelled block, those among them that the trees block, and all that the trees block."""
    own = scored.filter(held_out(F.col("host")) & F.col("rule").isNull()).select(_listed().alias("label"), (F.col("score") >= THRESHOLD).alias("blocked"))
    return own.agg(F.count_if("label").alias("blocks"), F.count_if(F.col("label") & F.col("blocked")).alias("found"), F.count_if("blocked").alias("blocked"))


def _listed() -> Column:
    return F.exists(F.array(*map(F.lit, TERMS)), lambda t: F.contains(F.col("host"), t))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, rows: int = TRAIN_ROWS) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of pages (page_id, url, ...), one row for each input row.

    score is the trees' block probability; a fifth of the hosts (held_out) teach nothing. The verdict is the rule's, else block from THRESHOLD on. A null URL or one without `://` has an empty
    host and path; the trees judge it as any other. Without any URL labelled block all scores are 0. Other columns aren't read.
    """
    named = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    which, verdict = rule(F.col("host"), F.col("path"), rules)
    listed = _listed()
    urls = named.select("*", which.alias("rule"), verdict.alias("says"), F.substring_index("host", ".", -1).alias("suffix"), F.substring_index("host", ".", -2).alias("domain"))
    urls = written(lexical(urls.withColumn("labelled", (F.coalesce(F.col("says") == "block", F.lit(False)) | (F.col("says").isNull() & listed)).cast("int"))), "urls")
    full = _with_statistics(urls)
    taught = full.filter(~held_out(F.col("host")))
    n = taught.count()
    sample = taught if n <= rows else taught.filter(F.pmod(F.xxhash64(F.lit("urls"), "url", "page_id"), F.lit(1 << 30)) < int(rows / n * (1 << 30)))
    names = LEXICAL + SUFFIX
    got = sample.orderBy("url", "page_id").select(*names, "labelled").toPandas().to_numpy(dtype=float)
    score = F.lit(0.0)
    if len(got) and got[:, -1].any():
        bias, trees = boost(got[:, :-1], got[:, -1], TREES, DEPTH)
        score = logistic(sum((tree_column(t, names) for t in trees), F.lit(bias)))
    scored = full.select("page_id", "host", "path", "rule", "says", score.alias("score"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("says", F.when(F.col("score") >= THRESHOLD, "block").otherwise("allow")).alias("verdict"), "score")


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("long"), "url"))
