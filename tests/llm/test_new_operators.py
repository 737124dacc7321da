"""Hard negatives, substring dedup and whitening against brute force, with nulls, ties, repeats, long and empty input."""

import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from attestry.llm import hardneg, substring, whitening

VECTORS = "vec_id long, embedding array<float>, label int, extra string"


def table(spark, tmp_path, rows, schema, name):
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def embeddings():
    rng = random.Random(3)
    rows = [(i, [round(rng.uniform(-1, 1), 2) for _ in range(8)], rng.randint(0, 3), "x") for i in range(400)]
    for i in range(0, 400, 9):
        rows[i] = (i, rows[(i * 7 + 50) % 400][1], rows[i][2], "tie")
    rows += [rows[50], rows[51], (500, None, 1, None), (501, [1.0] * 8, None, None), (502, [1.0, None] + [0.0] * 6, 1, None), (503, [math.nan] + [0.0] * 7, 1, None), (504, [math.inf] + [0.0] * 7, 1, None), (None, [1.0] * 8, 1, None), (550, [0.0] * 8, 2, None)]
    return rows


def mined(rows):
    seen = {}
    for i, v, label, _ in rows:
        if i is not None and label is not None and v is not None and all(c is not None and math.isfinite(c) for c in v):
            seen[i] = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(c))) for c in v])
    out = set()
    for a in (i for i in seen if i % 50 == 0):
        scored = sorted(((-sum(x * y for x, y in zip(seen[a][1], v, strict=True)), i, label) for i, (label, v) in seen.items() if i != a))
        for p, positive, _ in [s for s in scored if s[2] == seen[a][0]][:5]:
            fits = [s for s in scored if s[2] != seen[a][0] and 50 * -p <= 100 * -s[0] <= 95 * -p]
            out |= {(a, positive, rank, i, -p, -s) for rank, (s, i, _) in enumerate(fits[:3], 1)}
    return out


def test_hard_negatives(spark, tmp_path):
    rows = embeddings()
    got = hardneg.op11_hard_negatives(spark, table(spark, tmp_path, rows, VECTORS, "embeddings"))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert [tuple(r) for r in got.collect()] and {tuple(r) for r in got.collect()} == mined(rows) and got.count() == len(mined(rows))


def test_hard_negatives_in_small_blocks(spark):
    rng = random.Random(4)
    rows = [(i, rng.randint(0, 1), [rng.randint(-9, 9) for _ in range(rng.choice((3, 4)))]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, label long, vector array<long>")
    one = hardneg.mine(df, F.col("vec_id") % 5 == 0)
    many = hardneg.mine(df, F.col("vec_id") % 5 == 0, block_bytes=4 * 8 * 6)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect())) != []
    huge = spark.createDataFrame([(0, 0, [2**30, 1]), (1, 0, [2**29, 3]), (2, 1, [2**28, 5]), (3, 1, [2**30, 5])], "vec_id long, label long, vector array<long>")
    assert [tuple(r) for r in hardneg.mine(huge, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2, 2**59 + 3, 2**58 + 5)]  # beyond 2^53, exact
    assert hardneg.mine(df.limit(0), F.lit(True)).collect() == []


def whitened_by_hand(x):
    v = np.cov(x.T, bias=True)
    e, q = np.linalg.eigh(v)
    order = np.argsort(-e)
    return (x - x.mean(axis=0)) @ q[:, order] / np.sqrt(e[order]), e[order] / np.trace(v)


def test_whitening(spark, tmp_path):
    rows = embeddings()
    got = whitening.op13_whitening(spark, table(spark, tmp_path, rows, VECTORS, "embeddings")).toPandas()
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v, _, _ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)])
    n = len(x)
    assert len(got) == 8 * n and (got["n"] == n).all() and got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9
    w, explained = whitened_by_hand(x.astype(float))
    mine = got[got["vec_id"].notna()].drop_duplicates(["vec_id", "component"]).pivot(index="vec_id", columns="component", values="whitened")
    ids = [i for i, v, _, _ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    for k in range(8):
        one, two = np.array([w[r, k] for r, i in enumerate(ids) if i is not None]), np.array([mine.loc[i, k + 1] for i in ids if i is not None])
        assert min(np.abs(one - two).max(), np.abs(one + two).max()) < 1e-8
        assert abs(got[got["component"] == k + 1]["explained"].iloc[0] - explained[k]) < 1e-12
    sums = x.sum(axis=0)
    exact = {i: sum((n * int(c) - int(s)) ** 2 for c, s in zip(x[r], sums, strict=True)) for r, i in enumerate(ids)}
    assert all(exact[i] == d for i, d in zip(got["vec_id"], got["deviation"], strict=True) if i == i)


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, x array<long>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [5, 5]), (2, [5, 5])], schema)).collect() == []  # no spread at all
    flat = whitening.whiten(spark.createDataFrame([(i, [i, 7, 2 * i]) for i in range(50)] + [(99, [1])], schema)).toPandas()
    assert set(flat["component"]) == {1} and len(flat) == 50 and abs(flat["explained"][0] - 1) < 1e-12  # one direction holds all
    far = [(i, [10**12 * i, 3 * i * i]) for i in range(9)]
    wide = whitening.whiten(spark.createDataFrame(far, schema).repartition(9)).toPandas()
    assert wide["deviation"].isna().any() and wide["identity_error"][0] < 1e-6  # beyond a long: null
    tiny = np.array([[10**9 + i % 2, 10**7 * i] for i in range(64)])
    small = whitening.whiten(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(tiny)], schema).repartition(7)).toPandas()
    assert set(small["component"]) == {1, 2} and small["identity_error"][0] < 1e-4


def removed(docs, window=20):
    """By hand: (doc_id, text) -> (n_words, n_removed, digest of the rest)."""
    words = [(i, (t or "").encode().split()) for i, t in docs]
    first = {}
    for i, w in words:
        if i is not None:
            for s in range(len(w) - window + 1):
                key = b" ".join(w[s : s + window])
                first[key] = min(first.get(key, (i, s)), (i, s))
    out = []
    for i, w in words:
        gone = set()
        if i is not None:
            for s in range(len(w) - window + 1):
                if first[b" ".join(w[s : s + window])] < (i, s):
                    gone |= set(range(s, s + window))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out, key=repr)


def texts():
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdé", k=rng.randint(1, 4)))
    passages = [" ".join(word() for _ in range(rng.choice((19, 20, 21, 45)))) for _ in range(6)]
    docs = []
    for i in range(80):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(3)]
        docs.append((i, rng.choice(passages).join(parts) if i % 3 else " \n".join([parts[0], rng.choice(passages), parts[1], rng.choice(passages)])))
    docs += [(200 + i, docs[i][1]) for i in range(0, 60, 4)] + [(5, docs[30][1]), docs[7], docs[8], (300, None), (301, ""), (302, " \t\n"), (None, docs[9][1]), (303, "x " * 70), (304, "x y " * 25), (-4, docs[11][1])]
    return [*docs, (305, " ".join(word() for _ in range(9000)) + " " + passages[0]), (306, "w" * 30_000)]


def test_substring_dedup(spark, tmp_path):
    docs = texts()
    got = substring.op12_substring_dedup(spark, table(spark, tmp_path, [(i, t, "en") for i, t in docs], "doc_id long, text string, lang string", "documents"))
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == removed(docs)


def test_substring_dedup_at_other_lengths(spark):
    docs = texts()
    df = spark.createDataFrame([(i, t, 1, "y") for i, t in docs], "doc_id long, text string, n_words int, kept string")
    for window in (5, 37):
        got = substring.dedup_substrings(df, window)
        assert got.columns == ["doc_id", "text", "kept", "n_words", "n_removed"]
        assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in got.collect()), key=repr) == removed(docs, window)
    assert substring.dedup_substrings(df.limit(0)).collect() == []
    assert substring.levels(20) == [10, 20] and substring.levels(50) == [13, 25, 50] and substring.levels(5) == [5]
    few = substring.dedup_substrings(df.filter("doc_id in (1, 2, 301)"), 400).collect()  # nothing repeats: the first level ends it
    assert {r["n_removed"] for r in few} == {0}


def test_substring_dedup_of_runs(spark):
    """Windows that overlap their own repeat: one word, or a few, over and over, from every place on."""
    docs = [(i, " ".join(f"d{i}w{k}" for k in range(i % 40)) + f" r{i}" * (21 + i % 7)) for i in range(80)]
    docs += [(100 + i, " ".join(f"d{i}v{k}" for k in range(i)) + "".join(f" p{i}q{k % (2 + i % 9)}" for k in range(33))) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    for window in (20, 50):  # the least short window of 50 words stands at one of 38 places
        rows = df.withColumn("text", F.concat_ws(" ", "text", "text")) if window == 50 else df
        got = substring.dedup_substrings(rows, window).collect()
        wanted = removed([(r["doc_id"], r["text"]) for r in rows.collect()], window)
        assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in got), key=repr) == wanted
        assert any(n for _, _, n, _ in wanted)
