"""An index of trigrams gives what a scan gives, and reads less."""

import random

from pyspark.sql import functions as F

from attestry.operators import search as S
from attestry.operators.views import search_facts


def test_index_equals_scan(spark, tmp_path):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklmnoprstuéÉ $%", k=rng.randint(2, 9)))
    columns = ["metric", "entity", "raw_value", "statement", "evidence", "period"]
    rows = [(f"f{i}", *(" ".join(word() for _ in range(rng.randint(0, 5))) if rng.random() < 0.9 else None for _ in columns)) for i in range(600)]
    facts = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ["fact_id", *columns])).cache()
    path = str(tmp_path / "index")
    S.write_index(facts, "fact_id", columns, path)
    low = {r[0]: [(x or "").lower() for x in r[1:]] for r in rows}
    texts = [x for r in rows for x in r[1:] if x]
    queries = [t[at : at + rng.randint(3, 8)].upper() for t in rng.choices([t for t in texts if len(t) > 9], k=96) for at in [rng.randrange(len(t) - 8)]] + ["a", "", "zzz", "é "]
    whole = spark.read.parquet(path).count()
    parts, reads = [], []
    for n, q in enumerate(queries):
        parts.append(S.search(facts, "fact_id", columns, path, q).select(F.lit(n).alias("n"), "fact_id"))
    got = {n: set() for n in range(len(queries))}
    for lo in range(0, len(parts), 20):
        batch = parts[lo]
        for p in parts[lo + 1 : lo + 20]:
            batch = batch.unionByName(p)
        for r in batch.collect():
            got[r["n"]].add(r["fact_id"])
    for n, q in enumerate(queries):
        assert got[n] == {i for i, xs in low.items() if not q.strip() or any(q.lower() in x for x in xs)}, q
    for q in ("xyz", "abcd", queries[3]):
        grams = {q.lower()[i : i + 3] for i in range(len(q) - 2)}
        reads.append(spark.read.parquet(path).filter(F.col("bucket").isin([r[0] for r in spark.createDataFrame([(g,) for g in grams], "g string").select(S._bucket(F.col("g"))).collect()])).filter(F.col("trigram").isin(list(grams))).count())
    assert max(reads) < whole / 10
    one = queries[0]
    assert {r["fact_id"] for r in search_facts(facts.withColumn("doc_id", F.lit("d")).withColumn("category", F.lit("c")), query=one).collect()} == got[0]
