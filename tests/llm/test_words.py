"""Words that a hash could take for each other, long texts, and the pipeline's stages on a small table."""

import random

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attestry.llm import kernels as K
from attestry.llm import linededup, neardup, sampling, tokencount


def alternating(n):
    """The first 2 ** n letters of a sequence whose halves are each other's complements, and its complement."""
    word = "a"
    for _ in range(n):
        word += word.translate({97: "b", 98: "a"})
    return word, word.translate({97: "b", 98: "a"})


def test_complements_are_told_apart(spark):
    pairs = [alternating(n) for n in (10, 12)]
    texts = [w for pair in pairs for w in pair] + [f"{one} x {two}" for one, two in pairs]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    counts = {r["doc_id"]: r["n_tokens"] for r in tokencount.count_tokens(docs).collect()}
    assert counts == {i: len(own.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert all(r["text"] == r["decoded"] for r in sampling.encode_and_decode(docs, F.col("doc_id")).collect())
    assert all(r["kept"] for r in neardup.near_duplicates(docs).collect())


def test_equal_hashes_are_told_apart():
    data, rows = K.utf8(pa.array(["Foo bar foo", "é" * 9 + " bar", "bax 12345678x 12345678y"]))
    h, starts, ends, _ = K.words(data, rows, lower=True)
    words = [data[i:j].tobytes().lower() for i, j in zip(starts, ends, strict=True)]
    for hashes in (h, np.zeros_like(h)):
        at, back, second = K.distinct(hashes, data, starts, ends, lower=True)
        assert [words[at[k]] for k in back] == words and len(at) == len(set(words)) == len(set(second.tolist()))
    memo = K.Memo()
    made = memo.get(np.array([1, 1], dtype=np.uint64), np.array([2, 3], dtype=np.uint64), lambda new: new * 10)
    assert made.tolist() == [0, 10]
    assert memo.get(np.array([1, 1], dtype=np.uint64), np.array([3, 2], dtype=np.uint64), lambda new: np.array([7] * len(new))).tolist() == [7, 0]


def test_long_text_in_parts(spark):
    rng = random.Random(5)
    text = " ".join("".join(rng.choices("abcdefgh ", k=rng.randint(1, 12))) for _ in range(60_000)) + " \n"
    assert len(text) > sampling.SLICE
    docs = spark.createDataFrame([(1, text), (2, text[:1000])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in sampling.encode_and_decode(docs, F.lit(9)).collect()}
    assert got[1]["decoded"] == text and got[2]["decoded"] == text[:1000]
    same = next(i for i, (a, b) in enumerate(zip(got[1]["ids"], got[2]["ids"], strict=False)) if a != b) if got[1]["ids"][: len(got[2]["ids"])] != got[2]["ids"] else len(got[2]["ids"])
    assert same > 0.95 * len(got[2]["ids"])  # a part begins as the whole does, but for its last word


def test_lines_of_few_shingles_and_shared_ids(spark):
    own = "a line of its own that nobody repeats at all"
    rows = [(1, "-" * 60 + "\nfirst"), (2, "-" * 200), (3, "ha " * 15), (4, "ha " * 60), (5, "one\ntwo lines that repeat, word for word, below"), (5, f"x\n{own}"), (6, "two lines that repeat, word for word, below"), (6, "two lines that repeat, word for word, below"), (6, "what stands here is found in no other text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"], r["n_removed"]) for r in linededup.dedup_lines(docs).collect())
    want = [(1, rows[0][1], 0), (2, "", 1), (3, rows[2][1], 0), (4, "", 1), (5, rows[4][1], 0), (5, rows[5][1], 0), (6, "", 1), (6, "", 1), (6, rows[8][1], 0)]
    assert got == sorted(want)


def test_pipeline(spark, tmp_path):
    rng = random.Random(6)
    vocabulary = {k: ["".join(rng.choices(letters, k=rng.randint(3, 8))) for _ in range(300)] for k, letters in (("xx", "aeiklmn"), ("yy", "oprstuz"))}
    prose = lambda k, n: " ".join(rng.choices(vocabulary[k], k=n))
    item = prose("xx", 30)
    rows = [(i, prose("xx" if i % 2 else "yy", 60), "xx" if i % 2 else "yy", "s", None) for i in range(60)]
    rows += [(100, rows[3][1], "xx", "s", 1), (101, f"{prose('xx', 40)} {item} {prose('xx', 40)}", "xx", "s", 1), (102, "123 456", "xx", "s", 1), (103, None, None, None, None), (104, f"{prose('yy', 50)}\n{rows[4][1]}", "yy", "s", 1), (None, prose("xx", 50), None, "s", 1)]
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, path), "stage")
        assert docs.columns == corpus_pipeline.COLUMNS
        left[name] = {r["doc_id"] for r in docs.collect()}
        assert stage(spark, docs.filter("false"), path).count() == 0
    every = {r[0] for r in rows}
    assert left["language ID"] == every - {102, 103}
    assert left["line dedup"] == every - {100, 102, 103}  # its only line repeats that of document 3
    assert left["MinHash near-dedup"] == left["line dedup"] and left["benchmark decontamination"] == left["line dedup"] - {101}
    out = corpus_pipeline.run(spark, path).collect()
    assert {r["doc_id"] for r in out} == left["benchmark decontamination"] and all(r["lossless"] and r["n_pieces"] == len(r["ids"]) for r in out)
    assert next(r["text"] for r in docs.collect() if r["doc_id"] == 104) == rows[64][1].split("\n")[0]
