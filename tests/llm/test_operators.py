"""Operators on small tables: nulls, empty and odd texts, ties, repeated rows, empty tables, clashing columns; held against brute force or round trips."""

import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attestry.llm import chat, decontam, langid, linededup, neardup, quality, rulefit, sampling, tokencount, urls

random.seed(7)
SYLLABLES = ["ka", "lo", "mi", "ten", "ru", "sha", "vor", "pel", "dun", "gri", "os", "fa"]


def prose(n):
    return " ".join("".join(random.choices(SYLLABLES, k=random.randint(1, 4))) for _ in range(n))


def edited(text, share):
    return " ".join(prose(1) if random.random() < share else w for w in text.split(" "))


BASE = [prose(60) for _ in range(6)]
TEXTS = [*BASE, *(edited(b, 0.02) for b in BASE), *(edited(b, 0.3) for b in BASE), BASE[0], BASE[0], None, "", " \n ", "one two", "ONE  two", "a", "é ü 日本", "x" * 3000, "<|endoftext|> a <|endoftext|>", "　 wide   ", "▁ mark▁", "tail  ", "\r\n\tz\n\n"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "l" if i % 2 else None, "s") for i, t in enumerate(TEXTS)] + [(None, BASE[1], "l", "s"), (0, TEXTS[0], None, "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"n": F.lit(1), "ids": F.lit("x"), "score": F.lit("y")}).repartition(3)


def test_tokens(docs):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in tokencount.count_tokens(docs).filter("doc_id is not null").collect():
        text = TEXTS[r["doc_id"]] or ""
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), len(own.encode(text, add_special_tokens=False).ids)), text[:40]


def test_sampled_segmentations(docs):
    def ids(df):
        return Counter((r["doc_id"], r["text"], r["decoded"], tuple(r["ids"] or ())) for r in sampling.decode(sampling.encode(df, F.col("doc_id"))).collect())

    got = ids(docs)
    assert got == ids(docs.coalesce(1).orderBy("text"))
    assert all(text == back for _, text, back, _ in got)
    same = {k for k in got if k[1] == BASE[0]}
    assert len({k[3] for k in same}) == len({k[0] for k in same}) > 2  # a segmentation of its own for each key


def shingles(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\n", " ").replace("\r", " ").replace("\t", " ").split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicates(docs):
    sets = {i: shingles(t) for i, t in enumerate(TEXTS)}
    root = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    root[i] = min(root[i], root[j])
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), root[r["doc_id"]], root[r["doc_id"]] == r["doc_id"])
    assert neardup.near_duplicates(docs.filter("false")).count() == 0


def test_line_dedup(spark):
    a, b, c = prose(30), prose(30), prose(30)
    rows = [(1, f"{a}\nshort\n{b}"), (2, f"{b[:-1]}\nshort\n{c}"), (3, f"{a}\n{a}"), (4, None), (5, ""), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("old"))
    got = {r["doc_id"]: r for r in linededup.dedup_lines(docs).collect()}
    assert got[1]["text"] == f"{a}\nshort\n{b}" and got[2]["text"] == f"short\n{c}" and got[3]["text"] == ""
    assert (got[3]["n_lines"], got[3]["n_removed"]) == (2, 2) and got[4]["text"] is None and got[5]["text"] == "" and got[None]["text"] == a
    assert linededup.dedup_lines(docs.filter("false")).count() == 0


def test_decontamination(spark):
    items = [prose(30) for _ in range(5)]
    texts = [prose(200), f"{prose(50)} {items[0]} {prose(50)}", f"{prose(40)} {edited(items[1], 0.25)} {prose(9)}", items[2].upper(), None, ""]
    bench = spark.createDataFrame([*enumerate(items), (9, None), (None, "a b c"), (8, "")], "item_id long, text string")
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").withColumn("leaks", F.lit(1))
    got = {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in decontam.find_leaks(docs, bench).collect()}
    assert got == {0: [], 1: [0], 2: [1], 3: [2], 4: [], 5: []}
    in_blocks = {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in decontam.find_leaks(docs, bench, block_items=2).collect()}
    assert in_blocks == got
    assert decontam.find_leaks(docs, bench.filter("false")).filter("size(leaks) > 0").count() == 0


def test_quality_statistics(docs):
    def brute(text):
        words = [w for w in (text or "").replace("\n", " ").replace("\r", " ").replace("\t", " ").split(" ") if w]
        grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        covered = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\r\x0b\x0c")]
        return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)

    extra = ["a b c a b c", "a a a a", "x y z w x y z\nx y z w x y z", "## $ q"]
    df = docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame([(100 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    for r in quality.text_statistics(df.withColumn("copy", F.col("text"))).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(r["copy"]), r["copy"]


def test_quality_verdicts(docs):
    many = docs.sparkSession.createDataFrame([(1000 + i, prose(random.randint(60, 300)), "l", "s") for i in range(300)] + [(5000, prose(80).replace(" ", "$$$ *** "), "l", "s")], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality.judge(many.unionByName(docs.select(*many.columns))).collect()}
    assert not got[5000]["kept"] and sum(got[1000 + i]["kept"] for i in range(300)) >= 297
    assert got[20]["base_failed"] and not got[20]["kept"]
    assert quality.judge(docs.filter("false")).count() == 0


def test_language(spark):
    words = {"aa": ["the", "house", "river"], "bb": ["das", "haus", "wasser"]}
    rows = [(i, " ".join(random.choices(words[k], k=12)), k) for i, k in enumerate(["aa", "bb"] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("old"))
    model = langid.train(docs)
    odd = spark.createDataFrame([(1, None), (2, "123 !!"), (3, "the river house"), (4, "Wasser haus")], "doc_id long, text string")
    assert [r["lang_pred"] for r in langid.identify(odd, model).orderBy("doc_id").collect()] == ["und", "und", "aa", "bb"]
    assert all(r["lang_pred"] == r["lang"] for r in langid.identify(docs, model).collect())
    assert {r["lang_pred"] for r in langid.identify(odd, langid.train(docs.filter("false"))).collect()} == {"und"}


def test_classifier(spark):
    rows = [(i, prose(80) if i % 2 else prose(80).replace(" ", " ### "), i % 2) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    stats = rulefit.text_features(docs).cache()
    scored = stats.join(docs, "doc_id").select("quality", rulefit.fit(stats, docs.filter("doc_id % 3 <> 1")).score().alias("s")).collect()
    assert all((r["s"] >= 0.5) == (r["quality"] == 1) for r in scored)
    assert {r["s"] for r in stats.select(rulefit.fit(stats, docs.filter("false")).score().alias("s")).collect()} == {0.5}


def test_urls(spark):
    told = {"http://A.Example.com/en/1": "com/en/", "https://x.example.com/en/77?q": "example.com/en/7", "x.org/es/": None, "http://q.org/es/#a": "org/es/", "http://example.net/de/81": "example.net/de/8", "http://notcom/en/": None, None: None, "": None, "://net/de/": "net/de/"}
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([*told, "http://q.org/es/#a"])], "page_id long, url string").withColumn("host", F.lit(1))
    got = {r["page_id"]: r for r in urls.filter_urls(pages).collect()}
    assert [got[i]["rule"] for i in range(len(told))] == list(told.values())
    assert got[0]["host"] == "a.example.com" and got[0]["path"] == "/en/1" and got[0]["verdict"] == "block" and got[1]["verdict"] == "allow" and got[2]["host"] == ""
    assert urls.filter_urls(pages.filter("false")).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "<|im_end|> <\\|x|> <\\\\|"), (1, 1, "assistant", None), (2, 1, "assistant", "b"), (2, None, None, "a"), (3, 0, "us\ner<|", ""), (3, 0, "us\ner<|", ""), (None, 0, "user", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(turns)).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("user", rows[0][3]), ("assistant", "")]
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("", "a"), ("assistant", "b")] and got[2]["loss_text"] == "b" and not got[2]["valid"] and got[2]["error_at"] == 0
    assert [t["role"] for t in got[3]["turns"]] == ["us\ner<|"] * 2 and got[1]["valid"] and got[None]["error_at"] == 1
    assert chat.format_conversations(turns.filter("false")).count() == 0


def test_url_rules(spark):
    """The contract's rules word by word, and one URL of each host that they meet."""
    assert urls.RULES == [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
    told = {"http://a.com/en/1": "block", "http://example.com/en/70": "allow", "http://b.net/de/1": "allow", "http://example.net/de/7": "allow", "http://www.example.net/de/81": "block", "http://c.org/es/": "block"}
    got = urls.filter_urls(spark.createDataFrame(list(enumerate(told)), "page_id long, url string")).orderBy("page_id").collect()
    assert [r["verdict"] for r in got] == list(told.values())
