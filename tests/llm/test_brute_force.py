"""Operators without SQL against plain Python forms of their methods: every segmentation, every alignment, every half, every rule."""

import itertools
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from attestry.llm import boosting, decontam, langid, quality, rulefit, sampling, urls
from attestry.llm import lattice as L

SYLLABLES = ["ka", "lo", "mi", "ten", "ru", "sha", "vor", "pel", "dun", "gri", "os", "fa"]


def prose(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n))


def cuts(text, ids):
    """Every way to cut `text` into pieces (or single characters), as lists of (string, id or None)."""
    if not text:
        yield []
    for end in range(1, len(text) + 1):
        piece = text[:end]
        if piece in ids or end == 1:
            for rest in cuts(text[end:], ids):
                yield [(piece, ids.get(piece)), *rest]


def vocabulary():
    own = L.pieces(langid.vocabulary_path(langid.MODEL_FILE))
    return own, {own.names[i]: i for i in own.trie.ids[own.trie.ids >= 0].tolist()}


def test_word_scores_sum_all_segmentations(spark):
    own, ids = vocabulary()
    probability = np.random.default_rng(5).random((len(own.names) + 1, 3)) ** 8 + 1e-12
    probability /= probability.sum(axis=0)
    words = ["the", "rivers", "über", "日本x", "a", "zzqzx", "don't"]
    wanted = [np.log(sum(np.prod([probability[len(own.names) if i is None else i] for _, i in cut], axis=0) for cut in cuts(L.SPACE_MARK + w, ids))) for w in words]
    assert np.allclose(langid.word_scores([L.SPACE_MARK + w for w in words], own, probability), wanted, atol=1e-9)
    # and a text is the product of its words, whatever its case and marks
    texts = {1: "The (rivers) don't, 12 A", 2: None, 3: "", 4: "ÜBER über", 5: " ".join(["the rivers"] * 60_000)}
    told = {1: [0, 1, 6, 4], 4: [2, 2], 5: [0, 1] * 60_000}
    docs = spark.createDataFrame([*texts.items(), (1, texts[1])], "doc_id long, text string").withColumn("lang_pred", F.lit(7))
    priors = np.log([0.5, 0.3, 0.2])
    got = langid.identify(docs, (["a", "b", "c"], probability, priors)).collect()
    assert len(got) == 6
    for r in got:
        if r["doc_id"] in (2, 3):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            sums = priors + sum(wanted[i] * n for i, n in Counter(told[r["doc_id"]]).items())
            share = np.exp(sums - sums.max()) / np.exp(sums - sums.max()).sum()
            assert r["lang_pred"] == "abc"[int(sums.argmax())] and math.isclose(r["score"], share.max(), abs_tol=1e-6)


def test_rare_languages_are_learned(spark):
    rng = random.Random(11)
    words = {"aa": ["the", "house", "river"], "bb": ["das", "haus", "wasser"], "cc": ["maison", "fleuve", "ville"]}
    many = ["aa", "bb"] * 2000 + ["cc"] * 5
    rows = [(i, " ".join(rng.choices(words[k], k=8)), k) for i, k in enumerate(many)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=200)
    got = langid.identify(spark.createDataFrame([(1, "ville fleuve"), (2, "haus"), (3, "river")], "doc_id long, text string"), model)
    assert model[0] == ["aa", "bb", "cc"] and [r["lang_pred"] for r in got.orderBy("doc_id").collect()] == ["cc", "bb", "aa"]


def test_segmentations_are_drawn_by_their_weights(spark):
    own, ids = vocabulary()
    weight = lambda cut: math.prod(sampling.BYTE_WEIGHT if i is None else (1.0 + own.ranks[i]) ** -sampling.STEEPNESS for _, i in cut)
    word, n = "rivers", 6000
    weights = {tuple(i for _, i in cut): weight(cut) for cut in cuts(L.SPACE_MARK + word, ids)}
    total = sum(weights.values())
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(word).alias("text"))
    drawn = Counter(tuple(r["ids"]) for r in sampling.encode(docs, F.col("doc_id")).collect())
    assert set(drawn) <= set(weights) and len(drawn) > 3
    for cut, w in weights.items():
        p = w / total
        assert abs(drawn[cut] / n - p) <= 5 * math.sqrt(p * (1 - p) / n) + 2 / n


def smith_waterman(a, b, mismatch, gap):
    h, best = [0] * (len(b) + 1), 0
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, h[j] + (decontam.MATCH if x == y else mismatch), h[j + 1] - gap, row[-1] - gap))
        h, best = row, max(best, *row)
    return best


def test_leaks_are_those_of_all_alignments(spark):
    rng = random.Random(6)

    def edited(words, share):
        out = []
        for w in words:
            kind = rng.random() / share if share else 1
            out += [w] if kind >= 1 else [] if kind < 0.3 else [prose(rng, 1)] if kind < 0.7 else [w, prose(rng, 1)]
        return out

    items = {i: prose(rng, rng.choice((3, 5, 9, 20, 40, 80))).split(" ") for i in range(30)} | {90: ["yes"], 91: ["ka", "lo"]}
    texts = {}
    for k in range(120):
        words = prose(rng, rng.randint(0, 80)).split(" ")
        if k % 3:
            whole = items[rng.randrange(30)]
            lo = rng.randrange(len(whole) // 2 + 1)
            words += edited(whole[lo : lo + rng.randint(len(whole) // 3, len(whole))], rng.choice((0, 0.05, 0.15))) + prose(rng, rng.randint(0, 60)).split(" ")
        texts[k] = words
    texts |= {200: ["yes"], 201: ["ka", "lo"], 202: ["yes", "no"], 203: ["ka"]}
    wanted = {}
    for d, words in texts.items():
        words = [w for w in words if w]
        for i, item in items.items():
            full, score = decontam.MATCH * len(item), smith_waterman(item, words, decontam.MISMATCH, decontam.GAP)
            if len(item) < decontam.SEED_WORDS:
                leaks = item == words
            else:
                leaks = score >= decontam.SHARE * full and score >= min(full, decontam.MATCH * decontam.LEAST_WORDS)
                leaks = leaks or smith_waterman(item, words, -decontam.EDIT, decontam.EDIT) >= decontam.MATCH * decontam.PASSAGE_WORDS
            if leaks:
                wanted[d, i] = score / full
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    docs = spark.createDataFrame([(d, ", ".join(w).title()) for d, w in texts.items()], "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], x["item_id"]): x["score"] for r in decontam.find_leaks(docs.unionByName(docs.filter("doc_id < 9")), bench).collect() for x in r["leaks"]}
    assert set(got) == set(wanted) and len(got) > 25
    assert all(math.isclose(got[k], wanted[k]) for k in got)


def test_verdicts_of_the_best_half(spark):
    """Of all halves of a small group the one with the least determinant gives the same verdicts."""
    rng = random.Random(8)
    rows = [(i, rng.randint(90, 130), 0, rng.randint(0, 1), 0, 0) for i in range(11)]
    rows = [(i, n, n * 5 + rng.randint(-9, 9), s, d, r) for i, n, _, s, d, r in rows]
    rows += [(11, 100, 4000, 0, 0, 0), (12, 110, 560, 400, 0, 0), (13, 105, 520, 1, 40, 50)]
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = quality.outliers(spark.createDataFrame(rows, columns).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s")}), ["lang", "source"])
    _, n, c, s, d, r = np.array(rows, dtype=float).T
    x = np.stack([np.log1p(n), np.log((c + 1) / (n + 1)), np.log((s + 1) / (c + 20)), np.sqrt(d / (n + 1)), np.sqrt(r / (n + 1))], axis=1)
    halves = []
    for half in itertools.combinations(range(len(rows)), (len(rows) + 6) // 2):
        own = x[list(half)]
        halves.append((np.linalg.det(np.cov(own.T, bias=True) + np.diag(quality.FLOORS) ** 2), half))
    own = x[list(min(halves)[1])]
    apart = x - own.mean(axis=0)
    d2 = np.einsum("ij,jk,ik->i", apart, np.linalg.inv(np.cov(own.T, bias=True) + np.diag(quality.FLOORS) ** 2), apart)
    d2 *= quality.MEDIAN / max(float(np.median(d2)), quality.MEDIAN)
    assert {q["doc_id"] for q in got.collect() if q["distance2"] > quality.CUTOFF} == {i for i, v in enumerate(d2) if v > quality.CUTOFF} == {11, 12, 13}


def test_rules_as_columns(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, 80) if i % 2 else prose(rng, 80).replace(" ", " ## ", rng.randint(3, 70)), i % 2) for i in range(300)]
    odd = [(1000, None), (1001, ""), (1002, "x " * 400_000), (1003, "\n\n"), (None, "a b"), (1, rows[1][1]), (1, "another text")]
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(2, 0), (2, None), (9999, 1)], "doc_id long, quality int").withColumns({"_y": F.lit(5), "log_words": F.lit(1.0)})
    docs = spark.createDataFrame([r[:2] for r in rows] + odd, "doc_id long, text string").withColumns({"_y": F.lit("x"), "quality": F.lit(3)})
    stats = rulefit.text_features(docs).cache()
    model = rulefit.fit(stats, labels)
    assert len(model.weighted) > 1
    got = stats.select("*", model.score().alias("score")).collect()
    assert len(got) == len(rows) + len(odd)
    x = np.array([[r[s] for s in rulefit.STATISTICS] for r in got])
    margin = model.bias + sum(w * boosting.applies(rule, x) for rule, w in model.weighted)
    assert np.allclose([r["score"] for r in got], 1 / (1 + np.exp(-margin)))
    assert rulefit.text_features(docs.filter("false")).count() == 0


def test_trees_as_columns(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) & (x[:, 2] <= 0.5)).astype(float)
    bias, trees = boosting.boost(x, y, 30, 4)
    margin = bias + sum(boosting.predict(t, x) for t in trees)
    assert ((margin > 0) == (y > 0)).mean() > 0.98
    names = ["a", "b", "c", "d"]
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x[:500])], ["i", *names])
    score = boosting.logistic(sum((boosting.tree_column(t, names) for t in trees), F.lit(bias)))
    got = [r["s"] for r in rows.select("i", score.alias("s")).orderBy("i").collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-margin[:500])))


def test_url_features(spark):
    """Lexical features against their definitions, and a term told from others by held-out hosts."""
    odd = ["http://a-1.b.org/x/y22/?q=1&r=2#f", "", "ftp://", "https://" + "h" * 90_000 + "/" + "9" * 90_000]
    pages = spark.createDataFrame([(u,) for u in odd], "url string").select("url", urls.host(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path"))
    got = {r["url"]: r for r in urls.lexical(pages).collect()}
    first = got[odd[0]]
    assert [first[k] for k in ("depth", "labels", "parameters", "query_length", "fragment", "hyphens", "host_digits", "secure", "last_number")] == [3, 3, 2, 7, 1, 1, 1, 0, 2]
    share = [odd[0].count(c) / len(odd[0]) for c in set(odd[0])]
    assert math.isclose(first["entropy"], -sum(p * math.log2(p) for p in share))
    assert got[""]["length"] == 0 and got[odd[3]]["host_length"] == 90_000 and got[odd[3]]["last_number"] == 90_000
