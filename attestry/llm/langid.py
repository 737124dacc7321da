"""Language identification with segmentation-marginalised unigrams.

Each language is a distribution over the pieces of a fixed public vocabulary. A text's probability is the sum over
all its segmentations into pieces; as no piece crosses white space it is the product over words, each summed by the
forward algorithm. The distributions come from EM over the word counts of a bounded sample of labelled rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .lattice import FALLBACK, RAW_MARK, SPACE_MARK, Pieces, forward, lattice, pieces
from .scratch import written

#: Labelled rows that the model is fitted on: beyond this number a hash of doc_id draws about so many.
TRAIN_ROWS = 4_000
#: Of these, rows of each language at least (all, if it has fewer), so that a rare language is learned in a large table too.
LEAST_ROWS = 200
ROUNDS = 2
#: Added to each piece's expected count.
PRIOR_COUNT = 0.05
#: Words in one lattice.
PART = 5_000
UNDECIDED = "und"
MODEL_FILE = "piece_bpe_32k.model"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _string(word: bytes) -> str:
    """What the lattice is built over: lower case, without marks and digits at either end."""
    text = word.decode("utf-8", "replace").lower().replace(SPACE_MARK, RAW_MARK)
    lo, hi = 0, len(text)
    while lo < hi and not text[lo].isalpha():
        lo += 1
    while hi > lo and not text[hi - 1].isalpha():
        hi -= 1
    return SPACE_MARK + text[lo:hi] if hi > lo else ""


def _edge_weights(graph, probability: np.ndarray) -> np.ndarray:
    """probability: (pieces + 1, languages), the last row for a character that no piece spells."""
    return probability[np.where(graph.piece == FALLBACK, len(probability) - 1, graph.piece)]


def word_scores(strings: list[str], vocabulary: Pieces, probability: np.ndarray) -> np.ndarray:
    """Log probability of each string in each language; zeros for an empty one."""
    out = np.zeros((len(strings), probability.shape[1]))
    at = [i for i, s in enumerate(strings) if s]
    for lo in range(0, len(at), PART):
        part = at[lo : lo + PART]
        graph = lattice([strings[i] for i in part], vocabulary)
        alpha, scale = forward(graph, _edge_weights(graph, probability))
        end = graph.base + graph.length
        out[part] = np.log(np.maximum(alpha[end], 1e-300)) + scale[end][:, None]
    return out


def _expected(strings: list[str], counts: np.ndarray, languages: np.ndarray, vocabulary: Pieces, probability: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in each language: the E step."""
    graph = lattice(strings, vocabulary)
    owner = np.repeat(np.arange(len(strings)), graph.length + 1)[graph.target]
    weight = np.take_along_axis(_edge_weights(graph, probability), languages[owner][:, None], axis=1)
    alpha, up = forward(graph, weight)
    beta, down = forward(graph, weight, backwards=True)
    end = (graph.base + graph.length)[owner]
    share = alpha[graph.source, 0] * weight[:, 0] * beta[graph.target, 0] / alpha[end, 0] * np.exp(up[graph.source] + down[graph.target] - up[end])
    out = np.zeros_like(probability)
    np.add.at(out, (np.where(graph.piece == FALLBACK, len(probability) - 1, graph.piece), languages[owner]), share * counts[owner])
    return out


def _word_counts(sample: DataFrame, languages: list[str]) -> DataFrame:
    """(k, word, n): the words of a sample (lang, text) as the lattice takes them, with the language's position."""
    code = {v: i for i, v in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[int, str], int] = {}
            data, offsets = K.utf8(batch.column(1))
            langs = np.array([code[x] for x in batch.column(0).to_pylist()], dtype=np.uint64)
            for lo, hi in K.slices(offsets):
                h, starts, ends, bounds = K.words(data, offsets[lo : hi + 1], lower=True)
                of = np.repeat(langs[lo:hi], np.diff(bounds))
                _, first, n = np.unique(K.mix(h + of), return_index=True, return_counts=True)
                for i, c in zip(first.tolist(), n.tolist(), strict=True):
                    key = (int(of[i]), _string(data[starts[i] : ends[i]].tobytes()))
                    found[key] = found.get(key, 0) + c
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([w for _, w in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["k", "word", "n"])

    return sample.select("lang", "text").mapInArrow(K.task(run), "k int, word string, n long").filter("word <> ''").groupBy("k", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, path: str | None = None, rows: int = TRAIN_ROWS, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, piece probabilities (pieces + 1, languages) and log priors from labelled documents (doc_id, text, lang).

    Fitted on about `rows` of them (all if there are fewer) and LEAST_ROWS of each language: those whose doc_id has
    a small hash. What reaches the driver is one number for each piece of the vocabulary and language.
    """
    path = path or vocabulary_path(MODEL_FILE)
    labelled = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "lang", "text")
    by_lang = labelled.groupBy("lang").count().orderBy("lang").collect()
    languages, n = [r["lang"] for r in by_lang], sum(r["count"] for r in by_lang)
    if not languages:
        return [], np.zeros((0, 0)), np.zeros(0)
    priors = np.log(np.array([r["count"] for r in by_lang]) / n)
    sample = labelled
    if n > rows:
        bounds = [(r["lang"], int(min(1.0, max(rows / n, LEAST_ROWS / r["count"])) * (1 << 30))) for r in by_lang]
        bound = F.element_at(F.create_map(*(F.lit(x) for pair in bounds for x in pair)), F.col("lang"))
        sample = labelled.filter(F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 30)) < bound)
    words = written(_word_counts(sample, languages).repartition(docs.sparkSession.sparkContext.defaultParallelism), "langid-words")
    size = len(pieces(path).names)
    probability = np.full((size + 1, len(languages)), 1.0 / size)
    for _ in range(rounds):
        expected = np.zeros_like(probability)
        for r in _e_step(words, path, probability).collect():
            expected[r["piece"], r["k"]] = r["uses"]
        expected += PRIOR_COUNT
        probability = expected / expected.sum(axis=0)
    return languages, probability, priors


def _e_step(words: DataFrame, path: str, probability: np.ndarray) -> DataFrame:
    shared = words.sparkSession.sparkContext.broadcast(probability)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(shared.value)
        for batch in batches:
            k, word, n = (c.to_pylist() for c in batch.columns)
            total += _expected(word, np.array(n, dtype=float), np.array(k), pieces(path), shared.value)
        piece, k = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int64()), pa.array(k, pa.int64()), pa.array(total[piece, k])], names=["piece", "k", "uses"])

    # a fixed number of decimals keeps the sums independent of the order in which tasks end
    return words.mapInArrow(K.task(run), "piece long, k long, uses double").groupBy("piece", "k").agg(F.sum(F.col("uses").cast("decimal(28,6)")).cast("double").alias("uses"))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], path: str | None = None) -> DataFrame:
    """`docs` (text, ...) with lang_pred and score, the posterior of lang_pred, from the whole text alone.

    A null text, or one without a letter, is `und` with score 0, as is every text if the model knows no language.
    Ties go to the language first in the alphabet. All columns of the input stay, but for former ones of these two names.
    """
    languages, probability, priors = model
    docs = docs.drop("lang_pred", "score")
    if not languages:
        return docs.withColumns({"lang_pred": F.lit(UNDECIDED), "score": F.lit(0.0)})
    path = path or vocabulary_path(MODEL_FILE)
    shared = docs.sparkSession.sparkContext.broadcast(probability)
    name = f"langid:{hashlib.sha256(probability.tobytes()).hexdigest()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, memo = pieces(path), K.memo(name)
        for batch in batches:
            data, offsets = K.utf8(batch.column("text"))
            for lo, hi in K.slices(offsets):
                own = offsets[lo : hi + 1]
                h, starts, ends, bounds = K.words(data, own, lower=True)
                sums = np.zeros((hi - lo, len(languages)))
                if len(h):
                    at, back, second = K.distinct(h, data, starts, ends, lower=True)
                    found = memo.get(h[at], second, lambda new: word_scores([_string(data[starts[i] : ends[i]].tobytes()) for i in at[new]], vocabulary, shared.value))  # noqa: B023
                    sums = K.row_sums(found[back], bounds)
                sums = sums + priors
                best = sums.argmax(axis=1)
                score = 1.0 / np.exp(sums - sums[np.arange(len(sums)), best][:, None]).sum(axis=1)
                block = data[own[0] : own[-1]] | 32
                letters = K.row_sums(((block >= 97) & (block <= 122)).astype(np.int8), own - own[0])
                for i in np.flatnonzero(letters == 0):
                    letters[i] = any(map(str.isalpha, data[own[i] : own[i + 1]].tobytes().decode("utf-8", "replace")))
                known = letters > 0
                names = np.where(known, np.array(languages, dtype=object)[best], UNDECIDED)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0))], names=[*part.schema.names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(K.task(run), f"{schema}, lang_pred string, score double")


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    out = identify(docs.select(F.col("doc_id").cast("long"), "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
