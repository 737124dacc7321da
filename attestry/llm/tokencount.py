"""Token counts by the whole-token shortcut.

Offline it is proved which vocabulary strings encode alone as one token. A pre-token that is one of them counts 1 at
once; only the rest goes through the merges. Texts are cut before each run of ASCII white space: no pre-token spans
such a cut, so each distinct piece of text is counted once and looked up after that.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .langid import vocabulary_path

VOCABULARY_FILE = "byte_bpe_50k.json"
LIMIT = 512
SLICE = 1 << 22
#: Counts of merged pre-tokens that a worker keeps.
KEPT = 1 << 19


class Counter:
    """Counts tokens of a byte-level BPE vocabulary; `whole` is the proven set."""

    def __init__(self, vocabulary: list[str], merges: list[tuple[str, str]], specials: list[str]):
        from tokenizers.pre_tokenizers import ByteLevel

        self.ranks = {pair: i for i, pair in enumerate(merges)}
        self.specials = sorted(specials, key=len, reverse=True)
        self.split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.whole = frozenset(v for v in vocabulary if self.merged(v) == 1)
        self.seen: dict[str, int] = {}

    def merged(self, pretoken: str) -> int:
        """Tokens that are left once no merge applies, in O(n log n)."""
        parts, ranks = list(pretoken), self.ranks
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (r := ranks.get((a, b))) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] == a else n
            if j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, ""
            left -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((a + b, parts[k]))) is not None:
                    heapq.heappush(heap, (r, i, a + b, parts[k]))
            if (h := before[i]) >= 0 and (r := ranks.get((parts[h], a + b))) is not None:
                heapq.heappush(heap, (r, h, parts[h], a + b))
        return left

    def count(self, text: str) -> int:
        """Tokens of a text; a special token's string in it is one token and cuts the text."""
        for special in self.specials:
            if special in text:
                return sum(map(self.count, parts := text.split(special))) + len(parts) - 1
        return sum(1 if p in self.whole else self._rest(p) for p, _ in self.split(text)) if text else 0

    def _rest(self, pretoken: str) -> int:
        n = self.seen.get(pretoken)
        if n is None:
            n = self.merged(pretoken)
            if len(pretoken) <= 64:  # so that what is kept stays under some 100 MB
                if len(self.seen) >= KEPT:
                    self.seen.clear()
                self.seen[pretoken] = n
        return n


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in told["model"]["merges"]]
    return Counter(list(told["model"]["vocab"]), merges, [t["content"] for t in told["added_tokens"]])


def _spaced(text: str) -> bool:
    """It begins or ends with white space beyond ASCII, so that its pre-tokens depend on what stands beside it."""
    return (not text[0].isascii() and text[0].isspace()) or (not text[-1].isascii() and text[-1].isspace())


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of documents (doc_id, text, ...), one row for each input row.

    A null or empty text has 0 bytes and tokens. Special tokens' strings inside a text count as one token, as the
    library does by default; nothing is added, cut off or padded. Other columns are not read.
    """
    path = path or vocabulary_path(VOCABULARY_FILE)
    shared = docs.sparkSession.sparkContext.broadcast(counter(path).__dict__ | {"split": None, "seen": {}})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, memo = _received(path, shared), K.memo(f"tokens:{path}")
        for batch in batches:
            data, offsets = K.utf8(batch.column(1))
            for lo, hi in K.slices(offsets, SLICE):
                rows = offsets[lo : hi + 1]
                h, starts, ends, bounds, trailing = K.units(data, rows)
                own_at, back, second = K.distinct(h, data, starts, ends)

                def make(new: np.ndarray) -> np.ndarray:
                    texts = [data[starts[i] : ends[i]].tobytes().decode("utf-8", "replace") for i in own_at[new]]  # noqa: B023
                    words = [t.lstrip(" \t\n\x0b\x0c\r") for t in texts]
                    return np.array([-(1 << 40) if _spaced(w) else own.count(t) for t, w in zip(texts, words, strict=True)], dtype=np.int64)

                n = K.row_sums(memo.get(h[own_at], second, make)[back], bounds) if len(h) else np.zeros(hi - lo, dtype=np.int64)
                for i in np.flatnonzero(n < 0):  # white space beyond ASCII at a cut: the whole text at once
                    n[i] = own.count(data[rows[i] : rows[i + 1]].tobytes().decode("utf-8", "replace"))
                    trailing = trailing[trailing != i]
                for i in trailing:
                    end = ends[bounds[i + 1] - 1] if bounds[i + 1] > bounds[i] else rows[i]
                    n[i] += own.count(data[end : rows[i + 1]].tobytes().decode())
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(np.diff(rows)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(K.task(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


_rebuilt: dict[str, Counter] = {}


def _received(path: str, shared) -> Counter:
    """The broadcast counter with its pre-tokenizer, built once in a worker."""
    from tokenizers.pre_tokenizers import ByteLevel

    if path not in _rebuilt:
        own = Counter.__new__(Counter)
        own.__dict__.update(shared.value)
        own.split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        _rebuilt[path] = own
    return _rebuilt[path]


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
