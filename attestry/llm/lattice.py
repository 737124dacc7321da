"""Piece lattices over short strings: every way to cut a string into pieces of a fixed vocabulary.

The strings of a batch are laid out together: each has nodes 0 to len(string), an edge for each piece that fits
between two of them, and one for each character that no piece spells (the vocabulary's byte fallback).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from .kernels import mix

#: The vocabulary's mark for a space, and what stands for that character itself where a text holds it.
SPACE_MARK, RAW_MARK = "▁", "﷐"
FALLBACK = -1


class Trie:
    """The pieces' prefixes as states (0: the empty one); one step for each (state, code point), in an open-addressed table."""

    def __init__(self, prefixes: dict[str, int]):
        state = {"": 0} | {p: i for i, p in enumerate(sorted(prefixes, key=len), 1)}
        self.ids = np.array([FALLBACK] + [prefixes[p] for p in list(state)[1:]], dtype=np.int64)
        keys = np.array([self.key(state[p[:-1]], ord(p[-1])) for p in list(state)[1:]], dtype=np.int64)
        self.mask = (1 << (4 * len(keys) + 1).bit_length()) - 1
        self.keys, self.next = np.full(self.mask + 1, -1, dtype=np.int64), np.zeros(self.mask + 1, dtype=np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            own, first = np.unique(slot, return_index=True)
            first = first[self.keys[own] < 0]
            self.keys[slot[first]], self.next[slot[first]] = keys[left[first]], left[first] + 1
            stay = np.ones(len(left), dtype=bool)
            stay[first] = False
            left, slot = left[stay], slot[stay] + 1 & self.mask

    @staticmethod
    def key(state, point):
        return state << 21 | point

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return mix(keys.view(np.uint64)).view(np.int64) & self.mask

    def step(self, state: np.ndarray, point: np.ndarray) -> np.ndarray:
        """The states after one more character; 0 where no piece begins so."""
        keys = self.key(state, point)
        slot, out = self._slot(keys), np.zeros(len(keys), dtype=np.int64)
        left = np.arange(len(keys))
        while len(left):
            there = self.keys[slot]
            hit = there == keys[left]
            out[left[hit]] = self.next[slot[hit]]
            go = ~hit & (there >= 0)
            left, slot = left[go], slot[go] + 1 & self.mask
        return out


@dataclass(frozen=True)
class Pieces:
    """Piece strings of a vocabulary file, their ids, ranks (0 for the earliest merge), and byte_id: the id of byte 0."""

    names: tuple[str, ...]
    trie: Trie
    ranks: np.ndarray
    byte_id: int


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    names = tuple(model.id_to_piece(i) for i in range(n))
    prefixes: dict[str, int] = {}  # id of a piece, FALLBACK for what only begins one
    for i, name in enumerate(names):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            for end in range(1, len(name)):
                prefixes.setdefault(name[:end], FALLBACK)
            prefixes[name] = i
    scores = -np.array([model.get_score(i) for i in range(n)])
    return Pieces(names, Trie(prefixes), np.clip(scores, 0, n), next(i for i in range(n) if model.is_byte(i)))


@dataclass
class Lattice:
    base: np.ndarray  # first node of each string
    length: np.ndarray  # characters of each string
    source: np.ndarray  # of each edge, by target: nodes, and the piece's id or FALLBACK
    target: np.ndarray
    piece: np.ndarray


def lattice(strings: list[str], vocabulary: Pieces) -> Lattice:
    trie = vocabulary.trie
    point = np.frombuffer("".join(strings).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    length = np.array([len(s) for s in strings], dtype=np.int64)
    owner, end = np.repeat(np.arange(len(strings)), length), np.repeat(np.cumsum(length), length)
    at, reach = np.arange(len(point)), 1  # characters that a prefix of `reach` characters may begin at
    state, parts = np.zeros(len(point), dtype=np.int64), []
    while len(at):
        state = trie.step(state, point[at + reach - 1])
        piece = trie.ids[state]
        ends = slice(None) if reach == 1 else np.flatnonzero(piece >= 0)  # every character has an edge of its own
        source = at[ends] + owner[at[ends]]
        parts.append((source, source + reach, piece[ends]))
        go = (state > 0) & (at + reach < end[at])
        at, state, reach = at[go], state[go], reach + 1
    source, target, piece = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, dtype=np.int64),) * 3
    order = np.argsort(target, kind="stable")
    return Lattice(np.cumsum(length + 1) - length - 1, length, source[order], target[order], piece[order])


def forward(graph: Lattice, weight: np.ndarray, backwards: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all cuts up to each node, for `weight` (edges, columns), and the log scale of each node's sum.

    backwards: over all cuts from each node on. Sums are kept in range by scaling a node's row; a node's true sum is exp(scale) times its row.
    """
    n = int(graph.base[-1] + graph.length[-1] + 1) if len(graph.base) else 0
    alpha, scale = np.zeros((n, weight.shape[1])), np.zeros(n)
    head, tail = (graph.source, graph.target) if backwards else (graph.target, graph.source)
    alpha[graph.base + (graph.length if backwards else 0)] = 1.0
    owner = np.repeat(np.arange(len(graph.base)), graph.length + 1)
    depth = head - graph.base[owner[head]] if len(head) else head
    depth = graph.length[owner[head]] - depth if backwards else depth
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(1, (int(depth.max()) if len(depth) else 0) + 2))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        e = order[lo:hi]
        e = e[np.argsort(head[e], kind="stable")]
        nodes, first = np.unique(head[e], return_index=True)
        top = np.maximum.reduceat(scale[tail[e]], first)
        local = np.repeat(top, np.diff(np.append(first, len(e))))
        sums = np.add.reduceat(alpha[tail[e]] * weight[e] * np.exp(scale[tail[e]] - local)[:, None], first, axis=0)
        small = sums.max(axis=1)
        low = (small > 0) & (small < 1e-100)
        sums[low] /= small[low, None]
        alpha[nodes], scale[nodes] = sums, top + np.where(low, np.log(np.where(low, small, 1.0)), 0.0)
    return alpha, scale
