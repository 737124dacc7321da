"""Pairs made where the ids of a small bucket meet, and sets compared inside the cells of a crowded one."""

import random

import numpy as np

from attestry.llm import linking


def test_pairs_of_small_buckets(spark):
    """Up to FEW ids of a key come as pairs whose sizes allow the similarity; a larger bucket comes as its rows."""
    sizes = {1: 60, 2: 100, 3: 101, 4: 59, 5: 36}
    rows = [(i, [1 << 40, 7 << 50], n) for i, n in sizes.items()] + [(100 + i, [5 << 45], 50) for i in range(linking.FEW + 1)] + [(200, [9 << 52], 50)]
    got = linking.shared_keys(spark.createDataFrame(rows * 2, "id long, keys array<long>, n long").repartition(3), 60).collect()
    pairs = [(r.key, r.id) for r in got if r.many == 0]
    ratio = {(a, b): min(sizes[a], sizes[b]) / max(sizes[a], sizes[b]) for a in sizes for b in sizes if a < b}
    assert len(pairs) == len(set(pairs)) and {p for p, r in ratio.items() if r >= 0.6} <= set(pairs)
    assert all(ratio[p] > 0.5 for p in pairs)
    assert sorted(r.id for r in got if r.many > 0) == [100 + i for i in range(linking.FEW + 1)]


def test_cells_hold_every_link(spark):
    """Links of crowded buckets equal brute force over all pairs of different classes that one cell sees."""
    draw = random.Random(5)
    sets = {i: sorted({draw.randrange(60) if draw.random() < 0.9 else 1000 + i for _ in range(draw.randrange(20, 90))}) for i in range(150)}
    rows = [(i % 2, i, 150, i % 5 if i % 3 == 0 else 1000 + i, sets[i]) for i in sets]
    block = linking.BLOCK
    linking.BLOCK = 40  # several blocks a bucket
    try:
        held = linking._blocks(spark.createDataFrame(rows, "key long, id long, many long, root long, members array<long>"))
        found = linking._cell_links(held, lambda larger: np.where(larger > 45, 50, 40)).collect()
    finally:
        linking.BLOCK = block
    asked = set()
    for _, a, _, one, x in rows:
        for _, b, _, two, y in rows:
            if a < b and (a - b) % 2 == 0 and one != two:
                both = len({*x} & {*y})
                if 100 * both >= (50 if max(len(x), len(y)) > 45 else 40) * (len(x) + len(y) - both):
                    asked.add((a, b))
    assert 20 < len(asked) < 4000
    assert sorted((r.a, r.b) for r in found) == sorted(asked)
