"""The blocks of the exact neighbourhoods: scores of single precision only choose what is computed again."""

import tracemalloc

import numpy as np

from annalist.operators.similarity import best, nearest


def test_neighbours_closer_than_single_precision_are_told_apart_and_few_scores_are_held():
    g = np.random.default_rng(3)
    queries, points = g.normal(size=(2000, 16)), g.normal(size=(6000, 16))
    points[1000:1300] = queries[:300] * (1 + 1e-9 * g.normal(size=(300, 16)))
    points[2000:2300] = queries[:300] * (1 + 1e-9 * g.normal(size=(300, 16)))
    points[3000:3300] = points[1000:1300]
    points[7], points[8], points[9] = 0, points[9] * 1e-50, points[9] * 1e150
    tracemalloc.start()
    i, j, score = nearest(queries, points, 4, 0.2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    dots = np.stack([np.einsum("ij,ij->i", np.broadcast_to(q, points.shape), points) for q in queries])
    scale = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(points, axis=1)[None, :]
    cosine = np.divide(dots, scale, out=np.zeros_like(scale), where=scale > 0)
    rows, columns = np.nonzero(cosine >= 0.2)
    a, b, want = best(rows, columns, cosine[rows, columns], 4)
    assert np.array_equal(i, a) and np.array_equal(j, b) and np.array_equal(score, want)
    assert peak < 24e6  # all scores in double precision would be 96 MB, and a chunk of them was 64 MB
