import random

import numpy as np

from lectern.operators import graph


def test_dependencies_by_levels():
    rnd = random.Random(4)
    n = 25
    pairs = {tuple(sorted(rnd.sample(range(n - 2), 2))) for _ in range(40)}  # two notes stay alone
    near = [sorted({b for a, b in pairs if a == v} | {a for a, b in pairs if b == v}) for v in range(n)]
    start = np.concatenate([[0], np.cumsum([len(x) for x in near])])
    flat = np.array([w for x in near for w in x])
    dist, count = np.full((n, n), np.inf), np.zeros((n, n))
    for s in range(n):
        dist[s, s], count[s, s], front, d = 0, 1, [s], 0
        while front:
            d += 1
            for v in front:
                for w in near[v]:
                    if dist[s, w] >= d:
                        dist[s, w] = d
                        count[s, w] += count[s, v]
            front = [w for w in range(n) if dist[s, w] == d]
    for s in range(n):
        want = [sum(count[s, v] * count[v, t] / count[s, t] for t in range(n) if t not in (s, v) and np.isfinite(dist[s, t]) and dist[s, v] + dist[v, t] == dist[s, t]) if v != s else 0 for v in range(n)]
        assert np.allclose(graph._brandes(start, flat, s), want)
