import numpy as np

from gleanery.llm import pq
from tests.llm.test_topk import VECS


def brute(rows, least):
    use = {k for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    v = {k: np.array([float(np.float32(x)) for x in rows[k][1]]) for k in use}
    links = {k: [j for j in use if j != k and len(v[j]) == len(v[k]) and v[j] @ v[k] / np.sqrt((v[j] @ v[j]) * (v[k] @ v[k])) >= least] for k in use}
    out = []
    for k, (i, _) in enumerate(rows):
        reached, queue = {k}, [k]
        while queue:
            for j in links.get(queue.pop(), []):
                if j not in reached:
                    reached.add(j)
                    queue.append(j)
        c = None if i is None else min(rows[j][0] for j in reached)
        out.append((i, len(links.get(k, [])), c, i is not None and i == c))
    return sorted(out, key=str)


def planted(n, dim=64, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, n // 2, 2):  # pairs of cosine 0.95 to 0.99
        noise = rng.normal(size=dim)
        noise -= noise @ x[i] * x[i]
        c = rng.uniform(0.952, 0.99)
        x[i + 1] = c * x[i] + (1 - c * c) ** 0.5 * noise / np.linalg.norm(noise)
    return x


def test_against_all_pairs(spark):
    x = planted(300)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(500 + i, x[3].tolist()) for i in range(30)] + [(600, (2 * x[3]).tolist()), (601, [0.0] * 64), (602, None), (603, []), (604, [float("nan")] * 64), (605, [None] * 64), (None, x[5].tolist()), (606, [1.0, 2.0]), (607, [2.0, 4.0]), (7, x[7].tolist()), (608, [float("inf")] + [0.0] * 63)]
    for block in (pq.BLOCK, 8):  # 8: cells are split into blocks
        got = pq.cosine_groups(spark.createDataFrame([(i, v, 1, "v", 2) for i, v in rows], VECS), block=block).collect()
        want = brute(rows, 0.95)
        got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str)
        assert [g[0] for g in got] == [w[0] for w in want]
        assert sum(g[1] for g in got) >= 0.97 * sum(w[1] for w in want) and all(g[1] <= w[1] for g, w in zip(got, want))
        assert np.mean([g == w for g, w in zip(got, want)]) > 0.95


def test_recall_over_many_cells(spark):
    x = planted(12_000, seed=1)
    got = pq.cosine_groups(spark.createDataFrame([(i, v.tolist(), 1, "v", 2) for i, v in enumerate(x)], VECS).repartition(8)).collect()
    y = x.astype(np.float32).astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    want = np.concatenate([(y[i : i + 1000] @ y.T >= 0.95).sum(1) - 1 for i in range(0, len(y), 1000)])
    found = np.zeros(len(x))
    for r in got:
        found[r.vec_id] = r.n_links
    assert (found <= want).all() and found.sum() / want.sum() >= 0.9
    joined = {r.vec_id: r.component_id for r in got}
    assert np.mean([joined[i] == joined[i + 1] for i in range(0, 6000, 2)]) >= 0.95
    print("recall", found.sum() / want.sum())


def test_links_count_at_both_ends(spark):
    x = planted(12_000, seed=2)
    got = {r.vec_id: r.n_links for r in pq.cosine_groups(spark.createDataFrame([(i, v.tolist(), 1, "v", 2) for i, v in enumerate(x)], VECS).repartition(8)).collect()}
    pairs = [(got[i], got[i + 1]) for i in range(0, 6000, 2)]
    assert all(a == b for a, b in pairs) and np.mean([a for a, _ in pairs]) >= 0.999


def test_probes_hold_up_to_the_most_cells():
    sample, pairs = planted(pq.SAMPLE, seed=5), planted(8000, seed=9)[:4000]
    for vectors in (12_000, 262_144, pq.A_CELL * pq.MOST_CENTROIDS**2):
        near = pq.Quantiser(sample, vectors).cells(pairs)[0]
        a, b = near[::2], near[1::2]
        either = (a == b[:, :1]).any(1) | (b == a[:, :1]).any(1)
        print("cells of", vectors, "vectors, pairs that meet", either.mean())
        assert either.mean() >= 0.995


def test_empty_table(spark):
    assert pq.cosine_groups(spark.createDataFrame([], VECS)).count() == 0
