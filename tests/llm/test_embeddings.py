import numpy as np
import pytest

from gridcast.llm.components import connected_components
from gridcast.llm.embeddings import near_vectors


def brute(ids, vecs, threshold=0.95):
    ok = [v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) and i is not None for i, v in zip(ids, vecs)]
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(ids)
    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            if ok[a] and ok[b] and len(vecs[a]) == len(vecs[b]):
                x, y = (np.array(v, float) / np.abs(np.array(v, float)).max() for v in (vecs[a], vecs[b]))
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    links[a] += 1
                    links[b] += 1
                    ra, rb = sorted((root(ids[a]), root(ids[b])))
                    parent[rb] = ra
    named = [root(i) if o else i for i, o in zip(ids, ok)]
    return sorted((i if i is not None else -1, n, c if i is not None else -1) for i, n, c in zip(ids, links, named))


@pytest.mark.parametrize("block", [1024, 16])
def test_against_brute_force(spark, block):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 16))
    vecs = [(base[k % 40] + rng.standard_normal(16) * 0.04).astype("float32").tolist() for k in range(200)]
    vecs += [vecs[0]] * 30 + rng.standard_normal((100, 16)).astype("float32").tolist()
    vecs += [None, [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] * 16, [], [1.0, 2.0], [1.0, 2.0]]
    vecs += [[1e200, 0.0], [2e200, 1e199], [1e-200, 0.0], [-1e-200, 0.0], [1e308, 1e308], [3.0, 3.0]]
    ids = list(range(len(vecs)))
    ids[7] = None
    for k in (60, 61, 230, 240):  # ids with more than one vector
        ids[k] = ids[k + 5]
    rows = [(i, v, 0) for i, v in zip(ids, vecs)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, links int").repartition(3), block=block).toPandas()
    got = sorted(zip(got.vec_id.fillna(-1).astype(int), got.n_links, got.component_id.fillna(-1).astype(int)))
    assert got == brute(ids, vecs)


def test_empty(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    rng = np.random.default_rng(1)
    path = list(range(100, 140))
    edges = [(path[i], path[i + 1]) for i in range(39)] + [(5, k) for k in range(200, 260)] + [(7, 7), (300, 301), (301, 300)]
    mixed = rng.permutation(np.arange(1000, 1040)).tolist()
    edges += list(zip(mixed, mixed[1:]))
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 100 for k in path) and all(got[k] == 5 for k in range(200, 260))
    assert got[301] == 300 and all(got[k] == 1000 for k in mixed) and 7 not in got


def test_recall_near_the_threshold(spark):
    rng = np.random.default_rng(9)
    rows, pairs = [], 400
    for k in range(pairs):  # pairs of cosine 0.951 to 0.97 that are far from all others
        a, b = rng.standard_normal((2, 64))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        c = 0.951 + 0.019 * k / pairs
        rows += [(2 * k, a.tolist()), (2 * k + 1, (c * a + np.sqrt(1 - c * c) * b / np.linalg.norm(b)).tolist())]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).toPandas()
    linked = int((got.n_links > 0).sum()) // 2
    assert linked >= 0.99 * pairs and (got.component_id >= got.vec_id - 1).all()
