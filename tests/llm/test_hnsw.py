import numpy as np

from gridwx.llm import hnsw


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "?", 0) for i, v in rows], "vec_id long, embedding array<float>, id string, shard int").repartition(3)


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 24))
    data = (centres[rng.integers(0, 20, 1500)] + 0.5 * rng.normal(size=(1500, 24))).astype(np.float32)
    data[1200:1300] = data[7]  # one very common vector
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    rows += [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] * 24), (5003, [None] + [1.0] * 23), (5004, [float("inf")] * 24), (None, data[0].tolist())]
    result = hnsw.search_index(hnsw.build_index(hnsw.usable(frame(spark, rows), "vec_id", "embedding"), 400), hnsw.usable(frame(spark, rows), "vec_id", "embedding").where("id % 20 = 0")).collect()
    scores = data.astype(np.float64) @ data.astype(np.float64).T
    by_query = {}
    for r in result:
        by_query.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(by_query) == list(range(0, 1500, 20))
    hits = 0
    for q, found in by_query.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        assert all(abs(f[2] - scores[q, f[1]]) < 1e-9 for f in found)
        own = scores[q].copy()
        own[q] = -np.inf
        best = np.lexsort((np.arange(1500), -own))[:20]
        hits += sum(own[f[1]] >= own[best[-1]] for f in found)
        ordered = sorted(found, key=lambda f: (-f[2], f[1]))
        assert ordered == found
    assert hits / (20 * len(by_query)) >= 0.95


def test_fewer_candidates_than_asked(spark):
    found = hnsw.nearest(frame(spark, [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])]), "id % 20 = 0").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"])] == [(1, 1, 1.0), (2, 2, 0.0)]


def test_empty_table(spark):
    assert hnsw.nearest(frame(spark, [(0, [1.0])]).limit(0), "id % 20 = 0").count() == 0


def recall(rows: np.ndarray, width: int = hnsw.SEARCH_WIDTH, k: int = 20, spread: int = 0) -> float:
    """Recall of one graph per band of norms over every 20th row, ties counted as found."""
    norms = np.linalg.norm(rows, axis=1)
    bands = np.floor(np.log2(norms)).astype(int)
    found: dict[int, list] = {}
    asked = np.arange(0, len(rows), 20)
    for band in np.unique(bands):
        own = np.flatnonzero(bands == band)
        nodes = hnsw.build_graph(rows[own]).search((rows[asked] / np.abs(rows[asked]).max(1, keepdims=True)).astype(np.float32), width)
        for q, near in zip(asked.tolist(), nodes):
            found.setdefault(q, []).extend(own[near[near >= 0]].tolist())
    hits = 0
    for q in asked.tolist():
        scores = rows @ rows[q]
        scores[q] = -np.inf
        least = np.sort(scores)[-k]
        best = sorted((scores[v] for v in found[q] if v != q), reverse=True)[:k]
        hits += sum(s >= least for s in best)
    return hits / (k * len(asked))


def test_recall_with_unequal_norms():
    rng = np.random.default_rng(6)
    data = rng.normal(size=(3000, 24))
    assert recall(data) >= 0.95
    for factor in (1e2, 1e4, 1e6):
        one = data.copy()
        one[7] *= factor
        assert recall(one) >= 0.95
    assert recall(data * 10 ** rng.uniform(-3, 3, (3000, 1))) >= 0.95
    assert recall(data * 1e30) >= 0.95


def test_recall_in_separate_clusters():
    rng = np.random.default_rng(9)
    for clusters, noise in ((8, 0.05), (60, 0.1), (700, 0.02)):
        centres = rng.normal(size=(clusters, 32))
        data = centres[rng.integers(0, clusters, 5000)] + noise * rng.normal(size=(5000, 32))
        assert recall(data / np.linalg.norm(data, axis=1, keepdims=True)) >= 0.95


def test_bands_and_huge_components(spark):
    vectors = [[1.0, 0.0], [3.0, 4.0], [1e200, 1e200], [1e-200, 0.0], [0.75, 0.0]]
    rows = hnsw.usable(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>"), "vec_id", "embedding")
    bands = {r["id"]: r["band"] for r in hnsw.with_bands(rows).collect()}
    assert bands == {0: 0, 1: 2, 2: 664, 3: -665, 4: -1}
    found = hnsw.search_index(hnsw.build_index(rows), rows.where("id = 0")).orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == [2, 1, 4, 3]


def test_recall_of_vectors_that_differ_in_their_last_digits():
    rng = np.random.default_rng(5)
    for spread in (1e-3, 1e-5, 1e-7, 1e-9):
        centre = rng.normal(size=64)
        rows = centre / np.linalg.norm(centre) + spread * rng.normal(size=(3000, 64))
        assert recall(rows) >= 0.95, spread


def test_one_row_and_equal_rows_make_a_graph():
    for rows in (np.array([[3.0, 4.0]]), np.array([[1.0, 0.0], [1.0, 0.0]])):
        found = hnsw.build_graph(rows).search(np.array([[1.0, 1.0]], np.float32), 4)
        assert set(found[0][found[0] >= 0].tolist()) == set(range(len(rows)))
