import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import metric_tree as T

ROWS = "vec_id long, embedding array<double>, path string, x int, h1 int, rank int"


def brute(data, picked, k):
    """(query_id, rank, vec_id, score) of a full scan, over distinct usable rows, in Python's integers."""
    rows = set()
    for i, v in data:
        if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v):
            rows.add((i, tuple(int(np.floor(256 * c)) for c in v)))
    out = []
    for i, q in rows:
        if picked(i):
            scores = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in rows if (j, x) != (i, q) and len(x) == len(q))
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def frame(spark, data):
    return spark.createDataFrame([(i, v, "p", 1, 2, 3) for i, v in data], ROWS).repartition(4)


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 40, "page": 8, "query_block": 5}, {"shard_rows": 12, "page": 4, "fan": 3, "query_block": 4, "rows_per_part": 30}])
def test_equals_a_full_scan(spark, rows, sizes):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 5))
    vectors = (centres[rng.integers(0, 6, 150)] + 0.05 * rng.normal(size=(150, 5))).tolist()
    data = list(enumerate(vectors))
    data += [(200 + k, vectors[0]) for k in range(60)] + [(0, vectors[0]), (7, vectors[7])] * 3  # copies and repeated rows
    data += [(10, vectors[11]), (20, [0.0] * 5), (21, [0.0] * 5), (30, [1e-9] * 5)]  # an id with two vectors, zeros, ties
    data += [(300, None), (310, [None] * 5), (320, [float("nan")] * 5), (330, [float("inf")] * 5), (None, vectors[1])]
    data += [(400, [1.0, 2.0]), (410, [2.0, 1.0]), (420, [3.0]), (430, []), (440, [])]  # other lengths
    got = rows(T.search(frame(spark, data), F.col("vec_id") % 10 == 0, **sizes), "query_id", "rank", "vec_id", "score")
    assert sorted(got) == brute(data, lambda i: i % 10 == 0, 5)


def test_vectors_that_routers_do_not_tell_apart(spark, rows):
    data = [(k, [float(k == j) for j in range(90)]) for k in range(90)]  # all at one distance of each other
    got = rows(T.search(frame(spark, data), F.col("vec_id") % 10 == 0, shard_rows=10, page=4, fan=4), "query_id", "rank", "vec_id", "score")
    assert sorted(got) == brute(data, lambda i: i % 10 == 0, 5)


def test_few_and_no_rows(spark, rows):
    columns = ("query_id", "rank", "vec_id", "score")
    assert rows(T.search(frame(spark, [(0, [1.0, 2.0]), (3, [0.5, 0.1])]), F.col("vec_id") % 10 == 0), *columns) == brute([(0, [1.0, 2.0]), (3, [0.5, 0.1])], lambda i: i == 0, 5)
    assert rows(T.search(frame(spark, [(0, [1.0, 2.0])]), F.col("vec_id") % 10 == 0), *columns) == []
    assert rows(T.search(spark.createDataFrame([], ROWS), F.col("vec_id") % 10 == 0), *columns) == []


def test_large_components(spark, rows):
    rng = np.random.default_rng(4)
    data = [(k, (rng.normal(size=4) * 1e6).tolist()) for k in range(60)]
    got = rows(T.search(frame(spark, data), F.col("vec_id") % 10 == 0, shard_rows=20, page=4), "query_id", "rank", "vec_id", "score")
    assert sorted(got) == brute(data, lambda i: i % 10 == 0, 5)
    top = np.iinfo(np.int64).max
    assert T.products(np.array([[1 << 62, 5]]), np.array([[4, 0], [-4, 0]])).tolist() == [[top, -top - 1]]


def test_every_given_query(spark):
    data = "/root/testdata/sf0.1"
    got = {}
    for r in T.op11_metric_tree(spark, data).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    table = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.floor(256 * np.array([r["embedding"] for r in table], float)).astype(np.int64)
    ids = np.array([r["vec_id"] for r in table])
    assert set(got) == set(ids[ids % 50 == 0])
    for at in np.flatnonzero(ids % 50 == 0):
        scores = x @ x[at]
        best = sorted((-int(s), int(j)) for s, j in zip(scores, ids) if j != ids[at])[:5]
        assert sorted(got[ids[at]]) == [(rank, s, j) for rank, (s, j) in enumerate(best, 1)]


def test_bounds_save_work():
    rng = np.random.default_rng(2)
    centres = rng.integers(-300, 300, size=(40, 16))
    x = (centres[rng.integers(0, 40, 3000)] + rng.integers(-9, 10, size=(3000, 16))).astype(np.int64)
    x = np.unique(x, axis=0)
    rng.shuffle(x)
    pages = T.bulk_load(x, 32)
    leaves = [p for p in pages if len(p.members)]
    assert sorted(np.concatenate([p.members for p in leaves])) == list(range(len(x))) and max(len(p.members) for p in leaves) <= 32
    order = np.concatenate([p.members for p in pages if len(p.members)]).astype(int)
    starts = np.concatenate(([0], np.cumsum([len(p.members) for p in pages])))
    shard = T.Shard(
        x=x[order], ids=[np.array([i]) for i in order], apart=np.concatenate([p.member_distances for p in pages]), starts=starts,
        routers=np.stack([x[p.router] for p in pages]), has_router=np.array([p.router >= 0 for p in pages]), radius=np.array([p.radius for p in pages]),
        norm=np.array([p.norm for p in pages]), parent_distance=np.array([p.parent_distance for p in pages]),
        children=[np.flatnonzero([p.parent == k for p in pages]) for k in range(len(pages))],
    )
    asked = x[:50]
    top, scores, computed = T.best_first(shard, asked, np.full(50, -np.inf), 6)
    for row in range(50):
        wanted = sorted((-int(s), i) for i, s in enumerate(x @ asked[row]))[:6]
        assert [(-int(s), int(order[n])) for s, n in zip(scores[row], top[row])] == wanted
    assert computed < 50 * len(x) / 3
