"""Approximate nearest neighbours with a robust-pruned directed graph for each shard.

Equal vectors are one node, which keeps the least ids it can need (k + 1), so a
vector that a third of all rows share is one node and a graph never drowns in
copies. Nodes are dealt by hash to shards of about ``SHARD_ROWS``; a task builds a
shard's graph in rounds that double it: a beam search in the graph so far proposes
neighbours for a batch of nodes, and relaxed pruning keeps the nearest one and
drops those which a kept one is ``ALPHA`` times nearer to. Edges are added in both
directions, and a node with too many is pruned again. Graphs are a table in the
shared folder (node, vector, neighbours), so searching reads them again from any
executor.

Every query searches every shard, in blocks of ``QUERY_BLOCK`` queries: a task gets
one graph and one block, walks all its queries at once, and returns the nearest
k + 1 nodes of each. Scores are cosines in double precision on the original
vectors. Memory: one shard and one block.

Defined cases: vectors that are null, zero or hold null or non-finite components,
and rows without id, take no part; vectors of another length are no candidates;
repeated rows (id and vector) count once; equal vectors tie and go by id; fewer
candidates than k give fewer rows; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import ship_package, table
from ledgerline.session import store

K = 5
SHARD_ROWS = 4096
QUERY_BLOCK = 2048
DEGREE, BEAM, ALPHA = 32, 80, 1.2
BATCH = 256


def beam_search(vectors: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy searches of unit vectors for a batch of queries: node ids (-1: none) and distances, nearest first."""
    n, rows = len(queries), np.arange(len(queries))
    ids = np.full((n, beam), -1, np.int64)
    near = np.full((n, beam), np.inf, np.float32)
    done = np.zeros((n, beam), bool)
    seen = np.zeros((n, len(vectors) + 1), bool)  # the last column takes the missing neighbours
    ids[:, 0] = start
    near[:, 0] = 1 - queries @ vectors[start]
    seen[:, start] = seen[:, -1] = True
    active = rows
    while len(active):
        open_ = np.where(done[active] | (ids[active] < 0), np.inf, near[active])
        best = open_.argmin(axis=1)
        going = np.isfinite(open_[np.arange(len(active)), best])
        active, best = active[going], best[going]
        if not len(active):
            break
        done[active, best] = True
        nodes = edges[ids[active, best]]
        fresh = ~seen[active[:, None], nodes]
        distance = 1 - np.einsum("ard,ad->ar", vectors[nodes], queries[active])
        distance = np.where(fresh, distance, np.inf).astype(np.float32)
        seen[active[:, None], nodes] = True
        all_ids = np.concatenate((ids[active], np.where(fresh, nodes, -1)), axis=1)
        all_near = np.concatenate((near[active], distance), axis=1)
        all_done = np.concatenate((done[active], np.zeros_like(fresh)), axis=1)
        order = np.argsort(all_near, axis=1, kind="stable")[:, :beam]
        ids[active] = np.take_along_axis(all_ids, order, 1)
        near[active] = np.take_along_axis(all_near, order, 1)
        done[active] = np.take_along_axis(all_done, order, 1)
    return ids, near


def robust_prune(vectors: np.ndarray, points: np.ndarray, ids: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Neighbours (-1: none) for each point from its candidates (-1: none)."""
    own = vectors[points]
    there = vectors[ids]
    to_point = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("bcd,bd->bc", there, own)))
    to_point = np.where((ids < 0) | (ids == points[:, None]), np.inf, to_point)
    order = np.argsort(to_point, axis=1, kind="stable")
    ids, to_point = np.take_along_axis(ids, order, 1), np.take_along_axis(to_point, order, 1)
    there = vectors[ids]
    between = np.sqrt(np.maximum(0, 2 - 2 * there @ there.transpose(0, 2, 1)))
    # A candidate met twice is the second time at distance 0 of the first, and goes.
    alive = np.isfinite(to_point)
    out = np.full((len(points), degree), -1, np.int64)
    rows = np.arange(len(points))
    for k in range(degree):
        first = alive.argmax(axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        out[some, k] = ids[rows, first][some]
        alive &= ~(some[:, None] & (alpha * between[rows, first] <= to_point))
        alive[rows, first] = False
    return out


def build_graph(vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """Edges (node by degree, -1: none) of unit vectors, and the node to start from. Deterministic."""
    n = len(vectors)
    centre = vectors.mean(axis=0)
    start = int((vectors @ centre).argmax())
    edges = np.full((n, degree), -1, np.int64)
    order = np.random.default_rng(n).permutation(n)
    order = np.concatenate(([start], order[order != start]))
    at = 1
    while at < n:
        batch = order[at : at + min(BATCH, at)]
        found, _ = beam_search(vectors, edges, start, vectors[batch], beam)
        kept = robust_prune(vectors, batch, found, degree, alpha)
        edges[batch] = kept
        # The same edges the other way.
        source, target = np.repeat(batch, degree), kept.ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        ends, starts = np.unique(target, return_index=True)
        crowded, lists = [], []
        for node, new in zip(ends, np.split(source, starts[1:])):
            have = edges[node][edges[node] >= 0]
            both = np.concatenate((have, new))
            if len(both) <= degree:
                edges[node, : len(both)] = both
            else:
                crowded.append(node)
                lists.append(both)
        if crowded:
            width = max(map(len, lists))
            padded = np.full((len(lists), width), -1, np.int64)
            for k, one in enumerate(lists):
                padded[k, : len(one)] = one
            edges[crowded] = robust_prune(vectors, np.array(crowded), padded, degree, alpha)
        at += len(batch)
    return edges, start


def usable(vector: Column) -> Column:
    """Not null, not zero, all components there and finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nodes_of(rows: DataFrame, k: int) -> DataFrame:
    """dim, vector, ids (the k + 1 least) of each distinct vector of ``rows`` (vec_id, vector), stored."""
    distinct = rows.groupBy("vector", "vec_id").agg(F.lit(1).alias("one"))
    turn = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    least = distinct.withColumn("turn", turn).filter(F.col("turn") <= k + 1)
    nodes = least.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return store(nodes.select(F.size("vector").alias("dim"), "vector", "ids"), "graph-nodes")


def _tasks(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """``df`` dealt by key to a stated number of tasks, which adaptive execution does not merge."""
    return df.repartition(max(1, min(n, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))), *keys)


GRAPH = "dim int, shard long, node int, start int, vector array<double>, ids array<long>, edges array<int>"


def build_graphs(nodes: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The graphs of all shards as a stored table."""
    ship_package(nodes.sparkSession)
    shards = store(nodes.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).alias("n_shards")), "graph-sizes")
    n_graphs = shards.agg(F.sum("n_shards")).first()[0] or 1
    dealt = nodes.join(shards, "dim").withColumn("shard", F.pmod(F.xxhash64("vector"), "n_shards")).drop("n_shards")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(first=pdf["ids"].map(lambda ids: ids[0])).sort_values("first").drop(columns="first").reset_index(drop=True)
        vectors = np.stack(pdf["vector"].to_numpy())
        unit = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)
        edges, start = build_graph(unit)
        return pdf.assign(node=np.arange(len(pdf)), start=start, edges=[e[e >= 0].tolist() for e in edges])[["dim", "shard", "node", "start", "vector", "ids", "edges"]]

    return store(_tasks(dealt, n_graphs, "dim", "shard").groupBy("dim", "shard").applyInPandas(build, GRAPH), "graph-shards")


def _search(k: int, beam: int):
    def search(graph: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "query", "ids", "score"]
        if not len(graph) or not len(queries):
            return pd.DataFrame(columns=columns)
        graph = graph.sort_values("node")
        vectors = np.stack(graph["vector"].to_numpy())
        norms = np.linalg.norm(vectors, axis=1)
        unit = (vectors / norms[:, None]).astype(np.float32)
        edges = np.full((len(graph), DEGREE), -1, np.int64)
        for node, out in enumerate(graph["edges"]):
            edges[node, : len(out)] = out
        asked = np.stack(queries["vector"].to_numpy())
        asked_norms = np.linalg.norm(asked, axis=1)
        parts = []
        all_ids = graph["ids"].to_numpy()
        batch = max(1, BATCH * BEAM // max(beam, BEAM))
        for at in range(0, len(asked), batch):
            part = slice(at, at + batch)
            wanted = (asked[part] / asked_norms[part, None]).astype(np.float32)
            if beam < len(graph):
                found, _ = beam_search(unit, edges, int(graph["start"].iloc[0]), wanted, beam)
            else:  # a beam as wide as the shard: all nodes, reached by an edge or not
                found = np.tile(np.arange(len(graph)), (len(wanted), 1))
            # Exact scores of the whole beam, then the best.
            exact = np.einsum("bcd,bd->bc", vectors[found], asked[part]) / (norms[found] * asked_norms[part, None])
            exact = np.where(found < 0, -np.inf, exact)
            first = np.argsort(-exact, axis=1, kind="stable")[:, : k + 1]
            scores, nodes = np.take_along_axis(exact, first, 1), np.take_along_axis(found, first, 1)
            row, column = np.nonzero(nodes >= 0)
            parts.append(
                pd.DataFrame(
                    {
                        "query_id": queries["query_id"].to_numpy()[part][row], "query": queries["query"].to_numpy()[part][row],
                        "ids": all_ids[nodes[row, column]], "score": scores[row, column],
                    }
                )
            )
        return pd.concat(parts)[columns]

    return search


def nearest(graphs: DataFrame, queries: DataFrame, k: int = K, beam: int = BEAM, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each of ``queries`` (query_id, vector).

    The beam is widened to twice the nodes that ``k`` and the query itself ask of a shard.
    """
    beam = max(beam, 2 * (k + 1))
    ship_package(graphs.sparkSession)
    queries = store(queries.select("query_id", "vector").distinct().withColumns({"dim": F.size("vector"), "query": F.xxhash64("vector")}), "graph-queries")
    n_blocks = max(1, -(-queries.count() // query_block))
    shards = store(graphs.select("dim", "shard").distinct(), "graph-shard-names")
    block = F.pmod(F.xxhash64("query_id", "query"), F.lit(n_blocks))
    asked = queries.withColumn("block", block).join(shards, "dim")
    offered = graphs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    n_groups = shards.count() * n_blocks
    found = (
        _tasks(offered, n_groups, "dim", "shard", "block").groupBy("dim", "shard", "block")
        .cogroup(_tasks(asked, n_groups, "dim", "shard", "block").groupBy("dim", "shard", "block"))
        .applyInPandas(_search(k, beam), "query_id long, query long, ids array<long>, score double")
    )
    each = found.select("query_id", "query", F.explode("ids").alias("vec_id"), "score").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search(rows: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK, beam: int = BEAM) -> DataFrame:
    """The k nearest of all ``rows`` for those that ``queries`` (a condition on ``vec_id``) picks."""
    vectors = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    vectors = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    graphs = build_graphs(nodes_of(vectors, k), shard_rows)
    return nearest(graphs, vectors.filter(queries).select(F.col("vec_id").alias("query_id"), "vector"), k, beam, query_block)


def op2_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
