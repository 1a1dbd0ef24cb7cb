"""Exact top-k search by inner product with an M-tree of integer vectors.

Equal vectors are one node, which keeps the least ids it can need (k + 1). The upper
tree is grown a level at a time on Spark: a region with more than ``SHARD_ROWS``
nodes gets routers (its nodes of least hash), every node goes to the nearest one,
in groups of bounded size, and each child keeps its router, covering radius,
greatest norm and the distance to its parent's router. A region that routers hardly
divide is dealt by hash; its radii are as right as any. Regions that are
small enough become shards: a task cuts one into metric pages of up to ``PAGE``
entries, with the distance of each entry to its page's router. Pages are a table in
the shared folder.

For integer inner products the bounds are those of the Euclidean metric,
q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2: a page with router c, radius r and greatest norm
N holds no score above (|q|^2 + N^2 - max(0, |q - c| - r)^2) / 2, and the distance
|q - c| itself need not be computed where | |q - p| - |c - p| | for the parent's router
p rules the page out already; the same for single entries of a leaf.

A search first visits the shard that each query lies in, which gives a k-th best
score to beat. Blocks of queries then go down the upper tree, and on to those shards
that may hold a better score for one of them. Inside a shard each query opens its
pages best bound first until no bound reaches its k-th best score. Each shard meets
the queries in groups of ``QUERY_BLOCK`` * ``BLOCKS_PER_PART``, so that its
pages travel once per group and not once per block.

Scores are exact: products are added in doubles where these hold every sum,
otherwise in 64-bit integers. Bounds allow for rounding and ties, so that results
equal those of a full scan.

Defined cases: vectors that are null or hold null or non-finite components, and rows
without id, take no part; zero and empty vectors do (score 0); vectors of another
length are no candidates; rows equal in id and vector count once, rows with one id
and different vectors are rows of their own (each is asked, and a candidate of the
other); equal scores go by id; fewer candidates than k give fewer rows; components are
held at 2^62 and scores at the range of a long; no rows give no rows; other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import ship_package, table
from ledgerline.operators.skew import lookup
from ledgerline.session import store

K = 5
SCALE = 256
SHARD_ROWS = 4_096
PAGE = 64
FAN = 256  # children of a region
ROWS_PER_PART = 50_000  # nodes that meet the routers of their region in one group
QUERY_BLOCK = 1_024
BLOCKS_PER_PART = 16
SLACK = 1e-7
EXACT = 1 << 53


# --- vectors in a task ----------------------------------------------------------


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of longs, exact where a long holds them, else at its limits."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(1, a.shape[1])
    near = a.astype(float) @ b.astype(float).T
    if most < EXACT:
        return near.astype(np.int64)
    exact = a @ b.T  # right modulo 2^64
    if most < 2.0**62:
        return exact
    return np.where(near > 2.0**63 - 2.0**11, np.iinfo(np.int64).max, np.where(near < -(2.0**63) + 2.0**11, np.iinfo(np.int64).min, exact))


def squares(a: np.ndarray) -> np.ndarray:
    a = a.astype(float)
    return (a * a).sum(axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between the rows of two matrices."""
    return np.sqrt(np.maximum(0, squares(a)[:, None] + squares(b)[None, :] - 2 * (a.astype(float) @ b.astype(float).T)))


def bound(q2: np.ndarray, n2: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Greatest inner product for squared norms ``q2`` and ``n2`` (at most) at distance ``apart`` (at least), and what rounding may add."""
    return (q2 + n2 - np.maximum(0, apart) ** 2) / 2 + SLACK * (q2 + n2)


# --- the pages of a shard ---------------------------------------------------------


@dataclass
class Page:
    parent: int
    router: int  # index of a vector, -1 at the root
    radius: float
    norm: float  # greatest squared norm
    parent_distance: float
    members: np.ndarray  # of a leaf, else empty
    member_distances: np.ndarray


def bulk_load(x: np.ndarray, page: int = PAGE) -> list[Page]:
    """Pages of a metric tree over the rows of ``x``, parents first. Deterministic."""
    norms, none = squares(x), np.zeros(0, np.int64)
    pages: list[Page] = []
    todo = [(np.arange(len(x)), -1, -1, np.zeros(len(x)), 0.0)]
    while todo:
        members, parent, router, apart, parent_distance = todo.pop()
        leaf = len(members) <= page
        pages.append(
            Page(
                parent, router, float(apart.max(initial=0)), float(norms[members].max(initial=0)), parent_distance,
                members if leaf else none, apart if leaf else none.astype(float),
            )
        )
        if leaf:
            continue
        me, count = len(pages) - 1, min(page, -(-2 * len(members) // page))
        picks = np.sort(np.random.default_rng(len(members)).choice(len(members), count, replace=False))
        all_apart = distances(x[members], x[members[picks]])
        nearest = all_apart.argmin(axis=1)
        if np.bincount(nearest).max() > len(members) // 2:  # routers do not tell them apart: slices by distance
            order = np.argsort(all_apart[:, 0], kind="stable")
            nearest[order] = np.arange(len(members)) // -(-len(members) // count)
            picks = order[:: -(-len(members) // count)]
        for at, pick in enumerate(members[picks]):
            some = members[nearest == at]
            if len(some):
                up = float(distances(x[[pick]], x[[router]])[0, 0]) if router >= 0 else 0.0
                todo.append((some, me, int(pick), distances(x[some], x[[pick]])[:, 0], up))
    return pages


@dataclass
class Shard:
    """Pages as a task holds them for searching."""

    x: np.ndarray  # all vectors, leaf by leaf
    ids: list[np.ndarray]  # least ids of each
    apart: np.ndarray  # distance to the page's router
    starts: np.ndarray  # where the members of each page start; one more at the end
    routers: np.ndarray
    has_router: np.ndarray
    radius: np.ndarray
    norm: np.ndarray
    parent_distance: np.ndarray
    children: list[np.ndarray]
    norms: np.ndarray = field(init=False)
    turn: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.norms = squares(self.x)
        self.turn = np.array([ids[0] for ids in self.ids], np.int64)


def best_first(shard: Shard, queries: np.ndarray, beat: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best nodes (-1: none) and scores of each query that reach ``beat``, and how many products and distances it took."""
    b, n_pages, computed = len(queries), len(shard.radius), 0
    q2 = squares(queries)
    beat = beat.astype(float).copy()
    open_ = np.full((b, n_pages), -np.inf)
    open_[:, 0] = np.inf
    to_router = np.zeros((b, n_pages))
    top = np.full((b, k), -1, np.int64)
    scores = np.zeros((b, k), np.int64)
    active = np.arange(b)
    while len(active):
        best = open_[active].argmax(axis=1)
        reach = open_[active, best]
        going = (reach > -np.inf) & (reach >= beat[active])
        active, best = active[going], best[going]
        for page in np.unique(best):
            asking = active[best == page]
            open_[asking, page] = -np.inf
            near = to_router[asking, page][:, None]
            children = shard.children[page]
            if len(children):
                least = np.abs(near - shard.parent_distance[children][None, :]) if shard.has_router[page] else np.zeros((len(asking), len(children)))
                may = bound(q2[asking][:, None], shard.norm[children][None, :], least - shard.radius[children][None, :]) >= beat[asking][:, None]
                some = may.any(axis=1)
                which = may.any(axis=0)
                asking, may, children = asking[some], may[some][:, which], children[which]
                if not len(asking) or not len(children):
                    continue
                found = distances(queries[asking], shard.routers[children])
                computed += int(may.sum())
                reach = bound(q2[asking][:, None], shard.norm[children][None, :], found - shard.radius[children][None, :])
                cells = np.ix_(asking, children)
                to_router[cells] = found
                open_[cells] = np.where(may & (reach >= beat[asking][:, None]), reach, -np.inf)
                continue
            members = np.arange(shard.starts[page], shard.starts[page + 1])
            least = np.abs(near - shard.apart[members][None, :]) if shard.has_router[page] else np.zeros((len(asking), len(members)))
            may = bound(q2[asking][:, None], shard.norms[members][None, :], least) >= beat[asking][:, None]
            some, which = may.any(axis=1), may.any(axis=0)
            asking, may, members = asking[some], may[some][:, which], members[which]
            if not len(asking) or not len(members):
                continue
            found = products(queries[asking], shard.x[members])
            computed += int(may.sum())
            # A score of no interest may come along; it is one of the query's all the same.
            nodes = np.concatenate((top[asking], np.broadcast_to(members, found.shape)), axis=1)
            values = np.concatenate((scores[asking], found), axis=1)
            turns = np.where(nodes < 0, np.iinfo(np.int64).max, shard.turn[nodes])
            order = np.argsort(turns, axis=1, kind="stable")
            values, nodes = np.take_along_axis(values, order, 1), np.take_along_axis(nodes, order, 1)
            # Descending without negating the least long, which has no opposite.
            order = np.argsort(np.where(nodes < 0, np.iinfo(np.int64).max, ~values), axis=1, kind="stable")
            # A missing node may tie with the least score: put it last.
            order = np.take_along_axis(order, np.argsort(np.take_along_axis(nodes, order, 1) < 0, axis=1, kind="stable"), 1)[:, :k]
            top[asking], scores[asking] = np.take_along_axis(nodes, order, 1), np.take_along_axis(values, order, 1)
            full = asking[top[asking, -1] >= 0]
            beat[full] = np.maximum(beat[full], scores[full, -1].astype(float))
    return top, scores, computed


# --- the upper tree ---------------------------------------------------------------


def integers(vector: Column) -> Column:
    """floor(256 * component) as longs; null where the vector takes no part."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    most = F.lit(2.0**62)
    return F.when(vector.isNotNull() & finite, F.transform(vector, lambda c: F.floor(F.greatest(F.least(c * SCALE, most), -most))))


def vector_key(x: Column) -> list[Column]:
    """Two hashes that stand for a vector."""
    return [F.xxhash64(x).alias("h1"), F.xxhash64(F.lit("vector"), x).alias("h2")]


def nodes_of(rows: DataFrame, asked: Column, k: int) -> DataFrame:
    """dim, x, ids (the k + 1 least), asked (whether a query has it) of each distinct vector of ``rows`` (vec_id, x), stored."""
    turn = F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))
    least = rows.select("x", "vec_id").distinct().withColumn("turn", turn).filter(F.col("turn") <= k + 1)
    nodes = least.groupBy("x").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    wanted = rows.filter(asked).select("x").distinct().withColumn("asked", F.lit(True))
    nodes = nodes.join(wanted, "x", "left")
    return store(nodes.select(F.size("x").alias("dim"), "x", "ids", F.coalesce("asked", F.lit(False)).alias("asked")), "tree-nodes")


def _tasks(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """``df`` dealt by key to a stated number of tasks, which adaptive execution does not merge."""
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(1, min(n, most)), *keys)


def _assign(routers: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    if not len(rows) or not len(routers):
        return pd.DataFrame(columns=["parent", "at", "distance", "x", "ids", "asked", "dim"])
    apart = distances(np.stack(rows["x"].to_numpy()), np.stack(routers["router"].iloc[0]))
    at = apart.argmin(axis=1)
    return pd.DataFrame(
        {
            "parent": rows["path"].to_numpy(), "at": at.astype(np.int32), "distance": apart[np.arange(len(at)), at],
            "x": rows["x"].to_numpy(), "ids": rows["ids"].to_numpy(), "asked": rows["asked"].to_numpy(), "dim": rows["dim"].to_numpy(),
        }
    )


ROW = "path string, dim int, x array<long>, ids array<long>, asked boolean"
ASSIGNED = "parent string, at int, distance double, x array<long>, ids array<long>, asked boolean, dim int"
CHILD = "parent string, path string, leaf boolean, router array<long>, radius double, norm double, parent_distance double"


def norm2(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))


def _apart(a: Column, b: Column) -> Column:
    return F.sqrt(norm2(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda p, q: p - q)))


def grow(nodes: DataFrame, shard_rows: int = SHARD_ROWS, fan: int = FAN, rows_per_part: int = ROWS_PER_PART) -> tuple[DataFrame, DataFrame, int]:
    """(nodes with the path of their shard, the children of all regions, number of levels), stored."""
    spark = nodes.sparkSession
    rows = nodes.select(F.col("dim").cast("string").alias("path"), "dim", "x", "ids", "asked")
    shards, children, routers_before, levels = spark.createDataFrame([], ROW), spark.createDataFrame([], CHILD), None, 0
    while True:
        counts = store(rows.groupBy("path").agg(F.count("*").alias("n")), "tree-counts")
        large = counts.filter(F.col("n") > shard_rows)
        if large.isEmpty():
            return store(shards.unionByName(rows), "tree-shards"), store(children, "tree-children"), levels
        levels += 1
        shards = shards.unionByName(rows.join(counts.filter(F.col("n") <= shard_rows), "path").drop("n"))
        rows = rows.join(large, "path")
        turn = F.row_number().over(Window.partitionBy("path").orderBy(F.xxhash64("x"), "x"))
        picked = rows.select("path", "n", "x").withColumn("turn", turn).filter(F.col("turn") <= fan)
        picked = picked.filter(F.col("turn") <= F.ceil(2 * F.col("n") / shard_rows))
        sorted_ = F.transform(F.array_sort(F.collect_list(F.struct("turn", "x"))), lambda r: r["x"])
        routers = store(picked.groupBy("path", "n").agg(sorted_.alias("router")), "tree-routers")
        parts = F.ceil(F.col("n") / rows_per_part)
        offered = routers.select("path", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), "router")
        dealt = rows.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "x"), parts)).drop("n")
        n_groups = offered.count()
        assigned = (
            _tasks(offered, n_groups, "path", "part").groupBy("path", "part")
            .cogroup(_tasks(dealt, n_groups, "path", "part").groupBy("path", "part"))
            .applyInPandas(_assign, ASSIGNED)
        )
        assigned = store(assigned, "tree-assigned")
        sizes = assigned.groupBy("parent", "at").agg(F.count("*").alias("n_child"))
        sizes = sizes.join(large.withColumnRenamed("path", "parent"), "parent")
        # A child with most of its parent is no progress.
        pieces = F.when((F.col("n_child") > F.col("n") / 2) & (F.col("n_child") > shard_rows), F.least(F.lit(fan).cast("long"), F.ceil(F.col("n_child") / shard_rows)))
        sizes = store(sizes.select("parent", "at", pieces.alias("pieces")), "tree-sizes")
        path = F.concat_ws("/", "parent", F.col("at").cast("string"))
        piece = F.concat(path, F.lit("~"), F.pmod(F.xxhash64(F.lit(levels), "x"), F.col("pieces")).cast("string"))
        named = assigned.join(sizes, ["parent", "at"]).withColumn("path", F.when(F.col("pieces").isNotNull(), piece).otherwise(path))
        grown = named.groupBy("parent", "at", "path").agg(
            F.max("distance").alias("radius"), F.max(norm2(F.col("x"))).alias("norm"), (F.count("*") <= shard_rows).alias("leaf")
        )
        each = routers.select(F.col("path").alias("parent"), F.posexplode("router").alias("at", "router"))
        grown = grown.join(each, ["parent", "at"])
        if routers_before is not None:
            grown = grown.join(routers_before, "parent", "left")
        else:
            grown = grown.withColumn("above", F.lit(None).cast("array<long>"))
        apart = F.when(F.col("above").isNotNull(), _apart(F.col("router"), F.col("above")))
        grown = store(grown.select("parent", "path", "leaf", "router", "radius", "norm", apart.alias("parent_distance")), "tree-level")
        routers_before = grown.select(F.col("path").alias("parent"), F.col("router").alias("above"))
        children = children.unionByName(grown)
        rows = named.select("path", "dim", "x", "ids", "asked")


PAGES = (
    "path string, page int, parent int, router array<long>, radius double, norm double, parent_distance double, "
    "x array<long>, ids array<long>, n_ids array<int>, apart array<double>, dim int"
)


def _pages(page: int):
    def load(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(first=pdf["ids"].map(lambda ids: ids[0])).sort_values("first", kind="stable")
        x, ids = np.stack(pdf["x"].to_numpy()).astype(np.int64), pdf["ids"].to_numpy()
        none = np.zeros(0, np.int64)
        out = []
        for at, p in enumerate(bulk_load(x, page)):
            held = [ids[m] for m in p.members]
            out.append(
                (
                    pdf["path"].iloc[0], at, p.parent, x[p.router] if p.router >= 0 else None, p.radius, p.norm, p.parent_distance,
                    x[p.members].ravel(), np.concatenate(held) if held else none, np.array([len(i) for i in held], np.int32), p.member_distances, x.shape[1],
                )
            )
        return pd.DataFrame(out, columns=[part.split()[0] for part in PAGES.split(", ")])

    return load


def build_pages(shards: DataFrame, page: int = PAGE) -> DataFrame:
    """The pages of all shards as a stored table."""
    ship_package(shards.sparkSession)
    n = shards.select("path").distinct().count()
    return store(_tasks(shards.select("path", "x", "ids"), n, "path").groupBy("path").applyInPandas(_pages(page), PAGES), "tree-pages")


def _held(pages: pd.DataFrame) -> Shard:
    pages = pages.sort_values("page").reset_index(drop=True)
    dim = int(pages["dim"].iloc[0])
    n_ids = np.concatenate(pages["n_ids"].to_list())
    ids = np.split(np.concatenate(pages["ids"].to_list()), np.cumsum(n_ids)[:-1])
    has_router = pages["router"].notna().to_numpy()
    parents = pages["parent"].to_numpy()
    return Shard(
        x=np.concatenate(pages["x"].to_list()).reshape(len(n_ids), dim).astype(np.int64), ids=ids, apart=np.concatenate(pages["apart"].to_list()),
        starts=np.concatenate(([0], np.cumsum([len(n) for n in pages["n_ids"]]))),
        routers=np.stack([r if some else np.zeros(dim, np.int64) for r, some in zip(pages["router"], has_router)]), has_router=has_router,
        radius=pages["radius"].to_numpy(), norm=pages["norm"].to_numpy(), parent_distance=pages["parent_distance"].to_numpy(),
        children=[np.flatnonzero(parents == p) for p in range(len(pages))],
    )


# --- searching ----------------------------------------------------------------------

FOUND = "h1 long, h2 long, score long, same boolean, ids array<long>"


def _results(shard: Shard, queries: pd.DataFrame, asked: np.ndarray, beat: np.ndarray, k: int) -> pd.DataFrame:
    top, scores, _ = best_first(shard, asked, beat, k)
    row, column = np.nonzero((top >= 0) & ((scores >= beat[:, None]) | ~np.isfinite(beat[:, None])))
    nodes = top[row, column]
    return pd.DataFrame(
        {
            "h1": queries["h1"].to_numpy()[row], "h2": queries["h2"].to_numpy()[row], "score": scores[row, column],
            "same": (shard.x[nodes] == asked[row]).all(axis=1), "ids": [shard.ids[n] for n in nodes],
        }
    )


def _at_home(k: int):
    def search(pages: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(pages) or not len(queries):
            return pd.DataFrame(columns=["h1", "h2", "score", "same", "ids"])
        asked = np.stack(queries["x"].to_numpy()).astype(np.int64)
        return _results(_held(pages), queries, asked, np.full(len(asked), -np.inf), k)

    return search


def _unpacked(block: pd.Series) -> tuple[np.ndarray, np.ndarray, pd.DataFrame]:
    """Vectors, scores to beat, and (h1, h2, home) of the queries of a block."""
    frame = pd.DataFrame({name: list(block[name]) for name in ("h1", "h2", "home")})
    beat = np.array([-np.inf if b is None or np.isnan(b) else b for b in block["beat"]], float)
    return np.array([list(x) for x in block["x"]], np.int64).reshape(len(frame), -1), beat, frame


def _down(children: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
    """Which children each block goes on to: those that may hold a score one of its queries lacks."""
    if not len(children) or not len(blocks):
        return pd.DataFrame(columns=["block", "path", "leaf"])
    children = children.reset_index(drop=True)
    routers, radius, norm = np.stack(children["router"].to_numpy()), children["radius"].to_numpy(), children["norm"].to_numpy()
    out = []
    for _, block in blocks.iterrows():
        x, beat, _ = _unpacked(block)
        reach = bound(squares(x)[:, None], norm[None, :], distances(x, routers) - radius[None, :])
        some = np.flatnonzero((reach >= beat[:, None]).any(axis=0))
        out.append(pd.DataFrame({"block": block["block"], "path": children["child"].iloc[some], "leaf": children["leaf"].iloc[some]}))
    return pd.concat(out)


def _away(k: int):
    def search(pages: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        columns = ["h1", "h2", "score", "same", "ids"]
        if not len(pages) or not len(blocks):
            return pd.DataFrame(columns=columns)
        shard, path = _held(pages), pages["path"].iloc[0]
        out = []
        for _, block in blocks.iterrows():
            x, beat, queries = _unpacked(block)
            away = (queries["home"] != path).to_numpy()
            if away.any():
                out.append(_results(shard, queries[away], x[away], beat[away], k))
        return pd.concat(out)[columns] if out else pd.DataFrame(columns=columns)

    return search


def _met(left: DataFrame, blocks: DataFrame, pairs: DataFrame, function, schema: str) -> DataFrame:
    """``function`` of the rows of ``left`` (path) and the blocks that ``pairs`` (block, path, part) send there, in groups of bounded size."""
    groups = store(pairs.select("path", "part").distinct(), "tree-groups")
    n = groups.count()
    offered, sent = left.join(groups, "path"), pairs.join(blocks, "block")
    return _tasks(offered, n, "path", "part").groupBy("path", "part").cogroup(_tasks(sent, n, "path", "part").groupBy("path", "part")).applyInPandas(function, schema)


def search(
    rows: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, shard_rows: int = SHARD_ROWS,
    page: int = PAGE, fan: int = FAN, query_block: int = QUERY_BLOCK, rows_per_part: int = ROWS_PER_PART,
) -> DataFrame:
    """query_id, rank, vec_id, score of the k greatest inner products of all ``rows`` for those that ``queries`` (a condition on ``vec_id``) picks."""
    spark = rows.sparkSession
    ship_package(spark)
    named = rows.select(F.col(id_col).cast("long").alias("vec_id"), integers(F.col(vector_col).cast("array<double>")).alias("x"))
    named = named.filter("vec_id IS NOT NULL AND x IS NOT NULL")
    shards, children, levels = grow(nodes_of(named, queries, k), shard_rows, fan, rows_per_part)
    pages = build_pages(shards, page)

    # Each query in the shard it lies in; a shard has at most as many distinct queries as nodes.
    asked = shards.filter("asked").select("path", "dim", "x", *vector_key(F.col("x")))
    n = max(1, pages.filter("page = 0").count())
    at_home = (
        _tasks(pages, n, "path").groupBy("path").cogroup(_tasks(asked, n, "path").groupBy("path")).applyInPandas(_at_home(k + 1), FOUND)
    )
    at_home = store(at_home, "tree-home")
    if not levels:
        return _ranked(at_home, named, queries, k)

    beat = at_home.groupBy("h1", "h2").agg(F.when(F.count("*") > k, F.min("score")).cast("double").alias("beat"))
    above = F.regexp_replace("path", "/[^/]*$", "")
    waiting = store(asked.join(beat, ["h1", "h2"], "left").withColumn("above", above), "tree-waiting")
    counts = waiting.groupBy("above").agg(F.ceil(F.count("*") / query_block).alias("pieces"))
    blocked = waiting.join(counts, "above").withColumn("block", F.concat_ws("#", "above", F.pmod(F.xxhash64("path"), "pieces").cast("string")))
    one = F.struct("h1", "h2", F.col("path").alias("home"), "beat", "x")
    blocks = blocked.groupBy("block", "dim").agg(F.collect_list(one).alias("q"))
    blocks = store(blocks.select("block", "dim", *(F.col("q")[name].alias(name) for name in ("h1", "h2", "home", "beat", "x"))), "tree-blocks")
    parts = max(1, -(-blocks.count() // BLOCKS_PER_PART))
    part = F.pmod(F.xxhash64("block"), F.lit(parts))

    roots = children.select(F.col("parent").alias("path")).distinct()
    below = children.select(F.col("parent").alias("path"), F.col("path").alias("child"), "leaf", "router", "radius", "norm")
    frontier = blocks.select("block", F.col("dim").cast("string").alias("path"))
    leaves = frontier.join(roots, "path", "left_anti").select("block", "path")  # lengths that are one shard
    for _ in range(levels):
        pairs = frontier.join(roots, "path", "left_semi").withColumn("part", part)
        met = store(_met(below, blocks, pairs, _down, "block string, path string, leaf boolean"), "tree-frontier")
        leaves = leaves.unionByName(met.filter("leaf").select("block", "path"))
        frontier = met.filter("NOT leaf").select("block", "path")
    away = _met(pages, blocks, store(leaves.withColumn("part", part), "tree-leaves"), _away(k + 1), FOUND)
    return _ranked(at_home.unionByName(store(away, "tree-away")), named, queries, k)


def _ranked(found: DataFrame, named: DataFrame, queries: Column, k: int) -> DataFrame:
    """The k best of what was found for each query, without itself."""
    each = found.select("h1", "h2", "score", "same", F.explode("ids").alias("vec_id"))
    turn = F.row_number().over(Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id", F.desc("same")))
    best = each.withColumn("turn", turn).filter(F.col("turn") <= k + 1)
    lists = best.groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct("turn", "vec_id", "score", "same"))).alias("best"))
    asked = named.filter(queries).select(F.col("vec_id").alias("query_id"), *vector_key(F.col("x"))).distinct()
    sizes = asked.groupBy("h1", "h2").agg(F.count("*").alias("n_rows"))
    joined = lookup(asked, lists.join(sizes, ["h1", "h2"]), ["h1", "h2"], ["query_id"])
    others = F.slice(F.filter("best", lambda b: ~(b["same"] & (b["vec_id"] == F.col("query_id")))), 1, k)
    ranked = joined.select("query_id", F.posexplode(others).alias("at", "b"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def op11_metric_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
