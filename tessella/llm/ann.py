"""Approximate nearest neighbours by inner product over a hierarchical k-means tree.

The tree is fitted on a bounded sample: every node splits its vectors by
k-means until a leaf is small.  Where many of the table's rows fall into one
leaf, executors fit a subtree for it on a sample of its own rows, so that the
number of leaves follows the number of rows.  Every row is indexed in one leaf.  A query
walks the tree best bin first: a priority queue holds the branches not taken,
and the nearest is opened next, until so many leaves are visited as calibrated
queries needed for the recall that is asked for and they hold k rows or all
there are.  Inner products become
distances by one more component, sqrt(M^2 - |x|^2), with M the largest norm of
all rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, release, save


@dataclass(frozen=True)
class AnnParams:
    """sample_rows bounds the fit, calibration_queries the brute-force comparison (each against all rows).

    leaf_rows: of the sample, not of the table; recall: mean recall that the
    calibrated number of leaves must reach.  block_rows: rows of a leaf that
    are compared at once; larger leaves are several blocks.  leaf_most: rows of
    the table in a leaf from which on it gets a subtree, as long as there are
    fewer than max_leaves, which bounds the tree that is broadcast.
    """

    k: int = 20
    sample_rows: int = 20_000
    branch: int = 8
    leaf_rows: int = 100
    rounds: int = 8
    recall: float = 0.97
    calibration_queries: int = 100
    block_rows: int = 2_000
    leaf_most: int = 4_000
    max_leaves: int = 40_000
    seed: int = 42


@dataclass(frozen=True)
class Tree:
    """child[i]: first and number of node i's children (0: a leaf), centre of every node, leaf number of leaves."""

    centre: np.ndarray
    child: np.ndarray
    leaf: np.ndarray
    norm2: float  # M^2
    leaves: int
    scale: float = 1.0  # of vectors whose squares could overflow


def usable(v: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return v.isNotNull() & F.forall(v, ok) & F.exists(v, lambda x: x != 0)


def _lift(x: np.ndarray, norm2: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(0.0, norm2 - (x * x).sum(1)))
    return np.concatenate([x, rest[:, None]], axis=1)


def build_tree(sample: np.ndarray, norm2: float, p: AnnParams = AnnParams(), scale: float = 1.0) -> Tree:
    rng = np.random.default_rng(p.seed)
    x = _lift(sample * scale, norm2)
    centre, child, leaf, todo, leaves = [x.mean(0) if len(x) else np.zeros(x.shape[1])], [[0, 0]], [-1], [(0, np.arange(len(x)))], 0
    while todo:
        node, rows = todo.pop()
        part = x[rows]
        k = min(p.branch, len(rows))
        own = None
        if len(rows) > p.leaf_rows:
            c = part[rng.choice(len(rows), k, replace=False)]
            for _ in range(p.rounds):
                own = ((c * c).sum(1) - 2 * part @ c.T).argmin(1)
                n = np.bincount(own, minlength=k)
                total = np.zeros_like(c)
                np.add.at(total, own, part)
                c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
            own = ((c * c).sum(1) - 2 * part @ c.T).argmin(1)
            if np.bincount(own, minlength=k).max() == len(rows):  # all alike
                own = None
        if own is None:
            leaf[node], leaves = leaves, leaves + 1
            continue
        used = np.unique(own)
        child[node] = [len(centre), len(used)]
        for i in used:
            todo.append((len(centre), rows[own == i]))
            centre.append(c[i])
            child.append([0, 0])
            leaf.append(-1)
    return Tree(np.array(centre), np.array(child), np.array(leaf), norm2, leaves, scale)


def spliced(tree: Tree, parts: dict[int, Tree]) -> Tree:
    """``tree`` with subtrees in place of some leaves; leaves are numbered anew."""
    centre, child, leaf, leaves = [tree.centre], tree.child.copy(), tree.leaf.copy(), 0
    children, marks, n = [child], [leaf], len(tree.centre)
    for node in np.flatnonzero(tree.leaf >= 0):
        part = parts.get(int(tree.leaf[node]))
        if part is None or part.leaves < 2:
            leaf[node], leaves = leaves, leaves + 1
            continue
        # node 0 of the part is this node; its other nodes follow all there are
        moved = part.child.copy()
        moved[moved[:, 1] > 0, 0] += n - 1
        child[node], leaf[node] = moved[0], -1
        children.append(moved[1:])
        centre.append(part.centre[1:])
        marks.append(np.where(part.leaf[1:] >= 0, part.leaf[1:] + leaves, -1))
        leaves, n = leaves + part.leaves, n + len(moved) - 1
    return Tree(np.concatenate(centre), np.concatenate(children), np.concatenate(marks), tree.norm2, leaves, tree.scale)


def leaf_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Leaf of each row, all rows going down level by level."""
    at = np.zeros(len(x), np.int64)
    y = _lift(x * tree.scale, tree.norm2)
    while True:
        open_ = np.nonzero(tree.child[at, 1])[0]
        if not len(open_):
            return tree.leaf[at]
        for node in np.unique(at[open_]):
            rows = open_[at[open_] == node]
            first, n = tree.child[node]
            c = tree.centre[first : first + n]
            at[rows] = first + ((c * c).sum(1) - 2 * y[rows] @ c.T).argmin(1)


def best_bins(tree: Tree, q: np.ndarray) -> Iterator[int]:
    """All leaves in best-bin-first order for one query."""
    y = np.append(q * tree.scale, 0.0)
    queue = [(0.0, 0)]
    while queue:
        _, node = heapq.heappop(queue)
        first, n = tree.child[node]
        if not n:
            yield int(tree.leaf[node])
            continue
        c = tree.centre[first : first + n] - y
        for d, i in zip((c * c).sum(1).tolist(), range(first, first + n), strict=True):
            heapq.heappush(queue, (d, i))


def leaves_of(tree: Tree, q: np.ndarray, visits: int, held: np.ndarray, need: int) -> list[int]:
    """The first ``visits`` leaves for one query, and more until they hold ``need`` rows.  ``held``: rows of each leaf."""
    out, rows = [], 0
    for leaf in best_bins(tree, q):
        out.append(leaf)
        rows += int(held[leaf])
        if len(out) >= visits and rows >= need:
            break
    return out


def _score(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows, each summed in the same order wherever it stands."""
    return (x * q).sum(axis=1)


def _compare(k: int, scale: float = 1.0):
    """Best k of a block of rows for every query of a block of queries: highest score, then smallest id.

    A matrix product finds all that can be among them; these are scored one by
    one, so that rows tie where their scores are equal and nowhere else.
    """

    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        qids, found, scores = [], [], []
        if len(rows) and len(queries):
            x = np.stack(rows["v"].to_numpy()).astype(np.float64) * scale
            ids = rows["vec_id"].to_numpy(np.int64)
            slack = 1e-12 * np.linalg.norm(x, axis=1)
            for at in range(0, len(queries), 256):
                part = queries.iloc[at : at + 256]
                q = np.stack(part["v"].to_numpy()).astype(np.float64) * scale
                for qid, one, s in zip(part["query_id"].tolist(), q, q @ x.T, strict=True):
                    s[ids == qid] = -np.inf
                    off = slack * np.linalg.norm(one)
                    some = np.flatnonzero(ids != qid)
                    if len(s) > 4 * k:
                        low = s - off
                        some = np.flatnonzero((s + off >= np.partition(low, len(s) - k)[len(s) - k]) & (ids != qid))
                    exact = _score(x[some], one)
                    best = np.lexsort((ids[some], -exact))[:k]
                    qids.append(np.full(len(best), qid))
                    found.append(ids[some[best]])
                    scores.append(exact[best])
        flat = lambda a, kind: np.concatenate(a).astype(kind) if a else np.zeros(0, kind)
        return pd.DataFrame({"query_id": flat(qids, np.int64), "vec_id": flat(found, np.int64), "score": flat(scores, np.float64)})

    return run


def _ranked(partial: DataFrame, k: int, scale: float = 1.0) -> DataFrame:
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = partial.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", (F.col("score") / scale / scale).alias("score") if scale != 1 else "score")


def brute_force(rows: DataFrame, queries: list[tuple[int, np.ndarray]], k: int, scale: float = 1.0) -> DataFrame:
    """Exact neighbours of a few stated queries, which every task holds."""
    held = rows.sparkSession.sparkContext.broadcast(pd.DataFrame({"query_id": [i for i, _ in queries], "v": [v for _, v in queries]}))
    compare = _compare(k, scale)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 4_000):
                yield compare(b.iloc[at : at + 4_000], held.value)

    return _ranked(rows.select("vec_id", "v").mapInPandas(run, "query_id long, vec_id long, score double"), k, scale)


def calibrate(tree: Tree, index: DataFrame, queries: list[tuple[int, np.ndarray]], p: AnnParams) -> int:
    """Fewest leaves that give the sample queries the recall asked for, against brute force over all rows."""
    truth = brute_force(index, queries, p.k, tree.scale).join(index.select("vec_id", "leaf"), "vec_id").select("query_id", "leaf").collect()  # calibration_queries * k rows
    held: dict[int, list[int]] = {}
    for r in truth:
        held.setdefault(r.query_id, []).append(r.leaf)
    ranks = []  # of each query with neighbours: how many leaves each of these asks for
    for qid, v in queries:
        place, open_ = {}, set(held.get(qid, ()))
        for i, leaf in enumerate(best_bins(tree, v) if open_ else ()):
            if leaf in open_:
                place[leaf] = i + 1
                open_.discard(leaf)
                if not open_:
                    break
        if place:
            ranks.append(np.sort([place[leaf] for leaf in held[qid]]))
    if not ranks:
        return 1
    for visits in np.unique(np.concatenate(ranks)).tolist():
        if np.mean([np.searchsorted(x, visits, "right") / len(x) for x in ranks]) >= p.recall:
            return int(visits)
    return tree.leaves


def _assigned(rows: DataFrame, tree: Tree, kind: str) -> DataFrame:
    """``rows`` (vec_id, v) with the leaf of each."""
    sent = rows.sparkSession.sparkContext.broadcast(tree)  # at most about max_leaves centres

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(leaf=leaf_of(sent.value, np.stack(b["v"].to_numpy()).astype(float)).astype(np.int32) if len(b) else np.zeros(0, np.int32))
        release()

    return rows.mapInPandas(assign, f"vec_id long, v {kind}, leaf int")


def grow(tree: Tree, rows: DataFrame, kind: str, p: AnnParams) -> Tree:
    """``tree`` with subtrees for leaves of more than leaf_most rows, fitted by executors on samples of those rows.

    A round multiplies a leaf at most by sample_rows / leaf_rows; rounds end when
    no leaf is too large, none can be parted, or max_leaves is reached.
    """
    while tree.leaves < p.max_leaves:
        placed = save(_assigned(rows, tree, kind), "ann-placed", "zstd")
        count = {r.leaf: r["count"] for r in placed.groupBy("leaf").count().collect()}  # a row for each leaf
        room = p.max_leaves - tree.leaves
        large = sorted((leaf for leaf, n in count.items() if n > p.leaf_most), key=lambda leaf: -count[leaf])
        wish = {leaf: min(p.sample_rows, p.leaf_rows * -(-count[leaf] // p.leaf_most) * 2) for leaf in large}
        while large and sum(wish[leaf] for leaf in large) // p.leaf_rows > room:
            large.pop()
        if not large:
            return tree
        shares = placed.sparkSession.createDataFrame([(leaf, wish[leaf] / count[leaf]) for leaf in large], "leaf int, share double")
        some = placed.join(F.broadcast(shares), "leaf").where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
        norm2, scale = tree.norm2, tree.scale

        def fit(b: pd.DataFrame) -> pd.DataFrame:
            t = build_tree(np.stack(b["v"].to_numpy()).astype(float), norm2, p, scale)
            return pd.DataFrame({"leaf": [b["leaf"].iloc[0]], "centre": [t.centre.tobytes()], "child": [t.child.astype(np.int64).tobytes()], "mark": [t.leaf.astype(np.int64).tobytes()]})

        dim = tree.centre.shape[1]
        parts = {}
        for r in some.groupBy("leaf").applyInPandas(fit, "leaf int, centre binary, child binary, mark binary").collect():  # fewer centres than max_leaves asks for
            mark = np.frombuffer(r.mark, np.int64)
            parts[r.leaf] = Tree(np.frombuffer(r.centre).reshape(-1, dim), np.frombuffer(r.child, np.int64).reshape(-1, 2), mark, norm2, int(mark.max()) + 1, scale)
        before, tree = tree.leaves, spliced(tree, parts)
        if tree.leaves == before:
            return tree
    return tree


def search(vectors: DataFrame, is_query: Column, p: AnnParams = AnnParams()) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row where ``is_query`` holds.

    ``vectors`` has vec_id and embedding.  Vectors that are null, zero or hold
    null or non-finite components take no part, nor rows with a null vec_id;
    vectors of different lengths have no product and are searched apart.  A
    repeated vec_id with an equal vector counts once.  Of equal vectors only
    the k + 1 smallest ids can be among anyone's k nearest, so only these are
    compared; a group of equal vectors is cut down before each shuffle.
    Ties go to the smaller vec_id.  Fewer candidates than k: all of them.
    Products beyond the range of a double are ranked by size and told as
    infinite.  Other columns of ``vectors`` are not looked at.
    """
    spark = bounded(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), is_query.alias("asks")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    largest = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    lengths = rows.groupBy(F.size("v").alias("size")).agg(F.max(square).alias("square"), F.max(largest).alias("largest"), F.count("*").alias("n")).orderBy("size").collect()  # a row for each length
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kind = vectors.schema["embedding"].dataType.simpleString()
    for size, top, most, n in lengths:
        scale = 1.0 if 1e-100 < most < 1e100 else 2.0 ** -np.floor(np.log2(most))
        if scale != 1:
            top = size * (most * scale) ** 2  # no norm is larger
        found = _search(rows.where(F.size("v") == size), kind, float(top), n, float(scale), p)
        out = out if found is None else found if len(lengths) == 1 else out.union(found)
    return out


def _search(rows: DataFrame, kind: str, norm2: float, n: int, scale: float, p: AnnParams) -> DataFrame | None:
    """:func:`search` for vectors of one length; None without queries."""
    same = Window.partitionBy("v").orderBy("vec_id")
    index0 = rows.select("vec_id", "v").withColumn("n", F.dense_rank().over(same)).where(F.col("n") <= p.k + 1).select("vec_id", "v").distinct()
    # about the lowest hashes first, so that no task sorts more than its part of the sample
    share = 1.5 * p.sample_rows / n
    low = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30)) if share < 1 else F.lit(True)
    sample = rows.where(low).orderBy(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)), "vec_id").limit(p.sample_rows).select("v").collect()
    tree = build_tree(np.array([r.v for r in sample], float), norm2, p, scale)
    asked = rows.where("asks").select(F.col("vec_id").alias("query_id"), "v").distinct()
    some = asked.orderBy(F.xxhash64("query_id"), "query_id").limit(p.calibration_queries).collect()
    if not some:
        return None
    if n > p.leaf_most * tree.leaves:
        tree = grow(tree, index0, kind, p)
    index = save(_assigned(index0, tree, kind), "ann-index", "zstd")
    visits = calibrate(tree, index, [(r.query_id, np.array(r.v, float)) for r in some], p)
    held = np.zeros(tree.leaves, np.int64)
    for r in index.groupBy("leaf").count().collect():  # at most as many as leaves
        held[r.leaf] = r["count"]
    own = index.groupBy("vec_id").count().agg(F.max("count")).first()[0]  # rows of one id, which are none of its neighbours
    sent = rows.sparkSession.sparkContext.broadcast(tree)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["leaf"] = [leaves_of(sent.value, np.asarray(v, float), visits, held, p.k + own) for v in b["v"]]
            yield b

    routes = asked.repartition("query_id").mapInPandas(walk, f"query_id long, v {kind}, leaf array<int>")
    routes = save(routes, "ann-routes").withColumn("leaf", F.explode("leaf"))
    # blocks of rows and blocks of queries of one leaf, both of bounded size
    blocks = lambda d, n: d.groupBy("leaf").agg(F.ceil(F.count("*") / p.block_rows).cast("int").alias(n))
    sizes = blocks(index, "nb").join(blocks(routes, "nq"), "leaf")
    left = index.join(sizes, "leaf").withColumn("block", F.pmod(F.xxhash64("vec_id"), "nb").cast("int"))
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("nq") - 1))).select("leaf", "block", "part", "vec_id", "v")
    right = routes.join(sizes, "leaf").withColumn("part", F.pmod(F.xxhash64("query_id"), "nq").cast("int"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("leaf", "block", "part", "query_id", "v")
    key = ["leaf", "block", "part"]
    partial = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_compare(p.k, scale), "query_id long, vec_id long, score double")
    return _ranked(partial, p.k, scale)
