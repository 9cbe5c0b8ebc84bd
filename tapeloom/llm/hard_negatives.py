"""Hard negatives by score windows: cover trees over norm-augmented vectors, descended best-first."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import stored
from tapeloom.llm.vectors import is_query, matrix, top_rows

# Vectors per tree, vectors per leaf, what the covering radius shrinks by from level to level, and the points that a
# centre must cover on average for a level to be worth opening.
SHARD, LEAF, SHRINK, GATHER = 4096, 64, 1.3, 8
# Points of leaves that are verified together.
VERIFY = 512
# Cells that vectors are dealt to by their nearest pivot, at most; anchors that meet a tree, and trees that are bounded, at once.
PIVOTS, ANCHORS, METAS = 4096, 1024, 512
HITS = "anchor long, positive long, positive_score double, id long, score double"
WANTED = "anchor long, shard long, block long"


@dataclass
class CoverTree:
    """Nodes by level: each has a centre (one of its points), its covering radius, its children and its run of points.

    Points are lifted by one component that gives all the same norm, so the distance to an anchor of that norm tells the
    inner product. ``labels`` holds the least and greatest label below a node.
    """

    ids: np.ndarray
    marks: np.ndarray
    points: np.ndarray
    centres: np.ndarray
    radius: np.ndarray
    children: np.ndarray
    runs: np.ndarray
    labels: np.ndarray
    norm: float

    @staticmethod
    def build(ids: np.ndarray, marks: np.ndarray, points: np.ndarray, norm2: float, leaf: int = LEAF) -> CoverTree:
        """Level by level: the points of a node are covered by centres more than a level's radius apart.

        A node's own centre is the first centre of its children (nesting); every point joins the first centre within the
        radius (covering); later centres lie outside all earlier ones (separation). Levels that leave a node whole are
        passed over; a node whose points lie so evenly apart that a centre would cover fewer than ``GATHER`` of them is a
        leaf. Runs of sibling nodes lie together, and what a node covers is one run of points.
        """
        lifted = np.hstack([points, np.sqrt(np.maximum(norm2 - np.einsum("ij,ij->i", points, points), 0.0))[:, None]])
        nodes, order, slot = [], np.arange(len(ids)), 0
        todo = [(0, len(ids))]
        while slot < len(todo):
            begin, end = todo[slot]
            slot += 1
            rows = order[begin:end]
            apart = np.sqrt(((lifted[rows] - lifted[rows[0]]) ** 2).sum(axis=1))
            reach, first_child = float(apart.max()), len(todo)
            if len(rows) > leaf and reach > 0:
                group = _covered(lifted[rows], apart, reach / SHRINK)
                if (group.max() + 1) * GATHER <= len(rows):
                    order[begin:end] = rows[np.argsort(group, kind="stable")]
                    ends = begin + np.cumsum(np.bincount(group))
                    todo += zip([begin, *ends[:-1].tolist()], ends.tolist())
            nodes.append((rows[0], reach, first_child, len(todo), begin, end))
        centre, reach, first, last, begin, end = (np.array(x) for x in zip(*nodes))
        held = marks[order]
        labels = np.array([(held[a:b].min(), held[a:b].max()) for a, b in zip(begin, end)])
        return CoverTree(ids[order], held, points[order], lifted[centre], reach, np.stack([first, last], 1), np.stack([begin, end], 1), labels, norm2 ** 0.5)

    def bounds(self, nodes: slice | np.ndarray, lifted: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner products that points below ``nodes`` can have with an anchor.

        ``lifted`` is the anchor scaled to the common norm, ``size`` what its products are scaled back by.
        """
        return reachable(self.centres[nodes] @ lifted, self.radius[nodes], self.norm, size)

    def search(self, anchor: int, mark: int, vector: np.ndarray, windows: list[tuple], k: int, same: bool) -> Iterator[tuple]:
        """Rows of :data:`HITS` without the anchor: up to ``k`` best points inside each window ``(positive, score, low, high, floor)``.

        Nodes wait in a heap by the greatest product they can reach. A node is opened while some window wants it: its
        reach is not below the window's low end and k-th score so far, nor all above its high end. Leaves are verified
        point by point, by product, label and window, as soon as ``VERIFY`` points are due. ``floor`` is a k-th score known
        from other trees.
        """
        norm = float(np.sqrt(vector @ vector))
        lifted = np.append(vector * (self.norm / norm if norm else 0.0), 0.0)
        size = norm / self.norm if self.norm else 0.0
        low, high = (np.array([w[i] for w in windows], float) for i in (2, 3))
        least = np.maximum(low, [w[4] for w in windows])
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(windows)
        heap: list[tuple[float, float, int]] = [(-np.inf, -np.inf, 0)]
        pending: list[slice] = []

        def verify() -> None:
            """Compares the points of the leaves taken so far with label and windows, one by one."""
            ids, marks, points = (np.concatenate([x[s] for s in pending]) for x in (self.ids, self.marks, self.points))
            pending.clear()
            scores = points @ vector
            near = np.flatnonzero((scores >= least.min()) & (scores <= high.max()) & ((marks == mark) == same) & (ids != anchor))
            ids, scores = ids[near], scores[near]
            for w in range(len(windows)):
                good = (scores >= least[w]) & (scores <= high[w])
                if good.any():
                    both = np.concatenate([found[w][0], ids[good]]), np.concatenate([found[w][1], scores[good]])
                    best = top_rows(both[1], both[0], k)
                    found[w] = both[0][best], both[1][best]
                    if len(best) == k:
                        least[w] = max(least[w], found[w][1][-1])

        taken = 0
        while heap:
            upper, lower, node = heapq.heappop(heap)
            if -upper < least.min():
                break
            if not ((least <= -upper) & (high >= lower)).any():
                continue
            first, last = self.children[node]
            if last > first:
                lows, highs = self.bounds(slice(first, last), lifted, size)
                useful = ((highs[:, None] >= least) & (lows[:, None] <= high)).any(axis=1) & self._labelled(slice(first, last), mark, same)
                for at in np.flatnonzero(useful).tolist():
                    heapq.heappush(heap, (-highs[at], lows[at], first + at))
                continue
            begin, end = self.runs[node]
            pending.append(slice(begin, end))
            taken += end - begin
            if taken >= VERIFY:
                verify()
                taken = 0
        if pending:
            verify()
        for window, (ids, scores) in zip(windows, found):
            yield from ((window[0], window[1], i, s) for i, s in zip(ids.tolist(), scores.tolist()))

    def _labelled(self, nodes: slice, mark: int, same: bool) -> np.ndarray:
        return _may_hold(self.labels[nodes], mark, same)


def _covered(points: np.ndarray, apart: np.ndarray, radius: float) -> np.ndarray:
    """The number of the first centre within ``radius`` of each point; the first point is the first centre."""
    group = np.where(apart <= radius, 0, -1)
    free, n = np.flatnonzero(group < 0), 1
    while len(free):
        near = ((points[free] - points[free[0]]) ** 2).sum(axis=1) <= radius * radius
        near[0] = True
        group[free[near]] = n
        free, n = free[~near], n + 1
    return group


def _may_hold(labels: np.ndarray, mark: int, same: bool) -> np.ndarray:
    low, high = labels[:, 0], labels[:, 1]
    return (low <= mark) & (high >= mark) if same else (low != mark) | (high != mark)


def reachable(products: np.ndarray, radius: np.ndarray, norm: float, size: float) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of products from those of centres: by the triangle inequality on the sphere, and by the radius alone.

    A little slack covers rounding.
    """
    apart = np.sqrt(np.maximum(2 * norm * norm - 2 * products, 0.0))
    upper = np.minimum(norm * norm - np.maximum(apart - radius, 0.0) ** 2 / 2, products + norm * radius)
    lower = np.maximum(norm * norm - (apart + radius) ** 2 / 2, products - norm * radius)
    slack = 1e-9 * norm * norm + 1e-9
    return (lower - slack) * size, (upper + slack) * size


def labelled(vectors: DataFrame, key: str, vector: str, label: Column, prepare: Column | None) -> DataFrame:
    """``id, v, label`` of the rows that take part, ids once."""
    v = F.col(vector).cast("array<double>")
    sound = F.col(key).isNotNull() & F.col("_label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.withColumn("_label", label.cast("long")).where(sound).select(F.col(key).cast("long").alias("id"), v.alias("v"), "_label")
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    least = rows.where(F.size("v") == (common["d"] if common else 0)).groupBy("id").agg(F.min(F.struct("v", "_label")).alias("one"))
    own = least.select("id", F.col("one.v").alias("v"), F.col("one._label").alias("label"))
    return own if prepare is None else own.select("id", prepare.alias("v"), "label")


def _dealt(rows: DataFrame, n: int, shard_rows: int) -> DataFrame:
    """``rows`` with ``shard``: by the nearest of sampled pivots, crowded cells cut by hash."""
    n_pivots = min(PIVOTS, max(1, n // shard_rows))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(n_pivots).select("v").toPandas()
    pivots = matrix(sample["v"])
    half = np.einsum("ij,ij->i", pivots, pivots) / 2

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                batch["cell"] = np.argmax(matrix(batch["v"]) @ pivots.T - half, axis=1)
                yield batch

    placed = stored(rows.mapInPandas(near, "id long, v array<double>, label long, cell long"), "cells")
    parts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("parts"))
    # At most one row per pivot.
    cut = placed.join(F.broadcast(parts), "cell")
    return cut.withColumn("shard", F.col("cell") * F.lit(1 << 32) + F.pmod(F.xxhash64("id"), F.col("parts"))).drop("cell", "parts")


def mine(vectors: DataFrame, every: int = 100, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90,
         key: str = "vec_id", vector: str = "embedding", label: Column | str = "label", prepare: Column | None = None,
         shard_rows: int = SHARD) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: hard negatives of every anchor and positive.

    Anchors are the rows whose id is divisible by ``every``; an anchor's positives are its ``n_positives`` best other
    rows of its label; a positive's negatives are the ``n_negatives`` best rows of other labels whose score lies between
    ``low`` and ``high`` percent of the positive's, ends included. Scores are inner products (exact while sums stay below
    2**53), ties go to the smaller id. A window of a negative positive score is empty.

    Rows fall to the nearest of up to ``PIVOTS`` sampled pivots, crowded cells are cut by hash, and each shard of about
    ``shard_rows`` becomes a cover tree. An anchor first searches the tree of its own place, which gives it k-th scores.
    With those, all trees are bounded by their root's centre, radius and labels, and only trees that can still hold
    something are searched, with the anchors that want them, ``ANCHORS`` at a time. The same passes run for positives and
    then for the windows. What a task holds is bounded by these sizes.

    Rows with a null id, label or vector, a null or non-finite component, or another length than most (ties: the
    shorter) take no part; rows that repeat an id count once, as the least vector with its least label. Equal vectors
    tie. Other columns are not read. Anchors without positives, positives with an empty window and empty tables give no
    rows.
    """
    mark = F.col(label) if isinstance(label, str) else label
    rows = stored(labelled(vectors, key, vector, mark, prepare), "labelled")
    about = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm2")).first()
    placed = stored(_dealt(rows, about["n"], shard_rows), "shards")
    norm2 = float(about["norm2"] or 0.0) * (1 + 1e-12)

    def plant(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", ignore_index=True)
        tree = CoverTree.build(group["id"].to_numpy(np.int64), group["label"].to_numpy(np.int64), matrix(group["v"]), norm2)
        return pd.DataFrame({"shard": [group["shard"].iloc[0]], "tree": [pickle.dumps(tree)], "centre": [tree.centres[0].tobytes()],
                             "radius": [tree.radius[0]], "low": [tree.labels[0, 0]], "high": [tree.labels[0, 1]]})

    trees = stored(placed.groupBy("shard").applyInPandas(plant, "shard long, tree binary, centre binary, radius double, low long, high long"), "trees")
    block = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(max(1, about["n"] // every // ANCHORS))).alias("block")
    anchors = stored(placed.where(is_query(every)).select("id", "v", "label", F.col("shard").alias("home"), block), "anchors")
    minus, plus = F.lit(float("-inf")), F.lit(float("inf"))
    whole = F.array(F.struct(F.lit(None).cast("long").alias("positive"), F.lit(None).cast("double").alias("score"), minus.alias("low"), plus.alias("high"), minus.alias("floor")))
    positives = _passes(anchors.withColumn("windows", whole), trees, norm2, n_positives, True).select("anchor", F.col("id").alias("positive"), "score")
    positives = stored(positives, "positives")
    window = F.struct("positive", "score", (F.col("score") * low / 100).alias("low"), (F.col("score") * high / 100).alias("high"), minus.alias("floor"))
    # At most n_positives windows an anchor.
    asked = positives.where("score >= 0").groupBy("anchor").agg(F.collect_list(window).alias("windows"))
    known = anchors.join(asked, anchors["id"] == asked["anchor"]).select(*anchors.columns, "windows")
    negatives = _passes(known, trees, norm2, n_negatives, False)
    return negatives.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int"),
                            F.col("id").alias("negative_id"), F.col("positive_score").cast("long"), F.col("score").cast("long").alias("negative_score"))


def _passes(asked: DataFrame, trees: DataFrame, norm2: float, k: int, same: bool) -> DataFrame:
    """The ``k`` best hits of every anchor and window: first its home tree, then the trees that its k-th scores leave."""
    asked = stored(asked, "asked")
    group = ["anchor", "positive"]
    start = stored(_searched(asked.withColumn("shard", F.col("home")), trees, k, same), "home-hits")
    order = Window.partitionBy(*group).orderBy(F.desc("score"), "id")
    kth = start.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") == k)
    windows = asked.select("id", F.explode("windows").alias("w")).join(
        kth, (F.col("id") == kth["anchor"]) & F.col("w.positive").eqNullSafe(kth["positive"]), "left").groupBy("id").agg(F.collect_list(F.struct(
            "w.positive", "w.score", "w.low", "w.high", F.coalesce("kth", "w.floor").alias("floor"))).alias("windows"))
    known = stored(asked.drop("windows").join(windows, "id"), "asked")
    wanted = stored(_wanted(known, trees, norm2, same), "wanted")
    more = _searched(known.join(wanted.select(F.col("anchor").alias("id"), "shard"), "id"), trees, k, same)
    hits = start.union(more).withColumn("rank", F.row_number().over(order))
    return hits.where(F.col("rank") <= k)


def _searched(asked: DataFrame, trees: DataFrame, k: int, same: bool) -> DataFrame:
    """:data:`HITS` of anchors in the tree of ``shard``; a tree goes out once per block of anchors that want it."""
    blocks = asked.select(F.col("shard").alias("s"), F.col("block").alias("b")).distinct()
    dealt = blocks.join(trees.select(F.col("shard").alias("s"), "tree"), "s")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            tree: CoverTree = pickle.loads(left["tree"].iloc[0])
            for anchor, vector, mark, windows in zip(right["id"], right["v"], right["label"], right["windows"]):
                given = [(w["positive"], w["score"], w["low"], w["high"], w["floor"]) for w in windows]
                out += [(anchor, *hit) for hit in tree.search(anchor, mark, np.asarray(vector, float), given, k, same)]
        return pd.DataFrame({c: pd.Series([r[i] for r in out], dtype="object") for i, c in enumerate(["anchor", "positive", "positive_score", "id", "score"])})

    return dealt.groupBy("s", "b").cogroup(asked.groupBy("shard", "block")).applyInPandas(search, HITS)


def _wanted(asked: DataFrame, trees: DataFrame, norm2: float, same: bool) -> DataFrame:
    """``anchor, shard, block``: the trees other than home that can hold hits of an anchor, told by their roots alone.

    Anchors in blocks meet roots in groups of ``METAS``; neither vectors nor trees move.
    """
    meta = trees.select("shard", "centre", "radius", "low", "high")
    groups = max(1, -(-meta.count() // METAS))
    left = meta.withColumn("g", F.pmod(F.xxhash64("shard"), F.lit(groups))).groupBy("g").agg(
        F.collect_list(F.struct("shard", "centre", "radius", "low", "high")).alias("roots"))
    right = asked.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(
        F.col("g").cast("long"), "id", "v", "label", "home", "block", "windows")
    norm = norm2 ** 0.5

    def judge(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            roots = left["roots"].iloc[0]
            shards = np.array([r["shard"] for r in roots])
            centres = np.stack([np.frombuffer(r["centre"]) for r in roots])
            radius = np.array([r["radius"] for r in roots])
            labels = np.array([(r["low"], r["high"]) for r in roots])
            for anchor, vector, mark, home, block, windows in zip(*(right[c] for c in ("id", "v", "label", "home", "block", "windows"))):
                own = np.asarray(vector, float)
                size = float(np.sqrt(own @ own))
                lows, highs = reachable(centres @ np.append(own * (norm / size if size else 0.0), 0.0), radius, norm, size / norm if norm else 0.0)
                useful = np.zeros(len(shards), bool)
                for w in windows:
                    useful |= (highs >= max(w["low"], w["floor"])) & (lows <= w["high"])
                useful &= _may_hold(labels, mark, same) & (shards != home)
                out += [(anchor, s, block) for s in shards[useful].tolist()]
        return pd.DataFrame(out, columns=["anchor", "shard", "block"])

    # One row a group, so every block of anchors gets its own copy of the group's roots.
    copies = left.join(right.select(F.col("g").alias("to"), F.col("block").alias("b")).distinct(), F.col("g") == F.col("to")).select("to", "b", "roots")
    return copies.groupBy("to", "b").cogroup(right.groupBy("g", "block")).applyInPandas(judge, WANTED)
