"""Nearest neighbours: balanced posting lists with replicated borders, found through a centroid graph; the lists left out are checked by bounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import stored
from tapeloom.llm.vectors import HIT, best_hits, is_query, matrix, usable

# Wanted and largest rows of a posting list; lists never exceed MOST_LISTS centroids, longer ones are split by hash.
LIST_ROWS, LIST_MOST, MOST_LISTS = 512, 1024, 4096
# Rows that the centroids and the pruning ratio are fitted on (expected number), and those of them used as trial queries.
FIT_ROWS, TRIALS = 16_384, 256
# A vector also joins other lists up to this ratio of its least distance, COPIES in all; links per centroid.
BORDER, COPIES, LINKS = 1.03, 3, 16
# Recall aimed at when the ratio is chosen; queries of a block and lists of a group that one task holds.
RECALL, BLOCK, GROUP = 0.96, 2048, 16
# Queries of a block when the lists left out are checked: only hits above a known score come back, so blocks may be larger.
CHECK_BLOCK = 8192
SEED = 5


@dataclass
class Centroids:
    """Centroids in one dimension more than the vectors, their graph, the norm bound and the pruning ratio."""

    points: np.ndarray
    links: np.ndarray
    entries: np.ndarray
    norm2: float
    ratio: float = 1.0

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors with a last component that makes all norms equal, so that near means a large inner product."""
        rest = np.maximum(self.norm2 - np.einsum("ij,ij->i", vectors, vectors), 0.0)
        return np.hstack([vectors, np.sqrt(rest)[:, None]])

    def near(self, lifted: np.ndarray, ratio: float, least: int) -> np.ndarray:
        """Squared distances to the centroids that a walk over the graph finds, infinite for all others.

        Starts at the best entry point. All seen centroids within ``ratio`` of the nearest one so far, or among the
        ``least`` nearest, hand over their neighbours until none is new.
        """
        n, c = len(lifted), len(self.points)
        own = np.einsum("ij,ij->i", self.points, self.points)
        mine = np.einsum("ij,ij->i", lifted, lifted)
        seen = np.full((n, c), np.inf)
        seen[:, self.entries] = np.maximum(mine[:, None] - 2 * lifted @ self.points[self.entries].T + own[self.entries], 0)
        opened = np.zeros((n, c), bool)
        while True:
            best = seen.min(axis=1)
            rank = np.partition(seen, min(least, c) - 1, axis=1)[:, min(least, c) - 1]
            limit = np.maximum(best * ratio**2, np.where(np.isfinite(rank), rank, best))
            row, at = np.nonzero((seen <= limit[:, None]) & ~opened)
            if not len(row):
                return seen
            opened[row, at] = True
            row, at = np.repeat(row, self.links.shape[1]), self.links[at].ravel()
            pair = np.unique(row * c + at)
            row, at = pair // c, pair % c
            fresh = ~np.isfinite(seen[row, at])
            row, at = row[fresh], at[fresh]
            for i in range(0, len(row), 65_536):
                r, a = row[i: i + 65_536], at[i: i + 65_536]
                seen[r, a] = np.maximum(mine[r] - 2 * np.einsum("ij,ij->i", lifted[r], self.points[a]) + own[a], 0)


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1), 0)


def fit(sample: np.ndarray, norm2: float, n_lists: int, k: int) -> Centroids:
    """Centroids of a bounded sample by balanced k-means, their neighbour graph, and the pruning ratio.

    In each round lists over twice the mean size give half of their members to the emptiest centroid. The ratio is the
    least on a grid at which the lists selected for trial queries hold ``RECALL`` of their true neighbours within the
    sample; the whole table is denser, its neighbours are nearer, so that is the harder case.
    """
    rng = np.random.default_rng(SEED)
    index = Centroids(np.zeros((0, 0)), np.zeros((0, 0), np.int64), np.zeros(0, np.int64), norm2)
    lifted = index.lift(sample)
    c = min(n_lists, len(lifted))
    points = lifted[rng.choice(len(lifted), c, replace=False)].copy()
    for _ in range(8):
        home = np.concatenate([_square(lifted[i: i + 2048], points).argmin(axis=1) for i in range(0, len(lifted), 2048)])
        size = np.bincount(home, minlength=c)
        sums = np.zeros_like(points)
        np.add.at(sums, home, lifted)
        points = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], points)
        for big in np.flatnonzero(size > 2 * len(lifted) / c):
            small = int(size.argmin())
            if size[small] * 4 < size[big]:
                points[small] = lifted[rng.choice(np.flatnonzero(home == big))]
                size[small] = size[big] = size[big] // 2
    index.points = points
    order = np.argsort(_square(points, points), axis=1)[:, 1: LINKS + 1] if c > 1 else np.zeros((c, 1), np.int64)
    far = rng.integers(0, c, (c, 2))
    index.links = np.hstack([order, far])
    index.entries = rng.choice(c, max(1, int(c**0.5)), replace=False)

    trial = rng.choice(len(sample), min(TRIALS, len(sample)), replace=False)
    scores = sample[trial] @ sample.T
    scores[np.arange(len(trial)), trial] = -np.inf
    wanted = np.argsort(-scores, axis=1)[:, : min(k, max(1, len(sample) - 1))]
    asked = np.hstack([sample[trial], np.zeros((len(trial), 1))])
    distance = np.sqrt(_square(asked, points))
    nearest = distance.min(axis=1)
    lists = member_lists(index, lifted)
    held = np.full((len(sample), COPIES), -1)
    for i, own in enumerate(lists):
        held[i, : len(own)] = own
    # The ratio at which a query's selection first meets one of a neighbour's lists.
    reach = distance / np.maximum(nearest, 1e-12)[:, None]
    needs = np.where(held[wanted] >= 0, np.take_along_axis(reach, np.maximum(held[wanted], 0).reshape(len(trial), -1), 1)
                     .reshape(held[wanted].shape), np.inf).min(axis=2)
    index.ratio = float(max(1.0, np.quantile(needs, RECALL))) if needs.size else 1.0
    return index


def member_lists(index: Centroids, lifted: np.ndarray) -> list[np.ndarray]:
    """The lists that each vector joins: its nearest, and others about as near."""
    out = []
    for i in range(0, len(lifted), 1024):
        seen = index.near(lifted[i: i + 1024], BORDER, COPIES)
        order = np.argsort(seen, axis=1)[:, :COPIES]
        d = np.take_along_axis(seen, order, 1)
        out += [o[x <= x[0] * BORDER**2] for o, x in zip(order, d)]
    return out


def approximate_top_k(vectors: DataFrame, every: int, k: int, key: str = "vec_id", vector: str = "embedding",
                      list_rows: int = LIST_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products of each query with other rows.

    Queries are the rows whose id is divisible by ``every``. Every row is indexed in the posting list of its nearest
    centroid and, near a border, in up to ``COPIES`` lists. Lists over ``LIST_MOST`` rows (a frequent vector) are split by
    hash into parts that are searched together. A query walks the centroid graph and takes all lists within the
    fitted ratio of its least distance. Queries go in blocks and lists in groups; a task holds one block and one group
    and returns ``k`` hits a query, scored in double precision on the original vectors.

    The ratio holds for vectors like the sample's; queries that lie elsewhere, or in small clusters, would miss
    neighbours. So a check follows: of the lists not taken, those that may hold a product above the query's ``k``-th
    score so far, by their radius around the centroid or by their largest norm, are searched too.

    Only the centroids and the ratio come from a sample, of ``FIT_ROWS`` expected rows. Which rows take part: see
    :func:`vectors.usable`; zero vectors do not. A query without other rows has no result; an empty table gives an
    empty result.
    """
    spark = vectors.sparkSession
    rows = stored(usable(vectors, key, vector, allow_zero=False), "vectors")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first()
    n = size["n"]
    if not n:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    chance = (F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    sample = rows.where(chance < FIT_ROWS / n).select("id", "v").toPandas().sort_values("id") if n > FIT_ROWS else rows.toPandas().sort_values("id")
    if not len(sample):
        sample = rows.limit(1).toPandas()
    index = fit(matrix(sample["v"]), size["m"], min(MOST_LISTS, -(-n // list_rows)), k)
    shared = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 4096):
                part = batch.iloc[i: i + 4096]
                lists = member_lists(shared.value, shared.value.lift(matrix(part["v"])))
                count = [len(x) for x in lists]
                where = np.repeat(np.arange(len(part)), count)
                yield pd.DataFrame({"list": np.concatenate(lists).astype(np.int64), "id": part["id"].to_numpy()[where],
                                    "v": [part["v"].iloc[w].tobytes() for w in where]})

    def select(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.iloc[i: i + 512]
                points = matrix(part["v"])
                seen = shared.value.near(np.hstack([points, np.zeros((len(part), 1))]), shared.value.ratio, 1)
                chosen = seen <= seen.min(axis=1, keepdims=True) * shared.value.ratio**2 + 1e-12
                yield pd.DataFrame({"id": part["id"], "v": [p.tobytes() for p in points], "lists": [np.flatnonzero(c) for c in chosen]})

    listed = stored(rows.mapInPandas(assign, "list long, id long, v binary"), "postings")
    parts = listed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / LIST_MOST).alias("parts"))
    spread = listed.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        points = np.frombuffer(b"".join(group["v"]), np.float64).reshape(len(group), -1)
        centre = shared.value.points[group["list"].iloc[0], :-1]
        return pd.DataFrame({"list": [group["list"].iloc[0]], "part": [group["part"].iloc[0]],
                             "ids": [group["id"].to_numpy(np.int64).tobytes()], "points": [points.tobytes()],
                             "radius": [float(np.linalg.norm(points - centre, axis=1).max())], "norm": [float(np.linalg.norm(points, axis=1).max())]})

    packed = stored(spread.select("list", "part", "id", "v").groupBy("list", "part").applyInPandas(
        pack, "list long, part long, ids binary, points binary, radius double, norm double"), "lists")
    # One row per list, MOST_LISTS at most.
    spans = packed.groupBy("list").agg(F.max("radius").alias("radius"), F.max("norm").alias("norm"), F.count(F.lit(1)).alias("parts")).toPandas()
    limits = spark.sparkContext.broadcast(tuple(spans[c].to_numpy() for c in ("list", "radius", "norm", "parts")))
    n_groups = max(1, -(-int(spans["parts"].sum()) // GROUP))
    group_of = F.pmod(F.col("list") + F.col("part"), F.lit(n_groups)).alias("group")
    asked = stored(rows.where(is_query(every)).mapInPandas(select, "id long, v binary, lists array<long>"), "asked")
    n_queries = asked.count()

    def searched(wanted: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], queries: DataFrame, block: int) -> DataFrame:
        """Hits of queries in the lists that ``wanted`` names, a block of queries and a group of lists at a time."""
        n_blocks = max(1, -(-n_queries // block))
        left = queries.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_blocks))).mapInPandas(
            wanted, "block long, group long, id long, v binary, least double, lists array<long>")
        right = packed.select("list", "ids", "points", group_of).withColumn(
            "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
        return left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInPandas(search, HIT)

    def routed(batch: pd.DataFrame, query: np.ndarray, lists: np.ndarray, parts: np.ndarray) -> pd.DataFrame:
        """One row per query and group of lists: pairs of a query's place in the batch and a list become rows."""
        at = np.repeat(np.arange(len(query)), parts)
        part = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
        pairs = pd.DataFrame({"query": query[at], "group": (lists[at] + part) % n_groups, "list": lists[at]}).drop_duplicates()
        out = pairs.groupby(["query", "group"])["list"].agg(list).reset_index()
        return batch[["block", "id", "v", "least"]].iloc[out["query"].to_numpy()].reset_index(drop=True).assign(group=out["group"], lists=out["list"])[
            ["block", "group", "id", "v", "least", "lists"]]

    def taken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, _, _, parts = limits.value
        count = dict(zip(known.tolist(), parts.tolist()))
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.iloc[i: i + 512]
                lists = np.concatenate(part["lists"].to_list()).astype(np.int64)
                query = np.repeat(np.arange(len(part)), [len(x) for x in part["lists"]])
                sizes = np.array([count.get(x, 0) for x in lists.tolist()], np.int64)
                yield routed(part.assign(least=-np.inf), query, lists, sizes)

    def left_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, radius, norm, parts = limits.value
        centres = shared.value.points[known, :-1]
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.iloc[i: i + 512]
                points = np.stack([np.frombuffer(b, np.float64) for b in part["v"]])
                size = np.linalg.norm(points, axis=1)[:, None]
                bound = np.minimum(points @ centres.T + size * radius, size * norm) + 1e-9 * size * norm.max()
                may = bound >= part["least"].to_numpy()[:, None]
                for j, lists in enumerate(part["lists"]):
                    may[j] &= ~np.isin(known, lists)
                query, at = np.nonzero(may)
                if len(query):
                    yield routed(part, query, known[at], parts[at])

    def search(queries: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(queries) or not len(lists):
            return empty
        own = queries["id"].to_numpy(np.int64)
        asked_ = np.stack([np.frombuffer(b, np.float64) for b in queries["v"]])
        size = np.linalg.norm(asked_, axis=1)
        least = queries["least"].to_numpy(float).copy()
        takes: dict[int, list[int]] = {}
        for i, some in enumerate(queries["lists"]):
            for x in some:
                takes.setdefault(int(x), []).append(i)
        found = []
        for row in lists.itertuples():
            if row.list not in takes:
                continue
            ids = np.frombuffer(row.ids, np.int64)
            points = np.frombuffer(row.points, np.float64).reshape(len(ids), -1)
            # What a sum may differ by when its terms are added in another order.
            slack = points.shape[1] * 4e-16 * float(np.linalg.norm(points, axis=1).max())
            for j in range(0, len(takes[row.list]), 2048):
                who = np.array(takes[row.list][j: j + 2048])
                scores = asked_[who] @ points.T
                scores[own[who][:, None] == ids[None, :]] = -np.inf
                hit = (scores >= (least[who] - slack * size[who])[:, None]) & (scores > -np.inf)
                many = np.flatnonzero(hit.sum(axis=1) > k)
                if len(many):
                    kth = np.partition(scores[many], len(ids) - k, axis=1)[:, len(ids) - k] - slack * size[who[many]]
                    least[who[many]] = np.maximum(least[who[many]], kth)
                    hit[many] = (scores[many] >= kth[:, None]) & (scores[many] > -np.inf)
                q, at = np.nonzero(hit)
                for i in range(0, len(q), 65_536):
                    a, b = who[q[i: i + 65_536]], at[i: i + 65_536]
                    # One fixed order of summation, so that equal vectors score equal.
                    found.append((a, ids[b], np.cumsum(points[b] * asked_[a], axis=1)[:, -1]))
        if not found:
            return empty
        q, ids, exact = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((ids, -exact, q))
        q, ids, exact = q[order], ids[order], exact[order]
        fresh = np.r_[True, (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])]
        q, ids, exact = q[fresh], ids[fresh], exact[fresh]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        return pd.DataFrame({"query_id": own[q[keep]], "vec_id": ids[keep], "score": exact[keep]})

    near = stored(best_hits(searched(taken, asked, BLOCK), k), "near")
    # A query with fewer than k hits so far has no score to beat.
    kth = near.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    open_ = asked.join(kth, "id", "left").select("id", "v", "lists", F.coalesce("kth", F.lit(float("-inf"))).alias("least"))
    return best_hits(near.select("query_id", "vec_id", "score").unionByName(searched(left_out, open_, CHECK_BLOCK)), k)
