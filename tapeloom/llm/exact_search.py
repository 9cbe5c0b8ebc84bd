"""Exact top-k inner products: a k-d tree per shard, best-first traversal with box bounds and a passed-on k-th score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import stored
from tapeloom.llm.vectors import HIT, best_hits, is_query, matrix, top_rows, usable

# Vectors per shard, queries per block and vectors per leaf of a tree.
SHARD, BLOCK, LEAF = 4096, 512, 64
PACK = "shard long, ids binary, points binary, bounds binary, leaves binary"


def build_tree(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the points by leaf, ``begin`` of each leaf, and its tight box (``low | high`` per leaf).

    Splits at the median of the widest axis of the node's own box until a node has at most ``leaf`` points.
    """
    order, todo, begins = [], [np.arange(len(points))], [0]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            order.append(rows)
            begins.append(begins[-1] + len(rows))
            continue
        own = points[rows]
        axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        half = len(rows) // 2
        split = np.argpartition(own[:, axis], half)
        todo += [rows[split[half:]], rows[split[:half]]]
    whole = np.concatenate(order)
    boxes = np.array([[points[o].min(axis=0), points[o].max(axis=0)] for o in order])
    return whole, np.array(begins), boxes.reshape(len(order), -1)


def search_tree(queries: np.ndarray, own: np.ndarray, floor: np.ndarray, ids: np.ndarray, points: np.ndarray,
                begins: np.ndarray, boxes: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(query, ids, scores)`` of the up to ``k`` points of one tree that reach each query's ``floor``.

    Leaves are visited in falling order of the greatest inner product their box allows; a query stops where that falls
    below its k-th score so far, which starts at the score passed on from other shards.
    """
    d = queries.shape[1]
    bound = np.maximum(queries, 0) @ boxes[:, d:].T + np.minimum(queries, 0) @ boxes[:, :d].T
    visit = np.argsort(-bound, axis=1, kind="stable")
    for q in range(len(queries)):
        kth, found_ids, found = floor[q], np.zeros(0, np.int64), np.zeros(0)
        for leaf in visit[q]:
            if bound[q, leaf] < kth:
                break
            rows = slice(begins[leaf], begins[leaf + 1])
            scores = points[rows] @ queries[q]
            good = (scores >= kth) & (ids[rows] != own[q])
            if good.any():
                found_ids, found = np.concatenate([found_ids, ids[rows][good]]), np.concatenate([found, scores[good]])
                best = top_rows(found, found_ids, k)
                found_ids, found = found_ids[best], found[best]
                if len(found) == k:
                    kth = max(kth, found[-1])
        if len(found):
            yield q, found_ids, found


def _cells(shards: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every block of queries with every shard, dealt evenly: both sides carry the cell they go to."""
    n_blocks, n_shards = (df.agg(F.max(c)).first()[0] or 0 for df, c in ((blocks, "block"), (shards, "shard")))
    left = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks).cast("long"))))
    right = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards).cast("long"))))
    return left.join(right, ["shard", "block"])


def exact_top_k(vectors: DataFrame, every: int, k: int, key: str = "vec_id", vector: str = "embedding",
                prepare: Column | None = None, shard_rows: int = SHARD, block_rows: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products of each query with every other row.

    Queries are the rows whose id is divisible by ``every``. ``prepare`` (over the array ``v``) replaces the vectors
    before anything else. Rows fall by hash into shards, each with its tree; queries go in blocks. First each block
    meets one shard, which gives every query a k-th score; passed on to all other shards, it prunes their trees from the
    first leaf. What a cell holds is bounded by the shard and block sizes, and it returns at most ``k`` rows a query.

    Which rows take part: see :func:`vectors.usable`. Scores are exact while sums stay below 2**53. A query without any
    other row has no result; an empty table gives an empty result.
    """
    rows = usable(vectors, key, vector)
    if prepare is not None:
        rows = rows.select("id", prepare.alias("v"))
    n = rows.count()
    n_shards, n_blocks = max(1, -(-n // shard_rows)), max(1, -(-n // every // block_rows))
    placed = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(n_shards)))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", ignore_index=True)
        points, ids = matrix(group["v"]), group["id"].to_numpy(np.int64)
        order, begins, boxes = build_tree(points)
        return pd.DataFrame({"shard": [group["shard"].iloc[0]], "ids": [ids[order].tobytes()], "points": [points[order].tobytes()],
                             "bounds": [boxes.tobytes()], "leaves": [begins.astype(np.int64).tobytes()]})

    def pack_queries(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", ignore_index=True)
        return pd.DataFrame({"block": [group["block"].iloc[0]], "q_ids": [group["id"].to_numpy(np.int64).tobytes()],
                             "q_points": [matrix(group["v"]).tobytes()]})

    shards = stored(placed.groupBy("shard").applyInPandas(pack, PACK), "trees")
    asked = rows.where(is_query(every)).withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_blocks)))
    blocks = stored(asked.groupBy("block").applyInPandas(pack_queries, "block long, q_ids binary, q_points binary"), "queries")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for cell in batch.itertuples():
                own = np.frombuffer(cell.q_ids, np.int64)
                queries = np.frombuffer(cell.q_points, np.float64).reshape(len(own), -1)
                d = queries.shape[1]
                floor = np.frombuffer(cell.floors, np.float64) if cell.floors is not None else np.full(len(own), -np.inf)
                ids = np.frombuffer(cell.ids, np.int64)
                points = np.frombuffer(cell.points, np.float64).reshape(-1, d)
                hits = list(search_tree(queries, own, floor, ids, points, np.frombuffer(cell.leaves, np.int64),
                                        np.frombuffer(cell.bounds, np.float64).reshape(-1, 2 * d), k))
                if hits:
                    yield pd.DataFrame({"query_id": np.concatenate([np.full(len(h[1]), own[h[0]]) for h in hits]),
                                        "vec_id": np.concatenate([h[1] for h in hits]), "score": np.concatenate([h[2] for h in hits])})

    home = F.pmod(F.col("block"), F.lit(n_shards))
    none = F.lit(None).cast("binary")
    first = shards.join(blocks.withColumn("shard", home), "shard").withColumn("floors", none)
    start = stored(first.select("ids", "points", "bounds", "leaves", "q_ids", "q_points", "floors").mapInPandas(search, HIT), "first-hits")
    kth = start.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).where(F.col("n") == k)
    floors = asked.select("id", "block").join(kth, asked["id"] == kth["query_id"], "left").groupBy("block").agg(
        F.array_sort(F.collect_list(F.struct("id", F.coalesce("s", F.lit(float("-inf"))).alias("s")))).alias("f")).select(
        "block", F.col("f.s").alias("f"))

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"block": batch["block"], "floors": [np.asarray(f, np.float64).tobytes() for f in batch["f"]]})

    known = blocks.join(floors.mapInPandas(coded, "block long, floors binary"), "block")
    rest = _cells(shards, known).where(F.col("shard") != home)
    more = rest.select("ids", "points", "bounds", "leaves", "q_ids", "q_points", "floors").mapInPandas(search, HIT)
    return best_hits(start.union(more), k)
