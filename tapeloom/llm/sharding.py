"""K-d tree sharding: recursive splits at distributed weighted medians. DataFrame functions only."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import numbered, stored

# Hexadecimal digits of the order key that one pass over the rows resolves: 4096 bins a node.
DIGITS = 3
# A split may miss its aim by this part of the node's weight; a group of equal texts heavier than that is split too.
TOLERANCE = 0.0005


# Levels of the tree that rows descend from the table stored last, before they are stored again with their nodes.
LEVELS = 4


@dataclass
class Node:
    """``leaves`` shards starting with ``shard``; rows carry the ``number`` of the node they lie in."""

    number: int
    leaves: int
    shard: int
    weight: int


def _table(rows: DataFrame, lines: list[dict], schema: str) -> DataFrame:
    """A small table, one line a node, to be broadcast: nodes of a level are at most as many as shards."""
    text = F.lit(json.dumps(lines))
    return F.broadcast(rows.sparkSession.range(1).select(F.inline(F.from_json(text, f"array<struct<{schema}>>"))))


def _descend(rows: DataFrame, splits: list[dict]) -> DataFrame:
    """Rows of split nodes move to a child, others stay."""
    table = _table(rows, splits, "node:int,column:int,threshold:string,left:int,right:int")
    child = F.when(F.element_at("keys", F.col("column")) >= F.col("threshold"), F.col("right")).otherwise(F.col("left"))
    here = rows.join(table, "node", "left")
    return here.select(F.coalesce(child, F.col("node")).alias("node"), *[c for c in rows.columns if c != "node"])


def split_points(rows: DataFrame, nodes: list[Node], columns: list[int], tolerance: float) -> list[tuple[str, int]]:
    """For each node the threshold on its column (a place in ``keys``, from 1), and the weight left of it.

    The wanted weight is bracketed digit by digit: each pass sums the weights of the next ``DIGITS`` digits of the
    order key for all nodes at once (at most 4096 sums a node, taken map-side) and keeps, per node, only the bin that
    holds the wanted point, until a bin's edge is within the tolerance or the key ends.
    """
    aims = [n.weight * (n.leaves // 2) / n.leaves for n in nodes]
    prefix, below, answer = [""] * len(nodes), [0] * len(nodes), [None] * len(nodes)
    while any(a is None for a in answer):
        open_ = [i for i, a in enumerate(answer) if a is None]
        wanted = _table(rows, [
            {"node": nodes[i].number, "column": columns[i], "prefix": prefix[i], "aim": float(aims[i] - below[i])} for i in open_
        ], "node:int,column:int,prefix:string,aim:double")
        key = F.element_at("keys", F.col("column"))
        digit = F.substring(key, F.length("prefix") + 1, F.lit(DIGITS))
        bins = rows.join(wanted, "node").where(F.startswith(key, F.col("prefix"))).groupBy("node", "aim", digit.alias("bin")).agg(
            F.sum("weight").alias("w"))
        run = F.sum("w").over(Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        placed = bins.withColumn("run", run)
        over = placed.where(F.col("run") >= F.col("aim")).groupBy("node").agg(F.min(F.struct("bin", "run", "w")).alias("s"))
        found = {r["node"]: r["s"] for r in over.collect()}
        for i in open_:
            s = found.get(nodes[i].number)
            if s is None:
                answer[i] = ("", 0)
                continue
            slack = tolerance * nodes[i].weight
            low, high = below[i] + s["run"] - s["w"], below[i] + s["run"]
            here = prefix[i] + s["bin"]
            nearer_low = aims[i] - low <= high - aims[i]
            if min(aims[i] - low, high - aims[i]) <= slack or len(s["bin"]) < DIGITS:
                # An edge of the bin serves: its own start, or what follows it.
                answer[i] = (here, low) if nearer_low else (_after(here), high)
            else:
                prefix[i], below[i] = here, low
    return answer


def _after(digits: str) -> str:
    """The least key above all that start with ``digits`` (`g` sorts behind all hexadecimal digits)."""
    return digits + "g"


def kd_shards(docs: DataFrame, key: Column, weight: Column, dimensions: dict[str, Column], group: Column,
              leaves: int | None = None, leaf_bytes: int | None = None, tolerance: float = TOLERANCE,
              keep: dict[str, Column] | None = None) -> DataFrame:
    """``key, weight, shard, slot`` and the ``keep`` columns of every row of ``docs``.

    A k-d tree over ``dimensions`` (non-negative integer columns, null counts as 0): a node of several leaves is split
    where the weight of its left share of leaves ends, along the dimension that is widest there against its range
    over the whole table; ties in a dimension follow ``group`` and then ``key``. Splits go on until nodes reach ``leaf_bytes``, or until
    there are ``leaves`` shards. Dimensions that depend on the text alone keep equal texts (``group``) together, except
    for a group that is heavier than the tolerance and lies on a border: that is split by key. Each level takes one
    aggregation for the widths and a few for the medians, over a stored narrow table; only sums per node reach the
    driver, never rows. Splits go back as small broadcast tables, so the plan grows with the depth (and is cut every
    ``LEVELS`` levels), not with the number of shards. Shards are numbered in tree order, ``slot`` counts the rows of a shard from 0.

    Null keys and repeated rows are rows like others; an empty table gives an empty result.
    """
    parts = {name: F.coalesce(c.cast("long"), F.lit(0)) for name, c in dimensions.items()}
    tail = F.concat(F.lpad(F.hex(F.xxhash64(group)), 16, "0"), F.lpad(F.hex(F.coalesce(key.cast("long"), F.lit(0))), 16, "0"))
    extra = keep or {}
    names = list(parts)
    table = docs.select(key.alias("key"), weight.cast("long").alias("weight"),
                        F.array(*[F.concat(F.lpad(F.hex(c), 16, "0"), tail) for c in parts.values()]).alias("keys"),
                        *[c.alias(f"_d_{n}") for n, c in parts.items()],
                        *[c.alias(n) for n, c in extra.items()])
    rows = stored(table.withColumn("node", F.lit(0)), "kd-rows")
    spans = [f(f"_d_{n}").alias(f"{tag}_{n}") for n in names for tag, f in (("low", F.min), ("high", F.max))]
    total = rows.agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n"), *spans).first()
    if leaves is None:
        leaves = max(1, -(-(total["w"] or 0) // leaf_bytes))
    nodes, done, made, level = [Node(0, leaves, 0, total["w"] or 0)], [], 1, 0
    while nodes:
        done += [n for n in nodes if n.leaves == 1 or n.weight == 0]
        nodes = [n for n in nodes if n.leaves > 1 and n.weight > 0]
        if not nodes:
            break
        if level and level % LEVELS == 0:
            rows = stored(rows, "kd-rows")
        level += 1
        listed = _table(rows, [{"node": n.number} for n in nodes], "node:int")
        widths = {r["node"]: r for r in rows.join(listed, "node", "left_semi").groupBy("node").agg(*spans).collect()}

        def width(n: Node, name: str) -> float:
            r, whole = widths[n.number], max(1, total[f"high_{name}"] - total[f"low_{name}"])
            return (r[f"high_{name}"] - r[f"low_{name}"]) / whole

        columns = [1 + max(range(len(names)), key=lambda j: width(n, names[j])) for n in nodes]
        below, splits = [], []
        for node, column, (threshold, left) in zip(nodes, columns, split_points(rows, nodes, columns, tolerance)):
            half = node.leaves // 2
            below.append(Node(made, half, node.shard, left))
            below.append(Node(made + 1, node.leaves - half, node.shard + half, node.weight - left))
            splits.append({"node": node.number, "column": column, "threshold": threshold, "left": made, "right": made + 1})
            made += 2
        rows, nodes = _descend(rows, splits), below
    shards = _table(rows, [{"node": n.number, "shard": n.shard} for n in done], "node:int,shard:int")
    dealt = rows.join(shards, "node").select("key", "weight", *extra, "shard")
    return numbered(dealt, ["shard"], ["key", "weight", *extra], total["n"])


def text_shards(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, size, text_crc32, law, shard, slot, grown_shard``: shards of near equal bytes.

    The size is the text's UTF-8 bytes plus 1 (null: 1). The tree splits by characters, words, lines and multi-byte
    excess of the text on logarithmic scales; equal texts are one group.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    size = F.octet_length(whole) + 1

    def scaled(c: Column) -> Column:
        return F.floor(F.log2(c.cast("double") + 1) * (1 << 20)).cast("long")

    words = F.regexp_count(whole, F.lit(r"\x20"))
    lines = F.length(whole) - F.length(F.translate(whole, "\n", ""))
    dims = {"chars": scaled(F.length(whole)), "words": scaled(words), "lines": scaled(lines),
            "wide": scaled(F.octet_length(whole) - F.length(whole))}
    out = kd_shards(docs, F.col(key), size, dims, whole, leaves=shards,
                    keep={"text_crc32": F.crc32(whole.cast("binary"))})
    return out.select(F.col("key").alias(key), F.col("weight").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
