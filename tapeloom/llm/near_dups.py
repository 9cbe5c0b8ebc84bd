"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidates, exact confirmation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import stored
from tapeloom.llm.graph import components
from tapeloom.llm.shingles import Signer, fingerprint, shingle_sets

# At a resemblance of 0.85 a pair shares none of 40 bands of 8 rows once in 300,000 times.
BANDS, ROWS = 40, 8
# At a resemblance of 0.80 a pair shares none of 80 bands of 8 rows four times in 10 million.
PERCENT_80 = {"percent": 80, "bands": 80, "rows": 8}
# Members of a hub that one task confirms.
PER_HUB = 256


def signatures(docs: DataFrame, key: str, text: str, width: int, bands: int, rows: int) -> DataFrame:
    """``key, n_shingles, f1, f2, bands`` per document; ``bands`` is null for an empty set."""
    schema = "id long, n_shingles long, f1 long, f2 long, bands array<long>"

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, rows)
        for batch in batches:
            ids, sets = batch.column(0), shingle_sets(batch.column(1), width)
            for at in range(0, len(ids), 256):
                own = [next(sets) for _ in range(min(256, len(ids) - at))]
                full = [s for s in own if len(s)]
                keys = iter(signer.keys(full).view(np.int64)) if full else iter(())
                prints = [fingerprint(s) for s in own]
                yield pa.RecordBatch.from_arrays([
                    ids.slice(at, len(own)), pa.array([len(s) for s in own], pa.int64()),
                    pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()),
                    pa.array([next(keys) if len(s) else None for s in own], pa.list_(pa.int64())),
                ], ["id", "n_shingles", "f1", "f2", "bands"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(sign, schema)


def full_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """``id, hashes``: the whole shingle sets of the documents in ``wanted``."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, each = batch.column(0), shingle_sets(batch.column(1), width)
            for at in range(0, len(ids), 256):
                own = [next(each).view(np.int64) for _ in range(min(256, len(ids) - at))]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(own)), pa.array(own, pa.list_(pa.int64()))], ["id", "hashes"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.join(wanted.hint("shuffle_hash"), "id", "left_semi").mapInArrow(sets, "id long, hashes array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``a, b`` among ``pairs`` whose sets share at least ``percent`` % of their union.

    A hub ``a`` with many members is copied once per ``PER_HUB`` of them, so its members are spread over tasks.
    """
    loads = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PER_HUB).cast("int").alias("parts"))
    salted = pairs.join(loads, "a").withColumn("salt", F.pmod(F.hash("b"), F.col("parts")))
    members = salted.join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb")), "b")
    hubs = loads.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha")), "a").select(
        "a", "ha", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    shared = F.size(F.array_intersect("ha", "hb"))
    return members.join(hubs, ["a", "salt"]).where(
        100 * shared >= percent * (F.size("ha") + F.size("hb") - shared)).select("a", "b")


def prefix_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Every pair ``a < b`` of ``nodes`` (``node, root, n``) with different roots that may be linked, without all pairs.

    Two sets of sizes ``x`` and ``y`` are linked only if they share ``s >= percent * (x + y) / (100 + percent)``
    elements; then, with elements in one order, they share one among their first ``x - s + 1`` and ``y - s + 1``. The
    rarest elements come first, so texts that resemble each other without being linked differ in those. Sizes are put in
    classes 5 % wide and each set is listed under its leading elements once per class that a partner can be in;
    elements that a single set holds and lists within one component are dropped. Of what meets in a list, the places of
    the element in both sets rule out most: from their first common element on both must hold enough.
    """
    step = 1.05
    whole = sets.select(F.col("id").alias("node"), "hashes").join(nodes, "node").select("node", "root", F.explode("hashes").alias("g"))
    often = whole.groupBy("g").agg(F.count(F.lit(1)).alias("often"))
    order = whole.join(often, "g").groupBy("node", "root").agg(
        F.array_sort(F.collect_list(F.struct("often", "g"))).alias("order")).withColumn("n", F.size("order"))

    def size_class(n: Column) -> Column:
        return F.floor(F.log(step, n.cast("double"))).cast("int")

    low, high = F.ceil(F.col("n") * percent / 100.0), F.floor(F.col("n") * 100.0 / percent)
    ways = order.withColumn("own", size_class(F.col("n"))).withColumn(
        "other", F.explode(F.sequence(size_class(low) - 1, size_class(high) + 1)))
    least = F.greatest(F.floor(F.pow(F.lit(step), F.col("other"))) - 1, low)
    need = F.ceil((F.col("n") + least) * percent / (100.0 + percent) - 1e-9)
    lead = F.slice("order", F.lit(1), F.greatest(F.col("n") - need + 1, F.lit(0)).cast("int"))
    listed = ways.select("node", "root", "n", "own", "other", F.posexplode(lead).alias("at", "e")).where("e.often > 1").select(
        "node", "root", "n", "own", "at", F.struct("e.g", F.least("own", "other").alias("c0"), F.greatest("own", "other").alias("c1")).alias("list"))
    listed = stored(listed, "listed")
    split = listed.groupBy("list").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("list")
    kept = listed.join(split.hint("shuffle_hash"), "list", "left_semi")
    left = kept.select("list", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("own").alias("ca"), F.col("at").alias("ia"))
    right = kept.select("list", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("own").alias("cb"), F.col("at").alias("ib"))
    near = (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & (
        F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (
        F.col("ca") + F.col("cb") == left["list.c0"] + left["list.c1"]) & (
        # What both have from their first common element on must be enough.
        F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) * (100 + percent) >= (F.col("na") + F.col("nb")) * percent)
    return left.join(right, (left["list"] == right["list"]) & near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 85,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``key, n_shingles, component_id, kept`` for every row of ``docs``.

    Two documents are linked when their shingle sets share at least ``percent`` % of their union; a component is what
    links connect, named by its least id. Documents with equal sets form a class first, so exact copies cost one row
    each, however many there are. Each class enters ``bands`` buckets. In a bucket the least member is the hub and the
    only candidate pairs are hub and member (a star); candidates are confirmed on whole sets. Stars alone could miss a
    link between two members, so the members of buckets that confirmed links leave in several components go through an
    exact join on their rarest shingles (:func:`prefix_pairs`). A bucket of linked texts never costs more than a star.

    Null or word-less texts have an empty set and are linked with nothing. Rows repeating an id should repeat the text:
    each gets the component of its own text (:func:`one_of_each` tells different texts under one id apart). Rows with a null id and no identified copy get a null
    ``component_id`` and are kept. Other columns are not read; an empty table gives an empty result.
    """
    signed = stored(signatures(docs, key, text, width, bands, rows), "signatures")
    filled = signed.where("n_shingles > 0")
    classes = stored(filled.groupBy("f1", "f2", "n_shingles").agg(F.min("id").alias("node")), "classes")
    leaders = filled.join(classes.where("node IS NOT NULL").select(F.col("node").alias("id"), "f1", "f2").hint("shuffle_hash"),
                          ["id", "f1", "f2"], "left_semi")
    entries = leaders.select(F.explode("bands").alias("bucket"), F.col("id").alias("node"), F.col("n_shingles").alias("n"))
    shared = entries.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    members = stored(entries.join(shared.hint("shuffle_hash"), "bucket").select("bucket", "node", "n", "low"), "buckets")
    sets = stored(full_sets(docs, members.select(F.col("node").alias("id")).distinct(), key, text, width), "sets")
    like = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent

    hubs = members.where("node = low").select("bucket", F.col("node").alias("a"), F.col("n").alias("na")).distinct()
    tries = members.where("node <> low").join(hubs.hint("shuffle_hash"), "bucket").select(
        "a", "na", F.col("node").alias("b"), F.col("n").alias("nb"))
    links = stored(confirmed(tries.where(like).select("a", "b").distinct(), sets, percent), "links")
    roots = stored(components(links), "roots")
    labelled = members.select("bucket", "node", "n").join(roots, "node", "left").select(
        "bucket", "node", "n", F.coalesce("root", "node").alias("root"))
    torn = labelled.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1")
    rest = stored(labelled.join(torn.select("bucket").hint("shuffle_hash"), "bucket", "left_semi").groupBy("node", "root").agg(
        F.min("n").alias("n")), "rest")
    if not rest.isEmpty():
        found = stored(confirmed(prefix_pairs(rest, sets, percent), sets, percent), "links")
        if not found.isEmpty():
            roots = stored(components(links.union(found)), "roots")

    named = classes.join(roots, "node", "left").select("f1", "f2", F.col("n_shingles").alias("n"), F.coalesce("root", "node").alias("component"))
    placed = signed.join(named, (signed.f1 == named.f1) & (signed.f2 == named.f2) & (signed.n_shingles == named.n), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id"))
    return placed.select(
        F.col("id").alias(key), "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings: int) -> DataFrame:
    """``docs`` without near duplicates: of each component the document with the least id, once; own columns only.

    Different texts under one id are different documents, judged one by one: a document is an id with the fingerprint
    of its text. Of a component's documents with the least id the one with the least fingerprint stays, and of its rows
    the least one in the order of all columns. Rows with a null id all stay.
    """
    named = docs.where(F.col(key).isNotNull()).withColumn("_row", F.xxhash64(F.col(key), F.col(text).cast("string")))
    groups = near_duplicates(named, "_row", text, **settings).select("_row", "component_id").distinct()
    rows = named.select(key, "_row").join(groups.hint("shuffle_hash"), "_row")
    least = rows.groupBy("component_id").agg(F.min(F.struct(key, "_row")).alias("least")).select("least.*")
    left = named.join(least.hint("shuffle_hash"), [key, "_row"], "left_semi")
    # Maps and variants have no order of their own.
    order = [F.to_json(F.struct(f.name)) if re.search("map<|variant", f.dataType.simpleString()) else F.col(f.name)
             for f in docs.schema if f.name not in (key, text)]
    one = left.groupBy(key, "_row").agg(F.min_by(F.struct(*docs.columns), F.struct(F.lit(0), *order)).alias("one")).select("one.*")
    return one.union(docs.where(F.col(key).isNull()))
