"""Benchmark decontamination: a broadcast hash set of benchmark word windows, scanned, verified and removed."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from tapeloom.llm.common import CHUNK, mix, odd_numbers, pieces, powers, stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
# Bytes of windows and item names in one broadcast; a larger set is broadcast in parts, one scan each.
PART_BYTES = 48 << 20
LEAK = "struct<n_words:long,spans:array<struct<start:int,end:int,first:int,last:int>>,items:array<string>>"
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("first", pa.int32()), ("last", pa.int32())])
_LEAK = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(_SPAN)), ("items", pa.list_(pa.string()))])

_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_LOWERED = np.frombuffer(_LOWER, np.uint8)
_SYMBOL = odd_numbers(256, 41)
_LENGTH = int(odd_numbers(1, 42)[0])
_BASE = int(powers(2)[0][1])


def word_table(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and end byte of all words (A-Z lower-cased) of consecutive texts, and each text's first word.

    Bytes are hashed ``CHUNK`` at a time; a word that a border cuts is carried on, so a long text takes no more working
    memory than its words.
    """
    hashes, firsts, lasts = [], [], []
    begun, part, length = -1, np.zeros(1, np.uint64), 0
    up, down = powers(CHUNK + 1)
    borders = np.unique(offsets)
    for base in range(0, len(data), CHUNK):
        own = data[base: base + CHUNK]
        word = _IS_WORD[own]
        cut = np.zeros(len(own) + 1, bool)
        cut[borders[(borders >= base) & (borders <= base + len(own))] - base] = True
        opens, closes = word.copy(), word.copy()
        opens[1:] &= ~word[:-1] | cut[1:-1]
        closes[:-1] &= ~word[1:] | cut[1:-1]
        first, last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        total = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(_SYMBOL[_LOWERED[own]] * up[: len(own)], out=total[1:])
        sums, sizes = (total[last] - total[first]) * down[first], last - first
        first = first + base
        if begun >= 0:
            if len(sums) and first[0] == base:
                sums[:1] = part + sums[:1] * np.uint64(pow(_BASE, length, 1 << 64))
                sizes[0] += length
                first[0] = begun
            else:
                sums, sizes = np.concatenate([part, sums]), np.insert(sizes, 0, length)
                first, last = np.insert(first, 0, begun), np.insert(last, 0, 0)
            begun = -1
        if len(last) and last[-1] == len(own) and base + CHUNK < len(data):
            begun, part, length = int(first[-1]), sums[-1:], int(sizes[-1])
            sums, sizes, first, last = sums[:-1], sizes[:-1], first[:-1], last[:-1]
        hashes.append(mix(sums + sizes.astype(np.uint64)))
        firsts.append(first)
        lasts.append(first + sizes)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    if begun >= 0:
        hashes.append(mix(part + np.uint64(length)))
        firsts.append(np.array([begun]))
        lasts.append(np.array([begun + length]))
    first = np.concatenate(firsts)
    return np.concatenate(hashes), first, np.concatenate(lasts), np.searchsorted(first, offsets)


@dataclass
class WindowSet:
    """Distinct windows sorted by hash, with their words and items; ``lengths`` are the window lengths that occur."""

    places: np.ndarray
    hashes: np.ndarray
    grams: list[bytes]
    items: list[list[str]]
    lengths: list[int]
    bitmap: np.ndarray

    @staticmethod
    def of(pairs: list[tuple[str, str | None]]) -> WindowSet:
        """From (window, item) pairs; the words of a window are separated by one space."""
        held: dict[bytes, list[str]] = {}
        for gram, item in pairs:
            own = held.setdefault(gram.encode(), [])
            if item is not None:
                own.append(item)
        grams = list(held)
        sizes = [g.count(b" ") + 1 for g in grams]
        places = odd_numbers(max(sizes, default=1), 43)
        whole = b"\n".join(grams)
        starts = np.cumsum([0, *(len(g) + 1 for g in grams)])[: len(grams)]
        words, _, _, at = word_table(np.frombuffer(whole, np.uint8), starts)
        sums = [(words[a: a + n] * places[:n]).sum(keepdims=True, dtype=np.uint64) + _mark(n) for a, n in zip(at.tolist(), sizes)]
        hashes = mix(np.concatenate([np.zeros(0, np.uint64), *sums]))
        order = np.argsort(hashes)
        bits = min(24, max(16, math.ceil(math.log2(64 * len(grams) + 1))))
        bitmap = np.zeros(1 << bits, bool)
        bitmap[hashes >> np.uint64(64 - bits)] = True
        return WindowSet(places, hashes[order], [grams[i] for i in order], [held[grams[i]] for i in order], sorted(set(sizes)), bitmap)

    def find(self, data: np.ndarray, words: np.ndarray, first: np.ndarray, last: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """``(row, word, length, window)`` of every verified occurrence in consecutive texts."""
        shift = np.uint64(64 - int(math.log2(len(self.bitmap))))
        rolled, raw = words * self.places[0], None
        for n in range(1, self.lengths[-1] + 1 if self.lengths else 1):
            size = len(words) - n + 1
            if size <= 0:
                break
            if n > 1:
                rolled = rolled[:size] + words[n - 1:] * self.places[n - 1]
            if n not in self.lengths:
                continue
            hashes = mix(rolled + _mark(n))
            near = np.flatnonzero(self.bitmap[hashes >> shift])
            place = np.searchsorted(self.hashes, hashes[near])
            place[place == len(self.hashes)] = 0
            same = self.hashes[place] == hashes[near]
            rows = np.searchsorted(bounds, near, "right") - 1
            whole = same & (near + n <= bounds[np.minimum(rows + 1, len(bounds) - 1)])
            for word, row, at in zip(near[whole].tolist(), rows[whole].tolist(), place[whole].tolist()):
                raw = data.tobytes() if raw is None else raw
                gram = b" ".join([raw[a:b] for a, b in zip(first[word: word + n].tolist(), last[word: word + n].tolist())]).translate(_LOWER)
                while at < len(self.hashes) and self.hashes[at] == hashes[word]:
                    if self.grams[at] == gram:
                        yield row, word, n, at
                        break
                    at += 1


def _mark(n: int) -> np.uint64:
    return np.uint64(_LENGTH * n % (1 << 64))


def window_pairs(benchmark: DataFrame, n: int, item: str, text: str) -> DataFrame:
    """Distinct ``gram, item``: each item's windows of ``n`` words, or all its words where it has fewer."""
    lower = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = benchmark.select(F.col(item).cast("string").alias("item"), F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)).alias("w"))
    places = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
    grams = F.transform(places, lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))
    return words.where(F.size("w") > 0).select(F.explode(grams).alias("gram"), "item").distinct()


def _scanned(docs: DataFrame, text: str, out: str, pairs: list[tuple[str, str | None]]) -> DataFrame:
    """``docs`` with the column ``out`` (:data:`LEAK`): what one set of windows hits."""
    held = docs.sparkSession.sparkContext.broadcast(WindowSet.of(pairs))
    at = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = held.value
        for batch in batches:
            leaks: list[dict] = []
            for start, end, data, offsets in pieces(batch.column(at).cast(pa.string())):
                words, first, last, bounds = word_table(data, offsets)
                found: dict[int, list[tuple[int, int, int]]] = {}
                for row, word, size, gram in windows.find(data, words, first, last, bounds):
                    found.setdefault(row, []).append((word, size, gram))
                for row in range(end - start):
                    leak = {"n_words": int(bounds[row + 1] - bounds[row]), "spans": [], "items": []}
                    if row in found:
                        own = data[offsets[row]: offsets[row + 1]]
                        runs = merged([(w, w + n) for w, n, _ in found[row]])
                        # Code points before a byte: the bytes that do not continue one.
                        points = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
                        leak["spans"] = [{"start": int(points[first[a] - offsets[row]]), "end": int(points[last[b - 1] - offsets[row]]),
                                          "first": int(a - bounds[row]), "last": int(b - bounds[row])} for a, b in runs]
                        leak["items"] = sorted({i for gram in {g for _, _, g in found[row]} for i in windows.items[gram]})
                    leaks.append(leak)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaks, _LEAK)], [*batch.schema.names, out])

    return docs.mapInArrow(work, StructType([*docs.schema.fields, StructField(out, DataType.fromDDL(LEAK))]))


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs ``[first, last)`` of words, those that touch or overlap as one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _united(spans: list[dict]) -> list[dict]:
    """Spans of several scans of one text, those that touch or overlap in words as one."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["first"], s["last"])):
        if out and s["first"] <= out[-1]["last"]:
            if s["last"] > out[-1]["last"]:
                out[-1] = {**out[-1], "end": s["end"], "last": s["last"]}
        else:
            out.append(dict(s))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, out: str, n: int = WINDOW, text: str = "text", item: str = "item_id",
               item_text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """All rows and columns of ``docs`` with ``out``: the words of the text and what benchmark windows hit in it.

    A window is ``n`` consecutive words of an item, or the whole item where it has fewer. Distinct (window, item) pairs
    are formed on the cluster; their size is measured, and they are broadcast whole up to ``part_bytes``, beyond that in
    parts of that size, each scanned on its own and the hits united by row. A scan rolls hashes over the words of whole
    texts, looks them up in the hash set and compares every hit word by word, so no hash collision counts. Nothing is
    shuffled with one part; with several only the rows that hold hits are.

    ``out.spans`` are runs of hit words in code points (``start``, ``end``) and words (``first``, ``last``), ends
    exclusive; ``out.items`` the ids of the items hit, as sorted strings. A null text has no words; items with a null or
    word-less text have no windows; windows of an item without an id hit but are not listed; repeated rows and equal
    items each count. Empty tables on either side give rows without hits, or no rows. ``out`` must be a new name.
    """
    if out in docs.columns:
        raise ValueError(f"{out} is a column of the documents")
    pairs = stored(window_pairs(benchmark, n, item, item_text), "windows")
    size = F.octet_length("gram") + F.coalesce(F.octet_length("item"), F.lit(0)) + 32
    parts = max(1, -(-(pairs.agg(F.sum(size)).first()[0] or 0) // part_bytes))
    part = F.pmod(F.xxhash64("gram", "item"), F.lit(parts))

    def taken(i: int) -> list[tuple[str, str | None]]:
        return [(r["gram"], r["item"]) for r in pairs.where(part == i).toLocalIterator()]

    if parts == 1:
        return _scanned(docs, text, out, taken(0))
    row, first = "_row_of_leak", "_leak_n_words"
    base = stored(docs.withColumn(row, F.monotonically_increasing_id()), "leak-rows")
    partial = [stored(_scanned(base.select(row, text), text, out, taken(i)).select(row, out).where((F.size(f"{out}.items") > 0) | (F.size(f"{out}.spans") > 0)),
                      f"leaks-{i}") for i in range(parts)]
    hits = partial[0]
    for other in partial[1:]:
        hits = hits.union(other)
    grouped = hits.groupBy(row).agg(F.max(f"{out}.n_words").alias(first), F.flatten(F.collect_list(f"{out}.spans")).alias("spans"),
                                    F.array_sort(F.array_distinct(F.flatten(F.collect_list(f"{out}.items")))).alias("items"))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaks = [{"n_words": w, "spans": _united(s), "items": i} for w, s, i in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(leaks, _LEAK)], [row, out])

    united = grouped.mapInArrow(unite, f"{row} long, `{out}` {LEAK}")
    clean = F.struct(n_words(F.col(text)).alias("n_words"), F.array().cast("array<struct<start:int,end:int,first:int,last:int>>").alias("spans"),
                     F.array().cast("array<string>").alias("items"))
    return base.join(united, row, "left").withColumn(out, F.coalesce(out, clean)).select(*docs.columns, out)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(F.translate(text.cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORD)), F.lit(0)).cast("long")


def n_hit(leak: str) -> Column:
    """Words in any span."""
    return F.aggregate(f"{leak}.spans", F.lit(0).cast("long"), lambda a, s: a + (s["last"] - s["first"]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", mark: str = " ", text: str = "text", **settings) -> DataFrame:
    """``docs`` without what its texts share with the benchmark (see :func:`find_leaks`); own columns only.

    ``remove="documents"`` drops every row that holds a hit; ``remove="spans"`` keeps all rows and puts ``mark`` in
    place of each run of hit words, from its first to its last character. Other texts stay as they are.
    """
    out = "_leak"
    while out in docs.columns:
        out += "_"
    found = find_leaks(docs, benchmark, out, text=text, **settings)
    if remove == "documents":
        return found.where(F.size(f"{out}.spans") == 0).select(*docs.columns)
    if remove != "spans":
        raise ValueError(f"remove must be 'spans' or 'documents', not {remove!r}")
    at, last = docs.columns.index(text), len(docs.columns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(last).field("spans").to_pylist()
            texts = batch.column(at).to_pylist()
            for i, own in enumerate(spans):
                if own:
                    ends = [0, *(s["end"] for s in own)]
                    texts[i] = mark.join([*(texts[i][e: s["start"]] for e, s in zip(ends, own)), texts[i][ends[-1]:]])
            columns = batch.columns[:last]
            columns[at] = pa.array(texts, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:last])

    return found.mapInArrow(work, docs.schema)


def summary(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``key, n_words, n_hit, n_items, items_sha256, contaminated`` for every row of ``docs``."""
    found = find_leaks(docs.select(F.col(key), F.col(text).alias("_text")), benchmark, "_leak", text="_text", **settings)
    return found.select(
        key, F.col("_leak.n_words").alias("n_words"), n_hit("_leak").alias("n_hit"), F.size("_leak.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_leak.items", ","), 256).alias("items_sha256"), (F.size("_leak.spans") > 0).alias("contaminated"))
