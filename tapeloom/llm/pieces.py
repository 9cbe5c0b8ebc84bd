"""SentencePiece encoding with seeded merge-dropout, and lossless decoding."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import mix, odd_numbers, powers

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = 0x2581
# Stands for a U+2581 that the text itself holds; it goes to bytes, so that decoding tells it from a space.
LITERAL = 0x110000
DROPOUT, SEED = 0.1, 7
# Code points encoded together, and the longest unit that the joint merging takes.
CHUNK, LONGEST = 1 << 20, 48
NONE = np.int32(2**31 - 1)
_CODE = odd_numbers(2, 41)


class Merger:
    """Merge-type segmentation of a SentencePiece model, many units at a time.

    A unit is a run of spaces with what follows up to the next space, or one character that no longer piece holds; no
    piece reaches over its borders, so units are segmented by themselves.
    """

    def __init__(self, model: bytes, dropout: float, seed: int) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.dropout = np.uint64(min(max(dropout, 0.0), 1.0) * (2**64 - 2**11))
        self.seed = np.uint64(int(mix(np.array([seed], np.int64).view(np.uint64))[0]))
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        plain = [i for i in range(len(names)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        ids = {names[i]: i for i in plain}
        self.byte = np.zeros(256, np.int32)
        for i, name in enumerate(names):
            if sp.is_byte(i):
                self.byte[int(name[3:5], 16)] = i
        # Pieces in order of preference; equal scores rank equal, the leftmost is then merged first.
        scores = np.array([sp.get_score(i) for i in range(len(names))])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        self.char = np.full(LITERAL + 1, -1, np.int32)
        held = set()
        pairs = []
        for name, i in ids.items():
            if len(name) == 1:
                self.char[ord(name)] = i
            else:
                held.update(name)
                pairs += [(ids[name[:k]], ids[name[k:]], i) for k in range(1, len(name)) if name[:k] in ids and name[k:] in ids]
        self.alone = np.ones(LITERAL + 1, bool)
        self.alone[[ord(c) for c in held if self.char[ord(c)] >= 0]] = False
        left, right, whole = (np.array(x, np.uint64) for x in zip(*pairs))
        self.keys, self.values = self._table(left << np.uint64(32) | right, whole.astype(np.int32))
        self.text = self._texts(names, plain)

    def _texts(self, names: list[str], plain: list[int]) -> list[bytes]:
        out = [b""] * len(names)
        for i in plain:
            out[i] = names[i].replace("▁", " ").encode()
        for b, i in enumerate(self.byte):
            out[i] = bytes([b])
        return out

    @staticmethod
    def _table(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An open-addressing table with at most a quarter of its places taken."""
        size = 1 << int(len(keys) * 4).bit_length()
        table, held = np.full(size, 2**64 - 1, np.uint64), np.full(size, NONE, np.int32)
        place = (mix(keys) & np.uint64(size - 1)).astype(np.int64)
        for k, v, at in zip(keys, values, place):
            while table[at] != 2**64 - 1 and table[at] != k:
                at = (at + 1) & (size - 1)
            table[at], held[at] = k, v
        return table, held

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two pieces make, NONE if there is none (or a piece is negative)."""
        out = np.full(left.shape, NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        key = left.ravel()[todo].astype(np.uint64) << np.uint64(32) | right.ravel()[todo].astype(np.uint64)
        at = (mix(key) & np.uint64(len(self.keys) - 1)).astype(np.int64)
        flat = out.ravel()
        while len(todo):
            here = self.keys[at]
            hit = here == key
            flat[todo[hit]] = self.values[at[hit]]
            more = ~hit & (here != np.uint64(2**64 - 1))
            todo, key, at = todo[more], key[more], (at[more] + 1) & (len(self.keys) - 1)
        return flat.reshape(left.shape)

    def ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Preference of the merge of two pieces, NONE if they make none."""
        made = self.merged(left, right)
        return np.where(made == NONE, NONE, self.rank[np.where(made == NONE, 0, made)])

    def skipped(self, key: np.ndarray, step: np.ndarray) -> np.ndarray:
        """Whether the merge candidate that the occurrence ``key`` comes to as its ``step``-th is dropped."""
        return mix(mix(key ^ self.seed) ^ mix(step.astype(np.uint64) * _CODE[0] + _CODE[1])) < self.dropout

    def segment(self, symbols: np.ndarray, sizes: np.ndarray, keys: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of units given as padded rows of symbols; returns padded pieces and their numbers.

        Each unit is its own agenda: of all candidate merges the best ranked, leftmost one is taken; it is either
        dropped for good by its keyed hash or done, which brings up to two new candidates. Without keys none is dropped.
        """
        n, width = symbols.shape
        out, counts = symbols.copy(), sizes.astype(np.int64).copy()
        if width < 2:
            return out, counts
        key = np.zeros(n, np.uint64) if keys is None else keys
        rows, s, size, step = np.arange(n), symbols.astype(np.int32), counts.copy(), 0
        rank = self.ranked(s[:, :-1], s[:, 1:])
        cols = np.arange(width + 1, dtype=np.int16)
        while len(rows):
            line, best = np.arange(len(rows)), rank.argmin(axis=1)
            alive = rank[line, best] != NONE
            if not alive.all():
                gone = ~alive
                out[rows[gone]], counts[rows[gone]] = s[gone], size[gone]
                rows, s, key, rank, size, best = (x[alive] for x in (rows, s, key, rank, size, best))
                line = np.arange(len(rows))
            drop = np.zeros(len(rows), bool)
            if keys is not None:
                # All rows still here have come to equally many candidates.
                drop = self.skipped(key, np.full(len(rows), step))
                rank[line[drop], best[drop]] = NONE
            step += 1
            left = s[line, best]
            s[line, best] = np.where(drop, left, self.merged(left, s[line, best + 1]))
            # Close the gap after a merge; a dropped candidate moves nothing.
            last = np.where(drop, width + 1, best).astype(np.int16)[:, None]
            gap = ~drop
            s[:, :-1] = np.where(cols[: width - 1] <= last, s[:, :-1], s[:, 1:])
            s[gap, -1] = -1
            rank[:, :-1] = np.where(cols[: width - 2] <= last, rank[:, :-1], rank[:, 1:])
            rank[gap, -1] = NONE
            size -= gap
            for shift in (0, -1):
                at = best + shift
                go = np.flatnonzero(gap & (at >= 0) & (at < width - 1))
                rank[go, at[go]] = self.ranked(s[go, at[go]], s[go, at[go] + 1])
        return out, counts

    def agenda(self, symbols: list[int], key: int | None) -> list[int]:
        """The same for one unit of any length, with a heap."""
        n = len(symbols)
        piece, nxt, prev = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))
        heap: list[tuple[int, int, int, int, int]] = []
        # No more candidates than pairs at first and two for each merge.
        drops = iter(() if key is None else self.skipped(np.full(3 * n, key, np.uint64), np.arange(3 * n)).tolist())

        def offer(lefts: list[int]) -> None:
            lefts = [i for i in lefts if i >= 0 and nxt[i] < n]
            if lefts:
                made = self.merged(np.array([piece[i] for i in lefts]), np.array([piece[nxt[i]] for i in lefts]))
                for i, m in zip(lefts, made.tolist()):
                    if m != NONE:
                        heapq.heappush(heap, (int(self.rank[m]), i, end[i], end[nxt[i]], m))

        offer(list(range(n - 1)))
        while heap:
            _, i, mid, stop, made = heapq.heappop(heap)
            j = nxt[i]
            if piece[i] < 0 or end[i] != mid or j >= n or end[j] != stop:
                continue
            if next(drops, False):
                continue
            piece[i], end[i], piece[j], nxt[i] = made, stop, -1, nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
            offer([prev[i], i])
        return [p for p in piece if p >= 0]

    def encode(self, texts: list[str], places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of consecutive texts and the number of ids of each text; ``places`` are their 64-bit keys."""
        codes = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
        sizes = np.array([len(c) + 1 if len(c) else 0 for c in codes])
        first = np.concatenate([[0], np.cumsum(sizes)])
        text = np.full(first[-1], SPACE, np.uint32)
        for c, at in zip(codes, first):
            if len(c):
                text[at + 1: at + 1 + len(c)] = np.where(c == 32, SPACE, np.where(c == SPACE, LITERAL, c))
        if not len(text):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        space, alone = text == SPACE, self.alone[text]
        begin = np.ones(len(text), bool)
        begin[1:] = (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
        begin[first[:-1][sizes > 0]] = True
        unit = np.flatnonzero(begin)
        length = np.diff(np.append(unit, len(text)))
        owner = np.searchsorted(first, unit, "right") - 1
        up, down = powers(len(text) + 1)
        total = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(mix(text.astype(np.uint64) + _CODE[0]) * up[: len(text)], out=total[1:])
        content = mix((total[unit + length] - total[unit]) * down[unit] + length.astype(np.uint64))
        short = length <= LONGEST
        _, sample, back = np.unique(content, return_index=True, return_inverse=True)
        if self.dropout:
            # Long units hardly ever pass without a drop.
            sample = np.where(short[sample], sample, -1)
        begins, each = np.zeros((2, len(sample)), np.int64)
        some = np.flatnonzero(sample >= 0)
        flat, begins[some], each[some] = self._segmented(text, unit[sample[some]], length[sample[some]], None)
        begins, each = begins[back], each[back]
        if self.dropout:
            place = mix(places[owner] ^ mix((unit - first[owner]).astype(np.uint64) + self.seed))
            # Without a drop a unit takes one candidate per merge; an occurrence that drops none of them is done.
            merges = np.where(short, np.maximum(length - each, 0), 0)
            varied = ~short
            for at in range(0, len(unit), 1 << 14):
                part = merges[at: at + (1 << 14)]
                which = at + np.repeat(np.arange(len(part)), part)
                step = np.arange(len(which)) - np.repeat(np.cumsum(part) - part, part)
                varied[which[self.skipped(place[which], step)]] = True
            some = np.flatnonzero(varied)
            more, at, each[some] = self._segmented(text, unit[some], length[some], place[some])
            begins[some] = len(flat) + at
            flat = np.concatenate([flat, more])
        ends = np.cumsum(each)
        ids = flat[np.repeat(begins - (ends - each), each) + np.arange(ends[-1])]
        return ids, np.bincount(owner, weights=each, minlength=len(texts)).astype(np.int64)

    def _segmented(self, text: np.ndarray, unit: np.ndarray, size: np.ndarray, keys: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Piece ids of the units of ``text`` from ``unit`` on, and where each unit's begin and how many they are."""
        counts, begins = np.zeros((2, len(unit)), np.int64)
        pool, order = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        edges = [1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, LONGEST]
        for low, width in zip([0] + edges, edges):
            some = np.flatnonzero((size > low) & (size <= width))
            if not len(some):
                continue
            cols = np.arange(width)
            inside = cols < size[some][:, None]
            at = np.minimum(unit[some][:, None] + cols, len(text) - 1)
            symbols = np.where(inside, self.char[text[at]], -1).astype(np.int32)
            if width == 1:
                single = text[at[:, 0]]
                bytes_ = [[int(s)] if s >= 0 else [int(self.byte[b]) for b in chr(SPACE if c == LITERAL else c).encode()]
                          for s, c in zip(symbols[:, 0], single)]
                counts[some] = [len(b) for b in bytes_]
                pool.append(np.array([x for b in bytes_ for x in b], np.int32))
            else:
                found, counts[some] = self.segment(symbols, size[some], None if keys is None else keys[some])
                pool.append(found[cols < counts[some][:, None]])
            order.append(some)
        for i in np.flatnonzero(size > LONGEST):
            ids = self.agenda(self.char[text[unit[i]: unit[i] + size[i]]].tolist(), None if keys is None else int(keys[i]))
            counts[i] = len(ids)
            pool.append(np.array(ids, np.int32))
            order.append(np.array([i]))
        where = np.concatenate(order)
        begins[where] = np.cumsum(counts[where]) - counts[where]
        return np.concatenate(pool), begins, counts

    def decode(self, ids: np.ndarray) -> str:
        """The text of one document's ids."""
        whole = b"".join(map(self.text.__getitem__, ids.tolist()))
        return whole[1:].decode() if whole else ""


def model_bytes(path: str = MODEL) -> bytes:
    """The model file, read by the driver and sent along with the tasks."""
    with open(path, "rb") as file:
        return file.read()


def runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, n = at, 0
        while end < len(texts) and (end == at or n + len(texts[end]) <= CHUNK):
            n += len(texts[end])
            end += 1
        yield at, end
        at = end


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", model: bytes | None = None,
           dropout: float = DROPOUT, seed: int = SEED, out: str = "piece_ids") -> DataFrame:
    """``docs`` with ``out``, the piece ids of the text, varied by merge-dropout.

    Each candidate merge of each occurrence of a unit is skipped with probability ``dropout``, decided by a hash of the
    seed, the document, the place in it and the candidate's number, so reruns and other partitionings give the same ids.
    Only occurrences that skip nothing share the segmentation of their unit. ``dropout=0`` is the model's own segmentation. A null text has null ids, an empty
    one none; a null key counts as 0; equal rows get equal ids; a column called ``out`` is replaced.
    """
    blob = docs.sparkSession.sparkContext.broadcast(model if model is not None else model_bytes())
    schema = docs.drop(out).withColumn(out, F.lit(None).cast("array<int>")).schema
    kept = [c for c in docs.columns if c != out]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = Merger(blob.value, dropout, seed)
        for batch in batches:
            texts = batch.column("_text_").to_pylist()
            places = mix(np.array([k or 0 for k in batch.column("_key_").to_pylist()], np.int64).view(np.uint64))
            for at, end in runs([t or "" for t in texts]):
                own = texts[at:end]
                ids, counts = merger.encode([t or "" for t in own], places[at:end])
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()), mask=pa.array([t is None for t in own]))
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), lists], [*kept, out])

    keyed = docs.select(*kept, F.col(key).cast("long").alias("_key_"), F.col(text).cast("string").alias("_text_"))
    return keyed.mapInArrow(work, schema)


def decode(docs: DataFrame, ids: str = "piece_ids", out: str = "decoded", model: bytes | None = None) -> DataFrame:
    """``docs`` with ``out``, the text that the ids stand for (null for null ids)."""
    blob = docs.sparkSession.sparkContext.broadcast(model if model is not None else model_bytes())
    kept = [c for c in docs.columns if c != out]
    schema = docs.drop(out).withColumn(out, F.lit(None).cast("string")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = Merger(blob.value, 0.0, 0)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column(ids)
                flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
                texts = [merger.decode(flat[ends[i]: ends[i + 1]]) if v else None for i, v in enumerate(lists.is_valid().to_pylist())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, out])

    return docs.select(*kept).mapInArrow(work, schema)


def summary(docs: DataFrame, key: str = "doc_id", text: str = "text", dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """Per row: ``key, n_chars, n_pieces, pieces_sha256, decoded_sha256, lossless``, decoded from the encoded ids."""
    coded = encode(docs.select(F.col(key), F.col(text).alias("text")), key, "text", None, dropout, seed)
    back = decode(coded)
    return back.select(
        F.col(key), F.length("text").cast("long").alias("n_chars"), F.size("piece_ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join("piece_ids", ","), 256).alias("pieces_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))
