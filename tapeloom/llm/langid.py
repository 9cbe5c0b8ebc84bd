"""Language identification: sparse multinomial regression on TF-IDF character n-grams, FTRL, temperature."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import stored

UNDETERMINED = "und"
# Features are n-grams of 1 to 3 characters hashed into this many slots.
ORDERS, SLOTS = 3, 1 << 16
# Code points looked at together; longer texts come in pieces, each overlapping the next.
PIECE = 1 << 19
# Documents per language that the weights are fitted on (expected number), and the shards that fit them.
PER_LANGUAGE, SHARDS = 2000, 4
# One in so many sampled documents only sets the temperature.
CALIBRATE = 5
SCALE = 50.0

_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def grams(text: str) -> Iterator[np.ndarray]:
    """Slots of all n-grams of the lower-cased text, piece by piece; other than letters all count as one space.

    Runs of spaces count once, texts start and end with one. Nothing comes from a text without letters.
    """
    space = 32
    lower = text.lower()
    last = np.full(ORDERS - 1, space, np.uint32)[:1]
    for at in range(0, len(lower), PIECE):
        codes = np.frombuffer(lower[at: at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(letters()[codes], codes, np.uint32(space))
        whole = np.concatenate([last, codes] + ([np.array([space], np.uint32)] if at + PIECE >= len(lower) else []))
        keep = np.ones(len(whole), bool)
        keep[1:] = (whole[1:] != space) | (whole[:-1] != space)
        whole = whole[keep]
        seen = min(len(last), len(whole))
        out = []
        for n in range(1, ORDERS + 1):
            first = max(0, seen - n + 1)
            m = len(whole) - n + 1 - first
            if m <= 0:
                continue
            mixed = np.full(m, 0x9E3779B9 * n & 0xFFFFFFFF, np.uint32)
            for k in range(n):
                mixed = (mixed ^ whole[first + k: first + k + m]) * np.uint32(0x01000193 + 2 * k)
                mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x85EBCA6B)
            mixed ^= mixed >> np.uint32(13)
            slots = (mixed & np.uint32(SLOTS - 1)).astype(np.int64)
            out.append(slots[whole[first: first + m] != space] if n == 1 else slots)
        last = whole[-(ORDERS - 1):]
        if out and len(whole) > 1:
            yield np.concatenate(out)


def has_letters(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    """``weights[slot, class]`` already hold the idf; scores are ``softmax(logits / temperature)``."""

    classes: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.classes)), 0
        for slots in grams(text):
            total += self.weights[slots].sum(axis=0, dtype=np.float64)
            n += len(slots)
        return self.bias + total * (SCALE / max(n, 1))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Follow-the-regularised-leader steps for a multinomial model, with L1 and L2 penalties (elastic net)."""

    def __init__(self, n_classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.5) -> None:
        self.z, self.n = np.zeros((SLOTS + 1, n_classes)), np.zeros((SLOTS + 1, n_classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[rows]
        leader = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[rows])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, leader)

    def step(self, rows: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(rows)
        error = softmax(values @ w)
        error[label] -= 1
        g = values[:, None] * error
        n = self.n[rows]
        self.z[rows] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[rows] = n + g * g


def document_frequencies(docs: DataFrame, text: str) -> DataFrame:
    """``slot, df``: in how many of all texts each slot occurs; ``slot`` -1 counts the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            for value in batch.column(0):
                seen = np.zeros(SLOTS, bool)
                for slots in grams(value.as_py() or ""):
                    seen[slots] = True
                df += seen
                n += 1
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1)), pa.array(np.append(df[used], n))], ["slot", "df"])

    return docs.select(F.col(text).cast("string")).mapInArrow(count, "slot long, df long").groupBy("slot").agg(F.sum("df").alias("df"))


def train(docs: DataFrame, text: str, label: str, order: Column, per_language: int = PER_LANGUAGE) -> Model | None:
    """Fit on ``docs`` (rows with a label); None without any.

    Document frequencies are counted over all rows. The weights are fitted on a sample of ``per_language`` expected
    documents of each class, those with the smallest hash ``order``; each of ``SHARDS`` parts runs FTRL over whole
    texts and the weights are averaged. The temperature minimises the log loss on sampled documents held out of that.
    """
    sizes = {r[0]: r[1] for r in docs.groupBy(label).count().collect()}
    classes = sorted(sizes)
    if not classes:
        return None
    counts = document_frequencies(docs, text).toPandas()
    n_docs = int(counts.df[counts.slot == -1].iloc[0])
    idf = np.zeros(SLOTS, np.float64)
    real = counts[counts.slot >= 0]
    idf[real.slot.to_numpy()] = np.log((1 + n_docs) / (1 + real.df.to_numpy())) + 0.1
    share = F.create_map(*[F.lit(x) for c in classes for x in (c, per_language / sizes[c])])
    chance = (F.pmod(order, F.lit(1 << 30)) + 0.5) / float(1 << 30)
    sample = stored(docs.select(F.col(text).cast("string").alias("text"), F.col(label).alias("label"), order.alias("o"))
                    .where(chance < share[F.col("label")]), "language-sample")
    fit = sample.where(F.pmod(F.xxhash64("o"), F.lit(CALIBRATE)) != 0)

    def fit_shard(group: pd.DataFrame) -> pd.DataFrame:
        model, at = Ftrl(len(classes)), {c: i for i, c in enumerate(classes)}
        for row in group.sort_values("o", kind="stable").itertuples():
            found = list(grams(row.text or ""))
            if not found:
                continue
            tf = np.bincount(np.concatenate(found), minlength=SLOTS)
            rows = np.flatnonzero(tf)
            values = tf[rows] * idf[rows] * (SCALE / tf.sum())
            model.step(np.append(rows, SLOTS), np.append(values, 1.0), at[row.label])
        w = model.weights()
        rows, kinds = np.nonzero(w)
        return pd.DataFrame({"slot": rows, "kind": kinds, "w": w[rows, kinds]})

    parts = fit.withColumn("shard", F.pmod(F.xxhash64("o", F.lit(1)), F.lit(SHARDS)))
    fitted = parts.groupBy("shard").applyInPandas(fit_shard, "slot long, kind long, w double")
    w = np.zeros((SLOTS + 1, len(classes)))
    for row in fitted.groupBy("slot", "kind").agg(F.sum("w").alias("w")).toPandas().itertuples():
        w[row.slot, row.kind] = row.w / SHARDS
    model = Model(classes, (w[:SLOTS] * idf[:, None]).astype(np.float32), w[SLOTS])

    def raw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"label": batch.label, "logits": [model.logits(t or "") for t in batch.text]})

    held = sample.where(F.pmod(F.xxhash64("o"), F.lit(CALIBRATE)) == 0)
    seen = held.select("text", "label").mapInPandas(raw, "label string, logits array<double>").toPandas()
    if len(seen):
        logits = np.array(seen.logits.tolist())
        truth = np.array([classes.index(c) for c in seen.label])
        grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
        loss = [-np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def predict(docs: DataFrame, model: Model | None, text: str, out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its score (columns of those names are replaced).

    ``und`` and 0 for a text that is null or has no letter.
    """
    kept = [c for c in docs.columns if c not in out]
    schema = docs.drop(*out).withColumn(out[0], F.lit(None).cast("string")).withColumn(out[1], F.lit(None).cast("double")).schema

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for value in batch.column(len(kept)):
                t = value.as_py()
                if model is None or not has_letters(t):
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                p = softmax(model.logits(t) / model.temperature)
                best = int(np.argmax(p))
                names.append(model.classes[best])
                scores.append(float(p[best]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*kept, *out])

    return docs.select(*kept, F.col(text).cast("string").alias("_text_")).mapInArrow(classify, schema)


def held_out(key: str) -> Column:
    """Rows never learned from: crc32 of the id's decimal text leaves 2 when divided by 4 (null id: false)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learned(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    """The model learned from text and label of the rows of ``docs`` that are not held out and have an id and a label."""
    rows = docs.where(~held_out(key) & F.col(key).isNotNull() & F.col(label).isNotNull())
    return train(rows, text, label, F.xxhash64(F.col(key)), per_language)


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """``key, held_out, lang_pred, score`` for every row.

    Labels only serve learning (see :func:`learned`). Ties go to the class that sorts first. Repeated rows are scored
    alike; an empty table gives an empty result; a table without labels gives ``und`` throughout.
    """
    model = learned(docs, key, text, label, per_language)
    out = predict(docs.select(F.col(key), F.col(text).alias("_whole")), model, "_whole")
    return out.select(key, held_out(key).alias("held_out"), "lang_pred", "score")
