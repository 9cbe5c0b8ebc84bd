"""Toxicity by weak supervision: mined voters, a generative label model, and a linear classifier on its posteriors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import mix, odd_numbers, powers, stored
from tapeloom.llm.langid import letters

# Features are words and their first 4, 5 and 6 letters, hashed into this many slots.
SLOTS, PREFIXES = 1 << 20, (4, 5, 6)
# Code points looked at together; a word that a border would cut goes with the next piece.
PIECE = 1 << 19
# Labelled and further documents that the models are fitted on (expected numbers), and the features they may use.
LABELLED, FURTHER, FEATURES = 12_000, 3_000, 8192
# Lexicon voters, the least log odds of their terms, and the accuracy assumed of a given label.
LEXICONS, LEAST_ODDS, GIVEN = 16, 2.0, 0.98
CUT = 0.7
_KINDS = odd_numbers(8, 51)
_CODE = odd_numbers(1, 52)[0]


def slots(text: str) -> Iterator[np.ndarray]:
    """Feature slots of all words (runs of letters, lower-cased), piece by piece."""
    lower, at = text.lower(), 0
    while at < len(lower):
        end = min(len(lower), at + PIECE)
        while end < len(lower) and end > at + 1 and lower[end - 1].isalpha() and lower[end].isalpha() and end > at + PIECE // 2:
            end -= 1
        codes = np.frombuffer(lower[at:end].encode("utf-32-le", "surrogatepass"), np.uint32)
        at = end
        is_letter = letters()[codes]
        edge = np.diff(is_letter.astype(np.int8), prepend=0, append=0)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(first):
            continue
        up, down = powers(len(codes) + 1)
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(mix(codes.astype(np.uint64) + _CODE) * up[: len(codes)], out=total[1:])
        out = [mix((total[last] - total[first]) * down[first] + _KINDS[0])]
        for kind, n in enumerate(PREFIXES, 1):
            long = first[last - first >= n]
            out.append(mix((total[long + n] - total[long]) * down[long] + _KINDS[kind]))
        yield (np.concatenate(out) & np.uint64(SLOTS - 1)).astype(np.int64)


def patterns(text: str) -> list[int]:
    """Votes of the pattern voters: 1 toxic, -1 clean, 0 abstains."""
    upper, shouts = sum(map(str.isupper, text)) / max(1, len(text)), text.count("!!")
    return [int(shouts >= 2), int(upper > 0.3), -int(shouts == 0 and upper < 0.1)]


@dataclass
class LabelModel:
    """Class-conditional vote probabilities per voter, discounted for correlation: ``log_odds[voter, vote + 1]``."""

    log_odds: np.ndarray
    prior: float

    def posterior(self, votes: np.ndarray, given: np.ndarray) -> np.ndarray:
        """Probability of toxic, from the votes and, where ``given`` is 0 or 1, a label of accuracy GIVEN."""
        z = np.log(self.prior / (1 - self.prior)) + self.log_odds[np.arange(votes.shape[1]), votes + 1].sum(axis=1)
        told = np.log(GIVEN / (1 - GIVEN))
        return 1 / (1 + np.exp(-np.clip(z + np.where(given == 1, told, np.where(given == 0, -told, 0.0)), -50, 50)))


def fit_label_model(votes: np.ndarray, given: np.ndarray, rounds: int = 25) -> LabelModel:
    """Expectation maximisation over class-conditional vote distributions.

    Each round also measures the voters' correlations within the classes; a voter's log odds are divided by one plus
    the sum of its positive correlations, so that a group of voters that say the same counts about once.
    """
    n, m = votes.shape
    known = given >= 0
    model = LabelModel(np.zeros((m, 3)), float(np.clip((given == 1).sum() / max(1, known.sum()), 0.01, 0.99)))
    post = np.where(given == 1, GIVEN, np.where(given == 0, 1 - GIVEN, model.prior))
    for _ in range(rounds):
        odds = np.zeros((m, 3))
        for v in (-1, 0, 1):
            hit = votes == v
            yes = (hit * post[:, None]).sum(axis=0) + 1.0
            no = (hit * (1 - post)[:, None]).sum(axis=0) + 1.0
            odds[:, v + 1] = np.log(yes / (post.sum() + 3)) - np.log(no / ((1 - post).sum() + 3))
        centred = votes - np.where(post[:, None] > 0.5, (votes * post[:, None]).sum(axis=0) / max(post.sum(), 1e-9),
                                   (votes * (1 - post)[:, None]).sum(axis=0) / max((1 - post).sum(), 1e-9))
        spread = np.sqrt((centred**2).mean(axis=0)) + 1e-9
        together = (centred.T @ centred) / n / np.outer(spread, spread)
        np.fill_diagonal(together, 0)
        model.log_odds = odds / (1 + np.clip(together, 0, 1).sum(axis=1))[:, None]
        model.prior = float(np.clip(post.mean(), 0.005, 0.995))
        post = model.posterior(votes, given)
    return model


def fit_linear(found: list[np.ndarray], width: int, target: np.ndarray, epochs: int = 15, alpha: float = 1.0, beta: float = 1.0,
               l1: float = 0.5, l2: float = 0.005) -> tuple[np.ndarray, float]:
    """Sparse logistic regression on soft labels over 0/1 features, by FTRL steps with an elastic net.

    The L1 part keeps a feature out until its gradients add up to more than ``l1``, so the many features that a long
    text holds by chance get no weight.
    """
    z, n, w = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    rng = np.random.default_rng(1)
    penalty = np.append(np.full(width, l1), 0.0)
    for _ in range(epochs):
        for i in rng.permutation(len(found)):
            f = np.append(found[i], width)
            own = np.where(np.abs(z[f]) <= penalty[f], 0.0,
                           -(z[f] - np.sign(z[f]) * penalty[f]) / ((beta + np.sqrt(n[f])) / alpha + l2))
            g = 1 / (1 + np.exp(-np.clip(own.sum(), -50, 50))) - target[i]
            z[f] += g - (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / alpha * own
            n[f] += g * g
    w = np.where(np.abs(z) <= penalty, 0.0, -(z - np.sign(z) * penalty) / ((beta + np.sqrt(n)) / alpha + l2))
    return w[:-1], float(w[-1])


def best_cut(z: np.ndarray, toxic: np.ndarray) -> float:
    """The margin that divides labelled documents with the best F1, in the middle of the gap that it lies in."""
    order = np.argsort(-z, kind="stable")
    z, toxic = z[order], toxic[order]
    true = np.cumsum(toxic)
    f1 = 2 * true / (np.arange(1, len(z) + 1) + toxic.sum())
    ends = np.append(z[1:] < z[:-1], True)
    at = int(np.argmax(np.where(ends, f1, -1)))
    return float((z[at] + z[at + 1]) / 2) if at + 1 < len(z) else float(z[at] - 1)


def held_out(key: str) -> Column:
    """Rows whose labels are never learned from: crc32 of the id's decimal text leaves 1 when divided by 3 (null id: false)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _chance(key: str, salt: int) -> Column:
    return (F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(1 << 30)) + 0.5) / float(1 << 30)


def train(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> tuple[np.ndarray, float] | None:
    """Weights per slot and bias of the classifier; None unless both classes are labelled.

    Documents for fitting are a hash sample of the labelled rows that are not held out, and of further rows without
    using labels. Features count whose log-likelihood ratio between the labelled classes is more than chance gives the
    best of all frequent ones. Those with high smoothed log odds are terms; they are dealt into ``LEXICONS`` lexicon
    voters, next to voters on how many terms occur and on patterns. The label model weighs the voters; the classifier
    learns its posteriors from the up to ``FEATURES`` surest features.
    """
    told = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("id")).agg(
        F.max(F.col(label).cast("int")).alias("toxic"))
    n_told = told.count()
    if not n_told:
        return None
    picked = told.where(_chance("id", 3) < LABELLED / n_told)
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    n_rows = docs.count()
    further = rows.where(~held_out("id") & (_chance("id", 4) < FURTHER / max(1, n_rows))).withColumn("toxic", F.lit(-1))
    # The picked labels are bounded by LABELLED (expected), so they may be sent to every task.
    chosen = rows.join(F.broadcast(picked), "id").select("id", "text", "toxic").union(further)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [[s for s in slots(t)] for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "toxic": batch["toxic"], "found": [np.unique(np.concatenate(f)) if f else [] for f in found],
                                "votes": [patterns(t) for t in batch["text"]]})

    kind = docs.schema[key].dataType.simpleString()
    sample = stored(chosen.mapInPandas(features, f"id {kind}, toxic int, found array<long>, votes array<int>"), "toxicity-sample")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    yes, no = sizes.get(1, 0), sizes.get(0, 0)
    if not yes or not no:
        return None
    counts = sample.where("toxic >= 0").select("toxic", F.explode("found").alias("slot")).groupBy("slot").agg(
        F.sum(F.col("toxic")).alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    odds = F.log((F.col("a") + 0.5) / (yes + 1.0)) - F.log((F.col("b") + 0.5) / (no + 1.0))
    both, share = F.col("a") + F.col("b"), yes / (yes + no)

    def gain(part: Column, expected: Column) -> Column:
        return F.when(part > 0, part * F.log(part / expected)).otherwise(0.0)

    frequent = stored(counts.where("a + b >= 3").select(
        "slot", odds.alias("odds"), (2 * (gain(F.col("a"), both * share) + gain(F.col("b"), both * (1 - share)))).alias("g")), "toxicity-terms")
    least = 2 * np.log(max(frequent.count(), 1)) + 2
    terms = frequent.where(F.col("g") >= float(least)).orderBy(F.desc("g"), "slot").limit(FEATURES).toPandas()
    place = {s: i for i, s in enumerate(terms["slot"])}
    toxic_terms = set(terms["slot"][terms["odds"] > LEAST_ODDS])
    shared = docs.sparkSession.sparkContext.broadcast(set(place))

    def narrowed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["found"] = [[s for s in f if s in shared.value] for f in batch["found"]]
            yield batch

    data = sample.mapInPandas(narrowed, sample.schema).toPandas().sort_values(["id", "toxic"], ignore_index=True)
    n = len(data)
    given = data["toxic"].to_numpy()
    lexicon = np.zeros((n, LEXICONS), np.int64)
    hits = np.zeros(n, np.int64)
    for i, found in enumerate(data["found"]):
        own = [s for s in found if s in toxic_terms]
        hits[i] = len(own)
        for s in own:
            lexicon[i, s % LEXICONS] = 1
    several, none = (hits >= 3).astype(np.int64), -(hits == 0).astype(np.int64)
    votes = np.column_stack([lexicon, several, none, np.array(data["votes"].tolist())])
    model = fit_label_model(votes, given)
    post = model.posterior(votes, given)
    own = [np.array([place[s] for s in f], np.int64) for f in data["found"]]
    w, b = fit_linear(own, len(place), post)
    b += np.log(CUT / (1 - CUT)) - best_cut(np.array([w[f].sum() + b for f in own])[given >= 0], given[given >= 0] == 1)
    out = np.zeros(SLOTS)
    out[terms["slot"].to_numpy(np.int64)] = w
    return out.astype(np.float32), b


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """``key, held_out, score, predicted`` for every row of ``docs``.

    The score is the classifier's probability, from the whole text alone; an empty or null text gets the bias. Without
    labels of both classes all scores are 0. Repeated rows score alike; an empty table gives an empty result.
    """
    model = train(docs, labels, key, text, label)
    weights = None
    if model is not None:
        used = np.flatnonzero(model[0])
        weights = docs.sparkSession.sparkContext.broadcast((used, model[0][used], model[1]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = np.zeros(SLOTS, np.float32), 0.0
        if weights is not None:
            table[weights.value[0]], bias = weights.value[1], weights.value[2]
        for batch in batches:
            out = []
            for value in batch.column(1):
                if weights is None:
                    out.append(0.0)
                    continue
                kept = [s[table[s] != 0] for s in slots(value.as_py() or "")]
                found = np.unique(np.concatenate(kept)) if kept else np.zeros(0, np.int64)
                out.append(float(1 / (1 + np.exp(-np.clip(table[found].sum(dtype=np.float64) + bias, -50, 50)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["id", "score"])

    kind = docs.schema[key].dataType.simpleString()
    judged = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(judge, f"id {kind}, score double")
    return judged.select(F.col("id").alias(key), held_out("id").alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
