"""Leaf-wise boosted trees for all windows of a walk-forward schedule, grown from histograms.

Features become bins once. A job adds up gradient sums and counts per (window, leaf, feature, bin) as vectors and picks
each leaf's best split where the sums are; the driver sees one row per leaf. Rows stay where they are: a task places them
in leaves by walking the trees, which are small.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tapeloom.session import cut_lineage

MODEL = "window_id long, round long, tree string"
HISTORY = "window_id long, round long, valid_loss double, is_best boolean"
TRAIN, VALID = 1, 2
# Rows of a block, rounds between two writings of the predictions, and histograms that a task holds before it hands them on.
BLOCK, SNAPSHOT, HELD = 4096, 20, 64
# Rows up to which a window is one group and grows its trees in one task; larger ones meet as sums, one job per level.
WHOLE = 16_384


@dataclass(frozen=True)
class Boosting:
    rounds: int = 2000
    patience: int = 100
    held_out_weeks: int = 8
    step: float = 0.05
    leaves: int = 64
    min_rows: int = 100
    l2: float = 1.0
    bins: int = 64
    row_share: float = 0.8
    feature_share: float = 0.8
    seed: int = 42


@dataclass
class Tree:
    """Nodes by number: ``splits[node] = (feature, bin, left, right)``; ``values`` of the leaves, the step included."""

    splits: dict[int, tuple[int, int, int, int]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of every row of binned features."""
        at = np.zeros(len(bins), np.int64)
        for node, (feature, cut, left, right) in sorted(self.splits.items()):
            mine = at == node
            at[mine] = np.where(bins[mine, feature] <= cut, left, right)
        return at

    def predict(self, bins: np.ndarray) -> np.ndarray:
        at = self.nodes(bins)
        values = np.zeros(max(self.values) + 1)
        values[list(self.values)] = list(self.values.values())
        return values[at]

    def coded(self) -> str:
        return json.dumps([[[k, *v] for k, v in self.splits.items()], list(self.values.items())])

    @staticmethod
    def decoded(text: str) -> Tree:
        splits, values = json.loads(text)
        return Tree({k: tuple(v) for k, *v in splits}, {int(k): v for k, v in values})


@dataclass
class Growth:
    """A tree while it grows: nodes with their sums and best splits; children are numbered when a split becomes known."""

    known: dict[int, tuple] = field(default_factory=dict)
    children: dict[int, tuple[int, int]] = field(default_factory=dict)
    count: int = 1

    def replay(self, leaves: int) -> tuple[list[int], list[int], list[int]]:
        """Splits in the order of their gains: ``(split nodes, leaves, leaves whose children are not known yet)``.

        The leaf with the greatest gain is split first (ties to the older node). Stops at ``leaves`` leaves, without
        gains, or where the next split's children are not known; the last list is empty when the tree is done.
        """
        split, ends = [], [0]
        while len(ends) < leaves:
            open_ = [n for n in ends if self.known[n][0] > 0]
            if not open_:
                break
            node = max(open_, key=lambda n: (self.known[n][0], -n))
            if node not in self.children:
                return split, ends, [n for n in open_ if n not in self.children]
            split.append(node)
            ends.remove(node)
            ends += self.children[node]
        return split, ends, []

    def partial(self) -> Tree:
        """All splits known so far, for placing rows."""
        return Tree({n: (self.known[n][1], self.known[n][2], *self.children[n]) for n in self.children})

    def finished(self, cfg: Boosting) -> Tree:
        split, ends, _ = self.replay(cfg.leaves)
        return Tree({n: (self.known[n][1], self.known[n][2], *self.children[n]) for n in split},
                    {n: -cfg.step * self.known[n][3] / (self.known[n][4] + cfg.l2) for n in ends})


def best_split(hist: np.ndarray, features: np.ndarray, cfg: Boosting) -> tuple[float, int, int, float, float]:
    """``gain, feature, bin, gradient sum, rows`` of a leaf from its ``features x bins x (gradient, rows)``; gain 0: none."""
    g, n = hist[0, :, 0].sum(), np.rint(hist[0, :, 1].sum())
    left_g, left_n = hist[:, :-1, 0].cumsum(axis=1), np.rint(hist[:, :-1, 1].cumsum(axis=1))
    gain = left_g**2 / (left_n + cfg.l2) + (g - left_g) ** 2 / (n - left_n + cfg.l2) - g * g / (n + cfg.l2)
    gain = np.where((left_n >= cfg.min_rows) & (n - left_n >= cfg.min_rows), gain, 0.0)
    at = int(np.argmax(gain))
    feature, cut = divmod(at, gain.shape[1])
    best = float(gain[feature, cut])
    return (best if best > 1e-12 else 0.0), int(features[feature]), cut, float(g), float(n)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sampled_rows(keys: np.ndarray, cfg: Boosting, window: int, round_: int) -> np.ndarray:
    """Which rows a tree sees, by their keys."""
    salt = np.uint64((cfg.seed * 0x9E3779B97F4A7C15 + window * 0xD1B54A32D192ED03 + round_ * 0x8CB92BA72F3D8DD7) % (1 << 64))
    return (_mixed(keys ^ salt) >> np.uint64(11)).astype(float) / float(1 << 53) < cfg.row_share


def sampled_features(width: int, cfg: Boosting, window: int, round_: int) -> np.ndarray:
    rng = np.random.default_rng([cfg.seed, window, round_])
    return np.sort(rng.choice(width, max(1, round(width * cfg.feature_share)), replace=False))


def cut_points(rows: DataFrame, bins: int) -> list[np.ndarray]:
    """Distinct approximate quantiles of every feature over all rows; one row per feature comes back."""
    shares = [i / bins for i in range(1, bins)]
    cuts = rows.select(F.posexplode("features").alias("feature", "v")).groupBy("feature").agg(
        F.percentile_approx("v", shares, 1000).alias("cuts")).orderBy("feature").toPandas()
    return [np.unique(c) for c in cuts["cuts"]]


def binned(features: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Number of cuts below each value."""
    return np.column_stack([np.searchsorted(c, features[:, i], "left") for i, c in enumerate(cuts)]).astype(np.uint8)


@dataclass(frozen=True)
class Span:
    """Training weeks of a window; the last ones are held out for the stop."""

    window: int
    first: int
    valid: int
    last: int

    def roles(self, weeks: np.ndarray) -> np.ndarray:
        return np.where((weeks < self.first) | (weeks > self.last), 0, np.where(weeks >= self.valid, VALID, TRAIN))


def histogram(x: np.ndarray, g: np.ndarray, bins: int) -> np.ndarray:
    """``(gradient sums, rows)`` per feature and bin, flat, of binned rows."""
    width = x.shape[1]
    at = (x + np.arange(width) * bins).ravel()
    return np.stack([np.bincount(at, np.repeat(g, width), width * bins), np.bincount(at, minlength=width * bins)], axis=1).ravel()


def ended(losses: Sequence[float], round_: int, cfg: Boosting) -> bool:
    return round_ >= cfg.rounds or round_ - int(np.argmin(losses)) >= cfg.patience


def grow_window(bins: np.ndarray, y: np.ndarray, keys: np.ndarray, roles: np.ndarray, base: float, window: int, cfg: Boosting) -> tuple[list[float], list[Tree]]:
    """Held-out losses and trees of one window whose rows are at hand; the same trees as from sums."""
    score, losses, trees = np.full(len(y), base), [], []
    while True:
        off = (score - y)[roles == VALID]
        losses.append(float(off @ off) / len(off) if len(off) else 0.0)
        round_ = len(trees)
        if ended(losses, round_, cfg):
            return losses, trees
        features = sampled_features(bins.shape[1], cfg, window, round_)
        use = np.flatnonzero((roles == TRAIN) & sampled_rows(keys, cfg, window, round_))
        x, g = bins[np.ix_(use, features)].astype(np.int64), (score - y)[use]
        growth, rows, wanted = Growth(), {0: np.arange(len(use))}, [0]
        sums = {0: histogram(x, g, cfg.bins)}
        while wanted:
            for node in wanted:
                growth.known[node] = best_split(sums[node].reshape(-1, cfg.bins, 2), features, cfg)
            _, _, unknown = growth.replay(cfg.leaves)
            wanted = []
            for node in unknown:
                left, right = growth.children[node] = (growth.count, growth.count + 1)
                growth.count += 2
                mine = rows.pop(node)
                low = bins[use[mine], growth.known[node][1]] <= growth.known[node][2]
                rows[left], rows[right] = mine[low], mine[~low]
                # The smaller child is added up, its sibling is what remains of the parent.
                few, more = sorted((left, right), key=lambda c: len(rows[c]))
                sums[few] = histogram(x[rows[few]], g[rows[few]], cfg.bins)
                sums[more] = sums.pop(node) - sums[few]
                wanted += [left, right]
        trees.append(growth.finished(cfg))
        score = score + trees[-1].predict(bins)


class _Block:
    """Rows of one block: bins, labels, keys, weeks and predictions per window."""

    def __init__(self, row, width: int, n_windows: int) -> None:
        self.bins = np.frombuffer(row.bins, np.uint8).reshape(-1, width)
        self.y, self.keys, self.weeks = np.frombuffer(row.y), np.frombuffer(row.row_keys, np.uint64), np.frombuffer(row.weeks, np.int64)
        self.scores = np.frombuffer(row.scores).reshape(-1, n_windows).copy()

    def add(self, recent: list[list[Tree]]) -> None:
        for w, trees in enumerate(recent):
            for tree in trees:
                self.scores[:, w] += tree.predict(self.bins)


BLOCKS = "bins binary, y binary, row_keys binary, weeks binary, scores binary"


def fit_boosting(samples: DataFrame, plan: DataFrame, cfg: Boosting = Boosting(), label: str = "next_week_return") -> tuple[DataFrame, DataFrame, list[np.ndarray]]:
    """``(MODEL, HISTORY, cut points)``: the trees of every window, the held-out loss after every round, the bins.

    A window within ``WHOLE`` rows is one group and grows in one task, all such windows in one job. Larger windows grow
    together in the same jobs, one job per level of their trees, and never meet in a task. The last ``held_out_weeks`` training weeks are
    not trained on; a window stops after ``patience`` rounds without a lower squared loss on them, at the latest after
    ``rounds``. Round 0 is the mean label. Predictions are written every ``SNAPSHOT`` rounds; what was added since is
    recomputed from the trees, so a lost executor costs no more than that. Rows without a label are left out; windows
    without training rows get none.
    """
    spark = samples.sparkSession
    borders = plan.where("role = 'train'").groupBy("window_id").agg(F.min("week_ord").alias("a"), F.max("week_ord").alias("b")).orderBy("window_id").collect()
    spans = [Span(r["window_id"], r["a"], r["b"] + 1 - cfg.held_out_weeks, r["b"]) for r in borders]
    weeks = plan.where("role = 'train'").select("week_ord", F.col("date").alias("sample_date")).distinct()
    rows = samples.where(F.col(label).isNotNull()).join(F.broadcast(weeks), "sample_date")  # one row per week
    per_week = {r["week_ord"]: (r["n"], r["s"]) for r in rows.groupBy("week_ord").agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("s")).collect()}
    base = []
    for s in spans:
        own = [per_week[w] for w in range(s.first, s.valid) if w in per_week]
        base.append(sum(t for _, t in own) / sum(n for n, _ in own) if own else None)
    spans, base = [s for s, b in zip(spans, base) if b is not None], [b for b in base if b is not None]
    if not spans:
        return spark.createDataFrame([], MODEL), spark.createDataFrame([], HISTORY), []
    cuts = cut_points(rows, cfg.bins)
    width, n_windows = len(cuts), len(spans)

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                own = batch.iloc[at: at + BLOCK]
                x = binned(np.stack(own["features"].to_numpy()), cuts)
                yield pd.DataFrame({"bins": [x.tobytes()], "y": [own[label].to_numpy(float).tobytes()], "row_keys": [own["k"].to_numpy(np.int64).tobytes()],
                                    "weeks": [own["week_ord"].to_numpy(np.int64).tobytes()], "scores": [np.tile(base, (len(own), 1)).tobytes()]})

    keyed = rows.select("features", label, "week_ord", F.xxhash64("sample_date", "entity").alias("k"))
    recent: list[list[Tree]] = [[] for _ in spans]
    trees: list[list[Tree]] = [[] for _ in spans]
    losses: list[list[float]] = [[] for _ in spans]
    whole = [w for w, s in enumerate(spans) if sum(per_week[k][0] for k in range(s.first, s.last + 1) if k in per_week) <= WHOLE]
    running = set(range(n_windows)) - set(whole)

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = binned(np.stack(batch["features"].to_numpy()), cuts)
                yield pd.DataFrame({"week_ord": batch["week_ord"], "k": batch["k"], "y": batch[label].astype(float), "bins": [r.tobytes() for r in x]})

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["week_ord", "k"])
        w = int(group["w"].iloc[0])
        bins = np.frombuffer(b"".join(group["bins"]), np.uint8).reshape(len(group), width)
        own, grown = grow_window(bins, group["y"].to_numpy(float), group["k"].to_numpy(np.int64).view(np.uint64),
                                 spans[w].roles(group["week_ord"].to_numpy(np.int64)), base[w], spans[w].window, cfg)
        return pd.DataFrame({"w": w, "round": np.arange(len(own)), "loss": own, "tree": [t.coded() for t in grown] + [None]})

    if whole:
        served = spark.createDataFrame([(w, k) for w in whole for k in range(spans[w].first, spans[w].last + 1)], "w long, week_ord long")
        gathered = keyed.mapInPandas(coded, "week_ord long, k long, y double, bins binary").join(F.broadcast(served), "week_ord")
        for r in sorted(gathered.repartition(len(whole), "w").groupBy("w").applyInPandas(grow, "w long, round long, loss double, tree string").collect(),
                        key=lambda r: (r["w"], r["round"])):
            losses[r["w"]].append(r["loss"])
            if r["tree"] is not None:
                trees[r["w"]].append(Tree.decoded(r["tree"]))
    if running:
        blocks = cut_lineage(keyed.mapInPandas(packed, BLOCKS)).persist(StorageLevel.MEMORY_AND_DISK)

    def sums(growing: dict[int, Growth], wanted: dict[int, list[int]], features: dict[int, np.ndarray], round_: int, with_loss: bool) -> list:
        """Best splits ``(window, node, gain, ...)`` of the wanted nodes and, as node -1, the held-out losses."""
        placed = {w: g.partial() for w, g in growing.items()}

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for row in batch.itertuples():
                    block = _Block(row, width, n_windows)
                    block.add(recent)
                    for w, nodes in wanted.items():
                        roles = spans[w].roles(block.weeks)
                        if with_loss:
                            off = (block.scores[:, w] - block.y)[roles == VALID]
                            total[w, -1] = total.get((w, -1), 0.0) + np.array([off @ off, len(off)])
                        use = (roles == TRAIN) & sampled_rows(block.keys, cfg, spans[w].window, round_)
                        at = placed[w].nodes(block.bins)
                        for node in nodes:
                            mine = np.flatnonzero(use & (at == node))
                            hist = histogram(block.bins[np.ix_(mine, features[w])].astype(np.int64), block.scores[mine, w] - block.y[mine], cfg.bins)
                            total[w, node] = total.get((w, node), 0.0) + hist
                    if len(total) > HELD:
                        yield frame(total)
                        total.clear()
            if total:
                yield frame(total)

        def frame(total: dict[tuple[int, int], np.ndarray]) -> pd.DataFrame:
            return pd.DataFrame([(*k, v) for k, v in total.items()], columns=["w", "node", "v"])

        def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = [(w, node, v[0], 0, 0, 0.0, v[1]) if node < 0 else (w, node, *best_split(np.asarray(v).reshape(-1, cfg.bins, 2), features[w], cfg))
                       for w, node, v in zip(batch["w"], batch["node"], batch["v"])]
                yield pd.DataFrame(out, columns=["w", "node", "gain", "feature", "cut", "g", "n"])

        parts = blocks.mapInPandas(work, "w long, node long, v array<double>").select("w", "node", array_to_vector("v").alias("v"))
        added = parts.groupBy("w", "node").agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("v"))
        return added.mapInPandas(pick, "w long, node long, gain double, feature long, cut long, g double, n double").collect()

    round_ = 0
    while running:
        growing = {w: Growth() for w in running}
        features = {w: sampled_features(width, cfg, spans[w].window, round_) for w in running}
        wanted: dict[int, list[int]] = {w: [0] for w in running}
        first = True
        while wanted:
            for r in sums(growing, wanted, features, round_, first):
                if r["node"] < 0:
                    losses[r["w"]].append(r["gain"] / r["n"] if r["n"] else 0.0)
                else:
                    growing[r["w"]].known[r["node"]] = (r["gain"], r["feature"], r["cut"], r["g"], r["n"])
            if first:
                # The losses are those before this round's tree.
                for w in sorted(running):
                    if ended(losses[w], round_, cfg) or 0 not in growing[w].known:
                        running.discard(w)
                        del growing[w]
            first, wanted = False, {}
            for w, g in growing.items():
                _, _, unknown = g.replay(cfg.leaves)
                for node in unknown:
                    g.children[node] = (g.count, g.count + 1)
                    g.count += 2
                if unknown:
                    wanted[w] = [c for node in unknown for c in g.children[node]]
        for w, g in growing.items():
            tree = g.finished(cfg)
            trees[w].append(tree)
            recent[w].append(tree)
        round_ += 1
        if round_ % SNAPSHOT == 0 and running:
            added = recent

            def applied(batches: Iterator[pd.DataFrame], added=added) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    out = []
                    for row in batch.itertuples():
                        block = _Block(row, width, n_windows)
                        block.add(added)
                        out.append(block.scores.tobytes())
                    yield batch.assign(scores=out)

            older = blocks
            blocks = cut_lineage(blocks.mapInPandas(applied, BLOCKS)).persist(StorageLevel.MEMORY_AND_DISK)
            older.unpersist()
            recent = [[] for _ in spans]
    if len(whole) < n_windows:
        blocks.unpersist()
    best = [int(np.argmin(x)) for x in losses]
    model = [(s.window, 0, Tree({}, {0: b}).coded()) for s, b in zip(spans, base)]
    model += [(s.window, i + 1, t.coded()) for s, own, last in zip(spans, trees, best) for i, t in enumerate(own[:last])]
    history = [(s.window, i, x, i == last) for s, own, last in zip(spans, losses, best) for i, x in enumerate(own)]
    return spark.createDataFrame(model, MODEL), spark.createDataFrame(history, HISTORY), cuts


def score_boosting(samples: DataFrame, plan: DataFrame, model: DataFrame, cuts: Sequence[np.ndarray], roles: Sequence[str],
                   keep: Sequence[str] = (), staged: bool = False) -> DataFrame:
    """``window_id, role, date, entity, score`` (and ``keep``): the samples that the windows' models serve.

    ``staged`` gives the score after every round, with its ``round``, from one pass over the rows. The models are a few
    thousand small trees a window and go out with the tasks.
    """
    held: dict[int, list[Tree]] = {}
    for r in model.orderBy("window_id", "round").collect():
        held.setdefault(r["window_id"], []).append(Tree.decoded(r["tree"]))
    weeks = plan.where(F.col("role").isin(*roles) & F.col("window_id").isin(*held)).select("window_id", "role", F.col("date").alias("sample_date"))
    routed = samples.join(F.broadcast(weeks), "sample_date").select("window_id", "role", F.col("sample_date").alias("date"), "entity", *keep, "features")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for w, own in batch.groupby("window_id"):
                x = binned(np.stack(own["features"].to_numpy()), cuts)
                bare, score = own.drop(columns="features"), np.zeros(len(own))
                for i, tree in enumerate(held[w]):
                    score = score + tree.predict(x)
                    if staged:
                        yield bare.assign(score=score, round=i)
                if not staged:
                    yield bare.assign(score=score)

    extra = [StructField("score", DoubleType())] + [StructField("round", LongType())] * staged
    return routed.mapInPandas(work, StructType([f for f in routed.schema if f.name != "features"] + extra))
