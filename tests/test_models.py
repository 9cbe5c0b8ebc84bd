"""Walk-forward ridge from moments and boosted trees from histograms, against plain versions."""

import datetime as dt

import numpy as np
import pytest

from tapeloom.models import boosting as B
from tapeloom.models import moments as M
from tapeloom.models import walkforward as J

WEEKS, START = 40, dt.date(2020, 1, 3)


def day(week):
    return START + dt.timedelta(days=7 * week)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    out = []
    for week in range(WEEKS):
        for e in range(30):
            x = rng.normal([2.0, 100.0, 0.0, 5.0], [1.0, 5.0, 0.1, 0.0], 4)
            y = None if week == 7 and e < 5 else float(0.3 * x[0] - 0.1 * (x[1] > 101) + 4 * x[2] * (x[0] > 2) + rng.normal(0, 0.3))
            out.append((week, f"e{e}", x.tolist(), y))
    return out


@pytest.fixture(scope="module")
def samples(spark, rows):
    return spark.createDataFrame([(day(w), e, x, y) for w, e, x, y in rows], "sample_date date, entity string, features array<double>, next_week_return double").repartition(3)


@pytest.fixture(scope="module")
def plan(spark):
    out = []
    for window, at in enumerate((20, 26, 33)):
        out += [(window, w, "train" if w < at else "val" if w < at + 3 else "predict", day(w)) for w in range(at - 20, min(at + 7, WEEKS))]
    return spark.createDataFrame(out, "window_id long, week_ord long, role string, date date")


def test_ridges_of_overlapping_windows_equal_the_closed_form(samples, plan, rows, monkeypatch):
    monkeypatch.setattr(M, "STRIP", 2)
    monkeypatch.setattr(M, "HELD", 1)
    models = M.fit_ridges(samples, plan, (1.0, 30.0))
    got = {(r["window_id"], r["alpha"]): r for r in models.collect()}
    scored = {(r["window_id"], r["alpha"], r["date"], r["entity"]): r["score"] for r in M.score(samples, plan, models, ("val", "predict")).collect()}
    assert len(got) == 6
    for window, at in enumerate((20, 26, 33)):
        own = [r for r in rows if at - 20 <= r[0] < at and r[3] is not None]
        x, y = np.array([r[2] for r in own]), np.array([r[3] for r in own])
        spread = x.std(axis=0)
        z = x / np.where(spread > 1e-9, spread, 1.0)
        zc, yc = z - z.mean(axis=0), y - y.mean()
        for alpha in (1.0, 30.0):
            beta = np.linalg.solve(zc.T @ zc + alpha * np.eye(4), zc.T @ yc)
            model = got[window, alpha]
            assert model["n"] == len(own)
            for w, e, f, _ in rows:
                if at <= w < min(at + 7, WEEKS):
                    want = y.mean() + (np.array(f) / np.where(spread > 1e-9, spread, 1.0) - z.mean(axis=0)) @ beta
                    assert abs(scored[window, alpha, day(w), e] - want) < 1e-8
    assert M.fit_ridges(samples.limit(0), plan).count() == 0 and M.fit_ridges(samples, plan.limit(0)).count() == 0


def plain_boosting(x, y, keys, roles, cfg, window):
    """One window, one split at a time, the leaf with the greatest gain first."""
    score = np.full(len(y), y[roles == B.TRAIN].mean())
    losses, trees = [], []
    while True:
        off = (score - y)[roles == B.VALID]
        losses.append(float(off @ off) / len(off))
        best = int(np.argmin(losses))
        round_ = len(trees)
        if round_ >= cfg.rounds or round_ - best >= cfg.patience:
            return losses, trees[:best]
        use = (roles == B.TRAIN) & B.sampled_rows(keys, cfg, window, round_)
        columns = B.sampled_features(x.shape[1], cfg, window, round_)
        g = score - y

        def split(mine):
            best = (0.0, 0, 0)
            for f in columns:
                for cut in range(cfg.bins - 1):
                    left = mine & (x[:, f] <= cut)
                    n, m = left.sum(), mine.sum()
                    if n >= cfg.min_rows and m - n >= cfg.min_rows:
                        a, b = g[left].sum(), g[mine].sum()
                        gain = a * a / (n + cfg.l2) + (b - a) ** 2 / (m - n + cfg.l2) - b * b / (m + cfg.l2)
                        if gain > best[0] + 1e-9:
                            best = (gain, f, cut)
            return best

        leaves = [(use, np.ones(len(y), bool))]
        found = [split(use)]
        while len(leaves) < cfg.leaves and max(f[0] for f in found) > 1e-12:
            i = max(range(len(found)), key=lambda i: found[i][0])
            (mine, every), (_, f, cut) = leaves.pop(i), found.pop(i)
            for side in (x[:, f] <= cut, x[:, f] > cut):
                leaves.append((mine & side, every & side))
                found.append(split(mine & side))
        step = np.zeros(len(y))
        for mine, every in leaves:
            step[every] = -cfg.step * g[mine].sum() / (mine.sum() + cfg.l2)
        trees.append(step)
        score = score + step


@pytest.mark.parametrize("share", [1.0, 0.7])
def test_boosting_equals_a_plain_booster(spark, samples, plan, rows, share, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(B, "SNAPSHOT", 3)
    cfg = B.Boosting(rounds=60, patience=4, held_out_weeks=4, step=0.4, leaves=5, min_rows=15, bins=8, row_share=share, feature_share=share)
    model, history, cuts = B.fit_boosting(samples, plan, cfg)
    keys = {(r["sample_date"], r["entity"]): r["k"] for r in samples.select("sample_date", "entity", F.xxhash64("sample_date", "entity").alias("k")).collect()}
    scored = {(r["window_id"], r["date"], r["entity"]): r["score"] for r in B.score_boosting(samples, plan, model, cuts, ("train", "predict")).collect()}
    kept = {}
    for r in history.collect():
        kept.setdefault(r["window_id"], []).append((r["round"], r["valid_loss"], r["is_best"]))
    for window, at in enumerate((20, 26, 33)):
        own = [r for r in rows if at - 20 <= r[0] < at and r[3] is not None]
        x = B.binned(np.array([r[2] for r in own]), cuts)
        roles = np.array([B.VALID if r[0] >= at - 4 else B.TRAIN for r in own])
        losses, trees = plain_boosting(x, np.array([r[3] for r in own]), np.array([keys[day(r[0]), r[1]] for r in own], np.int64).view(np.uint64), roles, cfg, window)
        got = sorted(kept[window])
        # The stop acts: the last rounds brought no gain, and they are not part of the model.
        assert len(got) == len(losses) < 60 and np.allclose([v for _, v, _ in got], losses, rtol=1e-9)
        assert [r for r, _, best in got if best] == [len(trees)] and len(losses) - 1 - len(trees) == cfg.patience
        base = np.mean([r[3] for r, role in zip(own, roles) if role == B.TRAIN])
        for i in range(0, len(own), 37):
            assert abs(scored[window, day(own[i][0]), own[i][1]] - base - sum(t[i] for t in trees)) < 1e-9
    stages = B.score_boosting(samples, plan, model, cuts, ("val",), ["next_week_return"], staged=True).withColumnRenamed("next_week_return", "ret")
    table = {r["window_id"]: r for r in J.staged_registry(stages).collect()}
    assert set(table) == {0, 1, 2} and all(0 <= r["best_epoch"] <= r["epoch_count"] for r in table.values())
    rounds = J.registry(stages, by=["window_id", "round"]).toPandas()
    for window, group in rounds.groupby("window_id"):
        assert table[window]["val_score"] == group["val_score"].max() and table[window]["epoch_count"] == group["round"].max()


def test_windows_grown_whole_equal_those_grown_from_sums(spark, samples, plan, monkeypatch):
    cfg = B.Boosting(rounds=12, patience=4, held_out_weeks=4, step=0.4, leaves=5, min_rows=15, bins=8)
    # Every job counts: small windows must not start one per level of every tree.
    found = {}
    for whole in (0, 16_384):
        monkeypatch.setattr(B, "WHOLE", whole)
        group = f"boosting-{whole}"
        spark.sparkContext.setJobGroup(group, group)
        model, history, _ = B.fit_boosting(samples, plan, cfg)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        trees = [(r["window_id"], r["round"], B.Tree.decoded(r["tree"])) for r in model.orderBy("window_id", "round").collect()]
        found[whole] = trees, [tuple(r) for r in history.orderBy("window_id", "round").collect()], jobs
    spark.sparkContext._jsc.clearJobGroup()
    (a, old, many), (b, new, few) = found[0], found[16_384]
    assert 2 * few < many and len(a) == len(b) > 6
    for (w, i, t), (v, j, u) in zip(a, b):
        assert (w, i, t.splits) == (v, j, u.splits) and np.allclose(list(t.values.values()), list(u.values.values()), atol=1e-9)
    assert [(w, i, x) for w, i, _, x in old] == [(w, i, x) for w, i, _, x in new] and np.allclose([x[2] for x in old], [x[2] for x in new])


def test_model_store_is_read_as_of_a_day(spark, samples, plan, tmp_path):
    path = str(tmp_path / "models")
    J.save_models(M.fit_ridges(samples, plan), plan, path)
    for asked, window in (("2019-01-01", 0), (day(19), 0), (day(24), 0), (day(25), 1), (day(39), 2)):
        assert [r["window_id"] for r in J.model_as_of(spark, path, asked).collect()] == [window]


def test_timing_of_two_series_equals_plain_newton(spark):
    from tapeloom.operators import timing as T

    rng = np.random.default_rng(8)
    rows = []
    for series in ("a", "b", "flat"):
        for i in range(95):
            x = rng.normal(size=2)
            y = 1 if series == "flat" else int(x[0] + rng.normal() > 0)
            rows.append((series, dt.date(2020, 1, 1) + dt.timedelta(days=i), y, float(x[0]), float(x[1]), 3.0))
    df = spark.createDataFrame(rows, "series string, date date, y int, u double, v double, c double").repartition(4)
    got = {(r["series"], r["date"]): r for r in T.rolling_signals(df, ["u", "v", "c"], 60, 15, ["series"]).collect()}
    assert len(got) == 3 * 35
    for series in ("a", "b", "flat"):
        own = [r for r in rows if r[0] == series]
        x, y = np.array([r[3:] for r in own]), np.array([r[2] for r in own], float)
        for at in range(60, 95, 15):
            past = x[at - 60: at]
            s = past.std(axis=0)
            z = np.where(s > 0, (x - past.mean(axis=0)) / np.where(s > 0, s, 1), 0.0)
            z = np.column_stack([np.ones(len(z)), z])
            w = np.zeros(4)
            for _ in range(60):
                p = 1 / (1 + np.exp(-z[at - 60: at] @ w))
                ridge = np.diag([0.0, 1, 1, 1])
                w = w + np.linalg.lstsq((z[at - 60: at].T * (p * (1 - p))) @ z[at - 60: at] + ridge, z[at - 60: at].T @ (y[at - 60: at] - p) - ridge @ w, rcond=None)[0]
            for i in range(at, min(at + 15, 95)):
                want = y[i] if series == "flat" else 1 / (1 + np.exp(-z[i] @ w))
                assert abs(got[series, own[i][1]]["p"] - want) < 1e-7 and got[series, own[i][1]]["signal"] == int(want > 0.5)
