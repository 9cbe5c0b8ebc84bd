"""The feature store against brute force."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import store as S
from tapeloom.operators.calendar import week_ends

COLUMNS = ["a", "b", "c"]
SCHEMA = "sample_date date, entity string, " + ", ".join(f"{c} array<double>" for c in COLUMNS)


@pytest.fixture(scope="module")
def packed(spark):
    rng = np.random.default_rng(1)
    rows = []
    for day, n in ((dt.date(2020, 1, 3), 500), (dt.date(2020, 1, 10), 7), (dt.date(2020, 1, 17), 331), (dt.date(2020, 1, 24), 1)):
        for i in range(n):
            cells = [np.round(rng.standard_cauchy(4) * 10.0 ** rng.integers(-3, 6), rng.integers(0, 4)), rng.choice([0.0, -0.0, 1.5, -2.0], 4), rng.normal(size=4)]
            cells[2][rng.integers(4)] = [np.nan, np.inf, 7.0][i % 3]
            rows.append((day, f"e{i}", *[[None if x != x else float(x) for x in c] for c in cells]))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def clipped(pdf):
    out = {}
    for day, group in pdf.groupby("sample_date"):
        for c in COLUMNS:
            x = np.stack([np.array(v, float) for v in group[c]])
            x = np.where(np.isfinite(x), x, 0.0)
            m = np.median(x, axis=0)
            r = 3 * (np.median(np.abs(x - m), axis=0) + 1e-6)
            for e, v in zip(group["entity"], np.clip(x, m - r, m + r)):
                out[day, e, c] = v
    return out


@pytest.mark.parametrize("part, gather", [(1024, 256), (100, 8), (40, 256), (100, 1)])
def test_clipping_does_not_depend_on_parts(packed, part, gather):
    want = clipped(packed.toPandas())
    got = S.clip_packed(packed, COLUMNS, part=part, gather=gather).toPandas()
    assert len(got) == packed.count()
    for row in got.itertuples():
        for c in COLUMNS:
            assert np.allclose(getattr(row, c), want[row.sample_date, row.entity, c], rtol=1e-13, atol=0)


def test_packed_windows_and_store(spark, tmp_path):
    rng = np.random.default_rng(2)
    days = pd.bdate_range("2020-01-01", "2020-03-31")
    rows = []
    for e in ("x", "y", "z"):
        own = days[rng.random(len(days)) < (0.5 if e == "y" else 0.95)]
        rows += [(e, d.date(), None if e == "z" else float(i), None if rng.random() < 0.3 or e == "z" else float(rng.normal()), None) for i, d in enumerate(own)]
    panel = spark.createDataFrame(rows, "entity string, date date, a double, b double, c double")
    calendar = spark.createDataFrame([(d.date(),) for d in days], "date date")
    weeks = week_ends(calendar)
    got = S.packed_windows(panel, weeks, COLUMNS, 5).toPandas()
    table = {e: sorted(r[1:] for r in rows if r[0] == e) for e in "xyz"}
    want = {}
    for end in [r["date"] for r in weeks.collect()]:
        for e, own in table.items():
            seen = [r for r in own if r[0] <= end][-5:]
            if len(seen) == 5 and any(v is not None for r in seen for v in r[1:]):
                want[end, e] = seen
    assert {(r.sample_date, r.entity) for r in got.itertuples()} == set(want) and len(got) == len(want) and not any(e == "z" for _, e in want)
    for r in got.itertuples():
        for i, c in enumerate(COLUMNS, 1):
            assert [None if x is None or x != x else x for x in getattr(r, c)] == [s[i] for s in want[r.sample_date, r.entity]]

    path = str(tmp_path / "store")
    packed = S.packed_windows(panel, weeks, COLUMNS, 5)
    S.write_store(packed, path)
    newest = max(d for d, _ in want)
    again = packed.where(F.col("sample_date") == F.lit(newest)).withColumn("a", F.transform("a", lambda x: x + 100))
    S.write_store(again, path)
    back = S.read_store(spark, path, ["a"]).toPandas()
    assert len(back) == len(want) and list(back.columns) == ["sample_date", "entity", "a"]
    for r in back.itertuples():
        assert list(r.a) == [s[1] + (100 if r.sample_date == newest else 0) for s in want[r.sample_date, r.entity]]
    assert S.read_store(spark, path, start=newest).count() == sum(d == newest for d, _ in want)


def test_summaries_digest_and_scaler(packed):
    pdf = packed.toPandas()
    long = S.summarised(S.clip_packed(packed.select(*S.KEYS, *[F.concat(c, c, c, c, c).alias(c) for c in COLUMNS]), COLUMNS), COLUMNS).toPandas()
    cells = clipped(pdf)
    for r in long.sample(30, random_state=1).itertuples():
        want = []
        for c in COLUMNS:
            v = np.clip(np.tile(cells[r.sample_date, r.entity, c], 5), -1e6, 1e6)
            want += [v[-1], v.mean(), v.std(), v[-1] - v[-2], v[-1] - v[-6], v[-1] - v[-11], v[-5:].mean(), v[-10:].mean(), v[-20:].mean()]
        assert np.allclose(r.features, want, rtol=1e-12, atol=1e-9)
    assert len(S.summary_names(COLUMNS)) == 27
    digest = S.store_digest(packed, ["b"]).toPandas().set_index("sample_date")
    for day, group in pdf.groupby("sample_date"):
        v = np.stack(group["b"].to_numpy())
        d = digest.loc[day]
        assert d["n_cells"] == v.size and np.isclose(d["total"], v.sum()) and np.isclose(d["weighted"], (v * np.arange(1, 5)).sum()) and d["high"] == v.max()
    scaler = S.packed_scaler(packed, ["b"]).first()
    v = np.concatenate([np.concatenate(x) for x in [pdf["b"].to_numpy()]])
    assert np.isclose(scaler["mean"], v.mean()) and np.isclose(scaler["std"], v.std() + 1e-6)
    short = S.truncate_packed(packed, ["a"], 2).first()
    assert len(short["a"]) == 2


def test_only_closed_windows_are_cut_out(spark):
    days = [dt.date(2020, 1, 6) + dt.timedelta(d) for d in range(60) if d % 7 < 5]
    rows = [(f"e{i}", d, None if (k + i) % 3 else float(k), float(k * i) if k > 6 else None) for i in range(40) for k, d in enumerate(days)]
    bars = spark.createDataFrame(rows, "entity string, date date, a double, b double")
    weeks = week_ends(bars.select("date").distinct().where("date < '2020-02-20'"))
    packed = S.packed_windows(bars, weeks, ["a", "b"], 4)
    # Lists of every bar's last rows took most of the factors' time; Spark must not form them for bars that close no week.
    assert "collect_list" not in packed._jdf.queryExecution().toString()
    want = {}
    for r in weeks.collect():
        for i in range(40):
            own = [x for x in rows if x[0] == f"e{i}" and x[1] <= r["date"]][-4:]
            if len(own) == 4 and any(x[2] is not None or x[3] is not None for x in own):
                want[r["date"], f"e{i}"] = [x[2] for x in own], [x[3] for x in own]
    assert {(r["sample_date"], r["entity"]): (r["a"], r["b"]) for r in packed.collect()} == want and len(want) > 200
    assert packed.where("false").isEmpty() and S.packed_windows(bars, weeks.where("false"), ["a", "b"], 4).isEmpty()


def test_bars_are_dealt_by_their_number_not_by_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(S, "DEALT", 100)
    bars = spark.range(800).select(F.concat(F.lit("e"), F.col("id") % 20).alias("entity"), F.col("id").alias("x"))
    dealt = S.by_entity(bars, 800).select("entity", F.spark_partition_id().alias("p")).distinct().toPandas()
    assert len(dealt) == 20 and dealt["p"].nunique() > 3
