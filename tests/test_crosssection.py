"""Group statistics: the plan for large groups must equal the plan for small ones and pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import crosssection as X
from tapeloom.operators.cleaning import mad_clip, winsorize
from tapeloom.operators.evaluation import rank_ic_ordinal
from tapeloom.operators.pairwise import pairwise_loss
from tapeloom.sources.upsert import dimension_ids, upsert, with_dimension


@pytest.fixture(scope="module")
def skewed():
    """One date holds most rows and one value a third of them."""
    rng = np.random.default_rng(5)
    value = np.round(rng.normal(0, 1, 600), 2)
    value[:200] = 0.25
    date = np.where(np.arange(600) < 500, "hot", "cold")
    return pd.DataFrame({"date": date, "entity": [f"e{i:03d}" for i in range(600)], "v": value, "u": rng.normal(0, 1, 600)})


@pytest.mark.parametrize("piece", [None, 150, 10])
def test_ranks(spark, skewed, piece):
    got = X.ranks(spark.createDataFrame(skewed), ["date"], "entity", {"v": "rv", "u": "ru"}, piece).toPandas()
    want = skewed.assign(wv=skewed.groupby("date")["v"].rank(), wu=skewed.groupby("date")["u"].rank())
    both = got.merge(want, on=["date", "entity"])
    assert len(both) == 600
    np.testing.assert_allclose(both["rv"], both["wv"])
    np.testing.assert_allclose(both["ru"], both["wu"])


@pytest.mark.parametrize("piece", [150, 10])
def test_positions_split_equals_whole(spark, skewed, piece):
    df = spark.createDataFrame(skewed)
    whole = X.positions_of(df, ["date"], "entity", {"v": "p"}).toPandas().sort_values("entity")
    split = X.positions_of(df, ["date"], "entity", {"v": "p"}, piece).toPandas().sort_values("entity")
    assert whole["p"].tolist() == split["p"].tolist()
    assert sorted(split[split["date"] == "hot"]["p"]) == list(range(1, 501))


@pytest.mark.parametrize("piece", [None, 40])
def test_pairs_and_ids_do_not_depend_on_the_pieces(spark, skewed, piece):
    df = spark.createDataFrame(skewed)
    got = X.with_next(df, ["date"], ["v", "entity"], ["u", "entity"], piece).toPandas()
    assert len(got) == 600 and got["u_2"].isna().sum() == 2
    for date, group in skewed.groupby("date"):
        order = group.sort_values(["v", "entity"])
        want = dict(zip(order["entity"], order["entity"].shift(-1)))
        assert {e: x for e, x in zip(got.loc[got["date"] == date, "entity"], got.loc[got["date"] == date, "entity_2"])} == {
            e: None if x != x else x for e, x in want.items()}
    names = X.text_positions(df.select("entity"), "entity", "id", piece).toPandas()
    assert dict(zip(names["entity"], names["id"])) == {e: i for i, e in enumerate(sorted(skewed["entity"]))}


@pytest.mark.parametrize("accuracy, bracket", [(2000, 0.002), (40, 0.06)])
def test_quantiles_and_medians(spark, skewed, monkeypatch, accuracy, bracket):
    monkeypatch.setattr(X, "ACCURACY", accuracy)
    monkeypatch.setattr(X, "BRACKET", bracket)
    df = spark.createDataFrame(skewed)
    got = X.with_quantiles(df, ["date"], "v", {"a": 0.1, "b": 0.5, "c": 0.93}).toPandas().set_index("date")
    want = skewed.groupby("date")["v"].quantile([0.1, 0.5, 0.93]).unstack()
    np.testing.assert_allclose(got.loc[want.index, ["a", "b", "c"]], want)
    med = X.medians(df, ["date"], ["v", "u"]).toPandas().set_index("date")
    np.testing.assert_allclose(med.loc[want.index], skewed.groupby("date")[["v", "u"]].median())


def test_best_n_prunes_before_the_shuffle(spark, skewed):
    out = X.best_n(spark.createDataFrame(skewed), ["date"], [F.col("v").desc(), F.col("entity")], 3)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    top = skewed.sort_values(["v", "entity"], ascending=[False, True]).groupby("date").head(3)
    assert set(out.toPandas()["entity"]) == set(top["entity"])


def test_mad_clip(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, 41)
    x[0] = 50.0
    pdf = pd.DataFrame({"sample_date": "d", "t_pos": 0, "entity": [str(i) for i in range(41)], "x": x})
    got = mad_clip(spark.createDataFrame(pdf), ["x"]).toPandas().set_index("entity").loc[pdf["entity"], "x"]
    mid = np.median(x)
    reach = 3 * (np.median(np.abs(x - mid)) + 1e-6)
    np.testing.assert_allclose(got, np.clip(x, mid - reach, mid + reach))


def test_winsorize_matches_pandas(spark, skewed):
    got = winsorize(spark.createDataFrame(skewed), "u", 0.05, ["date"]).toPandas().set_index("entity")["u"]
    want = skewed.groupby("date")["u"].transform(lambda s: s.clip(s.quantile(0.05), s.quantile(0.95)))
    np.testing.assert_allclose(got.loc[skewed["entity"]], want)


def test_ordinal_ic_of_equal_orders_is_one(spark, skewed):
    df = spark.createDataFrame(skewed).select("date", "entity", F.col("u").alias("score"), (F.col("u") * 2).alias("ret"))
    assert rank_ic_ordinal(df).toPandas()["rank_ic"].tolist() == pytest.approx([1.0, 1.0])


def test_pair_loss_covers_every_row_and_prefers_good_scores(spark, skewed):
    df = spark.createDataFrame(skewed).select("date", "entity", F.col("u").alias("ret"), (F.col("u") * 5).alias("score"))
    good = pairwise_loss(df).toPandas().set_index("date")
    bad = pairwise_loss(df.withColumn("score", -F.col("score"))).toPandas().set_index("date")
    assert good.loc["hot", "n_pairs"] == 4 * 499
    assert (good["loss"] < bad["loss"]).all()


def test_dimension_ids_drop_null_and_pad_unknown(spark):
    raw = spark.createDataFrame([(" a", "x "), ("b", "y"), ("b", "z"), ("c", None)], "entity string, name string")
    ids = dimension_ids(raw)
    assert {r.entity: r.id for r in ids.collect()} == {"a": 0, "b": 1}
    asked = spark.createDataFrame([("a",), ("q",)], "entity string")
    assert {r.entity: r.industry_id for r in with_dimension(asked, ids).collect()} == {"a": 0, "q": 2}


def test_upsert_is_idempotent_and_prefers_new(spark):
    old = spark.createDataFrame([("a", 1, 1.0, 9.0), ("b", 1, 2.0, 9.0)], "entity string, date int, x double, y double")
    new = spark.createDataFrame([("a", 1, 5.0), ("c", 1, 6.0), ("c", 1, 6.0)], "entity string, date int, x double")
    once = upsert(old, new)
    assert {(r.entity, r.x, r.y) for r in once.collect()} == {("a", 5.0, None), ("b", 2.0, 9.0), ("c", 6.0, None)}
    twice = upsert(once.select("entity", "date", "x"), new)
    assert sorted((r.entity, r.x) for r in twice.collect()) == [("a", 5.0), ("b", 2.0), ("c", 6.0)]
