"""Equivalence: range-partitioned global ranking == single-task window, on keys
with ties and NULLs, for N below, at and above the tile count; exact
percentiles against DuckDB's quantile_cont."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from carepulse.operators.quantiles import exact_percentiles
from carepulse.operators.ranking import Key, ntile_of, placed, rank_all, rank_by_counts, rank_many


def _frame(spark, n, seed, null_every=11, distinct=13):
    rnd = random.Random(seed)
    rows = [(i, None if i % null_every == 0 else rnd.randrange(distinct),
             rnd.choice(["a", "b", "c", None])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, k int, s string")


def _windowed(df):
    """The plain single-task windows."""
    by = [F.col("k").desc(), F.col("s")]
    w, full = Window.orderBy(*by), Window.orderBy(*by, "id")
    return _sorted(df.withColumns({
        "rk": F.rank().over(w), "drk": F.dense_rank().over(w), "rn": F.row_number().over(full),
        "q4": F.ntile(4).over(full), "q3": F.ntile(3).over(full), "pr": F.percent_rank().over(w)}))


def _ranked(df):
    return _sorted(rank_all(df, [Key("k", True), ("s", False)], ["id"], rank="rk", dense_rank="drk",
                            row_number="rn", ntile=[(4, "q4"), (3, "q3")], percent_rank="pr"))


def _sorted(out):
    return out.select("id", "rk", "drk", "rn", "q4", "q3", F.round("pr", 12).alias("pr")) \
              .toPandas().sort_values("id").reset_index(drop=True)


@pytest.mark.parametrize("n", [1, 3, 7, 57, 400])
def test_distributed_rank_equals_window(spark, n):
    df = _frame(spark, n, seed=n)
    a, b = _windowed(df), _ranked(df)
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_hot_key_rank_by_counts(spark):
    # one key holds a third of the rows; RANK comes from per-key counts
    rows = [(i, 7 if i % 3 == 0 else i % 50) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, k int")
    got = rank_by_counts(df, [("k", True)], rank="rk").toPandas().sort_values("id")
    con = duckdb.connect()
    pdf = pd.DataFrame(rows, columns=["id", "k"])
    exp = con.execute("SELECT id, RANK() OVER (ORDER BY k DESC) AS rk FROM pdf ORDER BY id").df()
    assert got["rk"].tolist() == exp["rk"].tolist()


def test_ntile_formula_matches_sql(spark):
    for n in (1, 2, 3, 4, 5, 9, 10, 11, 101):
        df = spark.range(1, n + 1).withColumnRenamed("id", "rn")
        got = [r[0] for r in df.select(ntile_of(F.col("rn"), n, 4)).collect()]
        exp = duckdb.sql(f"SELECT NTILE(4) OVER (ORDER BY i) FROM range(1, {n + 1}) t(i) "
                         "ORDER BY i").fetchall()
        assert got == [e[0] for e in exp], n


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_rank_only_specs(spark, n):
    df = spark.createDataFrame([(i, i % 2) for i in range(n)], "id long, k int")
    got = rank_all(df, ["k"], rank="rk", percent_rank="pr", dense_rank="dr").toPandas().sort_values("id")
    w = Window.orderBy("k")
    exp = df.withColumns({"rk": F.rank().over(w), "pr": F.percent_rank().over(w),
                          "dr": F.dense_rank().over(w)}).toPandas().sort_values("id")
    assert got[["rk", "dr", "pr"]].values.tolist() == exp[["rk", "dr", "pr"]].values.tolist()


@pytest.mark.parametrize("spread", [1000, 1e12, 1e-9])
def test_exact_percentiles(spark, spread):
    rnd = random.Random(5)
    vals = [rnd.uniform(0, spread) if spread != 1000 else round(rnd.uniform(0, spread), 2)
            for _ in range(997)] + [spread * 1e6, None, None]
    pdf = pd.DataFrame({"v": vals})
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = exact_percentiles(df, "v", {"p50": 0.5, "p25": 0.25, "p90": 0.9, "p0": 0.0,
                                      "p100": 1.0}).first().asDict()
    exp = duckdb.sql("SELECT quantile_cont(v, 0.5) p50, quantile_cont(v, 0.25) p25, "
                     "quantile_cont(v, 0.9) p90, min(v) p0, max(v) p100 FROM pdf").df()
    for k, v in got.items():
        assert v == pytest.approx(exp[k][0], rel=1e-12, abs=1e-15), k


def test_percentiles_empty_input(spark):
    df = spark.createDataFrame([(None,)], "v double")
    got = exact_percentiles(df, "v", {"p50": 0.5}).first()
    assert got["p50"] is None


def test_percentiles_of_decimals_that_doubles_merge(spark):
    vals = ["9007199254740992.01", "9007199254740992.02", "9007199254740992.03"] * 3
    df = spark.createDataFrame([(v,) for v in vals], "s string").selectExpr("CAST(s AS DECIMAL(20,2)) AS v")
    got = exact_percentiles(df, "v", {"p50": 0.5}, summary=True).first()
    assert got["p50"] == 9007199254740992.02 and got["_n"] == 9


@pytest.mark.parametrize("n", [0, 1, 3, 7, 57, 400])
def test_several_orders_at_once_equal_windows(spark, n):
    """Orders of several types, directions and NULL places over one input, with
    rows that carry other columns, by one range shuffle."""
    rnd = random.Random(n)
    rows = [(i, rnd.choice([None, 1.5, 2.5, -1.0]), rnd.choice([None, "a", "b"]), rnd.randrange(5),
             rnd.choice([None, "x"])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, k double, s string, c int, other string") \
        .selectExpr("id", "k", "s", "CAST(c AS DECIMAL(28,2)) AS c", "other")
    got = rank_many(df, [
        dict(by=[Key("k", True)], tie=["id"], ntile=(4, "q"), rank="rk"),
        dict(by=["s", Key("c", True)], tie=["id"], row_number="rn", dense_rank="dr"),
        dict(by=[Key("c", False, False)], tie=["id"], ntile=[(3, "t"), (2, "h")], percent_rank="pr"),
        dict(with_={"sum": F.col("q") + F.col("t")}, by=[("sum", True)], rank="few", few=True),
        dict(by=["h"], rank="last")])
    a, b, c = [F.col("k").desc()], [F.col("s"), F.col("c").desc()], [F.col("c").asc_nulls_last()]
    exp = df.withColumns({
        "q": F.ntile(4).over(Window.orderBy(*a, "id")), "rk": F.rank().over(Window.orderBy(*a)),
        "rn": F.row_number().over(Window.orderBy(*b, "id")), "dr": F.dense_rank().over(Window.orderBy(*b)),
        "t": F.ntile(3).over(Window.orderBy(*c, "id")), "h": F.ntile(2).over(Window.orderBy(*c, "id")),
        "pr": F.percent_rank().over(Window.orderBy(*c))}).withColumn("sum", F.col("q") + F.col("t"))
    exp = exp.withColumns({"few": F.rank().over(Window.orderBy(F.col("sum").desc())),
                           "last": F.rank().over(Window.orderBy("h"))})
    assert sorted(got.columns) == sorted(exp.columns)
    assert sorted(got.select(exp.columns).collect(), key=lambda r: r["id"]) == sorted(exp.collect(), key=lambda r: r["id"])


def test_orders_together_need_one_tie_key(spark):
    df = spark.range(3).selectExpr("id", "id AS other")
    with pytest.raises(ValueError):
        rank_many(df, [dict(by=["id"], tie=["id"], ntile=(2, "a")), dict(by=["id"], tie=["other"], ntile=(2, "b"))])


def test_placed_within_groups(spark):
    rows = [(i, "abc"[min(2, i * i % 7 % 3)], (i * 37) % 11) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g string, v int")
    got = placed(df, "g", [F.col("v").desc(), F.col("id").asc()])
    w = Window.partitionBy("g").orderBy(F.col("v").desc(), "id")
    bad = got.withColumns({"x": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy("g"))}) \
        .where("x <> _rn or n <> _all")
    assert got.count() == 500 and bad.count() == 0


def test_percentiles_of_hot_values_and_gaps(spark):
    """A third of the rows hold one value; ranks beside it and in it are exact."""
    vals = [5.0] * 1000 + [float(i) for i in range(1500)] + [1e300, -1e300, 0.1 + 0.2]
    df = spark.createDataFrame([(v,) for v in vals], "v double").repartition(7)
    ps = {f"p{i}": i / 40 for i in range(41)}
    got = exact_percentiles(df, "v", ps).first().asDict()
    pdf = pd.DataFrame({"v": vals})                                                      # noqa: F841
    for k, p in ps.items():
        exp = duckdb.sql(f"SELECT quantile_cont(v, {p}) FROM pdf").fetchall()[0][0]
        assert got[k] == pytest.approx(exp, rel=1e-12), k


def test_a_rank_outside_its_bracket_is_found(spark):
    from carepulse.operators.quantiles import select_ranks
    df = spark.range(1000).selectExpr("CAST(id AS DECIMAL(18,2)) AS v")
    row = select_ranks(df, [0, 500, 999], [(10, 12), (600, 601)]).first()
    assert [int(row[f"at{r}"]) for r in (0, 500, 999)] == [0, 500, 999]
