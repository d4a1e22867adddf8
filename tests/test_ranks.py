from pyspark.sql import functions as F

from flowlens.operators import ranks as R


def test_quantiles_between_equal_values_are_that_value(spark):
    values = [7 / 12, 1 / 3, 0.1, 13 / 22, 47 / 81]
    rows = spark.createDataFrame([(f"{i}-{n}", v) for i, v in enumerate(values) for n in range(11, 40) for _ in range(n)], "k string, v double")
    got = R.exact_quantiles(R.value_counts(rows, ["k"], "v"), ["k"], {"q05": 0.05, "median": 0.5, "q95": 0.95})
    wrong = [r for r in got.collect() if {r["q05"], r["median"], r["q95"]} != {values[int(r["k"].split("-")[0])]}]
    assert not wrong
    assert rows.join(got, "k").where(F.col("v") > F.col("q95")).count() == 0


def test_infinite_values(spark):
    rows = spark.createDataFrame([(v,) for v in [1.0, 2.0, float("inf"), float("inf"), float("inf")]], "v double")
    r = R.exact_quantiles(R.value_counts(rows, [], "v"), [], {"q20": 0.2, "q25": 0.25, "q95": 0.95}).first()
    assert (r["q20"], r["q25"], r["q95"]) == (1.8, 2.0, float("inf"))
