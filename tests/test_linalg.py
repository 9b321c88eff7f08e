"""Sums of normal equations."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from seriesloom.functions.linalg import gram, square, sum_arrays


def test_gram_equals_numpy_with_one_array_per_series_and_task(spark):
    rng = np.random.default_rng(2)
    n = 6000
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", None, "d"], n, p=[0.7, 0.1, 0.1, 0.1]), "k": rng.integers(0, 300, n), "x": rng.normal(size=n), "y": rng.normal(size=n)})
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "17")  # series run over many batches
    try:
        df = spark.createDataFrame(pdf).repartition(5)
        got = {(r["g"], r["k"]): (square(r["gram"]), r["n"]) for r in gram(df, ["g", "k"], ["x", "y"]).collect()}
        whole = gram(df, [], ["x", "y"]).first()
    finally:
        spark.conf.set(key, before)
    want = pdf.groupby(["g", "k"], dropna=False)
    assert len(got) == want.ngroups
    for (g, k), part in want:
        z = part[["x", "y"]].to_numpy()
        m, rows = got[(None if pd.isna(g) else g, k)]
        assert rows == len(part)
        np.testing.assert_allclose(m, z.T @ z, atol=1e-9)
    z = pdf[["x", "y"]].to_numpy()
    np.testing.assert_allclose(square(whole["gram"]), z.T @ z)
    assert whole["n"] == n
    assert gram(df.limit(0), ["g"], ["x"]).count() == 0 and gram(df.limit(0), [], ["x"]).count() == 0


def test_partial_sums_are_one_per_series_and_task(spark):
    df = spark.range(20000).select((F.col("id") % 500).alias("s"), F.lit(1.0).alias("x")).repartition(4)
    plan = gram(df, ["s"], ["x"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("MapInPandas") == 2
    parts = df.sortWithinPartitions("s").withColumn("p", F.spark_partition_id()).select("s", "p").distinct().count()
    summed = sum_arrays(df.groupBy("s", F.spark_partition_id().alias("p")).agg(F.array(F.sum("x")).alias("a"), F.count("x").alias("n")), ["s"], ["a"], ["n"])
    assert parts <= 2000 and {(r["a"][0], r["n"]) for r in summed.collect()} == {(40.0, 40)}
