"""The correlation matrix makes its rows once and deals them by row before it sums."""

import numpy as np
from pyspark.sql import functions as F

from riskloom.operators.profile import correlation_matrix


def test_rows_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(i):
        made.add(1)
        return None if i % 5 == 0 else float(i * 7 % 11)
    df = spark.range(40, numPartitions=2).select(
        counted(F.col("id")).alias("a"), (F.col("id") % 6).cast("double").alias("b"))
    got = {(r.col_a, r.col_b): r["corr"] for r in correlation_matrix(df, ["a", "b"]).collect()}
    rows = [(i * 7 % 11, i % 6) for i in range(40) if i % 5]

    def rank(v):
        return [sum(x < y for x in v) + (sum(x == y for x in v) + 1) / 2 for y in v]
    want = np.corrcoef(*(rank(c) for c in zip(*rows)))[0, 1]
    assert np.isclose(got["a", "b"], want) and np.isclose(got["b", "a"], want)
    assert made.value == 40
