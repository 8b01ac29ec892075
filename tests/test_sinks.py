import random

from pyspark.sql import functions as F

from contestry.sources.sinks import rounded


def test_rounding_is_that_of_spark(spark):
    draw = random.Random(5)
    values = [None, 0.0, -0.0, 0.5, -0.5, 1e-7, -1e-7, 5e-7, -5e-7, 2.0000005, 1.0000015, 0.1234565, -2.5e-6,
              999.9999995, 1e300, -1e12, 123456789.1234565, float("nan"), float("inf"), float("-inf")]
    values += [draw.uniform(-100, 100) for _ in range(2000)]
    values += [a / b - c / d for a, b, c, d in ([draw.randint(1, 60) for _ in range(4)] for _ in range(2000))]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    for digits in (6, 9):
        ours = {r.i: repr(r.x) for r in rounded(df, digits).collect()}
        theirs = {r.i: repr(r.x) for r in df.withColumn("x", F.round("x", digits)).collect()}
        assert ours == theirs


def test_rounding_goes_by_text_near_ties_only(spark):
    plan = rounded(spark.createDataFrame([(0.25,)], "x double"))._jdf.queryExecution().optimizedPlan().toString()
    assert "FLOOR" in plan.upper()
