from pyspark.sql import functions as F

from strata.operators.tableops import delete, update


def test_null_condition_keeps_the_row(spark):
    df = spark.createDataFrame([(1,), (None,)], "v int")
    assert delete(df, F.col("v") < 5).collect() == [(None,)]
    assert sorted(r.v or -1 for r in update(df, F.col("v") < 5, {"v": F.lit(9)}).collect()) == [-1, 9]
