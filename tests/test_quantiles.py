import numpy as np
import pytest
from pyspark.sql import functions as F

from changegrid.operators.quantiles import group_quantiles


def test_equals_numpy_on_skewed_groups_with_ties(spark):
    """A third of the rows in one group, heavy ties, nulls, and a sketch that is really used."""
    value = "round(pow((id * 7919 % 100003) / 100003D, 4) * if(id % 5 = 0, 1, 1000), 1)"
    df = spark.range(400_000).selectExpr("if(id % 3 = 0, 0, int(id % 50)) as g", "id", f"if(id % 11 = 0, null, {value}) as v")
    got = group_quantiles(df, ["g"], "v", [0.02, 0.5, 0.98], ["a", "b", "c"], ["id"], accuracy=2000).toPandas().set_index("g")
    pdf = df.toPandas().dropna()
    for g, rows in pdf.groupby("g"):
        want = np.percentile(rows.v, [2, 50, 98])
        assert got.loc[g, ["a", "b", "c"]].to_numpy(float) == pytest.approx(want, abs=1e-9)
        assert got.loc[g, "vmax"] == rows.v.max()


def test_packed_values_give_the_same_answer(spark):
    df = spark.range(3000).selectExpr("int(id % 2) as g", "id div 100 as b", "(id * 37 % 1009) / 7D as v")
    packed = df.groupBy("g", "b").agg(F.collect_list("v").alias("v"))
    one = group_quantiles(df, ["g"], "v", [0.02, 0.98], ["a", "b2"], ["b"]).orderBy("g").collect()
    two = group_quantiles(packed, ["g"], "v", [0.02, 0.98], ["a", "b2"], ["b"], packed=True).orderBy("g").collect()
    assert one == two
