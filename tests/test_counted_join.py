import random

import pytest

from textloom.operators.counted_join import join_counted


@pytest.mark.parametrize("parts", [1, 3, 50, 8192])
def test_same_as_a_plain_join(spark, parts):
    r = random.Random(parts)
    left = [(r.choice(["hot", "hot", "warm", None, f"k{r.randint(0, 30)}"]), r.randint(0, 1), i) for i in range(600)]
    a = spark.createDataFrame(left, "k string, _n int, count long").toDF("k", "f", "v").repartition(4)
    b = a.where("k IS NOT NULL AND k <> 'k3'").groupBy("k", "f").count()
    got = sorted(map(tuple, join_counted(a, b, ["k", "f"], "count", parts).collect()))
    assert got == sorted(map(tuple, a.join(b, ["k", "f"]).collect())) and len(got) > 300
    assert join_counted(a.limit(0), b, ["k", "f"], "count", parts).count() == 0 == join_counted(a, b.limit(0), ["k", "f"], "count", parts).count()
