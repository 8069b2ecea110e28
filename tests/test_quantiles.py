import math
import random

import numpy as np
import pytest

from rankweave.operators.quantiles import exact_quantiles

QS = {"least": 0.0, "q1": 0.25, "median": 0.5, "p99": 0.99, "most": 1.0}


def plain(values, q):
    values = sorted(values)
    at = (len(values) - 1) * q
    low, high = values[math.floor(at)], values[math.ceil(at)]
    return low if low == high else low + (high - low) * (at - math.floor(at))


@pytest.mark.parametrize("buckets,finish", [(3, 1), (16, 8), (1024, 4096)])
def test_equals_sorting(spark, buckets, finish):
    draw = random.Random(5)
    groups = {
        "level": [draw.random() for _ in range(700)],
        "ties": [float(draw.randrange(4)) for _ in range(300)],
        "powers": [math.copysign(10.0 ** draw.randrange(-300, 300), draw.random() - 0.5) for _ in range(60)],
        "ends": [-math.inf, math.inf, -1.7976931348623157e308, 1.7976931348623157e308, 5e-324, 1e-323, 1.5e-323, 0.0, -0.0],
        "one": [4.25],
        None: [float(i) for i in range(50)],
    }
    rows = [(k, v) for k, values in groups.items() for v in values] + [("none", None), ("nan", math.nan), ("one", None)]
    draw.shuffle(rows)
    got = {r.k: r for r in exact_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", QS, buckets, finish).collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        assert got[k].n == len(values)
        for name, q in QS.items():
            want = plain(values, q)
            assert got[k][name] == want or (math.isnan(want) and math.isnan(got[k][name])), (k, name)


def test_one_hot_group_and_no_keys(spark):
    rows = spark.range(30_000).selectExpr("id % 7919 * 1.5 AS v", "'x' AS n")
    values = np.array([r.v for r in rows.select("v").collect()], float)
    got = exact_quantiles(rows, [], "v", QS, buckets=32, finish=100).collect()
    assert len(got) == 1 and got[0].n == 30_000
    for name, q in QS.items():
        assert got[0][name] == pytest.approx(float(np.quantile(values, q)), rel=1e-12)


def test_empty_table(spark):
    assert exact_quantiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", QS).collect() == []
