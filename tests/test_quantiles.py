import random

import numpy as np
import pytest

from veracell.operators.quantiles import exact

PS = [0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0]


@pytest.mark.parametrize("buckets,few", [(2, 0), (16, 0), (16, 10000)])
def test_equals_sorting(spark, buckets, few):
    r = random.Random(5)
    data = {"ties": [float(r.randint(0, 5)) for _ in range(500)], "wide": [r.lognormvariate(0, 8) for _ in range(700)], "one": [3.5], "two": [1.0, 2.0], "same": [7.0] * 50}
    rows = [(c, x) for c, v in data.items() for x in v] + [("none", None), ("one", None), ("two", float("nan"))]
    got = exact(spark.createDataFrame(rows, "column string, x double").repartition(3), PS, buckets, few)
    assert set(got) == set(data)
    for c, v in data.items():
        assert np.allclose(got[c], np.quantile(v, PS), rtol=1e-12), c


def test_no_rows(spark):
    assert exact(spark.createDataFrame([], "column string, x double"), PS) == {}
