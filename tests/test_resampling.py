"""The permutation test of the scan takes the largest r of all features in each draw."""

import random

import numpy as np

from pixelfurrow.operators import stats


def test_max_statistic_takes_all_features(spark):
    r = random.Random(2)
    rows = [(i, f, r.random() + (i if f == 3 else 0), float(i)) for i in range(12) for f in range(5)]
    x = np.array([[v for i, g, v, _ in rows if g == f] for f in range(5)])
    best = []
    for draw in range(1, 41):
        mixed = [((i + 1) * (draw * 2654435 + 40503) + (i + 1) * (i + 1) * (draw + 11) * 7919) % 1000003 for i in range(12)]
        source = sorted(range(12), key=lambda i: (mixed[i], i))
        y = np.empty(12)
        for k, i in enumerate(source):
            y[i] = k  # labels are positions
        best.append(max(abs(np.corrcoef(f, y)[0, 1]) for f in x))
    seen = max(abs(np.corrcoef(f, np.arange(12.0))[0, 1]) for f in x)
    k = sum(b >= seen - 1e-12 for b in best)
    out = stats.max_statistic(spark.createDataFrame(rows, "i long, feature int, value double, label double"), 40).first()
    assert abs(out.observed - seen) < 1e-9 and out.exceeding == k and abs(out.p - (1 + k) / 41) < 1e-12
    one = stats.max_statistic(spark.createDataFrame([x for x in rows if x[1] == 0], "i long, feature int, value double, label double"), 40).first()
    assert one.observed < out.observed


def test_permuted_correlations_of_packed_columns_equal_those_of_rows(spark):
    """Nulls of both columns too; before, every draw was rows of a shuffle and two joins."""
    r = random.Random(5)
    odd = lambda k, v: None if k % 7 == 3 else v
    rows = [(i, odd(i, r.random()), odd(i + 1, float(r.randrange(4)))) for i in range(60)]
    for some in (rows, rows[:2], [(i, 1.0, b) for i, _, b in rows], []):
        table = spark.createDataFrame(some, "i long, a double, b double").repartition(3)
        packed, spread = ({x.draw: x.s for x in stats.permuted_correlations(table, 30, most).collect()} for most in (60, -1))
        assert packed.keys() == spread.keys() == set(range(1, 31) if some else [])
        assert all(s is None and packed[d] is None or abs(packed[d] - s) < 1e-12 for d, s in spread.items())
    assert "Window" not in stats.permuted_correlations(table, 30)._jdf.queryExecution().toString()
