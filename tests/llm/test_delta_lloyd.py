import math
import random

import pytest

from stacksight.llm import delta_lloyd

from . import brute

FIELDS = "vec_id long, embedding array<float>"
NAMES = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def points(rows):
    f = lambda v: [math.floor(64 * x) for x in v]
    return {i: f(v) for i, v in rows if i is not None and v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)}


def clustered(spark, rows, fields=FIELDS, **how):
    return {r["vec_id"]: tuple(r[c] for c in NAMES) for r in delta_lloyd.cluster(spark.createDataFrame(rows, fields), **how).collect()}


def vectors(r, n, groups, step=0.125):
    centres = [[r.choice((-2, 2)) for _ in range(64)] for _ in range(groups)]
    return [(i, [c + step * r.randrange(-9, 9) for c in r.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    """A third of all vectors are one, and ties are common, as components are multiples of 1/8."""
    r = random.Random(seed)
    rows = vectors(r, 300, 3 + 10 * seed)
    rows += [(1000 + k, rows[0][1]) for k in range(150)]
    assert clustered(spark, rows) == brute.lloyd(points(rows))


def test_rounds_that_move_few(spark):
    """Well-parted groups: after the first rounds some centroids stand still, so most vectors are compared with few."""
    rows = vectors(random.Random(9), 250, 5)
    for rounds in (0, 1, 2, 6):
        assert clustered(spark, rows, rounds=rounds, clusters=7) == brute.lloyd(points(rows), 7, rounds)


def test_odd_rows(spark):
    r = random.Random(4)
    good = vectors(r, 9, 2)
    odd = [(None, good[0][1]), (50, None), (51, []), (52, good[0][1][:63]), (53, [None, *good[0][1][1:]]), (54, [math.nan, *good[0][1][1:]]), (55, [math.inf, *good[0][1][1:]]), (56, [0.0] * 64), (57, good[0][1] + [1.0])]
    assert clustered(spark, good + odd) == brute.lloyd(points(good + odd))
    assert clustered(spark, good + good[:4]) == brute.lloyd(points(good))
    assert clustered(spark, []) == {} and clustered(spark, odd[1:5]) == {}
    named = [(i, v, 1, {"a": 1}) for i, v in good]
    assert clustered(spark, named, FIELDS + ", cluster int, point map<string,int>") == brute.lloyd(points(good))


def test_component_too_large(spark):
    with pytest.raises(Exception, match="may not fit a long"):
        clustered(spark, [(1, [1e8] * 64)])
