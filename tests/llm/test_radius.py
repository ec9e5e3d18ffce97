"""Links at exactly the radius."""

import pytest

from sparkloom.llm import simhash


def groups(nodes, pairs):
    of = {n: {n} for n in nodes}
    for p in pairs:
        both = set().union(*(of[n] for n in p))
        for n in both:
            of[n] = both
    return {frozenset(x) for x in of.values()}


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_links(spark, radius):
    fps = [0, *((1 << (k + 1)) - 1 << 8 * k for k in range(5)), 1 << 60]
    found = {frozenset(r) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), radius).collect()}
    near = {frozenset((a, b)) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= radius}
    assert {p for p in found if len(p) == 2} <= near and groups(fps, found) == groups(fps, near)


@pytest.mark.parametrize("radius", [-1, 7, 64])
def test_no_ball(radius):
    with pytest.raises(ValueError):
        simhash.Ball(radius)
