import re

import pytest
from pyspark.sql import functions as F

from loomline.llm import simhash


def lists_broadcast(df):
    """Whether the plan that ran broadcasts rows that an explode made."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n")
    depth = [len(re.match(r"[\s:+*-]*", x)[0]) for x in lines]
    for i, x in enumerate(lines):
        if re.search(r"\bBroadcastExchange\b", x):
            below = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            if any("Generate explode" in y for y in lines[i:below]):
                return True
    return False


@pytest.mark.parametrize("n", [200, 1000])
def test_lists_of_long_postings_are_not_broadcast(spark, n):
    # One posting by its upper four octets, longer than STAR_FROM; few fingerprints, over 2,000 spots each.
    fps = simhash.cut(spark.range(n).select(F.expr("(7L << 32) | (xxhash64(id) & 4294967295L)").alias("fp")).distinct())
    df = simhash.links(fps)
    got = {frozenset((r.u, r.v)) for r in df.collect()}
    values = [r.fp for r in fps.collect()]
    near = {frozenset((a, b)) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 4}

    def groups(pairs):
        of = {v: {v} for v in values}
        for u, v in map(tuple, pairs):
            if of[u] is not of[v]:
                of[u] |= of[v]
                for x in of[u]:
                    of[x] = of[u]
        return {frozenset(g) for g in of.values()}

    assert groups(got) == groups(near)
    assert not lists_broadcast(df)
