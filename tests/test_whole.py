"""Queries over whole relations: against their SQL and against brute force."""

import os
from collections import defaultdict

import pytest
from parity import compare, connection

from orbweave.operators import traverse
from orbweave.plans import catalog
from orbweave.sources.testbed import chat_graph, purchase_graph

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def same_as_sql(spark, name):
    return not compare(spark, connection(SF), name, catalog.queries()[name], catalog.oracle_sql()[name], SF)


def pairs(df):
    return {tuple(r) for r in df.collect()}


def test_bit_expand_all(spark):
    """All 64 bits, the sign bit too."""
    assert same_as_sql(spark, "bit_expand_all")
    knows = pairs(purchase_graph(spark, SF).knows.select("src", "dst"))
    want = defaultdict(set)
    for src, dst in knows:
        want[src // 64, dst].add(src % 64)
    got = {(r.batch, r.v): {k for k in range(64) if r.bits >> k & 1} for r in catalog.queries()["bit_expand_all"](spark, SF).collect()}
    assert got == dict(want)
    assert {62, 63} <= set().union(*got.values())


def levels(edges, sources):
    """{(src, v): d} by plain breadth-first search."""
    step = defaultdict(set)
    for src, dst in edges:
        step[src].add(dst)
    found = {}
    for s in sources:
        near, d = {s}, 0
        while near:
            found |= {(s, v): d for v in near}
            d += 1
            near = {w for v in near for w in step[v] if (s, w) not in found}
    return found


def test_levels_of_all_persons(spark):
    g = purchase_graph(spark, SF)
    want = levels(pairs(g.knows.select("src", "dst")), [r.id for r in g.person.select("id").collect()])
    got = catalog.queries()["msbfs_levels_all"](spark, SF).collect()
    assert len(got) == len(want) and {(r.src, r.v): r.d for r in got} == want
    sums = defaultdict(lambda: [0, 0])
    for (src, _), d in want.items():
        sums[src][0] += d
        sums[src][1] += 1
    assert pairs(catalog.queries()["distance_sum_all"](spark, SF).select("src", "total", "reached")) == {(s, *x) for s, x in sums.items()}
    assert same_as_sql(spark, "msbfs_levels_all")
    assert same_as_sql(spark, "distance_sum_all")


def test_levels_against_direction(spark):
    edges = [(0, 63), (63, 62), (62, 64), (64, 127), (127, 0), (5, 63)]
    e = spark.createDataFrame(edges, "src long, dst long")
    v = spark.createDataFrame([(x,) for x in (0, 5, 62, 63, 64, 127, 200)], "v long")
    want = levels(edges, (0, 5, 62, 63, 64, 127, 200))
    assert {(r.src, r.v): r.d for r in traverse.msbfs_levels_bits(e, v).collect()} == want
    sums = {s: (sum(d for (a, _), d in want.items() if a == s), sum(a == s for a, _ in want)) for s, _ in want}
    assert pairs(traverse.distance_sums(e, v).select("src", "total", "reached")) == {(s, *x) for s, x in sums.items()}


def test_merge_union_all(spark):
    assert same_as_sql(spark, "merge_union_all")
    g = purchase_graph(spark, SF)
    want = dict.fromkeys((r.person for r in g.interest.collect()), 1) | dict.fromkeys((r.dst for r in g.knows.collect()), 2)
    assert pairs(catalog.queries()["merge_union_all"](spark, SF).select("v", "d")) == set(want.items())


def test_frontier_overlay_all(spark):
    assert same_as_sql(spark, "frontier_overlay_all")
    g = chat_graph(spark, SF)
    creator = {r.id: r.creator for r in g.comment.collect()}
    replied = {(creator[r.child], creator[r.parent]) for r in g.reply.collect()}
    knows = pairs(g.knows.select("src", "dst"))
    want = {(a, b) for a, b in knows if (a, b) in replied and (b, a) in replied}
    assert pairs(catalog.queries()["frontier_overlay_all"](spark, SF).select("src", "dst")) == want
    assert max(a for a, _ in want) >= 5
