"""Searches in one task's memory against the rounds over the cluster."""

import random

import pytest
from pyspark.sql import functions as F

from orbweave.operators import local, traverse
from orbweave.operators.components import connected_components
from orbweave.operators.relational import induced
from orbweave.plans import graph_queries as Q


@pytest.fixture(scope="module")
def edges(spark):
    rng = random.Random(3)
    half = {tuple(sorted(rng.sample(range(0, 1500, 5), 2))) for _ in range(330)} - {(0, 0)}
    return spark.createDataFrame([*half, *((b, a) for a, b in half)], "src long, dst long").repartition(3).cache()


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_closeness(spark, edges):
    members = spark.range(0, 1500, 5).select(F.col("id").alias("v"))
    want = rows(traverse.closeness(edges, members))
    assert rows(traverse.closeness_bits(edges, members)) == want and len(want) == 300
    inner = induced(edges, members)
    sums = rows(local.closeness_sums(inner))
    assert {r for r in rows(traverse.closeness_rounds(inner, 1200))} == sums


def test_khop_pairs(spark, edges):
    some = spark.range(0, 1500, 10).select(F.col("id").alias("v"))
    for h in (0, 1, 2, 3):
        assert rows(local.khop_pairs(edges, some, h)) == rows(traverse.khop_pairs(edges, some, h))


def test_distance(edges):
    for a, b in ((0, 5), (10, 500), (15, 1495), (20, 3), (4, 3)):
        assert local.distance(edges, a, b) == traverse.distance(edges, a, b)


def test_largest_by_key(edges):
    keyed = edges.where("src < dst").select((F.col("src") % 3).alias("tag"), "src", "dst")
    got = rows(local.largest_by_key(keyed, "tag"))
    for tag in (0, 1, 2):
        own = keyed.where(F.col("tag") == tag)
        parts = connected_components(own.select(F.col("src").alias("u"), F.col("dst").alias("v")))
        assert (tag, parts.groupBy("component").count().agg(F.max("count")).first()[0]) in got


def test_queries_give_the_same_beyond_the_limit(spark, edges, monkeypatch):
    person = edges.select(F.col("src").alias("id")).distinct().withColumn("birthday", F.lit("1990-01-01").cast("date"))
    tag = spark.createDataFrame([(0, "a"), (1, "b")], "id long, name string")
    interest = person.select(F.col("id").alias("person"), (F.col("id") % 2).alias("tag"))
    place = spark.createDataFrame([(1, "P", "City")], "id long, name string, label string")
    none = spark.createDataFrame([], "a long, b long")
    tables = {
        "person": person, "knows": edges, "tag": tag, "interest": interest, "place": place,
        "part_of": none.toDF("child", "parent"), "located": person.select(F.col("id").alias("person"), F.lit(1).cast("long").alias("place")),
        "organisation": spark.createDataFrame([], "id long, place long, type string"),
        "work_at": none.toDF("person", "org"), "study_at": none.toDF("person", "org"),
    }
    g = Q.Graph(tables)
    ask = lambda: (
        Q.query1(g, 0, 500, -1).collect(), Q.query2(g, 2, "1980-01-01").collect(), Q.query3(g, 4, 2, "P").collect(), Q.query3_pruned(g, 4, 2, "P").collect()
    )
    small = ask()
    monkeypatch.setattr(local, "LOCAL_EDGES", 10)
    assert ask() == small and small[2] == small[3]


def test_searches_by_component(spark, edges, monkeypatch):
    """Many components, directed edges, vertices without edges, several blocks; the same rows by rounds."""
    monkeypatch.setattr(local, "UNPACKED_ROWS", 7)
    edges = edges.where("src < 600 and dst < 600")  # few rounds
    one_way = edges.where("src < dst or src % 3 = 0")
    v = spark.range(0, 3000, 5).select(F.col("id").alias("v"))
    some = v.where("v % 7 = 0")
    for e, sources in ((edges, some), (one_way, v), (edges.where("false"), some)):
        want = rows(traverse.msbfs_levels(e, sources))
        assert traverse.all_levels(e, sources).count() == len(want)
        assert rows(traverse.all_levels(e, sources)) == want
        sums = {}
        for src, _, d in want:
            a, n = sums.get(src, (0, 0))
            sums[src] = (a + d, n + 1)
        sums = {(s, *x) for s, x in sums.items()}
        assert rows(traverse.distance_sums_from(e, sources)) == sums
        assert rows(traverse.all_distance_sums(e, v)) == {tuple(r) for r in traverse.distance_sums(e, v).collect()}


def test_searches_take_components_apart():
    """A search doesn't hold the state of components that its sources lie outside of."""
    import numpy as np

    src = np.array([0, 1, 10, 11, 5, 6])
    dst = np.array([1, 0, 11, 10, 6, 5])
    parts = local.Parts(src, dst)
    graph, lo = parts.around(parts.places(np.array([5, 6])))
    assert graph.ids.tolist() == [5, 6] and lo == 2 and graph.targets.tolist() == [1, 0]


def test_closeness_beyond_thirty_hops(spark):
    """The catalogue's SQL stops at 30 hops; the operators don't."""
    path = [(i, i + 1) for i in range(40)]
    e = spark.createDataFrame([*path, *((b, a) for a, b in path)], "src long, dst long")
    members = spark.range(41).select(F.col("id").alias("v"))
    want = {v: (40, sum(abs(v - w) for w in range(41))) for v in range(41)}
    assert {r.v: (r.reached, r.total) for r in traverse.closeness_bits(e, members).collect()} == want


def test_closeness_forms_and_query4_beyond_thirty_hops(spark):
    """The plain, the waves' and the ranked form go as far as paths do, too."""
    path = [(i, i + 1) for i in range(33)]
    e = spark.createDataFrame([*path, *((b, a) for a, b in path)], "src long, dst long").coalesce(2).cache()
    members = spark.range(34).select(F.col("id").alias("v"))
    total = {v: sum(abs(v - w) for w in range(34)) for v in range(34)}
    assert {(r.v, r.reached, r.total) for r in traverse.closeness(e, members).collect()} == {(v, 33, t) for v, t in total.items()}
    assert {tuple(r) for r in traverse.closeness_rounds(e).collect()} == {(v, 33, t) for v, t in total.items()}
    tables = {
        "knows": e, "tag": spark.createDataFrame([(0, "a")], "id long, name string"),
        "forum_tag": spark.createDataFrame([(7, 0)], "forum long, tag long"),
        "forum_member": members.select(F.lit(7).cast("long").alias("forum"), F.col("v").alias("person")),
    }
    best = sorted(((33 * 33 / (33 * t), -v) for v, t in total.items()), reverse=True)
    # the ends as well: their farthest vertices are 33 hops away
    assert [tuple(r) for r in Q.query4(Q.Graph(tables), 34, "a").collect()] == [(-v, s) for s, v in best]


def test_rounds_take_what_the_last_one_reached(monkeypatch):
    """On a path, a search from its end doesn't go over all that is still open in each round."""
    import numpy as np

    taken = []

    class Counted(local.Adjacency):
        def of(self, rows):
            taken.append(len(rows))
            return super().of(rows)

    if pull := getattr(local, "_pull", None):
        monkeypatch.setattr(local, "_pull", lambda graph, rows, now: taken.append(len(rows)) or pull(graph, rows, now))
    a = np.arange(400)
    graph = Counted(np.r_[a, a + 1], np.r_[a + 1, a])
    total = np.zeros(401, np.int64)
    for level, rows, new, _ in local._search(graph, np.array([0]), None):
        total[rows] += level * np.bitwise_count(new).sum(1, dtype=np.int64)
    assert total.tolist() == list(range(401))
    assert sum(taken) < 5 * 401


def test_words_and_parts_of_levels(monkeypatch):
    """Three words of sources, a few rows at a time, both directions; the first round that all rows are near, too."""
    import numpy as np

    monkeypatch.setattr(local, "PULLED_ROWS", 7)
    rng = np.random.default_rng(5)
    for n, m in ((190, 700), (300, 320)):
        src, dst = rng.integers(0, n, (2, m)) * 3
        step = {}
        for x, y in zip(src.tolist(), dst.tolist(), strict=True):
            step.setdefault(x, set()).add(y)
        parts = local.Parts(dst, src)
        places = parts.places(np.unique(np.r_[src, dst]))[:150]
        graph, lo = parts.around(places)
        got = {}
        for level, rows, new, _ in local._search(graph, places - lo, None):
            v, k = np.nonzero(np.unpackbits(new.view(np.uint8), axis=1, bitorder="little"))
            got |= {(int(parts.ids[places[j]]), int(graph.ids[rows[i]])): level for i, j in zip(v, k, strict=True)}
        want = {}
        for s in parts.ids[places].tolist():
            near, seen, d = {s}, {s}, 0
            while near := {y for x in near for y in step.get(x, ())} - seen:
                d += 1
                seen |= near
                want |= {(s, y): d for y in near}
        assert got == want and len(want) > 300


def test_levels_come_by_vertex(spark, monkeypatch):
    """A block's rows of one vertex lie together, which halves the files; graphs beyond LEVEL_CELLS give the same rows."""
    path = [(i, i + 1) for i in range(60)] + [(7, 100), (100, 101), (101, 7)]
    e = spark.createDataFrame([*path, *((b, a) for a, b in path[:50])], "src long, dst long").coalesce(1)
    v = e.selectExpr("src AS v").union(e.selectExpr("dst AS v")).distinct()
    got = [tuple(r) for r in local.levels(e, v).coalesce(1).collect()]
    runs = 1 + sum(a[1] != b[1] for a, b in zip(got, got[1:], strict=False))
    assert runs == len({v for _, v, _ in got})
    step = {}
    for r in e.collect():
        step.setdefault(r.src, set()).add(r.dst)
    want = {}
    for s in [*range(61), 100, 101]:
        near, seen, d = {s}, {s}, 0
        while near := {y for x in near for y in step.get(x, ())} - seen:
            d += 1
            seen |= near
            want |= {(s, y): d for y in near}
    assert {(a, b): d for a, b, d in got} == want and len(got) == len(want)
    monkeypatch.setattr(local, "LEVEL_CELLS", 0)
    assert sorted(tuple(r) for r in local.levels(e, v).collect()) == sorted(got)
