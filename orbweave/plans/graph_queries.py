"""The four parameterised queries over a graph of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.operators import local, traverse
from orbweave.operators.components import connected_components
from orbweave.operators.relational import common_counts, name_lookup, overlay, top
from orbweave.session import stage


@dataclass
class Graph:
    """Relations by name; what a query doesn't use is never scanned.

    person(id, birthday), knows(src, dst), tag(id, name), interest(person, tag), forum_tag(forum, tag),
    forum_member(forum, person), place(id, name, label), part_of(child, parent), located(person, place),
    organisation(id, place, type), work_at(person, org), study_at(person, org), comment(id, creator),
    reply(child, parent).
    """

    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.tables[name]
        except KeyError:
            raise AttributeError(f"the graph has no table {name!r}") from None


def query1(g: Graph, p1: int, p2: int, x: int) -> DataFrame:
    """(distance) between two persons over edges with more than x replies each way; -1 if there is no path."""
    spark = g.knows.sparkSession
    if p1 == p2:
        found = 0
    else:
        comment = g.tables.get("comment")
        edges = stage(overlay(g.knows, g.tables.get("reply"), comment, x), "overlay")
        found = local.distance(edges, p1, p2) if local.fits(edges) else traverse.distance(edges, p1, p2)
    return spark.range(1).select(F.lit(found).cast("long").alias("distance"))


def query1_on_the_fly(g: Graph, p1: int, p2: int, x: int) -> DataFrame:
    """The same, counting the replies of reached persons only."""
    found = traverse.distance_on_the_fly(g.knows, g.tables.get("reply"), g.tables.get("comment"), x, p1, p2)
    return g.knows.sparkSession.range(1).select(F.lit(found).cast("long").alias("distance"))


def largest_components(g: Graph, since) -> DataFrame:
    """(tag, score): the largest component of the persons born at ``since`` or later with that interest."""
    young = g.person.where(F.col("birthday") >= F.lit(since).cast("date")).select(F.col("id").alias("person"))
    member = stage(g.interest.join(young, "person", "left_semi").select("tag", "person").distinct(), "members")
    left = member.select("tag", F.col("person").alias("src"))
    right = member.select("tag", F.col("person").alias("dst"))
    inner = stage(g.knows.where("src < dst").join(left, "src").join(right, ["tag", "dst"]).select("tag", "src", "dst"), "inner")
    # tags whose edges fit into a task are done by tag, the others by star contraction over the cluster
    large = stage(inner.groupBy("tag").count().where(F.col("count") > local.LOCAL_EDGES).select("tag"), "large")
    found = local.largest_by_key(inner.join(large, "tag", "left_anti"), "tag")
    found = found.union(member.select("tag", F.lit(1).cast("long").alias("n")).distinct())
    if not large.isEmpty():
        rest = inner.join(large, "tag", "left_semi")
        ends = [F.struct("tag", F.col(c).alias("v")).alias(n) for c, n in (("src", "u"), ("dst", "v"))]
        sizes = connected_components(rest.select(*ends)).groupBy("component").agg(F.count("*").alias("n"))
        found = found.union(sizes.select("component.tag", "n"))
    best = found.groupBy(F.col("tag").alias("id")).agg(F.max("n").alias("n"))
    return g.tag.join(best, "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("score"))


def query2(g: Graph, k: int, since) -> DataFrame:
    """(name, score): the k tags of the largest components, ties by name."""
    return top(largest_components(g, since), k, F.desc("score"), "name", "id").select("name", "score")


def place_persons(g: Graph, place: str) -> DataFrame:
    root = name_lookup(g.place, place)
    return traverse.relevant_persons(g.place, g.part_of, g.located, g.organisation, g.work_at, g.study_at, root)


def _pairs(g: Graph, knows: DataFrame, persons: DataFrame, h: int) -> DataFrame:
    """(a, b): pairs of ``persons`` within h hops; graphs and places that fit into a task are searched there."""
    if local.fits(knows) and local.fits(persons):
        return local.khop_pairs(knows, persons, h)
    return traverse.khop_pairs_meet(knows, persons, h)


def _scored(g: Graph, pairs: DataFrame) -> DataFrame:
    shared = common_counts(pairs, g.interest)
    return pairs.join(shared, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("score"))


def query3(g: Graph, k: int, h: int, place: str) -> DataFrame:
    """(a, b, score): the k pairs of a place's persons within h hops that share most interests; score 0 counts."""
    persons = stage(place_persons(g, place), "persons")
    pairs = stage(_pairs(g, stage(g.knows.select("src", "dst"), "knows"), persons, h), "pairs")
    return top(_scored(g, pairs), k, F.desc("score"), "a", "b")


def query3_pruned(g: Graph, k: int, h: int, place: str) -> DataFrame:
    """The same rows from as few persons as suffice: those of many interests first.

    A pair shares no more interests than its poorer person has.  Once the k-th best score among the
    persons with at least t interests is t or more, no other pair can be among the best; until
    then four times as many persons take part.
    """
    persons = stage(place_persons(g, place), "persons")
    knows = stage(g.knows.select("src", "dst"), "knows")
    tags = g.interest.join(persons.withColumnRenamed("v", "person"), "person", "left_semi").groupBy("person").agg(F.count("*").alias("n"))
    rich = persons.join(tags.withColumnRenamed("person", "v"), "v", "left").select("v", F.coalesce("n", F.lit(0)).alias("n"))
    rich = stage(rich, "rich")
    cuts = rich.agg(F.percentile_approx("n", [15 / 16, 3 / 4], 10_000)).first()[0] or []
    for t in [*sorted(set(cuts), reverse=True), 0]:
        pairs = stage(_pairs(g, knows, stage(rich.where(F.col("n") >= t).select("v"), "rich"), h), "pairs")
        best = stage(top(_scored(g, pairs), k, F.desc("score"), "a", "b"), "best")
        worst = best.agg(F.min("score"), F.count("*")).first()
        if t == 0 or (worst[1] == k and worst[0] >= t):
            return top(best, k, F.desc("score"), "a", "b")


def tag_members(g: Graph, tag: str) -> DataFrame:
    forums = g.forum_tag.where(F.col("tag") == name_lookup(g.tag, tag)).select("forum")
    return g.forum_member.join(forums, "forum", "left_semi").select(F.col("person").alias("v")).distinct()


def query4(g: Graph, k: int, tag: str) -> DataFrame:
    """(person, score): the k members of a tag's forums of the highest closeness centrality."""
    found = traverse.closeness_bits(g.knows, tag_members(g, tag))
    return top(found.select(F.col("v").alias("person"), "score"), k, F.desc("score"), "person")
