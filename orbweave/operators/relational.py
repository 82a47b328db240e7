"""Single-step graph operators: sparse products as joins, masks as semi and anti joins.

Edges have (src, dst); vertex sets have one column ``v``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expand(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    """Distinct targets of the frontier's edges."""
    return edges.join(frontier.select(F.col("v").alias("src")), "src", "left_semi").select(F.col("dst").alias("v")).distinct()


def expand_unseen(edges: DataFrame, frontier: DataFrame, seen: DataFrame, keys: tuple[str, ...] = ("v",)) -> DataFrame:
    """Targets that aren't seen yet; with ("src", "v") as keys for many sources at once."""
    if keys == ("v",):
        return expand(edges, frontier).join(seen, "v", "left_anti")
    step = edges.select(F.col("src").alias("v"), F.col("dst").alias("next"))
    reached = frontier.join(step, "v").select("src", F.col("next").alias("v")).distinct()
    return reached.join(seen.select("src", "v"), ["src", "v"], "left_anti")


def expand_least(edges: DataFrame, frontier: DataFrame, seen: DataFrame) -> DataFrame:
    """(v, parent): unseen targets with their least predecessor."""
    step = edges.join(frontier.select(F.col("v").alias("src")), "src", "left_semi")
    return step.groupBy(F.col("dst").alias("v")).agg(F.min("src").alias("parent")).join(seen.select("v"), "v", "left_anti")


def expand_bits(edges: DataFrame, frontier: DataFrame, seen: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """(batch, v, bits): the sources, 64 to a word, that reach a vertex for the first time.

    ``done`` has the (batch, v) that all sources of their word have reached; they aren't in ``seen`` any more.
    """
    step = edges.select(F.col("src").alias("v"), F.col("dst").alias("next"))
    reached = frontier.join(step, "v").groupBy("batch", F.col("next").alias("v")).agg(F.bit_or("bits").alias("bits"))
    if done is not None:
        reached = reached.join(done, ["batch", "v"], "left_anti")
    old = seen.select("batch", "v", F.col("bits").alias("old"))
    new = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long"))))
    return reached.join(old, ["batch", "v"], "left").select("batch", "v", new.alias("bits")).where("bits <> 0")


def saturated(bits: DataFrame) -> DataFrame:
    """(batch, v) of words that have all the bits that any word of their batch has."""
    full = bits.groupBy("batch").agg(F.bit_or("bits").alias("all"))
    return bits.join(full, "batch").where(F.col("bits") == F.col("all")).select("batch", "v")


def merge_bits(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).groupBy("batch", "v").agg(F.bit_or("bits").alias("bits"))


def induced(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with both ends in ``vertices``."""
    return edges.join(vertices.select(F.col("v").alias("src")), "src", "left_semi").join(
        vertices.select(F.col("v").alias("dst")), "dst", "left_semi"
    )


def reply_counts(replies: DataFrame, creator: DataFrame) -> DataFrame:
    """(src, dst, n): how often src replied to a comment of dst."""
    child = creator.select(F.col("id").alias("child"), F.col("creator").alias("src"))
    parent = creator.select(F.col("id").alias("parent"), F.col("creator").alias("dst"))
    return replies.join(child, "child").join(parent, "parent").groupBy("src", "dst").agg(F.count("*").alias("n"))


def interactions(knows: DataFrame, replies: DataFrame, creator: DataFrame) -> DataFrame:
    """(src, dst, n) of acquainted pairs: the lesser of both directions' reply counts, 0 if there are none."""
    counts = reply_counts(replies, creator).join(knows, ["src", "dst"], "left_semi")
    back = counts.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("n").alias("m"))
    return knows.select("src", "dst").join(counts, ["src", "dst"], "left").join(back, ["src", "dst"], "left").select(
        "src", "dst", F.least(F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0))).alias("n")
    )


def overlay(knows: DataFrame, replies: DataFrame, creator: DataFrame, x: int) -> DataFrame:
    """KNOWS edges over which each side replied to the other more than x times; all for a negative x."""
    if x < 0:
        return knows.select("src", "dst").distinct()
    counts = reply_counts(replies, creator).join(knows, ["src", "dst"], "left_semi").where(F.col("n") > x).select("src", "dst")
    back = counts.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return counts.join(back, ["src", "dst"], "left_semi")


def overlay_from(frontier: DataFrame, knows: DataFrame, replies: DataFrame, creator: DataFrame, x: int) -> DataFrame:
    """The overlay's edges from the vertices of ``frontier``; replies of and to other persons aren't counted."""
    own = frontier.select(F.col("v").alias("src"))
    near = knows.select("src", "dst").distinct().join(own, "src", "left_semi")
    if x < 0:
        return near
    mine = creator.select(F.col("id").alias("mine"), F.col("creator").alias("src")).join(own, "src", "left_semi")
    other = creator.select(F.col("id").alias("other"), F.col("creator").alias("dst"))
    for here, there in (("child", "parent"), ("parent", "child")):  # replies of the frontier, then to it
        ends = replies.select(F.col(here).alias("mine"), F.col(there).alias("other"))
        counts = ends.join(mine, "mine").join(other, "other").groupBy("src", "dst").agg(F.count("*").alias("n"))
        near = near.join(counts.where(F.col("n") > x), ["src", "dst"], "left_semi")
    return near


def common_counts(pairs: DataFrame, interest: DataFrame) -> DataFrame:
    """(a, b, n): shared tags of given pairs only; pairs without any have no row."""
    left = interest.select(F.col("person").alias("a"), "tag")
    right = interest.select(F.col("person").alias("b"), "tag")
    return pairs.join(left, "a").join(right, ["b", "tag"]).groupBy("a", "b").agg(F.count("*").alias("n"))


def name_lookup(vertices: DataFrame, name: str) -> int:
    """The least id of a name; an error if there is none."""
    found = vertices.where(F.col("name") == name).agg(F.min("id")).first()[0]
    if found is None:
        raise LookupError(f"no vertex is named {name!r}")
    return found


def top(df: DataFrame, k: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(k)
