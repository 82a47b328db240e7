"""Iterative traversals: driver loops over staged frontiers, one distributed round at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.operators import local
from orbweave.operators.relational import expand, expand_bits, expand_least, expand_unseen, induced, merge_bits, overlay_from
from orbweave.session import stage

#: Rows of search state (a vertex and a word of 64 sources) that one wave of ``closeness_bits`` may reach.
WAVE_ROWS = 2_000_000_000


def _vertex(edges: DataFrame, v: int) -> DataFrame:
    return edges.sparkSession.range(1).select(F.lit(v).cast("long").alias("v"))


def bfs_levels(edges: DataFrame, source: int, max_depth: int | None = None) -> DataFrame:
    """(v, d) of all vertices that ``source`` reaches, itself at 0."""
    frontier = stage(_vertex(edges, source), "frontier")
    out = frontier.withColumn("d", F.lit(0))
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        frontier = stage(expand_unseen(edges, frontier, out.select("v")), "frontier")
        if frontier.isEmpty():
            break
        out = out.union(frontier.withColumn("d", F.lit(depth)))
    return out


def bfs_parents(edges: DataFrame, source: int) -> DataFrame:
    """(v, parent, d): a breadth-first tree by least parents; the source is its own."""
    frontier = stage(_vertex(edges, source), "frontier")
    out = frontier.select("v", F.col("v").alias("parent"), F.lit(0).alias("d"))
    depth = 0
    while True:
        depth += 1
        frontier = stage(expand_least(edges, frontier, out), "frontier")
        if frontier.isEmpty():
            return out
        out = out.union(frontier.select("v", "parent", F.lit(depth).alias("d")))


def msbfs_levels(edges: DataFrame, sources: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(src, v, d) from every vertex ``v`` of ``sources``, all in one loop."""
    frontier = stage(sources.select(F.col("v").alias("src"), "v").distinct(), "frontier")
    out = frontier.withColumn("d", F.lit(0))
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        frontier = stage(expand_unseen(edges, frontier, out, ("src", "v")), "frontier")
        if frontier.isEmpty():
            break
        out = out.union(frontier.withColumn("d", F.lit(depth)))
    return out


def distance(edges: DataFrame, a: int, b: int) -> int:
    """Hops from a to b, searched from both ends in turn; -1 if there is no path."""
    if a == b:
        return 0
    sides = [stage(_vertex(edges, x), "frontier") for x in (a, b)]
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    steps, seen, depth = (edges, back), list(sides), 0
    while True:
        for k in (0, 1):
            depth += 1
            sides[k] = stage(expand(steps[k], sides[k]).join(seen[k], "v", "left_anti"), "frontier")
            if not sides[k].join(sides[1 - k], "v", "left_semi").isEmpty():
                return depth
            if sides[k].isEmpty():
                return -1
            seen[k] = seen[k].union(sides[k])


def distance_on_the_fly(knows: DataFrame, replies: DataFrame, creator: DataFrame, x: int, a: int, b: int) -> int:
    """``distance`` over the overlay of mutual replies, of which each round builds the frontier's edges only."""
    if a == b:
        return 0
    sides = [stage(_vertex(knows, v), "frontier") for v in (a, b)]
    seen, depth = list(sides), 0
    while True:
        for k in (0, 1):
            depth += 1
            near = overlay_from(sides[k], knows, replies, creator, x).select(F.col("dst").alias("v")).distinct()
            sides[k] = stage(near.join(seen[k], "v", "left_anti"), "frontier")
            if not sides[k].join(sides[1 - k], "v", "left_semi").isEmpty():
                return depth
            if sides[k].isEmpty():
                return -1
            seen[k] = seen[k].union(sides[k])


def khop_pairs(edges: DataFrame, vertices: DataFrame, h: int) -> DataFrame:
    """(a, b), a < b: pairs of ``vertices`` within h hops over all edges, by h rounds from each."""
    reached = msbfs_levels(edges, vertices, h).where("d > 0 and src < v")
    return reached.join(vertices.select("v"), "v", "left_semi").select(F.col("src").alias("a"), F.col("v").alias("b"))


def khop_pairs_meet(edges: DataFrame, vertices: DataFrame, h: int) -> DataFrame:
    """The same pairs from balls of half the radius that meet; needs symmetric edges."""
    ball = stage(msbfs_levels(edges, vertices, (h + 1) // 2), "ball")
    left = ball.select(F.col("src").alias("a"), "v")
    right = ball.where(F.col("d") <= h // 2).select(F.col("src").alias("b"), "v")
    met = left.join(right, "v").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return met.where("a < b").distinct()


def place_closure(places: DataFrame, part_of: DataFrame, root: int) -> DataFrame:
    """(v): the place and all that is part of it; the hierarchy is a tree."""
    down = part_of.select(F.col("parent").alias("src"), F.col("child").alias("dst"))
    return bfs_levels(down, root).select("v")


def relevant_persons(places, part_of, located, organisations, work_at, study_at, root: int) -> DataFrame:
    """(v): persons who live, study or work in a place or its parts (work in companies, study in universities)."""
    inside = stage(place_closure(places, part_of, root), "places")
    homes = located.join(inside.withColumnRenamed("v", "place"), "place", "left_semi").select(F.col("person").alias("v"))
    there = organisations.join(inside.withColumnRenamed("v", "place"), "place", "left_semi")
    ties = [homes]
    for kind, edges in (("Company", work_at), ("University", study_at)):
        orgs = there.where(F.col("type") == kind).select(F.col("id").alias("org"))
        ties.append(edges.join(orgs, "org", "left_semi").select(F.col("person").alias("v")))
    return ties[0].union(ties[1]).union(ties[2]).distinct()


def _scores(sums: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """(v, reached, total, score) from (v, reached without itself, total of distances)."""
    score = F.when(F.coalesce("total", F.lit(0)) > 0, (F.col("reached") * F.col("reached")) / (F.lit(n - 1) * F.col("total")))
    return members.select("v").join(sums, "v", "left").select(
        "v",
        F.coalesce("reached", F.lit(0)).cast("long").alias("reached"),
        F.coalesce("total", F.lit(0)).cast("long").alias("total"),
        F.coalesce(score, F.lit(0.0)).alias("score"),
    )


def closeness(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Closeness centrality (r-1)^2 / ((n-1) s) in the graph induced by ``members``, plain rows."""
    members = stage(members.select("v").distinct(), "members")
    inner = stage(induced(edges, members), "induced")
    levels = msbfs_levels(inner, members).where("d > 0")
    sums = levels.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("reached"), F.sum("d").alias("total"))
    return _scores(sums, members, members.count())


def source_bits(sources: DataFrame) -> DataFrame:
    """(batch, v, bits): every source as its own bit, 64 to a word."""
    return sources.select(F.floor(F.col("v") / 64).cast("long").alias("batch"), "v", F.expr("shiftleft(1L, cast(pmod(v, 64) as int))").alias("bits"))


def msbfs_bits(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(batch, v, bits, d): the sources, 64 to a word, at distance d from which ``v`` is; a source itself at 0."""
    frontier = seen = stage(source_bits(sources.select("v").distinct()), "frontier")
    out = frontier.withColumn("d", F.lit(0))
    depth = 0
    while True:
        depth += 1
        frontier = stage(expand_bits(edges, frontier, seen), "frontier")
        if frontier.isEmpty():
            return out
        out = out.union(frontier.withColumn("d", F.lit(depth)))
        seen = stage(merge_bits(seen, frontier), "seen")


def msbfs_levels_bits(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """The rows of ``msbfs_levels``, found 64 sources to a word."""
    bit = F.explode(F.expr("filter(sequence(0, 63), k -> (shiftrightunsigned(bits, k) & 1L) = 1L)"))
    return msbfs_bits(edges, sources).select("batch", "v", "d", bit.alias("k")).select((F.col("batch") * 64 + F.col("k")).alias("src"), "v", "d")


def distance_sums(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(src, total, reached) of every vertex: sum and number of its distances to ``vertices``, which hold all ends of edges.

    Searched against the edges, the sources at distance d of a vertex are those that it reaches at d.
    """
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    n = F.bit_count("bits").cast("long")
    return msbfs_bits(back, vertices).groupBy(F.col("v").alias("src")).agg(F.sum(n * F.col("d")).alias("total"), F.sum(n).alias("reached"))


def _with_self(sums: DataFrame, sources: DataFrame) -> DataFrame:
    """(src, total, reached) of all ``sources``, each of which reaches itself at 0."""
    none = F.lit(0).cast("long")
    return sources.select(F.col("v").alias("src")).distinct().join(sums, "src", "left").select(
        "src", F.coalesce("total", none).alias("total"), (F.coalesce("reached", none) + 1).alias("reached")
    )


def all_levels(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """The rows of ``msbfs_levels``: searched in tasks up to ``local.SPLIT_EDGES`` (staged) edges, else by words in rounds."""
    if not local.fits(edges, local.SPLIT_EDGES):
        return msbfs_levels_bits(edges, sources)
    own = sources.select(F.col("v").alias("src"), "v", F.lit(0).alias("d")).distinct()
    return own.union(local.levels(edges, sources))


def all_distance_sums(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """The rows of ``distance_sums``, chosen likewise."""
    if not local.fits(edges, local.SPLIT_EDGES):
        return distance_sums(edges, vertices)
    return _with_self(local.sums_of_all(edges, vertices), vertices)


def distance_sums_from(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(src, total, reached) of ``sources`` only, chosen likewise."""
    if not local.fits(edges, local.SPLIT_EDGES):
        found = msbfs_levels_bits(edges, sources)
        return found.groupBy("src").agg(F.sum("d").alias("total"), F.count("*").alias("reached"))
    return _with_self(local.sums_from(edges, sources), sources)


def closeness_bits(edges: DataFrame, members: DataFrame) -> DataFrame:
    """The same for symmetric edges, 64 sources to a word.

    A vertex is at distance d from as many sources as it reaches at d, so bit counts by vertex do.  An
    induced graph of up to ``local.LOCAL_EDGES`` edges is searched in tasks that hold it whole; a larger one
    in rounds over the cluster, in waves of words so that the state stays below WAVE_ROWS.
    """
    members = stage(members.select("v").distinct(), "members")
    inner = stage(induced(edges, members), "induced")
    n = members.count()
    if local.fits(inner):
        return _scores(local.closeness_sums(inner), members, n)
    return _scores(closeness_rounds(inner), members, n)


def closeness_rounds(inner: DataFrame, wave_rows: int = WAVE_ROWS) -> DataFrame:
    """(v, reached, total) of the ends of symmetric edges, in rounds."""
    # isolated members reach nothing and stay out of the rounds
    ends = stage(inner.select(F.col("src").alias("v")).distinct(), "ends")
    bits = stage(source_bits(ends), "bits")
    full = stage(bits.groupBy("batch").agg(F.bit_or("bits").alias("all")), "full")
    waves = max(1, -(-full.count() * ends.count() // wave_rows))
    sums = [ends.select("v", F.lit(0).cast("long").alias("reached"), F.lit(0).cast("long").alias("total")).where("false")]
    for wave in range(waves):
        frontier = seen = bits.where(f"pmod(batch, {waves}) = {wave}")
        done = None
        level = 0
        while True:
            level += 1
            frontier = stage(expand_bits(inner, frontier, seen, done), "frontier")
            if frontier.isEmpty():
                break
            count = F.sum(F.bit_count("bits")).cast("long")
            sums.append(stage(frontier.groupBy("v").agg(count.alias("reached"), (count * level).alias("total")), "sums"))
            merged = stage(merge_bits(seen, frontier).join(full, "batch"), "seen")
            # words that all their sources have reached take part no more, as long as they are known as such
            more = merged.where(F.col("bits") == F.col("all")).select("batch", "v")
            done = more if done is None else done.union(more)
            seen = merged.where(F.col("bits") != F.col("all")).select("batch", "v", "bits")
    total = sums[0]
    for s in sums[1:]:
        total = total.union(s)
    return total.groupBy("v").agg(F.sum("reached").alias("reached"), F.sum("total").alias("total"))
