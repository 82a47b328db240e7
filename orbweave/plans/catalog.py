"""All registered graph queries, each beside the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions.text import generate_parameters, query_columns
from orbweave.operators import relational as R
from orbweave.operators import traverse as T
from orbweave.operators.components import connected_components
from orbweave.plans import graph_queries as Q
from orbweave.sources.files import Policy, convert, organisation_type, read_edges, read_table, reverse, without_dangling, write_table
from orbweave.session import shared_dir, stage
from orbweave.sources.testbed import CHAT, PURCHASE, chat_graph, purchase_graph, with_clause

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}

DATE, TAG = "1995-03-01", "Brand#1"


def _p(name: str, uses: str, sql: str, recursive: bool = False):
    """Register a query on the purchase graph with its SQL over the relations ``uses``."""
    return _register(name, purchase_graph, PURCHASE, uses, sql, recursive)


def _c(name: str, uses: str, sql: str, recursive: bool = False):
    return _register(name, chat_graph, CHAT, uses, sql, recursive)


def _register(name, graph, relations, uses, sql, recursive):
    def wrap(f):
        _QUERIES[name] = lambda spark, sf_dir: f(graph(spark, sf_dir))
        head = with_clause(relations, *uses.split(), recursive=recursive)
        _ORACLE[name] = f"{head}{', ' if sql.startswith('+') else ' '}{sql.lstrip('+')}"
        return f

    return wrap


def _set(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("v")).distinct()


# sources


@_p("scan_person_birthday", "person", "SELECT id, birthday FROM person")
def _(g):
    return g.person


@_p("edges_distinct", "knows", "SELECT DISTINCT src, dst FROM knows")
def _(g):
    return g.knows.select("src", "dst").distinct()


@_p("fk_edge_city", "located", "SELECT place AS src, person AS dst FROM located")
def _(g):
    return g.located.select(F.col("place").alias("src"), F.col("person").alias("dst"))


@_c("fk_edge_creator", "comment", "SELECT id AS src, creator AS dst FROM comment")
def _(g):
    return g.comment.select(F.col("id").alias("src"), F.col("creator").alias("dst"))


@_p("organisation_type", "organisation", "SELECT id, place, type FROM organisation")
def _(g):
    return organisation_type(g.place, g.org_at)


@_p("reverse_edge", "interest", "SELECT tag AS src, person AS dst FROM interest")
def _(g):
    return reverse(g.interest.select(F.col("person").alias("src"), F.col("tag").alias("dst")))


@_p("drop_dangling", "knows person", "SELECT src, dst FROM knows WHERE src IN (SELECT id FROM person WHERE id % 3 = 0) AND dst IN (SELECT id FROM person)")
def _(g):
    return without_dangling(g.knows, g.person.where("id % 3 = 0"), g.person)


def _folder(df: DataFrame, name: str) -> str:
    return f"{shared_dir(df.sparkSession)}/staged/{name}-{uuid.uuid4().hex}"


def _persons(g) -> DataFrame:
    """Persons with all columns of their file; names have quotes and backslashes."""
    text = [F.lit(x).alias(c) for c, x in (("lastName", '"q" \\x'), ("gender", "f"), ("locationIP", "1.2.3.4"), ("browserUsed", "b"))]
    at = F.lit("2010-01-02T03:04:05").cast("timestamp").alias("creationDate")
    return g.person.select("id", F.concat(F.lit("p "), "id").alias("firstName"), "birthday", at, *text)


@_p("csv_vertices", "person", """SELECT id, birthday, 'p ' || id AS "firstName", '"q" \\x' AS "lastName" FROM person""")
def _(g):
    """Written as a catalogue file and read back by header names."""
    path = _folder(g.person, "csv")
    write_table(_persons(g), path, "person")
    return read_table(g.person.sparkSession, path, "person", ["id", "birthday", "firstName", "lastName"])


@_p("csv_edges", "interest person", "SELECT DISTINCT person AS src, tag AS dst FROM interest WHERE person IN (SELECT id FROM person WHERE id % 3 = 0)")
def _(g):
    """Each edge is in the file twice and collapses; edges from other persons dangle."""
    path = _folder(g.interest, "csv")
    edges = g.interest.select(F.col("person").alias("src"), F.col("tag").alias("dst"))
    write_table(edges.union(edges), path, "person_hasInterest_tag")
    ends = (g.person.where("id % 3 = 0"), g.tag)
    return read_edges(g.person.sparkSession, path, "person_hasInterest_tag", drop_dangling=ends)


@_p("csv_convert", "place", "SELECT id, name, upper(label[1]) || lower(label[2:]) AS label FROM place")
def _(g):
    """A raw file in Latin-1 with a header of its own becomes one of the catalogue."""
    spark, raw, out = g.place.sparkSession, _folder(g.place, "raw"), _folder(g.place, "csv")
    text = g.place.select("id", "name", F.lit("\u00fc").alias("url"), F.upper("label").alias("type"))
    text.write.options(sep="|", quote="", escape="", header=True, encoding="ISO-8859-1").csv(f"{raw}/place.csv")
    convert(spark, raw, out, ["place"], "ISO-8859-1")
    return read_table(spark, out, "place").where(F.col("url") == "\u00fc").select("id", "name", "label")


@_p("csv_policies", "person", "SELECT CASE WHEN id % 5 = 0 THEN 9223372036854775807 ELSE id END AS id, 'a|\"b' AS name, CAST(NULL AS VARCHAR) AS url FROM person")
def _(g):
    """Quoted fields, blanks, comment lines, a missing and a further column, and numbers out of range that are clamped."""
    spark, path = g.person.sparkSession, _folder(g.person, "csv")
    number = F.when(F.col("id") % 5 == 0, F.concat(F.lit("9"), F.lpad(F.col("id").cast("string"), 30, "0"))).otherwise(F.col("id").cast("string"))
    line = F.concat(number, F.lit(' | "a|""b" |z'))
    head = spark.createDataFrame([("id:ID(Tag)|name:STRING|more:STRING",)], "value string")
    g.person.select(line.alias("value")).union(spark.createDataFrame([("# nothing",)], "value string")).repartition(3).write.text(f"{path}/rows")
    # one file: the header stands first
    whole = head.select("value", F.lit(0).alias("k")).union(spark.read.text(f"{path}/rows").select("value", F.lit(1).alias("k")))
    whole.coalesce(1).sortWithinPartitions("k").select("value").write.text(f"{path}/tag.csv")
    return read_table(spark, path, "tag", policy=Policy(quote='"', trim=True, comment="#", missing="null", overflow="clamp"))


@_p("parameter_rows", "person place tag", "SELECT 1 AS query, 100 AS n, 100 AS fit UNION ALL SELECT 2, 100, 100 UNION ALL SELECT 3, 100, 100 UNION ALL SELECT 4, 100, 100")
def _(g):
    """A hundred generated rows of each query; ``fit`` counts those whose parameters are in range and exist."""
    out = None
    for q in (1, 2, 3, 4):
        rows = generate_parameters(q, 100, g.person, g.place, g.tag)
        x = F.split("line", r"\|")
        ids = g.person.select(F.col("id").cast("string").alias("last")) if q == 1 else None
        names = {2: g.person.select(F.col("birthday").cast("string").alias("last")), 3: g.place.select(F.col("name").alias("last")), 4: g.tag.select(F.col("name").alias("last"))}
        low, high = (-1, 3) if q == 1 else (3, 7)
        own = rows.select(F.when(F.lit(q == 1), x[1]).otherwise(F.element_at(x, -1)).alias("last"), F.when(F.lit(q == 1), F.element_at(x, -1)).otherwise(x[0]).cast("int").alias("k"))
        known = (ids if q == 1 else names[q]).distinct()
        fit = own.where(F.col("k").between(low, high)).join(known, "last", "left_semi").agg(F.count("*").alias("fit"))
        one = rows.agg(F.count("*").alias("n")).crossJoin(fit).select(F.lit(q).alias("query"), "n", "fit")
        out = one if out is None else out.union(one)
    return out


# filters


@_p("saturated_words", "place", "+e AS (SELECT id AS src, CASE label WHEN 'Continent' THEN 1 WHEN 'Country' THEN 2 ELSE 3 END AS dst FROM place UNION ALL SELECT id, 10 + id % 2 FROM place), w AS (SELECT CAST(floor(src / 64) AS BIGINT) AS batch, dst AS v, bit_or(CASE WHEN src % 64 = 63 THEN CAST('-9223372036854775808' AS BIGINT) ELSE CAST(1 AS BIGINT) << CAST(least(src % 64, 62) AS INTEGER) END) AS bits FROM e GROUP BY 1, 2) SELECT batch, CAST(v AS BIGINT) AS v FROM w WHERE bits = (SELECT bit_or(bits) FROM w x WHERE x.batch = w.batch)")
def _(g):
    kind = F.when(F.col("label") == "Continent", 1).when(F.col("label") == "Country", 2).otherwise(3).cast("long")
    edges = g.place.select(F.col("id").alias("src"), kind.alias("dst")).union(g.place.select("id", 10 + F.col("id") % 2))
    seed = T.source_bits(_set(g.place, "id"))
    # a source isn't among the targets, so nothing is seen before
    return R.saturated(R.expand_bits(edges, seed, seed.where("false")))


@_p("birthday_filter", "person", f"SELECT id FROM person WHERE birthday >= DATE '{DATE}'")
def _(g):
    return g.person.where(F.col("birthday") >= F.lit(DATE).cast("date")).select("id")


_COUNTS = "reply_n AS (SELECT c.creator AS src, p.creator AS dst, count(*) AS n FROM reply JOIN comment c ON c.id = child JOIN comment p ON p.id = parent GROUP BY 1, 2)"


@_c("reply_threshold", "reply comment", f"+{_COUNTS} SELECT src, dst, n FROM reply_n WHERE n > 1")
def _(g):
    return R.reply_counts(g.reply, g.comment).where(F.col("n") > 1)


@_p("tag_count_equals", "interest", "SELECT person, count(*) AS n FROM interest GROUP BY person HAVING count(*) = 4")
def _(g):
    return g.interest.groupBy("person").agg(F.count("*").alias("n")).where(F.col("n") == 4)


@_p("meeting_prune", "knows", "SELECT dst AS v, sum(CASE WHEN src % 2 = 0 THEN 2 ELSE 1 END)::BIGINT AS mark FROM knows GROUP BY dst HAVING sum(CASE WHEN src % 2 = 0 THEN 2 ELSE 1 END) >= 3")
def _(g):
    mark = F.sum(F.when(F.col("src") % 2 == 0, 2).otherwise(1)).alias("mark")
    return g.knows.groupBy(F.col("dst").alias("v")).agg(mark).where(F.col("mark") >= 3)


@_p("no_self_lower_triangle", "knows", "SELECT src, dst FROM knows WHERE src < dst")
def _(g):
    return g.knows.where("src <> dst").where("src < dst")


@_p("neighbours_of", "interest", "SELECT person AS v FROM interest WHERE tag = 3")
def _(g):
    return g.interest.where("tag = 3").select(F.col("person").alias("v"))


@_p("induced_subgraph", "knows interest", "SELECT src, dst FROM knows WHERE src IN (SELECT person FROM interest WHERE tag = 3) AND dst IN (SELECT person FROM interest WHERE tag = 3)")
def _(g):
    return R.induced(g.knows, _set(g.interest.where("tag = 3"), "person"))


@_p("name_lookup_min_id", "tag", f"SELECT min(id) AS id FROM tag WHERE name = '{TAG}'")
def _(g):
    return g.tag.where(F.col("name") == TAG).agg(F.min("id").alias("id"))


@_c("existence_pattern", "reply comment", f"+{_COUNTS} SELECT DISTINCT src, dst FROM reply_n")
def _(g):
    return R.reply_counts(g.reply, g.comment).select("src", "dst").distinct()


@_p("default_zero", "person interest", "SELECT id, count(tag) AS n FROM person LEFT JOIN interest ON person = id GROUP BY id")
def _(g):
    n = g.interest.groupBy(F.col("person").alias("id")).agg(F.count("*").alias("n"))
    return g.person.select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


@_p("restrict_targets", "knows located", "SELECT src, dst FROM knows WHERE dst IN (SELECT person FROM located WHERE place < 1100)")
def _(g):
    return g.knows.join(g.located.where("place < 1100").select(F.col("person").alias("dst")), "dst", "left_semi").select("src", "dst")


# joins


@_c("reply_counts", "reply comment", f"+{_COUNTS} SELECT src, dst, n FROM reply_n")
def _(g):
    return R.reply_counts(g.reply, g.comment)


@_c("reply_counts_masked", "reply comment knows", f"+{_COUNTS} SELECT src, dst, n FROM reply_n SEMI JOIN knows USING (src, dst)")
def _(g):
    return R.reply_counts(g.reply, g.comment).join(g.knows, ["src", "dst"], "left_semi")


_COMMON = "SELECT k.src AS a, k.dst AS b, count(*) AS n FROM knows k JOIN interest i ON i.person = k.src JOIN interest j ON j.person = k.dst AND j.tag = i.tag WHERE k.src < k.dst GROUP BY 1, 2"


@_p("common_interests", "knows interest", _COMMON)
def _(g):
    pairs = g.knows.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return R.common_counts(pairs, g.interest)


@_p("semi_expand", "knows interest", "SELECT DISTINCT dst AS v FROM knows WHERE src IN (SELECT person FROM interest WHERE tag = 3)")
def _(g):
    return R.expand(g.knows, _set(g.interest.where("tag = 3"), "person"))


@_p("expand_union", "knows interest", "SELECT dst AS v FROM knows WHERE src IN (SELECT person FROM interest WHERE tag = 3) UNION SELECT person FROM interest WHERE tag = 3")
def _(g):
    start = _set(g.interest.where("tag = 3"), "person")
    return R.expand(g.knows, start).union(start).distinct()


@_p("forum_members", "forum_tag forum_member", "SELECT DISTINCT person AS v FROM forum_member WHERE forum IN (SELECT forum FROM forum_tag WHERE tag = 3)")
def _(g):
    edges = g.forum_member.select(F.col("forum").alias("src"), F.col("person").alias("dst"))
    return R.expand(edges, g.forum_tag.where("tag = 3").select(F.col("forum").alias("v")))


@_p("expand_unseen", "knows interest", "SELECT DISTINCT dst AS v FROM knows WHERE src IN (SELECT person FROM interest WHERE tag = 3) AND dst NOT IN (SELECT person FROM interest WHERE tag = 3)")
def _(g):
    start = _set(g.interest.where("tag = 3"), "person")
    return R.expand_unseen(g.knows, start, start)


@_p("expand_unseen_multi", "knows", "SELECT DISTINCT a.src AS src, b.dst AS v FROM knows a JOIN knows b ON a.dst = b.src WHERE a.src <> b.dst AND NOT EXISTS (SELECT 1 FROM knows c WHERE c.src = a.src AND c.dst = b.dst)")
def _(g):
    first = g.knows.select("src", F.col("dst").alias("v"))
    seen = first.union(g.knows.select("src", F.col("src").alias("v")).distinct())
    return R.expand_unseen(g.knows, first, seen, ("src", "v"))


@_p("bit_expand", "knows", "SELECT CAST(floor(src / 64) AS BIGINT) AS batch, dst AS v, bit_or(CAST(1 AS BIGINT) << CAST(src % 64 AS INTEGER)) AS bits FROM knows WHERE src % 64 < 62 GROUP BY 1, 2")
def _(g):
    own = g.knows.where("src % 64 < 62").select(F.col("src").alias("v")).distinct()
    seed = own.select(F.expr("cast(floor(v / 64) as bigint)").alias("batch"), "v", F.expr("shiftleft(1L, cast(v % 64 as int))").alias("bits"))
    return R.expand_bits(g.knows, seed, seed)


@_p("bit_expand_all", "knows", "SELECT CAST(floor(src / 64) AS BIGINT) AS batch, dst AS v, bit_or(CASE WHEN src % 64 = 63 THEN CAST('-9223372036854775808' AS BIGINT) ELSE CAST(1 AS BIGINT) << CAST(least(src % 64, 62) AS INTEGER) END) AS bits FROM knows GROUP BY 1, 2")
def _(g):
    seed = T.source_bits(_set(g.knows, "src"))
    return R.expand_bits(g.knows, seed, seed)


@_p("set_intersect", "interest", "SELECT person AS v FROM interest WHERE tag = 3 INTERSECT SELECT person FROM interest WHERE tag = 26")
def _(g):
    return _set(g.interest.where("tag = 3"), "person").intersect(_set(g.interest.where("tag = 26"), "person"))


@_c("reciprocal_edges", "reply comment", f"+{_COUNTS} SELECT a.src AS src, a.dst AS dst FROM reply_n a JOIN reply_n b ON a.src = b.dst AND a.dst = b.src")
def _(g):
    e = R.reply_counts(g.reply, g.comment).select("src", "dst")
    return e.join(reverse(e), ["src", "dst"], "left_semi")


@_p("merge_union", "knows interest", "SELECT v, max(d) AS d FROM (SELECT person AS v, 1 AS d FROM interest WHERE tag = 3 UNION ALL SELECT dst, 2 FROM knows WHERE src < 20) x GROUP BY v")
def _(g):
    a = g.interest.where("tag = 3").select(F.col("person").alias("v"), F.lit(1).alias("d"))
    return a.union(g.knows.where("src < 20").select(F.col("dst").alias("v"), F.lit(2).alias("d"))).groupBy("v").agg(F.max("d").alias("d"))


@_p("merge_union_all", "knows interest", "SELECT v, max(d) AS d FROM (SELECT person AS v, 1 AS d FROM interest UNION ALL SELECT dst, 2 FROM knows) x GROUP BY v")
def _(g):
    a = g.interest.select(F.col("person").alias("v"), F.lit(1).alias("d"))
    return a.union(g.knows.select(F.col("dst").alias("v"), F.lit(2).alias("d"))).groupBy("v").agg(F.max("d").alias("d"))


@_p("min_parent_step", "knows interest", "SELECT dst AS v, min(src) AS parent FROM knows WHERE src IN (SELECT person FROM interest WHERE tag = 3) AND dst NOT IN (SELECT person FROM interest WHERE tag = 3) GROUP BY dst")
def _(g):
    start = _set(g.interest.where("tag = 3"), "person")
    return R.expand_least(g.knows, start, start)


@_p("meet_pairs", "knows", "SELECT DISTINCT a.src AS a, b.src AS b FROM knows a JOIN knows b ON a.dst = b.dst WHERE a.src < b.src AND NOT (a.src % 2 = 1 AND b.src % 2 = 1)")
def _(g):
    a = g.knows.select(F.col("src").alias("a"), "dst")
    b = g.knows.select(F.col("src").alias("b"), "dst")
    return a.join(b, "dst").where("a < b AND NOT (a % 2 = 1 AND b % 2 = 1)").select("a", "b").distinct()


@_c("frontier_overlay", "reply comment knows", f"+{_COUNTS} SELECT a.src AS src, a.dst AS dst FROM reply_n a JOIN reply_n b ON a.src = b.dst AND a.dst = b.src SEMI JOIN knows k ON k.src = a.src AND k.dst = a.dst WHERE a.n > 0 AND b.n > 0 AND a.src < 5")
def _(g):
    near = g.knows.where("src < 5 OR dst < 5")
    return R.overlay(near, g.reply, g.comment, 0).where("src < 5")


@_c("frontier_overlay_all", "reply comment knows", f"+{_COUNTS} SELECT a.src AS src, a.dst AS dst FROM reply_n a JOIN reply_n b ON a.src = b.dst AND a.dst = b.src SEMI JOIN knows k ON k.src = a.src AND k.dst = a.dst WHERE a.n > 0 AND b.n > 0 AND a.src IN (SELECT creator FROM comment JOIN reply ON id = child)")
def _(g):
    # the frontier: persons who replied
    replied = g.comment.join(g.reply.select(F.col("child").alias("id")), "id", "left_semi").select(F.col("creator").alias("src")).distinct()
    out = g.knows.join(replied, "src", "left_semi").select("src", "dst")
    near = out.union(reverse(out)).distinct()
    return R.overlay(near, g.reply, g.comment, 0).join(replied, "src", "left_semi").select("src", "dst")


@_c("frontier_overlay_counts", "reply comment knows", f"+{_COUNTS} SELECT a.src AS src, a.dst AS dst FROM reply_n a JOIN reply_n b ON a.src = b.dst AND a.dst = b.src SEMI JOIN knows k ON k.src = a.src AND k.dst = a.dst WHERE a.n > 0 AND b.n > 0 AND a.src IN (SELECT creator FROM comment JOIN reply ON id = child)")
def _(g):
    replied = g.comment.join(g.reply.select(F.col("child").alias("id")), "id", "left_semi").select(F.col("creator").alias("v")).distinct()
    return R.overlay_from(replied, g.knows, g.reply, g.comment, 0)


@_p("optional_count_distinct", "person knows interest", "SELECT id, count(DISTINCT interest.tag) AS n FROM person LEFT JOIN knows ON src = id LEFT JOIN interest ON interest.person = dst GROUP BY id")
def _(g):
    tags = g.interest.select(F.col("person").alias("dst"), "tag")
    seen = g.knows.join(tags, "dst").groupBy(F.col("src").alias("id")).agg(F.count_distinct("tag").alias("n"))
    return g.person.select("id").join(seen, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


# aggregates


@_p("tags_per_person", "interest", "SELECT person, count(*) AS n FROM interest GROUP BY person")
def _(g):
    return g.interest.groupBy("person").agg(F.count("*").alias("n"))


@_p("max_tags", "interest", "SELECT max(n) AS n FROM (SELECT count(*) AS n FROM interest GROUP BY person) x")
def _(g):
    return g.interest.groupBy("person").agg(F.count("*").alias("n")).agg(F.max("n").alias("n"))


@_p("popcount_sum", "knows", "SELECT dst AS v, sum(bit_count(src))::BIGINT AS n FROM knows GROUP BY dst")
def _(g):
    return g.knows.groupBy(F.col("dst").alias("v")).agg(F.sum(F.bit_count("src")).cast("long").alias("n"))


@_p("largest_group", "located", "SELECT max(n) AS n FROM (SELECT count(*) AS n FROM located GROUP BY place) x")
def _(g):
    return g.located.groupBy("place").agg(F.count("*").alias("n")).agg(F.max("n").alias("n"))


@_p("bit_or", "knows", "SELECT dst AS v, bit_or(src) AS bits FROM knows GROUP BY dst")
def _(g):
    return g.knows.groupBy(F.col("dst").alias("v")).agg(F.bit_or("src").alias("bits"))


@_p("ratio", "knows interest", "SELECT a.v AS v, CAST(a.n AS DOUBLE) / b.n AS r FROM (SELECT src AS v, count(*) AS n FROM knows GROUP BY src) a JOIN (SELECT person AS v, count(*) AS n FROM interest GROUP BY person) b ON a.v = b.v")
def _(g):
    a = g.knows.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("n"))
    b = g.interest.groupBy(F.col("person").alias("v")).agg(F.count("*").alias("m"))
    return a.join(b, "v").select("v", (F.col("n") / F.col("m")).alias("r"))


# top-k, sets, scalars


@_p("topk_tags", "interest tag", "SELECT name, count(*) AS score FROM interest JOIN tag ON tag = id GROUP BY name ORDER BY score DESC, name LIMIT 5")
def _(g):
    n = g.interest.groupBy(F.col("tag").alias("id")).agg(F.count("*").alias("score"))
    return R.top(n.join(g.tag, "id").select("name", "score"), 5, F.desc("score"), "name")


@_p("topk_pairs", "knows interest", f"SELECT a, b, n FROM ({_COMMON}) x ORDER BY n DESC, a, b LIMIT 7")
def _(g):
    pairs = g.knows.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return R.top(R.common_counts(pairs, g.interest), 7, F.desc("n"), "a", "b")


@_p("topk_scores", "knows", "SELECT src AS person, count(*) AS score FROM knows GROUP BY src ORDER BY score DESC, person LIMIT 5")
def _(g):
    return R.top(g.knows.groupBy(F.col("src").alias("person")).agg(F.count("*").alias("score")), 5, F.desc("score"), "person")


@_p("persons_union", "located work_at study_at", "SELECT person AS v FROM located WHERE place < 1050 UNION SELECT person FROM work_at UNION SELECT person FROM study_at")
def _(g):
    return _set(g.located.where("place < 1050"), "person").union(_set(g.work_at, "person")).union(_set(g.study_at, "person")).distinct()


@_p("unseen_difference", "knows interest", "SELECT src AS v FROM knows EXCEPT SELECT person FROM interest")
def _(g):
    return _set(g.knows, "src").join(_set(g.interest, "person"), "v", "left_anti")


@_p("date_parse_format", "person", "SELECT id, strftime(birthday, '%Y/%m/%d') AS text, birthday >= DATE '1995-03-01' AS later FROM person")
def _(g):
    return g.person.select("id", F.date_format("birthday", "yyyy/MM/dd").alias("text"), (F.col("birthday") >= F.to_date(F.lit(DATE))).alias("later"))


@_p("bit_ops", "knows", "SELECT src, dst, src & dst AS a, src | dst AS o, ~src AS n, CAST(floor(src / 64) AS BIGINT) AS word, src % 64 AS bit, least(src, dst) AS lo FROM knows")
def _(g):
    return g.knows.select(
        "src", "dst", F.col("src").bitwiseAND(F.col("dst")).alias("a"), F.col("src").bitwiseOR(F.col("dst")).alias("o"),
        F.bitwise_not("src").alias("n"), F.expr("src div 64").alias("word"), (F.col("src") % 64).alias("bit"), F.least("src", "dst").alias("lo"),
    )


@_c("least_interaction", "reply comment knows", f"+{_COUNTS} SELECT k.src AS src, k.dst AS dst, least(coalesce(a.n, 0), coalesce(b.n, 0)) AS n FROM knows k LEFT JOIN reply_n a ON a.src = k.src AND a.dst = k.dst LEFT JOIN reply_n b ON b.src = k.dst AND b.dst = k.src")
def _(g):
    return R.interactions(g.knows, g.reply, g.comment)


@_p("pair_format", "knows", "SELECT src || '|' || dst AS pair FROM knows WHERE src < dst")
def _(g):
    return g.knows.where("src < dst").select(F.concat_ws("|", "src", "dst").alias("pair"))


@_p("label_initcap", "place", "SELECT id, upper(label[1]) || lower(label[2:]) AS label FROM place")
def _(g):
    return g.place.select("id", F.initcap(F.lower("label")).alias("label"))


@_p("parse_query_text", "tag", "SELECT 'query4(' || id || ', ' || name || ') % x' AS line, 4 AS query, CAST(id AS VARCHAR) AS first, name AS last FROM tag")
def _(g):
    line = F.concat(F.lit("query4("), F.col("id").cast("string"), F.lit(", "), F.col("name"), F.lit(") % x")).alias("line")
    parsed = g.tag.select(line).select("line", *query_columns(F.col("line")))
    return parsed.select("line", "query", F.get("params", 0).alias("first"), F.get("params", 1).alias("last"))


# algorithms

_BFS = "+r AS (SELECT CAST({s} AS BIGINT) AS v, 0 AS d UNION SELECT dst, d + 1 FROM r JOIN {e} ON src = v WHERE d < {cap})"


@_p("bfs_levels", "knows", _BFS.format(s=1, e="knows", cap=24) + " SELECT v, min(d) AS d FROM r GROUP BY v", True)
def _(g):
    return T.bfs_levels(_staged(g.knows), 1)


@_p("bfs_parents", "knows", _BFS.format(s=1, e="knows", cap=24) + ", l AS (SELECT v, min(d) AS d FROM r GROUP BY v) SELECT v, CASE WHEN d = 0 THEN v ELSE (SELECT min(k.src) FROM knows k JOIN l m ON m.v = k.src WHERE k.dst = l.v AND m.d = l.d - 1) END AS parent, d FROM l", True)
def _(g):
    return T.bfs_parents(_staged(g.knows), 1)


_MS = "+r AS (SELECT id AS src, id AS v, 0 AS d FROM person WHERE id % {m} = 0 UNION SELECT r.src, dst, d + 1 FROM r JOIN knows ON knows.src = v WHERE d < {cap})"


@_p("msbfs_levels", "knows person", _MS.format(m=100, cap=24) + " SELECT src, v, min(d) AS d FROM r GROUP BY src, v", True)
def _(g):
    return T.all_levels(_staged(g.knows), g.person.where("id % 100 = 0").select(F.col("id").alias("v")))


@_p("distance_sum", "knows person", _MS.format(m=100, cap=24) + " SELECT src, sum(d)::BIGINT AS total, count(*) AS reached FROM (SELECT src, v, min(d) AS d FROM r GROUP BY src, v) x GROUP BY src", True)
def _(g):
    return T.distance_sums_from(_staged(g.knows), g.person.where("id % 100 = 0").select(F.col("id").alias("v")))


# every person is a source; keyed recursion keeps one row of a pair
_MS_ALL = "+r(src, v, d) USING KEY (src, v) AS (SELECT id, id, 0 FROM person UNION SELECT r.src, knows.dst, min(r.d) + 1 FROM r JOIN knows ON knows.src = r.v LEFT JOIN recurring.r o ON o.src = r.src AND o.v = knows.dst WHERE o.src IS NULL GROUP BY r.src, knows.dst)"


@_p("msbfs_levels_all", "knows person", _MS_ALL + " SELECT src, v, d FROM r", True)
def _(g):
    return T.all_levels(_staged(g.knows), g.person.select(F.col("id").alias("v")))


@_p("distance_sum_all", "knows person", _MS_ALL + " SELECT src, sum(d)::BIGINT AS total, count(*) AS reached FROM r GROUP BY src", True)
def _(g):
    return T.all_distance_sums(_staged(g.knows), g.person.select(F.col("id").alias("v")))


@_c("bidirectional_distance", "knows", _BFS.format(s=0, e="knows", cap=12) + " SELECT CAST(coalesce((SELECT min(d) FROM r WHERE v = 9), -1) AS BIGINT) AS distance", True)
def _(g):
    return Q.query1(g, 0, 9, -1)




@_p("components", "knows interest", "+e AS (SELECT src, dst FROM knows WHERE src IN (SELECT person FROM interest WHERE tag = 3) AND dst IN (SELECT person FROM interest WHERE tag = 3)), r AS (SELECT src AS v, src AS c FROM e UNION SELECT dst, c FROM r JOIN e ON src = v) SELECT v, min(c) AS component FROM r GROUP BY v", True)
def _(g):
    inner = R.induced(g.knows, _set(g.interest.where("tag = 3"), "person"))
    return connected_components(inner.select(F.col("src").alias("u"), F.col("dst").alias("v")))


@_p("closure_size", "knows interest", "+e AS (SELECT src, dst FROM knows WHERE src IN (SELECT person FROM interest WHERE tag = 3) AND dst IN (SELECT person FROM interest WHERE tag = 3)), r AS (SELECT src AS v, src AS c FROM e UNION SELECT dst, c FROM r JOIN e ON src = v) SELECT component, count(*) AS n FROM (SELECT v, min(c) AS component FROM r GROUP BY v) x GROUP BY component", True)
def _(g):
    inner = R.induced(g.knows, _set(g.interest.where("tag = 3"), "person"))
    parts = connected_components(inner.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    return parts.groupBy("component").agg(F.count("*").alias("n"))


_PLACE = "root AS (SELECT min(id) AS id FROM place WHERE name = '{p}'), inside AS (SELECT id AS v FROM root UNION SELECT child FROM inside JOIN part_of ON parent = v)"
_PERSONS = _PLACE + (
    ", rel AS (SELECT person AS v FROM located WHERE place IN (SELECT v FROM inside) UNION SELECT person FROM work_at WHERE org IN (SELECT id FROM organisation WHERE type = 'Company' AND place IN (SELECT v FROM inside))"
    " UNION SELECT person FROM study_at WHERE org IN (SELECT id FROM organisation WHERE type = 'University' AND place IN (SELECT v FROM inside)))"
)
_TIES = "place part_of located organisation work_at study_at"
_WITHIN = (
    ", hop AS (SELECT v AS src, v, 0 AS d FROM rel UNION SELECT hop.src, dst, d + 1 FROM hop JOIN knows ON knows.src = v WHERE d < {h})"
    ", pairs AS (SELECT DISTINCT hop.src AS a, hop.v AS b FROM hop JOIN rel ON rel.v = hop.v WHERE hop.src < hop.v)"
)


@_p("place_closure", "place part_of", "+" + _PLACE.format(p="EUROPE") + " SELECT v FROM inside", True)
def _(g):
    return T.place_closure(g.place, g.part_of, R.name_lookup(g.place, "EUROPE"))


@_p("relevant_persons", _TIES, "+" + _PERSONS.format(p="EUROPE") + " SELECT v FROM rel", True)
def _(g):
    return Q.place_persons(g, "EUROPE")


@_p("khop_pairs", f"{_TIES} knows", "+" + _PERSONS.format(p="NATION_7") + _WITHIN.format(h=3) + " SELECT a, b FROM pairs", True)
def _(g):
    return T.khop_pairs(_staged(g.knows), _staged(Q.place_persons(g, "NATION_7")), 3)


@_p("khop_pairs_meet", f"{_TIES} knows", "+" + _PERSONS.format(p="NATION_7") + _WITHIN.format(h=3) + " SELECT a, b FROM pairs", True)
def _(g):
    return T.khop_pairs_meet(_staged(g.knows), _staged(Q.place_persons(g, "NATION_7")), 3)


_MEMBERS = "+mem AS (SELECT DISTINCT person AS v FROM forum_member WHERE forum IN (SELECT forum FROM forum_tag WHERE tag = (SELECT min(id) FROM tag WHERE name = '{t}'))), e AS MATERIALIZED (SELECT src, dst FROM knows WHERE src IN (SELECT v FROM mem) AND dst IN (SELECT v FROM mem))"
_CLOSE = _MEMBERS + (
    ", hop AS (SELECT v AS src, v, 0 AS d FROM mem UNION SELECT hop.src, dst, d + 1 FROM hop JOIN e ON e.src = v WHERE d < {cap})"
    ", near AS (SELECT src, v, min(d) AS d FROM hop GROUP BY src, v), sums AS (SELECT src AS v, count(*) - 1 AS reached, sum(d)::BIGINT AS total FROM near GROUP BY src)"
    ", closeness AS (SELECT v, reached, total, CASE WHEN total > 0 THEN CAST(reached * reached AS DOUBLE) / CAST(((SELECT count(*) FROM mem) - 1) * total AS DOUBLE) ELSE 0.0 END AS score FROM sums)"
)


@_p("closeness_bool", "knows forum_tag forum_member tag", _CLOSE.format(t=TAG, cap=30) + " SELECT v, reached, total, score FROM closeness", True)
def _(g):
    return T.closeness(g.knows, Q.tag_members(g, TAG))


@_p("closeness_bits", "knows forum_tag forum_member tag", _CLOSE.format(t=TAG, cap=30) + " SELECT v, reached, total, score FROM closeness", True)
def _(g):
    return T.closeness_bits(g.knows, Q.tag_members(g, TAG))


@_p("closeness_waves", "knows forum_tag forum_member tag", _CLOSE.format(t=TAG, cap=30) + " SELECT v, reached, total, score FROM closeness", True)
def _(g):
    """By rounds over the cluster, in waves of a few words."""
    members = _staged(Q.tag_members(g, TAG))
    n = members.count()
    return T._scores(T.closeness_rounds(_staged(R.induced(g.knows, members)), max(1, n * n // 128)), members, n)


_OVER = _COUNTS + ", over AS (SELECT a.src AS src, a.dst AS dst FROM reply_n a JOIN reply_n b ON a.src = b.dst AND a.dst = b.src SEMI JOIN knows k ON k.src = a.src AND k.dst = a.dst WHERE a.n > {x} AND b.n > {x})"


@_c("overlay_graph", "reply comment knows", "+" + _OVER.format(x=1) + " SELECT src, dst FROM over")
def _(g):
    return R.overlay(g.knows, g.reply, g.comment, 1)


# the four queries


def _q1(name: str, a: int, b: int, x: int) -> None:
    tail = f" SELECT CAST(coalesce((SELECT min(d) FROM r WHERE v = {b}), -1) AS BIGINT) AS distance"
    if x < 0:
        sql = _BFS.format(s=a, e="knows", cap=20)
    else:
        sql = "+" + _OVER.format(x=x) + ", " + _BFS.format(s=a, e="over", cap=20)[1:]
    _c(name, "reply comment knows", sql + tail, True)(lambda g: (Q.query1_on_the_fly if "on_the_fly" in name else Q.query1)(g, a, b, x))


_q1("q1_plain", 0, 14, -1)
_q1("q1_x0", 0, 14, 0)
_q1("q1_x2", 0, 9, 2)
_q1("q1_same_person", 3, 3, 3)
_q1("q1_unreachable", 0, 14, 50)
_q1("q1_on_the_fly", 0, 14, 0)
_q1("q1_on_the_fly_x2", 0, 9, 2)

_Q2 = (
    "+mem AS MATERIALIZED (SELECT tag, person FROM interest JOIN person p ON p.id = interest.person WHERE p.birthday >= DATE '{d}'), "
    "e AS MATERIALIZED (SELECT a.tag AS tag, src, dst FROM knows JOIN mem a ON a.person = src JOIN mem b ON b.person = dst AND a.tag = b.tag), "
    "r AS (SELECT tag, person AS v, person AS c FROM mem UNION SELECT r.tag, dst, c FROM r JOIN e ON e.tag = r.tag AND e.src = r.v AND r.c < e.dst), "
    "best AS (SELECT tag, max(n) AS n FROM (SELECT tag, c, count(*) AS n FROM (SELECT tag, v, min(c) AS c FROM r GROUP BY tag, v) y GROUP BY tag, c) x GROUP BY tag) "
    "SELECT name, coalesce(n, 0) AS score FROM tag LEFT JOIN best ON best.tag = tag.id ORDER BY score DESC, name LIMIT {k}"
)


@_p("q2", "person interest knows tag", _Q2.format(d=DATE, k=5), True)
def _(g):
    return Q.query2(g, 5, DATE)


@_p("q2_zero_fill", "person interest knows tag", _Q2.format(d="2030-01-01", k=4), True)
def _(g):
    return Q.query2(g, 4, "2030-01-01")


_Q3 = " SELECT pairs.a AS a, pairs.b AS b, coalesce(x.n, 0) AS score FROM pairs LEFT JOIN (SELECT p.a, p.b, count(*) AS n FROM pairs p JOIN interest i ON i.person = p.a JOIN interest j ON j.person = p.b AND j.tag = i.tag GROUP BY 1, 2) x ON x.a = pairs.a AND x.b = pairs.b ORDER BY score DESC, a, b LIMIT {k}"


def _q3(name: str, k: int, h: int, place: str) -> None:
    sql = "+" + _PERSONS.format(p=place) + _WITHIN.format(h=h) + _Q3.format(k=k)
    _p(name, f"{_TIES} knows interest", sql, True)(lambda g: (Q.query3_pruned if "pruned" in name else Q.query3)(g, k, h, place))


_q3("q3_continent", 3, 3, "EUROPE")
_q3("q3_country", 3, 3, "NATION_7")
_q3("q3_city", 5, 2, "NATION_7_AUTOMOBILE")
_q3("q3_zero_fill", 50, 2, "NATION_3")
_q3("q3_empty", 3, 0, "NATION_3")
_q3("q3_pruned", 3, 3, "NATION_7")
_q3("q3_pruned_zero_fill", 50, 2, "NATION_3")


@_p("q4", "knows forum_tag forum_member tag", _CLOSE.format(t=TAG, cap=30) + " SELECT v AS person, score FROM closeness ORDER BY score DESC, person LIMIT 5", True)
def _(g):
    return Q.query4(g, 5, TAG)


@_p("q4_small_tag", "knows forum_tag forum_member tag", _CLOSE.format(t="Brand#2", cap=30) + " SELECT v AS person, score FROM closeness ORDER BY score DESC, person LIMIT 3", True)
def _(g):
    return Q.query4(g, 3, "Brand#2")


@_p("result_text", "interest tag", "SELECT string_agg(name, ' ' ORDER BY score DESC, name) AS result FROM (SELECT name, count(*) AS score FROM interest JOIN tag ON tag = id GROUP BY name ORDER BY score DESC, name LIMIT 5) x")
def _(g):
    n = g.interest.groupBy(F.col("tag").alias("id")).agg(F.count("*").alias("score"))
    best = R.top(n.join(g.tag, "id").select("name", "score"), 5, F.desc("score"), "name")
    rows = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "name")))
    return best.agg(F.array_join(F.transform(rows, lambda x: x["name"]), " ").alias("result"))


def _staged(df: DataFrame) -> DataFrame:
    return stage(df, "edges")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)
