"""Two graphs derived from the star-schema test tables; every relation is one SQL select.

The selects run on Spark and, as common table expressions, on any engine that has the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orbweave.plans.graph_queries import Graph

LO = "SELECT o_custkey AS person, l_partkey AS part, l_suppkey AS supp, l_linenumber AS line, l_quantity AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey"

#: name -> (tables and relations it reads, select)
PURCHASE: dict[str, tuple[tuple[str, ...], str]] = {
    "lo": (("lineitem", "orders"), LO),
    "person": (
        ("customer", "orders"),
        "SELECT CAST(c_custkey AS BIGINT) AS id, CAST(min(o_orderdate) AS DATE) AS birthday FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    ),
    "buy": (("lo",), "SELECT DISTINCT person, part FROM lo WHERE line = 1 AND qty >= 31"),
    "knows": (
        ("buy",),
        "SELECT DISTINCT CAST(a.person AS BIGINT) AS src, CAST(b.person AS BIGINT) AS dst FROM buy a JOIN buy b ON a.part = b.part WHERE a.person <> b.person",
    ),
    "tagname": (("part",), "SELECT p_brand AS name FROM part UNION SELECT p_type AS name FROM part"),
    "tag": (("tagname",), "SELECT CAST(dense_rank() OVER (ORDER BY name) AS BIGINT) AS id, name FROM tagname"),
    "parttag": (
        ("part", "tag"),
        "SELECT p_partkey AS part, tag.id AS tag FROM part JOIN tag ON tag.name = p_brand UNION SELECT p_partkey AS part, tag.id AS tag FROM part JOIN tag ON tag.name = p_type",
    ),
    "interest": (
        ("lo", "parttag"),
        "SELECT DISTINCT CAST(lo.person AS BIGINT) AS person, parttag.tag AS tag FROM lo JOIN parttag ON lo.part = parttag.part WHERE line = 3 AND qty >= 21",
    ),
    "forum_tag": (("parttag",), "SELECT DISTINCT CAST(part AS BIGINT) AS forum, tag FROM parttag"),
    "forum_member": (
        ("lo",),
        "SELECT DISTINCT CAST(part AS BIGINT) AS forum, CAST(person AS BIGINT) AS person FROM lo WHERE line = 4",
    ),
    "segment": (("customer",), "SELECT c_mktsegment AS name, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS s FROM (SELECT DISTINCT c_mktsegment FROM customer) x"),
    "place": (
        ("region", "nation", "segment"),
        "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name, 'Continent' AS label FROM region "
        "UNION ALL SELECT CAST(100 + n_nationkey AS BIGINT), n_name, 'Country' FROM nation "
        "UNION ALL SELECT CAST(1000 + 10 * n_nationkey + segment.s AS BIGINT), n_name || '_' || segment.name, 'City' FROM nation CROSS JOIN segment",
    ),
    "part_of": (
        ("nation", "segment"),
        "SELECT CAST(100 + n_nationkey AS BIGINT) AS child, CAST(n_regionkey AS BIGINT) AS parent FROM nation "
        "UNION ALL SELECT CAST(1000 + 10 * n_nationkey + segment.s AS BIGINT), CAST(100 + n_nationkey AS BIGINT) FROM nation CROSS JOIN segment",
    ),
    "located": (
        ("customer", "segment"),
        "SELECT CAST(c_custkey AS BIGINT) AS person, CAST(1000 + 10 * c_nationkey + segment.s AS BIGINT) AS place FROM customer JOIN segment ON c_mktsegment = segment.name",
    ),
    "org_at": (
        ("supplier",),
        "SELECT CAST(s_suppkey AS BIGINT) AS id, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 100 + s_nationkey ELSE 1000 + 10 * s_nationkey + s_suppkey % 5 END AS BIGINT) AS place FROM supplier",
    ),
    "organisation": (
        ("org_at", "place"),
        "SELECT org_at.id AS id, org_at.place AS place, CASE WHEN place.label = 'Country' THEN 'Company' ELSE 'University' END AS type FROM org_at JOIN place ON org_at.place = place.id",
    ),
    "tie": (("lo",), "SELECT DISTINCT CAST(person AS BIGINT) AS person, CAST(supp AS BIGINT) AS org FROM lo WHERE line = 2 AND qty >= 46"),
    "work_at": (("tie", "organisation"), "SELECT person, org FROM tie JOIN organisation ON org = id WHERE type = 'Company'"),
    "study_at": (("tie", "organisation"), "SELECT person, org FROM tie JOIN organisation ON org = id WHERE type = 'University'"),
}

CHAT: dict[str, tuple[tuple[str, ...], str]] = {
    "users": (("events",), "SELECT count(DISTINCT user_id) AS n FROM events"),
    "bucketed": (
        ("events", "users"),
        "SELECT CAST(event_id AS BIGINT) AS id, CAST(user_id AS BIGINT) AS creator, ts, CASE WHEN event_id % 2 = 0 THEN 'r' || CAST(CAST(floor(user_id / 10) AS BIGINT) AS VARCHAR(20)) "
        "ELSE 'c' || CAST(CAST(user_id % greatest(CAST(floor(users.n / 10) AS BIGINT), 1) AS BIGINT) AS VARCHAR(20)) END AS bucket FROM events CROSS JOIN users",
    ),
    "comment": (("bucketed",), "SELECT id, creator FROM bucketed"),
    "reply": (
        ("bucketed",),
        "SELECT child, parent FROM (SELECT id AS child, lag(id) OVER (PARTITION BY bucket ORDER BY ts, id) AS parent FROM bucketed) x WHERE parent IS NOT NULL",
    ),
    "inbucket": (("bucketed",), "SELECT DISTINCT creator, bucket FROM bucketed"),
    "knows": (
        ("inbucket",),
        "SELECT DISTINCT a.creator AS src, b.creator AS dst FROM inbucket a JOIN inbucket b ON a.bucket = b.bucket WHERE a.creator <> b.creator",
    ),
}
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def with_clause(relations: dict, *names: str, recursive: bool = False) -> str:
    """WITH ... of the named relations and what they read, in order."""
    need: set[str] = set()

    def visit(name: str) -> None:
        if name in relations and name not in need:
            for x in relations[name][0]:
                visit(x)
            need.add(name)

    for name in names:
        visit(name)
    body = ",\n".join(f"{name} AS ({relations[name][1]})" for name in relations if name in need)
    return f"WITH {'RECURSIVE ' if recursive else ''}{body}"


def relation(spark: SparkSession, sf_dir: str, relations: dict, name: str) -> DataFrame:
    """A derived relation as a DataFrame; only the tables that it needs are read."""
    done: dict[str, DataFrame] = {}

    def build(key: str) -> DataFrame:
        if key not in done:
            if key in relations:
                inputs, sql = relations[key]
                done[key] = spark.sql(_refer(sql, inputs), **{x: build(x) for x in inputs})
            else:
                done[key] = spark.read.parquet(f"{sf_dir}/{key}.parquet")
        return done[key]

    return build(name)


def _refer(sql: str, names: tuple[str, ...]) -> str:
    """Table names behind FROM and JOIN become references to DataFrames, aliased by their names."""
    import re

    for name in names:
        sql = re.sub(rf"\b(FROM|JOIN) {name}\b(?! [ab] )(?! [ab]\b)", rf"\1 {{{name}}} AS {name}", sql)
        sql = re.sub(rf"\b(FROM|JOIN) {name} ([ab])\b", rf"\1 {{{name}}} AS \2", sql)
    return sql.replace("VARCHAR(20)", "STRING")


class _Lazy(dict):
    def __init__(self, spark: SparkSession, sf_dir: str, relations: dict):
        super().__init__()
        self._args = (spark, sf_dir, relations)

    def __missing__(self, name: str) -> DataFrame:
        spark, sf_dir, relations = self._args
        if name not in relations:
            raise KeyError(name)
        self[name] = relation(spark, sf_dir, relations, name)
        return self[name]

    def get(self, name, default=None):
        try:
            return self[name]
        except KeyError:
            return default


def purchase_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Persons who bought the same part know each other; brands and types are tags, parts are forums."""
    return Graph(_Lazy(spark, sf_dir, PURCHASE))


def chat_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Events are comments that reply to the one before in their bucket; users of a bucket know each other."""
    return Graph(_Lazy(spark, sf_dir, CHAT))


