"""Command line, by ``spark-submit orbweave/cli.py``.

``DIRECTORY QUERY PARAMETER...``, ``DIRECTORY FILE params.txt [QUERY]`` (lines ``queryN(a, b) % expected``),
``DIRECTORY TEST params.txt [QUERY]`` (the same, and an error if a result differs from an expected one),
``DIRECTORY ROWS QUERY params.csv [COUNT]`` (the first COUNT rows ``a|b``, 100 if not told).
Without arguments the environment tells: CsvPath, ParamsPath and Query; Tool, ChangeSet and RunIndex then
stand before each line of output.
"""

from __future__ import annotations

import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from orbweave.functions.text import KINDS, parse_case, parse_row, result_text, same_result
from orbweave.plans.graph_queries import Graph, query1, query2, query3, query4
from orbweave.sources.files import organisation_type, read_edges, read_table, symmetric

#: Parameter rows of a benchmark run.
ROWS = 100
RUN = {1: query1, 2: query2, 3: query3, 4: query4}


def load(spark: SparkSession, directory: str) -> Graph:
    """The graph of a directory of catalogue files; Spark reads what a query uses."""
    edge = lambda t, a, b: read_edges(spark, directory, t).select(F.col("src").alias(a), F.col("dst").alias(b))
    places = read_table(spark, directory, "place", ["id", "name", "label"])
    return Graph(
        {
            "person": read_table(spark, directory, "person", ["id", "birthday"]),
            "knows": symmetric(read_edges(spark, directory, "person_knows_person")),
            "tag": read_table(spark, directory, "tag", ["id", "name"]),
            "interest": edge("person_hasInterest_tag", "person", "tag"),
            "place": places,
            "part_of": edge("place_isPartOf_place", "child", "parent"),
            "located": edge("person_isLocatedIn_place", "person", "place"),
            "organisation": organisation_type(places, edge("organisation_isLocatedIn_place", "id", "place")),
            "work_at": edge("person_workAt_organisation", "person", "org"),
            "study_at": edge("person_studyAt_organisation", "person", "org"),
            "comment": edge("comment_hasCreator_person", "id", "creator"),
            "reply": edge("comment_replyOf_comment", "child", "parent"),
            "forum_tag": edge("forum_hasTag_tag", "forum", "tag"),
            "forum_member": edge("forum_hasMember_person", "forum", "person"),
        }
    )


def calls_of(args: list[str]) -> list[tuple[int, list, str | None]]:
    """(query, parameters, expected result or None) of what the command line asks for."""
    kind, *rest = args
    if kind in ("FILE", "TEST"):
        cases = [c for c in map(parse_case, open(rest[0], encoding="utf-8")) if c]
        return [c for c in cases if len(rest) < 2 or c[0] == int(rest[1])]
    if kind == "ROWS":
        n, count = int(rest[0]), int(rest[2]) if len(rest) > 2 else ROWS
        lines = [x for x in open(rest[1], encoding="utf-8") if x.strip()]
        return [(n, parse_row(n, x), None) for x in lines[:count]]
    n = int(kind)
    return [(n, [f(x) for f, x in zip(KINDS[n], rest, strict=True)], None)]


def from_environment(env) -> list[str]:
    """The arguments that the environment stands for."""
    lacking = [k for k in ("CsvPath", "ParamsPath", "Query") if k not in env]
    if lacking:
        raise SystemExit(f"{__doc__}\nnot set: {', '.join(lacking)}")
    n = env["Query"].lower().removeprefix("query").removeprefix("q")
    return [env["CsvPath"], "ROWS", n, f"{env['ParamsPath']}/query{n}.csv"]


def main(argv: list[str] | None = None) -> None:
    told = list(sys.argv[1:] if argv is None else argv)
    mark = "" if told else "".join(f"{os.environ[k]}," for k in ("Tool", "ChangeSet", "RunIndex") if k in os.environ)
    directory, *args = told or from_environment(os.environ)
    if not args:
        raise SystemExit(__doc__)
    calls = calls_of(args)
    spark = SparkSession.builder.appName("orbweave").getOrCreate()
    began = time.time()
    graph = load(spark, directory)
    loaded = time.time() - began
    wrong = 0
    for n, parameters, expected in calls:
        began = time.time()
        result, comment = result_text(RUN[n](graph, *parameters), n)
        print(f"{mark}q{n},{loaded * 1e6:.0f},{(time.time() - began) * 1e6:.0f},{result},{comment}")
        if expected is not None and args[0] == "TEST" and not same_result(n, result, expected):
            wrong += 1
            print(f"query{n}{tuple(parameters)}: {result!r}, expected {expected!r}", file=sys.stderr)
    if wrong:
        raise SystemExit(f"{wrong} of {len(calls)} results differ")


if __name__ == "__main__":
    main()
