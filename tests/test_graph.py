"""The micro-graph with hand-computed answers, and file edge cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from orbweave.functions.text import parse_query, parse_row, result_text, sample_parameters
from orbweave.operators import traverse
from orbweave.operators.components import connected_components
from orbweave.plans.graph_queries import Graph, query1, query2, query3, query4
from orbweave.sources.files import convert, read_edges, read_table, symmetric, validate_edges, without_dangling
from orbweave.sources.schema import HEADERS, parse_field, schema_of


@pytest.fixture(scope="module")
def graph(spark):
    make = lambda rows, cols: spark.createDataFrame(rows, cols)
    born = {1: "1980-01-01", 2: "1985-05-05", 3: "1985-05-05", 4: "1990-01-01", 5: "1970-01-01", 6: "1988-08-08", 7: "1982-02-02", 8: "1991-01-01", 9: "1992-02-02"}
    interest = {1: [1, 2], 2: [1, 2], 3: [1], 4: [2, 3], 5: [2], 6: [1, 3], 7: [3], 8: [3]}
    replies = {(1, 2): 3, (2, 1): 2, (2, 3): 1, (3, 2): 1, (3, 4): 2, (4, 3): 1, (4, 5): 1, (1, 6): 1, (6, 1): 1, (6, 5): 2, (5, 6): 2, (1, 4): 5, (4, 1): 5}
    comment, reply, n = [], [], 0
    for (a, b), times in replies.items():
        for _ in range(times):
            comment += [(n, a), (n + 1, b)]
            reply.append((n, n + 1))
            n += 2
    knows = [(1, 2), (2, 3), (3, 4), (4, 5), (1, 6), (6, 5), (7, 8)]
    return Graph(
        {
            "person": make([(p, dt.date.fromisoformat(d)) for p, d in born.items()], "id long, birthday date"),
            "knows": make(knows + [(b, a) for a, b in knows], "src long, dst long"),
            "tag": make([(1, "Alpha"), (2, "Beta"), (3, "Gamma"), (4, '"Delta"')], "id long, name string"),
            "interest": make([(p, t) for p, ts in interest.items() for t in ts], "person long, tag long"),
            "place": make(
                [(1, "Land", "Continent"), (2, "North", "Country"), (3, "South", "Country"), (4, "N1", "City"), (5, "N2", "City"), (6, "S1", "City")],
                "id long, name string, label string",
            ),
            "part_of": make([(2, 1), (3, 1), (4, 2), (5, 2), (6, 3)], "child long, parent long"),
            "located": make([(1, 4), (2, 4), (3, 5), (4, 6), (5, 6), (6, 6), (7, 5), (8, 6), (9, 4)], "person long, place long"),
            "organisation": make([(1, 2, "Company"), (2, 3, "Company"), (3, 4, "University"), (4, 6, "University")], "id long, place long, type string"),
            "work_at": make([(4, 1), (5, 2)], "person long, org long"),
            "study_at": make([(6, 3), (8, 4)], "person long, org long"),
            "comment": make(comment, "id long, creator long"),
            "reply": make(reply, "child long, parent long"),
            "forum_tag": make([(1, 1), (2, 1), (2, 3), (3, 4)], "forum long, tag long"),
            "forum_member": make([(1, 1), (1, 2), (1, 3), (1, 9), (2, 4), (2, 7), (3, 5)], "forum long, person long"),
        }
    )


@pytest.mark.parametrize(
    "a,b,x,want",
    [(1, 4, -1, 3), (1, 4, 0, 3), (1, 5, 0, 2), (3, 6, 0, 3), (1, 2, 1, 1), (1, 3, 1, -1), (6, 5, 1, 1), (6, 5, 2, -1), (2, 5, 0, 3), (1, 7, -1, -1), (9, 9, 3, 0)],
)
def test_query1(graph, a, b, x, want):
    assert query1(graph, a, b, x).first()[0] == want


@pytest.mark.parametrize(
    "since,want",
    [
        ("1960-01-01", [("Alpha", 4), ("Beta", 2), ("Gamma", 2), ('"Delta"', 0)]),
        ("1985-05-05", [("Alpha", 2), ("Beta", 1), ("Gamma", 1), ('"Delta"', 0)]),
        ("2000-01-01", [('"Delta"', 0), ("Alpha", 0), ("Beta", 0), ("Gamma", 0)]),
    ],
)
def test_query2(graph, since, want):
    assert [tuple(r) for r in query2(graph, 4, since).collect()] == want


@pytest.mark.parametrize(
    "k,h,place,want",
    [
        (3, 1, "Land", [(1, 2, 2), (1, 6, 1), (2, 3, 1)]),
        (5, 3, "North", [(1, 2, 2), (1, 3, 1), (1, 4, 1), (1, 6, 1), (2, 3, 1)]),
        (3, 2, "South", [(4, 5, 1), (4, 6, 1), (5, 6, 0)]),
        (3, 2, "N1", [(1, 2, 2), (1, 6, 1), (2, 6, 1)]),
        (3, 3, "N2", []),
    ],
)
def test_query3(graph, k, h, place, want):
    assert [tuple(r) for r in query3(graph, k, h, place).collect()] == want


@pytest.mark.parametrize(
    "k,tag,want",
    [
        (9, "Alpha", [(2, 0.45), (3, 0.45), (1, 0.3), (4, 0.3), (7, 0.0), (9, 0.0)]),
        (5, "Gamma", [(4, 0.0), (7, 0.0)]),
        (3, '"Delta"', [(5, 0.0)]),
        (3, "Beta", []),
    ],
)
def test_query4(graph, k, tag, want):
    assert [(r[0], round(r[1], 12)) for r in query4(graph, k, tag).collect()] == want


def test_unknown_place_raises(graph):
    with pytest.raises(LookupError):
        query3(graph, 3, 2, "Nowhere")


def test_components_of_a_long_path(spark):
    edges = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).union(spark.createDataFrame([(900, 900)], "u long, v long"))
    found = dict(connected_components(edges).collect())
    assert found == {**dict.fromkeys(range(301), 0), 900: 900}


def test_traversals_agree(graph):
    members = graph.person.select(F.col("id").alias("v"))
    a = {tuple(r) for r in traverse.closeness(graph.knows, members).collect()}
    assert a == {tuple(r) for r in traverse.closeness_bits(graph.knows, members).collect()}
    for h in (1, 2, 3, 4):
        plain = {tuple(r) for r in traverse.khop_pairs(graph.knows, members, h).collect()}
        assert plain == {tuple(r) for r in traverse.khop_pairs_meet(graph.knows, members, h).collect()}
    assert {tuple(r) for r in traverse.bfs_parents(graph.knows, 1).collect()} == {(1, 1, 0), (2, 1, 1), (6, 1, 1), (3, 2, 2), (5, 6, 2), (4, 3, 3)}


def test_files(spark, tmp_path):
    d = str(tmp_path)
    (tmp_path / "tag.csv").write_bytes('﻿id:ID(Tag)|name|url:STRING\r\n1|"quoted"|u\r\n2|Robert_John_\\"Mutt\\"_Lange|'.encode())
    rows = {tuple(r) for r in read_table(spark, d, "tag", ["id", "name"]).collect()}
    assert rows == {(1, '"quoted"'), (2, 'Robert_John_\\"Mutt\\"_Lange')}
    (tmp_path / "person_knows_person.csv").write_text(":START_ID(Person)|:END_ID(Person)|more\n1|2|x\n1|2|y\n2|9|z\n")
    edges = read_edges(spark, d, "person_knows_person")
    assert sorted(map(tuple, edges.collect())) == [(1, 2), (2, 9)]
    people = spark.createDataFrame([(1,), (2,)], "id long")
    with pytest.raises(ValueError, match="9"):
        validate_edges(edges, people, people)
    assert without_dangling(edges, people, people).count() == 1 and symmetric(edges).count() == 4
    (tmp_path / "forum_hasTag_tag.csv").write_text(":START_ID(Forum)|:END_ID(Tag)\n1|x\n")
    with pytest.raises(Exception):
        read_edges(spark, d, "forum_hasTag_tag").collect()
    with pytest.raises(ValueError):
        read_table(spark, d, "person_knows_person", ["src", "nothing"])
    (tmp_path / "place.csv").write_bytes("a|b|c|d\n1|Zürich|u|CITY\n".encode("latin-1"))
    convert(spark, d, f"{d}/out", ["place"], "ISO-8859-1")
    assert [tuple(r) for r in read_table(spark, f"{d}/out", "place").collect()] == [(1, "Zürich", "u", "City")]


def test_text():
    assert parse_field(":START_ID(Person)") == ("src", "long", "Person") and "birthday` date" in schema_of("person")
    assert len(HEADERS) == 18
    assert parse_query("query3(4, 6, A, (b) c) % 1|2") == (3, [4, 6, "A, (b) c"]) and parse_query("x") is None
    assert parse_row(4, "4|You_Make_Me_Wanna...") == [4, "You_Make_Me_Wanna..."]
    rows = sample_parameters(1, 20, [1, 2, 3], [], [], [])
    assert rows == sample_parameters(1, 20, [1, 2, 3], [], [], []) and all(a != b and -1 <= x <= 3 for a, b, x in rows)


def test_result_text(graph):
    assert result_text(query3(graph, 2, 2, "South"), 3) == ("4|5 4|6", "1 1")
    assert result_text(query1(graph, 1, 4, -1), 1) == ("3", "")
