"""Reader policies, rows of a wrong length, parameter files and the command line."""

import pytest
from parity import compare, connection
from pyspark.sql import functions as F

from orbweave import cli
from orbweave.functions.text import generate_parameters, parameter_rows, parse_case, parse_query, same_result, write_parameters
from orbweave.plans import catalog
from orbweave.sources.files import Policy, edge_table, read_edges, read_table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("row", ["2|b", "3|c|u|extra|more"])
def test_rows_of_a_wrong_length_raise_whatever_is_asked_for(spark, tmp_path, row):
    (tmp_path / "tag.csv").write_text(f"id:ID(Tag)|name:STRING|url:STRING\n1|a|u\n{row}\n")
    for columns in (None, ["id"], ["name"], ["id", "url"]):
        with pytest.raises(Exception, match="MALFORMED|Malformed"):
            read_table(spark, str(tmp_path), "tag", columns).collect()


def test_policies(spark, tmp_path):
    d = str(tmp_path)
    (tmp_path / "tag.csv").write_text('id:ID(Tag)|name:STRING|more\n# skipped\n 7 | "a|""b" |x\n99999999999999999999|c|\n-99999999999999999999|d|\n')
    read = lambda **k: [tuple(r) for r in read_table(spark, d, "tag", ["id", "name"], policy=Policy(quote='"', trim=True, comment="#", **k)).collect()]
    assert read(overflow="clamp") == [(7, 'a|"b'), (2**63 - 1, "c"), (-(2**63), "d")]
    assert read(overflow="ignore") == [(7, 'a|"b'), (None, "c"), (None, "d")]
    with pytest.raises(Exception):
        read()
    with pytest.raises(ValueError, match="more"):
        read(overflow="clamp", extra="error")
    with pytest.raises(ValueError, match="url"):
        read_table(spark, d, "tag", policy=Policy(trim=True))
    loose = Policy(quote='"', trim=True, comment="#", missing="null", overflow="clamp")
    assert [r.url for r in read_table(spark, d, "tag", policy=loose).collect()] == [None] * 3
    (tmp_path / "tag.csv").write_text("id:ID(Tag)|name|url\n1x|a|u\n")
    with pytest.raises(Exception, match="not an integer"):
        read_table(spark, d, "tag", policy=Policy(overflow="clamp")).collect()
    (tmp_path / "tag.csv").write_text("id:ID(Tag)|name|name\n1|a|u\n")
    with pytest.raises(ValueError, match="twice"):
        read_table(spark, d, "tag", ["id"])
    with pytest.raises(Exception):
        (tmp_path / "tag.csv").write_text("id:ID(Tag)|name|url\n1|abcdef|u\n")
        read_table(spark, d, "tag", policy=Policy(max_field=3)).collect()
    with pytest.raises(ValueError):
        Policy(overflow="wrap")


def test_header_in_another_encoding(spark, tmp_path):
    (tmp_path / "tag.csv").write_bytes("id:ID(Tag)|größe|name\n1|x|é\n".encode("latin-1"))
    assert read_table(spark, str(tmp_path), "tag", ["größe", "name"], "ISO-8859-1").first() == ("x", "é")


def test_edges_without_dangling_ends(spark, tmp_path):
    table = edge_table("person", "knows", "person")
    (tmp_path / f"{table}.csv").write_text(":START_ID(Person)|:END_ID(Person)\n1|2\n1|2\n2|9\n")
    people = spark.createDataFrame([(1,), (2,)], "id long")
    assert read_edges(spark, str(tmp_path), table, drop_dangling=(people, people)).collect() == [(1, 2)]
    with pytest.raises(ValueError):
        edge_table("person", "eats", "tag")


def test_parameter_text():
    assert parse_case("query1(1, 2, -1) % 3") == (1, [1, 2, -1], "3")
    assert parse_case("query2(4, 1990-01-02)") == (2, [4, "1990-01-02"], None)
    assert parse_case("nothing") is None
    assert same_result(1, "3 x", "3") and not same_result(1, "3", "4") and same_result(2, "a  b", "a b")
    lines, calls = parameter_rows(3, [(3, 2, "A, b")])
    assert lines == ["3|2|A, b"] and parse_query(calls[0]) == (3, [3, 2, "A, b"])


def test_generated_parameters(spark, tmp_path):
    persons = spark.createDataFrame([(i, f"19{i % 90 + 10}-01-01") for i in range(40)] + [(99, None)], "id long, birthday string")
    names = spark.createDataFrame([("A",), ("B, c",)], "name string")
    for q in (1, 2, 3, 4):
        rows = generate_parameters(q, 60, persons, names, names, seed=5)
        first = rows.orderBy("row").collect()
        assert first == generate_parameters(q, 60, persons, names, names, seed=5).orderBy("row").collect()
        assert len(first) >= 38 and all(parse_query(r.call)[0] == q for r in first)
        if q == 1:
            assert all(a != b and -1 <= x <= 3 for a, b, x in (parse_query(r.call)[1] for r in first))
        write_parameters(rows, str(tmp_path), q)
        assert [r[0] for r in spark.read.text(f"{tmp_path}/query{q}.csv").collect()] == [r.line for r in first]
    assert generate_parameters(4, 5, persons, names, names.where("false")).count() == 0


def test_command_line(tmp_path):
    (tmp_path / "p.txt").write_text("query1(1, 2, -1) % 1\n\nquery4(3, Tag) % 7 8\n")
    (tmp_path / "query2.csv").write_text("3|1990-01-01\n4|1991-01-01\n5|1992-01-01\n")
    assert cli.calls_of(["FILE", f"{tmp_path}/p.txt"]) == [(1, [1, 2, -1], "1"), (4, [3, "Tag"], "7 8")]
    assert cli.calls_of(["TEST", f"{tmp_path}/p.txt", "4"]) == [(4, [3, "Tag"], "7 8")]
    assert cli.calls_of(["3", "2", "4", "Asia"]) == [(3, [2, 4, "Asia"], None)]
    told = cli.from_environment({"CsvPath": "d", "ParamsPath": str(tmp_path), "Query": "Query2"})
    assert told[0] == "d" and len(cli.calls_of(told[1:])) == 3 and len(cli.calls_of([*told[1:], "2"])) == 2
    with pytest.raises(SystemExit, match="ParamsPath"):
        cli.from_environment({"CsvPath": "d"})


def test_command_line_runs_against_expected_results(spark, tmp_path, capsys):
    files = {
        "person": "id:ID(Person)|birthday:DATE\n1|1990-01-01\n2|1991-01-01\n3|1992-01-01\n",
        "person_knows_person": ":START_ID(Person)|:END_ID(Person)\n1|2\n2|3\n",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text)
    heads = {"tag": "id|name", "place": "id|name|:LABEL"}
    from orbweave.sources.schema import HEADERS

    for name, head in HEADERS.items():
        if name not in files:
            (tmp_path / f"{name}.csv").write_text(heads.get(name, head) + "\n")
    (tmp_path / "p.txt").write_text("query1(1, 3, -1) % 2\n")
    cli.main([str(tmp_path), "TEST", f"{tmp_path}/p.txt"])
    assert capsys.readouterr().out.splitlines()[-1].split(",")[::3] == ["q1", "2"]
    (tmp_path / "p.txt").write_text("query1(1, 3, -1) % 5\n")
    with pytest.raises(SystemExit):
        cli.main([str(tmp_path), "TEST", f"{tmp_path}/p.txt"])


@pytest.mark.parametrize("name", ["csv_vertices", "csv_edges", "csv_convert", "csv_policies", "saturated_words", "q1_on_the_fly"])
def test_rows_equal_sql(spark, name):
    assert not compare(spark, connection(SF), name, catalog.queries()[name], catalog.oracle_sql()[name], SF)
