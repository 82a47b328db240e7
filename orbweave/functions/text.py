"""Parameter text, result text, and scalar helpers."""

from __future__ import annotations

import random
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_QUERY = re.compile(r"query([1-4])\((.*)\)[^)]*\Z", re.S)
KINDS = {1: (int, int, int), 2: (int, str), 3: (int, int, str), 4: (int, str)}


def parse_query(line: str) -> tuple[int, list] | None:
    """(query, parameters) of ``queryN(a, b, c)``; text behind the last bracket is ignored."""
    m = _QUERY.match(line.strip())
    if not m:
        return None
    n = int(m[1])
    parts = m[2].split(", ", len(KINDS[n]) - 1)
    return n, [f(x.strip()) for f, x in zip(KINDS[n], parts, strict=True)]


def parse_case(line: str) -> tuple[int, list, str | None] | None:
    """(query, parameters, expected result or None) of ``queryN(a, b, c) % result``; blank lines and others give None."""
    call = parse_query(line)
    if call is None:
        return None
    tail = line.strip()[line.strip().rindex(")") + 1 :].strip()
    return *call, tail.removeprefix("%").strip() or None


def same_result(query: int, got: str, want: str) -> bool:
    """Whether a result text is the expected one; of query 1 only the number counts, blanks never do."""
    a, b = got.split(), want.split()
    return int(a[0]) == int(b[0]) if query == 1 and a and b else a == b


def parse_row(query: int, line: str) -> list:
    """Parameters of a row ``a|b|c``."""
    return [f(x.strip()) for f, x in zip(KINDS[query], line.rstrip("\r\n").split("|"), strict=True)]


def query_columns(text: Column) -> list[Column]:
    """query and its first parameter text of a column of such lines, in Spark."""
    return [
        F.regexp_extract(text, r"query([1-4])\(", 1).cast("int").alias("query"),
        F.split(F.regexp_extract(text, r"\((.*)\)[^)]*$", 1), ", ").alias("params"),
    ]


def result_text(df: DataFrame, query: int) -> tuple[str, str]:
    """(result, comment) of a query's rows: names, pairs ``a|b`` or ids joined by blanks, and the scores."""
    rows = df.collect()
    if query == 1:
        return str(rows[0]["distance"]), ""
    if query == 2:
        return " ".join(r["name"] for r in rows), " ".join(str(r["score"]) for r in rows)
    if query == 3:
        return " ".join(f"{r['a']}|{r['b']}" for r in rows), " ".join(str(r["score"]) for r in rows)
    return " ".join(str(r["person"]) for r in rows), " ".join(f"{r['score']:.6f}" for r in rows)


def parameter_rows(query: int, rows: list[tuple]) -> tuple[list[str], list[str]]:
    """The lines of a parameter file of either form: ``a|b|c``, and ``queryN(a, b, c)``."""
    texts = [[str(x) for x in row] for row in rows]
    return ["|".join(x) for x in texts], [f"query{query}({', '.join(x)})" for x in texts]


def generate_parameters(query: int, n: int, persons: DataFrame, places: DataFrame, tags: DataFrame, seed: int = 1) -> DataFrame:
    """(row, line, call): n parameter rows, drawn from ``persons(id, birthday)``, ``places(name)`` and ``tags(name)``.

    The i-th draw of a kind is its i-th vertex in an order by hash and seed, again from the start when
    all are used; numbers follow from hashes too, in the ranges of ``sample_parameters``.  Persons and
    dates never come to the driver.  Nulls aren't drawn; without vertices there are no rows.
    """
    spark = persons.sparkSession

    def draw(df: DataFrame, column: str, name: str, salt: int, count: int) -> DataFrame:
        order = F.xxhash64(F.lit(seed * 100 + query * 10 + salt), F.col(column))
        picked = df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(order, column).limit(count)
        rank = F.row_number().over(Window.orderBy(order, column)) - 1  # of ``count`` rows at most
        ranked = picked.select(F.col(column).cast("string").alias(name), rank.alias("at"), F.count("*").over(Window.partitionBy()).alias("of"))
        rows = spark.range(count).select(F.col("id").alias("row"))
        return rows.join(ranked, F.expr("pmod(row, of) = at")).select("row", name)

    def number(name: str, low: int, high: int, salt: int):
        return (F.lit(low) + F.pmod(F.xxhash64(F.lit(seed * 100 + query * 10 + salt), "row"), F.lit(high - low + 1))).cast("string").alias(name)

    if query == 1:
        # neighbours in the order by hash are two different persons
        ends = draw(persons, "id", "p", 1, n + 1)
        rows = ends.where(f"row < {n}").join(ends.select((F.col("row") - 1).alias("row"), F.col("p").alias("q")), "row").where("p <> q")
        parts = [F.col("p"), F.col("q"), number("x", -1, 3, 2)]
    elif query == 2:
        rows = draw(persons, "birthday", "d", 1, n)
        parts = [number("k", 3, 7, 2), F.col("d")]
    elif query == 3:
        rows = draw(places, "name", "p", 1, n)
        parts = [number("k", 3, 7, 2), number("h", 2, 6, 3), F.col("p")]
    else:
        rows = draw(tags, "name", "t", 1, n)
        parts = [number("k", 3, 7, 2), F.col("t")]
    call = F.concat(F.lit(f"query{query}("), F.concat_ws(", ", *parts), F.lit(")"))
    return rows.select("row", F.concat_ws("|", *parts).alias("line"), call.alias("call"))


def write_parameters(rows: DataFrame, directory: str, query: int) -> None:
    """Folders ``query<N>.csv`` and ``query<N>.txt`` of what ``generate_parameters`` gives, in its order."""
    for column, kind in (("line", "csv"), ("call", "txt")):
        rows.orderBy("row").select(column).coalesce(1).write.mode("overwrite").text(f"{directory}/query{query}.{kind}")


def sample_parameters(query: int, n: int, persons: list[int], dates: list[str], places: list[str], tags: list[str], seed: int = 1) -> list[tuple]:
    """n seeded parameter rows in the ranges of the benchmark: x -1..3, k 3..7, h 2..6, two different persons."""
    rng = random.Random(f"{seed}:{query}")
    out = []
    for _ in range(n):
        if query == 1:
            a, b = rng.sample(persons, 2)
            out.append((a, b, rng.randint(-1, 3)))
        elif query == 2:
            out.append((rng.randint(3, 7), rng.choice(dates)))
        elif query == 3:
            out.append((rng.randint(3, 7), rng.randint(2, 6), rng.choice(places)))
        else:
            out.append((rng.randint(3, 7), rng.choice(tags)))
    return out
