"""Pipe-separated graph files: scans, validation of edges, and writing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.sources.schema import HEADERS, parse_field, parse_header

#: ``columnPruning`` off: a row is checked whole, also where few of its columns are asked for.
CSV = {"sep": "|", "quote": "", "escape": "", "mode": "FAILFAST", "multiLine": "false", "columnPruning": "false"}
_BOUNDS = {"int": (-(1 << 31), (1 << 31) - 1), "long": (-(1 << 63), (1 << 63) - 1)}


@dataclass(frozen=True)
class Policy:
    """How files are read that don't keep to the catalogue's form.

    ``quote``: a quote sign, doubled inside of quoted fields (none: quotes and backslashes are text).  ``trim``:
    blanks around fields go.  ``comment``: lines that begin with this sign are skipped.  ``missing``: ``error``, or
    ``null`` for columns that a file lacks.  ``extra``: ``ignore``, or ``error`` for columns that aren't asked for.
    ``overflow``: ``error``, ``ignore`` (null) or ``clamp`` for integers out of range; other values that aren't
    integers are errors.  ``max_field``: the longest field in signs (-1: any).
    """

    quote: str = ""
    trim: bool = False
    comment: str = ""
    missing: str = "error"
    extra: str = "ignore"
    overflow: str = "error"
    max_field: int = -1

    def __post_init__(self):
        for name, known in (("missing", ("error", "null")), ("extra", ("ignore", "error")), ("overflow", ("error", "ignore", "clamp"))):
            if getattr(self, name) not in known:
                raise ValueError(f"{name} must be one of {known}")

    def options(self) -> dict[str, str]:
        out = CSV | {"maxCharsPerColumn": str(self.max_field)}
        if self.quote:
            out |= {"quote": self.quote, "escape": self.quote}
        if self.trim:
            out |= {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
        if self.comment:
            out |= {"comment": self.comment}
        return out


PLAIN = Policy()


def read_header(spark: SparkSession, path: str, encoding: str = "UTF-8", policy: Policy = PLAIN) -> list[str]:
    reader = spark.read.options(**policy.options()).option("header", False).option("encoding", encoding)
    # a separator that no header has: the line comes as one field
    rows = reader.option("sep", "\x01").schema("line string").csv(path).limit(1).collect()
    if not rows or rows[0][0] is None:
        raise ValueError(f"{path} has no header")
    names = rows[0][0].removeprefix("\ufeff").rstrip("\r").split("|")
    return [n.strip().strip(policy.quote or " ") for n in names] if policy.trim or policy.quote else names


def _integer(column: str, kind: str, overflow: str):
    """Text of an integer as ``kind``; out of range it is null or the nearest bound."""
    low, high = _BOUNDS[kind]
    text = F.col(column)
    digits = F.length(F.regexp_replace(text, "^[+-]?0*", ""))
    value = F.when(digits <= 30, text.cast("decimal(38,0)"))
    over = F.lit(None) if overflow == "ignore" else F.when(text.startswith("-"), F.lit(low)).otherwise(F.lit(high))
    out = F.when((digits <= 30) & (value >= low) & (value <= high), value.cast(kind)).otherwise(over.cast(kind))
    bad = F.raise_error(F.concat(F.lit(f"{column}: not an integer: "), text)).cast(kind)
    return F.when(text.isNull(), F.lit(None).cast(kind)).when(text.rlike("^[+-]?[0-9]+$"), out).otherwise(bad)


def read_table(
    spark: SparkSession,
    directory: str,
    table: str,
    columns: list[str] | None = None,
    encoding: str = "UTF-8",
    policy: Policy = PLAIN,
) -> DataFrame:
    """One file of the catalogue, its columns resolved by header name (with or without a type suffix).

    By the plain policy quotes and backslashes stay as they are, and columns beyond the asked ones are
    ignored; missing columns, rows of too few or too many fields (whichever columns are asked for), and
    values of a wrong type raise errors.  A column named twice is an error.
    """
    path = f"{directory}/{table}.csv"
    wanted = parse_header(HEADERS[table])
    types = {n: t for n, t, _ in wanted}
    names = [parse_field(x)[0] for x in read_header(spark, path, encoding, policy)]
    ask = columns or [n for n, _, _ in wanted]
    twice = [c for c in names if names.count(c) > 1]
    missing = [c for c in ask if c not in names]
    extra = [c for c in names if c not in types]
    if twice:
        raise ValueError(f"{path} has column {twice[0]!r} twice")
    if missing and policy.missing == "error":
        raise ValueError(f"{path} has no column {missing[0]!r}; its header has {names}")
    if extra and policy.extra == "error":
        raise ValueError(f"{path} has the column {extra[0]!r}, which {table} hasn't")
    loose = {n for n in names if policy.overflow != "error" and types.get(n) in _BOUNDS}
    schema = ", ".join(f"`{n}` {'string' if n in loose else types.get(n, 'string')}" for n in names)
    reader = spark.read.schema(schema).options(**policy.options()).option("header", True).option("enforceSchema", True)
    rows = reader.option("encoding", encoding).csv(path)
    out = []
    for c in ask:
        if c in missing:
            out.append(F.lit(None).cast(types.get(c, "string")).alias(c))
        else:
            out.append((_integer(c, types[c], policy.overflow) if c in loose else F.col(c)).alias(c))
    return rows.select(*out)


def read_edges(
    spark: SparkSession,
    directory: str,
    table: str,
    extra: list[str] | None = None,
    drop_dangling: tuple[DataFrame, DataFrame] | None = None,
    policy: Policy = PLAIN,
) -> DataFrame:
    """The set of (src, dst) of an edge file; parallel duplicates collapse.

    With ``drop_dangling``, the vertices (``id``) at either end, edges to others are left out.
    """
    edges = read_table(spark, directory, table, ["src", "dst", *(extra or [])], policy=policy).distinct()
    return edges if drop_dangling is None else without_dangling(edges, *drop_dangling)


def edge_table(source: str, edge: str, target: str) -> str:
    """The file of an edge kind between two vertex kinds, ``person``, ``knows``, ``person``."""
    table = f"{source}_{edge}_{target}"
    if table not in HEADERS:
        raise ValueError(f"the catalogue has no {table}")
    return table


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(reverse(edges)).distinct()


def without_dangling(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges whose ends are both vertices (``id``)."""
    kept = edges.join(sources.select(F.col("id").alias("src")), "src", "left_semi")
    return kept.join(targets.select(F.col("id").alias("dst")), "dst", "left_semi").select(*edges.columns)


def validate_edges(edges: DataFrame, sources: DataFrame, targets: DataFrame, name: str = "edges") -> DataFrame:
    """``edges``, or an error that names a dangling end."""
    for end, vertices in (("src", sources), ("dst", targets)):
        lost = edges.join(vertices.select(F.col("id").alias(end)), end, "left_anti").take(1)
        if lost:
            raise ValueError(f"{name}: {end} {lost[0][end]} is not a vertex")
    return edges


def organisation_type(places: DataFrame, located: DataFrame) -> DataFrame:
    """(id, place, type): organisations in a country are companies, others universities."""
    at = places.select(F.col("id").alias("place"), "label")
    kind = F.when(F.col("label") == "Country", "Company").otherwise("University")
    return located.join(at, "place").select("id", "place", kind.alias("type"))


def write_table(df: DataFrame, directory: str, table: str) -> None:
    """Write in the catalogue's format, labels in title case, as a folder ``<table>.csv``."""
    names = [n for n, _, _ in parse_header(HEADERS[table])]
    out = df.select(*names)
    if "label" in names:
        out = out.withColumn("label", F.initcap("label"))
    fields = dict(zip(names, HEADERS[table].split("|"), strict=True))
    out = out.select(*(F.col(n).alias(fields[n]) for n in names))
    out.write.mode("overwrite").options(sep="|", quote="", escape="", header=True, emptyValue="", nullValue="").csv(
        f"{directory}/{table}.csv"
    )


def convert(spark: SparkSession, source: str, target: str, tables: list[str] | None = None, encoding: str = "UTF-8") -> None:
    """Read raw files of any encoding and header, write them as UTF-8 with the catalogue's headers."""
    for table in tables or list(HEADERS):
        names = [n for n, _, _ in parse_header(HEADERS[table])]
        raw = spark.read.options(**CSV).option("header", True).option("encoding", encoding).csv(f"{source}/{table}.csv")
        write_table(raw.toDF(*names[: len(raw.columns)]), target, table)
