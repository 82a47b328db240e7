"""The catalogue of the social graph's files and its header grammar (fixed values)."""

from __future__ import annotations

import re

#: file -> header; ``name:TYPE``, ``id:ID(Label)``, ``:START_ID(Label)``, ``:END_ID(Label)``, ``:LABEL``.
HEADERS = {
    "comment": "id:ID(Comment)|creationDate:DATETIME|locationIP:STRING|browserUsed:STRING|content:STRING",
    "comment_hasCreator_person": ":START_ID(Comment)|:END_ID(Person)",
    "comment_isLocatedIn_place": ":START_ID(Comment)|:END_ID(Place)",
    "comment_replyOf_comment": ":START_ID(Comment)|:END_ID(Comment)",
    "forum": "id:ID(Forum)|title:STRING|creationDate:DATETIME",
    "forum_hasMember_person": ":START_ID(Forum)|:END_ID(Person)|joinDate:DATETIME",
    "forum_hasTag_tag": ":START_ID(Forum)|:END_ID(Tag)",
    "organisation": "id:ID(Organisation)|:LABEL|name:STRING|url:STRING",
    "organisation_isLocatedIn_place": ":START_ID(Organisation)|:END_ID(Place)",
    "person": "id:ID(Person)|firstName:STRING|lastName:STRING|gender:STRING|birthday:DATE|creationDate:DATETIME"
    "|locationIP:STRING|browserUsed:STRING",
    "person_hasInterest_tag": ":START_ID(Person)|:END_ID(Tag)",
    "person_isLocatedIn_place": ":START_ID(Person)|:END_ID(Place)",
    "person_knows_person": ":START_ID(Person)|:END_ID(Person)",
    "person_studyAt_organisation": ":START_ID(Person)|:END_ID(Organisation)|classYear:LONG",
    "person_workAt_organisation": ":START_ID(Person)|:END_ID(Organisation)|workFrom:LONG",
    "place": "id:ID(Place)|name:STRING|url:STRING|:LABEL",
    "place_isPartOf_place": ":START_ID(Place)|:END_ID(Place)",
    "tag": "id:ID(Tag)|name:STRING|url:STRING",
}
TYPES = {"STRING": "string", "LONG": "long", "INT": "int", "DATE": "date", "DATETIME": "timestamp", "DOUBLE": "double"}
_FIELD = re.compile(r"(?P<name>[^:]*)(?::(?P<kind>[A-Z_]+)(?:\((?P<label>[^)]*)\))?)?\Z")


def parse_field(field: str) -> tuple[str, str, str | None]:
    """(column name, Spark type, vertex label or None) of one header field."""
    m = _FIELD.match(field)
    if not m:
        raise ValueError(f"header field {field!r} can't be read")
    name, kind, label = m["name"], m["kind"] or "STRING", m["label"]
    if kind == "ID":
        return name or "id", "long", label
    if kind == "START_ID":
        return name or "src", "long", label
    if kind == "END_ID":
        return name or "dst", "long", label
    if kind == "LABEL":
        return name or "label", "string", None
    if kind not in TYPES:
        raise ValueError(f"unknown type in header field {field!r}")
    return name, TYPES[kind], None


def parse_header(header: str) -> list[tuple[str, str, str | None]]:
    return [parse_field(x) for x in header.split("|")]


def schema_of(table: str) -> str:
    return ", ".join(f"`{n}` {t}" for n, t, _ in parse_header(HEADERS[table]))
