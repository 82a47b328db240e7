"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders; windows of the resulting template tokens are
hash-joined between benchmark items and documents.  For documents that share enough windows of an
item, the values behind the placeholders are compared: equal values are a verbatim leak, values that
differ by a consistent renaming are a re-parameterised question, anything else is chance.  Items that
such windows can't find (short ones, and those made of numbers or names) are searched word for word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.textbytes import (
    chunks,
    mix,
    prefix_sums,
    text_column,
    tidied,
    word_hashes,
    words,
)
from orbweave.session import stage

WINDOW = 8
#: The share of an item's windows that a document must have, in percent, and the least count.
COVER_PERCENT, MIN_WINDOWS = 50, 3
#: So many windows of an item (RUN_WINDOWS + 7 tokens in a row) are enough, whatever its length.
RUN_WINDOWS = 24
#: Benchmarks of up to so many distinct windows are broadcast (16 bytes each); larger ones are joined by a shuffle.
BROADCAST_WINDOWS = 1_000_000
#: Units that stand for one placeholder.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres "
    "g kg mg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons "
    "s ms sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "l ml liter liters litre litres gallon gallons c f k degrees percent dollar dollars euro euros cent cents "
    "mph kmh kph w kw v a hz khz mhz ghz b kb mb gb tb"
).split()

NUMBER, NAME, UNIT = np.uint64(0x1111111111111111), np.uint64(0x2222222222222222), np.uint64(0x3333333333333333)
_ROLE = np.zeros(256, np.uint8)
_ROLE[[*range(48, 58)]] = 1  # digit
_ROLE[[*range(65, 91)]] = 2  # capital
_ROLE[[*range(97, 123), *range(128, 256)]] = 4  # other letter
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:\n"]] = True
#: First two bytes (UTF-8) of characters of scripts without spaces, each a token of its own: Thai, Lao, Burmese, Khmer,
#: U+3000 to U+9FFF (Chinese, Japanese), their compatibility and full-width forms, and the planes from U+20000 on.
_ALONE = np.zeros(1 << 16, bool)
for _a, _b in ((0xE0B8, 0xE0BB), (0xE180, 0xE182), (0xE19E, 0xE19F), (0xE380, 0xE9BF), (0xEFA4, 0xEFAB), (0xEFBC, 0xEFBF), (0xF0A0, 0xF0BF)):
    _ALONE[_a : _b + 1] = True


def _unit_hashes() -> np.ndarray:
    raw = np.frombuffer("\n".join(UNITS).encode(), np.uint8)
    starts, ends, _ = words(raw, np.array([0, len(raw)]))
    return np.sort(word_hashes(prefix_sums(raw, lower=True), starts, ends))


UNIT_HASHES = _unit_hashes()


def template(data: np.ndarray, offsets: np.ndarray):
    """(code, literal, is slot, row) of all tokens: runs of letters and digits, or single characters (``_ALONE``).

    A run with a digit is a number; a capitalised run that doesn't begin a sentence is a name, as
    are neighbours of it that are; a unit counts only behind a number.
    """
    ink = _INSIDE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    lead = np.flatnonzero(data[:-1] >= 0xE0)
    lead = lead[_ALONE[data[lead].astype(np.int64) << 8 | data[lead + 1]]]
    edge[lead] = True
    edge[np.minimum(lead + np.where(data[lead] >= 0xF0, 4, 3), len(data))] = True
    before = np.r_[False, ink[:-1]] if len(ink) else ink
    after = np.r_[ink[1:], False] if len(ink) else ink
    start = np.flatnonzero(ink & (~before | edge[:-1]))
    end = np.flatnonzero(ink & (~after | edge[1:])) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    if not len(start):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none.astype(bool), none
    literal = word_hashes(prefix_sums(data, lower=True), start, end)
    digits = np.r_[0, np.cumsum(_ROLE[data] == 1)]
    number = digits[end] > digits[start]
    stops = np.r_[0, np.cumsum(_STOP[data])]
    begins = np.r_[True, (stops[start[1:]] > stops[end[:-1]]) | (row[1:] != row[:-1])]
    name = (_ROLE[data[start]] == 2) & ~number & ~begins
    behind = np.r_[False, number[:-1] & (row[1:] == row[:-1])]
    at = np.minimum(np.searchsorted(UNIT_HASHES, literal), len(UNIT_HASHES) - 1)
    unit = behind & (UNIT_HASHES[at] == literal) & ~number
    code = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, literal)))
    return code, literal, number | name | unit, row


def windows(code: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first token) of every run of ``width`` tokens of one row."""
    n = max(len(code) - width + 1, 0)
    acc = np.zeros(n, np.uint64)
    for k in range(width):
        acc = acc * np.uint64(0xC2B2AE3D27D4EB4F) + code[k : k + n]
    first = np.flatnonzero(row[:n] == row[width - 1 :]) if n else np.zeros(0, np.int64)
    return mix(acc[first]), first


def exact_windows(literal: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The same of literal tokens; the hashes differ from those of templates and of other widths."""
    h, first = windows(literal, row, width)
    return mix(h ^ np.uint64(width * 0xA5A5A5A5A5A5A5)), first


def usable(slot: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Which windows say something: those with placeholders alone, or nearly, don't."""
    fixed = np.r_[0, np.cumsum(~slot)]
    return fixed[first + width] - fixed[first] >= width // 2 if len(first) else np.zeros(0, bool)


def _item_windows(width: int):
    """(item, hash, n_windows, exact) of distinct windows of each item; ``exact`` is 0 for template windows.

    An item with at most MIN_WINDOWS usable template windows (a role that differs at its first token could cost them
    all) has windows of literal tokens too, whose width is ``exact``; an item shorter than a window counts as one of
    its own length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: list[tuple[int, int, int, int]] = []
            data, offsets = text_column(batch)
            code, literal, slot, row = template(data, offsets)
            tokens = np.searchsorted(row, np.arange(len(ids) + 1))
            for i, item in enumerate(ids):
                own = slice(tokens[i], tokens[i + 1])
                h, first = windows(code[own], row[own], width)
                found = [(np.unique(h[usable(slot[own], first, width)]), 0)]
                short = min(width, int(tokens[i + 1] - tokens[i]))
                if short and len(found[0][0]) <= MIN_WINDOWS:
                    found.append((np.unique(exact_windows(literal[own], row[own], short)[0]), short))
                out += [(item, int(x), len(hashes), exact) for hashes, exact in found for x in hashes.view(np.int64)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in out], pa.int64()) for k in range(4)], names=["item", "hash", "n_windows", "exact"]
            )

    return run


def _document_windows(width: int, exact: list[int], known):
    """Template windows and literal ones of widths ``exact``, those of ``known`` only if given: (doc_id, key, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("doc_id").to_pylist(), batch.column("key").to_pylist()
            data, offsets = text_column(batch)
            out: tuple[list, list, list] = ([], [], [])
            for a, b in chunks(offsets):
                part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                code, literal, _, row = template(part, off)
                kept = []
                for w in [0, *exact]:
                    h, first = exact_windows(literal, row, w) if w else windows(code, row, width)
                    if known is not None:
                        table = known.value
                        at = np.minimum(np.searchsorted(table, h), max(len(table) - 1, 0))
                        ok = table[at] == h if len(table) else np.zeros(len(h), bool)
                        h, first = h[ok], first[ok]
                    kept.append((h, row[first]))
                h, r = (np.concatenate(x) for x in zip(*kept, strict=True))
                if exact:
                    order = np.argsort(r, kind="stable")
                    h, r = h[order], r[order]
                cut = np.searchsorted(r, np.arange(b - a + 1))
                for i in np.flatnonzero(np.diff(cut)):
                    out[0].append(ids[a + i])
                    out[1].append(keys[a + i])
                    out[2].append(np.unique(h[cut[i] : cut[i + 1]]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(out[0], pa.int64()),
                    pa.array(out[1], pa.binary()),
                    pa.array(out[2], pa.list_(pa.int64())),
                ],
                names=["doc_id", "key", "hashes"],
            )

    return run




def _renames(x: np.ndarray, y: np.ndarray, forth: dict[int, int], back: dict[int, int]) -> bool:
    """Whether x -> y fits a one-to-one renaming that has ``forth`` and ``back`` already; if so, they take it up."""
    new, old = dict(zip(x.tolist(), y.tolist(), strict=True)), dict(zip(y.tolist(), x.tolist(), strict=True))
    pairs = list(zip(x.tolist(), y.tolist(), strict=True))
    if not all(forth.get(p, q) == q == new[p] and back.get(q, p) == p == old[q] for p, q in pairs):
        return False
    forth.update(new)
    back.update(old)
    return True


def slot_verdict(item: str, text: str, width: int = WINDOW, cover_percent: int = COVER_PERCENT) -> str:
    """verbatim, renamed or inconsistent: do the values behind the placeholders of shared windows agree?

    Every alignment of the two counts, as judged over all its shared windows: the pair is verbatim if alignments with
    equal values have enough of the item's windows (``cover_percent`` of them or RUN_WINDOWS, and MIN_WINDOWS) between them, and renamed if one
    alignment has enough and a consistent renaming, or several next to each other (a copy with words put in or left
    out) have so together.  Alignments with fewer windows decide nothing.
    """
    views = []
    for x in (item, text):
        raw = np.frombuffer((x or "").encode(), np.uint8)
        code, literal, slot, row = template(raw, np.array([0, len(raw)]))
        views.append((literal, slot, *windows(code, row, width)))
    (a_literal, a_slot, a_h, a_first), (b_literal, _, b_h, _) = views
    n, m = len(a_h), len(b_h)
    at = a_first[usable(a_slot, a_first, width)]
    kinds, kind = np.unique(a_h[at], return_inverse=True)
    need = max(min(-(-len(kinds) * cover_percent // 100), RUN_WINDOWS), min(MIN_WINDOWS, len(kinds)), 1)
    order = np.argsort(b_h, kind="stable")
    low, high = (np.searchsorted(b_h[order], a_h[at], side) for side in ("left", "right"))
    votes = np.zeros(n + m, np.int64)
    for k, i, j in zip(at.tolist(), low.tolist(), high.tolist(), strict=True):
        votes[order[i:j] - k + n] += 1
    equal = np.zeros(len(kinds), bool)
    fitting: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []
    renamed = False
    for shift in (np.flatnonzero(votes) - n).tolist():
        k = np.arange(max(0, -shift), min(n, m - shift))
        k = k[a_h[k] == b_h[k + shift]]
        slots = np.unique((k[:, None] + np.arange(width)).ravel())
        slots = slots[a_slot[slots]]
        x, y = a_literal[slots], b_literal[slots + shift]
        has = np.unique(kind[np.isin(at, k)])
        if (x == y).all():
            equal[has] = True
            if equal.sum() >= need:
                return "verbatim"
        elif renamed or not _renames(x, y, {}, {}):
            continue
        elif len(has) >= need:
            renamed = True
        fitting.append((shift, len(has), has, x, y))
    if renamed:
        return "renamed"
    begins = [0, *(i for i in range(1, len(fitting)) if fitting[i][0] - fitting[i - 1][0] >= len(a_literal)), len(fitting)]
    for i, j in zip(begins, begins[1:], strict=False):
        forth: dict[int, int] = {}
        back: dict[int, int] = {}
        have = np.zeros(len(kinds), bool)
        for _, _, has, x, y in sorted(fitting[i:j], key=lambda f: -f[1]):
            if _renames(x, y, forth, back):
                have[has] = True
        if have.sum() >= need:
            return "renamed"
    return "inconsistent"


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WINDOW,
    cover_percent: int = COVER_PERCENT,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """(doc_id, item_id, n_shared, n_windows, verdict): documents that hold a benchmark item.

    A pair counts if the document has at least ``cover_percent`` of the item's distinct template
    windows, or RUN_WINDOWS of them (and MIN_WINDOWS, or all of a shorter item's), and its slots are verbatim or renamed
    consistently, or, for items with at most MIN_WINDOWS such windows, as many of the item's
    windows of literal tokens, which is verbatim (``n_shared`` and ``n_windows`` then count these).
    Items with fewer than ``width`` tokens are one literal window.  Texts that
    share an item_id are items of their own, each with its row for a document.  Null and empty texts match nothing; null ids
    stay; rows that repeat count once; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("item_text"))
    b = stage(b.where("item_text IS NOT NULL").distinct().withColumn("item", F.monotonically_increasing_id()), "benchmark")
    items = b.select(F.col("item").alias("item_id"), F.col("item_text").alias("text"))
    items = stage(items.mapInArrow(tidied(_item_windows(width)), "item long, hash long, n_windows long, exact long").distinct(), "items")
    d = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.unhex(F.md5("text")).alias("key"),
    )
    known, distinct = None, items.select("hash").distinct()
    if distinct.count() <= broadcast_windows:
        table = np.sort(distinct.toPandas()["hash"].to_numpy(np.int64).view(np.uint64))
        known = spark.sparkContext.broadcast(table)
    exact = sorted(r[0] for r in items.where("exact > 0").select("exact").distinct().collect())
    seen = d.mapInArrow(tidied(_document_windows(width, exact, known)), "doc_id long, key binary, hashes array<long>")
    seen = seen.select("doc_id", "key", F.explode("hashes").alias("hash")).distinct() if known is None else seen.distinct().select(
        "doc_id", "key", F.explode("hashes").alias("hash")
    )
    shared = seen.join(items, "hash").groupBy("doc_id", "key", "item").agg(
        *(f(F.when(k, F.col(c))).alias(n + x) for x, k in (("", F.col("exact") == 0), ("_exact", F.col("exact") > 0)) for f, c, n in ((F.count, "hash", "n_shared"), (F.max, "n_windows", "n_windows")))
    )

    def covers(n: str, of: str):
        share = F.least(F.ceil(F.col(of) * cover_percent / 100), F.lit(RUN_WINDOWS))
        return F.coalesce((F.col(n) >= share) & (F.col(n) >= F.least(F.lit(MIN_WINDOWS), F.col(of))), F.lit(False))

    literal = covers("n_shared_exact", "n_windows_exact")
    enough = shared.where(literal | covers("n_shared", "n_windows")).select(
        "doc_id", "key", "item", literal.alias("literal"),
        *(F.when(literal, F.col(f"{c}_exact")).otherwise(F.col(c)).alias(c) for c in ("n_shared", "n_windows")),
    )
    enough = stage(enough, "enough")
    if known is not None:
        known.unpersist()
    names = ["doc_id", "item_id", "n_shared", "n_windows"]
    found = enough.where("literal").join(b, "item").select(*names, F.lit("verbatim").alias("verdict"))
    enough = enough.where("NOT literal")
    # a text that many rows have is read once; both sides are of found documents only
    texts = d.join(stage(enough.select("key").distinct(), "keys"), "key", "left_semi").select("key", "text").dropDuplicates(["key"])
    pairs = enough.join(texts, "key").join(b, "item")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                slot_verdict(x, y, width, cover_percent)
                for x, y in zip(batch.column("item_text").to_pylist(), batch.column("text").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(found, pa.string())],
                names=[*names, "verdict"],
            )

    out = pairs.select(*names, "item_text", "text").mapInArrow(
        tidied(decide), "doc_id long, item_id long, n_shared long, n_windows long, verdict string"
    )
    return out.where("verdict <> 'inconsistent'").union(found).distinct()
