"""Exact repeats of fixed length, by column-wise construction of a collection's transform.

Every window of ``length`` bytes has an anchor that only its content decides (the leftmost of the
least hashed ANCHOR-grams in it), so equal windows lie alike around equal anchors.  The stretches of
windows that share one anchor become the strings of a collection, aligned at the anchor.  Stretches
whose anchor occurs once need no further work.  The others are dealt out by anchor, and each part of
the collection is built column by column from the right: one symbol of each string is inserted per
round, a stable sort by that symbol over the order of the round before gives the new order (the
column's slice of the transform), and the common prefixes follow from range minima of the old ones.
Since strings are aligned, a round touches only the strings that have the column, never the whole
transform.  What rounds need between stages lies in sequential files of the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.textbytes import mix, powers, prefix_sums, text_column, tidied, tidy
from orbweave.session import release, shuffle_partitions, stage, stage_buckets

LENGTH = 100
BLOCK_BYTES = 4 << 20
#: One numpy pass over a part of a block; positions must fit in PLACE_BITS.
PASS_BYTES = 1 << 20
PLACE_BITS = 22
#: Bytes of text for which the anchors, and the strings around repeated ones, are one part at most on average.
PART_BYTES = 8 << 20
#: Strings around one anchor beyond which its windows are dealt out singly, by their content.
HOT = 4096


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, anchor place, first window, number of windows) of all stretches, by place.

    Windows that cross from one row to the next don't count.
    """
    q = length // 2
    n = len(data) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    sums = prefix_sums(data)
    _, down = powers(len(sums))
    grams = mix((sums[q:] - sums[:-q]) * down[: len(sums) - q])
    span = length - q + 1
    low = np.uint64((1 << PLACE_BITS) - 1)
    best = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width * 2 <= span:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < span:
        best = np.minimum(best[: len(best) - (span - width)], best[span - width :])
    place = (best & low).astype(np.int64)
    ends = np.zeros(n, bool)
    for end in offsets[1:]:
        ends[max(0, end - length + 1) : min(n, end)] = True
    ok = ~ends
    new = ok.copy()
    new[1:] &= (place[1:] != place[:-1]) | ~ok[:-1]
    stop = ok.copy()
    stop[:-1] &= (place[1:] != place[:-1]) | ~ok[1:]
    first = np.flatnonzero(new)
    count = np.flatnonzero(stop) - first + 1
    at = place[first]
    return grams[at], at, first, count


def stretches(data: np.ndarray, offsets: np.ndarray, length: int):
    """``anchors`` of a whole block, in passes that overlap by a window; texts can have any length."""
    out = []
    total = len(data)
    a = 0
    while a < total:
        b = min(total, a + PASS_BYTES + length - 1)
        part = offsets[(offsets > a) & (offsets < b)] - a
        h, at, first, count = anchors(data[a:b], np.r_[0, part, b - a], length)
        out.append((h, at + a, first + a, count))
        if b == total:
            break
        a = b - length + 1
    if not out:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    h, at, first, count = (np.concatenate(x) for x in zip(*out, strict=True))
    # a stretch that two passes share is one: its anchor's place is the same in both
    joined = np.r_[False, (at[1:] == at[:-1]) & (first[1:] == first[:-1] + count[:-1])]
    if joined.any():
        keep = np.flatnonzero(~joined)
        count = np.add.reduceat(count, keep)
        h, at, first = h[keep], at[keep], first[keep]
    return h, at, first, count


BLOCKS = "block_id long, doc_ids array<long>, lengths array<long>, data binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    key = TaskContext.get().partitionId() << 32
    ids: list = []
    parts: list[np.ndarray] = []
    held = 0

    def flush():
        nonlocal key, ids, parts, held
        out = pa.RecordBatch.from_pydict(
            {
                "block_id": pa.array([key], pa.int64()),
                "doc_ids": pa.array([ids], pa.list_(pa.int64())),
                "lengths": pa.array([[len(p) for p in parts]], pa.list_(pa.int64())),
                "data": pa.array([np.concatenate(parts).tobytes()], pa.binary()),
            }
        )
        key, ids, parts, held = key + 1, [], [], 0
        return out

    for batch in batches:
        data, offsets = text_column(batch)
        for i, doc_id in enumerate(batch.column(0).to_pylist()):
            ids.append(doc_id)
            parts.append(data[offsets[i] : offsets[i + 1]].copy())
            held += len(parts[-1]) + 16
            if held >= BLOCK_BYTES:
                yield flush()
    if ids:
        yield flush()


def _open(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(data, offsets, document keys) of a block; a null doc_id counts as the smallest."""
    data = np.frombuffer(row["data"], np.uint8)
    offsets = np.r_[0, np.cumsum(np.array(row["lengths"], np.int64))].astype(np.int64)
    ids = np.array([-(1 << 63) if x is None else x for x in row["doc_ids"]], np.int64)
    return data, offsets, ids


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {k: batch.column(k)[i].as_py() for k in ("block_id", "doc_ids", "lengths", "data")}


def _squeeze(x: np.ndarray) -> bytes:
    """The byte planes of an array, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), -1).T.tobytes())


def _unsqueeze(blob: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _deal(key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, cuts): rows of a sorted hash dealt to n parts, in order within each."""
    part = (key >> np.uint64(17)) % np.uint64(n)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(n + 1))


def _ask(length: int, n_parts: int):
    """Of each block the distinct anchors (their upper half) and how many strings they have there.

    Two anchors of a part with equal upper halves pass for a repeated one; their strings differ, so nothing follows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                data, offsets, _ = _open(row)
                h, _, first, count = stretches(data, offsets, length)
                u, n = np.unique(h, return_counts=True)
                order, cut = _deal(u, n_parts)
                used = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array(used, pa.int32()),
                        "block_id": pa.array([row["block_id"]] * len(used), pa.int64()),
                        "anchors": pa.array([(u[order[cut[p] : cut[p + 1]]] >> np.uint64(32)).astype("<u4").tobytes() for p in used], pa.binary()),
                        "counts": pa.array(
                            [_squeeze(np.minimum(n[order[cut[p] : cut[p + 1]]], HOT + 1).astype("<u2")) for p in used], pa.binary()
                        ),
                    }
                )

    return run


def _answer(table: pa.Table) -> pa.Table:
    """For the anchors of each block: 0 if it occurs once, 1 if more often, 2 if very often."""
    keys = [np.frombuffer(x.as_py(), "<u4") for x in table.column("anchors")]
    counts = [_unsqueeze(x.as_py(), "<u2") for x in table.column("counts")]
    u, inv = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inv, np.concatenate(counts), len(u))
    code = ((total > 1).astype(np.uint8) + (total > HOT))[inv]
    ends = np.cumsum([len(k) for k in keys])
    press = zstandard.ZstdCompressor(level=1)
    return pa.table(
        {
            "block_id": table.column("block_id"),
            "part": table.column("part"),
            "codes": pa.array(
                [press.compress(code[e - len(k) : e].tobytes()) for e, k in zip(ends, keys, strict=True)], pa.binary()
            ),
        }
    )


def _candidates(row, answers: list[tuple[int, bytes]], length: int, n_parts: int):
    """The stretches of a block whose anchor occurs again, and for each the first equal string of the block."""
    data, offsets, ids = _open(row)
    h, at, first, count = stretches(data, offsets, length)
    u = np.unique(h)
    order, cut = _deal(u, n_parts)
    code = np.zeros(len(u), np.uint8)
    open_ = zstandard.ZstdDecompressor()
    for part, blob in answers:
        code[order[cut[part] : cut[part + 1]]] = np.frombuffer(open_.decompress(blob), np.uint8)
    own = code[np.searchsorted(u, h)] if len(u) else np.zeros(0, np.uint8)
    keep = own > 0
    h, at, first, count, own = h[keep], at[keep], first[keep], count[keep], own[keep]
    doc = np.searchsorted(offsets, first, "right") - 1
    # windows of the block in the order of documents: smaller doc_id, then place in the block
    rank = np.empty(len(ids), np.int64)
    rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    order = np.lexsort((first, rank[doc])) if len(first) else np.zeros(0, np.int64)
    h, at, first, count, own, doc = (x[order] for x in (h, at, first, count, own, doc))
    raw = data.tobytes()
    seen: dict[bytes, int] = {}
    source = np.empty(len(first), np.int64)
    for i, (a, n) in enumerate(zip(first.tolist(), count.tolist(), strict=True)):
        source[i] = seen.setdefault(raw[a : a + n + length - 1], i)
    return data, offsets, ids, raw, h, at, first, count, own, doc, source


#: Strings of a part: windows lie at columns -lead .. -lead + windows - 1 from the anchor.
STRINGS = "part int, block_id long, meta binary, text binary"
_META = np.dtype([("doc", "<i8"), ("order", "<u4"), ("index", "<u4"), ("at", "<u4"), ("lead", "u1"), ("windows", "u1"), ("skip", "u1")])


def _strings(length: int, n_parts: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"part": [], "block_id": [], "meta": [], "text": []}
        press = zstandard.ZstdCompressor(level=3)
        answers = list(zip(right.column("part").to_pylist(), right.column("codes").to_pylist(), strict=True))
        for row in left.to_pylist():
            data, offsets, ids, raw, h, at, first, count, own, doc, source = _candidates(row, answers, length, n_parts)
            new = np.flatnonzero(source == np.arange(len(source)))
            rows = []
            for i in new.tolist():
                a, n, k = int(first[i]), int(count[i]), int(doc[i])
                meta = (ids[k], k, i, at[i] - offsets[k], at[i] - a)
                if own[i] == 1:
                    rows.append((int(h[i] % np.uint64(n_parts)), (*meta, n, 0), raw[a : a + n + length - 1]))
                else:
                    for w in range(n):
                        text = raw[a + w : a + w + length]
                        part = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little") % n_parts
                        rows.append((part, (*meta[:4], at[i] - a - w, 1, w), text))
            rows.sort(key=lambda r: r[0])
            a = 0
            while a < len(rows):
                b = a
                while b < len(rows) and rows[b][0] == rows[a][0]:
                    b += 1
                out["part"].append(rows[a][0])
                out["block_id"].append(row["block_id"])
                out["meta"].append(_squeeze(np.array([r[1] for r in rows[a:b]], _META)))
                out["text"].append(press.compress(b"".join(r[2] for r in rows[a:b])))
                a = b
        tidy()
        return pa.table(
            {
                "part": pa.array(out["part"], pa.int32()),
                "block_id": pa.array(out["block_id"], pa.int64()),
                "meta": pa.array(out["meta"], pa.binary()),
                "text": pa.array(out["text"], pa.binary()),
            }
        )

    return run


def column_rounds(text: np.ndarray, start: np.ndarray, lead: np.ndarray, windows: np.ndarray, rank: np.ndarray, length: int):
    """Windows that also start earlier, as (string, window) index arrays.

    String s holds windows[s] + length - 1 symbols from start[s]; its symbol c lies at column
    c - lead[s].  ``rank`` orders the strings' anchors in the collection; of equal windows all but
    the one of the least rank are given.  Rounds go through the columns from the right.
    """
    size = windows + length - 1
    left, right = -lead, size - lead  # columns left .. right - 1
    by_end = np.argsort(-right, kind="stable")
    next_in = 0
    order = np.zeros(0, np.int64)
    common = np.zeros(0, np.int64)  # with the string before it in the order
    found_s, found_w = [], []
    for column in range(int(right.max()) - 1, int(left.min()) - 1, -1):
        new = next_in
        while new < len(by_end) and right[by_end[new]] > column:
            new += 1
        if new > next_in:  # strings that begin here from the right: empty suffixes, before all others
            order = np.r_[by_end[next_in:new], order]
            common = np.r_[np.zeros(new - next_in, np.int64), common]
            if len(common) > new - next_in:
                common[new - next_in] = 0
            next_in = new
        has = left[order] <= column
        places = np.flatnonzero(has)
        active = order[places]
        if not len(active):
            order, common = active, np.zeros(0, np.int64)
            continue
        symbol = text[start[active] + column - left[active]]
        by_symbol = np.argsort(symbol, kind="stable")
        before = places[by_symbol]  # places in the old order
        symbol = symbol[by_symbol]
        fresh = np.zeros(len(before), np.int64)
        if len(before) > 1:
            same = np.flatnonzero(symbol[1:] == symbol[:-1]) + 1
            lo, hi = before[same - 1] + 1, before[same] + 1
            step = hi - lo == 1
            value = common[lo]
            if not step.all():
                far = np.flatnonzero(~step)
                value[far] = _range_min(common, lo[far], hi[far])
            fresh[same] = value + 1
        order, common = order[before], np.minimum(fresh, length)
        # windows that start at this column: equal ones stand together
        valid = right[order] >= column + length
        joined = (common >= length) & valid
        if joined[1:].any():
            joined[0] = False
            group = np.cumsum(~joined)
            many = joined | np.r_[joined[1:], False]
            s, g = order[many], group[many]
            heads = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            least = np.minimum.reduceat(rank[s], heads)
            late = rank[s] != np.repeat(least, np.diff(np.r_[heads, len(g)]))
            found_s.append(s[late])
            found_w.append(column - left[s[late]])
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_s), np.concatenate(found_w)) if found_s else (none, none)


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minima of values[lo:hi], by doubling."""
    out = np.empty(len(lo), values.dtype)
    span = hi - lo
    level, table = 0, values
    for k in range(int(span.max()).bit_length()):
        own = np.flatnonzero((span >> k) == 1)
        if len(own):
            out[own] = np.minimum(table[lo[own]], table[hi[own] - (1 << k)])
        if len(table) > (1 << level):
            table = np.minimum(table[: len(table) - (1 << level)], table[1 << level :])
        level += 1
    return out


def _rounds(length: int):
    def run(table: pa.Table) -> pa.Table:
        open_ = zstandard.ZstdDecompressor()
        metas = [_unsqueeze(x.as_py(), _META) for x in table.column("meta")]
        meta = np.concatenate(metas)
        block = np.repeat(table.column("block_id").to_numpy(), [len(m) for m in metas])
        text = np.concatenate([np.frombuffer(open_.decompress(x.as_py()), np.uint8) for x in table.column("text")])
        windows = meta["windows"].astype(np.int64)
        size = windows + length - 1
        start = np.cumsum(size) - size
        by = np.lexsort((meta["at"], meta["order"], block, meta["doc"]))
        rank = np.empty(len(meta), np.int64)
        rank[by] = np.arange(len(meta))
        s, w = column_rounds(text, start, meta["lead"].astype(np.int64), windows, rank, length)
        bits = np.zeros(len(meta), np.uint64)
        np.bitwise_or.at(bits, s, np.uint64(1) << (w + meta["skip"][s]).astype(np.uint64))
        used = np.flatnonzero(bits)
        used = used[np.argsort(block[used], kind="stable")]
        cut = np.flatnonzero(np.r_[True, block[used][1:] != block[used][:-1]]) if len(used) else np.zeros(0, np.int64)
        ends = np.r_[cut[1:], len(used)].astype(np.int64)
        tidy()
        return pa.table(
            {
                "block_id": pa.array(block[used[cut]], pa.int64()),
                "marks": pa.array(
                    [
                        np.stack([meta["index"][used[a:b]].astype(np.uint64), bits[used[a:b]]], 1).tobytes()
                        for a, b in zip(cut.tolist(), ends.tolist(), strict=True)
                    ],
                    pa.binary(),
                ),
            }
        )

    return run


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"


def _apply(length: int, n_parts: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        codes = [(p, c) for p, c in zip(right.column("part").to_pylist(), right.column("codes").to_pylist(), strict=True) if c is not None]
        marks = [np.frombuffer(x, np.uint64).reshape(-1, 2) for x in right.column("marks").to_pylist() if x is not None]
        rows = []
        for row in left.to_pylist():
            data, offsets, ids, raw, h, at, first, count, own, doc, source = _candidates(row, codes, length, n_parts)
            bits = np.zeros(len(first), np.uint64)
            for m in marks:
                np.bitwise_or.at(bits, m[:, 0].astype(np.int64), m[:, 1])
            hit = np.zeros(len(data) + length + 1, np.int32)  # +1 where a removed window starts, -1 past its end
            copy = source != np.arange(len(source))
            np.add.at(hit, first[copy], 1)
            np.add.at(hit, first[copy] + count[copy] + length - 1, -1)
            for w in range(length - length // 2 + 1):
                own_w = np.flatnonzero((bits >> np.uint64(w)) & np.uint64(1) & ~copy)
                np.add.at(hit, first[own_w] + w, 1)
                np.add.at(hit, first[own_w] + w + length, -1)
            gone = np.cumsum(hit[: len(data)]) > 0
            for k, doc_id in enumerate(row["doc_ids"]):
                a, b = int(offsets[k]), int(offsets[k + 1])
                g = gone[a:b]
                if g.any():
                    edge = np.flatnonzero(np.diff(np.r_[False, g, False]))
                    spans = [{"start": x, "end": y} for x, y in edge.reshape(-1, 2).tolist()]
                    kept = data[a:b][~g].tobytes()
                else:
                    spans, kept = [], raw[a:b]
                n_removed = sum(x["end"] - x["start"] for x in spans)
                rows.append((doc_id, b - a, n_removed, len(spans), hashlib.sha256(kept).hexdigest(), spans))
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
        tidy()
        return pa.table({n: pa.array(list(c), t) for n, c, t in zip(names, cols, kinds, strict=True)})

    return run


def find_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Bytes of ``docs(doc_id, text)`` that lie in a ``length``-byte string which also starts earlier.

    Gives doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans (byte offsets) of
    every row.  Earlier means a smaller doc_id, or the same document and an earlier start; rows that
    repeat a doc_id are documents of their own in the order in which they are stored, and a null
    doc_id is the smallest.  Null texts are empty; texts shorter than ``length`` have no repeats;
    an empty table gives no rows; other columns are ignored.  ``length`` can be 8 to 126.
    """
    if not 8 <= length <= 126:
        raise ValueError("length must be 8 to 126")
    spark = docs.sparkSession
    n_buckets = shuffle_partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = stage_buckets(rows.mapInArrow(tidied(_blocks), BLOCKS), "blocks", "block_id", n_buckets)
    total = blocks.select(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    n_parts = max(8, 2 * n_buckets, -(-total // PART_BYTES))
    asked = blocks.mapInArrow(tidied(_ask(length, n_parts)), "part int, block_id long, anchors binary, counts binary")
    codes = stage_buckets(
        asked.groupBy("part").applyInArrow(_answer, "block_id long, part int, codes binary"), "codes", "block_id", n_buckets
    )
    del asked
    release(spark)
    grouped = blocks.groupBy("block_id")
    strings = grouped.cogroup(codes.groupBy("block_id")).applyInArrow(_strings(length, n_parts), STRINGS)
    marks = stage(strings.groupBy("part").applyInArrow(_rounds(length), "block_id long, marks binary"), "marks")
    del strings
    release(spark)
    both = codes.select("block_id", "part", "codes", F.lit(None).cast("binary").alias("marks")).union(
        marks.select("block_id", F.lit(None).cast("int").alias("part"), F.lit(None).cast("binary").alias("codes"), "marks")
    )
    return grouped.cogroup(both.groupBy("block_id")).applyInArrow(_apply(length, n_parts), OUT)
