"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Columns (n-grams) are dealt out in blocks and only their rarest part of each document enters the
first product, whose overlap counts are summed over the blocks and held against bounds that follow
from the set sizes.  What passes forms clusters that no link leaves; within them the product is
taken again over whole rows, block by block, and exact overlaps decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave.llm.textbytes import shingle_sets, tidied, tidy
from orbweave.operators.components import connected_components
from orbweave.session import release, shuffle_partitions, stage

WIDTH, PERCENT = 4, 85
#: Slots of the sketch of frequent n-grams: a fixed size, so that it may be broadcast.
SKETCH_BITS = 20
#: Bits of the filter of clustered documents, which spares the others the second product's shuffle.
KEPT_BITS = 25
#: An n-gram in at least so many documents of one pass counts as frequent in it.
FREQUENT = 3
#: Slots of the table of n-grams with long runs: a fixed size, as it is broadcast.
RUN_BITS = 24
#: Runs of more documents go by shared columns instead of pairs.
SHORT_RUN = 16
#: Parts in which the members of a long run are joined with its head.
RUN_SALTS = 16
#: Clustered sets up to which a table of 20 bytes each tells where n-grams go, so that they are shuffled once.
PLACED_SETS = 4_000_000
#: Shingles that one task of the second product holds for each of its two blocks.
BLOCK_SHINGLES = 4_000_000


def required(n, percent: int):
    """The least overlap of a set of size ``n`` with any set it links with."""
    return -(-n * percent // 100)


def common(n):
    """How many n-grams two linked sets of this size must share in their prefixes."""
    return np.maximum(1, n // 20)


def digest(s: np.ndarray) -> int:
    """The name of a set of shingles: 64 bits, equal for equal sets."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _shapes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, slots, counts = [], [], [], []
            for _, sets in shingle_sets(batch, width):
                sizes += [len(s) for s in sets]
                names += [digest(s) for s in sets]
                if sets:
                    u, c = np.unique(np.concatenate(sets), return_counts=True)
                    often = c >= FREQUENT
                    slots.append((u[often] >> np.uint64(64 - SKETCH_BITS)).astype(np.int32))
                    counts.append(c[often].astype(np.int64))
            slots = np.concatenate(slots) if slots else np.zeros(0, np.int32)
            counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            u, inv = np.unique(slots, return_inverse=True)
            total = np.bincount(inv, counts, len(u)).astype(np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_ids": pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())),
                    "sizes": pa.array([sizes], pa.list_(pa.int64())),
                    "names": pa.array([names], pa.list_(pa.int64())),
                    "slots": pa.array([u], pa.list_(pa.int32())),
                    "counts": pa.array([total], pa.list_(pa.int64())),
                }
            )

    return run


def _sketch(shapes: DataFrame) -> np.ndarray:
    """Weights 0 to 31 of all slots: the bit length of the summed counts."""
    pairs = shapes.select(F.explode(F.arrays_zip("slots", "counts")).alias("x")).select("x.*")
    rows = pairs.groupBy("slots").agg(F.sum("counts").alias("n")).toPandas()
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    if len(rows):
        out[rows["slots"].to_numpy()] = np.minimum(31, np.floor(np.log2(rows["n"].to_numpy(float))) + 1).astype(np.uint8)
    return out


def _run_table(runs: DataFrame) -> np.ndarray:
    """Weights 0 to 31 by n-gram: the bit length of its run, 0 for short ones (of those that share a slot, the most)."""
    rows = runs.groupBy("slot").agg(F.max("n").alias("n")).toPandas()
    out = np.zeros(1 << RUN_BITS, np.uint8)
    if len(rows):
        out[rows["slot"].to_numpy()] = np.minimum(31, np.floor(np.log2(rows["n"].to_numpy(float))) + 1).astype(np.uint8)
    return out


def _postings(weights, table, width: int, percent: int, n_buckets: int):
    """Prefixes of sets under one order of n-grams: those of short runs first, by the sketch, then by length of run.

    Without ``table`` runs are only to be counted: 4 bytes of n-gram and set each.  With it, 6 bytes of the
    n-gram, the set's name, and its size in as few bytes as do for all of a bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, runs = weights.value, table and table.value
        for batch in batches:
            first: set[int] = set()
            keys, docs, sizes = [], [], []
            for _, sets in shingle_sets(batch, width):
                for s in sets:
                    if not len(s) or (d := digest(s)) in first:
                        continue
                    first.add(d)
                    n = len(s)
                    take = n - required(n, percent) + int(common(n))
                    weight = w[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    low = (s * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(6)
                    if runs is not None:
                        long = runs[(low >> np.uint64(58 - RUN_BITS)).astype(np.int64)]
                        weight = np.where(long > 0, long + np.uint8(32), weight)
                    key = (weight.astype(np.uint64) << np.uint64(58)) | low
                    keys.append(np.partition(key, take - 1)[:take] if take < n else key)
                    docs.append((d, min(take, n)))
                    sizes.append(n)
            out = []
            if keys:
                flat = np.concatenate(keys)
                lens = np.array([k for _, k in docs])
                doc, size = np.repeat(np.array([d for d, _ in docs], np.int64), lens), np.repeat(np.array(sizes, np.int64), lens)
                flat &= np.uint64((1 << 58) - 1)
                bucket = (flat % np.uint64(n_buckets)).astype(np.int64)
                o = np.argsort(bucket, kind="stable")
                flat, doc, size = flat[o], doc[o], size[o]
                cut = np.searchsorted(bucket[o], np.arange(n_buckets + 1))
                out = [
                    (b, *(_counted(flat[x:y], doc[x:y]) if runs is None else _named(flat[x:y], doc[x:y], size[x:y])))
                    for b, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
                    if y > x
                ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in out], pa.int32()),
                    *(pa.array([x[k] for x in out], pa.binary()) for k in (1, 2, 3)),
                ],
                names=["bucket", "keys", "docs", "sizes"],
            )

    return run


POSTINGS = "bucket int, keys binary, docs binary, sizes binary"


def _counted(low: np.ndarray, doc: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Postings that do for counting runs: the bucket and 32 bits tell n-grams apart."""
    return (low >> np.uint64(26)).astype("<u4").tobytes(), doc.astype("<u4").tobytes(), b""


def _named(low: np.ndarray, doc: np.ndarray, size: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Postings for pairs: 48 bits of the n-gram (4 and 2 bytes in turn), which its bucket narrows further."""
    key = low >> np.uint64(10)
    keys = (key >> np.uint64(16)).astype("<u4").tobytes() + key.astype("<u2").tobytes()
    return keys, doc.tobytes(), size.astype("<u2" if size.max() < 1 << 16 else "<u4").tobytes()


def _keys(table: pa.Table) -> np.ndarray:
    out = [np.zeros(0, np.uint64)]
    for x in table.column("keys"):
        blob, n = x.as_py(), len(x.as_py()) // 6
        out.append(np.frombuffer(blob, "<u4", n).astype(np.uint64) << np.uint64(16) | np.frombuffer(blob, "<u2", n, 4 * n))
    return np.concatenate(out)


def _sizes(table: pa.Table) -> np.ndarray:
    out = [np.zeros(0, np.int64)]
    for x, docs in zip(table.column("sizes"), table.column("docs"), strict=True):
        blob = x.as_py()
        out.append(np.frombuffer(blob, f"<u{8 * len(blob) // len(docs.as_py())}").astype(np.int64))
    return np.concatenate(out)


def _flat(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column(name)] or [np.zeros(0, kind)])


def _long_runs(table: pa.Table) -> pa.Table:
    """(slot, n): n-grams in the prefixes of more than SHORT_RUN different sets, by their place in the table."""
    both = np.unique(_flat(table, "keys", "<u4").astype(np.uint64) << np.uint64(32) | _flat(table, "docs", "<u4"))
    u, n = np.unique(both >> np.uint64(32), return_counts=True)
    u, n = u[n > SHORT_RUN], n[n > SHORT_RUN]
    tidy()
    slot = u >> np.uint64(32 - RUN_BITS)
    return pa.table({"slot": pa.array(slot.astype(np.int32)), "n": pa.array(n.astype(np.int64))})


PAIRS = "a long, b long, na long, nb long, c long, run long"


def _pairs(percent: int):
    """Overlap counts of pairs in short runs (a, b, na, nb, c) and the members of long runs (a, na, run)."""

    def run(table: pa.Table) -> pa.Table:
        key, doc, size = _keys(table), _flat(table, "docs", np.int64), _sizes(table)
        o = np.lexsort((doc, key))
        key, doc, size = key[o], doc[o], size[o]
        same = np.r_[False, (key[1:] == key[:-1]) & (doc[1:] == doc[:-1])]
        key, doc, size = key[~same], doc[~same], size[~same]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.r_[start, len(key)])
        out = [[], [], [], []]
        for gap in range(1, SHORT_RUN):  # partners at each distance within the short runs
            ok = start[(count > gap) & (count <= SHORT_RUN)]
            if not len(ok):
                break
            n = count[(count > gap) & (count <= SHORT_RUN)] - gap
            left = np.repeat(ok, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            right = left + gap
            near = np.minimum(size[left], size[right]) * 100 >= np.maximum(size[left], size[right]) * percent
            for x, v in zip(out, (doc[left], doc[right], size[left], size[right]), strict=True):
                x.append(v[near])
        a, b, na, nb = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
        o = np.lexsort((b, a))
        a, b, na, nb = a[o], b[o], na[o], nb[o]
        new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
        c = np.diff(np.r_[new, len(a)])
        long = count > SHORT_RUN
        at = np.repeat(start[long], count[long]) + (
            np.arange(count[long].sum()) - np.repeat(np.cumsum(count[long]) - count[long], count[long])
        )
        k = len(at)
        tidy()
        null = lambda n: pa.nulls(n, pa.int64())
        cat = lambda x, y: pa.concat_arrays([pa.array(x, pa.int64()) if isinstance(x, np.ndarray) else x, y])
        return pa.table(
            {
                "a": cat(a[new], pa.array(doc[at], pa.int64())),
                "b": cat(b[new], null(k)),
                "na": cat(na[new], pa.array(size[at], pa.int64())),
                "nb": cat(nb[new], null(k)),
                "c": cat(c.astype(np.int64), null(k)),
                "run": pa.concat_arrays([null(len(new)), pa.array(key[at].view(np.int64), pa.int64())]),
            }
        )

    return run


def linked_labels(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The smallest id that each set reaches by links, from rows of the incidence product.

    Breadth first over rows: each visited row is multiplied with all rows not yet reached whose
    sizes allow a link, so a large group of copies is reached in few products and no pair is stored.
    """
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    size, ids = size[order], ids[order]
    column, flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    ends = np.cumsum(size)
    rows = [flat[e - n : e] for e, n in zip(ends.tolist(), size.tolist(), strict=True)]
    open_, open_flat, open_size = np.arange(len(ids)), flat, size
    open_start = ends - size
    alive = np.ones(len(ids), bool)
    label = np.empty(len(ids), np.int64)
    mark = np.zeros(len(column), np.int32)
    for seed in range(len(ids)):
        if not alive[seed]:
            continue
        alive[seed] = False
        group, todo = [seed], [seed]
        while todo:
            x = todo.pop()
            n = size[x]
            lo = np.searchsorted(open_size, required(n, percent))
            hi = np.searchsorted(open_size, n * 100 // percent, "right")
            if lo < hi and alive[open_[lo:hi]].any():
                mark[rows[x]] = 1
                f0 = open_start[lo]
                f1 = open_start[hi - 1] + open_size[hi - 1]
                overlap = np.add.reduceat(mark[open_flat[f0:f1]], open_start[lo:hi] - f0)
                mark[rows[x]] = 0
                hit = alive[open_[lo:hi]] & (overlap * 100 >= (n + open_size[lo:hi] - overlap) * percent)
                found = open_[lo:hi][hit]
                alive[found] = False
                group += found.tolist()
                todo += found.tolist()
        label[group] = ids[group].min()
        left = alive[open_]
        if len(open_) > 32 and left.sum() * 2 < len(open_):
            open_flat = open_flat[np.repeat(left, open_size)]
            open_, open_size = open_[left], open_size[left]
            open_start = np.cumsum(open_size) - open_size
    out = np.empty(len(ids), np.int64)
    out[order] = label
    return out


def _second_product(percent: int):
    def run(table: pa.Table) -> pa.Table:
        cluster = table.column("cluster").to_numpy()
        ids = table.column("name").to_numpy()
        blobs = table.column("grams")
        o = np.argsort(cluster, kind="stable")
        cut = np.flatnonzero(np.r_[True, cluster[o][1:] != cluster[o][:-1]]) if len(o) else np.zeros(0, np.int64)
        labels = np.empty(len(ids), np.int64)
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(o)], strict=True):
            own = o[a:b]
            sets = [np.frombuffer(blobs[int(i)].as_py(), np.uint64) for i in own]
            labels[own] = linked_labels(ids[own], sets, percent)
        tidy()
        return pa.table({"name": pa.array(ids, pa.int64()), "label": pa.array(labels, pa.int64())})

    return run


def _kept(reps: DataFrame) -> np.ndarray:
    """A filter that lets all ``reps(rep)`` pass, and few others."""
    slots = reps.select(F.expr(f"cast((rep ^ shiftright(rep, {KEPT_BITS})) & {(1 << KEPT_BITS) - 1}L as int)").alias("slot"))
    out = np.zeros(1 << KEPT_BITS, bool)
    out[slots.distinct().toPandas()["slot"].to_numpy(np.int64)] = True
    return np.packbits(out, bitorder="little")


def _grams(kept, width: int):
    """(doc_id, name, grams) of the rows that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = kept.value
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            slot = (ids ^ (ids >> KEPT_BITS)) & ((1 << KEPT_BITS) - 1)
            batch = batch.filter(pa.array((bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)))
            names: list[int] = []
            blobs: list[bytes] = []
            for _, sets in shingle_sets(batch, width):
                names += [digest(s) for s in sets]
                blobs += [s.tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "name", "grams"]
            )

    return run


def _places(placed: DataFrame) -> tuple[np.ndarray, ...]:
    """(doc_id, name, number of its cluster) by doc_id, and the blocks of each cluster by number."""
    table = placed.toArrow()
    ids, names, cluster, blocks = (table.column(c).to_numpy() for c in ("doc_id", "name", "cluster", "blocks"))
    u, first, number = np.unique(cluster, return_index=True, return_inverse=True)
    o = np.argsort(ids, kind="stable")
    return ids[o], names[o], number[o].astype(np.int32), blocks[first].astype(np.int32)


def _placed_grams(places, width: int):
    """(name, cluster, blocks, grams) of the sets that have a place, from their own rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reps, names, number, blocks = places.value
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            lo, hi = np.searchsorted(reps, ids), np.searchsorted(reps, ids, "right")
            batch, ranges = batch.filter(pa.array(lo < hi)), np.stack([lo, hi], 1)[lo < hi].tolist()
            at, blobs = [], []
            for first, sets in shingle_sets(batch, width):
                for s, (a, b) in zip(sets, ranges[first : first + len(sets)], strict=True):
                    # rows that share a doc_id may differ
                    own = a + np.flatnonzero(names[a:b] == digest(s))
                    at += own.tolist()
                    blobs += [s.tobytes()] * len(own)
            at = np.array(at, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[at]), pa.array(number[at].astype(np.int64)), pa.array(blocks[number[at]]), pa.array(blobs, pa.binary())],
                names=["name", "cluster", "blocks", "grams"],
            )

    return run


def link_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs(doc_id, text)``.

    Sets are the distinct runs of ``width`` words (A-Z lower-cased, separated by space, tab and line
    ends); shorter texts form one run, texts without words none.  Two documents link if
    100 * overlap >= percent * union; component_id is the smallest doc_id that links reach.  Null
    and empty texts link with nothing; rows with equal doc_id take the smallest of their components; a
    null doc_id gets no component; other columns are ignored.

    First product: two linked sets of sizes na and nb share at least min(common(na), common(nb))
    n-grams among the n - required(n) + common(n) first of each in any order of n-grams; here
    frequent ones come last.  Pairs in runs of up to SHORT_RUN documents are counted; what longer
    runs could add is bounded by how many of a document's n-grams lie in them, and documents for
    which those alone could suffice are clustered by the runs they share.
    """
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_buckets = max(8, 2 * shuffle_partitions(spark))
    shapes = stage(
        text.mapInArrow(
            tidied(_shapes(width)), "doc_ids array<long>, sizes array<long>, names array<long>, slots array<int>, counts array<long>"
        ),
        "shapes",
    )
    flat = shapes.select(F.explode(F.arrays_zip("doc_ids", "sizes", "names")).alias("x")).select(
        F.col("x.doc_ids").alias("doc_id"), F.col("x.sizes").alias("n_shingles"), F.col("x.names").alias("name")
    )
    named = flat.where("doc_id is not null and n_shingles > 0")
    # equal sets are one from here on, under their name
    reps = stage(named.groupBy("name").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n")), "reps")
    weights = spark.sparkContext.broadcast(_sketch(shapes))
    known = text.where("doc_id is not null")
    posted = lambda table: known.mapInArrow(tidied(_postings(weights, table, width, percent, n_buckets)), POSTINGS).groupBy("bucket")
    runs = stage(posted(None).applyInArrow(_long_runs, "slot int, n long"), "runs")
    release(spark)
    table = spark.sparkContext.broadcast(_run_table(runs))
    counted = stage(posted(table).applyInArrow(_pairs(percent), PAIRS), "counted")
    weights.unpersist()
    table.unpersist()
    release(spark)
    long = counted.where("run is not null").select(F.col("a").alias("d"), "na", "run")
    in_long = stage(long.groupBy("d", "na").agg(F.count("*").alias("h")), "in-long")
    share = lambda n: F.greatest(F.lit(1), F.floor(n / 20))
    enough = F.greatest(F.lit(1), F.floor(share(F.col("na")) * percent / 100) - 1)
    hot = stage(in_long.where(F.col("h") >= enough), "hot")
    pairs = counted.where("c > 0").groupBy("a", "b").agg(F.sum("c").alias("c"), F.min("na").alias("na"), F.min("nb").alias("nb"))
    need = F.least(share(F.col("na")), share(F.col("nb")))
    pairs = (
        pairs.join(in_long.groupBy(F.col("d").alias("a")).agg(F.max("h").alias("ha")), "a", "left")
        .join(in_long.groupBy(F.col("d").alias("b")).agg(F.max("h").alias("hb")), "b", "left")
        .where(F.col("c") >= need - F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0))))
        .select(F.col("a").alias("u"), F.col("b").alias("v"))
    )
    members = stage(long.join(hot.select("d"), "d", "left_semi"), "members")
    # two sets that share ``enough`` runs share one even if each leaves out its ``enough`` - 1 longest
    longest = Window.partitionBy("d").orderBy(F.desc("k"), "run")
    ranked = members.join(members.groupBy("run").agg(F.count("*").alias("k")), "run").withColumn("place", F.row_number().over(longest))
    members = ranked.where(F.col("place") >= enough).select("d", "run").withColumn("salt", F.pmod(F.xxhash64("d"), F.lit(RUN_SALTS)))
    heads = members.groupBy("run").agg(F.min("d").alias("u"))
    # a run that a third of all documents share is joined in RUN_SALTS parts
    salted = heads.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(RUN_SALTS - 1).cast("long"))))
    by_run = members.join(salted, ["run", "salt"]).where("u <> d").select("u", F.col("d").alias("v")).distinct()
    clusters = stage(
        connected_components(pairs.union(by_run)).select(F.col("v").alias("name"), F.col("component").alias("cluster")),
        "clusters",
    )
    sized = stage(clusters.join(reps, "name"), "sized")
    blocks = sized.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    placed = sized.join(blocks, "cluster").select(F.col("rep").alias("doc_id"), "name", "cluster", "blocks")
    if sized.count() <= PLACED_SETS:
        places = spark.sparkContext.broadcast(_places(placed))
        grams = known.mapInArrow(tidied(_placed_grams(places, width)), "name long, cluster long, blocks int, grams binary")
    else:
        kept = spark.sparkContext.broadcast(_kept(sized))
        # by name too: rows that share a doc_id may differ
        grams = known.mapInArrow(tidied(_grams(kept, width)), "doc_id long, name long, grams binary").join(placed, ["doc_id", "name"])
    own = F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int")
    tiles = F.when(F.col("blocks") > 1, F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(
        F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))).otherwise(
        F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))))
    tiled = grams.select("name", "cluster", "grams", "blocks", F.explode(tiles).alias("tile"))
    # clusters of one block share tasks; each pair of blocks of a larger one is a task of its own
    group = F.when(F.col("blocks") > 1, F.xxhash64("cluster", "tile")).otherwise(F.pmod(F.xxhash64("cluster"), F.lit(4 * n_buckets)))
    labels = (
        tiled.select("name", "cluster", "grams", group.alias("group"))
        .groupBy("group")
        .applyInArrow(_second_product(percent), "name long, label long")
    )
    labels = stage(labels, "labels")
    if blocks.where("blocks > 1").isEmpty():
        final = labels.groupBy("name").agg(F.min("label").alias("label"))
    else:
        final = connected_components(labels.select(F.col("name").alias("u"), F.col("label").alias("v"))).select(
            F.col("v").alias("name"), F.col("component").alias("label")
        )
    final = stage(final.join(reps, "name").select("name", "label", "rep"), "final")
    least = final.groupBy("label").agg(F.min("rep").alias("component_id"))
    linked = reps.join(final.select("name", "label").join(least, "label"), "name", "left").select(
        "name", F.coalesce("component_id", "rep").alias("component_id")
    )
    by_doc = named.join(linked, "name").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return flat.join(by_doc, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )
