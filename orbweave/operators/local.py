"""Traversals of graphs whose edges fit into every task: searches in numpy, dealt out by source.

The number of edges is checked first (LOCAL_EDGES); larger graphs go by the rounds of ``traverse`` and
``components``, which give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges that a task may hold: 16 bytes each as they come, three times that while they are sorted.
LOCAL_EDGES = 2_000_000
#: Edges that a task may hold which searches one range of components after the other.
SPLIT_EDGES = 6_000_000
#: Distances that ``levels`` orders in memory (4 bytes each), and the rows that it returns at once.
LEVEL_CELLS, BATCH_ROWS = 40_000_000, 500_000
#: Rows of search state whose bits are unpacked at once.
UNPACKED_ROWS = 1024
#: Words of 64 sources that are searched at once.
WORDS = 8
#: The same in ``Parts``, and the bytes that the state of such a search (three words a vertex and word) may have.
MOST_WORDS, STATE_BYTES = 32, 500_000_000
#: Rows of search state that are worked on at once, few enough for a core's cache.
PULLED_ROWS = 4096


def fits(edges: DataFrame, limit: int | None = None) -> bool:
    """Whether ``edges`` (staged, so that counting is cheap) are few enough."""
    return edges.count() <= (LOCAL_EDGES if limit is None else limit)


class Adjacency:
    """Neighbours of every vertex in one array; ``ids`` are the vertices that have any, ascending."""

    def __init__(self, src: np.ndarray, dst: np.ndarray):
        self.ids, flat = np.unique(np.concatenate([src, dst]), return_inverse=True)
        a, b = flat[: len(src)], flat[len(src) :]
        order = np.argsort(a, kind="stable")
        self.targets = b[order].astype(np.int32)
        self.starts = np.searchsorted(a[order], np.arange(len(self.ids) + 1))

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Places of those of ``ids`` that have neighbours."""
        at = np.minimum(np.searchsorted(self.ids, ids), max(len(self.ids) - 1, 0))
        return at[self.ids[at] == ids] if len(self.ids) else np.zeros(0, np.int64)

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all neighbours of ``rows``, where each row's begin)."""
        return _listed(self.starts, self.targets, rows)

    def fed_by(self, rows: np.ndarray) -> np.ndarray:
        """Places that have neighbours among ``rows``; edges are symmetric here."""
        return self.of(rows)[0]


def _listed(starts: np.ndarray, targets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = starts[rows + 1] - starts[rows]
    first = np.cumsum(n) - n
    return targets[np.repeat(starts[rows] - first, n) + np.arange(n.sum())], first


def collect_edges(edges: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(src, dst) of edges that ``fits`` has let through."""
    table = edges.select("src", "dst").toArrow()
    return tuple(np.asarray(table.column(c).to_numpy(), np.int64) for c in ("src", "dst"))


def distance(edges: DataFrame, a: int, b: int) -> int:
    """Hops from a to b, in one task; -1 if there is no path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[x.column(c).to_numpy(zero_copy_only=False) for c in ("src", "dst")] for x in batches]
        found = -1
        if parts:
            graph = Adjacency(*(np.concatenate([p[k] for p in parts]) for k in (0, 1)))
            now, goal = graph.places(np.array([a])), graph.places(np.array([b]))
            seen = np.zeros(len(graph.ids), bool)
            seen[now] = True
            depth = 0
            while len(now) and len(goal):
                if seen[goal[0]]:
                    found = depth
                    break
                near = np.unique(graph.of(now)[0])
                now = near[~seen[near]]
                seen[now] = True
                depth += 1
        yield pa.RecordBatch.from_arrays([pa.array([found], pa.int64())], names=["d"])

    return edges.select("src", "dst").coalesce(1).mapInArrow(run, "d long").agg(F.max("d")).first()[0]


def _pull(graph: Adjacency, rows: np.ndarray, now: np.ndarray) -> np.ndarray:
    """The words of ``now`` of all neighbours of each of ``rows`` (of falling degree) or-ed: first neighbours, then second ones, ..."""
    first = graph.starts[rows]
    less = first - graph.starts[rows + 1]  # ascending
    out = np.take(now, graph.targets[first], axis=0, mode="clip")
    near = np.empty_like(out)
    for k in range(1, -int(less[0])):
        n = np.searchsorted(less, -k)
        np.take(now, graph.targets[first[:n] + k], axis=0, out=near[:n], mode="clip")
        np.bitwise_or(out[:n], near[:n], out=out[:n])
    return out


def _any(words: np.ndarray) -> np.ndarray:
    """Whether a row has any bit; by columns, since numpy reduces short rows slowly."""
    found = words[:, 0].copy()
    for k in range(1, words.shape[1]):
        found |= words[:, k]
    return found != 0


def _counts(words: np.ndarray) -> np.ndarray:
    """Bits of every row."""
    found = np.bitwise_count(words[:, 0]).astype(np.int64)
    for k in range(1, words.shape[1]):
        found += np.bitwise_count(words[:, k])
    return found


def _search(graph: Adjacency, sources: np.ndarray, depth: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(level, rows, new bits of them, all bits so far) of a search from some words of 64 places at once; a level comes in parts.

    Against the edges' direction if they aren't symmetric: a row has the bit of a source that it reaches.
    A round takes rows with a neighbour that the round before changed.  Rows that all sources have reached can't change
    any more and leave the rounds.
    """
    k = np.arange(len(sources))
    words = -(-len(sources) // 64)
    seen = np.zeros((len(graph.ids), words), np.uint64)
    seen[sources, k // 64] |= np.uint64(1) << (k % 64).astype(np.uint64)
    full = np.bitwise_or.reduce(seen, 0)
    degree = np.diff(graph.starts)
    now, spare = seen.copy(), np.zeros_like(seen)
    is_open = degree > 0
    rows, old, level = sources, sources[:0], 0
    while len(rows) and (depth is None or level < depth):
        level += 1
        if degree[rows].sum() * 4 < len(graph.targets):
            near = np.zeros(len(graph.ids), bool)
            near[graph.fed_by(rows)] = True
            near &= is_open
        else:
            near = is_open
        near = np.flatnonzero(near)
        _rows_of(spare)[old] = np.zeros(1, _rows_of(spare).dtype)
        hit = []
        for at in range(0, len(near), PULLED_ROWS):
            some = near[at : at + PULLED_ROWS]
            some = some[np.argsort(-degree[some], kind="stable")]
            before = np.take(seen, some, axis=0, mode="clip")
            new = _pull(graph, some, now)
            new &= ~before
            to = np.flatnonzero(_any(new))
            if len(to) < len(some):
                some, new, before = some[to], np.take(new, to, axis=0, mode="clip"), np.take(before, to, axis=0, mode="clip")
            if len(some):
                _rows_of(spare)[some] = _rows_of(new)
                before |= new
                _rows_of(seen)[some] = _rows_of(before)
                is_open[some[~_any(before ^ full)]] = False
                hit.append(some)
                yield level, some, new, seen
        old, rows = rows, np.concatenate([rows[:0], *hit])
        now, spare = spare, now


def _rows_of(words: np.ndarray) -> np.ndarray:
    """Every row as one value, which numpy moves faster than a short row."""
    return words.view(f"V{8 * words.shape[1]}")[:, 0]


def _dealt(spark, n: int, words: int = WORDS):
    """Ranges of 64 * words sources, spread over tasks."""
    blocks = -(-n // (64 * words))
    return spark.range(0, max(blocks, 1), 1, max(1, min(blocks, 4 * spark.sparkContext.defaultParallelism)))


def closeness_sums(edges: DataFrame) -> DataFrame:
    """(v, reached, total): how many others each end of symmetric ``edges`` reaches, and its distances to them."""
    spark = edges.sparkSession
    shared = spark.sparkContext.broadcast(collect_edges(edges))
    n = len(np.unique(shared.value[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = Adjacency(*shared.value)
        reached, total = np.zeros(len(graph.ids), np.int64), np.zeros(len(graph.ids), np.int64)
        for batch in batches:
            for block in batch.column(0).to_pylist():
                sources = np.arange(block * 64 * WORDS, min((block + 1) * 64 * WORDS, len(graph.ids)))
                for level, rows, new, _ in _search(graph, sources, None):
                    count = _counts(new)
                    reached[rows] += count
                    total[rows] += level * count
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (graph.ids, reached, total)], names=["v", "reached", "total"])

    sums = _dealt(spark, n).mapInArrow(run, "v long, reached long, total long")
    return sums.groupBy("v").agg(F.sum("reached").alias("reached"), F.sum("total").alias("total"))


def khop_pairs(edges: DataFrame, vertices: DataFrame, h: int) -> DataFrame:
    """(a, b), a < b: pairs of ``vertices`` (no more than LOCAL_EDGES) within h hops over symmetric ``edges``."""
    spark = edges.sparkSession
    own = np.unique(np.asarray(vertices.select("v").toArrow().column("v").to_numpy(), np.int64))
    shared = spark.sparkContext.broadcast((*collect_edges(edges), own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, dst, ids = shared.value
        graph = Adjacency(src, dst)
        at = graph.places(ids)
        for batch in batches:
            for block in batch.column(0).to_pylist():
                sources = at[block * 64 * WORDS : (block + 1) * 64 * WORDS]
                seen = None
                for _, _, _, seen in _search(graph, sources, h) if len(sources) else ():
                    pass
                if seen is None:
                    continue
                b, a = np.nonzero(np.unpackbits(seen[at].view(np.uint8), axis=1, bitorder="little")[:, : len(sources)])
                a, b = graph.ids[sources[a]], graph.ids[at[b]]
                yield pa.RecordBatch.from_arrays([pa.array(a[a < b]), pa.array(b[a < b])], names=["a", "b"])

    return _dealt(spark, len(own)).mapInArrow(run, "a long, b long")


class Parts:
    """An ``Adjacency`` whose vertices are ordered by weak component, so that a range of components is a graph of its own.

    Within a component they go by a breadth-first search from its least vertex, each behind its parent's other children:
    sources that are searched together lie close together then, and few rounds change each row.
    """

    def __init__(self, src: np.ndarray, dst: np.ndarray):
        ids, label = least_labels(src, dst)
        a, b = (np.searchsorted(ids, x).astype(np.int32) for x in (src, dst))
        out, back = _rows(a, b, len(ids)), _rows(b, a, len(ids))
        order = np.lexsort((_search_order((out, back), np.flatnonzero(ids == label)), label))
        self.ids = ids[order]
        place = np.empty(len(ids), np.int32)
        place[order] = np.arange(len(ids), dtype=np.int32)
        a, b = place[a], place[b]
        del out, back, place
        (self.starts, self.targets), back = _rows(a, b, len(ids)), _rows(b, a, len(ids))
        same = all(np.array_equal(x, y) for x, y in zip((self.starts, self.targets), back, strict=True))
        self.back = None if same else back
        new = np.r_[True, np.diff(label[order]) != 0][: len(ids)]
        self.bounds = np.r_[np.flatnonzero(new), len(ids)]

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Places of those of ``ids`` that are ends, ascending."""
        order = np.argsort(self.ids)
        at = np.minimum(np.searchsorted(self.ids[order], ids), max(len(self.ids) - 1, 0))
        return np.sort(order[at[self.ids[order][at] == ids]]) if len(self.ids) else np.zeros(0, np.int64)

    def around(self, places: np.ndarray) -> tuple[Part, int]:
        """The graph of the components of ``places`` (ascending) and those between, and the place where it begins."""
        lo = self.bounds[np.searchsorted(self.bounds, places[0], "right") - 1]
        hi = self.bounds[np.searchsorted(self.bounds, places[-1], "right")]
        return Part(self, lo, hi), lo


class Part(Adjacency):
    """The places lo to hi of ``Parts``, which no edge leaves."""

    def __init__(self, parts: Parts, lo: int, hi: int):
        cut = lambda starts, targets: (starts[lo : hi + 1] - starts[lo], targets[starts[lo] : starts[hi]] - np.int32(lo))
        self.ids = parts.ids[lo:hi]
        self.starts, self.targets = cut(parts.starts, parts.targets)
        self.back = (self.starts, self.targets) if parts.back is None else cut(*parts.back)

    def fed_by(self, rows: np.ndarray) -> np.ndarray:
        return _listed(*self.back, rows)[0]


def _rows(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, targets) of edges from a to b between n places, each place's targets ascending."""
    key = a.astype(np.int64) << 32
    key |= b
    key.sort()
    return np.r_[0, np.cumsum(np.bincount(a, minlength=n))], key.astype(np.int32)


def _search_order(graphs, roots: np.ndarray) -> np.ndarray:
    """Ranks by breadth-first search from all ``roots`` at once along any of ``graphs``: by depth, then by parents' ranks."""
    rank = np.full(len(graphs[0][0]) - 1, -1)
    now, n = roots, 0
    while len(now):
        rank[now] = np.arange(n, n + len(now))
        n += len(now)
        near = np.concatenate([_listed(*g, now)[0] for g in graphs])
        parent = np.concatenate([np.repeat(np.arange(len(now)), g[0][now + 1] - g[0][now]) for g in graphs])
        new = rank[near] < 0
        near = near[new][np.argsort(parent[new], kind="stable")]
        _, first = np.unique(near, return_index=True)
        now = near[np.sort(first)]
    return rank


def _searched(edges: DataFrame, sources: DataFrame, found, schema: str, back: bool) -> DataFrame:
    """``found(parts, searches)`` of a task's blocks of ``sources(v)``, by (graph, where it begins in parts, places in it, levels).

    ``back``: searched against the edges.  The driver makes the ``Parts`` once; tasks get them ready.
    """
    spark = edges.sparkSession
    own = np.unique(np.asarray(sources.select("v").toArrow().column("v").to_numpy(), np.int64))
    src, dst = collect_edges(edges)
    parts = Parts(dst, src) if back else Parts(src, dst)
    at = parts.places(own)
    fair = -(-len(at) // (256 * spark.sparkContext.defaultParallelism))
    largest = int(np.diff(parts.bounds).max(initial=1))
    words = max(1, min(MOST_WORDS, fair, STATE_BYTES // (24 * largest)))
    shared = spark.sparkContext.broadcast((parts, at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, at = shared.value

        def searches():
            for batch in batches:
                for block in batch.column(0).to_pylist():
                    places = at[block * 64 * words : (block + 1) * 64 * words]
                    if len(places):
                        graph, lo = parts.around(places)
                        yield graph, lo, places - lo, _search(graph, places - lo, None)

        yield from found(parts, searches())

    return _dealt(spark, len(at), words).mapInArrow(run, schema)


def _bits(new: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, 0 or 1 by row and source) for a few rows at a time."""
    for k in range(0, len(new), UNPACKED_ROWS):
        yield k, np.unpackbits(new[k : k + UNPACKED_ROWS].view(np.uint8), axis=1, bitorder="little")[:, :n]


def levels(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(src, v, d), d > 0: the vertices that each of ``sources(v)`` reaches."""

    def batch(src, v, d):
        return pa.RecordBatch.from_arrays([pa.array(src), pa.array(v), pa.array(d.astype(np.int32))], names=["src", "v", "d"])

    def found(parts, searches):
        for graph, _, places, search in searches:
            ids, n = graph.ids[places], len(places)
            if len(graph.ids) * n > LEVEL_CELLS:
                for level, rows, new, _ in search:
                    for k, bits in _bits(new, n):
                        v, src = np.nonzero(bits)
                        yield batch(ids[src], graph.ids[rows[k + v]], np.full(len(v), level))
                continue
            # by v, then src: files of such rows have half the size or less
            depth = np.zeros((len(graph.ids), n), np.int32)
            for level, rows, new, _ in search:
                for k, bits in _bits(new, n):
                    depth[rows[k : k + len(bits)]] += bits * np.int32(level)
            step = max(1, BATCH_ROWS // n)
            for k in range(0, len(depth), step):
                v, src = np.nonzero(depth[k : k + step])
                yield batch(ids[src], graph.ids[k + v], depth[k + v, src])

    return _searched(edges, sources, found, "src long, v long, d int", True)


def sums_from(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(src, total, reached): the distances from each of ``sources(v)`` to the others that it reaches; no row for none."""

    def found(parts, searches):
        for graph, _, places, search in searches:
            total, reached = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
            for level, _, new, _ in search:
                for _, bits in _bits(new, len(places)):
                    count = bits.sum(0, dtype=np.int64)
                    reached += count
                    total += level * count
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (graph.ids[places], total, reached)], names=["src", "total", "reached"])

    return _searched(edges, sources, found, "src long, total long, reached long", True)


def sums_of_all(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """The same from every vertex to all ``vertices``, counted by words: the sources at d of a row are those that it reaches at d."""

    def found(parts, searches):
        total, reached = np.zeros(len(parts.ids), np.int64), np.zeros(len(parts.ids), np.int64)
        for _, lo, _, search in searches:
            for level, rows, new, _ in search:
                count = _counts(new)
                reached[lo + rows] += count
                total[lo + rows] += level * count
        hit = reached > 0
        yield pa.RecordBatch.from_arrays([pa.array(x[hit]) for x in (parts.ids, total, reached)], names=["src", "total", "reached"])

    sums = _searched(edges, vertices, found, "src long, total long, reached long", False)
    return sums.groupBy("src").agg(F.sum("total").alias("total"), F.sum("reached").alias("reached"))


def least_labels(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, the least vertex of each one's component): hooking to lesser labels and pointer jumping."""
    ids, flat = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = flat[: len(src)], flat[len(src) :]
    label = np.arange(len(ids))
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return ids, ids[label]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def largest_by_key(edges: DataFrame, key: str) -> DataFrame:
    """(key, n): vertices of the largest component of each key's ``edges(key, src, dst)``, which fit a task each."""

    def run(table: pa.Table) -> pa.Table:
        _, label = least_labels(*(table.column(c).to_numpy() for c in ("src", "dst")))
        n = int(np.unique(label, return_counts=True)[1].max())
        return pa.table({key: table.column(key)[:1], "n": pa.array([n], pa.int64())})

    return edges.select(key, "src", "dst").groupBy(key).applyInArrow(run, f"{key} long, n long")
