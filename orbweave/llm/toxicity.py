"""Toxicity by compression distance: zstandard dictionaries trained on toxic and on ordinary text.

Both dictionaries hold the same part that zstandard's trainer took from ordinary windows, and then a
part of its own class: for toxic text, what the trainer takes from those windows of toxic documents
that other toxic documents help to compress and ordinary text doesn't; for ordinary text, what it
takes from windows of ordinary documents.  A window's distance is the difference of its compressed
lengths with either; how often it passes each of several thresholds, with weights calibrated on
labelled rows that the dictionaries of their fold haven't seen, gives a document's score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave.llm.textbytes import chunks, mix, text_column, tidied

WINDOW, STRIDE = 64, 48
#: The fit's sample: so many labelled rows of each class at most, whole texts, with FIT_BYTES a class together.
TOXIC_ROWS, ORDINARY_ROWS, FIT_BYTES = 2000, 4000, 12 << 20
#: Bytes of the shared and the own part of a dictionary, and the trainer's segment and d-mer lengths for each.
SHARED_BYTES, OWN_BYTES = 16_000, 1200
SHARED_KD, OWN_KD = (24, 8), (12, 6)
#: Windows that train the shared part; they are drawn evenly from all of the sample's.
SHARED_WINDOWS = 30_000
#: Telling windows: their bytes and step, those of the coarse windows looked at before, and the bytes that others save.
FINE, FINE_STEP, COARSE, COARSE_STEP, SAVED = 14, 4, 48, 34, 4
#: Parts of the toxic documents; a window is looked for in the other parts.  Bytes of ordinary text that it is held against.
PARTS, GROUND_BYTES = 2, 2 << 20
THRESHOLDS = (1, 2, 3, 4, 6)
LEVEL = 3
#: Text that stands before every window whose cost is taken, and last in the dictionaries: frames of few bytes aren't compressed at all.
LEAD = bytes(range(33, 73))


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


def _trained(windows: list[bytes], size: int, kd: tuple[int, int]) -> bytes:
    """``size`` bytes of content that zstandard's trainer takes from ``windows``.

    The trainer needs more text than it gives; windows that hold too little of it are the content themselves.
    """
    if sum(map(len, windows)) < 8 * size:
        return b"".join(windows)[-size:]
    # the trainer's header and entropy tables come first and take 600 bytes at most
    return zstandard.train_dictionary(size + 600, windows, k=kd[0], d=kd[1]).as_bytes()[-size:]


class _Ground:
    """What windows cost, in bytes, with some content as the dictionary."""

    def __init__(self, content: bytes):
        self.params = zstandard.ZstdCompressionParameters(
            window_log=24, hash_log=20, chain_log=21, search_log=6, min_match=4, target_length=64,
            strategy=zstandard.STRATEGY_BTOPT, write_checksum=False, write_content_size=False, write_dict_id=False,
        )
        self.content = zstandard.ZstdCompressionDict(content + LEAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.content.precompute_compress(compression_params=self.params)

    def cost(self, windows: list[bytes]) -> np.ndarray:
        size = np.array([len(LEAD) + len(w) for w in windows], np.int64)
        start = np.cumsum(size) - size
        data = b"".join([LEAD + w for w in windows])
        frames = zstandard.BufferWithSegments(data, np.stack([start, size], 1).astype("<u8").tobytes())
        press = zstandard.ZstdCompressor(dict_data=self.content, compression_params=self.params)
        return np.fromiter(map(len, press.multi_compress_to_buffer(frames, threads=2)), np.int64, len(windows))


def _cut(text: bytes, size: int, step: int) -> list[bytes]:
    return [text[i : i + size] for i in range(0, max(1, len(text) - size + step), step)]


def _telling(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Windows of toxic documents that cost SAVED bytes less with other toxic documents than with as much ordinary text."""
    parts = [toxic[k::PARTS] for k in range(PARTS)]
    others = [b"".join(t for j, p in enumerate(parts) if j != k for t in p)[-GROUND_BYTES:] for k in range(PARTS)]
    ground = b"".join(ordinary)[-(GROUND_BYTES + max(map(len, others))) :]
    without, found = _Ground(ground), []
    for own, more in zip(parts, others, strict=True):
        windows = [w for t in own for w in _cut(t, COARSE, COARSE_STEP)]
        beside = _Ground(ground[len(more) :] + more)
        for size, step in ((FINE, FINE_STEP), (0, 0)):
            if not windows:
                break
            saved = without.cost(windows) - beside.cost(windows)
            windows = [w for w, x in zip(windows, saved.tolist(), strict=True) if x >= SAVED]
            if size:
                windows = [x for w in windows for x in _cut(w, size, step)]
        found += windows
    return found


def _dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """(ordinary, toxic) dictionary contents of equal size."""
    windows = [w for t in ordinary for w in _cut(t, WINDOW, WINDOW)]
    windows = windows[:: -(-len(windows) // SHARED_WINDOWS)]
    shared = _trained(windows, SHARED_BYTES, SHARED_KD)
    side = _trained(_telling(toxic, ordinary), OWN_BYTES, OWN_KD)
    plain = _trained([w[:FINE] for w in windows], OWN_BYTES, OWN_KD)
    size = min(len(side), len(plain))
    return shared + plain[len(plain) - size :], shared + side[len(side) - size :]


class Distance:
    """Windows of texts -> difference of their compressed lengths."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.sides = []
        for content in (ordinary, toxic):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.sides.append(
                zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
            )

    def windows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distance, row) of overlapping windows that cover each row; an empty row has none."""
        size = np.diff(offsets)
        count = np.where(size > 0, 1 + np.maximum(0, -(-(size - WINDOW) // STRIDE)), 0)
        row = np.repeat(np.arange(len(size)), count)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        start = offsets[row] + inside * STRIDE
        length = np.minimum(WINDOW, offsets[row + 1] - start)
        if not len(row):
            return np.zeros(0, np.int64), row
        frames = zstandard.BufferWithSegments(data.tobytes(), np.stack([start, length], 1).astype("<u8").tobytes())
        sizes = [
            np.fromiter(map(len, side.multi_compress_to_buffer(frames, threads=1)), np.int64, len(row)) for side in self.sides
        ]
        return sizes[0] - sizes[1], row

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = [np.zeros((0, 3 + 2 * len(THRESHOLDS)))]
        for a, b in chunks(offsets):
            d, row = self.windows(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            n = np.bincount(row, minlength=b - a).astype(float)
            most = np.zeros(b - a)
            np.maximum.at(most, row, d)
            cols = [most, np.log1p(n), np.bincount(row, np.maximum(d, 0), b - a) / np.maximum(n, 1)]
            for t in THRESHOLDS:
                c = np.bincount(row, d >= t, b - a)
                cols += [np.log1p(c), c / np.maximum(n, 1)]
            out.append(np.stack(cols, 1))
        return np.concatenate(out)


def _features(distance: Distance, texts: list[bytes]) -> np.ndarray:
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    return distance.features(np.frombuffer(b"".join(texts), np.uint8), offsets)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    a = np.c_[np.ones(len(x)), x]
    w = np.zeros(a.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _without_copies(pairs: list[tuple[bytes, int]]) -> list[tuple[bytes, int]]:
    """The texts without near copies of earlier ones, whose chance content would look like a mark of their class."""
    out, seen = [], set()
    for text, y in pairs:
        raw = np.frombuffer(text, np.uint8).astype(np.uint64)
        acc = np.zeros(max(len(raw) - 23, 0), np.uint64)
        for k in range(24):
            acc = acc * np.uint64(0x9E3779B97F4A7C15) + raw[k : k + len(acc)]
        acc = mix(acc)
        own = set(acc[acc < np.uint64(1 << 60)].tolist())
        if len(own & seen) * 10 <= len(own) * 3:
            out.append((text, y))
        seen |= own
    return out


def _shuffled(pair: tuple[bytes, int]) -> tuple[int, bytes, int]:
    """An order that doesn't follow the texts, the same in every run."""
    return zlib.crc32(pair[0]), *pair


def fit(texts: list[str], toxic: list[int], share: float | None = None) -> Model | None:
    """A model from labelled texts; None without both classes.

    ``share`` is the share of toxic ones among all labelled texts, if the given ones aren't drawn evenly.
    """
    pairs = _without_copies(
        sorted({(b" " + (t or "").encode(), int(y)) for t, y in zip(texts, toxic, strict=True)}, key=_shuffled)
    )
    if len({y for _, y in pairs}) < 2:
        return None
    y = np.array([v for _, v in pairs])
    fold = np.zeros(len(y), int)
    for v in (0, 1):
        fold[y == v] = np.arange((y == v).sum()) % 2
    x = None
    for f in (0, 1):
        seen = [p for p, k in zip(pairs, fold, strict=True) if k != f]
        ordinary, side = _dictionaries([t for t, v in seen if v], [t for t, v in seen if not v])
        own = _features(Distance(ordinary, side), [p[0] for p, k in zip(pairs, fold, strict=True) if k == f])
        x = np.zeros((len(y), own.shape[1])) if x is None else x
        x[fold == f] = own
    mean, scale = x.mean(0), x.std(0) + 1e-9
    w = _logistic((x - mean) / scale, y)
    # the cut at 0.5 is moved to where it separates the folds' labels best
    z = w[0] + (x - mean) / scale @ w[1:]
    order = np.argsort(-z)
    weight = np.ones(len(y))
    if share:
        weight[y == 0] = y.sum() * (1 - share) / share / (y == 0).sum()
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.cumsum(weight[order]) + y.sum())
    best = int(np.argmax(f1))
    cut = (z[order][best] + z[order][min(best + 1, len(z) - 1)]) / 2
    w[0] -= cut
    ordinary, side = _dictionaries([t for t, v in pairs if v], [t for t, v in pairs if not v])
    return Model(ordinary, side, mean, scale, w)


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, kept, limits: dict[int, int], limit_bytes: int
) -> list[tuple[str, int]]:
    """A bounded sample of labelled texts, each whole: of every class the first rows in an order by hash.

    There are at most ``limits`` of them, and as many as have ``limit_bytes`` together.  Rows that share a
    doc_id count as one (the text of the least hash), and so does a doc_id labelled more than once (each label).
    """
    key = F.col("doc_id").cast("long")
    known = labels.select(key.alias("doc_id"), F.col(label).cast("int").alias("y")).where(kept(key) & F.col("y").isNotNull())
    picked = None
    for y, n in limits.items():
        part = known.where(F.col("y") == y).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        picked = part if picked is None else picked.union(part)
    text = docs.select(key.alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # at most sum(limits) rows, so this side may be broadcast
    found = text.join(F.broadcast(picked), "doc_id")
    one = found.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    order = Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id")
    sized = one.select("y", "doc_id", "t.text", F.sum(F.octet_length("t.text")).over(order).alias("bytes"))
    return [(r["text"], r["y"]) for r in sized.where(F.col("bytes") <= limit_bytes).orderBy("y", "bytes", "doc_id").collect()]


def crc_mod(key, n: int):
    return F.crc32(key.cast("string").cast("binary")) % n


def train(docs: DataFrame, labels: DataFrame, kept=None) -> Model | None:
    kept = kept or (lambda key: F.lit(True))
    rows = training_rows(docs, labels, "toxic", kept, {1: TOXIC_ROWS, 0: ORDINARY_ROWS}, FIT_BYTES)
    share = labels.where(kept(F.col("doc_id").cast("long"))).agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    return fit([t for t, _ in rows], [y for _, y in rows], share)


def score(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all if None) and ``score`` (0 to 1) of its ``text``.

    Windows cover the whole text; null and empty texts have the score of no windows, and all texts
    score 0 if no model could be fitted.
    """
    from pyspark.sql import types as T

    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name != "score" and (keep is None or f.name in keep)]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType())])
    names = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        distance = Distance(m.ordinary, m.toxic) if m else None
        for batch in batches:
            if m is None:
                p = np.zeros(batch.num_rows)
            else:
                x = (distance.features(*text_column(batch)) - m.mean) / m.scale
                p = 1 / (1 + np.exp(-np.clip(m.weights[0] + x @ m.weights[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(p)], [*names, "score"])

    return docs.mapInArrow(tidied(run), schema)
