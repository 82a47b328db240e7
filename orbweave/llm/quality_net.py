"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks that cover it whole.  Learned filters slide over the byte
codes of each chunk and are max-pooled there; mean and maximum over the chunks go through a hidden
layer to one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orbweave.llm.textbytes import text_column, tidied
from orbweave.llm.toxicity import training_rows

#: Bytes of half a chunk; a chunk is two neighbouring halves, so chunks overlap by half.
HALF = 128
WIDTH, STEP, FILTERS, HIDDEN = 8, 2, 32, 16
#: The fit's sample: so many labelled rows of each class at most, whole texts, with FIT_BYTES a class together.
LOW_ROWS, GOOD_ROWS, FIT_BYTES = 1500, 2500, 8 << 20
EPOCHS, BATCH, RATE = 8, 64, 3e-3
#: Halves that one pass holds.
PASS_HALVES = 1024


def _codes() -> np.ndarray:
    """Fixed codes of all bytes: their class and four pseudo-random values."""
    out = np.zeros((256, 11), np.float32)
    out[97:123, 0] = out[65:91, 1] = out[48:58, 2] = out[32, 3] = out[10, 4] = out[128:, 5] = 1
    for c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
        out[c, 6] = 1
    out[1:, 7:] = np.random.default_rng(7).uniform(-1, 1, (255, 4))
    return out


CODES = _codes()


@dataclass
class Net:
    filters: np.ndarray
    bias: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray


def halves(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row) of all half chunks, zero-padded, each with the WIDTH - STEP bytes after it; every row has one at least."""
    size = np.diff(offsets)
    count = np.maximum(1, -(-size // HALF))
    row = np.repeat(np.arange(len(size)), count)
    start = offsets[row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * HALF
    at = start[:, None] + np.arange(HALF + WIDTH - STEP)
    padded = np.r_[data, np.zeros(1, np.uint8)]
    return np.where(at < offsets[row + 1][:, None], padded[np.minimum(at, len(data))], 0).astype(np.uint8), row


def _patches(raw: np.ndarray) -> np.ndarray:
    x = CODES[raw]
    n, _, d = x.shape
    s = x.strides
    view = np.lib.stride_tricks.as_strided(x, (n, HALF // STEP, WIDTH * d), (s[0], s[1] * STEP, s[2]))
    return view.reshape(n * (HALF // STEP), WIDTH * d)


def _pooled(net: Net, raw: np.ndarray) -> np.ndarray:
    """The filters' maxima over each half, rectified."""
    out = [np.zeros((0, FILTERS), np.float32)]
    for a in range(0, len(raw), PASS_HALVES):
        part = raw[a : a + PASS_HALVES]
        y = (_patches(part) @ net.filters).reshape(len(part), -1, FILTERS)
        out.append(np.maximum(y.max(1) + net.bias, 0))
    return np.concatenate(out)


def _chunks(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(left half, right half) of all chunks: neighbours of one row, or the only half twice."""
    last = np.r_[row[1:] != row[:-1], True]
    first = np.r_[True, row[1:] != row[:-1]]
    left = np.flatnonzero(~last | first)
    return left, np.where(last[left], left, left + 1)


def _document(pooled: np.ndarray, row: np.ndarray, n: int):
    left, right = _chunks(row)
    chunk = np.maximum(pooled[left], pooled[right])
    own = row[left]
    starts = np.searchsorted(own, np.arange(n))
    count = np.diff(np.r_[starts, len(own)])
    mean = np.add.reduceat(chunk, starts) / count[:, None]
    most = np.maximum.reduceat(chunk, starts)
    return np.c_[mean, most].astype(np.float32), (left, right, chunk, own, starts, count, most)


def _summary(net: Net, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean and maximum over the chunks of each row; a row alone goes in pieces of a pass that share a half."""
    if len(offsets) > 2 or len(data) <= PASS_HALVES * HALF:
        raw, row = halves(data, offsets)
        return _document(_pooled(net, raw), row, len(offsets) - 1)[0]
    total, most, count, step = np.zeros(FILTERS), np.zeros(FILTERS, np.float32), 0, (PASS_HALVES - 1) * HALF
    n_halves = -(-len(data) // HALF)
    for a in range(0, n_halves - 1, PASS_HALVES - 1):
        own = min(PASS_HALVES, n_halves - a)
        part = data[a * HALF : a * HALF + step + HALF + WIDTH]
        raw, _ = halves(part, np.array([0, len(part)]))
        pooled = _pooled(net, raw[:own])
        chunk = np.maximum(pooled[:-1], pooled[1:])
        total += chunk.sum(0, dtype=float)
        most = np.maximum(most, chunk.max(0))
        count += len(chunk)
    return np.r_[total / count, most].astype(np.float32)[None]


def predict(net: Net, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    if not n:
        return np.zeros(0)
    out = []
    a = 0
    while a < n:  # rows of about one pass together
        b = int(np.searchsorted(offsets, offsets[a] + PASS_HALVES * HALF, "right")) - 1
        b = min(max(b, a + 1), n, a + PASS_HALVES)
        x = _summary(net, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        z = np.maximum(x @ net.w1 + net.b1, 0) @ net.w2 + net.b2
        out.append(1 / (1 + np.exp(-np.clip(z[:, 0].astype(float), -30, 30))))
        a = b
    return np.concatenate(out)


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 0) -> Net | None:
    """A net from labelled texts, by Adam on the logistic loss; None without both classes."""
    if len(set(labels)) < 2:
        return None
    rng = np.random.default_rng(seed)
    own = []
    for t in texts:
        raw, _ = halves(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))
        own.append(raw)
    y = np.array(labels, np.float32)
    d = WIDTH * CODES.shape[1]
    shapes = {
        "filters": (d, FILTERS), "bias": (FILTERS,), "w1": (2 * FILTERS, HIDDEN), "b1": (HIDDEN,), "w2": (HIDDEN, 1), "b2": (1,),
    }
    p = {k: (rng.normal(0, (2 / s[0]) ** 0.5, s) if len(s) == 2 else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}
    m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(own))
        rate = RATE * (1 - epoch / epochs) + 1e-4
        for a in range(0, len(order), BATCH):
            ids = order[a : a + BATCH]
            raw = np.concatenate([own[i] for i in ids])
            row = np.repeat(np.arange(len(ids)), [len(own[i]) for i in ids])
            passes = range(0, len(raw), 4 * PASS_HALVES)
            where, top = np.empty((len(raw), FILTERS), np.int64), np.empty((len(raw), FILTERS), np.float32)
            for b in passes:
                patches = _patches(raw[b : b + 4 * PASS_HALVES])
                conv = (patches @ p["filters"]).reshape(-1, HALF // STEP, FILTERS)
                here = conv.argmax(1)
                where[b : b + len(conv)] = here
                top[b : b + len(conv)] = np.take_along_axis(conv, here[:, None], 1)[:, 0] + p["bias"]
            pooled = np.maximum(top, 0)
            x, (left, right, chunk, doc, starts, count, most) = _document(pooled, row, len(ids))
            h = np.maximum(x @ p["w1"] + p["b1"], 0)
            z = (h @ p["w2"] + p["b2"])[:, 0]
            dz = ((1 / (1 + np.exp(-z)) - y[ids]) / len(ids))[:, None]
            g = {"w2": h.T @ dz, "b2": dz.sum(0)}
            dh = dz @ p["w2"].T * (h > 0)
            g["w1"], g["b1"] = x.T @ dh, dh.sum(0)
            dx = dh @ p["w1"].T
            dchunk = dx[doc, :FILTERS] / count[doc][:, None] + dx[doc, FILTERS:] * (chunk == most[doc])
            dpool = np.zeros_like(pooled)
            to_left = pooled[left] >= pooled[right]
            np.add.at(dpool, left, dchunk * to_left)
            np.add.at(dpool, right, dchunk * ~to_left)
            dpool *= top > 0
            g["bias"] = dpool.sum(0)
            g["filters"] = np.zeros_like(p["filters"])
            for b in passes:
                if len(passes) > 1:
                    patches = _patches(raw[b : b + 4 * PASS_HALVES])
                here, back = where[b : b + 4 * PASS_HALVES], dpool[b : b + 4 * PASS_HALVES]
                place = here + (np.arange(len(back)) * (HALF // STEP))[:, None]
                g["filters"] += np.stack([back[:, f] @ patches[place[:, f]] for f in range(FILTERS)], 1)
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) + rate * 1e-4 * p[k]
    return Net(**{k: x.astype(np.float32) for k, x in p.items()})


def train(docs: DataFrame, labels: DataFrame, kept) -> Net | None:
    """Fit on the bounded sample; the rarer class is drawn more often, which the last bias makes good."""
    from pyspark.sql import functions as F

    rows = training_rows(docs, labels, "quality", kept, {0: LOW_ROWS, 1: GOOD_ROWS}, FIT_BYTES)
    net = fit([t for t, _ in rows], [y for _, y in rows])
    if net is not None:
        share = labels.where(kept(F.col("doc_id").cast("long"))).agg(F.avg(F.col("quality").cast("double"))).first()[0]
        drawn = sum(y for _, y in rows) / len(rows)
        net.b2 = (net.b2 + np.log(share / (1 - share) * (1 - drawn) / drawn)).astype(np.float32)
    return net


def score(docs: DataFrame, net: Net | None, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all if None) and ``score`` (probability of label 1) of its ``text``.

    Null and empty texts are scored as one chunk of padding; all texts score 1 if no net could be fitted.
    """
    from pyspark.sql import types as T

    shared = docs.sparkSession.sparkContext.broadcast(net)
    kept = [f for f in docs.schema.fields if f.name != "score" and (keep is None or f.name in keep)]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType())])
    names = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.ones(batch.num_rows) if shared.value is None else predict(shared.value, *text_column(batch))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(p)], [*names, "score"])

    return docs.mapInArrow(tidied(run), schema)
