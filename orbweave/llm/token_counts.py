"""Token counts: each distinct pre-token is encoded once, per-document frequencies are joined to it.

Blocks of documents become sparse (document, pre-token) frequency matrices.  The distinct pre-tokens
of the blocks are dealt out by hash; each is encoded once, only the number of its pieces goes back to
the blocks, and a matrix product gives the counts.  No ids of a document are ever held.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.textbytes import tidied, tidy
from orbweave.session import shuffle_partitions, stage

BLOCK_BYTES = 8 << 20
#: The pre-tokenisation pattern of byte-level BPE, and its form for texts of ASCII and
#: the letters of Latin-1 only, for which the standard library's engine gives the same pieces.
PATTERN = public_tokenizers.PATTERN
LATIN = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+"
)
UNSAFE = re.compile(r"[^\t\n\r -~À-ÖØ-öø-ÿ]")

_tokenizers: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a vocabulary file, once per process."""
    if path not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def special_splitter(path: str):
    """A pattern of the vocabulary's added tokens, or None."""
    import json

    key = path + "#special"
    if key not in _tokenizers:
        found = sorted((x["content"] for x in json.load(open(path))["added_tokens"]), key=len, reverse=True)
        _tokenizers[key] = re.compile("|".join(map(re.escape, found))) if found else None
    return _tokenizers[key]


def pre_tokens(text: str, tok) -> list[str]:
    """The pieces that are encoded independently; the library's own splitter for unusual characters."""
    if not UNSAFE.search(text):
        return LATIN.findall(text)
    out = [text[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(text)]
    if "".join(out) != text:
        raise ValueError("the pre-tokenizer does not partition the text")
    return out


def _pack(arrays: list[np.ndarray]) -> bytes:
    """Byte planes of uint32 arrays, compressed."""
    flat = np.concatenate(arrays).astype("<u4") if arrays else np.zeros(0, "<u4")
    return zstandard.ZstdCompressor(level=1).compress(flat.view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob, max_output_size=1 << 31), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def _strings(values: list[bytes]) -> bytes:
    lens = np.array([len(x) for x in values], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(np.uint32(len(values)).tobytes() + lens + b"".join(values))


def _read_strings(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob, max_output_size=1 << 31)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64) + 4 + 4 * n
    starts = np.r_[4 + 4 * n, ends[:-1]] if n else ends
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


BLOCK_SCHEMA = (
    "block_id long, doc_ids array<long>, n_bytes array<long>, plain array<long>, matrix binary, "
    "buckets array<struct<bucket:int,tokens:binary>>"
)
BLOCK_ARROW = pa.schema(
    [
        ("block_id", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("n_bytes", pa.list_(pa.int64())),
        ("plain", pa.list_(pa.int64())),
        ("matrix", pa.binary()),
        ("buckets", pa.list_(pa.struct([("bucket", pa.int32()), ("tokens", pa.binary())]))),
    ]
)


def _blocks(path: str, n_buckets: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok, special = tokenizer(path), special_splitter(path)
        seq, part = 0, TaskContext.get().partitionId()
        ids, sizes, plain, freqs = [], [], [], []
        held = 0

        def flush():
            nonlocal seq, held, ids, sizes, plain, freqs
            vocab: dict[str, int] = {}
            rows, cols, vals = [], [], []
            for f in freqs:
                own = np.fromiter((vocab.setdefault(k, len(vocab)) for k in f), np.uint32, len(f))
                rows.append(len(f))
                cols.append(own)
                vals.append(np.fromiter(f.values(), np.uint32, len(f)))
            names = [k.encode() for k in vocab]
            code = np.array([zlib.crc32(k) % n_buckets for k in names], np.int64)
            order = np.array(sorted(range(len(names)), key=lambda i: (code[i], names[i])), np.int64)
            rank = np.empty(len(names), np.uint32)
            rank[order] = np.arange(len(names), dtype=np.uint32)
            deltas = []
            for k, own in enumerate(cols):
                at = rank[own]
                o = np.argsort(at)
                deltas.append(np.diff(at[o], prepend=np.uint32(0)))
                vals[k] = vals[k][o]
            packed = [np.array([len(rows)], np.uint32), np.array(rows, np.uint32), *deltas, *vals]
            cut = np.searchsorted(code[order], np.arange(n_buckets + 1))
            dealt = [
                {"bucket": b, "tokens": _strings([names[i] for i in order[cut[b] : cut[b + 1]]])}
                for b in range(n_buckets)
                if cut[b + 1] > cut[b]
            ]
            out = pa.RecordBatch.from_pylist(
                [
                    {
                        "block_id": (part << 32) | seq,
                        "doc_ids": ids,
                        "n_bytes": sizes,
                        "plain": plain,
                        "matrix": _pack(packed),
                        "buckets": dealt,
                    }
                ],
                schema=BLOCK_ARROW,
            )
            seq, held = seq + 1, 0
            ids, sizes, plain, freqs = [], [], [], []
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                n = len(text) if text.isascii() else len(text.encode())
                own: Counter = Counter()
                marks = 0
                if special is None or not special.search(text):
                    own.update(pre_tokens(text, tok))
                else:
                    segments = special.split(text)
                    marks = len(segments) - 1
                    for x in segments:
                        if x:
                            own.update(pre_tokens(x, tok))
                ids.append(doc_id)
                sizes.append(n)
                plain.append(marks)
                freqs.append(own)
                held += n + 64
                if held >= block_bytes:
                    yield flush()
        if ids:
            yield flush()

    return run


def _count_pieces(path: str):
    def run(table: pa.Table) -> pa.Table:
        tok = tokenizer(path)
        lists = [_read_strings(x.as_py()) for x in table.column("tokens")]
        distinct = list({x for own in lists for x in own})
        pieces: dict[bytes, int] = {}
        for i in range(0, len(distinct), 4096):
            part = distinct[i : i + 4096]
            for k, e in zip(part, tok.encode_batch([x.decode() for x in part], add_special_tokens=False), strict=True):
                pieces[k] = len(e.ids)
        return pa.table(
            {
                "block_id": table.column("block_id"),
                "bucket": table.column("bucket"),
                "pieces": pa.array(
                    [_pack([np.fromiter((pieces[x] for x in own), np.uint32, len(own))]) for own in lists], pa.binary()
                ),
            }
        )

    return run


def _sum_up(left: pa.Table, right: pa.Table) -> pa.Table:
    parts = sorted(zip(right.column("bucket").to_pylist(), right.column("pieces").to_pylist(), strict=True))
    n_pieces = np.concatenate([_unpack(p) for _, p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
    out: dict[str, list] = {"doc_id": [], "n_bytes": [], "n_tokens": []}
    for row in left.to_pylist():
        flat = _unpack(row["matrix"])
        n = int(flat[0])
        sizes = flat[1 : 1 + n].astype(np.int64)
        total = int(sizes.sum())
        deltas, freq = flat[1 + n : 1 + n + total], flat[1 + n + total :].astype(np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        run = np.cumsum(deltas.astype(np.int64))
        base = np.repeat(np.where(starts > 0, run[np.maximum(starts - 1, 0)] if total else 0, 0), sizes)
        weighted = np.r_[0, np.cumsum(freq * n_pieces[run - base])] if total else np.zeros(1, np.int64)
        out["doc_id"] += row["doc_ids"]
        out["n_bytes"] += row["n_bytes"]
        out["n_tokens"] += (weighted[ends] - weighted[starts] + np.array(row["plain"], np.int64)).tolist()
    tidy()
    return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})


def count_tokens(
    docs: DataFrame, tokenizer_path: str | None = None, block_bytes: int = BLOCK_BYTES, limit: int = 1024
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs(doc_id, text)``.

    The counts equal ``Tokenizer.encode(text, add_special_tokens=False)``; added tokens that a text
    spells out count one each, as the library has it by default.  Null and empty texts have no
    tokens.  A null doc_id stays null, repeated rows each give a row, other columns are ignored.
    """
    spark = docs.sparkSession
    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    n_buckets = max(8, 2 * shuffle_partitions(spark))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = stage(rows.mapInArrow(tidied(_blocks(path, n_buckets, block_bytes)), BLOCK_SCHEMA), "tokens", "zstd")
    dealt = blocks.select("block_id", F.explode("buckets").alias("x")).select("block_id", "x.bucket", "x.tokens")
    pieces = dealt.groupBy("bucket").applyInArrow(_count_pieces(path), "block_id long, bucket int, pieces binary")
    counted = (
        blocks.select("block_id", "doc_ids", "n_bytes", "plain", "matrix")
        .groupBy("block_id")
        .cogroup(pieces.groupBy("block_id"))
        .applyInArrow(_sum_up, "doc_id long, n_bytes long, n_tokens long")
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
