"""Packing by the length histogram: shortest-pack-first, then patterns are joined to documents by rank."""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave.llm.token_counts import UNSAFE, special_splitter, tokenizer
from orbweave.llm.textbytes import tidied
from orbweave.session import stage

LENGTH = 2048
END_ID = 1
#: Bytes of words and ids that a worker keeps, about (a cache only, results don't depend on it).
CACHE_BYTES = 48 << 20
#: Marks of words seen once, a byte each.
DOORS = 1 << 20
#: Fixed value: the split pattern of the vocabulary for lower-case texts of ASCII and Latin-1 letters.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+"

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long"


#: Words that tell whether a vocabulary's model can be used alone.
PROBES = ("'s", "'ll", "7", "a", "strength", "über", "çéñøÿ", "|", "--", "\"?!", "façade", "zzzqxj")


def _byte_signs() -> dict[int, str]:
    """The sign that stands for each byte in byte-level vocabularies (itself if printable, else one from 256 on)."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def _pieces_of(tokenize):
    signs = _byte_signs()

    def ids(word: str) -> list[int]:
        raw = word if word.isascii() else "".join(map(signs.__getitem__, word.encode()))
        return [x.id for x in tokenize(raw)]

    return ids


class _WordIds(dict):
    """word -> its ids as little-endian uint32 bytes, encoded on first use.

    There are two generations of half the size; words used again move to the young one, the others go with the old one.
    Most distinct words are rare, so a word is kept from its second time on, as far as DOORS tells.
    """

    def __init__(self, tok):
        super().__init__()
        self.held, self.old = 0, {}
        self.door, self.opened = bytearray(DOORS), 0
        whole, pieces = lambda w: tok.encode(w, add_special_tokens=False).ids, _pieces_of(tok.model.tokenize)
        # the model alone, without the library's splitter, is twice as fast where it gives the same
        self.ids = pieces if all(pieces(w) == whole(w) for w in PROBES) else whole

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            ids = self.ids(word)
            found = struct.pack(f"<{len(ids)}I", *ids)
            at = hash(word) % DOORS
            if not self.door[at]:
                self.door[at] = 1
                self.opened += 1
                if self.opened * 2 > DOORS:
                    self.door, self.opened = bytearray(DOORS), 0
                return found
        self.held += len(found) + len(word) + 170
        if self.held > CACHE_BYTES // 2:
            self.old, self.held = dict(self), 0
            self.clear()
        self[word] = found
        return found


_caches: dict[str, _WordIds] = {}


def encoder(path: str):
    """text -> ids (bytes of little-endian uint32), equal to ``encode(text, add_special_tokens=False)``."""
    import re

    tok, special, find = tokenizer(path), special_splitter(path), re.compile(WORDS).findall
    cache = _caches.setdefault(path, _WordIds(tok))

    def encode(text: str) -> bytes:
        if UNSAFE.search(text) or (special is not None and "<|" in text and special.search(text)):
            return np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(cache.__getitem__, find(text.lower())))

    return encode


def _pieces(path: str, length: int, end_id: int, keep_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(length + 1, np.int64)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth")}
            ids = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = encode(text.as_py() or "") + end
                total = len(raw) // 4
                for start in range(0, total, length):
                    piece = raw[4 * start : 4 * (start + length)]
                    n = len(piece) // 4
                    out["doc_id"].append(doc_id)
                    out["start"].append(start)
                    out["length"].append(n)
                    out["ids_crc32"].append(zlib.crc32(piece))
                    out["doc_tokens"].append(total)
                    out["part"].append(part)
                    out["nth"].append(int(seen[n]))
                    seen[n] += 1
                    if keep_ids:
                        ids.append(np.frombuffer(piece, "<i4").tolist())
            arrays = {k: pa.array(v, pa.int32() if k == "part" else pa.int64()) for k, v in out.items()}
            if keep_ids:
                arrays["ids"] = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(arrays)

    return run


def pack_histogram(counts: dict[int, int], length: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Packing patterns (how many packs, [(piece length, how many of it in a pack)]) for a histogram.

    Goes through the lengths from the longest; each takes the open patterns with the shortest
    content first, one piece a pack at a time, splitting the count of the last pattern used.  What
    fits nowhere opens new packs, each filled with as many pieces of the length as fit.  At most
    two patterns are added for each length and pass, so the list stays bounded by ``length``,
    whatever the number of documents.
    """
    heap: list[tuple[int, int]] = []
    patterns: dict[int, tuple[int, list[tuple[int, int]]]] = {}
    made = 0

    def add(used: int, n: int, content: list[tuple[int, int]]) -> None:
        nonlocal made
        patterns[made] = (n, content)
        if used < length:
            heapq.heappush(heap, (used, made))
        made += 1

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            if heap and heap[0][0] + size <= length:
                used, key = heapq.heappop(heap)
                n, content = patterns.pop(key)
                fits = (length - used) // size
                if left >= n:
                    each = min(fits, left // n)
                    add(used + each * size, n, [*content, (size, each)])
                    left -= each * n
                else:
                    each = min(fits, left)
                    packs = left // each
                    add(used + each * size, packs, [*content, (size, each)])
                    left -= each * packs
                    if n > packs:
                        add(used, n - packs, content)
            else:
                each = min(length // size, left)
                add(each * size, left // each, [(size, each)])
                left -= each * (left // each)
    return list(patterns.values())


def _assign(patterns: list[tuple[int, list[tuple[int, int]]]]):
    """Sorted slot table: for ranks of a length, the pattern's first sequence, packs, multiplicity and offset."""
    rows, taken, first = [], {}, 0
    for n, content in patterns:
        at = 0
        for size, each in content:
            rank = taken.get(size, 0)
            rows.append((size, rank, first, each, at))
            taken[size] = rank + n * each
            at += size * each
        first += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return (table[:, 0] << 40) | table[:, 1], table


def pack(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    length: int = LENGTH,
    end_id: int = END_ID,
    keep_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents of ``docs(doc_id, text)`` with their place in sequences of ``length`` ids.

    Gives doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids if asked for).
    Documents longer than a sequence are cut every ``length`` ids; the rest of each is packed whole.
    Only the histogram (at most ``length`` rows) and the patterns made from it reach the driver.
    Null and empty texts give the end id alone; repeated rows are documents of their own; an empty
    table gives no pieces; other columns are ignored.
    """
    path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = PIECE + (", ids array<int>" if keep_ids else "")
    pieces = stage(rows.mapInArrow(tidied(_pieces(path, length, end_id, keep_ids)), schema), "pieces")
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    keys, table = _assign(pack_histogram(counts, length))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["length", "part"])
    shared = docs.sparkSession.sparkContext.broadcast((keys, table))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + (["ids"] if keep_ids else [])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, table = shared.value
        for batch in batches:
            size = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            slot = table[np.searchsorted(keys, (size << 40) | rank, "right") - 1]
            inside = rank - slot[:, 1]
            cols = {k: batch.column(k) for k in names}
            cols["sequence_id"] = pa.array(slot[:, 2] + inside // slot[:, 3], pa.int64())
            cols["offset"] = pa.array(slot[:, 4] + inside % slot[:, 3] * size, pa.int64())
            yield pa.RecordBatch.from_pydict(cols)

    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    out += (", ids array<int>" if keep_ids else "") + ", sequence_id long, offset long"
    return ranked.select(*names, (F.col("base") + F.col("nth")).alias("rank")).mapInArrow(tidied(place), out)
