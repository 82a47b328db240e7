"""Chat formatting as a prefix tree: shared initial turns are emitted once, depth first.

Every conversation is a path of turn nodes; a node is known by the hash of all turns up to it.
Conversations sorted by their paths give the depth-first order of the tree, and each adds the nodes
that the one before it doesn't have.  A node gets its place in the emitted sequence, its position id
(the length of what its ancestors emit), the intervals of its ancestors, which are all it attends to
besides itself, and the interval that the loss mask covers.  Lengths are tokens of a vocabulary if
one is given, else code points.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.textbytes import tidied
from orbweave.llm.token_counts import tokenizer
from orbweave.session import release, shuffle_partitions, stage, unstage

#: The marks of the template.
OPEN, CLOSE, HEAD_END = "<|turn|>", "<|end|>", "\n"
#: Strings that mean something to some template; inside texts their first sign gets a backslash.
CONTROL = re.compile(r"([<\[])(\\*)(\|[A-Za-z0-9_]*\|>|/?s>|/?INST\]|/?SYS>>|<SYS>>|</SYS>>|/?think>)")
ESCAPED = re.compile(r"([<\[])\\(\\*)(\|[A-Za-z0-9_]*\|>|/?s>|/?INST\]|/?SYS>>|<SYS>>|</SYS>>|/?think>)")
LEARNED_ROLE = "assistant"


def escape(text: str) -> str:
    """``text`` without control strings; ``unescape`` gives it back."""
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def format_turn(role: str, text: str) -> str:
    head = role.replace("\\", "\\\\").replace("\n", "\\n")
    return f"{OPEN}{escape(head)}{HEAD_END}{escape(text)}{CLOSE}"


def parse_turn(segment: str) -> tuple[str, str, int, int]:
    """(role, text, start and end of the escaped text) of one formatted turn."""
    if not (segment.startswith(OPEN) and segment.endswith(CLOSE)):
        raise ValueError("not a turn")
    head = segment.index(HEAD_END, len(OPEN))
    role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(segment[len(OPEN) : head]))
    start, end = head + len(HEAD_END), len(segment) - len(CLOSE)
    return role, unescape(segment[start:end]), start, end


TURN = (
    "conv_id long, depth int, node binary, parent binary, segment string, ids array<int>, size long, position long, "
    "loss_from long, loss_to long"
)
_TURN = (
    ("conv_id", pa.int64()), ("depth", pa.int32()), ("node", pa.binary()), ("parent", pa.binary()), ("segment", pa.string()),
    ("ids", pa.list_(pa.int32())), ("size", pa.int64()), ("position", pa.int64()), ("loss_from", pa.int64()), ("loss_to", pa.int64()),
)


def _turns(tokenizer_path: str | None):
    """Rows sorted by conversation and turn -> nodes; only the last node of the conversation is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path) if tokenizer_path else None
        last, parent, depth, position = object(), b"", 0, 0
        for batch in batches:
            cols: list[list] = [[] for _ in _TURN]
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text")), strict=True):
                if conv != last:
                    last, parent, depth, position = conv, b"", 0, 0
                segment = format_turn(role or "", text or "")
                _, _, start, end = parse_turn(segment)
                ids, size = None, len(segment)
                if tok is not None:  # head, text and tail have tokens of their own, so that the mask ends between tokens
                    cut = (segment[:start], segment[start:end], segment[end:])
                    parts = [tok.encode(x, add_special_tokens=False).ids for x in cut]
                    ids, start, end = sum(parts, []), len(parts[0]), len(parts[0]) + len(parts[1])
                    size = len(ids)
                learned = role == LEARNED_ROLE
                node = hashlib.blake2b(parent + segment.encode(), digest_size=16).digest()
                row = (conv, depth, node, parent, segment, ids, size, position, start if learned else None, end if learned else None)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
                parent, depth, position = node, depth + 1, position + size
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, (_, k) in zip(cols, _TURN, strict=True)], names=[n for n, _ in _TURN]
            )

    return run


def conversation_turns(conversations: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """A row of each turn: conv_id, depth, node, parent, segment, ids, size, position, and the mask's bounds in the turn."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )
    n = shuffle_partitions(conversations.sparkSession)
    ordered = rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(tidied(_turns(tokenizer_path)), TURN)


def prefix_tree(turns: DataFrame) -> DataFrame:
    """Nodes in emitted order: shard, start, end, run, node, parent, depth, position, segment, ids, loss, intervals, attends.

    ``start`` and ``end`` are places in the sequence of the shard, and so are those of ``loss``, what the
    loss mask covers of the node (null for turns that aren't learned).  Conversations are ranked by
    their paths over the cluster; each emits, in its rank, the nodes that no earlier one has, which is
    the depth-first order.  The order of nodes is then (``run``, the rank of the emitting conversation;
    depth), and a shard is one range of it.  ``intervals`` has the (shard, start, end) that a node
    attends to besides itself, root first, neighbours merged: as many as branches and shard ends lie on
    its path.  ``attends`` has the same place by place, one for each ancestor, so it grows with the
    square of the depth; it is only computed where it is selected.
    """
    spark = turns.sparkSession
    n = shuffle_partitions(spark)
    paths = turns.groupBy("conv_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("depth", "node"))), lambda x: x["node"]).alias("path")
    )
    # one path of each last node: however many conversations are equal, one of them is ranked
    paths = paths.groupBy(F.element_at("path", -1).alias("leaf")).agg(F.first("path").alias("path"))
    ranked = paths.select("path").repartitionByRange(n, "path").sortWithinPartitions("path")
    ranked = stage(ranked.select(F.monotonically_increasing_id().alias("run"), "path"), "ranked")
    steps = ranked.select("run", F.posexplode("path").alias("depth", "node"))
    # one row a distinct node: a first turn that a third of all conversations share is merged by partial aggregation
    names = ["run", "node", "parent", "depth", "position", "segment", "ids"]
    held = ["parent", "depth", "position", "segment", "ids", "size", "loss_from", "loss_to"]
    nodes = turns.groupBy("node").agg(*(F.first(c).alias(c) for c in held))
    nodes = stage(nodes.join(steps.groupBy("node").agg(F.min("run").alias("run")), "node"), "nodes")
    release(spark)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            lens = batch.column("size").to_pylist()
            starts = []
            for k in lens:
                starts.append(at)
                at += k
            ends = [a + k for a, k in zip(starts, lens, strict=True)]
            bounds = zip(starts, batch.column("loss_from").to_pylist(), batch.column("loss_to").to_pylist(), strict=True)
            loss = [None if x is None else {"start": a + x, "end": a + y} for a, x, y in bounds]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard] * len(lens), pa.int32()),
                    pa.array(starts, pa.int64()),
                    pa.array(ends, pa.int64()),
                    *(batch.column(c) for c in names),
                    pa.array(loss, pa.struct([("start", pa.int64()), ("end", pa.int64())])),
                ],
                names=["shard", "start", "end", *names, "loss"],
            )

    schema = (
        "shard int, start long, end long, run long, node binary, parent binary, depth int, position long, segment string, "
        "ids array<int>, loss struct<start:long,end:long>"
    )
    ordered = nodes.select(*names, "size", "loss_from", "loss_to")
    ordered = ordered.repartitionByRange(n, "run", "depth").sortWithinPartitions("run", "depth")
    placed = stage(ordered.mapInArrow(tidied(emit), schema), "tree")
    unstage(nodes)
    release(spark)
    return _with_attends(_with_intervals(placed, steps), ranked)


def _with_intervals(placed: DataFrame, steps: DataFrame) -> DataFrame:
    """``placed`` with ``intervals``, from what each path takes of each emitting run."""
    spots = placed.select("node", F.col("run").alias("owner"), "shard", "start", "end")
    emitting = placed.select("run").distinct()
    taken = (
        steps.join(emitting, "run", "left_semi")
        .join(spots, "node")
        .groupBy("run", "owner", "shard")
        .agg(F.min("depth").alias("low"), F.min("start").alias("start"), F.max("end").alias("end"))
    )
    lists = taken.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("low", "owner", "shard", "start", "end"))).alias("taken"))
    own = lambda x: (x["owner"] == F.col("run")) & (x["shard"] == F.col("shard"))
    spot = lambda x: F.struct(
        x["shard"].alias("shard"), x["start"].alias("start"), F.when(own(x), F.col("start")).otherwise(x["end"]).alias("end")
    )
    above = F.transform(F.filter("taken", lambda x: x["low"] < F.col("depth")), spot)
    none = F.array().cast("array<struct<shard:int,start:long,end:long>>")

    def merge(done, x):
        last = F.element_at(done, -1)
        longer = F.struct(last["shard"].alias("shard"), last["start"].alias("start"), x["end"].alias("end"))
        follows = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["shard"] == x["shard"]) & (
            F.try_element_at(done, F.lit(-1))["end"] == x["start"]
        )
        return F.when(follows, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(
            F.concat(done, F.array(x))
        )

    return placed.join(lists, "run").withColumn("intervals", F.aggregate(above, none, merge)).drop("taken")


def _with_attends(placed: DataFrame, ranked: DataFrame) -> DataFrame:
    """``placed`` with ``attends``, the place of every single ancestor."""
    spots = placed.select(F.col("node").alias("up"), F.struct("shard", "start", "end").alias("spot"))
    above = (
        placed.where("depth > 0")
        .select("run", "node", "depth")
        .join(ranked, "run")
        .select("node", F.posexplode(F.slice("path", F.lit(1), F.col("depth"))).alias("level", "up"))
        .join(spots, "up")
        .groupBy("node")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("level", "spot"))), lambda x: x["spot"]).alias("attends"))
    )
    none = F.array().cast("array<struct<shard:int,start:long,end:long>>")
    return placed.join(above, "node", "left").withColumn("attends", F.coalesce("attends", none))


DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
    "attended_chars long"
)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Emitted turns sorted by conversation and depth -> digests; holds one conversation's hashes only."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "attended_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    now, state = object(), None

    def row():
        return (now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5])

    def packed(rows):
        cols = list(zip(*rows, strict=True)) or [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    for batch in batches:
        done = []
        wanted = ("conv_id", "segment", "attended", "loss_from", "loss_to")
        for conv, segment, attended, a, b in zip(*(batch.column(c).to_pylist() for c in wanted), strict=True):
            if state is None or conv != now:
                if state is not None:
                    done.append(row())
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            role, text, _, _ = parse_turn(segment)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            if a is not None:
                masked = unescape(segment[a:b])
                state[2] += len(masked)
                state[3].update(masked.encode())
            state[4] += len(segment)
            state[5] = attended
        yield packed(done)
    if state is not None:
        yield packed([row()])


def read_back(turns: DataFrame, tree: DataFrame) -> DataFrame:
    """Digests of every conversation, from the tree's emitted text along its path, for trees laid out in code points.

    Masked text is what the tree's ``loss`` intervals cover, taken back from its escaped form.
    ``attended_chars`` is what the last turn attends to before itself.
    """
    n = shuffle_partitions(turns.sparkSession)
    path = turns.select("conv_id", "depth", "node")
    attended = F.aggregate("intervals", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    mask = [(F.col(f"loss.{k}") - F.col("start")).alias(f"loss_{n}") for k, n in (("start", "from"), ("end", "to"))]
    nodes = tree.select("node", "segment", attended.alias("attended"), *mask)
    found = path.join(nodes, "node").select("conv_id", "depth", "segment", "attended", "loss_from", "loss_to")
    ordered = found.repartition(n, "conv_id").sortWithinPartitions("conv_id", "depth")
    return ordered.mapInArrow(tidied(_read_back), DIGEST)


def format_chats(conversations: DataFrame, tokenizer_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(turns, tree) of ``conversations(conv_id, turn, role, text)``.

    With a vocabulary file the tree's places are tokens and its nodes have their ids, else they are
    code points.  Rows go by turn; equal turns by role and text, and repeated rows are turns of their
    own.  Null roles and texts are empty; a null conv_id is a conversation of its own; an empty table
    gives empty results; other columns are ignored.
    """
    turns = stage(conversation_turns(conversations, tokenizer_path), "turns")
    return turns, prefix_tree(turns)
