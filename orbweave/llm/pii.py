"""Personal data: validated base patterns, widened by bootstrapped contextual extraction.

Seeds are the spans of the base patterns and, for secrets, strings of a known form.  What stands
beside a seed (words and signs to its left, to its right, on both sides) and the shape of the seed
itself form lexical patterns; Spark scores the bipartite graph of patterns and instances in rounds,
and patterns that mostly go with known identifiers of one kind uncover further ones that no base
pattern matches: secrets, numbers run together, identifiers of unusual form.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbweave.llm.textbytes import tidied
from orbweave.session import stage

KINDS = ("email", "ip", "card", "phone", "secret")
#: The kinds that have a base pattern; secrets are only found by their context.
BASE_KINDS, SECRET = 4, 4
#: The base patterns.  Runs of digits are taken whole, which changes no match but keeps long ones linear.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
#: Further identifiers: a run without spaces that has digits or an at sign, looked for from the run's first sign only.
CANDIDATE = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")
#: Seeds of secrets, whole: hexadecimal digests, and keys of well-known forms.
SECRET_SEED = re.compile(
    r"(?:[0-9a-f]{16,20}|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|akia[0-9a-z]{16}|gh[opsur]_[0-9a-z]{36}|sk-[0-9a-z_-]{20,})\Z"
)
PIECE = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
#: Signs on the same line that count as context on each side, and the longest instance whose shape is a pattern.
CONTEXT_CHARS, SHAPE_CHARS = 80, 40
#: Rounds of scoring; a pattern needs so many distinct seeds of a kind, and its score has SMOOTH instances of score 0.
ROUNDS, MIN_SEEDS, SMOOTH, MIN_PATTERN, MIN_INSTANCE = 3, 3, 2, 0.6, 0.5
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if k % 2:
            x = 2 * x - 9 if x > 4 else 2 * x
        total += x
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches; the local part is the run before an at sign, so only at signs are visited."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        step = 64
        while True:  # the run can be longer than one look back
            lo = max(done, at - step)
            m = LOCAL.search(text, lo, at) if lo < at else None
            start = m.start() if m else at
            if start > lo or lo == done:
                break
            step *= 8
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind as in KINDS, then start."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGITS.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(x) <= 3 or not x.strip("0") or len(x.lstrip("0")) <= 3 for x in m[0].split(".")) and all(
            int(x[-4:] if len(x) > 4 else x) <= 255 for x in m[0].split(".")
        ):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def can_be(word: str) -> int:
    """The kinds (a bit each) whose form ``word`` has; what a base pattern's own check refuses is never of its kind."""
    digits = sum("0" <= c <= "9" for c in word)
    plain = digits == len(word) - sum(c in " -" for c in word)
    out = 0
    if "@" in word[1:-1]:
        out |= 1
    if digits >= 4 and word.count(".") + word.count(":") >= 2 and not IP.fullmatch(word):
        out |= 2
    if digits >= 12 and not (plain and 13 <= digits <= 19):
        out |= 4
    if 7 <= digits <= 15 and all(c in "+0123456789().-/ " for c in word):
        out |= 8
    if len(word) >= 8 and 0 < digits < len(word) and not any(c in " @/" for c in word):
        out |= 1 << SECRET
    return out


def contexts(text: str, start: int, end: int) -> list[str]:
    """The patterns of a place: two and three pieces to the left, two to the right, one on each side; and its own form.

    Forms are the shape of a short string, and the length and first four letters of one that begins with as many.
    """
    lo = max(0, start - CONTEXT_CHARS)
    left = PIECE.findall(text[lo:start].rpartition("\n")[2].lower())
    right = PIECE.findall(text[end : end + CONTEXT_CHARS].partition("\n")[0].lower())
    out = [f"l{n} {' '.join(left[-n:])}" for n in (2, 3) if len(left) >= n]
    if len(right) >= 2:
        out.append(f"r2 {' '.join(right[:2])}")
    if left and right:
        out.append(f"b1 {left[-1]} {right[0]}")
    word = text[start:end]
    if end - start <= SHAPE_CHARS and not word.isdigit():
        out.append("s " + "".join("9" if "0" <= c <= "9" else "a" if c.isalpha() else c for c in word))
    if end - start >= 8 and word[:4].isalpha():
        out.append(f"p {word[:4].lower()} {end - start}")
    return out


def _instance(word: str) -> str:
    """What stands for an identifier in the graph: itself in lower case, or a digest of a long one."""
    low = word.lower()
    return low if len(low) <= 64 else "#" + hashlib.blake2b(low.encode(), digest_size=16).hexdigest()


def _phones(text: str, taken) -> Iterator[tuple[int, int]]:
    """Of a run that begins like a phone number and has too many digits: the longest part up to a space that hasn't."""
    for m in PHONE.finditer(text):
        if sum(c.isdigit() for c in m[0]) > 15 and (cut := re.match(r"(?:\D*\d){9,15}(?= )", m[0])):
            if not taken(m.start(), m.start() + cut.end()):
                yield m.start(), m.start() + cut.end()


def occurrences(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, str, list[str]]]:
    """(kind or -1, start, end, kinds it can be, instance, patterns) of seeds and of candidates outside base spans."""
    out = [(k, a, b, 1 << k, _instance(text[a:b]), contexts(text, a, b)) for k, a, b in base]
    if not _DIGITS.search(text) and "@" not in text:
        return out
    spans = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in spans]
    reach = [-1, *accumulate((b for _, b in spans), max)]

    def taken(a: int, b: int) -> bool:
        return reach[bisect_left(starts, b)] > a

    if "+" in text:
        for a, b in _phones(text, taken):
            out.append((-1, a, b, can_be(text[a:b]), _instance(text[a:b]), contexts(text, a, b)))
    for m in CANDIDATE.finditer(text):
        run, at = m[0], m.start()
        if "=" in run or ":" in run:  # name=value is a name, a sign and a value
            run = run.rstrip("=")
            cut = max(run.rfind("="), run.rfind(":", 0, -1) if "://" not in run and run.count(":") == 1 else -1) + 1
            run, at = run[cut:], at + cut
        word = run.strip(".,;:!?\"'()[]{}<>|*#$%&`=")
        if len(word) < 5 or not (can := can_be(word)):
            continue
        a = at + run.index(word)
        b = a + len(word)
        if not taken(a, b):
            kind = SECRET if SECRET_SEED.match(word.lower()) and can >> SECRET & 1 else -1
            out.append((kind, a, b, can, _instance(word), contexts(text, a, b)))
    return out


SPANS = "array<struct<kind:int,start:int,end:int>>"
SEEN = "array<struct<kind:int,start:int,end:int,can:int,instance:string,contexts:array<string>>>"
_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
_SEEN = pa.struct(
    [*_SPAN, pa.field("can", pa.int32()), pa.field("instance", pa.string()), pa.field("contexts", pa.list_(pa.string()))]
)


def _find(names: list[str], text_name: str, keep: list[str]):
    """Columns ``keep`` of ``names``, and uid, base, seen and open (whether there is a candidate beside base spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 33
        fields = ("kind", "start", "end", "can", "instance", "contexts")
        for batch in batches:
            base_col, seen_col, open_col = [], [], []
            for value in batch.column(names.index(text_name)):
                text = value.as_py() or ""
                base = base_spans(text)
                seen = occurrences(text, base)
                base_col.append([dict(zip(fields, x, strict=False)) for x in base])
                seen_col.append([dict(zip(fields, x, strict=True)) for x in seen])
                open_col.append(len(seen) > len(base))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(names.index(c)) for c in keep),
                    pa.array(range(uid, uid + n), pa.int64()),
                    pa.array(base_col, pa.list_(_SPAN)),
                    pa.array(seen_col, pa.list_(_SEEN)),
                    pa.array(open_col, pa.bool_()),
                ],
                names=[*keep, "uid", "base", "seen", "open"],
            )
            uid += n

    return tidied(run)


def score_graph(edges: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, smooth: int = SMOOTH) -> DataFrame:
    """(context, kind, score, seeds, n) of patterns from distinct ``edges(context, instance, kind, can)``; kind -1 is unknown.

    A pattern's score is the mean score of its instances with ``smooth`` more of score 0; seeds
    count 1 for their own kind and 0 for others, unknown instances (for kinds that they can be) the
    noisy-or of their patterns in the round before.  Patterns with fewer seeds of a kind have none for it.
    """
    edges = stage(edges, "edges")
    sizes = edges.groupBy("context").agg(F.count("*").alias("n"))
    seeds = edges.where("kind >= 0").groupBy("context", "kind").agg(F.count("*").alias("seeds"))
    base = seeds.where(F.col("seeds") >= min_seeds).join(sizes, "context")
    patterns = stage(base.withColumn("score", F.col("seeds") / (F.col("n") + smooth)), "patterns")
    unknown = edges.where("kind < 0").select("context", "instance", "can")
    for _ in range(rounds - 1):
        hits = unknown.join(patterns.select("context", "kind", "score"), "context").where(_possible())
        guess = hits.groupBy("instance", "kind").agg(_noisy_or().alias("s"))
        gain = hits.select("context", "instance", "kind").join(guess, ["instance", "kind"])
        gain = gain.groupBy("context", "kind").agg(F.sum("s").alias("gain"))
        patterns = stage(
            patterns.drop("score", "gain")
            .join(gain, ["context", "kind"], "left")
            .withColumn("score", (F.col("seeds") + F.coalesce("gain", F.lit(0.0))) / (F.col("n") + smooth)),
            "patterns",
        )
    return patterns.select("context", "kind", "score", "seeds", "n")


def _possible():
    return F.expr("(can >> kind) & 1 = 1")


def _noisy_or():
    return 1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))


def _extra(found: DataFrame, min_pattern: float, min_instance: float) -> DataFrame:
    """(uid, extra): the spans that high-confidence patterns add to rows of ``found``, those that have any."""
    seen = found.select("uid", F.explode("seen").alias("s")).select("uid", "s.*")
    seen = seen.select("uid", "kind", "start", "end", "can", "instance", F.explode("contexts").alias("context"))
    patterns = score_graph(seen.select("context", "instance", "kind", "can").distinct())
    patterns = patterns.where(F.col("score") >= min_pattern).select("context", F.col("kind").alias("label"), "score")
    fresh = seen.where(f"kind < 0 OR kind >= {BASE_KINDS}").drop("kind")
    hits = fresh.join(patterns, "context").where(F.expr("(can >> label) & 1 = 1"))
    sure = (
        hits.select("instance", "label", "context", "score").distinct()
        .groupBy("instance", "label")
        .agg(_noisy_or().alias("s"))
        .where(F.col("s") >= min_instance)
        .groupBy("instance")
        .agg(F.max(F.struct("s", (-F.col("label")).alias("label"))).alias("best"))
        .select("instance", (-F.col("best.label")).alias("label"))
    )
    span = F.struct(F.col("label").alias("kind"), "start", "end")
    return hits.join(sure, ["instance", "label"]).groupBy("uid").agg(F.sort_array(F.collect_set(span)).alias("extra"))


_NONE = f"CAST(array() AS {SPANS})"


def find_pii(docs: DataFrame, min_pattern: float = MIN_PATTERN, min_instance: float = MIN_INSTANCE) -> DataFrame:
    """(doc_id, uid, base, extra): spans of every row of ``docs(doc_id, text)``.

    ``base`` has the validated matches, ``extra`` what high-confidence patterns add (never
    overlapping a base span), both as arrays of (kind, start, end) in code points.  Whole texts are
    searched; a pattern takes up to CONTEXT_CHARS signs of the same line on each side.  Candidates
    are runs without spaces with digits or an at sign that have the form of some kind (``can_be``).
    Null and empty texts have no spans; repeated rows give one row each, null doc_ids stay null, an
    empty table gives no rows; other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = f"doc_id long, uid long, base {SPANS}, seen {SEEN}, open boolean"
    found = stage(rows.mapInArrow(_find(["doc_id", "text"], "text", ["doc_id"]), schema), "pii")
    extra = stage(_extra(found, min_pattern, min_instance), "extra")
    return (
        found.select("doc_id", "uid", "base").join(extra, "uid", "left").withColumn("extra", F.coalesce("extra", F.expr(_NONE)))
    )


def spans_text(col):
    """kind:start:end of sorted spans, comma-joined."""
    name = F.element_at(F.array(*map(F.lit, KINDS)), col["kind"] + 1)
    return F.concat_ws(":", name, col["start"].cast("string"), col["end"].cast("string"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_sha256 and spans of what ``find_pii`` returns; n_extra and n_found count the added and all."""
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    joined = lambda c: F.concat_ws(",", F.transform(c, spans_text))
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:BASE_KINDS])),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "extra"))).alias("spans"),
        F.size("extra").cast("long").alias("n_extra"),
        (F.size("base") + F.size("extra")).cast("long").alias("n_found"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by its kind in capitals and brackets, as ``[EMAIL]``.

    All columns stay, whatever their names, and null texts stay null; overlapping spans merge under
    the first one's kind; repeated rows stay.  Rows are searched and written once; only those with
    a candidate beside base spans are joined with what the patterns add, by a number of their own.
    """
    columns = [f"c{k}" for k in range(len(docs.columns))]
    text = columns[docs.columns.index("text")]
    fields = [T.StructField(c, f.dataType, True) for c, f in zip(columns, docs.schema.fields, strict=True)]
    wide = T._parse_datatype_string(f"uid long, base {SPANS}, seen {SEEN}, open boolean")
    rows = docs.toDF(*columns).withColumn(text, F.col(text).cast("string"))
    found = stage(rows.mapInArrow(_find(columns, text, columns), T.StructType([*fields, *wide.fields])), "pii")
    extra = stage(_extra(found, MIN_PATTERN, MIN_INSTANCE), "extra")
    plain = found.where("NOT open").select(*columns, F.col("base").alias("spans"))
    more = found.where("open").join(extra, "uid", "left")
    more = more.select(*columns, F.concat("base", F.coalesce("extra", F.expr(_NONE))).alias("spans"))

    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("spans")
            cols = [batch.column(c) for c in columns]
            marked = [i for i, n in enumerate(own.value_lengths().to_pylist()) if n]
            if marked:
                texts = batch.column(text).to_pylist()
                for i in marked:
                    texts[i] = _replace(texts[i], own[i].as_py())
                cols[columns.index(text)] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, columns)

    return plain.union(more).mapInArrow(tidied(replaced), T.StructType(fields)).toDF(*docs.columns)


def _replace(text: str, spans: list[dict]) -> str:
    out, done = [], 0
    for x in sorted(spans, key=lambda x: (x["start"], x["kind"])):
        if x["start"] >= done:
            out += [text[done : x["start"]], f"[{KINDS[x['kind']].upper()}]"]
        done = max(done, x["end"])
    return "".join(out) + text[done:]
