"""Every operator against a brute-force version on small fixtures with nulls, ties, copies and extra columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

tokenizers = pytest.importorskip("tokenizers")

import public_tokenizers  # noqa: E402

from orbweave.llm import chat_tree, decontaminate, ngram_join, packing, pii, quality_net, quality_rules, repeats, token_counts, toxicity  # noqa: E402

DOCS = "doc_id long, text string, lang string, part int, score double"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base = prose(60)
    out = [prose(rng.randint(1, 80)) for _ in range(25)]
    out += [base] * 3
    for _ in range(8):  # near copies
        w = base.split()
        w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    out += ["", None, " \n\t ", "a", "a b c", "aaa " * 900, "x" * 5000, "Ünïcode ñandú <|endoftext|> 日本 🙂\x1c z ½", base + "\n" + base]
    out += ["mail a.b@c-d.example.org or 10.0.0.255 and 4111 1111 1111 1111, +1 (555) 010-9999 x@y", "999.1.1.1 @x a@b 1.2.3.4.5.6.7.8"]
    return out


@pytest.fixture(scope="module")
def rows():
    return list(enumerate(texts()))


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", 7, 0.5) for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_token_counts(docs, empty, rows):
    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: (len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in rows}
    for size in (1, 1 << 20):
        got = {r[0]: (r[1], r[2]) for r in token_counts.count_tokens(docs, block_bytes=size).collect()}
        assert got == want
    assert token_counts.count_tokens(empty).count() == 0


def test_packing(docs, empty, rows):
    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    got = packing.pack(docs, length=64, keep_ids=True).collect()
    seen = collections.defaultdict(dict)
    places = collections.defaultdict(list)
    for r in got:
        seen[r.doc_id][r.start] = r.ids
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.doc_tokens == len(want[r.doc_id])
        places[r.sequence_id].append((r.offset, r.length))
    assert {i: sum((p[k] for k in sorted(p)), []) for i, p in seen.items()} == want
    for own in places.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 64
    assert sorted(places) == list(range(len(places)))
    assert packing.pack(empty).count() == 0


def test_pack_histogram():
    rng = random.Random(1)
    for _ in range(30):
        counts = {rng.randint(1, 100): rng.randint(1, 1000) for _ in range(rng.randint(1, 40))}
        patterns = packing.pack_histogram(counts, 100)
        placed = collections.Counter()
        for n, content in patterns:
            assert n > 0 and sum(s * k for s, k in content) <= 100
            for s, k in content:
                placed[s] += n * k
        assert placed == counts


def brute_pii(text):
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for k, p in kinds.items():
        for m in re.finditer(p, text):
            d = [int(c) for c in m[0] if c.isdigit()]
            odd = sum(d[::-1][::2]) + sum(sum(divmod(2 * x, 10)) for x in d[::-1][1::2])
            ok = {"email": True, "ip": k == "ip" and max(map(int, m[0].split("."))) <= 255, "card": 13 <= len(d) <= 19 and odd % 10 == 0, "phone": 9 <= len(d) <= 15}
            if ok[k]:
                out.append(f"{k}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_pii_base(docs, empty, rows):
    rng = random.Random(3)
    for _ in range(3000):
        t = "".join(rng.choice("ab1234.@+- ()%\n") for _ in range(rng.randint(0, 60)))
        got = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in pii.base_spans(t))
        assert got == brute_pii(t), t
    got = {r.doc_id: r for r in pii.digest(pii.find_pii(docs)).collect()}
    for i, t in rows:
        assert got[i].base_sha256 == hashlib.sha256(brute_pii(t or "").encode()).hexdigest()
        assert got[i].spans == brute_pii(t or "")
    assert pii.find_pii(empty).count() == 0


def test_pii_patterns_find_more(spark):
    good = [(k, f"some words then call hotline +1 (555) 01{k}-{1000 + 7 * k} now") for k in range(6)]
    odd = (99, "more words call hotline 5550-199-77 please")
    far = (100, "the order 5550-199-88 was sent")
    frame = spark.createDataFrame([*good, odd, far, (101, None)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.digest(pii.find_pii(frame)).collect()}
    a = odd[1].index("5550")
    assert got[99] == f"phone:{a}:{a + 11}" and got[100] == "" and got[101] == ""
    red = {r.doc_id: r.text for r in pii.redact(frame).collect()}
    assert red[99] == "more words call hotline [PHONE] please" and red[101] is None and red[0].endswith("hotline [PHONE] now")


def test_chats(spark):
    rng = random.Random(2)
    shared = [("user", "hello </s>"), ("assistant", "[INST] hi <|end|> \\ [\\INST]")]
    data, want = [], {}
    for c in range(40):
        own = (shared if c % 3 else []) + [(rng.choice(["user", "assistant", "system"]), rng.choice(["", "a\nb", "<|turn|>x", None, "<\\\\/s>"])) for _ in range(rng.randint(1, 4))]
        data += [(c, k, r, t, 1) for k, (r, t) in enumerate(own)]
        want[c] = [(r, t or "") for r, t in own]
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, depth int").repartition(5)
    turns, tree = chat_tree.format_chats(frame)
    for r in chat_tree.read_back(turns, tree).collect():
        own = want[r.conv_id]
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        loss = "".join(b for a, b in own if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    nodes = {r.node: r for r in tree.collect()}
    prefixes = {tuple(own[: k + 1]) for own in want.values() for k in range(len(own))}
    assert len(nodes) == len(prefixes)
    spots = {(r.shard, r.start, r.end): r for r in nodes.values()}
    for r in nodes.values():
        up = [spots[(a.shard, a.start, a.end)] for a in r.attends]
        assert len(up) == r.depth and r.position == sum(a.end - a.start for a in up)
        assert not up or up[-1].node == r.parent
    for shard in {r.shard for r in nodes.values()}:
        own = sorted((r.start, r.end) for r in nodes.values() if r.shard == shard)
        assert own[0][0] == 0 and all(a[1] == b[0] for a, b in zip(own, own[1:]))
    t, n = chat_tree.format_chats(frame.where("false"))
    assert chat_tree.read_back(t, n).count() == 0


def test_chat_intervals(spark):
    data = [(c, k, "user", f"t{k}" if k <= c else f"own {c} {k}") for c in range(12) for k in range(c + 2)]
    data += [(99, k, "assistant", f"long {k}") for k in range(200)] + [(None, 0, None, None)]
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(5)
    turns, tree = chat_tree.format_chats(frame)
    for r in tree.collect():
        places = {(a.shard, k) for a in r.attends for k in range(a.start, a.end)}
        merged = [(a.shard, k) for a in r.intervals for k in range(a.start, a.end)]
        assert len(merged) == len(set(merged)) == r.position and set(merged) == places
        assert all(a.shard != b.shard or a.end != b.start for a, b in zip(r.intervals, r.intervals[1:]))
    assert {(r.conv_id, r.n_turns) for r in chat_tree.read_back(turns, tree).collect()} >= {(99, 200), (None, 1)}
    for r in chat_tree.read_back(turns, tree).where("conv_id = 99").collect():
        assert r.formatted_chars - r.attended_chars == len(chat_tree.format_turn("assistant", "long 199"))


def test_escape_round_trip():
    rng = random.Random(4)
    bits = ["<", "[", "\\", "/s>", "s>", "INST]", "/INST]", "|end|>", "|turn|>", "x", "\n"]
    for _ in range(5000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))
        e = chat_tree.escape(t)
        assert chat_tree.unescape(e) == t
        assert not re.search(r"</?s>|\[/?INST\]|<\|\w+\|>", e)
        assert chat_tree.parse_turn(chat_tree.format_turn(t, t))[:2] == (t, t)


def brute_repeats(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if b[k : k + length] in seen:
                gone[k : k + length] = True
            seen.add(b[k : k + length])
        spans = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("length,hot", [(100, 4096), (20, 4096), (20, 2)])
def test_repeats(docs, empty, rows, length, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.find_repeats(docs, length).collect()}
    assert got == brute_repeats(rows, length)
    assert repeats.find_repeats(empty).count() == 0


def test_passes_of_long_texts_join(monkeypatch):
    raw = np.random.default_rng(0).integers(97, 100, 5000).astype(np.uint8)
    whole = repeats.stretches(raw, np.array([0, 1200, 1200, 5000]), 100)
    monkeypatch.setattr(repeats, "PASS_BYTES", 333)
    parts = repeats.stretches(raw, np.array([0, 1200, 1200, 5000]), 100)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def brute_rules(t):
    w = WORD.findall(t or "")
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    c = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    cover = {k + j for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for j in range(8)}
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(lines) - len(set(lines)), len(cover)


def test_quality_rules(spark, docs, empty, rows):
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    for r in quality_rules.judge(docs, labels).collect():
        want = brute_rules(dict(rows)[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and r.kept == (not r.base_failed)
    assert quality_rules.judge(empty, labels).count() == 0


def test_binomial_tail(spark):
    from math import comb

    from pyspark.sql import functions as F

    cases = [(k, n) for n in (1, 5, 60, 900) for k in range(0, min(n, 30) + 1, 3)]
    frame = spark.createDataFrame(cases, "k long, n long")
    for r in frame.select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.05).alias("p")).collect():
        exact = sum(comb(r.n, i) * 0.05**i * 0.95 ** (r.n - i) for i in range(r.k + 1))
        assert r.p == pytest.approx(exact, rel=1e-9) or (r.k >= r.n * 0.05 and r.p == 1.0)


def test_quality_cutoffs_reject_outliers(spark):
    plain = [(i, "word " + " ".join(f"w{i}x{j}" for j in range(30)), "en") for i in range(3000)]
    odd = [(9000 + i, " ".join(f"#$%{i}x{j}|" for j in range(30)), "en") for i in range(20)]
    frame = spark.createDataFrame(plain + odd, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(3000)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in quality_rules.judge(frame, labels, epsilon=0.05).collect()}
    assert not any(kept[9000 + i] for i in range(20)) and sum(kept[i] for i in range(3000)) >= 2850


def brute_join(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("run,block", [(16, 4_000_000), (2, 4_000_000), (2, 150)])
def test_ngram_join(docs, empty, rows, run, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "SHORT_RUN", run)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", block)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_components(docs).collect()}
    assert got == brute_join(rows)
    if run == 16:
        assert ngram_join.link_components(empty).count() == 0


def test_ngram_join_common_ngrams_cluster_nothing(spark, monkeypatch):
    """Phrases in many unrelated documents, few in each pass, go last in prefixes; exact copies are one set."""
    phrases = [" ".join(f"common{i}{k}" for k in "abcd") for i in range(8)]
    own = [(i, " ".join(f"{p} own{i}x{j} own{i}y{j}" for j, p in enumerate(phrases))) for i in range(60)]
    rows = own + [(100 + i, own[0][1].upper()) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(100)
    seen = {}
    keep = lambda df, name, f=ngram_join.stage: seen.setdefault(name, f(df, name))
    monkeypatch.setattr(ngram_join, "stage", keep)
    got = {r.doc_id: r.component_id for r in ngram_join.link_components(docs).collect()}
    assert got == {i: 0 if i >= 100 else i for i, _ in rows}
    assert seen["clusters"].count() == 0


@pytest.mark.parametrize("most", [4_000_000, 0])
def test_ngram_join_shuffles_grams_once(spark, docs, rows, most, monkeypatch):
    """A table tells where the n-grams of clustered sets go; beyond its limit a join does, with the same rows."""
    plans = {}

    def note(df, name, f=ngram_join.stage):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return f(df, name)

    monkeypatch.setattr(ngram_join, "PLACED_SETS", most)
    monkeypatch.setattr(ngram_join, "stage", note)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_components(docs).collect()}
    assert got == brute_join(rows)
    assert ("Join" in plans["labels"]) == (most == 0)


def test_ngram_join_postings_are_small():
    """However few postings a set has in a bucket: 8 bytes for counting runs, 16 for pairs, and they are read back whole."""
    from types import SimpleNamespace

    texts = [" ".join(f"w{i}x{j}" for j in range(200 + i)) for i in range(20)]
    batch = pa.record_batch([pa.array(range(20), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    weights = SimpleNamespace(value=np.zeros(1 << ngram_join.SKETCH_BITS, np.uint8))
    table = SimpleNamespace(value=np.zeros(1 << ngram_join.RUN_BITS, np.uint8))
    sizes = [197 + i for i in range(20)]
    n = sum(k - ngram_join.required(k, 85) + int(ngram_join.common(k)) for k in sizes)
    for runs, width in ((None, 8), (table, 16)):
        out = pa.Table.from_batches(ngram_join._postings(weights, runs, 4, 85, 500)([batch]))
        assert sum(len(x.as_py()) for c in ("keys", "docs", "sizes") for x in out.column(c)) == width * n
    assert sorted(set(ngram_join._sizes(out).tolist())) == sizes and len(np.unique(ngram_join._keys(out))) == n
    long = np.array([70_000, 3], np.int64)
    blobs = ngram_join._named(np.array([5 << 10, (1 << 58) - 1], np.uint64), np.array([-1, 7], np.int64), long)
    out = pa.table({c: pa.array([b], pa.binary()) for c, b in zip(("keys", "docs", "sizes"), blobs, strict=True)})
    assert ngram_join._sizes(out).tolist() == long.tolist() and ngram_join._keys(out).tolist() == [5, (1 << 48) - 1]


def test_linked_labels_equal_brute_force():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 40, 400).astype(np.uint64)
    sets = [np.unique(np.r_[rng.choice(base, rng.integers(20, 60), replace=False)]) for _ in range(60)]
    sets += [np.unique(np.r_[s[rng.integers(0, 4) :], rng.integers(0, 99, 2).astype(np.uint64)]) for s in sets]
    ids = rng.permutation(len(sets)).astype(np.int64)
    got = dict(zip(ids.tolist(), ngram_join.linked_labels(ids, sets, 85).tolist(), strict=True))
    own = {int(i): set(s.tolist()) for i, s in zip(ids, sets, strict=True)}
    up = {i: i for i in own}
    for _ in own:
        for a in own:
            for b in own:
                if 100 * len(own[a] & own[b]) >= 85 * len(own[a] | own[b]):
                    up[a] = up[b] = min(up[a], up[b])
        if all(up[a] == up[b] for a in own for b in own if 100 * len(own[a] & own[b]) >= 85 * len(own[a] | own[b])):
            break
    assert got == up


def test_decontaminate(spark):
    item = "A farmer sells 12 kg of apples to Maria for 30 dollars and then buys 5 kg of pears from Maria at noon"
    again = item.replace("12", "77").replace("30", "41").replace("Maria", "Jonas").replace("5 kg", "6 kg")
    broken = item.replace("to Maria", "to Jonas")
    rows = [(1, f"Intro words here. {item} and more text follows."), (2, f"Before it. {again} After."), (3, f"x {broken} y"), (4, "nothing alike in this text at all, only words"), (5, None), (6, ""), (1, f"Intro words here. {item} and more text follows.")]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "short")], "item_id long, text string")
    for limit in (1_000_000, 0):
        got = {(r.doc_id, r.item_id, r.verdict) for r in decontaminate.contaminated(frame, bench, broadcast_windows=limit).collect()}
        assert got == {(1, 7, "verbatim"), (2, 7, "renamed")}
    assert decontaminate.contaminated(frame.where("false"), bench).count() == 0
    assert decontaminate.contaminated(frame, bench.where("false")).count() == 0


def test_decontaminate_exact(spark):
    """A verbatim copy of an item that templates can't find: short, of numbers, of names, without spaces, or of one window."""
    items = [
        "Name the largest moon",
        "Sort 12, 7, 3, 44, 9, 21, 6, 18 and 2",
        "The Rise And Fall Of The Old House Of Marble",
        "小明有三个苹果又买了五个苹果请问他现在一共有多少个苹果",
        "東京の人口は",
        "What is the tallest hill in all england",
    ]
    bench = spark.createDataFrame([*enumerate(items), (90, "!?"), (91, "")], "item_id long, text string")
    rows = [(i, f"he then asked {t} once more, and so on") for i, t in enumerate(items)]
    rows += [(6, f"前文{items[3]}后文"), (7, "Sort 13, 7, 4, 45, 9, 22, 6, 19 and 3"), (8, "Name the largest of all the moon"), (9, "东京人口"), (10, items[0].upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (1_000_000, 0):
        got = {tuple(r) for r in decontaminate.contaminated(docs, bench, broadcast_windows=limit).select("doc_id", "item_id", "verdict").collect()}
        assert got == {(i, i, "verbatim") for i in range(6)} | {(6, 3, "verbatim"), (10, 0, "verbatim")}
    both = decontaminate.contaminated(spark.createDataFrame([(1, f"So. {items[5]}?")], "doc_id long, text string"), bench)
    assert both.count() == 1


def test_slot_verdict_alignments():
    """All alignments count, and those with few windows decide nothing."""
    item = "A farmer sells 12 kg of apples to Maria for 30 dollars and then buys 5 kg of pears from Maria at noon"
    again = item.replace("12", "77").replace("30", "41").replace("Maria", "Jonas").replace("5 kg", "6 kg")
    broken = [item.replace("to Maria", f"to {x}") for x in "Ada Bob Cleo Dan Eve Finn Gus Hal Ida Jan Kim Lee Mia Ned Oda Pia Quin Ray".split()]
    verdict = decontaminate.slot_verdict
    assert verdict(item, ". ".join(broken)) == "inconsistent"
    assert verdict(item, ". ".join([*broken, item])) == "verbatim"
    assert verdict(item, ". ".join([*broken, again])) == "renamed"
    assert verdict(item, ". ".join([*[again.replace("77", str(k)) for k in range(80, 100)], item])) == "verbatim"
    # nine words with equal values beside a broken instance
    assert verdict(item, f"{broken[0]}. And buys 5 kg of pears from Maria at noon") == "inconsistent"
    # copies with words put in between
    middle = " and then "
    assert verdict(item, item.replace(middle, " but on second thoughts and then ")) == "verbatim"
    assert verdict(item, again.replace(middle, f"{middle}quite ")) == "renamed"


def labelled():
    rng = random.Random(8)
    vocab = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(200)]
    out = []
    for i in range(400):
        w = [rng.choice(vocab) for _ in range(60)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                w[rng.randrange(60)] = rng.choice(["blighter", "wretchedly", "numskull"])
        low = i % 5 == 0
        out.append((" ".join(x + "$$$" if low else x for x in w), int(toxic), int(not low)))
    return out


def test_toxicity(spark):
    data = labelled()
    model = toxicity.fit([t for t, _, _ in data[:300]], [y for _, y, _ in data[:300]])
    frame = spark.createDataFrame([(i, t, 1.0) for i, (t, _, _) in enumerate(data[300:])] + [(900, None, 0.0), (901, "", 0.0)], "doc_id long, text string, score double")
    got = {r.doc_id: r.score for r in toxicity.score(frame, model).collect()}
    assert sum((got[i] >= 0.5) == bool(y) for i, (_, y, _) in enumerate(data[300:])) >= 93
    assert all(0 <= x <= 1 for x in got.values()) and got[900] == got[901]
    assert {r.score for r in toxicity.score(frame, toxicity.fit(["a"], [0])).collect()} == {0.0}
    assert toxicity.score(frame.where("false"), model).count() == 0


def test_quality_net(spark):
    data = labelled()
    net = quality_net.fit([t for t, _, _ in data[:300]], [q for _, _, q in data[:300]])
    frame = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(data[300:])] + [(900, None), (901, "x" * 100_000)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality_net.score(frame, net).collect()}
    assert sum((got[i] >= 0.5) == bool(q) for i, (_, _, q) in enumerate(data[300:])) >= 95
    assert all(0 <= x <= 1 for x in got.values())
    assert quality_net.score(frame.where("false"), net).count() == 0


def test_pipeline_keeps_clean_documents(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    data = labelled()
    rows = [(i, t, "en", "s", len(t)) for i, (t, _, _) in enumerate(data)]
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows += [(1000, data[1][0], "en", "s", 1), (1001, f"before {item} after", "en", "s", 1), (1002, "write to me@host.example.com today please", "en", "s", 1), (1003, None, "en", "s", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, y) for i, (_, y, q) in enumerate(data)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left.append({r.doc_id for r in docs.collect()})
    toxic = {i for i, (_, y, _) in enumerate(data) if y}
    assert len(toxic & left[0]) <= 10 and len(left[0]) >= 290
    assert 1000 not in left[1] and 1 in left[1] and 1001 not in left[2] and left[1] - left[2] == {1001}
    assert left[2] == left[3] and "[EMAIL]" in docs.where("doc_id = 1002").first().text
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == left[3]
