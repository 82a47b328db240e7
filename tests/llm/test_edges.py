"""Every operator on repeated rows, null ids, empty tables, long texts and columns with clashing names."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")

import public_tokenizers  # noqa: E402

from orbweave.llm import chat_tree, decontaminate, ngram_join, packing, pii, quality_net, quality_rules, repeats, token_counts, toxicity  # noqa: E402

#: Names that operators use for columns of their own.
CLASHING = "uid long, base string, seen string, open boolean, key string, hashes long, cluster long, blocks int, spans string, component_id long, rank long, part int, node string, segment string, h string, s string, l_doc long, label string, kept boolean"
LONG = "one two three four five six seven eight nine ten " * 4000


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    prose = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(40)) for _ in range(n))
    copy = prose(50)
    return [(1, copy), (1, copy), (1, prose(30)), (2, copy), (None, copy), (None, None), (None, copy), (3, None), (3, ""), (4, LONG), (5, "ask me@x.example.org"), (5, "ask me@x.example.org")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    names = [x.split()[0] for x in CLASHING.split(", ")]
    frame = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    for x in CLASHING.split(", "):
        name, kind = x.split()
        frame = frame.withColumn(name, F.lit(None).cast(kind))
    assert set(names) < set(frame.columns)
    return frame.repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 1, 0), (None, 1, 1), (77, None, None)], "doc_id long, quality int, toxic int")


def counted(df, *columns):
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())


def test_token_counts(docs, rows):
    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter((i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert counted(token_counts.count_tokens(docs), "doc_id", "n_bytes", "n_tokens") == want


def test_packing(docs, rows):
    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter((i, len(tok.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows)
    found = packing.pack(docs, length=256)
    assert counted(found.where("start = 0"), "doc_id", "doc_tokens") == want
    assert found.agg(F.sum("length")).first()[0] == sum(n * k for (_, n), k in want.items())


def test_word_cache_of_any_size(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    texts = ["It's an über-façade, isn't it? 3.5%", LONG[:500], "ça vaïs ÀÉ don't they'll x--y"] * 3
    for size in (1, 3000, 1 << 20):
        monkeypatch.setattr(packing, "CACHE_BYTES", size)
        monkeypatch.setattr(packing, "_caches", {})
        encode = packing.encoder(path)
        for t in texts:
            assert encode(t) == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_pii(docs, rows):
    found = pii.find_pii(docs)
    assert counted(found, "doc_id") == collections.Counter((i,) for i, _ in rows)
    assert counted(pii.digest(found).where("n_email > 0"), "doc_id", "n_found") == {(5, 1): 2}
    red = pii.redact(docs)
    assert red.columns == docs.columns and red.count() == len(rows)
    assert counted(red.where("doc_id = 5"), "text") == {("ask [EMAIL]",): 2}
    assert counted(red.where("text IS NULL"), "doc_id") == {(None,): 1, (3,): 1}
    assert pii.redact(docs.where("false")).count() == 0


def test_repeats(docs, rows):
    got = repeats.find_repeats(docs, 20)
    assert counted(got, "doc_id", "n_bytes") == collections.Counter((i, len((t or "").encode())) for i, t in rows)
    # of three copies under null ids and 1 and 2, only one stays whole, and it has the smallest id: null
    copy = len(rows[0][1])
    whole = got.where(f"n_bytes = {copy} AND n_removed = 0").collect()
    assert [r.doc_id for r in whole] == [None]
    assert got.where(f"n_bytes = {copy} AND n_removed = {copy}").count() == 4
    long = got.where("doc_id = 4").first()
    assert long.n_bytes - long.n_removed < 200 and long.n_spans == 1


def test_quality_rules(docs, rows, labels):
    out = quality_rules.judge(docs.drop("kept"), labels)
    assert counted(out, "doc_id", "n_words") == collections.Counter((i, len((t or "").split())) for i, t in rows)


def test_quality_net_and_toxicity(docs, rows, labels):
    kept = lambda key: F.lit(True)
    for module, score in ((quality_net, quality_net.score), (toxicity, toxicity.score)):
        model = module.train(docs, labels, kept)
        got = score(docs, model, ["doc_id"]).collect()
        assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, _ in rows)
        assert all(0 <= r.score <= 1 for r in got)
        assert score(docs, model).columns == [*docs.columns, "score"]
    sample = toxicity.training_rows(docs, labels, "quality", kept, {0: 5, 1: 5}, 1 << 20)
    assert len(sample) == 2 and toxicity.training_rows(docs, labels, "quality", kept, {1: 5}, 10) == []


def test_ngram_join(docs, rows):
    got = counted(ngram_join.link_components(docs), "doc_id", "component_id")
    assert got == {(1, 1): 3, (2, 1): 1, (None, None): 3, (3, 3): 2, (4, 4): 1, (5, 5): 2}


def test_decontaminate(spark, docs, rows):
    bench = spark.createDataFrame([(9, rows[0][1]), (9, "ask me at x"), (9, rows[2][1]), (None, rows[0][1]), (8, None)], "item_id long, text string")
    got = counted(decontaminate.contaminated(docs, bench), "doc_id", "item_id", "verdict")
    want = {(i, item, "verbatim"): 1 for i, item in ((1, 9), (1, None), (2, 9), (2, None), (None, 9), (None, None))}
    # document 1 has two texts of item 9, each an item of its own
    found = decontaminate.contaminated(docs, bench).select("doc_id", "item_id", "verdict", "n_windows").distinct()
    assert set(got) == set(want) and found.where("doc_id = 1 AND item_id = 9").count() == 2


def test_chats(spark):
    data = [(1, 0, "user", "hi", "x"), (1, 0, "user", "hi", "x"), (None, 0, "assistant", None, "x"), (None, 1, None, "", "x"), (2, 5, "assistant", LONG, "x")]
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, node string")
    for name in ("segment", "depth", "position", "loss", "run", "ids", "size"):
        frame = frame.withColumn(name, F.lit(None).cast("string"))
    turns, tree = chat_tree.format_chats(frame)
    got = {r.conv_id: r for r in chat_tree.read_back(turns, tree).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 2, None: 2, 2: 1}
    assert got[2].loss_chars == len(LONG) and got[2].loss_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
    assert got[1].loss_chars == got[None].loss_chars == 0


def test_chats_in_tokens(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    data = [(c, k, "user" if k % 2 == 0 else "assistant", f"größe <|end|> {k if k < 2 else (c, k)}") for c in range(6) for k in range(c + 1)]
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    _, tree = chat_tree.format_chats(frame, path)
    nodes = {r.node: r for r in tree.collect()}
    for r in nodes.values():
        assert tok.decode(r.ids, skip_special_tokens=False) == r.segment and r.end - r.start == len(r.ids)
        path_size, up = 0, r
        while up.parent:
            up = nodes[up.parent]
            path_size += len(up.ids)
        assert r.position == path_size == sum(x.end - x.start for x in r.intervals)
        role, text, _, _ = chat_tree.parse_turn(r.segment)
        assert (r.loss is None) == (role == "user")
        if r.loss is not None:
            assert chat_tree.unescape(tok.decode(r.ids[r.loss.start - r.start : r.loss.end - r.start], skip_special_tokens=False)) == text


def test_pipeline_with_shared_ids(spark, tmp_path, rows, labels):
    import corpus_pipeline

    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "no such words at all in any text of these")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    # of the two equal rows under 1 one stays, 2 is a copy of it; the equal rows under 5 are one; nulls stay
    assert collections.Counter(r.doc_id for r in out.collect()) == {1: 2, None: 3, 3: 2, 4: 1, 5: 1}
    assert corpus_pipeline.run(spark, str(tmp_path)).where("start = 0").count() == 9
    empty = corpus_pipeline.drop_near_copies(spark, docs.where("false"), str(tmp_path))
    assert empty.count() == 0 and empty.columns == docs.columns
