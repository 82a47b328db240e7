"""The methods themselves against plain versions: pattern graph, dictionaries, convolution, cutoffs, windows."""

import math
import random

import numpy as np
import pytest
import zstandard

pytest.importorskip("tokenizers")

from orbweave.llm import decontaminate, pii, quality_net, quality_rules, toxicity  # noqa: E402


def plain_scores(edges, rounds, min_seeds, smooth):
    sizes, seeds = {}, {}
    for c, i, k, can in edges:
        sizes[c] = sizes.get(c, 0) + 1
        if k >= 0:
            seeds[c, k] = seeds.get((c, k), 0) + 1
    seeds = {key: n for key, n in seeds.items() if n >= min_seeds}
    score = {(c, k): n / (sizes[c] + smooth) for (c, k), n in seeds.items()}
    for _ in range(rounds - 1):
        miss = {}
        hits = [(c, i, k) for c, i, was, can in edges if was < 0 for (d, k) in score if c == d and can >> k & 1]
        for c, i, k in hits:
            miss[i, k] = miss.get((i, k), 0) + math.log(max(1 - score[c, k], 1e-9))
        score = {
            (c, k): (n + sum(1 - math.exp(miss[i, k]) for d, i, l in hits if (d, l) == (c, k))) / (sizes[c] + smooth)
            for (c, k), n in seeds.items()
        }
    return score


def test_score_rounds_equal_a_plain_version(spark):
    rng = random.Random(6)
    instances = [(f"i{n}", rng.choice([-1, -1, 0, 2, 4]), rng.randrange(1, 32)) for n in range(60)]
    edges = {(f"c{rng.randrange(9)}", i, k, can if k < 0 else 1 << k) for i, k, can in instances for _ in range(4)}
    frame = spark.createDataFrame(list(edges), "context string, instance string, kind int, can int")
    for rounds in (1, 2, 4):
        got = {(r.context, r.kind): r.score for r in pii.score_graph(frame, rounds, 2, 1).collect()}
        want = plain_scores(edges, rounds, 2, 1)
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_secrets_and_glued_numbers_are_found_by_their_context(spark):
    rng = random.Random(9)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n - 2)) + "a1"
    words = lambda: " ".join(rng.choice(["mill", "tower", "river", "stone", "glass", "paper"]) for _ in range(rng.randint(4, 9)))
    docs, planted = [], {}
    for n in range(40):
        kind = n % 4
        a, b = words(), words()
        if kind == 0:
            mid = f'token = "{hexa(40)}"'
            at = mid.index('"') + 1, len(mid) - 1
        elif kind == 1:
            mid = f"password={hexa(18)}"
            at = mid.index("=") + 1, len(mid)
        elif kind == 2:
            mid = f"AKIA{''.join(rng.choice('ABCDEFGH2345') for _ in range(14))}X7"
            at = 0, len(mid)
        else:
            mid = f"+1 (555) {200 + n}-{1000 + 7 * n}"
            at = 0, len(mid)
        docs.append((n, f"{a} {mid} {b}"))
        name = "phone" if kind == 3 else "secret"
        planted[n] = f"{name}:{len(a) + 1 + at[0]}:{len(a) + 1 + at[1]}"
    glued = f"{words()} +1 (555) 010-9999 190.137.223.76 end"
    docs.append((50, glued))
    clean = [(100 + n, f"{words()} {rng.choice(['9807915762804490', 'version 12.5', 'room 4411a', '2,345,678'])} {words()}") for n in range(60)]
    frame = spark.createDataFrame(docs + clean, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.digest(pii.find_pii(frame)).collect()}
    assert {n: got[n] for n in planted} == planted
    a = glued.index("+1")
    assert f"phone:{a}:{a + 17}" in got[50] and "ip:" in got[50]
    assert not any(got[100 + n] for n in range(60))


def test_identifiers_that_a_check_refuses_are_never_of_its_kind():
    assert not pii.can_be("9807915762804490") & 4 and not pii.can_be("300.1.2.3") & 2
    assert pii.can_be("4111-XXXX-XXXX-111122223333") & 4 and pii.can_be("5550-199-77") & 8


def test_distances_equal_plain_compression_by_window():
    rng = random.Random(1)
    text = [" ".join(rng.choice(["the", "of", "and", "wretch", "lout"]) for _ in range(n)).encode() for n in (0, 3, 60, 400)]
    ordinary, toxic = b"the of and " * 50, b"wretch lout " * 40
    offsets = np.r_[0, np.cumsum([len(t) for t in text])]
    got, row = toxicity.Distance(ordinary, toxic).windows(np.frombuffer(b"".join(text), np.uint8), offsets)
    sides = []
    for content in (ordinary, toxic):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=toxicity.LEVEL)
        sides.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
    want = []
    for r, t in enumerate(text):
        n = 0 if not t else 1 + max(0, -(-(len(t) - toxicity.WINDOW) // toxicity.STRIDE))
        for k in range(n):
            w = t[k * toxicity.STRIDE : k * toxicity.STRIDE + toxicity.WINDOW]
            want.append((r, len(sides[0].compress(w)) - len(sides[1].compress(w))))
    assert list(zip(row.tolist(), got.tolist(), strict=True)) == want


def test_dictionaries_come_from_the_trainer_and_their_class(monkeypatch):
    rng = random.Random(2)
    vocab = ["".join(rng.choice("etaoinshrd") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = lambda: [rng.choice(vocab) for _ in range(120)]
    ordinary = [" ".join(prose()).encode() for _ in range(300)]
    toxic = []
    for _ in range(120):
        w = prose()
        for _ in range(4):
            w[rng.randrange(120)] = rng.choice(["blighterly", "wretchedness", "numskullish"])
        toxic.append(" ".join(w).encode())
    taken = []
    plain = toxicity.zstandard.train_dictionary

    def spy(size, windows, **kw):
        out = plain(size, windows, **kw)
        taken.append((out.as_bytes(), windows))
        return out

    monkeypatch.setattr(toxicity.zstandard, "train_dictionary", spy)
    a, b = toxicity._dictionaries(toxic, ordinary)
    assert len(a) == len(b) and len(taken) == 3
    shared, side, own = (x for x, _ in taken)
    n = toxicity.OWN_BYTES
    assert a[:-n] == b[:-n] == shared[-toxicity.SHARED_BYTES :] and b[-n:] == side[-n:] and a[-n:] == own[-n:]
    whole = [b" ".join(toxic), b" ".join(ordinary)]
    assert all(w in whole[0] or any(w in t for t in toxic) for w in taken[1][1])
    assert all(any(w in t for t in ordinary) for w in taken[2][1][::50])
    grams = {w[k : k + 5] for w in (b"blighterly", b"wretchedness", b"numskullish") for k in range(len(w) - 4)}
    assert sum(g in b[-n:] for g in grams) > len(grams) / 2 and not any(g in a for g in grams)


def test_net_equals_a_plain_convolution():
    rng = np.random.default_rng(4)
    d = quality_net.WIDTH * quality_net.CODES.shape[1]
    f, h = quality_net.FILTERS, quality_net.HIDDEN
    net = quality_net.Net(rng.normal(size=(d, f)), rng.normal(size=f), rng.normal(size=(2 * f, h)), rng.normal(size=h), rng.normal(size=(h, 1)), rng.normal(size=1))
    net = quality_net.Net(**{k: v.astype(np.float32) for k, v in vars(net).items()})
    half, width, step = quality_net.HALF, quality_net.WIDTH, quality_net.STEP
    texts = [b"", b"abc", bytes(rng.integers(32, 127, 300).astype(np.uint8)), bytes(rng.integers(32, 127, 1500).astype(np.uint8))]

    def one(t):
        n = max(1, -(-len(t) // half))
        padded = t + bytes(n * half + width - len(t))
        pools = []
        for k in range(n):
            best = np.full(f, -np.inf)
            for s in range(0, half, step):
                codes = quality_net.CODES[np.frombuffer(padded[k * half + s : k * half + s + width], np.uint8)].ravel()
                best = np.maximum(best, codes @ net.filters + net.bias)
            pools.append(np.maximum(best, 0))
        chunks = [np.maximum(pools[k], pools[min(k + 1, n - 1)]) for k in range(max(1, n - 1))]
        x = np.r_[np.mean(chunks, 0), np.max(chunks, 0)]
        z = np.maximum(x @ net.w1 + net.b1, 0) @ net.w2 + net.b2
        return 1 / (1 + math.exp(-max(-30, min(30, float(z[0])))))

    offsets = np.r_[0, np.cumsum([len(t) for t in texts])]
    data = np.frombuffer(b"".join(texts), np.uint8)
    got = quality_net.predict(net, data, offsets)
    assert got == pytest.approx([one(t) for t in texts], abs=1e-4)


def test_long_rows_in_pieces_give_the_same(monkeypatch):
    rng = np.random.default_rng(5)
    d, f, h = quality_net.WIDTH * quality_net.CODES.shape[1], quality_net.FILTERS, quality_net.HIDDEN
    net = quality_net.Net(*(rng.normal(size=s).astype(np.float32) for s in ((d, f), f, (2 * f, h), h, (h, 1), 1)))
    for size in (1281, 1408, 5000, 12_800):
        data = rng.integers(32, 127, size).astype(np.uint8)
        monkeypatch.setattr(quality_net, "PASS_HALVES", 1024)
        whole = quality_net.predict(net, data, np.array([0, size]))
        monkeypatch.setattr(quality_net, "PASS_HALVES", 10)
        assert quality_net.predict(net, data, np.array([0, size])) == pytest.approx(whole, abs=1e-5)


def test_cutoffs_hold_for_every_stratum(spark):
    """Few labels prove cutoffs now, of false rejections there are at most as many as allowed, and strata differ."""
    rng = random.Random(3)
    docs, labels = [], []
    for n in range(5200):
        lang = "en" if n < 2600 else "de"
        symbols = rng.choices([0, 1, 2], [98, 1.5, 0.5])[0] if lang == "en" else rng.choices([0, 8], [90, 10])[0]
        words = [f"w{n}x{j}" for j in range(30)]
        for j in range(symbols):
            words[j] += "#$%"
        docs.append((n, " ".join(words), lang))
        labels.append((n, 1, 0))
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rates = quality_rules.with_rates(quality_rules.measures(frame, ["doc_id", "lang"]))
    found = {r.lang: r for r in quality_rules.cutoffs(rates, marks, "lang").collect()}
    assert found["en"].c_symbol_words is not None and found["de"].c_symbol_words is not None
    assert found["en"].c_symbol_words < found["de"].c_symbol_words
    kept = quality_rules.judge(frame, marks)
    for lang in ("en", "de"):
        n, out = kept.where(f"lang = '{lang}'").count(), kept.where(f"lang = '{lang}' AND NOT kept").count()
        assert out <= quality_rules.EPSILON * n
    # the level of a rule and stratum: the strictest cutoff kept passes by itself, the next stricter one doesn't
    level, share = quality_rules.DELTA / (2 * len(quality_rules.RULES)), quality_rules.EPSILON / len(quality_rules.RULES)
    part = lambda i, n: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(share) + (n - i) * math.log(1 - share)
    tail = lambda k, n: sum(math.exp(part(i, n)) for i in range(k + 1))
    grid = quality_rules.RULES["symbol_words"]
    for lang in ("en", "de"):
        own = [r.r_symbol_words for r in rates.where(f"lang = '{lang}'").collect()]
        passed = [c for c in grid if tail(sum(x > c for x in own), len(own)) <= level]
        assert min(passed) == found[lang].c_symbol_words


def test_windows_equal_brute_force(spark):
    item = "Take the long red road to the old mill and then turn left at the green gate by the river before noon"
    tokens = item.lower().split()
    rng = random.Random(12)
    docs = []
    for n in range(30):
        a, b = sorted(rng.sample(range(len(tokens) + 1), 2))
        docs.append((n, f"some words. {' '.join(item.split()[a:b])} other ends"))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: (r.n_shared, r.n_windows) for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    windows = {tuple(tokens[k : k + 8]) for k in range(len(tokens) - 7)}
    want = {}
    for n, t in docs:
        w = t.lower().replace(".", "").split()
        shared = len(windows & {tuple(w[k : k + 8]) for k in range(len(w) - 7)})
        if 2 * shared >= len(windows):
            want[n] = (shared, len(windows))
    assert got == want


def test_a_long_run_of_a_longer_item_counts(spark):
    rng = random.Random(13)
    item = " ".join(rng.choice("red blue old new long short cold warm wide deep".split()) + rng.choice("road mill gate tree".split()) for _ in range(120))
    part = " ".join(item.split()[30:70])
    short = " ".join(item.split()[30:55])
    docs = spark.createDataFrame([(1, f"so. {part} so"), (2, f"so. {short} so")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [(r.doc_id, r.verdict) for r in decontaminate.contaminated(docs, bench).collect()] == [(1, "verbatim")]
