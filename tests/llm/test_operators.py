"""The operators against brute force, exact round trips and held-out accuracy."""

import base64
import hashlib
import itertools
import math
import os
import re
import sys
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from conftest import PAGES, rows
from pyspark.sql import functions as F

from skein.llm import flac, gru, langid, lm, media, mixing, near_dedup, packing, privacy, quality, warc
from skein.llm.entry import QUERIES
from skein.llm.exact_dedup import dedup_exact
from skein.llm.shingles import OnePermutation

SMALL = "/root/testdata/sf0.01"
here = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the tables are not here")
crc = lambda i, n: None if i is None else zlib.crc32(str(i).encode()) % n


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


# 1. Media columns


@pytest.mark.parametrize("n", [64, 4096, 4160, 100_032])
@pytest.mark.parametrize("kind", ["noise", "wave", "constant", "text"])
def test_flac_round_trip(n, kind):
    rng = np.random.default_rng(n)
    data = {"noise": rng.integers(0, 256, n, dtype=np.uint8), "wave": (128 + 90 * np.sin(np.arange(n) / 9)).astype(np.uint8), "constant": np.full(n, 7, np.uint8), "text": np.frombuffer((b"the quick brown fox " * (n // 20 + 1))[:n], np.uint8)}[kind].tobytes()
    stored = media.encode_all([data])[0]
    assert stored[:4] == b"fLaC" and flac.decode_many([stored]) == [data]
    assert flac.read_samples(stored, n // 3, 40) == data[n // 3 : n // 3 + 40]
    if kind != "noise":
        assert len(stored) < n + 200


def test_damaged_flac_is_refused():
    stored = bytearray(media.encode_all([bytes(range(256)) * 40])[0])
    for at in (len(stored) - 3, len(stored) // 2):
        broken = bytearray(stored)
        broken[at] ^= 0x10
        with pytest.raises(flac.FlacError):
            flac.decode_many([bytes(broken)])


def plain_frames(stored, payload):
    """Header, checksums and places of every frame by the format's own rules, bit by bit where it matters."""

    def crc(data, poly, bits):
        c = 0
        for byte in data:
            c ^= byte << (bits - 8)
            for _ in range(8):
                c = (c << 1 ^ poly if c >> (bits - 1) & 1 else c << 1) & ((1 << bits) - 1)
        return c

    info = flac.Stream(stored)
    for k, (s, o, n) in enumerate(info.points.tolist()):
        a = info.frames_at + o
        b = info.frames_at + info.points["o"].tolist()[k + 1] if k + 1 < len(info.points) else len(stored)
        head = flac._parse_header(stored, a)
        assert stored[a] == 0xFF and stored[a + 1] == 0xF8 and head[1:] == (k, n) and s + n <= len(payload)
        assert crc(stored[a : a + head[0] - 1], 0x07, 8) == stored[a + head[0] - 1]
        assert crc(stored[a : b - 2], 0x8005, 16) == stored[b - 2] << 8 | stored[b - 1]


def without_table(stored):
    info = flac.Stream(stored)
    return stored[:4] + b"\x80" + stored[5:42] + stored[info.frames_at :]


@pytest.mark.parametrize("n", [64, 9000, 60_032])
def test_frames_by_the_format(n):
    rng = np.random.default_rng(n)
    data = bytes(rng.integers(60, 120, n, dtype=np.uint8))
    stored = media.encode_all([data])[0]
    plain_frames(stored, data)
    bare = without_table(stored)
    assert flac.Stream(bare).points is None and flac.decode_many([bare, stored]) == [data, data]
    assert flac.read_samples(bare, n // 2, 50) == data[n // 2 : n // 2 + 50]


def test_frames_out_of_place_are_refused():
    data = bytes(np.random.default_rng(3).integers(0, 256, 40_000, dtype=np.uint8))
    stored = media.encode_all([data])[0]
    info = flac.Stream(stored)
    at = (info.points["o"].astype(int) + info.frames_at).tolist()
    size = at[1] - at[0]
    assert at[2] - at[1] == size  # noise is stored as it is
    swapped = stored[: at[0]] + stored[at[1] : at[2]] + stored[at[0] : at[1]] + stored[at[2] :]
    with pytest.raises(flac.FlacError):
        flac.read_samples(swapped, 0, 10)


def test_seek_tables_that_are_full(monkeypatch):
    monkeypatch.setattr(flac, "MAX_POINTS", 3)
    data = bytes(np.random.default_rng(5).integers(40, 90, 70_000, dtype=np.uint8))
    stored = media.encode_all([data])[0]
    assert len(flac.Stream(stored).points) <= 3 and flac.decode_many([stored]) == [data] and flac.read_samples(stored, 65_000, 90) == data[65_000:65_090]


def test_pcm_blocks_and_ranges(spark):
    texts = {1: "short", 2: "wave of text " * 4000, 3: "", 4: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    stored = media.to_flac(docs)
    back = defaultdict(bytes)
    for r in media.pcm_blocks(stored).orderBy("id", "block").collect():
        assert r.first_sample == len(back[r.id]) and r.n_samples == len(r.pcm)
        back[r.id] += bytes(r.pcm)
    want = {i: media.padded((t or "").encode()) for i, t in texts.items()}
    assert back == want
    assert {r.id: bytes(r.pcm) for r in media.read_range(stored, 9000, 77).collect()} == {i: p[9000:9077] for i, p in want.items()}
    for r in media.store_and_read(docs).collect():
        n = [b.n_samples for b in media.pcm_blocks(stored.where(F.col("id") == r.id)).orderBy("block").collect()]
        k = len(n) // 2
        assert r.blocks == len(n) and r.seek_crc32 == zlib.crc32(want[r.id][sum(n[:k]) : sum(n[: k + 1])])


def test_blocks_of_many_streams_are_sought_together(monkeypatch):
    """A decoding step costs the same for one frame as for many, so the middle blocks of a batch are one decoding."""
    rng = np.random.default_rng(8)
    texts = [b"", b"short", *(bytes(rng.integers(60, 120, int(n), dtype=np.uint8)) for n in rng.integers(1, 9000, 30))]
    payloads = [media.padded(t) for t in texts]
    stored = media.encode_all(payloads)
    firsts, counts = rng.integers(0, 9000, len(texts)).tolist(), rng.integers(0, 3000, len(texts)).tolist()
    assert flac.read_many(stored, firsts, counts) == [p[a : a + n] for p, a, n in zip(payloads, firsts, counts, strict=True)]
    bare = [without_table(x) for x in stored]
    assert flac.read_many(bare, firsts, counts) == flac.read_many(stored, firsts, counts) and flac.read_many([], [], []) == []
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    calls, real = [], flac._decode_frames
    monkeypatch.setattr(flac, "_decode_frames", lambda *a: calls.append(len(a[1])) or real(*a))
    monkeypatch.setattr(media, "text_rows", lambda docs, *_: SimpleNamespace(mapInArrow=lambda run, _: [r for b in run(iter(docs)) for r in b.to_pylist()]))
    found = media.store_and_read([batch])
    assert [r["payload_sha256"] for r in found] == [hashlib.sha256(p).hexdigest() for p in payloads]
    per = [-(-len(p) // flac.BLOCK) for p in payloads]
    assert [r["seek_crc32"] for r in found] == [zlib.crc32(p[k // 2 * flac.BLOCK :][: flac.BLOCK]) for p, k in zip(payloads, per, strict=True)]
    assert calls == [sum(per), len(texts)]


def test_media_query(spark, tables):
    found = defaultdict(set)
    for r in QUERIES["op1_flac_media"](spark, tables).collect():
        found[r.payload_sha256].add(tuple(r)[1:])
    want = set()
    for _, t, _, _ in rows():
        raw = (t or "").encode()
        p = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        want.add((len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert {x[:4] for v in found.values() for x in v} == want


# 2. Language model


def test_a_window_takes_few_calls():
    """A window's cost is its arithmetic: classes are slices, and what needs no later step runs over the whole window."""
    rng, shape = np.random.default_rng(4), (gru.WINDOW, gru.LANES)
    flat = gru.initial(np.ones(gru.HEAD), np.ones(gru.TAIL))
    x, y = (rng.integers(0, gru.HEAD + gru.TAIL, shape) for _ in range(2))
    first, h, g = rng.random(shape) < 0.01, np.zeros((gru.LANES, gru.HIDDEN), np.float32), np.zeros(gru.SIZE, np.float32)
    calls = []
    sys.setprofile(lambda _, what, __: calls.append(what))
    try:
        gru.window_gradient(gru.views(flat), gru.views(g), x, y, first, np.ones(shape, bool), h)
    finally:
        sys.setprofile(None)
    assert sum(c in ("call", "c_call") for c in calls) < 450  # WINDOW steps and HEAD_CLASSES classes

def test_gru_gradient_is_the_slope():
    rng = np.random.default_rng(1)
    counts = np.zeros(gru.HEAD)
    counts[:100] = 50
    flat = gru.initial(counts, np.ones(gru.TAIL)).astype(np.float64)
    x, y = rng.integers(0, 100, (5, 3)), rng.integers(0, gru.HEAD + gru.TAIL, (5, 3))
    first, valid = np.zeros((5, 3), bool), np.ones((5, 3), bool)
    first[2, 1] = True
    h = rng.standard_normal((3, gru.HIDDEN))

    def loss(w):
        return gru.window_gradient(gru.views(w), gru.views(np.zeros(gru.SIZE)), x, y, first, valid, h)[0]

    g = np.zeros(gru.SIZE)
    gru.window_gradient(gru.views(flat), gru.views(g), x, y, first, valid, h)
    for i in np.argsort(-np.abs(g))[:: max(1, int((g != 0).sum()) // 25)][:25]:
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-3
        down[i] -= 1e-3
        assert math.isclose((loss(up) - loss(down)) / 2e-3, g[i], rel_tol=0.05, abs_tol=2e-4)


def test_probabilities_add_up_to_one():
    counts = np.arange(gru.HEAD)[::-1] + 1.0
    flat = gru.initial(counts, np.full(gru.TAIL, 9.0))
    every = np.arange(gru.HEAD + gru.TAIL)
    lp = gru.log_likelihood(flat, every, np.ones(len(every), np.int64))  # all in the first place of a document
    assert math.isclose(np.exp(lp).sum(), 1, rel_tol=1e-3)
    corpus = lm.CorpusCounts(100, 4, [(b" ", 9)], [(3, 20, 2)])
    seen = np.exp(corpus.tail_log(np.array([3, 3]), np.array([15, 5]))).sum()
    left = np.exp(corpus.tail_log(np.array([3]), np.array([0])))[0]
    assert math.isclose(seen + left, 1)
    # The words never seen share what is left: here nearly all of a class are words of up to eight of three letters.
    speller = lm.Speller(lm.spelling_counts([b"ab", b"ba", b"aab", b"c"] * 100_000))
    letters = [bytes(w) for n in range(1, 9) for w in itertools.product(b"abc", repeat=n)]
    share = np.bincount([lm.word_class(w) for w in letters], np.exp(speller.log_probs(letters)), gru.TAIL)
    assert (share < 1 + 1e-9).all() and share[lm.word_class(b"ab")] > 0.99
    shorts = [bytes([a]) for a in range(256)] + [bytes([a, b]) for a in range(256) for b in range(256)]
    assert (np.bincount([lm.word_class(w) for w in shorts], np.exp(lm.Speller(lm.spelling_counts([])).log_probs(shorts)), gru.TAIL) < 1).all()
    two = [w for w in letters if lm.word_class(w) == lm.word_class(b"ab")][:2]
    assert np.exp(speller.log_probs(two)).sum() < 1  # two unseen words of one class


def plain_spelling(seen):
    """ln P(word | class) by dictionaries, byte by byte from the word's end."""
    pair, of_class, counts = Counter(), Counter(), [Counter() for _ in range(3)]
    totals = [Counter() for _ in range(3)]

    def contexts(s, k):
        a, b, c = s[k - 1], s[k - 2], s[k - 3] if k > 2 else 256
        h = a * 0x9E3779B1 + b * 0x85EBCA77
        return a, (h >> 7) % lm.CONTEXTS[0], (h + c * 0xC2B2AE3D >> 9) % lm.CONTEXTS[1]

    for w in seen:
        s = [*reversed(w), 256]
        pair[s[0], s[1]] += 1
        of_class[lm.word_class(w)] += 1
        for k in range(2, len(s)):
            for o, row in enumerate(contexts(s, k)):
                counts[o][row, s[k]] += 1
                totals[o][row] += 1
    endings = Counter(lm.word_class(bytes([b, a]) if b < 256 else bytes([a])) for a in range(256) for b in range(257))

    def log_prob(w):
        s, k0 = [*reversed(w), 256], lm.word_class(w)
        out = math.log((pair[s[0], s[1]] + 0.1) / (of_class[k0] + 0.1 * endings[k0]))
        for k in range(2, len(s)):
            p = 1 / 257
            for o, row in enumerate(contexts(s, k)):
                p = (counts[o][row, s[k]] + 2 * p) / (totals[o][row] + 2)
            out += math.log(p)
        return out

    return log_prob


def test_score_against_a_plain_network(spark, tables):
    """Every document's score from its words, token by token, with the fitted weights."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    model, blocks = lm.fit_language_model(docs, lm.crc_mod("id", 7) == 2)
    texts = [(i, words(t), i is None or crc(i, 7) == 2) for i, t, _, _ in rows()]
    count = Counter(w for _, ws, held in texts if not held for w in [*ws, b" "])
    heads = {w: k for k, w in enumerate(model.head_words)}
    assert model.head_words == [b" ", *(w for w, _ in sorted(((w, c) for w, c in count.items() if w != b" "), key=lambda x: (-x[1], x[0])))][: gru.HEAD]
    p = {k: v.astype(np.float64) for k, v in gru.views(model.weights).items()}
    total, types = np.zeros(gru.TAIL), np.zeros(gru.TAIL)
    for w, c in count.items():
        if w not in heads:
            total[lm.word_class(w)] += c
            types[lm.word_class(w)] += 1
    spelling = plain_spelling([w for w in count if w not in heads])
    sigmoid, softmax = lambda x: 1 / (1 + np.exp(-x)), lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    found, n = defaultdict(list), gru.HIDDEN
    for r in blocks.mapInArrow(lm._score(spark.sparkContext.broadcast(model)), "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").collect():
        found[r.id].append(r.score)
    for i, ws, _ in texts:
        if len(ws) > 400:
            continue
        h, last, score = np.zeros(n), 0, 0.0
        for w in [*ws, b" "]:
            code = heads.get(w, gru.HEAD + lm.word_class(w))
            a, e = h @ p["u"], p["emb"][last]
            z, r = sigmoid(e[:n] + a[:n]), sigmoid(e[n : 2 * n] + a[n : 2 * n])
            h = (1 - z) * np.tanh(e[2 * n :] + r * a[2 * n :]) + z * h
            c = softmax(h @ p["wc"] + p["bc"])
            if code < gru.HEAD:
                k, j = divmod(code, gru.CLASS_WORDS)
                score += math.log10(c[k] * softmax(h @ p["ww"][k] + p["bw"][k])[j])
            else:
                k = code - gru.HEAD
                left = count[w] - gru.DISCOUNT if count[w] else gru.DISCOUNT * types[k] + 1
                score += math.log10(c[gru.HEAD_CLASSES + k] * left / (total[k] + 1))
                if not count[w]:
                    score += spelling(w) / math.log(10)
            last = code
        assert any(math.isclose(score, s, rel_tol=1e-3, abs_tol=1e-3) for s in found[i]), (i, score, found[i])


def test_states_run_through_whole_documents():
    flat = gru.initial(np.ones(gru.HEAD), np.ones(gru.TAIL))
    ids = np.random.default_rng(3).integers(0, gru.HEAD, 301)
    together = gru.log_likelihood(flat, ids, np.array([100, 1, 200]))
    alone = np.concatenate([gru.log_likelihood(flat, x, np.array([len(x)])) for x in np.split(ids, [100, 101])])
    assert np.allclose(together, alone, atol=1e-4)


def test_every_training_token_gives_a_gradient(monkeypatch):
    """Also in the pass over all blocks, where three windows of four only carried the state on."""
    rng = np.random.default_rng(2)
    texts = [np.concatenate([rng.integers(1, 50, n), [0]]).astype(np.int32) for n in (300, 120, 77, 1)]
    held = [False, True, False, False]
    row = {"block": [3], "held": [held], "ids": [[lm.packed(t) for t in texts]], "codes": [lm.packed(np.arange(50))]}
    seen, real = [], gru.window_gradient
    monkeypatch.setattr(gru, "window_gradient", lambda p, g, x, y, first, valid, h: seen.append(int(valid.sum())) or real(p, g, x, y, first, valid, h))
    start = SimpleNamespace(value=gru.initial(np.ones(gru.HEAD), np.ones(gru.TAIL)))
    list(lm._train(start, lm.RATE, 1)(pa.table(row).to_batches()))
    assert sum(seen) == sum(len(t) for t, out in zip(texts, held, strict=True) if not out)


def test_common_words_are_counted_alike(spark, tables, monkeypatch):
    """Counts do not depend on which words go by partial sums, nor on how many codes are gathered at once."""
    want = sorted(map(str, QUERIES["op2_gru_language_model"](spark, tables).drop("score").collect()))
    for some, gather in ((1, 7), (40, 1 << 20)):
        monkeypatch.setattr(lm, "COMMON_WORDS", some)
        monkeypatch.setattr(lm, "BLOCK_COMMON", 25)
        monkeypatch.setattr(lm, "GATHER_ROWS", gather)
        assert sorted(map(str, QUERIES["op2_gru_language_model"](spark, tables).drop("score").collect())) == want


def test_packed_ids():
    for x in ([0], [1, 255, 256, 70_000, 2**24], [5, 2**31, 2**45], []):
        assert lm.unpacked(lm.packed(np.array(x, np.int64))).tolist() == x


def test_base_scores(spark, tables):
    docs = [(i, words(t), i is None or crc(i, 7) == 2) for i, t, _, _ in rows()]
    count = Counter(w for _, ws, held in docs if not held for w in [*ws, None])
    n, v = sum(count.values()), len(count)
    base = lambda ws: sum(math.log10((count[w] + 1) / (n + v + 1)) for w in [*ws, None])
    want = sorted((str(i), held, len(ws) + 1, sum(count[w] > 0 for w in [*ws, None]), n, round(base(ws), 6)) for i, ws, held in docs)
    found = QUERIES["op2_gru_language_model"](spark, tables).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)


@here
def test_model_beats_the_base_on_held_out_texts(spark):
    """The base gives every unseen word what one is due; the model divides it among them, which a sixth of the words of the smaller table pay for."""
    found = QUERIES["op2_gru_language_model"](spark, "/root/testdata/sf0.1").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert found[0] > found[1]


# 3. Quality classifier


@here
def test_quality_on_held_out_labels(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    found = QUERIES["op3_quality_classifier"](spark, SMALL).where("held_out").join(labels, "doc_id").select("score", "quality", "predicted").collect()
    good, bad = [r.score for r in found if r.quality == 1], [r.score for r in found if r.quality == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.8
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in found)


def test_scores_keep_the_ratio_of_all_labels_past_the_bound(spark, monkeypatch):
    """Texts that tell nothing, 9 of 10 labelled good: past the sample's bound the scores were those of 1 of 2."""
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in rng.integers(0, 500, 80))) for i in range(800)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(800)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "SAMPLE_ROWS", 80)
    scores = [r.score for r in quality.score_quality(docs, quality.fit_quality(docs, labels)).collect()]
    assert abs(np.mean(scores) - 0.9) < 0.1


def test_quality_against_brute_force(spark, monkeypatch):
    """The dictionaries, the calibration and every score again, from single texts and plain loops."""
    rng = np.random.default_rng(9)
    say = lambda names, n: " ".join(str(rng.choice(names)) for _ in range(n))
    good, bad = [f"word{k}" for k in range(300)], [f"junk{k}" for k in range(300)]
    texts = {i: say(bad if i % 3 == 0 else good, 20 + i % 50) for i in range(240)} | {240: "", 241: "x" * 5000, 242: None, 243: say(good, 9000)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = [(i, int(i % 3 > 0)) for i in range(200)] + [(243, 1), (900, 0)]
    model = quality.fit_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    fold, raw = {}, {i: (t or "").encode() for i, t in texts.items()}
    for y in (0, 1):
        for n, i in enumerate(sorted(i for i, z in labels if z == y and i in texts), 1):
            fold[i] = n % 2
    marked = {i: y for i, y in labels if i in texts}
    count, lines = Counter(marked.values()), []
    for f in (0, 1):
        made = tuple(quality.train_dictionary([raw[i] for i in sorted(fold) if fold[i] == f and marked[i] == y]) for y in (1, 0))
        assert made == model.dictionaries[f]
        other = [i for i in sorted(fold, key=lambda i: (marked[i], i)) if fold[i] != f]
        y = np.array([marked[i] for i in other])
        w = np.array([count[k] / (y == k).sum() for k in y])
        size = lambda t, d: len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False).compress(t))
        gain = lambda t, made=made, size=size: (size(t, made[1]) - size(t, made[0])) / len(t) if t else 0.0
        d = np.array([gain(raw[i]) for i in other])
        z = (d - d.mean()) / d.std()
        w = w * len(w) / w.sum()
        a = b = 0.0
        for _ in range(20_000):  # plain gradient ascent
            e = w * (y - 1 / (1 + np.exp(-a - b * z)))
            a, b = a + 0.02 * e.sum(), b + 0.02 * ((e * z).sum() - b)
        lines.append((gain, a - b * d.mean() / d.std(), b / d.std()))
    found = {r.id: r.score for r in quality.score_quality(docs, model).collect()}
    for i, t in raw.items():
        odds = np.mean([a + b * gain(t) for gain, a, b in lines])
        assert math.isclose(found[i], 1 / (1 + math.exp(-max(-30, min(30, odds)))), abs_tol=1e-3)


# 4. Packing


def test_packing_places_every_token_once(spark, tables):
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in QUERIES["op4_best_fit_packing"](spark, tables).collect():
        pieces[r.doc_id].append((r.first_token, r.n_tokens))
        bins[r.shard, r.bin].append(r)
    for rs in bins.values():
        used = sum(r.n_tokens for r in rs)
        assert {r.used for r in rs} == {used} and {r.capacity for r in rs} == {min(c for c in packing.CAPACITIES if c >= used)}
        assert sorted(r.position for r in rs) == list(range(len(rs)))
    lengths = defaultdict(int)
    for i, t, _, _ in rows():
        lengths[i] += len(words(t)) + 1
    assert {i: sum(n for _, n in p) for i, p in pieces.items()} == lengths


def best_packing_cost(lengths, costs):
    """Least cost over all ways to part the pieces."""
    price = lambda n: min((c for k, c in costs.items() if k >= n), default=math.inf)

    def parts(xs):
        if not xs:
            yield []
            return
        for p in parts(xs[1:]):
            yield [xs[0], *p]
            for i in range(len(p)):
                yield [*p[:i], p[i] + xs[0], *p[i + 1 :]]

    return min(sum(map(price, p)) for p in parts(lengths))


def packed_cost(lengths, costs):
    made = packing.pack(lengths, costs)
    assert sorted(i for _, m in made for i in m) == list(range(len(lengths)))
    assert all(c == min(k for k in costs if k >= sum(lengths[i] for i in m)) for c, m in made)
    return sum(costs[c] for c, _ in made)


def test_packing_against_brute_force():
    rng, ratios = np.random.default_rng(4), []
    for n in range(150):
        caps = [(512, 1024, 2048, 4096), (100, 170, 300), (7, 12, 19)][n % 3]
        costs = packing.bin_costs(caps, int(rng.choice([1, 16])), [None, caps[-1]][n // 3 % 2])
        lengths = [int(rng.integers(1, caps[rng.choice([0, -1])] + 1)) for _ in range(rng.integers(1, 8))]
        ratios.append(packed_cost(lengths, costs) / best_packing_cost(lengths, costs))
    assert min(ratios) > 1 - 1e-9 and max(ratios) < 1.3 and np.mean(ratios) < 1.01


@pytest.mark.parametrize(("caps", "attention"), [((700, 1500, 4096), None), (packing.CAPACITIES, packing.ATTENTION)])
def test_joint_sizes_beat_the_largest_size(caps, attention):
    """Mixes whose pieces leave gaps in the largest bin, or are dear there."""
    rng, costs, largest = np.random.default_rng(6), packing.bin_costs(caps, 16, attention), max(caps)
    lengths = sorted([700] * 101 + [1500] * 53 + rng.integers(650, 700, 200).tolist(), reverse=True)
    plain = packing.best_fit(lengths, largest, lambda n, pool: largest)
    downsized = sum(min(c for k, c in costs.items() if k >= sum(lengths[i] for i in m)) for m in plain)
    assert packed_cost(lengths, costs) < 0.99 * downsized


def test_best_fit_is_close_to_full():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 900, 3000).tolist()
    made = packing.pack(lengths, packing.bin_costs(packing.CAPACITIES, 16, None))
    assert sum(cap for cap, _ in made) < 1.02 * sum(lengths)
    # A bin of 1024 costs less than two of 512 by their overhead, and more with attention.
    assert packing.pack([4096, 1, 512], packing.bin_costs(packing.CAPACITIES, 16, None)) == [(4096, [0]), (1024, [2, 1])]
    assert packing.pack([4096, 1, 512], packing.bin_costs(packing.CAPACITIES, 16, 6144)) == [(4096, [0]), (512, [2]), (512, [1])]


def test_second_round_never_costs_more(spark):
    rng = np.random.default_rng(1)
    docs = spark.createDataFrame([(i, "w " * int(rng.integers(1, 1500))) for i in range(3000)], "doc_id long, text string")
    costs = packing.bin_costs(packing.CAPACITIES)
    made = packing.pack_documents(docs).select("shard", "bin", "capacity").distinct().collect()
    lengths = [len(words(r.text)) + 1 for r in docs.collect()]
    assert sum(costs[r.capacity] for r in made) < 1.02 * packed_cost(lengths, costs)


# 5. Mixing


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 1, "b": 1, "c": 1}, {"a": 70, "b": 20, "c": 9, "d": 1}])
def test_schedule_is_pfair(spark, weights):
    docs = spark.createDataFrame([(i, s) for s in weights for i in range(400)], "doc_id long, source string")
    found = mixing.mix(docs, spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "source string, weight double"), block_rows=2).collect()
    total, slots = sum(weights.values()), {}
    for r in found:
        assert r.release <= r.slot < r.deadline
        slots.setdefault(r.slot, set()).add(r.source)
    assert all(len(s) == 1 for s in slots.values())
    done, end = Counter(), max((r.slot for r in found if r.in_mix), default=-1)
    for t in range(end + 1):
        done[next(iter(slots[t]))] += 1
        for s, w in weights.items():
            assert abs(done[s] - (t + 1) * w / total) < 1
    assert end + 1 >= total  # at least one period


def test_mix_numbers_every_row_once(spark, tables):
    found = QUERIES["op5_pfair_mixing"](spark, tables).collect()
    for s in {r.source for r in found}:
        assert sorted(r.row_in_source for r in found if r.source == s) == list(range(sum(r.source == s for r in found)))


def test_rare_sources_take_no_slots_from_a_common_one(spark):
    """20 common sources and 80 of one row: with whole shares of 1000 the first common one had less than none."""
    common, rare = 200, 1
    docs = spark.createDataFrame([(i, f"c{k:02}") for k in range(20) for i in range(common)] + [(0, f"r{k:02}") for k in range(80)], "doc_id long, source string")
    weights = spark.createDataFrame([(f"c{k:02}", 1000.0) for k in range(20)] + [(f"r{k:02}", 1.0) for k in range(80)], "source string, weight double")
    found = mixing.mix(docs, weights, block_rows=1).collect()
    assert sorted(r.slot for r in found) == list(range(20 * common + 80 * rare))  # every block its own slot, and no slot empty
    assert all(r.release <= r.slot < r.deadline for r in found)
    half = Counter(r.source for r in found if r.slot < 10 * common)
    assert max(half[f"c{k:02}"] for k in range(20)) - min(half[f"c{k:02}"] for k in range(20)) <= 2


def test_targets_hold_however_long_the_table(spark):
    """Weights that are no whole shares of 1000: the deviation must not grow with the slots."""
    weights = {"a": 1.0, "b": 0.4504, "c": 0.0006}
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.expr("CASE WHEN id < 6200 THEN 'a' WHEN id < 8990 THEN 'b' ELSE 'c' END").alias("source"))
    found = mixing.mix(docs, spark.createDataFrame(list(weights.items()), "source string, weight double"), block_rows=1).where("in_mix").select("slot", "source").orderBy("slot").collect()
    total, done = sum(weights.values()), Counter()
    assert [r.slot for r in found] == list(range(len(found))) and len(found) > 8000
    for r in found:
        done[r.source] += 1
        assert all(abs(done[s] - (r.slot + 1) * w / total) < 2 for s, w in weights.items())


def plain_pfair(blocks, w):
    """Earliest deadline first, frame by frame and slot by slot; weights are whole numbers."""
    order, frame, start = {}, 0, 0
    while any(frame * w[s] < b for s, b in blocks.items()):
        left = {s: min(w[s], b - frame * w[s]) for s, b in blocks.items() if frame * w[s] < b}
        total, done = sum(left.values()), dict.fromkeys(left, 0)
        for t in range(total):
            ready = [(-(-(done[s] + 1) * total // m), m, done[s], s) for s, m in left.items() if done[s] < m and done[s] * total // m <= t]
            deadline, _, _, s = min(ready)
            order[s, frame * w[s] + done[s]] = (start + t, start + done[s] * total // left[s], start + deadline)
            done[s] += 1
        start, frame = start + total, frame + 1
    return order


@pytest.mark.parametrize("at_once", [2, 10_000])
def test_schedule_against_brute_force(spark, monkeypatch, at_once):
    """Every slot, release and deadline by default weights, and deviation below one block at every slot of the mix."""
    monkeypatch.setattr(mixing, "FRAMES_AT_ONCE", at_once)
    sizes = {"a": 900, "b": 400, "c": 100, "d": 100, "e": 3, None: 40}
    docs = spark.createDataFrame([(i, s) for s, n in sizes.items() for i in range(n)], "doc_id long, source string")
    found = mixing.mix(docs, block_rows=4).collect()
    roots = {s: math.sqrt(n) for s, n in sizes.items()}
    unit = max(min(roots.values()), sum(roots.values()) / mixing.FRAME_SLOTS)
    w, blocks = {s: max(1, round(r / unit)) for s, r in roots.items()}, {s: -(-n // 4) for s, n in sizes.items()}
    named = lambda d: {("-" if s is None else "=" + s): v for s, v in d.items()}
    want = plain_pfair(named(blocks), named(w))
    assert {(named({r.source: 0}).popitem()[0], r.block): (r.slot, r.release, r.deadline) for r in found} == want
    whole = min(blocks[s] // w[s] for s in sizes)
    assert whole > 0 and max(r.slot for r in found if r.in_mix) == whole * sum(w.values()) - 1
    done, by_slot = Counter(), {r.slot: r.source for r in found}
    for t in range(whole * sum(w.values())):
        done[by_slot[t]] += 1
        assert all(abs(done[s] - (t + 1) * w[s] / sum(w.values())) < 1 for s in sizes)


def test_many_sources_share_one_frame(spark):
    """Thousands of sources of one block: one entry of the fold, every block its own slot."""
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3000, F.concat(F.lit("h"), "id")).otherwise("big").alias("source"))
    found = mixing.mix(docs, block_rows=1).collect()
    assert sorted(r.slot for r in found) == list(range(6000)) and all(r.release <= r.slot < r.deadline for r in found)


# 6. Language


@here
def test_languages_on_held_out_texts(spark):
    lang = spark.read.parquet(f"{SMALL}/documents.parquet").where("lang is not null").select("doc_id", "lang")
    found = QUERIES["op6_language_id"](spark, SMALL).where("held_out and lang_pred != 'und'").join(lang, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in found) > 0.95 * len(found)


def test_no_letter_is_und(spark, tables):
    found = {r.doc_id: r for r in QUERIES["op6_language_id"](spark, tables).collect()}
    assert {found[i].lang_pred for i in (140, 141, 142)} == {"und"} and found[145].lang_pred in ("en", "fr")


def plain_language_model(docs, smoothing=0.5):
    """Counts and scores by dictionaries, n-gram by n-gram."""
    fold = lambda t: " " + "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in t) + " "
    m = [0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D]

    def grams(t):
        t = fold(t or "")
        for n in (1, 2, 3):
            for p in range(len(t) - n + 1):
                g, h = t[p : p + n], 0
                if {1: g != " ", 2: g != "  ", 3: g[1:2] != " "}[n]:
                    for k in range(n):
                        h = (h * m[0] + (ord(g[k]) + k + 1) * m[1]) % 2**32
                    yield ((h ^ (h >> 15)) * m[2] % 2**32) >> 18

    counts = defaultdict(Counter)
    for t, lang in docs:
        counts[lang].update(grams(t))
    langs, rows = sorted(counts), Counter(lang for _, lang in docs)
    total = {x: sum(counts[x].values()) + smoothing * langid.BUCKETS for x in langs}

    def score(t):
        g = list(grams(t))
        if not any(c.isalpha() for c in t or ""):
            return "und", 0.0
        full = [sum(round(2**24 * math.log((counts[x][b] + smoothing) / total[x])) for b in g) / 2**24 + math.log(rows[x] / len(docs)) for x in langs]
        z = [math.exp((v - max(full)) / math.sqrt(len(g))) for v in full]
        return langs[full.index(max(full))], max(z) / sum(z)

    return score


@pytest.mark.parametrize("cut", [1, 5])
def test_languages_against_brute_force(spark, tables, cut):
    """Every label and score, however the table is cut."""
    want = plain_language_model([(t, la) for i, t, la, _ in rows() if la is not None and i is not None and crc(i, 4) != 2])
    docs = spark.read.parquet(f"{tables}/documents.parquet").repartition(cut)
    found = langid.predict_languages(docs, langid.fit_languages(docs, learn=F.col("id").isNotNull() & (langid.crc_mod("id", 4) != 2))).collect()
    expected = sorted((str(i), *want(t)) for i, t, _, _ in rows())
    for (i, lang, s), r in zip(expected, sorted(found, key=lambda r: (str(r.id), r.lang_pred, r.score)), strict=True):
        assert (i, lang) == (str(r.id), r.lang_pred) and math.isclose(s, r.score, abs_tol=1e-9)


# 7. Exact deduplication


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_against_brute_force(spark, tables, keep):
    groups = defaultdict(list)
    for i, t, _, _ in rows():
        groups[t or ""].append(i)
    pick = lambda ids: ({"max": max, "min": min}[keep](x) if (x := [i for i in ids if i is not None]) else None)
    want = sorted((str(i), str(pick(ids)), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
    found = dedup_exact(spark.read.parquet(f"{tables}/documents.parquet").repartition(23), keep=keep).collect()
    assert sorted((str(r.id), str(r.keep_id), r.group_size, r.digest.hex()) for r in found) == want
    assert sum(r.kept for r in found) == len(groups)


# 8. Near duplicates


def brute_components(docs, k, percent):
    sets, parent = {}, {}
    for i, t in docs:
        w = words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        parent[i] = i

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_against_brute_force(spark, tables):
    docs = [(i, t) for i, t, _, _ in rows() if i is not None and i != 146]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op8_minhash_near_dedup"](spark, tables).collect() if r.doc_id not in (None, 146)}
    assert found == brute_components(docs, 4, 80)


@here
def test_near_against_brute_force_on_a_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op8_minhash_near_dedup"](spark, "/root/testdata/sf0.001").collect()}
    assert found == brute_components(docs, 4, 80)


def test_densified_signatures_estimate_similarity():
    oph, rng = OnePermutation(42, 6), np.random.default_rng(2)
    for n in (20, 3000):
        both, a, b = (rng.integers(0, 2**64, m, dtype=np.uint64) for m in (8 * n // 10, n // 10, n // 10))
        one, two = (oph.signature(np.unique(np.concatenate([both, x]))) for x in (a, b))
        assert abs((one == two).mean() - len(both) / (len(both) + len(a) + len(b))) < 0.25


def test_pairs_at_the_threshold_share_a_bucket():
    """Pairs of similarity 0.8 and just above, sets of few and of many shingles: no band may be needed twice."""
    oph, rng = OnePermutation(near_dedup.BANDS, near_dedup.ROWS), np.random.default_rng(11)
    for n in (5, 10, 40, 200, 1000):
        missed = 0
        for _ in range(300):
            both, a, b = (rng.integers(0, 2**64, m, dtype=np.uint64) for m in (8 * n // 10, n // 10, n // 10 + n % 10 // 5))
            one, two = (oph.band_keys(oph.signature(np.unique(np.concatenate([both, x])))) for x in (a, b))
            assert len(both) * 100 >= 80 * (len(both) + len(a) + len(b)) - 100
            missed += not np.intersect1d(one, two).size
        assert missed == 0


def test_overlaps_are_exact():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 300, rng.integers(0, 90))).astype(np.uint64) for _ in range(12)]
    want = [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:5]]
    assert near_dedup.overlaps(sets[:5], sets[5:]).tolist() == want


@pytest.mark.parametrize("tile", [4, 1024])
def test_links_away_from_the_centres(spark, monkeypatch, tile):
    """Members that are like each other, not like the centres, still find each other in tiles of any size."""
    monkeypatch.setattr(near_dedup, "TILE", tile)
    texts = [(i, " ".join(f"w{(j if j < 30 else j + 100 * (i % 5))}" for j in range(60))) for i in range(40)]
    texts = [(i, t + " " + " ".join(f"z{i}{j}" for j in range(2))) for i, t in texts]
    df, labels = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([], "node long, label long")
    links = near_dedup.across_components(df.selectExpr("1L as key", "id"), df, labels, 4, 80).collect()
    found = defaultdict(set)
    for r in links:
        found[r.a % 5] |= {r.a, r.b}
        assert r.a % 5 == r.b % 5
    assert all(len(v) == 8 for v in found.values()) and len(found) == 5


# 9. WARC


@pytest.fixture
def archived(spark, tables, tmp_path):
    folder = f"file://{tmp_path}/warc"
    pages = warc.numbered_pages(spark.read.parquet(f"{tables}/pages.parquet"))
    captures = warc.write_archives(pages, folder)
    warc.write_directory(warc.write_index(captures, folder, lines_per_block=2), folder, part_lines=2)
    return folder, pages, captures


def test_archives_and_index(archived):
    folder, _, captures = archived
    index = warc.CaptureIndex(folder)
    found = index.lookup("https://example.org/a?b=1")
    assert sorted(c["page_id"] for c in found) == [1, 6]
    assert {c["page_id"]: index.fetch(c)["payload"] for c in found if c["record_type"] == "response"}[6] == b"later"
    assert len(index.lookup("http://a.b/")) == 3 and index.lookup("http://nowhere/") == []
    for r in warc.read_archives(captures).collect():
        html = [h or "" for i, _, h in PAGES if i == r.page_id]
        assert r.payload_digest in {base64.b32encode(hashlib.sha1(h.encode()).digest()).decode() for h in html}
        assert r.record_type == "response" or r.refers_to == {"<p>one</p>": 2, "": 4, "ü": 5}[html[0]]


def test_pages_are_read_through_the_index(archived, tmp_path):
    """The lookups give what the archives hold, and nothing without the index."""
    folder, pages, captures = archived
    whole = warc.read_archives(captures).drop("archive", "offset", "length")
    assert sorted(map(str, warc.read_by_index(pages, folder).collect())) == sorted(map(str, whole.collect()))
    for part in tmp_path.glob("warc/captures-*"):
        part.unlink()
    with pytest.raises(Exception, match="FileNotFoundError"):
        warc.read_by_index(pages, folder).collect()


def test_pages_of_one_url_with_a_long_payload_and_clashing_columns(spark, tmp_path, monkeypatch):
    """One URL and one payload on most rows, a payload of several megabytes, other columns of any name."""
    monkeypatch.setattr(warc, "HOT_ROWS", 50)
    long = "<p>" + "".join(f"{i:x} " for i in range(900_000))
    html = {i: "same" if i < 400 else long if i == 400 else f"p{i}" for i in range(500)}
    pages = spark.createDataFrame([(i, "http://one.org/", h, 7, "a", 1) for i, h in html.items()], "page_id long, url string, html string, seq long, payload string, n int")
    rows = warc.numbered_pages(pages.repartition(7))
    folder = f"file://{tmp_path}/warc"
    warc.write_directory(warc.write_index(warc.write_archives(rows, folder, archive_bytes=20_000), folder, lines_per_block=20), folder, part_lines=3)
    found = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_by_index(rows, folder).collect()}
    assert found == {i: (len(h), "revisit" if i < 399 else "response", 399 if i < 399 else None) for i, h in html.items()}


def test_url_keys_sort_by_host():
    assert warc.url_key("http://www.Example.org:80/a?b=1#c") == "org,example)/a?b=1"
    assert warc.url_key(None) == ")/" and warc.url_key("http://h:99") == "h:99)/"


# 10. Personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    twice = lambda x: x * 2 - 9 * (x > 4)
    return sum(twice(int(c)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TRICKY = ["a@b.c", "a@b..c d@e.f.g", "@@x@y.z@w.v", "1.2.3.4.5.6.7.8", "1.2.3.999 1.2.3.4", "00001.2.3.4", "+1 234 567 89", "+1(234)567-8901.", "++49 (30) 1234567 +", "4111-1111-1111-1111 4111111111111112", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0", "\U0001f600 ü@x.y a.b+c%d@x-y.co.uk", "x@y x@y.z.", "5500 0000 0000 0004\n10.0.0.256", ""]


def test_spans_against_plain_patterns(spark):
    texts = TRICKY + [t or "" for _, t, _, _ in rows()]
    if os.path.isdir(SMALL):
        texts += [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    named = F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string")))
    found = {r.id: r.spans for r in privacy.find_base(df).select("id", named.alias("spans")).collect()}
    assert found == {i: brute_spans(t) for i, t in enumerate(texts)}


def test_terms_that_give_an_entity_away(spark):
    lines = [(i, f"write zanzibar at boss@corp.com note{i} please\nnothing here line{i}") for i in range(8)] + [(100 + i, f"please write the common note at day{i}") for i in range(80)]
    df = spark.createDataFrame(lines, "doc_id long, text string")
    found = {r.id: r.terms for r in privacy.find_personal(df).collect()}
    assert [(t.s, t.e) for t in found[3]] == [(6, 14)] and not found[100]
    safe = {r.id: r.text for r in privacy.sanitise(df).collect()}
    assert "zanzibar" not in safe[3] and "[email]" in safe[3] and "please" in safe[3] and safe[100] == lines[8][1]


def brute_disclosure(texts, support, at):
    """Disclosure of every pair by its definition, and the general term of every entity."""
    name = lambda kind, m: f"{kind}:" + (m.lower() if kind == "email" else m if kind == "ip" else re.sub("[^0-9]", "", m))
    of_entity, of_term, both, kinds_of_line = Counter(), Counter(), Counter(), defaultdict(set)
    lines = [line for t in texts for line in t.split("\n")]
    for line in lines:
        spans = [(k, line[int(a) : int(b)]) for k, a, b in (x.split(":") for x in brute_spans(line))]
        bare = line
        for pattern in PLAIN.values():
            bare = re.sub(pattern, " ", bare)
        terms = {w.lower() for w in re.findall(r"[^\W_]+", bare) if re.search(r"[^\W\d_]", w)}
        of_term.update({w.lower() for w in re.findall(r"[^\W_]+", line)})
        for e in {name(k, m) for k, m in spans}:
            of_entity[e] += 1
            for t in terms:
                both[e, t] += 1
                kinds_of_line[e, t].add(line)
    n, d = math.log(len(lines)), {}
    for (e, t), c in both.items():
        if len(kinds_of_line[e, t]) >= support and of_term[t]:  # cut-up words are no terms
            worth = n - math.log(of_entity[e])
            d[e, t] = (n + math.log(c) - math.log(of_term[t]) - math.log(of_entity[e])) / worth if worth > 0 else 0.0
    general = {}
    for e in of_entity:
        broad = [(-v, t) for (f, t), v in d.items() if f == e and v < at and both[e, t] >= privacy.SUBSUMES * of_entity[e]]
        general[e] = min(broad)[1] if broad else f"[{e.split(':')[0]}]"
    return {(e, t): (v, general[e]) for (e, t), v in d.items() if v >= at}


def test_disclosure_against_brute_force(spark):
    rng = np.random.default_rng(12)
    entities = ["ann@x.org", "bob@y.net", "10.1.2.3", "+44 20 7946 0958", "Ann@X.org"]
    special = {e: [f"mark{k}{j}" for j in range(3)] for k, e in enumerate(entities)}
    texts = []
    for i in range(300):
        made = []
        for _ in range(rng.integers(1, 5)):
            ws = [str(w) for w in rng.choice(["the", "of", "mail", "reach", "call", "desk", "note"], 5)] + [f"n{rng.integers(0, 50)}"]
            if rng.random() < 0.3:
                e = entities[rng.integers(0, len(entities))]
                ws += [e, "contact", *(w for w in special[e] if rng.random() < 0.7)]
            elif rng.random() < 0.05:
                ws.append(special[entities[0]][0])
            made.append(" ".join(rng.permutation(ws)))
        texts.append("\n".join(made))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_disclosure(texts, privacy.SUPPORT, privacy.GENERALISE_AT)
    found = {(r.entity, r.term): (r.disclosure, r.general) for r in privacy.disclosing_terms(docs, privacy.find_base(docs)).collect()}
    assert want and found.keys() == want.keys() and {g for _, g in want.values()} & {"contact"}
    for k, (d, g) in want.items():
        assert math.isclose(found[k][0], d, rel_tol=1e-9) and found[k][1] == g


def test_sanitise_keeps_every_row(spark):
    """Null and repeated ids are rows of their own; general terms stand where terms were generalised."""
    body = "write zanzibar to boss@corp.com about it contact note{}"
    docs = [(7, body.format(i)) for i in range(6)] + [(None, body.format(9)), (None, None), (8, "")] + [(100 + i, f"contact us about it day{i}") for i in range(80)]
    found = privacy.sanitise(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(str(r.id) for r in found) == sorted(str(i) for i, _ in docs)
    assert sum("[email]" in r.text for r in found) == 7 and not any("zanzibar" in r.text for r in found)
    soft = privacy.sanitise(spark.createDataFrame(docs, "doc_id long, text string"), remove_at=2.0).where("id = 7").collect()
    assert len(soft) == 6 and all("write" not in r.text or "zanzibar" not in r.text for r in soft)
