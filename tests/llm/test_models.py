"""The learnt operators, the tokenizer and the vectors: held-out accuracy, round trips, plain versions."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from lorekeep.llm import embedding_dedup, piece_encoding, pseudo_likelihood, quality_classifier
from lorekeep.llm.common import components

from .test_text_operators import plain_components

SF = "/root/testdata/sf0.1"


def test_classifier_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_classifier.op7(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1].score, got[got.quality == 0].score
    assert len(bad) > 100
    auc = np.mean(good.to_numpy()[:, None] > bad.to_numpy()[None, :])
    assert auc > 0.99 and (good >= 0.5).mean() > 0.99 and (bad < 0.5).mean() > 0.9
    assert got.score.between(0, 1).all()


def test_classifier_edges(spark, as_docs, odd_texts):
    docs = as_docs(odd_texts)
    labels = spark.createDataFrame([(20, 1, 0), (21, 1, 0), (60, 0, 0), (44, 0, 0), (45, None, 1), (22, 7, 0), (None, 1, 0), (23, 1, 0), (23, 0, 0), (21, 1, 1), (999, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality_classifier.op7(docs, labels).count() == len(odd_texts)
    one = quality_classifier.op7(docs, labels.where("quality = 1")).collect()
    assert {r.score for r in one} == {1.0}
    assert {r.score for r in quality_classifier.op7(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.op7(as_docs([]), labels).count() == 0


def plain_features(raw: bytes) -> set:
    """Byte 1-, 2- and 3-grams and repetitions of a word, by plain loops."""
    q = quality_classifier
    out = set(raw) | {256 + (a << 8) + b for a, b in zip(raw, raw[1:], strict=False)}
    out |= {q.BASE3 + ((((a << 16) | (b << 8) | c) * 2654435761 % 2**32) >> (32 - q.TRI_BITS)) for a, b, c in zip(raw, raw[1:], raw[2:], strict=False)}
    run, last = 0, None
    for w in raw.split():
        run, last = (run + 1 if w == last else 0), w
        if 1 <= run <= q.REPEATS:
            out.add(q.BASE_R + run - 1)
    return out


def test_features_equal_plain_ones(odd_texts):
    seen = np.zeros(quality_classifier.SIZE, bool)
    for _, text in odd_texts:
        raw = (text or "").encode()
        assert set(quality_classifier.features(raw, seen).tolist()) == plain_features(raw)


def test_fit_reaches_the_plain_optimum():
    """The weights, divided by the log-count ratios, minimise the hinge-loss objective that a plain solver minimises too; the
    curve's gradient is zero at its slope and intercept."""
    q, r = quality_classifier, np.random.default_rng(3)
    y = r.integers(0, 2, 100)
    rows = [np.flatnonzero(r.random(40) < np.where(np.arange(40) < 12, 0.15 + 0.3 * k, 0.25)).astype(np.uint32) for k in y]
    w, a, b = q.fit(rows, y, 0.4)
    fit_on = np.flatnonzero(np.arange(100) % 5 != 4)
    count = np.ones((2, q.SIZE))
    for i in fit_on:
        count[y[i], rows[i]] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    x = np.zeros((100, 40))
    for i, ids in enumerate(rows):
        x[i, ids] = ratio[ids] / max(1.0, np.sqrt(len(ids)))
    sign, share = np.where(y == 1, 1.0, -1.0), [(y[fit_on] == k).mean() for k in (0, 1)]
    c = np.array([q.C * 0.5 / share[k] for k in y])
    value = lambda v: 0.5 * v @ v + (c * np.maximum(0, 1 - sign * (x @ v)))[fit_on].sum()
    v = np.zeros(40)
    for step in range(1, 30001):
        on = fit_on[(sign * (x @ v))[fit_on] < 1]
        v -= (v - (c * sign)[on] @ x[on]) / (step + 10)
    found = np.where(ratio[:40] != 0, w[:40] / np.where(ratio[:40] == 0, 1, ratio[:40]), 0)
    assert value(found) <= 1.02 * value(v) and abs(w[40:]).max() == 0
    out = np.arange(100) % 5 == 4
    m, t = x[out] @ found, y[out]
    weight = np.where(t == 1, 0.4, 0.6) / np.where(t == 1, t.sum(), (1 - t).sum()) * out.sum()
    target = np.where(t == 1, (t.sum() + 1) / (t.sum() + 2), 1 / ((1 - t).sum() + 2))
    g = weight * (1 / (1 + np.exp(-(a * m + b))) - target)
    assert abs((g * m).sum() + 1e-3 * a) < 1e-6 and abs(g.sum()) < 1e-6


def test_features_in_blocks(monkeypatch):
    seen, text = np.zeros(quality_classifier.SIZE, bool), ("héllo wörld ! " * 300).encode()
    whole = quality_classifier.features(text, seen)
    monkeypatch.setattr(quality_classifier, "BLOCK", 64)
    assert (quality_classifier.features(text, seen) == whole).all() and not seen.any()


def test_pieces_equal_the_library(spark, as_docs, odd_texts):
    import sentencepiece as sp

    own = sp.SentencePieceProcessor(model_file=piece_encoding.default_model())
    r = random.Random(7)
    letters = "ab the \n\té漢字🎉́  erZ1.,¿ñ\x00"
    rows = [*odd_texts, *((500 + i, "".join(r.choice(letters) for _ in range(r.randint(0, 60)))) for i in range(400)), (950, "a" * 3000), (951, "x▁y")]
    got = piece_encoding.decode_ids(piece_encoding.encode(as_docs(rows)), text_col="back").collect()
    assert len(got) == len(rows)
    for x in got:
        assert x.ids == (None if x.text is None else own.encode(x.text))
        assert x.back == (None if x.text is None else x.text.replace("▁", " "))
    assert piece_encoding.op4(as_docs(rows)).where("not round_trip").count() == 0
    assert piece_encoding.op4(as_docs([])).count() == 0


def test_pieces_stage_decodes(spark, as_docs, odd_texts):
    got = piece_encoding.stage(spark, as_docs(odd_texts), "").toPandas()
    assert list(got.columns) == ["doc_id", "source", "ids", "n_ids", "round_trip"]
    assert len(got) == len(odd_texts) and got.round_trip.all() and set(got.source) == {"src1"}
    assert [n for n in got.n_ids] == [0 if x is None else len(x) for x in got.ids]


def test_long_words_in_blocks(monkeypatch):
    """Words of a million characters equal the library's result, at under 20 us a character (900 for one column after another)."""
    import time

    import sentencepiece as sp

    path = piece_encoding.default_model()
    own, p, r = sp.SentencePieceProcessor(model_file=path), piece_encoding.pieces(path), random.Random(3)
    coded = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(1 << 20))
    p.words.clear()
    began = time.process_time()
    got = piece_encoding.encode_batch(p, [coded])[0]
    assert (time.process_time() - began) / len(coded) < 2e-5
    assert got.tolist() == own.encode(coded)
    for text in ("".join(chr(r.randint(0x4E00, 0x9FA5)) for _ in range(30000)), "a" * 20011, "ab" * 9000 + "c" + "-" * 9000, "".join(r.choice(["the", "ing", "Ω", "é", "zz", "==="]) for _ in range(6000))):
        assert piece_encoding.encode_batch(p, [text])[0].tolist() == own.encode(text)
    monkeypatch.setattr(piece_encoding, "LONG", 40)
    monkeypatch.setattr(piece_encoding, "PART", 300)
    monkeypatch.setattr(piece_encoding, "_agree", lambda *_: False)  # from the state before, each time
    text = "".join(r.choice("abetrs1=") for _ in range(1500))
    p.words.clear()
    assert piece_encoding.encode_batch(p, [text])[0].tolist() == own.encode(text)


def test_words_of_unequal_length_advance_together(monkeypatch):
    """A few long words of a batch, equal in length or not, cost some 25 us a character (600 for one word after another)."""
    import time

    import sentencepiece as sp

    path = piece_encoding.default_model()
    own, p, r = sp.SentencePieceProcessor(model_file=path), piece_encoding.pieces(path), random.Random(8)
    coded = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    p.edges, p.alone
    for words in ([coded(3000) for _ in range(10)], [coded(600 + i) for i in range(20)]):
        began = time.process_time()
        got = piece_encoding.encode_batch(p, words)
        assert (time.process_time() - began) / sum(map(len, words)) < 4e-5  # 27 and 18 us measured; room for a busy machine
        assert [x.tolist() for x in got] == own.encode(words)
    odd = ["".join(r.choice(["a", "漢", "Ω", "\x00", "the", "🎉", "="]) for _ in range(r.choice([1, 31, 33, 40, 700, 2047, 2049, 5000]))) for _ in range(60)]
    whole = own.encode(odd)
    for few in (0, 1 << 20):
        monkeypatch.setattr(piece_encoding, "FEW", few)
        p.words.clear()
        assert [x.tolist() for x in piece_encoding.encode_batch(p, odd)] == whole
    monkeypatch.setattr(piece_encoding, "CELLS", 4096)
    p.words.clear()
    assert [x.tolist() for x in piece_encoding.encode_batch(p, odd)] == whole


def test_unigram_viterbi():
    p = piece_encoding.Pieces.__new__(piece_encoding.Pieces)
    r = random.Random(1)
    vocab = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(30)} | set("ab"))
    p.text, p.bpe, p.prefix, p.unk, p.byte, p.byte_of, p.special = vocab, False, "", 0, {}, {}, set()
    p.n, p.score_of, p.width = len(vocab), np.array([-r.random() * 5 - 1 for _ in vocab]), 4
    h = np.array([p._hash(v) for v in vocab], np.uint64)
    order = np.argsort(h)
    p.keys, p.key_ids = h[order], order
    p.leading = np.zeros(1 << piece_encoding.LEAD, bool)
    p.leading[p.keys >> np.uint64(64 - piece_encoding.LEAD)] = True
    ids = {v: i for i, v in enumerate(vocab)}
    words = ["".join(r.choice("abc") for _ in range(7)) for _ in range(200)]

    def best(w):
        top = [(0.0, ())] + [None] * len(w)
        for e in range(1, len(w) + 1):
            c = [(top[s][0] + p.score_of[ids[w[s:e]]], (*top[s][1], ids[w[s:e]])) for s in range(max(0, e - 4), e) if w[s:e] in ids]
            if w[e - 1] not in ids:
                c.append((top[e - 1][0] + p.score_of.min() - 10, (*top[e - 1][1], 0)))
            top[e] = max(c)
        return top[-1][1]

    for w, x in zip(words, piece_encoding.viterbi(p, words), strict=True):  # equal sums may be reached in several orders
        assert sorted(np.frombuffer(x, np.int32).tolist()) == sorted(best(w))


def vectors():
    r = np.random.default_rng(4)
    centre = r.normal(size=(12, 16))
    rows = []
    for i in range(260):
        v = centre[i % 12] * r.uniform(0.5, 2) + r.normal(size=16) * r.choice([0.0, 0.05, 0.12, 1.0])
        rows.append((i, v.tolist(), int(i % 3) if i % 29 else None))
    rows += [(300 + i, rows[1][1], 1) for i in range(5)] + [(1, rows[1][1], rows[1][2]), (None, rows[1][1], 1)]
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] + [1.0] * 15, 1), (403, [None] + [1.0] * 15, 1), (404, [float("inf")] + [1.0] * 15, 1), (405, [], 1), (406, rows[1][1][:8], 1), (407, rows[1][1][:8], 1)]
    return rows


@pytest.mark.parametrize("tile", [1024, 4])
def test_embedding_dedup(spark, tile):
    rows = vectors()
    ok = [v is not None and len(v) > 0 and None not in v and bool(np.isfinite(v).all()) and any(v) and k is not None for _, v, k in rows]
    links = []
    for i, (_, a, k) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if ok[i] and ok[j] and rows[j][2] == k and len(a) == len(b) and np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)) >= 0.98:
                links.append((i, j))
    degree, root = Counter(x for e in links for x in e), plain_components(len(rows), links)
    low = {}
    for (i, *_), c in zip(rows, root, strict=True):
        low[c] = min((x for x in (low.get(c), i) if x is not None), default=None)
    want = Counter((i, degree[n], low[c], i is not None and i == low[c]) for n, ((i, *_), c) in enumerate(zip(rows, root, strict=True)))
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, g string").repartition(3)
    assert Counter(tuple(r) for r in embedding_dedup.near(df, tile=tile).collect()) == want
    assert embedding_dedup.op5(df.limit(0)).count() == 0


def test_matching_in_blocks(monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 7)
    r = np.random.default_rng(2)
    x = embedding_dedup._unit(r.normal(size=(60, 40)).ravel(), 40)
    y = embedding_dedup._unit((x[r.integers(0, 60, 90)] + r.normal(size=(90, 40)) * 0.03).ravel(), 40)
    turn = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    for threshold in (0.2, 0.9, 0.98):
        i, j = embedding_dedup.matching(x, y, turn, threshold)
        assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(zip(*(v.tolist() for v in np.nonzero(x @ y.T >= threshold)), strict=True))


def test_join_of_hot_keys(spark):
    """Keys of most rows, null keys, repeated rows and columns that have no hash: the same rows as a plain join."""
    from pyspark.sql import functions as F

    from lorekeep.llm.common import join_spread

    rows = [(1, "a")] * 3000 + [(2, str(i)) for i in range(500)] + [(i, "b") for i in range(10, 90)] + [(None, "c")] * 900
    df = spark.createDataFrame(rows, "k int, x string").repartition(4).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    given = spark.createDataFrame([(k, n, k * 10) for k, n in Counter(k for k, _ in rows).items() if k and k % 7], "k int, n long, y int")
    for how in ("inner", "left"):
        got = join_spread(df, given, ["k"], how=how).select("k", "x", "y")
        want = df.join(given, "k", how).select("k", "x", "y")
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(400 + i, 401 + i) for i in range(60)]
    root = plain_components(500, edges)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {n: root[n] for n in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pseudo_likelihood_learns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 4 = 0")
    known = pseudo_likelihood.vocabulary(docs)
    assert len(known) == pseudo_likelihood.TOP
    params = pseudo_likelihood.train(pseudo_likelihood.tokenise(docs, known))
    score = lambda d: pseudo_likelihood.score(pseudo_likelihood.tokenise(d, known), params).toPandas()
    other = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 40 = 1").select("doc_id", "text")
    got = score(other)
    ids = pseudo_likelihood.Tokens(known)
    seen = [pseudo_likelihood.tokens(t, ids) for t in docs.select("text").toPandas().text]
    unigram = np.bincount(np.concatenate(seen), minlength=pseudo_likelihood.PAD) + 1.0
    unigram /= unigram.sum()
    bigram = Counter(x for s in seen for x in zip(s[:-1].tolist(), s[1:].tolist(), strict=True))
    before = Counter()
    for (a, _), n in bigram.items():
        before[a] += n
    texts = [pseudo_likelihood.tokens(t, ids).tolist() for t in got.text]
    one = sum(np.log(unigram[t]).sum() for t in texts)
    two = sum(np.log(0.8 * bigram[(a, b)] / max(1, before[a]) + 0.2 * unigram[b]) for t in texts for a, b in zip([-1, *t], t, strict=False))
    assert got.log_likelihood.sum() > 0.9 * one and got.log_likelihood.sum() > 0.97 * two  # all are negative
    mixed = spark.createDataFrame([(i, " ".join(random.Random(i).sample(t.split(), len(t.split())))) for i, t in zip(got.doc_id, got.text, strict=True)], "doc_id long, text string")
    assert got.log_likelihood.sum() > score(mixed).log_likelihood.sum()


def test_pseudo_likelihood_plain(monkeypatch):
    params = [x + np.random.default_rng(1).normal(0, 0.1, x.shape).astype(np.float32) for x in pseudo_likelihood.start()]
    r = np.random.default_rng(0)
    texts = [r.integers(0, pseudo_likelihood.PAD, n).astype(np.int16) for n in (5, 0, 1, 9)]
    flat, at = pseudo_likelihood.stream(texts)
    monkeypatch.setattr(pseudo_likelihood, "SPAN", 4)
    got, want, k = pseudo_likelihood.log_probabilities(params, flat, at), [], 0
    for t in texts:
        full = np.concatenate([[pseudo_likelihood.PAD] * 2, t, [pseudo_likelihood.PAD] * 2]).astype(int)
        for i in range(2, len(full) - 2):
            h = np.append(np.tanh(sum(params[0][j][full[i + o]] for j, o in enumerate(pseudo_likelihood.OFFSETS))), 1)
            a, y = params[1] @ h, full[i]
            b = params[2][y // 32] @ h
            want.append(a[y // 32] - np.log(np.exp(a).sum()) + b[y % 32] - np.log(np.exp(b).sum()))
    assert np.allclose(got, want, atol=1e-4)


def test_pseudo_likelihood_gradients(monkeypatch):
    """With large sums of squares a step is the gradient times a constant: it equals differences of the loss."""
    p, r = pseudo_likelihood, np.random.default_rng(6)
    params = [x.astype(np.float64) + r.normal(0, 0.2, x.shape) for x in p.start()]
    flat, at = p.stream([r.integers(0, p.PAD, 40).astype(np.int16), r.integers(0, p.PAD, 3).astype(np.int16)])
    loss = lambda q: -p.log_probabilities(q, flat, at).mean()
    after = [x.copy() for x in params]
    p.train_on(after, [np.full(x.shape, 1e8) for x in params], flat, at)
    probes = [(0, (k, int(flat[at[i] + o]), d)) for k, o in enumerate(p.OFFSETS) for i in (0, 7, 20, 41) for d in (0, 5)]
    probes += [(1, (int(b), d)) for b in (0, 9, 31) for d in (0, 3, p.DIM)]
    probes += [(2, (int(p.TARGET[flat[at[i]]]) // p.WIDTH, int(p.TARGET[flat[at[i]]]) % p.WIDTH, d)) for i in (0, 5, 30) for d in (0, p.DIM)]
    for j, where in probes:
        slope = []
        for e in (2e-2, -2e-2):
            moved = [x.copy() for x in params]
            moved[j][where] += e
            slope.append(loss(moved))
        want = (slope[0] - slope[1]) / 4e-2
        got = (params[j][where] - after[j][where]) * 1e4 / p.RATE
        assert got == pytest.approx(want, rel=0.03, abs=2e-5)


def test_pseudo_likelihood_sums_of_many_partitions(spark, monkeypatch):
    """Parameters are averaged in proportion to tokens, in as many steps as there are: the same for one step or two."""
    p = pseudo_likelihood
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 200").repartition(6, "doc_id")
    ids = p.tokenise(docs, p.vocabulary(docs))
    whole = p.train(ids, rounds=1)
    monkeypatch.setattr(p, "STEP", 1)
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(whole, p.train(ids, rounds=1), strict=True))


def test_pseudo_likelihood_of_a_very_long_text(as_docs):
    r = random.Random(2)
    text = " ".join(r.choice(["the", "cat", "sat", "on", "mats", f"rare{r.randint(0, 9999)}"]) for _ in range(60000))
    one = pseudo_likelihood.op10(as_docs([(1, text), (2, "the cat"), (3, None)])).toPandas().set_index("doc_id")
    assert one.n_tokens.to_dict() == {1: 60000, 2: 2, 3: 0} and np.isfinite(one.log_likelihood).all()


def test_pseudo_likelihood_edges(as_docs, odd_texts):
    got = pseudo_likelihood.op10(as_docs(odd_texts)).collect()
    assert len(got) == len(odd_texts)
    assert all((r.mean_log_likelihood is None) == (r.n_tokens == 0) and r.log_likelihood <= 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert pseudo_likelihood.op10(as_docs([])).count() == 0


def test_pseudo_likelihood_of_every_word(as_docs, monkeypatch):
    """The probability of a class is divided among all its words, sent to the tasks or joined."""
    p, r = pseudo_likelihood, random.Random(8)
    monkeypatch.setattr(p, "KNOWN", p.TOP + 20)
    letters = lambda: "".join(r.choice("abcdefgh") for _ in range(7))
    common, rare = [letters() for _ in range(p.TOP)], [letters() for _ in range(60)]
    pool = common * 9 + [w for i, w in enumerate(rare) for _ in range(1 + i % 5)]
    r.shuffle(pool)
    docs = as_docs([(i, " ".join(pool[i * 40 : i * 40 + 40])) for i in range(len(pool) // 40 + 1)])
    n = Counter(pool)
    top = {w for w, _ in sorted(n.items(), key=lambda x: (-x[1], x[0]))[: p.TOP]}
    total = sum(k for w, k in n.items() if w not in top)
    monkeypatch.setattr(p, "train", lambda ids: p.start())
    plain = {x.doc_id: x.log_likelihood for x in p.score(p.tokenise(docs, p.vocabulary(docs)), p.start()).collect()}
    texts = {x.doc_id: x.text for x in docs.select("doc_id", "text").collect()}
    for x in p.op10(docs).collect():
        share = sum(np.log(n[w] / total) for w in texts[x.doc_id].split() if w not in top)
        assert x.n_tokens == len(texts[x.doc_id].split())
        assert x.log_likelihood == pytest.approx(plain[x.doc_id] + share) and x.mean_log_likelihood == pytest.approx(x.log_likelihood / x.n_tokens)


def test_pseudo_likelihood_tells_neighbours_of_one_class_apart():
    p = pseudo_likelihood
    ids = p.Tokens({})
    a, b = (p.inputs(p.split(t), ids) for t in ("x stone x", "x stoat x"))
    assert a[1] != b[1] and p.TARGET[a[1]] == p.TARGET[b[1]] == p.shape("stone")


def test_pseudo_likelihood_steps_equal_plain_steps(monkeypatch):
    """Steps of all blocks and offsets at once are those of plain sums a token, for logits that need a shift and for those that do not."""
    p, r = pseudo_likelihood, np.random.default_rng(3)
    flat, at = p.stream([np.minimum(r.zipf(1.3, n), p.PAD - 1).astype(np.int16) for n in (700, 0, 1, 60)])
    monkeypatch.setattr(p, "BATCH", 500)
    for spread in (0.1, 30.0):
        params = [x.astype(np.float64) + r.normal(0, spread, x.shape) * (j > 0) for j, x in enumerate(p.start())]
        assert p._small(params[1], params[2]) == (spread < 1)
        got, squares = [x.copy() for x in params], [np.zeros(x.shape) for x in params]
        p.train_on(got, squares, flat, at)
        want, sums = [x.copy() for x in params], [np.zeros(x.shape) for x in params]
        for s in range(0, len(at), 500):
            grads, some = [np.zeros(x.shape) for x in want], at[s : s + 500]
            for i in some:
                y = int(p.TARGET[flat[i]])
                h = np.append(np.tanh(sum(want[0][k][flat[i + o]] for k, o in enumerate(p.OFFSETS))), 1)
                back = np.zeros(p.DIM + 1)
                for w, g, right in ((want[1], grads[1], y // p.WIDTH), (want[2][y // p.WIDTH], grads[2][y // p.WIDTH], y % p.WIDTH)):
                    x = w @ h
                    e = np.exp(x - x.max())
                    e /= e.sum()
                    e[right] -= 1
                    g += np.outer(e, h) / len(some)
                    back += w.T @ e / len(some)
                for k, o in enumerate(p.OFFSETS):
                    grads[0][k][flat[i + o]] += back[: p.DIM] * (1 - h[: p.DIM] ** 2)
            for w, q, g in zip(want, sums, grads, strict=True):
                q += g * g
                w -= p.RATE * g / (np.sqrt(q) + 1e-6)
        assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(got, want, strict=True)) and all(np.allclose(a, b) for a, b in zip(squares, sums, strict=True))


def test_pseudo_likelihood_shapes_by_characters():
    p, r = pseudo_likelihood, random.Random(1)
    for w in ["", "_", "a_", "don't", "́", "x²", *("".join(r.choice("abé漢_-.,'1٣²½ªⅣ́‍#😀") for _ in range(r.randint(0, 6))) for _ in range(3000))]:
        assert p.shape(w) == p.TOP + sum(bool(k.search(w)) << i for i, k in enumerate(p._KINDS)) * 4 + min(3, len(w) // 5)
