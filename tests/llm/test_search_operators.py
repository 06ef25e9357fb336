"""Ranked search, phrase mining and pivot search against plain versions."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import phrase_mining, pivot_search, ranked_search

AZ = str.maketrans({c: chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain_ranks(docs, items, k=20):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(AZ))
    held = [(d, Counter(ws), len(ws)) for d, t in docs if (ws := words(t))]
    n, total, df = len(held), sum(x[2] for x in held), Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in {(i, t) for i, t in items if t is not None}:
        asked, scores = Counter(words(text)), []
        for d, c, size in held:
            m = 75 + 25 * size * n // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w, q in asked.items() if w in c)
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def items():
    return [(1, "Les. dup DUP"), (2, None), (3, ""), (4, "..."), (5, "a b x"), (6, "tail one ONE two"), (6, "x y"), (7, "漢 éß"), (7, "漢 éß"), (None, "zz x"), (8, "dup tail"), (9, "les " * 500)]


def test_ranked_search_equals_plain_ranks(spark, as_docs, odd_texts, items):
    docs = odd_texts + [(100 + i, "dup copy") for i in range(50)] + [(200, "q r s"), (201, "Q-R_S q"), (None, "dup copy")]
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, rank string")
    found = ranked_search.op11(as_docs(docs), table).collect()
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in found), key=repr) == plain_ranks([(d[0], d[1]) for d in docs], items)
    assert ranked_search.op11(as_docs([]), table).count() == ranked_search.op11(as_docs([(1, None)]), table).count() == ranked_search.op11(as_docs(docs), table.limit(0)).count() == 0
    assert ranked_search.op11(as_docs([]), table).dtypes == ranked_search.op11(as_docs(docs), table).dtypes


def test_blocks_of_items_change_nothing(spark, as_docs, odd_texts, items, monkeypatch):
    table = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(ranked_search, "VOCABULARY", 4)
    found = ranked_search.search(as_docs(odd_texts), table, 3).collect()
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in found), key=repr) == plain_ranks([(d[0], d[1]) for d in odd_texts], items, 3)


@pytest.mark.parametrize("seed", range(12))
def test_impacts_stop_only_when_bounds_prove_the_best(seed, monkeypatch):
    r = np.random.default_rng(seed)
    n, width, k = int(r.integers(1, 400)), 12, 5
    rows = [np.sort(r.choice(width, r.integers(1, width), replace=False)) for _ in range(n)]
    tfs = [r.geometric(0.3, len(x)) for x in rows]
    lists = lambda xs, kind: pa.array([x.tolist() for x in xs], pa.list_(kind))
    ids = r.permutation(n)
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array([int(t.sum()) + int(r.integers(0, 40)) for t in tfs]), lists(rows, pa.int32()), lists(tfs, pa.int32())], ["id", "n", "terms", "tfs"])
    shard = ranked_search.Shard([batch.slice(0, n // 2), batch.slice(n // 2)], n, 30 * n, width)
    monkeypatch.setattr(ranked_search, "STEP", 16)
    numbers, weights = r.choice(width, 4, replace=False), np.array([5000, 900, 40, 1])
    by_term = np.zeros(width, np.int64)
    by_term[numbers] = weights
    whole = shard.complete(np.arange(n), by_term)
    want = sorted((-s, i) for s, i in zip(whole.tolist(), ids.tolist(), strict=True) if s > 0)[:k]
    looked = []
    complete = shard.complete
    shard.complete = lambda docs, w: looked.append(len(docs)) or complete(docs, w)
    for floor in {0, -want[-1][0] if len(want) == k else 0}:
        docs, scores = shard.best(numbers, weights, by_term, k, floor)
        assert sorted(zip((-scores).tolist(), ids[docs].tolist(), strict=True)) == want
    assert n < 200 or min(looked) < n // 2  # of long lists not all documents are completed
    assert len(shard.best(numbers, weights, by_term, k, int(whole.max()) + 1)[0]) == 0


def plain_counts(docs, most):
    total, f = Counter(), Counter()
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(AZ)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(ws)
            for m in range(1, most + 1):
                f.update((lang or "und", tuple(ws[i : i + m])) for i in range(len(ws) - m + 1))
    return total, f


def plain_phrases(docs, most=3, least=10, share=50, first=2000):
    total, f = plain_counts(docs, most)
    made = {k: a for k, a in f.items() if len(k[1]) >= 2 and a >= least}
    dropped = {(lang, p[i : i + m]) for (lang, p), a in made.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= share * f[lang, p[i : i + m]]}
    by_lang = defaultdict(list)
    for (lang, p), a in made.items():
        if (lang, p) not in dropped:
            score, k = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            by_lang[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, r, p.decode(), -a, left, right, total[lang], -s) for lang, rows in by_lang.items() for r, (s, a, p, left, right) in enumerate(sorted(rows)[:first], 1))


@pytest.fixture(scope="module")
def spoken():
    r = random.Random(5)
    words = ["La", "la", "le", "é", "x", "x", "x", "yy", "#tag", "漢字", "a-b", "'tis"]
    text = lambda: "".join(r.choice(words) + r.choice([" "] * 9 + ["  ", "\t", ". ", ",", "\n", "\r\n", "; ", " ! "]) for _ in range(r.randint(0, 60)))
    rows = [(text(), r.choice(["en", "en", "de", None, "und"])) for _ in range(150)] + [(None, "en"), ("", "fr"), (" \t.", "fr"), ("x " * 3000, "en"), ("one two three four. " * 25, "xx"), ("one two three four", "xx")]
    return rows + rows[:20]


def _said(spark, rows):
    return spark.createDataFrame([(i, t, lang, "k") for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, phrase string").repartition(3)


def test_phrases_equal_plain_phrases(spark, spoken):
    found = phrase_mining.op12(_said(spark, spoken))
    assert sorted(map(tuple, found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == plain_phrases(spoken)
    assert phrase_mining.op12(_said(spark, spoken).limit(0)).count() == 0
    more = phrase_mining.mine(_said(spark, spoken), 4, 6, 80, 12)
    assert sorted(map(tuple, more.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == plain_phrases(spoken, 4, 6, 80, 12)


@pytest.mark.parametrize("bits", [3, 12, 24])
def test_sketches_of_any_width_lose_no_phrase(spark, spoken, bits):
    parts = phrase_mining.materialise(phrase_mining.shards(_said(spark, spoken).select("lang", "text")))
    good = phrase_mining.sketched(parts, 3, bits, 10)
    found = phrase_mining.counted(parts, good, 3, bits).groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where("n >= 10").collect()
    _, f = plain_counts(spoken, 3)
    assert {(r.lang, tuple(r.phrase.split(" "))): r.n for r in found} == {k: n for k, n in f.items() if n >= 10}


def test_long_texts_are_divided_between_pieces(spark):
    one = "aa bb cc dd. " * 300_000  # 3.9 MB, four parts
    parts = phrase_mining.shards(_said(spark, [(one, "en")]).select("lang", "text")).collect()
    assert len(parts) > 3 and sum(p.words for p in parts) == 1_200_000 and max(len(phrase_mining.plain(p.text)) for p in parts) < phrase_mining.PART + 100
    rows = phrase_mining.op12(_said(spark, [(one, "en")])).collect()
    assert sorted((r.phrase, r.a, r.n) for r in rows) == [("aa bb cc", 300_000, 1_200_000), ("bb cc dd", 300_000, 1_200_000)]


def test_equal_hashes_lose_no_phrase(monkeypatch):
    text = phrase_mining.pieces(b"a b c a b. d e a b")
    texts, hashed = [b"\n".join(text)], phrase_mining._mixed
    monkeypatch.setattr(phrase_mining, "_mixed", lambda x: hashed(x) & np.uint64(3))
    good = np.arange(4, dtype=np.uint64)
    few, times = phrase_mining._candidates(texts, "en", good, 2, np.uint64(0))
    whole, _ = phrase_mining._candidates(texts, "en", good, 2, np.uint64(0), apart=False)
    n = phrase_mining._scanned(texts, whole)
    assert phrase_mining._scanned(texts, few).sum() < times.sum() == n.sum() == 16
    assert dict(zip(whole, n.tolist(), strict=True))[" a b "] == 3


def test_cells_survive_coding():
    x = np.unique(np.random.default_rng(1).integers(0, 1 << 22, 5000))
    assert (phrase_mining._decoded(phrase_mining._encoded(x)) == x).all() and len(phrase_mining._decoded(phrase_mining._encoded(x[:0]))) == 0


def plain_top(rows, k=10):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, x in {(i, tuple(v)) for i, v in good if i is not None and i % 100 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(x, v, strict=True)), i is None, i) for i, v in good if i != q and len(v) == len(x))
        out += [(q, r, i, -s) for r, (s, _, i) in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("spread", [0.01, 1.0, 300.0])
def test_pivot_search_equals_plain_products(spark, spread):
    r = np.random.default_rng(2)
    centres = r.normal(size=(6, 5)) * spread
    rows = [(i, [float(x) for x in np.float32(centres[i % 6] + r.normal(size=5) * spread / 9)]) for i in range(900)]
    rows += [(1000 + i, [0.5] * 5) for i in range(30)] + [(1100, [0.5] * 5)] * 2 + [(1200, [0.0] * 5), (1300, [1.0, 2.0]), (1301, [2.0, 1.0]), (1400, []), (1401, [])]
    rows += [(1500, None), (1600, [math.nan] * 5), (1601, [None] * 5), (1700, [math.inf] * 5), (None, [9.0] * 5), (None, [0.5] * 5), (1800, [-3.0] * 5), (1800, [3.0] * 5)]
    table = spark.createDataFrame([(i, v, 1, "s") for i, v in rows], "vec_id long, embedding array<float>, label int, score string").repartition(3)
    found = pivot_search.op13(table)
    assert sorted(((x.query_id, x["rank"], x.vec_id, x.score) for x in found.collect()), key=repr) == plain_top(rows)
    assert pivot_search.op13(table.limit(0)).count() == pivot_search.op13(table.where("vec_id = 1")).count() == pivot_search.op13(table.where("vec_id = 1300 or vec_id = 1400")).count() == 0


def test_blocks_of_queries_change_nothing(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.float32(r.normal(size=3))]) for i in range(0, 6000, 5)]
    monkeypatch.setattr(pivot_search, "QUERIES", 7)
    found = pivot_search.op13(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert sorted(((x.query_id, x["rank"], x.vec_id, x.score) for x in found.collect()), key=repr) == plain_top(rows)


def test_bounds_leave_most_products_out():
    r = np.random.default_rng(7)
    x = np.floor(1024 * (r.normal(size=(40, 8))[r.integers(0, 40, 4000)] + r.normal(size=(4000, 8)) / 50))
    sample = pa.table({"id": np.arange(500), "v": pa.array(x[:500].tolist())})
    at = pivot_search.pivots(sample)[8]
    block = pivot_search.Block([0, 1], x[:2], at.tolist(), x[at], 10)
    d = np.c_[np.sqrt((x**2).sum(1)), pivot_search._apart(x, x[at])]
    floor, best = block.floor.copy(), [[], []]
    assert pivot_search.scan(block, pa.array(np.arange(4000)), x, d, floor, best, 10) < 4000
    for q in (0, 1):
        assert best[q] == sorted(((int(x[i] @ x[q]), i) for i in range(4000) if i != q), key=lambda s: (-s[0], s[1]))[:10]


def test_large_products_are_exact():
    x = np.array([[2.0**30 + 1, 3.0], [2.0**30, 5.0]])
    assert pivot_search.products(x, x[0]).tolist() == [(2**30 + 1) ** 2 + 9, 2**30 * (2**30 + 1) + 15]


@pytest.mark.parametrize("buckets", [1, 7, 1000])
def test_phrases_are_sent_once_a_bucket(spark, spoken, buckets):
    """Sums of buckets are those of all shards, each phrase once, however many buckets there are."""
    parts = phrase_mining.materialise(phrase_mining.shards(_said(spark, spoken).select("lang", "text")))
    found = phrase_mining.counted(parts, phrase_mining.sketched(parts, 3, 12, 10), 3, 12, buckets, 10).collect()
    _, f = plain_counts(spoken, 3)
    assert sorted((r.lang, r.phrase, r.n) for r in found) == sorted((lang, " ".join(p), n) for (lang, p), n in f.items() if n >= 10)


def test_sorted_phrases_and_cells_are_small():
    """What a shard sends: phrases in under 6 bytes each, and cells of random gaps, with counts that are nearly all 1, in under 1.5."""
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(40)]
    phrases = sorted({f" {a} {b} {c} ".encode() for a in words for b in words for c in r.sample(words, 20)})
    bucket = phrase_mining._buckets(b"\n".join(phrases), "en", 8)
    sent = [phrase_mining._small(b"\n".join([phrases[i] for i in np.flatnonzero(bucket == k)])) for k in range(8)]
    assert sum(map(len, sent)) < 6 * len(phrases) and max(map(len, sent)) < 2 * min(map(len, sent))
    cells = np.cumsum(np.random.default_rng(1).geometric(1 / 200, 20000))
    assert len(phrase_mining._encoded(cells)) + len(phrase_mining._small(bytes(np.random.default_rng(2).geometric(0.95, 20000).astype(np.uint8)))) < 1.5 * 20000
