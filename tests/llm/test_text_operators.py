"""The text operators against plain versions, odd inputs included."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import line_dedup, quality_rules, sharding, simhash_dedup, source_mixing, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def null_first(x):
    return (x is not None, x or 0)


def plain_line_dedup(rows, t=line_dedup.MIN_LINES, long=line_dedup.MIN_WORDS):
    docs = sorted({(i, x) for i, x in rows if x}, key=lambda r: null_first(r[0]))
    at = defaultdict(list)
    for i, x in docs:
        ls = x.split("\n")
        for p in range(max(len(ls) - t, 0) + 1):
            at[tuple(ls[p : p + t])].append(((i, x), p))
        for p, line in enumerate(ls):
            if len(WORD.findall(line)) >= long:
                at[line].append(((i, x), p))
    gone = defaultdict(set)
    for w, found in at.items():
        for d, p in found[1:]:
            gone[d] |= set(range(p, p + (1 if isinstance(w, str) else len(w))))
    return {d: (len(d[1].split("\n")), len(gone[d]), "\n".join(s for k, s in enumerate(d[1].split("\n")) if k not in gone[d])) for d in docs}


def test_line_dedup(as_docs, odd_texts):
    rows = [r for r in odd_texts if r != (None, "Les.")]  # hash order decides between ties of null ids only
    long = [" ".join(f"{c}{i}" for i in range(n)) for c, n in (("w", 20), ("v", 25), ("s", 19))]
    r = random.Random(12)
    rows += [(200 + i, "\n".join(r.choice([*long, "a", "b", "c", ""]) for _ in range(r.randint(1, 12)))) for i in range(60)]
    want = plain_line_dedup(rows)
    got = line_dedup.op1(as_docs(rows)).collect()
    expected = Counter((i, *want.get((i, x), (0, 0, ""))[:2], hashlib.md5(want.get((i, x), (0, 0, ""))[2].encode()).hexdigest()) for i, x in rows)
    assert Counter(tuple(r) for r in got) == expected


def test_line_dedup_stage_deletes_long_lines(as_docs):
    """A repeated line of 20 words goes in any surroundings, a pair too; a shorter one stays without a run."""
    long, other, short = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("w", 20), ("v", 25), ("s", 19)))
    docs = as_docs([(1, f"a\n{long}\nb"), (2, f"c\n{long}\n{other}\nd"), (3, long), (4, f"{short}\ne"), (5, f"f\n{other}\n{short}\n{long}"), (6, f"g\n{long}\n{long}"), (7, f"c\n{long}\n{other}\nd")])
    got = {r.doc_id: r.text for r in line_dedup.stage(None, docs, "").collect()}
    assert got == {1: f"a\n{long}\nb", 2: f"c\n{other}\nd", 4: f"{short}\ne", 5: f"f\n{short}", 6: "g"}


def test_line_dedup_takes_few_rows_and_extends(as_docs):
    """Of a run that is repeated with its surroundings only the first is taken apart into windows; the others are matched at their
    fingerprints, which are fewer than their windows, and extended: the runs are longer than what selected them."""
    run = "\n".join(f"line {i}" for i in range(40))
    docs = as_docs([(i, f"head {i}\n{run}\ntail {i}") for i in range(30)])
    runs = line_dedup.repeated_runs(docs).collect()
    assert max(r.len for r in runs) == 2 * line_dedup.MIN_LINES - 1
    covered = defaultdict(set)
    for r in runs:
        covered[r._id] |= set(range(r.pos, r.pos + r.len))
    assert covered == {i: set(range(1, 41)) for i in range(1, 30)}
    assert len(runs) < 29 * 30  # windows: 29 x 38; selected lines: about half
    whole = [r for r in runs if r.len > line_dedup.MIN_LINES]
    alone = {r._id: len({k for x in runs if x._id == r._id and x.len <= line_dedup.MIN_LINES for k in range(x.pos, x.pos + x.len)}) for r in runs}
    assert whole and max(alone.values()) < 40  # windows alone would leave lines of the run


def test_line_dedup_carries_columns(as_docs, odd_texts):
    docs = as_docs(odd_texts)
    out = line_dedup.stage(None, docs, "")
    assert out.columns == docs.columns
    kept = out.collect()
    assert all((r._t, r.fp, r.a, r.h) == tuple("tfak") or (r._t, r.fp, r.a) == tuple("tfa") for r in kept)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in kept)
    assert {4, 1, 2, 40} <= {r.doc_id for r in kept} or (None in {r.doc_id for r in kept})
    assert line_dedup.op1(as_docs([])).count() == 0


def plain_counts(x):
    x = x or ""
    w, ls = WORD.findall(x), [s for s in x.split("\n") if WORD.search(s)]
    g = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(g)
    hit = {i + k for i, y in enumerate(g) if n[y] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in x), len(ls) - len(set(ls)), len(hit)


def test_quality_rules(as_docs, odd_texts):
    got = quality_rules.op3(as_docs(odd_texts)).collect()
    want = Counter()
    for i, x in odd_texts:
        n, chars, sym, dup, rep = plain_counts(x)
        lines, upper = len([s for s in (x or "").split("\n") if WORD.search(s)]), sum(c.isupper() for c in x or "")
        base = n < 10 or 100 * rep > 20 * n
        want[(i, n, chars, sym, dup, rep, base, not (base or 10 * sym > n or chars < 3 * n or chars > 10 * n or 10 * dup > 3 * lines or 10 * upper > 3 * chars))] += 1
    assert Counter(tuple(r) for r in got) == want
    assert quality_rules.op3(as_docs([])).count() == 0


def test_order_of_rules():
    """Rejections per cost, each given the rules before."""
    found = [((True, True, False), 50), ((False, True, False), 1), ((False, False, True), 10), ((False, False, False), 39)]
    got = quality_rules.order_rules(found, {"a": 1.0, "b": 1.1, "c": 1.0})
    assert [x[0] for x in got] == ["a", "c", "b"] and [x[2] for x in got] == [0.5, 0.2, 1 / 40]
    r = random.Random(3)
    for _ in range(50):
        names = "abcd"
        found = [(tuple(r.random() < 0.3 for _ in names), r.randint(1, 9)) for _ in range(8)]
        seconds = {k: r.choice([0.1, 1.0, 2.0]) for k in names}
        left, asked = found, []
        for name, cost, hit in quality_rules.order_rules(found, seconds):
            rate = {k: sum(n for v, n in left if v[names.index(k)]) / max(1, sum(n for _, n in left)) for k in names if k not in asked}
            assert hit == rate[name] and hit / cost == max(rate[k] / seconds[k] for k in rate)
            asked.append(name)
            left = [(v, n) for v, n in left if not v[names.index(name)]]
        assert sorted(asked) == list(names)


def test_cascade_keeps_the_verdict(as_docs, odd_texts):
    docs = as_docs(odd_texts)
    order = quality_rules.cascade(docs)
    assert {k for k, *_ in order} == set(quality_rules.RULES) and all(s > 0 for _, s, _ in order)
    kept = quality_rules.apply_rules(docs)
    assert kept.count() == quality_rules.op3(docs).where("kept").count() and kept.columns == docs.columns


def test_order_is_the_same_each_time(spark):
    """Ten calls agree; a count is charged to the first rule that needs it, or to none if it is taken anyway."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    orders = [quality_rules.cascade(docs, sample=100) for _ in range(10)]
    assert len({tuple(o) for o in orders}) == 1
    n = docs.sample(min(1.0, 100 / docs.count()), 11).select(F.avg(F.length(F.coalesce("text", F.lit("")))), F.avg(quality_rules.n_words(F.col("text")))).first()
    seen = set()
    for name, cost, _ in orders[0]:
        new = set(quality_rules.NEEDS[name]) - seen
        assert abs(cost - 1 - sum(quality_rules.WORK[c][0] * n[0] + quality_rules.WORK[c][1] * n[1] for c in new)) < 1e-6 * cost
        seen |= new
    paid = dict((name, cost) for name, cost, _ in quality_rules.cascade(docs, paid=tuple(quality_rules.WORK)))
    assert set(paid.values()) == {1}


def test_later_rules_are_not_evaluated(spark, as_docs):
    """A rule that fails where it is asked does no harm behind one that rejects all."""
    rules = {"all": lambda t: F.length(F.coalesce(t, F.lit(""))) >= 0, "error": lambda t: F.raise_error(F.concat(F.lit("asked "), t)).cast("boolean")}
    verdict = quality_rules.first_rejection(F.col("text"), [("all", 1.0, 1.0), ("error", 1.0, 0.0)], rules)
    assert {r.v for r in as_docs([(1, "a"), (2, None)]).select(verdict.alias("v")).collect()} == {"all"}


def test_rules_of_a_very_long_text(as_docs):
    text = "\n".join(" ".join(f"w{i * j % 5000}" for j in range(50)) for i in range(4000))
    got = quality_rules.op3(as_docs([(1, text)])).first()
    assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == plain_counts(text)


def test_best_fit_decreasing():
    r = random.Random(1)
    for fixed in (None, 7):
        sizes = [r.randint(1, 60) for _ in range(400)]
        capacity = 100 if fixed is None else -(-sum(sizes) // fixed)
        got = sharding.best_fit_decreasing(sizes, capacity, fixed)
        room = [capacity] * (fixed or 0)
        want = [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fits = [(c, k) for k, c in enumerate(room) if c >= sizes[i]]
            if fits:
                k = min(fits)[1]
            elif fixed:
                k = max((c, k) for k, c in enumerate(room))[1]
            else:
                room.append(capacity)
                k = len(room) - 1
            room[k] -= sizes[i]
            want[i] = k
        assert got == want
        if fixed is None:
            assert max(got) + 1 <= 1.3 * sum(sizes) / capacity + 1


def plain_packing(rows, n_shards, capacity, grain, lane, stretch):
    """The shard of each text, by lists and plain searches; lanes by the hash that Spark has."""
    import xxhash

    def pack(items, capacity, fixed=None):
        room, out = [capacity] * (fixed or 0), {}
        for key, size in sorted(items.items(), key=lambda x: (-x[1], x[0])):
            fits = [(c, k) for k, c in enumerate(room) if c >= size]
            if fits:
                k = min(fits)[1]
            elif fixed:
                k = max((c, k) for k, c in enumerate(room))[1]
            else:
                room.append(max(capacity, size))
                k = len(room) - 1
            room[k] -= size
            out[key] = k
        return out

    def lanes_of(items, n, capacity):
        split = defaultdict(dict)
        for k, v in items.items():
            h = xxhash.xxh64_intdigest(k.encode(), 42)
            split[(h - 2**64 if h >= 2**63 else h) % n][k] = v
        return {i: pack(x, capacity) for i, x in sorted(split.items())}

    size, key = Counter(), {}
    for _, x in rows:
        raw = (x or "").encode()
        key[x or ""] = hashlib.sha256(raw).hexdigest()
        size[key[x or ""]] += len(raw) + 1
    total = sum(size.values())
    capacity = capacity or -(-total // n_shards)
    small = {k: v for k, v in size.items() if v * grain < capacity}
    n = max(1, -(-len(small) // lane))
    item = {k: k for k in size} | {k: f"{i}.{b}" for i, x in lanes_of(small, min(n, grain * n_shards) if n_shards else n, max(1, capacity // grain)).items() for k, b in x.items()}
    items = Counter()
    for k, v in size.items():
        items[item[k]] += v
    if n_shards:
        shards = pack(items, capacity, n_shards)
    else:
        shards, first = {}, 0
        for x in lanes_of(items, max(1, total // (stretch * capacity)), capacity).values():
            shards |= {k: first + b for k, b in x.items()}
            first += max(x.values()) + 1
    return {x: shards[item[k]] for x, k in key.items()}


@pytest.mark.parametrize(("n_shards", "capacity", "grain", "lane", "stretch"), [(4, None, 1024, 50000, 64), (4, None, 4, 3, 64), (None, 9000, 4, 3, 2), (None, 200000, 64, 5, 64)])
def test_sharding(as_docs, odd_texts, n_shards, capacity, grain, lane, stretch):
    docs = as_docs(odd_texts)
    got = sharding.shard(docs, n_shards, capacity, grain=grain, lane=lane, stretch=stretch).collect()
    assert {(r._t, r.fp, r.a, r.score, r.n) for r in got} == {tuple("tfash")}
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((x or "").encode()) + 1, zlib.crc32((x or "").encode())) for i, x in odd_texts)
    slots, where = defaultdict(list), plain_packing(odd_texts, n_shards, capacity, grain, lane, stretch)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert Counter((r.doc_id, r.shard) for r in got) == Counter((i, where[x or ""]) for i, x in odd_texts)


def test_sharding_of_nothing(as_docs):
    assert sharding.op2(as_docs([])).count() == 0 and sharding.shard(as_docs([]), capacity=10).count() == 0


def test_write_shards(spark, as_docs, odd_texts, tmp_path):
    """Each row once, null ids too; shards keep to the capacity but for one larger group."""
    sharding.write_shards(as_docs(odd_texts), str(tmp_path / "out"), 9000)
    back = spark.read.parquet(str(tmp_path / "out")).select("_doc.*", F.col("shard").alias("at")).collect()
    assert Counter((r.doc_id, r.text, r.shard) for r in back) == Counter((i, x, "t") for i, x in odd_texts)
    held = defaultdict(set)
    for r in back:
        held[r.at].add(r.text or "")
    sizes = Counter(x or "" for _, x in odd_texts)
    assert all(len(v) == 1 or sum((len(x.encode()) + 1) * sizes[x] for x in v) <= 9000 for v in held.values())


def test_sharding_near_equal(spark, as_docs):
    r = random.Random(5)
    rows = [(i, "".join(r.choice("abc ") for _ in range(r.randint(0, 400)))) for i in range(3000)]
    got = sharding.op2(as_docs(rows)).groupBy("shard").sum("size").collect()
    assert len(got) == 16 and max(x[1] for x in got) - min(x[1] for x in got) <= 2


def plain_fingerprint(x):
    import xxhash

    low = re.sub("[A-Z]", lambda m: m[0].lower(), x or "")
    w = WORD.findall(low)
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(y.encode(), 42) for y in s]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def plain_components(n, linked):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in linked:
        up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(n)]


def near_copies(rows):
    r = random.Random(8)
    words = [" ".join(r.choice(["alpha", "Beta", "gamma", "delta", "eps"]) + str(r.randint(0, 99)) for _ in range(300)) for _ in range(3)]
    out = list(rows)
    for k, base in enumerate(words):
        for j in range(12):
            w = base.split()
            for _ in range(j % 4):
                w[r.randrange(len(w))] = "new"
            out.append((1000 + 100 * k + j, " ".join(w)))
    return out


@pytest.mark.parametrize("tile", [4096, 3])
def test_simhash(spark, as_docs, odd_texts, tile, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "links", lambda p, r=3, f=simhash_dedup.links: f(p, r, tile))
    rows = near_copies(odd_texts)
    fp = [plain_fingerprint(x) for _, x in rows]
    root = plain_components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3])
    low = {}
    for (i, _), c in zip(rows, root, strict=True):
        low[c] = min((x for x in (low.get(c), i) if x is not None), default=None)
    got = simhash_dedup.op8(as_docs(rows)).collect()
    assert Counter(tuple(r) for r in got) == Counter((i, f"{f:016x}", low[c]) for (i, _), f, c in zip(rows, fp, root, strict=True))
    kept = simhash_dedup.near_dedup(as_docs(rows))
    assert kept.count() == len(set(root)) and kept.columns == as_docs(rows).columns
    assert {(r._t, r.fp, r.a, r.score, r.n) for r in kept.collect()} == {tuple("tfash")}
    assert simhash_dedup.op8(as_docs([])).count() == 0


def test_links_of_dense_fingerprints(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(40)]
    prints = sorted({b ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 3))) for b in base for _ in range(30)} | set(base))
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    root = plain_components(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    for tile in (4096, 2):
        found = [(e.a, e.b) for e in simhash_dedup.links(spark.createDataFrame([(s,) for s in signed], "fp long"), 3, tile).collect()]
        at = {s: i for i, s in enumerate(signed)}
        assert plain_components(len(prints), [(at[a], at[b]) for a, b in found]) == root


def plain_suffix(rows, n=200):
    raw = [(x or "").encode() for _, x in rows]
    seen = Counter(t[i : i + n] for t in raw for i in range(len(t) - n + 1))
    out = Counter()
    for (i, _), t in zip(rows, raw, strict=True):
        cut = np.zeros(len(t) + 2, bool)
        for k in range(len(t) - n + 1):
            if seen[t[k : k + n]] > 1:
                cut[k + 1 : k + 1 + n] = True
        rest = bytes(b for b, c in zip(t, cut[1:], strict=False) if not c)
        out[(i, len(t), int(cut.sum()), int((np.diff(cut.astype(int)) == 1).sum()), hashlib.sha256(rest).hexdigest())] += 1
    return out


@pytest.mark.parametrize("cap", [suffix_dedup.CAP, 1])
def test_suffix_dedup(as_docs, odd_texts, cap):
    """Also with groups cut down to single windows; a common string in many surroundings within one text."""
    r = random.Random(21)
    noise = lambda n: "".join(r.choice("abcdefghij") for _ in range(n))
    common, half = noise(150), noise(120)
    rows = [*odd_texts, (80, "".join(noise(60) + common for _ in range(40))), (81, noise(300) + half + common + half + noise(90)), (82, half + common + half), (83, common + half + noise(20) + half + common)]
    got = suffix_dedup.op9(as_docs(rows), cap=cap).collect()
    assert Counter(tuple(r) for r in got) == plain_suffix(rows)


def test_suffix_dedup_blocks_and_batches(as_docs, odd_texts, monkeypatch):
    r = random.Random(4)
    text = "".join(r.choice("ab\n") for _ in range(3000))
    rows = [*odd_texts, (70, text[:900] + "x" + text[500:1500]), (71, text), (72, "ab" * 400), (73, "q" + "ab" * 300)]
    for name, value in (("BLOCK", 333), ("BATCH", 5)):
        monkeypatch.setattr(suffix_dedup, name, value)
    raw = [((x or "").encode()) for _, x in rows if x and len(x.encode()) >= 200]
    for t in raw:  # every window has one selected string, inside it
        s = suffix_dedup.selected(t)
        assert [w for _, _, f, n in s.tolist() for w in range(f, f + n)] == list(range(len(t) - 199))
        assert all(f + n - 1 <= p <= f + 168 for _, p, f, n in s.tolist())
    assert Counter(tuple(x) for x in suffix_dedup.op9(as_docs(rows)).collect()) == plain_suffix(rows)
    assert suffix_dedup.op9(as_docs([])).count() == 0
    assert not [t for t in as_docs(rows).sparkSession.catalog.listTables() if t.name.startswith("texts_")]
    out = suffix_dedup.remove_repeats(as_docs(rows))
    assert all(hashlib.sha256(bytes(x.rest)).hexdigest() == x.kept_sha256 for x in out.collect())


def plain_fill(budget, caps, weights):
    got, left = dict.fromkeys(caps, 0.0), budget
    open_ = {k for k in caps if weights[k] > 0}
    while left > 1e-9 and open_:
        total = sum(weights[k] for k in open_)
        full = {k for k in open_ if got[k] + left * weights[k] / total >= caps[k]}
        if not full:
            for k in open_:
                got[k] += left * weights[k] / total
            break
        for k in full:
            left -= caps[k] - got[k]
            got[k] = caps[k]
        open_ -= full
    return got


def test_share_out(spark):
    r = random.Random(9)
    rows, want = [], {}
    for g in range(12):
        caps = {f"c{i}": float(r.randint(0, 50)) for i in range(r.randint(1, 6))}
        weights = {k: float(r.choice([0, 1, 2, 5])) for k in caps}
        budget = float(r.randint(0, 120))
        rows += [(g, k, caps[k], weights[k], budget) for k in caps]
        want |= {(g, k): v for k, v in plain_fill(budget, caps, weights).items()}
    got = source_mixing.share_out(spark.createDataFrame(rows, "p int, name string, cap double, weight double, budget double"), ["p"], "name")
    assert {(x.p, x.name): pytest.approx(x.alloc) for x in got.collect()} == want


def plain_budgets(leaves, weights, ratio, epochs=2):
    """Fills leaves (d, l, s) -> tokens level by level; a node's room is that of its children of positive weight."""
    w = lambda level, name: weights[level].get(name, 1.0)

    def room(prefix):
        if len(prefix) == 3:
            return float(leaves[prefix] * epochs)
        return sum(room(c) for c in children(prefix) if w(len(prefix), c[-1]) > 0)

    def children(prefix):
        return sorted({k[: len(prefix) + 1] for k in leaves if k[: len(prefix)] == prefix})

    out = {}

    def give(prefix, budget):
        if len(prefix) == 3:
            out[prefix] = budget
            return
        cs = children(prefix)
        for c, b in plain_fill(budget, {c: room(c) for c in cs}, {c: w(len(prefix), c[-1]) for c in cs}).items():
            give(c, b)

    give((), float(int(sum(leaves.values()) * ratio)))
    return out


def test_budgets_of_three_levels(spark):
    r = random.Random(5)
    probes = [({("A", "en", "s"): 100, ("A", "de", "s"): 10, ("B", "fr", "s"): 1000}, ({}, {"en": 0.0}, {}), 0.2)]
    for _ in range(6):
        leaves = {(d, la, s): r.choice([0, 5, 40, 40, 300]) for d in "AB" for la in ("en", "de", "fr") for s in "xyz" if r.random() < 0.8}
        probes.append((leaves, tuple({n: float(r.choice([0, 1, 1, 3])) for n in names} for names in ("AB", ("en", "de", "fr"), "xyz")), r.choice([0.3, 1.0, 1.9, 5.0])))
    for leaves, weights, ratio in probes:
        df = spark.createDataFrame([(*k, v) for k, v in leaves.items()], "d string, l string, s string, tokens long")
        got = {(x.d, x.l, x.s): x.budget for x in source_mixing.leaf_budgets(df, *weights, budget_ratio=ratio).collect()}
        assert got == {k: int(v + 1e-6) for k, v in plain_budgets(leaves, weights, ratio).items()}
    assert sum(source_mixing.leaf_budgets(spark.createDataFrame([(*k, v) for k, v in probes[0][0].items()], "d string, l string, s string, tokens long"), *probes[0][1], budget_ratio=0.2).toPandas().budget) == 222


def test_mixing(as_docs, monkeypatch):
    r = random.Random(6)
    rows = [(i, " ".join("w" * r.randint(1, 3) for _ in range(r.randint(0, 40))), r.choice(["en", "de", None]), r.choice(["src0", "src1", "src2", None, "odd"])) for i in range(400)]
    rows += [(None, "a b c", "en", "src0"), (3, rows[3][1], *rows[3][2:]), (401, None, "fr", "src4")]
    docs = as_docs(rows)
    out = source_mixing.mix(docs, epoch_col="epoch", domains={"even": 3.0}, languages={"en": 2.0}, budget_ratio=0.8)
    assert out.columns == [*docs.columns, "epoch"]
    got = out.collect()
    assert {(r._t, r.fp, r.a, r.score, r.n) for r in got} == {tuple("tfash")}
    total = sum(len((x[1] or "").split()) for x in rows)
    taken = sum(len((x.text or "").split()) for x in got)
    leaves = len({(x[2], x[3]) for x in rows})
    assert 0.8 * total - leaves <= taken <= 0.8 * total + 45 * leaves
    best = Counter((x.doc_id, x.epoch) for x in got)
    assert max(x.epoch for x in got) <= 1 and all(n == 1 for (i, _), n in best.items() if i not in (3, None))
    assert source_mixing.op6(as_docs([])).count() == 0
    rows_of = lambda: Counter((x.doc_id, x.text, x.lang, x.source, x.epoch) for x in source_mixing.mix(docs, epoch_col="epoch", **source_mixing.TARGETS).collect())
    broadcast = rows_of()
    monkeypatch.setattr(source_mixing, "PLAN_ROWS", 0)
    assert rows_of() == broadcast
    narrow = source_mixing.mix(docs, epoch_col="epoch", few=1, **source_mixing.TARGETS).collect()
    assert Counter((x.doc_id, x.text, x.lang, x.source, x.epoch) for x in narrow) == broadcast
