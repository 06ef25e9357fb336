"""The pipeline and its stages, against plain versions of each."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from lorekeep.llm import line_dedup, piece_encoding, quality_classifier, source_mixing

from .test_text_operators import WORD, plain_budgets, plain_components, plain_fingerprint, plain_line_dedup

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean prose, junk, copies, near copies, repeated passages, nulls and an extra column of a clashing name, on disk."""
    r = random.Random(17)
    vocabulary = ["".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(2, 8))) for _ in range(400)]
    line = lambda n: " ".join(r.choice(vocabulary) for _ in range(n)) + "."
    prose = lambda: "\n".join(line(r.randint(6, 14)) for _ in range(r.randint(3, 7)))
    junk = lambda: " ".join(r.choice(["$$$", "###", "@@@@", "1111", "%%%%", "WIN"]) for _ in range(30))
    passage = line(60)
    rows = [(i, prose()) for i in range(60)] + [(100 + i, junk()) for i in range(30)]
    rows += [(200 + i, f"{line(8)}\n{passage}\n{line(9)}") for i in range(8)]
    rows += [(300 + i, rows[i][1]) for i in range(6)] + [(320 + i, rows[10 + i][1] + " end") for i in range(4)]
    rows += [rows[0], (None, prose()), (400, None), (401, ""), (402, " \n ")]
    full = [(i, x, r.choice(["en", "de", None]), r.choice(["src0", "src1", None]), None if x is None else len(x), "kept") for i, x in rows]
    labels = [(i, 1, 0) for i in range(40)] + [(100 + i, 0, 0) for i in range(25)] + [(None, 1, 0), (5, None, 1)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(full, COLUMNS + ", _score_of_quality string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, full


def counted(rows):
    return Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in rows)


def test_each_stage_and_run(spark, corpus):
    import sentencepiece as sp

    folder, full = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "mixing sources", "piece encoding"]
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, frames[-1], folder)
        frames.append(spark.createDataFrame(out.collect(), out.schema))
    scored, lines, near, mixed, last = (f.collect() for f in frames[1:])
    assert all(f.columns == docs.columns for f in frames[1:5])
    # 7: what the classifier scores 0.5 or more, and it tells prose from junk
    model = quality_classifier.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    good = quality_classifier.score_documents(docs, model, "s").where("s >= 0.5").collect()
    assert counted(scored) == counted(good)
    kept = {r.doc_id for r in scored}
    assert not kept & set(range(100, 130)) and set(range(60)) <= kept and set(range(200, 208)) <= kept
    # 1: plain line dedup; documents left without a line go
    want = plain_line_dedup([(r.doc_id, r.text) for r in scored])
    expected = Counter()
    for r in scored:
        n, gone, rest = want.get((r.doc_id, r.text), (0, 0, r.text))
        if gone == 0 or gone < n:
            expected[(r.doc_id, rest, r.lang, r.source, None if rest is None else len(rest))] += 1
    assert counted(lines) == expected
    # 8: one of each group, that of the smallest id
    prints = [plain_fingerprint(r.text) for r in lines]
    root = plain_components(len(lines), [(i, j) for i in range(len(lines)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    best = defaultdict(list)
    for r, c in zip(lines, root, strict=True):
        best[c].append((r.doc_id is None, r.doc_id or 0))
    assert sorted(min(v) for v in best.values()) == sorted((r.doc_id is None, r.doc_id or 0) for r in near)
    # 6: each leaf gives whole epochs and the shortest prefix of the next
    size = lambda r: len(WORD.findall(r.text or ""))
    leaf = lambda r: ("even" if r.source == "src0" else "odd", r.lang or "\0null", r.source or "\0null")
    tokens = Counter()
    for r in near:
        tokens[leaf(r)] += size(r)
    budgets = plain_budgets(dict(tokens), (source_mixing.DOMAINS, source_mixing.LANGUAGES, {}), 1.0)
    for k, n in tokens.items():
        got = [r for r in mixed if leaf(r) == k]
        given, longest = sum(map(size, got)), max(size(r) for r in near if leaf(r) == k)
        assert int(budgets[k] + 1e-6) <= given < int(budgets[k] + 1e-6) + longest + 1 if n else not given
    # 4: ids of the library, which decode to the text
    own = sp.SentencePieceProcessor(model_file=piece_encoding.default_model())
    assert Counter((r.doc_id, r.source, tuple(r.ids or ()), r.n_ids) for r in last) == Counter((r.doc_id, r.source, tuple(own.encode(r.text or "")), len(own.encode(r.text or ""))) for r in mixed)
    assert all(r.round_trip for r in last)
    whole = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.source, tuple(r.ids or ())) for r in whole) == Counter((r.doc_id, r.source, tuple(r.ids or ())) for r in last)


def test_stages_of_nothing(spark, corpus, tmp_path):
    folder, _ = corpus
    for t in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_line_stage_keeps_what_it_does_not_touch(spark, corpus):
    folder, full = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = line_dedup.stage(spark, docs, folder).where("doc_id is null or doc_id in (400, 401)").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in full if r[0] in (None, 400, 401))
