from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _t string, fp string, a string, score string, n string, shard string, tk string, size string, h string"


@pytest.fixture(scope="session")
def as_docs(spark):
    """Documents of (doc_id, text) or (doc_id, text, lang, source), with extra columns of clashing names."""

    def make(rows):
        full = [(r[0], r[1], *(r[2:] or ("en", "src1")), None if r[1] is None else len(r[1]), *"tfashtlbqk"[:9]) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3) if full else spark.createDataFrame([], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and blank texts, repeated rows, ties, copies and a very long text."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeéßñ漢") for _ in range(r.randint(1, 6)))
    line = lambda: " ".join(word() for _ in range(r.randint(3, 9)))
    passage = "\n".join(line() for _ in range(8))
    long = "\n".join(line() for _ in range(700))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "Les."), (5, "Les."), (None, "Les."), (None, None), (6, "a b"), (7, "x\ny"), (8, "x\ny")]
    rows += [(20 + i, line() + "\n" + passage + "\n" + line()) for i in range(6)]
    rows += [(40, long), (41, long), (42, long + "\n" + passage), (43, long[:3000] + " zz " + long[3000:]), (44, "dup dup " * 200), (45, "dup dup " * 150)]
    rows += [(50 + i, "\n".join(line() for _ in range(5))) for i in range(12)]
    rows += [rows[12], rows[12], (60, "ONE %%% TWO### $$$ " * 20), (61, "tail " + passage[:260] + passage[:260])]
    return rows
