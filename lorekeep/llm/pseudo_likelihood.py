"""LM scoring: masked pseudo-likelihood from a bidirectional window network trained in numpy.

A token is a word, lower-cased. The `TOP` most frequent words of the whole corpus are outputs of the network;
others fall into `SHAPES` classes by length and kinds of characters. The network predicts each token from
the two tokens on either side of it (never from itself): the vectors of the four neighbours, one table
for each offset, are summed, pass a tanh layer, and a two-level softmax (block of the outputs, then
place in the block) gives the probability of the token or its class, which is divided among all words of
the class by their counts in the corpus, so that the probabilities of all its words sum to 1. As a neighbour,
a word of a class has one of the class's `ROWS` vectors, by its hash. Training runs where the documents lie: each partition
goes once over all its documents, from the same start, and the parameters are averaged in proportion to
tokens; this is done for `ROUNDS` disjoint parts of the corpus in turn, so each document trains once.
A document's score is the sum of its tokens' conditional log-probabilities.

Edge cases. A null, empty or blank text has no tokens: sum 0, mean null. Repeated rows train and score
like any others. Very long texts are cut into spans for arithmetic only; every token sees its neighbours.
An empty table gives an empty result. Columns other than the text are carried through.
"""

from __future__ import annotations

import re
import string
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

BLOCKS, WIDTH, DIM, SHAPES = 32, 32, 24, 32
PAD = BLOCKS * WIDTH
TOP = PAD - SHAPES
#: Vectors of a class; ids from PAD + 1 on are words of classes, TARGET gives the output of each id.
ROWS = 256
TARGET = np.concatenate([np.arange(PAD + 1), TOP + np.arange(SHAPES * ROWS) // ROWS])
OFFSETS = (-2, -1, 1, 2)
ROUNDS, RATE, BATCH, SPAN = 2, 0.15, 4096, 1 << 14
#: Tokens remembered by a worker.
REMEMBER = 1 << 19
#: Most words whose shares of their classes are sent to all tasks; those of rarer words are joined.
KNOWN = 1 << 18


def word_counts(docs: DataFrame) -> DataFrame:
    """All lower-cased words w of all documents (in UTF-8) and their numbers n."""

    def local(batches):
        counts: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                counts.update((t.as_py() or "").lower().encode().split())  # bytes: ASCII white space only
                if len(counts) > REMEMBER:
                    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()))], ["w", "n"])
                    counts.clear()
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()))], ["w", "n"])

    return docs.select("text").mapInArrow(local, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, n: int) -> list:
    """The first n rows of word_counts, ties by the word."""
    return counts.orderBy(F.desc("n"), "w").limit(n).collect()


def frequent(counts: DataFrame, n: int) -> list:
    """The TOP most frequent words and then the others of a count that at most n words in all reach; counts are taken in
    eighths of a doubling, so that the bound is found among few sums."""
    step = F.floor(F.log2("n") * 8)
    top, at, total = most_frequent(counts, TOP), None, 0
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("k")).collect(), key=lambda r: -r["step"]):
        total += r["k"]
        if total > n:
            break
        at = r["step"]
    mine = {bytes(r["w"]) for r in top}
    more = [] if at is None else counts.where(step >= at).collect()  # at most n
    return top + sorted((r for r in more if bytes(r["w"]) not in mine), key=lambda r: (-r["n"], bytes(r["w"])))


def _ids(rows) -> dict[str, int]:
    return {bytes(r["w"]).decode(): i for i, r in enumerate(rows)}


def vocabulary(docs: DataFrame) -> dict[str, int]:
    """Ids of the TOP most frequent lower-cased words of all documents, ties by the word."""
    return _ids(most_frequent(word_counts(docs), TOP))


_KINDS = (re.compile(r"[^\W\d_]"), re.compile(r"\d"), re.compile(r"[^\w\s]"))
_MARKS = string.punctuation.replace("_", "")


def shape(word: str) -> int:
    """The class of a word outside the vocabulary: kinds of characters (8) and length (4)."""
    plain = word.isalpha() or word.strip(_MARKS).isalpha()  # letters, and marks before or after them
    kinds = 1 + 4 * (not word.isalpha()) if plain else sum(bool(k.search(word)) << i for i, k in enumerate(_KINDS))
    return TOP + kinds * 4 + min(3, len(word) // 5)


class Tokens(dict):
    """Ids by the UTF-8 bytes of a word; those of words of classes are remembered as they come."""

    def __init__(self, known: dict[str, int]):
        super().__init__({w.encode(): i for w, i in known.items()})

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBER:
            for w in [w for w, i in self.items() if i >= TOP]:
                del self[w]
        self[word] = i = PAD + 1 + (shape(word.decode()) - TOP) * ROWS + zlib.crc32(word) % ROWS
        return i


def split(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()  # bytes: ASCII white space only


def inputs(words: list[bytes], ids: Tokens) -> np.ndarray:
    return np.fromiter(map(ids.__getitem__, words), np.int16, len(words))


def tokens(text: str | None, ids: Tokens) -> np.ndarray:
    """The outputs of the network that the words of the text stand for."""
    return TARGET[inputs(split(text), ids)].astype(np.int16)


def start(seed: int = 5) -> list[np.ndarray]:
    """Tables of the offsets, block weights, place weights (each with its bias as last column)."""
    r = np.random.default_rng(seed)
    e = r.normal(0, 0.3, (len(OFFSETS), PAD + 1, DIM))
    e = np.concatenate([e, np.repeat(e[:, TOP:PAD], ROWS, axis=1)], axis=1)
    return [x.astype(np.float32) for x in (e, np.zeros((BLOCKS, DIM + 1)), np.zeros((BLOCKS, WIDTH, DIM + 1)))]


def stream(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All tokens, two pads about each text, and the places of the tokens."""
    pad = np.full(2, PAD, np.int16)
    flat = np.concatenate([pad, *(x for t in texts for x in (t, pad))])
    return flat, np.flatnonzero(flat != PAD)


#: Logits up to this size, by a bound of them all, need no shift before they are exponents.
PLAIN = 60.0
_ONES = np.ones(WIDTH, np.float32)


def _small(*weights) -> bool:
    """Whether no logit can pass PLAIN: the inputs of the weights, of which the last is 1, lie between -1 and 1."""
    return all(np.abs(w).sum(-1).max() < PLAIN for w in weights)


def hidden(params, flat, at) -> np.ndarray:
    e = params[0]
    h = e[0].take(flat[at + OFFSETS[0]], axis=0)
    for k in range(1, len(OFFSETS)):
        h += e[k].take(flat[at + OFFSETS[k]], axis=0)
    out = np.ones((len(at), DIM + 1), h.dtype)
    np.tanh(h, out=out[:, :DIM])
    return out


def _by_block(flat, at) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """The order of places by the blocks of their outputs; blocks and places in the block in that order, and the blocks' slices (those of some places)."""
    y = TARGET[flat[at]]
    order = np.argsort((y // WIDTH).astype(np.uint8), kind="stable")
    block, place = np.divmod(y[order], WIDTH)
    ends = np.searchsorted(block, np.arange(BLOCKS + 1)).tolist()
    return order, block, place, [(b, slice(i, j)) for b, (i, j) in enumerate(zip(ends, ends[1:], strict=False)) if i < j]


def _logits(params, h, slices, small: bool) -> np.ndarray:
    """In rows: logits of the blocks for each row of h, then those of the places in its block; unless they are small, rows are shifted to a maximum of 0."""
    n = len(h)
    x = np.empty((2 * n, WIDTH), h.dtype)
    np.matmul(h, params[1].T, out=x[:n])
    for b, i in slices:
        np.matmul(h[i], params[2][b].T, out=x[n + i.start : n + i.stop])
    if not small:
        x -= x.max(1, keepdims=True)
    return x


def log_probabilities(params, flat, at) -> np.ndarray:
    """Conditional log-probability of the token at each place."""
    out, small = np.empty(len(at)), _small(params[1], params[2])
    for s in range(0, len(at), SPAN):
        p = at[s : s + SPAN]
        order, block, place, slices = _by_block(flat, p)
        x = _logits(params, hidden(params, flat, p[order]), slices, small)
        n = len(p)
        lp = x[np.arange(2 * n), np.concatenate([block, place])]
        lp -= np.log(np.exp(x, out=x) @ _ONES)
        out[s : s + SPAN][order] = lp[:n] + lp[n:]
    return out


def _summed(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of runs of rows, by the first row of each; those of one or two rows, which are most, all at once."""
    n = np.diff(first, append=len(x))
    out = x.take(first, axis=0)
    two, more = np.flatnonzero(n == 2), np.flatnonzero(n > 2)
    if len(two):
        out[two] += x.take(first.take(two) + 1, axis=0)
    if len(more):
        out[more] = np.add.reduceat(x[np.repeat(n > 2, n)], np.cumsum(n.take(more)) - n.take(more))
    return out


def train_on(params, squares, flat, at) -> None:
    """One pass of Adagrad over the places, in batches, in place."""
    for s in range(0, len(at), BATCH):
        order, block, place, slices = _by_block(flat, at[s : s + BATCH])
        p = at[s : s + BATCH][order]
        n = len(p)
        h = hidden(params, flat, p)
        x = _logits(params, h, slices, _small(params[1], params[2]))
        np.exp(x, out=x)
        x *= (1 / (x @ _ONES))[:, None]
        x[np.arange(2 * n), np.concatenate([block, place])] -= 1
        g, mine = x[:n], x[n:]
        grads = [None, g.T @ h / n, np.zeros_like(params[2])]
        gh = g @ params[1]
        for b, i in slices:
            np.matmul(mine[i].T, h[i], out=grads[2][b])
            gh[i] += mine[i] @ params[2][b]
        grads[2] /= n
        gh = gh[:, :DIM] * ((1 - h[:, :DIM] ** 2) / n)
        for k, o in enumerate(OFFSETS):
            t = flat[p + o]
            by = np.argsort(t, kind="stable")
            t = t.take(by)
            first = np.concatenate([[0], np.flatnonzero(t[1:] != t[:-1]) + 1])
            ids, ge = t.take(first), _summed(gh.take(by, axis=0), first)
            q = squares[0][k].take(ids, axis=0)
            q += ge * ge
            squares[0][k][ids] = q
            np.sqrt(q, out=q)
            q += 1e-6
            np.divide(ge, q, out=q)
            q *= RATE
            params[0][k][ids] = params[0][k].take(ids, axis=0) - q
        for j in (1, 2):
            squares[j] += grads[j] * grads[j]
            params[j] -= RATE * grads[j] / (np.sqrt(squares[j]) + 1e-6)


def _pack(params) -> np.ndarray:
    return np.concatenate([x.ravel() for x in params])


def _unpack(flat: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for x in start():
        out.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
        at += x.size
    return out


#: Parameters of a row, and steps in which partitions are summed first: a group is a part of them.
PIECE, STEP = 4096, 256


def tokenise(docs: DataFrame, known: dict[str, int], ids_col: str = "token_ids") -> DataFrame:
    """docs with the token ids of the text in binary column ids_col (16 bits each)."""
    given = docs.sparkSession.sparkContext.broadcast(known)

    @F.pandas_udf("binary")
    def ids(texts):
        words_ = remembered(given.value)
        return texts.map(lambda t: inputs(split(t), words_).tobytes(), na_action=None)

    return docs.withColumn(ids_col, ids("text"))


def class_totals(counts: DataFrame, rows) -> np.ndarray:
    """Numbers of tokens of each class: of all words but those of rows, which the network predicts itself."""
    totals = np.zeros(SHAPES, np.int64)
    for r in counts.groupBy("c").agg(F.sum("n").alias("n")).collect():
        totals[r["c"] - TOP] += r["n"]
    for r in rows:
        totals[r["c"] - TOP] -= r["n"]
    return totals


def with_classes(counts: DataFrame) -> DataFrame:
    """Word counts with the class c of each word."""

    @F.pandas_udf("int")
    def shapes(words):
        return words.map(lambda w: shape(bytes(w).decode()))

    return counts.withColumn("c", shapes("w"))


class Codes(dict):
    """Codes of words by their UTF-8 bytes: the place among given words, or behind them the row of a word of a class."""

    def __init__(self, given: list[bytes]):
        super().__init__(zip(given, range(len(given)), strict=True))
        self.given = len(given)

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.given + REMEMBER:
            for w in [w for w, i in self.items() if i >= self.given]:
                del self[w]
        self[word] = i = self.given + _row(word)
        return i


def _row(word: bytes) -> int:
    return (shape(word.decode()) - TOP) * ROWS + zlib.crc32(word) % ROWS


def packed_rows(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of the numbers of each row, which end before `ends` (0 first)."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer((ends * ids.itemsize).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids))]).cast(pa.binary())


def tokenise_all(docs: DataFrame, rows: list, totals: np.ndarray) -> DataFrame:
    """docs with token_ids as tokenise gives them for the first TOP of rows (see frequent), the sum of the words' logarithmic shares,
    and the words that are not among rows."""
    words_ = [bytes(r["w"]) for r in rows]
    n_top = min(TOP, len(rows))
    ids_of = np.concatenate([np.arange(n_top), PAD + 1 + np.array([_row(w) for w in words_[n_top:]], int), PAD + 1 + np.arange(SHAPES * ROWS)]).astype(np.int16)
    shares = np.concatenate([np.zeros(n_top), [np.log(r["n"] / totals[r["c"] - TOP]) for r in rows[n_top:]], np.zeros(SHAPES * ROWS)])
    given = docs.sparkSession.sparkContext.broadcast((words_, ids_of, shares))

    @F.arrow_udf("struct<ids binary, share double, rest array<binary>>")
    def ids(texts: pa.Array) -> pa.Array:
        words_, ids_of, shares = given.value
        codes, found, rest, size, n_rest = coded(words_), [np.zeros(0, np.int32)], [], [0], [0]
        for t in texts:
            w = split(t.as_py())
            x = np.fromiter(map(codes.__getitem__, w), np.int32, len(w))
            rest += [w[i] for i in np.flatnonzero(x >= len(words_))]
            found.append(x)
            size.append(len(w))
            n_rest.append(len(rest))
        x, ends = np.concatenate(found), np.cumsum(size)
        share = np.bincount(np.repeat(np.arange(len(texts)), size[1:]), shares[x], len(texts))
        columns = [packed_rows(ids_of[x], ends), pa.array(share), pa.ListArray.from_arrays(pa.array(n_rest, pa.int32()), pa.array(rest, pa.binary()))]
        return pa.StructArray.from_arrays(columns, ["ids", "share", "rest"])

    x = docs.withColumn("_x", ids("text"))
    return x.withColumns({"token_ids": F.col("_x.ids"), "_share": F.col("_x.share"), "_rest": F.col("_x.rest")}).drop("_x")


def rest_shares(ids: DataFrame, counts: DataFrame, totals: np.ndarray) -> DataFrame:
    """The sums of the logarithmic shares of the words in `_rest`, by `_row`."""
    total = F.get(F.array(*(F.lit(float(t)) for t in totals)), F.col("c") - TOP)
    share = counts.select("w", F.log(F.try_divide(F.col("n"), total)).alias("share"))  # a class all of whose words the network predicts has none
    return ids.select("_row", F.explode("_rest").alias("w")).join(share, "w").groupBy("_row").agg(F.sum("share").alias("_rest_share"))


_WORDS: list = [None, None]
_CODES: list = [None, None]


def coded(given: list[bytes]) -> Codes:
    """A worker's table of codes, kept from batch to batch."""
    if _CODES[0] is not given and _CODES[0] != given:
        _CODES[:] = given, Codes(given)
    return _CODES[1]


def remembered(known: dict[str, int]) -> Tokens:
    """A worker's table of words, kept from batch to batch."""
    if _WORDS[0] != known:
        _WORDS[:] = known, Tokens(known)
    return _WORDS[1]


def train(docs: DataFrame, rounds: int = ROUNDS, ids_col: str = "token_ids") -> list[np.ndarray]:
    """The network, trained on all documents (see tokenise); each round on those of one remainder of the tokens' hash."""
    params = start()
    for k in range(rounds):
        given = docs.sparkSession.sparkContext.broadcast(params)

        def local(batches, given=given):
            from pyspark import TaskContext

            step = TaskContext.get().partitionId() % STEP
            mine = [x.copy() for x in given.value]
            squares, n = [np.zeros_like(x) for x in mine], 0
            for b in batches:
                for at in range(0, b.num_rows, 512):
                    flat, places = stream([np.frombuffer(t.as_py(), np.int16) for t in b.column(0).slice(at, 512)])
                    if len(places):
                        train_on(mine, squares, flat, places)
                        n += len(places)
            if n:
                flat = _pack(mine).astype(np.float64) * n
                piece = [flat[i : i + PIECE] for i in range(0, len(flat), PIECE)]
                columns = [pa.array([step] * len(piece), pa.int32()), pa.array(range(len(piece)), pa.int32()), pa.array([x.tobytes() for x in piece], pa.binary()), pa.array([float(n)] * len(piece))]
                yield pa.RecordBatch.from_arrays(columns, ["step", "i", "x", "n"])

        def add(key, pdf):
            import pandas as pd

            return pd.DataFrame({"i": [key[-1]], "x": [np.sum([np.frombuffer(x) for x in pdf["x"]], axis=0).tobytes()], "n": [pdf["n"].sum()]})

        part = docs.where(F.pmod(F.xxhash64(ids_col), F.lit(rounds)) == k).select(ids_col)
        sums = part.mapInArrow(local, "step int, i int, x binary, n double").groupBy("step", "i").applyInPandas(add, "i int, x binary, n double")
        sums = sums.groupBy("i").applyInPandas(add, "i int, x binary, n double")
        rows = sums.orderBy("i").collect()  # as many as the network has pieces
        if rows:
            params = _unpack(np.concatenate([np.frombuffer(r["x"]) for r in rows]) / rows[0]["n"])
    return params


def score(docs: DataFrame, params, ids_col: str = "token_ids", prefix: str = "") -> DataFrame:
    """docs (see tokenise) with n_tokens, log_likelihood (the sum) and mean_log_likelihood."""
    given = docs.sparkSession.sparkContext.broadcast(params)

    @F.pandas_udf("struct<n long, s double>")
    def scored(ids):
        import pandas as pd

        sums, sizes = [np.zeros(0)], [np.zeros(0, np.int64)]
        for at in range(0, len(ids), 512):
            ts = [np.frombuffer(t, np.int16) for t in ids.iloc[at : at + 512]]
            flat, places = stream(ts)
            lp = np.concatenate([[0.0], np.cumsum(log_probabilities(given.value, flat, places))])
            n = np.array([len(t) for t in ts])
            end = np.cumsum(n)
            sums.append(lp[end] - lp[end - n])
            sizes.append(n)
        return pd.DataFrame({"n": np.concatenate(sizes), "s": np.concatenate(sums)})

    out = docs.withColumn("_lm_of_document", scored(ids_col))
    n, s = F.col("_lm_of_document.n"), F.col("_lm_of_document.s")
    return out.withColumns({f"{prefix}n_tokens": n, f"{prefix}log_likelihood": s, f"{prefix}mean_log_likelihood": F.when(n > 0, s / n)}).drop("_lm_of_document")


def op10(docs: DataFrame) -> DataFrame:
    counts = materialise(with_classes(word_counts(docs)))
    rows = frequent(counts, KNOWN)
    totals = class_totals(counts, rows[:TOP])
    ids = materialise(tokenise_all(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row")), rows, totals).drop("text"))
    out = score(ids.drop("_rest"), train(ids)).join(rest_shares(ids, counts, totals), "_row", "left")
    s = F.col("log_likelihood") + F.col("_share") + F.coalesce("_rest_share", F.lit(0.0))
    return out.select("doc_id", "n_tokens", s.alias("log_likelihood"), F.when(F.col("n_tokens") > 0, s / F.col("n_tokens")).alias("mean_log_likelihood"))
