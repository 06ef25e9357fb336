"""SentencePiece encoding and decoding by a batched numpy Viterbi search.

A text is normalised as the model asks (spaces become U+2581, one goes in front) and cut into words, a
run of U+2581 and what follows it; no piece spans two of them. The distinct words of a batch that have
equal length advance together, one column at a time (over 32 characters also those a quarter longer at most; a word that
has ended drops out): rolling hashes of all their substrings probe the sorted hashes of the pieces, and a vectorised
maximum over the pieces that end at the column stores a backpointer. For a unigram model the maximum is of the summed scores. The scores of a BPE model are merge
ranks, whose sum says nothing; there a candidate piece scores 0 if it may follow the piece before it (the
two, written together, are merged back into just these two) and minus infinity otherwise. Exactly
one way through such allowed pairs exists, and it is the model's own merge result.

Characters outside the vocabulary become their UTF-8 byte pieces (or the unknown piece). Decoding joins
pieces, gathers bytes and drops the space in front.

Edge cases. A null text gives null ids; an empty one gives none. U+2581 in a text decodes as a space, as
with the model's own library; all else round-trips. Words of over `LONG` characters are cut in blocks that all advance together,
each from some characters before it; a block counts if it comes to the same state there as the block before it, as later
columns depend on no more, and is else started at the places nearby or, at last, from that state. Very long texts are taken word by
word. Repeated rows are encoded alike. Other columns are carried through.
"""

from __future__ import annotations

import re
from functools import cache, cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
#: Words remembered by a worker, and words that advance together.
REMEMBER, TOGETHER = 1 << 19, 1 << 14
#: Texts encoded and decoded at a time: enough that many new words have equal length.
TEXTS, BACK = 1024, 256
LEAD, PAIR_BITS = 20, 20
#: Characters above which a word is cut in blocks, and of a block.
LONG, PART = 2048, 1024
#: Cells (characters and padding) of words that advance together.
CELLS = 1 << 20
#: Rows below which the pairs of pieces of all columns are judged before.
FEW = 512
MULT = np.uint64(0x9E3779B97F4A7C15)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The vocabulary of a model file, as sorted hashes of its pieces."""

    def __init__(self, path: str):
        import sentencepiece as sp
        from sentencepiece import sentencepiece_model_pb2 as pb

        own, proto = sp.SentencePieceProcessor(model_file=path), pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.bpe = proto.trainer_spec.model_type == 2
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models that keep texts as they are can be used")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.n = own.vocab_size()
        self.text = [own.id_to_piece(i) for i in range(self.n)]
        self.byte = {int(self.text[i][1:-1], 16): i for i in range(self.n) if own.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.special = {i for i in range(self.n) if own.is_control(i) or own.is_unknown(i)}
        self.unk = own.unk_id()
        plain = [i for i in range(self.n) if i not in self.byte_of and i not in self.special and self.text[i]]
        self.score_of = np.array([own.get_score(i) for i in range(self.n)])
        self.ids = {self.text[i]: i for i in plain}
        self.width = max((len(self.text[i]) for i in plain), default=1)
        h = np.array([self._hash(self.text[i]) for i in plain], np.uint64)
        order = np.argsort(h)
        self.keys, self.key_ids = h[order], np.array(plain, np.int64)[order]
        if len(np.unique(h)) != len(h):
            raise ValueError("two pieces share a hash")
        self.leading = np.zeros(1 << LEAD, bool)
        self.leading[self.keys >> np.uint64(64 - LEAD)] = True
        self.pairs = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        self.words: dict[str, bytes] = {}

    @staticmethod
    def _hash(s: str) -> int:
        h = 0
        for c in s:
            h = (h * int(MULT) + ord(c) + 1) & (2**64 - 1)
        return h

    def probe(self, h: np.ndarray) -> np.ndarray:
        """Places in h with the hash of a piece, and the pieces' ids; a table of leading bits spares most searches."""
        where = np.flatnonzero(self.leading[h >> np.uint64(64 - LEAD)])
        h = h[where]
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        found = self.keys[at] == h
        return where[found], self.key_ids[at[found]]

    def merged(self, symbols: list[str], least: int = 1) -> list[str]:
        """The symbols after the model's merges, until `least` are left: the best-scored adjacent pair first,
        leftmost of equal ones."""
        while len(symbols) > least:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                j = self.ids.get(symbols[i] + symbols[i + 1])
                if j is not None and (best is None or self.score_of[j] > best):
                    best, at = self.score_of[j], i
            if at < 0:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def allowed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of piece ids stays these two pieces when merged from characters."""
        pair = a * self.n + b
        keys, known = self.pairs  # the last pair seen with each hash
        slot = ((pair.astype(np.uint64) * MULT) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out, miss = known[slot], np.flatnonzero(keys[slot] != pair)
        if len(miss):
            new, back = np.unique(pair[miss], return_inverse=True)
            ok = self._stay(new // self.n, new % self.n)
            out[miss] = ok[back]
            slot = ((new.astype(np.uint64) * MULT) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
            slot, first = np.unique(slot, return_index=True)
            keys[slot], known[slot] = new[first], ok[first]
        return out

    @cached_property
    def edges(self):
        """For each piece its right edges (itself, the right part of its last merge, that part's right part, ...)
        and its left edges, -1 after the last; when each comes to be, as a rank; whether ranks rise with each
        merge, so that merges happen in their order; hash and power of its length."""
        rank, parts = -self.score_of, {}
        for i in self.ids.values():
            symbols = list(self.text[i])
            while len(symbols) > 2:
                short = self.merged(symbols[:], len(symbols) - 1)
                if len(short) == len(symbols):
                    break
                symbols = short
            parts[i] = [self.ids.get(x, -1) for x in symbols] if len(symbols) == 2 else []
        born = np.full(self.n + 1, np.inf)
        for i in self.ids.values():
            born[i] = rank[i] if parts[i] else -np.inf
        depth = max(len(t) for t in self.ids) if self.ids else 1
        right, left = np.full((self.n, depth), -1), np.full((self.n, depth), -1)
        regular = np.zeros(self.n, bool)
        for i in self.ids.values():
            for side, table in ((1, right), (0, left)):
                x, k = i, 0
                while x >= 0:
                    table[i, k], k = x, k + 1
                    x = parts[x][side] if parts.get(x) else -1
            regular[i] = all(x >= 0 and born[x] < born[i] for x in parts[i]) if len(self.text[i]) > 1 else True
        for i in sorted(self.ids.values(), key=lambda i: len(self.text[i])):
            regular[i] &= all(regular[x] for x in parts[i])
        hashes = np.zeros(self.n, np.uint64)
        powers = np.ones(self.n, np.uint64)
        for i in self.ids.values():
            hashes[i], powers[i] = self._hash(self.text[i]), pow(int(MULT), len(self.text[i]), 2**64)
        return right, left, born, regular, hashes, powers

    def _stay(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """allowed, reckoned for all pairs at once: a merge across the seam happens if its two parts are at the
        seam at one time and its rank comes before those of the merges that would take them away."""
        right, left, born, regular, hashes, powers = self.edges
        ok, odd = np.ones(len(a), bool), ~(regular[a] & regular[b])
        for i in np.flatnonzero(odd).tolist():
            x, y = self.text[a[i]], self.text[b[i]]
            ok[i] = self.merged([*x, *y]) == [x, y]
        for i in range(right.shape[1]):
            live = np.flatnonzero(~odd & ok & (right[a, i] >= 0))
            if not len(live):
                break
            for j in range(left.shape[1]):
                live = live[ok[live] & (left[b[live], j] >= 0)]
                if not len(live):
                    break
                r, m = right[a[live], i], left[b[live], j]
                at, both = self.probe(hashes[r] * powers[m] + hashes[m])
                r, m, w = r[at], m[at], live[at]
                r_gone = born[right[a[w], i - 1]] if i else np.full(len(w), np.inf)
                m_gone = born[left[b[w], j - 1]] if j else np.full(len(w), np.inf)
                s = -self.score_of[both]
                ok[w[(s < r_gone) & (s <= m_gone) & (born[r] <= m_gone) & (born[m] < r_gone)]] = False
        return ok

    @cached_property
    def written(self) -> np.ndarray:
        """What each piece decodes to."""
        return np.array([bytes((self.byte_of[i],)) if i in self.byte_of else b"" if i in self.special else t.encode() for i, t in enumerate(self.text)], object)

    @cached_property
    def alone(self) -> np.ndarray:
        """Which pieces the merges of their own characters make whole."""
        out = np.zeros(self.n, bool)
        for i in self.ids.values():
            out[i] = not self.bpe or self.merged(list(self.text[i])) == [self.text[i]]
        return out


def _codes(words: list[str]) -> np.ndarray:
    """Code points plus one of words, a row a word; 0 after the end of a shorter one."""
    sizes = np.array([len(w) for w in words])
    out = np.zeros((len(words), sizes.max()), np.uint64)
    out[np.arange(sizes.max()) < sizes[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    return out


def _hits(p: Pieces, codes: np.ndarray, done: int):
    """The pieces that end after `done` columns, in the order of their ends, the longest first: where in a flat table of prefixes
    (row 0: of none) they end, their lengths, their ids; and whether a character has no piece of its own."""
    n, size = codes.shape
    c = np.ascontiguousarray(codes.T)
    lone, ends, lengths, ids = c > 0, [], [], []
    h = c
    for k in range(1, min(p.width, size) + 1):
        if k > 1:
            h = h[:-1] * MULT + c[k - 1 :]
        skip = max(0, done - k + 1)  # row j of h: substrings that end after j + k characters
        at, got = p.probe(h[skip:].ravel())
        at += (skip + k - 1) * n
        if k == 1:
            lone.ravel()[at] = False
        good = c.ravel()[at] > 0
        if p.bpe:
            good &= p.alone[got]
        at, got = at[good], got[good]
        ends.append(at + n)
        lengths.append(np.full(len(at), k))
        ids.append(got)
    ends, lengths, ids = (np.concatenate(x[::-1]) for x in (ends, lengths, ids))
    order = np.argsort(ends // n, kind="stable")
    return ends[order], lengths[order], ids[order], lone


def _look_ahead(p: Pieces, ends: np.ndarray, begins: np.ndarray, ids: np.ndarray) -> None:
    """Judge the pairs of pieces that meet anywhere, so that columns of few rows find them judged."""
    by_end = np.argsort(ends, kind="stable")
    first, last = (np.searchsorted(ends[by_end], begins, side) for side in ("left", "right"))
    for at in range(0, len(ids), 1 << 15):
        n = (last - first)[at : at + (1 << 15)]
        b = np.repeat(np.arange(len(n)), n)
        a = by_end[np.arange(len(b)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at : at + (1 << 15)], n)]
        pair = np.unique(ids[a] * p.n + ids[at + b])
        p.allowed(pair // p.n, pair % p.n)


def advance(p: Pieces, codes: np.ndarray, given=None):
    """Sums, lengths of last pieces and last pieces (best, back, piece) of all prefixes of the rows, a column at a time.

    All substrings of all rows are looked up before; a row that has ended has no pieces left and drops out of the columns.
    given: the same of the first columns, from which to go on; else a row begins a word.
    """
    n, size = codes.shape
    unknown = p.n  # stands for a character outside the vocabulary, which nothing merges with
    best = np.full((size + 1, n), -np.inf)
    back, piece = np.zeros((size + 1, n), np.int16 if size < 2**15 else np.int64), np.full((size + 1, n), -1, np.int64)
    best[0], done = 0, 0
    if given is not None:
        done = len(given[0]) - 1
        for table, known in zip((best, back, piece), given, strict=True):
            table[: done + 1] = known
    floor = p.score_of.min() - 10.0
    ends, lengths, ids, lone = _hits(p, codes, done)
    begins = ends - lengths * n
    cuts = np.searchsorted(ends, np.arange(size + 2) * n)
    if p.bpe and n < FEW:
        _look_ahead(p, ends, begins, ids)
    some_lone = lone.any(axis=1)
    sums, lasts = best.ravel(), piece.ravel()
    for end in range(done + 1, size + 1):
        here = slice(cuts[end], cuts[end + 1])
        at, k, got = ends[here], lengths[here], ids[here]
        if p.bpe:  # a prefix has one last piece
            before = lasts[begins[here]]
            good = np.flatnonzero(sums[begins[here]] > -np.inf)
            pair = good[(before[good] >= 0) & (before[good] < unknown)]
            ok = np.zeros(len(at), bool)
            ok[good] = True
            if len(pair):
                ok[pair] = p.allowed(before[pair], got[pair])
            value = sums[begins[here]]
        else:
            value = sums[begins[here]] + p.score_of[got]
            np.maximum.at(sums, at, value)
            ok = (value == sums[at]) & (value > -np.inf)
        won = np.flatnonzero(ok)[::-1]  # of equal ones the longest, which is written last
        at = at[won]
        sums[at], lasts[at], back.ravel()[at] = value[won], got[won], k[won]
        if some_lone[end - 1]:  # a character without a piece of its own
            at = np.flatnonzero(lone[end - 1] & (best[end] == -np.inf if p.bpe else True))
            value = best[end - 1, at] + (0.0 if p.bpe else floor)
            better = value > best[end, at]
            at = at[better]
            best[end, at], back[end, at], piece[end, at] = value[better], 1, unknown
    return best, back, piece


def _agree(p: Pieces, a, b) -> bool:
    """Whether two runs of columns (best, back, piece) lead to the same later columns, but for a constant in best."""
    with np.errstate(invalid="ignore"):
        shift = a[0] - b[0]
    shift = shift[np.isfinite(shift)]
    same = (np.isfinite(a[0]) == np.isfinite(b[0])).all() and (a[1] == b[1]).all() and (a[2] == b[2]).all()
    return bool(same and (not len(shift) or np.ptp(shift) <= 1e-6))


def _advance_long(p: Pieces, words: list[np.ndarray]):
    """back and piece of all prefixes of long words (their codes), a pair a word; the blocks of all words advance together."""
    w = p.width
    lead = 8 * w
    part = max(PART, lead)

    def stacked(rows: list[np.ndarray]):
        """What advance gives for rows of unequal length, a triple of columns a row."""
        step = max(1, CELLS // (lead + part))
        for k in range(0, len(rows), step):
            few = rows[k : k + step]
            codes = np.zeros((len(few), max(map(len, few))), np.uint64)
            for i, r in enumerate(few):
                codes[i, : len(r)] = r
            got = advance(p, codes)
            for i, r in enumerate(few):
                yield tuple(x[: len(r) + 1, i] for x in got)

    def tried(at: list[tuple[int, int]], shift: int) -> dict:
        """By word and start of a block: its columns from w before its start on, begun lead - shift characters before it."""
        rows = [words[i][s - lead + shift : s + part] for i, s in at]
        return {b: tuple(x[lead - shift - w + 1 :].copy() for x in got) for b, got in zip(at, stacked(rows), strict=True)}

    starts = [(i, s) for i, codes in enumerate(words) for s in range(part, len(codes), part)]
    plain = tried(starts, 0)
    held = [[tuple(x.copy() for x in got)] for got in stacked([codes[:part] for codes in words])]
    state = [tuple(x[-w:] for x in h[0]) for h in held]
    others: list[dict] = []
    reached = [part] * len(words)

    def go_on(i: int, alone: bool) -> None:
        """Accept the blocks of word i as far as they agree with what is before them; if alone, all: those that do not, from that state."""
        codes = words[i]
        while reached[i] < len(codes):
            s = reached[i]
            found = next((o[i, s] for o in [plain, *others] if (i, s) in o and _agree(p, state[i], tuple(x[:w] for x in o[i, s]))), None)
            if found is not None:
                new = tuple(x[w:] for x in found)
            elif alone:
                begun = advance(p, codes[None, s - w + 1 : s + part], tuple(x[:, None] for x in state[i]))
                new = tuple(x[w:, 0] for x in begun)
            else:
                return
            held[i].append(new)
            state[i] = tuple(np.concatenate([a, b])[-w:] for a, b in zip(state[i], new, strict=True))
            reached[i] = s + part

    for i in range(len(words)):
        go_on(i, False)
    left = [(i, s) for i, s in starts if s >= reached[i]]
    if left:  # begun at each place of the length of a piece
        others.extend(tried(left, shift) for shift in range(1, w))
        for i in {i for i, _ in left}:
            go_on(i, True)
    return [tuple(np.concatenate([h[j] for h in hs]) for j in (1, 2)) for hs in held]


def viterbi(p: Pieces, words: list[str]) -> list[bytes]:
    """The piece ids (int32) of words, all advancing together."""
    n, sizes, unknown = len(words), np.array([len(w) for w in words]), p.n
    codes = _codes(words)
    if sizes.min() > max(LONG, PART, 16 * p.width):
        back, piece = np.zeros((sizes.max() + 1, n), np.int64), np.zeros((sizes.max() + 1, n), np.int64)
        for i, (b, q) in enumerate(_advance_long(p, [row[:size] for row, size in zip(codes, sizes, strict=True)])):
            back[: len(b), i], piece[: len(q), i] = b, q
    else:
        back, piece = advance(p, codes)[1:]
    pos, alive, who, what, lone = sizes.copy(), np.arange(n), [], [], set()
    while len(alive):
        at = pos[alive]
        got = piece[at, alive]
        lone.update(alive[got == unknown].tolist())
        who.append(alive)
        what.append(got)
        pos[alive] = at - back[at, alive]
        alive = alive[pos[alive] > 0]
    whose = np.concatenate(who[::-1])
    order = np.argsort(whose, kind="stable")
    ids = np.concatenate(what[::-1])[order]
    ends = np.cumsum(np.bincount(whose, minlength=n)).tolist()
    flat, starts = ids.astype(np.int32).tobytes(), [0, *ends[:-1]]
    out = [flat[4 * a : 4 * b] for a, b in zip(starts, ends, strict=True)]
    for w in lone:  # characters outside the vocabulary
        at, full = 0, []
        for i in ids[starts[w] : ends[w]].tolist():
            if i == unknown:
                raw = words[w][at].encode("utf-8", "surrogatepass")
                full += [p.byte[x] for x in raw] if len(p.byte) == 256 else [p.unk]
                at += 1
            else:
                full.append(i)
                at += len(p.text[i])
        out[w] = np.array(full, np.int32).tobytes()
    return out


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _width(size: int) -> int:
    """The columns in which a word of that length advances: up to 32 its length, else at most a quarter more; above LONG in blocks."""
    step = 1 << max(0, size.bit_length() - 3) if size > 32 else 1
    return -(-size // step) * step


def encode_batch(p: Pieces, texts: list[str | None]) -> list[np.ndarray | None]:
    cut = [None if t is None else _WORD.findall((p.prefix + t).replace(" ", SPACE)) if t else [] for t in texts]
    new = set(chain.from_iterable(ws for ws in cut if ws)).difference(p.words)
    if len(p.words) + len(new) > REMEMBER:
        p.words.clear()
        new = set(chain.from_iterable(ws for ws in cut if ws))
    by_size: dict[int, list[str]] = {}
    for w in new:
        by_size.setdefault(_width(len(w)), []).append(w)
    for width, ws in by_size.items():
        step = max(1, min(TOGETHER, CELLS // width))
        for at in range(0, len(ws), step):
            p.words.update(zip(ws[at : at + step], viterbi(p, ws[at : at + step]), strict=True))
    known = p.words.__getitem__
    return [None if ws is None else np.frombuffer(b"".join(map(known, ws)), np.int32) for ws in cut]


def decode(p: Pieces, ids: np.ndarray) -> str:
    text = b"".join(p.written[ids].tolist()).decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if p.prefix and text.startswith(" ") else text


def _with(docs: DataFrame, name: str, kind: str, per_batch, step: int) -> DataFrame:
    """docs with column `name` (in place of one of that name) of per_batch(rows), a few rows at a time."""
    columns = [c for c in docs.columns if c != name]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, step):
                rows = b.slice(at, step)
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in columns), per_batch(rows)], [*columns, name])

    schema = T.StructType([f for f in docs.schema.fields if f.name != name] + [T.StructField(name, T._parse_datatype_string(kind))])
    return docs.mapInArrow(run, schema)


def _as_lists(found: list[np.ndarray | None]) -> pa.Array:
    ends = np.cumsum([0, *(0 if x is None else len(x) for x in found)]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.int32), *(x for x in found if x is not None)])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()), mask=pa.array([x is None for x in found], pa.bool_()))


def encode(docs: DataFrame, path: str | None = None, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """docs with array<int> column ids_col."""
    path = path or default_model()

    def ids(rows):
        return _as_lists(encode_batch(pieces(path), rows.column(text_col).to_pylist()))

    return _with(docs, ids_col, "array<int>", ids, TEXTS)


def decode_ids(docs: DataFrame, path: str | None = None, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """docs with the text of ids_col in text_col."""
    path = path or default_model()

    def text(rows):
        p = pieces(path)
        return pa.array([decode(p, x.values.to_numpy()) if x.is_valid else None for x in rows.column(ids_col)], pa.string())

    return _with(docs, text_col, "string", text, BACK)


def op4(docs: DataFrame, path: str | None = None, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, ids, their number, and whether they decode to the text; the text itself does not come back."""
    path = path or default_model()

    def run(batches):
        p = pieces(path)
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                rows = b.slice(at, TEXTS)
                texts = rows.column("text").to_pylist()
                found = encode_batch(p, texts)
                same = [x is None or decode(p, x) == t.replace(SPACE, " ") for x, t in zip(found, texts, strict=True)]
                n = pa.array([0 if x is None else len(x) for x in found], pa.int32())
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in carried), _as_lists(found), n, pa.array(same, pa.bool_())], [*carried, "ids", "n_ids", "round_trip"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in carried)
    return docs.select(*carried, "text").mapInArrow(run, f"{kinds}, ids array<int>, n_ids int, round_trip boolean")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: doc_id, source, ids, their number, and whether they decode to the text."""
    return op4(docs, carried=("doc_id", "source"))
