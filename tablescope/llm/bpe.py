"""Byte-level BPE by prefix dynamic programming, with exact appends, local re-encoding after edits, and decoding.

The encoding of every byte prefix ends in one token that merge order allows after the encoding of what stands before it. Storing that
token for each prefix is enough: the ids are read off backwards, bytes appended later extend the table, and after an edit the
table is recomputed from the edit until it agrees again with the old one over the longest token's length.

Spark deals out the texts; a task encodes whole texts with these functions. Defined results: a null text counts as empty, an empty
text has no ids; repeated rows are encoded each; any length of text is encoded whole; an empty table gives an empty result; columns
that have the names of output columns make these take underscores.
"""

from __future__ import annotations

import base64
import ctypes
import hashlib
import re
from itertools import chain, filterfalse, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import free_name

CACHE_PIECES = 200_000      # pieces whose ids a task remembers
FITS = 1 << 15              # answers of fits() that a worker remembers
SIDE_BY_SIDE = 64           # bytes up to which pieces are encoded together, and remembered
GROUP_BYTES = 1 << 17       # bytes of the pieces that are encoded together
SLOTS = 1 << 20             # answers about pairs of tokens that a worker remembers
EDGES = 1 << 18             # hashes of the edges of the tree of tokens
DECODED = 1 << 13           # ids that are decoded together
PORTION = 100_000           # pieces that are looked at together
SLICE_BYTES = 1 << 21       # texts that a task holds as Python strings at a time; a longer text is held alone


class Vocabulary:
    """Ranks of a byte-level BPE: rank = id = order of the merges."""

    def __init__(self, rank_file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            self.tokens[i] = token
        self.longest = max(map(len, self.ranks))
        self.lengths = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))
        self._bytes, self._from = np.frombuffer(b"".join(self.tokens), np.uint8), np.cumsum(self.lengths) - self.lengths
        # Every way to cut a token into two, in order of ``left part << 32 | right part``: what the two give when put together.
        ranks = self.ranks
        cuts = [(x, y, i) for token, i in ranks.items() for n in range(1, len(token))
                if (x := ranks.get(token[:n])) is not None and (y := ranks.get(token[n:])) is not None]
        x, y, i = np.array(cuts, np.int64).reshape(-1, 3).T
        order = np.argsort(x << 32 | y)
        x, y, i = x[order], y[order], i[order]
        self._cuts, self._joined = x << 32 | y, i
        self._left, self._right = self._last_merges(x, y, i)
        # left[i], right[i]: the two tokens whose merge makes token i. A byte stands for itself; a token that merges never make has no entry.
        made = np.flatnonzero(self._left >= 0).tolist()
        self.left, self.right = (dict(zip(made, side[made].tolist())) for side in (self._left, self._right))
        self.made = {self.tokens[i]: i for i in made}
        self._fits: dict[tuple[int, int], bool] = {}
        self._edges = None
        self._slots = np.full(SLOTS, -1, np.int64)      # pair << 1 | whether it fits, at one place for each hash

    def _last_merges(self, x: np.ndarray, y: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens whose merge makes each token: of its cuts the one that earlier merges leave; -1 without one. Shorter tokens come first."""
        left = np.full(len(self.tokens), -1, np.int64)
        right = left.copy()
        single = np.fromiter((i for t, i in self.ranks.items() if len(t) == 1), np.int64)
        left[single] = right[single] = single
        early_x, early_y = (x < i) | (self.lengths[x] == 1), (y < i) | (self.lengths[y] == 1)
        order = np.argsort(self.lengths[i], kind="stable")
        order = order[(early_x & early_y)[order]]
        for some in np.split(order, np.flatnonzero(np.diff(self.lengths[i[order]])) + 1):
            some = some[(left[x[some]] >= 0) & (left[y[some]] >= 0)]
            some = some[self._borders_hold(x[some], y[some], i[some], left, right)]
            left[i[some]], right[i[some]] = x[some], y[some]
        return left, right

    def fits(self, a: int, b: int) -> bool:
        """Whether the bytes of tokens ``a`` and ``b`` in a row are encoded as just these two.

        Merges are undone from the latest one back. As long as no merge across the border would have come before the one just undone, the border held.
        """
        known = self._fits.get((a, b))
        if known is None:
            if len(self._fits) >= FITS:
                self._fits.clear()
            known = self._fits[a, b] = self._border_holds(a, b)
        return known

    def _border_holds(self, a: int, b: int) -> bool:
        ranks, tokens, left, right = self.ranks, self.tokens, self.left, self.right
        before = len(tokens)        # merges of a lower rank come before the state that is looked at
        while True:
            if ranks.get(tokens[a] + tokens[b], before) < before:
                return False
            split_a, split_b = right[a] != a, left[b] != b
            if not (split_a or split_b):
                return True
            if split_a and (a > b or not split_b):
                before, a = a, right[a]
            else:       # of equal merges the left one comes first, so a merge of this same rank over the border wins
                before, b = b + 1, left[b]

    def _borders_hold(self, a: np.ndarray, b: np.ndarray, before: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``_border_holds`` of many pairs, side by side, under the merges of a rank below ``before``."""
        out, open_ = np.ones(len(a), bool), np.arange(len(a))
        while len(open_):
            pair = a << 32 | b
            at = np.minimum(np.searchsorted(self._cuts, pair), len(self._cuts) - 1)
            broken = (self._cuts[at] == pair) & (self._joined[at] < before) if len(self._cuts) else np.zeros(len(a), bool)
            out[open_[broken]] = False
            split_a, split_b = right[a] != a, left[b] != b
            of_a = split_a & ((a > b) | ~split_b)
            before, a, b = np.where(of_a, a, b + 1), np.where(of_a, right[a], a), np.where(of_a, b, left[b])
            on = ~broken & (split_a | split_b)
            open_, before, a, b = open_[on], before[on], a[on], b[on]
        return out

    @staticmethod
    def _hash(keys: np.ndarray) -> np.ndarray:
        return keys * 0x9E3779B97F4A7C1 >> 40       # the lower bits of the product do not depend on the token in the upper half

    def _fit_all(self, pairs: np.ndarray) -> np.ndarray:
        """``fits`` of each ``a << 32 | b``; a negative one (nothing before the token) fits. Answers are remembered."""
        place = self._hash(pairs) & (SLOTS - 1)
        known = self._slots[place]
        out = (known & 1).astype(bool) | (pairs < 0)
        new = np.flatnonzero((known >> 1 != pairs) & (pairs >= 0))
        if len(new):
            distinct, of = np.unique(pairs[new], return_inverse=True)
            a, b = distinct >> 32, distinct & 0xFFFFFFFF
            answers = self._borders_hold(a, b, np.full(len(a), len(self.tokens)), self._left, self._right)
            out[new] = answers[of]
            self._slots[self._hash(distinct) & (SLOTS - 1)] = distinct << 1 | answers
        return out

    def last_tokens(self, piece: bytes, last: list[int]) -> list[int]:
        """Extend ``last`` (last[i]: last token of the first i bytes; last[0] is unused) to the whole of ``piece``."""
        made, fits, longest = self.made, self.fits, self.longest
        for i in range(len(last), len(piece) + 1):
            for start in range(max(0, i - longest), i):
                token = made.get(piece[start:i])
                if token is not None and (start == 0 or fits(last[start], token)):
                    last.append(token)
                    break
        return last

    def read_off(self, last: list[int]) -> list[int]:
        ids, i = [], len(last) - 1
        while i > 0:
            ids.append(last[i])
            i -= len(self.tokens[last[i]])
        return ids[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        return self.read_off(self.last_tokens(piece, [-1]))

    def _trie(self) -> tuple[np.ndarray, ...]:
        """(bucket, key, next, token): where each hash starts, edges ``state << 9 | byte`` in order of their hash, the state they lead to, and each state's
        token or -1."""
        if self._edges is None:
            states: dict[bytes, int] = {b"": 0}
            for token in sorted(self.made, key=len):
                for n in range(1, len(token) + 1):
                    states.setdefault(token[:n], len(states))
            key = np.array([states[p[:-1]] << 9 | p[-1] for p in states if p], np.int64)
            of = np.full(len(states), -1, np.int64)
            for token, i in self.made.items():
                of[states[token]] = i
            hashes = self._hash(key) & (EDGES - 1)
            order = np.argsort(hashes)
            bucket = np.searchsorted(hashes[order], np.arange(EDGES + 1)).astype(np.int32)
            self._edges = bucket, key[order], order + 1, of     # the state of number n came in by edge n - 1
        return self._edges

    def _tokens_in(self, data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every token in ``data`` at the places ``start``, as (start, end, token). No token has the value 256."""
        bucket, keys, to, of = self._trie()
        end, state, found = start, np.zeros(len(start), np.int64), [(start[:0],) * 3]
        while len(start):
            key = state << 9 | data[end]
            hashes = self._hash(key) & (EDGES - 1)
            at, stop = bucket[hashes], bucket[hashes + 1]
            hit = np.full(len(key), -1)
            look = np.flatnonzero(at < stop)
            while len(look):        # mostly once
                same = keys[at[look]] == key[look]
                hit[look[same]] = at[look[same]]
                look = look[~same]
                at[look] += 1
                look = look[at[look] < stop[look]]
            some = np.flatnonzero(hit >= 0)
            start, end, state = start[some], end[some] + 1, to[hit[some]]
            token = of[state]
            some = np.flatnonzero(token >= 0)
            found.append((start[some], end[some], token[some]))
        return tuple(map(np.concatenate, zip(*found)))

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts): the ids of all pieces in a row, and how many each has. Pieces go in groups of about GROUP_BYTES."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends, done, at = np.cumsum(sizes), [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        while at < len(pieces):
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + GROUP_BYTES, "right")))
            done.append(self._encode_group(b"".join(pieces[at:to]), sizes[at:to]))
            at = to
        return tuple(map(np.concatenate, zip(*done)))

    def _encode_group(self, joined: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tables of all pieces grow by one prefix at a time, side by side."""
        # A piece of n bytes has n + 1 places, the first for its empty prefix; they hold the byte after each prefix, or 256.
        after = np.cumsum(sizes + 1)
        data = np.full(len(joined) + len(sizes), 256, np.int64)
        inside = np.ones(len(data), bool)
        inside[after - 1] = False
        data[inside] = np.frombuffer(joined, np.uint8)
        start, end, token = self._tokens_in(data, np.flatnonzero(inside))
        prefix = (np.arange(len(data)) - np.repeat(after - sizes - 1, sizes + 1)).astype(np.min_scalar_type(int(sizes.max())))
        order = np.argsort(prefix[end], kind="stable")      # a radix sort, as the numbers are short
        bounds = np.cumsum(np.bincount(prefix[end])).tolist()
        start, end, token = start[order], end[order], token[order]
        last = np.full(len(data), -1, np.int64)             # the last token of each prefix
        for a, b in zip(bounds, bounds[1:]):
            good = self._fit_all(last[start[a:b]] << 32 | token[a:b])
            last[end[a:b][good]] = token[a:b][good]
        # The ids are those at the places that are met on the way back from the ends.
        met, at = np.zeros(len(data), bool), (after - 1)[sizes > 0]
        while len(at):
            met[at] = True
            at = at - self.lengths[last[at]]
            at = at[last[at] >= 0]
        return last[met], np.diff(np.cumsum(met)[after - 1], prepend=0)

    def decode(self, ids) -> bytes:
        return b"".join(self.decoded(np.fromiter(ids, np.int64)))

    def decoded(self, ids: np.ndarray):
        """The bytes of ``ids``, in portions."""
        for at in range(0, len(ids), DECODED):
            some = ids[at:at + DECODED]
            lengths = self.lengths[some]
            ends = np.cumsum(lengths)
            yield self._bytes[np.arange(int(ends[-1])) + np.repeat(self._from[some] - ends + lengths, lengths)].tobytes()


class EncodedBytes:
    """A run of bytes (without pre-splitting) whose prefix table is kept, for appends and edits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data = vocabulary, data
        self.last = vocabulary.last_tokens(data, [-1])

    def append(self, more: bytes) -> None:
        self.data += more
        self.vocabulary.last_tokens(self.data, self.last)

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in the place of data[start:stop]; returns how many table entries were computed anew."""
        v, old, shift = self.vocabulary, self.last, len(new) - (stop - start)
        data = self.data[:start] + new + self.data[stop:]
        last, agree, i = old[:start + 1], 0, start + 1
        while i <= len(data):
            v.last_tokens(data[:i], last)
            agree = agree + 1 if i > start + len(new) and last[i] == old[i - shift] else 0
            i += 1
            if agree >= v.longest:      # every later entry looks back at most so far
                last += old[i - shift:]
                break
        done, self.data, self.last = i - start - 1, data, last
        return done

    def ids(self) -> list[int]:
        return self.vocabulary.read_off(self.last)


# Letters, numbers and white space of U+0000 to U+00FF, written out: such texts are split by the faster standard module.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"


class Encoder:
    """Splits texts by ``pattern`` and encodes every piece by itself; the ids come as little-endian unsigned 32-bit integers."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.vocabulary = Vocabulary(rank_file)
        self.any = regex.compile(pattern)
        narrow = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{_S}{_L}{_N}]").replace(r"\p{L}", f"[{_L}]").replace(r"\p{N}", f"[{_N}]")
        narrow = narrow.replace(r"\S", f"[^{_S}]").replace(r"\s", f"[{_S}]")
        self.narrow = re.compile(narrow) if not re.search(r"\\[pPsSwWdD]", narrow) else None
        self.pieces: dict[str, bytes] = {}

    def _split(self, text: str):
        if self.narrow is not None:
            try:
                text.encode("latin-1")
                return self.narrow
            except UnicodeEncodeError:
                pass
        return self.any

    def _learn(self, parts: list[list[str]]) -> None:
        """Put the ids of the pieces of ``parts`` into the cache."""
        known, ranks = self.pieces, self.vocabulary.ranks
        missing = set(filterfalse(known.__contains__, chain.from_iterable(parts)))
        if len(known) + len(missing) > CACHE_PIECES:
            known.clear()
            missing = set(chain.from_iterable(parts))
        short, short_bytes = [], []
        for piece in missing:
            data = piece.encode()
            if (whole := ranks.get(data)) is not None:
                known[piece] = whole.to_bytes(4, "little")
            elif len(data) <= SIDE_BY_SIDE:
                short.append(piece)
                short_bytes.append(data)
            else:
                known[piece] = np.array(self.vocabulary.encode_piece(data), "<u4").tobytes()
        ids, counts = self.vocabulary.encode_pieces(short_bytes)
        packed, at = ids.astype("<u4").tobytes(), 0
        for piece, end in zip(short, (4 * np.cumsum(counts)).tolist()):
            known[piece] = packed[at:end]
            at = end

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Pieces are taken in portions of about PORTION, of many short texts or of a part of a long one."""
        out: list[bytes] = [b""] * len(texts)
        waiting: list[tuple[int, list[str]]] = []
        held = 0

        def finish():
            self._learn([p for _, p in waiting])
            for i, p in waiting:
                out[i] += b"".join(map(self.pieces.__getitem__, p))

        for i, text in enumerate(texts):
            split = self._split(text)
            if len(text) < PORTION:
                parts = [split.findall(text)]
            else:
                found = (m.group() for m in split.finditer(text))
                parts = iter(lambda: list(islice(found, PORTION)), [])
            for part in parts:
                waiting.append((i, part))
                held += len(part)
                if held >= PORTION:
                    finish()
                    waiting, held = [], 0
        finish()
        return out


_ENCODERS: dict[tuple[str, str], Encoder] = {}      # one for each worker, vocabulary and pattern


def encoder_of(rank_file: bytes, pattern: str) -> Encoder:
    key = (hashlib.sha256(rank_file).hexdigest(), pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(rank_file, pattern)
    return _ENCODERS[key]


def _give_back(encoder: Encoder) -> None:
    """Empty what a task has learnt; the worker stays and keeps the vocabulary."""
    encoder.pieces = {}
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc keeps freed memory until it is told not to
    if trim:
        trim(0)


def _slices(batches, text: str):
    """The batches in runs of rows with about SLICE_BYTES of text."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
            yield b.slice(at, to - at)
            at = to


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, text: str = "text", ids: bool = True) -> DataFrame:
    """``docs`` without the text, plus n_tokens, ids_sha256, decoded_sha256 and, with ``ids``, the ids themselves (array<int>).

    The rank file (under 1 MB) is read once and broadcast. decoded_sha256 is of the bytes that decoding gives.
    """
    with open(rank_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    kept = [c for c in docs.columns if c != text]
    names = {c: free_name(docs, c) for c in ("ids", "n_tokens", "ids_sha256", "decoded_sha256")}
    schema = T.StructType([docs.schema[c] for c in kept])
    if ids:
        schema.add(names["ids"], T.ArrayType(T.IntegerType(), False))
    schema = schema.add(names["n_tokens"], T.LongType()).add(names["ids_sha256"], T.StringType()).add(names["decoded_sha256"], T.StringType())

    def run(batches):
        encoder = encoder_of(ranks.value, pattern)
        sha = hashlib.sha256
        for b in _slices(batches, text):
            packed, counts, of_ids, of_bytes = [], [], [], []
            at = b.schema.get_field_index(text)
            for data in encoder.encode([x or "" for x in b.column(at).to_pylist()]):
                counts.append(len(data) // 4)
                of_ids.append(sha(data).hexdigest())
                decoded = sha()
                for part in encoder.vocabulary.decoded(np.frombuffer(data, "<u4")):
                    decoded.update(part)
                of_bytes.append(decoded.hexdigest())
                if ids:
                    packed.append(data)
            columns = [b.column(i) for i in range(b.num_columns) if i != at]
            if ids:
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4"))))
            columns += [pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        _give_back(encoder)

    return docs.mapInArrow(run, schema)
