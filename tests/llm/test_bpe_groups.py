"""Pieces that are encoded side by side: the same ids as tiktoken for any vocabulary, and each pair of tokens decided about once."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tablescope.llm import bpe


def rank_file(tokens):
    return b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in tokens)


def drawn_vocabulary(seed, letters=b"abc "):
    """All bytes in any order, and merges of two earlier tokens; some of the ranks are left out, some tokens are ones that merges never make."""
    rnd = random.Random(seed)
    tokens = [bytes([i]) for i in range(256)]
    rnd.shuffle(tokens)
    parts, ranked = [bytes([c]) for c in letters], list(enumerate(tokens))
    for i in range(300, 420):
        t = bytes(rnd.choices(letters, k=rnd.randint(4, 7))) if rnd.random() < 0.1 else rnd.choice(parts) + rnd.choice(parts)
        if t not in parts and len(t) < 12:
            parts.append(t)
            ranked.append((i, t))
    return rank_file(ranked), dict((t, i) for i, t in ranked)


@pytest.mark.parametrize("seed", range(8))
def test_drawn_vocabularies_equal_tiktoken(seed):
    file, ranks = drawn_vocabulary(seed)
    reference = tiktoken.Encoding("drawn", pat_str=r"[abc]+| +|[^abc ]+", mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(seed)
    texts = ["".join(rnd.choices("abc ", [5, 5, 5, 1], k=rnd.randint(0, 150))) + rnd.choice(["", "é", "日本"]) for _ in range(400)]
    encoder = bpe.Encoder(file, r"[abc]+| +|[^abc ]+")
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
    assert got == [reference.encode_ordinary(t) for t in texts]
    assert [encoder.vocabulary.decode(x).decode() for x in got] == texts


@pytest.fixture(scope="module")
def vocabulary():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return bpe.Vocabulary(f.read())


def test_pairs_are_decided_once(vocabulary, monkeypatch):
    """Answers were kept at a place that hardly depended on the left token, and pushed one another out."""
    rnd = random.Random(5)
    sounds = ["an", "th", "er", "ing", "ou", "sch", "qu", "tion", "é", "st", "ly", "or", "ü", "ndt"]
    pieces = list({"".join(rnd.choices(sounds, k=rnd.randint(2, 6))).encode() for _ in range(20_000)})
    decided = []
    for name in ("_border_holds", "_borders_hold"):
        if own := getattr(vocabulary, name, None):
            monkeypatch.setattr(vocabulary, name, lambda a, *more, own=own: (decided.append(np.size(a)), own(a, *more))[1])
    vocabulary.encode_pieces(pieces)
    first = sum(decided)
    vocabulary.encode_pieces(pieces)
    assert first > 2000 and sum(decided) - first < first / 10


def test_many_pairs_at_once_equal_one_by_one(vocabulary):
    rnd = random.Random(6)
    tokens = [t for t in vocabulary.made.values() if len(vocabulary.tokens[t]) < 5]
    pairs = [(rnd.choice(tokens), rnd.choice(tokens)) for _ in range(20_000)]
    pairs += [(vocabulary.left[t], vocabulary.right[t]) for t in tokens if vocabulary.left[t] != t]
    got = vocabulary._fit_all(np.array([a << 32 | b for a, b in pairs] + [-1]))
    assert got.tolist() == [vocabulary.fits(a, b) for a, b in pairs] + [True]


def test_groups_and_portions(vocabulary, monkeypatch):
    """Pieces of no, one and many bytes in groups of few bytes; decoding in portions."""
    rnd = random.Random(7)
    pieces = [bytes(rnd.choices(b"aetionh sing\xc3\xa9", k=n)) for n in [0, 1, 2, 64, 0, 200] * 20] + [b"", b"\xff\x00"]
    monkeypatch.setattr(bpe, "GROUP_BYTES", 100)
    monkeypatch.setattr(bpe, "DECODED", 7, raising=False)
    ids, counts = vocabulary.encode_pieces(pieces)
    ends = np.cumsum(counts).tolist()
    assert [ids[a:b].tolist() for a, b in zip([0] + ends, ends)] == [vocabulary.encode_piece(p) if p else [] for p in pieces]
    assert vocabulary.decode(i for i in ids.tolist()) == b"".join(pieces)
    assert [len(x) for x in vocabulary.encode_pieces([])] == [0, 0] and vocabulary.decode([]) == b""


def test_full_cache(monkeypatch):
    """A cache that fills up between portions changes no ids."""
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        encoder = bpe.Encoder(f.read(), public_tokenizers.PATTERN)
    rnd = random.Random(8)
    texts = [" ".join("".join(rnd.choices("aeinrst", k=rnd.randint(1, 5))) for _ in range(50)) for _ in range(40)]
    want = encoder.encode(texts)
    monkeypatch.setattr(bpe, "CACHE_PIECES", 60)
    monkeypatch.setattr(bpe, "PORTION", 70)
    assert encoder.encode(texts) == want
    assert hashlib.sha256(b"".join(encoder.vocabulary.decode(np.frombuffer(x, "<u4").tolist()) for x in want)).digest() == hashlib.sha256("".join(texts).encode()).digest()
