"""Importance resampling, repeated byte strings and the Merkle manifest, against brute force on small fixtures and odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F
from tablescope.llm import merkle, repeats, resample

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


# -- op11


@given(st.lists(st.one_of(st.none(), st.text(alphabet="abXZ09 -_é日\n", max_size=40)), max_size=8), st.integers(1, 3))
@settings(deadline=None, max_examples=60)
def test_runs_of_words(texts, longest):
    got = collections.Counter()
    words = np.zeros(len(texts), int)
    for first, n, of_row, row, bucket in resample.features(pa.array(texts, pa.string()), longest, 997):
        words[first:first + n] = of_row
        got.update((first + int(r), int(b)) for r, b in zip(row, bucket))
    want = collections.Counter()
    for i, t in enumerate(texts):
        w = WORDS.findall(low(t).encode())
        assert words[i] == len(w)
        for size in range(1, longest + 1):
            want.update((i, zlib.crc32(b" ".join(w[j:j + size])) % 997) for j in range(len(w) - size + 1))
    assert got == want


def test_very_long_words():
    long = "q" * 2_000_000
    (_, _, _, _, bucket), = resample.features(pa.array([f"{long} a {long}"]), 1, 1000)
    assert bucket.tolist() == [zlib.crc32(x.encode()) % 1000 for x in (long, "a", long)]


def brute_resample(rows, target, percent, min_words, longest=1, buckets=10_000):
    def features(t):
        w = WORDS.findall(low(t).encode())
        return [zlib.crc32(b" ".join(w[i:i + n])) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)], len(w)
    s, t = collections.Counter(), collections.Counter()
    for r in rows:
        s.update(features(r[1])[0])
    for x in target:
        t.update(features(x)[0])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for r in rows:
        f, n = features(r[1])
        h = int(hashlib.sha256(f"2024:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append([r[0], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), None, n])
    fit = sorted((x for x in out if x[5] >= min_words), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for i, x in enumerate(fit[:percent * len(fit) // 100]):
        x[4] = i + 1
    return sorted((tuple(x[:5]) for x in out), key=repr)


@pytest.mark.parametrize("percent,min_words,longest", [(10, 20, 1), (50, 0, 1), (100, 2, 2), (0, 0, 1)])
def test_resample_equals_brute_force(spark, documents, odd, percent, min_words, longest):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    rows = [*odd, *[(100 + i, " ".join(rnd.choices(words, k=rnd.randint(0, 60))), None, None) for i in range(150)]]
    target = [None, "", " ".join(words[:9]), "w1 w2 W3"]
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(target)], "item_id bigint, text string, score string")
    got = resample.resample(documents(rows), bench, percent, min_words, longest=longest)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    got = [tuple(r) for r in got.collect()]
    want = brute_resample(rows, target, percent, min_words, longest)
    no_rank = lambda x: sorted((r[:4] for r in x), key=repr)      # noqa: E731
    assert no_rank(got) == no_rank(want)
    by_rank = lambda x: [(r[4], r[3], r[0]) for r in sorted(x, key=lambda r: r[4] or 0) if r[4]]     # noqa: E731
    assert by_rank(got) == by_rank(want)


def test_cutoff_is_the_kth_key(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([1, 1, 1, 2, rnd.randint(0, 9)]), rnd.choice([None, *range(40)]), i % 3) for i in range(500)]
    df = resample._keyed(spark.createDataFrame(rows, "score bigint, id bigint, tie bigint").repartition(7))
    order = sorted(((-s, i is None, i, t) for s, i, t in rows), key=lambda r: (r[0], r[1], r[2] or 0, r[3]))
    for k in (1, 250, 500):
        r = resample.cutoff(df, k)
        assert (r["down"], r["no_id"], r["id"], r["tie"]) == order[k - 1]


def test_resample_empty(spark, documents):
    e = documents([])
    assert resample.resample(e, e).count() == 0
    full = resample.resample(documents([(1, "a b c", None, None)]), e, 100, 1).collect()
    assert [tuple(r)[0::4] for r in full] == [(1, 1)]


# -- op12


def brute_repeats(texts, length):
    count = collections.Counter()
    data = [(t or "").encode() for t in texts]
    for b in data:
        count.update(b[i:i + length] for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        rest = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest(), rest))
    return out


def repetitive():
    rnd = random.Random(5)
    words = ["alpha", "beta", "gam", "delta é", "x", "日本", "zz zz"]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 80))) for _ in range(30)]
    out = ["|".join(rnd.choice(base)[rnd.randint(0, 40):rnd.randint(60, 300)] for _ in range(rnd.randint(0, 4))) + str(rnd.random())[:rnd.randint(2, 6)]
           for _ in range(120)]
    return [*out, "a" * 300, "a" * 41, "ab" * 100, "", None, out[3], out[3], "short"]


@pytest.mark.parametrize("most,widths", [(10_000, (16, 4, 1)), (2, (16, 4, 1)), (0, (16, 2, 1)), (1, (8, 1)), (5, (1,))])
def test_repeats_equal_brute_force(spark, most, widths):
    """Also where every middle counts as hot and is refined down to whole strings."""
    texts = repetitive()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: r for r in repeats.cut_repeats(df, length=40, widths=widths, most=most, bucket=200).collect()}
    for i, want in enumerate(brute_repeats(texts, 40)):
        assert tuple(got[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) == want[:4] and bytes(got[i]["text"]) == want[4]


def test_repeats_in_one_passage_of_many_texts(spark):
    """A passage in every text, around which nothing is equal: one hot middle after the other."""
    rnd = random.Random(2)
    junk = lambda n: "".join(rnd.choices("abcdefghij", k=n))      # noqa: E731
    passage = junk(60)
    texts = [junk(rnd.randint(30, 90)) + passage + junk(rnd.randint(30, 90)) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in repeats.cut_repeats(df, length=40, widths=(16, 4, 1), most=10, keep_text=False).collect()}
    for i, want in enumerate(brute_repeats(texts, 40)):
        assert (got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == want[1:4]


def test_repeats_on_odd_rows_and_long_texts(documents, odd):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=7))       # noqa: E731
    shared = " ".join(word() for _ in range(70))
    long = " ".join(word() for _ in range(400_000))                              # 3 MB, more than a piece
    more = [(50, long[:1_500_000] + "<" + shared + ">" + long[1_500_000:], None, None), (51, "before [" + shared + "] after", None, None), (52, shared[:399], None, None)]
    out = repeats.cut_repeats(documents([*odd, *more]))
    got = collections.defaultdict(list)
    for r in out.collect():
        got[r["doc_id"]].append(r)
    assert got[50][0]["n_removed"] == len(shared) and got[50][0]["n_spans"] == 1 and got[51][0]["n_spans"] == 1
    assert got[51][0]["n_removed"] == len(shared) and bytes(got[51][0]["text"]) == b"before [] after"
    assert got[52][0]["n_removed"] == 0 and sum(map(len, got.values())) == len(odd) + 3
    assert got[4][0]["n_removed"] == got[4][0]["n_bytes"] == got[5][0]["n_removed"] and got[1][0]["n_bytes"] == 0    # two rows of one long text
    assert "score" in out.columns and "n_bytes" in out.columns


def test_run_index_matches_all_pairs():
    rnd = random.Random(4)
    rows = sorted({(rnd.choice([b"m1", b"m2"]), bytes(rnd.choices(b"ab", k=rnd.randint(0, 7))), bytes(rnd.choices(b"ab", k=rnd.randint(0, 8)))) for _ in range(200)})
    mids, behind, ahead = zip(*rows)
    index = repeats.RunIndex(list(mids), list(behind), list(ahead))
    common = lambda x, y: next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))      # noqa: E731
    for d, (members, best) in enumerate(index.matching_statistics()):
        assert members.tolist() == [i for i, x in enumerate(behind) if len(x) >= d]
        for i, got in zip(members.tolist(), best.tolist()):
            tail = behind[i][len(behind[i]) - d:]
            assert got == max((common(ahead[i], ahead[j]) for j in members.tolist()
                               if j != i and mids[j] == mids[i] and behind[j][len(behind[j]) - d:] == tail), default=-1)
    copies = repeats.RunIndex([b"m"] * 50, [bytes([65 + i]) + b"same" * 20 for i in range(50)], [b"x" * i for i in range(50)])
    assert copies.runs < 50 * 5      # 50 strings that differ at their far ends only: runs at the ends, none in between


def test_repeats_empty_and_short(documents):
    assert repeats.cut_repeats(documents([])).count() == 0
    assert repeats.cut_repeats(documents([(1, "a", None, None), (2, "a", None, None)])).agg(F.sum("n_removed")).first()[0] == 0


# -- op13


def sha(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def brute_manifest(rows, names, fan):
    def leaf(r, text):
        vals = [text if n == "text" else r[n] for n in names]
        return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in vals])

    def tree(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha(*out[-1][i:i + fan]) for i in range(0, len(out[-1]), fan)])
        return out
    groups = collections.defaultdict(list)
    for r in rows:
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
        text = r["text"] if r["text"] is None else low(r["text"])
        groups[r["lang"]].append((r["doc_id"], leaf(r, r["text"]), leaf(r, text) if hit else leaf(r, r["text"])))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = [tree([x[1] for x in groups[g]]) for g in order]
    top = tree([t[-1][0] for t in trees])
    out = []
    for j, g in enumerate(order):
        for i, (k, node, new) in enumerate(groups[g]):
            proof, levels, at = [], [*[(lv, None) for lv in trees[j][:-1]], *[(lv, j) for lv in top[:-1]]], i
            switched = False
            for nodes, start in levels:
                if start is not None and not switched:
                    at, switched = start, True
                run = nodes[at - at % fan:at - at % fan + fan]
                proof += [x for p, x in enumerate(run) if p != at % fan]
                new = sha(*[new if p == at % fan else x for p, x in enumerate(run)])
                at //= fan
            out.append((k, node, trees[j][-1][0], top[-1][0], sha(*proof), new, new == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("fan,depth,n", [(8, 4, 40), (2, 2, 75), (3, 1, 90), (8, 1, 700)])
def test_manifest_equals_brute_force(documents, odd, fan, depth, n):
    """Small fans and depths, so that groups have several stories."""
    rnd = random.Random(8)
    rows = [*odd, *[(100 + i, rnd.choice(["Text", "lower", None, "ÀB"]) and f"Text {i}", rnd.choice(["en", "en", "en", "de", "", "é"]), "s") for i in range(n)],
            (9999, "Alone", "zz", None)]
    df = documents(rows)
    got = sorted((tuple(r) for r in merkle.manifest(df, merkle.tampered(), fan=fan, depth=depth).collect()), key=repr)
    assert got == brute_manifest([r.asDict() for r in df.collect()], merkle.FIELDS, fan)
    assert any(not r[6] for r in got) and any(r[6] for r in got)


def test_manifest_of_few_rows(documents):
    assert merkle.manifest(documents([]), merkle.tampered()).count() == 0
    one, = merkle.manifest(documents([(5, "T", None, None)])).collect()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["verified"] and one["proof_sha256"] == sha("")


def test_versions_share_untouched_nodes():
    block = merkle.Block([sha(str(i)) for i in range(70)], 8, 3)
    before = [list(x) for x in block.levels]
    version = block.version(37, sha("new"))
    changed = [list(x) for x in block.levels]
    assert changed == before and len(version) == 4      # the leaf and its three ancestors, nothing else
    nodes = [*before[0][:37], sha("new"), *before[0][38:]]
    assert merkle.Block(nodes, 8, 3).top == version[-1] != block.top
