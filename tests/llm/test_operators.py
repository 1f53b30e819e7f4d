"""Every operator on odd rows, empty tables and small fixtures, against brute force or an exact round trip."""

import base64
import collections
import datetime
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle_check import compare, connect

import corpus_pipeline
from pyspark.sql import functions as F
from tablescope.llm import ann, bpe, exact_dedup, language, licenses, line_dedup, minhash, mixing, pii, shared, toxicity
from tablescope.llm.kernel import shingle_sets, word_counts
from tablescope.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


# -- kernel


@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \t\nabcXYé 日", max_size=30)), max_size=8))
@settings(deadline=None, max_examples=60)
def test_words_and_shingles(texts):
    import pyarrow as pa
    data = pa.array(texts, pa.string())
    assert word_counts(data).tolist() == [len(WORD.findall(t or "")) for t in texts]
    sets = list(shingle_sets(data))
    for t, s in zip(texts, sets):
        w = WORD.findall(low(t))
        assert len(s) == (len({tuple(w[i:i + 5]) for i in range(len(w) - 4)}) if len(w) > 4 else bool(w))


# -- op1


def test_feistel_is_a_permutation():
    f = pii.Feistel(b"key")
    for size in (1, 2, 7, 100, 1000):
        image = [f.permute(i, "t", size) for i in range(size)]
        assert sorted(image) == list(range(size))
        assert [f.permute(i, "t", size, back=True) for i in image] == list(range(size))


def test_pseudonyms_keep_format_and_links(documents, odd):
    text = ("card 4111 1111 1111 1111, tel +1 (988) 555-2485, ip 42.144.35.254, born 2021-03-04, ssn 123-45-6789, a.b1@mail.example.com, "
            "iban DE89 3704 0044 0532 0130 00, password=b7db7aa4a5fcc78305, not 4111111111111112 nor 2021-13-45 nor 1.2.3")
    other = "4111111111111111 988.555.2485 03/04/2021 DE89370400440532013000"
    df = pii.pseudonymise(documents([*odd, (20, text, None, None), (21, other, None, None)]), b"key")
    out = {r["doc_id"]: r for r in df.collect() if (r["doc_id"] or 0) >= 20}
    new, linked = out[20]["text"], out[21]["text"]
    assert df.count() == len(odd) + 2 and out[20]["_n_found"] == 8 and out[21]["_n_found"] == 4
    card = re.search(r"card (\d{4} \d{4} \d{4} \d{4}),", new)[1].replace(" ", "")
    assert card != "4111111111111111" and pii.luhn(card[:-1]) == int(card[-1]) and card in linked
    assert re.search(r"tel \+1 \((\d{3})\) (\d{3})-(\d{4}),", new).expand(r"\1.\2.\3") in linked
    day = datetime.date.fromisoformat(re.search(r"born ([\d-]+)", new)[1])
    assert day.strftime("%m/%d/%Y") in linked
    assert "not 4111111111111112 nor 2021-13-45 nor 1.2.3" in new and "@mail.example.com" in new
    back = {r["doc_id"]: r["text"] for r in pii.pseudonymise(df.select("doc_id", "text"), b"key", restore=True).collect()}
    assert back[20] == text and back[21] == other and back[1] is None


@pytest.mark.parametrize("value", ["1980-05-06", "05/06/1980", "192.0.2.7", "123-45-6789", "4111 1111 1111 1111", "4111111111111111", "555-123-4567",
                                   "+1 555-123-4567", "(555) 123-4567"])
def test_values_after_a_parenthesis_or_sign(value):
    names, back = pii.Pseudonyms(b"key"), pii.Pseudonyms(b"key", back=True)
    plain = pii.replace(value, names)
    for before, after in (("(", ")"), ("f(", ")"), ("((", "))"), ("(on ", " or 12)"), ("+(", ")")):
        new = pii.replace(before + value + after, names)
        assert plain != value and new == before + plain + after
        assert pii.replace(new, back) == before + value + after


@pytest.mark.parametrize("before,value,after", [
    ("", "BE68 5390 0754 7034", " BIC"), ("", "BE68 5390 0754 7034", " EUR 12"), ("", "BE68539007547034", " EUR"), ("", "AT61 1904 3002 3457 3201", " BIC"),
    ("", "ES91 2100 0418 4502 0005 1332", " EUR"), ("", "PL61 1090 1014 0000 0712 1981 2874", " A"), ("", "NO93 8601 1117 947", " EUR"),
    ("", "DE89 3704 0044 0532 0130 00", " BIC COBA"), ("AB12 CDEF ", "GB82 WEST 1234 5698 7654 32", " X"), ("", "2021-03-04", "T10:00:00Z"),
    ("", "2021-03-04", "t10:00"), ("1234 ", "4111 1111 1111 1111", "."), ("+", "4111 1111 1111 1111", ""), ("", "+49 30 1234 5678", " 4111 1112")])
def test_a_failed_candidate_hides_no_value(before, value, after):
    names, back = pii.Pseudonyms(b"key"), pii.Pseudonyms(b"key", back=True)
    plain = pii.replace(value, names)
    new = pii.replace(before + value + after, names)
    assert plain != value and new == before + plain + after
    assert pii.replace(new, back) == before + value + after


def test_no_date_in_what_only_looks_like_a_timestamp():
    names = pii.Pseudonyms(b"key")
    for text in ("2021-03-04Txx", "2021-03-04-05", "2021-03-04/05", "2021-13-45T10:00", "X2021-03-04T10"):
        assert pii.replace(text, names) == text


def test_longer_ibans_turn_back():
    """Longer than their country's: read alike before and after, whether or not the beginning passes as well."""
    names, back = pii.Pseudonyms(b"key"), pii.Pseudonyms(b"key", back=True)
    for i in range(300):
        body = f"{i * 7919:012d}{i % 1000:03d}"
        value = "BE" + pii._iban_check("BE", body) + body
        assert pii.replace(pii.replace(value, names), back) == value


# -- op2


def test_mix_meets_targets(spark, documents, odd):
    rnd = random.Random(3)
    more = [(100 + i, " ".join(["w"] * rnd.randint(0, 60)), None, rnd.choice(["s1", "s1", "s1", "s2", "s3", None])) for i in range(600)]
    words = {r[0]: r[1] for r in more}
    docs = documents([r for r in odd if r[0] not in (4, 5)] + more)
    got = mixing.mix(docs)
    size = collections.Counter()
    taken, target, largest = collections.Counter(), {}, collections.Counter()
    for r in got.collect():
        s, n = r["source"], r["_mix_size"]
        size[s] += n
        taken[s] += n * r["mix_repeats"]
        target[s] = r["mix_target"]
        largest[s] = max(largest[s], n)
        assert 0 <= r["mix_repeats"] <= 3
        if (r["doc_id"] or 0) >= 100:
            assert n == len(WORD.findall(words[r["doc_id"]]))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    want, left, free = {}, float(sum(size.values())), set(order)
    while True:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if 3 * size[s] <= weight[s] * level]
        if not over:
            break
        for s in over:
            want[s] = 3.0 * size[s]
            left -= want[s]
            free.discard(s)
    want |= {s: weight[s] * level for s in free}
    assert target == pytest.approx(want)
    for s in order:
        assert abs(taken[s] - target[s]) <= largest[s] + 1e-6
    assert rows(got, "doc_id", "mix_repeats") == rows(mixing.mix(docs.repartition(3)), "doc_id", "mix_repeats")
    copies = mixing.mixed(docs)
    assert copies.columns == docs.columns and copies.count() == got.agg(F.sum("mix_repeats")).first()[0]


# -- op3


@pytest.fixture(scope="module")
def encoder():
    with open(RANK_FILE, "rb") as f:
        return bpe.Encoder(f.read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    with open(RANK_FILE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(encoder, reference):
    parts = ["a", "the", " ", "  ", "\n", "é", "日本", "🙂", "12", "'s", "!!", "ß", "\x1c", "\x85", "\xa0", "tion", "AB", "²", "̀", "<|endoftext|>"]
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(600)] + ["a" * 3000 + " " * 300 + "xyz" * 500, ""]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [reference.encode_ordinary(t) for t in texts]


def test_appends_and_edits_are_exact(encoder):
    v, rnd = encoder.vocabulary, random.Random(2)
    draw = lambda n: bytes(rnd.choice(b"aetionh sing\xc3\xa9") for _ in range(n))     # noqa: E731
    for _ in range(60):
        e = bpe.EncodedBytes(v, draw(rnd.randint(0, 300)))
        i = rnd.randint(0, len(e.data))
        e.replace(i, min(len(e.data), i + rnd.randint(0, 5)), draw(rnd.randint(0, 5)))
        e.append(draw(7))
        assert e.ids() == v.read_off(v.last_tokens(e.data, [-1])) and v.decode(e.ids()) == e.data


def test_bpe_documents(documents, odd, reference):
    for r in bpe.encode_documents(documents(odd), RANK_FILE, public_tokenizers.PATTERN).collect():
        assert bytes.fromhex(r["decoded_sha256"]) in {hashlib.sha256((t or "").encode()).digest() for i, t, _, _ in odd if i == r["doc_id"]}
        assert hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest() == r["ids_sha256"] and len(r["ids"]) == r["_n_tokens"]


# -- op4


@pytest.mark.parametrize("digests", [False, True])
def test_exact_duplicates(documents, odd, digests):
    docs = odd + [(50 + i, "x" * 100 + str(i // 2), None, None) for i in range(6)]
    groups = collections.defaultdict(list)
    for i, t, _, _ in docs:
        groups[low(t)].append(i)
    want = []
    for i, t, _, _ in docs:
        ids = groups[low(t)]
        keep = max((x for x in ids if x is not None), default=None)
        want.append((i, keep, len(ids), i == keep) + ((hashlib.sha256(low(t).encode()).hexdigest(),) if digests else ()))
    got = exact_dedup.exact_duplicates(documents(docs), digest_all=digests)
    assert rows(got, "doc_id", "keep_id", "group_size", "kept", *["text_sha256"] * digests) == sorted(want, key=repr)


# -- op5


def brute_lines(docs, least):
    """All runs of all lengths: later copies go."""
    first, gone, body = set(), {}, {}
    for i, t in sorted({(i, t) for i, t in docs if t is not None}, key=lambda x: (x[0] is None, x[0] or 0, x[1])):
        lines = [x for x in t.split("\n") if x.strip()]
        drop = set()
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if sum(len(WORD.findall(x)) for x in lines[a:b + 1]) >= least:
                    run = tuple(lines[a:b + 1])
                    if run in first:
                        drop.update(range(a, b + 1))
                    first.add(run)
        body[i, t] = [x for k, x in enumerate(lines) if k not in drop]
    return body


def test_line_dedup_equals_brute_force(documents):
    rnd = random.Random(4)
    line = lambda: " ".join([rnd.choice("abcdefgh")] * rnd.randint(1, 4))     # noqa: E731
    pool = [line() for _ in range(12)]
    docs = [(i, "\n".join(rnd.choice(pool + [""]) for _ in range(rnd.randint(0, 14)))) for i in range(60)] + [(99, None), (98, "")]
    got = line_dedup.dedup_lines(documents([(i, t, None, None) for i, t in docs]), min_words=6).collect()
    want = brute_lines(docs, 6)
    assert len(got) == len(docs)
    for r, t in ((r, dict(docs)[r["doc_id"]]) for r in got):
        if t is None:
            assert r["text"] is None
        else:
            assert [x for x in r["text"].split("\n") if x.strip()] == want[r["doc_id"], t]


def test_line_dedup_odd_rows(documents, odd):
    passage = "a passage of more than twenty words that stands in several documents and is found again in each of them with no change at all"
    docs = odd + [(30, f"{passage}\nown line", None, None), (31, f"start\n\n{passage}\n\nend", None, None), (32, passage + "\n" + passage, None, None)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(documents(docs)).collect() if r["doc_id"] and r["doc_id"] >= 30}
    assert got == {30: f"{passage}\nown line", 31: "start\n\nend", 32: ""}


# -- op6


def test_best_path_equals_brute_force():
    draw = np.random.default_rng(0)
    for sizes in ([4, 0, 1, 6], [1], [], [5, 5]):
        first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        scores = draw.normal(size=(first[-1], 3)).astype(np.float32) * 3
        got = language.best_path(scores, first, 2.0)
        for a, b in zip(first[:-1], first[1:]):
            import itertools
            value = lambda p: sum(scores[a + t, x] for t, x in enumerate(p)) - 2.0 * sum(x != y for x, y in zip(p, p[1:]))
            if b > a:
                assert value(tuple(got[a:b])) == pytest.approx(max(map(value, itertools.product(range(3), repeat=b - a))), abs=1e-4)


def test_language_spans_and_accuracy(spark, sf, documents, odd):
    docs = shared.read(spark, sf, "documents")
    model = language.learn(docs.where(toxicity.fold("doc_id", 4) != 2))
    held = language.identify(docs.where(toxicity.fold("doc_id", 4) == 2), model)
    assert held.where("lang_pred = lang").count() / held.count() > 0.95
    texts = {r["lang"]: " ".join(r["text"].split()[:40]) for r in docs.where("n_chars > 500").collect()}
    mixed = language.identify(documents([(1, texts["de"] + " " + texts["es"], None, None), (2, None, None, None), (3, "12 !", None, None)]), model)
    out = {r["doc_id"]: r for r in mixed.collect()}
    assert {"de", "es"} <= {s["lang"] for s in out[1]["spans"]} and len(out[1]["spans"]) <= 6
    assert [(out[i]["_lang_pred"], out[i]["_score"]) for i in (2, 3)] == [("und", 0.0)] * 2
    assert language.identify(documents(odd), language.learn(documents(odd))).count() == len(odd)
    assert {r["_lang_pred"] for r in language.identify(documents(odd), language.learn(documents([]))).collect()} == {"und"}


# -- op7


def test_licences(documents, odd):
    mit = next(t for n, t in licenses.KNOWN if n == "MIT" and len(t) > 500)
    docs = odd + [(40, "Copyright (c) 2020 Somebody\n\n" + mit.replace(",", " ;\n").upper(), None, None), (41, "Licenced under the MIT licence!", None, None),
                  (42, "x\nReleased under the MIT License.\ny", None, None), (43, mit + " and more", None, None)]
    got = licenses.scan(documents(docs))
    assert rows(got, "doc_id", "license_id", "scope", "matches") == [(40, "MIT", "text", 1), (41, "MIT", "text", 1), (42, "MIT", "line", 1)]


def test_licences_by_canonical_form_only(spark, documents):
    """No filter on the spelling of the raw text."""
    text = next(t for n, t in licenses.KNOWN if n == "Unlicense")
    between = ["\n", "  ", "\t", "-", "\nCopyright (c) 2020 Somebody\n"]
    docs = [(i, text.replace("public domain", f"public{b}domain"), None, None) for i, b in enumerate(between)]
    docs.append((9, "x\n" + text.replace("public domain", "public--domain") + "\ny", None, None))
    got = licenses.scan(documents(docs))
    assert rows(got, "doc_id", "license_id", "scope") == [*[(i, "Unlicense", "text") for i in range(len(between))], (9, "Unlicense", "line")]
    known = spark.createDataFrame([("Own", "(c) 2020 Permission of Somebody\nThis is free software, as is")], "license_id string, text string")
    docs = [(1, "This is free\nsoftware as is", None, None), (2, "this is FREE software: as is!", None, None)]
    assert rows(licenses.scan(documents(docs), known), "doc_id", "license_id", "scope") == [(1, "Own", "text"), (2, "Own", "text")]


# -- op8


def brute_near(docs, whole):
    sets = []
    for i, t in docs:
        w = WORD.findall(low(t))
        sets.append((i, frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= whole * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        r = root(k)
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    out = []
    for k, (i, s) in enumerate(sets):
        c = i if not s else least[root(k)]
        out.append((i, len(s), c, i == c))
    return sorted(out, key=repr)


@pytest.mark.parametrize("small,block", [(32, 150_000), (2, 700)])
def test_near_duplicates_equal_brute_force(documents, odd, monkeypatch, small, block):
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", block)
    rnd = random.Random(5)
    docs = [(i, t) for i, t, _, _ in odd if i not in (4,)]
    for g in range(6):
        base = [f"w{rnd.randint(0, 10 ** 6)}" for _ in range(80)]
        for c in range(14):
            w = list(base)
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(80)] = f"x{rnd.randint(0, 10 ** 6)}"
            docs.append((1000 - 20 * g - c, " ".join(w)))
    got = minhash.near_duplicates(documents([(i, t, None, None) for i, t in docs]))
    assert rows(got, "doc_id", "n_shingles", "component_id", "kept") == brute_near(docs, 85)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in shared.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 160)}}


# -- op9


def test_search_recall_and_rules(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(3000, 16))
    x[1500:2200] = x[1500]      # one very common vector
    data = [(i, [float(z) for z in v]) for i, v in enumerate(x)]
    bad = [(5000, None), (5100, [0.0] * 16), (5200, [1.0] * 15 + [None]), (5300, [float("nan")] * 16), (5400, [1.0] * 3), (5500, []), (None, [1.0] * 16)]
    df = spark.createDataFrame(data + bad, "vec_id long, embedding array<double>").withColumn("id", F.lit("x"))
    got = collections.defaultdict(list)
    for r in ann.search(df, F.col("id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 3000, 100))
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(3000), d)) if i != q][:10]
        hit += len({i for _, i, _ in found} & set(want))
        assert [r for r, _, _ in found] == list(range(1, 11)) and [s for *_, s in found] == [d[i] for _, i, _ in found]
    assert hit / (10 * len(got)) >= 0.9
    few = ann.search(df.where("vec_id < 4"), F.col("id") % 100 == 0)
    assert few.count() == 3 and ann.search(df.where("false"), F.col("id") % 100 == 0).count() == 0


# -- op10


def test_toxicity_samples_ids_not_rows(spark, documents, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda offsets, words, confirmed, prior: seen.append((len(offsets) - 1, int(confirmed.sum()))))
    docs = documents([(i, f"some text {i}", None, None) for i in range(60)] + [(i, f"copy {c}", None, None) for i in range(30) for c in range(40)])
    labels = spark.createDataFrame([(i, int(i < 5)) for i in range(60)], "doc_id bigint, toxic int")
    toxicity.fit(docs, labels, F.lit(True), positives=5, unlabelled=50)
    toxicity.fit(docs, labels, F.lit(True), positives=5, unlabelled=60)
    assert 50 <= seen[0][0] <= 55 and seen[0][1] == 5 and seen[1] == (60, 5)


def test_toxicity_held_out(spark, documents, odd):
    docs = shared.read(spark, "/root/testdata/sf0.1", "documents")
    labels = shared.read(spark, "/root/testdata/sf0.1", "labels")
    held = toxicity.fold("doc_id", 5) == 0
    model = toxicity.fit(docs, labels, ~held)
    got = toxicity.scored(docs.where(held), model).join(labels, "doc_id").select("score", "toxic").toPandas()
    hit = (got.score >= 0.5) & (got.toxic == 1)
    assert hit.sum() / (got.toxic == 1).sum() > 0.8 and hit.sum() / (got.score >= 0.5).sum() > 0.8
    out = toxicity.scored(documents(odd), model)
    assert out.count() == len(odd) and out.where("_score between 0 and 1 and score = 'x'").count() == len(odd)
    none = toxicity.fit(docs, labels.where("toxic = 0"), ~held)
    assert toxicity.scored(documents(odd), none, name="s").select("s").distinct().count() == 1


# -- all


def test_empty_tables(documents):
    e = documents([])
    assert pii.pseudonymise(e, b"k").count() == mixing.mix(e).count() == mixing.mixed(e).count() == 0
    assert bpe.encode_documents(e, RANK_FILE, public_tokenizers.PATTERN).count() == exact_dedup.exact_duplicates(e).count() == 0
    assert line_dedup.dedup_lines(e).count() == licenses.scan(e).count() == minhash.near_duplicates(e).count() == 0


def test_queries_against_sql(spark, sf):
    con = connect(sf)
    for name, (run, sql) in QUERIES.items():
        if sql:
            assert compare(run(spark, sf), con, sql) == "", name


def test_pipeline(spark, sf):
    """Each stage against its rule, on its own input."""
    docs = shared.read(spark, sf, "documents")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, at = at, corpus_pipeline.materialize(stage(spark, at, sf), f"test-{name}")
        assert at.columns == docs.columns
        old, new = {r["doc_id"]: r for r in before.collect()}, at.collect()
        assert {r["doc_id"] for r in new} <= set(old)
        if name == "toxicity":
            toxic = {r[0] for r in shared.read(spark, sf, "labels").where("toxic = 1").collect()}
            assert all(r["text"] == old[r["doc_id"]]["text"] for r in new) and len(set(old) - {r["doc_id"] for r in new} - toxic) < 0.3 * len(old)
        if name == "line_dedup":
            want = brute_lines([(i, r["text"]) for i, r in old.items()], line_dedup.MIN_WORDS)
            assert {r["doc_id"]: [x for x in r["text"].split("\n") if x.strip()] for r in new} == {i: v for (i, t), v in want.items() if v or not t.strip()}
        if name == "near_duplicates":
            want = {i for i, _, _, kept in brute_near([(i, r["text"]) for i, r in old.items()], 80) if kept}
            assert {r["doc_id"] for r in new} == want
        if name == "source_mix":
            assert max(collections.Counter(r["doc_id"] for r in new).values()) <= 3
    out = corpus_pipeline.STAGES[-1][1](spark, at, sf)
    texts = collections.Counter(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in at.collect())
    assert collections.Counter(r["decoded_sha256"] for r in out.collect()) == texts


def test_folds(documents):
    got = documents([(i, None, None, None) for i in (0, 17, 123456)]).select("doc_id", toxicity.fold("doc_id", 5).alias("f")).collect()
    assert [r["f"] for r in got] == [zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in got]
