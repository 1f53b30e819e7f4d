"""Long repeated byte strings, found with a run-length index and cut out: suffix-array dedup for repetitive corpora.

A byte goes when a string of ``length`` bytes that covers it starts anywhere else too, in this text or another. All strings are judged on
the input, so every copy of a repeated string goes, the first one included. Matches never cross texts.

1. *Anchors.* Each start is assigned the smallest 16-byte hash among the next ``widths[0]`` places, which depends on nothing outside its
   string: equal strings have their anchor at the same distance d. A start and its anchor are ``left_d . middle . right``, the middle
   having ``length - widths[0]`` bytes. Only anchors whose middle occurs twice can have a repeat; counts of 64-bit hashes find these.
2. *Contexts.* Such an anchor becomes a string: the bytes before it, one symbol for its middle, the bytes after it. Equal contexts are one
   string with a multiplicity, so copies add to the length of a run and to nothing else.
3. *Index.* The contexts of a bounded bucket of middles get a run-compressed Burrows-Wheeler transform (``RunIndex``): starting from the order
   of what follows the middles, each backward step is a stable sort by the preceding byte. Where neighbours share that byte they stay
   neighbours and their common prefix grows by one; so only the two ends of every run keep a sample.
4. *Matching statistics* stream from these samples: the longest match of each start with any other place. ``length`` or more marks it.
5. A middle with more than ``most`` contexts is refined first: its starts are dealt out by middles that are longer by whole blocks of starts
   (``widths[1:]``), until at width 1 the middle and a byte are the whole string and no middle has more than 256 contexts.

Texts without a mark are never shuffled; the others meet their cuts by a digest of the text.

Defined results: a null text counts as empty; texts shorter than ``length`` stay whole; very long texts are worked on in pieces of 1 MB that
overlap; repeated rows are texts of their own, so all of their bytes go from ``length`` bytes on; ids may be null or repeat, rows keep theirs;
an empty table gives an empty result; output columns that clash with columns of ``docs`` get underscores in front. There are no ties to break.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .kernel import as_bytes, mix
from .shared import free_name, may_hold, quoted, without

LENGTH = 400
WIDTHS = (128, 16, 1)       # powers of two, each a multiple of the next
SEED = 16                   # bytes of the hash that selects anchors
MOST = 16_384               # contexts of one middle in one task
BUCKET = 8_192              # contexts of one bucket, on average
PIECE = 1 << 20
MAX_BITS = 1 << 28          # 32 MB at most


# -- anchors


def anchors(buf: np.ndarray, offs: np.ndarray, length: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, last start) for each stretch of starts that share an anchor, in the texts of ``buf``."""
    n = len(buf)
    if n < length:
        return (np.zeros(0, np.int64),) * 3
    words = np.ndarray((n - 7,), "<u8", buf, 0, (1,))       # 8 bytes from each place on
    seeds = mix(words[:n - SEED + 1] * np.uint64(0x9E3779B97F4A7C15) ^ np.roll(words, -(SEED - 8))[:n - SEED + 1] * np.uint64(0x94D049BB133111EB))
    low = np.uint64(0xFFFFFFFF)
    best = (seeds & ~low) | (low - np.arange(len(seeds), dtype=np.uint64))      # of equal hashes the last place
    step = 1
    while step < width:
        best = np.minimum(best[:-step], best[step:])
        step *= 2
    at = (low - (best[:n - length + 1] & low)).astype(np.int64)
    for end in offs[1:]:
        at[max(0, end - length + 1):end] = -1       # strings that would cross the end of a text
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    last = np.concatenate([first[1:], [len(at)]]) - 1
    real = at[first] >= 0
    return at[first][real], first[real], last[real]


def _pieces(texts: pa.Array, length: int):
    """(bytes, offsets, row of each text, place of its first byte): whole texts of about PIECE bytes together, or a piece of a longer one."""
    buf, offs = as_bytes(texts)
    row, n = 0, len(offs) - 1
    while row < n:
        if offs[row + 1] - offs[row] > PIECE:
            for at in range(int(offs[row]), int(offs[row + 1]) - length + 1, PIECE):
                end = min(at + PIECE + length - 1, int(offs[row + 1]))
                yield buf[at:end], np.array([0, end - at]), np.array([row]), np.array([at - offs[row]])
            row += 1
            continue
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + PIECE, "right")) - 1)
        yield buf[offs[row]:offs[end]], offs[row:end + 1] - offs[row], np.arange(row, end), np.zeros(end - row, np.int64)
        row = end


def _middles(texts: DataFrame, length: int, width: int) -> DataFrame:
    """(key): a 64-bit hash of each anchor's middle, one row for each anchor."""
    middle = length - width

    def run(batches):
        for b in batches:
            for buf, offs, _, _ in _pieces(b.column("text"), length):
                view = memoryview(np.ascontiguousarray(buf))
                at, _, _ = anchors(buf, offs, length, width)
                keys = np.fromiter((xxhash.xxh3_64_intdigest(view[a:a + middle]) for a in at.tolist()), np.uint64, len(at))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], names=["key"])

    return texts.mapInArrow(run, "key bigint")


def _bitmap(keys: DataFrame, n: int) -> tuple[bytes, int]:
    """A hashed bitmap of ``keys`` (column key), 16 bits for each of ``n`` but MAX_BITS at most, beyond which it lets more through."""
    bits = 1 << 18
    while bits < min(16 * n, MAX_BITS):
        bits *= 2
    block = 32768
    rows = (keys.select(F.expr(f"key & {bits - 1}").alias("h")).groupBy(F.shiftright("h", 15).alias("no"))
            .agg(F.expr(f"bitmap_construct_agg(h % {block})").alias("bits")).toArrow())
    out = np.zeros((bits // block, block // 8), np.uint8)
    for no, held in zip(rows.column("no").to_pylist(), rows.column("bits").to_pylist()):
        out[no] = np.frombuffer(held, np.uint8)
    return out.tobytes(), bits


# -- contexts

_CONTEXT = "mid binary, ctx binary, behind binary, ahead binary, m bigint"
_PLACED = _CONTEXT + ", h1 bigint, h2 bigint, a bigint"


def _context_key(middle: bytes, behind: bytes, ahead: bytes) -> bytes:
    return xxhash.xxh3_128_digest(middle + len(behind).to_bytes(4, "little") + behind + ahead)


def _contexts(texts: DataFrame, length: int, width: int, bitmap: bytes, bits: int) -> DataFrame:
    """One row for each anchor whose middle may occur again, in each distinct text of a batch: the text's digest (h1, h2), the anchor's place a,
    the middle's digest, the bytes ``behind`` it back to the first start and ``ahead`` of the middle, and how many rows of the batch hold the text."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)
    middle = length - width

    def run(batches):
        held = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            h1, h2 = (b.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2"))
            _, one, copies = np.unique(np.stack([h1, h2]), axis=1, return_index=True, return_counts=True)
            texts_once = b.column("text").take(pa.array(one))
            for buf, offs, row, base in _pieces(texts_once, length):
                data = np.ascontiguousarray(buf).tobytes()
                at, first, last = anchors(buf, offs, length, width)
                keys = np.fromiter((xxhash.xxh3_64_intdigest(data[a:a + middle]) for a in at.tolist()), np.uint64, len(at)) & np.uint64(bits - 1)
                some = (held[keys >> np.uint64(3)] >> (keys & np.uint64(7)).astype(np.uint8)) & 1 == 1
                at, first, last = at[some], first[some], last[some]
                text = np.searchsorted(offs, at, "right") - 1
                mids = [xxhash.xxh3_128_digest(data[a:a + middle]) for a in at.tolist()]
                behind = [data[f:a] for f, a in zip(first.tolist(), at.tolist())]
                ahead = [data[a + middle:z + length] for a, z in zip(at.tolist(), last.tolist())]
                who = one[row[text]]
                yield pa.RecordBatch.from_arrays([
                    pa.array(mids, pa.binary()), pa.array(list(map(_context_key, mids, behind, ahead)), pa.binary()), pa.array(behind, pa.binary()),
                    pa.array(ahead, pa.binary()), pa.array(copies[row[text]]), pa.array(h1[who]), pa.array(h2[who]), pa.array(at - offs[text] + base[text])],
                    names=["mid", "ctx", "behind", "ahead", "m", "h1", "h2", "a"])

    return texts.mapInArrow(run, _PLACED)


def _refined(contexts: DataFrame, width: int, finer: int) -> DataFrame:
    """The contexts of hot middles by blocks of ``finer`` starts: (parent, off, ...) with the middle longer by the block's distance on both sides."""
    def run(batches):
        for b in batches:
            rows = []
            for mid, ctx, behind, ahead, m in zip(*[b.column(c).to_pylist() for c in ("mid", "ctx", "behind", "ahead", "m")]):
                far, near = len(behind), width - len(ahead)
                for off in range(near // finer * finer, far + 1, finer):
                    top, bottom = min(far - off, finer - 1), max(near - off, 0)
                    own = width - finer - off
                    middle = xxhash.xxh3_128_digest(mid + off.to_bytes(4, "little") + behind[far - off:] + ahead[:own])
                    back, on = behind[far - off - top:far - off], ahead[own:own + finer - bottom]
                    rows.append((ctx, off, middle, _context_key(middle, back, on), back, on, m))
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["parent", "off", "mid", "ctx", "behind", "ahead", "m"])

    return contexts.mapInArrow(run, "parent binary, off int, " + _CONTEXT)


# -- the index


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of context strings, with samples at both ends of every run.

    Level d holds, in suffix order, the suffixes that start d bytes before their middle. Suffixes of other levels cannot stand between two that
    share more than d symbols, as a middle is a symbol of its own; so a level is a whole interval of the transform where it matters here.
    ``levels[d]`` has the run ends that are new at d: (members at heads, their common bytes after the middle with the suffix before them, members
    at tails, the same with the suffix after them); -1 where the symbols before or at the middle differ. Inside a run nothing is kept.
    """

    def __init__(self, middles: list[bytes], behind: list[bytes], ahead: list[bytes]):
        n = len(middles)
        self.far = np.fromiter(map(len, behind), np.int64, n)
        lengths = np.fromiter(map(len, ahead), np.int64, n)
        order = np.array(sorted(range(n), key=lambda i: (middles[i], ahead[i])), np.int64)
        back = np.zeros((n, int(self.far.max(initial=0)) + 1), np.uint8)
        for i, x in enumerate(behind):
            back[i, :len(x)] = np.frombuffer(x, np.uint8)[::-1]
        on = np.zeros((n, int(lengths.max(initial=0)) + 1), np.uint8)
        for i, x in enumerate(ahead):
            on[i, :len(x)] = np.frombuffer(x, np.uint8)
        a, b = order[:-1], order[1:]
        differ = on[a] != on[b]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), on.shape[1]) if n > 1 else np.zeros(0, np.int64)
        common = np.minimum(common, np.minimum(lengths[a], lengths[b]))
        group = np.zeros(n, np.int64)
        group[order[1:]] = np.cumsum([middles[x] != middles[y] for x, y in zip(a.tolist(), b.tolist())])
        self._ranges(common)
        self.place = np.empty(n, np.int64)
        self.place[order] = np.arange(n)
        self.levels, self.runs = [], 0
        joined = np.zeros(n, bool)      # neighbours in this order were neighbours one level before, of the same preceding byte
        for d in range(back.shape[1]):
            if d:
                stay = self.far[order] >= d
                was = np.flatnonzero(stay)
                order = order[was]
                byte = back[order, d - 1]
                by = np.argsort(byte, kind="stable")        # the backward step
                order, byte, was = order[by], byte[by], was[by]
                joined = np.zeros(len(order), bool)
                joined[1:] = (was[1:] == was[:-1] + 1) & (byte[1:] == byte[:-1])
                change = np.ones(len(order), bool)
                change[1:] = (byte[1:] != byte[:-1]) | (group[order[1:]] != group[order[:-1]])
                group[order] = np.cumsum(change)
            if not len(order):
                break
            heads = np.flatnonzero(~joined)
            tails = np.flatnonzero(~np.concatenate([joined[1:], [False]]))
            self.runs += len(heads)
            self.levels.append((order[heads], self._common(order, heads, group), order[tails], self._common(order, tails + 1, group)))

    def _ranges(self, common: np.ndarray) -> None:
        self.least = [common]
        step = 1
        while 2 * step <= len(common):
            x = self.least[-1]
            self.least.append(np.minimum(x[:-step], x[step:]))
            step *= 2

    def _common(self, order: np.ndarray, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Bytes after the middle that the suffix at each place of ``order`` shares with the one before it, by a range minimum."""
        out = np.full(len(at), -1, np.int64)
        inner = np.flatnonzero((at > 0) & (at < len(order)))
        x, y = order[at[inner] - 1], order[at[inner]]
        same = group[x] == group[y]
        inner, lo, hi = inner[same], self.place[x[same]], self.place[y[same]]
        if len(inner):
            k = np.frexp((hi - lo).astype(np.float64))[1] - 1
            for level in np.unique(k):
                these = k == level
                row = self.least[level]
                out[inner[these]] = np.minimum(row[lo[these]], row[hi[these] - (1 << int(level))])
        return out

    def matching_statistics(self):
        """For d = 0, 1, ...: (members, bytes after the middle) of each suffix's longest match with another string, streamed from the samples."""
        before = np.full(len(self.far), -1, np.int64)
        after = np.full(len(self.far), -1, np.int64)
        for d, (heads, with_before, tails, with_after) in enumerate(self.levels):
            before[heads], after[tails] = with_before, with_after
            members = np.flatnonzero(self.far >= d)
            yield members, np.maximum(before[members], after[members])


def _marks(contexts: DataFrame, width: int, bucket: int) -> DataFrame:
    """(ctx, nearest, farthest): the distances of the nearest and farthest start of each context that occurs elsewhere too."""
    n = max(1, -(-contexts.count() // bucket))
    dealt = contexts.withColumn("no", F.pmod(F.xxhash64("mid"), F.lit(n)))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        behind, ahead = table.column("behind").to_pylist(), table.column("ahead").to_pylist()
        index = RunIndex(table.column("mid").to_pylist(), behind, ahead)
        near = width - np.fromiter(map(len, ahead), np.int64, len(ahead))
        several = table.column("m").to_numpy() > 1      # the next suffix of the run is a copy of the whole string
        nearest, farthest = np.full(len(near), width), np.full(len(near), -1)
        for d, (members, common) in enumerate(index.matching_statistics()):
            found = members[(several[members] | (common >= width - d)) & (near[members] <= d)]
            nearest[found] = np.minimum(nearest[found], d)
            farthest[found] = d
        some = farthest >= 0
        keep = pa.array(np.flatnonzero(some))
        return pa.table({"ctx": table.column("ctx").take(keep), "nearest": pa.array(nearest[some].astype(np.int32)),
                         "farthest": pa.array(farthest[some].astype(np.int32))})

    return dealt.groupBy("no").applyInArrow(run, "ctx binary, nearest int, farthest int")


def _distinct(rows: DataFrame) -> DataFrame:
    return rows.groupBy("mid", "ctx", "behind", "ahead").agg(F.sum("m").alias("m"))


def repeated_ranges(texts: DataFrame, length: int = LENGTH, widths: tuple[int, ...] = WIDTHS, most: int = MOST, bucket: int = BUCKET) -> DataFrame:
    """(h1, h2, ranges): per text digest the byte ranges (first, end) that repeated strings cover. ``texts`` has h1, h2 and text."""
    if widths[-1] != 1 or any(a % b for a, b in zip(widths, widths[1:])) or widths[0] + SEED - 1 > length:
        raise ValueError("widths must end in 1, each a multiple of the next, and leave room for an anchor")
    long_enough = texts.where(F.octet_length("text") >= length)
    often = materialize(_middles(long_enough, length, widths[0]).groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "middles")
    bitmap, bits = _bitmap(often, often.count())
    placed = materialize(_contexts(long_enough, length, widths[0], bitmap, bits), "contexts")
    contexts = materialize(_distinct(placed), "distinct")
    links, found = None, []
    for level, width in enumerate(widths):
        finer = widths[level + 1] if level + 1 < len(widths) else None
        hot = None
        if finer:
            hot = materialize(contexts.groupBy("mid").agg(F.count("*").alias("c")).where(F.col("c") > most).select(F.col("mid").alias("k")), "hot")
            hot = hot if hot.limit(1).count() else None
        cool = without(contexts, F.col("mid"), hot) if hot is not None else contexts
        marks = materialize(_marks(cool, width, bucket), "marks")
        if links is None:
            found.append(marks)
        else:
            found.append(links.join(marks.withColumnRenamed("ctx", "c"), F.col("ctx") == F.col("c")).select(
                F.col("root").alias("ctx"), (F.col("off") + F.col("nearest")).alias("nearest"), (F.col("off") + F.col("farthest")).alias("farthest")))
        if hot is None:
            break
        parts = materialize(_refined(contexts.join(hot, F.col("mid") == F.col("k")).drop("k"), width, finer), "refined")
        if links is None:
            links = parts.select(F.col("parent").alias("root"), "off", "ctx")
        else:
            up = links.select("root", F.col("off").alias("o"), F.col("ctx").alias("p"))
            links = parts.join(up, F.col("parent") == F.col("p")).select("root", (F.col("o") + F.col("off")).alias("off"), "ctx")
        links = materialize(links, "links")
        contexts = materialize(_distinct(parts), "distinct")
    marks = found[0]
    for more in found[1:]:
        marks = marks.unionByName(more)
    if len(found) > 1:
        marks = materialize(marks.groupBy("ctx").agg(F.min("nearest").alias("nearest"), F.max("farthest").alias("farthest")), "marks")
    # All starts of a context lie within one string of each other, so what they cover is one range.
    covered = placed.select("h1", "h2", "a", F.col("ctx").alias("c")).join(marks, F.col("c") == F.col("ctx")).select(
        "h1", "h2", F.struct((F.col("a") - F.col("farthest")).alias("first"), (F.col("a") - F.col("nearest") + length).alias("end")).alias("range"))
    return covered.groupBy("h1", "h2").agg(F.collect_set("range").alias("ranges"))     # one text's anchors


def _merged(ranges: list[dict]) -> np.ndarray:
    """The ranges as ascending disjoint (first, end) rows."""
    firsts = np.sort(np.array([r["first"] for r in ranges], np.int64))
    ends = np.sort(np.array([r["end"] for r in ranges], np.int64))
    apart = np.concatenate([[True], firsts[1:] > ends[:-1]])       # so many ranges have ended as have begun
    return np.stack([firsts[apart], ends[np.concatenate([apart[1:], [True]])]], axis=1)


OUTPUT = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def cut_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, widths: tuple[int, ...] = WIDTHS, most: int = MOST, bucket: int = BUCKET,
                keep_text: bool = True) -> DataFrame:
    """``docs`` plus n_bytes, n_removed, n_spans and kept_sha256; the text column holds what is left, as binary (a cut may fall inside a
    character), or is dropped without ``keep_text``."""
    h1, h2, flag, ranges = (free_name(docs, x) for x in ("_h1", "_h2", "_held", "_ranges"))
    body = F.coalesce(quoted(text), F.lit(""))
    hashed = docs.withColumn(text, body).withColumn(h1, F.xxhash64(quoted(text))).withColumn(h2, F.xxhash64(F.lit("second"), quoted(text)))
    found = materialize(repeated_ranges(hashed.select(quoted(h1).alias("h1"), quoted(h2).alias("h2"), quoted(text).alias("text")),
                                        length, widths, most, bucket), "ranges")
    held = may_hold(hashed, F.xxhash64(quoted(h1), quoted(h2)), found.select(F.xxhash64("h1", "h2").alias("k")), flag)
    names = [free_name(docs, x) for x in OUTPUT]
    kept = [c for c in docs.columns if keep_text or c != text]
    whole = [F.octet_length(quoted(text)).cast("bigint"), F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), F.sha2(quoted(text).cast("binary"), 256)]
    same = held.where(~quoted(flag)).select(*[(quoted(c).cast("binary") if c == text else quoted(c)).alias(c) for c in kept],
                                            *[x.alias(n) for x, n in zip(whole, names)])
    by = found.select(F.col("h1").alias(free_name(hashed, "_r1")), F.col("h2").alias(free_name(hashed, "_r2")), F.col("ranges").alias(ranges))
    maybe = held.where(quoted(flag)).join(by, (quoted(h1) == quoted(by.columns[0])) & (quoted(h2) == quoted(by.columns[1])), "left").select(
        *[quoted(c) for c in docs.columns], quoted(ranges))

    def run(batches):
        for b in batches:
            out = []
            for data, r in zip(b.column(text).cast(pa.large_binary()).to_pylist(), b.column(ranges).to_pylist()):
                spans = _merged(r) if r else np.zeros((0, 2), np.int64)
                edges = [0, *spans.ravel().tolist(), len(data)]
                rest = b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2]))
                out.append((rest if keep_text else None, len(data), len(data) - len(rest), len(spans), hashlib.sha256(rest).hexdigest()))
            rest, *figures = zip(*out) if out else ((),) * 5
            columns = [pa.array(rest, pa.binary()) if c == text else b.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(x, pa.int64()) for x in figures[:3]], pa.array(figures[3], pa.string())],
                                             names=[*kept, *names])

    return same.unionByName(maybe.mapInArrow(run, same.schema))
