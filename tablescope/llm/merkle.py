"""Merkle manifest of a table: a digest tree whose altered versions share every untouched node.

Each row is a leaf. Per group (``lang``) the leaves stand in the order of their key, every ``fan`` consecutive nodes become one, and what remains is
the group's subroot; the subroots give the root in the same way. The tree is built in *stories* of ``DEPTH`` levels: an aligned block of
fan ** DEPTH nodes is worked on by one task, its top is a node of the next story. Going up, stories hand on one digest for each block. Going
down, each block gets the path of its top: the siblings on the left and on the right at every level above it, a few kilobytes however large
the table is.

A block is a persistent tree (``Block``): an altered leaf makes a version that copies the leaf's ancestors inside the block and shares all other
nodes. Above the block the version goes on along the block's path, so versions of different blocks never meet and no task sees another's nodes.

Digests are lowercase hex SHA-256 over the concatenated text of what they cover. A leaf covers its fields in turn, each ``-`` if null, else the
number of its UTF-8 bytes, ``:`` and the value.

Defined results: nulls are fields like others; a null group is a group of its own and comes first; null keys come first in their group and are
not altered by the query's rule; empty texts are fields of 0 bytes; long texts are hashed where they are read and never shuffled; rows that
share a key stand in the order of their leaves, and repeated rows are leaves of their own (which of them stands first makes no difference); an
empty table gives an empty result; only the named fields are read, so further columns change nothing, whatever their names.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .exact_dedup import LOWER, UPPER
from .shared import dense_ranks, quoted

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 8
DEPTH = 4


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def _field(value: Column) -> Column:
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(_field, columns)), 256)


class Block:
    """``depth`` levels over some consecutive nodes. ``levels[0]`` are the nodes, ``levels[-1]`` is the single top."""

    def __init__(self, nodes: list[str], fan: int, depth: int):
        self.fan, self.levels = fan, [nodes]
        for _ in range(depth):
            below = self.levels[-1]
            self.levels.append([digest(*below[i:i + fan]) for i in range(0, len(below), fan)])

    @property
    def top(self) -> str:
        return self.levels[-1][0]

    def path(self, at: int) -> list[tuple[str, str]]:
        """(left, right): the siblings of a node and of each of its ancestors, concatenated."""
        out = []
        for nodes in self.levels[:-1]:
            run = at - at % self.fan
            out.append(("".join(nodes[run:at]), "".join(nodes[at + 1:run + self.fan])))
            at //= self.fan
        return out

    def version(self, at: int, node: str) -> list[str]:
        """The copied nodes of the version that has ``node`` at place ``at``: itself and its ancestors, up to the new top."""
        return fold(node, self.path(at))


def fold(node: str, path: list[tuple[str, str]]) -> list[str]:
    """``node`` and its ancestors along ``path``."""
    out = [node]
    for left, right in path:
        out.append(digest(left, out[-1], right))
    return out


def _levels(n: int, fan: int) -> int:
    depth = 0
    while n > 1:
        n, depth = -(-n // fan), depth + 1
    return depth


def _tops(nodes: DataFrame, fan: int, depth: int) -> DataFrame:
    """(g, pos, n, node): the tops of the blocks of ``nodes`` (g, pos, n, node), n nodes in group g."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        n, block = table.column("n")[0].as_py(), table.column("block")[0].as_py()
        top = Block(table.column("node").to_pylist(), fan, min(depth, _levels(n, fan))).top
        return pa.table({"g": table.column("g")[:1], "pos": pa.array([block], pa.int64()), "n": pa.array([-(-n // fan ** depth)], pa.int64()), "node": [top]})

    dealt = nodes.withColumn("block", F.floor(F.col("pos") / fan ** depth))
    return dealt.groupBy("g", "block").applyInArrow(run, "g bigint, pos bigint, n bigint, node string")


_PATH = "array<struct<left:string,right:string>>"


def _paths(nodes: DataFrame, above: DataFrame | None, fan: int, depth: int) -> DataFrame:
    """(g, pos, path): the siblings of each node up to the top of its group's tree. ``above`` has those of the story above."""
    def run(table: pa.Table, over: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        block = Block(table.column("node").to_pylist(), fan, min(depth, _levels(table.column("n")[0].as_py(), fan)))
        rest = over.column("path")[0].as_py() if over.num_rows else []
        paths = [[{"left": a, "right": z} for a, z in block.path(i)] + rest for i in range(table.num_rows)]
        return pa.table({"g": table.column("g"), "pos": table.column("pos"),
                         "path": pa.array(paths, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))})

    dealt, out = nodes.withColumn("block", F.floor(F.col("pos") / fan ** depth)), f"g bigint, pos bigint, path {_PATH}"
    if above is None:
        return dealt.groupBy("g", "block").applyInArrow(lambda table: run(table, table.slice(0, 0)), out)
    return dealt.groupBy("g", "block").cogroup(above.withColumnRenamed("pos", "block").groupBy("g", "block")).applyInArrow(run, out)


def _stories(nodes: DataFrame, largest: int, fan: int, depth: int) -> list[DataFrame]:
    """``nodes``, the tops of its blocks, the tops of theirs, ..., until each group has a single node; groups that have one go along."""
    out, size = [nodes], largest
    while size > 1:
        size = -(-size // fan ** depth)
        out.append(materialize(_tops(out[-1], fan, depth), "nodes"))
    return out


def manifest(docs: DataFrame, altered: tuple[Column, dict[str, Column]] | None = None, fields: tuple[str, ...] = FIELDS, group: str = "lang",
             key: str = "doc_id", fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified), one row for each row of ``docs``.

    ``altered`` is (condition, {field: new value}): where the condition holds, the version with the new leaf is folded up to ``folded_root`` with the
    original siblings; elsewhere the original leaf is. ``proof_sha256`` digests the siblings, level by level, left to right.
    """
    condition, changes = altered or (F.lit(False), {})
    kind = docs.schema[key].dataType.simpleString()
    plain = leaf([quoted(c) for c in fields])
    new = F.when(condition, leaf([changes.get(c, quoted(c)) for c in fields]))
    rows = docs.select(quoted(key).alias("k"), quoted(group).cast("string").alias("lang"), plain.alias("node"), new.alias("new"))
    ranked = materialize(dense_ranks(rows, ["lang", "k", "node"], "leaves"), "ranked")
    groups = ranked.groupBy("lang").agg(F.min("rank").alias("first"), F.count("*").alias("n"))
    groups = materialize(dense_ranks(groups, ["lang"], "groups").select(
        F.col("lang").alias("l"), "first", "n", F.col("rank").cast("bigint").alias("g")), "groups")
    count, largest = groups.agg(F.count("*"), F.max("n")).first()
    leaves = materialize(ranked.join(groups, F.col("lang").eqNullSafe(F.col("l"))).select(
        "g", (F.col("rank") - F.col("first")).alias("pos"), "n", "node", "new", "k"), "placed")
    stories = _stories(leaves.select("g", "pos", "n", "node"), largest or 0, fan, depth)
    # The subroots are the leaves of the last tree, in the order of their groups; each group's path to the root ends its leaves' paths.
    subroots = materialize(stories[-1].select("g", F.col("node").alias("subroot")), "subroots")
    last = _stories(subroots.select(F.lit(0).cast("bigint").alias("g"), (F.col("g") - 1).cast("bigint").alias("pos"), F.lit(count).cast("bigint").alias("n"),
                                    F.col("subroot").alias("node")), count, fan, depth)
    above = None
    for story in reversed(last[:-1]):
        above = _paths(story, above, fan, depth)
    top = last[-1].first()      # one row, none of an empty table
    ends = subroots.withColumn("root", F.lit(top and top["node"]).cast("string"))
    if above is not None:
        ends = ends.join(above.select((F.col("pos") + 1).alias("at"), "path"), F.col("g") == F.col("at")).drop("at")
    else:
        ends = ends.withColumn("path", F.array().cast(_PATH))
    ends = materialize(ends, "ends")
    above = ends.select("g", F.lit(0).cast("bigint").alias("pos"), "path")
    for story in reversed(stories[1:-1]):
        above = materialize(_paths(story, above, fan, depth), "paths")

    def prove(table: pa.Table, over: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        block = Block(table.column("node").to_pylist(), fan, min(depth, _levels(table.column("n")[0].as_py(), fan)))
        rest = [(p["left"], p["right"]) for p in over.column("path")[0].as_py()]
        beyond = "".join(a + z for a, z in rest)
        proofs, roots = [], []
        for at, (node, other) in enumerate(zip(block.levels[0], table.column("new").to_pylist())):
            proofs.append(digest(*[a + z for a, z in block.path(at)], beyond))
            roots.append(fold(block.version(at, other or node)[-1], rest)[-1])
        return pa.table({"k": table.column("k"), "g": table.column("g"), "leaf": table.column("node"), "proof_sha256": proofs, "folded_root": roots})

    dealt = leaves.withColumn("block", F.floor(F.col("pos") / fan ** depth))
    paths = above.withColumnRenamed("pos", "block")
    proven = dealt.groupBy("g", "block").cogroup(paths.groupBy("g", "block")).applyInArrow(
        prove, f"k {kind}, g bigint, leaf string, proof_sha256 string, folded_root string")
    return proven.join(ends.select(F.col("g").alias("at"), "subroot", "root"), F.col("g") == F.col("at")).select(
        F.col("k").alias(key), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def lowered(text: str = "text") -> Column:
    return F.translate(quoted(text), UPPER, LOWER)


def tampered(key: str = "doc_id", text: str = "text") -> tuple[Column, dict[str, Column]]:
    """Where 3 divides the CRC-32 of the key's text, the text is lower-cased in A-Z."""
    hit = F.crc32(quoted(key).cast("string").cast("binary")) % 3 == 0
    return F.coalesce(hit, F.lit(False)), {text: lowered(text)}


def manifest_sql(fan: int = FAN) -> str:
    """The same rows as DuckDB SQL: one recursion makes the levels of all groups, one those above the subroots, one folds every leaf upwards."""
    field = lambda c: f"coalesce(octet_length(encode({c}::varchar)) || ':' || {c}::varchar, '-')"      # noqa: E731
    plain = " || ".join(field(c) for c in FIELDS)
    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    other = " || ".join(field(lower if c == "text" else c) for c in FIELDS)
    return f"""
with recursive bits as (select i::ubigint as i, i::ubigint as c, 0 as k from range(256) t(i)
                        union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end, k + 1 from bits where k < 8),
crc as (select list(c order by i) as t from bits where k = 8),
hit as (select doc_id, xor(list_reduce(list_prepend(4294967295::ubigint, [ascii((doc_id::varchar)[j])::ubigint for j in range(1, length(doc_id::varchar) + 1)]),
                           lambda c, b: xor(t[((xor(c, b) & 255) + 1)::bigint], c >> 8)), 4294967295::ubigint) % 3 = 0 as hit from documents, crc),
rows_of as (select doc_id, lang, sha256({plain}) as leaf, case when hit then sha256({other}) end as new from documents left join hit using (doc_id)),
g_of as (select lang, row_number() over (order by lang nulls first) as g from (select distinct lang from documents)),
leaves as (select g, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by g) as n, doc_id, leaf, new
           from rows_of join g_of on rows_of.lang is not distinct from g_of.lang),
tree as (select 0 as level, g, pos, n, leaf as node from leaves
         union all
         select any_value(level) + 1, g, pos // {fan}, any_value((n + {fan - 1}) // {fan}), sha256(string_agg(node, '' order by pos))
         from tree where n > 1 group by g, pos // {fan}),
subroots as (select g, node as subroot, level as depth from tree where n = 1),
upper_tree as (select 0 as level, g - 1 as pos, count(*) over () as n, subroot as node from subroots
         union all
         select any_value(level) + 1, pos // {fan}, any_value((n + {fan - 1}) // {fan}), sha256(string_agg(node, '' order by pos))
         from upper_tree where n > 1 group by pos // {fan}),
nodes as (select level, g, pos, node from tree where n > 1
          union all select u.level + depth, g, u.pos, u.node from upper_tree u, subroots where u.n > 1),
started as (select doc_id, g, leaf, new, coalesce(new, leaf) as folded, pos, 0 as level, '' as proof, depth, (select max(level) from upper_tree) + depth as top
       from leaves join subroots using (g)),
folds as (select * from started
          union all
          select any_value(f.doc_id), f.g, f.leaf, any_value(f.new),
                 sha256(coalesce(string_agg(node, '' order by s.pos) filter (s.pos < f.here), '') || any_value(f.folded) || coalesce(string_agg(node, '' order by s.pos) filter (s.pos > f.here), '')),
                 any_value(f.here // {fan}), any_value(f.level) + 1, any_value(f.proof) || coalesce(string_agg(node, '' order by s.pos) filter (s.pos <> f.here), ''),
                 any_value(depth), any_value(top)
          from (select *, case when level = depth then g - 1 else pos end as here from folds where level < top) f
          join nodes s on s.level = f.level and s.g = f.g and s.pos // {fan} = f.here // {fan}
          group by f.g, f.leaf, f.here)
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, folded as folded_root, folded = root as verified
from folds join subroots using (g), (select node as root from upper_tree where n = 1) where level = top
"""
