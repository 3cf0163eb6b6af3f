"""Merkle manifest of a table: one root for all rows, a subroot per group, and a proof for every row.

Rows become leaves, ordered by key in their group. Every ARITY nodes in a row become the digest of their texts, until
a group has one node, its subroot; the subroots, in order of their groups, give the root in the same way. Leaves are
ranked by ranges and dealt to blocks of ARITY ** LEVELS; a block is one ordered array, whose levels are collapsed by
sequence, transform, slice and aggregate. Roots of blocks are the nodes of the next round, so no task ever holds more
than a block, whatever the size of a group. Proofs are opened from the top down: a row's siblings in its block, then
those of its block.

Order within a group: null keys first, rows of one key by their leaves. A null group is a group of its own and comes
first. Rows repeated as a whole are leaves of their own. A group of one row has that leaf as its subroot, a table of
one group that subroot as its root. An empty table gives no rows. Columns that are not asked for are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.llm.common import crc_mod, written
from lineweave.operators.ranks import ranked

#: Nodes that become one node of the level above.
ARITY = 3
#: Levels that one block collapses; it holds at most ARITY ** LEVELS nodes.
LEVELS = 6
BLOCK = ARITY**LEVELS


def digest(text: Column) -> Column:
    """SHA-256 as lowercase hex of a text's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def leaf_of(values: list[Column]) -> Column:
    """The digest of a row: each value as `-` where it is null, else its length in UTF-8 bytes, a colon and its text."""
    texts = [v.cast("string") for v in values]
    return digest(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(path, leaf, lambda node, run: digest(F.concat(run.before, node, run.after)))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a proof, level by level, from left to right."""
    return digest(F.array_join(F.transform(path, lambda run: F.concat(run.before, run.after)), ""))


def _depth(n: Column) -> Column:
    """How many levels a block collapses: all until one node is left, LEVELS where its tree goes on above it."""
    return sum(((n > ARITY**k).cast("int") for k in range(LEVELS)), F.lit(0))


def _blocks(nodes: DataFrame) -> DataFrame:
    """(g, n, block, members, levels, root) from nodes (g, n: nodes of the tree, at: place from 0, node, own)."""
    packed = nodes.groupBy("g", "n", F.floor(F.col("at") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("at", "node", "own"))).alias("members"))
    above = lambda level: F.transform(F.sequence(F.lit(0), F.ceil(F.size(level) / ARITY).cast("int") - 1), lambda i: digest(F.array_join(F.slice(level, i * ARITY + 1, F.lit(ARITY)), "")))
    rounds = F.slice(F.array(*[F.lit(k) for k in range(LEVELS)]), F.lit(1), _depth(F.col("n")))
    first = F.array(F.col("members.node")).cast("array<array<string>>")
    levels = F.aggregate(rounds, first, lambda done, _: F.concat(done, F.transform(F.slice(done, -1, 1), above)))
    return packed.withColumn("levels", levels).withColumn("root", F.element_at(F.element_at("levels", -1), 1))


def _collapsed(nodes: DataFrame, largest: int) -> list[DataFrame]:
    """The written blocks of all rounds over trees of at most `largest` nodes; the last has one block per tree."""
    rounds = [written(_blocks(nodes), "blocks")]
    while largest > BLOCK:
        largest = -(-largest // BLOCK)
        below = rounds[-1].select("g", F.ceil(F.col("n") / BLOCK).alias("n"), F.col("block").alias("at"), F.col("root").alias("node"), F.struct(F.lit(0).alias("none")).alias("own"))
        rounds.append(written(_blocks(below), "blocks"))
    return rounds


def _opened(rounds: list[DataFrame], above: DataFrame, carried: list[str]) -> DataFrame:
    """(g, at, node, own, path, carried) of the first round's nodes; above: (g, path, carried) of the trees' own roots."""
    power = F.array(*[F.lit(ARITY**k) for k in range(LEVELS)])
    above = above.withColumn("block", F.lit(0).cast("long"))

    def siblings(level: Column, place: Column) -> Column:
        first = place - place % ARITY
        return F.struct(F.array_join(F.slice(level, first + 1, place - first), "").alias("before"), F.array_join(F.slice(level, place + 2, first + ARITY - 1 - place), "").alias("after"))

    for blocks in reversed(rounds):
        both = blocks.drop("root", "n").join(above, ["g", "block"])
        # the levels are bound once through an array of one, not worked out again for each member
        each = lambda levels, up: F.transform("members", lambda x, p: F.struct(x.at.alias("at"), x.node.alias("node"), x.own.alias("own"), F.concat(F.transform(levels, lambda level, k: siblings(level, F.floor(p / F.get(power, k)).cast("int"))), up).alias("path")))
        inner = F.slice("levels", F.lit(1), F.size("levels") - 1)
        opened = F.flatten(F.transform(F.array(F.struct(inner.alias("l"), F.col("path").alias("up"))), lambda b: each(b.l, b.up)))
        rows = both.select("g", *carried, F.inline(opened))
        above = rows.select("g", F.col("at").alias("block"), "path", *carried)
    return rows


def proofs(rows: DataFrame, key: str, group: str, fields: list[str], extra: dict[str, Column] | None = None) -> DataFrame:
    """(key, leaf, extra, subroot, root, path): each row's proof as its siblings (before, after) of every level.

    extra holds columns to be taken from rows in the same pass.
    """
    extra = extra or {}
    own = {"k": F.col(key), **extra}
    leaves = written(rows.select(F.col(group).alias("group"), leaf_of([F.col(c) for c in fields]).alias("node"), F.struct(*[c.alias(n) for n, c in own.items()]).alias("own"), F.monotonically_increasing_id().alias("_turn")), "leaves")
    placed = ranked(leaves, [F.col("group"), F.col("own.k"), F.col("node"), F.col("_turn")], "_rank").drop("_turn")
    # a group's number is the rank of its first row, so that numbers are ordered as groups are
    groups = written(placed.groupBy("group").agg(F.min("_rank").alias("g"), F.count(F.lit(1)).alias("n")), "groups").withColumnRenamed("group", "_group")
    n_groups, largest = groups.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()  # two numbers
    nodes = placed.join(groups, F.col("group").eqNullSafe(F.col("_group"))).select("g", "n", (F.col("_rank") - F.col("g")).alias("at"), "node", "own")
    rounds = _collapsed(nodes, largest)
    subroots = ranked(rounds[-1].select("g", F.col("root").alias("node")), [F.col("g")], "at")
    tops = _collapsed(subroots.select(F.lit(0).cast("long").alias("g"), F.lit(n_groups).cast("long").alias("n"), "at", "node", F.struct("g").alias("own")), n_groups)
    root = tops[-1].select("g", F.col("root"), F.array().cast("array<struct<before:string,after:string>>").alias("path"))
    above = _opened(tops, root, ["root"]).select(F.col("own.g").alias("g"), F.col("node").alias("subroot"), "root", "path")
    done = _opened(rounds, above, ["subroot", "root"])
    return done.select(F.col("own.k").alias(key), F.col("node").alias("leaf"), *[F.col(f"own.{n}").alias(n) for n in extra], "subroot", "root", "path")


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def tamper_check(docs: DataFrame) -> DataFrame:
    """The manifest of documents, and for each row whether its proof still leads to the root.

    Rows whose id has an even crc32 are looked at without the line feeds of their text, as if tampered with. A null id
    has no crc32 and is left as it is.
    """
    changed = F.when(crc_mod("doc_id", 2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    seen = leaf_of([changed if c == "text" else F.col(c) for c in FIELDS])
    made = proofs(docs, "doc_id", "source", FIELDS, {"seen": seen})
    out = made.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(F.col("seen"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle() -> str:
    """The same in DuckDB: levels as recursion over lists, proofs as recursion over a row's place."""
    leaf = lambda text: "sha256(" + " || ".join(f"case when {c} is null then '-' else strlen({c}::varchar) || ':' || {c}::varchar end" for c in ["doc_id", "source", "lang", "n_chars", text]) + ")"
    crc = "list_reduce(list_concat([4294967295::bigint], flatten(list_transform(range(1, length(doc_id::varchar) + 1), lambda j: [ascii(substr(doc_id::varchar, j, 1))::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: case when x >= 0 then xor(c, x) when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)"
    level = "list_transform(range(0, (len(nodes) + 2) // 3), lambda j: sha256(array_to_string(nodes[3 * j + 1 : 3 * j + 3], '')))"
    tree = lambda name, start: f"{name} as (select g, 0 as l, nodes from {start} union all select g, l + 1, {level} from {name} where len(nodes) > 1)"
    left = "array_to_string(s.nodes[(p.i // (3 ** s.l)::bigint) // 3 * 3 + 1 : p.i // (3 ** s.l)::bigint], '')"
    right = "array_to_string(s.nodes[p.i // (3 ** s.l)::bigint + 2 : (p.i // (3 ** s.l)::bigint) // 3 * 3 + 3], '')"
    return f"""
with recursive d as materialized (
  select doc_id, source, {leaf('text')} as leaf, {leaf(f"(case when doc_id is not null and ~({crc}) & 1 = 0 then replace(text, chr(10), '') else text end)")} as seen from documents),
r as materialized (select *, dense_rank() over (order by source nulls first) - 1 as g, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i from d),
bottom as (select g, list(leaf order by i) as nodes from r group by g),
{tree('low', 'bottom')},
sub as materialized (select g, nodes[1] as subroot from low where len(nodes) = 1),
middle as (select 0 as g, list(subroot order by g) as nodes from sub),
{tree('high', 'middle')},
runs as materialized (
  select p.g, p.i, s.l as l, {left} as before, {right} as after from r p join low s on s.g = p.g where len(s.nodes) > 1
  union all
  select p.g, p.i, 1000 + s.l, {left.replace('p.i', 'p.g')}, {right.replace('p.i', 'p.g')} from r p cross join high s where len(s.nodes) > 1),
step as materialized (select *, row_number() over (partition by g, i order by l) as k from runs),
proof as (select g, i, sha256(string_agg(before || after, '' order by k)) as proof from step group by all),
fold(g, i, k, node) as (
  select g, i, 0::bigint, seen from r union all select f.g, f.i, f.k + 1, sha256(s.before || f.node || s.after) from fold f join step s on s.g = f.g and s.i = f.i and s.k = f.k + 1),
top as (select g, i, arg_max(node, k) as folded from fold group by all)
select r.doc_id, r.leaf, sub.subroot, h.root, coalesce(proof.proof, sha256('')) as proof_sha256, top.folded as folded_root, top.folded = h.root as verified
from r join sub using (g) join top using (g, i) left join proof using (g, i) cross join (select nodes[1] as root from high where len(nodes) = 1) h"""
