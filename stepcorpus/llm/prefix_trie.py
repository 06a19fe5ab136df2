"""Conversations as a prefix trie, its subtree totals by parallel tree contraction.

A node is a sequence of turns that some conversation starts with; the root
is the empty sequence.  Turns are numbered by a range partition on
(conversation, turn), each task counting its own rows, so a conversation
with a third of all rows spans many tasks.  A node's key is its depth and the
sum of 126 hashed bits of every (place, turn) on the way to it: sums add up
across tasks, where a chained hash would need one task a conversation.  Texts
leave the first scan only as digests and lengths.

``subtree_sums`` contracts the tree in join rounds.  Rake: all leaves give
their totals to their parents and go.  Compress: of each chain of nodes with
one child those go whose hashed rank is above both neighbours', a third or
so, their sums moving to the child's edge.  A few leaves, a star or a chain
of any length are gone after about the logarithm of the tree's size.  Then
the rounds are undone from the last: a compressed node's total is its child's
total and what it had when it went.  Every join has unique keys on both
sides, hot parents are summed by partial aggregation, and each round's table
is written, so a lost executor repeats a round at most.

The ids that end at a node are hashed in order: range-partitioned by (node,
id), joined to one text a batch of rows, and the texts of a node streamed
through the hash, which by its nature runs in one task.

Turns stand in the order of ``turn``, null first; turns of one number in the
order of their digest, equal rows being separate turns.  A null role or text
is empty.  Rows without a conversation id belong to none and are left out.
Empty and very long texts are turns as others.  An empty table has no nodes.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepcorpus.llm.crc import CRC_TABLE, crc32_sql
from stepcorpus.llm.ordered import EMPTY, hash_in_order
from stepcorpus.session import materialize

PERIOD = 100  # conversations from one multiple of it to the next share the first turns of the first of them
HEADS = 6  # fewer turns than this are shared
_LIMBS = ("l0", "l1", "l2", "l3")
_LOW = 0xFFFFFFFF
_KEY = ["depth", "hi", "lo"]


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, part, pos, digest, n_chars: every turn with its place from 0; ``part`` is the task that held it."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest"), F.length(text).cast("long").alias("n_chars"))
    placed = materialize(rows.repartitionByRange(_partitions(rows), "conv_id", "turn", "digest").withColumn("part", F.spark_partition_id()), "turns")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    before = placed.groupBy("conv_id", "part").count().select("conv_id", "part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("turn", "digest")) - 1
    out = placed.withColumn("inside", inside).join(before, ["conv_id", "part"])
    return materialize(out.select("conv_id", "part", (F.col("before") + F.col("inside")).alias("pos"), "digest", "n_chars"), "numbered")


def with_shared_heads(turns: DataFrame, period: int = PERIOD, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """``(turns, conversations)`` after each conversation c gets the first h turns of c - c % period in
    place of its own first h, h being the checksum of its id modulo ``heads``."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h")
    convs = turns.filter("pos = 0").select("conv_id", (F.col("conv_id") - F.col("conv_id") % period).alias("base"), h)
    firsts = (turns.filter((F.col("conv_id") % period == 0) & (F.col("pos") < heads - 1)).groupBy(F.col("conv_id").alias("base"))
              .agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "n_chars"))).alias("firsts")))  # fewer than ``heads`` each
    none = F.array().cast("array<struct<pos:bigint,digest:binary,n_chars:bigint>>")
    shape = materialize(convs.join(firsts, "base", "left").select("conv_id", "h", F.coalesce(F.filter("firsts", lambda t: t["pos"] < F.col("h")), none).alias("firsts")), "heads")
    head = shape.select("conv_id", F.explode("firsts").alias("t")).select("conv_id", F.lit(-1).alias("part"), "t.pos", "t.digest", "t.n_chars")
    by_part = turns.select("conv_id", "part").distinct().join(shape.select("conv_id", "h", F.size("firsts").alias("k")), "conv_id")
    tail = (turns.join(by_part, ["conv_id", "part"]).filter("pos >= h")
            .select("conv_id", "part", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "digest", "n_chars"))
    return head.unionByName(tail), shape.select("conv_id")


def _key(sums: Sequence[Column]) -> list[Column]:
    low = [s.bitwiseAND(F.lit(_LOW)) for s in sums]
    return [F.shiftleft(low[0], 32).bitwiseOR(low[1]).alias("hi"), F.shiftleft(low[2], 32).bitwiseOR(low[3]).alias("lo")]


def _members(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(members, ends)``: the node of every prefix of every conversation, and the node each ends at."""
    a, b = F.xxhash64(F.lit(1), "pos", "digest"), F.xxhash64(F.lit(2), "pos", "digest")
    bits = (F.shiftrightunsigned(a, 33), a.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(b, 33), b.bitwiseAND(F.lit(_LOW)))
    hashed = turns.select("conv_id", "part", "pos", "n_chars", *(x.alias(n) for n, x in zip(_LIMBS, bits)))
    inside = Window.partitionBy("conv_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hashed = materialize(hashed.select("*", *(F.sum(n).over(inside).alias(f"s_{n}") for n in _LIMBS)), "hashed")
    parts = hashed.groupBy("conv_id", "part").agg(*(F.sum(n).alias(n) for n in _LIMBS), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    before = parts.select("conv_id", "part", *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"b_{n}") for n in _LIMBS))
    rows = hashed.join(before, ["conv_id", "part"])
    here = [F.col(f"b_{n}") + F.col(f"s_{n}") for n in _LIMBS]
    above = [h - F.col(n) for h, n in zip(here, _LIMBS)]
    members = rows.select("conv_id", (F.col("pos") + 1).alias("depth"), *_key(here), *(c.alias(f"up_{n}") for c, n in zip(_key(above), ("hi", "lo"))), "n_chars")
    ends = parts.groupBy("conv_id").agg(F.sum("n").alias("depth"), *(F.sum(n).alias(n) for n in _LIMBS)).select("conv_id", "depth", *_key([F.col(n) for n in _LIMBS]))
    zero = F.lit(0).cast("long")
    turnless = convs.join(turns.select("conv_id").distinct(), "conv_id", "left_anti").select("conv_id", zero.alias("depth"), zero.alias("hi"), zero.alias("lo"))
    return members, ends.unionByName(turnless)


def _looked_up(rows: DataFrame, table: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``rows`` joined with ``table`` (one row a key).  Keys with more than a quarter task's rows, of which
    there can be four a task at most, are joined by broadcast, the others by a shuffle."""
    limit = rows.count() // (4 * _partitions(rows))
    hot = F.broadcast(materialize(rows.groupBy(*keys).count().filter(F.col("count") > limit).select(*keys).join(table, list(keys)), "hot"))
    flagged = rows.join(hot, list(keys), "left")
    return flagged.filter(F.col(value).isNotNull()).unionByName(flagged.filter(F.col(value).isNull()).select(*rows.columns).join(table, list(keys)))


def subtree_sums(tree: DataFrame, values: Sequence[str]) -> DataFrame:
    """id and ``values`` (longs) summed over the subtree of every node of ``tree`` (id, parent, values; the
    parent of a root is null)."""
    zero = F.lit(0).cast("long")
    own, edge = [f"w_{v}" for v in values], [f"e_{v}" for v in values]
    kids = tree.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("kids"))
    active = materialize(tree.join(kids, "id", "left").select("id", "parent", F.coalesce("kids", zero).alias("kids"), *(F.col(v).alias(w) for v, w in zip(values, own)),
                                                              *(zero.alias(e) for e in edge)), "tree")
    raked, compressed = [], []
    while True:
        leaf = F.col("kids") == 0
        raked.append(active.filter(leaf).select("id", *(F.col(w).alias(v) for v, w in zip(values, own))))
        given = [F.sum(F.when(leaf, F.col(w) + F.col(e)).otherwise(0)).alias(f"g_{w}") for w, e in zip(own, edge)]
        up = active.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count_if(~leaf).alias("kids"), F.min(F.when(~leaf, F.col("id"))).alias("child"), *given)
        rest = active.filter(~leaf).drop("kids").join(up, "id").select("id", "parent", "kids", "child", *((F.col(w) + F.col(f"g_{w}")).alias(w) for w in own), *edge)
        rank = lambda c: F.xxhash64(F.lit(len(raked)), c)
        goes = (F.col("kids") == 1) & F.col("parent").isNotNull() & (rank("id") > rank("child")) & (rank("id") > rank("parent"))
        gone = rest.filter(goes).select(F.col("child").alias("id"), F.col("id").alias("gone"), F.col("parent").alias("above"),
                                        *(F.col(w).alias(f"g_{w}") for w in own), *(F.col(e).alias(f"g_{e}") for e in edge))
        met = materialize(rest.filter(F.coalesce(~goes, F.lit(True))).drop("child").join(gone, "id", "left"), "contracted")
        if met.isEmpty():
            break
        compressed.append(met.filter("gone is not null").select(F.col("gone"), "id", *((F.col(f"g_{w}") + F.col(e)).alias(f"x_{v}") for v, w, e in zip(values, own, edge))))
        active = met.select("id", F.coalesce("above", "parent").alias("parent"), "kids", *own,
                            *((F.col(e) + F.coalesce(F.col(f"g_{w}"), zero) + F.coalesce(F.col(f"g_{e}"), zero)).alias(e) for w, e in zip(own, edge)))
    known = raked.pop()
    while compressed:  # from the last round to the first: those compressed in it, then those raked before
        back = compressed.pop().join(known, "id").select(F.col("gone").alias("id"), *((F.col(v) + F.col(f"x_{v}")).alias(v) for v in values))
        known = materialize(known.unionByName(back).unionByName(raked.pop()), "expanded")
    return known


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Every node of the trie of ``turns`` (conv_id, part, pos, digest, n_chars) of the conversations ``convs``:
    conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    zero = F.lit(0).cast("long")
    members, ends = _members(turns, convs)
    ends = hash_in_order(ends.withColumn("piece", F.col("conv_id").cast("string").cast("binary")), _KEY, "conv_id", "ends_sha256", ",")
    nodes = members.groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("up_hi").alias("up_hi"), F.min("up_lo").alias("up_lo"), F.min("n_chars").alias("n_chars"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").select(
        zero.alias("depth"), zero.alias("hi"), zero.alias("lo"), "conv_id", "n_convs", F.lit(None).cast("long").alias("up_hi"), F.lit(None).cast("long").alias("up_lo"), zero.alias("n_chars"))
    nodes = materialize(nodes.unionByName(root).withColumn("id", F.monotonically_increasing_id()), "nodes")
    keys = ["up_depth", "up_hi", "up_lo"]
    below = nodes.filter("depth > 0").withColumn("up_depth", F.col("depth") - 1)
    parents = nodes.select(F.col("depth").alias("up_depth"), F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    linked = _looked_up(below, parents, keys, "parent").drop("up_depth")
    linked = materialize(linked.unionByName(nodes.filter("depth = 0").withColumns({"parent": F.lit(None).cast("long"), "parent_conv_id": F.lit(None).cast("long")})), "linked")
    kids = linked.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    tree = materialize(linked.join(kids, "id", "left").withColumn("n_children", F.coalesce("n_children", zero)), "trie")
    sums = subtree_sums(tree.select("id", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    return (tree.join(sums, "id").join(ends, _KEY, "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")))


def build(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they stand."""
    turns = numbered(conversations)
    return trie(turns, turns.filter("pos = 0").select("conv_id"))


def build_shared(conversations: DataFrame, period: int = PERIOD, heads: int = HEADS) -> DataFrame:
    """The trie of the conversations after ``with_shared_heads``."""
    return trie(*with_shared_heads(numbered(conversations), period, heads))


def brute_force(rows: list[tuple], shared: bool = True) -> list[tuple]:
    """The literal nodes of (conv_id, turn, role, text) rows."""
    from zlib import crc32
    own: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append(((turn is not None, turn or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [t[2] for t in sorted(ts)] for c, ts in own.items()}
    paths = {}
    for c, ts in own.items():
        h = crc32(str(c).encode()) % HEADS if shared else 0
        base = abs(c) // PERIOD * PERIOD * (1 if c >= 0 else -1)
        paths[c] = tuple((own.get(base, [])[:h] if h else []) + ts[h:])
    members: dict[tuple, list] = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    kids: dict[tuple, int] = {}
    for p in members:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, ms in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(ms) - 1) * len(p[-1][1]) if p else 0
    ended = {p: hashlib.sha256(",".join(str(c) for c in sorted(ms) if len(paths[c]) == len(p)).encode()).hexdigest() for p, ms in members.items()}
    return sorted((min(ms), len(p), min(members[p[:-1]]) if p else -1, len(ms), kids.get(p, 0), leaves[p], saved[p], ended[p]) for p, ms in members.items())


SQL = f"""
with {CRC_TABLE},
o as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, digest) - 1 as pos, digest, n from
  (select conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as digest, length(coalesce(text, '')) as n from conversations where conv_id is not null)),
c as (select conv_id, {crc32_sql('conv_id::varchar')} % {HEADS} as h from (select distinct conv_id from o), crc),
r as (select c.conv_id, 0 as own, pos, digest, n from c join o on o.conv_id = c.conv_id - c.conv_id % {PERIOD} and pos < h
  union all select conv_id, 1, pos, digest, n from o join c using (conv_id) where pos >= h),
i as (select conv_id, row_number() over (partition by conv_id order by own, pos) as depth, digest, n from r),
p as (select conv_id, depth, n, string_agg(digest, ',') over (partition by conv_id order by depth) as way from i union all select conv_id, 0, 0, '' from c),
x as (select depth, way, min(conv_id) as conv_id, count(*) as n_convs, any_value(n) as n from p group by depth, way),
m as (select p.conv_id as member, depth, x.conv_id, max(depth) over (partition by p.conv_id) = depth as ends from p join x using (depth, way)),
l as (select x.*, m.conv_id as parent_conv_id from x left join m on m.member = x.conv_id and m.depth = x.depth - 1),
k as (select parent_conv_id as conv_id, depth - 1 as depth, count(*) as n_children from l where depth > 0 group by all),
s as (select m.conv_id, m.depth, count(*) filter (k.n_children is null) as n_leaves, sum((x.n_convs - 1) * x.n) as saved_tokens
  from x left join k using (conv_id, depth) join m on m.member = x.conv_id and m.depth <= x.depth group by all),
e as (select conv_id, depth, sha256(string_agg(member::varchar, ',' order by member)) as ends_sha256 from m where ends group by all)
select conv_id, depth::bigint as depth, parent_conv_id, n_convs, coalesce(n_children, 0) as n_children, n_leaves, saved_tokens::bigint as saved_tokens,
  coalesce(ends_sha256, sha256('')) as ends_sha256 from l left join k using (conv_id, depth) join s using (conv_id, depth) left join e using (conv_id, depth)
"""
