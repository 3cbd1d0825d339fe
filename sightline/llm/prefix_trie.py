"""Conversation prefix trie: shared beginnings of conversations, by SQL ROLLUP.

A conversation is its sequence of turns; a node is a distinct sequence of first
``d`` turns of one or more conversations.  Turns become identifiers (128 bits of
the SHA-256 of role and text, with the text's length), and each conversation is
cut into column blocks of ``width`` positional identifiers.  One ``GROUP BY block
key, ROLLUP(t0, ...)`` aggregates the prefixes of all lengths of all blocks
together, and ``grouping_id`` tells their depth.  Long conversations continue in
further blocks, keyed by the node that the block before ends at: the exclusive or
of 128-bit hashes of (position, turn) up to there.  That key needs the
conversation's own turns only, so all blocks, of however long conversations, are
one ROLLUP and not one job each.

A node's value (its shared tokens, or that it is a leaf) is given to its smallest
member, which is also a member of all nodes above; a second ROLLUP sums for each
prefix what its members were given from that depth on, which is the sum over the
node's subtree.

Turns are numbered without a window over one conversation (`number_rows`), all
other groups are aggregated partially, and the members that end at a node are
hashed as a sorted stream, so neither a long conversation nor a third of all rows
in copies of one meets in one group in memory.

Defined results: rows with a null conversation id take no part; a null role or
text is the empty text; turns are ordered by turn (null first), then role and
text; repeated rows are turns of their own; a table without conversations has no
nodes, not even the root; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import discard, prepare, written
from sightline.operators.ranking import number_rows

WIDTH = 8
PACK_IDS = 4096
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def number_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_id): the turns of each conversation from position 0,
    with identifiers ``<128 bits of SHA-256>:<code points of the text>``."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("_role"), text.alias("_text"),
        F.concat(F.substring(digest, 1, 32), F.lit(":"), F.length(text).cast("string")).alias("turn_id"))
    # after role and text nothing tells rows apart: equal ones are the same turn
    order = [F.col("turn").asc_nulls_first(), F.col("_role").asc(), F.col("_text").asc()]
    numbered = number_rows(rows, order, by=["conv_id"], name="_n")
    return numbered.select("conv_id", (F.col("_n") - 1).alias("pos"), "turn_id")


def graft(numbered: DataFrame, base_of: Column, take: Column) -> DataFrame:
    """Conversations rebuilt: the first ``take`` turns of the conversation
    ``base_of`` (both expressions of conv_id), then the own turns after the first
    ``take``.  Returns (conv_id, pos, turn_id), and the turnless as one row each
    with null pos."""
    sizes = numbered.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_size")).select(
        "conv_id", "_size", base_of.cast("long").alias("_base"), take.cast("long").alias("_take"))
    bases = sizes.select(F.col("conv_id").alias("_base"), F.col("_size").alias("_base_size"))
    plan = sizes.join(bases, "_base", "left").withColumn(
        "_head", F.least("_take", F.coalesce("_base_size", F.lit(0))))
    head = (plan.where(F.col("_head") > 0)
            .select("conv_id", "_base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_head") - 1)).alias("pos"))
            .join(numbered.select(F.col("conv_id").alias("_base"), "pos", "turn_id"), ["_base", "pos"]))
    own = (numbered.join(plan.select("conv_id", "_take", "_head"), "conv_id")
           .where(F.col("pos") >= F.col("_take"))
           .withColumn("pos", F.col("pos") - F.col("_take") + F.col("_head")))
    columns = ["conv_id", "pos", "turn_id"]
    none = plan.where((F.col("_head") == 0) & (F.col("_size") <= F.col("_take"))).select(
        "conv_id", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("turn_id"))
    return head.select(*columns).unionByName(own.select(*columns)).unionByName(none)


def _hash(pos: Column, turn_id: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), pos.cast("long"), turn_id)


def column_blocks(rows: DataFrame, width: int) -> DataFrame:
    """One row for each conversation and block: conv_id, block, n_turns (of the
    conversation), the identifiers t0, t1, ... and the key (k1, k2) of the node
    that the blocks before end at."""
    block = F.floor(F.coalesce(F.col("pos"), F.lit(0)) / width).cast("long")
    tagged = rows.withColumn("block", block).withColumn("_at", F.col("pos") - F.col("block") * width)
    parts = tagged.groupBy("conv_id", "block").agg(
        F.count("pos").alias("_n"),
        *[F.max(F.when(F.col("_at") == i, F.col("turn_id"))).alias(f"t{i}") for i in range(width)],
        *[F.bit_xor(F.when(F.col("pos").isNotNull(), _hash(F.col("pos"), F.col("turn_id"), s))).alias(f"_x{s}")
          for s in (1, 2)])
    whole = Window.partitionBy("conv_id")
    before = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    return parts.select(
        "conv_id", "block", *[f"t{i}" for i in range(width)],
        F.sum("_n").over(whole).alias("n_turns"),
        *[F.coalesce(F.bit_xor(f"_x{s}").over(before), zero).alias(f"k{s}") for s in (1, 2)],
        *[F.coalesce(F.bit_xor(f"_x{s}").over(whole), zero).alias(f"e{s}") for s in (1, 2)])


def _rollup(blocks: DataFrame, width: int, aggregates: str) -> DataFrame:
    """All prefixes of all blocks: the block's key and columns, ``level`` (turns of
    the block in the prefix) and ``aggregates``.  The empty prefix of a later
    block is the last node of the block before, and left to that."""
    turns = [f"t{i}" for i in range(width)]
    grouped = blocks.sparkSession.sql(
        f"SELECT block, k1, k2, {', '.join(turns)}, grouping_id() AS gid, {aggregates} "
        f"FROM {{blocks}} GROUP BY block, k1, k2, ROLLUP({', '.join(turns)})", blocks=blocks)
    level = F.lit(width) - F.log2(F.col("gid") + 1).cast("int")
    last = F.coalesce(*[F.when(F.col("level") == i + 1, F.col(f"t{i}")) for i in range(width)])
    return (grouped.withColumn("level", level).withColumn("last", last)
            # a prefix that reaches beyond the end of its conversations is none
            .where(F.when(F.col("level") == 0, F.col("block") == 0).otherwise(F.col("last").isNotNull())))


def _with_keys(nodes: DataFrame, width: int) -> DataFrame:
    """Nodes with depth, their own key (h1, h2) and their parent's (p1, p2)."""
    depth = (F.col("block") * width + F.col("level")).cast("long")
    for s in (1, 2):
        own = F.col(f"k{s}")
        for i in range(width):
            part = _hash(F.col("block") * width + i, F.col(f"t{i}"), s)
            own = own.bitwiseXOR(F.when(F.col("level") > i, part).otherwise(F.lit(0).cast("long")))
        nodes = nodes.withColumn(f"h{s}", own)
    nodes = nodes.withColumn("depth", depth)
    for s in (1, 2):
        step = _hash(F.col("depth") - 1, F.col("last"), s)
        nodes = nodes.withColumn(f"p{s}", F.when(F.col("depth") > 0, F.col(f"h{s}").bitwiseXOR(step)))
    return nodes


def _ends(blocks: DataFrame) -> DataFrame:
    """(h1, h2, ends_sha256): the conversations that end at each node.  Sorted
    runs are packed to long strings where they lie; each node's digest then reads
    its few strings in order, as a stream."""
    prepare(blocks.sparkSession)
    ends = (blocks.where(F.col("block") == 0).select(F.col("e1").alias("h1"), F.col("e2").alias("h2"), "conv_id")
            .repartitionByRange("h1", "h2", "conv_id").sortWithinPartitions("h1", "h2", "conv_id"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            new = (b["h1"].diff().ne(0) | b["h2"].diff().ne(0)).cumsum()
            out = [(g["h1"].iloc[0], g["h2"].iloc[0], g["conv_id"].iloc[a], ",".join(map(str, g["conv_id"].iloc[a:a + PACK_IDS])))
                   for _, g in b.groupby(new, sort=False) for a in range(0, len(g), PACK_IDS)]
            yield pd.DataFrame(out, columns=["h1", "h2", "first", "ids"])

    packed = ends.mapInPandas(pack, "h1 long, h2 long, first long, ids string")
    runs = packed.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "first")

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state = None, None
        for b in batches:
            done = []
            for h1, h2, ids in zip(b["h1"], b["h2"], b["ids"]):
                if (h1, h2) != node:
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = (h1, h2), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pd.DataFrame(done, columns=["h1", "h2", "ends_sha256"])
        if node:
            yield pd.DataFrame([(*node, state.hexdigest())], columns=["h1", "h2", "ends_sha256"])

    return runs.mapInPandas(digest, "h1 long, h2 long, ends_sha256 string")


def prefix_trie(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """The trie of conversations given as (conv_id, pos, turn_id), with one row of
    null pos for a turnless one.  One row for each node: conv_id (smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, and the node's keys."""
    blocks = written(column_blocks(rows, width), "trie-blocks")
    first = _with_keys(_rollup(blocks, width, "count(*) AS n_convs, min(conv_id) AS member, max(n_turns) AS longest"), width)
    length = F.coalesce(F.split_part("last", F.lit(":"), F.lit(2)).cast("long"), F.lit(0).cast("long"))
    valued = first.select(F.col("member").alias("conv_id"), "block", "level",
                          (F.col("longest") == F.col("depth")).cast("long").alias("leaf"),
                          ((F.col("n_convs") - 1) * length).alias("saved"))

    # a conversation's values by level, then what it has from each level on
    given = valued.groupBy("conv_id", "block").agg(*[
        F.sum(F.when(F.col("level") == i, F.col(v))).alias(f"{v}_{i}") for v in ("leaf", "saved") for i in range(width + 1)])
    later = Window.partitionBy("conv_id").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    here = blocks.join(given, ["conv_id", "block"], "left").select(
        *blocks.columns, *[F.coalesce(f"{v}_{i}", zero).alias(f"{v}_{i}") for v in ("leaf", "saved") for i in range(width + 1)])
    total = {v: sum((F.col(f"{v}_{i}") for i in range(1, width + 1)), F.col(f"{v}_0")) for v in ("leaf", "saved")}
    carried = here.select("*", *[F.coalesce(F.sum(total[v]).over(later), zero).alias(f"{v}_later") for v in total])
    onward = carried.select(*blocks.columns, *[
        sum((F.col(f"{v}_{j}") for j in range(i, width + 1)), F.col(f"{v}_later")).alias(f"{v}_from_{i}")
        for v in total for i in range(width + 1)])
    sums = ", ".join(f"sum({v}_from_{i}) AS {v}_{i}" for v in total for i in range(width + 1))
    second = _with_keys(_rollup(onward, width, f"count(*) AS n_convs, min(conv_id) AS member, {sums}"), width)
    pick = lambda v: F.coalesce(*[F.when(F.col("level") == i, F.col(f"{v}_{i}")) for i in range(width + 1)])
    nodes = written(second.select("h1", "h2", "p1", "p2", "depth", F.col("member").alias("conv_id"), "n_convs",
                                  pick("leaf").alias("n_leaves"), pick("saved").alias("saved_tokens")), "trie-nodes")

    children = nodes.where(F.col("depth") > 0).groupBy(F.col("p1").alias("h1"), F.col("p2").alias("h2")).agg(
        F.count(F.lit(1)).alias("n_children"))
    ends = written(_ends(blocks), "trie-ends")
    discard(blocks)
    parents = nodes.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    return (nodes.join(children, ["h1", "h2"], "left").join(ends, ["h1", "h2"], "left").join(parents, ["p1", "p2"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
                    "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256")))


def oracle_sql() -> str:
    """The query's result in DuckDB: nodes as lists of turns."""
    return """
    WITH crc_table AS (
      SELECT list(list_reduce(list_prepend(n::BIGINT, range(8)),
             lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY n) AS t
      FROM range(256) r(n)),
    turns AS (
      SELECT conv_id::BIGINT AS conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
      FROM conversations WHERE conv_id IS NOT NULL),
    lists AS (
      SELECT conv_id, list({'r': role, 't': text} ORDER BY pos) AS own FROM turns GROUP BY conv_id),
    sized AS (
      SELECT conv_id, own, xor(list_reduce(list_prepend(4294967295::BIGINT,
               list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ord(d)::BIGINT)),
               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 6 AS h
      FROM lists, crc_table),
    rebuilt AS (
      SELECT s.conv_id, list_concat(coalesce(b.own[1:s.h], []), s.own[s.h + 1:]) AS seq
      FROM sized s LEFT JOIN lists b ON b.conv_id = s.conv_id - s.conv_id % 100),
    members AS (SELECT conv_id, seq, unnest(range(len(seq) + 1)) AS depth FROM rebuilt),
    nodes AS (
      SELECT seq[1:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
             coalesce(string_agg(CASE WHEN len(seq) = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ends
      FROM members GROUP BY ALL),
    children AS (
      SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
    full_nodes AS (
      SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (node)),
    above AS (
      SELECT node[1:up] AS node, n_children = 0 AS leaf,
             CASE WHEN depth > 0 THEN (n_convs - 1) * length(node[depth].t) ELSE 0 END AS saved
      FROM (SELECT *, unnest(range(depth + 1)) AS up FROM full_nodes)),
    subtree AS (
      SELECT node, count(*) FILTER (WHERE leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM above GROUP BY 1)
    SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children,
           s.n_leaves, s.saved_tokens, sha256(n.ends) AS ends_sha256
    FROM full_nodes n JOIN subtree s USING (node)
    LEFT JOIN nodes p ON n.depth > 0 AND p.node = n.node[1:n.depth - 1]
    """
