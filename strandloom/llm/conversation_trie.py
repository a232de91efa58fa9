"""Prefix trie of conversations, laid out in preorder.

A node is a distinct sequence of a conversation's first turns. Nodes are told apart by their depth and two sums of random numbers
drawn from (place, turn), which are running sums over the turns, so no conversation is ever an array and no step goes turn by turn.
Conversations are ranked in lexicographic order of their turns' digests: names of eight neighbouring turns, then ranks of
eight neighbouring names, and so on, so the number of rounds is the logarithm of the longest conversation. Sorted by (rank of the first
conversation that holds it, depth), nodes stand in preorder: the subtree of a node is the interval from it to the last node that starts
with or before its last conversation. Leaves and savings of a subtree are then differences of prefix sums, which are made in ranges of the order.

Texts are hashed where they are read and never shuffled. Ids of the conversations that end at a node are put into strings of at most CHUNK,
and a node's hash takes one string after the other, so it needs no memory for them.

Defined results: rows with a null conversation id are left out; null role or text is empty; turns of equal number go in order of their digest; equal
rows are turns of their own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandloom.operators.ranges import ranked, with_running

from . import shared

#: Names that are joined to one in a round of ranking.
ARITY = 8
#: Ids in one string.
CHUNK = 4096
#: A rebuilt conversation begins with that of the next lower multiple of FAMILY, and with fewer of its turns than HEADS.
FAMILY, HEADS = 5, 9
EMPTY = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """Stored (conv_id, i, digest, bytes, n): the turns of each conversation from 1, with how many it has."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    rows = shared.stored(conversations.sparkSession, rows.withColumn("row", F.monotonically_increasing_id()), "turns")
    placed = shared.stored(conversations.sparkSession, with_running(rows, [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("digest"), F.col("row")], g=F.lit(1).cast("long")), "placed")
    first = shared.stored(conversations.sparkSession, placed.groupBy("conv_id").agg(F.min("g").alias("first"), F.count(F.lit(1)).alias("n")), "first")
    out = placed.join(first, "conv_id").select("conv_id", (F.col("g") - F.col("first") + 1).alias("i"), "digest", "bytes", "n")
    out = shared.stored(conversations.sparkSession, out, "ordered")
    for done in (rows, placed, first):
        shared.discard(conversations.sparkSession, done)
    return out


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, d, digest, bytes) of the rebuilt conversations' turns, and their (conv_id, n): a family's first conversation gives the first
    crc32(conv_id) mod HEADS turns of each member, whose own turns follow from there."""
    spark = turns.sparkSession
    sizes = turns.where("i = 1").select("conv_id", "n")
    convs = sizes.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % HEADS).alias("h"))
    given = F.least("h", F.coalesce("n_base", F.lit(0).cast("long")))
    convs = shared.stored(spark, convs.join(sizes.toDF("base", "n_base"), "base", "left").select("conv_id", "base", "h", "n", given.alias("given")), "families")
    own = turns.drop("n").join(convs.select("conv_id", "h", "given"), "conv_id").where(F.col("i") > F.col("h")).select("conv_id", (F.col("i") - F.col("h") + F.col("given")).alias("d"), "digest", "bytes")
    heads = turns.where((F.col("i") < HEADS) & (F.col("conv_id") % FAMILY == 0)).select(F.col("conv_id").alias("base"), "i", "digest", "bytes")
    heads = heads.join(convs.select("conv_id", "base", "h"), "base").where(F.col("i") <= F.col("h")).select("conv_id", F.col("i").alias("d"), "digest", "bytes")
    return shared.stored(spark, own.union(heads), "rebuilt"), convs.select("conv_id", (F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("long"))).alias("n"))


def lexicographic_ranks(turns: DataFrame) -> DataFrame:
    """Stored (conv_id, r): equal conversations have equal r, and what begins with another stands after it."""
    spark = turns.sparkSession
    names = turns.select("conv_id", (F.col("d") - 1).alias("at"), F.col("digest").alias("name"))
    while True:
        parts = names.groupBy("conv_id", F.floor(F.col("at") / ARITY).cast("long").alias("at_")).agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("p"))
        keys = shared.stored(spark, parts.select("conv_id", F.col("at_").alias("at"), F.array_join(F.col("p.name"), "").alias("key")), "keys")  # at most ARITY names
        order = shared.stored(spark, keys.select("key").distinct(), "order")
        order_ = shared.stored(spark, ranked(order, [F.col("key")], "r"), "ranks")
        named = shared.stored(spark, keys.join(order_, "key").select("conv_id", "at", "r"), "named")
        for done in (keys, order, order_):
            shared.discard(spark, done)
        if named.where("at > 0").isEmpty():
            return named.select("conv_id", "r")
        names = named.select("conv_id", "at", F.lpad(F.hex("r"), 16, "0").alias("name"))


def _ends(batches):
    """mapInArrow over (r, d, ids) sorted by r and place: (r, d, sha256) of the joined ids of each r."""
    now, depth, running = None, None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([depth]), pa.array([running.hexdigest()])], names=["lo", "depth", "ends_sha256"])

    for got in batches:
        for r, d, ids in zip(*(got.column(k).to_pylist() for k in range(3)), strict=True):
            if r == now:
                running.update(b",")
            else:
                if now is not None:
                    yield row()
                now, depth, running = r, d, hashlib.sha256()
            running.update(ids.encode())
    if now is not None:
        yield row()


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row a node, from turns (conv_id, d from 1, digest, bytes) and all conversations (conv_id, n), turnless ones too.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, place, last): place is the node's preorder
    number, last that of the last node of its subtree.
    """
    spark = turns.sparkSession
    shared.bound_batches(spark)
    ranks = lexicographic_ranks(turns)
    members = shared.stored(spark, convs.join(ranks, "conv_id", "left").select("conv_id", "n", F.coalesce("r", F.lit(0).cast("long")).alias("r")), "members")
    draw = lambda k: F.xxhash64(F.lit(k), "digest", "d").cast("decimal(20,0)")
    drawn = shared.stored(spark, turns.select("conv_id", "d", "bytes", draw(1).alias("z1"), draw(2).alias("z2")), "drawn")
    run = shared.stored(spark, with_running(drawn, [F.col("conv_id"), F.col("d")], s1=F.col("z1"), s2=F.col("z2")), "sums")
    before = run.where("d = 1").select("conv_id", (F.col("s1") - F.col("z1")).alias("b1"), (F.col("s2") - F.col("z2")).alias("b2"))
    of = members.join(before, "conv_id", "left").select("conv_id", "r", "b1", "b2")
    of = shared.stored(spark, of, "starts")
    wide = lambda c: c.cast("decimal(38,0)")
    keyed = run.join(of, "conv_id").select("conv_id", "r", F.col("d").alias("depth"), *(wide(F.col(f"s{k}") - F.col(f"b{k}")).alias(f"k{k}") for k in (1, 2)), *(wide(F.col(f"s{k}") - F.col(f"b{k}") - F.col(f"z{k}")).alias(f"p{k}") for k in (1, 2)), "bytes")
    zero, none = wide(F.lit(0)), wide(F.lit(None))
    tops = members.select("conv_id", "r", F.lit(0).cast("long").alias("depth"), zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), F.lit(0).cast("long").alias("bytes"))
    nodes = keyed.union(tops).groupBy("depth", "k1", "k2", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("r").alias("lo"), F.max("r").alias("hi"), F.max("bytes").alias("bytes"))
    nodes = shared.stored(spark, nodes, "nodes")
    for done in (drawn, run, of):
        shared.discard(spark, done)
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = shared.stored(spark, nodes.select("depth", "k1", "k2", F.col("conv_id").alias("parent_conv_id")).join(kids, ["depth", "k1", "k2"]), "parents")
    own = parents.select("depth", "k1", "k2", "n_children")
    above = parents.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), "parent_conv_id")
    full = nodes.join(own, ["depth", "k1", "k2"], "left")
    full = shared.stored(spark, full.select("conv_id", "depth", "p1", "p2", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "lo", "hi", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")), "children")
    full = shared.stored(spark, full.join(above, ["depth", "p1", "p2"], "left").withColumn("leaf", (F.col("n_children") == 0).cast("long")).drop("p1", "p2"), "family")
    laid = shared.stored(spark, with_running(full, [F.col("lo"), F.col("depth")], place=F.lit(1).cast("long"), leaves=F.col("leaf"), savings=F.col("saved")), "preorder")
    last = shared.stored(spark, laid.groupBy(F.col("lo").alias("hi")).agg(F.max("place").alias("last"), F.max("leaves").alias("l1"), F.max("savings").alias("s1")), "last")
    whole = laid.join(last, "hi").withColumn("n_leaves", F.col("l1") - F.col("leaves") + F.col("leaf")).withColumn("saved_tokens", F.col("s1") - F.col("savings") + F.col("saved"))
    whole = shared.stored(spark, whole, "whole")
    placed = ranked(members, [F.col("r"), F.col("conv_id")], "g")
    chunks = placed.groupBy("r", F.floor(F.col("g") / CHUNK).alias("chunk")).agg(F.max("n").alias("d"), F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    ends = chunks.repartition("r").sortWithinPartitions("r", "chunk").select("r", "d", "ids").mapInArrow(_ends, "lo long, depth long, ends_sha256 string")
    ends = shared.stored(spark, ends, "ends")
    for done in (parents, full, laid, last, nodes):
        shared.discard(spark, done)
    return whole.join(ends, ["lo", "depth"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"), "place", "last")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """prefix_trie of the rebuilt conversations of (conv_id, turn, role, text)."""
    return prefix_trie(*rebuilt(ordered_turns(conversations)))


def oracle() -> str:
    """The same as DuckDB SQL: nodes by hashes of whole paths, subtrees through the paths of the nodes' conversations."""
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
    return (
        "WITH b AS (SELECT conv_id, text, digest, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS i FROM (SELECT conv_id, turn, coalesce(text, '') AS text, sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest FROM conversations WHERE conv_id IS NOT NULL)), "
        f"c AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, {crc} % {HEADS} AS h FROM (SELECT DISTINCT conv_id FROM b)), "
        "pre AS (SELECT c.conv_id, b.i AS d, text, digest FROM c JOIN b ON b.conv_id = c.base WHERE b.i <= c.h), np AS (SELECT conv_id, count(*) AS n FROM pre GROUP BY conv_id), "
        "t AS (SELECT * FROM pre UNION ALL SELECT b.conv_id, b.i - h + coalesce(n, 0), text, digest FROM b JOIN c ON b.conv_id = c.conv_id LEFT JOIN np ON b.conv_id = np.conv_id WHERE b.i > h), "
        "k AS (SELECT conv_id, d, strlen(text) AS bytes, sha256(string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY d)) AS key FROM t), "
        "p AS (SELECT conv_id, d, bytes, key, lag(key, 1, 'root') OVER (PARTITION BY conv_id ORDER BY d) AS parent FROM k UNION ALL SELECT conv_id, 0, 0, 'root', NULL FROM c), "
        "n AS (SELECT key, any_value(d) AS depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM p GROUP BY key), "
        "ch AS (SELECT parent AS key, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent), "
        "m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch ON n.key = ch.key), "
        "s AS (SELECT p.key, sum(CAST(n_children = 0 AS BIGINT)) AS n_leaves, sum((n_convs - 1) * m.bytes) AS saved_tokens FROM m JOIN p ON m.conv_id = p.conv_id WHERE p.d <= m.depth GROUP BY p.key), "
        "z AS (SELECT key, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY d DESC) = 1) GROUP BY key) "
        "SELECT m.conv_id, CAST(m.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256 "
        "FROM m LEFT JOIN n u ON m.parent = u.key JOIN s ON s.key = m.key LEFT JOIN z ON z.key = m.key"
    )


ORACLE = oracle()
