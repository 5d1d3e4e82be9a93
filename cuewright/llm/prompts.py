"""Prefix trie of the chat requests sent to a model, by collapsing whole sequences.

Requests open alike (system prompt, brief, first exchange), and a prefix cache pays for a shared
opening once. Identical requests are collapsed into one weighted sequence with the list of requests
that end there; sequences that are proper prefixes of others are dropped by an anti-join, which
leaves the leaves; the weighted prefixes of all sequences are then summed into nodes.

A prefix is named by 128 bits, the exclusive or of a hash of each (place, message). Such names add
up in any order, so a request of any length is cut into blocks, and no message text is ever shuffled.
"""
from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.plans.ranking import ranked

from .common import Scratch

BLOCK = 4096    # messages of a request that one task holds
CHUNK = 512     # ids of an end list in one row
NODE = ("n1", "n2")
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _blockwise(rows: DataFrame, name: str, how, value: str, *, key: str, place: str, descending: bool = False) -> DataFrame:
    """Add a running aggregate, this row included, over a key's rows by ``place``, block by block.

    ``rows`` has the key's number of rows in ``length``; only keys of several blocks have block totals.
    """
    rows = rows.withColumn("_block", F.floor(F.col(place) / BLOCK))
    order = lambda c: F.desc(c) if descending else F.asc(c)
    local = rows.withColumn(name, how(value).over(Window.partitionBy(key, "_block").orderBy(order(place))))
    totals = rows.where(F.col("length") >= BLOCK).groupBy(key, "_block").agg(how(value).alias("_total"))
    before = Window.partitionBy(key).orderBy(order("_block")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(key, "_block", how("_total").over(before).alias("_before"))
    both = local.join(totals, [key, "_block"], "left")
    joined = F.col(name).bitwiseXOR(F.coalesce("_before", F.lit(0))) if how is F.bit_xor else F.col(name) + F.coalesce("_before", F.lit(0))
    return both.withColumn(name, joined).drop("_block", "_before")


def _hashed(batches):
    """SHA-256 of every node's end list, streamed: rows come sorted by node and chunk."""
    node, running = None, None
    for batch in batches:
        out = []
        for n1, n2, text in zip(*(batch.column(c).to_pylist() for c in ("n1", "n2", "text")), strict=True):
            if (n1, n2) == node:
                running.update(b"," + text.encode())
            else:
                if node is not None:
                    out.append((*node, running.hexdigest()))
                node, running = (n1, n2), hashlib.sha256(text.encode())
        yield _rows(out)
    if node is not None:
        yield _rows([(*node, running.hexdigest())])


def _rows(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())],
                                      ["n1", "n2", "ends"])


def rebuilt(messages: DataFrame, scratch: Scratch, *, base: Column | None = None, shared: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(requests, messages) after every request got its opening.

    requests: ``request, length``. messages: ``request, place`` from 0, ``t1, t2`` (what it says),
    ``words, length``. ``base`` and ``shared``, expressions over ``request``, name the request whose
    first ``shared`` messages open this one, in place of as many of its own.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "content"))
    said = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    half = lambda at: F.conv(F.substring(said, at, 16), 16, -10).cast("bigint")
    slim = messages.where(F.col("request").isNotNull()).select(
        "request", "turn", half(1).alias("t1"), half(17).alias("t2"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"))
    slim = scratch.keep(slim, "messages")
    rows = ranked(slim, "place", ("turn", "t1", "t2"), keys=("request",),
                  keep=lambda df: scratch.keep(df, "ordered")).drop("turn")
    base = F.col("request") if base is None else base
    shared = F.lit(0) if shared is None else shared
    sizes = scratch.keep(rows.groupBy("request").agg(F.count(F.lit(1)).alias("own")), "sizes")
    known = sizes.select("request", "own", base.alias("base"), shared.cast("bigint").alias("shared"))
    lent = sizes.select(F.col("request").alias("base"), F.col("own").alias("of_base"))
    known = known.join(lent, "base", "left").withColumn("taken", F.least("shared", F.coalesce("of_base", F.lit(0)))) \
        .withColumn("length", F.col("taken") + F.greatest(F.col("own") - F.col("shared"), F.lit(0)))
    known = scratch.keep(known.select("request", "base", "shared", "taken", "length"), "requests")
    opening = known.where("taken > 0").join(rows.withColumnRenamed("request", "base"), "base").where("place < taken") \
        .select("request", "place", "t1", "t2", "words", "length")
    rest = rows.join(known, "request").where("place >= shared") \
        .select("request", (F.col("place") - F.col("shared") + F.col("taken")).alias("place"), "t1", "t2", "words", "length")
    return known.select("request", "length"), opening.unionAll(rest)


def prompt_trie(messages: DataFrame, scratch: Scratch, *, base: Column | None = None, shared: Column | None = None) -> DataFrame:
    """Per node: ``request, depth, parent_request, requests, children, leaves, saved_tokens, ends_sha256``.

    ``messages``: ``request, turn, role, content``, a row per message sent. A node is a distinct
    sequence of first messages (role and content), from the empty root; its members are the requests
    that start with it, and ``request`` is the smallest of them. ``leaves`` counts the childless nodes of
    its subtree, itself included; ``saved_tokens`` sums, over the subtree, the words of a node's last
    message for each member but one; ``ends_sha256`` hashes the ids of the members that end there,
    ascending and comma-joined. ``base`` and ``shared``: see ``rebuilt``.

    Messages go by turn (NULL first); those with one turn by their digest, repeated rows are a message
    each. A NULL role or content is empty. A row without request belongs to none and is left out.
    A request whose messages are all replaced by an opening that is not there ends at the root.
    An empty table gives no rows; other columns are never looked at.
    """
    requests, said = rebuilt(messages, scratch, base=base, shared=shared)
    hashed = said.select("request", "place", "words", "length", F.xxhash64("place", "t1", "t2").alias("x1"),
                         F.xxhash64(F.lit(1), "t2", "place", "t1").alias("x2"))
    for x, n in zip(("x1", "x2"), NODE, strict=True):
        hashed = _blockwise(hashed, n, F.bit_xor, x, key="request", place="place")
    parent = [F.col(n).bitwiseXOR(F.col(x)).alias(p) for n, x, p in zip(NODE, ("x1", "x2"), ("p1", "p2"), strict=True)]
    prefixes = scratch.keep(hashed.select("request", (F.col("place") + 1).alias("depth"), *NODE, *parent, "words", "length"), "prefixes")

    root = [F.lit(0).cast("bigint").alias(n) for n in NODE]
    ends = prefixes.where("depth = length").select("request", *NODE).unionAll(requests.where("length = 0").select("request", *root))
    ends = scratch.keep(ends, "ends")
    sequences = ends.groupBy(*NODE).agg(F.min("request").alias("request"), F.count(F.lit(1)).alias("weight"))
    proper = prefixes.select(F.col("p1").alias("n1"), F.col("p2").alias("n2")).distinct()
    leaves = sequences.join(proper, list(NODE), "left_anti").select("request", "weight", F.lit(1).cast("bigint").alias("leaf"))
    inner = sequences.join(proper, list(NODE), "left_semi").select("request", "weight", F.lit(0).cast("bigint"))
    sequences = scratch.keep(leaves.unionAll(inner), "sequences")
    paths = scratch.keep(prefixes.join(sequences, "request"), "paths")  # of one request for each sequence

    nodes = paths.groupBy(*NODE).agg(F.min("request").alias("request"), F.sum("weight").alias("requests"), F.sum("leaf").alias("leaves"),
                                     F.any_value("depth").alias("depth"), F.any_value("words").alias("words"),
                                     F.any_value("p1").alias("p1"), F.any_value("p2").alias("p2"))
    top = sequences.agg(F.min("request").alias("request"), F.sum("weight").alias("requests"), F.sum("leaf").alias("leaves")) \
        .where("requests > 0").select(*root, "request", "requests", "leaves", F.lit(0).cast("bigint").alias("depth"),
                                      F.lit(0).cast("bigint").alias("words"), F.lit(None).cast("bigint").alias("p1"), F.lit(None).cast("bigint").alias("p2"))
    nodes = scratch.keep(nodes.unionAll(top), "nodes")
    # a node's own saving stands once, on the path of its smallest member; a path's savings from a place down are that member's share
    own = nodes.where("depth > 0").select("request", "depth", ((F.col("requests") - 1) * F.col("words")).alias("own"))
    shares = _blockwise(paths.join(own, ["request", "depth"], "left").withColumn("own", F.coalesce("own", F.lit(0))),
                        "saved", F.sum, "own", key="request", place="depth", descending=True)
    shares = scratch.keep(shares.select(*NODE, "depth", "saved"), "shares")

    listed = ranked(ends, "at", ("request",), keys=NODE, keep=lambda df: scratch.keep(df, "listed"))
    chunks = listed.groupBy(*NODE, F.floor(F.col("at") / CHUNK).alias("chunk")) \
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list("request")), lambda r: r.cast("string")), ",").alias("text"))
    lists = chunks.repartition(*NODE).sortWithinPartitions(*NODE, "chunk").select(*NODE, "text").mapInArrow(_hashed, "n1 bigint, n2 bigint, ends string")

    none = {"child": F.lit(0).cast("bigint"), "saved": F.lit(0).cast("bigint"), "ends": F.lit(None).cast("string")}
    facts = [nodes.where("depth > 0").select(F.col("p1").alias("n1"), F.col("p2").alias("n2"), F.lit(1).cast("bigint").alias("child"), none["saved"].alias("saved"), none["ends"].alias("ends")),
             shares.select(*NODE, none["child"], "saved", none["ends"]),
             shares.where("depth = 1").select(*root, none["child"], "saved", none["ends"]),
             lists.select(*NODE, none["child"], none["saved"], "ends")]
    facts = facts[0].unionAll(facts[1]).unionAll(facts[2]).unionAll(facts[3])
    facts = facts.groupBy(*NODE).agg(F.sum("child").alias("children"), F.sum("saved").alias("saved_tokens"), F.max("ends").alias("ends"))
    named = nodes.where("depth > 0").select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("request").alias("parent_request"))
    first = nodes.where("depth = 0").select("request").first()  # one row
    deep = nodes.where("depth > 1").join(named, ["p1", "p2"]).select(*NODE, "request", "depth", "requests", "leaves", "parent_request")
    high = nodes.where("depth <= 1").select(*NODE, "request", "depth", "requests", "leaves", F.when(
        F.col("depth") == 1, F.lit(first[0] if first else None)).cast(dict(nodes.dtypes)["request"]).alias("parent_request"))
    return deep.unionAll(high).join(facts, list(NODE), "left").select(
        "request", "depth", "parent_request", "requests", F.coalesce("children", F.lit(0)).alias("children"), "leaves",
        F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))
