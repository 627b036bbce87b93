"""Prefix trie of conversations: what beginnings are shared, and what sharing them saves.

1. A turn is its SHA-256 digest and its text's length; texts go no further.  Equal conversations
   become one class with their number; their ids are joined to a digest over sorted pieces.
2. Classes are dealt by a hash of their first turn's digest.  In applyInPandas a trie is built for
   all first turns of a group: nodes are rows of lists, a node's children a dictionary from the next
   turn's digest to the child's row; a postorder with a stack of its own sums the subtrees.
3. First turns under which there are too many turns for one group are split before: their classes
   are dealt by the next turn as well, again and again while a group is too large.  The nodes above
   the split, the root among them, are summed from the tops of the groups below, level by level.

Groups are bounded by GROUP turns (those of one class, a conversation, stay together)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, join_spread, materialise, shuffle_partitions, table

#: Turns that a group may hold; where tasks get fewer each, a quarter of a task's share, but not under LEAST.
GROUP, LEAST = 200_000, 512
#: Ids that are joined to one piece of text.
PIECE = 20_000
NOTHING = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: A group's nodes, and of its tops what the level above needs.
FOUND = NODE + ", top boolean, above binary"


def turn_digest(role: Column, text: Column) -> Column:
    """Of a role and a text, told apart by the role's length in code points in front."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def numbered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns) with an array of (digest, size) of each conversation in order of turn, nulls first,
    those of one turn by digest.  Null roles and texts are empty; rows without a conv_id are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).cast("long").alias("turn"), turn_digest(role, text).alias("digest"), F.length(text).cast("long").alias("size")).alias("t")
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return whole.select("conv_id", F.transform("ts", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns"))


def grafted(numbered: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, turns): each conversation c with the first h turns of conversation c - c % block in front of
    its own turns behind its first h; h is crc32 of c in decimals, modulo `most`."""
    n = numbered.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int"))
    heads = numbered.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, most).alias("_head"))
    n = n.withColumn("_base", F.col("conv_id") - F.col("conv_id") % block).join(heads, "_base", "left")
    none = F.slice("turns", 1, 0)
    head = F.slice(F.coalesce("_head", none), F.lit(1), F.col("h"))
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return n.select("conv_id", F.concat(head, own).alias("turns"))


def id_digests(members: DataFrame, key: str) -> DataFrame:
    """(key, ends_sha256): the SHA-256 of each key's conv_ids in decimals, rising, joined by commas.

    Rows are dealt by ranges of key and id, so a key that very many have is dealt over many tasks;
    they join its ids to pieces, and a key's pieces are put in order and digested one after the other."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([held[0]], pa.int64()), pa.array([",".join(map(str, held))])], names=[key, "first", "ids"])

        now, held = None, []
        for batch in batches:
            for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (k != now or len(held) >= PIECE):
                    yield out()
                    held = []
                now = k
                held.append(i)
        if held:
            yield out()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], names=[key, "ends_sha256"])

        now, digest = None, None
        for batch in batches:
            for k, ids in zip(batch.column(0), batch.column(2), strict=True):
                k = k.as_py()
                if digest is not None and k != now:
                    yield out()
                    digest = None
                if digest is None:
                    now, digest = k, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.as_buffer().to_pybytes())
        if digest is not None:
            yield out()

    parts = shuffle_partitions(members.sparkSession)
    dealt = members.select(key, "conv_id").repartitionByRange(parts, key, "conv_id").sortWithinPartitions(key, "conv_id")
    joined = dealt.mapInArrow(pieces, f"{key} binary, first long, ids string")
    return joined.repartition(parts, key).sortWithinPartitions(key, "first").mapInArrow(digests, f"{key} binary, ends_sha256 string")


def _tries(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of all subtries whose tops' keys the rows (above, level, path, sizes, n, conv_id, ends_sha256) share
    in groups; a row's path begins with its top, at depth level + 1."""
    tops: dict[tuple[bytes, bytes], int] = {}
    children: list[dict[bytes, int]] = []
    parent, depth, size, n_convs, conv, ends, above = [], [], [], [], [], [], []

    def node(up: int, d: int, chars: int, over: bytes | None) -> int:
        children.append({})
        for column, value in ((parent, up), (depth, d), (size, chars), (n_convs, 0), (conv, None), (ends, NOTHING), (above, over)):
            column.append(value)
        return len(parent) - 1

    for over, level, path, sizes, n, least, sha in zip(rows["above"], rows["level"], rows["path"], rows["sizes"], rows["n"], rows["conv_id"], rows["ends_sha256"], strict=True):
        at = -1
        for k, (digest, chars) in enumerate(zip(path, sizes, strict=True)):
            known = tops if at < 0 else children[at]
            step = (over, digest) if at < 0 else digest
            to = known.get(step)
            if to is None:
                to = known[step] = node(at, level + 1 + k, chars, over if at < 0 else None)
            at = to
            n_convs[at] += n
            if conv[at] is None or least < conv[at]:
                conv[at] = least
        ends[at] = sha
    leaves, saved = [0] * len(parent), [0] * len(parent)
    for top in tops.values():
        stack = [(top, iter(children[top].values()))]
        while stack:
            at, rest = stack[-1]
            child = next(rest, None)
            if child is not None:
                stack.append((child, iter(children[child].values())))
                continue
            stack.pop()
            leaves[at] += not children[at]
            saved[at] += (n_convs[at] - 1) * size[at]
            if stack:
                leaves[stack[-1][0]] += leaves[at]
                saved[stack[-1][0]] += saved[at]
    up = pd.array([None if p < 0 else conv[p] for p in parent], dtype="Int64")
    return pd.DataFrame({
        "conv_id": conv, "depth": depth, "parent_conv_id": up, "n_convs": n_convs, "n_children": [len(c) for c in children], "n_leaves": leaves, "saved_tokens": saved,
        "ends_sha256": ends, "top": [p < 0 for p in parent], "above": above,
    })


def prefix_trie(conversations: DataFrame, group: int | None = None) -> DataFrame:
    """NODE for each distinct beginning of the conversations (conv_id, turns: an array of (digest, size)), from the
    root without a turn (depth 0) on: its least member, its parent's, its members, children, childless nodes
    below or itself, code points saved by it and all below, and the digest of the ids that end at it.

    Conversations are told apart by their turns' digests; conv_ids are unique.  One without turns ends at the root.  No
    conversations give no nodes.  `group` bounds the turns of a group (see GROUP)."""
    spark = conversations.sparkSession
    path = F.transform("turns", lambda t: t["digest"])
    whole = F.unhex(F.sha2(F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "")), 256))
    members = materialise(conversations.select("conv_id", "turns", whole.alias("whole")), "members")
    classes = members.groupBy("whole").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), F.first("turns").alias("turns"))
    classes = classes.join(id_digests(members, "whole").hint("merge"), "whole")
    sizes = F.transform("turns", lambda t: t["size"])
    classes = materialise(classes.select("conv_id", "n", "ends_sha256", path.alias("path"), sizes.alias("sizes")), "classes")
    discard(members)
    turns = classes.agg(F.sum(F.size("path"))).first()[0] or 0
    limit = group or max(LEAST, min(GROUP, turns // (4 * shuffle_partitions(spark))))

    # level by level: what goes into groups now, and the nodes above a split
    waiting, level = classes.withColumn("above", F.lit(b"")), 0
    groups, ended, split = [], [], []
    while True:
        ended.append(waiting.where(F.size("path") == level).select("above", "conv_id", "n", "ends_sha256"))
        under = waiting.where(F.size("path") > level)
        # a top is known by all turns up to it
        under = under.withColumn("top", F.unhex(F.sha2(F.concat("above", F.get("path", F.lit(level))), 256)))
        under = materialise(under, "level")
        large = under.groupBy("top").agg(F.sum(F.size("path") - level).alias("work"), F.count(F.lit(1)).alias("rows"))
        large = materialise(large.where((F.col("work") > limit) & (F.col("rows") > 1)), "large")
        dealt = join_spread(under, large, ["top"], "rows", ["conv_id"], how="left").withColumn("level", F.lit(level))
        groups.append(dealt.where("work is null"))
        if large.isEmpty():
            break
        on = dealt.where("work is not null")
        split.append(on.groupBy("top").agg(F.first("above").alias("over"), F.first(F.get("sizes", F.lit(level))).alias("size")))
        waiting = on.select("conv_id", "n", "ends_sha256", "path", "sizes", F.col("top").alias("above"))
        level += 1

    found = []
    for k, rows in enumerate(groups):
        rows = rows.select("above", "level", F.slice("path", k + 1, 1 << 30).alias("path"), F.slice("sizes", k + 1, 1 << 30).alias("sizes"), "n", "conv_id", "ends_sha256", F.col("top").alias("_top"))
        buckets = max(4 * shuffle_partitions(spark), turns // limit + 1)
        dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("_top"), F.lit(buckets))).drop("_top")
        found.append(dealt.groupBy("bucket").applyInPandas(_tries, FOUND))
    nodes = [materialise(f, "nodes") for f in found]

    # from the deepest split up: a node's children are the tops of groups and the split nodes below it
    out = [n.where("not top").select(*_names()) for n in nodes]
    below: DataFrame | None = None
    for k in range(level, -1, -1):
        tops = nodes[k].where("top").select("above", *_names())
        tops = tops if below is None else tops.unionByName(below)
        sums = tops.groupBy("above").agg(
            F.min("conv_id").alias("c"), F.sum("n_convs").alias("m"), F.count(F.lit(1)).alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
        )
        own = ended[k].select("above", F.col("conv_id").alias("c"), F.col("n").alias("m"), F.col("ends_sha256").alias("sha"))
        both = sums.withColumn("sha", F.lit(None).cast("string")).unionByName(own, allowMissingColumns=True)
        node = both.groupBy("above").agg(
            F.min("c").alias("conv_id"), F.sum("m").alias("n_convs"), F.coalesce(F.sum("kids"), F.lit(0)).alias("n_children"), F.coalesce(F.sum("leaves"), F.lit(1)).alias("n_leaves"),
            F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens"), F.coalesce(F.max("sha"), F.lit(NOTHING)).alias("ends_sha256"),
        )
        node = materialise(node, "above")
        ups = node.select("above", F.col("conv_id").alias("up"), "n_children")
        placed = join_spread(tops, ups.withColumnRenamed("n_children", "_kids"), ["above"], "_kids", ["conv_id"]).withColumn("parent_conv_id", F.col("up"))
        out.append(placed.select(*_names()))
        if k:
            info = split[k - 1].select(F.col("top").alias("above"), "over", "size")
            full = node.join(info, "above").withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("size"))
            full = full.select(F.col("over").alias("above"), "conv_id", F.lit(k).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
            below = materialise(full, "below")
        else:
            out.append(node.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def _names() -> list[str]:
    return [x.split()[0] for x in NODE.split(", ")]


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(grafted(numbered_turns(table(spark, sf_dir, "conversations"))))

