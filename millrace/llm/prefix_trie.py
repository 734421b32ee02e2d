"""The prefix trie of conversations, by a skeleton of splitters and sorted shards.

A conversation is a path: one 16-byte digest of role and text per turn, in order. Each
distinct prefix is a node. Paths are dealt to shards by splitters drawn from a sample, and
sorted within a shard, so the members of a node stand side by side:

1. A node whose members lie in several shards is a prefix of a splitter between them. The
   trie of the splitter paths, the skeleton, is broadcast; it holds at most
   SKELETON_NODES nodes, as splitters are cut to that depth.
2. Each shard goes once over its sorted rows with a stack as deep as one path. Nodes
   outside the skeleton have all their members there and are finished in place. For
   nodes of the skeleton the shard gives partial counts, and its members' ids in order.
3. Partial counts are reduced by node in Spark; sums over subtrees then go up the
   skeleton, and its nodes' ids become the parents of what hangs below them.

Equal paths are cut by id as well, so a conversation that a third of all share is spread
over the shards. Its digest of ids is sequential by nature: shards write the ids as
chunks of text, and one task per node reads these in order.

A conversation is one row of digests and sizes, 20 bytes a turn, without texts.

Defined results: null roles and texts are empty. Turns stand by number, nulls first, then
by role and the MD5 of the text; repeated turns stay. Rows without a conversation id
belong to none. A conversation without turns is a member of the root. An empty table has
no nodes, not even the root.
"""

from __future__ import annotations

import bisect
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.llm.batches import small_batches
from millrace.session import scratch_path

#: Bound on the broadcast trie, and sampled paths per shard.
SKELETON_NODES = 200_000
SAMPLED = 20
#: Characters of one chunk of member ids, and rows of one output batch.
CHUNK = 1 << 16
OUT_ROWS = 5000
WIDTH = 16

NODE, PARTIAL, ENDS = range(3)
PARTS = T.StructType(
    [
        T.StructField("kind", T.IntegerType()),
        T.StructField("skeleton", T.IntegerType()),
        *[T.StructField(n, T.LongType()) for n in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")],
        T.StructField("ends", T.StringType()),
    ]
)


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """Per `conv_id`: its `turns` in order, each with its digest `key` and `size` in code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.unhex(F.md5(text)), F.encode(role, "UTF-8"))))
    turn = F.struct("turn", role.alias("role"), F.md5(text).alias("md5"), key.alias("key"), F.length(text).alias("size"))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return turns.select("conv_id", F.transform("t", lambda t: F.struct(t["key"].alias("key"), t["size"].alias("size"))).alias("turns"))


def with_heads(turns: DataFrame, every=100, most=6) -> DataFrame:
    """Conversations rebuilt: the first h turns are those of conversation c - c % `every`,
    where h is the CRC-32 of the id modulo `most`; its own turns after its first h follow."""
    head = turns.where(F.col("conv_id") % every == 0)
    head = head.select(F.col("conv_id").alias("_base"), F.slice("turns", 1, most - 1).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    df = turns.withColumn("_h", h).withColumn("_of", F.col("conv_id") - F.col("conv_id") % every)
    df = df.join(head, F.col("_of") == F.col("_base"), "left")
    first = F.coalesce(F.slice("_head", F.lit(1), F.col("_h")), F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns") - F.col("_h"), F.lit(0)))
    return df.select("conv_id", F.concat(first, rest).alias("turns"))


def _paths(turns):
    keys = F.transform("turns", lambda t: F.hex(t["key"]))
    return turns.select(
        "conv_id",
        F.unhex(F.array_join(keys, "")).alias("path"),
        F.transform("turns", lambda t: t["size"].cast("int")).alias("sizes"),
    )


def _steps(path):
    return [path[i : i + WIDTH] for i in range(0, len(path), WIDTH)]


class Skeleton:
    """Splitters of sorted (path, id) rows, and the trie of their paths.

    `below` maps (node, turn digest) to a node; node 0 is the root. Parents come before
    their children.
    """

    def __init__(self, rows, shards):
        rows = sorted(rows)
        chosen = [rows[len(rows) * k // shards] for k in range(1, shards)] if rows else []
        self.splitters = [(path, conv) for path, conv, _ in chosen]
        self.below, self.parent, self.size, self.depth = {}, [-1], [0], [0]
        for path, _, sizes in chosen:
            at = 0
            for step, size in zip(_steps(path), sizes, strict=False):
                found = self.below.get((at, step))
                if found is None:
                    found = self.below[at, step] = len(self.parent)
                    self.parent.append(at)
                    self.size.append(size)
                    self.depth.append(self.depth[at] + 1)
                at = found

    def shard(self, path, conv):
        return bisect.bisect_right(self.splitters, (path, conv))


class Frame:
    """A node that is still open: its members are passing by."""

    __slots__ = ("step", "skeleton", "size", "n", "least", "children", "leaves", "saved", "ends", "listed", "waiting")

    def __init__(self, step, skeleton, size):
        self.step, self.skeleton, self.size = step, skeleton, size
        self.n = self.children = self.leaves = self.saved = self.listed = 0
        self.least, self.waiting = None, []
        self.ends = [] if skeleton >= 0 else hashlib.sha256()


class Shard:
    """One pass over the sorted rows of a shard; `out` gathers rows of PARTS."""

    def __init__(self, below):
        self.below, self.out = below, []
        self.stack = []

    def add(self, path, conv, sizes):
        steps, stack = _steps(path), self.stack
        if not stack:
            stack.append(Frame(b"", 0, 0))
        same = 0
        while same < len(steps) and same + 1 < len(stack) and stack[same + 1].step == steps[same]:
            same += 1
        while len(stack) > same + 1:
            self._close()
        for step, size in zip(steps[same:], sizes[same:], strict=True):
            above = stack[-1].skeleton
            stack.append(Frame(step, self.below.get((above, step), -1) if above >= 0 else -1, size))
        top = stack[-1]
        top.n += 1
        top.least = conv if top.least is None else min(top.least, conv)
        if top.skeleton < 0:
            top.ends.update((b"," if top.listed else b"") + str(conv).encode())
        else:
            top.ends.append((conv, str(conv)))
            if len(top.ends) * 8 > CHUNK:
                self._write_ends(top)
        top.listed += 1

    def _write_ends(self, frame):
        if frame.ends:
            text = ",".join(t for _, t in frame.ends)
            self.out.append((ENDS, frame.skeleton, frame.ends[0][0], None, None, None, None, None, None, text))
            frame.ends = []

    def _close(self):
        frame = self.stack.pop()
        above = self.stack[-1] if self.stack else None
        if above:
            above.n += frame.n
            above.least = frame.least if above.least is None else min(above.least, frame.least)
        if frame.skeleton >= 0:
            self._write_ends(frame)
            self.out.append(
                (PARTIAL, frame.skeleton, frame.least, None, None, frame.n, frame.children, frame.leaves, frame.saved, None)
            )
            return
        depth = len(self.stack)
        frame.leaves += not frame.children
        frame.saved += (frame.n - 1) * frame.size
        above.children += 1
        above.leaves += frame.leaves
        above.saved += frame.saved
        for row in frame.waiting:
            self.out.append((*row[:4], frame.least, *row[5:]))
        row = (NODE, above.skeleton, frame.least, depth, None, frame.n, frame.children, frame.leaves, frame.saved, frame.ends.hexdigest())
        # The smallest id of the node above is known once it is closed, or reduced.
        (self.out if above.skeleton >= 0 else above.waiting).append(row)

    def end(self):
        while self.stack:
            self._close()


def _batch(rows, schema):
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _shard_parts(sharded, shared):
    arrow = to_arrow_schema(PARTS)

    def run(batches):
        shard = Shard(shared.value.below)
        for batch in batches:
            path, conv, sizes = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("path", "conv_id", "sizes"))
            for row in zip(path, conv, sizes, strict=True):
                shard.add(*row)
                if len(shard.out) >= OUT_ROWS:
                    yield _batch(shard.out, arrow)
                    shard.out = []
        shard.end()
        for i in range(0, len(shard.out), OUT_ROWS):
            yield _batch(shard.out[i : i + OUT_ROWS], arrow)

    return sharded.mapInArrow(run, PARTS)


def _digests(chunks, parts):
    """(skeleton, ends): the digest of the ids of each node, from chunks in order."""
    schema = T.StructType([T.StructField("skeleton", T.IntegerType()), T.StructField("ends", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        node, digest = None, None
        for batch in batches:
            for at, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if at != node:
                    if digest:
                        yield _batch([(node, digest.hexdigest())], arrow)
                    node, digest = at, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(text.encode())
        if digest:
            yield _batch([(node, digest.hexdigest())], arrow)

    ordered = chunks.repartition(parts, "skeleton").sortWithinPartitions("skeleton", "conv_id")
    return ordered.select("skeleton", "ends").mapInArrow(run, schema)


def nodes(turns: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations (`conv_id`, `turns`): `conv_id` (the smallest
    member), `depth`, `parent_conv_id`, `n_convs`, `n_children`, `n_leaves`, `saved_tokens`
    and `ends_sha256`. Turn number `depth` of conversation `conv_id` is the node's text."""
    spark = turns.sparkSession
    small_batches(spark)
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = scratch_path(spark, "trie-paths")
    _paths(turns).write.parquet(stored)
    paths = spark.read.parquet(stored)
    depth = max(8, SKELETON_NODES // shards)
    share = shards * SAMPLED / max(1, paths.count())
    sample = paths.where(F.pmod(F.xxhash64("conv_id"), F.lit(1 << 32)) < int(share * (1 << 32)))
    sample = sample.select(F.substring("path", 1, WIDTH * depth).alias("path"), "conv_id", F.slice("sizes", 1, depth).alias("sizes"))
    skeleton = Skeleton([(bytes(r["path"]), r["conv_id"], r["sizes"]) for r in sample.collect()], shards)
    shared = spark.sparkContext.broadcast(skeleton)

    dealt_schema = T.StructType([*paths.schema.fields, T.StructField("shard", T.IntegerType())])
    dealt_arrow = to_arrow_schema(dealt_schema)

    def deal(batches):
        find = shared.value.shard
        for batch in batches:
            keys = zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True)
            number = pa.array([find(p, c) for p, c in keys], pa.int32())
            columns = [batch.column(i).cast(dealt_arrow.field(i).type) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, number], schema=dealt_arrow)

    dealt = paths.select("conv_id", "path", "sizes").mapInArrow(deal, dealt_schema)
    dealt = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("path", "conv_id")
    made = scratch_path(spark, "trie-parts")
    _shard_parts(dealt, shared).write.parquet(made)
    shared.unpersist()
    parts = spark.read.schema(PARTS).parquet(made)

    # The skeleton: reduced in Spark, then summed from its deepest nodes up.
    reduced = parts.where(F.col("kind") == PARTIAL).groupBy("skeleton").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    )
    found = {r["skeleton"]: r for r in reduced.collect()}
    children, leaves, saved = ([0] * len(skeleton.parent) for _ in range(3))
    rows = []
    for node in range(len(skeleton.parent) - 1, -1, -1):
        if node not in found:
            continue
        r, above = found[node], skeleton.parent[node]
        children[node] += r["n_children"]
        leaves[node] += r["n_leaves"] + (not children[node])
        saved[node] += r["saved_tokens"] + (r["n_convs"] - 1) * skeleton.size[node]
        if above >= 0:
            children[above] += 1
            leaves[above] += leaves[node]
            saved[above] += saved[node]
        upper = found[above]["conv_id"] if above >= 0 else None
        rows.append((node, r["conv_id"], skeleton.depth[node], upper, r["n_convs"], children[node], leaves[node], saved[node]))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    upper = spark.createDataFrame(rows, "skeleton int, " + ", ".join(f"{n} long" for n in names))
    digests = _digests(parts.where(F.col("kind") == ENDS), shards)
    none = hashlib.sha256().hexdigest()
    top = upper.join(digests, "skeleton", "left").select(*names, F.coalesce("ends", F.lit(none)).alias("ends_sha256"))
    rest = parts.where(F.col("kind") == NODE).join(
        F.broadcast(upper.select("skeleton", F.col("conv_id").alias("_upper"))), "skeleton", "left"
    )
    rest = rest.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_upper"))
    return top.unionByName(rest.select(*names, F.col("ends").alias("ends_sha256")))


def with_texts(found: DataFrame, conversations: DataFrame) -> DataFrame:
    """Nodes of plain conversations with the `role` and `text` of their last turn; the root has none."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text")
    )
    from millrace.functions.groups import OrderedRows, each_group

    def numbered(rows: OrderedRows):
        return rows.running_sum("depth", F.lit(1).cast("long")).df

    turns = turns.withColumn("_md5", F.md5("text"))
    turns = each_group(turns, "conv_id", ["turn", "role", "_md5"], numbered).drop("turn", "_md5")
    return found.join(turns, ["conv_id", "depth"], "left")


def report(conversations: DataFrame) -> DataFrame:
    """Nodes of the rebuilt conversations."""
    return nodes(with_heads(conversation_turns(conversations)))
