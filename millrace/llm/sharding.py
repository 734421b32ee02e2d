"""Shards by a consistent-hash ring with virtual nodes and bounded loads, natively.

The ring has a fixed number of cells. Each shard owns many virtual nodes, placed by a
hash; a key belongs to the cell of its hash, and wants the shard of the next node
clockwise. A shard has a bounded capacity: keys that find it full continue clockwise to
the next shard with room, so that loads are balanced by construction, and few keys are
far from where they would be on an unbounded ring.

Only the number of keys in each cell decides how many of them each shard takes, and those
are as many numbers as the ring has cells, however large the table. Waves run over the
cells in ring order: each gives the first shard clockwise with room what fits, and what
is left goes on in the next wave; a wave places all or fills a shard. The outcome, a few
ranges of ranks in each cell with the shard and the first slot, is broadcast. Rows find
their rank by a count per bucket of their cell and a number within the bucket; a cell has
as many buckets as its number of rows asks for. Equal rows are one row with a count until
the end, so neither a frequent id nor a frequent row is one task's work.

Defined results: a null text has no bytes; a null id is a key like any other. Equal rows
are placed each, next to each other. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.copies import numbered_copies
from millrace.llm.batches import free_name

CELLS = 4096
REPLICAS = 64
#: Rows that one bucket of a cell holds, about.
BUCKET_ROWS = 20_000
HASH_RANGE = 1 << 32


def hashed(column):
    """32 bits of a hash that other engines have too."""
    return F.conv(F.substring(F.md5(column), 1, 8), 16, 10).cast("long")


def key_cell(key, cells=CELLS):
    return F.pmod(hashed(F.coalesce(key.cast("string"), F.lit(""))), F.lit(cells)).cast("int")


def virtual_nodes(spark: SparkSession, shards: int, replicas=REPLICAS, cells=CELLS):
    """Sorted (cell, shard) of all virtual nodes."""
    nodes = spark.range(shards * replicas).select(
        (F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("replica")
    )
    cell = F.pmod(hashed(F.concat_ws("-", F.lit("shard"), "shard", "replica")), F.lit(cells))
    return sorted((r["cell"], r["shard"]) for r in nodes.select(cell.alias("cell"), "shard").collect())


def preferences(nodes, cells=CELLS):
    """For each cell, all shards in the order in which a key there meets them clockwise."""
    places = [cell for cell, _ in nodes]
    found = {}
    out = []
    for cell in range(cells):
        at = bisect.bisect_left(places, cell) % len(nodes)
        if at not in found:
            found[at] = list(dict.fromkeys(s for _, s in nodes[at:] + nodes[:at]))
        out.append(found[at])
    return out


def capacities(counts, prefer, shards, slack=0.0):
    """Room of each shard: an equal part, and one row more for those most asked for; with
    `slack`, so much more for all."""
    total = sum(counts)
    if slack:
        return [-(-int(total * (1 + slack)) // shards)] * shards
    wanted = [0] * shards
    for n, shard in zip(counts, prefer, strict=True):
        wanted[shard[0]] += n
    more = set(sorted(range(shards), key=lambda s: (-wanted[s], s))[: total % shards])
    return [total // shards + (s in more) for s in range(shards)]


def placed(counts, prefer, room):
    """(cell, first rank, end rank, shard, first slot) of all ranges of ranks that go together."""
    left, done, used = list(counts), [0] * len(counts), [0] * len(room)
    ranges = []
    while any(left):
        full = [u >= r for u, r in zip(used, room, strict=True)]
        for cell, n in enumerate(left):
            if not n:
                continue
            shard = next(s for s in prefer[cell] if not full[s])
            take = min(n, room[shard] - used[shard])
            if take:
                ranges.append((cell, done[cell], done[cell] + take, shard, used[shard]))
                used[shard] += take
                done[cell] += take
                left[cell] -= take
    return ranges


def _small_table(spark, rows, schema):
    """A table of plain rows as one literal."""
    data = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return spark.range(1).select(F.inline(data))


def sharded(
    docs: DataFrame, shards: int, key="doc_id", shard="shard", slot="slot", slack=0.0,
    replicas=REPLICAS, cells=CELLS, bucket_rows=BUCKET_ROWS,
) -> DataFrame:
    """Rows of `docs` with the number of their shard and a gapless number within it.

    Columns of `docs` are compared and counted as values: keep wide ones out and join them
    back, as equal rows are counted before they are placed.
    """
    spark = docs.sparkSession
    names = ("cell", "bucket", "order", "n", "rank", "end", "number", "size", "base", "parts", "ranges", "range")
    cell, bucket, order, n, rank, end, number, size, base, parts, ranges, part = (free_name(docs, f"_{c}") for c in names)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    found = key_cell(F.col(f"`{key}`"), cells)
    counts = [0] * cells
    for r in docs.groupBy(found.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["cell"]] = r["n"]
    prefer = preferences(virtual_nodes(spark, shards, replicas, cells), cells)
    plan = {}
    for c, low, high, s, first in placed(counts, prefer, capacities(counts, prefer, shards, slack)):
        plan.setdefault(c, []).append({"low": low, "high": high, "shard": s, "first": first})
    plan = [{cell: c, parts: -(-counts[c] // bucket_rows), ranges: r} for c, r in plan.items()]
    kind = "array<struct<low: long, high: long, shard: int, first: long>>"
    plan = _small_table(spark, plan, f"{cell}: int, {parts}: long, {ranges}: {kind}")
    # Rows of a cell stand in the order of a hash of all their columns; a bucket is a
    # range of that hash.
    text = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    rows = docs.groupBy(*columns).agg(F.count(F.lit(1)).alias(n)).withColumn(cell, key_cell(F.col(f"`{key}`"), cells))
    rows = rows.withColumn(order, F.md5(text)).join(F.broadcast(plan), cell)
    at = F.conv(F.substring(order, 1, 8), 16, 10).cast("long")
    rows = rows.withColumn(bucket, F.floor(at * F.col(parts) / HASH_RANGE).cast("long"))
    before = Window.partitionBy(cell).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(cell, bucket).agg(F.sum(n).alias(size))
    sizes = sizes.select(cell, bucket, F.coalesce(F.sum(size).over(before), F.lit(0)).alias(base))
    within = Window.partitionBy(cell, bucket).orderBy(order, *columns)
    rows = rows.withColumn(rank, F.sum(n).over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col(n))
    rows = rows.join(sizes, [cell, bucket]).withColumn(rank, F.col(rank) + F.col(base))
    rows = rows.withColumn(end, F.col(rank) + F.col(n))
    met = F.filter(ranges, lambda x: (x["low"] < F.col(end)) & (x["high"] > F.col(rank)))
    rows = rows.select(*columns, rank, end, F.explode(met).alias(part))
    low, high = F.greatest(rank, F.col(part)["low"]), F.least(end, F.col(part)["high"])
    rows = rows.select(
        *columns, F.col(part)["shard"].alias(shard), (high - low).alias(n),
        (F.col(part)["first"] + low - F.col(part)["low"]).alias(slot),
    )
    rows = numbered_copies(rows, n, number)
    return rows.select(*columns, shard, (F.col(slot) + F.col(number)).alias(slot))


def report(docs: DataFrame, shards=8) -> DataFrame:
    """Per document: its size, digest, shard and slot; the shards' rows differ by one at most."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(1).cast("long")).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return sharded(rows, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
