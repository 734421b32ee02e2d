"""Approximate nearest neighbours by a permutation index.

Pivots are chosen from a bounded sample of the vectors, each next one the farthest from
those before, so that a group of like vectors gives few of them. Every vector is
represented by its POSTED nearest pivots in order. Vectors are indexed in blocks: each
block holds one inverted file per pivot, with the vectors of the block that have it among
their nearest, and at which place. A query walks the files of its own nearest pivots
alone. Each posting adds what the footrule distance falls short of its most: a pivot that
one of them lacks counts as if it stood behind the last place. The share of a block that
is nearest so, and all vectors that are nearly as near as can be, are ranked by the exact
measure. These last matter where many vectors are nearly the same: more of them than the
share are still all ranked.

Inner products depend on lengths and orders of pivots do not, so vectors first get one
more component that brings them to equal length (none for queries), which makes the
nearest in angle the largest in inner product.

Queries are broadcast in blocks of bounded size, and each index block answers all of
them; only its best are shuffled.

Defined results: vectors that are null, empty, zero, of another length than most, or
with null or non-finite components take no part. Rows repeated under one id are
candidates each, but none of a query's own id; the query's vector is then the lowest of
its id. Ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.session import scratch_path

#: Pivots, and those of them that a vector is posted under.
PIVOTS, POSTED = 512, 64
#: Vectors that pivots are chosen from at most.
PIVOT_SAMPLE = 2048
NEAREST = 20
#: Share of a block that is ranked exactly, and the share of the footrule's most from
#: which on all are.
SHARE, ALIKE = 0.3, 0.85
BLOCK_QUERIES = 16_384
BATCH_ROWS = 8192


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector) of the vectors that take part, in double precision."""
    vector = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
    rows = rows.where(
        "vec_id is not null and size(vector) > 0"
        " and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
        " and exists(vector, x -> x <> 0)"
    )
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n"))
    most = sizes.first()
    return rows.where(F.size("vector") == most["n"]) if most else rows


def _lifted(x, longest):
    """Rows of `x` with a last component that makes each as long as `longest`."""
    rest = np.sqrt(np.maximum(longest**2 - (x**2).sum(1), 0))
    return np.column_stack([x, rest])


def _order(nearness, posted):
    """For rows of nearness to each pivot: the nearest pivots, in order."""
    return np.argsort(-nearness, axis=1, kind="stable")[:, :posted].astype(np.int16)


def _files(order, pivots):
    """Inverted files of a block: where each pivot's begins, and vectors and places of all."""
    pivot = order.ravel()
    by_pivot = np.argsort(pivot, kind="stable")
    first = np.searchsorted(pivot[by_pivot], np.arange(pivots + 1))
    vector, place = np.divmod(by_pivot, max(1, order.shape[1]))
    return first.astype(np.int32), vector.astype(np.int32), place.astype(np.int16)


def _gains(order, first, vector, place, count):
    """By how much each of `count` vectors is nearer to a query than the farthest can be."""
    files = [slice(first[p], first[p + 1]) for p in order.tolist()]
    if not files:
        return np.zeros(count)
    stands = np.repeat(np.arange(len(order), dtype=np.int16), [f.stop - f.start for f in files])
    off = np.abs(np.concatenate([place[f] for f in files]) - stands)
    return np.bincount(np.concatenate([vector[f] for f in files]), weights=len(order) - off, minlength=count)


def _spread(x, count):
    """Up to `count` rows of `x`, each the farthest from those before."""
    chosen = [0]
    away = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < count and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


_BLOCK = "ids binary, vectors binary, first binary, members binary, places binary"


def build(vectors: DataFrame, pivots=PIVOTS, posted=POSTED):
    """The stored index, one row per block of vectors with its inverted files, the stored
    vectors (vec_id, vector), and the pivots."""
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    kept = scratch_path(spark, "vectors")
    usable(vectors).write.parquet(kept)
    rows = spark.read.parquet(kept)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(PIVOT_SAMPLE).collect()
    longest = rows.agg(F.sqrt(F.max(F.expr("aggregate(vector, 0D, (s, x) -> s + x * x)")))).first()[0] or 1.0
    given = np.array([r["vector"] for r in sample]) if sample else np.zeros((0, 1))
    lifted = _spread(_lifted(given, longest), pivots) if sample else given

    def post(batches):
        import pandas as pd

        for batch in batches:
            if len(batch):
                x = np.stack(batch["vector"].to_numpy())
                files = _files(_order(_lifted(x, longest) @ lifted.T, posted), len(lifted))
                columns = (batch["vec_id"].to_numpy(), x, *files)
                yield pd.DataFrame([[c.tobytes() for c in columns]], columns=["ids", "vectors", "first", "members", "places"])

    path = scratch_path(spark, "pivot-files")
    rows.mapInPandas(post, _BLOCK).write.parquet(path)
    return spark.read.parquet(path), rows, lifted


def search(
    index: DataFrame, pivots, queries: DataFrame, nearest=NEAREST, posted=POSTED, share=SHARE, alike=ALIKE
) -> DataFrame:
    """The `nearest` of the index to each of `queries` (vec_id, vector): query_id, rank,
    vec_id, score. Stated queries against all rows, in blocks of BLOCK_QUERIES."""
    spark = index.sparkSession
    # A row is a block of vectors.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    found = None
    for block in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).collect()
        if not part and block:
            continue
        ids = np.array([r["vec_id"] for r in part], np.int64)
        x = np.array([r["vector"] for r in part]) if part else np.zeros((0, 1))
        # A query has no last component: it adds nothing to an inner product.
        orders = _order(np.column_stack([x, np.zeros(len(x))]) @ pivots.T, posted) if part else np.zeros((0, 0), np.int16)
        shared = spark.sparkContext.broadcast((ids, x, orders))

        def answer(batches, shared=shared):
            import pandas as pd

            ids, x, orders = shared.value
            best = [(np.zeros(0, np.int64), np.zeros(0)) for _ in ids]
            for batch in batches:
                for row in batch.itertuples(index=False):
                    names = np.frombuffer(row.ids, np.int64)
                    vectors = np.frombuffer(row.vectors, np.float64).reshape(len(names), -1)
                    first, members = np.frombuffer(row.first, np.int32), np.frombuffer(row.members, np.int32)
                    places = np.frombuffer(row.places, np.int16)
                    # One more than asked for, as the query itself may be among them.
                    count = min(len(names), max(int(np.ceil(share * len(names))), nearest + 1))
                    for i in range(len(ids)):
                        gain = _gains(orders[i].astype(np.int64), first, members, places, len(names))
                        least = min(np.partition(gain, -count)[-count], alike * orders.shape[1] ** 2)
                        near = np.flatnonzero((gain >= least) & (names != ids[i]))
                        # Row by row, so that equal vectors get equal scores.
                        score = (vectors[near] * x[i]).sum(1)
                        name = np.concatenate([best[i][0], names[near]])
                        score = np.concatenate([best[i][1], score])
                        if len(name) > nearest:
                            keep = np.flatnonzero(score >= np.partition(score, -nearest)[-nearest])
                            keep = keep[np.lexsort((name[keep], -score[keep]))[:nearest]]
                            name, score = name[keep], score[keep]
                        best[i] = name, score
            if len(ids):
                yield pd.DataFrame(
                    {
                        "query_id": np.repeat(ids, [len(b[0]) for b in best]),
                        "vec_id": np.concatenate([b[0] for b in best]),
                        "score": np.concatenate([b[1] for b in best]),
                    }
                )

        rows = index.mapInPandas(answer, "query_id long, vec_id long, score double")
        found = rows if found is None else found.unionByName(rows)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest)
    return ranked.select("query_id", "rank", "vec_id", "score")


def report(vectors: DataFrame) -> DataFrame:
    """Neighbours of every vector whose id is divisible by 20, among all others."""
    index, rows, pivots = build(vectors)
    queries = rows.where("vec_id % 20 = 0").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    return search(index, pivots, queries)
