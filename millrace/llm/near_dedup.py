"""Near-duplicate documents by SetSketch registers.

A document is the set of its five-word shingles. Its sketch holds, per register,
the minimum of the set's hash values on an exponentially spaced, truncated scale;
sketches of two sets merge to that of their union by the larger register, and a
register of two sets agrees with a probability close to their Jaccard similarity.

1. Equal sets become one class. Work after this is on classes.
2. Each class posts 48 bands of 4 registers. A pair at similarity 0.75 misses all
   of them with a probability of 1.2e-8.
3. In every bucket one central class is compared with all others, and linked classes
   become components: a bucket of near copies costs rows in proportion to its size.
4. Buckets that still hold several components are mostly texts that share a passage
   without being similar. Their classes are joined on rare shingles instead: with
   shingles in order of frequency, two similar sets share one in the part of each that
   is left when the needed overlap is taken off, at places that still allow it. This
   is exact, and shared passages, which come last, make no pairs.

A pair found in 3 or 4 is dropped if the joint likelihood of its registers rules the
threshold out, else it is verified on full sets.

Defined results: a null, empty or wordless text has an empty set, linked with
nothing. Rows with equal texts are of one class. A row with a null id takes part,
but never names a component. Repeated rows all get the same result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.functions.sizing import broadcast_if_small
from millrace.llm.batches import flat_rows, free_name, map_rows
from millrace.llm.components import components
from millrace.llm.hashing import BY_WHITE_SPACE, Words, distinct, mix, shingles
from millrace.session import checkpointed

SHINGLE = 5
#: Similarity that links two documents, in hundredths.
PERCENT = 75
BANDS, ROWS = 48, 4
REGISTERS = BANDS * ROWS
#: Base of the register scale: 16-bit registers then reach from 1 down to 2^-32.
BASE = 1.001
#: Log-likelihood distance at which the sketch rules a pair out (six deviations).
RULED_OUT = 18.0

_U32 = np.uint32
_MULTIPLY = (mix(np.arange(1, REGISTERS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(_U32) | _U32(1)
_ADD = (mix(np.arange(1001, REGISTERS + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(_U32)


def registers(values):
    """Sketch of a set of 64-bit shingle hashes, as 16-bit registers."""
    x = (values >> np.uint64(32)).astype(_U32) ^ values.astype(_U32)
    least = np.full(REGISTERS, 0xFFFFFFFF, _U32)
    for i in range(0, len(x), 256):
        h = x[i : i + 256, None] * _MULTIPLY
        h += _ADD
        np.minimum(least, h.min(axis=0), out=least)
    # The minimum of uniform values as an exponential one, then on the scale of BASE.
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, 0xFFFF).astype("<u2")


def merged(a, b):
    """Sketch of the union of two sets."""
    return np.maximum(a, b)


def _log_likelihood(similarity, u, v, above, below, equal):
    def p(x):
        return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = p(u - v * similarity), p(v - u * similarity)
    return above * np.log(up) + below * np.log(down) + equal * np.log(np.maximum(1 - up - down, 1e-12))


def likely_similarity(n_a, n_b, a, b):
    """(most likely similarity, how much likelier it is than the linking one), for
    arrays of set sizes and of sketches (one row each)."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    counts = (a > b).sum(1), (a < b).sum(1), (a == b).sum(1)
    most = np.minimum(u / v, v / u)
    grid = np.linspace(0.0, 1.0, 201)[:, None] * most
    values = _log_likelihood(grid, u, v, *counts)
    best = values.argmax(0)
    linking = _log_likelihood(np.minimum(PERCENT / 100, most), u, v, *counts)
    rows = np.arange(len(u))
    return grid[best, rows], values[best, rows] - linking


_SET = [
    T.StructField("n_shingles", T.LongType()),
    T.StructField("class", T.BinaryType()),
]


def _sets(texts):
    """Per text: distinct shingle hashes."""
    words = Words(texts, BY_WHITE_SPACE)
    owner, value = distinct(*shingles(words, SHINGLE))
    cut = np.searchsorted(owner, np.arange(1, len(texts)))
    return np.split(value, cut)


def _class(values):
    """128 bits that name a set."""
    if not len(values):
        return None
    sums = np.array([mix(values).sum(), mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()], "<u8")
    return sums.tobytes()


def _with_sets(docs, text, names):
    """`docs` with the size, class and sketch of each text's set."""
    fields = [
        T.StructField(n, t)
        for n, t in zip(names, [T.LongType(), T.BinaryType(), T.BinaryType()], strict=True)
    ]

    def prepare():
        def work(texts):
            sets = _sets(texts)
            return (
                [len(s) for s in sets],
                [_class(s) for s in sets],
                [registers(s).tobytes() if len(s) else None for s in sets],
            )

        return work

    return map_rows(docs, [text], fields, prepare, keep=[c for c in docs.columns if c != text])


def _buckets(classes):
    """(bucket, class) of every band; a bucket is a hash of its band's registers."""
    schema = T.StructType(
        [T.StructField("bucket", T.LongType()), T.StructField("class", T.BinaryType())]
    )
    weight = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64)).reshape(BANDS, ROWS)

    def prepare():
        def work(names, sketches):
            values = np.frombuffer(b"".join(sketches), "<u2").reshape(-1, BANDS, ROWS)
            keys = mix((mix(values.astype(np.uint64) + np.uint64(1)) * weight).sum(2))
            return keys.reshape(-1).view(np.int64), [n for n in names for _ in range(BANDS)]

        return work

    return flat_rows(classes, ["class", "sketch"], schema, prepare)


def _several(buckets, column, least=2):
    """Rows of `buckets` whose bucket holds `least` classes and several values of `column`."""
    mixed = buckets.groupBy("bucket").agg(
        F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(F.lit(1)).alias("n")
    )
    mixed = mixed.where((F.col("lo") != F.col("hi")) & (F.col("n") >= least))
    return buckets.join(mixed.select("bucket"), "bucket", "left_semi")


def _with_central(buckets):
    """Distinct pairs of one class of each bucket with the others.

    The class is the one with most company over all its buckets: of the copies of one
    text, that is likely the text they were made from, which is similar to them all.
    """
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    company = buckets.join(sizes, "bucket").groupBy("class").agg(F.sum("n").alias("company"))
    central = buckets.join(company, "class").groupBy("bucket").agg(
        F.max(F.struct("company", "class")).alias("most")
    )
    pairs = buckets.join(central.select("bucket", F.col("most.class").alias("a")), "bucket")
    pairs = pairs.where("class <> a").select(F.least("a", "class").alias("a"), F.greatest("a", "class").alias("b"))
    return pairs.distinct()


def _rare_shingles(members, sets):
    """(shingle, class, n, at) of the rare shingles of the classes in `members`: those at
    places that leave room for the overlap that a similar set needs. `sets` has `hashes`."""
    n = F.size("hashes")
    shingle = members.join(sets, "class").select("class", n.alias("n"), F.explode("hashes").alias("shingle"))
    often = shingle.groupBy("shingle").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    order = Window.partitionBy("class").orderBy("often", "shingle")
    ranked = shingle.join(often, "shingle", "left").withColumn("often", F.coalesce("often", F.lit(1)))
    ranked = ranked.withColumn("at", F.row_number().over(order) - 1)
    # A shingle of one class alone joins nothing, but keeps its place in the order.
    return ranked.where(
        (F.col("often") > 1) & (100 * (F.col("at") + 1) <= (100 - PERCENT) * F.col("n") + 100)
    ).drop("often")


def _sharing(rare):
    """Distinct pairs of classes of different roots that share a shingle of `rare` (shingle,
    class, root, n, at) where sets similar enough do."""

    def side(x):
        return rare.select(*[F.col(c).alias(f"{c}_{x}") for c in ("shingle", "class", "root", "n", "at")])

    overlap = F.expr(f"({PERCENT} * (n_a + n_b) + {PERCENT + 99}) div {100 + PERCENT}")
    pairs = side("a").join(
        side("b"),
        (F.col("shingle_a") == F.col("shingle_b"))
        & (F.col("class_a") < F.col("class_b"))
        & (F.col("root_a") != F.col("root_b"))
        & (F.col("at_a") <= F.col("n_a") - overlap)
        & (F.col("at_b") <= F.col("n_b") - overlap),
    )
    return pairs.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).distinct()


def _likely(pairs, classes):
    """Pairs that sizes and registers do not rule out."""
    side = classes.select("class", "n_shingles", "sketch")

    def named(x):
        return side.select(*[F.col(c).alias(n) for c, n in (("class", x), ("n_shingles", f"n_{x}"), ("sketch", f"s_{x}"))])

    joined = pairs.join(named("a"), "a").join(named("b"), "b")
    joined = joined.where(100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))

    def keep(batches):
        for batch in batches:
            if not len(batch):
                continue
            a, b = (np.stack([np.frombuffer(s, "<u2") for s in batch[c]]) for c in ("s_a", "s_b"))
            likely, worse = likely_similarity(
                batch["n_a"].to_numpy(float), batch["n_b"].to_numpy(float), a, b
            )
            yield batch.loc[(100 * likely >= PERCENT) | (worse < RULED_OUT), ["a", "b"]]

    return joined.mapInPandas(keep, "a binary, b binary")


def _full_sets(needed, classes, docs):
    """(class, hashes) of the classes in `needed`: one text of each is found by its hash,
    and its set made anew."""
    needed = needed.join(classes.select("class", "first_text"), "class").select("first_text")
    needed = broadcast_if_small(checkpointed(needed.distinct()))
    texts = docs.select("text", F.md5("text").alias("first_text")).join(needed, "first_text", "left_semi")
    texts = texts.groupBy("first_text").agg(F.min("text").alias("text"))
    schema = T.StructType(
        [T.StructField("class", T.BinaryType()), T.StructField("hashes", T.ArrayType(T.LongType()))]
    )

    def prepare():
        def work(given):
            sets = [s for s in _sets(given) if len(s)]
            return [_class(s) for s in sets], [s.view(np.int64) for s in sets]

        return work

    sets = flat_rows(texts, ["text"], schema, prepare)
    return checkpointed(sets.groupBy("class").agg(F.first("hashes").alias("hashes")))


def _confirmed(pairs, sets):
    """Pairs whose full sets are similar enough."""

    def named(x):
        return sets.select(F.col("class").alias(x), F.col("hashes").alias(f"h_{x}"))

    both = pairs.join(named("a"), "a").join(named("b"), "b")
    shared = F.size(F.array_intersect("h_a", "h_b"))
    both = both.withColumn("shared", shared)
    union = F.size("h_a") + F.size("h_b") - F.col("shared")
    return both.where(100 * F.col("shared") >= PERCENT * union).select("a", "b")


def _found(docs):
    """Every row's `doc_id`, `hash` of its text, `n_shingles`, `component_id` and `kept`."""
    docs = docs.select("doc_id", "text")
    rows = checkpointed(
        _with_sets(docs.withColumn("hash", F.md5("text")), "text", ["n_shingles", "class", "sketch"])
    )
    classes = checkpointed(
        rows.where("class is not null")
        .groupBy("class")
        .agg(
            F.min("doc_id").alias("least_id"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("sketch").alias("sketch"),
            F.min("hash").alias("first_text"),
        )
    )
    buckets = checkpointed(_several(_buckets(classes), "class"))

    def linked(pairs, sets=None):
        pairs = checkpointed(_likely(pairs, classes))
        if sets is None:
            ends = pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class")))
            sets = _full_sets(ends.distinct(), classes, docs)
        return _confirmed(pairs, sets)

    def rooted(rows, roots):
        out = rows.join(roots.withColumnRenamed("node", "class"), "class", "left")
        return out.withColumn("root", F.coalesce("root", "class"))

    def merged_with(roots, links):
        known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        return checkpointed(components(links.union(known)))

    def rooted(rows, roots):
        out = rows.join(roots.withColumnRenamed("node", "class"), "class", "left")
        return out.withColumn("root", F.coalesce("root", "class"))

    roots = checkpointed(components(linked(_with_central(buckets))))
    # A bucket of two is decided by now.
    open_ = checkpointed(_several(rooted(buckets, roots), "root", 3).select("class").distinct())
    sets = _full_sets(open_, classes, docs)
    rare = checkpointed(rooted(_rare_shingles(open_, sets), roots))
    links = linked(_sharing(rare), sets)
    links = links.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
    roots = checkpointed(components(links))
    named = classes.select("class", "least_id").join(
        roots.withColumnRenamed("node", "class"), "class", "left"
    ).withColumn("root", F.coalesce("root", "class"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component"))
    named = named.join(least, "root").select("class", "component")
    out = rows.select("doc_id", "hash", "n_shingles", "class").join(named, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select(
        "doc_id",
        "hash",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
    )


def groups(docs: DataFrame) -> DataFrame:
    """`doc_id`, `n_shingles`, `component_id`, `kept` for every row of `docs` (doc_id, text).

    `kept` marks the row that names its component; it is false where the id is null.
    """
    return _found(docs).drop("hash")


def keep_one(docs: DataFrame) -> DataFrame:
    """Rows of `docs`, one for each group of near-duplicates: that with the smallest id.

    Documents without words, and rows with a null id, all stay. Rows repeated with
    one id and one text leave one.
    """
    found = checkpointed(_found(docs).where("doc_id is not null and n_shingles > 0"))
    out = docs.withColumn(hidden := free_name(docs, "near_hash"), F.md5("text"))

    def same(rows):
        return (out["doc_id"] == rows["doc_id"]) & (out[hidden] == rows["hash"])

    gone = broadcast_if_small(found.where("not kept").select("doc_id", "hash").distinct())
    repeated = found.where("kept").groupBy("doc_id", "hash").count().where("count > 1")
    repeated = checkpointed(repeated.select("doc_id", "hash"))
    left = out.join(gone, same(gone), "left_anti")
    if not repeated.isEmpty():
        once = left.join(repeated, same(repeated), "left_semi").dropDuplicates(["doc_id", hidden])
        left = left.join(repeated, same(repeated), "left_anti").unionByName(once)
    return left.drop(hidden)
