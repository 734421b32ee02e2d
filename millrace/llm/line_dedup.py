"""Lines that repeat across documents, up to one word, by a deletion-neighbourhood join.

A line is its white-space words with A-Z folded. Lines of fewer than 5 words stay.
A line of 5 or more goes if an earlier line, by (doc_id, line number), has the same
words; one of 10 or more also goes if an earlier line of 10 or more is one word edit
away (a word put in, left out or replaced). Whether the earlier line itself goes
makes no difference, so the result does not depend on any order of work.

1. Equal lines are counted once, under a 128-bit hash and their earliest place.
2. Two lines within one edit share their first or their last words up to the middle.
   Only lines that share such a half with another line go on.
3. Those emit all variants with one word deleted, as hashed keys: keyed by length and
   place for replaced words, and against whole shorter lines for left-out ones. Only
   positions outside the shared half are needed.
4. Per key only the earliest line is kept, in a minimum that combines before the
   shuffle, so a key with a third of all lines is one small row per task. Each line
   and its earliest partner are then verified by their real words.

Defined results: rows with a null id have no place in the order; they stay as they are
and count for no other row. A null text stays null. Repeated rows of one id and text
are one document, so they get the same result and do not empty each other. Two texts
under one id share its places; neither is earlier than the other.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.sizing import broadcast_if_small
from millrace.llm.batches import flat_rows, free_name, map_rows
from millrace.llm.hashing import BY_WHITE_SPACE, SEQ_BASE, U, Words, mix, powers
from millrace.session import checkpointed, scratch_path

MIN_WORDS = 5
EDIT_WORDS = 10
SEQ_INVERSE = pow(SEQ_BASE, -1, 1 << 64)
PREFIX, SUFFIX = 1, 2
REPLACED, SHORT, LONG = 0, 1, 2


class _Sums:
    """Hashes of any run of words of a `Words`."""

    def __init__(self, hashes):
        n = len(hashes)
        self.total = np.zeros(n + 1, U)
        np.cumsum(hashes * powers(SEQ_BASE, max(n, 1))[:n], out=self.total[1:])
        self.inverse = powers(SEQ_INVERSE, n + 2)

    def run(self, begin, end):
        return (self.total[end] - self.total[begin]) * self.inverse[begin]


def _half(length):
    """Words that two lines, the longer of `length` words, share at one end if one edit
    apart; rounded down to fours, so that neighbouring lengths mostly agree."""
    return (length - 1) // 2 // 4 * 4


def _tagged(values, tag, size):
    return mix(values ^ mix(U(tag) * U(1 << 32) + size.astype(U)))


def _signed(values):
    return values.view(np.int64)


_LINES = "doc_id long, text_hash long, line_no int, n int, h1 long, h2 long, p1 long, p2 long, s1 long, s2 long"


def _line_rows(docs):
    """Hashes of every line of MIN_WORDS or more; unused half keys are 0."""

    def prepare():
        def work(texts, ids, hashes):
            split = [(t or "").split("\n") for t in texts]
            sizes = np.array([len(s) for s in split])
            words = Words([line for s in split for line in s], BY_WHITE_SPACE)
            owner = np.repeat(np.arange(len(split)), sizes)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            n = words.counts
            use = np.flatnonzero(n >= MIN_WORDS)
            a, b, n = words.first[use], words.first[use + 1], n[use]
            one, two = _Sums(words.hash), _Sums(mix(words.hash ^ U(0x5851F42D4C957F2D)))
            keys = []
            for side in (PREFIX, SUFFIX):
                halves = []
                for longer in (n, n + 1):
                    size = np.minimum(_half(longer), n)
                    run = one.run(a, a + size) if side == PREFIX else one.run(b - size, b)
                    halves.append(np.where(n >= EDIT_WORDS, _tagged(run, side, size), U(0)))
                halves[1] = np.where(halves[0] == halves[1], U(0), halves[1])
                keys += [_signed(k) for k in halves]
            whole = [_signed(_tagged(s.run(a, b), 7, n)) for s in (one, two)]
            at = owner[use]
            return (np.array(ids)[at], np.array(hashes)[at], number[use], n, *whole, *keys)

        return work

    schema = T.StructType.fromDDL(_LINES)
    return flat_rows(docs, ["text", "doc_id", "text_hash"], schema, prepare)


def _order(doc="doc_id", line="line_no"):
    """One number for a place, rising with (doc_id, line_no)."""
    return (F.col(doc).cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col(line)).cast("decimal(38,0)")


def _suspect_lines(docs, lines, distinct):
    """(doc_id, line_no, h1, sides, line, place) of the earliest place of every line that shares a half
    with another line."""
    keys = [
        F.when(F.col(c) != 0, F.struct(F.lit(side).alias("side"), F.col(c).alias("key")))
        for side, columns in ((PREFIX, ("p1", "p2")), (SUFFIX, ("s1", "s2")))
        for c in columns
    ]
    keyed = distinct.select("place", "h1", F.explode(F.array_compact(F.array(*keys))).alias("k"))
    keyed = keyed.select("place", "h1", "k.side", "k.key")
    shared = keyed.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"))
    shared = broadcast_if_small(checkpointed(shared.where("lo <> hi").select("key")))
    suspects = keyed.join(shared, "key", "left_semi").groupBy("place", "h1").agg(
        F.bit_or("side").alias("sides")
    )
    suspects = broadcast_if_small(checkpointed(suspects))
    where = lines.select("place", "h1", "doc_id", "text_hash", "line_no").distinct()
    suspects = suspects.join(where, ["place", "h1"])
    per_doc = suspects.groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("line_no", "sides", "h1")).alias("wanted")
    )
    per_doc = broadcast_if_small(checkpointed(per_doc))
    found = docs.join(per_doc, ["doc_id", "text_hash"])
    schema = T.StructType.fromDDL("doc_id long, line_no int, h1 long, sides int, line string")

    def prepare():
        def work(texts, ids, wanted):
            out = [[], [], [], [], []]
            for text, doc, lines in zip(texts, ids, wanted, strict=True):
                split = text.split("\n")
                for w in lines:
                    row = (doc, w["line_no"], w["h1"], w["sides"], split[w["line_no"]])
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            return out

        return work

    wanted = flat_rows(found, ["text", "doc_id", "wanted"], schema, prepare)
    # Repeated rows of one document count once.
    wanted = wanted.groupBy("doc_id", "line_no", "h1").agg(F.max("sides").alias("sides"), F.min("line").alias("line"))
    return wanted.withColumn("place", _order())


def _variants(lines):
    """(key, role, place, h1) of the deletion neighbourhood of every suspect line."""
    schema = T.StructType.fromDDL("key long, role int, doc_id long, line_no int, h1 long")

    def prepare():
        def work(texts, sides, docs, numbers, names):
            words = Words(texts, BY_WHITE_SPACE)
            sums = _Sums(words.hash)
            n, sides = words.counts, np.array(sides)
            first, last = words.first[:-1], words.first[1:]
            half = _half(n)
            # Deleted positions: those outside a shared half.
            low = np.where(sides & SUFFIX, 0, half)
            high = np.where(sides & PREFIX, n, n - half)
            count = np.maximum(high - low, 0)
            line = np.repeat(np.arange(len(n)), count)
            at = np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count) + low[line]
            i = first[line] + at
            rest = sums.run(first[line], i) + sums.run(i + 1, last[line]) * powers(
                SEQ_BASE, int(n.max(initial=1)) + 1
            )[at]
            replaced = mix(_tagged(rest, REPLACED + 11, n[line]) ^ mix(at.astype(U)))
            longer = n[line] > EDIT_WORDS
            long = _tagged(rest[longer], SHORT + 11, n[line][longer] - 1)
            short = _tagged(sums.run(first, last), SHORT + 11, n)
            keys = np.concatenate([replaced, long, short])
            roles = np.repeat([REPLACED, LONG, SHORT], [len(replaced), len(long), len(short)])
            rows = np.concatenate([line, line[longer], np.arange(len(n))])
            return _signed(keys), roles, np.array(docs)[rows], np.array(numbers)[rows], np.array(names)[rows]

        return work

    found = flat_rows(lines, ["line", "sides", "doc_id", "line_no", "h1"], schema, prepare, limit=1 << 17)
    return found.select("key", "role", _order().alias("place"), "h1")


def _within_one(a, b):
    """True if word lists `a` and `b` are at most one edit apart."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def _partners(lines):
    """(h1, partner): the earliest verified line one edit away, where earlier."""
    variants = _variants(lines)
    firsts = variants.groupBy("key").agg(
        *[F.min(F.when(F.col("role") == r, F.col("place"))).alias(f"first_{r}") for r in range(3)],
        F.max(F.when(F.col("role") != SHORT, F.col("place"))).alias("last"),
        F.max(F.when(F.col("role") == SHORT, F.col("place"))).alias("last_short"),
    )
    # Keys of one line alone have no partner.
    firsts = firsts.where(
        (F.col("first_0") < F.col("last"))
        | (F.col("first_1").isNotNull() & F.col("first_2").isNotNull())
    )
    firsts = broadcast_if_small(checkpointed(firsts.select("key", "first_0", "first_1", "first_2")))
    partner = (
        F.when(F.col("role") == REPLACED, F.col("first_0"))
        .when(F.col("role") == SHORT, F.col("first_2"))
        .otherwise(F.col("first_1"))
    )
    pairs = (
        variants.join(firsts, "key")
        .select("h1", "place", partner.alias("partner"))
        .where("partner < place")
        .select("h1", "partner")
        .distinct()
    )
    own = lines.select("h1", F.col("line").alias("own_line"))
    other = lines.select(F.col("place").alias("partner"), F.col("line").alias("other_line"))
    both = pairs.join(own, "h1").join(other, "partner")

    def verify(batches):
        fold = str.maketrans({c: c + 32 for c in range(65, 91)})
        for batch in batches:
            ok = [
                _within_one(a.translate(fold).encode().split(), b.translate(fold).encode().split())
                for a, b in zip(batch["own_line"], batch["other_line"], strict=True)
            ]
            yield batch.loc[ok, ["h1", "partner"]]

    sure = both.mapInPandas(verify, "h1 long, partner decimal(38,0)")
    return sure.groupBy("h1").agg(F.min("partner").alias("partner"))


def _stored(df, name):
    """`df` written to the shared folder as a table, and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def repeated_lines(docs: DataFrame) -> DataFrame:
    """`doc_id`, `text_hash` (xxhash64 of the text) and `removed`: the numbers, from 0, of
    the lines of that document that repeat an earlier line. Documents with none are left out.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    docs = docs.where("doc_id is not null and text is not null")
    lines = _stored(_line_rows(docs).withColumn("place", _order()), "lines")
    halves = ["p1", "p2", "s1", "s2"]
    distinct = _stored(
        lines.groupBy("h1", "h2").agg(
            F.min("place").alias("place"),
            F.max("place").alias("last"),
            *[F.max(c).alias(c) for c in ("p1", "p2", "s1", "s2")],
        ),
        "distinct-lines",
    )
    suspects = _stored(_suspect_lines(docs, lines, distinct), "suspect-lines")
    partners = checkpointed(_partners(suspects))
    known = distinct.select("h1", "h2", "place", "last").join(broadcast_if_small(partners), "h1", "left")
    known = known.where("place < last or partner is not null").select(
        "h1", "h2", F.least("place", "partner").alias("earliest")
    )
    known = broadcast_if_small(checkpointed(known))
    gone = lines.join(known, ["h1", "h2"]).where("earliest < place")
    return gone.groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias("removed"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """`docs` with repeated lines taken out of `text`, and two more columns: `n_lines`
    before, and `n_removed`."""
    names = {n: free_name(docs, n) for n in ("doc_key", "text_hash", "removed", "kept_text", "n_lines", "n_removed")}
    key, code, removed = names["doc_key"], names["text_hash"], names["removed"]
    gone = checkpointed(repeated_lines(docs)).select(
        F.col("doc_id").alias(key), F.col("text_hash").alias(code), F.col("removed").alias(removed)
    )
    keyed = docs.withColumn(key, F.col("doc_id").cast("long")).withColumn(code, F.xxhash64("text"))
    joined = keyed.join(broadcast_if_small(gone), [key, code], "left").select(*docs.columns, removed)
    fields = [
        T.StructField(names["kept_text"], T.StringType()),
        T.StructField(names["n_lines"], T.LongType()),
        T.StructField(names["n_removed"], T.LongType()),
    ]

    def prepare():
        def work(texts, removals):
            out = [[], [], []]
            for text, gone in zip(texts, removals, strict=True):
                lines = text.split("\n") if text is not None else []
                if gone:
                    gone = set(gone)
                    text = "\n".join(x for i, x in enumerate(lines) if i not in gone)
                for column, value in zip(out, (text, len(lines), len(gone or ())), strict=True):
                    column.append(value)
            return out

        return work

    made = map_rows(joined, ["text", removed], fields, prepare, keep=[c for c in docs.columns if c != "text"])
    return made.select(
        *[F.col(f"`{names['kept_text'] if c == 'text' else c}`").alias(c) for c in docs.columns],
        names["n_lines"],
        names["n_removed"],
    )


def clean(docs: DataFrame) -> DataFrame:
    """`docs` without repeated lines, `n_chars` brought up to date; a document that had
    lines taken out and has no word left goes."""
    columns = docs.columns
    made = without_repeats(docs)
    removed = made.columns[-1]
    made = made.where((F.col(f"`{removed}`") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in columns:
        made = made.withColumn("n_chars", F.when(F.col(f"`{removed}`") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return made.select(*[F.col(f"`{c}`") for c in columns])
