"""Two tokenizers' tokens aligned by bytes, in Arrow, with link counts over the corpus.

Both tokenizers write a text as tokens whose bytes, joined, are a space and the text. An
offset where tokens of both end cuts them into groups; an A and a B token whose bytes
overlap are linked. In each batch of documents:

1. Token ids come as Arrow lists. They are flattened, with the index of the parent
   document beside each; token sizes are taken by id and summed up along each document.
2. Ends are joined on the document-end key (document, end) by a full outer hash join. In
   key order each row is one link: the stretch up to that end lies in one A and one B
   token, the next to end in either. Rows with both ends close a group.
3. `group_by` counts the id pairs of each document, and those of the task as a whole.
   Spark merges the tasks' counts.

A second pass over the stored pairs of each document looks up the counts. The most
frequent pairs, at most HEAD_PAIRS, are broadcast, with the highest count of each B id (as
many as B has ids); pairs beyond are joined by a shuffle, so no pair is left out.

Encoding uses that neither tokenizer joins a space (U+0020) to what stands before it,
unless that is white space: texts are cut there, and each distinct unit is encoded once
per worker by the libraries. If the vocabularies do not allow this, whole texts are encoded.

Defined results: a null or empty text, and one whose A or B bytes are not a space and the
text (a text with U+2581 is such a one), has no tokens: zeros and an empty digest. Repeated
rows count each. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.llm.batches import pieces, small_batches
from millrace.llm.token_counts import _byte_letters
from millrace.session import scratch_path

#: Pairs whose counts are broadcast (16 bytes each), and pairs that a task holds before
#: it gives its counts on.
HEAD_PAIRS = 2_000_000
HELD_PAIRS = 1_500_000
#: What a worker remembers before it starts anew: units, and their characters.
CACHED, CACHED_CHARS = 600_000, 16_000_000
#: Pairs in one row of partial counts.
ROW_PAIRS = 50_000
MARK = "▁"

# A unit: up to a space behind something else than white space.
UNIT = re.compile(r"\s*\S+(?:[^\S ]\s*\S+)*(?:[^\S ]\s*\Z)?|\s+\Z")


class Numbers(dict):
    """Numbers things in the order in which they are first asked for; `new` lists those."""

    def __init__(self):
        super().__init__()
        self.new = []

    def __missing__(self, key):
        self[key] = number = len(self)
        self.new.append(key)
        return number


class Encoder:
    """Token ids of texts by both tokenizers, from a cache of units."""

    def __init__(self, json_text, model, limit=CACHED):
        import sentencepiece

        # Spark gives a task one core; the library's threads would wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.a, self.limit = Tokenizer.from_str(json_text), limit
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        letters = {letter: byte for byte, letter in _byte_letters().items()}
        of = {i: t for t, i in self.a.get_vocab().items()}
        entries = [of.get(i, "") for i in range(max(of) + 1)]
        self.bytes_a = [bytes(letters[x] for x in t) if all(x in letters for x in t) else t.encode() for t in entries]
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)
        ]
        self.sizes_a, self.sizes_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        self.space = self.b.piece_to_id(MARK)
        pre = json.loads(json_text).get("pre_tokenizer") or {}
        # Pieces hold the mark in front only, and no white space is dropped or added.
        self.cuttable = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
            and not any(MARK in p.lstrip(MARK) for p in names)
            and self.b.decode(self.b.encode("  a  b  ")) == "  a  b  "
            and names[self.space] == MARK
        )
        self._forget()

    def _forget(self):
        self.code, self.chars = Numbers(), 0
        self.ids = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.start = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
        self.good = np.zeros(0, bool)

    def _encode(self, units):
        """Ids of texts that begin with a space and their numbers, by A and B, and whether
        both keep the bytes of each text."""
        a = [e.ids for e in self.a.encode_batch(units, add_special_tokens=False)]
        b = self.b.encode([u[1:] for u in units], num_threads=1)
        # The library gives nothing for an empty text; in a longer one a space is a piece.
        b = [ids or [self.space] for ids in b]
        want = [u.encode() for u in units]
        joined, length = b"".join(want), np.array([len(w) for w in want], np.int64)
        good, sides = np.ones(len(units), bool), []
        for lists, tokens, sizes in ((a, self.bytes_a, self.sizes_a), (b, self.bytes_b, self.sizes_b)):
            count = np.array([len(x) for x in lists], np.int64)
            ids = np.fromiter(itertools.chain.from_iterable(lists), np.int32, count.sum())
            ends = np.concatenate([[0], np.cumsum(sizes[ids])])[np.cumsum(count)]
            # Mostly all are right at once; else each is looked at.
            if b"".join([tokens[i] for i in ids.tolist()]) != joined or (ends != np.cumsum(length)).any():
                good &= [b"".join([tokens[i] for i in x]) == w for x, w in zip(lists, want, strict=True)]
            sides.append((ids, count))
        return sides, good

    def _learn(self, units):
        sides, good = self._encode(units)
        for k, (ids, count) in enumerate(sides):
            self.ids[k] = np.concatenate([self.ids[k], ids])
            self.start[k] = np.concatenate([self.start[k], self.start[k][-1] + np.cumsum(count)])
        self.good = np.concatenate([self.good, good])

    def lists(self, texts):
        """Two Arrow lists of ids, empty for a text without tokens."""
        if len(self.code) > self.limit or self.chars > CACHED_CHARS:
            self._forget()
        spaced = [" " + t if t else "" for t in texts]
        cut = self.cuttable
        units = [UNIT.findall(t) if cut and t else [t] if t else [] for t in spaced]
        code = self.code
        used = np.array(list(map(code.__getitem__, itertools.chain.from_iterable(units))), np.int64)
        if code.new:
            self._learn(code.new)
            self.chars += sum(map(len, code.new))
            code.new = []
        counts = np.array([len(parts) for parts in units], np.int64)
        owner = np.repeat(np.arange(len(texts)), counts)
        bad = np.unique(owner[~self.good[used]])
        out = []
        for k in (0, 1):
            begin, size = self.start[k][used], np.diff(self.start[k])[used]
            size = np.where(np.isin(owner, bad), 0, size)
            before = np.cumsum(size) - size
            at = np.repeat(begin - before, size) + np.arange(size.sum())
            ends = np.zeros(len(texts) + 1, np.int64)
            np.cumsum(np.bincount(owner, weights=size, minlength=len(texts)).astype(np.int64), out=ends[1:])
            out.append([self.ids[k][at], ends])
        for i in bad.tolist():
            if counts[i] > 1:
                # Units keep their bytes or not one by one; only the whole text decides.
                sides, good = self._encode([spaced[i]])
                if good[0]:
                    for k, (ids, _) in enumerate(sides):
                        flat, ends = out[k]
                        out[k] = [np.insert(flat, ends[i], ids), ends + len(ids) * (np.arange(len(ends)) > i)]
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())) for flat, ends in out]


def _ends(lists, sizes, name):
    """One row per token: its document-end key, and its id as column `name`."""
    ids, document = lists.flatten(), pc.list_parent_indices(lists).cast(pa.int64())
    total = pc.cumulative_sum(pc.take(sizes, ids))
    total = pa.array([], pa.int64()) if not len(ids) else total
    # Sums run along the batch; what stands before a document goes off again.
    first = pc.take(lists.offsets, document)
    before = pc.take(pa.concat_arrays([pa.array([0], pa.int64()), total]), first)
    key = pc.add(pc.shift_left(document, pa.scalar(32, pa.int64())), pc.subtract(total, before))
    return pa.table({"key": key, name: ids})


class Aligned:
    """The links of a batch of documents, in order: `document`, ids `a` and `b`, and `cut`
    where a group ends."""

    def __init__(self, lists_a, lists_b, sizes_a, sizes_b):
        left, right = _ends(lists_a, sizes_a, "a"), _ends(lists_b, sizes_b, "b")
        both = left.join(right, "key", join_type="full outer", use_threads=False).sort_by("key").combine_chunks()
        key, a, b = (both.column(n).combine_chunks() if both.num_rows else pa.array([], t) for n, t in (("key", pa.int64()), ("a", pa.int32()), ("b", pa.int32())))
        self.documents = len(lists_a)
        self.document = pc.shift_right(key, pa.scalar(32, pa.int64()))
        self.ends_a, self.ends_b = (np.asarray(x.is_valid()) for x in (a, b))
        self.cut = self.ends_a & self.ends_b
        self.a, self.b = pc.fill_null_backward(a), pc.fill_null_backward(b)
        self.flat_a, self.flat_b = lists_a.flatten(), lists_b.flatten()

    def per_document(self, flags):
        found = np.asarray(self.document)
        return np.bincount(found[flags] if flags is not None else found, minlength=self.documents).astype(np.int64)

    def group_lists(self):
        """Ids of A and of B in each group, as lists, and where each document's groups begin."""
        out = []
        for flat, ends in ((self.flat_a, self.ends_a), (self.flat_b, self.ends_b)):
            offsets = np.concatenate([[0], np.cumsum(ends)[self.cut]])
            out.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat))
        return *out, np.concatenate([[0], np.cumsum(self.per_document(self.cut))])

    def group_texts(self, names):
        """Groups as `a1,a2|b1;a3|b2,b3` for each document."""
        a, b, first = self.group_lists()
        a, b = (
            pc.binary_join(pa.ListArray.from_arrays(x.offsets, pc.take(names, x.flatten())), ",") for x in (a, b)
        )
        groups = pc.binary_join_element_wise(a, b, "|")
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(first, pa.int32()), groups), ";")

    def pairs(self, base):
        """Distinct (document, pair) with their number of links, by document and pair."""
        pair = pc.add(pc.multiply(self.a.cast(pa.int64()), base), self.b.cast(pa.int64()))
        table = pa.table({"document": self.document, "pair": pair})
        counted = table.group_by(["document", "pair"], use_threads=False).aggregate([([], "count_all")])
        return counted.sort_by([("document", "ascending"), ("pair", "ascending")]).rename_columns(["document", "pair", "n"])


class Counts:
    """Partial counts of a task: tables that are merged when they get long."""

    def __init__(self):
        self.tables, self.rows = [], 0

    def add(self, pairs):
        if pairs.num_rows:
            self.tables.append(pairs.select(["pair", "n"]))
            self.rows += pairs.num_rows

    def merged(self):
        table = pa.concat_tables(self.tables).group_by("pair", use_threads=False).aggregate([("n", "sum")])
        return table.rename_columns(["pair", "n"])

    def full(self):
        """The merged counts, if they are more than a task should hold."""
        if self.rows > 2 * HELD_PAIRS:
            self.tables = [self.merged()]
            self.rows = self.tables[0].num_rows
            return self.rows > HELD_PAIRS
        return False

    def take(self):
        table = self.merged() if self.tables else None
        self.tables, self.rows = [], 0
        return table


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
PAIRS = [T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.LongType()))]


def _stored_schema(docs):
    """Rows of documents (`row` set), and rows of partial counts (`row` null)."""
    fields = [T.StructField("row", T.LongType()), docs.schema["doc_id"]]
    fields += [T.StructField(n, T.LongType()) for n in _NUMBERS]
    return T.StructType([*fields, T.StructField("groups_sha256", T.StringType()), *PAIRS])


def _lists(values, counts):
    offsets = np.concatenate([[0], np.cumsum(counts)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _store(docs, shared, path):
    schema = _stored_schema(docs)
    arrow = to_arrow_schema(schema)

    def counts_batch(table):
        pairs, n = table.column("pair").combine_chunks(), table.column("n").combine_chunks()
        cut = [min(ROW_PAIRS, len(pairs) - i) for i in range(0, len(pairs), ROW_PAIRS)]
        columns = [pa.nulls(len(cut), f.type) for f in arrow][:-2]
        return pa.RecordBatch.from_arrays([*columns, _lists(pairs, cut), _lists(n.cast(pa.int64()), cut)], schema=arrow)

    def run(batches):
        held = shared.value
        if "encoder" not in held:
            held["encoder"] = Encoder(held["json"], held["model"])
        encoder = held["encoder"]
        sizes = [pa.array([len(x) for x in side], pa.int64()) for side in (encoder.bytes_a, encoder.bytes_b)]
        names = pa.array([str(i) for i in range(max(len(sizes[0]), len(sizes[1])))])
        base = pa.scalar(len(sizes[1]), pa.int64())
        counts, row = Counts(), TaskContext.get().partitionId() << 36
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in pieces(texts):
                lists = encoder.lists(texts[begin:end])
                found = Aligned(*lists, *sizes)
                n = end - begin
                digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in found.group_texts(names).to_pylist()]
                pairs = found.pairs(base)
                counts.add(pairs)
                each = np.bincount(np.asarray(pairs.column("document")), minlength=n)
                columns = [
                    pa.array(np.arange(row, row + n)), batch.column(0).slice(begin, n).cast(arrow.field(1).type),
                    *[pa.array(np.diff(np.asarray(x.offsets)).astype(np.int64)) for x in lists],
                    pa.array(found.per_document(found.cut)), pa.array(found.per_document(None)), pa.array(digests, pa.string()),
                    _lists(pairs.column("pair").combine_chunks(), each), _lists(pairs.column("n").combine_chunks(), each),
                ]
                row += n
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
                if counts.full():
                    yield counts_batch(counts.take())
        if counts.rows:
            yield counts_batch(counts.take())

    docs.select("doc_id", "text").mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)


def _scored(stored, head, best, base):
    """Documents with `count_sum` and `n_best` over the pairs of `head`, and the `pairs` and
    `counts` of the rest."""
    shared = stored.sparkSession.sparkContext.broadcast({"pair": head[0], "n": head[1], "best": best})
    names = ["row", "doc_id", *_NUMBERS, "groups_sha256"]
    schema = T.StructType(
        [stored.schema[n] for n in names] + [T.StructField(n, T.LongType()) for n in ("count_sum", "n_best")] + PAIRS
    )
    arrow = to_arrow_schema(schema)

    def run(batches):
        held = shared.value
        for batch in batches:
            pairs, n = (batch.column(batch.schema.get_field_index(c)) for c in ("pairs", "counts"))
            document = np.asarray(pc.list_parent_indices(pairs))
            flat, n = np.asarray(pairs.flatten()), np.asarray(n.flatten())
            at = np.searchsorted(held["pair"], flat)
            at[at == len(held["pair"])] = 0
            known = held["pair"][at] == flat if len(held["pair"]) else np.zeros(len(flat), bool)
            count = np.where(known, held["n"][at] if len(held["n"]) else 0, 0)
            top = known & (count == held["best"][flat % base])
            # Integer sums: products of counts may be beyond what a double holds exactly.
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], document, count * n)
            np.add.at(sums[1], document, np.where(top, n, 0))
            rest = np.bincount(document[~known], minlength=batch.num_rows)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            columns += [pa.array(sums[0]), pa.array(sums[1]), _lists(pa.array(flat[~known]), rest), _lists(pa.array(n[~known]), rest)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return stored.mapInArrow(run, schema)


def aligned(docs: DataFrame, json_text: str, model: bytes) -> DataFrame:
    """Per row of `docs` (`doc_id`, `text`): tokens, groups and links, their digest, and how
    often the linked pairs are linked in all of `docs`."""
    spark = docs.sparkSession
    small_batches(spark)
    path = scratch_path(spark, "token-links")
    shared = spark.sparkContext.broadcast({"json": json_text, "model": model})
    _store(docs, shared, path)
    shared.unpersist()
    stored = spark.read.schema(_stored_schema(docs)).parquet(path)
    partial = stored.where("row is null").select(F.explode(F.arrays_zip("pairs", "counts")).alias("x"))
    merged = partial.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("n"))
    kept = scratch_path(spark, "pair-counts")
    merged.write.parquet(kept)
    merged = spark.read.parquet(kept)

    import sentencepiece

    base = sentencepiece.SentencePieceProcessor(model_proto=model).get_piece_size()
    best = np.zeros(base, np.int64)
    for r in merged.groupBy((F.col("pair") % base).cast("int").alias("b")).agg(F.max("n").alias("n")).collect():
        best[r["b"]] = r["n"]
    least = _least_of_head(merged)
    head = merged.where(F.col("n") >= least).toArrow()
    order = np.argsort(head.column("pair").to_numpy())
    head = [head.column(c).to_numpy()[order] for c in ("pair", "n")]
    out = _scored(stored.where("row is not null"), head, best, base)
    tail = merged.where(F.col("n") < least)
    if not tail.isEmpty():
        out = _with_tail(out, tail, best, base)
    return out.drop("row", "pairs", "counts")


def _least_of_head(merged):
    """The lowest count with which at most HEAD_PAIRS pairs are left; ties go out together."""
    if merged.count() <= HEAD_PAIRS:
        return 0
    # At most 64 rows: how many pairs have a count of so many bits.
    sizes = merged.groupBy(F.length(F.bin("n")).alias("bits")).agg(F.count(F.lit(1)).alias("pairs"))
    left, least = HEAD_PAIRS, 1 << 62
    for r in sorted(sizes.collect(), key=lambda r: -r["bits"]):
        left -= r["pairs"]
        if left < 0:
            break
        least = 1 << r["bits"] - 1
    return least


def _with_tail(scored, tail, best, base):
    """Sums over the pairs that were not broadcast, by a join on the pair."""
    spark = scored.sparkSession
    path = scratch_path(spark, "scored")
    scored.write.option("compression", "zstd").parquet(path)
    scored = spark.read.parquet(path)
    links = scored.select("row", F.explode(F.arrays_zip("pairs", "counts")).alias("x"))
    links = links.select("row", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("links"))
    highest = F.from_json(F.lit(json.dumps(best.tolist())), "array<long>")
    tops = spark.range(1).select(F.posexplode(highest).alias("b", "most"))
    tail = tail.withColumn("b", (F.col("pair") % base).cast("int")).join(F.broadcast(tops), "b").drop("b")
    found = links.join(tail, "pair").groupBy("row").agg(
        F.sum(F.col("n") * F.col("links")).alias("_sum"),
        F.sum(F.when(F.col("n") == F.col("most"), F.col("links")).otherwise(0)).alias("_best"),
    )
    out = scored.join(found, "row", "left")
    for name, more in (("count_sum", "_sum"), ("n_best", "_best")):
        out = out.withColumn(name, F.col(name) + F.coalesce(F.col(more), F.lit(0).cast("long")))
    return out.drop("_sum", "_best")


def token_groups(docs: DataFrame, json_text: str, model: bytes) -> DataFrame:
    """Per row of `docs`: `doc_id` and its `groups`, each the ids of A and of B that share bytes."""
    group = T.ArrayType(T.ArrayType(T.IntegerType()))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("groups_a", group), T.StructField("groups_b", group)])
    arrow = to_arrow_schema(schema)
    small_batches(docs.sparkSession)

    def run(batches):
        encoder = Encoder(json_text, model)
        sizes = [pa.array([len(x) for x in side], pa.int64()) for side in (encoder.bytes_a, encoder.bytes_b)]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in pieces(texts):
                a, b, first = Aligned(*encoder.lists(texts[begin:end]), *sizes).group_lists()
                lists = [pa.ListArray.from_arrays(pa.array(first, pa.int32()), x) for x in (a, b)]
                columns = [batch.column(0).slice(begin, end - begin), *lists]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def report(docs: DataFrame, json_text: str, model: bytes) -> DataFrame:
    return aligned(docs.select("doc_id", "text"), json_text, model).select(
        "doc_id", *_NUMBERS, "n_best", "count_sum", "groups_sha256"
    )
