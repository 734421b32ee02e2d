"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items.

Words are runs of ASCII letters and digits and of non-ASCII characters, with A-Z
folded. Every window of 13 consecutive words of an item is a pattern; an item of
fewer words is one pattern. Each text is normalised and scanned once, and matches
are mapped back to words and to code points of the original text.

Defined results: a null or wordless text has no words and no hits; an item without
words has no windows; an item with a null id marks words but is not listed; rows
repeated in either table count each for itself (an item id is listed once).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.sizing import measured_bytes
from millrace.llm.batches import free_name, map_rows
from millrace.llm.hashing import BY_ALPHANUMERIC, Words

WINDOW = 13
#: Item text that goes into one automaton. More items take more passes, not less work.
AUTOMATON_BYTES = 16 << 20


def _normal(text):
    words = (text or "").encode("utf-8", "surrogatepass").translate(BY_ALPHANUMERIC).split()
    # Latin-1 keeps one character per byte, so byte patterns can be matched as text.
    return len(words), (b" " + b" ".join(words) + b" ").decode("latin-1")


def _patterns(items, window):
    """pattern -> (its words, ids of items that hold it)"""
    found: dict = {}
    for item, text in items:
        n, normal = _normal(text)
        words = normal.split()
        for i in range(max(1, n - window + 1) if n else 0):
            part = words[i : i + window]
            found.setdefault(" " + " ".join(part) + " ", (len(part), set()))[1].add(item)
    return found


def _automaton(shared):
    """The automaton over a broadcast's patterns, built once per Python worker."""
    held = shared.value
    if "automaton" not in held:
        import ahocorasick

        built = ahocorasick.Automaton()
        for pattern, found in held["patterns"].items():
            built.add_word(pattern, found)
        built.make_automaton()
        held["automaton"] = built
    return held["automaton"]


def _merged(ranges):
    out = []
    for begin, end in sorted(ranges):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return out


def _spans(text, ranges):
    """Code point offsets in `text` of ranges of words."""
    words = Words([text], BY_ALPHANUMERIC, hashed=False)
    place = np.cumsum((words.bytes & 0xC0) != 0x80) - 1
    return [
        {"start": int(place[words.start[a]]), "end": int(place[words.end[b - 1] - 1]) + 1}
        for a, b in ranges
    ]


def scan(docs: DataFrame, benchmark: DataFrame, window=WINDOW, text="text", prefix="bench") -> DataFrame:
    """`docs` with `{prefix}_words`, `{prefix}_hit` (words inside any occurrence),
    `{prefix}_items` (distinct item ids as strings, sorted) and `{prefix}_spans`
    (code point ranges of the text that are covered).

    `benchmark` has `item_id` and `text`. A test set within AUTOMATON_BYTES takes one
    scan; a larger one is split over several automatons, one pass each.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    shards = max(1, math.ceil(measured_bytes(items) / AUTOMATON_BYTES))
    shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))
    names = [free_name(docs, f"{prefix}_{n}") for n in ("words", "hit", "items", "spans", "ranges")]
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    types = [
        T.LongType(),
        T.LongType(),
        T.ArrayType(T.StringType()),
        T.ArrayType(span),
        T.ArrayType(T.ArrayType(T.LongType())),
    ]
    fields = [T.StructField(n, t) for n, t in zip(names, types, strict=True)]
    out = docs
    for k in range(shards):
        # One shard at a time: never more than about AUTOMATON_BYTES of items.
        rows = [tuple(r) for r in items.where(shard == k).collect()]
        shared = spark.sparkContext.broadcast({"patterns": _patterns(rows, window)})

        def prepare(shared=shared):
            def work(texts, *before):
                automaton = _automaton(shared) if shared.value["patterns"] else None
                made = [[], [], [], [], []]
                for i, text in enumerate(texts):
                    n, normal = _normal(text)
                    ranges = list(before[0][i]) if before else []
                    found = set(before[1][i]) if before else set()
                    if automaton and n:
                        hits = list(automaton.iter(normal))
                        if hits:
                            spaces = np.flatnonzero(
                                np.frombuffer(normal.encode("latin-1"), np.uint8) == 0x20
                            )
                            last = np.searchsorted(spaces, [e for e, _ in hits])
                            for end, (_, (size, ids)) in zip(last.tolist(), hits, strict=True):
                                ranges.append([end - size, end])
                                found.update(ids)
                    ranges = _merged(ranges)
                    found.discard(None)
                    made[0].append(n)
                    made[1].append(sum(b - a for a, b in ranges))
                    made[2].append(sorted(found))
                    made[3].append(_spans(text, ranges) if ranges else [])
                    made[4].append(ranges)
                return made

            return work

        if k == 0:
            out = map_rows(out, [text], fields, prepare)
        else:
            # Earlier ranges and items come in, and merged ones go out.
            keep = docs.columns
            out = map_rows(out, [text, names[4], names[2]], fields, prepare, keep=keep)
    return out.drop(names[4])


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: word counts, items found, their digest, and the verdict."""
    found = scan(docs.select("doc_id", "text"), benchmark)
    words, hit = F.col("bench_words"), F.col("bench_hit")
    return found.select(
        "doc_id",
        words.alias("n_words"),
        hit.alias("n_hit"),
        F.size("bench_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("bench_items")), 256).alias("items_sha256"),
        ((hit > 0) & (20 * hit >= words)).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of `docs` that are not contaminated: under a twentieth of their words hit."""
    prefix = free_name(docs, "bench")
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    found = scan(docs, benchmark, prefix=prefix)
    words, hit = F.col(f"{prefix}_words"), F.col(f"{prefix}_hit")
    return found.where(~((hit > 0) & (20 * hit >= words))).select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )
