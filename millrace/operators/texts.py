"""Text columns: masked values, quality signals, overlapping chunks, n-gram counts.

All are native expressions: words and lines are arrays, and no Python worker starts.
Words are runs of characters other than space, tab, line feed, carriage return and form
feed. Null texts are handled as stated by each function.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import checkpointed

# Patterns of personal data, in the order in which they are tried.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
IPV4 = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"
PERSONAL = {"email": EMAIL, "ipv4": IPV4}
# A sign that each hit of a pattern has, and a form with the same hits that reads a run of
# signs once: within a run that no `@` follows, no later place can begin a hit either, so
# only the first place of a run is tried, or the one after the last hit.
NEEDED = {EMAIL: "@"}
LINEAR = {EMAIL: r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"}
WORD = r"[^ \t\n\r\f]+"
SYMBOL = r"[!-/:-@\[-`{-~]"
# Of n-grams that are counted: how many words are numbered, and how many numbers of so many
# bits go into one long.
NUMBERED = 1 << 20
PACKED, BITS = 3, 21


def words(column) -> Column:
    """The words of a text; none of a null one."""
    return F.coalesce(F.regexp_extract_all(column, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def redact(df: DataFrame, col: str, patterns: Mapping[str, str] = PERSONAL, text="redacted") -> DataFrame:
    """`df` with column `text`, where each hit of a pattern is its name in angle brackets,
    and the number of hits of each, `n_<name>`.

    Hits are taken from the left and do not overlap; of patterns that match at one place the
    first counts. So all patterns are alternatives of one expression, each a group of its
    own: the group that is not empty tells the kind. Patterns must have no capturing groups,
    match no empty text, and be in the syntax that Java's and RE2's expressions share.
    A null text stays null, with zero hits.
    """
    column, names = F.col(f"`{col}`"), list(patterns)
    every = "|".join(f"({LINEAR.get(p, p)})" for p in patterns.values())
    none = F.lit(0).cast("long")

    def holds(some):
        return column.rlike("|".join(f"(?:{LINEAR.get(p, p)})" for p in some))

    # Most texts have no hit and are read once; a pattern that needs a sign is tried where it is.
    tests = [column.contains(NEEDED[p]) & holds([p]) for p in patterns.values() if p in NEEDED]
    others = [p for p in patterns.values() if p not in NEEDED]
    tests += [holds(others)] if others else []
    # Per hit the group of each kind but the last, which has the hits that no other has.
    hits = [F.regexp_extract_all(column, F.lit(every), F.lit(i)).alias(f"g{i}") for i in range(1, len(names))]
    found = F.struct(F.split(column, every, -1).alias("gaps"), *hits)

    def rebuilt(x):
        groups, n = [x[f"g{i}"] for i in range(1, len(names))], F.size(x["gaps"]) - 1
        mask = F.array_repeat(F.lit(""), n)
        for name, group in zip(names, groups):
            mask = F.zip_with(mask, group, lambda m, g: F.when(g != "", F.lit(f"<{name.upper()}>")).otherwise(m))
        mask = F.transform(mask, lambda m: F.when(m == "", F.lit(f"<{names[-1].upper()}>")).otherwise(m))
        # One gap more than hits.
        whole = F.array_join(F.zip_with(x["gaps"], F.concat(mask, F.array(F.lit(""))), lambda g, m: F.concat(g, m)), "")
        counts = [F.size(F.filter(group, lambda g: g != "")) for group in groups]
        counts.append(reduce(lambda a, b: a - b, counts, n))
        return row(whole, [c.cast("long") for c in counts])

    def row(whole, counts):
        return F.struct(whole.alias(text), *[c.alias(f"n_{name}") for name, c in zip(names, counts)])

    masked = F.transform(F.array(found), rebuilt)
    plain = F.array(row(column, [none] * len(names)))
    return df.select("*", F.inline(F.when(reduce(Column.__or__, tests), masked).otherwise(plain)))


def quality_signals(df: DataFrame, col: str) -> DataFrame:
    """`df` with numbers that tell prose from junk.

    `n_words`, `mean_word_length`, `symbol_share` (ASCII punctuation among characters),
    `n_lines` (with a word), `repeated_line_share` (lines equal to an earlier one, of those),
    and `longest_run` (equal lines in a row). Shares and means of nothing are null; the
    counts of a null text are zero.
    """
    text = F.coalesce(F.col(f"`{col}`"), F.lit(""))
    n = F.length(text)
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.regexp_replace(x, r"[ \t\n\r\f]", "")) > 0)
    out = df.withColumn("_words", words(text)).withColumn("_lines", lines)
    letters = F.aggregate("_words", F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    # A fold over the lines: the current run, the longest so far, and the line before.
    start = F.struct(F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("most"), F.lit(None).cast("string").alias("line"))

    def step(a, x):
        run = F.when(a["line"] == x, a["run"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(run.alias("run"), F.greatest(a["most"], run).alias("most"), x.alias("line"))

    n_words, n_lines = F.size("_words").cast("long"), F.size("_lines").cast("long")
    return out.select(
        *[F.col(f"`{c}`") for c in df.columns],
        n_words.alias("n_words"),
        F.try_divide(letters, n_words).alias("mean_word_length"),
        F.try_divide(n - F.length(F.regexp_replace(text, SYMBOL, "")), n).alias("symbol_share"),
        n_lines.alias("n_lines"),
        F.try_divide(n_lines - F.size(F.array_distinct("_lines")), n_lines).alias("repeated_line_share"),
        F.aggregate("_lines", start, step, lambda a: a["most"]).alias("longest_run"),
    )


def chunk(df: DataFrame, key: str, col: str, size: int, overlap: int = 0) -> DataFrame:
    """Overlapping chunks of `size` words: `key`, `chunk` (from 0), `chunk_id`, `first_word`,
    `last_word` (positions from 0), and `text`, its words joined by one space.

    Each chunk begins `size` - `overlap` words after the one before; the last one ends
    with the text and may be shorter. `chunk_id` depends on the key and the chunk's place
    and words alone. Texts without words, and null ones, have no chunk.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be from 0 to size - 1")
    step = size - overlap
    n = F.size("_words")
    last = F.ceil(F.greatest(n - size, F.lit(0)) / step)
    rows = df.select(F.col(f"`{key}`").alias(key), words(F.col(f"`{col}`")).alias("_words")).where(n > 0)
    rows = rows.select("*", n.alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"))
    begin = F.col("chunk") * step
    part = F.array_join(F.slice("_words", (begin + 1).cast("int"), F.lit(size)), " ")
    name = F.concat_ws(":", F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), "chunk", part)
    return rows.select(
        key, "chunk", F.md5(name).alias("chunk_id"), begin.alias("first_word"),
        (F.least(begin + size, F.col("_n")) - 1).cast("long").alias("last_word"), part.alias("text"),
    )


def _let(value: Column, body) -> Column:
    """`body` of `value`, which is computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def grams(column, k: int) -> Column:
    """All word `k`-grams of a text in order, words joined by one space; fewer words have none."""

    def joined(found):
        places = F.when(F.size(found) >= k, F.sequence(F.lit(1), F.size(found) - (k - 1)))
        return F.coalesce(F.transform(places, lambda i: F.array_join(F.slice(found, i, F.lit(k)), " ")), F.array().cast("array<string>"))

    return _let(words(column), joined)


def _runs(g):
    """(gram, n) of sorted grams: equal neighbours are one run, from where it begins to the next."""
    begins = F.filter(
        F.sequence(F.lit(1), F.size(g)),
        lambda i: (i == 1) | (F.element_at(g, i) != F.element_at(g, F.greatest(i - 1, F.lit(1)))),
    )

    def cut(b):
        ends = F.concat(F.slice(b, F.lit(2), F.size(b)), F.array(F.size(g) + 1))
        return F.zip_with(b, ends, lambda x, y: F.struct(F.element_at(g, x).alias("gram"), (y - x).cast("long").alias("n")))

    return F.when(F.size(g) > 0, _let(begins, cut))


def _gram_runs(df, keys, col, k):
    """Each distinct gram of each row with its number `n`, without a shuffle."""
    return df.select(*keys, F.inline(_let(F.sort_array(grams(F.col(f"`{col}`"), k)), _runs)))


def ngrams(df: DataFrame, key: str, col: str, k: int) -> DataFrame:
    """The distinct word `k`-grams of each row: `key`, `gram`, and its number `n` there.

    Texts of fewer words, and null ones, have none. Repeated rows give theirs each.
    """
    return _gram_runs(df, [F.col(f"`{key}`").alias(key)], col, k)


def _numbered_words(df, col) -> DataFrame:
    """(word, id): the most frequent words, numbered from 1; at most about NUMBERED.

    Any other word is written in full where numbers stand for words, so which words have
    one settles the size of rows alone.
    """
    found = df.select(F.explode(words(F.col(f"`{col}`"))).alias("word"))
    counted = found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).persist()
    least, part, left = 0, 0, NUMBERED
    for r in counted.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).toLocalIterator():
        if r["words"] > left:  # of the words with the least number a part, by hash
            least, part = r["n"], 1000 * left // r["words"]
            break
        left -= r["words"]
    few = (F.col("n") == least) & (F.pmod(F.xxhash64("word"), F.lit(1000)) < part)
    place = F.row_number().over(Window.orderBy(F.desc("n"), "word"))
    numbered = checkpointed(counted.where((F.col("n") > least) | few).select("word", place.cast("long").alias("id")))
    counted.unpersist()
    return numbered


def _packed(df, numbered, k):
    """`df` with its grams in columns `_p*`, numbers of PACKED words each, and `_rest`, the
    words without a number (there 0), joined by one space; null if there are none."""
    ids, rest = [], []
    for i in range(1, k + 1):
        first = F.col("gram") if i == k else F.substring_index("gram", " ", i)
        word = first if i == 1 else F.substring_index(first, " ", -1)
        df = df.withColumn(f"_w{i}", word).join(F.broadcast(numbered.toDF(f"_w{i}", f"_i{i}")), f"_w{i}", "left")
        ids.append(F.coalesce(f"_i{i}", F.lit(0).cast("long")))
        rest.append(F.when(F.col(f"_i{i}").isNull(), F.col(f"_w{i}")))
    packs = [reduce(lambda a, x: F.shiftleft(a, BITS).bitwiseOR(x), ids[i : i + PACKED]) for i in range(0, k, PACKED)]
    rest = F.when(reduce(Column.__or__, [r.isNotNull() for r in rest]), F.concat_ws(" ", *rest))
    # In this order of columns the nulls and zeros of a row repeat those of the row before.
    return df.select(rest.alias("_rest"), *[p.alias(f"_p{i}") for i, p in enumerate(packs)], "n")


def _unpacked(df, numbered, k):
    """`df` with `gram`, which `_packed` made its columns of."""
    others, parts, place = df.columns, [], F.lit(0)
    for i in range(k):
        pack = i // PACKED
        last = min(k, (pack + 1) * PACKED) - 1
        number = F.shiftright(f"_p{pack}", BITS * (last - i)).bitwiseAND(F.lit((1 << BITS) - 1))
        df = df.withColumn(f"_i{i}", number).join(F.broadcast(numbered.toDF(f"_w{i}", f"_i{i}")), f"_i{i}", "left")
        place = place + F.when(F.col(f"_i{i}") == 0, 1).otherwise(0)
        parts.append(F.coalesce(f"_w{i}", F.split_part("_rest", F.lit(" "), F.greatest(place, F.lit(1)))))
    return df.select(F.concat_ws(" ", *parts).alias("gram"), *others)


def ngram_counts(df: DataFrame, col: str, k: int) -> DataFrame:
    """Each word `k`-gram of the table: `gram`, its `occurrences`, and the `texts` that have it.

    A row gives each of its grams once, with its number; map tasks add these up before the
    shuffle, so a gram that every text has arrives as one row per task. Most grams are rare,
    so nearly all are shuffled: frequent words are numbers there, three in a long. Rows come
    sorted by these, as neighbours that begin alike take less room in files.
    """
    numbered = _numbered_words(df, col)
    packed = _packed(_gram_runs(df, [], col, k), numbered, k)
    keys = packed.columns[:-1]
    counted = packed.groupBy(*keys).agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("texts"))
    return _unpacked(counted, numbered, k).sortWithinPartitions(*keys[1:], "_rest").select("gram", "occurrences", "texts")
