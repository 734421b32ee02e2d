"""Best-fit packing of tokenised documents into sequences, planned on lengths alone.

A document is its token ids and an end id; longer ones are cut into full pieces and a
rest. The plan sees only how many pieces there are of each length, at most 4096
numbers however large the corpus:

1. Pieces above a third of the capacity can share a sequence at most in pairs. From
   the longest down, each is matched with the longest partner that still fits.
2. Shorter pieces, longest first, go to the fullest sequence with room for them, and
   open new ones when there is none.

The plan gives each length ranges of ranks, with the sequence and offset of the first;
pieces are numbered per length in parallel, salted, so that a length shared by a third
of all pieces is spread over many tasks.

Defined results: a null or empty text is one piece, the end id alone. Repeated rows are
packed each for itself. An empty table gives no rows. Code points that the tokenizer's tables
lack, or have in another way than Python's, are as the tokenizer has them.
"""

from __future__ import annotations

import bisect
import functools
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.llm.batches import flat_rows
from millrace.llm.hashing import WORD_BASE, WORD_INVERSE, U, mix, powers
from millrace.session import scratch_path

CAPACITY = 4096
END_ID = 1
#: Pieces that one task numbers, about; and pre-tokens a worker keeps the ids of.
SALT_ROWS = 100_000
CACHED_WORDS = 600_000


# How the tokenizer splits lower-cased text: 's 't 're 've 'm 'll 'd, runs of letters,
# single numbers, and runs of anything else but white space.
#: What the library folds or splits otherwise than Python does; such texts go to it whole.
_ODD = ("<|", "\u03a3", "\x1c", "\x1d", "\x1e", "\x1f")
SPACE, LETTER, NUMBER, OTHER = range(4)
#: Added to the kind of a code point that the library may fold or compose in another way.
ODD = 4


def code_point_kinds(tokenizer):
    """The kind of every code point, as the tokenizer's own tables have it.

    Its pre-tokenizer cuts a text of all code points into runs of one kind, of which one
    character is looked at. Code points that the normalizer folds otherwise than Python,
    or that Python does not know, are marked as odd.
    """
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    cut = tokenizer.pre_tokenizer.pre_tokenize_str

    def runs(text):
        return len({at for _, at in cut(text)})

    kinds = np.full(0x110000, SPACE, np.uint8)
    every = np.array(points)
    known = {}
    for _, (begin, end) in cut("".join(map(chr, points))):
        first = chr(points[begin])
        if (begin, end) not in known:
            kind = LETTER if runs("a" + first) == 1 else NUMBER if runs(first * 2) == 2 else OTHER
            known[begin, end] = kind
            kinds[every[begin:end]] = kind
    # A mark that no character folds to or joins with stands between the code points.
    folded = tokenizer.normalizer.normalize_str("\x00".join(map(chr, points[1:]))).split("\x00")
    for c, new in zip(points[1:], folded, strict=True):
        plain = unicodedata.normalize("NFC", chr(c)).lower()
        if plain != new and not new.isspace() or unicodedata.category(chr(c)) == "Cn":
            kinds[c] |= ODD
    return kinds


@functools.lru_cache(2)
def _kinds_of(tokenizer_json):
    from tokenizers import Tokenizer

    return code_point_kinds(Tokenizer.from_str(tokenizer_json))


class WordIds:
    """Token ids of texts, by a cache of pre-tokens.

    The tokenizer lower-cases, splits and then merges within each pre-token, so the ids
    of a text are those of its pre-tokens in turn. The pre-tokens of many texts are found
    and hashed at once; each new one is given by the tokenizer itself, many at a time:
    the last id of each carries the word end.
    """

    def __init__(self, tokenizer, kinds=None, limit=CACHED_WORDS):
        self.tokenizer, self.limit, self.cache = tokenizer, limit, {}
        kinds = code_point_kinds(tokenizer) if kinds is None else kinds
        self.kinds, self.odd = kinds & (ODD - 1), kinds >= ODD
        size = 1 + max(tokenizer.get_vocab().values())
        self.ends, self.bytes = np.zeros(size, bool), np.zeros(size, np.int64)
        for token, i in tokenizer.get_vocab().items():
            # Each letter of a token stands for a byte.
            self.ends[i], self.bytes[i] = token.endswith("</w>"), len(token.removesuffix("</w>"))

    def _learn(self, names, words):
        for i in range(0, len(words), 200):
            some = words[i : i + 200]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            size = np.diff(np.concatenate([[0], np.cumsum(self.bytes[ids])])[np.concatenate([[0], cuts])])
            if size.tolist() != [len(w.encode()) for w in some]:
                # The library cuts one of them in another way: each for itself.
                for name, word in zip(names[i : i + 200], some, strict=True):
                    one = self.tokenizer.encode(word, add_special_tokens=False).ids
                    self.cache[name] = np.array(one, "<u4").tobytes()
                continue
            data, begin = ids.tobytes(), 0
            for name, end in zip(names[i : i + 200], cuts.tolist(), strict=True):
                self.cache[name] = data[4 * begin : 4 * end]
                begin = end

    def _plain(self, text):
        """True if folding and splitting `text` in Python gives what the library would."""
        if any(x in text for x in _ODD):
            return False
        if text.isascii():
            return True
        if self.odd[np.frombuffer(text.encode("utf-32-le"), "<u4")].any():
            return False
        return unicodedata.is_normalized("NFC", text)

    def _cut(self, codes):
        """Where pre-tokens begin and end."""
        kind = self.kinds[codes]
        number, word = kind == NUMBER, kind != SPACE
        change = kind[1:] != kind[:-1]
        begin = word & (np.concatenate([[True], change]) | number)
        end = word & (np.concatenate([change, [True]]) | number)
        # A lone apostrophe takes these letters with it; what follows them begins anew.
        at = np.flatnonzero((codes == 39) & begin & end)
        at = at[at + 2 < len(codes)]
        one, two = codes[at + 1], codes[at + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(at), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        for chosen, n in ((at[short], 2), (at[long], 3)):
            end[chosen], begin[chosen + 1] = False, False
            end[chosen + n - 1] = True
            after = chosen + n
            after = after[after < len(codes)]
            begin[after] |= kind[after] == LETTER
        return np.flatnonzero(begin), np.flatnonzero(end) + 1

    def packed(self, texts):
        """Ids of each text as little-endian 32-bit numbers."""
        plain = [self._plain(t) for t in texts]
        lower = [t.lower() if p else "" for t, p in zip(texts, plain, strict=True)]
        joined = "\n".join(lower) + "\n\n"
        codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        begin, end = self._cut(codes)
        total = np.zeros(len(codes) + 1, U)
        np.cumsum(mix(codes.astype(U) + U(1)) * powers(WORD_BASE, len(codes)), out=total[1:])
        names = mix((total[end] - total[begin]) * powers(WORD_INVERSE, len(codes))[begin])
        used, where, inverse = np.unique(names, return_index=True, return_inverse=True)
        used = used.tolist()
        if len(self.cache) > self.limit:
            self.cache = {}
        cache = self.cache
        new = [i for i, name in enumerate(used) if name not in cache]
        if new:
            words = [joined[begin[k] : end[k]] for k in where[new].tolist()]
            self._learn([used[i] for i in new], words)
        parts = [cache[name] for name in used]
        size = np.array([len(p) // 4 for p in parts], np.int64)
        ids, first = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(size) - size
        # The ids of every pre-token, in the order of the texts.
        sizes = size[inverse]
        ends = np.cumsum(sizes)
        flat = ids[np.repeat(first[inverse] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.cumsum([len(t) + 1 for t in lower])
        cut = np.concatenate([[0], ends])[np.searchsorted(begin, bounds)].tolist()
        out, last = [], 0
        for text, ok, at in zip(texts, plain, cut, strict=True):
            if ok:
                out.append(flat[last:at].tobytes())
            else:
                whole = self.tokenizer.encode(text, add_special_tokens=False).ids
                out.append(np.array(whole, "<u4").tobytes())
            last = at
        return out


def _held(shared):
    """The tokenizer and its cache, once per Python worker."""
    held = shared.value
    if "ids" not in held:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        held["ids"] = WordIds(Tokenizer.from_str(held["json"]), held["kinds"])
    return held["ids"]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def pieces(docs: DataFrame, tokenizer_json: str, capacity=CAPACITY, end_id=END_ID, with_ids=True) -> DataFrame:
    """One row per piece of each document: `doc_id`, `piece`, `start`, `length`, `ids_crc32`
    and, if asked for, `ids` (packed little-endian 32-bit). `tokenizer_json` is the file's content."""
    shared = docs.sparkSession.sparkContext.broadcast({"json": tokenizer_json, "kinds": _kinds_of(tokenizer_json)})
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity
    fields = T.StructType.fromDDL(_PIECES).fields
    schema = T.StructType(fields if with_ids else fields[:-1])

    def prepare():
        def work(texts, ids):
            out = [[] for _ in schema.fields]
            for doc, body in zip(ids, _held(shared).packed([t or "" for t in texts]), strict=True):
                body += end
                for k, at in enumerate(range(0, len(body), step)):
                    part = body[at : at + step]
                    row = (doc, k, at // 4, len(part) // 4, zlib.crc32(part), part)
                    for column, value in zip(out, row, strict=False):
                        column.append(value)
            return out

        return work

    return flat_rows(docs, ["text", "doc_id"], schema, prepare)


def plan(counts: dict[int, int], capacity=CAPACITY):
    """Ranges (length, first rank, rank after the last, first sequence, offset) that place
    `counts[length]` pieces of each length, and the number of sequences.

    Ranks of a range go to consecutive sequences at one offset.
    """
    left = {n: c for n, c in counts.items() if c}
    used = defaultdict(int)
    out, sequences = [], 0
    room = defaultdict(list)  # free room -> [(first sequence, count)]

    def place(length, first, count, offset):
        out.append((length, used[length], used[length] + count, first, offset))
        used[length] += count

    large = sorted(n for n in left if 3 * n > capacity)
    for n in reversed(large):
        while left[n]:
            k = bisect.bisect_right(large, capacity - n) - 1
            while k >= 0 and left[large[k]] - (large[k] == n) <= 0:
                k -= 1
            if k < 0:
                m, other = left[n], 0
            elif large[k] == n:
                m, other = left[n] // 2, n
            else:
                other = large[k]
                m = min(left[n], left[other])
            place(n, sequences, m, 0)
            left[n] -= m
            if other:
                place(other, sequences, m, n)
                left[other] -= m
            room[capacity - n - other].append((sequences, m))
            sequences += m
    free = sorted(r for r in room if r)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            k = bisect.bisect_left(free, n)
            if k == len(free):
                # New sequences: the last may stay partly filled.
                m = max(1, left[n] // (capacity // n))
                room[capacity].append((sequences, m))
                bisect.insort(free, capacity)
                sequences += m
                k = len(free) - 1
            gap = free[k]
            first, count = room[gap].pop()
            if not room[gap]:
                free.pop(k)
                del room[gap]
            each = min(gap // n, left[n])
            m = min(count, left[n] // each)
            if m < count:
                if gap not in room:
                    bisect.insort(free, gap)
                room[gap].append((first + m, count - m))
            for i in range(each):
                place(n, first, m, capacity - gap + i * n)
            left[n] -= m * each
            if rest := gap - each * n:
                if rest not in room:
                    bisect.insort(free, rest)
                room[rest].append((first, m))
    return out, sequences


def _ranked(rows):
    """`rows` with `rank`, numbering the pieces of each length from 0, and the counts."""
    total = rows.count()
    salts = max(1, total // SALT_ROWS)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    per = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    # One row per length and salt: a table in proportion to rows / SALT_ROWS.
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("own", F.row_number().over(own) - 1).join(
        per.select("length", "salt", "before"), ["length", "salt"]
    )
    counts = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    return ranked.withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "salt"), counts


def pack(rows: DataFrame, capacity=CAPACITY) -> DataFrame:
    """`rows` (pieces with a `length` of 1 to `capacity`) with `sequence_id` and `offset`.

    `rows` must be a stored table: it is read three times.
    """
    ranked, counts = _ranked(rows)
    ranges, _ = plan(counts, capacity)
    # At most a few ranges per length and free room; sorted for a binary search.
    table = np.array(sorted(ranges), np.int64).reshape(-1, 5)
    shared = rows.sparkSession.sparkContext.broadcast(table)
    schema = T.StructType(
        [
            *ranked.drop("rank").schema.fields,
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    )

    def locate(batches):
        table = shared.value
        # (length, rank) as one number: no length has 2^48 pieces.
        begins = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            at = np.searchsorted(begins, (batch["length"].to_numpy() << 48) + batch["rank"].to_numpy(), "right") - 1
            found = table[at]
            sequence = found[:, 3] + batch["rank"].to_numpy() - found[:, 1]
            yield batch.drop(columns="rank").assign(sequence_id=sequence, offset=found[:, 4])

    return ranked.mapInPandas(locate, schema)


def packed(docs: DataFrame, tokenizer_json: str, capacity=CAPACITY) -> DataFrame:
    """Every piece of `docs` with its sequence and its place there."""
    path = scratch_path(docs.sparkSession, "pieces")
    pieces(docs, tokenizer_json, capacity, with_ids=False).write.parquet(path)
    return pack(docs.sparkSession.read.parquet(path), capacity)
