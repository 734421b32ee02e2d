"""Token counts by rank-synchronous merging of byte pairs, in ragged numpy arrays.

Texts are cut at special tokens, which count one each, and split into pre-tokens. New
pre-tokens of a batch lie in one array of symbols, each knowing its sequence. A round
looks up the rank of every neighbouring pair, takes the lowest of each sequence and
merges all its places at once, from the left where they overlap. Merged symbols only
form pairs of higher rank, so this is the order of the usual algorithm. Sequences
without a pair left leave the array; what counts is how many symbols they have.

A very long pre-token would make every round look at all of it for a few places. One of
more than LONG bytes is an array of its own: places are kept by the rank of their pair, the
lowest rank is taken at all its places at once, and only the pairs beside them are looked
up anew. A rank comes up once, as new pairs hold the new symbol, so the work is in
proportion to the length and not to length times rounds.

Defined results: null and empty texts have no bytes and no tokens. Repeated rows are
counted each for itself.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.batches import map_rows

LIMIT = 512
#: Bytes from which on a pre-token is merged by itself.
LONG = 2048
#: Pre-tokens that a worker remembers the counts of.
CACHED = 1_000_000

# White space as the vocabulary's library has it, and its split.
_WS = r"\t-\r \x85\xa0  -     　"
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
)


def _byte_letters():
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def read_vocabulary(text):
    """Arrays of a byte-level vocabulary in JSON: `byte` symbols, sorted `pair` keys with
    their `rank` and the symbol they `make`, and the `special` strings."""
    model = json.loads(text)
    vocab = model["model"]["vocab"]
    letters = _byte_letters()
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
    pairs = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
    order = np.argsort(pairs)
    return {
        "byte": np.array([vocab[letters[b]] for b in range(256)], np.int64),
        "pair": pairs[order],
        "rank": order.astype(np.int64),
        "by_rank": pairs,
        "made": np.array([vocab[a + b] for a, b in merges], np.int64),
        "make": np.array([vocab[a + b] for a, b in merges], np.int64)[order],
        "special": [t["content"] for t in model["added_tokens"]],
    }


NONE = np.iinfo(np.int64).max


def _alternate(at, follows):
    """Of overlapping places (one symbol repeated) every other one, from the left."""
    group = np.cumsum(~follows) - 1
    first = np.flatnonzero(~follows)
    return at[(np.arange(len(at)) - first[group]) % 2 == 0]


def long_count(word, vocabulary):
    """Number of symbols that one long word (bytes) is merged to."""
    pair, rank = vocabulary["pair"], vocabulary["rank"]
    by_rank, made = vocabulary["by_rank"], vocabulary["made"]
    symbol = vocabulary["byte"][np.frombuffer(word, np.uint8)]
    n = len(symbol)
    # The symbols before and after each one that is left; a symbol stands where it begins.
    after, before, left = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
    places, waiting, count = {}, [], n

    def look(at):
        """Puts the pairs that begin at `at` under their ranks."""
        key = symbol[at] << 32 | symbol[after[at]]
        found = np.minimum(np.searchsorted(pair, key), len(pair) - 1)
        known = pair[found] == key
        at, ranks = at[known], rank[found[known]]
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for r, some in zip(ranks[np.concatenate([[0], cuts])].tolist() if len(at) else [], np.split(at, cuts), strict=False):
            if r not in places:
                places[r] = []
                heapq.heappush(waiting, r)
            places[r].append(some)

    look(np.arange(n - 1))
    while waiting:
        r = heapq.heappop(waiting)
        at = np.unique(np.concatenate(places.pop(r)))
        at = at[left[at]]
        at = at[after[at] < n]
        at = at[symbol[at] << 32 | symbol[after[at]] == by_rank[r]]
        if by_rank[r] >> 32 == by_rank[r] & 0xFFFFFFFF and len(at):
            at = _alternate(at, np.concatenate([[False], after[at[:-1]] == at[1:]]))
        if not len(at):
            continue
        gone = after[at]
        symbol[at], left[gone] = made[r], False
        after[at] = after[gone]
        inner = after[at] < n
        before[after[at[inner]]] = at[inner]
        count -= len(at)
        look(np.unique(np.concatenate([before[at][before[at] >= 0], at[inner]])))
    return count


def merged_counts(words, vocabulary):
    """Number of symbols that each of `words` (bytes, none empty) is merged to."""
    if any(len(w) > LONG for w in words):
        counts = np.array([long_count(w, vocabulary) if len(w) > LONG else 0 for w in words], np.int64)
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        if short:
            counts[short] = merged_counts([words[i] for i in short], vocabulary)
        return counts
    sizes = np.array([len(w) for w in words], np.int64)
    symbol = vocabulary["byte"][np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(np.arange(len(words)), sizes)
    counts = sizes.copy()
    pair, rank, make = vocabulary["pair"], vocabulary["rank"], vocabulary["make"]
    while len(symbol) > 1:
        key = symbol[:-1] << 32 | symbol[1:]
        found = np.minimum(np.searchsorted(pair, key), len(pair) - 1)
        known = (pair[found] == key) & (owner[:-1] == owner[1:])
        ranks = np.full(len(symbol), NONE)
        ranks[:-1][known] = rank[found[known]]
        begins = np.flatnonzero(np.diff(owner, prepend=-1))
        lowest = np.minimum.reduceat(ranks, begins)
        runs = np.diff(np.append(begins, len(symbol)))
        low = np.repeat(lowest, runs)
        hit = (ranks == low) & (low != NONE)
        at = np.flatnonzero(hit)
        if not len(at):
            break
        at = _alternate(at, np.diff(at, prepend=at[0] - 2) == 1)
        symbol[at] = make[found[at]]
        stay = np.ones(len(symbol), bool)
        stay[at + 1] = False
        # Sequences that had no pair are done.
        stay &= low != NONE
        counts -= np.bincount(owner[at], minlength=len(counts))
        symbol, owner = symbol[stay], owner[stay]
    return counts


class Counter:
    def __init__(self, vocabulary, limit=CACHED):
        import regex

        self.vocabulary, self.limit, self.cache = vocabulary, limit, {}
        self.split = regex.compile(SPLIT).findall
        self.special = vocabulary["special"]
        # The longest first, as one may begin another.
        escaped = map(regex.escape, sorted(self.special, key=len, reverse=True))
        self.cut = regex.compile("|".join(escaped)).split if self.special else lambda t: [t]

    def counts(self, texts):
        parts, extra = [], []
        for text in texts:
            cut = self.cut(text) if any(s in text for s in self.special) else [text]
            parts.append([w for part in cut for w in self.split(part)])
            extra.append(len(cut) - 1)
        if len(self.cache) > self.limit:
            self.cache = {}
        cache = self.cache
        new = {w for words in parts for w in words}
        new = [w for w in new if w not in cache]
        if new:
            made = merged_counts([w.encode("utf-8", "surrogatepass") for w in new], self.vocabulary)
            cache.update(zip(new, made.tolist(), strict=True))
        get = cache.__getitem__
        return [sum(map(get, words)) + n for words, n in zip(parts, extra, strict=True)]


def with_counts(docs: DataFrame, vocabulary_json: str, name="n_tokens") -> DataFrame:
    """`docs` with the number of tokens of each whole text in column `name`."""
    shared = docs.sparkSession.sparkContext.broadcast({"arrays": read_vocabulary(vocabulary_json)})

    def prepare():
        held = shared.value
        if "counter" not in held:
            held["counter"] = Counter(held["arrays"])

        def work(texts):
            return [held["counter"].counts([t or "" for t in texts])]

        return work

    return map_rows(docs, ["text"], [T.StructField(name, T.LongType())], prepare)


def report(docs: DataFrame, vocabulary_json: str, limit=LIMIT) -> DataFrame:
    docs = docs.select("doc_id", "text")
    return with_counts(docs, vocabulary_json).select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
