"""Toxic spans by a linear-chain conditional random field, and scores of whole texts.

Tokens are words (ASCII letters and digits, non-ASCII characters, A-Z folded) with
their first and last four bytes as features, each in one of 2^18 cells.

Labels are of documents, so token labels are derived from them: a word of a toxic text
is labelled toxic if it is met in several different contexts there, and its share among
toxic texts is far and surely above that among others. Contexts, not copies, count as support, so
the words of one text that was copied many times are not taken for insults. Counts run
over all labelled texts in Spark; the field is fitted on at most SAMPLE texts of either
class, chosen by a hash of the id.

Forward-backward marginals give each token's probability to be toxic. A text's score is
a logistic curve of their noisy-or, their sum and the text's length; tokens at 0.5 or
more are its offending spans.

Defined results: null, empty and wordless texts have no tokens and get the score of
that. With no labels, or one class only, every score is the share of toxic labels (0.5
without any). Rows with a null id or label are not learnt from; a null id is in no held
out fold. Repeated rows are scored each for itself.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.sizing import broadcast_if_small
from millrace.llm.batches import flat_rows, map_rows, pieces
from millrace.llm.hashing import BY_ALPHANUMERIC, U, Words, mix

BITS = 18
CELLS = 1 << BITS
SAMPLE = 1000
FOLDS, HELD_OUT = 5, 0
#: Different contexts, the log ratio of shares, and that less two standard errors, that
#: make a word's cell toxic.
CONTEXTS, RATIO, SURE = 4, 2.5, 0.8
EPOCHS, STEP, DECAY = 4, 0.15, 1e-4
#: Words of one vectorised chain segment.
BLOCK = 128


def features(words: Words):
    """Cells of every word: itself, its first and its last four bytes."""

    def cell(values, kind):
        return (mix(values + U(kind)) >> U(64 - BITS)).astype(np.int64)

    size = words.end - words.start
    data = words.bytes | np.where((words.bytes >= 65) & (words.bytes <= 90), 32, 0).astype(np.uint8)
    first, last = np.zeros(len(size), U), np.zeros(len(size), U)
    for k in range(4):
        inside = size > k
        first = first * U(257) + np.where(inside, data[np.minimum(words.start + k, len(data) - 1)], 0).astype(U)
        last = last * U(257) + np.where(inside, data[words.end - 1 - np.minimum(k, size - 1)], 0).astype(U)
    return np.stack([cell(words.hash, 1), cell(first, 2), cell(last, 3)])


def chain(words, emission, moves):
    """Transition weights of every token of all texts as one chain of 2x2 matrices; the
    first token of a text has equal rows, which forgets what came before."""
    x = np.exp(np.clip(emission, -30, 30))
    m = np.empty((len(x), 2, 2))
    m[:, :, 0] = moves[:, 0]
    m[:, :, 1] = moves[:, 1] * x[:, None]
    starts = words.first[:-1][words.counts > 0]
    m[starts] = np.stack([np.ones(len(starts)), x[starts]], 1)[:, None, :]
    return m, starts


def forward_backward(m):
    """Normalised forward and backward vectors of a chain of 2x2 matrices.

    Segments of BLOCK tokens advance together; vectors cross segments one by one.
    """
    n = len(m)
    count = -(-n // BLOCK)
    padded = np.tile(np.eye(2), (count * BLOCK, 1, 1))
    padded[:n] = m
    step = np.ascontiguousarray(padded.reshape(count, BLOCK, 2, 2).transpose(1, 2, 3, 0))
    whole = np.zeros((2, 2, count))
    whole[0, 0] = whole[1, 1] = 1
    for a in step:
        whole = np.stack(
            [[whole[i, 0] * a[0, j] + whole[i, 1] * a[1, j] for j in (0, 1)] for i in (0, 1)]
        )
        whole /= whole.sum((0, 1))
    ahead, behind = np.empty((2, count)), np.empty((2, count))
    f, b = (0.5, 0.5), (0.5, 0.5)
    totals = whole.transpose(2, 0, 1).tolist()
    for k, ((a, c), (d, e)) in enumerate(totals):
        ahead[:, k] = f
        f = (f[0] * a + f[1] * d, f[0] * c + f[1] * e)
        s = f[0] + f[1]
        f = (f[0] / s, f[1] / s)
    for k in range(count - 1, -1, -1):
        behind[:, k] = b
        (a, c), (d, e) = totals[k]
        b = (a * b[0] + c * b[1], d * b[0] + e * b[1])
        s = b[0] + b[1]
        b = (b[0] / s, b[1] / s)
    forward, backward = np.empty((BLOCK, 2, count)), np.empty((BLOCK, 2, count))
    f, b = ahead, behind
    for k in range(BLOCK):
        a = step[k]
        f = np.stack([f[0] * a[0, 0] + f[1] * a[1, 0], f[0] * a[0, 1] + f[1] * a[1, 1]])
        f /= f.sum(0)
        forward[k] = f
    for k in range(BLOCK - 1, -1, -1):
        backward[k] = b
        a = step[k]
        b = np.stack([a[0, 0] * b[0] + a[0, 1] * b[1], a[1, 0] * b[0] + a[1, 1] * b[1]])
        b /= b.sum(0)
    shape = lambda v: v.transpose(2, 0, 1).reshape(-1, 2)[:n]
    return shape(forward), shape(backward)


def marginals(forward, backward):
    both = forward * backward
    return both[:, 1] / both.sum(1)


class Field:
    """The fitted field with its curve over whole texts."""

    def __init__(self, weights, bias, moves, curve=None):
        self.weights, self.bias, self.moves, self.curve = weights, bias, moves, curve

    def tag(self, texts):
        """(words, probability of each word to be toxic)"""
        words = Words(texts, BY_ALPHANUMERIC)
        if not len(words.start):
            return words, np.zeros(0)
        emission = self.weights[features(words)].sum(0) + self.bias
        m, _ = chain(words, emission, self.moves)
        return words, marginals(*forward_backward(m))

    def summary(self, texts):
        """Per text: what the curve takes."""
        words, p = self.tag(texts)
        none = np.log1p(-np.minimum(p, 1 - 1e-9))
        owner, n = words.text, words.counts
        clean = np.bincount(owner, none, minlength=len(n))
        some = -np.expm1(clean)
        odds = np.log(np.maximum(some, 1e-9)) - np.minimum(clean, -1e-12).clip(-20)
        total = np.log1p(np.bincount(owner, p, minlength=len(n)))
        return words, p, np.stack([odds.clip(-20, 20), total, np.log1p(n), np.ones(len(n))], 1)

    def score(self, texts):
        """(scores of the texts, their offending spans in code points)"""
        words, p, x = self.summary(texts)
        scores = 1 / (1 + np.exp(-np.clip(x @ self.curve, -40, 40)))
        spans = [[] for _ in texts]
        bad = np.flatnonzero(p >= 0.5)
        if len(bad):
            place = np.cumsum((words.bytes & 0xC0) != 0x80) - 1
            for w in bad.tolist():
                i = int(words.text[w])
                base = int(place[words.base[i]])
                begin, end = int(place[words.start[w]]) - base, int(place[words.end[w] - 1]) - base + 1
                spans[i].append({"start": begin, "end": end})
        return scores.tolist(), spans


class Constant:
    def __init__(self, value):
        self.value = value

    def score(self, texts):
        return [self.value] * len(texts), [[] for _ in texts]


def _token_labels(words, toxic_text, toxic_cell):
    return toxic_text[words.text] & toxic_cell[features(words)[0]]


def fit_field(texts, labels, toxic_cell, seed=3):
    """Weights by gradient steps on the likelihood of token labels."""
    weights, bias = np.zeros(CELLS), -4.0
    log_moves = np.zeros((2, 2))
    scale_w, scale_m, scale_b = np.full(CELLS, 1e-8), np.full((2, 2), 1e-8), 1e-8
    rng = np.random.default_rng(seed)
    labels = np.array(labels, bool)
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        shuffled = [texts[i] for i in order]
        for begin, end in pieces(shuffled, 1 << 17):
            words = Words(shuffled[begin:end], BY_ALPHANUMERIC)
            if not len(words.start):
                continue
            truth = _token_labels(words, labels[order[begin:end]], toxic_cell)
            cells = features(words)
            m, starts = chain(words, weights[cells].sum(0) + bias, np.exp(log_moves))
            forward, backward = forward_backward(m)
            off = truth - marginals(forward, backward)
            gradient = np.bincount(cells.ravel(), np.tile(off, 3), minlength=CELLS) - DECAY * weights
            pair = forward[:-1, :, None] * m[1:] * backward[1:, None, :]
            pair /= pair.sum((1, 2), keepdims=True)
            inner = np.ones(len(truth), bool)
            inner[starts] = False
            inner = inner[1:]
            seen = np.zeros((2, 2))
            np.add.at(seen, (truth[:-1][inner].astype(int), truth[1:][inner].astype(int)), 1)
            moved = seen - pair[inner].sum(0)
            scale_w += gradient**2
            weights += STEP * 4 * gradient / np.sqrt(scale_w)
            scale_m += moved**2
            log_moves += STEP * moved / np.sqrt(scale_m)
            scale_b += off.sum() ** 2
            bias += STEP * off.sum() / np.sqrt(scale_b)
    return Field(weights, bias, np.exp(log_moves))


def fit_curve(x, truth, weight):
    """Logistic weights over the columns of `x`, each row counting by its `weight`."""
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (weight * (p - truth)) + 1e-2 * w
        h = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _toxic_cells(labelled, sizes):
    """Which word cells are toxic, from all labelled texts."""

    def prepare():
        def work(texts, labels):
            words = Words(texts, BY_ALPHANUMERIC)
            toxic = np.array(labels, bool)[words.text] if len(words.text) else np.zeros(0, bool)
            cells = features(words)[0]
            # Documents: each text's distinct cells, counted per class.
            key = np.unique(words.text * CELLS + cells)
            hit = np.array(labels, bool)[key // CELLS] if len(key) else np.zeros(0, bool)
            out = []
            for kind, part in ((1, key[hit]), (0, key[~hit])):
                count = np.bincount(part % CELLS, minlength=CELLS)
                at = np.flatnonzero(count)
                out.append((at, np.full(len(at), kind), np.zeros(len(at), np.int64), count[at]))
            # Contexts: the words on both sides of every word of a toxic text.
            before = np.concatenate([[0], words.hash[:-1]]).astype(U) if len(cells) else words.hash
            after = np.concatenate([words.hash[1:], [0]]).astype(U) if len(cells) else words.hash
            around = mix(before * U(3) + after).view(np.int64)
            pair = np.unique(np.stack([cells[toxic], around[toxic]]), axis=1)
            out.append((pair[0], np.full(pair.shape[1], 2), pair[1], np.ones(pair.shape[1], np.int64)))
            return [np.concatenate(c) for c in zip(*out, strict=True)]

        return work

    schema = T.StructType.fromDDL("cell int, kind int, context long, n long")
    rows = flat_rows(labelled, ["text", "label"], schema, prepare)
    once = rows.groupBy("cell", "kind", "context").agg(F.sum("n").alias("n"))

    def total(value, kind):
        return F.sum(F.when(F.col("kind") == kind, value).otherwise(0)).alias(f"k{kind}")

    # At most CELLS rows, whatever the size of the corpus.
    counts = once.groupBy("cell").agg(total(F.col("n"), 1), total(F.col("n"), 0), total(F.lit(1), 2)).toPandas()
    share = [(counts[f"k{k}"] + 0.5) / (sizes[k] + 1) for k in (1, 0)]
    error = np.sqrt(1 / (counts["k1"] + 0.5) + 1 / (counts["k0"] + 0.5))
    ratio = np.log(share[0] / share[1])
    good = (counts["k2"] >= CONTEXTS) & (ratio >= RATIO) & (ratio - 2 * error >= SURE)
    toxic = np.zeros(CELLS, bool)
    toxic[counts["cell"][good]] = True
    return toxic


def train(labelled: DataFrame, sample=SAMPLE):
    """A model from `labelled` (doc_id, text, label 0 or 1)."""
    labelled = labelled.where("doc_id is not null and label is not null")
    sizes = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return Constant(float(next(iter(sizes), 0.5)))
    toxic_cell = _toxic_cells(labelled, sizes)
    # The sample is chosen by ids alone, and only its texts are fetched.
    ids = [
        r["doc_id"]
        for label in (0, 1)
        for r in labelled.where(F.col("label") == label)
        .select("doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(2 * sample)
        .collect()
    ]
    wanted = labelled.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long").distinct()
    chosen = (
        labelled.join(F.broadcast(wanted), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(4 * sample)
        .collect()
    )
    # Every other text fits the field; the curve is fitted on those it has not seen.
    part = [chosen[0::2], chosen[1::2]]
    field = fit_field([r["text"] or "" for r in part[0]], [r["label"] for r in part[0]], toxic_cell)
    texts, truth = [r["text"] for r in part[1]], np.array([r["label"] for r in part[1]], float)
    x = np.concatenate([field.summary(texts[a:b])[2] for a, b in pieces(texts)]) if texts else np.zeros((0, 4))
    weight = np.array([sizes[int(t)] / max(1, (truth == t).sum()) for t in truth])
    field.curve = fit_curve(x, truth, weight / max(weight.mean(), 1e-9) if len(weight) else weight)
    return field


_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def scored(docs: DataFrame, model, score="score", spans="toxic_spans") -> DataFrame:
    """`docs` with the score of each whole text and its offending spans."""
    shared, kind = docs.sparkSession.sparkContext.broadcast(vars(model)), type(model)
    fields = [T.StructField(score, T.DoubleType()), T.StructField(spans, T.ArrayType(_SPAN))]

    def prepare():
        held = kind.__new__(kind)
        vars(held).update(shared.value)

        def work(texts):
            return held.score(texts)

        return work

    return map_rows(docs, ["text"], fields, prepare)


def fold(identity):
    """The fold number that the contract names: crc32 of the id as text."""
    return F.crc32(identity.cast("string").cast("binary")) % FOLDS


def learnt_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, label) of the rows that may be learnt from: all folds but one."""
    labels = labels.select("doc_id", F.col("toxic").alias("label")).where(fold(F.col("doc_id")) != HELD_OUT)
    return docs.select("doc_id", "text").join(broadcast_if_small(labels), "doc_id")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(docs.select("doc_id", "text"), train(learnt_rows(docs, labels)))
    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return out.select(
        "doc_id",
        held.alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "toxic_spans",
    )
