"""Quality scores by naive Bayes support vectors.

A text is the set of its byte 2-, 3- and 4-grams, and of the 2- to 8-grams of marks
that tell whether a word repeats the one before; each is in one of 2^18 cells. A cell's
weight is the log ratio of its share among good and among bad texts. Indicators times
these ratios, scaled to length 1, go to a linear support vector machine, fitted by dual
coordinate descent on hinge loss; a logistic curve turns its margin into a score.

Ratios are counted over all labelled texts in Spark; the machine is fitted on at most
SAMPLE of them and SAMPLE_BYTES of text, chosen by a hash of the text's id, evenly from
both classes. A repeated id counts once there, with its lowest text.

Defined results: null and empty texts have no n-grams and get the score of the bias
alone. With no labels, or one class only, every score is the share of good labels
(0.5 without any). Rows with a null id or label are not learnt from. Repeated rows are
scored each for itself.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.sizing import broadcast_if_small
from millrace.llm.batches import flat_rows, free_name, map_rows
from millrace.llm.hashing import BY_WHITE_SPACE, Words

BITS = 18
CELLS = 1 << BITS
#: Labelled texts, of each class, that the machine is fitted on at most, and their bytes.
SAMPLE, SAMPLE_BYTES = 3000, 32_000_000
#: Rows whose cells lie in one array.
CHUNK_ROWS = 200
COST, PASSES = 1.0, 20
FOLDS, HELD_OUT = 3, 1


def cells(text):
    """Sorted distinct cells of a text's byte n-grams."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    found = np.zeros(CELLS, bool)
    run = data
    for n in (2, 3, 4):
        if len(data) < n:
            break
        run = run[:-1] * np.uint32(0x01000193) + data[n - 1 :]
        found[((run + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)] = True
    if len(data):
        words = Words([text], BY_WHITE_SPACE).hash
        run = same = (words[1:] == words[:-1]).astype(np.uint32)
        for n in range(2, 9):
            if len(same) < n:
                break
            run = run[:-1] * np.uint32(2) + same[n - 1 :]
            found[((run + np.uint32(n << 16)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)] = True
    return np.flatnonzero(found)


def descend(rows, signs, ratio, passes=PASSES, cost=COST, seed=7):
    """Each cell's share of the margin (weight times ratio), and the bias, of the hinge-loss
    machine over `rows` of (cells, scale): a row's values are its cells' ratios times scale.

    Dual coordinate descent: each step solves one row's multiplier exactly. Rows have
    length 1. Values are not stored; the shares take the squares of the ratios.
    """
    share, bias, squares = np.zeros(CELLS), 0.0, ratio**2
    alpha = np.zeros(len(rows))
    # Length 1 and the bias; a row without cells has the bias alone.
    norms = np.array([(squares[at].sum() * scale**2) + 1.0 for at, scale in rows])
    order = np.random.default_rng(seed)
    for _ in range(passes):
        moved = 0.0
        for i in order.permutation(len(rows)):
            at, scale = rows[i]
            slope = signs[i] * (share[at].sum() * scale + bias) - 1.0
            new = min(max(alpha[i] - slope / norms[i], 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * signs[i]
                share[at] += step * scale * squares[at]
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return share, bias


def calibrate(margins, truth, weight):
    """(slope, shift) of the logistic curve nearest to `truth` over `margins`, each row
    counting by its `weight`."""
    slope, shift = 1.0, 0.0
    # Softened targets keep the curve finite when the classes part cleanly.
    good, bad = (truth * weight).sum(), ((1 - truth) * weight).sum()
    target = np.where(truth > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + shift, -40, 40)))
        off = weight * (p - target)
        g = np.array([(off * margins).sum(), off.sum()])
        d = weight * np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(d * margins**2).sum(), (d * margins).sum()], [(d * margins).sum(), d.sum()]])
        step = np.linalg.solve(h + 1e-6 * np.eye(2), g)
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(slope), float(shift)


class Model:
    def __init__(self, ratio, share, bias, slope, shift):
        # Of each cell: its square, and its share of the margin.
        self.squares = (ratio**2).astype(np.float32)
        self.share = share.astype(np.float32)
        self.bias, self.slope, self.shift = bias, slope, shift

    def margin(self, at):
        length = float(self.squares[at].sum()) ** 0.5
        return (float(self.share[at].sum()) / length if length else 0.0) + self.bias

    def score(self, text):
        z = self.slope * self.margin(cells(text)) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


class Constant:
    def __init__(self, value):
        self.value = value

    def score(self, text):
        return self.value


def fold(identity):
    """The fold number that contracts name: crc32 of the id as text."""
    return F.crc32(identity.cast("string").cast("binary")) % FOLDS


def _counts(labelled):
    """Per cell: how many good and bad texts hold it."""

    def prepare():
        def work(texts, labels):
            good, bad = np.zeros(CELLS, np.int64), np.zeros(CELLS, np.int64)
            for text, label in zip(texts, labels, strict=True):
                (good if label else bad)[cells(text)] += 1
            at = np.flatnonzero(good + bad)
            return at, good[at], bad[at]

        return work

    schema = T.StructType.fromDDL("cell int, good long, bad long")
    rows = flat_rows(labelled, ["text", "label"], schema, prepare)
    return rows.groupBy("cell").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


def train(labelled: DataFrame, sample=SAMPLE):
    """A model from `labelled` (doc_id, text, label 0 or 1)."""
    labelled = labelled.where("doc_id is not null and label is not null")
    sizes = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return Constant(float(next(iter(sizes), 0.5)))
    # At most CELLS rows, whatever the size of the corpus.
    counted = _counts(labelled).toPandas()
    good, bad = np.ones(CELLS), np.ones(CELLS)
    good[counted["cell"]] += counted["good"]
    bad[counted["cell"]] += counted["bad"]
    ratio = np.log(good / (sizes[1] + 2)) - np.log(bad / (sizes[0] + 2))
    rows, labels = _sampled(labelled, ratio, sample)
    signs = np.where(np.array(labels) > 0, 1.0, -1.0)
    # Margins for the curve come from rows that the fit has not seen.
    half = np.array([i % 5 == 0 for i in range(len(rows))])
    kept = [r for r, h in zip(rows, half, strict=True) if not h]
    share, bias = descend(kept, signs[~half], ratio)
    margins = np.array([share[at].sum() * scale + bias for (at, scale), h in zip(rows, half, strict=True) if h])
    # The sample is even; the curve is for the shares among all labelled texts.
    weight = np.array([sizes[int(s > 0)] / max(1, (signs == s).sum()) for s in signs[half]])
    slope, shift = calibrate(margins, (signs[half] > 0).astype(float), weight / weight.mean())
    share, bias = descend(rows, signs, ratio)
    return Model(ratio, share, bias, slope, shift)


def _sampled(labelled, ratio, sample):
    """(cells, scale) and the label of each text that the machine is fitted on.

    The sample is chosen by ids and sizes alone, and its texts are fetched one by one.
    """
    ids = []
    for label in (0, 1):
        known = labelled.where(F.col("label") == label).groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("n"))
        room = SAMPLE_BYTES
        for r in known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect():
            room -= r["n"] or 0
            if room < 0 and ids:
                break
            ids.append((r["doc_id"], label))
    wanted = labelled.sparkSession.createDataFrame(ids, "doc_id long, label int")
    chosen = labelled.join(F.broadcast(wanted), ["doc_id", "label"], "left_semi").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    squares, rows, labels, chunk = ratio**2, [], [], []

    def close():
        # One array for many rows: large ones go back to the system when they are dropped.
        data = np.concatenate(chunk) if chunk else np.zeros(0, np.int32)
        begin = 0
        for at in chunk:
            length = float(np.sqrt(squares[at].sum()))
            rows.append((data[begin : begin + len(at)], 1 / max(length, 1e-12)))
            begin += len(at)
        chunk.clear()

    for r in chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "label").toLocalIterator():
        chunk.append(cells(r["text"]).astype(np.int32))
        labels.append(r["label"])
        if len(chunk) == CHUNK_ROWS:
            close()
    close()
    return rows, labels


def scored(docs: DataFrame, model, name="score") -> DataFrame:
    """`docs` with the score of each whole text in column `name`."""
    # The numbers are broadcast; the code goes with the task.
    shared, kind = docs.sparkSession.sparkContext.broadcast(vars(model)), type(model)

    def prepare():
        held = kind.__new__(kind)
        vars(held).update(shared.value)

        def work(texts):
            return [[held.score(t) for t in texts]]

        return work

    return map_rows(docs, ["text"], [T.StructField(name, T.DoubleType())], prepare)


def learnt_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, label) of the rows that may be learnt from: all folds but one."""
    labels = labels.select("doc_id", F.col("quality").alias("label"))
    labels = labels.where(fold(F.col("doc_id")) != HELD_OUT)
    return docs.select("doc_id", "text").join(broadcast_if_small(labels), "doc_id")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(learnt_rows(docs, labels))
    out = scored(docs.select("doc_id", "text"), model)
    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return out.select(
        "doc_id",
        held.alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of `docs` with a score of 0.5 or more."""
    name = free_name(docs, "quality_score")
    out = scored(docs, train(learnt_rows(docs, labels)), name)
    return out.where(F.col(name) >= 0.5).drop(name)
