"""Masked values, signals, chunks, n-grams and assembled groups against plain Python."""

import random
import re
import time
from collections import Counter

import pytest
from compare import rows
from pyspark.sql import functions as F

from millrace.functions import groups
from millrace.operators import texts, windows

TEXTS = [
    None, "", "  \n\t", "one", "mail a.b@c.org or 10.0.0.1, 1.2.3.4.5 and x@y", "a@b.co" * 3, "1.1.1.1@mail.com", "x\n\nx\nx\ny\nx \nx",
    "é ß 日本 !? -- ...", "to be or not to be or not to be", "a\x0bb c\x1cd", "<EMAIL>", "$1 \\ a@b.cd $0",
]


@pytest.fixture(scope="module")
def docs(spark):
    long = " ".join(f"w{i % 977}" for i in range(50_000))
    return spark.createDataFrame(list(enumerate([*TEXTS, long])), "id long, text string")


def _words(text):
    return re.findall(r"[^ \t\n\r\f]+", text or "")


def test_redact(spark, docs):
    every = re.compile("|".join(f"({p})" for p in texts.PERSONAL.values()))
    found = {r["id"]: r for r in texts.redact(docs, "text").collect()}
    for i, text in enumerate(TEXTS):
        counts = Counter(m.lastindex for m in every.finditer(text or ""))
        want = text and every.sub(lambda m: ("<EMAIL>", "<IPV4>")[m.lastindex - 1], text)
        assert (found[i]["redacted"], found[i]["n_email"], found[i]["n_ipv4"]) == (want, counts[1], counts[2]), text
    assert texts.redact(docs.limit(0), "text").isEmpty()


def test_redact_of_overlapping_kinds(spark):
    df = spark.createDataFrame([("ab12cd 12ab 12 ab",)], "t string")
    kinds = {"both": "[a-z]{2}[0-9]{2}", "digits": "[0-9]+", "word": "[a-z]+", "late": "12ab"}
    found = texts.redact(df, "t", kinds, "out").first()
    assert found["out"] == "<BOTH><WORD> <DIGITS><WORD> <DIGITS> <WORD>"
    assert [found[f"n_{k}"] for k in kinds] == [1, 2, 3, 0]


def test_redact_of_random_texts(spark):
    """Kinds that begin or end within a run of signs, against Python's expressions."""
    rng = random.Random(5)
    made = ["".join(rng.choices("ab1.-@ _", (3, 3, 5, 5, 1, 4, 1, 1), k=rng.randint(1, 40))) for _ in range(5000)]
    made += ["x@b.co1y@c.de", "1.2.3.4567@x.org", "a.1.2.3.4@b.c", "1.2.3.4a@b.cd", "@@a@b.co@c.de"]
    for kinds in (texts.PERSONAL, dict(reversed(texts.PERSONAL.items())), {"email": texts.EMAIL}):
        every, names = re.compile("|".join(f"({p})" for p in kinds.values())), list(kinds)
        df = spark.createDataFrame(list(enumerate(made)), "id long, t string")
        for r in texts.redact(df, "t", kinds).collect():
            counts = Counter(m.lastindex for m in every.finditer(r["t"]))
            want = every.sub(lambda m: f"<{names[m.lastindex - 1].upper()}>", r["t"])
            assert (r["redacted"], *[r[f"n_{n}"] for n in names]) == (want, *[counts[i] for i in range(1, len(names) + 1)]), r["t"]


def test_redact_reads_a_long_run_once(spark):
    """A run of 300,000 signs was read from each of its places, for minutes."""
    df = spark.createDataFrame([("x" * 300_000 + " a@b.co",)], "t string")
    begun = time.time()
    found = texts.redact(df, "t").first()
    assert found["redacted"] == "x" * 300_000 + " <EMAIL>" and (found["n_email"], found["n_ipv4"]) == (1, 0)
    assert time.time() - begun < 20


def test_quality_signals(docs):
    found = {r["id"]: r for r in texts.quality_signals(docs, "text").collect()}
    for i, text in enumerate(TEXTS):
        r, w = found[i], _words(text)
        lines = [x for x in (text or "").split("\n") if _words(x)]
        run = most = 0
        for k, line in enumerate(lines):
            run = run + 1 if k and lines[k - 1] == line else 1
            most = max(most, run)
        symbols = len(re.findall(r"[!-/:-@\[-`{-~]", text or ""))
        assert (r["n_words"], r["n_lines"], r["longest_run"]) == (len(w), len(lines), most), text
        assert r["mean_word_length"] == (sum(map(len, w)) / len(w) if w else None)
        assert r["symbol_share"] == (symbols / len(text) if text else None)
        assert r["repeated_line_share"] == (1 - len(set(lines)) / len(lines) if lines else None) or abs(r["repeated_line_share"] - (1 - len(set(lines)) / len(lines))) < 1e-15


@pytest.mark.parametrize(("size", "overlap"), [(5, 0), (5, 2), (1, 0), (200, 199), (60_000, 5)])
def test_chunks_join_to_the_text(docs, size, overlap):
    long = docs if size > 1 else docs.where("id < 13")
    if overlap == 199:
        long = docs.where("id < 13")
    found = {}
    for r in texts.chunk(long, "id", "text", size, overlap).orderBy("id", "chunk").collect():
        found.setdefault(r["id"], []).append(r)
    for r in long.collect():
        w, parts = _words(r["text"]), found.get(r["id"], [])
        joined = []
        for k, p in enumerate(parts):
            assert p["chunk"] == k and p["first_word"] == k * (size - overlap)
            assert p["text"].split(" ") == w[p["first_word"] : p["last_word"] + 1]
            joined += p["text"].split(" ")[overlap if k else 0 :]
            assert p["last_word"] - p["first_word"] + 1 == size or k == len(parts) - 1
        assert joined == w
        assert len({p["chunk_id"] for p in parts}) == len(parts)
    with pytest.raises(ValueError):
        texts.chunk(docs, "id", "text", 3, 3)


@pytest.mark.parametrize("k", [1, 3])
def test_ngrams(spark, docs, k):
    want, per = Counter(), []
    for r in docs.collect():
        w = _words(r["text"])
        grams = Counter(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
        want.update(grams)
        per += [(r["id"], g, n) for g, n in grams.items()]
    assert Counter(map(tuple, texts.ngrams(docs, "id", "text", k).collect())) == Counter(per)
    seen = Counter(g for _, g, _ in per)
    counted = texts.ngram_counts(docs, "text", k)
    assert {r["gram"]: (r["occurrences"], r["texts"]) for r in counted.collect()} == {g: (n, seen[g]) for g, n in want.items()}
    assert not re.search("Python|Pandas|Arrow", counted._jdf.queryExecution().toString())


def test_a_very_common_gram_is_counted_before_the_shuffle(spark):
    df = spark.range(20_000).repartition(4).select(F.concat(F.lit("to be or "), F.col("id").cast("string")).alias("t"))
    found = texts.ngram_counts(df, "t", 3)
    assert rows(found.where("texts > 1")) == [("to be or", 20_000, 20_000)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan


def _shuffled(df, kind="shuffleBytesWritten"):
    """Bytes that the shuffles of `df` wrote, from the metrics of the plan that ran."""
    df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "ShuffleExchangeExec":
            found += node.metrics().apply(kind).value()
        inner = {"AdaptiveSparkPlanExec": "executedPlan", "ShuffleQueryStageExec": "plan", "ResultQueryStageExec": "plan"}
        below = node.children()
        todo += [getattr(node, inner[name])()] if name in inner else [below.apply(i) for i in range(below.size())]
    return found


def test_counted_grams_are_shuffled_as_numbers(spark):
    """Whole grams were shuffled, three words each."""
    rng = random.Random(8)
    known = [f"{i:x}-{rng.random()}" for i in range(500)]
    df = spark.createDataFrame([(" ".join(rng.choices(known, k=200)),) for _ in range(200)], "t string")
    plain = texts.ngrams(df.withColumn("id", F.lit(1)), "id", "t", 3).groupBy("gram").agg(F.sum("n"), F.count("n"))
    found = texts.ngram_counts(df, "t", 3)
    assert _shuffled(found) < 0.5 * _shuffled(plain)
    assert sorted(rows(found)) == sorted(rows(plain))


@pytest.mark.parametrize(("numbered", "k"), [(0, 3), (2, 1), (40, 3), (40, 4), (1 << 20, 7)])
def test_grams_of_words_without_a_number(spark, monkeypatch, numbered, k):
    """Any share of the words may have numbers, on any place of a gram."""
    rng = random.Random(numbered + k)
    known = ["0", "1", "!", "é", "日本", "\U0001f600", "\x0b", "\u00a0", "null", "a", "A", "a,", "", *(f"w{i}" for i in range(60))]
    made = [" ".join(rng.choices(known, [80 / (i + 1) for i in range(len(known))], k=rng.randint(0, 30))) for _ in range(150)]
    made += [None, "", " ", *made[:5]]
    monkeypatch.setattr(texts, "NUMBERED", numbered)
    occurrences, seen = Counter(), Counter()
    for t in made:
        w = _words(t)
        grams = Counter(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
        occurrences.update(grams)
        seen.update(grams.keys())
    found = texts.ngram_counts(spark.createDataFrame([(t,) for t in made], "t string"), "t", k)
    assert Counter(rows(found)) == Counter((g, n, seen[g]) for g, n in occurrences.items())


def test_assembled_groups(spark, monkeypatch):
    """A third of all rows is one group, with repeated and null orders: no long array."""
    rng = random.Random(4)
    made = [(rng.choice([7, 7, 7, 1, 2, None]), rng.choice([None, *range(400)]), f"t{i}") for i in range(2000)]
    df = spark.createDataFrame(made, "c long, turn long, text string")
    want = {}
    for c, turn, text in made:
        want.setdefault(c, []).append(((turn is not None, turn or 0, text), (turn, text)))
    want = {c: [r for _, r in sorted(x)] for c, x in want.items()}
    for cut in (1_000_000, 50):
        monkeypatch.setattr(groups, "SPLIT_ROWS", cut)
        found = {}
        for r in windows.assemble(df, "c", ["turn", "text"], ["turn", "text"], "turns", 64).orderBy("c", "segment").collect():
            assert r["first"] == r["segment"] * 64 and len(r["turns"]) <= 64
            found.setdefault(r["c"], []).extend(map(tuple, r["turns"]))
        assert found == want
    assert windows.assemble(df.limit(0), "c", ["turn"], ["text"]).isEmpty()
