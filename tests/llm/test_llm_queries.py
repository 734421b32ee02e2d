"""The numbered queries: against SQL where there is some, else against brute force."""

import zlib

import numpy as np
import pytest
from compare import differences, open_tables

import corpus_pipeline
from millrace.llm import contamination, line_dedup, near_dedup, packing, quality
from millrace.llm.queries import QUERIES, SQL, vocabulary

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizers():
    return pytest.importorskip("tokenizers")


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    assert differences(QUERIES[name](spark, FOLDER), open_tables(FOLDER), SQL[name]) == []


def _auc(score, truth):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    good = truth == 1
    return (rank[good].mean() - (good.sum() - 1) / 2) / (~good).sum()


# Some toxic labels of these tables are on texts without a toxic word.
@pytest.mark.parametrize(
    ("name", "label", "folds", "held", "least"),
    [("op2_toxicity", "toxic", 5, 0, 0.97), ("op6_quality", "quality", 3, 1, 0.99)],
)
def test_classifier_on_held_out_rows(spark, name, label, folds, held, least):
    folder = "/root/testdata/sf0.1"
    found = QUERIES[name](spark, folder).toPandas()
    assert len(found) == spark.read.parquet(f"{folder}/documents.parquet").count()
    expected = [zlib.crc32(str(i).encode()) % folds == held for i in found["doc_id"]]
    assert found["held_out"].tolist() == expected
    assert (found["predicted"] == (found["score"] >= 0.5)).all()
    assert found["score"].between(0, 1).all()
    rows = spark.read.parquet(f"{folder}/labels.parquet").toPandas().merge(found, on="doc_id")
    rows = rows[rows["held_out"]]
    assert _auc(rows["score"].to_numpy(), rows[label].to_numpy()) > least
    assert (rows["predicted"] == rows[label]).mean() > 0.98


def _check_packing(found, texts, tokenizer):
    """Pieces are those of the tokenizer, and each sequence is filled without a gap."""
    at = {}
    for r in found.itertuples():
        at.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for doc, text in texts.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        want = [
            (k, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes()))
            for k, s in enumerate(range(0, len(ids), 4096))
        ]
        assert sorted(at[doc]) == want
    for _, rows in found.sort_values("offset").groupby("sequence_id"):
        ends = rows["length"].cumsum()
        assert (rows["offset"].to_numpy() == (ends - rows["length"]).to_numpy()).all()
        assert ends.max() <= 4096
    # Best fit decreasing is within 11/9 of the fewest sequences; here it is close to full.
    assert found["sequence_id"].nunique() <= 1.02 * found["length"].sum() / 4096 + 1


def test_packing_against_the_tokenizer(spark, tokenizers):
    found = QUERIES["op3_packing"](spark, FOLDER).toPandas()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").toPandas()
    tokenizer = tokenizers.Tokenizer.from_str(vocabulary("word_bpe_49k.json"))
    _check_packing(found, dict(zip(docs["doc_id"], docs["text"], strict=True)), tokenizer)


def test_token_counts_against_the_library(spark, tokenizers):
    found = {r["doc_id"]: r for r in QUERIES["op5_token_counts"](spark, FOLDER).collect()}
    tokenizer = tokenizers.Tokenizer.from_str(vocabulary("byte_bpe_50k.json"))
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        n = len(tokenizer.encode(r["text"], add_special_tokens=False).ids)
        got = found[r["doc_id"]]
        assert (got["n_bytes"], got["n_tokens"], got["over_limit"]) == (len(r["text"].encode()), n, n > 512)


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.1"])
def test_neighbours_against_brute_force(spark, folder):
    found = QUERIES["op7_neighbours"](spark, folder).toPandas()
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    x, ids = np.array(rows["embedding"].tolist(), float), rows["vec_id"].to_numpy()
    hits = []
    for i in np.flatnonzero(ids % 20 == 0):
        score = x @ x[i]
        score[i] = -np.inf
        best = set(ids[np.lexsort((ids, -score))[:20]].tolist())
        mine = found[found["query_id"] == ids[i]].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21))
        assert (np.diff(mine["score"]) <= 0).all()
        place = {v: k for k, v in enumerate(ids.tolist())}
        exact = [x[i] @ x[place[v]] for v in mine["vec_id"]]
        assert np.allclose(mine["score"], exact, rtol=0, atol=1e-12)
        hits.append(len(best & set(mine["vec_id"])) / 20)
    assert np.mean(hits) >= 0.95


def test_extraction_keeps_the_article(spark):
    import html
    import re

    pages = {r["page_id"]: r for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    for r in QUERIES["op4_extraction"](spark, FOLDER).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r["page_id"]]["html"], re.DOTALL)[1]
        parts = re.split(r"</?(?:h1|p)>", inner)
        parts = [" ".join(html.unescape(re.sub("<[^>]+>", " ", p)).split()) for p in parts]
        assert r["text"] == "\n\n".join(p for p in parts if p)
        assert r["n_chars"] == len(r["text"])


def test_pipeline_is_its_stages(spark, tokenizers):
    """The result of `run` is that of the operators applied in turn, and decisions take effect."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    good = {r["doc_id"] for r in quality.report(docs, labels).where("predicted = 1").collect()}
    kept = [r for r in docs.collect() if r["doc_id"] in good]
    one = spark.createDataFrame(kept, docs.schema)
    lines = {r["doc_id"]: r for r in line_dedup.without_repeats(one).collect()}
    two = [
        r.asDict() | {"text": lines[r["doc_id"]]["text"], "n_chars": len(lines[r["doc_id"]]["text"])}
        for r in kept
        if not lines[r["doc_id"]]["n_removed"] or lines[r["doc_id"]]["text"].split()
    ]
    two = spark.createDataFrame(two, docs.schema)
    near = {r["doc_id"] for r in near_dedup.groups(two).where("kept or n_shingles = 0").collect()}
    dirty = {r["doc_id"] for r in contamination.report(two, benchmark).where("contaminated").collect()}
    texts = {r["doc_id"]: r["text"] for r in two.collect() if r["doc_id"] in near - dirty}
    found = corpus_pipeline.run(spark, FOLDER).toPandas()
    assert set(found["doc_id"]) == set(texts)
    tokenizer = tokenizers.Tokenizer.from_str(vocabulary("word_bpe_49k.json"))
    _check_packing(found, texts, tokenizer)


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == docs.columns
    assert packing.CAPACITY == 4096
