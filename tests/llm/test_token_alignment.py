"""Aligned tokens against the libraries and loops over bytes."""

import bisect
import hashlib
import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import token_alignment
from millrace.llm.queries import QUERIES, _model, vocabulary

FOLDER = "/root/testdata/sf0.001"
NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


@pytest.fixture(scope="module")
def codes():
    pytest.importorskip("tokenizers")
    pytest.importorskip("sentencepiece")
    return vocabulary("byte_bpe_50k.json"), _model("piece_bpe_32k.model")


def _brute(texts, codes):
    """Rows of numbers and digest, one text after the other, with sets of byte ranges."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_str(codes[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_proto=codes[1])
    names = {i: t for t, i in json.loads(codes[0])["model"]["vocab"].items()}
    letters = {x: y for y, x in token_alignment._byte_letters().items()}
    made, links = [], Counter()
    for text in texts:
        data = (" " + (text or "")).encode()
        ia = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ib = b.encode(text) if text else []
        ta = [bytes(letters[x] for x in names.get(i, "")) for i in ia]
        tb = []
        for i in ib:
            piece = b.id_to_piece(i)
            tb.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode())
        if not text or b"".join(ta) != data or b"".join(tb) != data:
            made.append(([], [], [], []))
            continue
        ends = [np.cumsum([len(t) for t in x]).tolist() for x in (ta, tb)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        # The token of each byte, from either side: equal neighbours are one link.
        at = [[k for k, t in enumerate(x) for _ in t] for x in (ta, tb)]
        found = [(ia[x], ib[y]) for x, y in dict.fromkeys(zip(*at, strict=True))]
        of = [[bisect.bisect_left(cuts, e) for e in x] for x in ends]
        sides = [[[] for _ in cuts] for _ in of]
        for side, x, y in zip(sides, (ia, ib), of, strict=True):
            for i, g in zip(x, y, strict=True):
                side[g].append(str(i))
        groups = ["|".join(map(",".join, pair)) for pair in zip(*sides, strict=True)]
        links.update(found)
        made.append((ia, ib, groups, found))
    best = Counter()
    for (_, y), n in links.items():
        best[y] = max(best[y], n)
    return [
        (
            len(ia), len(ib), len(groups), len(found), sum(links[p] == best[p[1]] for p in found), sum(links[p] for p in found),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if ia else "",
        )
        for ia, ib, groups, found in made
    ]


ODD = [
    None, "", " ", "   ", "a", "a ", " a  b   c ", "\t x\n\ny", "x▁y", "a b▁c d", "İ ﬁ Å ½ ² ş", "日本語 テスト　全角", "😀👍🏽 é é",
    "<|endoftext|> a <s> b</s> <unk> <0x41>", "don't it's I'LL 's", "a\x00b \x1c c\x1fd\x85e  f", "\r\n a\r b", "ᄀ각 ﷺ ☃", "x" * 3000,
    "ab " * 900, "\n" * 300 + " " * 300, "1234567890 3.14 -- ... !?", "٣٤٥ ₝ ՘ ֋", "𑷠𑷡 𝒳", "word", "word",
]


@pytest.mark.parametrize("held", [None, 5])
def test_against_the_libraries(spark, codes, monkeypatch, held):
    if held:
        # Few pairs broadcast, partial counts given on often: the rest is joined.
        monkeypatch.setattr(token_alignment, "HEAD_PAIRS", held)
        monkeypatch.setattr(token_alignment, "HELD_PAIRS", held)
        monkeypatch.setattr(token_alignment, "ROW_PAIRS", 3)
    docs = [r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").limit(20).collect()]
    texts = ODD + docs
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    table = table.withColumn("row", F.lit("extra")).withColumn("pairs", F.lit(1)).repartition(3)
    found = {r["doc_id"]: r for r in token_alignment.report(table, *codes).collect()}
    for i, want in enumerate(_brute(texts, codes)):
        assert tuple(found[i][n] for n in [*NUMBERS, "groups_sha256"]) == want, texts[i][:40] if texts[i] else texts[i]
    assert len(found) == len(texts)


def test_rows_of_one_document_and_none(spark, codes):
    schema = "doc_id long, text string"
    one = token_alignment.report(spark.createDataFrame([(1, "to be")], schema), *codes).first()
    two = token_alignment.report(spark.createDataFrame([(1, "to be"), (1, "to be"), (None, None)], schema), *codes)
    two = sorted(two.collect(), key=lambda r: r["n_a"])
    assert two[0]["doc_id"] is None and two[0]["groups_sha256"] == "" and two[0]["count_sum"] == 0
    assert two[1] == two[2] and two[1]["count_sum"] == 2 * one["count_sum"]
    assert token_alignment.report(spark.createDataFrame([], schema), *codes).isEmpty()


def test_units_join_to_the_text(codes):
    rng = random.Random(1)
    encoder = token_alignment.Encoder(*codes)
    assert encoder.cuttable
    texts = ["".join(rng.choice("ab1.,' \n\t　é") for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    assert all("".join(token_alignment.UNIT.findall(" " + t)) == " " + t for t in texts)
    a, b = encoder.lists(texts)
    assert a.to_pylist() == [e.ids for e in encoder.a.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert b.to_pylist() == encoder.b.encode(texts)


def test_groups_share_bytes(spark, codes):
    docs = spark.createDataFrame([(1, "unbelievable things"), (2, None)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in token_alignment.token_groups(docs, *codes).collect()}
    encoder = token_alignment.Encoder(*codes)
    for a, b in zip(found[1]["groups_a"], found[1]["groups_b"], strict=True):
        assert b"".join(encoder.bytes_a[i] for i in a) == b"".join(encoder.bytes_b[i] for i in b)
    assert found[2]["groups_a"] == []


def test_whole_table(spark, codes):
    found = QUERIES["op12_token_alignment"](spark, FOLDER)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = found.collect()
    want = dict(zip(docs, _brute(list(docs.values()), codes), strict=True))
    assert {r["doc_id"]: tuple(r[n] for n in [*NUMBERS, "groups_sha256"]) for r in rows} == want
