"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import (
    contamination,
    extraction,
    line_dedup,
    near_dedup,
    neighbours,
    packing,
    quality,
    secrets,
    token_counts,
    toxicity,
)
from millrace.llm.queries import vocabulary

DOCS = "doc_id long, text string"
#: Names that operators use for columns of their own.
CLASH = ["hash", "class", "bench_words", "bench", "quality_score", "near_hash", "removed", "text_hash", "doc_key", "n_lines"]


def words(seed, n, vocabulary=4000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def text(seed, n):
    return " ".join(words(seed, n))


def table(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def wide(df):
    """`df` with extra columns whose names clash with inner ones."""
    for name in CLASH:
        df = df.withColumn(name, F.lit("extra"))
    return df


@pytest.fixture(scope="module")
def long_text():
    return text(99, 60_000)


@pytest.fixture(scope="module")
def odd(spark, long_text):
    rows = [
        (1, None), (2, ""), (3, "   \n\t "), (None, text(3, 40)), (4, text(4, 40)), (4, text(4, 40)),
        (5, long_text), (6, text(4, 40)), (7, "one"), (8, "ÀÉ ünï 日本 😀"), (None, None), (9, "a\x00b\x1cc d"),
    ]
    return table(spark, rows)


def test_contamination(spark, odd, long_text):
    items = [(1, text(4, 40)), (2, "one"), (3, None), (None, text(3, 40)), (10, " ".join(long_text.split()[500:513])), (4, "...")]
    bench = table(spark, items, "item_id long, text string")
    found = {(r["doc_id"], r["n_words"]): r for r in contamination.report(odd, bench).collect()}
    assert found[(1, 0)]["contaminated"] is False
    assert found[(4, 40)]["n_hit"] == 40 and found[(4, 40)]["n_items"] == 1
    assert found[(7, 1)]["contaminated"] is True
    assert found[(5, 60_000)]["n_hit"] == 13 and not found[(5, 60_000)]["contaminated"]
    # An item without an id marks words but is not listed.
    assert found[(None, 40)]["n_hit"] == 40 and found[(None, 40)]["n_items"] == 0
    clean = contamination.clean(wide(odd), bench)
    assert clean.columns == wide(odd).columns
    assert sorted(r["doc_id"] or 0 for r in clean.collect()) == [0, 1, 2, 3, 5, 8, 9]
    assert contamination.report(odd, bench.limit(0)).where("n_hit > 0").isEmpty()
    assert contamination.report(odd.limit(0), bench).isEmpty()


def test_contamination_spans_and_shards(spark, monkeypatch):
    docs = table(spark, [(1, "Été: " + text(1, 20).upper() + " - end")])
    bench = table(spark, [(i, " ".join(words(1, 20)[i : i + 13])) for i in range(5)], "item_id long, text string")
    one = contamination.scan(docs, bench).first()
    assert [docs.first()["text"][s["start"] : s["end"]] for s in one["bench_spans"]] == [" ".join(words(1, 20)[:17]).upper()]
    # Small automatons, many passes: the same answer.
    monkeypatch.setattr(contamination, "AUTOMATON_BYTES", 100)
    assert contamination.scan(docs, bench).first() == one


def test_line_dedup(spark):
    base = words(1, 14)
    changed, shorter = [*base[:3], "other", *base[4:]], base[:-1]
    rows = [
        (1, " ".join(base) + "\nshort line\n" + text(2, 7)),
        (2, " ".join(changed).upper() + "\nshort line"),
        (3, "  ".join(shorter) + "\n" + text(2, 7) + "\n" + text(2, 6)),
        (4, " ".join([*base[:2], "x", "y", *base[4:]])),
        (5, None), (6, ""), (None, " ".join(base)), (7, text(5, 20)), (7, text(5, 20)), (8, text(9, 30_000)),
    ]
    found = [(r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.without_repeats(table(spark, rows)).collect()]
    by = {f[0]: f for f in found}
    assert by[1][3] == 0
    assert by[2][1] == "short line" and by[2][3] == 1
    assert by[3][1] == text(2, 6) and by[3][3] == 2
    # Two words away from the first, but one from the second.
    assert by[4][3] == 0 or by[4][1] == ""
    assert by[5][1] is None and by[5][2] == 0
    assert by[6][1] == "" and by[None][3] == 0 and by[7][3] == 0 and by[8][3] == 0
    assert len(found) == len(rows)
    kept = line_dedup.clean(wide(table(spark, rows)))
    assert kept.columns == wide(table(spark, rows)).columns
    assert line_dedup.clean(table(spark, [], DOCS)).isEmpty()


def test_line_dedup_stores_lines_of_repeated_rows_once(spark, monkeypatch):
    sizes, stored = {}, line_dedup._stored

    def counted(df, name):
        out = stored(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(line_dedup, "_stored", counted)
    line = text(5, 12)
    docs = table(spark, [(1, f"{line} x\n{line} y")] * 20)
    removed = [r["removed"] for r in line_dedup.repeated_lines(docs).collect()]
    assert removed == [[1]] and sizes["suspect-lines"] == 2


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(5)
    pool = [words(s, rng.randrange(4, 16), 30) for s in range(25)]
    docs = []
    for doc in range(60):
        lines = []
        for _ in range(4):
            line = list(rng.choice(pool))
            kind, i = rng.randrange(4), rng.randrange(len(line))
            if kind == 1:
                line[i] = "z"
            elif kind == 2:
                del line[i]
            elif kind == 3:
                line.insert(i, "z")
            lines.append(" ".join(line))
        docs.append((doc, "\n".join(lines)))

    def apart(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    seen, want = [], {}
    for doc, t in docs:
        for n, line in enumerate(t.split("\n")):
            w = line.split()
            if len(w) >= 5 and any(w == o or len(w) >= 10 and len(o) >= 10 and apart(w, o) <= 1 for o in seen):
                want.setdefault(doc, set()).add(n)
            seen.append(w)
    found = {r["doc_id"]: set(r["removed"]) for r in line_dedup.repeated_lines(table(spark, docs)).collect()}
    assert found == want


def test_near_dedup(spark, odd):
    found = near_dedup.groups(odd)
    rows = {(r["doc_id"], r["n_shingles"]): r for r in found.collect()}
    assert rows[(1, 0)]["kept"] and rows[(2, 0)]["component_id"] == 2
    assert rows[(6, 36)]["component_id"] == 4 and not rows[(6, 36)]["kept"]
    assert rows[(7, 1)]["kept"] and not rows[(None, 36)]["kept"]
    assert found.count() == odd.count()
    one = near_dedup.keep_one(wide(odd))
    assert one.columns == wide(odd).columns
    assert sorted(r["doc_id"] or 0 for r in one.collect()) == [0, 0, 1, 2, 3, 4, 5, 7, 8, 9]
    assert near_dedup.groups(odd.limit(0)).isEmpty()


def test_near_dedup_against_brute_force(spark):
    """Copies with changes, chains, and texts that share a passage without being similar."""
    rng = random.Random(2)
    passage = text(77, 60)
    rows = []
    for i in range(300):
        kind = i % 3
        if kind == 0:
            rows.append((i, passage + " " + text(1000 + i, rng.randrange(5, 40))))
        elif kind == 1:
            w = words(i // 60, 120)
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = f"x{rng.random()}"
            rows.append((i, " ".join(w)))
        else:
            rows.append((i, text(i, rng.randrange(1, 80))))
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.groups(table(spark, rows)).collect()}
    assert found == {i: (len(s), find(i)) for i, s in sets.items()}
    assert len({find(i) for i in sets}) < 280


def test_sketches_estimate_and_merge():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    a, b = near_dedup.registers(values[:1000]), near_dedup.registers(values[500:])
    size = np.array([1000.0])
    likely, worse = near_dedup.likely_similarity(size, size, a[None], b[None])
    assert abs(likely[0] - 1 / 3) < 0.12 and worse[0] > near_dedup.RULED_OUT
    assert (near_dedup.merged(a, b) == near_dedup.registers(values)).all()


def test_packing_plan():
    rng = random.Random(3)
    for sizes in ([4096] * 3, [2048] * 5, [1366] * 7, [1] * 10_000, [], [rng.randrange(1, 4097) for _ in range(3000)]):
        counts = {}
        for n in sizes:
            counts[n] = counts.get(n, 0) + 1
        ranges, used = packing.plan(counts)
        bins, ranks = {}, {}
        for length, low, high, first, offset in ranges:
            for k in range(high - low):
                bins.setdefault(first + k, []).append((offset, length))
            ranks.setdefault(length, []).extend(range(low, high))
        assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
        for parts in bins.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 4096 and sum(3 * n > 4096 for _, n in parts) <= 2
        assert len(bins) == used
        assert used <= max(1.06 * sum(sizes) / 4096, sum(2 * n > 4096 for n in sizes)) + 2


def test_packing_odd_rows(spark, odd):
    tokenizers = pytest.importorskip("tokenizers")
    code = vocabulary("word_bpe_49k.json")
    found = packing.packed(odd, code)
    assert found.where("doc_id = 1").select("length", "start").collect() == [(1, 0)]
    assert found.where("doc_id = 5").count() > 10
    assert packing.packed(odd.limit(0), code).isEmpty()
    cases = ["it's you're 'sx ''s 'qť", "ΟΔΟΣ Σ", "½ ² 12", "<|endoftext|>a", "İx Å é", "a\x1cb", "", "x" * 5000]
    plain = tokenizers.Tokenizer.from_str(code)
    ids = packing.WordIds(plain).packed(cases)
    assert ids == [np.array(plain.encode(c, add_special_tokens=False).ids, "<u4").tobytes() for c in cases]


def test_packing_of_every_code_point():
    """Alone, twice, and between letters and numbers, as the tokenizer has it."""
    tokenizers = pytest.importorskip("tokenizers")
    plain = tokenizers.Tokenizer.from_str(vocabulary("word_bpe_49k.json"))
    ids = packing.WordIds(plain)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not 0x3400 <= c < 0x9F00 and not 0x20000 <= c < 0xE0000 and c < 0xF0000]
    points += list("\u3400\u9fff\uac00\U00020000\U0002ffff\U00030000\U000f0000\U0010ffff")
    for begin in range(0, len(points), 500):
        texts = [f"{c} ab{c}x {c}{c} 1{c}2" for c in points[begin : begin + 500]]
        want = [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]
        assert ids.packed(texts) == want, begin
    odd = ["ab\u209dx", "x\u0558", "a\u058bb", "ab\U00011de0\U00011de1", "\u0378", "\U0001ccf0" * 3]
    assert ids.packed(odd) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in odd]


def test_token_counts_odd_rows(spark, odd):
    tokenizers = pytest.importorskip("tokenizers")
    code = vocabulary("byte_bpe_50k.json")
    plain = tokenizers.Tokenizer.from_str(code)
    rows = token_counts.report(odd, code).collect()
    assert sorted(r["n_tokens"] for r in rows) == sorted(
        len(plain.encode(r["text"] or "", add_special_tokens=False).ids) for r in odd.collect()
    )
    cases = ["a<|endoftext|>b", "a" * 999, "ab" * 777, " \n x  ", "'s 'S", "\x85 \xa0q\x1c"]
    counter = token_counts.Counter(token_counts.read_vocabulary(code))
    assert counter.counts(cases) == [len(plain.encode(c, add_special_tokens=False).ids) for c in cases]


def test_token_counts_of_long_pre_tokens():
    """Runs without a break: as the library has them, in time in proportion to their length."""
    import time

    tokenizers = pytest.importorskip("tokenizers")
    code = vocabulary("byte_bpe_50k.json")
    plain, counter = tokenizers.Tokenizer.from_str(code), token_counts.Counter(token_counts.read_vocabulary(code))
    rng = random.Random(8)
    makers = [lambda n: "".join(rng.choices("etaoinshrdlu", k=n)), lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n)), lambda n: "a" * n, lambda n: "ab" * (n // 2), lambda n: "=-" * (n // 2)]
    cases = [make(n) for make in makers for n in (1000, 2500, 20_000)]
    assert counter.counts(cases) == [len(plain.encode(c, add_special_tokens=False).ids) for c in cases]
    begin = time.process_time()
    counter.counts([makers[0](2_000_000)])
    assert time.process_time() - begin < 60


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_odd_rows(spark, odd, module, label):
    labels = "doc_id long, quality int, toxic int"
    for rows in ([], [(4, 1, 1)], [(4, 1, 1), (5, 0, 0), (6, None, None), (None, 1, 1), (7, 0, 1), (8, 1, 0), (9, 0, 0)]):
        found = module.report(odd, table(spark, rows, labels)).collect()
        assert len(found) == odd.count()
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    assert module.report(odd.limit(0), table(spark, rows, labels)).isEmpty()
    if module is quality:
        assert module.accepted(wide(odd), table(spark, [], labels)).columns == wide(odd).columns


def test_toxic_spans(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        w = words(i, 60)
        if i % 4 == 0:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(["Vermin", "blockhead"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 4 == 0)))
    docs = table(spark, rows)
    model = toxicity.train(toxicity.learnt_rows(docs, table(spark, labels, "doc_id long, quality int, toxic int")))
    for r in toxicity.scored(docs, model).where("doc_id < 40").collect():
        hit = {r["text"][s["start"] : s["end"]].lower() for s in r["toxic_spans"]}
        assert hit == set(re.findall("vermin|blockhead", r["text"].lower()))
        assert (r["score"] >= 0.5) == (r["doc_id"] % 4 == 0)


def test_chain_against_plain_sums():
    """Blocked forward-backward vectors give the marginals of all label sequences."""
    rng = np.random.default_rng(4)
    emission, moves = rng.normal(size=7), np.exp(rng.normal(size=(2, 2)))
    found = toxicity.Words(["a b c d", "", "e f g"], toxicity.BY_ALPHANUMERIC)
    got = toxicity.marginals(*toxicity.forward_backward(toxicity.chain(found, emission, moves)[0]))
    want = []
    for part in (emission[:4], emission[4:]):
        total, each = 0.0, np.zeros(len(part))
        for code in range(1 << len(part)):
            y = [(code >> k) & 1 for k in range(len(part))]
            weight = np.exp(sum(e for e, v in zip(part, y, strict=True) if v))
            for a, b in zip(y, y[1:], strict=False):
                weight *= moves[a, b]
            total, each = total + weight, each + weight * np.array(y)
        want.extend(each / total)
    assert np.allclose(got, want)


def test_extraction_odd_rows(spark):
    page = (
        '<html><body><header>Top</header><div class="cookie-notice">We</div><div class="post n12">'
        "<h2>A &amp; B</h2><p>One <b>two</b> &lt;x&gt;<p>Three<br>four</p><ul><li>i<li>j</ul>"
        "<script>var a = '</p>';</script><!-- no --></div><div class=comments><p>Me too</p></div>"
        "<form><p>Sub</p></form><aside>x</aside><footer>f</footer></body></html>"
    )
    rows = [
        (1, "http://a.example/1", page), (2, "http://a.example/2", page.replace("n12", "n13")), (3, None, page),
        (4, "nohost", None), (5, "http://a.example/5", ""), (6, "http://b.example/", "plain &copy; <b>text"),
        (None, "http://a.example/1", page), (7, "http://a.example/7", "<p>" + text(1, 50_000)), (8, "http://c.example", "<a href='x"),
    ]
    pages = table(spark, rows, "page_id long, url string, html string").withColumn("host", F.lit("extra")).withColumn("path", F.lit(1))
    found = {r["page_id"]: r for r in extraction.extract(pages).collect()}
    want = "A & B\n\nOne two <x>\n\nThree four\n\ni\n\nj"
    assert [found[k]["text"] for k in (1, 2, 3, None)] == [want] * 4
    assert found[4]["text"] == "" and found[5]["n_chars"] == 0
    assert found[6]["text"] == "plain © text" and found[7]["text"] == text(1, 50_000)
    assert len(found) == 9
    assert extraction.extract(pages.limit(0)).isEmpty()


def test_extraction_keeps_all_text_of_plain_divs(spark):
    long, links = text(1, 200), "<ul><li><a href=x>more</a></ul>"
    bodies = {
        "title": "<div class=post><h1>Title</h1><div class=entry><p>LONG</p></div></div>",
        "lead": "<div class=post><div class=lead>Lead</div><div class=body><p>LONG</p></div></div>",
        "sections": "<div class=content><p>Intro</p><section><p>LONG</p></section><section><h2>B</h2><p>LONG</p></section></div>",
        "list": "<div class=content><p>Intro</p><ul><li>LONG<li>LONG</ul><p>End</p></div>",
        "body": "<h1>Title</h1><div class=entry><p>LONG</p></div>",
    }
    wants = {"title": "Title|LONG", "lead": "Lead|LONG", "sections": "Intro|LONG|B|LONG", "list": "Intro|LONG|LONG|End", "body": "Title|LONG"}
    rows = [(i, f"http://{k}.example/{i}", f"<body>{'' if k == 'body' else links}{v}<footer>f</footer>".replace("LONG", long)) for k, v in bodies.items() for i in range(3)]
    # Most pages of a host have no title: one that has keeps it. Text outside an article stays out.
    rows += [(i, f"http://mixed.example/{i}", f"<body><div class=post>{'<h1>Title</h1>' if i == 3 else ''}<div class=entry><p>{long}</p></div></div>") for i in range(4)]
    rows += [(i, f"http://art.example/{i}", f"<body><div>out</div><article><h1>Title</h1><div><p>{long}</p></div></article>") for i in range(3)]
    found = extraction.extract(table(spark, rows, "page_id long, url string, html string")).collect()
    for r in found:
        host = r["url"].split("/")[2].split(".")[0]
        want = wants.get(host) or ("Title|LONG" if host == "art" or r["page_id"] == 3 else "LONG")
        assert r["text"] == want.replace("|", "\n\n").replace("LONG", long), r["url"]
    assert len(found) == len(rows)


def test_extraction_looks_inside_marked_elements(spark):
    body = f"<h1>Title</h1><p>{text(1, 60)}</p>"
    want = f"Title\n\n{text(1, 60)}"
    extras = "<div class='cookie-notice'><p>We</p></div><ul class=site-menu><li>Home</ul><div id=comments><p>Me too</p></div>"
    wraps = [
        "<div class='content-sidebar-wrap'>X</div>", "<div class='page has-sidebar'>X</div>", "<div class='layout-with-sidebar'>X</div>",
        "<article class='post comments-open'>X</article>", "<article class='post comments'>X</article>", "<div id=widget>X</div>",
        "<form id=aspnet>X</form>", "<form><div class=popup>X</div></form>",
    ]
    rows = [(i, f"http://h{i}.example/", f"<body>{w.replace('X', body + extras)}</body>") for i, w in enumerate(wraps)]
    code = "<article><p>One <em class=notice>two</em> three</p><pre><code>a <span class='hljs-comment'># b</span> <span class='token comment'>c</span></code></pre></article>"
    rows.append((100, "http://code.example/", code))
    # Long comments beside a short text are comments all the same, as are adverts without paragraphs.
    rows.append((101, "http://comments.example/", f"<div class=post><p>Short</p><div id=comments><p>{text(2, 80)}</p></div><div class=ad>{text(3, 80)}</div></div>"))
    rows.append((102, "http://wordpress.example/", f"<div class=post><p>Short</p></div><div id=comments><article class='comment-body'><p>{text(2, 80)}</p></article></div>"))
    found = {r["page_id"]: r["text"] for r in extraction.extract(table(spark, rows, "page_id long, url string, html string")).collect()}
    for i, wrap in enumerate(wraps):
        assert found[i] == want, wrap
    assert found[100] == "One two three\n\na # b c" and found[101] == found[102] == "Short"


def test_extraction_reads_on_behind_embedded_elements():
    cases = {
        "<p>One <svg class=icon/> two</p><p>three</p>": "One two\n\nthree",
        "<p>One <svg class='icon' /> two</p><p>x <svg><path d='M0'/></svg>three</p>": "One two\n\nx three",
        "<p>One <math display='block'/> two</p><p>three</p>": "One two\n\nthree",
        "<p>One <svg><g><title/><text>two</text></g></svg> three</p>": "One two three",
        "<p>One <svg><path><p>two</p>": "One\n\ntwo",
        "<p>One <svg style='display:none'><text>so</text></svg> two</p>": "One so two",
        "<p>One <svg role=banner><text>no</text></svg>two</p>": "One two",
        "<p>One</p><div hidden>two</div><p style='display:none'>three": "One\n\ntwo\n\nthree",
        "<h2 class='section-header'>One</h2><h3 id='block-menu'>two</h3><p>three": "One\n\ntwo\n\nthree",
        "<p>One <button>no</button>two": "One two",
        "<p title='a>b' x=\"c>d\">One</p>": "One",
        "<p title='a>One</p>": "One",
        "<p>One <!-- no > no": "One",
        "<p>One <b two": "One <b two",
        "<p>One <math><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow></math> two</p>": "One x=1 two",
        "<p>One</p><object data=x><p>two</p></object><p>three</p>": "One\n\ntwo\n\nthree",
        "<p>One</p><object data=x><p>two</p>": "One\n\ntwo",
        "<p>One <select><option>no<option>nor</select> two</p>": "One two",
        "<p>One</p><select name=x><option>no<p>two</p>": "One\n\ntwo",
        "<p>One</p><select><optgroup label=x><option value=1>no</option></optgroup></select>two": "One\n\ntwo",
        "<p>One</p><noscript><p>two</p></noscript>three": "One\n\ntwo\n\nthree",
        "<p>One</p><noscript>two<p>three</p>": "One\n\ntwo\n\nthree",
        "<p>One</p><textarea>two<p>three</p>": "One\n\ntwo\n\nthree",
        "<p>One</p><script>no<p>no</p>": "One",
        "<p>One</p><template><p>no</p></template><title>no</title><p>two</p>": "One\n\ntwo",
    }
    for page, want in cases.items():
        assert "\n\n".join(t for _, t, _ in extraction.Page(page).blocks) == want, page


@pytest.mark.parametrize(
    "pattern",
    ["<p>a<b", "<div>", "<h1>", "<x>a", "<a b='", "<a b=\"'>", "<a '>' ", "<!--", "<!", "</", "<title>", "<svg><text>", "<option>", "<b>a<p>", "</p>", "<p>a</q>", "<td><table>", "<code role=menu>", "<p &lt;"],
)
def test_extraction_is_linear(pattern):
    """A megabyte of broken html in a few seconds, and no more than twice as long for twice as much."""
    import time

    begin = time.process_time()
    page = extraction.Page(pattern * (1_000_000 // len(pattern)) + "end")
    page.main_text(page.best())
    assert time.process_time() - begin < 12


def test_neighbours_odd_rows(spark):
    rows = [
        (0, [1.0, 0.0]), (20, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [3.0, 1.0]), (4, None), (5, []),
        (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [float("inf"), 1.0]), (None, [1.0, 1.0]), (9, [1.0, 2.0, 3.0]), (40, [-1.0, 0.5]),
    ]
    vectors = table(spark, rows, "vec_id long, embedding array<double>").withColumn("vector", F.lit(1))
    found = [tuple(r) for r in neighbours.report(vectors).orderBy("query_id", "rank").collect()]
    assert found == [
        (0, 1, 3, 3.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0), (0, 4, 40, -1.0),
        (40, 1, 0, -1.0), (40, 2, 1, -1.0), (40, 3, 2, -1.0), (40, 4, 3, -2.5),
    ]
    assert neighbours.report(vectors.limit(0)).isEmpty()


def test_neighbours_in_a_dense_group(spark):
    """A third of all vectors nearly equal: still all of them are ranked exactly."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 32))
    x[::3] = x[0] + 0.01 * rng.normal(size=(500, 32))
    vectors = table(spark, [(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = neighbours.report(vectors).toPandas()
    hits = []
    for i in range(0, 1500, 20):
        score = x @ x[i]
        score[i] = -np.inf
        hits.append(len(set(np.argsort(-score)[:20]) & set(found[found["query_id"] == i]["vec_id"])) / 20)
    assert np.mean(hits) >= 0.95


def test_neighbours_of_varied_lengths_however_cut(spark):
    """Norms that differ widely, and several partitionings: recall stays, scores are exact."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 48)) * np.exp(0.4 * rng.normal(size=(3000, 1)))
    vectors = table(spark, [(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for parts in (1, 5):
        found = neighbours.report(vectors.repartition(parts)).toPandas()
        hits = []
        for i, rows in found.groupby("query_id"):
            score = x @ x[i]
            score[i] = -np.inf
            hits.append(len(set(np.argsort(-score)[:20]) & set(rows["vec_id"])) / 20)
            assert np.allclose(rows["score"], score[rows["vec_id"]], rtol=0, atol=1e-9)
        assert len(hits) == 150 and np.mean(hits) >= 0.95 and min(hits) >= 0.6


def test_neighbours_come_from_posted_rows():
    """What a query gets from the files is what the orders of pivots say, one by one."""
    rng = np.random.default_rng(5)
    near = rng.normal(size=(300, 40))
    orders = neighbours._order(near, 12)
    files = neighbours._files(orders, 40)
    for q in (0, 7):
        want = []
        for v in range(300):
            place = {p: k for k, p in enumerate(orders[v].tolist())}
            want.append(sum(12 - abs(place[p] - k) for k, p in enumerate(orders[q].tolist()) if p in place))
        got = neighbours._gains(orders[q].astype(np.int64), *files, 300)
        assert got.tolist() == want and want[q] == max(want) == 144


def test_secrets_odd_rows(spark, odd):
    code = "AKIA" + "B7" * 10
    rows = [
        (1, None), (2, ""), (3, f"é😀 Password: 'abcdef123456' {code} deadbeefdeadbeef00"), (4, "password=secret: abcdefghijklmnop"),
        (5, "token = short"), (6, "x" * 200_000 + " API_KEY=" + "k" * 40), (None, code), (3, code),
        (7, "-----BEGIN RSA PRIVATE KEY-----"), (8, "AKIAAKIA" + "C" * 14 + " 0123456789abcde"),
    ]
    docs = table(spark, rows).withColumn("key", F.lit(1)).withColumn("rules", F.lit(2))
    found = [(r["doc_id"], r["spans"]) for r in secrets.report(docs).collect()]
    by = dict(found)
    assert by[1] == by[2] == by[4] == by[5] == ""
    assert (3, "assign:3:26,access:28:52,hex:53:71") in found and (3, "access:0:24") in found
    assert by[6] == "assign:200001:200049" and by[None] == "access:0:24"
    assert by[7] == "pem:0:31" and by[8] == "access:0:22"
    assert secrets.report(odd).count() == odd.count() and secrets.report(docs.limit(0)).isEmpty()


def test_secret_scan_is_native(spark):
    plan = secrets.report(table(spark, [(1, "a")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_trigram_queries():
    pairs = [("abcd", "xxABCDx", True), ("(foo|bar)[0-9]+baz", "a foo1baz", True), ("(foo|bar)[0-9]+baz", "foo", False), ("ab?cde", "zacdez", True)]
    for pattern, sample, holds in pairs:
        grams = {sample.lower()[i : i + 3] for i in range(len(sample) - 2)}
        assert all(any(a <= grams for a in g) for g in secrets.trigram_query(pattern)) is holds
    assert secrets.trigram_query("[0-9a-f]+") == set()
