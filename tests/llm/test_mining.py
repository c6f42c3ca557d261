"""Collocations, hard negatives and main text of pages against brute force and known answers, and on awkward rows."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftframe.llm import collocations, extraction, negatives
from shiftframe.llm.dom import Markup, blocks_of
from tests_llm_cases import awkward, empty, rows

# --- collocations -------------------------------------------------------------------------------------------------


def slow_pieces(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for end in ".,;:!?\n\x0b\x0c\r":
        lowered = lowered.replace(end, "\n")
    return [[w for w in p.replace("\t", " ").split(" ") if w] for p in lowered.split("\n")]


def slow_collocations(docs, least, top):
    f = {}
    for text, lang in docs:
        own = f.setdefault(lang or "und", Counter())
        for piece in slow_pieces(text):
            own.update(tuple(piece[i : i + k]) for k in (1, 2, 3) for i in range(len(piece) - k + 1))
    found = []
    for lang, own in f.items():
        n = sum(v for g, v in own.items() if len(g) == 1)
        candidates = {g: v for g, v in own.items() if len(g) > 1 and v >= least}
        kept = []
        for g, a in candidates.items():
            if any(len(h) > len(g) and 100 * b >= 50 * a and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)) for h, b in candidates.items()):
                continue
            cuts = [(1_000_000 * a * a // (own[g[:k]] * own[g[k:]]), k, own[g[:k]], own[g[k:]]) for k in range(1, len(g))]
            score, _, left, right = min(cuts)
            kept.append((-score, -a, " ".join(g).encode(), left, right, n))
        for rank, (score, a, phrase, left, right, n) in enumerate(sorted(kept)[:top]):
            found.append((lang, rank + 1, phrase.decode(), -a, left, right, n, -score))
    return sorted(found, key=lambda r: tuple(map(str, r)))


def speech(seed, n):
    draw = random.Random(seed)
    words = ["the", "The", "of", "a", "new", "york", "city", "x y", "É", "b", "c", "d"] + [f"w{i}" for i in range(20)]
    texts = []
    for _ in range(n):
        own = [draw.choice(words) for _ in range(draw.randint(0, 60))]
        if draw.random() < 0.7:
            own[len(own) // 2 : len(own) // 2] = ["New", "York", "City"]
        texts.append("".join(w + draw.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n"]) for w in own))
    return [(t, draw.choice(["en", "en", "de", None])) for t in [*texts, *texts[: n // 3], "a " * 500]]


@pytest.mark.parametrize("trigger", [1, 3, 10_000])
def test_every_phrase_counts_in_one_chunk(trigger):
    draw = random.Random(trigger)
    for n in [*range(1, 12), 200]:
        words = [f"w{draw.randint(0, 9)}".encode() for _ in range(n)]
        got = Counter()
        for chunk in collocations.chunks_of(words, trigger):
            own, last = chunk.removesuffix(b"\n").split(b" "), chunk.endswith(b"\n")
            begins = collocations.owned(np.array([-len(own) if last else len(own)]))
            got.update(tuple(own[i : i + k]) for k in (1, 2, 3) for i in range(len(own) - k + 1) if begins[i])
        assert got == Counter(tuple(words[i : i + k]) for k in (1, 2, 3) for i in range(n - k + 1))


@pytest.mark.parametrize("block_words", [60, 2_000_000])
def test_collocations_match_brute_force(spark, monkeypatch, block_words):
    monkeypatch.setattr(collocations, "BLOCK_WORDS", block_words)
    docs = speech(block_words, 60)
    df = spark.createDataFrame(docs, "text string, lang string").repartition(3)
    got = collocations.mine_collocations(df, least=4, top=15, trigger=3)
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: tuple(map(str, r))) == slow_collocations(docs, 4, 15)


def test_collocations_repeat_and_order(spark):
    docs = [("b a, d c, e f", "xx")] * 5
    got = collocations.mine_collocations(spark.createDataFrame(docs, "text string, lang string"), least=5)
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [
        ("xx", i + 1, p, 5, 5, 5, 30, 1_000_000) for i, p in enumerate(["b a", "d c", "e f"])
    ]


def test_association_is_exact_beyond_64_bits(spark):
    a, left, right = 3_000_000_019, 3_000_000_021, 4_000_000_007
    row = spark.range(1).select(collocations.association(F.lit(a), F.lit(left), F.lit(right)).alias("s")).first()
    assert row["s"] == 1_000_000 * a * a // (left * right)


def test_collocations_awkward_rows(spark):
    got = collocations.mine_collocations(awkward(spark), least=2)
    assert {("en", "tie tie"), ("en", "word word word")} <= {(r["lang"], r["phrase"]) for r in got.collect()}
    none = collocations.mine_collocations(empty(spark))
    assert none.count() == 0 and none.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


# --- hard negatives -----------------------------------------------------------------------------------------------


def slow_negatives(vectors, every=100):
    parts = {}
    for vec_id, v, label in vectors:
        if vec_id is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        own = (label, [math.floor(256 * float(np.float32(x))) for x in v])
        parts[vec_id] = min(parts.get(vec_id, own), own)
    found = []
    for anchor, (label, v) in parts.items():
        if anchor % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i, m) for i, (m, w) in parts.items() if i != anchor and len(w) == len(v))
        for p, positive, _ in [s for s in scored if s[2] == label][:5]:
            inside = [(n, i) for n, i, m in scored if m != label and 80 * -p <= 100 * -n <= 100 * -p][:5]
            found += [(anchor, positive, k + 1, i, -p, -n) for k, (n, i) in enumerate(inside)]
    return sorted(found)


def cloud(seed, n, width, spread):
    random.seed(seed)
    centres = [[random.gauss(0, 1) for _ in range(width)] for _ in range(5)]
    found = []
    for i in range(n):
        label = random.randrange(4)
        found.append((i, [c + random.gauss(0, spread) for c in centres[label]], label))
    for i in range(0, n, 9):
        found[i] = (i, found[(i * 5) % n][1], random.randrange(4))  # ties of equal vectors
    return found


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("width,spread,blocks,columns", [(24, 0.8, 5, 4), (3, 0.2, 1, 8), (40, 3.0, 7, 3)])
def test_hard_negatives_match_brute_force(spark, monkeypatch, width, spread, blocks, columns):
    monkeypatch.setattr(negatives, "COLUMNS_AT_ONCE", columns)
    monkeypatch.setattr(negatives, "GROUP_ANCHORS", 8)
    vectors = cloud(width, 300, width, spread)
    got = negatives.hard_negatives(spark.createDataFrame(vectors, VECTORS), every=20, least_blocks=blocks)
    want = slow_negatives(vectors, 20)
    assert want and sorted(tuple(r) for r in got.collect()) == want


def test_scan_leaves_out_most_columns():
    columns = np.random.default_rng(3).integers(-200, 200, (64, 2000))
    columns[:, 7] = columns[:, 11] = 3 * np.arange(64)[::-1]
    scan = negatives.Scan(3 * np.arange(64)[::-1], columns, columns.min(axis=1), columns.max(axis=1), np.arange(2000))
    ids, scores = negatives.scan_positives(scan, np.arange(2000), 2)
    assert scores.tolist() == sorted((scan.anchor @ columns).tolist())[:-3:-1] and len(scan.candidates) < 200


def test_hard_negatives_awkward_rows(spark):
    good = cloud(1, 60, 4, 0.5)
    vectors = [
        *good, good[3], (None, good[0][1], 1), (100, None, 1), (101, [1.0, None, 0.0, 0.0], 1), (102, [float("nan")] * 4, 2),
        (103, [float("inf"), 0.0, 0.0, 0.0], 2), (104, good[1][1], None), (105, [0.0] * 4, 3), (200, good[2][1][:3], 1), (201, good[3][1][:3], 1),
        (202, good[4][1][:3], 2), (300, [], 1), (301, [], 2), (302, [3e38] * 4, 1), (7, [9.0] * 4, 0),
    ]
    want = slow_negatives([v for v in vectors if v[0] != 302], 20)
    df = spark.createDataFrame(vectors, VECTORS).withColumn("score", F.lit("x")).withColumn("block", F.lit(1)).withColumn("v", F.lit(2))
    assert sorted(tuple(r) for r in negatives.hard_negatives(df, every=20).collect()) == want
    none = negatives.hard_negatives(spark.createDataFrame([], VECTORS))
    assert none.count() == 0 and none.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


# --- main text of pages -------------------------------------------------------------------------------------------


def texts(page):
    return [b.text for b in blocks_of(page, Markup())]


@pytest.mark.parametrize("page,want", [
    ("<p>a<b>b</b>c</p>d", ["abc", "d"]),
    ("<p>a<br>b\n\t c&nbsp;d<p>e", ["a b c d", "e"]),
    ("<script>var t='</p>';if (a<b) {}</script><style>p{}</style><p>x</p>", ["x"]),
    ("<title>t &lt;</title><!-- no <p>no</p> --><p>&lt;p&gt; &amp;amp; &am &amp</p>", ["<p> &amp; &am &"]),
    ("<p title=\"a>b\" class='x'>y</p><p title=a>z", ["y", "z"]),
    ("a < b <3 <p>c</p", ["a < b <3", "c"]),
    ("<p>open <b>bold<p>next</b></p></div>tail<a href=\"/x", ["open bold", "next", "tail"]),
    ("<ul><li>a<ul><li>b</ul><li>c</ul>", ["a", "b", "c"]),
    ("<table><tr><td>a<td><p>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
    ("<!--> <p>x</p><!-- never ends <p>y", ["x"]),
    ("<script>never ends <p>y</p>", []),
    ("<?php x ?><![CDATA[y]]></ z>&#65;&#x1F600;&#0;", ["A\U0001f600�"]),
    ("", []), ("\x00퟿", ["\x00퟿"]),
])
def test_blocks_of_a_page(page, want):
    assert texts(page) == want


def test_blocks_of_deep_and_long_pages():
    deep = "<div>" * 20_000 + "x" + "</b></section>" * 20_000 + "<p>y"
    assert texts(deep) == ["x", "y"]
    assert texts("<p>" + "word " * 200_000) == ["word " * 199_999 + "word"]
    assert texts("<a x='" * 50_000) == []


@pytest.fixture(scope="module")
def field(spark):
    return extraction.train(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))


def test_field_on_labelled_pages_it_has_not_seen(field):
    pages = extraction.labelled_pages([], [], 150, seed=77)
    got = [(label, b.truth == "1") for p in pages for b, label in zip(p, field.decode(p, {}))]
    assert sum(bool(a) == b for a, b in got) / len(got) > 0.98


def test_viterbi_finds_the_best_labelling(field):
    for blocks in extraction.labelled_pages([], [], 20, seed=5):
        blocks = blocks[:10]

        def value(labels):
            total = 0.0
            for i, (b, own) in enumerate(zip(blocks, extraction.page_features(blocks))):
                total += labels[i] * sum(field.weights.get(f, 0.0) for f in ["bias", *b.context, *own])
                if i:
                    total += field.steps[b.context == blocks[i - 1].context][labels[i - 1]][labels[i]]
            return total

        best = max(value([n >> i & 1 for i in range(len(blocks))]) for n in range(1 << len(blocks)))
        assert value(field.decode(blocks, {})) == pytest.approx(best)


def test_extraction_finds_articles(spark, field):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in extraction.extract_main(pages, field).collect()}
    for row in pages.collect():
        inside = row["html"].split("<article>", 1)[-1].split("</article>")[0]
        want = " ".join(b.text for b in blocks_of("<article>" + inside, Markup()))
        assert got[row["page_id"]] == (want, len(want))


def test_extraction_leaves_out_what_is_around(spark, field):
    page = """<html><body><header class="site-header"><a href="/">My site</a></header><nav><a href="/a">Home</a></nav>
      <div class="cookie-banner"><p>We use cookies to improve this site.</p><button>Accept all</button></div>
      <div class="content"><h1>A title</h1><p>The first paragraph, which is long enough &amp; tells a story about something.</p>
      <div class="ad"><p>Buy now, a special offer for everyone.</p></div>
      <p>The second paragraph tells more of it,<br>over two lines.</p></div>
      <aside class="sidebar"><h3>Related articles</h3><ul><li><a href="/x">Other things</a></li></ul></aside>
      <form><label>Email address</label><input name=q><button>Send</button></form>
      <section class="comments"><h2>Comments</h2><div class="comment"><p>I do not agree with this at all, it is wrong.</p></div></section>
      <footer>&copy; 2024 All rights reserved.</footer></body></html>"""
    got = extraction.extract_main(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string"), field).first()
    assert got["text"] == (
        "A title The first paragraph, which is long enough & tells a story about something. "
        "The second paragraph tells more of it, over two lines."
    )


def test_extraction_awkward_rows(spark, field):
    cases = [
        (1, None, None, "t"), (None, "u", "", "t"), (2, "u", " \n ", "t"), (3, "u", "<p>" * 3, None), (4, None, "<article><p>Same text here.</p></article>", "t"),
        (4, None, "<article><p>Same text here.</p></article>", "t"), (5, "u", "<article><p>" + "Word, " * 100_000 + "end.</p></article>", "t"),
    ]
    df = spark.createDataFrame(cases, "page_id long, url string, html string, text string")
    got = rows(extraction.extract_main(df, field).select("page_id", "url", "n_chars"))
    assert got == sorted([(1, None, 0), (None, "u", 0), (2, "u", 0), (3, "u", 0), (4, None, 15), (4, None, 15), (5, "u", 600_004)], key=lambda r: tuple((x is None, str(x)) for x in r))
    none = df.where("false")
    assert extraction.extract_main(none, extraction.train(none, n=40)).count() == 0
