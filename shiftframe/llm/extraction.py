"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of a page.

A block is described by the elements around it and their names, by its place and by its text. The field scores each
block for being main text and each step from block to block, within one element and across elements; Viterbi's method
finds the best labelling of the whole page. It is trained on labelled pages: texts of a bounded sample of the table's own
pages, whose markup tells article from rest, set anew in many layouts (``layouts``), so that it learns from what elements
are called and where they stand instead of from one site's template.
"""

from __future__ import annotations

import random
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftframe.llm.dom import Block, Markup, blocks_of
from shiftframe.llm.layouts import page_of

SAMPLE_PAGES = 200  # pages of the table whose texts are used for training at most
SAMPLE_BYTES = 65_536  # longer pages are not sampled
HASHES = 1 << 40
LAYOUT_PAGES = 600  # labelled pages that the field is trained on
LEAST_SEEN = 3  # blocks that a feature must describe to have a weight
ROUNDS, RATE, DECAY = 160, 0.15, 1e-5
#: Words that say more about a short block than its length does.
CUES = frozenset(
    """advertisement sponsored cookie cookies privacy consent subscribe newsletter login password register comment comments
    reply replies share follow menu search related copyright rights reserved terms contact""".split()
)
SENTENCE_ENDS = tuple(".!?…:;»”\"'")
LENGTHS = (2, 5, 10, 20, 50)


def own_features(block: Block, place: int, last: int, after_heading: bool) -> list[str]:
    """What a block says itself; ``context`` is apart, as many blocks share it."""
    text = block.text
    words = text.split(" ")
    n = bisect_right(LENGTHS, len(words))
    links = 0 if not block.in_links else 1 if 2 * block.in_links < len(text) else 2
    found = [f"leaf={block.leaf}", f"words={n}", f"links={links}", f"words={n} links={links}", f"heading={after_heading}"]
    if text.endswith(SENTENCE_ENDS):
        found.append("sentence")
    if text.count(",") > 1:
        found.append("commas")
    if "©" in text:
        found.append("copyright")
    if place == 0:
        found.append("first")
    if place == last:
        found.append("last")
    if n < 4:
        found += [f"cue={w}" for w in {x.strip(".,:;!?()").lower() for x in words} & CUES]
    return found


def page_features(blocks: list[Block]) -> list[list[str]]:
    heading, found = False, []
    for i, block in enumerate(blocks):
        found.append(own_features(block, i, len(blocks) - 1, heading))
        heading = heading or block.leaf == "h1"
    return found


@dataclass
class Field:
    """Weights of features for main text, and of steps: [same context or not][from][to]. Rest is 0, main text 1."""

    weights: dict[str, float]
    steps: list[list[list[float]]]

    def decode(self, blocks: list[Block], contexts: dict[frozenset, float]) -> list[int]:
        """The best labels of a page's blocks. ``contexts`` remembers the weights of contexts."""
        get = self.weights.get
        bias = get("bias", 0.0)
        rest = main = 0.0
        back: list[tuple[int, int]] = []
        before = None
        for block, own in zip(blocks, page_features(blocks)):
            score = contexts.get(block.context)
            if score is None:
                score = contexts[block.context] = bias + sum(get(f, 0.0) for f in block.context)
            score += sum([get(f, 0.0) for f in own])
            if before is None:
                rest, main = 0.0, score
            else:
                step = self.steps[before == block.context]
                stay, enter, leave, on = rest + step[0][0], rest + step[0][1], main + step[1][0], main + step[1][1]
                back.append((int(leave > stay), int(on >= enter)))
                rest, main = max(stay, leave), max(enter, on) + score
            before = block.context
        if before is None:
            return []
        labels = [int(main > rest)]
        for chosen in reversed(back):
            labels.append(chosen[labels[-1]])
        return labels[::-1]


def train_field(pages: list[list[Block]], rounds: int = ROUNDS) -> Field:
    """Weights that make the labels of labelled pages likeliest, by gradient steps on all pages together."""
    pages = [p for p in pages if p]
    described = [[["bias", *b.context, *own] for b, own in zip(p, page_features(p))] for p in pages]
    seen = Counter(f for p in described for fs in p for f in fs)
    names = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= LEAST_SEEN))}
    count, longest = len(pages), max((len(p) for p in pages), default=0)
    feature = np.array([names[f] for p in described for fs in p for f in fs if f in names], dtype=np.int64)
    sizes = np.array([sum(f in names for f in fs) for p in described for fs in p], dtype=np.int64)
    page = np.repeat(np.arange(count), [len(p) for p in pages])
    place = np.concatenate([np.arange(len(p)) for p in pages]) if pages else page
    of = np.repeat(np.arange(len(page)), sizes)
    label = np.array([int(b.truth == "1") for p in pages for b in p], dtype=np.int64)
    same = np.zeros((count, longest), dtype=np.int64)
    same[page, place] = [int(i > 0 and p[i - 1].context == b.context) for p in pages for i, b in enumerate(p)]
    length = np.array([len(p) for p in pages], dtype=np.int64)
    truth = np.zeros((count, longest), dtype=np.int64)
    truth[page, place] = label
    gold = np.zeros((2, 2, 2))
    for at in range(1, longest):
        here = length > at
        np.add.at(gold, (same[here, at], truth[here, at - 1], truth[here, at]), 1)
    gold_features = np.bincount(feature, weights=label[of], minlength=len(names))
    w = np.zeros(len(names) + 8)
    moment, square = np.zeros_like(w), np.zeros_like(w)
    for turn in range(1, rounds + 1 if pages else 1):
        steps = w[len(names) :].reshape(2, 2, 2)
        node = np.zeros((count, longest, 2))
        node[page, place, 1] = np.bincount(of, weights=w[feature], minlength=len(page))
        forward, backward = np.zeros_like(node), np.zeros_like(node)
        forward[:, 0] = node[:, 0]
        for at in range(1, longest):
            forward[:, at] = node[:, at] + np.logaddexp.reduce(forward[:, at - 1, :, None] + steps[same[:, at]], axis=1)
        for at in range(longest - 2, -1, -1):
            ahead = np.logaddexp.reduce(steps[same[:, at + 1]] + (node[:, at + 1] + backward[:, at + 1])[:, None, :], axis=2)
            backward[:, at] = np.where((length > at + 1)[:, None], ahead, 0.0)
        total = np.logaddexp.reduce(forward[np.arange(count), length - 1], axis=1)
        likely = np.exp(forward + backward - total[:, None, None])[page, place, 1]
        gradient = np.empty_like(w)
        gradient[: len(names)] = gold_features - np.bincount(feature, weights=likely[of], minlength=len(names))
        expected = np.zeros((2, 2, 2))
        for at in range(1, longest):
            here = length > at
            both = np.exp(
                forward[here, at - 1, :, None] + steps[same[here, at]] + (node[here, at] + backward[here, at])[:, None, :] - total[here, None, None]
            )
            for kind in (0, 1):
                expected[kind] += both[same[here, at] == kind].sum(axis=0)
        gradient[len(names) :] = (gold - expected).ravel()
        gradient = gradient / max(len(page), 1) - DECAY * w
        moment, square = 0.9 * moment + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        w += RATE * (moment / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.99**turn)) + 1e-8)
    return Field({f: float(w[i]) for f, i in names.items()}, w[len(names) :].reshape(2, 2, 2).tolist())


def sampled_texts(pages: DataFrame, html: str) -> tuple[list[str], list[str]]:
    """(texts of articles, other texts) of at most ``SAMPLE_PAGES`` pages that name their article, chosen by hash.

    Only some pages with small hashes, four times the wanted number on average, and of equal ones one, are sent on.
    """
    share = min(1.0, 4 * SAMPLE_PAGES / max(pages.count(), 1))
    near = F.pmod(F.xxhash64(html), F.lit(HASHES)) < F.lit(int(share * HASHES))
    named = pages.where(near & F.octet_length(html).between(1, SAMPLE_BYTES) & F.col(html).contains("<article"))
    different = named.select(F.col(html).alias("html")).distinct()
    chosen = different.orderBy(F.pmod(F.xxhash64("html"), F.lit(HASHES)), "html").limit(SAMPLE_PAGES).collect()
    markup, inside, outside = Markup(), [], []
    for row in chosen:
        for block in blocks_of(row["html"], markup):
            (inside if "tag=article" in block.context and block.leaf == "p" else outside).append(block.text)
    return inside, outside


def labelled_pages(inside: list[str], outside: list[str], n: int, seed: int = 13) -> list[list[Block]]:
    """Blocks with labels of ``n`` pages in drawn layouts, with texts of both kinds and made-up ones."""
    draw, markup = random.Random(seed), Markup()
    return [blocks_of(page_of(draw, inside, outside), markup) for _ in range(n)]


def train(pages: DataFrame, html: str = "html", n: int = LAYOUT_PAGES) -> Field:
    """A field trained on ``n`` labelled pages with texts from ``pages``. An empty table gives one of made-up texts."""
    return train_field(labelled_pages(*sampled_texts(pages, html), n))


def extract_main(pages: DataFrame, model: Field, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars, n_blocks, n_main`` for every row.

    The main blocks' texts in page order, joined by one space, over the whole page. A null or empty page has an empty
    text, as has one without main text. Repeated rows are read each, ids and urls are passed on as they are, other
    columns are not read.
    """
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (key, url)}

    def read(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        markup, contexts = Markup(), {}
        for batch in found:
            out = []
            for page in batch.column(2):
                blocks = blocks_of(page.as_py() or "", markup)
                main = [b.text for b, label in zip(blocks, model.decode(blocks, contexts)) if label]
                text = " ".join(main)
                out.append((text, len(text), len(blocks), len(main)))
                if len(contexts) > 20_000:
                    contexts.clear()
            columns = list(zip(*out)) or [()] * 4
            arrays = [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["page_id", "url", "text", "n_chars", "n_blocks", "n_main"])

    narrow = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return narrow.mapInArrow(read, f"page_id {kinds[key]}, url {kinds[url]}, text string, n_chars long, n_blocks int, n_main int")
