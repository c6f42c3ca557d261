"""Decontamination, line dedup, sharding, mixing and the archive against brute force, and on awkward rows."""

import functools
import base64
import hashlib
import math
import re
import string
import zlib

import pytest
from pyspark.sql import functions as F

from shiftframe.functions.workspace import new_path
from shiftframe.llm import archive, boilerplate, decontaminate, mixing, sharding
from tests_llm_cases import awkward, empty, prose, rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def judged(text, items):
    doc = WORD.findall((text or "").translate(LOWER))
    hit, named = set(), set()
    for item_id, item in items:
        words = WORD.findall((item or "").translate(LOWER))
        n = min(13, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            for at in range(len(doc) - n + 1):
                if doc[at : at + n] == words[i : i + n]:
                    hit.update(range(at, at + n))
                    named.add(item_id)
    listed = ",".join(sorted(str(i) for i in named if i is not None))
    count = sum(i is not None for i in named)
    return len(doc), len(hit), count, hashlib.sha256(listed.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(doc)


def test_decontaminate_against_brute_force(spark):
    texts = prose(3, 40, vocabulary=12)  # few words, so windows share anchors and match often
    items = [(i, " ".join(t.split()[i : i + 10 + 3 * i])) for i, t in enumerate(texts[:9])]
    items += [(20, "a b"), (21, ""), (22, None), (None, texts[3]), (23, items[2][1]), (23, items[2][1]), (24, texts[5].upper())]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = rows(decontaminate.decontaminate(docs, tests))
    assert got == sorted(((i, *judged(t, items)) for i, t in enumerate(texts)), key=lambda r: str(r[0])) or got == rows(
        spark.createDataFrame([(i, *judged(t, items)) for i, t in enumerate(texts)], "a long, b long, c long, d long, e string, f boolean")
    )


def test_decontaminate_awkward(spark):
    items = [(1, "quick brown fox jumps over the lazy dog and runs far away today ok"), (2, "word word word"), (3, "tie"), (4, None)]
    tests = spark.createDataFrame(items, "item_id long, text string")
    docs = awkward(spark)
    want = [(r.doc_id, *judged(r.text, [i for i in items if r.doc_id != 5])) for r in docs.collect() if r.doc_id != 5]
    got = rows(decontaminate.decontaminate(docs, tests))
    assert [r for r in got if r[0] != 5] == rows(spark.createDataFrame(want, "a long, b long, c long, d long, e string, f boolean"))
    assert [r[1:4] for r in got if r[0] == 5] == [(60_000, 60_000, 1)]
    assert decontaminate.decontaminate(empty(spark), tests).count() == 0
    assert decontaminate.decontaminate(docs, tests.limit(0)).where("contaminated or n_hit > 0").count() == 0


def test_long_items(spark):
    """An item of very many words costs in proportion to them."""
    words = [f"w{i}" for i in range(30_000)]
    tests = spark.createDataFrame([(1, " ".join(words)), (2, "w5 w6")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + " ".join(words[100:120]) + " y"), (2, " ".join(words)), (3, "w5 w7")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.decontaminate(docs, tests).collect()}
    assert got == {1: (22, 20, 1), 2: (30_000, 30_000, 2), 3: (2, 0, 0)}


def test_phrases_and_proximity(spark):
    docs = spark.createDataFrame([(1, "one x two y three"), (2, "one two three"), (3, "three a b c d e one two")], "doc_id long, text string")
    phrases, _ = decontaminate.phrases_of(spark.createDataFrame([(1, "one two three")], "item_id long, text string"))
    terms = decontaminate.vocabulary(phrases)
    index = decontaminate.build_index(docs, terms)
    ids = decontaminate.lengths(index)
    exact = decontaminate.phrase_matches(index, phrases, terms).join(ids, "row")
    assert [(r.doc_id, r["first"], r["last"]) for r in exact.collect()] == [(2, 1, 3)]
    near = decontaminate.proximity_matches(index, phrases, terms, slop=4).join(ids, "row")
    assert sorted(r.doc_id for r in near.select("doc_id").distinct().collect()) == [1, 2]


def test_line_dedup(spark):
    def page(i):
        return f"<html><head><style>p{{}}</style><title>T{i}</title></head><body><nav>Home</nav><p>Body <b>{i}</b></p><!-- x --><footer>Foot</footer></body></html>"

    data = [(i, "HTTP://Site.org:80/a", page(i)) for i in range(10)] + [(20, "http://b.org/", page(1)), (21, None, None), (22, "nonsense", "")]
    pages = spark.createDataFrame(data + data[:1], "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("lines", F.lit(1))
    got = {r.page_id: r for r in boilerplate.drop_boilerplate(pages, most_share=0.5).collect()}
    assert got[3].host == "site.org" and got[3].n_lines == 4 and got[3].n_dropped == 2 and got[3].text == "T3\nBody 3"
    assert got[20].text == "T1\nHome\nBody 1\nFoot"
    assert (got[21].host, got[21].n_lines, got[21].text) == ("", 0, "")
    assert boilerplate.drop_boilerplate(pages.limit(0)).count() == 0


def check_shards(out, docs):
    assert len(out) == docs.count()
    for shard in {r.shard for r in out}:
        own = sorted(r.slot for r in out if r.shard == shard)
        assert own == list(range(len(own)))


def test_sharding(spark):
    docs = spark.createDataFrame(list(enumerate(prose(5, 3000))), "doc_id long, text string")
    out = sharding.shard_documents(docs, n_shards=8).collect()
    check_shards(out, docs)
    filled = [sum(r.size for r in out if r.shard == s) for s in range(8)]
    assert max(filled) <= 1.01 * min(filled)
    text = dict(docs.collect())
    assert all(r.size == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in out)
    assert rows(sharding.shard_documents(docs.repartition(7), n_shards=8)) == sorted(map(tuple, out), key=lambda r: tuple((x is None, str(x)) for x in r))
    check_shards(sharding.shard_documents(awkward(spark)).collect(), awkward(spark))
    assert sharding.shard_documents(empty(spark)).count() == 0


def test_shard_map_versions(spark):
    docs = spark.createDataFrame(list(enumerate(prose(6, 2000))), "doc_id long, text string")
    records = sharding.slotted(docs)
    loads = sharding.slot_loads(records).collect()
    size = {r.virtual_slot: r.bytes for r in loads}
    first = sharding.first_map(loads, 8)
    path = new_path(spark, "map")
    sharding.save_map(spark, first, path)
    grown = sharding.rebalanced_map(first, loads, 9)
    sharding.save_map(spark, grown, path)
    assert sharding.load_map(spark, path).agg(F.max("version")).first()[0] == 2
    assert sharding.load_map(spark, path, 1).count() == sharding.N_SLOTS == len(grown)
    before, after = {s: x for _, s, x in first}, {s: x for _, s, x in grown}
    moved = sum(size.get(s, 0) for s in before if before[s] != after[s])
    assert moved <= 1.2 * sum(size.values()) / 9
    filled = [sum(size.get(s, 0) for s in after if after[s] == x) for x in range(9)]
    assert max(filled) <= 1.1 * min(filled)
    shrunk = {s: x for _, s, x in sharding.rebalanced_map(grown, loads, 4)}
    assert set(shrunk.values()) == set(range(4))
    out = new_path(spark, "shards")
    sharding.write_shards(docs, sharding.load_map(spark, path), out)
    assert spark.read.parquet(out).count() == docs.count()


def shares(sizes, weights=(5, 2, 1)):
    """Target per source by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        extra = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += extra[s]
            if target[s] > 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                open_.discard(s)
    return target


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mixing(spark, seed):
    texts = prose(seed, 600)
    data = [(i, t, None if i % 50 == 0 else f"s{min(i % 40, 6 + seed)}") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    out = {r.doc_id: r for r in mixing.mix_sources(docs).collect()}
    sizes = {}
    for _, text, source in data:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    target = shares(sizes)
    taken = dict.fromkeys(sizes, 0)
    for i, text, source in data:
        assert out[i].size == len(text.split()) and out[i].source_size == sizes[source] and out[i].taken <= 3 * out[i].size
        assert math.isclose(out[i].target, target[source], rel_tol=1e-9)
        taken[source] += out[i].taken
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in sizes)
    assert rows(mixing.mix_sources(docs.repartition(5))) == rows(mixing.mix_sources(docs))


def test_mixing_awkward(spark):
    out = mixing.mix_sources(awkward(spark))
    assert out.count() == 12 and out.where("taken > 3 * size or taken is null or target > 3 * source_size").count() == 0
    assert mixing.mix_sources(empty(spark)).count() == 0
    assert mixing.mix_sources(awkward(spark).where("text is null")).agg(F.sum("taken")).first()[0] == 0


def test_archive_round_trip(spark):
    html = ["<p>same</p>"] * 5 + ["", None, "<p>é\r\n\r\nx</p>", "z" * 300_000]
    data = [(i, f"http://x.org/{i} a\r\nb", h) for i, h in enumerate(html)] + [(4, "u", "<p>same</p>"), (None, None, "<p>same</p>"), (None, "v", "alone")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    path = new_path(spark, "archive")
    archive.write_archive(pages, path)
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == len({h or "" for _, _, h in data})
    out = archive.parse_records(archive.read_records(spark, path)).collect()
    assert len(out) == len(data)
    for r in out:
        assert r.header_digest == r.payload_digest
    want = []
    for page, _, text in data:
        raw = (text or "").encode()
        same = [p for p, _, t in data if (t or "") == (text or "") and p is not None]
        response = max(same, default=None)
        want.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if page == response else "revisit", None if page == response else response))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out]
    assert sorted(got, key=str) == sorted(want, key=str)
    warc = new_path(spark, "warc")
    archive.export_warc(archive.read_records(spark, path), warc)
    text = "".join(x[1] for x in spark.read.text(warc, wholetext=True).select(F.lit(0), "value").collect())
    assert text.count("WARC/1.1\r\n") == len(data) and text.count("<p>same</p>\r\n\r\n") == 2


def test_archive_limits(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    path = new_path(spark, "archive")
    archive.write_archive(pages, path, least=3)
    out = {r.page_id: r.record_type for r in archive.parse_records(archive.read_records(spark, path)).collect()}
    assert out == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    broken = new_path(spark, "archive")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{broken}/headers")
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"x")).write.parquet(f"{broken}/payloads")
    with pytest.raises(Exception, match="does not have its digest"):
        archive.read_records(spark, broken).collect()
    nothing = new_path(spark, "archive")
    archive.write_archive(pages.limit(0), nothing)
    assert archive.read_records(spark, nothing).count() == 0


@pytest.mark.parametrize("most", [0, 1000])
def test_archive_stores_each_payload_once(spark, monkeypatch, most):
    monkeypatch.setattr(archive, "small_or_shuffled", functools.partial(archive.small_or_shuffled, most=most))
    cases = [(1, "a"), (2, "a"), (2, "a"), (3, "b"), (None, "c"), (None, "c"), (4, None), (5, ""), (6, "d"), (None, "d"), (7, "e"), (8, "e")]
    path = new_path(spark, "archive")
    archive.write_archive(spark.createDataFrame([(i, "u", h) for i, h in cases], "page_id long, url string, html string").repartition(3), path)
    stored = [bytes(r.payload).decode() for r in spark.read.parquet(f"{path}/payloads").collect()]
    assert sorted(stored) == ["", "a", "b", "c", "d", "e"]
    out = archive.parse_records(archive.read_records(spark, path)).collect()
    largest = {}
    for i, h in cases:
        largest[h or ""] = max(largest.get(h or "", i) or 0, i or 0) or None
    want = [(i, len(h or ""), "response" if i == largest[h or ""] else "revisit") for i, h in cases]
    assert sorted((str(r.page_id), r.payload_bytes, r.record_type) for r in out) == sorted((str(i), n, t) for i, n, t in want)


def test_sharding_edits_the_stored_map(spark):
    texts = prose(5, 400)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = new_path(spark, "map")
    place = lambda df: {r.doc_id: (r.shard, r.map_version, r.virtual_slot) for r in df.collect()}
    first = place(sharding.shard_documents(docs, 4, 64, map_path=path))
    again = place(sharding.shard_documents(docs, 4, 64, map_path=path))
    assert first == again and {v for _, v, _ in first.values()} == {1}
    more = docs.unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(prose(6, 40))], docs.schema))
    grown = place(sharding.shard_documents(more, 5, 64, map_path=path))
    assert {v for _, v, _ in grown.values()} == {2}
    moved = [i for i in first if grown[i][0] != first[i][0]]
    assert 0 < len(moved) < len(first) / 2 and 4 in {grown[i][0] for i in moved}
    assert spark.read.parquet(path).select("version").distinct().count() == 2
