"""The pipeline's stages, each against brute force on what the stage before kept."""

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from test_models import near
from test_native import judged, shares

from shiftframe.functions.workspace import materialize

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, names = docs.columns, [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "mixing", "sharding"]
    made = [docs]
    for name, stage in corpus_pipeline.STAGES:
        made.append(materialize(stage(spark, made[-1], FOLDER), f"test-{name}"))
    assert all(df.columns == columns for df in made[1:5])
    clean, single, pure, mixed, sharded = (df.collect() for df in made[1:])
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r.doc_id for r in clean}
    assert sum(i in kept for i, t in labels.items() if not t) >= 0.98 * sum(not t for t in labels.values())
    want = {d for d, _, c in near([(r.doc_id, r.text) for r in clean]) if d == c}
    assert {r.doc_id for r in single} == want
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    assert {r.doc_id for r in pure} == {r.doc_id for r in single if not judged(r.text, items)[-1]}
    sizes = Counter()
    for r in pure:
        sizes[r.source] += len(r.text.split())
    taken, target = Counter(), shares(dict(sizes))
    for r in mixed:
        taken[r.source] += len(r.text.split())
    longest = max(len(r.text.split()) for r in pure)
    assert all(abs(taken[s] - target[s]) <= longest for s in sizes)
    assert max(Counter(r.doc_id for r in mixed).values()) <= 3
    assert Counter(r.doc_id for r in sharded) == Counter(r.doc_id for r in mixed)
    for shard in {r.shard for r in sharded}:
        own = sorted(r.slot for r in sharded if r.shard == shard)
        assert own == list(range(len(own)))


def test_stages_on_nothing(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, FOLDER), f"none-{name}")
        assert docs.count() == 0


def test_stages_keep_rows_without_id(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(40)
    bare = docs.withColumn("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("doc_id")))
    for name, stage in corpus_pipeline.STAGES:
        bare = materialize(stage(spark, bare, FOLDER), f"bare-{name}")
    assert bare.where("doc_id is null").count() > 0


ROWS = "doc_id long, text string, lang string, source string, n_chars long, _row int, _times int, row string"


def staged(spark, name, rows):
    docs = spark.createDataFrame([(*r, "en", r[2], 0, 1, 2, "x")[:2] + ("en", r[2], 0, 1, 2, "x") for r in rows], ROWS)
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs.repartition(3), FOLDER)
    assert out.columns == docs.columns
    return Counter((r.doc_id, r.text, r.source) for r in out.collect())


def test_copies_without_id_and_ids_with_two_texts(spark):
    long = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(None, long, "a"), (None, long, "b"), (5, long, "c"), (5, "other words that nobody else has at all here", "a"), (7, long, "a"),
            (None, "alone and without any id in this whole table", "a"), (None, None, "a"), (9, "", None), (9, " ", None)]
    got = staged(spark, "simhash_near_dedup", rows)
    assert got == Counter([rows[2], rows[3], rows[5], rows[7]]) or got == Counter([rows[2], rows[3], rows[5], rows[8]])


def test_contaminated_rows_without_id_and_ids_with_two_texts(spark):
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").where("length(text) > 100").first().text
    rows = [(None, item, "a"), (None, "quite clean", "a"), (3, item, "a"), (3, "quite clean", "b"), (4, None, "a")]
    assert staged(spark, "benchmark_decontamination", rows) == Counter([rows[1], rows[3], rows[4]])


def test_mix_takes_rows_without_id_each_by_its_own_count(spark):
    rows = [(None, "a b c d " * 4, "a"), (None, "e f g h " * 4, "a"), (1, "i j k l " * 4, "a"), (1, "m n o p " * 40, "b"), (2, None, "b")]
    got = staged(spark, "mixing", rows)
    sizes = {"a": 48, "b": 160}
    taken, target = Counter(), shares(dict(sizes))
    for (_, text, source), n in got.items():
        taken[source] += n * len(text.split())
    assert all(abs(taken[s] - target[s]) <= {"a": 16, "b": 160}[s] for s in sizes) and all(n <= 3 for n in got.values())
