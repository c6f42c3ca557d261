"""Benchmark decontamination with a positional inverted index over the training text.

``build_index`` stores one posting (row, position, term) for every training token that some test text uses, next to
one row with the length of each document. A test phrase is found by intersecting postings whose positions are
adjusted by the place of the term in the phrase, beginning with its rarest terms, so that only documents which hold
two of these at the right distance are looked at term by term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftframe.functions.workspace import materialize
from shiftframe.llm.text import ascii_lower, small_or_shuffled

WINDOW = 13
SHARE = 20  # a document is contaminated when 20 * hit words >= its words
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # fixed value: the complement of the word characters, after lower-casing
LENGTH_TERM = -1  # term of the row that holds a document's length


def words(text: Column) -> Column:
    """Words of a text in order; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NO_WORD, -1), "")


def phrases_of(items: DataFrame, item_id: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(phrases: ``phrase, words``; members: ``phrase, item_id``): test texts with equal words are one phrase."""
    worded = items.select(F.col(item_id).cast("string").alias("item_id"), words(F.col(text)).alias("words"))
    worded = worded.where(F.size("words") > 0)
    distinct = worded.select("words").distinct().withColumn("phrase", F.row_number().over(Window.orderBy("words")))
    phrases = materialize(distinct.select("phrase", "words"), "phrases")
    members = phrases.join(worded, "words").where(F.col("item_id").isNotNull()).select("phrase", "item_id").distinct()
    return phrases, members


def vocabulary(phrases: DataFrame) -> DataFrame:
    """``word, term``: a number for every word of the test phrases. The window sees the words of the test set only."""
    found = phrases.select(F.explode("words").alias("word")).distinct()
    return found.select("word", F.row_number().over(Window.orderBy("word")).alias("term"))


def build_index(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings ``row, term, pos`` of the words in ``terms``, and per document a row with its id and length.

    Documents are numbered by row, not by id, so repeated and null ids stay apart. Positions start at 1. The postings
    of a document lie together in the file that its partition writes: no shuffle.
    """
    lookup = small_or_shuffled(
        terms.unionByName(terms.sparkSession.createDataFrame([("", LENGTH_TERM)], "word string, term int")), "terms"
    )
    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), words(F.col(text)).alias("words")
    )
    # the empty word cannot occur in a text; it stands at position 0 for the document itself
    placed = numbered.select(
        "row", "doc_id", F.size("words").alias("n"), F.posexplode(F.concat(F.array(F.lit("")), F.col("words")))
    )
    known = placed.join(lookup, placed["col"] == lookup["word"])
    own = F.col("pos") == 0
    return materialize(
        known.select(
            "row", "term", "pos", F.when(own, F.col("doc_id")).alias("doc_id"), F.when(own, F.col("n")).alias("n_words")
        ),
        "postings",
    )


def lengths(index: DataFrame) -> DataFrame:
    return index.where(F.col("term") == LENGTH_TERM).select("row", "doc_id", F.col("n_words").cast("long").alias("n_words"))


def postings(index: DataFrame) -> DataFrame:
    return index.where(F.col("term") != LENGTH_TERM).select("row", "term", "pos")


def _placed_terms(phrases: DataFrame, terms: DataFrame) -> DataFrame:
    spread = phrases.select("phrase", F.size("words").alias("n"), F.posexplode("words").alias("at", "word"))
    return spread.join(terms, "word").select("phrase", "n", "at", "term")


def _anchors(placed: DataFrame, rows_of: DataFrame, window: int) -> DataFrame:
    """``phrase, at1, term1, at2, term2``: the two rarest places of every window, each pair once.

    A window of one word has no second place. Windows with a word that occurs nowhere need no anchor.
    """
    counted = placed.join(rows_of, "term", "left")
    first, last = F.greatest(F.col("at") - window + 1, F.lit(0)), F.least(F.col("at"), F.greatest(F.col("n") - window, F.lit(0)))
    inside = counted.select("phrase", "at", "term", "n_rows", F.explode(F.sequence(first, last)).alias("start"))
    rare = F.row_number().over(Window.partitionBy("phrase", "start").orderBy(F.col("n_rows"), F.col("at")))
    ranked = inside.withColumn("n_rows", F.coalesce("n_rows", F.lit(0))).withColumn("rank", rare)
    first, second = F.col("rank") == 1, F.col("rank") == 2
    pairs = ranked.groupBy("phrase", "start").agg(
        F.min("n_rows").alias("fewest"),
        F.max(F.when(first, F.col("at"))).alias("at1"), F.max(F.when(first, F.col("term"))).alias("term1"),
        F.max(F.when(second, F.col("at"))).alias("at2"), F.max(F.when(second, F.col("term"))).alias("term2"),
    )
    return pairs.where("fewest > 0").select("phrase", "at1", "term1", "at2", "term2").distinct()


def phrase_matches(index: DataFrame, phrases: DataFrame, terms: DataFrame, window: int = WINDOW) -> DataFrame:
    """Exact matches ``row, phrase, first, last``: word positions of runs that hold ``window`` words of a phrase.

    A run is a stretch of at least ``window`` consecutive phrase words (all of them in a shorter phrase) found at
    consecutive positions of one document. The tables made from the test set are written and counted before they are
    broadcast; postings are joined by row and position otherwise.
    """
    placed = materialize(_placed_terms(phrases, terms), "phrase-terms")
    found = postings(index)
    anchors = materialize(_anchors(placed, found.groupBy("term").agg(F.count(F.lit(1)).alias("n_rows")), window), "anchors")
    rarest = small_or_shuffled(anchors.select(F.col("term1").alias("term"), "phrase", "at1", "at2", "term2"), "rarest")
    near = found.join(rarest, "term").select(
        "row", "phrase", (F.col("pos") - F.col("at1")).alias("shift"), "term2",
        (F.col("pos") - F.col("at1") + F.col("at2")).alias("pos2"),
    )
    seconds = small_or_shuffled(anchors.select(F.col("term2").alias("term")).where("term2 is not null").distinct(), "seconds")
    others = found.join(seconds, "term", "left_semi").select("row", F.col("term").alias("term2"), F.col("pos").alias("pos2"))
    alone = near.where("term2 is null").select("row", "phrase", "shift")
    both = near.where("term2 is not null").join(others, ["row", "term2", "pos2"], "left_semi")
    aligned = materialize(both.select("row", "phrase", "shift").unionByName(alone).distinct(), "aligned")
    held = small_or_shuffled(aligned.select("row").distinct(), "rows-aligned")
    steps = small_or_shuffled(placed, "steps")
    wanted = aligned.join(steps, "phrase").select(
        "row", "phrase", "shift", "n", "at", "term", (F.col("shift") + F.col("at")).alias("pos")
    )
    kept = found.join(held, "row", "left_semi")
    matched = wanted.join(kept, ["row", "term", "pos"]).select("row", "phrase", "shift", "n", "at")
    in_line = Window.partitionBy("row", "phrase", "shift").orderBy("at")
    runs = matched.withColumn("run", F.col("at") - F.row_number().over(in_line)).groupBy(
        "row", "phrase", "shift", "n", "run"
    ).agg(F.min("at").alias("begin"), F.max("at").alias("end"))
    whole = runs.where(F.col("end") - F.col("begin") + 1 >= F.least(F.lit(window), F.col("n")))
    return whole.select(
        "row", "phrase", (F.col("shift") + F.col("begin")).alias("first"), (F.col("shift") + F.col("end")).alias("last")
    )


def proximity_matches(index: DataFrame, phrases: DataFrame, terms: DataFrame, slop: int) -> DataFrame:
    """``row, phrase, near``: every different word of the phrase lies within ``slop`` words of an occurrence of its
    rarest one, at position ``near``. Postings meet by row and block of positions, never by row alone."""
    found = postings(index)
    counts = found.groupBy("term").agg(F.count(F.lit(1)).alias("n_rows"))
    asked = _placed_terms(phrases, terms).select("phrase", "term").distinct().join(counts, "term", "left")
    order = F.struct(F.coalesce("n_rows", F.lit(0)).alias("c"), "term")
    needed = asked.groupBy("phrase").agg(F.count(F.lit(1)).alias("needed"), F.min(order)["term"].alias("term"))
    block = max(slop, 1)
    centre = found.join(needed, "term").select(
        "row", "phrase", "needed", F.col("pos").alias("near"),
        F.explode(F.array(*[F.floor(F.col("pos") / block) + d for d in (-1, 0, 1)])).alias("block"),
    )
    others = found.join(asked, "term").select("row", "phrase", "term", "pos", F.floor(F.col("pos") / block).alias("block"))
    close = centre.join(others, ["row", "phrase", "block"]).where(F.abs(F.col("pos") - F.col("near")) <= slop)
    return close.groupBy("row", "phrase", "near", "needed").agg(F.count_distinct("term").alias("got")).where(
        "got = needed"
    ).select("row", "phrase", "near")


def decontaminate(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, share: int = SHARE,
) -> DataFrame:
    """Per document ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    Null and empty texts have no words and are clean. Items without words or without id are found under no name; an
    item without id still marks words. Repeated items count once, repeated documents are judged each. Empty tables
    give no rows, or documents without hits. Other columns are not read.
    """
    phrases, members = phrases_of(items, item_id, item_text)
    terms = materialize(vocabulary(phrases), "vocabulary")
    index = build_index(docs, terms, key, text)
    matches = materialize(phrase_matches(index, phrases, terms, window), "matches")
    hits = (
        matches.select("row", F.explode(F.sequence("first", "last")).alias("pos")).distinct()
        .groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    )
    named = (
        matches.select("row", "phrase").distinct().join(members, "phrase").select("row", "item_id").distinct()
        .groupBy("row").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    )
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return lengths(index).join(hits, "row", "left").join(named, "row", "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", listed).cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )


DECONTAMINATE_SQL = f"""
WITH split AS (
  SELECT doc_id, [w FOR w IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '{NO_WORD}') IF w <> ''] AS words, row_number() OVER () AS row
  FROM documents),
items AS (
  SELECT item_id::VARCHAR AS item_id, [w FOR w IN string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{NO_WORD}') IF w <> ''] AS words
  FROM benchmark),
phrases AS (
  SELECT item_id, least(len(words), 13) AS n,
         unnest([array_to_string(words[i : i + 12], ' ') FOR i IN range(1, greatest(len(words) - 12, 1) + 1)]) AS phrase
  FROM items WHERE len(words) > 0),
spans AS (
  SELECT row, n, unnest(range(1, len(words) - n + 2)) AS start, words
  FROM split, (SELECT DISTINCT n FROM phrases) WHERE len(words) >= n),
found AS (
  SELECT row, start, n, item_id FROM (SELECT row, start, n, array_to_string(words[start : start + n - 1], ' ') AS phrase FROM spans)
  JOIN phrases USING (n, phrase)),
hits AS (
  SELECT row, count(*) AS n_hit FROM (
    SELECT DISTINCT row, unnest(range(start, start + n)) AS pos FROM (SELECT DISTINCT row, start, n FROM found)) GROUP BY row),
named AS (
  SELECT row, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT row, item_id FROM found WHERE item_id IS NOT NULL) GROUP BY row)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND coalesce(n_hit, 0) * 20 >= len(words) AS contaminated
FROM split LEFT JOIN hits USING (row) LEFT JOIN named USING (row)
"""
