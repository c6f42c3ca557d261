"""Phrases of two and three words whose words belong together, counted over a prefix-free parse of the corpus.

Pieces of text are cut at words whose hash is a trigger, and every chunk runs on for two words into the next one, so a
phrase of up to three words lies whole in the chunk that its first word belongs to. What a chunk is depends on its words
alone: texts that repeat give the same chunks, and the corpus becomes a dictionary of different chunks with the number of
times each was parsed. Phrases are counted in the dictionary only, weighted by that number, and the two words that a
chunk shares with the next one begin phrases in the next one only.

The dictionary is held in blocks of bounded size that number their words. Counting goes from words to pairs to triples,
and each block learns which of its own words and pairs reach the least count before it forms anything longer, so what is
counted is exact and nothing but candidates and their parts travels.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftframe.functions.workspace import materialize
from shiftframe.llm.ngram import packed, unpacked_longs

LEAST_COUNT = 10
TOP = 2000
INSIDE_PERCENT = 50  # a phrase goes if a longer candidate around it has this share of its occurrences
TRIGGER = 16  # one word of so many begins a chunk
SHARED = 2  # words that a chunk shares with the next one: one less than the longest phrase
HELD_CHUNKS = 200_000  # different chunks that a task counts before it passes them on
BLOCK_WORDS = 2_000_000
ROWS_AT_ONCE = 100_000
SALTS = 64
#: What ends a piece of text, what separates words, and what is lower-cased.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
PLAIN = bytes.maketrans(
    string.ascii_uppercase.encode() + PIECE_ENDS + b"\t", string.ascii_lowercase.encode() + b"\n" * len(PIECE_ENDS) + b" "
)
LAST = "\n"  # ends the last chunk of a piece; no word holds one
BLOCK_TYPE = "block long, lang string, total long, words array<string>, counts array<long>, tokens binary, sizes binary, times binary"


def chunks_of(words: list[bytes], trigger: int = TRIGGER) -> list[bytes]:
    """The chunks of one piece in order, as texts; the last one ends with ``LAST``.

    A chunk begins at the first word and at every later one with a trigger hash that has another word behind it.
    """
    starts = [0, *[i for i in range(1, len(words) - 1) if not zlib.crc32(words[i]) % trigger]]
    cut = [b" ".join(words[a : b + SHARED]) for a, b in zip(starts, starts[1:])]
    return [*cut, b" ".join(words[starts[-1] :]) + LAST.encode()]


def parse_dictionary(docs: DataFrame, text: str, lang: str, trigger: int = TRIGGER) -> DataFrame:
    """``lang, chunk, n``: the different chunks of each language and how often each was parsed."""

    def told(held: dict[tuple[str, bytes], int]) -> pa.RecordBatch:
        langs, chunks = zip(*held)
        columns = [pa.array(langs, pa.string()), pa.array(chunks, pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "chunk", "n"])

    def parse(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bytes], int] = {}
        for batch in found:
            for of, content in zip(*batch.columns):
                name = of.as_py()
                for piece in (content.as_py() or "").encode().translate(PLAIN).split(b"\n"):
                    words = piece.split()
                    for chunk in chunks_of(words, trigger) if words else ():
                        held[name, chunk] = held.get((name, chunk), 0) + 1
                if len(held) >= HELD_CHUNKS:
                    yield told(held)
                    held = {}
        if held:
            yield told(held)

    narrow = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    parsed = narrow.mapInArrow(parse, "lang string, chunk string, n long")
    return parsed.groupBy("lang", "chunk").agg(F.sum("n").alias("n"))


def owned(sizes: np.ndarray) -> np.ndarray:
    """Which words begin phrases that count where they stand. A negative size is that of a piece's last chunk."""
    length = np.abs(sizes)
    left = np.repeat(np.cumsum(length), length) - np.arange(length.sum())  # words from here to the chunk's end
    return (left > SHARED) | np.repeat(sizes < 0, length)


def dictionary_blocks(dictionary: DataFrame) -> DataFrame:
    """The dictionary in rows of one language and up to ``BLOCK_WORDS`` words, which number their own words.

    ``tokens`` are the chunks' words, ``sizes`` their lengths (negative for the last chunk of a piece), ``times`` how often
    each chunk was parsed, ``counts`` what each word counts in this block, ``total`` all of it.
    """

    def closed(number: int, lang: str, words: dict[str, int], tokens: list[int], sizes: list[int], times: list[int]) -> pa.RecordBatch:
        token, size, time = (np.array(x, dtype=np.int64) for x in (tokens, sizes, times))
        weight = np.repeat(time, np.abs(size)) * owned(size)
        counts = np.zeros(len(words), dtype=np.int64)
        np.add.at(counts, token, weight)
        columns = [
            pa.array([number]), pa.array([lang]), pa.array([int(counts.sum())]), pa.array([list(words)], pa.list_(pa.string())),
            pa.array([counts], pa.list_(pa.int64())), *[pa.array([packed(x)], pa.binary()) for x in (token, size, time)],
        ]
        return pa.RecordBatch.from_arrays(columns, names=["block", "lang", "total", "words", "counts", "tokens", "sizes", "times"])

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = TaskContext.get().partitionId() << 32, 0
        open_: dict[str, tuple[dict[str, int], list[int], list[int], list[int]]] = {}
        for batch in found:
            for lang, chunk, n in zip(*(c.to_pylist() for c in batch.columns)):
                words, tokens, sizes, times = open_.setdefault(lang, ({}, [], [], []))
                own = chunk.removesuffix(LAST).split(" ")
                tokens.extend([words.setdefault(w, len(words)) for w in own])
                sizes.append(-len(own) if chunk.endswith(LAST) else len(own))
                times.append(n)
                total += len(own)
                if total >= BLOCK_WORDS:
                    for name, parts in open_.items():
                        yield closed(number, name, *parts)
                        number += 1
                    open_, total = {}, 0
        for name, parts in open_.items():
            yield closed(number, name, *parts)
            number += 1

    return dictionary.mapInArrow(batches, BLOCK_TYPE)


def counted(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows of the keys whose ``n`` adds up to ``least``, with that sum ``f``, a number ``id`` of the key, and ``first``.

    There is one row of a key per block at most, so a frequent key has as many rows as there are blocks.
    """
    same = Window.partitionBy(*keys)
    numbered = rows.withColumn("_own", F.monotonically_increasing_id())
    summed = numbered.withColumn("f", F.sum("n").over(same)).withColumn("id", F.min("_own").over(same))
    return summed.where(F.col("f") >= least).withColumn("first", F.col("_own") == F.col("id")).drop("_own", "n")


def summed_by(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sum of the weights of each."""
    order = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.diff(keys[order], prepend=-1))
    return keys[order][starts], np.add.reduceat(weight[order], starts) if len(starts) else weight[:0]


def pair_keys(tokens: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """For every word but the last, the number of the pair that it begins; -1 across chunks and at words left out."""
    ends = np.cumsum(np.abs(sizes))[:-1] - 1
    key = np.where((tokens[:-1] >= 0) & (tokens[1:] >= 0), tokens[:-1] * width + tokens[1:], -1)
    key[ends] = -1
    return key


def number_words(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """``block, ids, tokens, sizes, times`` with the blocks' words numbered by place in ``ids``, rare ones -1."""

    def number(block: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        at, ids = right.column("at").to_numpy(), right.column("id").to_numpy()
        order = np.argsort(ids)
        place = np.full(left.column("n_words")[0].as_py(), -1, dtype=np.int64)
        place[at[order]] = np.arange(len(order))
        tokens = place[unpacked_longs(left.column("tokens")[0].as_py())]
        return pa.table({
            "block": left.column("block"), "ids": pa.array([packed(ids[order])], pa.binary()),
            "tokens": pa.array([packed(tokens)], pa.binary()), "sizes": left.column("sizes"), "times": left.column("times"),
        })

    narrow = blocks.select("block", F.size("words").alias("n_words"), "tokens", "sizes", "times")
    back = words.select(F.col("block").alias("of_block"), "at", "id")
    return narrow.groupBy("block").cogroup(back.groupBy("of_block")).applyInArrow(
        number, "block long, ids binary, tokens binary, sizes binary, times binary"
    )


def block_pairs(numbered: DataFrame) -> DataFrame:
    """``block, a, b, n`` of the different pairs of frequent words in each block; ``n`` may be 0 for a shared pair."""

    def pairs(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for row in batch.to_pylist():
                ids, tokens, sizes, times = (unpacked_longs(row[c]) for c in ("ids", "tokens", "sizes", "times"))
                key = pair_keys(tokens, sizes, len(ids))
                weight = (np.repeat(times, np.abs(sizes)) * owned(sizes))[:-1]
                keys, n = summed_by(key[key >= 0], weight[key >= 0])
                for at in range(0, len(keys), ROWS_AT_ONCE):
                    a, b = np.divmod(keys[at : at + ROWS_AT_ONCE], len(ids))
                    columns = [np.full(len(a), row["block"]), ids[a], ids[b], n[at : at + ROWS_AT_ONCE]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["block", "a", "b", "n"])

    return numbered.mapInArrow(pairs, "block long, a long, b long, n long")


def block_triples(numbered: DataFrame, pairs: DataFrame) -> DataFrame:
    """``x, y, n`` of the different triples in each block that both frequent pairs ``x`` and ``y`` make up."""

    def triples(block: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0] if len(left) else None
        if row is None or not len(right):
            return pa.table({c: pa.array([], pa.int64()) for c in ("x", "y", "n")})
        ids, tokens, sizes, times = (unpacked_longs(row[c]) for c in ("ids", "tokens", "sizes", "times"))
        a, b, pair = (right.column(c).to_numpy() for c in ("a", "b", "id"))
        known = np.searchsorted(ids, a) * len(ids) + np.searchsorted(ids, b)
        order = np.argsort(known)
        known, pair = known[order], pair[order]
        key = pair_keys(tokens, sizes, len(ids))
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        at[known[at] != key] = -1
        weight = (np.repeat(times, np.abs(sizes)) * owned(sizes))[: max(len(at) - 1, 0)]
        both = (at[:-1] >= 0) & (at[1:] >= 0) & (weight > 0)
        keys, n = summed_by((at[:-1] * len(pair) + at[1:])[both], weight[both])
        x, y = np.divmod(keys, len(pair))
        return pa.table({"x": pair[x], "y": pair[y], "n": n})

    back = pairs.select(F.col("block").alias("of_block"), "a", "b", "id")
    return numbered.groupBy("block").cogroup(back.groupBy("of_block")).applyInArrow(triples, "x long, y long, n long")


def association(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) in whole numbers of up to 38 digits."""
    a, left, right = (x.cast("decimal(15,0)") for x in (a, left, right))
    return F.call_function("div", a * a * F.lit(1_000_000).cast("decimal(7,0)"), left * right)


def mine_collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST_COUNT, top: int = TOP, trigger: int = TRIGGER,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases of two and three words.

    Every candidate is counted in whole texts; the ranking is cut at ``top`` only after all are scored. A null or empty
    text has no words, rows without language share ``und``, repeated rows count each, an empty table gives no rows. Of
    phrases with equal score and count the smaller in UTF-8 order comes first. Other columns are not read.
    """
    blocks = materialize(dictionary_blocks(parse_dictionary(docs, text, lang, trigger)), "chunk-blocks")
    of_block = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x")).select(
        "block", "at", "lang", F.col("x.words").alias("word"), F.col("x.counts").alias("n")
    )
    found = counted(of_block, ["lang", "word"], least)
    words = materialize(found.withColumn("word", F.when(F.col("first"), F.col("word"))), "chunk-words")
    numbered = materialize(number_words(blocks, words), "numbered-blocks")
    pairs = materialize(counted(block_pairs(numbered), ["a", "b"], least), "chunk-pairs")
    triples = block_triples(numbered, pairs).groupBy("x", "y").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    triples = materialize(triples, "chunk-triples")

    word = words.where("first").select("id", "lang", "word", "f")
    pair = pairs.where("first").select("id", "a", "b", "f")
    named = lambda frame, to, name: frame.select(  # noqa: E731 - a copy whose columns have a prefix
        F.col("id").alias(to), *[F.col(c).alias(f"{name}_{c}") for c in frame.columns if c != "id"]
    )
    longer = triples.select(F.explode(F.array_distinct(F.array("x", "y"))).alias("id"), "f").groupBy("id").agg(F.max("f").alias("longer"))
    two = (
        pair.join(longer, "id", "left")
        .where(F.coalesce(100 * F.col("longer") < INSIDE_PERCENT * F.col("f"), F.lit(True)))
        .join(named(word, "a", "a"), "a").join(named(word, "b", "b"), "b")
        .select(
            F.col("a_lang").alias("lang"), F.concat_ws(" ", "a_word", "b_word").alias("phrase"), F.col("f").alias("a"),
            F.col("a_f").alias("l"), F.col("b_f").alias("r"), association(F.col("f"), F.col("a_f"), F.col("b_f")).alias("score"),
        )
    )
    three = (
        triples.join(named(pair, "x", "x"), "x").join(named(pair, "y", "y"), "y")
        .join(named(word, "x_a", "a"), "x_a").join(named(word, "x_b", "b"), "x_b").join(named(word, "y_b", "c"), "y_b")
    )
    cuts = [(F.col("a_f"), F.col("y_f")), (F.col("x_f"), F.col("c_f"))]
    scored = [
        F.struct(association(F.col("f"), left, right).alias("score"), F.lit(k + 1).alias("k"), left.alias("l"), right.alias("r"))
        for k, (left, right) in enumerate(cuts)
    ]
    three = three.withColumn("cut", F.least(*scored)).select(
        F.col("a_lang").alias("lang"), F.concat_ws(" ", "a_word", "b_word", "c_word").alias("phrase"), F.col("f").alias("a"),
        F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"),
    )
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = two.unionByName(three).withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    near = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*best))).where(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    total = blocks.groupBy(F.col("lang").alias("of")).agg(F.sum("total").alias("n"))
    return ranked.join(total, F.col("lang") == F.col("of")).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(string_split_regex(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)
),
one AS (SELECT lang, unnest(w) AS phrase FROM pieces),
two AS (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM pieces WHERE len(w) > 1),
three AS (
  SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS phrase
  FROM pieces WHERE len(w) > 2
),
f1 AS (SELECT lang, phrase, count(*) AS f FROM one GROUP BY ALL HAVING count(*) >= 10),
f2 AS (SELECT lang, phrase, count(*) AS f, string_split(phrase, ' ') AS p FROM two GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, phrase, count(*) AS f, string_split(phrase, ' ') AS p FROM three GROUP BY ALL HAVING count(*) >= 10),
inside AS (
  SELECT lang, part, max(f) AS longer
  FROM (SELECT lang, f, p[1] || ' ' || p[2] AS part FROM f3 UNION ALL SELECT lang, f, p[2] || ' ' || p[3] FROM f3)
  GROUP BY ALL
),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM f2 c JOIN f1 x ON x.lang = c.lang AND x.phrase = c.p[1] JOIN f1 y ON y.lang = c.lang AND y.phrase = c.p[2]
  LEFT JOIN inside i ON i.lang = c.lang AND i.part = c.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < 50 * c.f
  UNION ALL
  SELECT c.lang, c.phrase, c.f, 1, x.f, y.f
  FROM f3 c JOIN f1 x ON x.lang = c.lang AND x.phrase = c.p[1] JOIN f2 y ON y.lang = c.lang AND y.phrase = c.p[2] || ' ' || c.p[3]
  UNION ALL
  SELECT c.lang, c.phrase, c.f, 2, x.f, y.f
  FROM f3 c JOIN f2 x ON x.lang = c.lang AND x.phrase = c.p[1] || ' ' || c.p[2] JOIN f1 y ON y.lang = c.lang AND y.phrase = c.p[3]
),
scored AS (SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts),
lowest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest WHERE nth = 1
)
SELECT lang, rank, phrase, a, l, r, n, score
FROM ranked JOIN (SELECT lang, count(*) AS n FROM one GROUP BY lang) USING (lang)
WHERE rank <= 2000
"""
