"""Mix sources to target weights by hash-random keys, ranges of keys and prefix sums over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftframe.functions.workspace import materialize
from shiftframe.llm.text import SPACE

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
RANGE_DIGITS = 3  # hex digits of the key that name its range: 4096 ranges per source


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Add ``target`` to a table of ``no_source, src, source_size``.

    The sum of all sizes is shared by weight. A source that would get more than ``most`` times its size gets just
    that, and the rest goes to the others by weight. In order of size per weight the capped ones come first, so
    running sums find them. The two windows have no partition: they see one row per source.
    """
    by_name, everything = Window.orderBy("no_source", "src"), Window.partitionBy(F.lit(1))
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    cycle = F.array(*[F.lit(w) for w in weights])
    weighed = sources.withColumn("weight", F.element_at(cycle, (place + 1).cast("int")).cast("long"))
    weighed = weighed.withColumn("cap", F.col("source_size") * most)
    earlier = Window.orderBy(F.col("cap") / F.col("weight"), "no_source", "src").rowsBetween(
        Window.unboundedPreceding, -1
    )
    summed = weighed.select(
        "*",
        F.sum("source_size").over(everything).alias("_all"),
        F.sum("weight").over(everything).alias("_weights"),
        F.coalesce(F.sum("cap").over(earlier), F.lit(0)).alias("_caps_before"),
        F.coalesce(F.sum("weight").over(earlier), F.lit(0)).alias("_weights_before"),
    )
    level = (F.col("_all") - F.col("_caps_before")) / (F.col("_weights") - F.col("_weights_before"))
    marked = summed.withColumn("_capped", F.col("cap") / F.col("weight") <= level)
    left = F.col("_all") - F.coalesce(F.sum(F.when(F.col("_capped"), F.col("cap"))).over(everything), F.lit(0))
    open_weight = F.sum(F.when(~F.col("_capped"), F.col("weight"))).over(everything)
    target = F.when(F.col("_capped"), F.col("cap").cast("double")).otherwise(
        left.cast("double") * F.col("weight") / open_weight
    )
    return marked.select("no_source", "src", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix",
    weights: tuple[int, ...] = WEIGHTS, row: str | None = None,
) -> DataFrame:
    """Words that a mix takes from every document: ``doc_id, size, source_size, target, taken``.

    Each document has a hash-random key. Keys are sorted within ranges of a source; sums per range, added up along
    the source, give the words before each document, and the source's budget is cut there to the word. A budget above
    the source's size takes whole passes first. A hot source is 4096 ranges, each of them one key of the shuffle.
    Nulls: a null text has no words, a null source is a source of its own (last), a null id has one key for all such
    rows, ordered by size. Equal rows tie and may swap. An empty table gives no rows. Other columns are not read, but for
    ``row``, a column that tells rows apart: it settles ties and is passed on as ``row``.
    """
    told = [] if row is None else [F.col(row).alias("row")]
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null"))).cast("binary"))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        F.col(source).isNull().alias("no_source"),
        F.coalesce(F.col(source), F.lit("")).alias("src"),
        word_count(F.col(text)).alias("size"),
        hashed.alias("key"),
        *told,
    )
    rows = materialize(rows.withColumn("range", F.substring("key", 1, RANGE_DIGITS)), "mix-sizes")
    ranges = rows.groupBy("no_source", "src", "range").agg(F.sum("size").alias("in_range"))
    named = Window.partitionBy("no_source", "src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.withColumn("before", F.coalesce(F.sum("in_range").over(named), F.lit(0)))
    goal = targets(rows.groupBy("no_source", "src").agg(F.sum("size").alias("source_size")), weights)
    placed = before.join(goal, ["no_source", "src"]).drop("in_range")
    inside = Window.partitionBy("no_source", "src", "range").orderBy("key", "size", *(["row"] if told else [])).rowsBetween(
        Window.unboundedPreceding, 0
    )
    summed = rows.join(placed, ["no_source", "src", "range"]).withColumn(
        "_start", F.col("before") + F.sum("size").over(inside) - F.col("size")
    )
    budget = F.floor(F.col("target") + 0.5)
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - passes * F.col("source_size")
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_start")))
    return summed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *(["row"] if told else []))


MIX_SQL = f"""
WITH rows AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS src,
         len(regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS key
  FROM documents),
sources AS (SELECT no_source, src, sum(size)::BIGINT AS source_size FROM rows GROUP BY 1, 2),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY no_source, src) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         3 * source_size AS cap
  FROM sources),
summed AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT AS total, (sum(weight) OVER ())::BIGINT AS weights,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, no_source, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT
      AS caps_before,
    coalesce(sum(weight) OVER (ORDER BY cap / weight, no_source, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT
      AS weights_before
  FROM weighed),
marked AS (SELECT *, cap / weight <= (total - caps_before) / (weights - weights_before) AS capped FROM summed),
goals AS (
  SELECT no_source, src, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE
    (total - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0))::DOUBLE * weight
      / (sum(CASE WHEN NOT capped THEN weight END) OVER ())::BIGINT END AS target
  FROM marked),
placed AS (
  SELECT doc_id, size, source_size, target, floor(target + 0.5)::BIGINT AS budget,
    (sum(size) OVER (PARTITION BY no_source, src ORDER BY key, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
  FROM rows JOIN goals USING (no_source, src))
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
    + greatest(0, least(size, CASE WHEN source_size > 0 THEN budget % source_size ELSE 0 END - start)))::BIGINT AS taken
FROM placed
"""
