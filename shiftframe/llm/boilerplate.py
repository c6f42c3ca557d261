"""Line dedup by site-relative frequency: a line on too large a share of a host's pages is boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftframe.functions.workspace import materialize
from shiftframe.llm.text import small_or_shuffled

MOST_SHARE = 0.1
LEAST_PAGES = 3  # a line is repeated only from this many pages of the host on

# fixed values: markup that is not text, and tags that end a line
HIDDEN = r"(?s)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
BREAK = r"<(?:/?(?:p|div|li|ul|ol|h1|h2|h3|h4|h5|h6|title|article|section|nav|header|footer|table|tr|body|head|html)\b[^>]*|br\b[^>]*)>"
TAG = r"<[^>]*>"


def host_of(url: Column) -> Column:
    """Host of a URL in lower case; the empty text if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)", 1))


def lines_of(html: Column) -> Column:
    """Text lines of a page: hidden parts and tags removed, block tags end a line, blanks squeezed, no empty lines."""
    shown = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, ""), BREAK, "\n")
    plain = F.regexp_replace(F.regexp_replace(shown, TAG, ""), r"[ \t\r]+", " ")
    return F.array_remove(F.split(F.regexp_replace(plain, r" ?\n[ \n]*|^ | $", "\n"), "\n", -1), "")


def drop_boilerplate(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
    most_share: float = MOST_SHARE, least_pages: int = LEAST_PAGES,
) -> DataFrame:
    """``page_id, host, n_lines, n_dropped, text`` of every page, ``text`` being the lines that stay.

    A line counts once per page. It goes from all pages of a host when at least ``least_pages`` of them, and more than
    ``most_share`` of them, have it. Counts are combined before the shuffle, so a hot host or line is many small
    partial sums. Pages without a host form one host of the empty name; a null html has no lines; repeated rows are
    pages of their own. An empty table gives no rows. Other columns are not read.
    """
    lined = materialize(
        pages.select(
            F.monotonically_increasing_id().alias("row"), F.col(page_id).alias("page_id"),
            host_of(F.col(url)).alias("host"), lines_of(F.col(html)).alias("lines"),
        ),
        "page-lines",
    )
    total = lined.groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    seen = (
        lined.select("host", F.explode(F.array_distinct("lines")).alias("line"))
        .groupBy("host", "line").agg(F.count(F.lit(1)).alias("on")).where(F.col("on") >= least_pages)
    )
    common = small_or_shuffled(
        seen.join(total, "host").where(F.col("on") > F.col("of") * F.lit(most_share)).select("host", "line"), "boilerplate"
    )
    dropped = (
        lined.select("row", "host", F.posexplode("lines").alias("at", "line"))
        .join(common, ["host", "line"], "left_semi")
        .groupBy("row").agg(F.collect_set("at").alias("gone"))
    )
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    stay = F.filter("lines", lambda line, at: ~F.array_contains(gone, at))
    return lined.join(dropped, "row", "left").select(
        "page_id",
        "host",
        F.size("lines").cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_dropped"),
        F.concat_ws("\n", stay).alias("text"),
    )


BOILERPLATE_SQL = rf"""
WITH lined AS (
  SELECT row_number() OVER () AS row, page_id,
    lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)', 1)) AS host,
    [s FOR s IN string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      coalesce(html, ''), '{HIDDEN}', '', 'g'), '{BREAK}', chr(10), 'g'), '{TAG}', '', 'g'),
      '[ \t\r]+', ' ', 'g'), ' ?\n[ \n]*|^ | $', chr(10), 'g'), chr(10)) IF s <> ''] AS lines
  FROM pages),
total AS (SELECT host, count(*) AS of FROM lined GROUP BY host),
common AS (
  SELECT host, line FROM (
    SELECT host, line, count(*) AS seen_on FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM lined) GROUP BY ALL)
  JOIN total USING (host) WHERE seen_on >= {LEAST_PAGES} AND seen_on > of * {MOST_SHARE}::DOUBLE),
spread AS (SELECT row, host, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM lined),
marked AS (SELECT spread.*, common.line IS NOT NULL AS gone FROM spread LEFT JOIN common USING (host, line)),
joined AS (
  SELECT row, count(*) FILTER (WHERE gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS text
  FROM marked GROUP BY row)
SELECT page_id, host, len(lines)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, coalesce(text, '') AS text
FROM lined LEFT JOIN joined USING (row)
"""
