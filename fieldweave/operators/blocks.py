"""Block tables ``doc_id, page, block_idx, text, x0, y0, x1, y1`` from lines, spans and pages.

All are maps or one grouped aggregation by (document, page, block); no row is gathered beyond its block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import strip

#: Layout of a text without coordinates: a line is 12 high, a character 6 wide.
LINE, CHARACTER, HEIGHT = 12.0, 6.0, 10.0


def from_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A block for every line that isn't blank; numbers are those of the lines."""
    lines = docs.select(F.col(key).alias("doc_id"), F.posexplode(F.split(F.col(text), "\n")).alias("block_idx", "raw")).withColumn("text", strip(F.col("raw")))
    y = F.col("block_idx") * LINE
    return lines.where("text <> ''").select("doc_id", F.lit(0).alias("page"), "block_idx", "text", F.lit(0.0).alias("x0"), y.alias("y0"), (F.length("text") * CHARACTER).alias("x1"), (y + HEIGHT).alias("y1"))


def from_spans(spans: DataFrame) -> DataFrame:
    """Spans ``doc_id, page, block_idx, line, span, text, x0..y1`` to blocks: trimmed texts in order, the hull of their boxes.

    Empty spans are dropped, and blocks without any text with them.
    """
    kept = spans.withColumn("text", strip(F.col("text"))).where("text <> ''")
    return kept.groupBy("doc_id", "page", "block_idx").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("line", "span", "text")))["text"], " ").alias("text"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )


def from_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One block without a place for each whole text: how documents without a layout are read."""
    zero = F.lit(0.0)
    return docs.select(F.col(key).alias("doc_id"), F.lit(0).alias("page"), F.lit(0).alias("block_idx"), F.col(text).alias("text"), zero.alias("x0"), zero.alias("y0"), zero.alias("x1"), zero.alias("y1"))


def from_html(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """A block for every text between tags, scripts and styles apart."""
    bare = F.regexp_replace(F.col(html), r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", "<>")
    parts = pages.select(F.col(key).alias("doc_id"), F.posexplode(F.split(bare, "<[^>]*>")).alias("block_idx", "raw"))
    return parts.select("doc_id", F.lit(0).alias("page"), "block_idx", strip(F.regexp_replace("raw", r"\s+", " ")).alias("text")).where("text <> ''")


def simple_text(blocks: DataFrame) -> DataFrame:
    """``doc_id, text``: the blocks' trimmed texts, one a line, without empty ones."""
    t = strip(F.col("text"))
    return blocks.where(t != "").groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("page", "block_idx", t.alias("t"))))["t"], "\n").alias("text"))


def page_sizes(blocks: DataFrame) -> DataFrame:
    """``doc_id, width, height``: the farthest right and lower edges over all pages."""
    return blocks.groupBy("doc_id").agg(F.max("x1").cast("double").alias("width"), F.max("y1").cast("double").alias("height"))


def size_or_default(width: Column, height: Column) -> tuple[Column, Column]:
    return F.coalesce(width, F.lit(fixed.PAGE_WIDTH)), F.coalesce(height, F.lit(fixed.PAGE_HEIGHT))


def first_seen(rows: DataFrame, label: str, order: str) -> DataFrame:
    """Labels in the order in which they first appear, with their number of rows."""
    seen = rows.where(F.coalesce(F.col(label), F.lit("")) != "").groupBy(label).agg(F.min(order).alias("first"), F.count("*").alias("n"))
    return seen.withColumn("queue", F.row_number().over(W.orderBy("first")))
