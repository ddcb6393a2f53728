"""Layout of blocks (page, x0, y0, x1, y1, font, size, text): fonts, order, tables, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fonts(blocks: DataFrame, page: str = "page") -> DataFrame:
    """Mean size, most frequent font (of equals the first by name), number of fonts and range of sizes."""
    own = blocks.groupBy(page, "font").agg(F.count("*").alias("n"), F.sum("size").alias("s"), F.min("size").alias("a"), F.max("size").alias("b"))
    return own.groupBy(page).agg((F.sum("s") / F.sum("n")).alias("mean_size"), F.min_by("font", F.struct(-F.col("n"), "font")).alias("dominant_font"), F.count("*").alias("n_fonts"), F.min("a").alias("least_size"), F.max("b").alias("most_size"))


def reading_order(blocks: DataFrame, page: str = "page", order: str = "block") -> DataFrame:
    """1 - share of blocks that stand more than 10 above and not right of the one before; 1 with less than two."""
    w = Window.partitionBy(page).orderBy(order)
    rows = blocks.withColumns({"py": F.lag("y0").over(w), "px": F.lag("x0").over(w)})
    wrong = F.count_if((F.col("y0") < F.col("py") - 10) & (F.col("x0") <= F.col("px")))
    return rows.groupBy(page).agg(F.when(F.count("*") < 2, 1.0).otherwise(1 - wrong / F.count("*")).alias("reading_order"))


def edges(blocks: DataFrame, height: float, page: str = "page") -> DataFrame:
    return blocks.groupBy(page).agg(F.bool_or(F.col("y0") < 0.1 * height).alias("has_header"), F.bool_or(F.col("y1") > 0.9 * height).alias("has_footer"))


def quality(blocks: DataFrame, page: str = "page") -> DataFrame:
    """Mean of: length up to 1000 characters, evenness of sizes (population variance), few replacement characters, share of
    blocks of usual area."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    bad = F.length("text") - F.length(F.replace("text", F.lit("�"), F.lit("")))
    parts = [F.least(F.sum(F.length("text")) / 1000, F.lit(1.0)), 1 / (1 + F.var_pop("size") / 100), 1 / (1 + F.sum(bad) / 10), F.avg(F.when((area > 100) & (area < 100_000), 1.0).otherwise(0.0))]
    return blocks.groupBy(page).agg((sum(parts[1:], parts[0]) / 4).alias("layout_quality"))


def tables(blocks: DataFrame, page: str = "page") -> DataFrame:
    """Rows of blocks whose tops lie less than 5 from a row's first: a table has over two rows, more than one column, and over
    1.5 columns on average.

    A block joins the first row found that is near enough, so this is a fold over a page's blocks from the top. A row that
    begins at exactly 0 only takes blocks that do so too.
    """
    state = F.struct(F.array().cast("array<double>").alias("at"), F.array().cast("array<int>").alias("n"))

    def step(s: Column, y: Column) -> Column:
        close = F.array_position(F.transform(s["at"], lambda a: F.abs(a - y) < 5), True)
        near = F.when((close > 0) & (F.get(s["at"], (close - 1).cast("int")) != 0), close).otherwise(F.array_position(s["at"], y))
        grown = F.transform(s["n"], lambda c, i: F.when(i + 1 == near, c + 1).otherwise(c))
        return F.when(near > 0, F.struct(s["at"].alias("at"), grown.alias("n"))).otherwise(F.struct(F.array_append(s["at"], y).alias("at"), F.array_append(s["n"], F.lit(1)).alias("n")))

    rows = blocks.groupBy(page).agg(F.array_sort(F.collect_list(F.col("y0").cast("double"))).alias("tops")).withColumn("r", F.aggregate("tops", state, step)["n"])
    n, total = F.size("r"), F.aggregate("r", F.lit(0), lambda a, x: a + x)
    mean = total / F.greatest(n, F.lit(1))
    return rows.select(page, n.cast("long").alias("n_rows"), F.array_max("r").alias("most_columns"), ((n > 2) & (F.array_max("r") > 1) & (mean > 1.5)).alias("is_table"), F.least(mean / 3, F.lit(1.0)).alias("confidence"))


def spans_joined(blocks: DataFrame, spans: DataFrame) -> DataFrame:
    """Blocks with the most frequent font and flags and the mean size of their spans."""
    own = spans.groupBy("page", "block").agg(F.mode("font", True).alias("font"), F.avg("size").alias("size"), F.mode("flags", True).alias("flags"))
    return blocks.join(own, ["page", "block"], "left")


def bold(flags: Column) -> Column:
    return flags.bitwiseAND(F.lit(16)) != 0


def italic(flags: Column) -> Column:
    return flags.bitwiseAND(F.lit(2)) != 0


def page_text(lines: DataFrame, page: str = "page") -> DataFrame:
    """Lines (text, confidence, x1, y1) joined from the top left, with their mean confidence and counts."""
    rows = lines.groupBy(page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y1", "x1", "text"))), lambda x: x["text"]), "\n").alias("text"), F.avg("confidence").alias("confidence"))
    return rows.withColumns({"n_words": F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")), "n_chars": F.length("text")})
