"""Pipe tables that page ends have cut in two, put together again, over lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.text import strip


def is_row(line: Column) -> Column:
    """Whether a line is a row of a pipe table: a pipe at both ends and one between at least."""
    return strip(line).rlike(r"(?s)^\|.*\|.*\|$")


def is_rule(line: Column) -> Column:
    """Whether a line is the rule below a table's header: pipes at both ends, cells of three dashes or more with colons beside."""
    return strip(line).rlike(r"(?U)^\|+(\s*:?-{3,}:?\s*\|)*\s*:?-{3,}:?\s*\|+$")


def header(line: Column) -> Column:
    """A header's cells without white space and line breaks."""
    bare = F.regexp_replace(strip(line), r"^\|+|\|+$", "")
    return F.regexp_replace(F.replace(bare, F.lit("<br>"), F.lit("")), r"(?U)\s+", "")


def merged(lines: DataFrame, by: str = "doc_id") -> DataFrame:
    """Lines (by, line, content) without what stands between the parts of a table: blank lines, repeated header and rule.

    A table is a header, a rule and all rows that follow. The next one is a part of it if only blank lines lie between and
    the headers are equal; of several parts each is held against the one before it. Headers without a rule begin no table.
    All columns come from running frames of one order: runs of rows are islands, a run's first header with a rule opens its
    table, and what the table before it was is the last value so far. So lines are sorted once, nothing is gathered or
    joined, and windows stream one document's lines. Null contents are blank.
    """
    order = W.partitionBy(by).orderBy("line")
    sofar, before = order.rowsBetween(W.unboundedPreceding, W.currentRow), order.rowsBetween(W.unboundedPreceding, -1)
    text = F.coalesce(F.col("content"), F.lit(""))
    last = lambda of, value, frame: F.last(F.when(F.col(of), value), True).over(frame)
    rows = lines.withColumns({"_row": is_row(text), "_full": strip(text) != "", "_rule": is_rule(text)})
    rows = rows.withColumns({
        "_start": F.col("_row") & F.coalesce(F.lead("_rule").over(order), F.lit(False)),
        "_new": F.col("_row") & ~F.coalesce(F.lag("_row").over(order), F.lit(False)),
        "_two": F.coalesce(F.lead("_row").over(order), F.lit(False)),
    }).drop("_rule")
    rows = rows.withColumns({"_starts": F.count_if("_start").over(sofar), "_run": last("_new", F.col("line"), sofar), "_above": last("_full", F.col("line"), before)})
    rows = rows.withColumn("_base", last("_new", F.col("_starts") - F.col("_start").cast("long"), sofar))
    rows = rows.withColumn("_opens", F.col("_start") & (F.col("_starts") == F.col("_base") + 1)).drop("_starts", "_base", "_start", "_new")
    rows = rows.withColumn("_first", last("_opens", F.col("line"), sofar))
    rows = rows.withColumn("_of", F.col("_row") & F.coalesce(F.col("_first") >= F.col("_run"), F.lit(False))).drop("_run", "_row")
    rows = rows.withColumn("_head", F.when(F.col("_opens"), header(text)))
    joins = (last("_of", F.col("line"), before) == F.col("_above")) & (last("_opens", F.col("_head"), before) == F.col("_head")) & last("_opens", F.col("_two"), before) & F.col("_two")
    rows = rows.withColumn("_joins", F.col("_opens") & F.coalesce(joins, F.lit(False))).drop("_above", "_two", "_head")
    quoted = f"`{by.replace('`', '``')}`"
    rows = rows.withColumns({
        "_part": last("_opens", F.col("_joins"), sofar),
        "_next": F.expr(f"lead(if(_full, _joins, null)) IGNORE NULLS OVER (PARTITION BY {quoted} ORDER BY line)"),
    })
    gone = F.when(F.col("_of"), F.col("_part") & (F.col("line") < F.col("_first") + 2)).otherwise(~F.col("_full") & F.coalesce(F.col("_next"), F.lit(False)))
    return rows.where(~gone).select(*lines.columns)
