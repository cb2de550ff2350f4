"""An HTML review of a bundle: pages, decisions and boundary marks, rendered in the tasks, one string a bundle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def render(decisions: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """decisions(bundle_id, page_index, split, reason, confidence) to bundle_id, html."""
    rows = decisions
    if marks is not None:
        rows = rows.join(marks.select("bundle_id", (F.col("page_index") + 1).alias("page_index"), "mark"), ["bundle_id", "page_index"], "left")
    else:
        rows = rows.withColumn("mark", F.lit(None).cast("string"))
    line = F.concat(F.lit('<tr class="'), F.coalesce("mark", F.lit("")), F.lit('"><td>'), F.col("page_index"), F.lit("</td><td>"), F.when(F.col("split"), "split").otherwise(""), F.lit("</td><td>"), escape(F.col("reason")), F.format_string("</td><td>%.2f</td></tr>", "confidence"))
    listed = rows.groupBy("bundle_id").agg(F.array_sort(F.collect_list(F.struct("page_index", line.alias("line")))).alias("l"))
    return listed.select("bundle_id", F.concat(F.lit('<!doctype html><meta charset="utf-8"><title>'), escape(F.col("bundle_id")), F.lit("</title><table>"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("</table>")).alias("html"))
