"""Reports: CSV, JSON and one HTML page."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(rows: DataFrame, path: str) -> None:
    """One row a member, with a header; written in parallel."""
    rows.write.mode("overwrite").option("header", "true").csv(path)


def nested_groups(rows: DataFrame) -> DataFrame:
    """(group_id, category, files): members (path, size, ...) of each group in order of path.

    A group's files become one value, so the members of a group must fit in a
    row; rows of larger groups belong in the CSV.
    """
    other = [c for c in rows.columns if c not in ("group_id", "category")]
    first = ["path", *[c for c in other if c != "path"]]
    return rows.groupBy("group_id", "category").agg(F.array_sort(F.collect_list(F.struct(*first))).alias("files"))


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a group and line."""
    nested_groups(rows).write.mode("overwrite").json(path)


def write_html(summary: DataFrame, rows: DataFrame, path: str) -> None:
    """One page with the totals by category and every file of every group; everything is escaped.

    Lines are sorted by the executors and written by the driver as they come,
    a partition at a time, so neither a group nor the page has to fit in a row
    or in memory.
    """
    heads = rows.groupBy("group_id", "category").agg(F.count(F.lit(1)).alias("n")).withColumn("path", F.lit(None).cast("string"))
    listed = rows.where("path is not null").select("group_id", "category", "path").distinct().withColumn("n", F.lit(None).cast("bigint"))
    lines = heads.unionByName(listed).orderBy("group_id", "category", F.col("path").asc_nulls_first())
    with open(path, "w", encoding="utf-8", errors="surrogateescape") as page:
        page.write(_top(summary))
        inside = False
        for r in lines.toLocalIterator():
            if r["path"] is None:
                page.write(f"{'</ul>' if inside else ''}<h2>#{r['group_id']} {html.escape(str(r['category']))} ({r['n']})</h2><ul>\n")
                inside = True
            else:
                page.write(f"<li>{html.escape(r['path'])}</li>\n")
        page.write(f"{'</ul>' if inside else ''}</body></html>")


def _top(summary: DataFrame) -> str:
    """The page up to the groups; there are as many tiles as categories."""
    tiles = "".join(f"<li>{html.escape(str(r['category']))}: {r['groups']} groups, {r['files']} files, {r['reclaimable']} bytes</li>" for r in summary.orderBy("category").toLocalIterator())
    return f"<!doctype html><html><head><meta charset='utf-8'><title>Duplicates</title></head><body><ul>{tiles}</ul>"


def html_report(summary: DataFrame, rows: DataFrame, most_groups: int = 1500) -> str:
    """An overview with the totals by category and the files of the first ``most_groups`` groups; everything is escaped.

    What goes to the driver is limited by that number of groups and 50 files of
    each; the page says how many it leaves out. :func:`write_html` lists all.
    """
    held = rows.groupBy("group_id", "category").agg(F.count_distinct("path").alias("n"))
    here = F.coalesce(F.col("group_id") <= most_groups, F.lit(False))
    left = held.agg(F.count_if(~here).alias("groups"), F.coalesce(F.sum(F.col("n") - F.when(here, F.least("n", F.lit(50))).otherwise(0)), F.lit(0)).alias("files")).first()
    note = f"<p>Left out here: {left['groups']} groups, {left['files']} files. The whole list is in the full page (write_html), CSV and JSON.</p>" if left["files"] or left["groups"] else ""
    shown = rows.where(F.col("group_id") <= most_groups).groupBy("group_id", "category").agg(F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_set("path")), 1, 50).alias("paths"))
    body = "".join(
        f"<h2>#{r['group_id']} {html.escape(str(r['category']))} ({r['n']})</h2><ul>" + "".join(f"<li>{html.escape(p)}</li>" for p in r["paths"]) + "</ul>" for r in shown.orderBy("group_id").collect()
    )
    return f"{_top(summary)}{note}{body}</body></html>"
