"""Looking through groups and acting on them: flags, filters, sorts, decisions, deletion, the log of operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.media import CATEGORY_RANKS, EXACT, base_name, confidence
from shutterlake.operators.skew import salted_join

# Categories that count as similar, besides the exact ones.
SIMILAR = ("visually_identical", "same_content_likely", "resized_duplicate", "cropped_similar", "very_similar", "similar")
#: What each view of the groups keeps; all but 'resolved' hide resolved groups and groups of too few files.
VIEWS = {
    "all": "true", "pictures": "pictures", "videos": "videos", "file_identical": "category = 'file_identical'", "pixel_identical": "category = 'pixel_identical'", "resized": "category = 'resized_duplicate'",
    "crops": "category = 'cropped_similar'", "similar": "category in (" + ", ".join(f"'{c}'" for c in SIMILAR) + ")", "unreviewed": "not reviewed", "reviewed": "reviewed", "marked": "marked > 0", "resolved": "resolved",
}
#: How groups are sorted; the first four descending.
SORTS = {"savings": "potential", "count": "files", "unit_size": "unit_size", "similarity": "likeness", "name": "first_name", "path": "first_path"}
#: What can be done with a group as a whole.
ACTIONS = ("keep_selected", "keep_all", "ignore", "clear")
# Labels of categories in English and Spanish.
LABELS = {
    "file_identical": ("Identical file", "Archivo idéntico"), "pixel_identical": ("Identical pixels", "Pixel por pixel idéntico"), "visually_identical": ("Visually identical", "Visualmente idéntico"), "same_content_likely": ("Same content, likely", "Mismo contenido probable"),
    "resized_duplicate": ("Resized duplicate", "Duplicado redimensionado"), "cropped_similar": ("Crop of the same picture", "Recorte de la misma imagen"), "very_similar": ("Very similar", "Muy similar"), "similar": ("Similar", "Similar"), "different": ("Different", "Diferente"),
}


def label(category: Column, language: str = "en") -> Column:
    """A category's label; one that isn't known passes through."""
    at = 0 if language == "en" else 1
    names = F.create_map(*[F.lit(x) for c, pair in LABELS.items() for x in (c, pair[at])])
    return F.coalesce(F.try_element_at(names, category), category)


def _is(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def first_members(members: DataFrame) -> DataFrame:
    """(group_id, first_name, first_path): of each group's oldest file, ties by path whatever its case."""
    low = F.lower("path")
    first = members.where("path is not null").groupBy("group_id").agg(F.min(F.struct("mtime", low.alias("low"), "path")).alias("r"))
    return first.select("group_id", F.lower(base_name(F.col("r.path"))).alias("first_name"), F.col("r.low").alias("first_path"))


def group_flags(members: DataFrame) -> DataFrame:
    """One row a group of what its members say together.

    ``members`` has group_id, file_id, category, similarity, kind, size, path,
    mtime, decision, reviewed, deleted, ignored; nulls count as undecided,
    unreviewed, there and not ignored. A group's category is that of the
    highest rank. Unsafe: everything would go. Resolved: ignored, or fewer
    than two files left.
    """
    gone, dropped = F.col("decision") == "delete", _is(F.col("deleted"))
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in CATEGORY_RANKS.items() for x in p]), F.col("category")), F.lit(-1))
    size = F.coalesce("size", F.lit(0))
    there = F.when(~dropped, size)
    flags = members.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(~dropped).alias("active"), F.max(F.struct(rank.alias("rank"), "category")).alias("c"), F.sum(size).alias("total_size"), F.min(size).alias("unit_size"),
        (F.coalesce(F.sum(there), F.lit(0)) - F.coalesce(F.max(there), F.lit(0))).alias("spare"), F.coalesce(F.sum(F.when(gone, size)), F.lit(0)).alias("reclaimable"), F.count_if(_is(gone) & ~dropped).alias("marked"),
        F.every(_is(F.col("reviewed"))).alias("all_reviewed"), F.some(F.coalesce("decision", F.lit("undecided")) != "undecided").alias("decided"), F.every(_is(gone)).alias("unsafe"), F.some(_is(F.col("ignored"))).alias("ignored"),
        F.every(_is(F.col("kind") == "image")).alias("pictures"), F.every(_is(F.col("kind") == "video")).alias("videos"), F.max(F.when(~F.isnan("similarity"), F.col("similarity"))).alias("similarity"),
    )
    category = F.col("c.category")
    exact = category.isin(*EXACT)
    return flags.select(
        "group_id", category.alias("category"), "files", "active", "total_size", "unit_size", F.when(F.col("active") >= 2, F.col("spare")).otherwise(0).alias("potential"), "reclaimable", "marked", "unsafe", "ignored", "pictures", "videos",
        "similarity", (F.col("ignored") | (F.col("active") < 2)).alias("resolved"), (F.col("ignored") | F.col("all_reviewed") | F.col("decided")).alias("reviewed"), _is(exact).alias("exact"),
        confidence(category, F.col("similarity")).alias("confidence"), F.coalesce(F.nullif("similarity", F.lit(0.0)), F.when(_is(exact), 100.0).otherwise(0.0)).alias("likeness"),
    )


def browse(members: DataFrame, view: str = "all", query: str = "", least: int = 2, sort: str = "savings") -> tuple[DataFrame, list[Column]]:
    """The groups of a view whose files' names or paths hold ``query`` (whatever the case), and the order in which they are listed."""
    flags = group_flags(members)
    kept = flags.where(VIEWS[view]) if view == "resolved" else flags.where(f"not resolved and files >= {int(least)}").where(VIEWS[view])
    if query.strip():
        hit = members.where(F.contains(F.lower("path"), F.lit(query.strip().lower()))).select("group_id").distinct()
        kept = kept.join(hit, "group_id", "left_semi")
    kept = kept.join(first_members(members), "group_id", "left")
    key = F.col(SORTS[sort])
    return kept, [key.desc() if sort in ("savings", "count", "unit_size", "similarity") else key.asc(), F.col("group_id").asc()]


def apply_actions(members: DataFrame, actions: DataFrame) -> DataFrame:
    """``members`` with the decisions, reviewed and ignored flags that ``actions`` (group_id, action, selected: array of file ids) leave; groups without action stay as they are.

    keep_selected keeps the selected files and deletes the others, but does
    nothing if no member of the group is selected; keep_all keeps all; ignore marks all as reviewed and
    the group as ignored; clear makes all undecided and the group not ignored.
    """
    of = actions.groupBy("group_id").agg(F.max(F.struct("action", "selected")).alias("_a")).select("group_id", F.col("_a.action").alias("_action"), F.col("_a.selected").alias("_selected"))
    acted = members.join(of, "group_id", "left").withColumn("_chosen", _is(F.array_contains("_selected", F.col("file_id"))))
    any_chosen = acted.where("_action = 'keep_selected'").groupBy("group_id").agg(F.some("_chosen").alias("_any"))
    acted = acted.join(any_chosen, "group_id", "left")
    selects = (F.col("_action") == "keep_selected") & _is(F.col("_any"))
    decision = F.when(selects, F.when(F.col("_chosen"), "keep").otherwise("delete")).when(F.col("_action") == "keep_all", "keep").when(F.col("_action") == "clear", "undecided").otherwise(F.col("decision"))
    ignored = F.when(F.col("_action") == "ignore", True).when(F.col("_action") == "clear", False).otherwise(F.col("ignored"))
    out = acted.withColumns({"decision": decision, "reviewed": F.when(F.col("_action") == "ignore", True).otherwise(F.col("reviewed")), "ignored": ignored})
    return out.select(*members.columns)


def drop_deleted(members: DataFrame) -> DataFrame:
    """The members that are still there, of groups that keep two or more."""
    left = members.where(~_is(F.col("deleted")))
    whole = left.groupBy("group_id").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2").select("group_id")
    return left.join(whole, "group_id", "left_semi")


def preflight(marked: DataFrame, disk: DataFrame) -> DataFrame:
    """``marked`` (path, size, ...) with ``warning``: why a file will be left alone, or null.

    ``disk`` is a fresh scan: path, size, is_folder, is_link. A file is
    'missing', a 'folder', a 'link' (only the link goes), or its 'size_changed'.
    """
    now = disk.where("path is not null").groupBy("path").agg(F.max(F.struct(F.col("size").alias("_size"), F.col("is_folder").alias("_folder"), F.col("is_link").alias("_link"))).alias("_r")).select("path", "_r.*", F.lit(True).alias("_there"))
    seen = marked.join(now, "path", "left")
    warning = F.when(F.col("_there").isNull(), "missing").when(_is(F.col("_folder")), "folder").when(_is(F.col("_link")), "link").when(~F.col("_size").eqNullSafe(F.col("size")), "size_changed")
    return seen.withColumn("warning", warning).select(*marked.columns, "warning")


def marked_files(members: DataFrame) -> DataFrame:
    """The members that are to be deleted, are there, and aren't in an ignored group."""
    return members.where(_is(F.col("decision") == "delete") & ~_is(F.col("deleted")) & ~_is(F.col("ignored")))


def emptied_groups(members: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """(group_id): groups of which nothing would be left.

    Without ``chosen`` those in which files are marked and which aren't ignored; else those of an explicit list (group_id, file_id),
    whose files go as well as all marked ones.
    """
    gone = _is(F.col("decision") == "delete")
    if chosen is None:
        held = members.groupBy("group_id").agg(F.count_if(gone & ~_is(F.col("deleted"))).alias("n"), F.count_if(~gone & ~_is(F.col("deleted"))).alias("left"), F.some(_is(F.col("ignored"))).alias("ignored"))
        return held.where("n > 0 and left = 0 and not ignored").select("group_id")
    listed = members.join(chosen.select("group_id", "file_id").distinct().withColumn("_listed", F.lit(True)), ["group_id", "file_id"], "left").where(~_is(F.col("deleted")))
    held = listed.groupBy("group_id").agg(F.count_if(_is(F.col("_listed"))).alias("n"), F.count_if(~gone & ~_is(F.col("_listed"))).alias("left"))
    return held.where("n > 0 and left = 0").select("group_id")


def operation_entries(plans: DataFrame, outcomes: DataFrame, action: str) -> DataFrame:
    """(path, action, result, detail, size): what goes into the log for the outcomes (source_path, dest_path, ok, error, size) of plans (source_path, duplicate_of, size).

    Every outcome is logged, failed ones too; one whose plan isn't known keeps its own size. Deleted sources (no dest_path) name what they are copies of.
    """
    known = plans.where("source_path is not null").groupBy("source_path").agg(F.max(F.struct("duplicate_of", F.col("size").alias("plan_size"))).alias("_p")).select("source_path", "_p.*")
    both = salted_join(known, outcomes, ["source_path"], how="right")
    detail = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("dest_path").isNull(), F.concat(F.lit("already there as "), F.coalesce("duplicate_of", F.lit("?")))).otherwise(F.concat("source_path", F.lit(" > "), "dest_path"))
    return both.select(F.coalesce("dest_path", "source_path").alias("path"), F.when(F.col("dest_path").isNull() & _is(F.col("ok")), f"{action}-copy").otherwise(action).alias("action"), F.when(_is(F.col("ok")), "ok").otherwise("error").alias("result"), detail.alias("detail"), F.coalesce(F.nullif("size", F.lit(0)), "plan_size").alias("size"))


def moves_in_two_steps(plans: DataFrame) -> DataFrame:
    """(file_id, old, new, step): renames in place, 'aside' where the new name is another file's old one (a swap or a chain, which needs a temporary name), else 'direct'.

    ``plans`` has file_id, old, new (paths); what keeps its name has no step and null new names are left out.
    """
    moving = plans.where("new is not null and old <> new").select("file_id", "old", "new")
    held = moving.select(F.lower("old").alias("_at")).distinct()
    hit = moving.withColumn("_at", F.lower("new")).join(held.withColumn("_taken", F.lit(True)), "_at", "left")
    return hit.select("file_id", "old", "new", F.when(_is(F.col("_taken")) & (F.lower("old") != F.lower("new")), "aside").otherwise("direct").alias("step"))
