"""Keyed reads and changes of catalogue tables, as DataFrames in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import scalars as S

#: Files that are never catalogued.
IGNORED_NAMES = (".DS_Store", "Thumbs.db", "desktop.ini", ".photothumb", ".phtcache")
CACHE_FOLDERS = ("/cache/", "/.photothumb/", "/.phtcache/")
TEMP_SUFFIXES = (".tmp", ".temp", ".partial")


def newest_first(photos: DataFrame, newest: bool = True) -> list[Column]:
    """Sort columns by effective date, then id, in one direction."""
    eff = S.effective_date()
    return [eff.desc(), F.col("id").desc()] if newest else [eff.asc(), F.col("id").asc()]


def page(photos: DataFrame, skip: int, take: int, newest: bool = True) -> DataFrame:
    """Rows ``skip`` to ``skip + take`` in order of effective date and id."""
    return photos.orderBy(*newest_first(photos, newest)).offset(skip).limit(take)


def after_id(photos: DataFrame, last_id: int, take: int) -> DataFrame:
    """The newest rows whose id is above ``last_id``."""
    return photos.where(F.col("id") > last_id).orderBy(*newest_first(photos)).limit(take)


def after_cursor(photos: DataFrame, eff, last_id: int, take: int) -> DataFrame:
    """The rows that follow ``(eff, last_id)`` in newest-first order: a cursor that skips and repeats none."""
    at = S.effective_date()
    return photos.where((at < F.lit(eff)) | ((at == F.lit(eff)) & (F.col("id") < last_id))).orderBy(*newest_first(photos)).limit(take)


def keyed_update(rows: DataFrame, updates: DataFrame, key: str, columns: list[str], order: str | None = None, keep: bool = False) -> DataFrame:
    """``rows`` with ``columns`` from ``updates`` where the key matches.

    Of several updates of one key the first by ``order`` counts. With ``keep``
    a value that is there wins and only nulls are filled. Other keys of
    ``updates`` change nothing.
    """
    new = F.struct(*[F.col(c) for c in columns])
    picked = updates.groupBy(key).agg((F.min_by(new, order) if order else F.first(new)).alias("_new"))
    out = rows.join(picked, key, "left")
    for c in columns:
        fresh, old = F.col(f"_new.{c}"), F.col(c)
        out = out.withColumn(c, F.coalesce(old, fresh) if keep else F.when(F.col("_new").isNotNull(), fresh).otherwise(old))
    return out.select(*rows.columns)


def upsert(rows: DataFrame, changes: DataFrame, key: str | list[str]) -> DataFrame:
    """``changes`` over ``rows``: matching keys are replaced, others added. Both have the same columns."""
    keys = [key] if isinstance(key, str) else key
    return rows.join(changes.select(*keys), keys, "left_anti").select(*changes.columns).unionByName(changes)


def without(rows: DataFrame, gone: DataFrame, key: str, gone_key: str | None = None) -> DataFrame:
    """``rows`` whose key is not in ``gone``: a delete, or its cascade to a child table."""
    return rows.join(gone.select(F.col(gone_key or key).alias(key)), key, "left_anti")


def fill_rate(done: Column, total: Column) -> Column:
    """Progress in percent; 0 of nothing is 0."""
    return F.when(total > 0, done * 100.0 / total).otherwise(F.lit(0.0))


def seconds_left(elapsed: Column, done: Column, total: Column) -> Column:
    """Time for the rest at the pace so far; null before anything is done."""
    return F.when(done > 0, elapsed / done * (total - done))


def marked(rows: DataFrame, chosen: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """``rows`` with ``values`` set where the key is among ``chosen``."""
    keys = chosen.select(key).distinct().withColumn("_marked", F.lit(True))
    out = rows.join(keys, key, "left")
    return out.withColumns({c: F.when(F.col("_marked"), v).otherwise(F.col(c)) for c, v in values.items()}).select(*rows.columns)


def stamped(rows: DataFrame, passed: DataFrame, key: str, column: str, at: Column) -> DataFrame:
    """``rows`` with the time ``at`` in ``column`` for all keys of ``passed``; keys that ``rows`` lacks are added."""
    new = passed.select(key).distinct().join(rows.select(key), key, "left_anti").withColumn(column, at)
    return marked(rows, passed, key, {column: at}).unionByName(new, allowMissingColumns=True)


def pending(photos: DataFrame, state: int, where: Column | None = None) -> DataFrame:
    """Photos that wait in ``state``, of all folders or of those that ``where`` picks."""
    waiting = photos.where(F.col("state") == state)
    return waiting if where is None else waiting.where(where)


def selected(rows: DataFrame, chosen: DataFrame, key: str, keep_out=None) -> DataFrame:
    """The ``chosen`` rows that are still there, without the key ``keep_out``."""
    out = rows.join(chosen.select(key), key, "left_semi")
    return out if keep_out is None else out.where(F.col(key) != F.lit(keep_out))


def merged_results(results: DataFrame, by: list[str], counters: list[str], errors: str) -> DataFrame:
    """Results added up: counters summed, error lists put together and sorted."""
    return results.groupBy(*by).agg(*[F.sum(c).alias(c) for c in counters], F.array_sort(F.flatten(F.collect_list(errors))).alias(errors))


def people_page(people: DataFrame, mode: str, take: int) -> DataFrame:
    """The first ``take`` people by name (``alphabetical``), last appearance or
    else creation (``recent``) or number of faces (``faces``); ties by id."""
    order = {"alphabetical": F.col("name").asc(), "recent": F.coalesce("last_seen", "created").desc(), "faces": F.col("n").desc()}
    by = [order[mode], F.col("person_id").asc()]
    return people.orderBy(*by).limit(take).withColumn("place", F.row_number().over(W.orderBy(*by)))  # a page is small


def placed(page: DataFrame, *columns: str) -> DataFrame:
    """A page's ``columns`` with the place from 1."""
    return page.select(*columns, "place")


def ignored_path(path: Column) -> Column:
    """Caches, temporary and hidden files, and names that are never catalogued."""
    name, low = S.file_name(path), F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    test = name.isin(*IGNORED_NAMES) | name.startswith("~$") | name.startswith(".")
    for part in CACHE_FOLDERS:
        test = test | low.contains(part)
    for end in TEMP_SUFFIXES:
        test = test | F.lower(name).endswith(end)
    return test


def search(rows: DataFrame, column: str, text: str | None) -> DataFrame:
    """Rows that contain ``text``, whatever the case; a blank text finds all."""
    return rows if not (text or "").strip() else rows.where(F.lower(column).contains(text.strip().lower()))


def watched_root(files: DataFrame, roots: DataFrame) -> DataFrame:
    """``files`` with the longest of ``roots`` (column ``root``) that their path starts with, whatever the case.

    Each folder meets its own prefixes at each separator by an equality join,
    so any number of roots will do, and each file joins its folder; a root that
    is the file's whole path is the longest there can be. Files are neither
    multiplied nor grouped.
    """
    named = roots.groupBy(F.lower("root").alias("_root")).agg(F.max("root").alias("root"))
    parts = F.split("_folder", "/")
    prefix = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    path = F.lower("file_path")
    placed = files.withColumns({"_path": path, "_folder": F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"(?s)^(.*)/", 1))})
    keyed = placed.where("_folder IS NOT NULL").select("_folder").distinct().select("_folder", F.explode(prefix).alias("_root"))
    best = keyed.join(named, "_root").groupBy("_folder").agg(F.max_by("root", F.length("_root")).alias("_inside"))
    out = placed.join(best, "_folder", "left").join(named.toDF("_path", "_itself"), "_path", "left")
    return out.withColumn("root", F.coalesce("_itself", "_inside")).select("file_path", *[c for c in files.columns if c != "file_path"], "root")


def file_diff(known: DataFrame, seen: DataFrame) -> DataFrame:
    """``(path, change)`` with change new or deleted, comparing paths whatever the case."""
    k, s = known.select(F.lower("file_path").alias("path")).distinct(), seen.select(F.lower("file_path").alias("path")).distinct()
    new = s.join(k, "path", "left_anti").withColumn("change", F.lit("new"))
    return new.unionByName(k.join(s, "path", "left_anti").withColumn("change", F.lit("deleted")))


def index_actions(known: DataFrame, seen: DataFrame) -> DataFrame:
    """``seen`` with ``action``: insert, update (size or time differ) or skip. Both have file_path, file_size, modified_utc."""
    old = known.select("file_path", F.col("file_size").alias("_size"), F.col("modified_utc").alias("_at"), F.lit(True).alias("_old"))
    same = F.col("_size").eqNullSafe(F.col("file_size")) & F.col("_at").eqNullSafe(F.col("modified_utc"))
    action = F.when(F.col("_old").isNull(), "insert").when(same, "skip").otherwise("update")
    return seen.join(old, "file_path", "left").withColumn("action", action).drop("_size", "_at", "_old")


def modified_reset(photos: DataFrame, seen: DataFrame, derived: list[str], indexed_state: int = 1) -> DataFrame:
    """``photos`` after a pass over ``seen``: where the size differs or the time does by a
    second or more, size and time are new, the state is indexed again and ``derived`` columns are null."""
    new = seen.select("file_path", F.col("file_size").alias("_size"), F.col("modified_utc").alias("_at"))
    moved = F.abs(S.micros("_at") - S.micros("modified_utc")) >= 1_000_000
    out = photos.join(new, "file_path", "left").withColumn("_changed", F.col("_size").isNotNull() & (moved | (F.col("_size") != F.col("file_size"))))
    fresh = {"file_size": F.col("_size"), "modified_utc": F.col("_at"), "state": F.lit(indexed_state)} | {c: F.lit(None) for c in derived}
    for c, v in fresh.items():
        out = out.withColumn(c, F.when(F.col("_changed"), v).otherwise(F.col(c)))
    return out.select(*photos.columns)


def renamed(photos: DataFrame, moves: DataFrame) -> DataFrame:
    """``photos`` under their new paths (``moves``: old_path, new_path); a move of an unknown file adds a row."""
    out = photos.join(moves, photos["file_path"] == moves["old_path"], "left").withColumn("file_path", F.coalesce("new_path", "file_path")).select(*photos.columns)
    fresh = moves.join(photos.select(F.col("file_path").alias("old_path")), "old_path", "left_anti").select(F.col("new_path").alias("file_path"))
    return out.unionByName(fresh, allowMissingColumns=True)


def apply_events(photos: DataFrame, events: DataFrame) -> DataFrame:
    """Paths that remain after ``events`` (batch, seq, change_type, file_path).

    Inside a batch creates come first, then deletes, then changes; a later
    batch overrules. So the last create or delete of a path decides about it,
    which one aggregation finds. Creating what exists or deleting what does
    not changes nothing.
    """
    rank = F.when(F.col("change_type") == "Created", 0).when(F.col("change_type") == "Deleted", 1).otherwise(2)
    last = events.where("change_type IN ('Created', 'Deleted')").groupBy("file_path").agg(F.max_by("change_type", F.struct("batch", rank, "seq")).alias("last"))
    known = photos.select("file_path").distinct().withColumn("_known", F.lit(True))
    both = known.join(last, "file_path", "full")
    return both.where(F.coalesce(F.col("last") == "Created", F.lit(True))).select("file_path")


def merge_people(links: DataFrame, mapping: DataFrame) -> DataFrame:
    """Person-face links after ``mapping`` (old_id, new_id); links that become equal count once."""
    out = links.join(mapping, links["person_id"] == mapping["old_id"], "left")
    return out.select(F.coalesce("new_id", "person_id").alias("person_id"), "face_id").distinct()
