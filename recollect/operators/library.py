"""Photo and video libraries as frames: what ingest writes for each item, in one pass over a table of items.

Every item gives a root and its parts.  Ids are dense in order of item and part, so a part's root is found by its
place, and a new root supersedes the item's previous one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.operators import media
from recollect.sources.frames import in_runs, placed

# Kinds of frames.
PHOTO = {"root": "photo.root", "caption": "photo.caption.short", "tags": "photo.tags", "summary": "photo.ocr.summary", "block": "photo.ocr.block", "region": "photo.region"}
VIDEO = {"root": "video.root", "segment": "video.segment"}
MOST_BLOCKS, MOST_LINES, MOST_REGIONS = 64, 32, 4


def searchable_photo(kind: Column) -> Column:
    """Kinds that photo search reads; blocks are only found through their summary."""
    return kind.isin([v for k, v in PHOTO.items() if k != "block"])


def merged_metadata(user: Column, derived: Column) -> Column:
    """Both maps in one; the user's entry counts where both have a key."""
    more = F.map_filter(derived, lambda k, _: ~F.array_contains(F.map_keys(user), k))
    return F.when(user.isNull(), derived).when(derived.isNull(), user).otherwise(F.map_concat(user, more))


def _part(kind: str, content: Column, search: Column, metadata: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), content.cast("string").alias("content"), search.cast("string").alias("search_text"), metadata.alias("metadata"))


def photo_frames(photos: DataFrame, base: int = 0) -> DataFrame:
    """frame_id, asset_id, kind, parent_id, content, search_text, ts_ms, metadata of photos.

    ``photos`` has asset_id, captured_ms, is_local, caption, tags, blocks (array of confidence, text) and metadata.  A
    photo that isn't on this device has a root only.  Only captions, tags and the summary of its text are indexed.
    """
    nothing = F.lit(None).cast("string")
    summary = F.array_join(media.recognized_lines(F.col("blocks"), MOST_LINES), "\n")
    # Photos are sorted before their parts are made; a generator, so that both columns are made once for each.
    once = F.inline(F.array(F.struct(_about().alias("about"), summary.alias("summary"))))
    single = [_part(PHOTO["root"], nothing, nothing, F.col("about")), *[F.when(F.coalesce(c, F.lit("")) != "", _part(PHOTO[k], c, c, F.col("about"))) for k, c in (("caption", F.col("caption")), ("tags", F.col("tags")), ("summary", F.col("summary")))]]
    each = F.transform(F.slice(F.coalesce("blocks", F.array()), 1, MOST_BLOCKS), lambda b: _part(PHOTO["block"], b["text"], nothing, F.map_concat(F.col("about"), F.create_map(F.lit("confidence"), b["confidence"].cast("string")))))
    parts = F.when(F.col("is_local"), F.concat(F.array_compact(F.array(*single)), each)).otherwise(F.array(single[0]))
    each = in_runs(photos, "asset_id").select("asset_id", "captured_ms", "is_local", "caption", "tags", "blocks", once)
    made = placed(each.select("asset_id", F.col("captured_ms").alias("ts_ms"), F.posexplode(parts).alias("part", "p")).select("asset_id", "part", "ts_ms", "p.*"), base)
    return made.select("frame_id", "asset_id", "kind", _parent(), "content", "search_text", "ts_ms", "metadata")


def _about() -> Column:
    return merged_metadata(F.col("metadata"), F.create_map(F.lit("asset_id"), F.col("asset_id").cast("string"), F.lit("is_local"), F.col("is_local").cast("string")))


def _parent() -> Column:
    return F.when(F.col("part") > 0, F.col("frame_id") - F.col("part")).alias("parent_id")


def video_frames(videos: DataFrame, pieces: DataFrame, base: int = 0, *, length_ms: int = 10_000, overlap_ms: int = 0, most: int = 360) -> DataFrame:
    """frame_id, asset_id, kind, parent_id, content, search_text, ts_ms, metadata of videos and their segments.

    ``videos`` has asset_id, captured_ms, duration_ms, is_local and metadata; ``pieces`` of transcripts asset_id,
    from_ms, to_ms and text.  Segments have their video's time; only those with text are indexed.
    """
    windows = F.when(F.col("is_local"), media.segment_windows(F.col("duration_ms"), length_ms, overlap_ms, most))
    # Ids follow from the videos alone: they are numbered with their windows, before any text is joined.
    once = F.inline(F.array(F.struct(_about().alias("about"), F.coalesce(windows, F.array()).alias("windows"))))
    each = in_runs(videos, "asset_id").select("asset_id", F.col("captured_ms").alias("ts_ms"), once)
    parts = F.concat(F.array(F.lit(None).cast("struct<index:bigint,start_ms:bigint,end_ms:bigint,mid_ms:bigint>")), F.col("windows"))
    made = placed(each.select("asset_id", "ts_ms", "about", F.size("windows").alias("windows"), F.posexplode(parts).alias("part", "s")).select("asset_id", "ts_ms", "about", "windows", "part", "s.*"), base)
    segments = made.filter("part > 0").select(F.col("asset_id").alias("video_id"), "index", "start_ms", "end_ms")
    said = media.overlap_join(segments, pieces.withColumnRenamed("asset_id", "video_id"), cell_ms=max(length_ms, 1000)).select(F.col("video_id").alias("asset_id"), "index", "transcript")
    is_root = F.col("part") == 0
    text = F.when(~is_root, F.coalesce("transcript", F.lit("")))
    place = F.map_from_arrays(F.array(*map(F.lit, ("segment_index", "segment_count", "start_ms", "end_ms", "mid_ms"))), F.array(*[F.col(c).cast("string") for c in ("index", "windows", "start_ms", "end_ms", "mid_ms")]))
    return made.join(said, ["asset_id", "index"], "left").select(
        "frame_id",
        "asset_id",
        F.when(is_root, VIDEO["root"]).otherwise(VIDEO["segment"]).alias("kind"),
        _parent(),
        text.alias("content"),
        F.when(F.regexp_replace(text, r"\s+", "") != "", text).alias("search_text"),
        "ts_ms",
        F.when(is_root, F.col("about")).otherwise(F.map_concat("about", place)).alias("metadata"),
    )


def superseding(new: DataFrame, frames: DataFrame, root_kind: str) -> DataFrame:
    """frame_id, other_id: each item's previous live root and the new one that takes its place."""
    before = media.current_roots(frames, root_kind)
    roots = new.filter(F.col("kind") == root_kind).select(F.col("asset_id").cast("string").alias("asset_id"), F.col("frame_id").alias("other_id"))
    return before.join(roots, "asset_id").select("frame_id", "other_id")


def sync_scope(items: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Items (asset_id, created_ms) that a sync takes: those asked for (asset_id), or the library from its oldest on."""
    taken = items if only is None else items.join(only.select("asset_id").distinct(), "asset_id", "left_semi")
    return taken.orderBy("created_ms", "asset_id")
