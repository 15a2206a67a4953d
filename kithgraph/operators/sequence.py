"""Slideshow sequences: story types, captions, beats, timelines, for many albums at once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ORDER = ("date_taken", "image_id")


def in_album(*order: str) -> W:
    return W.partitionBy("album_id").orderBy(*(order or ORDER))


def story_type(count: Column, days: Column, places: Column) -> Column:
    return F.when((days <= 1) & (count >= 5), "CELEBRATION").when((days > 2) & (places >= 2), "TRAVEL").when(days > 30, "MEMORIES").when(count <= 5, "SOCIAL").otherwise("MEMORIES")


def story_profile(images: DataFrame) -> DataFrame:
    out = images.groupBy("album_id").agg(F.count("*").alias("n"), F.date_diff(F.max("date_taken"), F.min("date_taken")).alias("days"), F.count_distinct("place_name").alias("places"))
    return out.withColumn("story", story_type(F.col("n"), F.col("days"), F.col("places")))


def caption(style: str = "FULL", taken: str = "date_taken", place: str = "place_name") -> Column:
    """What an image's date and place say in a style; what is missing is left out."""
    friendly, none = F.date_format(taken, "MMMM d, yyyy"), F.lit("")
    return {
        "FULL": F.concat_ws(" • ", place, friendly),
        "DATE_ONLY": F.coalesce(friendly, none),
        "LOCATION_ONLY": F.coalesce(place, none),
        "MINIMAL": F.coalesce(F.date_format(taken, "MMM yyyy"), none),
    }[style]


def smart_captions(images: DataFrame, style: str = "FULL") -> DataFrame:
    """The style's caption on the first image, where the day changes and after an image without a date; within a day the place (FULL) or nothing."""
    day, before = F.to_date("date_taken"), F.lag(F.to_date("date_taken")).over(in_album())
    within = F.coalesce("place_name", F.lit("")) if style == "FULL" else F.lit("")
    return images.select("image_id", F.when(before.isNull() | ~day.eqNullSafe(before), caption(style)).otherwise(within).alias("caption"))


def place_changes(images: DataFrame) -> DataFrame:
    """Images whose place is known and differs from the last known place before them."""
    last = F.last("place_name", ignorenulls=True).over(in_album().rowsBetween(W.unboundedPreceding, -1))
    marked = images.withColumn("_last", last)
    return marked.filter(F.col("place_name").isNotNull() & (F.col("_last").isNull() | (F.col("_last") != F.col("place_name")))).select("image_id", "place_name")


def story_captions(images: DataFrame) -> DataFrame:
    """album_id, place, style (TITLE, CAPTION) and caption of the images that carry one in their album's story."""
    placed = images.withColumn("place", F.row_number().over(in_album()) - 1).join(story_profile(images).select("album_id", "story"), "album_id")
    travel, year = F.coalesce(F.concat(F.lit("Adventures in "), "place_name"), F.lit("Travel Memories")), F.coalesce(F.concat(F.lit("Memories of "), F.year("date_taken").cast("string")), F.lit("Celebration"))
    text = F.when(F.col("story") == "TRAVEL", travel).when(F.col("story") == "CELEBRATION", year).otherwise("Our Memories")
    titles = placed.filter("place = 0 AND story <> 'SOCIAL'").select("album_id", "place", F.lit("TITLE").alias("style"), text.alias("caption"))
    changes = place_changes(images).select("image_id").distinct()
    places = placed.filter("story = 'TRAVEL'").join(changes, "image_id", "left_semi")
    return titles.unionByName(places.select("album_id", "place", F.lit("CAPTION").alias("style"), F.col("place_name").alias("caption")))


def rms_energy(samples: DataFrame, window_ms: int = 50) -> DataFrame:
    at = (F.floor(F.col("t_ms") / window_ms) * window_ms).alias("t_ms")
    return samples.groupBy("track_id", at).agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("energy"))


def thinned(rows: DataFrame, key: str, gap: int, *order: str) -> DataFrame:
    """The first row of each key, then each at least gap ms after the last one kept; order begins with t_ms.

    A row that long after the one before it is kept whatever came earlier, so a key is cut there into runs. Runs are dealt
    over all tasks, and a task streams its runs in order: neither a key nor a run is ever held whole.
    """
    own = W.partitionBy(key).orderBy(*order)
    first = F.coalesce(F.col("t_ms") - F.lag("t_ms").over(own) >= gap, F.lit(True))
    runs = rows.withColumn("_first", first).withColumn("_run", F.sum(F.col("_first").cast("long")).over(own))
    columns, schema = rows.columns, rows.schema
    dealt = runs.repartition(key, "_run").sortWithinPartitions(key, "_run", *order)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = 0
        for batch in batches:
            kept = []
            for begins, t in zip(batch["_first"].tolist(), batch["t_ms"].tolist(), strict=True):
                kept.append(begins or t - last >= gap)
                last = t if kept[-1] else last
            yield batch.loc[kept, columns]

    return dealt.mapInPandas(keep, schema)


def detect_beats(energy: DataFrame, sensitivity: float = 1.0, gap: int = 300) -> DataFrame:
    """Beats of each track: peaks above 1.5 times the mean, divided by sensitivity, more than gap ms apart."""
    mean = F.avg("energy").over(W.partitionBy("track_id"))
    peaks = energy.withColumn("_mean", mean).filter(F.col("energy") > F.col("_mean") * 1.5 / sensitivity)
    return thinned(peaks.select("track_id", "t_ms"), "track_id", gap + 1, "t_ms")


def tempo(beats: DataFrame) -> DataFrame:
    """Beats a minute from the mean gap, 120 without one."""
    out = beats.groupBy("track_id").agg(F.count("*").alias("n"), ((F.max("t_ms") - F.min("t_ms")) / (F.count("*") - 1)).alias("_gap"))
    return out.select("track_id", "n", F.when(F.col("n") > 1, 60000 / F.col("_gap")).otherwise(120.0).alias("bpm"))


def even_beats(tracks: DataFrame) -> DataFrame:
    """tracks (track_id, bpm, duration_ms) to a beat each whole step before the end."""
    step = F.floor(60000 / F.col("bpm"))
    return tracks.select("track_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("duration_ms") - 1, step)).alias("t_ms"))


def beat_durations(images: DataFrame, beats: DataFrame, ends: DataFrame) -> DataFrame:
    """Seconds each image stays, from beat to beat; images are numbered from 0 as pos; 2 s without beats."""
    numbered = beats.withColumn("_i", F.row_number().over(W.partitionBy("track_id").orderBy("t_ms")) - 1)
    counts = beats.groupBy("track_id").agg(F.count("*").alias("_beats"))
    sizes = images.groupBy("album_id").agg(F.count("*").alias("_images"))
    own = images.join(sizes, "album_id").join(counts, images.album_id == counts.track_id, "left").drop("track_id").join(ends, images.album_id == ends.track_id, "left").drop("track_id")
    each = F.greatest(F.col("_beats") / F.col("_images"), F.lit(1.0))
    at = lambda place: F.least(F.floor(place * each), F.col("_beats") - 1)
    own = own.withColumn("_from", at(F.col("pos"))).withColumn("_to", at(F.col("pos") + 1))
    first = numbered.select(F.col("track_id").alias("album_id"), F.col("_i").alias("_from"), F.col("t_ms").alias("_begin"))
    last = numbered.select(F.col("track_id").alias("album_id"), F.col("_i").alias("_to"), F.col("t_ms").alias("_end"))
    both = own.join(first, ["album_id", "_from"], "left").join(last, ["album_id", "_to"], "left")
    end = F.when(F.col("_to") < F.col("_beats") - 1, F.col("_end")).otherwise(F.col("end_ms"))
    seconds = F.least(F.greatest((end - F.col("_begin")) / 1000, F.lit(0.5)), F.lit(5.0))
    return both.select("album_id", "image_id", F.when(F.col("_beats").isNull(), 2.0).otherwise(seconds).alias("seconds"))


def timeline(images: DataFrame, default: float = 2.0) -> DataFrame:
    """Start and end of each image by the running sum of durations."""
    own = F.coalesce("duration_s", F.lit(default))
    start = F.coalesce(F.sum(own).over(in_album().rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return images.select("album_id", "image_id", F.round(start, 4).alias("start_s"), F.round(start + own, 4).alias("end_s"))


def frame_plan(images: DataFrame, fps: int, tail: float = 0.2) -> DataFrame:
    """A row for each frame; the last fifth of an image's frames is its transition."""
    frames = F.floor(F.col("seconds") * fps)
    cut = frames - F.floor(frames * tail)
    out = images.select("image_id", frames.alias("_n"), cut.alias("_cut"), F.explode(F.sequence(F.lit(0).cast("long"), frames - 1)).alias("frame"))
    progress = F.when(F.col("frame") >= F.col("_cut"), (F.col("frame") - F.col("_cut")) / (F.col("_n") - F.col("_cut"))).otherwise(0.0)
    return out.select("image_id", "frame", F.round(progress, 6).alias("progress"), (F.floor(F.col("frame") * 1_000_000 / fps)).alias("at_us"))


def sessions(events: DataFrame, gap: str = "1 HOUR") -> DataFrame:
    """session number of each row of an album: a new one after a gap."""
    before = F.lag("date_taken").over(in_album())
    new = (before.isNull() | (F.col("date_taken") > before + F.expr(f"INTERVAL {gap}"))).cast("int")
    return events.withColumn("_new", new).withColumn("session", F.sum("_new").over(in_album())).drop("_new")


def throttle(events: DataFrame, ms: int) -> DataFrame:
    """The first event of an album, then each that comes at least ms after the last one kept."""
    return thinned(events.select("album_id", "image_id", "t_ms"), "album_id", ms, "t_ms", "image_id").select("image_id")


def debounce(events: DataFrame, ms: int) -> DataFrame:
    """Events that no other follows within ms."""
    after = F.lead("t_ms").over(in_album("t_ms", "image_id"))
    return events.withColumn("_after", after).filter(F.col("_after").isNull() | (F.col("_after") - F.col("t_ms") > ms)).drop("_after")


def distinct_until_changed(events: DataFrame, value: str) -> DataFrame:
    before = F.lag(value).over(in_album())
    first = F.row_number().over(in_album()) == 1
    return events.withColumn("_keep", first | ~F.col(value).eqNullSafe(before)).filter("_keep").drop("_keep")
