"""Folders of recordings with their truth, one for each recording, as rows: what is there, what is missing, what is broken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .notation import _headed, catalog

#: Names of a folder's files, the first that is there holds, and the fields of its description.
RECORDINGS = tuple(f"recording.{kind}" for kind in ("m4a", "wav", "mp3", "flac", "ogg"))
TRUTHS = tuple(f"expected.{kind}" for kind in ("abc", "musicxml", "xml"))
META = "key string, meter string, tempo_bpm double, form string"


def _first(names: tuple[str, ...]) -> Column:
    """The path of the first of names that a folder has."""
    place = F.array_position(F.array(*map(F.lit, names)), F.col("name"))
    return F.min_by("path", F.when(place > 0, place))


def dataset_folders(spark: SparkSession, root: str) -> DataFrame:
    """root/<slug>/ with a recording, the truth and perhaps meta.json to rows: slug, recording and truth (paths), text (of a truth in ABC notation), meta (null: none, or broken), missing ("recording", "truth"), broken ("meta").

    Files are listed and read by Spark, wherever root is; recordings aren't opened. A folder with parts missing is a row
    like any other, so that nothing is left out unseen; files of other names are.
    """
    parts = F.split("path", "/")
    under = lambda rows: rows.withColumns({"slug": F.url_decode(F.element_at(parts, -2)), "name": F.element_at(parts, -1)})
    files = under(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path"))
    named = files.where(F.col("name").isin(*RECORDINGS, *TRUTHS, "meta.json"))
    held = named.groupBy("slug").agg(_first(RECORDINGS).alias("recording"), _first(TRUTHS).alias("truth"), F.max((F.col("name") == "meta.json").cast("int")).alias("described"))
    read = lambda name: under(spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(root, wholetext=True).select("value", F.input_file_name().alias("path"))).groupBy("slug").agg(F.min("value").alias("value"))
    meta = read("meta.json").select("slug", F.from_json("value", META + ", broken string", {"columnNameOfCorruptRecord": "broken"}).alias("said"))
    found = held.join(read("expected.abc").withColumnRenamed("value", "text"), "slug", "left").join(meta, "slug", "left")
    broken = (F.col("described") == 1) & (F.col("said").isNull() | F.col("said.broken").isNotNull())
    gone = lambda c, name: F.when(F.col(c).isNull(), F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    plain = F.when(~broken, F.struct(*(F.col(f"said.{c}").alias(c) for c in ("key", "meter", "tempo_bpm", "form"))))
    return found.select("slug", "recording", "truth", F.when(F.col("truth").endswith(".abc"), F.col("text")).alias("text"), F.when(F.col("described") == 1, plain).alias("meta"), F.concat(gone("recording", "recording"), gone("truth", "truth")).alias("missing"), F.when(broken, F.array(F.lit("meta"))).otherwise(F.array().cast("array<string>")).alias("broken"))


def dataset_truth(folders: DataFrame) -> DataFrame:
    """What scoring compares with, of folders with a truth in notation: slug, key, meter, tempo, form and told, which of them the description tells. meter is else the notation's, form its sections' names twice; key and tempo are else null. reason as in catalog()."""
    tunes = folders.where("text is not null").select(F.col("slug").alias("source"), F.lit(0).cast("long").alias("tune"), "text")
    read = catalog(tunes).select(F.col("source").alias("slug"), "sections", "reason").join(_headed(tunes).select(F.col("source").alias("slug"), F.col("meter").alias("written")), "slug")
    names = F.array_join(F.array_sort(F.transform("sections", lambda x: x["name"])), "")
    fields = {"key": "key", "meter": "meter", "tempo": "tempo_bpm", "form": "form"}
    told = F.filter(F.array(*(F.when(F.col(f"meta.{c}").isNotNull(), F.lit(k)) for k, c in fields.items())), lambda x: x.isNotNull())
    both = folders.join(read, "slug")
    return both.select("slug", F.col("meta.key").alias("key"), F.coalesce("meta.meter", "written").alias("meter"), F.col("meta.tempo_bpm").alias("tempo"), F.coalesce("meta.form", F.repeat(names, 2)).alias("form"), told.alias("told"), "reason")
