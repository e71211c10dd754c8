"""Scans of index files, corpus metadata, file listings and benchmark sets; index and diff sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from . import bundles

INDEX_SCHEMA = "image string, tokens string"

# Readable image extensions and name parts that mark by-products.
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "pdf"]
IMAGE_EXCLUSIONS = ["_teaser", "_debug", "_staff", "_tesseract"]


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Headerless `image,tokens` lines; the schema is fixed, so there is no inference pass."""
    return spark.read.schema(INDEX_SCHEMA).csv(path)


def parse_index(line: Column) -> Column:
    return F.from_csv(line, F.lit(INDEX_SCHEMA))


def write_index(samples: DataFrame, path: str, **options: object) -> None:
    """Index lines of the complete samples, appended to a text bundle by image."""
    complete = samples.where("image is not null and tokens is not null")
    bundles.write(complete, path, "image", F.lit(0), F.to_csv(F.struct("image", "tokens")), **options)


def read_index_bundle(spark: SparkSession, path: str) -> DataFrame:
    return bundles.read(spark, path).where("error IS NULL").select(parse_index(F.col("value")).alias("_i")).select("_i.*")


def read_metadata(spark: SparkSession, path: str, max_tracks: int, max_complexity: int) -> DataFrame:
    """Corpus metadata CSV, all strings; rows with bad numbers or without both flags drop out."""
    rows = spark.read.option("header", True).csv(path)
    return usable_metadata(rows, max_tracks, max_complexity)


def usable_metadata(rows: DataFrame, max_tracks: int, max_complexity: int) -> DataFrame:
    tracks, complexity = F.col("n_tracks").try_cast("int"), F.col("complexity").try_cast("int")
    return (
        rows.where("`subset:all_valid` = 'True' and `subset:no_license_conflict` = 'True'")
        .where((tracks <= max_tracks) & (complexity <= max_complexity))
        .withColumn("n_tracks", tracks)
        .withColumn("complexity", complexity)
    )


def is_input_image(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    wanted = path.rlike(r"\.(" + "|".join(IMAGE_EXTENSIONS + [e.upper() for e in IMAGE_EXTENSIONS]) + ")$")
    unwanted = name.contains(IMAGE_EXCLUSIONS[0])
    for part in IMAGE_EXCLUSIONS[1:]:
        unwanted = unwanted | name.contains(part)
    return wanted & ~unwanted


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """Recursive listing; `content` is never read because only the path is selected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    return files.where(is_input_image(F.col("path"))).orderBy("path")


def with_kern_header(kern: Column) -> Column:
    """Prepend `**kern` per spine when the first real line lacks an exclusive interpretation."""
    lines = F.filter(F.split(kern, "\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("!"))
    first = F.element_at(lines, 1)
    spines = F.size(F.split(first, "\t"))
    header = F.array_join(F.array_repeat(F.lit("**kern"), spines), "\t")
    needs = (F.size(lines) > 0) & ~F.trim(first).startswith("**")
    return F.when(needs, F.concat(header, F.lit("\n"), kern)).otherwise(kern)


def joined_regions(regions: Column) -> Column:
    return F.array_join(F.filter(regions, lambda r: r != ""), "\n")


def export_diff(samples: DataFrame, path: str, **options: object) -> None:
    """Expected and actual text of every sample as a text bundle, named `sample/side.ext` by the sniffed format. Empty texts
    are left out."""
    actual_ext = F.when(X.is_kern(F.col("actual_text")), F.lit("krn")).otherwise(F.lit("musicxml"))
    sides = F.array(
        F.struct(F.lit("expected").alias("side"), F.col("kern_text").alias("value"), F.lit("krn").alias("ext")),
        F.struct(F.lit("actual").alias("side"), F.col("actual_text").alias("value"), actual_ext.alias("ext")),
    )
    rows = samples.select("sample_id", F.explode(sides).alias("_s")).select("sample_id", "_s.*").where("value <> ''")
    name = F.concat(F.col("sample_id").cast("string"), F.lit("/"), "side", F.lit("."), "ext")
    bundles.write(rows, path, name, F.lit(0), "value", **options)


def read_diff(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, side, content, extension) of an exported bundle."""
    part = [F.regexp_extract("entry", r"(?s)^(.*)/([^/.]*)\.([^.]*)$", i) for i in (1, 2, 3)]
    return bundles.read(spark, path).where("error IS NULL").select(part[0].alias("sample_id"), part[1].alias("side"), F.col("value").alias("content"), part[2].alias("extension"))


def companion_files(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Pair image and label files by stem; rendered `-pre.jpg` outputs and names with commas are skipped."""
    usable = images.where(~F.col("path").contains("-pre.jpg") & ~F.col("path").contains(","))
    stem = F.regexp_replace("path", r"(_distorted\.jpg|\.jpg|\.jpeg|\.png)", "")
    left = usable.select(F.col("path").alias("image"), stem.alias("stem"))
    right = labels.select(F.col("path").alias("label"), F.regexp_replace("path", r"\.semantic", "").alias("stem"))
    return left.join(right, "stem").select("image", "label")
