"""Compressed scores: the score inside a zip container."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as TY

#: Archives taken out of a batch at a time.
TAKEN = 64


def _score(content: bytes) -> dict:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            names = [n for n in archive.namelist() if n.endswith(".xml")]
            top = [n for n in names if "/" not in n] or names
            if not top:
                return {"text": None, "error": "no score in archive"}
            return {"text": archive.read(top[0]).decode("utf-8"), "error": None}
    except Exception as exc:  # a broken file is a row, not a failed job
        return {"text": None, "error": f"{type(exc).__name__}: {exc}"}


@F.arrow_udf(TY.StructType([TY.StructField("text", TY.StringType()), TY.StructField("error", TY.StringType())]))
def unpack_score(content: pa.Array) -> pa.Array:
    """A few archives at a time become Python values, however many a batch holds."""
    kind = pa.struct([("text", pa.string()), ("error", pa.string())])
    pieces = [pa.array([_score(c) for c in content.slice(start, TAKEN).to_pylist()], kind) for start in range(0, len(content), TAKEN)]
    return pa.concat_arrays(pieces) if pieces else pa.array([], kind)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(score, text, error): the first top-level .xml member, else the first .xml anywhere."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mxl").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("score"), unpack_score("content").alias("_s")).select("score", "_s.*")
