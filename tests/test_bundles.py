"""Text bundles: round trips, commit and abort, planning, pruning, damaged lines."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from scorespark.sources import bundles

ROWS = "name string, n bigint, text string"


def files(path):
    return sorted(f for f in glob.glob(f"{path}/**/*.txt", recursive=True))


def test_round_trip(spark, tmp_path):
    rows = [("a", 0, "x y"), ("a", 1, "tab\tback\\slash\nnew\r\\n"), ("b\tc", 7, ""), ("é日", 2, "ü" * 5000), ("", 3, "empty name"), ("a", 1, "tab\tback\\slash\nnew\r\\n")]
    path = str(tmp_path / "store")
    bundles.write(spark.createDataFrame([*rows, (None, 1, "no name"), ("z", 1, None)], ROWS), path, "name", "n", "text", buckets=4)
    found = bundles.read(spark, path).collect()
    assert sorted((r["entry"], r["number"], r["value"]) for r in found) == sorted(rows)
    assert {r["error"] for r in found} == {None}
    assert {os.path.basename(os.path.dirname(f)) for f in files(path)} <= {f"bucket={k:05d}-of-00004" for k in range(4)}


def test_append_overwrite_and_empty(spark, tmp_path):
    path = str(tmp_path / "store")
    one = spark.createDataFrame([("a", 0, "x")], ROWS)
    bundles.write(one, path, "name", "n", "text")
    bundles.write(one, path, "name", "n", "text")
    assert bundles.read(spark, path).count() == 2
    bundles.write(one, path, "name", "n", "text", mode="overwrite")
    assert bundles.read(spark, path).count() == 1
    bundles.write(one.where("false"), path, "name", "n", "text", mode="overwrite")
    assert bundles.read(spark, path).count() == 0


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    good = spark.createDataFrame([("a", 0, "kept")], ROWS)
    bundles.write(good, path, "name", "n", "text")
    before = sorted(os.listdir(path))
    rows = spark.range(2000).select(F.col("id").cast("string").alias("name"), "id", F.when(F.col("id") == 1500, F.raise_error(F.lit("broken row"))).otherwise(F.lit("x")).alias("text"))
    with pytest.raises(Exception, match="broken row"):
        bundles.write(rows, path, "name", "id", "text")
    assert sorted(os.listdir(path)) == before
    assert [r["value"] for r in bundles.read(spark, path).collect()] == ["kept"]


def test_files_that_no_task_reported_are_not_committed(tmp_path):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"bucket": pa.array([0, 0, 1], pa.int32()), "entry": ["a", "b", "c"], "number": [0, 0, 0], "value": ["x", "y", "z"]})
    writer = bundles.BundleWriter(str(tmp_path), 2, False)
    first, _lost = writer.write(iter([batch])), writer.write(iter([batch]))
    assert len(files(str(tmp_path))) == 4
    writer.commit([first, None])
    assert len(files(str(tmp_path))) == 2 and not [n for n in os.listdir(tmp_path) if n.startswith("_staging")]
    other = bundles.BundleWriter(str(tmp_path), 2, False)
    other.write(iter([batch]))
    other.abort([None])
    assert len(files(str(tmp_path))) == 2 and len(os.listdir(tmp_path)) == 1


@pytest.mark.parametrize("split", [1, 7, 50, 1 << 20])
def test_byte_ranges_return_every_line_once(tmp_path, split):
    lines = [f"e{n}\t{n}\t{'v' * (n % 9)}" for n in range(60)]
    folder = tmp_path / "written-x" / "bucket=00000-of-00001"
    folder.mkdir(parents=True)
    (folder / "a.txt").write_text("\n".join(lines) + "\n")
    (folder / "b.txt").write_text("last\t0\tno line end")
    reader = bundles.BundleReader(str(tmp_path), split)
    ranges = reader.partitions()
    found = [r for p in ranges for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(f"{r['entry']}\t{r['number']}\t{r['value']}" for r in found) == sorted([*lines, "last\t0\tno line end"])
    assert len(ranges) > 1 or split == 1 << 20


def test_named_entries_prune_buckets(spark, tmp_path):
    path = str(tmp_path / "store")
    bundles.write(spark.range(400).select(F.col("id").cast("string").alias("name"), "id", F.lit("x").alias("text")), path, "name", "id", "text", buckets=16)
    found = bundles.read(spark, path).where(F.col("entry").isin("7", "8"))
    assert sorted(r["entry"] for r in found.collect()) == ["7", "8"]
    reader = bundles.BundleReader(path, 1)
    assert list(reader.pushFilters([bundles.EqualTo(("entry",), "7"), bundles.EqualTo(("number",), 7)])) == [bundles.EqualTo(("number",), 7)]
    wanted = f"bucket={bundles.bucket_of('7', 16):05d}-"
    assert reader.partitions() and all(wanted in p[0] for r in reader.partitions() for p in r.pieces)


def test_damaged_lines_are_rows(spark, tmp_path):
    folder = tmp_path / "written-x" / "bucket=00000-of-00001"
    folder.mkdir(parents=True)
    (folder / "a.txt").write_bytes(b"good\t1\tline\nonly one field\nbad\tnumber\tx\n\xff\xfe\t1\tx\nodd\t1\tesc\\q\n")
    found = bundles.read(spark, str(tmp_path)).collect()
    assert [(r["entry"], r["value"]) for r in found if r["error"] is None] == [("good", "line")]
    assert sorted(r["error"].split(":")[0] for r in found if r["error"]) == ["KeyError", "UnicodeDecodeError", "ValueError", "ValueError"]
