"""Text bundles: many named texts in few files, written and read through Spark's Python data source interface.

A score, page or sample is an *entry* of numbered lines. Entries are dealt by a hash of their name into buckets, one
folder each; a file holds sorted lines ``entry<TAB>number<TAB>value`` (backslash, tab and line ends escaped), so that a
corpus makes as many files as it has tasks and buckets, not one folder or file per name.

Writing is all or nothing. Tasks write below a staging folder of the write; commit deletes what no successful task
reported and moves the folder into place with one rename; abort, or a job that dies, leaves nothing that readers see.
Reading plans byte ranges of about ``split_bytes``, prunes buckets when entries are named in a filter, and returns damaged
lines as rows with an error instead of failing.

Options: ``buckets`` (writing, 32), ``split_bytes`` (reading, 64 MB). Paths are those of ``pyarrow.fs``, so the folder may be
on any file system it knows.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "text_bundle"
WRITTEN = "bucket int, entry string, number bigint, value string"
READ = "entry string, number bigint, value string, error string"
BUCKETS = 32
SPLIT_BYTES = 64 << 20
#: Lines, and bytes of them, that a reader holds before they leave; lines that a writer takes out of a batch at a time.
LINES, HELD_BYTES, TAKEN = 4096, 4 << 20, 64
#: Lines of one entry that one task writes; a longer entry spreads over several tasks, in the same bucket folder.
LINES_PER_TASK = 1 << 20

ESCAPES = {"\\": "\\\\", "\t": "\\t", "\n": "\\n", "\r": "\\r"}
PLAIN = {v[1]: k for k, v in ESCAPES.items()}


def escaped(text: str) -> str:
    return re.sub(r"[\\\t\n\r]", lambda m: ESCAPES[m[0]], text)


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: PLAIN[m[1]], text) if "\\" in text else text


def bucket_of(entry: str, buckets: int) -> int:
    return zlib.crc32(entry.encode()) % buckets


def located(path: str) -> tuple[pa.fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pa.fs.FileSystem.from_uri(path)


# ---- writing -------------------------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    files: list[str] = field(default_factory=list)
    lines: int = 0


class BundleWriter(DataSourceArrowWriter):
    def __init__(self, path: str, buckets: int, overwrite: bool):
        self.path, self.buckets, self.overwrite, self.name = path.rstrip("/"), buckets, overwrite, uuid.uuid4().hex

    @property
    def staging(self) -> str:
        return f"_staging-{self.name}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Lines in order of bucket: one open file at a time. A name of its own per attempt."""
        store, root = located(self.path)
        done, attempt, out, current = Written(), uuid.uuid4().hex, None, None
        try:
            for batch in pieces(iterator):
                get = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
                for bucket, entry, number, value in zip(get["bucket"], get["entry"], get["number"], get["value"]):
                    if bucket != current:
                        if out is not None:
                            out.close()
                        folder = f"{self.staging}/bucket={bucket:05d}-of-{self.buckets:05d}"
                        store.create_dir(f"{root}/{folder}", recursive=True)
                        current, name = bucket, f"{folder}/{attempt}-{len(done.files)}.txt"
                        out = store.open_output_stream(f"{root}/{name}")
                        done.files.append(name)
                    out.write(f"{escaped(entry)}\t{number}\t{escaped(value)}\n".encode())
                    done.lines += 1
        finally:
            if out is not None:
                out.close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        store, root = located(self.path)
        before = [f.path for f in store.get_file_info(pa.fs.FileSelector(root, allow_not_found=True)) if f.base_name.startswith("written-")]
        kept = {f for m in messages if m is not None for f in m.files}
        store.create_dir(f"{root}/{self.staging}", recursive=True)
        for found in store.get_file_info(pa.fs.FileSelector(f"{root}/{self.staging}", recursive=True)):
            if found.type == pa.fs.FileType.File and found.path[found.path.index(self.staging) :] not in kept:
                store.delete_file(found.path)  # of an attempt that failed or lost a race
        with store.open_output_stream(f"{root}/{self.staging}/_lines") as out:
            out.write(json.dumps({"files": len(kept), "lines": sum(m.lines for m in messages if m is not None)}).encode())
        store.move(f"{root}/{self.staging}", f"{root}/written-{self.name}")
        for old in before if self.overwrite else ():
            store.delete_dir(old)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = located(self.path)
        if store.get_file_info(f"{root}/{self.staging}").type != pa.fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.staging}")


# ---- reading -------------------------------------------------------------------------------------------------------


@dataclass
class Range(InputPartition):
    """Byte ranges of files: the lines that begin in them."""

    pieces: list[tuple[str, int, int]]


class BundleReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes, self.entries = path.rstrip("/"), split_bytes, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Names of entries are taken here, all else is left to Spark."""
        for f in filters:
            names = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if names is not None and f.attribute == ("entry",):
                self.entries = names if self.entries is None else self.entries & names
            else:
                yield f

    def partitions(self) -> list[Range]:
        store, root = located(self.path)
        files = []
        for found in store.get_file_info(pa.fs.FileSelector(root, recursive=True)):
            at = re.search(r"/written-[^/]*/bucket=(\d+)-of-(\d+)/[^/]*$", found.path)
            if at and found.size and (self.entries is None or int(at[1]) in {bucket_of(e, int(at[2])) for e in self.entries}):
                files.append((found.path, found.size))
        pieces = [(p, start, min(size, start + self.split_bytes)) for p, size in sorted(files) for start in range(0, size, self.split_bytes)]
        ranges, room = [Range([])], self.split_bytes
        for piece in pieces:
            size = piece[2] - piece[1]
            if ranges[-1].pieces and size > room:
                ranges.append(Range([]))
                room = self.split_bytes
            ranges[-1].pieces.append(piece)
            room -= size
        return ranges

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, _ = located(self.path)
        held: list[tuple] = []
        room = HELD_BYTES
        for path, start, end in partition.pieces:
            for line in lines_of(store, path, start, end):
                row = parsed(line)
                if self.entries is None or row[0] in self.entries:
                    held.append(row)
                    room -= len(line)
                if len(held) == LINES or room <= 0:
                    yield batch_of(held)
                    held, room = [], HELD_BYTES
        if held:
            yield batch_of(held)


def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of ``TAKEN`` rows: what a step makes Python values of at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, TAKEN):
            yield batch.slice(start, TAKEN)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    s = pa.string()
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (s, pa.int64(), s, s))], ["entry", "number", "value", "error"])


def lines_of(store: pa.fs.FileSystem, path: str, start: int, end: int, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Lines whose first byte is in [start, end)."""
    with store.open_input_file(path) as source:
        source.seek(max(start - 1, 0))
        at, rest, skip = max(start - 1, 0), b"", start > 0
        while data := source.read(chunk):
            *whole, rest = (rest + data).split(b"\n")
            for line in whole:
                begin, at = at, at + len(line) + 1
                if skip:
                    skip = False  # the line before the range ends here
                elif begin < end:
                    yield line
            if at >= end and not skip:
                return
        if rest and not skip and at < end:
            yield rest


def parsed(line: bytes) -> tuple[str | None, int | None, str | None, str | None]:
    try:
        entry, number, value = line.decode().split("\t")
        return unescaped(entry), int(number), unescaped(value), None
    except (UnicodeDecodeError, ValueError, KeyError) as error:
        return None, None, None, f"{type(error).__name__}: {line[:200].decode(errors='replace')}"


# ---- data source ---------------------------------------------------------------------------------------------------


class TextBundle(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return READ

    def reader(self, schema: StructType) -> BundleReader:
        return BundleReader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> BundleWriter:
        return BundleWriter(self.options["path"], int(self.options.get("buckets", BUCKETS)), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TextBundle)


def write(rows: DataFrame, path: str, entry: str | Column, number: str | Column, value: str | Column, buckets: int = BUCKETS, mode: str = "append") -> None:
    """Write lines as a bundle: one shuffle by bucket, sorted inside. Rows without entry or value are left out; a null
    number counts as 0."""
    register(rows.sparkSession)
    col = lambda c: F.col(c) if isinstance(c, str) else c
    lines = rows.select(
        col(entry).cast("string").alias("entry"), F.coalesce(col(number).cast("long"), F.lit(0)).alias("number"), col(value).cast("string").alias("value")
    ).where("entry IS NOT NULL AND value IS NOT NULL")
    bucketed = lines.select(F.pmod(F.crc32(F.col("entry").cast("binary")), F.lit(buckets)).cast("int").alias("bucket"), "*")
    dealt = bucketed.repartition("bucket", F.expr(f"number div {LINES_PER_TASK}")).sortWithinPartitions("bucket", "entry", "number")
    dealt.write.format(FORMAT).option("buckets", buckets).mode(mode).save(path)


def read(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(entry, number, value, error): every line of a bundle; damaged ones with an error and nothing else."""
    register(spark)
    return spark.read.format(FORMAT).option("split_bytes", split_bytes).load(path)
