"""What Python steps hold does not grow with the Arrow batch that Spark hands them."""

import tracemalloc

import pyarrow as pa

from scorespark.sources import archives, bundles, musicxml

NOTE = "<note><pitch><step>C</step><octave>4</octave></pitch><duration>4</duration><type>quarter</type></note>"


def peak(step):
    tracemalloc.start()
    n = step()
    top = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return n, top


def test_musicxml_rows_leave_in_small_batches():
    text = f"<score-partwise><part><measure>{NOTE * 40}</measure></part></score-partwise>"
    batch = lambda n: pa.RecordBatch.from_pydict({"score": list(range(n)), "text": [text] * n})
    run = lambda b: lambda: sum(out.num_rows for out in musicxml.shred(iter([b]), pa.int64()))
    (few, low), (many, high) = peak(run(batch(20))), peak(run(batch(400)))
    assert (few, many) == (20 * 41, 400 * 41) and high < 2 * low


def test_bundle_reader_and_writer_hold_little(tmp_path):
    value = "v" * 20_000
    rows = 3000
    batch = pa.RecordBatch.from_pydict({
        "bucket": pa.array([0] * rows, pa.int32()), "entry": [str(n) for n in range(rows)], "number": [0] * rows, "value": [value] * rows,
    })
    writer = bundles.BundleWriter(str(tmp_path), 1, False)
    done, top = peak(lambda: writer.write(iter([batch])))
    assert done.lines == rows and top < 10_000_000
    writer.commit([done])
    reader = bundles.BundleReader(str(tmp_path), 1 << 30)
    read, top = peak(lambda: sum(b.num_rows for b in reader.read(reader.partitions()[0])))
    assert read == rows and top < 30_000_000


def test_archives_are_taken_out_a_few_at_a_time(spark):
    import io
    import zipfile

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("score.xml", "x" * 50_000)
    content = pa.array([buffer.getvalue()] * 1000, pa.binary())
    found, top = peak(lambda: archives.unpack_score.func(content))
    assert len(found) == 1000 and found[999].as_py() == {"text": "x" * 50_000, "error": None} and top < 15_000_000
