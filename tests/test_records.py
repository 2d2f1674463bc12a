"""Files in byte ranges: records and placed lines."""

import os

import pytest

from vigil.session import scratch_dir
from vigil.sources.records import LineReader, placed_lines, record_file


def folder(spark, files):
    base = scratch_dir(spark, "ranges").removeprefix("file:")
    os.makedirs(base)
    for name, content in files.items():
        with open(f"{base}/{name}", "wb") as f:
            f.write(content)
    return base


def test_records_of_split_files(spark):
    records = [bytes([i % 256]) + os.urandom(9) for i in range(1000)]
    base = folder(spark, {"a.bin": b"".join(records[:700]), "b.bin": b"".join(records[700:]), "empty.bin": b"", "_SUCCESS": b"x"})
    df = record_file(spark, base, 10, range_bytes=95)  # ranges of nine records
    assert df.rdd.getNumPartitions() > 100
    rows = sorted((r["path"], r["record"], r["label"], bytes(r["planar"])) for r in df.collect())
    assert [(label, planar) for _, _, label, planar in rows] == [(r[0], r[1:]) for r in records]
    assert [n for _, n, _, _ in rows] == [*range(700), *range(300)]
    one = record_file(spark, f"{base}/b.bin", 10, label_bytes=2)
    assert one.count() == 300 and one.first()["label"] == int.from_bytes(records[700][:2], "big")


def test_file_with_a_rest_is_rejected(spark):
    base = folder(spark, {"a.bin": b"x" * 25})
    with pytest.raises(Exception, match="not a whole number of records of 10 bytes: .*a.bin"):
        record_file(spark, base, 10).count()
    assert record_file(spark, folder(spark, {"e.bin": b""}), 10).count() == 0


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_each_line_once_with_its_place(spark, size):
    content = b"first\n\nthird line\r\n" + "é\n".encode() + b"x" * 50 + b"\nlast without end"
    base = folder(spark, {"a.txt": content})
    reader = LineReader({"path": base, "rangebytes": size})
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    rows = [(v, p) for part in parts for b in reader.read(part) for v, p in zip(b.column(0).to_pylist(), b.column(2).to_pylist())]
    want, at = [], 0
    for line in content.split(b"\n"):
        want.append((line.removesuffix(b"\r").decode(), at))
        at += len(line) + 1
    assert rows == want


def test_stream_resumes_after_its_place(spark):
    base = folder(spark, {"a.txt": b"1\n2\n"})
    out, got = scratch_dir(spark, "ranges-out"), []

    def run():
        q = placed_lines(spark, base).writeStream.foreachBatch(lambda b, i: got.append(sorted(tuple(r) for r in b.collect()))).option("checkpointLocation", out).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    run()  # nothing new
    with open(f"{base}/b.txt", "w") as f:
        f.write("3\n4")
    run()
    assert [[(v, p) for v, _, p in b] for b in got if b] == [[("1", 0), ("2", 2)], [("3", 0), ("4", 2)]]
    assert {f.rsplit("/", 1)[1] for b in got for _, f, _ in b} == {"a.txt", "b.txt"}
