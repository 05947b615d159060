import os
import random

import pytest
from pyarrow import fs

from loomline.sources import logs


class Counted:
    """A file that counts what is read of it."""

    def __init__(self, path):
        self.f, self.read = fs.LocalFileSystem().open_input_file(str(path)), 0

    def size(self):
        return self.f.size()

    def read_at(self, n, at):
        self.read += n
        return self.f.read_at(n, at)


def test_last_lines_equal_a_split_of_the_whole(tmp_path):
    rng = random.Random(1)
    for i in range(150):
        data = b"".join(rng.choice([b"", b"a", b"\xc3\xa9t", b"\r", b"long " * 9]) + b"\n" for _ in range(rng.randrange(12))) + rng.choice([b"", b"end"])
        (tmp_path / f"{i}").write_bytes(data)
        want = data.split(b"\n")
        want = want[:-1] if not want[-1] else want
        for n, empty, block in ((1, False, 3), (4, True, 1), (50, False, 7), (50, True, 64)):
            some = [x for x in want if x.rstrip(b"\r") or empty][-n:]
            got = logs.last_lines(Counted(tmp_path / f"{i}"), n, empty, block)
            assert [x for x, _ in got] == some
            assert all(data[at : at + len(x)] == x and (at == 0 or data[at - 1 : at] == b"\n") for x, at in got)


def test_ranges_of_bytes_hold_each_line_once(tmp_path):
    rng = random.Random(2)
    for i in range(60):
        data = b"".join(b"x" * rng.randrange(6) + b"\n" for _ in range(rng.randrange(15))) + b"y" * rng.randrange(3)
        (tmp_path / f"{i}").write_bytes(data)
        whole = list(logs.lines_from(Counted(tmp_path / f"{i}"), 0, len(data), 0, 4))
        assert [x for x, _ in whole] == [x for x in data.split(b"\n")[:-1]] + ([data.split(b"\n")[-1]] if data.split(b"\n")[-1] else [])
        cuts = sorted({0, len(data), *(rng.randrange(len(data) + 1) for _ in range(4))})
        parts = [r for a, b in zip(cuts, cuts[1:], strict=False) for r in logs.lines_from(Counted(tmp_path / f"{i}"), a, b, 0, 5)]
        assert parts == whole


def test_the_end_of_a_huge_log_takes_few_bytes(spark, tmp_path):
    """10 GB (a file with a hole): the last 8 lines take less than 1 MB."""
    path = tmp_path / "huge.log"
    with open(path, "wb") as f:
        f.truncate(10_000_000_000)
        f.seek(0, os.SEEK_END)
        f.write(b"\n" + b"".join(b"line %d\n\n" % i for i in range(20)))
    f = Counted(path)
    assert [x for x, _ in logs.last_lines(f, 8)] == [b"line %d" % i for i in range(12, 20)] and f.read < 1_000_000
    assert [(r.nth, r.line) for r in logs.tail(spark, str(path)).orderBy("nth").collect()] == [(i - 11, f"line {i}") for i in range(12, 20)]
    path.unlink()


def test_tail_of_missing_empty_and_odd_files(spark, tmp_path):
    assert logs.tail(spark, str(tmp_path / "none.log")).count() == 0
    (tmp_path / "empty.log").write_bytes(b"")
    assert logs.tail(spark, str(tmp_path / "empty.log")).count() == 0
    (tmp_path / "odd.log").write_bytes(b"a\r\n\n \n\xff\nlast")
    assert [r.line for r in logs.tail(spark, f"file://{tmp_path}/odd.log").orderBy("nth").collect()] == ["a", " ", "�", "last"]
    assert [r.line for r in logs.tail(spark, str(tmp_path / "odd.log"), 3, keep_empty=True).orderBy("nth").collect()] == [" ", "�", "last"]


def test_a_stream_goes_on_over_rotation_and_restart(spark, tmp_path):
    log, out = tmp_path / "a.log", f"{tmp_path}/out"
    wrote = []

    def add(n, end="\n", fresh=False):
        lines = [f"{len(wrote) + i} said" for i in range(n)]
        wrote.extend(lines)
        with open(log, "w" if fresh else "a") as f:
            f.write("\n".join(lines) + end)

    def run():
        q = logs.followed(spark, str(log)).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/cp").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted((r.line for r in spark.read.schema(logs.SCHEMA).parquet(out).collect()), key=lambda x: int(x.split()[0]))

    add(50)
    assert run() == wrote
    add(5)
    os.rename(log, f"{log}.prev")  # five lines are left in it
    add(9, fresh=True)
    assert run() == wrote
    add(3, end="")  # the last one isn't whole
    assert run() == wrote[:-1]
    with open(log, "a") as f:
        f.write("\n")
    assert run() == wrote
    add(4, fresh=True)  # cut and begun again
    assert run() == wrote
    with open(f"{log}.prev", "a") as f:  # a writer that kept its handle
        f.write(f"{len(wrote)} said\n")
    wrote.append(f"{len(wrote)} said")
    assert run() == wrote
    add(2)
    for _ in range(2):
        os.rename(log, f"{log}.prev")
        add(2, fresh=True)
    with pytest.raises(Exception, match="rotated twice"):
        run()


def test_a_batch_planned_before_a_rotation_is_read_after_it(tmp_path):
    log = tmp_path / "b.log"
    log.write_bytes(b"one\ntwo\n")
    r = logs._Stream({"path": str(log), "rangeBytes": "3"})
    start, end = r.initialOffset(), r.latestOffset()
    parts = r.partitions(start, end)
    os.rename(log, f"{log}.prev")
    log.write_bytes(b"three is longer than what was there\n")
    lines = lambda ps: [x for p in ps for b in r.read(p) for x in b.column(0).to_pylist()]
    assert lines(parts) == ["one", "two"] == lines(r.partitions(start, end))
    assert lines(r.partitions(end, r.latestOffset())) == ["three is longer than what was there"]
