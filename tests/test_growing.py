"""Growing log files: splits, streams and tables agree with plain Python."""

import json
import random

import pytest

from opsweave.sources import readers as R
from opsweave.sources.growing import _CHUNK, Range, _Files, _Stream, blocks


def plain(data, mark):
    """Blocks by plain Python."""
    out, at, block, begun = [], 0, [], -1
    for line in data.splitlines(keepends=True):
        if not mark:
            if line.strip():
                out.append((at, line.rstrip(b"\r\n").decode()))
        elif line.rstrip(b"\r\n") == mark:
            if begun >= 0 and block:
                out.append((begun, b"".join(block).rstrip(b"\r\n").decode()))
            block, begun = [], at
        elif begun >= 0:
            block.append(line)
        at += len(line)
    if begun >= 0 and block:
        out.append((begun, b"".join(block).rstrip(b"\r\n").decode()))
    return out


@pytest.mark.parametrize("mark", ["", "START"])
def test_any_split_gives_the_same_blocks(tmp_path, mark):
    rng = random.Random(len(mark))
    for trial in range(60):
        lines = [rng.choice(["START", "START", "STARTED", "", "a b", "x" * 9, "é", "no START"]) for _ in range(rng.randrange(25))]
        data = ("\n".join(lines) + rng.choice(["", "\n"])).encode()
        p = tmp_path / f"{trial}.log"
        p.write_bytes(data)
        for split in (1, 2, 3, 7, 50, 1000):
            files = _Files({"path": str(p), "start": mark, "split_bytes": str(split)})
            got = [row[1:] for r in files.ranges(str(p), 0, len(data)) for row in files.read(r)]
            assert got == plain(data, mark.encode()), (split, data)


def test_long_blocks_and_ends(tmp_path):
    p = tmp_path / "long.log"
    p.write_bytes(b"START\n" + b"y" * (2 * _CHUNK) + b"\nSTART\n" + b"z" * (_CHUNK + 5))
    files = _Files({"path": str(p), "start": "START"})
    size = p.stat().st_size
    end = files.whole_until(str(p), size)
    assert end == 6 + 2 * _CHUNK + 1
    assert [len(r[2]) for r in files.read(Range(str(p), 0, size, size))] == [2 * _CHUNK, _CHUNK + 5]
    assert [len(r[2]) for r in files.read(Range(str(p), 0, end, end))] == [2 * _CHUNK]
    lines = _Files({"path": str(p)})
    assert lines.whole_until(str(p), size) == end + 6
    shift = tmp_path / "edge.log"  # a start line across the border of two chunks
    for back in range(9):
        shift.write_bytes(b"a\nSTART\n" + b"q" * (_CHUNK - back))
        assert files.whole_until(str(shift), shift.stat().st_size) == 2


def test_shorter_and_missing_files(tmp_path):
    s = _Stream({"path": str(tmp_path / "none")})
    assert s.latestOffset() == s.initialOffset()
    got = s.partitions({"files": json.dumps({"a": 90, "b": 5, "c": 7})}, {"files": json.dumps({"a": 20, "b": 9, "c": 7})})
    assert [(r.file, r.lo, r.hi) for r in got] == [("a", 0, 20), ("b", 5, 9)]


def test_table(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.log").write_text("".join(f"START\n{i} {j}\nmore\n" for j in range(20)))
    got = sorted(r.value for r in blocks(spark, str(tmp_path), "START", split_bytes=40).collect())
    assert got == sorted(f"{i} {j}\nmore" for i in range(3) for j in range(20))


def test_streams_follow_files_that_grow(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    log, commits = folder / "a.jsonl", tmp_path / "git.log"
    line = '{"ts":"2024-01-02T00:00:00Z","tool":"%s","action":"block"}\n'
    log.write_text(line % "one" + "not json\n" + (line % "two")[:20])
    commits.write_text("COMMIT_START\nh1\nA\na@x\n2024-01-01T10:00:00+00:00\nFirst\n\nM\tx.py\n")
    good, bad = R.jsonl_stream(spark, str(folder), R.AUDIT)
    found = R.commit_stream(spark, str(commits))[0]

    def start(df, name):
        where = str(tmp_path / f"ckpt-{name}")
        return df.writeStream.format("memory").queryName(name).option("checkpointLocation", where).start()

    queries = [start(good, "grown_good"), start(bad.select("offset", "value"), "grown_bad"), start(found, "grown_commits")]

    def rows(sql):
        for q in queries:
            q.processAllAvailable()
        return [tuple(r) for r in spark.sql(sql).collect()]

    try:
        assert rows("select tool from grown_good") == [("one",)]
        assert rows("select hash from grown_commits") == []
        with log.open("a") as f:
            f.write((line % "two")[20:] + line % "three")
        with commits.open("a") as f:
            f.write("COMMIT_START\nh2\nB\nb@x\n2024-01-02T10:00:00+00:00\nSecond\n")
        assert sorted(rows("select tool from grown_good")) == [("one",), ("three",), ("two",)]
        assert rows("select * from grown_bad") == [(len(line % "one"), "not json")]
        assert rows("select hash, files_changed from grown_commits") == [("h1", 1)]
    finally:
        for q in queries:
            q.stop()
    table = R.parsed(blocks(spark, str(folder)), R.AUDIT)
    assert sorted(r.tool for r in table.collect()) == ["one", "three", "two"]
