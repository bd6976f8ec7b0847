"""The growing-file source: complete lines only, growth, truncation, replacement, restarts."""

from __future__ import annotations

import os

import pytest

from loreloom.sources import tail
from loreloom.streaming import events as se


def write(path, data, mode="ab"):
    with open(path, mode) as f:
        f.write(data)


def polled(reader, start):
    end = reader.latestOffset()
    rows = [r for piece in reader.partitions(start, end) for r in reader.read(piece)]
    return end, [r[2] for r in rows]


def follow(path, **options):
    reader = tail.TailReader({"path": str(path), **options})
    return reader, reader.initialOffset()


def test_new_lines_only_and_a_partial_line_waits(tmp_path):
    log = tmp_path / "log.txt"
    write(log, b"old\n")
    reader, at = follow(log, startingPosition="latest")
    at, lines = polled(reader, at)
    assert lines == []
    write(log, b"first\nsecond")
    at, lines = polled(reader, at)
    assert lines == ["first"]
    at, lines = polled(reader, at)
    assert lines == []
    write(log, "\nthé".encode() + b"\xff\r\n")
    at, lines = polled(reader, at)
    assert lines == ["second", "thé�"]


def test_truncated_and_replaced_files_start_anew(tmp_path):
    log = tmp_path / "log.txt"
    write(log, b"one\ntwo\nthree\n")
    reader, at = follow(log)
    at, lines = polled(reader, at)
    assert lines == ["one", "two", "three"]
    write(log, b"cut\n", "wb")
    at, lines = polled(reader, at)
    assert lines == ["cut"]
    write(log, b"a longer text than was there before\nand more\n", "wb")  # cut, and past the old position again
    at, lines = polled(reader, at)
    assert lines == ["a longer text than was there before", "and more"]
    write(tmp_path / "next", b"a longer text than was there before\nand more\nnew\n")
    os.replace(tmp_path / "next", log)
    at, lines = polled(reader, at)
    assert lines == ["a longer text than was there before", "and more", "new"]
    os.remove(log)
    at, lines = polled(reader, at)
    assert lines == [] and at == {"files": {}}
    write(log, b"back\n")
    assert polled(reader, at)[1] == ["back"]


@pytest.mark.parametrize("split", [1, 2, 7, 64, 1 << 20])
def test_pieces_hold_every_line_once(tmp_path, split):
    log = tmp_path / "log.txt"
    lines = [b"", b"a", b"bb", b"", b"c" * 50, b"", b"d" * 200_000, b"e"]
    write(log, b"\n".join(lines) + b"\nrest")
    reader, at = follow(log, splitBytes=str(split if split > 2 else max(split, 60)) if split < 60 else str(split))
    assert [x.encode() for x in polled(reader, at)[1]] == lines
    small = tmp_path / "small.txt"
    write(small, b"\n\na\nbc\n\ndef\n")
    reader, at = follow(small, splitBytes=str(split))
    assert polled(reader, at)[1] == ["", "", "a", "bc", "", "def"]


def test_bounded_batches_and_long_lines(tmp_path):
    log = tmp_path / "log.txt"
    write(log, b"aaaa\nbbbb\n" + b"c" * 100 + b"\ndd\n")
    reader, at = follow(log, maxBytesPerTrigger="6")
    seen = []
    for _ in range(6):
        at, lines = polled(reader, at)
        seen.append(lines)
    assert seen == [["aaaa"], ["bbbb"], ["c" * 100], ["dd"], [], []]


def test_lost_ranges(tmp_path):
    log = tmp_path / "log.txt"
    for strict in ("true", "false"):
        write(log, b"one\ntwo\n", "wb")
        reader, at = follow(log, failOnDataLoss=strict)
        pieces = reader.partitions(at, reader.latestOffset())
        write(log, b"x\n", "wb")
        if strict == "true":
            with pytest.raises(RuntimeError):
                reader.read(pieces[0])
        else:
            assert list(reader.read(pieces[0])) == []


def test_stream_over_three_steps_with_restarts(spark, tmp_path):
    """A folder that grows, a file that is replaced, and one that comes later; each start of the query goes on from the checkpoint."""
    folder = tmp_path / "logs"
    folder.mkdir()
    root = str(tmp_path / "out")

    def step():
        stream = tail.tail_lines(spark, str(folder), pattern="*.log")
        return sorted(r.value for r in se.run_to_table(stream, "tail", root).collect())

    write(folder / "a.log", b"a1\na2\na")
    write(folder / "b.log", b"b1\n")
    write(folder / "c.txt", b"no\n")
    assert step() == ["a1", "a2", "b1"]
    write(folder / "a.log", b"3\n")
    write(folder / "b.log", b"new b, and a longer one\n", "wb")
    assert step() == ["a1", "a2", "a3", "b1", "new b, and a longer one"]
    assert len(step()) == 5
    write(folder / "d.log", b"d1\n\n")
    write(folder / "a.log", b"a4\n")
    assert step() == ["", "a1", "a2", "a3", "a4", "b1", "d1", "new b, and a longer one"]
