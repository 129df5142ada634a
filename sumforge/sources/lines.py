"""Lines of large text files by number: an index of where lines are, and reads that open only what holds them.

Files are cut into pieces of equal length. A task counts the line feeds of its piece; sums over the pieces of a file
before each give the number of the first line that begins in it. A read takes the pieces in which its lines begin.
"""

from __future__ import annotations

import itertools

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PIECE = 32 << 20
#: Bytes read at a time.
CHUNK = 1 << 20


def index(spark: SparkSession, path: str, *, piece: int = PIECE) -> DataFrame:
    """(file, start, end, size, first, last) of each piece of the files at path: the numbers of the first line that begins in it and of the one behind its last.

    A line feed at the end of a file begins no line; an empty file has none.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("size")).where("size > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(piece).cast("long"))).alias("start")
    pieces = files.select("file", starts, "size").withColumn("end", F.least(F.col("start") + piece, "size")).repartition(F.col("file"), F.col("start"))

    def count(batches):
        for batch in batches:
            begins = [_begins(*x) for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(begins, pa.int64())], ["file", "start", "end", "size", "begins"])

    counted = pieces.select("file", "start", "end", "size").mapInArrow(count, "file string, start long, end long, size long, begins long")
    before = F.sum("begins").over(Window.partitionBy("file").orderBy("start"))  # one row for each piece
    return counted.select("file", "start", "end", "size", (before - F.col("begins")).alias("first"), before.alias("last"))


def read(pieces: DataFrame, first: int, last: int) -> DataFrame:
    """(file, line, value): lines first to last - 1 of each file, numbered from 0, by the pieces of index() that they begin in."""

    def lines(batches):
        for batch in batches:
            for file, start, end, size, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = _lines(file, start, end, size, number, first, last)
                while some := list(itertools.islice(found, 10_000)):
                    numbers, values = zip(*some, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(some)), pa.array(numbers, pa.int64()), pa.array(values, pa.string())], ["file", "line", "value"])

    wanted = pieces.where((F.col("first") < last) & (F.col("last") > first)).repartition("file", "start")
    return wanted.select("file", "start", "end", "size", F.col("first").alias("number")).mapInArrow(lines, "file string, line long, value string")


def _open(file: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(file)
    return system.open_input_file(path)


def _begins(file: str, start: int, end: int, size: int) -> int:
    """How many lines begin in a piece: behind a line feed at start - 1 to end - 2, or at the start of the file."""
    n, at = int(start == 0), max(start - 1, 0)
    with _open(file) as f:
        f.seek(at)
        while at < end - 1:
            block = f.read(min(CHUNK, end - 1 - at))
            if not block:
                break
            n, at = n + block.count(b"\n"), at + len(block)
    return n


def _lines(file: str, start: int, end: int, size: int, number: int, first: int, last: int):
    """The lines from first to last - 1 that begin in a piece whose first line is number; each is read to its end."""
    with _open(file) as f:
        at = start
        if start:
            f.seek(start - 1)
            rest, at = b"", start - 1
            while b"\n" not in rest:  # to the first line that begins here
                rest = f.read(CHUNK)
                if not rest:
                    return
                at += len(rest)
            rest = rest[rest.index(b"\n") + 1 :]
            at -= len(rest)
        else:
            rest = b""
        while at < end and number < last:
            parts = [rest]
            while b"\n" not in parts[-1]:
                block = f.read(CHUNK)
                if not block:
                    break
                parts.append(block)
            whole = b"".join(parts)
            line, feed, rest = whole.partition(b"\n")
            if number >= first:
                yield number, line.removesuffix(b"\r").decode("utf-8", "replace")
            at, number = at + len(line) + len(feed), number + 1
            if not feed:
                return
