"""Files that are one JSON array, read by several tasks.

Spark's text reader splits any file at a separator; with a comma for that, a
split is a run of pieces of the array, in order. A comma may lie in a string or
deep in a record, so a split alone doesn't tell where records end. A first pass
says for each split whether it has an odd number of quotes and how far it goes
down or up in brackets, once for a split that begins outside of strings and once
for one that begins inside. Composed in the order of a file's splits (two numbers
a split come to the driver and go back), this gives the state in which each split
begins. The second pass cuts the records, and the pieces of those that splits
divide are put together by file.

Escapes never reach over a split, since each begins at a comma. Records are handed
on as text, and from_json gives them their columns, as the JSON reader would.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship

QUOTE, ESCAPE, COMMA = ord('"'), ord("\\"), ord(",")
_STEP = np.zeros(256, np.int8)
_STEP[[ord("["), ord("{")]], _STEP[[ord("]"), ord("}")]] = 1, -1


def inside(data: np.ndarray) -> np.ndarray:
    """Whether each byte lies in a string, if the first one doesn't (a string's
    closing quote does)."""
    quotes = np.flatnonzero(data == QUOTE)
    if len(quotes):
        # the run of escapes that ends before a quote
        other = np.flatnonzero(data != ESCAPE)
        at = np.searchsorted(other, quotes) - 1
        before = np.where(at >= 0, other[np.maximum(at, 0)], -1)
        quotes = quotes[(quotes - before) % 2 == 1]
    marks = np.zeros(len(data) + 1, np.int8)
    marks[quotes + 1] = 1
    return np.cumsum(marks[:-1], dtype=np.int64) % 2 == 1


def summary(data: np.ndarray) -> tuple[int, int, int]:
    """(1 for an odd number of quotes, the change of depth from outside of
    strings, that from inside)."""
    if not len(data):
        return 0, 0, 0
    within, step = inside(data), _STEP[data].astype(np.int64)
    odd = int(inside(np.append(data, np.uint8(32)))[-1])
    return odd, int(step[~within].sum()), int(step[within].sum())


def cut(data: np.ndarray, within: bool, depth: int) -> tuple[bytes, list[bytes], bytes | None, bool]:
    """(what ends a record begun before, whole records, what begins one that ends
    later or None after the array, whether there is any mark between records) of
    bytes that begin in this state."""
    out = inside(data) == within
    step = np.where(out, _STEP[data], 0).astype(np.int32)
    level = depth + np.cumsum(step, dtype=np.int32)
    marks = np.flatnonzero(out & (((data == COMMA) & (level == 1)) | ((step == 1) & (level == 1)) | ((step == -1) & (level == 0)))).tolist()
    text = data.tobytes()
    if not marks:
        return text, [], None, False
    parts = [text[a + 1 : b] for a, b in zip(marks, marks[1:], strict=False)]
    return text[: marks[0]] if depth else b"", parts, None if level[marks[-1]] == 0 else text[marks[-1] + 1 :], True


class _Split:
    """A split as far as it has been read: `head` ends a record begun before it,
    `tail` begins one (None: none is open)."""

    def __init__(self, within: bool, depth: int):
        self.within, self.depth, self.head, self.tail, self.marked = within, depth, bytearray(), None, False

    def read(self, data: np.ndarray) -> list[bytes]:
        """The records that end in data and began in the split."""
        head, found, rest, marked = cut(data, self.within, self.depth)
        odd, outer, inner = summary(data)
        self.depth += inner if self.within else outer
        self.within ^= bool(odd)
        if self.tail is not None:
            self.tail += head
        elif not self.marked:
            self.head += head
        if marked:
            found = found if self.tail is None else [bytes(self.tail), *found]
            self.tail, self.marked = None if rest is None else bytearray(rest), True
        return found


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, np.ndarray]]:
    """(file, start, bytes) of the blocks of a task's splits, in order; but for
    the first of a file they begin with the comma before them."""
    now = None
    for b in batches:
        values, starts = b.column(0), b.column(2).to_numpy()
        files = b.column(1).dictionary_encode()
        of = files.indices.to_numpy()
        cuts = np.flatnonzero((of[1:] != of[:-1]) | (starts[1:] != starts[:-1])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(starts)], strict=True):
            if hi == lo:
                continue
            split = files.dictionary[of[lo]].as_py(), int(starts[lo])
            text = b",".join(values.slice(lo, hi - lo).to_pylist())
            yield *split, np.frombuffer(text if split[1] == 0 and split != now else b"," + text, np.uint8)
            now = split


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", ",").text(path)
    return rows.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def states(spark: SparkSession, path: str) -> dict[tuple[str, int], tuple[bool, int]]:
    """(file, start) of each split: whether it begins in a string, and how deep."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row: dict = {}
        for file, start, data in _blocks(batches):
            if (row.get("file"), row.get("start")) != (file, start):
                if row:
                    yield pa.RecordBatch.from_pylist([row])
                first = bytes(data).lstrip()[:1] if start == 0 else b"["
                row = {"file": file, "start": start, "array": first == b"[", "odd": 0, "outer": 0, "inner": 0}
            odd, outer, inner = summary(data)
            row["outer"] += inner if row["odd"] else outer
            row["inner"] += outer if row["odd"] else inner
            row["odd"] ^= odd
        if row:
            yield pa.RecordBatch.from_pylist([row])

    rows = _pieces(spark, path).mapInArrow(summed, "file string, start long, array boolean, odd long, outer long, inner long").collect()
    out, before = {}, None
    within, depth = False, 0
    for r in sorted(rows, key=lambda r: (r["file"], r["start"])):
        if r["file"] != before:
            before, within, depth = r["file"], False, 0
        if not r["array"]:
            raise ValueError(f"{r['file']} has no array")
        out[r["file"], r["start"]] = within, depth
        depth += r["inner"] if within else r["outer"]
        within ^= bool(r["odd"])
    return out


def records(spark: SparkSession, path: str) -> DataFrame:
    """value: the text of each record of the arrays at path."""
    ship(spark)
    begun = spark.sparkContext.broadcast(states(spark, path))  # a few bytes for each split of the files

    def splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], _Split, list[bytes]]]:
        now, split = None, None
        for file, start, data in _blocks(batches):
            if (file, start) != now:
                now = file, start
                split = _Split(*begun.value[now])
            yield now, split, split.read(data)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, found in splits(batches):
            found = [x.decode("utf-8", "replace") for x in found if x.strip()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["value"])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {now: split for now, split, _ in splits(batches)}
        rows = [{"file": f, "start": n, "head": bytes(x.head), "tail": None if x.tail is None else bytes(x.tail)} for (f, n), x in found.items()]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("file", pa.string()), ("start", pa.int64()), ("head", pa.binary()), ("tail", pa.binary())]))

    pieces = _pieces(spark, path)
    divided = pieces.mapInArrow(ends, "file string, start long, head binary, tail binary").groupBy("file").applyInArrow(_joined, "value string")
    return pieces.mapInArrow(whole, "value string").unionByName(divided)


def _joined(t: pa.Table) -> pa.Table:
    rows = sorted(t.to_pylist(), key=lambda r: r["start"])
    out, held = [], b""
    for r in rows:
        held += r["head"]
        if r["tail"] is not None:
            out.append(held)
            held = r["tail"]
    out.append(held)
    return pa.table({"value": pa.array([x.decode("utf-8", "replace") for x in out if x.strip()], pa.string())})


def read_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The records of a file (or files) with one JSON array, with these columns."""
    return records(spark, path).select(F.from_json("value", schema).alias("r")).select("r.*")

