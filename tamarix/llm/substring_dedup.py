"""Substring dedup (9): super-k-mer partitioning.

A window is `window` consecutive words; its minimiser is the least hash of the
`mini`-word sequences in it. Consecutive windows with the same minimiser travel
as one packed string to the minimiser's bucket. Equal windows have equal
minimisers, so all of them meet in one bucket, where sorting their words (runs
of 1, 2, 4, .. words are numbered by sorting pairs of shorter ones) finds equal
windows exactly, and for each the smallest document that has it.

A minimiser of very many windows would make one large bucket. A first pass
counts the windows of minimisers that are frequent in a chunk; windows of the
heavy ones are dealt by the pair of their minimiser and their least hash in a
second, independent order, which equal windows share as well. The counts decide
on the bucket alone, never on the result.

A chunk of documents sends each of its different strings once, with the
smallest document that holds it, however many documents of the chunk share it;
its texts travel compressed in one row. The buckets answer with the windows
that a smaller document elsewhere has, and the chunk, which finds its strings
in its texts again in the same order, removes the covered words.

Defined results: a null or empty text has no words and keeps the empty string;
texts shorter than a window keep all words; longer ones are read whole, a text
over `chunk_bytes` as a chunk of its own; identifiers are integers (others are
cast); documents with equal identifiers are one document, none of them smaller;
a null identifier is greater than all others; a document's own repeats stay; an
empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LAST = np.iinfo(np.int64).max
BUCKET_BYTES = 16_000_000
#: Windows a chunk must have of a minimiser to report it; the least share of all
#: windows that can make a minimiser heavy (so at most 1 / HEAVY are sent out).
SEEN, HEAVY = 64, 1e-6


class Packed:
    """The super-k-mers of a chunk. Words are joined by one space in `joined`,
    word i at word_from[i]:word_to[i]. Distinct strings stand in order of
    bucket, then first appearance; `low` is each one's smallest document."""

    def __init__(self, ids: np.ndarray, texts: pa.Array, window: int, mini: int, buckets: int, heavy: np.ndarray):
        words = common.Words(texts)
        self.bounds, self.n, self.ids = words.bounds, words.n, ids
        lengths = np.diff(words.offsets)
        self.word_from = words.offsets[:-1] + np.arange(words.n)
        self.word_to = self.word_from + lengths
        joined = np.full(len(words.packed) + words.n, 32, np.uint8)
        joined[np.arange(len(words.packed)) + np.repeat(np.arange(words.n), lengths)] = words.packed
        self.joined = joined.tobytes()
        self.doc = np.repeat(np.arange(len(texts)), words.lengths())
        m, valid = minimisers(words, self.doc, window, mini)
        n_windows = len(m)
        if len(heavy):
            split = np.isin(m, heavy)
            if split.any():
                second, _ = minimisers(words, self.doc, window, mini, 1)
                m = np.where(split, common.mixed(m + second * np.uint64(3)), m)
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (m[1:] != m[:-1])
        self.at = np.flatnonzero(new)
        order = np.cumsum(new) - 1
        self.windows = np.bincount(order[valid], minlength=len(self.at)) if len(self.at) else np.zeros(0, np.int64)
        joined = self.joined
        seen: dict[bytes, int] = {}
        which = [seen.setdefault(joined[s:e], len(seen)) for s, e in zip(self.word_from[self.at].tolist(), self.word_to[self.at + self.windows + window - 2].tolist(), strict=True)]
        which = np.array(which, np.int64)
        first = np.full(len(seen), -1, np.int64)
        first[which[::-1]] = np.arange(len(which))[::-1]
        bucket = (m[self.at[first]] % np.uint64(buckets)).astype(np.int64) if len(first) else first
        by = np.argsort(bucket, kind="stable")
        place = np.empty_like(by)
        place[by] = np.arange(len(by))
        self.which = place[which] if len(which) else which
        strings = list(seen)
        self.strings = [strings[i] for i in by.tolist()]
        self.bucket, self.count = bucket[by], self.windows[first][by]
        self.low = np.full(len(by), LAST)
        np.minimum.at(self.low, self.which, ids[self.doc[self.at]])
        self.cuts = np.append(np.flatnonzero(np.append(True, self.bucket[1:] != self.bucket[:-1])), len(by)).tolist() if len(by) else [0]


def minimisers(words: common.Words, doc: np.ndarray, window: int, mini: int, order: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The minimiser of the window at each word, and which of these windows lie
    in one document."""
    least = common.rolled(common.word_hashes(words, order), mini)
    n_windows = max(0, words.n - window + 1)
    m = least[:n_windows].copy()
    for j in range(1, window - mini + 1):
        np.minimum(m, least[j : j + n_windows], out=m)
    return m, doc[:n_windows] == doc[window - 1 :][:n_windows]


def numbers(ids: pa.Array) -> np.ndarray:
    return ids.cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)


def lowest(rows: list[tuple[int, bytes, bytes]], window: int) -> Iterator[tuple[int, bytes]]:
    """(chunk, answer) of a bucket's (chunk, strings, low): runs of windows that
    a smaller document has, as (string, first window, windows, that document)."""
    data = b"\n".join(common.expand(a) for _, a, _ in rows)
    words = common.Words(pa.array([data], pa.large_binary()))
    data = np.frombuffer(data, np.uint8)
    marks = data[(data == 32) | (data == 10)]
    line = np.append(0, np.cumsum(marks == 10))
    del data, marks
    same = words.codes()
    ok = np.flatnonzero(line[: len(line) - window + 1] == line[window - 1 :])
    same, line = common.run_ranks(same, window)[ok], line[ok]
    starts = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    at = np.arange(len(line)) - np.repeat(starts, np.diff(np.append(starts, len(line))))
    lows = [np.frombuffer(b, np.int64) for _, _, b in rows]
    counts = np.array([len(x) for x in lows])
    base = len(rows)
    chunk = np.repeat(np.arange(base), counts)[line]
    of = line - (np.cumsum(counts) - counts)[chunk]
    low = np.concatenate(lows)[line]
    least = np.full(int(same.max()) + 1, LAST)
    np.minimum.at(least, same, low)
    best = least[same]
    hit = np.flatnonzero(best < low)
    if not len(hit):
        return
    c, o, w, g = chunk[hit], of[hit], at[hit], best[hit]
    first = np.append(True, (c[1:] != c[:-1]) | (o[1:] != o[:-1]) | (w[1:] != w[:-1] + 1) | (g[1:] != g[:-1]))
    starts = np.flatnonzero(first)
    runs = np.stack([o[starts], w[starts], np.diff(np.append(starts, len(hit))), g[starts]], axis=1)
    edges = np.searchsorted(c[starts], np.arange(base + 1))
    for i in np.unique(c).tolist():
        yield rows[i][0], common.squeeze(runs[edges[i] : edges[i + 1]].tobytes())


def heavy_minimisers(texts: DataFrame, window: int, mini: int, buckets: int, chunk_bytes: int) -> np.ndarray:
    """The minimisers that have as many windows as four usual buckets."""

    def reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.chunks(batches, chunk_bytes):
            words = common.Words(b.column(0))
            m, valid = minimisers(words, np.repeat(np.arange(b.num_rows), words.lengths()), window, mini)
            found, n = np.unique(m[valid], return_counts=True)
            many = n >= SEEN
            rows = [None, *found[many].view(np.int64).tolist()], [int(n.sum()), *n[many].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64())], names=["m", "n"])

    counts = common.landed(texts.mapInArrow(reported, "m long, n long").groupBy("m").agg(F.sum("n").alias("n")), "substring-counts")
    total = counts.filter("m IS NULL").first()
    least = (total["n"] if total else 0) * max(4 / buckets, HEAVY)
    found = [r["m"] for r in counts.filter((F.col("n") >= least) & F.col("m").isNotNull()).select("m").collect()]
    common.discard(counts)
    return np.sort(np.array(found, np.int64).view(np.uint64))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, mini: int = 3, chunk_bytes: int = 4_000_000) -> DataFrame:
    """document_id, n_words, n_removed, kept (the words that stay, joined by one
    space), removed (runs of removed words: first, words)."""
    spark = docs.sparkSession
    common.ship(spark)
    total = common.text_bytes(docs, text_col)
    width = (2 * window - mini + 2) / (window - mini + 2)  # words sent a window, nearly
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total * width) // BUCKET_BYTES + 1)
    kind = docs.schema[id_col].dataType.simpleString()
    wire = "part long, chunk long, a binary, b binary"
    heavy = heavy_minimisers(docs.select(F.col(text_col).alias("text")), window, mini, buckets, chunk_bytes)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for b in common.chunks(batches, chunk_bytes):
            p = Packed(numbers(b.column(0)), b.column(1), window, mini, buckets, heavy)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema) as writer:
                writer.write_batch(b)
            rows = [(-1 - chunk, chunk, common.squeeze(sink.getvalue().to_pybytes()), None)]
            for lo, hi in zip(p.cuts, p.cuts[1:], strict=False):
                rows.append((int(p.bucket[lo]), chunk, common.squeeze(b"\n".join(p.strings[lo:hi])), p.low[lo:hi].tobytes()))
            yield batch_of(rows)
            chunk += 1

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["part", "chunk", "a", "b"])

    def counted(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        if part < 0:
            return t
        rows = list(zip(*(t.column(c).to_pylist() for c in ("chunk", "a", "b")), strict=True))
        found = [(part, chunk, answer, None) for chunk, answer in lowest(rows, window)]
        return pa.Table.from_batches([batch_of(found)]) if found else t.slice(0, 0)

    def gathered(t: pa.Table) -> pa.Table:
        rows = dict(zip(t.column("part").to_pylist(), t.column("a").to_pylist(), strict=True))
        text = rows.pop(next(k for k in rows if k < 0))
        held = pa.ipc.open_stream(common.expand(text)).read_all().combine_chunks()
        ids, texts = (held.column(i).combine_chunks() if held.num_rows else pa.array([], held.schema.types[i]) for i in (0, 1))
        p = Packed(numbers(ids), texts, window, mini, buckets, heavy)
        base = np.cumsum(p.count) - p.count
        least = np.repeat(p.low, p.count)
        begin = dict(zip(p.bucket[p.cuts[:-1]].tolist(), p.cuts[:-1], strict=True)) if len(p.bucket) else {}
        for part, answer in rows.items():
            o, w, n, g = np.frombuffer(common.expand(answer), np.int64).reshape(-1, 4).T
            least[common.ragged(base[begin[part] + o] + w, n)] = np.repeat(g, n)
        seen = least[common.ragged(base[p.which], p.windows)]
        starts = common.ragged(p.at, p.windows)
        starts = starts[seen < p.ids[p.doc[starts]]] if len(starts) else starts
        change = np.bincount(starts, minlength=p.n + window + 1).astype(np.int64)
        change[window:] -= np.bincount(starts, minlength=p.n + window + 1)[:-window]
        gone = np.cumsum(change)[: p.n] > 0
        kept, runs = [], []
        removed = np.append(0, np.cumsum(gone))[p.bounds]
        for i, (lo, hi) in enumerate(zip(p.bounds[:-1].tolist(), p.bounds[1:].tolist(), strict=True)):
            if lo == hi:
                kept.append(b"")
                runs.append([])
            elif removed[i] == removed[i + 1]:
                kept.append(p.joined[p.word_from[lo] : p.word_to[hi - 1]])
                runs.append([])
            else:
                g = gone[lo:hi]
                edge = np.append(0, np.append(np.flatnonzero(g[1:] != g[:-1]) + 1, hi - lo))
                spans = list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))
                kept.append(b" ".join(p.joined[p.word_from[lo + s] : p.word_to[lo + e - 1]] for s, e in spans if not g[s]))
                runs.append([{"first": s, "words": e - s} for s, e in spans if g[s]])
        spans = pa.array(runs, pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())])))
        return pa.table([ids, pa.array(np.diff(p.bounds)), pa.array(np.diff(removed)), pa.array(kept, pa.binary()).cast(pa.string()), spans], names=["document_id", "n_words", "n_removed", "kept", "removed"])

    sent = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(scatter, wire)
    answers = sent.groupBy("part").applyInArrow(counted, wire)
    return answers.groupBy("chunk").applyInArrow(gathered, f"document_id {kind}, n_words long, n_removed long, kept string, removed array<struct<first:int,words:int>>")
