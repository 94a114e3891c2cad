"""Packing (7): best-fit decreasing into fixed windows.

Each task tokenises the documents it reads and packs them in groups of at most
`group_tokens` tokens, without a shuffle: overlong documents are first cut into
full windows, then the remainders go, longest first, to the open window with the
least room that still takes them. A segment tree over the remaining capacities
finds that window in log2(window) steps. A group's memory is bounded, but for a
single longer document, which is a group of its own.

Windows of a group that keep more than a 256th of room are opened again: of
their pieces only number and length are shuffled, into groups of `group_tokens`
again, packed alike, and joined back. So the fill doesn't depend on how the
table is divided; the last windows of these larger groups are the only ones left
with much room.

Defined results: a null or empty text is the end token alone; a text of any
length is tokenised whole and cut into as many windows as it takes; identifiers
are integers (others are cast), a null one stays null; repeated rows are packed
as often as they occur; of equal lengths the piece read first goes first, of
equally tight windows the one opened last; an empty table gives no pieces; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Windows with more room than window // OPEN are packed again.
OPEN = 256
#: Sequences that are packed again are numbered from here.
AGAIN = 1 << 62
SCHEMA = "document_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


_MARKS = ",.;:!?"
_MARK, _LETTER, _SMALL = np.zeros(256, bool), np.zeros(256, bool), np.arange(256, dtype=np.uint8)
_MARK[list(_MARKS.encode())] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SMALL[65:91] += 32


class CapacityTree:
    """A segment tree over capacities 0..window: which of them open windows have."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: dict[int, list[int]] = {}

    def put(self, room: int, window_id: int) -> None:
        self.open.setdefault(room, []).append(window_id)
        i = room + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The tightest open window with room for `least`, removed: (id, room)."""
        i, count, leaves = least + self.leaves, self.count, self.leaves
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - leaves
        while i:
            count[i] -= 1
            i >>= 1
        return self.open[room].pop(), room


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Pieces (item, start, length, window id, offset) of items with these lengths."""
    full = lengths // window
    rest = lengths - full * window
    item = np.repeat(np.arange(len(lengths)), full)
    nth = common.ragged(np.zeros(len(lengths), np.int64), full)
    made = len(item)
    left = np.flatnonzero(rest)
    left = left[np.argsort(-rest[left], kind="stable")]
    tree, ids, offs, n = CapacityTree(window), [], [], made
    for r in rest[left].tolist():
        found = tree.take(r)
        w, room = found if found else (n, window)
        n += not found
        ids.append(w)
        offs.append(window - room)
        if room > r:
            tree.put(room - r, w)
    return (
        np.concatenate([item, left]), np.concatenate([nth * window, full[left] * window]), np.concatenate([np.full(made, window), rest[left]]),
        np.concatenate([np.arange(made), np.array(ids, np.int64)]), np.concatenate([np.zeros(made, np.int64), np.array(offs, np.int64)]),
    )


class WordIds:
    """Token ids of words, kept per Python worker. A text's ids are its words'
    ids if the tokenizer drops white space and joins no words; that is tried.
    Where the tokenizer doesn't tell them apart, words are looked up without
    their case and without a mark at their end, so fewer are new."""

    MOST = 800_000
    PROBES = ("one two", " one\n\ntwo\tthree  4,five ", "a\r\nb\x0bc\x0cd", "x\n", "né — 12 345 z’y\n#tag", "")

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        for probe in self.PROBES:
            words = pa.array([probe.encode()], pa.large_binary())
            if ids(probe) != [i for w in common.Words(words).array.to_pylist() for i in ids(w.decode())]:
                raise ValueError("the tokenizer's ids of a text are not those of its words")
        # a word in ASCII then is looked up in lower case
        self.one_case = all(ids(c) == ids(c.lower()) for c in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", *"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        # a mark after an ASCII letter then is a word of its own
        self.marks_apart = all(ids(f"{w}{m}") == [*ids(w), *ids(m)] for w in ("one", "it's", "X", "a-b", "né") for m in _MARKS)
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat, self.bounds = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)

    def _encoded(self, words: list[str], together: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word): words go to the tokenizer in lines
        of several, and a token's place in its line tells its word."""
        lines = [" ".join(words[i : i + together]) for i in range(0, len(words), together)]
        found = self.tokenizer.encode_batch(lines, add_special_tokens=False)
        counts = np.fromiter((len(e) for e in found), np.int64, len(found))
        total = int(counts.sum())
        ids = np.fromiter(chain.from_iterable(e.ids for e in found), np.uint32, total)
        places = np.fromiter(map(itemgetter(0), chain.from_iterable(e.offsets for e in found)), np.int64, total)
        begins = np.cumsum([0, *(len(x) + 1 for x in lines[:-1])])
        ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words)))
        word = np.searchsorted(ends, places + np.repeat(begins, counts), side="right")
        return ids, np.bincount(word, minlength=len(words))

    def encode(self, words: common.Words) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds by text)."""
        data, offsets, bounds = words.packed, words.offsets, words.bounds
        if self.one_case:
            wide = np.append(0, np.cumsum(data >= 128))[offsets]
            data = np.where(np.repeat(wide[1:] == wide[:-1], np.diff(offsets)), _SMALL[data], data)
        if self.marks_apart and words.n:
            last = offsets[1:] - 1
            cut = (np.diff(offsets) > 1) & _MARK[data[last]] & _LETTER[data[last - 1]]
            bounds = bounds + np.append(0, np.cumsum(cut))[bounds]
            offsets = np.sort(np.concatenate([offsets, last[cut]]))
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        codes, distinct = parts.indices.to_numpy(zero_copy_only=False), parts.dictionary.to_pylist()
        if len(self.index) > self.MOST:
            self.clear()
        get = self.index.get
        at = np.fromiter((get(w, -1) for w in distinct), np.int64, len(distinct))
        missing = np.flatnonzero(at < 0)
        new = [distinct[i] for i in missing.tolist()]
        at[missing] = len(self.index) + np.arange(len(new))
        for lo in range(0, len(new), 12_800):
            part = new[lo : lo + 12_800]
            flat, sizes = self._encoded([w.decode() for w in part])
            n = len(self.index)
            end = int(self.bounds[n])
            while end + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while n + len(part) + 1 > len(self.bounds):
                self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
            self.flat[end : end + len(flat)] = flat
            self.bounds[n + 1 : n + 1 + len(part)] = end + np.cumsum(sizes)
            self.index.update(zip(part, range(n, n + len(part)), strict=True))
        starts, sizes = self.bounds[at], self.bounds[at + 1] - self.bounds[at]
        per_word = sizes[codes]
        ids = self.flat[common.ragged(starts[codes], per_word)]
        return ids, np.append(0, np.cumsum(per_word))[bounds]


_LOADED: dict[str, WordIds] = {}


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", window: int = 4096, group_tokens: int = 4_000_000, chunk_bytes: int = 8_000_000) -> DataFrame:
    """Pieces: document_id, start, length, ids (little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset. The tokenizer (a JSON file of `tokenizers`
    whose pre-tokenizer drops white space) is read here and sent with the task."""
    spark = docs.sparkSession
    common.ship(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        model = f.read()
    if len(model) > 64_000_000:
        raise ValueError("the tokenizer file is too large to send with the tasks")
    WordIds(model)  # raises if it doesn't serve

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _LOADED:
            _LOADED.clear()
            _LOADED[model] = WordIds(model)
        coder = _LOADED[model]
        base = TaskContext.get().partitionId() << 40
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        size = 0
        for b in common.chunks(batches, chunk_bytes):
            ids, bounds = coder.encode(common.Words(b.column(1)))
            lengths = np.diff(bounds) + 1
            flat = np.full(int(lengths.sum()), end_id, np.uint32)
            flat[common.ragged(np.cumsum(lengths) - lengths, lengths - 1)] = ids
            held.append((b.column(0), flat, lengths))
            size += len(flat)
            if size >= group_tokens:
                base = yield from emitted(held, base)
                held, size = [], 0
        if held:
            yield from emitted(held, base)

    def emitted(held: list, base: int) -> Iterator[pa.RecordBatch]:
        names = pa.concat_arrays([x[0] for x in held])
        flat, lengths = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
        begins = np.cumsum(lengths) - lengths
        item, start, length, seq, offset = best_fit(lengths, window)
        again = (window - np.bincount(seq, weights=length) > window // OPEN)[seq]
        for lo in range(0, len(item), 2000):
            s = slice(lo, lo + 2000)
            part = flat[common.ragged(begins[item[s]] + start[s], length[s])].astype("<u4")
            cut = (np.append(0, np.cumsum(length[s])) * 4).astype(np.int32)
            ids = pa.BinaryArray.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(cut), pa.py_buffer(part)])
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(item[s])), *map(pa.array, (start[s], length[s])), ids, *map(pa.array, (lengths[item[s]], seq[s] + base, offset[s], np.arange(base + lo, base + lo + len(cut) - 1), again[s]))],
                names=["document_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "piece", "again"],
            )
        return base + len(item)

    def repacked(t: pa.Table) -> pa.Table:
        piece = t.column("piece").to_numpy()
        by = np.argsort(piece)
        piece = piece[by]
        item, _, _, seq, offset = best_fit(t.column("length").to_numpy()[by], window)
        first = AGAIN + (t.column("part")[0].as_py() << 32)
        return pa.table([pa.array(piece[item]), pa.array(seq + first), pa.array(offset)], names=["piece", "sequence_id", "offset"])

    rows = docs.selectExpr(f"cast(`{id_col}` as long) as document_id", f"`{text_col}` as text")
    pieces = common.landed(rows.mapInArrow(packed, f"{SCHEMA}, piece long, again boolean"), "pack-pieces")
    out = ["document_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    opened = pieces.filter("again")
    parts = (opened.agg(F.sum("length").alias("n")).first()["n"] or 0) // group_tokens + 1
    dealt = opened.select("piece", "length", F.pmod(F.xxhash64("piece"), F.lit(parts)).alias("part"))
    found = dealt.groupBy("part").applyInArrow(repacked, "piece long, sequence_id long, offset long")
    return pieces.filter("not again").select(*out).unionByName(opened.drop("sequence_id", "offset").join(found, "piece").select(*out))
