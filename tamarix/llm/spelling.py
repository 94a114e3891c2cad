"""Spelling variant grouping (12): words one edit apart, by a positional q-gram
inverted index with a count filter.

Words are the runs of letters of all texts, in lower case; each chunk of
documents sends a word once, with its count. The posting key of a word is one of
its q-grams with its position and the word's length.

Of two words one edit apart, the longer of length l, at least T = l - 2q + 1
q-grams are the same at the same position, or one further on after an insertion.
So they share one of their q + 1 rarest ones: words are posted under these only,
and a word looks under its own keys and, for words one longer, under the two
positions that each of its rarest q-grams may have there.

The postings of a bucket of keys make a local index of all q-grams of its words.
A word may be missing from as many lists of another's q-grams as T allows, so the
lists but for these, the shortest ones, hold every candidate: their sorted
postings are merged, for many words at once (a merge sort of their runs, in place
of a heap for each word). Candidates with T common q-grams are verified code point
by code point. A key with many words is dealt over cells, of a piece of the words
posted and a piece of those looked up each.

Defined results: null texts have no words; texts and words of any length are read
whole; a null identifier is written as nothing; rows may repeat, each counts; an
empty table gives no rows; other columns are not read, whatever their names; of
several near words with the largest count the smallest in code-point order is the
form; words without a form are their own root.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: a-z and U+00C0-00FF, which the UTF-8 bytes C3 80 - C3 BF are.
LETTERS = 26 + 64
#: Length of the grams; rows of a bucket; words of a piece of a key.
Q, BUCKET_ROWS, PIECE = 3, 100_000, 20_000
#: Candidates looked at together.
AT_ONCE = 1_000_000
#: What a row of a key is: a word that is posted and looks for others as long, a
#: word that looks for those one longer, one that only looks, one only posted.
BOTH, LONGER, LOOKS, LISTED = range(4)
_ALPHA = np.zeros(256, dtype=bool)
_ALPHA[[*range(65, 91), *range(97, 123)]] = True


def letters(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to letters."""
    lead = data == 0xC3
    out = _ALPHA[data] | lead
    out[1:] |= lead[:-1]
    return out


class Symbols:
    """Words as numbers of letters: `flat`, word i at bounds[i]:bounds[i + 1]."""

    def __init__(self, words: pa.Array):
        words = words.cast(pa.large_binary())
        off = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
        lead = data == 0xC3
        after = np.append(False, lead)[:-1]
        value = np.where(after, data.astype(np.int64) - 0x80 + 26, data.astype(np.int64) - 97)
        self.flat = value[~lead]
        self.bounds = np.append(0, np.cumsum(~lead))[off - off[0]]
        self.lengths = np.diff(self.bounds)
        f = self.flat
        #: The gram that begins at each letter; the last ones of a word are none.
        self.grams = np.append((f[:-2] * LETTERS + f[1:-1]) * LETTERS + f[2:], [0, 0]) if len(f) > 2 else np.zeros(len(f), np.int64)

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """(word, position) of every gram."""
        n = np.maximum(self.lengths - Q + 1, 0)
        return np.repeat(np.arange(len(n)), n), common.ragged(np.zeros(len(n), np.int64), n)


def first_of(group: np.ndarray, by: tuple[np.ndarray, ...], most: np.ndarray | int) -> np.ndarray:
    """The first `most` of each group, in the order of the keys `by` (the last
    one decides first)."""
    order = np.lexsort((*by, group))
    g = group[order]
    starts = np.flatnonzero(np.append(True, g[1:] != g[:-1])[: len(g)])
    nth = np.arange(len(g)) - np.repeat(starts, np.diff(np.append(starts, len(g))))
    return order[nth < (most if isinstance(most, int) else most[g])]


#: Positions and lengths lie in 21 bits each of a key; longer ones only share keys.
_PART = (1 << 21) - 1


def _key(gram: np.ndarray, position: np.ndarray, length: np.ndarray) -> np.ndarray:
    return (length & _PART) << 41 | (position & _PART) << 20 | gram


class Spelling:
    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, least_count: int = 2, every: int = 31, ratio: int = 10, chunk_bytes: int = 4_000_000):
        if least_length < 2 * Q:
            raise ValueError(f"words of fewer than {2 * Q} letters may share no gram")
        self.spark, self.ratio = docs.sparkSession, ratio
        common.ship(self.spark)
        counted = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_counting(least_length, every, chunk_bytes), "word string, n long")
        self.words = common.landed(counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count), "spelling-words")

    def _rarity(self) -> np.ndarray:
        """In how many places each gram is; LETTERS ** Q numbers, whatever the
        words are."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                s = Symbols(b.column(0))
                word, at = s.places()
                gram, n = np.unique(s.grams[s.bounds[word] + at], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n)], names=["gram", "n"])

        found = self.words.select("word").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(LETTERS**Q, np.int64)
        out[found.column("gram").to_numpy()] = found.column("n").to_numpy()
        return np.minimum(out, 0x7FFFFFFF).astype(np.int32)

    def _postings(self) -> DataFrame:
        """key, role, word, n: a word under its own keys, and under those that it
        may share with words one letter longer."""
        rare = self.spark.sparkContext.broadcast(self._rarity())

        def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                s = Symbols(b.column(0))
                word, at = s.places()
                gram = s.grams[s.bounds[word] + at]
                by = (at, gram, rare.value[gram])
                own, less = first_of(word, by, Q + 1), first_of(word, by, Q)
                long = s.lengths[word[less]] + 1
                keys = np.concatenate([_key(gram[own], at[own], s.lengths[word[own]]), _key(gram[less], at[less], long), _key(gram[less], at[less] + 1, long)])
                role = np.repeat(np.array([BOTH, LONGER], np.int32), [len(own), 2 * len(less)])
                rows = pa.array(np.concatenate([word[own], word[less], word[less]]))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(role), b.column(0).take(rows), b.column(1).take(rows)], names=["key", "role", "word", "n"])

        return self.words.mapInArrow(post, "key long, role int, word string, n long")

    def near(self) -> DataFrame:
        """word, near, n (the near word's): every pair, both ways."""
        posts = common.landed(self._postings(), "spelling-postings")
        sizes = posts.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
        heavy = common.landed(sizes.filter(F.col("rows") > PIECE).select("key", F.ceil(F.col("rows") / PIECE).cast("int").alias("pieces")), "spelling-heavy")
        buckets = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), posts.count() // BUCKET_ROWS + 1)
        met = posts.join(heavy, "key", "left").withColumn("own", F.pmod(F.xxhash64("word"), F.coalesce("pieces", F.lit(1))).cast("int"))
        cell = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), role.alias("role"))
        own, role = F.col("own"), F.col("role")

        def cells(other: Column) -> Column:
            twice = F.array(cell(own, other, F.lit(LISTED)), cell(other, own, F.lit(LOOKS)))
            return F.when(role == LONGER, F.array(cell(other, own, role))).when(other == own, F.array(cell(own, own, role))).otherwise(twice)

        dealt = F.flatten(F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), cells))
        met = met.select("key", "word", "n", F.explode(F.when(F.col("pieces").isNull(), F.array(cell(own, own, role))).otherwise(dealt)).alias("cell"))
        key = F.xxhash64("key", "cell.i", "cell.j")
        met = met.select(F.pmod(key, F.lit(buckets)).cast("int").alias("bucket"), key.alias("key"), "cell.role", "word", "n")
        pairs = met.groupBy("bucket").applyInArrow(_met, "word string, near string, n long")
        out = common.landed(pairs.dropDuplicates(["word", "near"]), "spelling-near")
        common.discard(posts, heavy)
        return out

    def variants(self) -> DataFrame:
        """word, form, root, n, n_near, form_n of every word."""
        best = self.near().groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("best"))
        words = self.words.join(best, "word", "left")
        has = -F.col("best.less") >= F.col("n") * self.ratio
        words = words.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n"))
        words = common.landed(words, "spelling-forms")
        roots = self._roots(words.filter("form IS NOT NULL").select("word", "form")).withColumnRenamed("word", "of")
        out = words.join(roots, F.col("word") == F.col("of"), "left")
        return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

    def _roots(self, edges: DataFrame) -> DataFrame:
        """word, root of the words with a form. Counts grow by `ratio` a step, so
        chains are short; each round doubles what is known of them."""
        up = common.landed(edges.select("word", F.col("form").alias("root")), "spelling-roots")
        while True:
            next_ = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
            more = common.landed(up.join(next_, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
            common.discard(up)
            up = more.drop("moved")
            up.landed_at = more.landed_at
            if more.filter("moved").isEmpty():
                return up


def _counting(least: int, every: int, size: int):
    def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.chunks(batches, size):
            runs = common.Words(b.column(1), lower=True, solid=letters)
            if not runs.n:
                continue
            codes, known = runs.coded()
            doc = np.repeat(np.arange(b.num_rows), runs.lengths())
            key, n = np.unique(doc << 32 | codes, return_counts=True)
            doc, code = key >> 32, key & 0xFFFFFFFF
            ids = [zlib.crc32(f"{'' if i is None else i}:".encode()) for i in b.column(0).to_pylist()]
            crc = zlib.crc32
            hashes = np.fromiter((crc(known[c], ids[d]) for c, d in zip(code.tolist(), doc.tolist(), strict=True)), np.int64, len(key))
            changed = hashes % every == 0
            total = np.bincount(code[~changed], weights=n[~changed], minlength=len(known)).astype(np.int64)
            others: Counter[str] = Counter()
            for c, h, m in zip(code[changed].tolist(), hashes[changed].tolist(), n[changed].tolist(), strict=True):
                run = known[c].decode()
                i = h % len(run)
                others[run[:i] + run[i + 1 :]] += m
            words = pa.concat_arrays([pa.array(known, pa.binary()).cast(pa.string()), pa.array(list(others), pa.string())])
            counts = pa.array(np.concatenate([total, np.fromiter(others.values(), np.int64, len(others))]))
            of = pc.and_(pc.greater_equal(pc.utf8_length(words), least), pc.greater(counts, 0))
            yield pa.RecordBatch.from_arrays([words, counts], names=["word", "n"]).filter(of)

    return counting


def _met(t: pa.Table) -> pa.Table:
    """The pairs of words of one edit among those of the same key, of a bucket."""
    _, key, rows = np.unique(t.column("key").to_numpy(), return_inverse=True, return_counts=True)
    role = t.column("role").to_numpy()
    posted = (role == BOTH) | (role == LISTED)
    some = np.flatnonzero((rows[key] > 1) & (np.bincount(key[posted], minlength=len(rows))[key] > 0))
    t, key, role, posted = t.take(pa.array(some)), key[some], role[some], posted[some]
    words = t.column("word").combine_chunks().dictionary_encode()
    names = words.dictionary
    of, rank = words.indices.to_numpy().astype(np.int64), np.empty(len(names), np.int64)
    rank[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
    s = Symbols(names)
    # the index: (key, gram, position) of every word under its own key
    held = np.flatnonzero(posted)
    n = s.lengths[of[held]] - Q + 1
    row, at = np.repeat(held, n), common.ragged(np.zeros(len(held), np.int64), n)
    listed = _place(key[row], s.grams[s.bounds[of[row]] + at], at)
    order = np.argsort(listed, kind="stable")
    listed, row = listed[order], row[order]
    # what each row looks up: a list a gram, two positions for words one longer
    longer = (role == LONGER).astype(np.int64)
    looks = np.flatnonzero(role != LISTED)
    n = s.lengths[of[looks]] - Q + 1
    who, at = np.repeat(looks, n), common.ragged(np.zeros(len(looks), np.int64), n)
    gram = s.grams[s.bounds[of[who]] + at]
    here, there = _place(key[who], gram, at), _place(key[who], gram, at + 1)
    lo, hi = np.searchsorted(listed, here), np.searchsorted(listed, here, side="right")
    lo2 = np.searchsorted(listed, there)
    hi2 = np.where(longer[who] == 1, np.searchsorted(listed, there, side="right"), lo2)
    size = hi - lo + hi2 - lo2
    # lists - T + 1: Q + 1 for words of the same length, Q for longer ones
    take = first_of(who, (at, size), Q + 1 - longer)
    who, lo, lo2, size, size1 = who[take], lo[take], lo2[take], size[take], (hi - lo)[take]
    some = size > 0
    who, lo, lo2, size, size1 = who[some], lo[some], lo2[some], size[some], size1[some]
    found = [np.zeros((2, 0), np.int64)]
    upto = np.cumsum(size)
    a = 0
    while a < len(who):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + AT_ONCE, side="right")))
        part = slice(a, b)
        first, second = row[common.ragged(lo[part], size1[part])], row[common.ragged(lo2[part], (size - size1)[part])]
        seeker = np.concatenate([np.repeat(who[part], size1[part]), np.repeat(who[part], (size - size1)[part])])
        merged = np.sort(seeker << 32 | np.concatenate([first, second]), kind="stable")
        merged = merged[np.append(True, merged[1:] != merged[:-1])[: len(merged)]]
        x, y = of[merged >> 32], of[merged & 0xFFFFFFFF]
        more = longer[merged >> 32] == 1
        fit = np.where(more, s.lengths[y] == s.lengths[x] + 1, (s.lengths[y] == s.lengths[x]) & (rank[x] < rank[y]))
        x, y = x[fit], y[fit]
        good = one_edit(s, x, y)
        found.append(np.stack([x[good], y[good]]))
        a = b
    x, y = np.unique(np.concatenate(found, axis=1), axis=1)
    n = np.zeros(len(names), np.int64)
    n[of] = t.column("n").to_numpy()
    left, right = np.append(x, y), np.append(y, x)
    return pa.table([names.take(pa.array(left)), names.take(pa.array(right)), pa.array(n[right])], names=["word", "near", "n"])


def _place(key: np.ndarray, gram: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One number for (key, gram, position); far positions only share lists."""
    return key << 42 | gram << 22 | at & _PART


def one_edit(s: Symbols, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs differ by one edit; y is as long as x or one longer. First
    those with enough common grams are chosen."""
    longer = s.lengths[y] > s.lengths[x]
    need = s.lengths[y] - 2 * Q + 1
    n = s.lengths[x] - Q + 1
    pair, at = np.repeat(np.arange(len(x)), n), common.ragged(np.zeros(len(x), np.int64), n)
    gx, iy = s.grams[s.bounds[x][pair] + at], s.bounds[y][pair] + at
    same = (gx == s.grams[iy]) | (longer[pair] & (gx == s.grams[np.minimum(iy + 1, len(s.grams) - 1)]))
    some = np.flatnonzero(np.bincount(pair[same], minlength=len(x)) >= need)
    x, y, longer = x[some], y[some], longer[some]
    n = s.lengths[x]
    pair, at = np.repeat(np.arange(len(x)), n), common.ragged(np.zeros(len(x), np.int64), n)
    cx, iy = s.flat[s.bounds[x][pair] + at], s.bounds[y][pair] + at
    differ = cx != s.flat[iy]
    # letters before the first difference; from there on they must move by one
    begins = np.minimum.reduceat(np.where(differ, at, n[pair]), np.cumsum(n) - n) if len(x) else n
    late = (at >= begins[pair]) & (cx != s.flat[np.minimum(iy + 1, len(s.flat) - 1)])
    ok = np.where(longer, np.bincount(pair[late], minlength=len(x)) == 0, np.bincount(pair[differ], minlength=len(x)) == 1)
    return some[ok]
