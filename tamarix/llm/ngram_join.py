"""N-gram Jaccard join (4): multiple-global-order filtering.

Documents whose sets of word shingles have a Jaccard similarity of t or more
are linked. A shingle travels as 64 bits made from keyed hashes of its words, a
set is known by the 128-bit digest of two such hashes of each of its shingles, so
copies are one set from the start. The key is drawn once for a join, on the
driver, so no text can be written whose shingles are taken for one another; the
result doesn't depend on it, but for the chance that two of a corpus' shingles
that matter meet in 64 bits. A set's size is exact: where the two hashes of its
shingles don't tell as many apart, shingles are numbered by their words. Whether
two sets are linked is decided on the words of a text of each.

Order 1, ascending hash. With d = n - ceil(t n), two linked sets share at least
min(d + 1 of either) members of their 2 d + 1 first ones. Only these members
travel: each chunk of documents sends one packed blob to each bucket of
shingles, a member once with its count however many sets of the chunk have it;
the bucket sums in how many documents of all chunks a member occurs and tells
the chunk which are shared.

Order 2, ascending document frequency. Of its members under order 1 a document
keeps those that come first by frequency, as many as the number that must be
shared leaves necessary; members in one document only are never sent on. Most
documents end here: too few of their members are shared. Candidates meet at the
members kept.

Each set has a sketch of 1024 bits, the parities of its members by hash; two
sets differ in at least as many members as their sketches in bits, so a pair
whose sketches differ by more than a link allows goes no further.

Order 3, descending hash. A candidate must also share a member of the d + 1
last ones; only what passes this is joined with the texts and compared.

A first round compares every set of a member with two leaders of it and merges
what is linked; later ones compare representatives of a member's components, one
pair for two components a round; at last all sets of a member that are still in
different components are compared, in blocks. A
pair that meets at many members goes out at the first of them only (as far as
eight of each set's members tell), so at the others the sets that come first at
the same member needn't meet: of these classes and the components, the largest
one of a member meets only what is outside of it. A member with many sets is dealt over tasks in all these
joins, by the order of its document frequency. So a group of thousands of near
copies needs few comparisons a set, and no link between components is lost. For
sets of a group that aren't linked, the last comparison grows with the square of
their number. Components come from alternating large-star
and small-star steps over the links between the components known so far.

Defined results: null texts and texts without words have the empty set and are
linked with nothing; texts with fewer words than a shingle are one shingle;
texts of any length take part whole; a null identifier is no label (a component
of null identifiers only has none); rows may repeat, those with the same
identifier are documents of their own; a similarity of exactly t links; an empty
table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Members of a bucket; bytes of a word, for an estimate of these.
TOKENS_A_BUCKET, BYTES_A_WORD = 1_000_000, 6
FIRST = 8
SKETCH = [f"s{i}" for i in range(16)]
#: Sets of a member that one task takes at once.
BLOCK = 512


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])[: len(values)]]


def shingle_sets(texts: pa.Array, k: int, key: bytes) -> tuple[list[np.ndarray], list[int], list[bytes], common.Words]:
    """The sorted distinct shingle hashes of each text, the sets' sizes and
    digests, and the words."""
    words = common.Words(texts, lower=True)
    own, other = common.keyed_hashes(words, key)
    of, check = common.rolled(own, k), common.rolled(other, k, salt=2)
    sets, sizes, keys = [], [], []
    bounds = words.bounds.tolist()
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        n = hi - lo
        if n >= k:
            h, c = of[lo : hi - k + 1], check[lo : hi - k + 1]
        else:
            h, c = (common.rolled(own[lo:hi], n, salt=1), common.rolled(other[lo:hi], n, salt=3)) if n else (own[:0], other[:0])
        h, c = distinct(h), distinct(c)
        sets.append(h)
        sizes.append(len(h) if len(h) == len(c) else len(distinct(common.run_ranks(words.coded()[0][lo:hi], k))))
        keys.append(xxhash.xxh3_128_digest(h.tobytes() + c.tobytes()))
    return sets, sizes, keys, words


def ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def parities(members: np.ndarray) -> np.ndarray:
    """The sketch, as 16 longs."""
    odd = np.bincount((members >> np.uint64(7)).astype(np.int64) & 1023, minlength=1024) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


class Bounds:
    """How many members count, for sets of n (numpy arrays); percent = 100 t."""

    def __init__(self, n: np.ndarray, percent: int):
        need = lambda m: -(-m * percent // 100)
        self.spare = n - need(n)
        self.first = np.minimum(n, 2 * self.spare + 1)
        smallest = need(n)
        self.shared = np.minimum(self.spare, smallest - need(smallest)) + 1
        self.kept = self.first - self.shared + 1


class NgramJaccardJoin:
    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, rounds: int = 3, chunk_bytes: int = 4_000_000):
        self.spark, self.k, self.percent, self.rounds, self.chunk_bytes = docs.sparkSession, k, percent, rounds, chunk_bytes
        common.ship(self.spark)
        self.key = secrets.token_bytes(32)
        self.docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def _scattered(self, buckets: int) -> DataFrame:
        """Rows (part, chunk, a, b, c, docs). part >= 0: a bucket's members of the
        chunk, their counts, and the place of the only set that has one, or where
        in the chunk's list the sets of a member with several begin. part < 0:
        the chunk's keys, sizes and that list, and its documents (id, n, key)."""
        k, size, percent, secret = self.k, self.chunk_bytes, self.percent, self.key

        def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chunk = TaskContext.get().partitionId() << 32
            for b in common.chunks(batches, size):
                sets, sizes, keys, _ = shingle_sets(b.column(1), k, secret)
                docs = ipc(pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int32()), pa.array(keys, pa.binary())], names=["id", "n", "key"]))
                found = {key: s for key, s in zip(keys, sets, strict=True) if len(s)}
                sets = list(found.values())
                n = np.array([len(s) for s in sets], np.int64)
                first = Bounds(n, percent).first
                members = np.concatenate([s[:q] for s, q in zip(sets, first.tolist(), strict=True)]) if sets else np.zeros(0, np.uint64)
                places = np.repeat(np.arange(len(sets), dtype=np.uint32), first)
                by = np.lexsort((members, members % np.uint64(buckets)))
                members, places = members[by], places[by]
                new = np.flatnonzero(np.append(True, members[1:] != members[:-1])[: len(members)])
                counts = np.diff(np.append(new, len(members)))
                many = counts > 1
                held = places[np.repeat(many, counts)]
                at = np.where(many, np.cumsum(np.where(many, counts, 0)) - counts, places[new]).astype(np.uint32)
                members, counts = members[new], counts.astype(np.uint32)
                part = (members % np.uint64(buckets)).astype(np.int64)
                cut = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)]).tolist()
                rows = [(-1 - chunk, chunk, b"".join(found), n.astype(np.uint32).tobytes(), held.tobytes(), docs)]
                rows += [(int(part[lo]), chunk, members[lo:hi].tobytes(), counts[lo:hi].tobytes(), at[lo:hi].tobytes(), None) for lo, hi in zip(cut, [*cut[1:], len(part)], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), *[pa.binary()] * 4), strict=True)], names=["part", "chunk", "a", "b", "c", "docs"])
                chunk += 1

        return self.docs.mapInArrow(scatter, "part long, chunk long, a binary, b binary, c binary, docs binary")

    def _sets(self, buckets: int) -> DataFrame:
        """id, n, key of every document; and n, key, members, grades (no id; `doc`
        is false): what a set must be compared by, for sets that share enough
        members with others. A grade is 4 log2 of a frequency."""
        percent = self.percent

        def counted(t: pa.Table) -> pa.Table:
            wire = ("chunk", "a", "b", "c", "d", "docs")
            if t.column("part")[0].as_py() < 0:
                return pa.table([t.column("chunk"), t.column("a"), t.column("b"), t.column("c"), pa.nulls(t.num_rows, pa.binary()), t.column("docs")], names=wire)
            a, b, c = (t.column(x).to_pylist() for x in "abc")
            members = np.concatenate([np.frombuffer(x, np.uint64) for x in a])
            by = np.argsort(members, kind="stable")
            new = np.append(True, members[by][1:] != members[by][:-1])
            total = np.add.reduceat(np.concatenate([np.frombuffer(x, np.uint32) for x in b])[by].astype(np.int64), np.flatnonzero(new))
            of = np.empty(len(members), np.int64)
            of[by] = total[np.cumsum(new) - 1]
            grade = np.minimum(255, 4 * np.log2(of)).astype(np.uint8)
            out, at = [], 0
            for chunk, x, y, z in zip(t.column("chunk").to_pylist(), a, b, c, strict=True):
                s = slice(at, at + len(x) // 8)
                shared = of[s] > 1
                if shared.any():
                    out.append((chunk, members[s][shared].tobytes(), np.frombuffer(y, np.uint32)[shared].tobytes(), np.frombuffer(z, np.uint32)[shared].tobytes(), grade[s][shared].tobytes()))
                at = s.stop
            cols = zip(*out, strict=True) if out else ([],) * 5
            cols = [pa.array(x, kind) for x, kind in zip(cols, (pa.int64(), *[pa.binary()] * 4), strict=True)]
            return pa.table([*cols, pa.nulls(len(out), pa.binary())], names=wire)

        def chosen(t: pa.Table) -> pa.Table:
            rows = list(zip(*(t.column(c).to_pylist() for c in "abcd"), strict=True))
            keys, sizes, held = next(x[:3] for x in rows if x[3] is None)
            docs = pa.ipc.open_stream(t.column("docs").drop_null()[0].as_py()).read_all()
            n, held = np.frombuffer(sizes, np.uint32).astype(np.int64), np.frombuffer(held, np.uint32)
            limit = Bounds(n, percent)
            rows = [x for x in rows if x[3] is not None]
            members, counts, at, grade = (np.concatenate([np.frombuffer(x[i], kind) for x in rows]) if rows else np.zeros(0, kind) for i, kind in enumerate((np.uint64, np.uint32, np.uint32, np.uint8)))
            places = np.repeat(at, counts)
            many = np.repeat(counts > 1, counts)
            places[many] = held[common.ragged(at[counts > 1], counts[counts > 1])]
            members, grade = np.repeat(members, counts), np.repeat(grade, counts)
            by = np.lexsort((members, grade, places))
            members, places, grade = members[by], places[by], grade[by]
            met = np.bincount(places, minlength=len(n))
            take = np.where(met >= limit.shared, limit.kept - (limit.first - met), 0)
            take = np.clip(take, 0, met)
            starts = np.cumsum(met) - met
            rows_of = np.flatnonzero(take)
            picked = common.ragged(starts[rows_of], take[rows_of])
            cut = pa.array(np.append(0, np.cumsum(take[rows_of])), pa.int32())
            lists = [pa.ListArray.from_arrays(cut, pa.array(x)) for x in (members[picked].view(np.int64), grade[picked].astype(np.int32))]
            m, d = len(rows_of), docs.num_rows
            kinds = pa.schema([("doc", pa.bool_()), ("id", docs.schema.field("id").type), ("n", pa.int32()), ("key", pa.binary()), ("members", lists[0].type), ("grades", lists[1].type)])
            found = [pa.array([False] * m), pa.nulls(m, kinds.field("id").type), pa.array(n[rows_of], pa.int32()), pa.array([keys[16 * i : 16 * i + 16] for i in rows_of.tolist()], pa.binary()), *lists]
            every = [pa.array([True] * d), *docs.columns, *(pa.nulls(d, x.type) for x in lists)]
            return pa.concat_tables([pa.table(every, schema=kinds), pa.table(found, schema=kinds)])

        kind = self.docs.schema["id"].dataType.simpleString()
        shared = self._scattered(buckets).groupBy("part").applyInArrow(counted, "chunk long, a binary, b binary, c binary, d binary, docs binary")
        return shared.groupBy("chunk").applyInArrow(chosen, f"doc boolean, id {kind}, n int, key binary, members array<long>, grades array<int>")

    def _full(self, sets: DataFrame, wanted: DataFrame) -> DataFrame:
        """key, the words of a text, the last members and the sketch of the
        wanted sets."""
        k, size, percent, secret = self.k, self.chunk_bytes, self.percent, self.key

        def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in common.chunks(batches, size):
                found, _, keys, words = shingle_sets(b.column(0), k, secret)
                sketch = np.stack([parities(s) for s in found])
                texts = [squeezed(words, lo, hi) for lo, hi in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True)]
                ends = [s[len(s) - 1 - (len(s) - -(-len(s) * percent // 100)) :].view(np.int64) for s in found]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(texts, pa.binary()), pa.array(ends, pa.list_(pa.int64())), *(pa.array(x) for x in sketch.T.copy())], names=["key", "whole", "last", *SKETCH])

        reps = sets.join(wanted, "key", "left_semi").groupBy("key").agg(F.min("id").alias("rep")).select("rep").distinct()
        # reps grow with the documents: a shuffle at every size
        texts = self.docs.join(reps.hint("merge"), F.col("id").eqNullSafe(F.col("rep")), "left_semi").select("text")
        found = texts.mapInArrow(full, "key binary, whole binary, last array<long>, " + ", ".join(f"{c} long" for c in SKETCH)).join(wanted, "key", "left_semi")
        return common.landed(found.dropDuplicates(["key"]), "join-full")

    def _linked(self, pairs: DataFrame, full: DataFrame) -> DataFrame:
        """The pairs (a, b, root_a, root_b) that are linked, as (a, b) of the
        components they join."""
        percent, k = self.percent, self.k

        def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.select([0, 1]).take(pa.array(similar(b.column(2), b.column(3), k, percent)))

        side = lambda c, x: full.select(F.col("key").alias(x), F.col(c).alias(f"{c}_{x}"))
        near = pairs.join(side("last", "b"), "b").join(side("last", "a"), "a").filter(F.arrays_overlap("last_a", "last_b")).drop("last_a", "last_b")
        both = near.join(side("whole", "b"), "b").join(side("whole", "a"), "a")
        found = both.select("root_a", "root_b", "whole_a", "whole_b").mapInArrow(linked, "root_a binary, root_b binary")
        return found.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))

    def components(self) -> DataFrame:
        """id, n, component: one row per document."""
        members = common.text_bytes(self.docs) / BYTES_A_WORD * 2 * (100 - self.percent) / 100
        buckets = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), int(members) // TOKENS_A_BUCKET + 1)
        every = common.landed(self._sets(buckets), "join-sets")
        sets = every.filter("doc").select("id", "n", "key")
        survivors = common.landed(every.filter("NOT doc").select("key", "n", "members", "grades").dropDuplicates(["key"]), "join-survivors")
        met = self._posts(survivors)
        full = self._full(sets, met.select("key").distinct())
        first = met.groupBy("key").agg(F.slice(F.sort_array(F.collect_list(place())), 1, FIRST).alias("first"))
        posts = common.landed(met.join(full.drop("whole", "last"), "key").join(first, "key"), "join-sketched")
        common.discard(survivors, met)
        roots = None  # of the sets that are linked: key, root
        for nth, last in enumerate([False] * self.rounds + [True]):
            pairs = common.landed(self._pairs(posts, roots, nth, last), "join-pairs")
            links = common.landed(self._linked(pairs, full), "join-links")
            merged = connected(links)
            common.discard(pairs, links)
            if roots is None:
                roots = merged
                continue
            higher = merged.select(F.col("key").alias("root"), F.col("root").alias("top"))
            moved = roots.join(higher, "root", "left").select("key", F.coalesce("top", "root").alias("root"))
            both = common.landed(moved.unionByName(merged.join(roots.select("key"), "key", "left_anti")), "join-roots")
            common.discard(roots, merged)
            roots = both
        common.discard(posts, full)
        lowest = sets.filter("n > 0").groupBy("key").agg(F.min("id").alias("low")).join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
        lowest = common.landed(lowest, "join-lowest")
        named = lowest.join(lowest.groupBy("root").agg(F.min("low").alias("component")), "root").select("key", "component")
        grouped = sets.filter("n > 0").join(named, "key").select("id", "n", "component")
        return grouped.unionByName(sets.filter("n = 0").select("id", "n", F.col("id").alias("component")))

    def _posts(self, survivors: DataFrame) -> DataFrame:
        """member, blocks, block, key, n; of members with the same sets, one is
        enough. A member's sets are dealt over blocks, as many as its frequency
        tells."""
        each = survivors.select("key", "n", F.explode(F.arrays_zip("members", "grades")).alias("of")).select("key", "n", F.col("of.members").alias("member"), F.ceil(F.pow(F.lit(2.0), F.col("of.grades") / 4) / BLOCK).cast("int").alias("blocks"))
        each = each.withColumn("block", F.pmod(F.xxhash64("key", F.lit(2)), F.col("blocks")).cast("int"))
        of_key = F.xxhash64("key").cast("decimal(38,0)")
        lists = each.groupBy("member").agg(F.count(F.lit(1)).alias("sets"), F.max("blocks").alias("blocks"), F.sum(of_key).alias("p"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("q")).filter("sets > 1")
        one = lists.groupBy("sets", "p", "q").agg(F.min(F.struct("member", "blocks")).alias("of")).select("of.member", F.explode(F.sequence(F.lit(0), F.col("of.blocks") - 1)).alias("block"))
        return common.landed(each.join(one, ["member", "block"]), "join-posts")

    def _pairs(self, posts: DataFrame, roots: DataFrame | None, nth: int, last: bool) -> DataFrame:
        """Distinct pairs a < b, with their components, of sets in different
        components that meet at a member: each with its member's leaders, or all
        with all."""
        of = posts.withColumn("root", F.col("key")) if roots is None else posts.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
        there = {c: f"{c}_2" for c in ("key", "n", "root", "first", *SKETCH)}
        upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        if last:
            # classes of a member's sets within which no pair goes out here: a component, and the sets whose first place is the same
            # and not here. No pair has both sets in the largest one: all sets meet those outside of it, in cells
            early = F.element_at("first", 1)
            own, same = F.struct("root", F.lit(None).cast("long").alias("place")), F.struct(F.lit(None).cast("binary").alias("root"), early.alias("place"))
            classes = of.select("member", "blocks", F.explode(F.when(early < place(), F.array(own, same)).otherwise(F.array(own))).alias("of"))
            sizes = classes.groupBy("member", "of").agg(F.count(F.lit(1)).alias("in_class"), F.max("blocks").alias("blocks"))
            sizes = sizes.groupBy("member").agg(F.max(F.struct("in_class", "of")).alias("most"), F.max("blocks").alias("blocks"), F.sum(F.when(F.col("of.place").isNull(), F.col("in_class"))).alias("sets")).filter("sets > most.in_class")
            outside = F.col("sets") - F.col("most.in_class")
            sizes = sizes.select("member", "most.of", F.ceil(F.col("sets") / BLOCK).cast("int").alias("rows"), F.ceil(outside / BLOCK).cast("int").alias("cols"), upto("blocks").alias("block"))
            open_ = of.join(sizes, ["member", "block"]).withColumn("inside", F.coalesce(F.col("of.root") == F.col("root"), F.col("of.place") == early))
            dealt = lambda c: F.pmod(F.xxhash64("key", F.lit(3)), F.col(c)).cast("int")
            left = open_.withColumn("row", dealt("rows")).withColumn("col", upto("cols")).select("member", "row", "col", "inside", "key", "n", "root", "first", *SKETCH)
            right = open_.filter("NOT inside").withColumn("col", dealt("cols")).withColumn("row", upto("rows")).select("member", "row", "col", *there).withColumnsRenamed(there)
            met, apart = left.join(right, ["member", "row", "col"]), F.col("inside") | (F.col("key") < F.col("key_2"))
        else:
            # each member has leaders of its own, later among its components' representatives
            by = F.xxhash64("member", "key", F.lit(nth)) if nth else F.col("key")
            if nth:
                rep = F.struct("key", "n", "first", *SKETCH)
                of = of.groupBy("member", "root").agg(F.max("blocks").alias("blocks"), F.min_by(rep, by).alias("rep")).select("member", "root", "blocks", "rep.*")
                of = of.withColumn("block", F.pmod(F.xxhash64("root", F.lit(2)), F.col("blocks")).cast("int"))
            lead = F.struct("root", "key", "n", "first", *SKETCH)
            leads = of.groupBy("member").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("blocks").alias("blocks"), F.array_distinct(F.array(F.min_by(lead, by), F.max_by(lead, by))).alias("leads")).filter("lo <> hi")
            others = leads.select("member", upto("blocks").alias("block"), "leads").select("member", "block", F.explode("leads").alias("lead")).select("member", "block", "lead.*").withColumnsRenamed(there)
            met, apart = of.join(others, ["member", "block"]), F.col("key") != F.col("key_2")
        differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_2"))) for c in SKETCH[1:]), F.bit_count(F.col(SKETCH[0]).bitwiseXOR(F.col(f"{SKETCH[0]}_2"))))
        near = (F.least("n", "n_2") * 100 >= F.greatest("n", "n_2") * self.percent) & (differ * (100 + self.percent) <= (F.col("n") + F.col("n_2")) * (100 - self.percent))
        good = apart & (F.col("root") != F.col("root_2")) & near
        if last:  # a pair goes out where it meets first, as far as `first` tells
            good = good & (F.coalesce(F.array_min(F.array_intersect("first", "first_2")), place()) >= place())
        a, b = F.struct(F.col("key").alias("key"), F.col("root").alias("root")), F.struct(F.col("key_2").alias("key"), F.col("root_2").alias("root"))
        two = met.filter(good).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        if nth and not last:  # a pair for two components
            two = two.withColumn("lo", F.least("a.root", "b.root")).withColumn("hi", F.greatest("a.root", "b.root"))
            two = two.groupBy("lo", "hi").agg(F.min_by(F.struct("a", "b"), F.xxhash64("a.key", "b.key", F.lit(nth))).alias("ab")).select("ab.*")
        two = two.select(F.col("a.key").alias("a"), F.col("b.key").alias("b"), F.col("a.root").alias("root_a"), F.col("b.root").alias("root_b"))
        return two if nth and not last else two.distinct()


def place() -> Column:
    """An order of the members at which pairs meet."""
    return F.xxhash64("member", F.lit(-1))


def squeezed(words: common.Words, lo: int, hi: int) -> bytes:
    """Words lo .. hi - 1, joined by one space."""
    data, at = words.packed, words.offsets[lo : hi + 1]
    return b" ".join(data[s:e].tobytes() for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def similar(a: pa.Array, b: pa.Array, k: int, percent: int) -> np.ndarray:
    """Which of the pairs of texts (words joined by one space) are linked, by the
    words themselves."""
    # a text often is in many pairs
    texts = pa.concat_arrays([a, b]).dictionary_encode()
    which = texts.indices.to_numpy(zero_copy_only=False)
    words = common.Words(texts.dictionary)
    doc = np.repeat(np.arange(len(words.bounds) - 1), words.lengths())
    runs = common.run_ranks(words.coded()[0], k)
    short = words.lengths() < k
    at = np.flatnonzero((doc[: len(runs)] == doc[k - 1 :][: len(runs)])) if len(runs) else np.zeros(0, np.int64)
    key = np.unique(doc[at] << 32 | runs[at])
    edges = np.searchsorted(key >> 32, np.arange(len(words.bounds)))
    sizes = np.where(short, 1, np.diff(edges))
    x, y = which[: len(a)].astype(np.int64), which[len(a) :].astype(np.int64)
    # the members of x's sets, looked up among y's
    counts = np.diff(edges)[x]
    pair = np.repeat(np.arange(len(x)), counts)
    wanted = y[pair] << 32 | (key[common.ragged(edges[x], counts)] & 0xFFFFFFFF)
    found = np.searchsorted(key, wanted)
    hit = np.append(key, -1)[found] == wanted
    both = np.bincount(pair[hit], minlength=len(x))
    both = np.where(short[x] | short[y], x == y, both)
    return np.flatnonzero(100 * both >= percent * (sizes[x] + sizes[y] - both))


def connected(links: DataFrame) -> DataFrame:
    """key, root (the smallest key of its component) of all ends of the landed
    links (a, b), by large-star and small-star steps until every key has one
    link, to a root."""
    now = links
    while True:
        ends = now.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")
        least = ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = common.landed(ends.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "join-large")
        # now u > v always
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        star = common.landed(small.filter("a <> b").distinct(), "join-star")
        common.discard(large, now if now is not links else None)
        now = star
        ends = now.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.lit(1).alias("up")), F.struct(F.col("b").alias("u"), F.lit(0).alias("up")))).alias("e")).select("e.*")
        # a key with two links up, or with links both ways
        if ends.groupBy("u").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).filter("ups > 1 or ups = 1 and least = 0").isEmpty():
            roots = now.select(F.col("a").alias("key"), F.col("b").alias("root"))
            roots = common.landed(roots.unionByName(roots.select(F.col("root").alias("key"), "root").distinct()), "join-merged")
            common.discard(now)
            return roots
