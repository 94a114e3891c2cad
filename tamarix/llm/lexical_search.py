"""Ranked lexical search (11): postings as a term-bucketed DataFrame.

Each chunk of documents gives a row for each of its terms, with the places of
the documents that hold the term and how often they do, and one row with the
identifiers and lengths of its documents. Documents lie in a chunk by ascending
identifier. Where the items are known, only their terms are posted. The rows go
to buckets by term, those of a term to as many as `SPREAD`, and are written.

Document frequencies and totals are sums over these rows. A term's weight goes
with it to the items that ask for it. Items are joined with the postings by
bucket and term; a match is scored once for all items that share its term; the
matches go back to their chunk, where they are summed by item and document; a
window numbers each item's documents, each task keeping its own first ones
before they are sent. All of this is in integers, but the logarithm.

Nothing grows with a term's frequency but the number of its rows, one a chunk,
which are dealt over buckets; sums of a document need no shuffle of matches,
since all of them are in its chunk. Asked terms are sent to all tasks only where
Spark knows them to be below its broadcast threshold.

Defined results: null texts and texts without a term are in no result and count
in no total; texts of any length are read whole; rows may repeat, those with the
same identifier are documents of their own; a null identifier is later than any
other; items with the same identifier, or none, are one item with the terms of
all; items without a term, and those with no match above 0, have no rows; equal
scores go by ascending identifier; empty tables give no rows; other columns are
not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .url_filter import LOWER, UPPER

#: What terms are made of, and the same for bytes.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM = np.ones(256, dtype=bool)
_TERM[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
#: Buckets of one term, and the most items of one row.
SPREAD, ITEMS = 16, 1000


def terms(text: Column) -> Column:
    """The different terms of a text."""
    return F.array_distinct(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0)))


class LexicalIndex:
    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wanted: DataFrame | None = None, chunk_bytes: int = 4_000_000):
        """The index of docs; of the terms in `wanted` (term) alone, if given."""
        spark = docs.sparkSession
        common.ship(spark)
        docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        id_type = docs.schema["id"].dataType.simpleString()
        rows = docs.mapInArrow(_posting(chunk_bytes), f"block long, term string, places array<int>, tfs array<int>, ids array<{id_type}>, ns array<int>")
        if wanted is not None:
            # a null term stands for a chunk's documents
            some = wanted.select("term").distinct().unionByName(spark.createDataFrame([(None,)], "term string"))
            rows = rows.alias("r").join(common.landed(some, "search-wanted").alias("w"), F.col("r.term").eqNullSafe(F.col("w.term")), "left_semi")
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.withColumn("part", F.pmod("block", F.lit(SPREAD)).cast("int")).withColumn("bucket", F.pmod(F.xxhash64(F.coalesce("term", F.col("block").cast("string")), "part"), F.lit(buckets)).cast("int"))
        self.rows = common.landed(rows.repartition(buckets, "bucket").sortWithinPartitions("term"), "search-postings")
        self.blocks = self.rows.filter("term IS NULL").select("block", "ids", "ns")
        self.postings = self.rows.filter("term IS NOT NULL").select("bucket", "part", "term", "block", "places", "tfs")

    def totals(self) -> tuple[int, int]:
        """Documents with a term, and all their terms with repeats."""
        some = F.aggregate("ns", F.lit(0).cast("long"), lambda s, n: s + (n > 0).cast("long"))
        all_ = F.aggregate("ns", F.lit(0).cast("long"), lambda s, n: s + n)
        r = self.blocks.agg(F.sum(some).alias("docs"), F.sum(all_).alias("length")).first()
        return r["docs"] or 0, r["length"] or 0

    def weights(self) -> DataFrame:
        """term, w of the terms that weigh something."""
        n, _ = self.totals()
        df = self.postings.groupBy("term").agg(F.sum(F.size("places").cast("long")).alias("df"))
        return df.select("term", F.floor(1000 * F.log((2.0 * n + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long").alias("w")).filter("w > 0")

    def search(self, items: DataFrame, id_col: str = "item_id", text_col: str = "text", k: int = 10) -> DataFrame:
        """item, rank, id, score: the k best documents of each item."""
        n, length = self.totals()
        asked = items.select(F.col(id_col).alias("item"), F.explode(terms(F.col(text_col))).alias("term")).distinct().join(self.weights(), "term")
        asked = common.landed(asked, "search-asked")
        parts = asked.groupBy("term").agg((F.count(F.lit(1)) / ITEMS).cast("int").alias("more"))
        asked = asked.join(parts, "term").groupBy("term", "w", F.pmod(F.xxhash64("item"), F.col("more") + 1).alias("nth")).agg(F.collect_list(F.struct("item")).alias("items"))
        asked = common.landed(asked.select("term", "w", "items", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part")), "search-asked-of")
        met = self.postings.select("part", "term", "block", "places", "tfs").join(asked, ["part", "term"]).drop("part", "term")
        met = met.repartition("block").join(self.blocks, "block")
        each = met.select("block", "w", "items", "ids", "ns", F.explode(F.arrays_zip("places", "tfs")).alias("p")).select("block", "w", "items", F.col("p.places").alias("place"), F.col("p.tfs").cast("long").alias("tf"), F.get("ids", F.col("p.places")).alias("id"), F.get("ns", F.col("p.places")).cast("long").alias("n"))
        each = each.withColumn("m", F.expr(f"10 + ((90 * n * {n}L) div {max(1, length)}L)"))
        each = each.select("block", "place", "id", "items", F.expr("w * ((1000000000 * tf) div (1000 * tf + 8 * m))").alias("gain")).filter("gain > 0")
        each = each.select("block", "place", "id", "gain", F.explode("items").alias("i")).select("block", "place", "id", "gain", F.col("i.item").alias("item"))
        found = each.groupBy("block", "item", "place").agg(F.sum("gain").alias("score"), F.first("id").alias("id"))
        best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "block", "place")
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("item", "rank", "id", "score")


def _posting(size: int):
    def posting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for b in common.chunks(batches, size):
            b = b.take(pc.sort_indices(b.column(0), null_placement="at_end"))
            words = common.Words(b.column(1), lower=True, solid=_TERM)
            coded = words.array.dictionary_encode()
            codes, doc = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(b.num_rows), words.lengths())
            key, tfs = np.unique(codes << 32 | doc, return_counts=True)
            code = key >> 32
            cut = np.searchsorted(code, np.arange(len(coded.dictionary) + 1))
            m = len(coded.dictionary)
            ends = lambda at: pa.array(np.append(at, at[-1]), pa.int32())  # noqa: E731  one list more, empty: the documents' row
            lists = [pa.ListArray.from_arrays(ends(cut), pa.array(x.astype(np.int32))) for x in (key & 0xFFFFFFFF, tfs)]
            own = pa.array(np.append(np.zeros(m + 1, np.int64), b.num_rows), pa.int32())
            lists += [pa.ListArray.from_arrays(own, b.column(0)), pa.ListArray.from_arrays(own, pa.array(words.lengths().astype(np.int32)))]
            term = pa.concat_arrays([coded.dictionary.cast(pa.large_string()), pa.nulls(1, pa.large_string())]).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m + 1, block)), term, *lists], names=["block", "term", "places", "tfs", "ids", "ns"])
            block += 1

    return posting
