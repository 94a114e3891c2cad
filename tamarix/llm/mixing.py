"""Mixing sources to target weights (5): weighted fair queueing.

Within its source each document has a place by the MD5 of its identifier, its
text's MD5 and a seed. Copy e (0, 1, 2) of a document begins after e * source
words + the words before it, and its virtual finish time is where it ends,
divided by the source's target. All copies are put in one global order by finish
time, and the mix is truncated at the total budget: all documents up to there
are whole, the one that the budget ends in is cut. Sources are served at rates
in proportion to their targets, so at virtual time 1 each has its target, but
for its one document then in service.

Copies that finish after the last of these documents can't be reached by the
budget and aren't sorted. Both orders are sorted by range, with running sums
within each range and a running sum over the ranges' totals (as many rows as
partitions). No task gets a whole source, however large.

Sources come by code point, null last, with weights 1, 2, 3, 1, ...; together
their targets are 100 % of all words. A target is at most `repeats` times its
source's words; what is above goes to the other sources by weight. The level
that settles this is the largest of (budget - caps of the k sources that cap
first) / (weights of the others).

Defined results: a null text or one without words has size 0 and is taken 0
times; a text of any length is one document; a null source is a source; null
identifiers are equal to each other; repeated rows are documents of their own,
those with equal identifiers and texts in the order of their places; equal
finish times go to the source that comes first; no words at all give targets of
0; an empty table gives no rows; columns of the input keep their names, whatever
these are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"
ROWS_A_RANGE = 1_000_000


class Mixture:
    """rows: place (row of the input as landed), id, source, size, and its
    source's size and target. entries(): the mix in order. taken(): words taken
    of each row. documents(): the mix as rows of the input."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3, seed: str = "mix-1", whole: bool = False):
        self.repeats, self.columns, self.text_col = repeats, docs.columns, text_col
        self.place = common.fresh(docs, "mix_place")
        size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
        key = F.substring(F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit(""))), F.lit(seed))), 1, 16)
        placed = docs.withColumn(self.place, F.monotonically_increasing_id())
        if whole:  # documents() needs the texts by place
            placed = self.landed = common.landed(placed, "mix-documents")
        sized = placed.select(F.col(self.place).alias("place"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key"))
        self.sized = common.landed(sized, "mix-sizes")
        self.sources = common.landed(self._targets(weights), "mix-sources")
        self.ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), self.repeats * self.sized.count() // ROWS_A_RANGE + 1)

    def _targets(self, weights: tuple[int, ...]) -> DataFrame:
        """rank, source, source_size, target."""
        by_source = self.sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
        w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
        s = by_source.withColumn("rank", rank).withColumn("weight", w).withColumn("cap", F.lit(self.repeats) * F.col("source_size"))
        first_capped = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
        every, before = Window.partitionBy(), first_capped.rowsBetween(Window.unboundedPreceding, -1)
        left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
        others = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
        s = s.withColumn("level", left.cast("double") / others.cast("double"))
        target = F.least(F.col("cap").cast("double"), F.col("weight").cast("double") * F.max("level").over(every))
        return s.select("rank", "source", "source_size", target.alias("target"))

    def _running(self, rows: DataFrame, order: list[str], out: str) -> DataFrame:
        """rows with the words (size) of all rows before them in this order."""
        rows = rows.repartitionByRange(self.ranges, *order).withColumn("range", F.spark_partition_id())
        rows = common.landed(rows, "mix-ranges")
        sums = rows.groupBy("range").agg(F.sum("size").alias("in_range"))
        earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
        sums = sums.select("range", F.coalesce(F.sum("in_range").over(earlier), F.lit(0)).alias("base"))
        within = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("so_far", F.coalesce(F.sum("size").over(within), F.lit(0))).join(sums, "range")
        return rows.withColumn(out, F.col("so_far") + F.col("base")).drop("range", "so_far", "base")

    def ordered(self) -> DataFrame:
        """The rows with the words of their source before them."""
        earlier = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)  # a row a source
        sources = self.sources.withColumn("base_words", F.coalesce(F.sum("source_size").over(earlier), F.lit(0)))
        rows = self.sized.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.place", "d.size", "d.key", "rank", "source_size", "target", "base_words")
        rows = self._running(rows, ["rank", "key", "size", "place"], "before")
        return rows.withColumn("before", F.col("before") - F.col("base_words")).drop("base_words", "key")

    def entries(self) -> DataFrame:
        """place, copy, words, finish, words_before: the mix in global order of
        virtual finish time, up to the total budget."""
        copies = self.ordered().filter("size > 0 and target > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(self.repeats - 1))))
        end = F.col("copy") * F.col("source_size") + F.col("before") + F.col("size")
        copies = copies.select("place", "rank", "copy", "size", "target", end.alias("end")).withColumn("finish", F.col("end").cast("double") / F.col("target"))
        copies = common.landed(copies, "mix-copies")
        # once all documents in service at time 1 are done, the budget is used up
        latest = copies.filter("end - size < target").agg(F.max("finish").alias("t")).first()["t"] or 0.0
        at = self._running(copies.filter(F.col("finish") <= latest), ["finish", "rank", "end"], "words_before")
        budget = self.sources.agg(F.sum("source_size").alias("budget"))
        at = at.crossJoin(F.broadcast(budget)).withColumn("words", F.least("size", F.col("budget") - F.col("words_before")))  # one row
        return at.filter("words > 0").select("place", "copy", "words", "finish", "words_before")

    def taken(self) -> DataFrame:
        taken = self.entries().groupBy("place").agg(F.sum("words").alias("taken"))
        rows = self.sized.alias("d").join(self.sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("place", "id", "d.source", "size", "source_size", "target")
        return rows.join(taken, "place", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))

    def documents(self) -> DataFrame:
        """A row for each entry; a document that is cut ends after its last word
        taken (its words then joined by one space)."""
        e = self.entries().select(F.col("place").alias(self.place), F.col("words").alias(f"{self.place}_words"))
        rows = self.landed.join(e, self.place)
        words, text = F.col(f"{self.place}_words"), F.col(f"`{self.text_col}`")
        cut = F.array_join(F.slice(F.filter(F.split(text, common.SPACES), lambda w: w != ""), 1, words.cast("int")), " ")
        text = F.when(F.regexp_count(text, F.lit(WORD)) > words, cut).otherwise(text)
        return rows.select(*[text.alias(c) if c == self.text_col else F.col(f"`{c}`") for c in self.columns])
