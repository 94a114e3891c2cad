"""Sharding (6): k-d tree partitioning by bytes.

Documents with equal texts are one point: its weight is their bytes, its
dimensions are metadata (size, place of the smallest identifier, language,
source). From the root down, each node is split along its widest dimension, as
a share of the root's width, at the weighted median, until the leaves are as
many as the shards and so reach the target bytes. Medians come from distributed
histograms: sums of bytes by 1024 bins of the split key, then by 1024 bins of
the bin that holds the middle, until that bin is a small share of the node or
one point. All nodes of a level share each histogram; at most 1024 sums a node
come to the driver. Ties along a dimension are split by the point's hash.

Slots count a shard's documents from 0: row numbers within even hash ranges of
the identifier plus the sums of the ranges before.

Defined results: a null text weighs 1 byte and is a point with the empty texts;
a text of any length is one point; identifiers are integers, and null metadata
count as 0; a point heavier than a shard makes that shard large, since equal
texts stay together; of dimensions of one width the first named is split;
repeated rows have slots of their own; an empty table gives no rows; the number
of shards is a power of two; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

DIMENSIONS = ("d_size", "d_place", "d_lang", "d_source")
BINS = 1024
ROWS_A_RANGE = 50_000


def by_node(values: list[int], node: str = "node") -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), (F.col(node) + 1).cast("int"))


class KdShards:
    def __init__(self, docs: DataFrame, shards: int = 16, tolerance: float = 0.0005, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source"):
        if shards & (shards - 1) or shards < 1:
            raise ValueError("the number of shards must be a power of two")
        self.shards, self.tolerance = shards, tolerance
        text = F.coalesce(F.col(text_col), F.lit(""))
        code = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.shiftrightunsigned(F.xxhash64(F.col(c)), 33))
        rows = docs.select(
            F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc32"), F.xxhash64(text).alias("point"),
            code(lang_col).alias("lang"), code(source_col).alias("source"), F.monotonically_increasing_id().alias("place"),
        )
        self.rows = common.landed(rows, "shard-rows")
        points = self.rows.groupBy("point").agg(F.sum("size").alias("w"), F.max("size").alias("bytes"), F.min("id").alias("first"), F.min("lang").alias("d_lang"), F.min("source").alias("d_source"))
        edge = self.rows.agg(F.min("id").alias("lo"), F.max("id").alias("hi")).first()
        width = max(1, (edge["hi"] or 0) - (edge["lo"] or 0))
        points = points.select(
            "point", "w", "d_lang", "d_source", (F.log2("bytes") * (1 << 25)).cast("long").alias("d_size"),
            F.coalesce(((F.col("first") - F.lit(edge["lo"] or 0)).cast("double") / width * ((1 << 31) - 1)).cast("long"), F.lit(0)).alias("d_place"),
        )
        self.points = common.landed(points, "shard-points")
        self.tree: list[list[tuple[str, int]]] = []  # by level, of each node: dimension, last key of its left half

    def _keyed(self, dims: list[str]) -> Column:
        """31 bits of the node's dimension, then 32 of the point's hash."""
        at = F.lit(0).cast("long")
        for i, d in enumerate(dims):
            at = F.when(F.col("node") == i, F.col(d)).otherwise(at)
        return F.shiftleft(at, 32) + F.shiftrightunsigned(F.xxhash64("point"), 32)

    def build(self) -> DataFrame:
        """The points with their leaf as `node`."""
        at, root, n = self.points.withColumn("node", F.lit(0)), None, 1
        while n < self.shards:
            stats = {r["node"]: r for r in at.groupBy("node").agg(F.sum("w").alias("w"), *[f(d).alias(f"{t}_{d}") for d in DIMENSIONS for f, t in ((F.min, "lo"), (F.max, "hi"))]).collect()}
            root = root or stats.get(0)
            dims = []
            for i in range(n):
                s = stats.get(i)
                wide = lambda d, s=s: (s[f"hi_{d}"] - s[f"lo_{d}"]) / max(1, root[f"hi_{d}"] - root[f"lo_{d}"])
                dims.append(max(DIMENSIONS, key=wide) if s else DIMENSIONS[0])
            keyed = common.landed(at.withColumn("key", self._keyed(dims)), "shard-keys")
            cuts = self._medians(keyed, n, stats)
            self.tree.append(list(zip(dims, cuts, strict=True)))
            before, at = at, common.landed(keyed.withColumn("node", F.col("node") * 2 + (F.col("key") > by_node(cuts)).cast("int")).drop("key"), "shard-level")
            common.discard(keyed, before)
            n *= 2
        return at

    def _medians(self, keyed: DataFrame, n: int, stats: dict) -> list[int]:
        lo, hi = [0] * n, [(1 << 63) - 1] * n
        below, cut, open_ = [0] * n, [0] * n, {i for i in range(n) if i in stats}
        while open_:
            step = [(h - low) // BINS + 1 for low, h in zip(lo, hi, strict=True)]
            inside = keyed.filter((F.col("key") >= by_node(lo)) & (F.col("key") <= by_node(hi)) & F.col("node").isin(list(open_)))
            bins = inside.withColumn("lo", by_node(lo)).withColumn("step", by_node(step)).groupBy("node", F.expr("(key - lo) div step").alias("bin"))
            found: dict[int, list] = {}
            for r in bins.agg(F.sum("w").alias("w"), F.min("key").alias("first"), F.max("key").alias("last")).collect():
                found.setdefault(r["node"], []).append((r["first"], r["last"], r["w"]))
            for i in list(open_):
                total, seen = stats[i]["w"], below[i]
                for first, last, w in sorted(found[i]):
                    if (seen + w) * 2 >= total:
                        lo[i], hi[i], below[i] = first, last, seen
                        nearer_after = (seen + w) * 2 - total <= total - 2 * seen
                        cut[i] = last if nearer_after else first - 1
                        if first == last or w <= self.tolerance * total:
                            open_.discard(i)
                        break
                    seen += w
        return cut

    def assigned(self) -> DataFrame:
        """id, size, crc32, shard, slot."""
        leaves = self.build()
        placed = self.rows.join(leaves.select("point", F.col("node").alias("shard")), "point")
        placed = common.landed(placed.select("id", "size", "crc32", "shard", "place"), "shard-placed")
        common.discard(leaves)
        ranges = placed.count() // (self.shards * ROWS_A_RANGE) + 1
        placed = placed.withColumn("range", F.pmod(F.xxhash64("id", "place"), F.lit(ranges)))
        sums = placed.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
        sums = sums.select("shard", "range", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
        slot = F.row_number().over(Window.partitionBy("shard", "range").orderBy("id", "place")) - 1
        return placed.withColumn("slot", slot).join(sums, ["shard", "range"]).select("id", "size", "crc32", "shard", (F.col("slot") + F.col("base")).alias("slot"))
