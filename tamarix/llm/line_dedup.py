"""Line dedup (1): a log-template tree, in DataFrame functions only.

A line goes down a tree of fixed depth: its number of words, then its leading
words, where a word with a digit counts as a field `<*>`. Within a leaf a word
is fixed at its position if more than `share` of the leaf's different lines have
it there; other words are fields too. A line with at least `similar` fixed words
belongs to the template of its fixed words and fields. Lines that this leaves go
one level further, to a leaf of the leaf: first by their next word, then, if
still left, by their last word; each of these gives a template alike, so a leaf
holds any number of them. A line in none is its own template. A template that an
earlier document (smaller identifier) has is recurring: its lines are dropped
from later documents.

Lines with no more words than the tree has levels end in its inner nodes, with no
word left to be a field: they recur as they are (a number alone is no boilerplate,
a word of it is).

Counts are combined in each task before they are sent, so a very common line
is one row a task; only different lines of leaves with two or more are taken
apart into words.

Defined results: lines end at \\n; white space in a line counts as one space; lines
without a word always stay; a null text has no lines and stays null, an empty one
has one line; texts of any length are read whole, in time linear in their lines;
a null identifier is later than none and its lines stay; repeats inside one
document stay; rows with equal identifier and text share their result; an empty
table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import once
from . import common

FIELD = "<*>"


#: Lines with these may have a field, or white space that is no space.
_ODD = r"[0-9\x09-\x0D]"
#: A word with a digit.
_NUMBERED = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"


class LineDedup:
    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 3, share: float = 0.5, similar: float = 0.6):
        self.depth, self.share, self.similar = depth, share, similar
        self.docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("k1", F.xxhash64("id", "text")).withColumn("k2", F.xxhash64("id", F.lit(7)))

    def _lines(self, docs: DataFrame) -> DataFrame:
        """id, k1, k2, pos, leaf, line, general of lines with words; a general
        line has fields for words with digits, unless it is short, and single
        spaces. A short line is a leaf of its own."""
        e = docs.select("id", "k1", "k2", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        even = lambda c: F.trim(F.regexp_replace(c, common.SPACES, " "))
        odd = even(F.regexp_replace("line", _NUMBERED, FIELD))
        uneven = F.startswith("line", F.lit(" ")) | F.endswith("line", F.lit(" ")) | F.contains("line", F.lit("  "))
        # once: else each use of the line would work it out again
        e = e.withColumn("general", once(F.when(uneven | F.col("line").rlike(_ODD), odd).otherwise(F.col("line"))))
        e = e.withColumn("words", once(F.octet_length("general") - F.octet_length(F.replace("general", F.lit(" "), F.lit(""))) + 1))
        head = F.substring_index("general", " ", self.depth)
        few = F.col("words") <= self.depth
        e = e.withColumn("general", once(F.when(few, even("line")).otherwise(F.col("general")))).filter("general <> ''")
        head = F.when(few, F.col("general")).otherwise(head)
        return e.select("id", "k1", "k2", "pos", F.xxhash64("words", head).alias("leaf"), F.xxhash64("general").alias("line"), "general")

    def _consensus(self, seen: DataFrame) -> DataFrame:
        """leaf, line, template of the lines that belong to a template."""
        leaves = seen.groupBy("leaf").agg(F.count(F.lit(1)).alias("lines")).filter("lines > 1")
        several = common.landed(seen.join(leaves, "leaf").select("leaf", "line", "lines", "rep.k1", "rep.k2"), "line-several")
        texts = self.docs.join(several.select("k1", "k2").distinct().hint("merge"), ["k1", "k2"], "left_semi")
        found = self._lines(texts).select("k1", "k2", "leaf", "line", "general").join(several, ["k1", "k2", "leaf", "line"])
        found = common.landed(found.dropDuplicates(["k1", "k2", "leaf", "line"]).select("leaf", "line", "lines", "general"), "line-general")
        words = F.transform(F.split("general", " "), lambda w: F.xxhash64(w))
        left, given = found.select("leaf", "line", words.alias("words")), []
        for nth, key in enumerate([F.col("leaf"), F.xxhash64("leaf", F.get("words", F.lit(self.depth))), F.xxhash64("leaf", F.element_at("words", -1), F.lit(1))]):
            tried = common.landed(self._templates(left.withColumn("part", key)), f"line-level-{nth}")
            given.append(tried.filter("template IS NOT NULL").select("leaf", "line", "template"))
            left = tried.filter("template IS NULL").select("leaf", "line", "words")
        return reduce(DataFrame.unionByName, given)

    def _templates(self, lines: DataFrame) -> DataFrame:
        """lines (leaf, line, words, part) with the template of their part, null
        for lines without one. The leading words are the leaf's, so only the
        others are counted."""
        field = F.xxhash64(F.lit(FIELD))
        sizes = lines.groupBy("part").agg(F.count(F.lit(1)).alias("lines")).filter("lines > 1")
        # once: not known as the part that the join dealt by, so a large part is counted by its words
        some = lines.join(sizes, "part").select("lines", "words", once(F.col("part")).alias("part"))
        each = some.select("part", "lines", F.posexplode(F.slice("words", self.depth + 1, F.size("words"))).alias("at", "word"))
        fixed = each.filter(F.col("word") != field).groupBy("part", "lines", "at", "word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > F.col("lines") * self.share)
        agreed = fixed.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct(F.col("at") + self.depth, "word"))).alias("agreed"))
        at = lines.join(sizes.join(agreed, "part", "left"), "part", "left")
        holds = lambda w, i: F.when(i < self.depth, w != field).otherwise(F.coalesce(F.col("agreed")[i] == w, F.lit(False)))
        at = at.withColumn("held", F.transform("words", lambda w, i: F.when(holds(w, i), w).otherwise(F.lit(0).cast("long"))))
        enough = F.col("lines").isNotNull() & (F.size(F.filter("held", lambda w: w != 0)) >= F.size("held") * self.similar)
        return at.select("leaf", "line", "words", F.when(enough, F.xxhash64("held")).alias("template"))

    def _recurring(self, lines: DataFrame) -> DataFrame:
        """leaf, line, first (the earliest document of its template), for lines
        of templates that a later document has too."""
        seen = lines.groupBy("leaf", "line").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")).alias("rep"), F.max("id").alias("high"))
        seen = common.landed(seen, "line-seen")
        of = seen.join(self._consensus(seen), ["leaf", "line"], "left").select("leaf", "line", F.col("rep.id").alias("low"), "high", F.coalesce("template", "line").alias("template"))
        first = of.groupBy("leaf", "template").agg(F.min("low").alias("first"))
        return of.join(first, ["leaf", "template"]).filter("first < high").select("leaf", "line", "first")

    def documents(self) -> DataFrame:
        """id, text, kept (the text without its recurring lines), n_lines, n_dropped."""
        mark = common.marked()
        lines = common.landed(self._lines(self.docs).drop("general"), "line-places")
        gone = lines.join(self._recurring(lines), ["leaf", "line"]).filter("first < id").groupBy("k1", "k2").agg(F.collect_set("pos").alias("gone"))
        rows = self.docs.join(common.landed_alone(gone, "line-gone", mark).hint("merge"), ["k1", "k2"], "left")
        rows = rows.withColumn("split", F.split("text", "\n", -1))
        places = F.array_except(F.sequence(F.lit(0), F.size("split") - 1), "gone")  # by a hash set: linear in the lines
        stays = F.array_join(F.transform(places, lambda i: F.col("split")[i]), "\n")
        return rows.select("id", "text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(stays).alias("kept"), F.coalesce(F.size("split"), F.lit(0)).alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_dropped"))
