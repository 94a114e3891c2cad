"""URL filters (13): exact rule lists by a cascade of Bloom filters, in DataFrame
functions only.

A rule `example.org/es/` holds for its host and all hosts below it, for paths
that begin with its path; the longest rule that fits a url decides. So a url has
one key for each pair of a number of host labels and a length of path that some
rule has: its last labels, followed by the beginning of its path. The universe is
all these keys of the corpus.

The rules are the listed keys of a cascade, and those that block are the listed
keys of a second one, whose universe is the rules. Level 1 is a Bloom
filter of the listed keys. Keys of the universe that pass it and aren't listed
are found in one pass over the corpus; level 2 encodes these, level 3 the listed
keys that pass level 2, and so on, until a level lets nothing wrong pass. Then a
key is listed if and only if the number of levels that it passes before it fails
one (or they end) is odd, for every key of the universe. Urls are judged by the
levels' bits alone, which are a scalar subquery each: no join, no list of rules.

A key is hashed from its SHA-256, each level in another way, so keys that look
alike to one level don't to the next. The bits of a level are made in the tasks
and put into one array, of `most_bytes` at the most: a longer list is dealt by
hash over several cascades of that size, which the urls pass one after the other,
each pass written to the shared folder.

Defined results: a null url or one without `://` has an empty host and path; no
rule fits these. A url that no rule fits is not listed: the verdict is `default`.
Of rules of the same length that with more of the host decides; a rule with both
verdicts blocks; rules without a host, null ones and repeated ones count for
nothing; A-Z of a host are lower-cased. Urls and rules
of any length are read whole; rows may repeat, a null identifier is an identifier
like others; an empty table gives no rows, an empty list of rules the default for
all; other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import once
from . import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _host_and_rest(url: Column) -> tuple[Column, Column]:
    """The host as it is written, and all that follows it; empty without ://."""
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.locate("://", url) + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return host, F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)


def listed_rules(rules: DataFrame, rule: str = "rule", verdict: str = "verdict") -> DataFrame:
    """key, labels, chars, verdict of the rules (`host` + `path`), each once."""
    host = F.translate(F.regexp_extract(rule, "^[^/]*", 0), UPPER, LOWER)
    path = F.substr(F.col(rule), F.length(F.regexp_extract(rule, "^[^/]*", 0)) + 1)
    parts = rules.select(host.alias("host"), path.alias("path"), F.col(verdict).alias("verdict")).filter("host <> ''")
    parts = parts.select(F.concat("host", "path").alias("key"), F.size(F.split("host", r"\.", -1)).alias("labels"), F.length("path").alias("chars"), "verdict")
    return parts.groupBy("key", "labels", "chars").agg(F.max(F.col("verdict") == "block").alias("blocks")).select("key", "labels", "chars", F.when(F.col("blocks"), F.lit("block")).otherwise(F.lit("allow")).alias("verdict"))


def _digest(key: Column) -> Column:
    return F.sha2(key, 256)


class Level:
    """A Bloom filter of the keys of a table, as an array of longs."""

    def __init__(self, digests: DataFrame, n: int, salt: int, rate: float):
        self.hashes = max(1, round(-math.log2(rate)))
        self.words = max(1, math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 64))
        self.salt = salt
        at = digests.select(F.explode(F.array(*self._places(F.col("digest")))).alias("place"))
        some = at.groupBy(_word(F.col("place")).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _bit(F.col("place")))).alias("bits"))
        all_ = some.unionByName(digests.sparkSession.range(self.words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits")))
        words = all_.groupBy("word").agg(F.bit_or("bits").alias("bits"))
        self.table = common.landed(words.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("bits")), "url-level")

    def _places(self, digest: Column) -> list[Column]:
        bits = F.lit(64 * self.words)
        first, step = (F.pmod(F.xxhash64(F.lit(2 * self.salt + i), digest), bits) for i in (0, 1))
        return [F.pmod(first + i * step, bits) for i in range(self.hashes)]

    def passes(self, digest: Column) -> Column:
        bits = self.table.scalar()
        return reduce(Column.__and__, (F.getbit(F.get(bits, _word(p).cast("int")), _bit(p)) == 1 for p in self._places(digest)))


def _word(place: Column) -> Column:
    return F.shiftright(place, 6)


def _bit(place: Column) -> Column:
    return F.pmod(place, F.lit(64)).cast("int")


class Cascade:
    """Levels that hold the listed keys exactly, among the keys of a universe.
    Both tables are (key, digest); the universe's rows may repeat."""

    def __init__(self, listed: DataFrame, universe: DataFrame, rate: float = 0.01, later: float = 0.5):
        self.levels: list[Level] = []
        inside = common.landed(listed.dropDuplicates(["key"]), "url-listed")
        outside, first = None, inside
        n = inside.count()
        while n:
            self.levels.append(Level(inside, n, len(self.levels), later if outside is not None else rate))
            if outside is None:
                wrong = universe.filter(self.levels[0].passes(F.col("digest"))).select("key", "digest").dropDuplicates(["key"]).join(first.select("key"), "key", "left_anti")
            else:
                wrong = outside.filter(self.levels[-1].passes(F.col("digest")))
            wrong = common.landed(wrong, "url-wrong")
            n = wrong.count()
            common.discard(outside)
            inside, outside = wrong, inside
        common.discard(inside, outside, first)

    def holds(self, digest: Column) -> Column:
        """Whether a key of the universe is listed."""
        inside = F.lit(bool(len(self.levels) % 2))
        for nth in reversed(range(len(self.levels))):
            inside = F.when(self.levels[nth].passes(digest), inside).otherwise(F.lit(nth % 2 == 1))
        return inside

    def discard(self) -> None:
        common.discard(*[x.table for x in self.levels])


class UrlFilter:
    def __init__(self, pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", rate: float = 0.01, most_bytes: int = 16 << 20):
        self.pages, self.url_col, self.default, self.rate = pages, url_col, default, rate
        self.rules = common.landed(listed_rules(rules).withColumn("digest", _digest(F.col("key"))), "url-rules")
        # the pairs of labels and characters that rules have: few, however long the list
        self.shapes = [(r["labels"], r["chars"]) for r in self.rules.select("labels", "chars").distinct().orderBy("labels", "chars").collect()]
        self.cascades = max(1, math.ceil(self.rules.count() * -math.log(rate) / math.log(2) ** 2 / 8 / most_bytes))

    def _keyed(self, urls: DataFrame, url: str, host: str, path: str, keys: str) -> DataFrame:
        """urls with host, path and a key (key, digest) or null for each shape."""
        of_url, of_path = _host_and_rest(F.col(f"`{url}`"))
        out = urls.withColumn(host, once(F.translate(of_url, UPPER, LOWER))).withColumn(path, once(of_path))
        labels = F.size(F.split(host, r"\.", -1))
        there = [F.when((F.col(host) != "") & (labels >= k) & (F.length(path) >= c), F.concat(F.substring_index(host, ".", -k), F.substring(path, 1, c))) for k, c in self.shapes]
        each = F.array(*there) if there else F.array().cast("array<string>")
        return out.withColumn(keys, once(F.transform(each, lambda k: F.when(k.isNotNull(), F.struct(k.alias("key"), _digest(k).alias("digest"))))))

    def _dealt(self, digest: Column, nth: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(-1), digest), F.lit(self.cascades)) == nth

    def _longest(self, keys: Column, cascade: Cascade, nth: int) -> Column:
        """(length, labels, key, digest) of the longest of the keys that is a rule."""
        found = []
        for i, (labels, _) in enumerate(self.shapes):
            k = F.get(keys, F.lit(i))
            rule = F.struct(F.length(k["key"]).alias("length"), F.lit(labels).alias("labels"), k["key"].alias("key"), k["digest"].alias("digest"))
            found.append(F.when(k.isNotNull() & self._dealt(k["digest"], nth) & cascade.holds(k["digest"]), rule))
        return F.array_max(F.array(*found))

    def _judged(self) -> tuple[DataFrame, str, str, str]:
        """The pages with host, path and the rule that fits best, and the names
        of these columns."""
        out, name = self.pages, []
        for c in ("host", "path", "keys", "fit", "longest"):
            name.append(common.fresh(out, c))
            out = out.withColumn(name[-1], F.lit(None))
        host, path, keys, fit, longest = name
        universe = self._keyed(self.pages.select(F.col(f"`{self.url_col}`").alias("url")), "url", "host", "path", "keys").select(F.explode("keys").alias("k")).filter("k IS NOT NULL").select("k.key", "k.digest")
        none = F.lit(None).cast("struct<length:int,labels:int,key:string,blocks:boolean>")
        out = self._keyed(self.pages, self.url_col, host, path, keys).withColumn(fit, none)
        for nth in range(self.cascades if self.shapes else 0):
            own, before = self.rules.filter(self._dealt(F.col("digest"), nth)), out
            listed = Cascade(own.select("key", "digest"), universe.filter(self._dealt(F.col("digest"), nth)), self.rate)
            blocking = Cascade(own.filter("verdict = 'block'").select("key", "digest"), own.select("key", "digest"), self.rate)
            out = out.withColumn(longest, once(self._longest(F.col(keys), listed, nth)))
            best = F.col(longest)
            own = F.struct(best["length"].alias("length"), best["labels"].alias("labels"), best["key"].alias("key"), blocking.holds(best["digest"]).alias("blocks"))
            out = out.withColumn(fit, once(F.array_max(F.array(fit, F.when(best.isNotNull(), own)))))
            if self.cascades > 1:
                out = common.landed(out, "url-judged")
                common.discard(before)
                listed.discard()
                blocking.discard()
        return out, host, path, fit

    def _verdict(self, fit: str) -> Column:
        return F.when(F.col(fit).isNull(), self.default).when(F.col(fit)["blocks"], "block").otherwise("allow")

    def judged(self, id_col: str = "page_id") -> DataFrame:
        """id, url, host, path, rule (null: none fits), verdict of every page."""
        out, host, path, fit = self._judged()
        return out.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{self.url_col}`").alias("url"), F.col(host).alias("host"), F.col(path).alias("path"), F.col(fit)["key"].alias("rule"), self._verdict(fit).alias("verdict"))

    def allowed(self) -> DataFrame:
        """The pages, with their own columns, that aren't blocked."""
        out, _, _, fit = self._judged()
        return out.filter(self._verdict(fit) == "allow").select(*[F.col(f"`{c}`") for c in self.pages.columns])
