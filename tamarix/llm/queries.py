"""The registered queries: thin forms of the operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, language_id, lexical_search, line_dedup, mixing, ngram_join, packing, quality_rules, sharding, spelling, substring_dedup, toxicity, url_filter
from .common import documents


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.LineDedup(documents(spark, sf_dir)).documents()
    return found.select(F.col("id").alias("doc_id"), F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def _level_sql(n: int, lines: str) -> str:
    """The templates m<n> of lines (part, leaf, general, ws)."""
    return f"""p{n} AS (SELECT *, count(*) OVER (PARTITION BY part) AS lines FROM ({lines})
), w{n} AS (SELECT part, leaf, general, lines, i, ws[i] AS word FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM p{n} WHERE lines > 1)
), f{n} AS (SELECT *, count(*) OVER (PARTITION BY part, i, word) > lines * 0.5 AND word <> '<*>' AS fixed FROM w{n}
), m{n} AS (
    SELECT leaf, general, string_agg(CASE WHEN fixed THEN word ELSE '<*>' END, ' ' ORDER BY i) AS template FROM f{n}
    GROUP BY leaf, general HAVING count(*) FILTER (fixed) >= count(*) * 0.6
)"""


OP1_SQL = rf"""
WITH s AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents
), l AS (SELECT doc_id, pos, ls[pos] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS pos FROM s)
), g AS (
    SELECT doc_id, pos, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS own,
        list_filter(string_split_regex(regexp_replace(line, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM l
), k AS (
    SELECT doc_id, pos, CASE WHEN len(ws) <= 3 THEN concat_ws(' ', len(ws), array_to_string(own, ' ')) ELSE concat_ws(' ', len(ws), ws[1], ws[2], ws[3]) END AS leaf,
        ws, array_to_string(CASE WHEN len(ws) <= 3 THEN own ELSE ws END, ' ') AS general FROM g WHERE len(ws) > 0
), seen AS (SELECT leaf, general, any_value(ws) AS ws, min(doc_id) AS low, max(doc_id) AS high FROM k GROUP BY leaf, general
), {_level_sql(1, "SELECT leaf AS part, leaf, general, ws FROM seen WHERE len(ws) > 3")
}, r1 AS (SELECT leaf, general, ws FROM p1 ANTI JOIN m1 USING (leaf, general)
), {_level_sql(2, "SELECT leaf || ' ' || ws[4] AS part, * FROM r1")
}, r2 AS (SELECT leaf, general, ws FROM p2 ANTI JOIN m2 USING (leaf, general)
), {_level_sql(3, "SELECT leaf || ' ' || ws[-1] AS part, * FROM r2")
}, m AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3
), t AS (
    SELECT leaf, general, min(low) OVER (PARTITION BY leaf, coalesce('T' || template, 'G' || general)) AS first FROM seen LEFT JOIN m USING (leaf, general)
), d AS (SELECT doc_id, pos FROM k JOIN t USING (leaf, general) WHERE first < doc_id
), r AS (
    SELECT l.doc_id, count(*) AS n_lines, count(d.pos) AS n_dropped, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (d.pos IS NULL), '') AS kept
    FROM l LEFT JOIN d ON d.doc_id = l.doc_id AND d.pos = l.pos GROUP BY l.doc_id
)
SELECT s.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256
FROM s LEFT JOIN r USING (doc_id)
"""


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.fit(docs.filter(~language_id.held_out()))
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP3_SQL = r"""
WITH d AS (
    SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents
), g AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)
), rep AS (
    SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, unnest(range(3)) AS j FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id
), b AS (
    SELECT d.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
           len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
    FROM d LEFT JOIN rep USING (doc_id)
), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b
), v AS (
    SELECT doc_id, lang, source, base_failed, unnest(['length', 'symbols', 'lines', 'repeats']) AS rate,
           unnest([word_chars * 1000 // greatest(n_words, 1), n_symbols * 1000000 // greatest(word_chars, 1), n_dup_lines * 1000 // greatest(n_lines, 1), n_repeat_words * 1000 // greatest(n_words, 1)]) AS v FROM f
), s AS (
    SELECT lang, source, rate, (v >> greatest(0, length(bin(v)) - 6)) << greatest(0, length(bin(v)) - 6) AS value, count(*) AS n FROM v WHERE NOT base_failed GROUP BY ALL
), q AS (
    SELECT k, CASE WHEN k < 2 THEN lang END AS lang, CASE WHEN k < 1 THEN source END AS source, rate, value, sum(n) AS n FROM s, range(3) AS r(k) GROUP BY ALL
), c AS (
    SELECT *, sum(n) OVER (PARTITION BY k, lang, source, rate ORDER BY value) AS upto, sum(n) OVER (PARTITION BY k, lang, source, rate) AS total FROM q
), h AS (
    SELECT k, lang, source, rate, max(total) AS total, min(value) FILTER (20 * upto >= total) AS q05, min(value) FILTER (4 * upto >= total) AS q1, min(value) FILTER (2 * upto >= total) AS q50, min(value) FILTER (4 * upto >= 3 * total) AS q3, min(value) FILTER (20 * upto >= 19 * total) AS q95
    FROM c GROUP BY k, lang, source, rate
), m AS (
    SELECT l.lang, l.rate, (l.total * l.q05 + 50 * e.q05) // (l.total + 50) AS q05, (l.total * l.q1 + 50 * e.q1) // (l.total + 50) AS q1, (l.total * l.q50 + 50 * e.q50) // (l.total + 50) AS q50, (l.total * l.q3 + 50 * e.q3) // (l.total + 50) AS q3, (l.total * l.q95 + 50 * e.q95) // (l.total + 50) AS q95
    FROM h AS l JOIN h AS e ON l.k = 1 AND e.k = 2 AND e.rate = l.rate
), p AS (
    SELECT o.lang, o.source, o.rate, (o.total * o.q05 + 50 * m.q05) // (o.total + 50) AS q05, (o.total * o.q1 + 50 * m.q1) // (o.total + 50) AS q1, (o.total * o.q50 + 50 * m.q50) // (o.total + 50) AS q50, (o.total * o.q3 + 50 * m.q3) // (o.total + 50) AS q3, (o.total * o.q95 + 50 * m.q95) // (o.total + 50) AS q95
    FROM h AS o JOIN m ON o.k = 0 AND m.rate = o.rate AND m.lang IS NOT DISTINCT FROM o.lang
), t AS (
    SELECT *, q3 + 3.0 * greatest(q3 - q1, q95 - q50) + q3 // 32 AS hi, CASE rate WHEN 'length' THEN q1 - 3.0 * greatest(q3 - q1, q50 - q05) - q1 // 32 END AS lo FROM p
), bad AS (
    SELECT DISTINCT doc_id FROM v JOIN t ON t.rate = v.rate AND t.lang IS NOT DISTINCT FROM v.lang AND t.source IS NOT DISTINCT FROM v.source
    WHERE v.v > hi OR v.v < lo
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM f
"""


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.NgramJaccardJoin(documents(spark, sf_dir)).components()
    return found.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))


OP4_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
    SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                             WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS same FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
), e AS (
    SELECT a, b FROM p JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 100 * same >= 80 * (na.n + nb.n - same)
), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
), c AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(c.low, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.a = w.doc_id
"""


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.Mixture(documents(spark, sf_dir).select("doc_id", "text", "source")).taken()
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           substr(md5(concat_ws('|', doc_id::VARCHAR, md5(coalesce(text, '')), 'mix-1')), 1, 16) AS key FROM documents
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source
), w AS (SELECT *, (rank - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s
), l AS (
    SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
    FROM w WINDOW b AS (ORDER BY cap::DOUBLE / weight::DOUBLE, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (SELECT rank, source, source_size, least(cap::DOUBLE, weight::DOUBLE * max(level) OVER ()) AS target FROM l
), o AS (
    SELECT d.*, rank, source_size, target, (coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS before
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (SELECT doc_id, rank, size, target, e * source_size + before + size AS ending FROM o, range(3) AS r(e) WHERE size > 0 AND target > 0
), q AS (
    SELECT doc_id, size, coalesce(sum(size) OVER (ORDER BY ending::DOUBLE / target, rank, ending ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_before FROM c
), k AS (SELECT doc_id, sum(greatest(0, least(size, (SELECT sum(size) FROM d) - words_before)))::BIGINT AS taken FROM q GROUP BY doc_id
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM o LEFT JOIN k USING (doc_id)
"""


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.KdShards(documents(spark, sf_dir)).assigned()
    return found.select(F.col("id").alias("doc_id"), "size", F.col("crc32").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))


def packed(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return pieces.select(F.col("document_id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    chain = toxicity.fit(docs, labels, ["quality", "toxic"])
    return toxicity.score(docs, chain).select(F.col("id").alias("doc_id"), "p_quality", "p_toxic", F.col("is_toxic").alias("toxic"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(documents(spark, sf_dir))
    return found.select(F.col("document_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH w AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), k AS (
    SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)
), m AS (SELECT g, min(doc_id) AS low FROM k GROUP BY g HAVING min(doc_id) <> max(doc_id)
), c AS (
    SELECT DISTINCT doc_id, i + j AS pos FROM (SELECT doc_id, i, unnest(range(13)) AS j FROM k JOIN m USING (g) WHERE low < doc_id)
), p AS (
    SELECT w.doc_id, i, ws[i] AS word, c.pos IS NOT NULL AS gone
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w) AS w LEFT JOIN c ON c.doc_id = w.doc_id AND c.pos = w.i
), r AS (
    SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM p GROUP BY doc_id
)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
"""


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.ExactDedup(documents(spark, sf_dir).select("doc_id", "text")).rows()
    return found.select(F.col("document_id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""



def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    index = lexical_search.LexicalIndex(docs, wanted=items.select(F.explode(lexical_search.terms(F.col("text"))).alias("term")))
    return index.search(items).select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


OP11_SQL = r"""
WITH t AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), p AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM t GROUP BY ALL
), l AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id
), a AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM l
), q AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), w AS (
    SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM p, a GROUP BY term, docs
), s AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // length))))::BIGINT AS score
    FROM q JOIN w USING (term) JOIN p USING (term) JOIN l USING (doc_id), a GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= 10
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.Spelling(documents(spark, sf_dir).select("doc_id", "text")).variants()


OP12_SQL = r"""
WITH t8 AS (
    SELECT list(c ORDER BY i) AS t FROM (
        SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) AS r(i))
), p AS (
    SELECT doc_id, run, count(*) AS n FROM (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL
), b AS (
    SELECT doc_id, run, n, flatten(list_transform(string_split(concat(doc_id::VARCHAR, ':', run), ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c) >> 6)::BIGINT, 128 + (unicode(c) & 63)::BIGINT] END)) AS bytes FROM p
), h AS (
    SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS h FROM b, t8
), w AS (
    SELECT word, sum(n)::BIGINT AS n FROM (
        SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h)
    GROUP BY word HAVING length(word) >= 7 AND sum(n) >= 2
), d AS (
    SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)
), e AS (
    SELECT DISTINCT word, near, near_n FROM (
        SELECT x.word, y.word AS near, y.n AS near_n FROM d AS x JOIN d AS y ON x.less = y.less AND x.i = y.i AND x.word <> y.word
        UNION ALL SELECT d.word, w.word, w.n FROM d JOIN w ON w.word = d.less
        UNION ALL SELECT w.word, d.word, d.n FROM d JOIN w ON w.word = d.less)
), f AS (
    SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n
    FROM w LEFT JOIN (SELECT word, count(*) AS n_near, max(near_n) AS best_n, first(near ORDER BY near_n DESC, near) AS best FROM e GROUP BY word) USING (word)
), c AS (
    WITH RECURSIVE r(word, root) AS (SELECT word, form FROM f WHERE form IS NOT NULL UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL)
    SELECT r.word, r.root FROM r JOIN f ON f.word = r.root WHERE f.form IS NULL
)
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN c ON c.word = f.word
"""


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")], "rule string, verdict string")
    found = url_filter.UrlFilter(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), rules).judged()
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


OP13_SQL = r"""
WITH r AS (
    SELECT *, rh || rp AS rule FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) AS v(rh, rp, verdict)
), u AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), f AS (
    SELECT *, (SELECT arg_max(rule, length(rule)) FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS rule FROM p
)
SELECT page_id, host, path, f.rule, coalesce(r.verdict, 'allow') AS verdict FROM f LEFT JOIN r ON r.rule = f.rule
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_language_id": op2_language_id,
    "op3_quality_rules": op3_quality_rules,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_mixing": op5_mixing,
    "op6_sharding": op6_sharding,
    "op7_packing": op7_packing,
    "op8_toxicity": op8_toxicity,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_lexical_search": op11_lexical_search,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_url_filter": op13_url_filter,
}
ORACLES: dict[str, str] = {
    "op1_line_dedup": OP1_SQL,
    "op3_quality_rules": OP3_SQL,
    "op4_ngram_jaccard_join": OP4_SQL,
    "op5_mixing": OP5_SQL,
    "op9_substring_dedup": OP9_SQL,
    "op10_exact_dedup": OP10_SQL,
    "op11_lexical_search": OP11_SQL,
    "op12_spelling_variants": OP12_SQL,
    "op13_url_filter": OP13_SQL,
}
