"""Announcements and a taxonomy derived from the generic test tables, in Spark
and in the SQL that the oracle runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fixed_values as V
from .functions import text as X
from .sources.files import MARKET, OFFICIAL
from .sources.schemas import PROFESSION, as_jobs

#: id, label, aliases, diplomas, source: terms are words of part names and types.
TAXONOMY = [
    ("it.responsable_si", "Widget", ["red widget", "ring keeper"], [], MARKET),
    ("it.cybersecurite", "Red Widget", ["widget rouge"], ["Diplôme Widget"], MARKET),
    ("it.technicien_developpement_informatique", "Blue bolt", ["développement informatique bolt"], [], MARKET),
    ("it.developpeur_logiciel", "Bolt bleu", ["blue bolt"], ["Diplôme Bolt", "Licence"], MARKET),
    ("it.technicien_informatique", "Informatique", ["blue bolt", "cold bolt"], ["Licence"], MARKET),
    ("edu.prof_universitaire", "Economy", ["professor"], [], MARKET),
    ("edu.formateur_professionnel", "Promo", ["Formateur"], [], MARKET),
    ("management.charge_projet", "Hot gear", [], [], MARKET),
    ("btp.chef_projet_genie_civil", "Hot gear economy", ["hot gear promo"], ["Génie"], MARKET),
    ("sales.marketing", "Old ring", [], ["Licence"], MARKET),
    ("sales.publicite", "Old ring large", ["ring old medium"], [], MARKET),
    ("industry.qualite", "Plate", ["large plate", "small plate"], [], MARKET),
    ("industry.responsable_hse", "Large plate standard", ["plate small standard"], [], MARKET),
    ("agri.horticulture", "New rod", [], [], MARKET),
    ("agri.technicien_technico_commercial_horticole", "Rod new", ["new rod"], [], MARKET),
    ("sales.commercial", "Cold rod", ["new rod", "brand 7"], [], MARKET),
    ("finance.comptable", "Comptable", ["gear accountant"], ["Licence"], MARKET),
    ("beauty.estheticien", "Esthéticien ring", ["ring small"], [], MARKET),
    ("hcp.1", "Old anvil", [], [], OFFICIAL),
    ("hcp.2", "New anvil", [], [], OFFICIAL),
    ("hcp.3", "Anvil n.c.a", [], [], OFFICIAL),
    ("hcp.4", "Small anvil economy", [], [], OFFICIAL),
]
RULES = (
    {"id": "rule.gear", "profession_id": "finance.comptable", "job_name_any": ["cold gear"], "specialty_any": ["economy", "promo"]},
    {"id": "rule.tech", "profession_id": "it.technicien_informatique", "grade_any": ["technicien"], "specialty_any": ["informatique", "standard"]},
)
NOW = "2001-08-01 12:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def taxonomy(spark: SparkSession) -> DataFrame:
    rows = [(i, p, label, p.split(".")[0], "family", [f"{i:04d}"], aliases, diplomas, source) for i, (p, label, aliases, diplomas, source) in enumerate(TAXONOMY)]
    return spark.createDataFrame(rows, PROFESSION)


def catalogue_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The taxonomy and an official profession for each name and type of part."""
    label = F.concat_ws(" ", "p_name", F.lower("p_type"))
    kinds = table(spark, sf_dir, "part").select(label.alias("label"), F.concat(F.lit("Diplôme "), F.initcap("p_name")).alias("diploma"), F.upper("p_name").alias("alias")).distinct()
    name = F.replace("label", F.lit(" "), F.lit("_"))
    own = kinds.select(
        (F.crc32("label") + 1000).cast("long").alias("ord"), F.concat(F.lit("part."), name).alias("id"), "label", F.lit("part").alias("sector"), F.lit("family").alias("family"), F.array(F.lit("0")).alias("hcp_codes"),
        F.array("alias").alias("aliases"), F.array("diploma").alias("diplomas"), F.when(F.contains("label", F.lit("o")), OFFICIAL).otherwise(MARKET).alias("source"),
    )
    return taxonomy(spark).unionByName(own)


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: names of parts and their beginnings, two of their words, and the
    beginnings of documents."""
    p, d = table(spark, sf_dir, "part"), table(spark, sf_dir, "documents")
    k = F.col("p_partkey")
    words = F.split("p_name", " ")
    of = p.select(F.explode(F.array("p_name", F.upper(F.substring(F.col("p_name"), F.lit(1), (k % 8 + 1).cast("int"))), F.concat_ws(" ", F.lower("p_type"), F.get(words, F.lit(1))), F.concat_ws(" ", "p_name", F.lower("p_type")))).alias("query"))
    return of.unionByName(d.select(F.substring(F.col("text"), F.lit(1), (F.col("doc_id") % 9 + 3).cast("int")).alias("query"))).distinct()


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries with a letter twice or left out."""
    k = (F.col("p_partkey") % 3 + 2).cast("int")
    n = F.col("p_name")
    twice = F.concat(F.substring(n, F.lit(1), k), F.substring(n, k, F.lit(99)))
    out = F.concat(F.substring(n, F.lit(1), k), F.substring(n, k + 2, F.lit(99)), F.lit(" "), F.lower("p_type"))
    return table(spark, sf_dir, "part").select(F.explode(F.array(twice, out)).alias("query")).distinct()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 5 == 0, "").when(k % 2 == 0, F.concat_ws(" ", "p_name", F.lower("p_type"))).otherwise(F.col("p_name"))
    grade = F.when(k % 21 == 0, "Maître de conférences grade A").when(k % 22 == 0, F.concat(F.lit("Formateur en "), "p_type")).when(k % 35 == 0, "Technicien de 3ème grade - échelle 9").when(k % 3 == 0, F.concat(F.lit("Technicien "), "p_type")).otherwise("")
    extra = F.when(k % 13 == 0, "Gestion informatique").when(k % 17 == 0, "Développement informatique").otherwise("")
    title = F.when(k % 4 == 0, F.concat(F.lit("Avis de concours de recrutement de "), "p_name", F.lit(" échelle "), (F.col("p_size") % 12).cast("string"), F.lit(" Agence "), "p_brand", F.lit(" annonce 1 poste")))
    title = title.when(k % 4 == 1, F.concat(F.lit("Recrutement d'un "), "p_name", F.lit("  Université "), "p_brand")).otherwise(F.concat_ws(" ", "p_brand", "p_name"))
    day = lambda d: F.concat(F.date_format(F.date_sub(F.lit("2001-08-01").cast("date"), d), "yyyy-MM-dd"), F.lit("T23:59:00"))
    rows = table(spark, sf_dir, "part").select(
        k.cast("string").alias("uuid"), F.concat(F.lit("https://jobs.example/"), k.cast("string")).alias("url"), F.lit("collec").alias("scope"), title.alias("listing_title"), F.col("p_brand").alias("administration"),
        day((k % 20 - 2).cast("int")).alias("publication_date"), day((4 - k % 9).cast("int")).alias("deadline"), name.alias("job_name"), grade.alias("grade"),
        F.when(k % 35 == 0, F.array().cast("array<string>")).otherwise(F.array("p_type", "p_brand", extra)).alias("specialties"), (k % 7).cast("int").alias("positions"),
    )
    return as_jobs(rows)


# --- the same in SQL ---------------------------------------------------------

JOBS_SQL = """jobs AS (
    SELECT p_partkey::VARCHAR AS uuid, 'https://jobs.example/' || p_partkey AS url,
        CASE WHEN p_partkey % 4 = 0 THEN 'Avis de concours de recrutement de ' || p_name || ' échelle ' || (p_size % 12) || ' Agence ' || p_brand || ' annonce 1 poste'
             WHEN p_partkey % 4 = 1 THEN 'Recrutement d''un ' || p_name || '  Université ' || p_brand ELSE p_brand || ' ' || p_name END AS listing_title,
        p_brand AS administration, strftime(DATE '2001-08-01' - (p_partkey % 20 - 2)::INT, '%Y-%m-%d') || 'T23:59:00' AS publication_date,
        strftime(DATE '2001-08-01' - (4 - p_partkey % 9)::INT, '%Y-%m-%d') || 'T23:59:00' AS deadline,
        CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 2 = 0 THEN p_name || ' ' || lower(p_type) ELSE p_name END AS job_name,
        CASE WHEN p_partkey % 21 = 0 THEN 'Maître de conférences grade A' WHEN p_partkey % 22 = 0 THEN 'Formateur en ' || p_type WHEN p_partkey % 35 = 0 THEN 'Technicien de 3ème grade - échelle 9'
             WHEN p_partkey % 3 = 0 THEN 'Technicien ' || p_type ELSE '' END AS grade,
        CASE WHEN p_partkey % 35 = 0 THEN []::VARCHAR[] ELSE [p_type, p_brand, CASE WHEN p_partkey % 13 = 0 THEN 'Gestion informatique' WHEN p_partkey % 17 = 0 THEN 'Développement informatique' ELSE '' END] END AS specialties,
        (p_partkey % 7)::INT AS positions
    FROM part)"""
_q = lambda s: "'" + s.replace("'", "''") + "'"
_list = lambda xs: "[" + ", ".join(map(_q, xs)) + "]::VARCHAR[]"
TAXONOMY_SQL = "tax(ord, id, label, aliases, diplomas, source) AS (VALUES " + ", ".join(f"({i}, {_q(p)}, {_q(lb)}, {_list(al)}, {_list(di)}, {_q(so)})" for i, (p, lb, al, di, so) in enumerate(TAXONOMY)) + ")"

CATALOGUE_TAXONOMY_SQL = TAXONOMY_SQL.replace("tax(", "few(", 1) + f""", kinds AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS label, 'Diplôme ' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS diploma, upper(p_name) AS alias FROM part
), tax AS (SELECT * FROM few UNION ALL SELECT NULL, 'part.' || replace(label, ' ', '_'), label, [alias], [diploma], CASE WHEN contains(label, 'o') THEN '{OFFICIAL}' ELSE '{MARKET}' END FROM kinds)"""
ASKED_QUERY_SQL = """SELECT DISTINCT unnest([p_name, upper(substr(p_name, 1, p_partkey % 8 + 1)), lower(p_type) || coalesce(' ' || string_split(p_name, ' ')[2], ''), p_name || ' ' || lower(p_type)]) AS query FROM part
    UNION SELECT substr(text, 1, doc_id % 9 + 3) FROM documents"""
TYPED_QUERY_SQL = "SELECT DISTINCT unnest([substr(p_name, 1, p_partkey % 3 + 2) || substr(p_name, p_partkey % 3 + 2, 99), substr(p_name, 1, p_partkey % 3 + 2) || substr(p_name, p_partkey % 3 + 4, 99) || ' ' || lower(p_type)]) AS query FROM part"


def fold_sql(x: str) -> str:
    return f"replace(lower(strip_accents(coalesce({x}, ''))), 'ß', 'ss')"


def norm_sql(x: str) -> str:
    return rf"trim(regexp_replace({fold_sql(x)}, '[^\p{{L}}\p{{N}}+#]+', ' ', 'g'))"


def clean_sql(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g'))"


def tokens_sql(n: str) -> str:
    return f"list_filter(string_split({n}, ' '), lambda t: length(t) > 1 AND t NOT IN ({', '.join(map(_q, V.STOPWORDS))}))"


def phrase_sql(v: str, p: str) -> str:
    return f"({v} <> '' AND {p} <> '' AND contains(' ' || {v} || ' ', ' ' || {p} || ' '))"


def any_phrase_sql(v: str, phrases) -> str:
    return "(" + " OR ".join(phrase_sql(v, _q(X.norm_text(p))) for p in phrases) + ")"


def role_sql(title: str) -> str:
    """X.listing_role in SQL."""
    edges = "' -–:()[]'"
    whole = clean_sql(title)
    out = []
    for opening in ("d[''’]?u?n?e?", "de"):
        hit = rf"trim(regexp_extract({whole}, '(?i)\brecrutement {opening}\s+(.+?)(?:\s+annonce\b|$)', 1), {edges})"
        scale = r"'(?i)^(.*?\b(?:echelle|échelle)\s*\d+)\b.*$'"
        # RE2 knows ASCII word edges only, so a space or the start stands for \b here
        scale = scale.replace(r"\b(?:echelle", r"(?:echelle")
        names = "|".join(V.EMPLOYER_WORDS)
        cut = rf"trim(CASE WHEN regexp_matches({hit}, {scale}) THEN regexp_extract({hit}, {scale}, 1) ELSE regexp_replace({hit}, '(?i)\s+(?:{names})(?:[^\p{{L}}\p{{N}}_].*$|$)', '') END, {edges})"
        out.append(f"CASE WHEN {norm_sql(cut)} <> '' AND {norm_sql(cut)} <> {norm_sql(whole)} THEN {cut} END")
    return f"coalesce({', '.join(out)}, '')"


TERMS_SQL = f"""terms AS (
    SELECT *, {norm_sql('term')} AS norm_term, list_distinct({tokens_sql(norm_sql('term'))}) AS term_tokens
    FROM (SELECT ord, id, label, source, term_ord - 1 AS term_ord, list_concat([label], aliases)[term_ord] AS term FROM (SELECT *, unnest(range(1, len(aliases) + 2)) AS term_ord FROM tax)))"""
EVIDENCE_SQL = f"""evidence AS (
    SELECT uuid, (row_number() OVER (PARTITION BY uuid ORDER BY pos) - 1)::INT AS field_ord, field, value, weight, {norm_sql('value')} AS norm_value FROM (
        SELECT uuid, 0 AS pos, 'job_name' AS field, job_name AS value, 1.0::DOUBLE AS weight FROM jobs
        UNION ALL SELECT uuid, i, 'specialty', specialties[i], 1.0 FROM (SELECT uuid, specialties, unnest(range(1, len(specialties) + 1)) AS i FROM jobs)
        UNION ALL SELECT uuid, 1000, 'listing_role', {role_sql('listing_title')}, 1.0 FROM jobs
        UNION ALL SELECT uuid, 1001, 'listing_title', listing_title, 0.9 FROM jobs UNION ALL SELECT uuid, 1002, 'grade', grade, 0.72 FROM jobs) WHERE value <> '')"""
PAIRS_SQL = f"""val AS (SELECT norm_value, list_distinct({tokens_sql('norm_value')}) AS value_tokens FROM (SELECT DISTINCT norm_value FROM evidence)
), pairs AS (
    SELECT norm_value, norm_term, len(value_tokens) AS nv, len(term_tokens) AS nt, len(list_intersect(value_tokens, term_tokens)) AS sh
    FROM val, (SELECT DISTINCT norm_term, term_tokens FROM terms)
), strict AS (
    SELECT norm_value, norm_term, CASE WHEN norm_value = norm_term THEN 100.0 WHEN nv = 0 OR nt = 0 THEN 0.0 WHEN nt >= 2 AND {phrase_sql('norm_value', 'norm_term')} THEN 98.0 WHEN nt >= 2 AND sh = nt THEN 94.0 ELSE 0.0 END::DOUBLE AS raw FROM pairs
), related AS (
    SELECT norm_value, norm_term, CASE WHEN norm_value = norm_term THEN 100.0 WHEN nt >= 2 AND sh = nt THEN 91.0 WHEN nv >= 2 AND sh = nv THEN 88.0
        WHEN sh >= 2 AND sh / least(nv, nt) >= 0.80 AND sh / (nv + nt - sh) >= 0.45 THEN 84.0 WHEN sh >= 2 AND sh / least(nv, nt) >= 0.67 AND sh / (nv + nt - sh) >= 0.35 THEN 78.0 ELSE 0.0 END::DOUBLE AS raw FROM pairs)"""


def best_sql(name: str, scores: str, source: str, band: str) -> str:
    """CTE `name`: uuid, pid, label, source, field, value, term, raw, weighted."""
    return f"""{name} AS (
    SELECT uuid, id AS pid, label, source, field, value, term, raw, weighted FROM (
        SELECT e.uuid, t.id, t.label, t.source, e.field, e.value, t.term, s.raw, s.raw * e.weight AS weighted,
               row_number() OVER (PARTITION BY e.uuid, t.id ORDER BY s.raw * e.weight DESC, t.term_ord, e.field_ord) AS rn
        FROM evidence e JOIN {scores} s USING (norm_value) JOIN terms t USING (norm_term) WHERE s.raw > 0 AND t.source = '{source}') WHERE rn = 1 AND {band})"""


def confidence_sql(s: str) -> str:
    return f"CASE WHEN {s} >= 98 THEN 'EXACT' WHEN {s} >= 92 THEN 'STRONG' WHEN {s} >= 70 THEN 'RELATED' ELSE 'NONE' END"


def _rule_sql(r: dict) -> str:
    on = []
    if r.get("job_name_any"):
        on.append(any_phrase_sql(norm_sql("job_name"), r["job_name_any"]))
    if r.get("grade_any"):
        on.append(any_phrase_sql(norm_sql("grade"), r["grade_any"]))
    if r.get("specialty_any"):
        on.append("(" + " OR ".join(f"list_contains(list_transform(specialties, lambda x: {phrase_sql(norm_sql('x'), _q(X.norm_text(p)))}), true)" for p in r["specialty_any"]) + ")")
    return f"SELECT uuid, '{r['profession_id']}' AS pid, '{r['id']}' AS rule FROM jobs WHERE {' AND '.join(on)}"


CONTEXT_SQL = "context AS (SELECT c.uuid, c.pid, t.label, t.source, 'context_rule' AS field, c.rule AS value, c.rule AS term, 99.0::DOUBLE AS raw, 99.0::DOUBLE AS weighted FROM (" + " UNION ALL ".join(map(_rule_sql, RULES)) + ") c JOIN tax t ON t.id = c.pid)"
MERGED_SQL = """merged AS (
    SELECT * EXCLUDE (rn, first), round(least(weighted, 100), 2) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY uuid, pid ORDER BY round(least(weighted, 100), 2) DESC, first DESC) AS rn
        FROM (SELECT *, 1 AS first FROM context UNION ALL SELECT *, 0 FROM market)) WHERE rn = 1)"""
_pairs = lambda xs: ", ".join(f"({_q(a)}, {_q(b)})" for a, b in xs)
_only = ", ".join(map(_q, V.TECHNICIAN_ONLY))
POLICY_SQL = f"""role AS (
    SELECT uuid, job_name, specialties, {norm_sql("job_name || ' ' || grade || ' ' || " + role_sql('listing_title'))} AS role, contains({norm_sql("job_name || ' ' || grade")}, 'technicien') AS technician,
        len(list_filter(specialties, lambda x: contains({norm_sql('x')}, 'informatique') AND NOT contains({norm_sql('x')}, 'developpement informatique') AND NOT contains({norm_sql('x')}, 'developpement numerique'))) > 0 AS independent FROM jobs
), flag AS (
    SELECT m.*, r.technician, r.independent, {any_phrase_sql('r.role', V.ACADEMIC_MARKERS)} AND bool_or(pid = '{V.ACADEMIC_ID}') OVER w AS academic, {any_phrase_sql('r.role', V.TRAINER_MARKERS)} AND bool_or(pid = '{V.TRAINER_ID}') OVER w AS trainer,
        trim(r.job_name) <> '' AND bool_or(field = 'job_name') OVER w AS titled FROM merged m JOIN role r USING (uuid) WINDOW w AS (PARTITION BY uuid)
), early AS (SELECT * FROM flag WHERE (academic AND pid = '{V.ACADEMIC_ID}') OR (NOT academic AND trainer AND pid = '{V.TRAINER_ID}')
), late AS (SELECT * FROM flag WHERE NOT academic AND NOT trainer AND (NOT titled OR field IN ('job_name', 'context_rule'))
), tech AS (
    SELECT * FROM late l WHERE CASE WHEN NOT technician THEN pid NOT IN ({_only}) ELSE
        NOT EXISTS (SELECT 1 FROM late o JOIN (VALUES {_pairs(V.TECHNICIAN_REPLACES)}) AS d(a, b) ON d.a = o.pid WHERE o.uuid = l.uuid AND d.b = l.pid)
        AND NOT (l.pid = '{V.IT_TECHNICIAN}' AND NOT l.independent AND EXISTS (SELECT 1 FROM late o WHERE o.uuid = l.uuid AND o.pid = '{V.DEVELOPER_TECHNICIAN}')) END
), worded AS (SELECT *, {norm_sql('value')} AS title, list_distinct({tokens_sql(norm_sql('term'))}) AS words FROM tech
), pruned AS (
    SELECT * FROM worded l WHERE NOT EXISTS (SELECT 1 FROM worded o JOIN (VALUES {_pairs(V.DOMINANCE)}) AS d(a, b) ON d.a = o.pid WHERE o.uuid = l.uuid AND d.b = l.pid)
        AND NOT (l.field = 'job_name' AND len(l.words) > 0 AND EXISTS (SELECT 1 FROM worded o WHERE o.uuid = l.uuid AND o.field = 'job_name' AND o.title = l.title AND len(o.words) > len(l.words) AND list_has_all(o.words, l.words) AND o.score >= l.score))
), decided AS (
    SELECT uuid, pid, label, source, field, value, term, raw, weighted, score FROM early UNION ALL SELECT uuid, pid, label, source, field, value, term, raw, weighted, score FROM pruned
), fallback AS (
    SELECT *, round(least(weighted, 100), 2) AS score FROM official WHERE uuid NOT IN (SELECT uuid FROM merged)
), final AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY score DESC, lower(label)) AS rank FROM (SELECT * FROM decided UNION ALL SELECT * FROM fallback)) WHERE rank <= 8
), hints AS (
    SELECT * FROM (SELECT r.*, round(least(weighted, 100), 2) AS score, row_number() OVER (PARTITION BY uuid ORDER BY round(least(weighted, 100), 2) DESC, lower(label)) AS rank FROM relevant r WHERE NOT EXISTS (SELECT 1 FROM final f WHERE f.uuid = r.uuid AND f.pid = r.pid)) WHERE rank <= 8)"""
CANDIDATES_SQL = ",\n".join(
    [JOBS_SQL, TAXONOMY_SQL, TERMS_SQL, EVIDENCE_SQL, PAIRS_SQL, best_sql("market", "strict", MARKET, "weighted >= 92"), best_sql("official", "strict", OFFICIAL, "weighted >= 96"), best_sql("relevant", "related", MARKET, "weighted BETWEEN 70 AND 91.99"), CONTEXT_SQL, MERGED_SQL]
)
INDEX_SQL = CANDIDATES_SQL + ",\n" + POLICY_SQL
