"""The registered queries of the engine's own operators, over whole tables, with SQL that computes the same.

`part` plays the catalog: a name's second word is the generic, the whole name the brand, the size gives
strength and form. Noisy queries are its names with characters exchanged or lost, strengths and forms.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, UNCLASSIFIED
from ..functions import text as T
from ..functions.vocabulary import AD_FRAGMENTS, CHARACTER_CONFUSIONS, CONTRACT_FORMS, CONTRACT_ROUTES, FORMS, FREQUENCIES, MEAL_PHRASES, OPTICAL_PAIRS, STOPWORDS, UNITS
from ..operators import catalog as C
from ..operators import contracts, extraction, layout, linkage
from ..sources.providers import CuratedBrands, ingredients_from, names_from, sync

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from .. import workers

    workers.prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- text

# What SPACE and the letters of functions.text are in this dialect.
_SQL_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"


def _sql_normalize(x: str) -> str:
    kept = rf"regexp_replace(replace(lower(coalesce({x}, '')), '-', ' '), '[^\p{{L}}\p{{N}}_\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}+/]', ' ', 'g')"
    squeezed = f"trim(regexp_replace({kept}, '{_SQL_SPACE}+', ' ', 'g'))"
    return rf"array_to_string(list_transform(string_split({squeezed}, ' '), lambda t: regexp_replace(t, '^([a-zA-Z]+)([0-9]{{2,}})$', '\1 \2')), ' ')"


@query(f"SELECT doc_id, length(n) AS n_chars, md5(n) AS digest FROM (SELECT doc_id, {_sql_normalize('text')} AS n FROM documents)")
def normalize_documents(spark, sf_dir):
    n = T.normalize("text")
    return _table(spark, sf_dir, "documents").select("doc_id", n.alias("n")).select("doc_id", F.length("n").alias("n_chars"), F.md5("n").alias("digest"))


_U = "|".join(sorted((u for u in UNITS if u != "%"), key=lambda w: (-len(w), w)))
_NUM = r"([0-9]+(?:\.[0-9]+)?)"
_SQL_SINGLE = rf"(?i){_NUM}\s*({_U})\b"
_SQL_PER = rf"(?i){_NUM}\s*({_U})\s*/\s*{_NUM}\s*({_U})\b"
_SQL_UNITS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in UNITS.items()) + "}"
_SQL_FORMS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in FORMS.items()) + "}"
_FORM_WORDS = "|".join(sorted(FORMS, key=lambda w: (-len(w), w)))


def _sql_number(x: str, pattern: str, k: int) -> str:
    return f"try_cast(regexp_extract({x}, '{pattern}', {k}) AS DOUBLE)"


def _sql_unit(x: str, pattern: str, k: int) -> str:
    return f"{_SQL_UNITS}[lower(regexp_extract({x}, '{pattern}', {k}))]"


_STRENGTHS = """
  SELECT p_partkey, unnest([p_name || ' ' || p_size || 'mg', p_name || ' ' || p_size || '.5 ML/' || (p_size + 1) || ' ml syr',
    p_size || ' mg + ' || (p_size * 2) || 'mcg tabs ' || p_name, p_name || ' ' || p_size, p_name || ' susp ' || p_size || ' grams x']) AS t FROM part"""


@query(rf"""
WITH x AS ({_STRENGTHS}),
y AS (SELECT *, contains(t, '+') AND len(list_filter(list_transform(string_split(t, '+'), lambda p: regexp_matches(p, '{_SQL_SINGLE}')), lambda m: m)) >= 2 AS many,
  regexp_matches(t, '{_SQL_PER}') AS per, regexp_matches(t, '{_SQL_SINGLE}') AS one FROM x)
SELECT p_partkey, t, CASE WHEN many THEN 2 WHEN per OR one THEN 1 ELSE 0 END::INTEGER AS n_components,
  CASE WHEN many THEN {_sql_number("string_split(t, '+')[1]", _SQL_SINGLE, 1)} WHEN per THEN {_sql_number('t', _SQL_PER, 1)} WHEN one THEN {_sql_number('t', _SQL_SINGLE, 1)} END AS value,
  CASE WHEN many THEN {_sql_unit("string_split(t, '+')[1]", _SQL_SINGLE, 2)} WHEN per THEN {_sql_unit('t', _SQL_PER, 2)} WHEN one THEN {_sql_unit('t', _SQL_SINGLE, 2)} END AS unit,
  CASE WHEN per AND NOT many THEN {_sql_number('t', _SQL_PER, 3)} END AS per_value,
  CASE WHEN per AND NOT many THEN {_sql_unit('t', _SQL_PER, 4)} END AS per_unit,
  trim(regexp_replace(regexp_replace(regexp_replace(t, '{_SQL_PER}', ' ', 'g'), '{_SQL_SINGLE}', ' ', 'g'), '\s+', ' ', 'g')) AS stripped,
  list_filter(list_transform(regexp_extract_all(lower(t), '[a-z]+'), lambda w: {_SQL_FORMS}[w]), lambda f: f IS NOT NULL)[1] AS form,
  trim(regexp_replace(regexp_replace(t, '(?i)\b(?:{_FORM_WORDS})\b', ' ', 'g'), '\s+', ' ', 'g')) AS formless
FROM y""")
def strength_and_form(spark, sf_dir):
    size, name = F.col("p_size").cast("string"), F.col("p_name")
    texts = F.array(F.concat(name, F.lit(" "), size, F.lit("mg")), F.concat(name, F.lit(" "), size, F.lit(".5 ML/"), (F.col("p_size") + 1).cast("string"), F.lit(" ml syr")), F.concat(size, F.lit(" mg + "), (F.col("p_size") * 2).cast("string"), F.lit("mcg tabs "), name), F.concat(name, F.lit(" "), size), F.concat(name, F.lit(" susp "), size, F.lit(" grams x")))
    x = _table(spark, sf_dir, "part").select("p_partkey", F.explode(texts).alias("t")).withColumn("s", T.strength("t"))
    one = F.get("s.components", F.lit(0))
    return x.select("p_partkey", "t", F.size("s.components").alias("n_components"), one["value"].cast("double").alias("value"), one["unit"].alias("unit"), F.col("s.per_value").cast("double").alias("per_value"), F.col("s.per_unit").alias("per_unit"), T.strip_strength("t").alias("stripped"), T.dosage_form("t").alias("form"), T.strip_form("t").alias("formless"))


_NOTES = ["1 tablet BD 5 days", "Take 2 caps tds for 1 week", "1/2-0-1 after food", "1-0-1 (Tot:8 Tab) 3 days", "1 Morning, 1 Night (After Food) 8 Days", "t-0-0 10 days", "after food", "500mg 1 - 0 ", "(250) at 9 pm", "Evening 0.5/5 SOS", "half tsp HS D3", "nothing here", "1 Morning (Before Food)", "Forte 1-o-1", "2 puffs at bedtime for 2 months", ""]
_SQL_NOTES = "(SELECT unnest(range(1, {n} + 1)) AS id, unnest([{v}]) AS t)".format(n=len(_NOTES), v=", ".join(f"'{t}'" for t in _NOTES))


def _sql_first(x: str, pattern: str, k: int = 0) -> str:
    return f"nullif(trim(regexp_extract({x}, '{pattern}', {k})), '')"


_FRACTION = r"\b([0-9]/[0-9]|[0-9])\s*-\s*([0-9]/[0-9]|[0-9])\s*-\s*([0-9]/[0-9]|[0-9])\b"
_OPTICAL = r"(?i)\b([01tli])\s*[-/]\s*([01tlio])\s*[-/]\s*([01tlio])\b"
_SQL_FREQUENCY = "\n".join([
    "CASE",
    *(rf"WHEN regexp_matches(upper(t), '\b{k}\b') THEN '{v}'" for k, v in FREQUENCIES.items() if k not in MEAL_PHRASES),
    rf"WHEN regexp_matches(t, '{_FRACTION}') THEN concat_ws('-', {', '.join(f'regexp_extract(t, {chr(39)}{_FRACTION}{chr(39)}, {k})' for k in (1, 2, 3))}) || ' (M-A-N)'",
    r"WHEN regexp_matches(t, '\b([0-9]|-)\s*[-/]\s*([0-9]|-)\s*[-/]\s*([0-9]|-)\b') THEN regexp_extract(t, '\b([0-9]|-)\s*[-/]\s*([0-9]|-)\s*[-/]\s*([0-9]|-)\b') || ' (M-A-N)'",
    rf"WHEN regexp_matches(t, '{_OPTICAL}') THEN concat_ws('-', {', '.join(f'CASE WHEN lower(regexp_extract(t, {chr(39)}{_OPTICAL}{chr(39)}, {k})) IN ({chr(39)}1{chr(39)}, {chr(39)}t{chr(39)}, {chr(39)}l{chr(39)}, {chr(39)}i{chr(39)}) THEN {chr(39)}1{chr(39)} ELSE {chr(39)}0{chr(39)} END' for k in (1, 2, 3))}) || ' (M-A-N)'",
    r"WHEN regexp_matches(t, '(?i)\bmorning\b') AND regexp_matches(t, '(?i)\b(?:night|bedtime)\b') THEN 'Twice Daily (Morning, Night)'",
    r"WHEN regexp_matches(t, '(?i)\bmorning\b') THEN 'Morning' WHEN regexp_matches(t, '(?i)\b(?:night|bedtime)\b') THEN 'Night' WHEN regexp_matches(t, '(?i)\b(?:evening|ep)\b') THEN 'Evening'",
    r"WHEN regexp_matches(t, '(?i)\b[0-9]{1,2}\s*(?:AM|PM)\b') THEN upper(trim(regexp_extract(t, '(?i)\b[0-9]{1,2}\s*(?:AM|PM)\b')))",
    *(rf"WHEN regexp_matches(upper(t), '\b{k}\b') THEN '{FREQUENCIES[k]}'" for k in MEAL_PHRASES),
    r"WHEN regexp_matches(t, '\b[0-9]\s*-\s*[0-9]\b') THEN replace(regexp_extract(t, '\b[0-9]\s*-\s*[0-9]\b'), ' ', '')",
    "ELSE 'N/A' END",
])


@query(rf"""
SELECT n_nationkey, id, t, {_SQL_FREQUENCY} AS frequency,
  coalesce({_sql_first(r"regexp_replace(t, '(?i)\(?\s*tot(?:al)?\s*[:.]?\s*[0-9]+\s*\w*\)?', ' ', 'g')", r"(?i)\b(?:[0-9]+/[0-9]+|[0-9]+(?:\.[0-9]+)?|half|one|two|three)\s*-?\s*(?:tablets?|tabs?|capsules?|caps?|drops?|puffs?|spoons?|tsp|teaspoons?)\b")}, 'N/A') AS dosage,
  coalesce({_sql_first('t', r"(?i)\b[0-9]+\s?(?:days|day|weeks|week|months|month)\b")}, 'N/A') AS duration,
  coalesce({_sql_first('t', r"(?i)[0-9]{1,4}(?:\.[0-9]+)?\s?(?:mg|ml|mcg|iu|gm?)\b")}, {_sql_first('t', r"(?i)[(\[]\s*([0-9]{1,4})\s*(?:mg|ml)?[)\]]", 1)} || 'mg', {_sql_first('t', r"\(?\s*[0-9]+(?:\.[0-9]+)?\s*/\s*[0-9]+(?:\.[0-9]+)?\s*\)?")}, {_sql_first('t', r"(?i)\b(?:CD3|D3|Plus|NXT|SR|XL|Forte)\b")}, 'N/A') AS strength_text
FROM {_SQL_NOTES}, nation""")
def instruction_fields(spark, sf_dir):
    notes = F.array(*[F.struct(F.lit(k + 1).cast("long").alias("id"), F.lit(t).alias("t")) for k, t in enumerate(_NOTES)])
    x = _table(spark, sf_dir, "nation").select("n_nationkey", F.explode(notes).alias("n")).select("n_nationkey", "n.id", "n.t")
    return x.select("n_nationkey", "id", "t", T.frequency("t").alias("frequency"), T.dosage("t").alias("dosage"), T.duration("t").alias("duration"), T.strength_text("t").alias("strength_text"))


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


@query(rf"""
WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents WHERE length(trim(text)) > 0),
k AS (SELECT doc_id, line_no, unnest(list_filter(string_split(trim(regexp_replace(regexp_replace(line, '[^A-Za-z0-9\s/\-().]', ' ', 'g'), '{_SQL_SPACE}+', ' ', 'g')), ' '), lambda w: w <> '')) AS w FROM l),
c AS (SELECT doc_id, line_no, trim(regexp_replace(w, '[^A-Za-z0-9\s\-]', '', 'g')) AS w FROM k)
SELECT doc_id, line_no, count(*) AS n_tokens, count(*) FILTER (w = '' OR lower(regexp_replace(w, '[^a-zA-Z]', '', 'g')) IN ({_STOP})
    OR regexp_full_match(w, '[0-9]+(?:\.[0-9]+)?') OR upper(w) IN ({', '.join(f"'{k}'" for k in FREQUENCIES)})
    OR regexp_full_match(w, '[0-9]-[0-9]-[0-9]') OR regexp_full_match(w, '(?i)[0-9]+\s?(day|days|week|weeks|month|months)')
    OR len(list_filter(regexp_extract_all(lower(w), '[a-z]+'), lambda v: {_SQL_FORMS}[v] IS NOT NULL)) > 0) AS n_noise
FROM c GROUP BY doc_id, line_no""")
def tokenize_lines(spark, sf_dir):
    lines = layout.text_lines(_table(spark, sf_dir, "documents"))
    tokens = lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), T.tokenize("text").alias("w"))
    return tokens.select("doc_id", "line_no", F.size("w").cast("long").alias("n_tokens"), F.size(F.filter("w", T.is_noise)).cast("long").alias("n_noise")).filter("n_tokens > 0")


def _sql_replaced(x: str, old: str, new: str) -> str:
    return f"list_transform(list_filter(range(1, length({x}) + 1), lambda i: substring({x}, i, {len(old)}) = '{old}'), lambda i: substring({x}, 1, i - 1) || '{new}' || substring({x}, i + {len(old)}))"


_OPTICALS = " || ".join(["[t]", *(_sql_replaced("t", a, b) for a, b in OPTICAL_PAIRS)])
_CONFUSED = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {k} AS k" for a, to in CHARACTER_CONFUSIONS.items() for k, b in enumerate(to))


@query(f"""
WITH x AS (SELECT DISTINCT lower(p_name) AS t FROM part), c AS ({_CONFUSED}),
o AS (SELECT t, {_OPTICALS} AS v FROM x),
p AS (SELECT t, unnest(range(1, length(t) + 1)) AS i FROM x),
m AS (SELECT t, substring(t, 1, i - 1) || b || substring(t, i + 1) AS v, row_number() OVER (PARTITION BY t ORDER BY i, k) AS turn FROM p JOIN c ON substring(t, i, 1) = a)
SELECT t, 'optical' AS kind, unnest(range(0, len(v))) AS turn, unnest(v) AS variant FROM o
UNION ALL SELECT t, 'character', 0, t FROM x UNION ALL SELECT t, 'character', turn, v FROM m""")
def name_variants(spark, sf_dir):
    x = _table(spark, sf_dir, "part").select(F.lower("p_name").alias("t")).distinct()
    made = [x.select("t", F.lit(k).alias("kind"), F.posexplode(f("t")).alias("turn", "variant")) for k, f in (("optical", T.optical_variants), ("character", T.character_variants))]
    return made[0].unionByName(made[1]).withColumn("turn", F.col("turn").cast("long"))


# ---------------------------------------------------------------- catalog

def part_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each name of `part`."""
    parts = _table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"), F.min("p_size").alias("size"))
    form = F.element_at(F.array(F.lit("tablet"), F.lit("syrup"), F.lit(None)), (F.col("size") % 3 + 1).cast("int"))
    word = lambda n: F.element_at(F.split("p_name", " "), n)
    return parts.select(
        F.concat(F.lit("part:"), T.slug("p_name")).alias("external_id"), word(2).alias("generic_name"), F.when(F.col("k") % 4 > 0, F.col("p_name")).alias("brand_name"),
        F.array(F.when(F.col("k") % 2 == 0, F.concat(word(1), F.lit("-"), word(2))).otherwise(F.concat(word(1), F.lit(" plus"))), F.upper(word(1)), F.lit(" ")).alias("aliases"), F.col("size").cast("decimal(10,3)").alias("strength_value"), F.lit("mg").alias("strength_unit"),
        form.alias("dosage_form"), F.element_at(F.array(F.lit("legacy_manual"), F.lit("abdm"), F.lit("rxnorm")), (F.col("k") % 3 + 1).cast("int")).alias("source"),
        F.when(F.col("k") % 5 == 0, UNCLASSIFIED).otherwise("v1").alias("source_version"),
    )


def part_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.derived(part_records(spark, sf_dir))


_SQL_SLUG = "coalesce(nullif(regexp_replace(regexp_replace(lower(trim({x})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unknown')"
_SQL_CATALOG = f"""
raw AS (SELECT p_name, min(p_partkey) AS k, ['tablet', 'syrup', NULL][min(p_size) % 3 + 1] AS dosage_form, min(p_size) AS size FROM part GROUP BY p_name),
rec AS (SELECT 'part:' || {_SQL_SLUG.format(x='p_name')} AS external_id, string_split(p_name, ' ')[2] AS generic_name,
  CASE WHEN k % 4 > 0 THEN p_name END AS brand_name,
  list_sort(list_distinct([CASE WHEN k % 2 = 0 THEN {_sql_normalize("string_split(p_name, ' ')[1] || '-' || string_split(p_name, ' ')[2]")} ELSE string_split(p_name, ' ')[1] || ' plus' END, {_sql_normalize("string_split(p_name, ' ')[1]")}])) AS aliases,
  size::DOUBLE AS strength_value, 'mg' AS strength_unit, dosage_form, ['legacy_manual', 'abdm', 'rxnorm'][k % 3 + 1] AS source,
  CASE WHEN k % 5 = 0 THEN '{UNCLASSIFIED}' ELSE 'v1' END AS source_version FROM raw),
cat AS (SELECT *, sha256(source || '|' || external_id) AS id, {_sql_normalize('generic_name')} AS canonical_name,
  lower(array_to_string(list_filter([trim(generic_name), trim(brand_name)] || aliases, lambda p: p IS NOT NULL AND p <> ''), ' ')) AS search_text,
  CASE source WHEN 'legacy_manual' THEN 0 WHEN 'abdm' THEN 1 ELSE 2 END AS priority, (brand_name IS NULL)::INT AS missing FROM rec),
keys AS (SELECT key, id, is_alias, priority, missing, external_id FROM (
  SELECT lower(generic_name) AS key, id, false AS is_alias, priority, missing, external_id FROM cat
  UNION SELECT lower(brand_name), id, false, priority, missing, external_id FROM cat
  UNION SELECT unnest(aliases), id, true, priority, missing, external_id FROM cat) WHERE key IS NOT NULL),
best AS (SELECT key, arg_min(id, (priority, missing, external_id)) AS exact_id, arg_min(id, (priority, missing, external_id)) FILTER (is_alias) AS alias_id FROM keys GROUP BY key)"""


@query(f"WITH {_SQL_CATALOG} SELECT external_id, generic_name, brand_name, array_to_string(aliases, '|') AS aliases, strength_value, dosage_form, source, id, canonical_name, search_text FROM cat")
def catalog_build(spark, sf_dir):
    return part_catalog(spark, sf_dir).select("external_id", "generic_name", "brand_name", F.array_join("aliases", "|").alias("aliases"), F.col("strength_value").cast("double").alias("strength_value"), "dosage_form", "source", "id", "canonical_name", "search_text")


@query(f"""
WITH raw AS (SELECT p_name, min(p_partkey) AS k, lower(min(p_type)) AS form FROM part GROUP BY p_name),
a AS (SELECT 'legacy:' || {_SQL_SLUG.format(x='p_name')} AS external_id, p_name FROM raw WHERE k % 3 <> 0),
b AS (SELECT 'legacy:' || {_SQL_SLUG.format(x='p_name')} AS external_id, p_name, string_split(p_name, ' ')[1] AS generic_name, form FROM raw WHERE k % 2 = 0)
SELECT coalesce(a.external_id, b.external_id) AS external_id, coalesce(b.generic_name, a.p_name) AS generic_name, b.p_name AS brand_name,
  b.form AS dosage_form, CASE WHEN b.external_id IS NULL OR a.external_id IS NOT NULL THEN 'unclassified_name' END AS source_version,
  {_sql_normalize('coalesce(b.generic_name, a.p_name)')} AS canonical_name
FROM a FULL JOIN b ON a.external_id = b.external_id""")
def upsert_merge(spark, sf_dir):
    parts = _table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"), F.lower(F.min("p_type")).alias("dosage_form"))
    names = names_from(parts.filter("k % 3 <> 0").select(F.col("p_name").alias("value")))
    empty = spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in C.SCHEMA.items()))
    first = C.upsert(empty, names, ("generic_name", "brand_name", "aliases", "source_version"))
    brands = parts.filter("k % 2 = 0").select(F.concat(F.lit("legacy:"), T.slug("p_name")).alias("external_id"), F.col("p_name").alias("brand_name"), F.element_at(F.split("p_name", " "), 1).alias("generic_name"), "dosage_form", F.lit("legacy_manual").alias("source"))
    return C.upsert(first, brands, ("brand_name", "generic_name", "dosage_form")).select("external_id", "generic_name", "brand_name", "dosage_form", "source_version", "canonical_name")


def part_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, first words and noise, as often as they come."""
    parts = _table(spark, sf_dir, "part")
    return parts.select("p_partkey", F.explode(F.array("p_name", F.upper(F.element_at(F.split("p_name", " "), 1)), F.concat(F.lit("  "), F.element_at(F.split("p_name", " "), 2)), F.translate("p_name", "ol", "01"))).alias("term"))


_SQL_TERMS = "terms AS (SELECT p_partkey, unnest([p_name, upper(string_split(p_name, ' ')[1]), '  ' || string_split(p_name, ' ')[2], translate(p_name, 'ol', '01')]) AS term FROM part)"


@query(f"WITH {_SQL_CATALOG}, {_SQL_TERMS} SELECT p_partkey, term, exact_id, alias_id FROM terms LEFT JOIN best ON lower(trim(term)) = key")
def exact_lookup(spark, sf_dir):
    return C.find_exact(part_terms(spark, sf_dir), part_catalog(spark, sf_dir)).select("p_partkey", "term", "exact_id", "alias_id")


@query(f"""WITH {_SQL_CATALOG}, {_SQL_TERMS}, t AS (SELECT DISTINCT term FROM terms)
SELECT term, id, row_number() OVER (PARTITION BY term ORDER BY priority, missing, external_id)::INTEGER AS place FROM t JOIN cat ON {_sql_normalize('term')} = lower(canonical_name)""")
def canonical_lookup(spark, sf_dir):
    return C.find_by_canonical(part_terms(spark, sf_dir).select("term").distinct(), part_catalog(spark, sf_dir)).select("term", "id", "place")


@query(f"""
WITH {_SQL_CATALOG}, {_SQL_TERMS},
q AS (SELECT DISTINCT trim(lower(term)) AS term FROM terms),
g AS (SELECT DISTINCT s, substring('  ' || w || ' ', i, 3) AS gram FROM (
  SELECT s, w, unnest(range(1, length(w) + 2)) AS i FROM (
    SELECT s, unnest(list_filter(regexp_split_to_array(s, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS w FROM (SELECT term AS s FROM q UNION SELECT search_text FROM cat)))),
n AS (SELECT s, count(*) AS n FROM g GROUP BY s),
p AS (SELECT q.term, cat.id, cat.external_id, x.n AS m, y.n AS n, (SELECT count(*) FROM g a JOIN g b ON a.gram = b.gram WHERE a.s = q.term AND b.s = cat.search_text) AS c
  FROM q JOIN n x ON x.s = q.term CROSS JOIN cat JOIN n y ON y.s = cat.search_text),
r AS (SELECT *, c / (m + n - c) AS similarity FROM p),
k AS (SELECT term, id, similarity, row_number() OVER (PARTITION BY term ORDER BY similarity DESC, external_id) AS place FROM r WHERE similarity >= {DEFAULTS.min_trigram_similarity})
SELECT term, id, similarity, place::INTEGER AS place FROM k WHERE place <= {DEFAULTS.candidate_limit}""")
def trigram_topk(spark, sf_dir):
    return C.search(part_terms(spark, sf_dir), part_catalog(spark, sf_dir))


@query(f"WITH {_SQL_CATALOG} SELECT external_id, generic_name, brand_name, (SELECT count(*) FROM cat) AS total FROM cat ORDER BY coalesce(generic_name, brand_name), external_id LIMIT 20 OFFSET 10")
def catalog_page(spark, sf_dir):
    rows, total = C.page(part_catalog(spark, sf_dir), 20, 10)
    return rows.select("external_id", "generic_name", "brand_name", F.lit(total).cast("long").alias("total"))


# ---------------------------------------------------------------- linkage

@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity * 2 AS c, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_discount * 10 END AS o, l_tax < 0.04 AS m FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN o IS NULL THEN c ELSE round(c * (0.5 + 0.5 * greatest(0.0, least(1.0, o))), 1) END AS fused,
  CASE WHEN NOT m THEN 'REVIEW_REQUIRED' WHEN c >= 82 THEN 'HIGH_CONFIDENCE' WHEN c >= 60 THEN 'LOW_CONFIDENCE' ELSE 'NO_MATCH' END AS status FROM x""")
def status_policy(spark, sf_dir):
    x = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 2).alias("c"), F.when(F.col("l_linenumber") % 4 != 0, F.col("l_discount") * 10).alias("o"), (F.col("l_tax") < 0.04).alias("m"))
    return x.select("l_orderkey", "l_linenumber", T.fuse_confidence("c", "o").alias("fused"), linkage.status(F.col("c"), F.col("m")).alias("status"))


@query(f"""
WITH {_SQL_CATALOG},
q AS (SELECT DISTINCT generic_name AS g, s, f FROM cat, (SELECT unnest([NULL, 1, 5, 20]) AS s), (SELECT unnest([NULL, 'tablet', 'syrup']) AS f)),
j AS (SELECT q.*, cat.*, s IS NOT NULL AND abs(strength_value - s) < 0.01 AS sm, f IS NULL OR coalesce(f = dosage_form, true) AS fm, count(*) OVER w AS n0, min(priority) OVER w AS top
  FROM q JOIN cat ON generic_name = g WINDOW w AS (PARTITION BY g, s, f)),
t AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (sm AND fm) OVER w AS nb, count(*) FILTER (sm) OVER w AS ns, count(*) FILTER (fm) OVER w AS nf
  FROM j WHERE n0 = 1 OR priority = top WINDOW w AS (PARTITION BY g, s, f))
SELECT g, s::INTEGER AS s, f, id,
  CASE WHEN n = 1 THEN true WHEN s IS NOT NULL AND f IS NOT NULL AND nb > 0 THEN nb = 1 WHEN s IS NOT NULL AND ns > 0 THEN ns = 1 AND f IS NULL
       WHEN s IS NULL AND f IS NOT NULL AND nf > 0 THEN nf = 1 ELSE false END AS is_unique
FROM t WHERE CASE WHEN n = 1 THEN true WHEN s IS NOT NULL AND f IS NOT NULL AND nb > 0 THEN sm AND fm WHEN s IS NOT NULL AND ns > 0 THEN sm
       WHEN s IS NULL AND f IS NOT NULL AND nf > 0 THEN fm ELSE true END""")
def generic_disambiguation(spark, sf_dir):
    cat = part_catalog(spark, sf_dir)
    asked = cat.select(F.col("generic_name").alias("g")).distinct().withColumn("s", F.explode(F.array(F.lit(None).cast("int"), F.lit(1), F.lit(5), F.lit(20)))).withColumn("f", F.explode(F.array(F.lit(None).cast("string"), F.lit("tablet"), F.lit("syrup"))))
    asked = asked.withColumns({"q_strength": T.strength(F.concat(F.col("s").cast("string"), F.lit("mg"))), "q_form": F.col("f"), "q": F.concat_ws("|", "g", F.coalesce(F.col("s").cast("string"), F.lit("-")), F.coalesce("f", F.lit("-")))})
    rows = asked.join(cat, F.col("g") == F.col("generic_name"))
    return linkage.disambiguate(rows).select("g", "s", "f", "id", F.col("unique").alias("is_unique"))


@query(f"""
WITH {_SQL_CATALOG}, t AS (SELECT p_partkey, p_name AS term, {_sql_normalize('p_name')} AS n FROM part),
h AS (SELECT t.*, best.exact_id, CASE WHEN alias_id = exact_id OR {_sql_normalize('brand_name')} = n THEN CASE WHEN source_version = '{UNCLASSIFIED}' THEN 'EXACT_CATALOG_NAME' WHEN alias_id = exact_id THEN 'EXACT_ALIAS' ELSE 'EXACT_BRAND' END END AS label FROM t JOIN best ON n = key JOIN cat ON cat.id = exact_id)
SELECT p_partkey, term, 'EXACT' AS status, exact_id AS matched_id, label AS match_type, 100.0::DOUBLE AS confidence FROM h WHERE label IS NOT NULL""")
def resolve_exact(spark, sf_dir):
    """Clean names: all end in the exact stage."""
    names = _table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("term"))
    return linkage.resolve(names, part_catalog(spark, sf_dir), text="term").select("p_partkey", "term", "status", "matched_id", "match_type", "confidence")


def _noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text for each row of `part`, by its key: clean, with exchanged or lost characters, with strength and form."""
    name, size = F.col("p_name"), F.col("p_size").cast("string")
    generic = F.element_at(F.split(name, " "), 2)
    kinds = [name, F.translate(name, "ol", "01"), generic, F.concat(generic, F.lit(" "), size, F.lit("mg")), F.concat(name.substr(F.lit(2), F.length(name)), F.lit(" "), (F.col("p_size") % 4).cast("string"), F.lit("mg")), F.concat(name, F.lit(" "), size, F.lit(" mg tabs")), F.replace(name, F.lit("m"), F.lit("n")), F.concat(generic, F.lit("x syrup")), F.replace(generic, F.lit("i"), F.lit("1")), F.concat(F.lit("zq "), F.reverse(name))]
    return _table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*kinds), (F.col("p_partkey") % len(kinds) + 1).cast("int")).alias("input_text"))


_SQL_GENERIC = "string_split(p_name, ' ')[2]"
_SQL_NOISY = f"""noisy AS (SELECT p_partkey, [p_name, translate(p_name, 'ol', '01'), {_SQL_GENERIC}, {_SQL_GENERIC} || ' ' || p_size || 'mg', substring(p_name, 2) || ' ' || (p_size % 4) || 'mg',
  p_name || ' ' || p_size || ' mg tabs', replace(p_name, 'm', 'n'), {_SQL_GENERIC} || 'x syrup', replace({_SQL_GENERIC}, 'i', '1'), 'zq ' || reverse(p_name)][p_partkey % 10 + 1] AS input_text FROM part)"""


def _sql_common(a: str, b: str) -> str:
    """Length of the longest common subsequence, a bit for each character of a (120 at most)."""
    full = f"((1::HUGEINT << length({a})::HUGEINT) - 1)"
    masks = f"list_transform(string_split({b}, ''), lambda c: coalesce(list_sum(list_transform(range(length({a})), lambda i: CASE WHEN substring({a}, i + 1, 1) = c THEN 1::HUGEINT << i::HUGEINT ELSE 0::HUGEINT END)), 0)::HUGEINT)"
    return f"(length({a}) - bit_count(list_reduce({masks}, lambda s, m: ((s + (s & m)) | (s - (s & m))) & {full}, {full})))"


def _sql_ratio(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 100e0 ELSE 200e0 * {_sql_common(a, b)} / (length({a}) + length({b})) END"


def _sql_partial(a: str, b: str) -> str:
    def windows(s: str, l: str) -> str:
        part = f"substring({l}, greatest(0, j) + 1, j + length({s}) - greatest(0, j))"
        return f"list_max(list_transform(range(1 - length({s}), length({l})), lambda j: {_sql_ratio(s, part)}))"

    return f"CASE WHEN least(length({a}), length({b})) = 0 THEN CASE WHEN length({a}) = length({b}) THEN 100e0 ELSE 0e0 END WHEN length({a}) <= length({b}) THEN {windows(a, b)} ELSE {windows(b, a)} END"


# From terms (term) and cat: near (term, id, similarity, external_id, base), the candidates of each term and their scores.
_SQL_NEAR = rf"""
grams AS (SELECT DISTINCT s, substring('  ' || w || ' ', i, 3) AS gram FROM (
  SELECT s, w, unnest(range(1, length(w) + 2)) AS i FROM (
    SELECT s, unnest(list_filter(regexp_split_to_array(s, '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) AS w FROM (SELECT term AS s FROM terms UNION SELECT search_text FROM cat)))),
sizes AS (SELECT s, count(*) AS n FROM grams GROUP BY s),
shared AS (SELECT a.s AS term, cat.id, any_value(external_id) AS external_id, any_value(search_text) AS search_text, count(*) AS c FROM terms JOIN grams a ON a.s = term JOIN grams b ON a.gram = b.gram JOIN cat ON b.s = search_text GROUP BY ALL),
alike AS (SELECT term, id, external_id, c / (x.n + y.n - c) AS similarity FROM shared JOIN sizes x ON x.s = term JOIN sizes y ON y.s = search_text),
tops AS (SELECT * FROM alike WHERE similarity >= {DEFAULTS.min_trigram_similarity} QUALIFY row_number() OVER (PARTITION BY term ORDER BY similarity DESC, external_id) <= LIMIT_OF_TERM),
named AS (SELECT tops.*, unnest([lower(brand_name), lower(generic_name)]) AS name FROM tops JOIN cat USING (id)),
pairs AS (SELECT DISTINCT term AS a, name AS b FROM named WHERE name <> ''),
split1 AS (SELECT *, list_filter(string_split(a, ' '), lambda w: w <> '') AS x, list_filter(string_split(b, ' '), lambda w: w <> '') AS y FROM pairs),
split2 AS (SELECT *, array_to_string(list_sort(x), ' ') AS sa, array_to_string(list_sort(y), ' ') AS sb,
  array_to_string(list_sort(list_filter(list_distinct(x), lambda w: list_contains(y, w))), ' ') AS common,
  array_to_string(list_sort(list_filter(list_distinct(x), lambda w: NOT list_contains(y, w))), ' ') AS oa,
  array_to_string(list_sort(list_filter(list_distinct(y), lambda w: NOT list_contains(x, w))), ' ') AS ob FROM split1),
whole AS (SELECT *, greatest(length(a), length(b)) / least(length(a), length(b)) AS lengths, {_sql_ratio('a', 'b')} AS r0,
  length(common) + (common <> '')::INT + length(oa) AS fa, length(common) + (common <> '')::INT + length(ob) AS fb FROM split2),
token AS (SELECT *, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0e0 WHEN common <> '' AND (oa = '' OR ob = '') THEN 100e0 ELSE greatest(100e0 - 100e0 * (length(oa) + length(ob) - 2 * {_sql_common('oa', 'ob')}) / (fa + fb),
  CASE WHEN common <> '' THEN greatest(100e0 - 100e0 * (fa - length(common)) / (length(common) + fa), 100e0 - 100e0 * (fb - length(common)) / (length(common) + fb)) ELSE 0e0 END) END AS ts FROM whole),
weighted AS (SELECT *, CASE WHEN lengths < 1.5 THEN greatest(r0, 0.95e0 * greatest({_sql_ratio('sa', 'sb')}, ts))
  ELSE greatest(r0, (CASE WHEN lengths <= 8 THEN 0.9e0 ELSE 0.6e0 END) * {_sql_partial('a', 'b')},
    0.95e0 * (CASE WHEN lengths <= 8 THEN 0.9e0 ELSE 0.6e0 END) * CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0e0 WHEN common <> '' THEN 100e0 ELSE greatest({_sql_partial('sa', 'sb')}, {_sql_partial('oa', 'ob')}) END) END AS wr FROM token),
gapped AS (SELECT *, greatest(wr, ts) - CASE WHEN abs(length(a) - length(b)) >= 3 THEN 4 * abs(length(a) - length(b)) ELSE 0 END AS raw_score, least(4, length(a), length(b)) AS n FROM weighted),
scores AS (SELECT a, b, greatest(0e0, least(100e0, CASE WHEN n > 0 AND substring(a, 1, n) = substring(b, 1, n) AND raw_score >= 70 THEN least(100e0, raw_score + 10) ELSE raw_score END)) AS base FROM gapped),
near AS (SELECT term, id, similarity, external_id, max(base) AS base FROM named JOIN scores ON a = term AND b = name GROUP BY ALL)"""


def _sql_label(stage: str) -> str:
    """The label of a row of cat by its stage."""
    kind = "CASE WHEN coalesce(brand_name, '') <> '' THEN 'BRAND' ELSE 'GENERIC' END"
    known = {"alias": "'EXACT_ALIAS'", "brand": "'EXACT_BRAND'", "generic": "CASE WHEN source = 'rxnorm' THEN 'EXACT_GENERIC_RXNORM' ELSE 'EXACT_GENERIC' END", "ocr": f"'OCR_NORMALIZED_' || {kind}", "fuzzy": f"'FUZZY_' || {kind}"}
    other = {"ocr": "OCR_NORMALIZED_CATALOG_NAME", "fuzzy": "FUZZY_CATALOG_NAME"}.get(stage, "EXACT_CATALOG_NAME")
    return f"CASE WHEN source_version = '{UNCLASSIFIED}' THEN '{other}' ELSE {known[stage]} END"


def _sql_resolve(strict: bool) -> str:
    """All stages. The texts state one strength at most, and normalizing leaves it as it is."""
    squeeze = "trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    stripped = squeeze.format(x=f"regexp_replace(q, '{_SQL_SINGLE}', ' ', 'g')")
    name = squeeze.format(x=rf"regexp_replace({stripped}, '(?i)\b(?:{_FORM_WORDS})\b', ' ', 'g')")
    strength_clash = "(sv IS NOT NULL AND NOT sm)"
    clash = f"({strength_clash} OR NOT fm)" if strict else strength_clash
    never = f"({strength_clash} OR NOT fm)" if strict else "false"
    return f"""
WITH {_SQL_CATALOG}, {_SQL_NOISY}, confused AS ({_CONFUSED}),
norm AS (SELECT *, {_sql_normalize('input_text')} AS q FROM noisy),
parsed AS (SELECT q, {_sql_number('q', _SQL_SINGLE, 1)} AS sv, nullif({_sql_unit('q', _SQL_SINGLE, 2)}, '') AS su,
  list_filter(list_transform(regexp_extract_all(lower(q), '[a-z]+'), lambda w: {_SQL_FORMS}[w]), lambda f: f IS NOT NULL)[1] AS f, coalesce(nullif({name}, ''), q) AS name FROM (SELECT DISTINCT q FROM norm WHERE q <> '')),
facts AS (SELECT parsed.*, cat.*, coalesce(su = strength_unit AND abs(strength_value - sv) < 0.01, false) AS sm, su = strength_unit AS same_unit, f IS NULL OR dosage_form IS NULL OR f = dosage_form AS fm FROM parsed CROSS JOIN cat),
tries AS (SELECT q, 0 AS turn, q AS term FROM parsed UNION ALL SELECT q, 1, name FROM parsed WHERE name <> q),
exacts AS (SELECT facts.q, turn, facts.id, {clash} AS clash, alias_id = exact_id AS by_alias, CASE WHEN alias_id = exact_id THEN {_sql_label('alias')} ELSE {_sql_label('brand')} END AS label
  FROM tries JOIN best ON term = key JOIN facts ON facts.q = tries.q AND facts.id = exact_id WHERE coalesce(alias_id = exact_id, false) OR {_sql_normalize('brand_name')} = term),
exact AS (SELECT q, CASE WHEN clash THEN 'REVIEW_REQUIRED' ELSE 'EXACT' END AS status, id, label, CASE WHEN clash THEN 70e0 ELSE 100e0 END AS confidence, 1 AS n FROM exacts QUALIFY row_number() OVER (PARTITION BY q ORDER BY turn) = 1),
g0 AS (SELECT *, count(*) OVER (PARTITION BY q) AS n0, min(priority) OVER (PARTITION BY q) AS top FROM facts WHERE {_sql_normalize('name')} = lower(canonical_name) AND q NOT IN (SELECT q FROM exact)),
g1 AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (sm AND fm) OVER w AS nb, count(*) FILTER (sm) OVER w AS ns, count(*) FILTER (fm) OVER w AS nf FROM g0 WHERE n0 = 1 OR priority = top WINDOW w AS (PARTITION BY q)),
g2 AS (SELECT *, NOT {never} AND CASE WHEN n = 1 THEN true WHEN sv IS NOT NULL AND f IS NOT NULL AND nb > 0 THEN nb = 1 WHEN sv IS NOT NULL AND ns > 0 THEN ns = 1 AND f IS NULL WHEN sv IS NULL AND f IS NOT NULL AND nf > 0 THEN nf = 1 ELSE false END AS is_unique
  FROM g1 WHERE CASE WHEN n = 1 THEN true WHEN sv IS NOT NULL AND f IS NOT NULL AND nb > 0 THEN sm AND fm WHEN sv IS NOT NULL AND ns > 0 THEN sm WHEN sv IS NULL AND f IS NOT NULL AND nf > 0 THEN fm ELSE true END),
g3 AS (SELECT *, {_sql_label('generic')} AS label, bool_and(is_unique) OVER (PARTITION BY q) AS every, count(*) OVER (PARTITION BY q) AS many FROM g2),
generic AS (SELECT q, CASE WHEN every THEN 'EXACT' ELSE 'REVIEW_REQUIRED' END AS status, id, label, CASE WHEN is_unique THEN 100e0 ELSE 85e0 END AS confidence, many AS n FROM g3 QUALIFY row_number() OVER (PARTITION BY q ORDER BY priority, missing, external_id) = 1),
rest AS (SELECT q, name AS t FROM parsed WHERE q NOT IN (SELECT q FROM exact UNION SELECT q FROM generic)),
opticals AS (SELECT q, unnest(range(len(v) - 1)) AS k, unnest(v[2:]) AS term FROM (SELECT q, {_OPTICALS} AS v FROM rest)),
characters AS (SELECT q, row_number() OVER (PARTITION BY q ORDER BY i, k) AS k, substring(t, 1, i - 1) || b || substring(t, i + 1) AS term FROM (SELECT q, t, unnest(range(1, length(t) + 1)) AS i FROM rest) JOIN confused ON substring(t, i, 1) = a),
variants AS (SELECT q, 0 AS part, 0 AS k, q AS term, 'fuzzy' AS stage FROM rest UNION ALL SELECT q, 0, 1, t, 'fuzzy' FROM rest WHERE t <> q
  UNION ALL SELECT q, 1, k, term, 'ocr' FROM opticals UNION ALL SELECT q, 2, k, term, 'ocr' FROM characters),
asked AS (SELECT q, row_number() OVER (PARTITION BY q ORDER BY part, k) AS turn, lower(trim(term)) AS term, stage FROM variants),
met AS (SELECT asked.*, CASE WHEN stage = 'ocr' THEN exact_id END AS exact_id FROM asked LEFT JOIN best ON key = term WHERE term <> ''),
terms AS (SELECT DISTINCT term FROM met WHERE exact_id IS NULL),{_SQL_NEAR.replace("LIMIT_OF_TERM", str(DEFAULTS.candidate_limit))},
every AS (SELECT q, turn, stage, exact_id AS id, 100e0 AS base, 1e0 AS similarity, true AS verified FROM met WHERE exact_id IS NOT NULL
  UNION ALL SELECT q, turn, stage, id, base, similarity, false FROM met JOIN near USING (term) WHERE exact_id IS NULL),
judged AS (SELECT e.q, e.id, e.turn, e.similarity, external_id, verified AND NOT {never} AS verified,
  CASE WHEN verified AND {never} THEN 70e0 WHEN verified THEN 100e0 ELSE greatest(0e0, least(100e0, base
    + CASE WHEN sv IS NULL THEN 0e0 WHEN sm THEN {DEFAULTS.strength_match_bonus}e0 WHEN same_unit THEN -{DEFAULTS.strength_mismatch_penalty}e0 ELSE 0e0 END
    + CASE WHEN fm THEN 0e0 ELSE -{DEFAULTS.form_mismatch_penalty}e0 END + CASE WHEN priority = 0 THEN {DEFAULTS.source_priority_bonus}e0 ELSE 0e0 END)) END AS score,
  CASE WHEN stage = 'fuzzy' THEN {_sql_label('fuzzy')} ELSE {_sql_label('ocr')} END AS label, sm OR coalesce(f = dosage_form, false) AS sure FROM every e JOIN facts USING (q, id)),
merged AS (SELECT q, id, any_value(external_id) AS external_id, arg_min(struct_pack(score := score, label := label), (NOT verified, -score, turn)) AS b, bool_or(verified) AS verified, min(turn) AS turn, max(similarity) AS similarity, bool_or(sure) AS sure FROM judged GROUP BY q, id),
placed AS (SELECT *, CAST(printf('%.1f', b.score) AS DOUBLE) AS confidence, row_number() OVER (PARTITION BY q ORDER BY b.score DESC, turn, similarity DESC, external_id) AS place FROM merged),
listed AS (SELECT q, count(*) AS n, max(id) FILTER (place = 1) AS id, max(b.label) FILTER (place = 1) AS label, max(confidence) FILTER (place = 1) AS confidence, max(confidence) FILTER (place = 2) AS second, bool_or(verified OR sure) FILTER (place = 1) AS backed
  FROM placed WHERE place <= {DEFAULTS.candidate_limit} GROUP BY q),
raw_fuzzy AS (SELECT *, CASE WHEN n > 1 AND confidence - second < {DEFAULTS.ambiguity_margin} THEN 'REVIEW_REQUIRED' WHEN confidence >= {DEFAULTS.match_threshold} THEN 'HIGH_CONFIDENCE' WHEN confidence >= {DEFAULTS.low_confidence_threshold} THEN 'LOW_CONFIDENCE' ELSE 'NO_MATCH' END AS st FROM listed),
fuzzy AS (SELECT q, CASE WHEN st = 'HIGH_CONFIDENCE' AND NOT backed THEN 'REVIEW_REQUIRED' ELSE st END AS status, id, label, confidence, CASE WHEN st = 'NO_MATCH' THEN 0 ELSE n END AS n FROM raw_fuzzy),
answers AS (SELECT * FROM exact UNION ALL SELECT * FROM generic UNION ALL SELECT * FROM fuzzy)
SELECT p_partkey, input_text, coalesce(status, 'NO_MATCH') AS status, CASE WHEN status IN ('EXACT', 'HIGH_CONFIDENCE') THEN id END AS matched_id, CASE WHEN status IN ('EXACT', 'HIGH_CONFIDENCE') THEN label END AS match_type,
  CASE WHEN status IN ('EXACT', 'HIGH_CONFIDENCE') THEN confidence END AS confidence, coalesce(n, 0)::INTEGER AS n_candidates FROM norm LEFT JOIN answers USING (q)"""


def _resolved(spark: SparkSession, sf_dir: str, **settings) -> DataFrame:
    found = linkage.resolve(_noisy(spark, sf_dir), part_catalog(spark, sf_dir), type(DEFAULTS)(**settings))
    return found.select("p_partkey", "input_text", "status", "matched_id", "match_type", "confidence", F.size("candidates").alias("n_candidates"))


@query(_sql_resolve(False))
def resolve_batch(spark, sf_dir):
    """Every stage."""
    return _resolved(spark, sf_dir)


@query(_sql_resolve(True))
def resolve_batch_strict(spark, sf_dir):
    return _resolved(spark, sf_dir, strict_strength=True, decimal_safe=True)


@query(f"""
WITH {_SQL_CATALOG}, {_SQL_NOISY},
t0 AS (SELECT DISTINCT input_text AS token, lower(trim(input_text)) AS t FROM noisy),
hits AS (SELECT t0.*, exact_id, alias_id FROM t0 LEFT JOIN best ON t = key),
made AS (SELECT token, unnest(range(len(v))) AS turn, unnest(v) AS term FROM (SELECT token, {_OPTICALS} AS v FROM hits WHERE exact_id IS NULL)),
terms AS (SELECT DISTINCT lower(trim(term)) AS term FROM made),{_SQL_NEAR.replace("LIMIT_OF_TERM", str(DEFAULTS.candidate_limit))},
ranked AS (SELECT token, turn, id, base, row_number() OVER (PARTITION BY token, turn ORDER BY base DESC, similarity DESC, external_id) AS place FROM made JOIN near USING (term)),
two AS (SELECT token, turn, max(id) FILTER (place = 1) AS id, max(base) AS base, max(base) FILTER (place = 2) AS next FROM ranked WHERE place <= 2 GROUP BY ALL),
raw_best AS (SELECT * FROM two WHERE turn = 0),
variant AS (SELECT * FROM two WHERE turn > 0 QUALIFY row_number() OVER (PARTITION BY token ORDER BY base DESC, turn) = 1),
picked AS (SELECT h.token, coalesce(r.base >= {DEFAULTS.match_threshold}, false) AS by_raw, coalesce(v.base >= {DEFAULTS.match_threshold}, false) AS by_variant, r.id AS rid, r.base AS rb, coalesce(r.base - r.next < {DEFAULTS.ambiguity_margin}, false) AS rc,
  v.id AS vid, v.base AS vb, coalesce(v.base - v.next < {DEFAULTS.ambiguity_margin}, false) AS vc FROM hits h LEFT JOIN raw_best r USING (token) LEFT JOIN variant v USING (token) WHERE exact_id IS NULL)
SELECT token, exact_id AS id, 100e0 AS confidence, CASE WHEN coalesce(alias_id = exact_id, false) THEN 'alias' ELSE 'exact' END AS match_type FROM hits WHERE exact_id IS NOT NULL
UNION ALL SELECT token, CASE WHEN by_raw AND NOT rc THEN rid WHEN NOT by_raw AND by_variant AND NOT vc THEN vid END, coalesce(CASE WHEN by_raw THEN rb WHEN by_variant THEN vb END, rb, vb, 0e0),
  CASE WHEN by_raw THEN CASE WHEN rc THEN 'ambiguous' ELSE 'fuzzy' END WHEN by_variant THEN CASE WHEN vc THEN 'ambiguous' ELSE 'ocr_corrected' END ELSE 'unresolved' END FROM picked""")
def match_tokens(spark, sf_dir):
    tokens = _noisy(spark, sf_dir).select(F.col("input_text").alias("token")).distinct()
    return linkage.match_tokens(tokens, part_catalog(spark, sf_dir))


@query(f"""
WITH {_SQL_CATALOG}, {_SQL_TERMS.replace('terms AS', 'given AS')},
terms AS (SELECT DISTINCT lower(trim(term)) AS term FROM given WHERE trim(term) <> ''),{_SQL_NEAR.replace("LIMIT_OF_TERM", "10")},
first_hits AS (SELECT term, exact_id AS id, 100e0 AS confidence, 1e0 AS similarity, CASE WHEN coalesce(alias_id = exact_id, false) THEN 'alias' ELSE 'exact' END AS match_type FROM terms JOIN best ON key = term),
every AS (SELECT * FROM first_hits UNION ALL SELECT term, id, base, similarity, 'fuzzy' FROM near WHERE NOT EXISTS (FROM first_hits f WHERE f.term = near.term AND f.id = near.id))
SELECT term, row_number() OVER (PARTITION BY term ORDER BY match_type = 'fuzzy', confidence DESC, similarity DESC, external_id)::INTEGER AS place, id, confidence, match_type FROM every JOIN cat USING (id) QUALIFY place <= 10""")
def search_many(spark, sf_dir):
    return linkage.search_many(part_terms(spark, sf_dir).select("term").distinct(), part_catalog(spark, sf_dir))


# ---------------------------------------------------------------- documents

_WORDS = [("Dolo", 0.95, 10, 100, 60, 20), ("650", 0.9, 80, 102, 40, 20), ("1-0-1", 0.9, 130, 101, 50, 20), ("5", 0.9, 190, 100, 10, 20), ("days", 0.9, 210, 103, 40, 20), ("Pan", 0.8, 10, 140, 40, 20), ("40", 0.8, 60, 141, 30, 20), ("0-0-1", 0.8, 130, 142, 50, 20), (".", 0.9, 5, 5, 5, 5), ("low", 0.05, 5, 5, 5, 5), ("T", 0.5, 300, 141, 10, 20)]
_EXPECTED = [(0, "Dolo 650 1-0-1 days", 10, 100, 240, 23, 0.9), (1, "Pan 40 0-0-1 T", 10, 140, 300, 22, 0.5)]


@query("SELECT n_nationkey, unnest([{a}])::INTEGER AS line_no, unnest([{b}]) AS text, unnest([{c}])::INTEGER AS x, unnest([{d}])::INTEGER AS y, unnest([{e}])::INTEGER AS width, unnest([{f}])::INTEGER AS height, unnest([{g}])::DOUBLE AS min_confidence FROM nation".format(**{k: ", ".join(repr(r[i]) for r in _EXPECTED) for i, k in enumerate("abcdefg")}))
def row_banding(spark, sf_dir):
    word = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("text", "confidence", "x", "y", "width", "height"), w, strict=True)]) for w in _WORDS])
    words = _table(spark, sf_dir, "nation").select("n_nationkey", F.explode(word).alias("w")).select("n_nationkey", "w.*")
    return layout.lines_of_words(layout.clean_words(words), doc="n_nationkey").select("n_nationkey", "line_no", "text", "x", "y", "width", "height", "min_confidence")


_AD = "(" + "|".join(re.escape(a).replace("\\ ", " ") for a in AD_FRAGMENTS) + ")"
# An advertisement fragment goes after every ninth line, or none would occur.
_SQL_LINES = f"""l0 AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents WHERE length(trim(text)) > 0),
l AS (SELECT doc_id, line_no, CASE WHEN (doc_id + line_no) % 9 = 0 THEN line || ' ' || upper([{', '.join(f"'{a}'" for a in AD_FRAGMENTS)}][(doc_id + line_no) % {len(AD_FRAGMENTS)} + 1]) ELSE line END AS line FROM l0)"""


def _with_ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, with an advertisement at the end of every ninth line."""
    def ended(line, k):
        number = F.col("doc_id") + k
        fragment = F.element_at(F.array(*map(F.lit, AD_FRAGMENTS)), (number % len(AD_FRAGMENTS) + 1).cast("int"))
        return F.when(number % 9 == 0, F.concat(line, F.lit(" "), F.upper(fragment))).otherwise(line)

    docs = _table(spark, sf_dir, "documents").filter(F.length(F.trim("text")) > 0)
    return docs.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), ended), "\n").alias("text"))


@query(rf"""
WITH {_SQL_LINES},
f AS (SELECT *, regexp_matches(lower(line), '{_AD}') AS ad, regexp_matches(lower(line), '( rx|rx |r/|treatment|medicine|medication|adv)') OR regexp_matches(lower(line), '(^|[^\p{{L}}\p{{N}}_])(tab|cap|syp|inj|ointment)($|[^\p{{L}}\p{{N}}_])') OR regexp_matches(lower(line), '(^|[^\p{{L}}\p{{N}}_])[0-9]+\s*(mg|ml|mcg)($|[^\p{{L}}\p{{N}}_])') AS hit FROM l),
s AS (SELECT *, max((hit AND NOT ad)::INT) OVER (PARTITION BY doc_id ORDER BY line_no) = 1 AS inside, max((hit AND NOT ad)::INT) OVER (PARTITION BY doc_id) = 1 AS opened FROM f)
SELECT doc_id, CASE WHEN NOT opened THEN 'medicine' WHEN ad THEN 'ad' WHEN inside THEN 'medicine' ELSE 'patient' END AS section, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM s GROUP BY ALL""")
def section_split(spark, sf_dir):
    lines = layout.text_sections(_with_ads(spark, sf_dir))
    return lines.groupBy("doc_id", "section").agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).cast("long").alias("n_chars"))


@query(rf"""
WITH {_SQL_LINES},
f AS (SELECT *, regexp_matches(lower(line), '{_AD}') AS ad, regexp_matches(lower(line), '( rx|rx |r/|treatment|medicine|medication|adv)') OR regexp_matches(lower(line), '(^|[^\p{{L}}\p{{N}}_])(tab|cap|syp|inj|ointment)($|[^\p{{L}}\p{{N}}_])') OR regexp_matches(lower(line), '(^|[^\p{{L}}\p{{N}}_])[0-9]+\s*(mg|ml|mcg)($|[^\p{{L}}\p{{N}}_])') AS hit FROM l),
s AS (SELECT *, max((hit AND NOT ad)::INT) OVER (PARTITION BY doc_id ORDER BY line_no) = 1 AS inside, max((hit AND NOT ad)::INT) OVER (PARTITION BY doc_id) = 1 AS opened FROM f)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT ad AND NOT (opened AND inside)), '') AS patient_info,
  coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT opened OR inside AND NOT ad), '') AS medicine_text, string_agg(line, chr(10) ORDER BY line_no) AS full_text,
  sum(len(string_split(line, ' ')))::BIGINT AS word_count FROM s GROUP BY doc_id""")
def page_texts(spark, sf_dir):
    return layout.page_texts(layout.sections(layout.text_lines(_with_ads(spark, sf_dir))).withColumn("words", F.split("text", " ")))


_PAGES = ["Dolo 650 1-0-1 5 days Pan 40 1-0-0 7 days", "Dolo 650\n1-0-1\n5 days\nPan 40\n1-0-0\n7 days", "Zzq 99 OD 5 days"]
_FOUND = [(0, 0, "Dolo 650", "1-0-1 (M-A-N)", "5 days"), (0, 1, "Pan 40", "1-0-0 (M-A-N)", "7 days"), (1, 0, "Dolo 650", "1-0-1 (M-A-N)", "5 days"), (1, 1, "Pan 40", "1-0-0 (M-A-N)", "7 days")]


def curated(spark: SparkSession) -> DataFrame:
    return sync(CuratedBrands(), spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in C.SCHEMA.items())))[0]


@query("SELECT (n_nationkey * 10 + unnest([{a}]))::INTEGER AS doc_id, unnest([{b}])::INTEGER AS place, unnest([{c}]) AS name, unnest([{d}]) AS frequency, unnest([{e}]) AS duration FROM nation".format(**{k: ", ".join(repr(r[i]) for r in _FOUND) for i, k in enumerate("abcde")}))
def extract_products(spark, sf_dir):
    pages = F.array(*map(F.lit, _PAGES))
    docs = _table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(pages).alias("k", "text")).select((F.col("n_nationkey") * 10 + F.col("k")).cast("int").alias("doc_id"), "text")
    return extraction.extract(layout.text_lines(docs), curated(spark)).select("doc_id", "place", "name", "frequency", "duration")


@query(r"""
WITH j AS (SELECT event_id, event_type, user_id, props FROM events)
SELECT event_id, event_type AS name, round((event_id % 100) / 100.0 * 100.0, 1) AS confidence, 'N/A' AS dosage, (user_id % 9) || ' days' AS duration, (user_id % 9)::INTEGER AS days, 'Dr. U' || user_id || chr(10) || 'Patient: P' AS info FROM j""")
def json_contract(spark, sf_dir):
    """Structured answers as JSON strings, made from events, through schema, rows and patient lines."""
    med = F.array(F.struct(F.col("event_type").alias("name"), ((F.col("event_id") % 100) / 100.0).alias("confidence"), F.concat((F.col("user_id") % 9).cast("string"), F.lit(" days")).alias("duration_text")))
    meta = F.struct(F.concat(F.lit("Dr. U"), F.col("user_id").cast("string")).alias("prescriber_name"), F.lit("P").alias("patient_name"))
    texts = _table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(meta.alias("metadata"), med.alias("medications"))).alias("json"))
    parsed = contracts.llm_extraction(contracts.parse_llm(texts)).withColumn("info", contracts.patient_info(F.col("parsed.metadata")))
    rows = contracts.llm_rows(parsed, "event_id", "extraction", "info")
    return rows.select("event_id", "name", "confidence", "dosage", "duration", F.get("extraction.medications", F.lit(0))["durationDays"].alias("days"), "info")


@query("""
WITH n AS (SELECT DISTINCT trim(p_name) AS name FROM part)
SELECT 'legacy:' || regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g') AS external_id, name AS generic_name, 'unclassified_name' AS source_version FROM n""")
def name_import(spark, sf_dir):
    names = _table(spark, sf_dir, "part").select(F.concat(F.lit(" "), F.col("p_name")).alias("value")).distinct()
    return names_from(names).select("external_id", "generic_name", "source_version")


# ---------------------------------------------------------------- contracts

_FORMS_OF = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in CONTRACT_FORMS.items()) + "}"
_ROUTES_OF = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in CONTRACT_ROUTES.items()) + "}"


@query(f"""
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE WHEN l_linenumber % 3 = 0 THEN '' WHEN l_linenumber % 3 = 1 THEN l_partkey || ' mg' END AS strength,
  CASE WHEN l_linenumber % 2 = 0 THEN 'N/A' ELSE (l_partkey % 7) || ' mg' END AS strength_text, ['Tablet', 'SYRUP', 'gel', NULL][l_partkey % 4 + 1] AS dosage_form, ['oral', 'Topical', 'rectal'][l_partkey % 3 + 1] AS route,
  CASE WHEN l_linenumber % 4 = 0 THEN 'N/A' ELSE (l_orderkey % 12) || ' days' END AS duration, CASE WHEN l_linenumber % 5 <> 0 THEN l_quantity * 2 END AS overall, l_quantity AS confidence FROM lineitem),
p AS (SELECT DISTINCT l_orderkey AS doc_id, [' Name: X ', 'Patient details not detected clearly.', ''][l_orderkey % 3 + 1] AS info FROM lineitem)
SELECT doc_id, nullif(nullif(trim(info), 'Patient details not detected clearly.'), '') AS notes, 'P' || l_partkey AS name,
  coalesce(nullif(strength, ''), nullif(strength_text, 'N/A')) AS strength, {_FORMS_OF}[lower(dosage_form)] AS form, {_ROUTES_OF}[lower(route)] AS route, nullif(duration, 'N/A') AS duration_text,
  try_cast(nullif(regexp_extract(nullif(duration, 'N/A'), '(?i)([0-9]+)\\s*day', 1), '') AS INTEGER) AS days, round(coalesce(overall, confidence) / 100, 3) AS confidence
FROM p JOIN r ON l_orderkey = doc_id""")
def extraction_contract(spark, sf_dir):
    """Rows of products, as extraction makes them, in the extraction contract, a list for each document."""
    key, line, part = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    items = _table(spark, sf_dir, "lineitem")
    pick = lambda n, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (n % len(v) + 1).cast("int"))
    rows = items.select(
        key.alias("doc_id"), line.alias("place"), F.concat(F.lit("P"), part.cast("string")).alias("name"), F.lit(None).cast("string").alias("generic_name"),
        F.when(line % 3 == 0, "").when(line % 3 == 1, F.concat(part.cast("string"), F.lit(" mg"))).alias("strength"), F.when(line % 2 == 0, "N/A").otherwise(F.concat((part % 7).cast("string"), F.lit(" mg"))).alias("strength_text"),
        pick(part, "Tablet", "SYRUP", "gel", None).alias("dosage_form"), pick(part, "oral", "Topical", "rectal").alias("route"), F.lit("N/A").alias("dosage"), F.lit("").alias("frequency"),
        F.when(line % 4 == 0, "N/A").otherwise(F.concat((key % 12).cast("string"), F.lit(" days"))).alias("duration"), F.when(line % 5 != 0, F.col("l_quantity") * 2).alias("overall_confidence"), F.col("l_quantity").alias("confidence"),
    )
    patients = items.select(key.alias("doc_id")).distinct().withColumn("patient_info", pick(F.col("doc_id"), " Name: X ", contracts.NO_PATIENT, ""))
    made = contracts.extraction(rows, patients).select("doc_id", "notes", F.explode("medications").alias("m"))
    return made.select("doc_id", "notes", "m.name", "m.strength", "m.form", "m.route", F.col("m.durationText").alias("duration_text"), F.col("m.durationDays").alias("days"), "m.confidence")


@query(f"""
WITH a AS ({_sql_resolve(False)}), {_SQL_CATALOG.lstrip()}
SELECT p_partkey, status, matched_id, generic_name, brand_name, coalesce(cat.strength_value, {_sql_number(_sql_normalize('input_text'), _SQL_SINGLE, 1)}) AS strength_value,
  CASE WHEN cat.strength_value IS NULL THEN nullif({_sql_unit(_sql_normalize('input_text'), _SQL_SINGLE, 2)}, '') ELSE cat.strength_unit END AS strength_unit, dosage_form, source FROM a LEFT JOIN cat ON id = matched_id""")
def resolve_answers(spark, sf_dir):
    catalog = part_catalog(spark, sf_dir)
    found = linkage.resolve(_noisy(spark, sf_dir), catalog)
    return contracts.resolve_answers(found, catalog).select("p_partkey", "status", "matched_id", "generic_name", "brand_name", "strength_value", "strength_unit", "dosage_form", "source")


@query(f"WITH {_SQL_CATALOG} SELECT id, generic_name, brand_name, array_to_string(aliases, '|') AS aliases, NULL::VARCHAR AS strength, strength_value, strength_unit, dosage_form, 0 AS n_components, source, source_version, canonical_name FROM cat WHERE id >= '4'")
def catalog_rows(spark, sf_dir):
    rows = C.rows_out(part_catalog(spark, sf_dir)).filter("id >= '4'")
    return rows.select("id", "generic_name", "brand_name", F.array_join("aliases", "|").alias("aliases"), "strength", "strength_value", "strength_unit", "dosage_form", F.size("combination_components").alias("n_components"), "source", "source_version", "canonical_name")


@query(f"WITH {_SQL_CATALOG} SELECT t.p_partkey, cat.id, cat.external_id FROM (SELECT p_partkey, sha256('abdm|part:' || {_SQL_SLUG.format(x='p_name')}) AS key FROM part) t JOIN cat ON cat.id = key")
def catalog_by_id(spark, sf_dir):
    keys = _table(spark, sf_dir, "part").select("p_partkey", F.sha2(F.concat(F.lit("abdm|part:"), T.slug("p_name")), 256).alias("key"))
    return C.by_ids(keys, part_catalog(spark, sf_dir), "key").select("p_partkey", "id", "external_id")


@query("""
WITH x AS (SELECT l_orderkey AS doc_id, CASE WHEN l_tax >= 0.04 THEN 'REVIEW_REQUIRED' WHEN l_quantity * 2 >= 82 THEN 'HIGH_CONFIDENCE' WHEN l_quantity * 2 >= 60 THEN 'LOW_CONFIDENCE' ELSE 'NO_MATCH' END AS status FROM lineitem)
SELECT doc_id, status, count(*) AS n FROM x GROUP BY ALL""")
def status_counts(spark, sf_dir):
    x = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), linkage.status(F.col("l_quantity") * 2, F.col("l_tax") < 0.04).alias("status"))
    return linkage.status_counts(x)


@query("""
WITH c AS (SELECT p_partkey, CASE WHEN p_partkey % 10 > 0 THEN p_partkey::VARCHAR ELSE '' END AS rxcui, upper(p_name) AS name, CASE WHEN p_partkey % 2 = 0 THEN 'PIN' END AS tty FROM part)
SELECT 'rxnorm:' || rxcui AS external_id, array_to_string(list_transform(string_split(lower(name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS generic_name, rxcui, coalesce(tty, 'IN') AS tty, 'rxnorm' AS source FROM c WHERE rxcui <> ''""")
def ingredient_import(spark, sf_dir):
    concepts = _table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 10 > 0, F.col("p_partkey").cast("string")).otherwise("").alias("rxcui"), F.concat(F.lit(" "), F.upper("p_name")).alias("name"), F.when(F.col("p_partkey") % 2 == 0, "PIN").alias("tty"))
    return ingredients_from(concepts).select("external_id", "generic_name", "rxcui", F.element_at("codes", "rxnorm_tty").alias("tty"), "source")
