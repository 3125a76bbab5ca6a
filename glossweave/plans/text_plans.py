"""Scalar text functions and the noise filter over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions import escapes, keys, locales, noise, text as tx
from ..session import evaluate_once, table
from . import derive as d
from .registry import query

WITH = "WITH "


@query("N1-N13", WITH + d.CORPUS + f"""
SELECT text, {', '.join(f'coalesce({sql}, false) AS {name}' for name, sql in d.sql_noise_rules('text').items())},
       {d.sql_noise('text')} AS is_noise
FROM (SELECT DISTINCT text FROM corpus WHERE text IS NOT NULL) c""")
def noise_flags(spark, root):
    distinct = d.corpus(spark, root).filter("text is not null").select("text").distinct()
    flags = noise.trimmed_rules(F.col("t"))
    once = evaluate_once(distinct, ["text"], t=tx.trim_ws(F.col("text"))).select("text", *[r.alias(n) for n, r in flags.items()])
    return once.withColumn("is_noise", F.expr(" OR ".join(flags)))


@query("N1-N13,A1", WITH + d.CORPUS + f"""
SELECT origin, count(*) AS total, count(*) FILTER (NOT noise) AS kept, count(*) FILTER (noise) AS dropped
FROM (SELECT origin, {d.sql_noise('text')} AS noise FROM corpus) c GROUP BY origin""")
def noise_filter(spark, root):
    # no shuffle of texts: each row is judged where it is read, only one counter per origin moves
    trimmed = evaluate_once(d.corpus(spark, root), ["origin"], t=tx.trim_ws(F.col("text")))
    counts = trimmed.groupBy("origin").agg(F.count("*").alias("total"), F.count_if(~noise.is_noise_trimmed(F.col("t"))).alias("kept"))
    return counts.withColumn("dropped", F.col("total") - F.col("kept"))


@query("N1-N13", WITH + d.CORPUS + f"""
SELECT rule, count(*) AS n, count(DISTINCT text) AS distinct_texts FROM (
  SELECT text, CASE {' '.join(f"WHEN {sql} THEN '{name}'" for name, sql in d.sql_noise_rules('text').items())} ELSE 'kept' END AS rule
  FROM corpus) c GROUP BY rule""")
def noise_first_rule(spark, root):
    # one row per text before the distinct count: a hot text collapses inside each task
    per_text = d.corpus(spark, root).groupBy("text").count()
    per_text = evaluate_once(per_text, ["text", "count"], t=tx.trim_ws(F.col("text")))
    return per_text.groupBy(noise.first_rule(F.col("t")).alias("rule")).agg(
        F.sum("count").alias("n"), F.count("text").alias("distinct_texts")
    )


ENTITY_SQL = "replace(replace(replace(replace(replace(replace(replace({0}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' ')"


@query("X8", f"""SELECT page_id, CAST(length(t) AS BIGINT) AS decoded_length, md5(t) AS decoded_md5
FROM (SELECT page_id, {ENTITY_SQL.format('html')} AS t FROM pages) p""")
def entity_decode(spark, root):
    t = tx.decode_entities(F.col("html"))
    return table(spark, root, "pages").select("page_id", F.length(t).cast("long").alias("decoded_length"), F.md5(t).alias("decoded_md5"))


@query("X6", WITH + d.LINES + " SELECT doc_id, line, text FROM lines")
def line_numbers(spark, root):
    return d.lines(spark, root).select("doc_id", "line", "text")


@query("P12", f"""SELECT doc_id, array_to_string(p, '|') AS placeholders, CAST(len(p) AS BIGINT) AS n FROM (
  SELECT doc_id, list_sort(list_transform(regexp_extract_all(text, {d.lit(fixed.PLACEHOLDER)}, 0),
         lambda x: regexp_replace(x, '^[^:{{%$]*:', ':'))) AS p
  FROM (SELECT doc_id, 'To {{name}} %1$s ' || text || ' ${{n}} %d :count' AS text FROM documents) s) t""")
def placeholder_multiset(spark, root):
    text = F.concat(F.lit("To {name} %1$s "), F.col("text"), F.lit(" ${n} %d :count"))
    p = tx.placeholders(text)
    return table(spark, root, "documents").select(
        "doc_id", F.array_join(p, "|").alias("placeholders"), F.size(p).cast("long").alias("n")
    )


@query("P11", f"""SELECT count(*) AS n, count(*) FILTER (u > 1) AS many, sum(u) AS arguments FROM (
  SELECT CAST(len(regexp_extract_all(replace(text, '%%', ''), {d.lit(fixed.PRINTF_UNNUMBERED)}, 0)) AS BIGINT) AS u
  FROM (SELECT text || ' %d%% ' || lang || CASE WHEN lang = 'en' THEN ' %s' ELSE ' %1$s' END AS text FROM documents) s) t""")
def unnumbered_arguments(spark, root):
    text = F.concat(F.col("text"), F.lit(" %d%% "), F.col("lang"), F.when(F.col("lang") == "en", F.lit(" %s")).otherwise(F.lit(" %1$s")))
    hits = F.size(tx.extract_all(F.replace(text, F.lit("%%"), F.lit("")), fixed.PRINTF_UNNUMBERED)).cast("long")
    return table(spark, root, "documents").select(tx.many_unnumbered_arguments(text).alias("many"), hits.alias("u")).agg(
        F.count("*").alias("n"), F.count_if("many").alias("many"), F.sum("u").alias("arguments")
    )


@query("P13", WITH + d.LINES + f"""
SELECT DISTINCT text, {d.sql_hash('text', 32)} AS cache_hash, {d.sql_hash('text', 16)} AS state_hash FROM lines""")
def truncated_hash(spark, root):
    t = F.col("text")
    return d.lines(spark, root).select("text").distinct().select(
        "text", tx.short_hash(t, fixed.CACHE_HASH_CHARS).alias("cache_hash"), tx.short_hash(t, fixed.STATE_HASH_CHARS).alias("state_hash")
    )


@query("P14,I5", f"""SELECT conv_id, turn, {d.sql_hash("concat_ws(chr(0), 'rules-1', 'en', role, array_to_string(list_sort([role, 'engine', 'A' || conv_id]), ','), CASE WHEN turn = 0 THEN 'true' ELSE 'false' END)", 32)} AS fingerprint
FROM conversations""")
def prompt_fingerprint(spark, root):
    glossary = F.array(F.col("role"), F.lit("engine"), F.concat(F.lit("A"), F.col("conv_id")))
    fp = tx.fingerprint(F.lit("rules-1"), F.lit("en"), F.col("role"), glossary, F.col("turn") == 0)
    return table(spark, root, "conversations").select("conv_id", "turn", fp.alias("fingerprint"))


@query("P15,P16", f"""SELECT doc_id, md5(CASE WHEN cell = '' THEN '—' WHEN length(cell) > 160 THEN substr(cell, 1, 160) || '…' ELSE cell END) AS cell_md5,
  CASE WHEN length(text) > 90 THEN substr(text, 1, 90) || '…' ELSE text END AS cli,
  CASE WHEN length(text) > 40 THEN substr(text, 1, 40) || '…' ELSE text END AS warning
FROM (SELECT doc_id, text, trim(replace(regexp_replace(text, '[\\r\\n]+', ' ', 'g'), '|', '\\|')) AS cell FROM documents) t""")
def report_cells(spark, root):
    t = F.col("text")
    return table(spark, root, "documents").select(
        "doc_id", F.md5(tx.report_cell(t)).alias("cell_md5"),
        tx.preview(t, fixed.PREVIEW_CLI).alias("cli"), tx.preview(t, fixed.PREVIEW_WARNING).alias("warning"),
    )


def _replace_sql(c: str, pairs) -> str:
    for old, new in pairs:
        spell = lambda s: " || ".join(f"chr({ord(x)})" for x in s) or "''"
        c = f"replace({c}, {spell(old)}, {spell(new)})"
    return c


_DOC_ESC = "(SELECT doc_id, '@' || lang || chr(9) || '\"' || text || '''' AS text FROM documents)"


@query("P9", f"""SELECT doc_id, md5(CASE WHEN regexp_matches(e, '^ | $| {{2}}') THEN '"' || e || '"' ELSE e END) AS escaped_md5,
  md5(replace(text, chr(13), '')) AS back_md5 FROM (
  SELECT doc_id, text, CASE WHEN regexp_matches(s, '^[@?]') THEN '\\' || s ELSE s END AS e FROM (
    SELECT doc_id, text, {_replace_sql('text', escapes.ANDROID_ESCAPES)} AS s FROM {_DOC_ESC} x) y) z""")
def escape_android(spark, root):
    text = F.concat(F.lit("@"), F.col("lang"), F.lit('\t"'), F.col("text"), F.lit("'"))
    e = table(spark, root, "documents").select("doc_id", escapes.escape_android(text).alias("e"))
    return e.select("doc_id", F.md5("e").alias("escaped_md5"), F.md5(escapes.unescape_android(F.col("e"))).alias("back_md5"))


@query("P10", f"""SELECT doc_id, md5({_replace_sql('text', escapes.APPLE_ESCAPES)}) AS escaped_md5,
  md5(text) AS back_md5 FROM {_DOC_ESC} x""")
def escape_apple(spark, root):
    text = F.concat(F.lit("@"), F.col("lang"), F.lit('\t"'), F.col("text"), F.lit("'"))
    e = table(spark, root, "documents").select("doc_id", escapes.escape_apple(text).alias("e"))
    return e.select("doc_id", F.md5("e").alias("escaped_md5"), F.md5(escapes.unescape_apple(F.col("e"))).alias("back_md5"))


# cultures derived from the documents: language, and a script or region chosen by where the text came from
_REGION = {"de": "at", "en": "gb", "es": "419", "fr": "ca"}
_CULTURE_SQL = (
    "(SELECT DISTINCT lang, source, CASE WHEN source IN ('src0', 'src1') THEN lang WHEN source IN ('src2', 'src3') THEN NULL "
    "WHEN source = 'src4' THEN upper(lang) || '_latn_' || r ELSE lang || '-' || r END AS culture FROM "
    "(SELECT lang, source, CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _REGION.items()) + " ELSE 'us' END AS r FROM documents) x)"
)
_TAG_SQL = (
    "array_to_string(list_transform(regexp_split_to_array(culture, '[-_]'), lambda p, i: CASE WHEN i = 1 THEN lower(p) "
    "WHEN length(p) = 4 THEN upper(substr(p, 1, 1)) || lower(substr(p, 2)) WHEN length(p) = 2 THEN upper(p) ELSE p END), '{0}')"
)


def _cultures(spark, root):
    region = F.create_map(*[F.lit(x) for kv in _REGION.items() for x in kv])
    r = F.coalesce(F.try_element_at(region, F.col("lang")), F.lit("us"))
    culture = (
        F.when(F.col("source").isin("src0", "src1"), F.col("lang"))
        .when(F.col("source").isin("src2", "src3"), F.lit(None).cast("string"))
        .when(F.col("source") == "src4", F.concat(F.upper("lang"), F.lit("_latn_"), r))
        .otherwise(F.concat(F.col("lang"), F.lit("-"), r))
    )
    return table(spark, root, "documents").select("lang", "source").distinct().withColumn("culture", culture)


@query("P6,P7,P17", f"""SELECT lang, source, culture, CASE WHEN culture IS NULL THEN 'values'
  WHEN regexp_matches(tag, '^[a-z]{{2}}(-[A-Z]{{2}})?$') THEN 'values-' || regexp_replace(tag, '-([A-Z]{{2}})$', '-r\\1')
  ELSE 'values-b+' || replace(tag, '-', '+') END AS android, {_TAG_SQL.format('_')} AS arb,
  regexp_matches(culture, '{locales.KNOWN_SHAPE}') AS known
FROM (SELECT lang, source, culture, {_TAG_SQL.format('-')} AS tag FROM {_CULTURE_SQL} c) t""")
def culture_qualifiers(spark, root):
    c = F.col("culture")
    return _cultures(spark, root).select(
        "lang", "source", "culture", locales.android_qualifier(c).alias("android"), locales.arb_locale(c).alias("arb"),
        locales.is_known_shape(c).alias("known"),
    )


@query("P8,T7,W6", f"""SELECT lang, source, fmt, CASE fmt
  WHEN 'resx' THEN 'L/App' || CASE WHEN culture IS NULL THEN '' ELSE '.' || tag END || '.resx'
  WHEN 'i18next' THEN 'L/' || coalesce(tag, 'en') || '/App.json'
  WHEN 'android' THEN 'L/' || CASE WHEN culture IS NULL THEN 'values' WHEN regexp_matches(tag, '^[a-z]{{2}}(-[A-Z]{{2}})?$')
       THEN 'values-' || regexp_replace(tag, '-([A-Z]{{2}})$', '-r\\1') ELSE 'values-b+' || replace(tag, '-', '+') END || '/App.xml'
  WHEN 'strings' THEN 'L/' || coalesce(tag, 'Base') || '.lproj/App.strings'
  WHEN 'arb' THEN 'L/App_' || coalesce(replace(tag, '-', '_'), 'en') || '.arb' END AS path
FROM (SELECT lang, source, culture, {_TAG_SQL.format('-')} AS tag, unnest(['resx', 'i18next', 'android', 'strings', 'arb', 'po']) AS fmt
      FROM {_CULTURE_SQL} c) t""")
def bundle_paths(spark, root):
    fmts = F.array(*[F.lit(f) for f in ["resx", "i18next", "android", "strings", "arb", "po"]])
    df = _cultures(spark, root).withColumn("fmt", F.explode(fmts))
    return df.select("lang", "source", "fmt", locales.bundle_path(F.col("fmt"), F.lit("L"), F.lit("App"), F.col("culture")).alias("path"))


# --- keys ---------------------------------------------------------------------------------------

@query("P2,P3", WITH + d.KEPT + f"""
SELECT text, {d.sql_base_key('text')} AS key FROM (SELECT DISTINCT text FROM kept) k""")
def key_from_text(spark, root):
    return d.kept(spark, root).select("text").distinct().select("text", keys.base_key(F.col("text")).alias("key"))


_SAN = f"list_filter(regexp_split_to_array(t, {d.lit(fixed.NOT_KEY_CHAR + '+')}), lambda w: w <> '')"


@query("P1", f"""SELECT p_partkey, {d.sql_prefix_digit('(' + d.sql_pascal(_SAN) + ')')} AS key
FROM (SELECT p_partkey, p_size || '-' || p_name || '.' || p_type || ' ' || p_brand AS t FROM part) p
UNION ALL SELECT c_custkey, {d.sql_prefix_digit('(' + d.sql_pascal(_SAN) + ')')} FROM (SELECT c_custkey, c_mktsegment || '::' || c_name AS t FROM customer) c""")
def sanitize_key(spark, root):
    part = table(spark, root, "part").select(
        "p_partkey", F.concat(F.col("p_size"), F.lit("-"), F.col("p_name"), F.lit("."), F.col("p_type"), F.lit(" "), F.col("p_brand")).alias("t"))
    customer = table(spark, root, "customer").select(F.col("c_custkey").alias("p_partkey"), F.concat("c_mktsegment", F.lit("::"), "c_name").alias("t"))
    return part.unionByName(customer).select("p_partkey", keys.sanitize_key(F.col("t")).alias("key"))


def _snake_sql(k: str) -> str:
    s = f"regexp_replace({k}, '([\\p{{Ll}}\\p{{N}}])(\\p{{Lu}})', '\\1_\\2', 'g')"
    s = f"regexp_replace({s}, '(\\p{{Lu}})(\\p{{Lu}}\\p{{Ll}})', '\\1_\\2', 'g')"
    s = f"regexp_replace(lower({s}), '[^\\p{{L}}\\p{{N}}_]+', '_', 'g')"
    s = f"regexp_replace(regexp_replace({s}, '_+', '_', 'g'), '^_|_$', '', 'g')"
    s = f"CASE WHEN {s} = '' THEN 'text' ELSE {s} END"
    s = f"CASE WHEN regexp_matches({s}, '^\\p{{N}}') THEN 'k_' || ({s}) ELSE {s} END"
    return f"(SELECT CASE WHEN v IN {d.sql_list(fixed.KOTLIN_JAVA_KEYWORDS)} THEN v || '_text' ELSE v END FROM (SELECT {s} AS v) q)"


@query("P4,K2", WITH + d.KEPT + f""",
k AS (SELECT DISTINCT {d.sql_base_key('text')} AS key FROM (SELECT DISTINCT text FROM kept) x),
s AS (SELECT key, {_snake_sql('key')} AS snake FROM k)
SELECT key, snake, {_snake_sql('snake')} = snake AS idempotent FROM s""")
def snake_keys(spark, root):
    k = key_from_text(spark, root).select("key").distinct().withColumn("snake", keys.lower_snake(F.col("key")))
    return k.withColumn("idempotent", keys.lower_snake(F.col("snake")) == F.col("snake"))


def _camel_sql(k: str) -> str:
    run = f"length(regexp_extract({k}, '^(\\p{{Lu}}+)(?:[^\\p{{Lu}}]|$)', 1))"
    keep = f"CASE WHEN {run} > 1 AND {run} < length({k}) AND regexp_matches(substr({k}, {run} + 1, 1), '\\p{{L}}') THEN {run} - 1 ELSE {run} END"
    return f"lower(substr({k}, 1, {keep})) || substr({k}, ({keep}) + 1)"


@query("P5,K2", WITH + d.KEPT + f""",
k AS (SELECT DISTINCT {d.sql_base_key('text')} AS key FROM (SELECT DISTINCT text FROM kept) x),
s AS (SELECT key, {_camel_sql('key')} AS camel FROM k)
SELECT key, camel, ({_camel_sql('camel')}) = camel AS idempotent FROM s""")
def camel_keys(spark, root):
    k = key_from_text(spark, root).select("key").distinct().withColumn("camel", keys.lower_camel(F.col("key")))
    return k.withColumn("idempotent", keys.lower_camel(F.col("camel")) == F.col("camel"))


@query("P18", WITH + d.KEPT + f"""
SELECT regexp_matches(text, '^[\\p{{L}}_][\\p{{L}}\\p{{N}}_]*$') AND text NOT IN {d.sql_list(fixed.RESERVED_MEMBERS)} AS legal, count(*) AS n
FROM (SELECT text FROM kept UNION ALL SELECT r_name FROM region UNION ALL SELECT p_type FROM part) t GROUP BY 1""")
def legal_members(spark, root):
    texts = d.kept(spark, root).select("text").unionByName(table(spark, root, "region").select(F.col("r_name").alias("text")))
    texts = texts.unionByName(table(spark, root, "part").select(F.col("p_type").alias("text")))
    return texts.groupBy(keys.legal_member(F.col("text")).alias("legal")).agg(F.count("*").alias("n"))
