"""Inputs that Spark derives from the given tables, each with its SQL twin.

The tables hold no source code and no bundles, so lines of ``documents`` stand for string candidates, distinct
lines for a source bundle, and ``labels`` decides which target values and states exist.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import fixed
from ..functions.keys import base_key
from ..functions.noise import is_noise_trimmed
from ..functions.text import short_hash, trim_ws
from ..session import evaluate_once, materialise, spread, table

LANGUAGES = ["de", "es", "fr"]


def lit(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def sql_list(items: list[str]) -> str:
    return "(" + ", ".join(lit(i) for i in items) + ")"


def sql_trim(c: str) -> str:
    return f"trim({c}, ' ' || chr(9) || chr(13) || chr(10) || chr(12))"


def sql_match(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {lit(pattern)})"


def sql_noise_rules(c: str) -> dict[str, str]:
    t = sql_trim(c)
    m = lambda p: sql_match(t, p)
    spaceless = f"NOT contains({t}, ' ')"
    return {
        "n01_short": f"length({t}) < 2",
        "n02_no_letter": f"NOT {m(fixed.LETTER)}",
        "n03_no_word": f"NOT {m(fixed.ASCII_WORD)}",
        "n04_uri": m(fixed.URI_SCHEME),
        "n05_path": m(fixed.PATH_LIKE),
        "n06_guid": m(fixed.GUID),
        "n07_colour": m(fixed.HEX_COLOUR),
        "n08_media_type": m(fixed.MEDIA_TYPE),
        "n09_sql": f"({m(fixed.SQL_VERB)} AND {m(fixed.SQL_CLAUSE)})",
        "n10_date": m(fixed.DATE_PATTERN),
        "n11_screaming": m(fixed.SCREAMING),
        "n12_identifier": f"({spaceless} AND {m(fixed.IDENTIFIER)})",
        "n13_short_lower": f"({spaceless} AND {m(fixed.SHORT_LOWER)})",
    }


def sql_noise(c: str) -> str:
    return "(" + " OR ".join(f"({r})" for r in sql_noise_rules(c).values()) + ")"


def sql_hash(c: str, n: int) -> str:
    return f"upper(substr(sha256({c}), 1, {n}))"


def sql_pascal(words: str) -> str:
    # the sharp s has no one-character capital in invariant casing
    up = "CASE WHEN substr(w, 1, 1) = 'ß' THEN 'ß' ELSE upper(substr(w, 1, 1)) END"
    return f"array_to_string(list_transform({words}, lambda w: {up} || substr(w, 2)), '')"


def sql_prefix_digit(k: str) -> str:
    return f"CASE WHEN regexp_matches({k}, '^\\p{{N}}') THEN {lit(fixed.DIGIT_PREFIX)} || {k} ELSE {k} END"


def sql_key_words(c: str) -> str:
    split = f"regexp_split_to_array({c}, {lit(fixed.WORD_SEPARATOR)})"
    kept = f"list_filter({split}, lambda v: regexp_matches(v, {lit(fixed.KEY_CHAR)}))[1:{fixed.KEY_WORDS}]"
    return f"list_filter(flatten(list_transform({kept}, lambda v: regexp_split_to_array(lower(v), {lit(fixed.NOT_KEY_CHAR + '+')}))), lambda p: p <> '')"


def sql_base_key(c: str) -> str:
    k = sql_pascal(sql_key_words(c))
    k = f"coalesce(nullif({sql_prefix_digit('(' + k + ')')}, ''), {lit(fixed.DEFAULT_KEY)})"
    return f"CASE WHEN {k} IN {sql_list(fixed.RESERVED_MEMBERS)} THEN {k} || 'Text' ELSE {k} END"


# --- lines: every line of every document ----------------------------------------------------


def lines_of(docs: DataFrame, keep: list[str]) -> DataFrame:
    return docs.select(*keep, F.posexplode(F.split("text", "\n"))).select(*keep, (F.col("pos") + 1).cast("long").alias("line"), F.col("col").alias("text"))


def lines(spark: SparkSession, root: str) -> DataFrame:
    docs = spread(table(spark, root, "documents").select("doc_id", "lang", "source", "text"))
    return lines_of(docs, ["doc_id", "lang", "source"])


LINES = """lines AS (
  SELECT doc_id, lang, source, CAST(generate_subscripts(parts, 1) AS BIGINT) AS line, unnest(parts) AS text
  FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS parts FROM documents) d)"""


# --- kept: candidate lines (trimmed, noise dropped) -----------------------------------------


def keep_copy(df: DataFrame) -> DataFrame:
    keep = [c for c in df.columns if c != "text"]
    return evaluate_once(df, keep, text=trim_ws(F.col("text"))).filter(~is_noise_trimmed(F.col("text")))


def kept(spark: SparkSession, root: str) -> DataFrame:
    return keep_copy(lines(spark, root))


KEPT = LINES + f""",
kept AS (
  SELECT * FROM (SELECT doc_id, lang, source, line, {sql_trim('text')} AS text FROM lines) t
  WHERE NOT {sql_noise('text')})"""


# --- units: one row per distinct text, with what the labels say about its documents ----------


def units(spark: SparkSession, root: str) -> DataFrame:
    """Partial aggregation first, so a text repeated in a third of all rows shuffles once per task.

    Target, state and approvals all start here: the table is written once instead of scanning the documents per use.
    """
    labels = table(spark, root, "labels").select("doc_id", "quality", "toxic")
    # joined before the lines are split off: one row per document on both sides, no key is hot
    docs = spread(table(spark, root, "documents").select("doc_id", "lang", "text")).join(labels, "doc_id", "left")
    marked = keep_copy(lines_of(docs, ["doc_id", "lang", "quality", "toxic"]))
    per_text = marked.groupBy("text").agg(
        F.min("doc_id").alias("first_doc"),
        F.count("*").alias("occurrences"),
        F.max("quality").alias("quality"),
        F.max("toxic").alias("toxic"),
        F.min("lang").alias("src_lang"),
    )
    return materialise(per_text.withColumn("key", F.concat(F.lit("T"), short_hash(F.col("text"), 32))), "units", packed=True)


UNITS = KEPT + f""",
units AS (
  SELECT *, 'T' || {sql_hash('text', 32)} AS key FROM (
    SELECT text, min(k.doc_id) AS first_doc, count(*) AS occurrences, max(quality) AS quality, max(toxic) AS toxic,
           min(lang) AS src_lang
    FROM kept k LEFT JOIN labels l ON k.doc_id = l.doc_id GROUP BY text) u)"""


# --- target bundles and recorded state per language ------------------------------------------


def per_language(df: DataFrame) -> DataFrame:
    """Languages times rows as a generator: the list is a run option, no join is needed."""
    return df.withColumn("lang", F.explode(F.array(*[F.lit(x) for x in LANGUAGES])))


def target(u: DataFrame) -> DataFrame:
    """Labelled texts have a target entry: empty for quality 0, edited by hand for toxic 1."""
    value = (
        F.when(F.col("quality") == 0, F.lit(""))
        .when(F.col("toxic") == 1, F.concat(F.lit("<"), F.col("lang"), F.lit("> "), F.col("text")))
        .otherwise(F.concat(F.lit("["), F.col("lang"), F.lit("] "), F.col("text")))
    )
    df = per_language(u.filter(F.col("quality").isNotNull()))
    return df.filter(F.col("lang") != F.col("src_lang")).select("lang", "key", value.alias("value"))


def state(u: DataFrame) -> DataFrame:
    """What the tool wrote last: texts seen more than once have since changed in the source."""
    df = per_language(u.filter(F.col("quality") == 1))
    source = F.when(F.col("occurrences") > 1, F.concat(F.col("text"), F.lit(" (old)"))).otherwise(F.col("text"))
    written = F.concat(F.lit("["), F.col("lang"), F.lit("] "), F.col("text"))
    return df.select(
        "lang", "key",
        short_hash(source, fixed.STATE_HASH_CHARS).alias("source_hash"),
        short_hash(written, fixed.STATE_HASH_CHARS).alias("translation_hash"),
    )


def approved(u: DataFrame) -> DataFrame:
    """Approved wordings: texts from documents labelled good and harmless."""
    df = per_language(u.filter((F.col("quality") == 1) & (F.col("toxic") == 0)))
    return df.filter(F.col("lang") == F.col("src_lang")).select(
        "lang", F.col("text").alias("source_text"), F.col("text").alias("wording"), F.col("first_doc").alias("ord")
    )


TARGET = UNITS + """,
unit_lang AS (SELECT u.*, unnest(['de', 'es', 'fr']) AS lang FROM units u),
target AS (
  SELECT lang, key, CASE WHEN quality = 0 THEN '' WHEN toxic = 1 THEN '<' || lang || '> ' || text
                         ELSE '[' || lang || '] ' || text END AS value
  FROM unit_lang WHERE quality IS NOT NULL AND lang <> src_lang)"""
STATE = TARGET + f""",
state AS (
  SELECT lang, key,
         {sql_hash("CASE WHEN occurrences > 1 THEN text || ' (old)' ELSE text END", fixed.STATE_HASH_CHARS)} AS source_hash,
         {sql_hash("'[' || lang || '] ' || text", fixed.STATE_HASH_CHARS)} AS translation_hash
  FROM unit_lang WHERE quality = 1),
approved AS (
  SELECT lang, text AS source_text, text AS wording, first_doc AS ord
  FROM unit_lang WHERE quality = 1 AND toxic = 0 AND lang = src_lang)"""


# --- string columns of every table ------------------------------------------------------------

STRING_COLUMNS = [
    ("pages", "url"), ("events", "event_type"), ("events", "props"), ("orders", "o_orderstatus"),
    ("orders", "o_orderpriority"), ("customer", "c_name"), ("customer", "c_mktsegment"), ("supplier", "s_name"),
    ("part", "p_name"), ("part", "p_brand"), ("part", "p_type"), ("nation", "n_name"), ("region", "r_name"),
    ("lineitem", "l_returnflag"), ("lineitem", "l_linestatus"), ("documents", "lang"), ("documents", "source"),
    ("conversations", "role"), ("benchmark", "text"),
]


def corpus(spark: SparkSession, root: str) -> DataFrame:
    """(origin, text): every string column plus the document lines; each table is scanned once."""
    out = lines(spark, root).select(F.lit("documents.line").alias("origin"), "text")
    for name in dict.fromkeys(t for t, _ in STRING_COLUMNS):
        columns = [c for t, c in STRING_COLUMNS if t == name]
        cells = F.array(*[F.struct(F.lit(f"{name}.{c}").alias("origin"), F.col(c).alias("text")) for c in columns])
        out = out.unionByName(spread(table(spark, root, name).select(*columns)).select(F.inline(cells)))
    return out


CORPUS = LINES + ",\ncorpus AS (\n  SELECT 'documents.line' AS origin, text FROM lines\n" + "\n".join(
    f"  UNION ALL SELECT '{t}.{c}', {c} FROM {t}" for t, c in STRING_COLUMNS
) + ")"


# --- source trees: every document is a file of the project named by its source and language --------

TREE_NAMES = [
    "App.csproj", "src/Program.cs", "package.json", "src/App.vue", "app/src/main/AndroidManifest.xml", "app/build.gradle",
    "ios/Runner.xcodeproj/project.pbxproj", "Package.swift", "Sources/Main.swift", "pubspec.yaml", "lib/main.dart",
    "src/main.js", "node_modules/x/index.js", "obj/Form.designer.cs", "web/index.html", "app/src/main/res/layout/main.xml",
    "app/src/main/res/values/strings.xml", "l10n.yaml", "ios/Info.plist", "src/App.spec.ts", "web/package.json",
    "Views/Home.xaml", "core/build.gradle", "core/src/main/java/a/b/View.kt",
]
# content of the files whose content is looked at, by language; all others hold the document text
TREE_CONTENT = [
    ("package.json", "en", '{"name":"a","dependencies":{"react":"^18.0.0","i18next":"^23.0.0"}}'),
    ("package.json", "fr", '{"name":"a","dependencies":{"vue":"^3.0.0"},"devDependencies":{"vite":"1"}}'),
    ("package.json", "de", '{"name":"a","dependencies":{"left-pad":"1"}}'),
    ("package.json", "es", '{"name":"a"}'),
    ("pubspec.yaml", "en", "name: a\ndependencies:\n  flutter:\n    sdk: flutter\n  intl: any\nflutter:\n  generate: true\n"),
    ("pubspec.yaml", "fr", "name: a\ndependencies:\n  flutter:\n    sdk: flutter\n"),
    ("pubspec.yaml", "de", "name: a\n"),
    ("app/build.gradle", "en", 'plugins { id "com.android.application" }\nandroid { defaultConfig { resConfigs "en", "de", "es", "fr" } }\n'),
    ("app/build.gradle", "fr", 'plugins { id "com.android.application" }\nandroid { defaultConfig { resConfigs "en", "fr" } }\n'),
    ("app/build.gradle", "de", "plugins { id 'java' }\n"),
    ("App.csproj", "en", "<Project><PropertyGroup><RootNamespace>Acme.Shop</RootNamespace><NeutralLanguage>en</NeutralLanguage></PropertyGroup></Project>"),
    ("App.csproj", "fr", "<Project><PropertyGroup><RootNamespace>Acme</RootNamespace></PropertyGroup></Project>"),
    ("Package.swift", "en", 'let package = Package(name: "a", defaultLocalization: "en")'),
    ("ios/Info.plist", "en", "<plist><dict><key>CFBundleLocalizations</key></dict></plist>"),
    ("ios/Runner.xcodeproj/project.pbxproj", "fr", "files = ( Localizable.strings )"),
    ("src/main.js", "en", 'import "./i18n";\n'),
    ("src/Program.cs", "fr", 'CultureInfo.CurrentUICulture = new CultureInfo("fr");\n'),
    ("app/src/main/res/layout/main.xml", "en", '<LinearLayout xmlns:android="http://schemas.android.com/apk/res/android"/>'),
    ("app/src/main/res/values/strings.xml", "en", '<resources xmlns:android="http://schemas.android.com/apk/res/android"/>'),
]


def tree(spark: SparkSession, root: str) -> DataFrame:
    """(project, path, content, doc_id); the place in the name list follows from the document number."""
    docs = spread(table(spark, root, "documents").select("doc_id", "lang", "source", "text"))
    names = F.array(*[F.lit(n) for n in TREE_NAMES])
    path = F.element_at(names, (F.pmod("doc_id", F.lit(len(TREE_NAMES))) + 1).cast("int"))
    content = F.col("text")
    for name, lang, body in TREE_CONTENT:
        content = F.when((F.col("path") == name) & (F.col("lang") == lang), F.lit(body)).otherwise(content)
    project = F.concat_ws("-", "source", "lang")
    return docs.withColumn("path", path).select(project.alias("project"), "path", content.alias("content"), "doc_id", "lang")


_TREE_CASE = " ".join(f"WHEN path = {lit(n)} AND lang = {lit(g)} THEN {lit(b)}" for n, g, b in TREE_CONTENT)
TREE = f"""tree AS (
  SELECT source || '-' || lang AS project, path, CASE {_TREE_CASE} ELSE text END AS content, doc_id, lang
  FROM (SELECT *, list_extract([{', '.join(lit(n) for n in TREE_NAMES)}], CAST(doc_id % {len(TREE_NAMES)} + 1 AS BIGINT)) AS path FROM documents) t)"""
