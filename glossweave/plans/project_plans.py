"""Files, detection, set-up, edits, rewriting, spans and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions import paths
from ..functions.text import short_hash
from ..operators import code, detect, incremental as inc, islands, markup, rewrite, setup
from ..session import spread, table
from . import derive as d
from .markup_plans import ENTITY_SQL, TOK, dead
from .registry import query

W = "WITH "


def _any_sql(template: str, items) -> str:
    return "(" + " OR ".join(template.format(d.lit(i)) for i in items) + ")"


# --- paths ---------------------------------------------------------------------------------------

_SKIP = d.sql_list(fixed.SKIP_SEGMENTS)
_FILES = d.TREE + """,
paths AS (SELECT project, path FROM tree UNION ALL
  SELECT 'pages', regexp_replace(url, '^[a-z]+://', '') FROM pages)"""


def _paths(spark, root):
    urls = table(spark, root, "pages").select(F.lit("pages").alias("project"), F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    return d.tree(spark, root).select("project", "path").unionByName(urls)


@query("S4,P19", W + _FILES + f"""
SELECT coalesce(reason, 'scanned') AS excluded_by, count(*) AS n FROM (
  SELECT CASE WHEN len(list_filter(string_split(lower(path), '/')[1:len(string_split(path, '/')) - 1], lambda s: s IN {_SKIP})) > 0 THEN 'skip_segment'
    WHEN {_any_sql("ends_with(lower(path), {0})", fixed.GENERATED_SUFFIXES)} THEN 'generated_name'
    WHEN starts_with(lower(path), 'app/src/main/res/') THEN 'resource_dir' WHEN contains(lower(path), 'ref=x') THEN 'user_fragment' END AS reason
  FROM paths) x GROUP BY 1""")
def path_exclusions(spark, root):
    by = paths.excluded_by(F.col("path"), "app/src/main/res", ("ref=x",))
    return _paths(spark, root).groupBy(F.coalesce(by, F.lit("scanned")).alias("excluded_by")).agg(F.count("*").alias("n"))


@query("S3,P19", W + _FILES + """
SELECT lower(regexp_extract(path, '(\\.[^./\\\\]+)$', 1)) AS extension, length(path) - length(replace(path, '/', '')) AS depth, count(*) AS n
FROM paths GROUP BY 1, 2""")
def extensions(spark, root):
    p = F.col("path")
    return _paths(spark, root).groupBy(paths.extension(p).alias("extension"), paths.depth(p).cast("long").alias("depth")).agg(F.count("*").alias("n"))


@query("X31", W + _FILES + f"""
SELECT {_any_sql("contains('/' || lower(path), {0})", fixed.TEST_FRAGMENTS)} AS is_test, count(*) AS n FROM paths GROUP BY 1""")
def test_files(spark, root):
    return _paths(spark, root).groupBy(paths.is_test_file(F.col("path")).alias("is_test")).agg(F.count("*").alias("n"))


@query("S5", f"""SELECT doc_id, {_any_sql("contains(upper(substr(t, 1, 2000)), upper({0}))", fixed.GENERATED_BANNERS)} AS generated
FROM (SELECT doc_id, CASE lang WHEN 'fr' THEN '// <Auto-Generated/>' || chr(10) || text WHEN 'de' THEN text || repeat(' ', 2000) || '@generated' ELSE text END AS t FROM documents) x""")
def generated_filter(spark, root):
    t = (
        F.when(F.col("lang") == "fr", F.concat(F.lit("// <Auto-Generated/>\n"), "text"))
        .when(F.col("lang") == "de", F.concat("text", F.repeat(F.lit(" "), F.lit(2000)), F.lit("@generated"))).otherwise(F.col("text"))
    )
    return table(spark, root, "documents").select("doc_id", paths.is_generated_content(t).alias("generated"))


@query("S6,D17", """SELECT doc_id, lang <> 'de' AS valid, lang = 'en' AS bom, CASE WHEN lang <> 'de' THEN md5(text) END AS text_md5 FROM documents""")
def utf8_bom_flags(spark, root):
    from ..sources.files import decode

    raw = F.col("text").cast("binary")
    content = F.when(F.col("lang") == "en", F.concat(F.unhex(F.lit("EFBBBF")), raw)).when(F.col("lang") == "de", F.concat(raw, F.unhex(F.lit("C3")))).otherwise(raw)
    files = decode(table(spark, root, "documents").select("doc_id", content.alias("content")))
    return files.select("doc_id", F.col("is_valid_utf8").alias("valid"), F.col("has_bom").alias("bom"), F.md5("text").alias("text_md5"))


@query("S8,O1", W + d.TREE + """
SELECT project, path, doc_id FROM tree WHERE NOT contains(path, 'node_modules/') AND NOT starts_with(path, 'obj/')
ORDER BY upper(project), upper(path), path, doc_id LIMIT 50""")
def file_limit(spark, root):
    """First N scanned files in scan order; the limit is the option itself and skipped files do not count."""
    kept = d.tree(spark, root).filter(paths.excluded_by(F.col("path")).isNull())
    order = [F.upper("project"), F.upper("path"), "path", "doc_id"]
    return kept.filter(~F.contains("path", F.lit("node_modules/"))).orderBy(*order).limit(50).select("project", "path", "doc_id")


_MANIFESTS = ["package.json", "build.gradle", "pubspec.yaml", "App.csproj"]


@query("S9,O4,D15", W + d.TREE + f""",
h AS (SELECT DISTINCT project, path, regexp_extract(path, '([^/\\\\]+)$', 1) AS name, length(path) - length(replace(path, '/', '')) AS depth FROM tree),
t AS (SELECT *, row_number() OVER (PARTITION BY project, name ORDER BY depth, path) AS rank FROM h WHERE name IN {d.sql_list(_MANIFESTS)})
SELECT project, name, path, rank FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY depth, name, path) AS p FROM t WHERE rank <= 4) x WHERE p <= 24""")
def manifest_top4(spark, root):
    return detect.top_manifests(d.tree(spark, root), _MANIFESTS).select("project", "name", "path", F.col("rank").cast("long"))


# --- detection --------------------------------------------------------------------------------------


def _score_sql(stack: str) -> str:
    out = ""
    for name, p, c, score in detect.SCORES:
        if name == stack:
            out += f" WHEN {d.sql_match('path', p)}" + (f" AND {d.sql_match('content', c)}" if c else "") + f" THEN {score}"
    return f"coalesce(max(CASE{out} END), 0)"


_SCORED = d.TREE + """,
scored AS (""" + " UNION ALL ".join(f"SELECT project, '{s}' AS stack, {_score_sql(s)} AS score, {i} AS rank FROM tree GROUP BY project" for i, s in enumerate(fixed.STACK_ORDER)) + ")"


@query("T2,T3,T4,T5,T6", W + _SCORED + " SELECT project, stack, CAST(score AS BIGINT) AS score FROM scored")
def stack_scores(spark, root):
    return detect.stack_scores(d.tree(spark, root)).select("project", "stack", F.col("score").cast("long"))


@query("T1", W + _SCORED + """
SELECT project, CASE WHEN score > 0 THEN stack END AS stack, CAST(score AS BIGINT) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY project ORDER BY score DESC, rank) AS r FROM scored) x WHERE r = 1""")
def detect_stack(spark, root):
    return detect.resolve(d.tree(spark, root)).select("project", "stack", F.col("score").cast("long"))


@query("T7", W + d.TREE + """
SELECT project, dir FROM (SELECT project, dir, row_number() OVER (PARTITION BY project ORDER BY length(dir) - length(replace(dir, '/', '')), dir) AS r
  FROM (SELECT DISTINCT project, regexp_extract(path, '^(.*main/res)/', 1) AS dir FROM tree) x WHERE dir <> '') y WHERE r = 1""")
def resource_directory(spark, root):
    return detect.shallowest(d.tree(spark, root), "^(.*main/res)/")


@query("J14", W + d.TREE + """,
m AS (SELECT DISTINCT project, regexp_replace(path, '/?[^/]*$', '') AS dir FROM tree WHERE path LIKE '%build.gradle' OR path LIKE '%package.json'),
f AS (SELECT DISTINCT project, path FROM tree)
SELECT f.project, f.path, (SELECT arg_max(m.dir, length(m.dir)) FROM m WHERE m.project = f.project AND (m.dir = '' OR starts_with(f.path, m.dir || '/'))) AS module FROM f""")
def nearest_module(spark, root):
    files = d.tree(spark, root).select("project", "path").distinct()
    modules = files.filter(F.col("path").rlike("(build\\.gradle|package\\.json)$")).select("project", paths.directory(F.col("path")).alias("dir"))
    return detect.nearest_module(files, modules)


@query("X22", W + d.TREE + """
SELECT project, path, doc_id, NOT regexp_matches(lower(path), '(^|/)values[^/]*/') AND NOT regexp_matches(lower(path), '(^|/)androidmanifest\\.xml$')
  AND (regexp_matches(lower(path), '(^|/)res/(layout|menu|xml|navigation)[^/]*/') OR (contains(content, 'http://schemas.android.com/apk/res/android')
       AND regexp_extract(content, '<([A-Za-z][A-Za-z0-9_.:-]*)', 1) NOT IN ('manifest', 'resources'))) AS copy_bearing
FROM tree WHERE path LIKE '%.xml'""")
def copy_bearing_xml(spark, root):
    t = d.tree(spark, root).filter(F.endswith("path", F.lit(".xml")))
    return t.select("project", "path", "doc_id", markup.copy_bearing_xml(F.col("path"), F.col("content")).alias("copy_bearing"))


@query("P20", W + d.TREE + """
SELECT project, coalesce(nullif(max(regexp_extract(content, '<RootNamespace>([^<]+)</RootNamespace>', 1)) FILTER (path LIKE '%.csproj'), ''),
  regexp_replace(project, '[^A-Za-z0-9_.]', '_', 'g')) AS namespace FROM tree GROUP BY project""")
def namespaces(spark, root):
    ns = F.max(F.when(F.endswith("path", F.lit(".csproj")), F.regexp_extract("content", "<RootNamespace>([^<]+)</RootNamespace>", 1)))
    return d.tree(spark, root).groupBy("project").agg(ns.alias("ns")).select(
        "project", F.coalesce(F.nullif("ns", F.lit("")), F.regexp_replace("project", "[^A-Za-z0-9_.]", "_")).alias("namespace"))


# --- set-up -----------------------------------------------------------------------------------------

_FINDINGS = d.TREE + ",\nfindings AS (" + " UNION ALL ".join(
    f"SELECT project, '{s}' AS stack, '{step}' AS step, '{sev}' AS severity, {str(auto).lower()} AS automatic, "
    + {"file": f"CASE WHEN bool_or({d.sql_match('path', p)}) THEN ", "content": f"CASE WHEN bool_or({d.sql_match('path', p)} AND {d.sql_match('content', c)}) THEN "}.get(setup.WHERE_PRESENT.get(step), "")
    + f"bool_or({d.sql_match('path', p)} AND {d.sql_match('content', c)}) " + ("END " if step in setup.WHERE_PRESENT else "") + "AS satisfied FROM tree GROUP BY project"
    for s, step, sev, auto, p, c in setup.CHECKS
) + ")"


@query("Z2,Z3,Z4,Z5,Z6,D16", W + _FINDINGS + " SELECT project, stack, step, severity, automatic, satisfied FROM findings")
def setup_findings(spark, root):
    return setup.findings(d.tree(spark, root))


@query("A11,I7", W + _FINDINGS + """
SELECT project, stack, bool_and(done) AS ready, bool_or(severity = 'blocking' AND NOT done) AS blocked,
  bool_and(NOT (severity = 'blocking' AND NOT done) OR automatic) AS blocking_is_automatic, count(*) FILTER (NOT done) AS open_steps
FROM (SELECT *, coalesce(satisfied, true) AS done FROM findings) f GROUP BY project, stack""")
def setup_gate(spark, root):
    return setup.gate(setup.findings(d.tree(spark, root)), ["project", "stack"])


@query("Z4,U4", W + d.TREE + """,
shipped AS (SELECT DISTINCT project, unnest(regexp_extract_all(regexp_extract(content, '(?:resConfigs|resourceConfigurations|localeFilters)([^}\\n]*)', 1), '["'']([A-Za-z-]+)["'']', 1)) AS lang
            FROM tree WHERE path LIKE '%.gradle'),
wanted AS (SELECT DISTINCT project, unnest(['de', 'es', 'fr']) AS lang FROM shipped)
SELECT w.project, w.lang FROM wanted w ANTI JOIN shipped s ON w.project = s.project AND w.lang = lower(split_part(s.lang, '-', 1))""")
def stripped_languages(spark, root):
    """Languages that a project's locale filter would drop from the build."""
    gradle = d.tree(spark, root).filter(F.endswith("path", F.lit(".gradle")))
    shipped = gradle.select("project", F.explode(setup.language_of(setup.locale_filter_languages(F.col("content")))).alias("lang")).distinct()
    wanted = d.per_language(shipped.select("project").distinct())
    return wanted.join(shipped, ["project", "lang"], "left_anti")


_EDIT_FILE = "CASE WHEN turn = 3 THEN '../d' || conv_id WHEN turn = 4 THEN '/d' || conv_id WHEN turn = 5 THEN '.\\D' || conv_id || '.TXT' WHEN turn > 8 THEN 'missing' ELSE 'd' || conv_id || '.txt' END"


def _edits(spark, root):
    n = F.col("conv_id")
    file = (
        F.when(F.col("turn") == 3, F.concat(F.lit("../d"), n)).when(F.col("turn") == 4, F.concat(F.lit("/d"), n))
        .when(F.col("turn") == 5, F.concat(F.lit(".\\D"), n, F.lit(".TXT"))).when(F.col("turn") > 8, F.lit("missing")).otherwise(F.concat(F.lit("d"), n, F.lit(".txt")))
    )
    kind = F.when(F.col("role") == "user", "replace").when(F.col("role") == "assistant", "append").otherwise("create")
    return table(spark, root, "conversations").select(
        F.col("conv_id").alias("step"), F.col("turn").alias("ord"), file.alias("file"), kind.alias("kind"),
        F.regexp_extract("text", r"^([^ \n]+)", 1).alias("anchor"), F.col("text").alias("content"))


_VALID = f"""files AS (SELECT 'd' || doc_id || '.txt' AS path, text AS content FROM documents),
edits AS (SELECT conv_id AS step, turn AS ord, regexp_replace(replace({_EDIT_FILE}, chr(92), '/'), '^\\./', '') AS file,
  CASE role WHEN 'user' THEN 'replace' WHEN 'assistant' THEN 'append' ELSE 'create' END AS kind,
  regexp_extract(text, '^([^ \\n]+)', 1) AS anchor FROM conversations),
counted AS (SELECT e.*, f.content IS NOT NULL AS present, CASE WHEN length(anchor) > 0 THEN (length(content) - length(replace(content, anchor, ''))) // length(anchor) ELSE 0 END AS hits
  FROM edits e LEFT JOIN files f ON lower(e.file) = lower(f.path)),
valid AS (SELECT *, CASE WHEN regexp_matches(file, '^/|^[A-Za-z]:|(^|/)\\.\\.(/|$)') THEN 'outside project'
  WHEN kind = 'create' AND present THEN 'already exists' WHEN kind = 'create' THEN NULL WHEN NOT present THEN 'not offered'
  WHEN kind = 'append' THEN NULL WHEN hits = 0 THEN 'anchor not found' WHEN hits > 1 THEN 'anchor ambiguous' END AS refusal FROM counted)"""


def _edit_files(spark, root):
    return table(spark, root, "documents").select(F.concat(F.lit("d"), "doc_id", F.lit(".txt")).alias("path"), F.col("text").alias("content"))


@query("Z1,J12,D14", W + _VALID + " SELECT step, ord, file, kind, refusal FROM valid")
def edit_validation(spark, root):
    return setup.validate(_edits(spark, root), _edit_files(spark, root)).select("step", "ord", "file", "kind", "refusal")


@query("Z1,A11", W + _VALID + """
SELECT step, count(*) AS edits, count(refusal) AS refused, bool_and(refusal IS NULL) AS accepted FROM valid GROUP BY step""")
def edit_steps(spark, root):
    return setup.accepted_steps(setup.validate(_edits(spark, root), _edit_files(spark, root)))


@query("U3", W + _VALID + """
SELECT DISTINCT step FROM edits EXCEPT SELECT step FROM valid GROUP BY step HAVING bool_and(refusal IS NULL)""")
def steps_left(spark, root):
    """Planned minus applied."""
    applied = edit_steps(spark, root).filter("accepted")
    return _edits(spark, root).select("step").distinct().join(applied.select("step"), "step", "left_anti")


@query("Z7", W + d.TREE + """
SELECT doc_id, CASE WHEN contains(path, 'package.json') THEN CASE
    WHEN regexp_matches(content, '"i18next"[ ]*:') THEN content
    WHEN regexp_matches(content, '"dependencies"[ ]*:[ ]*\\{[ \\t\\r\\n]*"') THEN regexp_replace(content, '"dependencies"([ ]*:[ ]*)\\{[ \\t\\r\\n]*"', '"dependencies"\\1{"i18next": "^23.0.0", "', 'g')
    ELSE regexp_replace(content, '[ \\t\\r\\n]*\\}[ \\t\\r\\n]*$', ', "dependencies": {"i18next": "^23.0.0"}}') END
  WHEN path = 'pubspec.yaml' THEN CASE WHEN regexp_matches(content, '(?m)^  generate: true$') THEN content
    WHEN regexp_matches(content, '(?m)^flutter:[ ]*$') THEN regexp_replace(content, '(?m)^flutter:[ ]*$', 'flutter:' || chr(10) || '  generate: true', 'g')
    ELSE regexp_replace(content, '\\n*$', '') || chr(10) || 'flutter:' || chr(10) || '  generate: true' || chr(10) END
  ELSE CASE WHEN contains(content, '<NeutralLanguage>') THEN content
    ELSE regexp_replace(content, '^((?s:.*?)<PropertyGroup>)', '\\1<NeutralLanguage>en</NeutralLanguage>') END END AS patched
FROM tree WHERE path IN ('package.json', 'web/package.json', 'pubspec.yaml', 'App.csproj')""")
def manifest_patches(spark, root):
    t = d.tree(spark, root).filter(F.col("path").isin("package.json", "web/package.json", "pubspec.yaml", "App.csproj"))
    c = F.col("content")
    patched = (
        F.when(F.contains("path", F.lit("package.json")), setup.add_json_dependency(c, "i18next", "^23.0.0"))
        .when(F.col("path") == "pubspec.yaml", setup.add_yaml_flag(c, "flutter", "generate: true"))
        .otherwise(setup.add_property(c, "NeutralLanguage", "en"))
    )
    return t.select("doc_id", patched.alias("patched"))


@query("U1", """SELECT min(tag) AS tag FROM (SELECT lang AS tag FROM documents UNION ALL SELECT upper(lang) FROM documents
UNION ALL SELECT role FROM conversations UNION ALL SELECT event_type FROM events) x GROUP BY upper(tag)""")
def option_union(spark, root):
    docs = table(spark, root, "documents").select("lang")
    tags = docs.select(F.col("lang").alias("tag")).unionByName(docs.select(F.upper("lang").alias("tag")))
    tags = tags.unionByName(table(spark, root, "conversations").select(F.col("role").alias("tag"))).unionByName(table(spark, root, "events").select(F.col("event_type").alias("tag")))
    return tags.groupBy(F.upper("tag").alias("_k")).agg(F.min("tag").alias("tag")).select("tag")


@query("U2", W + d.LINES + """
SELECT doc_id, line, min(claim) AS claim FROM (
  SELECT doc_id, line, 1 AS claim FROM lines WHERE regexp_matches(text, '[0-9]') UNION ALL
  SELECT doc_id, line, 2 FROM lines WHERE regexp_matches(text, '@') UNION ALL
  SELECT doc_id, line, 3 FROM lines WHERE regexp_matches(text, '[A-Z]')) x GROUP BY doc_id, line""")
def first_claim(spark, root):
    """Three match streams over one scan; the first claim per position wins."""
    t = F.col("text")
    claims = F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(i)) for i, p in [(1, "[0-9]"), (2, "@"), (3, "[A-Z]")]]))
    return d.lines(spark, root).select("doc_id", "line", F.array_min(claims).cast("long").alias("claim")).filter("claim is not null")


# --- rewriting --------------------------------------------------------------------------------------

_COMBOS = [(dialect, kind) for dialect, kinds, _, _ in rewrite.RULES for kind in kinds] + [("html", "MarkupText"), ("interface_builder", "MarkupAttribute")]


def _template_sql(template: str) -> str:
    out, rest = [], template.replace("{{", "\u0001").replace("}}", "\u0002").replace("{key}", "\u0003").replace("{name}", "\u0004")
    for part in __import__("re").split("([\u0003\u0004])", rest):
        if part == "\u0003":
            out.append("key")
        elif part == "\u0004":
            out.append("'label'")
        elif part:
            out.append(d.lit(part.replace("\u0001", "{").replace("\u0002", "}")))
    return " || ".join(out)


@query("R1,D21", W + d.UNITS + f"""
SELECT key, dialect, kind, CASE {' '.join(f"WHEN dialect = '{dl}' AND kind IN {d.sql_list(ks)} THEN {_template_sql(t)}" for dl, ks, t, _ in rewrite.RULES)} END AS replacement,
  CASE {' '.join(f"WHEN dialect = '{dl}' AND kind IN {d.sql_list(ks)} THEN {d.lit(i.format())}" for dl, ks, _, i in rewrite.RULES if i)} END AS required_import
FROM (SELECT key, c.dialect AS dialect, c.kind AS kind FROM (SELECT key, unnest([{', '.join(f"{{'dialect': '{a}', 'kind': '{b}'}}" for a, b in _COMBOS)}]) AS c FROM units) u) x""")
def rewrite_plan(spark, root):
    combos = F.array(*[F.struct(F.lit(a).alias("dialect"), F.lit(b).alias("kind")) for a, b in _COMBOS])
    u = d.units(spark, root).select("key", F.inline(combos))
    p = rewrite.plan(F.col("dialect"), F.col("kind"), F.col("key"), F.lit("label"))
    return u.select("key", "dialect", "kind", p.alias("p")).select("key", "dialect", "kind", "p.replacement", "p.required_import")


def _spliced(spark, root):
    pages = spread(table(spark, root, "pages").select("page_id", "html"))
    found = markup.candidates(pages, ["page_id"], "html", "html").filter("kind = 'MarkupText'")
    p = rewrite.plan(F.lit("jsx"), F.col("kind"), F.concat(F.lit("T"), short_hash(F.col("text"), 16)), F.col("member"))
    edits = found.select("page_id", "span_start", "raw", p["replacement"].alias("replacement"))
    return rewrite.splice(pages, ["page_id"], "html", edits)


_B = d.sql_trim("s.t")
_REPLACE = f"""CASE WHEN s.t NOT LIKE '<%' AND {_B} <> '' AND NOT {dead("coalesce(s.b, '')")} AND NOT {dead("coalesce(s.a, '')")} AND NOT regexp_matches({_B}, '[{{}}]')
  AND NOT {d.sql_noise(ENTITY_SQL.format(_B))} THEN regexp_extract(s.t, '^[ \\t\\r\\n\\f]*', 0) || '{{t("T' || {d.sql_hash(ENTITY_SQL.format(_B), 16)} || '")}}' || regexp_extract(s.t, '[ \\t\\r\\n\\f]*$', 0) ELSE s.t END"""
_NEW_HTML = f"""tok AS (SELECT page_id, html, {TOK} AS tok FROM pages),
cells AS (SELECT page_id, html, list_transform(tok, lambda t, i: {{'t': t, 'b': tok[i - 1], 'a': tok[i + 1]}}) AS cells FROM tok),
spliced AS (SELECT page_id, html, list_transform(cells, lambda s: {_REPLACE}) AS parts, list_transform(cells, lambda s: s.t) AS tok FROM cells)"""


@query("R2,O5", W + _NEW_HTML + " SELECT page_id, md5(array_to_string(parts, '')) AS new_md5 FROM spliced WHERE parts <> tok")
def splice_pages(spark, root):
    return _spliced(spark, root).select("page_id", F.md5("content").alias("new_md5"))


@query("A10,R2", W + _NEW_HTML + """
SELECT count(*) FILTER (n > 0) AS files, CAST(sum(n) AS BIGINT) AS replacements, CAST(0 AS BIGINT) AS skipped FROM (
  SELECT len(list_filter(parts, lambda p: starts_with(p, '{t("T') OR regexp_matches(p, '^[ \\t\\r\\n\\f]+\\{t\\("T'))) AS n FROM spliced) x""")
def rewrite_summary(spark, root):
    return rewrite.summary(_spliced(spark, root))


_IMPORT = 'import { t } from "./i18n";'


@query("R3,P21", f"""SELECT doc_id, md5(CASE lang WHEN 'en' THEN 'import a;' || chr(10) || 'import b;' || chr(10) || '{_IMPORT}' || chr(10) || text
  WHEN 'fr' THEN text || chr(10) || '{_IMPORT}'
  WHEN 'de' THEN '// head' || chr(13) || chr(10) || '{_IMPORT}' || chr(13) || chr(10) || replace(text, chr(10), chr(13) || chr(10)) || chr(13) || chr(10)
  ELSE '{_IMPORT}' || chr(10) || text END) AS new_md5 FROM documents""")
def ensured_imports(spark, root):
    """English files have imports, French ones the line already, German ones a head comment and CRLF."""
    text = F.col("text")
    content = (
        F.when(F.col("lang") == "en", F.concat(F.lit("import a;\nimport b;\n"), text))
        .when(F.col("lang") == "fr", F.concat(text, F.lit("\n" + _IMPORT)))
        .when(F.col("lang") == "de", F.concat(F.lit("// head\r\n"), F.replace(text, F.lit("\n"), F.lit("\r\n")), F.lit("\r\n"))).otherwise(text)
    )
    docs = spread(table(spark, root, "documents").select("doc_id", "lang", "text")).select("doc_id", content.alias("content"))
    new = rewrite.ensure_import(F.col("content"), F.lit(_IMPORT), r"^import [a-z{]", r"^(//|/\*|\*)")
    return docs.select("doc_id", F.md5(new).alias("new_md5"))


@query("R5", W + d.TREE + """
SELECT doc_id, contains(c, 'androidx.compose') AS uses_compose, regexp_matches(c, '@Composable[ \\t\\r\\n]') AS has_composable,
  regexp_matches(c, '(?:class|object)[ \\t]+[A-Za-z0-9_]+[^{\\n]*(?:Activity|Fragment|Service|Context|View)\\b') AS has_context,
  regexp_matches(c, '(?m)^import[ \\t]+[a-z][A-Za-z0-9_.]*\\.R;?[ \\t]*$') AS imports_r
FROM (SELECT doc_id, CASE lang WHEN 'en' THEN 'import a.b.R' || chr(10) || 'class Main : BaseActivity() {' || chr(10) WHEN 'fr' THEN 'import androidx.compose.ui' || chr(10) || '@Composable fun A()' || chr(10) ELSE '' END || content AS c FROM tree) x""")
def android_traits(spark, root):
    head = F.when(F.col("lang") == "en", "import a.b.R\nclass Main : BaseActivity() {\n").when(F.col("lang") == "fr", "import androidx.compose.ui\n@Composable fun A()\n").otherwise("")
    t = d.tree(spark, root).select("doc_id", code.file_traits(F.concat(head, F.col("content"))).alias("t"))
    return t.select("doc_id", "t.*")


@query("W10,P18,A4", W + d.KEPT + f"""
SELECT key, '    public static string ' || key || ' => Get("' || key || '");' AS accessor FROM (SELECT DISTINCT {d.sql_base_key('text')} AS key FROM (SELECT DISTINCT text FROM kept) t) k
WHERE regexp_matches(key, '^[\\p{{L}}_][\\p{{L}}\\p{{N}}_]*$') AND key NOT IN {d.sql_list(fixed.RESERVED_MEMBERS)}""")
def accessor_members(spark, root):
    from ..functions import keys
    from ..operators.report import accessor_lines

    k = d.kept(spark, root).select("text").distinct().select(keys.base_key(F.col("text")).alias("key")).distinct()
    return accessor_lines(k)


# --- spans ------------------------------------------------------------------------------------------

@query("X28", """SELECT conv_id, island, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS turns, sum(length(text)) AS chars FROM (
  SELECT *, CAST(sum(is_new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM (
    SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS is_new
    FROM (SELECT *, length(text) > 200 AS kind FROM conversations) a) b) c GROUP BY conv_id, island""")
def adjacent_merge(spark, root):
    """Neighbouring long (or short) turns as one span."""
    c = table(spark, root, "conversations").select("conv_id", "turn", F.length("text").alias("len"))
    out = islands.islands(c.withColumn("kind", F.col("len") > 200), "conv_id", "turn", "kind")
    return out.groupBy("conv_id", "island").agg(
        F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("turns"), F.sum("len").alias("chars"))


@query("X29,J13", """SELECT l_returnflag, count(*) AS spans, count(*) FILTER (inside) AS inside_n FROM (
  SELECT l_returnflag, EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey AND l.l_orderkey > p.p_size * 100 AND l.l_orderkey < p.p_size * 400) AS inside
  FROM lineitem l) x GROUP BY l_returnflag""")
def scope_range_join(spark, root):
    """Line items as literals at an order position, parts as bodies with a start and an end."""
    spans = table(spark, root, "lineitem").select("l_returnflag", F.col("l_partkey").alias("file"), F.col("l_orderkey").alias("position"))
    size = F.col("p_size").cast("long")
    bodies = table(spark, root, "part").select(F.col("p_partkey").alias("file"), (size * 100).alias("start"), (size * 400).alias("end"))
    inner = islands.inside(spans, bodies, "file").groupBy("l_returnflag").agg(F.count("*").alias("inside_n"))
    total = spans.groupBy("l_returnflag").agg(F.count("*").alias("spans"))
    return total.join(inner, "l_returnflag", "left").select("l_returnflag", "spans", F.coalesce("inside_n", F.lit(0)).alias("inside_n"))


# --- events -----------------------------------------------------------------------------------------

@query("E1,D20", """SELECT e.user_id, e.event_id, e.event_type, l.complete FROM events e
JOIN (SELECT user_id, coalesce(max(event_id) FILTER (event_type = 'signup'), -1) AS cursor, arg_max(event_type, event_id) = 'purchase' AS complete FROM events GROUP BY user_id) l
ON e.user_id = l.user_id AND e.event_id > l.cursor""")
def event_cursor(spark, root):
    """Every reader replays what came after its last sign-up; a log that ends in a purchase is complete."""
    from ..streaming.events import after_cursor

    e = table(spark, root, "events").select("user_id", "event_id", "event_type")
    logs = e.groupBy("user_id").agg(
        F.coalesce(F.max(F.when(F.col("event_type") == "signup", F.col("event_id"))), F.lit(-1)).alias("cursor"),
        (F.max_by("event_type", "event_id") == "purchase").alias("complete"))
    return after_cursor(e, logs, "user_id").select("user_id", "event_id", "event_type", "complete")
