"""Code extraction: every document becomes one source file per language, one statement set per line.

What must come out is known from the statements, so SQL can state it without reading code.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import code
from ..operators.rewrite import splice
from ..session import spread, table
from . import derive as d
from .registry import query

# statement templates: (before the literal, after it, expected kind or None)
STATEMENTS = {
    "swift": [
        ('Text("', '")', "UiCall"), ('let a = "', '"', None), ('button.title = "', '"', "Assignment"),
        ('show(title: "', '")', "NamedArgument"), ('print("', '")', None), ('// Text("', '")', None), ('Image(systemName: "', '")', None),
        ('NSLocalizedString("', '", comment: "")', None),
        ('Text(flag ? "', '" : other)', "UiCall"), ('Text(flag ? other : "', '")', "UiCall"), ('.alert(isPresented: $x, "', '")', "UiCall"),
        ('print(x, label: "', '")', None),
    ],
    "objc": [
        ('[b setTitle:@"', '" forState:0];', "UiCall"), ('label.text = @"', '";', "Assignment"), ('NSLog(@"', '");', None),
        ('char *c = "', '";', None), ('s = NSLocalizedString(@"', '", nil);', None), ('[a message:@"', '"];', "NamedArgument"),
    ],
    "dart": [
        ('Text("', '"),', "UiCall"), ('TextField(hintText: "', '"),', "NamedArgument"), ('debugPrint("', '");', None),
        ('final k = Key("', '");', None), ('const Text("', '");', "UiCall"), ('/* Text("', '") */', None),
        ('const Column(children: [Text(x), Text("', '")]);', "UiCall"), ('log(f(x), name: g(y), error: "', '");', None),
    ],
    "android": [
        ('view.setText("', '")', "UiCall"), ('Toast.makeText(ctx, "', '", 0).show()', "UiSecondArgument"), ('Log.d(TAG, "', '")', None),
        ('Row(contentDescription = "', '")', "NamedArgument"), ('val x = "', '"', None), ('@Named("', '")', None),
        ('@Named(text = "', '")', None), ('Log.d(TAG, x, title = "', '")', None), ('view.setText(x + "', '")', "UiCall"),
    ],
    "script": [('alert("', '");', "UiCall"), ('t("', '");', None), ('toast.error("', '");', "UiCall"), ('const a = "', '";', None)],
    "csharp": [
        ('var a = "', '";', "CodeLiteral"), ('if (a == "', '") return;', None), ('_logger.LogInformation("', '");', None),
        ('[Display("', '")]', "Attribute"), ('throw new InvalidOperationException("', '");', None), ('case "', '":', None),
        ('x = name.StartsWith("', '");', None), ('y = "', '" == z;', None), ('Go(L["', '"]);', None),
        ('_logger.LogInformation(x + "', '");', None), ('throw new BadException(x + f(y) + "', '" + z);', None),
        ('if (a == (flag ? "', '" : b)) return;', None), ('Assert.Fail("', '");', None), ('Go(new[] { f(x), "', '" });', "CodeLiteral"),
    ],
}
_IDS = {
    "swift": "X23,X26", "objc": "X24,X26", "dart": "X27,X28,X30", "android": "X19,X20", "script": "X10,X12", "csharp": "X13,X14,X15",
}


def escaped(c):
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


_ESC = "replace(replace(text, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34))"


def source_files(spark, root, dialect):
    """(doc_id, content): one file per document, as many statements per line as the language has templates."""

    def statements(line):
        parts = []
        for before, after, _ in STATEMENTS[dialect]:
            parts += [F.lit(before), line, F.lit(after + "\n")]
        return F.concat(*parts)

    # escaped once, not in every statement; no escape makes or takes a line
    content = F.array_join(F.transform(F.split(escaped(F.col("text")), "\n"), statements), "")
    return spread(table(spark, root, "documents").select("doc_id", "text")).select("doc_id", content.alias("content"))


def _code_query(dialect: str):
    spec = code.DIALECTS[dialect]
    rows = STATEMENTS[dialect]
    n = len(rows)
    wanted = ", ".join(f"{{'j': {j + 1}, 'kind': '{kind}'}}" for j, (_, _, kind) in enumerate(rows) if kind)
    conditions = [f"NOT {d.sql_noise('text')}"]
    if spec.skip:
        conditions.append("NOT " + d.sql_match(f"chr(34) || {_ESC} || chr(34)", code.re2(spec.skip)))
    sql = "WITH " + d.LINES + f"""
SELECT doc_id, CAST((line - 1) * {n} + s.j AS BIGINT) AS line, s.kind AS kind, text
FROM (SELECT *, unnest([{wanted}]) AS s FROM lines) x WHERE {' AND '.join(conditions)}"""

    def run(spark, root):
        c = code.candidates(source_files(spark, root, dialect), ["doc_id"], "content", dialect)
        return c.select("doc_id", F.col("line").cast("long"), "kind", "text")

    run.__name__ = f"extract_code_{dialect}"
    return query(_IDS[dialect] + ",S7", sql)(run)


for _dialect in STATEMENTS:
    _code_query(_dialect)


_OWN = "replace(replace(text, '{', '{{'), '}', '}}')"


@query("X16", "WITH " + d.KEPT + f""",
k AS (SELECT DISTINCT {_OWN} AS own, lang, CASE WHEN lang = 'en' THEN '' ELSE ':N0' END AS clause FROM kept)
SELECT own || ' {{name}} {{{{' || lang || '}}}} {{count' || clause || '}}' AS body, own || ' {{0}} {{{{' || lang || '}}}} {{1}}' AS format,
       CASE WHEN clause = '' THEN 'name|count' END AS args FROM k""")
def format_strings(spark, root):
    """All texts; a brace of the text itself is doubled, as it is in an interpolated literal."""
    own = F.replace(F.replace("text", F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))
    tail = F.when(F.col("lang") == "en", F.lit("")).otherwise(F.lit(":N0"))
    body = F.concat(own, F.lit(" {name} {{"), F.col("lang"), F.lit("}} {count"), tail, F.lit("}"))
    bodies = d.kept(spark, root).select(body.alias("body")).distinct()
    b = F.col("body")
    return bodies.select("body", code.format_string(b).alias("format"), F.array_join(code.format_arguments(b), "|").alias("args"))


@query("X32,A10", "WITH " + d.LINES + f"""
SELECT kind, count(*) AS n FROM (SELECT unnest(['CodeLiteral', 'Diagnostic', 'Attribute', 'Diagnostic', 'Diagnostic', 'Diagnostic', 'CodeLiteral']) AS kind, text FROM lines) x
WHERE NOT {d.sql_noise('text')} GROUP BY kind""")
def diagnostics_opted_in(spark, root):
    c = code.candidates(source_files(spark, root, "csharp"), ["doc_id"], "content", "csharp", include_diagnostics=True)
    return c.groupBy("kind").agg(F.count("*").alias("n"))


@query("X3,X6,R2", "WITH " + d.LINES + f"""
SELECT doc_id, count(*) * 6 AS applied, 0 AS skipped, true AS same FROM lines
WHERE NOT {d.sql_noise('text')} AND NOT {d.sql_match(f"chr(34) || {_ESC} || chr(34)", code.re2(code.DIALECTS['swift'].skip))} GROUP BY doc_id""")
def code_spans_hold(spark, root):
    """Every literal put back where it was found gives the same file: all spans are exact."""
    files = source_files(spark, root, "swift")
    c = code.candidates(files, ["doc_id"], "content", "swift")
    out = splice(files, ["doc_id"], "content", c.select("doc_id", "span_start", "raw", F.col("raw").alias("replacement")))
    # files are compared by their hashes, so that no content is moved for it
    out = out.select("doc_id", "applied", "skipped", F.md5("content").alias("new")).join(files.select("doc_id", F.md5("content").alias("old")), "doc_id")
    return out.select("doc_id", F.col("applied").cast("long"), "skipped", (F.col("new") == F.col("old")).alias("same"))


# scope templates: (before the literal, after it, expected reason or None)
NO_CONTEXT = code.DIALECTS["dart"].out_of_scope
SCOPES = [
    ('class A { Widget build(BuildContext context) { return Text("', '"); } }', None),
    ('void f() { var x = Text("', '"); }', NO_CONTEXT),
    ('Widget w(BuildContext context) => Text("', '");', None),
    ('final t = Text("', '");', NO_CONTEXT),
    ('Widget b(BuildContext context) { return const Column(children: [Text(x), Text("', '")]); }', "const scope"),
    ('Widget c(BuildContext context) { return B(make: () { if (a) { for (;;) { return Row([Text("', '")]); } } }); }', None),
    ('Widget d(Key k, BuildContext context) async { g(() { h({}); }); return Text("', '"); }', None),
    ('show(a, (BuildContext context, i) => Text(i), Text("', '"));', NO_CONTEXT),
    ('Widget e(/* BuildContext context) { */ int i) { return Text("', '"); }', NO_CONTEXT),
]
_SCOPE_ROWS = ", ".join(f"{{'j': {j + 1}, 'reason': {d.lit(r) if r else 'CAST(NULL AS VARCHAR)'}}}" for j, (_, _, r) in enumerate(SCOPES))
_DART_COPY = f"NOT {d.sql_noise('text')} AND NOT " + d.sql_match(f"chr(34) || {_ESC} || chr(34)", code.re2(code.DIALECTS["dart"].skip))


def _built(spark, root, templates):
    """(doc_id, content): every line of a document in each of the templates, a line for each."""

    def statements(line):
        return F.concat(*[part for before, after, *_ in templates for part in (F.lit(before), escaped(line), F.lit(after + "\n"))])

    docs = spread(table(spark, root, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), statements), "").alias("content"))


@query("X29,X30,J13", "WITH " + d.LINES + f"""
SELECT doc_id, CAST((line - 1) * {len(SCOPES)} + s.j AS BIGINT) AS line, s.reason AS reason, text
FROM (SELECT *, unnest([{_SCOPE_ROWS}]) AS s FROM lines) x WHERE {_DART_COPY}""")
def dart_scopes(spark, root):
    """Literals outside every body that has a build context are reported, not offered for rewriting."""
    c = code.candidates(_built(spark, root, SCOPES), ["doc_id"], "content", "dart")
    return c.select("doc_id", F.col("line").cast("long"), F.col("blocked_reason").alias("reason"), "text")


_GAP = '" /* first "half" */\n // then\n" and more" \'!\''


@query("X28,X27", "WITH " + d.LINES + f"""
SELECT doc_id, CAST((line - 1) * 3 + 1 AS BIGINT) AS line, text || ' and more!' AS text, CAST(length({_ESC}) + {1 + len(_GAP)} AS BIGINT) AS span_length
FROM lines WHERE NOT {d.sql_noise("text || ' and more!'")} AND NOT {d.sql_match(f"chr(34) || {_ESC} || chr(34)", code.re2(code.DIALECTS["dart"].skip))}""")
def adjacent_literals(spark, root):
    """Literals with blanks and comments between them are one candidate with one span."""
    one = lambda line: F.concat(F.lit('Text("'), escaped(line), F.lit(_GAP + "),\n"))
    content = F.array_join(F.transform(F.split("text", "\n"), one), "")
    files = spread(table(spark, root, "documents").select("doc_id", "text")).select("doc_id", content.alias("content"))
    c = code.candidates(files, ["doc_id"], "content", "dart")
    return c.select("doc_id", F.col("line").cast("long"), "text", F.col("span_length").cast("long"))
