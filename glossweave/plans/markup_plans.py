"""Markup extraction over ``pages`` and over markup that Spark builds from text columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions import noise, text as tx
from ..operators import markup
from ..session import evaluate_once, spread, table
from . import derive as d
from .registry import query
from .text_plans import ENTITY_SQL



def _pages(spark, root):
    return spread(table(spark, root, "pages").select("page_id", "html"))


TOK = f"regexp_extract_all(html, {d.lit(tx.re2(fixed.MARKUP_TOKEN))}, 0)"


def dead(c: str) -> str:
    return d.sql_match(c, fixed.DEAD_START)


def _nodes(source: str = "pages", key: str = "page_id") -> str:
    """tok(key, ord, t, b, a) and nodes(key, ord, raw, text, element) as SQL."""
    return f"""tok AS (
  SELECT {key}, unnest(tok) AS t, generate_subscripts(tok, 1) AS ord FROM (SELECT {key}, {TOK} AS tok FROM {source}) p),
nb AS (SELECT {key}, ord, t, coalesce(lag(t) OVER w, '') AS b, coalesce(lead(t) OVER w, '') AS a,
              coalesce(sum(length(t)) OVER (PARTITION BY {key} ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off,
              coalesce(sum(length(t) - length(replace(t, chr(10), ''))) OVER (PARTITION BY {key} ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nl
       FROM tok WINDOW w AS (PARTITION BY {key} ORDER BY ord)),
nodes AS (SELECT *, {d.sql_trim(ENTITY_SQL.format('t'))} AS text, regexp_extract(b, {d.lit(fixed.TAG_NAME)}, 1) AS element
          FROM nb WHERE t NOT LIKE '<%' AND NOT {dead('b')} AND NOT {dead('a')})"""


@query("X1", f"""SELECT page_id, length(m) = length(html) AS same_length, md5(m) AS masked_md5 FROM (
  SELECT page_id, html, array_to_string(list_transform({TOK}, lambda t: CASE WHEN {d.sql_match('t', fixed.MARKUP_DEAD)}
    THEN regexp_replace(t, '[^\\r\\n]', ' ', 'g') ELSE t END), '') AS m FROM pages) p""")
def mask_html(spark, root):
    m = tx.mask(F.col("html"), fixed.MARKUP_DEAD)
    pages = _pages(spark, root).select("page_id", "html", m.alias("m"))
    return pages.select("page_id", (F.length("m") == F.length("html")).alias("same_length"), F.md5("m").alias("masked_md5"))


_BODY = r"(?s)<body[^<>]*>.*</body>"


@query("X2", f"""SELECT page_id, length(m) = length(html) AS same_length, md5(m) AS masked_md5 FROM (
  SELECT page_id, html, regexp_replace(substr(html, 1, strpos(html, body) - 1), '[^\\r\\n]', ' ', 'g') || body
     || regexp_replace(substr(html, strpos(html, body) + length(body)), '[^\\r\\n]', ' ', 'g') AS m
  FROM (SELECT page_id, html, regexp_extract(html, {d.lit(_BODY)}) AS body FROM pages) x) p""")
def mask_outside_body(spark, root):
    m = tx.mask_outside(F.col("html"), _BODY)
    pages = _pages(spark, root).select("page_id", "html", m.alias("m"))
    return pages.select("page_id", (F.length("m") == F.length("html")).alias("same_length"), F.md5("m").alias("masked_md5"))


@query("X3", "WITH " + _nodes() + f"""
SELECT page_id, count(*) FILTER (ok) AS intact, count(*) FILTER (NOT ok) AS masked FROM (
  SELECT page_id, NOT {dead('b')} AND NOT {dead('a')} AS ok FROM nb WHERE t NOT LIKE '<%' AND {d.sql_trim('t')} <> '') x GROUP BY page_id""")
def intact_spans(spark, root):
    tok = tx.extract_all(F.col("html"), fixed.MARKUP_TOKEN)
    cells = F.transform("tok", lambda t, i: F.struct(t.alias("t"), F.coalesce(F.get("tok", i - 1), F.lit("")).alias("b"), F.coalesce(F.get("tok", i + 1), F.lit("")).alias("a")))
    text = F.filter("cells", lambda s: ~F.startswith(s.t, F.lit("<")) & (tx.trim_ws(s.t) != ""))
    ok = F.filter("text", lambda s: ~markup.is_dead(s.b) & ~markup.is_dead(s.a))
    out = evaluate_once(_pages(spark, root), ["page_id"], tok=tok)
    out = evaluate_once(evaluate_once(out, ["page_id"], cells=cells), ["page_id"], text=text)
    out = out.filter(F.size("text") > 0).select("page_id", F.size(ok).cast("long").alias("intact"), F.size("text").alias("n"))
    return out.select("page_id", "intact", (F.col("n") - F.col("intact")).cast("long").alias("masked"))


@query("X9,X8,N1-N13,A2", "WITH " + _nodes() + f"""
SELECT page_id, text, count(*) AS occurrences FROM nodes WHERE NOT {d.sql_noise('text')} GROUP BY page_id, text""")
def html_text_nodes(spark, root):
    nodes = markup.text_nodes(_pages(spark, root), ["page_id"], "html")
    return nodes.filter(~noise.is_noise_trimmed(F.col("text"))).groupBy("page_id", "text").agg(F.count("*").alias("occurrences"))


@query("X1,X9,X8,N1-N13,A2", "WITH " + _nodes() + f"""
SELECT text, count(*) AS occurrences, count(DISTINCT page_id) AS pages, min(page_id) AS first_page
FROM nodes WHERE NOT {d.sql_noise('text')} GROUP BY text""")
def scan_only_summary(spark, root):
    nodes = markup.text_nodes(_pages(spark, root), ["page_id"], "html").filter(~noise.is_noise_trimmed(F.col("text")))
    per_page = nodes.groupBy("text", "page_id").agg(F.count("*").alias("n"))
    return per_page.groupBy("text").agg(
        F.sum("n").alias("occurrences"), F.count("page_id").alias("pages"), F.min("page_id").alias("first_page"))


@query("X5", "WITH " + _nodes() + f"""
SELECT element, count(*) AS n FROM nodes WHERE text <> '' GROUP BY element""")
def element_names(spark, root):
    nodes = markup.text_nodes(_pages(spark, root), ["page_id"], "html")
    return nodes.filter(F.col("text") != "").groupBy("element").agg(F.count("*").alias("n"))


_BODY_SQL = d.sql_trim("t")
_LEAD_SQL = r"regexp_extract(t, '^[ \t\r\n\f]*', 0)"


@query("D1,X6,X7,X9,S7,B12", "WITH " + _nodes() + f"""
SELECT page_id, CAST(off + length({_LEAD_SQL}) AS BIGINT) AS span_start, CAST(length({_BODY_SQL}) AS BIGINT) AS span_length,
  CAST(nl + 1 + length({_LEAD_SQL}) - length(replace({_LEAD_SQL}, chr(10), '')) AS BIGINT) AS line, {ENTITY_SQL.format(_BODY_SQL)} AS text,
  element AS member,
  trim(regexp_replace(regexp_replace(right(b, 60) || t || substr(a, 1, 60), '[\\r\\n]+', ' ', 'g'), ' {{2,}}', ' ', 'g')) AS context
FROM nodes WHERE {_BODY_SQL} <> '' AND NOT regexp_matches({_BODY_SQL}, '[{{}}]') AND NOT {d.sql_noise(ENTITY_SQL.format(_BODY_SQL))}""")
def html_candidates(spark, root):
    c = markup.candidates(_pages(spark, root), ["page_id"], "html", "html")
    return c.select(
        "page_id", F.col("span_start").cast("long"), F.col("span_length").cast("long"), F.col("line").cast("long"),
        "text", "member", "context")


# --- attributes: lines wrapped into markup of each dialect -----------------------------------------
# {0} is the attribute-escaped line; each wrapper holds accepted, ignored and reference-valued attributes
WRAPPERS = {
    "html": '<p class="x">\n<img alt="{0}" src="a.png"><input type="text" placeholder=\'{0}\' title="{0}"></p><!-- <b title="{0}"> -->',
    "xaml": '<Grid>\n  <Button Content="{0}" Command="Go" ToolTip="{0}"/>\n<TextBox Text="{{Binding Name}}" x:Name="{0}"/></Grid>',
    "android_layout": '<LinearLayout>\n<TextView android:text="{0}" tools:text="{0}" android:id="@+id/a"/><EditText android:hint="@string/x" app:title="{0}"/></LinearLayout>',
    "interface_builder": '<scene>\n<button title="{0}" id="a1"/><label text="{0}" fontDescription="{0}"/></scene>',
    "vue": '<div :title="x" v-text="{0}" @click="go"><span title="{0}" data-x="{0}"></span></div>',
    "jsx": 'export const A = ({a}) => (\n<Card icon={<I n={{b: {c: {d: `}${a ? "{" : 1}`}}}}/>} onClick={() => {if (a < 1 && a > 0) {go({a: {a}});}}} title="{0}" name="{0}"></Card>); // <b title="{0}">\n',
    "razor": '<div>\n<a title="@Model.Name" href="/x">x</a><input placeholder="{0}" value="{0}"/></div>',
}
EXPECTED = {
    "html": ["alt", "placeholder", "title"], "xaml": ["Content", "ToolTip"], "android_layout": ["android:text", "app:title"],
    "interface_builder": ["title", "text"], "vue": ["title"], "razor": ["placeholder"], "jsx": ["title"],
}


def _escape_sql(c: str) -> str:
    return f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


def _attribute_query(dialect: str):
    reject = {"xaml": r"^\{", "android_layout": r"^[@?]", "razor": "@"}.get(dialect)
    extra = f" AND NOT {d.sql_match(_escape_sql('text'), reject)}" if reject else ""
    sql = "WITH " + d.LINES + f"""
SELECT doc_id, line, unnest({EXPECTED[dialect]}) AS attribute, {ENTITY_SQL.format(_escape_sql('text'))} AS text
FROM lines WHERE {d.sql_trim('text')} <> '' AND NOT {d.sql_noise(ENTITY_SQL.format(_escape_sql('text')))}{extra}"""

    def run(spark, root):
        from ..functions.escapes import escape_xml_attribute

        value = F.replace(escape_xml_attribute(F.col("text")), F.lit("'"), F.lit("&apos;"))
        template = WRAPPERS[dialect] if dialect == "jsx" else WRAPPERS[dialect].replace("{{", "{").replace("}}", "}")
        head, *rest = template.split("{0}")
        built = F.concat(F.lit(head), *[x for r in rest for x in (value, F.lit(r))])
        df = d.lines(spark, root).select("doc_id", "line", built.alias("content"))
        df = df.withColumnRenamed("line", "doc_line")
        c = markup.candidates(df, ["doc_id", "doc_line"], "content", dialect)
        return c.filter(F.col("phase") == 0).select("doc_id", F.col("doc_line").alias("line"), F.col("member").alias("attribute"), "text")

    run.__name__ = f"attributes_{dialect}"
    ids = {"html": "X4,X9,N14", "xaml": "X17", "android_layout": "X21", "interface_builder": "X25", "vue": "X11", "razor": "X18", "jsx": "X10"}
    return query(ids[dialect], sql)(run)


for _dialect in WRAPPERS:
    _attribute_query(_dialect)


# --- text nodes: lines between tags of each dialect, and where they are no copy ---------------------
# {0} is the escaped line; the elements listed hold it as live text
TEXTS = {
    "xaml": ('<Grid>\n<TextBlock>{0}</TextBlock><Button Content="x">\n  {0} </Button><!-- <Run>{0}</Run> --></Grid>', ["TextBlock", "Button"]),
    "vue": ('<div v-if="a > b && c"><p>{0}</p><span>{{ {0} }}</span><!-- <b>{0}</b> --></div>', ["p"]),
    "jsx": (
        'export const A = ({a}) => (\n<Card icon={<I n={{b: {c: {d: `}${a ? "{" : 1}`}}}}/>} go={() => {if (a < 1 && a > 0) {go({a: {a: {a}}});}}}>\n'
        "<p>{0}</p>{a && <b className='x'>{0}</b>}<i>{a} {0}</i><Trans>{0} <u>{0}</u></Trans><><em>{a.map((x) => <li key={x}>{0}</li>)}</em></></Card>);\n"
        "// <s>{0}</s>\nconst f = (a < b) ? useA<string>(a) : a > 3 && /<q>/.test(a);\n", ["p", "b", "li"]),
    "razor": (
        '@page "/x"\n@using A.B\n@code { List<string> a = new List<string>(); string s = @"<q>{0}</q>"; void F() { if (a.Count < 3) { } } }\n'
        '@if (Model.A < 3 && F("}")) {\n<p title="@(x ? "a" : "b")">{0}</p>\n  int y = 1; if (y > 0) { <b>{0}</b> } }\nelse if (F<int>(1)) { <br> <i>@y {0}</i> }\n'
        "<u>{0}</u>@{ var z = new Dictionary<string, List<int>>(); { { } } }@* <s>{0}</s> *@<em>{0}</em>\n@foreach (var i in z) { foreach (var j in i) { <li>{0}</li> } }",
        ["p", "b", "u", "em", "li"]),
}


def _text_query(dialect: str):
    template, elements = TEXTS[dialect]
    # braces and at signs that are no code are written as references
    code = [("{", "&#123;"), ("}", "&#125;"), ("@", "&#64;")]
    escaped = _escape_sql("text")
    for old, new in code:
        escaped = f"replace({escaped}, '{old}', '{new}')"
    shown = ENTITY_SQL.format(d.sql_trim(escaped))
    sql = "WITH " + d.LINES + f"""
SELECT doc_id, line, unnest({elements}) AS element, {shown} AS text FROM lines WHERE {d.sql_trim('text')} <> '' AND NOT {d.sql_noise(shown)}"""

    def run(spark, root):
        from ..functions.escapes import escape_xml_attribute

        value = F.replace(escape_xml_attribute(F.col("text")), F.lit("'"), F.lit("&apos;"))
        for old, new in code:
            value = F.replace(value, F.lit(old), F.lit(new))
        head, *rest = template.split("{0}")
        built = F.concat(F.lit(head), *[x for r in rest for x in (value, F.lit(r))])
        df = d.lines(spark, root).select("doc_id", F.col("line").alias("doc_line"), built.alias("content"))
        c = markup.candidates(df, ["doc_id", "doc_line"], "content", dialect).filter(F.col("phase") == 1)
        return c.select("doc_id", F.col("doc_line").alias("line"), F.col("member").alias("element"), "text")

    run.__name__ = f"text_{dialect}"
    ids = {"xaml": "X17", "vue": "X11", "jsx": "X10", "razor": "X18"}
    return query(ids[dialect], sql)(run)


for _dialect in TEXTS:
    _text_query(_dialect)


@query("X7", """SELECT page_id, trim(regexp_replace(regexp_replace(substr(html, greatest(1, p - 60), p + 4 + 60 - greatest(1, p - 60)), '[\\r\\n]+', ' ', 'g'), ' {2,}', ' ', 'g')) AS snippet
FROM (SELECT page_id, html, strpos(html, '<h1>') AS p FROM pages) x WHERE p > 0""")
def context_snippet(spark, root):
    pages = _pages(spark, root).select("page_id", "html", F.locate("<h1>", "html").alias("p")).filter("p > 0")
    return pages.select("page_id", tx.snippet(F.col("html"), F.col("p"), F.lit(4), 60, 60).alias("snippet"))
