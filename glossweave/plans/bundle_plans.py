"""Bundles written to the shared folder and read back, per format."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions import escapes as esc, locales
from ..session import materialise
from ..sources import bundles as b, patches
from . import derive as d
from .registry import query

_PATHS = {
    "resx": "'L/App.' || lang || '.resx'", "i18next": "'L/' || lang || '/App.json'", "android": "'L/values-' || lang || '/App.xml'",
    "strings": "'L/' || lang || '.lproj/App.strings'", "arb": "'L/App_' || lang || '.arb'",
}
_IDS = {"resx": "W1", "i18next": "W2", "android": "W3", "strings": "W4", "arb": "W5"}
_VALUE = """text || ' %d "q" ' || lang || ' <b> & \\ ''' || chr(10) || chr(9) || 'x'"""


def incoming(spark, root, fmt):
    """Every distinct text as an entry of three bundles, with characters that each format must escape."""
    df = d.per_language(d.units(spark, root).select("key", "text", "first_doc"))
    value = F.concat("text", F.lit(' %d "q" '), "lang", F.lit(" <b> & \\ '\n\tx"))
    path = locales.bundle_path(F.lit(fmt), F.lit("L"), F.lit("App"), F.col("lang"))
    return df.select(path.alias("path"), "key", value.alias("value"), F.concat(F.lit("doc "), "first_doc").alias("comment"))


def _roundtrip(fmt: str):
    sql = "WITH " + d.UNITS + f", u AS (SELECT key, text, unnest(['de', 'es', 'fr']) AS lang FROM units) SELECT {_PATHS[fmt]} AS path, key, {_VALUE} AS value FROM u"

    def run(spark, root):
        none = spark.createDataFrame([], "path string, text string")
        folder = b.write_lines(b.merge_lines(none, incoming(spark, root, fmt), fmt))
        return b.read_lines(spark, folder, fmt).select("path", "key", "value")

    run.__name__ = f"bundle_roundtrip_{fmt}"
    return query(_IDS[fmt] + ",S12,P8,P9,P10,G2", sql)(run)


for _fmt in _PATHS:
    _roundtrip(_fmt)


# --- merging into bundles that exist: every document is a bundle with its lines as entries, written as by hand -------------
# entry styles by line number modulo 3; {k} key, {v} the value as the format writes it, {r} without the XML layer.
# Lines of style 0 get a new value, those of style 1 the one they have, those of style 2 none.
_HAND = {
    "resx": (
        '<?xml version="1.0" encoding="utf-8"?>\r\n<root>\r\n  <!-- <data name="no"><value>x</value></data> </root> -->\r\n',
        ['  <data name="{k}" xml:space="preserve">\r\n    <value>{v}</value>\r\n    <comment>by hand</comment>\r\n  </data>\r\n',
         '  <data name="{k}"><value><![CDATA[{r}]]></value></data>\r\n\r\n', "  <data  name='{k}' ><value>{v}&#8217;</value></data>\r\n"],
        '  <data name="zz" xml:space="preserve"><value>Fresh words</value></data>\r\n', "</root>\r\n<!-- </root> -->"),
    "android": (
        "<resources>\n    <!-- <string name=\"no\">x</string> -->\n",
        ['    <string name="{k}" translatable="false">{v}</string>\n', '    <string name="{k}"><![CDATA[{r}]]></string> <!-- \' " -->\n',
         '\n    <string name="{k}">{v}&#8217;</string>\n'],
        '    <string name="zz">Fresh words</string>\n', "</resources>\n"),
    "strings": (
        '/* "no" = "x"; */\n', ['/* note */ "{k}" = "{v}";\n', '"{k}" = "{v}"; "x{k}" = "a // b";\n', '{k}\t= "{v}\\u2019" ; // "n" = "x";\n\n'],
        '"zz" = "Fresh words";\n', ""),
    "i18next": (
        '{\r\n    "a": {"}": [1, "{"]}', [',\r\n    "{k}": {v}', ',\r\n    "{k}" :{v}', ', "{k}": {"deep": {v}}'], ',\r\n    "zz": "Fresh words"', "\r\n}\r\n"),
    "arb": (
        '{\n\t"@@locale": "en"', [',\n\t"{k}": {v},\n\t"@{k}": {"description": "by hand"}', ',\n\t"{k}" : {v}', ',\n\t"{k}": 12'], ',\n\t"zz": "Fresh words"', "\n}"),
}


def _sql_escaped(fmt: str, c: str) -> tuple[str, str]:
    """SQL of (the value as written, the same without the XML layer)."""
    xml = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;"), ("\n", "&#10;")]
    if fmt == "resx":
        return _sql_chain(c, xml), c
    if fmt == "android":
        raw = _sql_chain(c, [("\\", "\\\\"), ("\r", ""), ("\n", "\\n"), ("\t", "\\t"), ('"', '\\"'), ("'", "\\'")])
        raw = f"CASE WHEN regexp_matches({raw}, '^[@?]') THEN chr(92) || {raw} ELSE {raw} END"
        raw = f"CASE WHEN regexp_matches({raw}, '^ | $| {{2}}') THEN chr(34) || ({raw}) || chr(34) ELSE {raw} END"
        return _sql_chain(f"({raw})", xml), f"({raw})"
    if fmt == "strings":
        raw = _sql_chain(c, [("\\", "\\\\"), ('"', '\\"'), ("\r\n", "\\n"), ("\r", "\\n"), ("\n", "\\n"), ("\t", "\\t")])
        return raw, raw
    return f"CAST(to_json({c}) AS VARCHAR)", c


def _sql_chain(c: str, pairs) -> str:
    named = {"\r": "chr(13)", "\n": "chr(10)", "\t": "chr(9)", "\r\n": "chr(13) || chr(10)"}
    for old, new in pairs:
        c = f"replace({c}, {named.get(old, d.lit(old))}, {d.lit(new)})"
    return c


def _sql_text(s: str) -> str:
    return "replace(replace(replace(" + d.lit(s.replace("\r", "␍").replace("\n", "␊").replace("\t", "␉")) + ", '␍', chr(13)), '␊', chr(10)), '␉', chr(9))"


def _sql_entry(fmt: str, style: int, c: str) -> str:
    v, r = _sql_escaped(fmt, c)
    text = _sql_text(_HAND[fmt][1][style])
    filled = f"replace(replace(replace({text}, '{{k}}', key), '{{v}}', {v}), '{{r}}', {r})"
    if fmt == "android" and c != "text":  # a new value with several arguments without numbers is marked
        many = f"len(regexp_extract_all(replace({c}, '%%', ''), {d.lit(fixed.PRINTF_UNNUMBERED)})) > 1"
        filled = f"CASE WHEN {many} THEN replace({filled}, ' translatable=\"false\">', ' translatable=\"false\" formatted=\"false\">') ELSE {filled} END"
    return filled


# quotes that keep blanks are taken off a whole value alone: in front of a further character they stay
_WRAPPED = "CASE WHEN regexp_matches(text, ' {2}') THEN chr(34) || text || chr(34) ELSE text END"


def _merge_query(fmt: str):
    head, styles, fresh, tail = _HAND[fmt]
    cases = lambda changed: "CASE line % 3 " + " ".join(
        f"WHEN {i} THEN {_sql_entry(fmt, i, 'text || ' + d.lit(' neu') if changed and i == 0 else 'text')}" for i in range(3)) + " END"
    last = {"resx": "text || chr(8217)", "strings": "text || chr(8217)", "android": f"{_WRAPPED} || chr(8217)"}.get(fmt, "NULL")
    shown = f"CASE line % 3 WHEN 0 THEN text || ' neu' WHEN 1 THEN text ELSE {last} END"
    extra = "UNION ALL SELECT doc_id, 'x' || key, 'a // b' FROM e WHERE line % 3 = 1" if fmt == "strings" else ""
    sql = "WITH " + d.KEPT + f""",
e AS (SELECT doc_id, line, 'k' || lpad(CAST(line AS VARCHAR), 9, '0') AS key, text FROM kept WHERE NOT contains(text, ']]>')),
t AS (SELECT doc_id, {_sql_text(head)} || string_agg({cases(True)}, '' ORDER BY line) || {_sql_text(fresh)} || {_sql_text(tail)} AS text FROM e GROUP BY doc_id),
v AS (SELECT doc_id, key, {shown} AS value FROM e UNION ALL SELECT DISTINCT doc_id, 'zz', 'Fresh words' FROM e {extra}),
w AS (SELECT doc_id, count(*) AS n, md5(string_agg(key || '=' || value, chr(10) ORDER BY key)) AS entries_md5 FROM v WHERE value IS NOT NULL GROUP BY doc_id)
SELECT t.doc_id, true AS same, md5(text) AS text_md5, n, entries_md5 FROM t JOIN w ON w.doc_id = t.doc_id"""

    def run(spark, root):
        df = d.kept(spark, root).filter(~F.contains("text", F.lit("]]>"))).select("doc_id", "line", "text")
        df = df.withColumn("key", F.concat(F.lit("k"), F.lpad(F.col("line").cast("string"), 9, "0")))
        r = {"android": esc.escape_android(F.col("text")), "strings": esc.escape_apple(F.col("text"))}.get(fmt, F.col("text"))
        v = b._json_text(F.col("text")) if fmt in ("i18next", "arb") else r if fmt == "strings" else b._xml_text(r)
        filled = F.lit(None).cast("string")
        for i, style in enumerate(styles):
            one = F.replace(F.replace(F.replace(F.lit(style), F.lit("{k}"), F.col("key")), F.lit("{v}"), v), F.lit("{r}"), r)
            filled = F.when(F.col("line") % 3 == i, one).otherwise(filled)
        cells = F.sort_array(F.collect_list(F.struct("line", filled.alias("entry"))))
        path = F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path")
        files = df.groupBy(path).agg(F.concat(F.lit(head), F.array_join(F.transform(cells, lambda c: c["entry"]), ""), F.lit(tail)).alias("text"))
        files = materialise(files, "hand-bundles")
        none = F.lit(None).cast("string").alias("comment")
        told = df.filter("line % 3 < 2").select(path, "key", F.concat("text", F.when(F.col("line") % 3 == 0, " neu").otherwise("")).alias("value"), none)
        told = told.unionByName(files.select("path", F.lit("zz").alias("key"), F.lit("Fresh words").alias("value"), none))
        told = materialise(told, "told")  # a merge asks for it in each of its parts
        cut = patches.cut_once(files, fmt)
        new = materialise(patches.texts(patches.merge(files, told, fmt, cut)), "merged-bundles")
        back = patches.texts(patches.merge(files, told.filter("false"), fmt, cut)).withColumnRenamed("text", "back")
        read = patches.entries(new, fmt).groupBy("path").agg(
            F.count("*").alias("n"), F.md5(F.array_join(F.sort_array(F.collect_list(F.concat("key", F.lit("="), "value"))), "\n")).alias("entries_md5"))
        joined = files.withColumnRenamed("text", "old").join(back, "path").join(new, "path").join(read, "path")
        return joined.select(
            F.substring("path", F.lit(3), F.length("path")).cast("long").alias("doc_id"), (F.col("old") == F.col("back")).alias("same"),
            F.md5("text").alias("text_md5"), "n", "entries_md5")

    run.__name__ = f"bundle_merge_{fmt}"
    return query(_IDS[fmt] + ",S12,O2,P9,P10", sql)(run)


for _fmt in _HAND:
    _merge_query(_fmt)
