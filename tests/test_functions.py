"""Scalar functions on literal rows."""

import pytest
from pyspark.sql import functions as F

from glossweave.functions import escapes, keys, locales, noise, paths, text as tx
from glossweave.operators import code
from glossweave.operators.rewrite import ensure_import


def column(spark, values, fn, schema="v string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(fn(F.col("v")).alias("o")).collect()]


@pytest.fixture(scope="module")
def noise_of(spark):
    return lambda values: column(spark, values, noise.is_noise)


def test_noise_drops(noise_of):
    drop = [
        "", " a ", "12 + 34", "日本語", "https://example.org/a b", "mailto:a@b.org", "./src/app", "C:\\temp\\a.txt", "{1b4e28ba-2fa1-11d2-883f-0016d3cca427}",
        "#ffcc00", "application/json; charset=utf-8", "SELECT id FROM users", "update t set a = 1", "yyyy-MM-dd HH:mm", "MAX_RETRY_COUNT", "user.name", "kebab-case-name", "abc",
    ]
    assert noise_of(drop) == [True] * len(drop)


def test_noise_keeps(noise_of):
    keep = [
        "Save", "Save changes?", "Select a file to open", "Update your profile", "Hello {0}", "File: not found", "OK now", "Delete the item", "Über uns", "OK: done",
    ]
    assert noise_of(keep) == [False] * len(keep)


def test_noise_letter_run_is_optional(spark):
    assert column(spark, ["日本語"], lambda c: noise.is_noise(c, r"\p{L}{2}")) == [False]


def test_keys(spark):
    assert column(spark, ["Save your changes now please or later on", "2 items left", "Don't go!", "...", "Culture"], keys.base_key) == [
        "SaveYourChangesNowPleaseOr", "N2ItemsLeft", "DonTGo", "Text", "CultureText"]
    assert column(spark, ["a-b c", "1st", "", "Save.Title"], keys.sanitize_key) == ["ABC", "N1st", "", "SaveTitle"]
    assert column(spark, ["SaveYourHTMLFile", "class", "K2Items", "New"], keys.lower_snake) == ["save_your_html_file", "class_text", "k2_items", "new_text"]
    assert column(spark, ["Größe", "ÄndereDatei"], keys.lower_snake) == ["größe", "ändere_datei"]
    assert column(spark, ["SAVE CHANGES", "don't stop", "2 files", "one two three four five six seven", "...", "iPhone app"], keys.key_from_text) == [
        "SaveChanges", "DonTStop", "N2Files", "OneTwoThreeFourFiveSix", "", "IphoneApp"]
    assert column(spark, ["Get", "Manager", "Gets"], keys.legal_member) == [False, False, True]
    assert column(spark, ["Get", "Gets"], keys.reserve) == ["GetText", "Gets"]
    assert column(spark, ["SaveFile", "URLPath", "OK", "already"], keys.lower_camel) == ["saveFile", "urlPath", "ok", "already"]


def test_locales(spark):
    assert column(spark, ["de", "pt-BR", "zh-hans-cn", "es-419", None], locales.android_qualifier) == [
        "values-de", "values-pt-rBR", "values-b+zh+Hans+CN", "values-b+es+419", "values"]
    assert column(spark, ["PT_br", "zh-hant-tw"], locales.arb_locale) == ["pt_BR", "zh_Hant_TW"]


def test_escapes_round_trip(spark):
    values = ['a "b" \'c\' \\n d', "@home", "?x", "line\nbreak\tand\\\\", " padded ", "😀 ü & <b>", "two  blanks"]
    assert column(spark, values, lambda c: escapes.unescape_android(escapes.escape_android(c))) == values
    assert column(spark, values, lambda c: escapes.unescape_apple(escapes.escape_apple(c))) == values
    assert column(spark, values, lambda c: escapes.unescape_xml(escapes.escape_xml(c))) == values
    assert column(spark, ["\\uD83D\\uDE00 \\u00e9\\n"], escapes.unescape_code) == ["😀 é\n"]


def test_placeholders(spark):
    df = spark.createDataFrame([("{0} of %d", "%d von {0}"), ("{name}", "{Name}"), ("a:b", "c"), ("x :id", "y :id"), ("${a} {{b}}", "{{b}} ${a}")], "a string, b string")
    assert [r[0] for r in df.select(tx.same_placeholders(F.col("a"), F.col("b"))).collect()] == [True, False, True, True, True]
    assert column(spark, ["%s %s", "%1$s %2$s", "100%% %d"], tx.many_unnumbered_arguments) == [True, False, False]


def test_mask_keeps_length_and_lines(spark):
    html = "<p>a</p><!-- x\ny --><script>let a = '<p>';</script><b>c</b>"
    masked = column(spark, [html], lambda c: tx.mask(c, r"(?is)<!--.*?-->|<script[ >].*?</script>"))[0]
    assert len(masked) == len(html) and masked.count("\n") == 1 and "let" not in masked and masked.endswith("<b>c</b>")


def test_format_string(spark):
    assert column(spark, ["Hi {name}, {{x}} {n + 1}"], code.format_string) == ["Hi {0}, {{x}} {1}"]
    assert column(spark, ["Hi {name}", "{n:N0}", "{a,5}"], code.format_arguments) == [["name"], None, None]


def test_paths(spark):
    assert column(spark, ["src/a.cs", "node_modules/x/a.js", "A.Designer.cs", "bin", "Obj/a.cs"], paths.excluded_by) == [
        None, "skip_segment", "generated_name", None, "skip_segment"]


def test_ensure_import(spark):
    fn = lambda c: ensure_import(c, F.lit("using A;"), r"^using [A-Z]", r"^//")
    assert column(spark, ["using B;\r\nclass X {}\r\n", "// c\nclass X {}\n", "using A;\n", "class X {}"], fn) == [
        "using B;\r\nusing A;\r\nclass X {}\r\n", "// c\nusing A;\nclass X {}\n", "using A;\n", "using A;\nclass X {}"]
