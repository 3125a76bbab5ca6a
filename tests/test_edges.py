"""Cases that tables do not hold: values with angle brackets, deep folders, blank lines, comments that name tags."""

import pytest

from glossweave.operators import detect, markup, setup
from glossweave.sources import bundles


@pytest.mark.parametrize("dialect,source,want", [
    ("jsx", '<Button onClick={() => go({a: {b: 1}})} title="Save all">Click here</Button>', {"Save all", "Click here"}),
    ("vue", '<div v-if="a > b" title="Shown title">Body text</div>', {"Shown title", "Body text"}),
    ("html", "<p title='Is a > b?'>First words</p><a href=x=y>Second words</a>", {"Is a > b?", "First words", "Second words"}),
    ("html", '<p title="never closed>Some text here</p>', {"Some text here"}),
])
def test_values_may_hold_angle_brackets(spark, dialect, source, want):
    found = markup.candidates(spark.createDataFrame([(1, source)], "id long, content string"), ["id"], "content", dialect).collect()
    assert {r.text for r in found} == want
    assert all(source[r.span_start:r.span_start + r.span_length] == r.raw for r in found)


def test_long_tags_do_not_recurse(spark):
    source = "<p " + " ".join(f'a{i}="{i} > 0"' for i in range(20000)) + ">Short words</p>"
    found = markup.candidates(spark.createDataFrame([(1, source)], "id long, content string"), ["id"], "content", "html").collect()
    assert [r.text for r in found] == ["Short words"]


def test_modules_are_found_from_any_depth(spark):
    deep = "/".join(f"d{i}" for i in range(40))
    files = spark.createDataFrame([("p", f"m/{deep}/a.kt"), ("p", "top.kt"), ("p", "m/b.kt"), ("q", "m/b.kt"), ("p", "x/y/c.kt")], "project string, path string")
    modules = spark.createDataFrame([("p", "m"), ("p", ""), ("p", f"m/{deep}")], "project string, dir string")
    got = {(r.project, r.path): r.module for r in detect.nearest_module(files, modules).collect()}
    assert got == {("p", f"m/{deep}/a.kt"): f"m/{deep}", ("p", "top.kt"): "", ("p", "m/b.kt"): "m", ("q", "m/b.kt"): None, ("p", "x/y/c.kt"): ""}


def test_merging_keeps_blank_lines_and_finds_the_closing_tag(spark):
    text = '<resources>\n    <!-- not </resources> yet -->\n    <string name="a">One</string>\n\n    <string name="b">Two</string>\n</resources>\n<!-- end </resources> of file -->\n'
    files = spark.createDataFrame([("f.xml", text)], "path string, text string")
    incoming = spark.createDataFrame([("f.xml", "c", "Three", None)], "path string, key string, value string, comment string")
    lines = bundles.merge_lines(files, incoming, "android").collect()
    merged = "\n".join(r.line for r in sorted(lines, key=lambda r: (r.section, r.pos, r.key or "")))
    assert [k for k in ("One", "Two", "Three") if k in merged] == ["One", "Two", "Three"]
    assert merged.index("Three") < merged.index("</resources>\n<!-- end") and "</string>\n\n" in merged
    assert merged.rstrip().endswith("<!-- end </resources> of file -->") and merged.count("</resources>") == 3


def test_malformed_bundles_are_all_listed(spark):
    files = spark.createDataFrame([(f"{i}.json", "{") for i in range(7)], "path string, text string")
    with pytest.raises(bundles.MalformedBundle, match=r"0\.json and 6 more, all listed in"):
        bundles.refuse_malformed(files, "i18next")


def test_files_that_differ_in_case_give_one_refusal_each(spark):
    edits = spark.createDataFrame([("s", 1, "app/Info.txt", "replace", "one", "x"), ("s", 2, "APP/info.txt", "append", None, "y")], "step string, ord int, file string, kind string, anchor string, content string")
    files = spark.createDataFrame([("app/info.txt", "two"), ("app/Info.txt", "one")], "path string, content string")
    got = setup.validate(edits, files).collect()
    assert sorted((r.ord, r.refusal) for r in got) == [(1, None), (2, None)]


@pytest.mark.parametrize("dialect,source,want", [
    ("android", '@Named(text = "Account name")\nLog.d(TAG, "v", title = "Order id")\nRow(label = "Kept words")', {"Kept words"}),
    ("csharp", 'Log.LogInformation("First part " + x + "Second part"); throw new BadException("Bad thing " + y + " happened here"); if (a == (flag ? "Left one" : "Right one")) return; Assert.Fail("Not for users"); var s = Make(x, "For all users");', {"For all users"}),
    ("swift", '.alert(isPresented: $x, "Really delete")\nText(flag ? "Turn on" : "Turn off")\nprint(a, label: "More words")\nlet b = "Plain words"', {"Really delete", "Turn on", "Turn off"}),
    ("swift", "Text(\n" + "    // long remark\n" * 400 + '"Far away words")', {"Far away words"}),
])
def test_context_reaches_through_open_brackets(spark, dialect, source, want):
    from glossweave.operators import code

    found = code.candidates(spark.createDataFrame([(1, source)], "id long, content string"), ["id"], "content", dialect).collect()
    assert {r.text for r in found} == want


def test_const_scope_reaches_all_children(spark):
    from glossweave.operators import code

    source = 'Widget build(BuildContext context) {\nreturn const Column(children: [Text("Alpha one"), Text("Beta two")]);\nText("Gamma three");\n}'
    found = code.candidates(spark.createDataFrame([(1, source)], "id long, content string"), ["id"], "content", "dart").collect()
    assert {r.text: r.blocked_reason for r in found} == {"Alpha one": "const scope", "Beta two": "const scope", "Gamma three": None}


def test_setup_steps_apply_only_where_their_files_are(spark):
    files = spark.createDataFrame([
        ("a", "app/build.gradle", "android { }"), ("b", "app/build.gradle", 'resConfigs "en", "pt", "de-rAT"'), ("c", "X.xcodeproj/project.pbxproj", "x.strings")],
        "project string, path string, content string")
    steps = setup.findings(files, ["de", "pt-BR"])
    got = {(r.project, r.step): r.satisfied for r in steps.collect()}
    assert got["a", "locale filter"] is None and got["b", "locale filter"] is True
    assert got["c", "project reference"] is True and got["c", "default localization"] is None
    assert {r.step: r.satisfied for r in setup.findings(files, ["fr"]).filter("project = 'b'").collect()}["locale filter"] is False
    gates = {(r.project, r.stack): r.blocked for r in setup.gate(steps, ["project", "stack"]).collect()}
    assert gates["a", "android"] is False and gates["c", "apple"] is False
