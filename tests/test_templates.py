"""The readers of JSX and Razor on sources without Spark, and what extraction makes of them."""

import time

import pytest

from glossweave.operators import markup, templates


def cut(dialect, source):
    tokens = templates.READERS[dialect](source)
    assert "".join(source[a:b] for _, a, b in tokens) == source
    return [(kind, source[a:b]) for kind, a, b in tokens]


def texts(dialect, source):
    return [t for kind, t in cut(dialect, source) if kind == "text" and t.strip()]


@pytest.mark.parametrize("source,want", [
    ("@code { List<string> items = new List<string>(); int Count; }", []),
    ("@{ var a = \"}\"; var b = '}'; var c = @\"}\"\"}\"; /* } */ // }\n { { } } }<p>After</p>", ["After"]),
    ("@if (a) { <p>Yes</p> } else if (b < c) { <p>Maybe</p> } else { <p>No</p> }<i>End</i>", ["Yes", "Maybe", "No", "End"]),
    ("@switch (a) { case 1: break; default: { <p>One</p> break; } }", ["One"]),
    ("@do { <p>Again</p> } while (a < b); <i>End</i>", ["Again", " while (a < b); ", "End"]),
    ("@section Side { <p>Aside</p> }", ["Aside", " }"]),
    ("<p>@Html.Raw(\"<b>no</b>\") x</p><p>me@site.org</p><p>@@home</p>", ['@Html.Raw("<b>no</b>") x', "me@site.org", "@@home"]),
    ("@using System.Linq\n@using (Html.BeginForm()) { <label>Name</label> }", ["Name"]),
    ("@{ RenderFragment f = @<p>Inner</p>; }<p>Outer</p>", ["Outer"]),
    ("<script>if (a < b) { \"<p>x</p>\" }</script><style>p > b { }</style><p>Seen</p>", ["Seen"]),
    ("@for (int i = 0; i < 3; i++) { <br> <input value=\"@(i > 1 ? \"a\" : \"b\")\"> <p>In</p> @:line text\n }", ["In", "line text"]),
])
def test_razor(source, want):
    assert texts("razor", source) == want


@pytest.mark.parametrize("source,want", [
    ("const a = <Button onClick={() => go({a: {b: {c: {d: 1}}}})} title=\"Save all\">Click here</Button>;", ["Click here"]),
    ("if (a < b) { c = d > e; } const f = x as Array<string>; g<T>(h);", []),
    ("return cond ? <p>One</p> : <p>Two</p>", ["One", "Two"]),
    ("x = `${<b>In template</b>}`; y = <p>{`<i>${z}</i>`}Text</p>", ["Text"]),
    ("const e = <><p>A</p>{list.map(x => <li>{x.y}<b>B</b></li>)}</>", ["A", "B"]),
    ("const e = <Trans>hidden <Trans>more</Trans> words</Trans>; const f = <p>Shown</p>", ["Shown"]),
    ("/* <p>c</p> */ // <p>d</p>\nconst s = '<p>s</p>', r = /<p>/g; const e = <br/>; export default <p>E</p>", ["E"]),
    ("const f = <T,>(x: T) => x; const g = <K extends B>(x: K) => x; const e = <p>E</p>", ["E"]),
    ("const e = <p title=\"a > b\" {...rest}>don't stop</p>; const s = 'x';", ["don't stop"]),
])
def test_jsx(source, want):
    assert texts("jsx", source) == want


@pytest.mark.parametrize("dialect", ["jsx", "razor"])
def test_odd_sources_are_covered(dialect):
    for source in ("", "<", "<>", "</", "<a", "<a b='", "@", "@{", "@(", "@if", "@if (", "@code", "{", "}", "`", "`${", "a = <p>", "<p>{", "<Trans>", "x = <Trans", "'", '"', "@*", "<!--", "<script>"):
        cut(dialect, source)


@pytest.mark.parametrize("dialect,source", [
    ("jsx", "x = <a b={" + "{" * 50000 + "}" * 50000 + "}>Text</a>"),
    ("jsx", "x = " + "<a>{" * 20000 + "y" + "}</a>" * 20000),
    ("jsx", "x = <p>" + "<b>Some words</b>" * 50000 + "</p>"),
    ("razor", "@if (a) { " + "if (b) { <p>" * 20000 + "T" + "</p> }" * 20000 + " }"),
    ("razor", "<p>Some @words here</p>" * 50000),
])
def test_work_grows_with_the_file_alone(dialect, source):
    start = time.process_time()
    cut(dialect, source)
    assert time.process_time() - start < 20


def test_candidates_have_exact_spans_and_whole_windows(spark):
    source = 'const A = () => (\n' + "<i/>" * 30 + '<Button go={() => f({a: {b: {c: {d: 1}}}})} title="Save all">Click &amp; go</Button>);\n' + "y();" * 30
    found = markup.candidates(spark.createDataFrame([(1, source)], "id long, content string"), ["id"], "content", "jsx").collect()
    assert {r.text for r in found} == {"Save all", "Click & go"}
    assert all(source[r.span_start:r.span_start + r.span_length] == r.raw for r in found)
    at = source.index("Click")
    assert next(r.context for r in found if r.phase == 1) == source[at - 60:at + 14 + 60].replace("\n", " ").strip()
