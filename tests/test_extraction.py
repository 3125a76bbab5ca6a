"""Extraction per language on small sources; spans are read back from the text."""

from pyspark.sql import functions as F

from glossweave.operators import code, markup, scan, setup

SOURCES = {
    ("swift", "a.swift"): ('Text("Hello there")\nlet a = "Not shown"\nText("Hi \\(name) there")\nImage(systemName: "Star icon")\nb.title = "My title"\n/* Text("No way") */\nlet u = #"Raw "text" here"#\nText("Last one")', ["Hello there", "My title", "Last one"]),
    ("objc", "a.m"): ('[b setTitle:@"Save file" forState:0];\nNSLog(@"Log line");\nx.text = @"Some text";\nNSLocalizedString(@"Done thing", nil);', ["Save file", "Some text"]),
    ("dart", "a.dart"): ("Text('Hello world'),\nText('Two ' 'parts here'),\nText('Hi $name there'),\nKey('My key'),\nTextField(hintText: \"Your name\")", ["Hello world", "Two parts here", "Your name"]),
    ("android", "a.kt"): ('view.setText("Hello you")\nToast.makeText(this, "Saved now", 1)\nLog.d("Tag", "Debug text")\n@Named("Some name") val x = 1\nRow(label = "A label")', ["Hello you", "Saved now", "A label"]),
    ("script", "a.ts"): ("alert('Hello you');\nt('Known key');\ntoast.success(`All done`);\nalert(`Hi ${name} there`);\nconst a = 'Not copy';\nalert('It\\'s escaped');", ["Hello you", "All done"]),
    ("csharp", "a.cs"): ('var a = "Hello you"; // "Comment text"\nif (x == "Other text") {}\nvar p = @"C:\\dir\\Verbatim text";\nvar s = $"Hi {name} there";\nswitch (x) { case "Case text": break; }\nx.StartsWith("Start text");\nnameof("Some name");\n_log.LogError("Log text");\nthrow new Exception("Bad thing");', ["Hello you", "C:\\dir\\Verbatim text", "Hi {0} there"]),
}


def test_code(spark):
    for (dialect, path), (text, expected) in SOURCES.items():
        df = spark.createDataFrame([(path, text)], "path string, content string")
        rows = sorted(code.candidates(df, ["path"], "content", dialect).collect(), key=lambda r: r.span_start)
        assert [r.text for r in rows] == expected, dialect
        for r in rows:
            assert text[r.span_start : r.span_start + r.span_length] == r.raw
            assert text[: r.span_start].count("\n") + 1 == r.line


MARKUP = {
    "html": ('<p title="A title">Some text</p>\n<!-- <p>Old text</p> --><script>var a = "<p>No text</p>";</script><p>Price &amp; tax {x}</p><b>Two words</b>', ["A title", "Some text", "Two words"]),
    "jsx": ('const A = () => (\n<div title="A title" onClick={go}>Some text <b>Bold text</b>{name}</div>\n);\nconst b = 1;\n', ["A title", "Some text", "Bold text"]),
    "xaml": ('<Grid><TextBlock Text="Some text" x:Name="Own name"/><Button Content="{Binding X}">Press me</Button></Grid>', ["Some text", "Press me"]),
    "razor": ("<p>Hello there</p><p>Hi @Model.Name</p><input placeholder='Your name' title='@T'/>", ["Hello there", "Your name"]),
    "android_layout": ('<T android:text="Some text" tools:text="Fake text" android:hint="@string/x" />', ["Some text"]),
    "interface_builder": ('<button title="Press me" customClass="My Class"/><label text="Some text"/>', ["Press me", "Some text"]),
    "vue": ('<div :title="bound" title="A title" v-if="Some cond"><span>Some text</span></div>', ["A title", "Some text"]),
}


def test_markup(spark):
    for dialect, (text, expected) in MARKUP.items():
        df = spark.createDataFrame([("a", text)], "path string, content string")
        rows = sorted(markup.candidates(df, ["path"], "content", dialect).collect(), key=lambda r: r.span_start)
        assert [r.text for r in rows] == expected, dialect
        for r in rows:
            assert text[r.span_start : r.span_start + r.span_length] == r.raw


def test_vue_file_has_two_live_parts(spark):
    text = '<template>\n<p>Some text</p>\n</template>\n<script>\nalert("Hello you");\nconst a = "<p>No text</p>";\n</script>'
    df = spark.createDataFrame([("a.vue", text)], "path string, text string")
    rows = scan.with_ids(scan.candidates(df, "web")).orderBy("id").collect()
    assert [(r.text, r.line) for r in rows] == [("Some text", 2), ("Hello you", 5)]


def test_every_scan_has_a_dialect():
    for _, _, family, dialect, _ in scan.SCANS:
        assert dialect in (code.DIALECTS if family == "code" else markup.DIALECTS)
    assert {s for s, *_ in scan.SCANS} == {c[0] for c in setup.CHECKS}


def test_edits(spark):
    files = spark.createDataFrame([("a.txt", "one two two"), ("b.txt", "x\r\ny\r\n")], "path string, content string")
    edits = spark.createDataFrame(
        [("s1", 0, "a.txt", "replace", "one", "1"), ("s2", 0, "a.txt", "replace", "two", "2"), ("s3", 0, "../a.txt", "create", "", "x"), ("s4", 0, "c.txt", "replace", "a", "b"), ("s5", 0, "B.txt", "replace", "x\n", "z\n"), ("s1", 1, "new.txt", "create", "", "n")],
        "step string, ord long, file string, kind string, anchor string, content string")
    checked = setup.validate(edits, files)
    assert {(r.step, r.ord): r.refusal for r in checked.collect()} == {
        ("s1", 0): None, ("s1", 1): None, ("s2", 0): "anchor ambiguous", ("s3", 0): "outside project", ("s4", 0): "not offered", ("s5", 0): None}
    assert {r.step for r in setup.accepted_steps(checked).filter("accepted").collect()} == {"s1", "s5"}
    new = files.filter("path = 'b.txt'").select(setup.apply_one(F.col("content"), F.lit("replace"), F.lit("x\n"), F.lit("z\n"))).first()[0]
    assert new == "z\r\ny\r\n"


def test_token_positions_are_summed_by_batch(spark):
    """Positions of every row of a batch in one go; nulls, rows without tokens and repeated rows keep their own."""
    import pyarrow as pa
    from glossweave.operators import spans

    lists = pa.array([[9], [3, 1, 2], None, [], [5], [1, 1]], pa.list_(pa.int32())).slice(1)
    assert spans._sums_before.func(lists).to_pylist() == [[0, 3, 4], None, [], [0], [0, 1]]
