"""The bracket tree on sources without Spark: positions, scopes, comments, and work that stays in proportion."""

import time

import pytest

from glossweave.operators.code import DIALECTS


def read(dialect, source):
    out = list(DIALECTS[dialect].compiled().read(source))
    for h in out:
        assert source[h["start"]:h["start"] + h["length"]] == h["raw"]
        assert source[:h["start"]].count("\n") + 1 == h["line"]
    return out


def kinds(dialect, source):
    return {h["inner"]: h["kind"] for h in read(dialect, source)}


@pytest.mark.parametrize("dialect,source,want", [
    ("swift", '/* a /* b */ Text("Hidden copy") */ Text("Shown copy")', {"Shown copy": "UiCall"}),
    ("swift", 'Text(a ? b ? "One" : "Two" : "Three"); show(title: x, "No title")', {"One": "UiCall", "Two": "UiCall", "Three": "UiCall"}),
    ("swift", 'let d = ["key": "value"]\nlabel.text = "Target"\nTextual("No call")\nfoo("a").help("Chained")', {"Target": "Assignment", "Chained": "UiCall"}),
    ("android", '/* x /* y */ setText("Hidden") */ v.setText("Shown")\n@Named("Bean") val a = 1\nif (a) Log.d(TAG, f(g("Deep")))', {"Shown": "UiCall", "Deep": "Diagnostic"}),
    ("android", 'Toast.makeText(getString("Key"), "Message", 1)\nToast.makeText("First", x)', {"Message": "UiSecondArgument"}),
    ("csharp", '/* not nested /* */ var a = "Open"; /* "Closed" */ var b = "x /* y */ z";', {"Open": "CodeLiteral", "x /* y */ z": "CodeLiteral"}),
    ("csharp", 'throw Make(\n  f("Thrown"));\nvar s = "After"; d["index"] = L["Key"]; [Display(Name = "Shown name")] [Route("a/b")] int x;',
     {"Thrown": "Diagnostic", "After": "CodeLiteral", "index": "CodeLiteral", "Shown name": "Attribute"}),
    ("objc", '[a setTitle:/* why */@"Button" forState:0]; NSLog(@"%d", f(@"Log")); x = @"Plain";', {"Button": "UiCall", "%d": "Diagnostic"}),
    ("script", 'alert(`Whole`); alert("Escaped \\n"); toast.error(a || "Kept"); toast.error("Sure"); t("key")', {"Whole": "UiCall", "Sure": "UiCall"}),
    ("dart", "Text(r'raw \\d'); Text('it\\'s'); TextField(hintText: // why\n 'Hint'); print(f(x), 'Log')", {"it\\'s": "UiCall", "Hint": "NamedArgument", "Log": "Diagnostic"}),
])
def test_positions(dialect, source, want):
    assert kinds(dialect, source) == want


def test_adjacent_literals_are_one_candidate():
    source = "Text('One ' /* not 'this' */ \"two \" // nor 'that'\n  'three', 'x y')"
    found = read("dart", source)
    assert [h["inner"] for h in found] == ["One two three", "x y"]
    assert found[0]["raw"].startswith("'One '") and found[0]["raw"].endswith("'three'")
    assert [h["inner"] for h in read("dart", "Text('a b' '$c')")] == []  # one part is no plain literal
    assert [h["inner"] for h in read("dart", "Text('a b' + 'c d')")] == ["a b", "c d"]


@pytest.mark.parametrize("source,want", [
    ('Widget build(BuildContext context) { return Text("A a"); } final x = Text("B b");', [None, "no"]),
    ('Widget build(BuildContext context) { f() { return Text("A a"); } if (x) { Text("B b"); } }', [None, None]),
    ('Widget build(BuildContext context) =>\n  Row(children: [Text("A a")]);\nvar y = Text("B b");', [None, "no"]),
    ('void init(Context context) { Text("A a"); } b(BuildContextual context) { Text("B b"); }', ["no", "no"]),
    ('Widget build(BuildContext context)\n{\n  return Text("A a");\n}\nText("B b");', [None, "no"]),
    ('Widget a(BuildContext context) async { Text("A a"); }}} Text("B b");', [None, "no"]),
    ('list(builder: (BuildContext context) => Text("A a"), other: Text("B b"))', [None, "no"]),
    ('const a = Text("A a"); Widget build(BuildContext context) { const Text("B b"); }', ["const", "const"]),
])
def test_build_scopes(source, want):
    names = {None: None, "no": "no build context in scope", "const": "const scope"}
    assert [h["reason"] for h in read("dart", source)] == [names[w] for w in want]


def test_unclosed_and_odd_sources():
    for dialect in DIALECTS:
        for source in ("", "\n", '"', "'", "/*", "((([[{{", ")]}", '"a b', "/* /* */", '@"', "$", "#\"", "\\", "f(\"x y\"", " é\n\"w w\""):
            read(dialect, source)


@pytest.mark.parametrize("source", [
    "f(" + ", ".join(f'"Text number {i}"' for i in range(100000)) + ");",
    "f(" + " + ".join(f'"Text number {i}"' for i in range(100000)) + ");",
    "f(" * 50000 + '"Deep text"' + ")" * 50000 + ";",
    "{" * 50000 + 'f("Deep text");' + "}" * 50000,
    "/*" * 100000 + '"x y"' + "*/" * 100000,
])
def test_work_grows_with_the_file_alone(source):
    start = time.process_time()
    n = sum(1 for _ in DIALECTS["csharp"].compiled().read(source)) + sum(1 for _ in DIALECTS["dart"].compiled().read(source))
    assert time.process_time() - start < 30 and n >= 0


def test_context_and_member():
    found = read("csharp", "x.Go();\nvar total = Make(1,\n   \"For all users\", 2); Next();")
    assert found[0]["context"].strip() == 'var total = Make(1,\n   "For all users", 2);' and found[0]["member"] == "Make"
    found = read("swift", "a" * 100 + '; b.title = "My title"' + "c" * 100)
    assert len(found[0]["context"]) == 70 + 10 + 70 and found[0]["member"] == "b.title"


def test_gaps_that_recur_are_looked_at_once():
    class Counted:
        def __init__(self, pattern):
            self.pattern, self.calls = pattern, 0

        def search(self, gap):
            self.calls += 1
            return self.pattern.search(gap)

    reader = DIALECTS["dart"].compiled()
    reader.scope = scope = Counted(reader.scope)
    one = 'Widget w(BuildContext context) { return const B(a ? b : c, label: Text("Save all")); }\nfinal t = Text("Open $it", "Open it");\n'
    found = [(h["line"], h["inner"], h["reason"]) for h in reader.read(one * 200)]
    assert found[:2] == [(1, "Save all", "const scope"), (2, "Open it", "no build context in scope")] and len(found) == 400
    assert scope.calls < 40
