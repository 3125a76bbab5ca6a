"""Lossless merges: the file comes back byte for byte, values are patched in place, all notations are read."""

import os

import pytest
from hypothesis import given, settings, strategies as st

from glossweave.sources import bundles, patches

FILES = {
    "resx": '<?xml version="1.0"?>\r\n<root>\r\n  <!-- <data name="no"><value>x</value></data> </root> -->\r\n  <data name="A" xml:space="preserve">\r\n    <value>old\r\n &#8217;text</value>\r\n    <comment>keep</comment>\r\n  </data><data name="B"><value><![CDATA[a <b> & c]]></value></data>\r\n  <data name="E"><value/></data>\r\n</root>\r\n<!-- end </root> -->',
    "android": '<resources>\n    <string name="A" translatable="false">It\\\'s "old" &#8217;</string><string name="B"><![CDATA[<b>x</b>]]></string>\n    <string name="C">Hi <b>you</b></string>\n    <plurals name="p"><item quantity="one">one</item></plurals>\n</resources>\n',
    "strings": '/* "no" = "x"; */\n"A" = "x"; "B" = "z \\"q\\"";\nbare = "v"; // c "n" = "m";\nnot a line we know\n"last" = "1";',
    "i18next": '{"A": "old", "B": "b", "n": {"deep": "}", "list": [1, 2]}, "num": 3\n}\n',
    "arb": '{\r\n\t"@@locale": "en",\r\n\t"A": "o\\u00e9",\r\n\t"@A": {"description": "mine"},\r\n\t"B": "b"\r\n}',
}
VALUES = {
    "resx": {"A": "old\n ’text", "B": "a <b> & c"}, "android": {"A": 'It\'s "old" ’', "B": "<b>x</b>", "C": "Hi <b>you</b>"},
    "strings": {"A": "x", "B": 'z "q"', "bare": "v", "last": "1"}, "i18next": {"A": "old", "B": "b"}, "arb": {"@@locale": "en", "A": "oé", "B": "b"},
}


def joined(rows):
    key = lambda r: (r[1], r[2] if r[2] is not None else "\U0010ffff", r[3], r[4] or "")
    return "".join(r[6] + r[7] for r in sorted(rows, key=key))


def merged(spark, fmt, text, values):
    files = spark.createDataFrame([("d/x", text)], "path string, text string")
    told = spark.createDataFrame([("d/x", k, v, None) for k, v in values.items()], "path string, key string, value string, comment string")
    return patches.texts(patches.merge(files, told, fmt)).first().text


@pytest.mark.parametrize("fmt", sorted(FILES))
def test_values_are_read_and_nothing_is_lost(fmt):
    rows = list(patches.pieces_of("x", FILES[fmt], fmt, bundles.get(fmt).closing))
    assert joined(rows) == FILES[fmt]
    assert {r[4]: r[5] for r in rows if r[5] is not None} == ({**VALUES[fmt], "A": "It\\'s \"old\" ’"} if fmt == "android" else VALUES[fmt])


CHANGED = {
    "resx": ("<value>old\r\n &#8217;text</value>", "<value>new &lt;x&gt;</value>", '  <data name="E"><value/></data>\r\n', '  <data name="Z" xml:space="preserve"><value>more</value></data>\r\n'),
    "android": ('>It\\\'s "old" &#8217;<', ">new &lt;x&gt;<", "</plurals>\n", '    <string name="Z">more</string>\n'),
    "strings": ('"A" = "x"', '"A" = "new <x>"', '"last" = "1";', '\n"Z" = "more";\n'),
    "i18next": ('"A": "old"', '"A": "new <x>"', '"b"', ',\n"Z": "more"'),
    "arb": ('"o\\u00e9"', '"new <x>"', '"B": "b"', ',\r\n\t"Z": "more"'),
}


@pytest.mark.parametrize("fmt", sorted(FILES))
def test_only_what_is_merged_changes(spark, fmt):
    text = FILES[fmt]
    assert merged(spark, fmt, text, {}) == text
    assert merged(spark, fmt, text, {k: v for k, v in VALUES[fmt].items() if k in ("A", "B")}) == text
    old, new, after, line = CHANGED[fmt]
    assert merged(spark, fmt, text, {"A": "new <x>", "Z": "more"}) == text.replace(old, new).replace(after, after + line)


def test_character_data_sections_stay(spark):
    out = merged(spark, "android", FILES["android"], {"B": "a ]]> b & 'c'"})
    assert "<![CDATA[a ]]]]><![CDATA[> b & \\'c\\']]>" in out
    out = merged(spark, "resx", FILES["resx"], {"B": "1 < 2"})
    assert "<![CDATA[1 < 2]]>" in out


def test_members_keep_their_order(spark):
    assert merged(spark, "i18next", '{\n  "b": "1",\n  "d": "2"\n}\n', {"a": "x", "aa": "z", "c": "y", "e": "w"}) == (
        '{\n  "a": "x",\n  "aa": "z",\n  "b": "1",\n  "c": "y",\n  "d": "2",\n  "e": "w"\n}\n')
    assert merged(spark, "i18next", '{"d": "2", "b": "1"}', {"c": "y"}) == '{"d": "2", "b": "1",\n"c": "y"}'.replace("\n", "")
    assert merged(spark, "i18next", "{\n}\n", {"c": "y", "b": "1"}) == '{\n  "b": "1",\n  "c": "y"\n\n}\n'


def test_duplicates_and_nested_members(spark):
    assert merged(spark, "strings", '"A" = "1"; "A" = "2";\n', {"A": "3"}) == '"A" = "3"; "A" = "2";\n'
    assert merged(spark, "i18next", '{"n": {"x": 1}}', {"n": "no"}) == '{"n": {"x": 1}}'


def test_files_are_written_whole(spark, tmp_path):
    files = spark.createDataFrame([("d/x.strings", FILES["strings"])], "path string, text string")
    told = spark.createDataFrame([("d/x.strings", "A", "new", None), ("e/y.strings", "B", "b", None)], "path string, key string, value string, comment string")
    assert {r.path for r in patches.publish(patches.merge(files, told, "strings"), str(tmp_path)).collect()} == {"d/x.strings", "e/y.strings"}
    with open(os.path.join(tmp_path, "d/x.strings"), encoding="utf-8", newline="") as f:
        assert f.read() == FILES["strings"].replace('"A" = "x"', '"A" = "new"')
    with open(os.path.join(tmp_path, "e/y.strings"), encoding="utf-8", newline="") as f:
        assert f.read() == '"B" = "b";\n'


@settings(max_examples=150, deadline=None)
@given(fmt=st.sampled_from(sorted(FILES)), text=st.text(alphabet='ab"\\=;:,{}[]<>/!- \r\n\'&dtvlues', max_size=60), at=st.integers(0, 200))
def test_any_text_is_given_back(fmt, text, at):
    """Damaged files too: pieces always make the file."""
    whole = FILES[fmt][:at] + text + FILES[fmt][at:]
    try:
        rows = list(patches.pieces_of("x", whole, fmt, bundles.get(fmt).closing))
    except ValueError:  # a string that is none: such a file is refused before it is merged
        return
    assert joined(rows) == whole


def test_a_merge_cuts_its_files_once(spark):
    """The pieces are written when the merge is planned; before, each of its five parts cut the files anew."""
    files = spark.createDataFrame([("a", '"k" = "v";\n"k" = "w";\n"l" = "x";\n')], "path string, text string")
    told = spark.createDataFrame([("a", "k", "new", None), ("a", "m", "more", None)], "path string, key string, value string, comment string")
    merged = patches.merge(files, told, "strings")
    assert "MapInArrow" not in merged._jdf.queryExecution().optimizedPlan().toString()
    assert patches.texts(merged).first().text == '"k" = "new";\n"k" = "w";\n"l" = "x";\n"m" = "more";\n'


@pytest.mark.parametrize("text", ['{"A":  , "B": "b"}', '{"A":  }', '{"A":  ', '{"A": \t]'])
def test_a_missing_value_repeats_nothing(text):
    assert joined(list(patches.pieces_of("x", text, "arb", None))) == text
