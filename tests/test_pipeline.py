"""Several runs over small projects, one per stack, as a user would make them."""

import os
import sys

import pytest
from pyspark import cloudpickle

from glossweave.operators.provider import Provider, RuleProvider
from glossweave.options import RunOptions, merge_config
from glossweave.pipeline import EveryRequestFailed, run
from glossweave.sources import bundles

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CS = """using System;

public class Orders
{
    const string Table = "orders_table";
    public void Save(string name)
    {
        if (name == "Admin user") return;
        _logger.LogInformation("Saving the order now");
        Show("Order saved.");
        Show($"Hello {name}, you have {Count} orders");
        Show("Order saved.");
        Get("SELECT id FROM orders WHERE id = 1");
        // Show("Not this one");
    }
}
"""


def project(tmp_path, files):
    for path, text in files.items():
        full = tmp_path / path
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(tmp_path)


def dotnet(tmp_path, **more):
    return project(tmp_path, {"App.csproj": "<Project><PropertyGroup></PropertyGroup></Project>", "Orders.cs": CS, **more})


def options(root, **more):
    return RunOptions(project=root, languages=("de", "fr"), **more)


class Failing(Provider):
    def classify(self, batch):
        raise ConnectionError("no route")

    translate = classify


class Dropping(RuleProvider):
    """Loses every placeholder."""

    def translate(self, batch, lang):
        return [{"id": r["id"], "translation": f"[{lang}] x", "note": None} for r in batch]


def read(spark, root, path, fmt):
    text = open(os.path.join(root, path), encoding="utf-8").read()
    df = spark.createDataFrame([(path, text)], "path string, text string")
    return {r.key: r.value for r in bundles.entries(df, fmt).collect()}


def test_runs_of_one_project(spark, tmp_path):
    root = dotnet(tmp_path)
    first = run(spark, options(root))
    texts = {r.text for r in first.verdicts.filter("label = 'localized'").collect()}
    assert texts == {"Order saved.", "Hello {0}, you have {1} orders"}
    source = read(spark, root, "Resources/Strings.resx", "resx")
    assert source == {"OrderSaved": "Order saved.", "Hello0YouHave1Orders": "Hello {0}, you have {1} orders"}
    assert read(spark, root, "Resources/Strings.de.resx", "resx")["OrderSaved"] == "[de] Order saved."
    assert first.asked > 0

    report = open(os.path.join(root, ".glossweave/report.md"), encoding="utf-8").read()
    assert report.startswith("# Localization run\n") and report.index("## Set-up") < report.index("## Coverage") < report.index("## Entries") < report.index("## Left out")
    assert "| Orders.cs | 10 | OrderSaved | Order saved. | [de] Order saved. | [fr] Order saved. |" in report
    accessor = open(os.path.join(root, "Resources/Strings.Designer.cs"), encoding="utf-8").read()
    assert 'public static string OrderSaved => Get("OrderSaved");' in accessor and accessor.endswith("    }\n}\n")

    again = run(spark, options(root))
    assert again.asked == 0
    assert {r.lang: (r.already, r.total) for r in again.outcomes.collect()} == {"de": (2, 2), "fr": (2, 2)}

    # a hand edit survives even a forced run, and a new string is filled in
    de = os.path.join(root, "Resources/Strings.de.resx")
    text = open(de, encoding="utf-8").read().replace("[de] Order saved.", "Bestellung gespeichert.")
    open(de, "w", encoding="utf-8").write(text)
    extra = CS.replace('Show("Order saved.");', 'Show("Order saved.");\n        Show("Thank You");', 1)
    open(os.path.join(root, "Orders.cs"), "w").write(extra)
    third = run(spark, options(root, retranslate=True))
    out = {r.lang: r for r in third.outcomes.collect()}
    assert out["de"].human_edited == 1 and out["de"].sent_forced == 2 and out["fr"].sent_forced == 3
    assert read(spark, root, "Resources/Strings.de.resx", "resx")["OrderSaved"] == "Bestellung gespeichert."
    assert read(spark, root, "Resources/Strings.de.resx", "resx")["ThankYou"] == "[de] Thank You"


def test_apply_rewrites_and_keeps_a_copy(spark, tmp_path):
    root = dotnet(tmp_path)
    bom = b"\xef\xbb\xbf" + CS.replace("\n", "\r\n").encode()
    open(os.path.join(root, "Orders.cs"), "wb").write(bom)
    result = run(spark, options(root, apply=True))
    assert result.rewritten["replacements"] == 3 and not result.refused_rewrite
    new = open(os.path.join(root, "Orders.cs"), "rb").read()
    assert new.startswith(b"\xef\xbb\xbf") and b'Show(L["OrderSaved"]);\r\n' in new
    assert b'string.Format(L["Hello0YouHave1Orders"], name, Count)' in new
    assert new.count(b"using App.Resources;\r\n") == 1 and b'"Admin user"' in new and b'// Show("Not this one");' in new
    assert open(os.path.join(root, "Orders.cs.bak"), "rb").read() == bom
    twice = run(spark, options(root, apply=True))
    assert twice.rewritten["replacements"] == 0


def test_scan_only_writes_nothing(spark, tmp_path):
    root = dotnet(tmp_path, **{"bad.cs": b'x("Broken \xff text");', "obj/Gen.cs": 'a("Generated text here");'})
    result = run(spark, options(root, scan_only=True))
    assert {r.path for r in result.candidates.collect()} == {"Orders.cs"}
    assert [r.id for r in result.candidates.orderBy("id").collect()] == [0, 1, 2]
    assert not os.path.exists(os.path.join(root, "Resources"))


def test_failures(spark, tmp_path):
    root = dotnet(tmp_path)
    with pytest.raises(EveryRequestFailed, match="no route"):
        run(spark, options(root), Failing())
    lost = run(spark, options(root), Dropping())
    assert {r.key for r in lost.final.filter("lang = 'de' and value is not null").collect()} == {"OrderSaved"}
    open(os.path.join(root, "Resources/Strings.resx"), "w").write("<root><data name=")
    with pytest.raises(bundles.MalformedBundle):
        run(spark, options(root))
    assert open(os.path.join(root, "Resources/Strings.resx")).read() == "<root><data name="


def test_blocked_setup_refuses_then_fixes(spark, tmp_path):
    root = project(tmp_path, {
        "package.json": '{"name": "a", "dependencies": {"react": "^18.0.0"}}', "src/main.js": 'import "./i18n";\nalert("Welcome back");\n',
        "src/App.jsx": 'export const A = () => (\n  <div title="Main page">Hello there</div>\n);\n', "src/App.test.jsx": 'alert("Test text");',
    })
    first = run(spark, options(root, apply=True))
    assert first.refused_rewrite and 'alert("Welcome back")' in open(os.path.join(root, "src/main.js")).read()
    assert read(spark, root, "src/locales/de/Strings.json", "i18next") == {
        "MainPage": "[de] Main page", "HelloThere": "[de] Hello there", "WelcomeBack": "[de] Welcome back"}
    assert os.path.exists(os.path.join(root, "src/i18n.js"))
    second = run(spark, options(root, apply=True, apply_setup=True))
    assert second.fixed == ["package.json"] and not second.refused_rewrite
    assert '"i18next": "^23.0.0", "react"' in open(os.path.join(root, "package.json")).read()
    app = open(os.path.join(root, "src/App.jsx")).read()
    assert '<div title={t("MainPage")}>{t("HelloThere")}</div>' in app and app.startswith('import { t } from "./i18n";\n')


def test_options():
    o = merge_config({"project": "a", "languages": ["de"], "batch_size": 10}, {"languages": ["DE", "fr"], "batch_size": 20})
    assert o.languages == ("de", "fr") and o.batch_size == 20
    with pytest.raises(ValueError):
        RunOptions(project="a", languages=("not a tag",)).validate()
    with pytest.raises(bundles.UnsupportedFormat):
        RunOptions(project="a", languages=("de",), fmt="po").validate()
