"""The provider seam: usage, prompt inputs, and batches that are asked once."""

import os
import sys
import threading
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from glossweave.operators import classify as cl, incremental as inc, provider as pv

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors do not see this folder


class Counting(pv.RuleProvider):
    calls = []

    def classify(self, batch):
        Counting.calls.append([r["id"] for r in batch])
        return super().classify(batch)


def batch(n):
    return [{"id": str(i), "text": f"Text {i}", "context": ""} for i in range(n)]


def test_finished_batches_are_not_asked_again(tmp_path):
    log = pv.AnswerLog(str(tmp_path / "log"))
    Counting.calls.clear()
    ask = lambda m, b: m.classify(b)
    first = pv.ask_batch(Counting(), ask, batch(3), log)
    assert pv.ask_batch(Counting(), ask, batch(3), pv.AnswerLog(str(tmp_path / "log"))) == first
    assert len(Counting.calls) == 1
    assert [(r["input_tokens"], r["output_tokens"]) for r in first] == [(18, 51), (0, 0), (0, 0)]
    pv.ask_batch(Counting(), ask, batch(2), log)
    assert len(Counting.calls) == 2


class Broken(pv.RuleProvider):
    def classify(self, batch):
        self.usage = (5, 0)
        raise ConnectionError("down")


def test_failed_batches_are_asked_again_and_paid_for(tmp_path):
    log = pv.AnswerLog(str(tmp_path))
    ask = lambda m, b: m.classify(b)
    rows = pv.ask_batch(Broken(), ask, batch(2), log)
    assert all("down" in r["error"] for r in rows) and rows[0]["input_tokens"] == 5
    assert pv.ask_batch(pv.RuleProvider(), ask, batch(2), log)[0]["error"] is None
    model = pv.RetryingProvider(Broken(), attempts=3, delay=0.0)
    assert pv.ask_batch(model, ask, batch(1), None)[0]["input_tokens"] == 15


class Flaky(pv.RuleProvider):
    left = [2]

    def classify(self, batch):
        if Flaky.left[0]:
            Flaky.left[0] -= 1
            self.usage = (1, 0)
            raise TimeoutError
        return super().classify(batch)


def test_retries_add_up():
    model = pv.RetryingProvider(Flaky(), attempts=3, delay=0.0)
    assert model.classify(batch(1))[0]["id"] == "0" and model.usage == (2 + 6, 17)


class Slow(pv.RuleProvider):
    def classify(self, batch):
        time.sleep(0.3)
        return [{**a, "reason": f"{threading.get_ident()}"} for a in super().classify(batch)]


def test_concurrency_is_not_bound_to_cores(spark):
    """Two tasks ask eight batches at a time; every id is answered once and tokens are those of all batches."""
    texts = spark.createDataFrame([(f"{i:03}", f"Text {i}", "") for i in range(80)], "id string, text string, context string").repartition(5)
    answers = pv.ask(texts, lambda m, b: m.classify(b), 5, 8, Slow()).collect()
    assert sorted(r.id for r in answers) == [f"{i:03}" for i in range(80)]
    assert len({r.reason for r in answers}) > 2
    assert sum(r.input_tokens for r in answers) == sum(len(f"Text {i}") for i in range(80))


class Foreign(pv.RuleProvider):
    def classify(self, batch):
        return [*super().classify(batch), {"id": "other", "user_facing": True}, *super().classify(batch)]


def test_foreign_and_repeated_ids_are_discarded(spark):
    texts = spark.createDataFrame([("a", "Text", ""), ("b", "More", "")], "id string, text string, context string")
    assert sorted(r.id for r in pv.ask(texts, lambda m, b: m.classify(b), 5, 1, Foreign()).collect()) == ["a", "b"]


class Recording(pv.RuleProvider):
    def translate(self, batch, lang):
        told = self.prompt
        return [{**a, "note": f"{told.context}/{'+'.join(told.glossary)}/{told.examples.get(lang)}"} for a in super().translate(batch, lang)]


@pytest.mark.parametrize("wrap", [lambda m: m, pv.RetryingProvider])
def test_prompt_inputs_reach_the_provider(spark, wrap):
    approved = spark.createDataFrame([("de", f"Text {i:02}", f"Wort {i}", i) for i in range(30)] + [("fr", "A b", "C d", 1)], "lang string, source_text string, wording string, ord int")
    examples = inc.prompt_examples(approved)
    assert {k: len(v) for k, v in examples.items()} == {"de": 20, "fr": 1} and examples["de"][0] == ("Text 00", "Wort 0")
    units = spark.createDataFrame([("de", "k", "Save", ""), ("fr", "k", "Save", "")], "lang string, key string, text string, context string")
    model = wrap(Recording()).told(pv.Prompt("en", "shop", ("Cart",), examples))
    notes = {r.note for r in cl.translate(units, None, model)[2].collect()}
    assert notes == {f"shop/Cart/{examples['de']}", "shop/Cart/(('A b', 'C d'),)"}


class Named(pv.RuleProvider):
    def translate(self, batch, lang):
        return [a for a in super().translate(batch, lang) if "silent" not in a["translation"]]


def test_answers_meet_units_by_their_text(spark):
    rows = [("de", "a", "Save", "z"), ("de", "b", "Save", "y"), ("fr", "a", "Save", "x"), ("fr", "c", "silent", None), ("it", "d", "Open", "w"), ("de", None, "Go", "v"),
            (None, "e", "Save", "u"), ("de", "f", None, "t")]
    units = spark.createDataFrame(rows, "lang string, key string, text string, context string")
    grouped = lambda df: sorted(map(str, df.select("lang", "text", "context").collect()))
    assert grouped(cl.questions(units, ["de", "fr"])) == grouped(cl.questions(units))
    whole = units.filter("lang IS NOT NULL AND text IS NOT NULL")
    for languages in (None, ["de", "fr"]):
        out, fresh, answers = cl.translate(whole, None, Named(), languages=languages)
        assert out.columns == ["lang", "text", "key", "context", "translation", "status"]
        assert sorted((r.lang, str(r.key), r.text, r.translation, r.status) for r in out.collect()) == sorted([
            ("de", "a", "Save", "[de] Save", "ok"), ("de", "b", "Save", "[de] Save", "ok"), ("fr", "a", "Save", "[fr] Save", "ok"),
            ("fr", "c", "silent", None, "unanswered"), ("it", "d", "Open", "[it] Open", "ok"), ("de", "None", "Go", "[de] Go", "ok")])
        assert fresh.count() == 4 and "text" not in answers.columns
        again, words, asked = cl.translate(whole, fresh, Named(), languages=languages)
        spoken = lambda df: sorted(map(str, df.filter("text <> 'silent'").collect()))
        assert spoken(again) == spoken(out)
        assert [r.error for r in asked.collect()] == ["no answer"] and sorted(map(str, words.collect())) == sorted(map(str, fresh.collect()))


def test_the_log_goes_when_answers_are_written(spark, tmp_path, monkeypatch):
    folder = f"{pv.scratch_path(spark, 'answer-log')}"
    monkeypatch.setattr(pv, "scratch_path", lambda session, label: folder)
    seen, real = [], pv.materialise
    monkeypatch.setattr(pv, "materialise", lambda *a, **b: (real(*a, **b), seen.append([os.path.getsize(f"{d}/{f}") for d, _, fs in os.walk(folder) for f in fs]))[0])
    text = "the same words again and again " * 20
    requests = spark.createDataFrame([(str(i), text, "c", "de") for i in range(60)], "id string, text string, context string, lang string")
    out = pv.ask(requests, lambda m, b: m.translate(b, "de"), model=pv.RuleProvider(), carry=("lang", "text"))
    assert out.filter(F.concat(F.lit("[de] "), "text") == F.col("translation")).count() == 60
    assert 0 < sum(seen[0]) < 60 * len(text) / 4 and not os.path.exists(folder)
