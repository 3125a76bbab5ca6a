"""What queries do per row: no step is done more often than its result is asked for."""

import os

import pytest
from pyspark.sql import functions as F

from glossweave import session
from glossweave.operators import incremental as inc, markup, ordering, provider as pv
from glossweave.plans import bundle_plans, code_plans, load_catalog
from glossweave.sources import bundles


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_log_files_grow_with_attempts_alone(tmp_path):
    batches = [[{"id": f"{i}-{k}", "text": f"Text {k}", "context": ""} for k in range(3)] for i in range(20)]
    ask = lambda m, b: m.classify(b)
    log = pv.AnswerLog(str(tmp_path), "7")
    first = [pv.ask_batch(pv.RuleProvider(), ask, b, log) for b in batches]
    files = [p for p in tmp_path.rglob("*") if p.is_file()]
    assert len(files) == 1
    # an attempt that was lost while it wrote: its whole lines count
    files[0].write_bytes(files[0].read_bytes()[:-5])
    again = pv.AnswerLog(str(tmp_path), "7")
    assert [again.read(b) for b in batches] == [*first[:-1], None]
    assert pv.AnswerLog(str(tmp_path), "8").read(batches[0]) is None


def test_final_values_take_translations_that_rows_have(spark):
    rows = [("de", "a", "A", "SEND", None, "old"), ("de", "b", "B", "REUSED", "W", "old"), ("de", "c", "C", "CURRENT", "W", "now"), ("fr", "a", "A", "SEND", None, None)]
    actions = spark.createDataFrame(rows, "lang string, key string, text string, action string, wording string, current string")
    sent = actions.filter("action = 'SEND'").select("lang", "key", F.concat(F.lit("> "), "text").alias("translation"))
    own = inc.final_values(actions.withColumn("translation", F.when(F.col("action") == "SEND", F.concat(F.lit("> "), "text"))))
    assert sorted(map(str, own.collect())) == sorted(map(str, inc.final_values(actions, sent).collect()))
    assert "Join" not in plan(own)


def test_tags_without_attributes_are_not_searched(spark):
    df = spark.createDataFrame([(1, '@if (a) { <p>Save all</p> }<b title="Open it">Close it</b><i =>Go on</i>')], "id long, content string")
    found = markup.candidates(df, ["id"], "content", "razor")
    assert "Contains(token" in plan(found) or "contains(token" in plan(found).lower()
    assert {(r.phase, r.text) for r in found.collect()} >= {(1, "Save all"), (0, "Open it"), (1, "Close it"), (1, "Go on")}


@pytest.mark.parametrize("dialect", list(code_plans.STATEMENTS))
def test_texts_are_escaped_once_a_file(spark, data, dialect):
    assert plan(code_plans.source_files(spark, data, dialect)).count("replace(") == 2


def test_files_are_compared_without_moving_them(spark, data):
    top = plan(load_catalog()["code_spans_hold"].run(spark, data)).split("Join")[0]
    assert "md5(" not in top and "content" not in top


@pytest.mark.parametrize("fmt", ["resx", "i18next", "arb"])
def test_new_values_of_a_merge_are_made_once(spark, data, fmt, monkeypatch):
    written, real = [], bundle_plans.materialise
    monkeypatch.setattr(bundle_plans, "materialise", lambda df, label: written.append(label) or real(df, label))
    assert load_catalog()[f"bundle_merge_{fmt}"].run(spark, data).count()
    assert "told" in written


@pytest.fixture
def shuffled_joins(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("how", ["left", "full_outer"])
def test_rows_of_a_key_are_dealt_out_by_the_key_alone(spark, shuffled_joins, how):
    left = [("de", "a", 1), ("de-AT", "a", 2), ("fr", "a", 3), ("fr", "a", 4), ("de", None, 5), (None, "a", 6), ("de", "b", 7)]
    right = [("de", "a", 10), ("de-AT", "a", 20), ("fr", "a", 30), ("fr", "a", 31), ("de", None, 50), (None, "a", 60), ("es", "c", 70)]
    a, b = spark.createDataFrame(left, "lang string, key string, x int"), spark.createDataFrame(right, "lang string, key string, y int")
    got = inc.per_language(a, b, "key", how)
    assert got.columns == ["lang", "key", "x", "y"]
    assert sorted(map(str, got.collect())) == sorted(map(str, a.join(b, ["lang", "key"], how).collect()))
    dealt = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(key" in dealt and "hashpartitioning(lang" not in dealt


def test_one_text_in_all_languages_is_moved_by_key_and_by_text(spark, shuffled_joins):
    units = spark.createDataFrame([("de", "k", "Save"), ("fr", "k", "Save")], "lang string, key string, text string")
    target = spark.createDataFrame([("de", "k", "Sichern")], "lang string, key string, value string")
    state = spark.createDataFrame([("de", "k", "0", "0")], "lang string, key string, source_hash string, translation_hash string")
    old = spark.createDataFrame([("fr", "Save", "Enregistrer", 1)], "lang string, source_text string, wording string, ord long")
    decided = inc.decide(units, target, state)
    actions = inc.reuse(decided, inc.learn(decided, old))
    assert {(r.lang, r.action, r.wording) for r in actions.collect()} == {("de", "HUMAN", "Sichern"), ("fr", "REUSED", "Enregistrer")}
    dealt = decided._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(key" in dealt and "hashpartitioning(lang" not in dealt


def test_shuffles_go_when_their_table_is_written(spark):
    manager = spark._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: {f for f in manager.getAllFiles().mkString("|").split("|") if "/shuffle_" in f}
    before, setting = files(), spark.conf.get(session._FREE)
    out = session.materialise(spark.range(5000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count(), "test", packed=True)
    assert files() <= before and spark.conf.get(session._FREE) == setting
    assert sorted((r["k"], r["count"]) for r in out.collect()) == [(0, 715), (1, 715)] + [(k, 714) for k in range(2, 7)]
    with pytest.raises(ZeroDivisionError), session.shuffles_freed(spark):
        1 / 0
    assert spark.conf.get(session._FREE) == setting


def test_scratch_tables_alone_are_discarded(spark, tmp_path):
    out = session.materialise(spark.range(3), "test")
    other = spark.range(3)
    other.write.parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError):
        session.discard(spark, spark.read.parquet(str(tmp_path / "t")))
    folder = out.inputFiles()[0].rpartition("/")[0].replace("file:", "")
    assert os.path.isdir(folder) and os.path.isdir(tmp_path / "t")
    session.discard(spark, out)
    assert not os.path.exists(folder) and os.path.isdir(tmp_path / "t")


def test_bundles_without_a_file_move_their_entries_once(spark, shuffled_joins):
    none = spark.createDataFrame([], "path string, text string")
    incoming = spark.createDataFrame([("L/a", "k1", "One", None), ("L/a", "k2", "Two", "doc 1"), ("L/b", "k1", "One", None)], "path string, key string, value string, comment string")
    for fmt in ("resx", "android", "strings", "i18next", "arb"):
        lines = bundles.merge_lines(none, incoming, fmt)
        entries = lines.filter("status = 'added'")
        assert sorted((r.path, r.status) for r in entries.collect()) == [("L/a", "added"), ("L/a", "added"), ("L/b", "added")]
        moved = lines.filter("section = 1")._jdf.queryExecution().optimizedPlan().toString()
        assert "value#" in moved and "FullOuter" not in moved


def test_new_entries_beside_files_and_without_any_are_the_same(spark):
    files = spark.createDataFrame([("L/a", '"k1" = "Old";\n/* note */\n\n"k3" = "Three";\n'), ("L/blank", " ")], "path string, text string")
    rows = [("L/a", "k1", "One", None), ("L/a", "k2", "Two", "doc 1"), ("L/blank", "k1", "One", None), ("L/b", "k1", "One", "c"), ("L/b", None, "No", None), (None, "k9", "x", None)]
    incoming = spark.createDataFrame(rows, "path string, key string, value string, comment string")
    there = bundles.merge_lines(files, incoming, "strings").collect()
    assert sorted(str(r.status) for r in there if r.status) == ["added"] * 5 + ["kept", "updated"]
    alone = bundles.merge_lines(files.limit(0), incoming.filter("path = 'L/b'"), "strings").collect()
    assert sorted(map(str, alone)) == sorted(str(r) for r in there if r.path == "L/b")


def test_the_input_of_an_order_goes_when_it_is_numbered(spark, monkeypatch):
    gone, real = [], ordering.discard
    monkeypatch.setattr(ordering, "discard", lambda s, *w: (gone.extend(w), real(s, *w)))
    ranked = ordering.with_group_rank(spark.createDataFrame([("a", 3), ("b", 1), ("a", 2)], "g string, o int"), "g", ["o"])
    assert sorted((r["g"], r["o"], r["rank"]) for r in ranked.collect()) == [("a", 2, 1), ("a", 3, 2), ("b", 1, 1)]
    assert len(gone) == 1 and "rank-input" in gone[0].inputFiles()[0]
    given = session.materialise(spark.createDataFrame([("a", 3)], "g string, o int"), "given")
    assert ordering.with_group_rank(given, "g", ["o"], written=True).count() == 1 and len(gone) == 1 and given.count() == 1
