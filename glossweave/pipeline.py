"""One run over a project: scan, classify, name, merge, translate, write, rewrite, report."""

from __future__ import annotations

import os
import time
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import fixed, schemas
from .functions import keys, locales
from .functions.text import short_hash
from .operators import classify as cl, dedupe, detect, incremental as inc, keyalloc, provider as pv, report, rewrite, scan, setup
from .options import RunOptions, with_stack
from .session import materialise
from .sources import bundles, files as src, patches


class EveryRequestFailed(RuntimeError):
    pass


@dataclass
class RunResult:
    options: RunOptions
    candidates: DataFrame
    findings: DataFrame
    verdicts: DataFrame | None = None
    corpus: DataFrame | None = None
    outcomes: DataFrame | None = None
    final: DataFrame | None = None
    refused_rewrite: bool = False
    fixed: list = field(default_factory=list)
    rewritten: dict = field(default_factory=dict)
    merged: dict = field(default_factory=dict)
    asked: int = 0
    tokens: tuple[int, int] = (0, 0)
    seconds: float = 0.0


def _load(spark: SparkSession, path: str, schema) -> DataFrame:
    """Newest version of a work table; empty before the first run."""
    try:
        df = spark.read.schema(schema.add("run", "long") if "run" not in schema.names else schema).parquet(path)
        newest = df.agg(F.max("run")).first()[0]
    except AnalysisException:
        newest = None
    plain = [f.name for f in schema.fields if f.name != "run"]
    if newest is None:
        return spark.createDataFrame([], schema).select(*plain)
    return df.filter(F.col("run") == newest).select(*plain)


def _save(df: DataFrame, path: str) -> None:
    """Whole new version beside the old ones: a failed run leaves the last good one."""
    df.withColumn("run", F.lit(time.time_ns())).write.mode("append").partitionBy("run").parquet(path)


def _schema(s):
    from pyspark.sql import types as T

    return T.StructType(list(s.fields))


def run(spark: SparkSession, options: RunOptions, model: pv.Provider | None = None) -> RunResult:
    began = time.time()
    options = options.validate()
    model = model or pv.RuleProvider()
    everything = materialise(src.walk(spark, options.project).filter(~F.startswith("path", F.lit(".glossweave/"))), "files")
    tree = everything.select(F.lit(".").alias("project"), "path", F.coalesce("text", F.lit("")).alias("content"))
    best = detect.resolve(tree, options.stack).first()
    if best is None or best.stack is None:
        raise ValueError("no known stack in this project")
    o = with_stack(options, best.stack)

    scannable = src.scannable(everything, o.stack, o.resource_dir, o.exclude)
    if o.max_files:
        scannable = scannable.orderBy(F.upper("path"), "path").limit(o.max_files)
    found = materialise(scan.with_ids(scan.candidates(scannable, o.stack, o.include_diagnostics)), "candidates")
    findings = setup.findings(tree, list(o.languages)).filter(F.col("stack") == o.stack).drop("project")
    result = RunResult(o, found, findings)
    if o.apply_setup:
        fixes = setup.built_in_fixes(tree.select("path", "content"), findings).join(everything.select("path", "has_bom"), "path")
        result.fixed = sorted(r.path for r in src.write_back(fixes.withColumnRenamed("content", "text"), o.project).collect())
        if result.fixed:
            changed = src.walk(spark, o.project).filter(F.col("path").isin(*result.fixed)).select(F.lit(".").alias("project"), "path", F.col("text").alias("content"))
            tree = materialise(tree.filter(~F.col("path").isin(*result.fixed)).unionByName(changed), "tree")
            result.findings = findings = setup.findings(tree, list(o.languages)).filter(F.col("stack") == o.stack).drop("project")
    if o.scan_only:
        result.seconds = time.time() - began
        return result

    # source bundle and verdicts
    where = lambda culture: locales.bundle_path(F.lit(o.fmt), F.lit(o.resource_dir), F.lit(o.base_name), culture)
    bundle_files = everything.select("path", F.coalesce("text", F.lit("")).alias("text"))
    none = F.lit(None).cast("string")
    source_path = spark.range(1).select(where(none).alias("path"))
    source_files = bundle_files.join(source_path, "path", "left_semi")
    bundles.refuse_malformed(source_files, o.fmt)
    existing = patches.entries(source_files, o.fmt).select("key", F.col("value").alias("text"))
    fingerprint = spark.range(1).select(cl_fingerprint(o, model)).first()[0]
    model = model.told(pv.Prompt(o.source_language, o.context, o.glossary))
    cache_path = os.path.join(o.work, "verdicts")
    cache = _load(spark, cache_path, _schema(schemas.VERDICT)) if o.use_cache else None
    verdicts, fresh, answers = cl.classify(found, ["id"], cache, model, fingerprint, o.batch_size, o.concurrency)
    verdicts = materialise(verdicts, "verdicts")
    _paid(result, answers)
    if o.use_cache:
        _save(inc.upsert(cache, fresh, ["text_hash"]), cache_path)  # before anything else can fail
    result.verdicts = verdicts

    # keys: known texts keep theirs, others are allocated against every existing key
    localized = verdicts.filter("label = 'localized'").select("text", "id", "context", "proposed_key")
    known = dedupe.lowest_key(existing, "text").select("text", "key")
    new = localized.join(known, "text", "left_anti")
    base = _normal(keys.base_key(F.col("text"), F.col("proposed_key")), o.stack)
    fresh_keys = keyalloc.allocate(new.select("text", base.alias("base"), F.col("id").alias("ord")), _reserved(source_files, existing, o.fmt))
    keyed = localized.join(known.unionByName(fresh_keys.select("text", "key")), "text")
    scanned = materialise(keyed.select("key", "text", "context", "id"), "keyed")
    corpus = materialise(inc.corpus(existing, scanned), "corpus")
    result.corpus = corpus
    if corpus.isEmpty():
        result.seconds = time.time() - began
        return result
    place = F.concat_ws(":", "path", F.col("line").cast("string"))
    comments = found.join(scanned.select("text", "key"), "text").groupBy("key").agg(F.min_by(place, "id").alias("comment"))
    outgoing = [corpus.join(comments, "key", "left").select(where(none).alias("path"), "key", F.col("text").alias("value"), "comment")]

    # every language at once
    units = corpus.select("key", "text", (F.col("origin") == "changed").alias("changed")).withColumn("lang", F.explode(F.array(*[F.lit(x) for x in o.languages])))
    places = spark.createDataFrame([(x,) for x in o.languages], "lang string").withColumn("path", where(F.col("lang")))
    target_files = bundle_files.join(places.select("path"), "path", "left_semi")
    bundles.refuse_malformed(target_files, o.fmt)
    target = patches.entries(target_files, o.fmt).join(places, "path").select("lang", "key", "value")
    state_path, approved_path, words_path = (os.path.join(o.work, n) for n in ("state", "approved", "translations"))
    state = _load(spark, state_path, _schema(schemas.STATE_WRITTEN))
    approved = _load(spark, approved_path, _schema(schemas.STATE_APPROVED))
    decided = inc.decide(units, target, state, o.retranslate)
    learned = materialise(inc.learn(decided, approved), "learned")
    actions = materialise(inc.reuse(decided, learned), "actions")
    result.outcomes = inc.outcomes(actions)
    send = actions.filter("action = 'SEND'").select("lang", "key", "text").join(scanned.select("key", "context"), "key", "left")
    model = model.told(pv.Prompt(o.source_language, o.context, o.glossary, inc.prompt_examples(learned)))
    words = _load(spark, words_path, _schema(schemas.TRANSLATION)) if o.use_cache else None
    translated, new_words, answers = cl.translate(send, words, model, o.retranslate, o.batch_size, o.concurrency)
    _paid(result, answers)
    if o.use_cache:
        _save(inc.upsert(words, new_words, ["id"]), words_path)
    final = materialise(inc.final_values(actions, translated.filter("status = 'ok'")), "final")
    result.final = final
    outgoing.append(final.filter(inc.filled("value") & F.col("action").isin("SEND", "REUSED")).join(places, "lang").select("path", "key", "value", F.lit(None).cast("string").alias("comment")))

    merged = materialise(patches.merge(source_files.unionByName(target_files), outgoing[0].unionByName(outgoing[1]), o.fmt), "merged")
    patches.publish(merged, o.project).collect()
    counts = merged.filter("status is not null").groupBy("path", "status").count().collect()
    for r in counts:
        result.merged.setdefault(r.path, {})[r.status] = r["count"]
    _save(inc.new_state(final, state), state_path)
    _save(learned.select("lang", "source_text", "wording", "ord"), approved_path)

    _emit(spark, o, corpus)

    # rewriting waits for the set-up
    if o.apply:
        gate = setup.gate(findings, ["stack"]).first()
        if gate is not None and gate.blocked:
            result.refused_rewrite = True
        else:
            result.rewritten = _rewrite(spark, o, everything, found.join(scanned.select("text", "key"), "text"))
    result.seconds = time.time() - began
    _report(spark, result)
    return result


def _emit(spark: SparkSession, o: RunOptions, corpus: DataFrame) -> None:
    """Runtime glue: the accessor class for .NET, a bootstrap module for the web, nothing for the others."""
    if o.stack == "dotnet":
        path = f"{o.resource_dir}/{o.base_name}.Designer.cs"
        accessor = report.accessor_file(spark, corpus.select("key"), path, "App.Resources", o.base_name)
        bundles.publish(spark, bundles.write_lines(accessor), o.project).collect()
    elif o.stack == "web":
        target = os.path.join(o.project, "src", "i18n.js")
        if not os.path.exists(target):
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(target, "w", encoding="utf-8") as out:
                out.write(report.bootstrap(o.source_language, o.base_name))


def _report(spark: SparkSession, r: RunResult) -> None:
    head = {"stack": r.options.stack, "format": r.options.fmt, "languages": ", ".join(r.options.languages), "requests": r.asked, "tokens read": r.tokens[0], "tokens written": r.tokens[1], "seconds": round(r.seconds, 1)}
    head |= {f"bundle {path}": ", ".join(f"{n} {status}" for status, n in sorted(c.items())) for path, c in sorted(r.merged.items())}
    head |= {f"rewrite {k}": v for k, v in r.rewritten.items()}
    if r.refused_rewrite:
        head["rewrite"] = "refused: a blocking set-up step is open"
    left_out = r.candidates.join(r.verdicts.filter("label <> 'localized'").select("text", F.coalesce("reason", "label").alias("reason")), "text")
    entries = r.candidates.join(r.final.select("text", "key", "lang", "value"), "text").select("path", "line", "key", "text", "lang", "value")
    rows = report.lines(spark, head, r.findings, r.outcomes, r.final, entries, left_out.select("path", "line", "text", "reason"), list(r.options.languages))
    bundles.publish(spark, bundles.write_lines(materialise(rows, "report")), r.options.work).collect()


def cl_fingerprint(o: RunOptions, model: pv.Provider):
    from .functions.text import fingerprint

    glossary = F.array(*[F.lit(g) for g in o.glossary]).cast("array<string>")
    return fingerprint(F.lit(model.name), F.lit(o.source_language), F.lit(o.context), glossary, F.lit(o.include_diagnostics))


def _paid(result: RunResult, answers: DataFrame) -> None:
    """Counts answers and tokens, and ends the run when every request failed."""
    _gate(answers)
    result.asked += answers.count()
    used = pv.token_totals(answers).first()
    result.tokens = (result.tokens[0] + used.input_tokens, result.tokens[1] + used.output_tokens)


def _gate(answers: DataFrame) -> None:
    g = pv.all_failed(answers).first()
    if g.abort:
        raise EveryRequestFailed(g.first_error)


def _normal(c, stack: str):
    return {"android": keys.lower_snake, "flutter": keys.lower_camel}.get(stack, lambda x: x)(c)


def _reserved(source_files: DataFrame, existing: DataFrame, fmt: str) -> DataFrame:
    """Every key of the file, including those that hold no text."""
    return patches.keys(source_files, fmt).select("key")


IMPORTS = {"csharp": (r"^using [A-Za-z]", r"^(//|/\*|\*|#)"), "script": (r"^import ", r"^(//|/\*|\*|['\"]use )"), "jsx": (r"^import ", r"^(//|/\*|\*|['\"]use )"), "dart": (r"^import ", r"^(//|library )")}


def _rewrite(spark: SparkSession, o: RunOptions, files: DataFrame, entries: DataFrame) -> dict:
    p = rewrite.plan(F.col("dialect"), F.col("kind"), F.col("key"), F.col("member"), F.col("interpolation_args"), F.col("blocked_reason"))
    planned = entries.withColumn("plan", p)
    edits = planned.filter("plan is not null").select("path", "dialect", "span_start", "raw", "plan.*")
    spliced = materialise(rewrite.splice(files.filter("text is not null"), ["path"], "text", edits).join(files.select("path", "has_bom"), "path").filter("applied > 0"), "spliced")
    needs = edits.filter("required_import is not null").groupBy("path").agg(F.min(F.struct("dialect", "required_import")).alias("need"))
    out = spliced.join(needs, "path", "left")
    text = F.col("content")
    for dialect, (existing, prologue) in IMPORTS.items():
        text = F.when(F.col("need.dialect") == dialect, rewrite.ensure_import(F.col("content"), F.col("need.required_import"), existing, prologue)).otherwise(text)
    written = src.write_back(out.select("path", text.alias("text"), "has_bom"), o.project)
    totals = rewrite.summary(spliced).first().asDict()
    totals["files"] = written.count()
    totals["not_rewritable"] = planned.filter("plan is null").count()
    return totals
