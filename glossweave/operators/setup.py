"""Project set-up: what is missing, whether it blocks rewriting, and anchored edits that fix it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: (stack, step, severity, automatic, path pattern, content pattern)
CHECKS = [
    ("dotnet", "culture selection", "recommended", False, r"\.cs$", r"CultureInfo\.|UseRequestLocalization"),
    ("dotnet", "neutral language", "recommended", True, r"\.csproj$", r"<NeutralLanguage>"),
    ("web", "manifest", "blocking", False, r"(^|/)package\.json$", r"\{"),
    ("web", "packages", "blocking", True, r"(^|/)package\.json$", r'"(i18next|vue-i18n|svelte-i18n|@ngx-translate/core)"[ ]*:'),
    ("web", "bootstrap import", "blocking", True, r"(^|/)(main|index)\.(js|ts|jsx|tsx)$", r"i18n"),
    ("android", "locale filter", "recommended", False, r"\.gradle(\.kts)?$", r"resConfigs|resourceConfigurations|localeFilters"),
    ("apple", "project reference", "blocking", False, r"\.pbxproj$", r"\.strings"),
    ("apple", "default localization", "blocking", False, r"(^|/)Package\.swift$", r"defaultLocalization"),
    ("apple", "localizations in plist", "recommended", False, r"Info\.plist$", r"CFBundleLocalizations"),
    ("flutter", "pubspec", "blocking", False, r"(^|/)pubspec\.yaml$", r"name:"),
    ("flutter", "localizations package", "blocking", True, r"(^|/)pubspec\.yaml$", r"flutter_localizations"),
    ("flutter", "intl package", "blocking", True, r"(^|/)pubspec\.yaml$", r"[ ]intl:"),
    ("flutter", "generate flag", "blocking", True, r"(^|/)pubspec\.yaml$", r"generate:[ ]*true"),
    ("flutter", "l10n.yaml", "blocking", True, r"(^|/)l10n\.yaml$", r"."),
    ("flutter", "delegates", "blocking", False, r"\.dart$", r"localizationsDelegates"),
]
#: Steps that apply only to projects with such a file, or with a file of such content; elsewhere nothing is asked for.
WHERE_PRESENT = {"project reference": "file", "default localization": "file", "localizations in plist": "file", "locale filter": "content"}


def findings(files: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """(project, stack, step, severity, automatic, satisfied) from one aggregate over the files; satisfied is null where a
    step does not apply. A project without a locale filter ships all languages; one with a filter should name those asked for."""
    def hit(stack: str, step: str, severity: str, automatic: bool, p: str, c: str) -> Column:
        here = F.col("path").rlike(p)
        found = F.bool_or(here & F.col("content").rlike(c))
        if step == "locale filter" and languages:
            named = F.flatten(F.collect_set(F.when(here, language_of(locale_filter_languages(F.col("content"))))))
            found = F.when(found, F.size(F.array_except(F.lit(sorted({x.split("-")[0].lower() for x in languages})), named)) == 0)
        where = WHERE_PRESENT.get(step)
        return found if not where else F.when(F.bool_or(here if where == "file" else here & F.col("content").rlike(c)), found)

    wide = files.groupBy("project").agg(*[hit(*c).alias(f"c{i}") for i, c in enumerate(CHECKS)])
    cells = F.array(*[
        F.struct(F.lit(c[0]).alias("stack"), F.lit(c[1]).alias("step"), F.lit(c[2]).alias("severity"), F.lit(c[3]).alias("automatic"), F.col(f"c{i}").alias("satisfied"))
        for i, c in enumerate(CHECKS)
    ])
    return wide.select("project", F.inline(cells))


def gate(steps: DataFrame, by: list[str]) -> DataFrame:
    """Rewriting is refused while a blocking step is open; translations are kept either way."""
    done = F.coalesce("satisfied", F.lit(True))
    open_block = (F.col("severity") == "blocking") & ~done
    return steps.groupBy(*by).agg(
        F.every(done).alias("ready"),
        F.bool_or(open_block).alias("blocked"),
        F.every(~open_block | F.col("automatic")).alias("blocking_is_automatic"),
        F.count_if(~done).alias("open_steps"),
    )


def language_of(tags: Column) -> Column:
    """Language subtags: a filter for ``pt`` keeps ``pt-BR``."""
    return F.transform(tags, lambda t: F.lower(F.split_part(t, F.lit("-"), F.lit(1))))


def locale_filter_languages(content: Column) -> Column:
    """Languages that a build file keeps."""
    call = F.regexp_extract(content, r"(?:resConfigs|resourceConfigurations|localeFilters)([^}\n]*)", 1)
    return F.regexp_extract_all(call, F.lit(r"""["']([A-Za-z-]+)["']"""), F.lit(1))


# --- anchored edits -------------------------------------------------------------------------------


def anchor_count(content: Column, anchor: Column) -> Column:
    return F.when(F.length(anchor) > 0, (F.length(content) - F.length(F.replace(content, anchor, F.lit("")))) / F.length(anchor)).otherwise(0).cast("long")


def match_endings(content: Column, text: Column) -> Column:
    """Edits are written with bare line feeds; a file with CRLF gets CRLF."""
    lf = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    return F.when(F.contains(content, F.lit("\r\n")), F.replace(lf, F.lit("\n"), F.lit("\r\n"))).otherwise(lf)


def validate(edits: DataFrame, files: DataFrame) -> DataFrame:
    """edits(step, ord, file, kind, anchor, content) against files(path, content): one refusal per edit at most,
    and a step is accepted only when all of its edits are."""
    same = files.select(F.col("path").alias("file"), F.col("content").alias("_exact")).dropDuplicates(["file"])
    f = files.groupBy(F.lower("path").alias("_path")).agg(F.min_by("content", "path").alias("_alike"))
    path = F.regexp_replace(F.replace("file", F.lit("\\"), F.lit("/")), r"^\./", "")
    # paths that differ in case alone name one file of the project; with several, the one spelled alike is meant
    j = edits.withColumn("file", path).join(same, "file", "left").withColumn("_path", F.lower("file")).join(f, "_path", "left")
    j = j.withColumn("_content", F.coalesce("_exact", "_alike")).drop("_exact", "_alike")
    outside = F.col("file").rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)")
    exists = F.col("_content").isNotNull()
    anchor = match_endings(F.col("_content"), F.col("anchor"))
    refusal = (
        F.when(outside, "outside project")
        .when((F.col("kind") == "create") & exists, "already exists")
        .when(F.col("kind") == "create", F.lit(None))
        .when(~exists, "not offered")
        .when(F.col("kind") == "append", F.lit(None))
        .when(anchor_count(F.col("_content"), anchor) == 0, "anchor not found")
        .when(anchor_count(F.col("_content"), anchor) > 1, "anchor ambiguous")
    )
    return j.withColumn("refusal", refusal).drop("_path", "_content")


def accepted_steps(validated: DataFrame) -> DataFrame:
    return validated.groupBy("step").agg(
        F.count("*").alias("edits"), F.count("refusal").alias("refused"), F.every(F.col("refusal").isNull()).alias("accepted"))


def apply_one(content: Column, kind: Column, anchor: Column, new: Column) -> Column:
    """Text of a file after one accepted edit."""
    body = match_endings(content, new)
    return (
        F.when(kind == "create", new)
        .when(kind == "append", F.concat(content, body))
        .otherwise(F.replace(content, match_endings(content, anchor), body))
    )


# --- manifest patches ------------------------------------------------------------------------------


def add_json_dependency(content: Column, package: str, version: str) -> Column:
    """First entry of "dependencies", or a new object before the closing brace; other text is untouched."""
    entry = f'"{package}": "{version}"'
    has = content.rlike(f'"{package}"[ ]*:')
    into = F.regexp_replace(content, r'"dependencies"([ ]*:[ ]*)\{[ \t\r\n]*"', f'"dependencies"$1{{{entry}, "')
    fresh = F.regexp_replace(content, r"[ \t\r\n]*\}[ \t\r\n]*$", f', "dependencies": {{{entry}}}}}')
    return F.when(has, content).when(content.rlike(r'"dependencies"[ ]*:[ ]*\{[ \t\r\n]*"'), into).otherwise(fresh)


def add_property(content: Column, name: str, value: str) -> Column:
    """XML property in the first property group."""
    new = f"<{name}>{value}</{name}>"
    return F.when(F.contains(content, F.lit(f"<{name}>")), content).otherwise(
        F.regexp_replace(content, r"^((?s:.*?)<PropertyGroup>)", f"$1{new}"))


def add_yaml_flag(content: Column, section: str, line: str) -> Column:
    """Indented line under a top-level YAML section, creating the section at the end when absent."""
    has = content.rlike(rf"(?m)^  {line}$")
    into = F.regexp_replace(content, rf"(?m)^{section}:[ ]*$", f"{section}:\n  {line}")
    end = F.concat(F.regexp_replace(content, r"\n*$", ""), F.lit(f"\n{section}:\n  {line}\n"))
    return F.when(has, content).when(content.rlike(rf"(?m)^{section}:[ ]*$"), into).otherwise(end)


def built_in_fixes(files: DataFrame, steps: DataFrame) -> DataFrame:
    """files(path, content) changed by the automatic fix of an open step: (path, content), changed files only."""
    todo = {r.step for r in steps.filter(~F.col("satisfied") & F.col("automatic")).select("step").collect()}  # a handful of steps
    c, p = F.col("content"), F.col("path")
    new = c
    if "neutral language" in todo:
        new = F.when(p.rlike(r"\.csproj$"), add_property(new, "NeutralLanguage", "en")).otherwise(new)
    if "packages" in todo:
        new = F.when(p == "package.json", add_json_dependency(new, "i18next", "^23.0.0")).otherwise(new)
    if "generate flag" in todo:
        new = F.when(p == "pubspec.yaml", add_yaml_flag(new, "flutter", "generate: true")).otherwise(new)
    if "intl package" in todo:
        new = F.when(p == "pubspec.yaml", add_yaml_flag(new, "dependencies", "intl: any")).otherwise(new)
    return files.select("path", c.alias("_old"), new.alias("content")).filter("content <> _old").drop("_old")
