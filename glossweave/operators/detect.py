"""Which stack a project uses: one score per file and stack, the best per project wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed

# fixed values: (stack, path pattern, content pattern or None, score)
SCORES = [
    ("dotnet", r"\.(csproj|fsproj|vbproj)$", None, 100),
    ("dotnet", r"^[^/]+\.slnx?$", None, 95),
    ("dotnet", r"\.cs$", None, 60),
    ("web", r"^([^/]+/)?package\.json$", r'"(react|vue|svelte|next|nuxt|@angular/core|solid-js|preact)"[ ]*:', 95),
    ("web", r"^([^/]+/)?package\.json$", None, 70),
    ("web", r"\.(vue|svelte|jsx|tsx)$", None, 65),
    ("web", r"\.(js|ts|html)$", None, 40),
    ("android", r"(^|/)AndroidManifest\.xml$", None, 100),
    ("android", r"\.gradle(\.kts)?$", r"com\.android\.(application|library)", 90),
    ("apple", r"\.(xcodeproj|xcworkspace)/", None, 100),
    ("apple", r"^Package\.swift$", None, 95),
    ("apple", r"/Package\.swift$", None, 90),
    ("apple", r"\.(swift|m|mm)$", None, 60),
    ("flutter", r"(^|/)pubspec\.yaml$", r"sdk:[ ]*flutter", 100),
    ("flutter", r"(^|/)pubspec\.yaml$", None, 70),
    ("flutter", r"\.dart$", None, 50),
]


def file_score(stack: str, path: Column, content: Column) -> Column:
    """Rules are listed best first, so the first that holds is the score."""
    out = F.lit(None).cast("int")
    for name, p, c, score in reversed(SCORES):
        if name == stack:
            hit = path.rlike(p) if c is None else path.rlike(p) & content.rlike(c)
            out = F.when(hit, F.lit(score)).otherwise(out)
    return out


def stack_scores(files: DataFrame) -> DataFrame:
    """(project, stack, score): a plain max per project, combined inside tasks first."""
    aggs = [F.coalesce(F.max(file_score(s, F.col("path"), F.col("content"))), F.lit(0)).alias(s) for s in fixed.STACK_ORDER]
    wide = files.groupBy("project").agg(*aggs)
    cells = F.array(*[F.struct(F.lit(s).alias("stack"), F.col(s).alias("score"), F.lit(i).alias("rank")) for i, s in enumerate(fixed.STACK_ORDER)])
    return wide.select("project", F.inline(cells))


def resolve(files: DataFrame, explicit: str | None = None) -> DataFrame:
    """Best stack per project; registry order breaks ties; no positive score gives a null stack."""
    if explicit:
        known = {s.lower(): s for s in fixed.STACK_ORDER}
        if explicit.lower() not in known:
            raise ValueError(f"unknown stack {explicit!r}; known: {', '.join(fixed.STACK_ORDER)}")
        return files.select("project").distinct().select("project", F.lit(known[explicit.lower()]).alias("stack"), F.lit(100).alias("score"))
    best = F.max_by(F.struct("stack", "score"), F.struct("score", -F.col("rank"))).alias("b")
    out = stack_scores(files).groupBy("project").agg(best)
    return out.select("project", F.when(F.col("b.score") > 0, F.col("b.stack")).alias("stack"), F.col("b.score").alias("score"))


def shallowest(files: DataFrame, pattern: str) -> DataFrame:
    """Shallowest directory that matches, ties by path."""
    d = F.regexp_extract("path", pattern, 1)
    hits = files.withColumn("dir", d).filter(F.col("dir") != "")
    depth = F.length("dir") - F.length(F.replace("dir", F.lit("/"), F.lit("")))
    return hits.groupBy("project").agg(F.min_by("dir", F.struct(depth, "dir")).alias("dir"))


def top_manifests(files: DataFrame, names: list[str], per_name: int = 4, per_project: int = 24) -> DataFrame:
    """The few shallowest files per manifest name, then per project. Rank filters apply before the shuffle."""
    from pyspark.sql import Window as W

    from ..functions.paths import depth, file_name

    hits = files.select("project", "path").distinct().withColumn("name", file_name(F.col("path"))).filter(F.col("name").isin(*names))
    hits = hits.withColumn("depth", depth(F.col("path")))
    w = W.partitionBy("project", "name").orderBy("depth", "path")
    top = hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_name)
    v = W.partitionBy("project").orderBy("depth", "name", "path")
    return top.withColumn("position", F.row_number().over(v)).filter(F.col("position") <= per_project)


def nearest_module(files: DataFrame, modules: DataFrame) -> DataFrame:
    """Each file with its nearest ancestor directory that is a module, null when none is.

    Ancestors are looked up once per directory, so a project's root meets its directories, not its files.
    """
    folder = F.regexp_replace(F.regexp_extract("path", r"^(.*)/", 0), "/$", "")
    placed = files.select("project", "path", folder.alias("folder"))
    folders = placed.select("project", "folder").distinct()
    parts = F.when(F.col("folder") == "", F.array().cast("array<string>")).otherwise(F.split("folder", "/"))
    ups = F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda n: F.struct(n.alias("up"), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - n), "/").alias("dir")),
    )
    above = folders.select("project", "folder", F.inline(ups)).join(modules.select("project", "dir").distinct(), ["project", "dir"])
    near = above.groupBy("project", "folder").agg(F.min_by("dir", "up").alias("module"))
    return placed.join(near, ["project", "folder"], "left").select("project", "path", "module")
