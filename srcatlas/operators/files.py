"""Files: filters, kinds, routes, manifests and the directory summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ignore import DEFAULT_EXCLUDES, compile_rules, keyed_rules
from ..functions.scalar import file_name, strip, suffix

KEY = ["repo_id", "rel_path"]
#: Fixed suffixes and directory names of the kinds.
APPLICATION = (
    ".py", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".go", ".rs", ".rb", ".php", ".java", ".kt", ".kts", ".scala",
    ".cs", ".cpp", ".cc", ".c", ".h", ".hpp", ".swift", ".m", ".mm", ".dart", ".ex", ".exs", ".clj", ".cljs", ".lua",
)
MIGRATIONS = ("/migrations/", "/alembic/", "/db/migrate/", "/database/migrations/", "/prisma/migrations/", "/flyway/", "/liquibase/")
#: Fixed names of files that say what a directory is about.
NOTABLE = (
    "pyproject.toml", "setup.py", "setup.cfg", "requirements.txt", "Pipfile", "poetry.lock", "package.json", "pnpm-workspace.yaml",
    "Cargo.toml", "go.mod", "pom.xml", "build.gradle", "build.gradle.kts", "Gemfile", "composer.json", "Dockerfile",
    "docker-compose.yml", "Makefile", "README.md", "README.rst", "VISION.md", "ARCHITECTURE.md", "CHANGELOG.md",
)


def _prefixes(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def _ignored(path: Column, rules) -> Column:
    """The last matching rule decides each prefix; a file goes if any prefix does."""
    prefixes, depth = _prefixes(path), F.size(F.split(path, "/"))

    def verdict(p: Column, k: Column) -> Column:
        out = F.lit(False)
        for _, regex, negate, dir_only in rules:
            hit = p.rlike(regex) & (k < depth - 1) if dir_only else p.rlike(regex)
            out = F.when(hit, F.lit(not negate)).otherwise(out)
        return out

    return F.exists(F.zip_with(prefixes, F.sequence(F.lit(0), depth - 1), lambda p, k: verdict(p, k)), lambda x: x)


def _any_rule(rules) -> str:
    """One pattern over whole paths for rules of which none brings anything back: the file or a directory above it matches one."""
    return "^(?:" + "|".join(f"(?:{regex[1:-1]})" + ("/.*" if dir_only else "(?:/.*)?") for _, regex, _, dir_only in rules) + ")$"


def filter_ignored(files: DataFrame, extra=(), defaults=DEFAULT_EXCLUDES, own_rules: bool | DataFrame = True) -> DataFrame:
    """Drop files that the defaults, their repository's root .gitignore or `extra` exclude.

    With `own_rules`, the .gitignore texts come from `files`, or are given as (repo_id, text); what goes is
    decided on paths alone and anti-joined.  Filter a table without texts where files are many: the join
    then moves paths only.  Without own rules, rules without exceptions are one pattern over the path.
    """
    rules = compile_rules([*defaults, *extra])
    if own_rules is not False:
        ignores = files.where("rel_path = '.gitignore'").select("repo_id", "text") if own_rules is True else own_rules
        return files.join(ignored_files(files.select(*KEY), ignores, extra, defaults), KEY, "left_anti")
    return files.where(~_by_shared_rules(rules)) if rules else files


def _by_shared_rules(rules) -> Column:
    if any(negate for _, _, negate, _ in rules):
        return _ignored(F.col("rel_path"), rules)
    return F.col("rel_path").rlike(_any_rule(rules)) if rules else F.lit(False)


RULES = "repo_id string, seq int, meets string, key string, regex string, negate boolean, dir_only boolean"
#: Parts of a repository's paths that meet its rules in tasks of their own.
SALTS = 16


def repository_rules(ignores: DataFrame, extra=(), defaults=DEFAULT_EXCLUDES) -> DataFrame:
    """A row for each rule of each repository that has a .gitignore (repo_id, text): defaults, its own, extras; the last that matches counts."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = [(repo, *rule) for repo, text in zip(frame["repo_id"], frame["text"]) for rule in keyed_rules([*defaults, *(text or "").splitlines(), *extra])]
            yield pd.DataFrame(rows, columns=["repo_id", "seq", "meets", "key", "regex", "negate", "dir_only"])

    return ignores.mapInPandas(run, RULES)


def ignored_prefixes(prefixes: DataFrame, rules: DataFrame) -> DataFrame:
    """Those of the directories and files (repo_id, prefix, is_dir) whose last matching rule ignores them.

    Rules without wildcards and those for a suffix meet prefixes by equality; the others are tried on every
    prefix of their repository, in order of the pattern, so that each is compiled once for all rows of a task.
    A repository's prefixes are dealt to `SALTS` parts, to each of which its rules go.
    """
    name = F.element_at(F.split("prefix", "/"), -1)
    salted = prefixes.withColumn("salt", F.pmod(F.xxhash64("prefix"), F.lit(SALTS)).cast("int"))
    everywhere = rules.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    ways = F.array(
        F.struct(F.lit("name").alias("meets"), name.alias("key")), F.struct(F.lit("path").alias("meets"), F.col("prefix").alias("key")), F.struct(F.lit("suffix").alias("meets"), F.regexp_extract(name, r"(\.[^.]*)$", 1).alias("key"))
    )
    keyed = salted.select("repo_id", "salt", "prefix", "is_dir", F.explode(ways).alias("w")).select("repo_id", "salt", "prefix", "is_dir", "w.*")
    verdict = ["repo_id", "prefix", "is_dir", "seq", "negate"]
    by_key = keyed.join(everywhere.where("meets <> 'pattern'"), ["repo_id", "salt", "meets", "key"]).where("is_dir OR NOT dir_only").select(*verdict)
    tried = salted.join(everywhere.where("meets = 'pattern'"), ["repo_id", "salt"]).where("is_dir OR NOT dir_only").sortWithinPartitions("regex")
    by_pattern = tried.where("regexp_instr(prefix, regex) > 0").select(*verdict)
    last = by_key.unionByName(by_pattern).groupBy("repo_id", "prefix", "is_dir").agg(F.max_by("negate", "seq").alias("negate"))
    return last.where("NOT negate").drop("negate")


def ignored_files(paths: DataFrame, ignores: DataFrame, extra=(), defaults=DEFAULT_EXCLUDES) -> DataFrame:
    """(repo_id, rel_path) of the files that go: they or a directory above them are ignored.

    Every directory of a repository with rules of its own is judged once; repositories without share one pattern.
    """
    own = ignores.select("repo_id").distinct()
    steps = F.split("rel_path", "/")
    parts = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.struct(F.array_join(F.slice(steps, 1, n), "/").alias("prefix"), (n < F.size(steps)).alias("is_dir")))
    spine = paths.join(own, "repo_id", "left_semi").select(*KEY, F.explode(parts).alias("p")).select(*KEY, "p.*")
    judged = ignored_prefixes(spine.select("repo_id", "prefix", "is_dir").distinct(), repository_rules(ignores, extra, defaults))
    by_own = spine.join(judged, ["repo_id", "prefix", "is_dir"], "left_semi").select(*KEY).distinct()
    by_default = paths.join(own, "repo_id", "left_anti").where(_by_shared_rules(compile_rules([*defaults, *extra]))).select(*KEY).distinct()
    return by_own.unionByName(by_default)


def filter_size(files: DataFrame, max_file_bytes: int = 2_000_000) -> DataFrame:
    return files.where(F.col("size") <= max_file_bytes)


def filter_near_empty(files: DataFrame, min_content_bytes: int = 64) -> DataFrame:
    return files.where(F.length(strip(F.col("text"))) >= min_content_bytes) if min_content_bytes > 0 else files


def _declares_openapi(text: Column) -> Column:
    """Whether the head of a text has a key openapi or swagger with a version: in YAML on a line of its own, in JSON anywhere."""
    head = F.left(text, F.lit(4096))
    lines = F.transform(F.split(head, "\n"), lambda x: F.regexp_replace(x, r"\s+", ""))
    return F.exists(lines, lambda x: x.rlike(r"""^(?:openapi|swagger):["']?[0-9]""")) | F.regexp_replace(head, r"\s+", "").rlike(r'"(?:openapi|swagger)":"[0-9]')


def kind(path: Column, text: Column) -> Column:
    ext, low = suffix(path), F.concat(F.lit("/"), F.lower(path))
    migration = F.lit(False)
    for token in MIGRATIONS:
        migration = migration | low.contains(token)
    out = F.when(ext.isin(".sql", ".ddl"), F.when(migration, "migration").otherwise("sql"))
    out = out.when(ext == ".proto", "protobuf").when(ext.isin(".graphql", ".graphqls", ".gql"), "graphql")
    out = out.when(ext.isin(".yml", ".yaml", ".json") & _declares_openapi(text), "openapi")
    return out.when(ext.isin(*APPLICATION), F.when(migration, "migration").otherwise("application_code")).otherwise("other")


def classify(files: DataFrame) -> DataFrame:
    return files.withColumn("kind", kind(F.col("rel_path"), F.col("text")))


def route(files: DataFrame, specialized: bool = True) -> DataFrame:
    """cache, specialized:<kind> or model; needs `kind` and `hit`."""
    own = F.col("kind").isin("sql", "protobuf", "graphql", "openapi") | ((F.col("kind") == "migration") & suffix(F.col("rel_path")).isin(".sql", ".ddl"))
    out = F.when(F.col("hit"), F.lit("cache"))
    if specialized:
        out = out.when(own, F.concat(F.lit("specialized:"), F.col("kind")))
    return files.withColumn("route", out.otherwise("model"))


def select_manifests(files: DataFrame, max_depth: int = 3, limit: int = 20_000) -> DataFrame:
    """Texts of notable files, cut at `limit` characters with a mark; `place` orders them by directory, parents first, then by name."""
    parts = F.split("rel_path", "/")
    cut = F.when(F.length("text") > limit, F.concat(F.left("text", F.lit(limit)), F.lit("\n... [truncated]\n"))).otherwise(F.col("text"))
    chosen = files.where(file_name(F.col("rel_path")).isin(*NOTABLE) & (F.size(parts) - 1 <= max_depth))
    # A name that begins with a blank sorts before all directories, so a directory's own files come first.
    place = F.concat(F.slice(parts, 1, F.size(parts) - 1), F.array(F.concat(F.lit(" "), F.element_at(parts, -1))))
    return chosen.select(*KEY, cut.alias("text"), place.alias("place"))


def summarize_tree(files: DataFrame, max_depth: int = 3, top: int = 10) -> DataFrame:
    """Per directory, its own files: count, bytes, leading extensions, notable names."""
    parts = F.split("rel_path", "/")
    own = files.select(
        "repo_id",
        F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("dir"),
        F.element_at(parts, -1).alias("name"),
        F.coalesce(F.nullif(suffix(F.col("rel_path")), F.lit("")), F.lit("<noext>")).alias("ext"),
        "size",
    )
    steps = F.split("dir", "/")
    spine = own.select("repo_id", "dir").distinct().select(
        "repo_id", F.explode(F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))))).alias("dir")
    ).distinct()
    spine = spine.withColumn("depth", F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))).where(F.col("depth") <= max_depth)
    by_ext = own.groupBy("repo_id", "dir", "ext").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("name").alias("first"), F.sort_array(F.collect_set(F.when(F.col("name").isin(*NOTABLE), F.col("name")))).alias("notable"))
    rank = F.row_number().over(Window.partitionBy("repo_id", "dir").orderBy(F.desc("n"), "first"))
    dirs = by_ext.withColumn("rank", rank).groupBy("repo_id", "dir").agg(
        F.sum("n").alias("file_count"),
        F.sum("bytes").alias("total_bytes"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("rank") <= top, F.struct("rank", "ext", "n")))), lambda x: F.struct(x["ext"].alias("ext"), x["n"].alias("n"))).alias("extensions"),
        F.sort_array(F.flatten(F.collect_list("notable"))).alias("notable_files"),
    )
    zero = F.lit(0).cast("long")
    return spine.join(dirs, ["repo_id", "dir"], "left").withColumns({"file_count": F.coalesce("file_count", zero), "total_bytes": F.coalesce("total_bytes", zero)})
