"""Coverage, section reports, lineage and review outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import is_placeholder, strip

KEY = ["repo_id", "section_id"]


def coverage(notes: DataFrame) -> DataFrame:
    """Findings and distinct files per section, and over all sections (section_id null)."""
    files = notes.groupBy(*KEY, "file").agg(F.count("*").alias("n"))
    per = files.groupBy(*KEY).agg(F.sum("n").alias("findings"), F.count("file").alias("files"))
    total = files.groupBy("repo_id", "file").agg(F.sum("n").alias("n")).groupBy("repo_id").agg(F.sum("n").alias("findings"), F.count("file").alias("files"))
    return per.unionByName(total.withColumn("section_id", F.lit(None).cast("string")))


def coverage_percent(contributing: DataFrame, state_files: DataFrame) -> DataFrame:
    """Per repository: files with findings of all files, half-even to one digit."""
    both = state_files.join(contributing, "repo_id", "full_outer").na.fill(0)
    total = F.greatest("state_files", "with_findings")
    return both.select("repo_id", total.alias("total_files"), "with_findings", F.when(total > 0, F.bround(F.col("with_findings") * 100.0 / total, 1)).otherwise(0.0).alias("percent"))


def coverage_report(notes: DataFrame, state: DataFrame, sections: Sequence[str]) -> DataFrame:
    """Coverage of every repository that has notes or a state, by section (0 where nothing was found) and in all (section_id null).

    `notes` has (repo_id, section_id, file), `state` a row for each file of the extraction state
    (repo_id, rel_path, n_findings).  Notes count where a repository has any; else the state says how many
    files there are and how many of them have findings.  Percent is half-even to one digit.
    """
    files = notes.where(F.col("section_id").isin(*sections)).groupBy(*KEY, F.coalesce("file", F.lit("")).alias("file")).agg(F.count("*").alias("n"))
    per = files.groupBy(*KEY).agg(F.sum("n").alias("findings"), F.count_if(F.col("file") != "").alias("files"))
    noted = files.where("file <> ''").select("repo_id", "file").distinct().groupBy("repo_id").agg(F.count("*").alias("noted"))
    stored = state.groupBy("repo_id").agg(F.count("*").alias("stored"), F.count_if(F.col("n_findings") > 0).alias("stored_with"))
    zero = F.lit(0).cast("long")
    both = noted.join(stored, "repo_id", "full_outer").na.fill(0)
    repos = both.unionByName(files.select("repo_id").distinct().join(both, "repo_id", "left_anti"), allowMissingColumns=True).na.fill(0)
    spine = repos.select("repo_id", F.explode(F.array(*map(F.lit, sections))).alias("section_id"))
    none = F.lit(None)
    by_section = spine.join(per, KEY, "left").select(*KEY, F.coalesce("findings", zero).alias("findings"), F.coalesce("files", zero).alias("files"), none.cast("long").alias("total_files"), none.cast("double").alias("percent"))
    has_notes = F.col("noted") > 0
    with_findings = F.when(has_notes, F.col("noted")).otherwise(F.col("stored_with"))
    total = F.when(has_notes, F.greatest("noted", "stored")).otherwise(F.col("stored"))
    found = files.groupBy("repo_id").agg(F.sum("n").alias("findings"))
    in_all = repos.join(found, "repo_id", "left").select(
        "repo_id", none.cast("string").alias("section_id"), F.coalesce("findings", zero).alias("findings"), with_findings.alias("files"), total.alias("total_files"),
        F.when(total > 0, F.bround(with_findings * 100.0 / total, 1)).otherwise(0.0).alias("percent"),
    )
    return by_section.unionByName(in_all)


def collect_upstream(bodies: DataFrame, lineage: DataFrame) -> DataFrame:
    """Populated upstream bodies of each derivative section, in declared order."""
    up = bodies.where(F.col("body").isNotNull() & ~is_placeholder(F.col("body"), "derive")).withColumnRenamed("section_id", "upstream_id")
    return up.join(F.broadcast(lineage), "upstream_id").select("repo_id", "section_id", "ord", "upstream_id", "body")


def review_outcome(critiques: DataFrame, min_score: int = 7) -> DataFrame:
    """Whether a first critique asks for a revision, and whether the revision is accepted."""
    asks = (F.size("unsupported_claims") > 0) | (F.size("gaps") > 0)
    first = critiques.where("round = 0").select(*KEY, F.col("score").alias("initial"), ((F.col("score") < min_score) & asks).alias("revise"))
    second = critiques.where("round = 1").select(*KEY, F.col("score").alias("followup"))
    return first.join(second, KEY, "left").withColumn("accepted", F.col("revise") & F.coalesce(F.col("followup") >= F.col("initial"), F.lit(False)))


def context_pack(bodies: DataFrame, sections: DataFrame) -> DataFrame:
    """All populated sections of a repository as one text, in order of the taxonomy; a repository has one body for each section."""
    body = strip(F.col("body"))
    rows = bodies.where((body != "") & ~is_placeholder(F.col("body"), "chat")).join(F.broadcast(sections), "section_id")
    parts = F.sort_array(F.collect_list(F.struct("ord", "section_id", body.alias("body"))))
    return rows.groupBy("repo_id").agg(F.array_join(F.transform(parts, lambda x: F.concat(F.lit("# "), x["section_id"], F.lit("\n\n"), x["body"])), "\n\n").alias("context"))


def section_report(repos: DataFrame, sections: Sequence[str], counts: DataFrame, bodies: DataFrame, critiques: DataFrame) -> DataFrame:
    """One row for each repository and section of the taxonomy, and the mean score of its scored sections.

    `counts` is `coverage`; a section without findings counts 0 and one without body has an empty body.
    Critiques of empty bodies do not count.  The gap shown is the first one, else the first
    unsupported claim, else that the section is unpopulated.
    """
    body = F.coalesce("body", F.lit(""))
    empty = is_placeholder(body, "report")
    rows = repos.select("repo_id").distinct().select("repo_id", F.posexplode(F.array(*map(F.lit, sections))).alias("ord", "section_id"))
    for table in (counts.where("section_id IS NOT NULL"), bodies.select(*KEY, "body"), critiques.select(*KEY, "score", "gaps", "unsupported_claims")):
        rows = rows.join(table, KEY, "left")
    rows = rows.withColumn("is_empty", empty).withColumn("scored", ~F.col("is_empty") & (strip(body) != "") & F.col("score").isNotNull())
    gap = (
        F.when(F.col("scored") & (F.size("gaps") > 0), F.substring(F.get("gaps", F.lit(0)), 1, 60))
        .when(F.col("scored") & (F.size("unsupported_claims") > 0), F.concat(F.lit("unsupported: "), F.substring(F.get("unsupported_claims", F.lit(0)), 1, 50)))
        .when(F.col("is_empty"), "no findings")
        .otherwise("")
    )
    score = F.when(F.col("scored"), F.col("score"))
    return rows.select(
        "repo_id", "ord", "section_id", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("findings", F.lit(0)).alias("findings"),
        F.length(body).cast("long").alias("body_chars"), "is_empty", score.alias("score"), gap.alias("gap"),
        F.avg(score).over(Window.partitionBy("repo_id")).alias("overall"),  # as many rows as sections
    )


def derivation_path(sections: DataFrame, upstream: DataFrame, state: DataFrame, review: bool = False) -> DataFrame:
    """What becomes of each derivative section of each repository, and whether it is stored when that succeeds.

    `sections` holds (repo_id, section_id) of all derivative sections, `upstream` their `upstream_hash`
    where there is something to derive from, `state` the stored `upstream_hash` and `revised`.  Without
    upstream a section is skipped, and stored as empty.  A stored body of the same upstream is reused,
    under review only if it was revised.
    """
    was = state.select(*KEY, F.col("upstream_hash").alias("was"), "revised")
    both = sections.select(*KEY).join(upstream.select(*KEY, "upstream_hash"), KEY, "left").join(was, KEY, "left")
    same = (F.col("was") == F.col("upstream_hash")) & (F.coalesce("revised", F.lit(False)) if review else F.lit(True))
    path = F.when(F.col("upstream_hash").isNull(), "skipped").when(F.coalesce(same, F.lit(False)), "cached").otherwise("derive")
    return both.select(*KEY, path.alias("path"), (path != "cached").alias("stored_on_success"), F.coalesce("upstream_hash", F.lit("")).alias("upstream_hash"))


def derivation_rows(paths: DataFrame, answers: DataFrame, review: bool = False) -> DataFrame:
    """State rows after the answers (repo_id, section_id, body, ok): failures and reused bodies are not stored again."""
    out = paths.where("stored_on_success").join(answers.select(*KEY, "body", "ok"), KEY, "left")
    kept = out.where((F.col("path") == "skipped") | F.coalesce("ok", F.lit(False)))
    return kept.select(*KEY, "upstream_hash", F.when(F.col("path") == "skipped", "").otherwise(F.col("body")).alias("body"), F.lit(review).alias("revised"))
