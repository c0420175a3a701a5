"""Composed comparison jobs (C01-C06): all pairs of all repositories in one plan.

Each job is a chain of the operators in ``churnlens.operators``; nothing
loops over pairs on the driver.  Model scoring is outside the library: the
jobs stop at the review-request table (diffs + context + prompt), and the
reply table is joined back with ``enrich.merge_back``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.functions.paths import extension, valid_filename
from churnlens.operators import enrich, snapshots, symbols, versions
from churnlens.session import cut_lineage
from churnlens.sources.store import Store

# Extension scope per language of a validation batch.
LANGUAGE_EXTENSIONS = {
    "php": ".php", "javascript": ".js,.jsx,.mjs", "python": ".py", "go": ".go", "java": ".java",
    "csharp": ".cs", "typescript": ".ts,.tsx", "c": ".c,.h", "cpp": ".cpp,.cc,.cxx,.hpp,.hxx,.h++",
    "ruby": ".rb", "rust": ".rs",
}


def render_changes(changes: DataFrame, files: DataFrame, keywords: str | None = None, mode: str = "product",
                   context_lines: int | None = None) -> DataFrame:
    """Review rows of aligned changes; ``files`` as for :func:`snapshots.with_contents`."""
    diffs = snapshots.render_diffs(changes, files, context_lines)
    if mode == "folder":
        diffs = snapshots.keyword_scope(diffs, keywords)
    else:
        diffs = diffs.where(valid_filename("path"))
    return diffs.select("pair_id", "repo", "old_version", "new_version", "path", "change_type", "diff", "context",
                        F.lit("unknown").alias("vuln_severity"))


def compare_snapshots(files: DataFrame | Store, pairs: DataFrame, extensions: str | None = None,
                      keywords: str | None = None, mode: str = "product", context_lines: int | None = None) -> DataFrame:
    """C01 (mode='folder') / C02 (mode='product'): review rows for every changed file of every pair.

    ``files`` is a tree scan or a store.  Product mode ignores keywords and keeps only valid file names (Q7);
    folder mode filters on keywords (P04/P05).  Output: pair_id, path,
    change_type, diff, context (the diff, or its first ``context_lines``), vuln_severity='unknown'.
    """
    listed, texts = _sides(files)
    return render_changes(snapshots.align(listed, pairs, extensions, mode), texts, keywords, mode, context_lines)


def _sides(files: DataFrame | Store) -> tuple[DataFrame, DataFrame]:
    """What is aligned and where texts come from."""
    return (files.manifest, files.contents) if isinstance(files, Store) else (files, files)


def bulk_compare(files: DataFrame | Store, tags: DataFrame, count: int, extensions: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The ``count`` newest adjacent release pairs of every repository, compared in one plan.

    Returns (results keyed by '[new→old] path', per-pair summary A22); both read one alignment, written once.
    """
    pairs = (versions.release_pairs(tags, count).where(F.col("status") == "ok")
             .select(F.format_string("%s:%s..%s", F.col("repo").cast("string"), "old_version", "new_version")
                     .alias("pair_id"), F.col("repo").cast("string").alias("repo"), "old_version", "new_version"))
    listed, texts = _sides(files)
    changes = cut_lineage(snapshots.align(listed, pairs, extensions))
    keyed = render_changes(changes, texts).withColumn(
        "result_key", snapshots.pair_label(F.col("new_version"), F.col("old_version"), F.col("path")))
    return keyed, snapshots.bulk_summary(pairs, listed, changes)


def library_compare(files: DataFrame | Store, requests: DataFrame, extensions: str | None = None) -> DataFrame:
    """Comparisons keyed on the repository URL (requests: repo_url, old_version, new_version)."""
    pairs = requests.select(F.concat_ws(":", "repo_url", "old_version", "new_version").alias("pair_id"),
                            F.col("repo_url").alias("repo"), "old_version", "new_version")
    return compare_snapshots(files, pairs, extensions)


def cve_compare(files: DataFrame | Store, requests: DataFrame, cves: DataFrame) -> DataFrame:
    """Diffs of each request seeded with the CVEs of its *old* version (J12 -> J08 -> C02).

    requests: pair_id, repo, old_version, new_version, cpe.  Blank cpe/version -> no CVE rows.
    Which files changed is written once (pair_id and path): only requests with changes meet the CVEs, and
    those of one CPE name meet one list (:func:`enrich.cves_by_name`).
    """
    diffs = cut_lineage(compare_snapshots(files, requests.select("pair_id", "repo", "old_version", "new_version")).select("pair_id", "path"))
    changed = requests.join(diffs.select("pair_id").distinct(), "pair_id", "left_semi")
    asked, name_cves = enrich.cves_by_name(changed.select(F.col("pair_id").alias("request_id"), "cpe", F.col("old_version").alias("version")), cves)
    return enrich.seed_cve_matches(diffs.join(asked.withColumnRenamed("request_id", "pair_id"), "pair_id"), name_cves, "name_id")


def review_requests(diffs: DataFrame, files: DataFrame, enable_context: bool = True) -> DataFrame:
    """E1 stop point: the prompt of every diff, with function context prepended.

    ``files`` are the new snapshots (definitions are looked up there).  Diffs
    are rendered once and read twice, for their calls and for their text.
    """
    diffs = cut_lineage(diffs.select("pair_id", "repo", "new_version", "path", "context"))
    lines = diffs.select(F.col("repo"), F.col("new_version").alias("version"), "path",
                         F.explode("context").alias("line"))
    texts = diffs.select("repo", F.col("new_version").alias("version"), "path", F.array_join("context", "\n").alias("text"))
    defs = symbols.materialized_definitions(files.select("repo", "version", "path", "content"))
    ctx = symbols.function_context(lines, defs, texts).select("repo", F.col("version").alias("new_version"), "path",
                                                        F.col("context").alias("function_context"))
    joined = diffs.withColumn("diff_text", F.array_join("context", "\n")).join(ctx, ["repo", "new_version", "path"], "left")
    body = enrich.with_context(F.col("diff_text"), F.col("function_context"), enable_context)
    return joined.select("pair_id", "path", enrich.render_prompt("main_analysis", file_path="path",
                                                                 diff_content=body).alias("prompt"))


def language_scope(spark) -> DataFrame:
    """P22 scope dimension: (language, ext) rows of the validation extension lists."""
    rows = [(lang, e.strip().lower()) for lang, exts in LANGUAGE_EXTENSIONS.items() for e in exts.split(",")]
    return spark.createDataFrame(rows, "language string, ext string")


def validation_batch(files: DataFrame, projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C06 + P22 + A25: compare each project's two versions within its language's extensions.

    projects: project, language, repo, version_1, version_2.  One alignment
    for all projects; the extension scope is an equi-join on a small
    (language, ext) dimension.  Returns (per-project summary, totals).
    """
    pairs = projects.select(F.col("project").alias("pair_id"), "repo", F.col("version_1").alias("old_version"),
                            F.col("version_2").alias("new_version"))
    scope = F.broadcast(language_scope(files.sparkSession))
    changes = (snapshots.align(files, pairs)
               .withColumn("ext", extension("path"))
               .join(projects.select(F.col("project").alias("pair_id"), "language"), "pair_id")
               .join(scope, ["language", "ext"], "left_semi"))
    summary = snapshots.bulk_summary(pairs, files, changes).withColumnRenamed("pair_id", "project")
    totals = summary.agg(F.sum(F.when(F.col("status") == "completed", 1).otherwise(0)).cast("bigint").alias("success"),
                         F.sum(F.when(F.col("status") != "completed", 1).otherwise(0)).cast("bigint").alias("failure"))
    return summary, totals
