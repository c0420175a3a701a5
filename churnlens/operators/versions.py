"""Release versions: order (F20, O04), pairs (W01), next version (W02, W03), tag feeds.

Version order is a sort key built in Catalyst, so ordering, ranking and
"next/previous" are ordinary sorts and joins: no comparator runs in Python.

Key: strip one leading 'v', read '_' as '.', split on '.', pad with "0"
parts to the largest part count present in the data being ordered, and
map each part to (class, nlen, num, str):
  class 1 — starts with a digit: (nlen, num) = length and text of the digit
            prefix without leading zeros, str = '' (so "2rc1" == "2")
  class 0 — empty or first character below '0' (e.g. '-x'): str = part
  class 2 — anything else: str = part
Comparing the structs reproduces the reference's pairwise rule (numeric
when both parts have a digit prefix, else byte order), since a digit
prefix sorts between class 0 and class 2 text.  (nlen, num) orders digit
strings of any length numerically, where the reference falls back to text
past int64 (Q15).  Padding both sides of a comparison with zero parts does
not change its result, so one common pad length is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens.functions.paths import valid_version
from churnlens.functions.text import col_, go_trim
from churnlens.operators.sequence import index_within

# Every version accepted by P15 (<= 50 characters) has at most 51 parts;
# used when the caller does not supply the data's own maximum.
VERSION_PARTS = 51


def version_parts(c) -> Column:
    v = F.regexp_replace(col_(c), "^v", "")
    return F.split(F.replace(v, F.lit("_"), F.lit(".")), r"\.", -1)


def version_key(c, n_parts: int | Column = VERSION_PARTS) -> Column:
    """F20 as a sortable array<struct<class:int, nlen:int, num:string, str:string>>."""
    parts = version_parts(c)
    n = n_parts if isinstance(n_parts, Column) else F.lit(n_parts)
    padded = F.concat(parts, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), n - F.size(parts))))

    def part_key(p):
        digits = F.regexp_extract(p, "^[0-9]+", 0)
        numeric = digits != ""
        num = F.regexp_replace(digits, "^0+", "")
        cls = F.when(numeric, 1).when((p == "") | (p < "0"), 0).otherwise(2)
        return F.struct(cls.alias("class"), F.when(numeric, F.length(num)).otherwise(0).alias("nlen"),
                        F.when(numeric, num).otherwise(F.lit("")).alias("num"),
                        F.when(numeric, F.lit("")).otherwise(p).alias("str"))

    return F.transform(padded, part_key)


def max_parts(tags: DataFrame, tag: str = "tag") -> Column:
    """Largest part count among the tags, as a scalar subquery of the same plan."""
    return tags.agg(F.max(F.size(version_parts(tag))).alias("n")).scalar()


def with_version_key(tags: DataFrame) -> DataFrame:
    """The tags with their sort key, padded to the largest part count among them."""
    return tags.withColumn("_parts", max_parts(tags)).withColumn("version_key", version_key("tag", F.col("_parts"))).drop("_parts")


def compare_versions(a, b) -> Column:
    """-1 / 0 / 1 like the reference comparator."""
    ka, kb = version_key(a), version_key(b)
    return F.when(ka > kb, 1).when(ka < kb, -1).otherwise(0)


def clean_tags(tags: DataFrame, repo: str = "repo", tag: str = "tag") -> DataFrame:
    """Trimmed, valid (P15), distinct tags per repository."""
    return (tags.select(F.col(repo).alias("repo"), go_trim(F.col(tag)).alias("tag"))
            .where(valid_version("tag")).distinct())


def sorted_versions(tags: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Position of each distinct valid tag, newest version first (tag asc on ties)."""
    clean = clean_tags(tags)
    t = with_version_key(clean)
    return index_within(t, ["repo"], [F.desc("version_key"), F.asc("tag")], out="version_rank",
                        carry=carry).drop("version_key")


def release_pairs(tags: DataFrame, count: int) -> DataFrame:
    """(new_version, old_version) for the ``count`` newest adjacent pairs per repo.

    A repository with fewer than count+1 versions gets one row with
    status 'insufficient' and null versions, as the reference refuses it.
    Only the count+1 newest tags of a repository are ever ordered: the window is limited,
    and Spark limits it before the shuffle too, so a repository with very many tags is cut down in each task.
    """
    clean = clean_tags(tags)
    newest = Window.partitionBy("repo").orderBy(F.desc("version_key"), F.asc("tag"))
    top = (with_version_key(clean)
           .withColumn("n", F.row_number().over(newest)).where(F.col("n") <= count + 1))
    # at most count + 1 rows of a repository
    listed = top.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("n", "tag"))).alias("tags"))
    totals = clean.groupBy("repo").agg(F.count(F.lit(1)).alias("available_versions"))
    enough = F.col("available_versions") >= count + 1
    at = lambda i: F.get(F.col("tags"), i)["tag"]
    pairs = F.when(enough, F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.struct(
        i.cast("bigint").alias("pair_index"), at(i).alias("new_version"), at(i + 1).alias("old_version"))))
    return (totals.join(listed, "repo").select("repo", "available_versions", F.explode_outer(pairs).alias("p"), enough.alias("ok"))
            .select("repo", "p.pair_index", "p.new_version", "p.old_version", "available_versions",
                    F.when(F.col("ok"), "ok").otherwise("insufficient").alias("status")))


def tags_by_date(tags: DataFrame) -> DataFrame:
    """Distinct valid tags with their latest publication time, newest first."""
    t = (tags.select(F.col("repo"), go_trim(F.col("tag")).alias("tag"), F.col("published_at"))
         .where(valid_version("tag"))
         .groupBy("repo", "tag").agg(F.max("published_at").alias("published_at")))
    return index_within(t, ["repo"], [F.desc("published_at"), F.asc("tag")], out="date_rank", carry=["tag"])


def next_versions(tags: DataFrame, current: DataFrame) -> DataFrame:
    """W03 and W02 for each (repo, current_version).

    next_version: the tag listed just before the current one (newer by date);
    the list head when the current one is first or unknown; the current one
    itself when the repository has no tags.
    next_incremental: for 'base-suffix' tags, the first (newest) listed tag
    before the current one that starts with 'base-'; otherwise next_version.

    No list is ever sorted: the head, the neighbour and the family's newest tag are minima over the
    repository's tags, combined in each task.  ``current`` has one row per monitored repository;
    one that is monitored at several versions meets its tags once for each.
    """
    dated = (tags.select("repo", go_trim(F.col("tag")).alias("tag"), "published_at").where(valid_version("tag"))
             .groupBy("repo", "tag").agg(F.max("published_at").alias("published_at")))
    # listing order: newest first (no date last), then by tag
    dated = dated.select("repo", "tag", F.coalesce(-F.unix_micros(F.col("published_at").cast("timestamp")), F.lit((1 << 63) - 1)).alias("at"))
    cur = current.select("repo", "current_version").distinct()
    known = (cur.join(dated, (cur["repo"] == dated["repo"]) & (cur["current_version"] == dated["tag"]), "left")
             .select(cur["repo"], "current_version", F.col("at").alias("cur_at")))
    base = F.when(F.contains(F.col("current_version"), F.lit("-")), F.substring_index("current_version", "-", 1))
    seen = known.withColumn("base", base).join(dated, "repo", "left")
    place = F.struct("at", "tag")
    before = place < F.struct(F.col("cur_at").alias("at"), F.col("current_version").alias("tag"))
    family = F.contains("tag", F.lit("-")) & (F.substring_index("tag", "-", 1) == F.col("base"))
    return (seen.groupBy("repo", "current_version").agg(
                F.min(F.when(F.col("tag").isNotNull(), place))["tag"].alias("head"),
                F.max(F.when(F.col("cur_at").isNotNull() & before, place))["tag"].alias("newer"),
                F.min(F.when(F.col("cur_at").isNotNull() & before & family, place))["tag"].alias("inc"))
            .withColumn("next_version", F.coalesce("newer", "head", "current_version"))
            .select("repo", "current_version", "next_version", F.coalesce("inc", "next_version").alias("next_incremental")))


def feed_refs(feeds: DataFrame, json_col: str = "json") -> DataFrame:
    """(repo, refs) from a tag feed document; non-string elements become null (kept in place)."""
    v = F.try_parse_json(F.col(json_col))
    items = F.try_variant_get(v, "$.refs", "array<variant>")
    as_text = F.transform(F.coalesce(items, F.array().cast("array<variant>")),
                          lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))
    return feeds.select("repo", as_text.alias("refs"))


def first_tags(refs: DataFrame, limit: int | None = None) -> DataFrame:
    """W09 + S15: the refs of a feed (the first ``limit`` raw ones; None: all), trimmed and validated.

    ``refs`` is (repo, refs array<string>) where non-string JSON elements
    were already read as null; they are skipped, like the reference.
    """
    return (refs.select("repo", F.posexplode("refs").alias("pos", "tag"))
            .where(F.lit(True) if limit is None else F.col("pos") < limit).where(F.col("tag").isNotNull())
            .withColumn("tag", go_trim("tag")).where(valid_version("tag")))
