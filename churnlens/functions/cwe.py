"""CWE label extraction (F14), description cleaning (F15), id normalisation (F16).

The extraction is two regex passes over the answer text, evaluated with
``regexp_extract_all`` and folded with higher-order array functions, so a
whole findings table is labelled inside the JVM.  The optional CWE
dictionary is a bounded dimension (the public CWE list has about a thousand
entries); it is turned into a map literal only after its size is checked.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.functions.text import ASCII_NONSPACE, ASCII_SPACE, col_, go_trim

_S = ASCII_SPACE
_NS = ASCII_NONSPACE

# The labelled pattern (id, separator, description up to a
# terminator) and the bare-id pattern.  Written with ASCII classes so Java
# and RE2 agree; \z is end of text (Java's $ would also match before a final
# newline).
CWE_LABELLED = (rf"CWE-(\d+){_S}*(?::|-){_S}*([^\n\[]+?)"
                rf"(?:{_S}+-{_S}+(?:CWE-\d+|{_NS}+\.{_NS}+|{_NS}+/{_NS}+)|{_S}+\[|\n|\z)")
CWE_BARE = r"CWE-(\d+)"


def normalize_id(c) -> Column:
    """F16: trim, upper, drop 'CWE-', drop leading zeros; all zeros -> ''."""
    return F.regexp_replace(F.upper(go_trim(col_(c))), "^(?:CWE-)?0*", "")


def sanitize_description(raw, cwe_id) -> Column:
    """trim; drop a repeated ' - CWE-<id>' suffix; drop a short path-like last part."""
    return _sanitize_steps(F.struct(col_(raw).alias("raw"), col_(cwe_id).alias("id")))


def _sanitize_steps(s: Column) -> Column:
    """F15 on a struct(raw, id); each step is bound once so no sub-expression is repeated."""
    def step1(x):
        d0 = go_trim(x["raw"])
        return F.struct(x["id"].alias("id"), d0.alias("d0"), F.concat(F.lit(" - CWE-"), x["id"]).alias("suffix"))

    def step2(x):
        d1 = F.when(x["d0"].endswith(x["suffix"]),
                    go_trim(F.substring(x["d0"], F.lit(1), F.length(x["d0"]) - F.length(x["suffix"])))
                    ).otherwise(x["d0"])
        return F.struct(x["d0"].alias("d0"), d1.alias("d1"))

    def step3(x):
        return F.struct(x["d0"].alias("d0"), x["d1"].alias("d1"), F.split(x["d1"], " - ", -1).alias("parts"))

    def step4(x):
        parts = x["parts"]
        n = F.size(parts)
        last = F.get(parts, n - 1)
        short_plain = (F.octet_length(last) < 30) & ~last.rlike(r"[()'/]")
        pathish = ~F.contains(last, F.lit(" ")) | last.startswith("apps/") | last.startswith("packages/")
        cut = go_trim(F.array_join(F.slice(parts, 1, n - 1), " - "))
        d2 = F.when((n > 1) & short_plain & pathish, cut).otherwise(x["d1"])
        return F.when(x["d0"] == "", F.lit("")).otherwise(d2)

    arr = F.array(s)
    for f in (step1, step2, step3, step4):
        arr = F.transform(arr, f)
    return F.get(arr, 0)


def mentioned_ids(resp) -> Column:
    """The distinct normalised ids that an answer mentions, labelled or bare."""
    r = F.coalesce(col_(resp), F.lit(""))
    ids = F.transform(F.regexp_extract_all(r, F.lit(CWE_BARE), 1), lambda i: normalize_id(i))
    return F.array_distinct(F.filter(ids, lambda i: i != ""))


def with_dictionary(df: DataFrame, cwe_dict: DataFrame, out: str, resp: str, keys: list[str]) -> DataFrame:
    """Add ``out``, the map normalised id -> name, to every row; it holds the ids that the row's answer mentions.

    Blank ids or names are skipped; for a repeated id the last row wins (row
    order of the source).  Mentions are exploded, equi-joined with the (cwe_id, name) table
    and folded back by ``keys`` (not null; rows that share them share a map), so the
    dictionary is a table like any other, whatever its size, and Spark broadcasts it only where it is small.
    """
    clean = (cwe_dict
             .select(normalize_id("cwe_id").alias("id"), F.trim("name").alias("name"),
                     F.monotonically_increasing_id().alias("seq"))
             .where((F.col("id") != "") & (F.coalesce(F.col("name"), F.lit("")) != ""))
             .groupBy("id").agg(F.max_by("name", "seq").alias("name")))
    names = (df.select(*keys, F.explode(mentioned_ids(resp)).alias("id")).join(clean, "id")
             .groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct("id", "name"))).alias(out)))
    return df.join(names, keys, "left").withColumn(out, F.coalesce(out, F.create_map().cast("map<string,string>")))


def extract_labels(resp, names: Column | None = None) -> Column:
    """ordered, de-duplicated ``CWE-<n>[: name]`` labels of one answer.

    Pass 1 takes labelled mentions: name from the dictionary, else the
    cleaned description.  Pass 2 adds bare ids the dictionary knows.  Ids are
    compared after F16 normalisation; the first mention of an id wins.
    """
    r = F.coalesce(col_(resp), F.lit(""))
    has_cwe = F.contains(r, F.lit("CWE-"))
    ids = F.regexp_extract_all(r, F.lit(CWE_LABELLED), 1)
    descs = F.regexp_extract_all(r, F.lit(CWE_LABELLED), 2)

    def name_step(z):
        # digits only, so F16 has just zeros to drop; without ' - ' F15 has nothing to cut
        i = F.ltrim(z["ids"], F.lit("0"))
        desc = F.when(F.contains(z["descs"], F.lit(" - ")), sanitize_description(z["descs"], z["ids"])).otherwise(go_trim(z["descs"]))
        return F.struct(i.alias("id"), (F.coalesce(F.element_at(names, i), desc) if names is not None else desc).alias("name"))

    def label(z):
        text = F.concat(F.lit("CWE-"), z["id"],
                        F.when(z["name"] != "", F.concat(F.lit(": "), z["name"])).otherwise(F.lit("")))
        return F.struct(z["id"].alias("id"), text.alias("label"))

    mentions = F.filter(F.transform(F.arrays_zip(ids.alias("ids"), descs.alias("descs")), name_step),
                        lambda s: s["id"] != "")
    first = F.transform(mentions, label)
    if names is not None:
        bare = F.transform(F.regexp_extract_all(r, F.lit(CWE_BARE), 1), lambda i: normalize_id(i))
        second = F.transform(
            F.filter(bare, lambda i: (i != "") & (F.coalesce(F.element_at(names, i), F.lit("")) != "")),
            lambda i: F.struct(i.alias("id"), F.concat(F.lit("CWE-"), i, F.lit(": "), F.element_at(names, i)).alias("label")))
        candidates = F.concat(first, second)
    else:
        candidates = first

    def first_per_id(cs):
        # cs is bound once (lambda variable); first label of each id in order of first mention
        order = F.array_distinct(F.transform(cs, lambda s: s["id"]))
        several = F.transform(order, lambda i: F.get(F.filter(cs, lambda s: s["id"] == i), 0)["label"])
        return F.when(F.size(cs) > 1, several).otherwise(F.transform(cs, lambda s: s["label"]))

    labels = F.get(F.transform(F.array(candidates), first_per_id), 0)
    return F.when(has_cwe, labels).otherwise(F.array().cast("array<string>"))
