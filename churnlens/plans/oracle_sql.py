"""DuckDB SQL fragments for the oracle side of the correctness check.

These re-state each operator in plain SQL (RE2 regex dialect, 1-based
lists) so the Spark plans are checked against an independent formulation.
They are Python functions returning SQL text so the same expression can be
reused inside several oracle queries.
"""

from __future__ import annotations

# The labelled mention in RE2 syntax, written out here so that a wrong pattern in the library shows.
CWE_LABELLED_RE2 = r"CWE-(\d+)\s*(?::|-)\s*([^\n\[]+?)(?:\s+-\s+(?:CWE-\d+|\S+\.\S+|\S+/\S+)|\s+\[|\n|$)"

# RE2 spelling of the Unicode white-space class used by the reference's trim.
WS = r"[\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def go_trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def is_blank(x: str) -> str:
    return f"({x} IS NULL OR regexp_full_match({x}, '{WS}*'))"


def lower_lines(x: str) -> str:
    return f"string_split(lower(coalesce({x}, '')), chr(10))"


def n_yes(x: str) -> str:
    return f"len(list_filter({lower_lines(x)}, lambda l: contains(l, 'vulnerability existed: yes')))"


def status_text(x: str) -> str:
    return (f"CASE WHEN {is_blank(x)} THEN 'AI: No analysis' "
            f"WHEN {n_yes(x)} > 0 THEN 'AI: ' || {n_yes(x)} || ' vulnerabilities' "
            f"WHEN contains(lower(coalesce({x}, '')), 'not sure') THEN 'AI: Not Sure' "
            f"ELSE 'AI: No vulnerabilities' END")


def status_norm(x: str) -> str:
    return (f"CASE WHEN {is_blank(x)} THEN 'unknown' WHEN {n_yes(x)} > 0 THEN 'yes' "
            f"WHEN contains(lower(coalesce({x}, '')), 'not sure') THEN 'not_sure' ELSE 'no' END")


def severity(x: str) -> str:
    first = f"list_filter({lower_lines(x)}, lambda l: contains(l, 'vulnerability existed: yes'))[1]"
    return (f"CASE WHEN {first} IS NULL THEN 'low' "
            f"WHEN contains({first}, 'critical') OR contains({first}, 'high') THEN 'high' "
            f"WHEN contains({first}, 'medium') THEN 'medium' "
            f"WHEN contains({first}, 'low') THEN 'low' ELSE 'high' END")


def cve_answer(x: str) -> str:
    decide = ("CASE WHEN contains(l, 'description matches: yes') THEN 'Yes' "
              "WHEN contains(l, 'description matches: no') THEN 'No' "
              "WHEN contains(l, 'matches: yes') OR contains(l, 'match: yes') THEN 'Yes' "
              "WHEN contains(l, 'matches: no') OR contains(l, 'match: no') THEN 'No' END")
    return (f"coalesce(list_filter(list_transform({lower_lines(x)}, lambda l: {decide}), lambda v: v IS NOT NULL)[1], 'No')")


def sanitize(desc: str, raw_id: str) -> str:
    d0 = go_trim(desc)
    suffix = f"(' - CWE-' || {raw_id})"
    d1 = (f"(CASE WHEN suffix({d0}, {suffix}) THEN {go_trim(f'left({d0}, length({d0}) - length({suffix}))')} "
          f"ELSE {d0} END)")
    parts = f"string_split({d1}, ' - ')"
    last = f"{parts}[len({parts})]"
    cond = (f"len({parts}) > 1 AND strlen({last}) < 30 AND NOT regexp_matches({last}, '[()''/]') "
            f"AND (NOT contains({last}, ' ') OR starts_with({last}, 'apps/') OR starts_with({last}, 'packages/'))")
    cut = go_trim(f"array_to_string({parts}[1:len({parts}) - 1], ' - ')")
    return f"(CASE WHEN {d0} = '' THEN '' WHEN {cond} THEN {cut} ELSE {d1} END)"


def cwe_mentions_cte(src: str, keys: str, text: str) -> str:
    """One row per labelled CWE mention: keys, pos, norm id, label (no dictionary)."""
    pat = CWE_LABELLED_RE2.replace("'", "''")
    return f"""
SELECT {keys}, pos, norm, 'CWE-' || norm || CASE WHEN name <> '' THEN ': ' || name ELSE '' END AS label
FROM (
  SELECT {keys}, pos, regexp_replace(raw_id, '^0+', '') AS norm, {sanitize('raw_desc', 'raw_id')} AS name
  FROM (
    SELECT {keys}, unnest(ids) AS raw_id, unnest(descs) AS raw_desc, unnest(generate_series(1, len(ids))) AS pos
    FROM (SELECT {keys}, regexp_extract_all({text}, '{pat}', 1) AS ids,
                 regexp_extract_all({text}, '{pat}', 2) AS descs
          FROM {src} WHERE contains({text}, 'CWE-'))
  )
) WHERE norm <> ''"""


def cwe_labels_cte(mentions: str, keys: str) -> str:
    """First mention per id, with 0-based position among kept labels."""
    part = ", ".join(k.strip() for k in keys.split(","))
    return f"""
SELECT {keys}, CAST(row_number() OVER (PARTITION BY {part} ORDER BY pos) - 1 AS INTEGER) AS cwe_pos, label AS cwe
FROM (SELECT *, row_number() OVER (PARTITION BY {part}, norm ORDER BY pos) AS k FROM {mentions}) WHERE k = 1"""
