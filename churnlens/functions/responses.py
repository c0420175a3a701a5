"""Column builders that turn free-text review answers into fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from churnlens.functions.text import col_, is_blank, lines

# Phrases and labels of the review answer format.
YES_PHRASE = "vulnerability existed: yes"
NOT_SURE_PHRASE = "not sure"
NO_ANALYSIS_TEXT = "AI: No analysis"
NOT_SURE_TEXT = "AI: Not Sure"
NO_VULNS_TEXT = "AI: No vulnerabilities"
UNCATEGORIZED = "Uncategorized"


def _lower_lines(resp) -> Column:
    return F.transform(lines(resp), lambda l: F.lower(l))


def _lower(resp) -> Column:
    return F.lower(F.coalesce(col_(resp), F.lit("")))


def yes_line_count(resp) -> Column:
    """Number of lines that contain the yes phrase (two on one line count once)."""
    # a match takes the rest of its line, so the next one starts on another line
    return F.regexp_count(_lower(resp), F.lit(YES_PHRASE + r"[^\n]*"))


def response_status(resp) -> Column:
    """struct(text, normalized) parsed from an answer."""
    # the phrases hold no line end, so a line has one if the text has it; a blank answer has none of them
    r, low = col_(resp), _lower(resp)
    yes, not_sure = F.contains(low, F.lit(YES_PHRASE)), F.contains(low, F.lit(NOT_SURE_PHRASE))
    text = (F.when(yes, F.format_string("AI: %d vulnerabilities", yes_line_count(r)))
            .when(not_sure, F.lit(NOT_SURE_TEXT))
            .when(is_blank(r), F.lit(NO_ANALYSIS_TEXT))
            .otherwise(F.lit(NO_VULNS_TEXT)))
    norm = (F.when(yes, F.lit("yes"))
            .when(not_sure, F.lit("not_sure"))
            .when(is_blank(r), F.lit("unknown"))
            .otherwise(F.lit("no")))
    return F.struct(text.alias("text"), norm.alias("normalized"))


def response_severity(resp) -> Column:
    """severity from the first yes line; no yes line -> 'low'."""
    low = _lower(resp)
    # line starts only, so a long line is read once; the line is bound once for all words
    first = F.regexp_extract(low, rf"(?md)^[^\n]*{YES_PHRASE}[^\n]*", 0)

    def word(line):
        return (F.when(F.contains(line, F.lit("critical")) | F.contains(line, F.lit("high")), F.lit("high"))
                .when(F.contains(line, F.lit("medium")), F.lit("medium"))
                .when(F.contains(line, F.lit("low")), F.lit("low"))
                .otherwise(F.lit("high")))

    return F.when(~F.contains(low, F.lit(YES_PHRASE)), F.lit("low")).otherwise(F.get(F.transform(F.array(first), word), 0))


def cve_answer(resp) -> Column:
    """first decisive line wins; default 'No'."""
    def decide(l):
        return (F.when(F.contains(l, F.lit("description matches: yes")), F.lit("Yes"))
                .when(F.contains(l, F.lit("description matches: no")), F.lit("No"))
                .when(F.contains(l, F.lit("matches: yes")) | F.contains(l, F.lit("match: yes")), F.lit("Yes"))
                .when(F.contains(l, F.lit("matches: no")) | F.contains(l, F.lit("match: no")), F.lit("No")))
    decided = F.filter(F.transform(_lower_lines(resp), decide), lambda x: x.isNotNull())
    return F.coalesce(F.get(decided, 0), F.lit("No"))


def normalized_status(stored, resp, status_text) -> Column:
    """stored value, else the parsed answer unless unknown, else the status text."""
    stored = F.coalesce(col_(stored), F.lit(""))
    parsed = response_status(resp)["normalized"]
    st = F.lower(F.coalesce(col_(status_text), F.lit("")))
    from_text = (F.when(F.contains(st, F.lit("not sure")), F.lit("not_sure"))
                 .when(F.contains(st, F.lit("no vulnerabilities")), F.lit("no"))
                 .when(F.contains(st, F.lit("vulnerabilities")), F.lit("yes"))
                 .otherwise(F.lit("unknown")))
    has_resp = F.coalesce(col_(resp), F.lit("")) != ""
    return (F.when(stored != "", stored)
            .when(has_resp & (parsed != "unknown"), parsed)
            .otherwise(from_text))


def is_relevant(normalized) -> Column:
    """P10: normalised status (lower-cased) is yes or not_sure."""
    return F.lower(col_(normalized)).isin("yes", "not_sure")


def confidence_class(status_text) -> Column:
    """A06: 'confirmed' / 'uncertain' / null from the status text (Q1 kept)."""
    st = F.lower(F.coalesce(col_(status_text), F.lit("")))
    return (F.when(F.contains(st, F.lit("yes")) | F.contains(st, F.lit("vulnerabilities")), F.lit("confirmed"))
            .when(F.contains(st, F.lit("not sure")), F.lit("uncertain")))


SERVICE_PATHS = {"local": ["$.response"], "openai": ["$.choices[0].message.content"],
                 "deepseek": ["$.choices[0].message.content"], "claude": ["$.content[0].text"]}


def envelope_text(body, service: str = "auto") -> Column:
    """the answer text inside a model-service JSON reply; 'No AI response' when absent.

    Per service: ``response`` (local service), ``choices[0].message.content``
    (chat completion), ``content[0].text`` (messages API); ``auto`` tries all
    three.  Only JSON strings count (a number or object there is no answer).
    """
    v = F.try_parse_json(col_(body))
    paths = SERVICE_PATHS.get(service) or ["$.response", "$.choices[0].message.content", "$.content[0].text"]

    def text_at(path):
        e = F.try_variant_get(v, path, "variant")
        return F.when(F.schema_of_variant(e) == "STRING", F.try_variant_get(v, path, "string"))

    return F.coalesce(*[text_at(p) for p in paths], F.lit("No AI response"))
