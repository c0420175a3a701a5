"""Column builders for text: whitespace, lines, cleaning, slugs.

All builders return ``pyspark.sql.Column`` expressions so they stay inside
whole-stage codegen; nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace set of the reference's trim (Unicode White_Space
# as used by its standard library), and its ASCII-only regex classes.
GO_SPACE_CLASS = (r"[\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                  r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
ASCII_SPACE = r"[\t\n\f\r ]"          # RE2 \s
ASCII_NONSPACE = r"[^\t\n\f\r ]"      # RE2 \S
WORD_START = r"(?<![0-9A-Za-z_])"     # ASCII \b before a word
WORD_END = r"(?![0-9A-Za-z_])"        # ASCII \b after a word


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The same set as plain characters, for character-set trims (no regex).
GO_SPACE_CHARS = ("\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
                  + "\u2028\u2029\u202f\u205f\u3000")


def go_trim(c) -> Column:
    """Trim Unicode white space on both ends (not only ' ')."""
    return F.btrim(col_(c), F.lit(GO_SPACE_CHARS))


def is_blank(c) -> Column:
    """True when the text is null, empty or white space only."""
    c = col_(c)
    return c.isNull() | ~c.rlike("[^" + GO_SPACE_CLASS[1:])


def lines(c) -> Column:
    """Split on LF only (CR stays), keep empty elements."""
    return F.split(F.coalesce(col_(c), F.lit("")), "\n", -1)


def file_lines(c) -> Column:
    """Lines of a file; one trailing empty element is dropped, empty file -> []."""
    parts = lines(c)
    n = F.size(parts)
    return (F.when(F.coalesce(col_(c), F.lit("")) == "", F.array().cast("array<string>"))
            .when(F.get(parts, n - 1) == "", F.slice(parts, 1, n - 1))
            .otherwise(parts))


def line_count(c) -> Column:
    """S03 count without building the array: newlines, plus one for an unterminated last line."""
    t = F.coalesce(col_(c), F.lit(""))
    newlines = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    return F.when(t == "", F.lit(0)).otherwise(newlines + F.when(t.endswith("\n"), 0).otherwise(1))


def clean_input(c, max_bytes: int) -> Column:
    """drop C0/C1 control characters, cut to ``max_bytes`` bytes, trim."""
    s = F.regexp_replace(col_(c), r"[\x00-\x1f\x7f-\x{9f}]", "")
    return F.when(col_(c).isNull(), F.lit("")).otherwise(go_trim(utf8_prefix(s, max_bytes)))


def clean_prompt(c, max_bytes: int) -> Column:
    """like F01 but tab, LF, CR and 0x01-0x07 are kept."""
    s = F.regexp_replace(col_(c), r"[\x00\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]", "")
    return F.when(col_(c).isNull(), F.lit("")).otherwise(go_trim(utf8_prefix(s, max_bytes)))


def utf8_prefix(s: Column, max_bytes: int) -> Column:
    """Longest prefix of ``s`` whose UTF-8 encoding fits in ``max_bytes``.

    The reference cuts bytes and may leave half a character; Spark strings
    must stay valid UTF-8, so a character split by the limit is dropped.
    The first ``max_bytes`` bytes are read back as text without validation
    (a cast, not a strict decode, which fails under ANSI mode); the broken
    tail then reads as replacement characters, which are stripped.  (A real
    U+FFFD right at the cut is stripped too.)
    """
    raw = F.substring(F.encode(s, "UTF-8"), 1, max_bytes)
    decoded = raw.cast("string")
    fits = F.octet_length(s) <= max_bytes
    return F.when(fits, s).otherwise(F.regexp_replace(decoded, "\uFFFD+$", ""))


def path_slug(c) -> Column:
    """lower-case, runs of characters outside [a-z0-9] -> '_', strip '_'.

    Empty input -> 'unknown'; input made only of other characters -> 'value'.
    """
    lowered = F.lower(col_(c))
    slug = F.regexp_replace(F.regexp_replace(lowered, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return (F.when(F.coalesce(lowered, F.lit("")) == "", F.lit("unknown"))
            .when(slug == "", F.lit("value"))
            .otherwise(slug))


def format_template(template, **values) -> Column:
    """sequential placeholder replacement ``{name}`` -> value."""
    out = col_(template) if not isinstance(template, str) else F.lit(template)
    for key, val in values.items():
        out = F.replace(out, F.lit("{" + key + "}"), F.coalesce(col_(val), F.lit("")))
    return out
