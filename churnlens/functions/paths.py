"""Column builders over file paths, names and URLs."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from churnlens.functions.text import col_

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's tables.
# ---------------------------------------------------------------------------

# Analysis language per extension (symbol extraction): extension -> language.
ANALYSIS_LANGUAGE = {
    ".c": "c", ".h": "c",
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hxx": "cpp", ".h++": "cpp",
    ".c++": "cpp", ".hh": "cpp", ".ii": "cpp", ".ixx": "cpp",
    ".cs": "csharp", ".csx": "csharp",
    ".go": "go",
    ".java": "java",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".php": "php", ".phtml": "php", ".php3": "php", ".php4": "php", ".php5": "php", ".phps": "php",
    ".py": "python", ".pyw": "python", ".pyi": "python", ".pyx": "python",
    ".rb": "ruby", ".rake": "ruby", ".gemspec": "ruby", ".ru": "ruby",
    ".rs": "rust", ".rlib": "rust",
    ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript",
}

# Display language per extension (dashboards): extension -> label.
DISPLAY_LANGUAGE = {
    ".php": "PHP", ".js": "JavaScript", ".jsx": "JavaScript", ".ts": "TypeScript",
    ".tsx": "TypeScript", ".py": "Python", ".go": "Go", ".java": "Java", ".c": "C",
    ".cpp": "C++", ".cc": "C++", ".cxx": "C++", ".cs": "C#", ".rb": "Ruby", ".rs": "Rust",
    ".swift": "Swift", ".kt": "Kotlin", ".scala": "Scala", ".pl": "Perl", ".sh": "Shell",
    ".bash": "Shell", ".sql": "SQL", ".html": "HTML", ".css": "CSS", ".vue": "Vue", ".dart": "Dart",
}

# Definition-lookup extension order per language (rank = position).
LOOKUP_EXTENSIONS = {
    "php": [".php", ".phtml", ".php3", ".php4", ".php5", ".phps"],
    "javascript": [".js", ".jsx", ".mjs", ".cjs"],
    "typescript": [".ts", ".tsx", ".mts", ".cts"],
    "python": [".py", ".pyw", ".pyi", ".pyx"],
    "java": [".java"],
    "go": [".go"],
    "ruby": [".rb", ".rake", ".gemspec", ".ru"],
    "c": [".c", ".h"],
    "cpp": [".cpp", ".hpp", ".cc", ".cxx", ".h++", ".c++", ".hh"],
    "csharp": [".cs", ".csx"],
    "rust": [".rs", ".rlib"],
}

# Path components skipped when indexing definitions.
INDEX_EXCLUDED_DIRS = [".git", "node_modules", "vendor", "tests", "__pycache__", ".vscode",
                       ".idea", "target", "build", "dist", "bin", "obj"]

# Substrings that drop a path from a product snapshot scan.
SNAPSHOT_EXCLUDED = [".git", "node_modules", ".vscode", "__pycache__", ".idea", ".DS_Store"]

# Characters that make a filename invalid.
FILENAME_FORBIDDEN = ["..", ":", "*", "?", '"', "<", ">", "|"]


def _map_literal(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(sorted(d.items()))])


def basename(c) -> Column:
    """last path segment."""
    return F.substring_index(col_(c), "/", -1)


def extension(c) -> Column:
    """lower-cased extension from the last '.' of the last segment, '' if none."""
    base = basename(c)
    return F.lower(F.regexp_extract(base, r"(\.[^.]*)$", 1))


def analysis_language(c) -> Column:
    """language used by symbol extraction, 'unknown' when not mapped."""
    return F.coalesce(F.element_at(_map_literal(ANALYSIS_LANGUAGE), extension(c)), F.lit("unknown"))


def display_language(c) -> Column:
    """language label used by dashboards, null when not mapped."""
    return F.element_at(_map_literal(DISPLAY_LANGUAGE), extension(c))


def lookup_extension_dim(spark):
    """F09 as a small dimension (lang, ext, ext_rank)."""
    rows = [(lang, ext, i) for lang, exts in LOOKUP_EXTENSIONS.items() for i, ext in enumerate(exts)]
    return spark.createDataFrame(rows, "lang string, ext string, ext_rank int")


def parse_extensions(c) -> Column:
    """P01: 'php, .JS,,' -> ['.php', '.js']; null -> []."""
    parts = F.transform(F.split(F.coalesce(col_(c), F.lit("")), ",", -1), lambda x: F.trim(x))
    kept = F.filter(parts, lambda x: x != "")
    return F.transform(kept, lambda x: F.lower(F.when(x.startswith("."), x).otherwise(F.concat(F.lit("."), x))))


def extension_allowed(path, ext_list: Column) -> Column:
    """Empty list keeps everything, else lower-cased extension must be listed."""
    return (F.size(ext_list) == 0) | F.array_contains(ext_list, extension(path))


def valid_filename(c) -> Column:
    """Non-empty, at most 255 bytes, none of the forbidden substrings."""
    c = col_(c)
    bad = F.lit(False)
    for s in FILENAME_FORBIDDEN:
        bad = bad | F.contains(c, F.lit(s))
    return (F.coalesce(c, F.lit("")) != "") & (F.octet_length(c) <= 255) & ~bad


def snapshot_path_kept(c) -> Column:
    """Drop a path containing an excluded substring or with a hidden basename."""
    c = col_(c)
    bad = basename(c).startswith(".")
    for s in SNAPSHOT_EXCLUDED:
        bad = bad | F.contains(c, F.lit(s))
    return ~bad


def index_path_kept(c) -> Column:
    """P20: no directory component (lower-cased) is excluded; files need an extension."""
    c = col_(c)
    dirs = F.slice(F.split(F.lower(c), "/", -1), 1, F.greatest(F.size(F.split(c, "/", -1)) - 1, F.lit(0)))
    excluded = F.array(*[F.lit(d) for d in INDEX_EXCLUDED_DIRS])
    return ~F.coalesce(F.arrays_overlap(dirs, excluded), F.lit(False)) & (extension(c) != "")


def valid_version(c) -> Column:
    """[a-zA-Z0-9._-]+ and at most 50 characters."""
    c = col_(c)
    return F.coalesce(c.rlike(r"^[a-zA-Z0-9._-]+$") & (F.length(c) <= 50), F.lit(False))


def valid_repo_url(c) -> Column:
    """One of the two accepted URL prefixes."""
    c = F.coalesce(col_(c), F.lit(""))
    return c.startswith("https://github.com/") | c.startswith("http://github.com/")


UUID_PATTERN = (r"^(?:urn:uuid:)?\{?[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?"
                r"[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}\}?$")


def valid_uuid(c) -> Column:
    """Canonical, urn-prefixed, braced or undashed UUID text."""
    return F.coalesce(col_(c).rlike(UUID_PATTERN), F.lit(False))


def repo_name(url) -> Column:
    """last URL segment (one trailing '/' removed), else 'repo_' + hash, 8 chars."""
    u = F.regexp_replace(col_(url), "/$", "")
    has_slash = F.contains(u, F.lit("/"))
    return F.when(has_slash, F.substring_index(u, "/", -1)).otherwise(
        F.substring(F.concat(F.lit("repo_"), F.sha2(u, 256)), 1, 8))


def client_ip(forwarded_for, remote_addr) -> Column:
    """first X-Forwarded-For entry (trimmed), else the address without port."""
    first = F.trim(F.substring_index(F.coalesce(col_(forwarded_for), F.lit("")), ",", 1))
    addr = F.coalesce(col_(remote_addr), F.lit(""))
    no_port = F.regexp_replace(addr, ":[^:]*$", "")
    return F.when(F.coalesce(col_(forwarded_for), F.lit("")) != "", first).otherwise(no_port)
