"""Definition and call tables for whole corpora, and diff context.

Symbol extraction is lexical (regular expressions per language), not a
grammar: the grammars are not available here.  The one step that needs a
loop — the extent of a definition (parameter list, then matching braces,
Python indentation or Ruby ``end``, strings and comments left out) — is a small per-file pandas function; everything after it
(signature/body split, call extraction, builtin exclusion, resolution,
changed-function detection, context text) is Catalyst.

Tables
  files:       repo, version, path, content
  definitions: repo, version, path, lang, name, is_method, seq, signature, body
  calls:       repo, version, path, lang, caller, callee, call_pos
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlens.functions.builtins import builtins_dim
from churnlens.functions.paths import analysis_language, extension, index_path_kept, lookup_extension_dim
from churnlens.functions.text import ASCII_SPACE, WORD_START, go_trim
from churnlens.session import cut_lineage

_S = ASCII_SPACE
_ID = r"[A-Za-z_][A-Za-z0-9_]*"
_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|virtual|override|async|sealed|extern|unsafe|synchronized|native|partial|new)[ \t]+)"

# Definition start patterns per language: (regex with the name in group 1, is_method).
# Lexical stand-ins for the grammar nodes each language indexes.
DEFINITION_PATTERNS: dict[str, list[tuple[str, bool]]] = {
    "php": [(rf"(?m)^[ \t]*function[ \t]+&?[ \t]*({_ID})[ \t]*\(", False),
            (rf"(?m)^[ \t]*{_MODS}+function[ \t]+&?[ \t]*({_ID})[ \t]*\(", True)],
    "python": [(rf"(?m)^[ \t]*(?:async[ \t]+)?def[ \t]+({_ID})[ \t]*\(", False)],
    "c": [(rf"(?m)^(?:[A-Za-z_][A-Za-z0-9_]*[ \t\*]+)+\**({_ID})[ \t]*\([^;{{]*\)[ \t\n]*\{{", False)],
    "cpp": [(rf"(?m)^(?:[A-Za-z_][A-Za-z0-9_:<>,]*[ \t\*&]+)+[\*&]*((?:{_ID}::)*~?{_ID})[ \t]*\([^;{{]*\)[ \t\n]*(?:const[ \t\n]*)?(?:noexcept[ \t\n]*)?(?:override[ \t\n]*)?\{{", False)],
    "csharp": [(rf"(?m)^[ \t]*{_MODS}*[A-Za-z_][A-Za-z0-9_<>,\[\]\.? ]*[ \t]+({_ID})[ \t]*(?:<[^>]*>)?[ \t]*\([^;{{]*\)[ \t\n]*(?:where[^{{]*)?(?:\{{|=>)", True)],
    "go": [(rf"(?m)^func[ \t]+({_ID})[ \t]*[\[(]", False)],
    "java": [(rf"(?m)^[ \t]*{_MODS}*(?:<[^>]*>[ \t]+)?[A-Za-z_][A-Za-z0-9_<>,\[\]\.? ]*[ \t]+({_ID})[ \t]*\([^;{{]*\)[ \t\n]*(?:throws[^{{]*)?\{{", True)],
    "javascript": [(rf"(?m)^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?function[ \t]*\*?[ \t]*({_ID})[ \t]*\(", False)],
    "typescript": [(rf"(?m)^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?(?:async[ \t]+)?function[ \t]*\*?[ \t]*({_ID})[ \t]*[<(]", False)],
    "ruby": [(r"(?m)^[ \t]*def[ \t]+(?:self\.)?([A-Za-z_][A-Za-z0-9_]*[?!=]?)", True)],
    "rust": [(rf"(?m)^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:const[ \t]+)?(?:async[ \t]+)?(?:unsafe[ \t]+)?(?:extern[ \t]+\"[^\"]*\"[ \t]+)?fn[ \t]+({_ID})[ \t]*[<(]", False)],
}
_COMPILED = {lang: [(re.compile(p), m) for p, m in pats] for lang, pats in DEFINITION_PATTERNS.items()}

# F30 fixed values: call patterns per language, applied in this order.
CALL_PATTERNS: dict[str, list[str]] = {
    "c": [rf"{WORD_START}([a-z_][a-z0-9_]*){_S}*\("],
    "cpp": [rf"{WORD_START}([a-z_][a-z0-9_]*){_S}*\("],
    "go": [rf"{WORD_START}([a-z_][a-z0-9_]*){_S}*\("],
    "rust": [rf"{WORD_START}([a-z_][a-z0-9_]*){_S}*\("],
    "java": [rf"(?:this|[a-z][a-zA-Z0-9_]*){_S}*\.{_S}*([a-z][a-zA-Z0-9_]*){_S}*\(",
             rf"{WORD_START}([a-z][a-z0-9_]*){_S}*\("],
    "csharp": [rf"(?:this|[a-z][a-zA-Z0-9_]*){_S}*\.{_S}*([a-z][a-zA-Z0-9_]*){_S}*\(",
               rf"{WORD_START}([a-z][a-z0-9_]*){_S}*\("],
    "javascript": [rf"(?:this|[a-z][a-zA-Z0-9_]*){_S}*\.{_S}*([a-z][a-zA-Z0-9_]*){_S}*\(",
                   rf"{WORD_START}([a-z][a-zA-Z0-9_]*){_S}*\("],
    "typescript": [rf"(?:this|[a-z][a-zA-Z0-9_]*){_S}*\.{_S}*([a-z][a-zA-Z0-9_]*){_S}*\(",
                   rf"{WORD_START}([a-z][a-zA-Z0-9_]*){_S}*\("],
    "python": [rf"{WORD_START}([a-z_][a-z0-9_]*){_S}*\(",
               rf"(?:self|[a-z_][a-z0-9_]*){_S}*\.{_S}*([a-z_][a-z0-9_]*){_S}*\("],
    "ruby": [rf"(?:[a-z_][a-z0-9_]*){_S}*\.{_S}*([a-z_][a-z0-9_]*)",
             rf"{WORD_START}([a-z_][a-z0-9_]*){_S}*\("],
    "php": [rf"\$this{_S}*->{_S}*([a-z_][a-zA-Z0-9_]*){_S}*\(",
            rf"(?:[A-Z][a-zA-Z0-9_]*)::{_S}*([a-z_][a-zA-Z0-9_]*){_S}*\(",
            rf"{WORD_START}([a-z_][a-z0-9_]*){_S}*\("],
}

# Calls in the body of a definition: the name that is called, in any case, whatever it is called on.
# Names after `new`, a definition keyword or another language word are no calls.
_WORDS = "if|else|for|while|do|switch|case|return|catch|new"
_WORDS_OF = {
    "php": "elseif|foreach|function|fn|match|throw|yield|and|or|xor", "python": "elif|def|class|except|with|in|is|not|and|or|lambda|yield|await|assert|raise",
    "c": "sizeof", "cpp": "sizeof|throw", "csharp": "foreach|using|lock|fixed|typeof|sizeof|throw|await|yield|in|is|when",
    "go": "func|go|defer|range|select", "java": "synchronized|throw|super|assert", "javascript": "function|typeof|throw|await|yield|in|of",
    "typescript": "function|typeof|throw|await|yield|in|of", "ruby": "def|unless|until|elsif|when|and|or|not|yield|in|self", "rust": "fn|match|loop|in|let",
}


def _callee(lang: str, first: str = "[A-Za-z_]", end: str = "") -> str:
    """A name that is no word of the language, as group 1."""
    return rf"(?!(?:{_WORDS}|{_WORDS_OF[lang]})(?![A-Za-z0-9_]))({first}[A-Za-z0-9_]*{end})"


_NOT_DEFINED = "(?<!function )(?<!func )(?<!fn )(?<!def )(?<!class )(?<!new )"


def _free(lang: str) -> str:
    # most places hold no letter: that is looked at before the words in front
    return rf"(?=[A-Za-z_]){WORD_START}{_NOT_DEFINED}{_callee(lang)}{_S}*\("


BODY_CALL_PATTERNS: dict[str, list[str]] = {
    **{lang: [_free(lang)] for lang in ("python", "go", "javascript", "typescript")},
    "php": [rf"(?<!\$){_free('php')}"],
    "csharp": [rf"{WORD_START}{_NOT_DEFINED}{_callee('csharp')}{_S}*(?:<[A-Za-z0-9_, .<>]*>)?{_S}*\("],
    # plain names only (C), and no scoped names (C++, Rust)
    "c": [rf"(?<!\.)(?<!->){_free('c')}"], "cpp": [rf"(?<!::){_free('cpp')}"], "rust": [rf"(?<!::){_free('rust')}"],
    # the first name of the call: a simple receiver, else the method
    "java": [rf"(?<![0-9A-Za-z_.]){_NOT_DEFINED}(?:this{_S}*\.{_S}*)?{_callee('java')}(?={_S}*(?:\.{_S}*{_ID}{_S}*)?\()",
             rf"(?:\.{_S}*{_ID}|[)\]]){_S}*\.{_S}*{_callee('java')}{_S}*\("],
    "ruby": [rf"(?<![0-9A-Za-z_.@$:]){_NOT_DEFINED}{_callee('ruby', '[a-z_]', '[?!]?')}(?={_S}*\.{_S}*[a-z_]|\()",
             rf"(?:{WORD_START}[A-Z][A-Za-z0-9_]*|{WORD_START}self|[)\]}}]|@[a-z_]+){_S}*\.{_S}*([a-z_][A-Za-z0-9_]*[?!]?)"],
}

# Strings and comments, which hold neither braces nor calls that count.
_SLASHES, _HASH = r"//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/", r"#[^\n]*"
_QUOTED = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
_QUOTED_LINES = r"\"(?:\\[\s\S]|[^\"\\])*\"|'(?:\\[\s\S]|[^'\\])*'"
_NO_CODE = {
    "php": rf"{_SLASHES}|{_HASH}|{_QUOTED_LINES}",
    "python": r"\"\"\"(?:[^\"]|\"(?!\"\"))*\"\"\"|'\'\'(?:[^']|'(?!''))*'\'\'" + rf"|{_HASH}|{_QUOTED}",
    "ruby": rf"{_HASH}|{_QUOTED_LINES}",
    "rust": _SLASHES + r"|\"(?:\\[\s\S]|[^\"\\])*\"|'(?:\\.|[^'\\\n])'",
    **{lang: rf"{_SLASHES}|{_QUOTED}" for lang in ("c", "cpp", "csharp", "java")},
    **{lang: rf"{_SLASHES}|{_QUOTED}|`[^`]*`" for lang in ("go", "javascript", "typescript")},
}
_NO_CODE_START = "(?=[/#\"'`])"  # where strings and comments may start
_NO_CODE_COMPILED = {lang: re.compile(p) for lang, p in _NO_CODE.items()}
_NOT_NEWLINE = re.compile(r"[^\n]")
_BRACKETS = re.compile(r"[()\[\]{}]")
_OPENS = {")": "(", "]": "[", "}": "{"}
# a bracket, with brackets that hold none, up to the one that closes it
_FLAT = r"[^()\[\]{}]*+"
_INSIDE = rf"{_FLAT}(?:(?:\({_FLAT}\)|\[{_FLAT}\]|\{{{_FLAT}\}}){_FLAT})*+"
_SHALLOW = re.compile(rf"\({_INSIDE}\)|\[{_INSIDE}\]|\{{{_INSIDE}\}}")

DEF_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("name", T.StringType()), T.StructField("is_method", T.BooleanType()),
    T.StructField("start", T.IntegerType()), T.StructField("text", T.StringType())]))


def code_only(src: str, lang: str) -> str:
    """The text with strings and comments blanked; every character stays at its place."""
    pat = _NO_CODE_COMPILED.get(lang)
    return pat.sub(lambda m: _NOT_NEWLINE.sub(" ", m[0]), src) if pat else src


def bracket_pairs(code: str) -> dict[int, int]:
    """Place of every opening bracket -> place of the one that closes it, in one pass; unclosed ones are missing."""
    pairs, waiting = {}, []
    for m in _BRACKETS.finditer(code):
        at = m.start()
        opens = _OPENS.get(code[at])
        if opens is None:
            waiting.append(at)
            continue
        while waiting:  # a bracket of another kind that was never closed is skipped
            if code[(was := waiting.pop())] == opens:
                pairs[was] = at
                break
    return pairs


def closing_place(code: str):
    """Function from the place of an opening bracket to the one that closes it (else a default).

    A bracket with one level of brackets inside is read on the spot; only a deeper or an unclosed one needs
    the pairs of the whole text, which are then found once.
    """
    pairs = None

    def closes(at: int, default: int) -> int:
        nonlocal pairs
        if m := _SHALLOW.match(code, at) if at >= 0 else None:
            return m.end() - 1
        if pairs is None:
            pairs = bracket_pairs(code)
        return pairs.get(at, default)

    return closes


def _body_end(code: str, closes, at: int, lang: str) -> int | None:
    """End of a definition whose parameter list closed before ``at``: past its body, None for a mere declaration."""
    for m in iter(lambda: _NEXT.search(code, at), None):
        ch, at = m[0], m.end()
        if ch == ";":
            return None
        if ch == "=>":
            if lang == "csharp":
                stop = code.find(";", at)
                return len(code) if stop < 0 else stop + 1
            continue
        close = closes(m.start(), len(code) - 1)
        if ch == "{":
            before = code[:m.start()].rstrip()[-9:]
            # a type, not the body
            if not ((lang == "go" and before.endswith(("interface", "struct"))) or (lang == "typescript" and before.endswith((":", "|", "&", "=>")))):
                return close + 1
        at = close + 1
    return None


_NEXT = re.compile(r"=>|[;({\[]")


def _indent_end(src: str, line_start: int, indent: int) -> int:
    pos = src.find("\n", line_start)
    if pos < 0:
        return len(src)
    end = pos
    while pos < len(src):
        nxt = src.find("\n", pos + 1)
        line = src[pos + 1: nxt if nxt >= 0 else len(src)]
        if line.strip():
            if len(line) - len(line.lstrip(" \t")) <= indent:
                break
            end = nxt if nxt >= 0 else len(src)
        if nxt < 0:
            break
        pos = nxt
    return end


def _ruby_end(src: str, line_start: int, indent: int) -> int:
    pat = re.compile(r"(?m)^[ \t]{%d}end\b" % indent)
    m = pat.search(src, line_start + 1)
    return m.end() if m else len(src)


def find_definitions(content: str, lang: str) -> list[dict]:
    """Definition starts and full text of one file (extent by braces / indentation / 'end')."""
    out = []
    if not content or lang not in _COMPILED:
        return out
    code = code_only(content, lang)
    closes = closing_place(code)
    for pat, is_method in _COMPILED[lang]:
        for m in pat.finditer(code):
            start = m.start()
            while start < len(code) and code[start] in " \t\n":
                start += 1
            line_start = code.rfind("\n", 0, start) + 1
            indent = start - line_start
            params = code.find("(", m.end(1))
            close = closes(params, params)
            if lang == "python":
                colon = code.find(":", close)
                end = _indent_end(code, colon if colon >= 0 else close, indent)
            elif lang == "ruby":
                end = _ruby_end(code, start, indent)
            else:
                end = _body_end(code, closes, close + 1, lang) if params >= 0 else None
                if end is None:
                    continue
            out.append({"name": m.group(1), "is_method": is_method, "start": start, "text": content[start:end]})
    out.sort(key=lambda d: (d["start"], d["is_method"]))
    return out


def _definitions_batch(content: pa.Array, lang: pa.Array) -> pa.Array:
    ends, found = [0], []
    for c, l in zip(content.to_pylist(), lang.to_pylist()):
        found += find_definitions(c, l)
        ends.append(len(found))
    columns = [pa.array([d[k] for d in found], t) for k, t in _DEF_ARROW.items()]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, list(_DEF_ARROW)))


_DEF_ARROW = {"name": pa.string(), "is_method": pa.bool_(), "start": pa.int32(), "text": pa.string()}

# Non-deterministic only to keep Catalyst from duplicating the call.
definitions_udf = F.arrow_udf(_definitions_batch, DEF_SCHEMA).asNondeterministic()


def split_signature(text: Column, lang: Column) -> tuple[Column, Column]:
    """signature before the first '{', body between it and the last '}' (right-trimmed).

    Python: first line / the rest.  No '{' (or at position 0): whole text is the signature.
    """
    i = F.instr(text, "{")
    last = F.length(text) - F.length(F.substring_index(text, "}", -1))  # 0 without one
    brace_sig = go_trim(F.substring(text, F.lit(1), i - 1))
    brace_body = F.when(last > i + 1, F.regexp_replace(F.substring(text, i + 1, last - i - 1), "[\n\r ]+$", "")) \
        .otherwise(F.lit(""))
    nl = F.instr(text, "\n")
    py_sig = go_trim(F.when(nl > 0, F.substring(text, F.lit(1), nl - 1)).otherwise(text))
    py_body = F.when(nl > 0, F.regexp_replace(F.substring(text, nl + 1, F.length(text)), "[\n\r ]+$", "")) \
        .otherwise(F.lit(""))
    is_py = lang == "python"
    has_brace = i > 1
    sig = F.when(is_py, py_sig).when(has_brace, brace_sig).otherwise(go_trim(text))
    body = F.when(is_py, py_body).when(has_brace, brace_body).otherwise(F.lit(""))
    return sig, body


def materialized_definitions(files: DataFrame) -> DataFrame:
    """``definitions`` and the names each calls, written once to the session's checkpoint folder.

    The definition table feeds several joins (calls, resolution, changed
    functions); materializing it runs the Python extent finder and the call
    patterns once and cuts the lineage, so a lost executor does not recompute it.
    The text is left out: signature and body hold it.
    """
    return cut_lineage(definitions(files).drop("text").withColumn("callees", body_call_names(F.col("body"), F.col("lang"))))


def definitions(files: DataFrame) -> DataFrame:
    """One row per definition of every file (lexical), with F31 signature/body."""
    f = files.select("repo", "version", "path", "content", analysis_language("path").alias("lang"))
    f = f.where((F.col("lang") != "unknown") & F.col("content").isNotNull())
    d = f.select("repo", "version", "path", "lang", F.posexplode(definitions_udf("content", "lang")).alias("seq", "d"))
    sig, body = split_signature(F.col("d.text"), F.col("lang"))
    return d.select("repo", "version", "path", "lang", F.col("d.name").alias("name"),
                    F.col("d.is_method").alias("is_method"), F.col("seq").cast("int").alias("seq"),
                    sig.alias("signature"), body.alias("body"), F.col("d.text").alias("text"))


def call_names(text: Column, lang: str) -> Column:
    """distinct callee names of a text, pattern order then position."""
    pats = CALL_PATTERNS.get(lang, [])
    if not pats:
        return F.array().cast("array<string>")
    found = [F.regexp_extract_all(text, F.lit(p), 1) for p in pats]
    return F.array_distinct(F.concat(*found)) if len(found) > 1 else F.array_distinct(found[0])


def body_call_names(body: Column, lang: Column) -> Column:
    """Distinct names that a definition's body calls, in first-seen order of each pattern."""
    def of(d: Column) -> Column:
        out = F
        for name, pats in BODY_CALL_PATTERNS.items():
            code = F.regexp_replace(d["body"], _NO_CODE_START + rf"(?:{_NO_CODE[name]})", " ")
            found = [F.regexp_extract_all(code, F.lit(p), 1) for p in pats]
            out = out.when(d["lang"] == name, F.array_distinct(F.concat(*found) if len(found) > 1 else found[0]))
        return out.otherwise(F.array().cast("array<string>"))

    # as a lambda: the generated method with the patterns of all languages is too long for the JVM to compile
    return F.get(F.transform(F.array(F.struct(body.alias("body"), lang.alias("lang"))), of), 0)


def call_names_any(text: Column, lang: Column) -> Column:
    """F30 with the language taken from a column."""
    out = F.array().cast("array<string>")
    for name in CALL_PATTERNS:
        out = F.when(lang == name, call_names(text, name)).otherwise(out)
    return out


def calls(defs: DataFrame) -> DataFrame:
    """Callees of every definition (from its body, if they aren't known), in first-seen order."""
    names = F.col("callees") if "callees" in defs.columns else body_call_names(F.col("body"), F.col("lang"))
    return defs.select("repo", "version", "path", "lang", F.col("name").alias("caller"),
                       F.posexplode(names).alias("call_pos", "callee"))


def drop_builtins(calls_df: DataFrame, name_col: str = "callee") -> DataFrame:
    """Remove calls of (language, name) builtins; unknown languages keep everything.

    The builtin table is a fixed, bounded dimension (a few thousand rows), so
    it is broadcast.
    """
    b = F.broadcast(builtins_dim(calls_df.sparkSession)
                    .withColumnRenamed("lang", "_bl").withColumnRenamed("name", "_bn"))
    return calls_df.join(b, (F.col("lang") == F.col("_bl")) & (F.col(name_col) == F.col("_bn")), "left_anti")


BROADCAST_NAMES = 50_000


def called_names(calls_df: DataFrame) -> DataFrame:
    """The distinct (repo, version, lookup_lang, name) that are called, made once; sent to every task if they are few."""
    names = cut_lineage(calls_df.select("repo", "version", F.col("lang").alias("lookup_lang"), F.col("callee").alias("name")).distinct())
    return F.broadcast(names) if names.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES else names


def _candidates(defs: DataFrame, called: DataFrame | None) -> DataFrame:
    """Definitions that lookups may return, once per lookup language; only those of ``called`` names if these are given."""
    dim = F.broadcast(lookup_extension_dim(defs.sparkSession).withColumnRenamed("lang", "lookup_lang"))
    d = defs.where(index_path_kept("path")).withColumn("ext", extension("path")).join(dim, "ext")
    return d if called is None else d.join(called, ["repo", "version", "lookup_lang", "name"], "left_semi")


def _texts(defs: DataFrame, called: DataFrame | None, t: Column) -> DataFrame:
    """Texts by place, of called names only if these are given."""
    d = defs if called is None else defs.join(called, ["repo", "version", "name"], "left_semi")
    return d.select("repo", "version", F.col("path").alias("def_path"), "name", F.col("seq").alias("def_seq"), t.alias("t"))


def first_definitions(defs: DataFrame, called: DataFrame | None = None) -> DataFrame:
    """W04 + F09 + P20: per (repo, version, lookup language, name) the definition a lookup returns.

    Candidate files are those whose extension is in the language's lookup
    list and outside excluded directories; the winner has the lowest
    extension rank, then comes first in directory-walk order (path compared
    component by component); inside one file the last definition of a name
    wins.  A min over a struct is a partial aggregate, so a name defined in a
    huge number of files is still combined map-side.  ``called`` (see
    :func:`called_names`) leaves out names that nobody looks up.
    """
    d = _candidates(defs, called)
    # files are taken in directory-walk order: compare path components, not whole strings
    # the winner is chosen on its place only; texts are looked up for winners
    best = F.min(F.struct(F.col("ext_rank"), F.split("path", "/").alias("walk"), (-F.col("seq")).alias("neg_seq"), F.col("path")))
    won = (d.groupBy("repo", "version", "lookup_lang", "name").agg(best.alias("w"))
           .select("repo", "version", F.col("lookup_lang").alias("lang"), "name", F.col("w.path").alias("def_path"),
                   (-F.col("w.neg_seq")).cast("int").alias("def_seq")))
    texts = _texts(defs, called, F.struct("signature", "body", "is_method"))
    # a file listed twice has the same place twice: the smaller text then
    return (won.join(texts, ["repo", "version", "def_path", "name", "def_seq"])
            .groupBy("repo", "version", "lang", "name", "def_path").agg(F.min("t").alias("t"))
            .select("repo", "version", "lang", "name", "def_path", "t.signature", "t.body", "t.is_method"))


def resolve_calls(calls_df: DataFrame, defs: DataFrame) -> DataFrame:
    """Calls joined to the definition a lookup returns; unresolved calls are dropped."""
    first = first_definitions(defs, called_names(calls_df)).withColumnRenamed("name", "callee")
    return calls_df.join(first, ["repo", "version", "lang", "callee"], "inner")


def ancestor_folders(path) -> Column:
    """The folders above a file, each with its final slash; '' is the root."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1),
                       lambda i: F.when(i == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))))


def folder_index(defs: DataFrame, called: DataFrame | None = None) -> DataFrame:
    """For every folder and name the definition that a lookup in that folder's tree returns: one row per (repo, version, lang, name, tree).

    A definition counts for each folder above it.  The first one by (extension rank, walk, last in
    file) is chosen on its place alone, in each task first, so a name with very many definitions is one row per
    folder and task before anything moves.
    """
    place = F.struct("ext_rank", F.split("path", "/").alias("walk"), (-F.col("seq")).alias("neg_seq"), "path")
    d = (_candidates(defs, called)
         .select("repo", "version", "lookup_lang", "name", place.alias("place"), F.explode(ancestor_folders(F.col("path"))).alias("tree")))
    return (d.groupBy("repo", "version", "lookup_lang", "name", "tree").agg(F.min("place").alias("w"))
            .select("repo", "version", F.col("lookup_lang").alias("lang"), "name", "tree", F.col("w.path").alias("def_path"),
                    (-F.col("w.neg_seq")).cast("int").alias("def_seq")))


def resolve_in_tree(calls_df: DataFrame, defs: DataFrame) -> DataFrame:
    """Like J05, but only definitions inside the calling file's directory tree count.

    An equi-join with :func:`folder_index` on (repo, version, language, name, the call's folder): every
    call meets one row, however many definitions its name has.  Texts are joined for the winners.
    """
    called = called_names(calls_df)
    tree = F.regexp_replace(F.col("path"), "[^/]*$", "")
    place = ["repo", "version", "def_path", "name", "def_seq"]
    index = folder_index(defs, called)
    # a file listed twice has the same place twice: the smaller text then
    texts = (_texts(defs, called, F.struct("signature", "body")).join(index.select(*place).distinct(), place, "left_semi")
             .groupBy(*place).agg(F.min("t").alias("t")))
    found = index.join(texts, place).withColumnRenamed("name", "callee")
    return (calls_df.distinct().withColumn("tree", tree).join(found, ["repo", "version", "lang", "callee", "tree"])
            .select(*calls_df.columns, "def_path", F.col("t.signature").alias("signature"), F.col("t.body").alias("body")))


def diff_tokens(diff_lines: DataFrame) -> DataFrame:
    """Distinct lower-cased ASCII word tokens of each diff: (repo, version, path, token)."""
    return (diff_lines.select("repo", "version", "path",
                              F.explode(F.regexp_extract_all(F.lower("line"), F.lit("[a-z0-9_]+"), 0)).alias("token"))
            .distinct())


def changed_functions(diff_lines: DataFrame, defs: DataFrame) -> DataFrame:
    """Names defined in the (new) file that occur in its diff as whole words.

    A word-boundary match of an all-word-character name equals membership
    of the lower-cased name among the diff's word tokens, so this is a
    semi join on (file, token) instead of a regex per name.
    """
    return changed_definitions(diff_lines, defs).select("repo", "version", "path", "lang", "name").distinct()


def changed_definitions(diff_lines: DataFrame, defs: DataFrame) -> DataFrame:
    """The definitions themselves, with all their columns."""
    return (defs.where(F.col("name").rlike("^[A-Za-z0-9_]+$")).withColumn("token", F.lower("name"))
            .join(diff_tokens(diff_lines), ["repo", "version", "path", "token"], "left_semi").select(*defs.columns))


def context_calls(diff_lines: DataFrame, defs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Callees of the changed functions of each diff; F30 on the diff text when there are none.

    ``texts`` (repo, version, path, text) are the whole diffs, so that a call and its bracket may stand on two
    lines; without them each line is looked at on its own.  Both halves are written once, since they are read again.
    """
    from_defs = cut_lineage(calls(changed_definitions(diff_lines, defs))
                            .select("repo", "version", "path", "lang", "callee").distinct())
    whole = diff_lines.select("repo", "version", "path", F.col("line").alias("text")) if texts is None else texts.select("repo", "version", "path", "text")
    from_text = (whole.join(from_defs.select("repo", "version", "path").distinct(), ["repo", "version", "path"], "left_anti")
                 .withColumn("lang", analysis_language("path"))
                 .select("repo", "version", "path", "lang", F.explode(call_names_any(F.col("text"), F.col("lang"))).alias("callee"))
                 .distinct())
    return from_defs.unionByName(cut_lineage(from_text))


CONTEXT_HEADER = "\n=== Function Context ===\n\nThe following functions are called in the changed code:\n\n"
CONTEXT_FOOTER = "\n=== End Function Context ===\n\n"
NO_BODY = "\n{\n  // Function body not available\n}\n"


def function_context(diff_lines: DataFrame, defs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """X13 + F24: per diff, the context text of the resolved, non-builtin callees (sorted by name)."""
    resolved = resolve_calls(drop_builtins(context_calls(diff_lines, defs, texts)), defs)
    block = F.concat(F.lit("[Function: "), F.col("callee"), F.lit("]\nLanguage: "), F.col("lang"), F.lit("\n"),
                     F.when(F.col("def_path") != "", F.concat(F.lit("File: "), F.substring_index("def_path", "/", -1),
                                                             F.lit("\n"))).otherwise(F.lit("")),
                     F.lit("\n"),
                     F.when(F.col("body") != "", F.col("body"))
                     .when(F.col("signature") != "", F.concat(F.col("signature"), F.lit(NO_BODY)))
                     .otherwise(F.lit("")))
    per = (resolved.groupBy("repo", "version", "path")
           .agg(F.array_sort(F.collect_list(F.struct(F.col("callee"), block.alias("b")))).alias("blocks"),
                F.count(F.lit(1)).alias("n_functions")))
    return per.select("repo", "version", "path", "n_functions",
                      F.concat(F.lit(CONTEXT_HEADER), F.array_join(F.transform("blocks", lambda s: s["b"]), "\n---\n\n"),
                               F.lit(CONTEXT_FOOTER)).alias("context"))
