"""Validity of source chunks and functions with their documentation, by generalised LL parsing.

Both run in one narrow pass over the chunks: a chunk is lexed and parsed by the dialects of the
language its file extension stands for. Functions are matches of the grammars' rules. Where a parse
fails, it goes on at the next line, so that whole functions of broken files come out too.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.llm import grammars
from codelode.llm.gll import ERROR
from codelode.operators.projects import project_of
from codelode.session import cut_lineage, spread

MIN_WORDS = 5
#: A description of more than this share of the files with descriptions (and of more than one) is
#: a template and says nothing about a function.
TEMPLATE_SHARE = 0.01


def extension(path: Column) -> Column:
    """The extension with its dot in lower case; empty where the last name has none."""
    name = F.substring_index(path, "/", -1)
    return F.when(F.instr(name, ".") > 1, F.concat(F.lit("."), F.lower(F.substring_index(name, ".", -1)))).otherwise(F.lit(""))


def valid(text: str | None, language: str | None) -> bool:
    """False if every dialect of the language rejects the text; null, blank and unknown ones pass."""
    if text is None or language is None:
        return True
    lang = grammars.language(language)
    return lang is None or lang.accepts(text)


# ------------------------------------------------------------------ functions of a chunk

#: Rules of the grammars whose matches are functions, and rules whose matches may begin ahead of one.
FUNCTION_RULES = {
    "java": ({"member"}, set()),
    "c": ({"item"}, set()),
    "javascript": ({"func", "cmember", "prop"}, set()),
    "typescript": ({"func", "cmember", "prop", "tmember"}, set()),
    "go": ({"func"}, set()),
    "rust": ({"fn"}, {"item"}),
    "python": ({"func"}, {"decorated"}),
    "bash": ({"fdef"}, set()),
}
#: Rules that bind a name to a value, which may be a function, and those of functions without a name.
BINDINGS, UNNAMED = {"var1", "cmember"}, {"arrow", "func"}


class _Chunk:
    """A lexed chunk: tokens of one dialect, their spans and their texts."""

    def __init__(self, text: str, language: str, dialect: int = 0):
        self.text, self.language = text, language
        self.lang = grammars.language(language)
        spans = [m.span() for m in self.lang.rx.finditer(text)]
        lexemes = [text[a:b] for a, b in spans]
        self.grammar = self.lang.dialects[dialect]
        self.toks, at = self.lang.tokens(lexemes, dialect)
        at = at if at is not None else self.lang.where(lexemes, dialect)
        self.spans = [spans[j] for j in at]
        self.words = [lexemes[j] for j in at]
        t = self.grammar.terminals
        # tokens that a layout puts in have no text of their own
        virtual = {t[x] for x in ("ASI", "NL", "INDENT", "DEDENT") if x in t}
        self.real = [k not in virtual and not w.startswith("\n") for k, w in zip(self.toks, self.words, strict=False)]
        self.breaks = [k for k, x in enumerate(text) if x == "\n"]

    def line_of(self, at: int) -> int:
        """Number of the line that holds a character, from 0."""
        return bisect_left(self.breaks, at)

    def line(self, k: int) -> str:
        return self.text[self.breaks[k - 1] + 1 if k else 0 : self.breaks[k] if k < len(self.breaks) else len(self.text)]

    def begins_line(self, i: int) -> bool:
        a = self.spans[i][0]
        return self.real[i] and self.toks[i] != ERROR and not self.text[(self.breaks[k - 1] + 1 if (k := self.line_of(a)) else 0) : a].strip()

    def end(self, b: int) -> int:
        """Offset behind the last token with text before token ``b``."""
        while b > 1 and not self.real[b - 1]:
            b -= 1
        return self.spans[b - 1][1]


def parse_chunk(text: str, language: str) -> tuple[_Chunk, bool, list]:
    """(lexed chunk, valid, events of the parser), by the first dialect that accepts the chunk.

    Where none does, the first one goes on after each rejection, with the rule for what may follow
    an error: at the rejected token if that begins a line, else at the next one that does, however
    far it is indented.
    """
    c = None
    for d in range(len(grammars.language(language).dialects)):
        x = _Chunk(text, language, d)
        ok, i, found = x.grammar.parse(x.toks)
        if ok or len(x.toks) == 1:
            return x, True, found
        if c is None:
            c, at, events = x, i, found
    n, k = len(c.toks) - 1, 0
    while True:
        k = max(k, at)
        while k < n and not c.begins_line(k):
            k += 1
        if k >= n:
            return c, False, events
        done, at, more = c.grammar.parse(c.toks, k, c.grammar.rest)
        events += more
        if done:
            return c, False, events
        k += 1


def _name_before(c: _Chunk, i: int, first: int) -> int | None:
    """Token of the function name before the parenthesis at ``i``; skips type parameters."""
    j = i - 1
    if j >= first and (c.words[j] == ">" or c.words[j] == "]" and c.language in ("go", "python")):
        closing, opening, depth = c.words[j], "<" if c.words[j] == ">" else "[", 0
        while j >= first:
            depth += (c.words[j] == closing) - (c.words[j] == opening)
            j -= 1
            if not depth:
                break
    # ``function (``: a keyword, not a name
    keyword = c.language in ("javascript", "typescript") and c.words[j] == "function" or c.language == "typescript" and c.words[j] == "new" and j == first
    return j if j >= first and re.match(r"[#\w$]", c.words[j]) and not keyword else None


def _bound(c: _Chunk, rule: str, a: int, b: int, unnamed: dict[int, int]) -> tuple[int, int] | None:
    """(name token, end) of ``name = function`` in the tokens ``a`` to ``b``; None if the value is no function."""
    w, depth, name = c.words, 0, None
    for j in range(a, b):
        x = w[j]
        if x in ("(", "[", "{"):
            depth += 1
        elif x in (")", "]", "}"):
            depth -= 1
        elif depth:
            continue
        elif x == "=" and c.real[j]:
            break
        elif x == ":" and name is not None:
            continue
        elif re.match(r"[#\w$]", x) and (name is None or w[j - 1] != ":" and rule == "cmember" and ":" not in w[a:j]):
            name = j
    else:
        return None
    if name is None or j + 1 >= b or rule == "var1" and name != a:
        return None
    if j + 1 in unnamed:
        return name, unnamed[j + 1]
    # parameters that read as an expression up to the arrow
    j += 2 if w[j + 1] == "async" else 1
    if j < b and w[j] == "(":
        depth = 0
        for j in range(j, b):  # noqa: B020
            depth += (w[j] == "(") - (w[j] == ")")
            if not depth:
                break
    return (name, b) if j + 1 < b and w[j + 1] == "=>" else None


def _after_annotations(c: _Chunk, a: int, b: int) -> int:
    """First token of a declaration behind its annotations."""
    while a < b and c.words[a] in ("@", "#") and c.language != "javascript" or a < b and not c.real[a]:
        a += 1
        depth = 0
        while a < b and (depth or re.match(r"[\w.!(\[]", c.words[a])):
            depth += (c.words[a] in "([") - (c.words[a] in ")]")
            a += 1
            if not depth and not (a < b and c.words[a] in (".", "(", "[", "!")) and c.words[a - 1] not in (".", "!"):
                break
    return a


_LINE_MARK = {"java": "//", "c": "//", "javascript": "//", "typescript": "//", "go": "//", "rust": "//", "bash": "#"}
_BETWEEN = re.compile(r"[ \t]*(?:@[\w.]+(?:\(.*\))?|#!?\[.*\])[ \t]*\r?$")


def comment_above(c: _Chunk, start: int) -> str:
    """The comment that ends on the line above the one that holds ``start``; annotations may stand between."""
    mark = _LINE_MARK.get(c.language)
    j = c.line_of(start) - 1
    while j >= 0 and _BETWEEN.match(c.line(j)):
        j -= 1
    if j < 0 or mark is None:
        return ""
    if c.language != "bash" and c.line(j).rstrip().endswith("*/"):
        k = j
        while k >= 0 and "/*" not in c.line(k):
            k -= 1
        if k < 0 or not c.line(k).lstrip().startswith("/*"):
            return ""
        return "\n".join(map(c.line, range(k, j + 1)))
    k = j
    while k >= 0 and c.line(k).lstrip().startswith(mark) and not _BETWEEN.match(c.line(k)):
        k -= 1
    return "\n".join(map(c.line, range(k + 1, j + 1)))


def _docstring(c: _Chunk, colon: int) -> str:
    """The text of the string that is the first statement behind a colon, without its quotes."""
    k, out, n = colon + 1, [], len(c.toks) - 1
    while k < n and not c.real[k]:
        k += 1
    while k < n and c.real[k]:
        m = re.fullmatch(r"""[rRuU]?(\"\"\"|\'\'\'|"|')((?s:.*))\1""", c.words[k])
        if not m:
            break
        out.append(m[2])
        k += 1
    return "".join(out) if k >= n or not c.real[k] or c.words[k] == ";" else ""


# ------------------------------------------------------------------ descriptions

_STRIP = re.compile(r"^[ \t]*(?:/\*+!?|\*+/|\*(?!\*)|//[/!]*|#+(?!\w)|--+)?[ \t]*|[ \t]*\*+/[ \t]*$|[ \t\r]+$")
_TAG = re.compile(r"^(?:@\w+|\\(?:param|return|brief)\b|:[a-z]+(?:\s+[^:]*)?:)")
_SECTION = re.compile(r"^(?:#+\s*)?(?:Args|Arguments|Parameters|Params|Keyword Args|Keyword Arguments|Attributes|Returns?|Yields?|Raises|Throws|Errors|Panics|Examples?|Notes?|See also|Safety)\s*:?$", re.I)
_NAMED = re.compile(r"^(?:[*+-]\s*)?[`'\"]?\*{0,2}[A-Za-z_$][\w$.]*[`'\"]?\s*(?:\([^)]*\))?\s*(?::|--|–)(?:\s|$)|^[*+-]\s*`[^`]*`|^`[^`]*`$|^[\w$]+\s*:?$")
_BULLET_NAME = re.compile(r"^(?:[*+-]\s*)?`[^`]*`\s*(?:[:–-].*)?$")
_TODO = re.compile(r"\b(?:TODO|FIXME|XXX|HACK|TBD|tbd)\b(?:\([^)]*\))?:?")
_HAS = re.compile(r"\w")


def description(comment: str) -> tuple[str, int]:
    """The text of a comment without marks, parameter and section lines, and its number of words."""
    kept, section = [], False
    for raw in comment.split("\n"):
        line = raw
        while True:
            new = _STRIP.sub("", line)
            if new == line:
                break
            line = new
            if not re.match(r"[ \t]*(?:\*/|/\*)", line):
                break
        line = line.strip()
        if not line:
            section = False
            continue
        if _SECTION.match(line):
            section = True
            continue
        if _TAG.match(line) or _BULLET_NAME.match(line) or (section and _NAMED.match(line)):
            continue
        line = _TODO.sub(" ", line).strip()
        if any(_HAS.match(x) for x in line):
            kept.append(line)
    text = " ".join(kept)
    return text, sum(1 for w in text.split() if re.search(r"[^\W_]", w))


def functions(text: str, language: str) -> tuple[bool, list[tuple[str, str, int, int]]]:
    """(valid, [(name, raw comment, start, end)]) of one chunk; offsets are characters of the text.

    Names, heads and bodies are what the parser matched. Of a broken chunk the functions come out
    that are whole. Methods and prototypes without a body count.
    """
    lang = grammars.language(language)
    if lang is None or language not in FUNCTION_RULES:
        return valid(text, language), []
    c, ok, events = parse_chunk(text, language)
    if len(c.toks) == 1:
        return True, []
    own, ahead = FUNCTION_RULES[language]
    spans = {e for e in events if e.__class__ is tuple}
    unnamed = {a: b for rule, a, b in spans if rule in UNNAMED}
    wider = {}
    for rule, a, b in spans:
        if rule in ahead:
            wider[b] = min(a, wider.get(b, a))
    # every mark belongs to the innermost function around it
    marks: dict[tuple, list[int]] = {}
    todo = sorted([(e[1], -e[2], e) for e in spans if e[0] in own] + [(e, 1, None) for e in {e for e in events if e.__class__ is int}], key=lambda x: x[:2])
    around: list[tuple] = []
    for at, _, span in todo:
        while around and around[-1][2] <= at:
            around.pop()
        if span is not None:
            around.append(span)
        elif around:
            marks.setdefault(around[-1], []).append(at)
    found: dict[tuple[int, int], tuple[int, int, list[int]]] = {}
    for span, at in marks.items():
        _, a, b = span
        if language == "c" and c.words[a] == "typedef":
            continue
        if span[0] == "tmember" and c.words[a] == "(" and a and re.match(r"[\w$?]", c.words[a - 1]):
            a -= 1  # read as a property and a call signature behind it
        name = next((j for i in at if c.words[i] == "(" and (j := _name_before(c, i, a)) is not None), None)
        if name is not None:
            found[name, b] = (a, b, at)
    if language in ("javascript", "typescript"):
        for rule, a, b in spans:
            got = _bound(c, rule, a, b, unnamed) if rule in BINDINGS else None
            if got:
                found[got] = (a, got[1], [])
    out = []
    for (name, _), (a, b, at) in found.items():
        a = min(a, wider.get(b, a))
        first = _after_annotations(c, a, name)
        if language == "python":
            colon = next((i for i in at if c.words[i] == ":"), None)
            comment = _docstring(c, colon) if colon is not None else ""
        else:
            comment = comment_above(c, c.spans[first][0]) or comment_above(c, c.spans[a][0])
        out.append((c.words[name].lstrip("#") if language != "rust" else c.words[name], comment, c.spans[a][0], c.end(b)))
    return ok, sorted(set(out), key=lambda x: x[2:])


# ------------------------------------------------------------------ operators


#: Extensions that a table of them may have; it becomes a literal of the plan.
MOST_EXTENSIONS = 1000


def language_column(ext_languages: DataFrame, path: Column) -> Column:
    """Language by extension, null where it is unknown. Of several languages of one extension the first by name counts."""
    rows = ext_languages.select(F.lower("ext").alias("ext"), "language").where("ext is not null and language is not null").distinct().limit(MOST_EXTENSIONS + 1).collect()
    if len(rows) > MOST_EXTENSIONS:
        raise ValueError(f"more than {MOST_EXTENSIONS} extensions")
    known: dict[str, str] = {}
    for r in sorted(rows):
        known.setdefault(r["ext"], r["language"])
    if not known:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), extension(path))


def _with_language(chunks: DataFrame, ext_languages: DataFrame, cols: list[Column]) -> DataFrame:
    """The wanted columns and ``language`` by extension; rows of unknown extensions are left out."""
    return spread(chunks.select(*cols, language_column(ext_languages, F.col("file_path")).alias("language")).where(F.col("language").isNotNull()))


def invalid_files(chunks: DataFrame, ext_languages: DataFrame) -> DataFrame:
    """``file_path`` of each file with a chunk that its language rejects, once.

    A null or blank content is valid, so is a file whose extension is unknown. Verdicts are
    merged per task before the shuffle, so one file may hold any share of the rows.
    """
    src = _with_language(chunks, ext_languages, [F.col("file_path"), F.col("content")]).select("file_path", "language", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[str] = set()
        for batch in batches:
            out = []
            for p, lang, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if p not in told and not valid(text, lang):
                    told.add(p)
                    out.append(p)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["file_path"])

    return src.mapInArrow(run, "file_path string").distinct()


def invalid_rates(chunks: DataFrame, ext_languages: DataFrame, projects: DataFrame) -> DataFrame:
    """``(project, language, n_files, n_invalid, share)`` over the files of known extensions."""
    bad = invalid_files(chunks, ext_languages).withColumn("__bad", F.lit(1))
    files = _with_language(chunks.select("file_path"), ext_languages, [F.col("file_path")]).distinct()
    both = project_of(files.join(bad, "file_path", "left"), projects)
    return both.groupBy("project", "language").agg(F.count("*").alias("n_files"), F.count("__bad").alias("n_invalid"), F.round(F.count("__bad") / F.count("*"), 6).alias("share"))


def documented_functions(chunks: DataFrame, ext_languages: DataFrame, min_words: int = MIN_WORDS, keep_invalid: bool = False, with_code: bool = True) -> DataFrame:
    """``(id, file_path, function_name, description, n_words[, code])`` of functions with a description.

    The description is the docstring in Python, else the comment directly above; where that has
    fewer than ``min_words`` words, ``summary`` stands in for the function that ``symbol`` names.
    Functions of files that do not parse are left out, or kept if they parse by themselves
    (``keep_invalid``). A name that occurs more than once in a chunk comes out once, with its
    longest description. Null content, symbol or summary give nothing. Repeated rows of an id
    give one row per name.
    """
    cols = [F.col("id"), F.col("file_path"), F.col("symbol"), F.col("summary"), F.col("content")]
    src = _with_language(chunks, ext_languages, cols).select("id", "file_path", "language", "symbol", "summary", "content")
    schema = "id bigint, file_path string, invalid boolean, function_name string, description string, n_words int" + (", code string" if with_code else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, p, lang, symbol, summary, text in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if text is None:
                    continue
                ok, found = functions(text, lang)
                if not ok:
                    rows.append((i, p, True, None, None, 0, None))
                    if not keep_invalid:
                        continue
                best: dict[str, tuple] = {}
                for name, comment, a, b in found:
                    doc, n = description(comment)
                    if n < min_words and symbol == name and summary:
                        doc, n = description(summary)
                    if n >= min_words and (name not in best or best[name][5] < n):
                        best[name] = (i, p, False, name, doc, n, text[a:b])
                rows += best.values()
            if rows:
                cols = list(zip(*rows, strict=True))[: len(names)]
                kinds = [pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names=names)

    got = cut_lineage(src.mapInArrow(run, schema))
    named = got.where(~F.col("invalid"))
    if not keep_invalid:
        bad = got.where("invalid").select("file_path").distinct()
        named = named.join(bad, "file_path", "left_anti")
    return named.drop("invalid").dropDuplicates(["id", "function_name"])


def without_templates(functions_df: DataFrame, max_share: float = TEMPLATE_SHARE) -> DataFrame:
    """Functions whose description, apart from names and numbers, occurs in at most ``max_share`` of the files.

    The share is of the files that have a description, whatever the size of the corpus; what only
    one file says is no template. Descriptions are counted by hash over all rows, map-side first.
    """
    key = F.xxhash64(F.regexp_replace(F.lower("description"), r"[^\p{L}]+", " "))
    keyed = functions_df.withColumn("__k", key)
    total = functions_df.select("file_path").distinct().agg(F.count("*").alias("__total"))
    count = keyed.select("__k", "file_path").distinct().groupBy("__k").agg(F.count("*").alias("__n")).where(F.col("__n") > 1)
    # one row of figures beside a row per repeated description
    often = count.join(F.broadcast(total), F.col("__n") > F.lit(max_share) * F.col("__total")).select("__k")
    return keyed.join(often, "__k", "left_anti").drop("__k")
