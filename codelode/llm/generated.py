"""Files that nobody wrote by hand: generated, minified, copied in, or data kept as code.

Every chunk is lexed and its tokens are emitted again in a canonical layout, a statement or brace
to a line. What the original looks like against that is summed up per file, map-side first, so
that one file may hold any share of the rows: growth in lines (minified), lines equal to canonical
ones and lines whose shape the lines before foretell (generated), share of literals (data). The
shape of all chunks of a file together decides, and so does its path or a note in a comment of any
of its chunks; every file comes out with its scores.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.llm import grammars
from codelode.llm.parsing import language_column
from codelode.session import spread

#: Directory names of copied-in and of generated code, and endings of file names (fixed values).
VENDOR_DIRS = ("vendor", "vendors", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "3rd_party", "node_modules", "bower_components", "site-packages", "external", "externals", "extern", "deps", "jspm_packages", "carthage", "pods")
GENERATED_DIRS = ("generated", "__generated__", "autogen", "auto-generated", "autogenerated", "gen", "generated-sources", "gen-src")
GENERATED_NAMES = r"(?i)(\.min\.(js|mjs|css)|\.bundle\.js|\.pb\.(go|h|cc|c)|_pb2(_grpc)?\.pyi?|\.pb-c\.[ch]|_pb\.(js|d\.ts|ts)|[._-](gen|generated|autogen)\.[a-z]+|\.g\.(dart|cs)|\.designer\.cs|[.-][0-9a-f]{8,20}(\.chunk)?\.(js|css|mjs)|\.d\.min\.ts)$"

#: Notes in comments. The first group says that a tool made the file, the second that it is a copy.
GENERATED_NOTE = re.compile(
    r"""(?ix) @generated\b | <auto-?generated | \bauto-?generated\b | \b(?:code|file|source|module|class)\s+(?:was\s+|is\s+)?(?:automatically\s+)?generated\b
      | \bgenerated\s+(?:automatically|by\s+(?:the\s+)?\S+|from\s+\S+\.\w+|section|code\b|file\b) | \b(?:do\s+not|don't|never)\s+(?:edit|modify|change)\b(?=.*\b(?:generat|by\s+hand|manual|file|regenerat|$))
      | \bregenerate\s+instead\b | \bmanual\s+changes\s+will\s+be\s+(?:lost|overwritten) | \bchecksum\s+of\s+generated | \bend\s+of\s+generated | \bproduced\s+by\s+\S+\s+-- | \#\s*sourceMappingURL= | \bdo\s+not\s+modify\s+by\s+hand\b"""
)
COPIED_NOTE = re.compile(
    r"""(?ix) \bupstream\s+copy\b | \bbundled\s+copy\b | \bvendored\s+(?:from|copy|version|in)\b | \bimported\s+unchanged\b | \bcopied\s+(?:verbatim|unchanged)?\s*from\s+(?:the\s+)?\S+\s+(?:v?\d|project|library|repository)
      | \(c\)\s+(?:\d{4}\S*\s+)?(?:the\s+)?\S+\s+(?:authors|contributors)\b | \bcopyright\s+(?:\(c\)\s+)?(?:\d{4}\S*\s+)?(?:the\s+)?\S+\s+(?:authors|contributors)\b | \bv\d+\.\d+\.\d+\s*\|\s*.*\blicen[sc]e | @license\b | @preserve\b"""
)
#: Words in a note that speak about generated files rather than say that this is one.
ABOUT = re.compile(r"(?i)\b(?:renders?|compares?|helpers?|parses?|writes?|reads?|detects?|skips?|handles?|minif(?:y|ies)|checks?|lists?|finds?|removes?|keeps?|strips?|emits?|whether|if|when)\b")

LONG_LINE = 200
#: Shape limits: share of text in long lines and growth in lines when laid out canonically (minified);
#: share of code that is literals (data); share of lines that are rows of three or more literals.
LONG_SHARE, EXPANSION = 0.8, 6.0
LITERAL_SHARE, ROW_SHARE = 0.8, 0.9
MIN_CODE, MIN_ROWS = 400, 12
#: Uniform code (generated): share of lines that are canonical lines, share of lines foretold by
#: those before them, and from how many lines on; for files in many chunks: chunks for each different shape.
LAYOUT_SHARE, FORETOLD_SHARE, MIN_LINES = 0.75, 0.65, 60
CHUNKS_PER_SHAPE, MIN_CHUNKS = 20, 40

_TEXTUAL = re.compile(r"#[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'[^'\n]*'|[\w.-]+|\S")
#: Languages whose files are literals by nature; only bare numbers or uniform rows make them data.
DATA_LANGUAGES = {"json", "yaml", "toml", "css", "markdown", "sql"}
_BREAKS = {";", "{", "}"}

METRICS = ("made", "copied", "chars", "long_chars", "lines", "canon", "code", "literal", "numbers", "strings", "rows", "coded", "same", "foretold", "chunks")
#: Languages in which a line end ends a statement outside brackets.
LINE_LANGUAGES = {"python", "yaml", "toml", "bash", "javascript", "typescript", "go"}


def _is_comment(x: str, language: str) -> bool:
    if language in ("python", "bash", "toml", "yaml"):
        return x[0] == "#"
    if language == "sql":
        return x.startswith(("--", "/*"))
    if language == "markdown":
        return x.startswith("<!--")
    return x.startswith(("//", "/*"))


def _note(comment: str) -> tuple[bool, bool]:
    made = copied = False
    for line in comment.split("\n"):
        if GENERATED_NOTE.search(line):
            first = re.search(r"[A-Za-z@<#][\w<>-]*", line)
            made = made or not (first and ABOUT.fullmatch(first.group().rstrip("s")) or first and ABOUT.fullmatch(first.group()))
        if COPIED_NOTE.search(line):
            copied = True
    return made, copied


def canonical(tokens: list[tuple[str, bool]], language: str) -> list[str]:
    """Canonical lines, without white space, of the code tokens ``(text, begins a line)`` of a chunk.

    A line ends behind a brace, behind a semicolon outside parentheses, in some languages at a
    line end outside brackets, and in Python behind the colon of a block on one line.
    """
    out, cur, depth, braces = [], [], 0, 0
    by_line, python = language in LINE_LANGUAGES, language == "python"
    head = ""
    for x, begins in tokens:
        if begins and by_line and cur and depth <= 0 and (not python or braces <= 0):
            out.append("".join(cur))
            cur = []
        if not cur:
            head = x
        cur.append(x)
        c = x[0]
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif python and x in "{}":
            braces += 1 if x == "{" else -1
        elif x in _BREAKS and (depth <= 0 or c != ";") or python and x == ":" and depth <= 0 and braces <= 0 and head in _BLOCKS:
            out.append("".join(cur))
            cur = []
    if cur:
        out.append("".join(cur))
    return out


_BLOCKS = {"if", "else", "elif", "for", "while", "def", "class", "try", "except", "finally", "with", "async"}


@lru_cache(maxsize=None)
def _keywords(language: str) -> frozenset:
    return frozenset(grammars.language(language).dialects[0].terminals)


def _shape_of(x: str, keywords: frozenset) -> str:
    c = x[0]
    if c in "\"'`" and len(x) > 1:
        return "s"
    if c.isdigit() or c in "-+." and len(x) > 1 and x[1].isdigit():
        return "0"
    return x if x in keywords or not (c.isalpha() or c in "_$@#") else "w"


def measure(text: str, language: str | None) -> tuple[tuple[int, ...], int]:
    """The metrics of one chunk, in the order of ``METRICS``, and a hash of the shapes of its lines."""
    lines = [x for x in text.split("\n") if x.strip()]
    chars = sum(map(len, lines))
    long_chars = sum(len(x) for x in lines if len(x) > LONG_LINE)
    made = copied = False
    if language is None:
        return (0, 0, chars, long_chars, len(lines), *[0] * 9, 1), 0
    if language == "markdown":
        for m in re.finditer(r"<!--(?s:.*?)-->", text):
            a, b = _note(m.group())
            made, copied = made or a, copied or b
        return (int(made), int(copied), chars, 0, len(lines), *[0] * 9, 1), 0
    rx = _TEXTUAL if language == "yaml" else grammars.language(language).rx
    keywords = _keywords(language)
    code = literal = numbers = strings = directives = rows = 0
    on_line = 0  # literals on the current line, and its end
    nxt = text.find("\n")
    nxt = len(text) if nxt < 0 else nxt
    first = begins = True
    tokens: list[tuple[str, bool]] = []
    for m in rx.finditer(text):
        x = m.group()
        a = m.start()
        if a > nxt:
            rows += on_line >= 3
            on_line = 0
            begins = True
            nxt = text.find("\n", a)
            nxt = len(text) if nxt < 0 else nxt
        c = x[0]
        if c == "\n" or c == "\\":
            continue
        if language == "c" and x.lstrip()[:1] == "#":
            directives += 1
            code += len(x)
            continue
        if _is_comment(x, language):
            a2, b2 = _note(x)
            made, copied = made or a2, copied or b2
            continue
        n = len(x)
        code += n
        if c in "\"'`" and n > 1:
            literal += n
            strings += 1
            on_line += 1
            if first and language == "python" and x[:3] in ('"""', "'''"):
                a2, b2 = _note(x)
                made, copied = made or a2, copied or b2
        elif c.isdigit() or (c in "-+." and n > 1 and x[1].isdigit()):
            literal += n
            numbers += 1
            on_line += 1
        elif c == "," or (c == "-" and n == 1):
            literal += n
        tokens.append((x, begins))
        first = begins = False
    rows += on_line >= 3
    canon = canonical(tokens, language)
    # the lines as they are, without white space, and the shapes of those with a name in them
    own: list[str] = []
    shapes: list[str] = []
    named: list[str] = []
    cur: list[str] = []
    for x, begins in [*tokens, ("", True)]:
        if begins and cur:
            own.append("".join(cur))
            shape = " ".join([_shape_of(y, keywords) for y in cur])
            if "w" in shape:
                shapes.append(shape)
                named.append(own[-1])
            cur = []
        cur.append(x)
    same = sum((Counter(own) & Counter(canon)).values())
    after: dict[str, str] = {}
    foretold = 0
    seen = set(named[:1])
    for one, two, line in zip(shapes, shapes[1:], named[1:]):
        # the same line again is a copy, not the next entry of a pattern
        foretold += after.get(one) == two and line not in seen
        after[one] = two
        seen.add(line)
    numbers_out = (int(made), int(copied), chars, long_chars, len(lines), max(len(canon) + directives, 1), code, literal, numbers, strings, rows, len(shapes), min(same, len(shapes)), foretold, 1)
    return numbers_out, zlib.crc32("\n".join(shapes).encode("utf-8", "surrogatepass")) if len(shapes) > 1 else 0


def _path_reason(path: Column) -> Column:
    """The reason a path gives, or null. Directories count as whole names, so ``vendor_portal`` is none."""
    dirs = F.transform(F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(1))), F.lower)
    return (
        F.when(F.arrays_overlap(dirs, F.array(*[F.lit(x) for x in VENDOR_DIRS])), "copied: path")
        .when(F.arrays_overlap(dirs, F.array(*[F.lit(x) for x in GENERATED_DIRS])), "generated: path")
        .when(F.substring_index(path, "/", -1).rlike(GENERATED_NAMES), "generated: name")
    )


def file_shapes(chunks: DataFrame, ext_languages: DataFrame) -> DataFrame:
    """Summed metrics per file: ``(file_path, language, made, copied, chars, ..., shapes)``.

    ``shapes`` is the approximate number of different shapes among its chunks, from sketches of a
    fixed size. Null contents count as empty; a file of unknown extension has a null language.
    """
    src = _with_language_left(chunks, ext_languages)
    schema = "file_path string, language string, shape bigint, " + ", ".join(f"{m} bigint" for m in METRICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[tuple, list] = {}
            for p, lang, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                m, shape = measure(text or "", lang)
                t = total.get((p, lang, shape))
                if t is None:
                    total[p, lang, shape] = [*m]
                else:
                    for k, v in enumerate(m):
                        t[k] += v
            if total:
                cols = list(zip(*([*key, *t] for key, t in total.items()), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), *[pa.array(c, pa.int64()) for c in cols[2:]]], names=["file_path", "language", "shape", *METRICS])

    # by the shapes of their lines; copies of one text don't make a file uniform
    sketch = F.approx_count_distinct(F.when(F.col("shape") != 0, F.col("shape")), 0.05).alias("shapes")
    return src.mapInArrow(run, schema).groupBy("file_path", "language").agg(*[F.sum(m).alias(m) for m in METRICS], F.sum(F.when(F.col("shape") != 0, F.col("chunks"))).alias("shaped"), sketch)


def _with_language_left(chunks: DataFrame, ext_languages: DataFrame) -> DataFrame:
    """All rows with the language of their extension, null where it is unknown."""
    return spread(chunks.select("file_path", language_column(ext_languages, F.col("file_path")).alias("language"), "content"))


def not_hand_written(chunks: DataFrame, ext_languages: DataFrame) -> DataFrame:
    """``(file_path, reason, expansion, literal_share, layout_share, foretold_share)`` of each file that wasn't written by hand for its project, once.

    Reasons, the first that holds: copied or generated by its path or name, by a note in a
    comment, data, minified, uniform. Comments that merely speak about generated files, and string
    literals, are no notes. Small files are never data, minified or uniform. Scores are null where
    a file has no code.
    """
    s = file_shapes(chunks, ext_languages)
    c = F.col
    big = c("code") >= MIN_CODE
    plain = c("language").isin(*DATA_LANGUAGES)
    minified = big & (c("long_chars") >= LONG_SHARE * c("chars")) & (c("canon") >= EXPANSION * c("lines")) & ~c("language").isin("json", "yaml", "toml", "sql")
    blob = big & ~plain & (c("literal") >= LITERAL_SHARE * c("code"))
    numbers = (c("language") == "json") & (c("numbers") >= 30) & (c("numbers") >= 0.9 * (c("numbers") + c("strings")))
    rows = c("language").isin("json", "sql") & (c("rows") >= MIN_ROWS) & (c("rows") >= ROW_SHARE * c("lines"))
    within = (c("coded") >= MIN_LINES) & (c("same") >= LAYOUT_SHARE * c("coded")) & (c("foretold") >= FORETOLD_SHARE * c("coded"))
    across = (c("shaped") >= MIN_CHUNKS) & (c("shapes") * CHUNKS_PER_SHAPE <= c("shaped"))
    uniform = ~plain & (within | across)
    reason = F.coalesce(
        _path_reason(c("file_path")),
        F.when(c("made") > 0, "generated: note").when(c("copied") > 0, "copied: note").when(blob | numbers | rows, "data: shape").when(minified, "minified: shape").when(uniform, "generated: shape"),
    )
    share = lambda a, b: F.round(F.try_divide(c(a), c(b)), 4)
    scores = [share("canon", "lines").alias("expansion"), share("literal", "code").alias("literal_share"), share("same", "coded").alias("layout_share"), share("foretold", "coded").alias("foretold_share")]
    return s.select("file_path", reason.alias("reason"), *scores).where(c("reason").isNotNull())
