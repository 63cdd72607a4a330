"""Top-level definitions of source files, for every language that has definition types.

A file is lexed once into words, brackets, literals and comments; at bracket depth 0 the tokens
fall into items: statements, declarations, comments. An item whose head (its tokens at depth 0 up
to the body) matches the language's pattern is a definition. Nothing has to parse: stray closing
brackets are passed over, and an item whose brackets never close ends where the next definition
begins at the start of a line. The patterns stand for the definition types of the inventory, so
exported functions, templates or records are items, but no definitions.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache

from codelode import schema

_WORD = r"[^\W\d][\w$]*|[$@#]?[\w$]+"
_DQ, _SQ = r'"(?:[^"\\\n]|\\(?s:.))*"', r"'(?:[^'\\\n]|\\(?s:.))*'"
_C_COMMENT = r"/\*(?s:.*?)(?:\*/|\Z)|//[^\n]*"
_TEMPLATE = r"`(?:[^`\\]|\\(?s:.))*`"
_TRIPLE = r'"""(?s:.*?)"""'
_ATTRIBUTES = r"(?:@[\w$]+(?: [.:] \w+)*(?: \(\))? )*"
_TYPED = r"(?:[\w.:$]+|<|>|,|\?|&|\*|\[\]|::)"


@dataclass(frozen=True)
class Syntax:
    """How a language is lexed and what its definitions look like."""

    literals: str
    comments: str
    head: str  # matched at the start of an item's head; a group holds the name
    line_ends: bool = False  # a line end ends a statement that can end there
    needs_body: str = r"(?!)"  # heads that are definitions only with a body in braces
    body: str = "brace"


_FUNCTION = r"(?:async )?function ([\w$]+)"
_JS = rf"{_FUNCTION}|{_ATTRIBUTES}class ([\w$]+)"
_TS = rf"{_JS}|interface ([\w$]+)|type ([\w$]+)(?: <.*?>)? ="
_JS_LIT = rf"{_TEMPLATE}|{_DQ}|{_SQ}|(?<=[(,=:\[!&|?{{}};])[ \t]*/(?![*/\s])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*"
_JAVA_MODS = rf"{_ATTRIBUTES}(?:(?:public|private|protected|static|final|abstract|sealed|synchronized|native|strictfp|default|non - sealed) {_ATTRIBUTES})*"
_C_FUNCTION = rf"(?!typedef\b|struct \w* ?{{|return\b|if\b|while\b|for\b|switch\b|else\b)(?:{_TYPED} )+?(~? ?[\w:]+(?: :: [~\w]+)*) \(\)(?! \(\))[^=]*"
_SCALA_MODS = r"(?:@\w+ (?:\(\) )?)*(?:(?:private|protected)(?: \[\])? |override |final |sealed |abstract |implicit |lazy |case |inline |open |opaque |transparent )*"
_KT_MODS = rf"{_ATTRIBUTES}(?:(?:public|private|internal|protected|open|abstract|final|sealed|data|inline|value|enum|annotation|suspend|override|tailrec|operator|infix|external|inner|companion|expect|actual|fun) )*?"
_SWIFT_MODS = rf"{_ATTRIBUTES}(?:(?:public|private|fileprivate|internal|open|final|static|mutating|indirect|override|nonisolated|async|prefix|postfix)(?: \(\))? {_ATTRIBUTES})*"
_CS_MODS = r"(?:\[\] )*(?:(?:public|private|protected|internal|static|sealed|abstract|partial|readonly|unsafe|ref|file|new) )*"
_RUST_VIS = r"(?:pub (?:\(\) )?)?"

SYNTAX = {
    "python": Syntax(rf"(?:\b[rRbBuUfF]{{1,2}})?(?:{_TRIPLE}|'''(?s:.*?)'''|{_DQ}|{_SQ})", r"#[^\n]*", r"(?:@.*? NL )*(?:async )?(?:def|class) (\w+)", body="indent"),
    "javascript": Syntax(_JS_LIT, _C_COMMENT, _JS, True),
    "typescript": Syntax(_JS_LIT, _C_COMMENT, rf"{_TS}|(?:const )?enum ([\w$]+)", True, _FUNCTION),
    "tsx": Syntax(_JS_LIT, _C_COMMENT, _TS, True, _FUNCTION),
    "go": Syntax(rf"`[^`]*`|{_DQ}|'(?:[^'\\\n]|\\.)+'", _C_COMMENT, r"func (?:\(\) )?(\w+)|type (\w+)|type (\(\))", True),
    "rust": Syntax(
        rf"b?r\#+\"(?s:.*?)\"\#+|b?\"(?:[^\"\\]|\\(?s:.))*\"|b?'(?:[^'\\\n]|\\(?:u\{{[^}}]*\}}|x..|.))'", _C_COMMENT,
        rf"{_RUST_VIS}(?:(?:const|async|unsafe|default|extern(?: STR)?) )*fn (\w+)|(?:unsafe |default )?impl\b(?: <.*?>(?= [\w:!&(\[]))?(?: !)?(?: [^{{]*? for)? (?:& |dyn |mut )*(?:\w+ :: )*(\w+)|{_RUST_VIS}(?:unsafe )?(?:struct|enum|trait|type) (\w+)",
        needs_body=rf"{_RUST_VIS}(?:(?:const|async|unsafe|default|extern(?: STR)?) )*fn ",
    ),
    "java": Syntax(rf"{_TRIPLE}|{_DQ}|{_SQ}", _C_COMMENT, rf"{_JAVA_MODS}(?:class|interface|enum) (\w+)|{_JAVA_MODS}(?!(?:record|return|new|throw|else|assert|yield) )(?:< .*? > )?(?:{_TYPED} )+?(\w+) \(\)(?: \[\])*(?: throws [\w., ]+)?(?: [{{;]|$)|{_JAVA_MODS}(?!(?:if|for|while|switch|catch|synchronized|try|do) )(\w+) \(\)(?: throws [\w., ]+)? {{"),
    "c": Syntax(rf"{_DQ}|{_SQ}", rf"{_C_COMMENT}|^[ \t]*\#(?:[^\n\\]|\\(?s:.))*", rf"{_C_FUNCTION}|(?:struct|enum) (\w+) {{|(?:struct|enum) ({{)", needs_body=_C_FUNCTION),
    "cpp": Syntax(rf"R\"\((?s:.*?)\)\"|{_DQ}|{_SQ}", rf"{_C_COMMENT}|^[ \t]*\#(?:[^\n\\]|\\(?s:.))*", rf"(?!template\b){_C_FUNCTION}|(?:inline )?namespace ([\w:]+(?: :: \w+)*)?|(?:class|struct|enum(?: class| struct)?) (\w+)[^=;]*{{|(?:struct|enum) ({{)", needs_body=_C_FUNCTION),
    "ruby": Syntax(rf"{_DQ}|{_SQ}", r"#[^\n]*|^=begin(?s:.*?)^=end", r"(?:def|class|module) ([\w:.?!=]+)", body="end"),
    "php": Syntax(rf"{_DQ}|{_SQ}", rf"{_C_COMMENT}|\#(?!\[)[^\n]*|<\?php|\?>", r"function (?:& )?(\w+)|(?:(?:abstract|final|readonly) )*class (\w+)"),
    "swift": Syntax(rf"{_TRIPLE}|{_DQ}", _C_COMMENT, rf"{_SWIFT_MODS}(?:func|class|struct|enum|extension|actor|protocol) ([\w.]+|[^\w\s(]+)", True),
    "kotlin": Syntax(rf"{_TRIPLE}|{_DQ}|{_SQ}", _C_COMMENT, rf"{_KT_MODS}(?:class|interface|object) (\w+)|{_KT_MODS}fun (?:<.*?> )?(?:[\w?<>, ]+ \. )?(\w+) \(\)", True),
    "scala": Syntax(rf"{_TRIPLE}|{_DQ}|'(?:[^'\\\n]|\\.)'", _C_COMMENT, rf"{_SCALA_MODS}(?:def|class|object|trait) (\w+|[^\w\s(]+)", True),
    "c_sharp": Syntax(rf"@\"(?:[^\"]|\"\")*\"|{_DQ}|{_SQ}", rf"{_C_COMMENT}|^[ \t]*\#[^\n]*", rf"{_CS_MODS}(?:class|interface|struct|enum) (\w+)"),
    "lua": Syntax(rf"\[\[(?s:.*?)\]\]|{_DQ}|{_SQ}", r"--\[\[(?s:.*?)\]\]|--[^\n]*", r"(?:local )?function ([\w.:]+)", body="end"),
}

_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
#: What a line may not end with, and what the next may not begin with, for a statement to end there.
_GOES_ON = {"=", "+", "-", "*", "/", "%", "&", "|", "^", "<", ",", ".", "?", ":", "!", "~", "=>", "->", "&&", "||", "extends", "implements", "with", "where"}
_FOLLOWS = {"=", "+", "*", "/", "%", "&", "|", "^", ">", ",", ".", "?", ":", "{", "=>", "->", "&&", "||", "else", "catch", "finally", "extends", "implements", "with", "where", "instanceof", "in", "throws"}
#: Heads that go on behind their braces, up to a semicolon.
_TYPES = re.compile(r"(?:typedef|struct|enum|union|class|static|const|extern)\b")


_ONLY_ATTRIBUTES = re.compile(_ATTRIBUTES)


@lru_cache(maxsize=None)
def _compiled(language: str):
    s = SYNTAX[language]
    rx = re.compile(rf"(?P<c>{s.comments})|(?P<s>{s.literals})|(?P<n>\n)|(?P<x>\\\r?\n)|(?P<w>{_WORD})|(?P<p>=>|->|::|&&|\|\||[^\s\w])", re.M)
    return s, rx, re.compile(s.head), re.compile(s.needs_body)


@dataclass
class Item:
    """A run of tokens at depth 0: offsets, its head, where its braces end, and whether they close."""

    start: int
    end: int
    head: str
    braced: int = 0
    closed: bool = True
    comment: bool = False


def _brace_items(text: str, language: str) -> list[Item]:
    s, rx, _, _ = _compiled(language)
    toks = [(m.lastgroup, m.group(), m.start(), m.end()) for m in rx.finditer(text) if m.lastgroup != "x"]
    out: list[Item] = []
    item: Item | None = None
    words: list[str] = []
    depth, in_head = 0, True
    stack: list[str] = []

    def close(end: int) -> None:
        nonlocal item, words, in_head
        item.end, item.head = end, " ".join(words)
        out.append(item)
        item, words, in_head = None, [], True

    last = ""
    for k, (kind, x, a, b) in enumerate(toks):
        if kind == "c":
            if item is None:
                out.append(Item(a, b, "", comment=True))
            continue
        if kind == "n":
            if item is not None and not depth and s.line_ends and last not in _GOES_ON:
                j = k + 1
                while j < len(toks) and toks[j][0] in "nc":
                    j += 1
                nxt = toks[j][1] if j < len(toks) else ""
                if (nxt not in _FOLLOWS or nxt == "{" and item.braced) and not _ONLY_ATTRIBUTES.fullmatch(" ".join(words) + " "):
                    close(item.end)
            continue
        if x in _CLOSE and kind == "p":
            if stack and x == stack[-1]:
                stack.pop()
                depth -= 1
                item.end = b
                if not depth:
                    if x == "}":
                        item.braced = b
                    if in_head and x != "}":
                        words.append({")": "()", "]": "[]"}[x])
                    if x == "]" and words[:1] == ["#"] and language == "rust":
                        close(b)
                    elif x == "}" and _ends_here(language, " ".join(words), s):
                        close(b)
            elif x in stack:  # brackets in between were never closed
                while stack.pop() != x:
                    depth -= 1
                depth -= 1
                item.end = b
                if not depth:
                    item.braced = b
                    close(b)
            last = x
            continue
        if item is None:
            if x == ";" and kind == "p":
                continue
            item = Item(a, b, "")
        item.end = b
        last = x
        if x in _OPEN and kind == "p":
            if not depth and x == "{" and in_head:
                words.append("{")
                in_head = False
            stack.append(_OPEN[x])
            depth += 1
        elif not depth:
            if x == ";" and kind == "p":
                if in_head:
                    words.append(";")
                close(b)
            elif in_head:
                words.append("STR" if kind == "s" else x)
                if x in ("=", "=>") and kind == "p":
                    in_head = language in ("kotlin", "scala")  # the type of a parameter may follow
    if item is not None:
        item.closed = not depth
        close(item.end)
    return out


def _ends_here(language: str, head: str, s: Syntax) -> bool:
    """Whether the closing brace that leads back to depth 0 ends the item."""
    if s.line_ends:
        return False  # the line end does, or what follows it
    if language in ("c", "cpp") and _TYPES.match(head) and not re.search(r"\(\)[^=]*{$", head):
        return False
    return " = " not in f" {head} "


def _indent_items(text: str) -> list[Item]:
    """Logical lines at indentation 0 with all that is indented below them."""
    _, rx, _, _ = _compiled("python")
    out: list[Item] = []
    item: Item | None = None
    words: list[str] = []
    depth, new_line, decorated = 0, True, False
    for m in rx.finditer(text):
        kind, x, a, b = m.lastgroup, m.group(), m.start(), m.end()
        if kind == "n":
            if not depth:
                new_line = True
            continue
        at_margin = new_line and (a == 0 or text[a - 1] == "\n")
        if kind == "c":
            if at_margin and not depth:
                out.append(Item(a, b, "", comment=True))
            continue
        if kind == "x":
            continue
        # a definition at the margin ends brackets that were never closed
        margin = a == 0 or text[a - 1] == "\n"
        if depth and margin and re.match(r"(?:async[ ]+def|def|class)\b|@\w", text[a : a + 20]):
            depth, at_margin = 0, True
        goes_on = x in ("else", "elif", "except", "finally", "case") and item is not None and not decorated
        if at_margin and not (goes_on or decorated or x in _CLOSE):
            if item is not None:
                out.append(item)
            item, words = Item(a, b, ""), []
        if at_margin:
            decorated = x[0] == "@"
        if item is None:
            item = Item(a, b, "")
        if new_line and words and not depth:
            words.append("NL")
        new_line = False
        if len(words) < 80:
            words.append(x if kind != "s" else "STR")
            item.head = " ".join(words)
        item.end = b
        if kind == "p":
            depth = depth + 1 if x in _OPEN else max(0, depth - 1) if x in _CLOSE else depth
    if item is not None:
        out.append(item)
    return sorted(out, key=lambda i: i.start)


_ENDS = re.compile(r"end\b")


def _end_items(text: str, language: str) -> list[Item]:
    """Lines at indentation 0; a definition goes on to the ``end`` at its own indentation."""
    _, rx, head, _ = _compiled(language)
    hidden = {a: m.end() for m in rx.finditer(text) if m.lastgroup in ("c", "s") for a in [m.start()]}
    out: list[Item] = []
    at, until = 0, -1
    item: Item | None = None
    for line in text.split("\n"):
        a, b = at, at + len(line.rstrip())
        at += len(line) + 1
        # lines within a literal or comment of several lines say nothing
        inside = a < until
        for p in range(a, b):
            if p >= until and p in hidden:
                until = hidden[p]
        if inside or b <= a:
            if item is not None and inside and b > a:
                item.end = b
            continue
        if line[:1] in " \t":
            if item is not None:
                item.end = b
            continue
        body = text[a:b]
        if item is not None and not item.closed:
            if _ENDS.match(body) or not head.match(_spaced(body)):
                item.end = b
                item.closed = bool(_ENDS.match(body))
                continue
        item = Item(a, min(max(b, until), len(text)) if body[:2] in ("--", "#", "=b") else b, _spaced(body), comment=a in hidden and text[a] in "#-=")
        # a definition on one line, or one without ``end``, is closed
        item.closed = not head.match(item.head) or bool(re.search(r"\bend\s*$", body)) or bool(re.match(r"def\s+[\w.?!]+(?:\([^)]*\))?\s*=", body))
        out.append(item)
    return out


def _spaced(line: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"([(<;])", r" \1", line)).strip()


def _resync(text: str, item: Item, language: str) -> int:
    """Where an item whose brackets never close ends: before the next definition at a line start."""
    _, _, head, _ = _compiled(language)
    for m in re.finditer(r"\n(?=[^\s#/*}\])])", text[item.start : item.end]):
        at = item.start + m.end()
        line = text[at : text.find("\n", at) if text.find("\n", at) >= 0 else len(text)]
        plain = re.sub(r"\([^()]*\)", " () ", re.sub(r"([{}<>;:@*&=,])", r" \1 ", line))
        if head.match(re.sub(r"\s+", " ", plain).strip()):
            return at
    return item.end


def items(text: str, language: str) -> list[Item]:
    """The items of a file at depth 0, comments included, in order."""
    s = SYNTAX[language]
    if s.body == "indent":
        return _indent_items(text)
    if s.body == "end":
        return _end_items(text, language)
    out, base = [], 0
    while True:
        found = _brace_items(text[base:], language)
        for i in found:
            i.start, i.end, i.braced = i.start + base, i.end + base, i.braced and i.braced + base
        if not found or found[-1].closed:
            return out + found
        cut = _resync(text, found[-1], language)
        if cut >= found[-1].end:
            return out + found
        tail = found.pop()
        tail.end = tail.start + len(text[tail.start : cut].rstrip())
        out += [*found, tail]
        base = cut


def definition(item: Item, language: str) -> str | None:
    """The name of the definition that an item is, ``<anonymous>`` without one; None for other items."""
    if item.comment:
        return None
    _, _, head, needs_body = _compiled(language)
    m = head.match(item.head)
    if not m:
        return None
    braced = "{" in item.head
    if not braced and needs_body.match(item.head):
        return None
    name = next((g for g in m.groups() if g), "")
    return re.sub(r"\s+", "", name) if re.match(r"[~\w$]", name) else "<anonymous>" if name in ("", "{", "()") else name


def definitions(text: str, language: str, min_chars: int = schema.MIN_CHUNK) -> list[tuple[str, str, int, int, str]] | None:
    """``(symbol, content, start_line, end_line, kind)`` of a file; None where it has no definition.

    Definitions at depth 0 of ``min_chars`` or more are chunks of any size; members stay inside.
    What lies between, item by item and without those under ``min_chars``, is one ``<module>``
    chunk in front, from its first kept item's line to the last item's.
    """
    breaks = [k for k, x in enumerate(text) if x == "\n"]
    defs, rest, last, some = [], [], 0, False
    for i in items(text, language):
        name = definition(i, language)
        start, end = i.start, i.end
        if name is not None and language in ("c", "cpp") and i.head.endswith("{") and not i.head.endswith(") {") and i.braced:
            tail = text[i.braced : end].strip()
            if tail not in ("", ";"):
                name = None  # a variable of that type
            else:
                end = i.braced
        last = bisect_right(breaks, i.end - 1) + 1
        first = bisect_right(breaks, start) + 1
        body = text[start:end]
        if name is not None:
            some = True
            if len(body) >= min_chars:
                defs.append((name, body, first, bisect_right(breaks, end - 1) + 1, "definition"))
        elif len(body.strip()) >= min_chars:
            rest.append((body.strip(), first))
    if not some:
        return None
    out = [("<module>", "\n\n".join(x for x, _ in rest), rest[0][1], last, "module_level")] if rest else []
    return out + defs
