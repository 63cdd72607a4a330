"""Text expressions: paths, lines, token estimates, patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from codelode import schema


def suffix(path: Column) -> Column:
    """The last ``.ext`` of the name, case kept; empty for names that only start with a dot or end with one."""
    return F.regexp_extract(F.substring_index(path, "/", -1), r"[^/.][^/]*(\.[^./]+)$", 1)


def language_of(path: Column, default: str | None = None) -> Column:
    """Language by suffix, ``default`` where the suffix is unknown."""
    table = F.create_map(*[F.lit(x) for kv in schema.EXTENSIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, suffix(path)), F.lit(default).cast("string"))


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"(?U)\S")


def unix_lines(text: Column) -> Column:
    """CRLF and lone CR as LF, as text-mode reading gives them."""
    return F.regexp_replace(text, "\r\n?", "\n")


def lines(text: Column) -> Column:
    """Parts between ``\\n``; a trailing one gives a last empty line."""
    return F.split(text, "\n", -1)


def approx_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(text) / 4).cast("bigint")


def truncate(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def occurrences(text: Column, word: Column | str) -> Column:
    """Non-overlapping occurrences of a substring; 0 for an empty word."""
    w = F.lit(word) if isinstance(word, str) else word
    n = F.length(w)
    return F.when(n > 0, ((F.length(text) - F.length(F.replace(text, w, F.lit("")))) / n).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def query_words(query: Column) -> Column:
    """Distinct lower-case words of a query."""
    return F.array_distinct(F.filter(F.split(F.lower(F.trim(query)), r"\s+"), lambda w: F.length(w) > 0))


def postgres_like(column: Column, pattern: str) -> Column:
    """LIKE in which a backslash takes the next character literally, whatever it is."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\" and k + 1 < len(pattern):
            k += 1
            c = pattern[k]
            out.append("\\" + c if c in "%_\\" else c)
        else:
            out.append(c)
        k += 1
    return column.like("".join(out))


def under(path: Column, folder: str) -> Column:
    """True for paths below the folder; characters of the folder are literal."""
    return path.startswith(folder.rstrip("/") + "/")


def preview(text: Column, n: int = 25) -> Column:
    """The first ``n`` lines, and how many more there are."""
    ls = lines(text)
    more = F.greatest(F.size(ls) - n, F.lit(0))
    head = F.array_join(F.slice(ls, 1, n), "\n")
    return F.struct(head.alias("head"), more.alias("more_lines"), F.when(more > 0, F.concat(head, F.format_string("\n... (%d more lines)", more))).otherwise(head).alias("rendered"))


def any_of(column: Column, values: Sequence[str]) -> Column:
    """Regular-expression alternation of unescaped words."""
    return column.rlike("|".join(values)) if values else F.lit(False)
