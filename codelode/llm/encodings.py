"""Finding and undoing wrong character decodings by a cheapest-path search.

Every token of a text that looks implausible is the start of a best-first search: states are
texts, edges are "encode with one codec, decode with another" and "unescape", each with a cost,
and a character-plausibility cost is the price of stopping at a state. The cheapest stop is the
restored token. States already seen are recognised by their hash. Tokens repeat, so results are
kept per Python worker. No shuffle: one narrow pass over the texts.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelode.session import spread

#: Codecs through which UTF-8 bytes are commonly shown (fixed values).
BYTE_VIEWS = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "cp1254", "cp866", "koi8-r", "iso8859-2", "iso8859-5", "iso8859-15")
#: Pairs (shown as, really) of single-byte and multi-byte codecs that are confused with each other.
CONFUSED = tuple(
    [("latin-1", "iso8859-2"), ("cp1252", "iso8859-2"), ("cp1252", "cp1250")]
    + [(shown, real) for real in ("cp1252", "cp1250", "mac_roman", "cp437", "cp850") for shown in ("cp437", "cp850", "mac_roman", "cp1252", "cp1250") if shown != real]
    + [(shown, real) for real in ("cp1251", "koi8-r", "cp866", "iso8859-5") for shown in ("cp1251", "koi8-r", "cp866", "iso8859-5", "cp1252", "latin-1", "mac_cyrillic") if shown != real]
    + [(shown, real) for real in ("cp932", "euc_jp") for shown in ("cp1252", "latin-1", "cp437", "mac_roman", "cp1251")]
)
UTF8_STEP, SWAP_STEP, WIDE_STEP, UNESCAPE_STEP = 0.9, 1.6, 1.4, 0.9
#: A token is searched only if stopping at once costs more than this; no path could pay off below it.
PLAUSIBLE = 1.0
#: The space searched: texts at most three steps away, over steps that make a text no more than
#: ``WORSE`` less plausible. A search that expands ``MAX_STATES`` states without an end is reported.
MAX_DEPTH, WORSE, MAX_STATES = 3, 6.0, 400
#: From this length on, equal neighbours are priced once and counted.
LONG = 48

TOKEN = re.compile(r"[^ \t\r\n\f\v]*[^\x00-\x7f][^ \t\r\n\f\v]*")
BACKTICKS = re.compile(r"```.*?```|``.*?``|`[^`\n]*`", re.S)
UTF8_SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
#: Japanese prose always holds some of these, chance results of a wide codec seldom do.
KANA = re.compile("[\u3041-\u3096\u30a1-\u30fa\u3001\u3002]")
NAMED = re.compile(r"&(?:#\d{2,6}|#x[0-9a-fA-F]{2,5}|[A-Za-z]{3,8});")

DASHES = set("–—‘’“”„…«»‹›・。、「」『』（）！？：；")
PLAIN_SYMBOLS = set("°±§£€½¼¾·×→←↑↓≤≥≠∈√∞∂∑∏•✓✔★☆©®™µ²³¹№′″¿¡")
#: Pairs that open a punctuation mark or umlaut shown through a wrong codec (fixed values).
TRIGGERS = {"â€", "ΓÇ", "ÔÇ", "‚Ä", "вЂ", "Ð²", "ï»"}
RUSSIAN = set("абвгдеёжзийклмнопрстуфхцчшщъыьэюяАБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ")


@lru_cache(maxsize=None)
def char_class(c: str) -> tuple[str, float]:
    """Class of a character and what it costs by itself."""
    o = ord(c)
    if o < 0x80:
        if c.isalpha():
            return ("U" if c.isupper() else "l"), 0.0
        return ("d" if c.isdigit() else "a"), 0.0
    if 0x80 <= o <= 0x9F:
        return "C", 4.0
    if o == 0xFFFD:
        return "F", 4.0
    if c in DASHES:
        return "q", 0.1
    if c in ("﻿", "​", "‌", "‍", "­", "️"):
        return "z", 0.1
    if o == 0xA0 or o == 0x202F:
        return "n", 0.3
    if c in "ªº‚ƒˆ˜¨¯´¸¬¦¤¢¥†‡‰":
        return "s", 1.1
    if c in PLAIN_SYMBOLS:
        return "s", 0.3
    if 0x2500 <= o <= 0x25FF:
        return "b", 0.15
    if 0x1F000 <= o <= 0x1FAFF or 0x2600 <= o <= 0x27BF:
        return "e", 0.2
    cat = unicodedata.category(c)
    if cat[0] == "M":
        return "m", 0.5
    if 0x3040 <= o <= 0x30FF or 0x4E00 <= o <= 0x9FFF or 0xFF01 <= o <= 0xFF5E or 0x3000 <= o <= 0x303F:
        return "j", 0.04
    if 0xFF61 <= o <= 0xFF9F:
        return "k", 1.2
    if c in RUSSIAN:
        return ("R" if c.isupper() else "r"), 0.03
    if 0x400 <= o <= 0x52F:
        return ("R" if c.isupper() else "r"), 1.0
    if 0x370 <= o <= 0x3FF:
        return ("G" if c.isupper() else "g"), 0.25
    if 0xC0 <= o <= 0x24F and c.isalpha():
        rare = 0.05 if o <= 0x17F else 1.0
        return ("L" if c.isupper() else "i"), rare
    if c.isalpha():
        return "x", 1.2
    return "s", 0.9


_SCRIPT = {"U": 1, "l": 1, "L": 1, "i": 1, "R": 2, "r": 2, "G": 3, "g": 3, "j": 4, "k": 4, "x": 5}
_UPPER, _LOWER, _LETTER = set("ULRG"), set("lirg"), set("UlLiRrGgjkx")


class _Pairs(dict):
    """What a character costs behind another one (or none), itself included."""

    def __missing__(self, pair: tuple[str, str]) -> float:
        if len(self) > 500_000:
            self.clear()
        self[pair] = x = _pair_cost(*pair)
        return x


_PAIR = _Pairs()


def _pair_cost(pc: str, c: str) -> float:
    k, total = char_class(c)
    if not pc or pc < "\x80" and c < "\x80":
        return total
    prev = char_class(pc)[0]
    if pc + c in TRIGGERS:
        total += 1.0
    elif pc in "ÂÃÐÑ" and k not in _LETTER and c >= "\x80":
        total += 1.6
    if prev in "Li" and k in "Li":
        total += 0.35
    if prev in _LETTER and k in _LETTER:
        if _SCRIPT[prev] != _SCRIPT[k]:
            total += 1.6
        elif k in _UPPER and prev in _LOWER:
            total += 1.6
        elif pc in "ÂÃÐÑÅÄĂĹŃ" and k in _LOWER and c >= "\x80":
            total += 0.8
    elif prev in _LETTER and k in "sb":
        total += 1.6
    elif prev in "sb" and k in "sb" and c != pc and (prev != k or k == "s"):
        total += 0.7
    elif prev == "b" and k in _LETTER:
        total += 1.2
    elif prev == "s" and k in _LETTER and pc in "‚ƒ√¬¦¤¢†‡‰":
        total += 1.2
    elif prev == "q" and c == "¿":
        total += 1.6
    elif prev in _LETTER and k == "n" and prev in "LRGb":
        total += 1.2
    elif prev == "C" or k == "C":
        total += 0.4
    return total


def cost(text: str) -> float:
    """Implausibility of a token: rare characters, and neighbours that don't go together."""
    pairs = zip(" " + text[:-1], text) if text else ()
    if len(text) < LONG:
        return sum(map(_PAIR.__getitem__, pairs))
    return sum(n * _PAIR[p] for p, n in Counter(pairs).items())


class _Bytes(dict):
    """Number of a character to that of the byte that a codec shows as it, ``other`` for characters it never shows.

    Bytes the codec leaves undefined stand for the control of their number.
    """

    def __init__(self, codec: str, other: int):
        super().__init__()
        self.other = other
        for b in range(256):
            try:
                self.setdefault(ord(bytes([b]).decode(codec)), b)
            except UnicodeDecodeError:
                self.setdefault(b, b)

    def __missing__(self, c: int) -> int:
        return self.other


@lru_cache(maxsize=None)
def _table(codec: str, other: int) -> _Bytes:
    return _Bytes(codec, other)


def _bytes(text: str, codec: str) -> bytes | None:
    try:
        return text.translate(_table(codec, 0x100)).encode("latin-1")
    except UnicodeEncodeError:
        return None


def _through_utf8(text: str, codec: str) -> str | None:
    """UTF-8 sequences among the characters' bytes decoded; characters outside them stay."""
    raw = text.translate(_table(codec, 0x1A)).encode("latin-1")
    out, at = [], 0
    for m in UTF8_SEQUENCE.finditer(raw):
        try:
            seen = m.group().decode("utf-8")
        except UnicodeDecodeError:
            continue
        out.append(text[at : m.start()])
        out.append(seen)
        at = m.end()
    if not out:
        return None
    out.append(text[at:])
    return "".join(out)


def steps(text: str) -> Iterator[tuple[str, float, str]]:
    """Edges from a state: (name, cost, text)."""
    if not text.isascii():
        for codec in BYTE_VIEWS:
            new = _through_utf8(text, codec)
            if new is not None and new != text:
                yield f"{codec}>utf-8", UTF8_STEP, new
        raws: dict[str, bytes | None] = {}
        for shown, real in CONFUSED:
            if shown not in raws:
                raws[shown] = _bytes(text, shown)
            raw = raws[shown]
            if raw is None:
                continue
            try:
                new = raw.decode(real)
            except UnicodeDecodeError:
                continue
            if real in ("cp932", "euc_jp") and not KANA.search(new):
                continue
            if new != text:
                yield f"{shown}>{real}", WIDE_STEP if real in ("cp932", "euc_jp") else SWAP_STEP, new
    if "&" in text and NAMED.search(text):
        new = html.unescape(text)
        if new != text:
            yield "unescape", UNESCAPE_STEP, new


def search(token: str) -> tuple[str, tuple[str, ...], bool]:
    """The cheapest text reachable from ``token``, the path to it (empty: it stays), and whether the search came to its end."""
    start = cost(token)
    if start <= PLAUSIBLE:
        return token, (), True
    best, best_text, best_path = start, token, ()
    heap = [(start, 0, 0.0, token, ())]
    seen = {hash(token)}
    n = 0
    while heap:
        reach, _, paid, text, path = heapq.heappop(heap)
        if paid >= best or len(path) == MAX_DEPTH:
            continue
        if n == MAX_STATES:
            return best_text, best_path, False
        n += 1
        for name, price, new in steps(text):
            h = hash(new)
            if h in seen:
                continue
            seen.add(h)
            stop = paid + price + cost(new)
            if stop < best - 1e-9:
                best, best_text, best_path = stop, new, (*path, name)
            if paid + price < best and stop < reach + WORSE:
                heapq.heappush(heap, (stop, len(seen), paid + price, new, (*path, name)))
    return best_text, best_path, True


#: Results of tokens met before; long ones hardly come back, and would fill the memory.
_kept = lru_cache(maxsize=200_000)(search)


def restore_token(token: str) -> tuple[str, tuple[str, ...], bool]:
    """``search``, looked up where the token was met before."""
    return _kept(token) if len(token) <= 200 else search(token)


def _apply(token: str, path: tuple[str, ...]) -> str | None:
    for name in path:
        if name == "unescape":
            token = html.unescape(token)
            continue
        shown, real = name.split(">")
        if real == "utf-8":
            new = _through_utf8(token, shown)
        else:
            raw = _bytes(token, shown)
            try:
                new = None if raw is None else raw.decode(real)
            except UnicodeDecodeError:
                new = None
        if new is None:
            return None
        token = new
    return token


def restore(text: str | None) -> tuple[str | None, int, int, int]:
    """(restored text, places with wrong characters outside backticks, places with losses, searches cut off).

    A place is a token (a run without ASCII white space). A token is wrong if a cheaper text is
    reachable from it, or if it shows U+FFFD or a C1 control. Losses can't be undone: they stay
    and are counted. Tokens too short to tell by themselves follow the path that most wrong
    tokens of the same text took, where that makes them no less plausible. Quoted spans between
    backticks stay as they are. Null gives (null, 0, 0, 0).
    """
    if text is None or text.isascii():
        return text, 0, 0, 0
    quoted = [m.span() for m in BACKTICKS.finditer(text)] if "`" in text else []
    spans, at = [], 0
    for a, b in quoted:
        spans.append((at, a))
        at = b
    spans.append((at, len(text)))
    found: list[tuple[int, int, str, tuple[str, ...]]] = []
    quiet: list[tuple[int, int, str]] = []
    paths: Counter = Counter()
    wrong = lost = cut = 0
    for lo, hi in spans:
        for m in TOKEN.finditer(text, lo, hi):
            token = m.group()
            new, path, ended = restore_token(token)
            cut += not ended
            loss = "�" in token
            if path or loss or any("\x80" <= c <= "\x9f" for c in token):
                wrong += 1
                lost += loss or "�" in new
                found.append((m.start(), m.end(), new, path))
                if path:
                    paths[path] += 1
            else:
                quiet.append((m.start(), m.end(), token))
    if not wrong:
        return text, 0, 0, cut
    if paths:
        path, votes = paths.most_common(1)[0]
        if votes * 2 > sum(paths.values()):
            for a, b, token in quiet:
                new = _apply(token, path)
                if new is not None and new != token and cost(new) <= cost(token):
                    found.append((a, b, new, path))
            found.sort()
    out, at = [], 0
    for a, b, new, _ in found:
        out.append(text[at:a])
        out.append(new)
        at = b
    out.append(text[at:])
    return "".join(out), wrong, lost, cut


def restore_encoding(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", only_wrong: bool = True) -> DataFrame:
    """``(id, text, n_places, n_lost, n_cut)``: texts with wrong characters, restored where nothing was lost.

    ``n_cut`` counts places whose search expanded ``MAX_STATES`` states without coming to its end.

    With ``only_wrong=False`` every row comes out. Null texts stay null with no places; empty
    texts stay empty. Repeated rows stay repeated; other columns don't take part.
    """
    src = df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__t"))
    if only_wrong:
        src = src.where(F.col("__t").rlike("[^\\x00-\\x7f]"))  # plain ASCII shows no wrong character
    schema = T.StructType(
        [T.StructField(id_col, src.schema["__id"].dataType), T.StructField("text", T.StringType()), T.StructField("n_places", T.IntegerType()), T.StructField("n_lost", T.IntegerType()), T.StructField("n_cut", T.IntegerType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, texts, places, lost, cut = [], [], [], [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                new, n, gone, short = restore(t)
                if n or not only_wrong:
                    keep.append(k)
                    texts.append(new)
                    places.append(n)
                    lost.append(gone)
                    cut.append(short)
            ids = batch.column(0).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string()), pa.array(places, pa.int32()), pa.array(lost, pa.int32()), pa.array(cut, pa.int32())], names=schema.names)

    return spread(src).mapInArrow(run, schema)
