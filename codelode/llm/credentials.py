"""Finding and blanking credentials in source code with a linear-chain conditional random field.

Every line is cut into lexical tokens; every token gets shape features (of itself) and context
features (names, keywords and quotes around it), and the most probable label sequence by Viterbi
decides which characters belong to a credential. Lines whose tokens can't reach that label in any
context (an upper bound from the weights) skip it, which changes no label. The field is trained
at first use, by gradient ascent on the conditional likelihood, on ``SAMPLES`` sequences, and a
sixth as many without a word that tells, that a seeded grammar of contexts and values makes up: no
row of the data is needed, and every run has the same weights. They are a few thousand numbers and
travel with the task.
"""

from __future__ import annotations

import base64
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import ne

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.session import spread

#: Labelled sequences the field is trained on (besides a sixth as many neutral ones), passes over them, and the seed of both.
SAMPLES, EPOCHS, SEED = 6000, 24, 17
BLANK = "*"

TOKEN = re.compile(
    r"""
    (?P<begin>-----BEGIN[ A-Z0-9]*-----) | (?P<end>-----END[ A-Z0-9]*-----)
  | (?P<nl>\n)
  | (?P<url>[A-Za-z][A-Za-z0-9+]*+://)
  | (?P<user>(?<=://)[^\s:/@"'`]++(?=:[^\s@"'`]+@))
  | (?P<upass>(?<=:)(?<!//)[^\s@"'`/]++(?=@[\w.\[%{$-]))
  | (?P<ref>\$\{[^}\n]*\} | \$\([^)\n]*\) | \$\w+ | <[^<>\n]{1,60}> | %\(\w+\)s | \{\{[^}\n]*\}\})
  | (?P<flag>--[A-Za-z][\w-]*+=)
  | (?P<name>[A-Za-z_][\w.-]*+(?=["']?[ \t]*(?::[ ]?\w+(?:\[\])?[ \t]*=|:=|[:=])(?![=/])[ \t]*(?:["'`(\[{\s]|$)) | (?<![^\s\#/,(])[A-Za-z_]\w*+(?=[:=][^\s/:=]))
  | (?P<q>\"\"\"|'''|["'`])
  | (?P<atom>(?:(?<=["'\s])[,=:](?=[^\s,=:"'`]{5}))?[^\s"'`;(){}\[\]\\:=,<>][^\s"'`;(){}\[\]\\<>]*)
  | (?P<p>\S)
    """,
    re.X,
)

SECRET_NOUNS = {"password", "passwd", "pwd", "pass", "pw", "passphrase", "secret", "apikey", "credential", "credentials", "passcode"}
SECRET_PAIRS = {"key", "token"}
KEY_OWNERS = {"api", "access", "auth", "private", "refresh", "session", "service", "encryption", "signing", "deploy", "tls", "ssh", "secret", "master", "admin", "client", "webhook", "bearer", "hmac", "account", "license", "storage"}
HASH_NOUNS = {"checksum", "digest", "sha", "md5", "etag", "hash", "uuid", "guid", "id", "integrity", "fingerprint", "commit", "revision", "crc", "nonce", "salt", "sum", "version", "sha1", "sha256", "sha512"}
PLACEHOLDERS = {"changeme", "change", "example", "dummy", "test", "todo", "none", "null", "nil", "undefined", "placeholder", "redacted", "replace-me", "replace_me", "not-a-secret", "your-key-here", "secret", "password", "passwd", "token", "user", "username", "true", "false", "default", "empty", "masked", "hidden", "foo", "bar", "sample", "tbd", "n/a", "xxx", "fixme", "unset", "your_api_key", "your_password", "your_token", "insert-key-here"}
CUES = {"bearer", "token", "basic", "password", "passwd", "pw", "pwd", "login", "key", "secret", "identified", "by", "is", "authorization", "integrity", "credential", "credentials", "passphrase", "sign", "signer", "checksum", "commit", "sha", "from", "for", "old", "environ", "getenv", "env", "vault", "values", "enter", "pass", "apikey"}


def words_of(name: str) -> list[str]:
    """Lower-case words of an identifier."""
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]


@lru_cache(maxsize=100_000)
def name_class(name: str) -> str:
    """What an identifier says about the value it names."""
    w = words_of(name)
    if not w:
        return "none"
    if "public" in w or "pub" in w or "pubkey" in w:
        return "public"
    if w[-1] in HASH_NOUNS:
        return "hash"
    if w[-1] in SECRET_NOUNS:
        return "secret"
    if w[-1] in SECRET_PAIRS and len(w) > 1 and w[-2] in KEY_OWNERS:
        return "secret"
    if len(w) > 1 and w[-2] in SECRET_NOUNS and w[-1] in ("value", "hash", "string", "text", "key"):
        return "secret"
    if w[-1] in ("key", "token", "signer", "login", "auth", "authorization"):
        return "maybe" if len(w) == 1 else "weak"
    if w[-1] in ("user", "username", "host", "url", "name", "path"):
        return "plain"
    return "other"


class _Kinds(dict):
    """Kind of each character, by its number."""

    def __missing__(self, n: int) -> str:
        c = chr(n)
        self[n] = "u" if c.isupper() else "l" if c.islower() else "d" if c.isdigit() else "-" if c in "-_." else "/" if c == "/" else "s"
        return self[n]


_KIND = _Kinds()
_PLACEHOLDER = re.compile(r"x{3,}|\*{2,}|\.{2,}|-+|_+|0+|(?:your|my|the|insert|enter|some)[-_]?[a-z_-]*")
_MASKED = re.compile(r"[*xX.•#-]{3,}")
_UPPER = re.compile(r"[A-Z][A-Z_]*")
_LOW = re.compile(r"(?:[a-z]+[_.-])*[a-z]+")
_CAMEL = re.compile(r"[a-z]+(?:[A-Z][a-z]+)+|(?:[A-Z][a-z]+)+")
_NUM = re.compile(r"(?:[A-Za-z]+[_-])+\d{1,3}")
_REFERENCE = re.compile(r"(?:env|vault|file|ref|secret|ssm|arn|kms|op)[:/]")
_PATHLIKE = re.compile(r"(?:[\w.-]+/)+[\w.-]*")
_MIXED = re.compile(r"\d[A-Za-z]|[a-z][A-Z][a-z]?[A-Z]")
_HOST = re.compile(r"[\w-]+(?:\.[\w-]+)+(?::\d+)?(?:/\S*)?")
_HOST_CHARS = re.compile(r"[a-z\d.:/_-]+")
_HEX = re.compile(r"[0-9a-f]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_DIGEST = re.compile(r"sha\d+[-:]|md5[-:]")
_KNOWN = re.compile(r"AKIA[0-9A-Z]{12,}|eyJ[\w-]+\.[\w-]+|(?:gh[a-z]|sk|pk|xox[a-z]|glpat|pat|tok|npm|nvk|AIza|SG)[_.-][\w.-]{12,}")
_B64 = re.compile(r"[A-Za-z0-9+/=]{20,}")
_WORDS_DIGITS = re.compile(r"[A-Za-z][a-z0-9]+[^A-Za-z0-9\s][A-Z][a-z0-9]+\d{2,}[^A-Za-z0-9\s]?")
_VERSION = re.compile(r"v?\d+(?:\.\d+)+")
_NUMBER = re.compile(r"[-+]?\d[\d.]*%?")
_V_LOG_V = [0.0, *(v * math.log2(v) for v in range(1, 2000))]


@lru_cache(maxsize=300_000)
def shape(token: str) -> tuple[str, ...]:
    """Shape features of a token: length, kinds of characters, how often they change, known forms.

    A form is only tried on tokens that hold the kinds of characters it needs.
    """
    n = len(token)
    f = [f"len{min(n, 40) // 4}" if n < 40 else ("len10" if n < 60 else "len15")]
    low = token.lower()
    bare = low.strip("<>[]().,!?*\"'")
    kinds = token.translate(_KIND)
    kind = set(kinds)
    have = "".join(sorted(kind))
    f.append("set:" + have)
    changes = sum(map(ne, kinds, kinds[1:]))
    if n:
        f.append(f"chg{min(9, int(10 * changes / n))}")
    if n >= 6:
        counts = map(token.count, dict.fromkeys(token))
        e = math.log2(n) - (sum([_V_LOG_V[v] for v in counts]) if n < len(_V_LOG_V) else sum(v * math.log2(v) for v in counts)) / n
        f.append(f"ent{int(e * 2 + 1e-9)}")
    lower, upper, digit, dash, slash = "l" in kind, "u" in kind, "d" in kind, "-" in kind, "/" in kind
    letters = lower or upper
    if bare in PLACEHOLDERS or _PLACEHOLDER.fullmatch(bare) or _MASKED.fullmatch(token):
        f.append("placeholder")
    if upper and not (lower or digit or slash or "s" in kind) and _UPPER.fullmatch(token):
        f.append("upper")
    if not letters or slash or "s" in kind:
        pass
    elif lower and not upper and not digit and _LOW.fullmatch(token):
        f.append("ident-low")
    elif lower and upper and not digit and not dash and _CAMEL.fullmatch(token):
        f.append("ident-camel")
    elif digit and dash and _NUM.fullmatch(token):
        f.append("ident-num")
    if (slash or ":" in token) and _REFERENCE.match(low) or slash and _PATHLIKE.fullmatch(token) and n < 60 and changes < n / 2 and not _MIXED.search(token):
        f.append("path")
    if not upper and dash and "." in token and _HOST.fullmatch(token) and _HOST_CHARS.fullmatch(token):
        f.append("host")
    if (lower or digit) and not (upper or dash or slash or "s" in kind) and _HEX.fullmatch(token):
        f.append("hex" if n in (32, 40, 64) else "hex-other")
    if n == 36 and _UUID.fullmatch(token):
        f.append("uuid")
    if low[:3] in ("sha", "md5") and _DIGEST.match(low):
        f.append("digest")
    if n >= 12 and _KNOWN.match(token):
        f.append("known")
    if n >= 20 and _B64.fullmatch(token):
        f.append("b64")
        if n >= 60:
            f.append("b64-line")
    if upper and digit and _WORDS_DIGITS.fullmatch(token):
        f.append("words+digits")
    if digit and "." in token and _VERSION.fullmatch(token):
        f.append("version")
    if low.startswith(("base64,", "data:")):
        f.append("data-uri")
    if digit and not letters and _NUMBER.fullmatch(token):
        f.append("number")
    return tuple(f)


#: Kinds of tokens that can be a value.
VALUED = ("atom", "upass", "user", "name", "ref")


@lru_cache(maxsize=300_000)
def said(kind: str, token: str) -> tuple[str | None, tuple[str, ...]]:
    """What a token says of those behind it: its class as a name, and its words among ``CUES``."""
    return name_class(token) if kind != "atom" else None, tuple(w for w in words_of(token)[-2:] if w in CUES)


def own_features(kind: str, token: str) -> tuple[str, tuple[str, ...] | str]:
    """What a token's features depend on, its context aside."""
    return (kind, shape(token)) if kind in VALUED else (kind, token if kind in ("p", "q") else "")


#: Names and words around most tokens, and how many tokens and lines a process keeps in mind.
USUAL = ({"none", "other", "plain"}, {"for", "from"})
MEMORY = 200_000


class Tokens:
    """Tokens of one window with their kinds and places."""

    __slots__ = ("kind", "text", "at", "end")

    def __init__(self, text: str, lo: int, hi: int):
        self.kind, self.text, self.at, self.end = [], [], [], []
        for m in TOKEN.finditer(text, lo, hi):
            self.kind.append(m.lastgroup)
            self.text.append(m.group())
            self.at.append(m.start())
            self.end.append(m.end())


def features(t: Tokens) -> list[list[str]]:
    """Features of every token of a window."""
    n = len(t.text)
    out = []
    quoted, quote, quote_at = False, "", -1
    last_name, name_dist, last_words, has_url = "none", 99, [], False
    line_first = True
    in_key = False
    comment = False
    for i in range(n):
        k, x = t.kind[i], t.text[i]
        f = ["k:" + k]
        prev_k, prev_x = (t.kind[i - 1], t.text[i - 1]) if i else ("^", "")
        next_k, next_x = (t.kind[i + 1], t.text[i + 1]) if i + 1 < n else ("$", "")
        f.append("pk:" + prev_k)
        f.append("nk:" + next_k)
        if k in ("begin", "end"):
            f.append("private" if "PRIVATE" in x else "public")
            if k == "begin":
                body = sum(len(t.text[j]) for j in range(i + 1, min(n, i + 6)) if t.kind[j] in ("atom", "p"))
                f.append("body" if body >= 30 else "no-body")
                in_key = "PRIVATE" in x and body >= 30
        f.append("q1" if quoted else "q0")
        if in_key:
            f.append("in-key")
        if k in VALUED:
            s = shape(x)
            near = last_name if name_dist <= 12 else "none"
            f += s
            f.append(f"near:{near}")
            place = "upass" if k == "upass" else "alone" if quoted and prev_k == "q" and next_k == "q" else "bare" if not quoted else "part"
            f.append("place:" + place)
            f += [f"{place}|{near}|{y}" for y in s if not y.startswith(("len", "chg", "ent"))]
            f += [f"{near}|{y}" for y in s if y.startswith(("chg", "len"))]
            cue = next((w for w in reversed(last_words[-4:]) if w in CUES), "none")
            f.append("cue:" + cue)
            f += [f"cue:{cue}|{y}" for y in s if not y.startswith(("len", "ent"))]
            f.append("pw:" + (last_words[-1] if last_words and last_words[-1] in CUES else "-"))
            if has_url:
                f.append("url-before")
                f += [f"url|{place}|{y}" for y in s if not y.startswith("len")]
            if comment:
                f.append("comment")
                f += [f"comment|{cue}|{y}" for y in s if y.startswith(("set", "chg", "placeholder", "ident"))]
            if line_first and quoted:
                f.append("literal-line")
                f += [f"literal-line|{near}|{y}" for y in s if y.startswith(("b64", "hex", "len"))]
        elif k == "p" or k == "q":
            f.append("x:" + x)
        out.append(f)
        # state for what follows
        if k == "nl":
            line_first, comment = True, False
            if not quoted:
                last_words = last_words[-2:]
        elif k not in ("q",):
            if k != "p":
                line_first = False
        if k == "q":
            if quoted and x == quote:
                quoted = False
            elif not quoted:
                quoted, quote, quote_at = True, x, i
        if k == "name" or k == "flag":
            c = name_class(x)
            if not (k == "name" and quoted and quote_at != i - 1) or c != "other":
                last_name, name_dist = c, 0
        elif k != "nl" and k != "q":
            name_dist += 1
        if k == "url":
            has_url = True
        if x[:1] == "#" or x[:2] in ("//", "--") and k != "flag" or x[:1] == "*":
            comment = not quoted or comment
        if k == "end":
            in_key = False
        if k in ("atom", "name", "flag"):
            last_words += [w for w in words_of(x)[-2:]] or ["?"]
    return out


# ------------------------------------------------------------------ the field


class _Usual(dict):
    """``Field.first`` of each token met."""

    def __init__(self, field: Field, quoted: bool, marked: bool):
        super().__init__()
        self.field, self.where = field, (quoted, marked)

    def __missing__(self, f: tuple[str, str]) -> float:
        self[f] = x = self.field.first(*f, *self.where)
        return x


class Field:
    """A linear-chain conditional random field with two labels: other (0) and credential (1)."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, trans: np.ndarray):
        self.index, self.weights, self.trans = index, weights, trans
        self._w = [tuple(row) for row in weights.tolist()]
        self._t = trans.tolist()
        kinds = ["^", "$", *TOKEN.groupindex]
        self._before, self._after = ({k: self.lead(f"{w}:{k}") for k in kinds} for w in ("pk", "nk"))
        self._leads: dict[tuple, dict[tuple, float]] = {}
        self._usual = {(q, m): _Usual(self, q, m) for q in (False, True) for m in (False, True)}
        # at or below this no token gains by label 1, whatever stands beside it, as long as transitions only cost
        costs = max(trans[0, 1], trans[1, 0], trans[1, 1]) <= trans[0, 0]
        self._never = -max(self._before.values()) - max(self._after.values()) - 1e-6 if costs else -math.inf
        #: Lines that hold nothing.
        self.bare: set[str] = set()

    def viterbi(self, feats: list[list[str]]) -> list[int]:
        """The most probable labels."""
        if not feats:
            return []
        get, w, t = self.index.get, self._w, self._t
        back, a0, a1 = [], 0.0, 0.0
        for i, f in enumerate(feats):
            e0 = e1 = 0.0
            for x in f:
                j = get(x)
                if j is not None:
                    p = w[j]
                    e0 += p[0]
                    e1 += p[1]
            if i == 0:
                a0, a1 = e0, e1
                back.append((0, 1))
                continue
            x0, x1 = a0 + t[0][0], a1 + t[1][0]
            y0, y1 = a0 + t[0][1], a1 + t[1][1]
            back.append((0 if x0 >= x1 else 1, 0 if y0 >= y1 else 1))
            a0, a1 = max(x0, x1) + e0, max(y0, y1) + e1
        lab = 0 if a0 >= a1 else 1
        out = [lab]
        for b in back[:0:-1]:
            lab = b[lab]
            out.append(lab)
        return out[::-1]

    def possible(self, t: list[tuple[str, str]]) -> bool:
        """False only if Viterbi is sure to label nothing of these kinds and texts of tokens.

        No run of tokens can outweigh its transitions then, each token counted with the largest lead
        of label 1 that any context gives it: first any of ``USUAL``, then those of which the window
        holds the names and words.
        """
        kinds = [k for k, _ in t]
        quoted, marked = "q" in kinds, any(x[:1] in "#*" or x[:2] in ("//", "--") for _, x in t)
        usual = self._usual[quoted, marked]
        if len(usual) > MEMORY:
            usual.clear()
        most = max(map(usual.__getitem__, t), default=-math.inf)
        if most <= self._never:
            return False
        if most < math.inf and not self._outweighs(kinds, [usual[f] for f in t]):
            return False
        if "begin" in kinds:
            return True
        near, cues = {"none"}, set()
        for k, x in t:
            if k in ("atom", "name", "flag"):
                c, w = said(k, x)
                if c:
                    near.add(c)
                cues.update(w)
        if len(self._leads) > MEMORY // 20:
            self._leads.clear()
        place = ("url" in kinds, quoted, marked)
        lead = self._leads.setdefault((frozenset(near), frozenset(cues), place), {})
        leads = []
        for k, x in t:
            f = own_features(k, x)
            d = lead.get(f)
            if d is None:
                d = lead[f] = self._lead(near, cues, place, *f)
            leads.append(d)
        return self._outweighs(kinds, leads)

    def first(self, kind: str, token: str, quoted: bool, marked: bool) -> float:
        """The largest lead of a token in usual contexts; infinite if the token makes the context another."""
        c, w = said(kind, token) if kind in ("atom", "name", "flag") else (None, ())
        if kind in ("begin", "url") or c is not None and c not in USUAL[0] or not USUAL[1].issuperset(w):
            return math.inf
        lead = self._leads.setdefault((quoted, marked), {})
        f = own_features(kind, token)
        if f not in lead:
            lead[f] = self._lead(*USUAL, (False, quoted, marked), *f)
        return lead[f]

    def _outweighs(self, kinds: list[str], leads: list[float]) -> bool:
        """Whether a run of tokens can lead by more than the transitions into and out of it cost."""
        (t00, t01), (t10, t11) = self._t
        start, stay, stop = t01 - t00, t11 - t00, t10 - t00
        before, after = self._before, self._after
        run, enter, prev = 0.0, 0.0, "^"
        for k, nxt, d in zip(kinds, [*kinds[1:], "$"], leads, strict=True):
            run = d + before[prev] + after[nxt] + (run + stay if run + stay > enter else enter)
            if run > (1e-6 - stop if nxt != "$" else -1e-6) - 2e-6:
                return True
            enter, prev = start, k
        return False

    def _lead(self, near: set[str], cues: set[str], place: tuple[bool, bool, bool], kind: str, own: tuple[str, ...] | str) -> float:
        """The largest lead of label 1 over label 0 for a token, without the kinds of its neighbours.

        ``place``: whether the window has a URL, quotes, a mark that may begin a comment.
        """
        d = self.lead
        url, quoted, marked = place
        out = d("k:" + kind) + (max(d("q0"), d("q1")) if quoted else d("q0"))
        if kind == "end":
            return out + max(d("private"), d("public"))
        if kind in ("p", "q"):
            return out + d("x:" + own)
        if kind not in VALUED:
            return out
        steady = [y for y in own if not y.startswith(("len", "chg", "ent"))]
        best = -math.inf
        for c in near:
            by_near = d(f"near:{c}") + sum(d(f"{c}|{y}") for y in own if y.startswith(("chg", "len")))
            if quoted:
                by_near += max(0.0, d("literal-line") + sum(d(f"literal-line|{c}|{y}") for y in own if y.startswith(("b64", "hex", "len"))))
            for p in ("upass",) if kind == "upass" else ("alone", "bare", "part") if quoted else ("bare",):
                by_place = d("place:" + p) + sum(d(f"{p}|{c}|{y}") for y in steady)
                if url:
                    by_place += max(0.0, d("url-before") + sum(d(f"url|{p}|{y}") for y in own if not y.startswith("len")))
                best = max(best, by_near + by_place)
        by_cue = max(d("cue:" + c) + sum(d(f"cue:{c}|{y}") for y in own if not y.startswith(("len", "ent"))) + (max(0.0, d("comment") + sum(d(f"comment|{c}|{y}") for y in own if y.startswith(("set", "chg", "placeholder", "ident")))) if marked else 0.0) for c in ("none", *cues))
        return out + sum(map(d, own)) + best + by_cue + max(d("pw:" + w) for w in ("-", *cues))

    def lead(self, feature: str) -> float:
        """What a feature adds to label 1 over label 0."""
        j = self.index.get(feature)
        return self._w[j][1] - self._w[j][0] if j is not None else 0.0

    @classmethod
    def fit(cls, sequences: list[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS, rate: float = 0.3, l2: float = 1e-5, min_count: int = 2, seed: int = SEED) -> Field:
        """Maximises the conditional log-likelihood by AdaGrad over batches, with exact forward-backward sums."""
        counts = Counter(x for feats, _ in sequences for f in feats for x in f)
        index = {x: j for j, x in enumerate(sorted(x for x, c in counts.items() if c >= min_count))}
        coded = [([[index[x] for x in f if x in index] for f in feats], labels) for feats, labels in sequences if feats]
        n_feat = len(index)
        weights, trans = np.zeros((n_feat + 1, 2)), np.zeros((2, 2))
        gw, gt = np.full((n_feat + 1, 2), 1e-6), np.full((2, 2), 1e-6)
        rng = np.random.default_rng(seed)
        # batches of similar lengths; the last feature number is padding
        order = sorted(range(len(coded)), key=lambda i: len(coded[i][0]))
        batches = []
        for lo in range(0, len(order), 250):
            part = [coded[i] for i in order[lo : lo + 250]]
            T = max(len(f) for f, _ in part)
            width = max(len(x) for f, _ in part for x in f)
            ids = np.full((len(part), T, width), n_feat, dtype=np.int64)
            y = np.zeros((len(part), T), dtype=np.int64)
            mask = np.zeros((len(part), T), dtype=bool)
            for b, (f, lab) in enumerate(part):
                mask[b, : len(f)] = True
                y[b, : len(f)] = lab
                for t, x in enumerate(f):
                    ids[b, t, : len(x)] = x
            batches.append((ids, y, mask))
        for _ in range(epochs):
            for k in rng.permutation(len(batches)):
                ids, y, mask = batches[k]
                B, T, _ = ids.shape
                emit = weights[ids].sum(axis=2)
                # forward and backward in log space
                alpha = np.zeros((B, T, 2))
                beta = np.zeros((B, T, 2))
                alpha[:, 0] = emit[:, 0]
                for t in range(1, T):
                    nxt = np.logaddexp(alpha[:, t - 1, 0:1] + trans[0], alpha[:, t - 1, 1:2] + trans[1]) + emit[:, t]
                    alpha[:, t] = np.where(mask[:, t : t + 1], nxt, alpha[:, t - 1])
                for t in range(T - 2, -1, -1):
                    x = emit[:, t + 1] + beta[:, t + 1]
                    prv = np.logaddexp(x[:, 0:1] + trans[:, 0], x[:, 1:2] + trans[:, 1])
                    beta[:, t] = np.where(mask[:, t + 1 : t + 2], prv, beta[:, t])
                z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
                post = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
                grad = -post
                bb, tt = np.nonzero(mask)
                grad[bb, tt, y[bb, tt]] += 1.0
                dw = np.zeros_like(weights)
                flat = ids.reshape(-1)
                for lab in (0, 1):
                    dw[:, lab] = np.bincount(flat, weights=np.repeat(grad[:, :, lab].reshape(-1), ids.shape[2]), minlength=n_feat + 1)
                dt = np.zeros((2, 2))
                both = mask[:, 1:]
                for a in (0, 1):
                    for b in (0, 1):
                        p = np.exp(alpha[:, :-1, a] + trans[a, b] + emit[:, 1:, b] + beta[:, 1:, b] - z[:, None])
                        dt[a, b] = (((y[:, :-1] == a) & (y[:, 1:] == b) & both).sum()) - (p * both).sum()
                dw[n_feat] = 0
                dw -= l2 * B * weights
                gw += dw**2
                gt += dt**2
                weights += rate * dw / np.sqrt(gw)
                trans += rate * dt / np.sqrt(gt)
        keep = np.abs(weights[:n_feat, 0] - weights[:n_feat, 1]) > 0.02
        kept = {x: j for x, j in index.items() if keep[j]}
        rows = np.array([weights[j] for j in kept.values()]).reshape(-1, 2)
        return cls({x: k for k, x in enumerate(kept)}, rows, trans)


# ------------------------------------------------------------------ made-up training sequences


class Maker:
    """A seeded grammar of lines with and without credentials; parts in ``\\x01 ... \\x02`` are credentials."""

    def __init__(self, seed: int = SEED):
        self.r = random.Random(seed)
        syl = ["ba", "cor", "den", "fil", "gan", "hol", "jun", "kap", "lor", "mit", "nex", "pol", "qua", "rin", "sol", "tum", "ver", "wex", "yar", "zen", "tar", "ob", "ist", "ane"]
        self.nouns = sorted({"".join(self.r.choices(syl, k=self.r.choice([2, 2, 3]))) for _ in range(300)})

    def noun(self):
        return self.r.choice(self.nouns)

    def style(self, words):
        s = self.r.random()
        if s < 0.5:
            return "_".join(words)
        if s < 0.85:
            return words[0] + "".join(w.capitalize() for w in words[1:])
        return "_".join(words).upper()

    def name(self, words=None):
        return self.style([self.noun() for _ in range(self.r.choice([0, 1, 1]))] + (words or [self.noun(), self.noun()]))

    def chars(self, alphabet, lo, hi):
        return "".join(self.r.choices(alphabet, k=self.r.randint(lo, hi)))

    def secret(self):
        r, an = self.r, string.ascii_letters + string.digits
        kind = r.randrange(11)
        if kind == 10:
            return self.chars(string.ascii_letters, 8, 16)
        if kind <= 2:
            return self.chars(an, 10, 44)
        if kind == 3:
            return self.chars(an + "!*?_-.+=,", 9, 20)
        if kind <= 5:
            leet = str.maketrans({"e": "3", "o": "0", "i": "1"})
            w = self.noun()
            w = w.capitalize() if r.random() < 0.5 else w.translate(leet) if r.random() < 0.6 else w
            return f"{w}{r.choice('!_-+.*?')}{self.noun().capitalize()}{r.randint(100, 9999)}{r.choice(['', '!', '*', '?'])}"
        if kind == 6:
            return r.choice(["ghp_", "sk_live_", "xoxb-", "pat.", "nvk-", "tok_live_", "glpat-", "npm_"]) + self.chars(an, 20, 40)
        if kind == 7:
            return "AKIA" + self.chars(string.ascii_uppercase + string.digits, 16, 16)
        if kind == 8:
            return "eyJhbGciOiJIUzI1NiJ9." + self.chars(an + "-_", 30, 60) + "." + self.chars(an + "-_", 30, 60)
        return self.hex()

    def hex(self):
        return self.chars("0123456789abcdef", *[(n, n) for n in [self.r.choice([32, 40, 64])]][0])

    def fake(self):
        r = self.r
        return r.choice(["", "changeme", "xxxx", "xxxxxxxxxxxx", "********", "****", "TODO", "example", "dummy", "replace-me", "not-a-secret", "YOUR_API_KEY", "YOUR_PASSWORD", "<your-key-here>", "<redacted>", "<set in vault>", "<password>", "${" + self.name().upper() + "}", "${" + self.name() + "}", "$" + self.name().upper(), "$(vault_read " + self.name() + ")", "env:" + self.name().upper(), "vault/" + self.name(), "null", "%s", "{{ " + self.name() + " }}", self.name(), "none", "secret", "password", "placeholder", "..."])

    def sentence(self):
        return self.r.choice([" ".join(self.noun() for _ in range(self.r.randint(2, 5))), f"expected '{{' before {self.noun()}", f"missing {self.noun()} for {self.noun()}", f"{self.noun()} [{self.noun()} was closed", f"enter password for {self.noun()}: ", f"invalid token in {self.noun()}", f"password is too short ({self.noun()}", f"no api key for {self.noun()}"])

    def plain(self):
        r = self.r
        return r.choice([self.name(), self.sentence(), "-".join([self.noun(), self.noun(), self.noun()]), f"{self.noun()}-{self.noun()}-{r.randint(1, 999)}", f"{self.noun()}/{self.noun()}", f"https://{self.noun()}.example/{self.noun()}", str(r.randint(1, 99999)), self.noun().capitalize() + self.noun().capitalize(), f"{self.noun()}.{self.noun()}.example", f"{self.noun()}{r.randint(1,99)}"])

    def secret_name(self):
        return self.name(self.r.choice([["password"], ["passwd"], ["pwd"], ["passphrase"], ["secret"], ["apikey"], ["api", "key"], ["access", "token"], ["refresh", "token"], ["auth", "token"], ["client", "secret"], ["webhook", "secret"], ["session", "secret"], ["signing", "key"], ["encryption", "key"], ["service", "key"], ["private", "token"], ["admin", "pw"], ["smtp", "pass"], ["db", "password"], ["deploy", "key"], ["private", "key"], ["tls", "key"]]))

    def hash_name(self):
        return self.name(self.r.choice([["checksum"], ["commit", "sha"], ["content", "digest"], ["etag"], ["batch", "uuid"], ["trace", "id"], ["request", "id"], ["file", "hash"], ["md5"], ["fingerprint"], ["build", "id"]]))

    def assign(self, name, value):
        r = self.r
        q = '"' if r.random() < 0.85 else "'"
        v = f"{q}{value}{q}"
        return r.choice([f"{name} = {v}", f"    {name} = {v}", f"const char *{name} = {v};", f"var {name} = {v};", f"var {name}: string = {v};", f"let {name} = {v};", f"String {name} = {v};", f"{name} := {v}", f"export {name}={v}", f"{name}: {v}", f'"{name}": {v},', f"  {name}: {v}", f"{self.name()}({name}={v})", f'{self.name()}(user="{self.noun()}", {name}={v})', f"private final String {name} = {v};", f"{{ {name}: {v}, {self.name()}: {r.randint(1, 99)} }}"])

    def bare(self, name, value):
        return self.r.choice([f"{name}: {value}", f"  {name}: {value}", f"{name}={value}", f"export {name}={value}", f"{name} = {value}"])

    def key_block(self, what, lines, indent=""):
        b64 = string.ascii_letters + string.digits + "+/"
        return [f"-----BEGIN {what}-----"] + [indent + self.chars(b64, 64, 64) for _ in range(lines)] + [indent + f"-----END {what}-----"]

    def neutral(self) -> str:
        """Lines without a word that tells: random values under any name, and the data and code around them."""
        r, an = self.r, string.ascii_letters + string.digits
        pick = r.randrange(8)
        camel = lambda: self.noun() + self.noun().capitalize() + self.noun().capitalize()
        value = "\x01" + self.chars(an, 18, 60) + "\x02"
        if pick < 2:
            return self.assign(self.name(), value)
        if pick == 2:
            return r.choice([f'{self.name()}("{value}")', f'{self.name()}({self.name()}, "{value}");', f'{self.name()}("{self.noun()}", "{value}")', f'{self.name()}.{self.name()}("{value}", {r.randint(1, 999)});', f"return '{value}'"])
        if pick == 3:
            row = r.choice([lambda: f"0x{r.randrange(256):02x}", lambda: f"0x{r.randrange(256):02X}", lambda: str(r.randrange(256)), lambda: f"{r.random():.4f}", lambda: f"0x{r.randrange(2**32):08x}", lambda: f'"{self.noun()}"'])
            return "    " + ", ".join(row() for _ in range(r.randint(6, 16))) + ","
        if pick == 4:
            css = lambda: f".{self.noun()[:3]}{r.randint(1, 99)}{r.choice(['', '>a', '>b'])}{{margin:{r.randint(1, 40)}px;color:#{r.randrange(2**24):06x};width:{r.randint(1, 999)}px}}"
            js = lambda: f"function {self.noun()[:2]}{r.randint(1, 999)}(v,u){{return v.{camel()}(u,{r.randint(1, 999)})}}var {self.noun()[:2]}{r.randint(1, 999)}=d=>q[{r.randint(1, 999)}]||v.{camel()};{self.noun()[:2]}{r.randint(1, 99)}.{camel()}({r.randint(1, 9)});for(var r=0;r<{r.randint(1, 99)};r++)"
            one = r.choice([css, js])
            return "".join(one() for _ in range(r.randint(2, 6)))
        if pick == 5:
            q = r.choice("\"'")
            return r.choice([f"const {camel()} = {camel()}.replace(/[(\"']{camel()}/g, {camel()});", f"{self.name()}.add({self.name()}.{self.name()}());", f"{self.name()}.{self.name()}({camel()}.{camel()}, {q}{self.noun()}{q});", f"if ({camel()}.{camel()}({camel()}) > {r.randint(1, 999)}) {{", f"import {self.noun()}.{self.noun()}.{camel().capitalize()};", f"{self.name()}[{q}{self.name()}{q}] = {self.name()} + {r.randint(1, 99)}", f"re.compile(r{q}[A-Za-z0-9_]+({self.noun()}|\\d{{2,4}}){q})", f"{self.name()} = {self.name()}({self.name()}={r.randint(1, 9999)})"])
        if pick == 6:
            mark = r.choice(["//", "#", "--", "*"])
            return r.choice([f"{mark} Code generated by {self.noun()}{self.noun()} v{r.randint(1, 9)}.{r.randint(0, 30)}. DO NOT EDIT.", f"{mark} {self.noun().capitalize()} {self.noun()} of {self.noun()} {r.randint(1, 99)} ({self.name()}).", f"{mark} see https://{self.noun()}.example/{self.noun()}/{r.randint(1, 9999)}#L{r.randint(1, 99)}", f"{mark} TODO({self.noun()}): {self.sentence()}", f"/** {self.sentence()} */"])
        return self.assign(self.name(), r.choice([self.plain(), self.plain(), "-".join(self.chars("0123456789abcdef", n, n) for n in (8, 4, 4, 4, 12)), self.chars("0123456789abcdef", 8, 16), camel(), f"{r.randint(2001, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}T{r.randint(0, 23):02d}:00:00Z", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, f"{self.noun()}/{self.noun()}@{r.randint(1, 9)}.{r.randint(0, 30)}.{r.randint(0, 9)}"]))

    def line(self) -> str:
        r = self.r
        s = lambda: "\x01" + self.secret() + "\x02"
        host = r.choice(["db.example", "10.0.0.12", "cache-2.inner.example", "api.host.invalid"])
        scheme = r.choice(["postgres", "mysql", "redis", "amqp", "mongodb", "https"])
        mark = r.choice(["//", "#", "--", "*"])
        pick = r.randrange(44)
        if pick < 7:
            return self.assign(self.secret_name(), s())
        if pick < 9:
            return self.bare(self.secret_name(), s())
        if pick < 13:
            return self.assign(self.secret_name(), self.fake())
        if pick < 15:
            return self.bare(self.secret_name(), self.fake())
        if pick == 15:
            return self.assign(self.hash_name(), r.choice([self.hex(), self.hex(), self.chars("0123456789abcdef", 8, 16), "-".join(self.chars("0123456789abcdef", n, n) for n in (8, 4, 4, 4, 12))]))
        if pick == 16:
            return self.assign(self.name(), r.choice(["\x01ghp_" + self.chars(string.ascii_letters + string.digits, 20, 36) + "\x02", "\x01AKIA" + self.chars(string.ascii_uppercase + string.digits, 16, 16) + "\x02", "\x01eyJhbGciOiJIUzI1NiJ9." + self.chars(string.ascii_letters + string.digits + "-_", 30, 60) + "." + self.chars(string.ascii_letters + string.digits, 30, 60) + "\x02", "\x01xoxb-" + self.chars(string.ascii_letters + string.digits, 20, 36) + "\x02", "\x01sk_live_" + self.chars(string.ascii_letters + string.digits, 20, 36) + "\x02"]))
        if pick < 20:
            return self.assign(r.choice([self.name(), self.name([self.noun(), "token"]), self.name(["token", self.noun()]), self.name([self.noun(), "key"])]), self.plain())
        if pick < 22:
            pw = r.choice([self.chars(string.ascii_letters + string.digits + "._-", 9, 20), self.secret().replace("/", "x").replace("@", "y")])
            return f'{self.name()}("{scheme}://{r.choice(["app", "svc", "reader", ""])}{self.noun()}:\x01{pw}\x02@{host}:{r.randint(1000, 9999)}/{self.noun()}"){r.choice(["", ";"])}'
        if pick == 22:
            return f'{self.name()}("{scheme}://{r.choice(["USER:PASSWORD", "user:****", "%s:%s", "user:password", "${USER}:${PASSWORD}", "<user>:<password>", "$USER:$PASS"])}@{host}/{self.noun()}")'
        if pick < 25:
            v = r.choice(["Bearer " + s(), "Token " + s(), "Basic \x01" + base64.b64encode(f"{self.noun()}:{self.secret()[:14]}".encode()).decode() + "\x02"])
            return r.choice([f'{self.name()}("Authorization", "{v}")', f'{self.name()}("Authorization", "{v}");', f'curl -H "Authorization: {v}" https://{host}/{self.name()}', f'headers["Authorization"] = "{v}"'])
        if pick == 25:
            v = r.choice(["Bearer ", "Token "]) + r.choice(["$" + self.name().upper(), "${" + self.name() + "}", "<token>", "%s"])
            return r.choice([f'curl -H "Authorization: {v}" https://{host}/{self.name()}', f'{self.name()}("Authorization", "{v}")'])
        if pick < 28:
            v = self.secret()
            return f'{self.name()}("https://{host}/v1/{self.noun()}", "\x01{v}\x02"){r.choice(["", ";"])}'
        if pick == 28:
            return f'{self.name()}("https://{host}/v1/{self.noun()}", "{self.plain()}")'
        if pick < 31:
            return r.choice([f"{mark} password: {s()}", f"{mark} old login: {s()}", f"{mark} token for staging is {s()}", f"{mark} TODO remove, key={s()}", f"{mark} pw {s()}", f"{mark} {self.noun()} secret is {s()}", f"{mark} api key: {s()}"])
        if pick < 33:
            return r.choice([f"{mark} Reads one token from the {self.noun()} store and waits until the {self.noun()} is ready.", f"{mark} keep {self.noun()} token before {self.noun()}", f"{mark} the password isn't {self.noun()} when {self.noun()} is empty", f"{mark} Splits a key at each {self.noun()} and returns the pieces in source order.", f"{mark} token can be {self.noun()} here (see {self.noun()}", f"{mark} Callers must hold the {self.noun()} login", f"@param {self.name()}", f"{mark} password: see vault", f"{mark} old login: {self.name()}"])
        if pick == 33:
            return r.choice([f"CREATE USER {self.name()} IDENTIFIED BY '{s()}';", f"ALTER USER {self.name()} SET password = '{s()}';", f"mysql -u {self.name()} --password='{s()}' {self.name()}", f'{self.name()}("--password={s()}")', f"mysql -p{s()} {self.noun()}", f"--api-key={s()}"])
        if pick == 34:
            return r.choice([f"ALTER USER {self.name()} SET password = :{self.name()};", f"mysql -u {self.name()} --password=\"$DB_PASSWORD\" {self.name()}", f'{self.name()}("--password={r.choice(["****", "$PASS", "<password>"])}")', f"INSERT INTO {self.name()} VALUES ({r.randint(1, 9999)}, '{self.chars('0123456789abcdef', 12, 12)}', {r.random():.2f}, '{self.name()}');"])
        if pick == 35:
            k = r.choice(["PRIVATE KEY", "RSA PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY"])
            name = r.choice([self.secret_name(), self.name(["signer"]), self.name()])
            if r.random() < 0.5:
                return self.assign(name, "\x01" + "\\n".join(self.key_block(k, r.randint(2, 6))) + "\x02")
            block = "\n".join(self.key_block(k, r.randint(2, 6), r.choice(["", "  "])))
            return r.choice([f'{name} = """\x01{block}\x02"""', f"{name}: |\n  \x01{block}\x02", f"\x01{block}\x02"])
        if pick == 36:
            k = r.choice(["PUBLIC KEY", "CERTIFICATE", "RSA PUBLIC KEY"])
            return r.choice([self.assign(r.choice([self.name(["public", "key"]), self.name(), r.choice("akpx")]), "\\n".join(self.key_block(k, r.randint(1, 3)))), f"{self.name()}: |\n  " + "\n".join(self.key_block(k, 2, "  ")), f'if {self.name()}.startswith("-----BEGIN PRIVATE KEY-----"):', f'{self.name()} = "-----BEGIN RSA PRIVATE KEY-----"', f"{mark} a block begins with -----BEGIN PRIVATE KEY-----"])
        if pick == 37:
            v = self.secret()
            k = max(1, len(v) // 2)
            n = self.secret_name()
            return f'{n} = (\n    "\x01{v[:k]}\x02"\n    "\x01{v[k:]}\x02"\n)'
        if pick == 38:
            b64 = string.ascii_letters + string.digits + "+/"
            return r.choice([f'"{self.chars(b64, 76, 76)}"', f"{self.name()} = (\n" + "\n".join(f'    "{self.chars(b64, 76, 76)}"' for _ in range(3)) + "\n)", f'{self.name()}("integrity sha512-{self.chars(b64, 86, 86)}==")', f'"{self.name()}@{r.randint(1,9)}.{r.randint(0,9)}.0", integrity "sha512-{self.chars(b64, 86, 86)}=="', f'{self.name()} = "data:image/png;base64,{self.chars(b64, 60, 90)}"'])
        if pick == 39:
            n = self.name().upper()
            return r.choice([f'{self.secret_name()} = os.environ["{n}"]', f'{self.secret_name()} := os.Getenv("{n}")', f"var {self.secret_name()} = process.env.{n};", f'String {self.secret_name()} = System.getenv("{n}");', f'{self.secret_name()} = {self.name()}("{self.noun()}/access_token")', f'{self.secret_name()} = {self.name()}("{self.noun()}/{self.noun()}_pass")', f'let {self.secret_name()} = {self.name()}({self.name()}, {r.randint(1, 9999)});', f"if {self.secret_name()} == nil {{", f"return {self.secret_name()};", f'{self.name()}["{self.secret_name()}"]', f'raise {self.noun().capitalize()}Error("{self.sentence()}") from exc'])
        if pick == 40:
            return r.choice([f"Sign in with `{self.name()}` and password `{s()}` ({self.noun()}).", f"The password is `{s()}`.", f"Use the token `{s()}` for {self.noun()}."])
        if pick == 41:
            return r.choice([f"Set `{self.secret_name().upper()}=<your value>` before the first run.", f"Set `{self.secret_name().upper()}` before the first run.", f"- Reads one {self.noun()} from the {self.noun()} token, see `{self.name()}` and `{self.name()}` ({r.randint(1, 9999)}).", f"The key `{self.name()}` names the {self.noun()}.", f"## {self.noun().capitalize()}Token{self.noun().capitalize()} {r.randint(1, 9)}.{r.randint(1, 99)}"])
        if pick == 42:
            return r.choice([f"{self.name()}.{self.name()}({self.name()}, {r.randint(1, 9999)});", f"for (const {self.name()} of {self.name()}.{self.name(['token', self.noun()])}) {{", f"const {self.name(['token', self.noun()])} = {{ {self.name()}: {self.name()}, {self.name()}: {r.randint(1, 9999)} }};", f'{self.name()} = {{"{self.name(["token", self.noun()])}": {self.name()}, "{self.name()}": {r.randint(1, 9999)}}}', f"def {self.name(['token', self.noun()])}({self.name()}, {self.name()}: str) -> int:", f"func {self.name()}({self.name()} int, {self.name(['key', self.noun()])} string) error {{", f"{self.name()}(`{self.noun()}/${{{self.name()}}}/{r.randint(1, 9999)}`);", f"import {{ {self.name()}, {self.name()} }} from \"./{self.name()}\";"])
        return r.choice([f'{self.name()} = {{"{self.secret_name()}": "{s()}", "{self.name()}": {r.randint(1, 99)}}}', f"secret: vault/{self.name()}", f'{self.name(["user"])} = "{self.name()}"', f"user: {self.name()}", f"{mark} {self.noun()}-ui v{r.randint(1, 9)}.{r.randint(0, 30)}.{r.randint(0, 9)} | (c) the {self.noun()} authors | MIT license", f"{mark} Copyright {r.randint(2001, 2025)} the {self.noun()} authors", f'const {self.name()} = "data:image/png;base64,{self.chars(string.ascii_letters + string.digits + "+/", 60, 400)}";', f'"""{self.r.choice([self.noun().capitalize() + ".", "Docs.", "tbd", "TODO", "n/a", self.sentence() + "."])}', f'def {self.name(["token", self.noun()])}():\n    """{self.noun().capitalize()}.\n    """', f'log.info("{self.sentence()}", {self.name()}, {self.name()})'])

    def sequence(self, neutral: bool = False):
        raw = self.neutral() if neutral else self.line()
        text, spans, at = [], [], 0
        for part in re.split(r"([\x01\x02])", raw):
            if part == "\x01":
                spans.append([at, at])
            elif part == "\x02":
                spans[-1][1] = at
            else:
                text.append(part)
                at += len(part)
        t = Tokens("".join(text), 0, at)
        labels = [int(any(a < y and x < b for a, b in spans)) for x, y in zip(t.at, t.end, strict=True)]
        return features(t), labels


@lru_cache(maxsize=2)
def trained(samples: int = SAMPLES, epochs: int = EPOCHS, seed: int = SEED) -> Field:
    """The field with its weights; trained once per process."""
    make = Maker(seed)
    sequences = [make.sequence() for _ in range(samples)]
    return Field.fit(sequences + [make.sequence(neutral=True) for _ in range(samples // 6)], epochs)


_FIELDS: dict[bytes, Field] = {}


def _field(index: dict[str, int], weights: np.ndarray, trans: np.ndarray) -> Field:
    """The field of these weights with what it has in mind; one per process, whatever tasks it runs."""
    key = weights.tobytes() + trans.tobytes()
    if key not in _FIELDS:
        _FIELDS.clear()
        _FIELDS[key] = Field(index, weights, trans)
    return _FIELDS[key]


# ------------------------------------------------------------------ operator


#: A line whose value starts on the next one, and a line that continues it.
CONTINUED = re.compile(r"""[=(\\+]\s*\(?\s*$|^\s*["']?[\w.-]+["']?\s*:\s*$""")
CONTINUES = re.compile(r"""\s*[+.]?\s*["'`]""")


def windows(text: str) -> list[tuple[int, int]]:
    """Spans of whole lines to label, which hold every line of the text: each with the lines that continue it."""
    out: list[tuple[int, int]] = []
    b, n = -1, len(text)
    while b < n:
        a = b + 1
        b = text.find("\n", a)
        b = n if b < 0 else b
        line = text[a:b]
        if not line or line.isspace():
            continue
        if "-----BEGIN" in line and "-----END" not in line:
            end = text.find("-----END", b)
            if end >= 0 and "-----BEGIN" not in text[b:end]:
                b = text.find("\n", end)
                b = n if b < 0 else b
        elif line.rstrip()[-1] in "=(\\+:" and CONTINUED.search(line):
            # a value that starts on the next line, in literals one below the other
            while b < n:
                e = text.find("\n", b + 1)
                e = n if e < 0 else e
                if not CONTINUES.match(text, b + 1, e):
                    break
                b = e
        out.append((a, b))
    return out


def find(text: str | None, field: Field) -> list[tuple[int, int]]:
    """Character spans of credentials, in order; touching and merely quoted-apart tokens are one value."""
    if not text:
        return []
    out: list[tuple[int, int]] = []
    for lo, hi in windows(text):
        line = text[lo:hi]
        lo += len(line) - len(line.lstrip())
        line = line.strip() if lo else ""  # the first token may depend on the character before it
        if line in field.bare:
            continue
        if not field.possible([(m.lastgroup, m.group()) for m in TOKEN.finditer(text, lo, hi)]):
            if len(field.bare) > MEMORY:
                field.bare.clear()
            if line:
                field.bare.add(line)
            continue
        t = Tokens(text, lo, hi)
        labels = field.viterbi(features(t))
        for i, lab in enumerate(labels):
            if not lab or t.kind[i] in ("nl", "q"):
                continue
            a, b = t.at[i], t.end[i]
            if out and out[-1][1] <= a and re.fullmatch(r"\s*|[\\\s]*", text[out[-1][1] : a]):
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    # an escape behind the last character belongs to the code around it
    return [(a, b - 1 if text[b - 1] == "\\" and b - a > 1 else b) for a, b in out]


def values(text: str, spans: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Spans that belong to one value: literals one below the other continue the one before."""
    groups: list[list[tuple[int, int]]] = []
    for a, b in spans:
        if groups and re.fullmatch(r"""["'`]\s*[+\\]?\s*\n\s*[+.]?\s*["'`]""", text[groups[-1][-1][1] : a]):
            groups[-1].append((a, b))
        else:
            groups.append([(a, b)])
    return groups


def blank(text: str, spans: list[tuple[int, int]], char: str = BLANK) -> str:
    """The text with every character of the spans replaced; line ends stay, so does the length."""
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        out.append(re.sub(r"[^\r\n]", char, text[a:b]))
        at = b
    out.append(text[at:])
    return "".join(out)


def find_credentials(df: DataFrame, id_col: str = "id", text_col: str = "content", redact: bool = False, only_found: bool = True) -> DataFrame:
    """``(id, line_no, start, length)`` per credential, or with ``redact`` ``(id, content, n_found)``.

    ``line_no`` is 1-based and counts ``\\n``; ``start`` is the character offset in the text. With
    ``redact`` each credential's characters are blanked one by one and nothing else changes;
    ``only_found=False`` keeps rows without one. Null and empty texts hold nothing. Repeated rows
    stay repeated.
    """
    model = trained()
    parts = (model.index, model.weights, model.trans)
    src = df.select(F.col(id_col).cast("bigint").alias("__id"), F.col(text_col).cast("string").alias("__t"))
    schema = f"{id_col} bigint, content string, n_found int" if redact else f"{id_col} bigint, line_no int, start int, length int"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = _field(*parts)
        for batch in batches:
            rows: list[tuple] = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                spans = find(t, field)
                if redact:
                    if spans or not only_found:
                        rows.append((i, blank(t, spans) if spans else t, len(values(t, spans)) if spans else 0))
                else:
                    for group in values(t, spans) if spans else []:
                        a, b = group[0][0], group[-1][1]
                        rows.append((i, t.count("\n", 0, a) + 1, a, b - a))
            if rows:
                kinds = [pa.int64(), pa.string(), pa.int32()] if redact else [pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return spread(src).mapInArrow(run, schema)
