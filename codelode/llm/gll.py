"""A generalised LL parser with graph-structured stacks.

A grammar is written in EBNF. Every rule becomes a deterministic automaton over terminals and
rule names; the parser runs these automata with a stack of return states. Where the next token
leaves one possibility, a single stack grows and shrinks. Where it leaves several, all of them go
on in step, one token at a time; calls made at one position with one return state share a stack
node, so ambiguity costs polynomial, not exponential, time. As soon as one possibility is left,
the parser is a plain pushdown automaton again.

Grammars must not have left recursion or rules that match nothing; repetition is written with
``*`` and ``+`` instead. What a parse reports are events, in order: the index of each token that
a terminal marked ``x!`` took, and ``(rule, first token, token behind)`` of each match of a rule whose
head is marked ``rule! :=``. The first token of a match travels in the stack nodes, so matches
are right however stacks were shared. A rejected text reports the matches completed before it was
rejected, so that whole constructs of broken texts come out. A rule ``rest``, if there is one,
says what may follow an error; parsing can start with it at any token.
"""

from __future__ import annotations

import re

EOF, ERROR = 0, 1

_LEX = re.compile(r"'(?:[^'])+'!?|[A-Za-z_]\w*!?|:=|[()?*+|]")


class _Close(dict):
    """Row of a state that ends a match of ``rule``, whatever the next token is, and goes on in ``state``."""

    def __init__(self, rule: str, state: int):
        super().__init__()
        self.rule, self.state = rule, state

    def get(self, _token):
        return self


class _Open(tuple):
    """A move ``(pushes, next, marked)`` of which some pushes open a match."""


class Grammar:
    """Tables of one grammar. ``terminals`` numbers literals and token classes."""

    def __init__(self, text: str, start: str = "file"):
        self.terminals: dict[str, int] = {"<eof>": EOF, "<error>": ERROR}
        words = _LEX.findall(text)
        heads = [k for k, w in enumerate(words) if k + 1 < len(words) and words[k + 1] == ":="]
        self.names = {words[k].rstrip("!"): j for j, k in enumerate(heads)}
        self._marked = {j: words[k][:-1] for j, k in enumerate(heads) if words[k].endswith("!")}
        self._closing: dict[tuple[int, int], int] = {}  # (rule, state behind the call) to the state that closes the match
        self._edges: list[list[tuple]] = []  # of the automata before determinisation: (symbol or None, target)
        rules = []
        for j, k in enumerate(heads):
            body = words[k + 2 : heads[j + 1] if j + 1 < len(heads) else len(words)]
            self._w, self._at = body, 0
            a, b = self._alt()
            if self._at != len(body):
                raise ValueError(f"grammar: {words[k]}: {body[self._at:self._at + 5]}")
            rules.append((a, b))
        self._determinise(rules)
        starts = [self.names[x] for x in (start, "rest") if x in self.names]
        self._first_follow(starts)
        self.start = self.begin[starts[0]]
        self.rest = self.begin[starts[-1]]
        self._tables()

    # -- reading the notation

    def _state(self) -> int:
        self._edges.append([])
        return len(self._edges) - 1

    def _alt(self):
        a, b = self._state(), self._state()
        while True:
            x, y = self._seq()
            self._edges[a].append((None, x))
            self._edges[y].append((None, b))
            if self._at < len(self._w) and self._w[self._at] == "|":
                self._at += 1
                continue
            return a, b

    def _seq(self):
        a = b = self._state()
        while self._at < len(self._w) and self._w[self._at] not in ("|", ")"):
            x, y = self._item()
            self._edges[b].append((None, x))
            b = y
        return a, b

    def _item(self):
        w = self._w[self._at]
        self._at += 1
        if w == "(":
            a, b = self._alt()
            self._at += 1
        else:
            a, b = self._state(), self._state()
            mark = w.endswith("!")
            w = w.rstrip("!")
            if w[0] == "'" or w.isupper():
                name = w[1:-1] if w[0] == "'" else w
                sym = ("t", self.terminals.setdefault(name, len(self.terminals)), mark)
            else:
                sym = ("n", self.names[w], False)
            self._edges[a].append((sym, b))
        while self._at < len(self._w) and self._w[self._at] in "?*+":
            op = self._w[self._at]
            self._at += 1
            x, y = self._state(), self._state()
            self._edges[x].append((None, a))
            self._edges[b].append((None, y))
            if op in "?*":
                self._edges[x].append((None, y))
            if op in "*+":
                self._edges[b].append((None, a))
            a, b = x, y
        return a, b

    # -- automata

    def _closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for sym, t in self._edges[todo.pop()]:
                if sym is None and t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def _determinise(self, rules) -> None:
        self.begin: list[int] = []
        self.rule_of: list[int] = []
        self.final: list[bool] = []
        self.go: list[dict] = []
        for r, (a, b) in enumerate(rules):
            known: dict[frozenset, int] = {}

            def number(s):
                if s not in known:
                    known[s] = len(self.go)
                    self.go.append({})
                    self.rule_of.append(r)
                    self.final.append(b in s)
                    todo.append(s)
                return known[s]

            todo: list[frozenset] = []
            self.begin.append(number(self._closure([a])))
            while todo:
                s = todo.pop()
                by: dict[tuple, set] = {}
                for q in s:
                    for sym, t in self._edges[q]:
                        if sym is not None:
                            by.setdefault(sym, set()).add(t)
                me = known[s]
                for sym, ts in sorted(by.items()):
                    self.go[me][sym] = number(self._closure(ts))
        del self._edges

    def _first_follow(self, starts: list[int]) -> None:
        n = len(self.begin)
        self.first = [set() for _ in range(n)]
        for r in range(n):
            if self.final[self.begin[r]]:
                raise ValueError(f"grammar: rule {list(self.names)[r]} may be empty")
        changed = True
        while changed:
            changed = False
            for r in range(n):
                for (kind, x, _), _t in self.go[self.begin[r]].items():
                    new = {x} if kind == "t" else self.first[x]
                    if not new <= self.first[r]:
                        self.first[r] |= new
                        changed = True
        follow = [set() for _ in range(n)]
        for r in starts:
            follow[r].add(EOF)
        changed = True
        while changed:
            changed = False
            for s, out in enumerate(self.go):
                for (kind, x, _), t in out.items():
                    if kind == "t":
                        continue
                    new = set()
                    for k2, y, _m in self.go[t]:
                        new |= {y} if k2 == "t" else self.first[y]
                    if self.final[t]:
                        new |= follow[self.rule_of[s]]
                    if not new <= follow[x]:
                        follow[x] |= new
                        changed = True
        self.follow = follow

    def _moves(self, s: int, t: int, depth: int = 0) -> list[tuple]:
        """Ways to consume token ``t`` in state ``s``: (return states pushed, next state, marked).

        A negative push stands for the index of the token, where a match of a marked rule begins.
        """
        if depth > 60:
            raise ValueError(f"grammar: left recursion in {list(self.names)[self.rule_of[s]]}")
        out = []
        for (kind, x, mark), nxt in self.go[s].items():
            if kind == "t":
                if x == t:
                    out.append(((), nxt, mark))
            elif t in self.first[x]:
                if x in self._marked:
                    close = self._closing.setdefault((x, nxt), len(self.go) + len(self._closing))
                    own = (~close, close)
                else:
                    # a state that can only return needs no place on the stack
                    own = () if self.final[nxt] and not self.go[nxt] else (nxt,)
                for p, target, m in self._moves(self.begin[x], t, depth + 1):
                    out.append((own + p, target, m))
        return list(dict.fromkeys(out))

    def _tables(self) -> None:
        """``fast[s][t]``: int = next state; tuple = (pushes, next, mark); -1 = return; list = (moves, return).

        States behind those of the rules close a match.
        """
        self.fast: list[dict] = []
        for s in range(len(self.go)):
            row = {}
            back = self.follow[self.rule_of[s]] if self.final[s] else set()
            heads = set(back)
            for kind, x, _ in self.go[s]:
                heads |= {x} if kind == "t" else self.first[x]
            for t in heads:
                moves = self._moves(s, t)
                if not moves:
                    row[t] = -1
                elif len(moves) == 1 and t not in back:
                    p, nxt, m = moves[0]
                    row[t] = nxt if not p and not m else _Open(moves[0]) if min(p, default=0) < 0 else (p, nxt, m)
                else:
                    row[t] = [moves, t in back]
            self.fast.append(row)
        self.fast += [_Close(self._marked[r], nxt) for r, nxt in self._closing]

    # -- running

    def parse(self, toks: list[int], at: int = 0, state: int | None = None) -> tuple[bool, int, list]:
        """(accepted, index of the last token looked at, events).

        ``toks`` must end with ``EOF``. Parsing starts at index ``at``, with the start rule unless
        ``state`` is ``rest``.
        """
        fast = self.fast
        state, stack, i = self.start if state is None else state, None, at
        events: list = []
        t = toks[i]
        while True:
            act = fast[state].get(t)
            if act.__class__ is int:
                if act >= 0:
                    state = act
                    i += 1
                    t = toks[i]
                elif stack is None:
                    return t == EOF, i, events
                else:
                    state, up = stack
                    if up.__class__ is list:
                        if len(up) > 1:
                            got = self._together(toks, i, [(state, p, None) for p in up], events)
                            if got.__class__ is bool:
                                return got, self._where, events
                            state, stack, i = got
                            t = toks[i]
                            continue
                        up = up[0]
                    stack = up
            elif act.__class__ is tuple:
                pushes, state, mark = act
                for r in pushes:
                    stack = (r, stack)
                if mark:
                    events.append(i)
                i += 1
                t = toks[i]
            elif act.__class__ is _Close:
                first, up = stack
                events.append((act.rule, first, i))
                state = act.state
                if up.__class__ is list:
                    if len(up) > 1:
                        got = self._together(toks, i, [(state, p, None) for p in up], events)
                        if got.__class__ is bool:
                            return got, self._where, events
                        state, stack, i = got
                        t = toks[i]
                        continue
                    up = up[0]
                stack = up
            elif act.__class__ is _Open or act is not None and len(act[0]) == 1 and not self._returns(stack, t):
                pushes, state, mark = act if act.__class__ is _Open else act[0][0]
                for r in pushes:
                    stack = (r if r >= 0 else i, stack)
                if mark:
                    events.append(i)
                i += 1
                t = toks[i]
            elif act is None:
                events += self._ended(state, stack, i)
                return False, i, events
            else:
                got = self._together(toks, i, [(state, stack, None)], events)
                if got.__class__ is bool:
                    return got, self._where, events
                state, stack, i = got
                t = toks[i]

    def _ended(self, state: int, stack, i: int) -> list:
        """Matches that end before token ``i`` if this state is left behind there."""
        out = []
        while True:
            row = self.fast[state]
            if row.__class__ is _Close:
                first, stack = stack
                out.append((row.rule, first, i))
                state = row.state
                stack = stack[0] if stack.__class__ is list else stack
                continue
            if not self.final[state] or stack is None:
                return out
            state, stack = stack
            stack = stack[0] if stack.__class__ is list else stack

    def _returns(self, stack, t) -> bool:
        """Whether a return to this stack could go on with token ``t``."""
        fast = self.fast
        while stack is not None:
            s, stack = stack
            if stack.__class__ is list:
                if len(stack) > 1:
                    return True
                stack = stack[0]
            while fast[s].__class__ is _Close:
                s, (_, stack) = fast[s].state, stack
                if stack.__class__ is list:
                    if len(stack) > 1:
                        return True
                    stack = stack[0]
            a = fast[s].get(t)
            if a is None:
                return False
            if a.__class__ is not int or a >= 0:
                return True
        return t == EOF

    def _together(self, toks, i, work, events):
        """Follows several possibilities in step until one is left; extends ``events`` by its events."""
        fast = self.fast
        while True:
            t = toks[i]
            nxt: dict[tuple, tuple] = {}
            made: dict[int, tuple] = {}
            seen = {(s, id(n)) for s, n, _ in work}
            held = list(work)  # keeps every node whose identity is in ``seen`` alive
            accepted = None
            begun = list(work)
            while work:
                s, node, log = work.pop()
                act = fast[s].get(t)
                if act is None:
                    continue
                if act.__class__ is int:
                    if act >= 0:
                        nxt.setdefault((act, id(node)), (act, node, log))
                        continue
                    moves, back = (), True
                elif act.__class__ is tuple or act.__class__ is _Open:
                    moves, back = (act,), False
                elif act.__class__ is _Close:
                    first, up = node
                    log = (log, (act.rule, first, i))
                    for p in up if up.__class__ is list else (up,):
                        if (act.state, id(p)) not in seen:
                            seen.add((act.state, id(p)))
                            work.append((act.state, p, log))
                            held.append(p)
                    continue
                else:
                    moves, back = act
                for pushes, target, mark in moves:
                    n = node
                    for r in pushes:
                        g = made.get(r)
                        if g is None:
                            g = made[r] = (r if r >= 0 else i, [n])
                        elif not any(p is n for p in g[1]):
                            g[1].append(n)
                        n = g
                    nxt.setdefault((target, id(n)), (target, n, (log, i) if mark else log))
                if back:
                    if node is None:
                        if t == EOF:
                            accepted = (log,)
                        continue
                    r, up = node
                    for p in up if up.__class__ is list else (up,):
                        if (r, id(p)) not in seen:
                            seen.add((r, id(p)))
                            work.append((r, p, log))
                            held.append(p)
            if t == EOF or not nxt:
                self._where = i
                if accepted is not None:
                    events += _unroll(accepted[0])
                else:
                    events += max((_unroll(log) + self._ended(s, node, i) for s, node, log in begun), key=_matches)
                return accepted is not None
            i += 1
            if len(nxt) == 1:
                (s, node, log), = nxt.values()
                events += _unroll(log)
                return s, node, i
            work = list(nxt.values())


def _matches(events: list) -> int:
    return sum(e.__class__ is tuple for e in events)


def _unroll(log) -> list:
    out = []
    while log is not None:
        log, i = log
        out.append(i)
    return out[::-1]
