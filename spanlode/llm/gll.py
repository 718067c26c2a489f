"""A generalised LL recogniser with a graph-structured stack, over token trees.

A grammar is text: ``Name = body`` lines, a body being an EBNF of names, ``'tokens'``, upper-case token classes, bracket
groups and the operators ``| ? * + ( )``. Each rule is compiled to a small automaton. ``b:Rule``, ``p:Rule``, ``s:Rule``
and ``i:Rule`` stand for a brace, parenthesis, square or indentation group whose whole content is a ``Rule``; ``ANY`` is
any content, ``EMPTY`` none. ``@nl`` is zero wide and holds before a token that starts a line and at an end,
``@nobrace`` holds before anything but a brace group, ``@noword`` before anything but ``function`` and ``class``,
``@noelse``, ``@noquery``, ``@noif``, ``@nopower`` and ``@noassign`` before anything but ``else``, ``?``, ``if``, ``**``
and an assignment or arrow: what can go on that way has to, so a long chain has one end at each of its places.

Descriptors (automaton state, stack node, position) are worked off in any order; a stack node is shared by all callers
of a rule at a position, so left recursion and ambiguity cost nothing special. Several start rules (dialects) run on
the same tokens with the same tables. Rules named in ``memo`` are worked off on their own, once a place, on a stack of
frames, so chains may be as long as memory allows. What such a rule accepts depends only on the tokens it looked at; where
these are few, its ends are also kept in a tree over them, for the next text. Groups are recognised from the inside out
and become single tokens, named by the rules that accept their content. The trees are caches: emptying them changes no
result. A rule ``TX`` is ``X`` without ``return``; it is asked only where ``X`` accepts a content that has one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

END = 0
NL_BIT = 1 << 30  # set in a token that starts a line
CACHE = 400_000
GROUPS = 50_000
DEPTH = 256  # tokens
_LEX = re.compile(r"\s*(?:('[^']+')|([bpsi]:\w+|@\w+|\w+)|([|?*+()]))")


@dataclass
class _Rule:
    start: int
    memo: bool = False
    tree: dict = field(default_factory=dict)
    first: set = field(default_factory=set)
    nullable: bool = False


class Grammar:
    """Compiled grammar. ``terminals`` maps a terminal's name to its number; ``starts`` are the dialects' rules."""

    def __init__(self, text: str, starts: list[str], memo: set[str]):
        self.starts = starts
        bodies = {}
        for line in re.sub(r"\n[ \t]+(?=\S)", " ", text).splitlines():
            if line.strip():
                name, _, body = line.partition(" = ")
                bodies[name.strip()] = body
        self.terminals: dict[str, int] = {"END": END}
        self.rules: dict[str, _Rule] = {}
        self.edges: list[list] = []  # state -> [(symbol kind, symbol, target)]
        self.final: list[bool] = []
        self._names = set(bodies)
        for name, body in bodies.items():
            self.rules[name] = _Rule(self._compile(body), name in memo)
        self._groups: dict[str, list[tuple[str, int]]] = {"b": [], "p": [], "s": [], "i": []}
        for t, n in self.terminals.items():
            if t[1:2] == ":" and len(t) > 2 and t[0] in self._groups:
                self._groups[t[0]].append((t[2:], n))
        unknown = {n for e in self.edges for kind, n, _ in e if kind == "nl" and n != "@nl"} - {"@nobrace", "@noword", "@noelse", "@noquery", "@noif", "@nopower", "@noassign"}
        unknown |= {t for t in self.terminals if re.fullmatch("[A-Z][a-z]+[A-Za-z]*", t)} - set("None True False Self".split())
        if unknown:
            raise ValueError(f"no rules {sorted(unknown)}")
        for kind, held in self._groups.items():
            for rule, _ in held:
                if rule not in self.rules and rule not in ("ANY", "EMPTY"):
                    raise ValueError(f"no rule {rule} for {kind}:{rule}")
        named = lambda words: {self.terminals[w] for w in words.split() if w in self.terminals}
        self._barred = {"@nobrace": {n for _, n in self._groups["b"]}, "@noword": named("function class"), "@noelse": named("else"), "@noquery": named("?"), "@noif": named("if"), "@nopower": named("**")}
        self._barred["@noassign"] = named("= += -= *= /= %= **= <<= &= |= ^= &&= ||= ??= => ->")
        self._groups = {kind: sorted(held, key=lambda r: r[0][:1] == "T" and r[0][1:] in self._names) for kind, held in self._groups.items()}
        self.returns = named("return") | {self.terminals.setdefault("RETURNS", len(self.terminals))}
        self._firsts()
        self.matches: list[frozenset[int]] = [frozenset({END})]  # token -> terminals
        self.token_of: dict[frozenset[int], int] = {self.matches[0]: 0}
        self.acts: list[dict] = [{} for _ in self.edges]
        self.group_cache: dict[str, dict] = {k: {} for k in self._groups}
        self.nodes = 0

    # Compilation: Thompson's construction, then states without empty edges.

    def _compile(self, body: str) -> int:
        tokens, at = [], 0
        body = body.strip()
        while at < len(body):
            m = _LEX.match(body, at)
            if not m:
                raise ValueError(f"bad grammar near {body[at : at + 30]!r}")
            tokens.append(m[1] or m[2] or m[3])
            at = m.end()
        raw: list[list] = []

        def new() -> int:
            raw.append([])
            return len(raw) - 1

        def alternatives(i: int):
            a, b = new(), new()
            while True:
                x, y, i = sequence(i)
                raw[a].append((None, x))
                raw[y].append((None, b))
                if i < len(tokens) and tokens[i] == "|":
                    i += 1
                    continue
                return a, b, i

        def sequence(i: int):
            a = b = new()
            while i < len(tokens) and tokens[i] not in "|)":
                if tokens[i] == "(":
                    x, y, i = alternatives(i + 1)
                    if tokens[i] != ")":
                        raise ValueError(body)
                else:
                    x, y = new(), new()
                    raw[x].append((tokens[i], y))
                i += 1
                while i < len(tokens) and tokens[i] in "?*+":
                    op = tokens[i]
                    p, q = new(), new()
                    raw[p].append((None, x))
                    raw[y].append((None, q))
                    if op in "?*":
                        raw[p].append((None, q))
                    if op in "*+":
                        raw[y].append((None, x))
                    x, y = p, q
                    i += 1
                raw[b].append((None, x))
                b = y
            return a, b, i

        start, end, i = alternatives(0)
        if i != len(tokens):
            raise ValueError(f"unbalanced: {body}")

        def closure(s: int) -> list[int]:
            seen, todo = {s}, [s]
            while todo:
                for sym, t in raw[todo.pop()]:
                    if sym is None and t not in seen:
                        seen.add(t)
                        todo.append(t)
            return sorted(seen)

        number: dict[tuple, int] = {}
        todo = []

        def state(raw_states: frozenset) -> int:
            if raw_states not in number:
                number[raw_states] = len(self.edges)
                self.edges.append([])
                self.final.append(end in raw_states)
                todo.append(raw_states)
            return number[raw_states]

        first = state(frozenset(closure(start)))
        while todo:
            held = todo.pop()
            by_symbol: dict[str, set] = {}
            for s in held:
                for sym, t in raw[s]:
                    if sym is not None:
                        by_symbol.setdefault(sym, set()).update(closure(t))
            for sym, targets in by_symbol.items():
                target = state(frozenset(targets))
                if sym[0] == "@":
                    edge = ("nl", sym, target)
                elif sym in self._names:
                    edge = ("rule", sym, target)
                else:
                    edge = ("token", self.terminals.setdefault(sym.strip("'"), len(self.terminals)), target)
                self.edges[number[held]].append(edge)
        return first

    def _firsts(self) -> None:
        changed = True
        while changed:
            changed = False
            for rule in self.rules.values():
                first, nullable = self.first_of(rule.start)
                if nullable != rule.nullable or not first <= rule.first:
                    rule.nullable, changed = nullable or rule.nullable, True
                    rule.first |= first

    def first_of(self, state: int) -> tuple[set, bool]:
        out, seen, todo, nullable = set(), {state}, [state], False
        while todo:
            s = todo.pop()
            nullable |= self.final[s]
            for kind, sym, target in self.edges[s]:
                onward = kind == "nl"
                if kind == "token":
                    out.add(sym)
                elif kind == "rule":
                    out |= self.rules[sym].first
                    onward = self.rules[sym].nullable
                if onward and target not in seen:
                    seen.add(target)
                    todo.append(target)
        return out, nullable

    # Tokens.

    def token(self, *names: str) -> int:
        """The number of a token that counts as each of the named terminals; names no rule uses are ignored."""
        held = frozenset(self.terminals[n] for n in names if n in self.terminals)
        return self._token(held)

    def _token(self, held: frozenset[int]) -> int:
        if not held:
            held = frozenset({-1})
        n = self.token_of.get(held)
        if n is None:
            n = self.token_of[held] = len(self.matches)
            self.matches.append(held)
        return n

    def group(self, kind: str, content: list[int]) -> int:
        """The token of a bracket group with this content."""
        key = tuple(content)
        cache = self.group_cache[kind]
        n = cache.get(key)
        if n is None:
            held = set()
            returning = any(not self.returns.isdisjoint(self.matches[t & ~NL_BIT]) for t in content)
            for rule, terminal in self._groups[kind]:
                base = self.terminals.get(f"{kind}:{rule[1:]}") if rule[0] == "T" and rule[1:] in self._names else None
                if base is not None and (base not in held or not returning):
                    ok = base in held
                else:
                    ok = rule == "ANY" or (rule == "EMPTY" and not content) or (rule != "EMPTY" and self.accepts(rule, content))
                if ok:
                    held.add(terminal)
            if returning:
                held.add(self.terminals["RETURNS"])
            n = self._token(frozenset(held))
            if len(cache) > GROUPS:
                cache.clear()
            cache[key] = n
        return n

    # Recognition.

    def accepts(self, rule: str, tokens: list[int], known: dict | None = None) -> bool:
        """Whether the whole of ``tokens`` is a ``rule``; ``known`` keeps what rules accept at places of these tokens."""
        r = self.rules[rule]
        if tokens and r.first.isdisjoint(self.matches[tokens[0] & ~NL_BIT]) and not r.nullable:
            return False
        return not tokens and r.nullable or len(tokens) in self._run(rule, [*tokens, END | NL_BIT], {} if known is None else known)

    def accepted_by(self, tokens: list[int]) -> list[str]:
        """The dialects that accept the tokens."""
        known: dict = {}
        return [s for s in self.starts if self.accepts(s, tokens, known)]

    def _known(self, name: str, rule: _Rule, tokens: list[int], at: int, places: dict):
        """(lengths of what the rule accepts at ``at``, how many tokens it looked at) if that was found before."""
        found = places.get((name, at))
        if found is not None:
            return found
        node, i = rule.tree, at
        while node is not None:
            found = node.get(-1)
            if found is not None:
                places[name, at] = found
                return found
            node = node.get(tokens[i])
            i += 1
        return None

    def _keep(self, name: str, tokens: list[int], at: int, found: tuple, places: dict) -> None:
        places[name, at] = found
        if found[1] > DEPTH:
            return
        if self.nodes > CACHE:
            for r in self.rules.values():
                r.tree = {}
            self.nodes = 0
        node = self.rules[name].tree
        for t in tokens[at : at + found[1]]:
            below = node.get(t)
            if below is None:
                below = node[t] = {}
                self.nodes += 1
            node = below
        node[-1] = found

    def _actions(self, state: int, token: int) -> tuple:
        """What can be done in ``state`` before ``token``; looked up once, then kept."""
        out, held = [], self.matches[token & ~NL_BIT]
        for kind, sym, target in self.edges[state]:
            if kind == "token":
                if sym in held:
                    out.append((0, None, None, target))
            elif kind == "nl":
                if token & NL_BIT if sym == "@nl" else held.isdisjoint(self._barred[sym]):
                    out.append((1, None, None, target))
            else:
                rule = self.rules[sym]
                if rule.nullable or not rule.first.isdisjoint(held):
                    out.append((2 if rule.memo else 3, sym, rule, target))
        acts = self.acts[state][token] = (self.final[state], tuple(out))
        return acts

    def _run(self, name: str, tokens: list[int], places: dict) -> set[int]:
        """Ends of ``name`` at the beginning. A frame is a memo rule at a place, with what is left to do there."""
        acts, frames = self.acts, []
        at, far, ends, seen, stack, waiting = 0, 0, set(), set(), {}, []
        todo = [(self.rules[name].start, None, 0)]
        while True:
            while todo:
                d = todo.pop()
                if d in seen:
                    continue
                seen.add(d)
                state, node, p = d
                token = tokens[p]
                if p > far:
                    far = p
                a = acts[state].get(token)
                final, edges = a if a is not None else self._actions(state, token)
                for kind, sym, rule, target in edges:
                    if kind == 0:
                        todo.append((target, node, p + 1))
                    elif kind == 2:
                        found = self._known(sym, rule, tokens, p, places)
                        if found is None:
                            waiting.append((sym, rule, p, target, node))
                            continue
                        if p + found[1] - 1 > far:
                            far = p + found[1] - 1
                        for n in found[0]:
                            todo.append((target, node, p + n))
                    elif kind == 3:
                        key = (sym, p)
                        child = stack.get(key)
                        if child is None:
                            child = stack[key] = ([], set())
                            todo.append((rule.start, key, p))
                        child[0].append((target, node))
                        for q in child[1]:
                            todo.append((target, node, q))
                    else:
                        todo.append((target, node, p))
                if final:
                    if node is None:
                        ends.add(p)
                    else:
                        callers, popped = stack[node]
                        if p not in popped:
                            popped.add(p)
                            for target, caller in callers:
                                todo.append((target, caller, p))
            if waiting:
                sym, rule, p, target, node = waiting.pop()
                found = self._known(sym, rule, tokens, p, places)
                if found is None:  # its own frame first, then this again
                    waiting.append((sym, rule, p, target, node))
                    frames.append((name, at, far, ends, seen, stack, waiting))
                    name, at, far, ends, seen, stack, waiting = sym, p, p, set(), set(), {}, []
                    todo = [(rule.start, None, p)]
                    continue
                far = max(far, p + found[1] - 1)
                todo = [(target, node, p + n) for n in found[0]]
            elif frames:
                self._keep(name, tokens, at, (tuple(sorted(e - at for e in ends)), far + 1 - at), places)
                name, at, far, ends, seen, stack, waiting = frames.pop()
            else:
                return ends
