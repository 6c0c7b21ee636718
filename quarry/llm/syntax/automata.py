"""Content grammars as transition networks over token symbols: recognition, and least-cost repair.

A grammar gives, for every kind of bracket content, a rule over tokens in which a nested bracket pair is
one symbol that carries the kinds its own content was found to match. Parsing fills a chart of (bracket
span, kind) from the inside out. A rule is a position automaton whose positions are terminals or calls of
rules, its own among them; the calls open at a place form a stack. Sets of stacks are the states of an
automaton that is made deterministic only as far as texts need it, so a known sequence of symbols costs one
look-up each. The repair fills the same chart level by level: level c holds what c edits can reach.
"""

from __future__ import annotations

import re
from array import array
from itertools import chain

_ITEM = re.compile(r"\s*(?:'([^']+)'|<(\w+)>|([A-Za-z_]\w*)|([|*+?()]))")
#: States kept for one grammar, and stacks in all of them; beyond it the table starts anew.
MOST_STATES, MOST_STACKS = 60_000, 2_000_000


class Grammar:
    """Rules ``name = expression``; upper-case names are lexical classes, ``<kind>`` a bracket pair of that content."""

    def __init__(self, text: str, insertable: str = ""):
        self.insertable = insertable.split()
        self.text: dict[str, list] = {}
        for line in filter(None, re.sub(r"\n[ \t]+", " ", text).split("\n")):
            name, _, body = line.partition("=")
            self.text[name.strip()] = self._items(body)
        self.labels: list[str] = []
        self.calls: list[str | None] = []
        self.follow: list[list[int]] = []
        self.ends: list[bool] = []
        self.first: dict[str, list[int]] = {}
        self.nullable: dict[str, bool] = {}
        built = {name: self._build(self._tree(name)) for name in self.text}
        for name, (_, first, last) in built.items():
            self.first[name] = sorted(first)
            for p in last:
                self.ends[p] = True
        self._find_nullable(built)
        self._reset()

    @staticmethod
    def _items(body: str) -> list:
        out, at = [], 0
        body = body.strip()
        while at < len(body):
            m = _ITEM.match(body, at)
            if not m:
                raise ValueError(f"bad rule near {body[at : at + 30]!r}")
            out.append(m.groups())
            at = m.end()
        return out

    def _tree(self, name: str) -> tuple:
        items, place = self.text[name], [0]

        def alternatives() -> tuple:
            options = [sequence()]
            while place[0] < len(items) and items[place[0]][3] == "|":
                place[0] += 1
                options.append(sequence())
            return options[0] if len(options) == 1 else ("or", *options)

        def sequence() -> tuple:
            parts = []
            while place[0] < len(items) and items[place[0]][3] not in ("|", ")"):
                literal, kind, word, sign = items[place[0]]
                place[0] += 1
                if sign == "(":
                    node = alternatives()
                    place[0] += 1
                elif literal is not None:
                    node = ("t", literal, None)
                elif kind is not None:
                    node = ("t", f"<{kind}>", None)
                elif word in self.text:
                    node = ("t", word, word)
                elif word.isupper():
                    node = ("t", word, None)
                else:
                    raise ValueError(f"unknown rule {word} in {name}")
                while place[0] < len(items) and items[place[0]][3] in ("*", "+", "?"):
                    node = (items[place[0]][3], node)
                    place[0] += 1
                parts.append(node)
            return ("and", *parts)

        return alternatives()

    def _build(self, node: tuple) -> tuple[bool, set[int], set[int]]:
        kind = node[0]
        if kind == "t":
            self.labels.append(node[1])
            self.calls.append(node[2])
            self.follow.append([])
            self.ends.append(False)
            at = {len(self.labels) - 1}
            return False, at, set(at)
        if kind == "and":
            nullable, first, last = True, set(), set()
            for child in node[1:]:
                n, f, end = self._build(child)
                for p in last:
                    self.follow[p] = sorted({*self.follow[p], *f})
                first = first | f if nullable else first
                last = last | end if n else end
                nullable = nullable and n
            return nullable, first, last
        if kind == "or":
            parts = [self._build(c) for c in node[1:]]
            return any(p[0] for p in parts), set().union(*(p[1] for p in parts)), set().union(*(p[2] for p in parts))
        n, f, end = self._build(node[1])
        if kind in "*+":
            for p in end:
                self.follow[p] = sorted({*self.follow[p], *f})
        return n or kind in "*?", f, end

    def _find_nullable(self, built: dict) -> None:
        """Rules that match nothing at all, directly or through calls of such rules."""
        self.nullable = {name: b[0] for name, b in built.items()}
        changed = True
        while changed:
            changed = False
            for name in built:
                if not self.nullable[name]:
                    seen, todo = set(), list(self.first[name])
                    while todo and not self.nullable[name]:
                        p = todo.pop()
                        if p in seen or not (self.calls[p] and self.nullable[self.calls[p]]):
                            continue
                        seen.add(p)
                        if self.ends[p]:
                            self.nullable[name] = changed = True
                        todo += self.follow[p]

    def _reset(self) -> None:
        self._stacks: list[tuple[int, int]] = []
        self._ids: dict[tuple[int, int], int] = {}
        self._reach: dict[int, tuple[dict[str, list[int]], bool]] = {}
        self._states: dict[frozenset[int], int] = {}
        self._sets: list[frozenset[int]] = []
        self._accept: list[bool] = []
        self._next: list[dict[int, int]] = []
        self._starts: dict[str, int] = {}
        self._held = 0
        self._named: dict[tuple[int, str], int] = {}
        self._unions: dict[tuple[int, int], int] = {}
        self._grown: dict[int, int] = {}
        self._hits: dict[int | str, dict[int, tuple[int, ...]]] = {}
        self._spans_at: dict[int, tuple[str, ...]] = {}

    def _stack(self, position: int, parent: int) -> int:
        key = (position, parent)
        number = self._ids.get(key)
        if number is None:
            number = self._ids[key] = len(self._stacks)
            self._stacks.append(key)
        return number

    def reach(self, stack: int) -> tuple[dict[str, list[int]], bool]:
        """(stacks after one more terminal, by the terminal; whether the whole may end here)."""
        known = self._reach.get(stack)
        if known is None:
            out: dict[str, list[int]] = {}
            ended = [False]
            seen: set[tuple[bool, int, int]] = set()

            def enter(position: int, parent: int) -> None:
                if (True, position, parent) in seen:
                    return
                seen.add((True, position, parent))
                rule = self.calls[position]
                number = self._stack(position, parent)
                if rule is None:
                    out.setdefault(self.labels[position], []).append(number)
                    return
                for f in self.first[rule]:
                    enter(f, number)
                if self.nullable[rule]:
                    advance(number)

            def advance(number: int) -> None:
                position, parent = self._stacks[number]
                if (False, number, 0) in seen:
                    return
                seen.add((False, number, 0))
                for q in self.follow[position]:
                    enter(q, parent)
                if self.ends[position]:
                    if parent < 0:
                        ended[0] = True
                    else:
                        advance(parent)

            position, parent = self._stacks[stack]
            if position < 0:
                rule = self._roots[position]
                for f in self.first[rule]:
                    enter(f, -1)
                ended[0] |= self.nullable[rule]
            else:
                advance(stack)
            known = self._reach[stack] = (out, ended[0])
        return known

    _roots: dict[int, str] = {}

    def start(self, rule: str) -> int:
        """The state before the first symbol of a rule."""
        number = self._starts.get(rule)
        if number is None:
            place = -2 - sorted(self.text).index(rule)
            self._roots = {**self._roots, place: rule}
            number = self._starts[rule] = self._state(frozenset([self._stack(place, -1)]))
        return number

    def _state(self, stacks: frozenset[int]) -> int:
        number = self._states.get(stacks)
        if number is None:
            number = self._states[stacks] = len(self._sets)
            self._sets.append(stacks)
            self._held += len(stacks)
            self._accept.append(any(self.reach(s)[1] for s in stacks))
            self._next.append({})
        return number

    def _step(self, state: int, symbol: int, names: frozenset[str]) -> int:
        reached = self._after(self._sets[state], self._hits.setdefault(symbol, {}), names)
        number = self._next[state][symbol] = self._state(reached) if reached else -1
        return number

    def _after(self, stacks: frozenset[int], hits: dict[int, tuple[int, ...]], names: frozenset[str] | tuple[str, ...]) -> frozenset[int]:
        """The stacks after any of the terminals; ``hits`` keeps those of each stack, as large sets share most of theirs."""
        parts = []
        for s in stacks:
            found = hits.get(s)
            if found is None:
                out = self.reach(s)[0]
                found = hits[s] = tuple(h for name in names for h in out.get(name, ()))
            if found:
                parts.append(found)
        return frozenset(chain.from_iterable(parts))

    def accepts(self, rule: str, symbols: list[int], names: list[frozenset[str]]) -> bool:
        """Whether the symbols spell a word of the rule; ``names[symbol]`` are the terminals a symbol stands for."""
        state, table = self.start(rule), self._next
        for symbol in symbols:
            after = table[state].get(symbol)
            if after is None:
                after = self._step(state, symbol, names[symbol])
            if after < 0:
                return False
            state = after
        return self._accept[state]

    def tidy(self) -> None:
        """Begin the tables anew once they hold too much; called between texts."""
        if len(self._sets) > MOST_STATES or self._held > MOST_STACKS or len(self._stacks) > 5 * MOST_STATES:
            self._reset()

    # --- repair ------------------------------------------------------------------------------------

    def by_symbol(self, state: int, symbol: int, names: frozenset[str]) -> int:
        """The state after a symbol, -1 if none."""
        after = self._next[state].get(symbol)
        return self._step(state, symbol, names) if after is None else after

    def by_name(self, state: int, name: str) -> int:
        """The state after one terminal, -1 if none."""
        key = (state, name)
        after = self._named.get(key)
        if after is None:
            reached = self._after(self._sets[state], self._hits.setdefault(name, {}), (name,))
            after = self._named[key] = self._state(reached) if reached else -1
        return after

    def union(self, a: int, b: int) -> int:
        """The state of the stacks of either state."""
        if a == b or b < 0:
            return a
        if a < 0:
            return b
        key = (a, b) if a < b else (b, a)
        both = self._unions.get(key)
        if both is None:
            both = self._unions[key] = self._state(self._sets[a] | self._sets[b])
        return both

    def inserted(self, state: int) -> int:
        """The state after the insertion of any one insertable terminal, -1 if none fits."""
        after = self._grown.get(state)
        if after is None:
            reached = self._after(self._sets[state], self._hits.setdefault("inserted", {}), tuple(self.insertable))
            after = self._grown[state] = self._state(reached) if reached else -1
        return after

    def spans_at(self, state: int) -> tuple[str, ...]:
        """The kinds of bracket pair that a state can go on with."""
        kinds = self._spans_at.get(state)
        if kinds is None:
            kinds = self._spans_at[state] = tuple(sorted({name[1:-1] for s in self._sets[state] for name in self.reach(s)[0] if name[0] == "<" and name[1:-1] in self.text}))
        return kinds


class Span(int):
    """The symbol of a bracket pair with what its repair needs: the kinds it can be of, content, whether its end is missing, its tokens."""

    def __new__(cls, symbol: int, bracket: str, kinds: list[str], content: list[int], missing: bool) -> Span:
        self = super().__new__(cls, symbol)
        self.kinds, self.content, self.missing = kinds, content, missing
        self.size = 1 + (not missing and bracket != "INDENT") + sum(x.size if isinstance(x, Span) else 1 for x in content)
        self.entries = {}
        return self


class Repair:
    """The chart entry of (content, rule): for every number of edits and every place the stacks that can be reached.

    Edits cost 1 each: deleting a token, inserting a token of the grammar's insertable terminals, or replacing a
    token by one. A bracket pair may be repaired inside, at the cost of its own entry for the kind that is wanted, or
    deleted with all its tokens. Levels are filled only up to the least cost that spells a word of the rule, so the cost
    is exact; the work is the number of symbols times the cost, and inside pairs likewise.
    """

    def __init__(self, grammar: Grammar, rule: str, content: list[int], names: list[frozenset[str]], extra: int = 0):
        self.grammar, self.rule, self.content, self.names, self.extra = grammar, rule, content, names, extra
        self.rows: list[array] = []
        self.cost: int | None = None

    def at_most(self, limit: int) -> int | None:
        """The cost if it is at most ``limit``, else None."""
        while self.cost is None and len(self.rows) + self.extra <= limit:
            self._fill()
        return self.cost if self.cost is not None and self.cost <= limit else None

    def least(self) -> int:
        """The cost."""
        while self.cost is None:
            self._fill()
        return self.cost

    def entry(self, span: Span, kind: str) -> Repair:
        found = span.entries.get(kind)
        if found is None:
            found = span.entries[kind] = Repair(self.grammar, kind, span.content, self.names, int(span.missing))
        return found

    def _fill(self) -> None:
        grammar, names, rows, level = self.grammar, self.names, self.rows, len(self.rows)
        union, inserted, by_symbol = grammar.union, grammar.inserted, grammar.by_symbol
        row, before = array("i"), rows[-1] if level else None
        state = grammar.start(self.rule)
        if level:
            state = union(before[0], inserted(before[0]) if before[0] >= 0 else -1)
        row.append(state)
        for k, symbol in enumerate(self.content):
            after = by_symbol(state, symbol, names[symbol]) if state >= 0 else -1
            if level:
                above = before[k]
                if isinstance(symbol, Span):
                    if above >= 0:
                        for kind in grammar.spans_at(above):
                            if kind in symbol.kinds and f"<{kind}>" not in names[symbol]:
                                price = self.entry(symbol, kind).at_most(level)
                                if price is not None and rows[level - price][k] >= 0:
                                    after = union(after, grammar.by_name(rows[level - price][k], f"<{kind}>"))
                    if level >= symbol.size:
                        after = union(after, rows[level - symbol.size][k])
                elif above >= 0:
                    after = union(union(after, above), inserted(above))
                beside = before[k + 1]
                if beside >= 0:
                    after = union(union(after, beside), inserted(beside))
            row.append(after)
            state = after
        rows.append(row)
        if state >= 0 and grammar._accept[state]:
            self.cost = level + self.extra

    def places(self) -> list[float]:
        """Where the edits of one least repair lie, as shares of the content; those inside bracket pairs lie in their share."""
        grammar, rows, names, width = self.grammar, self.rows, self.names, max(1, len(self.content))
        level, k = self.least() - self.extra, len(self.content)
        out = [1.0] * self.extra
        stack = next(s for s in sorted(grammar._sets[rows[level][k]]) if grammar.reach(s)[1])
        held = lambda c, i: grammar._sets[rows[c][i]] if rows[c][i] >= 0 else ()

        def source(c: int, i: int, terminals) -> int | None:  # noqa: ANN001
            return next((s for s in held(c, i) if any(stack in grammar.reach(s)[0].get(t, ()) for t in terminals)), None)

        while k or level:
            if level and stack in held(level - 1, k):
                level -= 1
                continue
            symbol = self.content[k - 1] if k else None
            if symbol is not None and (was := source(level, k - 1, names[symbol])) is not None:
                stack, k = was, k - 1
                continue
            if isinstance(symbol, Span):
                if level >= symbol.size and stack in held(level - symbol.size, k - 1):
                    out += [(k - 1) / width] * symbol.size
                    level, k = level - symbol.size, k - 1
                    continue
                for kind, entry in symbol.entries.items():
                    if entry.cost is not None and 0 < entry.cost <= level and (was := source(level - entry.cost, k - 1, (f"<{kind}>",))) is not None:
                        out += [(k - 1 + p) / width for p in entry.places()]
                        stack, level, k = was, level - entry.cost, k - 1
                        break
                else:
                    stack, level = source(level - 1, k, grammar.insertable), level - 1
                    out.append(k / width)
                continue
            if symbol is not None and stack in held(level - 1, k - 1):
                out.append((k - 1) / width)
                level, k = level - 1, k - 1
            elif symbol is not None and (was := source(level - 1, k - 1, grammar.insertable)) is not None:
                out.append((k - 1) / width)
                stack, level, k = was, level - 1, k - 1
            else:
                stack, level = source(level - 1, k, grammar.insertable), level - 1
                out.append(k / width)
        return out[::-1]
