"""Byte automata: regular expressions to an NFA, subset construction, minimisation, transition arrays."""

from __future__ import annotations

import re._constants as c
import re._parser as parser

MANY = c.MAXREPEAT


class Nfa:
    """Thompson construction over bytes; `reverse` builds the automaton of the mirrored expression."""

    def __init__(self) -> None:
        self.free: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1

    def add(self, pattern: str, reverse: bool = False) -> tuple[int, int]:
        return self._sequence(list(parser.parse(pattern)), reverse)

    def _sequence(self, items, reverse):
        begin = end = self.state()
        for op, arg in reversed(items) if reverse else items:
            a, b = self._item(op, arg, reverse)
            self.free[end].append(a)
            end = b
        return begin, end

    def _bytes(self, op, arg) -> frozenset:
        if op is c.LITERAL:
            return frozenset([arg])
        if op is c.NOT_LITERAL:
            return frozenset(range(256)) - {arg}
        if op is c.IN:
            out, negate = set(), False
            for kind, value in arg:
                if kind is c.NEGATE:
                    negate = True
                elif kind is c.RANGE:
                    out |= set(range(value[0], value[1] + 1))
                else:
                    out |= self._bytes(kind, value)
            return frozenset(range(256)) - out if negate else frozenset(out)
        raise ValueError(f"unsupported in a rule: {op}")

    def _item(self, op, arg, reverse):
        if op is c.SUBPATTERN:
            return self._sequence(list(arg[3]), reverse)
        if op is c.BRANCH:
            begin, end = self.state(), self.state()
            for choice in arg[1]:
                a, b = self._sequence(list(choice), reverse)
                self.free[begin].append(a)
                self.free[b].append(end)
            return begin, end
        if op is c.MAX_REPEAT:
            least, most, body = arg
            begin = end = self.state()
            for _ in range(least):
                a, b = self._sequence(list(body), reverse)
                self.free[end].append(a)
                end = b
            if most is MANY:
                a, b = self._sequence(list(body), reverse)
                out = self.state()
                self.free[end] += [a, out]
                self.free[b] += [a, out]
                return begin, out
            out = self.state()
            self.free[end].append(out)
            for _ in range(most - least):
                a, b = self._sequence(list(body), reverse)
                self.free[end].append(a)
                self.free[b].append(out)
                end = b
            return begin, out
        begin, end = self.state(), self.state()
        self.moves[begin].append((self._bytes(op, arg), end))
        return begin, end

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


class Dfa:
    """Minimal automaton: byte classes, a flat transition list indexed by state + class, and what each state accepts.

    States are numbered in steps of `width`, so `table[state + classes[byte]]` is the next state.
    States from `accepting` on accept; `labels[state]` names the rules.
    """

    def __init__(self, patterns: dict[str, str], anywhere: bool, reverse: bool = False) -> None:
        nfa = Nfa()
        ends, begins = {}, []
        for name, pattern in patterns.items():
            a, b = nfa.add(pattern, reverse)
            begins.append(a)
            ends[b] = name
        root = nfa.closure(begins)
        classes, n_classes = self._classes(nfa)
        sample = {k: b for b, k in reversed(list(enumerate(classes)))}
        index, rows, todo = {root: 0}, [], [root]
        while todo:
            now = todo.pop(0)
            row = []
            for k in range(n_classes):
                byte = sample[k]
                to = nfa.closure({t for s in now for on, t in nfa.moves[s] if byte in on})
                if anywhere:
                    to = to | root
                if to not in index:
                    index[to] = len(index)
                    todo.append(to)
                row.append(index[to])
            rows.append(row)
        accepts = [frozenset(ends[s] for s in state if s in ends) for state in index]
        self._minimise(rows, accepts, classes, n_classes)

    @staticmethod
    def _classes(nfa: Nfa) -> tuple[list[int], int]:
        sets = list({on for moves in nfa.moves for on, _ in moves})
        seen: dict[tuple, int] = {}
        out = [seen.setdefault(tuple(b in s for s in sets), len(seen)) for b in range(256)]
        return out, len(seen)

    def _minimise(self, rows, accepts, classes, width) -> None:
        kinds: dict = {}
        group = [kinds.setdefault(a, len(kinds)) for a in accepts]
        while True:
            keys: dict = {}
            finer = [keys.setdefault((group[s], *[group[t] for t in row]), len(keys)) for s, row in enumerate(rows)]
            if len(keys) == len(set(group)):
                break
            group = finer
        member: dict[int, int] = {}
        for s, g in enumerate(group):
            member.setdefault(g, s)
        order = sorted(member, key=lambda g: (bool(accepts[member[g]]), g != group[0], member[g]))
        number = {g: i * width for i, g in enumerate(order)}
        self.width, self.n_states, self.start = width, len(order), number[group[0]]
        self.classes = bytes(classes)
        self.table = [number[group[t]] for g in order for t in rows[member[g]]]
        self.labels = {number[g]: sorted(accepts[member[g]]) for g in order if accepts[member[g]]}
        self.accepting = min(self.labels)
        dead = [number[g] for g in order if not accepts[member[g]] and all(group[t] == g for t in rows[member[g]])]
        self.dead = dead[0] if dead else -1

    def longest(self, coded: bytes, at: int, to: int, step: int = 1) -> int:
        """Furthest position (in steps from `at`) at which the anchored automaton accepts, or -1."""
        table, state, best, seen = self.table, self.start, -1, 0
        while at != to:
            state = table[state + coded[at]]
            at += step
            seen += 1
            if state >= self.accepting:
                best = seen
            elif state == self.dead:
                break
        return best
