"""The cheapest repair of a conversation's roles, by depth-first branch-and-bound.

A valid conversation is empty, or an optional system turn followed by pairs of user and assistant.
Edits are written as letters, in order: Keep, Rerole to the role that is due, Delete, Insert an
empty turn of the role that is due. Of the cheapest edits the ones with the least text win, so a
solution is a pair (cost, audit) and the search looks for the least pair.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import NamedTuple

START, SYSTEM, USER, ASSISTANT = range(4)  # what was put out last
STATES = (START, SYSTEM, USER, ASSISTANT)
FINAL = (START, ASSISTANT)
ROLES = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1

_AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_DUE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_REACH = {START: STATES, SYSTEM: (SYSTEM, USER, ASSISTANT), USER: (USER, ASSISTANT), ASSISTANT: (USER, ASSISTANT)}


class Turn(NamedTuple):
    """``initial`` of the role; ``doomed`` turns must go, ``cut`` ones cost more when they stay."""

    initial: str
    doomed: bool
    cut: bool


class Solution(NamedTuple):
    cost: int
    audit: str


def _follows(state: int | None, initial: str) -> bool:
    """Whether a turn may come right after ``state``."""
    if state == START:
        return initial in ("s", "u")
    return state is not None and _AFTER.get(initial) == _DUE[state]


class Bounds:
    """What the rest of the turns costs at least, from every place on.

    A doomed turn costs a deletion and a cut one its surcharge. Of the turns that may stay, look at
    neighbours that may not follow each other: a rerole, a deletion or an insertion mends at most two
    adjoining ones, so a run of k such neighbours takes at least half of k edits, rounded up.
    """

    def __init__(self, turns: Sequence[Turn], targets: Iterable[int]):
        self.targets = frozenset(targets)
        n = len(turns)
        self.fixed, self.edits, self.run = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        self.next: list[str | None] = [None] * (n + 1)
        for i in range(n - 1, -1, -1):
            turn = turns[i]
            self.fixed[i] = self.fixed[i + 1] + (DELETE if turn.doomed else CUT if turn.cut else 0)
            self.next[i], self.run[i], self.edits[i] = self.next[i + 1], self.run[i + 1], self.edits[i + 1]
            if not turn.doomed:
                self.edits[i] = self._edits(i + 1, _AFTER.get(turn.initial))
                self.run[i] = 0 if self._joins(_AFTER.get(turn.initial), i + 1) else self.run[i + 1] + 1
                self.next[i] = turn.initial

    def _joins(self, state: int | None, at: int) -> bool:
        initial = self.next[at]
        return state in self.targets if initial is None else _follows(state, initial)

    def _edits(self, at: int, state: int | None) -> int:
        if self._joins(state, at):
            return self.edits[at]
        return self.edits[at] + (self.run[at] + 2) // 2 - (self.run[at] + 1) // 2

    def least(self, at: int, state: int) -> int | None:
        """None where no target can be reached from ``state``."""
        if not self.targets.intersection(_REACH[state]):
            return None
        return self.fixed[at] + REROLE * self._edits(at, state)


def _moves(turns: Sequence[Turn], at: int, state: int) -> list[tuple[str, int, int, int]]:
    """(letter, next place, next state, cost) of every edit that is possible here, by letter."""
    due = _DUE[state]
    found = [("I", at, due, INSERT)]
    if at < len(turns):
        turn = turns[at]
        found.insert(0, ("D", at + 1, state, DELETE))
        if not turn.doomed:
            if _follows(state, turn.initial):
                found.append(("K", at + 1, _AFTER[turn.initial], CUT * turn.cut))
            found.append(("R", at + 1, due, REROLE + CUT * turn.cut))
    return found


def _dive(turns: Sequence[Turn], bounds: Bounds, state: int) -> Solution | None:
    """A first incumbent: at every turn the edit, or insertion and edit, that looks cheapest."""
    cost, audit = 0, []
    for at in range(len(turns)):
        options = []
        for letter, place, after, price in _moves(turns, at, state):
            steps = [(letter, after, price)] if place > at else [
                (letter + second, last, price + more)
                for second, further, last, more in _moves(turns, at, after) if second == "K"]
            for letters, last, total in steps:
                if (low := bounds.least(at + 1, last)) is not None:
                    options.append((total + low, letters, last, total))
        if not options:
            return None
        _, letters, state, total = min(options)
        cost, audit = cost + total, [*audit, letters]
    for _ in range(2):
        if state not in bounds.targets:
            cost, state = cost + INSERT, _DUE[state]
            audit.append("I")
    return Solution(cost, "".join(audit)) if state in bounds.targets else None


def repair(turns: Sequence[Turn], entry: int = START, targets: Sequence[int] = FINAL) -> Solution | None:
    """The least (cost, audit) that leads from ``entry`` to one of ``targets``; None if nothing does.

    Edits are tried in the order of their letters, from an explicit stack. A prefix is given up when
    its cost and the suffix bound exceed the incumbent, when they equal it but the audit is already
    greater, or when the same place and state were reached by a lesser prefix. Two prefixes of equal
    cost that lead to one place are never prefixes of each other, so the lesser one stays the lesser
    whatever follows. When the stack is empty, the incumbent is proved.
    """
    bounds = Bounds(turns, targets)
    best = _dive(turns, bounds, entry)
    table: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        at, state, cost, audit = stack.pop()
        low = bounds.least(at, state)
        if low is None:
            continue
        if best and (cost + low > best.cost or cost + low == best.cost and audit > best.audit[:len(audit)]):
            continue
        known = table.get((at, state))
        if known and known <= (cost, audit):
            continue
        table[at, state] = cost, audit
        if at == len(turns) and state in bounds.targets and (best is None or (cost, audit) < best):
            best = Solution(cost, audit)
        for letter, place, after, price in reversed(_moves(turns, at, state)):
            stack.append((place, after, cost + price, audit + letter))
    return best


# Long conversations are cut into segments: a table has the least solution from each state to each.

Table = dict[tuple[int, int], Solution]


def segment_table(turns: Sequence[Turn]) -> Table:
    found = {(a, b): repair(turns, a, [b]) for a in STATES for b in _REACH[a]}
    return {k: s for k, s in found.items() if s is not None}


def _through(first: Table, second: Table, entry: int, exit_: int) -> tuple[Solution, int] | None:
    ways = [(first[entry, m].cost + second[m, exit_].cost, m)
            for m in STATES if (entry, m) in first and (m, exit_) in second]
    if not ways:
        return None
    cheapest = min(ways)[0]
    return min((Solution(cheapest, first[entry, m].audit + second[m, exit_].audit), m)
               for cost, m in ways if cost == cheapest)


def joined(tables: Sequence[Table]) -> Table:
    """The table of segments one after another, put together in pairs."""
    while len(tables) > 1:
        pairs = []
        for i in range(0, len(tables) - 1, 2):
            some = {(a, b): _through(tables[i], tables[i + 1], a, b) for a in STATES for b in _REACH[a]}
            pairs.append({k: s[0] for k, s in some.items() if s})
        tables = pairs + ([tables[-1]] if len(tables) % 2 else [])
    return tables[0]


def route(tables: Sequence[Table], entry: int, exit_: int) -> list[tuple[int, int]]:
    """The states in front of and behind each segment on the least way from ``entry`` to ``exit_``."""
    out: list[tuple[int, int]] = []
    stack = [(0, len(tables), entry, exit_)]
    while stack:
        low, high, a, b = stack.pop()
        if high - low == 1:
            out.append((a, b))
            continue
        half = (low + high) // 2
        _, middle = _through(joined(tables[low:half]), joined(tables[half:high]), a, b)
        stack += [(half, high, middle, b), (low, half, a, middle)]
    return out


def least_exit(table: Table, targets: Sequence[int] = FINAL) -> tuple[Solution, int]:
    """The least solution of a whole conversation, and the state it ends in."""
    return min((table[START, t], t) for t in targets if (START, t) in table)


def replay(audit: str, roles: Sequence[str], texts: Sequence[str], entry: int = START) -> list[str]:
    """The repaired ``role:text`` lines."""
    out, state, at = [], entry, 0
    for letter in audit:
        if letter == "I":
            state = _DUE[state]
            out.append(f"{ROLES[state]}:")
            continue
        if letter == "K":
            state = _AFTER[roles[at][:1]]
            out.append(f"{roles[at]}:{texts[at]}")
        elif letter == "R":
            state = _DUE[state]
            out.append(f"{ROLES[state]}:{texts[at]}")
        at += 1
    return out
