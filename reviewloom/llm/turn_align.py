"""Wagner-Fischer alignment of a conversation's turns to the alternating grammar (s?(ua)+)?.

The grammar has one string of each feasible length, so a conversation is repaired by aligning its turns to those
strings and taking the cheapest audit. Strings of the same last letter are suffixes of one another but for a leading
`s`; one table over what is left of turns and string therefore serves all lengths, and one more row of it the leading
`s`. Cells that no path within the cost of a greedy repair can use are left out (Ukkonen's band). Equally cheap
audits are traced back for every length and compared.

A long conversation is cut into segments. The same tables give the cheapest audit of a segment for each pair of places
in the grammar at its ends, and neighbouring segments are joined by the place between them. No audit of a segment is
the beginning of another one equally cheap, so joining the least audits gives the least.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import numpy as np

# Places in the grammar: nothing yet, after s, after u, after a. Only the first and the last may end it.
START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (START, ASSISTANT)

# Costs of the edits, and of leaving a truncated turn.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FAR = 1 << 40

# A turn is a letter: its role (s, u, a, x for any other), a capital if truncated, or GONE if it has to be deleted.
GONE = "D"

Best = dict[tuple[int, int], tuple[int, str]]


def _greedy(turns: str, entry: int) -> int:
    """What it costs at most to get from `entry` to either of USER and ASSISTANT."""
    cost, place = 0, entry
    for t in turns:
        if t == GONE:
            cost += DELETE
            continue
        cost += TRUNCATED if t.isupper() else 0
        wanted = "a" if place == USER else "u"
        if place == START and t in "sS":
            place = SYSTEM
            continue
        cost += 0 if t.lower() == wanted else REROLE
        place = ASSISTANT if wanted == "a" else USER
    return cost + 2 * INSERT


class _Table:
    """Costs of aligning the turns from i on to the last r letters of the string that ends in `last`.

    Column k of row i stands for r = n - i + k - below; columns outside the band cost more than the incumbent.
    """

    def __init__(self, turns: str, last: str, incumbent: int):
        self.turns, self.last = turns, last
        n = len(turns)
        self.below, above = incumbent // DELETE + 1, incumbent // INSERT + 1
        width = self.below + above + 1
        k = np.arange(width, dtype=np.int64)
        self.rows = np.full((n + 1, width + 1), FAR, np.int64)  # one column more, out of the band
        self.rows[n, :width] = np.where(k >= self.below, INSERT * (k - self.below), FAR)
        for i in range(n - 1, -1, -1):
            left = n - i + k - self.below
            after = self.rows[i + 1]
            step = after[1:width + 1] + DELETE
            if turns[i] != GONE:
                same, other = (self.cost(i, c) for c in (last, "a" if last == "u" else "u"))
                put = after[:width] + np.where(left % 2 == 1, same, other)
                step = np.where(left > 0, np.minimum(step, put), step)
            step = np.where(left < 0, FAR, step)
            self.rows[i, :width] = np.minimum.accumulate(step - INSERT * k) + INSERT * k
        self.rows[self.rows > FAR] = FAR

    def letter(self, left: int) -> str:
        return self.last if left % 2 else ("a" if self.last == "u" else "u")

    def cost(self, i: int, letter: str) -> int:
        t = self.turns[i]
        return (0 if t.lower() == letter else REROLE) + (TRUNCATED if t.isupper() else 0)

    def at(self, i: int, left: int) -> int:
        k = left - (len(self.turns) - i) + self.below
        return int(self.rows[i, k]) if left >= 0 and 0 <= k < self.rows.shape[1] else FAR

    def trace(self, i: int, left: int) -> str:
        """The least of the cheapest audits from a cell on: at each cell the first edit that keeps to the cost."""
        out, n = [], len(self.turns)
        while i < n or left:
            here = self.at(i, left)
            if i < n and self.at(i + 1, left) + DELETE == here:
                out.append("D")
                i += 1
            elif left and self.at(i, left - 1) + INSERT == here:
                out.append("I")
                left -= 1
            else:
                out.append("K" if self.turns[i].lower() == self.letter(left) else "R")
                i, left = i + 1, left - 1
        return "".join(out)


def _least(table: _Table, lengths: Iterable[int]) -> tuple[int, str] | None:
    """The cheapest audit over all lengths of the string, without a leading s."""
    costs = [(table.at(0, m), m) for m in lengths]
    cost = min(costs, default=(FAR, 0))[0]
    return None if cost >= FAR else (cost, min(table.trace(0, m) for c, m in costs if c == cost))


def _least_with_system(table: _Table, lengths: Iterable[int]) -> tuple[int, str] | None:
    """The same with a kept system turn before the string; all turns before it are deleted."""
    best = None
    for i, t in enumerate(table.turns):
        if t not in "sS":
            continue
        before = DELETE * i + (TRUNCATED if t == "S" else 0)
        if best is not None and before > best[0]:
            break
        for m in lengths:
            cost = before + table.at(i + 1, m)
            if cost < FAR and (best is None or cost <= best[0]):
                found = (cost, "D" * i + "K" + table.trace(i + 1, m))
                best = found if best is None else min(best, found)
    return best


@lru_cache(maxsize=1 << 15)
def align(turns: str, entries: tuple[int, ...], exits: tuple[int, ...]) -> Best:
    """Cheapest audit, the least in ASCII among equals, from each entry to each exit that can be reached."""
    best: Best = {}
    n = len(turns)
    incumbent = max(_greedy(turns, e) for e in entries) + 2 * INSERT
    reach = n + incumbent // INSERT + 1
    for out in exits:
        if out in (START, SYSTEM):
            if out in entries:
                best[out, out] = (DELETE * n, "D" * n)
            if out == SYSTEM and START in entries:
                # The empty string after the system turn: everything else is deleted.
                kept = [(DELETE * (n - 1) + (TRUNCATED if t == "S" else 0), "D" * i + "K" + "D" * (n - 1 - i))
                        for i, t in enumerate(turns) if t in "sS"]
                if kept:
                    best[START, SYSTEM] = min(kept)
            continue
        table = _Table(turns, "u" if out == USER else "a", incumbent)
        odd, even = range(1, reach + 1, 2), range(2, reach + 1, 2)
        for entry in entries:
            # Lengths whose first letter follows the entry; none at all if it is the exit itself.
            if entry == USER:
                lengths = odd if out == ASSISTANT else range(0, reach + 1, 2)
            elif entry == ASSISTANT:
                lengths = odd if out == USER else range(0, reach + 1, 2)
            else:
                lengths = odd if out == USER else even
            found = [_least(table, lengths)]
            if entry == START:
                found.append(_least_with_system(table, lengths))
            found = [f for f in found if f is not None]
            if found:
                best[entry, out] = min(found)
    return best


def join(first: Best, second: Best) -> Best:
    """Cheapest audits of two neighbouring segments as one."""
    best: Best = {}
    for (a, b), (cost, audit) in first.items():
        for (c, d), (more, rest) in second.items():
            if b == c:
                found = (cost + more, audit + rest)
                best[a, d] = min(best.get((a, d), found), found)
    return best


def whole(best: Best) -> tuple[int, str]:
    """Cost and audit of a conversation."""
    return min(best[START, end] for end in FINAL if (START, end) in best)
