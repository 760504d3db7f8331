"""Counts of limits that apply to vessels and that they break, by searches instead of a row for each limit.

Limits with equal guards (section, place, type, direction) and of one kind form a group. Within a group a limit opens at
the lower draught of its range and closes at the upper one; what is open at a draught is a prefix of these events. Each
prefix is a few blocks whose sizes are powers of two, each block is sorted by its bounds with summed counts, so a binary
search in each block counts the bounds that a vessel breaks. A vessel looks at 16 groups of guards at most (its own
section, place and type or any, its direction or any) whatever the number of limits.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

KINDS = ("max_beam", "max_length", "min_length", "ukc", "fresh_water", "forbidden", "allowed")


def _codes(values: Sequence) -> dict:
    """None is 0; other values count from 1."""
    return {None: 0} | {v: i for i, v in enumerate(sorted({v for v in values if v is not None}), 1)}


class LimitIndex:
    """Limits as rows (section, place, type, both_ways, draught_from, draught_to, kind, bound, times). A limit without a
    bound is broken wherever it applies, unless it allows; a kind that is not known forbids."""

    def __init__(self, rows: Sequence[tuple]) -> None:
        # a range that is empty applies to no draught
        rows = [r for r in rows if r[4] is None or r[5] is None or r[4] < r[5]]
        self.sections, self.places, self.types = (_codes([r[i] for r in rows]) for i in range(3))
        groups: dict[tuple, int] = {}
        event, group, bound, weight = [], [], [], []
        for section, place, kind_of, both, low, high, kind, limit, times in rows:
            always = low is None and high is None
            guard = self._guard(self.sections[section], self.places[place], self.types[kind_of], int(bool(both)))
            if kind not in KINDS or limit is None and kind in ("max_beam", "max_length", "min_length"):
                kind = "forbidden"
            limit = np.inf if limit is None else limit
            exact = limit if kind == "fresh_water" else None
            g = groups.setdefault((guard, KINDS.index(kind), always, exact), len(groups))
            for at, sign in ((-np.inf if low is None else low, 1), (high, -1)):
                if at is not None:
                    event.append(at)
                    group.append(g)
                    bound.append(limit)
                    weight.append(sign * times)
        event, group, bound, weight = np.array(event, float), np.array(group, np.int64), np.array(bound, float), np.array(weight, np.int64)
        order = np.lexsort((event, group))
        self.event, group, bound, weight = event[order], group[order], bound[order], weight[order]
        self.first = np.searchsorted(group, np.arange(len(groups) + 1))
        self.total = np.concatenate([[0], np.cumsum(weight)])
        place = np.arange(len(group)) - self.first[group]
        self.bounds, self.sums = [], []
        level = 0
        while len(group) and 1 << level <= int(np.diff(self.first).max()):
            order = np.lexsort((bound, place >> level, group))
            self.bounds.append(bound[order])
            self.sums.append(np.concatenate([[0], np.cumsum(weight[order])]))
            level += 1
        self.groups: dict[tuple[int, bool], dict[int, list[tuple[int, float | None]]]] = {}
        for (guard, kind, always, exact), g in groups.items():
            self.groups.setdefault((kind, always), {}).setdefault(guard, []).append((g, exact))
        self.guards = {k: np.array(sorted(v), np.int64) for k, v in self.groups.items()}
        # which of the 16 ways to leave guards open occur
        self.ways = {k: {tuple(x) for x in np.stack(self._way(v), axis=1).tolist()} for k, v in self.guards.items()}
        # several groups of one guard differ in their exact bound: one table for each position among them
        self.tables = {}
        for k, own in self.groups.items():
            depth = max(map(len, own.values()))
            table = np.full((depth, len(own)), -1, np.int64)
            exact = np.full((depth, len(own)), np.nan)
            for c, guard in enumerate(self.guards[k].tolist()):
                for r, (g, x) in enumerate(own[guard]):
                    table[r, c] = g
                    exact[r, c] = np.nan if x is None else x
            self.tables[k] = table, exact

    def _guard(self, section, place, kind_of, both):
        return ((section * len(self.places) + place) * len(self.types) + kind_of) * 2 + both

    def _way(self, guard: np.ndarray) -> list[np.ndarray]:
        """Of each guard: whether section, place and type are open, and whether it is for both directions."""
        rest, both = guard // 2, guard % 2
        rest, kind_of = rest // len(self.types), rest % len(self.types)
        section, place = rest // len(self.places), rest % len(self.places)
        return [(x == 0).astype(int) for x in (section, place, kind_of)] + [both]

    def _open(self, g: np.ndarray, draught: np.ndarray) -> np.ndarray:
        """Events of each group at or below a draught."""
        low, high = self.first[g].copy(), self.first[g + 1].copy()
        while (low < high).any():
            middle = (low + high) >> 1
            go = (low < high) & (self.event[np.minimum(middle, len(self.event) - 1)] <= draught)
            low, high = np.where(go, middle + 1, low), np.where(go, high, np.minimum(middle, high))
        return low - self.first[g]

    def _sum_while(self, g: np.ndarray, prefix: np.ndarray, holds: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """Counts of each group's first `prefix` events whose bound `holds` (true for low bounds, false from some on)."""
        out = np.zeros(len(g), np.int64)
        for level, (bounds, sums) in enumerate(zip(self.bounds, self.sums, strict=True)):
            own = np.flatnonzero(prefix >> level & 1)
            if not len(own):
                continue
            start = self.first[g[own]] + (prefix[own] >> (level + 1) << (level + 1))
            low, high = start.copy(), start + (1 << level)
            for _ in range(level + 1):
                middle = (low + high) >> 1
                go = (low < high) & holds(bounds[np.minimum(middle, len(bounds) - 1)], own)
                low, high = np.where(go, middle + 1, low), np.where(go, high, middle)
            out[own] += sums[low] - sums[start]
        return out

    def count(self, section: list, place: list, kind_of: list, moves: np.ndarray, draught: np.ndarray, beam: np.ndarray, length: np.ndarray, depth: np.ndarray, allowance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(limits that apply, limits broken) of each vessel; numbers that are not there are NaN."""
        n = len(section)
        applies, broken = np.zeros(n, np.int64), np.zeros(n, np.int64)
        own = [np.array([codes.get(v, -1) if v is not None else -1 for v in values], np.int64) for codes, values in ((self.sections, section), (self.places, place), (self.types, kind_of))]
        for any_section, any_place, any_type, both in np.ndindex(2, 2, 2, 2):
            parts = [np.zeros(n, np.int64) if any_ else code for any_, code in zip((any_section, any_place, any_type), own, strict=True)]
            if not any((any_section, any_place, any_type, both) in ways for ways in self.ways.values()):
                continue
            fits = (parts[0] >= 0) & (parts[1] >= 0) & (parts[2] >= 0) & (moves if both else True)
            guard = self._guard(*parts, both)
            for (kind, always), known in self.guards.items():
                if (any_section, any_place, any_type, both) not in self.ways[kind, always]:
                    continue
                at = np.minimum(np.searchsorted(known, guard), len(known) - 1)
                there = fits & (known[at] == guard)
                if not always:
                    there &= ~np.isnan(draught)
                if KINDS[kind] in ("ukc", "fresh_water"):
                    there &= ~np.isnan(depth)
                for groups, exact in zip(*self.tables[kind, always], strict=True):
                    v = np.flatnonzero(there & (groups[at] >= 0))
                    if len(v):
                        self._add(KINDS[kind], groups[at[v]], exact[at[v]], v, always, applies, broken, draught, beam, length, depth, allowance)
        return applies, broken

    def _add(self, kind, g, exact, v, always, applies, broken, draught, beam, length, depth, allowance) -> None:
        prefix = self.first[g + 1] - self.first[g] if always else self._open(g, draught[v])
        found = self.total[self.first[g] + prefix] - self.total[self.first[g]]
        applies[v] += found
        if kind == "allowed":
            return
        if kind == "forbidden":
            broken[v] += found
        elif kind == "fresh_water":
            broken[v] += np.where(allowance[v] == exact, 0, found)
        elif kind in ("max_beam", "max_length"):
            size = (beam if kind == "max_beam" else length)[v]
            low = self._sum_while(g, prefix, lambda bound, k: bound < size[k])
            broken[v] += np.where(np.isnan(size), found, low)
        else:
            size, deep, low = length[v], depth[v], draught[v]
            met = (lambda bound, k: bound < size[k]) if kind == "min_length" else (lambda bound, k: deep[k] >= low[k] + bound)
            broken[v] += found - self._sum_while(g, prefix, met)
