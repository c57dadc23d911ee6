"""Error-correcting chart parsing: the least number of tokens to insert or delete so that a text parses; putting another in a token's place is both.

The chart holds items (state, origin) per position, an origin being a nonterminal that began at some position together with the items that
wait for it. A text is first parsed without edits, with one token of lookahead; that fails exactly if its cost isn't 0. Then the chart is
searched by cost so far plus a lower bound of what is still to come. The bound is the exact edit distance of the rest of the text to a
looser language, in which a nonterminal may return to any place it is called from, but brackets are counted: a table over positions, states
and open brackets, filled from the end. As the bound never grows faster than the cost, the first repair found is a cheapest one.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass
from heapq import heappop, heappush
from math import isqrt

import numpy as np

from fieldloom.llm.grammar import Grammar

#: What is done, the position, and the token that is inserted or deleted.
Edit = tuple[str, int, str]
#: Items taken up per search before it is given up, and per token if that is more. Cells of the table of bounds (two bytes each) that are kept at a time.
BUDGET, PER_TOKEN, CELLS = 40_000, 20, 30_000_000
FAR = 30_000


@dataclass(frozen=True)
class Repair:
    """cost: number of edits; least: what it is at least, the cost itself if that is the minimum; edits: in order; reached: tokens before the first
    error; at_end: whether inserting tokens at the end is as cheap; of the edits at the end of a mere bound one stands for all."""

    cost: int
    least: int
    edits: tuple[Edit, ...]
    reached: int
    at_end: bool

    @property
    def exact(self) -> bool:
        return self.cost <= self.least


class Origin:
    """A nonterminal begun somewhere: the least cost before it, brackets open there, the value of the token before it, the items that wait for it, and its ends so far."""

    __slots__ = ("before", "depth", "ends", "value", "waiting")

    def __init__(self, before: int, depth: int, value: str | None) -> None:
        self.before, self.depth, self.value = before, depth, value
        self.waiting: dict[tuple, tuple[Edit, ...]] = {}
        self.ends: dict[int, tuple[Edit, ...]] = {}


def parse(g: Grammar, kinds: list[str], values: list[str | None] | None = None, last_cut: bool = False, budget: int | None = None) -> Repair:
    """The cheapest repair of a text, given as kinds of tokens, to a sentence of the grammar, whose first rule ``Start`` ends in ``$``.

    values: names of tokens, which those that the grammar pairs must share. last_cut: whether the last token is one that the text's end cut off.
    Only a search that takes more than ``budget`` items (``BUDGET``, or ``PER_TOKEN`` for each token if that is more) may end with a cost that isn't
    proven: then ``least`` is below ``cost``.
    """
    budget = max(BUDGET, PER_TOKEN * len(kinds)) if budget is None else budget
    tokens, names = [*kinds, "$"], [*(values or [None] * len(kinds)), None]
    charts = _plain(g, tokens, names)
    n, reached = len(kinds), len(charts) - 1
    if charts[-1] is None:
        return Repair(0, 0, (), n, True)
    bound = _completion(g, charts[-1], reached, n)
    # what ends all that is open at the end, the last token left out if it is cut off
    ends = reached == n or (last_cut and reached == n - 1)
    bad = [i for i, t in enumerate(kinds) if t not in g.terminals]
    least = max(1, len(bad))
    best = bound
    if bad and bound[0] > least:  # tokens that no sentence has may only be to be taken out
        kept = [i for i, t in enumerate(tokens) if t in g.terminals]
        if _plain(g, [tokens[i] for i in kept], [names[i] for i in kept])[-1] is None:
            best = (least, tuple(("delete", i, kinds[i]) for i in bad))
    if best[0] > least:
        best, least = _search(g, tokens, names, best, least, budget)
    return Repair(best[0], min(least, best[0]), best[1], reached, ends and bound[0] <= best[0])


def _plain(g: Grammar, tokens: list[str], names: list[str | None]) -> list[dict | None]:
    """The charts of a parse without edits, up to the position that can't be passed; None last if all is passed."""
    moves, keyed = g.moves, g.keyed
    charts: list[dict | None] = []
    items: dict[tuple, None] = {(g.start["Start"], Origin(0, 0, None)): None}
    for at, token in enumerate(tokens):
        charts.append(items)
        here: dict[str, Origin] = {}
        following: dict[tuple, None] = {}
        todo = list(items)
        name = names[at]
        for q, origin in todo:  # it grows
            move = moves[q].get(token)
            if move is None:
                continue
            done, called, to = move
            if to is not None and (name is None or origin.value is None or token not in g.paired or origin.value == name):
                following[to, origin] = None
            for inner, first, after in called:
                child = here.get(inner)
                if child is None:
                    child = here[inner] = Origin(0, 0, names[at - 1] if inner in keyed else None)
                    items[first, child] = None
                    todo.append((first, child))
                child.waiting[after, origin] = ()
            if done:
                for item in origin.waiting:
                    if item not in items:
                        items[item] = None
                        todo.append(item)
        if not following:
            return charts
        items = following
    return [*charts, None]


def _completion(g: Grammar, items: dict, at: int, n: int) -> tuple[int, tuple[Edit, ...]]:
    """Delete what follows a position and insert the least that ends all that is open there."""
    least: dict[Origin, int] = {}

    def to_end(origin: Origin) -> int:
        stack = [origin]
        while stack:
            o = stack[-1]
            if o in least:
                stack.pop()
                continue
            missing = [p for _, p in o.waiting if p not in least]
            if missing and any(p in stack for p in missing):  # left recursion leads no faster to the end
                missing = [p for p in missing if p not in stack]
            stack.extend(missing)
            if not missing:
                least[o] = min((g.rest[q] + least.get(p, FAR) for q, p in o.waiting), default=0)
        return least[origin]

    # of the rest, one token is the mark of the end
    cost = min(n - at + g.rest[q] + to_end(o) - 1 for q, o in items)
    return cost, ((("delete", at, ""),) if at < n else ()) + (("insert", n, ""),)


class Bounds:
    """For each position, by class of state and open brackets, the least edits of the rest of the text in the looser language.

    ``cap`` brackets stand for any greater number, too: one that closes there may lead below it or not. A row follows from the one after it. Of a table of more
    than ``CELLS``, only the rows where blocks begin are kept; a block is filled again when it is asked for, and the last few of them stay.
    """

    def __init__(self, g: Grammar, tokens: list[str], cap: int) -> None:
        self.tokens, self.loose, self.width, size = tokens, g.loose, cap + 1, g.loose.n * (cap + 1)
        loose, width, depth = g.loose, cap + 1, np.arange(cap + 1)

        def table(to: np.ndarray, step: np.ndarray) -> np.ndarray:
            at = depth[None, :] + step[:, None]
            stay = (step[:, None] == 2) & (depth[None, :] == cap)  # a bracket that closes above the cap
            index = to[:, None] * width + np.where(stay, cap, np.minimum(at, cap))
            return np.where((at < 0) | ((step[:, None] == 2) & ~stay), size, index)  # the last cell is out of reach

        self.every = table(loose.to, loose.step)
        self.by_token = {}
        for t in {*tokens[:-1]}:
            if t in loose.by_token:
                rows, starts, to, step = loose.by_token[t]
                self.by_token[t] = rows, starts, table(to, step)
        self.block = len(tokens) if len(tokens) * size <= CELLS else isqrt(len(tokens)) + 1
        self.most = max(2, CELLS // (self.block * size))
        self.blocks: dict[int, list[array]] = {}
        self.begins: dict[int, np.ndarray] = {}  # the first row of each block
        self.hits = (-1, [])
        now = np.full(size + 1, FAR, np.int16)
        now[loose.ends * width] = 0
        self.last = now
        for b in range((len(tokens) - 1) // self.block, -1, -1):
            self._fill(b)

    def _fill(self, b: int) -> list[array]:
        end = min(len(self.tokens), (b + 1) * self.block)
        now, rows = self.last if end == len(self.tokens) else self.begins[b + 1], []
        for i in range(end - 1, b * self.block - 1, -1):
            now = self._before(now, i)
            rows.append(array("h", now.tobytes()))
        rows.reverse()
        self.begins[b] = now
        while len(self.blocks) >= self.most:
            del self.blocks[next(iter(self.blocks))]
        self.blocks[b] = rows
        return rows

    def _before(self, after: np.ndarray, i: int) -> np.ndarray:
        """The row of a position from the one after it."""
        now = after.copy()
        if i < len(self.tokens) - 1:
            now += np.int16(1)
            if self.tokens[i] in self.by_token:
                rows, starts, index = self.by_token[self.tokens[i]]
                view = now[:-1].reshape(-1, self.width)
                view[rows] = np.minimum(view[rows], np.minimum.reduceat(after[index], starts, axis=0))
            now[-1] = FAR
        while True:  # tokens inserted here
            onward = np.minimum.reduceat(now[self.every], self.loose.first, axis=0)
            better = np.minimum(now[:-1], onward.ravel() + np.int16(1))
            if np.array_equal(better, now[:-1]):
                break
            now[:-1] = better
        np.minimum(now, FAR, out=now)
        return now

    def __getitem__(self, at: int) -> array:
        b, i = divmod(at, self.block)
        if self.hits[0] != b:
            rows = self.blocks.pop(b, None)
            if rows is None:
                rows = self._fill(b)
            else:
                self.blocks[b] = rows  # the one used last is the last to go
            self.hits = b, rows
        return self.hits[1][i]

    def whole(self) -> list[array] | Bounds:
        """All rows if they are kept, else the table itself."""
        return self.blocks[0] if self.block == len(self.tokens) else self


def _search(g: Grammar, tokens: list[str], names: list[str | None], best: tuple, least: int, budget: int) -> tuple[tuple, int]:
    """The cheapest repair that costs less than ``best``, or that, and what the minimum is at least."""
    deep = top = 0
    for t in tokens:
        deep = max(0, deep + g.brackets.get(t, 0))
        top = max(top, deep)
    cap = min(top + 1, 24)
    table = Bounds(g, tokens, cap).whole()
    found, least = _astar(g, tokens, names, table, cap, best, least, budget, 1)
    if found[0] > least:  # not proven: look for a better bound with a greater weight on what is still to come
        for weight in (2, 3):
            found = min(found, _astar(g, tokens, names, table, cap, found, least, budget // 2, weight)[0], key=lambda x: x[0])
    return found, least


def _astar(g: Grammar, tokens: list[str], names: list[str | None], table: list[array] | Bounds, cap: int, best: tuple, least: int, budget: int, weight: int) -> tuple[tuple, int]:
    n, width = len(tokens) - 1, cap + 1
    cls, off, shifts, calls, final, start, keyed, paired, only_matched = g.loose.cls, g.off, g.shifts, g.calls, g.final, g.start, g.keyed, g.paired, g.only_matched
    known: list[dict[tuple, int]] = [{} for _ in tokens]  # the cheapest way to an item so far
    done: list[set[tuple]] = [set() for _ in tokens]
    begun: list[dict[tuple, Origin]] = [{} for _ in tokens]
    heap: list[tuple] = []
    limit, tick, taken = best[0], 0, 0

    def push(at: int, q: int, origin: Origin, edits: tuple[Edit, ...]) -> None:
        nonlocal tick
        item, cost = (q, origin), len(edits)
        if item in done[at] or known[at].get(item, cost + 1) <= cost:
            return
        depth = origin.depth + off[q]
        rest = table[at][cls[q] * width + (depth if depth < cap else cap)]
        if origin.before + cost + rest >= limit:
            return
        known[at][item] = cost
        tick -= 1
        heappush(heap, (origin.before + cost + weight * rest, -at, tick, item, edits, None))

    push(0, start["Start"], Origin(0, 0, None), ())
    while heap:
        total, at, _, item, edits, later = heappop(heap)
        at = -at
        q, origin = item
        if weight == 1 and total > least:
            least = total
            if least >= limit:
                return best, limit
        taken += 1
        if taken > budget:
            return best, least
        token, name = tokens[at], names[at]
        if later is not None:  # its edits, by what they lead to
            while later and later[-1][0] <= total:
                _, to_at, to, edit = later.pop()
                push(to_at, to, origin, (*edits, edit))
            if later:
                tick -= 1
                heappush(heap, (later[-1][0], -at, tick, item, edits, later))
            continue
        if item in done[at] or known[at][item] < len(edits):
            continue
        done[at].add(item)
        cost, depth = origin.before + len(edits), origin.depth + off[q]
        own = shifts[q]
        to = own.get(token)
        if to is not None and (name is None or origin.value is None or token not in paired or origin.value == name):
            if token == "$":
                return (cost, edits), max(least, cost) if weight == 1 else least
            push(at + 1, to, origin, edits)
        for inner, after in calls[q].items():
            key = (inner, depth, names[at - 1] if inner in keyed else None)
            child = begun[at].get(key)
            if child is None or child.before > cost:
                if child is None:
                    child = begun[at][key] = Origin(cost, depth, key[2])
                child.before = cost
                known[at].pop((start[inner], child), None)
                push(at, start[inner], child, ())
            child.waiting[after, origin] = edits
            for end, more in list(child.ends.items()):
                push(end, after, origin, edits + more)
        if final[q]:
            before = origin.ends.get(at)
            if before is None or len(before) > len(edits):
                origin.ends[at] = edits
                for (after, outer), more in list(origin.waiting.items()):
                    push(at, after, outer, more + edits)
        # edits
        ways = []
        if at < n and not (keyed and any(c in keyed for c in calls[q])):  # what follows a paired token is left to what is called there
            rest = table[at + 1][cls[q] * width + (depth if depth < cap else cap)]
            ways.append((cost + 1 + weight * rest, at + 1, q, ("delete", at, token)))
        here = table[at]
        for terminal, to in own.items():
            if terminal == "$" or terminal in only_matched:
                continue
            d = origin.depth + off[to]
            cell = cls[to] * width + (d if d < cap else cap)
            ways.append((cost + 1 + weight * here[cell], at, to, ("insert", at, terminal)))
        if ways:
            ways.sort(key=lambda w: (-w[0], -w[1]))
            tick -= 1
            heappush(heap, (max(total, ways[-1][0]), -at, tick, item, edits, ways))
    return best, limit if weight == 1 else least
