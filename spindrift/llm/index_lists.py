"""Index lists of a prefix-filter join, read by blocks: what sizes and positions rule out is never touched."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from spindrift.llm.words import mix

#: Runs or pairs that are looked at at a time.
AT_ONCE = 1 << 19


def possible(na, nb, pa, pb, percent: int):
    """Whether sizes and positions still allow the similarity: a gram at these positions is the first in common."""
    return np.minimum(na - pa, nb - pb) * (100 + percent) >= percent * (na + nb)


def changes(*columns: np.ndarray) -> np.ndarray:
    """Places at which any of the columns differs from the row before; the first row is one."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def spread(start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(run, member) of all members of the runs start..end, about AT_ONCE at a time."""
    upto = np.concatenate(([0], np.cumsum(end - start)))
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + AT_ONCE, "right")) - 1)
        per = end[lo:hi] - start[lo:hi]
        run = np.repeat(np.arange(lo, hi), per)
        yield run, np.arange(upto[hi] - upto[lo]) - np.repeat(upto[lo:hi] - upto[lo], per) + start[run]
        lo = hi


class Lists:
    """Entries sorted by (list, set size, position); those of one list and size are a group, and those of one position in
    it a block.

    ``read`` and ``skipped`` count the entries that runs touched, and those of the same lists that they did not."""

    def __init__(self, of: np.ndarray, n: np.ndarray, pos: np.ndarray) -> None:
        edges = changes(of, n)
        self.of, self.starts, self.sizes = of, np.append(edges, len(of)), n[edges]
        self.keys = (of[edges] << 32) | self.sizes
        self.places = (np.repeat(np.arange(len(edges)), np.diff(self.starts)) << 32) | pos
        self.read = self.skipped = 0

    def runs(self, of: np.ndarray, n: np.ndarray, pos: np.ndarray, percent: int, larger: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(set, start, end): for sets by list, size and position, the runs of entries that can be partners.

        A set's runs come together.  Of each size from percent to 1 / percent of the set's (``larger``: from its own on)
        a run goes from the group's start to the last position at which enough grams are left."""
        low = np.searchsorted(self.keys, (of << 32) | (n if larger else -(-percent * n // 100)), "left")
        high = np.searchsorted(self.keys, (of << 32) | (100 * n // percent), "right")
        for sets, groups in spread(low, np.maximum(low, high)):
            size = self.sizes[groups]
            need = -(-percent * (n[sets] + size) // (100 + percent))
            fits = (n[sets] - pos[sets] >= need) & (size >= need)
            sets, groups, last = sets[fits], groups[fits], (size - need)[fits]
            start, end = self.starts[groups], np.searchsorted(self.places, (groups << 32) | last, "right")
            some = end > start
            self.read += int((end - start)[some].sum())
            yield sets[some], start[some], end[some]
        lengths = np.searchsorted(self.of, of, "right") - np.searchsorted(self.of, of, "left")
        self.skipped = self.skipped + int(lengths.sum()) - self.read


def leaders(of: np.ndarray, n: np.ndarray, node: np.ndarray, percent: int, most: int, seed: int) -> np.ndarray:
    """A mask of ``most`` entries of each list and class of sizes: those of smallest seeded hash, so lists that share sets
    mostly share leaders."""
    kind = np.floor(np.log(n) / np.log(100 / percent)).astype(np.int64)
    order = mix(node.astype(np.uint64) ^ mix(np.array([seed], np.uint64)))
    by = np.lexsort((order, kind, of))
    first = changes(of[by], kind[by])
    rank = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
    out = np.zeros(len(by), bool)
    out[by[rank < most]] = True
    return out


def counts(lists: Lists, of: np.ndarray, n: np.ndarray, pos: np.ndarray, percent: int, larger: bool = False) -> np.ndarray:
    """Entries that can be partners of each set."""
    out = np.zeros(len(of), np.int64)
    for sets, start, end in lists.runs(of, n, pos, percent, larger):
        np.add.at(out, sets, end - start)
    return out


def partners(entries: dict[str, np.ndarray], homes: np.ndarray, sets: np.ndarray, percent: int, larger: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, row): each of ``sets`` with the ``homes`` of its list that can be its partners, both rows of ``entries`` (of, n,
    pos), homes in order.  ``larger`` gives only homes that stand after the set."""
    of, n, pos = (entries[k] for k in ("of", "n", "pos"))
    lists = Lists(of[homes], n[homes], pos[homes])
    for own, start, end in lists.runs(of[sets], n[sets], pos[sets], percent, larger):
        if larger:
            start = np.minimum(np.maximum(start, np.searchsorted(homes, sets[own], "right")), end)
        for run, member in spread(start, end):
            yield sets[own[run]], homes[member]


def first_pairs(entries: dict[str, np.ndarray], border: np.ndarray, percent: int, dense: int, leading: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Pairs of rows to compare at first, and a mask of the rows whose lists go on.

    ``entries`` (of, n, pos, doc) are sorted lists.  A list that has at most ``dense`` possible pairs for each of its sets
    gives them all and is done.  Another one, or one of ``border`` (list numbers), gives each of its sets with the leaders
    that can be its partners, and goes on."""
    of, n, pos, doc = (entries[k] for k in ("of", "n", "pos", "doc"))
    sizes = np.bincount(of)
    able = possible(n, n, pos, pos, percent)  # else no set of its size or larger is left for it
    rows = np.flatnonzero(able & (sizes[of] > 1))
    # possible pairs by blocks: entries of one list, size and position have the same runs
    first = changes(of[rows], n[rows], pos[rows])
    lengths = np.diff(np.append(first, len(rows)))
    block = rows[first]
    full = Lists(of, n, pos)
    found = np.zeros(len(sizes))
    for own, start, end in full.runs(of[block], n[block], pos[block], percent, True):
        after = block[own] + lengths[own]
        np.add.at(found, of[block[own]], lengths[own] * np.maximum(end - np.maximum(start, after), 0.0))
    np.add.at(found, of[block], lengths * (lengths - 1) / 2)
    on = found > dense * sizes
    on[border] = True
    out = list(partners(entries, np.arange(len(of)), rows[~on[of[rows]]], percent, True))
    more = on[of]
    at = np.flatnonzero(more)
    if len(at):
        lead = at[leaders(of[at], n[at], doc[at], percent, leading, 0)]
        out += partners(entries, lead, at, percent)
    return [(x[doc[x] != doc[y]], y[doc[x] != doc[y]]) for x, y in out], more


def open_pairs(entries: dict[str, np.ndarray], percent: int, dense: int, leading: int | None, seed: int) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], bool]:
    """Pairs of rows of different components that are still open, each with whether it is sure to link; and whether some
    list has more.

    ``entries`` (of, n, pos, doc, component, major, visitor, ref, n_ref, shared): each list's rows are homes or visitors,
    sorted by size and position.  Visitors meet homes of other components; two sets that both stand outside the list's
    major component meet once.  A list with more than ``dense`` possible pairs a row only gives those with ``leading`` homes of
    each class of sizes, unless that is None.  What both share with a common reference decides pairs unread."""
    of, n, pos, doc, component, major, visitor, ref, n_ref, shared = (entries[k] for k in ("of", "n", "pos", "doc", "component", "major", "visitor", "ref", "n_ref", "shared"))
    guests, homes = np.flatnonzero(visitor), np.flatnonzero(~visitor)
    parts, limited = [], False
    if leading is not None:
        sizes = np.bincount(of)
        per = np.zeros(len(sizes))
        np.add.at(per, of[guests], counts(Lists(of[homes], n[homes], pos[homes]), of[guests], n[guests], pos[guests], percent))
        long = per > dense * sizes
        limited = bool(long.any())
        own = homes[long[of[homes]]]
        if len(own):
            parts.append((own[leaders(of[own], n[own], doc[own], percent, leading, seed)], guests[long[of[guests]]]))
        homes, guests = homes[~long[of[homes]]], guests[~long[of[guests]]]
    parts.append((homes, guests))
    out = []
    for own, sets in parts:
        for x, y in partners(entries, own, sets, percent):
            keep = (component[x] != component[y]) & ((component[y] == major[y]) | (doc[x] < doc[y]))
            x, y = x[keep], y[keep]
            need = percent * (n[x] + n[y])
            alike = ref[x] == ref[y]
            upper = np.minimum(shared[x], shared[y]) + np.minimum(n[x] - shared[x], n[y] - shared[y])
            keep = ~alike | (upper * (100 + percent) >= need)
            sure = alike & ((shared[x] + shared[y] - n_ref[x]) * (100 + percent) >= need)
            if keep.any():
                out.append((x[keep], y[keep], sure[keep]))
    return out, limited
