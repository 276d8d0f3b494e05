"""Suffix arrays by Larsson-Sadakane refinement and common prefixes by Kasai's rule, in numpy."""

from __future__ import annotations

import numpy as np


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    head = np.ones(len(ordered), bool)
    head[1:] = ordered[1:] != ordered[:-1]
    return head


def _tied(head: np.ndarray) -> np.ndarray:
    """Which places are in runs of more than one."""
    after = np.ones(len(head), bool)
    after[:-1] = head[1:]
    return ~(head & after)


def suffix_array(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix array, place of each suffix in it, rank), by the first `depth` symbols. Suffixes that tie in all
    of these have one rank and stand together in no particular order.

    Groups that still tie are refined by the rank h symbols on, and h doubles. Suffixes alone in their group
    keep their place and are not touched again.
    """
    n = len(symbols)
    code, base, h = symbols.astype(np.int64) + 1, int(symbols.max(initial=0)) + 2, 1
    while 2 * h <= depth and base ** (2 * h) < 1 << 62:
        later = np.zeros(n, np.int64)
        later[: max(0, n - h)] = code[h:]
        code = code * base**h + later
        h *= 2
    sa = np.argsort(code, kind="stable")
    head = _starts(code[sa])
    slots, rank = np.arange(n), np.empty(n, np.int64)
    rank[sa] = slots[head][np.cumsum(head) - 1]
    slots = slots[_tied(head)]
    while h < depth and len(slots):
        step = min(h, depth - h)
        mine = sa[slots]
        ahead = np.where(mine + step < n, rank[np.minimum(mine + step, n - 1)] + 1, 0)
        key = rank[mine] * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        mine, head = mine[order], _starts(key[order])
        sa[slots] = mine
        rank[mine] = slots[head][np.cumsum(head) - 1]  # the first slot of its group
        slots = slots[_tied(head)]
        h += step
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    return sa, place, rank


def common_prefixes(symbols: np.ndarray, sa: np.ndarray, place: np.ndarray, rank: np.ndarray, begins: np.ndarray, lengths: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix the symbols (at most `depth`) it shares with the suffix before it in the array.

    Kasai's rule: one symbol on in the text the common prefix is at most one shorter. It holds for suffixes that
    differ within `depth`; those of one rank share `depth`, and the symbol after such a run starts from nothing.
    The strings that make up the text (each ends with a symbol of its own) are walked side by side, from their
    begins over as many suffixes as `lengths` says; other suffixes have 0.
    """
    out = np.zeros(len(symbols), np.int64)
    h = np.zeros(len(begins), np.int64)
    order = np.argsort(-lengths, kind="stable")
    begins, lengths = begins[order], lengths[order]
    for t in range(int(lengths.max(initial=0))):
        live = int(np.searchsorted(-lengths, -t, side="left"))
        i = begins[:live] + t
        before = place[i] - 1
        j = sa[np.maximum(before, 0)]
        h = h[:live]
        h = np.where((before < 0) | (h >= depth), 0, np.maximum(h - 1, 0))
        h[(before >= 0) & (rank[i] == rank[j])] = depth
        going = np.flatnonzero((before >= 0) & (h < depth))
        while len(going):
            going = going[symbols[i[going] + h[going]] == symbols[j[going] + h[going]]]
            h[going] += 1
            going = going[h[going] < depth]
        out[i] = h
    return out
