"""Suffix arrays by induced sorting, and permuted common prefixes, for one shard of text inside a task."""

from __future__ import annotations

import numpy as np


def _classify(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the one after it. The last symbol is the least and stands alone."""
    n = len(t)
    s = np.zeros(n, bool)
    s[n - 1] = True
    if n > 1:
        up, same = t[:-1] < t[1:], t[:-1] == t[1:]
        # an equal symbol has the type of the next different one
        place = np.where(same, 0, np.arange(1, n))
        nxt = np.flatnonzero(~same)
        s[:-1] = up[nxt[np.searchsorted(nxt, np.arange(n - 1))]]
        del place
    return s


def _induce_by_bucket(t, sa, small, heads, tails, sizes) -> None:
    """Sort all suffixes from the leftmost-smaller ones in ``sa``, a bucket at a time: for texts of few symbols.

    What a bucket induces into itself is done in rounds; the order within a round is that of the array.
    """
    present = np.flatnonzero(sizes)
    at = heads.copy()
    n = len(t)
    filled_from = {}
    for c in present:
        low, high = heads[c], heads[c] + sizes[c]
        # larger suffixes stand before the smaller ones of a bucket: first what was induced so far, then more of it
        done = low
        while True:
            part = sa[done:at[c]]
            done = at[c]
            part = part[part > 0] - 1
            part = part[~small[part]]
            _append(t, sa, part, at)
            if at[c] == done:
                break
        filled_from[c] = at[c]
        part = sa[at[c]:high]
        part = part[part > 0] - 1
        _append(t, sa, part[~small[part]], at)
    # the smaller ones anew, from the right
    end = tails.copy()
    for c in present:
        sa[filled_from[c]:tails[c]] = -1
    if n:
        sa[0] = n - 1
        end[t[n - 1]] -= 1
    for c in present[::-1]:
        done = tails[c] if c != t[n - 1] else end[c]
        if c == t[n - 1]:
            continue
        while True:
            low = end[c]
            part = sa[low:done][::-1]
            done = low
            part = part[part > 0] - 1
            part = part[small[part]]
            _prepend(t, sa, part, end)
            if end[c] == done:
                break
        part = sa[heads[c]:filled_from[c]][::-1]
        part = part[part > 0] - 1
        _prepend(t, sa, part[small[part]], end)


def _append(t, sa, part, at) -> None:
    if len(part):
        c = t[part]
        order = np.argsort(c, kind="stable")
        part, c = part[order], c[order]
        names, first, count = np.unique(c, return_index=True, return_counts=True)
        sa[np.repeat(at[names] - first, count) + np.arange(len(part))] = part
        at[names] += count


def _prepend(t, sa, part, end) -> None:
    if len(part):
        c = t[part]
        order = np.argsort(c, kind="stable")
        part, c = part[order], c[order]
        names, first, count = np.unique(c, return_index=True, return_counts=True)
        sa[np.repeat(end[names] - 1 + first, count) - np.arange(len(part))] = part
        end[names] -= count


def _induce_one_by_one(t, sa, small, heads, tails, sizes) -> None:
    """The same for texts of many symbols, whose buckets are too small for whole-array steps."""
    text, out, kind = t.tolist(), sa.tolist(), small.tolist()
    at = heads.tolist()
    n = len(text)
    larger_at = []
    for i in range(n):
        j = out[i] - 1
        if j >= 0 and not kind[j]:
            c = text[j]
            out[at[c]] = j
            at[c] += 1
    larger_at = at
    first = heads.tolist()
    end = tails.tolist()
    for c in range(len(first)):
        for i in range(larger_at[c], end[c]):
            out[i] = -1
    last = text[n - 1]
    out[0] = n - 1
    end[last] = 0
    for i in range(n - 1, -1, -1):
        j = out[i] - 1
        if j >= 0 and kind[j]:
            c = text[j]
            end[c] -= 1
            out[end[c]] = j
    sa[:] = out


def _sorted_suffixes(t: np.ndarray, symbols: int) -> np.ndarray:
    """Suffix array of ``t``, whose last symbol 0 occurs nowhere else."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    small = _classify(t)
    left = np.flatnonzero(small[1:] & ~small[:-1]) + 1  # leftmost smaller suffixes
    sizes = np.bincount(t, minlength=symbols)
    tails = np.cumsum(sizes)
    heads = tails - sizes
    induce = _induce_by_bucket if symbols <= 2048 and n > 4 * symbols else _induce_one_by_one

    def placed(order: np.ndarray) -> np.ndarray:
        sa = np.full(n, -1, np.int64)
        end = tails.copy()
        _prepend(t, sa, order[::-1], end)
        induce(t, sa, small, heads, tails, sizes)
        return sa

    sa = placed(left)
    order = sa[np.isin(sa, left, assume_unique=True)] if len(left) else left
    # name the substrings between leftmost smaller suffixes; equal ones share a name
    ends = np.append(left[1:], n - 1)
    length = np.zeros(n, np.int64)
    length[left] = np.minimum(ends + 1, n) - left
    differs = np.ones(len(order), bool)
    if len(order) > 1:
        a, b = order[:-1], order[1:]
        equal = length[a] == length[b]
        k = 0
        live = np.flatnonzero(equal)
        while len(live):
            live = live[length[a[live]] > k]
            same = (t[a[live] + k] == t[b[live] + k]) & (small[a[live] + k] == small[b[live] + k])
            equal[live[~same]] = False
            live = live[same]
            k += 1
        differs[1:] = ~equal
    names = np.cumsum(differs) - 1
    if len(order) and names[-1] + 1 < len(order):
        name_at = np.empty(n, np.int64)
        name_at[order] = names
        # the last leftmost smaller suffix is the end symbol, the only one of name 0
        order = left[_sorted_suffixes(name_at[left], int(names[-1]) + 1)]
    return placed(order)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of an array of non-negative symbols, end excluded."""
    values, t = np.unique(t, return_inverse=True)
    if not len(t):
        return np.empty(0, np.int64)
    return _sorted_suffixes(np.append(t.reshape(-1) + 1, 0).astype(np.int64), len(values) + 1)[1:]


def permuted_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place of ``t``, in text order, the common prefix with the suffix before it in the array.

    Where a place and its neighbour follow equal symbols, the prefix is one less than that of the place before. Only
    the other places are compared symbol by symbol, all at once.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    has = before >= 0
    follows = np.zeros(n, bool)
    if n > 1:
        follows[1:] = has[1:] & (before[1:] > 0) & (t[:-1] == t[np.maximum(before[1:], 1) - 1])
    common = np.zeros(n, np.int64)
    live, k = np.flatnonzero(has & ~follows), 0
    while len(live):
        i, j = live + k, before[live] + k
        live, i, j = (x[(i < n) & (j < n)] for x in (live, i, j))
        live = live[t[i] == t[j]]
        common[live] += 1
        k += 1
    start = np.maximum.accumulate(np.where(follows, 0, np.arange(n)))
    return np.where(has, common[start] - (np.arange(n) - start), 0)
