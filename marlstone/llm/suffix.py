"""Suffix arrays by induced sorting, and permuted common prefixes.

The first level sorts bytes: whole buckets are induced at once with numpy, one
round for each step of a run of equal bytes. Deeper levels, a third of the size
and less, have alphabets too large for that and are induced element by element.
"""

from __future__ import annotations

import numpy as np


def s_types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last is."""
    n = len(s)
    change = np.flatnonzero(s[1:] != s[:-1])
    out = np.ones(n, bool)
    if len(change):
        smaller = s[change] < s[change + 1]
        out[: change[-1] + 1] = np.repeat(smaller, np.diff(change, prepend=-1))
    return out


#: Symbols of LMS substrings that are compared at a time.
_COMPARE = 1 << 18


def _name(s: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings, which ``ordered`` sorts: neighbours of one
    length are compared symbol by symbol."""
    place = np.empty(len(s), np.int32)
    place[lms] = np.arange(len(lms), dtype=np.int32)
    rank = place[ordered]
    size = (np.append(lms[1:], len(s) - 1) + 1 - lms)[rank]
    new = np.ones(len(rank), np.int64)
    at = np.flatnonzero(size[1:] == size[:-1]) + 1
    ends = np.cumsum(size[at])
    i = 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] - size[at[i]] + _COMPARE, "right")))
        some, n = at[i:j], size[at[i:j]]
        first = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(first, n)
        differ = s[np.repeat(ordered[some], n) + step] != s[np.repeat(ordered[some - 1], n) + step]
        new[some] = np.logical_or.reduceat(differ, first)
        i = j
    names = np.empty(len(lms), np.int64)
    names[rank] = np.cumsum(new) - 1
    return names, int(new.sum())


def _spread(sa: np.ndarray, heads: np.ndarray, items: np.ndarray, chars: np.ndarray, step: int) -> None:
    """Append items to their buckets, in order, upward or downward."""
    order = np.argsort(chars, kind="stable")
    c = chars[order]
    count = np.bincount(c, minlength=len(heads))
    first = np.cumsum(count) - count
    place = np.arange(len(c)) - first[c]
    sa[heads[c] + step * place] = items[order]
    heads += step * count


def _induce_bytes(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    n = len(s)
    count = np.bincount(s, minlength=sigma)
    ends = np.cumsum(count)
    begins = ends - count
    # LMS suffixes stand at their buckets' ends, in the order given.
    lms_char = s[lms]
    by_char = np.argsort(lms_char, kind="stable")
    lms_by, n_lms = lms[by_char], np.bincount(lms_char, minlength=sigma)
    lms_end = np.cumsum(n_lms)
    sa = np.full(n, -1, np.int32)
    head = begins.copy()
    present = np.flatnonzero(count)
    for c in present:
        done = begins[c]
        while done < head[c]:
            pre = sa[done : head[c]] - 1
            done = head[c]
            pre = pre[pre >= 0]
            pre = pre[~is_s[pre]]
            if len(pre):
                _spread(sa, head, pre, s[pre], 1)
        if n_lms[c]:
            pre = lms_by[lms_end[c] - n_lms[c] : lms_end[c]] - 1
            pre = pre[pre >= 0]
            pre = pre[~is_s[pre]]
            if len(pre):
                _spread(sa, head, pre, s[pre], 1)
    tail = ends - 1
    for c in present[::-1]:
        done = ends[c] - 1
        while done > tail[c]:
            pre = sa[tail[c] + 1 : done + 1][::-1] - 1
            done = tail[c]
            pre = pre[pre >= 0]
            pre = pre[is_s[pre]]
            if len(pre):
                _spread(sa, tail, pre, s[pre], -1)
        pre = sa[begins[c] : head[c]][::-1] - 1
        pre = pre[pre >= 0]
        pre = pre[is_s[pre]]
        if len(pre):
            _spread(sa, tail, pre, s[pre], -1)
    # The last suffix is the smallest; nothing induces it.
    sa[0] = n - 1
    return sa


def _induce_names(s: list[int], is_s: bytes, lms: list[int], ends: list[int]) -> list[int]:
    n = len(s)
    sa = [-1] * n
    tail = ends[1:]
    for i in reversed(lms):
        c = s[i]
        tail[c] -= 1
        sa[tail[c]] = i
    head = ends[:-1]
    for i in sa:  # what is written on the way lies ahead
        if i > 0 and not is_s[i - 1]:
            c = s[i - 1]
            sa[head[c]] = i - 1
            head[c] += 1
    tail = ends[1:]
    for k in range(n - 1, -1, -1):
        i = sa[k]
        if i > 0 and is_s[i - 1]:
            c = s[i - 1]
            tail[c] -= 1
            sa[tail[c]] = i - 1
    sa[0] = n - 1
    return sa


#: Alphabets up to this size are induced a bucket at a time.
BUCKETS = 512


def _induce(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    if sigma <= BUCKETS:
        return _induce_bytes(s, is_s, lms, sigma)
    ends = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=sigma))])
    return np.array(_induce_names(s.tolist(), is_s.tobytes(), lms.tolist(), ends.tolist()), np.int32)


def suffix_array(s: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array of integers below ``sigma`` whose last is the only 0."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    is_s = s_types(s)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = is_s[1:] & ~is_s[:-1]
    lms = np.flatnonzero(is_lms)
    sa = _induce(s, is_s, lms, sigma)
    ordered = sa[is_lms[sa]]
    names, kinds = _name(s, lms, ordered)
    if kinds < len(lms):
        # The last LMS substring is the sentinel: the only name 0.
        ordered = lms[suffix_array(names, kinds)]
    return _induce(s, is_s, ordered, sigma)


def permuted_common_prefixes(s: np.ndarray, sa: np.ndarray, limit: int) -> np.ndarray:
    """In text order, the length that each suffix of ``sa`` shares with its
    predecessor there, counted up to ``limit``; -1 where ``sa`` has none.

    The text needs ``limit`` symbols after each suffix of ``sa``.
    """
    phi = np.full(len(s), -1, np.int32)
    phi[sa[1:]] = sa[:-1]
    out = np.full(len(s), -1, np.int32)
    at = np.flatnonzero(phi >= 0)
    out[at] = 0
    # Eight symbols at a time, then one at a time.
    n = max(0, len(s) - 7)
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word |= s[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    k = 0
    while k < limit and len(at):
        step = 8 if limit - k >= 8 else 1
        side = word if step == 8 else s
        same = side[at + k] == side[phi[at] + k]
        more = at[same]
        k += step
        out[more] = k
        if step == 8 and k < limit:
            _finish(s, phi, out, at[~same], k - 8)
        at = more
    return out


def _finish(s: np.ndarray, phi: np.ndarray, out: np.ndarray, at: np.ndarray, k: int) -> None:
    for _ in range(8):
        at = at[s[at + k] == s[phi[at] + k]]
        k += 1
        out[at] = k
