"""Edit distance of word sequences within a band."""

from __future__ import annotations

from collections import Counter

import numpy as np


def banded_distance(a: list, b: list, k: int) -> int:
    """Levenshtein distance of ``a`` and ``b`` if it is at most ``k``, else k + 1.

    Only the cells within ``k`` of the diagonal are computed, a column at a time
    as one integer whose bits are the band's vertical differences.
    """
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n - m > k:
        return k + 1
    k = min(k, n)
    if not m:
        return n
    width = 2 * k + 2
    ones, top = (1 << width) - 1, 1 << (width - 1)
    at: dict = {}
    for i, word in enumerate(a):
        at[word] = at.get(word, 0) | 1 << i
    vp, vn, distance, start = ones ^ ((1 << (width - k - 1)) - 1), 0, k, k + 1 - width
    worst, row = k + m - (n - k), top >> 1
    for j in range(m):
        x = at.get(b[j], 0)
        x = (x >> start if start >= 0 else x << -start) & ones
        d0 = ((((x & vp) + vp) & ones) ^ vp) | x | vn
        hp, hn = vn | (ones & ~(d0 | vp)), d0 & vp
        if j < n - k:  # down the band's lower edge
            if not d0 & top:
                distance += 1
                if distance > worst:
                    return k + 1
        else:  # along the last row
            if hp & row:
                distance += 1
            elif hn & row:
                distance -= 1
            row >>= 1
        d0 >>= 1
        vp, vn = hn | (ones & ~(d0 | hp)), d0 & hp
        start += 1
    return distance if distance <= k else k + 1


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether 1 - distance / longer length is at least ``least``; two empty texts are."""
    longer = max(len(a), len(b))
    limit = int((1 - least) * longer + 1e-9)
    if abs(len(a) - len(b)) > limit:
        return False
    for _ in range(2):  # common ends cost nothing
        m = min(len(a), len(b))
        same = a[:m] == b[:m]
        cut = m if same.all() else int(np.argmin(same))
        a, b = a[cut:][::-1], b[cut:][::-1]
    if not len(a) or not len(b):
        return max(len(a), len(b)) <= limit
    a, b = a.tolist(), b.tolist()
    if max(len(a), len(b)) - (Counter(a) & Counter(b)).total() > limit:
        return False
    k = min(8, limit)
    while True:
        if banded_distance(a, b, k) <= k:
            return True
        if k == limit:
            return False
        k = min(4 * k, limit)
