"""String similarity scores from 0 to 100, by the public definitions of the indel ratio and its token forms."""

from __future__ import annotations

import numpy as np


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit per character of a."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s, get = full, masks.get
    for c in b:
        u = s & get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def simple_ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 200.0 * lcs(a, b) / n if n else 100.0


def quick_ratio(a: str, b: str) -> float:
    return simple_ratio(a, b) if a and b else 0.0


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string against any window of its length in the longer, cut off at the edges."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0 if b else 100.0
    m, best = len(a), 0.0
    for i in range(1 - m, len(b)):
        window = b[max(0, i) : i + m]
        if 200.0 * min(m, len(window)) / (m + len(window)) > best:
            best = max(best, simple_ratio(a, window))
    if m == len(b) and best < 100:
        for i in range(1 - m, m):
            best = max(best, simple_ratio(b, a[max(0, i) : i + m]))
    return best


def sorted_words(text: str) -> str:
    return " ".join(sorted(text.split()))


def token_sort_ratio(a: str, b: str) -> float:
    return simple_ratio(sorted_words(a), sorted_words(b))


def _sets(a: str, b: str) -> tuple[set, str, str, str]:
    x, y = set(a.split()), set(b.split())
    return x & y, " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))


def token_set_ratio(a: str, b: str) -> float:
    if not a.split() or not b.split():
        return 0.0
    both, common, left, right = _sets(a, b)
    if both and (not left or not right):
        return 100.0
    gap = 1 if common else 0
    n, na, nb = len(common), len(left), len(right)
    apart = na + nb - 2 * lcs(left, right)
    best = 100.0 - 100.0 * apart / (2 * (n + gap) + na + nb)
    if common:
        best = max(best, *(100.0 - 100.0 * (gap + x) / (2 * n + gap + x) for x in (na, nb)))
    return best


def _partial_token_ratio(a: str, b: str) -> float:
    both, _, left, right = _sets(a, b)
    if both:
        return 100.0
    return max(partial_ratio(sorted_words(a), sorted_words(b)), partial_ratio(left, right) if left and right else 0.0)


def weighted_ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    best = simple_ratio(a, b)
    if longer < 1.5:
        return max(best, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if longer < 8 else 0.6
    return max(best, scale * partial_ratio(a, b), 0.95 * scale * _partial_token_ratio(a, b))


SCORERS = {f.__name__: f for f in (simple_ratio, partial_ratio, token_sort_ratio, token_set_ratio, weighted_ratio, quick_ratio)}
#: Scorers for which 2 * (characters in common, counted with multiplicity) / (sum of lengths) is an upper bound.
BOUNDED = {"simple_ratio", "token_sort_ratio", "quick_ratio"}


def _bags(texts: list[str]) -> np.ndarray:
    """Counts of characters in 32 buckets; sharing a bucket only loosens the bound."""
    out = np.zeros((len(texts), 32), np.int16)
    for i, t in enumerate(texts):
        out[i] = np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) & 31, minlength=32).clip(max=30000)
    return out


def similar_pairs(left: list[str], right: list[str], scorer: str, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) with score > 100 * threshold; only i < j where both lists are the same one."""
    score, limit = SCORERS[scorer], np.float32(100 * threshold)
    if scorer == "token_sort_ratio":
        left, right, score = [sorted_words(x) for x in left], [sorted_words(x) for x in right], simple_ratio
    bags = (_bags(left), _bags(right)) if scorer in BOUNDED else None
    sizes = np.array([len(x) for x in right])
    out_i, out_j = [], []
    for i, a in enumerate(left):
        js = np.arange(i + 1 if same else 0, len(right))
        if bags is not None and len(js):
            common = np.minimum(bags[0][i], bags[1][js]).sum(axis=1)
            total = len(a) + sizes[js]
            js = js[(200.0 * common > (100 * threshold - 1e-3) * total) | (total == 0)]
        for j in js:
            if np.float32(score(a, right[j])) > limit:
                out_i.append(i)
                out_j.append(int(j))
    return np.array(out_i, np.int64), np.array(out_j, np.int64)
