"""Plain versions of the operators, for small fixtures."""

import re
from collections import Counter, defaultdict
from fractions import Fraction


def shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def near(rows):
    """doc_id -> (set size, smallest doc_id reachable)."""
    sets = {i: shingles(t) for i, t in rows}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    both = Counter((a, b) for h in holders.values() for k, a in enumerate(h) for b in h[k + 1 :])
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), n in both.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(s), top(i)) for i, s in sets.items()}


def quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
    n = len(covered)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), n, len(w) < 10 or 100 * n > 20 * len(w)


def deviation(order, weights):
    """Largest distance of a source's blocks from its share, over an order of sources."""
    total, got, worst = sum(weights.values()), Counter(), Fraction(0)
    for t, s in enumerate(order, 1):
        got[s] += 1
        for x, w in weights.items():
            worst = max(worst, abs(got[x] - Fraction(w) * t / Fraction(total)))
    return worst
