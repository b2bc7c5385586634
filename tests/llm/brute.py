"""Plain versions of the operators, for small inputs."""

import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    words = WORDS.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(len(words) - width + 1, 1)))


def components(nodes, edges):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def near(texts, width, percent):
    """id -> (number of shingles, component)."""
    sets = {i: shingles(t, width) for i, t in texts.items()}
    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    both = {}
    for ids in by.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                both[a, b] = both.get((a, b), 0) + 1
    edges = [(a, b) for (a, b), n in both.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    found = components(sets, edges)
    return {i: (len(s), found[i]) for i, s in sets.items()}


def mix_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """source -> target."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, full, pool = {}, set(), share * sum(sizes.values())
    while True:
        left = pool - sum(cap * sizes[s] for s in full)
        each = left / (sum(weight[s] for s in names if s not in full) or 1)
        over = {s for s in names if s not in full and weight[s] * each > cap * sizes[s]}
        if not over:
            break
        full |= over
    for s in names:
        target[s] = cap * sizes[s] if s in full else weight[s] * each
    return target
