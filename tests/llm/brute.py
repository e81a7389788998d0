"""Plain versions of the operators' rules, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    text = text or ""
    w = WORD.findall(text)
    times = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i, x in enumerate(zip(w, w[1:], w[2:])) if times[x] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def windows_removed(docs, size=13):
    """docs: [(doc_id, text)] -> per row (n_words, n_removed, kept_sha256)."""
    first = {}
    split = [(d, WORD.findall(t or "")) for d, t in docs]
    for d, w in split:
        if d is not None:
            for k in range(len(w) - size + 1):
                key = tuple(w[k : k + size])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in split:
        gone = [False] * len(w)
        if d is not None:
            for k in range(len(w) - size + 1):
                if first[tuple(w[k : k + size])] < d:
                    gone[k : k + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode("utf-8")).hexdigest()))
    return out


def longest_repeat(docs, size=13):
    """The level-wise rule by definition: windows of each length that two documents have."""
    split = {d: WORD.findall(t or "") for d, t in docs}
    level, out = size, dict.fromkeys(split, 0)
    while True:
        owners = defaultdict(set)
        for d in split:
            for k in range(len(split[d]) - level + 1):
                owners[tuple(split[d][k : k + level])].add(d)
        hit = {d for o in owners.values() if len(o) > 1 for d in o}
        if not hit:
            return out
        for d in hit:
            out[d] = level
        level *= 2


def shingles(text, size):
    w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def near_components(docs, size, percent=80):
    """docs: {doc_id: text} -> {doc_id: least doc_id reachable}."""
    sets = {d: shingles(t, size) for d, t in docs.items()}
    up = {d: d for d in docs}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    held = defaultdict(list)
    for d in sorted(docs):
        shared = Counter(e for s in sets[d] for e in held[s])
        for s in sets[d]:
            held[s].append(d)
        for e, n in shared.items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[e]) - n):
                a, b = top(d), top(e)
                up[max(a, b)] = min(a, b)
    return {d: top(d) for d in docs}, {d: len(s) for d, s in sets.items()}


def filled(sizes, weights, total, cap):
    """Shares of total by weight, none over cap times its size; the excess is shared again until none is above."""
    share, full = [0.0] * len(sizes), set()
    while True:
        rest = total - sum(cap * sizes[k] for k in full)
        weight = sum(w for k, w in enumerate(weights) if k not in full)
        share = [cap * s if k in full else rest * w / weight for k, (s, w) in enumerate(zip(sizes, weights))]
        over = {k for k in range(len(sizes)) if k not in full and share[k] > cap * sizes[k]}
        if not over:
            return share
        full |= over


def uniform(doc_id, seed):
    return (int(hashlib.md5(f"{seed}:{doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def mixed(rows, weights=(5, 2, 1), cap=3, lean=16, seed="mix1"):
    """[(doc_id, source, size)] -> {doc_id: copies}, {doc_id: expected copies}: the Pareto draw by sorting."""
    names = sorted({s for _, s, _ in rows})
    size = {s: sum(n for _, x, n in rows if x == s) for s in names}
    target = dict(zip(names, filled([size[s] for s in names], [weights[k % len(weights)] for k in range(len(names))], sum(size.values()), cap)))
    out, each = {}, {}
    for s in names:
        mine = [(d, n, max(n.bit_length() - 1, 0)) for d, x, n in rows if x == s]
        classes = sorted({c for _, _, c in mine})
        words = [sum(n for _, n, x in mine if x == c) for c in classes]
        want = {c: t / w if w else 0.0 for c, w, t in zip(classes, words, filled(words, [max(w, 1) * (lean + c) for c, w in zip(classes, words)], target[s], cap))}
        gap, ranks = target[s], []
        for d, n, c in mine:
            each[d], out[d] = want[c], int(want[c])
            gap -= out[d] * n
            p = want[c] - out[d]
            if p > 0 and n:
                u = uniform(d, seed)
                r = (u / (1 - u)) / (p / (1 - p))
                ranks.append((r / (r + 1), d, n))
        ranks.sort()
        while ranks and ranks[0][2] <= gap:
            _, d, n = ranks.pop(0)
            out[d] += 1
            gap -= n
        near = min(((abs(n - gap), r, d) for r, d, n in ranks if abs(n - gap) < gap), default=None)
        if near:
            out[near[2]] += 1
    return out, each
