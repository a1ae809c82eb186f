"""Plain versions of the operators, for comparison on small inputs."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import xxhash

SPACES = re.compile(rb"[\x20\x09-\x0D]+")


def repeats(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def fingerprint(text, size=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def linked(fps, radius=4):
    """The index of each one's component: the smallest index reachable."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(fps))]


def unigram(rows):
    """n_tokens, n_known, train_tokens, base_score by (doc_id, text)."""
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    tok = lambda t: [*(t or "").encode().lower().split(), None]
    c = collections.Counter(w for i, t in rows if not held(i) for w in tok(t))
    n, v = sum(c.values()), len(c)
    return [(held(i), len(tok(t)), sum(w in c for w in tok(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tok(t))) for i, t in rows]


def suffix_tree(rows, p, model=False):
    """The log10 probability of each text of (doc_id, text) by a tree in dictionaries, and the number of states; or with
    ``model`` the probability of a word after a context, the states and the words learnt."""
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    tok = lambda t: [*(t or "").encode().lower().split(), None]
    texts = [tok(t) for _, t in rows]
    train = [x for (i, _), x in zip(rows, texts) if not held(i)]
    unigrams = collections.Counter(w for x in train for w in x)
    total = sum(unigrams.values())
    follow = collections.defaultdict(collections.Counter)
    for x in train:
        for i in range(1, len(x)):
            for k in range(1, min(i, p.depth) + 1):
                follow[tuple(x[i - k : i])][x[i]] += 1
    state = {}
    for context, after in follow.items():
        own = sum(after.values())
        listed = {w: n for w, n in after.items() if n >= p.least_count}
        if not listed:
            continue
        if len(context) == 1:
            lower = {w: unigrams[w] / (total + 1) for w in listed}
        else:
            suffix = follow[context[1:]]
            lower = {w: suffix[w] / sum(suffix.values()) for w in listed}
        kl = sum(n / own * math.log(n / own / lower[w]) for w, n in listed.items())
        left = max(1 - sum(listed.values()) / own, 0)
        if left > 1e-15:
            kl += left * math.log(left / max(1 - sum(lower.values()), 1e-12))
        if kl >= p.divergence and 2 * own * kl > len(listed) + p.deviations * math.sqrt(2 * len(listed)):
            mass = {w: max(n - p.discount, 0) / own for w, n in listed.items()}
            state[context] = (1 - sum(mass.values()), mass)

    def probability(context, w):
        if not context:
            return max(unigrams[w], 1) / (total + 1)
        shorter = probability(context[1:], w)
        if context not in state:
            return shorter
        back, mass = state[context]
        return mass.get(w, 0.0) + back * shorter

    if model:
        return probability, sorted(state, key=str), list(unigrams)
    return [sum(math.log10(probability(tuple(x[max(0, i - p.depth) : i]), w)) for i, w in enumerate(x)) for x in texts], len(state)
