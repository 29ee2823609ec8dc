"""Plain Python twins of the operators, for small inputs."""

import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rule_counts(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if seen[g] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def edited_texts(rows):
    """{doc_id: edited text} of [(doc_id, text)]."""
    rows = sorted((i, t or "") for i, t in rows)
    out = {}
    for n, (i, text) in enumerate(rows):
        half = len(text) // 2
        out[i] = text[: len(text) - half] + rows[(n + 1) % len(rows)][1][:half]
    return out


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def components(rows):
    """{doc_id: smallest doc_id reachable} over links of Jaccard 0.75 or more."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((root(sets[a][0]), root(sets[b][0])))
                parent[q] = p
    return {i: root(i) for i, _ in sets}


def xx(*values):
    """Spark's xxhash64 of strings, bigints and (as 4 bytes) numpy-like ints given as ('int', n): signed."""
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<i", v[1]) if isinstance(v, tuple) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) * (seed >> 63)


def murmur(*longs):
    """Spark's 32-bit hash of bigints: signed."""
    m, rot = 0xFFFFFFFF, lambda x, r: (x << r | x >> 32 - r) & 0xFFFFFFFF
    seed = 42
    for v in longs:
        h = seed
        for word in (v & m, v >> 32 & m):
            k = rot(word * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
            h = (rot(h ^ k, 13) * 5 + 0xE6546B64) & m
        h ^= 8
        h = (h ^ h >> 16) * 0x85EBCA6B & m
        h = (h ^ h >> 13) * 0xC2B2AE35 & m
        seed = h ^ h >> 16
    return seed - (1 << 32) * (seed >> 31)


def order_min_hash(text, k=3, size=2, coordinates=64, longest=24, orders=4):
    """List of 32-bit numbers: of every rotation of every order, the least elements in text order."""
    tokens = [w[i : i + longest] for w in WORD.findall(text or "") for i in range(0, len(w), longest)]
    if not tokens:
        return []
    grams = [tuple(tokens[i : i + k]) for i in range(max(1, len(tokens) - k + 1))]
    seen, elements = Counter(), []
    for at, gram in enumerate(grams):
        mask = (1 << 32) - 1
        name = xx(*gram) >> 31 & mask
        n, seen[name] = seen[name], seen[name] + 1
        elements.append((xx(name, ("int", n)) >> 31 & mask if n else name, at))
    out, each = [], coordinates // orders
    for order in range(orders):
        dealt = sorted((xx(name, ("int", -order)) >> 31 & mask if order else name, at) for name, at in elements)
        for j in range(each):
            anchor = j * (1 << 32) // each
            below = sum(e[0] < anchor for e in dealt)
            chosen = [dealt[(below + i) % len(dealt)] for i in range(size)]
            out.append(murmur(*[e[0] for e in sorted(chosen, key=lambda e: e[1])]))
    return out


def alike(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    return sum(x == y for x, y in zip(a, b)) / len(a)


def rendezvous(key, weights):
    """The shard of least cost, the lower one of equal ones."""
    draw = lambda j: ((xx("rendezvous", "null" if key is None else str(key), ("int", j)) & (1 << 64) - 1) >> 11) + 0.5
    costs = [-math.log(draw(j) / (1 << 53)) / w for j, w in enumerate(weights)]
    return costs.index(min(costs))


def binomial_allows(n, risk, level):
    """Largest k with P(binomial(n, risk) <= k) <= level; -1: none."""
    total, k = 0.0, -1
    for i in range(n):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(risk) + (n - i) * math.log1p(-risk))
        if total > level:
            break
        k = i
    return k


def rule_cutoffs(rows, rules, risk=0.02, level=0.05, loss=20, steps=50):
    """{(stratum, rule): cutoff or None} of [(stratum, quality, {rule: share})], from the highest cutoff down until one fails."""
    strata = defaultdict(list)
    for stratum, quality, shares in rows:
        strata[stratum].append((quality, shares))
    found = {}
    for stratum, own in strata.items():
        good = [s for q, s in own if q == 1]
        bad = [s for q, s in own if q == 0]
        allowed = binomial_allows(len(good), risk, level / (len(strata) * len(rules)))
        for rule in rules:
            passed = []
            for c in range(steps - 1, 0, -1):
                out = [sum(s[rule] * steps > c + 1e-9 for s in side) for side in (good, bad)]
                if out[0] > allowed:
                    break
                passed.append((round(out[1] / max(1, len(bad)) - loss * out[0] / max(1, len(good)), 12), c))
            best = max(passed, default=(0, 0))[0]
            top = [c for gain, c in passed if gain == best]
            found[stratum, rule] = math.floor(sum(top) / len(top) + 0.5) / steps if best > 0 else None
    return found


def site_bayes(rows):
    """{row number: (p_host, p_path)} of [(host, path, p)], each row's own p left out: sums, moments and shrinkage one after the other."""
    def strength(sites):
        weight = sum(n for _, n, _ in sites)
        spread = sum(n * (m - prior) ** 2 for m, n, prior in sites) / weight
        noise = sum(prior * (1 - prior) for _, _, prior in sites) / weight
        pooled = sum(n * prior * (1 - prior) for _, n, prior in sites) / weight
        return min(max(pooled / max(spread - noise, 1e-6) - 1, 1.0), 10_000.0)

    hosts, paths = defaultdict(list), defaultdict(list)
    for host, path, p in rows:
        hosts[host].append(p)
        paths[host, path].append(p)
    mean = lambda x: sum(x) / len(x)
    rate = mean([p for *_, p in rows])
    by_host = strength([(mean(x), len(x), rate) for x in hosts.values()])
    by_path = strength([(mean(x), len(x), mean(hosts[k[0]])) for k, x in paths.items()])
    out = {}
    for i, (host, path, p) in enumerate(rows):
        p_host = (by_host * rate + sum(hosts[host]) - p) / (by_host + len(hosts[host]) - 1)
        own = paths[host, path]
        out[i] = (p_host, (by_path * p_host + sum(own) - p) / (by_path + len(own) - 1))
    return out
