"""Plain versions of the operators, for small inputs."""

import bisect
import hashlib
import re
from collections import defaultdict


def repeats(texts, length=400):
    """Per text: bytes removed, runs, and the hash of what stays."""
    bodies = [(t or "").encode() for t in texts]
    seen = defaultdict(int)
    for b in bodies:
        for i in range(len(b) - length + 1):
            seen[hashlib.blake2b(b[i : i + length], digest_size=16).digest()] += 1
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[hashlib.blake2b(b[i : i + length], digest_size=16).digest()] > 1:
                gone[i : i + length] = b"\1" * length
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def without_passages(texts, length=400, words=51):
    """Texts without the strings of ``length`` bytes and the passages of ``words`` words that occur twice."""
    bodies = [(t or "").encode() for t in texts]
    strings = []
    for b in bodies:
        own = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)]
        strings.append([(i, i + length) for i in range(len(b) - length + 1)] + [(own[i][0], own[i + words - 1][1]) for i in range(len(own) - words + 1)])
    key = lambda b, x, y: hashlib.blake2b(b[x:y], digest_size=16).digest()
    seen, out = defaultdict(set), []
    for i, (b, own) in enumerate(zip(bodies, strings)):
        for x, y in own:
            seen[key(b, x, y)].add((i, x))
    for b, own in zip(bodies, strings):
        gone = bytearray(len(b))
        for x, y in own:
            if len(seen[key(b, x, y)]) > 1:
                gone[x:y] = b"\1" * (y - x)
        out.append(bytes(c for c, g in zip(b, gone) if not g).decode("utf-8", "ignore"))
    return out


def simhash(text, words=4):
    import xxhash

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not found:
        return 0
    grams = [" ".join(found)] if len(found) < words else [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def shingles(text, words=5):
    """The set of a text's shingles; all words are one where there are fewer."""
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))) if found else frozenset()


def joined(n, pairs):
    """Smallest index that each of n reaches."""
    up = list(range(n))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def best_fit(counts, size):
    """Sequences that best-fit decreasing opens."""
    gaps, opened = [], 0
    for v in range(size, 0, -1):
        for _ in range(int(counts[v])):
            i = bisect.bisect_left(gaps, v)
            if i < len(gaps):
                gap = gaps.pop(i) - v
            else:
                opened, gap = opened + 1, size - v
            if gap:
                bisect.insort(gaps, gap)
    return opened
