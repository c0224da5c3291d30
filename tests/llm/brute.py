"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import regex
import xxhash


class Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*[words[k:] for k in range(width)]))


def near(docs, width, percent=80):
    """doc_id -> (set size, component)."""
    sets = {i: shingles(t, width) for i, t in docs}
    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    groups = Union(sets)
    for i, s in sets.items():
        for j, shared in Counter(j for g in s for j in holders[g] if j > i).items():
            if 100 * shared >= percent * (len(s) + len(sets[j]) - shared):
                groups.join(i, j)
    return {i: (len(s), groups.find(i)) for i, s in sets.items()}


def substrings(docs, length=100):
    """doc_id -> (bytes, removed, spans, digest), texts in order of id."""
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            window = data[k : k + length]
            if window in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def normalised(line):
    return regex.sub(r"[^\p{L}\p{M}\p{N}]+", " ", line.lower()).strip(" ")


def simhash(norm):
    hashes = np.array([xxhash.xxh64_intdigest(w.encode(), 42) for w in norm.split(" ")], np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view(np.uint64)[0])


def edits(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def fuzzy_lines(docs, least_words=5, distance=2, percent=90):
    """doc_id -> numbers of the lines that repeat an earlier one."""
    places, numbers = [], {}
    for i, text in docs:
        for n, line in enumerate((text or "").split("\n")):
            norm = normalised(line)
            if norm.count(" ") + 1 >= least_words:
                places.append((i, n, numbers.setdefault(norm, len(numbers))))
    lines = list(numbers)
    hashes = [simhash(x) for x in lines]
    groups = Union(range(len(lines)))
    for a in range(len(lines)):
        for b in range(a + 1, len(lines)):
            if bin(hashes[a] ^ hashes[b]).count("1") <= distance:
                longer = max(len(lines[a]), len(lines[b]))
                if edits(lines[a], lines[b]) <= longer * (100 - percent) // 100:
                    groups.join(a, b)
    seen, out = set(), defaultdict(list)
    for i, n, line in sorted(places):
        group = groups.find(line)
        if group in seen:
            out[i].append(n)
        seen.add(group)
    return out


def similar_lines(docs, percent=90):
    """doc_id -> numbers of the lines that repeat an earlier one, by edit similarity alone."""
    places = [(i, n, x) for i, text in docs for n, x in enumerate(map(normalised, (text or "").split("\n"))) if x]
    lines = sorted({x for _, _, x in places}, key=len)
    groups = Union(range(len(lines)))
    for b, y in enumerate(lines):
        allowed = len(y) * (100 - percent) // 100
        for a, x in enumerate(lines[:b]):
            # Each edit changes the counts of characters by two at most.
            if len(y) - len(x) <= allowed and (Counter(y) - Counter(x)).total() <= allowed and edits(x, y) <= allowed:
                groups.join(a, b)
    number = {x: k for k, x in enumerate(lines)}
    seen, out = set(), defaultdict(list)
    for i, n, x in sorted(places):
        group = groups.find(number[x])
        if group in seen:
            out[i].append(n)
        seen.add(group)
    return out


def exact(docs):
    """doc_id -> (keep_id, group size, digest)."""
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in docs}
    members = defaultdict(list)
    for i, t in norm.items():
        members[t].append(i)
    return {i: (min(members[t]), len(members[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}


def repeated(sources):
    """Sorted ids, each as often as its Poisson draw says; sources weigh the root of their size."""
    sizes = Counter(sources.values())
    weights = {s: n**0.5 for s, n in sizes.items()}
    found = []
    for i, s in sources.items():
        rate = weights[s] / sum(weights.values()) * len(sources) / sizes[s]
        u = int(hashlib.md5(f"0|{i}".encode()).hexdigest()[:13], 16) / 2**52
        times, p = 0, math.exp(-rate)
        below = p
        while below <= u:
            times += 1
            p *= rate / times
            below += p
        found += [i] * times
    return sorted(found)
