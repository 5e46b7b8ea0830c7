"""Plain-Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def groups(nodes, links):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def shingles(text, width):
    w = SPACE.findall(lower(text or ""))
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}


def near_duplicates(docs, width, percent):
    """docs: {doc_id: text} -> {doc_id: (n_shingles, component)}; by an inverted index."""
    sets = {k: shingles(t, width) for k, t in docs.items()}
    where = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            where[x].append(k)
    links = []
    for a, s in sets.items():
        shared = defaultdict(int)
        for x in s:
            for b in where[x]:
                if b > a:
                    shared[b] += 1
        links += [(a, b) for b, n in shared.items() if 100 * n >= percent * (len(s) + len(sets[b]) - n)]
    root = groups(docs, links)
    return {k: (len(sets[k]), root[k]) for k in docs}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d // 10 + d % 10
    return total % 10 == 0


def personal(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def secrets(text):
    text, out = text or "", []
    for m in re.finditer(r"""(?i:(?a:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(1)) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(out)


def digest(spans, kinds):
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]
