"""Plain Python versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def quality(text):
    w = words(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (
        len(w),
        sum(map(len, w)),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        len(covered),
        len(w) < 50 or 100 * len(covered) > 50 * len(w),
    )


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, width=3):
    w = words(lowered(text))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def classes(links, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def jaccard_components(rows, percent=90, width=3):
    """{doc_id: (n_shingles, component_id)} for rows (doc_id, text) with different ids."""
    sets = {i: shingles(t, width) for i, t in rows}
    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    shared = Counter()
    for ids in holders.values():
        for x in range(len(ids)):
            for y in range(x + 1, len(ids)):
                shared[min(ids[x], ids[y]), max(ids[x], ids[y])] += 1
    links = [
        (a, b) for (a, b), n in shared.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)
    ]
    found = classes(links, sets)
    return {i: (len(s), found[i]) for i, s in sets.items()}


def repeated_bytes(rows, width=200):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256 of the rest)}: every string of ``width`` bytes that also starts elsewhere."""
    data = {i: (t or "").encode() for i, t in rows}
    seen = Counter(b[p : p + width] for b in data.values() for p in range(len(b) - width + 1))
    out = {}
    for i, b in data.items():
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if seen[b[p : p + width]] > 1:
                gone[p : p + width] = b"\1" * width
        rest = bytes(c for c, g in zip(b, gone) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return out


def repeated_words(rows, width=20):
    """{doc_id: (n_words, n_removed, sha256 of the rest)}: windows of words that also start earlier."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            window = tuple(w[p : p + width])
            if window in seen:
                gone[p : p + width] = [True] * width
            seen.add(window)
        rest = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(rest.encode()).hexdigest())
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    """Top of the tree, and for each leaf the siblings on its left and right by level."""
    level, places, paths = leaves, list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for k, p in enumerate(places):
            run = p - p % 3
            paths[k].append(("".join(level[run:p]), "".join(level[p + 1 : run + 3])))
        places = [p // 3 for p in places]
        level = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
    return level[0], paths


def fold(node, path):
    for left, right in path:
        node = sha(left + node + right)
    return node


def manifest(rows):
    """[(doc_id, leaf, subroot, root, proof, root folded from the text without line ends)] for rows (doc_id, source, lang, n_chars, text)."""
    of = defaultdict(list)
    for r in rows:
        of[r[1]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(of, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        of[name].sort(key=lambda x: x[:3])
        trees[name] = tree([x[2] for x in of[name]])
    root, above = tree([trees[name][0] for name in names])
    out = []
    for place, name in enumerate(names):
        subroot, paths = trees[name]
        for (_, _, own, r), path in zip(of[name], paths):
            path = path + above[place]
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            shown = leaf((*r[:4], r[4] and r[4].replace("\n", ""))) if even else own
            out.append((r[0], own, subroot, root, sha("".join(a + b for a, b in path)), fold(shown, path)))
    return out


def collocations(rows, support=30, absorbed=80, best=2000, longest=4):
    """Rows (lang, rank, phrase, a, l, r, n, score) for rows (lang, text)."""
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                counts.update((lang or "und", tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= support}
    gone = set()
    for (lang, p), a in found.items():
        inner = {(lang, p[i : i + m]) for m in range(2, len(p)) for i in range(len(p) - m + 1)}
        gone |= {x for x in inner if 100 * a >= absorbed * found[x]}
    scored = defaultdict(list)
    for (lang, p), a in found.items():
        if (lang, p) not in gone:
            score, k = min((2_000_000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k) for k in range(1, len(p)))
            scored[lang].append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return [
        (lang, rank, phrase.decode(), -a, left, right, totals[lang], -score)
        for lang, phrases in scored.items()
        for rank, (score, a, phrase, left, right) in enumerate(sorted(phrases)[:best], 1)
    ]


def simhash(text, width=4):
    w = words(lowered(text))
    parts = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def close_classes(prints, radius=4):
    prints = sorted(set(prints))
    links = [(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= radius]
    return classes(links, prints)
