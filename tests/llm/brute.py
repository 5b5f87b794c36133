"""Plain statements of what the operators must return, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")


def normal(text):
    return "".join(c for c in text or "" if c not in SPACE)


def exact(rows):
    """rows: (doc_id, text). Returns doc_id -> (keep_id, group_size, kept, sha)."""
    groups = defaultdict(list)
    for d, t in rows:
        groups[normal(t)].append((-len(t or ""), d))
    return {
        d: (min(groups[normal(t)])[1], len(groups[normal(t)]), min(groups[normal(t)])[1] == d, hashlib.sha256(normal(t).encode()).hexdigest()) for d, t in rows
    }


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def personal(text):
    """Base spans (kind, start, end) in order."""
    text = text or ""
    found = [("email", m) for m in EMAIL.finditer(text)]
    found += [("ip", m) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m))
    found += [("phone", m) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    order = ("email", "ip", "card", "phone")
    return sorted(((k, m.start(), m.end()) for k, m in found), key=lambda s: (s[1], order.index(s[0])))


def shingle_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def near(rows):
    """doc_id -> (set size, component). Pairs come from an index of all shingles."""
    sets = {d: shingle_set(t) for d, t in rows}
    index = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            index[x].append(d)
    common = Counter()
    for members in index.values():
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                common[a, b] += 1
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


def base_quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {p for places in windows.values() if len(places) > 1 for i in places for p in range(i, i + 8)}
    n, repeated = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeated, n < 20 or 100 * repeated > 30 * n


def repeated_bytes(rows, length=100):
    """doc_id -> (bytes, removed, runs, sha of the rest)."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            else:
                seen.add(s)
        runs = len(re.findall(b"\1+", bytes(gone)))
        out[d] = (len(raw), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    return out


def targets(sizes, weights=(3, 1, 2), share=Fraction(3, 2), cap=2):
    """sizes: source -> words. The targets by repeated resharing."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    out, left, open_ = {}, share * sum(sizes.values()), set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total >= cap * sizes[s]}
        if not over:
            return out | {s: float(left * weight[s] / total) for s in open_}
        for s in over:
            out[s] = float(cap * sizes[s])
            left -= cap * sizes[s]
        open_ -= over
    return out


def words(text):
    return len(WORD.findall(text or ""))


def crc(text):
    return zlib.crc32((text or "").encode())
