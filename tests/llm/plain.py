"""Plain versions of the operators, over Python rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from fractions import Fraction  # noqa: F401

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, lower=lambda t: t.translate(UPPER)):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def near_duplicates(docs, percent=80):
    """{doc_id: (set size, smallest linked id)} of unique ids."""
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def dedup_lines(docs):
    """{doc_id: (text, lines, removed)} of unique ids without nulls."""
    first = {}
    gone = defaultdict(set)
    for d, t in sorted(docs):
        lines = t.split("\n")
        for p in range(len(lines) - 2):
            if first.setdefault(tuple(lines[p : p + 3]), (d, p)) != (d, p):
                gone[d] |= {p, p + 1, p + 2}
    out = {}
    for d, t in docs:
        lines = t.split("\n")
        kept = [line for i, line in enumerate(lines) if i not in gone[d]]
        out[d] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def leaks(docs, items):
    out = {}
    for i, item in items:
        own = shingles(item, str.lower)
        for d, t in docs:
            both = len(own & shingles(t, str.lower))
            if own and 10 * both >= 8 * len(own):
                out[d, i] = both
    return out


BASE = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
)


def is_personal(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(part) <= 255 for part in value.split("."))
    if kind == "card":
        doubled = (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def base_spans(text):
    return [
        (kind, m.start(), m.end())
        for kind, pattern in BASE
        for m in pattern.finditer(text or "")
        if is_personal(kind, m.group())
    ]


def periodic_runs(ws):
    """(start, length, period), by start and period: each period's longest equal stretches."""
    out = {}
    for q in range(1, len(ws) // 3 + 1):
        k = 0
        while k < len(ws) - q:
            low = k
            while k < len(ws) - q and ws[k] == ws[k + q]:
                k += 1
            if k - low + q >= max(24, 3 * q):
                out.setdefault((low, k - low + q), q)
            k += 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def rebuilt(rows):
    """{conv_id: turns} whose first turns are those of the conversation that begins its hundred."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def prefix_trie(conversations):
    """Rows of every distinct prefix of the conversations {conv_id: turns}."""
    of = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            of[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for prefix in of:
        if prefix:
            children[prefix[:-1]].append(prefix)
    leaves, saved = {}, {}
    for prefix in sorted(of, key=len, reverse=True):
        below = children[prefix]
        leaves[prefix] = sum(leaves[b] for b in below) or 1
        own = (len(of[prefix]) - 1) * len(prefix[-1][1]) if prefix else 0
        saved[prefix] = own + sum(saved[b] for b in below)
    return sorted(
        (
            min(cs), len(p), min(of[p[:-1]]) if p else None, len(cs), len(children[p]), leaves[p], saved[p],
            hashlib.sha256(",".join(str(c) for c in sorted(cs) if len(conversations[c]) == len(p)).encode()).hexdigest(),
        )
        for p, cs in of.items()
    )
