"""Plain Python versions of the contracts, for small tables."""

from __future__ import annotations

import hashlib
import re

PII = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def _luhn(d: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def pii_base(text: str | None) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in PII.items():
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": lambda: True,
                  "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                  "card": lambda: 16 <= len(digits) <= 19 and _luhn(digits),
                  "phone": lambda: 8 <= len(digits) <= 15}[kind]()
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def pii_row(text: str | None) -> tuple:
    spans = pii_base(text)
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    return (*[sum(s[0] == k for s in spans) for k in PII], hashlib.sha256(joined.encode()).hexdigest())


def _repeats(seqs: list, window: int) -> list[list[bool]]:
    """Which units lie in a window that starts more than once anywhere."""
    from collections import Counter

    count = Counter(s[i:i + window] for s in seqs for i in range(len(s) - window + 1))
    out = []
    for s in seqs:
        gone = [False] * len(s)
        last = -1
        for i in range(len(s) - window + 1):
            if count[s[i:i + window]] > 1:
                for j in range(max(i, last), i + window):
                    gone[j] = True
                last = i + window
        out.append(gone)
    return out


def suffix_rows(texts: list[str | None], length: int = 400) -> list[tuple]:
    raws = [(t or "").encode() for t in texts]
    out = []
    for raw, gone in zip(raws, _repeats(raws, length)):
        rest = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(g and not p for p, g in zip([False, *gone], gone))
        out.append((len(raw), sum(gone), runs, hashlib.sha256(rest).hexdigest()))
    return out


def substring_rows(texts: list[str | None], window: int = 35) -> list[tuple]:
    seqs = [tuple((t or "").encode().split()) for t in texts]
    out = []
    for words, gone in zip(seqs, _repeats(seqs, window)):
        rest = [w for w, g in zip(words, gone) if not g]
        out.append((len(words), sum(gone), hashlib.sha256(b" ".join(rest)).hexdigest()))
    return out


def jaccard_rows(ids: list[int], texts: list[str | None], percent: int = 80) -> list[tuple]:
    """(n_shingles, component_id): all pairs that share a shingle, then union-find."""
    from collections import defaultdict

    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    both = defaultdict(int)
    for hs in holders.values():
        for k, i in enumerate(hs):
            for j in hs[k + 1:]:
                both[i, j] += 1
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for (i, j), n in both.items():
        if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b, key=lambda k: ids[k])] = min(a, b, key=lambda k: ids[k])
    return [(len(s), ids[root(i)]) for i, s in enumerate(sets)]
