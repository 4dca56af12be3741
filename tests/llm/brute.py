"""Plain, slow versions of the operators, one row at a time."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import Counter

from xxhash import xxh64_intdigest

SPACE = r"[\x20\x09-\x0D]+"


def words(text):
    return [w for w in re.split(SPACE, text or "") if w]


def features(text):
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def secrets(text):
    """(kind, start, end) of the base patterns, by start, then kind."""
    text, out = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def simhash(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = words(lowered)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components(fps):
    """fps: list of (doc_id, fingerprint). Smallest id reachable, per entry."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(fps)), 2):
        if (fps[a][1] ^ fps[b][1]).bit_count() <= 3:
            root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for i, (d, _) in enumerate(fps):
        least.setdefault(find(i), []).append(d)
    return [min((d for d in least[find(i)] if d is not None), default=None) for i in range(len(fps))]


def dedup_lines(docs):
    """docs: {id: text}. New texts, in which later repeated runs of three lines with a word are cut."""
    seen, out = set(), {}
    for d in sorted(docs):
        lines = (docs[d] or "").split("\n")
        where = [i for i, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
        own = [lines[i].strip(" \t\n\x0b\x0c\r") for i in where]
        gone = set()
        for i in range(len(own) - 2):
            key = tuple(own[i : i + 3])
            if key in seen:
                gone |= set(where[i : i + 3])
            seen.add(key)
        out[d] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def dedup_bytes(docs, length=100):
    """docs: {id: text}. Kept bytes and number of removed runs."""
    seen, out = set(), {}
    for d in sorted(docs):
        data = (docs[d] or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            else:
                seen.add(w)
        out[d] = bytes(b for b, g in zip(data, gone) if not g), len(re.findall(b"\1+", gone))
    return out


def leaks(docs, items, least=0.8):
    """Pairs (doc, item) where some item-sized window is similar enough by weighted 5-word shingles; every window is tried."""

    def shingles(text):
        w = words((text or "").lower())
        return [tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(1, len(w))))]

    def weight(bag):
        return sum(n * sum(map(len, s)) for s, n in bag.items())

    out = set()
    for d, text in docs.items():
        own = shingles(text)
        for k, item in items.items():
            want = Counter(shingles(item))
            n = sum(want.values())
            if n and set(own) & set(want):
                for i in range(max(1, len(own) - n + 1)):
                    got = Counter(own[i : i + n])
                    if weight(got & want) >= least * weight(got | want):
                        out.add((d, k))
                        break
    return out


def jaccard_components(docs):
    """docs: {id: text}. Shingles and smallest id reachable over links of 80 % Jaccard similarity; every pair is compared."""
    sets = {}
    for d, t in docs.items():
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(docs), 2):
        x, y = sets[a], sets[b]
        if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in docs}


def infill(doc_id, text):
    """n, form, prefix_chars, middle_chars and output of one document."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    h = [int(hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def plant(doc_id, w):
    """The words of a document with the contract's stretch of repeats."""
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def runs(w):
    """Runs (start, length, period) of a list of words, by start, then period: each lag is walked from end to end, least lags first."""
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, own):
    gone = {i for a, n, q in own for i in range(a + q, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)
