"""Plain Python versions of the operators, for small inputs."""

import re
import zlib


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", lower(text))


def held(doc_id, folds, fold):
    return zlib.crc32(str(doc_id).encode()) % folds == fold


def repeats(docs, length=50):
    """(doc_id, bytes, removed ranges, kept bytes) of documents with an id."""
    home = {}
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            home[b[i:i + length]] = min(home.get(b[i:i + length], d), d)
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if home[b[i:i + length]] < d:
                gone[i:i + length] = b"\1" * length
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out.append((d, len(b), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


BENCHMARK_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def contaminated(docs, items, window=10):
    """(doc_id, words, hit words, item ids)."""
    wins = []
    for i, t in items:
        w = BENCHMARK_WORD.findall(lower(t))
        n = min(window, len(w))
        if i is not None and n:
            wins.append((str(i), n, {tuple(w[k:k + n]) for k in range(len(w) - n + 1)}))
    out = []
    for d, t in docs:
        w, hit, ids = BENCHMARK_WORD.findall(lower(t)), set(), set()
        for i, n, mine in wins:
            for p in range(len(w) - n + 1):
                if tuple(w[p:p + n]) in mine:
                    ids.add(i)
                    hit.update(range(p, p + n))
        out.append((d, len(w), len(hit), sorted(ids)))
    return out


def shingles(text, size):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i:i + size]) for i in range(len(w) - size + 1)}


def near(docs, size, percent):
    """(doc_id, set size, component)."""
    sets = {d: shingles(t, size) for d, t in docs}
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                p, q = top(a), top(b)
                up[max(p, q)] = min(p, q)
    return sorted((d, len(sets[d]), top(d)) for d in ids)


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def checksum(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d if d < 10 else d - 9
    return total % 10 == 0


def personal(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                  "card": 14 <= len(digits) <= 19 and checksum(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), m.end(), kind))
    order = list(PATTERNS)
    return sorted(out, key=lambda s: (s[0], order.index(s[2])))
