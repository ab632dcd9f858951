"""Plain Python versions of the operators' contracts."""

import re
from collections import defaultdict

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    return frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i:i + n]) for i in range(len(w) - n + 1)])


def components(rows):
    """{row number: least doc_id reachable} for (doc_id, text) rows."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                up[find(a)] = find(b)
    low = defaultdict(lambda: None)
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        low[r] = doc if low[r] is None else min(low[r], doc) if doc is not None else low[r]
    return [len(s) for s in sets], [low[find(i)] for i in range(len(rows))]


def n_links(rows):
    """How many other rows each (doc_id, text) row links with."""
    sets = [shingles(t) for _, t in rows]
    return [sum(a != b and bool(x & y) and 100 * len(x & y) >= 85 * len(x | y) for b, y in enumerate(sets)) for a, x in enumerate(sets)]


def words13(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))


def contamination(text, items, n=13):
    w, hit, names = words13(text), set(), set()
    for name, item in items:
        b = words13(item)
        m = min(n, len(b))
        for i in range(len(b) - m + 1 if m else 0):
            for j in range(len(w) - m + 1):
                if w[j:j + m] == b[i:i + m]:
                    hit |= set(range(j, j + m))
                    names.add(str(name))
    return len(w), len(hit), sorted(names)


BASE = {"assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
        "access": (r"AKIA[A-Z0-9]+", 0, 16), "hex": (r"[0-9a-f]+", 0, 32)}


def base_spans(text):
    out = [(m.start(), i, k, m.end()) for i, (k, (p, g, least)) in enumerate(BASE.items()) for m in re.finditer(p, text or "", re.A) if len(m[g]) >= least]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


def redacted(text, spans, mark="<secret>"):
    out, done = "", 0
    for _, s, e in sorted(spans, key=lambda x: x[1]):
        if s >= done:
            out += text[done:s] + mark
        done = max(done, e)
    return out + text[done:]


def patience(a, b):
    """Patience alignment written recursively: number of matched words and their range in b."""
    def lis(js):
        best = [[j] for j in js]
        for k in range(len(js)):
            for m in range(k):
                if js[m] < js[k] and len(best[m]) + 1 > len(best[k]):
                    best[k] = best[m] + [js[k]]
        return max(best, key=len, default=[])

    def go(a, b, off):
        both = [w for w in a if a.count(w) == 1 and b.count(w) == 1]
        chain = lis([b.index(w) for w in both])
        if chain:
            out, i, j = [], 0, 0
            for y in chain:
                x = a.index(b[y])
                out += go(a[i:x], b[j:y], off + j) + [off + y]
                i, j = x + 1, y + 1
            return out + go(a[i:], b[j:], off + j)
        head = tail = 0
        while head < min(len(a), len(b)) and a[head] == b[head]:
            head += 1
        while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
            tail += 1
        return [off + k for k in range(head)] + [off + len(b) - 1 - k for k in range(tail)][::-1]
    return go(a, b, 0)
