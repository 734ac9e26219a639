"""Plain versions of the operators, for small inputs."""

import collections
import hashlib
import math
import re
import zlib

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def spaced(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def base_spans(text):
    t = text or ""
    pattern = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    spans = [(m.start(), 0, m.end()) for m in re.finditer(pattern, t, re.I | re.A) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(spans)


def substring(rows, size=50):
    """rows: (doc_id, text), ids may repeat; null is larger than all."""
    key = lambda i: math.inf if i is None else i
    first = {}
    for i, t in rows:
        w = spaced(t)
        for p in range(len(w) - size + 1):
            g = tuple(w[p : p + size])
            first[g] = min(first.get(g, math.inf), key(i))
    out = []
    for i, t in rows:
        w = spaced(t)
        gone = set()
        for p in range(len(w) - size + 1):
            if first[tuple(w[p : p + size])] < key(i):
                gone.update(range(p, p + size))
        out.append((i, len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone))))
    return out


def lines(rows, run=2):
    key = lambda i: math.inf if i is None else i
    texts = sorted({(key(i), t) for i, t in rows if t is not None}, key=lambda x: (x[0], x[1]))
    least = {}
    for i, t in texts:
        least.setdefault(t, i)
    seen = {}
    for t, i in least.items():
        x = t.split("\n")
        for p in range(len(x) - run + 1):
            g = tuple(x[p : p + run])
            seen.setdefault(g, []).append((i, t, p))
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, 0, 0, None))
            continue
        x = t.split("\n")
        gone = set()
        if key(i) > least[t] and len(x) >= run:
            gone = set(range(len(x)))
        else:
            for p in range(len(x) - run + 1):
                # among texts of one id the order is that of hashes, so tests use distinct ids
                if min(y[0:1] + y[2:] for y in seen[tuple(x[p : p + run])]) < (least[t], p):
                    gone.update(range(p, p + run))
        out.append((i, len(x), len(gone), sha("\n".join(y for p, y in enumerate(x) if p not in gone))))
    return out


def contaminated(rows, items, size=10):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    windows = collections.defaultdict(set)
    for item, t in items:
        w = words(t)
        n = min(size, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[p : p + n])].add("" if item is None else str(item))
    sizes = {len(g) for g in windows}
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                g = tuple(w[p : p + n])
                if g in windows:
                    hit.update(range(p, p + n))
                    found |= windows[g]
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def quality(text):
    w, t = spaced(text), text or ""
    count = collections.Counter(tuple(w[p : p + 8]) for p in range(len(w) - 7))
    again = {q for p in range(len(w) - 7) if count[tuple(w[p : p + 8])] > 1 for q in range(p, p + 8)}
    full = [x for x in t.split("\n") if spaced(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(full) - len(set(full)), len(again)


def good(text, q):
    """Whether no quality rule rejects; q has the thresholds."""
    n, chars, symbols, dup, again = quality(text)
    full = [x for x in (text or "").split("\n") if spaced(x)]
    letters = sum(bool(re.search("[A-Za-z\x80-\U0010ffff]", w)) for w in spaced(text))
    broken = sum(x.rstrip(" \t\n\x0b\x0c\r").endswith(("...", "\u2026")) for x in full)
    return not (
        n < q.MIN_WORDS or 100 * again > q.MAX_REPEAT_PERCENT * n or symbols > q.MAX_SYMBOLS_PER_WORD * n or dup > q.MAX_DUP_LINE_SHARE * len(full)
        or not q.MIN_MEAN_WORD * n <= chars <= q.MAX_MEAN_WORD * n or 100 * letters < q.MIN_LETTER_PERCENT * n or 100 * broken > q.MAX_ELLIPSIS_PERCENT * len(full)
    )


def components(rows, n=4, percent=85):
    """rows with distinct ids: (doc_id, size, component, links)."""
    sets = []
    for i, t in rows:
        w = spaced((t or "").translate(LOWER))
        sets.append((i, {tuple(w[p : p + n]) for p in range(len(w) - n + 1)} or ({tuple(w)} if w else set())))
    up, links = {i: i for i, _ in sets}, collections.Counter()

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for x in range(len(sets)):
        for y in range(x):
            (i, a), (j, b) = sets[x], sets[y]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                links[i] += 1
                links[j] += 1
                r, s = sorted((root(i), root(j)))
                up[s] = r
    least = {}
    for i in up:
        least[root(i)] = min(least.get(root(i), i), i)
    return [(i, len(a), least[root(i)], links[i]) for i, a in sets]


def unigram(rows):
    tokens = lambda t: [*spaced((t or "").translate(LOWER)), None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = collections.Counter(x for i, t in rows if not held(i) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(t))) for i, t in rows]
