"""Plain Python forms of the operators, for small tables."""
from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def pii(text):
    text, out = text or "", []
    # anchored at the start of a run, to be linear; the same matches as the plain pattern
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text if "@" in text else ""):
        out.append(("email", m))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", m))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m))
    return [(k, m.start(), m.end()) for k, m in out]


SECRETS = (("assign", r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6),
           ("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]+", 24))


def secrets(text):
    out = []
    for rank, (kind, pattern, least) in enumerate(SECRETS):
        for m in re.finditer(pattern, text or ""):
            if len(m.group(2) if kind == "assign" else m[0]) >= least:
                out.append((m.start(), rank, m.end(), kind))
    return [(k, a, z) for a, _, z, k in sorted(out)]


def joined(spans):
    return ",".join(f"{k}:{a}:{z}" for k, a, z in spans)


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def contamination(docs, items, width=10):
    windows, sizes = defaultdict(set), set()
    for item, text in items:
        w = alnum_words(text)
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i:i + n])].add(item)
            sizes.add(n)
    out = []
    for doc, text in docs:
        w, hit, found = alnum_words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    found |= windows[tuple(w[i:i + n])]
                    hit.update(range(i, i + n))
        ids = sorted({str(x) for x in found if x is not None})
        out.append((doc, len(w), len(hit), len(ids), sha(",".join(ids)), bool(hit)))
    return out


def spaced_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def repeats(docs, width=35):
    words = [(d, spaced_words(t)) for d, t in docs]
    seen = Counter(tuple(w[i:i + width]) for _, w in words for i in range(len(w) - width + 1))
    out = []
    for d, w in words:
        kept, last = [], -width
        for i in range(len(w)):
            if i + width <= len(w) and seen[tuple(w[i:i + width])] > 1:
                last = i
            if i - last >= width:
                kept.append(w[i])
        out.append((d, len(w), len(w) - len(kept), sha(" ".join(kept))))
    return out


def shingles(text, n=5):
    w = spaced_words(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def components(docs, similar=85):
    rows = [(d, shingles(t)) for d, t in docs]
    sets = list(dict.fromkeys(s for _, s in rows if s))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in holders[x])
        for x in s:
            holders[x].append(i)
        for j, n in shared.items():
            if 100 * n >= similar * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    at = {s: root(i) for i, s in enumerate(sets)}
    least = {}
    for d, s in rows:
        if s and d is not None:
            least[at[s]] = min(least.get(at[s], d), d)
    return [(d, len(s), least.get(at[s]) if s else d) for d, s in rows]


def site_rates(rows, least=20):
    """Per ``(host, path, p)``: global, host and path rate without the row itself, variances from plain sums of squares."""
    def mean(x):
        return sum(x) / len(x)
    paths, hosts = {}, {}
    for h, q, p in rows:
        paths.setdefault((h, q), []).append(p)
        hosts.setdefault(h, []).append(p)
    n, all_p = len(rows), [p for *_, p in rows]
    m = mean(all_p)
    within = sum((x - mean(v)) ** 2 for v in paths.values() for x in v) / max(1, n - len(paths))
    between_paths = sum(len(v) * (mean(v) - mean(hosts[h])) ** 2 for (h, _), v in paths.items())
    between_hosts = sum(len(v) * (mean(v) - m) ** 2 for v in hosts.values())
    in_host = sum(len(v) ** 2 / len(hosts[h]) for (h, _), v in paths.items())
    squares = sum(len(v) ** 2 for v in paths.values()) / n
    path_var = max(0, (between_paths - (len(paths) - len(hosts)) * within) / (n - in_host)) if n - in_host > 1e-6 * n else 0
    free = n - sum(len(v) ** 2 for v in hosts.values()) / n
    host_var = max(0, (between_hosts - (len(hosts) - 1) * within - path_var * (in_host - squares)) / free) if free > 1e-6 * n else 0
    noise = max(0, m * (1 - m) - host_var - path_var)
    out = []
    for k, (h, q, _) in enumerate(rows):
        rest = [r for j, r in enumerate(rows) if j != k]
        whole = min(0.999, max(1e-4, mean([r[2] for r in rest]))) if rest else min(0.999, max(1e-4, m))
        mine, rate = [r for r in rest if r[0] == h], whole
        if mine and host_var >= 1e-12:
            sizes = {}
            for r in mine:
                sizes[r[1]] = sizes.get(r[1], 0) + 1
            noise_h = path_var * sum(c * c for c in sizes.values()) / len(mine) ** 2 + noise / len(mine)
            rate += min(len(mine) / (len(mine) + least), host_var / (host_var + noise_h)) * (mean([r[2] for r in mine]) - whole)
        host = rate = min(1 - 1e-6, max(1e-6, rate))
        mine = [r for r in mine if r[1] == q]
        if mine and path_var >= 1e-12:
            w = min(len(mine) / (len(mine) + least), path_var / (path_var + noise / len(mine)))
            rate += w * (mean([r[2] for r in mine]) - host)
        out.append((whole, host, min(1 - 1e-6, max(1e-6, rate))))
    return out


def longest_and_spans(text, items, width=10):
    """Longest verbatim match of at least a window, in words, and the covered intervals ``start:end``."""
    w, hit, best = alnum_words(text), set(), 0
    for _, t in items:
        v = alnum_words(t)
        n = min(width, len(v))
        for q in range(len(v) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i:i + n] == v[q:q + n]:
                    hit.update(range(i, i + n))
                    m = n
                    while q + m < len(v) and i + m < len(w) and v[q + m] == w[i + m]:
                        m += 1
                    best = max(best, m)
    starts, ends = sorted(i for i in hit if i - 1 not in hit), sorted(i + 1 for i in hit if i + 1 not in hit)
    return best, ",".join(f"{a}:{z}" for a, z in zip(starts, ends))
