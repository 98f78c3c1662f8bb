"""Plain versions of the corpus operators, for small inputs: rows are (doc_id, text or None)."""

import hashlib
import math
import re
from collections import Counter

BLANK = "\x20\x09-\x0d"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def repeated_strings(rows, width=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - width + 1):
            k = b[p : p + width]
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if first[b[p : p + width]] < d:
                gone[p : p + width] = b"\x01" * width
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out[d] = (len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone) if not g)))
    return out


def chunks(data, gear, shortest=20, bits=4, longest=128, window=24):
    """Content-defined chunks, byte by byte: gear[b] is the random word of a byte."""
    mask = (1 << 64) - 1

    def cut_here(end):
        h = 0
        for b in data[end - window : end]:
            h = ((h << 1) + gear[b]) & mask
        for _ in range(2):
            h = ((h ^ (h >> 32)) * 0xD6E8FEB86659FD93) & mask
        return (h ^ (h >> 32)) >> (64 - bits) == 0

    out, last = [], 0
    for end in range(1, len(data) + 1):
        size = end - last
        if len(data) > max(shortest, window) and (size == longest and end < len(data) or size >= shortest and end >= window and cut_here(end)):
            out.append(data[last:end])
            last = end
    rest = data[last:]
    if rest and out and len(rest) < shortest:
        out[-1] += rest
    elif rest:
        out.append(rest)
    return out


def duplicate_chunks(rows, gear):
    """doc -> (bytes, removed, spans, digest of the rest): chunks that a document of smaller id has, too, go."""
    cut = [(d, chunks((t or "").encode(), gear)) for d, t in rows]
    first = {}
    for d, cs in cut:
        for c in cs:
            first[c] = min(first.get(c, d), d)
    out = {}
    for d, cs in cut:
        gone = [first[c] < d for c in cs]
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (sum(map(len, cs)), sum(len(c) for c, g in zip(cs, gone) if g), runs, sha(b"".join(c for c, g in zip(cs, gone) if not g)))
    return out


def binomial_cdf(k, n, p):
    return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log(1 - p)) for j in range(k + 1))


def cutoffs(held, steps, alpha, delta, strata):
    """(stratum, rule) -> cutoff. held: rows (stratum, good, holdout, statistics by rule); steps: (rule, level, cutoff), loose ones first in each rule."""
    out = {}
    for s in {r[0] for r in held}:
        own = [r for r in held if r[0] == s]
        plan = [r for r in own if not r[2]]
        over = lambda r, step: (r[3][step[0]] or 0) > step[2]
        good = [r for r in plan if r[1]]
        order = []
        for i, step in enumerate(steps):
            g = sum(over(r, step) for r in good)
            looser = sum(not r[1] and over(r, steps[i - 1]) for r in plan) if step[1] else 0
            gain = sum(not r[1] and over(r, step) for r in plan) - looser
            if gain > 0 and g <= alpha / 5 * len(good):
                order.append((g, step[1], -gain, i))
        test = [r for r in own if r[2] and r[1]]
        taken = []
        for *_, i in sorted(order):
            k = sum(any(over(r, steps[j]) for j in [*taken, i]) for r in test)
            if not (k < alpha * len(test) and binomial_cdf(k, len(test), alpha) <= delta / strata):
                break
            taken.append(i)
        for i in taken:
            rule, _, c = steps[i]
            out[s, rule] = min(c, out.get((s, rule), c))
    return out


def rule_statistics(text):
    t = text or ""
    words = re.findall(f"[^{BLANK}]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(f"[^{BLANK}]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(grams)
    hit = {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(5)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(hit), n < 10 or 100 * len(hit) > 20 * n


def secret_spans(text):
    t = text or ""
    out = []
    a = [m for m in re.finditer(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[1]) >= 6 and all(ord(c) < 128 for c in m[0])]
    b = [m for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    c = [m for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    for k, ms in enumerate((a, b, c)):
        out += [(m.start(), k, m.end()) for m in ms]
    names = ("assign", "access", "hex")
    return len(a), len(b), len(c), sha(",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(out)))


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x // 10 + x % 10
    return total % 10 == 0


def personal_spans(text):
    t = text or ""
    dig = lambda s: re.sub("[^0-9]", "", s)
    found = [
        list(re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)),
        [m for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))],
        [m for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(dig(m[0])) <= 19 and luhn(dig(m[0]))],
        [m for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(dig(m[0])) <= 15],
    ]
    return *map(len, found), sha(",".join(f"{k}:{m.start()}:{m.end()}" for k, ms in zip(("email", "ip", "card", "phone"), found) for m in ms))


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingle_sets(rows, k):
    out = []
    for d, t in rows:
        w = re.findall(f"[^{BLANK}]+", lowered(t))
        out.append((d, {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()))
    return out


def components(rows, k=4, percent=85):
    sets = shingle_sets(rows, k)
    parent = {d: d for d, _ in rows}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    index = {}
    for i, (_, s) in enumerate(sets):
        for g in s:
            index.setdefault(g, []).append(i)
    for i, (d, s) in enumerate(sets):
        for j, both in Counter(j for g in s for j in index[g] if j < i).items():
            if 100 * both >= percent * (len(s) + len(sets[j][1]) - both):
                a, b = root(d), root(sets[j][0])
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), root(d)) for d, s in sets}


def contamination(rows, items, size=10):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = {}
    for item, t in items:
        w = word.findall(lowered(t))
        for p in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[p : p + size]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for d, t in rows:
        w, hit, found = word.findall(lowered(t)), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                got = windows.get(tuple(w[p : p + n]))
                if got:
                    hit.update(range(p, p + n))
                    found |= got
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out
