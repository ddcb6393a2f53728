"""Plain versions of the operators, a row at a time."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def fingerprint(text):
    w = WORD.findall((text or "").translate(LOW))
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, fps, most=3):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = find(i), find(j)
                root[max(a, b, key=lambda k: ids[k])] = min(a, b, key=lambda k: ids[k])
    return [ids[find(i)] for i in range(len(ids))]


def statistics(text):
    w, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    count, inside = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if count[tuple(w[i : i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(number):
    return sum(x - 9 if (x := int(c) * (1 + i % 2)) > 9 else x for i, c in enumerate(reversed(number))) % 10 == 0


def personal(text):
    out = []
    for rank, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 12 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 9 <= len(d) <= 15):
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def deduped(rows, size=20):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    at = lambda i, s: ((i is None, i or 0), s)
    first = {}
    for i, w in words:
        for s in range(len(w) - size + 1):
            k = tuple(w[s : s + size])
            first[k] = min(first.get(k, at(i, s)), at(i, s))
    out = []
    for i, w in words:
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - size + 1):
            if first[tuple(w[s : s + size])] < at(i, s):
                gone[s : s + size] = True
        out.append((i, len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


def contamination(rows, items, size=13):
    terms = lambda t: TERM.findall((t or "").translate(LOW))
    windows = {}
    for key, t in items:
        w = terms(t)
        for s in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[s : s + size]), set()).add(key)
    out = []
    for i, t in rows:
        w, hit, found = terms(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def records(rows):
    lowest = -(1 << 63)
    rows = [(lowest if i is None else i, i, (h or "").encode()) for i, h in rows]
    last = {}
    for k, _, b in rows:
        last[b] = max(last.get(b, lowest), k)
    out = []
    for k, i, b in rows:
        again = len(b) >= 1000 and k != last[b]
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", last[b] if again else None))
    return out


def boosted(rows, sizes, rounds, rate, ridge):
    """Gradient boosting of two-level trees, an example at a time; returns the margin of a row."""
    examples = [(r, y) for r in rows for y in [1] * r["positive"] + [0] * (r["n"] - r["positive"])]
    hits = sum(y for _, y in examples)
    bias = float(np.log((hits + 0.5) / (len(examples) - hits + 0.5)))
    trees = []

    def score(r):
        total = bias
        for f, c, sides in trees:
            f2, c2, low, high = sides[r[f] >= c]
            total += low if r[f2] < c2 else high
        return total

    def split(own):
        best = None
        for f, k in sizes.items():
            for c in range(1, k):
                leaves, gain = [], 0.0
                for side in (False, True):
                    p = [(y, 1 / (1 + np.exp(-score(r)))) for r, y in own if (r[f] >= c) == side]
                    g, h = sum(y - q for y, q in p), sum(q * (1 - q) for _, q in p)
                    leaves.append(rate * g / (h + ridge))
                    gain += g * g / (h + ridge)
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, f, c, *leaves)
        return best[1:]

    for _ in range(rounds):
        f, c, _, _ = split(examples)
        sides = [split([x for x in examples if (x[0][f] >= c) == side]) if any((x[0][f] >= c) == side for x in examples) else (f, 1, 0.0, 0.0) for side in (False, True)]
        trees.append((f, c, sides))
    return score


def least_determinant(x, target, rules):
    """The least log determinant of the regularised scatter of three quarters of the rows, over all subsets, and the rows within the
    cut of that estimate."""
    h, best = math.ceil(rules.COVER * len(x)), None
    for own in combinations(range(len(x)), h):
        y = x[list(own)]
        mixed = rules.regular((h * np.cov(y.T, bias=True) * rules.CONSISTENT + rules.WIDER * target) / (h + rules.WIDER))
        log_det = np.linalg.slogdet(mixed)[1]
        if best is None or log_det < best[0]:
            best = (log_det, y.mean(axis=0), mixed)
    log_det, centre, mixed = best
    d = [float((r - centre) @ np.linalg.inv(mixed) @ (r - centre)) for r in x]
    return log_det, {i for i, v in enumerate(d) if v <= rules.CUT / 2}


def attention(model, text):
    """Score of a text by gated attention, a passage at a time."""
    p, found = model.weights, []
    from packetlens.llm import mil

    for row in mil.bag(text):
        x = (row - model.mean) / model.scale
        h = [math.tanh(sum(x[i] * p["w1"][i][k] for i in range(len(x))) + p["b1"][k]) for k in range(mil.HIDDEN)]
        e = sum(p["a"][g] * math.tanh(sum(h[k] * p["v"][k][g] for k in range(mil.HIDDEN))) / (1 + math.exp(-sum(h[k] * p["u"][k][g] for k in range(mil.HIDDEN)))) for g in range(mil.GATE))
        found.append((e, h))
    total = sum(math.exp(e) for e, _ in found)
    z = [sum(math.exp(e) / total * h[k] for e, h in found) for k in range(mil.HIDDEN)]
    return 1 / (1 + math.exp(-(sum(z[k] * p["c"][k] for k in range(mil.HIDDEN)) + p["d"])))


def languages(rows, langid):
    """(language, probability) of each document by naive Bayes, from dictionaries of counts."""
    n, docs = {}, Counter()
    for i, t, lang in rows:
        if lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            docs[lang] += 1
            n.setdefault(lang, Counter()).update(langid.buckets(t or "").tolist())
    total = {k: sum(c.values()) + langid.SMOOTHING * langid.BUCKETS for k, c in n.items()}
    out = {}
    for i, t, _ in rows:
        if not any(map(str.isalpha, t or "")):
            out[i] = ("und", 0.0)
            continue
        own = Counter(langid.buckets(t).tolist())
        logs = {k: math.log(docs[k] / sum(docs.values())) + sum(m * math.log((c[b] + langid.SMOOTHING) / total[k]) for b, m in own.items()) for k, c in sorted(n.items())}
        top = max(logs.values())
        best = next(k for k, v in logs.items() if v == top)
        out[i] = (best, 1 / sum(math.exp(v - top) for v in logs.values()))
    return out
