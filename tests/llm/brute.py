"""Plain Python versions of the operators that SQL cannot express, for small tables. rows: list of (doc_id, text)."""

import hashlib
import re


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def substring(rows, size=20):
    first, out = {}, {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        w = words(text)
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            first.setdefault(key, (doc, i))
    for doc, text in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < (doc, i):
                gone.update(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[doc] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def decontam(rows, items, size=10):
    split = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    by = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            by.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    sizes = {len(k) for k in by}
    out = {}
    for doc, text in rows:
        w, hit, found = split(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if got := by.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= got
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def shingles(text, size=3):
    w = words(lower(text))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def jaccard(rows, size=3, threshold=90):
    sets = [(doc, shingles(text, size)) for doc, text in rows]
    parent = {doc: doc for doc, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * min(len(x), len(y)) >= threshold * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= threshold * (len(x) + len(y) - both):
                    p, q = sorted((top(a), top(b)))
                    parent[q] = p
    return {doc: (len(x), top(doc)) for doc, x in sets}


def links(vectors, least=0.9):
    """vectors: list of (id, list or None)."""
    import numpy as np

    good = []
    for k, v in vectors:
        ok = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        good.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None)
    parent, n = {k: k for k, _ in vectors}, {k: 0 for k, _ in vectors}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(good):
        for j in range(i):
            b = good[j]
            if a is not None and b is not None and len(a) == len(b) and float(a @ b) >= least:
                x, y = vectors[i][0], vectors[j][0]
                n[x] += 1
                n[y] += 1
                p, q = sorted((top(x), top(y)))
                parent[q] = p
    return {k: (n[k], top(k)) for k, _ in vectors}


def language(rows, cells=1 << 16):
    """rows: (key, text, declared, host, suffix). By key the language, its posterior and the number of trigrams."""
    from collections import Counter, defaultdict
    from math import exp, log

    def grams(text):
        data = bytearray()
        for c in (text or "").encode():
            c = c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
            if c != 0x20 or not data or data[-1] != 0x20:
                data.append(c)
        code = [(data[i] << 16 | data[i + 1] << 8 | data[i + 2]) * 2654435761 % 2**32 for i in range(len(data) - 2)]
        return [c * cells >> 32 for c in code]

    spoken = sorted({r[2] for r in rows if r[2] is not None})
    counts = {k: Counter() for k in spoken}
    for _, text, said, _, _ in rows:
        if said is not None:
            counts[said].update(grams(text))
    whole = {k: sum(counts[k].values()) + 0.5 * cells for k in spoken}
    fit, guess = {}, {}
    for key, text, *_ in rows:
        g = grams(text)
        fit[key] = [sum(log((counts[k][c] + 0.5) / whole[k]) for c in g) * min(1, 40 / max(len(g), 1)) for k in spoken], len(g)
        guess[key] = max(range(len(spoken)), key=lambda i: (fit[key][0][i], -i)) if g else None
    total = Counter(v for v in guess.values() if v is not None)
    n = len(spoken)
    overall = [(total[i] + 1) / (sum(total.values()) + n) for i in range(n)]
    by = {name: defaultdict(Counter) for name in ("said", "host", "suffix")}
    above = {}
    for key, _, said, host, suffix in rows:
        if guess[key] is not None:
            for name, value in (("said", said), ("host", host), ("suffix", suffix)):
                if value is not None:
                    by[name][value][guess[key]] += 1
            if host is not None and suffix is not None:
                above[host] = max(above.get(host, suffix), suffix)

    def prior(host):
        if host not in by["host"]:
            return overall
        parent = overall
        if host in above:
            c = by["suffix"][above[host]]
            parent = [(c[i] + 50 * overall[i]) / (sum(c.values()) + 50) for i in range(n)]
        c = by["host"][host]
        return [(c[i] + 20 * parent[i]) / (sum(c.values()) + 20) for i in range(n)]

    out = {}
    for key, _, said, host, _ in rows:
        logs = [fit[key][0][i] + log(prior(host)[i]) + (log((by["said"][said][i] + 1) / (total[i] + n)) if said in by["said"] else 0) for i in range(n)]
        best = max(range(n), key=lambda i: (logs[i], -i))
        out[key] = spoken[best], 1 / sum(exp(x - logs[best]) for x in logs), fit[key][1]
    return out


def co_trained(xc, xm, given, rounds, handed, sure, held_out):
    """Scores of all rows of two views, all in memory. given: rows in order of their labels' ids, with labels; others have none."""
    import numpy as np

    def fit(x, y):
        mean, scale = x.mean(0), x.std(0)
        scale[scale < 1e-9] = 1
        z, w = np.c_[(x - mean) / scale, np.ones(len(x))], np.zeros(x.shape[1] + 1)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            w -= np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.eye(len(w)), z.T @ (p - y) + w)
        return lambda x: np.clip(np.c_[(x - mean) / scale, np.ones(len(x))] @ w, -30, 30)

    rows, y = np.array([r for r, _ in given]), np.array([v for _, v in given], float)
    held = np.random.default_rng(0).random(len(y)) < held_out
    views, known = (xc, xm), rows[~held]
    free = np.ones(len(xc), bool)
    free[rows] = False
    n_free, pseudo = free.sum(), [{}, {}]
    models = [fit(x[known], y[~held]) for x in views]
    for _ in range(rounds):
        picks = []
        for model, x in zip(models, views):
            at = np.flatnonzero(free)
            m = model(x[at])
            size = np.minimum(np.floor(np.abs(m) * 4096 / 30), 4095)  # ties, also of neighbours within a bin, are handed on together
            sure_ones = np.abs(m) > sure
            last = np.sort(size[sure_ones])[::-1][: int(np.ceil(handed * n_free))]
            picks.append({int(at[i]): float(m[i] > 0) for i in np.flatnonzero(sure_ones & (size >= (last[-1] if len(last) else 0)))})
        if not any(picks):
            break
        for k in (0, 1):
            pseudo[1 - k].update(picks[k])
        free[[i for p in picks for i in p]] = False
        models = [fit(np.r_[x[known], x[list(p)]], np.r_[y[~held], list(p.values())]) for x, p in zip(views, pseudo)]
    scaled = [fit(model(x[rows[held]])[:, None], y[held]) for model, x in zip(models, views)]
    both = np.c_[[s(m(x)[:, None]) for s, m, x in zip(scaled, models, views)]].T
    return 1 / (1 + np.exp(-fit(both[rows[held]], y[held])(both)))
