"""Plain brute-force versions of the operators, for small inputs."""

import hashlib
import itertools
import re
from collections import defaultdict

WS = " \t\n\x0b\x0c\r"


def fold(t):
    return t.encode().lower().decode()


def space_words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", fold(t or "")) if w]


def shingles(t, k=5):
    w = space_words(t)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def jaccard_classes(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    links = [(a, b) for (a, s), (b, u) in itertools.combinations(sets, 2) if s and u and 100 * len(s & u) >= 80 * len(s | u)]
    comp = components({i for i, _ in rows}, links)
    return sorted((i, len(s), comp[i]) for i, s in sets)


def dedup_lines(rows, min_docs=5, min_chars=40):
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            k = fold(x.strip(WS))
            if len(k) >= min_chars and i is not None:
                held[k].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(held.get(fold(x.strip(WS)), ())) < min_docs or max(held[fold(x.strip(WS))]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def best_distance(pattern, text):
    """Smallest edit distance of pattern to a substring of text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def item_words(t):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())


def contaminated(docs, items, percent=20, min_words=1):
    out = set()
    for d, t in docs:
        text = item_words(t)
        for i, it in items:
            w = item_words(it)
            if len(w) >= min_words:
                e = len(w) * percent // 100
                best = best_distance(w, text)
                if best <= e:
                    out.add((d, i, best))
    return out


def base_spans(t):
    t, out = t or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A | re.I):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", t):
        if len(m[0]) >= 20:
            out.append((m.start(), 1, "access", m.end()))
    for m in re.finditer(r"[0-9a-f]+", t):
        if len(m[0]) >= 24:
            out.append((m.start(), 2, "hex", m.end()))
    return sorted(out)


def licence_row(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t or ""))
    places, labels = [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split(" ")
        for i in range(len(w)):
            if w[i:i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))
