"""Plain single-threaded versions of the operators, for comparison."""

from __future__ import annotations

import hashlib
import re
import zlib

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def decontaminate(docs, items, span=10):
    wins = {}
    for item, text in items:
        w = words(text)
        n = min(span, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[i:i + n]), set()).add(item)
    sizes = {len(k) for k in wins}
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i:i + n])) in wins:
                    hit.update(range(i, i + n))
                    found |= wins[k]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = re.search(r"[/?#]|\Z", rest).start()
    return rest[:end].translate(FOLD), re.match(r"[^?#]*", rest[end:]).group()


def base_rule(host, path):
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    fits = [r for r in rules if (h := r[:r.index("/")]) and (host == h or host.endswith("." + h))
            and path.startswith(r[r.index("/"):])]
    best = max(fits, key=len, default=None)
    return best, rules.get(best)


def license_base(text):
    w, places, labels = words(text), [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i:i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)


def secrets(text):
    text = text or ""
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 32]
    joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
    n = lambda kind: sum(s[3] == kind for s in spans)
    return n("assign"), n("access"), n("hex"), hashlib.sha256(joined.encode()).hexdigest(), joined


def near_duplicates(docs):
    sets = []
    for doc, text in docs:
        w = (text or "").translate(FOLD)
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        sets.append((doc, {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    posted = {}
    for i, (_, s) in enumerate(sets):
        for g in s:
            posted.setdefault(g, []).append(i)
    seen = set()
    for members in posted.values():
        for a in range(len(members)):
            for b in range(a + 1, len(members)):
                seen.add((members[a], members[b]))
    for i, j in seen:
        (a, s), (b, t) = sets[i], sets[j]
        common = len(s & t)
        if 100 * common >= 75 * (len(s) + len(t) - common):
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    return [(d, len(s), root(d), root(d) == d) for d, s in sets]


def held_out(doc):
    return zlib.crc32(str(doc).encode()) % 5 == 0
