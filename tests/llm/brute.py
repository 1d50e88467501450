"""Plain restatements of the operators' contracts on lists of rows, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

LATE = (1 << 63) - 1


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def windows_removed(rows, window=50):
    """(id, n_words, n_removed, sha) of (id, text) rows."""
    first = {}
    for key, text in rows:
        own = words(text)
        for i in range(len(own) - window + 1):
            w = tuple(own[i : i + window])
            first[w] = min(first.get(w, LATE), LATE if key is None else key)
    out = []
    for key, text in rows:
        own, gone = words(text), set()
        for i in range(len(own) - window + 1):
            if first[tuple(own[i : i + window])] < (LATE if key is None else key):
                gone.update(range(i, i + window))
        out.append((key, len(own), len(gone), sha(" ".join(w for i, w in enumerate(own) if i not in gone))))
    return out


def id_rows(rows, encode, end):
    """(id, start, n_tokens, crc) of (id, text) rows with different ids, nulls first."""
    out, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*encode(text or ""), end]
        out.append((key, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def fitting_rule(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (lower(m[1]), m[2]) if m else ("", "")
    fit = []
    for place, verdict in rules:
        name, rest = place.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fit.append((len(place), place, verdict))
    return host, path, *(max(fit)[1:] if fit else (None, None))


def shingle_set(text, width):
    own = words(lower(text))
    n = min(width, len(own))
    return {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()


def components(rows, width, percent):
    """{id: (n_shingles, component)} of rows with different ids."""
    sets = {key: shingle_set(text, width) for key, text in rows}
    root = {key: key for key in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    at = defaultdict(list)
    for key, own in sets.items():
        for s in own:
            at[s].append(key)
    for key, own in sets.items():
        for other, common in Counter(o for s in own for o in at[s] if o < key).items():
            if 100 * common >= percent * (len(own) + len(sets[other]) - common):
                a, b = find(key), find(other)
                root[max(a, b)] = min(a, b)
    return {key: (len(own), find(key)) for key, own in sets.items()}


def quality_counts(text):
    text = text or ""
    own = words(text)
    lines = [line for line in text.split("\n") if words(line)]
    grams = [tuple(own[i : i + 3]) for i in range(len(own) - 2)]
    often, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            covered.update((i, i + 1, i + 2))
    failed = len(own) < 50 or 100 * len(covered) > 50 * len(own)
    return len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def best_path(word, scores, worst):
    """Tokens of the best segmentation of one pre-token."""
    text, longest = "\u2581" + word, max(map(len, scores))
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        size = len(text[end - 1].encode())
        here = (best[-1][0] + size * worst, best[-1][1] + size)
        for start in range(max(0, end - longest), end):
            if text[start:end] in scores:
                other = (best[start][0] + scores[text[start:end]], best[start][1] + 1)
                if other[0] > here[0] or other[0] == here[0] and other[1] < here[1]:
                    here = other
        best.append(here)
    return best[-1][1]


_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def contamination(rows, items, window=13):
    """(id, n_words, n_hit, items) of (id, text) rows."""
    cut = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    wanted = defaultdict(set)
    for item, text in items:
        own = cut(text)
        for i in range(max(min(1, len(own)), len(own) - window + 1)):
            wanted[tuple(own[i : i + window])].add(str(item))
    sizes, out = {len(w) for w in wanted}, []
    for key, text in rows:
        own, hit, found = cut(text), set(), set()
        for size in sizes:
            for i in range(len(own) - size + 1):
                if (w := tuple(own[i : i + size])) in wanted:
                    hit.update(range(i, i + size))
                    found |= wanted[w]
        out.append((key, len(own), len(hit), sorted(found)))
    return out
