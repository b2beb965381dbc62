"""Brute-force versions of the contracts, on plain Python values."""

import hashlib
import re

UPPER = {c: c + 32 for c in range(65, 91)}


def shingles(text, k=5):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(UPPER)) if x]
    if len(w) >= k:
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    return {tuple(w)} if w else set()


def jaccard_components(docs):
    """{doc_id: (n_shingles, component_id)} of (doc_id, text) rows of distinct ids."""
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def substring_dedup(docs, length=50):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256)}."""
    first, out = {}, {}
    for i, text in sorted(docs):
        b = (text or "").encode()
        for s in range(len(b) - length + 1):
            first.setdefault(b[s : s + length], i)
    for i, text in docs:
        b = (text or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < i:
                gone[s : s + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def decontamination(docs, items, width=8):
    """{doc_id: (n_words, n_hit, n_items, sha256)}."""
    windows = {}
    for item, text in items:
        w = item_words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add(str(item))
    out = {}
    for doc, text in docs:
        w, hit, found = item_words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                own = windows.get(tuple(w[i : i + size]))
                if own:
                    found |= own
                    hit |= set(range(i, i + size))
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out


def base_secrets(text):
    """(kind, start, end) of the three base patterns, as the contract words them."""
    text = text or ""
    key = r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    assign = key + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [("assign", m.start(), m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 12]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


def line_dedup(rows, min_words=5, min_line_words=3):
    """[(doc_id, n_units, removed spans, kept)] of (doc_id, text) rows, in their order."""
    norm = lambda u: re.sub(r"[ \t\n\x0b\f\r]+", " ", u.translate(UPPER)).strip(" ")
    rank, cuts = [], {}
    for doc, text in set(rows):
        if text is None:
            continue
        key, at, units = hashlib.sha256(text.encode()).digest()[:8], 0, []
        for number, line in enumerate(text.split("\n")):
            pieces = [p for p in re.split(r"(?<=[.!?])(?<!^)(?=[ \t\r\f\v])|(?<=[。！？])", line)]
            own = []
            for p in pieces:  # white space after an end belongs to the sentence before it
                space = re.match(r"[ \t\r\f\v]*", p).end() if own and re.search(r"[.!?]$", own[-1]) else 0
                if space:
                    own[-1] += p[:space]
                own.append(p[space:])
            own = [p for p in own if p] or [""]
            for p in own:
                units.append((number, p, at, at + len(p)))
                words = norm(p).split(" ") if norm(p) else []
                if len(words) >= (min_line_words if len(own) == 1 else min_words):
                    signed = int.from_bytes(key, "big", signed=True)
                    rank.append((doc is None, doc or 0, signed, len(units) - 1, norm(p), (doc, text)))
                at += len(p)
            at += 1
        cuts[doc, text] = units
    seen, gone = set(), {}
    for _, _, _, n, u, row in sorted(rank, key=lambda r: r[:4]):
        if u in seen:
            gone.setdefault(row, set()).add(n)
        seen.add(u)
    out = []
    for row in rows:
        units, drop, lines = cuts.get(row, []), gone.get(row, set()), {}
        for n, (number, p, _, _) in enumerate(units):
            lines.setdefault(number, []).extend([] if n in drop else [p])
        out.append((row[0], len(units), [units[n][2:] for n in sorted(drop)], "\n".join("".join(x) for x in lines.values() if x)))
    return out
