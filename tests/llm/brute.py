"""Plain definitions of what the operators return, for small tables."""

import hashlib
import re
import zlib
from array import array


def luhn(d):
    return sum(n if k % 2 == 0 else n * 2 - 9 * (n > 4) for k, n in enumerate(map(int, reversed(d)))) % 10 == 0


def pii(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, *m.span()))
    return sorted(out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15])


def secrets(t):
    word = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    names = "|".join([word("password"), word("passwd"), word("secret"), word("token"), word("api") + "_?" + word("key")])
    out = [(*m.span(), 0) for m in re.finditer(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 8]
    out += [(*m.span(), 1) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return sorted(out + [(*m.span(), 2) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32], key=lambda s: (s[0], s[2]))


def repeated_bytes(docs, depth=100):
    """doc_id: (n_bytes, n_removed, n_spans, sha256) by direct search."""
    seen, out = set(), {}
    for d, t in sorted(docs.items()):
        b = (t or "").encode()
        mark = bytearray(len(b))
        for p in range(len(b) - depth + 1):
            w = b[p : p + depth]
            if w in seen:
                mark[p : p + depth] = b"\1" * depth
            seen.add(w)
        kept = bytes(x for x, m in zip(b, mark) if not m)
        out[d] = (len(b), sum(mark), sum(m and (k == 0 or not mark[k - 1]) for k, m in enumerate(mark)), hashlib.sha256(kept).hexdigest())
    return out


def simhash(t):
    import xxhash

    w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in ([w[k : k + 4] for k in range(len(w) - 3)] or [w])]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(prints):
    """doc_id: smallest doc_id reachable over links of 4 bits."""
    best = {d: d for d in prints}
    moved = True
    while moved:
        moved = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 4 and best[b] < best[a]:
                    best[a], moved = best[b], True
    return best


def words6(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def contamination(docs, bench):
    win = {}
    for i, t in bench.items():
        w = words6(t)
        for k in range(max(1, len(w) - 7) if w else 0):
            win.setdefault(tuple(w[k : k + 8]), set()).add(i)
    out = {}
    for d, t in docs.items():
        w, hit, items = words6(t), set(), set()
        for n in {len(x) for x in win}:
            for k in range(len(w) - n + 1):
                if own := win.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    items |= own
        out[d] = (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), len(items) >= 2)
    return out


def quality(t):
    ws = [x for x in re.split("[\x20\x09-\x0d]+", t or "") if x]
    lines = [x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    at = {}
    for k in range(len(ws) - 4):
        at.setdefault(tuple(ws[k : k + 5]), []).append(k)
    rep = {k + j for ks in at.values() if len(ks) > 1 for k in ks for j in range(5)}
    failed = len(ws) < 10 or 100 * len(rep) > 20 * len(ws)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(rep), failed


def crc(ids):
    return zlib.crc32(array("I", ids).tobytes())
