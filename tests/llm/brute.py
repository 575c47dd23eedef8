"""Plain, slow versions of the corpus queries, row by row."""

import base64
import collections
import hashlib
import re
import struct
import zlib

WORD = re.compile("[^\x20\x09-\x0d]+")


def passages(docs, window=50):
    least = {}
    bodies = [(i, (t or "").encode()) for i, t in docs]
    rank = lambda i: -(1 << 63) if i is None else i
    for i, b in bodies:
        for p in range(len(b) - window + 1):
            w = b[p : p + window]
            least[w] = min(least.get(w, rank(i)), rank(i))
    out = []
    for i, b in bodies:
        cut = bytearray(len(b))
        for p in range(len(b) - window + 1):
            if least[b[p : p + window]] < rank(i):
                cut[p : p + window] = b"\1" * window
        kept = bytes(x for x, c in zip(b, cut, strict=True) if not c)
        spans = sum(1 for p in range(len(b)) if cut[p] and (not p or not cut[p - 1]))
        out.append((i, len(b), sum(cut), spans, hashlib.sha256(kept).hexdigest()))
    return out


def secrets(text):
    text = text or ""
    either = lambda w: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in w)
    names = "|".join(either(w) for w in ("password", "passwd", "secret", "token")) + "|" + either("api") + "_?" + either("key")
    found = [(m.start(), 0, m.end()) for m in re.finditer(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))
    return (*(sum(1 for f in found if f[1] == k) for k in range(3)), hashlib.sha256(joined.encode()).hexdigest())


def fingerprint(text):
    import xxhash

    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[j : j + 3]).encode(), 42) for j in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, reach=2):
    """(id, fingerprint) pairs: smallest id reachable from each position."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= reach:
                parent[find(a)] = find(b)
    least = {}
    for i, (id_, _) in enumerate(fps):
        if id_ is not None:
            least[find(i)] = min(least.get(find(i), id_), id_)
    return [least.get(find(i)) for i in range(len(fps))]


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    at = collections.defaultdict(list)
    for j in range(len(words) - 7):
        at[tuple(words[j : j + 8])].append(j)
    covered = {j + d for v in at.values() if len(v) > 1 for j in v for d in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words)


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def media(text):
    b = (text or "").encode()
    payload = b + bytes(-len(b) % 64 if b else 64)
    return len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])


def pieces(ids, size=1024):
    """(piece, start, length, crc) of a document's ids, the end id included."""
    n, start, out = len(ids), 0, []
    while start < n:
        stop = min(n, start + (n % size or size)) if not out else start + size
        out.append((len(out), start, stop - start, zlib.crc32(b"".join(struct.pack("<I", x) for x in ids[start:stop]))))
        start = stop
    return out
