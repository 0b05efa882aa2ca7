"""Plain versions of the operators for small tables, written from their contracts."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import xxhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def decontaminated(docs, items, window=10):
    """{doc_id: (n_words, n_hit, n_items, digest)}"""
    grams = defaultdict(set)
    for item, text in items:
        w = WORD.findall(lower(text))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            grams[tuple(w[k : k + n])].add(str(item))
    sizes = {len(g) for g in grams}
    out = {}
    for doc, text in docs:
        w = WORD.findall(lower(text))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                owners = grams.get(tuple(w[k : k + n]))
                if owners:
                    hit.update(range(k, k + n))
                    found |= owners
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out


def simhash(text, shingle=4):
    w = SPACED.findall(lower(text))
    if not w:
        return 0
    grams = [" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(docs, radius=4):
    """{doc_id: (hex fingerprint, component)}"""
    fps = {d: simhash(t) for d, t in docs}
    distinct = sorted(set(fps.values()))
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            root[f] = root[root[f]]
            f = root[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for d, f in fps.items():
        r = find(f)
        least[r] = min(least.get(r, d), d)
    return {d: (f"{f:016x}", least[find(f)]) for d, f in fps.items()}


def without_repeats(docs, length=100):
    """{doc_id: (n_bytes, n_removed, n_spans, digest of what stays)}; docs in order."""
    seen, out = set(), {}
    for doc, text in sorted(docs):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            else:
                seen.add(s)
        stay = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[doc] = (len(raw), sum(gone), spans, hashlib.sha256(stay).hexdigest())
    return out


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def crc_of_ids(ids):
    import numpy as np

    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
