"""Plain versions of what operators compute, written without their code."""

import math
import re
from collections import Counter, defaultdict

import regex
import xxhash

#: Kind, expression, group whose length counts, least length; the first three as the contract has them.
SECRETS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----", 0, 0),
    ("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    ("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 0),
]


def secret_spans(text, kinds=len(SECRETS)):
    """(kind, start, end) of each secret of the first ``kinds`` kinds, by start, then kind as listed."""
    found = []
    for k, (_, expression, group, least) in enumerate(SECRETS[:kinds]):
        found += [(m.start(), k, m.end()) for m in re.finditer(expression, text or "", re.ASCII) if len(m[group]) >= least]
    return [(SECRETS[k][0], s, e) for s, k, e in sorted(found)]


def listed(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def _hash(*parts, seed=42):
    """Spark's xxhash64 of texts and longs."""
    for p in parts:
        data = p.encode() if isinstance(p, str) else (p & ((1 << 64) - 1)).to_bytes(8, "little")
        seed = xxhash.xxh64(data, seed=seed).intdigest()
    return _signed(seed)


def order_minhash(text, k=2, pick=2, longest=20):
    """bucket -> hash of the least ``pick`` numbered k-mers in text order."""
    words = []
    for w in re.split("[ \t\n\v\f\r]+", text or ""):
        words += list(w) if len(w) > longest else [w] if w else []
    grams = [words[i : i + k] for i in range(max(len(words) - k + 1, 1 if words else 0))]
    hashes, seen, buckets = [_hash(*g) for g in grams], {}, {}
    for at, h in enumerate(hashes):
        low = h & ((1 << 35) - 1)
        seen[low] = seen.get(low, 0) + 1
        ranked = _hash_int(low, seen[low]) & ((1 << 35) - 1)
        buckets.setdefault(ranked >> 30, []).append((ranked, at))
    out = {}
    for b, ranked in buckets.items():
        chain = 0
        for at in sorted(at for _, at in sorted(ranked)[:pick]):
            chain = _hash(chain, hashes[at])
        out[b] = chain & ((1 << 58) - 1)
    return out


def _hash_int(low, number):
    """Spark's xxhash64 of a long and an int."""
    return _int_hash(number, xxhash.xxh64(low.to_bytes(8, "little"), seed=42).intdigest())


def _int_hash(x, seed):
    return _signed(xxhash.xxh64((x & 0xFFFFFFFF).to_bytes(4, "little"), seed=seed).intdigest())


def likeness(a, b):
    filled = a.keys() | b.keys()
    return sum(a.get(k) == b.get(k) for k in filled) / len(filled) if filled else 1.0


_WORD = regex.compile(r"(?:[A-Za-z0-9_]|(?![\x00-\x7F\p{P}\p{Z}\p{Cc}\p{Cf}\p{S}]).)+|(?![\x00-\x7F])\p{S}", regex.DOTALL)


def shingle_counts(text, size=5):
    words = _WORD.findall((text or "").lower())
    return Counter(tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))) if words else Counter()


def similar_pairs(texts, least, floor=0.8):
    """{(i, j): weighted Jaccard similarity over counts * idf} of the distinct texts that share a shingle, from ``least`` on."""
    sets = [shingle_counts(t) for t in texts]
    df = Counter(x for c in sets for x in c)
    n = len(texts)
    weight = {x: floor + (1 - floor) * math.log(n / k) / math.log(max(n, 2)) for x, k in df.items()}
    total = [sum(k * weight[x] for x, k in c.items()) for c in sets]
    where = defaultdict(list)
    for i, c in enumerate(sets):
        for x, k in c.items():
            where[x].append((i, k))
    both: Counter = Counter()
    for x, held in where.items():
        for a, (i, k) in enumerate(held):
            for j, m in held[a + 1 :]:
                both[i, j] += min(k, m) * weight[x]
    like = {(i, j): w / (total[i] + total[j] - w) for (i, j), w in both.items()}
    return {p: s for p, s in like.items() if s >= least}
