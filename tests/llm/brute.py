"""Plain Python versions of the operators, for small inputs."""

import hashlib
import math
import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def substring_rows(docs, factor=13):
    """Sorted (doc_id, n_words, n_removed, sha)."""
    first = {}
    last = 1 << 63
    key = lambda i: last if i is None else i
    texts = [(i, WORD.findall(t or "")) for i, t in docs]
    for i, w in texts:
        for k in range(len(w) - factor + 1):
            at = tuple(w[k : k + factor])
            first[at] = min(first.get(at, key(i)), key(i))
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - factor + 1):
            if first[tuple(w[k : k + factor])] < key(i):
                gone[k : k + factor] = [True] * factor
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return sorted(out, key=repr)


def suffix_rows(docs, length=400):
    """Sorted (doc_id, n_bytes, n_removed, n_spans, sha)."""
    count = {}
    texts = [(i, (t or "").encode()) for i, t in docs]
    for _, b in texts:
        for k in range(len(b) - length + 1):
            count[b[k : k + length]] = count.get(b[k : k + length], 0) + 1
    out = []
    for i, b in texts:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return sorted(out, key=repr)


def exact_rows(docs):
    """Sorted (doc_id, keep_id, group_size, kept, sha)."""
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in docs]
    out = []
    for i, t in norm:
        ids = [j for j, u in norm if u == t]
        known = [j for j in ids if j is not None]
        keep = min(known) if known else None
        out.append((i, keep, len(ids), i == keep, sha(t)))
    return sorted(out, key=repr)


def fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(text)
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def simhash_groups(docs):
    """A number for each row; rows of one component have the same."""
    fps = [fingerprint(t) for _, t in docs]
    group = list(range(len(docs)))
    changed = True
    while changed:
        changed = False
        for a in range(len(docs)):
            for b in range(len(docs)):
                if group[a] != group[b] and bin(fps[a] ^ fps[b]).count("1") <= 3:
                    low, high = sorted((group[a], group[b]))
                    group = [low if g == high else g for g in group]
                    changed = True
    return group


def simhash_rows(docs):
    """Sorted (doc_id, fingerprint, component_id)."""
    group = simhash_groups(docs)
    out = []
    for (i, t), g in zip(docs, group):
        known = [j for (j, _), h in zip(docs, group) if h == g and j is not None]
        out.append((i, f"{fingerprint(t):016x}", min(known) if known else None))
    return sorted(out, key=repr)


def _mix(h):
    m = (1 << 64) - 1
    h ^= h >> 33
    h = h * 0xFF51AFD7ED558CCD & m
    h ^= h >> 29
    h = h * 0xC4CEB9FE1A85EC53 & m
    return h ^ (h >> 32)


def quality_features(text, table, base, salt, bits):
    """Slot -> value of a text's features, number by number."""
    m = (1 << 64) - 1
    run = lambda values: _mix(sum(v * pow(base, i, 1 << 64) for i, v in enumerate(values)) & m)
    kind = lambda b: 1 if 97 <= b <= 122 or b >= 128 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else b + 8
    words = [w.encode() for w in WORD.findall(text or "")]
    word = [run([table[b + 32 if 65 <= b <= 90 else b] for b in w]) for w in words]
    shape = []
    for w in words:
        kinds = [kind(b) for b in w]
        shape.append(run([_mix(k) for i, k in enumerate(kinds) if not i or k != kinds[i - 1]]))
    pair = lambda a, b, s: _mix((a * salt[s] + b) & m)
    found = [w ^ salt[0] for w in word] + [s ^ salt[3] for s in shape]
    for i in range(len(words) - 1):
        found += [pair(word[i], word[i + 1], 2), pair(shape[i], shape[i + 1], 1) ^ salt[4]]
        if word[i] == word[i + 1]:
            found.append(salt[6])
        if i + 2 < len(words):
            found.append(_mix((pair(shape[i], shape[i + 1], 1) * salt[5] + shape[i + 2]) & m))
    count = {}
    for h in found:
        count[h >> (64 - bits)] = count.get(h >> (64 - bits), 0) + 1
    value = {s: math.log1p(n) for s, n in count.items()}
    length = math.sqrt(sum(v * v for v in value.values()))
    return {s: v / length for s, v in value.items()}


def quality_model(examples, passes, seed, alpha, beta, l1, l2):
    """Weights by slot (the bias under None) from (features, label), by follow-the-regularised-leader updates one by one."""
    z, n = {}, {}

    def weight(s):
        a = z.get(s, 0.0)
        return 0.0 if abs(a) <= l1 else -(a - math.copysign(l1, a)) / ((beta + math.sqrt(n.get(s, 0.0))) / alpha + l2)

    order = np.random.default_rng(seed)
    for _ in range(passes):
        for i in order.permutation(len(examples)):
            features, label = examples[i]
            features = features | {None: 0.1}
            w = {s: weight(s) for s in features}
            p = 1 / (1 + math.exp(-sum(w[s] * v for s, v in features.items())))
            for s, v in features.items():
                g = (p - label) * v
                z[s] = z.get(s, 0.0) + g - (math.sqrt(n.get(s, 0.0) + g * g) - math.sqrt(n.get(s, 0.0))) / alpha * w[s]
                n[s] = n.get(s, 0.0) + g * g
    return {s: weight(s) for s in z}
