"""Plain versions of the operators, for tests."""

from collections import defaultdict

import xxhash


def simhash(text):
    words = (text or "").encode().lower().split()
    k = min(3, len(words))
    if not k:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, bits=2):
    """id -> smallest id reachable; ``prints`` is id -> fingerprint."""
    by = defaultdict(list)
    for i, p in prints.items():
        by[p].append(i)
    keys, up = list(by), {}
    up = {k: k for k in keys}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= bits:
                up[root(a)] = root(b)
    least = {}
    for k in keys:
        least[root(k)] = min(least.get(root(k), min(by[k])), min(by[k]))
    return {i: least[root(k)] for k in keys for i in by[k]}


def tiles(item, doc, least):
    """Greedy string tiling by trying all matches each round."""
    k, out = min(least, len(item)), []
    a, b = [False] * len(item), [False] * len(doc)
    while k:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and not a[i + n] and not b[d + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, d)
        n, i, d = best
        if n < k:
            break
        a[i : i + n] = [True] * n
        b[d : d + n] = [True] * n
        out.append((i, d, n))
    return out


def greedy_tokens(word, vocabulary):
    n = 0
    while word:
        size = next((s for s in range(len(word), 0, -1) if word[:s] in vocabulary), 0)
        if not size:
            return None
        n, word = n + 1, word[size:]
    return n
