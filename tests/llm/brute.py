"""Plain single-machine versions of the operators, for comparison."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
sha = lambda b: hashlib.sha256(b).hexdigest()


def words(text):
    return WORD.findall((text or "").encode())


def substring_dedup(rows, window):
    """rows: (doc_id, text) -> (doc_id, n_words, n_removed, sha)"""
    least = {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - window + 1) if i is not None else ():
            k = tuple(w[p:p + window])
            least[k] = min(least.get(k, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for p in range(len(w) - window + 1) if i is not None else ():
            if least[tuple(w[p:p + window])] < i:
                gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), sha(b" ".join(x for p, x in enumerate(w) if p not in gone))))
    return out


def simhash(rows, shingle, bits):
    fps = []
    for i, t in rows:
        w = words((t or "").encode().lower().decode())
        sh = [b" ".join(w[p:p + shingle]) for p in range(max(1, len(w) - shingle + 1))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    group = {f: f for f in fps}

    def root(f):
        while group[f] != f:
            f = group[f]
        return f
    uniq = sorted(group)
    for x, a in enumerate(uniq):
        for b in uniq[x + 1:]:
            if bin(a ^ b).count("1") <= bits:
                group[root(a)] = root(b)
    least = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[root(f)] = min(least.get(root(f), i), i)
    return [(i, f"{f:016x}", least.get(root(f))) for (i, _), f in zip(rows, fps)]


def decontaminate(rows, items, window):
    cut = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    toks = lambda t: cut.findall((t or "").encode().lower())
    wins = defaultdict(set)
    for i, t in items:
        w = toks(t)
        n = min(window, len(w))
        for p in range(len(w) - n + 1) if w else ():
            wins[tuple(w[p:p + n])].add(i)
    sizes = {len(k) for k in wins}
    out = []
    for i, t in rows:
        w = toks(t)
        hit, names = set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (k := tuple(w[p:p + n])) in wins:
                    hit.update(range(p, p + n))
                    names |= wins[k]
        names = sorted(str(x) for x in names if x is not None)
        out.append((i, len(w), len(hit), len(names), sha(",".join(names).encode()), bool(hit)))
    return out


def quality_base(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[p:p + 5]) for p in range(len(w) - 4)]
    often = Counter(grams)
    rep = set()
    for p, g in enumerate(grams):
        if often[g] > 1:
            rep.update(range(p, p + 5))
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(rep),
            len(w) < 10 or 100 * len(rep) > 20 * len(w))


def repeated_bytes(rows, size):
    """(doc_id, n_bytes, n_removed, n_spans, sha)"""
    seen = Counter()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        for p in range(len(b) - size + 1):
            seen[b[p:p + size]] += 1
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        end = 0
        for p in range(len(b) - size + 1):
            if seen[b[p:p + size]] > 1:
                for q in range(max(p, end), p + size):
                    gone[q] = 1
                end = p + size
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def unigram(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score)"""
    import math
    import zlib
    seen = Counter()
    toks = [[*words((t or "").encode().lower().decode()), None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    for w, h in zip(toks, held):
        if not h:
            seen.update(w)
    n, v = sum(seen.values()), len(seen)
    return [(i, h, len(w), sum(seen[x] > 0 for x in w), n, sum(math.log10((seen[x] + 1) / (n + v + 1)) for x in w))
            for (i, _), w, h in zip(rows, toks, held)]
