"""Plain versions of the operators, over all rows in memory."""

from __future__ import annotations

import hashlib
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def mix_targets(sizes: dict, cap: int = 3) -> dict:
    """Targets by source: 5, 2, 1 by code point (null last), overflow shared again by weight."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free = dict.fromkeys(names, 0.0), set(names)
    left = float(sum(sizes.values()))
    while left > 1e-9 and free:
        whole = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / whole
        left = sum(max(0.0, target[s] - cap * sizes[s]) for s in names)
        for s in list(free):
            if target[s] >= cap * sizes[s]:
                target[s] = float(cap * sizes[s])
                free.discard(s)
    return target


def quality(text):
    ws = words(text)
    seen = {}
    for i in range(len(ws) - 2):
        seen.setdefault(tuple(ws[i:i + 3]), []).append(i)
    repeat = {j for at in seen.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return {"n_words": len(ws), "word_chars": sum(map(len, ws)),
            "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
            "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)),
            "n_repeat_words": len(repeat),
            "base_failed": len(ws) < 50 or 100 * len(repeat) > 50 * len(ws)}


def span_dedup(docs, window=50):
    """docs: (doc_id, text) -> list of (doc_id, n_words, n_removed, sha256)."""
    first = {}
    for d, t in docs:
        ws = words(t)
        for i in range(len(ws) - window + 1):
            key = tuple(ws[i:i + window])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    out = []
    for d, t in docs:
        ws = words(t)
        gone = set()
        for i in range(len(ws) - window + 1):
            key = tuple(ws[i:i + window])
            if d is not None and first[key] < d:
                gone.update(range(i, i + window))
        kept = [w for i, w in enumerate(ws) if i not in gone]
        out.append((d, len(ws), len(gone),
                    hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def shingle_set(text, n=5):
    ws = words(text)
    return {tuple(ws[i:i + n]) for i in range(max(1, len(ws) - n + 1))} if ws else set()


def near_groups(docs, threshold=0.8):
    """docs: (doc_id, text) -> {doc_id: (class_id, n_links)}; ids are distinct here."""
    sets = {d: shingle_set(t) for d, t in docs}
    by = {}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(d)
    pairs = {(a, b) for ds in by.values() for i, a in enumerate(ds) for b in ds[i + 1:]}
    links, parent = dict.fromkeys(sets, 0), {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if both >= threshold * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d: (root(d), links[d]) for d in sets}


def nearest(rows, k=5, every=50):
    """rows: (vec_id, list) -> {query_id: [(vec_id, cosine), ...]}."""
    import numpy as np

    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], float)
    norm = np.sqrt((x * x).sum(1))
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        cos = (x * x[i]).sum(1) / (norm * norm[i])
        order = [j for j in np.lexsort((ids, -cos)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), float(cos[j])) for j in order]
    return out


def conversation_digests(rows):
    """rows: (conv_id, turn, role, text) -> {conv_id: (n_turns, turns, loss_chars, loss)}."""
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss),
                  hashlib.sha256(loss.encode()).hexdigest())
    return out


def encoded(docs, tokenizer):
    """docs sorted by id -> rows of (doc_id, start, n_tokens, crc32)."""
    import numpy as np

    out, at = [], 0
    for d, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out
