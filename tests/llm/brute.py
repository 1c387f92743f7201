"""Plain restatements of the contracts, for small inputs."""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from corvane.llm import kernels as K

SPACED = r"[^\x20\x09-\x0D]+"
PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def substring_dedup(docs, size=13):
    words = {d: re.findall(SPACED, t or "") for d, t in docs}
    first: dict = {}
    for d in sorted(words):
        for i in range(len(words[d]) - size + 1):
            first.setdefault(tuple(words[d][i : i + size]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < d:
                gone.update(range(i, i + size))
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def byte_dedup(docs, size=200):
    raw = {d: (t or "").encode() for d, t in docs}
    count = Counter(b[i : i + size] for b in raw.values() for i in range(len(b) - size + 1))
    out = {}
    for d, b in raw.items():
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if count[b[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out


def statistics(text):
    text = text or ""
    w = re.findall(SPACED, text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(SPACED, x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)


def near_components(docs, k=4, percent=85):
    sets = {}
    for d, t in docs:
        w = re.findall(SPACED, (t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    label = {d: d for d in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def contamination(docs, items, size=13):
    windows = defaultdict(set)
    for item, text in items:
        w = tuple(re.findall(PLAIN, (text or "").translate(LOWER)))
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[w[i : i + n]].add(str(item))
    out = {}
    for d, t in docs:
        w, hit, found = re.findall(PLAIN, (t or "").translate(LOWER)), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= own
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w))
    return out


def within(a, b, edits):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1] <= edits


def line_dedup(docs, edits, min_chars):
    first, order, near = {}, [], set()
    for d, t in sorted(docs):
        for i, line in enumerate([] if t is None else t.split("\n")):
            if len(line) >= min_chars and line not in first:
                first[line] = (d, i)
                if any(abs(len(o) - len(line)) <= edits and within(o, line, edits) for o in order):
                    near.add(line)
                order.append(line)
    out = {}
    for d, t in docs:
        lines = [] if t is None else t.split("\n")
        exact = [i for i, x in enumerate(lines) if len(x) >= min_chars and first[x] != (d, i)]
        alike = [i for i, x in enumerate(lines) if len(x) >= min_chars and first[x] == (d, i) and x in near]
        out[d] = (len(lines), len(exact), len(alike), ",".join(map(str, sorted(exact + alike))))
    return out


def shards(sizes, limit, deepest=60):
    bits = {d: bin((1 << 60) | int(hashlib.md5(str(d).encode()).hexdigest()[:15], 16))[3:] for d in sizes}

    def split(ids, prefix):
        total = sum(sizes[d] for d in ids)
        if total <= limit or len(prefix) == deepest or not ids:
            return {d: (prefix, len(prefix), total) for d in ids}
        return split([d for d in ids if bits[d][len(prefix)] == "0"], prefix + "0") | split([d for d in ids if bits[d][len(prefix)] == "1"], prefix + "1")

    return split(list(sizes), "")


def lexical_search(docs, items, k=50):
    """doc lists per item, from (doc_id, text) rows, each a document of its own."""
    terms = [(d, Counter(re.findall(PLAIN, (t or "").translate(LOWER)))) for d, t in docs]
    terms = [(d, c) for d, c in terms if c]
    n_docs, length = len(terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(re.findall(PLAIN, (text or "").translate(LOWER)))
    out = {}
    for item, own in asked.items():
        scores = []
        for d, c in terms:
            m = 100 - 50 + 50 * sum(c.values()) * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out[item] = [(i, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(scores)[:k], 1)]
    return out


def damaged(rows):
    """Turns by conversation after damage, in order: (turn, role, text)."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text, own = " " if role is None else role, " " if text is None else text, out[conv]
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:])) for c, own in out.items()}


def repaired(turns):
    """(cost, audit, repaired turns) of the cheapest, then ASCII-least edits, by search over all strings of edits in order of cost."""
    seen, faulty = set(), []
    for _, role, text in turns:
        words = re.findall(SPACED, text)
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1][-1] not in ".!?" else ""
        seen.add((role, text))
        faulty.append((role, text, fault))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, initials, made = heapq.heappop(heap)
        if i == len(faulty) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, audit, made, faulty
        state = (i, {"": 0, "s": 1, "u": 2, "a": 3}[initials[-1:]])
        if state in done:
            continue
        done.add(state)

        def go(more, edit, step, role=None, text=""):
            word = initials + (role[:1] or " " if role is not None else "")
            if re.fullmatch("s?(ua)*u?", word):
                heapq.heappush(heap, (cost + more, audit + edit, i + step, word, made if role is None else (*made, f"{role}:{text}")))

        for role in ("user", "assistant"):
            go(2, "I", 0, role)
        if i < len(faulty):
            role, text, fault = faulty[i]
            go(3, "D", 1)
            if fault not in ("blank", "duplicate"):
                late = int(fault == "truncated")
                go(late, "K", 1, role, text)
                for new in ("user", "assistant"):
                    go(2 + late, "R", 1, new, text)


def conversation_repair(rows):
    by = damaged(rows)
    out = {}
    for conv in {r[0] for r in rows}:
        turns = by.get(conv, [])
        cost, audit, made, faulty = repaired(turns)
        numbers = {t for t, _, _ in turns if t is not None}
        initials = [r[:1] for _, r, _ in turns]
        count = Counter(f for _, _, f in faulty)
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, sha("\n".join(made)))
    return out


def simhash(text, bits=256):
    """The fingerprint of one text by the hashes of the engine, votes counted one by one."""
    raw = (text or "").translate(LOWER).encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    hashed = [K.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)])) for w in words]
    symbols = np.concatenate(hashed) if hashed else np.zeros(0, np.uint64)
    terms = Counter(("w", int(h)) for h in symbols)
    if len(words) >= 5:
        terms.update(("s", int(K.mix(g ^ np.uint64(5)))) for g in K.gram_hashes(symbols, 5))
    elif words:
        terms[("s", int(K.mix(K.gram_hashes(symbols, len(words)) + np.uint64(len(words)))[0]))] += 1
    votes = [0] * bits
    for (kind, h), tf in terms.items():
        weight = (2 if kind == "s" else 1) * tf.bit_length()
        for i in range(bits // 64):
            own = int(K.mix(np.array([(h + (i + 1) * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0])
            for b in range(64):
                votes[64 * i + b] += weight if own >> b & 1 else -weight
    return sum(1 << b for b, v in enumerate(votes) if v > 0).to_bytes(bits // 8, "little").hex()


def fingerprints(docs):
    rows = sorted(docs, key=lambda r: -r[0])
    out = {}
    for (d, t), (_, following) in zip(rows, [*rows[1:], rows[0]]):
        t, following = t or "", following or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        a, b, c = simhash(t), simhash(edited), simhash(following)
        like = lambda x, y: max(0.0, math.cos(math.pi * (int(x, 16) ^ int(y, 16)).bit_count() / 256))
        out[d] = (len(t), sha(edited), a, b, round(like(a, b), 9), round(like(a, c), 9))
    return out
