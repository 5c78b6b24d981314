"""Plain Python versions of the corpus operators' contracts."""

import base64
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import tiktoken
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLEAN = " \t\n\x0b\x0c\r"


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    n, rep = len(words), len(covered)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), rep, n < 20 or 100 * rep > 30 * n


def kept_lines(rows):
    """(doc_id, text) to (doc_id, n_lines, n_dropped, hash)."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    holders = defaultdict(set)
    for d, text in rows:
        for line in (text or "").split("\n"):
            if len(key := line.strip(CLEAN).translate(lower)) >= 40:
                holders[key].add(d)
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(h := holders.get(x.strip(CLEAN).translate(lower), ())) >= 5 and max(h) != d)]
        out.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def fingerprint(text):
    words = [w.encode() for w in WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(rows, distance=2):
    """(doc_id, fingerprint) to {doc_id: smallest id reachable}."""
    prints = sorted({f for _, f in rows})
    a = np.array(prints, dtype=np.uint64)
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= distance):
            parent[root(int(j))] = root(i)
    place = {f: i for i, f in enumerate(prints)}
    lowest = {}
    for d, f in rows:
        r = root(place[f])
        lowest[r] = min(lowest.get(r, d), d)
    return {d: lowest[root(place[f])] for d, f in rows}


def targets(sizes):
    """{source: size} to {source: target}, sharing excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            out.update({s: left * weight[s] / total for s in open_})
            break
        out.update({s: 2.0 * sizes[s] for s in over})
        left -= sum(2.0 * sizes[s] for s in over)
        open_ -= over
    return out


def tiktoken_encoding():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def edited(rows):
    """(doc_id, text) to (doc_id, n_chars, edited text), in order of doc_id."""
    rows = sorted((d, t or "") for d, t in rows)
    out = []
    for k, (d, text) in enumerate(rows):
        q = len(text) // 4
        out.append((d, len(text), text[: len(text) - q] + rows[(k + 1) % len(rows)][1][:q]))
    return out


def weighted_jaccard(a, b, shingle=5):
    def terms(text):
        words = WORD.findall(text)
        return Counter(tuple(words[i : i + shingle]) for i in range(max(len(words) - shingle + 1, 1))) if words else Counter()

    x, y = terms(a), terms(b)
    top = sum((x | y).values())
    return sum((x & y).values()) / top if top else 1.0


SECRETS = (
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)


def secret_spans(text):
    found = []
    for rank, (kind, pattern, group, least) in enumerate(SECRETS):
        for m in re.finditer(pattern, text or "", re.ASCII):
            if len(m[group]) >= least:
                found.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(found)]


def filled_middle(doc_id, text):
    text, h = text or "", sha(f"7:{'' if doc_id is None else doc_id}")
    h1, h2, _, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return doc_id, len(units), "plain", None, None, sha(text), sha(text)
    form = "spm" if h4 % 100 < 50 else "psm"
    output = f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(units), form, len(prefix), len(middle), sha(output), sha(text)


def collocations(rows, longest=5, least=100, top=2000):
    """(lang, text) to (lang, rank, phrase, a, l, r, n, score)."""
    f, totals = Counter(), Counter()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            f.update((lang, *words[i:j]) for i in range(len(words)) for j in range(i + 1, min(i + longest, len(words)) + 1))
    often = {p: a for p, a in f.items() if a >= least}
    inside = Counter()
    for (lang, *words), a in often.items():
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                if j - i < len(words):
                    inside[lang, *words[i:j]] = max(inside[lang, *words[i:j]], a)
    found = defaultdict(list)
    for p, a in often.items():
        lang, *words = p
        if len(words) > 1 and 100 * inside[p] < 100 * a:
            n = totals[lang]
            cuts = [(1000 * a * n // (f[lang, *words[:k]] * f[lang, *words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            found[lang].append((-score, -a, " ".join(words).encode(), f[lang, *words[:k]], f[lang, *words[k:]], n))
    return [
        (lang, rank, phrase.decode(), -a, left, right, n, -score)
        for lang, phrases in found.items()
        for rank, (score, a, phrase, left, right, n) in enumerate(sorted(phrases)[:top], 1)
    ]


def best_fit(lengths, size):
    """Windows and offsets by looking at every open window; of equal rooms the last one that came to have it."""
    room, out, since = [], [], []
    for step, n in enumerate(lengths):
        fits = [w for w, r in enumerate(room) if r >= n]
        if not fits:
            room.append(size)
            since.append(step)
            fits = [len(room) - 1]
        w = min(fits, key=lambda w: (room[w], -since[w]))
        out.append((w, size - room[w]))
        room[w] -= n
        since[w] = step
    return out
