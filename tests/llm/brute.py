"""Plain versions of the corpus operators' contracts, and documents that are hard on them."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_hash string, key int, class string, component string, kept string, dd_runs int, n int, word string, anchor int, hash int, row string"


def low(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def hard_texts(seed=3):
    """(doc_id, text): copies, near copies, shared passages, ties, nulls, empty and long texts."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(["th", "er", "on", "An", "é", "ß", "-x", "9"]) for _ in range(rnd.randint(1, 4)))
    text = lambda n: " ".join(word() + ("\n" if rnd.random() < 0.15 else "") for _ in range(n))
    base, passage = [text(rnd.randint(20, 80)) for _ in range(12)], text(30)
    rows = [(i, base[i]) for i in range(12)]
    for i in range(12, 40):
        words = rnd.choice(base).split(" ")
        for _ in range(rnd.choice([0, 1, 1, 2, 6])):
            words[rnd.randrange(len(words))] = word()
        rows.append((i, " ".join(words)))
    rows += [(40 + i, f"{text(15)} {passage} {text(9)}") for i in range(8)]
    rows += [(50, None), (51, ""), (52, " \t\n "), (53, "one"), (54, "one"), (55, "One two"), (56, "a " * 60), (57, "a " * 60), (58, text(4000)), (59, "x" * 5000), (60, "same\nsame\nsame\nsame\nsame\nsame"), (61, "\n\n\n\n")]
    return rows


def documents(spark, rows):
    """The rows with further columns whose names clash with the operators' own."""
    full = [(i, t, "en", "src0", len(t) if t is not None else None, "c", 1, "c", "c", "c", 2, 3, "c", 4, 5, "c") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def substrings(rows, window=13):
    first, out = {}, {}
    for i, t in sorted(rows):
        w = SPACED.findall(t or "")
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    for i, t in rows:
        w, gone = SPACED.findall(t or ""), set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def contamination(rows, items, window=10):
    found, out = defaultdict(set), {}
    for i, t in items:
        w = TERM.findall(low(t))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            found[tuple(w[k : k + window])].add(str(i))
    for i, t in rows:
        w, hit, own = TERM.findall(low(t)), set(), set()
        for n in {len(x) for x in found}:
            for k in range(len(w) - n + 1):
                if o := found.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    own |= o
        out[i] = (len(w), len(hit), len(own), sha(",".join(sorted(own))), bool(hit))
    return out


def shingle_sets(rows, size=5):
    out = {}
    for i, t in rows:
        w = SPACED.findall(low(t))
        out[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    return out


def components(sets, threshold=85):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def line_dedup(rows, least=3):
    """doc_id -> kept text; rows in doc_id order."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        lines, gone = (t or "").split("\n"), set()
        for k in range(len(lines) - least + 1):
            run = tuple(lines[k : k + least])
            if run in seen:
                gone.update(range(k, k + least))
            seen.add(run)
        out[i] = None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def runs_removed(rows, min_lines, min_chars):
    """doc_id -> kept text, from the longest earlier match of every suffix."""
    whole = {i: t.split("\n") for i, t in rows if t is not None}
    starts, out = defaultdict(list), {i: None for i, _ in rows}
    for i in sorted(whole):
        lines, gone = whole[i], set()
        for p in range(len(lines)):
            longest = 0
            for e, q in starts[lines[p]]:
                n = 0
                while p + n < len(lines) and q + n < len(whole[e]) and lines[p + n] == whole[e][q + n]:
                    n += 1
                longest = max(longest, n)
            starts[lines[p]].append((i, p))
            if longest >= min_lines or sum(len("".join(x.split())) for x in lines[p : p + longest]) >= min_chars:
                gone.update(range(p, p + longest))
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def base_scores(rows):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    counts = Counter()
    for i, t in rows:
        if not held[i]:
            counts.update([*SPACED.findall(low(t)), None])
    total, distinct, out = sum(counts.values()), len(counts), {}
    for i, t in rows:
        w = [*SPACED.findall(low(t)), None]
        out[i] = (held[i], len(w), sum(counts[x] > 0 for x in w), total, sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in w))
    return out
