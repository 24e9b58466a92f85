"""Small tables with every awkward row, and plain versions of the operators."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(30_000))
PASSAGE = " ".join(f"shared{k}" for k in range(70))
BASE = [f"alpha{k}" for k in range(60)]
ROWS = [
    (1, None, "en", "a"), (2, "", "en", None), (3, "  \n\t ", None, "a"), (4, "one", "en", "b"), (5, "One", "en", "b"),
    (6, " ".join(BASE), "en", "a"), (7, " ".join(BASE), "en", "a"), (8, " ".join([*BASE[:58], "new", "end"]), "en", "c"), (9, " ".join(BASE[:30] + ["odd"] * 30), "en", "c"),
    (10, LONG, "de", "a"), (10, LONG, "de", "a"), (None, "no id here " * 40, "en", "b"), (12, f"intro {PASSAGE} outro one", "fr", "b"), (13, f"other {PASSAGE} words two", "fr", "b"),
    (14, "é" * 500 + " tail", "fr", "c"), (15, "x" + "é" * 500 + " more", "fr", "c"), (16, "ab" * 600, "en", "c"), (17, "the the the", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def documents(spark, rows=None):
    """With extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)
    return frame.select("*", F.length("text").cast("long").alias("n_chars"), F.lit(1).alias("node"), F.lit("x").alias("key"), F.lit(2).alias("size"), F.lit(3).alias("bits"), F.lit(4).alias("component"))


def shingles(text, size):
    words = WORD.findall((text or "").translate(UPPER))
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())


def ngram_components(rows, size=4, percent=85):
    """(doc_id, n, component) in any order."""
    sets = [shingles(text, size) for _, text in rows]
    found = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            found[x].append(k)
    shared = Counter((a, b) for group in found.values() for i, a in enumerate(group) for b in group[i + 1 :])
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            up[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return sorted(((i, len(s), least.get(top(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def repeated(units, length):
    """Which units of each list lie in `length` units that start anywhere else, too."""
    seen = Counter(tuple(u[s : s + length]) if isinstance(u, list) else u[s : s + length] for u in units for s in range(len(u) - length + 1))
    for u in units:
        gone = np.zeros(len(u), bool)
        for s in range(len(u) - length + 1):
            if seen[tuple(u[s : s + length]) if isinstance(u, list) else u[s : s + length]] > 1:
                gone[s : s + length] = True
        yield gone


def removal(rows, length=400, passage_words=51):
    texts = [(t or "").encode() for _, t in rows]
    words = list(repeated([WORD.findall(t or "") for _, t in rows], passage_words))
    out = []
    for (i, _), t, gone, said in zip(rows, texts, repeated(texts, length), words, strict=True):
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest(), int(said.sum()), bool(said.any())))
    return sorted(out, key=str)


def kneser_ney(rows, trusted, half, discounts_of, unknown_bits):
    """{id: total bits} by the model of the other half, of rows with unique ids."""
    words = {i: WORD.findall(text or "") for i, text in rows}
    counts = [Counter(), Counter()]
    for i in trusted:
        counts[half[i]].update(zip(["", *words[i]], words[i], strict=False))
    sizes = Counter(n for c in counts for n in c.values())
    d, bits = discounts_of(np.array([sizes[k] for k in (1, 2, 3, 4)])), {i: 0.0 for i in words}
    for h, c in enumerate(counts):
        left, total, spare = Counter(w for _, w in c), Counter(), Counter()
        for (v, _), n in c.items():
            total[v] += n
            spare[v] += d[min(n, 3)]
        low = discounts_of(np.array([sum(n == k for n in left.values()) for k in (1, 2, 3, 4)]))
        flat = (sum(low[min(n, 3)] for n in left.values()) / len(c) if c else 1.0) / (len(left) + 1)
        for i in (i for i in words if half[i] != h):
            for v, w in zip(["", *words[i]], words[i], strict=False):
                lower = (left[w] - low[min(left[w], 3)]) / len(c) + flat if left[w] else flat * 2.0**-unknown_bits
                seen = max(c[v, w] - d[min(c[v, w], 3)], 0) / max(total[v], 1)
                bits[i] -= np.log2(seen + (spare[v] / total[v] if total[v] else 1.0) * lower)
    return bits
