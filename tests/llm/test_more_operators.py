"""Operators 11 to 13 against plain versions, with nulls, empties, ties, repeats and long texts."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import decontamination, queries, spelling_groups, vector_codes
from quern.llm.word_index import Bits, Wavelet, WordIndex, suffix_order, words_of

from ..test_queries import plain
from . import cases

SF = "/root/testdata/sf0.001"
LETTERS, TERMS = re.compile("[A-Za-zÀ-ÿ]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("name", ["op11_spelling_groups", "op12_vector_codes", "op13_decontamination"])
def test_matches_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    mine, theirs = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df()
    assert len(mine) and sorted(mine.columns) == sorted(theirs.columns) and plain(mine) == plain(theirs)


# spelling variants


def plain_counts(rows, least_length, least_count):
    out = Counter()
    for i, text in rows:
        for run in LETTERS.findall((text or "").translate(cases.UPPER)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            out[run[:at] + run[at + 1 :] if h % 199 == 0 else run] += 1
    return {w: n for w, n in out.items() if len(w) >= least_length and n >= least_count}


def edits(word, alphabet):
    for k in range(len(word) + 1):
        for c in alphabet:
            yield word[:k] + c + word[k:]
            yield word[:k] + c + word[k + 1 :]
        yield word[:k] + word[k + 1 :]


def plain_forms(counts, times=5):
    alphabet = {c for w in counts for c in w}
    near = {w: {x for x in edits(w, alphabet) if x in counts and x != w} for w in counts}
    best = {w: min(near[w], key=lambda x: (-counts[x], x)) for w in counts if near[w]}
    form = {w: x for w, x in best.items() if counts[x] >= times * counts[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted(((w, n, len(near[w]), form.get(w), counts.get(form.get(w)), root(w)) for w, n in counts.items()), key=str)


def test_counts_of_words(spark):
    """Every 199th run is altered: over words of all rows, with letters of two bytes, capitals, marks between and a null id."""
    rng = np.random.Generator(np.random.PCG64(5))
    word = lambda: "".join(rng.choice(list("abcdéÀÿxÖZ"), int(rng.integers(1, 9))))
    rows = [(None if k == 3 else k % 50, " ".join(word() for _ in range(200)) + "×÷ŁĀ½naïve1two_ß") for k in range(60)] + [(i, t) for i, t, _, _ in cases.ROWS]
    docs = cases.documents(spark, [(i, t, "en", "a") for i, t in rows])
    expected = plain_counts(rows, 1, 1)
    assert sum(h % 199 == 0 for i, t in rows for run in LETTERS.findall((t or "").translate(cases.UPPER)) for h in [zlib.crc32(f"{'' if i is None else i}:{run}".encode())]) > 20
    expected.pop("", None)
    assert {r.word: r.n for r in spelling_groups.word_counts(docs, 1, 1).collect()} == expected
    assert {r.word: r.n for r in spelling_groups.word_counts(docs).collect()} == plain_counts(rows, 6, 5)


@pytest.mark.parametrize("alphabet", ["ab", "abé", "abcdefgh"])
def test_forms_of_words(spark, alphabet):
    """Few letters make repeated bigrams, ties and dense neighbourhoods; chains of forms come from counts that differ widely."""
    rng = np.random.Generator(np.random.PCG64(len(alphabet)))
    counts = {}
    for _ in range(250):
        w = "".join(rng.choice(list(alphabet), int(rng.integers(6, 11))))
        counts[w] = int(5 ** rng.integers(1, 9) * rng.integers(1, 3))
        near = list(edits(w, alphabet))
        for x in rng.choice(len(near), 2):
            if len(near[x]) >= 6:
                counts[near[x]] = int(5 ** rng.integers(1, 9))
    words = spark.createDataFrame([(w, n, 1) for w, n in counts.items()], "word string, n long, b int")
    assert rows_of(spelling_groups.spelling_forms(words)) == plain_forms(counts)


def test_chain_of_forms(spark):
    counts = {"a" * (6 + k): 5 ** (k + 1) for k in range(20)} | {"zzzzzzz": 7}
    found = {r.word: r for r in spelling_groups.spelling_forms(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert {r.root for w, r in found.items() if w[0] == "a"} == {"a" * 25} and found["a" * 6].form == "a" * 7
    assert (found["zzzzzzz"].n_near, found["zzzzzzz"].form, found["zzzzzzz"].root) == (0, None, "zzzzzzz")


def test_no_words(spark):
    assert not spelling_groups.spelling_forms(spelling_groups.word_counts(cases.documents(spark, [(1, None, "en", "a"), (2, "", "en", "a")]))).collect()
    assert not spelling_groups.spelling_forms(spelling_groups.word_counts(cases.documents(spark, []))).collect()


# vector codes


def plain_codes(rows, parts, entries, rounds, scale=4096):
    """rows of unique ids."""
    kept = sorted((i, label, [int(np.floor(float(x) * scale)) for x in v]) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v))
    width = len(kept[0][2]) // parts
    cut = lambda v, k: v[k * width : (k + 1) * width]
    books = [[cut(v, k) for _, _, v in kept[:entries]] for k in range(parts)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda v, k: min((square(cut(v, k), b), e) for e, b in enumerate(books[k]))
    for _ in range(rounds):
        groups = [defaultdict(list) for _ in range(parts)]
        for _, _, v in kept:
            for k in range(parts):
                groups[k][best(v, k)[1]].append(cut(v, k))
        books = [[[sum(c) // len(c) for c in zip(*groups[k][e], strict=True)] if groups[k][e] else b for e, b in enumerate(books[k])] for k in range(parts)]
    found = [(i, label, [best(v, k) for k in range(parts)]) for i, label, v in kept]
    errors = Counter()
    for _, label, x in found:
        errors[label] += sum(d for d, _ in x)
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for _, e in x), sum(d for d, _ in x), errors[label], digest) for i, label, x in found), key=str)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").select("*", F.lit(1).alias("code"), F.lit(2).alias("ints"), F.lit("x").alias("error"))


def test_vector_codes(spark):
    rng = np.random.Generator(np.random.PCG64(9))
    rows = [(k, [float(x) for x in np.round(rng.normal(0, 0.01, 16), int(rng.integers(2, 4))).astype(np.float32)], [1, 2, None][k % 3]) for k in range(3, 300)]
    rows += [(300, rows[0][1], 2), (301, rows[0][1], None), (0, None, 1), (1, [None] * 16, 1), (2, [float("nan")] + [0.0] * 15, 1), (400, [float("inf")] * 16, 1), (401, [0.0] * 16, 1)]
    got = vector_codes.vector_codes(vectors(spark, rows).repartition(5))
    assert rows_of(got) == plain_codes(rows, 8, 16, 6)


def test_few_vectors_and_none(spark):
    few = [(1, [0.5, -0.25, 1.0, 0.0], None), (2, [0.5, -0.25, 1.0, 0.0], None), (3, [1.0, 2.0, 3.0], 1)]
    assert rows_of(vector_codes.vector_codes(vectors(spark, few), 2)) == plain_codes(few[:2], 2, 16, 6)
    assert not vector_codes.vector_codes(vectors(spark, [(1, None, 1)])).collect()
    assert not vector_codes.vector_codes(vectors(spark, [])).collect()
    with pytest.raises(ValueError, match="beyond"):
        vector_codes.vector_codes(vectors(spark, [(1, [1e30] * 8, 1)]))


def test_repeated_ids_in_any_order(spark):
    rows = [(k // 3, [float((k * 7 + j) % 5) for j in range(8)], k % 2) for k in range(60)]
    a, b = (rows_of(vector_codes.vector_codes(vectors(spark, x), 4, 4, 3)) for x in (rows, rows[::-1]))
    assert a == b and len(a) == 60


def test_nearest_entry_of_ties():
    rng = np.random.Generator(np.random.PCG64(2))
    part, book = rng.integers(-3, 4, (500, 5)), rng.integers(-3, 4, (9, 5))
    distances = ((part[:, None] - book[None]) ** 2).sum(axis=2)
    index, best = vector_codes.nearest(part, book)
    assert (index == distances.argmin(axis=1)).all() and (best == distances.min(axis=1)).all()


# decontamination


def plain_contamination(rows, items, window=10):
    of = lambda t: TERMS.findall((t or "").translate(cases.UPPER))
    windows = defaultdict(set)
    for item, text in items:
        words = of(text)
        for k in range(max(1, len(words) - window + 1) if words else 0):
            windows[tuple(words[k : k + window])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for i, text in rows:
        words, hit, names = of(text), set(), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                if (w := tuple(words[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    names |= windows[w]
        names = sorted(str(x) for x in names if x is not None)
        out.append((i, len(words), sorted(hit), names))
    return sorted(out, key=str)


def found_hits(frame):
    return sorted(((r.doc_id, r.n_words, [k for s in r.spans for k in range(s.first, s.last)], sorted(r.names)) for r in frame.collect()), key=str)


ITEMS = [
    (1, " ".join(cases.PASSAGE.split()[5:30])), (2, " ".join(cases.PASSAGE.split()[20:40])), (3, "THE the"), (4, "one"), (5, None), (6, " .,; "), (7, "never said anywhere at all by anyone in these rows here"),
    (None, "éé" * 3 + " tail"), (8, "é" * 500), (9, "tail é"), (10, "ab" * 600), (10, "no id here no"), (11, "here no"), (12, "alpha3 alpha4 alpha5 alpha6 alpha7 alpha8 alpha9 alpha10 alpha11 alpha12"),
]


@pytest.mark.parametrize(("window", "phrase_bytes"), [(10, 1 << 20), (10, 300), (3, 1 << 20)])
def test_decontamination(spark, window, phrase_bytes):
    """In one block of phrases and in several."""
    rows = [(i, t) for i, t, _, _ in cases.ROWS] + [(50, "Kein é\x00Wort_hier, one-the the"), (51, "one"), (None, None)]
    docs = cases.documents(spark, [(i, t, "en", "a") for i, t in rows]).withColumn("spans", F.lit(1)).withColumn("shard", F.lit("s"))
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("phrase", F.lit("x"))
    assert found_hits(decontamination.contamination(docs, items, window, phrase_bytes)) == plain_contamination(rows, ITEMS, window)


def test_decontamination_without_items_or_documents(spark):
    docs, items = cases.documents(spark), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert not any(r.spans or r.names for r in decontamination.contamination(docs, items.limit(0)).collect())
    assert decontamination.contamination(cases.documents(spark, []), items).count() == 0


def test_planted_passage_in_copies(spark):
    """A hot passage in a third of the rows, each with words of its own."""
    item = " ".join(f"plant{k}" for k in range(25))
    rows = [(k, f"own{k} {' '.join(f'w{k}x{j}' for j in range(30))} {item if k % 3 == 0 else 'clean'} end{k}", "en", "a") for k in range(600)]
    got = {r.doc_id: r for r in decontamination.contamination(cases.documents(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert all((len(r.spans) == 1 and r.spans[0].last - r.spans[0].first == 25) if i % 3 == 0 else not r.spans for i, r in got.items()) and len(got) == 600


@pytest.mark.parametrize("symbols", [[0], [0, 0, 0], [1, 0, 1, 0, 1, 0], [1] * 70 + [0], list(np.random.default_rng(1).integers(0, 3, 400)), list(np.random.default_rng(2).integers(0, 90_000, 500))])
def test_suffix_order(symbols):
    s = np.array(symbols, np.int64)
    assert suffix_order(s).tolist() == sorted(range(len(s)), key=lambda k: symbols[k:])


def test_wavelet_ranks():
    rng = np.random.default_rng(4)
    symbols = rng.integers(0, 13, 1000)
    tree = Wavelet.of(symbols, 4)
    at, c = rng.integers(0, 1001, 300), rng.integers(0, 13, 300)
    ranks = tree.follow(c, at) - tree.follow(c, np.zeros(300, np.int64))
    assert ranks.tolist() == [int((symbols[:a] == x).sum()) for a, x in zip(at, c, strict=True)]
    assert tree.read(np.arange(1000))[0].tolist() == symbols.tolist()
    flags = rng.integers(0, 2, 129).astype(bool)
    assert Bits.of(flags).ones(np.arange(130)).tolist() == [int(flags[:k].sum()) for k in range(130)]


def test_index_read_back_finds_every_place():
    texts = ["a b a b a", "B!a?b", "c", "a", "b a b a b a b a b c"] * 9
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    words, sizes = words_of(buf, np.append(0, np.cumsum([len(t.encode()) for t in texts])))
    assert sizes.tolist() == [len(TERMS.findall(t.lower())) for t in texts]
    index = WordIndex.from_columns(*WordIndex.of(words, sizes).columns())
    line = " 0 ".join(" ".join(TERMS.findall(t.lower())) for t in texts).split()
    phrases = [p.split() for p in ("a", "a b", "b a b", "b c", "c c", "a d", "b a b a b a b a b c")]
    symbols = [index.symbols_of(pa.array([w.encode() for w in p], pa.large_binary())) for p in phrases]
    padded = np.array([np.pad(x, (0, 10 - len(x))) for x in symbols])
    which, low, high = index.search(padded, np.array([len(p) for p in phrases]))
    found = {k: sorted(index.locate(np.arange(a, b)).tolist()) for k, a, b in zip(which.tolist(), low.tolist(), high.tolist(), strict=True)}
    assert found == {k: places for k, p in enumerate(phrases) if (places := [s for s in range(len(line)) if line[s : s + len(p)] == p])}
