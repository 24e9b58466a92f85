"""Spelling variant grouping [operator 11]: rare-first q-gram prefix filter.

Words are the runs of letters of the corpus, counted over all documents. Their
bigrams are ordered by how many words hold them, the rarest first and equal ones
by position, and each word is looked up by its three rarest alone: an edit of one
code point destroys two bigrams at most, so the first of the three that is left
is among the three of the other word, too.

Where it stands in the other word is limited: before the edit it keeps its place
and all that comes before it is equal; after the edit it keeps its distance from
the end and all that follows is equal. Of the rest of the word, one half holds
the edit and the other half is equal as well. Words meet by the hash of length,
side, equal side and equal half, so that candidates share far more than a frequent
bigram, and each is verified by its edit distance.

`word_counts` alters runs as the contract asks: one code point goes from a run of
a document where 199 divides a checksum. Checksums are linear: that of a document's
prefix, moved by the length of a run, and that of the run are combined, so each
distinct run of a batch is read once. The operator itself, `spelling_forms`, takes
any table of words and counts.

Null and empty texts have no words; texts of any length are read whole; a null
doc_id counts as an empty one in the checksum; repeated rows are occurrences like
others; ties of counts go to the smallest word; words near to none have no form
and are their own root; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.bytetext import lowered, string_slices
from quern.llm.common import by_batch, staged, table

#: Divisor of the checksum, least length and count of a word, how much more frequent a form is.
ALTERED, LEAST_LENGTH, LEAST_COUNT, TIMES = 199, 6, 5, 5
#: Two bigrams are destroyed by an edit, so three are looked up.
RAREST = 3
#: A form is at least five times as frequent, and counts are below 2**63: no chain has more than 27 links, so that five doublings reach its end.
DOUBLINGS = 5
#: In UTF-8 the letters beyond ASCII, U+00C0 to U+00FF, are this byte and one more.
LEAD = 0xC3
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), LEAD]] = True
#: Bytes of text read at a time.
SLICE_BYTES = 4 << 20


def letter_runs(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts one after another, their letters alone: these bytes, the borders of runs in them, and each run's text and number of code points."""
    lead = buf == LEAD
    letter = LETTER[buf]
    letter[1:] |= lead[:-1]
    cut = np.zeros(len(buf) + 1, bool)
    cut[offsets] = True
    first = letter.copy()
    first[1:] &= ~letter[:-1] | cut[1:-1]
    places = np.flatnonzero(letter)
    begins = np.flatnonzero(first)
    borders = np.append(np.searchsorted(places, begins), len(places)).astype(np.int64)
    bytes_of = buf[places]
    doubled = np.append(0, np.cumsum(bytes_of == LEAD))
    points = np.diff(borders) - np.diff(doubled[borders])
    return bytes_of, borders, np.searchsorted(offsets, begins, "right") - 1, points


def moved_checksums(checksums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """[i, j]: what the i-th checksum adds to that of `lengths[j]` bytes after it; a checksum is linear in the state before."""
    zeros = [bytes(int(n)) for n in lengths]
    return np.array([[zlib.crc32(z, int(c)) ^ zlib.crc32(z) for z in zeros] for c in checksums], np.uint32).reshape(len(checksums), len(lengths))


def counted_runs(ids: list[str], buf: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], list[int]]:
    """The words of some texts and how often each occurs, one code point less where ALTERED divides the checksum of `id:run`."""
    data, borders, owner, points = letter_runs(lowered(buf), offsets)
    runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(owner), [None, pa.py_buffer(borders), pa.py_buffer(data)]).dictionary_encode()
    distinct, of = runs.dictionary.to_pylist(), runs.indices.to_numpy()
    sizes, size_of = np.unique([len(x) for x in distinct], return_inverse=True)
    moved = moved_checksums(np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32), sizes)
    check = moved[owner, size_of[of]] ^ np.array([zlib.crc32(x) for x in distinct], np.uint32)[of]
    short = check % np.uint32(ALTERED) == 0
    counts = dict(zip(distinct, np.bincount(of[~short], minlength=len(distinct)).tolist(), strict=True))
    for run, at in zip(of[short].tolist(), (check[short] % points[short]).tolist(), strict=True):
        text = distinct[run].decode()
        word = (text[:at] + text[at + 1 :]).encode()
        counts[word] = counts.get(word, 0) + 1
    return list(counts), list(counts.values())


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """docs(doc_id, text) to (word, n) of the words of at least that length and count."""

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column(0).to_pylist()
        for start, count, buf, offsets in string_slices(batch.column(1), SLICE_BYTES):
            if not len(buf):
                continue
            words, n = counted_runs(ids[start : start + count], buf, offsets)
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["word", "n"])
            yield out.filter(pc.and_(pc.greater(out.column(1), 0), pc.greater_equal(pc.utf8_length(out.column(0)), least_length)))

    ids = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    counts = by_batch(docs.select(ids.alias("id"), "text"), step, "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def rare_bigrams(words: DataFrame) -> DataFrame:
    """(word, length, at) for the RAREST first bigrams of each word; positions from 0.

    Bigrams of these letters are 90 * 90 at most, so their counts can be broadcast.
    """
    length = F.length("word")
    grams = words.select("word", F.posexplode(F.transform(F.sequence(F.lit(1), length - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))).alias("at", "gram"))
    counts = staged(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("held")), "bigrams")
    first = F.slice(F.array_sort(F.collect_list(F.struct("held", "gram", "at"))), 1, RAREST)
    ranked = grams.join(F.broadcast(counts), "gram").groupBy("word").agg(first.alias("first"))
    return ranked.select("word", length.alias("length"), F.explode("first.at").alias("at"))


def meeting_keys(target: Column) -> Column:
    """The hashes by which a word meets the words of length `target`, its own or one more, that hold its bigram `at` and differ by one edit.

    The edit is a place of the other word, after the bigram or before it; the
    `rest` on that side is cut in halves, of which one is equal. There is no
    key where there is no place.
    """
    word, at, length = F.col("word"), F.col("at"), F.col("length")
    part = lambda begin, n: F.substring(word, begin + 1, n)
    last = lambda n: F.substring(word, length - n + 1, n)
    key = lambda kind, there, *parts: F.when(there, F.xxhash64(F.lit(kind), target, *parts))
    after, before = target - at - 2, at + target - length
    half, half_before = F.floor(after / 2).cast("int"), F.floor(before / 2).cast("int")
    none = F.lit(0)
    return F.array_compact(
        F.array(
            key(0, after >= 1, part(none, at + 2 + half)),
            key(1, half >= 1, part(none, at + 2), last(after - half)),
            key(2, before >= 1, part(none, half_before), last(length - at)),
            key(3, half_before >= 1, last(target - half_before)),
        )
    )


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b) once for each pair of words(word) that differ by one inserted, deleted or replaced code point; a is the shorter, or the smaller of two equally long."""
    rare = staged(rare_bigrams(words), "rare")
    length = F.col("length")
    right = rare.select(F.col("word").alias("b"), F.explode(F.array_distinct(meeting_keys(length))).alias("key"))
    left = rare.select(F.col("word").alias("a"), F.explode(F.array_distinct(F.concat(meeting_keys(length), meeting_keys(length + 1)))).alias("key"))
    longer = F.length("a") < F.length("b")
    return left.join(right, "key").where((longer | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)).select("a", "b").distinct()


def chain_ends(links: DataFrame) -> DataFrame:
    """links(word, form) to (word, root): forms followed to the last, twice as far with each step."""
    far = links.select("word", F.col("form").alias("root"))
    for _ in range(DOUBLINGS):
        far = staged(far, "roots")
        on = far.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if far.select("root").join(on.select("root"), "root", "left_semi").isEmpty():
            break
        far = far.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return far


def spelling_forms(words: DataFrame, times: int = TIMES) -> DataFrame:
    """words(word, n) with unique words to (word, n, n_near, form, form_n, root)."""
    words = staged(words.select("word", "n"), "words")
    pairs = staged(near_pairs(words.select("word")), "near")
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("other_n")), "b")
    best = counted.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("b").alias("form"))).alias("best"))
    form_n = -F.col("best.less")
    kept = F.coalesce(form_n >= times * F.col("n"), F.lit(False))
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(kept, F.col("best.form")).alias("form"), F.when(kept, form_n).alias("form_n"))
    found = staged(found, "forms")
    roots = chain_ends(found.where("form IS NOT NULL").select("word", "form"))
    return found.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(word_counts(table(spark, sf_dir, "documents")))


ORACLE_SQL = """
WITH RECURSIVE steps AS (
  SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
    translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
), counted AS (
  SELECT id, run, count(*) AS n,
    flatten(list_transform(string_split(id || ':' || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)] ELSE [195, ord(x) - 64] END)) AS bytes
  FROM runs GROUP BY id, run
), checked AS (
  SELECT run, n, xor(4294967295, list_reduce([4294967295] || bytes, lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) AS h
  FROM counted, steps
), altered AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n
  FROM checked
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM altered WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), places AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words
), cut AS (
  SELECT word, n, left(word, i - 1) || '_' || substr(word, i + 1) AS masked, left(word, i - 1) || substr(word, i + 1) AS shorter FROM places
), pairs AS (
  SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.masked = b.masked AND a.word <> b.word
  UNION SELECT cut.word, words.word FROM cut JOIN words ON cut.shorter = words.word
  UNION SELECT words.word, cut.word FROM cut JOIN words ON cut.shorter = words.word
), best AS (
  SELECT a, count(*) AS n_near, arg_min({'word': b, 'n': n}, {'n': -n, 'word': b}) AS x FROM pairs JOIN words ON b = word GROUP BY a
), found AS (
  SELECT word, n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near,
    CASE WHEN x.n >= 5 * n THEN x.word END AS form, CASE WHEN x.n >= 5 * n THEN x.n END AS form_n
  FROM words LEFT JOIN best ON a = word
), walk AS (
  SELECT word, word AS root, 0 AS depth FROM found
  UNION ALL SELECT walk.word, found.form, depth + 1 FROM walk JOIN found ON walk.root = found.word WHERE found.form IS NOT NULL
), roots AS (
  SELECT word, arg_max(root, depth) AS root FROM walk GROUP BY word
)
SELECT word, n, n_near, form, form_n, root FROM found JOIN roots USING (word)
"""
