"""Quality classifier [operator 4]: interpolated modified Kneser-Ney bigrams.

The model is trained on trusted text, the documents labelled good, and scores
every document in bits a token; a document is rejected where it needs more than
the QUANTILE of the trusted documents of its language. There are two models,
each of one half of the trusted documents (by a hash of the id); a document is
scored by the model of the other half, so trusted and other documents compare.

Every word of a trusted document has counts of its own: a word is 31 bits of its
hash, a bigram an exact 62-bit key of two words, the half one bit more. A word
that the half never saw costs UNKNOWN_BITS more than its share of what the
continuation counts leave.

The cost of a text is a sum of values, each under its own key: of each word its
lower order and, where another word follows, its backoff weight, and of each bigram
what it gains over both. All are kept in shards by key that grow with the input. The sums of each
word are made in the shards of the words from what each shard of bigrams has, and
go back to it for the gains. The questions of the documents are sharded, too: each
batch of documents asks each shard with four bytes a question and gets back a sum
for each document; a question about what is not in a shard of a hundred thousand keys
meets one of them by chance in one of 40,000 cases. Values are kept to 1/1024 bit. A
document asks once for each key and says how often it means it. Bigrams and words with HOT_SHARE of all occurrences are answered
where they are asked and do not travel, so no frequent word makes a hot shard. A batch
is named by where it stands and what it holds; a task that runs again reads the same
rows and names them alike.

The model's shards grow with the trusted text, and where there is much more other
text, several tasks share a shard's questions, each with a copy of the shard.

Trusted documents are found by a join on the id, without a bound: their ids are broadcast
up to BROADCAST_IDS, and beyond that texts move once to meet them. Which scored rows are
trusted is joined to the scores. Broadcast are also the hot values (at most 2 HOT of 12
bytes) and a bitmap of hashed words (4 MB), so that no question is asked about words that
were never seen: all of bounded size.

Null, empty and blank texts have no tokens and no bits and are rejected. Labels
that are null trust nothing; without trusted text nothing can be judged and all
documents with tokens are kept. A null language is a language; one without
trusted documents is judged by all trusted documents. Null ids are scored and
never trusted. Repeated rows get repeated results; very long texts are scored
whole; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quern.llm.blocks import BLOCK_CELLS, gathered, has_bits, set_bits
from quern.llm.bytetext import find_words, mix, string_slices, word_hashes
from quern.llm.common import by_batch, drop_staged, lean, settled, staged, staged_here, table

WORD_BITS = 31
WORDS = 1 << WORD_BITS
START, UNKNOWN = 0, 1
HALVES = 2
KEY_BITS = 2 * WORD_BITS
KEY_MASK = (1 << KEY_BITS) - 1
SCRAMBLE = 0x2545F4914F6CDD1D & KEY_MASK | 1
UNSCRAMBLE = pow(SCRAMBLE, -1, KEY_MASK + 1)
UNKNOWN_BITS = 20.0
#: A key is hot from this share of all occurrences; at most HOT bigrams and HOT words are.
HOT_SHARE, HOT = 2.0**-22, 1 << 20
QUANTILE, PRIOR_TOKENS = 0.999, 10
BATCH_BYTES = 4 << 20
#: Ids of trusted documents that are broadcast at most (32 MB); more are joined by shuffle.
BROADCAST_IDS = 4_000_000
BUCKETS = 1 << 16
TABLE = HALVES * WORDS
KEY_BYTES, KEY_TOP, DIGEST_BYTES, SUM_BYTES = 8, 3, 4, 6
MOST_TIMES = 2**32 - 1
#: Bits are kept in steps of 1 / FINE from LEAST_BITS on.
FINE, LEAST_BITS = 1024, -8192.0
SIEVE_BITS = 24
#: Groups in which sums of words are made, at least; they grow with the shards.
COARSE = 1 << 8
#: Trusted text of a shard of the model, text whose questions a task answers, and shards at most (more text is answered in slices).
SHARD_BYTES, SLICE_BYTES, MOST_SHARDS = 1 << 23, 64 << 20, 1 << 16


class Lower(NamedTuple):
    """What the lower order of each half needs besides a word's own continuations."""

    discounts: np.ndarray
    total: np.ndarray
    flat: np.ndarray
    unknown: np.ndarray


class Model(NamedTuple):
    """Values of the hot keys, the bits of an unknown word in each half, and a bitmap of the words that may be known."""

    hot_keys: np.ndarray
    hot_values: np.ndarray
    unknown: np.ndarray
    sieve: np.ndarray


def half_of(ids: pa.Array) -> np.ndarray:
    """Which half a document is in; null ids are in the first."""
    return (mix(ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) & np.uint64(1)).astype(np.int64)


def hashed_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word of all rows, none START or UNKNOWN, and the first word of each row."""
    starts, ends, first = find_words(buf, offsets)
    return np.maximum(word_hashes(buf, starts, ends) >> np.uint64(64 - WORD_BITS), np.uint64(UNKNOWN + 1)).astype(np.int64), first


def bigrams(words: np.ndarray, first: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(previous word, word) of each token in the half of its row; a row's first word follows START. Words of the second half count on from WORDS."""
    rows = np.repeat(half, np.diff(first))
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[first[:-1][first[:-1] < len(words)]] = START
    return before + rows * WORDS, words + rows * WORDS


def scramble(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    plain = (before & (WORDS - 1)) << WORD_BITS | word & (WORDS - 1)
    return (before >> WORD_BITS) << KEY_BITS | (plain * SCRAMBLE) & KEY_MASK


def unscramble(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    plain, base = ((keys & KEY_MASK) * UNSCRAMBLE) & KEY_MASK, (keys >> KEY_BITS) * WORDS
    return (plain >> WORD_BITS) + base, (plain & (WORDS - 1)) + base


def word_keys(word: np.ndarray) -> np.ndarray:
    """Keys of words that others follow; no bigram has them."""
    return scramble((word & ~np.int64(WORDS - 1)) + UNKNOWN, word)


def last_keys(word: np.ndarray) -> np.ndarray:
    """Keys of words that end a text; no bigram has them."""
    return scramble(word, np.full_like(word, UNKNOWN))


def pack(residues: np.ndarray, width: int = 3) -> bytes:
    return residues.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(data: bytes, width: int = 3) -> np.ndarray:
    rows = np.zeros((len(data) // width, 8), np.uint8)
    rows[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return rows.view("<i8").ravel().astype(np.int64)


def pack_sorted(residues: np.ndarray, width: int, top: int = 2) -> bytes:
    """Numbers byte by byte: the lower bytes as they are, the `top` upper ones, which hardly change from one to the next, deflated."""
    planes = residues.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width]
    return planes[: width - top].tobytes() + zlib.compress(planes[width - top :].tobytes(), 1)


def unpack_sorted(data: bytes, n: int, width: int, top: int = 2) -> np.ndarray:
    low = n * (width - top)
    rows = np.zeros((8, n), np.uint8)
    rows[: width - top] = np.frombuffer(data, np.uint8, low).reshape(width - top, n)
    rows[width - top : width] = np.frombuffer(zlib.decompress(data[low:]), np.uint8).reshape(top, n)
    return np.ascontiguousarray(rows.T).view("<i8").ravel().astype(np.int64)


def _unsigned(sums: np.ndarray) -> np.ndarray:
    """Whole numbers with the sign in the lowest bit."""
    whole = np.round(sums).astype(np.int64)
    return whole << 1 ^ whole >> 63


def _signed(coded: np.ndarray) -> np.ndarray:
    return coded >> 1 ^ -(coded & 1)


def digests(residues: np.ndarray, shift: int) -> np.ndarray:
    """The upper bits of keys in their shard, by which they are asked."""
    return residues >> (shift - 8 * DIGEST_BYTES)


def coded(bits: np.ndarray) -> bytes:
    """Three bytes a value, the upper ones deflated: the third hardly ever differs."""
    steps = np.round((bits - LEAST_BITS) * FINE).astype(np.int64)
    if len(steps) and not 0 <= steps.min() <= steps.max() < 1 << 24:
        raise ValueError(f"values of {bits.min():.1f} to {bits.max():.1f} bits don't fit")
    return pack_sorted(steps, 3, 2)


def decoded_bits(data: bytes, n: int) -> np.ndarray:
    return unpack_sorted(data, n, 3, 2) / FINE + LEAST_BITS


def squeezed(values: np.ndarray, kind: str) -> bytes:
    return zlib.compress(values.astype(kind).tobytes(), 1)


def expanded(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind)


def squeezed_counts(counts: np.ndarray) -> bytes:
    """Counts in four bytes each, or in eight where one needs them; the first byte says which."""
    width = 4 if counts.max(initial=0) < 1 << 32 else 8
    return bytes([width]) + squeezed(counts, f"<u{width}")


def expanded_counts(data: bytes) -> np.ndarray:
    return expanded(data[1:], f"<u{data[0]}").astype(np.int64)


def good_ids(labels: DataFrame) -> DataFrame:
    """Ids of the documents labelled good."""
    return labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()


def shard_shift(shards: int) -> int:
    """`shards` is a power of two, half of them for each half."""
    return KEY_BITS + 1 - (shards.bit_length() - 1)


def count_shards(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, keys, counts): the bigrams of trusted documents, merged shard by shard."""
    shift = shard_shift(shards)
    schema = "shard int, keys binary, counts binary"

    def rows(keys: np.ndarray, counts: np.ndarray):
        shard = keys >> shift
        borders = np.searchsorted(shard, np.arange(shards + 1))
        found = [s for s in range(shards) if borders[s + 1] > borders[s]]
        low = keys & ((1 << shift) - 1)
        parts = [slice(borders[s], borders[s + 1]) for s in found]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([pack_sorted(low[p], KEY_BYTES, KEY_TOP) for p in parts], pa.binary()), pa.array([squeezed_counts(counts[p]) for p in parts], pa.binary())], ["shard", "keys", "counts"])

    def run(batches):
        lean()
        held, size = [], 0
        for batch in batches:
            half = half_of(batch.column(0))
            for start, count, buf, offsets in string_slices(batch.column(1)):
                held.append(scramble(*bigrams(*hashed_words(buf, offsets), half[start : start + count])))
                size += len(held[-1])
                if size > 1 << 21:
                    yield from rows(*np.unique(np.concatenate(held), return_counts=True))
                    held, size = [], 0
        if size:
            yield from rows(*np.unique(np.concatenate(held), return_counts=True))

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        each = [expanded_counts(x) for x in group["counts"]]
        keys, inverse = np.unique(np.concatenate([unpack_sorted(x, len(n), KEY_BYTES, KEY_TOP) for x, n in zip(group["keys"], each, strict=True)]), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate(each)).astype(np.int64)
        return pd.DataFrame({"shard": [group["shard"].iloc[0]], "keys": [pack_sorted(keys, KEY_BYTES, KEY_TOP)], "counts": [squeezed_counts(counts)]})

    return docs.select("doc_id", "text").mapInArrow(run, schema).groupBy("shard").applyInPandas(merge, schema)


def _decoded(batch: pa.RecordBatch, shift: int):
    for shard, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        counts = expanded_counts(counts)
        yield unpack_sorted(keys, len(counts), KEY_BYTES, KEY_TOP) | int(shard) << shift, counts


def _size_bucket(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log(counts) * 2000, BUCKETS - 1).astype(np.int64)


def discounts_of(types: np.ndarray) -> np.ndarray:
    """Modified discounts for counts of 0, 1, 2, 3 and more from the numbers of types with counts 1 to 4."""
    n1, n2, n3, n4 = (float(x) for x in types[:4])
    if not n1 or not n2:
        return np.array([0, 0.75, 0.75, 0.75])
    y = n1 / (n1 + 2 * n2)
    d = [0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.clip(np.array(d), [0, 0.05, 0.05, 0.05], [0, 0.95, 1.95, 2.95])


def types_of(tables: DataFrame, shift: int) -> np.ndarray:
    """How many bigrams have a count in each bucket."""

    def fill(cells: np.ndarray, batch: pa.RecordBatch) -> None:
        for _, counts in _decoded(batch, shift):
            cells += np.bincount(_size_bucket(counts), minlength=BUCKETS)

    return gathered(tables, fill, BUCKETS, "int64")


def hot_limit(types: np.ndarray, share: float | None = None) -> int:
    """The bucket of the least frequent hot keys, from the numbers of keys in each."""
    least = (HOT_SHARE if share is None else share) * float((types * np.exp(np.arange(BUCKETS) / 2000)).sum())
    fits = np.flatnonzero((np.cumsum(types[::-1])[::-1] <= HOT) & (np.arange(BUCKETS) >= np.log(max(least, 1)) * 2000))
    return int(fits[0]) if len(fits) else BUCKETS


def words_of(whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of a shard of bigrams by their keys, and where each bigram's first and second are."""
    before, word = unscramble(whole)
    words, at = np.unique(np.concatenate([before, word]), return_inverse=True)
    order = np.argsort(word_keys(words))
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return words[order], place[at[: len(whole)]], place[at[len(whole) :]]


SUMS = "shard int, part int, words binary, heads binary, tails binary, weights binary"
SUM_NAMES = [f.split()[0] for f in SUMS.split(", ")]


def word_sums(tables: DataFrame, discounts: np.ndarray, shards: int) -> DataFrame:
    """(shard, part, words, heads, tails, weights): how many tokens follow each word, how many different words it follows, and its backoff weight.

    Where part is -1, `words` are all words of the shard, in the order of their
    keys; else there are the same sums for the words of the bigrams of a shard,
    in the order of words_of, from one of `part`.
    """
    shift, coarse = shard_shift(shards), min(shards, max(COARSE, shards >> 3))
    wide = shard_shift(coarse)

    def row(shard: int, part: int, words: np.ndarray | None, heads: np.ndarray, tails: np.ndarray, weights: np.ndarray) -> tuple:
        return int(shard), int(part), None if words is None else (words & (WORDS - 1)).astype("<u4").tobytes(), squeezed_counts(heads), squeezed_counts(tails), squeezed(weights, "<f4")

    def ask(batch: pa.RecordBatch):
        for source, (whole, counts) in zip(batch.column(0).to_pylist(), _decoded(batch, shift), strict=True):
            words, at, to = words_of(whole)
            heads, tails, weights = np.bincount(at, counts, len(words)), np.bincount(to, minlength=len(words)), np.bincount(at, discounts[np.minimum(counts, 3)], len(words))
            borders = np.searchsorted(word_keys(words) >> wide, np.arange(coarse + 1))
            out = [row(k, source, words[p], heads[p], tails[p], weights[p]) for k in range(coarse) if (p := slice(borders[k], borders[k + 1])).start < p.stop]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k < 2 else pa.binary()) for k, c in enumerate(zip(*out, strict=True))], SUM_NAMES)

    def add(group: pd.DataFrame) -> pd.DataFrame:
        coarse_shard = int(group["shard"].iloc[0])
        base = (coarse_shard << wide >> KEY_BITS) * WORDS
        each = [np.frombuffer(x, "<u4").astype(np.int64) + base for x in group["words"]]
        words, inverse = np.unique(np.concatenate(each), return_inverse=True)
        heads, tails = (np.bincount(inverse, np.concatenate([expanded_counts(x) for x in group[c]])).astype(np.int64) for c in ("heads", "tails"))
        weights = np.bincount(inverse, np.concatenate([expanded(x, "<f4") for x in group["weights"]])) / np.maximum(heads, 1)
        out, end = [], 0
        for source, x in zip(group["part"], each, strict=True):
            own = inverse[end : end + len(x)]
            end += len(x)
            out.append((source, coarse_shard, None, *row(0, 0, None, heads[own], tails[own], weights[own])[3:]))
        order = np.argsort(word_keys(words))
        fine = word_keys(words[order]) >> shift
        for shard in np.unique(fine):
            p = order[slice(*np.searchsorted(fine, [shard, shard + 1]))]
            out.append(row(shard, -1, words[p], heads[p], tails[p], weights[p]))
        return pd.DataFrame(out, columns=SUM_NAMES)

    return by_batch(tables, ask, SUMS).groupBy("shard").applyInPandas(add, SUMS)


def _words_in(batch: pa.RecordBatch, shift: int):
    """(words, heads, tails, weights) of each shard of all words."""
    for shard, words, heads, tails, weights in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        words = np.frombuffer(words, "<u4").astype(np.int64) + (int(shard) << shift >> KEY_BITS) * WORDS
        yield int(shard), words, expanded_counts(heads), expanded_counts(tails), expanded(weights, "<f4").astype(float)


def all_words(sums: DataFrame) -> DataFrame:
    return sums.where("part < 0").drop("part")


def _sieve_cells(word: np.ndarray) -> np.ndarray:
    return word >> (WORD_BITS - SIEVE_BITS)


def word_sieve(sums: DataFrame, shards: int) -> np.ndarray:
    """A bit for each cell of words with any counts: about what is in none nothing need be asked. START's cell is set."""
    shift = shard_shift(shards)

    def fill(cells: np.ndarray, batch: pa.RecordBatch) -> None:
        for _, words, *_ in _words_in(batch, shift):
            set_bits(cells, _sieve_cells(words))

    return gathered(all_words(sums), fill, HALVES << SIEVE_BITS >> 3, "uint8", bits=True)


def lower_order(sums: DataFrame, shards: int) -> tuple[Lower, int]:
    """What all words' continuations give, and the bucket of the least frequent hot words."""
    shift = shard_shift(shards)

    def fill(cells: np.ndarray, batch: pa.RecordBatch) -> None:
        for _, words, heads, tails, _ in _words_in(batch, shift):
            cells[:BUCKETS] += np.bincount(_size_bucket(np.maximum(heads, 1)), minlength=BUCKETS)
            low = tails > 0
            half = (words[low] >> WORD_BITS) * 8
            cells[BUCKETS : BUCKETS + 16] += np.bincount(half + np.minimum(tails[low], 5), minlength=16)
            cells[BUCKETS + 16 : BUCKETS + 32] += np.bincount(half, tails[low], 16).astype(np.int64)

    cells = gathered(all_words(sums), fill, BUCKETS + BLOCK_CELLS, "int64")
    counts = cells[BUCKETS : BUCKETS + 16].reshape(HALVES, 8)
    total = cells[BUCKETS + 16 : BUCKETS + 32 : 8].astype(float)
    low = np.stack([discounts_of(x[1:5]) for x in counts])
    cut = low[:, 1] * counts[:, 1] + low[:, 2] * counts[:, 2] + low[:, 3] * counts[:, 3:].sum(axis=1)
    left_over = np.where(total > 0, cut / np.maximum(total, 1), 1.0)
    flat = left_over / (counts.sum(axis=1) + 1)
    return Lower(low, np.maximum(total, 1), flat, UNKNOWN_BITS - np.log2(flat)), hot_limit(cells[:BUCKETS])


def lower_of(low: Lower, half: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Lower-order probability of words with `left` continuations."""
    return (left - low.discounts[half, np.minimum(left, 3)]) / low.total[half] + low.flat[half]


VALUES = "shard int, n int, keys binary, cost binary, hot_keys binary, hot_cost binary"
VALUE_NAMES = [f.split()[0] for f in VALUES.split(", ")]


def _values_row(shard: int, shift: int, keys: np.ndarray, cost: np.ndarray, hot: np.ndarray) -> tuple:
    cold = ~hot  # hot keys are never asked for
    low = digests(keys[cold] & ((1 << shift) - 1), shift)
    return int(shard), len(low), pack_sorted(low, DIGEST_BYTES), coded(cost[cold]), keys[hot].astype("<i8").tobytes(), cost[hot].astype("<f4").tobytes()


def word_values(sums: DataFrame, low: Lower, limit: int, shards: int) -> DataFrame:
    """Bits of each word beyond those of an unknown one, with those of its backoff weight where others follow it and without where it is last."""
    shift = shard_shift(shards)

    def step(batch: pa.RecordBatch):
        keys, costs, hots = [], [], []
        for _, words, heads, tails, weights in _words_in(batch, shift):
            half = words >> WORD_BITS
            own = np.where(tails > 0, -np.log2(np.where(tails > 0, lower_of(low, half, tails), 1.0)) - low.unknown[half], 0.0)
            after = np.where(heads > 0, -np.log2(np.maximum(weights, 1e-30)), 0.0)
            hot = _size_bucket(np.maximum(heads, 1)) >= limit
            keys += [word_keys(words), last_keys(words)]
            costs += [own + after, own]
            hots += [hot, hot]
        keys, costs, hots = np.concatenate(keys), np.concatenate(costs), np.concatenate(hots)
        order = np.argsort(keys)
        keys, costs, hots = keys[order], costs[order], hots[order]
        borders = np.searchsorted(keys >> shift, np.arange(shards + 1))
        out = [_values_row(s, shift, keys[p], costs[p], hots[p]) for s in range(shards) if (p := slice(borders[s], borders[s + 1])).start < p.stop]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k < 2 else pa.binary()) for k, c in enumerate(zip(*out, strict=True))], VALUE_NAMES)

    return by_batch(all_words(sums), step, VALUES)


def bigram_values(tables: DataFrame, sums: DataFrame, discounts: np.ndarray, low: Lower, limit: int, shards: int) -> DataFrame:
    """What each bigram gains over its backoff, negative."""
    shift = shard_shift(shards)

    def run(own: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        shard = int(own["shard"].iloc[0])
        counts = expanded_counts(own["counts"].iloc[0])
        whole = unpack_sorted(own["keys"].iloc[0], len(counts), KEY_BYTES, KEY_TOP) | shard << shift
        asked, at, to = words_of(whole)
        words = words.sort_values("part")
        heads, tails = (np.concatenate([expanded_counts(x) for x in words[c]]) for c in ("heads", "tails"))
        weights = np.concatenate([expanded(x, "<f4") for x in words["weights"]]).astype(float)
        if len(heads) != len(asked):
            raise ValueError("a shard of bigrams got back another number of words than it asked for")
        seen = gain(counts, discounts, heads[at], weights[at], lower_of(low, whole >> KEY_BITS, tails[to]))
        return pd.DataFrame([_values_row(shard, shift, whole, -seen, _size_bucket(counts) >= limit)], columns=VALUE_NAMES)

    return tables.groupBy("shard").cogroup(sums.where("part >= 0").groupBy("shard")).applyInPandas(run, VALUES)


def gain(counts: np.ndarray, discounts: np.ndarray, contexts: np.ndarray, backoff: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """How many bits a bigram seen `counts` times is better than one never seen after the same word."""
    seen = np.maximum(counts - discounts[np.minimum(counts, 3)], 0) / np.maximum(contexts, 1)
    return np.log2(1 + seen / (backoff * lower))


def fit_model(merged: DataFrame, shards: int) -> tuple[DataFrame, Model]:
    """The values of all keys in shards, and those of the hot keys."""
    at = len(staged_here())
    tables = staged(merged, "bigrams")
    types = types_of(tables, shard_shift(shards))
    discounts = discounts_of(types[_size_bucket(np.array([1, 2, 3, 4]))])
    settled(tables.sparkSession)
    sums = staged(word_sums(tables, discounts, shards), "words")
    settled(tables.sparkSession)
    scratch = staged_here()[at:]
    low, limit = lower_order(sums, shards)
    values = staged(word_values(sums, low, limit, shards).unionAll(bigram_values(tables, sums, discounts, low, hot_limit(types), shards)), "values")
    sieve = word_sieve(sums, shards)
    # the values are all that goes on; scratch tables go now, and shuffles with the collection of their plans
    drop_staged(tables.sparkSession, scratch)
    settled(tables.sparkSession)
    got = values.select("hot_keys", "hot_cost").collect()
    keys, cost = (np.concatenate([np.frombuffer(r[k], kind) for r in got] or [np.zeros(0, kind)]) for k, kind in (("hot_keys", "<i8"), ("hot_cost", "<f4")))
    order = np.argsort(keys, kind="stable")
    return values.select("shard", "n", "keys", "cost"), Model(keys[order], cost[order], low.unknown, sieve)


ASKED = "shard int, batch string, head boolean, sizes binary, keys binary, times binary, doc_ids array<bigint>, langs array<string>, n_tokens binary, bits binary, parts int"


def ask_shards(docs: DataFrame, model, shards: int) -> DataFrame:
    """Per batch of documents a head with what is known already, and one row of questions for each shard."""
    shift = shard_shift(shards)
    batch_bytes = max(BATCH_BYTES, shards << 9)  # so that a batch has something to ask of each shard

    def rows(texts: pa.Array, ids: pa.Array, langs: pa.Array, serial: int):
        other = HALVES - 1 - half_of(ids)
        m, keys, owners, tokens, bits, base = model.value, [], [], [], [], 0
        for _, count, buf, offsets in string_slices(texts):
            words, first = hashed_words(buf, offsets)
            owner = np.repeat(np.arange(count), np.diff(first)) + base
            half = other[base : base + count]
            before, word = bigrams(words, first, half)
            tokens.append(np.diff(first))
            whole = m.unknown[half] * np.diff(first)
            known_before, known_word = has_bits(m.sieve, _sieve_cells(before)), has_bits(m.sieve, _sieve_cells(word))
            last = np.zeros(len(word), bool)
            last[first[1:][np.diff(first) > 0] - 1] = True
            begin = np.flatnonzero(before & (WORDS - 1) == START)
            for asked, owned, key in ((slice(None), owner[begin], word_keys(before[begin])), (known_word, owner, np.where(last, last_keys(word), word_keys(word))), (known_before & known_word, owner, scramble(before, word))):
                key, owned = key[asked], owned[asked]
                at = np.minimum(np.searchsorted(m.hot_keys, key), max(0, len(m.hot_keys) - 1))
                hot = m.hot_keys[at] == key if len(m.hot_keys) else np.zeros(len(key), bool)
                whole += np.bincount(owned[hot] - base, m.hot_values[at[hot]], count)
                keys.append(key[~hot])
                owners.append(owned[~hot])
            bits.append(whole)
            base += count
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        order = np.lexsort((keys, owners, keys >> shift))
        keys, owners = keys[order], owners[order]
        # a document asks once for each key and says how often it means it
        own = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1]))[: len(keys)])
        times = np.minimum(np.diff(np.append(own, len(keys))), MOST_TIMES)
        keys, owners, shard = digests(keys[own] & ((1 << shift) - 1), shift), owners[own], keys[own] >> shift
        borders = np.searchsorted(shard, np.arange(shards + 1))
        found = [s for s in range(shards) if borders[s + 1] > borders[s]]
        name = f"{TaskContext.get().partitionId()}-{serial}-{zlib.crc32(b''.join(x.tobytes() for x in bits)):08x}"
        sizes = [squeezed(np.bincount(owners[borders[s] : borders[s + 1]], minlength=base), "<u4") for s in found]
        parts = [pack(keys[borders[s] : borders[s + 1]], DIGEST_BYTES) for s in found]
        often = [squeezed(times[borders[s] : borders[s + 1]], "<u4") for s in found]
        n, none = len(found), lambda kind: pa.nulls(len(found), kind)
        home = zlib.crc32(name.encode()) % shards
        columns = [
            ([home, *found], pa.int32()), ([name] * (n + 1), pa.string()), ([True] + [False] * n, pa.bool_()), ([None, *sizes], pa.binary()), ([None, *parts], pa.binary()), ([None, *often], pa.binary()),
            ([ids.cast(pa.int64()).to_pylist(), *none(pa.int64()).to_pylist()], pa.list_(pa.int64())), ([langs.to_pylist(), *none(pa.string()).to_pylist()], pa.list_(pa.string())),
            ([squeezed(np.concatenate(tokens), "<i8")] + [None] * n, pa.binary()), ([np.concatenate(bits).tobytes()] + [None] * n, pa.binary()), ([n] + [None] * n, pa.int32()),
        ]
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in columns], [f.split()[0] for f in ASKED.split(", ")])

    def run(batches):
        lean()
        held, size, serial = [], 0, 0
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                held.append(part)
                size += sum(len(x) for x in part.column(1).to_pylist() if x)
                if size >= batch_bytes:
                    yield from flush(held, serial)
                    held, size, serial = [], 0, serial + 1
        if held:
            yield from flush(held, serial)

    def flush(held, serial):
        whole = pa.Table.from_batches(held).combine_chunks()
        yield from rows(*(whole.column(k).combine_chunks() for k in (1, 0, 2)), serial)

    return docs.select("doc_id", "text", "lang").mapInArrow(run, ASKED)


ANSWERED = "batch string, head boolean, saved binary, doc_ids array<bigint>, langs array<string>, n_tokens binary, bits binary, parts int"


def answer(asked: DataFrame, tables: DataFrame, slices: int = 1) -> DataFrame:
    """Each shard's sums for the documents of each batch; `slices` tasks share a shard's batches, each with a copy of the shard."""

    def run(known: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        low = np.concatenate([unpack_sorted(x, n, DIGEST_BYTES) for x, n in zip(known["keys"], known["n"], strict=True)] or [np.zeros(0, np.int64)])
        cost = np.concatenate([decoded_bits(x, n) for x, n in zip(known["cost"], known["n"], strict=True)] or [np.zeros(0)])
        order = np.argsort(low)
        low, cost = low[order], cost[order]
        saved = []
        for head, sizes, keys, times in zip(questions["head"], questions["sizes"], questions["keys"], questions["times"], strict=True):
            if head:
                saved.append(None)
                continue
            sizes, keys = expanded(sizes, "<u4"), unpack(keys, DIGEST_BYTES)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(low, keys), max(0, len(low) - 1))
            more = np.where(low[at] == keys, cost[at], 0) * expanded(times, "<u4") if len(low) else np.zeros(len(keys))
            saved.append(pack_sorted(_unsigned(np.bincount(owner, more, len(sizes)) * FINE), SUM_BYTES, SUM_BYTES))
        return questions.assign(saved=saved)[[f.split()[0] for f in ANSWERED.split(", ")]]

    copies = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))) if slices > 1 else F.lit(0)
    own = F.pmod(F.xxhash64("batch"), F.lit(slices)).cast("int") if slices > 1 else F.lit(0)
    shared = tables.withColumn("slice", copies)
    return shared.groupBy("shard", "slice").cogroup(asked.withColumn("slice", own).groupBy("shard", "slice")).applyInPandas(run, ANSWERED)


SCORED = "doc_id bigint, lang string, n_tokens bigint, total_bits double"


def add_up(answers: DataFrame) -> DataFrame:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        heads, rest = group[group["head"]], group[~group["head"].astype(bool)]
        if len(heads) != 1 or len(rest) != heads["parts"].iloc[0]:
            raise ValueError("a batch of documents was cut differently when it was read again")
        head = heads.iloc[0]
        bits = np.frombuffer(head["bits"], "<f8").copy()
        for x in rest["saved"]:
            bits += _signed(unpack_sorted(x, len(bits), SUM_BYTES, SUM_BYTES)) / FINE
        return pd.DataFrame({"doc_id": pd.array(list(head["doc_ids"]), "Int64"), "lang": list(head["langs"]), "n_tokens": expanded(head["n_tokens"], "<i8"), "total_bits": bits})

    return answers.groupBy("batch").applyInPandas(run, SCORED)


def score_documents(docs: DataFrame, labels: DataFrame, shards: int | None = None, slices: int | None = None) -> DataFrame:
    """docs(doc_id, text, lang) to (doc_id, lang, trusted, n_tokens, total_bits); shards, a power of two, and slices are made from the texts' sizes where they aren't given."""
    docs, good = docs.select("doc_id", "text", "lang"), staged(good_ids(labels), "good")
    near = F.broadcast(good) if good.count() <= BROADCAST_IDS else good
    trusted = docs.join(near, "doc_id", "left_semi").select("doc_id", "text")

    size = lambda rows: rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = shards or 1 << max(5, min(MOST_SHARDS.bit_length() - 1, (size(trusted) // SHARD_BYTES).bit_length()))
    slices = slices or -(-size(docs) // (shards * SLICE_BYTES)) or 1
    tables, model = fit_model(count_shards(trusted, shards), shards)
    model = docs.sparkSession.sparkContext.broadcast(model)
    scored = add_up(answer(ask_shards(docs, model, shards), tables, slices))
    marked = scored.join(near.withColumn("good", F.lit(True)), "doc_id", "left")
    return marked.select("doc_id", "lang", F.col("good").isNotNull().alias("trusted"), "n_tokens", "total_bits")


def judge(scored: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """Adds bits (a token, drawn to the language's mean by PRIOR_TOKENS), perplexity, limit and keep.

    Limits are exact quantiles of bits in steps of 1/1000: counts of steps per
    language are summed before the shuffle, so languages of any size are a
    few thousand rows.
    """
    key = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    scored = staged(scored.withColumn("key", key), "scored")
    trusted = scored.where("trusted AND n_tokens > 0")
    means = trusted.groupBy("key").agg((F.sum("total_bits") / F.sum("n_tokens")).alias("mean"))
    overall = trusted.agg((F.sum("total_bits") / F.sum("n_tokens")).alias("mean")).first()["mean"]
    few = means.count() <= 10_000
    smoothed = (F.col("total_bits") + PRIOR_TOKENS * F.coalesce("mean", F.lit(overall or 0.0))) / (F.col("n_tokens") + PRIOR_TOKENS)

    def with_bits(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(means) if few else means, "key", "left").withColumn("bits", F.when(F.col("n_tokens") > 0, smoothed))

    steps = with_bits(trusted).withColumn("step", F.ceil(F.col("bits") * 1000)).groupBy("key", "step").agg(F.count(F.lit(1)).alias("n"))
    everywhere = steps.groupBy("step").agg(F.sum("n").alias("n")).withColumn("key", F.lit("*"))
    steps = steps.select("key", "step", "n").unionAll(everywhere.select("key", "step", "n"))
    up_to = F.sum("n").over(W.partitionBy("key").orderBy("step").rowsBetween(W.unboundedPreceding, 0))
    limits = steps.withColumn("below", up_to).withColumn("all", F.sum("n").over(W.partitionBy("key"))).where(F.col("below") >= quantile * F.col("all")).groupBy("key").agg((F.min("step") / 1000).alias("limit"))
    limits = staged(limits, "limits")
    general = limits.where("key = '*'").first()
    fallback = F.lit(general["limit"] if general else float("inf"))
    own = limits.where("key <> '*'")
    judged = with_bits(scored).join(F.broadcast(own) if few else own, "key", "left").withColumn("limit", F.coalesce("limit", fallback))
    return judged.select("doc_id", "lang", "trusted", "n_tokens", F.round("bits", 4).alias("bits"), F.round(F.pow(F.lit(2.0), "bits"), 3).alias("perplexity"), "limit", F.coalesce(F.col("bits") <= F.col("limit"), F.lit(False)).alias("keep"))


def op4_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
