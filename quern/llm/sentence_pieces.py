"""SentencePiece encoding and decoding [operator 7] on the tokenizers library.

The model file's protobuf is read field by field; from it come the normaliser,
the metaspace marker, the pieces with their scores (as a unigram model, or as
merges in score order where the file holds a BPE model) and byte fallback.
Batches are encoded with THREADS threads: words not met before where no piece
crosses a word's end, else whole texts. The ids are always those of the
tokenizers library; `parity` says of every text whether the reference library
gives the same for what was encoded, word by word or as a whole.

Null and empty texts give no ids. Whole texts are encoded whatever their
length. Repeated rows give repeated results; rows are independent and extra
columns are ignored. The model's bytes (under 1 MB) travel with the task, so
executors need no file.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
import struct
from collections.abc import Callable
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import by_batch, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
THREADS = 2
#: Characters encoded at a time, or one text, and words remembered from one time to the next.
BATCH_CHARS, MOST_WORDS, WORDS_A_LIST = 1 << 20, 1 << 17, 512
SPACE = "▁"
#: Fixed values of the model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
_MARKED_WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class Model(NamedTuple):
    pieces: list[tuple[str, float, int]]
    kind: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool
    escape: bool


def _fields(data: bytes):
    """(number, value) of each field of one protobuf message; numbers of 4 and 8 bytes stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


def parse_model(data: bytes) -> Model:
    pieces, trainer, normal = [], {}, {}
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normal = dict(_fields(value))
    return Model(pieces, trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), normal.get(2, b""), bool(normal.get(3, 1)), bool(normal.get(4, 1)), bool(normal.get(5, 1)))


def cuts_at_markers(model: Model) -> bool:
    """No piece crosses from a letter to a marker, so each word with the markers before it is encoded by itself."""
    return model.escape and not any(SPACE in piece.lstrip(SPACE) for piece, _, _ in model.pieces)


def build_tokenizer(model: Model):
    """The same encoder and decoder in the tokenizers library."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    ids = {piece: i for i, (piece, _, _) in enumerate(model.pieces)}
    unknown = next((i for i, x in enumerate(model.pieces) if x[2] == UNKNOWN), 0)
    if model.kind == BPE:
        scored = {piece: score for piece, score, kind in model.pieces if kind in (NORMAL, USER_DEFINED)}
        merges = [(-score, ids[whole], k, whole) for whole, score in scored.items() for k in range(1, len(whole)) if whole[:k] in scored and whole[k:] in scored]
        merges = [(whole[:k], whole[k:]) for _, _, k, whole in sorted(merges)]
        core = models.BPE(ids, merges, unk_token=model.pieces[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback, cache_capacity=0)
    else:
        core = models.Unigram([(piece, score) for piece, score, _ in model.pieces], unknown, model.byte_fallback)
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if model.escape:
        steps.append(normalizers.Replace(" ", SPACE))
    out.normalizer = normalizers.Sequence(steps)
    if cuts_at_markers(model):
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE}+[^{SPACE}]*"), "isolated")
    strip = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    out.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
    return out


class Numbers(dict):
    """The next number for each new key."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


class Words:
    """Ids of words met so far, at most MOST_WORDS from one batch to the next, and whether the reference library agrees on each."""

    def __init__(self, model: Model, core, reference, decoder=None):
        self.encoder, self.reference, self.decoder, self.prefixed = core, reference, decoder, model.dummy_prefix
        self.marker = next((i for i, x in enumerate(model.pieces) if x[0] == SPACE), -1)
        #: A text decodes to its words one after the other: each begins with a marker, which is a piece, and each loses one blank.
        self.alone = decoder is not None and model.dummy_prefix and not model.charsmap and not model.squeeze and self.marker >= 0
        self.clear()

    def clear(self) -> None:
        self.places = Numbers()
        self.flat, self.sizes, self.same, self.hits = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
        self.back = np.zeros(0, bool)

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and how many each has."""
        lists = [words[k : k + WORDS_A_LIST] for k in range(0, len(words), WORDS_A_LIST)]
        found = self.encoder.encode_batch(lists, is_pretokenized=True, add_special_tokens=False)
        sizes = [np.bincount(np.array(x.word_ids, np.int64), minlength=len(own)) for x, own in zip(found, lists, strict=True)]
        return np.array([i for x in found for i in x.ids], np.int32), np.concatenate(sizes)

    def _agreed(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether the reference library gives the same for each word.

        It gets WORDS_A_LIST words at a time as one text, and each by itself
        only where that differs. Markers without a word would melt into the
        next word's and are always by themselves.
        """
        usual = np.array([w[0] == SPACE and w[-1] != SPACE for w in words], bool)
        own, counts, places = ids[np.repeat(usual, sizes)], sizes[usual], np.flatnonzero(usual)
        ends, single = np.append(0, np.cumsum(counts)), np.flatnonzero(~usual).tolist()
        lists = [places[k : k + WORDS_A_LIST].tolist() for k in range(0, len(places), WORDS_A_LIST)]
        for k, (part, theirs) in enumerate(zip(lists, self._reference_ids(["".join([words[i] for i in part]) for part in lists]), strict=True)):
            if not np.array_equal(own[ends[k * WORDS_A_LIST] : ends[min((k + 1) * WORDS_A_LIST, len(counts))]], np.array(theirs, np.int32)):
                single += part
        same, ends = np.ones(len(words), bool), np.cumsum(sizes)
        for k, theirs in zip(single, self._reference_ids([words[k] for k in single]), strict=True):
            same[k] = np.array_equal(ids[ends[k] - sizes[k] : ends[k]], theirs)
        return same

    def _reference_ids(self, marked: list[str]) -> list[list[int]]:
        """The reference library puts the first marker before a text itself; that marker alone would be no text."""
        if not self.prefixed:
            return self.reference.encode(marked, num_threads=1)
        return [ids if x != SPACE else [self.marker] for x, ids in zip(marked, self.reference.encode([x[1:] for x in marked], num_threads=1), strict=True)]

    def _restored(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether the word is known to be what its ids decode to.

        WORDS_A_LIST words are decoded at a time: where one doesn't come back, a
        character of it is missing in all of them. Those are known of none.
        """
        ends, out = np.append(0, np.cumsum(sizes)), np.zeros(len(words), bool)
        firsts = range(0, len(words), WORDS_A_LIST) if self.alone else ()
        back = self.decoder.decode_batch([ids[ends[k] : ends[min(k + WORDS_A_LIST, len(words))]].tolist() for k in firsts], skip_special_tokens=False) if firsts else []
        for k, text in zip(firsts, back, strict=True):
            part = words[k : k + WORDS_A_LIST]
            out[k : k + WORDS_A_LIST] = all(w[0] == SPACE for w in part) and text == "".join(part)[1:].replace(SPACE, " ")
        return out

    def forget(self) -> None:
        """Keeps the words met most often, half as many as fit, none met once."""
        best = np.argsort(-self.hits, kind="stable")[: MOST_WORDS // 2]
        best = best[self.hits[best] > 1]
        starts, names = np.cumsum(self.sizes) - self.sizes, list(self.places)
        flat, sizes, same, back = [self.flat[starts[k] : starts[k] + self.sizes[k]] for k in best], self.sizes[best], self.same[best], self.back[best]
        self.clear()
        self.places.update((names[k], i) for i, k in enumerate(best.tolist()))
        self.flat, self.sizes, self.same, self.back, self.hits = np.concatenate([self.flat, *flat]), sizes, same, back, np.ones(len(best), np.int64)

    def places_of(self, words: list[str]) -> np.ndarray:
        if len(self.places) > MOST_WORDS:
            self.forget()
        known, places = len(self.places), self.places
        at = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
        if len(places) > known:
            fresh = list(itertools.islice(places, known, None))
            ids, sizes = self._encoded(fresh)
            self.flat, self.sizes, self.same = np.concatenate([self.flat, ids]), np.append(self.sizes, sizes), np.append(self.same, self._agreed(fresh, ids, sizes))
            self.back = np.append(self.back, self._restored(fresh, ids, sizes))
            self.hits = np.append(self.hits, np.zeros(len(fresh), np.int64))
        self.hits += np.bincount(at, minlength=len(self.hits))
        return at


class Codec(NamedTuple):
    """Encoder and decoder, what is known of words where texts can be cut into them, and the reference library."""

    whole: object
    words: Words | None
    marked: Callable[[str], str]
    reference: object


@lru_cache(4)
def _loaded(data: bytes) -> Codec:
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    import sentencepiece
    from tokenizers import Tokenizer

    model = parse_model(data)
    whole, reference = build_tokenizer(model), sentencepiece.SentencePieceProcessor(model_proto=data)
    words = Words(model, Tokenizer(whole.model), reference, whole) if cuts_at_markers(model) else None
    plain = not model.charsmap and not model.squeeze
    marked = (lambda text: (SPACE if model.dummy_prefix else "") + text.replace(" ", SPACE)) if plain else whole.normalizer.normalize_str
    return Codec(whole, words, marked, reference)


def encode_texts(data: bytes, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
    """Ids of each text by the tokenizers library, and whether the reference library gives the same."""
    return checked_texts(data, texts)[:2]


def checked_texts(data: bytes, texts: list[str]) -> tuple[list[np.ndarray], list[bool], list[bool]]:
    """Ids of each text by the tokenizers library, whether the reference library gives the same, and whether all its words are known to decode to themselves.

    Where no piece crosses from a letter to a marker, a text's ids are its
    words' ids in a row, so the words not met before are the batch that both
    libraries encode.
    """
    codec = _loaded(data)
    if codec.words is None:
        ids = [x.ids if t else [] for x, t in zip(codec.whole.encode_batch_fast(texts, add_special_tokens=False), texts, strict=True)]
        same = [a == b for a, b in zip(ids, codec.reference.encode(texts, num_threads=1), strict=True)]
        return [np.array(x, np.int32) for x in ids], same, [False] * len(texts)
    words = codec.words
    parts = [_MARKED_WORDS.findall(codec.marked(t)) if t else [] for t in texts]
    at = words.places_of([w for part in parts for w in part])
    starts, taken = np.cumsum(words.sizes) - words.sizes, words.sizes[at]
    ends = np.append(0, np.cumsum(taken))
    ids = words.flat[np.arange(ends[-1]) + np.repeat(starts[at] - ends[:-1], taken)]
    first = np.cumsum([0, *map(len, parts)])
    none = lambda flags: (np.diff(np.append(0, np.cumsum(flags))[first]) == 0).tolist()
    return [ids[a:b] for a, b in zip(ends[first[:-1]].tolist(), ends[first[1:]].tolist(), strict=True)], none(~words.same[at]), none(~words.back[at])


def decode_ids(data: bytes, ids: list[list[int]]) -> list[str]:
    return _loaded(data).whole.decode_batch(ids, skip_special_tokens=False)


ENCODED = "doc_id bigint, ids array<int>, n_tokens bigint, n_byte_tokens bigint, tokens_sha256 string, parity boolean, restored boolean"


def encode_documents(docs: DataFrame, model_path: str = MODEL, keep_ids: bool = True) -> DataFrame:
    """docs(doc_id, text) with ids, their digest, parity, and whether decoding gives the text back (markers read as blanks)."""
    with open(model_path, "rb") as f:  # a parameter of the driver, not a table
        data = f.read()
    bytes_at = np.array([kind == BYTE for _, _, kind in parse_model(data).pieces])

    def step(batch: pa.RecordBatch):
        ids_in, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (last == first or size < BATCH_CHARS):
                size += len(texts[last])
                last += 1
            part = texts[first:last]
            ids, same, restored = checked_texts(data, part)
            # where a word isn't known to come back, the whole text is decoded
            rest = [k for k, known in enumerate(restored) if not known]
            for k, text in zip(rest, decode_ids(data, [ids[k].tolist() for k in rest]), strict=True):
                restored[k] = text == part[k].replace(SPACE, " ")
            columns = [
                pa.array(ids_in[first:last], pa.int64()), pa.array(ids if keep_ids else [None] * len(part), pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64()),
                pa.array([int(bytes_at[x].sum()) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids]),
                pa.array(same, pa.bool_()), pa.array(restored, pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in ENCODED.split(", ")])
            first = last

    return by_batch(docs.select("doc_id", "text"), step, ENCODED)


def decode_documents(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """encoded(doc_id, ids) to (doc_id, text); null ids give the empty text."""
    with open(model_path, "rb") as f:
        data = f.read()

    def step(batch: pa.RecordBatch):
        text = decode_ids(data, [x or [] for x in batch.column(1).to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(text, pa.string())], ["doc_id", "text"])

    return by_batch(encoded.select("doc_id", "ids"), step, "doc_id bigint, text string")


def op7_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), keep_ids=False).drop("ids")
