"""SentencePiece encoding and decoding with the tokenizers library.

The model protobuf is read field by field, and its normaliser, space mark, piece scores (as a unigram model, or as merge
ranks where the model is BPE) and byte fallback are rebuilt as a ``tokenizers`` pipeline that encodes batches on several
threads. Its ids are the result. They are held against the SentencePiece runtime, and where the two differ (ties between merges
that give the same piece, which ranks cannot express) ``parity`` is false and that word or text takes the runtime's ids.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrust.llm.common import short_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BATCH_CHARS = 250_000
CACHE = 120_000
CACHE_CHARS = 4_000_000
LINE = 128
WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze_spaces: bool = True
    escape_spaces: bool = True


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protobuf message: number and value (varint as int, the rest as bytes)."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7

    while at < len(raw):
        key = varint()
        number, wire = key >> 3, key & 7
        if wire == 0:
            yield number, varint()
        else:
            n = {1: 8, 5: 4}.get(wire)
            n = varint() if n is None else n
            yield number, raw[at : at + n]
            at += n


def parse_model(raw: bytes) -> Model:
    m = Model()
    for number, value in _fields(raw):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for k, v in _fields(value):
                if k == 1:
                    piece = v.decode("utf-8")
                elif k == 2:
                    score = struct.unpack("<f", v)[0]
                elif k == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:
            for k, v in _fields(value):
                if k == 3:
                    m.kind = v
                elif k == 35:
                    m.byte_fallback = bool(v)
        elif number == 3:
            for k, v in _fields(value):
                if k == 2:
                    m.charsmap = v
                elif k == 3:
                    m.dummy_prefix = bool(v)
                elif k == 4:
                    m.squeeze_spaces = bool(v)
                elif k == 5:
                    m.escape_spaces = bool(v)
    return m


def merges(model: Model) -> list[tuple[str, str]]:
    """The pairs that make each normal piece, best score first."""
    rank = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, UNUSED)}
    score = {p: s for p, s, _ in model.pieces}
    out = []
    for p in rank:
        out += [(-score[p], rank[p[:k]], rank[p[k:]], p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in rank and p[k:] in rank]
    return [(a, b) for *_, a, b in sorted(out)]


def crosses_words(model: Model) -> bool:
    """Whether a piece has a space mark after another character; if none has, words with the marks before them are encoded apart."""
    return any(SPACE in p.lstrip(SPACE) for p, _, kind in model.pieces if kind in (NORMAL, UNUSED))


def build(model: Model):
    """A ``tokenizers.Tokenizer`` that encodes and decodes as the model does."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if any(kind == USER for *_, kind in model.pieces):
        raise ValueError("user-defined pieces are not supported")
    unk = next(i for i, x in enumerate(model.pieces) if x[2] == UNKNOWN)
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.squeeze_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.escape_spaces:
        steps.append(normalizers.Replace(" ", SPACE))
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(SPACE))
    if model.kind == UNIGRAM:
        tok = Tokenizer(models.Unigram([(p, s) for p, s, _ in model.pieces], unk, model.byte_fallback))
    elif model.kind == BPE:
        vocab = {p: i for i, (p, *_) in enumerate(model.pieces)}
        tok = Tokenizer(models.BPE(vocab, merges(model), unk_token=model.pieces[unk][0], fuse_unk=True, byte_fallback=model.byte_fallback))
    else:
        raise ValueError(f"model type {model.kind} is not supported")
    tok.normalizer = normalizers.Sequence(steps)
    if model.kind == BPE and not crosses_words(model):
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE}*[^{SPACE}]+|{SPACE}+"), "isolated")
    tail = [decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse()]
    tok.decoder = decoders.Sequence([*tail, decoders.Strip(" ", 1, 0)] if model.dummy_prefix else tail)
    tok.encode_special_tokens = True
    return tok


class _Encoder:
    """Ids, parity and round trip of texts; ids and offsets come as arrays."""

    def __init__(self, raw: bytes, threads: int, verify: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.threads = threads
        self.spec = parse_model(raw)
        self.tok, self.sp = build(self.spec), None
        if verify:
            from sentencepiece import SentencePieceProcessor

            self.sp = SentencePieceProcessor(model_proto=raw)
        self.plain = not (self.spec.charsmap or self.spec.squeeze_spaces)
        self.by_words = self.plain and self.spec.dummy_prefix and self.spec.escape_spaces and not crosses_words(self.spec)
        self.marked = np.array([p.startswith(SPACE) for p, *_ in self.spec.pieces], bool)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.pending: list[list[np.ndarray]] = [[], [], [], []]
        self.table = [np.empty(0, np.int32), np.zeros(1, np.int64), np.empty(0, bool), np.empty(0, bool)]

    def keep(self, words: list[str]) -> None:
        """Forget all words but those known ones that the texts in hand use again: the frequent ones stay."""
        flat, ends, parity, same = self.table
        old = {w: self.known[w] for w in words if w in self.known}
        k = np.fromiter(old.values(), np.int64, len(old))
        lens = ends[k + 1] - ends[k]
        upto = np.concatenate([[0], np.cumsum(lens)])
        self.table = [flat[np.arange(upto[-1]) + np.repeat(ends[k] - upto[:-1], lens)], upto, parity[k], same[k]]
        self.known = dict(zip(old, range(len(old)), strict=True))
        self.chars = sum(map(len, old))

    def batch(self, texts: list[str]) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
        """Ids by the rebuilt pipeline, held against the runtime where there is one, and decoded again."""
        ids = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        parity = np.ones(len(ids), bool)
        if self.sp:
            for k, theirs in enumerate(self.sp.encode(texts, num_threads=self.threads)):
                if ids[k] != theirs:
                    ids[k], parity[k] = theirs, False
        back = self.tok.decode_batch(ids, skip_special_tokens=False)
        whole = texts if self.plain else [self.tok.normalizer.normalize_str(t).replace(SPACE, " ").removeprefix(" " * self.spec.dummy_prefix) for t in texts]
        same = np.array([a == b.replace(SPACE, " ") for a, b in zip(back, whole, strict=True)], bool)
        return ids, parity, same

    def learn(self, words: list[str], line: int) -> None:
        """Encode new words, ``line`` of them to a text: with one mark each, at its front, a word begins where a piece with the mark does."""
        lines = [words[i : i + line] for i in range(0, len(words), line)]
        # the first mark is the one that the model puts before a text
        ids, parity, same = self.batch(["".join(x)[1:].replace(SPACE, " ") if x != [SPACE] else "" for x in lines])
        for x, own, ok, back in zip(lines, ids, parity, same, strict=True):
            own = np.array(own if x != [SPACE] else [self.tok.token_to_id(SPACE)], np.int32)
            starts = np.flatnonzero(self.marked[own]) if len(x) > 1 else np.zeros(1, np.int64)
            if len(x) > 1 and not (ok and back and len(starts) == len(x)):
                self.learn(x, 1)
                continue
            self.pending[0].append(own)
            self.pending[1].append(np.diff(np.append(starts, len(own))))
            self.pending[2].append(np.full(len(x), ok))
            self.pending[3].append(np.full(len(x), back))
            self.known.update(zip(x, range(len(self.known), len(self.known) + len(x)), strict=True))
            self.chars += sum(map(len, x))

    def settle(self) -> None:
        """Put what was learned into the table."""
        if not self.pending[0]:
            return
        flat, ends, parity, same = self.table
        lens = np.concatenate(self.pending[1])
        new = (np.concatenate(self.pending[0]), ends[-1] + np.cumsum(lens), np.concatenate(self.pending[2]), np.concatenate(self.pending[3]))
        self.table = [np.concatenate(p) for p in zip((flat, ends, parity, same), new, strict=True)]
        self.pending = [[], [], [], []]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, offsets, parity, round trip) of the texts."""
        if not self.by_words:
            ids, parity, same = self.batch(texts)
            return np.fromiter(chain.from_iterable(ids), np.int32), np.cumsum([0, *map(len, ids)]), parity, same
        words, counts = [], []
        for t in texts:
            own = WORDS.findall(SPACE + t.replace(" ", SPACE)) if t else []
            words += own
            counts.append(len(own))
        if len(self.known) > CACHE or self.chars > CACHE_CHARS:
            self.keep(words)
        if new := [w for w in dict.fromkeys(words) if w not in self.known]:
            self.learn([w for w in new if w.count(SPACE) == 1 and w != SPACE], LINE)
            self.learn([w for w in new if w.count(SPACE) != 1 or w == SPACE], 1)
        self.settle()
        flat, ends, parity, same = self.table
        k = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        lens = ends[k + 1] - ends[k]
        upto = np.concatenate([[0], np.cumsum(lens)])
        ids = flat[np.arange(upto[-1]) + np.repeat(ends[k] - upto[:-1], lens)]
        at = np.concatenate([[0], np.cumsum(counts)])
        good = lambda flag: np.diff(np.concatenate([[0], np.cumsum(~flag[k])])[at]) == 0
        return ids, upto[at], good(parity), good(same)


def encode(docs: DataFrame, model: str = MODEL, threads: int = 2, shipped: bool = False, verify: bool = True) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n_tokens, ids, parity, round_trip)``, one row for each input row.

    ``ids`` are the model's ids of the whole text, without begin and end marks. ``round_trip``: decoding gives back the
    normalised text. ``parity``: the rebuilt pipeline gave the runtime's ids by itself; null without ``verify``, when no
    runtime is loaded. Null and empty texts have no ids and are true in both; ids may be null or repeat, an empty table gives
    none, and columns other than the two are not looked at. ``model`` is a path that every executor has, or with ``shipped``
    a name sent by ``addFile``. Batches are bounded by their characters, so very long texts do not pile up in memory. Where no
    piece of the model reaches over a word's beginning, a text's ids are those of its words: each word is encoded and checked
    once a task, and a text's flags are true where those of all its words are.
    """
    kinds = "doc_id long, n_tokens long, ids array<int>, parity boolean, round_trip boolean"
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what earlier tasks left in a worker that Spark uses again
        with open(SparkFiles.get(model) if shipped else model, "rb") as f:
            encoder = _Encoder(f.read(), threads, verify)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars + len(texts[to]) <= BATCH_CHARS):
                    chars += len(texts[to])
                    to += 1
                ids, offsets, parity, same = encoder(texts[at:to])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                columns = [batch.column(0).slice(at, to - at), pa.array(np.diff(offsets), pa.int64()), lists, pa.array(parity) if verify else pa.nulls(to - at, pa.bool_()), pa.array(same)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "parity", "round_trip"])
                at = to

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, kinds)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``encoded(doc_id, ids)`` to ``(doc_id, text)``; null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(model, "rb") as f:
            tok = build(parse_model(f.read()))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tok.decode_batch([x or [] for x in b.column(1).to_pylist()], skip_special_tokens=False), pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
