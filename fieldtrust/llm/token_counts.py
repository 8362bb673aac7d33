"""Greedy word-piece lengths from a linear longest-match automaton.

The vocabulary's trie gets failure links: where no longer match exists, the link says how many pieces (and unknown characters)
the text matched so far falls into and in which state matching goes on. Each character is read once, and only counts are kept,
never pieces.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrust.llm.common import short_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
CACHE = 400_000
LONG = 64


class LongestMatch:
    """Counts the pieces that greedy longest-match-first takes from a word; a character that no piece starts with counts ``unknown(char)``."""

    def __init__(self, pieces: Iterable[str], unknown=lambda c: len(c.encode("utf-8", "surrogatepass"))):
        self.unknown = unknown
        self.next: list[dict[str, int]] = [{}]
        final = [False]
        for p in pieces:
            at = 0
            for c in p:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    final.append(False)
                at = self.next[at][c]
            final[at] = bool(at)
        # fail[v]: the state after popped[v] pieces (and unknown characters) have been taken off the text that leads to v
        self.fail = [0] * len(self.next)
        self.popped = [0] * len(self.next)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for c, v in self.next[u].items():
                queue.append(v)
                if final[v]:
                    self.popped[v] = 1
                elif u == 0:
                    self.popped[v] = unknown(c)
                else:
                    self.fail[v], self.popped[v] = self._step(self.fail[u], c, self.popped[u])

    def _step(self, at: int, c: str, n: int) -> tuple[int, int]:
        """Where reading ``c`` leads from a state, with the count ``n`` and what is taken off on the way."""
        while c not in self.next[at]:
            if at == 0:
                return 0, n + self.unknown(c)
            n += self.popped[at]
            at = self.fail[at]
        return self.next[at][c], n

    def count(self, word: str) -> int:
        at, total = 0, 0
        for c in word:
            at, total = self._step(at, c, total)
        while at:
            total += self.popped[at]
            at = self.fail[at]
        return total


def greedy_count(word: str, pieces: set[str], longest: int) -> int:
    """The plain definition, for tests."""
    total = i = 0
    while i < len(word):
        k = next((k for k in range(min(longest, len(word) - i), 0, -1) if word[i : i + k] in pieces), 0)
        total += 1 if k else len(word[i].encode("utf-8", "surrogatepass"))
        i += k or 1
    return total


def vocabulary(path: str = MODEL) -> list[str]:
    """The normal pieces of a SentencePiece model: with the space mark they start words, without it they go on."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


class _Cache(dict):
    def __init__(self, automaton: LongestMatch):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(SPACE + word.decode("utf-8", "surrogatepass"))
        if len(word) <= LONG:  # a longer word is counted each time, so the memory is bounded in bytes too
            if len(self) >= CACHE:
                self.clear()
            self[word] = n
        return n


def token_counts(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n_words, n_tokens, n_bytes)``, one row for each input row, whole texts.

    Words are runs without ASCII white space. Null and empty texts have no words. Ids may be null or repeat; an empty table
    gives no rows; columns other than the two are not looked at.
    """

    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Cache(LongestMatch(vocabulary(model)))
        for b in batches:
            words, tokens, sizes = [], [], []
            for t in b.column(1).to_pylist():
                raw = (t or "").encode("utf-8", "surrogatepass")
                w = raw.split()
                words.append(len(w))
                tokens.append(sum(map(cache.__getitem__, w)))
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (words, tokens, sizes))], ["doc_id", "n_words", "n_tokens", "n_bytes"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_bytes long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
