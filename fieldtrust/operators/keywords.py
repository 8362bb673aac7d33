"""Keyword lists, of a few words or a table, against texts: one pass over each text.

Words are held in plain arrays: their characters and a hash of their first ones. The hashes of all windows of a text are looked up
there, and what is found is compared character by character, so every place at which a word stands is known, overlapping or not. Of
each word the places that do not overlap its own earlier ones are counted, from the left, as a plain count of the word in the text does. A
table of keywords is counted first: up to ``WORDS`` of them (and ``CHARS`` characters) go to the tasks so; a larger one
is joined on the words' leading characters, so that nothing of it passes the driver.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtrust.functions import text as tx

#: The largest keyword table that tasks hold: some forty bytes a word and four a character.
WORDS, CHARS = 1_000_000, 16_000_000
#: So many words are looked for one by one, by their bytes, rather than in a table.
FEW = 32
#: Leading characters by which a larger table is joined.
LEAD = 6
#: Leading characters that are hashed, and windows or characters of one step.
HASHED, STEP = 16, 1 << 16
HITS = "array<struct<w:int,n:int>>"
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Words:
    """Distinct, non-empty words as arrays, to be looked for in texts."""

    def __init__(self, words: tuple[str, ...]):
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.start = np.cumsum(self.size) - self.size
        self.chars = _codes("".join(words))
        self.leads = []  # (length of the lead, hashes in order, their words, which mixed hashes there are)
        lead = np.minimum(self.size, HASHED)
        for n in np.unique(lead).tolist():
            of = np.flatnonzero(lead == n)
            h = np.zeros(len(of), np.uint64)
            for k in range(n):
                h = h * _BASE + self.chars[self.start[of] + k]
            order = np.argsort(h, kind="stable")
            bits = min(24, max(10, int(8 * len(of)).bit_length()))
            there = np.zeros(1 << bits, bool)
            there[(h * _MIX) >> np.uint64(64 - bits)] = True
            self.leads.append((n, h[order], of[order].astype(np.int32), there))

    def _candidates(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place, word) wherever the hash of a word's lead is that of a window."""
        longest = self.leads[-1][0] if self.leads else 0
        for lo in range(0, len(codes), STEP):
            c = codes[lo : lo + STEP + longest - 1].astype(np.uint64)
            h, k = np.zeros(min(STEP, len(c)), np.uint64), 0
            for n, hashes, of, there in self.leads:
                while k < n:
                    h = h[: max(0, len(c) - k)]
                    h *= _BASE
                    h += c[k : k + len(h)]
                    k += 1
                at = np.flatnonzero(there[(h * _MIX) >> np.uint64(64 - len(there).bit_length() + 1)])
                first, last = np.searchsorted(hashes, h[at]), np.searchsorted(hashes, h[at], "right")
                some = last > first
                at, first, many = at[some], first[some], (last - first)[some]
                which = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
                yield np.repeat(at, many) + lo, of[which]

    def places(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, word, place) of the words in texts that lie one behind the other in ``codes``, in that order."""
        found = []
        for at, w in self._candidates(codes):
            text = np.searchsorted(ends, at, "right")
            inside = at + self.size[w] <= ends[text]
            at, w, text = at[inside], w[inside], text[inside]
            for n in np.unique(self.size[w]).tolist():
                mine = np.flatnonzero(self.size[w] == n)
                for lo in range(0, len(mine), max(1, 4 * STEP // n)):
                    m = mine[lo : lo + max(1, 4 * STEP // n)]
                    same = (codes[at[m, None] + np.arange(n)] == self.chars[self.start[w[m], None] + np.arange(n)]).all(axis=1)
                    found.append((text[m[same]], w[m[same]], at[m[same]]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)
        text, w, at = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((at, w, text))
        return text[order], w[order], at[order]

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, word, how often), in that order."""
        codes = [_codes(t) for t in texts]
        ends = np.cumsum([len(c) for c in codes])
        text, w, at = self.places(np.concatenate([*codes, np.zeros(0, np.uint32)]), ends)
        new = np.ones(len(at), bool)
        new[1:] = (text[1:] != text[:-1]) | (w[1:] != w[:-1])
        first = np.flatnonzero(new)
        n = np.diff(first, append=len(at))
        overlaps = np.flatnonzero(~new[1:] & (at[1:] - at[:-1] < self.size[w[1:]])) + 1
        for r in np.unique(np.searchsorted(first, overlaps, "right") - 1).tolist():
            size, free, k = int(self.size[w[first[r]]]), 0, 0
            for p in at[first[r] : first[r] + n[r]].tolist():
                if p >= free:
                    free, k = p + size, k + 1
            n[r] = k
        return text[first], w[first], n


@lru_cache(maxsize=4)
def _automaton(words: tuple[str, ...]) -> Words:
    """The words' table; kept for further columns of the same list."""
    return Words(words)


def hits(text: str, words: Words) -> list[tuple[int, int]]:
    """(word, how often) of the words in a text, by their place in the list."""
    _, w, n = words.counts([text])
    return list(zip(w.tolist(), n.tolist(), strict=True))


def scanned(texts: pa.Array, words: Words) -> pa.Array:
    """``hits`` of each text. Of a batch's texts some are Python strings at a time, and what is found is held as plain numbers of eight bytes a hit."""
    ends, w, n = array("i", [0]), array("i"), array("i")
    some, chars = [], 0

    def count() -> None:
        text, which, many = words.counts(some)
        for total in (len(w) + np.cumsum(np.bincount(text, minlength=len(some)))).tolist() if some else ():
            ends.append(total)
        w.frombytes(which.astype(np.int32).tobytes())
        n.frombytes(many.astype(np.int32).tobytes())

    for t in texts:
        some.append(t.as_py() if t.is_valid else "")
        chars += len(some[-1])
        if chars >= STEP:
            count()
            some, chars = [], 0
    count()
    kinds = [pa.Array.from_buffers(pa.int32(), len(x), [None, pa.py_buffer(x)]) for x in (ends, w, n)]
    return pa.ListArray.from_arrays(kinds[0], pa.StructArray.from_arrays(kinds[1:], ["w", "n"]))


def matches(text: Column, words: tuple[str, ...]) -> Column:
    """Array of structs (w: place in ``words``, n: occurrences) of the words that occur, in the list's order; distinct, non-empty words."""
    words = tuple(words)
    if not words:
        return F.array().cast(HITS)
    if len(words) <= FEW:
        t = F.coalesce(text, F.lit(""))
        places = [F.struct(F.lit(i).alias("w"), F.when(t.contains(w), tx.occurrences(t, w)).otherwise(0).alias("n")) for i, w in enumerate(words)]
        return F.filter(F.array(*places), lambda x: x["n"] > 0).cast(HITS)

    table = _automaton(words)

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("w", T.IntegerType()), T.StructField("n", T.IntegerType())])))
    def scan(texts: pa.Array) -> pa.Array:
        return scanned(texts, table)

    return scan(F.coalesce(text, F.lit("")))


def words_of(found: Column, words: tuple[str, ...]) -> Column:
    """The words that ``matches`` found."""
    table = F.array(*[F.lit(w) for w in words])
    return F.transform(found, lambda x: F.get(table, x["w"]))


def covered(found: Column, words: tuple[str, ...]) -> Column:
    """Characters in words; words that overlap each count."""
    sizes = F.array(*[F.lit(len(w)) for w in words])
    return F.aggregate(found, F.lit(0), lambda a, x: a + x["n"] * F.get(sizes, x["w"]))


def _clean(keywords: DataFrame, tenants: bool) -> DataFrame:
    own = keywords if tenants else keywords.withColumn("tenant_id", F.lit(None).cast("long"))
    return own.where(F.length("word") > 0).select("tenant_id", "word").distinct()


def keyword_hits(texts: DataFrame, keywords: DataFrame, text: str = "text", tenant: str | None = None, bound: int = WORDS) -> DataFrame:
    """``texts`` with the keywords that occur in them: (texts' columns, word, occurrences), one row for each text and word.

    ``keywords(word)`` or, with ``tenant`` (a column of ``texts``), ``keywords(tenant_id, word)``, where a null ``tenant_id`` holds for
    all tenants. Case counts; words that are null or empty are left out and repeated ones count once. Rows of ``texts`` that are
    equal give a row each. Null texts have no words.
    """
    own = _clean(keywords, tenant is not None)
    size = own.select("word").distinct().agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("word")), F.lit(0)).alias("c")).first()
    if not size.n:
        return texts.select("*", F.lit("").alias("word"), F.lit(0).alias("occurrences")).where("false")
    return (_by_table if size.n <= bound and size.c <= CHARS else _by_lead)(texts, own, text, tenant)


def _by_table(texts: DataFrame, own: DataFrame, text: str, tenant: str | None) -> DataFrame:
    """Within the row: all tenants' words in one table, then those of other tenants left out."""
    of = F.when(~F.max(F.col("tenant_id").isNull()), F.array_sort(F.collect_set(F.col("tenant_id").cast("long")))).alias("_of")
    rows = own.groupBy("word").agg(of).orderBy("word").select("word", "_of").toArrow()  # at most WORDS
    found = texts.withColumn("_hits", matches(F.col(text), tuple(rows["word"].to_pylist())))
    out = found.select(*texts.columns, F.explode("_hits").alias("_hit"))
    # the words by their place, joined as a table no larger than that of the tasks: Spark broadcasts it by its size
    names = texts.sparkSession.createDataFrame(rows.add_column(0, "_w", pa.array(np.arange(len(rows), dtype=np.int32))))
    out = out.join(F.broadcast(names), F.col("_hit.w") == F.col("_w"))
    if tenant:
        out = out.where(F.col("_of").isNull() | F.coalesce(F.array_contains("_of", F.col(tenant).cast("long")), F.lit(False)))
    return out.select(*texts.columns, "word", F.col("_hit.n").alias("occurrences"))


def _by_lead(texts: DataFrame, own: DataFrame, text: str, tenant: str | None) -> DataFrame:
    """Texts' distinct substrings of the lengths that the words' leads have, joined with the words on (lead); candidates are counted in the text itself.

    Every text gets a number of its own, and the words found for it come together on that number, so texts are not sent with substrings.
    """
    from fieldtrust.operators.graph import checkpoint_dir

    checkpoint_dir(texts.sparkSession)
    numbered = texts.withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    words = own.withColumn("_lead", F.substring("word", 1, LEAD))
    lengths = [r.n for r in words.select(F.length("_lead").alias("n")).distinct().collect()]  # at most LEAD rows

    def substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                leads = sorted({t[k : k + n] for n in lengths for k in range(len(t) - n + 1)})
                for at in range(0, len(leads), 10_000):
                    some = leads[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(some), pa.int64()), pa.array(some, pa.string())], ["_id", "_lead"])

    pairs = numbered.where(F.length(text) > 0).select("_id", text).mapInArrow(substrings, "_id long, _lead string")
    # one row a lead tells whether any word begins so; only such leads stay
    candidates = pairs.join(words.select("_lead", "word").distinct(), "_lead").select("_id", "word")
    counted = candidates.join(numbered, "_id")
    # a count that does not overlap itself: what the text loses when the word is taken out of it
    n = ((F.length(text) - F.length(F.replace(F.col(text), F.col("word"), F.lit("")))) / F.length("word")).cast("int")
    out = counted.withColumn("occurrences", n).where("occurrences > 0")
    if tenant:
        mine = own.withColumnRenamed("tenant_id", "_tenant").withColumnRenamed("word", "_word")
        out = out.join(mine, (F.col("word") == F.col("_word")) & (F.col("_tenant").isNull() | (F.col("_tenant") == F.col(tenant).cast("long"))), "left_semi")
    return out.select(*texts.columns, "word", "occurrences")


def marketing_stats(texts: DataFrame, keywords: DataFrame, key: str, text: str = "text", tenant: str | None = None) -> DataFrame:
    """(key, keyword_count, keyword_chars, density) of every row of ``texts`` against a keyword table; rows without a word have zeros. ``key`` is unique."""
    found = keyword_hits(texts, keywords, text, tenant).groupBy(key).agg(F.count("*").alias("k"), F.sum(F.col("occurrences") * F.length("word")).alias("c"))
    n = F.col("_n")
    out = texts.select(key, F.length(text).alias("_n")).join(found, key, "left")  # no text is shuffled
    c = F.coalesce("c", F.lit(0))
    return out.select(key, F.coalesce("k", F.lit(0)).alias("keyword_count"), c.alias("keyword_chars"), F.when(n > 0, c / n).otherwise(0.0).alias("density"))


def match_features(texts: DataFrame, features: DataFrame, text: str = "text") -> DataFrame:
    """Texts and the active features of which some pattern occurs in them, case aside: (texts' columns, feature_id, n_patterns).

    ``features(feature_id, patterns, is_active)``; a pattern that a feature names twice counts twice. Patterns are counted within
    the row: nothing is shuffled with texts, and equal rows stay apart.
    """
    pats = features.where("is_active").select("feature_id", F.explode("patterns").alias("pattern")).where("pattern <> ''")
    pats = pats.select("feature_id", F.lower("pattern").alias("word")).groupBy("feature_id", "word").agg(F.count("*").alias("n"))
    size = pats.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("word")), F.lit(0)).alias("c")).first()
    if size.n > WORDS or size.c > CHARS:
        numbered = texts.select("*", F.monotonically_increasing_id().alias("_row"), F.lower(text).alias("_low"))
        from fieldtrust.operators.graph import checkpoint_dir

        checkpoint_dir(texts.sparkSession)
        numbered = numbered.checkpoint()
        found = _by_lead(numbered.select("_row", "_low"), pats.select(F.lit(None).cast("long").alias("tenant_id"), "word").distinct(), "_low", None)
        by = found.select("_row", "word").join(pats, "word").groupBy("_row", "feature_id").agg(F.sum("n").alias("n_patterns"))
        return numbered.join(by, "_row").select(*texts.columns, "feature_id", "n_patterns")
    kinds = features.schema["feature_id"].dataType
    rows = pats.groupBy("word").agg(F.collect_list(F.struct("feature_id", "n")).alias("f")).orderBy("word").collect()  # at most WORDS
    if not rows:
        return texts.select("*", F.lit(None).cast(kinds).alias("feature_id"), F.lit(0).cast("long").alias("n_patterns")).where("false")
    ids = sorted({x.feature_id for r in rows for x in r.f}, key=str)
    place = {f: i for i, f in enumerate(ids)}
    words = tuple(r.word for r in rows)
    per = tuple(tuple((place[x.feature_id], int(x.n)) for x in r.f) for r in rows)

    table = _automaton(words)

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("w", T.IntegerType()), T.StructField("n", T.IntegerType())])))
    def scan(texts: pa.Array) -> pa.Array:
        out = []
        for found in scanned(texts, table):
            n: dict[int, int] = {}
            for w in (x["w"] for x in found.as_py()):
                for f, k in per[w]:
                    n[f] = n.get(f, 0) + k
            out.append([{"w": f, "n": k} for f, k in sorted(n.items())])
        return pa.array(out, pa.list_(pa.struct([("w", pa.int32()), ("n", pa.int32())])))

    names = texts.sparkSession.createDataFrame(list(enumerate(ids)), T.StructType([T.StructField("_w", T.IntegerType()), T.StructField("feature_id", kinds)]))
    out = texts.withColumn("_hits", scan(F.coalesce(F.lower(text), F.lit("")))).select(*texts.columns, F.explode("_hits").alias("_hit"))
    return out.join(F.broadcast(names), F.col("_hit.w") == F.col("_w")).select(*texts.columns, "feature_id", F.col("_hit.n").cast("long").alias("n_patterns"))
