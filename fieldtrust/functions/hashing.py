"""Fingerprints and simple encodings as column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts whose code points are counted at once.
HISTOGRAM_ROWS = 1024


def grams(text: Column, n: int = 2) -> Column:
    """Character n-grams; a shorter text is its own gram, an empty one has none. Characters are split once: taking substrings of a long text by place would read it from its start each time."""
    t = F.coalesce(text, F.lit(""))
    chars = F.filter(F.split(t, ""), lambda c: c != "")
    out = chars
    for k in range(1, n):
        out = F.zip_with(out, F.slice(chars, F.lit(k + 1), F.greatest(F.length(t), F.lit(1))), lambda a, b: F.concat(a, b))
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).when(F.length(t) < n, F.array(t)).otherwise(F.filter(out, lambda g: g.isNotNull()))


def md5_low(text: Column) -> Column:
    """The low 64 bits of an MD5, as two's complement."""
    h = F.md5(text.cast("binary"))
    high, low = F.conv(F.substring(h, 17, 8), 16, 10).cast("long"), F.conv(F.substring(h, 25, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def simhash64(text: Column, bits: int = 64) -> Column:
    """Majority of the bits of the grams' hashes; a tie leaves the bit unset."""
    hashes = F.transform(grams(text), md5_low)

    def bit(k: Column) -> Column:
        ones = F.aggregate(hashes, F.lit(0), lambda a, h: a + F.getbit(h, k).cast("int"))
        return F.when(ones * 2 > F.size(hashes), F.expr("1L")).otherwise(F.expr("0L"))

    out = F.lit(0).cast("long")
    for k in range(bits):
        out = out.bitwiseOR(F.shiftleft(bit(F.lit(k)), k))
    return out


def polynomial31(text: Column) -> Column:
    """h * 31 + code point, kept to 32 bits."""
    chars = F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0).cast("long"), lambda h, c: (h * 31 + F.ascii(c)).bitwiseAND(F.lit(0xFFFFFFFF)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def histogram(text: Column, bins: int = 256) -> Column:
    """Code points modulo ``bins``, as a vector of length 1; all zero for the empty text. All code points of a batch are counted at once, by the text they are of."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def counted(texts: pa.Array) -> pa.Array:
        vectors = []
        for at in range(0, len(texts), HISTOGRAM_ROWS):
            codes = [(t or "").encode("utf-32-le", "surrogatepass") for t in texts.slice(at, HISTOGRAM_ROWS).to_pylist()]
            of = np.repeat(np.arange(len(codes)), [len(c) // 4 for c in codes])
            n = np.bincount(of * bins + np.frombuffer(b"".join(codes), np.uint32) % bins, minlength=len(codes) * bins).reshape(-1, bins).astype(np.float64)
            length = np.sqrt((n * n).sum(axis=1, keepdims=True))
            vectors.append(np.divide(n, length, out=np.zeros_like(n), where=length > 0).ravel())
        flat = np.concatenate(vectors) if vectors else np.zeros(0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * bins), pa.array(flat))

    return counted(F.coalesce(text, F.lit("")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def dedup_key(name: Column, address: Column) -> Column:
    return F.md5(F.concat(F.coalesce(name, F.lit("")), F.coalesce(address, F.lit(""))))


def device_bucket(device_id: Column) -> Column:
    return F.crc32(device_id.cast("binary")) % 100 / 100
