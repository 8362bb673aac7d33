"""Text as column expressions. A null text counts as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = "[\\u4e00-\\u9fa5]"
# fixed values: the full-width marks that count as punctuation
MARKS = '[，。！？、；："（）]'
STOPWORDS = ("的", "了", "是", "在", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上", "也", "很", "到", "说", "要", "去")


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("int")


def keyword_density(text: Column, word: str) -> Column:
    return F.when(F.length(text) > 0, occurrences(text, word) / F.length(text)).otherwise(0.0)


def normalize(text: Column) -> Column:
    """All white space out, four full-width marks to their plain forms."""
    return F.translate(F.regexp_replace(text_of(text), r"(?U)\s+", ""), "，。！？", ",.!?")


def features(text: Column) -> Column:
    t = text_of(text)
    return F.struct(
        F.length(t).alias("length"),
        F.regexp_count(t, F.lit(f"{HAN}+")).alias("word_count"),
        F.regexp_count(t, F.lit(MARKS)).alias("punctuation_count"),
        F.regexp_count(t, F.lit(r"(?U)\d")).alias("digit_count"),
        F.regexp_count(t, F.lit("[!！]")).alias("exclamation_count"),
    )


def marks_in(text: Column, marks: str) -> Column:
    """How many characters of a text are of a few literal ones, each looked for by its bytes."""
    return sum((F.length(text) - F.length(F.replace(text, F.lit(m), F.lit(""))) for m in marks), F.lit(0))


def mark_counts(text: Column) -> Column:
    """The parts of ``features`` that the punctuation rule asks for."""
    t = text_of(text)
    return F.struct(F.length(t).alias("length"), marks_in(t, MARKS[1:-1]).alias("punctuation_count"), marks_in(t, "!！").alias("exclamation_count"))


def is_stuffed(text: Column, max_repeat: int = 3) -> Column:
    """A character three (or ``max_repeat``) times in a row, or a phrase of Han characters said twice."""
    t = text_of(text)
    return t.rlike(r"([^\n])\1{%d,}" % max(2, max_repeat - 1)) | t.rlike(rf"({HAN}{{2,}})\1")


def matched(text: Column, words: tuple[str, ...]) -> Column:
    """The words of a literal list that occur in the text, in the list's order."""
    t = text_of(text)
    return F.array_compact(F.array(*[F.when(t.contains(w), F.lit(w)) for w in words]))


def covered_chars(text: Column, words: tuple[str, ...]) -> Column:
    t = text_of(text)
    total = F.lit(0)
    for w in words:
        total = total + F.length(t) - F.length(F.replace(t, F.lit(w), F.lit("")))
    return total


def ordered_union(*lists: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(w for x in lists for w in x))


def top_keywords(text: Column, n: int = 10) -> Column:
    """The most frequent runs of two or more Han characters, stop words aside; ties by first place."""
    runs = F.filter(F.regexp_extract_all(text_of(text), F.lit(f"{HAN}+"), F.lit(0)), lambda w: (F.length(w) >= 2) & ~w.isin(*STOPWORDS))
    ranked = F.transform(F.array_distinct(runs), lambda w: F.struct((-F.size(F.filter(runs, lambda v: v == w))).alias("n"), F.array_position(runs, w).alias("at"), w.alias("w")))
    return F.slice(F.transform(F.array_sort(ranked), lambda r: r["w"]), 1, n)


def shorten(text: Column, n: int = 100) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def strip_noise(value: Column) -> Column:
    """Null for null, empty and "null"; control characters out, ends trimmed."""
    cleaned = F.trim(F.regexp_replace(value, "[\\x00-\\x1f\\x7f-\\x9f]", ""))
    return F.when((value == "") | (value == "null"), F.lit(None)).otherwise(cleaned)


def phone(value: Column) -> Column:
    """Struct (phone, valid, kind): other characters out; mobile, landline or service number. Empty is valid."""
    v = text_of(value)
    c = F.regexp_replace(v, r"[^\d\-+]", "")
    kind = F.when(c.rlike(r"^1[3-9]\d{9}$"), "mobile").when(c.rlike(r"^0\d{2,3}-?\d{7,8}$"), "landline").when(c.rlike(r"^400-?\d{3}-?\d{4}$"), "service")
    return F.struct(F.when(v == "", value).otherwise(c).alias("phone"), ((v == "") | kind.isNotNull()).alias("valid"), F.when(v != "", kind).alias("kind"))


def business_hours(value: Column) -> Column:
    """Struct (valid, error) of the first two times."""
    hours = F.transform(F.regexp_extract_all(text_of(value), F.lit(r"(\d{1,2}):?(\d{2})?"), F.lit(1)), lambda h: h.cast("int"))
    a, b = F.get(hours, F.lit(0)), F.get(hours, F.lit(1))
    error = F.when(b.isNull(), None).when((a >= 24) | (b >= 24), "时间超出24小时制范围").when((a > b) & (b != 0), F.format_string("开始时间(%d:00)晚于结束时间(%d:00)", a, b))
    return F.struct(error.isNull().alias("valid"), error.alias("error"))


def positional_similarity(a: Column, b: Column) -> Column:
    """1 less the differing places of the common length by the longer length; 0 where one is empty. A longer tail only weighs in the length."""
    x, y = text_of(a), text_of(b)
    n = F.least(F.length(x), F.length(y))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    differ = F.size(F.filter(places, lambda i: F.substring(x, i, F.lit(1)) != F.substring(y, i, F.lit(1))))
    return F.when(n == 0, 0.0).otherwise(1.0 - differ / F.greatest(F.length(x), F.length(y)))


def address_completeness(address: Column) -> Column:
    """Share of the five parts an address can show."""
    t = text_of(address)
    parts = ("省|市|自治区|特别行政区", "市|县", "区|县", "路|街|道|巷", "号|栋|座|层")
    return sum((t.rlike(p).cast("int") for p in parts), F.lit(0)) / len(parts)


def marketing_share(text: Column, words: tuple[str, ...]) -> Column:
    """Share of the words of a list that a lower-cased text holds."""
    return F.size(matched(F.lower(text_of(text)), words)) / len(words)
