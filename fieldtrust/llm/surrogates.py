"""Surrogates for personal data: keyed, of the same kind, format, script and gender, and distinct. DataFrame functions only.

Mentions are found by one pattern. Each stands for an entity (its kind and its normal form, so that spellings of one phone
number or name agree). Entities get replacements drawn from a keyed hash; where two would get the same one, or one that some
entity of the corpus really has, the later draws again until all differ. Texts are put together from the pieces around the
mentions and the replacements in each mention's own format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldtrust.llm.common import checkpointed, written
from fieldtrust.llm.decontamination import text_key

#: Where the key of the registered query and the pipeline is set; without it the test tables get a key that protects nothing.
KEY_SETTING = "spark.fieldtrust.surrogateKey"
TEST_KEY = "test tables only"
ROUNDS = 40
WIDEN = 3  # a name gets one more syllable every so many draws, an e-mail address one more character after the first so many
# fixed values: forms of address by gender
MALE = ("Mr", "Herr", "Monsieur", "Señor", "господин", "κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "госпожа", "κυρία")
NEUTRAL = ("Dr", "Prof", "Professor")
PARTICLES = ("van", "von", "de", "der", "den", "del", "della", "di", "da", "dos", "du", "la", "le", "ten", "ter", "bin", "al")
#: Words after which ten digits in a row are a phone number.
CUES = ("phone", "tel", "telephone", "call", "mobile", "cell", "fax", "whatsapp")
BARE, CAPITALS = "\x01", "\x02"  # before the form of a name that a text also has with a form of address: as it is, in capitals
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
WORD = r"\p{L}\p{N}._%+\-"
HEX = "[0-9A-Fa-f]{1,4}"
PARTICLE = rf"(?:(?:{'|'.join(PARTICLES)}) ){{0,3}}"
#: One word of a name: Smith, Jean-Luc, O'Brien. A possessive's end is no part of it.
NAME = r"(?:\p{Lu}\p{L}+(?:['’\-]\p{Lu}\p{L}+)*|\p{Lu}(?:['’]\p{Lu}\p{L}+)+)"
#: What of a name is replaced; particles, single letters and the marks between stay.
PIECE = r"(?<!\p{L})\p{Lu}\p{L}+"
BARE_PHONE = r"[2-9]\d{2}[2-9]\d{6}"
PHONES = (
    r"(?<![\d+])(?:\+\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3}[ .\-]?\d{4}(?!\d)",
    r"(?<![\d+])\+\d{1,3}[ .\-]\d{2,4}[ .\-]\d{3,4}[ .\-]\d{3,4}(?!\d)",
    r"(?<![\d+])\+\d{8,15}(?!\d)",
    r"(?<![\d+.\-])00\d{1,3}[ .\-]\d{2,4}[ .\-]\d{3,4}[ .\-]\d{3,4}(?!\d)",
    r"(?<![\d+.,\-])0\d{2,4}[ .\-]\d{3,4}[ .\-]\d{3,4}(?![\d\-]|[.,]\d)",
    r"(?<![\d\-])(?:1-)?\d{3}-\d{3}-\d{4}(?![\d\-])",
    r"(?<![\d+.,\-])[2-9]\d{2}(?:\.[2-9]\d{2}\.| [2-9]\d{2} )\d{4}(?![\d\-]|[.,]\d)",
    rf"(?<!\d){BARE_PHONE}(?!\d)(?<=(?i:{'|'.join(CUES)})[.: ]{{1,3}}\d{{10}})",
)
PATTERNS = {
    "email": rf"(?<![{WORD}])[{WORD}]++@[\p{{L}}\p{{N}}\-]++(?:\.[\p{{L}}\p{{N}}\-]++)+",
    "ipv4": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)",
    "phone": rf"(?=[\d+(])(?:{'|'.join(PHONES)})",  # one look at most places, not eight
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}([ \-])\d{4}\1\d{4}\1\d{4})(?!\d)",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "secret": r"(?<![\p{L}\p{N}])(?=[^\d\s]*\d)(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36})(?![\p{L}\p{N}])",
    "ipv6": rf"(?<![\p{{L}}\p{{N}}:.])(?=[A-Fa-f:]*[0-9])(?:(?:{HEX}:){{7}}{HEX}|(?:{HEX}:){{1,6}}(?::{HEX}){{1,6}})(?![\p{{L}}\p{{N}}:])",
    "person": rf"(?<!\p{{L}})(?:{'|'.join(sorted((*MALE, *FEMALE, *NEUTRAL), key=len, reverse=True))})\.? {PARTICLE}{NAME}(?: {PARTICLE}{NAME}){{0,3}}(?!\p{{L}})",
}
KINDS = ("email", "secret", "iban", "card", "ssn", "phone", "ipv4", "ipv6", "person")
PATTERN = "|".join(f"(?:{PATTERNS[k]})" for k in KINDS)
#: What every text with a mention has; cheap to look for, and all others pass by untouched and unshuffled.
DIGIT_OR_AT = "[0-9@]"
TITLE = r"[MHFSDPгκ](?:rs?|s|iss|onsieur|adame|err|rau|eñora?|rof|rofessor|осподин|оспожа|ύριος|υρία)\.? " + PARTICLE + r"\p{Lu}"
ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
SYLLABLES = {
    "latin": (("ba", "de", "fi", "ga", "ho", "ju", "ka", "le", "mi", "no", "pa", "ro", "sa", "te", "vi", "zu"), ("n", "r", "s", "l"), ("a", "ia", "ina", "ella"), ("e", "y", "is", "en")),
    "cyrillic": (("ба", "ве", "ги", "да", "жо", "ку", "ла", "ме", "ни", "по", "ра", "со", "та", "фе", "ви", "зу"), ("н", "р", "с", "л"), ("а", "ия", "ина", "елла"), ("о", "и", "ин", "ер")),
    "greek": (("βα", "γε", "δι", "θα", "κο", "λυ", "μα", "νε", "πι", "ρο", "σα", "τε", "φι", "χα", "ζε", "λο"), ("ς", "νος", "ρος", "λης"), ("α", "ια", "ινα", "ελλα"), ("ι", "ο", "υς", "ων")),
}


def _luhn_sum(digits: str, upto: str) -> str:
    """SQL: the Luhn sum of the characters 1..upto of ``digits`` with a check digit to follow."""
    d = f"cast(substring({digits}, i, 1) as int)"
    return f"aggregate(sequence(1, {upto}), 0, (s, i) -> s + CASE WHEN ({upto} - i) % 2 = 0 THEN CASE WHEN {d} > 4 THEN 2 * {d} - 9 ELSE 2 * {d} END ELSE {d} END)"


def _kind(form: str) -> Column:
    digits = f"regexp_replace({form}, '[^0-9]', '')"
    card = f"({_luhn_sum(digits, f'(length({digits}) - 1)')} + cast(right({digits}, 1) as int)) % 10 = 0"
    k = F.when(F.expr(f"instr({form}, '@') > 0"), "email")
    for kind in ("secret", "iban", "card", "ssn", "phone", "ipv4", "ipv6", "person"):
        # the word that made ten digits a phone number is not in the form
        hit = F.expr(form).rlike(f"^(?:{PATTERNS[kind]}{'|' + BARE_PHONE if kind == 'phone' else ''})$")
        # a long number that fails its check digit is not a card, and a hash made of digits only is one of those numbers
        k = k.when(hit, F.when(F.expr(card), "card").otherwise("none")) if kind == "card" else k.when(hit, kind)
    return k.otherwise("none")


def _byte(i: str) -> str:
    return f"cast(conv(substring(stream, 1 + 2 * (({i}) % 63), 2), 16, 10) as int)"


def _pick(alphabet: str, i: str) -> str:
    return f"substring('{alphabet}', 1 + {_byte(i)} % {len(alphabet)}, 1)"


def _by_class(start: str = "0") -> str:
    """SQL: every digit and letter of ``norm`` from ``start`` on replaced by one of its class and script."""
    return f"""array_join(transform(split(norm, ''), (c, i) -> CASE WHEN i < {start} THEN c
        WHEN c rlike '[0-9]' THEN {_pick('0123456789', 'i')} WHEN c rlike '[A-Z]' THEN {_pick(ALPHABETS['latin'].upper(), 'i')}
        WHEN c rlike '\\\\p{{IsCyrillic}}' THEN {_pick(ALPHABETS['cyrillic'], 'i')} WHEN c rlike '\\\\p{{IsGreek}}' THEN {_pick(ALPHABETS['greek'], 'i')}
        WHEN c rlike '\\\\p{{L}}' THEN {_pick(ALPHABETS['latin'], 'i')} ELSE c END), '')"""


def _name(script: str, family: bool) -> str:
    syl, male, female, either = SYLLABLES[script]
    one = lambda xs, i: f"element_at(array({', '.join(repr(x) for x in xs)}), 1 + {_byte(i)} % {len(xs)})"
    body = ", ".join(one(syl, str(k)) for k in range(4 if family else 3))
    body += f", array_join(transform(slice(sequence(10, 62), 1, attempt div {WIDEN}), i -> {one(syl, 'i')}), '')"
    if family:
        return f"concat({body}, {one(male, '9')})"
    return f"concat({body}, CASE WHEN kind like '%female%' THEN {one(female, '9')} WHEN kind like '%any%' THEN {one(either, '9')} ELSE {one(male, '9')} END)"


def _draw() -> Column:
    """The replacement of (kind, norm) for the current ``attempt``; in lower case where case is the mention's."""
    digits = lambda keep, first: f"array_join(transform(split(norm, ''), (c, i) -> CASE WHEN i < {keep} THEN c WHEN i = {keep} THEN {first} ELSE {_pick('0123456789', 'i')} END), '')"
    phone = digits("greatest(0, length(norm) - 10)", _pick("23456789", "i"))
    body = f"left({digits('1', _pick('0123456789', 'i'))}, length(norm) - 1)"
    card = f"concat({body}, cast((10 - {_luhn_sum(body, '(length(norm) - 1)')} % 10) % 10 as string))"
    ssn = digits("0", "'9'")
    ipv4 = f"concat_ws('.', 240 + {_byte('0')} % 15, {_byte('1')}, {_byte('2')}, {_byte('3')})"
    groups = ", ".join(f"concat({', '.join(_pick('0123456789abcdef', str(4 * g + k)) for k in range(4))})" for g in range(1, 8))
    ipv6 = f"concat_ws(':', concat('fd', {_pick('0123456789abcdef', '2')}, {_pick('0123456789abcdef', '3')}), {groups})"
    hexed = f"array_join(transform(split(norm, ''), (c, i) -> {_pick('0123456789abcdef', 'i')}), '')"
    secret = f"CASE WHEN norm rlike '^[0-9a-f]+$' THEN {hexed} ELSE {_by_class('4')} END"
    # more characters of the first one's class and script go before it
    wider = f"""array_join(transform(slice(sequence(62, 10, -1), 1, greatest(0, attempt div {WIDEN} - 1)), i -> CASE WHEN norm rlike '^[0-9]' THEN {_pick('0123456789', 'i')}
        WHEN norm rlike '^\\\\p{{IsCyrillic}}' THEN {_pick(ALPHABETS['cyrillic'], 'i')} WHEN norm rlike '^\\\\p{{IsGreek}}' THEN {_pick(ALPHABETS['greek'], 'i')} ELSE {_pick(ALPHABETS['latin'], 'i')} END), '')"""
    email = f"""concat({wider}, substring_index({_by_class()}, '.', size(split(norm, '[.]')) - 1), '.', substring_index(norm, '.', -1))"""
    plain = _by_class("4")
    as_digits = f"regexp_replace(concat(substring({plain}, 5), left(norm, 2), '00'), '[^0-9A-Z]', '')"
    mod = f"aggregate(split({as_digits}, ''), 0, (r, c) -> CASE WHEN c rlike '[0-9]' THEN (r * 10 + cast(c as int)) % 97 ELSE (r * 100 + ascii(c) - 55) % 97 END)"
    iban = f"concat(left(norm, 2), lpad(cast(98 - {mod} as string), 2, '0'), substring({plain}, 5))"
    names = "".join(f" WHEN kind like 'given%{s}' THEN {_name(s, False)} WHEN kind like 'family%{s}' THEN {_name(s, True)}" for s in SYLLABLES)
    return F.expr(f"CASE kind WHEN 'phone' THEN {phone} WHEN 'card' THEN {card} WHEN 'ssn' THEN {ssn} WHEN 'ipv4' THEN {ipv4} WHEN 'ipv6' THEN {ipv6} WHEN 'secret' THEN {secret} WHEN 'email' THEN {email} WHEN 'iban' THEN {iban} ELSE CASE{names} END END")


def assign(entities: DataFrame, key: str, rounds: int = ROUNDS) -> DataFrame:
    """Distinct ``(kind, norm)`` to ``(kind, norm, surrogate)``: no two of a kind share one, and none is an entity of its kind.

    Names and e-mail addresses that keep meeting grow, so their room exceeds any number of them.
    """
    stream = F.concat(*[F.sha2(F.concat_ws("|", F.lit(key), "kind", "norm", F.col("attempt").cast("string"), F.lit(str(k))), 256) for k in range(2)])

    def drawn(df: DataFrame) -> DataFrame:
        return df.withColumn("stream", stream).withColumn("surrogate", _draw()).select("kind", "norm", "attempt", "surrogate")

    real = entities.select(F.col("kind").alias("rk"), F.col("norm").alias("rn"))
    state = checkpointed(drawn(entities.withColumn("attempt", F.lit(0))))
    for _ in range(rounds):
        # whoever drew first keeps it; ties go to the smaller normal form
        place = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("attempt", "norm"))
        seen = state.withColumn("place", place).join(real, (F.col("kind") == F.col("rk")) & (F.col("surrogate") == F.col("rn")), "left")
        seen = seen.withColumn("clash", (F.col("place") > 1) | F.col("rn").isNotNull())
        if not seen.where("clash").limit(1).count():
            return state.select("kind", "norm", "surrogate")
        again = drawn(seen.where("clash").select("kind", "norm", (F.col("attempt") + 1).alias("attempt")))
        state = checkpointed(seen.where("not clash").select("kind", "norm", "attempt", "surrogate").unionAll(again))
    raise RuntimeError("surrogates still collide; the formats leave too little room")


def _names_again(forms: Column, text: Column) -> tuple[Column, Column]:
    """(forms, pattern): where a text names persons with a form of address, their names without one are mentions of them too.

    ``pattern`` is null for a text without such names. A bare name's form is that of the titled one behind a mark.
    """
    titled = F.filter(forms, lambda f: f.rlike(f"^(?:{'|'.join((*MALE, *FEMALE, *NEUTRAL))})\\.? "))

    def named(p: Column) -> Column:
        title, rest, family = F.substring_index(p, " ", 1), F.substring(p, F.instr(p, " ") + 1, F.length(p)), F.substring_index(p, " ", -1)
        one = lambda mark, name, shown: F.struct(shown.alias("name"), F.concat(F.lit(mark), title, F.lit(" "), name).alias("form"))
        short = F.concat(F.substring_index(rest, " ", 1), F.lit(" "), family)  # of three names the first and the last
        return F.array(*[one(mark, x, said(x)) for x in (rest, short, family) for mark, said in ((BARE, lambda y: y), (CAPITALS, F.upper))])

    known = F.flatten(F.transform(titled, named))
    names = F.reverse(F.array_sort(F.transform(F.array_distinct(F.transform(known, lambda e: e["name"])), lambda n: F.struct(F.length(n).alias("n"), n.alias("name")))))
    pattern = F.when(F.size(titled) > 0, F.concat(F.lit(PATTERN + r"|(?<!\p{L})(?:"), F.array_join(F.transform(names, lambda n: n["name"]), "|"), F.lit(r")(?!\p{L})")))
    again = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.coalesce(F.get(F.filter(known, lambda e: e["name"] == m), F.lit(0))["form"], m))
    return F.when(pattern.isNotNull(), again).otherwise(forms), pattern


def _forms(mentions: DataFrame) -> DataFrame:
    """Distinct ``(form)`` with its kind and its parts (kind, norm): one, or a person's given and family names.

    A form of address that leaves the gender open takes that of the corpus's other persons of the same given name.
    """
    f = mentions.select("form").distinct().withColumn("bare", F.regexp_replace("form", f"^[{BARE}{CAPITALS}]", "")).withColumn("kind", _kind("bare")).where("kind <> 'none'")
    said = lambda titles: F.col("bare").rlike(f"^(?:{'|'.join(titles)})\\.? ")
    script = F.when(F.col("bare").rlike(r" \p{IsCyrillic}"), "cyrillic").when(F.col("bare").rlike(r" \p{IsGreek}"), "greek").otherwise("latin")
    own = F.expr("substring(bare, instr(bare, ' ') + 1, length(bare))")
    last = F.substring_index(own, " ", -1)
    found = lambda c: F.transform(F.regexp_extract_all(c, F.lit(PIECE), F.lit(0)), F.lower)
    before = F.when(F.col("kind") == "person", found(F.substring(own, F.lit(1), F.length(own) - F.length(last))))
    f = f.withColumns({"script": script, "gender": F.when(said(FEMALE), "female").when(said(MALE), "male"), "givens": before, "families": found(last)}).withColumn("given", F.get("givens", F.lit(0)))
    seen = f.where("gender IS NOT NULL AND given IS NOT NULL").groupBy("script", "given").agg(F.when(F.count_if(F.col("gender") == "female") * 2 >= F.count("*"), "female").otherwise("male").alias("known"))
    f = f.join(seen, ["script", "given"], "left").withColumn("gender", F.coalesce("gender", "known", F.lit("any")))
    named = lambda xs, kind: F.transform(xs, lambda x: F.struct(kind.alias("kind"), x.alias("norm")))
    person = F.concat(named(F.col("givens"), F.concat(F.lit("given-"), F.col("gender"), F.lit("-"), F.col("script"))), named(F.col("families"), F.concat(F.lit("family-"), F.col("script"))))
    digits = F.regexp_replace("bare", "[^0-9]", "")
    norm = (
        # with and without the country code 1 it is one number, and 00 says what + does
        F.when(F.col("kind") == "phone", F.regexp_replace(F.regexp_replace(digits, "^00", ""), "^1([0-9]{10})$", "$1"))
        .when(F.col("kind").isin("card", "ssn"), digits)
        .when(F.col("kind") == "iban", F.regexp_replace("bare", " ", ""))
        .when(F.col("kind") == "secret", F.when(F.col("bare").rlike("^[0-9A-Fa-f]+$"), F.lower("bare")).otherwise(F.col("bare")))
        .otherwise(F.lower("bare"))
    )
    parts = F.when(F.col("kind") != "person", F.array(F.struct(F.col("kind").alias("kind"), norm.alias("norm")))).otherwise(person)
    return f.select("form", "kind", parts.alias("parts"))


def _rendered() -> Column:
    """The surrogate in the format of ``form``: its separators, its case, a person's form of address."""
    s = "s[0]"
    # digits before the number itself, a country code, stay
    place = "length(regexp_replace(substring(form, 1, i + 1), '[^0-9A-Z]', '')) - length(regexp_replace(form, '[^0-9A-Z]', '')) + length(s[0])"
    spaced = f"array_join(transform(split(form, ''), (c, i) -> CASE WHEN c rlike '[0-9A-Z]' AND {place} > 0 THEN substring(s[0], {place}, 1) ELSE c END), '')"
    more = "(length(s[0]) - length(form))"  # a widened address is longer than its form
    cased = f"concat(CASE WHEN form = upper(form) THEN upper(left(s[0], {more})) ELSE left(s[0], {more}) END, array_join(transform(split(form, ''), (c, i) -> CASE WHEN c rlike '\\\\p{{Lu}}' THEN upper(substring(s[0], {more} + i + 1, 1)) ELSE substring(s[0], {more} + i + 1, 1) END), ''))"
    capitals = "CASE WHEN form = upper(form) THEN upper(s[0]) ELSE s[0] END"
    own = "substring(form, instr(form, ' ') + 1, length(form))"
    piece = PIECE.replace("\\", "\\\\")
    shown = f"zip_with(s, regexp_extract_all({own}, '{piece}', 0), (x, p) -> CASE WHEN p = upper(p) THEN upper(x) ELSE concat(upper(left(x, 1)), substring(x, 2)) END)"
    names = f"array_join(zip_with(split({own}, '{piece}'), concat({shown}, array('')), (a, b) -> concat(a, b)), '')"
    person = f"CASE WHEN left(form, 1) = '{CAPITALS}' THEN upper({names}) WHEN left(form, 1) = '{BARE}' THEN {names} ELSE concat(substring_index(form, ' ', 1), ' ', {names}) END"
    return F.expr(f"CASE WHEN kind IN ('phone', 'card', 'ssn', 'iban') THEN {spaced} WHEN kind = 'email' THEN {cased} WHEN kind IN ('secret', 'ipv6') THEN {capitals} WHEN kind = 'person' THEN {person} ELSE {s} END")


def surrogates(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, and ``n_replaced``; other columns stay, a column ``n_replaced`` is replaced.

    One row for each input row. A text without personal data, an empty or null one comes back unchanged with 0. The same
    entity gets the same surrogate in every text, for the same ``key``, which has to be kept secret: who knows it can try numbers.
    Persons are found by a form of address (up to four names with hyphens, apostrophes and particles; particles and single letters stay),
    and then by their names alone in the same text. Ten digits in a row are a phone number behind a word that says so. An IPv6 address gets a
    full one of the private range; its spellings are different entities. What is joined back to the texts is a table of the
    distinct texts that hold personal data; mentions of a text that thousands of rows share are handled once.
    """
    names = [c for c in docs.columns if c != "n_replaced"]
    maybe = F.coalesce(F.col("text").rlike(DIGIT_OR_AT) | F.col("text").rlike(TITLE), F.lit(False))
    others = docs.where(~maybe).select(*names, F.lit(0).cast("long").alias("n_replaced"))
    docs = written(docs.where(maybe), "pii-suspects")
    k1, k2 = text_key(F.col("text"))
    hit = docs.select(k1, k2, "text", F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)).alias("forms")).where(F.size("forms") > 0)
    forms, pattern = _names_again(F.col("forms"), F.col("text"))
    hit = written(hit.select("k1", "k2", forms.alias("forms"), pattern.alias("pattern")).dropDuplicates(["k1", "k2"]), "pii-mentions")
    mentions = hit.select("k1", "k2", "pattern", F.posexplode("forms").alias("at", "form"))
    forms = written(_forms(mentions), "pii-forms")
    parts = forms.select("form", "kind", F.posexplode("parts").alias("n", "part")).select("form", F.col("kind").alias("form_kind"), "n", "part.kind", "part.norm")
    given = assign(checkpointed(parts.select("kind", "norm").distinct()), key)
    drawn = parts.join(given, ["kind", "norm"]).groupBy("form", F.col("form_kind").alias("kind")).agg(F.array_sort(F.collect_list(F.struct("n", "surrogate"))).alias("s"))
    drawn = drawn.withColumn("s", F.col("s.surrogate")).select("form", _rendered().alias("new"))
    # a mention that is no entity after all keeps its form
    fixed = mentions.join(drawn, "form", "left").groupBy("k1", "k2")
    fixed = fixed.agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("new", F.col("form")).alias("new")))).alias("new"), F.count("new").alias("n_replaced"), F.first("pattern").alias("pattern"))
    fixed = written(fixed.where("n_replaced > 0").select(F.col("k1").alias("f1"), F.col("k2").alias("f2"), F.col("new.new").alias("new"), "n_replaced", "pattern"), "pii-fixed")
    # the row travels as one struct, so its columns may have any names
    rows = docs.select(F.struct(*names).alias("row"), k1.alias("f1"), k2.alias("f2")).join(fixed, ["f1", "f2"], "left")
    between = F.when(F.col("pattern").isNull(), F.split("row.text", PATTERN)).otherwise(F.split("row.text", F.col("pattern")))
    pieces = F.zip_with(between, F.concat("new", F.array(F.lit(""))), lambda p, r: F.concat(p, r))
    text = F.when(F.col("new").isNotNull(), F.array_join(pieces, "")).otherwise(F.col("row.text"))
    done = rows.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names], F.coalesce("n_replaced", F.lit(0)).cast("long").alias("n_replaced"))
    return done.unionAll(others)


def key_of(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, TEST_KEY)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), key_of(spark))
