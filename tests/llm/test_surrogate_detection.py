"""Names of several words, phone numbers of many spellings, IPv6 addresses: what is found, kept in form and kept together."""

from fieldtrust.llm import surrogates

DOCS = "doc_id long, text string"


def run(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    return [r.text for r in sorted(surrogates.surrogates(docs, "a key").collect(), key=lambda r: r.doc_id)]


def test_names_of_several_words(spark):
    texts = [
        "Mrs. Jane Roe-Smith, Ms. Mary Ann Lee and Mary Lee; MARY ANN LEE",
        "Mr. Jean-Luc Picard and Mrs. O'Brien's dog; Mrs. O’Brien",
        "Herr Karl van der Berg met Mr. de la Cruz; van der Berg left. Mr. Roe.",
        "Mrs. Smith's house, Dr. Anna Maria Luisa Torres-Vega",
        "госпожа Анна-Мария Петрова",
    ]
    out = run(spark, texts)
    for name in ("Jane", "Roe", "Smith", "Mary", "Ann ", "Lee", "LEE", "Jean", "Luc", "Picard", "Brien", "Karl", "Berg", "Cruz", "Anna", "Maria", "Luisa", "Torres", "Vega", "Анна", "Мария", "Петрова"):
        assert not any(name in t for t in out), name
    first, rest = out[0].split(", Ms. ")
    roe, smith = first.split()[-1].split("-")
    mary, ann, lee = rest.split(" and ")[0].split()
    assert rest == f"{mary} {ann} {lee} and {mary} {lee}; {mary.upper()} {ann.upper()} {lee.upper()}"
    brien = out[1].split("O'")[1].split("'")[0]
    assert out[1].endswith(f"Mrs. O'{brien}'s dog; Mrs. O’{brien}") and out[1].split()[1].count("-") == 1
    berg = out[2].split()[4]
    assert out[2].split(";")[1].startswith(f" van der {berg} left.") and " Mr. de la " in out[2]
    assert out[2].endswith(f"Mr. {roe}.") and out[3].startswith(f"Mrs. {smith}'s house")  # a part of a double name is that name


def test_phone_numbers_of_many_spellings(spark):
    same = ["437-555-0689", "437.555.0689", "437 555 0689", "+14375550689", "+1 437 555 0689", "001 437 555 0689", "(437) 555-0689"]
    other = ["0044 20 7946 0958", "+44 20 7946 0958", "020 7946 0958"]
    out = run(spark, [f"reach us at {x}, please" for x in same + other] + ["tel: 4375550689", "order 4375550689 of 2024.123.4567 and 1700000000", "values 0.123 456 7890, 3.141 592 6535"])
    digits = [("".join(c for c in t if c.isdigit())) for t in out]
    new = digits[0]
    assert len(new) == 10 and new != "4375550689" and all(d.endswith(new) for d in digits[: len(same)]) and digits[len(same) + 3] == new
    assert digits[3] == digits[4] == "1" + new and digits[5] == "001" + new and "." in out[1] and out[3].split()[3][0] == "+"
    a, b, c = digits[len(same) : len(same) + 3]
    assert a == "00" + b and b.startswith("44") and b != "442079460958" and c.startswith("0") and c != "02079460958"
    assert out[-2] == "order 4375550689 of 2024.123.4567 and 1700000000" and out[-1] == "values 0.123 456 7890, 3.141 592 6535"


def test_ipv6(spark):
    out = run(spark, ["from 2001:db8::ff00:42:8329 to 2001:0db8:85a3:0000:0000:8a2e:0370:7334.", "again 2001:DB8::FF00:42:8329", "at 12:30:45, std::dec, a::b, 00:1b:44:11:3a:b7"])
    a, b = out[0].split()[1], out[0].split()[3].rstrip(".")
    assert a != b and all(len(x) == 39 and x.startswith("fd") and x.count(":") == 7 for x in (a, b))
    assert out[1] == f"again {a.upper()}" and out[2] == "at 12:30:45, std::dec, a::b, 00:1b:44:11:3a:b7"
