"""More entities than a format's first room holds still get surrogates of their own."""

import string

from pyspark.sql import functions as F

from fieldtrust.llm import surrogates


def test_names_beyond_the_room(spark):
    names = spark.range(17000).select(F.lit("given-male-latin").alias("kind"), F.concat(F.lit("x"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("norm"))
    rows = surrogates.assign(names, "a key").collect()
    assert len({r.norm for r in rows}) == len(rows) == 17000
    assert len({r.surrogate for r in rows}) == 17000 and not {r.surrogate for r in rows} & {r.norm for r in rows}


def test_all_addresses_of_a_short_format(spark):
    mails = [f"{a}@{b}.io" for a in string.ascii_lowercase for b in string.ascii_lowercase]
    rows = [(i, f"mail {m} now") for i, m in enumerate(mails)] + [(-1, "mail A@b.io now"), (-2, "mail A@B.IO now"), (-3, "mail Ann@b.io now")]
    got = {r.doc_id: r.text.split()[1] for r in surrogates.surrogates(spark.createDataFrame(rows, "doc_id long, text string"), "a key").collect()}
    new = [got[i] for i in range(len(mails))]
    assert len(set(new)) == len(mails) and not set(new) & set(mails)
    assert all(a.endswith(".io") and a.count("@") == 1 and a == a.lower() for a in new)
    same = got[mails.index("a@b.io")]
    assert got[-1].lower() == got[-2].lower() == same and got[-2] == same.upper() and got[-3] != same and got[-3][0].isupper()
