"""The full score's parts: what is shuffled by device and time, and what a row says of its text."""

from fieldtrust.operators import decision, geo_rules
from fieldtrust.plans import registry, scenarios


def test_texts_are_not_shuffled_with_places(spark, sf_dir, monkeypatch):
    seen, real = [], geo_rules.analyze

    def analyze(df, *args):
        seen.append(df.columns)
        return real(df, *args)

    monkeypatch.setattr(scenarios.geo_rules, "analyze", analyze)
    out = registry.QUERIES["full_scores"](spark, sf_dir)
    assert len(seen) == 1 and "text" not in seen[0]
    assert out.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_has_text_may_stand_for_the_text(spark):
    anomalies = "array<struct<type:string,description:string,severity:double,details:map<string,string>>>"
    df = spark.sql(f"""SELECT id, text, 1.0D AS latitude, 2.0D AS longitude, 40.0D AS geo_score, 90.0D AS text_score, 0 AS marketing_count, CAST(array() AS {anomalies}) AS geo_anomalies, CAST(array() AS {anomalies}) AS text_anomalies
        FROM VALUES (1, 'a text'), (2, '  a    '), (3, NULL), (4, '') AS t(id, text)""")
    want = decision.score(df).orderBy("id").select("total_score", "risk_level", "is_fake").collect()
    told = df.withColumn("has_text", decision.has_text(df.text)).drop("text")
    assert decision.score(told).orderBy("id").select("total_score", "risk_level", "is_fake").collect() == want
    assert len({r.total_score for r in want}) == 2
