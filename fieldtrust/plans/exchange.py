"""Registered queries of rows that are written and read back, and of the states that logs of events lead to."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrust.functions import hashing
from fieldtrust.functions import text as tx
from fieldtrust.operators import ml, preprocess, records, workflow
from fieldtrust.operators.graph import checkpoint_dir
from fieldtrust.plans import tables as t
from fieldtrust.plans.registry import AS_OF, query, times, ts
from fieldtrust.plans.tables import DETECTIONS_SQL
from fieldtrust.sources import readers, writers


def _path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"""SELECT CAST(id AS VARCHAR) AS record_id, sha256(coalesce(text, '')) AS content_hash, 'pending' AS review_status, '{AS_OF}' AS day, {ts('suspicion_score * 100')} AS score_c FROM {DETECTIONS_SQL} WHERE tenant_id = 1""")
def stored_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tenant's rows of a detection table that every tenant's rows were appended to."""
    path = _path(spark, "detections")
    d = t.detections(spark, sf_dir)
    for tenant in range(3):
        writers.append_detections(writers.to_detections(d.where(F.col("tenant_id") == tenant), tenant, AS_OF), path)
    mine = readers.read_tenant(spark, path, 1)
    return mine.select("record_id", "content_hash", "review_status", F.col("day").cast("string").alias("day"), times(F.col("suspicion_score"), 100).alias("score_c"))


_PLAIN_PHONE = "(p LIKE '138%' OR p LIKE '400-%')"


@query(f"""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 13 = 0 THEN 'x' ELSE c_name || ', "' || c_mktsegment || '"' END AS name, (c_custkey * 7919) % 20001 / 100.0 - 100 AS lat, (c_custkey * 104729) % 40001 / 100.0 - 200 AS lon,
CASE c_custkey % 4 WHEN 0 THEN '138' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') WHEN 1 THEN '400-123-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') WHEN 2 THEN 'none' ELSE '' END AS p FROM customer)
SELECT c_custkey, name, {ts('lat * 100')} AS lat_c, array_to_string(list_filter([CASE WHEN name = '' THEN 'name_missing' WHEN length(name) < 2 THEN 'name_too_short' END, CASE WHEN lat NOT BETWEEN -90 AND 90 THEN 'latitude_range' END, CASE WHEN lon NOT BETWEEN -180 AND 180 THEN 'longitude_range' END], lambda x: x IS NOT NULL), '|') AS errors,
CASE WHEN p = '' OR {_PLAIN_PHONE} THEN '' ELSE 'phone_format' END AS warnings FROM c""")
def uploaded_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places exported with headings of the other language, read as an upload and checked."""
    k = F.col("c_custkey")
    phone = F.when(k % 4 == 0, F.concat(F.lit("138"), F.lpad(k.cast("string"), 8, "0"))).when(k % 4 == 1, F.concat(F.lit("400-123-"), F.lpad((k % 10000).cast("string"), 4, "0"))).when(k % 4 == 2, "none").otherwise("")
    name = F.when(k % 11 == 0, "").when(k % 13 == 0, "x").otherwise(F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')))
    rows = t.read(spark, sf_dir, "customer").select(
        k.alias("id"), name.alias("名称"), ((k * 7919) % 20001 / 100.0 - 100).cast("double").alias("纬度"), ((k * 104729) % 40001 / 100.0 - 200).cast("double").alias("经度"), phone.alias("电话"), F.lit("").alias("地址"),
    )
    path = _path(spark, "places") + ".csv"
    writers.export(rows, path, "csv")
    read = readers.with_known_headings(readers.read_any(spark, path))
    said = lambda c: F.array_join(c, "|").alias(c)
    return preprocess.validate_poi(read).select(F.col("id").cast("long").alias("c_custkey"), tx.text_of(F.col("name")).alias("name"), times(F.col("latitude").cast("double"), 100).alias("lat_c"), said("errors"), said("warnings"))


@query(f"""SELECT CAST(event_id AS VARCHAR) AS record_id, CASE WHEN event_id % 4 = 0 THEN 'd' || user_id ELSE '' END AS device_id, {ts('CASE WHEN event_id % 3 = 0 THEN 1.5 WHEN event_id % 5 = 0 THEN 0 ELSE (event_id * 7919) % 18001 / 100.0 - 90 END * 100')} AS lat_c,
CASE WHEN event_id % 6 = 0 THEN 'WIFI' ELSE 'GPS' END AS source, {ts('CASE WHEN event_id % 7 = 0 THEN value ELSE 10 END * 100')} AS accuracy_c, CASE WHEN event_id % 2 = 0 THEN props ELSE '' END AS text, event_type AS content_type FROM events""")
def normalized_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested reports, some with flat fields too, exported as JSON lines and read back flat."""
    e = F.col("event_id")
    lat = ((e * 7919) % 18001 / 100.0 - 90).cast("double")
    rows = t.read(spark, sf_dir, "events").select(
        e.alias("id"), F.when(e % 4 == 0, F.concat(F.lit("d"), "user_id")).alias("device_id"), F.when(e % 3 == 0, 1.5).alias("latitude"),
        F.struct(F.when(e % 5 > 0, lat).alias("latitude"), F.when(e % 6 == 0, "WIFI").alias("source"), F.when(e % 7 == 0, F.col("value")).alias("accuracy")).alias("geo"),
        F.struct(F.when(e % 2 == 0, F.col("props")).alias("text"), F.col("event_type").alias("content_type")).alias("content"),
    )
    path = _path(spark, "reports")
    writers.export(rows, path)
    n = records.normalized(spark.read.schema(rows.schema).json(path))
    return n.select("record_id", "device_id", times(F.col("latitude"), 100).alias("lat_c"), "source", times(F.col("accuracy"), 100).alias("accuracy_c"), "text", "content_type")


_ACTION_SQL = "CASE event_id % 5 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' WHEN 2 THEN 'escalate' WHEN 3 THEN 'label' ELSE 'note' END"


@query(f"""WITH v AS (SELECT (event_id * 31) % 700 AS record_id, event_id AS seq, CASE WHEN event_id % 211 = 0 THEN 'delete' ELSE {_ACTION_SQL} END AS action, CAST(user_id AS VARCHAR) AS reviewer, event_type AS value FROM events),
s AS (SELECT record_id, arg_max(action, seq) FILTER (action IN ('approve', 'reject', 'escalate')) AS a, arg_max(reviewer, seq) FILTER (action IN ('approve', 'reject', 'escalate')) AS reviewer, arg_max(value, seq) FILTER (action = 'label') AS ground_truth, bool_or(action = 'delete') AS gone FROM v GROUP BY 1)
SELECT c_custkey AS record_id, CASE a WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' WHEN 'escalate' THEN 'escalated' ELSE 'pending' END AS review_status, reviewer, ground_truth FROM customer LEFT JOIN s ON c_custkey = s.record_id WHERE NOT coalesce(gone, false)""")
def review_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records after all that reviewers did to them; deleted ones are gone."""
    e = F.col("event_id")
    action = F.when(e % 211 == 0, "delete").when(e % 5 == 0, "approve").when(e % 5 == 1, "reject").when(e % 5 == 2, "escalate").when(e % 5 == 3, "label").otherwise("note")
    events = t.read(spark, sf_dir, "events").select(((e * 31) % 700).alias("record_id"), e.alias("seq"), action.alias("action"), F.col("user_id").cast("string").alias("reviewer"), F.col("event_type").alias("value"))
    return workflow.review_state(t.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record_id")), events)


@query(f"""WITH ch AS (SELECT o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 10000000 ELSE 0 END AS k, arg_max(o_orderpriority, o_orderkey) AS label, arg_max(o_orderkey % 7 = 0, o_orderkey) AS gone, max(o_orderkey) AS seq FROM orders WHERE o_custkey % 3 > 0 GROUP BY 1)
SELECT c_custkey AS k, c_mktsegment AS label, -1 AS seq FROM customer WHERE c_custkey NOT IN (SELECT k FROM ch) UNION ALL SELECT k, label, seq FROM ch WHERE NOT gone""")
def merged_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers after upserts and deletes, several to a key; of those the last one holds."""
    o = F.col("o_orderkey")
    existing = t.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("label"), F.lit(-1).cast("long").alias("seq"))
    changes = t.read(spark, sf_dir, "orders").where("o_custkey % 3 > 0").select((F.col("o_custkey") + F.when(o % 5 == 0, 10_000_000).otherwise(0)).alias("k"), F.col("o_orderpriority").alias("label"), o.alias("seq"), F.when(o % 7 == 0, "delete").otherwise("upsert").alias("op"))
    return workflow.merged(existing, changes, "k")


@query("""WITH m AS (SELECT CAST(ts AS DATE) AS day, event_type AS metric, count(*) AS value FROM events GROUP BY 1, 2), r AS (SELECT n_nationkey AS rule_id, metric, n_nationkey * 3 AS threshold, n_nationkey % 5 AS o FROM nation, (SELECT DISTINCT event_type AS metric FROM events))
SELECT CAST(day AS VARCHAR) AS day, metric, CAST(rule_id AS BIGINT) AS rule_id, value FROM m JOIN r USING (metric) WHERE CASE o WHEN 0 THEN value > threshold WHEN 1 THEN value >= threshold WHEN 2 THEN value < threshold WHEN 3 THEN value <= threshold ELSE value = threshold END""")
def triggered_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert rules, one of each operator and metric, that a day's numbers of events meet."""
    e = t.read(spark, sf_dir, "events")
    values = e.groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("metric")).agg(F.count("*").alias("value"))
    n = F.col("n_nationkey")
    rules = t.read(spark, sf_dir, "nation").select(n.cast("long").alias("rule_id"), F.get(F.array(*map(F.lit, workflow.METRICS)), n % 5).alias("operator"), (n * 3).alias("threshold"))
    kinds = e.agg(F.collect_set("event_type").alias("kinds"))  # the kinds of event, a handful
    rules = rules.withColumn("kinds", kinds.scalar()).select("rule_id", "operator", "threshold", F.explode("kinds").alias("metric"))
    return workflow.triggered(values, rules).select(F.col("day").cast("string").alias("day"), "metric", "rule_id", "value")


@query(f"""WITH p AS (SELECT quality = 0 AS l, n_chars % 3 = 0 AS p FROM documents JOIN labels USING (doc_id)), s AS (SELECT count(*) FILTER (l AND p) AS tp, count(*) FILTER (NOT l AND p) AS fp, count(*) FILTER (l AND NOT p) AS fn, count(*) FILTER (NOT l AND NOT p) AS tn FROM p)
SELECT tp, fp, fn, tn, {ts('(tp + tn) * 1000000.0 / (tp + fp + fn + tn)')} AS accuracy_m, {ts('tp * 1000000.0 / (tp + fp)')} AS precision_m, {ts('tp * 1000000.0 / (tp + fn)')} AS recall_m, {ts('2 * tp * 1000000.0 / (2 * tp + fp + fn)')} AS f1_m FROM s""")
def stored_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored predictions of all documents against the labels of those that have one."""
    path = _path(spark, "predictions")
    writers.export(t.read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 3 == 0).cast("int").alias("predicted")), path, "parquet")
    truth = t.read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).cast("int").alias("label"))
    m = ml.evaluate(spark.read.parquet(path), truth, "doc_id")
    return m.select("tp", "fp", "fn", "tn", *[times(F.col(c), 1_000_000).alias(f"{c}_m") for c in ("accuracy", "precision", "recall", "f1")])


_RAW_PHONE_SQL = "CASE k % 5 WHEN 0 THEN '(138) ' || lpad(CAST(k AS VARCHAR), 8, '0') WHEN 1 THEN '021-' || lpad(CAST(k AS VARCHAR), 8, '5') WHEN 2 THEN '400 ' || lpad(CAST(k % 10000000 AS VARCHAR), 7, '0') WHEN 3 THEN 'ext. ' || k ELSE '' END"


@query(f"""WITH s AS (SELECT s_suppkey AS k, s_suppkey * 5 % 27 AS a, s_suppkey * 11 % 26 AS b FROM supplier), p AS (SELECT *, {_RAW_PHONE_SQL} AS v FROM s),
c AS (SELECT *, regexp_replace(v, '[^0-9+-]', '', 'g') AS c FROM p),
q AS (SELECT *, CASE WHEN regexp_full_match(c, '1[3-9][0-9]{{9}}') THEN 'mobile' WHEN regexp_full_match(c, '0[0-9]{{2,3}}-?[0-9]{{7,8}}') THEN 'landline' WHEN regexp_full_match(c, '400-?[0-9]{{3}}-?[0-9]{{4}}') THEN 'service' END AS kind FROM c)
SELECT k, c AS phone, CASE WHEN v <> '' THEN kind END AS kind, v = '' OR kind IS NOT NULL AS valid, NOT (a >= 24 OR b >= 24 OR (a > b AND b <> 0)) AS hours_valid, CASE WHEN k % 9 = 0 THEN NULL ELSE 'Supplier ' || k END AS name FROM q""")
def contact_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telephones, opening hours and names of suppliers, cleaned and checked."""
    k = F.col("k")
    s = t.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    raw = F.when(k % 5 == 0, F.concat(F.lit("(138) "), F.lpad(k.cast("string"), 8, "0"))).when(k % 5 == 1, F.concat(F.lit("021-"), F.lpad(k.cast("string"), 8, "5")))
    raw = raw.when(k % 5 == 2, F.concat(F.lit("400 "), F.lpad((k % 10_000_000).cast("string"), 7, "0"))).when(k % 5 == 3, F.concat(F.lit("ext. "), k)).otherwise("")
    hours = F.format_string("%02d:00-%02d:00", k * 5 % 27, k * 11 % 26)
    name = F.when(k % 9 == 0, "null").otherwise(F.concat(F.lit(" Supp\x07lier "), k, F.lit("\x00 ")))
    p = tx.phone(raw)
    return s.select("k", p["phone"].alias("phone"), p["kind"].alias("kind"), p["valid"].alias("valid"), tx.business_hours(hours)["valid"].alias("hours_valid"), tx.strip_noise(name).alias("name"))


_CODES = lambda c: f"SELECT p_partkey, unicode(x) % 64 AS b, count(*) AS n FROM (SELECT p_partkey, unnest(string_split({c}, '')) AS x FROM part) GROUP BY 1, 2"


@query(f"""WITH a AS ({_CODES('p_name')}), b AS ({_CODES('p_type')}), d AS (SELECT p_partkey, sum(a.n * b.n) AS dot FROM a JOIN b USING (p_partkey, b) GROUP BY 1), na AS (SELECT p_partkey, sqrt(sum(n * n)) AS l, count(*) AS bins FROM a GROUP BY 1), nb AS (SELECT p_partkey, sqrt(sum(n * n)) AS l FROM b GROUP BY 1)
SELECT p_partkey, bins, {ts('coalesce(dot, 0) / na.l / nb.l * 10000')} AS cosine_w FROM na JOIN nb USING (p_partkey) LEFT JOIN d USING (p_partkey)""")
def code_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike the characters of a part's name and type are, by vectors of code points."""
    v = t.read(spark, sf_dir, "part").select("p_partkey", hashing.histogram(F.col("p_name"), 64).alias("a"), hashing.histogram(F.col("p_type"), 64).alias("b"))
    return v.select("p_partkey", F.size(F.filter("a", lambda x: x > 0)).cast("long").alias("bins"), times(hashing.cosine(F.col("a"), F.col("b")), 10_000).alias("cosine_w"))
