"""What resharding writes: every affected row once, null and repeated ids included, and the layout read back from it."""

import zlib
from collections import Counter

from fieldtrust.llm import resharding


def test_files_hold_all_affected_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(resharding, "FILE_ROWS", 4)
    texts = [(i, f"text {i} " * (1 + i % 5)) for i in range(60)]
    texts += [(None, "no id")] * 5 + [(None, None)] * 3 + [(7, "same")] * 6 + [(8, "")] * 2
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    placed = resharding.reshard(docs, 3, 5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    files = resharding.rewrite_affected(docs, placed, str(tmp_path / "out"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = placed.where("touched").collect()
    count = lambda rs: Counter((r.doc_id, r.text, r.shard, r.slot) for r in rs)
    assert count(files.collect()) == count(rows) and sum(r.doc_id is None for r in rows) > 0
    assert all(r.touched for r in placed.where("moved").collect())
    assert any(len(list(d.glob("*.parquet"))) > 1 for d in (tmp_path / "out").glob("shard=*"))
    got = resharding.resharded(docs, 3, 5).collect()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    for j in range(5):
        slots = sorted(r.slot for r in got if r.shard == j)
        assert slots == list(range(len(slots))) and len(slots) in (len(texts) // 5, len(texts) // 5 + 1)
    assert resharding.resharded(docs.where("false")).count() == 0
    # columns by name, wherever they stand
    turned = docs.selectExpr("'en' AS lang", "text", "1 AS slot", "doc_id")
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in resharding.resharded(turned, 3, 5).collect()) == want
