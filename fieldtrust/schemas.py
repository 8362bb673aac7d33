"""Table schemas of the records, results and messages."""

from pyspark.sql.types import ArrayType, BooleanType, DecimalType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType, TimestampType

S, D, L, I, B = StringType(), DoubleType(), LongType(), IntegerType(), BooleanType()


def struct(**kinds) -> StructType:
    return StructType([StructField(k, v) for k, v in kinds.items()])


GEO = struct(latitude=D, longitude=D, accuracy=D, source=S)
CONTENT = struct(text=S, content_type=S)
METADATA = struct(ip=S, app_version=S, user_agent=S)
RECORD = struct(record_id=S, device_id=S, user_id=S, timestamp=D, geo=GEO, content=CONTENT, metadata=METADATA, label=S, seq=L)
ANOMALY = struct(type=S, description=S, severity=D, details=MapType(S, S))
RESULT = struct(
    record_id=S, score=D, is_fake=B, risk_level=S, geo_score=D, text_score=D, simhash_score=D, semantic_score=D, reasons=ArrayType(S), confidence=D,
    high_severity_hit=B, marketing_count=I, similar_records=I, cluster_size=I,
)
REQUEST = struct(
    device_id=S, user_id=S, session_id=S, timestamp=L, geo=struct(latitude=D, longitude=D, accuracy=D, source=S), content=struct(text=S, type=S),
    metadata=struct(ip=S, app_version=S, user_agent=S, platform=S),
)
MESSAGE = struct(request_id=S, timestamp=S, data=REQUEST)
DETECTION = struct(
    id=L, tenant_id=L, record_id=S, device_id=S, user_id=S, content_type=S, geo_source=S, text=S, content_hash=S, latitude=DecimalType(10, 7), longitude=DecimalType(10, 7),
    accuracy=DecimalType(10, 2), suspicion_score=DecimalType(5, 2), geo_score=DecimalType(5, 2), text_score=DecimalType(5, 2), simhash_score=DecimalType(5, 2),
    semantic_score=DecimalType(5, 2), is_fake=B, risk_level=S, reasons=ArrayType(S), review_status=S, processing_time_ms=I, created_at=TimestampType(),
)
FEATURE = struct(feature_id=S, name=S, feature_type=S, description=S, patterns=ArrayType(S), weight=D, is_active=B)
SAMPLE = struct(sample_id=S, data=MapType(S, S), label=S, source=S, verified=B, created_at=S)
