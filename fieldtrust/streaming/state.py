"""What a stream remembers: devices' rates and places, earlier fingerprints and vectors. Let go by event time.

Copies and like texts of a live stream are found in two keyed steps. A row asks several lanes: one for each band of its fingerprint,
keyed by the band's value, and each block of stored vectors, of which one keeps the row's own. A lane answers at once with a count,
and the row's answers, all of the same micro-batch, are added up by the row's id. Two fingerprints that agree on several bands are
counted on the first one only. Blocks are as many as tasks, so vectors are compared with all kept ones and no lane is hot.

Rows of a micro-batch come in the order of (timestamp, request_id); a lane keeps counts of fingerprints, not rows. State needs the
RocksDB state store (``CONF``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from fieldtrust.operators import dedup
from fieldtrust.params import DEFAULT, Params

#: What the session needs for the keyed state.
CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
STAMPS = 200
DEVICE_SECONDS, COPY_SECONDS = 2 * 3600.0, 24 * 3600.0
BLOCKS = 8
BINS = 256


class DeviceState(StatefulProcessor):
    """Arrivals of the device in the last minute and hour (of at most ``STAMPS`` kept) and its last valid place."""

    def __init__(self, names: list[str], seconds: float):
        self.names, self.seconds = names, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("device", "stamps array<double>, latitude double, longitude double, timestamp double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        stamps, lat, lon, ts = self.kept.get() if self.kept.exists() else ([], None, None, None)
        stamps, latest = list(stamps), None
        for r in sorted(rows, key=lambda r: (r.timestamp, r.request_id)):
            now = r.timestamp
            stamps = [t for t in stamps if t > now - 3600][-(STAMPS - 1) :] + [now]
            latest = now if latest is None else max(now, latest)
            valid = -90 <= r.latitude <= 90 and -180 <= r.longitude <= 180 and bool(r.device_id)
            before = (lat, lon, ts) if valid else (None, None, None)
            counts = {"minute_count": sum(t > now - 60 for t in stamps), "hour_count": len(stamps)}
            yield Row(**{n: getattr(r, n) for n in self.names}, **counts, **dict(zip(("prev_lat", "prev_lon", "prev_ts"), before, strict=True)))
            if valid:
                lat, lon, ts = r.latitude, r.longitude, now
        self.kept.update((stamps, lat, lon, ts))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int((latest + self.seconds) * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


def with_device_state(requests: DataFrame, seconds: float = DEVICE_SECONDS) -> DataFrame:
    """Adds ``minute_count``, ``hour_count``, ``prev_lat``, ``prev_lon`` and ``prev_ts``; ``requests`` has a watermark on ``ts``."""
    more = [T.StructField("minute_count", T.LongType()), T.StructField("hour_count", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("prev_lat", "prev_lon", "prev_ts")]]
    kinds = T.StructType([*[T.StructField(f.name, f.dataType) for f in requests.schema], *more])
    return requests.groupBy("device_id").transformWithState(DeviceState(requests.columns, seconds), kinds, "append", "EventTime", None, "ts")


class Lane(StatefulProcessor):
    """One band value's fingerprints with how often they came, or one block of vectors."""

    def __init__(self, distance: int, cosine: float, seconds: float):
        self.distance, self.cosine, self.seconds = distance, cosine, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fps = handle.getMapState("fps", "fp long", "n long, last double")
        self.vectors = handle.getMapState("vectors", "id string", "v binary, last double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rows = sorted(rows, key=lambda r: (r.timestamp, r.request_id))
        yield from (self._prints if key[0] == "fp" else self._block)(key, rows)
        for t in list(self.handle.listTimers()):  # one timer is kept, for what goes first
            self.handle.deleteTimer(t)
        self._wake()

    def _prints(self, key, rows) -> Iterator[Row]:
        known = {int(k[0]): [int(v[0]), float(v[1])] for k, v in self.fps.iterator()}
        touched = set()
        for r in rows:
            n, least = 0, 64
            for fp, (times, last) in known.items():
                apart = (r.fp ^ fp) & 0xFFFFFFFFFFFFFFFF
                d = apart.bit_count()
                if d <= (0 if r.short else self.distance) and last > r.timestamp - self.seconds and not _earlier_band(apart, key[1], self.distance):
                    n, least = n + times, min(least, d)
            yield Row(request_id=r.request_id, ts=r.ts, n=n, least=least, alike=0, payload=r.payload)
            times, last = known.get(r.fp, (0, r.timestamp))
            known[r.fp] = [times + 1, max(last, r.timestamp)]
            touched.add(r.fp)
        for fp in touched:
            self.fps.updateValue((fp,), tuple(known[fp]))

    def _block(self, key, rows) -> Iterator[Row]:
        kept = [(np.frombuffer(bytes(v[0]), np.float64), float(v[1])) for _, v in self.vectors.iterator()]
        own = [r for r in rows if r.own]
        x = np.zeros((len(kept) + len(own), BINS))
        last = np.zeros(len(x))
        for i, (v, t) in enumerate(kept):
            x[i], last[i] = v, t
        m = len(kept)
        for r in rows:
            v = np.frombuffer(bytes(r.vector), np.float64)
            like = (x[:m] @ v >= self.cosine) & (last[:m] > r.timestamp - self.seconds)
            yield Row(request_id=r.request_id, ts=r.ts, n=0, least=64, alike=int(like.sum()), payload=r.payload)
            if r.own:
                x[m], last[m] = v, r.timestamp
                m += 1
                self.vectors.updateValue((r.request_id,), (bytes(r.vector), r.timestamp))

    def _wake(self) -> None:
        ends = [float(v[1]) for state in (self.fps, self.vectors) for _, v in state.iterator()]
        if ends:
            self.handle.registerTimer(int((min(ends) + self.seconds) * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = expiredTimerInfo.getExpiryTimeInMs() / 1000 - self.seconds
        for state in (self.fps, self.vectors):
            for k in [k for k, v in state.iterator() if float(v[1]) <= until]:
                state.removeKey(tuple(k))
        self._wake()
        return iter(())

    def close(self) -> None:
        pass


def _earlier_band(apart: int, band: int, distance: int) -> bool:
    """Whether two fingerprints that differ in the bits ``apart`` agree on a band before ``band``."""
    edges = [64 * i // (distance + 1) for i in range(distance + 2)]
    return any(not (apart >> a) & ((1 << (b - a)) - 1) for a, b in zip(edges[:band], edges[1 : band + 1], strict=True))


class Answers(StatefulProcessor):
    """Adds up what the lanes said of a row; all of it is in one micro-batch, so nothing is kept."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n, least, like, payload = 0, 64, 0, None
        for r in rows:
            n, least, like = n + r.n, min(least, r.least), like + r.alike
            payload = payload if r.payload is None else r.payload
        yield Row(payload=payload, n=n, least=least, alike=like)

    def close(self) -> None:
        pass


@F.arrow_udf(T.StructType([T.StructField("fp", T.LongType()), T.StructField("vector", T.BinaryType())]))
def fingerprint_and_vector(texts: pa.Array) -> pa.Array:
    """The batch path's fingerprint of a text and its histogram of code points modulo 256 as a unit vector."""
    hashes, fps, vectors = dedup._PairHashes(), [], []
    for t in texts.to_pylist():
        t = t or ""
        fps.append(dedup.majority_bits(t, hashes))
        c = np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) % BINS, minlength=BINS).astype(np.float64)
        vectors.append((c / max(np.linalg.norm(c), 1e-300)).tobytes())
    return pa.StructArray.from_arrays([pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64()), pa.array(vectors, pa.binary())], ["fp", "vector"])


def with_copies(requests: DataFrame, p: Params = DEFAULT, seconds: float = COPY_SECONDS, blocks: int = BLOCKS) -> DataFrame:
    """Adds, of the rows that came before, how many are near copies and how many are like: ``similar_records``, ``hamming_distance``, ``simhash_score``, ``cluster_size`` and ``semantic_score``.

    ``requests(request_id, timestamp, ts, text, ...)``, each id once, with a watermark on ``ts``. Near copies are those of the batch
    path (``dedup.check_prior``): fingerprints within three bits, for texts under twenty characters equal ones. A fingerprint is
    forgotten ``seconds`` after it last came, a vector after it came.
    """
    k = p.simhash_distance
    made = fingerprint_and_vector(F.col("text"))
    names = requests.columns
    r = requests.withColumn("_m", made).select("request_id", "timestamp", "ts", (F.length(F.coalesce("text", F.lit(""))) < p.simhash_short).alias("short"), F.col("_m.fp").alias("fp"), F.col("_m.vector").alias("vector"), F.struct(*names).alias("payload"))
    payload = F.col("payload")
    nothing = F.lit(None).cast(requests.select(F.struct(*names).alias("p")).schema["p"].dataType)
    home = F.pmod(F.xxhash64("request_id"), F.lit(blocks))
    lanes = []
    for i, lane in enumerate(F.get(dedup.bands(F.col("fp"), k), F.lit(b)) for b in range(k + 1)):
        lanes.append(F.struct(F.lit("fp").alias("kind"), F.lit(i).alias("lane"), lane["value"].alias("value"), F.lit(False).alias("own"), F.lit(None).cast("binary").alias("vector"), (payload if i == 0 else nothing).alias("payload")))
    for b in range(blocks):
        lanes.append(F.struct(F.lit("vector").alias("kind"), F.lit(b).alias("lane"), F.lit(0).cast("long").alias("value"), (home == b).alias("own"), F.col("vector").alias("vector"), nothing.alias("payload")))
    asked = r.select("request_id", "timestamp", "ts", "short", "fp", F.explode(F.array(*lanes)).alias("_l")).select("request_id", "timestamp", "ts", "short", "fp", "_l.*")
    row = requests.select(F.struct(*names).alias("p")).schema["p"].dataType
    said = T.StructType([T.StructField("request_id", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("n", T.LongType()), T.StructField("least", T.IntegerType()), T.StructField("alike", T.LongType()), T.StructField("payload", row)])
    answers = asked.groupBy("kind", "lane", "value").transformWithState(Lane(k, p.cosine, seconds), said, "append", "EventTime", None, "ts")
    summed = T.StructType([T.StructField("payload", row), T.StructField("n", T.LongType()), T.StructField("least", T.IntegerType()), T.StructField("alike", T.LongType())])
    out = answers.groupBy("request_id").transformWithState(Answers(), summed, "append", "None").select("payload.*", "n", "least", "alike")
    size = F.col("alike") + 1
    return out.withColumns({
        "similar_records": F.col("n").cast("int"), "hamming_distance": F.col("least"), "simhash_score": F.when(F.col("n") > 0, (1 - F.col("least") / 64.0) * 100).otherwise(0.0),
        "cluster_size": size, "semantic_score": F.when(size > p.cluster_size, F.least(size / 20.0, F.lit(1.0)) * 100).otherwise(0.0),
    }).drop("n", "least", "alike")
