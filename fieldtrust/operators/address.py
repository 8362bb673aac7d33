"""Addresses by a dictionary of divisions: parts, confidence, completeness, likeness. Expressions throughout.

Tokens come from longest match over the dictionary, numbers with their unit and division suffixes, in place of a segmenter.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from fieldtrust.functions.text import positional_similarity, text_of
from fieldtrust.operators.graph import checkpoint_dir

# fixed values: divisions, and the endings of streets and buildings
MUNICIPALITIES = ("北京", "上海", "天津", "重庆")
PROVINCES = ("广东", "江苏", "浙江", "山东", "河南", "四川", "湖北", "湖南", "河北", "福建", "安徽", "江西", "辽宁", "黑龙江", "吉林", "山西", "陕西", "甘肃", "青海", "海南", "台湾")
REGIONS = {"新疆": "新疆维吾尔自治区", "西藏": "西藏自治区", "宁夏": "宁夏回族自治区", "广西": "广西壮族自治区", "内蒙古": "内蒙古自治区", "香港": "香港特别行政区", "澳门": "澳门特别行政区"}
CITIES = (
    "广州", "深圳", "杭州", "南京", "成都", "武汉", "西安", "苏州", "郑州", "长沙", "东莞", "青岛", "沈阳", "宁波", "昆明", "合肥", "佛山", "福州", "厦门", "哈尔滨", "济南",
    "大连", "温州", "南宁", "南昌", "贵阳", "兰州", "银川", "西宁", "海口", "呼和浩特", "太原", "石家庄", "长春", "拉萨", "乌鲁木齐", "台北",
)
DISTRICTS = (
    "朝阳区", "海淀区", "东城区", "西城区", "丰台区", "石景山区", "通州区", "昌平区", "大兴区", "顺义区", "房山区", "门头沟区", "怀柔区", "平谷区", "密云区", "延庆区",
    "浦东新区", "黄浦区", "徐汇区", "长宁区", "静安区", "普陀区", "虹口区", "杨浦区", "闵行区", "宝山区", "嘉定区", "金山区", "松江区", "青浦区", "奉贤区", "崇明区",
)
STREETS = ("路", "街", "大道", "巷", "弄", "胡同", "道", "线", "公路", "大街", "中路", "西路", "东路", "南路", "北路", "支路", "弄堂", "横街", "纵街", "环线", "快速路", "主干道", "次干道")
BUILDINGS = ("大厦", "大楼", "中心", "广场", "商场", "市场", "城", "堡", "寨", "公寓", "小区", "花园", "苑", "庭", "坊", "村", "庄", "家园", "宫", "馆", "楼", "厦", "屋", "办公楼", "写字楼", "综合楼", "商务楼")
NUMBERS = (r"\d+(?:[号|栋幢座层室单元])", r"\d+-\d+[号|栋幢座层室单元]", r"\d+[区|排组栋幢]", r"[A-Za-z0-9]+-[A-Za-z0-9]+", r"\d+")
# fixed values: the aliases by which the short parser knows a province
ALIASES = {
    "北京市": ("北京",), "上海市": ("上海",), "天津市": ("天津",), "重庆市": ("重庆",), "广东省": ("广东", "粤"), "江苏省": ("江苏", "苏"), "浙江省": ("浙江", "浙"), "山东省": ("山东", "鲁"),
    "河南省": ("河南", "豫"), "四川省": ("四川", "川", "蜀"), "湖北省": ("湖北", "鄂"), "湖南省": ("湖南", "湘"), "河北省": ("河北", "冀"), "福建省": ("福建", "闽"), "安徽省": ("安徽", "皖"),
    "江西省": ("江西", "赣"), "辽宁省": ("辽宁", "辽"), "黑龙江省": ("黑龙江", "黑"), "吉林省": ("吉林", "吉"), "山西省": ("山西", "晋"), "陕西省": ("陕西", "陕", "秦"), "甘肃省": ("甘肃", "甘", "陇"),
    "青海省": ("青海", "青"), "新疆维吾尔自治区": ("新疆", "新"), "西藏自治区": ("西藏", "藏"), "宁夏回族自治区": ("宁夏", "宁"), "广西壮族自治区": ("广西", "桂"), "内蒙古自治区": ("内蒙古", "蒙"),
    "海南省": ("海南", "琼"), "台湾省": ("台湾", "台"), "香港特别行政区": ("香港", "港"), "澳门特别行政区": ("澳门", "澳"),
}

FULL = {n: n + "市" for n in (*MUNICIPALITIES, *CITIES)} | {n: n + "省" for n in PROVINCES} | REGIONS
#: The parts of an address, and the surest that each can be (see ``parse``).
KINDS = ("province", "city", "district", "street", "number", "building")
SUREST = {"province": 1.0, "city": 0.9, "district": 0.8, "street": 0.8, "number": 0.9, "building": 0.8}
NAMES = tuple(sorted({*FULL, *DISTRICTS}, key=lambda n: (-len(n), n)))


def _any(words) -> str:
    return "|".join(map(re.escape, sorted(words, key=lambda n: (-len(n), n))))


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))


def prepared(address: Column) -> Column:
    """Spaces squeezed, other characters out, full names of divisions shortened."""
    t = F.trim(F.regexp_replace(text_of(address), r"(?U)\s+", " "))
    t = F.regexp_replace(t, r'[^一-龥a-zA-Z0-9\s，。！？、；："（）【】\-+.]', "")
    for short, whole in FULL.items():
        t = F.replace(t, F.lit(whole), F.lit(short))
    return t


def parse(df: DataFrame, address: str = "address", to: str = "parsed") -> DataFrame:
    """Adds a struct (province, city, district, street, number, building as structs (value, confidence), full_address, confidence, is_complete, warnings, prepared).

    The first known name is the province and the first that is no municipality the city, so one name may be both, as the
    dictionary has provinces and cities in one. Streets, numbers and buildings need a division; absent parts are null.
    Each step is a projection of its own, so that what it found is computed once.
    """
    part = lambda v, c: F.when(v.isNotNull(), F.struct(v.alias("value"), (c if isinstance(c, Column) else F.lit(c)).cast("double").alias("confidence")))
    d = df.withColumn("_t", prepared(F.col(address)))
    d = d.withColumn("_tokens", F.regexp_extract_all("_t", F.lit(rf"{_any(NAMES)}|\d+|[一-龥]{{1,5}}?[区县市]|."), F.lit(0)))
    d = d.withColumns({
        "_province": F.get(F.filter("_tokens", lambda w: w.isin(*NAMES)), F.lit(0)),
        "_city": F.get(F.filter("_tokens", lambda w: w.isin(*NAMES) & ~w.isin(*MUNICIPALITIES)), F.lit(0)),
        "_district": F.get(F.filter("_tokens", lambda w: w.rlike("[区县市]$") & (F.length(w) > 1)), F.lit(0)),
    })
    d = d.withColumn("_rest", F.col("_t"))
    for v in ("_province", "_city", "_district"):
        d = d.withColumn("_rest", F.replace("_rest", F.coalesce(v, F.lit("\0")), F.lit("")))
    some = F.coalesce("_province", "_city", "_district").isNotNull()
    rest = F.trim("_rest")
    d = d.withColumns({"_street": F.when(some, _by_list(rest, STREETS)), "_number": F.when(some, F.coalesce(*[_first(rest, x) for x in NUMBERS]))})
    d = d.withColumn("_left", rest)
    for v in ("_street", "_number"):
        d = d.withColumn("_left", F.replace("_left", F.coalesce(v, F.lit("\0")), F.lit("")))
    guessed = F.when(F.col("_city").isNull() & F.col("_district").rlike("[区县]$"), F.substring("_district", F.lit(1), F.length("_district") - 1))
    made = {
        "province": part(F.col("_province"), F.when(F.col("_province").isin(*MUNICIPALITIES), 1.0).otherwise(0.9)), "city": F.coalesce(part(F.col("_city"), 0.9), part(guessed, 0.6)),
        "district": part(F.col("_district"), 0.8), "street": part(F.col("_street"), 0.8), "number": part(F.col("_number"), 0.9), "building": part(_by_list(F.trim("_left"), BUILDINGS), 0.8),
    }
    d = d.withColumns({f"_p_{k}": v for k, v in made.items()})
    has = {k: F.col(f"_p_{k}").isNotNull() for k in made}
    n = sum((c.cast("int") for c in has.values()), F.lit(0))
    bonus = F.when(has["province"] & has["city"], 0.1).otherwise(0.0) + F.when(has["street"] & has["number"], 0.1).otherwise(0.0)
    sure = F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), F.least(n * 0.1, F.lit(0.3)) + bonus + 0.5))
    lacks = {"province": "缺少省份信息", "city": "缺少城市信息", "district": "缺少区县信息"}
    said = F.array_compact(F.array(*[F.when(~has[k], v) for k, v in lacks.items()], F.when(~has["street"] & ~has["number"], "缺少街道和门牌号信息")))
    complete = (has["province"] & has["city"] & has["district"]) | (has["street"] & has["number"])
    whole = F.concat_ws("", *[F.col(f"_p_{k}.value") for k in made])
    out = F.struct(*[F.col(f"_p_{k}").alias(k) for k in made], whole.alias("full_address"), sure.alias("confidence"), complete.alias("is_complete"), said.alias("warnings"), F.col("_t").alias("prepared"))
    return d.withColumn(to, out).select(*df.columns, to)


def _by_list(text: Column, words: tuple[str, ...]) -> Column:
    """All up to the first word of the list that the text has behind something else."""
    return F.coalesce(*[_first(text, f".+?{re.escape(k)}") for k in words])


def similarity(a: Column, b: Column) -> Column:
    """Likeness of two parsed addresses: over the parts both have, positional likeness by the smaller confidence; without any, half that of the whole."""
    both = [a[k].isNotNull() & b[k].isNotNull() for k in KINDS]
    n = sum((x.cast("int") for x in both), F.lit(0))
    total = sum((F.when(x, positional_similarity(a[k]["value"], b[k]["value"]) * F.least(a[k]["confidence"], b[k]["confidence"])).otherwise(0.0) for x, k in zip(both, KINDS, strict=True)), F.lit(0.0))
    return F.when(n > 0, total / n).otherwise(positional_similarity(a["prepared"], b["prepared"]) * 0.5)


def _values(structs: pa.ChunkedArray, kind: str | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Of a column of parsed addresses the distinct values of a part (None: of the whole text), which of them each row has (-1: none) and how sure it is of it."""
    rows = structs.to_pylist()
    got = [(r["prepared"], 1.0) if kind is None else (r[kind]["value"], r[kind]["confidence"]) if r[kind] else (None, 0.0) for r in rows]
    place: dict[str, int] = {}
    which = np.array([-1 if v is None else place.setdefault(v, len(place)) for v, _ in got], np.int64)
    return list(place), which, np.array([c for _, c in got], np.float64)


def likenesses(a: list[str], b: list[str]) -> np.ndarray:
    """``positional_similarity`` of every text of ``a`` with every one of ``b``, place by place of the texts."""
    la, lb = (np.array([len(v) for v in x], np.int64) for x in (a, b))
    same = np.zeros((len(a), len(b)), np.int64)
    width = int(min(la.max(initial=0), lb.max(initial=0)))
    ca, cb = (np.array([[ord(c) for c in v[:width].ljust(width, "\0")] for v in x], np.int32).reshape(len(x), width) for x in (a, b))
    for i in range(width):
        same += (ca[:, i, None] == cb[None, :, i]) & (i < la)[:, None] & (i < lb)[None]
    short, long_ = np.minimum(la[:, None], lb[None]), np.maximum(la[:, None], lb[None])
    return np.where(short == 0, 0.0, 1.0 - (short - same) / np.maximum(long_, 1))


def tile_similarity(x: pa.ChunkedArray, y: pa.ChunkedArray) -> np.ndarray:
    """``similarity`` of every parsed address of ``x`` with every one of ``y``; a distinct value of a part is compared once."""
    n, total = np.zeros((len(x), len(y)), np.int64), np.zeros((len(x), len(y)))
    for kind in KINDS:
        (va, ia, ca), (vb, ib, cb) = _values(x, kind), _values(y, kind)
        both = (ia >= 0)[:, None] & (ib >= 0)[None]
        if both.any():
            n += both
            total += np.where(both, likenesses(va, vb)[ia[:, None], ib[None]] * np.minimum(ca[:, None], cb[None]), 0.0)
    if (n == 0).any():
        (va, ia, _), (vb, ib, _) = _values(x, None), _values(y, None)
        return np.where(n > 0, total / np.maximum(n, 1), likenesses(va, vb)[ia[:, None], ib[None]] * 0.5)
    return total / n


def _distinct_tiles(df: DataFrame, tile: int) -> DataFrame:
    """``df(p, ...)``, a row for each distinct parsed address, with its tile: which parts it has, province and city, and a share of those where they are more than a tile's."""
    has = F.concat(*[F.when(F.col(f"p.{k}").isNotNull(), "1").otherwise("0") for k in KINDS])
    d = df.withColumn("area", F.struct(has.alias("has"), F.col("p.province.value").alias("province"), F.col("p.city.value").alias("city")))
    parts = d.groupBy("area").agg(F.ceil(F.count("*") / tile).alias("_parts"))
    d = d.join(parts, "area").withColumn("tile", F.struct("area", F.pmod(F.xxhash64("p"), F.col("_parts")).alias("part"))).drop("area", "_parts")
    return d.withColumn("n", F.monotonically_increasing_id()).checkpoint()


def _bound(a: Column, b: Column) -> Column:
    """The greatest likeness that addresses of two tiles can have: provinces and cities are those of the tiles, other shared parts may be the same, all by the surest a part can be. A city guessed from a district is as sure as one named."""
    n, total = F.lit(0), F.lit(0.0)
    for i, kind in enumerate(KINDS):
        both = (F.substring(a["has"], i + 1, 1) == "1") & (F.substring(b["has"], i + 1, 1) == "1")
        like = positional_similarity(a[kind], b[kind]) if kind in ("province", "city") else F.lit(1.0)
        n = n + both.cast("int")
        total = total + F.when(both, like * SUREST[kind]).otherwise(0.0)
    return F.when(n > 0, total / n).otherwise(0.5)


def similar_addresses(df: DataFrame, candidates: DataFrame, k: int = 5, tile: int = 512, report: dict | None = None) -> DataFrame:
    """The k likest candidates for each address asked: ``df(record_id, address)``, ``candidates(candidate_id, address)`` to ``(record_id, candidate_id, similarity, rank)``; ties by ``candidate_id``.

    Equal parsed addresses are compared once, however many rows have them, and of a candidate address its k smallest ids are kept.
    Addresses lie in tiles by the parts they have, province and city. A tile first meets those of its own province and city; the
    k-th likeness found is what others have to reach, and only tiles whose bound reaches the least of a tile's meet it. A task holds
    two tiles and gives k candidates an address. Null candidate ids are left out. ``report`` receives how many pairs were
    ``compared`` of how many there are (``pairs``).
    """
    checkpoint_dir(df.sparkSession)
    # parsed once: what follows would copy the parser's expressions into each of its own
    asked = parse(df.select("record_id", "address"), to="p").select("record_id", "p").checkpoint()
    rows = parse(candidates.where("candidate_id IS NOT NULL").select("candidate_id", "address"), to="p").select("candidate_id", "p").checkpoint()
    # the k smallest ids of an address: of each of some shares of its rows first, so that no address has all its rows in one task
    share = F.pmod(F.xxhash64("candidate_id"), F.lit(64))
    for by in ([F.col("p"), share], [F.col("p")]):
        rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("candidate_id"))).where(F.col("_r") <= k).drop("_r")
    others = _distinct_tiles(rows.groupBy("p").agg(F.sort_array(F.collect_list("candidate_id")).alias("ids")), tile)
    mine = _distinct_tiles(asked.select("p").distinct(), tile)
    a_tiles = mine.groupBy(F.col("tile").alias("ta")).agg(F.count("*").alias("na"))
    b_tiles = others.groupBy(F.col("tile").alias("tb")).agg(F.count("*").alias("nb")).checkpoint()
    id_kind = candidates.schema["candidate_id"].dataType
    kinds = T.StructType([T.StructField("n", T.LongType()), T.StructField("ids", T.ArrayType(id_kind)), T.StructField("similarity", T.DoubleType())])
    arrow = to_arrow_schema(kinds)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        ids = right.column("r_ids").combine_chunks()
        first = pc.list_element(ids, 0)
        rank = np.empty(len(first), np.int64)
        rank[pc.sort_indices(first).to_numpy()] = np.arange(len(first))
        s = tile_similarity(left.column("p"), right.column("r_p"))
        best = np.stack([np.lexsort((rank, -row))[:k] for row in s])
        return pa.Table.from_arrays([pa.array(np.repeat(left.column("n").to_numpy(), best.shape[1])), ids.take(pa.array(best.ravel())), pa.array(np.take_along_axis(s, best, axis=1).ravel())], schema=arrow)

    def met(pairs: DataFrame) -> DataFrame:
        a = mine.select("n", "p", F.col("tile").alias("ta")).join(pairs.select("ta", "tb"), "ta")
        b = others.select(F.col("p").alias("r_p"), F.col("ids").alias("r_ids"), F.col("tile").alias("tb")).join(pairs.select("ta", "tb"), "tb")
        a, b = a.select("n", "p", "ta", "tb"), b.select("r_p", "r_ids", F.col("ta").alias("r_ta"), F.col("tb").alias("r_tb"))
        return a.groupBy("ta", "tb").cogroup(b.groupBy("r_ta", "r_tb")).applyInArrow(compare, kinds).checkpoint()

    place = lambda c: F.struct(F.col(f"{c}.area.province"), F.col(f"{c}.area.city"))
    # tiles of one area: a struct without nulls, so that absent parts are equal
    home = a_tiles.withColumn("at", place("ta")).join(b_tiles.withColumn("at", place("tb")), "at").select("ta", "tb", "na", "nb").checkpoint()
    found = met(home)
    kth = found.select("n", F.explode("ids").alias("id"), "similarity").withColumn("_r", F.row_number().over(Window.partitionBy("n").orderBy(F.col("similarity").desc()))).where(F.col("_r") == k)
    least = mine.join(kth.select("n", F.col("similarity").alias("kth")), "n", "left").groupBy(F.col("tile").alias("ta")).agg(F.count("*").alias("na"), F.min(F.coalesce("kth", F.lit(-1.0))).alias("least"))
    # tiles are as few as there are provinces, cities and sets of parts, times how full they are; only their names meet here
    rest = least.join(b_tiles, _bound(F.col("ta.area"), F.col("tb.area")) >= F.col("least") - 1e-9).join(home.select("ta", "tb"), ["ta", "tb"], "left_anti").select("ta", "tb", "na", "nb").checkpoint()
    if report is not None:
        met_pairs = home.unionAll(rest).agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0))).first()[0]
        report.update(compared=met_pairs, pairs=df.count() * candidates.count())
    every = found.unionAll(met(rest)).select("n", F.explode("ids").alias("candidate_id"), "similarity")
    best = every.withColumn("rank", F.row_number().over(Window.partitionBy("n").orderBy(F.col("similarity").desc(), "candidate_id"))).where(F.col("rank") <= k)
    return asked.join(mine.select("p", "n"), "p").join(best, "n").select("record_id", "candidate_id", "similarity", "rank")


def short_parse(df: DataFrame, address: str = "address", to: str = "parsed") -> DataFrame:
    """Adds the short parser's struct: province by alias, city and district as all before the first 市, 区 or 县, street and number of the rest, confidence .4/.3/.2/.1, warnings."""
    d = df.withColumn("_t", F.regexp_replace(text_of(F.col(address)), r"(?U)\s+", ""))
    table = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(a).alias("a")) for p, names in ALIASES.items() for a in names])
    d = d.withColumn("_hit", F.get(F.filter(table, lambda q: F.contains(F.col("_t"), q["a"])), F.lit(0)))
    d = d.withColumn("_rest", F.replace("_t", F.coalesce("_hit.a", F.lit("\0")), F.lit("")))
    upto = lambda c: F.when(F.instr("_rest", c) > 0, F.concat(F.substring_index("_rest", c, 1), F.lit(c)))
    d = d.withColumns({"_city": F.when(F.col("_hit").isNotNull(), upto("市")), "_district": F.coalesce(upto("区"), upto("县"))}).withColumn("_tail", F.col("_t"))
    for v in ("_city", "_district"):
        d = d.withColumn("_tail", F.replace("_tail", F.coalesce(v, F.lit("\0")), F.lit("")))
    d = d.withColumns({"_words": F.regexp_extract_all("_tail", F.lit(r"(?U)[^\d]+"), F.lit(0)), "_numbers": F.regexp_extract_all("_tail", F.lit(r"(?U)\d+"), F.lit(0)), "_empty": F.length(F.trim(text_of(F.col(address)))) < 2})
    got = {"province": F.col("_hit.p"), "city": F.col("_city"), "district": F.col("_district"), "street": F.trim(F.get("_words", F.size("_words") - 1)), "number": F.get("_numbers", F.lit(0))}
    weigh = {"province": 0.4, "city": 0.3, "district": 0.2}
    sure = sum((F.when(got[k].isNotNull(), w).otherwise(0.0) for k, w in weigh.items()), F.when(F.length("_t") > 10, 0.1).otherwise(0.0))
    said = F.when(F.col("_empty"), F.array(F.lit("地址文本为空或过短"))).otherwise(F.array_compact(F.array(F.when(F.col("_hit").isNull(), "无法识别省份"), F.when(F.col("_city").isNull(), "无法识别城市"))))
    fields = [F.when(~F.col("_empty"), v).alias(k) for k, v in got.items()]
    out = F.struct(*fields, F.when(~F.col("_empty"), F.concat_ws("", *got.values())).alias("full_address"), F.when(F.col("_empty"), 0.0).otherwise(F.least(sure, F.lit(1.0))).alias("confidence"), said.alias("warnings"))
    return d.withColumn(to, out).select(*df.columns, to)
