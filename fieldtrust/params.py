"""Thresholds, weights and word lists of the scoring rules; one object that becomes literals of the plan."""

from __future__ import annotations

from dataclasses import dataclass, field

# fixed values: marketing words that always count, and those a tenant has unless it sets its own
DEFAULT_KEYWORDS = (
    "超级", "强烈推荐", "必去", "必买", "必吃", "绝绝子", "yyds", "宝藏", "绝了", "太赞了", "太棒了", "超赞",
    "安利", "打卡", "网红", "排队", "火爆", "最好", "最佳", "最强", "最牛", "顶级", "极致", "完美", "无敌", "No.1", "number one",
    "全网第一", "销量第一", "行业第一", "排名第一", "人气", "爆款", "新品", "限时", "优惠", "折扣",
    "免费", "赠品", "抽奖", "活动", "促销", "大促", "套餐", "团购", "优惠价", "最低价", "特价",
    "网红店", "网红打卡", "网红景点", "打卡胜地", "必打卡", "好评", "五星好评", "好评如潮", "口碑推荐",
    "不容错过", "错过后悔", "机不可失", "限时抢购", "手慢无",
)
TENANT_KEYWORDS = ("超级", "强烈推荐", "必去", "必买", "绝绝子", "yyds", "宝藏", "绝了", "太赞了", "太棒了")
# fixed values: phrases that mark a templated text
TEMPLATES = (
    "(?:超级|强烈|非常|特别){2,}",
    "(?:推荐|安利|必去|必买|必吃){2,}",
    "(?iu)(?:yyds|绝绝子|绝了|宝藏)",
    "!{3,}|！{3,}",
    "(?:超级|强烈|特别|非常)(?:推荐|安利|介绍)",
    "(?:必去|必买|必吃|必玩)(?:之地|地方|店铺|餐厅|景点|店)",
    "(?:打卡|网红|排队|火爆|人气)(?:地点|地方|店铺|餐厅|景点|店|胜地)",
    r"(?iu)(?:最好|最佳|最强|最牛|全网第一|销量第一|行业第一|排名第一|顶级|极致|完美|无敌|No\.?1|number\s*one)",
)


@dataclass(frozen=True)
class Params:
    lat_min: float = 18.0
    lat_max: float = 54.0
    lon_min: float = 73.0
    lon_max: float = 135.0
    edge_degrees: float = 5.0
    max_speed_kmh: float = 350.0
    teleport_km: float = 100.0
    teleport_seconds: float = 60.0
    per_minute: int = 10
    per_hour: int = 100
    min_length: int = 5
    max_length: int = 500
    keywords: tuple[str, ...] = TENANT_KEYWORDS
    default_keywords: tuple[str, ...] = DEFAULT_KEYWORDS
    templates: tuple[str, ...] = TEMPLATES
    simhash_distance: int = 3
    simhash_short: int = 20
    cosine: float = 0.85
    cluster_size: int = 5
    geo_weight: float = 0.30
    text_weight: float = 0.40
    simhash_weight: float = 0.15
    semantic_weight: float = 0.15
    batch_semantic_weight: float = 0.25
    neural_weight: float = 0.15
    medium: float = 35.0
    high: float = 60.0
    high_severity: float = 0.8
    marketing_fake: int = 5
    marketing_medium: int = 3
    confidence_step: float = 0.02
    reliability: dict = field(default_factory=lambda: {"rules": 1.0, "cross_validation": 0.8, "ai_model": 0.7})


DEFAULT = Params()
