"""News analytics as column expressions: tokens, sentiment, event types, symbols."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of good news, in the given order.
POSITIVE = [
    "增长", "大涨", "飙升", "盈利", "扭亏", "预增", "超预期", "创新高", "突破", "放量", "强势", "利好", "提振", "回升", "反弹", "复苏", "繁荣", "景气",
    "扩张", "加速", "降准", "降息", "放水", "宽松", "支持", "扶持", "鼓励", "减税", "降费", "刺激", "利好政策", "放量", "看涨", "买入", "推荐", "增持",
    "乐观", "信心", "机会", "低估值", "价值洼地", "黄金坑", "抄底", "回购", "分红", "送转", "增持", "中标", "合同签订",
]
# Words of bad news, in the given order.
NEGATIVE = [
    "下跌", "大跌", "暴跌", "亏损", "预亏", "爆雷", "不及预期", "新低", "破位", "缩量", "利空", "拖累", "下滑", "回落", "衰退", "萧条", "萎缩", "放缓",
    "恶化", "违约", "暴雷", "加息", "收紧", "去杠杆", "处罚", "立案", "调查", "退市", "st", "风险提示", "监管", "整顿", "查封", "看跌", "卖出",
    "减持", "悲观", "恐慌", "逃离", "踩踏", "泡沫", "崩盘", "失守", "危机", "减持", "质押", "冻结", "违约", "逾期", "仲裁", "诉讼",
]
# Words that weigh the next one, with their weights.
INTENSIFIERS = {
    "大幅": 1.5, "明显": 1.3, "显著": 1.3, "略有": 0.5, "小幅": 0.5, "较为": 0.8, "极度": 1.8, "严重": 1.8, "强烈": 1.5,
}
# Words that turn the next one around.
NEGATORS = [
    "不", "未", "没有", "并非", "无", "否", "不会", "未能", "尚未",
]
# Event types in the given order, each with its keywords.
KEYWORDS = {
    "policy": [
        "政策", "监管", "证监会", "央行", "降准", "降息", "加息", "LPR", "利率", "存款准备金", "逆回购", "MLF", "国常会", "政治局", "国务院", "发改委",
        "财政部", "税务总局",
    ],
    "earnings": [
        "财报", "营收", "净利润", "业绩预告", "快报", "EPS", "每股收益", "同比增长", "环比增长", "扭亏", "预增", "预亏",
    ],
    "macro": [
        "GDP", "CPI", "PPI", "PMI", "社融", "M2", "M1", "M0", "出口", "进口", "贸易顺差", "外汇储备", "通胀", "通缩", "非农", "失业率",
        "消费者信心",
    ],
    "geo": [
        "地缘", "冲突", "战争", "制裁", "关税", "贸易战", "中美", "俄乌", "中东", "欧盟", "北约", "联合国", "外交", "大使", "声明", "抗议",
    ],
    "industry": [
        "产业链", "供应链", "涨价", "降价", "产能", "供需", "新能源", "光伏", "锂电", "芯片", "半导体", "AI", "人工智能", "大模型", "医药", "集采", "房地产",
        "基建",
    ],
    "company": [
        "涨停", "跌停", "停牌", "复牌", "增持", "减持", "回购", "分红", "送转", "配股", "定增", "并购", "重组", "借壳", "退市", "ST", "立案", "调查",
        "处罚",
    ],
    "market": [
        "大盘", "沪指", "深成指", "创业板指", "科创板", "北向资金", "主力资金", "成交量", "A股", "港股", "美股", "牛市", "熊市", "震荡", "反弹",
    ],
    "tech": [
        "技术突破", "研发", "专利", "创新", "首发", "芯片制程", "光刻机", "量子计算", "无人驾驶",
    ],
}
# Importance of each event type.
IMPORTANCE = {
    "geo": 0.9, "macro": 0.85, "policy": 0.8, "earnings": 0.7, "company": 0.65, "market": 0.6, "industry": 0.5,
    "tech": 0.4, "other": 0.2,
}
# Names of companies with their codes; some have none.
NAMES = {
    "贵州茅台": "600519.SH", "中国平安": "601318.SH", "招商银行": "600036.SH", "宁德时代": "300750.SZ", "五粮液": "000858.SZ",
    "比亚迪": "002594.SZ", "药明康德": "603259.SH", "隆基绿能": "601012.SH", "中信证券": "600030.SH", "东方财富": "300059.SZ",
    "工商银行": "601398.SH", "建设银行": "601939.SH", "中国石油": "601857.SH", "中国移动": "600941.SH", "华为": "", "字节跳动": "",
}


def _any_of(terms: list[str]) -> str:
    """A pattern of the longest term that fits."""
    return "|".join(re.escape(t) for t in sorted(dict.fromkeys(terms), key=lambda t: (-len(t), t)))


def tokenize(text: Column, terms: list[str]) -> Column:
    """Lower-cased tokens: at each place the longest term that fits, else one character."""
    pattern = _any_of(terms)
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"(?s)({pattern}|.)" if pattern else "(?s)(.)"), F.lit(1))


def with_sentiment(
    df: DataFrame, text: Column, positive: list[str] | None = None, negative: list[str] | None = None, intensifiers: dict[str, float] | None = None, negators: list[str] | None = None
) -> DataFrame:
    """Adds score in [-1, 1], magnitude in [0, 1] and labels of a text; a listed word counts with the weight of an intensifier before
    it and -0.5 of it behind a negator, also one before the intensifier. Only runs of terms that follow one another are taken from a text, since
    other characters are tokens that count for nothing; in a run each term goes through the rule together with the two before it."""
    pos, neg = positive or POSITIVE, negative or NEGATIVE
    strong, nots = INTENSIFIERS if intensifiers is None else intensifiers, NEGATORS if negators is None else negators
    prefix = "__"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    t, n, r, s = (prefix + x for x in "tnrs")  # names that no column has
    listed = lambda c, words: c.isin(words) if words else F.lit(False)
    weight = F.create_map(*[F.lit(x) for kv in strong.items() for x in kv]) if strong else None
    pattern = _any_of([*pos, *neg, *strong, *nots])
    df = df.withColumn(t, F.lower(F.coalesce(text, F.lit(""))))
    df = df.withColumn(r, F.regexp_extract_all(t, F.lit(f"(?:{pattern})++"), F.lit(0)))  # possessive: a loop, however long a run is

    def value(w: Column, b: Column, bb: Column) -> Column:
        x = F.coalesce(F.try_element_at(weight, b), F.lit(1.0)) if weight is not None else F.lit(1.0)
        negated = listed(b, nots) | (listed(b, list(strong)) & listed(bb, nots))
        return F.when(negated, -0.5 * x).otherwise(x)

    none = F.lit("")
    start = F.struct(F.lit(0.0).alias("r"), F.lit(0.0).alias("t"), F.lit(0).alias("less"), none.alias("b"), none.alias("bb"))

    def term(y: Column, w: Column, b: Column, bb: Column) -> Column:
        x = value(w, b, bb)
        p, q = F.when(listed(w, pos), x).otherwise(0.0), F.when(listed(w, neg), x).otherwise(0.0)
        return F.struct((y["r"] + p - q).alias("r"), (y["t"] + F.abs(p) + F.abs(q)).alias("t"), (y["less"] + F.length(w) - 1).alias("less"), w.alias("b"), b.alias("bb"))

    def run(y: Column, x: Column) -> Column:
        single = term(y, x, none, none)
        begun = F.struct(y["r"].alias("r"), y["t"].alias("t"), y["less"].alias("less"), none.alias("b"), none.alias("bb"))
        several = F.aggregate(F.regexp_extract_all(x, F.lit(f"({pattern})"), F.lit(1)), begun, lambda z, w: term(z, w, z["b"], z["bb"]))
        return F.when(listed(x, list(dict.fromkeys([*pos, *neg, *strong, *nots]))), single).otherwise(several)

    sums = F.aggregate(r, start, run)
    df = df.withColumn(s, sums).withColumn(n, F.length(t) - F.col(s)["less"])
    total = F.col(s)["t"]
    score = F.when(total > 0, F.least(F.greatest(F.col(s)["r"] / total, F.lit(-1.0)), F.lit(1.0))).otherwise(0.0)
    df = df.withColumn("score", score).withColumn("magnitude", F.least(F.lit(1.0), total / F.greatest(n, F.lit(1)) * 2))
    return df.withColumn("labels", sentiment_labels(F.col("score"), F.col("magnitude"))).drop(t, n, r, s)


def sentiment_labels(score: Column, magnitude: Column) -> Column:
    base = F.when(score > 0.2, "positive").when(score < -0.2, "negative").otherwise("neutral")
    strong = F.when((magnitude > 0.6) & (score > 0.3), "greed").when((magnitude > 0.6) & (score < -0.3), "fear")
    return F.array_compact(F.array(base, strong))


def event_types(text: Column, keywords: dict[str, list[str]] | None = None, word_boundary: bool = False) -> Column:
    """Types by falling number of their keywords that the text holds, ties in the given order; ["other"] for none. The text is
    lower-cased once, and each keyword is looked for once. With ``word_boundary`` a keyword of Latin letters or digits does not count inside a longer word."""

    def held(low: Column, word: str) -> Column:
        if word_boundary:
            before, after = ("(?<![a-z0-9])" if re.match("[a-z0-9]", word) else ""), ("(?![a-z0-9])" if re.search("[a-z0-9]$", word) else "")
            if before or after:
                return F.rlike(low, F.lit(before + re.escape(word) + after))
        return F.contains(low, F.lit(word))

    def counted(low: Column) -> Column:
        found = []
        for order, (name, words) in enumerate((keywords or KEYWORDS).items()):
            n = sum((held(low, w.lower()).cast("int") for w in words), F.lit(0))
            found.append(F.struct((-n).alias("n"), F.lit(order).alias("o"), F.lit(name).alias("name")))
        return F.array_sort(F.filter(F.array(*found), lambda x: x["n"] < 0))

    def named(hits: Column) -> Column:
        return F.when(F.size(hits) > 0, F.transform(hits, lambda x: x["name"])).otherwise(F.array(F.lit("other")))

    return _once(_once(F.lower(F.coalesce(text, F.lit(""))), counted), named)


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def event_importance(types: Column) -> Column:
    lookup = F.create_map(*[F.lit(x) for kv in IMPORTANCE.items() for x in kv])
    return F.coalesce(F.try_element_at(lookup, F.coalesce(F.get(types, F.lit(0)), F.lit(""))), F.lit(0.3))


def extract_codes(text: Column, word_boundary: bool = False) -> Column:
    """Six-digit codes with their exchange, given or from the first digit; sorted and distinct. With ``word_boundary`` six digits inside a
    longer number or word are no code."""
    text = F.coalesce(text, F.lit(""))
    code = r"(\d{6})(?:\.(SH|SZ|BJ))?"
    pattern = F.lit(rf"(?<![0-9A-Za-z]){code}(?![0-9A-Za-z])" if word_boundary else code)
    codes, ends = F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2))

    def full(code: Column, end: Column) -> Column:
        first = F.substring(code, 1, 1)
        guess = F.when(first.isin("6", "9"), "SH").when(first.isin("0", "3", "2"), "SZ").when(first == "4", "BJ")
        return F.concat(code, F.lit("."), F.when(end != "", end).otherwise(guess))

    return F.array_sort(F.array_distinct(F.array_compact(F.zip_with(codes, ends, full))))


def extract_names(text: Column, names: dict[str, str] | None = None) -> Column:
    """Codes of the names that the text holds, in the dictionary's order; names without a code are left out."""
    text = F.coalesce(text, F.lit(""))
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(n)), F.lit(c)) for n, c in (names or NAMES).items() if c]))


def extract_symbols(text: Column, names: dict[str, str] | None = None) -> Column:
    return F.array_sort(F.array_union(extract_codes(text), extract_names(text, names)))


def tag_news(news: DataFrame, title: str = "title", content: str = "content", keywords: dict[str, list[str]] | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """Adds symbols, tags and importance; works on streams too."""
    text = F.concat_ws(" ", title, content)
    return news.withColumn("symbols", extract_symbols(text, names)).withColumn("tags", event_types(text, keywords)).withColumn("importance", event_importance(F.col("tags")))


def daily_sentiment(scored: DataFrame, days: DataFrame) -> DataFrame:
    """(symbol, date, sentiment, magnitude, news_count) on the given days; zeros on days without news. scored: symbols, published_at, score, magnitude."""
    rows = scored.withColumn("symbol", F.explode("symbols")).groupBy("symbol", F.to_date("published_at").alias("date"))
    daily = rows.agg(F.avg("score").alias("sentiment"), F.avg("magnitude").alias("magnitude"), F.count("*").alias("news_count"))
    grid = daily.select("symbol").distinct().join(F.broadcast(days.select(F.col("day").alias("date"))), how="cross")  # symbols by business days
    return grid.join(daily, ["symbol", "date"], "left").na.fill({"sentiment": 0.0, "magnitude": 0.0, "news_count": 0})


def news_filter(news: DataFrame, start: Column, end: Column, keywords: list[str] | None = None, title: str = "title", content: str = "content") -> DataFrame:
    """News of a time range that hold any of the keywords in title or content, whatever the case."""
    out = news.filter((F.col("published_at") >= start) & (F.col("published_at") <= end))
    if keywords:
        low = F.lower(F.concat_ws("\n", title, content))
        hit = F.lit(False)
        for k in keywords:
            hit = hit | F.contains(low, F.lit(k.lower()))
        out = out.filter(hit)
    return out


def latest_news(news: DataFrame, n: int, content: str = "content") -> DataFrame:
    """The newest n news, content cut to 200 characters."""
    return news.orderBy(F.col("published_at").desc(), "news_id").limit(n).withColumn(content, F.substring(content, 1, 200))
