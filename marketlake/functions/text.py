"""Keyword and list expressions."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default lexicon and the event keywords, first match wins.
POSITIVE = {
    "增长": 1.0, "盈利": 1.2, "超预期": 1.3, "中标": 1.0, "回购": 1.1, "增持": 1.2, "突破": 0.9, "创新高": 1.2,
    "分红": 1.0, "利好": 1.1, "签约": 0.8, "获批": 1.0, "大涨": 1.0, "涨停": 0.8,
}
NEGATIVE = {
    "亏损": 1.2, "下降": 0.9, "减持": 1.1, "立案": 1.3, "处罚": 1.3, "警示": 1.0, "诉讼": 1.1, "违约": 1.2,
    "退市": 1.4, "风险": 0.7, "下滑": 1.0, "暴雷": 1.4, "调查": 1.1, "大跌": 1.0, "跌停": 0.8,
}
EVENT_TYPES = (
    ("行政处罚", "penalty"), ("处罚决定", "penalty"), ("立案", "investigation"), ("调查", "investigation"),
    ("监管函", "regulatory_letter"), ("警示函", "warning_letter"), ("处分", "disciplinary"),
)


def _weight(text: Column, lexicon: dict[str, float]) -> Column:
    return reduce(add, (F.when(text.contains(k), w).otherwise(0.0) for k, w in lexicon.items()))


def keyword_sentiment(text: Column, positive: dict[str, float] = POSITIVE, negative: dict[str, float] = NEGATIVE) -> Column:
    """(p - n) / (p + n) over keywords that occur, each once; 0 without any."""
    t = F.coalesce(text, F.lit(""))
    p, n = _weight(t, positive), _weight(t, negative)
    return F.when(p + n == 0, 0.0).otherwise((p - n) / (p + n))


def mentions(text: Column, keywords: tuple[tuple[str, str], ...] = EVENT_TYPES) -> Column:
    return reduce(or_, (text.contains(k) for k, _ in keywords))


def event_type(text: Column, keywords: tuple[tuple[str, str], ...] = EVENT_TYPES, default: str = "regulatory") -> Column:
    return reduce(lambda rest, kt: F.when(text.contains(kt[0]), kt[1]).otherwise(rest), reversed(keywords), F.lit(default))


def related_symbols(raw: Column) -> Column:
    """Upper-cased symbols of a list split at ; and , ; anything else in it, other exchanges too, is dropped."""
    parts = F.transform(F.split(F.coalesce(raw, F.lit("")), "[;,]"), lambda s: F.upper(F.trim(s)))
    return F.filter(parts, lambda s: s.rlike(r"^[0-9]{6}\.(SH|SZ)$"))


def sector_name(name: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(name, F.lit("")), r"[ⅠⅡⅢIVⅣ\s]", "")
    return F.replace(F.replace(bare, F.lit("概念"), F.lit("")), F.lit("板块"), F.lit(""))


def board_to_bk(board: Column) -> Column:
    return F.concat(F.lit("BK"), F.lpad(F.regexp_replace(board.cast("string"), r"\D", ""), 4, "0"))


def bk_to_board(bk: Column) -> Column:
    return F.regexp_replace(bk, r"^BK0*", "")
