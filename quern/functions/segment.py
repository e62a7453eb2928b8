"""Words of a text, as columns: letters stand together, Han characters are cut by a dictionary.

One pattern does it: its branches are tried in order, so the longest dictionary word at a place wins (forward maximum matching), a Han character outside all words is a
word of its own, and what stands between words is a token too.  Tokens join to the text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Common words of our own choice; callers may pass others.
WORDS = (
    "我们 你们 他们 她们 自己 大家 今天 明天 昨天 现在 以后 以前 时候 时间 天气 心情 地方 东西 问题 事情 朋友 孩子 老师 学生 学校 公司 工作 生活 世界 中国 北京 上海 "
    "城市 国家 社会 经济 文化 历史 音乐 电影 电话 手机 电脑 网络 汽车 火车 飞机 医院 医生 菜品 味道 服务 服务员 环境 价格 便宜 态度 餐厅 饭店 酒店 客人 "
    "什么 怎么 怎样 怎么样 为什么 哪里 哪个 多少 可以 可能 应该 需要 知道 觉得 认为 喜欢 希望 开始 结束 出来 起来 看到 听到 告诉 帮助 学习 "
    "因为 所以 但是 如果 虽然 而且 或者 以及 不是 不错 没有 还是 已经 正在 非常 特别 比较 一起 一样 一个 一些 一下 这个 那个 这些 那些 这样 那样 这里 那里 "
    "很好 好吃 好看 漂亮 高兴 快乐 重要 简单 容易 困难 男人 女人 先生 小姐 妈妈 爸爸 句子 末尾 钓鱼 有人"
).split()
HAN = r"[\x{3400}-\x{9FFF}]"
#: Runs of letters with case and of modifiers, of which no Han word has any; letters of other scripts stand alone.
LETTERS = r"[\p{Lu}\p{Ll}\p{Lt}\p{Lm}]+"
#: Tokens that count as words, by unit: those with a Han character, or those with any letter.
IS_WORD = {"han": HAN, "letter": r"\p{L}"}


def pattern(words: Sequence[str] = WORDS) -> str:
    longest_first = sorted(set(words), key=lambda w: (-len(w), w))
    return "|".join([LETTERS, r"[^\p{L}]+", *map(re.escape, longest_first), HAN, r"\p{Lo}"])


def tokens(text: Column, words: Sequence[str] = WORDS) -> Column:
    """All tokens of the text in order; they join to the text."""
    return F.regexp_extract_all(text, F.lit(f"({pattern(words)})"), 1)


def span(tokens: Column, i: Column) -> tuple[Column, Column]:
    """Start and end of token ``i`` in the text."""
    start = F.length(F.array_join(F.slice(tokens, F.lit(1), i), ""))
    return start, start + F.length(F.get(tokens, i))
