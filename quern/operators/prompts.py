"""Prompt templates and their routing by task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import options_block

# fixed values: template version -> (task, greatest number of new tokens, template)
SYSTEM = (
    "你是一个严格的文本分类器。\n请严格遵守以下规则：\n1. 只输出一个允许标签。\n2. 不要解释理由。\n3. 不要复述输入。\n4. 不要添加\"答案是\"\"Label\"\"Answer\"等前缀。\n"
    "5. 不要添加句号、引号、括号或其他标点。\n6. 不要输出多个标签。\n7. 即使不确定，也必须从允许标签中选择最符合的一项。"
)
TEMPLATES = {
    "pawsx-binary-v2": ("pair_paraphrase", 4, "任务：判断下面两个句子的核心语义是否相同。\n\n标签定义：\n1 = 语义相同\n0 = 语义不同\n\n句子A：\n{text_a}\n\n句子B：\n{text_b}\n\n允许输出：0 或 1\n\n答案："),
    "xnli-nli-v2": ("nli", 8, "任务：自然语言推断。\n\n请根据\"前提\"判断\"假设\"与它的逻辑关系。\n\n标签定义：\nentailment = 前提能够推出假设\nneutral = 前提既不能推出也不能否定假设\ncontradiction = 前提与假设矛盾\n\n前提：\n{text_a}\n\n假设：\n{text_b}\n\n允许输出：entailment、neutral 或 contradiction\n\n答案："),
    "lcqmc-binary-v2": ("question_matching", 4, "任务：判断下面两个问题表达的意思是否相同。\n\n标签定义：\n1 = 两个问题表达相同或基本相同的意思\n0 = 两个问题表达不同的意思\n\n问题A：\n{text_a}\n\n问题B：\n{text_b}\n\n允许输出：0 或 1\n\n答案："),
    "asap-polarity-v2": ("sentiment_polarity", 4, "任务：判断下面评论的整体情感极性。\n\n标签定义：\npositive = 整体评价为正面\nnegative = 整体评价为负面\n\n评论：\n{text_a}\n\n允许输出：positive 或 negative\n\n答案："),
    "asap-rating-v1": ("sentiment_rating", 4, "任务：判断下面评论的整体星级评分。\n\n请根据评论内容，从 1 到 5 星中选择一个最符合的评分。\n1 = 1 星，2 = 2 星，3 = 3 星，4 = 4 星，5 = 5 星\n\n评论：\n{text_a}\n\n允许输出：1、2、3、4 或 5\n\n答案："),
    "c3-letter-v2": ("multiple_choice_mrc", 4, "任务：根据材料回答一道单项选择题。\n\n请阅读材料和问题，从给出的选项中选择唯一正确答案。\n\n材料：\n{context}\n\n问题：\n{question}\n\n选项：\n{options_block}\n\n只输出正确选项的一个大写字母。\n不要输出选项文本。\n不要解释理由。\n\n允许输出：{allowed_letters}\n\n答案："),
}


def registry(spark: SparkSession) -> DataFrame:
    """version, task, max_new_tokens: one row for each template."""
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{v}', '{t}', {n})" for v, (t, n, _) in TEMPLATES.items()) + " AS t(version, task, max_new_tokens)")


def version_of(task: Column) -> Column:
    """The template of a task; an unknown task is an error."""
    out = F.raise_error(F.concat(F.lit("unknown task: "), F.coalesce(task, F.lit("null"))))
    for version, (name, _, _) in TEMPLATES.items():
        out = F.when(task == name, version).otherwise(out)
    return out


def max_tokens(version: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, (_, n, _) in TEMPLATES.items():
        out = F.when(version == name, n).otherwise(out)
    return out


def _fill(template: str, fields: dict[str, Column]) -> Column:
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[fields[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p])


def user_prompt(task: Column, payload: dict[str, Column]) -> Column:
    """The filled template of the task; ``payload``: text_a, text_b, context, question, options as far as tasks need them."""
    fields = dict(payload)
    if "options" in payload:
        fields |= {"options_block": options_block(payload["options"]), "allowed_letters": F.array_join(F.transform(payload["options"], lambda o, i: F.char(i.cast("long") + 65)), " ")}
    out = F.lit(None).cast("string")
    for name, _, template in TEMPLATES.values():
        import re

        if set(re.findall(r"\{(\w+)\}", template)) <= set(fields):
            out = F.when(task == name, _fill(template, fields)).otherwise(out)
    return out


def messages(user: Column) -> Column:
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(SYSTEM).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))
