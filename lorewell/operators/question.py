"""Understanding questions in batch: aliases, intent, category, dialogue context."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions import rulesets as R
from lorewell.functions.text import is_blank, strip
from lorewell.operators.classify import SHARD_KEYWORDS, classify_first_match, keyword_matches
from lorewell.scale import let, top_per_key

# Text added to expanded and to planned questions, and between turns.
ALIAS_LINE = ("\n检索规范词：", "、")
FOLLOW_UP = "\n后续问题："
UNKNOWN_SOURCE = "未指定"
INTENT_CATEGORY = "ACADEMIC"
PLAN = (
    "原问题：{question}\n转专业目标：{target}\n来源专业：{source}\n"
    "检索重点：{target}专业或所属学院当期转专业接收条件、专业要求、名额、学业表现、笔试、面试和考核办法；"
    "补充学校统一转专业规定；仅在存在明确转出限制时参考{source}的转出规则。"
)

# Phrases that are no transfer questions, subjects that are no target, and the
# sentence patterns of transfer questions in the order they are tried.
NOT_A_TRANSFER = ("转账", "跳转", "转发", "转接", "转让")
NOT_A_TARGET = ("学校", "本科生", "学生")
MANY_DETAILS = r"(?:名额|笔试|面试|考核方式)"
TWO_SIDED = (
    r"(?:请问|想问|我想)?(?:从)?([\p{IsHan}A-Za-z0-9（）()·+\-]{2,24}?)(?:专业)?转(?:入|到|去)([\p{IsHan}A-Za-z0-9（）()·+\-]{2,24}?)(?:专业|学院)?(?:的)?(?:(?:有?什么|需要什么)?(?:条件|要求|名额|考核)|考什么|怎么考|怎么转|可以吗|是否可以|能不能|申请)",
    r"(?:请问|想问|我想)?从([\p{IsHan}A-Za-z0-9（）()·+\-]{2,24}?)(?:专业)?转(?:入|到|去)([\p{IsHan}A-Za-z0-9（）()·+\-]{2,24}?)(?:专业|学院)?(?:可以吗|行吗|吗|[?？]|$)",
    r"(?:请问|想问|我想)?([\p{IsHan}A-Za-z0-9（）()·+\-]{2,24}?)(?:专业)?转([\p{IsHan}A-Za-z0-9（）()·+\-]{2,24}?)(?:专业|学院)?(?:的)?(?:(?:有?什么|需要什么)?(?:条件|要求|名额|考核)|考什么|怎么考|怎么转|可以吗|是否可以|能不能|申请)",
)
TARGET_ONLY = (
    r"([\p{IsHan}A-Za-z0-9（）()·+\-]{2,24}?)(?:专业|学院)?(?:接收转专业|转专业接收).*(?:(?:(?:有?什么|需要什么)?(?:条件|要求|名额|考核)|考什么|怎么考|怎么转|可以吗|是否可以|能不能|申请)|学生|吗)",
    r"转入([\p{IsHan}A-Za-z0-9（）()·+\-]{2,24}?)(?:专业|学院)?(?:的)?(?:(?:有?什么|需要什么)?(?:条件|要求|名额|考核)|考什么|怎么考|怎么转|可以吗|是否可以|能不能|申请)",
    r"([\p{IsHan}A-Za-z0-9（）()·+\-]{2,24}?)(?:专业|学院)?转专业(?:(?:(?:有?什么|需要什么)?(?:条件|要求|名额|考核)|考什么|怎么考|怎么转|可以吗|是否可以|能不能|申请)|政策|细则)",
    r"([\p{IsHan}A-Za-z0-9（）()·+\-]{2,24}?)(?:专业|学院)?(?:的)?(?:名额|笔试|面试|考核方式)(?:[、，,和及/]|还有|以及).*(?:名额|笔试|面试|考核方式)",
)
SUBJECT_TRIMS = (r"^(?:请问|想问|我想|能否|可以)", r"(?:有什么|什么|需要什么)$", r"(?:专业|学院)$")


def alias_violations(aliases: DataFrame) -> DataFrame:
    """(alias, problem) for blank terms, unknown categories and aliases with two owners."""
    row_checks = aliases.select("alias", F.explode(F.filter(F.array(
        F.when(is_blank(F.col("canonical")), F.lit("canonical_blank")),
        F.when(is_blank(F.col("alias")), F.lit("alias_blank")),
        F.when(~is_blank(F.col("category")) & ~F.col("category").isin(*R.CATEGORIES), F.lit("category_invalid")),
    ), lambda p: p.isNotNull())).alias("problem"))
    owners = (
        aliases.groupBy("alias").agg(F.count_distinct("canonical").alias("owners"))
        .where(F.col("owners") > 1).select("alias", F.lit("alias_conflict").alias("problem")))
    return row_checks.distinct().unionByName(owners)


def _expanded(question: Column, matched: Column) -> tuple[Column, Column]:
    """(canonical terms, retrieval question) from matches ordered longest alias first."""
    visible = let(matched, lambda found: F.filter(found, lambda m, i: ~F.exists(
        F.slice(found, F.lit(1), i), lambda longer: F.contains(longer["alias"], m["alias"]))))
    terms = F.array_distinct(F.transform(
        F.filter(visible, lambda m: (m["alias"] != m["canonical"]) & ~F.contains(question, m["canonical"])),
        lambda m: m["canonical"]))
    lead, comma = ALIAS_LINE
    expanded = let(terms, lambda t: F.when(F.size(t) == 0, question).otherwise(
        F.concat(question, F.lit(lead), F.array_join(t, comma))))
    return terms, expanded


def expand_aliases(questions: DataFrame, question: str, aliases: DataFrame,
                   shard: int = SHARD_KEYWORDS) -> DataFrame:
    """Add ``canonical_terms`` and ``retrieval_question``.

    The longest alias is taken first and hides aliases inside it; ``seq`` orders equally long ones. ``aliases``:
    canonical, alias, seq. Null and empty aliases are skipped; a null question keeps no terms.
    """
    listed = aliases.select(F.col("alias").alias("keyword"), "canonical", "seq")
    staged = keyword_matches(questions, question, listed, "__found", shard)
    ordered = F.sort_array(F.transform("__found", lambda m: F.struct(
        (-F.length(m["keyword"])).alias("length"), m["seq"].alias("seq"), m["canonical"].alias("canonical"), m["keyword"].alias("alias"))))
    staged = staged.withColumn("__matched", F.transform(
        ordered, lambda m: F.struct(m["canonical"].alias("canonical"), m["alias"].alias("alias"))))
    terms, expanded = _expanded(F.col(question), F.col("__matched"))
    return staged.withColumns({"canonical_terms": terms, "retrieval_question": expanded}).drop("__matched", "__found")


def _subject(value: Column) -> Column:
    for pattern in SUBJECT_TRIMS:
        value = F.regexp_replace(value, pattern, "")
    return strip(value)


def transfer_intent(question: Column, institution: Sequence[str] = ()) -> Column:
    """Struct (source, target) of a transfer question, null when it is none.

    ``institution`` lists names of the institution itself, which are never a target.
    """
    text = F.replace(F.replace(F.regexp_replace(question, r"\s+", ""), F.lit("？"), F.lit("?")), F.lit("，"), F.lit(","))
    excluded = (*institution, *NOT_A_TARGET)

    def tried(normal: Column) -> Column:
        def hit(pattern: str, two_sided: bool) -> Column:
            target = _subject(F.regexp_extract(normal, pattern, 2 if two_sided else 1))
            source = _subject(F.regexp_extract(normal, pattern, 1)) if two_sided else F.lit(None).cast("string")
            return let(F.struct(source.alias("source"), target.alias("target")), lambda s: F.when(
                ~is_blank(s["target"]) & ~s["target"].isin(*excluded),
                F.struct(F.when(s["source"] != s["target"], s["source"]).alias("source"), s["target"].alias("target"))))

        # Every pattern needs one of these words; most texts have none and skip the patterns.
        possible = F.contains(normal, F.lit("转")) | normal.rlike(MANY_DETAILS)
        barred = ~possible
        for phrase in NOT_A_TRANSFER:
            barred = barred | F.contains(normal, F.lit(phrase))
        return F.when(~barred, F.coalesce(
            *[hit(p, True) for p in TWO_SIDED], *[hit(p, False) for p in TARGET_ONLY]))

    return F.when(~is_blank(question), let(text, tried))


def planned_question(question: Column, intent: Column) -> Column:
    """The retrieval text of a transfer question; other questions stay as they are."""
    def planned(found: Column) -> Column:
        source = F.coalesce(found["source"], F.lit(UNKNOWN_SOURCE))
        values = {"question": strip(question), "target": found["target"], "source": source}
        pieces: list[Column] = []
        rest = PLAN
        while "{" in rest:
            text, _, tail = rest.partition("{")
            name, _, rest = tail.partition("}")
            pieces += [F.lit(text), values[name]]
        return F.when(found.isNull(), question).otherwise(F.concat(*pieces, F.lit(rest)))

    return let(intent, planned)  # the patterns of an intent are tried once


def classify_question(planned: Column, name: str | None = None, institution: Sequence[str] = (),
                      rules: R.RuleSet | None = None) -> Column:
    """Category of a question: fixed for transfer questions, else the first matching rule."""
    rules = R.SHIPPED.rules("question_rules", name) if rules is None else rules
    return (
        F.when(is_blank(planned), F.lit(None).cast("string"))
        .when(transfer_intent(planned, institution).isNotNull(), F.lit(INTENT_CATEGORY))
        .otherwise(classify_first_match(planned, rules)))


def bounded_history(messages: DataFrame, max_messages: int = 12, max_chars: int = 6000) -> DataFrame:
    """Newest messages of each conversation within both budgets; the oldest one kept is cut at its head.

    ``messages``: conversation_id, ord, role, content. Only ``max_messages`` rows of a
    conversation reach the shuffle.
    """
    newest = top_per_key(messages, ["conversation_id"], [F.desc("ord")], max_messages, "age")
    newer = Window.partitionBy("conversation_id").orderBy("age").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length("content")).over(newer), F.lit(0))
    return (
        newest.withColumn("__left", F.lit(max_chars) - used).where(F.col("__left") > 0)
        .withColumn("content", F.when(F.length("content") > F.col("__left"), F.expr("right(content, __left)"))
                    .otherwise(F.col("content")))
        .drop("__left", "age"))


def contextualize(questions: DataFrame, history: DataFrame, question: str = "question",
                  out: str = "question_in_context") -> DataFrame:
    """Put the latest user message of the (bounded) history before the question."""
    last = (
        history.where(F.upper("role") == "USER").groupBy("conversation_id")
        .agg(F.max_by("content", "ord").alias("__last")))
    return (
        questions.join(last, "conversation_id", "left")
        .withColumn(out, F.when(is_blank(F.col("__last")), F.col(question)).otherwise(
            F.concat("__last", F.lit(FOLLOW_UP), F.col(question))))
        .drop("__last"))
