import pytest
from pyspark.sql import functions as F

from lorewell.operators import question as Q
from lorewell.sources.tables import alias_dictionary

INTENTS = [
    ("金融转软件条件", "金融", "软件"), ("软件转金融条件", "软件", "金融"), ("从金融转到软件", "金融", "软件"),
    ("转入软件有什么要求", None, "软件"), ("软件学院接收转专业学生吗", None, "软件"), ("软件转专业考什么", None, "软件"),
    ("软件的名额、笔试、面试和考核方式", None, "软件"), ("软件 转 软件 条件", None, "软件"),
    ("示大转专业需要什么条件", None, None), ("学校转专业需要什么条件", None, None), ("校园卡怎么转账", None, None),
    ("网页为什么自动跳转", None, None), ("食堂几点开门", None, None), ("", None, None),
]
CATEGORIES = [
    ("新生报到带什么？", "NEW_STUDENT"), ("转专业有什么条件？", "ACADEMIC"), ("图书馆几点开门", "LIFE"), ("讲讲晨跑", "LIFE"),
    ("计算机专业怎么规划", "MAJOR"), ("通信工程就业方向", "CAREER"), ("示大简介", "SCHOOL_OVERVIEW"), ("有哪些学院", "ORGANIZATION"),
    ("有什么重点实验室", "RESEARCH"), ("金融转软件条件", "ACADEMIC"), ("今天天气", None), (" ", None), ("校园卡怎么转账", "NEW_STUDENT"),
]


def test_intents(spark):
    df = spark.createDataFrame([(i, q) for i, (q, *_) in enumerate(INTENTS)], "i int, q string")
    rows = df.select("i", Q.transfer_intent(F.col("q"), ["示大"]).alias("t")).orderBy("i").collect()
    assert [((r.t.source, r.t.target) if r.t else (None, None)) for r in rows] == [t[1:] for t in INTENTS]


def test_plan_names_both_sides(spark):
    df = spark.createDataFrame([("金融转软件条件",), ("你好",)], "q string")
    texts = [r[0] for r in df.select(Q.planned_question(F.col("q"), Q.transfer_intent(F.col("q")))).collect()]
    assert "转专业目标：软件" in texts[0] and "来源专业：金融" in texts[0] and texts[0].startswith("原问题：金融转软件条件\n")
    assert texts[1] == "你好"


def test_categories(spark):
    df = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(CATEGORIES)], "i int, q string")
    rows = df.select("i", Q.classify_question(F.col("q"), "示大").alias("c")).orderBy("i").collect()
    assert [r.c for r in rows] == [c for _, c in CATEGORIES]


@pytest.mark.parametrize("shard", [1, 100])
def test_aliases_from_file(spark, tmp_path, shard):
    (tmp_path / "terms.json").write_text(
        '{"terms": [{"canonical": "示例大学", "aliases": ["示大"], "category": "SCHOOL_OVERVIEW"},\n'
        '{"canonical": "早锻炼", "aliases": ["晨跑"], "category": "LIFE"}, {"canonical": "晨间", "aliases": ["晨"]}]}', encoding="utf-8")
    aliases = alias_dictionary(spark, str(tmp_path / "terms.json"))
    assert aliases.count() == 6
    questions = ["讲讲晨跑", "示大有晨跑吗", "讲讲早锻炼", "讲讲跑步", "早锻炼就是晨跑"]
    df = spark.createDataFrame(list(enumerate(questions)), "i int, q string")
    rows = Q.expand_aliases(df, "q", aliases, shard).orderBy("i").collect()
    assert [list(r.canonical_terms) for r in rows] == [["早锻炼"], ["示例大学", "早锻炼"], [], [], []] or \
        [sorted(r.canonical_terms) for r in rows] == [["早锻炼"], sorted(["示例大学", "早锻炼"]), [], [], []]
    assert rows[0].retrieval_question == "讲讲晨跑\n检索规范词：早锻炼"
    assert rows[3].retrieval_question == "讲讲跑步"


def test_alias_conflicts(spark):
    df = spark.createDataFrame(
        [("A", "晨跑", "LIFE"), ("B", "晨跑", "LIFE"), (" ", "x", None), ("C", "", "LIFE"), ("D", "d", "NOPE")],
        "canonical string, alias string, category string")
    rows = {(r.alias, r.problem) for r in Q.alias_violations(df).collect()}
    assert rows == {("晨跑", "alias_conflict"), ("x", "canonical_blank"), ("", "alias_blank"), ("d", "category_invalid")}


def test_history_budget(spark):
    messages = [(1, i, "USER" if i % 2 == 0 else "ASSISTANT", str(i) * 10) for i in range(6)]
    df = spark.createDataFrame(messages, "conversation_id int, ord int, role string, content string")
    rows = Q.bounded_history(df, 12, 25).orderBy("ord").collect()
    assert [(r.ord, r.content) for r in rows] == [(3, "33333"), (4, "4" * 10), (5, "5" * 10)]
    asked = spark.createDataFrame([(1, "再说"), (2, "好")], "conversation_id int, question string")
    out = {r.conversation_id: r.question_in_context for r in Q.contextualize(asked, Q.bounded_history(df, 12, 25)).collect()}
    assert out == {1: "4444444444\n后续问题：再说", 2: "好"}
