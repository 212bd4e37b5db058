"""Physical plans: every Python stage runs once per row."""

import re

from pyspark.sql import functions as F

from lorewell.operators.embed import hash_embedding
from lorewell.operators.html import edge_table, parse_pages
from lorewell.plans.web_index import web_index_job
from lorewell.registry import views as V
from tests.test_registry import SF, pytestmark  # noqa: F401


def python_nodes(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"(?:ArrowEvalPython|MapInArrow|BatchEvalPython)\b", plan)


def test_pages_are_parsed_once(spark):
    parsed = parse_pages(V.table(spark, SF, "pages"))
    assert len(python_nodes(parsed)) == 1
    assert len(python_nodes(edge_table(parsed))) == 1


def test_texts_are_cut_once_and_embedded_once(spark):
    rows = web_index_job(V.catalog(spark, SF), hash_embedding(64))
    assert len(python_nodes(rows.select("document_id", F.size("vector")))) == 2
