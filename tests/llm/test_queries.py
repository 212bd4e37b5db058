"""The package's queries against their SQL, or against plain computations where SQL cannot say them."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest

from lorewell.llm import queries as Q
from lorewell.registry.views import TABLES
from tools.check import table

SF = os.environ.get("LOREWELL_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    return connection


def rows(con, sql):
    return con.execute(sql).fetchall()


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_against_sql(spark, con, name):
    df = Q.QUERIES[name](spark, SF)
    done = con.execute(Q.ORACLES[name])
    assert table(df.columns, df.collect()) == table([d[0] for d in done.description], done.fetchall())


def test_packing(spark, con):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(Q.tokenizer_file())
    packed = Q.QUERIES["op1_best_fit_packing"](spark, SF).collect()
    mine = {(r.doc_id, r.piece): r for r in packed}
    total = 0
    for doc_id, text in rows(con, "select doc_id, text from documents"):
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        total += len(ids)
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            r = mine.pop((doc_id, piece))
            assert (r.start, r.length, r.ids_crc32) == (a, b - a, zlib.crc32(ids[a:b].tobytes()))
    assert not mine
    sequences = {}
    for r in packed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-total // 2048) * 1.01 + 1


def test_nearest_neighbours(spark, con):
    vectors = {i: np.array(v, float) for i, v in rows(con, "select vec_id, embedding from embeddings")}
    ids = np.array(sorted(vectors))
    data = np.stack([vectors[i] for i in ids])
    found = {}
    for r in Q.QUERIES["op2_nearest_neighbours"](spark, SF).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == {int(i) for i in ids if i % 20 == 0}
    hits = total = 0
    for query, got in found.items():
        got.sort()
        assert [g[0] for g in got] == list(range(1, len(got) + 1))
        assert all(abs(s - vectors[v] @ vectors[query]) < 1e-12 for _, v, s in got)
        assert [(-s, v) for _, v, s in got] == sorted((-s, v) for _, v, s in got)
        scores = data @ vectors[query]
        best = [int(ids[k]) for k in np.lexsort((ids, -scores)) if ids[k] != query][:20]
        hits += len(set(best) & {v for _, v, _ in got})
        total += len(best)
    assert hits >= 0.9 * total


def test_page_texts(spark, con):
    import html
    import re

    for r in Q.QUERIES["op3_html_extraction"](spark, SF).collect():
        (page,) = con.execute("select html from pages where page_id = ?", [r.page_id]).fetchall()[0]
        body = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", body)]
        assert r.text == " ".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


def test_held_out_languages(spark, con):
    truth = dict(rows(con, "select doc_id, lang from documents"))
    got = Q.QUERIES["op9_language_id"](spark, SF).collect()
    assert {r.doc_id for r in got} == set(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out]
    assert sum(held) >= 0.95 * len(held)


def test_toxicity_marks_its_fold(spark, con):
    got = Q.QUERIES["op5_toxicity"](spark, SF).collect()
    assert len(got) == rows(con, "select count(*) from documents")[0][0]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_urls(spark, con):
    rules = {("org", "/"): "allow", ("example.org", "/es/"): "block", ("example.org", "/en/1"): "block",
             ("com", "/fr/"): "allow", ("com", "/de/"): "block"}
    urls = dict(rows(con, "select page_id, url from pages"))
    for r in Q.QUERIES["op8_url_filter"](spark, SF).collect():
        rest = urls[r.page_id].split("://", 1)[1]
        host, slash, path = rest.partition("/")
        path = (slash + path).split("?")[0].split("#")[0]
        assert (r.host, r.path) == (host.lower(), path)
        fits = [(len(h + p), h + p, v) for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fits:
            assert (r.rule, r.verdict) == max(fits)[1:]
        else:
            assert r.rule is None and r.verdict in ("allow", "block")


def test_secret_candidates(spark, con):
    import re

    pattern = re.compile(r"(?<![A-Za-z0-9+/_.\-])(?=[A-Za-z0-9+/_.\-]{0,80}?(?:[0-9]|[a-z][A-Z]))([A-Za-z0-9+/_.\-]{16,}={0,2})")
    want = sorted((i, n, hashlib.sha256(m.encode()).hexdigest()) for i, t in rows(con, "select doc_id, text from documents")
                  for n, m in enumerate(pattern.findall(t or "")))
    got = Q.QUERIES["op7_secret_scan"](spark, SF).collect()
    assert sorted((r.doc_id, r.nth, r.value_sha256) for r in got) == want
    assert all(r.is_secret for r in got if r.word.lower() == "token" and r.n_chars == 40)
