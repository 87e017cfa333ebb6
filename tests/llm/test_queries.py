"""The registered queries of the corpus operators against DuckDB and plain Python, on the smallest tables."""

import glob
import hashlib
import os
import re
import zlib

import duckdb
import pytest

from seqlake.llm import queries, sql, toxicity

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_query_equals_sql(spark, duck, name):
    cols, got = rows(queries.queries()[name](spark, SMALL))
    r = duck.execute(queries.oracle_sql()[name])
    at = {c[0]: i for i, c in enumerate(r.description)}
    assert set(at) <= set(cols)
    want = sorted((tuple(x[at[c]] for c in cols if c in at) for x in r.fetchall()), key=str)
    assert sorted((tuple(v for c, v in zip(cols, x, strict=True) if c in at) for x in got), key=str) == want


def test_pii_query_equals_python(spark, duck):
    from tests.llm.test_text import plain_spans

    got = {r.doc_id: r for r in queries.op6_pii(spark, SMALL).collect()}
    for i, t in duck.execute("select doc_id, text from documents").fetchall():
        base = plain_spans(t)
        counts = [len(re.findall(rf"(?:^|,){k}:", base)) for k in ("email", "ip", "card", "phone")]
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == counts
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert {x for x in base.split(",") if x} <= set(got[i].spans.split(","))


def test_media_query_equals_python(spark, duck):
    got = {r.doc_id: r for r in queries.op8_media(spark, SMALL).collect()}
    for i, t in duck.execute("select doc_id, text from documents").fetchall():
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:])


def test_toxicity_query(spark, duck):
    got = queries.op9_toxicity(spark, SMALL).collect()
    assert len(got) == duck.execute("select count(*) from documents").fetchone()[0]
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= toxicity.THRESHOLD)
