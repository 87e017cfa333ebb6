"""Whole secrets, named licences, and filters and explodes on results."""

import random
import string

import pytest
from pyspark.sql import functions as F

from seqlake.llm import licenses, pii, queries, secret_scan

SMALL = "/root/testdata/sf0.001"


def test_nothing_of_a_long_secret_stays(spark):
    rnd = random.Random(3)
    rows = []
    for n in (30, 401, 700, 1000, 10_000):
        v = "".join(rnd.choice(string.ascii_letters + string.digits) for _ in range(n))
        rows += [(f"token={v} end", v), (f"password: {v}\n", v), (f'x = "{v}"', v), (f"secret='{v}'", v), (f"Bearer {v} x", v)]
    v = "".join(rnd.choice(string.ascii_letters) for _ in range(122))
    rows += [(f'password = "{v}"', v), ("see https://u:S3cr3tPassw0rd@host/x", "S3cr3tPassw0rd"), ("password is hunter2hunter2x.", "hunter2hunter2x"), ("token=abc.def.ghi-12345).", "abc.def.ghi-12345")]
    df = spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate(rows)], "id int, text string, v string")
    for r in secret_scan.scan(df, F.lit("src/app.py")).collect():
        left = r["_scan"]["redacted"]
        assert r.v[-8:] not in left and r.v[:8] not in left, (r.text[:40], len(r.v))
        assert all(c.end - c.start >= 8 for c in r["_scan"]["candidates"])


@pytest.mark.parametrize("name", ["pii", "secrets", "licences"])
def test_results_can_be_filtered_and_exploded(spark, name):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    if name == "pii":
        out, seen, inner = pii.scan(docs), "_pii.scored > 0", F.explode("_pii.base")
    elif name == "secrets":
        out, seen, inner = secret_scan.scan(docs, F.lit("")), "size(_scan.candidates) > 0", F.explode("_scan.candidates")
    else:
        out, seen, inner = licenses.scan(docs, F.lit("a/b")), "_license.headers > 0", F.explode(F.array("_license.own"))
    rows = out.collect()
    field = {"pii": lambda r: r["_pii"]["scored"] > 0, "secrets": lambda r: len(r["_scan"]["candidates"]) > 0, "licences": lambda r: r["_license"]["headers"] > 0}[name]
    assert out.where(seen).count() == sum(map(field, rows))
    assert out.select(inner.alias("x")).where("x is not null").count() >= 0
    assert out.where("doc_id = 7").count() == sum(r.doc_id == 7 for r in rows)


def test_licences_by_name_and_version(spark):
    lgpl = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    texts = [("SPDX-License-Identifier: MIT", "MIT"), ("// SPDX-License-Identifier: GPL-2.0-only\n", "GPL-2.0"), (lgpl, "LGPL-2.1"), (licenses.FILES["GPL-3.0 short"] + ".", "GPL-3.0"), ("nothing of the kind", None), (None, None), ("", None), ("x" * 200_000 + " SPDX-License-Identifier: Zlib", "Zlib")]
    texts += [(licenses.FILES[k], k) for k in ("BSD-4-Clause", "BSD-3-Clause", "BSD-2-Clause", "MIT", "ISC")]
    df = spark.createDataFrame([(i, t, w, "x") for i, (t, w) in enumerate(texts)], "id int, text string, want string, _license string")
    for r in licenses.scan(df, F.concat(F.lit("d"), F.col("id").cast("string"), F.lit("/x"))).collect():
        assert r["_license"]["own"] == r.want, (r.want, r["_license"])


def test_secret_and_licence_queries_equal_their_operators(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id: r for r in queries.op2_secrets(spark, SMALL).collect()}
    for r in secret_scan.scan(docs, F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))).collect():
        found = [c for c in r["_scan"]["candidates"] if c.score >= secret_scan.THRESHOLD]
        assert got[r.doc_id].spans == ",".join(f"{c.start}:{c.end}" for c in found) and got[r.doc_id].n_secrets == len(found)
        left, at, out = r.text or "", 0, ""
        for c in found:
            out, at = out + left[at : c.start] + "[SECRET]", c.end
        assert r["_scan"]["redacted"] == out + left[at:]
    have = queries.op10_licenses(spark, SMALL)
    assert have.count() == docs.count() and have.where("own is not null and license <> own").count() == 0
