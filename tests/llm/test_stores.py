"""Archives, media, licences and the pipeline."""

import base64
import hashlib
import random
import textwrap
import zlib

import pytest
from pyspark.sql import functions as F

from seqlake.llm import licenses, media, queries, warc

SMALL = "/root/testdata/sf0.001"
RECORD = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def test_archives_round_trip(spark):
    rows = [(1, "http://a", "<p>x</p>"), (2, "http://b", None), (3, None, ""), (4, "u", "<p>x</p>"), (5, "u", "a" + 2 * RECORD + "b"), (6, "u", RECORD), (7, "u", "WARC/1.1\r\nContent-Length: 99999\r\n\r\nzz"), (8, "u", "é\r\n\r\nñ𝒳"), (9, "u\r\nX: y", "WARC/1.1\r\n" * 5), (10, "u", "x" * 100000), (None, "u", "nul"), (11, "u", "a" + 2 * RECORD + "b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, value int")
    groups = {}
    for i, _, h in rows:
        groups.setdefault(h or "", []).append(i)
    want = []
    for i, _, h in rows:
        b, own = (h or "").encode(), groups[h or ""]
        top = max([x for x in own if x is not None], default=None)
        first = len(own) == 1 or i == top
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first else "revisit", None if first else top))
    for parts in (1, 4):
        assert sorted(map(tuple, warc.round_trip(df.repartition(parts)).collect()), key=str) == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0
    assert warc.round_trip(df.where("page_id in (1, 4)"), min_bytes=9).where("record_type = 'revisit'").count() == 0


def test_archives_of_pages_with_text_ids(spark):
    rows = [("a\nb", "x"), ("", "x"), (None, "y"), ("é %41>", "z"), ("a b", "")]
    df = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id string, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()}
    assert got == {"a\nb": (1, "response", None), "": (1, "revisit", "a\nb"), None: (1, "response", None), "é %41>": (1, "response", None), "a b": (0, "response", None)}


def test_chain_skips_what_it_does_not_reach(spark):
    rows = [("f", 0, 100), ("f", 40, 100), ("f", 100, 300), ("f", 150, 200), ("f", 200, 300), ("f", 300, 400), ("g", 0, None), ("g", 7, 9)]
    got = warc.chain(spark.createDataFrame(rows, "file string, off long, succ long")).select("file", "off").collect()
    assert sorted(map(tuple, got)) == [("f", 0), ("f", 100), ("f", 300), ("g", 0)]


def test_media_round_trip(spark):
    r = random.Random(1)
    big = "".join(r.choice("abcdefgh \n") for _ in range(60000))
    rows = [(1, big), (2, "x" + big), (3, big), (4, None), (5, ""), (6, "a" * 576), (7, "é" * 100), (8, big[20000:] + big), (1, big), (None, "hey"), (9, "a" * 50000), (2, "other")]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, medium int")
    want = []
    for i, t in rows:
        b = (t or "").encode()
        p = b + b"\xff" * (-len(b) % 576 if b else 576)
        w = media.wav(p)
        want.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(w), hashlib.sha256(w).hexdigest(), media.features(p)))
    assert sorted(map(tuple, media.round_trip(df.repartition(3)).collect()), key=str) == sorted(want, key=str)
    assert media.round_trip(df.limit(0)).count() == 0


def test_chunks_follow_content():
    r = random.Random(2)
    a = bytes(r.randrange(256) for _ in range(100_000))
    x, y = media.chunked(a), media.chunked(b"some bytes in front" + a)
    assert b"".join(b for _, b in x) == a and len({d for d, _ in x} & {d for d, _ in y}) >= len(x) - 2
    assert all(media.LEAST <= len(b) <= media.MOST for _, b in x[:-1])


def test_media_detects_damage():
    m = media.wav(media.payload_of(b"abc"))
    parts = [{"digest": d, "data": b[:-1] + b"?"} for d, b in media.chunked(m)]
    with pytest.raises(ValueError):
        media.rebuild([{"digest": d} for d, _ in media.chunked(m)], parts, hashlib.sha256(m).digest())


def test_licences(spark):
    rows = [(1, "Released under the MIT License.", "a/LICENSE"), (2, "some code", "a/b/c.py"), (3, "x\nLicensed under the Apache License, Version 2.0.\nmore", "a/b/d.py"), (4, None, None), (5, "", "z/q"), (6, "the license of ering", "a/e"), (7, "Licensed under CC BY-NC 4.0.", "k/LICENSE"), (8, "t", "k/l/m/n.py"), (9, "w " * 60000 + "license", "y/LICENSE"), (11, "This work is licensed under the GNU General Public License, version 3.", "b/x.py")]
    df = spark.createDataFrame([(a, b, c, 1) for a, b, c in rows], "doc_id long, text string, p string, license int").repartition(3)
    got = {r.doc_id: (r.own, r.inherited) for r in licenses.scan(df, F.col("p")).select("doc_id", "_license.*").collect()}
    assert {i: got[i][0] for i in (1, 3, 7, 11)} == {1: "MIT", 3: "Apache-2.0", 7: "CC-BY-NC-4.0", 11: "GPL-3.0"}
    assert got[8] == (None, "CC-BY-NC-4.0") and got[4] == got[5] == got[9] == (None, None) and got[2][1] is not None
    assert licenses.scan(df.limit(0), F.col("p")).count() == 0


def test_licence_files_and_wrapped_notices(spark):
    wrap = lambda t, n=70: "\n".join(textwrap.wrap(t, n))
    warranty = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
    notice = "# Copyright 2020 The Authors\n#\n# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n#\n# Unless required by applicable law or agreed to in writing, software\n# distributed under the License is distributed on an \"AS IS\" BASIS.\nimport os\n"
    gpl = "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version {} of the License, or\n# (at your option) any later version.\n"
    want = {
        "MIT": wrap("MIT License\n\nCopyright (c) 2021 Somebody\n\n" + licenses.FILES["MIT"][12:]),
        "ISC": wrap(licenses.FILES["ISC"]), "BSD-2-Clause": wrap("Copyright (c) 2019, Somebody " + licenses.FILES["BSD-2-Clause"] + " " + warranty), "BSD-3-Clause": wrap("Copyright (c) 2019, Somebody " + licenses.FILES["BSD-3-Clause"] + " " + warranty),
        "GPL-2.0": wrap(licenses.FILES["GPL-2.0"]), "GPL-3.0": wrap(licenses.FILES["GPL-3.0"]), "LGPL-3.0": wrap(licenses.FILES["LGPL-3.0"]), "AGPL-3.0": wrap(licenses.FILES["AGPL-3.0"]), "Apache-2.0": notice,
    }
    rows = [(k, v, f"d{i}/text{i}") for i, (k, v) in enumerate(want.items())] + [("GPL-2.0", gpl.format(2), "n/a"), ("GPL-3.0", gpl.format(3), "n/b")]
    rows += [("MIT", "no words of it", "d0/x/y.py")]  # d0/text0 is a licence file by its content
    got = licenses.scan(spark.createDataFrame([(*r, 1) for r in rows], "name string, text string, p string, _license int"), F.col("p")).collect()
    assert [(r.name, r._license.license) for r in got if r.name != r._license.license] == []


def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "secrets", "tokens"]
    kept = docs
    for name, stage in pipeline.STAGES:
        out = pipeline.cut(stage(spark, kept, SMALL), name)
        assert out.count() <= kept.count()
        if name != "tokens":
            assert out.columns == docs.columns
        if name == "near_duplicates":
            groups = queries.minhash.near_duplicates(kept, width=5).where("kept").select("doc_id").distinct().count()
            assert out.count() == groups
        kept = out
    clean = docs.count()
    assert kept.count() > 0.6 * clean


def test_pipeline_edges(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c d e f g", "en", "s", 13), (3, "A b c d e f g", "en", "s", 13)], schema)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0
    out = pipeline.cut(pipeline.drop_near_duplicates(spark, docs, SMALL), "x")
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "2", "3"]
    assert pipeline.cut(pipeline.redact_secrets(spark, docs, SMALL), "y").where("text is null").count() == 2


def test_every_operator_has_a_query():
    names = queries.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
