"""Quality, toxicity, near-duplicates, licences and the pipeline against plain implementations."""

import itertools
import math
import random
import re
import textwrap
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from tallyframe.llm import license_scan, line_quality, near_duplicates, queries, toxicity

from .helpers import ODD, SF, components, empty, odd_docs


def near_copies(n=60, seed=2):
    """Groups of copies at all distances around the threshold."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([6, 20, 60, 200]))]
        out.append(" ".join(words))
        for _ in range(rng.randint(0, 5)):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                copy[rng.randrange(len(copy))] = f"W{rng.randint(0, 5000)}"
            out.append(" ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    return out


@pytest.mark.parametrize("percent", [85, 80, 60])
def test_near_duplicates(spark, percent):
    docs = odd_docs(spark, near_copies() + ["a b c d e f g h i", "b c d e f g h i"])  # five shingles of which four are shared: exactly 80 %
    want = components({r.doc_id: r.text for r in docs.collect()}, percent=percent)
    got = near_duplicates.near_duplicates(docs, percent=percent).collect()
    assert len(got) == docs.count()
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_duplicates.near_duplicates(empty(docs)).collect() == []


def test_an_executor_holds_few_rows_at_a_time(spark, monkeypatch):
    """Keys are made by tasks of bounded rows, however the representatives were written, and stages send workers small batches."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(near_duplicates, "INDEX_ROWS", 50)
    reps = spark.range(400).coalesce(1).withColumnRenamed("id", "rep").select("rep", *[F.xxhash64("rep", F.lit(k)).alias(f"s{k}") for k in range(near_duplicates.LONGS)])
    keys = near_duplicates._index(reps, 85)
    assert keys.count() == 400 * 63 and keys.rdd.getNumPartitions() == 8
    assert max(r["n"] for r in keys.groupBy(F.spark_partition_id()).agg(F.count_distinct("rep").alias("n")).collect()) < 100
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.set(name, "10000")
            stage(spark, empty(odd_docs(spark)), SF)
            assert spark.conf.get(name) == "1000"
    finally:
        spark.conf.set(name, before)


def test_a_hot_bucket_is_dealt_in_squares(spark, monkeypatch):
    """Many pages of one template, most of them not similar enough, meet in the same buckets."""
    monkeypatch.setattr(near_duplicates, "SQUARE", 7)
    rng = random.Random(11)
    template = [f"t{k}" for k in range(60)]
    texts = [" ".join([*template, *[f"o{rng.randint(0, 30)}" for _ in range(rng.choice([4, 8, 12]))]]) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in near_duplicates.near_duplicates(docs).collect()}
    assert got == components(dict(enumerate(texts)))


@pytest.mark.parametrize("percent", [85, 80, 60])
def test_members_of_a_cluster_meet_by_their_differences(spark, monkeypatch, percent):
    """Every cluster counts as large; repeated ids and long chains are there too."""
    monkeypatch.setattr(near_duplicates, "FEW", 1)
    rng = random.Random(percent)
    template, texts = [f"t{k}" for k in range(80)], near_copies(30, percent)
    for _ in range(150):
        copy = list(rng.choice([template, template, texts[-1].split()]))
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(len(copy))] = rng.choice(["u", "v", f"n{rng.randint(0, 10**6)}"])
        texts.append(" ".join(copy))
    docs = spark.createDataFrame([*enumerate(texts), *list(enumerate(texts))[::7]], "doc_id long, text string")
    got = near_duplicates.near_duplicates(docs, percent=percent).collect()
    assert len(got) == docs.count()
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in got} == components(dict(enumerate(texts)), percent=percent)


def test_meetings_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    """Near copies of one text, of which many are just not similar enough: members used to meet as often as they shared a bucket."""
    seen, meetings = [], near_duplicates._meetings

    def counted(docs, clusters, *more):
        strays, everyone, sure = meetings(docs, clusters, *more)
        pairs = strays.join(everyone.select("key", F.col("rep").alias("other")), "key")
        seen.append((clusters.filter("comp <> major").count() * clusters.filter("comp = major").count(), pairs.count()))
        return strays, everyone, sure

    from pyspark.sql import functions as F

    monkeypatch.setattr(near_duplicates, "_meetings", counted)
    rng = random.Random(4)
    template, texts = [f"t{k}" for k in range(150)], []
    for k in range(600):
        copy = list(template)
        for at in rng.sample(range(150), rng.randint(0, 2) if k % 2 else rng.randint(5, 7)):
            copy[at] = f"n{rng.randint(0, 10**6)}"
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in near_duplicates.near_duplicates(docs).collect()}
    assert got == components(dict(enumerate(texts)))
    every, met = seen[0]
    assert every > 40_000 and met < every / 10


def test_windows_of_swapped_words_differ():
    for width in (3, 5, 7):
        windows = {tuple(w) for w in itertools.product("abc", repeat=width)}
        hashes = {near_duplicates.window_hashes(near_duplicates.word_hashes([x.encode() for x in w]), width)[0] for w in windows}
        assert len(hashes) == len(windows)


def test_chunks_miss_seldom():
    for percent in (50, 70, 80, 85, 90):
        chunks, size = near_duplicates.layout(percent)
        same = percent / 100
        assert (1 - same**size - size * same ** (size - 1) * (1 - same)) ** chunks <= near_duplicates.MISS
    assert near_duplicates.layout(85) == (9, 7) and near_duplicates.layout(80) == (10, 6)


def test_odd_sketch_never_exceeds_the_difference():
    sets = [near_duplicates.shingles(t) for t in near_copies()]
    sketches = near_duplicates.odd_sketches(sets)
    for a, x in zip(sets, sketches, strict=True):
        for b, y in zip(sets, sketches, strict=True):
            apart = sum(int(v).bit_count() for v in (x ^ y).view("<u8"))
            own = len(set(a.tolist()) ^ set(b.tolist()))
            assert apart <= own and (apart - own) % 2 == 0


def test_chain_of_copies(spark):
    words = [f"v{k}" for k in range(100)]
    texts = []
    for k in range(25):  # each is near the next, the ends are far apart
        words[(4 * k) % 100] = f"x{k}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(docs).collect()}
    assert got == {i: c for i, (c, _) in components(dict(enumerate(texts))).items()}


def base_figures(text):
    """Figures by the definition, counted plainly."""
    words = text.encode().split()
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    inside = {k + j for k, w in enumerate(windows) if w in often for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    chars = sum(len(w.decode()) for w in words)
    return len(words), chars, sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def test_line_quality(spark):
    shared = "this very line stands in many documents of the host"
    more = [f"{shared}\n" + " ".join(f"u{i}x{k}" for k in range(80)) for i in range(40)] + ["\n".join(f"{shared} {k}" for k in range(12)) + f"\nown {i}" for i in range(3)]
    docs = odd_docs(spark, more)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = line_quality.line_quality(docs, min_documents=5, max_share=0.05).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_figures(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.n_removed_words <= 0.8 * r.n_words)
        if shared in texts[r.doc_id].split("\n"):
            assert r.n_removed_words == len(shared.split())
    assert line_quality.line_quality(empty(docs)).collect() == []


def brute_quality(rows, min_documents=20, max_share=0.05, max_removed=0.8):
    """Figures and verdicts by the definitions: distinct sets of lines are compared as sets."""
    plain = lambda line: b" ".join(line.encode().lower().split())
    cut = [(i, t or "", h, [line for line in (t or "").split("\n") if line.encode().split()]) for i, t, h in rows]
    sets = {(h, frozenset(map(plain, lines))) for _, _, h, lines in cut}
    docs = Counter(h for h, _ in sets)
    having = Counter((h, line) for h, lines in sets for line in lines)
    out = []
    for i, text, h, lines in cut:
        figures = base_figures(text)
        gone = sum(len(line.encode().split()) for line in lines if having[h, plain(line)] >= min_documents and having[h, plain(line)] > max_share * docs[h])
        failed = figures[0] < 50 or 100 * figures[4] > 50 * figures[0]
        out.append((i, *figures, failed, not failed and gone <= max_removed * figures[0], gone))
    return sorted(out, key=repr)


def quality_rows(rng):
    """Hosts with templates of all sizes, hosts of null and of the empty name, copies, and odd texts."""
    lines = {h: [" ".join(f"{h}{k}w{j}" for j in range(rng.randint(1, 9))) for k in range(60)] for h in ("a", "b", "", None)}
    rows = []
    for n in range(400):
        h = rng.choice(["a", "a", "b", "", None])
        own = [" ".join(f"o{n}x{rng.randint(0, 30)}" for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 8))]
        text = "\n".join([*rng.sample(lines[h], rng.choice([0, 1, 5, 40, 60])), *own, rng.choice(["", " ", own[0].upper() if own else "x"])])
        rows += [(n, text, h)] * rng.choice([1, 1, 1, 3])
    return rows + [(1000 + k, t, None) for k, t in enumerate(ODD)]


def test_line_quality_equals_brute_force(spark):
    rows = quality_rows(random.Random(4))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(map(tuple, line_quality.line_quality(docs).collect()), key=repr)
    assert got == brute_quality(rows)
    assert {r[6:8] for r in got} == {(True, False), (False, True), (False, False)}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    import duckdb

    for path in (SF, "/root/testdata/sf0.01"):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS FROM '{path}/documents.parquet'")
        df = queries.QUERIES[name](spark, path)
        rel = con.execute(queries.SQL[name])
        names = [d[0] for d in rel.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(rel.fetchall(), key=repr)


def test_depleted_documents_go(spark):
    shared = [" ".join(f"n{k}w{j}" for j in range(12)) for k in range(6)]
    texts = ["\n".join([*[" ".join(f"q{i}y{k}z{j}" for j in range(6)) for k in range(12)], *shared]) for i in range(30)] + ["\n".join([*shared, "short own end"])]
    docs = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: r.kept for r in line_quality.line_quality(docs, min_documents=10).collect()}
    assert got == {i: i < 30 for i in range(31)}


def test_copies_are_not_boilerplate(spark):
    text = "\n".join(" ".join(f"c{i}d{k}" for k in range(20)) for i in range(6))
    docs = spark.createDataFrame([(i, text, "h") for i in range(50)], "doc_id long, text string, source string")
    assert all(r.kept for r in line_quality.line_quality(docs, min_documents=5).collect())


def test_template_lines_do_not_hide_each_other(spark):
    shared = [" ".join(f"t{k}w{j}" for j in range(4)) for k in range(40)]
    texts = ["\n".join([*shared, " ".join(f"o{i}x{j}" for j in range(20))]) for i in range(60)]
    rng = random.Random(6)
    stubs = ["\n".join(x) for x in {tuple(sorted(rng.sample(shared[:16], 14))) for _ in range(100)}]
    rows = [(t, "full") for t in texts] + [(t, "stubs") for t in stubs] + [(stubs[0], "stubs")] * 500
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in line_quality.line_quality(docs).collect()}
    assert all(got[i].n_removed_words == 160 for i in range(60))
    assert all(got[i].n_removed_words == got[i].n_words == 56 and not got[i].kept for i in range(60, len(rows)))


def test_frequent_lines_are_removed(spark):
    shared = ["Terms and  notices of this site", "contact us any time"]
    own = ["\n".join(" ".join(f"r{i}s{k}t{j}" for j in range(15)) for k in range(5)) for i in range(40)]
    texts = [f"{shared[0].upper()}\n{o}\n\n{shared[1]}" for o in own]
    whole = "\n".join([" ".join(f"z{j}" for j in range(80)), shared[0]])
    rows = [(i, t, "h", i) for i, t in enumerate(texts)] + [(90, whole, "other", 0), (90, texts[0], "h", 1), (90, shared[0], "h", 2), (None, texts[1], "h", 3), (None, None, "h", 4), (92, whole, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _row long")
    want = [(i, f"{o}\n", "h", i) for i, o in enumerate(own)] + [(90, whole, "other", 0), (90, own[0] + "\n", "h", 1), (None, own[1] + "\n", "h", 3), (92, whole, None, 5)]
    got = line_quality.frequent_lines_removed(docs)
    assert got.schema == docs.schema and sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    stage = dict(corpus_pipeline.STAGES)["quality rules"](spark, docs, SF)
    assert sorted(map(tuple, stage.collect()), key=repr) == sorted(want, key=repr)
    assert line_quality.frequent_lines_removed(empty(docs)).collect() == []


def brute_segments(scores):
    """Maximal segments by the recursive definition."""
    best = None
    for a in range(len(scores)):
        total = 0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > 0 and (best is None or total > best[2] or total == best[2] and b + 1 - a < best[1] - best[0]):
                best = (a, b + 1, total)
    if best is None:
        return []
    a, b, s = best
    return brute_segments(scores[:a]) + [best] + [(x + b, y + b, z) for x, y, z in brute_segments(scores[b:])]


def test_segments():
    rng = random.Random(4)
    for _ in range(200):
        scores = [rng.choice([-7, -4, -1, 2, 5, 11]) + rng.random() for _ in range(rng.randint(0, 25))]
        got = toxicity.maximal_segments(scores)
        want = brute_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]


def brute_score(model, text):
    """A text's score by the definitions: every word by its surest known prefix, segments by the recursive definition."""
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    scores = []
    for w in words:
        known = [f for f in [w, *[w[:k] + "-" for k in range(3, 9) if k <= len(w)]] if f in model.score]
        best = w if w in model.score else max(known, key=lambda f: model.sure[f], default=None)
        scores.append((model.score[best] if best else 0.0) - model.drift)
    chance = model.log_k + math.log(max(len(words), 1))
    excess = sum(max(0.0, model.scale * s - chance) for *_, s in brute_segments(scores))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, model.bias + model.slope * min(excess, 50.0)))))


def test_toxicity_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(12)
    clean, vile = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)], [f"vile{chr(97 + k)}" for k in range(12)]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        words = [rng.choice(clean) for _ in range(rng.randint(5, 60))]
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(vile) for _ in range(rng.randint(3, 6))]
        rows.append((i, " ".join(words), "l", "s"))
        if i % 7:
            labels.append((i, int(toxic)))
    rows += [(1000 + k, t, None, None) for k, t in enumerate(ODD) if t is None or len(t) < 200] + [rows[3], (None, "vilea vileb", None, None)]
    labels += [labels[0], (None, 1), (2, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.QUERIES["op8_toxicity"](spark, str(tmp_path)).collect()
    learned = {i: y for i, y in labels if i is not None and y is not None and zlib.crc32(str(i).encode()) % 5}
    model = toxicity.fit([rows[i][1] for i in sorted(learned)], [learned[i] for i in sorted(learned)])
    texts = {i: t for i, t, *_ in rows}
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert abs(r.score - brute_score(model, texts[r.doc_id])) < 1e-9 and r.predicted == (r.score >= 0.5)
    assert {r.predicted for r in got if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 5 == 0} == {1}
    # Bounds on the sample take effect, in characters too, and are no error.
    docs, marks = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    assert toxicity.fit_sample(docs, marks, chars=0) is None
    small = toxicity.fit_sample(docs, marks, chars=9000)
    assert small is not None and len(small.score) < len(model.score) + 1


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit_sample(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").filter("held_out").collect()
    hits = Counter((r.toxic, r.predicted) for r in rows)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 for r in rows)
    assert hits[1, 1] / (hits[1, 1] + hits[1, 0]) > 0.85
    assert hits[0, 1] / (hits[0, 1] + hits[0, 0]) < 0.01


def test_toxicity_odd(spark):
    docs = odd_docs(spark)
    assert len(toxicity.score(docs, None).collect()) == docs.count()
    model = toxicity.fit([f"good text {k} words" for k in range(40)] + [f"bad vile text {k} here" for k in range(9)], [0] * 40 + [1] * 9)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert len(got) == docs.count() - 1 and got[0] == got[1] <= min(got.values())
    assert toxicity.keep_clean(docs, model).columns == docs.columns
    assert toxicity.score(empty(docs), model).collect() == []


def test_licenses(spark):
    import duckdb

    grant, notice, warranty = (license_scan.SENTENCES[k] for k in ("mit-grant", "mit-notice", "mit-warranty"))
    more = ["Intro.\nReleased under the MIT License. More", f"{grant.upper()}.\nbetween\n{notice}. {warranty}.", f"{warranty}.\n{notice}.\n{grant}.", "Licensed under CC BY-NC 4.0.\nAll rights reserved."]
    docs = odd_docs(spark, more)
    got = {r.doc_id: r.licenses for r in license_scan.scan(docs).collect()}
    n = docs.count() - 1
    assert [got[k] for k in range(n - 4, n)] == ["MIT", "MIT", "", "CC-BY-NC-4.0,all-rights-reserved"]
    documents = docs.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.execute(license_scan.scan_sql()).fetchall()
    assert sorted(map(tuple, license_scan.scan(docs).collect()), key=repr) == sorted(want, key=repr)
    assert license_scan.scan(empty(docs)).collect() == []


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD3 = f"{BSD}\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0"""
GNU = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2}General Public License as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version."
FULL = {
    MIT: "MIT", f"The MIT License (MIT)\n\nCopyright (c) 2020 Someone\n\n{MIT}": "MIT", BSD: "BSD-2-Clause", BSD3: "BSD-3-Clause", ISC: "ISC", APACHE: "Apache-2.0",
    GNU.format("program", ":", "", ",", "3"): "GPL-3.0-or-later", GNU.format("program", ";", "", ";", "2"): "GPL-2.0-or-later",
    GNU.format("program", ":", "Affero ", ",", "3"): "AGPL-3.0-or-later", GNU.format("library", ";", "Lesser ", ";", "2.1"): "LGPL-2.1-or-later",
    "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991": "GPL-2.0-only", "   GNU LESSER GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\nCopyright": "LGPL-3.0-only",
    "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/": "Apache-2.0",
}


def test_license_texts_at_any_width(spark):
    import duckdb

    def wrapped(text, width, prefix):
        parts = [line for part in text.split("\n\n") for line in [*[w for x in part.split("\n") for w in textwrap.wrap(x, width)], ""]]
        return "\n".join(["Some file", "", *[(prefix + line).rstrip() for line in parts], "", "code follows"])

    rows = [(wrapped(text, width, prefix), want) for text, want in FULL.items() for width in (60, 76, 5000) for prefix in ("", "# ", " * ", "// ", ";; ")]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in license_scan.scan(docs).collect()}
    assert [got[i] for i in range(len(rows))] == [want for _, want in rows]
    documents = docs.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.execute(license_scan.scan_sql()).fetchall()
    assert sorted(map(tuple, license_scan.scan(docs).collect()), key=repr) == sorted(want, key=repr)


def test_pipeline(spark):
    """Each stage against a plain version on its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    judged = {r.doc_id: r.kept for r in line_quality.line_quality(docs).collect()}
    stages = dict(corpus_pipeline.STAGES)
    first = stages["quality rules"](spark, docs, SF)
    assert first.columns == docs.columns
    assert {r.doc_id for r in first.collect()} == {i for i, k in judged.items() if k}
    second = stages["toxicity"](spark, first, SF)
    model = toxicity.fit_sample(first, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in second.collect()} == {r.doc_id for r in toxicity.score(first, model).filter("score < 0.5").collect()}
    third = stages["near-duplicates"](spark, second, SF)
    want = components({r.doc_id: r.text for r in second.collect()}, percent=80)
    assert {r.doc_id for r in third.collect()} == {i for i, (c, _) in want.items() if c == i}
    packed = {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()}
    assert packed == {r.doc_id for r in third.collect()}


def test_one_row_of_each_group_stays(spark):
    words = [f"v{k}" for k in range(60)]
    near = " ".join([*words[:30], "other", *words[31:]])  # 51 of 61 shingles shared: between 80 and 85 %
    rows = [(7, " ".join(words), "a"), (7, " ".join(words), "a"), (3, near, "b"), (None, " ".join(words).upper(), "c"), (None, "alone in the world", "d"), (None, "alone in the world", "e"), (9, "", "f"), (9, "", "f"), (4, None, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = dict(corpus_pipeline.STAGES)["near-duplicates"](spark, docs, SF)
    assert got.columns == docs.columns
    left = sorted(map(tuple, got.collect()), key=repr)
    assert [r for r in left if r[1] != "alone in the world"] == [(3, near, "b"), (4, None, "g"), (9, "", "f"), (9, "", "f")] and len(left) == 5


def test_stages_equal_brute_force(spark, tmp_path):
    """The quality and toxicity stages against definitions that share no code with them."""
    rows = quality_rows(random.Random(21))
    docs = spark.createDataFrame([(i, t, None, h) for i, t, h in rows], "doc_id long, text string, lang string, source string")
    verdict = {(i): k for i, *_, k, _ in brute_quality(rows)}
    stages = dict(corpus_pipeline.STAGES)
    got = stages["quality rules"](spark, docs, SF)
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, *_ in rows if verdict[i])
    clean = [(i, " ".join(f"w{chr(97 + (i * k) % 23)}x" for k in range(1, 30)), i % 5 == 0) for i in range(200)]
    texts = [(i, t + (" vilea vileb vilec viled" if toxic else "")) for i, t, toxic in clean]
    spark.createDataFrame([(i, int(toxic)) for i, _, toxic in clean], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in texts], "doc_id long, text string, lang string, source string")
    left = {r.doc_id for r in stages["toxicity"](spark, docs, str(tmp_path)).collect()}
    known = [(i, t, y) for (i, t), (_, _, y) in zip(texts, clean, strict=True) if zlib.crc32(str(i).encode()) % 5]
    model = toxicity.fit([t for _, t, _ in known], [int(y) for *_, y in known])
    assert left == {i for i, t in texts if brute_score(model, t) < 0.5} == {i for i, _, toxic in clean if not toxic}


def test_pipeline_stages_on_empty_and_odd(spark):
    docs = odd_docs(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(docs), SF).collect() == []
        stage(spark, docs, SF).collect()


def test_queries_registered():
    assert len(queries.QUERIES) == 10
