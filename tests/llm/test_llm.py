"""Every operator against a plain version, on small tables with nulls, empty, long, tied and repeated rows."""

import collections
import hashlib
import math
import os
import random
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fathomdex.llm import bpe, catalog, common, exact_dedup, html_text, jaccard_join, language, licenses, lm_score, mixing, neighbours, paragraphs

PICK = random.Random(4)
WORDS = ["".join(PICK.choices("abcdefghij", k=PICK.randint(2, 6))) for _ in range(400)]


def prose(n, pick=PICK):
    return " ".join(pick.choices(WORDS, k=n))


BASE = [prose(60) for _ in range(4)]
TEXTS = [None, "", " \t\n", "One", "one", "two words", prose(20_000), *BASE, *BASE, BASE[0].upper(), *(b + " tail" for b in BASE), *(prose(40) for _ in range(10)), "héllo wörld «ß»  x y", BASE[1].replace(" ", "\n")]
ROWS = [(i, t, PICK.choice(["en", "fr", None]), PICK.choice(["a", "b", "", None]), 7) for i, t in enumerate(TEXTS)] + [(3, "One", "en", "a", 7)]
SCHEMA = "doc_id long, text string, lang string, source string, n long"


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return (t or "").encode().lower().split()


def test_exact_dedup(spark):
    out = exact_dedup.exact_groups(table(spark).withColumnRenamed("n", "kept"))
    assert out.columns == ["doc_id", "text", "lang", "source", "keep_id", "group_size", "kept", "text_sha256"]
    groups = collections.defaultdict(list)
    for r in ROWS:
        groups[r[1] or ""].append(r[0])
    got = out.collect()
    assert len(got) == len(ROWS)
    for r in got:
        ids = groups[r["text"] or ""]
        assert (r["keep_id"], r["group_size"]) == (max(ids), len(ids))
        assert r["text_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert sum(r["kept"] for r in got) == len(groups)
    nulls = spark.createDataFrame([(None, "x", None, None, 1), (None, "x", None, None, 1), (None, None, None, None, 1)], SCHEMA)
    assert exact_dedup.exact_dedup(nulls).count() == 2
    assert exact_dedup.exact_groups(empty(spark)).count() == 0


def plain_mix(rows):
    size = [len(words(r[1])) for r in rows]
    named = sorted({r[3] for r in rows if r[3] is not None}, key=str.encode) + ([None] if any(r[3] is None for r in rows) else [])
    total = {s: sum(n for n, r in zip(size, rows) if r[3] == s) for s in named}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(named)}
    target, free = {}, set(named)
    while free:
        rest = sum(size) - sum(target.values())
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * total[s]}
        if not over:
            return total, target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = 3.0 * total[s]
        free -= over
    return total, target


def test_mixing(spark):
    rows = [(i, prose(PICK.randint(0, 30)), None, PICK.choice(["a", "b", "c", "d", None]), 0) for i in range(400)] + ROWS[7:]
    got = mixing.mix_counts(table(spark, rows)).collect()
    total, target = plain_mix(rows)
    assert len(got) == len(rows)
    for s in total:
        mine = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == total[s] and r["target"] == pytest.approx(target[s]) for r in mine)
        assert sum(r["size"] * r["copies"] for r in mine) == pytest.approx(target[s], abs=3 * max(r["size"] for r in mine))
    assert all(0 <= r["copies"] <= 3 for r in got)
    again = mixing.mix_counts(table(spark, rows)).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in again) == sorted((r["doc_id"], r["copies"]) for r in got)
    assert mixing.mix(table(spark, rows)).count() == sum(r["copies"] for r in got)
    assert mixing.mix_counts(empty(spark)).count() == 0
    assert {r["target"] for r in mixing.mix_counts(table(spark, ROWS[:3])).collect()} == {0.0}


def test_language(spark):
    pick = random.Random(1)
    kinds = {"en": ["the", "thing", "shower", "with", "that"], "fr": ["eau", "fenêtre", "leçon", "oiseau", "quel"]}
    rows = [(i, " ".join(pick.choices(kinds[k], k=pick.randint(8, 60))), k, k, 0) for i in range(200) for k in [pick.choice(["en", "fr"])]]
    rows += [(900, None, "en", "x", 0), (901, "123 !!", "en", "x", 0), (902, "", None, "x", 0), (903, "thing that", None, None, 0)]
    out = {r["doc_id"]: r for r in language.identify(table(spark, rows)).collect()}
    assert all(out[i]["lang_pred"] == k for i, _, k, _, _ in rows[:200])
    assert all((out[i]["lang_pred"], out[i]["score"], out[i]["rejected"]) == ("und", 0.0, True) for i in (900, 901, 902))
    assert out[903]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in out.values())
    assert language.identify(empty(spark)).count() == 0
    marks = spark.createDataFrame([(1, "\u0301\u0301 \u0308", None, None, 0), (2, "thing that shower with", None, None, 0), (2, "thing that shower with", None, None, 0)], SCHEMA)
    model = language.train(table(spark, rows[:200]))
    assert sorted(r["lang_pred"] for r in language.classify(marks, model).collect()) == ["en", "en", "und"]
    many = [(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26)} " * 5, f"l{i}", None, 0) for i in range(260)]
    assert len(language.train(table(spark, many))) == 260
    assert {r["lang_pred"] for r in language.classify(table(spark), {}).collect()} == {"und"}


def test_bpe(spark):
    from tokenizers import Tokenizer

    texts = [*TEXTS, "<|endoftext|>a<|startoftext|> b", "ΑΣ Σ. İI", "aaaaaaa" * 90, "it's 12½ 漢字 ՘x \U000187fc", "é \u0085\x1c\x00", "hahaha" * 40]
    library = Tokenizer.from_file(bpe.tokenizer_path())
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in bpe.encode(table(spark, rows)).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i]["ids"], dtype="<u4").tolist() == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode(empty(spark)).count() == 0


def plain_components(rows, width=4, num=85, den=100):
    sets = {}
    for r in rows:
        w = words(r[1])
        sets[r[0]] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("operator", [bpe.encode, lambda docs: language.classify(docs, {}), lambda docs: jaccard_join.similar_groups(docs)])
def test_python_batches_are_bounded(spark, operator):
    """Pipeline's Python stages take few bytes at once, however many rows that is; a lower bound of the caller stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(300, numPartitions=1).selectExpr("id AS doc_id", "concat('w', repeat(cast(id % 10 AS string), 40000)) AS text")

    def bytes_at_once(batches):
        for batch in batches:
            yield batch.assign(text=batch["text"].str.len()).agg({"text": ["sum"]}).astype("int64")

    try:
        spark.conf.unset(key)
        operator(docs)
        got = [r["text"] for r in docs.select("text").mapInPandas(bytes_at_once, "text long").collect()]
        assert sum(got) == 300 * 40_001
        assert max(got) <= 1.1 * common.BATCH_BYTES
        spark.conf.set(key, "1m")
        operator(docs)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key)


def test_star_links_against_all_pairs():
    pick = random.Random(31)
    for _ in range(20):
        base = pick.sample(range(10_000), 60)
        sets = [np.array(sorted({*pick.sample(base, pick.randint(40, 60)), *pick.sample(range(10_000, 10_040), pick.randint(0, 9))}), dtype=np.uint64) for _ in range(60)]
        ids = np.array(pick.sample(range(1000), len(sets)))
        up = {int(i): int(i) for i in ids}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        def groups(links):
            up.update({i: i for i in up})
            for x, y in links:
                x, y = find(x), find(y)
                up[max(x, y)] = min(x, y)
            return {i: find(i) for i in up}

        every = [(int(ids[i]), int(ids[j])) for i in range(60) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]
        assert groups(jaccard_join.star_links(ids, sets)) == groups(every)


@pytest.mark.parametrize("broadcast", [0, 100_000])
def test_components(spark, monkeypatch, broadcast):
    monkeypatch.setattr(common, "MOST_BROADCAST", broadcast)
    pick = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1200)] + [(2500, i) for i in range(2000, 2300)] + [(pick.randint(3000, 3400), pick.randint(3000, 3400)) for _ in range(150)] + [(5, 5), (7, 6)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, y in edges:
        x, y = find(x), find(y)
        up[max(x, y)] = min(x, y)
    linked = {x for x, y in edges if x != y} | {y for x, y in edges if x != y}
    got = common.components(spark.createDataFrame(edges, "a long, b long").repartition(3), "test").collect()
    assert len(got) == len(linked) and {r["node"]: r["root"] for r in got} == {x: find(x) for x in linked}
    assert common.components(spark.createDataFrame([], "a long, b long"), "test").count() == 0


def test_jaccard_join_splits_large_cells(spark, monkeypatch):
    """Cells of more sets than pivots, in several chunks, of which some are dealt anew."""
    monkeypatch.setattr(jaccard_join, "PIVOTS", 2)
    monkeypatch.setattr(jaccard_join, "CHUNK", 16)
    pick = random.Random(18)
    shared = [pick.choices(WORDS, k=40) for _ in range(2)]
    rows = []
    for i in range(0, 160, 2):  # a passage that many unlike documents share, and near copies of each
        w = [*pick.choices(WORDS, k=30), *pick.choice(shared), *pick.choices(WORDS, k=30)]
        rows.append((i, " ".join(w), "", "", 0))
        w[pick.randrange(100)] = "changed"
        rows.append((i + 1, " ".join(w), "", "", 0))
    got = jaccard_join.similar_groups(table(spark, rows), part=4000).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain_components(rows)


def test_jaccard_join_deals_large_cells_in_waves(spark, monkeypatch):
    """Near copies meet in nearly all their cells: their counts are shuffled in several waves, with all links."""
    waves, write = [], jaccard_join.materialize
    monkeypatch.setattr(jaccard_join, "materialize", lambda df, name: waves.append(name) or write(df, name))
    pick = random.Random(22)
    rows = []
    for base in [pick.choices(WORDS, k=100) for _ in range(3)]:
        for _ in range(30):
            w = list(base)
            w[pick.randrange(100)] = pick.choice(WORDS)
            rows.append((len(rows), " ".join(w), "", "", 0))
    got = jaccard_join.similar_groups(table(spark, rows)).collect()
    assert waves.count("met-0-tied") > 1
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain_components(rows)


def test_jaccard_join_deals_sets_anew_in_waves(spark, monkeypatch):
    """Sets that are left in many larger cells are dealt anew a part of these at a time, and texts
    go to their places once; small cells' pairs go in waves too. No link is lost."""
    made, write = [], jaccard_join.materialize
    monkeypatch.setattr(jaccard_join, "materialize", lambda df, name: made.append((name, write(df, name))) or made[-1][1])
    for name, value in (("PIVOTS", 2), ("CHUNK", 16), ("AGAIN", 0.05), ("WAVE", 1)):
        monkeypatch.setattr(jaccard_join, name, value)
    pick = random.Random(19)
    shared = [pick.choices(WORDS, k=40) for _ in range(2)]
    rows = []
    for i in range(0, 320, 2):
        w = [*pick.choices(WORDS, k=30), *pick.choice(shared), *pick.choices(WORDS, k=30)]
        rows.append((i, " ".join(w), "", "", 0))
        w[pick.randrange(100)] = "changed"
        rows.append((i + 1, " ".join(w), "", "", 0))
    got = jaccard_join.similar_groups(table(spark, rows), part=4000).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain_components(rows)
    names = [name for name, _ in made]
    assert names.count("met-1") > 1 and names.count("placed-texts") == 1 and names.count("met-0-close") > 1
    left = [path for name, df in made for path in df.work_tables if name.startswith(("met-", "placed")) and os.path.exists(path.removeprefix("file:"))]
    assert not left


def test_pipeline_drops_what_a_stage_has_read(spark, tmp_path, monkeypatch):
    """Besides the result's own, one stage's rows are on disk once the next are written."""
    made, write = [], corpus_pipeline.materialize
    monkeypatch.setattr(corpus_pipeline, "materialize", lambda df, name: made.append(write(df, name)) or made[-1])
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(str(k), lambda spark, docs, sf_dir, k=k: docs.filter(f"doc_id > {k}")) for k in range(4)])
    spark.range(9).selectExpr("id AS doc_id", "'x' AS text").write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert [os.path.exists(df.work_tables[0].removeprefix("file:")) for df in made] == [False, False, True]
    assert sorted(r["doc_id"] for r in got.collect()) == [4, 5, 6, 7, 8]


@pytest.mark.parametrize("part", [2_000_000, 1500])
def test_jaccard_join(spark, part):
    pick = random.Random(8)
    rows = list(ROWS[:-1])
    for i in range(100, 240):
        w = pick.choice(BASE).split()
        for _ in range(pick.choice([0, 1, 1, 2, 2, 3])):
            w[pick.randrange(60)] = pick.choice(WORDS)
        rows.append((i, " ".join(w), None, None, 0))
    rows += [(300 + n, " ".join(WORDS[:n]), None, None, 0) for n in range(1, 40)]
    got = jaccard_join.similar_groups(table(spark, [*rows, rows[9]]), part=part).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain_components(rows)
    assert len(got) == len(rows) + 1
    if part > 10_000:
        assert jaccard_join.similar_groups(empty(spark)).count() == 0
        odd = jaccard_join.similar_groups(spark.createDataFrame([(None, BASE[0], "", "", 0), (1, BASE[0], "", "", 0)], SCHEMA)).collect()
        assert sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"] or -1) for r in odd) == [("1", 57, 1), ("None", 57, -1)]


CLASHES = ["texts", "alike", "whole", "mix_rank", "mix_class", "mix_b", "gone_id", "spans", "c0", "key", "state", "row", "html"]


def test_columns_of_any_name(spark):
    rows = [(i, t, k) for i, (t, k) in enumerate([(prose(40), "a"), (BASE[0], "a"), (BASE[0], "b"), (None, None), ("x " + BASE[0], "a")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = docs.select("*", *(F.concat(F.lit(f"{c}-"), "doc_id").alias(c) for c in CLASHES))
    for out in (exact_dedup.exact_groups(docs), exact_dedup.exact_dedup(docs), mixing.mix_counts(docs), mixing.mix(docs), paragraphs.remove_repeats(docs), licenses.scan(docs), language.classify(docs, {}), jaccard_join.drop_similar(docs), bpe.encode(docs)):
        kept = [c for c in CLASHES if c in out.columns]
        assert kept == CLASHES or "ids" in out.columns
        for r in out.select("doc_id", *kept).collect():
            assert [r[c] for c in kept] == [f"{c}-{r['doc_id']}" for c in kept]
    assert lm_score.score(docs).count() == jaccard_join.similar_groups(docs).count() == 5
    vectors = spark.range(1, 61).select(F.col("id").alias("vec_id"), F.array(*(F.sin(F.col("id") * k) for k in range(1, 9))).alias("embedding"), *(F.lit(1).alias(c) for c in ("v", "rank", "score", "is_query", "order", "mine", "other", "bits")))
    assert neighbours.search(vectors.unionByName(vectors), F.col("vec_id") % 20 == 0).count() == 60
    pages = docs.select("doc_id", F.col("text").alias("body"), *(c for c in CLASHES if c != "html"), F.col("text").alias("html"))
    assert {r["texts"] for r in html_text.extract(pages).collect()} == {f"texts-{i}" for i in range(5)}


def duck(rows_or_path, sql):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    if isinstance(rows_or_path, str):
        db.sql(f"CREATE VIEW documents AS SELECT * FROM '{rows_or_path}/documents.parquet'")
    else:
        db.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n BIGINT)")
        db.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [list(r) for r in rows_or_path])
    rel = db.sql(sql)
    return sorted(map(str, (dict(sorted(zip(rel.columns, r))) for r in rel.fetchall())))


def told(df):
    return sorted(str(dict(sorted(r.asDict().items()))) for r in df.collect())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    assert told(catalog.queries()[name](spark, sf)) == duck(sf, catalog.oracle_sql()[name])


def test_mixing_without_ids(spark):
    rows = [(None, prose(PICK.randint(0, 30)), None, "a", 0) for _ in range(300)]
    got = mixing.mix_counts(table(spark, rows))
    assert got.count() == 300
    spread = spark.createDataFrame(rows, SCHEMA).select(F.pmod(mixing._spread(F.col("doc_id"), F.col("text")), F.lit(16)).alias("cell")).distinct().count()
    assert spread > 10


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(400, 16))
    v[50:90] = v[50]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (1004, [1.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = collections.defaultdict(list)
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 400, 20))
    hit = 0
    for q, found in got.items():
        s = (v * v[q]).sum(axis=1)
        best = [i for i in np.lexsort((np.arange(400), -s)).tolist() if i != q][:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert found == [(k + 1, i, x) for k, (x, i) in enumerate(sorted(((-x, i) for _, i, x in found))) for x in [-x]]
        assert all(x == pytest.approx(float(s[i]), abs=1e-12) for _, i, x in found)
        hit += len({f[1] for f in found} & set(best))
    assert hit >= 0.9 * 20 * len(got)
    assert [r["vec_id"] for r in sorted(neighbours.search(df.filter("vec_id < 3"), F.col("vec_id") % 20 == 0).collect())] == [i for i in np.argsort(-(v[:3] @ v[0])).tolist() if i]
    assert neighbours.search(df.filter("vec_id < 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    cases = {1: (mit, "MIT"), 2: ("x. Licensed under the Apache License, Version 2.0. y", "Apache-2.0"), 3: ("Released under the MIT License.\nAll rights reserved.", "MIT|proprietary"), 4: (None, ""), 5: ("the MIT license is nice", ""), 6: (prose(20_000) + ".\nLicensed under CC BY-NC 4.0.", "CC-BY-NC-4.0")}
    got = {r["doc_id"]: r["licences"] for r in licenses.scan(table(spark, [(i, t, None, None, 0) for i, (t, _) in cases.items()])).collect()}
    assert got == {i: x for i, (_, x) in cases.items()}
    assert licenses.scan(empty(spark)).count() == 0


def test_licenses_wrapped(spark):
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    notice = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    as_is = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE."
    gpl = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    bsd = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."]
    head = "MIT License\n\nCopyright (c) 2020 Someone\n\n"

    def wrapped(parts, width, before="", end="\n"):
        return end.join(before + line for k, p in enumerate(parts) for line in [*([""] if k else []), *textwrap.wrap(p, width)])

    mit = [grant, notice, as_is]
    cases = {1: (head + wrapped(mit, 72), "MIT"), 2: (wrapped(mit, 78, " * "), "MIT"), 3: (wrapped(mit, 70, "# ", "\r\n"), "MIT"), 4: (wrapped([gpl], 75), "GPL-2.0-or-later"), 5: (wrapped(bsd, 74), "BSD-2-Clause"), 6: ("Licensed under\n\nthe MIT License.", ""), 7: ("Copyright Someone\nAll rights\nreserved.", "proprietary"), 8: ("Not licensed under\nthe MIT License.", "")}
    got = {r["doc_id"]: (r["licences"], r["rest"]) for r in licenses.scan(table(spark, [(i, t, None, None, 0) for i, (t, _) in cases.items()])).collect()}
    assert got == {i: (x, ";") for i, (_, x) in cases.items()}
    apache = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an \"AS IS\" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nSee the License for the specific language governing permissions and\nlimitations under the License."
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."
    lgpl = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    more = {11: (apache, "Apache-2.0"), 12: (mpl, "MPL-2.0"), 13: (wrapped([lgpl], 66, "// "), "LGPL-2.1-or-later"), 14: ("// SPDX-License-Identifier: AGPL-3.0-only\nint x;", "AGPL-3.0-only"), 15: ("This is free and unencumbered software released into the\npublic domain.", "Unlicense"), 16: ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"), 17: ("Not distributed under the ISC license", ""), 18: (None, ""), 19: (apache + "\n\n" + mpl, "Apache-2.0|MPL-2.0")}
    rows = [(i, t, None, None, 0) for i, (t, _) in [*cases.items(), *more.items(), (11, more[11])]]
    out = licenses.scan(table(spark, rows)).select("doc_id", *licenses.ADDED)
    assert {r["doc_id"]: r["licences"] for r in out.collect() if r["doc_id"] > 10} == {i: x for i, (_, x) in more.items()}
    assert told(out) == duck(rows, licenses.SQL)


def test_html(spark):
    page = '<html><head><title>t</title></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><script>var a="</p>";</script><article><h1>Big  news</h1><p>One &amp; two<br>three.<p>Last <b>line</b>.</article><div class="comments"><p>First comment here.</p></div><footer>&copy; Site</footer></body></html>'
    rows = [(1, "u", page, 1), (2, None, None, 2), (3, "u", "", 3), (1, "u", page, 1), (4, "u", "<nav>x</nav>", 5)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long")).collect()
    assert [(r["text"], r["n_chars"]) for r in got if r["page_id"] == 1] == [("Big news One & two three. Last line.", 36)] * 2
    assert {r["text"] for r in got if r["page_id"] > 1} == {""}
    model = html_text.default_model()
    held = html_text.labelled_pages(60, seed=99)
    e, n = model.emissions([html_text.features(b) for b, _ in held])
    label = html_text.viterbi(e, n, model.step)
    right = sum(int((label[i, : len(y)] == y).sum()) for i, (_, y) in enumerate(held))
    assert right >= 0.98 * sum(len(y) for _, y in held)


def test_html_without_telling_names():
    model = html_text.default_model()
    one, two = "This is a first paragraph of the story, with a few words in it.", "And another one follows here, as long as the first."
    cases = {
        f'<div class="x1"><p>{one}</p><p>{two}</p></div>': f"{one} {two}",
        f"<p>{one}<p>{two}": f"{one} {two}",
        f"{one} {two}": f"{one} {two}",
        f'<article><p>{one}</p><svg class="i"/><p>{two}</p></article>': f"{one} {two}",
        f"<article><p>{one}</p><svg><path/><p>{two}</p></article>": f"{one} {two}",
        f'<article><p title="it>{one}</p><p>{two}</p></article>': f"{one} {two}",
        f"<article><p it's>{one}</p><p>{two} it's</p></article>": f"{one} {two} it's",
        f"<article><p>{one} 1 < 2 &lt;b&gt;</p><!-- x --><p>{two}</p></article><!-- <p>no": f"{one} 1 < 2 <b> {two}",
        f"<script>var a = 1;</script><article><p>{one}</p></article><script>x": one,
    }
    assert html_text.main_texts(list(cases), model) == list(cases.values())
    assert html_text.main_texts(list(cases), model) == [html_text.main_texts([c], model)[0] for c in cases]


def test_html_of_very_long_pages():
    import time

    model = html_text.default_model()
    for page in ("<a " * 200_000, '<p "' * 200_000, "<svg>" * 200_000, "<div>" * 50_000, '<a x="' * 200_001 + ">"):
        began = time.time()
        html_text.main_texts([page], model)
        assert time.time() - began < 20
    text = prose(20_000)
    assert html_text.main_texts([f"<article><p>{text}</p></article>"], model) == [text]


def test_paragraphs_of_large_cells(spark):
    """Lines of a common part and own words: every link by brute force is connected, whatever the size of a cell."""
    pick = random.Random(21)
    common = [prose(50, pick) for _ in range(2)]
    rows = []
    for i in range(150):
        own = prose(10, pick).split()
        rows.append((2 * i, f"{pick.choice(common)} {' '.join(own)}", "", "", 0))
        own[9] = "changed"
        rows.append((2 * i + 1, f"{rows[-1][1].rsplit(' ', 10)[0]} {' '.join(own)}", "", "", 0))
    want = plain_components(rows, 5, 8, 10)
    got = {r["doc_id"]: r["keeper_doc_id"] for r in paragraphs.repeated_paragraphs(table(spark, rows)).collect() if r["first"] == 0 and r["last"] == 60}
    assert [got.get(i, i) for i in want] == [k for _, k in want.values()]


def test_paragraphs(spark):
    pick = random.Random(3)
    passage = prose(60, pick).replace(" w", ". w") + "."
    other = passage.split()
    other[30] = "changed"
    inner = ". ".join(prose(9, pick) for _ in range(8)) + "."
    rows = [(1, prose(30, pick) + "\n" + passage, "", "", 0), (2, passage + "\n" + prose(40, pick), "", "", 0), (3, " ".join(other), "", "", 0), (4, prose(80, pick), "", "", 0), (5, None, "", "", 0), (6, "", "", "", 0), (7, f"{prose(20, pick)}. {inner} {prose(20, pick)}", "", "", 0), (8, f"{prose(33, pick)}. {inner} {prose(12, pick)}", "", "", 0), (None, passage, "", "", 0)]
    got = paragraphs.repeated_paragraphs(table(spark, [*rows, rows[3]])).collect()
    assert {r["doc_id"] for r in got} == {1, 2, 3, 7, 8}
    assert {(r["doc_id"], r["first"], r["removed"]) for r in got if r["doc_id"] < 4 and r["last"] - r["first"] == 60} >= {(1, 30, False), (2, 0, True), (3, 0, True)}
    clean = {r["doc_id"]: r["text"] for r in paragraphs.remove_repeats(table(spark, rows)).collect()}
    assert clean[1] == rows[0][1] and clean[4] == rows[3][1] and clean[3] == "" and clean[5] is None
    assert passage not in clean[2] and clean[2] in rows[1][1]
    assert paragraphs.repeated_paragraphs(empty(spark)).count() == 0


def repeated_words(rows):
    """By brute force: the (id, word number) of each word of a window of 25 words that stands before by id and place, without overlap."""
    first, gone = {}, set()
    for i, t in sorted(rows):
        w = words(t)
        for k in range(len(w) - 24):
            j, at = first.setdefault(tuple(w[k : k + 25]), (i, k))
            if j != i or k - at >= 25:
                gone |= {(i, x) for x in range(k, k + 25)}
    return gone


def test_paragraphs_texts_are_read_once_for_all_lines(spark):
    """Lines, their verification, runs and windows each read the texts once: small and large cells share a reading."""
    pick = random.Random(8)
    line = pick.choices(WORDS, k=60)
    near = [" ".join([*line[:k], "x", *line[k + 1 :]]) for k in range(2 * paragraphs.SMALL_CELL)]
    pair = pick.choices(WORDS, k=60)
    lines = [*near, " ".join(pair), " ".join([*pair[:-1], "x"]), *(prose(40, pick) for _ in range(5))]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    got = paragraphs.repeated_paragraphs(docs.mapInPandas(counted, docs.schema)).collect()
    whole = {r["doc_id"]: r["keeper_doc_id"] for r in got if (r["first"], r["last"]) == (0, 60)}
    assert whole == dict.fromkeys(range(len(near)), 0) | {len(near): len(near), len(near) + 1: len(near)}
    assert read.value == 4 * len(lines)


def test_paragraphs_runs_anywhere(spark):
    pick = random.Random(5)
    passages = [prose(55, pick) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [prose(pick.randint(1, 40), pick)]
        for p in pick.sample(passages, 2):
            w = p.split()
            at = pick.randint(0, 5)
            parts += [" ".join(w[at : pick.randint(20, 55)]), prose(pick.randint(1, 40), pick)]
        rows.append((i, " ".join(parts)))
    rows += [(100, prose(10, pick) + " " + passages[0] + "\n" + prose(5, pick)), (101, passages[0].replace(" ", "\n")), (102, " ".join(["again"] * 200)), (103, " ".join([prose(30, random.Random(7))] * 5))]
    got = paragraphs.repeated_paragraphs(table(spark, [(i, t, "", "", 0) for i, t in rows]))
    out = got.collect()
    assert {(r["doc_id"], k) for r in out if r["removed"] for k in range(r["first"], r["last"])} == repeated_words(rows)
    text = {i: words(t) for i, t in rows}
    for r in out:
        n = r["last"] - r["first"]
        assert text[r["doc_id"]][r["first"] : r["last"]] == text[r["keeper_doc_id"]][r["keeper_first"] : r["keeper_first"] + n]
        assert r["removed"] == ((r["keeper_doc_id"], r["keeper_first"]) != (r["doc_id"], r["first"]))


def test_lm(spark):
    rows = [(i, prose(PICK.randint(0, 60)), None, None, 0) for i in range(150)] + [(1000 + i, t, None, None, 0) for i, t in enumerate(TEXTS)] + [(None, "one", None, None, 0)]
    got = lm_score.score(table(spark, rows)).collect()
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = collections.Counter(w for i, t, *_ in rows if not out(i) for w in [*words(t), b"\n"])
    n, v = sum(c.values()), len(c)
    texts = {i: t for i, t, *_ in rows}
    assert len(got) == len(rows)
    for r in got:
        w = [*words(texts[r["doc_id"]]), b"\n"]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out(r["doc_id"]), len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0
    assert lm_score.score(empty(spark)).count() == 0


def test_lm_with_blocks_of_one_blank_text(spark):
    rows = [(0, "a b c", None, None, 0), (1, None, None, None, 0), (2, "x " * 50, None, None, 0), (3, "", None, None, 0)]
    assert lm_score.score(spark.createDataFrame(rows, SCHEMA).repartition(4, "doc_id")).count() == 4


def test_lm_gains_on_a_tiny_corpus(spark):
    pick = random.Random(12)
    halves = WORDS[:200], WORDS[200:]
    rows = [(i, " ".join(pick.choices(pick.choice(halves), k=80)), None, None, 0) for i in range(300)]
    held = [r for r in lm_score.score(table(spark, rows)).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_lm_held_out_gain(spark):
    held = [r for r in lm_score.query(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.9 * sum(r["base_score"] for r in held)


def test_class_probabilities_add_up():
    w = np.random.default_rng(0).normal(size=(lm_score.ROWS, lm_score.CLASSES))
    p = np.exp(lm_score.log_softmax(w, np.array([0, 3]), np.array([1, 200])))
    assert p.sum(axis=1) == pytest.approx([1.0, 1.0])


def test_pipeline(spark, tmp_path):
    pick = random.Random(6)
    rows = [(i, prose(30, pick), pick.choice(["en", "fr"]), pick.choice(["a", "b"]), 0) for i in range(80)]
    rows += [(100, rows[5][1], "en", "a", 0), (101, rows[6][1] + " end", "en", "a", 0), (102, None, "en", "a", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "n-gram Jaccard join", "mixing sources", "BPE encoding"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", "), name
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "exact dedup":
            assert not {5, 102} & ids and 101 in ids
        if name == "n-gram Jaccard join":
            assert 101 not in ids and (6 in ids)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_pipeline_against_a_plain_version(spark, tmp_path):
    """Every stage by loops over lists; mixing by its SQL, encoding by the tokenizer library."""
    from tokenizers import Tokenizer

    pick = random.Random(16)
    kinds = {"en": ["the", "thing", "shower", "with", "that", *WORDS[:60]], "fr": ["eau", "fenêtre", "leçon", "oiseau", "quel", *WORDS[200:260]]}
    rows = [(i, " ".join(pick.choices(kinds[k], k=pick.randint(10, 60))), k, pick.choice(["a", "b", None]), 0) for i in range(90) for k in [pick.choice(["en", "fr"])]]
    for i in range(90, 120):
        w = rows[i - 90][1].split()
        w[pick.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w) if i % 3 else rows[i - 90][1], "en", "b", 0))
    rows += [(200, None, "en", "a", 0), (201, "12 !", "en", "a", 0), (202, "", None, None, 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    model = tuple(language.train(spark.createDataFrame([r for r in rows if zlib.crc32(str(r[0]).encode()) % 5], SCHEMA)).items())
    predicted = [(r, language.predict_one(model, r[1])) for r in rows]
    docs = [(r[0], r[1], lang, *r[3:]) for r, (lang, _, rejected) in predicted if not rejected]
    last = {r[1]: r for r in sorted(docs, key=lambda r: r[0])}
    docs = sorted(last.values(), key=lambda r: r[0])
    root = plain_components(docs, 5, 8, 10)
    docs = [r for r in docs if root[r[0]][1] == r[0]]
    taken = {int(x["doc_id"]): x["taken"] // max(1, x["size"]) for x in map(eval, duck(docs, mixing.SQL))}
    library = Tokenizer.from_file(bpe.tokenizer_path())
    want = sorted((r[0], hashlib.sha256(np.array(library.encode(r[1], add_special_tokens=False).ids, dtype="<u4").tobytes()).hexdigest()) for r in docs for _ in range(taken[r[0]]))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in got) == want and len({r[0] for r in want}) > 40


def test_pipeline_near_copies_rule(spark):
    pick = random.Random(9)
    rows = []
    for i in range(0, 300, 2):
        w = prose(pick.randint(25, 120), pick).split()
        rows.append((i, " ".join(w), "en", "a", 0))
        for k in pick.sample(range(len(w)), pick.randint(1, 3)):
            w[k] = "changed"
        rows.append((i + 1, " ".join(w), "en", "a", 0))
    sets = {i: {tuple(w[k : k + 5]) for w in [words(t)] for k in range(len(w) - 4)} for i, t, *_ in rows}
    gone = {i for i in sets if i % 2 and 10 * len(sets[i] & sets[i - 1]) >= 8 * len(sets[i] | sets[i - 1])}
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, table(spark, rows), "").collect()}
    assert 20 < len(gone) < 130 and kept == set(sets) - gone


def test_catalog():
    names = catalog.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(catalog.oracle_sql()) <= set(names)
