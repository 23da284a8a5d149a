"""Mixing and licences: hand-made cases; whole tables are compared with SQL in test_queries."""

import textwrap
from collections import Counter

import pytest
from pyspark.sql import functions as F

from muonloom.llm import licences, mixing
from muonloom.llm.known_licences import ISC, LICENCES, MIT


def sources(spark, rows):
    return spark.createDataFrame(rows, "source string, source_size long")


def test_weights_go_round_by_code_point_with_null_last(spark):
    df = mixing.cyclic_weights(sources(spark, [("b", 1), ("a", 1), (None, 1), ("é", 1), ("Z", 1)]))
    assert {r.source: r.weight for r in df.collect()} == {"Z": 1, "a": 2, "b": 3, "é": 1, None: 2}


def test_excess_is_shared_again(spark):
    df = mixing.cyclic_weights(sources(spark, [("a", 600), ("b", 10), ("c", 390)]))
    filled, n = mixing.fill_targets(df)
    got = {r.source: (r.target, r.rate) for r in filled.collect()}
    # shares 1000 * (1, 2, 3) / 6; b stops at 30, the rest is shared 1:3
    assert n == 3 and got["b"] == (30.0, 3.0)
    assert got["a"][0] == pytest.approx(970 / 4) and got["c"][0] == pytest.approx(970 * 3 / 4)


def test_cap_after_cap(spark):
    df = mixing.cyclic_weights(sources(spark, [("a", 900), ("b", 1), ("c", 40), ("d", 0)]))
    filled, _ = mixing.fill_targets(df)
    got = {r.source: (r.target, r.rate) for r in filled.collect()}
    assert got == {"a": (818.0, 818 / 900), "b": (3.0, 3.0), "c": (120.0, 3.0), "d": (0.0, 1.0)}


def test_mix_copies_and_emission(edge):
    rows = mixing.mix(edge).select("doc_id", "source", "n_words", "copies", "rate", "target", "source_size").collect()
    assert len(rows) == edge.count()
    for r in rows:
        assert int(r.rate) <= r.copies <= min(3, int(r.rate) + 1)
    twice = mixing.mix(edge).select("doc_id", "source", "n_words", "copies", "rate", "target", "source_size").collect()
    assert sorted(map(str, rows)) == sorted(map(str, twice))
    out = mixing.emit(mixing.mix(edge)).select("doc_id", "text", "lang", "source", "n_chars")
    assert out.count() == sum(r.copies for r in rows)


def test_many_sources_are_salted(edge, monkeypatch):
    want = sorted(map(str, mixing.mix(edge).select("doc_id", "source", "copies", "rate").collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    df = mixing.mix(edge)
    assert sorted(map(str, df.select("doc_id", "source", "copies", "rate").collect())) == want


def test_taken_words_come_near_targets(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"),
                                    F.expr("repeat('word ', cast(1 + id % 17 as int))").alias("text"))
    got = mixing.mix(docs).groupBy("source").agg(
        F.first("target").alias("t"), F.sum(F.col("n_words") * F.col("copies")).alias("n")).collect()
    assert all(abs(r.n / r.t - 1) < 0.1 for r in got)


def test_nothing_to_mix(nothing):
    assert mixing.mix(nothing).count() == 0


def test_licences_whatever_their_dress(spark):
    odd = "Copyright (c) 2020 Some Body\nAll rights reserved.\n\n" + MIT.upper().replace(",", " ,").replace('"', "'")
    rows = [(1, MIT), (2, odd), (3, MIT + " Except on Mondays."), (4, None), (5, ""), (None, MIT), (1, MIT),
            (6, "text\nReleased under the  MIT Licence\nmore"), (7, "not released under the mit license at all")]
    rows += [(100 + i, t) for i, (_, t) in enumerate(LICENCES)]
    df = spark.createDataFrame([r + ("x", 1) for r in rows], "doc_id long, text string, digest string, licence int")
    got = [tuple(r) for r in licences.scan(df).select("doc_id", "licence", "notices").collect()]
    found = Counter((i, a, tuple(n)) for i, a, n in got)
    assert found[1, "MIT", ()] == 2 and found[None, "MIT", ()] == 1 and found[2, "MIT", ("proprietary",)] == 1
    for i in (3, 4, 5, 7):
        assert found[i, None, ()] == 1
    assert found[6, None, ("MIT",)] == 1
    assert [(i, a) for i, a, _ in sorted((g for g in got if (g[0] or 0) >= 100))] == [
        (100 + i, a) for i, (a, _) in enumerate(LICENCES)]


def test_licences_at_every_width(spark):
    owners = ["Copyright (c) 2020 A. Person", "Copyright 2019-2021 The Authors. All rights reserved.", "(c) 2020 Firm",
              "Copyright Some Firm, Inc. and other contributors", "Copyright by A. Person", "© A. Person"]
    rows = []
    for licence, text in LICENCES:
        for width in (1, 12, 20, 30, 40, 50, 57, 60, 66, 72, 76, 80, 100, 1000):
            body = "\n\n".join(textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False)
                               for p in text.split("\n\n"))
            rows.append((len(rows), owners[len(rows) % len(owners)] + "\n\n" + body, licence))
    rows.append((len(rows), "Copyright (c) 2020 A. Person\n\n" + ISC.replace(
        "above copyright notice and this", "above\ncopyright notice and this"), "ISC"))
    assert any(line.lower().startswith("copyright") for _, text, _ in rows for line in text.split("\n")[1:])
    df = spark.createDataFrame(rows, "doc_id long, text string, want string")
    got = {r.doc_id: r.licence for r in licences.scan(df).collect()}
    assert [(i, got[i], w) for i, _, w in rows if got[i] != w] == []


def test_licences_of_edge_rows(edge, nothing):
    assert licences.scan(edge).count() == edge.count() and licences.scan(nothing).count() == 0


def test_no_python_in_native_plans(edge):
    for df in (mixing.mix(edge), licences.scan(edge)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
