"""Collocations against a plain loop, over small shards, full bitmaps and odd texts."""

import random
import re
from collections import Counter

import duckdb
import pytest

from tidemark.llm import collocations, registry

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string"


def plain(rows, support, longest=5, top=2000):
    totals, counts = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    held = {x: c for x, c in counts.items() if c >= support and len(x[1]) > 1}
    within = set()
    for (lang, words), c in held.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                if c >= counts[lang, words[i : i + k]]:
                    within.add((lang, words[i : i + k]))
    out = []
    for (lang, words), a in held.items():
        if (lang, words) in within:
            continue
        n, best = totals[lang], None
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            score = 1000 * a * n // (left * right)
            if best is None or score < best[0]:
                best = score, left, right
        out.append((lang, " ".join(words), a, best[1], best[2], n, best[0]))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranked, at = [], Counter()
    for lang, *rest in out:
        at[lang] += 1
        if at[lang] <= top:
            ranked.append((lang, at[lang], *rest))
    return ranked


def found(spark, rows, **options):
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA), **options)
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got.collect())


def made(rng, count):
    words = ["the", "The", "of", "cat", "sat", "On", "mat", "é", "x\xa0y", "中", "zz"]
    marks = [" ", "  ", "\t", ".", ", ", "\n", "\x0b", "\r\n", " ; ", ""]
    text = lambda: "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randrange(60)))
    return [(k, text(), rng.choice(["en", "en", "de", None])) for k in range(count)]


@pytest.mark.parametrize("shard", [1, 40, 300])
def test_summed_candidates_equal_a_plain_loop(spark, shard):
    rows = made(random.Random(7 + shard), 120)
    assert found(spark, rows, support=6, shard=shard, summed=0) == plain(rows, 6)


def test_many_shards_leave_only_frequent_candidates(spark):
    rows = made(random.Random(3), 200)
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("coalesce(lang, 'und') AS lang", "cast(text AS binary) AS text").repartition(30)
    words = collocations._words(docs, 40).where("phrase is not null and n >= 30")
    held = spark.sparkContext.broadcast(collocations.word_filter(words))
    sums = collocations._sums(docs, held, 5, 40)
    one = {r.h: r.n for r in sums.groupBy("h").agg({"n": "sum"}).toDF("h", "n").collect()}
    own = {r.phrase: r.n for r in collocations.phrases(docs, support=30, shard=40, summed=0)[0].where("phrase like '% %'").collect()}
    pairs = collocations._joined_filter(collocations._frequent(sums, 30, 1 << 20), 1 << 20)
    bits = sum(int(x).bit_count() for x in pairs)
    assert 0 < bits <= 2 * sum(n >= 30 for n in one.values()) < 2 * len(one) and own
    # the union of all shards' candidates at the lowered support, one, holds far more
    total = docs.withColumn("total", collocations.F.lit(10**9))
    everything = collocations._joined_filter(collocations._candidates(total, held, 30, 5, 40, 1 << 20), 1 << 20)
    assert bits < sum(int(x).bit_count() for x in everything) / 2


@pytest.mark.parametrize(("shard", "bits"), [(4_000_000, (1 << 25, 1 << 27)), (50, (1 << 25, 1 << 20)), (300, (64, 64)), (1, (1 << 12, 1 << 12))])
def test_random_texts_equal_a_plain_loop(spark, shard, bits):
    rows = made(random.Random(shard), 120)
    assert found(spark, rows, support=6, shard=shard, bits=bits) == plain(rows, 6)


def test_nulls_repeats_long_texts_and_the_top(spark):
    rows = [(1, None, None), (2, "", "fr"), (3, "A b " * 5000 + "c", "en"), (3, "a B " * 5000, "en"), (None, "x y z. " * 300, None), (4, "x y z", "und")]
    assert found(spark, rows) == plain(rows, 100)
    assert found(spark, rows, top=2) == plain(rows, 100, top=2)


def test_inside_a_longer_phrase_of_equal_count(spark):
    rows = [(k, "p q r s t; q r" if k % 2 else "p q r s t", "en") for k in range(20)]
    got = found(spark, rows, support=10)
    assert got == plain(rows, 10) and [r[2] for r in got] == ["p q r s t", "q r"]


def test_empty_tables_and_other_columns(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(k, "a b", "en", "x", 1) for k in range(5)]
    df = spark.createDataFrame(rows, SCHEMA + ", phrase string, n int")
    assert [r.phrase for r in collocations.collocations(df, support=5).collect()] == ["a b"]


def test_products_beyond_64_bits_are_exact(spark):
    a, n, left, right = 9_999_999_999_991, 99_999_999_999_973, 10_000_000_000_007, 9_999_999_999_993
    df = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long")
    assert df.select(collocations.score("a", "n", "l", "r").alias("s")).first()["s"] == 1000 * a * n // (left * right)


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    result = con.execute(registry.ORACLES["op11_collocations"])
    names = [c[0] for c in result.description]
    got = [tuple(r[c] for c in names) for r in registry.op11_collocations(spark, SF).collect()]
    assert sorted(got) == sorted(result.fetchall())
