"""Work and memory on very long and odd inputs, and what bounds them against plainer versions."""

from __future__ import annotations

import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from docketspark.llm import decontamination, licenses, mixing, near_dedup, secrets, substring_dedup


def seconds(f, n):
    best = []
    for _ in range(2):
        began = time.process_time()
        f(n)
        best.append(time.process_time() - began)
    return min(best)


def test_spans_apart_as_by_all_pairs():
    rng = random.Random(1)
    for shared in (0, 3):
        for _ in range(300):
            spans = [(b, b + rng.randint(1, 12)) for b in (rng.randrange(60) for _ in range(40))]
            apart, kept = licenses.Apart(shared), []
            for b, e in spans:
                free = all(min(e, y) - max(b, x) <= shared for x, y in kept)
                assert apart.add(b, e) == free
                if free:
                    kept.append((b, e))


def test_spans_within_longer_as_by_all_pairs():
    rng = random.Random(2)
    for _ in range(200):
        spans = sorted((("x", rng.randint(1, 6), 9, b, b + rng.randint(1, 12)) for b in (rng.randrange(20) for _ in range(30))), key=lambda x: (-x[1], x[3], x[2]))
        assert licenses.within_longer(spans) == [any(x[1] > m and x[3] <= b and e <= x[4] for x in spans) for _, m, _, b, e in spans]


def test_many_notices_in_one_text(spark):
    line = "Released under the MIT License.\n"
    docs = lambda n: spark.createDataFrame([(1, line * n)], "doc_id long, text string")
    assert licenses.scan(docs(300)).count() == 300

    def wall(n):
        began = time.perf_counter()
        assert licenses.scan(docs(n)).count() == n
        return time.perf_counter() - began

    wall(2000)
    assert wall(16_000) < 20  # 26 s for 8,000 when each match was held against all others


def test_many_passwords_in_one_text():
    text = lambda n: "\n".join(f"postgres://user{i}:pa55-{i}word{i}@db.example/{i}" for i in range(n))
    assert len(secrets.candidates(text(50))) >= 50
    short, long = (seconds(lambda n: secrets.candidates(text(n)), n) for n in (2000, 8000))
    assert long < 6 * short


def test_shingles_are_handed_on_by_their_bytes(monkeypatch):
    monkeypatch.setattr(near_dedup, "FLUSH_BYTES", 1 << 20)
    rng = random.Random(3)
    batches = [pa.record_batch([pa.array([" ".join(f"w{rng.randrange(10**6)}" for _ in range(20_000)) for _ in range(10)])], names=["text"]) for _ in range(6)]
    fed = []

    def feed():
        for b in batches:
            fed.append(b)
            yield b

    at = [len(fed) for _ in near_dedup._keys(5, 13, 4, 80)(feed())]
    assert at[0] == 1 and len(set(at)) > 4  # handed on long before the last batch


def test_equal_rows_and_empty_texts_are_spread(spark):
    rows = [(None, "")] * 3000 + [(7, "one text " * 30)] * 3000 + [(i, f"text of {i} " * 5) for i in range(100, 1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    dealt, buckets, _ = substring_dedup._dealt(docs, "doc_id", 1 << 14, 100)
    sizes = dealt.groupBy("bucket", F.length("text").alias("n")).count().agg(F.max("count")).first()[0]
    assert buckets >= 32 and sizes < 500
    got = substring_dedup.remove_repeats(docs, bucket_bytes=1 << 14).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("n_removed").alias("most")).where("doc_id = 7 or doc_id is null").collect()
    # a text repeats windows of its own; all its rows lose the same
    assert {(r.doc_id, r.n) for r in got} == {(None, 3000), (7, 3000)}


def test_rows_of_one_id_in_many_buckets_lose_the_same(spark):
    words = lambda seed, n: " ".join(f"{seed}-{k}" for k in range(n))
    rows = [(1, words("a", 60))] + [(5, words("a", 60))] * 40 + [(5, words("b", 30))] + [(9, words("b", 30))] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs, bucket_bytes=500).collect())
    assert got == sorted([(1, 60, 0)] + [(5, 60, 60)] * 40 + [(5, 30, 0)] + [(9, 30, 30)] * 3)


def test_documents_without_ids_meet_the_targets(spark):
    rng = random.Random(4)
    rows = [(None, f"{source}{k} " + "w " * rng.randint(5, 14), source) for source in "abcdef" for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.copies(docs).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()
    # a draw of 200 documents of ten words deviates by some 70 words
    assert len(got) == 6 and all(abs(r.taken - r.target) < 260 for r in got)
    shared = mixing.copies(docs.withColumn("doc_id", F.lit(7).cast("long"))).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) < 260 for r in shared)


def test_items_that_share_a_phrase_and_long_items(spark):
    """No leak where only a phrase of all items stands; the work of an item grows with its length."""
    rng = random.Random(5)
    some = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    phrase = "in the year of our lord one thousand"
    items = [(n, f"{some(20)} {phrase} {some(20)}") for n in range(200)]
    docs = [(n, f"{some(60)} {phrase} {some(60)} {phrase}") for n in range(100)] + [(1000, items[7][1])]

    def wall(docs, items):
        began = time.perf_counter()
        got = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
        return {(r.doc_id, r.item_id, r.similarity) for r in got}, time.perf_counter() - began

    assert wall(docs, items[:20])[0] == {(1000, 7, 1.0)}
    (got, few), (same, many) = wall(docs, items[:50]), wall(docs, items)
    assert got == same == {(1000, 7, 1.0)} and many < 3 * few
    (_, short), (found, long) = (wall([(1, f"x {text} y")], [(1, text)]) for text in (some(1000), some(4000)))
    assert found == {(1, 1, 1.0)} and long < 4 * short
