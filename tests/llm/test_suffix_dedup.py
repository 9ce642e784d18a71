"""Repeated byte strings against a table of all windows, suffix order against sorting."""

from __future__ import annotations

import bisect
import random

import numpy as np
import pytest

from docketspark.llm import suffix_dedup as sd
from docketspark.llm.suffix_array import suffix_ranks

SCHEMA = "doc_id long, text string, bucket string, row string, kept string"


def ranks(texts):
    return suffix_ranks(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))


def test_suffixes_in_order():
    rng = random.Random(1)
    cases = [[bytes(rng.randrange(k) + 97 for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 6))] for k in (1, 2, 3, 4) for _ in range(300)]
    for texts in [*cases, [b"a" * 100, b"a" * 60 + b"b"], [b"ab" * 50], [bytes(range(256)) * 2], [b""], [b"\x00\x00", b"\x00"]]:
        suffixes = [t[i:] for t in texts for i in range(len(t))]
        order = sorted(suffixes)
        assert ranks(texts).tolist() == [bisect.bisect_left(order, s) for s in suffixes], texts


def model(rows, width):
    """[(id, bytes, removed, spans, kept)] of (id, text)."""
    first: dict[bytes, int] = {}
    rows = [(i, (t or "").encode()) for i, t in rows]
    for i, b in rows:
        for a in range(len(b) - width + 1):
            w = b[a : a + width]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, b in rows:
        gone = bytearray(len(b))
        for a in range(len(b) - width + 1):
            if first[b[a : a + width]] < i:
                gone[a : a + width] = b"\x01" * width
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("ab é\n") for _ in range(n))
    passages = [text(n) for n in (49, 50, 51, 60, 200, 700)]
    texts = [text(rng.randint(0, 60)) + rng.choice(passages) + text(rng.randint(0, 60)) + rng.choice(passages) for _ in range(60)]
    for base in rng.sample(texts, 15):
        k = rng.randrange(len(base))
        texts += [base, base[:k] + "X" + base[k:], base[k:], base[:k]]
    texts += ["", None, "a" * 3000, "a" * 49, "a" * 50, "ab" * 900, "x" + "a" * 300, "😀" * 40, "😀" * 13 + "é", " " * 500, text(40_000)]
    texts.append(texts[-1][5_000:35_000])
    rng.shuffle(texts)
    return [(3 * i - 40, t) for i, t in enumerate(texts)]


def found(spark, rows, **options):
    frame = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA).repartition(5)
    return sorted(((r[0], *r[1:4], bytes(r[4])) for r in sd.remove_repeated_bytes(frame, **options).collect()), key=lambda r: (r[0] is not None, r))


@pytest.mark.parametrize("options", [{}, {"width": 33, "gram": 9}, {"bucket_bytes": 3000, "shard_keys": 50, "cell_bits": 6, "sorted_bytes": 500}, {"bucket_bytes": 3000, "hot": 2}])
def test_bytes_removed_as_by_all_windows(spark, options):
    rows = corpus(2)
    assert found(spark, rows, **options) == model(rows, options.get("width", 50))


def test_shared_and_null_ids(spark):
    passage = "".join(random.Random(5).choice("abcdefgh ") for _ in range(300))
    rows = [(7, passage), (7, passage), (7, "begin " + passage), (9, passage), (None, None), (None, passage + "end"), (None, passage + "end"), (None, "")]
    got = found(spark, rows)
    assert sorted(r[1] for r in got) == sorted(len((t or "").encode()) for _, t in rows)
    left = {}
    for r in got:
        left.setdefault((r[0], r[1]), []).append(r[2])
    # null ids come first, so the two equal rows of null keep all; every later row loses the passage
    assert left[None, 303] == [0, 0] and left[7, 300] == [300, 300] and left[7, 306] == [300] and left[9, 300] == [300] and left[None, 0] == [0, 0]


def test_many_empty_texts_without_id_are_spread(spark):
    docs = spark.createDataFrame([(None, "")] * 4000, "doc_id long, text string")
    dealt, _ = sd._dealt(docs, "doc_id", 1 << 20)
    sizes = [r["count"] for r in dealt.groupBy("bucket").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 700 and len(sizes) >= 8


def test_no_rows(spark):
    assert found(spark, []) == []
