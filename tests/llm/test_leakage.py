import random

import numpy as np
import pytest

from tessella.llm import leakage
from tessella.llm.words import words


def test_index_against_scan():
    rng = np.random.default_rng(3)
    text = np.concatenate([rng.integers(1, 6, 700), np.tile([2, 3, 4], 60), rng.integers(1, 6, 90)])
    index = leakage.FMIndex(text, sample=7)
    patterns = np.array([text[i : i + 4] for i in range(0, len(text) - 4, 5)] + [[5, 5, 5, 5], [1, 2, 1, 2], [900, 1, 1, 1], [1, 1, 1, 7], [7, 8, 9, 300]])
    low, high = index.ranges(patterns.ravel(), np.arange(len(patterns)) * 4, 4)
    for p, a, b in zip(patterns, low, high, strict=True):
        expected = {i for i in range(len(text) - 3) if (text[i : i + 4] == p).all()}
        assert set(index.locate(np.arange(a, b)).tolist()) == expected


def brute(docs, items, run):
    out = set()
    for d, t in docs:
        w = words(t or "")
        for i, x in items:
            v = words(x or "")
            grams = {tuple(v[k : k + run]) for k in range(len(v) - run + 1)}
            if any(tuple(w[k : k + run]) in grams for k in range(len(w) - run + 1)):
                out.add((d, i))
    return out


@pytest.mark.parametrize("shard", [50, 1 << 20])
def test_against_brute_force(spark, shard):
    rng = random.Random(2)
    vocab = [f"pâl{i}" for i in range(25)] + ["É", "º", "12"]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(say(rng.randint(3, 30)))) for i in range(12)] + [(90, None), (91, "")]
    docs = []
    for d in range(120):
        w = say(rng.randint(0, 40)) + ["outro"] * rng.randint(0, 2)
        if rng.random() < 0.5:
            source = items[rng.randrange(12)][1].split()
            a = rng.randrange(len(source))
            w += source[a : a + rng.randint(1, 20)] + say(3)
        docs.append((d, rng.choice([" ", ",\n", "  - "]).join(x.upper() if rng.random() < 0.3 else x for x in w)))
    docs += [(500, None), (501, ""), (502, " ".join(["pal1"] * 40_000)), (503, items[0][1] + " " + items[0][1])]
    c, e = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in leakage.leaked_pairs(c, e, run=6, shard_words=shard).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, items, 6)


def test_spans(spark):
    item = " ".join(f"w{i}" for i in range(30))
    doc = "antes " + item.upper().replace(" ", ", ") + " depois " + " ".join(item.split()[3:17])
    c, e = spark.createDataFrame([(1, doc)], "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted(tuple(r) for r in leakage.leaked_spans(c, e).collect()) == [(1, 7, 1, 30, 30), (1, 7, 32, 45, 14)]
    assert leakage.leaked_spans(c, e.limit(0)).count() == leakage.leaked_spans(c.limit(0), e).count() == 0
    with pytest.raises(ValueError):
        leakage.leaked_spans(c, e.union(e), most_bytes=100)


@pytest.mark.parametrize("more", [5, 20, 700])
def test_shard_without_the_last_words_of_the_test_set(spark, more):
    first = [f"a{i}" for i in range(12)]
    items = spark.createDataFrame([(1, " ".join(first)), (2, " ".join(f"b{i}" for i in range(more)))], "item_id long, text string")
    docs = spark.createDataFrame([(7, "x " + " ".join(first) + " y")], "doc_id long, text string")
    assert [tuple(r) for r in leakage.leaked_spans(docs, items).collect()] == [(7, 1, 1, 12, 12)]


def test_any_partitioning_and_shard_size(spark):
    """Shards of one stretch, and of low symbols only, find what a single shard finds."""
    rng = random.Random(5)
    items = [(i, " ".join(f"v{rng.randint(20 * i, 20 * i + 40)}" for _ in range(20))) for i in range(30)]
    docs = [(d, "x ".join([" ".join(items[k][1].split()[a : a + 9]) + " " for k, a in [(rng.randrange(30), rng.randrange(12)) for _ in range(rng.randint(0, 3))]])) for d in range(60)]
    c, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items, 5)
    for parts, shard in ((1, 1 << 20), (7, 1), (60, 1), (3, 40)):
        assert {tuple(r) for r in leakage.leaked_pairs(c.repartition(parts), e, run=5, shard_words=shard).collect()} == want
