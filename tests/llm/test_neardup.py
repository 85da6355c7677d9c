import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import neardup


def word_sets(text, size):
    import re

    w = re.findall(r"[^\W_]+", text.lower())
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def corpus(seed, n=90):
    """Texts from few phrases, with edited, reordered and exact copies."""
    rng = random.Random(seed)
    phrases = [" ".join(f"w{rng.randint(0, 60)}" for _ in range(rng.randint(4, 9))) for _ in range(40)]
    out = []
    for i in range(n):
        parts = rng.choices(phrases, k=rng.randint(3, 14))
        out.append((f"d{i}", ". ".join(parts)))
        while rng.random() < 0.5:
            other = list(parts)
            for _ in range(rng.randint(0, 2)):
                other[rng.randrange(len(other))] = rng.choice(phrases)
            if rng.random() < 0.3:
                rng.shuffle(other)
            out.append((f"d{i}-{len(out)}", " ".join(other).upper() if rng.random() < 0.5 else ". ".join(other)))
    return out + [("null", None), (None, "x y z"), ("short", "a b"), ("empty", ""), out[0]]


def brute(rows, size, threshold):
    sets = {d: word_sets(t, size) for d, t in rows if d and t}
    ids = sorted(d for d in sets if sets[d])
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


@pytest.mark.parametrize(("size", "threshold", "options"), [(3, 0.6, {}), (5, 0.8, {"hot": 3, "part_grams": 200}), (2, 0.5, {"hot": 2, "part_grams": 50}), (1, 0.9, {})])
def test_exact(spark, size, threshold, options):
    rows = corpus(size)
    df = spark.createDataFrame(rows, "doc_id string, t string").repartition(3)
    pairs, members = neardup.near_duplicates(df, doc_id=F.col("doc_id"), text=F.col("t"), size=size, threshold=threshold, **options)
    got = [tuple(r) for r in neardup.duplicate_pairs(pairs, members).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, size, threshold)
    links = neardup.link_counts(pairs, members).collect()
    assert len(links) == len({r.doc_id for r in links}) == len({d for d, t in rows if d and t and word_sets(t, size)})


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id string, t string")
    pairs, members = neardup.near_duplicates(df, doc_id=F.col("doc_id"), text=F.col("t"))
    assert pairs.count() == members.count() == neardup.duplicate_pairs(pairs, members).count() == 0


def test_hot_copies(spark):
    rows = [(f"c{i}", "one two three four five six seven eight") for i in range(200)] + [("e", "one two three four five six seven nine"), ("long", " ".join(map(str, range(60_000))))]
    df = spark.createDataFrame(rows, "doc_id string, t string").repartition(4)
    pairs, members = neardup.near_duplicates(df, doc_id=F.col("doc_id"), text=F.col("t"), size=3, threshold=0.7)
    assert pairs.count() == 1 and members.count() == 202
    assert {(r.copies, r.links) for r in neardup.link_counts(pairs, members).collect()} == {(200, 1), (1, 1), (1, 0)}


def test_packing():
    rng = np.random.default_rng(1)
    for n in (1, 2, 1000):
        v = np.unique(rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32))
        assert (neardup.unpack(neardup.pack(v)) == v).all()


def test_words_do_not_depend_on_neighbours():
    a = neardup.shingle_sets(["Um dois três quatro", "x", "", "um DOIS, três; quatro_"], 3)
    assert (a[0] == a[3]).all() and len(a[1]) == len(a[2]) == 0 and (neardup.shingle_sets(["um dois três quatro"], 3)[0] == a[0]).all()


def test_frequent_gram_is_split_on_both_sides(spark):
    """One shingle in a third of the texts: every cell gets a small part of either side, and no pair is lost."""
    rng = random.Random(9)
    rows = []
    for i in range(600):
        own = " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(6))
        rows.append((f"d{i:03}", f"hot one two three {own}" if i % 3 == 0 else own + " " + own[::-1]))
    rows += [(f"e{i:03}", f"hot one two three {rows[3 * i][1].split(maxsplit=4)[4]} end") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id string, t string").repartition(3)
    pairs, members = neardup.near_duplicates(df, doc_id=F.col("doc_id"), text=F.col("t"), size=3, threshold=0.6, hot=20, part_grams=400)
    assert {tuple(r) for r in neardup.duplicate_pairs(pairs, members).collect()} == brute(rows, 3, 0.6)
    sets = [s for s in neardup.shingle_sets([t for _, t in rows], 3)]
    small = [np.unique((s >> np.uint64(32)).astype(np.uint32)) for s in sets]
    sketch = np.zeros((neardup.SKETCH_ROWS, 1 << neardup.SKETCH_BITS), np.uint32)
    for row, cells in zip(sketch, neardup._cells(np.concatenate(small))):
        row += np.bincount(cells, minlength=len(row)).astype(np.uint32)
    out = neardup._blocks([i.to_bytes(16, "big") for i in range(len(rows))], small, sketch, 0.6, 2, 20, neardup.hot_cells(sketch, 20, 32))
    for cell, block in zip(out["cell"], out["block"]):
        if cell >= neardup.PARTS * 2:
            role = neardup._unpack(block, 0.6)[6]
            assert (role & 1).sum() < 60 and (role & 2).sum() < 60  # of 260


@pytest.mark.parametrize("small", [0, 4, 15, 10**6])
def test_small_sets_are_joined_whole(spark, monkeypatch, small):
    """Wherever the line between small and large sets is drawn, no pair is lost: here within one process."""
    monkeypatch.setattr(neardup, "SMALL", small)
    rows = corpus(11)
    texts = sorted({t for d, t in rows if d and t})
    sets = [(np.unique((s >> np.uint64(32)).astype(np.uint32)), t) for s, t in zip(neardup.shingle_sets(texts, 2), texts) if len(s)]
    classes = {s.tobytes(): s for s, _ in sets}
    keys = [i.to_bytes(16, "big") for i in range(len(classes))]
    grams = list(classes.values())
    sketch = np.zeros((neardup.SKETCH_ROWS, 1 << neardup.SKETCH_BITS), np.uint32)
    for row, cells in zip(sketch, neardup._cells(np.concatenate(grams))):
        row += np.bincount(cells, minlength=len(row)).astype(np.uint32)
    out = neardup._blocks(keys, grams, sketch, 0.5, 1, 10**9, 0)
    found = set()
    for cell in set(out["cell"]):
        a, b = neardup.joined([x for c, x in zip(out["cell"], out["block"]) if c == cell], 0.5)
        found |= {frozenset((x.tobytes(), y.tobytes())) for x, y in zip(a, b)}
    for i, x in enumerate(grams):
        for j in range(i):
            same = len(np.intersect1d(x, grams[j]))
            if same >= 0.5 * (len(x) + len(grams[j]) - same):
                assert frozenset((keys[i], keys[j])) in found
