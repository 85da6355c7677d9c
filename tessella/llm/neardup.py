"""Near-duplicate texts: an exact similarity join over word shingles.

Texts with the same shingle set form a class; only classes are compared. The method is
rare-first prefix filtering: shingles are ordered by corpus frequency (a count-min
sketch over all texts), and two sets of Jaccard similarity t or more must share a
shingle among the first |x| - ceil(t|x|) + 1 of either, at places and sizes that leave
room for enough further matches (positional and length filter).

On a corpus of recurring phrases that alone leaves too many candidates, so sets are
first projected on ``BUCKETS`` parts of the shingle space. If the whole sets reach
|x & y| >= t/(1+t) (|x|+|y|), so do their projections on at least one part, as both sides
add up over the parts. It is therefore enough to join the projections, each with its
own prefix, and the suffix filter becomes cheap: a parity sketch of each
projection bounds the size of their symmetric difference from below. No filter loses a
pair. Candidates are made distinct and verified once on the whole sets.

A projection of a small set holds next to nothing, so that even a common shingle would be
its rarest. Sets of at most ``SMALL`` shingles are therefore joined whole, as one more part.
Two sets that reach t differ in size by no more than t, so the part takes all sets up to
``SMALL`` / t: a pair is either in it, or both its sets are large enough for projections.

Postings travel as packed blocks, one row per map batch and target partition.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.session import materialize

BUCKETS = 8
SMALL = 40
#: The parts of the shingle space, and the part of the small sets.
PARTS = BUCKETS + 1
#: 64-bit words of a parity sketch.
WORDS = 4
SKETCH_BITS, SKETCH_ROWS = 19, 2
ONE, ODD = np.uint64(1), np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finalizer of MurmurHash3)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


CHUNK_CHARS = 1 << 19
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_word_chars: list[np.ndarray] = []


def _hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every word of some texts: runs of letters and digits, case ignored.

    A word's hash is a polynomial in its characters modulo 2^64, read off running sums.
    """
    if not _word_chars:
        _word_chars.append(np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000))
    low = [t.lower() for t in texts]
    starts = np.cumsum([0, *[len(t) + 1 for t in low]])
    chars = np.frombuffer(" ".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    room = 1 << max(19, int(len(chars)).bit_length())
    if room not in _tables:
        _tables.clear()
        _tables[room] = (_powers(int(ODD), room), _powers(pow(int(ODD), -1, 1 << 64), room))
    up, down = _tables[room]
    edges = np.flatnonzero(np.diff(_word_chars[0][chars].astype(np.int8), prepend=np.int8(0)))  # texts end with a blank
    first, last = edges[::2], edges[1::2]
    sums = np.cumsum(chars * up[: len(chars)], dtype=np.uint64)
    before = np.where(first > 0, sums[first - 1], np.uint64(0))
    return np.searchsorted(starts, first, "right") - 1, mix((sums[last - 1] - before) * down[first])


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its runs of ``size`` words."""
    doc, h = _hashed_words(texts)
    n = max(0, len(h) - size + 1)
    out = h[:n].copy()
    for i in range(1, size):
        out = out * ODD + h[i : n + i]
    own = doc[:n] == doc[size - 1 :] if n else np.empty(0, bool)
    out, doc = mix(out[own]), doc[:n][own]
    edges = np.searchsorted(doc, np.arange(len(texts) + 1))
    sets = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        x = np.sort(out[a:b])
        sets.append(x[np.concatenate([[True], x[1:] != x[:-1]])] if b > a else x)
    return sets


def _chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about CHUNK_CHARS characters; a longer text is a chunk of its own."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > CHUNK_CHARS:
            yield first, texts[first:i]
            first, held = i, 0
        held += len(t) + 1
    if first < len(texts):
        yield first, texts[first:]


def pack(values: np.ndarray) -> bytes:
    """Sorted 32-bit values as byte planes of their differences, which compress."""
    steps = values.copy()
    steps[1:] -= values[:-1]
    return steps.view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.uint32).ravel(), dtype=np.uint32)


def shingled(texts: DataFrame, doc_id: Column, text: Column, size: int) -> DataFrame:
    """(doc_id, class, n, grams): the class is a 128-bit hash of the shingle set, grams its sorted 32-bit values, packed.

    Null texts and those of fewer than ``size`` words have no shingles and are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, keys, sizes, grams = [], [], [], []
            for first, some in _chunks(batch.column(1).to_pylist()):
                for i, own in enumerate(shingle_sets(some, size), first):
                    if len(own):
                        small = (own >> np.uint64(32)).astype(np.uint32)
                        small = small[np.concatenate([[True], small[1:] != small[:-1]])]
                        keep.append(i)
                        keys.append(xxhash.xxh3_128_digest(own.tobytes()))
                        sizes.append(len(small))
                        grams.append(pack(small))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(grams, pa.binary())], names=["doc_id", "class", "n", "grams"])

    return texts.select(doc_id.cast("string").alias("doc_id"), text.alias("t")).where("doc_id is not null and t is not null").mapInArrow(run, "doc_id string, class binary, n int, grams binary")


def _cells(grams: np.ndarray) -> list[np.ndarray]:
    h = mix(grams.astype(np.uint64) + ODD)
    return [((h >> np.uint64(20 * r)) & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64) for r in range(SKETCH_ROWS)]


def frequencies(sets: DataFrame, tasks: int) -> np.ndarray:
    """A count-min sketch (fixed size) of how many texts hold each shingle; copies met in one task count once.

    Summed in two steps, so that no task gets more than about the root of all blocks.
    """
    blocks, width = 32, (1 << SKETCH_BITS) * SKETCH_ROWS // 32
    fan = max(1, math.isqrt(tasks))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen: set[bytes] = set()
        total = np.zeros((SKETCH_ROWS, 1 << SKETCH_BITS), np.int64)
        for batch in batches:
            new = []
            for key, grams in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key not in seen:
                    seen.add(key)
                    new.append(unpack(grams))
            if new:
                for row, cells in zip(total, _cells(np.concatenate(new)), strict=True):
                    row += np.bincount(cells, minlength=len(row))
        flat = np.minimum(total, 0xFFFFFFFF).astype(np.uint32).reshape(blocks, width)
        at = TaskContext.get().partitionId() % fan
        yield pa.RecordBatch.from_pydict({"at": [at] * blocks, "block": list(range(blocks)), "counts": [x.tobytes() for x in flat]}, schema=pa.schema([("at", pa.int32()), ("block", pa.int32()), ("counts", pa.binary())]))

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for counts in table.column("counts"):
            total += np.frombuffer(counts.as_py(), np.uint32)
        out = np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()
        return table.slice(0, 1).set_column(2, "counts", pa.array([out], pa.binary()))

    schema = "at int, block int, counts binary"
    parts = sets.select("class", "grams").mapInArrow(count, schema).groupBy("at", "block").applyInArrow(add, schema).groupBy("block").applyInArrow(add, schema)
    rows = sorted((r.block, r.counts) for r in parts.select("block", "counts").collect())  # the sketch has a fixed size
    if not rows:
        return np.zeros((SKETCH_ROWS, 1 << SKETCH_BITS), np.uint32)
    return np.concatenate([np.frombuffer(c, np.uint32) for _, c in rows]).reshape(SKETCH_ROWS, -1)


def _least(sizes: np.ndarray, share: float) -> np.ndarray:
    """ceil(share * size), safe against rounding."""
    return np.ceil(sizes * share - 1e-9).astype(np.int64)


def _indexed(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """The length of the prefix that must be found by sets of at least the same size."""
    return sizes - _least(sizes, 2 * threshold / (1 + threshold)) + 1


def hot_cells(sketch: np.ndarray, hot: int, most: int) -> int:
    """How many partitions, at most ``most``, the cells of the grams more frequent than ``hot`` get; several cells may share one, and are joined one after the other."""
    sides = -(-sketch[0][sketch[0] > hot].astype(np.int64) // hot)
    return int(min((sides**2).sum(), most))


def postings(sets: DataFrame, counts: object, threshold: float, spread: int, hot: int, extra: int) -> DataFrame:
    """(part, cell, block): packed prefixes of the projections, each class once per task.

    A gram that c > ``hot`` texts hold is split on both sides: with k = c / hot, probing entries take a row and
    indexed ones a column of a grid of k x k cells by their class, and each goes to all cells of its line. Any two
    meet in one cell, and a cell holds about ``hot`` entries of either kind however frequent the gram is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        sketch = counts.value
        for batch in batches:
            keys, sets_ = [], []
            for key, grams in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key not in seen:
                    seen.add(key)
                    keys.append(key)
                    sets_.append(unpack(grams))
            if keys:
                yield pa.RecordBatch.from_pydict(_blocks(keys, sets_, sketch, threshold, spread, hot, extra), schema=pa.schema([("part", pa.int32()), ("cell", pa.int64()), ("block", pa.binary())]))

    return sets.select("class", "grams").mapInArrow(run, "part int, cell bigint, block binary")


def _blocks(keys: list[bytes], sets: list[np.ndarray], sketch: np.ndarray, threshold: float, spread: int, hot: int, extra: int) -> dict[str, list]:
    whole = np.array([len(s) for s in sets])
    gram = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), whole)
    count = np.minimum(*[row[c] for row, c in zip(sketch, _cells(gram), strict=True)]) if SKETCH_ROWS == 2 else np.min([row[c] for row, c in zip(sketch, _cells(gram), strict=True)], axis=0)
    h = mix(gram.astype(np.uint64))
    apart, together = np.flatnonzero((whole > SMALL)[doc]), np.flatnonzero((whole <= SMALL / threshold + 1e-9)[doc])
    cell = np.concatenate([doc[apart] * PARTS + (h[apart] % np.uint64(BUCKETS)).astype(np.int64), doc[together] * PARTS + BUCKETS])
    both = np.concatenate([apart, together])
    gram, count, h = gram[both], count[both], h[both]
    order = np.lexsort((gram, count, cell))
    gram, count, h, cell = gram[order], count[order], h[order], cell[order]
    start = np.flatnonzero(np.concatenate([[True], np.diff(cell) != 0]))
    size = np.diff(np.concatenate([start, [len(cell)]]))
    bit = ONE << ((h >> np.uint64(8)) & np.uint64(63))
    half = (h >> np.uint64(14)) % np.uint64(WORDS)
    parity = np.stack([np.bitwise_xor.reduceat(np.where(half == x, bit, np.uint64(0)), start) for x in range(WORDS)], axis=1)
    pos = np.arange(len(cell)) - np.repeat(start, size)
    own = np.repeat(np.arange(len(start)), size)  # the projection of each posting
    probe = pos < (size - _least(size, threshold) + 1)[own]
    index = pos < _indexed(size, threshold)[own]
    keep = np.flatnonzero(probe & (count > 1))  # a gram counted once occurs once
    gram, count, own, pos, index = gram[keep], count[keep], own[keep], pos[keep], index[keep]
    place = (cell[start] % PARTS)[own] + PARTS * ((mix(gram.astype(np.uint64) ^ ODD) % np.uint64(spread)).astype(np.int64))
    role = usual = np.where(index, 3, 1).astype(np.uint8)
    much = np.flatnonzero(count > hot)
    if len(much):
        whose = gram.astype(np.uint64) | ((cell[start] % PARTS)[own].astype(np.uint64) << np.uint64(32))  # a gram may be in a part and in that of the small sets
        sides = -(-count[much].astype(np.int64) // hot)
        line = np.array([xxhash.xxh32_intdigest(keys[d]) for d in (cell[start] // PARTS)[own[much]]]) % sides
        copy, side, mine = np.repeat(much, sides), np.repeat(sides, sides), np.repeat(line, sides)
        other = np.arange(len(copy)) - np.repeat(np.cumsum(sides) - sides, sides)
        grid = lambda row, column: PARTS * spread + (mix(mix((row * side + column).astype(np.uint64) + ODD) ^ whose[copy]) >> np.uint64(2)).astype(np.int64)
        indexed = index[copy]
        rest = np.setdiff1d(np.arange(len(gram)), much, assume_unique=True)
        pick = np.concatenate([rest, copy, copy[indexed]])
        place = np.concatenate([place[rest], grid(mine, other), grid(other, mine)[indexed]])
        role = np.concatenate([role[rest], np.full(len(copy), 1, np.uint8), np.full(int(indexed.sum()), 2, np.uint8)])
        gram, own, pos, usual = gram[pick], own[pick], pos[pick], usual[pick]
    out: dict[str, list] = {"part": [], "cell": [], "block": []}
    order = np.argsort(place, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(place[order]) != 0, [True]])) if len(order) else np.array([0])
    key_bytes = np.frombuffer(b"".join(keys), "V16")
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        at = order[a:b]
        at = at[np.argsort(own[at], kind="stable")]
        used, entries = np.unique(own[at], return_counts=True)
        docs = cell[start[used]] // PARTS
        wide, large = _narrow(max(int(pos[at].max()), int(size[used].max()))), _narrow(int(whole[docs].max()))
        salted = bool((role[at] != usual[at]).any())
        head = np.array([len(used), len(at), np.dtype(wide).itemsize, np.dtype(large).itemsize, salted], np.int64)
        fields = (head, key_bytes[docs], whole[docs].astype(large), size[used].astype(wide), parity[used], entries.astype(wide), gram[at], pos[at].astype(wide), *([role[at]] if salted else []))
        to = int(place[order[a]])
        out["part"].append(to if to < PARTS * spread else PARTS * spread + to % extra)
        out["cell"].append(to)
        out["block"].append(b"".join(x.tobytes() for x in fields))
    return out


WIDTHS = {1: np.uint8, 2: np.uint16, 4: np.uint32}


def _narrow(most: int) -> type:
    return np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32


def _unpack(block: bytes, threshold: float) -> tuple[np.ndarray, ...]:
    """Keys, whole sizes, sizes, parities; then per entry gram, place, role and number of its text."""
    docs, entries, width, larger, salted = np.frombuffer(block, np.int64, 5)
    at, out = 40, []
    wide, large = WIDTHS[int(width)], WIDTHS[int(larger)]
    for kind, n in (("V16", docs), (large, docs), (wide, docs), (np.uint64, WORDS * docs), (wide, docs), (np.uint32, entries), (wide, entries), (np.uint8, entries if salted else 0)):
        out.append(np.frombuffer(block, kind, n, at))
        at += np.dtype(kind).itemsize * int(n)
    key, whole, size, parity, held, gram, pos, role = out
    whole, size = whole.astype(np.uint32), size.astype(np.int64)
    local = np.repeat(np.arange(docs), held.astype(np.int64))
    if not salted:
        role = np.where(pos < _indexed(size, threshold)[local], 3, 1).astype(np.uint8)
    return key, whole, size, parity.reshape(-1, WORDS), gram, pos.astype(np.int32), role, local


def joined(blocks: list[bytes], threshold: float, chunk: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """The classes of candidate pairs of one partition, each pair once, by all filters."""
    parts = [_unpack(b, threshold) for b in blocks]
    key = np.concatenate([p[0] for p in parts])
    base = np.cumsum([0, *[len(p[0]) for p in parts]])
    names, first, code = np.unique(key, return_index=True, return_inverse=True)
    whole, size = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
    gram, pos, role = (np.concatenate([p[i] for p in parts]) for i in (4, 5, 6))
    doc = np.concatenate([p[7] + b for p, b in zip(parts, base[:-1], strict=True)])
    mine = first[code[doc]] == doc  # a class sent by several tasks counts once
    gram, pos, role, doc = gram[mine], pos[mine], role[mine], doc[mine]
    n = size[doc].astype(np.int32)
    order = np.lexsort((code[doc], n, gram))
    gram, pos, role, doc, n = gram[order], pos[order], role[order], doc[order], n[order]
    rank = np.arange(len(gram))
    indexed, probes = np.flatnonzero(role & 2), np.flatnonzero(role & 1)
    share = threshold / (1 + threshold)
    # room: the largest joint size that the rest of a set, from a place on, can still reach the threshold with
    room = np.floor((n - pos + 1e-9) / share).astype(np.int64)
    place = gram.astype(np.int64) << 31
    # an indexed entry before the probe in (gram, size, class) order, of at least t times its size, and not too large for its place
    low = np.searchsorted((place + n)[indexed], place[probes] + _least(n[probes].astype(np.float64), threshold), "left")
    high = np.minimum(np.searchsorted(rank[indexed], probes, "left"), np.searchsorted((place + n)[indexed], place[probes] + np.maximum(room[probes] - n[probes], 0), "right"))
    todo = high - low
    some = todo > 0
    probes, low, todo = probes[some], low[some].astype(np.int32), todo[some]
    j_doc = doc[indexed].astype(np.int32)
    narrow = np.int16 if len(n) and n.max() < 16000 else np.int32
    j_most = np.minimum(room[indexed] - n[indexed], np.iinfo(narrow).max).astype(narrow)  # the largest probe an entry has room for
    i_size, i_doc = n[probes].astype(narrow), doc[probes].astype(np.int32)
    parity = np.concatenate([p[3] for p in parts])
    sketch = [np.ascontiguousarray(parity[:, w]) for w in range(WORDS)]
    ends = np.cumsum(todo)
    found, a = [], 0
    while a < len(probes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + chunk, "right")))
        count = todo[a:b]
        j = np.arange(count.sum(), dtype=np.int32) + np.repeat(low[a:b] - (np.cumsum(count) - count).astype(np.int32), count)
        ok = np.flatnonzero(j_most[j] >= np.repeat(i_size[a:b], count))  # positional filter
        j = j_doc[j[ok]]
        i = i_doc[a + np.searchsorted(np.cumsum(count), ok, "right")]
        both = size[i].astype(np.int64) + size[j]
        slack = both - 2 * np.ceil(both * share - 1e-9).astype(np.int64)
        for word in sketch:  # suffix filter: differences counted so far already exceed the slack
            slack = slack - np.bitwise_count(word[i] ^ word[j])
            ok = np.flatnonzero(slack >= 0)
            i, j, slack = i[ok], j[ok], slack[ok]
        x, y = whole[i].astype(np.float64), whole[j].astype(np.float64)
        ok = np.minimum(x, y) >= threshold * np.maximum(x, y) - 1e-9  # length filter
        p, q = code[i[ok]], code[j[ok]]
        pair = np.minimum(p, q).astype(np.int64) * len(names) + np.maximum(p, q)
        found.append(np.unique(pair[p != q]))
        a = b
    pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    return names[pairs // max(1, len(names))], names[pairs % max(1, len(names))]


def candidates(blocks: DataFrame, threshold: float, parts: int) -> DataFrame:
    """(a, b): distinct candidate pairs of classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for cell, block in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                held.setdefault(cell, []).append(block)
        while held:
            a, b = joined(held.popitem()[1], threshold)
            yield pa.RecordBatch.from_pydict({"a": [x.tobytes() for x in a], "b": [x.tobytes() for x in b]}, schema=pa.schema([("a", pa.binary()), ("b", pa.binary())]))

    return blocks.repartitionById(parts, F.col("part")).mapInArrow(run, "a binary, b binary").distinct()


def verified(pairs: DataFrame, sets: DataFrame, threshold: float, most_broadcast: int = 50_000) -> DataFrame:
    """(a, b, similarity) of the pairs that reach the threshold on their whole sets."""
    ends = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    few = ends.limit(most_broadcast + 1).count() <= most_broadcast
    used = sets.select("class", "grams").join(F.broadcast(ends) if few else ends, "class", "left_semi").dropDuplicates(["class"])
    full = pairs.join(used.withColumnsRenamed({"class": "a", "grams": "x"}), "a").join(used.withColumnsRenamed({"class": "b", "grams": "y"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sims = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = unpack(x), unpack(y)
                same = len(np.intersect1d(p, q, assume_unique=True))
                sims.append(same / (len(p) + len(q) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], names=["a", "b", "similarity"])

    return full.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary, similarity double").where(F.col("similarity") >= threshold - 1e-12)


def near_duplicates(texts: DataFrame, *, doc_id: Column, text: Column, size: int = 5, threshold: float = 0.8, hot: int = 50_000, part_grams: int = 4_000_000) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs of classes (a, b, similarity) with Jaccard similarity >= threshold, and (class, doc_id).

    Every pair of different shingle sets that reaches the threshold is found. Texts with equal sets share
    a class. A document delivered several times is a member once; one delivered with different texts is a member
    of several classes. Null ids or texts and texts of fewer than ``size`` words are in no class. Very long
    texts are treated whole. An empty table gives empty results.
    """
    spark = texts.sparkSession
    sets = materialize(shingled(texts, doc_id, text, size), "neardup-sets")
    total = sets.agg(F.sum("n")).first()[0] or 0
    spread = max(1, -(-int(total) // (BUCKETS * part_grams)))
    counts = spark.sparkContext.broadcast(frequencies(sets, max(1, sets.rdd.getNumPartitions())))  # of fixed size
    extra = hot_cells(counts.value, hot, 2 * PARTS * spread)
    found = materialize(candidates(postings(sets, counts, threshold, spread, hot, extra), threshold, PARTS * spread + extra), "neardup-candidates")
    return verified(found, sets, threshold), sets.select("class", "doc_id").distinct()


def duplicate_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: all pairs of documents, within and across classes."""
    left, right = members.select(F.col("class").alias("a"), F.col("doc_id").alias("p")), members.select(F.col("class").alias("b"), F.col("doc_id").alias("q"))
    across = pairs.select("a", "b").join(left, "a").join(right, "b").where("p <> q")
    within = left.join(right, F.col("a") == F.col("b")).where("p < q")
    both = across.select("p", "q").unionByName(within.select("p", "q"))
    return both.select(F.least("p", "q").alias("doc_id_a"), F.greatest("p", "q").alias("doc_id_b")).distinct()


def link_counts(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_id, class_id, copies, links): one row per document and class, with the class's smallest member, its size and its number of linked classes."""
    links = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).groupBy("class").agg(F.count("*").alias("links"))
    copies = members.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    return members.join(copies, "class").join(links, "class", "left").select("doc_id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
