"""Test passages that leaked into a corpus, found with an FM-index per shard.

The alphabet of the index is the test set's vocabulary. Each shard of the corpus is
folded to words; stretches of at least ``run`` successive vocabulary words (nothing
shorter can hold a passage) form its text, parted by a symbol of their own. Over that
text an FM-index is built: the Burrows-Wheeler transform in a wavelet matrix and a
sampled suffix array. All test windows of ``run`` words are searched backwards at
once, occurrences are located through the samples, and overlapping windows of one
item are merged into spans. Shards never meet, so there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.words import WORD, fold, repair, words

SPANS = "doc_id bigint, item_id bigint, first_word int, last_word int, longest int"


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of the sorted suffixes, by prefix doubling."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1 if step < n else 0
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], (np.diff(key[order]) != 0).astype(np.int64)]))
        rank = new
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class WaveletMatrix:
    """Rank over a sequence of symbols, one bit vector with running counts per level."""

    def __init__(self, symbols: np.ndarray, levels: int) -> None:
        self.levels, self.ones, self.zeros = levels, [], []
        now = symbols
        for level in range(levels - 1, -1, -1):
            bits = (now >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bits)]).astype(np.int32))
            self.zeros.append(int(len(bits) - bits.sum()))
            now = np.concatenate([now[bits == 0], now[bits == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        low, high = np.zeros_like(at), at
        for ones, zeros, level in zip(self.ones, self.zeros, range(self.levels - 1, -1, -1), strict=True):
            bit = (symbol >> level) & 1
            a, b = ones[low], ones[high]
            low, high = np.where(bit == 1, zeros + a, low - a), np.where(bit == 1, zeros + b, high - b)
        return high - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it occurs before."""
        symbol, low, high = np.zeros_like(at), np.zeros_like(at), at
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[high + 1] - ones[high]
            a, b = ones[low], ones[high]
            symbol = symbol * 2 + bit
            low, high = np.where(bit == 1, zeros + a, low - a), np.where(bit == 1, zeros + b, high - b)
        return symbol, high - low


class FMIndex:
    """Counts and places of patterns in a text of symbols >= 1; patterns may hold symbols that the text lacks."""

    def __init__(self, text: np.ndarray, sample: int = 16) -> None:
        text = np.concatenate([text, [0]]).astype(np.int64)
        order = suffix_array(text)
        levels = max(1, int(text.max()).bit_length())
        self.bwt = WaveletMatrix(text[order - 1], levels)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=(1 << levels) + 1))]).astype(np.int64)
        kept = order % sample == 0
        self.kept_before = np.concatenate([[0], np.cumsum(kept)]).astype(np.int64)
        self.samples = order[kept]
        self.size = len(text)

    def ranges(self, stream: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [from, to) of the patterns of one length that begin at ``starts`` of a stream, searched backwards together.

        A symbol beyond the index's own range occurs nowhere.
        """
        low = np.zeros(len(starts), np.int64)
        high = np.full(len(starts), self.size, np.int64)
        live = np.arange(len(starts))
        for back in range(length - 1, -1, -1):
            c = stream[starts[live] + back].astype(np.int64)
            known = c < 1 << self.bwt.levels
            if not known.all():
                low[live[~known]] = high[live[~known]] = 0
                live, c = live[known], c[known]
            a, b = self.before[c] + self.bwt.rank(c, low[live]), self.before[c] + self.bwt.rank(c, high[live])
            low[live], high[live] = a, b
            live = live[a < b]
            if not len(live):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text positions of suffix rows, walking back to a sampled one."""
        found, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live, at = np.arange(len(rows)), rows.astype(np.int64)
        while len(live):
            kept = self.kept_before[at + 1] > self.kept_before[at]
            done = live[kept]
            found[done] = self.samples[self.kept_before[at[kept]]] + steps[done]
            live, at = live[~kept], at[~kept]
            steps[live] += 1
            symbol, rank = self.bwt.access(at)
            at = self.before[symbol] + rank
        return found


class Passages:
    """The windows of a test set over its own vocabulary: one stream of symbols and the place where each window begins."""

    def __init__(self, items: list[tuple[int, str]], run: int) -> None:
        self.run, self.ids = run, {}
        self.names = np.array([i for i, _ in items], np.int64)
        stream, starts, owners, places = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        at = 0
        for number, (_, text) in enumerate(items):
            symbols = np.array([self.ids.setdefault(w, len(self.ids) + 2) for w in words(repair(text))], np.int32)  # 0 ends the text, 1 parts it
            n = max(0, len(symbols) - run + 1)
            stream.append(symbols)
            starts.append(at + np.arange(n))
            owners.append(np.full(n, number, np.int32))
            places.append(np.arange(n, dtype=np.int32))
            at += len(symbols)
        self.stream, self.starts = np.concatenate(stream), np.concatenate(starts)
        self.owners, self.places = np.concatenate(owners), np.concatenate(places)

    def stretches(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of a text's long stretches of vocabulary words, each followed by 1, and the words' places."""
        get = self.ids.get
        symbols = np.array([get(w, 0) for w in WORD.findall(fold(text))], np.int64)
        if len(symbols) < self.run:
            return symbols[:0], symbols[:0]
        known = np.concatenate([[0], (symbols > 0).astype(np.int8), [0]])
        edges = np.diff(known)
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        keep = ends - starts >= self.run
        parts, at = [], []
        for a, b in zip(starts[keep], ends[keep], strict=True):
            parts += [symbols[a:b], [1]]
            at += [np.arange(a, b + 1)]
        return (np.concatenate(parts), np.concatenate(at)) if parts else (symbols[:0], symbols[:0])

    def search(self, docs: list[int], parts: list[tuple[np.ndarray, np.ndarray]]) -> dict[str, list]:
        """Merged spans of every passage in one shard, found through its index."""
        out: dict[str, list] = {"doc_id": [], "item_id": [], "first_word": [], "last_word": [], "longest": []}
        sizes = np.array([len(p[0]) for p in parts])
        if not len(self.starts) or not sizes.sum():
            return out
        text, place = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        doc = np.repeat(np.arange(len(parts)), sizes)
        index = FMIndex(text)
        low, high = index.ranges(self.stream, self.starts, self.run)
        count = high - low
        hit = np.flatnonzero(count)
        if not len(hit):
            return out
        window = np.repeat(hit, count[hit])
        rows = np.arange(count.sum()) - np.repeat(np.cumsum(count[hit]) - count[hit], count[hit]) + np.repeat(low[hit], count[hit])
        at = index.locate(rows)
        d, item, start, shift = doc[at], self.names[self.owners[window]], place[at], place[at] - self.places[window]
        order = np.lexsort((start, shift, item, d))
        d, item, start, shift = d[order], item[order], start[order], shift[order]
        # windows of one item at one shift that follow each other are one run of equal words
        new = np.concatenate([[True], (np.diff(d) != 0) | (np.diff(item) != 0) | (np.diff(shift) != 0) | (np.diff(start) > 1)])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(d)]]) - 1
        d, item, a, b = d[first], item[first], start[first], start[last] + self.run
        order = np.lexsort((a, item, d))
        spans: list[list[int]] = []
        for i in order:  # removal spans: what overlaps is merged
            one = [int(d[i]), int(item[i]), int(a[i]), int(b[i]), int(b[i] - a[i])]
            if spans and spans[-1][:2] == one[:2] and one[2] <= spans[-1][3]:
                spans[-1][3] = max(spans[-1][3], one[3])
                spans[-1][4] = max(spans[-1][4], one[4])
            else:
                spans.append(one)
        for i, item_, a_, b_, longest in spans:
            for name, value in zip(out, (docs[i], item_, a_, b_ - 1, longest), strict=True):
                out[name].append(value)
        return out


def leaked_spans(corpus: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", run: int = 12, shard_words: int = 1 << 21, most_bytes: int = 1 << 26) -> DataFrame:
    """(doc_id, item_id, first_word, last_word, longest): merged spans of ``run`` or more successive words of an item.

    Words are compared without case and accents; a text whose encoding was mangled is read
    repaired. first_word and last_word count the text's words from 0. Null and blank texts,
    items shorter than ``run`` words, and items without an id have no spans; ids that repeat are searched as one
    item each. The test set is a stated query set, held in memory with about four times the
    bytes of its text: one of more than ``most_bytes`` bytes (64 MB) is refused before it is
    read and must be searched in parts. Further columns are not read.
    """
    usable = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    held = usable.agg(F.sum(F.octet_length("t").cast("bigint") + 8)).first()[0] or 0
    if held > most_bytes:
        raise ValueError(f"the test set has {held} bytes, more than {most_bytes}")
    passages = corpus.sparkSession.sparkContext.broadcast(Passages([tuple(r) for r in usable.collect()], run))  # of bounded size

    def run_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[int] = []
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held, own = 0, passages.value
        schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int32()), ("last_word", pa.int32()), ("longest", pa.int32())])
        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = own.stretches(repair(value))
                if len(part[0]):
                    docs.append(doc)
                    parts.append(part)
                    held += len(part[0])
                if held >= shard_words:
                    yield pa.RecordBatch.from_pydict(own.search(docs, parts), schema=schema)
                    docs, parts, held = [], [], 0
        if docs:
            yield pa.RecordBatch.from_pydict(own.search(docs, parts), schema=schema)

    return corpus.select(F.col(doc_id).cast("bigint").alias("d"), F.col(text).alias("t")).where("d is not null and t is not null").mapInArrow(run_shard, SPANS)


def leaked_pairs(corpus: DataFrame, items: DataFrame, **options: object) -> DataFrame:
    """(doc_id, item_id): each document with each item that leaked into it, once."""
    return leaked_spans(corpus, items, **options).select("doc_id", "item_id").distinct()
