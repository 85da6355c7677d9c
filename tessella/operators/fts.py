"""Full-text search: lexemes with positions, a web-style query language, cover-density rank."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.stem import stem
from tessella.functions.text import fold_text

TOKEN = re.compile(r"[^\W_]+")
#: The commonest function words of Portuguese, left out of the index.
STOPWORDS = frozenset(
    "a ao aos aquela aquelas aquele aqueles aquilo as até com como da das de dela delas dele deles depois do dos e ela elas ele eles em entre era eram essa essas esse esses esta estas este estes eu foi foram há isso isto "
    "já lhe lhes mais mas me mesmo meu minha muito na nas nem no nos nós não o os ou para pela pelas pelo pelos por qual quando que quem se sem ser seu seus só são sua suas também te tem tinha tu um uma umas uns você à às é".split()
)


@cache
def lexeme(word: str) -> str | None:
    """The accent-free stem of a lower-case word, None for a stop word."""
    return None if word in STOPWORDS else fold_text(stem(word))


def lexemes(text: str, stemmed: bool = True) -> list[tuple[str, int]]:
    """(lexeme, position from 1); stop words take up a position."""
    out = []
    for i, word in enumerate(TOKEN.findall(text.lower()), 1):
        x = lexeme(word) if stemmed else fold_text(word)
        if x:
            out.append((x, i))
    return out


@dataclass(frozen=True)
class Term:
    """A word, or a phrase of several: each with its distance from the first, which counts stop words too."""

    words: tuple[str, ...]
    offsets: tuple[int, ...] = (0,)


@dataclass(frozen=True)
class Query:
    """Any of the alternatives: all wanted terms and none of the unwanted."""

    alternatives: tuple[tuple[tuple[Term, ...], tuple[Term, ...]], ...]


def parse(text: str, stemmed: bool = True) -> Query:
    """Words are joined by and, OR separates alternatives, "..." is a phrase, - excludes."""
    groups: list[tuple[list[Term], list[Term]]] = [([], [])]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text):
        if word == "OR" and not minus:
            groups.append(([], []))
            continue
        found = lexemes(phrase or word, stemmed)
        if found:
            groups[-1][1 if minus else 0].append(Term(tuple(x for x, _ in found), tuple(p - found[0][1] for _, p in found)))
    return Query(tuple((tuple(a), tuple(b)) for a, b in groups if a or b))


def _places(term: Term, at: dict[str, list[int]]) -> list[int]:
    """Where a term begins: the words of a phrase stand at their exact distances."""
    rest = [(set(at.get(w, ())), o) for w, o in zip(term.words[1:], term.offsets[1:], strict=True)]
    return [p for p in at.get(term.words[0], []) if all(p + o in places for places, o in rest)]


def score(query: Query, at: dict[str, list[int]]) -> float | None:
    """None without a match, else the sum over minimal covers of 1 / (1 + words in excess).

    A cover is a shortest stretch that holds every wanted term (Clarke, Cormack and Tudhope 2000).
    """
    best = None
    for wanted, unwanted in query.alternatives:
        if any(_places(t, at) for t in unwanted):
            continue
        places = [_places(t, at) for t in wanted]
        if not all(places):
            continue
        total = 0.0 if wanted else 1.0
        marks = sorted((p, i) for i, ps in enumerate(places) for p in ps)
        last: dict[int, int] = {}
        previous = -1
        for p, i in marks:
            last[i] = p
            if len(last) == len(places):
                start = min(last.values())
                if start > previous:
                    total += 1 / (1 + max(0, p - start + 1 - len(places)))
                    previous = start
        best = total if best is None else max(best, total)
    return best


def ranked(docs: DataFrame, text: Column, query: str, limit: int | None, *, cap: int | None = None, stemmed: bool = True) -> DataFrame:
    """(doc_id, score): the best ``limit`` matches, ties by doc_id; all matches, in no order, where limit is None.

    A word of the query is first sought in the folded text inside the JVM, so that most texts never
    reach Python. ``cap`` keeps only the first matches by doc_id, as a bound on ranking work. An empty
    query and null texts match nothing.
    """
    parsed = parse(query, stemmed)

    @F.pandas_udf(T.DoubleType())
    def scores(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            at: dict[str, list[int]] = {}
            for x, p in lexemes(t, stemmed):
                at.setdefault(x, []).append(p)
            out.append(score(parsed, at))
        return pd.Series(out, index=texts.index, dtype="float64")

    if not parsed.alternatives:
        return docs.select("doc_id", F.lit(0.0).alias("score")).where(F.lit(False))
    found = docs.where(text.isNotNull() & may_match(text, parsed)).select("doc_id", scores(text).alias("score")).where(F.col("score").isNotNull())
    if cap is not None:
        found = found.orderBy("doc_id").limit(cap)
    return found if limit is None else found.orderBy(F.desc("score"), "doc_id").limit(limit)


def may_match(text: Column, query: Query) -> Column:
    """A necessary condition: every wanted word's first letters (which its stem keeps) occur in the folded text."""
    from tessella.functions.text import fold

    low, any_ = fold(F.lower(text)), F.lit(False)
    for wanted, _ in query.alternatives:
        all_ = F.lit(True)
        for term in wanted:
            for w in term.words:
                all_ = all_ & low.contains(w[: max(1, min(len(w), 3))])
        any_ = any_ | all_
    return any_


ENTRIES = "array<struct<lexeme:string,positions:array<int>>>"


def postings(docs: DataFrame, text: Column, stemmed: bool = True) -> DataFrame:
    """(lexeme, doc_id, positions): the inverted lists. Ids must be unique, so a text makes its own rows and nothing is shuffled."""

    @F.pandas_udf(ENTRIES)
    def split(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            at: dict[str, list[int]] = {}
            for x, p in lexemes(t, stemmed) if t is not None else ():
                at.setdefault(x, []).append(p)
            out.append([{"lexeme": x, "positions": ps} for x, ps in at.items()])
        return pd.Series(out, index=texts.index, dtype=object)

    return docs.select("doc_id", F.explode(split(text)).alias("x")).select("x.lexeme", "doc_id", "x.positions")


#: Parts of a stored index.
PARTS = 64


def write_index(docs: DataFrame, text: Column, path: str, stemmed: bool = True) -> None:
    """The postings stored by part of their lexeme, sorted by lexeme within: a query reads the parts and row groups of its own words.

    Rows are placed by range of (part, lexeme, id), so that a word of very many documents is written by many tasks.
    """
    rows = postings(docs, text, stemmed).withColumn("part", F.crc32(F.col("lexeme").cast("binary")) % PARTS)
    rows.repartitionByRange("part", "lexeme", "doc_id").sortWithinPartitions("part", "lexeme", "doc_id").write.partitionBy("part").parquet(path)


def ranked_by_index(index: DataFrame, query: str, limit: int | None, *, kept: DataFrame | None = None, ids: DataFrame | None = None, cap: int | None = None, stemmed: bool = True) -> DataFrame:
    """As ``ranked``, from stored postings: only the lists of the query's own words are read and grouped by document.

    ``kept`` (doc_id) restricts the documents. A query with an alternative that only excludes words needs ``ids``, the ids
    of all documents that have a text, as no list names the documents without a word.
    """
    parsed = parse(query, stemmed)
    words = sorted({w for side in parsed.alternatives for terms in side for t in terms for w in t.words})
    parts = sorted({zlib.crc32(w.encode()) % PARTS for w in words})

    @F.pandas_udf(T.DoubleType())
    def scores(entries: pd.Series) -> pd.Series:
        held = ({e["lexeme"]: [int(p) for p in e["positions"]] for e in es} if es is not None else {} for es in entries)
        return pd.Series([score(parsed, at) for at in held], index=entries.index, dtype="float64")

    lists = index.where(F.col("part").isin(parts) & F.col("lexeme").isin(words))
    if kept is not None:
        lists = lists.join(kept.select("doc_id"), "doc_id", "left_semi")
    found = lists.groupBy("doc_id").agg(F.collect_list(F.struct("lexeme", "positions")).alias("entries"))  # an entry per word of the query
    if any(not wanted for wanted, _ in parsed.alternatives):
        if ids is None:
            raise ValueError("a query that only excludes words needs the ids of all documents")
        found = (ids if kept is None else ids.join(kept.select("doc_id"), "doc_id", "left_semi")).select("doc_id").join(found, "doc_id", "left")
    found = found.select("doc_id", scores("entries").alias("score")).where(F.col("score").isNotNull())
    if cap is not None:
        found = found.orderBy("doc_id").limit(cap)
    return found if limit is None else found.orderBy(F.desc("score"), "doc_id").limit(limit)
