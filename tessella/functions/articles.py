"""Article locators of the extraction step: one spelling, single places, and the legislation list they belong to.

A locator is read by two scanners. The first goes over the characters as typed and writes
numbers, ordinal marks and key words in one spelling. The second turns that spelling into
a row of marked parts, and the single places are read off the order of the marks.
"""

from __future__ import annotations

import re
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.text import law_name

#: The most members a range may have, and how much each citation context weighs.
LONGEST = 21
CONTEXTS = {"supporting": 3, "distinguishing": 2, "criticizing": 1, "referencing": 0}

RUN = re.compile(r"\d+|[^\W\d_ºª]+|\s+|.", re.S)
MARKS = ("º", "°")
LEADS = ("artigo", "artigos", "art", "arts")


class Spelling:
    """A scanner over the runs of a locator: digits, letters, blanks and single other characters."""

    def __init__(self, text: str) -> None:
        self.runs = RUN.findall(text)
        self.at, self.out = 0, []

    def peek(self, ahead: int = 0) -> str:
        at = self.at + ahead
        return self.runs[at] if at < len(self.runs) else ""

    def blanks(self, ahead: int) -> int:
        """The place of the first run from there that is no blank."""
        return ahead + 1 if self.peek(ahead).isspace() else ahead

    def open(self, ahead: int) -> bool:
        """Whether no word goes on at that place."""
        c = self.peek(ahead)[:1]
        return not (c.isalnum() or c == "_")

    def fresh(self) -> bool:
        """Whether no word runs up to here; an ordinal mark belongs to a word."""
        c = self.out[-1][-1:] if self.out else ""
        return not (c.isalnum() or c == "_")

    def number(self) -> None:
        fresh = self.fresh()
        self.out.append(self.peek())
        ahead = 1
        if self.peek(1) == "-" and len(self.peek(2)) == 1 and self.peek(2).isascii() and self.peek(2).isalpha():
            mark = self.blanks(3)
            marked = self.peek(mark) in MARKS and self.peek(mark + 1) != "."
            if fresh and (marked or self.open(3)):
                self.out.append(".º")  # a suffix stands behind an ordinal mark
            self.out += ["-", self.peek(2)]
            ahead = 3
        mark = self.blanks(ahead)
        if self.peek(mark) in MARKS and self.peek(mark + 1) != ".":
            self.out.append(".º")
            ahead = mark + 1
        self.at += ahead

    def word(self) -> None:
        word = self.peek()
        low = word.lower()
        fresh = self.fresh()
        if fresh and low == "al" and self.peek(1) == ".":
            self.out.append("alínea ")
            self.at += self.blanks(2)
        elif fresh and low in ("alinea", "alineas", "alínea", "alíneas") and self.open(1) and "i" in low[:4]:
            self.out.append("alínea" + word[6:])
            self.at += 1
        elif fresh and low == "n" and (mark := self.blanks(2 if self.peek(1) == "." else 1)) and self.peek(mark) in MARKS:
            many = self.peek(mark + 1) == "s"
            if self.open(mark + 1 + many):
                self.out.append("n.ºs" if many else "n.º")
                self.at += mark + 1 + many
            else:
                self.out.append(word)
                self.at += 1
        else:
            self.out.append(word)
            self.at += 1

    def write(self) -> str:
        first = self.peek().lower()
        dot = self.peek(1) == "." and first in ("art", "arts")
        if first in LEADS and self.peek(1 + dot).isspace():
            self.at = 2 + dot
        while run := self.peek():
            if run[0].isdecimal():
                self.number()
            elif run[0].isalpha() and run not in ("º", "ª"):
                self.word()
            else:
                self.out.append("º" if run in MARKS else " " if run.isspace() else run)
                self.at += 1
        return "".join(self.out)


def spell(text: str) -> str:
    """One spelling of ordinal marks, ``n.º`` and ``alínea``; no leading word "artigo"; single blanks; no marks at the end."""
    return " ".join(Spelling(text.strip()).write().split()).rstrip(" .,;:")


#: The parts of a spelled locator, each with the letter that marks it.
PARTS = {
    "A": r"\d+\.º(?:-[A-Za-z])?",  # an article
    "N": r"(?i:n\.ºs?)",
    "L": r"(?i:al[íi]neas?)(?=\s+\S)",
    "x": r"\b[a-z]\)",
    "X": r"\b[A-Z]\)",
    "i": r"\d+",
    "e": r"\be\b",
    "r": r"\ba\b",
    "c": r",",
    "p": r"[;:]",
    "o": r"[^\s.]",
}
PART = re.compile("|".join(f"(?P<{k}>{v})" for k, v in PARTS.items()))


def _counted(first: int, last: int) -> list[int]:
    return list(range(first, last + 1)) if 0 < last - first < LONGEST else []


def expand_clean(s: str) -> list[str]:
    """The single places that a spelled locator names; what does not parse stays as it is.

    Ranges of more than 21 members are not expanded: of articles the text stays, of
    numbers none is given. Members of a number list that are no plain numbers are left
    out, and so is what follows the word alínea and is no letter.
    """
    if not s:
        return []
    found = [(m.lastgroup or "", m.group()) for m in PART.finditer(s)]
    marks = "".join(k for k, _ in found)
    texts = [t for _, t in found]
    if re.fullmatch("A(?:[ce]A)+", marks):
        return texts[::2]
    if marks == "ArA" and "-" not in s:
        first, last = (int(t[:-2]) for t in texts[::2])
        return [f"{n}.º" for n in _counted(first, last)] or [s]
    if not s.startswith(texts[0]) or marks[0] != "A":
        return [s]
    begin, end = 1, len(marks)
    while begin < end and marks[begin] == "c":
        begin += 1
    letters: list[str] = []
    if (word := marks.find("L", begin)) >= 0:
        letters, end = [t[0] for k, t in found[word:] if k == "x"], word
    elif tail := re.search("c(?P<list>[xX](?:[ce][xX])*)$", marks[begin:]):
        letters = [t[0] for k, t in found[begin + tail.start() :] if k == "x"]
        end = begin + tail.start() if letters else end  # capitals alone belong to the number list, which drops them
    while begin < end and marks[end - 1] == "c":
        end -= 1
    numbers: list[str] = []
    if begin < end:
        if marks[begin] != "N" or begin + 1 == end:
            return [s]
        own = marks[begin + 1 : end].rstrip("cp")
        if own == "iri":
            numbers = [str(n) for n in _counted(int(texts[begin + 1]), int(texts[begin + 3]))]
        else:
            numbers = [texts[begin + 1 + m.start(1)] for m in re.finditer("(?:^|(?<=[ce]))(i)(?=[ce]|$)", own)]
    places = (texts[0] + (f", n.º {n}" if n else "") + (f", alínea {x})" if x else "") for n, x in product(numbers or [""], letters or [""]))
    return list(dict.fromkeys(places))


def _each(values: pd.Series, make, missing):  # noqa: ANN001, ANN202
    """A function of each distinct value, given back in the values' order."""
    codes, distinct = pd.factorize(values)
    found = [make(x) for x in distinct]
    return pd.Series([found[c] if c >= 0 else missing for c in codes], index=values.index, dtype=object)


@F.pandas_udf(T.StringType())
def _spelled(raw: pd.Series) -> pd.Series:
    return _each(raw, spell, None)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _expanded(raw: pd.Series) -> pd.Series:
    return _each(raw, lambda x: expand_clean(spell(x)), [])


def clean_article(raw: Column) -> Column:
    """``spell`` of each value; null stays null."""
    return _spelled(raw)


def expand_articles(raw: Column) -> Column:
    """array<string> of places. Null and blank give an empty array."""
    return _expanded(raw)


def normalized_legislation(citations: DataFrame, keys: list[str], position: str, article: str, law: str, context: str) -> DataFrame:
    """One row per (keys, article, law) with the weightiest context, in order of first appearance.

    Compound articles are expanded first; unknown contexts count as referencing; an empty article stays "".
    Columns: keys, article, law, citation_context, place (from 1).
    """
    ctx = F.lower(F.trim(F.coalesce(F.col(context), F.lit("referencing"))))
    places = expand_articles(F.trim(F.coalesce(F.col(article), F.lit(""))))
    rows = citations.select(*keys, F.col(position).alias("_pos"), law_name(F.trim(F.coalesce(F.col(law), F.lit("")))).alias("law"), F.when(ctx.isin(*CONTEXTS), ctx).otherwise("referencing").alias("_ctx"), places.alias("_places"))
    rows = rows.select(*keys, "_pos", "law", "_ctx", F.posexplode(F.when(F.size("_places") > 0, F.col("_places")).otherwise(F.array(F.lit("")))).alias("_sub", "article"))
    weights = F.create_map(*[F.lit(x) for pair in CONTEXTS.items() for x in pair])
    best = rows.groupBy(*keys, "article", "law").agg(F.max_by("_ctx", weights[F.col("_ctx")]).alias("citation_context"), F.min(F.struct("_pos", "_sub")).alias("_first"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_first"))
    return best.select(*keys, "article", "law", "citation_context", place.alias("place"))
