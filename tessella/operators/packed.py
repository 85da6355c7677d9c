"""Several values packed in one field: one row per value with its position.

Whatever must stay whole is first put aside under an indexed placeholder of characters
that the text lacks: quoted spans, and in article locators also groups of numbers and of
letters, whose own delimiters don't separate articles. The rest is split, placeholders are
looked up again by their index, and values are exploded with their positions.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUOTED = re.compile(r'"(?:[^"]|"")*"|«[^«»]*»|“[^“”]*”')
MARK = re.compile(r"^\s*(?:[-–—*•·▪◦]+\s+|\(?\d{1,3}[.)]\s+|[•·▪◦]+\s*)+")
LONE_MARK = re.compile(r"[-–—*•]+")
PRIVATE = (0xE000, 0xF8FF)


class Held:
    """Spans put aside, each under an indexed placeholder that can't be part of the text."""

    def __init__(self, text: str) -> None:
        self.open, self.close = markers(text)
        self.spans: list[str] = []
        self.mark = f"{self.open}(\\d+){self.close}"

    def put(self, m: re.Match[str]) -> str:
        self.spans.append(m.group())
        return f"{self.open}{len(self.spans) - 1}{self.close}"

    def restore(self, piece: str) -> str:
        return re.sub(self.mark, lambda m: self.spans[int(m[1])], piece)


def markers(text: str) -> tuple[str, str]:
    """Two private-use characters that the text does not contain."""
    found = list(islice((chr(c) for c in range(*PRIVATE) if chr(c) not in text), 2))
    if len(found) < 2:
        raise ValueError("the text holds every private-use character")
    return found[0], found[1]


def unquote(span: str) -> str:
    inner = span[1:-1]
    return inner.replace('""', '"') if span[0] == '"' else inner


def split_phrases(text: str | None) -> list[str]:
    """The phrases of a free-typed list, as written, without list marks, enclosing quotes and outer blanks.

    Quoted spans are first replaced by indexed placeholders made of characters that the
    text does not hold, so that a separator inside them does not separate. Then ; | • tab
    and line end separate anywhere, a comma unless between digits, and a slash only next to
    a blank or a quoted span ("e/ou" and "12/2010" stay whole). Null and blank give [].
    """
    if not text or not text.strip():
        return []
    held = Held(text)
    rest = QUOTED.sub(held.put, text)
    whole = re.compile(held.mark)
    pieces = re.split(rf"[;|•\t\r\n\v\f\x85\u2028\u2029]|(?<!\d),|,(?!\d)|(?<=\s)/|/(?=\s)|(?<={held.close})/(?={held.open})", rest)
    out = []
    for piece in pieces:
        piece = MARK.sub("", piece).strip()
        if m := whole.fullmatch(piece):
            piece = unquote(held.spans[int(m[1])]).strip()
        elif LONE_MARK.fullmatch(piece):
            continue
        else:
            piece = held.restore(piece).strip()
        if piece:
            out.append(piece)
    return out


# the parts of a locator: words that announce an article, a number or a letter, ordinal marks, ranges
ARTICLE = r"(?:\bart(?:igo)?s?\b\.?\s*(?:[ºª°]\s*s?\b\.?)?|\bart[ºª°]\s*s?\.?)"
NUMBER = r"(?:\bn\s*\.?\s*(?:[ºª°o]s\b|[ºª°]\s*s\b)\.?|\bn[uú]m(?:ero)?s\b\.?|\bn\s*\.?\s*[ºª°o]\b\.?|\bn\s*\.?\s*[ºª°]\.?|\bn[uú]m(?:ero)?\b\.?|\bnr?s?\.(?=\s*\d))"
PLURAL = re.compile(r"(?:[ºª°o]\s*s|(?:m|o)s)\b\.?\s*$", re.I)
LETTERS = r"(?:\bal[ií]neas?\b|\bal\.?[ªº]?s?\b\.?|\bals\.?)"
ORDINAL = r"(?:\s*\.?\s*[ºª°]|\.?o\b)"
SUFFIX = r"(?:\s*-\s*[A-Z](?![\w)]))"
RANGE = r"(?:\ba\b(?!\s*\))|\bat[ée]\b|[-–—−])"
BETWEEN = rf"\s*(?:(?:[,;|+&/\n\r]|\be\b|{RANGE})\s*)+"
PLAIN = rf"\d++(?!{ORDINAL}){SUFFIX}?"
LETTER = r"\b[a-z]\s*\)"
#: A group keeps its own delimiters: numbers behind their word or a tight slash, and letters.
GROUP = re.compile(
    rf"(?:{NUMBER}\s*\d++{ORDINAL}?{SUFFIX}?|(?<=\S)/{PLAIN})(?:{BETWEEN}(?:{NUMBER}\s*\d++{ORDINAL}?{SUFFIX}?|{PLAIN}))*|(?:{LETTERS}\s*)?{LETTER}(?:{BETWEEN}(?:{LETTERS}\s*)?{LETTER})*",
    re.I,
)
MEMBER = re.compile(rf"(?P<word>{NUMBER})|(?P<letter>{LETTER})|(?P<value>\d++)(?P<ord>{ORDINAL})?(?P<suffix>{SUFFIX})?|(?P<range>{RANGE})|(?P<slash>/)", re.I)
DELIMITER = re.compile(r'(["«»“”])|[,;|+&/\n\r]|\be\b', re.I)
#: Numbers of more digits are no ends of a range: the ends then stand as two values.
DIGITS = 15


@dataclass
class Place:
    """An article or a number, or all from ``first`` to ``last``, with what stands below it."""

    first: str
    last: str = ""
    suffix: str = ""
    numbers: list[Place] = field(default_factory=list)
    letters: list[str] = field(default_factory=list)


def _ranges(start: str, end: str) -> bool:
    return start.isdigit() and len(start) <= DIGITS and len(end) <= DIGITS and int(start) < int(end)


class Locators:
    """The articles named so far; a piece without an article of its own goes on below the last one."""

    def __init__(self) -> None:
        self.articles: list[Place] = []
        self.many, self.since, self.below = False, 0, "article"

    def piece(self, text: str, held: Held) -> None:
        end = 0
        for m in re.finditer(rf"{held.mark}|(?P<art>{ARTICLE})?\s*(?P<value>\d++)(?P<ord>{ORDINAL})?(?P<suffix>{SUFFIX})?", text, re.I):
            between, end = text[end : m.start()], m.end()
            if m[1]:
                span = held.spans[int(m[1])]
                if QUOTED.fullmatch(span):
                    self.below, self.many = "article", False
                    self.read(unquote(span))
                    self.below, self.many = "article", False
                else:
                    self.group(span)
                continue
            suffix = (m["suffix"] or "").strip(" -").upper()
            if not m["art"] and not m["ord"] and self.below != "article" and self.articles[-1].numbers:
                self.number(m["value"], suffix, False)
            else:
                self.article(m["value"], suffix, not m["art"] and bool(re.search(RANGE, between, re.I)))

    def read(self, text: str) -> None:
        held = Held(text)
        rest = GROUP.sub(held.put, QUOTED.sub(held.put, text))
        for part in DELIMITER.split(rest):
            if part in ('"', "«", "»", "“", "”"):
                self.below, self.many = "article", False
            elif part:
                self.piece(part, held)

    def article(self, value: str, suffix: str, ranging: bool) -> None:
        value, before = value.lstrip("0") or "0", self.articles[-1] if self.articles else None
        if ranging and before and before.last in ("", before.first):
            if before.first == value and suffix:
                self.articles += [Place(value, suffix=chr(x)) for x in range(ord(before.suffix) + 1 if before.suffix else ord("A"), ord(suffix))]
            elif _ranges(before.first, value) and int(value) - int(before.first) > 1:
                self.articles.append(Place(str(int(before.first) + 1), str(int(value) - 1)))
        self.articles.append(Place(value, suffix=suffix))
        self.many, self.since, self.below = False, 0, "article"

    def number(self, value: str, suffix: str, ranging: bool) -> None:
        own = self.articles[-1].numbers
        value = value.lstrip("0") or "0"
        if ranging and own and not own[-1].suffix and not suffix and _ranges(own[-1].first, value):
            if int(value) - int(own[-1].first) > 1:
                own.append(Place(str(int(own[-1].first) + 1), str(int(value) - 1)))
        own.append(Place(value, suffix=suffix))
        self.below = "number"

    def letter(self, new: str, ranging: bool) -> None:
        last = self.articles[-1]
        places = (last.numbers[self.since :] if self.many else last.numbers[-1:]) if last.numbers else [last]
        for own in (p.letters for p in places):
            own.extend(map(chr, range(ord(own[-1]) + 1, ord(new) + 1)) if ranging and own and own[-1] < new else [new])
        self.below = "letter"

    def group(self, span: str) -> None:
        if span.startswith("/") and self.below == "article" and self.articles:
            self.many, self.since = False, len(self.articles[-1].numbers)
        ranging = False
        for m in MEMBER.finditer(span):
            if m["word"]:
                self.many = bool(PLURAL.search(m["word"]))
                if self.articles and (self.below != "number" or self.many):
                    self.since = len(self.articles[-1].numbers)
                if self.articles:
                    self.below = "number"
            elif m["letter"]:
                if self.articles:
                    self.letter(m["letter"][0].lower(), ranging)
                ranging = False
            elif m["value"]:
                suffix = (m["suffix"] or "").strip(" -").upper()
                if self.articles:
                    self.number(m["value"], suffix, ranging)
                else:  # a number below no article is taken for one
                    self.article(m["value"], suffix, False)
                ranging = False
            else:
                ranging = bool(m["range"])

    def specs(self) -> list[tuple[str, int | None, int | None, list[str], int]]:
        """(head, first, last, tails, base): the values are head, each number from first to last, each tail; base values come before."""
        out: list[tuple[str, int | None, int | None, list[str], int]] = []
        base = 0

        def add(head: str, place: Place, mark: str, tails: list[str]) -> None:
            nonlocal base
            if place.last:
                first, last = int(place.first), int(place.last)
                out.append((head, first, last, [mark + t for t in tails], base))
                base += (last - first + 1) * len(tails)
            else:
                out.append((head + place.first, None, None, [mark + (f"-{place.suffix}" if place.suffix else "") + t for t in tails], base))
                base += len(tails)

        letters = lambda p: [f", alínea {x})" for x in p.letters] or [""]
        for article in self.articles:
            if not article.numbers:
                add("", article, ".º", letters(article))
            for n in article.numbers:
                add(f"{article.first}.º{f'-{article.suffix}' if article.suffix else ''}, n.º ", n, "", letters(n))
        return out


def locators(text: str | None) -> list[tuple[str, int | None, int | None, list[str], int]]:
    """Every place that a free-typed article field names, with ranges as (head, first, last, tails, base).

    Items at one level share what stands before them; letters after a list opened by a plural mark hold for the
    whole list. Null, blank and texts without a number give [].
    """
    if not text or not any(c.isdigit() for c in text):
        return []
    found = Locators()
    found.read(text)
    return found.specs()


def members(specs: list[tuple[str, int | None, int | None, list[str], int]]) -> list[str]:
    """The values that specs stand for, in order, as the JVM expands them."""
    return [f"{head}{'' if first is None else n}{t}" for head, first, last, tails, _ in specs for n in (range(first, last + 1) if first is not None and last is not None else [0]) for t in tails]


def split_locators(text: str | None) -> list[str]:
    """Every place that a free-typed article field names, as ``A.º[-X][, n.º N][, alínea l)]``; a range gives all its members."""
    return members(locators(text))


def _source(records: DataFrame, key: Column, value: Column) -> DataFrame:
    return records.select(key.cast("string").alias("rec_key"), value.alias("v")).where("rec_key is not null and trim(v) <> ''")


def _each(x: pd.Series, split: Callable[[str], list]) -> pd.Series:
    """``split`` of every value, worked out once for each distinct one; nulls give []."""
    codes, distinct = pd.factorize(x, use_na_sentinel=True)
    found = [split(v) for v in distinct]
    return pd.Series([found[c] if c >= 0 else [] for c in codes], index=x.index, dtype=object)


def unpack(records: DataFrame, field_name: str, key: Column, value: Column, split: Callable[[str | None], list[str]], *, least: int = 2) -> DataFrame:
    """(field_name, rec_key, val_pos, val): one row for each value of a field that holds ``least`` or more.

    A record delivered several times gives its rows once: (rec_key, val_pos, val) are distinct.
    Null keys or values give nothing; an empty table gives an empty result.
    """

    @F.pandas_udf("array<string>")
    def values(x: pd.Series) -> pd.Series:
        return _each(x, lambda v: r if len(r := split(v)) >= least else [])

    rows = _source(records, key, value).select("rec_key", F.posexplode(values("v")).alias("pos", "val"))
    return rows.select(F.lit(field_name).alias("field_name"), "rec_key", (F.col("pos") + 1).alias("val_pos"), "val").distinct()


SPEC = "array<struct<head:string,first:bigint,last:bigint,tails:array<string>,base:bigint>>"


def unpack_ranges(records: DataFrame, field_name: str, key: Column, value: Column, split: Callable[[str | None], list[tuple]] = locators, *, least: int = 2, block: int = 1024) -> DataFrame:
    """As ``unpack`` for values given as ranges: Python hands over the ends, and the JVM makes the members, ``block`` at a time, so that none is lost however long a range is."""

    @F.pandas_udf(SPEC)
    def specs(x: pd.Series) -> pd.Series:
        def enough(v: str) -> list[dict]:
            found = split(v)
            n = found[-1][4] + len(found[-1][3]) * (1 if found[-1][1] is None else found[-1][2] - found[-1][1] + 1) if found else 0
            return [dict(zip(("head", "first", "last", "tails", "base"), s, strict=True)) for s in found] if n >= least else []

        return _each(x, enough)

    rows = _source(records, key, value).select("rec_key", F.explode(specs("v")).alias("s")).select("rec_key", "s.*")
    size = F.coalesce(F.col("last") - F.col("first"), F.lit(0).cast("bigint"))
    blocks = rows.withColumn("_size", size).withColumn("_at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_size"), F.lit(block).cast("bigint"))))
    each = blocks.withColumn("_n", F.explode(F.sequence(F.col("_at"), F.least(F.col("_size"), F.col("_at") + (block - 1)))))
    number = F.coalesce((F.col("first") + F.col("_n")).cast("string"), F.lit(""))
    out = each.select("rec_key", (F.col("base") + F.col("_n") * F.size("tails")).alias("_from"), F.concat("head", number).alias("_start"), F.posexplode("tails").alias("_t", "_tail"))
    return out.select(F.lit(field_name).alias("field_name"), "rec_key", (F.col("_from") + F.col("_t") + 1).cast("int").alias("val_pos"), F.concat("_start", "_tail").alias("val")).distinct()
