"""Free-typed values mapped to the entries of a reference list.

A multi-pattern automaton over the entries' names, their usual variants and short
forms finds mentions inside a value; the longest that do not overlap win. A numbered
entry is meant only where kind, number and year all agree. Values without a mention
go to token-set similarity, which forgives misspellings. The rest mean no entry.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import Counter
from dataclasses import dataclass, field
from operator import itemgetter

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.words import fold, repair

# How the kinds of numbered acts, and the first words of named ones, are written.
KINDS = {
    "Lei": ("lei", "l"),
    "Decreto-Lei": ("decreto lei", "dec lei", "d lei", "decreto l", "dl"),
    "Decreto Regulamentar": ("decreto regulamentar", "dec regulamentar", "d regulamentar", "decreto reg", "dec reg", "d reg", "dr"),
    "Portaria": ("portaria", "port"),
}
OPENINGS = {"codigo": ("codigo", "cod", "c"), "estatuto": ("estatuto", "est"), "regulamento": ("regulamento", "regul", "reg", "rego", "reg o"), "regime": ("regime", "reg", "rego", "reg o")}
FILLERS = frozenset("de da do das dos e a o as os em no na nos nas sobre ao aos".split())
# Words that stand around a name and do not count against a likeness.
AROUND = FILLERS | frozenset(
    "novo nova actual atual antigo antiga artigo artigos art arts numero num ao abrigo nos termos disposto versao consolidada redacao dada aprovado aprovada por pelo pela lei especial cit citado citada referido referida doravante vigente vigor "
    "revisto alterado rectificado rectificada conforme segundo presente janeiro fevereiro marco abril maio junho julho agosto setembro outubro novembro dezembro".split()
)
#: Two-digit years from here on belong to the last century, the others to this one up to YOUNGEST.
OLDEST, YOUNGEST = 79, 24

NUMBER_MARK = re.compile(r"\b(?:n\s*\.?\s*[o°]s?|num(?:ero)?s?|nr|n)\s*\.?\s*(?=\d)")
ACT_NUMBER = re.compile(r"(?<!\d)0*(\d+)\s*(?:[-‐-―−]\s*([a-z])(?![a-z]))?\s*(?:/|\bde\b)\s*(\d{4}|\d{2})(?!\d)")
NEXT_WORD = re.compile(r"\s*(\S+)")
INITIALS = re.compile(r"\b[a-z]\.(?:\s?[a-z]\.)*\s?[a-z]\b\.?")


def _act(m: re.Match[str]) -> str:
    year = m[3]
    if len(year) == 2:
        y = int(year)
        year = f"19{year}" if y >= OLDEST else f"20{year}" if y <= YOUNGEST else f"00{year}"
    return f" {m[1]}{m[2] or ''}/{year} "


def normal(text: str) -> str:
    """Lower-case words and act numbers ("379b/1993") between single blanks, with a blank at each end."""
    s = NUMBER_MARK.sub(" ", fold(repair(text)))
    s = ACT_NUMBER.sub(_act, s)
    s = INITIALS.sub(lambda m: " " + re.sub(r"[.\s]", "", m.group()) + " ", s)
    s = re.sub(r"/(?!\d{4}\b)|[^a-z0-9/]+", " ", s)
    return f" {' '.join(s.split())} "


def distance(a: str, b: str) -> int:
    """Edits from a to b: insert, delete, replace, or swap two letters, also where letters were put or lost between them."""
    far = len(a) + len(b)
    row: dict[str, int] = {}  # the last row in which a letter of a was seen
    cost = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        cost[i + 1][1] = i
    for j in range(len(b) + 1):
        cost[1][j + 1] = j
    for i, x in enumerate(a, 1):
        seen = 0
        for j, y in enumerate(b, 1):
            k, m = row.get(y, 0), seen
            if x == y:
                seen = j
            cost[i + 1][j + 1] = min(cost[i][j] + (x != y), cost[i + 1][j] + 1, cost[i][j + 1] + 1, cost[k][m] + (i - k - 1) + 1 + (j - m - 1))
        row[x] = i
    return cost[-1][-1]


def alike(a: str, b: str, least: float) -> float:
    """1 - edits / length, or 0 where that is under ``least``."""
    if a == b:
        return 1.0
    size = max(len(a), len(b))
    most = int(size * (1 - least) + 1e-9)
    if abs(len(a) - len(b)) > most or size - sum(min(a.count(c), b.count(c)) for c in set(a)) > most:
        return 0.0
    d = distance(a, b)
    return 1 - d / size if d <= most else 0.0


def _letters(words: list[str]) -> np.ndarray:
    """How often each of 64 classes of letters occurs in each word."""
    out = np.zeros((len(words), 64), np.uint8)
    for i, w in enumerate(words):
        for c in w[:255]:
            out[i, ord(c) & 63] += 1
    return out


@dataclass
class Gazetteer:
    """Entries (id, name, short form, kind, year) and the automaton over their variants, built once per process."""

    entries: list[tuple[int, str, str | None, str | None, int | None]]
    token_least: float = 0.7
    whole_least: float = 0.88
    loose_least: float = 0.6
    share_least: float = 0.86
    _made: dict = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": {}}

    def _make(self) -> dict:
        auto, names = ahocorasick.Automaton(), []
        acts: dict[tuple[str | None, str], int] = {}
        patterns: dict[str, tuple[str, object]] = {f" {alias} ": ("kind", kind) for kind, aliases in KINDS.items() for alias in aliases}
        clashes: dict[str, set[int]] = {}

        def put(pattern: str, what: str, key: int) -> None:
            held = patterns.setdefault(pattern, (what, key))
            if held[1] != key:
                clashes.setdefault(pattern.strip(), {key}).update([held[1]] if isinstance(held[1], int) else [])

        for key, name, short, kind, year in self.entries:
            tokens = normal(name).split()
            number = next((t for t in tokens if "/" in t), None)
            if year is not None and number:
                if acts.setdefault((kind, number), key) != key:
                    clashes.setdefault(f"{kind} {number}", {key}).add(acts[(kind, number)])
                continue
            if not tokens:
                continue
            content = [t for t in tokens if t not in FILLERS]
            names.append((key, tokens, content))
            link = tokens[1:2] if tokens[1:2] and tokens[1] in FILLERS else []
            rest = tokens[1 + len(link) :]
            for first in OPENINGS.get(tokens[0], (tokens[0],)):
                for variant in ([first, *link, *rest], [first, *[t for t in rest if t not in FILLERS]], [*rest, first, *link], [*rest, first]):
                    put(f" {' '.join(variant)} ", "name", key)
            if short and fold(short).strip():
                put(f" {fold(short)} ", "short", key)
        for pattern, what in patterns.items():
            auto.add_word(pattern, (len(pattern), what))
        auto.make_automaton()
        vocabulary = sorted({t for _, _, content in names for t in content})
        lists: dict[str, list[int]] = {}  # the entries, by place in names, that need a word
        for at, (_, _, content) in enumerate(names):
            for t in set(content):
                lists.setdefault(t, []).append(at)
        return {
            "auto": auto, "acts": acts, "names": names, "words": frozenset(vocabulary), "near": {}, "lists": lists, "clashes": clashes,
            "spelled": np.array(vocabulary, object), "sizes": np.array([len(v) for v in vocabulary], np.int32), "letters": _letters(vocabulary),
        }

    def clashes(self) -> list[tuple[str, list[int]]]:
        """(way of writing, ids) that entries share; a value that uses one is given the lowest of the ids, as entries come in order."""
        if not self._made:
            self._made.update(self._make())
        return sorted((k, sorted(v)) for k, v in self._made["clashes"].items())

    def mentions(self, s: str) -> list[tuple[int, int, str, object]]:
        """Longest mentions that do not overlap, in order."""
        hits = sorted(((end - size + 1, end, what) for end, (size, what) in self._made["auto"].iter(s)), key=lambda h: (h[0] - h[1], h[0]))
        taken: list[tuple[int, int, str, object]] = []  # in order, so that only neighbours can overlap
        for start, end, what in hits:
            at = bisect(taken, start, key=itemgetter(0))
            if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or end <= taken[at][0]):  # blanks may be shared
                taken.insert(at, (start, end, *what))
        return taken

    def find(self, text: str | None) -> int:
        """The entry meant, 0 for none. Null and blank mean none."""
        if not text or not text.strip():
            return 0
        if not self._made:
            self._made.update(self._make())
        s = normal(text)
        found = self.mentions(s)
        names = [(a - b, a, what) for a, b, kind, what in found if kind == "name"]
        if names:
            return min(names)[2]
        for a, b, kind, what in found:
            if kind == "kind":
                following = NEXT_WORD.match(s, b)
                if following and "/" in following[1]:
                    return self._made["acts"].get((what, following[1]), 0)
        shorts = [what for _, _, kind, what in found if kind == "short"]
        return shorts[0] if shorts else self.similar(s)

    def _near(self, token: str) -> dict[str, float]:
        """The vocabulary words that are alike by ``loose_least``; lengths and letters in common rule most of them out at once."""
        memo, made = self._made["near"], self._made
        if token not in memo:
            if len(memo) > 200_000:
                memo.clear()
            longer = np.maximum(made["sizes"], len(token))
            most = (longer * (1 - self.loose_least) + 1e-9).astype(np.int32)
            common = np.minimum(made["letters"], _letters([token])).sum(1)  # letters of one class count together: never too few
            some = np.flatnonzero((np.abs(made["sizes"] - len(token)) <= most) & (longer - common <= most))
            memo[token] = {v: x for v in made["spelled"][some] if (x := alike(token, v, self.loose_least))}
        return memo[token]

    def _candidates(self, near: list[dict[str, float]]) -> list[int]:
        """The places of the entries of which every content word has a like one, counted by the words' lists of entries."""
        counted = Counter(at for v in {v for sims in near for v in sims} for at in self._made["lists"][v])
        return sorted(at for at, n in counted.items() if n == len(set(self._made["names"][at][2])))

    def similar(self, s: str) -> int:
        """Token-set similarity: every content word of the entry has its own like word in the value.

        The words must be alike by ``token_least``, and the shared part of both word sets, without words that usually
        stand around a name, must reach ``share_least``, so that a further word makes another name; or they are alike by
        ``loose_least`` and the whole strings by ``whole_least``. The largest share wins, ties go to the lower id.
        An entry of link words only is found by its name alone.
        """
        own = self._made["words"]
        tokens = list(dict.fromkeys(t for t in s.split() if t in own or t not in AROUND and not t.isdigit()))
        near = [self._near(t) for t in tokens]
        best = (0.0, 0)
        for at in self._candidates(near):
            key, full, content = self._made["names"][at]
            links = sorted(((sims[c], i, j) for j, c in enumerate(content) for i, sims in enumerate(near) if c in sims), reverse=True)
            used_i, used_j, total, weakest = set(), set(), 0.0, 1.0
            for x, i, j in links:
                if i not in used_i and j not in used_j:
                    used_i.add(i)
                    used_j.add(j)
                    total += x * (len(content[j]) + len(tokens[i]))
                    weakest = min(weakest, x)
            if len(used_j) < len(content):
                continue
            # short leftovers are broken link words ("deP rocesso")
            score = total / (sum(map(len, content)) + sum(len(t) for i, t in enumerate(tokens) if len(t) > 3 or i in used_i))
            if (score < self.share_least or weakest < self.token_least) and not alike("".join(s.split()), "".join(full), self.whole_least):
                continue
            if (score, -key) > (best[0], -best[1] if best[1] else float("-inf")):
                best = (score, key)
        return best[1]


def gazetteer(entries: DataFrame, *, key: str, name: str, short: str, kind: str, year: str, most: int = 100_000) -> Gazetteer:
    """The reference list, which must be small: more than ``most`` entries are refused. Nameless entries are left out."""
    rows = entries.select(key, name, short, kind, year).where(F.col(name).isNotNull() & F.col(key).isNotNull()).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the reference list has more than {most} entries")
    return Gazetteer(sorted(tuple(r) for r in rows))


def canonical(value: Column, names: Gazetteer) -> Column:
    """The id of the entry that the value means, 0 for none (also for null and blank)."""

    @F.pandas_udf("bigint")
    def find(x: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(x, use_na_sentinel=True)
        ids = [names.find(v) for v in distinct]
        return pd.Series([ids[c] if c >= 0 else 0 for c in codes], index=x.index, dtype="int64")

    return find(value)
