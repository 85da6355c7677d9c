"""Text functions as Column expressions; Python only where Spark has no built-in."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _translation() -> tuple[str, str]:
    """Characters that decompose to one plain character, and combining marks (dropped)."""
    pairs = {}
    for code in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            pairs[chr(code)] = base
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(pairs) + marks, "".join(pairs.values())


_FROM, _TO = _translation()


def fold(value: Column) -> Column:
    """Without accents; ordinal marks become letters. One-to-one decompositions only, all inside the JVM."""
    return F.translate(value, _FROM, _TO)


def fold_text(value: str) -> str:
    """The exact form of ``fold`` in Python, ligatures and fractions included."""
    return "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c))


@F.pandas_udf(T.StringType())
def fold_exact(value: pd.Series) -> pd.Series:
    return value.map(fold_text, na_action="ignore")


def keywords(raw: Column) -> Column:
    """Comma-joined plain phrases of two to six words, in order, without repeats; null if none is left.

    A list without commas that has line ends is split on those.
    """
    by_comma = F.split(raw, ",", -1)
    parts = F.when((F.size(by_comma) == 1) & F.contains(raw, F.lit("\n")), F.split(raw, "\r\n|[\n\r\u000b\f\u001c-\u001e\u0085  ]", -1)).otherwise(by_comma)
    plain = F.transform(parts, lambda p: F.trim(F.regexp_replace(F.regexp_replace(F.lower(fold(p)), "[^a-z0-9 ]", " "), " +", " ")))
    kept = F.filter(plain, lambda p: (p != "") & F.size(F.split(p, " ")).between(2, 6))
    return F.nullif(F.array_join(F.array_distinct(kept), ", "), F.lit(""))


# Abbreviations of laws and their full names.
LAW_NAMES = {
    "cc": "Código Civil",
    "c.c.": "Código Civil",
    "cod. civil": "Código Civil",
    "cpc": "Código de Processo Civil",
    "ncpc": "Código de Processo Civil",
    "novo cpc": "Código de Processo Civil",
    "cp": "Código Penal",
    "cpp": "Código de Processo Penal",
    "ct": "Código do Trabalho",
    "cpt": "Código de Processo do Trabalho",
    "csc": "Código das Sociedades Comerciais",
    "crp": "Constituição da República Portuguesa",
    "c.r.p.": "Constituição da República Portuguesa",
    "cpa": "Código do Procedimento Administrativo",
    "cpta": "Código de Processo nos Tribunais Administrativos",
    "ccp": "Código dos Contratos Públicos",
    "rcp": "Regulamento das Custas Processuais",
}
#: How the kinds of numbered acts that get one spelling are written in front of the number.
ACTS = {"decreto-lei": "Decreto-Lei", "decreto lei": "Decreto-Lei", "decretolei": "Decreto-Lei", "dl": "Decreto-Lei", "lei": "Lei"}
DIGITS, A_WORD = "(?U)^\\d+$", "(?U)^\\w+$"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def without_promulgation(name: Column) -> Column:
    """A name without the date at its end: behind the last comma the words de, a number, de, a word, and maybe de and a number."""

    def cut(parts: Column) -> Column:
        words = F.split(F.regexp_replace(F.lower(F.element_at(parts, -1)), "(?U)^\\s+|\\s+$", ""), "(?U)\\s+")
        at = lambda w, i: F.get(w, F.lit(i))
        dated = lambda w: (
            (at(w, 0) == "de") & at(w, 1).rlike(DIGITS) & (at(w, 2) == "de") & at(w, 3).rlike(A_WORD)
            & ((F.size(w) == 4) | (F.size(w) == 6) & (at(w, 4) == "de") & at(w, 5).rlike(DIGITS))
        )
        rest = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), ",")
        return F.when((F.size(parts) > 1) & bound(words, dated), rest).otherwise(F.array_join(parts, ","))

    return bound(F.split(name, ",", -1), cut)


def law_name(raw: Column) -> Column:
    """Abbreviations spelled out, decree-laws and laws as ``Lei n.º X/Y``, anything else without its date.

    A numbered act is a known kind, maybe a number mark (n and any of ° º . and blanks), and then number/year.
    """
    names = F.create_map(*[F.lit(x) for pair in LAW_NAMES.items() for x in pair])
    kinds = F.create_map(*[F.lit(x) for pair in ACTS.items() for x in pair])

    def act(s: Column) -> Column:
        word = F.regexp_replace(F.lower(F.regexp_extract(s, "^(\\D*)\\d", 1)), "(?U)\\s", " ")
        kind = bound(word, lambda w: F.coalesce(kinds[F.rtrim(w)], kinds[F.rtrim(F.regexp_replace(w, "n[°º. ]*$", ""))]))
        number = F.nullif(F.regexp_extract(s, "^\\D*(\\d+(?:-[A-Za-z])?/\\d+)", 1), F.lit(""))
        return F.concat(kind, F.lit(" n.º "), number)  # null unless both are there

    def name(s: Column) -> Column:
        return F.coalesce(bound(F.trim(F.lower(s)), lambda low: F.coalesce(names[low], names[F.btrim(low, F.lit(". "))])), act(s), s)

    return F.when(raw == "", raw).otherwise(bound(without_promulgation(F.trim(raw)), name))


# Fixed value: the words by which a label names a decision that unifies case law, without accents (one spelling error of the source included).
UNIFIES = r"unifor[a-z]{0,6}zacao|fixacao\s+de\s+jurispr|fixar\s+jurispr|uniformizador"


def unifies_case_law(*labels: Column) -> Column:
    """Whether any label names a decision that unifies case law; null labels count as no."""
    hit = F.lit(False)
    for label in labels:
        hit = hit | F.coalesce(F.lower(fold(label)).rlike(UNIFIES), F.lit(False))
    return hit


# Phrases by which a decision states a thesis for all courts, without accents.
THESIS = r"fixa-se a seguinte jurisprudencia|fixa jurisprudencia|uniformiza(?:-se)? (?:a )?jurisprudencia|acordao uniformizador"


def states_thesis(*texts: Column) -> Column:
    """Whether any of the texts states a thesis; null texts count as no."""
    return F.coalesce(F.lower(fold(F.concat_ws(" ", *texts))).rlike(THESIS), F.lit(False))


def iso_date(raw: Column) -> Column:
    """ISO, MM/DD/YYYY or DD-MM-YYYY; the first shape that fits decides, impossible dates are null."""
    s = F.trim(raw)
    shaped = lambda shape, form: F.when(s.rlike(shape), F.try_to_timestamp(s, F.lit(form)).cast("date"))
    return F.coalesce(shaped(r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), shaped(r"^\d{2}/\d{2}/\d{4}$", "MM/dd/yyyy"), shaped(r"^\d{2}-\d{2}-\d{4}$", "dd-MM-yyyy"))


def any_date(raw: Column) -> Column:
    """ISO, then DD/MM/YYYY, then DD-MM-YYYY: the reading of the quality reports."""
    s = F.trim(raw)
    read = [F.when(s.rlike(shape), F.try_to_timestamp(s, F.lit(form)).cast("date")) for shape, form in ((r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"))]
    return F.coalesce(*read)


def filled(value: Column) -> Column:
    """Null for the empty string."""
    return F.nullif(value, F.lit(""))


def embedding_texts(query: Column, question: Column, summary: Column, ratio: Column, outcome: Column, most: int = 12_000) -> dict[str, Column]:
    """The three texts to embed, cut to ``most`` characters; parts that are missing or empty are left out."""
    join = lambda *parts: F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), "\n\n")
    return {
        "embedding": F.left(F.coalesce(filled(query), filled(summary), F.lit("")), F.lit(most)),
        "embedding_context": F.left(join(query, question, summary), F.lit(most)),
        "embedding_ratio": F.left(join(ratio, outcome), F.lit(most)),
    }


def doc_id_of(url: Column) -> Column:
    """The last path part of a URL, before any query, slashes at the end ignored."""
    return F.split_part(F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1), F.lit("?"), F.lit(1))


def linked_ids(html: Column) -> Column:
    """Distinct document ids named by a listing page, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit("/([a-f0-9]{32})\\?OpenDocument"), F.lit(1)))


def vector_of(text: Column, dim: int) -> Column:
    """A vector from its text form ``[a,b]``; null unless it has ``dim`` numbers."""
    v = F.try_cast(F.split(F.regexp_replace(text, "^\\s*\\[|\\]\\s*$", ""), ","), "array<float>") if hasattr(F, "try_cast") else F.split(F.regexp_replace(text, "^\\s*\\[|\\]\\s*$", ""), ",").try_cast("array<float>")
    return F.when((F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull()), v)


def json_reply(raw: Column) -> Column:
    """A model's reply without code fences and language tag."""
    s = F.trim(raw)
    inner = F.regexp_extract(s, r"(?s)^```(?:json)?\s*(.*?)\s*(?:```)?$", 1)
    return F.when(s.startswith("```"), inner).otherwise(s)


def header_field(text: Column, key: str, within: int = 4000) -> Column:
    """The lines under ``key:`` up to the next line that is a label, within the page head; null if absent."""
    head = F.regexp_replace(F.left(text, F.lit(within)), "\\r\\n?", "\n")
    found = F.regexp_extract(head, rf"(?s)(?:^|\n){re.escape(key)}:?[ \t]*\n(.*?)(?=\n[^\n]{{1,60}}:[ \t]*(?:\n|$)|$)", 1)
    return filled(F.trim(found))


def human_size(n: Column) -> Column:
    """Bytes with a unit: 1023 -> 1023.0 B, 1536 -> 1.5 KB; exact halves go to the even digit."""
    shown = lambda power, unit: F.format_string(f"%.1f {unit}", F.bround(n / float(1 << power), 1))
    out = shown(40, "TB")
    for power, unit in ((30, "GB"), (20, "MB"), (10, "KB"), (0, "B")):
        out = F.when(n < float(1 << (power + 10)), shown(power, unit)).otherwise(out)
    return out


def human_duration(seconds: Column) -> Column:
    """h:mm:ss."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def truthy(value: Column, kind: str) -> Column:
    """Not null, empty, false or zero."""
    if kind.startswith("array"):
        return F.coalesce(F.size(value) > 0, F.lit(False)) & value.isNotNull()
    if kind == "string":
        return F.coalesce(value != "", F.lit(False))
    if kind in ("boolean", "bool"):
        return F.coalesce(value, F.lit(False))
    if kind.startswith("struct"):
        return value.isNotNull()
    return F.coalesce(value != 0, F.lit(False))


def present(value: Column, kind: str) -> Column:
    """Not null, "" or an empty list; false and zero count as present."""
    return truthy(value, kind) if kind == "string" or kind.startswith("array") else value.isNotNull()


def not_blank(value: Column, kind: str) -> Column:
    """As present, and strings must hold more than white space."""
    return F.coalesce(value.rlike("(?U)\\S"), F.lit(False)) if kind == "string" else present(value, kind)
