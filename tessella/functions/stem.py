"""The published Snowball stemmer for Portuguese, for text without accents folded away later."""

from __future__ import annotations

VOWELS = "aeiouáéíóúâêô"
# The suffix lists of the published algorithm.
STANDARD = (
    ("eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância", ""),
    ("logia logias", "log"),
    ("uça~o uço~es", "u"),
    ("ência ências", "ente"),
)
VERBS = (
    "ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem "
    "ado ido ando endo indo ara~o era~o ira~o ar er ir as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes "
    "is ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos "
    "aremos eremos iremos ássemos êssemos íssemos imos armos ermos irmos eu iu ou ira iras"
)
_ORDERED_VERBS = sorted(VERBS.split(), key=len, reverse=True)
_ORDERED_STANDARD = sorted(((s, by) for group, by in STANDARD for s in group.split()), key=lambda x: -len(x[0]))


def _after(word: str, start: int) -> int:
    """The place after the first non-vowel that follows a vowel."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _rv(word: str) -> int:
    if len(word) < 3:
        return len(word)
    if word[1] not in VOWELS:
        return next((i + 1 for i in range(2, len(word)) if word[i] in VOWELS), len(word))
    if word[0] in VOWELS:
        return next((i + 1 for i in range(2, len(word)) if word[i] not in VOWELS), len(word))
    return 3


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    w = word.replace("ã", "a~").replace("õ", "o~")
    r1 = _after(w, 0)
    r2 = _after(w, r1) if r1 < len(w) else len(w)
    rv = _rv(w)
    ends = lambda s, region: w.endswith(s) and len(w) - len(s) >= region
    before = w
    done = False
    for s, by in _ORDERED_STANDARD:
        if w.endswith(s):
            if ends(s, r2):
                w, done = w[: -len(s)] + by, True
            break
    if not done:
        w, done = _more(w, r1, r2, rv)
    if not done:
        for s in _ORDERED_VERBS:
            if ends(s, rv):
                w, done = w[: -len(s)], True
                break
    if done:
        if w != before and w.endswith("ci") and len(w) - 1 >= rv:
            w = w[:-1]
    else:
        for s in ("os", "a", "i", "o", "á", "í", "ó"):
            if ends(s, rv):
                w = w[: -len(s)]
                break
    for s in ("e", "é", "ê"):
        if ends(s, rv):
            w = w[: -len(s)]
            if w.endswith("gu") and len(w) - 1 >= rv or w.endswith("ci") and len(w) - 1 >= rv:
                w = w[:-1]
            break
    if w.endswith("ç"):
        w = w[:-1] + "c"
    return w.replace("a~", "ã").replace("o~", "õ")


def _more(w: str, r1: int, r2: int, rv: int) -> tuple[str, bool]:
    """Adverbs, nouns of quality and the suffixes that leave a further one behind."""
    if w.endswith("amente"):
        if len(w) - 6 >= r1:
            w = w[:-6]
            for s in ("ativ", "iv", "os", "ic", "ad"):
                if w.endswith(s) and len(w) - len(s) >= r2:
                    return w[: -len(s)], True
            return w, True
        return w, False
    for s, inner in (("mente", ("ante", "avel", "ível", "ável")), ("idades", ("abil", "ic", "iv")), ("idade", ("abil", "ic", "iv")), ("ivas", ("at",)), ("ivos", ("at",)), ("iva", ("at",)), ("ivo", ("at",))):
        if w.endswith(s):
            if len(w) - len(s) < r2:
                return w, False
            w = w[: -len(s)]
            for x in inner:
                if w.endswith(x) and len(w) - len(x) >= r2:
                    return w[: -len(x)], True
            return w, True
    for s in ("iras", "ira"):
        if w.endswith(s):
            if len(w) - len(s) >= rv and w[: -len(s)].endswith("e"):
                return w[: -len(s)] + "ir", True
            return w, False
    return w, False
