import pytest
from pyspark.sql import functions as F

from tessella.llm import canonical

ENTRIES = [
    (1, "Código de Processo Comum", "CPC", "codigo", None), (4, "Código do Arrendamento Rústico", "CAR", "codigo", None), (8, "Código da Vizinhança", None, "codigo", None), (13, "Código Sancionatório", None, "codigo", None),
    (14, "Código de Processo Sancionatório", "CPS", "codigo", None), (43, "Regulamento Geral das Feiras", "RGF", "codigo", None), (49, "Regime Jurídico das Associações de Rega", "RJAR", "codigo", None),
    (103, "Decreto-Lei n.º 6/1995", None, "Decreto-Lei", 1995), (121, "Lei n.º 379-B/1993", None, "Lei", 1993), (183, "Lei n.º 36/1996", None, "Lei", 1996), (125, "Lei n.º 6/1995", None, "Lei", 1995), (205, "Decreto Regulamentar n.º 8/2007", None, "Decreto Regulamentar", 2007),
]
CASES = [
    (None, 0), ("", 0), ("  ", 0), ("novo CPC", 1), ("C.P.C.", 1), ("cpc ", 1), ("art. 7.º, n.º 2 do  CÓDIGO DE PROCESSO COMUM - versão consolidada", 1), ("CÃ³digo da VizinhanÃ§a", 8), ("Vizinhança, Código da", 8),
    ("Código Arrendamento Rústico", 4), ("Código do Arrendament Rústicoo", 4), ("Código do Arrendamento Turístico Sazonal", 0), ("Código de Processoo Sancionatório", 14), ("Código deP rocesso Comum", 1), ("Reg. Geral das Feiras", 43),
    ("Regulamento Geral das Marinas", 0), ("Reg.º Jurídico das Associações de Rega", 49), ("D.L. n.º 6 / 95, de 3 de maio de 1995", 103), ("da Lei 6/95", 125), ("Lei nº379 - B de 1993 de 9/11", 121), ("Lei n.º 379/1993", 0),
    ("Decreto-Lei n.º 36/1996", 0), ("Lei 36/1996 (rectificada)", 183), ("Lei 36/96", 183), ("Lei 36/30", 0), ("DR 8/07", 205), ("Portaria n.º 6/1995", 0), ("a lei aplicável", 0), ("citado Código", 0), ("n.º 6/1995", 0),
    ("x " * 5000 + "Código da Vizinhança", 8),
]


@pytest.mark.parametrize(("text", "key"), CASES)
def test_cases(text, key):
    assert canonical.Gazetteer(ENTRIES).find(text) == key


def test_column(spark):
    g = canonical.Gazetteer(ENTRIES)
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, law string").select("i", canonical.canonical(F.col("law"), g).alias("k")).collect()
    assert [r.k for r in sorted(rows)] == [k for _, k in CASES]
    entries = spark.createDataFrame([(*e, "extra") for e in ENTRIES], "law_id long, law_name string, short_form string, law_kind string, law_year int, law string")
    assert canonical.gazetteer(entries, key="law_id", name="law_name", short="short_form", kind="law_kind", year="law_year").entries == sorted(ENTRIES)
    with pytest.raises(ValueError):
        canonical.gazetteer(entries, key="law_id", name="law_name", short="short_form", kind="law_kind", year="law_year", most=3)


def test_distance():
    assert [canonical.distance(*p) for p in (("", "ab"), ("abc", "acb"), ("kitten", "sitting"), ("a", "a"))] == [2, 1, 3, 0]


def test_odd_entries_and_clashes():
    """An act without a number is taken for a name, an empty name for none, and ways of writing that entries share are reported."""
    names = canonical.Gazetteer([(1, "Lei das Rendas", "LR", "Lei", 1999), (2, "Código Civil", "CC", "Código", None), (3, "Cod. Civil", "cc", "Código", None), (4, "Lei n.º 5/2001", None, "Lei", 2001), (5, "Lei nº 5/01", None, "Lei", 2001), (6, "...", "", None, None)])
    assert names.find("lei das rendas") == 1 and names.find("C. Civil") == 2 and names.find("Lei 5/2001") == 4 and names.find("...") == 0
    assert ("cc", [2, 3]) in names.clashes() and ("Lei 5/2001", [4, 5]) in names.clashes()


def test_candidate_lists_lose_nothing():
    """Against a search that looks at every entry and every word."""
    import random

    rng = random.Random(3)
    parts = ["codigo", "civil", "penal", "processo", "trabalho", "estrada", "registo", "predial", "comercial", "notariado", "arrendamento", "urbano", "de", "do"]
    entries = [(i, " ".join(dict.fromkeys(rng.choices(parts, k=rng.randint(1, 4)))), None, None, None) for i in range(1, 60)]
    names, plain = canonical.Gazetteer(entries), EveryEntry(entries)
    assert names.find("x") == plain.find("x") == 0

    def worse(w):
        at = rng.randrange(len(w))
        return rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("aeiorst") + w[at:], w[:at] + rng.choice("aeiorst") + w[at + 1 :], w])

    for _ in range(400):
        s = canonical.normal(" ".join(worse(w) or w for w in rng.choice(entries)[1].split()))
        assert names.similar(s) == plain.similar(s)
        for t in s.split():
            assert names._near(t) == {v: x for v in names._made["spelled"] if (x := canonical.alike(t, v, names.loose_least))}


class EveryEntry(canonical.Gazetteer):
    def _candidates(self, near):
        return [at for at, (_, _, content) in enumerate(self._made["names"]) if content]
