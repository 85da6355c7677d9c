import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.operators.packed import locators, members, split_locators, split_phrases, unpack, unpack_ranges


@pytest.mark.parametrize(
    ("text", "out"),
    [
        (None, []), ("  ", []), ("a b", ["a b"]), ("a, b;c", ["a", "b", "c"]), ("juros de 4,5 por cento, a 1.250,50", ["juros de 4,5 por cento", "a 1.250,50"]),
        ("dolo e/ou culpa / lei 12/2010", ["dolo e/ou culpa", "lei 12/2010"]), ('"a, b";«c; d»| "e ""f"", g"', ["a, b", "c; d", 'e "f", g']),
        ("1) a\n2) b\r\n3. a", ["a", "b", "a"]), ("• a • b", ["a", "b"]), ("- x\n- y-z", ["x", "y-z"]), (",, a ;; ,", ["a"]), ('o "x, y" z, w', ['o "x, y" z', "w"]), ('"aberto, b', ['"aberto', "b"]),
        (", 0", ["", "0"]),
    ],
)
def test_phrases(text, out):
    assert split_phrases(text) == out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc ,;|/é-0", min_size=1, max_size=8).map(str.strip).filter(bool), min_size=1, max_size=6), st.sampled_from([", ", ";", " | ", "\n", " • "]))
def test_quoted_round_trip(values, mark):
    assert split_phrases(mark.join(f'"{v}"' for v in values)) == values


@pytest.mark.parametrize(
    ("text", "out"),
    [
        ("527.º, n.ºs 1 e 2", ["527.º, n.º 1", "527.º, n.º 2"]), ("5.º, n.ºs 1-3", ["5.º, n.º 1", "5.º, n.º 2", "5.º, n.º 3"]), ("9.º/9/f)", ["9.º, n.º 9, alínea f)"]), ("9.º / 10.º", ["9.º", "10.º"]),
        ("13.º, 220", ["13.º", "220.º"]), ("9.º-A a 9.º-C", ["9.º-A", "9.º-B", "9.º-C"]), ("Artºs 9, 10", ["9.º", "10.º"]), ('"9.º, n.º 9", "10.º"', ["9.º, n.º 9", "10.º"]),
        ("9.º, n.ºs 1 e 2, alínea a)", ["9.º, n.º 1, alínea a)", "9.º, n.º 2, alínea a)"]), ("12.º, n.º 1, alíneas c) a e)", ["12.º, n.º 1, alínea c)", "12.º, n.º 1, alínea d)", "12.º, n.º 1, alínea e)"]),
        ("9.º – 11.º", ["9.º", "10.º", "11.º"]), ("passim", []), (None, []), ("", []), ("9.º e 9.º", ["9.º", "9.º"]),
        ("5.º, n.ºs 1 a 3 e 7, alíneas a) e b)", [f"5.º, n.º {n}, alínea {x})" for n in (1, 2, 3, 7) for x in "ab"]), ("5.º, n.º 1 a 3, alínea a)", ["5.º, n.º 1", "5.º, n.º 2", "5.º, n.º 3, alínea a)"]),
        ("1.º a " + "9" * 20 + ".º", ["1.º", "9" * 20 + ".º"]), ("«5.º; n.º 1» 7", ["5.º, n.º 1", "7.º"]), ("5.º, n.º 1; 7", ["5.º, n.º 1", "5.º, n.º 7"]),
    ],
)
def test_locators(text, out):
    assert split_locators(text) == out


def test_unpack(spark):
    rows = [("a", "x, y"), ("a", "x, y"), ("b", "one"), ("c", None), (None, "x, y"), ("d", "x; x"), ("e", "long " * 20000 + ", z")]
    got = unpack(spark.createDataFrame(rows, "k string, val string"), "f", F.col("k"), F.col("val"), split_phrases)
    out = {(r.rec_key, r.val_pos): r.val for r in got.collect()}
    assert got.count() == 6 and out[("d", 1)] == out[("d", 2)] == "x" and out[("e", 2)] == "z" and out[("a", 2)] == "y"
    assert unpack(spark.createDataFrame([], "k string, val string"), "f", F.col("k"), F.col("val"), split_phrases).count() == 0


def test_ranges_lose_no_member(spark):
    """Long ranges are expanded in blocks by the JVM; short ones agree with the plain expansion."""
    texts = ["1.º a 2500.º", "3.º, n.ºs 1 a 5000, alíneas a) a c)", "9.º-A a 9.º-C, n.º 2", '"7.º, n.ºs 2 a 4"; 8.º', "5.º", None, "", "passim", "2.º, n.º 1, alínea a), n.º 2, alínea b)"]
    df = spark.createDataFrame([(str(i), t, "x") for i, t in enumerate(texts)] + [("1", texts[1], "x"), (None, texts[0], "x")], "k string, v string, field_name string")
    got: dict = {}
    for r in unpack_ranges(df, "article", F.col("k"), F.col("v"), block=7).collect():
        got.setdefault(r.rec_key, []).append((r.val_pos, r.val))
    want = {str(i): list(enumerate(members(locators(t)), 1)) for i, t in enumerate(texts) if len(split_locators(t)) > 1}
    assert {k: sorted(v) for k, v in got.items()} == want and len(want["0"]) == 2500 and len(want["1"]) == 15000
    assert unpack_ranges(df.where("k = 'none'"), "article", F.col("k"), F.col("v")).count() == 0
    long = spark.createDataFrame([("a", "1.º a 1000000.º")], "k string, v string")
    assert unpack_ranges(long, "article", F.col("k"), F.col("v")).agg(F.count("*"), F.max("val_pos")).first() == (1_000_000, 1_000_000)
