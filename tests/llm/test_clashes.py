"""Further columns, whatever their names, and nulls in any column change nothing."""

from pyspark.sql import functions as F

from tessella.llm import canonical, leakage, mixing, neardup, readability

EXTRA = ("d", "t", "k", "c", "class", "n", "grams", "a", "b", "x", "y", "part", "block", "level", "score", "tokens", "rate", "times", "copies", "links", "grade", "law_id", "item_id", "longest")


def widened(df):
    for name in EXTRA:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(name if name < "m" else None))
    return df


def both(make, df):
    plain, wide = (sorted(map(str, make(x).collect())) for x in (df, widened(df)))
    assert plain == wide
    return plain


def test_clashing_names(spark):
    rows = [(i, ["a", "b", None][i % 3], f"um dois três quatro cinco seis sete oito nove {i // 2}. Fim longamente circunstanciado.") for i in range(30)] + [(None, "a", "um dois três"), (99, "b", None), (100, "a", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    items = spark.createDataFrame([(1, "Um, dois, tres, quatro, cinco, seis"), (None, "um dois três"), (2, None)], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 5 + 1) for i in range(30)] + [(None, 1), (3, None)], "doc_id long, grade int")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, None), (None, None, None)], "source string, target_share double, max_repeats int")
    assert both(lambda d: neardup.duplicate_pairs(*neardup.near_duplicates(d, doc_id=F.col("doc_id"), text=F.col("text"), size=2, threshold=0.7)), docs)
    assert both(lambda d: neardup.link_counts(*neardup.near_duplicates(d, doc_id=F.col("doc_id"), text=F.col("text"), size=2, threshold=0.7)), docs)
    assert both(lambda d: leakage.leaked_spans(d, items, run=4), docs)
    assert both(lambda d: readability.extreme_bands(readability.reading_levels(d, labels)), docs) is not None
    assert both(lambda d: mixing.share_report(*mixing.draw(d, targets)), docs)


def test_many_mentions_in_one_value():
    g = canonical.Gazetteer([(8, "Código da Vizinhança", None, "codigo", None)])
    assert g.find("lei " * 30_000) == 0 and g.find("lei " * 30_000 + "código da vizinhança") == 8
