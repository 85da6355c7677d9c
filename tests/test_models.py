import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators import models
from tessella.plans.text_queries import serving_metadata

SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])


def test_retries_by_kind_of_failure(spark):
    """Unreadable replies and network failures are tried again with growing waits, refusals are not."""
    calls, waits = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0.0)
    seen: dict = {}

    def call(t):
        calls.add(1)
        seen[t] = seen.get(t, 0) + 1
        if t == "refused":
            raise models.Refused(t)
        if t == "never" or t == "third" and seen[t] < 3:
            raise (OSError, ValueError, KeyError)[seen[t] % 3](t)
        return {"a": len(t), "other": 1}

    rows = spark.createDataFrame([("third",), ("never",), ("refused",), ("fine",), (None,), ("",)], "t string").coalesce(1)
    got = {r.t: r.x for r in rows.select("t", models.extracted(F.col("t"), call, SCHEMA, sleep=waits.add).alias("x")).collect()}
    assert got["third"].a == 5 and got["fine"].a == 4 and got["fine"].b is None and all(got[t].a is None for t in ("never", "refused", None, ""))
    assert calls.value == 3 + 5 + 1 + 1 and waits.value == sum(map(models.wait, (0, 1))) + sum(map(models.wait, range(4)))


def test_replies_are_validated(spark):
    good = '{"a": 1, "b": "x", "c": [1]}'
    cases = [(good, True), (f"```json\n{good}\n```", True), (f"```{good}```", True), ('{"a": 1}', True), ('{"a": "x", "b": "y"}', False), ('{"b": "y"}', False), ("[1]", False), ("{", False), ("", False), (None, False), (good[:-1], False)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", models.parsed_reply(F.col("t"), SCHEMA, ("a",)).alias("x")).collect()}
    assert [got[i] is not None for i in range(len(cases))] == [ok for _, ok in cases] and got[0].b == "x" and got[3].b is None


@pytest.mark.parametrize("size", [1, 3, 50])
def test_batches_keep_places(spark, size):
    texts = [None, "", "aa", "b", "  ", "aab", "c", "aaaa"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2)
    got = {r.i: r.v for r in df.select("i", models.embedded(F.col("t"), models.counting_embedder("ab"), size).alias("v")).collect()}
    assert got == {i: [float(t.count("a")), float(t.count("b"))] if t and t.strip() else None for i, t in enumerate(texts)}


def test_source_keys_replace_fields(spark):
    kind = "doc_id string, source_db string, court string, court_short string, x struct<court: string, summary: string, court_short: string>"
    df = spark.createDataFrame([("d", "db", None, "S", ("of the model", None, "M"))], kind)
    m = json.loads(df.select(serving_metadata(df, "x")).first()[0])
    assert m == {"summary": None, "source_db": "db", "court": "", "court_short": "S"}


def test_postprocessing(spark):
    cited = "array<struct<article: string, law: string, citation_context: string>>"
    kind = f"k string, x struct<keywords_search_query: string, procedural_type: string, case_type: string, is_jurisprudence_unification: boolean, legislation_cited: {cited}>"
    rows = [
        ("a", ("Mora do Devedor, x, mora-do devedor", "REVISTA", None, None, [("527.º, n.ºs 1 e 2", "CPC", "bogus"), None, ("527.º, n.º 2", "cpc", "Supporting")])),
        ("b", (None, None, "Recurso para Fixação de Jurisprudência", False, [])), ("c", (None, None, None, True, None)), ("d", None), (None, None),
    ]
    got = {r.k: r for r in models.postprocessed(spark.createDataFrame(rows, kind), "k", "x").collect()}
    law = "Código de Processo Civil"
    assert got["a"].keywords == "mora do devedor" and got["a"].is_auj is False and [tuple(p) for p in got["a"].legislation] == [(1, "527.º, n.º 1", law, "referencing"), (2, "527.º, n.º 2", law, "supporting")]
    assert got["b"].is_auj and got["c"].is_auj and got["b"].legislation is None and got["d"].is_auj is None and len(got) == 4


def test_benchmark_is_sorted_by_cost(spark):
    docs = spark.createDataFrame([("aaaa bbbb",), ("b" * 40,), (None,), ("",)], "t string")

    def fails(t):
        raise models.Refused(t)

    made = {"dear": (lambda t: {"a": 1, "b": t}, 10.0, 0.0), "cheap": (lambda t: {"a": 1}, 1.0, 0.0), "none": (fails, 5.0, 0.0)}
    got = models.benchmark(docs, "t", made, SCHEMA).orderBy("place").collect()
    assert [(r.model, r.calls, r.answered, r.filled, r.prompt_tokens) for r in got] == [("cheap", 2, 2, 0.5, 12), ("none", 2, 0, 0.0, 12), ("dear", 2, 2, 1.0, 12)]
