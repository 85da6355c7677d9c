import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.operators import nested


def found(value):
    return [(p, q) for p, q, *_ in nested.visit(nested.unwrap(nested.parse(value)))]


def test_rules():
    doc = {
        "llm_extracted": {"parties": [None, {"name": "a", "representatives": {"name": "b", "mandates": [{"begun": None}, {"begun": "x"}]}}, {}]},
        "amounts_involved": {"amount": 1.5, "currency": None}, "timeline_events": json.dumps([{"date": None}, {"event": "e", "exhibits": [{"ref": "r"}]}]),
        "model_notes": {"x": [{"a": 1}]}, "summary": "[not json", "other": [1, {"z": 0}], "plain": {"inner": [{"q": False}]}, "legal_descriptors": ["A"],
    }
    expected = [
        ("parties", "2"), ("parties.representatives", "2.1"), ("parties.representatives.mandates", "2.1.2"), ("amounts_involved", "1"), ("timeline_events", "2"), ("timeline_events.exhibits", "2.1"),
        ("other", "2"), ("plain.inner"[6:], "1"),
    ]
    assert found(json.dumps(doc)) == expected
    assert found(json.dumps(json.dumps(doc))) == expected


def test_invalid_and_empty():
    for text in (None, "", "{", '{"parties":[{"a":1}]', '{"parties":[{"a":NaN}]}', "[]", "null", "3", '"text"'):
        assert found(text) == []
    deep = '{"parties":[{"a":1,"representatives":' * 400 + "1" + "}]}" * 400
    assert len(found(deep)) == 799  # each representatives object counts as a list of one


def test_struct_and_schema(spark):
    kind = "r struct<name:string, parties:array<struct<role:string,name:string>>, note:string>, doc_id string"
    rows = [(("n", [None, ("x", None), (None, None)], '[{"k": 1}]'), "d1"), ((None, None, None), "d2"), (None, "d3"), (("n", [None, ("x", None), (None, None)], '[{"k": 1}]'), "d1")]
    df = spark.createDataFrame(rows, kind)
    tagged = nested.flatten(df, "t", F.col("doc_id"), nested.struct_as_json("r", df.schema["r"].dataType))
    once = nested.distinct_children(tagged)
    assert {(r.rec_key, r.child_path, r.child_pos, r.parent_path) for r in once.collect()} == {("d1", "parties", "2", ""), ("d1", "note", "1", "")}
    assert once.count() == 2
    typed = nested.with_schema(once, "parties", "role string").collect()
    assert [(r.rec_key, r.role) for r in typed] == [("d1", "x")]
    assert nested.flatten(df.limit(0), "t", F.col("doc_id"), F.col("doc_id")).count() == 0


def test_write_by_tag(spark, tmp_path):
    df = spark.createDataFrame([(1, '{"parties":[{"a":1}],"injuries":[{"b":2}]}')], "doc_id long, metadata string")
    nested.write_children(nested.flatten(df, "documents", F.col("doc_id"), F.col("metadata")), str(tmp_path / "x"))
    assert {p.name for p in (tmp_path / "x" / "rec_table=documents").iterdir()} == {"child_path=parties", "child_path=injuries"}


def test_no_record_is_too_deep(spark):
    for n in (1000, 20_000):
        deep = '{"a":[' * n + '{"b":1}' + "]}" * n
        assert len(found(deep)) == n and nested.parse_deep(deep[:-1]) is None
    df = spark.createDataFrame([(1, deep), (2, "{"), (3, None), (4, "null"), (5, "[" * 9000)], "doc_id long, metadata string")
    assert nested.flatten(df, "d", F.col("doc_id"), F.col("metadata")).where("rec_key = '1'").count() == 20_000
    assert tuple(nested.invalid(df, "d", F.col("metadata")).first()) == ("d", 5, 1, 2)


JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=6), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=15)


@settings(max_examples=150, deadline=None)
@given(JSON, st.sampled_from([None, 1, "\t"]), st.integers(0, 30), st.sampled_from(['"', "{", ",", "x", "]", "\x01"]))
def test_deep_parser_agrees(value, indent, at, noise):
    text = json.dumps(value, indent=indent)
    assert nested.parse_deep(text) == nested.parse(text) == value
    broken = text[:at] + noise + text[at:]
    assert nested.parse_deep(broken) == nested.parse(broken)


def test_json_as_text_counts_everywhere(spark):
    item = [{"k": 1}, None, {"k": 2}]
    forms = {"plain": json.dumps(item), "led": "\n  " + json.dumps(item), "twice": json.dumps(json.dumps(item)), "thrice": json.dumps(json.dumps(json.dumps(item)))}
    kind = "r struct<note: string, names: array<string>, other: map<string, array<struct<k: int>>>>, doc_id string"
    rows = [((t, [None, json.dumps({"k": 3}), "plain"], {"m": [(4,), (None,)]}), n) for n, t in forms.items()]
    df = spark.createDataFrame(rows, kind)
    want = {("note", "1"), ("note", "3"), ("names", "2"), ("m", "1")}
    got = nested.flatten(df, "t", F.col("doc_id"), nested.struct_as_json("r", df.schema["r"].dataType)).collect()
    for n, t in forms.items():
        assert {(r.child_path, r.child_pos) for r in got if r.rec_key == n} == want
        assert {(p, q) for p, q in found(json.dumps({"note": t, "names": [None, json.dumps({"k": 3})], "other": {"m": [{"k": 4}]}}))} == want


def test_tables_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, '{"parties":[{"name":"a","representatives":[{"name":"b"}]}]}'), (2, '{"parties":[null,{"name":"c"}]}')], "doc_id long, metadata string")
    nested.write_children(nested.flatten(df, "documents", F.col("doc_id"), F.col("metadata")), str(tmp_path / "x"))
    rows = nested.read_children(spark, str(tmp_path / "x"), "documents", "parties.representatives", "name string").collect()
    assert [(r.rec_key, r.parent_path, r.parent_pos, r.child_pos, r["name"]) for r in rows] == [("1", "parties", "1", "1.1", "b")]


def test_struct_keeps_whatever_may_hold_children(spark):
    item = [{"k": 1}, None, {"k": 2}]
    # inside the wrapping quotes, blanks and brackets are written as escapes
    forms = {"line": json.dumps("\n  " + json.dumps(item)), "tab": json.dumps(json.dumps("\t" + json.dumps(item))), "code": json.dumps(json.dumps(item)).replace("[", "\\u005b")}
    df = spark.createDataFrame([((t, [None, t], 1), n) for n, t in forms.items()], "r struct<note: string, names: array<string>, size: int>, doc_id string")
    got = nested.flatten(df, "t", F.col("doc_id"), nested.struct_as_json("r", df.schema["r"].dataType)).collect()
    for n, t in forms.items():
        want = [("note", "1"), ("note", "3"), ("names", "2.1"), ("names", "2.3")]
        assert found(json.dumps({"note": t, "names": [None, t]})) == want
        assert [(r.child_path, r.child_pos) for r in got if r.rec_key == n] == want


def test_struct_keeps_variants_and_null_fields(spark):
    df = spark.sql("""select 'd' as doc_id, named_struct('v', parse_json('{"p": [{"a": 1}]}'), 'w', array(parse_json('{"b": 2}')), 'x', array(named_struct('c', 3, 'n', cast(null as string))), 't', time'10:00:00') as r""")
    got = nested.flatten(df, "t", F.col("doc_id"), nested.struct_as_json("r", df.schema["r"].dataType)).collect()
    assert [(r.child_path, r.child_pos, json.loads(r.payload)) for r in got] == [("p", "1", {"a": 1}), ("w", "1", {"b": 2}), ("x", "1", {"c": 3, "n": None})]
