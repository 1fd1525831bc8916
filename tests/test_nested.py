import json

from hypothesis import given, settings
from hypothesis import strategies as st
from quillstream.functions import nested as core
from quillstream.operators import nested

values = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=3), lambda v: st.lists(v, max_size=3) | st.dictionaries(st.text(min_size=1, max_size=2), v, max_size=3), max_leaves=12)


def brute(nodes):
    out = []

    def walk(v, path, parent):
        if isinstance(v, dict):
            if v:
                out.append((path, parent))
            for k, x in v.items():
                walk(x, f"{path}/{k}", path)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, f"{path}/{i}", parent)

    for i, n in enumerate(nodes):
        walk(json.loads(n), str(i), "")
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(values, max_size=3))
def test_objects_match_brute_force(vs):
    nodes = [json.dumps(v) for v in vs]
    assert [("/".join(s), "/".join(s[:-1])) for s, *_ in core.objects(nodes)] == brute(nodes)


@settings(max_examples=150, deadline=None)
@given(values)
def test_flat_parser_reads_what_the_other_reads(v):
    text = json.dumps(v, indent=1)
    assert core._parse_flat(text) == json.loads(text)


def test_any_depth():
    deep = '{"a":' * 60_000 + '{"b":1}' + "}" * 60_000
    assert core.parse(deep) is not core.unreadable


def test_operator_edge_cases(spark):
    rows = [(1, ['{"a":[{"b":{}},[{"c":1}],"x"],"a":{"d":{"e":2}}}', None, "{bad", "{}", "NaN"], 0), (2, None, 0), (3, [], 0), (4, ['[{"k":1}]'], 0), (4, ['[{"k":1}]'], 0)]
    df = spark.createDataFrame(rows, "graph_id int, nodes array<string>, path int")
    flat = nested.flatten_objects(df)
    assert sorted((r["graph_id"], r["path"], r["parent_path"]) for r in flat.collect()) == [(1, "0", ""), (1, "0/a", "0"), (1, "0/a/d", "0/a"), (4, "0/0", ""), (4, "0/0", "")]
    assert {r["dewey"] for r in flat.filter("path = '0/a/d'").collect()} == {"0-0-0"}
    tables = {r["schema_path"]: r["columns"] for r in nested.schema_tables(flat).collect()}
    assert tables["$/a/d"] == "e"
    assert nested.flatten_objects(df.limit(0)).count() == 0
    assert nested.table_of(flat, "$/a/d", ["e"]).collect()[0]["v_e"] == "2"


def test_keys_that_are_addresses_and_deep_lists(spark):
    deep = "[" * 3000 + "1, 2" + "]" * 3000
    rows = [(1, ['{"http://schema.org/author": {"~a/b": {"c": 1}}, "d": {"n": 1.50, "l": ' + deep + "}}"])]
    flat = nested.flatten_objects(spark.createDataFrame(rows, "graph_id int, nodes array<string>"))
    got = {r["path"]: (r["schema_path"], r["parent_schema_path"]) for r in flat.collect()}
    assert got["0/http://schema.org/author"] == ("$/http:~1~1schema.org~1author", "$")
    assert got["0/http://schema.org/author/~a/b"] == ("$/http:~1~1schema.org~1author/~0a~1b", "$/http:~1~1schema.org~1author")
    scalars = flat.filter("path = '0/d'").collect()[0]["scalars"]
    assert scalars["n"] == "1.5" and scalars["l"] == deep
    assert {(r["schema_path"], r["parent_schema_path"]) for r in nested.schema_tables(flat).collect()} == set(got.values())
