"""The key registry, generated files, the catalog and the command line."""

import ast
import json

import pytest

from ranklume import catalog, codegen
from ranklume.__main__ import main
from ranklume.keys import Key, KeyRegistry, RegistryError, check_entries, parse_yaml
from ranklume.queries import COMPLEX_PLAN

GOOD = {"id": 1, "name": "a.b_c", "type": "f32", "scope": "score", "owner": "o", "doc": "d"}
YAML = """
# a registry
version: 3
keys:
  - id: 1
    name: a.b
    type: f32   # a float
    scope: score
    owner: "core"
    doc: 'with: colon'
  - id: 2
    name: c
    type: i64
    scope: candidate
    owner: x
    doc: text
"""


def problems(*entries, version=1):
    return check_entries({"version": version, "keys": list(entries)})


def test_valid_registry():
    assert problems(GOOD) == []
    reg = KeyRegistry.from_document({"version": 1, "keys": [GOOD]})
    k = reg.by_id(1)
    assert (k.column, k.constant, reg.by_name("a.b_c"), reg.by_id(9), reg.by_name("z")) == ("a_b_c", "A_B_C", k, None, None)
    assert reg.document() == {"version": 1, "keys": [GOOD]}


@pytest.mark.parametrize("field,value", [("id", 0), ("id", "1"), ("id", True), ("name", "A.b"), ("name", "1a"), ("name", "a..b"), ("name", ""), ("type", "f64"), ("scope", "other"), ("owner", ""), ("doc", ""), ("doc", None)])
def test_bad_fields_are_told_with_their_path(field, value):
    assert problems({**GOOD, field: value})[0].startswith(f"- keys.0.{field}: ")


def test_other_registry_errors():
    assert problems(version=0)[0].startswith("- version")
    assert check_entries([]) and check_entries({"version": 1, "keys": 3}) and problems("x")
    twice = problems(GOOD, {**GOOD, "name": "z"}, {**GOOD, "id": 5})
    assert any("keys.1.id: duplicate" in m for m in twice) and any("keys.2.name: duplicate" in m for m in twice)
    with pytest.raises(RegistryError):
        KeyRegistry.from_document({"version": 1, "keys": [{**GOOD, "type": "no"}]})
    with pytest.raises(RegistryError):
        KeyRegistry([Key(1, "a", "f32", "score"), Key(1, "b", "f32", "score")])
    with pytest.raises(RegistryError):
        KeyRegistry([Key(1, "a", "f99", "score")])


def test_yaml_and_files(tmp_path):
    doc = parse_yaml(YAML)
    assert doc["version"] == 3 and doc["keys"][0]["doc"] == "with: colon" and doc["keys"][0]["type"] == "f32" and doc["keys"][1]["id"] == 2
    (tmp_path / "r.yaml").write_text(YAML)
    reg = KeyRegistry.load(tmp_path / "r.yaml")
    (tmp_path / "r.json").write_text(codegen.keys_json(reg))
    assert KeyRegistry.load(tmp_path / "r.json").keys == reg.keys
    assert KeyRegistry.default().resolve("score.final").id == 3999
    with pytest.raises(KeyError):
        reg.resolve(77)


def test_schema_and_values(spark):
    reg = KeyRegistry.default()
    assert reg.struct(3001, "feat.embedding").simpleString() == "struct<score_base:float,feat_embedding:array<float>>"
    assert reg.struct(2002)[0].metadata["key_name"] == "feat.embedding" and len(reg.struct()) == 11
    assert reg.to_frame(spark).count() == 11
    fine = {"i64": 3, "f32": 1.0, "f32vec": [1.0], "string": "x"}
    for key in reg.keys:
        reg.check(key, None)
        reg.check(key, fine[key.type])
        for kind, value in fine.items():
            if kind != key.type:
                with pytest.raises(TypeError, match="Type mismatch"):
                    reg.check(key, value)


def test_generated_files(tmp_path):
    reg = KeyRegistry.default()
    assert codegen.generate(reg, tmp_path / "g") == [] and codegen.generate(reg, tmp_path / "g", check=True) == []
    space = {}
    exec((tmp_path / "g/keys.py").read_text(), space)
    assert space["SCORE_FINAL"] == 3999 and space["BY_NAME"]["score.ml"] == 3002
    ast.parse((tmp_path / "g/nodes.pyi").read_text())
    assert "CAND_CANDIDATE_ID: { id: 1001" in (tmp_path / "g/keys.ts").read_text() and "kCount = 11" in (tmp_path / "g/keys.h").read_text()
    (tmp_path / "g/keys.h").write_text("x")
    (tmp_path / "g/keys.ts").unlink()
    assert sorted(codegen.generate(reg, tmp_path / "g", check=True)) == ["missing: keys.ts", "stale: keys.h"]


def test_catalog(tmp_path, spark):
    doc = catalog.export()
    by = {n["op"]: n for n in doc["nodes"]}
    assert by["core:sourcer"]["writes"] == {"kind": "static", "keys": ["cand.candidate_id", "score.base"]} and by["core:score_formula"]["writes"] == {"kind": "param_derived", "param": "output_key_id"}
    assert [n["namespace"] for n in doc["nodes"]] == sorted(n["namespace"] for n in doc["nodes"])
    assert catalog.to_frame(spark).count() == len(by)
    (tmp_path / "m.py").write_text("META = {'name': 'm', 'version': '1', 'writes': [3002]}\ndef run_batch(b, c, p): pass\n")
    (tmp_path / "broken.py").write_text("META = 1")
    (tmp_path / "exp.py").write_text("META = {'name': 'e', 'stability': 'experimental'}\ndef run_batch(b, c, p): pass\n")
    doc = catalog.export(modules=tmp_path)
    mine = [n for n in doc["nodes"] if n["namespace"] == "py.m"]
    assert mine[0]["op"].startswith("py:m.py@1#") and mine[0]["writes"]["keys"] == ["score.ml"] and len(doc["warnings"]) == 2
    text = catalog.to_yaml({"a": [{"b": 1, "c": {"d": []}}], "e": "x"})
    assert text == 'a:\n  - b: 1\n    c:\n      d: []\ne: "x"\n'


def test_command_line(tmp_path, capsys, spark):
    plan = tmp_path / "p.json"
    plan.write_text(json.dumps({"name": "cli", "nodes": [{"id": "s", "op": "core:sourcer", "params": {"k": 3}}, {"id": "f", "op": "core:score_formula", "inputs": ["s"]}]}))
    assert main(["run", str(plan), "-n", "2"]) == 0
    assert capsys.readouterr().out.splitlines() == ["[0] candidate_id=1, score.final=1.0000", "[1] candidate_id=2, score.final=0.6667"]
    assert main(["run", str(plan), "-q"]) == 0 and capsys.readouterr().out == ""
    big = tmp_path / "big.json"
    big.write_text(json.dumps(COMPLEX_PLAN))
    tight = tmp_path / "b.json"
    tight.write_text('{"hard": {"node_count": 2}}')
    assert main(["validate", str(plan), str(big)]) == 0
    assert "'score': 49" in capsys.readouterr().out
    assert main(["validate", str(big), "-b", str(tight), "--json"]) == 1
    assert "PLAN_TOO_COMPLEX" in json.loads(capsys.readouterr().out)["error"]
    assert main(["run", str(big), "-b", str(tight)]) == 1 and main(["run", str(tmp_path / "no.json")]) == 1
    gate = tmp_path / "x.plan.py"
    gate.write_text("import os")
    assert main(["validate", str(gate)]) == 1
    assert main(["codegen", "-o", str(tmp_path / "g")]) == 0 and main(["codegen", "-o", str(tmp_path / "g"), "--check"]) == 0
    assert main(["nodes", "export", "--format", "json"]) == 0 and main(["nodes", "codegen"]) == 0 and main(["nodes", "graduate"]) == 1
