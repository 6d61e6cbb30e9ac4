"""Content-management parsers, capsules and briefings."""

from pyspark.sql import functions as F

from skein.functions.embed import embedding
from skein.operators import capsule
from skein.sources import cms, parsers

G = "11111111-2222-3333-4444-{:012d}"


def links(edges):
    return {(e["source"], e["target"], e["relationship"]) for e in edges}


def test_item():
    text = f'''---
ID: "{G.format(1).upper()}"
Parent: "{G.format(2)}"
Template: "{{{G.format(3)}}}"
Path: /sitecore/content/Home
SharedFields:
- ID: "x"
  Hint: __Base template
  Value: |
    {{{G.format(4)}}}|{{{G.format(5)}}}
- ID: "y"
  Hint: __Renderings
  Value: <r id="{{{G.format(6)}}}" ds="{{{G.format(7)}}}" />
- ID: "z"
  Hint: Link
  Value: "{{{G.format(8)}}}"
'''
    nodes, edges = cms.parse_item("home.yml", text)
    me = G.format(1)
    assert [(n["id"], n["name"]) for n in nodes] == [(me, "Home")]
    assert links(edges) == {
        (me, G.format(3), "BASED_ON_TEMPLATE"), (G.format(2), me, "HAS_CHILD"), (me, G.format(4), "INHERITS_FROM"), (me, G.format(5), "INHERITS_FROM"),
        (me, G.format(6), "HAS_RENDERING"), (me, G.format(7), "USES_DATASOURCE"), (me, G.format(8), "REFERENCES"),
    }
    assert cms.parse_item("x.yml", "plain: 1") == ([], [])


def test_config():
    text = """<configuration><sitecore><pipelines><init><processor type="A.One, Asm"/></init></pipelines>
    <services><register serviceType="I" implementationType="A.Two"/><configurator type="A.Three"/></services>
    <events><event name="e"><handler type="A.One, Asm"/></event></events></sitecore></configuration>"""
    nodes, edges = cms.parse_config("a.config", text)
    assert links(edges) == {
        ("a.config", "clrtype:A.One", "REGISTERS_PROCESSOR"), ("a.config", "clrtype:A.Two", "REGISTERS_SERVICE"),
        ("a.config", "clrtype:A.Three", "REGISTERS_CONFIGURATOR"), ("a.config", "clrtype:A.One", "HANDLES_EVENT"),
    }
    assert len(nodes) == 4 and cms.parse_config("b.config", "<broken") == ([], [])


def test_config_properties():
    text = """<a><b><sitecore><pipelines><http><processor type="N.P"/><other type="N.No"/></http></pipelines>
    <services><register serviceType="N.I, Asm" concreteType="N.C" lifetime="Singleton"/></services>
    <events><event name="saved"><handler type="N.H"/></event></events><settings><setting name="One"/><setting/><setting name="Two"/></settings></sitecore></b></a>"""
    nodes, edges = cms.parse_config("x/a.config", text)
    assert {(e["target"], *sorted(e["properties"].items())) for e in edges} == {
        ("clrtype:N.P", ("pipeline", "http")), ("clrtype:N.C", ("lifetime", "Singleton"), ("serviceType", "N.I")), ("clrtype:N.H", ("event", "saved")),
    }
    assert nodes[0]["properties"] == {"cms": "Sitecore", "settingCount": "2", "settings": "One,Two"} and nodes[0]["name"] == "a.config"
    assert cms.parse_config("web.config", "<configuration><pipelines/></configuration>") == ([], [])


def test_config_properties_reach_the_tables(spark):
    files = spark.createDataFrame([("a.config", '<sitecore><events><event name="e"><handler type="N.H"/></event></events></sitecore>')], "path string, text string")
    parsed = parsers.parse_files(files, {".config": cms.parse_config})
    assert parsers.edges_of(parsed, properties=True).first()["properties"] == {"event": "e"}
    assert {r["id"]: r["properties"] for r in parsers.nodes_of(parsed, properties=True).collect()}["clrtype:N.H"] == {"clrType": "N.H"}


def test_module_metadata():
    php = """<?php // 'extend' => ['No' => 'n']
    $aModule = array('id' => 'x', 'title' => array('de' => 'T'), 'extend' => ['A\\B' => 'm/C', SomeClass::class => 'skip', 'D' => "m/E",], 'blocks' => []);"""
    assert parsers.module_extensions(php) == [("A\\B", "m/C"), ("D", "m/E")]
    assert parsers.module_extensions("") == [] and parsers.module_extensions("['extend' => 3]") == [] and parsers.module_extensions("]]'") == []


def test_routes_and_types():
    route = '{"sitecore":{"route":{"name":"home","placeholders":{"main":[{"componentName":"Hero","placeholders":{"in":[{"componentName":"Text"}]}}]}}}}'
    assert links(cms.parse_route("r.json", route)[1]) == {("r.json", "xmcloud:component:hero", "RENDERS_COMPONENT"), ("r.json", "xmcloud:component:text", "RENDERS_COMPONENT")}
    nodes, edges = cms.parse_content_types("p.cs", "[ContentType(GUID = \"x\")] public class Start : PageData { public virtual string Title { get; set; } }")
    assert [(n["type"], n["name"]) for n in nodes] == [("OptiPageType", "Start"), ("OptiProperty", "Title")] and edges[0]["relationship"] == "HAS_PROPERTY"
    assert [n["type"] for n in cms.parse_registrations("k.cs", "[assembly: RegisterModule(typeof(M))] class P : TreeNode {}")[0]] == ["KenticoModule", "KenticoPageType"]
    assert cms.parse_component("src/Hero.tsx", "<Placeholder name='x'/>")[0][0]["id"] == "xmcloud:component:hero"


def test_capsule_and_briefings(spark):
    nodes = spark.createDataFrame([(k, "Class", k.upper(), f"body of {k}", f"src/m{i}/{k}.cs", 1) for i, k in enumerate("abcd")], "id string, type string, name string, content string, file_path string, start_line int")
    edges = spark.createDataFrame([("a", "b", "CALLS", 0), ("b", "c", "IMPORTS", 0)], "source string, target string, relationship string, provenance int")
    text = capsule.synthesize(nodes, edges, ["d"], cap=3, budget_chars=12)
    assert "body of d" in text and "n0[" in text and "-->|CALLS|" in text and text.count("body of") == 1
    found = capsule.audit(nodes, edges)
    assert found["clusters"] == [(2,)] and found["suspect"] == [("IMPORTS",)] and found["hotspots"][0] == ("b", 2)
    assert capsule.orient(nodes, edges)["dependencies"] == [("m0", "m1", 1), ("m1", "m2", 1)]
    assert capsule.clamp("abc", 2, "ask").startswith("ab\n") and capsule.fit(["a b", "c " * 100], 30)[0] == "a b"


def test_hash_embedding(spark):
    rows = spark.createDataFrame([("a", "red fish"), ("b", "fish red"), ("c", "")], "id string, t string").select("id", embedding(F.col("t")).alias("v"))
    got = {r["id"]: r["v"] for r in rows.collect()}
    assert got["a"] == got["b"] and len(got["c"]) == 64
