"""Parsers of content-management files: serialised items, configuration, components and content types."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from skein.schema import EXTRACTED, INFERRED
from skein.sources.parsers import blank_out, edge

_GUID = re.compile(r"\{?([0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12})\}?")


def guid(text: str) -> str:
    m = _GUID.search(text or "")
    if not m:
        return (text or "").strip().lower()
    d = m[1].replace("-", "").lower()
    return f"{d[:8]}-{d[8:12]}-{d[12:16]}-{d[16:20]}-{d[20:]}"


def _node(id: str, kind: str, name: str, content: str, path: str) -> dict:
    return {"id": id, "type": kind, "name": name, "content": content, "file_path": path, "start_line": 1, "end_line": content.count("\n") + 1}


def yaml_fields(text: str) -> Iterator[tuple[str, str]]:
    """(hint, value) of the fields of a serialised item: ``Hint:`` lines and the ``Value:`` (plain, quoted or block) after each."""
    hint, block, depth = "", None, 0
    for line in text.split("\n"):
        body, indent = line.strip(), len(line) - len(line.lstrip())
        if block is not None:
            if body and indent <= depth:
                yield hint, "\n".join(block)
                block = None
            else:
                block.append(body)
                continue
        if m := re.match(r"(?:- )?Hint:\s*(.*)", body):
            hint = m[1].strip().strip('"')
        elif m := re.match(r"(?:- )?Value:\s*(.*)", body):
            if m[1].strip() in ("|", ">", "|-", ">-"):
                block, depth = [], indent
            else:
                yield hint, m[1].strip().strip('"')
    if block is not None:
        yield hint, "\n".join(block)


def parse_item(path: str, text: str) -> tuple[list[dict], list[dict]]:
    """A serialised item: its template, parent, base templates, renderings with their data sources, and the items its fields name."""
    head = dict(re.findall(r'^(ID|Parent|Template|Path|Name):\s*"?([^"\n]*)"?\s*$', text, re.M))
    if not head.get("ID"):
        return [], []
    item = guid(head["ID"])
    name = head.get("Name") or head.get("Path", path).rstrip("/").split("/")[-1]
    edges = []
    if head.get("Template"):
        edges.append(edge(item, guid(head["Template"]), "BASED_ON_TEMPLATE", INFERRED))
    if head.get("Parent"):
        edges.append(edge(guid(head["Parent"]), item, "HAS_CHILD", INFERRED))
    for hint, value in yaml_fields(text):
        found = [guid(g[0]) for g in _GUID.finditer(value)]
        if hint == "__Base template":
            edges += [edge(item, g, "INHERITS_FROM", INFERRED) for g in found]
        elif hint in ("__Renderings", "__Final Renderings"):
            edges += [edge(item, guid(g), "HAS_RENDERING", INFERRED) for g in re.findall(r'\b(?:s:)?id="(\{[^"]+\})"', value)]
            edges += [edge(item, guid(g), "USES_DATASOURCE", INFERRED) for g in re.findall(r'\b(?:s:)?ds="(\{[^"]+\})"', value)]
        else:
            edges += [edge(item, g, "REFERENCES", INFERRED) for g in found if g != item]
    return [_node(item, "SitecoreItem", name, text, path)], edges


def _local(element: ET.Element) -> str:
    return element.tag.split("}")[-1]


class Declared:
    """How a configuration section names types: the elements that lead there, where the type stands, and what goes with it."""

    def __init__(self, path: str, types: str, relationship: str, **properties: str):
        self.path, self.types, self.relationship, self.properties = path.split("/"), types.split(), relationship, properties


# Sections of a configuration file (* is any element) and the relationships that graphs on disk use.  A
# property is @attribute or element() of the element at a depth of the path.
DECLARED = (
    Declared("pipelines/*/processor", "type", "REGISTERS_PROCESSOR", pipeline="1:element()"),
    Declared("services/register", "implementationType concreteType", "REGISTERS_SERVICE", serviceType="1:@serviceType", lifetime="1:@lifetime"),
    Declared("services/configurator", "type", "REGISTERS_CONFIGURATOR"),
    Declared("events/event/handler", "type", "HANDLES_EVENT", event="1:@name"),
)
SETTINGS_KEPT = 50


def _chains(at: ET.Element, most: int, above: tuple = ()) -> Iterator[tuple[ET.Element, ...]]:
    """Every way down from an element, in the order of the file, up to ``most`` elements."""
    for child in at:
        chain = (*above, child)
        yield chain
        if len(chain) < most:
            yield from _chains(child, most, chain)


def type_name(value: str | None) -> str:
    """A type without its assembly."""
    return (value or "").partition(",")[0].strip()


def parse_config(path: str, text: str) -> tuple[list[dict], list[dict]]:
    """A configuration file: processors, services, configurators and event handlers by the types that they name, and its settings."""
    try:
        top = next((e for e in ET.fromstring(text).iter() if _local(e) == "sitecore"), None)
    except ET.ParseError:
        top = None
    if top is None:
        return [], []
    edges, settings = [], []
    types: dict[str, None] = {}

    def told(chain: tuple[ET.Element, ...], where: str) -> str:
        depth, _, what = where.partition(":")
        element = chain[int(depth)]
        value = _local(element) if what == "element()" else element.get(what[1:], "")
        return type_name(value) if what.endswith("Type") else value

    for chain in _chains(top, max(len(d.path) for d in DECLARED)):
        names = [_local(e) for e in chain]
        if names == ["settings", "setting"] and chain[-1].get("name"):
            settings.append(chain[-1].get("name"))
        for d in DECLARED:
            if len(names) != len(d.path) or any(n != w for n, w in zip(names, d.path, strict=True) if w != "*"):
                continue
            full = next(filter(None, (type_name(chain[-1].get(t)) for t in d.types)), "")
            if full:
                types[full] = None
                properties = {k: told(chain, where) for k, where in d.properties.items()}
                edges.append({**edge(path, f"clrtype:{full}", d.relationship, INFERRED), "properties": properties})
    about = {"cms": "Sitecore"} | ({"settingCount": str(len(settings)), "settings": ",".join(settings[:SETTINGS_KEPT])} if settings else {})
    nodes = [{**_node(path, "SitecoreConfig", path.split("/")[-1], text, path), "properties": about}]
    for full in types:
        nodes.append({**_node(f"clrtype:{full}", "ClrType", full.rpartition(".")[2] or full, full, path), "properties": {"clrType": full}})
    return nodes, edges


def parse_component(path: str, text: str) -> tuple[list[dict], list[dict]]:
    """A component module that uses layout fields or placeholders."""
    if not re.search(r"\b(?:withDatasourceCheck|useSitecoreContext|ComponentRendering|Placeholder)\b", text):
        return [], []
    name = re.sub(r"\.[^.]*$", "", path.split("/")[-1])
    return [_node(f"xmcloud:component:{name.lower()}", "XmCloudComponent", name, text, path)], [edge(path, f"xmcloud:component:{name.lower()}", "DEFINES_COMPONENT", INFERRED)]


def parse_route(path: str, text: str) -> tuple[list[dict], list[dict]]:
    """Route data: every component in its placeholders, however deep."""
    try:
        data = json.loads(text)
    except ValueError:
        return [], []
    route = data
    for key in ("sitecore", "route"):
        route = route.get(key, route) if isinstance(route, dict) else {}
    if not isinstance(route, dict) or "placeholders" not in route:
        return [], []
    names, todo = [], [route]
    while todo:
        at = todo.pop()
        if isinstance(at, dict):
            if isinstance(at.get("componentName"), str):
                names.append(at["componentName"])
            holders = at.get("placeholders")
            todo += [c for cs in holders.values() if isinstance(cs, list) for c in cs] if isinstance(holders, dict) else []
    edges = [edge(path, f"xmcloud:component:{n.lower()}", "RENDERS_COMPONENT", INFERRED) for n in dict.fromkeys(names)]
    return [_node(path, "XmCloudRouteData", str(route.get("name") or path.split("/")[-1]), text, path)], edges


def parse_content_types(path: str, text: str) -> tuple[list[dict], list[dict]]:
    """Classes marked as content types, pages or blocks, with their virtual properties."""
    code = blank_out(text)
    nodes, edges = [], []
    for m in re.finditer(r"\[ContentType(?:Attribute)?\b[^\]]*\]\s*(?:\[[^\]]*\]\s*)*(?:\w+\s+)*class\s+(\w+)\s*(?::\s*([^{]+))?\{", code):
        kind = "OptiPageType" if "PageData" in (m[2] or "") else "OptiBlockType"
        name, depth, end = f"{path}::{m[1]}", 1, m.end()
        while end < len(code) and depth:
            depth += (code[end] == "{") - (code[end] == "}")
            end += 1
        nodes.append(_node(name, kind, m[1], text[m.start() : end], path))
        for p in re.finditer(r"\bpublic\s+virtual\s+[\w<>?\[\],.]+\s+(\w+)\s*\{", code[m.end() : end]):
            nodes.append(_node(f"{name}::{p[1]}", "OptiProperty", p[1], p[0], path))
            edges.append(edge(name, f"{name}::{p[1]}", "HAS_PROPERTY", INFERRED))
    return nodes, edges


def parse_registrations(path: str, text: str) -> tuple[list[dict], list[dict]]:
    """Module, page-type and form-component registrations by attribute or base class."""
    code = blank_out(text)
    found = []
    if re.search(r"\[\s*(?:assembly:\s*)?RegisterModule\b", code):
        # Fixed value: the name that such nodes have in graphs on disk.
        found.append(("KenticoModule", "Kentico Module Registration", f"{path}::KenticoModule"))
    for kind, base in (("KenticoPageType", r"TreeNode"), ("KenticoFormComponent", r"FormComponent<[^>]*>")):
        found += [(kind, m[1], f"{path}::{m[1]}") for m in re.finditer(rf"\bclass\s+(\w+)\s*:\s*[^{{]*\b{base}", code)]
    return [_node(i, k, n, "", path) for k, n, i in found], [edge(path, i, "CONTAINS", EXTRACTED) for _, _, i in found]
