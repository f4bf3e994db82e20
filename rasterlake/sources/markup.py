"""Element tables of SVG and XML documents (SRC-10), by a Python table function over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "doc string, node int, parent int, tag string, attrs map<string,string>, text string, path array<string>, groups array<string>, inherited map<string,string>"
#: Properties that texts take from their ancestors.
INHERITED = ("font-family", "dominant-baseline")


def parse(doc: str, xml: str | None) -> list[dict]:
    """Elements in document order; a document that can't be parsed is one row with the tag '!error'. Entity
    declarations are refused. path: ids (or tags) of the ancestors from the root; groups: ids of those that are
    groups; inherited: what the nearest ancestor that has it says of each INHERITED property."""
    rows: list[dict] = []
    stack: list[dict] = []
    parser = expat.ParserCreate()

    def start(tag: str, attrs: dict) -> None:
        own = {k.rsplit(":", 1)[-1]: v for k, v in attrs.items()}
        style = {k.strip().lower(): v.strip() for k, _, v in (p.partition(":") for p in own.pop("style", "").split(";")) if k.strip()}
        row = {"doc": doc, "node": len(rows), "parent": stack[-1]["node"] if stack else None, "tag": tag.rsplit(":", 1)[-1], "attrs": {**own, **style}, "text": "", "path": [r["attrs"].get("id", r["tag"]) for r in stack]}
        row["groups"] = [r["attrs"]["id"] for r in stack if r["tag"] == "g" and "id" in r["attrs"]]
        row["inherited"] = {k: v for k in INHERITED for v in [r["attrs"][k] for r in stack if r["attrs"].get(k)][-1:]}
        rows.append(row)
        stack.append(row)

    def refuse(*_: object) -> None:
        raise expat.ExpatError("entity declarations are refused")

    parser.StartElementHandler = start
    parser.EndElementHandler = lambda tag: stack.pop()
    parser.CharacterDataHandler = lambda data: stack[-1].__setitem__("text", stack[-1]["text"] + data) if stack else None
    parser.EntityDeclHandler = refuse
    try:
        parser.Parse(xml or "", True)
    except expat.ExpatError as e:
        return [{"doc": doc, "node": 0, "parent": None, "tag": "!error", "attrs": {}, "text": str(e), "path": [], "groups": [], "inherited": {}}]
    return rows


def elements(docs: DataFrame, doc: str, xml: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [e for d, x in zip(rows["doc"], rows["xml"], strict=True) for e in parse(d, x)]
            yield pd.DataFrame(found, columns=["doc", "node", "parent", "tag", "attrs", "text", "path", "groups", "inherited"])

    return docs.selectExpr(f"CAST(`{doc}` AS STRING) AS doc", f"`{xml}` AS xml").mapInPandas(run, SCHEMA)
