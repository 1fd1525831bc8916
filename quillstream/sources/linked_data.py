"""JSON-LD scripts of a page as nodes in source order."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nested import parse, unreadable

# Keys of which a node has one.
NODE_KEYS = ("@type", "@id", "headline", "name", "description", "url", "image", "thumbnailUrl")
GRAPH = T.StructType([
    T.StructField("nodes", T.ArrayType(T.StringType())), T.StructField("malformed", T.IntegerType()), T.StructField("limit_reached", T.BooleanType()),
])


@dataclass(frozen=True)
class Limits:
    """How much of a page's graph is walked."""

    nodes: int = 250
    visited: int = 4000
    depth: int = 64
    characters: int = 524_288


def _units(text: str) -> int:
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def collect(scripts: list[str | None], limits: Limits) -> dict:
    """Nodes in pre-order and source key order over all scripts; of nodes with
    one ``@id`` the first counts, though what is below the others counts too.
    A script that goes beyond the characters ends the walk."""
    import json

    nodes, malformed, limited, visited, spent = [], 0, False, 0, 0
    seen: set[str] = set()
    for k, text in enumerate(scripts):
        if text is None or not text.strip():
            continue
        spent += _units(text)
        if spent > limits.characters:
            limited = True
            break
        value = parse(text)
        if value is unreadable or value is None:
            malformed += 1
            continue
        stack = [(value, 0)]
        while stack:
            item, depth = stack.pop()
            if visited >= limits.visited or len(nodes) >= limits.nodes:
                limited = True
                break
            if depth > limits.depth:
                limited = True
                continue
            visited += 1
            if isinstance(item, dict):
                if any(key in item for key in NODE_KEYS):
                    name = item.get("@id")
                    name = name.strip() if isinstance(name, str) else ""
                    if not name or name not in seen:
                        seen.add(name)
                        nodes.append(json.dumps(item, ensure_ascii=False))
                children = [v for v in item.values() if isinstance(v, (dict, list))]
            else:
                children = [v for v in item if isinstance(v, (dict, list))] if isinstance(item, list) else []
            stack.extend((c, depth + 1) for c in reversed(children))
        if limited and (visited >= limits.visited or len(nodes) >= limits.nodes):
            break
    return {"nodes": nodes, "malformed": malformed, "limit_reached": limited}


def graph_of(elements: Column, limits: Limits = Limits()) -> Column:
    """The graph of a page's elements."""

    @F.pandas_udf(GRAPH)
    def walk(scripts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([collect(list(s) if s is not None else [], limits) for s in scripts], columns=["nodes", "malformed", "limit_reached"])

    kind = lambda e: F.lower(e["attrs"]["type"])
    scripts = F.filter(elements, lambda e: (e["tag"] == "script") & (kind(e).contains("ld+json") | kind(e).contains("json+ld")))
    return walk.asNondeterministic()(F.transform(scripts, lambda e: e["text"]))
