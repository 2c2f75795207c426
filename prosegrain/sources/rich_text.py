"""Rich-text trees (JSON) to plain text."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegrain.dims import fixed

_TOKEN = re.compile(r'[\s,:]*+([{}\[\]]|"(?:[^"\\]|\\.)*+"|[^\s,:{}\[\]"]++)', re.S)


def _deep(text: str):
    """A JSON value nested more deeply than the parser of the standard library goes."""
    held: list = [[]]
    for m in _TOKEN.finditer(text):
        t = m[1]
        if t in "{[":
            held.append([t])
        elif t in "}]":
            kind, *items = held.pop()
            held[-1].append(dict(zip(items[::2], items[1::2], strict=True)) if kind == "{" else items)
        else:
            held[-1].append(json.loads(t))
    (out,) = held.pop()
    return out


def tree_text(tree: str | None, blocks: frozenset[str]) -> str:
    """Blocks of one tree, joined by blank lines: each holds the text of the leaves below it, in order."""
    try:
        root = json.loads(tree or "null")
    except RecursionError:
        root = _deep(tree)
    except ValueError:
        return ""
    found: list[list[str]] = []
    todo = [(root, -1)]  # (node, the number of the outermost block that it lies in); the root is no block
    while todo:
        node, block = todo.pop()
        if not isinstance(node, dict):
            continue
        if block is None and node.get("type") in blocks:
            block = len(found)
            found.append([])
        block = None if block == -1 else block
        text = node.get("text")
        if text not in (None, "") and not isinstance(text, (dict, list)):
            if block is not None:
                found[block].append(text if isinstance(text, str) else json.dumps(text))
            continue
        content = node.get("content")
        todo.extend((child, block) for child in reversed(content if isinstance(content, list) else []))
    joined = ("".join(x).strip(" \t\n\v\f\r") for x in found)
    return "\n\n".join(x for x in joined if x)


def flatten_rich_text(docs: DataFrame, blocks=tuple(fixed.BLOCK_TYPES)) -> DataFrame:
    """(doc_id, text): blocks of the tree in docs(doc_id, tree STRING), joined by blank lines.

    A tree is walked once, inside its own row, however deep it is.
    """
    kinds = frozenset(blocks)

    @F.pandas_udf("string")
    def walked(tree: pd.Series) -> pd.Series:
        return tree.map(lambda t: tree_text(t, kinds))

    return docs.select("doc_id", walked("tree").alias("text"))
