"""Species trees in text: nested parentheses, {…} groups counted once, [label], # comments.

``parse`` reads a tree into nodes by a token stream and a stack; a species tree has some
thousand nodes, so this happens on the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..schemas import SPECIES_TREE

_TOKEN = re.compile(r"\s+|,|(?P<open>[({])|(?P<close>[)}])|\[(?P<label>[^\]]*)\]|:(?P<weight>[^\s,(){}\[\]]*)|(?P<name>[^\s,(){}\[\]:]+)")


@dataclass
class TreeNode:
    node_id: int
    parent_id: int | None
    label: str | None = None
    species: str | None = None
    once: bool = False
    weight: float = 1.0
    bits: int = 0


def parse(text: str) -> list[TreeNode]:
    """Nodes in the order of their first character; the root is 0.  Weights in the text are read and not used."""
    text = re.sub(r"#[^\n]*", "", text)
    nodes, path, last = [], [], None
    for m in _TOKEN.finditer(text):
        if m["open"] or m["name"]:
            last = TreeNode(len(nodes), path[-1].node_id if path else None)
            nodes.append(last)
            if m["open"]:
                last.once = m["open"] == "{"
                path.append(last)
            else:
                last.species = m["name"]
        elif m["close"]:
            if not path:
                raise ValueError("a tree closes more groups than it opens")
            last = path.pop()
        elif m["label"] is not None:
            (path[-1] if path and last is path[-1] else last or path[-1]).label = m["label"]
    if path:
        raise ValueError("a tree leaves groups open")
    bit = {}
    for n in nodes:
        if n.species is not None:
            n.bits = 1 << bit.setdefault(n.species, len(bit))
    for n in reversed(nodes):
        if n.parent_id is not None:
            nodes[n.parent_id].bits |= n.bits
            if nodes[n.parent_id].once:
                n.weight = 0.0
    return nodes


def load(spark: SparkSession, text: str) -> DataFrame:
    """The tree as a table, profiles in words of 63 bits."""

    def words(bits: int) -> list[int]:
        out = []
        while bits:
            out.append(bits & (1 << 63) - 1)
            bits >>= 63
        return out

    rows = [(n.node_id, n.parent_id, n.label, n.species, n.once, n.weight, words(n.bits)) for n in parse(text)]
    return spark.createDataFrame(rows, SPECIES_TREE)


def nested(rows: list[tuple[int, str, list[str]]]) -> str:
    """A tree text from a rank table: (level, name, species of that level itself) in depth-first order."""
    out, depth = [], 0
    for level, name, species in rows:
        while depth >= level:
            out.append(")")
            depth -= 1
        out.append(f"([{name}] " + " ".join(species))
        depth = level
    return " ".join(out) + " )" * depth
