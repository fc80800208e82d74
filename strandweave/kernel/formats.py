"""Text of clusters and trees."""

from __future__ import annotations

from .cutting import Tree
from .linkage import Linkage


def label(g: Linkage, t: Tree, mark: str = "#") -> str:
    return g.nodes[t.node].name.replace(":", "_") + f"{mark}{t.domain.number}"


def newick(g: Linkage, t: Tree, lengths: bool = False) -> str:
    """Newick; lengths are half the difference of the parent's and the node's own distance."""
    out: list[str] = []
    todo: list = [(t, None, False)]  # (tree, distance above it, whether its branches are written), or text
    while todo:
        one = todo.pop()
        if isinstance(one, str):
            out.append(one)
            continue
        x, above, written = one
        if not written and not x.domain:
            out.append("(")
            todo.append((x, above, True))
            for k, c in reversed(list(enumerate(x.children))):
                todo.append((c, x.dist, False))
                todo += [","] * (k > 0)
            continue
        out.append(label(g, x) if x.domain else ")")
        if lengths and above is not None:
            out.append(f":{(above - (x.dist or 0.0)) / 2:.1f}")
    return "".join(out) + ";"


def drawing(g: Linkage, t: Tree, decimals: int = 1) -> str:
    """A drawing of the tree, one line a leaf or inner node, scores at inner nodes."""
    lines: list[str] = []
    todo = [(t, "", True, True)]
    while todo:
        x, indent, last, top = todo.pop()
        stem = "" if top else indent + ("`-" if last else "+-")
        if x.domain:
            lines.append(f"{stem} {g.nodes[x.node].name}({x.domain.number}) {x.domain.start} {x.domain.end}")
            continue
        lines.append(f"{stem}[{x.score if g.p.by_score else x.dist:.{decimals}f}]")
        inner = indent + ("" if top else "  " if last else "| ")
        todo += [(c, inner, k == len(x.children) - 1, False) for k, c in reversed(list(enumerate(x.children)))]
    return "\n".join(lines)
