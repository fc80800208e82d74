"""One component from rows to rows."""

from __future__ import annotations

import pandas as pd

from ..params import Params
from .cutting import Cutter, Tree, tree_of
from .formats import newick
from .linkage import LEAF, Edge, Linkage


def link(genes: list[tuple], hits: list[tuple], p: Params, low: float | None = None) -> Linkage:
    """genes: (species, gene, length, trunc); hits: (gene1, gene2, from1, to1, from2, to2, dist, score), in their order of input."""
    g = Linkage(p, low)
    bits: dict = {}
    at = {}
    for species, gene, length, trunc in genes:
        at[gene] = g.leaf(f"{species}:{gene}", int(length), 1 << bits.setdefault(species, len(bits)), int(trunc)).id
    g.species = list(bits)
    for a, b, f1, t1, f2, t2, dist, score in hits:
        if a != b:
            g.connect(at[a], at[b], (int(f1), int(t1)), (int(f2), int(t2)), dist, score)
    g.run()
    return g


#: A dumped node and link, as fields of rows.  Species are numbers of the component's list; child and measures are those of
#: the merge that made the node; unknown parents are null.
NODE = ("id", "name", "count", "length", "core_from", "core_to", "species", "trunc", "kind", "child1", "child2", "dist", "score", "parent", "parent_left",
        "parent_right", "cut_from", "cut_to", "joined_from", "joined_to", "gone")
LINK = ("left", "right", "count", "status")
_BITS = 62


def dump(g: Linkage) -> tuple[list[dict], list[dict]]:
    """(nodes, links) of a linked component, from which ``restore`` makes it again."""
    nodes = []
    for n in g.nodes:
        words, bits = [], n.species
        while bits:
            words.append(bits & (1 << _BITS) - 1)
            bits >>= _BITS
        c = n.child
        values = (n.id, n.name, n.count, n.length, *n.core, words, n.trunc, n.kind, c and c.n1, c and c.n2, c and c.dist, c and c.score,
                  n.parent, n.parent_left, n.parent_right, *n.cut, *n.joined, n.gone)
        nodes.append(dict(zip(NODE, values, strict=True)))
    links = [dict(zip(LINK, (l.left, l.right, l.count, l.status), strict=True)) for n in g.nodes for l in n.right.values()]
    return nodes, links


def restore(nodes: list[dict], links: list[dict], p: Params) -> Linkage:
    """The linked component of a dump; its edges are gone, as cutting asks only for those that merges took."""
    g = Linkage(p, 0.0)
    for r in nodes:
        bits = sum(w << _BITS * k for k, w in enumerate(r["species"]))
        child = None if r["child1"] is None else Edge(r["child1"], r["child2"], (0, 0), (0, 0), r["dist"], r["score"], True)
        n = g.add(name=r["name"], count=r["count"], length=r["length"], core=(r["core_from"], r["core_to"]), species=bits, trunc=r["trunc"], kind=r["kind"], child=child,
                  parent=r["parent"], parent_left=r["parent_left"], parent_right=r["parent_right"], cut=(r["cut_from"], r["cut_to"]), joined=(r["joined_from"], r["joined_to"]), gone=r["gone"])
        if n.kind == LEAF:
            g.leaves = n.id + 1
            species = n.name.partition(":")[0]
            if species not in g.species:  # numbered in the order of the leaves, as link does
                g.species.append(species)
    for r in links:
        g.link(r["left"], r["right"], r["count"], r["status"])
    return g


def cut(g: Linkage, p: Params | None = None) -> Cutter:
    """Clusters of a linked component; other parameters than the linkage's may decide the cuts."""
    if p is not None:
        g.p = p.resolved()
    c = Cutter(g)
    c.cut_all()
    if c.p.absorb_ratio >= 0.99999999:
        c.absorb_all()
    if c.p.outgroup:
        c.drop_outgroup(sum(1 << k for k, name in enumerate(g.species) if name in c.p.outgroup))
    c.drop_small()
    return c


def rows(component: int, g: Linkage, p: Params | None = None) -> dict[str, list[tuple]]:
    """Tables of one component: domains, tree, newick; a cluster's id is its root node's number."""
    c = cut(g, p)
    out: dict[str, list[tuple]] = {"domains": [], "tree": [], "newick": []}
    for cl in c.clusters():
        root = cl.roots[0]
        for d in cl.members:
            species, _, gene = g.nodes[d.leaf].name.partition(":")
            out["domains"].append((component, root, species, gene, d.number, d.start, d.end, 0))
        for top in cl.roots:  # a cluster that others were merged into has a tree of each
            t = tree_of(c, top, cl.members)
            if t is None:
                continue
            todo: list[tuple[Tree, int | None, int]] = [(t, None, 0)]
            while todo:
                x, parent, side = todo.pop()
                d = x.domain
                # A leaf's row is named by its gene and domain; the same leaf can end several branches.
                out["tree"].append((component, root, x.node, parent, side, x.score, x.dist, g.nodes[x.node].name if d else None, d.number if d else None, d.start if d else None, d.end if d else None))
                todo += [(c_, x.node, k) for k, c_ in reversed(list(enumerate(x.children)))]
            out["newick"].append((component, root, newick(g, t, not c.p.by_score)))
    return out


def frame(kind: str, found: dict[str, list[tuple]]) -> pd.DataFrame:
    columns = {
        "domains": ["component", "cluster_id", "species", "gene", "dom", "from", "to", "subgroup"],
        "tree": ["component", "cluster_id", "node_id", "parent_id", "side", "score", "dist", "gene", "dom", "from", "to"],
        "newick": ["component", "cluster_id", "newick"],
    }[kind]
    return pd.DataFrame(found[kind], columns=columns)
