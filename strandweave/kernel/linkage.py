"""Average linkage that splits sequences where alignments say they hold several domains.

Nodes are genes, or segments made by merges: a centre from the aligned parts of two
nodes, and flanks from what overhangs.  Edges carry an alignment region on each side.
The edge of the best bucket is merged next; edges of the two merged nodes become edges of
the new ones, a missing edge counting with the missing value.
"""

from __future__ import annotations

import heapq
import struct
from collections import deque
from collections.abc import Iterable
from dataclasses import dataclass, field

from ..params import Params
from .geometry import HIGH, LOW, Region, consistent, hull, known, least_overlap, mean, mean_region, meets, moved_region, shared, side, size

LEAF, CENTRE, FLANK1, FLANK2 = 0, 1, 2, 3
#: Order of a merge's new nodes: centre, left of the first and second, right of the first and second.
SLOTS = 5


@dataclass(slots=True)
class Link:
    """Two segments that follow each other on ``count`` genes; status 0: live, 1: replaced, 2: deleted."""

    left: int
    right: int
    count: int
    status: int = 0


@dataclass(slots=True)
class Node:
    id: int
    name: str
    count: int
    length: int
    core: Region
    species: int
    trunc: int = 0
    kind: int = LEAF
    child: Edge | None = None
    parent: int | None = None
    parent_left: int | None = None
    parent_right: int | None = None
    cut: Region = (LOW, HIGH)
    joined: Region = (LOW, HIGH)
    gone: bool = False  # merged into another node, and not (yet) a root again
    deleted: bool = False
    absorbed: str = ""  # "L" or "R": the side it was merged from
    centre_root: bool = False
    left: dict[int, Link] = field(default_factory=dict)
    right: dict[int, Link] = field(default_factory=dict)

    @property
    def flank(self) -> bool:
        return self.kind in (FLANK1, FLANK2)

    @property
    def children(self) -> tuple[int, ...]:
        if self.child is None:
            return ()
        return {CENTRE: (self.child.n1, self.child.n2), FLANK1: (self.child.n1,), FLANK2: (self.child.n2,)}[self.kind]


@dataclass(slots=True, eq=False)
class Edge:
    n1: int
    n2: int
    a1: Region
    a2: Region
    dist: float
    score: float
    dead: bool = False

    def other(self, n: int) -> int:
        return self.n2 if n == self.n1 else self.n1

    def seen_from(self, n: int) -> tuple[Region, Region]:
        """(region on n, region on the other)."""
        return (self.a1, self.a2) if n == self.n1 else (self.a2, self.a1)


class Buckets:
    """Edges by rounded measure: the best bucket first; by score the newest of it, by distance the oldest."""

    def __init__(self, p: Params, low: float):
        self.p, self.low, self.held, self.heap = p, low, {}, []

    def push(self, e: Edge) -> None:
        value = e.score if self.p.by_score else e.dist
        k = round((value - self.low) * self.p.dist_scale)
        if k not in self.held:
            self.held[k] = deque()
            heapq.heappush(self.heap, -k if self.p.by_score else k)
        self.held[k].append(e)

    def pop(self) -> Edge | None:
        while self.heap:
            k = -self.heap[0] if self.p.by_score else self.heap[0]
            held = self.held[k]
            while held:
                e = held.pop() if self.p.by_score else held.popleft()
                if not e.dead:
                    return e
            del self.held[k]
            heapq.heappop(self.heap)
        return None


_FLOAT = struct.Struct("f")


def single(x: float) -> float:
    """x as a 32-bit float has it."""
    return _FLOAT.unpack(_FLOAT.pack(x))[0]


class Linkage:
    """The graph of one component, and its agglomeration."""

    def __init__(self, p: Params, low: float | None = None):
        self.p = p.resolved()
        self.nodes: list[Node] = []
        self.edges: list[dict[int, Edge]] = []
        self.queue = Buckets(self.p, (self.p.miss_score if low is None else low) - 1)
        self.leaves = 0
        self.species: list[str] = []  # by bit

    def add(self, **values) -> Node:
        n = Node(len(self.nodes), **values)
        self.nodes.append(n)
        self.edges.append({})
        return n

    def leaf(self, name: str, length: int, species: int, trunc: int = 0) -> Node:
        n = self.add(name=name, count=1, length=length, core=(1, length), species=species, trunc=0 if self.p.ignore_truncation else trunc)
        self.leaves = len(self.nodes)
        return n

    def connect(self, n1: int, n2: int, a1: Region, a2: Region, dist: float, score: float) -> Edge:
        if n1 > n2:
            n1, n2, a1, a2 = n2, n1, a2, a1
        e = Edge(n1, n2, a1, a2, single(dist), single(score))
        self.edges[n1][n2] = self.edges[n2][n1] = e
        return e

    def measure(self, e: Edge) -> float:
        return e.score if self.p.by_score else e.dist

    def better(self, a: float, b: float) -> bool:
        return a > b if self.p.by_score else a < b

    def link(self, left: int, right: int, count: int, status: int = 0) -> Link:
        """Adds to the count of the link from left to right."""
        found = self.nodes[left].right.get(right)
        if found is None:
            found = Link(left, right, 0, status)
            self.nodes[left].right[right] = self.nodes[right].left[left] = found
        found.count += count
        return found

    def linked(self, a: int, b: int) -> bool:
        return b in self.nodes[a].right or b in self.nodes[a].left

    def run(self) -> None:
        for held in self.edges:
            for other, e in held.items():
                if e.n1 != other and not e.dead:
                    self.queue.push(e)
        while (e := self.queue.pop()) is not None:
            if self.better(self.p.cutoff, self.measure(e)):
                return
            if self.linked(e.n1, e.n2) and self.better(self.p.split_cutoff, self.measure(e)):
                self.drop(e)
                continue
            self.merge(e)

    def drop(self, e: Edge) -> None:
        e.dead = True
        self.edges[e.n1].pop(e.n2, None)
        self.edges[e.n2].pop(e.n1, None)

    def merge(self, best: Edge) -> None:
        a, b = self.nodes[best.n1], self.nodes[best.n2]
        thirds = [Third(self, best, k) for k in sorted((self.edges[a.id].keys() | self.edges[b.id].keys()) - {a.id, b.id})]
        shape = Shape(self, best, thirds)
        new = self.new_nodes(best, shape)
        made: list[Edge] = []
        counts = [(a.count * (k in (0, 1, 3)), b.count * (k in (0, 2, 4))) for k in range(SLOTS)]
        # Where a third has an edge to one of the two nodes, its new alignments follow from that edge's regions alone.
        seen: dict[tuple, list] = {}
        for t in thirds:
            key = None if t.both else (t.a13, t.a31, t.a23, t.a32, t.spurious)
            found = None if key is None else seen.get(key)
            if found is None:
                found = [(k, *x) for k, x in t.alignments(shape).items() if new[k] is not None]
                if key is not None:
                    seen[key] = found
            for k, on_new, on_third in found:
                n, m = counts[k]
                dist = single((t.dist1 * n + t.dist2 * m) / (n + m))
                score = single((t.score1 * n + t.score2 * m) / (n + m))
                made.append(self.connect(new[k].id, t.node.id, on_new, on_third, dist, score))
        a.gone = b.gone = True
        for t in thirds:
            for e in (t.e1, t.e2):
                if e is not None:
                    self.drop(e)
        self.drop(best)
        for e in made:
            self.queue.push(e)

    def new_nodes(self, best: Edge, s: Shape) -> list[Node | None]:
        a, b = self.nodes[best.n1], self.nodes[best.n2]
        a.cut, a.joined, b.cut, b.joined = s.break1, s.bound1, s.break2, s.bound2
        centre = self.add(name=a.name, count=a.count + b.count, length=size(s.whole), core=s.core, species=a.species | b.species, trunc=a.trunc & b.trunc, kind=CENTRE, child=best)
        out: list[Node | None] = [centre]
        for cut, right in ((0, False), (1, True)):
            for n, brk, kind in ((a, s.break1, FLANK1), (b, s.break2, FLANK2)):
                at = brk[cut]
                core = (1, n.core[1] - at) if right else (n.core[0], at - 1)
                if not known(at) or size(core) < self.p.min_len:
                    out.append(None)
                    continue
                length = n.length - at + 1 if right else at - 1
                out.append(self.add(name=n.name, count=n.count, length=length, core=core, species=n.species, trunc=n.trunc & (1 if right else 2), kind=kind, child=best))
        a.parent = b.parent = centre.id
        # Neighbours on a side go to that side's flank, or to the centre where there is none.
        for right, (fa, fb) in ((False, (out[1], out[2])), (True, (out[3], out[4]))):
            if fa is None and fb is None:
                self.inherit(centre, right, a, b)
            else:
                self.inherit(fa or centre, right, a)
                self.inherit(fb or centre, right, b)
        for k, n in ((1, a), (2, b)):
            if out[k] is not None:
                self.link(out[k].id, centre.id, n.count)
                n.parent_left = out[k].id
        for k, n in ((3, a), (4, b)):
            if out[k] is not None:
                self.link(centre.id, out[k].id, n.count)
                n.parent_right = out[k].id
        return out

    def inherit(self, new: Node, right: bool, *old: Node) -> None:
        """Links of the old nodes on a side become the new one's; common neighbours add up."""
        own = {n.id for n in old}
        held = sorted({k for n in old for k in (n.right if right else n.left)})
        for k in held:
            links = [l for n in old if (l := (n.right if right else n.left).get(k)) and not l.status]
            if k in own or not links:
                continue
            for l in links:
                l.status = 1
            total = sum(l.count for l in links)
            self.link(new.id, k, total) if right else self.link(k, new.id, total)


class Third:
    """A node that has an edge to one or both of the nodes that are merged."""

    __slots__ = ("a13", "a23", "a31", "a32", "best", "both", "dist1", "dist2", "e1", "e2", "g", "node", "score1", "score2", "spurious")

    def __init__(self, g: Linkage, best: Edge, third: int):
        p = g.p
        self.g, self.best, self.node = g, best, g.nodes[third]
        self.e1, self.e2 = g.edges[best.n1].get(third), g.edges[best.n2].get(third)
        self.a13, self.a31 = self.e1.seen_from(best.n1) if self.e1 else (None, None)
        self.a23, self.a32 = self.e2.seen_from(best.n2) if self.e2 else (None, None)
        self.score1, self.dist1 = (self.e1.score, self.e1.dist) if self.e1 else (p.miss_score, p.miss_dist)
        self.score2, self.dist2 = (self.e2.score, self.e2.dist) if self.e2 else (p.miss_score, p.miss_dist)
        self.both = self.e1 is not None and self.e2 is not None
        # The third follows one of the two on a gene and is similar to the other elsewhere: not the same domain.
        self.spurious = False
        if self.e1 and not self.e2 and g.linked(best.n2, third):
            self.spurious = meets(self.a13, best.a1, p) != 0
        elif self.e2 and not self.e1 and g.linked(best.n1, third):
            self.spurious = meets(self.a23, best.a2, p) != 0

    def agrees(self) -> bool:
        return consistent(self.best.a1, self.best.a2, self.a13, self.a31, self.a23, self.a32, self.g.p)

    def votes(self, brk1: Region, brk2: Region) -> tuple[int, int] | None:
        """On which side of the breaks the third's alignments lie; None: it has no say."""
        p, g = self.g.p, self.g
        floor = max(p.split_cutoff, (p.split_per_length or 0) * self.node.length)
        out = [0, 0]
        for k, (e, here, there, brk, partner) in enumerate(((self.e1, self.a13, self.a31, brk1, self.best.n2), (self.e2, self.a23, self.a32, brk2, self.best.n1))):
            if e is None:
                continue
            out[k] = meets(here, brk, p)
            if out[k] == 0 or g.linked(partner, self.node.id):
                continue
            weak = floor > e.score or bool(p.split_dist) and p.split_dist < e.dist
            if g.better(p.cutoff, g.measure(e)) or size(there) < self.node.length * p.coverage or weak:
                return None
        return out[0], out[1]

    def hits(self, s: Shape) -> dict[int, int]:
        """New nodes that the third's alignments overlap: slot to 1, 2 or 3 (first, second, both)."""
        p, out = self.g.p, {}
        for k, (here, brk, length) in enumerate(((self.a13, s.cut1, s.n1.length), (self.a23, s.cut2, s.n2.length)), 1):
            if here is None:
                continue
            if here[0] < brk[0] and meets((1, brk[0] - 1), here, p) == 0:
                out[k] = k
            if meets((max(brk[0], 1), min(brk[1], length)), here, p) == 0:
                out[0] = out.get(0, 0) + k
            if brk[1] < here[1] and meets((brk[1] + 1, length), here, p) == 0:
                out[k + 2] = k
        if self.spurious:
            out.pop(0, None)
        return out

    def alignments(self, s: Shape) -> dict[int, tuple[Region, Region]]:
        """slot to (region on the new node, region on the third)."""
        g, p, best = self.g, self.g.p, self.best
        hits = self.hits(s)
        if not hits:
            return {}
        first = self.both and g.better(g.measure(self.e1), g.measure(self.e2))
        agree = self.both and self.agrees()
        m1 = moved_region(s.break1, self.a13, self.a31) if self.e1 else None
        m2 = moved_region(s.break2, self.a23, self.a32) if self.e2 else None
        if self.both:
            if agree:
                brk3 = mean_region(m1, s.n1.count, m2, s.n2.count)
            else:
                x, y = (m1, m2) if first else (m2, m1)
                brk3 = (x[0] if known(x[0]) else y[0]), (x[1] if known(x[1]) else y[1])
        else:
            brk3 = m1 or m2

        def wide(r: Region, *of: Region | None) -> bool:
            return all(o is None or size(r) >= least_overlap(size(s.whole), size(o), p) for o in of)

        out: dict[int, tuple[Region, Region]] = {}
        if 0 in hits and (found := self.centre(s, brk3, agree, first)):
            if wide(found[1], self.a31, self.a32) and wide(found[0], self.a13, self.a23):
                out[0] = found
        for k, (here, there, brk) in ((1, (self.a13, self.a31, s.break1)), (2, (self.a23, self.a32, s.break2))):
            if k in hits:
                on3, on = (there[0], min(there[1], brk3[0] - 1)), (here[0], min(here[1], brk[0] - 1))
                if wide(on3, there) and wide(on, here):
                    out[k] = on, on3
            if k + 2 in hits:
                on3, on = (max(there[0], brk3[1] + 1), there[1]), (max(here[0] - brk[1], 1), here[1] - brk[1])
                if wide(on3, there) and wide(on, here):
                    out[k + 2] = on, on3
        return {k: ((max(on[0], 1) if on[0] < 0 else on[0], on[1]), on3) for k, (on, on3) in sorted(out.items()) if not on[0] < 0 > on[1]}

    def centre(self, s: Shape, brk3: Region, agree: bool, first: bool) -> tuple[Region, Region] | None:
        best = self.best
        on1 = moved_region(self.a13, best.a1, s.middle) if self.e1 else None
        on2 = moved_region(self.a23, best.a2, s.middle) if self.e2 else None
        if self.both:
            if side(self.a31, brk3, 1) or side(self.a32, brk3, 1):
                return None
            t1, t2 = shared(self.a31, brk3), shared(self.a32, brk3)
            if not agree:
                on, on3 = (on1, t1) if first else (on2, t2)
            else:
                on, on3 = list(hull(on1, on2)), hull(t1, t2)
                mid, mid3 = mean_region(on1, s.n1.count, on2, s.n2.count), mean_region(t1, s.n1.count, t2, s.n2.count)
                for k in (0, 1):  # ends that nearly agree on the third are set by their mean
                    if abs(t1[k] - t2[k]) <= 10:
                        on[k] = mid[k] + on3[k] - mid3[k]
                on = on[0], on[1]
        else:
            on, there = (on1, self.a31) if self.e1 else (on2, self.a32)
            if side(there, brk3, 1):
                return None
            on3 = shared(there, brk3)
        return None if side(on, s.whole, 1) else (shared(on, s.whole), on3)


class Shape:
    """Where two merged nodes are cut, and the coordinates of the new centre."""

    def __init__(self, g: Linkage, best: Edge, thirds: Iterable[Third]):
        p = g.p
        self.n1, self.n2 = a, b = g.nodes[best.n1], g.nodes[best.n2]
        brk1, brk2 = best.a1, best.a2
        both = [t for t in thirds if t.both]
        while not p.no_extend:
            ext = [*brk1, *brk2]
            for t in both:
                if meets(t.a13, brk1, p) or meets(t.a23, brk2, p):
                    continue
                if (t.a13[0] >= brk1[0] or t.a23[0] >= brk2[0]) and (t.a13[1] <= brk1[1] or t.a23[1] <= brk2[1]):
                    continue
                if not t.agrees():
                    continue
                on2, on1 = moved_region(t.a13, best.a1, best.a2), moved_region(t.a23, best.a2, best.a1)
                ext = [min(ext[0], max(t.a13[0], on1[0])), max(ext[1], min(t.a13[1], on1[1])), min(ext[2], max(t.a23[0], on2[0])), max(ext[3], min(t.a23[1], on2[1]))]
            if ext == [*brk1, *brk2]:
                break
            brk1, brk2 = (ext[0], ext[1]), (ext[2], ext[3])
        self.bound1, self.bound2 = brk1, brk2
        cuts = {(k, s): 0 for k in (0, 1) for s in (-1, 1)}
        for t in thirds:
            v = t.votes(brk1, brk2)
            if v is None or t.both and v[0] == v[1]:
                continue
            for k in (0, 1):
                if v[k]:
                    cuts[k, v[k]] += t.node.count
        self.break1, self.cut1 = self._cut(p, a, b, brk1, brk2, cuts, 0)
        self.break2, self.cut2 = self._cut(p, b, a, brk2, brk1, cuts, 1)
        c1, c2 = self.cut1, self.cut2
        length = mean(size(best.a1), a.count, size(best.a2), b.count)
        start = 1 + max(best.a1[0] - c1[0], best.a2[0] - c2[0])
        self.middle = middle = start, start + length - 1
        self.whole = 1, middle[1] + max(c1[1] - best.a1[1], c2[1] - best.a2[1])
        core = 1 + max(self.bound1[0] - c1[0], self.bound2[0] - c2[0])
        self.core = core, core + mean(size(self.bound1), a.count, size(self.bound2), b.count) - 1

    @staticmethod
    def _cut(p: Params, n: Node, partner: Node, brk: Region, other: Region, cuts: dict, k: int) -> tuple[Region, Region]:
        """(break points, cut region) of a node: an end is cut if enough others end there, or if what overhangs is long."""
        if p.no_break or size(brk) < p.min_len and size(other) < p.min_len:
            return (LOW, HIGH), (1, n.length)
        points, region = [LOW, HIGH], [1, n.length]
        for end, over, bit, votes in ((0, brk[0] - n.core[0], 2, cuts[k, -1]), (1, n.core[1] - brk[1], 1, cuts[k, 1])):
            if partner.trunc & bit:
                continue
            if votes >= p.min_cut_count and over >= p.min_len or over >= p.min_len2:
                points[end] = region[end] = brk[end]
        return (points[0], points[1]), (region[0], region[1])
