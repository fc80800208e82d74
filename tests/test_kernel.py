"""The clustering kernel: hand-made splits, classic average linkage by brute force, invariants on random graphs."""

import pickle
import random

import pytest

from strandweave.kernel import component as k
from strandweave.kernel import geometry as geo
from strandweave.kernel.cutting import Cutter, duplication
from strandweave.kernel.formats import drawing, newick
from strandweave.kernel.cutting import tree_of
from strandweave.params import Params

TWO_DOMAINS = (
    [("a", "1", 500, 0), ("b", "2", 500, 0), ("c", "3", 250, 0), ("d", "4", 250, 0)],
    [("1", "2", 1, 500, 1, 500, 10, 400.0), ("1", "3", 1, 250, 1, 250, 20, 200.0), ("2", "3", 1, 250, 1, 250, 20, 210.0), ("1", "4", 251, 500, 1, 250, 20, 190.0), ("2", "4", 251, 500, 1, 250, 20, 195.0)],
)


def members(genes, hits, p):
    out = {}
    for _, root, sp, gene, dom, f, t, _ in k.rows(0, k.link(genes, hits, p))["domains"]:
        out.setdefault(root, set()).add((f"{sp}:{gene}", f, t))
    return sorted(map(sorted, out.values()))


def test_splits_two_domains():
    assert members(*TWO_DOMAINS, Params(cutoff=60)) == [
        [("a:1", 1, 250), ("b:2", 1, 250), ("c:3", 1, 250)],
        [("a:1", 251, 500), ("b:2", 251, 500), ("d:4", 1, 250)],
    ]


def test_no_break_keeps_genes_whole():
    for row in k.rows(0, k.link(*TWO_DOMAINS, Params(cutoff=60, no_break=True)))["domains"]:
        assert row[5] == 1 and row[4] == 1


def test_truncated_partner_does_not_cut():
    genes = [("a", "1", 900, 0), ("b", "2", 300, 1)]
    hits = [("1", "2", 1, 300, 1, 300, 10, 200.0)]
    assert members(genes, hits, Params(cutoff=60)) == [[("a:1", 1, 900), ("b:2", 1, 300)]]
    cut = members([genes[0], ("b", "2", 300, 0)], hits, Params(cutoff=60))
    assert cut == [[("a:1", 1, 300), ("b:2", 1, 300)]]


def test_adjacent_segments_do_not_merge_on_weak_similarity():
    g = k.link(*TWO_DOMAINS, Params(cutoff=60))
    centre, flank = next((n.id, n.parent_right) for n in g.nodes if n.parent_right is not None)
    assert g.linked(g.nodes[centre].parent, flank)


def brute(genes, scores, cutoff, miss):
    """Average linkage over all pairs, absent ones at the missing score."""
    groups = [frozenset([g]) for g in genes]

    def mean(a, b):
        return sum(scores.get(frozenset((x, y)), miss) for x in a for y in b) / (len(a) * len(b))

    while len(groups) > 1:
        linked = [(mean(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j and any(frozenset((x, y)) in scores for x in a for y in b)]
        if not linked or max(linked)[0] < cutoff:
            break
        _, i, j = max(linked)
        groups = [x for n, x in enumerate(groups) if n not in (i, j)] + [groups[i] | groups[j]]
    return {g for g in groups if len(g) > 1}


@pytest.mark.parametrize("seed", range(25))
def test_average_linkage(seed):
    rnd = random.Random(seed)
    names = [str(i) for i in range(9)]
    scores = {frozenset((a, b)): float(rnd.randrange(58_000, 200_000)) / 1000 for a in names for b in names if a < b and rnd.random() < 0.5}
    genes = [(f"s{i}", n, 300, 0) for i, n in enumerate(names)]
    hits = [(*sorted(p), 1, 300, 1, 300, 10, s) for p, s in sorted(scores.items(), key=lambda x: sorted(x[0]))]
    p = Params(cutoff=60, miss_score=57, no_break=True, min_species=1, dist_scale=1_000_000, absorb_ratio=0, min_cut_count=0, homology=True)
    got = {frozenset(x[0].split(":")[1] for x in c) for c in members(genes, hits, p)}
    assert got == brute(names, scores, 60, 57)


def random_graph(rnd, n=14):
    genes = [(f"s{rnd.randrange(5)}", str(i), rnd.randrange(120, 900), 0) for i in range(n)]
    hits, taken = [], set()
    for a in range(n):
        for b in range(a + 1, n):
            if rnd.random() < 0.3:
                la, lb = genes[a][2], genes[b][2]
                size = rnd.randrange(60, min(la, lb))
                f1, f2 = rnd.randrange(1, la - size + 2), rnd.randrange(1, lb - size + 2)
                score = 57 + rnd.randrange(1, 400_000) / 1000
                if score not in taken:
                    taken.add(score)
                    hits.append((str(a), str(b), f1, f1 + size - 1, f2, f2 + size - 1, rnd.randrange(1, 200), score))
    return genes, hits


@pytest.mark.parametrize("seed", range(60))
def test_invariants(seed):
    rnd = random.Random(seed)
    genes, hits = random_graph(rnd)
    p = Params(cutoff=60, dist_scale=100_000, min_species=1)
    g = k.link(genes, hits, p)
    state = pickle.dumps(g)
    found = k.rows(0, g)
    length = {n: l for _, n, l, _ in genes}
    by = {}
    for _, root, _, gene, dom, f, t, _ in found["domains"]:
        assert 1 <= f <= t <= length[gene]
        by.setdefault(gene, []).append((dom, f, t))
    for doms in by.values():
        assert [f for _, f, _ in sorted(doms)] == sorted(f for _, f, _ in doms)
    # A linked state that was written and read is cut the same; input order changes nothing.
    assert k.rows(0, pickle.loads(state))["domains"] == found["domains"]
    mixed = list(hits)
    rnd.shuffle(mixed)
    key = lambda rows: sorted((r[2], r[3], r[5], r[6]) for r in rows)
    assert key(k.rows(0, k.link(genes, mixed, p))["domains"]) == key(found["domains"])


@pytest.mark.parametrize("seed", range(20))
def test_components_are_independent(seed):
    rnd = random.Random(seed)
    one, two = random_graph(rnd, 8), random_graph(rnd, 8)
    two = ([(s, "x" + n, l, t) for s, n, l, t in two[0]], [("x" + a, "x" + b, *r) for a, b, *r in two[1]])
    p = Params(cutoff=60, dist_scale=100_000, min_species=1)
    apart = sorted(members(*one, p) + members(*two, p))
    assert sorted(members(one[0] + two[0], one[1] + two[1], p)) == apart


def test_duplication_rules():
    p = Params(cut_ratio=0.5).resolved()
    assert duplication(p, 0b1, 0b1, 0b1) == 0
    assert duplication(p, 0b111, 0b111, 0b110) == 1
    assert duplication(p, 0b1111, 0b0011, 0b0110) == 2  # half is not more than half
    assert duplication(Params(cut_ratio=0.5, weak_ratio=0.3).resolved(), 0b1111, 0b0111, 0b1100) == 2
    assert duplication(Params(homology=True).resolved(), 0b111, 0b111, 0b111) == 2


def test_cut_separates_paralogs():
    genes = [("a", "a1", 300, 0), ("b", "b1", 300, 0), ("a", "a2", 300, 0), ("b", "b2", 300, 0)]
    hits = [("a1", "b1", 1, 300, 1, 300, 10, 300.0), ("a2", "b2", 1, 300, 1, 300, 10, 290.0), ("a1", "a2", 1, 300, 1, 300, 10, 100.0), ("b1", "b2", 1, 300, 1, 300, 10, 100.0), ("a1", "b2", 1, 300, 1, 300, 10, 100.0), ("b1", "a2", 1, 300, 1, 300, 10, 100.0)]
    two = members(genes, hits, Params(cutoff=60))
    assert [[x[0] for x in c] for c in two] == [["a:a1", "b:b1"], ["a:a2", "b:b2"]]
    assert len(members(genes, hits, Params(cutoff=60, homology=True))) == 1


def test_trees():
    g = k.link(*TWO_DOMAINS, Params(cutoff=60))
    c: Cutter = k.cut(g)
    texts = sorted(newick(g, tree_of(c, x.roots[0], x.members)) for x in c.clusters())
    assert texts == ["(c_3#1,(a_1#1,b_2#1));", "(d_4#1,(a_1#2,b_2#2));"]
    text = drawing(g, tree_of(c, c.clusters()[0].roots[0], c.clusters()[0].members))
    assert text.count("[") == 2 and "400.0" in text


def test_geometry():
    assert geo.div(-7, 2) == -3 and geo.div(7, 2) == 3
    assert geo.moved(5, (1, 10), (101, 119)) == 109 and geo.moved(-2, (1, 10), (101, 119)) == 98 and geo.moved(12, (1, 10), (101, 119)) == 121
    assert geo.mean_region((geo.LOW, 10), 1, (5, geo.HIGH), 3) == (5, 10)
    assert geo.side((1, 10), (10, 20), 1) == -1 and geo.side((1, 10), (10, 20), 0) == 0
    with pytest.raises(ValueError):
        geo.moved(1, (3, 3), (1, 5))


def test_derived_parameters():
    p = Params().resolved()
    assert (p.cutoff, p.miss_score, p.split_cutoff) == (60.0, 57.0, 0.0)
    assert Params(cutoff=80.0).resolved().split_cutoff == 80.0
    d = Params(measure="dist").resolved()
    assert d.cutoff == 270.0 and d.miss_dist == pytest.approx(270 / 0.95) and d.miss_score == pytest.approx(57.0)
    assert Params(cutoff=0.5).resolved().dist_scale == 100 and Params(cutoff=0.5).decimals == 2


def tips(rows):
    return sorted((r[0], r[1], r[7].split(":")[1], r[8], r[9], r[10]) for r in rows["tree"] if r[7])


@pytest.mark.parametrize("seed", range(60))
def test_tips_are_the_members(seed):
    """Also where a gene has two domains in a cluster: each ends a branch of its own."""
    rnd = random.Random(seed)
    genes, hits = random_graph(rnd)
    p = Params(cutoff=60, dist_scale=100_000, min_species=1, cut_ratio=rnd.choice((0.5, 2.0)))
    found = k.rows(0, k.link(genes, hits, p))
    assert tips(found) == sorted((c, root, gene, dom, f, t) for c, root, _, gene, dom, f, t, _ in found["domains"])
    for _, root, text in found["newick"]:
        members = sorted(f"{sp}_{gene}#{dom}" for _, r, sp, gene, dom, *_ in found["domains"] if r == root)
        assert sorted(text.replace("(", " ").replace(")", " ").replace(",", " ").replace(";", " ").split()) == members


def test_some_genes_have_two_domains_in_one_cluster():
    """What the test above is about does occur in such graphs."""
    twice = 0
    for seed in range(60):
        found = k.rows(0, k.link(*random_graph(random.Random(seed)), Params(cutoff=60, dist_scale=100_000, min_species=1, homology=True)))
        held = [(r[1], r[3]) for r in found["domains"]]
        twice += len(held) - len(set(held))
        assert tips(found) == sorted((c, root, gene, dom, f, t) for c, root, _, gene, dom, f, t, _ in found["domains"])
    assert twice > 10


@pytest.mark.parametrize("seed", range(20))
def test_dump_and_restore(seed):
    rnd = random.Random(seed)
    genes, hits = random_graph(rnd)
    genes = [(f"s{i * 7}", *g[1:]) for i, g in enumerate(genes)] + [(f"t{i}", f"x{i}", 300, 0) for i in range(80)]  # more species than a word has bits
    hits += [("0", f"x{i}", 1, 100, 1, 100, 5, 90.0 + i / 7) for i in range(80)]
    p = Params(cutoff=60, dist_scale=100_000, min_species=1)
    g = k.link(genes, hits, p)
    nodes, links = k.dump(g)
    again = k.restore(nodes, links, p)
    assert k.dump(again) == (nodes, links)
    for q in (p, Params(cutoff=60, dist_scale=100_000, min_species=2, cut_ratio=0.2)):
        assert k.rows(0, k.restore(nodes, links, q), q) == k.rows(0, k.restore(*k.dump(g), q), q)
    assert k.rows(0, again) == k.rows(0, g)


def test_deep_trees():
    """A chain and a star of thousands of genes: no step goes deeper than the interpreter's stack."""
    n = 5_000
    genes = [(f"s{i}", f"g{i:05d}", 300, 0) for i in range(n)]
    chain = [(f"g{i:05d}", f"g{i + 1:05d}", 1, 300, 1, 300, 10, 1e6 - 100 * i) for i in range(n - 1)]
    p = Params(cutoff=60, min_species=1, homology=True, miss_score=59.9, dist_scale=1000)
    found = k.rows(0, k.link(genes, chain, p))
    assert len(found["domains"]) == len(tips(found)) == n and len(found["tree"]) == 2 * n - 1
    g = k.link(genes, chain, p)
    c = k.cut(g)
    text = drawing(g, tree_of(c, c.clusters()[0].roots[0], c.clusters()[0].members))
    assert text.count("\n") == 2 * n - 2
    few = 800
    star = [("g00000", f"g{i:05d}", 1, 300, 1, 300, 10, 1e6 - i) for i in range(1, few)]
    found = k.rows(0, k.link(genes[:few], star, p))
    assert len(found["domains"]) == len(tips(found)) == few
