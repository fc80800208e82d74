"""Page regions: hand-made pages, a version over trees by plain recursion, and time on hostile pages."""

import html
import math
import random
import time

import pytest

from strandweave.llm import htmltext as h

PARAGRAPHS = [f"This is paragraph number {k} of the article, and it goes on for some time to say what it has to say about topic {k}." for k in range(20)]


def ps(*which):
    return "".join(f"<p>{PARAGRAPHS[k]}</p>" for k in which)


def text(*which):
    return " ".join(PARAGRAPHS[k] for k in which)


MENU = "<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>"

CASES = {
    "two articles": (MENU + f"<article>{ps(0, 1, 2)}</article><article>{ps(3)}</article><footer>foot</footer>", text(0, 1, 2, 3)),
    "teaser before a long body": (f"<article class=card><h3><a href=/x>Other story</a></h3><p>Short teaser.</p></article><div id=content>{ps(*range(20))}</div>", text(*range(20))),
    "unnamed teaser before a long body": (f"<article><p>Short teaser of it.</p></article><div>{ps(*range(20))}</div>", text(*range(20))),
    "legal and social inside an article": (f"<article>{ps(0, 1)}<div class=legal>{ps(2)}</div><div class=social>{ps(3)}</div>{ps(4)}</article>", text(0, 1, 2, 3, 4)),
    "social links inside an article": (f"<article>{ps(0, 1)}<div class=social><a href=1>Post</a> <a href=2>Pin</a></div>{ps(4)}</article>", text(0, 1, 4)),
    "advert and comments inside an article": (f"<article>{ps(0, 1)}<div class=ad>{ps(5)}</div>{ps(2)}<section id=comments>{ps(6, 7)}</section></article>", text(0, 1, 2)),
    "wrapper with a listed word": (f"<div class='long-form'>{ps(0, 1, 2)}</div><div class='card'><p>More.</p></div>", text(0, 1, 2)),
    "names of other elements": (f"<div class='post has-comments with-sidebar'>{ps(0, 1, 2)}</div><div class=comments>{ps(9)}</div>", text(0, 1, 2)),
    "article named by a mark": (f"<article class='sponsored'>{ps(0, 1, 2)}</article>", text(0, 1, 2)),
    "comments as articles": (f"<article>{ps(0, 1, 2)}</article><article class=comment>{ps(7, 8)}</article><article class=comment>{ps(9)}</article>", text(0, 1, 2)),
    "article header and aside": (f"<article><header><h1>Title of it</h1></header>{ps(0)}<aside>{ps(1)}</aside>{ps(2)}</article>", "Title of it " + text(0, 2)),
    "short paragraphs": (f"<article><h1>T</h1>{ps(0)}<p>Yes.</p>{ps(1)}<ul><li>One<li>Two</ul></article>", f"T {text(0)} Yes. {text(1)} One Two"),
    "nested articles": (f"<article>{ps(0)}<article>{ps(1)}</article>{ps(2)}</article>", text(0, 1, 2)),
    "a notice below": (f"<div>{ps(0, 1, 2)}</div><div class=copyright>{ps(3)}</div>", text(0, 1, 2)),
}


@pytest.mark.parametrize("name", CASES)
def test_regions(name):
    page, want = CASES[name]
    assert h.extract(f"<!DOCTYPE html><html><head><title>t</title></head><body>{page}</body></html>") == want


# Trees: (tag, class, children); text children are strings.


def random_tree(rnd, depth=0):
    kids = []
    for _ in range(rnd.randint(1, 5)):
        x = rnd.random()
        if x < 0.55 or depth > 4:
            words = " ".join(rnd.choice("alpha beta gamma delta of the in it".split()) for _ in range(rnd.choice((1, 2, 8, 30))))
            kids.append(("p", "", [("a", "", [words])] if rnd.random() < 0.3 else [words]))
        else:
            tag = rnd.choice("div div section article nav aside footer main".split())
            kids.append((tag, rnd.choice(("", "", "", "content", "ad", "comments", "legal", "card", "has-sidebar post")), random_tree(rnd, depth + 1)))
    return kids


def page_of(kids):
    return "".join(k if isinstance(k, str) else f"<{k[0]}" + (f' class="{k[1]}"' if k[1] else "") + f">{page_of(k[2])}</{k[0]}>" for k in kids)


def plain_extract(kids):
    """The docstring over a tree, with whole paths held by each line."""
    lines = []  # text, linked, path of elements
    count = [0]

    def walk(kids, path):
        for tag, cls, inner in kids:
            count[0] += 1
            me = (count[0], tag, cls)
            words = {w for one in cls.split() if one.split("-")[0] not in h.OTHERS for w in one.split("-")}
            if tag in h.SKIPPED:
                continue
            if tag == "p":
                link = inner[0] if not isinstance(inner[0], str) else None
                t = link[2][0] if link else inner[0]
                lines.append((t, len(t) if link else 0, 4 if link else 2, [*path]))
            else:
                kind = h.STRONG if words & h.NAMES else h.WEAK if words & h.DOUBTFUL else h.PLAIN
                walk(inner, [*path, (me, kind)])

    walk(kids, [((0, "body", ""), h.PLAIN)])
    if not lines:
        return ""
    raw = [(len(t) - linked) / tags for t, linked, tags, _ in lines]
    smooth = []
    for i in range(len(raw)):
        near = [(math.exp(-((i - j) ** 2) / 2), raw[j]) for j in range(max(0, i - 3), min(len(raw), i + 4))]
        smooth.append(sum(w * x for w, x in near) / sum(w for w, _ in near))
    mean = sum(smooth) / len(smooth)
    bar = min(math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth)), max(smooth))
    if any(abs(x - bar) < 1e-9 for x in smooth):
        return None  # a tie by rounding
    content = [x >= bar for x in smooth]
    total = sum(len(t) for t, *_ in lines)
    article = [next((e[0] for e, _ in path if e[1] == "article"), None) for *_, path in lines]
    section = [next(e[0] for e, _ in reversed(path) if e[1] in h.SECTIONS) for *_, path in lines]

    def select(strict):
        def left_out(path):
            for depth, (e, kind) in enumerate(path):
                if not kind:
                    continue
                own = [k for k, (*_, p) in enumerate(lines) if (e, kind) in p]
                wraps = 2 * sum(len(lines[k][0]) for k in own) > total
                inside = any(x[1] == "article" for x, _ in path[:depth])
                if (strict or not wraps) if kind == h.STRONG else not wraps and (not inside or sum(len(lines[k][0]) - lines[k][1] for k in own) < bar * max(1, sum(lines[k][2] for k in own))):
                    return True
            return False

        kept = [k for k, (*_, path) in enumerate(lines) if not left_out(path)]
        votes = {}
        for k in kept:
            if content[k]:
                votes[article[k]] = votes.get(article[k], 0) + len(lines[k][0])
        if not votes:
            return [lines[k][0] for k in kept]
        rest = 2 * votes.get(None, 0) >= sum(votes.values())
        good = {section[k] for k in kept if content[k] and article[k] is None}
        return [lines[k][0] for k in kept if (votes.get(article[k], 0) >= 0.1 * max(votes.values()) and votes.get(article[k], 0) if article[k] is not None else rest and section[k] in good)]

    found = select(True)
    named = any(kind for *_, path in lines for _, kind in path)
    if named and sum(map(len, found)) < 0.1 * total:
        found = select(False)
    return " ".join(found)


@pytest.mark.parametrize("seed", range(300))
def test_plain_version(seed):
    tree = random_tree(random.Random(seed))
    want = plain_extract(tree)
    if want is not None:
        assert h.extract(f"<body>{page_of(tree)}</body>") == " ".join(want.split())


@pytest.mark.parametrize("page", [
    "<div>" * 100_000 + "end", "<div>x" * 50_000, "<li><div>" * 50_000, "<div>" * 50_000 + "<li>a" * 50_000, "<p>a</i></b></span>" * 30_000, "<span class=ad><b>" * 30_000 + "</i>" * 30_000,
    "<ul><li>" * 30_000 + "</table>" * 30_000, "<article><div class=ad>" * 30_000 + "deep", "<a>" * 50_000 + "text" + "</a>" * 50_000,
], ids=range(9))
def test_hostile_pages_take_linear_time(page):
    half = page[: len(page) // 2]
    t = time.process_time()
    h.extract(half)
    a = time.process_time() - t
    t = time.process_time()
    h.extract(page)
    b = time.process_time() - t
    assert b < 10 and b < 5 * a + 1


def test_precision_and_recall_on_mixed_pages():
    """Words of the article against words of everything else, over made-up pages."""
    rnd = random.Random(5)
    hit = got = want = 0
    for n in range(200):
        word = lambda kind: f"{kind}{n}x{rnd.randrange(10**6)}"  # noqa: E731, B023
        line = lambda kind, k: " ".join(word(kind) for _ in range(k))
        body = "".join(f"<p>{line('art', rnd.choice((2, 12, 40, 60)))}</p>" for _ in range(rnd.randint(2, 15)))
        wrap = rnd.choice(("<article>%s</article>", "<main><article class=post>%s</article></main>", "<div class='content has-sidebar'>%s</div>", "<div id=main><section>%s</section></div>"))
        parts = [wrap % body] + [
            f"<{t} {c}><p>{line('junk', rnd.choice((3, 10, 25)))}</p></{t.split()[0]}>"
            for t, c in rnd.sample([("nav", ""), ("header", ""), ("div", "class=sidebar"), ("div", "class='cookie-consent'"), ("div", "class=ad"), ("form", ""), ("section", "id=comments"), ("aside", ""), ("div", "class=newsletter"), ("footer", "")], 6)]
        rnd.shuffle(parts)
        words = h.extract("<html><body>" + "".join(parts) + "</body></html>").split()
        true = [w for w in html.unescape(body.replace("<p>", " ").replace("</p>", " ")).split()]
        hit += sum(w.startswith("art") for w in words)
        got += len(words)
        want += len(true)
    assert hit / got > 0.99 and hit / want > 0.99
