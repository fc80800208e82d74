"""Weighted finite-state transducers over small alphabets, their composition, and the clause grammar of ``toxicity`` made of them."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Marked by the target transducer: an insult near a target, a threat with a target on this side of the clause.
INSULT_AT, THREAT_AT = 6, 7
SYMBOLS = range(8)
HARM = (INSULT, THREAT, INSULT_AT, THREAT_AT)

NEAR = 3
FIXED_WEIGHT = 3.0
NEGATED, REPORTED, TARGETED = 0.4, 0.6, 1.25


class Transducer:
    """Deterministic in its input.  arcs: (state, symbol) to (state, symbol, weight); states are numbered from the start, 0."""

    def __init__(self, start: Hashable, arc: Callable[[Hashable, int], tuple[Hashable, int, float]], symbols: Iterable[int] = SYMBOLS):
        """arc: the rule for each state and symbol; only states that can be reached get a number."""
        number, todo, self.arcs = {start: 0}, [start], []
        for state in todo:
            row = []
            for symbol in symbols:
                to, out, weight = arc(state, symbol)
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append((number[to], out, weight))
            self.arcs.append(row)

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this writes, the other reads; weights multiply."""

        def arc(pair: tuple[int, int], symbol: int) -> tuple[tuple[int, int], int, float]:
            here, middle, w = self.arcs[pair[0]][symbol]
            there, out, v = other.arcs[pair[1]][middle]
            return (here, there), out, w * v

        return Transducer((0, 0), arc)

    def run(self, symbols: Iterable[int]) -> tuple[list[int], list[float]]:
        """(what is written, weight of each arc)."""
        state, out, weights = 0, [], []
        for s in symbols:
            state, o, w = self.arcs[state][s]
            out.append(o)
            weights.append(w)
        return out, weights


def negation() -> Transducer:
    """State: symbols that the last negation still reaches.  Harm in reach keeps NEGATED of its weight."""
    return Transducer(0, lambda s, x: (NEAR if x == NEGATION else max(0, s - 1), x, NEGATED if s and x in HARM else 1.0))


def report() -> Transducer:
    """State: whether a reporting word was read.  Harm after it keeps REPORTED of its weight."""
    return Transducer(False, lambda s, x: (s or x == REPORT, x, REPORTED if s and x in HARM else 1.0))


def target() -> Transducer:
    """State: symbols that the last target still reaches, and whether there was one.  Marks insults in reach, and threats after any."""

    def arc(state: tuple[int, bool], x: int) -> tuple[tuple[int, bool], int, float]:
        reach, seen = state
        to = (NEAR, True) if x == TARGET else (max(0, reach - 1), seen)
        return to, INSULT_AT if x == INSULT and reach else THREAT_AT if x == THREAT and seen else x, 1.0

    return Transducer((0, False), arc)


def worth() -> Transducer:
    """One state: what each symbol is worth; a threat without a target is worth nothing."""
    value = {INSULT: 1.0, INSULT_AT: TARGETED, THREAT_AT: FIXED_WEIGHT}
    return Transducer(0, lambda s, x: (0, x, value.get(x, 0.0)))


def untargeted_worth() -> Transducer:
    """``worth`` where targets are not told apart, for comparison."""
    value = {INSULT: 1.0, THREAT: FIXED_WEIGHT}
    return Transducer(0, lambda s, x: (0, x, value.get(x, 0.0)))


class Grammar:
    """A clause is read forwards by negation, report and target composed, and what they write backwards by target and worth composed.

    without: names of transducers that are left out, to measure what each adds.
    """

    def __init__(self, without: frozenset[str] = frozenset()):
        forwards = [make() for name, make in (("negation", negation), ("report", report), ("target", target)) if name not in without]
        self.forwards = Transducer(0, lambda s, x: (0, x, 1.0))
        for t in forwards:
            self.forwards = self.forwards.then(t)
        self.backwards = untargeted_worth() if "target" in without else target().then(worth())

    def __call__(self, symbols: list[tuple[int, int, float]]) -> float:
        """Score of (position, class, lexical weight) in order; words between them are other symbols."""
        tape, held, last = [], [], None
        for p, kind, weight in symbols:
            if last is not None:  # beyond the reach of every state, more of them change nothing
                gap = min(p - last - 1, NEAR + 1)
                tape += [OTHER] * gap
                held += [0.0] * gap
            tape.append(kind)
            held.append(weight)
            last = p
        out, ahead = self.forwards.run(tape)
        _, back = self.backwards.run(reversed(out))
        return sum(w * a * b for w, a, b in zip(held, ahead, reversed(back), strict=True) if b)


__all__ = ["FIXED_WEIGHT", "HARM", "INSULT", "NEAR", "NEGATED", "NEGATION", "OTHER", "REPORT", "REPORTED", "TARGET", "TARGETED", "THREAT", "Grammar", "Transducer"]
