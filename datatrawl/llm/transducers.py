"""Weighted sequential transducers over the classes of a clause's words, and their composition.

A machine reads a symbol, moves on, writes a symbol and gives a factor. Composed machines pass
symbols on from one to the next and multiply the factors. The clause grammar is the composition of
a target, a threat, a negation and a reported-speech machine; a clause weighs the sum, over the
attacks that come out, of lexical weight times factor.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

# Classes of words.
INSULT, HARM, INTENT, TARGET, NEGATION, REPORT, OTHER = "ihwtnro"
# What comes out for a word: an attack, a negated or a reported one, or nothing of the kind.
ATTACK, NEGATED, REPORTED = "ANR"


@dataclass
class Machine:
    """`arcs` maps (state, symbol) to (state, symbol out, factor); without an arc a symbol passes
    unchanged and leads to `fallback` of the state (the state itself if it has none)."""

    start: object
    arcs: dict = field(default_factory=dict)
    fallback: dict = field(default_factory=dict)

    def step(self, state, symbol: str):
        arc = self.arcs.get((state, symbol))
        return arc if arc is not None else (self.fallback.get(state, state), symbol, 1.0)

    def states(self, alphabet: Iterable[str]) -> set:
        """The states that can be reached."""
        alphabet = list(alphabet)
        seen, todo = {self.start}, [self.start]
        while todo:
            state = todo.pop()
            for symbol in alphabet:
                to = self.step(state, symbol)[0]
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return seen


def compose(first: Machine, second: Machine, alphabet: Iterable[str]) -> Machine:
    """The machine that feeds what `first` writes to `second`; only pairs of states that occur."""
    alphabet = list(alphabet)
    out = Machine((first.start, second.start))
    seen, todo = {out.start}, [out.start]
    while todo:
        a, b = todo.pop()
        for symbol in alphabet:
            a2, middle, f1 = first.step(a, symbol)
            b2, last, f2 = second.step(b, middle)
            out.arcs[(a, b), symbol] = ((a2, b2), last, f1 * f2)
            if (a2, b2) not in seen:
                seen.add((a2, b2))
                todo.append((a2, b2))
    return out


def target_machine(bonus: float) -> Machine:
    """An insult after a word for a person weighs more."""
    return Machine("none", {
        ("none", TARGET): ("near", TARGET, 1.0),
        ("none", INSULT): ("none", ATTACK, 1.0),
        ("near", INSULT): ("near", ATTACK, bonus),
    })


def threat_machine(gap: int) -> Machine:
    """Intent, harm and a target in this order, within `gap` words of each other: an attack.

    The word of harm is the attack's place; it comes out as one if a target follows, which a
    sequential machine can't foresee, so the target is where the attack is written.
    """
    m = Machine("none")
    m.arcs["none", INTENT] = (("intent", gap), INTENT, 1.0)
    for left in range(gap, 0, -1):
        for kind in ("intent", "harm"):
            m.fallback[kind, left] = (kind, left - 1) if left > 1 else "none"
        m.arcs[("intent", left), INTENT] = (("intent", gap), INTENT, 1.0)
        m.arcs[("harm", left), INTENT] = (("intent", gap), INTENT, 1.0)
        m.arcs[("intent", left), HARM] = (("harm", gap), HARM, 1.0)
        m.arcs[("harm", left), TARGET] = ("none", ATTACK, 1.0)
    return m


def scope_machine(trigger: str, gap: int, out: str, factor: float) -> Machine:
    """An attack within `gap` words after `trigger` (whole clause if 0) becomes `out`."""
    m = Machine("none")
    if not gap:
        m.arcs["none", trigger] = ("on", trigger, 1.0)
        m.arcs["on", ATTACK] = ("on", out, factor)
        return m
    m.arcs["none", trigger] = (("on", gap), trigger, 1.0)
    for left in range(gap, 0, -1):
        m.fallback["on", left] = ("on", left - 1) if left > 1 else "none"
        m.arcs[("on", left), trigger] = (("on", gap), trigger, 1.0)
        m.arcs[("on", left), ATTACK] = ("none", out, factor)
    return m


def clause_grammar(target_bonus: float, negated: float, reported: float, gap: int = 4) -> Machine:
    words = (INSULT, HARM, INTENT, TARGET, NEGATION, REPORT, OTHER)
    # Threats read targets before the target machine lets insults pass as attacks.
    grammar = compose(threat_machine(gap), target_machine(target_bonus), words)
    grammar = compose(grammar, scope_machine(NEGATION, gap, NEGATED, negated), words)
    return compose(grammar, scope_machine(REPORT, 0, REPORTED, reported), words)


def run(machine: Machine, symbols: Iterable[str]) -> list[tuple[str, float]]:
    """What the machine writes for each symbol, and the factor."""
    state, out = machine.start, []
    for symbol in symbols:
        state, written, factor = machine.step(state, symbol)
        out.append((written, factor))
    return out
