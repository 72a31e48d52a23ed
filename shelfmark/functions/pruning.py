"""Exclude globs as one automaton over path segments, to decide which folders need listing.

Each pattern (each alternative of its braces) is a chain of segments; its state is the set of places in
the chain that the segments so far can have reached, kept as the bits of a number.  A folder's states
travel with it, so a listing steps once per name, whatever the depth:

* ``excludes`` - the path itself is excluded: a pattern has matched, or a negated one hasn't;
* ``barren`` - no path below can survive.  For the patterns together it follows a name that no wildcard-free segment
  matches: if every extension by such names is excluded, every other one is, since other names reach more places.  A negated
  pattern bars what is below once it can't match any more.

Patterns whose segments can't be told apart (a slash within ``+(a/b)``) are left to the whole-path filter.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import cached_property

from shelfmark.functions.globs import braces, segment, split

ANY, STARS = "any name", "any names"


class Chain:
    """One alternative of one pattern: its segments are compiled regular expressions, ANY or STARS."""

    def __init__(self, pattern: str):
        parts = split(pattern)
        self.segments = [STARS if p == "**" else ANY if p == "*" else re.compile(segment(p, True) + r"\Z") for p in parts]
        self.simple = all("/" not in p for p in parts) and "" not in parts
        self.end = len(parts)
        #: A last ``**`` matches whatever is below, so its end loops.
        self.loops = parts[-1] == "**"

    def closed(self, bits: int) -> int:
        """With the places that a ``**`` of no names leads to; a last one needs a name."""
        for i, s in enumerate(self.segments[:-1]):
            if s == STARS and bits >> i & 1:
                bits |= 1 << i + 1
        return bits

    @cached_property
    def start(self) -> int:
        return self.closed(1)

    def step(self, bits: int, name: str | None) -> int:
        """The places after a name; None stands for one that only wildcards match."""
        out = 0
        if bits >> self.end & 1 and self.loops:
            out |= 1 << self.end
        for i, s in enumerate(self.segments):
            if bits >> i & 1:
                if s == STARS:
                    out |= 1 << (self.end if i == self.end - 1 else i)
                elif s == ANY or (name is not None and s.match(name)):
                    out |= 1 << i + 1
        return self.closed(out)

    def accepts(self, bits: int) -> bool:
        return bool(bits >> self.end & 1)

    def hopeful(self, bits: int) -> bool:
        """Whether a longer path can match."""
        return bool(bits & (1 << self.end) - 1) or (self.accepts(bits) and self.loops)


State = tuple[int, ...]


class Pruner:
    """All exclude patterns; ``hidden`` excludes names that start with a dot, and what is below."""

    def __init__(self, patterns: Sequence[str] = (), hidden: bool = False):
        self.hidden = hidden
        self.chains: list[Chain] = []
        self.plain: list[int] = []  # each chain is a pattern of its own
        self.negated: list[list[int]] = []  # the chains of a negated pattern
        for pattern in patterns:
            bare = pattern.lstrip("!") if not pattern.startswith("!(") else pattern
            own = [Chain(p) for p in braces(bare)]
            places = list(range(len(self.chains), len(self.chains) + len(own)))
            if (len(pattern) - len(bare)) % 2:
                if all(c.simple for c in own):
                    self.negated.append(places)
                    self.chains += own
            else:
                self.plain += [len(self.chains) + k for k in range(sum(c.simple for c in own))]
                self.chains += [c for c in own if c.simple]
        self.seen: dict[State, bool] = {}

    @property
    def start(self) -> State:
        return tuple(c.start for c in self.chains)

    def step(self, state: State, name: str | None) -> State:
        return tuple(c.step(bits, name) for c, bits in zip(self.chains, state, strict=True))

    def excludes(self, state: State, name: str) -> bool:
        """Whether the path with this state and last name is excluded."""
        if self.hidden and name.startswith("."):
            return True
        return any(self.chains[k].accepts(state[k]) for k in self.plain) or any(
            not any(self.chains[k].accepts(state[k]) for k in own) for own in self.negated
        )

    def barren(self, state: State, name: str) -> bool:
        """Whether all that is below the folder is excluded."""
        if self.hidden and name.startswith("."):
            return True
        if state not in self.seen:
            if len(self.seen) > 100_000:
                self.seen.clear()
            self.seen[state] = any(not any(self.chains[k].hopeful(state[k]) for k in own) for own in self.negated) or self.covers(state)
        return self.seen[state]

    def covers(self, state: State) -> bool:
        """Whether the patterns match every longer path."""
        passed = set()
        while True:
            state = self.step(state, None)
            if not any(self.chains[k].accepts(state[k]) for k in self.plain):
                return False
            if state in passed:
                return True
            passed.add(state)
