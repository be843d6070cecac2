"""Dynamic programs over byte strings: Unigram lattices and the n-gram segmentation of the byte-piece trainer."""

from __future__ import annotations

import math

from ..functions.codepoints import char_length

INF = math.inf
GRID = float(1 << 30)


def on_grid(x: float) -> float:
    """Rounded to a multiple of 2**-30: sums of a few thousand such values are exact, so paths of equal probability tie."""
    return round(x * GRID) / GRID


class Unigram:
    """Best path through dictionary words; a single character costs ``fallback`` if need be. First of equal paths."""

    def __init__(self, weights: dict[bytes, float], fallback: float = -10.0):
        total = sum(weights.values())
        log_total = math.log(total) if total > 0 else 0.0
        self.weight = {w: on_grid(math.log(f) - log_total) for w, f in weights.items() if w and f > 0}
        self.longest = max(map(len, self.weight), default=0)
        self.steps: dict[bytes, float | None] = {w[:i]: None for w in self.weight for i in range(1, len(w))}
        self.steps.update(self.weight)  # None for what only begins a word
        self.fallback = on_grid(fallback)

    @classmethod
    def cutter(cls, weights: dict[bytes, float]) -> Unigram:
        """For runs of Han characters: an unknown character weighs log(1 / sum of frequencies)."""
        total = sum(weights.values())
        return cls(weights, math.log(1.0 / total) if total > 0 else -10.0)

    def tokenize(self, text: bytes) -> list[bytes]:
        n = len(text)
        score = [-INF] * (n + 1)
        score[0] = 0.0
        came = list(range(n + 1))
        steps, longest = self.steps, self.longest
        pos = 0
        while pos < n:
            base = score[pos]
            size = char_length(text[pos])
            if pos + size <= n and base + self.fallback > score[pos + size]:
                score[pos + size] = base + self.fallback
                came[pos + size] = pos
            for end in range(pos + 1, min(n, pos + longest) + 1):
                w = steps.get(text[pos:end], INF)
                if w is INF:
                    break
                if w is not None and base + w > score[end]:
                    score[end] = base + w
                    came[end] = pos
            pos += size
        out = []
        end = n
        while end > 0:
            start = came[end]
            if start == end:  # bytes that no path reaches (a cut-off character)
                start = end - 1
            out.append(text[start:end])
            end = start
        return out[::-1]


STATES = 6


def segment(word: bytes, logp: dict[bytes, float]) -> list[bytes]:
    """Split a word where the best path of n-gram states returns to zero context.

    State j means j bytes of context. A state grows by one, returns to 0, or stays at the last one. State 0
    stands only on character starts, and an n-gram begins on one, except while the last state stays. Where a
    character ends every path, it and those after it stand alone, and the best path before it counts.
    """
    n = len(word)
    if n == 0:
        return []
    inside = [0] * n
    i = 0
    while i < n:
        for j in range(min(char_length(word[i]), n - i)):
            inside[i + j] = j
        i += char_length(word[i])
    last, get = STATES - 1, logp.get
    now = [get(word[:1], -INF)] + [-INF] * last
    back: list[list[int]] = []
    for at in range(1, n):
        nxt, route = [-INF] * STATES, [0] * STATES
        here, least = inside[at], inside[at - 1]
        if here == 0:
            best, who = -INF, 0
            for p in range(least, STATES):
                if now[p] > best:
                    best, who = now[p], p
            nxt[0], route[0] = best + get(word[at : at + 1], -INF), who
        for j in range(max(here, least + 1, 1), min(last, at + 1)):
            if now[j - 1] > -INF and not inside[at - j]:
                nxt[j], route[j] = now[j - 1] + get(word[at - j : at + 1], -INF), j - 1
        if at >= last:
            best, who = -INF, 0
            if least < last and not inside[at - last]:
                best, who = now[last - 1], last - 1
            if now[last] > best:
                best, who = now[last], last
            if best > -INF:
                nxt[last], route[last] = best + get(word[at - last : at + 1], -INF), who
        now = nxt
        back.append(route)
    state, best = 0, -INF
    for j in range(STATES):
        if j >= inside[n - 1] and now[j] > best:
            best, state = now[j], j
    path = [0] * n
    for at in range(n - 1, -1, -1):
        path[at] = state
        if at:
            state = back[at - 1][state]
    cuts = [0, *(i for i in range(1, n) if path[i] == 0 and inside[i] == 0), n]
    return [word[a:b] for a, b in zip(cuts, cuts[1:])]
