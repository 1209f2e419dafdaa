"""Unit graph: affine conversions as edges, composed once, checked for consistency.

An edge ``(a, b, scale, offset)`` says ``b = scale * a + offset``. All arithmetic on the graph is
rational, so a cycle is consistent exactly when its composition is the identity.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable
from fractions import Fraction

Edge = tuple[str, str, "Fraction | int | str", "Fraction | int | str"]

# Definitions of the units.
VOLUME_EDGES: list[Edge] = [
    ("l", "ml", 1000, 0),
    ("l", "cl", 100, 0),
    ("cl", "ml", 10, 0),
    ("dl", "cl", 10, 0),
    ("hl", "l", 100, 0),
    ("us_floz", "ml", "29.5735295625", 0),
    ("us_pt", "us_floz", 16, 0),
    ("us_qt", "us_pt", 2, 0),
    ("us_gal", "us_qt", 4, 0),
    ("us_gal", "us_floz", 128, 0),
    ("us_bbl", "us_gal", 31, 0),
    ("imp_floz", "ml", "28.4130625", 0),
    ("imp_pt", "imp_floz", 20, 0),
    ("imp_qt", "imp_pt", 2, 0),
    ("imp_gal", "imp_qt", 4, 0),
    ("imp_gal", "imp_floz", 160, 0),
]


class InconsistentUnits(ValueError):
    """Two paths between the same units disagree."""


def compositions(edges: Iterable[Edge]) -> dict[tuple[str, str], tuple[Fraction, Fraction, int]]:
    """Shortest composition ``(scale, offset, hops)`` for every reachable ordered pair.

    Breadth-first from every unit over the edges and their inverses. Every edge closes a cycle
    with the tree it does not belong to; each such cycle must compose to the identity, otherwise
    :class:`InconsistentUnits` is raised. A zero scale cannot be inverted and is refused.
    """
    out: dict[str, list[tuple[str, Fraction, Fraction]]] = {}
    for a, b, scale, offset in edges:
        s, o = Fraction(scale), Fraction(offset)
        if s == 0:
            raise InconsistentUnits(f"{a} -> {b} has no inverse")
        out.setdefault(a, []).append((b, s, o))
        out.setdefault(b, []).append((a, 1 / s, -o / s))
    found: dict[tuple[str, str], tuple[Fraction, Fraction, int]] = {}
    for start in out:
        found[start, start] = (Fraction(1), Fraction(0), 0)
        queue = deque([start])
        while queue:
            at = queue.popleft()
            s0, o0, hops = found[start, at]
            for to, s, o in out[at]:
                if (start, to) not in found:
                    found[start, to] = (s * s0, s * o0 + o, hops + 1)
                    queue.append(to)
        for at in list(out):
            if (start, at) in found:
                s0, o0, _ = found[start, at]
                for to, s, o in out[at]:
                    if found[start, to][:2] != (s * s0, s * o0 + o):
                        raise InconsistentUnits(f"{start} -> {to} depends on the path taken")
    return found
