"""Search for sparse integer score cards.

Works on the pattern table; each step below is one Spark job over it for all
candidates of all settings together.

Feature sets grow one feature at a time, every extension of every kept set
fitted at once, and then exchange features: every set that differs in one
feature from a kept one is fitted, until the kept ones stay. The fits are
stretched by several multipliers and rounded one coefficient after the other,
each time the one and the way that costs the least loss while the others stay
as they are. Rounded cards are at last moved by single points and pairs of
points while that helps.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame

from tallycard.models.batch_fit import FitSpec, fit_many, losses, matrix_losses
from tallycard.models.linear import LinearFit
from tallycard.session import settled

#: A setting: most terms, largest number of points.
Cell = tuple[int, int]
#: A card: intercept, points per feature in the order of the features, multiplier.
Move = tuple[int, tuple[int, ...], float]


@dataclass(frozen=True)
class FoundCard:
    """risk = logistic((intercept + points . items) / multiplier)."""

    number: int
    points: dict[str, int]
    intercept: float
    multiplier: float
    loss: float


def _best(fits: dict[str, LinearFit], loss: dict[str, float], beam: int) -> list[str]:
    return sorted(fits, key=lambda name: (round(loss[name], 9), name))[:beam]


def grown_sets(pats: DataFrame, features: list[str], sizes: list[int], beam: int, swap_rounds: int = 5) -> dict[int, list[LinearFit]]:
    """The best ``beam`` fits of every size in ``sizes``, best first.

    Sets grow once, to the largest size; a smaller one is a start of the same path. Each round fits at most beam x
    features candidates. Then the sets of the wanted sizes exchange features. A size beyond the number of features means
    all of them.
    """
    kept: list[tuple[str, ...]] = [()]
    by_size: dict[int, tuple[dict[str, LinearFit], dict[str, float]]] = {}
    for size in range(1, min(max(sizes), len(features)) + 1):
        wider = sorted({tuple(sorted((*s, f))) for s in kept for f in features if f not in s})
        fits = fit_many(pats, [FitSpec("|".join(s), s) for s in wider])
        loss = losses(pats, fits)
        kept = [tuple(name.split("|")) for name in _best(fits, loss, beam)]
        by_size[size] = fits, loss
    wanted = sorted({min(t, len(features)) for t in sizes})
    for _ in range(swap_rounds):
        exchanged = {
            "|".join(s)
            for t in wanted for name in _best(*by_size[t], beam) for out in name.split("|") for new in features if new not in name.split("|")
            for s in [sorted({*name.split("|"), new} - {out})]
        }
        exchanged -= {name for t in wanted for name in by_size[t][0]}
        if not exchanged:
            break
        before = [_best(*by_size[t], beam) for t in wanted]
        fits = fit_many(pats, [FitSpec(name, tuple(name.split("|"))) for name in sorted(exchanged)])
        loss = losses(pats, fits)
        for name, fit in fits.items():
            for known, new in zip(by_size[len(fit.coefs)], (fit, loss[name])):
                known[name] = new
        if before == [_best(*by_size[t], beam) for t in wanted]:
            break
    best = {t: [by_size[t][0][name] for name in _best(*by_size[t], beam)] for t in wanted}
    return {size: best[min(size, len(features))] for size in sizes}


def stretches(fit: LinearFit, bound: int, multipliers: int | list[float]) -> list[float]:
    """Multipliers to try: as given, or so many up to the one that brings the biggest coefficient to ``bound``."""
    if not isinstance(multipliers, int):
        return [float(m) for m in multipliers]
    largest = bound / (float(np.nan_to_num(max(abs(v) for v in fit.coefs.values()))) or 1.0)
    return [float(m) for m in np.linspace(min(1.0, largest), largest, multipliers)]


def round_by_coordinate(pats: DataFrame, features: list[str], starts: list[tuple[np.ndarray, float, int]]) -> list[Move]:
    """Round stretched fits, (intercept and coefficients, multiplier, bound), all of them together.

    Every step tries both neighbours of every number of a card that is not whole yet, and keeps the best of them.
    """
    cards = [w.copy() for w, _, _ in starts]
    for w, (_, _, bound) in zip(cards, starts):
        w[1:] = np.clip(w[1:], -bound, bound)
    while True:
        tries: list[tuple[int, np.ndarray]] = []
        for k, w in enumerate(cards):
            for c in np.flatnonzero(w != np.rint(w)):
                for whole in (np.floor(w[c]), np.ceil(w[c])):
                    new = w.copy()
                    new[c] = whole
                    tries.append((k, new))
        if not tries:
            break
        loss = matrix_losses(pats, features, np.array([new / starts[k][1] for k, new in tries]))
        best: dict[int, tuple[float, np.ndarray]] = {}
        for (k, new), value in zip(tries, loss):
            if k not in best or value < best[k][0]:
                best[k] = value, new
        for k, (_, new) in best.items():
            cards[k] = new
    return [(int(w[0]), tuple(int(v) for v in w[1:]), m) for w, (_, m, _) in zip(cards, starts)]


def neighbours(card: Move, terms: int, bound: int, multipliers: list[float]) -> set[Move]:
    """Cards that differ by a point in one or two places, or in the multiplier, within the setting's limits."""
    b0, points, m = card
    room = sum(map(bool, points)) < terms
    places = [0] + [k + 1 for k, v in enumerate(points) if v or room]
    found = {(b0, points, other) for other in multipliers}
    moves = [((k, s),) for k in places for s in (-1, 1)]
    moves += [((a, s), (b, u)) for a, b in combinations(places, 2) for s in (-1, 1) for u in (-1, 1)]
    for move in moves:
        new = [b0, *points]
        for place, step in move:
            new[place] += step
        if max(map(abs, new[1:]), default=0) <= bound and sum(map(bool, new[1:])) <= terms:
            found |= {(new[0], tuple(new[1:]), m)}
    return found


def search_cards(pats: DataFrame, features: list[str], terms: list[int], bounds: list[int], pool: int = 2, beam: int = 8,
                 multipliers: int | list[float] = 16, tolerance: float = 0.05, rounds: int = 30) -> dict[Cell, list[FoundCard]]:
    """``card_search`` for every (terms, bound) at once."""
    pats = settled(pats.select(*features, "pos", "n"))
    grown = grown_sets(pats, features, terms, beam)
    starts, owner = [], []
    tried: dict[Cell, list[float]] = {}
    for cell in [(t, b) for t in terms for b in bounds]:
        for fit in grown[cell[0]]:
            # without records a fit has no numbers
            w = np.nan_to_num(np.array([fit.intercept, *[fit.coefs.get(f, 0.0) for f in features]]))
            for m in stretches(fit, cell[1], multipliers):
                starts.append((w * m, m, cell[1]))
                owner.append(cell)
                tried.setdefault(cell, []).append(m)
    rounded = round_by_coordinate(pats, features, starts)
    known: dict[Cell, dict[Move, float]] = {cell: {} for cell in tried}
    new: dict[Cell, set[Move]] = {cell: set() for cell in tried}
    for cell, card in zip(owner, rounded):
        new[cell].add(card)
    seen: dict[Cell, set[Move]] = {cell: set() for cell in tried}
    keep = max(beam, 2 * pool)
    for _ in range(rounds + 1):
        todo = [(cell, card) for cell, cards in new.items() for card in sorted(cards - known[cell].keys())]
        if todo:
            weights = np.array([np.array([b0, *points]) / m for _, (b0, points, m) in todo])
            for (cell, card), loss in zip(todo, matrix_losses(pats, features, weights)):
                known[cell][card] = float(loss)
        # every kept card's neighbours are looked at once
        new = {}
        for cell, found in known.items():
            kept = [c for c in _different(found, keep) if c not in seen[cell]]
            seen[cell].update(kept)
            some = sorted(set(tried[cell]))
            new[cell] = {n for c in kept for n in neighbours(c, *cell, _around(some, c[2]))}
        if not any(new.values()):
            break
    return {cell: best_cards(features, found, pool, tolerance) for cell, found in known.items()}


def _around(multipliers: list[float], m: float, many: int = 8) -> list[float]:
    at = min(range(len(multipliers)), key=lambda k: abs(multipliers[k] - m))
    return multipliers[max(0, at - many):at + many + 1]


def _different(found: dict[Move, float], most: int) -> list[Move]:
    """The best cards with different points, best first."""
    out, points = [], set()
    for card in sorted(found, key=lambda c: (round(found[c], 9), c)):
        if card[1] not in points:
            points.add(card[1])
            out.append(card)
            if len(out) == most:
                break
    return out


def card_search(pats: DataFrame, features: list[str], terms: int, bound: int, pool: int = 2, beam: int = 8,
                multipliers: int | list[float] = 16, tolerance: float = 0.05) -> list[FoundCard]:
    """Up to ``pool`` different cards whose loss is within ``tolerance`` of the best, numbered from it."""
    return search_cards(pats, features, [terms], [bound], pool, beam, multipliers, tolerance)[terms, bound]


def best_cards(features: list[str], found: dict[Move, float], pool: int, tolerance: float) -> list[FoundCard]:
    """The ``pool`` cards of least loss with different points, none more than ``tolerance`` worse than the first."""
    best = _different(found, pool)
    return [
        FoundCard(k + 1, {f: v for f, v in zip(features, card[1]) if v}, float(card[0]), card[2], found[card])
        for k, card in enumerate(best) if found[card] <= found[best[0]] * (1 + tolerance)
    ]
