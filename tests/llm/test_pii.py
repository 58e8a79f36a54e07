"""The field over whole spans: against all segmentations, and on planted entities that the patterns lose."""

import itertools
import math
import random

import numpy as np
import pytest

from ordersight.llm import pii


def some_stretch(rng, n, spans, rows=6):
    stretch = pii.Stretch("", [], None)
    stretch.tokens = [(i, i + 1) for i in range(n)]
    stretch.candidates = [(i, j, tuple(f"f{x}" for x in rng.choice(rows, 2, replace=False))) for i, j in spans]
    return stretch


def segmentations(stretch):
    """All ways to cover the tokens: lists of (first, end, kind, candidate or None)."""
    n = len(stretch.tokens)

    def on(at):
        if at == n:
            yield []
            return
        for rest in on(at + 1):
            yield [(at, at + 1, pii.OUTSIDE, None), *rest]
        for c, (i, j, _) in enumerate(stretch.candidates):
            if i == at:
                for rest in on(j):
                    for k in range(pii.OUTSIDE):
                        yield [(i, j, k, c), *rest]
    return list(on(0))


def value(stretch, parts, field, margin):
    total, before = 0.0, pii.OUTSIDE
    for _, _, k, c in parts:
        total += field.follow[before, k]
        if c is not None:
            total += field.weights[[field.numbers[f] for f in stretch.candidates[c][2]], k].sum() - margin
        before = k
    return total


@pytest.fixture
def field():
    rng = np.random.default_rng(2)
    return pii.Field({f"f{x}": x for x in range(6)}, rng.normal(0, 2, (6, pii.OUTSIDE)),
                     rng.normal(0, 1, (pii.OUTSIDE + 1, pii.OUTSIDE + 1)))


SPANS = [(0, 2), (1, 3), (2, 4), (0, 4), (3, 5), (4, 5)]


def test_best_of_all_segmentations(field):
    rng = np.random.default_rng(7)
    for n in (1, 3, 5):
        stretch = some_stretch(rng, n, [s for s in SPANS if s[1] <= n])
        best = max(segmentations(stretch), key=lambda p: value(stretch, p, field, pii.MARGIN))
        assert field.best(stretch) == [(i, j, k) for i, j, k, c in best if c is not None]


def test_gradient_is_expected_less_gold(field):
    """Expected counts by enumeration of all segmentations."""
    stretch = some_stretch(np.random.default_rng(8), 5, SPANS)
    everything = segmentations(stretch)
    mass = np.array([math.exp(value(stretch, p, field, 0.0)) for p in everything])
    gold = [(0, 2), (4, 1)]  # candidates (0, 2) and (3, 5)
    golden = [(0, 2, 2, 0), (2, 3, pii.OUTSIDE, None), (3, 5, 1, 4)]
    want_w, want_f = np.zeros_like(field.weights), np.zeros_like(field.follow)
    for share, parts in [*zip(mass / mass.sum(), everything, strict=True), (-1.0, golden)]:
        before = pii.OUTSIDE
        for _, _, k, c in parts:
            want_f[before, k] += share
            if c is not None:
                for f in stretch.candidates[c][2]:
                    want_w[field.numbers[f], k] += share
            before = k
    got_w, got_f = np.zeros_like(want_w), np.zeros_like(want_f)
    candidates = [(i, j, [field.numbers[f] for f in fs]) for i, j, fs in stretch.candidates]
    pii._gradient((5, candidates, gold), field.weights, field.follow, got_w, got_f)
    assert np.allclose(got_w, want_w) and np.allclose(got_f, want_f)


def card(rng, valid=True):
    digits = "".join(str(rng.randrange(10)) for _ in range(15))
    digits += next(c for c in "0123456789" if pii.luhn(digits + c) == valid)
    return " ".join(digits[i:i + 4] for i in range(0, 16, 4)) if rng.random() < 0.5 else digits


def phone(rng):
    return f"+{rng.randint(1, 99)} ({rng.randint(100, 999)}) {rng.randint(100, 999)}-{rng.randint(1000, 9999)}"


def address(rng):
    return ".".join(str(rng.randrange(256)) for _ in range(4))


def test_planted_entities():
    """Entities that the patterns lose to a longer match are found; other long numbers stay outside."""
    rng = random.Random(3)
    makers = {"card": card, "phone": phone, "ip": address, "email": lambda r: f"ab{r.randrange(99)}@mail.example.org"}
    noise = [lambda r: card(r, False), lambda r: f"{r.getrandbits(160):040x}", lambda r: f"no {r.randrange(10 ** 9)}"]
    texts = [" and ".join(rng.choice([*makers.values(), *noise])(rng) + " text" for _ in range(4)) for _ in range(200)]
    field = pii.fit(texts)
    wanted = found = wrong = 0
    for _ in range(100):
        a, b = card(rng), phone(rng)
        for text, parts in ((f"call {b} {a} now", [("phone", b), ("card", a)]), (f"pay {a} {a} now", [("card", a)] * 2),
                            (f"key {rng.getrandbits(160):040x} end", []), (f"ref {card(rng, False)} end", [])):
            base, spans = pii.all_spans(text, field)
            got = [(pii.KINDS[k], text[s:e]) for s, k, e in spans if (s, k, e) not in base]
            missed = [p for p in parts if p not in [(pii.KINDS[k], text[s:e]) for s, k, e in base]]
            wanted, found = wanted + len(missed), found + len([p for p in missed if p in got])
            wrong += len([g for g in got if g not in parts])
    assert wanted > 300 and found >= 0.95 * wanted and wrong <= 0.02 * found


def test_whole_spans():
    assert pii.is_entity("4111 1111 1111 1111") and not pii.is_entity("4111 1111 1111 1112")
    assert pii.is_entity("+1 (826) 555-4081") and pii.is_entity("1.2.3.255") and not pii.is_entity("1.2.3.256")
    assert not any(map(pii.is_entity, itertools.chain("", ["12345678901234a", "1.2.3", "+1"])))
