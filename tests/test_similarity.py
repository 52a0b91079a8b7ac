import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kindred.functions import similarity
from kindred.functions.similarity import lcs, lcs_all, ratios, token_set_ratios, token_sort_ratios


def ratio_of(a, b):
    return ratios([a], [b])[0]


def token_sort_of(a, b):
    return token_sort_ratios([a], [b])[0]


def token_set_of(a, b):
    return token_set_ratios([a], [b])[0]


WORDS = st.text("abc ", max_size=14)


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def plain_set_ratio(a, b):
    """As defined: the best of the shared tokens, in order, against each side, and of the sides."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, one, two = (" ".join(sorted(t)) for t in (x & y, x - y, y - x))
    if both and not (one and two):
        return 1.0
    left, right = f"{both} {one}".strip(), f"{both} {two}".strip()
    indel = lambda s, t: 2 * plain_lcs(s, t) / (len(s) + len(t))
    # with shared tokens in front, the common part of the sides is theirs and that of the rests
    sides = 2 * (len(both) + bool(both) + plain_lcs(one, two)) / (len(left) + len(right))
    return max(sides, indel(both, left), indel(both, right)) if both else sides


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ab 日é😀", max_size=150), st.text("ab 日é😀", max_size=150)), max_size=12))
def test_batches(pairs):
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    want = [plain_lcs(x, y) for x, y in pairs]
    assert lcs_all(a, b).tolist() == want == [lcs(x, y) for x, y in pairs]
    old, similarity.LONGEST = similarity.LONGEST, 20
    try:
        assert lcs_all(a, b).tolist() == want
    finally:
        similarity.LONGEST = old
    assert token_set_ratios(a, b).tolist() == [pytest.approx(plain_set_ratio(x, y)) for x, y in pairs]


@settings(max_examples=200, deadline=None)
@given(WORDS, WORDS)
def test_properties(a, b):
    assert lcs(a, b) == plain_lcs(a, b)
    for f in (ratio_of, token_sort_of, token_set_of):
        assert 0 <= f(a, b) <= 1
        assert abs(f(a, b) - f(b, a)) < 1e-12
        assert f(a, "") == 0
    if a.strip():
        assert ratio_of(a, a) == token_set_of(a, a) == 1


def test_textbook():
    assert lcs("AGGTAB", "GXTXAYB") == 4
    assert token_set_of("acme ltd", "acme ltd pvt") == 1.0
    assert token_sort_of("b a", "a b") == 1.0
