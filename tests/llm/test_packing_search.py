"""The packing search against the fewest sequences there can be, and on large groups."""

import random

import pytest
from stratafind.llm.swap_packing import Exchanges, best_fit, least_bins, local_search


def fewest(lengths, capacity, upper):
    """The optimum by trying every place, largest pieces first."""
    rest = sorted(lengths, reverse=True)

    def fits(rooms, i):
        if i == len(rest):
            return True
        for room in {r for r in rooms if r >= rest[i]}:
            b = rooms.index(room)
            if fits([*rooms[:b], room - rest[i], *rooms[b + 1 :]], i + 1):
                return True
        return False

    return next((k for k in range(-(-sum(lengths) // capacity), upper) if fits([capacity] * k, 0)), upper)


def check(bins, lengths, capacity):
    assert sorted(i for b in bins for i in b) == list(range(len(lengths))) and all(sum(lengths[i] for i in b) <= capacity for b in bins)


def test_small_groups_reach_the_optimum():
    r, missed, reached = random.Random(2), 0, 0
    assert len(local_search(best_fit([26, 41, 31, 26, 27, 38, 38, 27, 32], 100), [26, 41, 31, 26, 27, 38, 38, 27, 32], 100)) == 3
    while missed < 60:
        capacity = r.choice([20, 30, 50, 100])
        lengths = [r.randint(1, capacity * r.choice([40, 50, 70]) // 100) for _ in range(r.randint(9, 12))]
        bins = best_fit(lengths, capacity)
        best = fewest(lengths, capacity, len(bins))
        assert least_bins(lengths, capacity) <= best
        if best < len(bins):
            missed += 1
            found = local_search(bins, lengths, capacity)
            check(found, lengths, capacity)
            reached += len(found) == best
    assert reached >= 0.9 * missed, (reached, missed)


@pytest.mark.parametrize("low,high,share", [(900, 1500, 0.5), (800, 2000, 0.4), (1000, 1700, 0.6)])
def test_large_groups_take_fewer_sequences_than_best_fit(low, high, share):
    """Of what best fit has above the lower bound, the search saves a good part."""
    r = random.Random(low)
    lengths = [r.randint(low, high) for _ in range(2000)]
    bins = best_fit(lengths, 4096)
    found, least = local_search(bins, lengths, 4096), least_bins(lengths, 4096)
    check(found, lengths, 4096)
    assert len(bins) - len(found) >= 0.3 * share * (len(bins) - least) > 0


def test_every_exchange_raises_the_squared_fill():
    r = random.Random(5)
    lengths = [r.randint(1, 60) for _ in range(120)]
    x = Exchanges([[i] for i in range(120)], lengths, 100)
    squares = lambda: int((x.fill**2).sum())
    plain, last = x.exchange, [squares()]

    def seen(a, gain, take, give):
        plain(a, gain, take, give)
        last.append(squares())
        assert 1 <= len(take) <= 2 and len(give) <= 2 and last[-1] > last[-2] and x.fill.max() <= 100

    x.exchange = seen
    check(x.improve(0), lengths, 100)
    assert len(last) > 60


def test_bound_and_empty_group():
    assert least_bins([], 10) == 0 and local_search([], [], 10) == []
    assert least_bins([6, 6, 6], 10) == 3 and least_bins([6, 6, 4, 4, 5, 5], 10) == 3 and least_bins([7, 7, 4, 4], 10) == 3
