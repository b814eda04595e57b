"""Exponion search against all distances, and the codes against plain Python."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quartzlake.llm import vectorcodes

INF, NAN = float("inf"), float("nan")


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 64), st.sampled_from([2, 5, 300]), st.integers(1, 4))
def test_search_equals_all_distances(seed, entries, spread, width):
    rng = np.random.default_rng(seed)  # few values: many ties and repeated entries
    book, parts = rng.integers(-spread, spread, (entries, width)), rng.integers(-spread, spread, (200, width))
    at, best = vectorcodes.Search(book)(parts, rng.integers(0, entries, 200))
    every = ((parts[:, None] - book[None]) ** 2).sum(2)
    assert at.tolist() == every.argmin(1).tolist() and best.tolist() == every.min(1).tolist()


def test_search_leaves_entries_out():
    """Well separated entries: a part that starts at its own entry looks at no other."""
    book = np.arange(64)[:, None] * 1000
    search = vectorcodes.Search(book)
    assert np.searchsorted(search.apart[5], 4 * 3**2, side="right") == 1
    assert search(np.array([[5003]]), np.array([5]))[0].tolist() == [5]


def plainly(rows):
    good = [r for r in rows if r[1] is not None and len(r[1]) == 64 and all(x is not None and np.isfinite(x) for x in r[1])]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    fixed = [[int(np.floor(np.float32(x) * np.float32(256))) for x in r[1]] for r in good]
    parts = [[f[4 * p : 4 * p + 4] for f in fixed] for p in range(16)]
    books = [p[:64] for p in parts]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), i) for i, y in enumerate(book))
    for _ in range(2):
        for p in range(16):
            own = {}
            for x in parts[p]:
                own.setdefault(nearest(x, books[p])[1], []).append(x)
            books[p] = [[sum(c) // len(own[i]) for c in zip(*own[i], strict=True)] if i in own else y for i, y in enumerate(books[p])]
    final = [[nearest(x, books[p]) for x in parts[p]] for p in range(16)]
    error = [sum(final[p][i][0] for p in range(16)) for i in range(len(good))]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    total = {}
    for r, e in zip(good, error, strict=True):
        total[r[2]] = total.get(r[2], 0) + e
    return [(r[0], "".join(f"{final[p][i][1]:02x}" for p in range(16)), error[i], total[r[2]], sha) for i, r in enumerate(good)]


@pytest.mark.parametrize("n", [3, 150])
def test_codes_equal_plain_python(spark, n):
    rng = np.random.default_rng(n)
    floats = lambda: [float(np.float32(x)) for x in rng.normal(0, 0.2, 64)]
    rows = [(int(i), floats(), int(i % 3) or None, "clash") for i in rng.permutation(n)]
    rows += [(rows[0][0], rows[0][1], 1, "clash"), (rows[1][0], rows[2][1], None, "clash"), (None, floats(), 2, "clash"), (901, [0.0] * 64, 2, "clash"), (902, [0.0] * 64, 2, "clash")]
    rows += [(-1, None, 1, "clash"), (-2, [None] + [0.1] * 63, 1, "clash"), (-3, [NAN] + [0.1] * 63, 1, "clash"), (-4, [0.1] * 63 + [-INF], 1, "clash"), (-5, [], 1, "clash"), (9_005, [0.5] * 32, 1, "clash"), (-6, [1e30] * 64, 1, "clash")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string").repartition(3)
    found = vectorcodes.codes(table).drop("label").collect()
    want = plainly([r for r in rows if r[0] != -6])
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    assert vectorcodes.codes(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
