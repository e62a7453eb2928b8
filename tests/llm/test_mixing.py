import math
from fractions import Fraction

from quern.llm import mixing as M


def water_fill(sizes, weights=M.WEIGHTS):
    """Caps the fullest source again and again, as the words of the task say."""
    names = sorted(sizes, key=lambda x: (x is None, (x or "").encode()))
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    left, free, out = Fraction(3, 2) * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(w[n] for n in free)
        full = [n for n in free if level * w[n] > 2 * sizes[n]]
        if not full:
            return out | {n: float(level * w[n]) for n in free}
        for n in full:
            out[n] = float(2 * sizes[n])
            left -= 2 * sizes[n]
            free.discard(n)
    return out


def rows(sizes_by_source):
    k = 0
    for s, sizes in sizes_by_source.items():
        for n in sizes:
            yield (k, s, n)
            k += 1


def test_targets_and_selection(spark):
    data = list(rows({"a": [3] * 200, "b": [1, 5, 9, 200] * 40, None: [7] * 150, "": [2] * 3, "z": [0, 0], "c": [50] * 90}))
    df = spark.createDataFrame(data, "doc_id long, source string, size long")
    got = M.allocate(df).collect()
    again = M.allocate(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(data)
    sizes = {}
    for _, s, n in data:
        sizes[s] = sizes.get(s, 0) + n
    want, largest = water_fill(sizes), {}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert math.isclose(r.target, want[r.source]) and 0 <= r.copies <= 2 and r.source_size == sizes[r.source]
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]


def taken_and_targets(got):
    taken, target, largest = {}, {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
        target[r.source], largest[r.source] = r.target, max(largest.get(r.source, 0), r.size)
    return all(abs(taken[s] - target[s]) <= largest[s] for s in taken), taken


def test_rows_that_tie_are_taken_up_to_the_target(spark):
    """Null ids, one id over and over, and rows that are alike in everything, each a third of a source or all of it."""
    alike, mixed = [10] * 600, [1 + i % 9 for i in range(600)]
    for ids, sizes in (([None] * 600, alike), ([7] * 600, mixed), ([None] * 200 + [7] * 200 + list(range(10, 210)), alike)):
        data = [(i, s, n) for s in ("a", "b", None) for i, n in zip(ids, sizes, strict=True)]
        df = spark.createDataFrame(data, "doc_id long, source string, size long")
        assert taken_and_targets(M.allocate(df).collect())[0]
    assert taken_and_targets(M.allocate(df).collect()) == taken_and_targets(M.allocate(df.repartition(5)).collect())


def test_texts_of_one_id_draw_numbers_of_their_own(docs):
    df = M.sized(docs([(None if i % 2 else 5, "word " * 9 + str(i), "en", "abc"[i % 3]) for i in range(900)]))
    got = M.allocate(df, draw="draw", keep=("text",)).collect()
    assert taken_and_targets(got)[0] and len({r.text for r in got}) == 900
    assert {(r.source, r.copies) for r in got} == {(r.source, r.copies) for r in M.allocate(df.repartition(3), draw="draw").collect()}


def test_levels_of_many_sources(spark):
    sizes = {f"s{i:03}": (i * 37 % 101) ** 2 + (i == 7) for i in range(400)}
    got = {r.source: r.target for r in M.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = water_fill(sizes)
    assert all(math.isclose(got[s], want[s]) for s in sizes)


def test_sizes_and_awkward_rows(awkward, empty):
    from quern.llm.common import materialize

    s = materialize(M.sized(awkward), "t")
    got = M.allocate(s).collect()
    assert len(got) == 9 and all(r.copies == 0 for r in got if r.size == 0)
    assert M.allocate(M.sized(empty)).count() == 0
