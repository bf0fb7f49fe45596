"""Forms that let a query's work grow with its table, each against all pairs."""

import random

import pytest
from pyspark.sql import functions as F


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def all_pairs(rows, threshold):
    """{(a, b): identity} of the similar ones of rows (rep, seq, ...)."""
    found = {}
    for a, x, *_ in rows:
        for b, y, *_ in rows:
            n = max(len(x), len(y))
            if a < b and n and (e := edits(x, y)) <= int((1 - threshold) * n + 1e-9):
                found[a, b] = 1 - e / n
    return found


def roots(nodes, pairs):
    root = {a: a for a in nodes}
    while any(root[a] != root[b] for a, b in pairs):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


def counted(counts):
    """{(smaller mask, larger mask): [n, m]} of what aligned_blocks counts."""
    found = {}
    for r in counts.collect():
        have = found.setdefault((min(r.mask_a, r.mask_b), max(r.mask_a, r.mask_b)), [0, None])
        have[0] += r.n
        have[1] = max(x for x in (have[1], r.m, -1) if x is not None)
    return {k: v for k, v in found.items() if v[0]}


def test_names_meet_few_candidates(spark):
    """Numbered names share all their q-grams; what a deletion leaves is shared by those that differ in one place."""
    from splitwarden.operators import identity

    rows = [(k, f"Customer#{k * 7 % 1000:09d}") for k in range(300)] + [(1000, "Customer#00000001"), (1001, "Customer#0000000011"), (1002, "")]
    df = spark.createDataFrame(rows, "rep long, seq string")
    want = all_pairs(rows, 0.9)
    groups = identity._deletions(df.where("length(seq) = 18"), 0.9, 1).groupBy("variant").count()
    assert groups.agg(F.sum(F.expr("count * (count - 1) / 2"))).first()[0] < 300 * 299 / 20
    for threshold in (0.9, 0.94):
        got = [(r.a, r.b, round(r.identity, 9)) for r in identity.similar_pairs(df, threshold).collect()]
        assert sorted(got) == sorted((a, b, round(v, 9)) for (a, b), v in all_pairs(rows, threshold).items()) and got


def test_long_strings_are_aligned_many_at_a_time():
    import numpy as np

    from splitwarden.operators import alignment_kernel as kernel

    rng = random.Random(3)
    a = ["".join(rng.choice("abcdé 0") for _ in range(rng.choice([65, 64 * 2, 64 * 2 + 1, 100, 200, 333]))) for _ in range(20)]
    b = [s[rng.randrange(9) :].replace("b", rng.choice("bc")) + "x" * rng.randrange(70) for s in a]
    (x, m), (y, n) = kernel.codes(a), kernel.codes(b)
    i, j = (v.ravel() for v in np.indices((20, 20)))
    want = [edits(a[p], b[q]) for p, q in zip(i, j)]
    assert kernel._long(x, m, y, n, i, j, pairs=150).tolist() == want
    assert kernel._long(y, n, x, m, j, i).tolist() == want
    got = kernel.identities(a, b, i, j, 0.4)
    assert got == pytest.approx([1 - e / max(len(a[p]), len(b[q])) if e <= int(0.6 * max(len(a[p]), len(b[q])) + 1e-9) else 0 for p, q, e in zip(i, j, want)])


def test_reaching_rows_come_in_small_batches(spark):
    """A row may be sent to every ball, so what one Arrow batch becomes must not grow with the balls."""
    import numpy as np
    import pyarrow as pa

    from splitwarden.operators.similarity import Balls

    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(rng.normal(size=(600, 4)))], "id long, v array<double>")
    balls = Balls(df, "euclidean", 2)
    x = pa.RecordBatch.from_pydict({"id": pa.array(range(4000)), "v": pa.array(rng.normal(size=(4000, 4)).tolist()), "reach": pa.array([100.0] * 4000)})
    sizes = [b.num_rows for b in balls.reached()([x])]
    assert max(sizes) <= 65536 and sum(sizes) == 4000 * int((balls.radius >= 0).sum())


def test_rows_are_sent_to_a_bounded_number_of_tiles():
    import numpy as np

    from splitwarden.operators.similarity import _nearest, _tile_rows

    assert [-(-n // _tile_rows(n)) for n in (1, 2048, 40000, 10**5, 10**6)] == [1, 1, 16, 16, 16]
    far = np.array([[3.0, 1, 1, 2, 1], [np.inf, 5, np.inf, 4, 4], [np.inf] * 5])
    assert [v.tolist() for v in _nearest(far, 2)] == [[0, 0, 1, 1], [1, 2, 3, 4]]
    assert [v.tolist() for v in _nearest(far, 9)] == [[0] * 5 + [1] * 3, [1, 2, 4, 3, 0, 3, 4, 1]]


def test_counts_and_forests_of_packs_and_hubs(spark):
    """Certain pairs are counted, and hubs come first; the results are those of all pairs."""
    from splitwarden.operators import identity

    rng = random.Random(4)
    rows = [(k, f"Customer#{k:05d}", 1 << k % 2) for k in range(60)] + [(100 + k, "".join(rng.choice("abCust") for _ in range(rng.randint(3, 30))), 1 << k % 3) for k in range(60)]
    rows += [(200 + k, "prefix" + c * 6, m) for k, (c, m) in enumerate(zip("qwertyuiop", [1, 4] * 5))]
    df = spark.createDataFrame(rows, "rep long, seq string, mask int")
    pairs, mask = all_pairs(rows, 0.3), {r[0]: r[2] for r in rows}
    for across in ([(1, 2)], [(1, 4), (1, 2), (2, 4)]):
        want = {}
        for (a, b), v in pairs.items():
            key = tuple(sorted((mask[a], mask[b])))
            if key in across:
                n, m = want.get(key, (0, 0))
                want[key] = [n + 1, max(m, v)]
        assert counted(identity.aligned_blocks(df, 0.3, "counts", rows_per_block=8, across=across)) == {k: [n, pytest.approx(m)] for k, (n, m) in want.items()}
    edges = [(r.a, r.b) for r in identity.aligned_blocks(df, 0.3, "forest", rows_per_block=8, hubs=2, few=0).collect()]
    assert set(edges) <= set(pairs) and roots(mask, edges) == roots(mask, pairs)


def test_names_that_differ_in_digits_are_counted_not_compared(spark, monkeypatch):
    """Numbers before and after a common word make many prefixes, but two patterns, whose pairs are all similar."""
    from splitwarden.operators import identity

    rows = [(k, f"{k % 40}-Customer#{k * 7:07d}", 1 << k % 3) for k in range(120)]
    df = spark.createDataFrame(rows, "rep long, seq string, mask int")
    compared, met = identity._compared, []

    def watched(some, threshold, want, rows_per_block, meets):
        kinds = [r["kind"] for r in some.select("kind").distinct().collect()]
        met.extend((x, y) for x in kinds for y in kinds if meets(x, y))
        return compared(some, threshold, want, rows_per_block, meets)

    monkeypatch.setattr(identity, "_compared", watched)
    across, want = [(1, 2), (1, 4), (2, 4)], {}
    for (a, b), v in all_pairs(rows, 0.3).items():
        key = tuple(sorted((rows[a][2], rows[b][2])))
        if key in across:
            n, m = want.get(key, (0, 0))
            want[key] = [n + 1, max(m, v)]
    assert counted(identity.aligned_blocks(df, 0.3, "counts", rows_per_block=8, across=across)) == {k: [n, pytest.approx(m)] for k, (n, m) in want.items()}
    assert not met


@pytest.mark.parametrize("test", ["Customer#000000999", "Customer#00000000", "Customer#000000456", "Customer#987654321", "9999-Stomer#1", "x", None])
def test_highest_identity_between_counted_names(spark, test):
    """The closest pair may be one digit, one inserted character or many edits apart, or the same name in both parts, wherever it is looked for."""
    from splitwarden.operators import identity

    rows = [(k, f"Customer#{k:09d}", "train") for k in range(1100)] + [(2000, "Supplier", "val"), (2001, "Customer#000000017", "val"), (2002, test, "test")]
    df = spark.createDataFrame(rows, "rep long, seq string, partition string")
    got = {(r.part_a, r.part_b): (r.n_pairs, r.max_identity) for r in identity.similar_sequences(df, "rep", "seq", 0.3).collect()}
    held = {p: {s for _, s, part in rows if part == p and s} for p in ("train", "val", "test")}
    for (x, y), (n, m) in got.items():
        near = [1 - e / max(len(a), len(b)) for a in held[x] for b in held[y] if (e := edits(a, b)) <= int(0.7 * max(len(a), len(b)) + 1e-9)]
        assert (n, m) == (len(near), pytest.approx(max(near)) if near else None)


def test_components_take_no_round_to_see_that_they_are_done(spark, monkeypatch):
    """Stars are components already; what isn't a star comes out as before."""
    from splitwarden.operators import components

    written, names = components.materialise, []
    monkeypatch.setattr(components, "materialise", lambda df, name: names.append(name) or written(df, name))
    rng = random.Random(6)
    stars = [(1, 5), (7, 1), (2, 9), (9, 2), (3, 3), (None, 4)]
    for edges, rounds in ((stars, 0), ([], 0), ([(1, 2), (2, 3)], 1), ([(k, k + 1) for k in range(40)], 8), ([(rng.randrange(90), rng.randrange(90)) for _ in range(60)], 8)):
        names.clear()
        got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
        pairs = [e for e in edges if None not in e]
        want = roots({x for e in pairs for x in e}, pairs)
        assert got == {n: r for n, r in want.items() if n != r} and names.count("large") <= rounds, (edges, names)


def test_what_hubs_leave_outside_meets_more_hubs_first(spark, monkeypatch):
    """The last comparison, with all, is of few rows only; the forest connects what all pairs do."""
    from splitwarden.operators import identity

    rng = random.Random(12)
    rows = [(k, "".join(rng.choice("abcdefgh"[: 4 if k % 6 else 8]) for _ in range(rng.randint(12, 15))), 0) for k in range(300)]
    rows += [(400 + k, c * 13, 0) for k, c in enumerate("XYZ")] + [(500, "Q" * 6 + "XXXXXXX", 0), (501, "1" * 13, 0), (502, "2" * 11, 0)]
    pairs, compared, outside = all_pairs(rows, 0.4), identity._compared, []

    def watched(some, threshold, want, rows_per_block, meets):
        outside.append(some.where("kind <> 1").count())
        return compared(some, threshold, want, rows_per_block, meets)

    monkeypatch.setattr(identity, "_compared", watched)
    forest = identity.aligned_blocks(spark.createDataFrame(rows, "rep long, seq string, mask int"), 0.4, "forest", rows_per_block=64, hubs=1, few=0, few_pairs=0)
    edges = [(r.a, r.b) for r in forest.collect()]
    assert set(edges) <= set(pairs) and roots([r[0] for r in rows], edges) == roots([r[0] for r in rows], pairs)
    assert len(outside) > 2 and outside[-1] <= 60, outside


def _by_distance(x, y, asked, ids, k):
    import numpy as np

    from splitwarden.operators.similarity import _distances

    out = []
    for a, row in zip(asked, np.round(_distances(x, y, "manhattan"), 9)):
        near = sorted((d, i) for d, i in zip(row.tolist(), ids) if i != a and np.isfinite(d))
        out += [(a, i, d) for d, i in near[:k]]
    return out


@pytest.mark.parametrize("kind", ["even", "heavy", "equal", "small", "wide"])
def test_manhattan_neighbours_work_out_few_distances(kind):
    """Steps of 6 bits bound the distances; what they leave is worked out in full, and the result is that of all."""
    import numpy as np

    from splitwarden.operators.similarity import _Grid, _nearest_in_steps

    rng = np.random.default_rng(8)
    y = {
        "even": lambda: rng.normal(size=(6000, 64)) / 8, "heavy": lambda: rng.standard_cauchy(size=(300, 5)), "equal": lambda: rng.integers(0, 2, (300, 3)) * 1.0,
        "small": lambda: rng.normal(size=(3, 2)), "wide": lambda: np.concatenate([rng.normal(size=(200, 600)), 1e6 * rng.normal(size=(3, 600))]),
    }[kind]()
    grid, x, ids = _Grid(y), y[:40], np.arange(len(y))
    want = _by_distance(x, y, range(40), range(len(y)), 5)
    least = {a: d for a, _, d in want}
    for reach in (None, np.array([least[a] + 0.001 for a in range(len(x))])):
        i, j, d = _nearest_in_steps(grid, x, y, reach, np.arange(len(x)), ids, 5, 9, some=200)
        assert list(zip(i.tolist(), j.tolist(), d.tolist())) == want[: len(i)] and len(i) == len(want)
    if kind == "even":
        assert len(grid.within(x, reach)[0]) < x.shape[0] * len(y) / 50


def test_manhattan_neighbours_with_ties_and_repeated_ids(spark):
    import numpy as np

    from splitwarden.operators.similarity import knn

    rng = np.random.default_rng(9)
    y = np.round(rng.normal(size=(500, 6)), 1)
    y[7, 2], y[11] = np.inf, y[12]
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(y)] + [(3, y[4].tolist())], "id long, embedding array<double>")
    ids, y = [*range(500), 3], np.concatenate([y, y[4:5]])
    for rows in (None, 40):
        got = [(r.a, r.b, r.distance) for r in knn(df.where("id % 9 = 2"), df, 4, rows_per_block=rows, metric="manhattan").orderBy("a", "rank").collect()]
        asked = [k for k in range(500) if k % 9 == 2]
        assert got == _by_distance(y[asked], y, asked, ids, 4)
