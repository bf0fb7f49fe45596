"""The corpus pipeline against a brute-force version."""

import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from splitwarden.llm import packing
from splitwarden.llm.queries import QUALITY
from splitwarden.llm.simhash import near_duplicates

from . import brute
from .test_operators import check_pieces, check_sequences, prose


def corpus(seed=0):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randint(40, 400), 3000), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), i) for i in range(120)]
    for i in range(120, 200):
        text = rng.choice(rows[:120])[1]
        if i % 2:
            words = text.split(" ")
            words[rng.randrange(len(words))] = "edit"
            text = " ".join(words)
        rows.append((i, text, "en", "a", None))
    notice = prose(rng, 30, 3000)  # in more than 20 documents of a source
    rows = [(i, f"{t}\n{notice.upper()}", *rest) if i % 4 == 0 and rest[1] == "a" else (i, t, *rest) for i, t, *rest in rows]
    return rows + [(300, None, None, None, 0), (301, "", "en", "a", 0), (302, "x " * 200, "en", "b", 400)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def near_pairs(texts):
    """Pairs of five-word Jaccard 0.8 or more, of all pairs of {id: text}."""
    words = {i: brute.WORD.findall((t or "").lower()) for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items() if w}
    return [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]


def smallest_of_groups(ids, pairs):
    root = {i: i for i in ids}
    before = None
    while before != root:
        before = dict(root)
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return sorted(i for i, r in root.items() if i == r)


def test_stages_match_brute_force(spark, tmp_path):
    rows = corpus()
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    by_id, docs, kept = {r[0]: r for r in rows}, spark.read.parquet(path), [r[0] for r in rows]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "exact dedup", "simhash near-dedup", "mixing", "packing"]

    def step(name):
        out = stages[name](spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        again = spark.read.parquet(str(tmp_path / name))
        assert all(tuple(r) == by_id[r.doc_id] for r in again.collect())
        return again

    plain = [(i, by_id[i][1], by_id[i][3]) for i in kept]
    judged, often = brute.quality(plain, **QUALITY, count="texts"), brute.boilerplate(plain, QUALITY["max_docs"], "texts")
    kept = [i for i in kept if judged[i][6]]
    for i in kept:
        left = "\n".join(x for x in by_id[i][1].split("\n") if not often(by_id[i][3], x))
        if left != by_id[i][1]:
            by_id[i] = (i, left, *by_id[i][2:4], len(left))
    assert any(by_id[i][4] not in (i, None) for i in kept)
    docs = step("quality rules")
    assert sorted(r.doc_id for r in docs.collect()) == kept

    last = {by_id[i][1]: i for i in kept}
    kept = sorted(last.values())
    docs = step("exact dedup")
    assert sorted(r.doc_id for r in docs.collect()) == kept

    kept = smallest_of_groups(kept, near_pairs({i: by_id[i][1] for i in kept}))
    docs = step("simhash near-dedup")
    assert sorted(r.doc_id for r in docs.collect()) == kept and len(kept) < len(last)

    sizes = defaultdict(int)
    for i in kept:
        sizes[by_id[i][3]] += len(by_id[i][1].split())
    docs = step("mixing")
    copies = Counter(r.doc_id for r in docs.collect())
    assert set(copies) <= set(kept) and max(copies.values()) <= 2
    for source, target in brute.targets(dict(sizes)).items():
        assert abs(sum(n * len(by_id[i][1].split()) for i, n in copies.items() if by_id[i][3] == source) - target) <= 0.05 * target

    packed = stages["packing"](spark, docs, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in packed if r.start == 0) == copies
    code = packing.coder(packing.tokenizer_path())
    assert sum(r.length for r in packed) == sum(n * (len(code.encode(by_id[i][1])) // 4 + 1) for i, n in copies.items())
    once = [(i, by_id[i][1]) for i, n in copies.items() if n == 1]
    check_pieces([r for r in packed if copies[r.doc_id] == 1], once, code)
    assert check_sequences(packed, 2048) < 0.2


def test_run_and_awkward_tables(spark, tmp_path):
    spark.createDataFrame(corpus(1), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} == set(rows[0].asDict())
    odd = [
        (None, None, None, None, None), (1, "", "en", None, 1), (1, "a", "en", "s", 1), (1, "a", "en", "s", 1), (None, "b " * 300, None, "s", 2),
        (2, "c " * 90_000, "de", "t", 3)
    ]
    extra = "kept string, `__words` string, component_id string, copies string, `a.b` string"
    for some in (odd, []):
        for _, stage in corpus_pipeline.STAGES:
            df = spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in some], f"{SCHEMA}, {extra}")
            rows = stage(spark, df, str(tmp_path)).collect()
            if stage is corpus_pipeline.STAGES[-1][1]:
                assert Counter(r.doc_id for r in rows if r.start == 0) == Counter(r[0] for r in some)
            else:
                assert {r.doc_id for r in rows} <= {r[0] for r in some} and len(rows) <= 2 * len(some)
                assert all(r.kept == r["__words"] == r["a.b"] == "x" for r in rows)


def test_mixing_counts_rows_not_ids(spark, tmp_path):
    """Rows that share an id, or have none, are taken one by one."""
    rng = random.Random(31)
    rows = [(k // 2 if k < 400 else None, prose(rng, rng.randint(5, 40)), "en", rng.choice("abc"), k) for k in range(800)]
    sizes, taken, times = Counter(), Counter(), Counter()
    for r in rows:
        sizes[r[3]] += len(r[1].split())
    for r in dict(corpus_pipeline.STAGES)["mixing"](spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect():
        assert tuple(r) == rows[r.n_chars]
        taken[r.source] += len(r.text.split())
        times[r.n_chars] += 1
    assert max(times.values()) <= 2
    for source, target in brute.targets(dict(sizes)).items():
        assert abs(taken[source] - target) < 40


def test_no_near_copy_reaches_mixing(spark, tmp_path):
    rng = random.Random(3)
    rows = corpus(2)
    for i in range(400, 440):  # several edits, and chains of edits
        words = rng.choice(rows[:120] + rows[203:])[1].split(" ")
        for _ in range(rng.randint(1, 6)):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(50)}"
        rows.append((i, " ".join(words), "en", "a", None))
    docs = spark.createDataFrame(rows, SCHEMA)
    names = [n for n, _ in corpus_pipeline.STAGES]
    before = None
    for name, stage in corpus_pipeline.STAGES[: names.index("mixing")]:
        before, docs = docs, stage(spark, docs, str(tmp_path)).cache()
    kept, given = ({r.doc_id: r.text for r in df.collect()} for df in (docs, before))
    assert not near_pairs(kept)
    assert sorted(kept) == smallest_of_groups(given, near_pairs(given))


def test_near_copies_of_a_large_group(spark):
    """Buckets of far more texts than a tile, against all pairs."""
    rng = random.Random(4)
    base = prose(rng, 120, 3000)
    rows = []
    for i in range(150):
        words = base.split(" ")
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(50)}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, prose(rng, 100, 3000)) for i in range(50)] + [(400, None), (401, ""), (402, "a"), (403, "A"), (None, base)]
    texts = {i: t for i, t in rows if i is not None}
    want = set(texts) - set(smallest_of_groups(texts, near_pairs(texts)))
    # most of these texts differ by three edits, which is just below the threshold, so a group has few links among many close pairs
    for tile in (1024, 16):
        found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), tile=tile).collect()
        gone = {r.node for r in found if r.node != r.root}
        assert gone == want and len(want) > 80, (tile, gone - want, want - gone, len(want))
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("tile", [1024, 8])
def test_near_copies_of_many_groups(spark, tile):
    """Groups of copies with two edits each, of which most pairs are just below the threshold, against all pairs."""
    rng = random.Random(9)
    rows = []
    for _ in range(40):
        base = prose(rng, 120, 3000).split(" ")
        for _ in range(30):
            words = list(base)
            for _ in range(2):
                words[rng.randrange(len(words))] = f"edit{rng.randrange(50)}"
            rows.append((len(rows), " ".join(words)))
    texts = dict(rows)
    want = set(texts) - set(smallest_of_groups(texts, near_pairs(texts)))
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), tile=tile).collect()
    gone = {r.node for r in found if r.node != r.root}
    assert gone == want and len(want) > 100, (len(want), len(want - gone), len(gone - want))


def test_rounds_of_near_copies_keep_the_drivers_plans_small(spark, monkeypatch):
    """The tables that a round reads are as many in the last round as in the second, and rounds read only texts that can be in a pair."""
    from splitwarden.llm import simhash

    rng = random.Random(9)
    rows = []
    for _ in range(12):
        base = prose(rng, 120, 3000).split(" ")
        for _ in range(20):
            words = list(base)
            for _ in range(2):
                words[rng.randrange(len(words))] = f"edit{rng.randrange(50)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(1000 + k, prose(rng, 100, 3000)) for k in range(400)]
    written, scans = simhash.materialise, {}

    def watched(df, name):
        scans.setdefault(name, []).append(df._jdf.queryExecution().optimizedPlan().collectLeaves().size())
        out = written(df, name)
        if name == "asked":
            scans["rows"] = out.count()
        return out

    monkeypatch.setattr(simhash, "materialise", watched)
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), tile=64)
    texts = dict(rows)
    assert {r.node for r in found.collect() if r.node != r.root} == set(texts) - set(smallest_of_groups(texts, near_pairs(texts)))
    assert len(scans["proposals"]) > 3 and scans["proposals"][1] == scans["proposals"][-1] and scans["verified"][1] == scans["verified"][-1], scans
    assert scans["rows"] <= 240 + 40, scans["rows"]
