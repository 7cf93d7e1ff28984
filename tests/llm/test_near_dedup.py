import random

from tests.llm.conftest import ODD
from tidewatch.llm.components import components
from tidewatch.llm.near_dedup import keep_first, near_duplicates


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t))
    ids, root = sorted(sets), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    rows = []
    for family in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 20, 60, 120]))]
        for copy in range(rng.choice([1, 2, 9])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append(" ".join(words).replace("w1", "W1", rng.choice([0, 1])))
    rng.shuffle(rows)
    return list(enumerate(rows, 100))


def test_classes_equal_all_pairs(make_docs):
    for seed in (1, 2):
        rows = corpus(seed)
        got = near_duplicates(make_docs(rows)).collect()
        want = brute(rows)
        assert {r.doc_id: r.component_id for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
        assert {r.doc_id: r.n_shingles for r in got} == {i: len(shingles(t)) for i, t in rows}


def test_family_below_the_threshold_stays_apart(make_docs):
    # members share most shingles with the base, hardly enough with each other: mixed buckets, resolved exactly
    rng = random.Random(5)
    base = ["b%d" % i for i in range(60)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(60), rng.choice([1, 2, 3])):
            words[at] = "own%d_%d" % (i, at)
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.component_id for r in near_duplicates(make_docs(rows)).collect()}
    assert got == brute(rows)


def test_odd_rows(make_docs):
    got = near_duplicates(make_docs(ODD)).collect()
    assert len(got) == len(ODD)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].n_shingles == by_id[2].n_shingles == by_id[3].n_shingles == 0
    assert by_id[6].n_shingles == 1 and by_id[5].n_shingles == 1
    assert all(r.kept for r in got)
    assert by_id[None].component_id is None
    assert near_duplicates(make_docs([])).count() == 0


def test_one_of_each_group_stays(make_docs):
    docs = make_docs([(5, "a b c d e f"), (3, "A b  c d e f"), (9, "other words are in this one"), (4, None), (6, None)])
    kept = keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 6, 9]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (300, 299), (299, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 299: 299, 300: 299}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
