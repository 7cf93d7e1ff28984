import random

from tests.llm.conftest import ODD
from tidewatch.llm import decontaminate as dc
from tidewatch.llm.decontaminate import best_match, brute_force, leaks, normal, pieces, without_leaks


def edited(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        at = rng.randrange(len(chars))
        what = rng.randrange(3)
        if what == 0:
            chars[at] = "#"
        elif what == 1:
            del chars[at]
        else:
            chars.insert(at, "#")
    return "".join(chars)


def test_matches_the_full_table(spark, make_docs):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 18)))) for i in range(6)] + [(6, None), (7, ""), (8, "short one")]
    docs = []
    for i in range(40):
        parts = [" ".join(word() for _ in range(12))]
        if i % 2:
            item = items[rng.randrange(6)][1]
            parts.insert(rng.randrange(2), edited(rng, item, rng.choice([0, 1, 2, 4, 7, 9])))
        docs.append((i, "  ".join(parts).upper() if i % 3 else "\n".join(parts)))
    docs += [(100, "it is a SHORT\n one indeed")]
    got = {(r.doc_id, r.item_id, r.edits) for r in leaks(make_docs(docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute_force(docs, items)
    assert got == want and len(want) > 8


def test_myers_and_pieces():
    assert pieces("abcdefg", 2) == [(0, "ab"), (2, "cd"), (4, "efg")]
    item = "kitten sitting"
    masks = {}
    for j, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << j
    assert best_match(item, masks, "a kitten sitting here") == (0, 16)
    assert best_match(item, masks, "a kiten sitXting here")[0] == 2
    assert normal(" A\t b\n") == "a b"


def test_odd_rows_and_empty_tables(spark, make_docs):
    items = spark.createDataFrame([(1, "no id at all in this row of text"), (None, "word"), (2, None)], "item_id long, text string")
    docs = make_docs(ODD)
    assert [(r.doc_id, r.item_id) for r in leaks(docs, items).collect()] == [(None, 1)]
    kept = without_leaks(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(ODD) - 1
    assert without_leaks(docs, items.limit(0)).count() == len(ODD)
    assert leaks(make_docs([]), items).count() == 0


def test_a_match_is_returned_where_it_stands_whatever_was_inserted_or_left_out():
    rng = random.Random(8)
    item = "".join(rng.choice("abcdefgh ijklm") for _ in range(130)).strip()
    item = " ".join(item.split())
    for _ in range(200):
        edited = list(item)
        for _ in range(rng.randint(0, len(item) // dc.CHARS_PER_EDIT)):
            at, kind = rng.randrange(2, len(edited) - 2), rng.choice(["in", "out", "other"])
            edited[at:at + (kind != "in")] = [] if kind == "out" else ["Z".lower()]
        before, after = "qqqq " * rng.randint(0, 3), " wwww" * rng.randint(0, 3)
        body = "".join(edited)
        text = before + body + after
        found = dc.Matcher([(7, item)]).leaks(text)
        assert len(found) == 1
        start, end = found[0]["start"], found[0]["end"]
        # the place is that of a part at the distance reported, and the planted one up to its last edits
        assert abs(start - len(before)) <= found[0]["edits"] and abs(end - len(before) - len(body)) <= found[0]["edits"]
        best = dc.best_match(item, {c: sum(1 << j for j, x in enumerate(item) if x == c) for c in set(item)}, text[start:end])
        assert best[0] == found[0]["edits"] and dc.matched(item, text[:end], found[0]["edits"]) == end - start


def test_two_slabs_of_equal_size_do_not_meet_each_others_items(spark, make_docs, monkeypatch):
    monkeypatch.setattr(dc, "SLAB_CHARS", 60)
    items = [(1, "the first test item is about rivers and seas"), (1, "the other test item tells of hills and woods"), (2, "a third one has to do with cities and towns")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = make_docs([(i, f"so {t} it is") for i, (_, t) in enumerate(items)])
    got = sorted((r.doc_id, r.item_id, r.edits, r.start) for r in dc.leaks(docs, benchmark).collect())
    assert got == [(0, 1, 0, 3), (1, 1, 0, 3), (2, 2, 0, 3)]
