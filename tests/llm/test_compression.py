import random
import re

from tests.llm.conftest import ODD
from tidewatch.llm import compression


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, again = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    counts = {}
    for w in windows:
        counts[w] = counts.get(w, 0) + 1
    inside = {i + j for i, w in enumerate(windows) if counts[w] > 1 for j in range(8)}
    n, repeats = len(words), len(inside)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, repeats, n < 20 or 100 * repeats > 30 * n)


def test_counts_equal_brute_force(make_docs):
    rng = random.Random(8)
    bits = ["a", "b", "ü", "\U0001f600", "#", "|<", " ", " ", "\n", "\n\n", "\t", "\x0b", "word", "same words come again and again in here\n", " ", "\x1c"]
    rows = list(enumerate("".join(rng.choice(bits) for _ in range(rng.randint(0, 80))) for _ in range(300))) + [(i, t) for i, t in ODD if i and i < 9 and i != 9]
    rows = [(1000 + k, t) for k, (_, t) in enumerate(rows)]
    for r in compression.judged(make_docs(rows)).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(dict(rows)[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_bands(make_docs):
    rng = random.Random(1)
    plain = lambda n: " ".join("".join(rng.choice(["tion", "er", "an", "the", "o", "st", "ing"]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    noise = " ".join("".join(chr(rng.randint(33, 126)) for _ in range(9)) for _ in range(800))
    # no eight words repeat, yet little is new
    dull = " ".join("a" * 60 + format(i, "012b").replace("0", "c").replace("1", "d") for i in range(900))
    half = plain(400) + " " + noise + noise[::-1]
    got = {r.doc_id: r for r in compression.judged(make_docs([(1, plain(60)), (2, plain(3000)), (3, noise), (4, dull), (5, half)])).collect()}
    assert got[1].kept and got[2].kept
    assert not got[3].base_failed and not got[3].kept and got[3].ratio > 0.8
    assert not got[4].base_failed and not got[4].kept
    assert not got[5].kept and got[5].n_bad_chunks > got[5].n_chunks / 2


def test_empty_and_repeated(make_docs):
    assert compression.judged(make_docs([])).count() == 0
    assert compression.judged(make_docs(ODD)).count() == len(ODD)
