"""Ids of whole texts out of the ids of their pieces, each distinct piece being encoded once and remembered.

Most of a text is words met before, so words are remembered too: they are looked up as the text is cut at its spaces, and
only new ones are cut into pieces. ``BY_WORDS`` allows it: none of its pieces runs over the place before a space with a
character behind it that is no white space, none looks back, and white space that ends there is cut as at a text's end.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: the pattern whose pieces end before such spaces; by any other, whole texts are cut into pieces
BY_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: the places themselves, where a text has more white space than one space between its words
SPACES, SPACE = regex.compile(r" (?=\S)"), regex.compile(r"\s").match
#: longer words and pieces are not remembered
LONGEST = 64


def _key(piece: str) -> str:
    """What a piece is remembered by: a word without its space, anything else behind one."""
    return piece[1:] if piece[0] == " " and not piece.isspace() else " " + piece


class Remembered:
    """Ids by ``encode``, which gives those of some distinct pieces as 32-bit integers; up to twice ``most`` of them are remembered,
    and what one call adds."""

    def __init__(self, pattern: str, encode: Callable[[list[str]], list[bytes]], most: int):
        self.pattern, self.new_ids, self.most = regex.compile(pattern), encode, most
        self.find, self.by_words = self.pattern.findall, pattern == BY_WORDS
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _look(self, keys: list[str]) -> list[bytes | None]:
        """What is remembered by each key; what the older half alone has is taken over."""
        found = list(map(self.known.get, keys))
        if None in found and self.older:
            for i, ids in enumerate(found):
                if ids is None and (ids := self.older.get(keys[i])) is not None:
                    found[i] = self.known[keys[i]] = ids
        return found

    def of_pieces(self, rows: list[list[str]], words: list[str] = ()) -> list[bytes]:
        """The ids of each list of pieces, one behind the other; then those of ``words``, each a new piece behind a space."""
        if len(self.known) >= self.most:
            self.known, self.older = {}, self.known
        pieces = list(set().union(*rows))
        keys = list(map(_key, pieces))
        ids = dict(zip(pieces, self._look(keys)))
        missed = [(p, key) for p, key in zip(pieces, keys) if ids[p] is None]
        new = {w: " " + w for w in words}
        new.update((key, p) for p, key in missed)
        got = dict(zip(new, self.new_ids(list(new.values())), strict=True)) if new else {}
        self.known.update((key, own) for key, own in got.items() if len(key) <= LONGEST)
        ids.update((p, got[key]) for p, key in missed)
        return [b"".join(map(ids.__getitem__, row)) for row in rows] + [got[w] for w in words]

    def of_cut(self, heads: list[str], words: list[str]) -> list[bytes]:
        """The ids of the beginnings of texts, then those of distinct new words behind a space."""
        plain = [w.isascii() and w.isalpha() for w in words]
        rest = [self.find(" " + w) for w, whole in zip(words, plain) if not whole]
        found = self.of_pieces([*map(self.find, heads), *rest], [w for w, whole in zip(words, plain) if whole])
        n, own = len(heads), iter(found[len(heads):len(heads) + len(rest)])
        singles = iter(found[len(heads) + len(rest):])
        return found[:n] + [next(singles if whole else own) for whole in plain]

    def of_texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        if not self.by_words or not texts:
            return self.of_pieces(list(map(self.find, texts)))
        rows = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        ends, flat = rows.offsets.to_numpy(), rows.flatten()
        first = np.zeros(len(flat), bool)
        first[ends[:-1]] = True
        heads, coded = flat.filter(pa.array(first)).to_pylist(), flat.filter(pa.array(~first)).dictionary_encode()
        words, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        ids, sizes = self._look(words), np.diff(ends)
        # words that begin with white space are never remembered; their texts are cut at the right spaces
        odd = [i for i, w in enumerate(words) if ids[i] is None and (not w or w[0].isspace() and SPACE(w))]
        if odd:
            number, own = {w: i for i, w in enumerate(words)}, np.split(codes, np.cumsum(sizes - 1)[:-1])
            for row in np.unique(np.repeat(np.arange(len(texts)), sizes - 1)[np.isin(codes, odd)]).tolist():
                heads[row], *rest = SPACES.split(texts[row])
                own[row] = np.array([number.setdefault(w, len(number)) for w in rest], np.int32)
            words, codes, sizes = list(number), np.concatenate(own), np.array([len(c) + 1 for c in own])
            ids += self._look(words[len(ids):])
            for i in odd:
                ids[i] = b""
            first = np.zeros(len(codes) + len(texts), bool)
            first[np.cumsum(sizes) - sizes] = True
        new = [i for i, own in enumerate(ids) if own is None]
        if len(self.known) >= self.most:
            self.known, self.older = {}, self.known
        found = self.of_cut(heads, [words[i] for i in new])
        for i, own in zip(new, found[len(heads):]):
            ids[i] = own
            if len(words[i]) <= LONGEST:
                self.known[words[i]] = own
        # every head and word brings its ids, all texts at once
        ids += found[:len(heads)]
        which = np.empty(len(first), np.int64)
        which[first], which[~first] = np.arange(len(heads)) + len(words), codes
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        counts, starts = lengths[which], np.cumsum(lengths) - lengths
        after = np.cumsum(counts)
        places = np.repeat(starts[which] - after + counts, counts)
        places += np.arange(len(places))
        raw = np.frombuffer(b"".join(ids), np.uint32)[places].tobytes()
        cuts = 4 * after[np.cumsum(sizes) - 1]
        return [raw[a:b] for a, b in zip([0, *cuts.tolist()], cuts.tolist())]
