"""Tokenizing whole texts with the tokenizers library, each distinct word once per worker.

Both tokenizers split a text before they merge, and never across the space between two words, so a text's ids are those
of its space-separated chunks in a row. Encoding a chunk costs far more than finding it, so a worker keeps the ids of up to
MEMO words, found by 128-bit hashes in arrays of about 40 bytes a word; beyond that, those not met for longest go.
Texts in which a space touches other white space, or begins or ends the text, are encoded whole, as there the split of white space
depends on both sides; so are texts that hold the string of one of the tokenizer's special tokens in any case.

Such strings get the ids that the library's plain call gives them. With plain_specials they are encoded as ordinary text
instead, so that a text can't forge an end of document.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words whose ids a worker keeps, at most.
MEMO = 800_000
#: Bytes of texts that are encoded at a time; words of letters that are encoded as one text.
SLICE, RUN = 4_000_000, 500
_ODD = r"(^ )|( $)|([\s\pZ\x{85}\x{1c}-\x{1f}] [\s\pZ\x{85}\x{1c}-\x{1f}])"
TAIL = ".,;:!?|"
_TAILS = r"(?P<tail>[.,;:!?|]+)$"
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LATER = np.uint64(0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_hashes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each string, by its bytes eight at a time."""
    strings = strings.cast(pa.large_binary())
    if not len(strings):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    raw = np.frombuffer(strings.buffers()[2], np.uint8) if strings.buffers()[2] else np.zeros(0, np.uint8)
    raw = np.concatenate([raw[offsets[0] : offsets[-1]], np.zeros(8, np.uint8)])
    eight = np.ndarray(len(raw) - 7, np.dtype("<u8"), raw, strides=(1,))
    at, left = offsets[:-1] - offsets[0], np.diff(offsets)
    one, two = _mix(left.astype(np.uint64) + _P), _mix(left.astype(np.uint64) + _Q)
    todo = np.flatnonzero(left > 0)
    at, left = at[todo], left[todo]
    while len(todo):
        word = eight[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (np.uint64(8) - np.minimum(left, 8).astype(np.uint64))))
        one[todo] = _mix(one[todo] * _P + word)
        two[todo] = _mix(two[todo] * _Q ^ word)
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    return one, two


class _Known:
    """Ids of words by hash: sorted keys, where each word's ids begin in a pool, how many they are, and when it was last met."""

    def __init__(self) -> None:
        self.one, self.two = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.length, self.met = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.pool, self.tick = np.zeros(0, np.uint32), 0

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Each word's place, or -1."""
        if not len(self.one) or not len(one):
            return np.full(len(one), -1)
        order = np.argsort(one)  # in key order, searches stay within the cache
        at = np.empty(len(one), np.int64)
        at[order] = np.searchsorted(self.one, one[order])
        at[at == len(self.one)] = 0
        at[(self.one[at] != one) | (self.two[at] != two)] = -1
        return at

    def use(self, at: np.ndarray) -> None:
        self.tick += 1
        self.met[at] = self.tick

    def add(self, one: np.ndarray, two: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        """New words, whose ids stand in a row; a first hash that is held already, or comes twice, keeps its first word."""
        if len(self.one) + len(one) > MEMO:
            self._drop()
        length = length.astype(np.int32)
        start = len(self.pool) + np.cumsum(length, dtype=np.int32) - length
        self.pool = np.concatenate([self.pool, ids])
        key = np.concatenate([self.one, one])
        _, order = np.unique(key, return_index=True)
        new = lambda a, b: np.concatenate([a, b])[order]
        self.one, self.two = key[order], new(self.two, two)
        self.start, self.length, self.met = new(self.start, start), new(self.length, length), new(self.met, np.full(len(one), self.tick, np.int32))

    def _drop(self) -> None:
        """The half that wasn't met for longest goes."""
        keep = np.sort(np.argsort(-self.met, kind="stable")[: MEMO // 2])
        length = self.length[keep]
        end = np.cumsum(length, dtype=np.int64)
        self.pool = self.pool[np.repeat(self.start[keep] - (end - length), length) + np.arange(int(end[-1]) if len(end) else 0)]
        self.one, self.two, self.length, self.met = self.one[keep], self.two[keep], length, self.met[keep]
        self.start = (end - length).astype(np.int32)


class Encoder:
    """joined: whether a chunk's ids depend on the space before it (byte-level), or white space is dropped (word level)."""

    def __init__(self, source: str | bytes, plain_specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(source) if isinstance(source, bytes) else Tokenizer.from_file(source)
        self.tokenizer.encode_special_tokens = plain_specials
        self.specials = [] if plain_specials else sorted({x.content for x in self.tokenizer.get_added_tokens_decoder().values()})
        same = lambda a, b: self._ids([a])[0].tolist() == self._ids([b])[0].tolist()
        self.joined, self.lowers = not same(" a", "a"), same("A", "a")
        # Ids that a word's first (byte-level) or last (word level) piece has, and no other one: runs of words are told apart by them.
        vocabulary = self.tokenizer.get_vocab()
        self.marks = np.zeros(max(vocabulary.values()) + 1, bool)
        self.marks[[i for x, i in vocabulary.items() if (x.startswith("\u0120") if self.joined else x.endswith("</w>"))]] = True
        self.known = _Known()

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts in a row, and how many each has."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return np.fromiter(chain.from_iterable([x.ids for x in found]), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters only, each behind a space where that matters: many of them are encoded as one text."""
        space = "" if self.joined else " "
        runs = [words[i : i + RUN] for i in range(0, len(words), RUN)]
        ids, sizes = self._ids([space.join(r) for r in runs])
        at = np.flatnonzero(self.marks[ids])
        per_run = np.add.reduceat(self.marks[ids].astype(np.int64), np.cumsum(sizes) - sizes) if len(ids) else np.zeros(0, np.int64)
        if len(at) != len(words) or (sizes == 0).any() or (per_run != [len(r) for r in runs]).any():
            return self._ids(words)
        edges = np.append(at, len(ids)) if self.joined else np.concatenate([[0], at + 1])
        return ids, np.diff(edges)

    def _cut(self, words: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """Each word without the punctuation behind it, where that can be encoded apart, so that each word is encoded once; those
        pieces of punctuation; and which words have one."""
        stem = pc.utf8_rtrim(words, TAIL)
        alone = pc.utf8_is_alpha(stem)
        if self.lowers:  # what a letter's small form adds, such as a dot above, would go with the punctuation
            alone = pc.and_not(pc.and_(alone, pc.utf8_is_alpha(pc.utf8_lower(stem))), pc.match_substring(stem, "\u0130"))
        tailed = pc.and_(alone, pc.less(pc.binary_length(stem), pc.binary_length(words)))
        tails = pc.struct_field(pc.extract_regex(words.filter(tailed), _TAILS), "tail")
        return pc.if_else(tailed, stem, words), tails, tailed.to_numpy(zero_copy_only=False)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (one more entry than texts). Null counts as empty."""
        raw = texts = pc.fill_null(texts, "").cast(pa.large_string())
        if self.lowers:  # the tokenizer would; so words are alike before they are looked up
            # Put together anew, as ascii_lower takes a slice for a whole array.
            texts = pc.ascii_lower(pa.concat_arrays([texts, texts.slice(0, 0)]))
        odd = pc.match_substring_regex(texts, _ODD)
        for special in self.specials:
            odd = pc.or_(odd, pc.match_substring(texts, special, ignore_case=True))
        odd = odd.to_numpy(zero_copy_only=False)
        split = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        first = split.offsets.to_numpy()[:-1] - split.offsets[0].as_py()
        words = split.flatten().dictionary_encode()
        codes, words = words.indices.to_numpy(), words.dictionary
        stems, tails, tailed = self._cut(words)
        stems, tails = stems.dictionary_encode(), tails.dictionary_encode()
        # Pieces: stems behind a space, stems that begin a text, tails. Where the space doesn't matter, there are none of the second.
        n, n_tails = len(stems.dictionary), len(tails.dictionary)
        piece = stems.indices.to_numpy().astype(np.int64)[codes]
        one, two = string_hashes(pa.concat_arrays([stems.dictionary, tails.dictionary]))
        begins = np.unique(piece[first]) if self.joined else np.zeros(0, np.int64)
        if self.joined:
            renamed = np.zeros(n, np.int64)
            renamed[begins] = n + np.arange(len(begins))
            piece[first] = renamed[piece[first]]
        later = _LATER if self.joined else np.uint64(1)
        one = np.concatenate([one[:n] * later, one[begins], one[n:]])
        two = np.concatenate([two[:n] * later, two[begins], two[n:]])
        at = self.known.find(one, two)
        new, old = np.flatnonzero(at < 0), at[at >= 0]
        self.known.use(old)
        start, length = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        start[at >= 0], length[at >= 0] = self.known.start[old], self.known.length[old]
        pools = [self.known.pool]
        held = len(pools[0])
        if len(new):
            behind, begin, tail = (new[(new >= a) & (new < b)] - a for a, b in ((0, n), (n, n + len(begins)), (n + len(begins), len(at))))
            own = stems.dictionary.take(pa.array(behind))
            letters = pc.utf8_is_alpha(own).to_numpy(zero_copy_only=False)
            if self.lowers:
                letters &= ~pc.match_substring(own, "\u0130").to_numpy(zero_copy_only=False)
            spaced = [" " + x for x in own.to_pylist()] if self.joined else own.to_pylist()
            asked = [spaced[i] for i in np.flatnonzero(~letters).tolist()]
            asked += stems.dictionary.take(pa.array(begins[begin])).to_pylist() + tails.dictionary.take(pa.array(tail)).to_pylist()
            words_ids, words_length = self._plain([spaced[i] for i in np.flatnonzero(letters).tolist()])
            ids, rest = self._ids(asked)
            ids, sizes = np.concatenate([words_ids, ids]), np.concatenate([words_length, rest])
            new = new[np.concatenate([np.flatnonzero(letters), np.flatnonzero(~letters), np.arange(len(letters), len(new))])]
            length[new] = sizes
            start[new] = held + np.cumsum(length[new]) - length[new]
            self.known.add(one[new], two[new], ids, length[new])
            pools.append(ids)
        # Each word's pieces in a row: the stem, and the tail where there is one.
        spot = np.full(len(words), -1)
        spot[tailed] = n + len(begins) + tails.indices.to_numpy()
        behind = spot[codes]
        pieces = 1 + (behind >= 0)
        place = np.cumsum(pieces) - pieces
        row = np.empty(int(pieces.sum()), np.int64)
        row[place] = piece
        row[place[behind >= 0] + 1] = behind[behind >= 0]
        if odd.any():  # such a text is one piece
            ids, sizes = self._ids(raw.filter(pa.array(odd)).to_pylist())
            row[place[first[odd]]] = len(at) + np.arange(len(sizes))
            start = np.concatenate([start, sum(map(len, pools)) + np.cumsum(sizes) - sizes])
            length = np.concatenate([length, sizes])
            pools.append(ids)
        pool = np.concatenate(pools)
        # A text holds fewer than 2**31 bytes and a slice not many more, so 32 bits number all ids.
        each = length.astype(np.int32)[row]
        ends = np.cumsum(each, dtype=np.int32)
        total = int(ends[-1]) if len(ends) else 0
        spots = np.repeat(start.astype(np.int32)[row] - (ends - each), each)
        spots += np.arange(total, dtype=np.int32)
        bounds = np.concatenate([np.zeros(1, np.int64), ends])[np.append(place[first], len(row))]
        return pool[spots], bounds


_encoders: dict[tuple[str | bytes, bool], Encoder] = {}


def encoder(source: str | bytes, plain_specials: bool = False) -> Encoder:
    """One encoder per worker process, of a tokenizer file's path or its bytes."""
    key = (source, plain_specials)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(source, plain_specials)
    return _encoders[key]


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids with end_id behind them."""
    at = bounds[1:]
    return np.insert(ids, at, end_id), bounds + np.arange(len(bounds))
