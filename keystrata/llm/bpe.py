"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A leaf is a symbol's pair with its right neighbour; its value is ``rank * width + position``,
so the minimum at the root is the leftmost pair of lowest rank.  A merge changes three leaves
(the merged symbol, its left neighbour, the symbol that goes), each put right in log2(width)
steps, until the root holds no mergeable pair.  Words of up to 64 bytes are encoded many at a
time, one tree per row of a numpy matrix; longer ones one by one with a scalar tree, so that a
word of n bytes costs O(n log n).

Text handling is that of the ``tokenizers`` library for a vocabulary file with NFC, white-space
and lower-case normalisation, a splitting pattern, byte-level symbols and word ends.  White
space never lies inside a pre-token, so a lower-cased text is encoded chunk by chunk between
ASCII white space (the splitting pattern removes any other).  Arrow cuts the texts of a step,
numbers their distinct chunks and puts the ids of each in place; chunks already met are looked
up in a bounded memo (``memo`` entries in each of two generations; it changes the speed only).

Null texts count as empty; an empty or all-white text has no ids and decodes to "".
"""

from __future__ import annotations

import codecs
import gc
import json
import os
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

_NONE = np.int32(2**31 - 1)
_WIDEST = 64


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """A vocabulary file of the tokenizers library: byte-level BPE with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.model = spec["model"]
        self.ids = dict(self.model["vocab"])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = [""] * (max([*self.ids.values(), *self.special.values()]) + 1)
        for token, i in [*self.ids.items(), *self.special.items()]:
            self.tokens[i] = token
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self._words = regex.compile(pattern).findall
        self._split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None

    @cached_property
    def _stops(self) -> dict[str, bytes]:
        """Ids of the stops that the pattern parts from a word before them."""
        own = [c for c in ".,;:!?" if self._words("a" + c) == ["a", c]]
        return dict(zip(own, self.encode_words(own), strict=True))

    def parts(self, text: str) -> list[str | int]:
        """A text in lower case, cut where special tokens stand, which come as their ids."""
        if not any(x in text for x in self.special):
            return [_lower(text)]
        return [self.special[x] if k % 2 else _lower(x) for k, x in enumerate(self._split(text))]

    def encode_chunks(self, raw: list[bytes], known: Callable[[bytes], bytes | None] = lambda chunk: None) -> list[bytes]:
        """Ids of each lower-case string in UTF-8, as little-endian unsigned 32-bit integers; ``known``: those of a string met before."""
        out: list[bytes] = [b""] * len(raw)
        words: list[str] = []
        place: dict[str, int] = {}
        whole: list[tuple[int, int, bytes]] = []  # chunks that are one word each, or one and a stop
        rest: list[tuple[int, list[int]]] = []
        stops = self._stops

        def of(word: str) -> int:
            at = place.setdefault(word, len(words))
            if at == len(words):
                words.append(word)
            return at

        for k, chunk in enumerate(raw):
            low = chunk.decode("utf-8", "surrogatepass")
            if low.isalpha():
                whole.append((k, of(low), b""))
            elif low[-1:] in stops and low[:-1].isalpha():
                met = known(chunk[:-1])
                if met:
                    out[k] = met + stops[low[-1]]
                else:
                    whole.append((k, of(low[:-1]), stops[low[-1]]))
            else:
                rest.append((k, [*map(of, self._words(low))]))
        made = self.encode_words(words)
        for k, at, tail in whole:
            out[k] = made[at] + tail
        for k, own in rest:
            out[k] = b"".join([made[at] for at in own])
        return out

    def encode_words(self, words: list[str]) -> list[bytes]:
        raise NotImplementedError

    def decode(self, ids: bytes) -> str:
        """The file names no decoder: the tokens, joined by one space."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _lower(text: str) -> str:
    """NFC, then lower case of one character at a time: no final sigma."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return "".join(c.lower() for c in text) if "\u03a3" in text else text.lower()


class SegmentTreeBpe(Vocabulary):
    """Merges by segment tree."""

    def __init__(self, path: str):
        super().__init__(path)
        vocab, end = self.ids, self.model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self._inner = np.array([vocab[c] for c in symbols], np.int32)
        self._last = np.array([vocab[c + end] for c in symbols], np.int32)
        self._rank_of: dict[int, int] = {}
        made = []
        for rank, pair in enumerate(self.model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self._rank_of.setdefault(vocab[a] << 32 | vocab[b], rank)
            made.append(vocab[a + b])
        self._made = np.array(made, np.int32)
        self._pair_ranks = _PairRanks(self._rank_of)
        #: Ranks of the pairs that a word starts with: a byte before an inner byte, or before a last one.
        both = np.concatenate([self._inner, self._last]).astype(np.int64)
        self._first = self._pair_ranks(np.repeat(self._inner.astype(np.int64), 512), np.tile(both, 256)).reshape(256, 512)

    # -- merging ---------------------------------------------------------------------------

    def _leaf(self, left: np.ndarray, right: np.ndarray, pos: np.ndarray, width: int) -> np.ndarray:
        rank = self._pair_ranks(left.astype(np.int64), right.astype(np.int64))
        return np.where(rank >= 0, rank * width + pos, _NONE).astype(np.int32)

    def _merge_rows(self, words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """words: of 2 to ``width`` bytes each.  The ids of all, one word after the other, and how many each has."""
        n, lengths = len(words), np.fromiter(map(len, words), np.int64, len(words))
        column = np.arange(width)
        flat = np.frombuffer(b"".join(words), np.uint8)
        inside = column < lengths[:, None]
        raw = np.zeros((n, width), np.int64)
        raw[inside] = flat
        final = column == (lengths - 1)[:, None]
        sym = np.full((n, width + 1), -1, np.int32)  # the last column: no neighbour
        sym[:, :width] = np.where(final, self._last[raw], np.where(inside, self._inner[raw], -1))
        pair = column < (lengths - 1)[:, None]
        right = np.full((n, width + 1), width, np.int16)
        right[:, :width] = np.where(pair, column + 1, width)
        left = np.full((n, width + 1), width, np.int16)
        left[:, 1:width] = column[:-1]
        after = np.zeros((n, width), np.int64)
        after[:, :-1] = raw[:, 1:] + 256 * final[:, 1:]
        rank = np.where(pair, self._first[raw, after], -1)
        tree = np.full((n, 2 * width), _NONE, np.int32)
        tree[:, width:] = np.where(rank >= 0, rank * width + column, _NONE)
        half = width
        while half > 1:  # parents of [half, 2 half)
            np.minimum(tree[:, half : 2 * half : 2], tree[:, half + 1 : 2 * half : 2], out=tree[:, half // 2 : half])
            half //= 2
        flat_tree, flat_sym, flat_right, flat_left = tree.reshape(-1), sym.reshape(-1), right.reshape(-1), left.reshape(-1)
        rows = np.flatnonzero(tree[:, 1] < _NONE)
        while len(rows):
            at, in_tree = rows * (width + 1), rows * (2 * width)
            rank, pos = np.divmod(flat_tree[in_tree + 1], width)
            gone = flat_right[at + pos].astype(np.int64)
            behind, before = flat_right[at + gone].astype(np.int64), flat_left[at + pos].astype(np.int64)
            new = self._made[rank]
            flat_sym[at + pos] = new
            flat_sym[at + gone] = -1
            flat_right[at + pos] = behind
            flat_left[at + behind] = pos  # column ``width`` takes what has no place
            flat_tree[in_tree + width + gone] = _NONE
            flat_tree[in_tree + width + pos] = self._leaf(new, flat_sym[at + behind], pos, width)
            has = np.flatnonzero(before < width)
            held = before[has]
            flat_tree[in_tree[has] + width + held] = self._leaf(flat_sym[at[has] + held], new[has], held, width)
            for base, leaf in ((in_tree, gone), (in_tree, pos), (in_tree[has], held)):
                node = (leaf + width) >> 1
                for _ in range(width.bit_length() - 1):
                    two = base + 2 * node
                    flat_tree[base + node] = np.minimum(flat_tree[two], flat_tree[two + 1])
                    node = node >> 1
            rows = rows[tree[rows, 1] < _NONE]
        kept = sym[:, :width] >= 0
        return sym[:, :width][kept], kept.sum(1)

    def _merge_long(self, word: bytes) -> bytes:
        n = len(word)
        width = 1 << (n - 1).bit_length()
        sym = self._inner[np.frombuffer(word, np.uint8)].tolist()
        sym[-1] = int(self._last[word[-1]])
        right, left = [*range(1, n + 1)], [*range(-1, n - 1)]
        none, rank_of, made = 1 << 62, self._rank_of, self._made
        tree = [none] * (2 * width)

        def leaf(i: int) -> int:
            j = right[i]
            rank = rank_of.get(sym[i] << 32 | sym[j]) if j < n else None
            return none if rank is None else rank * width + i

        def update(i: int, value: int) -> None:
            node = width + i
            tree[node] = value
            while node > 1:
                node >>= 1
                low = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == low:
                    break
                tree[node] = low

        for i in range(n):
            tree[width + i] = leaf(i)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] < none:
            rank, i = divmod(tree[1], width)
            j = right[i]
            sym[i], sym[j] = int(made[rank]), -1
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            update(j, none)
            update(i, leaf(i))
            if left[i] >= 0:
                update(left[i], leaf(left[i]))
        return np.array([s for s in sym if s >= 0], "<u4").tobytes()

    def encode_words(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        groups: dict[int, list[int]] = {}
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        for k, w in enumerate(raw):
            n = len(w)
            if n == 1:
                out[k] = int(self._last[w[0]]).to_bytes(4, "little")
            elif n > _WIDEST:
                out[k] = self._merge_long(w)
            else:
                groups.setdefault(1 << (n - 1).bit_length(), []).append(k)
        for width, ks in groups.items():
            for at in range(0, len(ks), 8192):
                part = ks[at : at + 8192]
                ids, counts = self._merge_rows([raw[k] for k in part], width)
                joined, ends = ids.astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
                start = 0
                for k, end in zip(part, ends, strict=True):
                    out[k] = joined[start:end]
                    start = end
        return out


class _PairRanks:
    """Rank of a pair of ids, or -1, for many pairs: two hash tables, the second for what meets in the first."""

    def __init__(self, rank_of: dict[int, int]):
        keys = np.fromiter(rank_of.keys(), np.int64, len(rank_of))
        ranks = np.fromiter(rank_of.values(), np.int32, len(rank_of))
        self._key = np.full(int(ranks.max(initial=0)) + 1, -1, np.int64)
        self._key[ranks] = keys
        self._tables = []
        bits = max(8, (4 * len(keys) - 1).bit_length())
        for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93):
            slot = self._slot(keys, odd, bits)
            table = np.zeros(1 << bits, np.int32)
            table[slot] = ranks
            self._tables.append((odd, bits, table))
            lost = table[slot] != ranks
            keys, ranks = keys[lost], ranks[lost]
            if not len(keys):
                break
        self._rest = {int(k): int(r) for k, r in zip(keys, ranks, strict=True)}

    @staticmethod
    def _slot(keys: np.ndarray, odd: int, bits: int) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(odd)) >> np.uint64(64 - bits)).view(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """left, right: ids as int64; a negative right: no neighbour."""
        key = left << 32 | right
        out = np.full(len(key), -1, np.int32)
        todo = np.flatnonzero(right >= 0)
        for odd, bits, table in self._tables:
            rank = table[self._slot(key[todo], odd, bits)]
            ok = self._key[rank] == key[todo]
            out[todo[ok]] = rank[ok]
            todo = todo[~ok]
        for i in todo if self._rest else ():
            out[i] = self._rest.get(int(key[i]), -1)
        return out


class LibraryBpe(Vocabulary):
    """Merges by the BPE model of the ``tokenizers`` library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__(path)
        self._library = Tokenizer(Tokenizer.from_file(path).model)
        self._library.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        symbols = byte_symbols()
        symbols[10] = "\n"  # which parts the words and is in none
        self._symbols = "".join(symbols)
        self._final = self._finals()

    def _finals(self) -> np.ndarray | None:
        """Which ids end a word; None if some do so in one word and not in another."""
        vocab, end = self.ids, self.model["end_of_word_suffix"] or ""
        inner, last = ({vocab[c + x] for c in byte_symbols()} for x in ("", end))
        pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in self.model["merges"]]
        merges, before = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], -1
        while before != len(inner) + len(last):
            before = len(inner) + len(last)
            for a, b, both in merges:
                if a in inner and b in inner:
                    inner.add(both)
                if a in inner and b in last:
                    last.add(both)
        if inner & last:
            return None
        final = np.zeros(len(self.tokens), bool)
        final[list(last)] = True
        return final

    def encode_words(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        encode = self._library.encode_batch if self._final is None else self._library.encode_batch_fast  # which tells no words
        for at in range(0, len(words), 256):
            part = words[at : at + 256]
            line = codecs.charmap_decode("\n".join(part).encode("utf-8", "surrogatepass"), "strict", self._symbols)[0]
            made = encode([line], add_special_tokens=False)[0]
            ids, start = np.array(made.ids, "<u4"), 0
            if self._final is None:
                ends = np.cumsum(np.bincount(made.word_ids))
            else:
                ends = np.flatnonzero(self._final[ids]) + 1
            flat = ids.tobytes()
            for _, end in zip(part, (4 * ends).tolist(), strict=True):
                out.append(flat[start:end])
                start = end
        return out


class Encoder:
    """Whole texts by way of chunks, with a memo of two generations of some more than ``memo`` chunks each."""

    def __init__(self, backend, memo: int = 200_000, step_chars: int = 1_000_000):
        self._backend, self._memo, self._step = backend, memo, step_chars
        self._young: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}

    def _learn(self, keys: list[bytes]) -> list[bytes]:
        """Ids of distinct chunks, which all are in the young generation then, but for long ones."""
        young, old = self._young, self._old
        found = list(map(young.get, keys))
        new = []
        for k in [k for k, ids in enumerate(found) if ids is None]:
            ids = old.get(keys[k])
            if ids is None:
                new.append(k)
            else:
                young[keys[k]] = found[k] = ids
        missing = [keys[k] for k in new]
        for k, key, ids in zip(new, missing, self._backend.encode_chunks(missing, lambda key: young.get(key) or old.get(key)), strict=True):
            found[k] = ids
            if len(key) <= 64:
                young[key] = ids
        if len(young) > self._memo:
            self._old, self._young = young, {}
        return found

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text in turn, as little-endian unsigned 32-bit integers."""
        held, size = [], 0
        for text in texts:
            held.append(self._backend.parts(text or ""))
            size += len(text or "")
            if size >= self._step:
                yield from self._flush(held)
                held, size = [], 0
        yield from self._flush(held)

    def _flush(self, held: list[list[str | int]]) -> Iterator[bytes]:
        collecting = gc.isenabled()
        gc.disable()  # nothing here makes a cycle, and looking for some in the memo takes a fifth of the time
        try:
            made = self._rows([x.encode("utf-8", "surrogatepass") for own in held for x in own if isinstance(x, str)])
        finally:
            if collecting:
                gc.enable()
        for own in held:
            yield next(made) if len(own) == 1 else b"".join([next(made) if isinstance(x, str) else x.to_bytes(4, "little") for x in own])

    def _rows(self, rows: list[bytes]) -> Iterator[bytes]:
        ends = np.cumsum([0, *map(len, rows)], dtype=np.int64)
        lines = pa.LargeStringArray.from_buffers(len(rows), pa.py_buffer(ends), pa.py_buffer(b"".join(rows)))
        cut = pc.ascii_split_whitespace(lines)
        coded = cut.values.view(pa.large_binary()).dictionary_encode()
        ids = pa.array(self._learn(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
        if not len(ids):
            return iter([b""] * len(rows))
        _, places, data = ids.buffers()
        at = np.frombuffer(places, np.int64)[cut.offsets.to_numpy()].tolist()
        flat = memoryview(data) if data is not None else memoryview(b"")
        return (bytes(flat[a:b]) for a, b in zip(at, at[1:]))

    def decode(self, ids: bytes) -> str:
        return self._backend.decode(ids)


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, library: bool = False) -> Encoder:
    """One per Python worker and vocabulary file."""
    key = (path, library)
    if key not in _ENCODERS:
        backend = LibraryBpe(path) if library else SegmentTreeBpe(path)
        backend.model = {}  # the file's merges and ids are in the backend's own tables now
        _ENCODERS[key] = Encoder(backend)
    return _ENCODERS[key]
