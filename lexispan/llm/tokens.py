"""Byte-pair encoding of whole Arrow batches by a public tokenizer.

A pre-token of the supported byte-pair vocabularies never runs from a character
that is not white space into white space, nor from a letter of A to Z into ASCII
punctuation other than an apostrophe, so a text can be cut there and its pieces
encoded by themselves. Natural text repeats its pieces, so each distinct piece of
a batch is encoded once, many pieces to a call of the library, and the ids are
gathered with numpy.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_UPPER, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = _LETTER[65:91] = _LETTER[97:123] = True
#: Punctuation that no pre-token joins to a letter before it.
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in '!"),.:;?']] = True
#: The same where marks are at ends of words; but for what a special token holds.
_WIDE_STOP = _STOP.copy()
_WIDE_STOP[[ord(c) for c in "#$%&*"]] = True
#: Last bytes of the letters U+00C0 to U+00FF, all after the byte C3, and of the small ones.
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
_SMALL = _LATIN & (np.arange(256) >= 0x9F)


#: Bytes of small letters for which byte-level vocabularies have another character than the byte's own.
_STANDS = [("\x9f", "\u0141"), ("\xa0", "\u0142"), ("\xad", "\u0143")]
#: Last two bytes of the white space characters above U+007F.
_WIDE_SPACE = np.zeros(1 << 16, bool)
_WIDE_SPACE[
    [int.from_bytes(chr(c).encode()[-2:], "big") for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
] = True


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts or byte strings (null: empty) and the n + 1 places where they begin and end."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    raw = pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type)
    texts = texts.cast(pa.large_binary() if raw else pa.large_string())
    if texts.null_count:
        texts = texts.fill_null(b"" if raw else "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def cuts(data: np.ndarray, offsets: np.ndarray, stop: np.ndarray = _STOP, latin: bool = False) -> np.ndarray:
    """Places where a piece begins: each text's start, each white space after a character that is none, and each ``stop`` after a letter of A to Z, with ``latin`` also after one of U+00C0 to U+00FF."""
    cut = np.zeros(len(data), bool)
    if len(data):
        space = _SPACE[data]
        cut[1:] = space[1:] & ~space[:-1]
        if len(data) > 2:
            at = np.flatnonzero(cut)
            at = at[(at >= 2) & (data[at - 1] >= 128)]
            pair = data[at - 2].astype(np.int32) << 8 | data[at - 1]
            cut[at[_WIDE_SPACE[pair]]] = False
        at = np.flatnonzero(stop[data[1:]]) + 1
        letter = _LETTER[data[at - 1]]
        if latin:
            letter |= _LATIN[data[at - 1]] & (data[at - 2] == 0xC3) & (at >= 2)
        cut[at[letter]] = True
        starts = offsets[:-1]
        cut[starts[starts < len(data)]] = True
    return np.flatnonzero(cut)


class _Known:
    """Pieces and their ids as three flat arrays."""

    def __init__(self):
        self.pieces, self.ids, self.ends = pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def add(self, pieces: pa.Array, ids: np.ndarray, n: np.ndarray) -> None:
        self.pieces = pa.concat_arrays([self.pieces, pieces])
        self.ids = np.concatenate((self.ids, ids))
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(n)))


class BatchEncoder:
    """Encodes string arrays; keeps the ids of up to ``keep`` pieces between calls.

    A vocabulary marks either the ends of words, and then white space only divides,
    or the space before a word. With marks at ends, pieces go to the library with
    a control character between them, whose id tells them apart; words of A to Z
    and small letters up to U+00FF, whose pre-tokens are known, go without and past
    the patterns. With marks
    before, pieces of one space and what follows are put one after another, and
    the ids that begin with a space tell them apart. The other pieces are encoded
    each by itself.

    Every text gets the ids that the library gives it, whatever texts stand beside it. The strings of
    special tokens in a text give their ids too, as the library has it; with ``ordinary``
    they are text like any other.
    """

    def __init__(self, path: str, keep: int = 600_000, together: int = 1000, ordinary: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = ordinary
        special = [re.escape(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(special)) if special and not ordinary else None
        self.stop = _WIDE_STOP.copy()
        self.stop[np.frombuffer(b"".join(t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()), np.uint8)] = False
        self.keep, self.together = keep, together
        self.known = _Known()
        vocabulary = self.tokenizer.get_vocab()
        self.suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.marks = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.marks[i] = token.endswith(self.suffix) if self.suffix else token.startswith("\u0120")
        own = self.tokenizer.encode("\x01", add_special_tokens=False).ids
        self.between = own[0] if len(own) == 1 else None
        # the same model for words of A to Z, in the characters that stand for their bytes
        self.words = Tokenizer(self.tokenizer.model)
        self.words.normalizer = normalizers.Sequence([])
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.words.encode_special_tokens = True

    def _each(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, one after another, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces.to_pylist(), add_special_tokens=False)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.uint32, int(n.sum())), n

    def _joined(self, pieces: pa.Array, plain: bool) -> tuple[np.ndarray, np.ndarray]:
        data, _ = flat(pieces)
        if plain:
            if self.suffix:
                line = data.tobytes().decode("latin-1")
                for byte, sign in _STANDS:
                    line = line.replace(byte, sign)
            else:
                line = data.tobytes().decode().replace(" ", " \u0120")
        else:
            line = " \x01 ".join(pieces.to_pylist()) if self.suffix else data.tobytes().decode()
        ids = np.array((self.words if plain else self.tokenizer).encode_batch_fast([line], add_special_tokens=False)[0].ids, np.uint32)
        if plain and self.suffix:
            n = np.diff(np.flatnonzero(self.marks[ids]), prepend=-1)
        elif self.suffix:
            at = np.flatnonzero(ids == self.between)
            n = np.diff(at, prepend=-1, append=len(ids)) - 1
            ids = np.delete(ids, at)
        else:
            n = np.diff(np.flatnonzero(self.marks[ids]), append=len(ids))
        return (ids, n) if len(n) == len(pieces) and n.sum() == len(ids) else self._each(pieces)

    def _learn(self, pieces: pa.Array) -> np.ndarray:
        """Encode pieces that are not known; their places among the known."""
        place, base = np.zeros(len(pieces), np.int64), len(self.known.pieces)
        data, ends = flat(pieces)
        starts, size = ends[:-1], np.diff(ends)
        letter = _LETTER[data]
        if self.suffix:
            letter &= ~_UPPER[data]
            at = np.flatnonzero(data[:-1] == 0xC3)
            at = at[_SMALL[data[at + 1]]]
            letter[at] = letter[at + 1] = True
        total = np.concatenate(([0], np.cumsum(letter, dtype=np.int64)))
        spaced = data[starts] == 32
        plain = spaced & (size > 1) & (total[ends[1:]] - total[starts] == size - 1)
        if self.suffix:
            many = np.full(len(pieces), self.between is not None and not (data == 1).any())
        else:
            many = spaced & (size > 1) & ~_SPACE[data[np.minimum(starts + 1, len(data) - 1)]]
        for own, how in ((np.flatnonzero(plain), True), (np.flatnonzero(many & ~plain), False), (np.flatnonzero(~many & ~plain), None)):
            if not len(own):
                continue
            place[own] = base + np.arange(len(own))
            base += len(own)
            own, out = pieces.take(pa.array(own)), []
            for at in range(0, len(own), self.together):
                part = own.slice(at, self.together)
                out.append(self._each(part) if how is None else self._joined(part, how))
            self.known.add(own, *(np.concatenate(x) for x in zip(*out, strict=True)))
        return place

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Of each distinct piece where it stands among the known ones."""
        at = pc.index_in(pieces, value_set=self.known.pieces)
        unknown = np.asarray(at.is_null())
        new = int(unknown.sum())
        if len(self.known.pieces) + new > self.keep:
            self.known = _Known()  # those of this batch come again soonest
            return self._learn(pieces)
        place = at.fill_null(0).to_numpy().astype(np.int64)
        if new:
            place[unknown] = self._learn(pieces.filter(at.is_null()))
        return place

    def _lowered(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The texts without capitals of A to Z and U+00C0 to U+00DE, as their case is lost, and with spaces for ASCII white space; but a letter under a mark is the library's matter, and so is what only looks like a special token."""
        upper = _UPPER[data]
        at = np.flatnonzero(data[:-1] == 0xC3) + 1
        upper[at[_LATIN[data[at]] & (data[at] < 0x9F)]] = True
        alone = np.append((data[1:] < 128) | (data[1:] == 0xC3), True)  # C3 begins no mark
        alone[offsets[1:][offsets[1:] > 0] - 1] = True  # what comes next is another text
        upper &= alone
        low = data + (upper.view(np.uint8) << 5)
        low[_SPACE[data]] = 32
        if self.special:
            for m in self.special.finditer(low.tobytes()):
                low[m.start() : m.end()] = data[m.start() : m.end()]
        return low

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the n + 1 places where each text's ids begin and end."""
        data, offsets = flat(texts)
        if self.suffix and len(data):
            data = self._lowered(data, offsets)
        starts = cuts(data, offsets, self.stop, True) if self.suffix else cuts(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        ends = np.append(starts, len(data)).astype(np.int64)
        coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        place = self._places(coded.dictionary)[coded.indices.to_numpy()]
        first = self.known.ends[place]
        many = self.known.ends[place + 1] - first
        upto = np.concatenate(([0], np.cumsum(many)))
        at = np.repeat((first - upto[:-1]).astype(np.int32), many)
        at += np.arange(upto[-1], dtype=np.int32)
        return self.known.ids[at], upto[np.searchsorted(starts, offsets)]


_ENCODERS: dict[tuple, BatchEncoder] = {}


def encoder(path: str) -> BatchEncoder:
    """This process's encoder for a vocabulary file; a worker keeps it from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = BatchEncoder(path)
    return _ENCODERS[path]


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """The batch in parts of about ``most`` bytes of text, a single longer text by itself: bounds what is held at once."""
    sizes = np.diff(flat(batch.column(column))[1])
    group = (np.cumsum(sizes) - sizes) // most
    at = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(sizes)])) if len(sizes) else [0]
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield batch.slice(a, b - a)
