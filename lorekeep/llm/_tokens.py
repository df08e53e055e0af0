"""Token ids of texts, by the tokenizers library."""

from __future__ import annotations

import json
import os
import re
import string
from array import array
from functools import lru_cache
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from lorekeep.llm._shared import KEPT

# Fixed value: how the byte-level vocabulary's pre-tokenizer splits a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Most units of text that a worker remembers in each of two generations: when the newer is full it becomes the older, from which units that recur
#: come back. PARTS is for the parts that units consist of, likewise. About 130 bytes each, so some 200 MB in all, which other stages drop.
REMEMBERED, PARTS = 450_000, 300_000
#: A longer unit is not remembered.
LONGEST = 40
#: Different units of other kinds than letters that one call to the library encodes.
AT_ONCE = 1 << 10
#: Units whose ids are gathered at once.
GATHERED = 1 << 17
#: Different words of letters whose ids a worker remembers from one slice of text to the next, in Arrow arrays (some 40 bytes each).
KNOWN = 1 << 20
#: Characters that are split off the ends of words of letters, where any run of them is one pre-token.
MARKS = string.punctuation

_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: How the vocabulary writes bytes.
_LETTER = {b: chr(b) for b in _PRINTED} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in _PRINTED)}
_ID = attrgetter("id")
_UNSURE = re.compile(r"[\x1c-\x1f\x85]")
_GAP = re.compile(r"(?<=\S) (?=\S)")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Unclear(Exception):
    pass


class _Remembered(dict):
    """Ids, as bytes, of pieces of text; each is encoded when first asked for, and forgotten when two generations of others have come since it was last met."""

    def __init__(self, encode, most: int):
        self.encode, self.most, self.old = encode, most, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            found = self.encode(piece)
            if len(piece) > LONGEST:
                return found
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[piece] = found
        return found


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def _packed(raw: bytes | np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Bytes cut into binary values of these sizes."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int64)), pa.py_buffer(raw)])


def _parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large string or binary column, and the offsets between its values."""
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8), offsets - offsets[0]


def _gathered(units: pa.Array, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the units that are seen, one after the other, and the offsets between them."""
    data, at, total = [np.zeros(0, np.uint8)], [np.zeros(1, np.int64)], 0
    for lo in range(0, len(seen), GATHERED):
        raw, offsets = _parts(units.take(pa.array(seen[lo : lo + GATHERED])))
        data.append(raw)
        at.append(offsets[1:] + total)
        total += len(raw)
    return np.concatenate(data), np.concatenate(at)


class Encoder:
    """Ids of texts as the file's tokenizer has them without special tokens added.

    A space between two other characters always starts a new pre-token, so a text's ids are those of its pieces between such
    spaces, and pieces recur: each is looked up, and only new ones go to the library's model. Where that is not sure (the
    text has a special token's string, or white space on which libraries disagree), and for files of another kind than a byte-level
    BPE with the usual split, the library encodes the whole text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # only new words get there
        self.kind = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.kind == "H" else "<u4")
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = os.path.commonprefix(self.special)[:1]  # what all of them start with, maybe nothing
        self.find = regex.compile(PATTERN).findall
        self.after, self.parts = _Remembered(self._after, REMEMBERED), _Remembered(self._part, PARTS)
        self.known, self.known_ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.words_are_plain = not any(map(str.isalpha, self.special))
        made = json.loads(self.tokenizer.to_str())
        split, model = made.get("pre_tokenizer") or {}, made["model"]
        self.usual = (
            model.get("type") == "BPE" and not made.get("normalizer") and split.get("type") == "ByteLevel" and not split.get("add_prefix_space")
            and split.get("use_regex", True) and not model.get("ignore_merges") and not model.get("dropout") and not made.get("truncation") and not made.get("padding")
            and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or " " in x["content"] for x in made["added_tokens"])
        )
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # whether an id begins with a space
        self.opens[[k for x, k in vocabulary.items() if x.startswith(_LETTER[32])]] = True

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _part(self, part: str) -> bytes:
        written = part.replace(" ", "Ġ") if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(_LETTER)
        return array(self.kind, map(_ID, self.model.tokenize(written))).tobytes()

    def _piece(self, before: str, piece: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace() or _UNSURE.search(piece):
            raise _Unclear
        return self._unit(before + piece)

    def _after(self, piece: str) -> bytes:
        return self.parts[" " + piece] if self.words_are_plain and piece.isalpha() else self._piece(" ", piece)

    def _unit(self, unit: str) -> bytes:
        if self.mark in unit and any(x in unit for x in self.special):
            raise _Unclear
        word = unit[unit[0] == " " :]
        if word.isalpha():
            return self.parts[unit]
        if word[:-1].isalpha() and word[-1] in ".,;:!?":
            return self.parts[unit[:-1]] + self.parts[unit[-1]]
        return b"".join(map(self.parts.__getitem__, self.find(unit)))

    def ids(self, text: str) -> bytes:
        """Little-endian ids of dtype."""
        if not text:
            return b""
        if not self.usual:
            return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        pieces = text.split(" ")
        try:
            return self._piece("", pieces[0]) + b"".join(map(self.after.__getitem__, pieces[1:]))
        except _Unclear:
            return self._by_gaps(text)

    def _by_gaps(self, text: str) -> bytes:
        if not text:
            return b""
        if _UNSURE.search(text) or any(x in text for x in self.special):
            return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        first, *rest = _GAP.split(text)
        return self._unit(first) + b"".join(self._unit(" " + x) for x in rest)

    def _unclear(self, words: pa.Array) -> np.ndarray:
        """Which pieces are no units of their own."""
        size = pc.binary_length(words).to_numpy()
        out = (size == 0) | (pc.binary_length(pc.utf8_trim_whitespace(words)).to_numpy() < size)
        data = _parts(words)[0]
        if ((data - np.uint8(0x1C)) < 4).any() or (data == 0x85).any() or self.mark.encode() in data.tobytes():
            odd = np.zeros(len(words), bool)
            for x in ("\x1c", "\x1d", "\x1e", "\x1f", "\x85", *self.special):
                odd |= pc.match_substring(words, x).to_numpy(zero_copy_only=False)
            out |= odd
        return out

    def _joined(self, units: list[str]) -> tuple[bytes, np.ndarray]:
        """Ids of units that begin with a space, and how many bytes each has: an id that begins with a space is a unit's first."""
        ids = [np.zeros(0, self.dtype)]
        for lo in range(0, len(units), AT_ONCE):
            found = self.tokenizer.encode_batch_fast(["".join(units[lo : lo + AT_ONCE])], add_special_tokens=False)
            ids.append(np.array(found[0].ids, self.dtype))
        all_ids = np.concatenate(ids)
        first = np.flatnonzero(self.opens[all_ids])
        if len(first) != len(units):
            raise ValueError("the tokenizer's ids do not tell where words begin")
        return all_ids.tobytes(), np.diff(np.append(first, len(all_ids))) * self.dtype.itemsize

    def _letters(self, words: list[str]) -> tuple[bytes, np.ndarray]:
        """Like _joined, for words of letters only, with a space before them or not: each is one pre-token."""
        written = "\n".join(words).encode().decode("latin-1").translate(_LETTER).split(_LETTER[10]) if words else []
        ids, sizes = array(self.kind), array("q")
        for lo in range(0, len(written), 32):  # few objects at a time
            found = list(map(self.model.tokenize, written[lo : lo + 32]))
            ids.extend(map(_ID, chain.from_iterable(found)))
            sizes.extend(map(len, found))
        return ids.tobytes(), np.array(sizes, np.int64) * self.dtype.itemsize

    def _remembered(self, bases: pa.Array) -> np.ndarray:
        """Where each of different strings, with a space before it or not, stands in known, or -1 if it is no word of letters; new words are encoded."""
        at = pc.index_in(bases, self.known)
        new = bases.filter(pc.is_null(at))
        letters = np.fromiter((len(x) <= LONGEST and x.isalpha() for x in _strings(pc.utf8_ltrim(new, " "))), bool, len(new))
        new = new.filter(pa.array(letters))
        place = pc.fill_null(at, -1).to_numpy().astype(np.int64)
        old = np.flatnonzero(place >= 0)
        if len(self.known) + len(new) > KNOWN:  # those of before are forgotten
            kept = pa.array(place[old])
            self.known, self.known_ids = self.known.take(kept), self.known_ids.take(kept)
            place[old] = np.arange(len(old))
        place[np.flatnonzero(place < 0)[letters]] = len(self.known) + np.arange(len(new))
        self.known, self.known_ids = pa.concat_arrays([self.known, new]), pa.concat_arrays([self.known_ids, _packed(*self._letters(_strings(new)))])
        return place

    def _units(self, units: pa.Array) -> pa.Array:
        """Ids, as bytes, of different clear pieces, with a space before them or not.

        Where lines of one word meet, as in "one.\nTwo", the line's end is a pre-token and each line is a word of its own.
        """
        lines = pc.split_pattern(units, "\n")
        begin = np.append(0, np.cumsum(lines.value_lengths().to_numpy(), dtype=np.int64))
        lines = lines.flatten()
        bases = pc.utf8_rtrim(lines, MARKS)
        coded = bases.dictionary_encode()
        place = self._remembered(coded.dictionary)[coded.indices.to_numpy()]
        other = np.logical_or.reduceat(place < 0, begin[:-1]) if len(units) else np.zeros(0, bool)
        # the marks behind a word, cut from the column's bytes
        data, offsets = _parts(lines)
        size = np.diff(offsets) - pc.binary_length(bases).to_numpy()
        marked = np.flatnonzero(size)
        size = size[marked]
        marks = _packed(data[np.repeat(offsets[marked + 1] - np.cumsum(size), size) + np.arange(size.sum())], size).dictionary_encode()
        # units of other kinds
        spaced = pc.starts_with(units, " ").to_numpy(zero_copy_only=False)
        joined = _packed(*self._joined(_strings(units.filter(pa.array(other & spaced)))))
        alone = [self._pack(x.ids) for x in self.tokenizer.encode_batch_fast(_strings(units.filter(pa.array(other & ~spaced))), add_special_tokens=False)]
        tails = [self._part(x.decode()) for x in marks.dictionary.to_pylist()]
        known = len(self.known_ids)
        table = pa.concat_arrays([self.known_ids, joined, pa.array([*alone, *tails, self._part("\n"), b""], pa.large_binary())])
        line_end, nothing = len(table) - 2, len(table) - 1
        seen = np.full((len(lines), 3), nothing)
        seen[:, 0] = line_end
        seen[begin[:-1], 0] = nothing
        seen[:, 1] = place
        seen[marked, 2] = known + len(joined) + len(alone) + marks.indices.to_numpy()
        seen[np.repeat(other, np.diff(begin))] = nothing
        seen[begin[:-1][other & spaced], 1] = known + np.arange(len(joined))
        seen[begin[:-1][other & ~spaced], 1] = known + len(joined) + np.arange(len(alone))
        raw, at = _gathered(table, seen.ravel())
        return _packed(raw, np.diff(at[3 * begin]))

    def streams(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end_id after each, and the offsets between texts. Each different piece of the texts is encoded once; only words of letters are remembered."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        split = pc.split_pattern(texts, " ")
        offsets = np.append(0, np.cumsum(split.value_lengths().to_numpy(), dtype=np.int64))
        pieces = split.flatten().dictionary_encode()
        words, codes = pieces.dictionary, pieces.indices.to_numpy()
        begin = offsets[:-1]
        unclear = self._unclear(words) if self.usual else np.ones(len(words), bool)
        other = np.logical_or.reduceat(unclear[codes], begin) if len(texts) else np.zeros(0, bool)
        # what stands in the streams: clear words, first words, whole texts, the end and nothing
        clear = np.flatnonzero(~unclear)
        firsts, first = np.unique(codes[begin[~other]], return_inverse=True)
        spaced = pc.binary_join_element_wise(*(pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in ("", words.take(pa.array(clear)), " ")))
        units = self._units(pa.concat_arrays([spaced, words.take(pa.array(firsts))]))
        whole = [(self._by_gaps if self.usual else self.ids)(x) for x in texts.filter(pa.array(other)).to_pylist()]
        table = pa.concat_arrays([units, pa.array([*whole, self._pack([end_id]), b""], pa.large_binary())])
        end, nothing = len(table) - 2, len(table) - 1
        place = np.full(len(words), nothing, np.int32)
        place[clear] = np.arange(len(clear))
        ends = offsets[1:] + np.arange(len(texts))
        inside = np.ones(len(codes) + len(texts), bool)
        inside[ends] = False
        inner = place[codes]
        if whole:
            inner[np.repeat(other, np.diff(offsets))] = nothing
        inner[begin[~other]] = len(clear) + first
        inner[begin[other]] = len(units) + np.arange(len(whole))
        seen = np.full(len(inside), end, np.int32)
        seen[inside] = inner
        raw, at = _gathered(table, seen)
        return raw.view(self.dtype), np.append(0, at[ends + 1]) // self.dtype.itemsize


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    return Encoder(path)


KEPT["encoder"] = encoder.cache_clear
