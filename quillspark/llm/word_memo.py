"""Token ids of whole texts, one vocabulary lookup for each distinct word of a batch.

Both public vocabularies split a text into pieces before any merge applies, so the ids of
a text are those of its units in a row, where a unit is one piece or several.  The units of a batch are
cut and dictionary-encoded as arrays; only units not seen before reach the tokenizer's merge model.
"""

from __future__ import annotations

import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

# The pre-tokenizer patterns of the two vocabularies and the printable byte ranges.
WORD_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SPACED_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
PRINTABLE = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]

BLANK = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]"
UNEVEN = rf"^ | $|{BLANK} | {BLANK}"
SINGLE = re.compile(r"(?<=\S) (?=\S)")
PLAIN = re.compile(r"[ -~\nÀ-ɏ]*\Z")
# Kinds of bytes for ``piece_units``; the quote is a mark after which letters may be a contraction.
OTHER, LETTER, DIGIT, MARK, QUOTE, BLANK_BYTE, LINE_END = range(7)
SOLID = (LETTER, DIGIT, MARK, QUOTE)
KINDS = np.array([LETTER if chr(b).isascii() and chr(b).isalpha() or 0xC3 <= b <= 0xC8 else DIGIT if 48 <= b < 58 else QUOTE if b == 39 else BLANK_BYTE if b == 32 else LINE_END if b == 10 else MARK if 32 < b < 127 else OTHER for b in range(256)], np.uint8)
IS_SOLID = np.isin(np.arange(7), SOLID)
CUT, IF_SOLID_NEXT, IF_SOLID_BEFORE = 1, 2, 3
SLICE_BYTES, MEMO_BYTES, SPACED_BYTES, ENTRY_BYTES = 4 << 20, 96 << 20, 144 << 20, 200


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    table, extra = [""] * 256, 0
    for b in PRINTABLE:
        table[b] = chr(b)
    for b in range(256):
        if not table[b]:
            table[b] = chr(256 + extra)
            extra += 1
    return table


def cut_rules() -> np.ndarray:
    """What holds between two bytes, by 8 times the kind of the first and the kind of the second."""
    rules = np.zeros(64, np.uint8)
    for a in SOLID:
        for b in SOLID:
            marks = a in (MARK, QUOTE) and b in (MARK, QUOTE)
            rules[8 * a + b] = 0 if a == b or marks or (a, b) == (QUOTE, LETTER) else CUT
        rules[[8 * a + BLANK_BYTE, 8 * a + LINE_END]] = CUT
        rules[8 * LINE_END + a] = IF_SOLID_BEFORE
    rules[[8 * BLANK_BYTE + BLANK_BYTE, 8 * LINE_END + BLANK_BYTE]] = IF_SOLID_NEXT
    return rules


RULES = cut_rules()
LETTERS = dict(enumerate(byte_letters()))
STOPS = frozenset(".,;:?")


def as_letters(piece: str) -> str:
    """The piece with each of its bytes as the vocabulary's letter for it."""
    if piece.isascii() and piece.isalnum():
        return piece
    return piece.encode().decode("latin-1").translate(LETTERS)


def lowered(text: str) -> str:
    """Lower case one code point at a time: no context rule for a final sigma."""
    return text.lower() if "Σ" not in text else "".join([c.lower() for c in text])


def word_units(text: str) -> list[str]:
    """Normalised pieces of a unit for a vocabulary that drops white space."""
    return WORD_PIECES.findall(lowered(unicodedata.normalize("NFC", text)))


def slices(texts: pa.Array):
    """Consecutive parts of an array of about SLICE_BYTES, one text at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > SLICE_BYTES:
            yield texts.slice(at, i - at)
            at, total = i, 0
        total += int(n)
    if at < len(texts):
        yield texts.slice(at)


class BoundedMemo(dict):
    """A map that holds at most twice ``limit`` bytes (``ENTRY_BYTES`` an entry, the key and ``size``).

    At ``limit`` the map becomes the older generation and a new one begins, so keys in use survive.
    What alone takes over a hundredth of ``limit`` is not held.
    """

    def __init__(self, limit: int = MEMO_BYTES):
        super().__init__()
        self.limit, self.held, self.older = limit, 0, {}

    def hold(self, key: str, value, size: int):
        size += ENTRY_BYTES + len(key)
        if size * 100 > self.limit:
            return value
        if self.held + size > self.limit:
            self.older, self.held = dict(self), 0
            self.clear()
        self[key] = value
        self.held += size
        return value


class UnitIds(BoundedMemo):
    """unit -> ids as little-endian uint32 bytes."""

    def __init__(self, path: str, spaced: bool, limit: int = MEMO_BYTES):
        from tokenizers import Tokenizer

        super().__init__(limit)
        self.tokenizer, self.spaced = Tokenizer.from_file(path), spaced
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenize = self.tokenizer.model.tokenize

    def library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def merged(self, piece: str) -> bytes:
        """Ids of a piece between whose parts merges apply."""
        return array("I", [t.id for t in self.tokenize(as_letters(piece))]).tobytes()

    def pieces(self, unit: str) -> list[str]:
        """The unit's parts between which no merge applies."""
        return SPACED_PIECES.findall(unit) if self.spaced else word_units(unit)

    def computed(self, unit: str) -> bytes:
        if self.spaced and unit.isascii():
            if unit[0] == " " and unit[1:].isalpha():
                return array("I", [t.id for t in self.tokenize(LETTERS[32] + unit[1:])]).tobytes()
            if unit.isalpha():
                return array("I", [t.id for t in self.tokenize(unit)]).tobytes()
        if "<|" in unit or not (unit.isascii() or PLAIN.match(unit)):
            return self.library(unit)  # special tokens and rarer scripts: the library sees the unit itself
        if self.spaced:
            if unit[0] == " " and unit[1:].isalpha():
                return self.merged(unit)
        elif unit.isalpha() and unit.islower() and unit.isascii():
            return self.merged(unit)
        parts = self.pieces(unit)
        return self.merged(unit) if parts == [unit] else b"".join([self[p] for p in parts])

    def __missing__(self, unit: str) -> bytes:
        if (ids := self.older.get(unit)) is None:
            if self.spaced and unit[-1] in STOPS and unit[0] == " " and unit[1:-1].isalpha():
                return self[unit[:-1]] + self[unit[-1]]  # held in parts only
            ids = self.computed(unit)
        return self.hold(unit, ids, len(ids))


def texts_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    return pc.fill_null(batch.column(column).cast(pa.large_string()), "")


def drop_blank_units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Units between ASCII white space, and each text's offsets into them."""
    parts = pc.ascii_split_whitespace(texts)
    return parts.flatten(), list_offsets(parts)


def list_offsets(parts) -> np.ndarray:
    offsets = np.asarray(parts.offsets)
    return offsets - offsets[0]


def spaced_units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Units that each start at a single blank between two other characters (the blank is kept)."""
    uneven = pc.match_substring_regex(texts, UNEVEN)
    if not pc.any(uneven).as_py():
        parts = pc.split_pattern(texts, " ")
        units, offsets = parts.flatten(), list_offsets(parts)
        first = np.zeros(len(units), bool)
        first[offsets[:-1]] = True
        blank = pc.if_else(pa.array(first), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
        return pc.binary_join_element_wise(blank, units, pa.scalar("", pa.large_string())), offsets
    units, offsets = [], [0]
    for text in texts.to_pylist():
        head, *tail = SINGLE.split(text)
        units += [head, *[" " + t for t in tail]]
        offsets.append(len(units))
    return pa.array(units, pa.large_string()), np.array(offsets)


def piece_units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Units cut where the bytes on both sides show that a piece of ``SPACED_PIECES`` ends, whatever else the text holds.

    Most units are one piece.  Next to characters of no known kind, after a quote and inside longer runs
    of white space nothing is cut, so such units hold several pieces.  Texts must not spell a special token.
    """
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if at[0] == at[-1]:
        return pa.array([], pa.large_string()), np.zeros(len(texts) + 1, np.int64)
    data, at = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]
    kinds = KINDS[data]
    inner = np.flatnonzero(data & 0xC0 == 0x80)
    lead, last = data[inner - 1], data[inner]
    kinds[inner] = KINDS[lead]
    signs = inner[(lead == 0xC3) & ((last == 0x97) | (last == 0xB7))]  # × and ÷
    kinds[signs] = kinds[signs - 1] = OTHER
    begins = np.zeros(len(data) + 1, bool)
    begins[at] = True
    rules = RULES[kinds[:-1] * np.uint8(8) + kinds[1:]]
    cut = begins[:-1].copy()
    cut[1:] |= rules == CUT
    blank = np.flatnonzero(rules == IF_SOLID_NEXT) + 1
    blank = blank[~begins[blank + 1]]
    cut[blank[IS_SOLID[kinds[blank + 1]]]] = True
    after = np.flatnonzero(rules == IF_SOLID_BEFORE) + 1
    after = after[after > 1]
    cut[after[IS_SOLID[kinds[after - 2]]]] = True
    first = np.flatnonzero(cut)
    ends = np.append(first, len(data))
    return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(data)), np.searchsorted(first, at)


def encoded(texts: pa.Array, memo: UnitIds):
    """(ids of all texts in a row, each text's offsets) for each slice of the texts."""
    for part in slices(texts):
        special = pc.any(pc.match_substring(part, "<|")).as_py()  # the spelling of special tokens is left alone
        if memo.spaced:
            units, offsets = spaced_units(part) if special else piece_units(part)
        else:  # this vocabulary has no capitals
            units, offsets = drop_blank_units(part if special else pc.ascii_lower(part))
        coded = units.dictionary_encode()
        words = [memo[u] if u else b"" for u in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        lengths = np.fromiter(map(len, words), np.int64, len(words)) // 4
        flat, at = np.frombuffer(b"".join(words), "<u4"), np.asarray(coded.indices)
        counts = lengths[at]
        ends = np.cumsum(counts)
        kind = np.int32 if len(flat) + (ends[-1] if len(ends) else 0) < 1 << 31 else np.int64
        starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        where = np.repeat((starts[at] - (ends - counts)).astype(kind), counts)
        where += np.arange(len(where), dtype=kind)
        yield flat[where], np.concatenate(([0], ends))[offsets]
    pa.default_memory_pool().release_unused()


def text_ids(texts: pa.Array, memo: UnitIds):
    """The ids of each text, in order."""
    for ids, offsets in encoded(texts, memo):
        for a, b in zip(offsets[:-1], offsets[1:]):
            yield ids[a:b]


MEMOS: dict[tuple[str, bool], UnitIds] = {}


def memo_for(path: str, spaced: bool) -> UnitIds:
    """One memo for each vocabulary and Python worker, kept between tasks."""
    if (path, spaced) not in MEMOS:
        MEMOS[path, spaced] = UnitIds(path, spaced, SPACED_BYTES if spaced else MEMO_BYTES)
    return MEMOS[path, spaced]
