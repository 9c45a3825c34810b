"""Token ids of whole texts by the tokenizers library, through a cache of what stands between white space.

Both vocabularies used here treat a text piece by piece and no piece crosses the places at which a text is parted
below, so the ids of a text are the ids of its parts, one after the other.  Parts repeat, so most are looked up.  For
vocabularies that drop white space ``Encoder.encode_all`` parts many texts at once and looks each different piece up once.

A text that holds the content of an added token, such as ``<|endoftext|>``, goes to the library as a whole where
``added_tokens`` is set, and so has the ids of ``encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import gc
import json
import os
import re
import struct
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import cache_of

#: White space as the vocabularies' patterns know it (Unicode White_Space).
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_BEFORE_SPACE = re.compile(f"(?<=[^{_WHITE}])(?=[{_WHITE}])")
_OTHER_WHITE = "\t\x0b\x0c\r\x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))
_PAIRS = ("  ", " \n", "\n ", "\n\n", "\x00")
#: Parts longer than this are not kept.
_LONGEST = 48

# The splitting patterns of the two kinds of vocabulary, as their files state them.
_KEEPING = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_DROPPING = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: A line break, or printable Latin-1 after at most one space.
_LATIN = re.compile("\\n| ?[!-~\xa1-\xac\xae-\xff]+")

#: What ``pieces_without_spaces`` splits by pattern: printable ASCII and the letters of Latin-1.
_PLAIN = re.compile("[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
_GAP, _LETTER, _DIGIT, _SIGN, _ODD = range(5)
#: The same for bytes of UTF-8, where 0xc3 leads those letters; after another lead, which is odd, the rest doesn't matter.
_KINDS = np.full(256, _ODD, np.uint8)
_KINDS[[*b"\t\n\v\f\r "]] = _GAP
_KINDS[0x21:0x7F] = _SIGN
_KINDS[[*b"0123456789"]] = _DIGIT
_KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), 0xC3]] = _LETTER
_KINDS[[0x97, 0xB7]] = _ODD
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[[*range(0x41, 0x5B), *range(0x80, 0x9F)]] += 0x20


def _byte_chars() -> list[str]:
    """The visible character that byte-level vocabularies write for each byte."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


_BYTE_CHARS = {b: c for b, c in enumerate(_byte_chars())}
_PACKERS = {kind: [struct.Struct(f"<{n}{code}").pack for n in range(16)] for kind, code in (("<u4", "I"), ("<u2", "H"))}


def _shown(piece: str) -> str:
    """The piece in the characters that byte-level vocabularies write for its bytes."""
    if piece.isascii():
        return piece.replace(" ", _BYTE_CHARS[0x20]) if piece.isprintable() else piece.translate(_BYTE_CHARS)
    return piece.encode().decode("latin-1").translate(_BYTE_CHARS)


def _rules(path: str) -> str | None:
    """Which of the two splitting patterns the vocabulary's file asks for, if its other rules are those known here."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    model, normalizer, splitter = told["model"], told["normalizer"], told["pre_tokenizer"] or {}
    if model["type"] != "BPE" or any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
        return None
    if splitter.get("type") == "ByteLevel" and splitter["use_regex"] and not splitter["add_prefix_space"] and normalizer is None:
        return _KEEPING
    steps = [x["type"] for x in splitter.get("pretokenizers", [])], [x["type"] for x in (normalizer or {}).get("normalizers", [])]
    if steps != (["Split", "ByteLevel"], ["NFC", "Replace", "Lowercase"]):
        return None
    split, level = splitter["pretokenizers"]
    white = normalizer["normalizers"][1]
    plain = split["behavior"] == "Removed" and split["invert"] and not level["use_regex"] and not level["add_prefix_space"]
    known = split["pattern"] == {"Regex": _DROPPING} and white["pattern"] == {"Regex": r"\s+"} and white["content"] == " "
    return _DROPPING if plain and known else None


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def parts_with_spaces(text: str) -> list[str]:
    """For byte-level vocabularies: a space belongs to what follows it, a line break stands alone."""
    if any(x in text for x in _PAIRS) or any(x in text for x in (_OTHER_WHITE[:4] if text.isascii() else _OTHER_WHITE)):
        return _BEFORE_SPACE.split(text)
    return text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")


def parts_without_spaces(text: str) -> list[str]:
    """For vocabularies that drop white space."""
    return text.replace("\n", " ").split(" ")


def utf8(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after the other, and where each begins, with the end of the last."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int32)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces_without_spaces(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """For vocabularies that drop white space: pieces of all texts (no nulls), one after the other, and how many there are up
    to the end of each text.

    What stands between white space and has other characters than those of ``_PLAIN`` comes unsplit and as it is, all else
    in lower case.
    """
    raw, offsets = utf8(texts)
    n = len(raw)
    first = np.zeros(n + 3, bool)
    first[offsets] = True
    kinds, low = _KINDS[raw], np.zeros(n + 2, np.uint8)
    low[:n] = _LOWER[raw]
    if (kinds == _ODD).any():
        bounds = np.append(np.flatnonzero((kinds == _GAP) | first[:n]), n)
        odd = np.flatnonzero(np.maximum.reduceat(kinds, bounds[:-1]) == _ODD)
        begin, turn = bounds[odd], np.zeros(n + 1, np.int8)
        turn[begin + (kinds[begin] == _GAP)] += 1
        turn[bounds[odd + 1]] -= 1
        unsplit = np.cumsum(turn[:n], dtype=np.int8).view(bool)
        kinds[unsplit] = _ODD
        np.copyto(low[:n], raw, where=unsplit)
    solid = kinds != _GAP
    start = first[:n] | (kinds == _DIGIT)
    start[1:] |= kinds[1:] != kinds[:-1]
    start &= solid
    # 's, 't, 'm, 'd, 're, 've and 'll are pieces where a run of signs begins with them
    at = np.flatnonzero((raw == 0x27) & start & (kinds == _SIGN))
    one, two = low[at + 1], low[at + 1].astype(np.uint16) << 8 | low[at + 2]
    length = np.where(np.isin(two, [int.from_bytes(x) for x in (b"re", b"ve", b"ll")]) & ~first[at + 2], 3, 0)
    length = np.where(np.isin(one, [*b"stmd"]), 2, length) * ~first[at + 1]
    at, length = at[length > 0], length[length > 0]
    start[at + 1] = False
    after = (at + length)[at + length < n]
    start[after] = solid[after]
    data = low[:n][solid]
    places = np.append(np.flatnonzero(start[solid]), len(data)).astype(np.int32)
    pieces = pa.StringArray.from_buffers(len(places) - 1, pa.py_buffer(places), pa.py_buffer(data))
    return pieces, np.searchsorted(np.flatnonzero(start), offsets[1:])


class Kept(dict):
    """Results by key.  At most ``2 * keep`` are held; what hasn't been asked for lately goes first."""

    def __init__(self, make, keep: int):
        super().__init__()
        self.make, self.keep, self.old = make, keep, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= _LONGEST:
            self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > self.keep:
            self.old = dict(self)
            self.clear()


class Encoder:
    """Whole texts -> ids as little-endian bytes of ``kind``: unsigned, of 32 bits, or of 16 where the vocabulary allows it.

    A part is normalised and split by the vocabulary's own rules and its pieces go through the vocabulary's model.  For
    parts in Latin-1, where those rules are plain, a pattern stands in for the library's slower calls; letters alone are
    one piece.  Contents of added tokens are ordinary text unless ``added_tokens`` is set.  A file whose rules aren't
    those of ``drops_space`` is an error.
    """

    def __init__(self, path: str, drops_space: bool, keep: int = 400_000, added_tokens: bool = False, kind: str = "<u4"):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        pattern = _DROPPING if drops_space else _KEEPING
        if _rules(path) != pattern:
            raise ValueError(f"{path}: not the normaliser, splitting pattern and model that are known for drops_space={drops_space}")
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.normalizer, self.splitter = self.tokenizer.model, self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        tokens = self.tokenizer.get_added_tokens_decoder().values() if added_tokens else ()
        if any(x.normalized for x in tokens):
            raise ValueError(f"{path}: added tokens that are looked for in normalised text")
        self.added = [x.content for x in tokens]
        self.lower = drops_space
        self.kind, self.packers = kind, _PACKERS[kind]
        self.split = parts_without_spaces if drops_space else parts_with_spaces
        self.pattern = regex.compile(pattern)
        self.parts = Kept(self._part, keep)
        self.pieces = Kept(self._piece, keep)
        self.uncut = Kept(self._uncut, keep)

    def _piece(self, piece: str) -> bytes:
        ids = [x.id for x in self.model.tokenize(piece)]
        return self.packers[len(ids)](*ids) if len(ids) < len(self.packers) else np.array(ids, self.kind).tobytes()

    def _part(self, part: str) -> bytes:
        if part.isascii() and (part.isalpha() or not self.lower and part[:1] == " " and part[1:].isalpha()):
            return self.pieces[part.lower() if self.lower else _shown(part)]
        if _LATIN.fullmatch(part):
            pieces = map(_shown, self.pattern.findall(part.lower() if self.lower else part))
        else:
            clean = self.normalizer.normalize_str(part) if self.normalizer else part
            pieces = [x for x, _ in self.splitter.pre_tokenize_str(clean)]
        return b"".join(map(self.pieces.__getitem__, pieces))

    def _uncut(self, piece: str) -> bytes:
        """Ids of what ``pieces_without_spaces`` gives."""
        return self._piece(_shown(piece)) if _PLAIN.fullmatch(piece) else self._part(piece)

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text."""
        if not text:
            return b""
        for content in self.added:
            if content in text:
                return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        self.parts.trim()
        self.pieces.trim()
        return b"".join(map(self.parts.__getitem__, self.split(text)))

    def encode_all(self, texts: pa.Array, end: int) -> pa.Array:
        """Ids of each whole text (null: none) with the id ``end`` behind them, as ``encode`` gives them."""
        texts, last = pc.fill_null(texts.cast(pa.string()), ""), np.array([end], self.kind).tobytes()
        if not self.lower:
            return pa.array([self.encode(x) + last for x in texts.to_pylist()], pa.binary())
        held, raw = np.zeros(len(texts), bool), utf8(texts)[0].tobytes() if self.added else b""
        for content in self.added:
            if content.encode() in raw:
                held |= np.asarray(pc.match_substring(texts, content))
        whole = [self.encode(texts[i].as_py()) + last for i in np.flatnonzero(held).tolist()]
        if whole:
            texts = pc.if_else(pa.array(held), "", texts)
        pieces, upto = pieces_without_spaces(texts)
        coded = pieces.dictionary_encode()
        for kept in (self.uncut, self.parts, self.pieces):
            kept.trim()
        found = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = [*map(self.uncut.__getitem__, found), last, *whole]
        # each text's pieces are followed by its end, or by all of it where the library took it whole
        place = upto + np.arange(len(texts))
        which = np.empty(len(pieces) + len(texts), np.int32)
        inner = np.ones(len(which), bool)
        inner[place] = False
        which[inner] = coded.indices
        which[place] = len(ids) - len(whole) - 1
        which[place[held]] = np.arange(len(ids) - len(whole), len(ids))
        taken = pa.array(ids, pa.binary()).take(pa.array(which))
        ends = np.frombuffer(taken.buffers()[1], np.int32)[np.concatenate([[0], place + 1])]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends), taken.buffers()[2]])


def encoder(path: str, drops_space: bool, added_tokens: bool = False, kind: str = "<u4") -> Encoder:
    """One encoder for each vocabulary, its handling and Python worker."""
    key, have = (path, drops_space, added_tokens, kind), cache_of("tokens")
    if key not in have:
        have[key] = Encoder(path, drops_space, added_tokens=added_tokens, kind=kind)
    return have[key]


@contextmanager
def no_cycle_search() -> Iterator[None]:
    """No search for garbage in cycles, which goes through the caches again and again; encoding makes no cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()
