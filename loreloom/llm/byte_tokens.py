"""Token ids of whole texts by their words: a batch's distinct words are looked up once, and ids of words are remembered
in each Python worker."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from loreloom.llm.common import pieces_of, remembered

#: A place that no token reaches across: before a single blank or line break between two other characters.
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Texts with other white space than single blanks and line breaks within are cut by that pattern.
_OTHER_SPACE = "[ \n][ \n]|\\A[ \n]|[ \n]\\z|[\t\x0b-\r\x1c-\x1f\u0085   -     　]"
#: Letters of the Latin and Cyrillic blocks, then marks: two stretches to the byte-level pattern.
_SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ɏЀ-ҁҊ-ӿ]+)([.,;:!?&*%$#]*)")
#: Longer words are not remembered.
_LONG = 80


def text_runs(texts: pa.Array, most_bytes: int = 8 << 20) -> Iterator[tuple[int, pa.Array]]:
    """Runs of about ``most_bytes`` (one text at least) of a string array, nulls as '', with the place of their first."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + most_bytes, "right")))
        yield start, texts.slice(start, end - start)
        start = end


class Words:
    """The words of a run of texts: ``distinct`` keys, and for each text its words' places in them.

    A key is a word behind a blank; one that begins with a line break or carriage return is a stretch of its own, the
    latter without that sign. ``space``: the texts are preceded by a blank."""

    def __init__(self, texts: pa.Array, space: bool):
        odd = pc.match_substring_regex(texts, _OTHER_SPACE).to_numpy(zero_copy_only=False)
        plain = texts.filter(pa.array(~odd)) if odd.any() else texts
        plain = pc.replace_substring(plain, "\n", " \n")
        if not space:
            plain = pc.binary_join_element_wise(pa.scalar("\r", pa.large_string()), plain, pa.scalar("", pa.large_string()))
        lists = pc.split_pattern(plain, " ")
        words = lists.flatten()
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        if odd.any():
            others = [_keys(t, space) for t in texts.filter(pa.array(odd)).to_pylist()]
            words = pa.concat_arrays([words, pa.array([w for keys in others for w in keys], pa.large_string())])
            every = np.empty(len(texts), np.int64)
            every[~odd], every[odd] = lengths, [len(keys) for keys in others]
            first = np.empty(len(texts), np.int64)
            first[~odd] = np.cumsum(lengths) - lengths
            first[odd] = lengths.sum() + np.cumsum(every[odd]) - every[odd]
            run, place = pieces_of(every)
            order, lengths = first[run] + place, every
        else:
            order = None
        coded = words.dictionary_encode()
        self.distinct: list[str] = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.codes = coded.indices.to_numpy()
        if order is not None:
            self.codes = self.codes[order]
        self.ends = np.cumsum(lengths)

    def ids(self, model: _ByWords) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has."""
        coded = list(map(model.known.__getitem__, self.distinct))
        ids = np.frombuffer(b"".join(coded), np.uint32)
        size = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        first = np.cumsum(size) - size
        sizes = size[self.codes]
        ends = np.cumsum(sizes)
        at = np.repeat(first[self.codes] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        upto = np.concatenate(([0], ends))[np.concatenate(([0], self.ends))]
        return ids[at], np.diff(upto)


def _keys(text: str, space: bool) -> list[str]:
    return [s[1:] if s[0] == " " and s[1:2] not in ("", "\n", "\r") else "\r" + s
            for s in _CUT.split(" " + text if space else text)]


class _words(remembered):
    def __missing__(self, key):
        return self.compute(key) if len(key) > _LONG else super().__missing__(key)


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves, the others
    for the letters from 256 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class _ByWords:
    """``known`` has the ids of each key of ``Words``, as the bytes of unsigned 32-bit numbers."""

    def __init__(self, remember: int):
        self.known = _words(self._of_key, remember)

    def _of_key(self, key: str) -> bytes:
        if key[:1] == "\r":
            return self.encode(key[1:]) if len(key) > 1 else b""
        return self.encode(key if key[:1] == "\n" else " " + key)

    def encode(self, stretch: str) -> bytes:
        """Ids of a stretch between two cuts."""
        raise NotImplementedError


class ByteLevel(_ByWords):
    """A byte-level BPE of the tokenizers library. ``plain``: special tokens' strings are ordinary text."""

    def __init__(self, path: str, plain: bool, remember: int = 500_000):
        from tokenizers import Tokenizer

        super().__init__(remember)
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = plain
        self.merges = self.model.model.tokenize
        self.letters = byte_letters()
        self.lettered = dict(enumerate(self.letters))

    def _merged(self, word: str) -> bytes:
        return array("I", [t.id for t in self.merges(word.encode().decode("latin-1").translate(self.lettered))]).tobytes()

    def encode(self, stretch: str) -> bytes:
        if stretch[0] == " " and (word := stretch[1:]).isalpha() and (word.isascii() or max(word) < "\u0500"):
            return self._merged(stretch)
        lead = stretch[0] if stretch[0] in " \n" else ""
        simple = _SIMPLE.fullmatch(stretch, len(lead))
        if simple is None:
            return array("I", self.model.encode(stretch, add_special_tokens=False).ids).tobytes()
        core, marks = simple.groups()
        if lead == "\n":
            return self._merged("\n") + self.encode(stretch[1:])
        if marks:
            return self.known[core if lead else "\r" + core] + self.known["\r" + marks]
        return self._merged(stretch)

    def token_bytes(self) -> list[bytes]:
        """The bytes of every id."""
        value = {c: b for b, c in enumerate(self.letters)}
        return [bytes(value[c] for c in token) if all(c in value for c in token) else token.encode()
                for token in map(self.model.id_to_token, range(self.model.get_vocab_size()))]


class Pieces(_ByWords):
    """A sentencepiece model that writes a blank as U+2581 and puts one before every text.

    No piece of it may hold a blank behind another character, or a line break: words would not be separate."""

    def __init__(self, path: str, remember: int = 500_000):
        from sentencepiece import SentencePieceProcessor

        super().__init__(remember)
        self.model = SentencePieceProcessor(model_file=path)
        self.pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("\n" in p or re.search("[^▁]▁", p) for p in self.pieces):
            raise ValueError("pieces of this model reach across words")
        self.blank = self.model.piece_to_id("▁")

    def encode(self, stretch: str) -> bytes:
        if stretch == " ":
            return array("I", [self.blank]).tobytes()
        if stretch[0] == " ":
            return array("I", self.model.encode(stretch[1:], num_threads=1)).tobytes()
        # The blank that the model puts before a line break stays a piece of its own.
        return array("I", self.model.encode(stretch, num_threads=1)[1:]).tobytes()

    def token_bytes(self) -> list[bytes]:
        return [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                for i, p in enumerate(self.pieces)]


@cache
def byte_level(path: str, plain: bool, remember: int = 500_000) -> ByteLevel:
    """One for all tasks of a worker process: what it remembers is bounded, about 200 bytes a word."""
    return ByteLevel(path, plain, remember)


@cache
def piece_model(path: str, remember: int = 500_000) -> Pieces:
    return Pieces(path, remember)


def vocabulary_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
