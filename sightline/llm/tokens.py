"""Tokenizing in tasks: each distinct piece of text goes through the tokenizer library once.

A piece is a run of ASCII blanks with the non-blank run behind it.  The two tokenizers that are
used here never join what lies on both sides of such a boundary (their pre-tokenizers break where a
blank follows a non-blank), so the tokens of a text are those of its pieces, one after another.
Texts with other white space or control characters are cut only between visible ASCII characters.
"""

from __future__ import annotations

import functools
import re
from itertools import chain

import numpy as np

from sightline.llm.workers import enter

#: A piece; together the pieces are the whole text.
PIECE = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+\Z")
#: Characters that some regular-expression engines count as blanks and others don't.
ODD = re.compile(
    "[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]"
)
#: In texts with such characters, pieces begin only where visible ASCII stands on both sides of one blank.
SAFE = re.compile("(?<=[!-~])(?= [!-~])")
#: Bytes that a worker remembers of pieces before it starts anew (each with ``EACH`` for its entries).
REMEMBERED, EACH = 96_000_000, 170
_L = "a-z\xdf-\xf6\xf8-\xff"
#: Pieces of plain parts: (line feed)(letters)(punctuation); the pre-tokenizers break just between them.
PLAIN_BEGIN = re.compile(rf"(\n?)((?<!\n) [A-Z\xc0-\xd6\xd8-\xde{_L}]+|[A-Z\xc0-\xd6\xd8-\xde{_L}]+)([!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{{|}}~]*)")
PLAIN_END = re.compile(rf"()([\xc0-\xd6\xd8-\xde{_L}]+)([!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{{|}}~]*)")


#: How a byte-level vocabulary writes the bytes 128 to 191, which continue a character.
#: Bytes that are printable in Latin-1 stand for themselves, the others for 256, 257 and so on.
_PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_CONTINUES = {chr(b) for b in _PRINTED if 128 <= b < 192} | {chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PRINTED))) if 128 <= b < 192}


class _Index(dict):
    """Number of each piece; an unknown one gets the next number and is noted in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = i = len(self)
        self.new.append(piece)
        return i


class _Lists:
    """Short number lists on end: list i is ``flat[starts[i] : starts[i + 1]]``."""

    def __init__(self, flat=None, sizes=None, dtype=np.uint32):
        self.flat = np.zeros(0, dtype) if flat is None else flat
        self.starts = np.zeros(1, np.int64) if sizes is None else np.concatenate([[0], np.cumsum(sizes)])

    def sizes(self, which: np.ndarray) -> np.ndarray:
        return self.starts[which + 1] - self.starts[which]

    def of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of those numbers on end, and their sizes."""
        size = self.sizes(which)
        at = np.arange(int(size.sum()), dtype=np.int64) + np.repeat(self.starts[which] - (np.cumsum(size) - size), size)
        return self.flat[at], size

    def extend(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.flat = np.concatenate([self.flat, flat])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])


class Encoder:
    """Token ids of whole texts, with a memory of pieces.

    A vocabulary with word-end marks drops white space and case; its pieces are blank-separated
    words in lower-case ASCII.  Any other is taken to be byte-level, with blanks kept.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.no_truncation()
        self.t.no_padding()
        vocab = self.t.get_vocab()
        self.top = max(vocab.values())
        self.ends = any(k.endswith("</w>") for k in vocab)
        # the same model for parts that its own rules would leave whole, many in one string
        rules = json.loads(self.t.to_str())
        rules["normalizer"] = rules["post_processor"] = None
        rules["added_tokens"] = []
        rules["pre_tokenizer"] = {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"String": "\x00"}, "behavior": "Removed", "invert": False},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        }
        self.model = Tokenizer.from_str(json.dumps(rules))
        self.plain = (PLAIN_END if self.ends else PLAIN_BEGIN).fullmatch
        if not self.ends:
            # characters that begin in each token, and whether its first byte begins one
            special = {i: t.content for i, t in self.t.get_added_tokens_decoder().items()}
            self.chars, self.clean = np.zeros(self.top + 1, np.int32), np.ones(self.top + 1, bool)
            for name, i in vocab.items():
                bits = np.array([c not in _CONTINUES for c in name]) if i not in special else np.ones(len(name), bool)
                self.chars[i], self.clean[i] = bits.sum(), bits[0]
        self.reset()

    def reset(self) -> None:
        self.index, self.bytes = _Index(), 0
        self.tokens = _Lists()

    def _alone(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [x.ids for x in self.t.encode_batch_fast(pieces, add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum())), sizes

    def _together(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [], []
        for i in range(0, len(parts), 200_000):
            some = parts[i : i + 200_000]
            got = self.model.encode_batch(["\0".join(some[j : j + 1000]) for j in range(0, len(some), 1000)], add_special_tokens=False)
            for j, x in enumerate(got):
                ids.append(np.array(x.ids, np.uint32))
                sizes.append(np.bincount(np.array(x.word_ids, np.int64), minlength=min(1000, len(some) - 1000 * j)))
        return (np.concatenate(ids), np.concatenate(sizes)) if ids else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _learn(self) -> None:
        new, self.index.new = self.index.new, []
        self.bytes += sum(map(len, new)) + EACH * len(new)
        found = [self.plain(p) for p in new]
        easy = np.fromiter((m is not None for m in found), bool, len(new))
        parts = _Index()  # number of each part
        three = np.array([[parts[x] if x else -1 for x in (m[1], m[2].lower() if self.ends else m[2], m[3])] for m in found if m], np.int64).reshape(-1, 3)
        names = list(parts)
        lists = _Lists(*self._together(names))
        a, of_part = lists.of(three[three >= 0])
        in_parts = np.zeros(three.shape, np.int64)
        in_parts[three >= 0] = of_part
        hard = [p for p, m in zip(new, found) if not m]
        self.tokens.extend(*_merge(easy, a, in_parts.sum(1), *self._alone(hard)))
    def _split(self, text: str) -> list[str]:
        if ODD.search(text):
            return SAFE.split(text)
        if not self.ends:
            return PIECE.findall(text)
        if "<|" not in text:
            text = text.encode().lower().decode()
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all pieces of all texts on end, and the count of pieces of each text."""
        if self.bytes > REMEMBERED:
            self.reset()
        split = [self._split(t) for t in texts]
        n = np.fromiter(map(len, split), np.int64, len(split))
        flat = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))
        if self.index.new:
            self._learn()
        return flat, n

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids on end, and the number of ids of each text."""
        flat, n = self.pieces(texts)
        ids, size = self.tokens.of(flat)
        return ids, _sums(size, n)

    def prefix_ends(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Characters of the first 0, 1, 2, ... tokens of every text on end, and the number of entries of
        each text.  -1 where a token ends inside a character."""
        if self.ends:
            raise ValueError("tokens of this vocabulary don't cover the text, so prefixes have no place in it")
        ids, n = self.encode(texts)
        ends = np.cumsum(n)
        at = np.cumsum(self.chars[ids], dtype=np.int64)
        at -= np.repeat(np.concatenate([[0], at])[ends - n], n)
        inside = ~self.clean[ids]  # then the token before ends inside a character
        at[np.flatnonzero(inside[1:])] = -1
        return np.insert(at, ends - n, 0), n + 1


def _merge(easy, a, an, b, bn) -> tuple[np.ndarray, np.ndarray]:
    """Lists of two kinds in one order: those of ``easy`` from ``a``, the others from ``b``."""
    sizes = np.zeros(len(easy), np.int64)
    sizes[easy], sizes[~easy] = an, bn
    flat = np.zeros(int(sizes.sum()), a.dtype)
    of_easy = np.repeat(easy, sizes)
    flat[of_easy], flat[~of_easy] = a, b
    return flat, sizes


def _sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of the first n[0] values, the next n[1], and so on."""
    cum = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(n)
    return cum[ends] - cum[ends - n]


@functools.cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def encoder(path: str) -> Encoder:
    """One for each worker process, which serves many tasks."""
    enter("tokens", _encoder.cache_clear)
    return _encoder(path)


def batches(lengths: list[int], most: int):
    """(first, last) slices of about ``most`` units of length; a long text is a slice of its own."""
    first = size = 0
    for i, n in enumerate(lengths):
        size += n
        if size >= most:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(lengths):
        yield first, len(lengths)
