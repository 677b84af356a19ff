"""Token ids of whole texts by public vocabularies, put together from words that no token crosses.

Most words of a text have been encoded before by the same worker, so the libraries see each of them once in a while.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters after which no cut is made: white space by any table, and the sign that pieces have for a blank.
OPEN = "\x00-\x20\x7f-\xa0 ᠎ -⁯▁　﻿"
#: Letters in every version of Unicode. No byte-level token goes on from one of them to a mark or a blank.
LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
#: Any token ends before a blank that follows a visible character.
BLANK_CUT = re.compile(rf"(?<=[^{OPEN}])(?= )")
UNEASY = "(?:^|[" + re.sub("[^-]", lambda c: f"\\x{{{ord(c[0]):x}}}", OPEN) + "]) "
#: Byte-level ones also end before a line end that does, and between a letter and a mark.
MARK_CUT = re.compile(rf"(?<=[^{OPEN}])(?=\n)|(?<=[{LETTERS}])(?=[!-/:-@\[-`{{-~])")
WORD = re.compile(rf" ?[{LETTERS}]+")
#: Words that are remembered besides those of a batch and the bytes they may take, the longest such word, and parts of words.
REMEMBERED, BYTES, LONGEST, PARTS = 1 << 18, 16 << 20, 64, 1 << 16
#: The sign of pieces for a blank.
BLANK = "▁"
# The bytes that a byte-level vocabulary writes as themselves; the others are written as the characters from 256 on, in order.
SEEN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
SIGNS = {b: b for b in SEEN} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(SEEN)))}


def default_path(name: str) -> str:
    """Where the installed file of this name is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def words_of(text: str, first: bool) -> list[str]:
    """The words of a text, cut at blanks that no token crosses, each without the blank before it. With
    ``first`` the first one has no blank before it (it is empty where the text begins with one)."""
    parts = BLANK_CUT.split(text if first else f" {text}")
    return ([""] if parts[0][:1] == " " and first else []) + [c[1:] if c[:1] == " " else c for c in parts]


def words_of_all(texts: pa.Array, first: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of all texts (not null), and where those of each text begin and end among them."""
    uneasy = pc.match_substring_regex(texts, UNEASY)
    hard = np.flatnonzero(uneasy.to_numpy(zero_copy_only=False))
    easy = np.setdiff1d(np.arange(len(texts)), hard)
    lists = [pc.split_pattern(texts.take(pa.array(easy)), " ").cast(pa.list_(pa.string()))]
    lists.append(pa.array([words_of(t, first) for t in texts.take(pa.array(hard)).to_pylist()], pa.list_(pa.string())))
    joined = pa.concat_arrays(lists)
    offsets, at = joined.offsets.to_numpy(), np.argsort(np.concatenate([easy, hard]), kind="stable")
    return joined.values, offsets[:-1][at], offsets[1:][at]


class Remembered:
    """What a function makes of words, in columns, kept while the words are met again.

    When the table has more than ``REMEMBERED`` words or ``BYTES``, the half that was met last stays, but for long words.
    """

    def __init__(self, of_words: Callable[[list[str]], dict[str, pa.Array]]):
        self.of_words, self.clock = of_words, 0
        self.table = self.made([])
        self.met = np.zeros(0, np.int64)

    def made(self, words: list[str]) -> pa.Table:
        return pa.table({"word": pa.array(words, pa.string()), **self.of_words(words)})

    def of(self, words: pa.Array) -> pa.Table:
        """A row for each of the words, which are distinct."""
        at = pc.index_in(words, value_set=self.table.column("word").combine_chunks())
        unknown = at.is_null().to_numpy(zero_copy_only=False)
        new = self.made(words.filter(pa.array(unknown)).to_pylist())
        table = pa.concat_tables([self.table, new]).combine_chunks()
        place = at.fill_null(0).to_numpy().astype(np.int64)
        place[unknown] = self.table.num_rows + np.arange(new.num_rows)
        self.met = np.concatenate([self.met, np.zeros(new.num_rows, np.int64)])
        self.clock += 1
        self.met[place] = self.clock
        found = table.take(pa.array(place))
        if table.num_rows > REMEMBERED or table.nbytes > BYTES:
            stay = np.argsort(-self.met, kind="stable")[: min(REMEMBERED, table.num_rows) // 2]
            stay = stay[(pc.utf8_length(table.column("word")).to_numpy() <= LONGEST)[stay]]
            table, self.met = table.take(pa.array(stay)).combine_chunks(), self.met[stay]
        self.table = table
        return found


@lru_cache(maxsize=4)
def byte_level(path: str):
    """The byte-level tokenizer of a file; strings of special tokens in a text are plain text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    found.model._resize_cache(0)  # words are remembered here
    return found


@lru_cache(maxsize=4)
def pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=4)
def byte_level_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    byte = {chr(sign): b for b, sign in SIGNS.items()}
    entries = byte_level(path).get_vocab(with_added_tokens=False)
    found = [b""] * (1 + max(entries.values()))
    for entry, i in entries.items():
        found[i] = bytes(byte[c] for c in entry)
    return found


def piece_names(path: str) -> list[str]:
    model = pieces(path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size())]


@lru_cache(maxsize=4)
def piece_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a piece vocabulary: the piece in UTF-8 with blanks for their sign, or the one byte it stands for."""
    model = pieces(path)
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(piece_names(path))]


class ByteLevel:
    """What ``made`` makes of the ids of words with the blank before them, by a byte-level vocabulary. A word is put together
    from parts, which are remembered too; a part of letters is one unit of the merges, so it goes to them directly."""

    def __init__(self, path: str, made: Callable[[list[int]], bytes | tuple]):
        self.whole, self.made = byte_level(path), made
        self.merged, self.signs = self.whole.model.tokenize, {b: chr(sign) for b, sign in SIGNS.items()}
        self.blank = self.signs[0x20]
        self.young, self.old = {}, {}

    def part(self, text: str) -> bytes | tuple:
        if text.isascii() and text[:1] == " " and text[1:].isalpha():
            return self.made([t.id for t in self.merged(self.blank + text[1:])])
        if WORD.fullmatch(text):
            return self.made([t.id for t in self.merged(text.encode().decode("latin-1").translate(self.signs))])
        return self.made(self.whole.encode(text, add_special_tokens=False).ids)

    def of(self, words: list[str]) -> list[bytes | tuple]:
        if len(self.young) > PARTS:
            self.young, self.old = {}, {c: x for c, x in self.young.items() if len(c) <= LONGEST}
        young, old, found = self.young, self.old, []
        for w in words:
            joined = None
            for p in (f" {w}",) if w.isascii() and w.isalpha() else MARK_CUT.split(f" {w}"):
                x = young.get(p)
                if x is None:
                    x = young[p] = old.get(p) or self.part(p)
                joined = x if joined is None else joined + x
            found.append(joined)
        return found


def piece_ids(path: str, words: list[str]) -> list[list[int]]:
    """Ids of words with the blank before them, which the model adds by itself."""
    model = pieces(path)
    return [x or [model.piece_to_id(BLANK)] for x in model.encode(words, num_threads=1)]


@lru_cache(maxsize=4)
def checked_pieces(path: str) -> str:
    """The path of a piece vocabulary, none of whose pieces has a blank after another character."""
    wrong = [p for p in piece_names(path) if re.search(f"[^{BLANK}]{BLANK}", p)]
    if wrong:
        raise ValueError(f"{path} has pieces that go over a blank, such as {wrong[0]!r}")
    return path


@lru_cache(maxsize=4)
def packer(path: str, width: int) -> Remembered:
    """Ids of words by a byte-level vocabulary, as little-endian numbers of ``width`` bytes."""
    packed = [i.to_bytes(width, "little") for i in range(byte_level(path).get_vocab_size())]
    known = ByteLevel(path, lambda ids: b"".join(map(packed.__getitem__, ids)))
    return Remembered(lambda words: {"ids": pa.array(known.of(words), pa.binary())})


def packed_ids(texts: pa.Array, path: str, width: int) -> list[bytes]:
    """The ids of each whole text, one after another: those that the library gives for it at once."""
    words, begins, ends = words_of_all(texts, first=True)
    coded = words.dictionary_encode()
    known = packer(path, width).of(coded.dictionary).column("ids").combine_chunks().cast(pa.large_binary()).take(coded.indices)
    _, offsets, data = known.buffers()
    at, data = np.frombuffer(offsets, np.int64), memoryview(data) if data else b""
    heads = byte_level(path).encode_batch_fast(words.take(pa.array(begins)).to_pylist(), add_special_tokens=False)
    return [np.array(h.ids, f"<u{width}").tobytes() + bytes(data[a:b]) for h, a, b in zip(heads, at[begins + 1].tolist(), at[ends].tolist(), strict=True)]


def width_of(path: str) -> int:
    """Bytes that hold any id of a vocabulary."""
    return 2 if byte_level(path).get_vocab_size() <= 1 << 16 else 4
