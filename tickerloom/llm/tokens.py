"""Encoding with the tokenizers library, one word at a time and remembered.

The vocabulary's pre-tokenizer never joins text across ASCII white space and its normalizer works inside such words, so
the ids of a text are the ids of its words in order. Words repeat; each worker keeps a bounded table of them and asks the
library only for new ones. ``tests/llm`` compares this with encoding whole texts.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np

from tickerloom.llm.common import kept_for_stage

END_ID = 1
#: Words remembered by a worker; beyond it the table starts anew, which costs time only.
REMEMBER = 600_000
#: New words that the library encodes at once: what it returns takes about a kilobyte a word.
LEARN = 10_000
#: Bytes of texts encoded at once, and bytes of a text that are split into words at once.
GROUP, PIECE = 1 << 21, 1 << 18
_WHITE = re.compile(rb"[ \t-\r]")
#: Words of a-z and the small letters of Latin-1: the normalizer leaves them as they are and the pre-tokenizer whole.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\xa0-\xb6\xb8-\xbf])+")
#: What is beyond Latin-1: composing before or after lower case may differ there, so such text keeps its case.
_WIDE = re.compile(rb"[\xc4-\xff]")
_PUNCT = re.escape(b".,|!$%&*#;:?")
#: Closing punctuation after a letter or digit. A run of symbols is one piece, so there, and only there, it is a piece of its own.
_CLOSING = re.compile(rb"[%b](?:(?<=[a-z0-9].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))[%b]*+(?=[ \t-\r]|\Z)" % (_PUNCT, _PUNCT))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder(dict):
    """ids(text) for a vocabulary file of the tokenizers library whose ids are below 65,536; as a mapping, numbers of the words remembered."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        # Added tokens are matched as they are written; text with what all of them start with (in any case) may hold one.
        added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = os.path.commonprefix(added) if added else b"\xff"
        # The byte-level step shows bytes that are no printable Latin-1 characters as the characters from U+0100 on.
        hidden = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b)]
        self.chars = {b: 0x100 + k for k, b in enumerate(hidden) if b != 0x20}
        # The merge step alone, for words that need no other; a word's last id is one with the word's end in it.
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = CharDelimiterSplit(" ")
        self.last = np.zeros(1 << 16, bool)
        if suffix := self.tokenizer.model.end_of_word_suffix:
            self.last[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self.new: list[bytes] = []
        self.ids_known, self.ends = array("H"), array("q", [0])  # the ids of word n are ids_known[ends[n]:ends[n + 1]]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def _learn(self) -> None:
        """Encode the new words, LEARN at once."""
        for at in range(0, len(self.new), LEARN):
            self._learn_some(self.new[at : at + LEARN])
        self.new = []

    def _learn_some(self, new: list[bytes]) -> None:
        """Plain words are encoded by the library's merge step together, the others by its whole chain."""
        plain = [w for w in new if _PLAIN.fullmatch(w)] if self.last.any() else []
        made = {}
        if plain:
            joined = b" ".join(plain)
            text = joined.decode() if joined.isascii() else joined.decode("latin-1").translate(self.chars)
            ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u2")
            raw, ends = ids.tobytes(), (2 * np.flatnonzero(self.last[ids]) + 2).tolist()
            made = {w: raw[a:b] for w, a, b in zip(plain, [0, *ends], ends, strict=False)}
        rest = [w for w in new if w not in made]
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in rest], add_special_tokens=False)
        made.update((w, array("H", x.ids).tobytes()) for w, x in zip(rest, found))
        parts = list(map(made.__getitem__, new))
        self.ids_known.frombytes(b"".join(parts))
        self.ends.extend((self.ends[-1] + np.cumsum(np.array(list(map(len, parts))) // 2)).tolist())

    def _split(self, text: bytes) -> list[bytes]:
        """The words of a text: in lower case and without their closing punctuation where that changes no id."""
        low = text.lower()
        if self.mark in low or _WIDE.search(text):
            return text.split()
        return _CLOSING.sub(rb" \g<0>", low).split()

    def _ids(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self) > REMEMBER:
            self._forget()
        numbers = []
        for words in map(self._split, texts):
            numbers.append(np.fromiter(map(self.__getitem__, words), np.int64, len(words)))
        if self.new:
            self._learn()
        number = np.concatenate([*numbers, np.zeros(0, np.int64)])
        ends = np.frombuffer(self.ends, np.int64)
        first, size = ends[number], ends[number + 1] - ends[number]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = np.frombuffer(self.ids_known, "<u2")[np.repeat(first - upto[:-1], size) + np.arange(upto[-1])] if len(number) else np.zeros(0, "<u2")
        cuts = upto[np.cumsum([0, *map(len, numbers)])]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def each(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The ids of each whole text in turn, little-endian unsigned 16-bit. New words are learned for many texts at once; a long text goes piece by piece."""
        group: list[bytes] = []
        held = 0
        for text in texts:
            if len(text) > PIECE:
                yield from self._ids(group)
                group, held = [], 0
                yield np.concatenate([self._ids([piece])[0] for piece in _pieces(text)])
                continue
            group.append(text)
            held += len(text)
            if held > GROUP:
                yield from self._ids(group)
                group, held = [], 0
        yield from self._ids(group)

    def ids(self, text: bytes) -> np.ndarray:
        return next(self.each([text]))


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text cut at white space into pieces of about PIECE bytes (an unbroken run stays whole)."""
    at = 0
    while len(text) - at > PIECE:
        cut = _WHITE.search(text, at + PIECE)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a vocabulary file, with the words that it met in this stage."""
    kept = kept_for_stage()
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]
