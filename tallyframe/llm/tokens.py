"""Token ids of whole texts, as the tokenizers library gives them for a tokenizer file.

The vocabulary, merges, normalisation and special tokens are those of the file, and any
text may go through the tokenizer itself. It takes over 500 seconds a GB, most of it for
offsets and strings that nobody asked for. So spans of plain characters (Latin letters,
digits, punctuation, spaces, line breaks) are merged by tiktoken's byte-pair merger, built
from the merges of the same file; ``Encoder`` checks that the file is one whose ids follow
from ranks alone, and uses the tokenizer for everything otherwise:

- Byte level: a token's rank is its id, and the words are those of the public pattern.
- With word ends: a word is lower-cased and closed by a NUL, which stands for the end of a
  word in the vocabulary. The ids of characters at the end of a word lie below those of all
  merges, so the last character and the NUL merge first, as the file has it.

A text is cut at single spaces between a visible character and a Latin letter, which no
word of either tokenizer crosses. Pieces with any other character, or with a run of over
``LONGEST`` characters without a word border, go through the tokenizer, and so does a whole
text that holds the string of an added (special) token. The ids are those that the
unmodified tokenizer gives for the whole text; tests hold them against each other.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array
from collections.abc import Iterator

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
#: Characters of a long text that are encoded at a time.
SPAN = 1 << 20
LONGEST = 1000

LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
MARKS = re.escape("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
CUT = re.compile(rf" (?<=\S )(?=[{LETTERS}])")
ODD = re.compile(rf"[^{LETTERS}0-9{MARKS} \n]|[^ \n]{{{LONGEST}}}|[ \n]{{{LONGEST}}}")
#: Words of a lower-cased plain text with word ends.
WORDS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{LETTERS}]+|[0-9]|[{MARKS}]+")
ENDED = r"[^\x00]*\x00"


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it is printable, else one from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (chr(256 + i) for i in range(256))
    return [chr(b) if b in printable else next(others) for b in range(256)]


def _ranks(model: dict, added: set[int]) -> dict[bytes, int] | None:
    """Bytes of each token and its id, if merging the least id first is what the merges say."""
    vocabulary, ends = model["vocab"], model.get("end_of_word_suffix") or ""
    if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix")):
        return None
    merged = [a + b for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])]
    if ends:  # the first part of a merge never ends a word
        merged = [a.replace(ends, "") + (ends if a.endswith(ends) else "") for a in merged]
    ids = [vocabulary[token] for token in merged]
    made = set(merged)
    singles = [i for token, i in vocabulary.items() if i not in added and token not in made]
    if ids != sorted(ids) or (singles and ids and max(singles) > ids[0]):
        return None
    number = {letter: bytes([b]) for b, letter in enumerate(_byte_letters())}
    out = {}
    for token, i in vocabulary.items():
        if i in added:
            continue
        last = bool(ends) and token.endswith(ends)
        letters = token[: -len(ends)] if last else token
        if not all(c in number for c in letters):
            return None
        out[b"".join(number[c] for c in letters) + (b"\0" if last else b"")] = i
    return out


class Encoder:
    """``special``: the strings of special tokens are these tokens, as by default in the tokenizer, or else ordinary text."""

    def __init__(self, path: str, special: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        added = parts["added_tokens"]
        strings = [re.escape(t["content"]) for t in added if special or not t["special"]]
        self.added = re.compile("|".join(strings), re.IGNORECASE) if strings else None
        self.ends = bool(parts["model"].get("end_of_word_suffix"))
        before = parts["pre_tokenizer"] or {}
        known = (
            before.get("type") == "Sequence" if self.ends
            else before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and not parts["normalizer"]
        )
        ranks = _ranks(parts["model"], {t["id"] for t in added}) if known else None
        self.merger = None
        if ranks:
            pattern = ENDED if self.ends else public_tokenizers.PATTERN
            self.merger = tiktoken.Encoding("merges", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _plain(self, text: str) -> bytes:
        if self.ends:
            words = WORDS.findall(text.lower())
            if not words:
                return b""
            text = "\0".join(words) + "\0"
        return array("I", self.merger.encode_ordinary(text)).tobytes()

    def _span(self, text: str) -> bytes:
        if not ODD.search(text):
            return self._plain(text)
        out, plain = [], []
        first, *rest = CUT.split(text)
        for piece in (first, *(" " + x for x in rest)):
            if not ODD.search(piece):
                plain.append(piece)
                continue
            if plain:
                out.append(self._plain("".join(plain)))
                plain = []
            out.append(self._whole(piece))
        if plain:
            out.append(self._plain("".join(plain)))
        return b"".join(out)

    def _spans(self, text: str) -> Iterator[str]:
        """The text in spans that end at a cut, so that a long one is never split into all its pieces at once."""
        start = 0
        while len(text) - start > SPAN:
            cut = CUT.search(text, start + SPAN)
            if cut is None:
                break
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:]

    def ids(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.merger is None or (self.added and self.added.search(text)):
            return self._whole(text)
        return b"".join(map(self._span, self._spans(text)))


@functools.cache
def encoder(path: str, special: bool = True) -> Encoder:
    """One encoder for each worker process and file."""
    return Encoder(path, special)
