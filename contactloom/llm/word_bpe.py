"""Reading of a word-level BPE file: how a text is cut into words, and the merge rules.

The file's library is asked for nothing but single words; cutting and lower-casing follow the
file's own settings and are compared with the library in the tests. Words of a text are kept in
bounded caches, since most words of a text are not new.
"""

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, filterfalse

import regex

#: Bytes of text worked on at once; cuts fall on white space.
PIECE_BYTES = 1 << 20
CACHE_WORDS = 300_000


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if it prints, else the next letter from U+0100."""
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printing]
    return {b: chr(b) for b in printing} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordBpe:
    """Settings and merge rules of one file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.end = spec["model"], spec["model"]["end_of_word_suffix"]
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or not self.end or steps != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path}: only word BPE with NFC and lower-casing is read here")
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("|".join(map(re.escape, self.special)))
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        self.vocab: dict[str, int] = model["vocab"]
        size = len(self.vocab)
        self.left, self.right = list(range(size)), list(range(size))
        self.rank = [-1] * size
        self.merge_rank: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, made = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.left[made], self.right[made], self.rank[made] = x, y, rank
            self.merge_rank[x << 20 | y] = rank
        self.inner = {t: i for t, i in self.vocab.items() if not t.endswith(self.end)}
        self.final = {t.removesuffix(self.end): i for t, i in self.vocab.items() if t.endswith(self.end)}
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.path, self.assigned = path, set(map(chr, range(128)))

    @staticmethod
    def lowered(text: str) -> str:
        """Lower case code point by code point, as the file's library does."""
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)

    @staticmethod
    def composed(text: str) -> str:
        return text if text.isascii() or unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)

    def unfamiliar(self, chunk: str) -> bool:
        """Whether a code point is in no table of this Python's; the library's tables may be newer."""
        if self.assigned.issuperset(chunk):
            return False
        self.assigned.update(c for c in chunk if unicodedata.category(c) != "Cn")
        return not self.assigned.issuperset(chunk)

    def library_ids(self, chunk: str) -> list[int]:
        """The library's own ids, for unfamiliar chunks."""
        return _library(self.path).encode(chunk, add_special_tokens=False).ids

    def segments(self, chunk: str) -> Iterator[tuple[str, str]]:
        """(ordinary text, special string after it or empty) of a chunk."""
        at = 0
        for found in self.special_pattern.finditer(chunk):
            yield chunk[at : found.start()], found.group()
            at = found.end()
        yield chunk[at:], ""

    def words(self, text: str) -> list[str]:
        """The words of an ordinary text."""
        if text.isascii():
            low = text.lower()
            return [low] if low.isalpha() else self.pattern.findall(low)
        low = self.lowered(self.composed(text))
        return [low] if low.isalpha() else self.pattern.findall(low)

    def as_letters(self, word: str) -> str:
        """The word's bytes as letters."""
        return word if word.isascii() and word.isprintable() else word.encode("utf-8").decode("latin-1").translate(self.letters)


@lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def pieces(text: str, size: int = PIECE_BYTES) -> Iterator[str]:
    """Parts of about ``size``, cut after a space or line end, or not at all if there is none."""
    at = 0
    while len(text) - at > size:
        cut = max(text.rfind(" ", at, at + size), text.rfind("\n", at, at + size))
        if cut < at:
            near = [c for c in (text.find(" ", at), text.find("\n", at)) if c >= 0]
            cut = min(near, default=len(text) - 1)
        yield text[at : cut + 1]
        at = cut + 1
    if at < len(text) or not text:
        yield text[at:]


def chunks(piece: str) -> list[str]:
    """A text between spaces and line ends; joined by single spaces, it has the same length."""
    return piece.replace("\n", " ").split(" ")


def groups(texts: list[str], size: int = PIECE_BYTES) -> Iterator[list[str]]:
    """Runs of texts of about ``size`` characters together, so that new words are worked on together."""
    run, held = [], 0
    for text in texts:
        run.append(text)
        held += len(text)
        if held >= size:
            yield run
            run, held = [], 0
    if run:
        yield run


class Remembered:
    """Values of words or chunks; ``fill`` computes those of new ones, many at a time.

    Two generations of up to half of ``limit`` words each: when the younger one is full it becomes the
    older one, and what is asked for again moves back. So rare words go and frequent ones stay.
    """

    def __init__(self, fill: Callable[[list[str]], list], limit: int = CACHE_WORDS):
        self.fill, self.limit, self.known, self.older = fill, limit, {}, {}

    def learn(self, *lists: list[str]) -> None:
        """See to it that all keys are known, until the next call."""
        fresh, is_known = set(), self.known.__contains__
        # most keys are known, so they are not put into a set first
        fresh.update(filterfalse(is_known, chain.from_iterable(lists)))
        if fresh:
            if len(self.known) + len(fresh) > self.limit // 2:
                held = self.known
                self.known = {k: held[k] for k in set().union(*lists) if k in held}
                self.older = held
            # looked up one by one: a set's own intersection with a dict would walk all of the dict
            again = {k for k in fresh if k in self.older}
            self.known.update((k, self.older[k]) for k in again)
            new = list(fresh - again)
            self.known.update(zip(new, self.fill(new), strict=True))

    def of(self, keys: list[str]) -> Iterator:
        """The value of each key, in order."""
        self.learn(keys)
        return map(self.known.__getitem__, keys)

    def of_each(self, lists: list[list[str]]) -> Iterator[Iterator]:
        """The values of each list's keys; what is new in all of them is computed together."""
        self.learn(*lists)
        get = self.known.__getitem__
        return (map(get, keys) for keys in lists)
