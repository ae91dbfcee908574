"""Exact token counts of texts and of all their prefixes, by dynamic programming over prefixes.

A sequence of BPE tokens is what the merge rules make of its letters exactly if every two
neighbours are: no rule that comes before the rules inside them joins them. So each prefix of a
word has one last token that fits to the last token of what stands before it, and its count is one
more than the count there. The table of a word's prefixes is filled once; words that begin alike
share it. Counts at the ends of words add up over the text, so truncation and budgets are answered
by looking up, and no text is encoded.

Defined cases: a null text counts as empty and has no tokens; repeated rows are each returned;
ids may be null; an empty table gives an empty table; other columns are ignored. Strings of special
tokens inside a text count as one token each, as the library's default has it. Words with code
points that Python's tables don't know yet are given to the library. Prefixes are
prefixes in code points of the text's NFC form (the text itself, nearly always).
"""

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, pairwise

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.llm.word_bpe import Remembered, WordBpe, chunks, groups, pieces, word_bpe


RUN_BYTES = 1 << 22  # text whose new words are counted together
KNOWN_PAIRS = 1 << 18  # neighbours whose verdicts are kept
KNOWN_STEPS = 1 << 17  # steps from letter to letter that are kept


def endings(tokens: dict[str, int]) -> dict[str, int]:
    """Every ending of a token, itself included -> the token it is, -1 if it is none."""
    found = {text[at:]: -1 for text in tokens for at in range(len(text))}
    return found | {text: token for text, token in tokens.items() if text}


class PrefixCounter:
    def __init__(self, bpe: WordBpe):
        self.bpe = bpe
        self.inner, self.final = endings(bpe.inner), endings(bpe.final)
        self.beginnings = {text[:end] for text in bpe.inner for end in range(len(text) + 1)}
        self.steps: dict[str, tuple[str, list[tuple[int, int]]]] = {}
        self.pairs: dict[int, bool] = {}
        self.word_counts = Remembered(self._count_words)
        self.chunk_counts = Remembered(self._count_chunks)

    def apart(self, a: int, b: int) -> bool:
        """Whether the rules leave token a before token b as they are.

        The rules inside the two are undone, last one first; if what then stands at the border
        could have been joined by an earlier rule, it would have been.
        """
        rank, rules, limit = self.bpe.rank, self.bpe.merge_rank, 1 << 60
        while True:
            joined = rules.get(a << 20 | b)
            if joined is not None and joined < limit:
                return False
            if rank[a] > rank[b]:
                limit, a = rank[a], self.bpe.right[a]
            elif rank[b] < 0:
                return True
            else:  # rules of one rank work from the left, so the border's would come first
                limit, b = rank[b] + 1, self.bpe.left[b]

    def _known_apart(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= KNOWN_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.apart(a, b)
        return known

    def _last(self, word: str, end: int, tokens: dict[str, int], last: list[int], counts: list[int]):
        """(token, count) of the prefix word[:end]; ``tokens`` are ``endings``, so looking stops where no token goes on."""
        fitting = []
        for start in range(end - 1, -1, -1):
            token = tokens.get(word[start:end])
            if token is None:
                break
            if token >= 0:
                fitting.append((start, token))
        for start, token in reversed(fitting):
            if start == 0 or self._known_apart(last[start], token):
                return token, counts[start] + 1
        raise ValueError(f"no token ends {word[:end]!r}")

    def _step(self, text: str) -> tuple[str, list[tuple[int, int]]]:
        """(longest ending of ``text`` that a token begins with, (length, token) of its endings that are inner tokens).

        The longest token comes first. Every token that a prefix of a word ends with ends this ending too, so a
        prefix's tokens are known from the ending of the prefix before it and one more letter.
        """
        ending = next(text[at:] for at in range(len(text) + 1) if text[at:] in self.beginnings)
        tokens = ((len(ending) - at, self.bpe.inner.get(ending[at:], -1)) for at in range(len(ending)))
        if len(self.steps) >= KNOWN_STEPS:
            self.steps.clear()
        known = self.steps[text] = ending, [(size, token) for size, token in tokens if token >= 0]
        return known

    def _count_words(self, words: list[str]) -> list[int]:
        """Token counts of words, in the given order; worked on in alphabetical order."""
        found, before = {}, ""
        steps, pairs = self.steps, self.pairs
        last, counts, ended = [-1], [0], [""]  # of each prefix inside the word
        for word in sorted(words):
            letters = self.bpe.as_letters(word)
            if self.final.get(letters, -1) >= 0:
                found[word] = 1
                continue
            same, most = 0, min(len(before), len(letters), len(last) - 1)
            while same < most and before[same] == letters[same]:
                same += 1
            del last[same + 1 :], counts[same + 1 :], ended[same + 1 :]
            ending = ended[same]
            for end in range(same + 1, len(letters)):
                text = ending + letters[end - 1]
                ending, fitting = steps.get(text) or self._step(text)
                for size, token in fitting:
                    start = end - size
                    if start:
                        known = pairs.get(last[start] << 20 | token)
                        if not (self._known_apart(last[start], token) if known is None else known):
                            continue
                    last.append(token)
                    counts.append(counts[start] + 1)
                    ended.append(ending)
                    break
                else:
                    raise ValueError(f"no token ends {letters[:end]!r}")
            found[word] = self._last(letters, len(letters), self.final, last, counts)[1]
            before = letters
        return [found[w] for w in words]

    def word_prefix_counts(self, word: str) -> list[int]:
        """Token counts of each prefix of a word, in code points, the prefix being a word of its own."""
        letters = self.bpe.as_letters(word)
        last, counts, whole = [-1], [0], []
        for end in range(1, len(letters) + 1):
            whole.append(self._last(letters, end, self.final, last, counts)[1])
            token, count = self._last(letters, end, self.inner, last, counts)
            last.append(token)
            counts.append(count)
        ends = accumulate(len(c.encode("utf-8")) for c in word)
        return [whole[e - 1] for e in ends]

    def _count_chunks(self, new: list[str]) -> list[int]:
        bpe, words, totals, ends = self.bpe, [], [0] * len(new), [0]
        for i, chunk in enumerate(new):
            if chunk.isascii() and chunk.isalpha():
                words.append(chunk.lower())
            elif bpe.unfamiliar(chunk):
                totals[i] = len(bpe.library_ids(chunk))
            elif "<|" in chunk:
                parts = list(bpe.segments(chunk))
                totals[i] = sum(1 for _, special in parts if special)
                words += [w for text, _ in parts for w in bpe.words(text)]
            else:
                words += bpe.words(chunk)
            ends.append(len(words))
        before = list(accumulate(self.word_counts.of(words), initial=0))
        return [n + before[end] - before[start] for n, (start, end) in zip(totals, pairwise(ends), strict=True)]

    def count(self, text: str) -> int:
        return sum(sum(self.chunk_counts.of(chunks(p))) for p in pieces(text))

    def count_all(self, texts: list[str]) -> Iterator[int]:
        """Counts of every text; what is new in several texts is counted together."""
        for run in groups(texts, RUN_BYTES):
            if len(run) == 1:
                yield self.count(run[0])
            else:
                yield from map(sum, self.chunk_counts.of_each([chunks(t) for t in run]))

    def _plain_prefix_counts(self, text: str) -> list[int]:
        """Counts of the prefixes of an ordinary chunk, in code points."""
        lowered, wide = self.bpe.lowered(text), None
        if len(lowered) != len(text):
            wide = list(accumulate(len(c.lower()) for c in text))
        out, base, at = [0] * len(lowered), 0, 0
        for found in self.bpe.pattern.finditer(lowered):
            word = found.group()
            out[at : found.start()] = [base] * (found.start() - at)
            inside = self.word_prefix_counts(word)
            if word[0] == "'" and len(word) == 3 and word[1:].isalpha():
                # cut short, the mark and the letter after it are words of their own
                inside[1] = inside[0] + self.word_prefix_counts(word[1])[0]
            out[found.start() : found.end()] = [base + c for c in inside]
            base, at = base + inside[-1], found.end()
        out[at:] = [base] * (len(lowered) - at)
        return out if wide is None else [out[e - 1] for e in wide]

    def chunk_prefix_counts(self, chunk: str) -> list[int]:
        """Counts of the prefixes of a chunk in NFC, in code points."""
        if self.bpe.unfamiliar(chunk):
            return [len(self.bpe.library_ids(chunk[: i + 1])) for i in range(len(chunk))]
        out: list[int] = []
        base = 0
        for text, special in self.bpe.segments(chunk):
            # cut short, a special string is ordinary text
            counts = self._plain_prefix_counts(text + special)
            out += [base + c for c in counts]
            if special:
                base += (counts[len(text) - 1] if text else 0) + 1
                out[-1] = base
        return out

    def prefix_counts(self, text: str) -> list[int]:
        """Counts of all prefixes of the text's NFC form, the empty prefix left out."""
        out: list[int] = []
        base = 0
        for i, chunk in enumerate(chunks(self.bpe.composed(text))):
            if i:
                out.append(base)  # the space before it
            inside = self.chunk_prefix_counts(chunk)
            out += [base + c for c in inside]
            base += inside[-1] if inside else 0
        return out

    def fitting(self, text: str, budget: int) -> int:
        """Code points of the longest prefix of the text's NFC form with at most ``budget`` tokens."""
        base = at = 0
        for piece in pieces(self.bpe.composed(text), max(4 * budget, 1)):  # a long text is read as far as it fits
            own = chunks(piece)
            counts = list(self.chunk_counts.of(own))
            if base + sum(counts) <= budget:
                base, at = base + sum(counts), at + len(piece)
                continue
            for chunk, count in zip(own, counts, strict=True):
                if base + count > budget:
                    inside = self.chunk_prefix_counts(chunk)
                    best = max((i + 1 for i, c in enumerate(inside) if base + c <= budget), default=0)
                    return at + best
                base, at = base + count, at + len(chunk) + 1
        return at


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(word_bpe(path))


def _counted(batches: Iterator[pa.RecordBatch], path: str, limit: int, prefixes: bool) -> Iterator[pa.RecordBatch]:
    """Counts in batches; the rows of a task are worked on as they come."""
    own = counter(path)
    for given in batches:
        texts = given.column(1)
        bytes_ = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
        bodies = [t or "" for t in texts.to_pylist()]
        counts = list(own.count_all(bodies))
        fits = [
            own.fitting(body, limit) if n > limit else len(own.bpe.composed(body))
            for body, n in zip(bodies, counts, strict=True)
        ]
        tables = [own.prefix_counts(body) for body in bodies] if prefixes else []
        columns = [given.column(0), bytes_, pa.array(counts, pa.int64()), pa.array(fits, pa.int64())]
        names = ["id", "n_bytes", "n_tokens", "limit_chars"]
        if prefixes:
            columns.append(pa.array(tables, pa.list_(pa.int32())))
            names.append("prefix_tokens")
        yield pa.RecordBatch.from_arrays(columns, names)


def token_counts(
    docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id", limit: int = 2048,
    prefixes: bool = False,
) -> DataFrame:
    """``id_col``, n_bytes, n_tokens, over_limit, limit_chars; with ``prefixes``, also prefix_tokens.

    ``limit_chars`` is the length of the longest prefix with at most ``limit`` tokens.
    ``prefix_tokens[i]`` is the count of the first ``i + 1`` code points. Nothing is shuffled.
    """
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    fields = f"id {kind}, n_bytes long, n_tokens long, limit_chars long" + ", prefix_tokens array<int>" * prefixes
    counted = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(
        lambda batches: _counted(batches, path, limit, prefixes), fields
    )
    more = ["prefix_tokens"] if prefixes else []
    return counted.select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"),
        "limit_chars", *more,
    )
