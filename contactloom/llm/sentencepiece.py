"""SentencePiece encoding and decoding: a Viterbi search over all words of a batch at once.

Words of equal length advance together, one position at a time. Hashes of all substrings that end
there are probed in the sorted hashes of the pieces; the best score of every word is a vectorised
maximum over the lengths, whose piece is the backpointer.

For a unigram model the scores are the model's. For a BPE model, neighbouring pieces must besides
be apart, that is, no merge across their border may come before the merges inside them. Exactly one
path holds this everywhere, and it is what merging gives; so the ids are the library's in both
cases. Every segmentation is compared with its word before it is used.

A text is cut into words where no piece can reach across, and words are remembered in a bounded
cache, so only new words are searched. Characters that no piece has become bytes.

Defined cases: null texts count as empty, and empty texts have no ids; repeated rows are each
returned; ids of rows may be null; an empty table gives an empty table; other columns are kept by
``encode`` and ``decode``.
"""

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactloom.llm.word_bpe import PIECE_BYTES, Remembered, groups

U = np.uint64
SPACE = "▁"
_BITS = 20  # of the table that tells most absent substrings without a search
_PAIR_BITS = 20  # of the table of pairs already compared
NEVER = 1 << 40
RUN_BYTES = 1 << 20  # text whose new words are searched together
CACHE_WORDS, CACHE_PARTS = 400_000, 200_000
PART_ROWS = 2_000  # rows of a batch whose ids are held at once


class Pieces:
    """The pieces of a model file, and which of them may be neighbours."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as format_

        model = format_.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces):
            raise ValueError(f"{path}: only models that keep texts as they are, with a space before, are read here")
        kind = format_.ModelProto.SentencePiece
        self.is_bpe = model.trainer_spec.model_type == format_.TrainerSpec.BPE
        self.n = len(model.pieces)
        self.surface = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        ids = [i for i, k in enumerate(self.kinds) if k == kind.NORMAL]
        self.unknown = next(i for i, k in enumerate(self.kinds) if k == kind.UNKNOWN)
        self.bytes = {int(self.surface[i][1:-1], 16): i for i, k in enumerate(self.kinds) if k == kind.BYTE}
        self.ids = {self.surface[i]: i for i in ids}
        scores = {i: model.pieces[i].score for i in ids}
        self.score = np.full(self.n + 1, min(scores.values()) - 10.0)
        for i, s in scores.items():
            self.score[i] = s
        self.longest = max(map(len, self.ids))
        self.pairs_inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.splits_at_space = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self._index()
        if self.is_bpe:
            self._rules()
        self.out = [b""] * (self.n + 1)
        for i, k in enumerate(self.kinds):
            if k == kind.BYTE:
                self.out[i] = bytes([int(self.surface[i][1:-1], 16)])
            elif k == kind.NORMAL:
                self.out[i] = self.surface[i].replace(SPACE, " ").encode("utf-8")
            elif k == kind.UNKNOWN:
                self.out[i] = " ⁇ ".encode()

    def _index(self) -> None:
        """Sorted hashes of all pieces; another base is taken if two pieces share one."""
        for base in range(0x9E3779B97F4A7C15, 0x9E3779B97F4A7C15 + 200, 2):
            keys = []
            for piece in self.ids:
                h = 0
                for c in piece:
                    h = (h * base + ord(c) + 1) % (1 << 64)
                keys.append(h)
            if len(set(keys)) == len(keys):
                break
        order = np.argsort(np.array(keys, U))
        self.base = U(base)
        self.keys = np.array(keys, U)[order]
        self.key_ids = np.array(list(self.ids.values()), np.int64)[order]
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[(self.keys * U(0x9E3779B97F4A7C15)) >> U(64 - _BITS)] = True
        self.powers = np.multiply.accumulate(np.r_[U(1), np.full(self.longest, self.base, U)])

    # -- which neighbours are apart, for BPE -------------------------------------------------------

    def _rules(self) -> None:
        """Merge rules as (left, right) -> rank, and the last merge inside every piece."""
        symbols, size = self.ids, self.n
        if not {c for p in self.ids for c in p} <= symbols.keys():
            raise ValueError("a piece has a character that is no piece of its own")
        by_score = sorted({-self.score[i] for i in self.ids.values()})
        place = {s: r for r, s in enumerate(by_score)}
        rank_of = {p: place[-self.score[i]] for p, i in self.ids.items()}
        self.rank = np.full(size + 1, -1, np.int64)
        self.left, self.right = np.arange(size + 1), np.arange(size + 1)
        rules = {}
        for p in self.ids:
            for i in range(1, len(p)):
                if p[:i] in symbols and p[i:] in symbols:
                    rules[symbols[p[:i]] << 32 | symbols[p[i:]]] = rank_of[p]
            if len(p) > 1:
                parts = self._last_merge(p, rank_of)
                if parts:
                    self.rank[self.ids[p]] = rank_of[p]
                    self.left[self.ids[p]], self.right[self.ids[p]] = (symbols[x] for x in parts)
        keys = np.array(sorted(rules), np.int64)
        self.rule_keys = np.r_[keys, np.int64(1) << 62]
        self.rule_ranks = np.r_[np.array([rules[k] for k in keys.tolist()], np.int64), NEVER]
        own = np.array([self.rank[i] for i in range(self.n)])
        #: pieces that merging their own characters gives back; others never come up
        self.reached = np.ones(self.n + 2, bool)
        for p, i in self.ids.items():
            self.reached[i] = len(p) == 1 or own[i] >= 0
        self.steady = bool(
            np.all((self.rank[self.left] <= self.rank)[: self.n] & (self.rank[self.right] <= self.rank)[: self.n])
        )
        self.pair_keys = np.full(1 << _PAIR_BITS, -1, np.int64)
        self.pair_apart = np.zeros(1 << _PAIR_BITS, bool)

    @staticmethod
    def _merged(parts: list[str], rank_of: dict[str, int]) -> Iterator[tuple[str, str]]:
        """Merge in place, best rule first and from the left; yields the two parts of every merge."""
        while len(parts) > 1:
            found = min(
                ((rank_of[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in rank_of),
                default=None,
            )
            if found is None:
                return
            i = found[1]
            yield parts[i], parts[i + 1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _last_merge(self, piece: str, rank_of: dict[str, int]) -> tuple[str, str] | None:
        parts, last = list(piece), None
        for last in self._merged(parts, rank_of):
            pass
        return last if len(parts) == 1 else None

    def _search_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undo the merges inside both pieces, last one first, and see what could cross the border."""
        out = np.ones(len(a), bool)
        at, limit = np.arange(len(a)), np.full(len(a), NEVER)
        while len(at):
            key = a << 32 | b
            i = np.searchsorted(self.rule_keys, key)
            crossing = np.where(self.rule_keys[i] == key, self.rule_ranks[i], NEVER) < limit
            out[at[crossing]] = False
            ra, rb = self.rank[a], self.rank[b]
            first = ra > rb
            go = ~crossing & (first | (rb >= 0))
            at, a, b, ra, rb, first = at[go], a[go], b[go], ra[go], rb[go], first[go]
            limit = np.where(first, ra, rb + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return out

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_search_apart``, with a table of earlier pairs in which a pair may take another's place."""
        key = a << 32 | b
        slot = ((key.astype(U) * U(0x9E3779B97F4A7C15)) >> U(64 - _PAIR_BITS)).astype(np.int64)
        out = self.pair_apart[slot]
        new = np.flatnonzero(self.pair_keys[slot] != key)
        if len(new):
            asked, back = np.unique(key[new], return_inverse=True)
            found = self._search_apart(asked >> 32, asked & 0xFFFFFFFF)[back]
            out[new] = found
            self.pair_keys[slot[new]], self.pair_apart[slot[new]] = key[new], found
        return out

    # -- the search -------------------------------------------------------------------------------

    def probe(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1."""
        out = np.full(len(h), -1)
        some = np.flatnonzero(self.maybe[(h * U(0x9E3779B97F4A7C15)) >> U(64 - _BITS)])
        i = np.searchsorted(self.keys, h[some])
        i[i == len(self.keys)] = 0
        hit = self.keys[i] == h[some]
        out[some[hit]] = self.key_ids[i[hit]]
        return out

    def viterbi(self, words: list[str]) -> list[list[int]]:
        """The best piece sequence of words of one length; -1 - c stands for a character c without a piece."""
        m, length = len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(m, length)
        sums = np.zeros((length + 1, m), U)
        for i in range(length):
            sums[i + 1] = sums[i] * self.base + codes[:, i] + U(1)
        best = np.full((length + 1, m), -np.inf)
        best[0] = 0
        width = np.zeros((length + 1, m), np.int32)
        piece = np.full((length + 1, m), self.n, np.int64)
        for end in range(1, length + 1):
            for size in range(1, min(self.longest, end) + 1):
                start = end - size
                found = self.probe(sums[end] - sums[start] * self.powers[size])
                if size == 1:
                    found[found < 0] = self.n
                at = np.flatnonzero((found >= 0) & (best[start] > -np.inf))
                if not len(at):
                    continue
                ids = found[at]
                if self.is_bpe:
                    fit = self.reached[ids]
                    if start:
                        fit &= self.apart(piece[start, at], ids)
                    at, ids = at[fit], ids[fit]
                score = best[start, at] + self.score[ids]
                better = score > best[end, at]
                at, ids = at[better], ids[better]
                best[end, at], width[end, at], piece[end, at] = score[better], size, ids
        return self._paths(words, codes, width, piece)

    def _paths(self, words, codes, width, piece) -> list[list[int]]:
        m, length = codes.shape
        paths: list[list[int]] = [[] for _ in range(m)]
        at, live = np.full(m, length), np.arange(m)
        while len(live):
            ends = at[live]
            ids = piece[ends, live]
            unknown = ids == self.n
            ids = np.where(unknown, -1 - codes[live, ends - 1].astype(np.int64), ids)
            for row, i in zip(live.tolist(), ids.tolist(), strict=True):
                paths[row].append(i)
            at[live] -= width[ends, live]
            live = live[at[live] > 0]
        for word, path in zip(words, paths, strict=True):
            path.reverse()
            if "".join(self.surface[i] if i >= 0 else chr(-1 - i) for i in path) != word:
                raise ValueError(f"pieces of {word!r} do not make it up")
        return paths


class Encoder:
    """Ids of texts as little-endian numbers of ``dtype``."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.dtype = np.dtype("<u2" if self.pieces.n <= 1 << 16 else "<u4")
        self.parts = Remembered(self._search, CACHE_PARTS)
        self.words = Remembered(self._cut_and_search, CACHE_WORDS)

    def _as_bytes(self, path: list[int]) -> bytes:
        out: list[int] = []
        for i in path:
            if i >= 0:
                out.append(i)
            elif self.pieces.bytes:
                out += [self.pieces.bytes[b] for b in chr(-1 - i).encode("utf-8")]
            elif not out or out[-1] != self.pieces.unknown:
                out.append(self.pieces.unknown)
        return np.array(out, self.dtype).tobytes()

    def _search(self, parts: list[str]) -> list[bytes]:
        by_length: dict[int, list[int]] = {}
        for i, part in enumerate(parts):
            by_length.setdefault(len(part), []).append(i)
        out = [b""] * len(parts)
        for length, own in by_length.items():
            step = max(1, (1 << 20) // (length + 1))  # bounds the tables of long words
            for at in range(0, len(own), step):
                rows = own[at : at + step]
                for i, path in zip(rows, self.pieces.viterbi([parts[i] for i in rows]), strict=True):
                    out[i] = self._as_bytes(path)
        return out

    def _cut(self, word: str) -> list[str]:
        """Parts between which no piece can reach."""
        inside, at, out = self.pieces.pairs_inside, 0, []
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in inside:
                out.append(word[at:i])
                at = i
        out.append(word[at:])
        return out

    def _cut_and_search(self, words: list[str]) -> list[bytes]:
        return [b"".join(ids) for ids in self.parts.of_each([self._cut(w) for w in words])]

    def encode(self, text: str) -> bytes:
        return b"".join(b"".join(self.words.of(self._words(p))) for p in self._parts(text)) if text else b""

    def _parts(self, text: str) -> Iterator[str]:
        """The text with a space before it, in parts of about PIECE_BYTES that begin with their spaces."""
        body = SPACE + text.replace(" ", SPACE)
        at = 0
        while self.pieces.splits_at_space and len(body) - at > PIECE_BYTES:
            cut = body.rfind(SPACE, at + 1, at + PIECE_BYTES)
            while cut > at and body[cut - 1] == SPACE:
                cut -= 1
            if cut <= at:
                found = re.compile(f"(?<!{SPACE}){SPACE}").search(body, at + 1)
                cut = found.start() if found else len(body)
            yield body[at:cut]
            at = cut
        yield body[at:]

    def _words(self, body: str) -> list[str]:
        if not body:
            return []
        if not self.pieces.splits_at_space:
            return [body]
        if SPACE + SPACE in body:
            return re.findall(f"{SPACE}+[^{SPACE}]*", body)
        return [SPACE + w for w in body.split(SPACE)[1:]]

    def decode(self, ids: np.ndarray) -> str:
        out = b"".join(map(self.pieces.out.__getitem__, ids.tolist()))
        return out.removeprefix(b" ").decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts of PART_ROWS rows."""
    for given in batches:
        for at in range(0, given.num_rows, PART_ROWS):
            yield given.slice(at, PART_ROWS)


def encoded(texts: list[str], own: Encoder) -> Iterator[bytes]:
    """Ids of every text; what is new in several texts is searched together."""
    for run in groups(texts, RUN_BYTES):
        if len(run) == 1:
            yield own.encode(run[0])
        else:
            words = [own._words(SPACE + t.replace(" ", SPACE)) if t else [] for t in run]
            yield from (b"".join(ids) for ids in own.words.of_each(words))


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``docs`` with the column ``ids``: array of piece ids. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for given in in_parts(batches):
            found = list(encoded([t or "" for t in given.column(text).to_pylist()], own))
            ends = np.cumsum([0, *(len(x) // own.dtype.itemsize for x in found)])
            values = np.frombuffer(b"".join(found), own.dtype).astype(np.int32)
            listed = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(values))
            kept = [n for n in given.schema.names if n != ids]
            yield pa.RecordBatch.from_arrays(
                [*(given.column(n) for n in kept), listed.cast(pa.list_(pa.int32()))], [*kept, ids]
            )

    kept = docs.drop(ids)
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(docs: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the column ``text``: the text of the ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for given in in_parts(batches):
            texts = [own.decode(np.array(x or [], np.int64)) for x in given.column(ids).to_pylist()]
            kept = [n for n in given.schema.names if n != text]
            yield pa.RecordBatch.from_arrays([*(given.column(n) for n in kept), pa.array(texts, pa.string())], [*kept, text])

    kept = docs.drop(text)
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(text, T.StringType())]))


def digests(docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id_col``, n_bytes, n_tokens, ids_crc32 (little-endian 32-bit ids) and round_trip.

    ``round_trip`` tells whether decoding the ids gives the text. Ids are made and used batch by
    batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for given in batches:
            texts = [t or "" for t in given.column(1).to_pylist()]
            sizes, crcs, same = [], [], []
            for text_, found in zip(texts, encoded(texts, own), strict=True):
                values = np.frombuffer(found, own.dtype)
                sizes.append(len(values))
                crcs.append(zlib.crc32(values.astype("<u4").tobytes()))
                same.append(own.decode(values) == text_)
            yield pa.RecordBatch.from_arrays(
                [given.column(0), pc.fill_null(pc.binary_length(given.column(1)), 0).cast(pa.int64()),
                 pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64()), pa.array(same, pa.bool_())],
                ["id", "n_bytes", "n_tokens", "ids_crc32", "round_trip"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(
        run, f"id {kind}, n_bytes long, n_tokens long, ids_crc32 long, round_trip boolean"
    ).withColumnRenamed("id", id_col)
