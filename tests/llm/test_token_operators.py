"""Token counts, SentencePiece, token files: against the libraries, and by round trip."""

import random
import zlib

import numpy as np
import pytest

from contactloom.llm import sentencepiece, token_counts, token_files, word_bpe
from contactloom.llm.queries import tokenizer_file

WORDS, PIECES = tokenizer_file("word_bpe_49k.json"), tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def odd_strings(n=150):
    rng = random.Random(3)
    letters = "abst 'reldm<|>!?é日́İ0 1\n\tΣẞ "
    return ["".join(rng.choice(letters) for _ in range(50)) for _ in range(n)] + [
        "", " ", "\n", "it's we're 'r 're 'rest ''s !!'re they'll'x 'LL", "a<|endoftext|>b<|endof <|startoftext|>", "!!<|endoftext|>!!",
    ]


def test_counts(odd_docs, odd_texts, library):
    got = {r["doc_id"]: r for r in token_counts.token_counts(odd_docs, WORDS, limit=40).collect()}
    assert got.keys() == odd_texts.keys()
    for i, text in odd_texts.items():
        n = len(ids(library, text))
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((text or "").encode()), n, n > 40)


def test_every_prefix(library):
    own = token_counts.counter(WORDS)
    for text in odd_strings():
        body = own.bpe.composed(text)
        want = [len(ids(library, body[: i + 1])) for i in range(len(body))]
        assert own.prefix_counts(text) == want
        for budget in (0, 1, 7):
            fits = max((i + 1 for i, n in enumerate(want) if n <= budget), default=0)
            assert own.fitting(text, budget) == fits or len(ids(library, text)) <= budget


def test_every_code_point(library):
    own = token_counts.PrefixCounter(word_bpe.word_bpe(WORDS))
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4096):
        text = " ".join(f"a{chr(c)}1" for c in points[at : at + 4096])
        assert own.count(text) == len(ids(library, text)), hex(points[at])


def test_prefix_column(spark, library):
    docs = spark.createDataFrame([(None, "some words, cut"), (1, None), (1, None)], "doc_id long, text string")
    rows = token_counts.token_counts(docs, WORDS, prefixes=True).collect()
    assert [r["prefix_tokens"] for r in rows if r["doc_id"] is None] == [
        [len(ids(library, "some words, cut"[: i + 1])) for i in range(15)]
    ]
    assert [r["prefix_tokens"] for r in rows if r["doc_id"] == 1] == [[], []]
    assert token_counts.token_counts(docs.filter("doc_id > 9"), WORDS).collect() == []


def test_small_caches(library, odd_texts, monkeypatch):
    own = token_counts.PrefixCounter(word_bpe.word_bpe(WORDS))
    own.word_counts.limit = own.chunk_counts.limit = 5
    monkeypatch.setattr(word_bpe, "PIECE_BYTES", 100)
    for text in list(odd_texts.values())[:40]:
        assert own.count(text or "") == len(ids(library, text))


# --- SentencePiece ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece as library

    return library.SentencePieceProcessor(model_file=PIECES)


def own_ids(own, text):
    return np.frombuffer(own.encode(text), own.dtype).tolist()


def test_encode_and_decode(odd_docs, odd_texts, pieces):
    made = sentencepiece.encode(odd_docs, PIECES)
    assert made.columns == [*odd_docs.columns, "token_ids"]
    back = sentencepiece.decode(made, PIECES).collect()
    assert len(back) == len(odd_texts)
    for r in back:
        assert r["token_ids"] == pieces.encode(r["text"] or "") and r["decoded"] == (r["text"] or "")


def test_pieces_at_odds(pieces, monkeypatch):
    rng = random.Random(7)
    parts = ["a", "the", "in", " ", "  ", "    ", "\n", "\t", "▁", "é", "日", "1", "23", "(", "):", "return", "    if", "😀", "==", "__", "\x00"]
    own = sentencepiece.encoder(PIECES)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(600)]
    assert [own_ids(own, t) for t in texts] == [pieces.encode(t) for t in texts]
    monkeypatch.setattr(sentencepiece, "PIECE_BYTES", 50)
    assert [own_ids(own, t) for t in texts[:100]] == [pieces.encode(t) for t in texts[:100]]
    assert own_ids(own, "x" * 3000) == pieces.encode("x" * 3000)


def test_unigram_scores(tmp_path):
    """The same pieces as a unigram model: the search then maximises the scores."""
    import sentencepiece as library
    from sentencepiece import sentencepiece_model_pb2 as format_

    model = format_.ModelProto()
    with open(PIECES, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = format_.TrainerSpec.UNIGRAM
    for i, p in enumerate(model.pieces):
        p.score = -1.0 - (i * 7919 % 10_007) / 1000  # no ties to speak of
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    theirs = library.SentencePieceProcessor(model_file=str(path))
    own = sentencepiece.Encoder(str(path))
    score = [p.score for p in model.pieces]
    for text in ("the quick brown fox jumps", "internationalization of things", "a bc def"):
        mine, want = own_ids(own, text), theirs.encode(text)
        assert sum(score[i] for i in mine) == pytest.approx(sum(score[i] for i in want))


def test_sentencepiece_edges(spark, pieces):
    docs = spark.createDataFrame([(None, None), (2, ""), (2, "")], "doc_id long, text string")
    rows = sentencepiece.digests(docs, PIECES).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["round_trip"]) for r in rows) == [(0, 0, True), (2, 0, True), (2, 0, True)]
    assert sentencepiece.encode(docs.filter("doc_id > 9"), PIECES).collect() == []


# --- token files --------------------------------------------------------------------------------


def test_token_files(odd_docs, odd_texts, library, spark):
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.token_files(odd_docs, WORDS, shard_bytes=5_000).collect()}
    start, want = 0, {}
    for i in sorted(odd_texts):
        own = [*ids(library, odd_texts[i]), 2]
        want[i] = start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())
        start += len(own)
    assert got == want


def test_token_files_are_flat(spark, library, tmp_path):
    docs = spark.createDataFrame([(5, "five"), (None, "null two"), (5, "a five"), (-3, None), (900, "far away")], "doc_id long, text string")
    folder = f"file://{tmp_path}/out"
    manifest = token_files.write_token_files(docs, WORDS, folder, dtype="uint32", shard_bytes=10)
    flat = np.concatenate([token_files.mapped(folder, f"tokens-{r['shard']:08d}.bin", "<u4") for r in manifest.orderBy("shard").collect()])
    want = [t for text in ("null two", None, "a five", "five", "far away") for t in [*ids(library, text), 2]]
    assert flat.tolist() == want
    rows = token_files.read_token_files(manifest, folder, "uint32").orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, -3, 5, 5, 900]
    assert not [p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("_temporary") and not p.name.endswith("-docs")]


def test_token_files_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.token_files(docs, WORDS).collect() == []


def test_the_last_token_is_looked_for_among_endings_of_tokens():
    """Looking stops at the first text that ends no token, however long the longest token is."""
    from contactloom.llm.token_counts import endings

    found = endings({"abc": 5, "c": 0, "": 9})
    assert found == {"abc": 5, "bc": -1, "c": 0}


def test_long_and_short_words_count_as_the_library_does(library):
    """Words that begin alike, one behind the other."""
    import public_tokenizers

    from contactloom.llm.token_counts import PrefixCounter
    from contactloom.llm.word_bpe import word_bpe

    own = PrefixCounter(word_bpe(public_tokenizers.path("word_bpe_49k.json")))
    stem = "aershlyatthinonan" * 20
    words = [stem[:n] + end for n in (5, 9, 199, 260) for end in ("", "eauxq", "zz", "7")]
    assert list(own.count_all([*words, " ".join(words)])) == [
        len(library.encode(t, add_special_tokens=False).ids) for t in [*words, " ".join(words)]
    ]


def test_the_older_generation_is_looked_up_not_walked():
    """A walk over it for every few new words was most of the time of counting."""
    from contactloom.llm.word_bpe import Remembered

    class Unwalked(dict):
        def __iter__(self):
            raise AssertionError("walked")

        keys = items = values = __iter__

    asked = []
    kept = Remembered(lambda keys: asked.append(sorted(keys)) or [len(k) for k in keys])
    kept.older = Unwalked(a=1, bb=2)
    assert list(kept.of(["bb", "ccc", "a"])) == [2, 3, 1] and asked == [["ccc"]]


def _largest_call(memory, monkeypatch):
    """Characters of the largest call of a memory's ``learn`` so far."""
    most, learn = [0], memory.learn

    def counted(*lists):
        most[0] = max(most[0], sum(len(k) for keys in lists for k in keys))
        learn(*lists)

    monkeypatch.setattr(memory, "learn", counted)
    return most


def test_token_files_work_on_short_runs(monkeypatch):
    """Texts whose words are looked up together stay small."""
    own = token_files.Encoder(WORDS, "uint16")
    most = _largest_call(own.chunks, monkeypatch)
    text = " ".join(f"Word{i % 500} its plain, words" for i in range(400))
    assert len(set(own.encode_all([text] * 100))) == 1
    assert 0 < most[0] <= 1 << 18


def test_sentencepiece_holds_little(monkeypatch):
    """A worker's memory: short runs, and at most 600,000 remembered words and parts."""
    own = sentencepiece.Encoder(PIECES)
    most = _largest_call(own.words, monkeypatch)
    text = " ".join(f"word{i % 500} its plain, words" for i in range(4000))
    assert len(set(sentencepiece.encoded([text] * 40, own))) == 1
    assert 0 < most[0] <= 1 << 21
    assert own.words.limit + own.parts.limit <= 600_000


def test_a_long_text_is_read_as_far_as_it_fits(library):
    own = token_counts.PrefixCounter(word_bpe.word_bpe(WORDS))
    text = " ".join(f"word{i}\n" for i in range(20_000))
    end = own.fitting(text, 50)
    assert len(own.chunk_counts.known) < 500
    assert len(ids(library, text[:end])) == 50 < len(ids(library, text[: end + 1]))


def test_steps_from_letter_to_letter_are_kept(library, monkeypatch):
    monkeypatch.setattr(token_counts, "KNOWN_STEPS", 5)
    own = token_counts.PrefixCounter(word_bpe.word_bpe(WORDS))
    for text in ["unbelievably unbelieving antidisestablishment", "zzqxj 日本語 éé 'tis it's", "", "a"]:
        assert own.count(text) == len(ids(library, text))
    assert 0 < len(own.steps) <= 5
