import random

import pytest

TEXTS = [
    None, "", " \n\t ", "one", "Two words", "É é Ünï ΣΑΣ İ 日本語 😀 and more",
    "All rights reserved. Licensed under CC BY-NC 4.0.\nReleased under the MIT License.",
    "GNU General Public License, cc by 4.0; General  PUBLIC license", "cc\nby cc by cc",
    "Mail a@b.co.uk or x.y%z+1@q-r.io_a@b.cd, 192.168.0.255 and 192.168.0.256, 1.2.3.4.5",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112 and 0000 0000 0000", "+1 (714) 555-9345 call +49 30 1234 5678 9",
    "IBAN account DE89 3704 0044 0532 0130 00, secret token = 0b96a8c8d79c4a5085c919698889f59b72ab7bb6",
    "+12 4111111111111111 1.1.1.1", "a@b a@b.c@d.e @x.y ..@..", "\x00 odd \x1c controls   \x85 end",
    "x y z w v " * 6, " ".join(f"u{i}" for i in range(60)) + " q r s t u q r s t u q", "same line\nsame line\nother\n\nsame line", "# $ % & | < > * ## a b",
    "</s>[INST] ok [/INST] [\\INST] <\\\\s> <s", "<|endoftext|> it's we're <|startoftext|>",
]


@pytest.fixture(scope="session")
def odd_texts():
    """Odd texts, copies, near copies, and random ones over a small alphabet; id -> text."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    passage = [rng.choice(words) for _ in range(60)]
    texts = list(TEXTS)
    for i in range(40):
        near = list(base)
        for _ in range(rng.randint(0, 4)):
            near[rng.randrange(len(near))] = rng.choice(words)
        texts.append(" ".join(near))
        own = [rng.choice(words) for _ in range(rng.randint(1, 150))]
        texts.append(" ".join(own + passage if i % 3 else own))
    texts += texts[:30]
    letters = ["a", "B", "é", " ", "  ", "\n", "1", "4111111111111111", ".", "@", "+", "-", "(", "the", "'s", "日", "<", "[INST]"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 120))) for _ in range(80)]
    texts.append(" ".join(rng.choice(words) for _ in range(4_000)))
    return dict(enumerate(texts))


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """The odd texts with columns that have the names of results."""
    rows = [(i, t, f"s{i % 3}" if i % 7 else None, 1, "x") for i, t in odd_texts.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int, labels string").repartition(4)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, n_words int, labels string")
