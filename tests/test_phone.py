import random

import pytest
from pyspark.sql import functions as F

from contactloom.functions import phone
from contactloom.functions.dialing import KEY_DIGITS, country_of_number, dial_plan, intervals
from contactloom.functions.fixed_values import PHONE_PATTERNS
from contactloom.operators import extract
from tests import model
from tests.conftest import SF


def one_column(spark, values, name="text"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def random_texts(n: int) -> list[str]:
    """Texts dense in phone-like pieces, odd spaces, other scripts' digits and long digit runs."""
    rng = random.Random(7)
    pieces = [
        "(202)", "202", "555", "0143", "+1", "1", "+", "-", ".", " ", " ", " ", "\n", "\t",
        "(", ")", "HELP", "ABC", "x", "é", "|", "0", "+91", "2025550143", "12025550143", "٤٥٦", "１２３",
        "168", "1790", "5555555", "12345", "99999-", "_", "\x1c", "\x85", "  ", "--",
    ]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 40))) for _ in range(n)]
    return texts + ["1 " * 20000, "2025550143" * 3000, "(" * 30000, "", "é12345 12345 ١٢٣٤٥ 12345_"]


@pytest.fixture(scope="module")
def texts():
    return random_texts(3000)


def test_candidates_equal_the_model(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {tuple(r) for r in extract.pattern_candidates(df, "id").collect()}
    want = {(i, *c) for i, t in enumerate(texts) for c in model.candidates(t)}
    assert got == want


def test_numbers_and_zips_equal_the_model(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r.numbers for r in extract.numbers_of_texts(df, "id").collect()}
    want = {i: model.numbers(t) for i, t in enumerate(texts)}
    assert got == {i: n for i, n in want.items() if n}
    zips = df.select("id", phone.zip_codes(F.col("text")).alias("zips")).collect()
    assert {r.id: r.zips for r in zips} == {i: model.zips(t) for i, t in enumerate(texts)}


def test_documents_equal_the_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.numbers for r in extract.numbers_of_texts(docs, "doc_id").collect()}
    want = {r.doc_id: model.numbers(r.text) for r in docs.collect()}
    assert got and got == {i: n for i, n in want.items() if n}


@pytest.mark.parametrize("ordinal", range(18, 29))
def test_letter_patterns_never_give_a_valid_number(spark, ordinal):
    text = "+1 800-555-HELP 800.555.HELP (800)-555-HELP (800)555-HELP 800 555 ABC 800 555-HELP " \
           "(800) 555-HELP 1-800-555-HELP 1 800.555.HELP 1 800-555-HELP"
    assert "[A-Z]" in PHONE_PATTERNS[ordinal - 1]
    rows = extract.pattern_candidates(one_column(spark, [text])).transform(
        extract.format_candidates
    ).transform(extract.check_candidates).filter(F.col("pattern_ord") == ordinal).collect()
    assert rows and not any(r.valid for r in rows)


@pytest.mark.parametrize(
    "raw, number, reason",
    [
        ("+91 98765 43210", "9876543210", None),
        ("0123456789", "123456789", "length"),
        ("123456789", "123456789", "length"),
        ("2025550143", "2025550143", None),
        ("12025550143", "12025550143", None),
        ("120255501434", "120255501434", "length_12"),
        ("1202555014345", "1202555014345", "length"),
        ("5555555123", "5555555123", "repeat_run"),
        ("1235555555", "1235555555", None),
        ("2021685555", "2021685555", "contains_168"),
        ("17905551234", "17905551234", "prefix_1790"),
        ("+1 (202) 555-0143", "+12025550143", None),
        ("(202) 555-0143", "2025550143", None),
        ("555555512345", "555555512345", "repeat_run"),
        ("168555512345", "168555512345", "contains_168"),
    ],
)
def test_format_and_validity(spark, raw, number, reason):
    row = one_column(spark, [raw], "raw").transform(extract.format_candidates).transform(
        extract.check_candidates
    ).first()
    assert (row.number, row.valid, row.reason) == (number, reason is None, reason)
    assert (model.clean(raw), model.reason(number)) == (number, reason)


def test_rejection_breakdown_counts_every_candidate(spark):
    raw = ["2025550143", "2021685555", "123", "456", "17905551234"]
    checked = one_column(spark, raw, "raw").transform(extract.format_candidates).transform(
        extract.check_candidates
    )
    got = {r.reason: r.n for r in extract.rejection_breakdown(checked).collect()}
    assert got == {"valid": 1, "contains_168": 1, "length": 2, "prefix_1790": 1}


@pytest.mark.parametrize(
    "number, country",
    [
        ("2025550143", "US"), ("12025550143", "US"), ("+12025550143", "US"), ("4165550143", "CA"),
        ("+14165550143", "CA"), ("8765550143", "JM"), ("8005550143", "US"), ("2115550143", None),
        ("3715550143", None), ("1025550143", None), ("2020550143", None), ("22025550143", None),
        ("+6565550123", "SG"), ("+35312345678", "IE"), ("+49301234567", "DE"), ("+2105550143", None),
        ("+1+2025550143", None), ("+77012345678", "KZ"), ("+76012345678", "KZ"), ("+79161234567", "RU"),
        ("+5997175000", "BQ"), ("+5999175000", "CW"), ("+37866661212", "SM"), ("+358181234567", "AX"),
        ("+358401234567", "FI"), ("+4779123456", "SJ"), ("+61891621234", "CC"), ("+61891641234", "CX"),
        ("+61291641234", "AU"), ("2005550100", None), ("5555550100", None), ("8885550100", "US"),
        ("+49123", None), ("+491234567890123456", None),
        # codes without an area: Canadian, personal, premium
        ("6005551234", "CA"), ("6225551234", "CA"), ("5005551234", "US"), ("5335551234", "US"), ("9005551234", "US"),
        ("+15225551234", "US"), ("18665551234", "US"),
        # area codes that are not in service, or only planned
        ("2325551234", None), ("2305551234", None), ("2225551234", None), ("8895551234", None), ("9995551234", None),
        ("9765551234", None), ("2015551234", "US"), ("2045551234", "CA"), ("9895551234", "US"), ("9900551234", None),
        ("2021551234", None), ("9111234567", None),
        # national lengths and first digits
        ("+441234567", None), ("+44123456789", "GB"), ("+442071234567", "GB"), ("+33123456789", "FR"), ("+3312345678", None),
        ("+34912345678", "ES"), ("+34112345678", None), ("+6512345678", None), ("+6591234567", "SG"), ("+390612345678", "IT"),
        ("+390669812345", "VA"), ("+441481123456", "GG"), ("+441534123456", "JE"), ("+441624123456", "IM"), ("+262269123456", "YT"),
        ("+99912345678", None), ("+88212345678", None), ("+0123456789", None), ("+12025550143123", None), ("", None), ("+", None),
    ],
)
def test_country_of_number(spark, number, country):
    df = one_column(spark, [number], "n").select(country_of_number(F.col("n")).alias("c"))
    assert df.first().c == country


def test_own_dial_plan_and_longest_prefix(spark):
    df = one_column(spark, ["2025550143", "2125550143", "+4412345678"], "n")
    plan = {"1": "US", "1212": "NY", "12125": "NYC"}
    assert [r[0] for r in df.select(country_of_number(F.col("n"), plan)).collect()] == ["US", "NYC", None]
    assert [r[0] for r in df.select(country_of_number(F.col("n"), {})).collect()] == [None] * 3


def test_intervals_are_sorted_and_the_longest_prefix_wins():
    plan = dial_plan()
    table = intervals(plan)
    assert all(a[0] <= a[1] < b[0] for a, b in zip(table, table[1:]))
    rng = random.Random(2)
    places = [p + d for a in table for p in a[:2] for d in (-1, 0, 1)] + [rng.randrange(10**KEY_DIGITS) for _ in range(2000)]
    for place in places:
        digits = str(place).zfill(KEY_DIGITS)
        fitting = [r for r in plan if r.low <= digits[: len(r.low)] <= r.high]
        want = max(fitting, key=lambda r: (len(r.low), int(r.low) - int(r.high))).country if fitting else None
        assert next((c for low, high, c, *_ in table if low <= place <= high), None) == want


def test_area_codes_are_listed_once():
    from contactloom.functions.dialing import NORTH_AMERICA, US_AREAS, US_SERVICES, _numbers

    listed = [n for areas in (US_AREAS, US_SERVICES, *NORTH_AMERICA.values()) for n in _numbers(areas)]
    assert len(listed) == len(set(listed))
    assert all(200 <= n <= 999 and n // 10 % 10 != 9 and n % 100 != 11 for n in listed)
