"""Column expressions that find, format and validate phone numbers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactloom.functions.fixed_values import PHONE_PATTERNS

# Unicode white space, spelled out so that every regex engine agrees on it.
SPACE = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
DIGIT = r"\p{Nd}"
WORD = r"\p{L}\p{N}_"


def unicode_pattern(pattern: str) -> str:
    """Spell ``\\d`` and ``\\s`` out as Unicode classes (Java's own are ASCII)."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        token = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        i += len(token)
        if token in "[]":
            in_class = token == "["
        if token == r"\d":
            token = DIGIT
        elif token == r"\s":
            token = SPACE if in_class else f"[{SPACE}]"
        out.append(token)
    return "".join(out)


def _required_char(pattern: str) -> str | None:
    """A character that every match of ``pattern`` holds, as far as it is plain to see."""
    for token, char in ((r"\(", "("), (r"\+", "+"), ("[.]", "."), ("[-]", "-"), ("}-", "-")):
        if token in pattern:
            return char
    return None


PATTERNS = [unicode_pattern(p) for p in PHONE_PATTERNS]
REQUIRED_CHAR = {unicode_pattern(p): _required_char(p) for p in PHONE_PATTERNS}
# A pattern that ends in letters holds 6 or 7 digits and can never give a valid number.
LIVE_PATTERNS = [p for p in PATTERNS if "[A-Z]" not in p]

# Every pattern's match is one run of digits with at most two separators between neighbours, an
# optional leading "(" or "+", and (letter patterns only) one separator and letters at the end.
# So one linear scan for such runs finds all the text the patterns can match, and the patterns
# themselves only read the runs. Possessive quantifiers keep Java's matcher from recursing on long
# runs; each run is taken whole, so they change no match.
_RUN = rf"[(+]?{DIGIT}(?:[{SPACE}().-]{{0,2}}+{DIGIT}){{%d,}}+"
DIGIT_RUN = _RUN % 9  # 10 digits or more: enough for a valid number
DIGIT_RUN_WITH_LETTERS = _RUN % 5 + rf"(?:[{SPACE}.-][A-Z]{{3,4}})?"
_ALL = (1 << 31) - 1
RUN_GAP = "|"  # stands between runs; no pattern matches it

ZIP = rf"(?<![{WORD}]){DIGIT}{{5}}(?![{WORD}])"


def digit_runs(text: Column, letters: bool = False) -> Column:
    """The runs of ``text`` that a pattern can match, joined by ``RUN_GAP``; '' if there are none."""
    run = DIGIT_RUN_WITH_LETTERS if letters else DIGIT_RUN
    return F.array_join(F.regexp_extract_all(text, F.lit(run), F.lit(0)), RUN_GAP)


def runs_of_blocks(text: Column, mark: str) -> Column:
    """``digit_runs`` of the blocks of a text between ``mark``s, in one scan; blocks without runs are left out.

    ``RUN_GAP`` may also stand before and behind a block's runs.
    """
    found = F.array_join(F.regexp_extract_all(text, F.lit(f"{mark}|{DIGIT_RUN}"), F.lit(0)), RUN_GAP)
    return F.filter(F.split(found, mark), lambda r: F.length(r) >= 10)


def pattern_matches(runs: Column, patterns: list[str]) -> list[Column]:
    """One array of matches per pattern, in pattern order.

    A pattern whose required character does not occur is not run.
    """
    found = []
    for pattern in patterns:
        matches = F.regexp_extract_all(runs, F.lit(pattern), F.lit(0))
        char = REQUIRED_CHAR[pattern]
        if char:
            none = F.array().cast("array<string>")
            matches = F.when(runs.contains(char), matches).otherwise(none)
        found.append(matches)
    return found


def format_number(raw: Column) -> Column:
    """Drop a leading ``+91`` or one ``0``, then everything but digits and ``+``."""
    rest = F.when(raw.startswith("+91"), F.substring(raw, 4, _ALL)).when(raw.startswith("0"), F.substring(raw, 2, _ALL))
    return F.regexp_replace(rest.otherwise(raw), rf"[^{DIGIT}+]", "")


def digits_of(number: Column) -> Column:
    return F.regexp_replace(number, rf"[^{DIGIT}]", "")


def _reason_of_digits(digits: Column) -> Column:
    size = F.length(digits)
    return (
        F.when((size < 10) | (size > 12), "length")
        .when(digits.rlike(rf"^({DIGIT})\1{{6}}"), "repeat_run")
        .when(digits.contains("168"), "contains_168")
        .when(size > 11, "length_12")
        .when(digits.startswith("1790"), "prefix_1790")
    )


def reject_reason(number: Column) -> Column:
    """First rule that a formatted number breaks, null for a valid number."""
    return _reason_of_digits(digits_of(number))


def after_last_tel(href: Column) -> Column:
    return F.substring_index(href, "tel:", -1)


def valid_numbers(tel_hrefs: Column | None, blocks: Column | None, runs: Column | None = None) -> Column:
    """Distinct valid numbers in order of sighting: tel: links, then block, pattern, match.

    ``runs`` are the blocks' digit runs, where they are known already.
    """
    found = []
    if tel_hrefs is not None:
        found.append(F.transform(tel_hrefs, lambda h: after_last_tel(h)))
    if blocks is not None:
        runs = F.filter(F.transform(blocks, lambda b: digit_runs(b)), lambda r: r != "")
    if runs is not None:
        matches = F.transform(runs, lambda r: F.flatten(F.array(*pattern_matches(r, LIVE_PATTERNS))))
        found.append(F.flatten(matches))
    raw = F.array_distinct(F.concat(*found))
    numbers = F.array_distinct(F.transform(raw, lambda r: format_number(r)))
    checked = F.transform(
        numbers, lambda n: F.struct(n.alias("number"), F.replace(n, F.lit("+"), F.lit("")).alias("digits"))
    )
    return F.filter(checked, lambda x: _reason_of_digits(x.digits).isNull()).getField("number")


def zip_codes(text: Column) -> Column:
    """Distinct 5-digit tokens in order of sighting."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(ZIP), F.lit(0)))
