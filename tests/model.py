"""Plain Python statement of the extraction rules, written for the tests only."""

import re

from contactloom.functions.fixed_values import PHONE_PATTERNS


def clean(raw: str) -> str:
    if raw.startswith("+91"):
        raw = raw[3:]
    elif raw.startswith("0"):
        raw = raw[1:]
    return "".join(c for c in raw if c == "+" or c.isdecimal())


def reason(number: str) -> str | None:
    digits = number.replace("+", "")
    if not 10 <= len(digits) <= 12:
        return "length"
    if len(set(digits[:7])) == 1:
        return "repeat_run"
    if "168" in digits:
        return "contains_168"
    if len(digits) == 12:
        return "length_12"
    return "prefix_1790" if digits.startswith("1790") else None


def candidates(text: str) -> list[tuple[int, int, str]]:
    return [
        (p, m, raw)
        for p, pattern in enumerate(PHONE_PATTERNS, 1)
        for m, raw in enumerate(re.findall(pattern, text))
    ]


def numbers(text: str) -> list[str]:
    found = dict.fromkeys(clean(raw) for _, _, raw in candidates(text))
    return [n for n in found if reason(n) is None]


def zips(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\b\d{5}\b", text)))
