"""Country of a phone number by the public numbering plans, as intervals of E.164 digits.

A plan is a list of ranges of leading digits, each with its country and the lengths its numbers have.
Where ranges overlap the longer prefix wins, then the narrower range. Flattened, they are one sorted table of intervals that
do not overlap, over the first ``KEY_DIGITS`` digits; a number is looked up by a binary search in
constant arrays, in the row, without a join. Which blocks inside a range are handed out is not modelled;
a caller with a finer plan passes their own.
"""

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactloom.functions.intervals import interval_of

#: No range is told by more digits than that.
KEY_DIGITS = 7
ANY_LENGTH = 8, 15

# --- fixed values: area codes in service in the United States (ranges of codes) ------------------
US_AREAS = """
201-203 205-210 212-220 223-225 227-229 231 234-235 239-240 248 251-254 256 260 262 267 269-270 272 274 276
279 281 283 301-305 307-310 312-321 323-327 329-332 334 336-337 339 341 346-347 350-353 357 360-361 363-364
369 380 385-386 401-402 404-410 412-415 417 419 423-425 430 432 434-436 440 442-443 445 447-448 457-458
463-464 469-472 475 478-480 483-484 501-505 507-510 512-513 515-518 520 530-531 534 539-541 551 557 559
561-564 567 570-575 580 582 585-586 601-603 605-610 612 614-621 623-624 626 628-631 636 640-641 645-646
650-651 656-657 659-662 667 669 678-682 686 689 701-704 706-708 712-720 724-732 734 737-738 740 743
747-748 754 757 760 762-763 765 769-775 779 781 785-786 801-806 808 810 812-818 820-821 826 828 830-832
835 837-840 843 845 847-848 850 854 856-865 870 872 878 901 903-904 906-910 912-920 924-925 928-931 934
936-938 940-941 943 945 947-949 951-952 954 956 959 970-973 975 978-980 983-986 989
"""
# --- fixed values: codes without an area, kept by the United States: free-phone, personal, premium ---
US_SERVICES = "800 833 844 855 866 877 888 500 521-529 533 544 566 577 588 900"

# --- fixed values: North American area codes outside the United States --------------------------
NORTH_AMERICA = {
    "CA": "204 226 236 249 250 257 263 289 306 343 354 365 367 368 382 387 403 416 418 428 431 437 "
          "438 450 460 468 474 506 514 519 548 579 581 584 587 600 604 613 622 639 647 672 683 705 "
          "709 742 753 778 780 782 807 819 825 867 873 879 902 905 942",
    "BS": "242", "BB": "246", "AI": "264", "AG": "268", "VG": "284", "VI": "340", "KY": "345",
    "BM": "441", "GD": "473", "TC": "649", "MS": "664", "MP": "670", "GU": "671", "AS": "684",
    "SX": "721", "LC": "758", "DM": "767", "VC": "784", "PR": "787 939", "DO": "809 829 849",
    "TT": "868", "KN": "869", "JM": "658 876",
}

# --- fixed values: E.164 country codes, main country of each, lengths of national numbers, and their
# first digits where these are not 1 to 9
COUNTRY_CODES = """
7 RU 10 3-9, 20 EG 8-10, 27 ZA 9, 30 GR 10 2-9, 31 NL 9, 32 BE 8-9, 33 FR 9, 34 ES 9 5-9, 36 HU 8-9,
39 IT 6-11 0-9, 40 RO 9 2-9, 41 CH 9 2-9, 43 AT 7-13, 44 GB 9-10, 45 DK 8 2-9, 46 SE 7-10, 47 NO 8 2-9,
48 PL 9, 49 DE 6-13, 51 PE 8-9, 52 MX 10, 53 CU 8, 54 AR 10-11, 55 BR 10-11, 56 CL 9, 57 CO 8-10, 58 VE 10 2-9,
60 MY 8-10, 61 AU 9, 62 ID 8-12, 63 PH 8-10, 64 NZ 8-10 2-9, 65 SG 8 3-9, 66 TH 8-9, 81 JP 9-10, 82 KR 8-10,
84 VN 9-10, 86 CN 9-11, 90 TR 10 2-9, 91 IN 10, 92 PK 9-10 2-9, 93 AF 9 2-7, 94 LK 9, 95 MM 7-10, 98 IR 10,
211 SS 9, 212 MA 9 5-8, 213 DZ 8-9, 216 TN 8 2-9, 218 LY 9 2-9, 220 GM 7 2-9, 221 SN 9 3-9, 222 MR 8 2-8,
223 ML 8 2-9, 224 GN 8-9 3-7, 225 CI 10 0-2, 226 BF 8, 227 NE 8, 228 TG 8 2-9, 229 BJ 8-10 0-9, 230 MU 7-8 2-9,
231 LR 7-9 2-8, 232 SL 8 2-9, 233 GH 9 2-5, 234 NG 8-10, 235 TD 8 2-9, 236 CF 8 2-8, 237 CM 9 2-8, 238 CV 7 2-9,
239 ST 7 2-9, 240 GQ 9 2-9, 241 GA 7-8 0-9, 242 CG 9 0-9, 243 CD 7-9, 244 AO 9 2-9, 245 GW 9 4-9, 246 IO 7 3,
247 AC 5-6, 248 SC 7 2-8, 249 SD 9, 250 RW 9 2-9, 251 ET 9, 252 SO 7-9, 253 DJ 8 2-7, 254 KE 9-10, 255 TZ 9 2-9,
256 UG 9 2-9, 257 BI 8 2-7, 258 MZ 8-9 2-8, 260 ZM 9 2-9, 261 MG 9 2-3, 262 RE 9 2-9, 263 ZW 9, 264 NA 8-9 6-8,
265 MW 7-9, 266 LS 8 2-8, 267 BW 7-8, 268 SZ 8 0-9, 269 KM 7 3-8, 290 SH 4-5 2-8, 291 ER 7, 297 AW 7 2-9,
298 FO 6 2-9, 299 GL 6 1-9, 350 GI 8 2-5, 351 PT 9, 352 LU 6-11 2-9, 353 IE 7-10, 354 IS 7 3-9, 355 AL 8-9 2-9,
356 MT 8 2-9, 357 CY 8 2-9, 358 FI 6-11, 359 BG 7-9 2-9, 370 LT 8 3-9, 371 LV 8 2-9, 372 EE 7-8 3-9, 373 MD 8 2-9,
374 AM 8, 375 BY 9, 376 AD 6 3-8, 377 MC 8-9 3-9, 378 SM 6-10 0-9, 380 UA 9 3-9, 381 RS 8-9, 382 ME 8 2-9,
383 XK 8-9 2-9, 385 HR 8-9, 386 SI 8, 387 BA 8-9 3-9, 389 MK 8 2-8, 420 CZ 9 2-9, 421 SK 9 2-9, 423 LI 7 2-9,
501 BZ 7 2-8, 502 GT 8 2-7, 503 SV 8 2-9, 504 HN 8 2-9, 505 NI 8, 506 CR 8 2-8, 507 PA 7-8, 509 HT 8 2-9,
590 GP 9, 591 BO 8 2-8, 592 GY 7 2-9, 593 EC 8-9 2-9, 594 GF 9, 595 PY 9 2-9, 596 MQ 9, 597 SR 6-7 2-8, 598 UY 8 2-9,
599 CW 7-8, 670 TL 7-8 2-8, 673 BN 7 2-8, 674 NR 7 4-8, 675 PG 7-8, 676 TO 5-7 2-8, 677 SB 5-7, 678 VU 5-7,
679 FJ 7 2-9, 680 PW 7 2-8, 682 CK 5 2-8, 685 WS 5-7 2-8, 686 KI 5-8, 687 NC 6 2-9, 688 TV 5-7 2-9, 689 PF 8 4-8,
691 FM 7 3-9, 692 MH 7 2-6, 852 HK 8 2-9, 853 MO 8 2-8, 855 KH 8-9, 856 LA 8-10 2-8, 880 BD 8-10, 886 TW 8-9 2-9,
960 MV 7 3-9, 961 LB 7-8, 962 JO 8-9 2-8, 963 SY 8-9, 964 IQ 8-10, 965 KW 8, 966 SA 9, 967 YE 7-9, 968 OM 8 2-9,
970 PS 8-9, 971 AE 8-9 2-9, 972 IL 8-9, 973 BH 8, 974 QA 8 2-8, 975 BT 7-8, 976 MN 8, 977 NP 8-10, 992 TJ 9,
993 TM 8, 994 AZ 9, 995 GE 9 3-8, 996 KG 9 2-9, 998 UZ 9
"""

# --- fixed values: parts of a country code's numbers that belong to another territory, and the
# lengths of national numbers there
TERRITORIES = """
35818 AX 6-11, 4779 SJ 8, 5993 BQ 7, 5994 BQ 7, 5997 BQ 7, 6189162 CC 9, 6189164 CX 9, 76 KZ 10, 77 KZ 10,
441481 GG 10, 441534 JE 10, 441624 IM 10, 262269 YT 9, 262639 YT 9, 3906698 VA 6-11
"""


@dataclass(frozen=True)
class DigitRange:
    """Numbers whose first digits lie between ``low`` and ``high``, both of one width."""

    low: str
    high: str
    country: str
    shortest: int  # of all digits, country code included
    longest: int


def _numbers(ranges: str) -> Iterable[int]:
    for part in ranges.split():
        low, _, high = part.partition("-")
        yield from range(int(low), int(high or low) + 1)


def _entries(table: str) -> Iterable[list[str]]:
    return (entry.split() for entry in table.replace("\n", " ").strip().split(", "))


def dial_plan() -> list[DigitRange]:
    """The built-in plan. A North American number is a country code 1, an area and an exchange from 2 on."""
    areas = {"US": f"{US_AREAS} {US_SERVICES}"} | NORTH_AMERICA
    plan = [
        DigitRange(f"1{area}2", f"1{area}9", country, 11, 11)
        for country, listed in areas.items() for area in _numbers(listed)
    ]
    for code, country, lengths, *first in _entries(COUNTRY_CODES):
        digits = list(_numbers(first[0] if first else "1-9"))
        national = list(_numbers(lengths))
        plan.append(DigitRange(
            f"{code}{digits[0]}", f"{code}{digits[-1]}", country, len(code) + national[0], len(code) + national[-1]
        ))
    codes = {code for code, *_ in _entries(COUNTRY_CODES)}
    for prefix, country, lengths in _entries(TERRITORIES):
        code = next(prefix[:n] for n in (1, 2, 3) if prefix[:n] in codes)
        national = list(_numbers(lengths))
        plan.append(DigitRange(prefix, prefix, country, len(code) + national[0], len(code) + national[-1]))
    return plan


def intervals(plan: Iterable[DigitRange]) -> list[tuple[int, int, str, int, int]]:
    """``(low, high, country, shortest, longest)``: sorted, without overlaps, of the first ``KEY_DIGITS`` digits."""
    pieces: list[tuple[int, int, str, int, int]] = []
    # what wins first; the others only fill what is left open
    for r in sorted(plan, key=lambda r: (-len(r.low), int(r.high) - int(r.low), r.low)):
        rest = 10 ** (KEY_DIGITS - len(r.low))
        open_ = [(int(r.low) * rest, (int(r.high) + 1) * rest - 1)]
        for low, high, *_ in pieces:
            open_ = [
                (a, b) for x, y in open_ for a, b in ((x, min(y, low - 1)), (max(x, high + 1), y)) if a <= b
            ] if any(x <= high and low <= y for x, y in open_) else open_
        pieces += [(a, b, r.country, r.shortest, r.longest) for a, b in open_]
    return sorted(pieces)


def e164_digits(number: Column) -> Column:
    """E.164 digits of a formatted number, null where it cannot be one.

    Without ``+`` the default country is the United States: 10 digits, or 11 that start with 1.
    """
    return (
        F.when(number.rlike(r"^\+[1-9][0-9]{7,14}\z"), F.substring(number, 2, 20))
        .when(number.rlike(r"^1[0-9]{10}\z"), number)
        .when(number.rlike(r"^[0-9]{10}\z"), F.concat(F.lit("1"), number))
    )


def country_of_number(number: Column, plan: Iterable[DigitRange] | Mapping[str, str] | None = None) -> Column:
    """Country of the interval that holds the number, if it has numbers of that length.

    ``plan`` may be a mapping of prefixes to countries, whose numbers may have any length.
    """
    if isinstance(plan, Mapping):
        plan = [DigitRange(prefix, prefix, country, *ANY_LENGTH) for prefix, country in plan.items()]
    table = intervals(dial_plan() if plan is None else plan)

    def found(digits: Column) -> Column:
        key = F.substring(digits, 1, KEY_DIGITS).cast("int")
        return F.transform(
            F.transform(F.array(key), lambda k: interval_of(k, table, country="string", shortest="int", longest="int")),
            lambda r: F.when(F.length(digits).between(r["shortest"], r["longest"]), r["country"]),
        )[0]

    return F.transform(F.array(e164_digits(number)), found)[0]
