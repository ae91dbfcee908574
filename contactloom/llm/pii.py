"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Everything is computed inside the row: matches and the gaps between them come from one pattern, so
their lengths give the places. Every pattern is linear in the text, for hostile texts too: a run
of letters or digits is tried from its start only, and nothing backtracks over it.
DataFrame functions only.

Base kinds (email, ip, card, phone) are reported whenever their own check passes, whatever the
score. Added kinds (iban, ssn, secret) need a score of at least ``MIN_SCORE``.

Defined cases: a null text counts as empty, and stays null when redacted; repeated rows are each
treated; an empty table gives an empty table; other columns are kept, an input column named like a
result is replaced. Overlapping spans of several kinds are all reported and redacted as one.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.llm.text import let, running, whole

MIN_SCORE = 0.5
#: Characters of the text before and after a span in which context words count, and how many other
#: matches they can hold: a match has two characters at least, with one between it and the next.
CONTEXT_CHARS = 40
CONTEXT_MATCHES = 14
SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn's check of a string of digits."""
    reverse = F.reverse(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)), F.lit(0),
        lambda a, i: a + let(
            F.substring(reverse, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1),
            lambda d: F.when(d > 9, d - 9).otherwise(d),
        ),
    )
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """The check of an account number: its first four characters last, letters as 10 to 35, modulo 97 is 1."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, F.lit(1), F.lit(4)))
    rest = F.aggregate(
        F.sequence(F.lit(1), F.length(turned)), F.lit(0),
        lambda a, i: let(
            F.substring(turned, i, F.lit(1)),
            lambda c: F.when(
                c.between("0", "9"), (a * 10 + c.cast("int")) % 97
            ).otherwise((a * 100 + F.ascii(c) - 55) % 97),
        ),
    )
    return rest == 1


def _small_parts(ip: Column) -> Column:
    parts = F.transform(F.split(ip, "\\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    hint: str  # text that must stand somewhere for the pattern to match; spares the other texts
    check: Callable[[Column], Column]
    score: float
    words: str  # context words, as a pattern
    base: bool = True


KINDS = (
    Kind("email", "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
         "@", lambda m: F.lit(True), 0.9, "mail|contact|reach|write"),
    Kind("ip", "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
         "[0-9]\\.[0-9]", _small_parts, 0.6, "\\bip\\b|host|server|address|client"),
    Kind("card", "[0-9](?:[ -]?[0-9])++", "[0-9][ -]?[0-9]",
         lambda m: let(_digits(m), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False)),
         0.7, "card|credit|visa|payment|account"),
    Kind("phone", "\\+[0-9][ ().0-9-]+[0-9]", "\\+[0-9]",
         lambda m: F.length(_digits(m)).between(9, 15), 0.6, "phone|call|tel|mobile|fax"),
    Kind("iban", "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}+(?:[ ]?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
         "[A-Z]{2}[0-9]{2}",
         lambda m: let(F.regexp_replace(m, " ", ""), lambda x: F.length(x).between(15, 34) & mod97(x)),
         0.6, "iban|account|bank|konto|compte", base=False),
    Kind("ssn", "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]",
         lambda m: ~m.rlike("^(?:000|666|9..)-|-00-|-0000$"), 0.3, "ssn|social security|taxpayer", base=False),
    Kind("secret", "(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|[0-9a-f]{32,64})(?![A-Za-z0-9])",
         "[0-9A-Za-z]{20}",
         lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]"), 0.3, "token|secret|key|passw|auth|bearer", base=False),
)
CONTEXT_BONUS = 0.3


def _spans_of(text: Column, kind: Kind) -> Column:
    """Spans of one kind, in order; failing matches are dropped and not tried again."""

    def walk(matches: Column) -> Column:
        return let(F.split(text, kind.pattern), lambda gaps: placed(matches, gaps))

    def placed(matches: Column, gaps: Column) -> Column:
        # gaps[i] stands before match i, the last gap after all matches
        lengths = F.transform(matches, lambda m, i: F.char_length(m) + F.char_length(F.get(gaps, i)))
        # the ends of what stands before a match and the beginnings of what stands after it
        ends = F.transform(matches, lambda m, i: F.right(F.concat(_end(F.get(gaps, i)), m), F.lit(CONTEXT_CHARS)))
        begins = F.transform(matches, lambda m, i: F.left(F.concat(m, _begin(F.get(gaps, i + 1))), F.lit(CONTEXT_CHARS)))

        def near(i: Column, ends: Column, begins: Column) -> Column:
            first = F.greatest(i - CONTEXT_MATCHES, F.lit(0))
            before = F.concat(F.array_join(F.slice(ends, first + 1, i - first), ""), _end(F.get(gaps, i)))
            after = F.concat(_begin(F.get(gaps, i + 1)), F.array_join(F.slice(begins, i + 2, F.lit(CONTEXT_MATCHES)), ""))
            return F.concat_ws(" ", _end(before), _begin(after))

        def at(before: Column, ends: Column, begins: Column) -> Column:
            every = F.transform(matches, lambda m, i: F.struct(
                m.alias("m"), i.alias("i"), (F.get(before, i) + F.char_length(F.get(gaps, i))).alias("start"),
            ))
            return F.transform(F.filter(every, lambda x: kind.check(x["m"])), lambda x: F.struct(
                F.lit(kind.name).alias("kind"), x["start"].alias("start"),
                (x["start"] + F.char_length(x["m"])).alias("end"),
                _score(kind, near(x["i"], ends, begins)).alias("score"),
            ))

        # one struct, since every further lambda costs the analyzer a round
        once = F.struct(running(lengths, lambda a, b: a + b, F.lit(0)).alias("before"), ends.alias("ends"), begins.alias("begins"))
        return let(once, lambda x: at(x["before"], x["ends"], x["begins"]))

    found = F.regexp_extract_all(text, F.lit(kind.pattern), 0)
    spans = F.when(text.rlike(kind.hint), let(found, walk)).otherwise(F.array().cast(SPAN))
    return spans if kind.base else F.filter(spans, lambda s: s["score"] >= MIN_SCORE)


def _end(text: Column) -> Column:
    return F.right(text, F.lit(CONTEXT_CHARS))


def _begin(text: Column) -> Column:
    return F.left(text, F.lit(CONTEXT_CHARS))


def _score(kind: Kind, near: Column) -> Column:
    """The kind's own score, raised if one of its context words stands ``near``."""
    return F.when(F.lower(near).rlike(kind.words), min(1.0, kind.score + CONTEXT_BONUS)).otherwise(kind.score)


def spans(text: Column, kinds=KINDS) -> Column:
    """All spans of a text by start, then by kind in the order of KINDS."""

    def of_text(body: Column) -> Column:
        every = F.concat(*[
            F.transform(_spans_of(body, k), lambda s: F.struct(
                s["start"].alias("start"), F.lit(n).alias("n"), s.alias("span")
            ))
            for n, k in enumerate(kinds)
        ])
        return F.transform(F.array_sort(every), lambda x: x["span"])

    return let(whole(text), of_text)


def redacted(text: Column, found: Column) -> Column:
    """The text with every span, or run of overlapping spans, replaced by its kind in brackets."""

    def rebuilt(reached: Column) -> Column:
        # reached[i] is where the spans before span i end
        parts = F.transform(found, lambda s, i: F.when(
            s["start"] >= F.get(reached, i),
            F.concat(
                F.substring(text, F.get(reached, i) + 1, s["start"] - F.get(reached, i)),
                F.lit("["), F.upper(s["kind"]), F.lit("]"),
            ),
        ).otherwise(""))
        end = F.array_max(F.transform(found, lambda s: s["end"]))
        return F.concat(F.array_join(parts, ""), F.substring(text, end + 1, F.char_length(text)))

    ends = F.transform(found, lambda s: s["end"])
    return F.when(F.size(found) == 0, text).otherwise(
        let(running(ends, lambda a, b: F.greatest(a, b), F.lit(0)), rebuilt)
    )


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``pii``: array of ``(kind, start, end, score)``, code points, end exclusive."""
    return docs.withColumn("pii", spans(F.col(text)))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced in the text; the same columns and rows."""
    names = [F.col(f"`{c}`") for c in docs.columns if c != text]
    done = let(spans(F.col(text)), lambda found: redacted(F.col(text), found))
    return docs.select(*names, done.alias(text)).select(*[F.col(f"`{c}`") for c in docs.columns])


def listed(found: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
