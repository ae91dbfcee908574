"""The operators' results in plain Python, one document at a time."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lowered(text):
    return (text or "").translate(ASCII_LOWER)


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def license_row(text, templates, phrases):
    words = alnum(text)
    places = [
        (i, label)
        for phrase, label in phrases
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    base = sorted({label for _, label in places})
    found, best = set(base), 0.0
    for t in templates:
        tokens = set(t.tokens)
        both = max((len(tokens.intersection(words[i : i + t.window])) for i, w in enumerate(words) if w in tokens), default=0)
        if both >= t.needed:
            found.add(t.label)
            best = max(best, both / len(t.tokens))
    starts = [i for i, _ in places]
    return (
        len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base),
        ",".join(sorted(found)), 1.0 if places else best,
    )


def shingles(text):
    words = spaced(lowered(text))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def groups(texts):
    """doc_id -> (set size, smallest id reachable) of a dict of texts."""
    sets = {i: shingles(t) for i, t in texts.items()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    shared = Counter()
    for ids in holders.values():
        shared.update(combinations(sorted(ids), 2))
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), both in shared.items():
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def contamination_row(text, items):
    words = alnum(text)
    hit, found = set(), set()
    for item, item_text in items:
        own = alnum(item_text)
        n = min(13, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                if item is not None:
                    found.add(str(item))
    joined = ",".join(sorted(found))
    return (
        len(words), len(hit), len(found), hashlib.sha256(joined.encode()).hexdigest(),
        bool(hit) and 20 * len(hit) >= len(words),
    )


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
)


def base_spans(text):
    found = [
        (m.start(), n, kind, m.end())
        for n, (kind, pattern, check) in enumerate(BASE)
        for m in re.finditer(pattern, text or "")
        if check(m.group())
    ]
    return [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found)]


def quality_row(text):
    words = spaced(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {
        i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)
    }
    lines = [x for x in (text or "").split("\n") if spaced(x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)),
        len(repeated), len(words) < 10 or 100 * len(repeated) > 20 * len(words),
    )


def chat_row(turns):
    """Of (turn, role, text) rows."""
    rows = sorted(((t is not None, t or 0, r or "", x or "") for t, r, x in turns))
    told = "".join(f"{r}\n{x}\n" for _, _, r, x in rows)
    loss = "".join(x for _, _, r, x in rows if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(rows), sha(told), len(loss), sha(loss)
