"""Fixtures and plain versions of the operators, document by document and pair by pair."""

import hashlib
import random
import re
from collections import Counter

import regex

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, row int, words string, spans string, score string, node int"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "s", None if t is None else len(t), "r", 1, "w", "x", "y", 2) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def documents(seed=1):
    """Null, empty, short, long, equal, nearly equal and periodic texts, and passages that several documents share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéü") for _ in range(rng.randint(1, 7)))
    vocabulary = [word() for _ in range(400)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = [prose(60), prose(45), prose(34)]
    texts = [None, "", " \n\t", "a", "Ab cd", "one two three four", "x" * 500, "ab" * 300, " ".join(["la"] * 90), " ", None]
    for k in range(30):
        body = prose(rng.randint(1, 220))
        if k % 3 == 0:
            at = rng.randrange(len(body) + 1)
            body[at:at] = shared[k % 2]
        if k % 5 == 0:
            body += shared[2]
        texts.append(("\n" if k % 2 else " ").join(body))
    base = prose(300)
    for _ in range(14):
        copy = list(base)
        for _ in range(rng.randint(0, 14)):
            copy[rng.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    tiny = prose(12)
    texts += [" ".join(tiny), " ".join(tiny[:-1]), " ".join([*tiny, "end"]), " ".join(tiny).upper()]
    texts += [texts[12], texts[12], " ".join(prose(9_000))]
    return texts


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def substrings(texts, window=200):
    held = [(t or "").encode() for t in texts]
    often = Counter(w[i : i + window] for w in held for i in range(len(w) - window + 1))
    out = []
    for w in held:
        gone = bytearray(len(w))
        for i in range(len(w) - window + 1):
            if often[w[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        kept = bytes(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def passages(texts, window=35):
    held = [spaced(t) for t in texts]
    often = Counter(tuple(w[i : i + window]) for w in held for i in range(len(w) - window + 1))
    out = []
    for w in held:
        gone = [0] * len(w)
        for i in range(len(w) - window + 1):
            if often[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [1] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingles(text, k=5):
    w = spaced(ascii_lower(text))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(texts, ids):
    """(size of the set, least id that links reach) of each document."""
    sets = [shingles(t) for t in texts]
    top = list(range(len(sets)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    low = {}
    for i in range(len(sets)):
        r = find(i)
        low[r] = min((x for x in (low.get(r), ids[i]) if x is not None), default=None)
    return [(len(s), low[find(i)] if s else ids[i]) for i, s in enumerate(sets)]


def lines(texts, ids, least=50):
    """Texts without the later copies of runs of any number of lines of at least `least` characters."""
    held = [[] if t is None else t.split("\n") for t in texts]
    order = sorted(range(len(held)), key=lambda i: (ids[i] is not None, ids[i]))
    gone = [set() for _ in held]
    size, repeated = 1, True
    while repeated:  # no longer run repeats if none of this size does
        seen, repeated = set(), False
        for i in order:
            for at in range(len(held[i]) - size + 1):
                run = tuple(held[i][at : at + size])
                if run in seen:
                    repeated = True
                    if sum(map(len, run)) >= least:
                        gone[i] |= set(range(at, at + size))
                seen.add(run)
        size += 1
    return [None if t is None else "\n".join(x for k, x in enumerate(h) if k not in g) for t, h, g in zip(texts, held, gone, strict=True)]


def template(text, units):
    """Words without case, and the same with slots."""
    cased = regex.findall(r"[\p{L}\p{N}]+", text or "")
    telling = regex.search(r"\p{Ll}", text or "")
    words = [w.upper().lower() for w in cased]

    def slot(c, w):
        if regex.match(r"\p{N}", c):
            return "#number"
        if telling and regex.match(r"[\p{Lu}\p{Lt}]", c):
            return "#name"
        return "#unit" if w in units else w

    return words, [slot(c, w) for c, w in zip(cased, words, strict=True)]


def leaked_words(item, text, units, width=8, least=12):
    """Most words of the item that the text holds on one diagonal with consistent slots; 0 if they are too few."""
    (words, names), (of_text, names_of_text) = template(item, units), template(text, units)
    n = len(words)
    width = min(width, n)
    if not n:
        return 0
    starts = range(n - width + 1)
    plain = lambda w: sum(not x.startswith("#") for x in w)
    vague = {at: plain(names[at : at + width]) < 4 and plain(names[at : at + width]) < width for at in starts}
    if n >= 8 and all(vague.values()):
        vague = dict.fromkeys(starts, False)
    diagonals = {}
    for at in starts:
        for place in range(len(of_text) - width + 1):
            typed = not vague[at] and names[at : at + width] == names_of_text[place : place + width]
            if typed or words[at : at + width] == of_text[place : place + width]:
                diagonals.setdefault(place - at, set()).add(at)
    best = 0
    for d, held in diagonals.items():
        covered = sorted({p for at in held for p in range(at, at + width)})
        pairs = {p: (words[p], of_text[p + d]) for p in covered if names[p].startswith("#")}
        times = Counter(pairs.values())
        kept = {a: min((b for x, b in times if x == a), key=lambda b, a=a: (-times[a, b], b)) for a, _ in times}
        bad = {p for p, (a, b) in pairs.items() if kept[a] != b}
        left = {p for at in held if not bad & set(range(at, at + width)) for p in range(at, at + width)}
        longest = 0
        for i, p in enumerate(covered):
            seen = {}
            for k, q in enumerate(covered[i:]):
                a, b = pairs.get(q, (None, None))
                if q != p + k or (a is not None and seen.setdefault(a, b) != b):
                    break
                longest = max(longest, k + 1)
        found = max(len(left), longest) if bad else len(covered)
        best = max(best, found if found >= min(least, n) else 0)
    return best
