"""Suffix array with common prefixes by external induced sorting: queues on disk carry suffixes and common prefixes through the recursion.

Suffixes whose text rises (S) or falls (L) to the next letter are told apart; those that begin a rise after a fall (seeds) are sorted
first, by recursion: one round of induction sorts the seeds' own stretches, the stretches are named in that order, and the seeds are
sorted by the suffixes of the sequence of names, by the same means. From the sorted seeds, a scan upwards induces the L suffixes and a scan
downwards the S suffixes: whenever a suffix is met, the one a letter before it is put into the queue of its first letter, with the prefix
it shares with the one put there before, which is one letter more than the least common prefix met in between.

The queues, one for each letter, form a priority queue by letter and order of arrival. What they hold beyond `memory` bytes is written to a
temporary file of the task, a run for each letter, and read back in order at the letter's turn, CHUNK entries at a time. The arrays of the
length of the text (letters, types, order, prefixes, names) are mapped from temporary files where they are larger than `memory`, and are
gone through in chunks. So a text is sorted in memory that doesn't depend on its length.

Names are written with two digits of an alphabet of about the square root of their number, so that the queues of the recursion are few and
long as well; the suffixes that begin with a first digit are the seeds'. Common prefixes of seeds come from those of their names: the
stretches that the names share, and then letter by letter in the stretches that differ. They are carried up to CAP letters.
"""

from __future__ import annotations

import tempfile
from collections import deque
from collections.abc import Iterator

import numpy as np

CAP = 255
#: Entries that are worked on at once.
CHUNK = 1 << 17
#: A sequence of names is sorted by doubled ranks, in memory, if that takes no more than `memory` at so many bytes a name.
DOUBLING_BYTES = 64
#: Up to so many names are letters as they are.
FEW_NAMES = 1_024


def room(n: int, kind: type, memory: int) -> np.ndarray:
    """An array of zeros, mapped from a temporary file where it is larger than memory."""
    if n * np.dtype(kind).itemsize <= memory:
        return np.zeros(n, kind)
    return np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=(n,))


class Queues:
    """For each letter, suffixes and common prefixes in order of arrival: as parts of arrays in memory, or as runs in a file."""

    #: How often any queues were written to disk, by this process.
    spills = 0

    def __init__(self, letters: int, memory: int):
        self.blocks: list[deque] = [deque() for _ in range(letters)]
        self.memory, self.held, self.file = memory, 0, None

    def put(self, place: np.ndarray, prefix: np.ndarray, letter: np.ndarray, start: np.ndarray) -> None:
        """Adds to the queues of letters: to each the entries from its start on, up to the next one's."""
        for k, i, j in zip(letter.tolist(), start.tolist(), [*start[1:].tolist(), len(place)], strict=True):
            self.blocks[k].append((place, prefix, i, j))
        self.held += place.nbytes + prefix.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        Queues.spills += 1
        self.file = self.file or tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        for blocks in self.blocks:
            last = []
            while blocks and len(blocks[-1]) == 4:
                last.append(blocks.pop())
            if last:
                place, prefix = self._joined(last[::-1])
                self.file.write(place.tobytes())
                self.file.write(prefix.tobytes())
                blocks.append((at, at + place.nbytes, len(place)))
                at += place.nbytes + prefix.nbytes
        self.held = 0

    @staticmethod
    def _joined(parts: list) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([p[i:j] for p, _, i, j in parts]), np.concatenate([x[i:j] for _, x, i, j in parts])

    def take(self, letter: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The first entries of a queue, about CHUNK of them; None if it is empty."""
        blocks, got, n = self.blocks[letter], [], 0
        while blocks and n < CHUNK:
            block = blocks.popleft()
            if len(block) == 3:
                at, more, size = block
                some = min(size, CHUNK)
                self.file.seek(at)
                place = np.frombuffer(self.file.read(8 * some), np.int64)
                self.file.seek(more)
                prefix = np.frombuffer(self.file.read(some), np.uint8)
                if some < size:
                    blocks.appendleft((at + 8 * some, more + some, size - some))
                block = (place, prefix, 0, some)
            got.append(block)
            n += block[3] - block[2]
        return self._joined(got) if got else None

    def close(self) -> None:
        if self.file:
            self.file.close()


def starts(letter: np.ndarray) -> np.ndarray:
    """Where runs of one letter begin."""
    return np.flatnonzero(np.append(True, letter[1:] != letter[:-1]))


def chunks(n: int) -> Iterator[tuple[int, int]]:
    return ((i, min(i + CHUNK, n)) for i in range(0, n, CHUNK))


def _least_table(values: np.ndarray) -> list[np.ndarray]:
    table, width = [values], 1
    while 2 * width <= len(values):
        table.append(np.minimum(table[-1][:-width], table[-1][width:]))
        width *= 2
    return table


def _least(table: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least value of [first, last), CAP where that is empty."""
    out = np.full(len(first), CAP, np.uint8)
    some = np.flatnonzero(last > first)
    if len(some):
        level = np.frexp((last - first)[some].astype(float))[1] - 1
        for k in np.flatnonzero(np.bincount(level)):
            at = some[level == k]
            out[at] = np.minimum(table[k][first[at]], table[k][last[at] - (1 << int(k))])
    return out


class Induction:
    """Sorts all suffixes of a text from its seeds. The last letter is 0 and no other is."""

    def __init__(self, text: np.ndarray, memory: int):
        n = len(text)
        self.text, self.memory, self.letters = text, memory, int(text.max()) + 1
        self.rising = room(n, np.bool_, memory)
        falling_by, rising_by = (np.zeros(self.letters, np.int64) for _ in range(2))
        after, after_rises = 0, True
        for i, j in reversed(list(chunks(n))):
            part = np.append(text[i:j], text[j] if j < n else text[j - 1])
            rises = part[:-1] < part[1:]
            differs = part[:-1] != part[1:]
            if j == n:
                rises[-1] = differs[-1] = True
            elif not differs[-1]:
                rises[-1], differs[-1] = after_rises, True
            ends = np.flatnonzero(differs)
            rises = rises[ends[np.searchsorted(ends, np.arange(j - i))]]
            self.rising[i:j], after_rises = rises, rises[0]
            rising_by += np.bincount(part[:-1][rises], minlength=self.letters)
            falling_by += np.bincount(part[:-1][~rises], minlength=self.letters)
        self.begin = np.append(0, np.cumsum(falling_by + rising_by))
        self.turn = self.begin[:-1] + falling_by  # where the S suffixes of a letter begin
        self.order, self.prefix = room(n, np.int64 if n >= 1 << 31 else np.int32, memory), room(n + 1, np.uint8, memory)

    def is_seed(self, place: np.ndarray) -> np.ndarray:
        return self.rising[place] & ~self.rising[place - 1] & (place > 0)

    def run(self, place: int) -> int:
        """How often the letter at a place stands there in a row, up to CAP."""
        part = self.text[place : place + CAP]
        other = np.flatnonzero(part != part[0])
        return int(other[0]) if len(other) else len(part)

    def _put(self, queues: Queues, arrived: np.ndarray, since: np.ndarray, place: np.ndarray, prefix: np.ndarray, wanted: bool, with_prefix: bool) -> None:
        """Puts the suffixes before those of a batch into the queues of their letters."""
        before = place - 1
        at = np.flatnonzero(before >= 0)
        at = at[self.rising[before[at]] == wanted]
        low = prefix.min()
        if not len(at):
            np.minimum(since, low, out=since)
            return
        target = self.text[before[at]]
        by = np.argsort(target, kind="stable")
        at, target = at[by], target[by]
        start = starts(target)
        hit = target[start]
        shared = np.zeros(len(at), np.uint8)
        if with_prefix:
            table = _least_table(prefix)
            back = np.empty(len(at), np.int64)
            back[1:] = at[:-1] + 1
            back[start] = 0
            shared = _least(table, back, at + 1)
            shared[start] = np.minimum(shared[start], since[hit])
            shared = np.minimum(shared, CAP - 1) + np.uint8(1)
            shared[start[~arrived[hit]]] = 0
            arrived[hit] = True
            last = at[np.append(start[1:], len(at)) - 1]
            np.minimum(since, low, out=since)
            since[hit] = _least(table, last + 1, np.full(len(last), len(prefix)))
        queues.put(before[at], shared, hit, start)

    def up(self, seeds: Queues, with_prefix: bool) -> None:
        """Writes the L suffixes of all letters in order; seeds hold the S suffixes that are given, in order."""
        queues, arrived = Queues(self.letters, self.memory), np.zeros(self.letters, np.bool_)
        for letter in range(self.letters):
            since, at = np.zeros(self.letters, np.uint8), self.begin[letter]
            while (batch := queues.take(letter)) is not None:
                place, prefix = batch
                self.order[at : at + len(place)], self.prefix[at : at + len(place)] = batch
                at += len(place)
                self._put(queues, arrived, since, place, prefix, False, with_prefix)
            first = True
            while (batch := seeds.take(letter)) is not None:
                place, prefix = batch
                if first and at > self.begin[letter]:
                    prefix[0] = min(self.run(self.order[at - 1]), self.run(place[0]))
                elif first:
                    prefix[0] = 0
                first = False
                self._put(queues, arrived, since, place, prefix, False, with_prefix)
        queues.close()
        seeds.close()

    def down(self, with_prefix: bool) -> None:
        """Writes the S suffixes of all letters, from the last to the first; the common prefixes met are those with the suffix after."""
        queues, arrived = Queues(self.letters, self.memory), np.zeros(self.letters, np.bool_)
        for letter in range(self.letters - 1, 0, -1):
            since, at = np.zeros(self.letters, np.uint8), self.begin[letter + 1]
            while (batch := queues.take(letter)) is not None:
                place, prefix = batch
                self.order[at - len(place) : at] = place[::-1]
                self.prefix[at - len(place) + 1 : at + 1] = prefix[::-1]
                at -= len(place)
                self._put(queues, arrived, since, place, prefix, True, with_prefix)
            turn, begin = self.turn[letter], self.begin[letter]
            seam = min(self.run(self.order[turn - 1]), self.run(self.order[turn])) if begin < turn < self.begin[letter + 1] else 0
            self.prefix[self.begin[letter + 1]] = 0  # the next letter's first
            if turn < self.begin[letter + 1]:
                self.prefix[turn] = seam
            for high in range(turn, begin, -CHUNK):
                low = max(begin, high - CHUNK)
                prefix = self.prefix[low + 1 : high + 1][::-1].copy()
                if high == turn:
                    prefix[0] = seam
                self._put(queues, arrived, since, self.order[low:high][::-1].astype(np.int64), prefix, True, with_prefix)
        self.order[0], self.prefix[0] = len(self.text) - 1, 0  # the end of the text, smaller than all
        queues.close()


def _alike(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which stretches from a and b are equal over their length."""
    out = length > 0
    live, k = np.flatnonzero(out), 0
    while len(live):
        same = text[a[live] + k] == text[b[live] + k]
        out[live[~same]] = False
        k += 1
        live = live[same]
        live = live[length[live] > k]
    return out


def _extended(text: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Common prefixes of different suffixes, up to CAP, of which known letters agree."""
    out = np.minimum(known, CAP).astype(np.int64)
    live = np.flatnonzero(out < CAP)
    while len(live):
        at = out[live]
        live = live[text[a[live] + at] == text[b[live] + at]]
        out[live] += 1
        live = live[out[live] < CAP]
    return out


def _doubled(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What suffixes() gives, in memory, by doubled ranks; only suffixes that still tie are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    first = np.zeros(n, np.int64)
    first[starts(text[order])] = starts(text[order])
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(first)
    ranks, step = [rank], 1  # the rank at k: the first place of the suffixes that agree in 2**k letters
    while True:
        of = rank[order]
        same = np.append(False, of[1:] == of[:-1])
        tied = np.flatnonzero(same | np.append(same[1:], False))
        if not len(tied):
            break
        suffix = order[tied]
        after = np.zeros(len(tied), np.int64)
        inner = suffix + step < n
        after[inner] = rank[suffix[inner] + step] + 1
        key = of[tied].astype(np.int64) * (n + 1) + after
        by = np.argsort(key, kind="stable")
        order[tied], key = suffix[by], key[by]
        at = starts(key)
        rank = rank.copy()
        rank[order[tied]] = np.repeat(tied[at], np.diff(np.append(at, len(tied))))
        ranks.append(rank)
        step *= 2
    shared = np.zeros(n, np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        i, j = order[:-1] + shared[1:], order[1:] + shared[1:]
        inner = np.flatnonzero((i < n) & (j < n))
        inner = inner[ranks[k][i[inner]] == ranks[k][j[inner]]]
        shared[1 + inner] += 1 << k
    return order, np.minimum(shared, CAP).astype(np.uint8)


def suffixes(text: np.ndarray, memory: int = 64_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Places of all suffixes in order, and the prefix (up to CAP) that each shares with the one before it.

    text: small whole numbers, of which the last is 0 and no other is.
    """
    n, sort = len(text), Induction(text, memory)
    if n == 1:
        return np.zeros(1, np.int32), np.zeros(1, np.uint8)
    # the seeds, and how far it is to the next one; a seed's number is half its place, as no two are neighbours
    seeds, length = Queues(sort.letters, memory), room(n // 2 + 1, np.int32, memory)
    seed, m, last = room(n // 2 + 1, sort.order.dtype, memory), 0, None
    for i, j in chunks(n):
        place = np.arange(i, j)
        place = place[sort.is_seed(place)]
        if len(place):
            seed[m : m + len(place)] = place
            m += len(place)
            all_of = place if last is None else np.append(last, place)
            length[all_of[:-1] // 2] = np.diff(all_of)
            last = place[-1]
            letter = text[place]
            by = np.argsort(letter, kind="stable")
            start = starts(letter[by])
            seeds.put(place[by], np.zeros(len(by), np.uint8), letter[by][start], start)
    seed = seed[:m]
    # one round of induction sorts the seeds' stretches, equal stretches get equal names
    sort.up(seeds, False)
    sort.down(False)
    names, n_names, before = room(n // 2 + 1, np.int32, memory), 0, None
    for i, j in chunks(n):
        place = sort.order[i:j].astype(np.int64)
        place = place[sort.is_seed(place)]
        if len(place):
            a = np.append(place[0] if before is None else before, place[:-1])
            of_a, of_b = length[a // 2], length[place // 2]
            new = ~_alike(text, a, place, np.where(of_a == of_b, of_b + 1, 0) * (a != place))
            names[place // 2] = n_names + np.cumsum(new) - 1
            n_names += int(new.sum())
            before = place[-1]
    # the seeds in order, by the suffixes of the sequence of names
    again = Queues(sort.letters, memory)

    def put(place: np.ndarray, before: np.ndarray, known: np.ndarray) -> None:
        prefix = _extended(text, before, place, np.where(before == place, CAP, known))
        letter = text[place]
        start = starts(letter)
        again.put(place, prefix.astype(np.uint8), letter[start], start)

    before = None
    if n_names == m:
        for i, j in chunks(n):
            place = sort.order[i:j].astype(np.int64)
            place = place[sort.is_seed(place)]
            if len(place):
                put(place, np.append(place[0] if before is None else before, place[:-1]), np.zeros(len(place), np.int64))
                before = place[-1]
    else:
        inside = DOUBLING_BYTES * m <= memory
        width = 1 if inside or n_names <= FEW_NAMES else 2
        radix = int(np.ceil(n_names ** (1 / width)))
        digits = room(width * (m - 1) + 1, np.uint16 if radix < 65_000 else np.int32, memory)
        for i, j in chunks(m - 1):
            name = names[seed[i:j] // 2]
            if width == 1:
                digits[i:j] = name
            else:
                digits[2 * i : 2 * j : 2], digits[2 * i + 1 : 2 * j : 2] = name // radix + 1, name % radix + 1
        del names
        order, prefix = _doubled(digits) if inside else suffixes(digits, memory)
        low = CAP
        for i, j in chunks(len(order)):
            place, shared = order[i:j].astype(np.int64), prefix[i:j]
            at = np.flatnonzero(place % width == 0)
            if not len(at):
                low = min(low, int(shared.min()))
                continue
            common = np.minimum.reduceat(shared, np.append(0, at[:-1] + 1))
            common[0] = min(common[0], low)
            low = int(shared[at[-1] + 1 :].min()) if at[-1] + 1 < len(shared) else CAP
            number = place[at] // width
            ahead = np.append(number[0] if before is None else before, number[:-1])
            known = seed[np.minimum(ahead + common // width, m - 1)].astype(np.int64) - seed[ahead]
            put(seed[number].astype(np.int64), seed[ahead].astype(np.int64), known)
            before = number[-1]
        del order, prefix, digits
    sort.up(again, True)
    sort.down(True)
    return sort.order, sort.prefix[:n]
