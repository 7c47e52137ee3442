"""Best-fit packing of tokenized documents into sequences of fixed length, by bin completion with branch and bound.

Documents are tokenized in Spark tasks (ids by the tokenizer, without special tokens, then the end id) and cut where they are longer than
a sequence. All that packing needs to know is how many pieces there are of each length: at most `length` numbers, whatever the input. So
these are packed as they are, every kind of sequence once with the number of its repeats, and the pieces then look up their places by
their number among those of their length. No part of the corpus is packed apart from the rest, and no task holds more than its batch.

Best fit by decreasing length gives the first solution. Where it needs more sequences than the lower bound, bin completion takes the largest
piece left, lists the undominated ways to fill its sequence, fullest first, puts each to use as often as there are pieces for it, or less
often, and gives up branches that waste more than a better solution may, or that have led to the same pieces left before. The search ends
when the bound is met, when all branches have been seen (then no fewer sequences are possible), or after STEPS steps.

Nulls and edges: a null text is empty, an empty text has the end id alone; null ids are carried; repeated rows are packed one by one; very
long texts become many pieces; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import random
import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvlake.llm import arrays as A
from kvlake.llm.store import cut

LENGTH = 4_096
END_ID = 1
#: Steps after which the search for fewer sequences ends: its time is bounded, and the best solution so far stays.
STEPS = 20_000
#: Units that are encoded as one text.
LOT = 50
#: Words (about 50 bytes each) and units of words (about 200 bytes) whose ids a worker remembers: beyond that it keeps half of the words, and no unit.
WORDS, UNITS = 600_000, 100_000
#: Bytes of these words and of their ids, beyond which a worker keeps half of them as well: words may be long.
WORDS_BYTES = 64_000_000
#: Words that are looked up at once.
WORDS_AT_ONCE = 100_000

#: Last nodes of the search that keep the rest of their ways; those above make them anew when the search comes back.
OPEN = 50

#: number of sequences, and how many pieces of each length one of them holds
Kind = tuple[int, dict[int, int]]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of [first, first + size), one range after the other."""
    to = np.cumsum(size)
    return np.repeat(first - to + size, size) + np.arange(to[-1] if len(to) else 0)


class Tokens:
    """The ids of texts; those of words (bytes between ASCII white space) are remembered, if the tokenizer treats words independently.

    The words that are known, some 50 bytes each, stand in arrays and are found by 64-bit hashes, many at a time. Every word is then compared
    with the known one, byte by byte: where hashes meet, the texts at hand are encoded whole.

    How words fall into units is read from the tokenizer's file: composed, lower-case words are split by its pattern, and the ids of a unit end
    with the one that has the suffix for ends of words. New units are encoded many at a time. Words with characters beyond Latin, whose
    composing and lower case are the tokenizer's own affair, and words that hold a special token are encoded as they are. A file with other
    parts is not read so, and whether the reading gives the ids of whole texts is tried with PROBE; if not, texts are encoded whole.
    """

    PROBE = "It's 12.5% of  naïve Ünï\tcode:\n'tis x_y -- don't A.B, (c) 日本 é <b>I'LL</b>  #tag\r\n ... '' 's ré a\u0301 \u0301x ΑΣ <|x|>"
    #: What makes a word be encoded as it is: any but printable ASCII and Latin letters, and the beginning of a special token.
    ODD = re.compile(r"[^\n!-~À-ÖØ-öø-ɏ]|<\|")
    #: Stands between words; no id has these bytes at any offset, as ids are below 2**24.
    BREAK = b"\xff" * 8

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.key, self.entry = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)  # hashes in order, and where in the others each word is
        self.letters, self.letters_to = np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
        self.held, self.held_to = np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64)
        self.met = np.zeros(0, dtype=np.int32)
        self.units: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        pattern, suffix = self._parts(held), held["model"].get("end_of_word_suffix")
        self.by_word = False
        if pattern and suffix:
            self.split = regex.compile(r"\n|" + pattern)
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
            self.by_word = self._by_word([self.PROBE.encode()]) == [self._encode(self.PROBE)]

    @staticmethod
    def _parts(held: dict) -> str | None:
        """The pattern of units, if the file composes, puts blanks for white space, lowers, and keeps what a pattern finds."""
        steps = (held.get("normalizer") or {}).get("normalizers", [])
        splits = (held.get("pre_tokenizer") or {}).get("pretokenizers", [])
        special = all(t["content"].startswith("<|") and t["special"] for t in held.get("added_tokens", []))
        if [x["type"] for x in steps] != ["NFC", "Replace", "Lowercase"] or steps[1]["pattern"].get("Regex") != r"\s+" or steps[1]["content"] != " " or not special:
            return None
        if [x["type"] for x in splits] != ["Split", "ByteLevel"] or splits[0]["behavior"] != "Removed" or not splits[0]["invert"] or splits[1]["add_prefix_space"]:
            return None
        return splits[0]["pattern"].get("Regex")

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn_units(self, units: list[str]) -> None:
        lots = [units[i : i + LOT] for i in range(0, len(units), LOT)]
        for some, encoded in zip(lots, self.tokenizer.encode_batch_fast([" ".join(x) for x in lots], add_special_tokens=False), strict=True):
            ids = np.array(encoded.ids, dtype="<u4")
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(some) and last[-1] == len(ids):
                held, first = ids.tobytes(), 0
                for unit, end in zip(some, (last * 4).tolist(), strict=True):
                    self.units[unit] = held[first:end]
                    first = end
            else:
                self.units.update((unit, self._encode(unit)) for unit in some)

    def _learn(self, new: list[bytes]) -> list[bytes]:
        """The ids of words that aren't known."""
        if len(self.units) > UNITS:
            self.units.clear()
        of: dict[bytes, bytes] = {}
        plain = new
        text = b"\n".join(plain).decode()
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.ODD.search(text):
            of = {w: self._encode(w.decode()) for w in new if self.ODD.search(unicodedata.normalize("NFC", w.decode()))}
            plain = [w for w in new if w not in of]
            text = unicodedata.normalize("NFC", b"\n".join(plain).decode())
        if plain:
            units = self.split.findall(text.lower())
            self.units["\n"] = self.BREAK
            self._learn_units(list(set(units).difference(self.units)))
            of.update(zip(plain, b"".join(map(self.units.__getitem__, units)).split(self.BREAK), strict=True))
        return [of[w] for w in new]

    def _forget(self) -> None:
        """Keeps the half of the words that was met in most lots."""
        n = len(self.met)
        keep = np.zeros(n, dtype=bool)
        keep[np.argsort(self.met, kind="stable")[(n + 1) // 2 :]] = True
        for name in ("letters", "held"):
            to = getattr(self, f"{name}_to")
            size = np.diff(to)
            setattr(self, name, getattr(self, name)[np.repeat(keep, size)])
            setattr(self, f"{name}_to", np.append(0, np.cumsum(size[keep])))
        known = keep[self.entry]
        self.key, self.entry = self.key[known], (np.cumsum(keep, dtype=np.int32) - 1)[self.entry[known]]
        self.met = self.met[keep] // 2

    def _ids_of(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of all words, and how many each has; None where two words have one hash."""
        if len(self.key) > WORDS or self.letters.nbytes + self.held.nbytes > WORDS_BYTES:
            self._forget()
        key, one, of = np.unique(A.word_hashes(data, begin, end), return_index=True, return_inverse=True)
        at = np.searchsorted(self.key, key)
        unknown = np.ones(len(key), dtype=bool)
        inside = at < len(self.key)
        unknown[inside] = self.key[at[inside]] != key[inside]
        if unknown.any():
            text, first = data.tobytes(), one[unknown]
            words = [text[i:j] for i, j in zip(begin[first].tolist(), end[first].tolist(), strict=True)]
            ids = self._learn(words)
            self.key = np.insert(self.key, at[unknown], key[unknown])
            self.entry = np.insert(self.entry, at[unknown], np.arange(len(self.met), len(self.met) + len(words), dtype=np.int32))
            self.letters = np.append(self.letters, np.frombuffer(b"".join(words), dtype=np.uint8))
            self.letters_to = np.append(self.letters_to, self.letters_to[-1] + np.cumsum([len(w) for w in words]))
            self.held = np.append(self.held, np.frombuffer(b"".join(ids), dtype="<u4"))
            self.held_to = np.append(self.held_to, self.held_to[-1] + np.cumsum([len(x) // 4 for x in ids]))
            self.met = np.append(self.met, np.zeros(len(words), dtype=np.int32))
            at = np.searchsorted(self.key, key)
        entry = self.entry[at]
        self.met[entry] += 1
        entry, size = entry[of], end - begin
        first = self.letters_to[entry]
        if not np.array_equal(self.letters_to[entry + 1] - first, size) or not np.array_equal(self.letters[ranges(first, size)], data[A.SPACED[data]]):
            return None
        first = self.held_to[entry]
        number = self.held_to[entry + 1] - first
        return self.held[ranges(first, number)], number

    def _by_word(self, texts: list[bytes]) -> list[bytes]:
        data, bounds = np.frombuffer(b"".join(texts), dtype=np.uint8), np.append(0, np.cumsum([len(t) for t in texts], dtype=np.int64))
        begin, end, doc = A.words(data, bounds, A.SPACED)
        parts, numbers = [b""], [np.zeros(0, dtype=np.int64)]
        for i in range(0, len(begin), WORDS_AT_ONCE):
            j = min(i + WORDS_AT_ONCE, len(begin))
            found = self._ids_of(data[begin[i] : end[j - 1]], begin[i:j] - begin[i], end[i:j] - begin[i])
            if found is None:
                return [self._encode(text.decode()) for text in texts]
            parts.append(found[0].tobytes())
            numbers.append(found[1])
        ids = b"".join(parts)
        to = 4 * np.append(0, np.cumsum(np.concatenate(numbers)))[np.searchsorted(doc, np.arange(len(texts) + 1))]
        return [ids[a:b] for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        return self._by_word(texts) if self.by_word else [self._encode(text.decode()) for text in texts]


_TOKENS: dict[str, Tokens] = {}


def pieces(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, task, nth (a piece's number among those of its length in its task) for every row of docs, without a shuffle."""
    kind = dict(docs.dtypes)["doc_id"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        path = tokenizer or default_tokenizer()
        if path not in _TOKENS:
            _TOKENS[path] = Tokens(path)
        tokens, task, seen = _TOKENS[path], TaskContext.get().partitionId(), np.zeros(length + 1, dtype=np.int64)
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            for i, j, data, bounds in A.texts(batch["text"]):
                row, piece, start, size, crc = [], [], [], [], []
                held = data.tobytes()
                for k, ids in enumerate(tokens.ids([held[bounds[k] : bounds[k + 1]] for k in range(j - i)])):
                    ids += end
                    for n, at in enumerate(range(0, len(ids), 4 * length)):
                        part = ids[at : at + 4 * length]
                        row.append(k)
                        piece.append(n)
                        start.append(at // 4)
                        size.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                sizes = np.array(size, dtype=np.int64)
                by = np.argsort(sizes, kind="stable")
                of = sizes[by]
                nth = np.empty(len(of), dtype=np.int64)
                nth[by] = seen[of] + np.arange(len(of)) - np.searchsorted(of, of)
                seen += np.bincount(sizes, minlength=length + 1)
                ids_of = batch["doc_id"].slice(i, j - i).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids_of, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(sizes), pa.array(crc, pa.int64()), pa.array([task] * len(row), pa.int32()), pa.array(nth)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"],
                )

    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, nth long")


def lower_bound(counts: dict[int, int], length: int) -> int:
    """The least number of sequences that any packing can do with: pieces too large to share a sequence, and what the others need beside their room."""
    sizes = np.array(sorted(counts), dtype=np.int64)
    numbers = np.array([counts[s] for s in sizes.tolist()], dtype=np.int64)
    pieces_to, sum_to = np.append(0, np.cumsum(numbers)), np.append(0, np.cumsum(sizes * numbers))
    half = np.searchsorted(sizes, length // 2, "right")
    least = np.append(0, sizes[:half])  # smaller pieces are left out of account, and those that could only share with them stand alone
    shared = np.searchsorted(sizes, length - least, "right")
    small = sum_to[half] - sum_to[np.searchsorted(sizes, least)]
    room = (pieces_to[shared] - pieces_to[half]) * length - (sum_to[shared] - sum_to[half])
    return max(-(-int(sum_to[-1]) // length), int(np.max(pieces_to[-1] - pieces_to[half] + np.maximum(0, -(-(small - room) // length)))))


def best_fit(counts: dict[int, int], length: int) -> list[Kind]:
    """Best fit by decreasing size, each piece to the fullest sequence that has room: equal sequences are filled as one."""
    done: list[Kind] = []
    kinds: list[Kind] = []
    open_: list[tuple[int, int]] = []  # room and number of a kind

    def put(n: int, held: dict[int, int], room: int) -> None:
        if n:
            kinds.append((n, held))
            insort(open_, (room, len(kinds) - 1)) if room else done.append(kinds[-1])

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect_left(open_, (size, -1))
            room, number = open_.pop(at) if at < len(open_) else (length, -1)
            n, held = kinds[number] if number >= 0 else (left, {})
            each = room // size
            full = min(n, left // each)
            put(full, {**held, size: each}, room - each * size)
            left -= full * each
            if full < n and left:
                put(1, {**held, size: left}, room - left * size)
                left, full = 0, full + 1
            if number >= 0:
                put(n - full, held, room)
    return done + [kinds[k] for _, k in open_]


@dataclass(slots=True)
class Node:
    """A step of the search: a number of equal sequences, the room that each leaves, and the ways to fill one that are still to be tried."""

    times: int = 0
    room: int = 0
    held: dict[int, int] = field(default_factory=dict)
    ways: Iterator[tuple[int, dict[int, int]]] | None = None
    taken: int = 0


def reach(sizes: list[int], counts: list[int], room: int) -> list[int]:
    """For each sum up to room the last place in sizes, from which on the pieces can make it exactly; -1 where none can."""
    last = np.full(room + 1, -1, dtype=np.int64)
    last[0] = len(sizes)
    every = (2 << room) - 1
    made = 1  # bit t: the sum t can be made
    for k in range(len(sizes) - 1, -1, -1):
        if (made ^ every).bit_length() <= sizes[k]:
            break  # what is missing is less than the pieces that are left
        before, n, part = made, min(counts[k], room // sizes[k]), 1
        while n > 0:
            made |= made << min(part, n) * sizes[k] & every
            n, part = n - part, 2 * part
        if made != before:
            new = np.frombuffer((made ^ before).to_bytes(room // 8 + 1, "little"), dtype=np.uint8)
            last[np.flatnonzero(np.unpackbits(new, bitorder="little"))] = k
    return last.tolist()


def fillings(counts: dict[int, int], room: int, most_left: int, steps: list[int]) -> Iterator[tuple[int, dict[int, int]]]:
    """(room left, pieces of each size) of the undominated ways to fill a room that leave at most most_left, fullest first, each when it is asked for.

    A way is dominated if a piece left out could take the place of some of its pieces that are together smaller, or of nothing. Sums that
    cannot be made are known beforehand, so no step is lost on them.
    """
    sizes = sorted((s for s in counts if s <= room), reverse=True)
    number = [counts[s] for s in sizes]
    last = reach(sizes, number, room)

    def dominated(left: int, chosen: dict[int, int]) -> bool:
        sums = 1  # bit t: some of the chosen pieces have size t together
        for s, n in chosen.items():
            for _ in range(n):
                sums |= sums << s
        return any((sums >> max(x - left, 0)) & ((1 << min(left, x)) - 1) for x in counts if chosen.get(x, 0) < counts[x])

    def exact(total: int) -> Iterator[dict[int, int]]:
        """The ways to make a sum: larger pieces first, and as many of them as can be."""
        chosen: list[tuple[int, int]] = []
        left, k, most = total, 0, total
        while steps[0] > 0:
            while left and last[left] >= k:
                if sizes[k] > left:
                    k, most = bisect_left(sizes, -left, key=lambda s: -s), left
                n = next((n for n in range(min(number[k], left // sizes[k], most), 0, -1) if last[left - n * sizes[k]] > k), 0)
                if n:
                    steps[0] -= 1
                    chosen.append((k, n))
                    left -= n * sizes[k]
                k, most = k + 1, left
            if not left:
                yield {sizes[i]: n for i, n in chosen}
            if not chosen:
                return
            k, n = chosen.pop()
            left, most = left + n * sizes[k], n - 1

    for left in range(min(room, most_left) + 1):
        if last[room - left] >= 0:
            yield from ((left, chosen) for chosen in exact(room - left) if not left or not dominated(left, chosen))


def complete(counts: dict[int, int], length: int, steps: int = STEPS) -> list[Kind]:
    """Kinds of sequences that hold all pieces: best fit, improved by bin completion where the lower bound leaves room for fewer sequences.

    The search goes depth first over one table of the pieces left, which is put back on the way back; what was left before is known by
    128 bits. So its memory grows with the depth and the steps, by some hundred bytes each, and not with the number of lengths for each branch.
    """
    best = best_fit(counts, length)
    total, bound, budget = sum(s * n for s, n in counts.items()), lower_bound(counts, length), [steps]
    bits = random.Random(0)
    mark = {s: bits.getrandbits(128) for s in counts}

    def fewer(target: int) -> list[Kind] | None:
        """A packing into `target` sequences, if the search meets one."""
        allowed = target * length - total
        left, waste, key = dict(counts), 0, 0
        seen: dict[int, int] = {}
        path: list[Node] = []

        def put(node: Node, sign: int) -> None:
            """Takes a node's sequences from the pieces left, or puts them back."""
            nonlocal waste, key
            for s, n in node.held.items():
                left[s] = left.get(s, 0) - sign * node.times * n
                if not left[s]:
                    del left[s]
                key = (key + sign * node.times * n * mark[s]) % 2**128
            waste += sign * node.times * node.room

        reached = True  # a state that was not looked at yet
        while budget[0] > 0:
            budget[0] -= 1
            if reached and not left:
                return [(node.times, node.held) for node in path]
            if reached and seen.get(key, allowed + 1) > waste:
                seen[key] = waste
                path.append(Node())
                if len(path) > OPEN:
                    path[-OPEN - 1].ways = None
            if not path:
                return None
            node, reached = path[-1], True
            put(node, -1)
            node.times -= 1
            if node.times <= 0:
                node.times = 0
                largest = max(left)
                if node.ways is None:
                    rest = {s: n - (s == largest) for s, n in left.items() if n > (s == largest)}
                    node.ways = islice(fillings(rest, length - largest, allowed - waste, budget), node.taken, None)
                way = next(node.ways, None)
                if way is None:
                    path.pop()
                    reached = False
                    continue
                node.room, chosen = way
                node.taken += 1
                node.held = {**chosen, largest: chosen.get(largest, 0) + 1}
                node.times = min(left[s] // n for s, n in node.held.items())
                if node.room:
                    node.times = min(node.times, (allowed - waste) // node.room)
            put(node, 1)
        return None

    while (n := sum(k for k, _ in best)) > bound:
        better = fewer(n - 1)
        if better is None:
            break
        best = better
    return best


class Places:
    """Where the pieces of each length go, by their number among those of their length."""

    def __init__(self, kinds: list[Kind]):
        rows, first, taken = [], 0, {}
        for n, held in kinds:
            at = 0
            for size in sorted(held, reverse=True):
                rows.append((size, taken.get(size, 0), held[size], first, at))
                taken[size] = taken.get(size, 0) + n * held[size]
                at += size * held[size]
            first += n
        table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
        self.key, self.since, self.each, self.first, self.at = (table[:, 0] << 40) + table[:, 1], *table[:, 1:].T

    def of(self, size: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset."""
        k = np.searchsorted(self.key, (size << 40) + number, "right") - 1
        n = number - self.since[k]
        return self.first[k] + n // self.each[k], self.at[k] + n % self.each[k] * size


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row."""
    items = cut(pieces(docs, tokenizer, length, end_id))
    places = Places(complete({r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}, length))
    by_task = items.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = items.join(by_task.select("length", "task", before.alias("before")), ["length", "task"])
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.of(batch["length"].to_numpy(), batch["number"].to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    kind = dict(docs.dtypes)["doc_id"]
    return numbered.select(*columns, (F.col("nth") + F.col("before")).alias("number")).mapInArrow(rows, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
