"""Byte-level BPE encoding and decoding with a given vocabulary.

A short word is a contiguous array of parts next to the ranks of adjacent pairs: scan for the
minimum, delete that boundary, refresh the two ranks beside it.  Long runs, where scanning
would be quadratic, use the same order from a heap.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gleanframe.llm.rows import kept, map_steps, picked, texts

# fixed value: how text splits into words before merging
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# bytes up to which a word is scanned, and up to which words of equal width advance together
SHORT, _TOGETHER = 200, 48
# bytes of text whose distinct words are encoded at a time; the arrays then stay in cache
STEP_BYTES = 2 << 20
_NONE, _TABLE = 1 << 40, 1 << 19
_LETTER, _NUMBER, _SPACE, _BLANK = 1, 2, 3, 4


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary's text form."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _distinct(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each distinct word, number of the distinct word of each row) of words of one width."""
    n, width = words.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = words
    lanes = padded.view(np.uint64)
    key = lanes[:, 0].copy()
    for i in range(1, lanes.shape[1]):
        key ^= key >> np.uint64(29)
        key = key * np.uint64(0x9E3779B97F4A7C15) + lanes[:, i]
    _, rows, inverse = np.unique(key, return_index=True, return_inverse=True)
    if lanes.shape[1] > 1:
        # words that only share the mixed key stand alone
        apart = np.flatnonzero((lanes != lanes[rows[inverse]]).any(1))
        inverse[apart] = len(rows) + np.arange(len(apart))
        rows = np.append(rows, apart)
    return rows, inverse


class Vocabulary:
    """Pair ranks and token bytes of a tokenizer file."""

    def __init__(self, content: str):
        spec = json.loads(content)
        letters = byte_letters()
        model = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes: dict[int, bytes] = {i: bytes(letters[c] for c in token) for token, i in model.items()}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.of_byte = [0] * 256
        for letter, b in letters.items():
            self.of_byte[b] = model[letter]
        # (left id, right id) in one integer -> rank; the merged id by rank
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks[model[left] << 32 | model[right]] = rank
            self.merged.append(model[left + right])
        self.merged_ids = np.array(self.merged or [0], np.int64)
        self.byte_ids = np.array(self.of_byte, np.int64)
        self.pair_keys, self.pair_ranks = np.full(_TABLE, -1, np.int64), np.zeros(_TABLE, np.int64)
        for key, rank in self.ranks.items():
            at = ((key >> 32) * 0x9E3779B1 + (key & 0xFFFFFFFF) * 0x85EBCA77) >> 7 & _TABLE - 1
            while self.pair_keys[at] >= 0:
                at = at + 1 & _TABLE - 1
            self.pair_keys[at], self.pair_ranks[at] = key, rank
        self.byte_pair_ranks = self._rank(
            np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256)
        ).reshape(256, 256)
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        self.kinds = np.zeros(0x110000, np.uint8)
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                self.kinds[ord(m[0][0]):ord(m[0][-1]) + 1] = kind
        self.kinds[0xD800:0xE000] = 0
        self.kinds[32] = _BLANK

    def word(self, data: bytes) -> list[int]:
        """Token ids of one word."""
        ids = [self.of_byte[b] for b in data]
        if len(ids) > SHORT:
            return self._long(ids)
        get, merged = self.ranks.get, self.merged
        near = [get(ids[i] << 32 | ids[i + 1], _NONE) for i in range(len(ids) - 1)]
        while near:
            least = min(near)
            if least == _NONE:
                break
            at = near.index(least)
            ids[at:at + 2] = [merged[least]]
            del near[at]
            if at:
                near[at - 1] = get(ids[at - 1] << 32 | ids[at], _NONE)
            if at < len(near):
                near[at] = get(ids[at] << 32 | ids[at + 1], _NONE)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = self.merged[rank], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := get(ids[a] << 32 | ids[b])) is not None:
                    heapq.heappush(heap, (r, a, ids[a], ids[b]))
        return [i for i in ids if i >= 0]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, by open addressing in a table that is nine tenths empty."""
        key = left << 32 | right
        at = (left * 0x9E3779B1 + right * 0x85EBCA77) >> 7 & _TABLE - 1
        found = self.pair_keys[at]
        rank = np.where(found == key, self.pair_ranks[at], _NONE)
        again = np.flatnonzero((found != key) & (found >= 0))
        while len(again):
            at[again] = at[again] + 1 & _TABLE - 1
            found = self.pair_keys[at[again]]
            hit = found == key[again]
            rank[again[hit]] = self.pair_ranks[at[again[hit]]]
            again = again[~hit & (found >= 0)]
        return rank

    def _merge(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids) of words of one width, a row each; every round merges once in each word."""
        n, width = data.shape
        out, size = np.zeros((n, width), np.uint32), np.full(n, width)
        ids = self.byte_ids[data]
        if width == 1:
            out[:] = ids
            return out, size
        near = self.byte_pair_ranks[data[:, :-1], data[:, 1:]]
        live, columns = np.arange(n), np.arange(width)
        while True:
            at = near.argmin(1)
            rows = np.arange(len(live))
            least = near[rows, at]
            done = least == _NONE
            if done.any():
                out[live[done], :ids.shape[1]] = ids[done]
                go = np.flatnonzero(~done)
                live, ids, near, at, least, rows = live[go], ids[go], near[go], at[go], least[go], rows[:len(go)]
            if not len(live):
                return out, size
            size[live] -= 1
            # delete the boundary after the part ``at``
            shift = columns[:-1] > at[:, None]
            ids = np.where(shift, ids[:, 1:], ids[:, :-1])
            ids[rows, at] = self.merged_ids[least]
            if ids.shape[1] == 1:
                out[live, 0] = ids[:, 0]
                return out, size
            near = np.where(columns[:-2] >= at[:, None], near[:, 1:], near[:, :-1])
            columns = columns[:-1]
            # refresh the ranks beside it; rows end in parts that repeat the last one, with no rank
            for beside in (at - 1, at):
                inside = np.flatnonzero((beside >= 0) & (beside + 1 < ids.shape[1]))
                where = beside[inside]
                near[inside, where] = self._rank(ids[inside, where], ids[inside, where + 1])

    def _starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where words start, by the rules of ``WORDS``; ``first`` marks the start of each text."""
        kind = self.kinds[points]
        space = kind >= _SPACE
        follows = ~first[1:]  # position i + 1 belongs to the text of i
        run = first.copy()
        run[1:] |= kind[1:] != kind[:-1]
        # a blank belongs to the word after it
        glued = np.zeros(len(points), bool)
        glued[:-1] = (kind[:-1] == _BLANK) & ~space[1:] & follows
        start = run & ~space
        start[1:] &= ~glued[:-1]
        # white space: where its run starts, and its last character if a word follows
        begins = first.copy()
        begins[1:] |= ~space[:-1]
        last = np.zeros(len(points), bool)
        last[:-1] = ~space[1:] & follows
        start |= space & (begins | last)
        marks = np.flatnonzero(start & (points == 39))
        if len(marks):
            ends = np.append(np.flatnonzero(first), len(points))
            room = ends[np.searchsorted(ends, marks, "right")] - marks
            def letter(i):
                return np.where(room > i, points[np.minimum(marks + i, len(points) - 1)], 0)
            one, two = letter(1), letter(2)
            short = np.isin(one, [115, 116, 109, 100])
            long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
            start[marks[short | long] + 1] = False
            for some, width in ((short, 2), (long, 3)):
                after = marks[some & (room > width)] + width
                start[after[kind[after] == _LETTER]] = True
        return np.flatnonzero(start)

    def _segments(self, segments: list[str]) -> list[bytes]:
        """Packed ids of texts that are not empty and hold no special token."""
        if not segments:
            return []
        joined = "".join(segments)
        data = np.frombuffer(joined.encode(), np.uint8)
        if len(data) == len(joined):
            points, offset = data, np.arange(len(data) + 1)
        else:
            points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            offset = np.zeros(len(points) + 1, np.int64)
            np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), out=offset[1:])
        first = np.zeros(len(points), bool)
        begin = np.cumsum([0, *map(len, segments[:-1])])
        first[begin] = True
        starts = self._starts(points, first)
        at = offset[starts]
        width = np.diff(np.append(at, len(data)))
        count, groups = np.empty(len(at), np.int64), []
        class_of = np.minimum(width, _TOGETHER + 1).astype(np.uint8)
        order = np.argsort(class_of, kind="stable")
        edges = np.flatnonzero(np.diff(class_of[order])) + 1
        for which in np.split(order, edges):
            w = int(class_of[which[0]])
            if w > _TOGETHER:
                spans = zip(at[which].tolist(), width[which].tolist())
                found = [self.word(data[i:i + n].tobytes()) for i, n in spans]
                count[which] = [len(f) for f in found]
                groups.append((which, found, None))
                continue
            words = data[at[which][:, None] + np.arange(w)]
            distinct, inverse = _distinct(words)
            ids, size = self._merge(words[distinct])
            count[which] = size[inverse]
            groups.append((which, ids, inverse))
        to = np.zeros(len(at) + 1, np.int64)
        np.cumsum(count, out=to[1:])
        out = np.empty(to[-1], np.uint32)
        for which, ids, inverse in groups:
            if inverse is None:
                for i, found in zip(which.tolist(), ids):
                    out[to[i]:to[i + 1]] = found
                continue
            place, size, some = to[which], count[which], inverse
            for j in range(ids.shape[1]):
                if j:
                    more = np.flatnonzero(size > j)
                    place, size, some = place[more], size[more], some[more]
                out[place + j] = ids[some, j]
                if not len(some):
                    break
        cuts = to[np.append(np.searchsorted(starts, begin), len(starts))].tolist()
        return [out[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, batch: list[str]) -> list[bytes]:
        """Packed ids of every text; the distinct words of all texts are encoded once."""
        plans: list[list[str]] = []
        for text in batch:
            special = self.split is not None and any(s in text for s in self.special)
            plans.append([p for p in (self.split.split(text) if special else (text,)) if p])
        done = iter(self._segments([p for plan in plans for p in plan if p not in self.special]))
        return [
            b"".join(array("I", [self.special[p]]).tobytes() if p in self.special else next(done) for p in plan)
            for plan in plans
        ]

    def decode(self, ids: bytes) -> str:
        """Text of packed ids; bytes that are no UTF-8 become replacement marks."""
        return b"".join(map(self.bytes.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


def load(content: str) -> Vocabulary:
    """The vocabulary of a tokenizer file's text, once per Python worker."""
    return kept(("bpe", hashlib.sha256(content.encode()).hexdigest()), lambda: Vocabulary(content))


def vocabulary_text(path: str) -> str:
    """Content of a byte-level tokenizer file: a few megabytes, broadcast once."""
    with open(path, encoding="utf-8") as f:
        content = f.read()
    if json.loads(content)["model"]["type"] != "BPE":
        raise ValueError(f"{path} holds no BPE vocabulary")
    return content


def encode(df: DataFrame, vocabulary: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids binary, decoded string): ids as little-endian unsigned 32-bit integers.

    ``vocabulary`` is the path of a tokenizer file.  Special tokens in a text become their one
    id.  Null and empty texts have no ids; an empty table gives an empty one; rows are
    independent, so repeated ones are encoded alike.
    """
    sent = df.sparkSession.sparkContext.broadcast(vocabulary_text(vocabulary))

    def run(columns):
        vocab = load(sent.value)
        packed = vocab.encode_all(texts(columns[text]))
        return (
            columns[key], [len(p) // 4 for p in packed], pa.array(packed, pa.binary()),
            [vocab.decode(p) for p in packed],
        )

    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens bigint, ids binary, decoded string"
    return map_steps(picked(df, [key, text]), run, schema, STEP_BYTES)
