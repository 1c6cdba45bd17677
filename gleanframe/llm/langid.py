"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts up to ``ORDER`` long.  A byte costs what its longest
kept context says, where a context that has not seen the byte escapes to its suffix and leaves
out the bytes it has seen.  The statistics are frozen after fitting, so the costs of every
context and byte are worked out once, and a text's exact code length is a sum of table entries.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from gleanframe.llm.rows import Sent, kept, map_steps, picked, text_bytes
from gleanframe.operators.columns import ident

ORDER = 3
# distinct texts per language that the trees are fitted on, chosen by a hash of the text (expected
# number), and of all languages together
SAMPLE, SAMPLE_IN_ALL = 5_000, 320_000
# occurrences from which a context is kept, and bytes of the table of costs; with many languages
# a context must have been seen more often
CONTEXT_SEEN, TABLE_BYTES = 8, 64 << 20
_LETTER = r"\p{L}"


def symbols(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, start of each): lower case, every run of ASCII non-letters one blank.

    Three zero bytes go before each text, so that no context reaches into the text before.
    """
    folded = [b"\0\0\0" + t.decode().lower().replace("\0", " ").encode() for t in contents]
    data = np.frombuffer(b"".join(folded), np.uint8)
    table = np.arange(256, dtype=np.uint8)
    table[1:128] = 32
    table[97:123] = np.arange(97, 123)
    data = table[data]
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    starts = np.cumsum([0, *map(len, folded)])[:-1]
    before = np.concatenate([[0], np.cumsum(keep)])
    return data[keep], before[starts]


def _grams(data: np.ndarray) -> np.ndarray:
    """Each byte with the three before it, as one integer; starts of texts are left out."""
    wide = data.astype(np.uint32)
    grams = wide[3:] | wide[2:-1] << np.uint32(8) | wide[1:-2] << np.uint32(16) | wide[:-3] << np.uint32(24)
    return grams[data[3:] != 0]


@dataclass
class Trees:
    """Counts of (three bytes of context, byte) per language, small enough to broadcast."""

    languages: list[str]
    # language number, context and byte, count
    counts: tuple[np.ndarray, np.ndarray, np.ndarray]


class Costs:
    """Bits of every byte in every kept context under each language."""

    def __init__(self, trees: Trees, table_bytes: int = TABLE_BYTES):
        which, grams, counts = trees.counts
        languages = max(1, len(trees.languages))
        context = np.stack([grams >> np.uint32(8 * i) & np.uint32(255) for i in range(ORDER + 1)])
        present = np.unique(np.concatenate([context.ravel(), [0, 32]]))
        # class 0 stands for any one byte never seen
        self.classes = np.zeros(256, np.int64)
        self.classes[present] = np.arange(1, len(present) + 1)
        size = len(present) + 1
        weight = np.ones(size)
        weight[0] = 256 - len(present)
        seen = self.classes[context]
        self.size, self.rows = size, np.zeros(size ** ORDER, np.int32)
        most = max(1, table_bytes // (4 * size * languages))
        least = CONTEXT_SEEN
        while self._contexts(seen, counts, least) > most and least < 1 << 40:
            least *= 2
        # root: the context without bytes, its parent the uniform choice of a byte
        below = np.full((1, languages, size), 1 / 256)
        of_code = np.zeros(1, np.int64)  # row of each context of the order before
        tables, total = [], 0
        for order in range(ORDER + 1):
            code = np.zeros(len(grams), np.int64)
            for i in range(order, 0, -1):
                code = code * size + seen[i]
            found, row = np.unique(code, return_inverse=True)
            often = np.bincount(row, counts, len(found)) >= (least if order else 0)
            if order == 0 and not len(found):
                found, often = np.zeros(1, np.int64), np.ones(1, bool)
            kept_codes = found[often]
            parent = of_code[kept_codes % size ** (order - 1)] if order else np.zeros(len(kept_codes), np.int64)
            number = np.full(len(found), -1)
            number[often] = np.arange(len(kept_codes))
            use = number[row] >= 0 if len(row) else np.zeros(0, bool)
            tally = np.zeros((len(kept_codes), languages, size))
            np.add.at(tally, (number[row[use]], which[use], seen[0][use]), counts[use])
            flat = np.concatenate(tables) if tables else below
            above = flat[parent]
            n, kinds = tally.sum(2, keepdims=True), (tally > 0).sum(2, keepdims=True)
            unseen = (np.where(tally > 0, 0, above) * weight).sum(2, keepdims=True)
            escape = np.where(unseen > 0, kinds / np.maximum(2 * n, 1), 0)
            fresh = escape * above / np.maximum(unseen, 1e-300)
            known = (2 * tally - 1) / np.maximum(2 * n, 1) / np.where(unseen > 0, 1, 1 - kinds / np.maximum(2 * n, 2))
            here = np.where(n > 0, np.where(tally > 0, known, fresh), above)
            tables.append(here)
            # contexts of this order that are not kept use the row of their suffix
            rows = np.tile(of_code, size) if order else np.zeros(1, np.int64)
            rows[kept_codes] = total + np.arange(len(kept_codes))
            of_code, total = rows, total + len(kept_codes)
        self.rows = of_code.astype(np.int32)
        bits = -np.log2(np.concatenate(tables))
        self.bits = np.ascontiguousarray(bits.transpose(0, 2, 1).reshape(-1, languages), np.float32)

    def _contexts(self, seen: np.ndarray, counts: np.ndarray, least: int) -> int:
        """Contexts of all orders that were seen so often."""
        n, code = 1, np.zeros(seen.shape[1], np.int64)
        for order in range(1, ORDER + 1):
            code = code + seen[order] * self.size ** (order - 1)
            n += int((np.bincount(np.unique(code, return_inverse=True)[1], counts) >= least).sum()) if len(code) else 0
        return n

    def lengths(self, contents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(bits of each text under each language, its number of coded bytes)."""
        data, starts = symbols(contents)
        x = self.classes.astype(np.int32)[data]
        code = (x[:-3] * self.size + x[1:-2]) * self.size + x[2:-1]
        at = np.concatenate([np.zeros(3, np.int64), self.rows[code] * np.int64(self.size) + x[3:]])
        real = data != 0
        n = np.add.reduceat(real.astype(np.int64), starts)
        bits = np.stack([
            np.add.reduceat(np.where(real, self.bits[at, i], 0).astype(np.float64), starts)
            for i in range(self.bits.shape[1])
        ], 1)
        return bits, n


def fit(
    df: DataFrame, *, text: str = "text", label: str = "lang", sample: int = SAMPLE,
) -> Trees:
    """Trees of the rows with a text and a label, for any number of languages.

    About ``sample`` distinct texts a language are drawn by a hash of the text, fewer where there
    are more than 64 languages, so that SAMPLE_IN_ALL bounds them all.  Copies and repeated rows
    count once.  Without any such row the trees know no language.
    """
    rows = df.select(ident(label).cast("string").alias("label"), ident(text).alias("text")).dropna()
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    languages = sorted(r["label"] for r in sizes.select("label").collect())
    place = {label: i for i, label in enumerate(languages)}
    wanted = min(sample, max(1, SAMPLE_IN_ALL // max(1, len(languages))))
    # a few numbers per language
    share = sizes.select(F.col("label").alias("__label"), F.least(F.lit(1.0), F.lit(wanted) / F.col("n")).alias("share"))
    drawn = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.lit(1 << 30) * F.col("share")
    chosen = rows.join(F.broadcast(share), F.col("label") == F.col("__label")).where(drawn).select("label", "text").distinct()

    def count(columns):
        which, grams, counts = [], [], []
        labels = np.array([place[x] for x in columns["label"].to_pylist()], int)
        contents = text_bytes(columns["text"])
        for i in np.unique(labels):
            found, n = np.unique(_grams(symbols([contents[j] for j in np.flatnonzero(labels == i)])[0]), return_counts=True)
            which.append(np.full(len(found), i))
            grams.append(found)
            counts.append(n)
        return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (which, grams, counts)]

    # at most as many rows as there are contexts in the bounded sample
    total = map_steps(chosen, count, "which bigint, gram bigint, n bigint").groupBy("which", "gram").agg(F.sum("n").alias("n"))
    got = total.toArrow()
    which, grams, counts = (got.column(i).to_numpy() for i in range(3))
    return Trees(languages, (which.astype(np.int64), grams.astype(np.uint32), counts.astype(np.float64)))


def _judge(sent: Sent, names: list[str], contents: list[bytes]) -> tuple[list, np.ndarray, list]:
    """(language, score, bits per byte) of each text."""
    model = kept(("costs", sent.name), lambda: Costs(sent.value))
    letter = kept("letter", lambda: regex.compile(_LETTER))
    known = np.array([bool(names) and letter.search(t.decode()) is not None for t in contents], bool)
    out, score, each = ["und"] * len(contents), np.zeros(len(contents)), [None] * len(contents)
    if known.any():
        at = np.flatnonzero(known)
        bits, n = model.lengths([contents[i] for i in at])
        best = bits.argmin(1)
        least = bits[np.arange(len(at)), best]
        score[at] = 1 / np.exp2(np.minimum(least[:, None] - bits, 0)).sum(1)
        for i, b, length, size in zip(at, best, least, n):
            out[i], each[i] = names[b], length / size
    return out, score, each


def predict(df: DataFrame, trees: Trees, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, bits_per_byte), one row per input row, repeated rows included.

    The language with the shortest code wins, the first in order among equals; the score is its
    share of 2^-length over all languages.  A null text, one without a letter, and every text
    under trees without languages is ``und`` with score 0 and no bits.
    """
    sent, names = Sent(df.sparkSession, trees), trees.languages

    def run(columns):
        out, score, each = _judge(sent, names, text_bytes(columns[text]))
        return columns[key], out, score, pa.array(each, pa.float64())

    kind = df.schema[key].dataType.simpleString()
    return map_steps(picked(df, [key, text]), run, f"`{key}` {kind}, lang_pred string, score double, bits_per_byte double")


def accepted(df: DataFrame, trees: Trees, *, text: str = "text") -> DataFrame:
    """The rows, with all columns, whose text is in a learned language.

    Rejected are ``und`` and what its best language codes in as many bits as plain bytes have.
    Repeated rows are judged alike; an empty table stays one.
    """
    sent, names = Sent(df.sparkSession, trees), trees.languages

    def run(columns):
        *_, each = _judge(sent, names, text_bytes(columns["__text"]))
        keep = pa.array([b is not None and b < 8 for b in each], pa.bool_())
        return [c.filter(keep) for name, c in columns.items() if name != "__text"]

    source = df.select(*[ident(c).alias(f"c{i}") for i, c in enumerate(df.columns)], ident(text).alias("__text"))
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(df.schema.fields))
    return map_steps(source, run, schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)])
