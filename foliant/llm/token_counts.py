"""Token counts of every prefix, by prefix dynamic programming.

The vocabulary has no piece in which a space follows another character, so a
text can be cut before each run of spaces.  The count at a prefix is then the
count at the last cut plus the count of the part of a word after it:
``N[cut + j] = N[cut] + c(word, j)``.  c is tokenised once for each distinct
word and j; N is summed over the cuts.  What is stored is the step of N at
each code point, so any prefix's count, the longest prefix within a budget and
the total are sums, without encoding again.

Long words are cut further wherever their two neighbouring characters are
adjacent in no piece.  In what still exceeds ``LONG`` bytes, the prefixes are
counted along the text: the last piece of a prefix is the one that ends there
and stays apart from the last piece of what it leaves, and a prefix has one
token more than that.  A text's own U+2581 is a space to the model.

Rules for unusual rows: a null or empty text has 0 bytes and 0 tokens.  Rows
that repeat each return a row.  A null doc_id stays null.  Columns besides
doc_id and text are ignored.  No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._blocks import chunks, lean, prefix_sums, ragged, span_hash
from ._segments import SegmentTable
from ._tables import load

LONG, LIMIT, PAIRS = 256, 4096, 1 << 18
MARK = "▁"


class Pieces:
    """A sentencepiece model with the table of the words that it has met."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size()) if not (self.model.is_control(i) or self.model.is_byte(i) or self.model.is_unknown(i))]
        self.adjacent = {p[k : k + 2] for p in names for k in range(len(p) - 1)}
        if any(a != MARK and b == MARK for a, b in self.adjacent):
            raise ValueError("a piece holds a space after another character: texts of this model can't be cut at spaces")
        self.base = self.count("x")
        self.table = SegmentTable(np.int32)
        self.score = {p: self.model.get_score(self.model.piece_to_id(p)) for p in names}
        self.longest = max(map(len, names), default=1)
        self.together: dict[tuple[str, str], bool] = {}

    def count(self, text: str) -> int:
        return len(self.model.encode(text))

    def counts(self, texts: list[str]) -> list[int]:
        """Of texts that begin with a space: "x" before them stands for what ends there."""
        return [len(x) - self.base for x in self.model.encode(["x" + t for t in texts], num_threads=1)]

    def parts(self, word: str) -> list[str]:
        """A long word in parts that no piece joins; the first one begins with its space."""
        shown = word.replace(" ", MARK)
        cuts = [k for k in range(2, len(word)) if shown[k - 1 : k + 1] not in self.adjacent]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]

    def apart(self, left: str, right: str) -> bool:
        """Whether two pieces side by side are what their joint text is merged to: best score first, then leftmost."""
        key = (left, right)
        if key not in self.together:
            if len(self.together) > PAIRS:
                self.together.clear()
            parts = list(left + right)
            while True:
                pairs = [(-self.score[x + y], k) for k, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in self.score]
                if not pairs:
                    break
                k = min(pairs)[1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            self.together[key] = parts == [left, right]
        return self.together[key]

    def prefixes(self, part: str, inner: bool) -> list[int]:
        """Counts of all prefixes of a long part."""
        head = "x\n" if inner else "x"
        shown, counts, last = part.replace(" ", MARK), [0], [""]
        for j in range(1, len(shown) + 1):
            for n in range(min(self.longest, j), 0, -1):
                piece = shown[j - n : j]
                if piece in self.score and (not last[j - n] or self.apart(last[j - n], piece)):
                    counts.append(counts[j - n] + 1)
                    break
            else:  # a character of no piece
                piece = shown[j - 1]
                counts.append(counts[j - 1] + self.count("x\n" + piece) - self.count("x\n"))
            last.append(piece)
        if counts[-1] != self.count(head + part) - self.count(head):  # not a model of ranked merges: the library counts each
            return [self.count(head + part[:j]) - self.count(head) for j in range(1, len(part) + 1)]
        return counts[1:]

    def steps(self, words: list[str]) -> list[list[int]]:
        """For each word (spaces first), the change of the count at each of its code points."""
        pieces: list[tuple[int, str, bool]] = []
        for i, w in enumerate(words):
            if len(w) > LONG // 4 and len(w.encode()) > LONG:
                pieces += [(i, p, k > 0) for k, p in enumerate(self.parts(w))]
            else:
                pieces.append((i, w, False))
        asked: dict[tuple[str, bool], int] = {}
        for _, p, inner in pieces:
            if len(p.encode()) <= LONG:
                for j in range(1, len(p) + 1):
                    asked.setdefault((p[:j], inner), 0)
        plain, inner = [k for k in asked if not k[1]], [k for k in asked if k[1]]
        asked.update(zip(plain, self.counts([k[0] for k in plain])))
        # a part that begins inside a word: a line break, which no piece holds, parts it from the "x"
        head = self.count("x\n")
        asked.update(zip(inner, (len(x) - head for x in self.model.encode(["x\n" + k[0] for k in inner], num_threads=1))))
        out: list[list[int]] = [[] for _ in words]
        for i, p, inside in pieces:
            last = 0
            counts = [asked[p[:j], inside] for j in range(1, len(p) + 1)] if len(p.encode()) <= LONG else self.prefixes(p, inside)
            for now in counts:
                out[i].append(now - last)
                last = now
        return out


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def prefix_steps(model: Pieces, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the count at each code point of all texts, and the number of code points of each text."""
    full = np.flatnonzero(np.diff(off))
    buf = np.insert(buf, off[full], 32)  # the space that the model puts before a text
    start_of = off[full] + np.arange(len(full))
    gap = buf == 32
    cut = gap.copy()
    cut[1:] &= ~gap[:-1]
    cut[start_of] = True
    # a text's own leading spaces go with the space before it
    start = np.flatnonzero(cut)
    end = np.r_[start[1:], len(buf)]
    at, size = model.table.lookup(buf, start, end, span_hash(prefix_sums(buf), start, end), model.steps)
    # the first step of each text belongs to the space that was put before it; it joins the step after it
    flat = model.table.gather(at, size).astype(np.int32)
    per_text = np.add.reduceat(size, np.searchsorted(start, start_of)) if len(full) else np.zeros(0, np.int64)
    first = np.cumsum(per_text) - per_text
    flat[first + 1] += flat[first]
    keep = np.ones(len(flat), bool)
    keep[first] = False
    points = np.zeros(len(off) - 1, np.int64)
    points[full] = per_text - 1
    return flat[keep], points


def _direct(model: Pieces, text: str) -> np.ndarray:
    """Steps of a text that holds the model's own space mark: those of the text with spaces."""
    data = text.replace(MARK, " ").encode()
    return prefix_steps(model, np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]


def _counter(path: str, with_steps: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, mark = pieces(path), MARK.encode()
        for rows, buf, off in chunks(batches):
            steps, points = prefix_steps(model, buf, off)
            edges = np.r_[0, np.cumsum(points)]
            sums = np.r_[0, np.cumsum(steps, dtype=np.int64)]
            total = sums[edges[1:]] - sums[edges[:-1]]
            own: dict[int, np.ndarray] = {}
            if mark in (data := buf.tobytes()):
                for i in range(len(points)):
                    if mark in (part := data[off[i] : off[i + 1]]):
                        own[i] = _direct(model, part.decode())
                        total[i] = own[i].sum(dtype=np.int64)
            cols = [rows.column(0), pa.array(np.diff(off)), pa.array(total)]
            if with_steps:
                packed = steps.astype("<i4")
                cols.append(pa.array([own[i].astype("<i4").tobytes() if i in own else packed[edges[i] : edges[i + 1]].tobytes() for i in range(len(points))], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_tokens", "steps"][: len(cols)])

    return lean(run)


def prefix_counts(docs: DataFrame, model: str, with_steps: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_tokens and steps (little-endian 32-bit change of the count at each code point) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_counter(model, with_steps), "doc_id long, n_bytes long, n_tokens long" + ", steps binary" * with_steps)


def count_at(steps: bytes, points: int) -> int:
    """Tokens of the prefix of so many code points."""
    return int(np.frombuffer(steps, "<i4")[:points].sum(dtype=np.int64))


def longest_within(steps: bytes, budget: int) -> int:
    """Code points of the longest prefix that has at most ``budget`` tokens."""
    counts = np.r_[0, np.cumsum(np.frombuffer(steps, "<i4"), dtype=np.int64)]
    return int(np.flatnonzero(counts <= budget)[-1])


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = prefix_counts(load(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
