"""Edit-aware token counts.

A document's pre-tokens (the pieces that a tokenizer's pattern cuts before merging) lie, some at a time, in the leaves
of a segment tree of characters and tokens. Trees are kept in a table with their texts. Each set of edits finds the
leaves that it touches by the sums of characters, with the one before where its last match could reach into the edit,
encodes from there on until a piece ends where an old leaf did, and updates the sums above the changed leaves; a
pattern's match depends only on the text from its start on, so the rest is as it was. Then the tree is ready for the
next set of edits.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F, types as T

from . import pii
from .session import Tables, bound_batches

#: Where public vocabularies lie; a parameter of every function that reads one.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public pre-token pattern of that vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: How far behind the character that ends it a piece's match can depend on the text: "'l" before another l, or white space.
LOOK = 1
#: Pieces of a leaf, and leaves that an edit may bring more than there is room for before the tree is laid out anew.
LEAF, GROWN = 16, 8
#: Pieces whose counts a worker remembers.
REMEMBERED = 400_000


class Counter:
    """Token counts of pieces."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.pattern, self.known = regex.compile(pattern), {}

    def piece(self, text: str) -> int:
        n = self.known.get(text)
        if n is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            n = self.known[text] = len(self.encoding.encode_ordinary(text))
        return n

    def pieces(self, text: str) -> tuple[list[str], list[int]]:
        found = self.pattern.findall(text)
        known = self.known
        counts = [known.get(p) for p in found]
        if None in counts:
            counts = [self.piece(p) if n is None else n for p, n in zip(found, counts, strict=True)]
        return found, counts


def _leaves(chars: list[int], tokens: list[int]) -> list[tuple[int, int]]:
    """Sums of characters and tokens of each LEAF neighbouring pieces."""
    return [(sum(chars[i : i + LEAF]), sum(tokens[i : i + LEAF])) for i in range(0, len(chars), LEAF)]


class Tree:
    """Segment trees of two sums over the same leaves, characters and tokens: node i has the children 2 * i and 2 * i + 1, the root is 1."""

    def __init__(self, sums: np.ndarray):
        self.sums, self.size = sums, sums.shape[1] // 2

    @classmethod
    def of(cls, leaves: list[tuple[int, int]]) -> "Tree":
        size = 1 << max(0, (len(leaves) - 1).bit_length())
        sums = np.zeros((2, 2 * size), np.int32)
        if leaves:
            sums[:, size : size + len(leaves)] = np.array(leaves).T
        low = size
        while low > 1:
            sums[:, low // 2 : low] = sums[:, low : 2 * low].reshape(2, -1, 2).sum(axis=2)
            low //= 2
        return cls(sums)

    @classmethod
    def read(cls, stored: bytes) -> "Tree":
        return cls(np.frombuffer(stored, np.int32).reshape(2, -1).copy())

    def stored(self) -> bytes:
        return self.sums.tobytes()

    @property
    def chars(self) -> int:
        return int(self.sums[0, 1])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaves(self) -> list[tuple[int, int]]:
        return [tuple(x) for x in self.sums[:, self.size :].T.tolist()]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character `at`, which the text has, and where that leaf starts."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            left = int(self.sums[0, node])
            if at - start >= left:
                node, start = node + 1, start + left
        return node - self.size, start

    def set(self, leaf: int, sums: tuple[int, int]) -> None:
        """Give a leaf other sums, and bring those above it up to date."""
        at = leaf + self.size
        change = np.array(sums, np.int32) - self.sums[:, at]
        while at and change.any():
            self.sums[:, at] += change
            at //= 2


class Counted:
    """A text and its tree, for any number of sets of edits, one after another."""

    def __init__(self, text: str, tree: Tree, counter: Counter):
        self.text, self.tree, self.counter, self.encoded = text, tree, counter, 0

    @classmethod
    def of(cls, text: str, counter: Counter) -> tuple["Counted", int]:
        """The text counted as a whole, and the number of its pieces."""
        pieces, counts = counter.pieces(text)
        return cls(text, Tree.of(_leaves(list(map(len, pieces)), counts)), counter), len(pieces)

    def edit(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace [start, end) by new for each of the edits, which are in order and don't overlap."""
        parts, at, before = [], 0, [0]
        for a, b, new in edits:
            parts += [self.text[at:a], new]
            at = b
            before.append(before[-1] + len(new) - (b - a))  # how far the edits up to here move what follows
        text, n = "".join([*parts, self.text[at:]]), len(self.text)
        regions, k = [], 0
        while k < len(edits):
            leaf, start = self.tree.find(max(0, edits[k][0] - LOOK - 1)) if n else (0, 0)
            end, stop = start + before[k], self.tree.size
            last, k = edits[k][1], k + 1
            chars, tokens = [], []
            while end < len(text):
                m = self.counter.pattern.match(text, end)
                chars.append(m.end() - end)
                tokens.append(self.counter.piece(m.group()))
                end = m.end()
                while k < len(edits) and end - before[k] >= edits[k][0] - LOOK:  # the next edit is so near that this piece could see it
                    last, k = edits[k][1], k + 1
                old = end - before[k]
                if last <= old < n:
                    next_leaf, begins = self.tree.find(old)
                    if begins == old and next_leaf > leaf:  # the rest, up to the next edit, is cut as it was
                        stop = next_leaf
                        break
            else:
                k = len(edits)  # edits that are left insert or take away at the end, and are in what was encoded
            self.encoded += len(chars)
            regions.append((leaf, stop, _leaves(chars, tokens)))
        if any(len(new) > stop - leaf + GROWN for leaf, stop, new in regions):
            leaves, done = [], 0
            old = self.tree.leaves()
            for leaf, stop, new in regions:
                leaves += [x for x in old[done:leaf] if x[0]] + new
                done = stop
            self.tree = Tree.of(leaves + [x for x in old[done:] if x[0]])
        else:
            for leaf, stop, new in regions:
                room = stop - leaf
                if len(new) > room:  # the last leaf takes the rest
                    new = [*new[: room - 1], tuple(map(sum, zip(*new[room - 1 :], strict=True)))]
                for i in range(room):
                    self.tree.set(leaf + i, new[i] if i < len(new) else (0, 0))
        self.text = text


TREE = "tree binary, n_pieces long, tokens long, n_edits long, pieces_encoded long"


def _with_counter(spark, vocabulary: str, pattern: str):
    bound_batches(spark)
    with open(vocabulary, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())  # a vocabulary: a fixed size
    return lambda: Counter(sent.value, pattern)


def build_trees(docs: DataFrame, keep: list[str] | None = None, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """`keep` columns of docs (default: doc_id), text and TREE, one row for each row: to be written, and edited by edit_trees().

    tokens: the text's count. n_pieces: its pieces. Null texts are empty. Texts of any length are read whole.
    """
    spark, keep = docs.sparkSession, keep or ["doc_id"]
    slim, made = docs.select(*dict.fromkeys([*keep, "text"])), _with_counter(spark, vocabulary, pattern)
    more = [c for c in keep if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = made()
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column("text")]
            trees, pieces, tokens = [], [], []
            for text in texts:
                doc, n = Counted.of(text, counter)
                trees.append(doc.tree.stored())
                pieces.append(n)
                tokens.append(doc.tree.tokens)
            none = pa.array(np.zeros(len(texts), np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in more), pa.array(texts, pa.string()), pa.array(trees, pa.binary()), pa.array(pieces, pa.int64()), pa.array(tokens, pa.int64()), none, none], names=[*more, "text", *_TREE_NAMES])

    return slim.mapInArrow(run, T.StructType([*(slim.schema[c] for c in more), *T.StructType.fromDDL("text string, " + TREE)]))


_TREE_NAMES = [f.split()[0] for f in TREE.split(", ")]
EDITS = "array<struct<start: int, end: int, new: string>>"


def edit_trees(trees: DataFrame, edits: str | Callable[[str], list[tuple[int, int, str]]] = "edits", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """build_trees()' rows with the edits applied to text and tree; n_edits and pieces_encoded grow by what they took.

    edits: a column of EDITS (which goes), or a function from the text. Null edits are none. They are put in order by
    start and end; one that begins before the last one's end, or lies outside the text, is an error.
    """
    made = _with_counter(trees.sparkSession, vocabulary, pattern)
    names = [c for c in trees.columns if c != edits]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = made()
        for batch in batches:
            new = {c: [] for c in ("text", "tree", "tokens", "n_edits", "pieces_encoded")}
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_py()
                own = edits(text) if callable(edits) else [(e["start"], e["end"], e["new"] or "") for e in batch.column(edits)[i].as_py() or []]
                own = sorted(own)
                if any(a > b for a, b, _ in own) or any(x[1] > y[0] for x, y in zip(own, own[1:], strict=False)) or own and not 0 <= own[0][0] <= own[-1][1] <= len(text):
                    raise ValueError("edits overlap or lie outside the text")
                stored, encoded = batch.column("tree")[i].as_py(), 0
                tokens = batch.column("tokens")[i].as_py()
                if own:
                    doc = Counted(text, Tree.read(stored), counter)
                    doc.edit(own)
                    text, stored, tokens, encoded = doc.text, doc.tree.stored(), doc.tree.tokens, doc.encoded
                for c, v in zip(new, (text, stored, tokens, batch.column("n_edits")[i].as_py() + len(own), batch.column("pieces_encoded")[i].as_py() + encoded), strict=True):
                    new[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(new[c], batch.schema.field(c).type) if c in new else batch.column(c) for c in names], names=names)

    return trees.mapInArrow(run, T.StructType([trees.schema[c] for c in names]))


def repeated_lines(text: str) -> list[tuple[int, int, str]]:
    """Edits that take away each line that stood before."""
    out, seen, at = [], set(), 0
    for line in text.split("\n"):
        end = min(len(text), at + len(line) + 1)
        if line.strip() and line in seen:
            out.append((at, end, ""))
        seen.add(line)
        at = end
    return out


def personal_data(text: str) -> list[tuple[int, int, str]]:
    """Edits that put base personal data as <KIND>; of spans that overlap the first one."""
    out, at = [], 0
    for a, b, kind in sorted(pii.find(text)[0]):
        if a >= at:
            out.append((a, b, f"<{kind.upper()}>"))
            at = b
    return out


def count_clean_up(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_edits, tokens_before, tokens_after, n_pieces, pieces_encoded, a row for each row of docs.

    The trees are kept in the shared folder; one clean-up masks personal data, the next one, on the trees that the
    first one left, takes repeated lines away. A null text is an empty one, of no tokens; texts are read whole, however long;
    repeated rows are counted each by itself; other columns of docs, whatever their names, don't matter. An empty table
    gives an empty result.
    """
    trees = Tables(docs.sparkSession, "token-trees").keep(build_trees(docs.select("doc_id", "text"), vocabulary=vocabulary))
    first = edit_trees(trees.withColumn("tokens_before", F.col("tokens")), personal_data, vocabulary)
    second = edit_trees(first, repeated_lines, vocabulary)
    return second.select("doc_id", "n_edits", "tokens_before", F.col("tokens").alias("tokens_after"), "n_pieces", "pieces_encoded")


def totals(counts: DataFrame) -> DataFrame:
    """One row: documents, tokens before and after, and the share of pieces that was encoded again."""
    return counts.agg(F.count("*").alias("docs"), F.sum("tokens_before").alias("tokens_before"), F.sum("tokens_after").alias("tokens_after"), F.try_divide(F.sum("pieces_encoded"), F.sum("n_pieces")).alias("encoded_again"))


def read_vocabulary(path: str = VOCABULARY) -> Counter:
    with open(path, "rb") as f:
        return Counter(f.read())
