"""Token counts that follow edits: a segment tree of pre-token runs per document, kept as a table.

The leaves of a text's tree are runs of whole pre-tokens of the byte-level
vocabulary: (code points, tokens). A text is cut before every single space between
two non-spaces, which is always an edge between pre-tokens; runs longer than
`LONG` are cut at every edge.

Whether a place is an edge depends on what begins there and on at most two
characters behind it, never on what comes before the edge. So an edit leaves all
leaves that end three characters before it; from there on pre-tokens are found
again until one ends where an old leaf ended behind the edit: all that follows is
as before. Only these leaves are encoded again, and the sums above them updated.

`trees` makes the table of trees, `apply_edits` turns it into the next one by a
column of edits without encoding anything else, as often as there are edits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from larkframe.llm.common import in_slices, stage
from larkframe.llm.tokens import UNSAFE

CUT = regex.compile(r"(?<=\S)(?= \S)")
#: Characters of a run from which on it is cut at every pre-token.
LONG = 64
#: Leaves of a block of the tree when it is made; an edited block holds twice as many at most.
BLOCK = 64
#: Characters before an edit that may decide on an edge together with what the edit touches.
CONTEXT = 3
_LEAVES = [StructField("text", StringType()), StructField("lengths", ArrayType(IntegerType())), StructField("tokens", ArrayType(IntegerType()))]


def pre_tokens():
    import public_tokenizers

    return regex.compile(public_tokenizers.PATTERN)


def runs(text: str, pattern) -> list[str]:
    """The leaves' texts; their concatenation is the text."""
    if not text:
        return []
    if text[0] != " " and text[-1] != " " and not UNSAFE.search(text):
        first, *rest = text.split(" ")
        found = [first, *[" " + r for r in rest]]
    else:
        found = CUT.split(text)
    if max(map(len, found)) <= LONG:
        return found
    return [x for r in found for x in (pattern.findall(r) if len(r) > LONG else (r,))]


class SumTree:
    """Sums of (length, tokens) over blocks, as an implicit binary tree."""

    def __init__(self, lengths: np.ndarray, tokens: np.ndarray):
        n = max(1, len(lengths))
        self.leaves = 1 << (n - 1).bit_length()
        self.sums = np.zeros((2, 2 * self.leaves), np.int64)
        self.sums[0, self.leaves : self.leaves + len(lengths)] = lengths
        self.sums[1, self.leaves : self.leaves + len(tokens)] = tokens
        at = self.leaves
        while at > 1:
            self.sums[:, at // 2 : at] = self.sums[:, at : 2 * at : 2] + self.sums[:, at + 1 : 2 * at : 2]
            at //= 2

    def find(self, position: int) -> tuple[int, int]:
        """The block that holds a character and where the block starts; the last with any for one beyond the end."""
        node, start = 1, 0
        position = min(position, int(self.sums[0, 1]) - 1)
        while node < self.leaves:
            node *= 2
            left = int(self.sums[0, node])
            if position - start >= left:
                start += left
                node += 1
        return node - self.leaves, start

    def change(self, block: int, length: int, tokens: int) -> None:
        node = block + self.leaves
        by = np.array([length, tokens]) - self.sums[:, node]
        while node:
            self.sums[:, node] += by
            node //= 2


@dataclass
class Edit:
    """Replaces `removed` code points at `position` by `added`."""

    position: int
    removed: int
    added: str


class TokenCount:
    """The token count of a text under edits. `count` returns the tokens of a run of whole pre-tokens."""

    def __init__(self, text: str, lengths: np.ndarray, tokens: np.ndarray, count: Callable[[str], int], pattern):
        self.text, self.count, self.pattern = text, count, pattern
        self.rebuilt = -1
        self._set(np.asarray(lengths, np.int64), np.asarray(tokens, np.int64))

    @classmethod
    def of(cls, text: str, count: Callable[[str], int], pattern) -> TokenCount:
        own = runs(text, pattern)
        return cls(text, np.fromiter(map(len, own), np.int64, len(own)), np.fromiter(map(count, own), np.int64, len(own)), count, pattern)

    def _set(self, lengths: np.ndarray, tokens: np.ndarray) -> None:
        cuts = range(0, len(lengths), BLOCK)
        self.blocks = [(lengths[k : k + BLOCK], tokens[k : k + BLOCK]) for k in cuts]
        self.tree = SumTree(np.add.reduceat(lengths, cuts) if len(cuts) else lengths, np.add.reduceat(tokens, cuts) if len(cuts) else tokens)
        self.rebuilt += 1

    @property
    def tokens(self) -> int:
        return int(self.tree.sums[1, 1])

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and tokens of all leaves."""
        empty = np.zeros(0, np.int64)
        return tuple(np.concatenate([empty, *[b[k] for b in self.blocks]]) for k in (0, 1))

    def apply(self, edit: Edit) -> int:
        """Applies an edit and returns the code points that were encoded again."""
        n = len(self.text)
        p = min(max(edit.position, 0), n)
        q = min(p + max(edit.removed, 0), n)
        delta = len(edit.added) - (q - p)
        self.text = self.text[:p] + edit.added + self.text[q:]
        if not n:
            fresh = TokenCount.of(self.text, self.count, self.pattern)
            self.blocks, self.tree = fresh.blocks, fresh.tree
            return len(self.text)
        first, at = self.tree.find(max(p - CONTEXT, 0))
        lengths, tokens = self.blocks[first]
        ends = at + np.cumsum(lengths)
        # Leaves of the first block that stay.
        low = int(np.searchsorted(ends, max(p - CONTEXT, 0), "right"))
        left = int(ends[low - 1]) if low else at
        # Pre-tokens are found again up to one that ends where a leaf behind the edit ended.
        last, high, old, end = first, low, left, left
        new: list[str] = []
        match, count = self.pattern.match, self.count
        while True:
            # The first old edge behind the edit that is not before the new end.
            while old < q or old + delta < end:
                while high == len(self.blocks[last][0]) and last + 1 < len(self.blocks):
                    last, high = last + 1, 0
                if high == len(self.blocks[last][0]):
                    break
                old += int(self.blocks[last][0][high])
                high += 1
            if old + delta == end and old >= q:
                break
            found = match(self.text, end)
            new.append(found.group())
            end = found.end()
        own = [np.fromiter(map(f, new), np.int64, len(new)) for f in (len, count)]
        rest = self.blocks[last]
        whole = [np.concatenate([lengths[:low], own[0], rest[0][high:]]), np.concatenate([tokens[:low], own[1], rest[1][high:]])]
        room = 2 * BLOCK
        if len(whole[0]) <= room * (last + 1 - first):
            for block in range(first, last + 1):
                part = (whole[0][:room], whole[1][:room])
                whole = [w[room:] for w in whole]
                self.blocks[block] = part
                self.tree.change(block, int(part[0].sum()), int(part[1].sum()))
        else:
            self.blocks[first : last + 1] = [tuple(whole)]
            self._set(*self.leaves())
        return end - left


def trees(docs: DataFrame, tokenizers: str | None = None) -> DataFrame:
    """The segment tree of every text: doc_id, text, and of its leaves lengths (code points) and tokens.

    Null texts count as empty and have no leaves; texts are encoded whole, however
    long; repeated rows have a tree each; other columns, whatever their names, take
    no part. No rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from larkframe.llm.tokens import byte_bpe

        count, pattern = byte_bpe(tokenizers).count_run, pre_tokens()
        for batch in in_slices(batches, 1):
            ends, lengths, tokens = [0], [], []
            for text in batch.column(1):
                own = runs(text.as_py() or "", pattern)
                lengths.extend(map(len, own))
                tokens.extend(map(count, own))
                ends.append(len(lengths))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (lengths, tokens)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], ["doc_id", "text", "lengths", "tokens"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, StructType([docs.schema["doc_id"], *_LEAVES]))


def apply_edits(kept: DataFrame, tokenizers: str | None = None) -> DataFrame:
    """The trees after their edits, and encoded_again (code points).

    kept: the columns of `trees`, and edits, an array of (position, removed, added)
    that are applied one after the other; null or empty for none. Positions count
    code points; what lies outside the text is cut to it. doc_id may be of any type.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from larkframe.llm.tokens import byte_bpe

        count, pattern = byte_bpe(tokenizers).count_run, pre_tokens()
        for batch in in_slices(batches, 1):
            texts, leaves, again = [], ([], []), []
            for text, lengths, tokens, edits in zip(*[batch.column(c) for c in range(1, 5)], strict=True):
                tree = TokenCount(text.as_py(), lengths.values.to_numpy(), tokens.values.to_numpy(), count, pattern)
                again.append(sum(tree.apply(Edit(e["position"], e["removed"], e["added"] or "")) for e in edits.as_py() or ()))
                texts.append(tree.text)
                for column, x in zip(leaves, tree.leaves(), strict=True):
                    column.append(x.astype(np.int32))
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in leaves[0]])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in leaves]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *lists, pa.array(again, pa.int64())], ["doc_id", "text", "lengths", "tokens", "encoded_again"])

    return kept.select("doc_id", "text", "lengths", "tokens", "edits").mapInArrow(run, StructType([kept.schema["doc_id"], *_LEAVES, StructField("encoded_again", LongType())]))


def n_tokens(tokens: str = "tokens"):
    """Tokens of a tree."""
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda a, x: a + x)


def some_edits(text: str = "text"):
    """The edits of the registered query: a cut, an insertion, a replacement and an addition at places that depend on the text alone."""
    n = F.length(text)
    edit = lambda at, removed, added: F.struct(at.cast("long").alias("position"), F.lit(removed).cast("long").alias("removed"), added.alias("added"))
    return F.array(
        edit(F.floor(n / 3), 17, F.lit("")),
        edit(F.floor(n / 2), 0, F.substring(text, 1, 24)),
        edit(F.floor(2 * n / 3), 9, F.lit(" New words. ")),
        edit(n + 64, 0, F.lit("\nEnd.")),
    )


def recounted(docs: DataFrame, tokenizers: str | None = None) -> DataFrame:
    """Counts of every text before and after its edits: doc_id, n_chars, n_tokens, edited_chars, edited_tokens, encoded_again (code points).

    The trees are staged, and the edits are applied to the staged trees. Null texts
    count as empty. Repeated rows are counted each. No rows give no rows.
    """
    kept = stage(trees(docs, tokenizers), "count-trees")
    # What is known before goes along with the doc_id, so that nothing is joined.
    before = F.struct("doc_id", F.length("text").cast("long").alias("n_chars"), n_tokens().alias("n_tokens"))
    named = apply_edits(kept.select(before.alias("doc_id"), "text", "lengths", "tokens", some_edits().alias("edits")), tokenizers)
    return named.select("doc_id.doc_id", "doc_id.n_chars", "doc_id.n_tokens", F.length("text").cast("long").alias("edited_chars"), n_tokens().alias("edited_tokens"), "encoded_again")
