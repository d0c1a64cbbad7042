"""Token counts that follow edits without encoding the whole document again.

A document is cut into pieces that can be encoded on their own (see `pieces`); runs of pieces are the leaves of a
segment tree whose nodes hold the characters and tokens below them. An edit finds its leaves by descending along
the character sums, rewrites their text, and takes in further leaves on either side only while the seam is not a
place where pieces may be cut (boundary context). The new text goes into the slots of the leaves it replaces, its
pieces are counted, and the sums on the paths above are updated. A leaf that outgrows its slot has the tree built
anew from its leaves, without encoding.

Defined cases: a null text is empty; a document without edits keeps its count; edits apply in order, each to the
text the ones before it left; starts beyond the end append, lengths beyond the end are cut, null starts and
lengths are 0 and a null replacement is empty; repeated rows are documents of their own; an empty table gives no
rows. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipescope.llm.common import giving_back, in_small_batches
from pipescope.llm.pieces import CUT, RUN, PieceEncoder, text_parts, tokenizer_text, worker_encoder

LEAF_PIECES = 32
RESULT = "doc_id long, n_edits long, tokens_before long, tokens_after long, chars_after long, chars_encoded long"


def cut(text: str) -> list[str]:
    """The pieces of a text in order; joined they are the text."""
    if RUN.search(text) is not None:
        return CUT.split(text)
    head, *rest = text.split(" ")
    pieces = [" " + p for p in rest]
    return [head, *pieces] if head else pieces


def seam(left: str, right: str) -> bool:
    """May a text be cut between `left` and `right`?"""
    return not left[-1].isspace() and right[0] == " " and len(right) > 1 and not right[1].isspace()


class SegmentTree:
    """Leaves of text with sums of characters and tokens; node 1 is the root, node i has children 2i and 2i + 1."""

    def __init__(self, texts: list[str], tokens: list[int]):
        self.width = 1 << max(0, (len(texts) - 1).bit_length())
        self.texts = texts + [""] * (self.width - len(texts))
        self.chars = [0] * self.width + [len(t) for t in self.texts]
        self.tokens = [0] * self.width + tokens + [0] * (self.width - len(tokens))
        for node in range(self.width - 1, 0, -1):
            self._add_up(node)

    def _add_up(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def find(self, char: int) -> tuple[int, int]:
        """The leaf that holds the character, and the characters before the leaf; the last leaf beyond the end."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if before + self.chars[node] <= char and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        return node - self.width, before

    def set(self, leaf: int, text: str, tokens: int) -> None:
        node = leaf + self.width
        self.texts[leaf], self.chars[node], self.tokens[node] = text, len(text), tokens
        while node > 1:
            node //= 2
            self._add_up(node)

    def neighbour(self, leaf: int, step: int) -> int | None:
        """The next leaf with text on that side."""
        leaf += step
        while 0 <= leaf < self.width and not self.texts[leaf]:
            leaf += step
        return leaf if 0 <= leaf < self.width else None


class EditedDocument:
    """The token count of a text under edits."""

    def __init__(self, encoder: PieceEncoder, text: str, counts: np.ndarray | None = None):
        """`counts` are the tokens of the text's pieces, if they are known."""
        self.encoder = encoder
        pieces = cut(text)
        if counts is None:
            counts = np.asarray(self._count(pieces), np.int64)
        groups = range(0, len(pieces), LEAF_PIECES)
        self.tree = SegmentTree(["".join(pieces[i:i + LEAF_PIECES]) for i in groups] or [""],
                                np.add.reduceat(counts, groups).tolist() if pieces else [0])
        self.encoded = 0

    def _count(self, pieces: list[str]) -> list[int]:
        numbers = list(map(self.encoder.bare.__getitem__, pieces))
        self.encoder.settle()
        return self.encoder.sizes[numbers].tolist() if numbers else []

    @property
    def tokens(self) -> int:
        return self.tree.tokens[1]

    @property
    def chars(self) -> int:
        return self.tree.chars[1]

    def text(self) -> str:
        return "".join(self.tree.texts)

    def edit(self, start: int, length: int, replacement: str) -> None:
        """Replace `length` characters from `start`."""
        start = min(max(start, 0), self.chars)
        length = min(max(length, 0), self.chars - start)
        first, before = self.tree.find(start)
        last, _ = self.tree.find(start + length - 1) if length else (first, before)
        old = "".join(self.tree.texts[first:last + 1])
        at = start - before
        text = old[:at] + replacement + old[at + length:]
        while (left := self.tree.neighbour(first, -1)) is not None and not (text and seam(self.tree.texts[left], text)):
            first, text = left, self.tree.texts[left] + text
        while (right := self.tree.neighbour(last, 1)) is not None and not (text and seam(text, self.tree.texts[right])):
            last, text = right, text + self.tree.texts[right]
        pieces = cut(text)
        counts = self._count(pieces)
        self.encoded += len(text)
        room = last - first + 1
        share = max(LEAF_PIECES, -(-len(pieces) // room))
        for slot in range(room):
            part = slice(slot * share, (slot + 1) * share)
            self.tree.set(first + slot, "".join(pieces[part]), sum(counts[part]))
        if share > 4 * LEAF_PIECES:
            self._spread(first, pieces, counts, share, room)

    def _spread(self, first: int, pieces: list[str], counts: list[int], share: int, room: int) -> None:
        """Build the tree anew with the outgrown leaves cut into leaves of the usual size."""
        texts, tokens = [], []
        for leaf in range(self.tree.width):
            if first <= leaf < first + room:
                for i in range((leaf - first) * share, min((leaf - first + 1) * share, len(pieces)), LEAF_PIECES):
                    end = min(i + LEAF_PIECES, (leaf - first + 1) * share)
                    texts.append("".join(pieces[i:end]))
                    tokens.append(sum(counts[i:end]))
            elif self.tree.texts[leaf]:
                texts.append(self.tree.texts[leaf])
                tokens.append(self.tree.tokens[self.tree.width + leaf])
        self.tree = SegmentTree(texts or [""], tokens or [0])


def with_edits(docs: DataFrame, edits: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Join a table of edits (doc_id, seq, start, length, replacement) to its documents as the column `edits`.

    The edits of one document follow each other by definition; they are as many as one document has.
    """
    listed = edits.groupBy(F.col("doc_id").alias("_edited")).agg(
        F.array_sort(F.collect_list(F.struct("seq", "start", "length", "replacement"))).alias("_listed"))
    of = F.transform("_listed", lambda e: F.struct(e["start"], e["length"], e["replacement"]))
    return docs.join(listed, docs[doc_id] == listed["_edited"], "left").withColumn("edits", of).drop("_edited", "_listed")


def derived_edits(doc_id: Column, text: Column, most: int = 3) -> Column:
    """1 to `most` edits of a text that depend on its id and length alone: replacements, insertions and removals
    of up to 40 characters at any place, with words taken from another place of the same text."""
    def draw(i: Column, salt: int, below: Column | int) -> Column:
        bound = F.lit(below) if isinstance(below, int) else below
        return F.pmod(F.xxhash64(doc_id, i, F.lit(salt)), F.greatest(bound, F.lit(1)).cast("long"))

    body = F.coalesce(text, F.lit(""))
    size = F.length(body)
    return F.transform(
        F.sequence(F.lit(1), (1 + draw(F.lit(0), 0, most)).cast("int")),
        lambda i: F.struct(draw(i, 1, size + 1).alias("start"), (draw(i, 2, 3) * draw(i, 3, 21)).alias("length"),
                           body.substr((draw(i, 4, size) + 1).cast("int"), (draw(i, 5, 3) * draw(i, 6, 21)).cast("int"))
                           .alias("replacement")))


def edited_counts(docs: DataFrame, tokenizer_path: str, *, doc_id: str = "doc_id", text: str = "text",
                  edits: str = "edits") -> DataFrame:
    """RESULT columns for every row: its tokens before and after its `edits` (array of start, length, replacement),
    and the characters that were encoded for the edits."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_text(tokenizer_path))
    names = [c.split()[0] for c in RESULT.split(", ")]

    def count(batches):
        encoder = worker_encoder(shared.value)
        for batch in batches:
            ids, lists = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for part, texts in text_parts(batch.column(1)):
                rows = []
                for key, t, changes, counts in zip(ids[part], texts, lists[part], encoder.token_counts(texts)):
                    document = EditedDocument(encoder, t, counts)
                    before = document.tokens
                    for change in changes or []:
                        document.edit(change["start"] or 0, change["length"] or 0, change["replacement"] or "")
                    rows.append((key, len(changes or []), before, document.tokens, document.chars, document.encoded))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    kind = "array<struct<start:long,length:long,replacement:string>>"
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(edits).cast(kind).alias("edits"))
    return in_small_batches(chosen).mapInArrow(lambda batches: giving_back(count(batches)), RESULT)
