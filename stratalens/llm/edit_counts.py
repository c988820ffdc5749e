"""Edit-aware token counts from pre-token segment trees.

A document's pre-tokens are grouped into leaves of LEAF; a leaf knows its code points and tokens, and a binary tree over the leaves
keeps sums of both. An edit (first code point, end, new text) is found by descending the tree. Splitting goes
from left to right and looks a few signs ahead (the length of an added token at most), so re-encoding starts one leaf and CONTEXT signs
before the edit and ends at the first later leaf whose first sign again starts a pre-token; from there on nothing can differ. The region's new pre-tokens are dealt to
the same leaves, and only those leaves' ancestors are summed anew. Where a region's leaves would grow to four times their size it gets
more leaves; the tree's sums are then built anew from the leaves, without encoding anything else.

Defined results: null texts count as empty and have no tokens; positions beyond the text are cut to it; edits of a row apply in
their order; null or missing edits change nothing; repeated rows are counted alike; an empty table gives no rows; further columns are kept.
Memory: a batch of texts with their trees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.llm import shared
from stratalens.llm.bpe import Encoder, encoder
from stratalens.llm.token_frames import default_tokenizer

LEAF = 32
#: Signs around an edit that are encoded with it: more than any contraction, and than the added tokens that ``edit`` allows for.
CONTEXT = 32
EDITS = "array<struct<first:int,end:int,text:string>>"


class Tree:
    """Sums over leaves in heap order: row 1 is the root, row ``width`` the first leaf; columns are code points, tokens, pre-tokens."""

    def __init__(self, leaves: np.ndarray):
        self.n = len(leaves)
        self.width = 1 << max(0, (max(self.n, 1) - 1).bit_length())
        self.sums = np.zeros((2 * self.width, 3), dtype=np.int64)
        self.sums[self.width : self.width + self.n] = leaves
        level = self.width
        while level > 1:
            half = level // 2
            self.sums[half:level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level = half

    @staticmethod
    def load(n: int, sums: bytes) -> "Tree":
        out = Tree.__new__(Tree)
        out.n, out.sums = n, np.frombuffer(sums, "<i8").reshape(-1, 3).copy()
        out.width = len(out.sums) // 2
        return out

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def find(self, point: int) -> tuple[int, int]:
        """The leaf that holds a code point (the last one, for the end), and the leaf's first code point."""
        node, before = 1, 0
        while node < self.width:
            left = int(self.sums[2 * node, 0])
            if point - before < left or self.sums[2 * node + 1, 0] == 0:
                node = 2 * node
            else:
                before, node = before + left, 2 * node + 1
        return node - self.width, before

    def set(self, first: int, leaves: np.ndarray) -> None:
        a, b = self.width + first, self.width + first + len(leaves)
        self.sums[a:b] = leaves
        while a > 1:
            a, b = a // 2, (b - 1) // 2 + 1
            self.sums[a:b] = self.sums[2 * a : 2 * b : 2] + self.sums[2 * a + 1 : 2 * b : 2]


def leaves_of(starts: np.ndarray, sizes: np.ndarray, length: int, count: int | None = None) -> np.ndarray:
    """Deal pre-tokens (first code points, tokens) to leaves: to ``count`` of them, or by LEAF."""
    n = len(starts)
    count = count or max(1, -(-n // LEAF))
    cuts = (np.arange(count + 1) * n) // count if n % LEAF or count * LEAF != n else np.arange(count + 1) * LEAF
    chars = np.append(starts, length)
    tokens = np.concatenate(([0], np.cumsum(sizes)))
    return np.stack((np.diff(chars[cuts]), np.diff(tokens[cuts]), np.diff(cuts)), axis=1)


def edit(tree: Tree, text: str, first: int, end: int, new: str, own: Encoder) -> tuple[Tree, str, int]:
    """The tree and text after one edit, and the code points that were encoded."""
    first = min(max(first, 0), len(text))
    end = min(max(end, first), len(text))
    out = text[:first] + new + text[end:]
    delta = len(out) - len(text)
    context = max(CONTEXT, 2 * max(map(len, own.added), default=0))
    chars = tree.sums[tree.width : tree.width + tree.n, 0]
    leaf, from_char = tree.find(max(0, first - 1))
    left = leaf
    while left and (left == leaf or first - from_char < context):
        left -= 1
        from_char -= int(chars[left])
    right, at = tree.find(min(end, len(text)))
    to_char = at + int(chars[right])  # end of the last leaf that the edit touches, in the old text
    encoded, reach = 0, 1
    while True:
        # the following leaves tell whether the first sign after the border still starts a pre-token
        ahead, more = 0, right + 1
        while more < tree.n and (more < right + 1 + reach or ahead < context):
            ahead += int(chars[more])
            more += 1
        region = out[from_char : to_char + delta + ahead]
        starts, _, sizes, _ = own.spans([region])
        encoded += len(region)
        border = to_char + delta - from_char
        at_end = to_char >= len(text)
        k = int(np.searchsorted(starts, border))
        if at_end or k < len(starts) and starts[k] == border:
            break
        step = min(reach, tree.n - 1 - right)
        to_char += int(chars[right + 1 : right + 1 + step].sum())
        right += step
        reach *= 2
    k = len(starts) if at_end else k
    if at_end:
        right = tree.n - 1
    if k > 4 * LEAF * (right - left + 1):
        leaves = tree.sums[tree.width : tree.width + tree.n]
        tree = Tree(np.concatenate((leaves[:left], leaves_of(starts[:k], sizes[:k], border), leaves[right + 1 :])))
    else:
        tree.set(left, leaves_of(starts[:k], sizes[:k], border, right - left + 1))
    return tree, out, encoded


def builder(path: str):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            texts = batch.column("text").fill_null("").to_pylist()
            starts, _, sizes, bounds = own.spans(texts)
            trees, base = [], 0
            for i, text in enumerate(texts):
                a, b = bounds[i], bounds[i + 1]
                trees.append(Tree(leaves_of(starts[a:b] - base, sizes[a:b], len(text))))
                base += len(text)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([t.n for t in trees], pa.int32()), pa.array([t.tokens for t in trees], pa.int64()), pa.array([t.sums.astype("<i8").tobytes() for t in trees], pa.binary())], [*batch.schema.names, "n_leaves", "n_tokens", "tree"])

    return build


def editor(path: str):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            names = batch.schema.names
            texts = batch.column("text").fill_null("").to_pylist()
            trees, counts, encoded, new = [], [], [], []
            for text, n, sums, edits in zip(texts, batch.column("n_leaves").to_pylist(), batch.column("tree").to_pylist(), batch.column("edits").to_pylist()):
                tree, work = Tree.load(n, sums), 0
                for e in edits or []:
                    if e is not None and e["first"] is not None:
                        tree, text, more = edit(tree, text, e["first"], e["first"] if e["end"] is None else e["end"], e["text"] or "", own)
                        work += more
                trees.append((tree.n, tree.sums.astype("<i8").tobytes()))
                counts.append(tree.tokens)
                encoded.append(work)
                new.append(text)
            fresh = {"text": pa.array(new, batch.column("text").type), "n_leaves": pa.array([t[0] for t in trees], pa.int32()), "tree": pa.array([t[1] for t in trees], pa.binary())}
            keep = [n for n in names if n != "edits"]
            yield pa.RecordBatch.from_arrays([*(fresh.get(n, batch.column(n)) for n in keep), pa.array(counts, pa.int64()), pa.array(encoded, pa.int64())], [*keep, "new_tokens", "encoded_chars"])

    return apply


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def build_trees(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """All columns with n_leaves, n_tokens and tree; write it as a table to keep the trees."""
    shared.bounded_batches(docs.sparkSession, rows=256, mb=4)
    return docs.mapInArrow(builder(tokenizer_path or default_tokenizer()), f"{_fields(docs)}, n_leaves int, n_tokens long, tree binary")


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """Join edits (doc_id, ordinal, first, end, text) to the documents' trees."""
    lists = edits.where("doc_id is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "first", "end", "text"))).alias("l"))
    lists = lists.select("doc_id", F.transform("l", lambda e: F.struct(e["first"].cast("int").alias("first"), e["end"].cast("int").alias("end"), e["text"].alias("text"))).alias("edits"))
    return trees.join(lists, "doc_id", "left")


def apply_edits(trees: DataFrame, edits: Column | None = None, tokenizer_path: str | None = None) -> DataFrame:
    """Apply each row's edits to its text, tree and count: new_tokens, encoded_chars. n_tokens stays the count before."""
    rows = trees if edits is None else trees.withColumn("edits", edits.cast(EDITS))
    return rows.mapInArrow(editor(tokenizer_path or default_tokenizer()), f"{_fields(rows.drop('edits'))}, new_tokens long, encoded_chars long")


def sample_edits(doc_id: Column, text: Column) -> Column:
    """Three edits of a document at places that its id decides: a replacement, an insertion and a deletion."""
    length = F.coalesce(F.length(text), F.lit(0))
    at = [(F.crc32(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(k)).cast("binary")) % (length + 1)).cast("int") for k in ("replace", "insert", "delete")]
    one = lambda a, b, t: F.struct(a.alias("first"), b.alias("end"), F.lit(t).alias("text"))
    return F.array(one(at[0], at[0] + 5, "revised "), one(at[1], at[1], "\n it's  42 new words"), one(at[2], at[2] + 7, ""))
