"""SentencePiece ids by a table of distinct marked words.

SentencePiece marks blanks with the sign U+2581 and merges pieces inside a text. Where no piece of the model reaches from a word
into the marker that follows it, merges never cross that border, and a marked word (markers and the signs after
them) has the same ids wherever it stands. Signs that occur in no piece of two signs or more (line breaks, for instance) part a text in the same way.

1. Documents are taken in blocks of BLOCK characters. A block's distinct chunks are numbered; its documents become one array of these
   numbers, which is written in buckets of the block. The chunks go out packed by hash bucket, one row per block and bucket.
2. Rows of a bucket meet in one task. It keeps the bucket's table of distinct chunks, segments each of them once with the library, and answers every row with ids.
   A chunk is asked for once a block at most, however frequent it is. The number of buckets grows with the input.
3. Rows of a block meet again, and the ids are joined to the documents by position.

A model that isn't of this form (another type than BPE, a character map, pieces across markers) has whole texts as chunks, which is right for
any model.

Defined results: null texts count as empty and have no ids; an empty text has none and decodes to an empty text; null and repeated rows are kept one by one; an
empty table gives no rows; columns that aren't named in ``keep`` are ignored. Memory: a block or one document, and the distinct chunks of one bucket.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm import shared

MARK = "▁"
#: Characters of texts in a block, bytes of input for each bucket, and the most buckets.
BLOCK, BUCKET, MOST_BUCKETS = 16 << 20, 16 << 20, 1 << 17
#: Bytes of input for each bucket of the written table, and the most of these; estimates from here on mean that nothing is known.
SPLIT, MOST_FILES, UNKNOWN = 128 << 20, 100_000, 1 << 60
#: A run of signs outside all longer pieces is cut at this length; it may be cut anywhere.
RUN = 64


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Model:
    """The library's processor, and one without the dummy prefix for chunks."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        proto.ParseFromString(self.library.serialized_model_proto())
        norm, kinds = proto.normalizer_spec, proto.SentencePiece
        longer = [p.piece for p in proto.pieces if p.type == kinds.NORMAL and len(p.piece) > 1]
        self.parted = (
            proto.trainer_spec.model_type == proto.trainer_spec.BPE and not proto.trainer_spec.treat_whitespace_as_suffix
            and norm.escape_whitespaces and not norm.precompiled_charsmap and not norm.remove_extra_whitespaces
            and all(p.type in (kinds.NORMAL, kinds.UNKNOWN, kinds.CONTROL, kinds.BYTE) for p in proto.pieces)
            and not any(MARK in p.lstrip(MARK) for p in longer)
        )
        self.prefix = MARK if norm.add_dummy_prefix else ""
        if self.parted:
            signs = "".join(f"\\U{ord(c):08x}" for c in sorted(set("".join(longer)) - {MARK}))
            self.pattern = re.compile(f"{MARK}*[{signs}]+|{MARK}+|[^{signs}{MARK}]{{1,{RUN}}}" if signs else f"{MARK}+|[^{MARK}]{{1,{RUN}}}")
            norm.add_dummy_prefix = False
            self.plain = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        return self.pattern.findall(self.prefix + text.replace(" ", MARK)) if self.parted else [text]

    def segment(self, chunks: list[str]) -> list[list[int]]:
        return (self.plain if self.parted else self.library).encode(chunks, num_threads=1)


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def packed(values: np.ndarray) -> bytes:
    """Little-endian unsigned 32-bit integers, byte by byte of significance, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).view("<u4").ravel()


def splitter(path: str, buckets: int, keep: Sequence[str], block_size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def flush(block: int, kept: list[pa.RecordBatch], counts: list[int], places: list[np.ndarray], table: dict[str, int]) -> Iterator[pa.RecordBatch]:
        def rows(length: int, **columns: pa.Array) -> Iterator[pa.RecordBatch]:
            own = [columns.get(f.name, pa.nulls(length, f.type)) for f in fields]
            yield from pa.Table.from_arrays([pa.array([block] * length, pa.int64()), *own], ["block", *(f.name for f in fields)]).to_batches(1_000)

        docs = pa.Table.from_batches(kept).combine_chunks()
        fields = [*docs.schema, pa.field("row", pa.int32()), pa.field("n", pa.int64()), pa.field("places", pa.binary()), pa.field("homes", pa.binary()), pa.field("bucket", pa.int32()), pa.field("chunks", pa.binary())]
        n = len(counts)
        yield from rows(n, row=pa.array(range(n), pa.int32()), n=pa.array(counts, pa.int64()), **dict(zip(docs.column_names, docs.columns)))
        raw = [c.encode() for c in table]
        homes = np.fromiter((xxhash.xxh3_64_intdigest(c) % buckets for c in raw), np.uint32, len(raw))
        yield from rows(1, row=pa.array([-1], pa.int32()), places=pa.array([packed(np.concatenate(places))], pa.binary()), homes=pa.array([packed(homes)], pa.binary()))
        order = np.argsort(homes, kind="stable")
        cuts = np.flatnonzero(np.diff(homes[order].astype(np.int64), prepend=-1))
        press = zstandard.ZstdCompressor(level=3).compress
        texts = [press(b"\0".join(_escaped(raw[i]) for i in order[a:b])) for a, b in zip(cuts, [*cuts[1:], len(order)])]
        yield from rows(len(cuts), bucket=pa.array(homes[order[cuts]], pa.int32()), chunks=pa.array(texts, pa.binary()))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        part, number = TaskContext.get().partitionId(), 0
        kept, counts, places, table, size = [], [], [], {}, 0
        for batch in batches:
            docs, first = batch.select(keep), 0
            for i, text in enumerate(batch.column("__text").fill_null("").to_pylist()):
                found = own.chunks(text)
                places.append(np.fromiter((table.setdefault(c, len(table)) for c in found), np.uint32, len(found)))
                counts.append(len(found))
                size += len(text)
                if size >= block_size:
                    yield from flush(part << 32 | number, [*kept, docs.slice(first, i + 1 - first)], counts, places, table)
                    number, first = number + 1, i + 1
                    kept, counts, places, table, size = [], [], [], {}, 0
            if first < len(docs):
                kept.append(docs.slice(first))
        if counts:
            yield from flush(part << 32 | number, kept, counts, places, table)

    return split


def _escaped(chunk: bytes) -> bytes:
    """Without zero bytes, so that one can part chunks."""
    return chunk.replace(b"\1", b"\1\2").replace(b"\0", b"\1\1") if b"\0" in chunk or b"\1" in chunk else chunk


def _plain(chunk: bytes) -> str:
    return (re.sub(b"\1([\1\2])", lambda m: b"\0" if m[1] == b"\1" else b"\1", chunk) if b"\1" in chunk else chunk).decode()


ANSWER = "block long, bucket int, counts binary, ids binary"


def segmenter(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        table: dict[bytes, np.ndarray] = {}
        now = None
        for batch in batches:
            counts, ids = [], []
            for bucket, chunks in zip(batch.column("bucket").to_pylist(), batch.column("chunks").to_pylist()):
                if bucket != now:
                    now, table = bucket, {}
                asked = zstandard.ZstdDecompressor().decompress(chunks).split(b"\0")
                new = [c for c in asked if c not in table]
                for c, found in zip(new, own.segment([_plain(c) for c in new])):
                    table[c] = np.array(found, np.uint32)
                found = [table[c] for c in asked]
                counts.append(packed(np.fromiter(map(len, found), np.uint32, len(found))))
                ids.append(packed(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("bucket"), pa.array(counts, pa.binary()), pa.array(ids, pa.binary())], ["block", "bucket", "counts", "ids"])

    return segment


def joiner(keep: Sequence[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def join(parts: pa.Table, answers: pa.Table) -> pa.Table:
        row = parts.column("row").to_numpy()
        docs = parts.take(pa.array(np.flatnonzero(row >= 0)[np.argsort(row[row >= 0], kind="stable")]))
        meta = parts.take(pa.array(np.flatnonzero(row < 0)))
        where, homes = unpacked(meta.column("places")[0].as_py()), unpacked(meta.column("homes")[0].as_py())
        answers = answers.sort_by("bucket")
        sizes = [unpacked(x) for x in answers.column("counts").to_pylist()]
        ids = [unpacked(x) for x in answers.column("ids").to_pylist()]
        none = [np.zeros(0, np.uint32)]
        sizes, ids = np.concatenate(sizes or none).astype(np.int64), np.concatenate(ids or none).astype(np.int32)
        # the answers come by bucket and number; a chunk's place among them
        at = np.empty(len(homes), np.int64)
        at[np.argsort(homes, kind="stable")] = np.arange(len(homes))
        slot = at[where]
        starts = np.concatenate(([0], np.cumsum(sizes)))[:-1] if len(sizes) else np.zeros(0, np.int64)
        each = sizes[slot]
        ends = np.concatenate(([0], np.cumsum(each)))
        flat = ids[np.repeat(starts[slot] - ends[:-1], each) + np.arange(ends[-1])]
        bounds = np.concatenate(([0], np.cumsum(docs.column("n").to_numpy())))
        lists = pa.LargeListArray.from_arrays(pa.array(ends[bounds], pa.int64()), pa.array(flat, pa.int32())).cast(pa.list_(pa.int32()))
        return pa.Table.from_arrays([*(docs.column(c) for c in keep), lists], [*keep, "ids"])

    return join


def input_size(docs: DataFrame) -> int:
    """The planner's estimate of the input's bytes; 0 where it has none."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < UNKNOWN else 0


def encode(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", model_path: str | None = None, block_size: int = BLOCK, buckets: int | None = None) -> DataFrame:
    """``keep`` columns and ids of every row's text. ``buckets`` of chunks come from the input's estimated size, and from the session's partitions where
    nothing is known of it (rows that don't come from files)."""
    spark = docs.sparkSession
    shared.bounded_batches(spark, rows=256, mb=4)
    path = model_path or default_model()
    inner = [f"__k{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(c).alias(k) for c, k in zip(keep, inner)), F.col(text).alias("__text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != "__text")
    schema = f"block long, {fields}row int, n long, places binary, homes binary, bucket int, chunks binary"
    size, least = input_size(rows), shared.partitions_of(spark)
    buckets = buckets or min(MOST_BUCKETS, max(least, size // BUCKET))
    # in buckets of the block: the arrays of numbers, the largest part, stay where they are until the ids come to them
    parts = shared.bucketed(rows.mapInArrow(splitter(path, buckets, inner, block_size), schema), f"{shared.fresh_dir(spark, 'pieces')}/parts", "block", min(MOST_FILES, max(least, size // SPLIT)))
    asked = parts.where("bucket is not null").select("block", "bucket", "chunks").repartition("bucket").sortWithinPartitions("bucket")
    answers = asked.mapInArrow(segmenter(path), ANSWER)
    homes = parts.where("row is not null").select("block", *inner, "row", "n", "places", "homes")
    out = homes.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(joiner(inner), f"{fields}ids array<int>")
    return out.select(*(F.col(k).alias(c) for c, k in zip(keep, inner)), "ids")


def decoder(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            texts = [own.library.decode(ids) if ids else "" for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return decode


def decode(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """All columns and the decoded text; null ids decode to an empty text."""
    shared.bounded_batches(encoded.sparkSession, rows=256, mb=4)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(decoder(model_path or default_model()), f"{fields}, decoded string")
