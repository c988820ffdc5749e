"""Token ids as seekable files: one independent zstandard frame per document and a trailing seek table.

A file holds, in ascending doc_id order, one frame per document with its ids as little-endian integers (2 or 4 bytes
wide by the vocabulary's size), then a skippable frame with the documents' index (doc_id, ids), then the seek
table in the public seekable layout: a skippable frame (magic 0x184D2A5E) with compressed size, decompressed size and the low 32 bits
of the XXH64 of the decompressed bytes for each frame, and a footer (frame count, descriptor with the checksum flag,
magic 0x8F92EAB1). A reader takes the footer, the table and the index, and then only the frames that it wants.

Writers are tasks over ranges of doc_id. A task writes its file under a name of its own and reports it, so a lost executor's
task can run again; the manifest (a table of the shared folder) names the files that count. Files are opened with
pyarrow's file systems by URI.

Defined results: null text counts as empty and has the end id only; a null doc_id sorts first and is stored as the
smallest long; repeated doc_ids are kept, in order of their text; an empty table gives no files and no
rows; further columns are ignored. Memory: a batch of texts, and one document's ids.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalens.llm import shared
from stratalens.llm.bpe import encoder, library

SKIPPABLE, SEEK_MAGIC, INDEX_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
END_ID = 0
NO_ID = -(1 << 63)
MANIFEST = "path string, part int, first_id long, n_docs long, n_ids long, n_bytes long"
ROWS = "part int, pos long, doc_id long, start long, n_tokens long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(path: str, texts: list[str]) -> list[np.ndarray]:
    """Ids with the end id."""
    return [np.append(ids, np.uint32(END_ID)) for ids in encoder(path).encode(texts)]


class FrameWriter:
    """Writes documents to a binary stream; ``close`` adds index and seek table."""

    def __init__(self, out, width: int, level: int = 1):
        self.out, self.dtype = out, np.dtype(f"<u{width}")
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=True)
        self.doc_ids: list[int] = []
        self.counts: list[int] = []
        self.table: list[tuple[int, int, int]] = []

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        raw = ids.astype(self.dtype).tobytes()
        frame = self.pack.compress(raw)
        self.out.write(frame)
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids))
        self.table.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> None:
        index = zstandard.ZstdCompressor(level=3).compress(struct.pack("<BQ", self.dtype.itemsize, len(self.doc_ids)) + np.array(self.doc_ids, "<i8").tobytes() + np.array(self.counts, "<i8").tobytes())
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index) + 4) + index + struct.pack("<I", len(index)))
        entries = np.array(self.table, "<u4").tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.table), 0x80, SEEK_MAGIC))


class FrameReader:
    """Random access to a file's documents; checks each frame's checksum."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        count, descriptor, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != SEEK_MAGIC or descriptor != 0x80:
            raise ValueError("no seek table")
        at = size - 9 - 12 * count
        self.table = np.frombuffer(source.read_at(12 * count, at), "<u4").reshape(count, 3).astype(np.int64)
        at -= 8
        (length,) = struct.unpack("<I", source.read_at(4, at - 4))
        index = zstandard.ZstdDecompressor().decompress(source.read_at(length, at - 4 - length))
        self.width, n = struct.unpack("<BQ", index[:9])
        self.doc_ids = np.frombuffer(index, "<i8", n, 9)
        self.counts = np.frombuffer(index, "<i8", n, 9 + 8 * n)
        self.offsets = np.concatenate(([0], np.cumsum(self.table[:, 0])))
        self.unpack = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document; nothing else is decompressed."""
        packed, size, check = self.table[k]
        raw = self.unpack.decompress(self.source.read_at(int(packed), int(self.offsets[k])), max_output_size=int(size)) if size else b""
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"checksum of frame {k} is wrong")
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")

    def find(self, doc_id: int) -> list[int]:
        at = int(np.searchsorted(self.doc_ids, doc_id))
        end = int(np.searchsorted(self.doc_ids, doc_id, side="right"))
        return list(range(at, end))


def writer(root: str, path: str, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = own = None
        n_ids = 0
        part = 0
        for batch in batches:
            docs = batch.column("doc_id").fill_null(NO_ID).to_pylist()
            texts = batch.column("text").fill_null("").to_pylist()
            if not docs:
                continue
            if out is None:
                part = batch.column("part")[0].as_py()
                target, root_path = fs.FileSystem.from_uri(root)
                target.create_dir(root_path, recursive=True)
                name = f"ids-{part:06d}-{uuid.uuid4().hex}.zst"
                stream = target.open_output_stream(f"{root_path}/{name}", compression=None)
                out, own = stream, FrameWriter(stream, width)
            for doc_id, ids in zip(docs, encode(path, texts)):
                own.add(doc_id, ids)
                n_ids += len(ids)
        if out is not None:
            own.close()
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "part": pa.array([part], pa.int32()), "first_id": [own.doc_ids[0]], "n_docs": [len(own.doc_ids)], "n_ids": [n_ids], "n_bytes": [size]})

    return write


def write_frames(docs: DataFrame, root: str, tokenizer_path: str | None = None) -> DataFrame:
    """Encode every document into files below ``root``; returns the manifest, one row per file."""
    spark = docs.sparkSession
    shared.bounded_batches(spark, rows=256, mb=4)
    path = tokenizer_path or default_tokenizer()
    width = 2 if library(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
    rows = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())
    return shared.written(rows.mapInArrow(writer(f"{root}/files", path, width), MANIFEST), f"{root}/manifest")


def reader(root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, root_path = fs.FileSystem.from_uri(root)
        for batch in batches:
            for row in batch.to_pylist():
                with target.open_input_file(f"{root_path}/{row['path']}") as source:
                    frames = FrameReader(source)
                    starts = row["before"] + np.concatenate(([0], np.cumsum(frames.counts)))
                    for at in range(0, len(frames), 4096):
                        ks = range(at, min(at + 4096, len(frames)))
                        crcs = [zlib.crc32(frames.ids(k).tobytes()) for k in ks]
                        ids = frames.doc_ids[at : ks.stop]
                        yield pa.RecordBatch.from_pydict({
                            "part": pa.array([row["part"]] * len(ks), pa.int32()), "pos": pa.array(list(ks), pa.int64()),
                            "doc_id": pa.array(ids, pa.int64(), mask=ids == NO_ID), "start": pa.array(starts[at : ks.stop], pa.int64()),
                            "n_tokens": pa.array(frames.counts[at : ks.stop], pa.int64()), "ids_crc32": pa.array(crcs, pa.int64()),
                        })

    return read


def read_digests(manifest: DataFrame, root: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    spark = manifest.sparkSession
    order = Window.orderBy("part")  # one row per file
    files = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    files = files.select("path", "part", "before").repartition(max(1, shared.partitions_of(spark)), "part")
    return files.mapInArrow(reader(f"{root}/files"), ROWS).select("doc_id", "start", "n_tokens", "ids_crc32")


def read_documents(spark: SparkSession, root: str, doc_ids: DataFrame) -> DataFrame:
    """doc_id, ids of the requested documents: files are chosen by their range of ids, and only the documents' own frames are decompressed."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    files = manifest.withColumn("next_id", F.lead("first_id").over(Window.orderBy("part")))
    ranges = files.select("path", "part", "first_id", F.coalesce("next_id", F.lit((1 << 63) - 1)).alias("next_id"))
    wanted = doc_ids.select("doc_id").where("doc_id is not null").distinct()
    # one row per file: a range join with the file table, whose size is checked before it is sent to all
    side = F.broadcast(ranges) if ranges.count() <= 100_000 else ranges
    hits = wanted.join(side, (F.col("doc_id") >= F.col("first_id")) & (F.col("doc_id") <= F.col("next_id"))).select("path", "doc_id").repartition("path").sortWithinPartitions("path", "doc_id")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, root_path = fs.FileSystem.from_uri(f"{root}/files")
        name = source = frames = None
        for batch in batches:
            found: list[tuple[int, list[int]]] = []
            for row in batch.to_pylist():
                if row["path"] != name:
                    if source is not None:
                        source.close()
                    name, source = row["path"], target.open_input_file(f"{root_path}/{row['path']}")
                    frames = FrameReader(source)
                found += [(row["doc_id"], frames.ids(k).astype(np.int64).tolist()) for k in frames.find(row["doc_id"])]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([x for x, _ in found], pa.int64()), "ids": pa.array([x for _, x in found], pa.list_(pa.int64()))})
        if source is not None:
            source.close()

    return hits.mapInArrow(fetch, "doc_id long, ids array<long>")


def token_output(docs: DataFrame, root: str | None = None, tokenizer_path: str | None = None) -> DataFrame:
    root = root or shared.fresh_dir(docs.sparkSession, "token-frames")
    return read_digests(write_frames(docs, root, tokenizer_path), root)
