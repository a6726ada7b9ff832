"""Token ids as Arrow files of equal-length sequences.

Documents are ordered by id over ranges, so file follows file and each holds one stretch of the token stream. A file has
record batches of fixed-size lists: ``ids`` (16 bits where the vocabulary allows) and ``mask`` (false for the
padding after the last token). Any sequence can be mapped into memory and sliced without a copy. A second
file beside it says where each document begins and how long it is.

Tasks write under names of their own and report them; only reported files belong to the result, so a task
that was lost or run twice leaves at most a file that nobody reads. Memory holds one batch per task.

Defined cases: a null or empty text is the end token alone; null ids come first; rows with the same id stand in
the order of their texts, each a document; a text of any length is written whole; an empty table
gives no files and an empty result; only id and text are read, so other columns cannot clash.
"""

import json
import uuid
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagmill.llm.tokens import encoder, slices
from tagmill.storage import fresh_path, settle

BATCH_SEQUENCES = 256


class Format(NamedTuple):
    tokenizer: str
    length: int = 1024
    end_id: int = 2


def opened(path: str):
    """File system and path of a URI or a plain path."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


class SequenceWriter:
    """Writes a stream of ids as batches of equal-length sequences."""

    def __init__(self, stream, width, length: int):
        self.length, self.width = length, width
        item = pa.from_numpy_dtype(width)
        self.schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.file = ipc.new_file(stream, self.schema)
        self.held, self.count, self.total = [], 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.width))
        self.count += len(ids)
        self.total += len(ids)
        block = BATCH_SEQUENCES * self.length
        if self.count >= block:
            flat = np.concatenate(self.held)
            whole = len(flat) // block * block
            for start in range(0, whole, block):
                self.write(flat[start : start + block])
            self.held, self.count = [flat[whole:]], len(flat) - whole

    def write(self, flat: np.ndarray) -> None:
        rows = -(-len(flat) // self.length)
        mask = np.zeros(rows * self.length, bool)
        mask[: len(flat)] = True
        padded = np.zeros(rows * self.length, self.width)
        padded[: len(flat)] = flat
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (padded, mask)]
        self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.count:
            self.write(np.concatenate(self.held))
        self.file.close()


def write_tokens(docs: DataFrame, layout: Format, folder: str | None = None, text="text", ident="doc_id") -> DataFrame:
    """Write the files; the manifest has ``part, path, n_docs, n_tokens`` and ``start``, the tokens in earlier files."""
    folder = folder or fresh_path(docs.sparkSession, "tokens")
    system, place = opened(folder)
    system.create_dir(place, recursive=True)

    def write(batches):
        coder = encoder(layout.tokenizer, layout.end_id)
        width = np.dtype("<u2" if coder.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        system, place = opened(folder)
        part = TaskContext.get().partitionId()
        name = f"{place}/tokens-{part:06d}-{uuid.uuid4().hex}"
        writer = stream = index = None
        docs_seen = 0
        for batch in batches:
            for rows in slices(batch, 1):
                if writer is None:
                    stream, marks = system.open_output_stream(f"{name}.arrow"), system.open_output_stream(f"{name}.index")
                    writer = SequenceWriter(stream, width, layout.length)
                    schema = pa.schema([("id", rows.column(0).type), ("start", pa.int64()), ("n_tokens", pa.int64())])
                    index = ipc.new_file(marks, schema)
                ids, edges = coder.ids(rows.column(1))
                index.write_batch(pa.RecordBatch.from_arrays([rows.column(0), pa.array(edges[:-1] + writer.total), pa.array(np.diff(edges))], schema=schema))
                writer.add(ids)
                docs_seen += rows.num_rows
        if writer is not None:
            writer.close()
            index.close()
            stream.close()
            marks.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{folder}/{name.rpartition('/')[2]}"], "n_docs": [docs_seen], "n_tokens": [writer.total]})

    rows = docs.select(F.col(ident).alias("id"), F.col(text).alias("text")).repartitionByRange("id").sortWithinPartitions("id", "text")
    found = settle(rows.mapInArrow(write, "part bigint, path string, n_docs bigint, n_tokens bigint"), "manifest")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return settle(found.withColumn("start", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))), "manifest")


def read_documents(manifest: DataFrame, kind: str = "bigint") -> DataFrame:
    """``id, start, n_tokens, ids_crc32`` of every document, from the files."""

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                system, place = opened(row["path"])
                with system.open_input_file(f"{place}.arrow") as tokens, system.open_input_file(f"{place}.index") as marks:
                    yield from checked(ipc.open_file(tokens), ipc.open_file(marks), row["start"])

    files = max(manifest.count(), 1)
    schema = f"id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint"
    return manifest.select("path", "start").repartition(files).mapInArrow(read, schema)


def checked(tokens, index, before: int):
    """Batches of documents with the checksum of their ids, one batch of sequences at a time."""
    held, at, upto, number = b"", 0, 0, 0  # bytes of the ids [at, upto)
    for i in range(index.num_record_batches):
        marks = index.get_batch(i)
        sums = []
        for start, count in zip(marks.column(1).to_pylist(), marks.column(2).to_pylist(), strict=True):
            crc, place = 0, start
            while place < start + count:
                if place >= upto:
                    block = tokens.get_batch(number)
                    ids, mask = (c.values.to_numpy(zero_copy_only=False) for c in block.columns)
                    held, at = ids[mask].astype("<u4").tobytes(), upto
                    upto, number = at + len(held) // 4, number + 1
                end = min(start + count, upto)
                crc = zlib.crc32(memoryview(held)[4 * (place - at) : 4 * (end - at)], crc)
                place = end
            sums.append(crc)
        starts = np.array(marks.column(1)) + before
        yield pa.RecordBatch.from_arrays([marks.column(0), pa.array(starts), marks.column(2), pa.array(sums, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])


class Sequences:
    """Random access to the sequences of one local file, without copies."""

    def __init__(self, path: str):
        self.file = ipc.open_file(pa.memory_map(path))

    def __getitem__(self, number: int):
        batch = self.file.get_batch(number // BATCH_SEQUENCES)
        ids, mask = batch.column(0)[number % BATCH_SEQUENCES], batch.column(1)[number % BATCH_SEQUENCES]
        return ids.values.to_numpy(zero_copy_only=True), mask.values


def describe(manifest: DataFrame, layout: Format) -> str:
    """What a reader needs to know, as JSON."""
    return json.dumps({"length": layout.length, "batch_sequences": BATCH_SEQUENCES, "end_id": layout.end_id, "files": manifest.count()})
