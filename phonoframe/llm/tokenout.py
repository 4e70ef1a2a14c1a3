"""Token ids as bit-plane files, and their reader.

A file holds whole documents in ascending id order. Layout, all numbers little-endian:

    magic `PLN1`, then chunks one after the other, then the footer, its length (8 bytes), magic `PLN1`
    chunk: up to CHUNK_IDS ids, transposed into planes: with bits, plane k is bit k of every id, packed 8 to a byte; with
           bytes, byte k of every id. Planes beyond the chunk's highest set bit are left out. Each plane is compressed
           with zstandard on its own.
    footer: JSON: the plane kind, the chunk index (offset, ids, sizes of the planes), and the documents (ids and token counts)

Documents never depend on where chunks end: the chunk index finds any range of ids.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phonoframe.llm.common import cut, shared_dir, tidy

MAGIC = b"PLN1"
CHUNK_IDS = 1 << 16
SLICE_BYTES = 2_000_000  # text that is tokenized at once
FILE_BYTES = 256_000_000  # bytes of the input that one file holds, about; there are spark.sql.shuffle.partitions files at least
FILE_DOCS = 500_000  # documents of a file; beyond it a task begins another one, so footers stay small
READ_DOCS = 20_000  # documents that the reader gives at once
CACHE_WORDS = 800_000  # words whose ids a worker remembers, in about 200 MB; the memory is emptied when full
END_ID = 1


# The parts of a tokenizer file for which ids can be looked up word by word
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class Encoder:
    """Ids of whole texts, word by word.

    This holds for tokenizers with the normaliser and splitter named below; with another one whole texts are encoded.
    The tokenizer splits at white space, and its normalisation never looks across it, so a text's ids are those of its
    words between ASCII white space, and each different word is encoded once. It also splits between a letter and `.,;:!?`
    and lower-cases, so such marks count as words, and words of ASCII are lower-cased before they are looked up.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        special = all(t["special"] and not t["single_word"] and not t["lstrip"] and not t["rstrip"] and not t["normalized"] and not re.search(r"\s|[A-Za-z][.,;:!?]", t["content"]) for t in parts["added_tokens"])
        self.by_word = special and (parts["normalizer"], parts["pre_tokenizer"]) == (NORMALIZER, SPLITTER) and not parts["truncation"] and not parts["padding"] and parts["model"]["type"] == "BPE" and not parts["model"]["dropout"]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}  # place of a word's ids in begin and size
        self.begin, self.size, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def learn(self, words: list[str]) -> None:
        ids: list[np.ndarray] = []
        size: list[int] = []
        for at in range(0, len(words), 4096):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(words[at : at + 4096], add_special_tokens=False)]
            size += map(len, found)
            ids.append(np.fromiter(chain.from_iterable(found), np.uint32))
        n, sizes = len(self.known), np.array(size, np.int64)
        self.known.update(zip(words, range(n, n + len(words)), strict=True))
        self.begin = np.concatenate((self.begin, len(self.pool) + np.cumsum(sizes) - sizes))
        self.size = np.concatenate((self.size, sizes))
        self.pool = np.concatenate((self.pool, *ids))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text); nulls count as empty."""
        import pyarrow.compute as pc

        if not self.by_word:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(pc.fill_null(texts, "").to_pylist(), add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(found), np.uint32), np.array(list(map(len, found)), np.int64)
        spaced = pc.replace_substring_regex(pc.fill_null(texts.cast(pa.large_string()), ""), "([A-Za-zÀ-ÖØ-öø-ÿ])([.,;:!?])", r"\1 \2")
        words = pc.ascii_split_whitespace(spaced)
        flat = words.flatten()
        flat = pc.if_else(pc.string_is_ascii(flat), pc.ascii_lower(flat), flat).dictionary_encode()
        names = flat.dictionary.to_pylist()
        place = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        new = np.nonzero(place < 0)[0]
        if len(new):
            if self.known and len(self.known) + len(new) > CACHE_WORDS:
                self.forget()
                new = np.arange(len(names))
            place[new] = len(self.known) + np.arange(len(new))
            self.learn([names[k] for k in new.tolist()])
        begin, size, code = self.begin[place], self.size[place], flat.indices.to_numpy(zero_copy_only=False)
        each = size[code]
        ends = np.cumsum(each)
        total = int(ends[-1]) if len(ends) else 0
        out = self.pool[np.arange(total) + np.repeat(begin[code] - (ends - each), each)]
        edge = np.concatenate(([0], ends))[np.asarray(words.offsets) - words.offsets[0].as_py()]
        return out, np.diff(edge)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The encoder of this worker: later tasks go on with its words."""
    return Encoder(path)


def planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of one chunk, lowest first, without those above the highest set bit."""
    top = int(ids.max()).bit_length() if len(ids) else 0
    if kind == "byte":
        return [np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, k]).tobytes() for k in range((top + 7) // 8)]
    return [np.packbits(((ids >> np.uint32(k)) & np.uint32(1)).astype(np.uint8), bitorder="little").tobytes() for k in range(top)]


def unplanes(parts: list[bytes], n: int, kind: str) -> np.ndarray:
    ids = np.zeros(n, np.uint32)
    for k, part in enumerate(parts):
        row = np.frombuffer(part, np.uint8)
        ids |= row.astype(np.uint32) << np.uint32(8 * k) if kind == "byte" else np.unpackbits(row, count=n, bitorder="little").astype(np.uint32) << np.uint32(k)
    return ids


class Writer:
    """One file, written as it grows: no more than a chunk and one call's ids are held."""

    def __init__(self, sink, kind: str = "bit", level: int = 3) -> None:
        import zstandard

        self.sink, self.kind, self.packer = sink, kind, zstandard.ZstdCompressor(level=level)
        self.rest, self.index, self.docs, self.at = np.zeros(0, np.uint32), [], [], 4
        sink.write(MAGIC)

    def _flush(self, ids: np.ndarray) -> None:
        packed = [self.packer.compress(p) for p in planes(ids, self.kind)]
        self.sink.write(b"".join(packed))
        self.index.append([self.at, len(ids), [len(p) for p in packed]])
        self.at += sum(map(len, packed))

    def add(self, ids: np.ndarray, docs: list[tuple[int | None, int]]) -> None:
        self.docs += docs
        ids = np.concatenate((self.rest, ids))
        whole = len(ids) - len(ids) % CHUNK_IDS
        for a in range(0, whole, CHUNK_IDS):
            self._flush(ids[a : a + CHUNK_IDS])
        self.rest = ids[whole:]

    def close(self) -> None:
        if len(self.rest):
            self._flush(self.rest)
        footer = self.packer.compress(json.dumps({"kind": self.kind, "chunks": self.index, "docs": self.docs}).encode())
        self.sink.write(footer + struct.pack("<Q", len(footer)) + MAGIC)


def read_file(source) -> Iterator[tuple[int | None, np.ndarray]]:
    """(document id, its ids) in the order of the file; source: a seekable binary file."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    size = source.seek(0, 2)
    source.seek(size - 12)
    tail = source.read(12)
    if tail[8:] != MAGIC:
        raise ValueError("not a bit-plane file, or cut short")
    n = struct.unpack("<Q", tail[:8])[0]
    source.seek(size - 12 - n)
    footer = json.loads(unpack(source.read(n)))
    held, at, chunks = np.zeros(0, np.uint32), 0, iter(footer["chunks"])
    for doc, count in footer["docs"]:
        while len(held) - at < count:
            offset, ids, sizes = next(chunks)
            source.seek(offset)
            parts = [unpack(source.read(s)) for s in sizes]
            held, at = np.concatenate((held[at:], unplanes(parts, ids, footer["kind"]))), 0
        yield doc, held[at : at + count]
        at += count


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", kind: str = "bit", partitions: int | None = None) -> DataFrame:
    """Write every document's ids, each closed by id 1, and return the manifest: (shard long, path string, docs long, ids long).

    Shards follow each other in ascending id order; rows that share an id are ordered by a hash of the text, then the text, so
    that they may stand in several files, and null ids come first. Null
    texts are empty. A task writes to a name of its own and renames it when complete, and only files named in the manifest
    count, so retried or doubled tasks do no harm. An empty table gives no files. tokenizer: a file of the tokenizers library
    that executors find under the same path. folder: shared by all, in any store that pyarrow opens.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = partitions or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-_input_bytes(docs) // FILE_BYTES))
    rows = rows.withColumn("mark", F.xxhash64("text")).repartitionByRange(n, "doc_id", "mark").sortWithinPartitions("doc_id", "mark", "text").drop("mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        from pyspark import TaskContext

        coder, sink, n_docs, n_ids = encoder(tokenizer), None, 0, 0
        shard = TaskContext.get().partitionId() << 32
        store, root = _open(folder)

        def done() -> pa.RecordBatch:
            writer.close()
            sink.close()
            store.move(path + ".part", path)
            return pa.RecordBatch.from_pylist([{"shard": shard, "path": path, "docs": n_docs, "ids": n_ids}], pa.schema([("shard", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

        for batch in batches:
            sizes = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64))))
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(sizes, sizes[a] + SLICE_BYTES)) - 1)
                b = min(b, batch.num_rows)
                ids, counts = coder.encode(batch.column(1).slice(a, b - a))
                ids = np.insert(ids, np.cumsum(counts), END_ID)
                if sink is not None and n_docs + b - a > FILE_DOCS:
                    yield done()
                    sink, n_docs, n_ids, shard = None, 0, 0, shard + 1
                if sink is None:
                    store.create_dir(root, recursive=True)
                    path = f"{root}/ids-{shard >> 32:06d}-{shard & 0xFFFFFFFF:04d}-{uuid.uuid4().hex}.pln"
                    sink = store.open_output_stream(path + ".part")
                    writer = Writer(sink, kind)
                writer.add(ids, list(zip(batch.column(0).slice(a, b - a).to_pylist(), (counts + 1).tolist(), strict=True)))
                n_docs, n_ids, a = n_docs + b - a, n_ids + len(ids), b
        if sink is not None:
            yield done()

    return cut(rows.mapInArrow(tidy(run), "shard long, path string, docs long, ids long"))


def _input_bytes(docs: DataFrame) -> int:
    """As Spark's statistics have it; where they don't, the texts' bytes."""
    known = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if known < 1 << 60:
        return known
    return int(docs.select(F.sum(F.octet_length(F.concat_ws("", *[F.col(f"`{f.name}`") for f in docs.schema.fields if f.dataType.simpleString() == "string"])))).first()[0] or 0)


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, start counting the ids of all documents before it.
    No files: no rows. A file is read chunk by chunk, and its documents are given READ_DOCS at a time."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("shard", "path", "docs", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    files = files.repartition(max(1, manifest.count()), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                out, at = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}, row["base"]
                batch_of = lambda: pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})  # noqa: E731, B023
                with store.open_input_file(row["path"]) as source:
                    for doc, ids in read_file(source):
                        for name, v in zip(out, (doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                            out[name].append(v)
                        at += len(ids)
                        if len(out["doc_id"]) >= READ_DOCS:
                            yield batch_of()
                            out = {k: [] for k in out}
                yield batch_of()

    return files.select("path", "base").mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", kind: str = "bit", folder: str | None = None) -> DataFrame:
    """Write the files into a new folder in the shared one, or the one named, and return what reading them back gives: a row
    per input row, null ids and repeated rows included, null texts as empty ones; an empty table gives no rows."""
    folder = folder or f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    return read_tokens(write_tokens(docs, tokenizer, folder, id_col, text_col, kind), folder)
