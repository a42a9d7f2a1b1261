"""Token ids as binary files: independent zstandard frames with a trailing seek table.

A file holds frames of whole documents (a document longer than a frame has one of its own), a skippable frame with
the document index, and a skippable frame with the seek table: for each frame its compressed and plain size and the
low 32 bits of the XXH64 of its plain bytes, then the number of frames, a descriptor and a magic number. A reader
takes the tail first, then only the frames that hold what it wants, and checks each one.
"""

import io
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, open_fs, shuffle_width, slices
from quillspark.llm.words import encoder

#: Fixed values of the seekable zstandard format.
SKIPPABLE, SEEK_FRAME, SEEK_END, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
FRAME_BYTES = 1 << 20
#: Index of documents: frame, first byte in the frame's plain bytes, bytes, ids before it in the file.
PLACES = (("frame", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("start", pa.int64()))


class TokenFileWriter:
    """Takes documents in order; close() writes the index and the seek table."""

    def __init__(self, sink, key_type: pa.DataType, width: int = 2, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.sink, self.key_type, self.width, self.frame_bytes = sink, key_type, width, frame_bytes
        self.zip = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames, self.keys, self.places = [], [], []
        self.plain, self.held, self.start = [], 0, 0

    def add(self, key, ids: bytes) -> None:
        if self.held and self.held + len(ids) > self.frame_bytes:
            self._flush()
        self.keys.append(key)
        self.places.append((len(self.frames), self.held, len(ids), self.start))
        self.plain.append(ids)
        self.held += len(ids)
        self.start += len(ids) // self.width

    def _flush(self) -> None:
        plain = b"".join(self.plain)
        packed = self.zip.compress(plain)
        self.sink.write(packed)
        self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.plain, self.held = [], 0

    def close(self) -> None:
        if self.held or self.plain:
            self._flush()
        columns = list(zip(*self.places, strict=True)) or [[]] * len(PLACES)
        index = pa.table({"key": pa.array(self.keys, self.key_type)} | {n: pa.array(c, t) for (n, t), c in zip(PLACES, columns, strict=True)})
        index = index.replace_schema_metadata({"width": str(self.width)})
        body = io.BytesIO()
        with pa.ipc.new_stream(body, index.schema) as w:
            w.write_table(index)
        body = self.zip.compress(body.getvalue())
        self.sink.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEK_END)
        self.sink.write(struct.pack("<II", SEEK_FRAME, len(table)) + table)


class TokenFileReader:
    """Reads the tail of a seekable source (with size(), seek() and read()), then single frames on demand."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        count, descriptor, magic = struct.unpack("<IBI", self._read(end - 9, 9))
        if magic != SEEK_END or not descriptor & CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        head = end - 9 - 12 * count - 8
        if struct.unpack("<I", self._read(head, 4))[0] != SEEK_FRAME:
            raise ValueError("the seek table is not where its length says")
        entries = np.frombuffer(self._read(head + 8, 12 * count), "<u4").reshape(count, 3).astype(np.int64)
        self.sizes, self.plain, self.sums = entries[:, 0], entries[:, 1], entries[:, 2]
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        magic, size = struct.unpack("<II", self._read(int(self.at[-1]), 8))
        if magic != SKIPPABLE or int(self.at[-1]) + 8 + size != head:
            raise ValueError("the document index is damaged")
        self.index = pa.ipc.open_stream(zstandard.decompress(self._read(int(self.at[-1]) + 8, size))).read_all()
        self.width = int(self.index.schema.metadata[b"width"])

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def frame(self, k: int) -> bytes:
        plain = zstandard.ZstdDecompressor().decompress(self._read(int(self.at[k]), int(self.sizes[k])), max_output_size=int(self.plain[k]))
        if len(plain) != self.plain[k] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} fails its checksum")
        return plain

    def documents(self, keys=None):
        """(key, ids before it in the file, its ids) of all documents, or of those whose key is in keys; no other frame is read."""
        held, plain = -1, b""
        rows = self.index.to_pydict()
        for key, frame, at, size, start in zip(rows["key"], *(rows[n] for n, _ in PLACES), strict=True):
            if keys is not None and key not in keys:
                continue
            if frame != held:
                held, plain = frame, self.frame(frame)
            yield key, start, np.frombuffer(plain, f"<u{self.width}", size // self.width, at)


def write_token_files(docs: DataFrame, out_dir: str, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Encode every text and write the ids in ascending id order; returns the manifest: part, path, n_docs, n_tokens, base.

    Texts are dealt out once, by ranges of ids and, within an id, of hashes of the text and of places in the scan, so
    that rows of one id, even wholly equal ones, are no single task; the borders come from a sample. A task encodes its
    sorted range as it streams by and writes one file; a repeated task writes a file of its own and only the file
    named in the manifest counts. Null and empty texts have the end id only; null ids come first; repeated ids stay next
    to each other, ordered by the XXH64 of their texts; an empty table writes no file; other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("k"), text.alias("t"), F.xxhash64(text).alias("h"), F.xxhash64(F.monotonically_increasing_id()).alias("d"))
    tail = [] if end_id is None else [end_id]
    parts = max(shuffle_width(spark), docs.rdd.getNumPartitions())
    ordered = rows.repartitionByRange(parts, "k", "h", "d").sortWithinPartitions("k", "h").select("k", "t")

    def write(batches):
        enc, files, path = encoder(tokenizer), None, ""
        width = 2 if enc.whole.get_vocab_size() <= 1 << 16 and max(tail, default=0) < 1 << 16 else 4
        end = np.array(tail, f"<u{width}").tobytes()
        part = TaskContext.get().partitionId()
        for batch in batches:
            if batch.num_rows and files is None:
                fs, where = open_fs(out_dir)
                fs.create_dir(where, recursive=True)
                path = f"part-{part:06d}-{uuid.uuid4().hex[:12]}.ids.zst"
                sink = fs.open_output_stream(f"{where}/{path}", compression=None)
                files = TokenFileWriter(sink, batch.column(0).type, width, frame_bytes)
            keys = batch.column(0).to_pylist()
            for first, texts in slices(batch.column(1)):
                for key, ids in zip(keys[first : first + len(texts)], enc.encode(texts), strict=True):
                    files.add(key, np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes() + end)
        if files is not None:
            files.close()
            sink.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "path": f"{out_dir}/{path}", "n_docs": len(files.keys), "n_tokens": files.start}])

    written = materialize(ordered.mapInArrow(write, "part long, path string, n_docs long, n_tokens long"), "manifest")
    rows = sorted(written.collect())  # one row a file
    before, manifest = 0, []
    for r in rows:
        manifest.append((*r, before))
        before += r["n_tokens"]
    return spark.createDataFrame(manifest, "part long, path string, n_docs long, n_tokens long, base long")


def read_token_files(manifest: DataFrame, kind, digest_only: bool = True) -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and the ids unless digest_only."""
    from pyspark.sql import types as T

    fields = [T.StructField("doc_id", kind), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    fields += [] if digest_only else [T.StructField("ids", T.ArrayType(T.IntegerType()))]

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, where = open_fs(path)
                with fs.open_input_file(where) as source:
                    reader = TokenFileReader(source)
                    key_type, rows = reader.index.schema.field("key").type, []
                    for key, start, ids in reader.documents():
                        rows.append((key, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) + (() if digest_only else (ids.astype(np.int32),)))
                        if len(rows) >= (5000 if digest_only else 200):
                            yield batch_of(rows, key_type)
                            rows = []
                    if rows:
                        yield batch_of(rows, key_type)

    def batch_of(rows, key_type):
        types = [key_type, pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], [f.name for f in fields])

    spark: SparkSession = manifest.sparkSession
    n = max(shuffle_width(spark), 1)
    return manifest.select("path", "base").repartition(n).mapInArrow(read, T.StructType(fields))
