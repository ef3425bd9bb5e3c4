"""Token ids in compressed blocks that give single documents at a short read.

Format (a Parquet folder, so that the writer's commit survives lost tasks and any store works):
`dictionary/`: one row (hash, body): the zstandard dictionary, trained on serialized id arrays
(little-endian unsigned 32-bit) of a bounded sample of documents, and its SHA-256.
`blocks/`: one row a block: part, block (number in the part), doc_ids (list), before (ids of the part's
documents before the block), hash (of the dictionary), index (little-endian unsigned 64-bit offsets, one
more than documents), body (one zstandard frame a document, end to end). Parts and blocks ascend by
doc_id. A frame is found through the index and read alone.

Nulls: a null text is empty (the end id alone); rows with null doc_id come first; equal ids keep all rows,
in the order of their text. Empty tables give an empty folder and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscape.llm import text as T
from lexiscape.llm import tokens as K
from lexiscape.session import Scratch

END = 2
#: Documents whose ids train the dictionary, bytes of ids taken from each, and the dictionary's size.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 500, 16_384, 65_536
BLOCK_BYTES, LEVEL = 4 << 20, 3
BLOCK = "part int, block int, doc_ids array<long>, before long, tokens long, hash string, index binary, body binary"


def train(docs: DataFrame, end: int = END, vocabulary: str | None = None) -> bytes:
    """A dictionary from the SAMPLE_DOCS documents of smallest id hash (it affects size only, never content)."""
    import zstandard

    keep = T.sample(T.id_text(docs), SAMPLE_DOCS, "doc_id").select(F.substring("text", 1, SAMPLE_BYTES).alias("text")).collect()
    ids, off = K.with_end(*K.encoder(vocabulary).encode(pa.array([r["text"] for r in keep], pa.string())), end)
    samples = [ids[s:e].tobytes()[:SAMPLE_BYTES] for s, e in zip(off, off[1:])]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little to train on: the samples themselves are the dictionary
        return b"".join(samples)[-DICTIONARY_BYTES:].rjust(8, b"\0")


def write(docs: DataFrame, path: str, end: int = END, vocabulary: str | None = None) -> None:
    """Writes all documents to a folder in ascending order of doc_id."""
    spark = docs.sparkSession
    T.bounded_batches(spark)
    body = train(docs, end, vocabulary)
    digest = hashlib.sha256(body).hexdigest()
    spark.createDataFrame([(digest, bytearray(body))], "hash string, body binary").coalesce(1).write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(body)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(shared.value))
        enc, part = K.encoder(vocabulary), TaskContext.get().partitionId()
        frames, names, block, before, tokens, held = [], [], 0, 0, 0, 0

        def flush():
            index = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype("<u8").tobytes()
            return pa.RecordBatch.from_pylist([{"part": part, "block": block, "doc_ids": names, "before": before, "tokens": tokens, "hash": digest, "index": index, "body": b"".join(frames)}], SCHEMA)

        for b in T.slices(batches, limit=K.SLICE_BYTES):
            ids, off = K.with_end(*enc.encode(b.column("text")), end)
            data = ids.astype("<u4", copy=False).tobytes()
            for name, s, e in zip(b.column("doc_id").to_pylist(), off.tolist(), off[1:].tolist()):
                frames.append(pack.compress(data[4 * s : 4 * e]))
                names.append(name)
                held, tokens = held + len(frames[-1]), tokens + e - s
                if held >= BLOCK_BYTES:
                    yield flush()
                    frames, names, block, before, tokens, held = [], [], block + 1, before + tokens, 0, 0
        if frames:
            yield flush()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = T.id_text(docs).repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    rows.mapInArrow(each, BLOCK).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


SCHEMA = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("before", pa.int64()), ("tokens", pa.int64()), ("hash", pa.string()), ("index", pa.binary()), ("body", pa.binary())])


def _dictionary(spark: SparkSession, path: str) -> dict[str, bytes]:
    found = {r["hash"]: bytes(r["body"]) for r in spark.read.parquet(f"{path}/dictionary").collect()}
    for digest, body in found.items():
        if hashlib.sha256(body).hexdigest() != digest:
            raise ValueError("the dictionary does not match its hash")
    return found


def read(spark: SparkSession, path: str, with_ids: bool = False, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32[, ids] of all documents, or of a few, of which only the frames are read."""
    shared = spark.sparkContext.broadcast(_dictionary(spark, path))
    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    totals = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("tokens").alias("n")).collect()}  # a row a file
    before, at = {}, 0
    for part in sorted(totals):
        before[part], at = at, at + totals[part]
    wanted = None if doc_ids is None else set(doc_ids)
    if wanted is not None:
        blocks = blocks.where(F.arrays_overlap("doc_ids", F.array(*(F.lit(i).cast("long") for i in sorted(wanted)))))

    def each(batches):
        import zstandard

        packs = {k: zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(v)) for k, v in shared.value.items()}
        for b in batches:
            for r in range(b.num_rows):
                one = b.slice(r, 1).to_pylist()[0]
                index, pack = np.frombuffer(one["index"], "<u8").astype(np.int64).tolist(), packs[one["hash"]]
                start, rows = before[one["part"]] + one["before"], []
                for name, s, e in zip(one["doc_ids"], index, index[1:]):
                    if wanted is not None and name not in wanted:
                        n = zstandard.frame_content_size(one["body"][s : s + 18]) // 4
                    else:
                        ids = pack.decompress(one["body"][s:e])
                        n = len(ids) // 4
                        rows.append((name, start, n, zlib.crc32(ids), ids))
                    start += n
                cols = [pa.array([x[i] for x in rows], pa.int64()) for i in range(4)]
                if with_ids:
                    cols.append(pa.array([np.frombuffer(x[4], "<u4").astype(np.int64) for x in rows], pa.list_(pa.int64())))
                yield pa.record_batch(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return blocks.mapInArrow(each, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def round_trip(docs: DataFrame, end: int = END, vocabulary: str | None = None) -> DataFrame:
    """What reading the written files gives."""
    path = Scratch(docs.sparkSession).path()
    write(docs, path, end, vocabulary)
    return read(docs.sparkSession, path)
