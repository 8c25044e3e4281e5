"""Token-id files: canonical length-limited Huffman coding with bit-offset checkpoints.

The ids of every text are counted over all texts; the counts give code lengths
(package-merge, no code longer than ``longest`` bits), and the lengths alone
give the canonical codes. Ids are stored as their codes, each document from a
byte boundary on, in blocks of whole documents. A block holds its documents'
ids and token counts and the bit offset of every ``stride``-th token of each
document, so it can be decoded on its own and in many places at once: a table
of 2^longest entries gives the id and the code length for the next bits of
every place, and all places advance together.

The files are a Spark table of blocks (columns ``part``, ``block``, ``first``,
``doc_ids``, ``n_tokens``, ``checkpoints``, ``payload``) beside a one-row table
of code lengths. Partition number, block number and order inside a block follow
ascending document id. Spark's own writers and readers carry them, so any store
and any lost executor is Spark's to handle.

Defined results: a null or empty text is its end id alone; null ids come first;
repeated ids are all kept, in the order of their checksums and ids; an empty table
gives no block and reads back as no document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lernspur.llm import tokens
from lernspur.llm.common import fresh_path, materialize, shuffle_partitions

BLOCK = "part int, block int, first long, doc_ids array<{id}>, n_tokens array<int>, checkpoints array<long>, payload binary"


@dataclass(frozen=True)
class FileConfig:
    end_id: int = 2
    tokenizer: str | None = None
    longest: int = 18
    #: tokens between checkpoints, and about how many a block holds
    stride: int = 256
    block_tokens: int = 65_536
    #: about how many tokens one range of doc_id holds
    range_tokens: int = 8_000_000


def code_lengths(counts: np.ndarray, longest: int) -> np.ndarray:
    """Optimal code lengths <= ``longest`` by package-merge; 0 for ids that never occur."""
    ids = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    if len(ids) == 0:
        return out
    if len(ids) == 1:
        out[ids] = 1
        return out
    if len(ids) > 1 << longest:
        raise ValueError(f"{len(ids)} ids need codes longer than {longest} bits")
    ids = ids[np.argsort(counts[ids], kind="stable")]
    leaves = counts[ids].astype(np.int64)
    rows, is_leaf = leaves, [np.ones(len(leaves), bool)]
    for _ in range(longest - 1):
        packages = rows[: len(rows) // 2 * 2].reshape(-1, 2).sum(axis=1)
        rows = np.concatenate([leaves, packages])
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        is_leaf.append(order < len(leaves))
    lengths = np.zeros(len(ids), dtype=np.uint8)
    take = 2 * len(ids) - 2
    for flags in reversed(is_leaf):
        n = int(flags[:take].sum())
        lengths[:n] += 1
        take = 2 * (take - n)
    out[ids] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id), each one more than the last, lengthened by zeros."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    ids = np.flatnonzero(lengths)
    ids = ids[np.lexsort((ids, lengths[ids]))]
    widest = int(lengths.max(initial=0))
    spans = np.uint64(1) << (widest - lengths[ids]).astype(np.uint64)
    begins = np.concatenate([[0], np.cumsum(spans)[:-1]]).astype(np.uint64) if len(ids) else spans
    codes[ids] = begins >> (widest - lengths[ids]).astype(np.uint64)
    return codes


def encode_ids(ids: np.ndarray, bounds: np.ndarray, lengths: np.ndarray, codes: np.ndarray, stride: int) -> tuple[bytes, np.ndarray, list[np.ndarray]]:
    """Coded bytes of all documents, the byte each begins at, and each one's checkpoints (bits from its beginning)."""
    width = lengths[ids].astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(width)])
    bits = upto[bounds[1:]] - upto[bounds[:-1]]
    begin = np.concatenate([[0], np.cumsum((bits + 7) // 8)])
    at = upto[:-1] - np.repeat(upto[bounds[:-1]] - 8 * begin[:-1], np.diff(bounds))
    words = np.zeros(int(begin[-1]) // 8 + 2, dtype=np.uint64)
    if len(ids):
        word, inside = at >> 6, at & 63
        code = codes[ids] << (64 - width).astype(np.uint64)
        new = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[new]] = np.bitwise_or.reduceat(code >> inside.astype(np.uint64), new)
        over = np.flatnonzero(inside + width > 64)
        words[word[over] + 1] |= code[over] << (64 - inside[over]).astype(np.uint64)
    marks = [upto[a:b:stride] - upto[a] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return words.astype(">u8").tobytes()[: int(begin[-1])], begin, marks


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every value of the next ``widest`` bits: the id and the code length."""
    widest = int(lengths.max(initial=1))
    ids = np.flatnonzero(lengths)
    ids = ids[np.lexsort((ids, lengths[ids]))]
    spans = 1 << (widest - lengths[ids]).astype(np.int64)
    symbol, width = np.zeros(1 << widest, np.uint32), np.ones(1 << widest, np.int64)
    symbol[: spans.sum()] = np.repeat(ids, spans)
    width[: spans.sum()] = np.repeat(lengths[ids], spans)
    return symbol, width, widest


def decode_ids(payload: bytes, n_tokens: np.ndarray, checkpoints: np.ndarray, table: tuple[np.ndarray, np.ndarray, int], stride: int) -> np.ndarray:
    """Ids of all documents of a payload, every checkpoint's run of tokens decoded at the same time."""
    symbol, width, widest = table
    raw = np.frombuffer(payload + b"\0" * 8, dtype=np.uint8).astype(np.uint32)
    ahead = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    runs = -(-n_tokens // stride)
    ends = np.cumsum(n_tokens)
    nth = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    begin = np.repeat(ends - n_tokens, runs) + nth * stride
    count = np.minimum(stride, np.repeat(ends, runs) - begin)
    order = np.argsort(-count, kind="stable")
    at, begin, count = checkpoints[order].copy(), begin[order], count[order]
    out = np.empty(int(n_tokens.sum()), dtype="<u4")
    live = len(count)
    for step in range(int(count.max(initial=0))):
        live = int(np.searchsorted(-count[:live], -step, side="left"))
        place = at[:live]
        window = (ahead[place >> 3] >> (32 - widest - (place & 7)).astype(np.uint32)) & np.uint32((1 << widest) - 1)
        out[begin[:live] + step] = symbol[window]
        place += width[window]
    return out


def tokenized(docs: DataFrame, config: FileConfig) -> DataFrame:
    """doc_id, the ids of its whole text, as little-endian integers of 2 or 4 bytes (``wide``), and their checksum."""
    path, end = config.tokenizer or tokens.default_tokenizer(), config.end_id

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path).encode
        for batch in batches:
            texts = batch.column("text")
            for a, b in tokens.text_groups(texts):
                ids = encode(texts.slice(a, b - a), end)
                wide = [bool(x.max() > 65_535) for x in ids]
                data = [x.tobytes() if w else x.astype("<u2").tobytes() for x, w in zip(ids, wide, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(wide), pa.array([zlib.crc32(x) for x in data], pa.int64()), pa.array(data, pa.binary())], names=["doc_id", "wide", "mark", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, wide boolean, mark long, ids binary")


def _id_slices(batch: pa.RecordBatch, most: int = 1_000_000) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The ids of runs of rows with about ``most`` bytes together, and the row each run begins at."""
    ids, wide = batch.column("ids"), batch.column("wide")
    for a, b in tokens.text_groups(ids, most):
        yield a, [np.frombuffer(x, dtype="<u4" if w else "<u2") for x, w in zip(ids.slice(a, b - a).to_pylist(), wide.slice(a, b - a).to_pylist(), strict=True)]


def id_counts(ids: DataFrame) -> np.ndarray:
    """How often each id occurs; the result has as many entries as the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for _, parts in _id_slices(batch):
                found = np.bincount(np.concatenate(parts))
                if len(found) > len(total):
                    total = np.pad(total, (0, len(found) - len(total)))
                total[: len(found)] += found
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["id", "n"])

    rows = ids.select("wide", "ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 0, dtype=np.int64)
    out[rows["id"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy()
    return out


def write_token_files(docs: DataFrame, path: str, config: FileConfig = FileConfig()) -> None:
    """Writes the coded ids of all documents below ``path``, in ascending doc_id order.

    The ids are dealt to ranges of doc_id (and, for rows of one id, of their checksum), as many as their
    number asks for; each range is coded once, after it is sorted, straight into blocks.
    """
    spark = docs.sparkSession
    ids = materialize(tokenized(docs, config), "ids")
    counts = id_counts(ids)
    lengths = code_lengths(counts, config.longest)
    spark.createDataFrame([(lengths.tolist(), config.stride)], "lengths array<int>, stride int").coalesce(1).write.parquet(f"{path}/codes")
    book = spark.sparkContext.broadcast(lengths)
    stride, most = config.stride, config.block_tokens
    order = [F.col("doc_id").asc_nulls_first(), F.col("mark")]
    ranges = max(shuffle_partitions(spark), int(counts.sum()) // config.range_tokens + 1)
    ordered = ids.repartitionByRange(ranges, *order).sortWithinPartitions(*order, "ids")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, first = TaskContext.get().partitionId(), 0, 0
        lengths = book.value
        codes = canonical_codes(lengths)
        names: list[pa.Array] = []
        parts: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            sizes = np.array([len(x) for x in parts])
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            data, begin, marks = encode_ids(np.concatenate(parts).astype(np.int64), bounds, lengths, codes, stride)
            checkpoints = np.concatenate([m + 8 * at for m, at in zip(marks, begin, strict=False)])
            docs = pa.concat_arrays(names)
            rows = [[part], [number], [first], None, [sizes], [checkpoints], [data]]
            types = [pa.int32(), pa.int32(), pa.int64(), None, pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()]
            arrays = [pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs) if t is None else pa.array(r, t) for r, t in zip(rows, types, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=["part", "block", "first", "doc_ids", "n_tokens", "checkpoints", "payload"])

        for batch in batches:
            for at, some in _id_slices(batch):
                since = 0
                for i, x in enumerate(some):
                    parts.append(x)
                    held += len(x)
                    if held >= most:
                        names.append(batch.column("doc_id").slice(at + since, i + 1 - since))
                        yield close()
                        number, first, since = number + 1, first + held, i + 1
                        names, parts, held = [], [], 0
                if since < len(some):
                    names.append(batch.column("doc_id").slice(at + since, len(some) - since))
        if parts:
            yield close()

    ordered.select("doc_id", "wide", "ids").mapInArrow(block, BLOCK.format(id=kind)).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens, the checksum of the decoded ids and, if wanted, these (little-endian, 4 bytes each)."""
    blocks = spark.read.parquet(f"{path}/blocks")
    book = spark.read.parquet(f"{path}/codes").first()
    shared = spark.sparkContext.broadcast((np.array(book["lengths"], dtype=np.uint8), book["stride"]))
    totals = blocks.select("part", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda s, x: s + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    before = totals.select("part", F.coalesce(F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, stride = shared.value
        table = decode_table(lengths)
        for whole in batches:
            for at in range(0, whole.num_rows, 16):
                rows = whole.slice(at, 16).to_pylist()
                sizes = np.concatenate([np.array(r["n_tokens"], dtype=np.int64) for r in rows])
                starts = np.concatenate([r["before"] + r["first"] + np.cumsum([0, *r["n_tokens"][:-1]]) for r in rows])
                offsets = np.cumsum([0, *(len(r["payload"]) for r in rows)])
                marks = np.concatenate([np.array(r["checkpoints"], dtype=np.int64) + 8 * o for r, o in zip(rows, offsets[:-1], strict=True)])
                ids = decode_ids(b"".join(r["payload"] for r in rows), sizes, marks, table, stride)
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                data = [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                names = whole.slice(at, 16).column("doc_ids").flatten()
                columns = [names, pa.array(starts.astype(np.int64)), pa.array(sizes), pa.array([zlib.crc32(x) for x in data], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(data, pa.binary())] * with_ids, names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    return blocks.join(F.broadcast(before), "part").mapInArrow(decode, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def token_file_round_trip(docs: DataFrame, config: FileConfig = FileConfig(), with_ids: bool = True) -> DataFrame:
    """Writes the documents' token files to the shared folder and reads them back."""
    path = fresh_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, config)
    return read_token_files(docs.sparkSession, path, with_ids)
