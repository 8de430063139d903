"""Blocks of documents and exchanges of packed arrays between blocks and buckets.

Operators that look something up for every token or byte of a corpus would shuffle billions of
small rows. Instead documents are gathered into blocks (a stored table, one row a block); a block
folds what it asks, sends each bucket one packed array, and gets one packed answer in the same
order. Equal questions of a block are one, so that a hot key is at most one entry from each block.

Blocks grow with the input, up to MOST_BLOCK bytes, so that FEW of them do while they can. Were each
block to send each bucket a row of its own, rows would grow as the square of the input: beyond WIDE
blocks, messages go in two hops. A block sends one row to each range of buckets; the rows of a group
of blocks to a range are turned into one row for each bucket, and replies go back the same way. With
as many groups and ranges as the root of the blocks, each row is about as large as a block over that
root, and a task of a hop holds about one block. A bucket holds the questions of about one block.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.core import dropped, slices, stored

#: Bytes of text in a block, at least and at most, and the blocks wanted.
LEAST_BLOCK, MOST_BLOCK = 500_000, 4_000_000
FEW = 128
#: Blocks (or the root of blocks times buckets) beyond which messages go in two hops. Up to it a message of an
#: exchange has about a kilobyte, and what two hops would shuffle and write twice is spared.
WIDE = 4_096


def join_parts(parts: list[bytes]) -> bytes:
    return np.array([len(parts), *map(len, parts)], "<u4").tobytes() + b"".join(parts)


def split_parts(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    size = np.frombuffer(data, "<u4", n, 4).astype(np.int64)
    at = 4 * (n + 1) + np.concatenate([[0], np.cumsum(size)])
    return [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def squeezed(data: bytes) -> bytes:
    """data compressed, after its length."""
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unsqueezed(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def planes(a: np.ndarray) -> bytes:
    """64-bit values with equal bytes side by side, which compress better so."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def planes4(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes4(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    return planes(np.diff(a.astype(np.uint64), prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data), dtype=np.uint64)


def bucket_of(key: np.ndarray, n: int) -> np.ndarray:
    """Even ranges of 64-bit hashes, so that sorted keys have sorted buckets."""
    return ((key >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def bounds(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, from, to) of each run of a sorted array."""
    if len(bucket):
        cut = np.flatnonzero(np.diff(bucket)) + 1
        for a, b in zip([0, *cut], [*cut, len(bucket)], strict=True):
            yield int(bucket[a]), int(a), int(b)


def make_blocks(docs: DataFrame, encode: Callable[[np.ndarray, np.ndarray, np.ndarray], bytes], tag: str) -> DataFrame:
    """docs (id long, text) -> stored (block, data): encode(ids, bytes, offsets) of the documents of each block."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    most = min(MOST_BLOCK, max(LEAST_BLOCK, total // FEW))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[np.ndarray] = []
        data: list[np.ndarray] = []
        lens: list[np.ndarray] = []

        def full() -> pa.RecordBatch:
            off = np.concatenate([[0], np.cumsum(np.concatenate(lens))])
            out = squeezed(encode(np.concatenate(ids), np.concatenate(data), off))
            ids.clear(), data.clear(), lens.clear()
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([out], pa.binary())], names=["block", "data"])

        for rows, d, off in slices(batches, "text", LEAST_BLOCK):
            ids.append(rows.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            data.append(d)
            lens.append(np.diff(off))
            if sum(map(len, data)) >= most:
                yield full()
                number += 1
        if ids:
            yield full()

    return stored(docs.select("id", "text").mapInArrow(work, "block long, data binary"), tag)


def text_block(ids: np.ndarray, data: np.ndarray, off: np.ndarray) -> bytes:
    return join_parts([ids.astype("<i8").tobytes(), off.astype("<i8").tobytes(), data.tobytes()])


def from_text_block(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, off, data = split_parts(block)
    return np.frombuffer(ids, "<i8"), np.frombuffer(data, np.uint8), np.frombuffer(off, "<i8")


Send = Callable[[bytes, dict[int, bytes]], list[tuple[int, bytes]]]
Answer = Callable[[list[bytes]], list[bytes]]  # one reply more than messages: the bucket's own figures
Packed = list[tuple[int, bytes]]


def packed(parts: Packed) -> bytes:
    return squeezed(join_parts([np.array([n for n, _ in parts], "<i8").tobytes(), *(m for _, m in parts)]))


def unpacked(data: bytes) -> Packed:
    names, *parts = split_parts(unsqueezed(data))
    return list(zip(np.frombuffer(names, "<i8").tolist(), parts, strict=True))


class Answers(NamedTuple):
    replies: DataFrame  # (to = block, sender, data = packed (bucket, reply))
    figures: DataFrame  # (data = packed (bucket, figures))

    def each_figures(self) -> Iterator[bytes]:
        """Every bucket's own figures, one after the other."""
        for r in self.figures.select("data").toLocalIterator():
            yield unpacked(r["data"])[0][1]


_ROW = "to long, sender long, data binary"


def _rows(by: dict[int, Packed], sender: int) -> pd.DataFrame:
    return pd.DataFrame({"to": np.array(list(by), np.int64), "sender": np.full(len(by), sender, np.int64), "data": [packed(v) for v in by.values()]})


def turned(rows: DataFrame) -> DataFrame:
    """Rows (to, sender, packed (target, message)) -> (target, to, packed (sender, message)), one for each target of a `to`."""

    def work(f: pd.DataFrame) -> pd.DataFrame:
        by: dict[int, Packed] = {}
        for sender, data in zip(f["sender"], f["data"], strict=True):
            for target, m in unpacked(data):
                by.setdefault(target, []).append((int(sender), m))
        return _rows(by, int(f["to"].iloc[0]))

    return rows.groupBy("to").applyInPandas(work, _ROW)


def answered(blocks: DataFrame, replies: DataFrame | None, send: Send, answer: Answer, tag: str, n_buckets: int) -> Answers:
    """send(block, its earlier replies by bucket) gives messages to buckets, answer(messages of a bucket) one reply
    to each, and perhaps the bucket's own figures."""
    n_blocks = blocks.count()
    two_hops = n_blocks * n_buckets > WIDE * WIDE
    groups, ranges = (math.isqrt(n_blocks) + 1, math.isqrt(n_buckets) + 1) if two_hops else (1, n_buckets)

    def out(block: int, data: bytes, got: list[dict[int, bytes]]) -> pd.DataFrame:
        by: dict[int, Packed] = {}
        group = zlib.crc32(str(block).encode()) % groups
        for bucket, m in send(data, got[0] if got else {}):
            to = group * ranges + bucket * ranges // n_buckets if two_hops else bucket
            by.setdefault(to, []).append((bucket if two_hops else block, m))
        return _rows(by, block)

    if replies is None:

        def plain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for block, data in zip(f["block"], f["data"], strict=True):
                    yield out(block, unsqueezed(data), [])

        sent = blocks.mapInPandas(plain, _ROW)
    else:
        sent = with_replies(blocks, [replies], out, _ROW)
    if two_hops:
        sent = turned(sent)

    def work(f: pd.DataFrame) -> pd.DataFrame:
        bucket = int(f["to"].iloc[0])
        got = [(int(sender), block, m) for sender, data in zip(f["sender"], f["data"], strict=True) for block, m in unpacked(data)]
        made = answer([m for _, _, m in got])
        by: dict[int, Packed] = {FIGURES: [(bucket, x) for x in made[len(got) :]]} if len(made) > len(got) else {}
        for (sender, block, _), reply in zip(got, made, strict=False):
            by.setdefault(sender if two_hops else block, []).append((block if two_hops else bucket, reply))
        return _rows(by, bucket)

    made = stored(sent.groupBy("to").applyInPandas(work, _ROW), tag)
    back, figures = made.where(F.col("to") != FIGURES), made.where(F.col("to") == FIGURES)
    if two_hops:
        back, figures = stored(turned(back), f"{tag}-back"), stored(figures, f"{tag}-figures")
        dropped(made)
    return Answers(back, figures)


def with_replies(blocks: DataFrame, replies: list[DataFrame], work: Callable[[int, bytes, list[dict[int, bytes]]], pd.DataFrame], shape: str) -> DataFrame:
    """work(block number, block, its replies by bucket from each of the tables) of every block."""
    every = reduce(DataFrame.unionByName, [r.select("to", F.lit(i).alias("part"), "data") for i, r in enumerate(replies)])
    n = len(replies)

    def both(key: tuple, b: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        got: list[dict[int, bytes]] = [{} for _ in range(n)]
        for part, data in zip(r["part"], r["data"], strict=True):
            got[part].update(unpacked(data))
        return work(int(key[0]), unsqueezed(b["data"].iloc[0]), got)

    return blocks.groupBy("block").cogroup(every.groupBy("to")).applyInPandas(both, shape)


def ids_and_text(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


#: What is sent to this block is a bucket's own figures.
FIGURES = -1
