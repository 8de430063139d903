"""Alignment of two tokenizers' tokens over the same bytes.

A blank and the text are cut by a byte-level BPE file (A) and by a sentence-piece model (B, which adds the
blank itself). Both give every byte an owner: the token that covers it, by repeating each token's number
over its bytes. Where the pair of owners changes, a new overlap of an A and a B token begins; where both
change at once, a group of tokens ends. This is one pass over the bytes of many texts.

Corpus figures: in how many documents an A id and a B id overlap, and the most of these for each A id.
Documents become blocks of their distinct pairs; pairs go to buckets by hash, which add up the documents
of all blocks and answer each block what it asked (see blocks.py), so that a pair of a third of all tokens
is one entry from each block. The maxima are one number for each A id, as many as the file has.

What the libraries do is done once where it can be: A's file is a list of merges whose ids ascend, so that
its pieces are ranks; B's model has no piece with a blank after another character, so that runs of
blanks and what follows up to the next are cut on their own, and a worker keeps KNOWN of them.

Defined results: a text that is null or empty, or whose tokens' bytes are not those of blank and text (it
holds U+2581, say), has no tokens, zeros, and the empty text for groups; special tokens in a text are plain
text; rows that share a doc_id, or have none, are documents of their own; no rows give no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.blocks import answered, bounds, bucket_of, from_planes, from_planes4, join_parts, make_blocks, pack_sorted, planes, planes4, split_parts, unpack_sorted, unpacked, with_replies
from millrace.llm.bpe import spelling
from millrace.llm.core import mix, slices

#: Pieces whose ids a worker keeps.
KNOWN = 400_000
NO_ID = -(1 << 63)
#: Fixed values of the file formats: what a piece of A is, B's blank, and a piece of B that is one byte.
PIECE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLANK = "▁"
BYTE = re.compile("<0x([0-9A-F]{2})>")
_CHUNK = re.compile(" +[^ ]*")


class Table:
    """The bytes of each token of a vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.said = [str(i) for i in range(len(tokens))]

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        return self.data[np.repeat(self.at[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())]


class ByteLevel:
    """The A side: a byte-level BPE file whose merges make ascending ids."""

    def __init__(self, spec: str):
        import tiktoken

        said = json.loads(spec)
        vocab: dict[str, int] = said["model"]["vocab"]
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in said["model"]["merges"]]
        if made != sorted(made):
            raise ValueError("the merges of the file do not make ascending ids")
        byte = {c: b for b, c in enumerate(spelling())}
        special = {t["content"] for t in said["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in special}
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            tokens[i] = token
        self.table = Table(tokens)
        self._cut = tiktoken.Encoding("a", pat_str=PIECE, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._cut(" " + t) for t in texts]


class Pieces:
    """The B side: a sentence-piece model with byte pieces."""

    def __init__(self, model: bytes):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        self.table = Table([bytes([int(m[1], 16)]) if (m := BYTE.fullmatch(n)) else n.replace(BLANK, " ").encode() for n in names])
        self.by_chunk = BLANK in names and not any(re.search(f"[^{BLANK}]{BLANK}", n) for n in names)
        self.blank = [names.index(BLANK)] if self.by_chunk else []
        self.known: dict[str, list[int]] = {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        if not self.by_chunk:
            return self._model.encode(texts, num_threads=1)
        out = []
        for text in texts:
            chunks = _CHUNK.findall(" " + text)
            new = list({c for c in chunks if c not in self.known})
            if len(self.known) + len(new) > KNOWN:
                self.known.clear()
                new = list(set(chunks))
            # the model adds the first blank, but to nothing
            self.known.update(zip(new, self._model.encode([c[1:] for c in new], num_threads=1), strict=True))
            self.known[" "] = self.blank
            ids: list[int] = []
            for c in chunks:
                ids += self.known[c]
            out.append(ids)
        return out


class Aligned(NamedTuple):
    """Tokens of n texts and how they meet. Places of texts are n + 1 offsets."""

    a: np.ndarray  # ids
    b: np.ndarray
    a_at: np.ndarray  # of texts in a
    b_at: np.ndarray
    a_group: np.ndarray  # the group of each token, counted over all texts
    b_group: np.ndarray
    group_at: np.ndarray  # of texts in groups
    ends: np.ndarray  # byte at which each group ends in its text with the blank before it
    link_a: np.ndarray  # the token of each overlap
    link_b: np.ndarray
    link_at: np.ndarray  # of texts in links


class Aligner:
    def __init__(self, a: str, b: bytes):
        self.a, self.b = ByteLevel(a), Pieces(b)

    def align(self, data: np.ndarray, off: np.ndarray) -> Aligned:
        n = len(off) - 1
        raw = data.tobytes()
        texts = [raw[x:y].decode() for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        some = [i for i, t in enumerate(texts) if t]
        got = [side.encode([texts[i] for i in some]) for side in (self.a, self.b)]
        tokens, many = [], []
        for side, ids in zip((self.a, self.b), got, strict=True):
            count = np.zeros(n, np.int64)
            count[some] = [len(x) for x in ids]
            tokens.append(np.fromiter((i for x in ids for i in x), np.int64, int(count.sum())))
            many.append(count)
        size = np.diff(off)
        good = size > 0
        # blank and text, as bytes
        whole = np.where(good, size + 1, 0)
        at = np.cumsum(whole) - whole
        spaced = np.empty(whole.sum(), np.uint8)
        spaced[at[good]] = 0x20
        inside = np.ones(len(spaced), bool)
        inside[at[good]] = False
        spaced[inside] = data
        for side, ids, count in zip((self.a, self.b), tokens, many, strict=True):
            length = side.table.size[ids]
            of = np.repeat(np.arange(n), count)
            fits = np.bincount(of, length, minlength=n).astype(np.int64) == whole
            good &= fits
            same = side.table.bytes_of(ids[fits[of]]) == spaced[np.repeat(fits, whole)]
            wrong = np.repeat(np.flatnonzero(fits), whole[fits])[~same]
            good[wrong] = False
        for k in range(2):
            tokens[k] = tokens[k][np.repeat(good, many[k])]
            many[k] = np.where(good, many[k], 0)
        return self._met(*tokens, *many, np.where(good, whole, 0))

    def _met(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, size: np.ndarray) -> Aligned:
        offsets = lambda x: np.concatenate([[0], np.cumsum(x)]).astype(np.int64)
        owner_a = np.repeat(np.arange(len(a), dtype=np.int32), self.a.table.size[a])
        owner_b = np.repeat(np.arange(len(b), dtype=np.int32), self.b.table.size[b])
        new_a, new_b = (np.concatenate([[True], o[1:] != o[:-1]])[: len(o)] for o in (owner_a, owner_b))
        links, cuts = np.flatnonzero(new_a | new_b), np.flatnonzero(new_a & new_b)  # where they begin
        text_at = offsets(size)
        group_at = np.searchsorted(cuts, text_at)
        end = np.append(cuts[1:], len(owner_a))[: len(cuts)]
        number = np.cumsum(new_a & new_b) - 1
        start = np.repeat(text_at[:-1], np.diff(group_at))
        first_a, first_b = np.flatnonzero(new_a), np.flatnonzero(new_b)
        return Aligned(a, b, offsets(n_a), offsets(n_b), number[first_a], number[first_b], group_at, end - start, owner_a[links], owner_b[links], np.searchsorted(links, text_at))

    def groups(self, m: Aligned) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of each text: ids of A and B, group by group."""
        total = int(m.group_at[-1])
        in_a, in_b = np.bincount(m.a_group, minlength=total), np.bincount(m.b_group, minlength=total)
        a_before, b_before = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        place_a = np.arange(len(m.a)) + b_before[m.a_group]
        place_b = np.arange(len(m.b)) + (a_before + in_a)[m.b_group]
        last_a = np.append(m.a_group[1:] != m.a_group[:-1], True)[: len(m.a)]
        last_b = np.append(m.b_group[1:] != m.b_group[:-1], True)[: len(m.b)]
        # every id with what follows it: a comma, the end of a side, and a comma, the end of a group
        said = [f"{s}{mark}" for side, marks in ((self.a, ",|"), (self.b, ",;")) for mark in marks for s in side.table.said]
        n_a, n_b = len(self.a.table.said), len(self.b.table.said)
        code = np.empty(len(m.a) + len(m.b), np.int64)
        code[place_a] = m.a + n_a * last_a
        code[place_b] = 2 * n_a + m.b + n_b * last_b
        at = (m.a_at + m.b_at).tolist()
        codes = code.tolist()
        return ["".join([said[c] for c in codes[x:y]])[:-1] for x, y in zip(at[:-1], at[1:], strict=True)]


class Files(NamedTuple):
    a: str
    b: str


def files() -> Files:
    import public_tokenizers

    return Files(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


_aligner: dict[str, Aligner] = {}


def _shared(spark: SparkSession, which: Files):
    """A function that gives a worker its aligner, made once."""
    with open(which.a, encoding="utf-8") as f, open(which.b, "rb") as g:
        both = f.read(), g.read()
    name = sha256(both[0].encode() + both[1]).hexdigest()
    sent = spark.sparkContext.broadcast(both)  # two vocabulary files

    def mine() -> Aligner:
        if name not in _aligner:
            _aligner.clear()
            _aligner[name] = Aligner(*sent.value)
        return _aligner[name]

    return mine


def alignments(docs: DataFrame, which: Files, text: str = "text") -> DataFrame:
    """docs with a, b (token ids) and groups: for each, how many tokens of a and b it takes and the byte at which
    it ends in blank and text. Columns of these names are replaced, others pass through."""
    mine = _shared(docs.sparkSession, which)
    rest = [c for c in docs.columns if c not in ("a", "b", "groups")]
    group = "array<struct<n_a: int, n_b: int, ends: long>>"
    lists = lambda at, values: pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in slices(batches, text):
            m = mine().align(data, off)
            n = int(m.group_at[-1])
            many = [pa.array(np.bincount(g, minlength=n), pa.int32()) for g in (m.a_group, m.b_group)]
            groups = pa.StructArray.from_arrays([*many, pa.array(m.ends, pa.int64())], names=["n_a", "n_b", "ends"])
            yield pa.RecordBatch.from_arrays([*rows.columns, lists(m.a_at, pa.array(m.a, pa.int32())), lists(m.b_at, pa.array(m.b, pa.int32())), lists(m.group_at, groups)], names=[*rest, "a", "b", "groups"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(rest).schema)
    return docs.select(rest).mapInArrow(work, f"{shape}, a array<int>, b array<int>, groups {group}")


# ---------------------------------------------------------------- corpus figures

#: A pair is its A id above so many bits and its B id below.
_LOW = np.uint64(32)


def coded_block(mine):
    """ids, n_a, n_b, n_groups, digests, distinct pairs, and of each document its pairs and how often it has them."""

    def encode(ids: np.ndarray, data: np.ndarray, off: np.ndarray) -> bytes:
        m = mine().align(data, off)
        digests = b"".join(sha256(g.encode()).digest() for g in mine().groups(m))
        pair = (m.a[m.link_a].astype(np.uint64) << _LOW) | m.b[m.link_b].astype(np.uint64)
        u, of = np.unique(pair, return_inverse=True)
        text = np.repeat(np.arange(len(ids)), np.diff(m.link_at))
        held, often = np.unique(text * max(len(u), 1) + of, return_counts=True)
        in_text = np.bincount(held // max(len(u), 1), minlength=len(ids))
        counts = [np.diff(x).astype("<i8").tobytes() for x in (m.a_at, m.b_at, m.group_at)]
        return join_parts([ids.astype("<i8").tobytes(), *counts, digests, pack_sorted(u), in_text.astype("<i8").tobytes(), planes4(held % max(len(u), 1)), planes(often.astype(np.uint64))])

    return encode


class Coded:
    def __init__(self, block: bytes):
        ids, n_a, n_b, n_groups, digests, pairs, in_text, held, often = split_parts(block)
        self.ids, self.n_a, self.n_b, self.n_groups = (np.frombuffer(x, "<i8") for x in (ids, n_a, n_b, n_groups))
        self.digests = digests
        self.pair = unpack_sorted(pairs)
        self.text = np.repeat(np.arange(len(self.ids)), np.frombuffer(in_text, "<i8"))
        self.held, self.often = from_planes4(held).astype(np.int64), from_planes(often).astype(np.int64)

    def dealt(self, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The order in which pairs are asked for, and their buckets in that order."""
        bucket = bucket_of(mix(self.pair), n_buckets)
        order = np.argsort(bucket, kind="stable")
        return order, bucket[order]


def ask_pairs(n_buckets: int):
    def send(block: bytes, _: dict[int, bytes]) -> list[tuple[int, bytes]]:
        b = Coded(block)
        order, bucket = b.dealt(n_buckets)
        documents = np.bincount(b.held, minlength=len(b.pair))
        return [(k, join_parts([pack_sorted(b.pair[order[i:j]]), planes4(documents[order[i:j]])])) for k, i, j in bounds(bucket)]

    return send


def count_pairs(messages: list[bytes]) -> list[bytes]:
    """Replies: the documents of each pair. A bucket's own figures: A ids, and the most documents of a pair of each."""
    parts = [split_parts(m) for m in messages]
    pairs = [unpack_sorted(p[0]) for p in parts]
    u, of = np.unique(np.concatenate(pairs), return_inverse=True)
    total = np.zeros(len(u), np.int64)
    np.add.at(total, of, np.concatenate([from_planes4(p[1]) for p in parts]).astype(np.int64))
    a = (u >> _LOW).astype(np.int64)
    first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    cut = np.cumsum([len(p) for p in pairs])[:-1]
    figures = join_parts([a[first].astype("<i8").tobytes(), np.maximum.reduceat(total, first).astype("<i8").tobytes()])
    return [*(planes(x.astype(np.uint64)) for x in np.split(total[of], cut)), figures]


def most_documents(figures: DataFrame, n_a: int) -> np.ndarray:
    """The most documents of a pair of each A id."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for data in f["data"]:
                for _, x in unpacked(data):
                    a, most = (np.frombuffer(y, "<i8") for y in split_parts(x))
                    yield pd.DataFrame({"a": a, "most": most})

    out = np.zeros(n_a, np.int64)
    for a, most in figures.select("data").mapInPandas(work, "a long, most long").groupBy("a").agg(F.max("most")).collect():  # one row for each token of A's file
        out[a] = most
    return out


SHAPE = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def statistics(docs: DataFrame, which: Files, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row of docs: sizes of its alignment, how its links fare in all documents, digest of its groups."""
    spark = docs.sparkSession
    mine = _shared(spark, which)
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    blocks = make_blocks(rows, coded_block(mine), "alignments")
    n = max(1, blocks.count())
    pairs = answered(blocks, None, ask_pairs(n), count_pairs, "pairs", n)
    with open(which.a, encoding="utf-8") as f:
        size = max(json.load(f)["model"]["vocab"].values()) + 1
    sent = spark.sparkContext.broadcast(most_documents(pairs.figures, size))  # one number for each token of A's file

    def work(_: int, block: bytes, got: list[dict[int, bytes]]) -> pd.DataFrame:
        b = Coded(block)
        order, _ = b.dealt(n)
        count = np.zeros(len(b.pair), np.int64)
        if len(order):
            count[order] = np.concatenate([from_planes(got[0][k]) for k in sorted(got[0])]).astype(np.int64)
        best = count == sent.value[(b.pair >> _LOW).astype(np.int64)]
        at = np.searchsorted(b.text, np.arange(len(b.ids) + 1))
        add = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[at])
        hexed = b.digests.hex()
        digest = ["" if not many else hexed[64 * i : 64 * i + 64] for i, many in enumerate(b.n_a.tolist())]
        return pd.DataFrame({"doc_id": pd.array(np.where(b.ids == NO_ID, None, b.ids), "Int64"), "n_a": b.n_a, "n_b": b.n_b, "n_groups": b.n_groups, "n_links": add(b.often), "n_best": add(b.often * best[b.held]), "count_sum": add(b.often * count[b.held]), "groups_sha256": digest})

    return with_replies(blocks, [pairs.replies], work, SHAPE)


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics(spark.read.parquet(f"{sf_dir}/documents.parquet"), files())
