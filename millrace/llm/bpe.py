"""BPE encoding and decoding with a pair occurrence index.

A partition's texts are cut into pieces; every piece not yet known is laid into one linked list of
symbols, an index maps each mergeable pair to all its positions there, and active ranks are applied
in ascending order, each to all its positions at once, left to right, updating the lists of the
pairs that go and come. Pieces never touch each other, so that the order within each piece is the
order of plain BPE.

Scale: one map over the documents without a shuffle; a worker's memory is bounded by the Arrow
batch, the ids of the KNOWN most recently indexed pieces, and the vocabulary, whose size the file fixes.

Defined results: null and empty texts have no ids and decode to the empty text; other columns pass
through; special tokens in a text become their ids, as the file says.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.core import given_back

#: Pieces whose ids a worker keeps.
KNOWN = 400_000
#: Texts that are cut into pieces at once.
AT_ONCE = 100
#: Fixed values of the file format: how white space is folded, what a piece is, how bytes are spelt.
WHITE = r"\p{White_Space}"
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"


def spelling() -> list[str]:
    """The character that stands for each byte: itself where it is printable, else one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Codec:
    """Encoder and decoder of one tokenizer file: lower-cased pieces, byte spelling, word-end suffix."""

    def __init__(self, spec: str):
        import regex

        said = json.loads(spec)
        model = said["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in said["added_tokens"]}
        self.text_of = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[self.vocab[a], self.vocab[b]] = (r, self.vocab[a + b])
        self.byte = spelling()
        self.pieces = regex.compile(PIECE).findall
        self.white = regex.compile(WHITE + "+").sub
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str | int, bytes] = {i: np.array([i], "<u4").tobytes() for i in self.special.values()}

    def fold(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def cut(self, text: str) -> list[str | int]:
        """Pieces, and the ids of special tokens between them."""
        if self.specials is None or "<|" not in text:
            return self.pieces(self.fold(text))
        out: list[str | int] = []
        for k, part in enumerate(self.specials.split(text)):
            out += [self.special[part]] if k % 2 else self.pieces(self.fold(part))
        return out

    def index(self, pieces: Iterable[str]) -> None:
        """Encodes these pieces together."""
        symbol: list[int] = []
        ahead: list[int] = []
        behind: list[int] = []
        starts: list[tuple[str, int]] = []
        for piece in pieces:
            spelt = [self.byte[b] for b in piece.encode("utf-8", "surrogatepass")]
            spelt[-1] += self.suffix
            at, n = len(symbol), len(spelt)
            starts.append((piece, at))
            symbol += [self.vocab[c] for c in spelt]
            ahead += [*range(at + 1, at + n), -1]
            behind += [-1, *range(at, at + n - 1)]
        rank, where, active = self.rank, {}, []
        for i, j in enumerate(ahead):
            if j >= 0 and (pair := (symbol[i], symbol[j])) in rank:
                if pair in where:
                    where[pair].append(i)
                else:
                    where[pair] = [i]
                    active.append((rank[pair][0], pair))
        heapq.heapify(active)
        while active:
            _, pair = heapq.heappop(active)
            a, b = pair
            merged = rank[pair][1]
            positions = where.pop(pair)
            positions.sort()
            for i in positions:
                j = ahead[i]
                if symbol[i] != a or j < 0 or symbol[j] != b:
                    continue  # an earlier merge took one of the two
                symbol[i], symbol[j] = merged, -1
                k = ahead[i] = ahead[j]
                if k >= 0:
                    behind[k] = i
                h = behind[i]
                for left, right in ((h, i), (i, k)):
                    if left >= 0 <= right and (new := (symbol[left], symbol[right])) in rank:
                        if new in where:
                            where[new].append(left)
                        else:
                            where[new] = [left]
                            heapq.heappush(active, (rank[new][0], new))
        for piece, i in starts:
            ids = []
            while i >= 0:
                ids.append(symbol[i])
                i = ahead[i]
            self.known[piece] = np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, the decoded text) of each text."""
        cut = [self.cut(t) if t else [] for t in texts]
        fresh = {p for pieces in cut for p in pieces if p not in self.known}
        fresh = {p for p in fresh if isinstance(p, str)}
        if len(self.known) + len(fresh) > KNOWN:
            self.known = {i: self.known[i] for i in self.special.values()}
            fresh = {p for pieces in cut for p in pieces if isinstance(p, str)}
        self.index(fresh)
        ids = [b"".join([self.known[p] for p in pieces]) for pieces in cut]
        return [(x, self.decode(x)) for x in ids]

    def decode(self, ids: bytes | None) -> str | None:
        """The texts of the tokens, with a blank between them: what a file without a decoder says."""
        return None if ids is None else " ".join([self.text_of[x] for x in np.frombuffer(ids, "<u4").tolist()])


def encode(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """Adds ids (binary: little-endian unsigned 32-bit integers) and decoded (string) to docs."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # one vocabulary file
    rest = [c for c in docs.columns if c not in ("ids", "decoded")]
    shape = docs.select(rest).schema.add("ids", "binary").add("decoded", "string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given_back()
        codec = Codec(spec.value)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                got = codec.encode(part.column(rest.index(text)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.string())], names=[*rest, "ids", "decoded"])
        del codec
        given_back()

    return docs.select(rest).mapInArrow(work, shape)


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of ids (as encode gives them)."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = encoded.sparkSession.sparkContext.broadcast(f.read())
    rest = [c for c in encoded.columns if c != out]
    shape = encoded.select(rest).schema.add(out, "string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(spec.value)
        for batch in batches:
            got = [codec.decode(x) for x in batch.column(rest.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], names=[*rest, out])

    return encoded.select(rest).mapInArrow(work, shape)


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    return encode(docs, tokenizer).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), word_bpe())
