"""Removal of repeated passages by merged Burrows-Wheeler transforms.

A byte goes if a LENGTH-byte string that covers it also starts in a document with a smaller doc_id.

Every LENGTH-byte window belongs to its minimizer, the least hash of the GRAM-byte strings in it;
neighbouring windows with one minimizer form a run. Equal windows have equal minimizers, so runs can
be dealt by minimizer and all that equals a window meets in one bucket:

1. Blocks of documents tell each bucket their runs by hash: minimizer, string, least doc_id. A minimizer
   of one document only goes no further; one that always stands in the same string is settled, since
   equal strings are one with its least doc_id.
2. The runs of the others are sent as strings, equal strings of a block once. A bucket splits its
   strings into SHARDS, builds each shard's Burrows-Wheeler transform, and merges them by refining
   their interleave one character at a time: after k rounds it is in the order of k-byte prefixes,
   and neighbours that were told apart in round k have a common prefix of k - 1. After LENGTH
   rounds, intervals that were never told apart are the repeated strings, and the least doc_id of an
   interval is its windows'. No suffix is sorted again, and one that stands alone leaves the rounds.
   Strings that share neither what stands before their minimizer nor what stands behind it have no
   window in common (a sure bound) and are not merged.
3. Blocks mark the windows that start earlier elsewhere and remove the bytes that they cover.

Scale: text is written once as blocks and shuffled twice by block; only candidates are sent. A
minimizer with more than HOT different strings (a passage in a third of all documents) is sent window
by window, dealt by the window's own hash, so that no bucket has to hold its contexts. Merges run in
chunks of about CHUNK symbols. Strings under one minimizer are told apart by 48 bits of hash.

Defined results: null and empty texts have 0 bytes and lose nothing; rows that share a doc_id do not
remove each other's bytes; a null doc_id takes no part and loses nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.blocks import answered, bounds, bucket_of, from_planes, from_text_block, ids_and_text, join_parts, make_blocks, pack_sorted, planes, split_parts, text_block, unpack_sorted, with_replies
from millrace.llm.core import mix, prefix_hash, span_hash

LENGTH = 50
GRAM = 20
#: Windows of a run at most.
LONGEST_RUN = 128
HOT = 1_000
SHARDS = 2
CHUNK = 30_000

_A, _B, _C = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD1342543DE82EF95), np.uint64(0xBF58476D1CE4E5B9)
_LOW48 = np.uint64((1 << 48) - 1)


#: Bytes of text that are hashed at once, so that the arrays stay in a core's cache.
PIECE = 96_000


def runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(minimizer, hash of its string, first window, end, number of text) of every run; windows never cross texts."""
    parts, at, n = [], 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + PIECE, "right")) - 1)
        if off[to] - off[at] >= LENGTH:
            key, name, start, end, text = runs_of_piece(data[off[at] : off[to]], off[at : to + 1] - off[at])
            parts.append((key, name, start + off[at], end + off[at], text + at))
        at = to
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(5))


def grams(data: np.ndarray) -> np.ndarray:
    """Hashes of all GRAM-byte strings (16 to 24 bytes)."""
    word = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,)).astype(np.uint64)
    n = len(data) - GRAM + 1
    h = word[:n] * _A
    h += word[GRAM - 8 :] * _C
    h ^= word[8 : n + 8]
    h ^= h >> np.uint64(29)
    h *= _B
    h ^= h >> np.uint64(32)
    return h


def runs_of_piece(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    h = grams(data)
    span, width = LENGTH - GRAM + 1, 1
    while 2 * width <= span:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    if width < span:
        h = np.minimum(h[: -(span - width)], h[span - width :])
    # a run ends where the minimizer changes, before windows that would leave the text, and with the text
    size = np.diff(off)
    new = np.empty(len(h), bool)
    new[0] = True
    np.not_equal(h[1:], h[:-1], out=new[1:])
    heads = off[:-1][size >= LENGTH]
    tails = (off[1:] - LENGTH + 1)[size >= LENGTH]
    new[heads] = True
    new[tails[tails < len(h)]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(h))
    text = np.searchsorted(off, start, "right") - 1
    inside = start + LENGTH <= off[text + 1]
    start, end, text = start[inside], end[inside], text[inside]
    if len(start) and (end - start).max() > LONGEST_RUN:
        pieces = -(-(end - start) // LONGEST_RUN)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, end, text = np.repeat(start, pieces) + nth * LONGEST_RUN, np.repeat(end, pieces), np.repeat(text, pieces)
        end = np.minimum(end, start + LONGEST_RUN)
    return mix(h[start]), span_hash(prefix_hash(data), start, end + LENGTH - 1) & _LOW48, start, end, text


class Runs:
    """The runs of a block, and its entries: the distinct (minimizer, string) by that order."""

    def __init__(self, block: bytes):
        self.ids, self.data, self.off = from_text_block(block)
        self.key, self.name, self.start, self.end, text = runs(self.data, self.off)
        self.owner = self.ids[text]
        self.order, self.first, self.which = distinct(self.key, self.name, nearly=True)
        self.pick = self.order[self.first]

    def least(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each entry: its least id, and whether it has another."""
        if not len(self.first):
            return self.ids[:0], np.zeros(0, bool)
        low = np.minimum.reduceat(self.owner[self.order], self.first)
        return low, low != np.maximum.reduceat(self.owner[self.order], self.first)


def distinct(key: np.ndarray, name: np.ndarray, nearly: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by (key, name), where its distinct pairs begin, and the number of each row's pair.

    nearly: by the upper bits of the key and some of the name, in one sort; a pair may then, rarely,
    count as two, which costs a message and changes no result.
    """
    if nearly:
        order = np.argsort((key & ~np.uint64(0xFFFF)) | (name & np.uint64(0xFFFF)))
    else:
        order = np.lexsort((name, key))
    k, n = key[order], name[order]
    new = np.ones(len(order), bool)
    new[1:] = (k[1:] != k[:-1]) | (n[1:] != n[:-1])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), which


def tell_runs(n_buckets: int):
    def send(block: bytes, _: dict[int, bytes]) -> list[tuple[int, bytes]]:
        r = Runs(block)
        low, more = r.least()
        key, name = r.key[r.pick], r.name[r.pick]
        six = name.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        return [(b, join_parts([pack_sorted(key[i:j]), six[i:j].tobytes(), planes(low[i:j].view(np.uint64)), np.packbits(more[i:j]).tobytes()])) for b, i, j in bounds(bucket_of(key, n_buckets))]

    return send


ALONE, SETTLED, OPEN, HOT_KEY = range(4)


def settle_runs(messages: list[bytes]) -> list[bytes]:
    """For each entry told: what its minimizer is, and for settled ones the least id."""
    parts = [split_parts(m) for m in messages]
    keys = [unpack_sorted(p[0]) for p in parts]
    size = [len(k) for k in keys]
    key = np.concatenate(keys)
    six = np.concatenate([np.frombuffer(p[1], np.uint8).reshape(-1, 6) for p in parts])
    name = np.pad(six, ((0, 0), (0, 2))).view("<u8").ravel()
    low = np.concatenate([from_planes(p[2]).view(np.int64) for p in parts])
    more = np.concatenate([np.unpackbits(np.frombuffer(p[3], np.uint8), count=n) for p, n in zip(parts, size, strict=True)])
    order, first, _ = distinct(key, name)
    k = key[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    at = np.flatnonzero(new)
    group = np.empty(len(k), np.int64)
    group[order] = np.cumsum(new) - 1
    variants = np.bincount(group[order[first]])
    least = np.minimum.reduceat(low[order], at)
    repeated = (least != np.maximum.reduceat(low[order], at)) | (np.maximum.reduceat(more[order], at) > 0)
    mark = np.where(~repeated, ALONE, np.where(variants == 1, SETTLED, np.where(variants > HOT, HOT_KEY, OPEN))).astype(np.uint8)[group]
    least = least[group]
    out, done = [], 0
    for n in size:
        m, v = mark[done : done + n], least[done : done + n]
        done += n
        out.append(join_parts([m.tobytes(), planes(v[m == SETTLED].view(np.uint64))]))
    return out


def marks_of(replies: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The marks of a block's entries, and the least ids of the settled ones (0 for others)."""
    parts = [split_parts(replies[b]) for b in sorted(replies)]
    if not parts:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    mark = np.frombuffer(b"".join(p[0] for p in parts), np.uint8)
    least = np.zeros(len(mark), np.int64)
    least[mark == SETTLED] = np.concatenate([from_planes(p[1]).view(np.int64) for p in parts])
    return mark, least


def strings(r: Runs, mark: np.ndarray) -> tuple:
    """The open strings of a block: distinct (key, start, length, least id) by key, and for each
    occurrence its string, first byte and id."""
    mark = mark[r.which] if len(r.which) else mark
    cold, hot = mark == OPEN, mark == HOT_KEY
    windows = (r.end - r.start)[hot]
    each = np.repeat(r.start[hot], windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    at = np.concatenate([r.start[cold], each])
    length = np.concatenate([(r.end - r.start)[cold] + LENGTH - 1, np.full(len(each), LENGTH)])
    owner = np.concatenate([r.owner[cold], np.repeat(r.owner[hot], windows)])
    own = span_hash(prefix_hash(r.data), each, each + LENGTH) if len(each) else r.key[:0]
    key, name = np.concatenate([r.key[cold], mix(own)]), np.concatenate([r.name[cold], own])
    order, first, which = distinct(key, name, nearly=True)
    least = np.minimum.reduceat(owner[order], first) if len(first) else owner[:0]
    pick = order[first]
    return (key[pick], at[pick], length[pick], least), (which, at, owner)


def gathered(data: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of several spans, one after the other."""
    place = np.arange(length.sum()) + np.repeat(at - (np.cumsum(length) - length), length)
    return data[place]


def send_strings(n_buckets: int):
    def send(block: bytes, replies: dict[int, bytes]) -> list[tuple[int, bytes]]:
        r = Runs(block)
        (k, at, length, least), _ = strings(r, marks_of(replies)[0])
        data = r.data
        return [
            (b, join_parts([pack_sorted(k[i:j]), length[i:j].astype(np.uint8).tobytes(), planes(least[i:j].astype(np.int64).view(np.uint64)), gathered(data, at[i:j], length[i:j]).tobytes()]))
            for b, i, j in bounds(bucket_of(k, n_buckets))
        ]

    return send


def transform(data: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A shard's Burrows-Wheeler transform and the suffix at each place; strings end in distinct
    terminators, which are 0 in the transform and sort first, by string. Symbols are bytes plus one."""
    k, n = len(length), len(data) + len(length)
    stop = np.cumsum(length + 1) - 1
    symbol = np.zeros(n, np.uint8)
    body = np.ones(n, bool)
    body[stop] = False
    symbol[body] = data + np.uint8(1)  # no byte of UTF-8 is 255
    rank = symbol.astype(np.uint64) + np.uint64(k)
    rank[stop] = np.arange(k, dtype=np.uint64)
    base = np.uint64(k + 257)
    depth = 63 // int(base).bit_length()
    top = np.append(rank, np.zeros(depth, np.uint64))
    value = top[:n].copy()
    for j in range(1, depth):
        value = value * base + top[j : n + j]
    while True:
        order = np.argsort(value)
        new = np.zeros(n, np.uint64)
        new[1:] = value[order][1:] != value[order][:-1]
        place = np.cumsum(new, dtype=np.uint64)
        rank = np.empty(n, np.uint64)
        rank[order] = place
        if depth > LENGTH or int(place[-1]) == n - 1:
            break
        ahead = np.zeros(n, np.uint64)
        ahead[: max(n - depth, 0)] = rank[depth:] + np.uint64(1)
        value = rank * np.uint64(n + 1) + ahead
        depth *= 2
    before = np.zeros(n, np.uint8)
    before[1:] = symbol[:-1]  # before a string's first byte stands a terminator
    return before[order], order


def merged_intervals(data: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For every byte of the strings (and a place for each terminator): the number of the interval of
    suffixes that share its next LENGTH symbols, -1 where it shares them with none. Shards' transforms are
    merged by interleave refinement: `at` is the interleave, as places in the transforms one behind the other.
    A suffix told apart from all others tells all longer ones apart as well, so that it takes no part in later rounds."""
    parts = np.array_split(np.arange(len(length)), min(SHARDS, len(length)))
    begin = np.concatenate([[0], np.cumsum(length)])
    made = [transform(data[begin[p[0]] : begin[p[-1] + 1]], length[p]) for p in parts]
    bwt = np.concatenate([b for b, _ in made])
    shift = np.cumsum([0] + [len(b) for b, _ in made])
    suffix = np.concatenate([o + s for (_, o), s in zip(made, shift[:-1], strict=True)])
    # where in its shard the suffix stands that is longer by the symbol before
    longer = np.empty(len(bwt), np.int32)
    for (b, _), s in zip(made, shift[:-1], strict=True):
        longer[np.argsort(b, kind="stable") + s] = np.arange(s, s + len(b), dtype=np.int32)
    at, group = np.arange(len(bwt), dtype=np.int32), np.zeros(len(bwt), np.int32)
    for _ in range(LENGTH):
        c = bwt[at]
        order = np.argsort(c, kind="stable")
        order = order[np.count_nonzero(c == 0) :]  # a suffix that begins with its terminator is alone
        at, group, c = longer[at[order]], group[order], c[order]
        told = np.ones(len(at) + 1, bool)
        told[1:-1] = (group[1:] != group[:-1]) | (c[1:] != c[:-1])
        stays = ~(told[:-1] & told[1:])
        at, group = at[stays], np.cumsum(told[:-1], dtype=np.int32)[stays]
    out = np.full(len(bwt), -1, np.int64)
    out[suffix[at]] = group
    return out


def may_share(key: np.ndarray, data: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which strings can have a window that another has too; the others' minimizers stand in other surroundings.

    A shared window holds the minimizer and, before or behind it, half of its other bytes at least: strings that
    share none of these two surroundings share no window.
    """
    half = (LENGTH - GRAM + 1) // 2
    begin = np.cumsum(length) - length
    of = np.repeat(np.arange(len(length)), length)[: len(data) - GRAM + 1]
    spot = np.flatnonzero(mix(grams(data)) == key[of])
    of = of[spot]
    end, s = begin[of] + length[of], prefix_hash(data)
    before, behind = (spot - half >= begin[of]) & (spot + GRAM <= end), spot + GRAM + half <= end
    around = np.concatenate([span_hash(s, spot[before] - half, spot[before] + GRAM), ~span_hash(s, spot[behind], spot[behind] + GRAM + half)])
    of = np.concatenate([of[before], of[behind]])
    out = np.zeros(len(length), bool)
    if len(of):
        order = np.argsort(around)
        around, of = around[order], of[order]
        first = np.flatnonzero(np.append(True, around[1:] != around[:-1]))
        shared = np.minimum.reduceat(of, first) != np.maximum.reduceat(of, first)
        out[of[np.repeat(shared, np.diff(np.append(first, len(of))))]] = True
    return out


def earliest(messages: list[bytes]) -> list[bytes]:
    """For each string sent: the least doc_id that has each of its windows, as runs of equal ones."""
    parts = [split_parts(m) for m in messages]
    sizes = [len(p[1]) for p in parts]
    key = np.concatenate([unpack_sorted(p[0]) for p in parts])
    length = np.concatenate([np.frombuffer(p[1], np.uint8) for p in parts]).astype(np.int64)
    least = np.concatenate([from_planes(p[2]).view(np.int64) for p in parts])
    data = np.frombuffer(b"".join(p[3] for p in parts), np.uint8)
    at = np.cumsum(length) - length
    name = span_hash(prefix_hash(data), at, at + length)
    order, first, which = distinct(key, name)
    pick = order[first]
    low = np.minimum.reduceat(least[order], first)
    ukey, uat, ulen = key[pick], at[pick], length[pick]
    group = np.concatenate([[0], np.cumsum(ukey[1:] != ukey[:-1])])
    several = np.bincount(group)[group] > 1
    # windows of all distinct strings, with the least id of their own string to begin with
    many = ulen - LENGTH + 1
    wat = np.cumsum(many) - many
    value = np.repeat(low, many)
    todo = np.flatnonzero(several)
    if len(todo):
        todo = todo[may_share(ukey[todo], gathered(data, uat[todo], ulen[todo]), ulen[todo])]
    cut = np.flatnonzero(np.diff(np.cumsum(ulen[todo]) // CHUNK)) + 1
    cut = sorted({int(np.searchsorted(group[todo], group[todo][c])) for c in cut} - {0})  # whole minimizers
    for chunk in np.split(todo, cut):
        if not len(chunk):
            continue
        interval = merged_intervals(gathered(data, uat[chunk], ulen[chunk]), ulen[chunk])
        start = np.cumsum(ulen[chunk] + 1) - (ulen[chunk] + 1)
        place = np.repeat(start - (np.cumsum(many[chunk]) - many[chunk]), many[chunk]) + np.arange(many[chunk].sum())
        target = np.repeat(wat[chunk] - (np.cumsum(many[chunk]) - many[chunk]), many[chunk]) + np.arange(many[chunk].sum())
        of, shared = interval[place], interval[place] >= 0
        of, target = of[shared], target[shared]
        best = np.full(of.max(initial=-1) + 1, np.iinfo(np.int64).max)
        np.minimum.at(best, of, value[target])
        value[target] = best[of]
    turn = np.ones(len(value), bool)
    turn[1:] = value[1:] != value[:-1]
    turn[wat] = True
    begins = np.flatnonzero(turn)
    stretch = np.diff(np.append(begins, len(value)))
    n_runs = np.add.reduceat(turn, wat)
    rat = np.cumsum(n_runs) - n_runs
    out, done = [], 0
    for n in sizes:
        mine = which[done : done + n]
        done += n
        r = np.repeat(rat[mine] - (np.cumsum(n_runs[mine]) - n_runs[mine]), n_runs[mine]) + np.arange(n_runs[mine].sum())
        out.append(join_parts([n_runs[mine].astype(np.uint8).tobytes(), stretch[r].astype(np.uint8).tobytes(), planes(value[begins[r]].view(np.uint64))]))
    return out


def applied(marks: dict[int, bytes], replies: dict[int, bytes], block: bytes) -> pd.DataFrame:
    r = Runs(block)
    ids, data, off = r.ids, r.data, r.off
    mark, least = marks_of(marks)
    gone = np.zeros(len(data) + 1, np.int32)
    if len(r.which):
        cut = (mark[r.which] == SETTLED) & (least[r.which] < r.owner)
        np.add.at(gone, r.start[cut], 1)
        np.add.at(gone, r.end[cut] + LENGTH - 1, -1)
    _, (which, at, owner) = strings(r, mark)
    if len(which):
        parts = [split_parts(replies[b]) for b in sorted(replies)]
        n_runs = np.concatenate([np.frombuffer(p[0], np.uint8) for p in parts]).astype(np.int64)
        stretch = np.concatenate([np.frombuffer(p[1], np.uint8) for p in parts]).astype(np.int64)
        value = np.concatenate([from_planes(p[2]).view(np.int64) for p in parts])
        rat = np.cumsum(n_runs) - n_runs
        reach = np.cumsum(stretch)
        many = n_runs[which]
        x = np.repeat(rat[which] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        begin = reach[x] - stretch[x] - np.repeat(reach[rat[which]] - stretch[rat[which]], many) + np.repeat(at, many)
        cut = value[x] < np.repeat(owner, many)
        np.add.at(gone, begin[cut], 1)
        np.add.at(gone, (begin + stretch[x] + LENGTH - 1)[cut], -1)
    lost = np.cumsum(gone[:-1]) > 0
    edge = lost.copy()
    edge[1:] &= ~lost[:-1]
    heads = off[:-1][off[:-1] < len(lost)]
    edge[heads] = lost[heads]
    total, spans = np.concatenate([[0], np.cumsum(lost)]), np.concatenate([[0], np.cumsum(edge)])
    rest = [data[a:b][~lost[a:b]].tobytes() if total[b] > total[a] else data[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)]
    return pd.DataFrame({"doc_id": ids, "n_bytes": np.diff(off), "n_removed": np.diff(total[off]), "n_spans": np.diff(spans[off]), "kept": rest})


SHAPE = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def without_passages(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): each text's bytes without the passages that start earlier elsewhere."""
    spark = docs.sparkSession
    rows = ids_and_text(docs, key, text)
    blocks = make_blocks(rows.where("id is not null"), text_block, "passages")
    n = max(1, blocks.count() // 2)
    marks = answered(blocks, None, tell_runs(n), settle_runs, "minimizers", n)
    least = answered(blocks, marks.replies, send_strings(n), earliest, "intervals", n)
    out = with_replies(blocks, [marks.replies, least.replies], lambda _, block, got: applied(got[0], got[1], block), SHAPE)
    unnamed = rows.where("id is null").select(F.col("id").alias("doc_id"), F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    return out.unionByName(unnamed)


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
