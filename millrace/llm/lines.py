"""Fuzzy line deduplication by SimHash.

Lines are normalised (lower-cased A-Z; ASCII punctuation and white space as one blank). Lines equal
after that are one class; each class has a 64-bit SimHash of its words. Two SimHashes within
SURE bits agree on at least two of BLOCKS blocks (the pigeonhole rule), so classes that share a
pair of blocks are candidates. One changed word moves several bits, so that blocks alone find a
fifth of the lines with edit similarity 0.8: classes that share one of BANDS keys of three minima
over their pairs of neighbouring words are candidates as well. Candidates within DISTANCE bits are
verified by edit similarity of the normalised lines, after a bound from counts of three-character
strings has ruled out most of the others, and connected classes form a group. A group keeps its
first occurrence, by (doc_id, line number), and loses the others. Recall against edit similarity
alone is tested (tests/llm) and stated in the README.

Scale: lines equal after normalising fold in a map-side combined aggregate, so that a line in a
third of all documents is one row from each task; block pairs and band keys hold 32 bits, their
shuffles follow each other, and links.link compares within buckets and never emits all their pairs.
Text is read once for hashes, once for the candidates' lines, and once to apply the decisions.

Defined results: null and empty texts have no lines to remove, and lines without a letter or digit
stay; rows that share a doc_id and text are one document and are treated alike; a null doc_id keeps
all its lines. Columns other than the text pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.blocks import from_planes, join_parts, planes, split_parts, squeezed, unsqueezed
from millrace.llm.core import Words, dropped, fresh, given_back, lower_az, mix, slices, stored
from millrace.llm.links import link

#: Bits between the SimHashes of lines that are verified, and of those that are sure to be candidates.
DISTANCE = 16
SURE = 1
BLOCKS = 3
#: Keys of ROWS minima each, and the bytes of a pair of words below which it ranks after all longer ones.
BANDS, ROWS, LIGHT = 10, 3, 12
PACKED = [f"k{i}" for i in range(BANDS // 2)]
SIMILARITY_PERCENT = 80

_ONE = np.uint64(1)
_A, _B = np.uint64(0xD1342543DE82EF95), np.uint64(0x9FB21C651E98DF25)
#: White space and ASCII punctuation.
_GAP = np.zeros(256, bool)
_GAP[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
NORMAL = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def line_table(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the lines with a word: text, number in it, fingerprints (n, 2), SimHash, band keys (n, BANDS / 2)."""
    feeds = np.flatnonzero(data == 10)
    many = np.diff(np.searchsorted(feeds, off)) + 1
    text = np.repeat(np.arange(len(many)), many)
    number = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    starts = np.sort(np.concatenate([off[:-1], feeds + 1]), kind="stable")
    w = Words(data, np.append(starts, len(data)), gaps=_GAP)
    full = np.flatnonzero(w.count)
    if not len(full):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros((0, 2), np.uint64), np.zeros(0, np.uint64), np.zeros((0, BANDS // 2), np.uint64)
    at = w.first[:-1][full]
    # a line's fingerprint: its words' hashes, each under a power by its place
    place = np.arange(len(w.hash)) - np.repeat(at, w.count[full])
    up = np.cumprod(np.concatenate([[_ONE], np.full(int(place.max()), _A, np.uint64)]), dtype=np.uint64)
    one = np.add.reduceat(w.hash * up[place], at)
    two = np.add.reduceat(mix(w.hash ^ _B) * up[place], at)
    marks = mix(np.stack([one, two], axis=1) + w.count[full].astype(np.uint64)[:, None])
    size = w.end - w.start
    return text[full], number[full], marks, simhash(w.hash, np.minimum(size, 12).astype(np.uint64), at, w.count[full]), bands(w.hash, size, at)


def bands(words: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Keys of the lines that begin at `at`, of 32 bits, two to a number.

    A key hashes ROWS minima over a line's pairs of neighbouring words, the last word with no other.
    Short pairs rank last: they are in so many lines that they would make large buckets.
    """
    last = np.append(at[1:], len(words)) - 1
    after, more = np.append(words[1:], _A), np.append(size[1:], 0)
    after[last], more[last] = _A, 0
    pair = mix(words * _A + after)
    high, low = (pair >> np.uint64(32)).astype(np.uint32), pair.astype(np.uint32)
    light = (size + more < LIGHT).astype(np.uint32) << np.uint32(31)
    odd = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * _B).astype(np.uint32) | np.uint32(1)
    keys = np.zeros((BANDS, len(at)), np.uint64)
    for i in range(BANDS * ROWS):
        rank = (((high * odd[2 * i]) ^ (low * odd[2 * i + 1])) * np.uint32(0x9E3779B1)) >> np.uint32(1)
        keys[i // ROWS] = mix(keys[i // ROWS] * _A + np.minimum.reduceat(rank | light, at))
    return ((keys[0::2] & ~np.uint64(0xFFFFFFFF)) | (keys[1::2] >> np.uint64(32))).T


#: Words that are counted at once: 16-bit counters hold them, at most 15 a word.
COUNTED = 4_000
_LANE = np.uint64(0x0001000100010001)


def simhash(words: np.ndarray, length: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Bit i is set if the different words of a line that have it set outweigh the others.

    A word counts once and weighs its length, 12 at most, and 0 to 3 by its hash: else the few words
    that make up half of any text would make all long lines alike, and short lines would have ties.
    Counters of 16 bits, four to a number.
    """
    line = np.repeat(np.arange(len(at), dtype=np.uint64), count)
    named = (line << np.uint64(40)) | (words >> np.uint64(24))
    order = np.argsort(named)
    new = np.ones(len(order), bool)
    new[1:] = named[order][1:] != named[order][:-1]
    pick = order[new]
    count = np.bincount(line[pick].astype(np.int64), minlength=len(at))
    at = np.cumsum(count) - count
    words, weight = words[pick], length[pick] + (words[pick] >> np.uint64(5)) % np.uint64(4)
    total = np.add.reduceat(weight, at)
    pieces = -(-count // COUNTED)
    first = np.cumsum(pieces) - pieces
    nth = np.arange(pieces.sum()) - np.repeat(first, pieces)
    begin = np.repeat(at, pieces) + nth * COUNTED
    out = np.zeros(len(at), np.uint64)
    for lane in range(16):
        sums = np.add.reduceat(((words >> np.uint64(lane)) & _LANE) * weight, begin)
        for k in range(4):
            votes = (sums >> np.uint64(16 * k)) & np.uint64(0xFFFF)
            votes = np.add.reduceat(votes, first) if len(begin) > len(at) else votes
            out |= (2 * votes > total).astype(np.uint64) << np.uint64(lane + 16 * k)
    return out


def occurrences(docs: DataFrame, text: str, key: str) -> DataFrame:
    """A row for each line with a word: again, if its class stands in its text before."""
    shape = "doc_id long, t long, line int, f1 long, f2 long, sim long, again boolean" + "".join(f", {k} long" for k in PACKED)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in slices(batches, "text"):
            of, number, marks, sim, keys = line_table(data, off)
            order = np.lexsort((number, marks[:, 1], marks[:, 0], of))
            again = np.zeros(len(of), bool)
            again[order[1:]] = (of[order[1:]] == of[order[:-1]]) & (marks[order[1:]] == marks[order[:-1]]).all(axis=1)
            at = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(at), rows.column(1).take(at), pa.array(number.astype(np.int32)), pa.array(marks[:, 0].view(np.int64)), pa.array(marks[:, 1].view(np.int64)), pa.array(sim.view(np.int64)), pa.array(again), *(pa.array(np.ascontiguousarray(k).view(np.int64)) for k in keys.T)],
                names=["doc_id", "t", "line", "f1", "f2", "sim", "again", *PACKED],
            )
        given_back()

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull()).mapInArrow(work, shape)


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or more than `most`: bit vectors as long integers, after common ends are cut."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    a, b = unlike(a, b)
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, d = full, 0, len(a)
    pause = max(LOOK, most // 4)
    look = most + pause
    for k, c in enumerate(b):
        if k == look:
            if least_end(up, down, len(a), k, len(b) - k) > most:
                return most + 1
            look += pause
        eq = where.get(c, 0)
        flat = (((eq & up) + up) ^ up) | eq | down
        rise = down | (full & ~(flat | up))
        fall = up & flat
        d += bool(rise & last) - bool(fall & last)
        if d - (len(b) - k - 1) > most:
            return most + 1
        rise = (rise << 1 | 1) & full
        fall = (fall << 1) & full
        up = fall | (full & ~((eq | down) | rise))
        down = rise & (eq | down)
    return d


#: Characters between two looks at whether the limit can still be met.
LOOK = 32


def least_end(up: int, down: int, n: int, k: int, rest: int) -> int:
    """A bound of the distance after k characters of the other line, `rest` before its end: it goes on from some
    place of the n, whose distance the bits give, and what is left of the two may differ in length."""
    one, two = (np.unpackbits(np.frombuffer(x.to_bytes((n + 7) // 8, "little"), np.uint8), count=n, bitorder="little").view(np.int8) for x in (up, down))
    here = np.zeros(n + 1, np.int64)
    np.cumsum(one - two, out=here[1:])
    return k + int((here + np.abs(n - rest - np.arange(n + 1))).min())


def unlike(a: str, b: str) -> tuple[str, str]:
    """The two without their common start and end."""
    n = min(len(a), len(b))
    i = _common(a, b, n)
    a, b = a[i:], b[i:]
    j = _common(a[::-1], b[::-1], n - i)
    return a[: len(a) - j], b[: len(b) - j]


def _common(a: str, b: str, n: int) -> int:
    """Length of the common start, by halving."""
    low, high = 0, n
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


#: Three-character strings are counted in PROFILE cells. One edit moves a profile by 2 * 3 at most; no smaller
#: number is sure, whatever words two lines share, so that LIKELY is the same.
PROFILE, AT_ONCE = 1_024, 4_096
#: Pairs whose profiles are held at once.
PROFILED = 1_024
SURELY = LIKELY = 6


def profiles(lines: list[str]) -> np.ndarray:
    """How often each hashed three-character string stands in each line."""
    code = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4") for x in lines]
    size = np.array([max(len(c) - 2, 0) for c in code], np.int64)
    out = np.zeros(len(lines) * PROFILE, np.int32)
    if size.any():
        h = np.concatenate([c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA6B) ^ c[2:] * np.uint32(0xC2B2AE35) for c in code if len(c) > 2])
        cell = (h * np.uint32(0x27D4EB2F) >> np.uint32(22)).astype(np.int64)
        out = np.bincount(np.repeat(np.arange(len(lines)), size) * PROFILE + cell, minlength=len(out)).astype(np.int32)
    return out.reshape(len(lines), PROFILE)


#: Words that are looked ahead for a place where two lines go on alike.
AHEAD = 6
_STEPS = [(p, d - p) for d in range(1, AHEAD + 1) for p in range(d + 1)]


def at_most(x: str, y: str, most: int) -> int:
    """A bound of the edit distance of two lines by aligning words, or more than `most`."""
    a, b = x.split(" "), y.split(" ")
    na, nb, i, j, cost = len(a), len(b), 0, 0, 0
    while i < na and j < nb and cost <= most:
        if a[i] == b[j]:
            i, j = i + 1, j + 1
            continue
        for p, q in _STEPS:
            if i + p < na and j + q < nb and a[i + p] == b[j + q]:
                break
        else:
            p = q = 1
        cost += max(sum(map(len, a[i : i + p])) + p, sum(map(len, b[j : j + q])) + q)
        i, j = i + p, j + q
    return cost + max(sum(map(len, a[i:])) + na - i, sum(map(len, b[j:])) + nb - j)


def similar_pairs(xs: list[str], ys: list[str], i: np.ndarray, j: np.ndarray, percent: int, moves: int = SURELY) -> np.ndarray:
    """Which of the pairs (xs[i], ys[j]) have the edit similarity."""
    out, left, most = settled(xs, ys, i, j, percent, moves)
    out[left] = within(xs, ys, i[left], j[left], most)
    return out


def settled(xs: list[str], ys: list[str], i: np.ndarray, j: np.ndarray, percent: int, moves: int = SURELY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which of the pairs are sure to have the similarity, which may have it, with how many edits): lengths and profiles rule out most of the others."""
    out = np.zeros(len(i), bool)
    nx, ny = (np.array([len(v) for v in side], np.int64) for side in (xs, ys))
    most = np.maximum(nx[i], ny[j]) * (100 - percent) // 100
    left = np.flatnonzero(np.abs(nx[i] - ny[j]) <= most)
    near = np.zeros(len(left), bool)
    for at in range(0, len(left), PROFILED):
        some = left[at : at + PROFILED]
        px, px_at = _profiled(xs, i[some])
        py, py_at = _profiled(ys, j[some])
        for k in range(0, len(some), 256):
            near[at + k : at + k + 256] = np.abs(px[px_at[k : k + 256]] - py[py_at[k : k + 256]]).sum(axis=1) <= moves * most[some[k : k + 256]]
    left = left[near]
    # lines that differ by words are mostly settled by aligning them
    sure = np.array([at_most(xs[i[n]], ys[j[n]], int(most[n])) <= most[n] for n in left], bool)
    out[left[sure]] = True
    left = left[~sure]
    return out, left, most[left]


def _profiled(lines: list[str], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Profiles of the lines named, once each, and where each name's is."""
    u, at = np.unique(which, return_inverse=True)
    return profiles([lines[k] for k in u]), at


#: Numbers that the tables of one batch of pairs hold, about, and those of one step of it at most.
CELLS, STEP = 2_000_000, 8_192
#: Pairs of like length below which they are compared one by one.
FEW = 16


def within(xs: list[str], ys: list[str], i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which of the pairs (xs[i], ys[j]) have an edit distance of `most` or less: many pairs of like length at once."""
    pairs = [unlike(xs[a], ys[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    longer = np.array([max(len(x), len(y)) for x, y in pairs], np.int64)
    out = longer <= most
    order = np.flatnonzero(~out & np.array([len(x) > 0 and len(y) > 0 for x, y in pairs], bool))
    order = order[np.argsort(longer[order], kind="stable")]
    size, at = longer[order], 0
    while at < len(order):
        # tables are as wide as the longest of a batch
        to = int(np.searchsorted(size, size[at] + size[at] // 4 + 32, "right"))
        to = min(to, at + max(1, STEP * 64 // int(size[to - 1])))
        some = order[at:to]
        if len(some) >= FEW:
            one, two = ([np.frombuffer(pairs[k][side].encode("utf-32-le", "surrogatepass"), "<u4") for k in some] for side in (0, 1))
            out[some] = _distances(one, two, most[some]) <= most[some]
        else:
            out[some] = [edit_distance(*pairs[k], int(most[k])) <= most[k] for k in some]
        at = to
    return out


def _table(lines: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Lines as rows, filled up with zeros, and their lengths."""
    size = np.array([len(x) for x in lines], np.int64)
    out = np.zeros((len(lines), int(size.max(initial=0))), np.uint32)
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = np.concatenate(lines) if size.any() else []
    return out, size


def _distances(xs: list[np.ndarray], ys: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    """Levenshtein distances of the pairs, or more than `most`: bit vectors of 64 places, each a character behind
    the one before it, so that one step moves all of all pairs."""
    a, na = _table(xs)
    words, pairs = max(1, -(-a.shape[1] // 64)), len(xs)
    known, codes = np.unique(a, return_inverse=True)  # 0 fills up and is a code as well, whose bits stand behind the end
    codes = codes.reshape(a.shape)
    many = max(1, CELLS // ((len(known) + 1) * words))
    if many < pairs:
        return np.concatenate([_distances(xs[at : at + many], ys[at : at + many], most[at : at + many]) for at in range(0, pairs, many)])
    b, nb = _table(ys)
    out = np.where(na == 0, nb, na)
    # the bits of each pair's characters, by (word, character, pair)
    where = np.zeros((words, len(known) + 1, pairs), np.uint64)
    for k in range(a.shape[1]):
        n = np.flatnonzero(na > k)
        where[k // 64, codes[n, k], n] |= _ONE << np.uint64(k % 64)
    width = where.shape[1] * pairs
    spot = np.searchsorted(known, b)
    said = known[np.minimum(spot, len(known) - 1)] == b if len(known) else np.zeros(b.shape, bool)
    spot = np.where(said, spot, len(known))
    # row words + k: the k-th characters; a word reads the rows from its own upwards
    read = np.full((b.shape[1] + 2 * words, pairs), len(known) * pairs, np.int64)
    read[words : words + b.shape[1]] = spot.T * pairs
    where = where.reshape(-1)
    of = np.arange(words)[:, None] * width + np.arange(pairs)[None, :]
    up, down = np.full((words, pairs), ~np.uint64(0)), np.zeros((words, pairs), np.uint64)
    edge = np.repeat(64 * np.arange(1, words + 1)[:, None], pairs, axis=1)  # distances at the last place of each word
    rise_in, fall_in = np.ones((words, pairs), np.uint64), np.zeros((words, pairs), np.uint64)
    top, who = np.uint64(63), np.arange(pairs)
    last = np.maximum(na - 1, 0) // 64
    behind = np.where(na % 64 > 0, ~np.uint64(0) << (na % 64).astype(np.uint64), np.uint64(0))
    end = np.where((na > 0) & (nb > 0), nb - 1 + last, -1)
    for t in range(int(end.max(initial=-1)) + 1):
        if t % LOOK == 0:
            stay = end[who] >= t
            if t and words > 2:
                low = least_ends(edge, t - np.arange(words), na[who], nb[who]) if t >= words else np.zeros(len(who), np.int64)
                lost = stay & (low > most[who])
                out[who[lost]] = most[who[lost]] + 1
                end[who[lost]] = -1
                stay &= ~lost
            if not stay.all():
                who = who[stay]
                read, of, up, down, edge, rise_in, fall_in = (np.ascontiguousarray(x[:, stay]) for x in (read, of, up, down, edge, rise_in, fall_in))
            if not len(who):
                break
            ends = end[who]
            finish = set(ends.tolist())
        v = min(t + 1, words)
        mv, pv, ri, fi = down[:v], up[:v], rise_in[:v], fall_in[:v]
        eq = where.take(read[words + t - v + 1 : words + t + 1][::-1] + of[:v])
        flat = eq | mv
        eq |= fi
        h = (((eq & pv) + pv) ^ pv) | eq
        rise, fall = mv | ~(h | pv), pv & h
        rise_out, fall_out = rise >> top, fall >> top
        edge[:v] += rise_out.view(np.int64) - fall_out.view(np.int64)
        rise, fall = (rise << _ONE) | ri, (fall << _ONE) | fi
        up[:v], down[:v] = fall | ~(flat | rise), rise & flat
        rise_in[1 : v + 1], fall_in[1 : v + 1] = rise_out[: words - 1], fall_out[: words - 1]
        if t in finish:
            done = np.flatnonzero(ends == t)
            at = last[who[done]]
            rest = behind[who[done]]
            out[who[done]] = edge[at, done] - np.bitwise_count(up[at, done] & rest) + np.bitwise_count(down[at, done] & rest)
    return out


def least_ends(edge: np.ndarray, k: np.ndarray, n: np.ndarray, size: np.ndarray) -> np.ndarray:
    """least_end of many pairs, from distances at the end of each word of places, k characters on by word: between two
    ends they fall by half of what the places allow. Words are a character apart, for which two are taken off."""
    low = 64 * np.arange(len(edge))[:, None]
    before = np.concatenate([np.broadcast_to(k[:1, None], (1, len(n))), edge[:-1]])
    even = n[None, :] - size[None, :] + k[:, None]
    off = np.maximum(0, np.maximum(low - even, even - np.minimum(low + 64, n[None, :])))
    bound = (before + edge - 63) // 2 + off - 2
    return np.where(low <= n[None, :], bound, np.iinfo(np.int32).max).min(axis=0)


def verified(pairs: DataFrame, percent: int) -> DataFrame:
    """Of (a, b, x, y) the (a, b) with edit similarity 1 - distance / longer length of percent / 100 or more."""

    def compared(held: list[tuple[pa.RecordBatch, np.ndarray]]) -> list[pa.RecordBatch]:
        rows, most = pa.Table.from_batches([h[0] for h in held]).combine_chunks(), np.concatenate([h[1] for h in held])
        every = np.arange(len(most))
        keep = within(rows.column(2).to_pylist(), rows.column(3).to_pylist(), every, every, most)
        return rows.select([0, 1]).filter(pa.array(keep)).to_batches()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                every = np.arange(part.num_rows)
                sure, left, most = settled(part.column(2).to_pylist(), part.column(3).to_pylist(), every, every, percent)
                yield part.select([0, 1]).filter(pa.array(sure))
                held.append((part.take(pa.array(left)), most))
                if sum(len(h[1]) for h in held) > AT_ONCE:
                    yield from compared(held)
                    held = []
        if held:
            yield from compared(held)
        del held
        given_back()

    return pairs.select("a", "b", "x", "y").mapInArrow(work, "a long, b long")


def close_lines(xs: list[dict], ys: list[dict], apart: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs `apart` of lines xs and ys (sim, x) are within DISTANCE bits and have the edit similarity."""
    return close_cells([(xs, ys, apart)], percent)[0]


def close_cells(cells: list[tuple[list[dict], list[dict], np.ndarray]], percent: int) -> list[np.ndarray]:
    """close_lines of many cells, their pairs verified together."""
    out, left, right, pairs = [], [], [], []
    for xs, ys, apart in cells:
        a, b = (np.array([v["sim"] for v in side], np.int64).view(np.uint64) for side in (xs, ys))
        near = apart & (np.bitwise_count(a[:, None] ^ b[None, :]) <= DISTANCE)
        pairs.append(np.argwhere(near) + [len(left), len(right)])
        out.append(near)
        left += [v["x"] for v in xs]
        right += [v["x"] for v in ys]
    i, j = np.concatenate(pairs).T
    good = np.split(similar_pairs(left, right, i, j, percent), np.cumsum([len(p) for p in pairs])[:-1])
    for near, links in zip(out, good, strict=True):
        near[near] = links
    return out


def similar(x: str, y: str, percent: int) -> bool:
    longer = max(len(x), len(y))
    return 100 * (longer - edit_distance(x, y, longer * (100 - percent) // 100)) >= percent * longer


#: A key is its number above PLACE bits and what its blocks or minima hold below.
PLACE = 44
_EDGE = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
_PAIRS = list(combinations(range(BLOCKS), BLOCKS - SURE))
KEYS = len(_PAIRS) + BANDS
#: Keys of a range, ranges that one batch of classes is dealt over, and classes of a batch.
RANGE, FAN, BATCH = 1_000_000, 256, 65_536


def all_keys() -> list[Column]:
    """The keys of a class with columns sim and PACKED: one for each pair of blocks, one for each band."""
    block = [F.shiftrightunsigned(F.col("sim"), _EDGE[i]).bitwiseAND(F.lit((1 << (_EDGE[i + 1] - _EDGE[i])) - 1)) for i in range(BLOCKS)]
    out = [F.lit(n << PLACE).bitwiseOR(F.shiftleft(block[i], 22)).bitwiseOR(block[j]) for n, (i, j) in enumerate(_PAIRS)]
    return out + [F.lit((len(_PAIRS) + n) << PLACE).bitwiseOR(F.shiftrightunsigned(F.col(PACKED[n // 2]), 32 * (n % 2)).bitwiseAND(F.lit(0xFFFFFFFF))) for n in range(BANDS)]


def keys_of(sim: np.ndarray, packed: list[np.ndarray]) -> np.ndarray:
    """The same of many classes, (KEYS, n)."""
    block = [(sim >> np.uint64(_EDGE[i])) & np.uint64((1 << (_EDGE[i + 1] - _EDGE[i])) - 1) for i in range(BLOCKS)]
    out = [np.uint64(n << PLACE) | block[i] << np.uint64(22) | block[j] for n, (i, j) in enumerate(_PAIRS)]
    out += [np.uint64((len(_PAIRS) + n) << PLACE) | packed[n // 2] >> np.uint64(32 * (n % 2)) & np.uint64(0xFFFFFFFF) for n in range(BANDS)]
    return np.stack(out)


def _entries(parts: list[np.ndarray]) -> bytes:
    return squeezed(join_parts([planes(x) for x in parts]))


def _dealt(key: np.ndarray, rest: list[np.ndarray], of: np.ndarray, known: list[np.ndarray]) -> tuple[list[int], list[bytes]]:
    """Entries by the range `of` each; the entries `known` to be shared go along with the first range."""
    order = np.argsort(of, kind="stable")
    cut = np.flatnonzero(np.diff(of[order])) + 1
    names, data = [], []
    for at in np.split(order, cut):
        extra = known if not names else [x[:0] for x in known]
        names.append(int(of[at[0]]))
        data.append(_entries([key[at], *(x[at] for x in rest), *extra]))
    return names, data


def candidates(classes: DataFrame) -> DataFrame:
    """Stored (key, id, sim): the classes that share a key, without pairs that are too far apart.

    Keys travel packed, a row for each batch of classes and range of keys. A batch that has a key more
    than twice sends it once, marked, and passes these classes on as they are: so a key that a third of
    all classes share is a few entries in its range. Ranges beyond FAN are reached in two steps.
    """
    ranges = max(1, -(-classes.count() * KEYS // RANGE))
    first = min(ranges, FAN)
    finer = -(-ranges // first)
    shape = "part int, data binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for rows in (whole.slice(at, BATCH) for at in range(0, whole.num_rows, BATCH)):
                id_, sim, *packed = (rows.column(i).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for i in range(rows.num_columns))
                key = keys_of(sim, packed).ravel()
                who = np.tile(np.arange(len(id_)), KEYS)
                order = np.argsort(key, kind="stable")
                key, who = key[order], who[order]
                start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                many = np.diff(np.append(start, len(key)))
                often = np.repeat(many > 2, many)
                sent = ~often
                sent[start[many > 2]] = True
                known = [key[often], id_[who[often]], sim[who[often]]]
                k, w = key[sent], who[sent]
                names, data = _dealt(k, [id_[w], sim[w], often[sent].astype(np.uint64)], (mix(k) % np.uint64(first)).astype(np.int64), known)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(data, pa.binary())], names=["part", "data"])
        given_back()

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for part, data in zip(f["part"], f["data"], strict=True):
                k, i, s, m, *known = (from_planes(x) for x in split_parts(unsqueezed(data)))
                to, out = _dealt(k, [i, s, m], (mix(k) // np.uint64(first) % np.uint64(finer)).astype(np.int64), known)
                yield pd.DataFrame({"part": [int(part) + first * t for t in to], "data": out})

    def shared(f: pd.DataFrame) -> pd.DataFrame:
        parts = [[from_planes(x) for x in split_parts(unsqueezed(d))] for d in f["data"]]
        k, i, s, m, kk, ki, ks = (np.concatenate([p[n] for p in parts]) for n in range(7))
        order = np.argsort(k, kind="stable")
        k, i, s, m = k[order], i[order], s[order], m[order] > 0
        start = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
        many = np.diff(np.append(start, len(k)))
        two = np.flatnonzero(many == 2)
        close = np.bitwise_count(s[start[two]] ^ s[start[two] + 1]) <= DISTANCE
        good = (many > 2) | (np.logical_or.reduceat(m, start) if len(k) else many > 2)
        good[two] |= close
        keep = np.repeat(good, many) & ~m
        column = lambda a, b: np.concatenate([a[keep], b]).view(np.int64)
        return pd.DataFrame({"key": column(k, kk), "id": column(i, ki), "sim": column(s, ks)})

    sent = classes.select(F.col("f1").alias("id"), "sim", *PACKED).mapInArrow(pack, shape)
    if finer > 1:
        sent = sent.mapInPandas(split, shape)
    return stored(sent.groupBy("part").applyInPandas(shared, "key long, id long, sim long"), "line-keys")


def repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """(doc_id, t = xxhash64 of the text, lines array<int>): the lines that each text loses, numbered from 0."""
    found = stored(occurrences(docs, text, key), "lines")
    classes = stored(found.groupBy("f1", "f2").agg(F.min("doc_id").alias("d"), F.max("sim").alias("sim"), F.count("*").alias("n"), *(F.max(k).alias(k) for k in PACKED)), "line-classes")
    live = candidates(classes)
    # a class is known by f1 from here on: of classes that share it, by chance, one takes part
    wanted = classes.join(live.select(F.col("id").alias("f1")).distinct(), "f1", "left_semi").groupBy("f1").agg(F.min(F.struct("f2", "d")).alias("c")).select("f1", "c.f2", F.col("c.d").alias("doc_id"))
    heads = stored(found.where(~F.col("again")).join(wanted, ["f1", "f2", "doc_id"]).groupBy(F.col("f1").alias("id"), "f2", "doc_id").agg(F.min(F.struct("line", "t")).alias("at"), F.max("sim").alias("sim"), *(F.max(k).alias(k) for k in PACKED)).select("id", "f2", "doc_id", "at.line", "at.t", "sim", *PACKED), "line-heads")
    body = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    normal = F.trim(lower_az(F.regexp_replace(F.get(F.split("text", "\n", -1), F.col("line")), NORMAL, " ")))
    texts = stored(body.join(heads, ["doc_id", "t"]).select("id", "sim", *PACKED, normal.alias("x")).dropDuplicates(["id"]), "line-texts")

    def near(pairs: DataFrame) -> DataFrame:
        one, two = (texts.select(F.col("id").alias(i), F.col("sim").alias("s" + i), F.col("x").alias(t)) for i, t in (("a", "x"), ("b", "y")))
        close = pairs.join(one, "a").join(two, "b").where(F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) <= DISTANCE)
        return verified(close, percent)

    labels = link(live, near, texts.select("id", F.struct("sim", "x", F.array(*all_keys()).alias("keys")).alias("p")), lambda cells: close_cells(cells, percent))
    keeper = classes.where("n > 1").select("f1", "f2", F.col("d").alias("keep_doc"), F.lit(None).cast("int").alias("keep_line"))
    if labels is not None:
        # classes of one group keep the first of their first occurrences; that class's own line stays
        group = labels.unionByName(labels.select(F.col("label").alias("id"), "label")).distinct().join(heads, "id")
        group = stored(group.withColumn("at", F.struct("doc_id", "line")).select("id", "f2", "label", "at"), "line-groups")
        first = group.groupBy("label").agg(F.min("at").alias("keep"))
        linked = group.join(first, "label").select(F.col("id").alias("f1"), "f2", F.col("keep.doc_id").alias("keep_doc"), F.when(F.col("at") == F.col("keep"), F.lit(None)).otherwise(F.col("keep.line")).cast("int").alias("keep_line"))
        keeper = keeper.join(linked.select("f1", "f2"), ["f1", "f2"], "left_anti").unionByName(linked)
    gone = found.join(keeper, ["f1", "f2"]).where(F.col("again") | (F.col("doc_id") != F.col("keep_doc")) | (F.col("keep_line").isNotNull() & (F.col("line") != F.col("keep_line"))))
    return gone.groupBy("doc_id", "t").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def without_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = SIMILARITY_PERCENT, gone: str = "_gone") -> DataFrame:
    """docs with column `gone` (the lines lost, null for none; one of that name is replaced) and the text without them."""
    d, t, lost = fresh(docs, "_d", "_t", "_lost")
    found = repeats(docs, text, key, percent).select(F.col("doc_id").alias(d), F.col("t").alias(t), F.col("lines").alias(lost))
    out = docs.join(found, (F.col(key).cast("long") == F.col(d)) & (F.xxhash64(text) == F.col(t)), "left").drop(d, t)
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(lost, i)), "\n")
    return out.withColumn(text, F.when(F.col(lost).isNull(), F.col(text)).otherwise(kept)).withColumn(gone, F.col(lost)).drop(lost)


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"))
    out = without_repeats(docs)
    return out.select("doc_id", "n_lines", F.coalesce(F.size("_gone").cast("long"), F.lit(0)).alias("n_removed"), F.col("_gone").alias("removed_lines"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
