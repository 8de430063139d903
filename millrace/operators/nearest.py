"""Nearest neighbours of many queries within a task: matrix products, and the few candidates that could be among the best.

Scores of candidates are summed component by component in double precision, so that they don't depend on how rows
are dealt. A candidate is passed on unless n others are sure to stand before it by (rounded score, key).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute

#: Vectors that meet the queries at once, and candidates held beyond what is passed on.
AT_ONCE, SPARE = 1_024, 500_000
#: What a product may differ from the sum in order, and a score from the middle between two roundings.
NEAR = 1e-9


def units(vectors: pa.Array, ready: bool = False) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """By width: which vectors have it, and these at length one; and of each vector its width (-1 without a direction). ready: all are at length one."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    width = np.array(vectors.value_lengths().fill_null(-1), np.int64)
    flat = vectors.flatten()
    if flat.null_count:
        at = np.repeat(np.arange(len(width)), np.maximum(width, 0))
        width[at[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
        keep = np.repeat(width >= 0, np.array(vectors.value_lengths().fill_null(0), np.int64))
        flat = flat.filter(pa.array(keep))
    data = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(np.maximum(width, 0))
    out = {}
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        x = data[(ends[rows] - w)[:, None] + np.arange(w)[None, :]]
        if ready:
            out[w] = (rows, x)
            continue
        length = np.zeros(len(x))
        for d in range(w):
            length = length + x[:, d] * x[:, d]
        length = np.sqrt(length)
        none = ~(length > 0) & ~np.isnan(length)
        width[rows[none]] = -1
        with np.errstate(all="ignore"):
            out[w] = (rows[~none], (x / length[:, None])[~none])
    return out, width


class Best:
    """The candidates of queries (id, vector, kind) among the rows (key, vector, kind) met so far."""

    #: Whether vectors come at length one.
    READY = False

    def __init__(self, queries: pa.Table, n: int, may: set | None, digits: int):
        self.n, self.may, self.scale = n, may, 10.0**digits
        queries = queries.combine_chunks()
        self.ids = queries.column(0).combine_chunks()
        self.vectors, _ = units(queries.column(1), self.READY)
        self.kind = queries.column(2).to_numpy()
        # of each query, a rounded score that n rows are sure to reach
        self.least = np.full(len(self.ids), -1.0)
        self.keys: list = []
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.count = 0

    def meet(self, batch: pa.RecordBatch) -> None:
        for at in range(0, batch.num_rows, AT_ONCE):
            self._meet(batch.slice(at, AT_ONCE))

    def _meet(self, part: pa.RecordBatch) -> None:
        vectors, _ = units(part.column(1), self.READY)
        rows, asked = part.num_rows, len(self.ids)
        if not asked:
            return
        score = np.zeros((asked, rows))
        with np.errstate(all="ignore"):
            for w, (i, q) in self.vectors.items():
                if w in vectors:
                    j, x = vectors[w]
                    score[np.ix_(i, j)] = q @ x.T
        score = np.where(np.isnan(score), 1.0, score)
        np.clip(score, 0.0, 1.0, out=score)
        self._forbid(score, part)
        if self.count == 0 and rows > self.n:
            self._raise(np.partition(score, rows - self.n, axis=1)[:, rows - self.n])
        i, j = np.nonzero(score * self.scale >= np.where(self.least < 0, -0.5, self.least - 0.5 - 2 * NEAR * self.scale)[:, None])
        if not len(i):
            return
        base = sum(len(k) for k in self.keys)
        used, at = np.unique(j, return_inverse=True)
        self.keys.append(part.column(0).take(pa.array(used)))
        self.held.append((i, base + at, self._in_order(i, j, vectors)))
        self.count += len(i)
        if self.count > 4 * self.n * asked + SPARE or len(self.held) == 1:
            self._prune()

    def _forbid(self, score: np.ndarray, part: pa.RecordBatch) -> None:
        """Scores below all others for the pairs that may not meet."""
        if self.may is not None:
            mine, a = np.unique(part.column(2).to_numpy(), return_inverse=True)
            theirs, b = np.unique(self.kind, return_inverse=True)
            allowed = np.array([[(int(m), int(t)) in self.may for m in mine] for t in theirs])
            score[~allowed[b][:, a]] = -1.0

    def _raise(self, nth: np.ndarray) -> None:
        self.least = np.maximum(self.least, np.where(nth < 0, -1.0, np.floor(nth * self.scale + 0.5 - NEAR * self.scale)))

    def _in_order(self, i: np.ndarray, j: np.ndarray, vectors: dict) -> np.ndarray:
        """Scores of the pairs, summed in the order of the components."""
        out = np.zeros(len(i))
        for w, (qi, q) in self.vectors.items():
            if w not in vectors:
                continue
            xj, x = vectors[w]
            row, column = np.full(len(self.ids), -1), np.full(int(max(j.max(), xj.max(initial=0))) + 1, -1)
            row[qi], column[xj] = np.arange(len(qi)), np.arange(len(xj))
            both = np.flatnonzero((row[i] >= 0) & (column[j] >= 0))
            for at in range(0, len(both), 65_536):
                some = both[at : at + 65_536]
                a, b = row[i[some]], column[j[some]]
                s = np.zeros(len(some))
                with np.errstate(all="ignore"):
                    for d in range(w):
                        s = s + x[b, d] * q[a, d]
                out[some] = s
        return out

    #: A rounded score below all others.
    NONE = -1.0

    def _shown(self, score: np.ndarray) -> np.ndarray:
        return np.clip(np.where(np.isnan(score), 1.0, score), 0.0, 1.0)

    def _prune(self) -> None:
        i, at, score = (np.concatenate([h[k] for h in self.held]) for k in range(3))
        keys = pa.chunked_array(self.keys).combine_chunks()
        used, at = np.unique(at, return_inverse=True)
        keys = keys.take(pa.array(used))
        place = np.empty(len(keys), np.int64)
        place[pa.compute.sort_indices(keys, null_placement="at_start").to_numpy()] = np.arange(len(keys))
        place = place[at]
        shown = self._shown(score) * self.scale + 0.5
        low, high = np.floor(shown - NEAR * self.scale), np.floor(shown + NEAR * self.scale)
        order = np.lexsort((place, -low, i))
        first = np.flatnonzero(np.append(True, i[order][1:] != i[order][:-1]))
        size = np.diff(np.append(first, len(order)))
        nth = order[first + np.minimum(size, self.n) - 1]
        enough, who = size >= self.n, i[order][first]
        bar, last = np.full(len(self.ids), self.NONE), np.full(len(self.ids), np.iinfo(np.int64).max)
        bar[who[enough]], last[who[enough]] = low[nth[enough]], place[nth[enough]]
        keep = (high > bar[i]) | ((high == bar[i]) & (place <= last[i]))
        self.least = np.maximum(self.least, bar)
        self.held, self.keys, self.count = [(i[keep], at[keep], score[keep])], [keys], int(keep.sum())

    def found(self, names: list[str], key: pa.DataType | None = None) -> pa.Table:
        """(query, key, score) of the candidates; key: the keys' type where no row may have been met."""
        if not self.held:
            return pa.Table.from_arrays([self.ids.slice(0, 0), pa.array([], key or pa.null()), pa.array([], pa.float64())], names=names)
        self._prune()
        i, at, score = self.held[0]
        return pa.Table.from_arrays([self.ids.take(pa.array(i)), self.keys[0].take(pa.array(at)), pa.array(score)], names=names)


class Probes(Best):
    """The candidates of queries (id, vector, kind, cells, least) among the rows (key, vector, kind, cell): a query meets the rows of its
    cells and of its kind only. least: a rounded score that n rows, met elsewhere, reach. Vectors come at length one."""

    READY = True

    def __init__(self, queries: pa.Table, n: int, digits: int):
        super().__init__(queries, n, None, digits)
        asked = queries.column(3).combine_chunks()
        cell = asked.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.probed = np.zeros((len(asked), int(cell.max(initial=-1)) + 2), bool)  # the last column is for all other cells
        self.probed[np.repeat(np.arange(len(asked)), np.array(asked.value_lengths(), np.int64)), cell] = True
        self.probed[:, -1] = False
        least = queries.column(4).fill_null(-1.0).to_numpy()
        self.least = np.where(least < 0, -1.0, np.floor(least * self.scale + 0.5))

    def _meet(self, part: pa.RecordBatch) -> None:
        if self.probed[:, self._cells(part)].any():
            super()._meet(part)

    def _cells(self, part: pa.RecordBatch) -> np.ndarray:
        return np.minimum(part.column(3).to_numpy().astype(np.int64), self.probed.shape[1] - 1)

    def _forbid(self, score: np.ndarray, part: pa.RecordBatch) -> None:
        score[~self.probed[:, self._cells(part)] | (self.kind[:, None] != part.column(2).to_numpy()[None, :])] = -1.0


#: Groups of kinds whose queries and rows meet.
GROUPS = 64


class Kinds:
    """Probes with the queries of each group of kinds, which only rows of the same group meet: the products of others are never made."""

    def __init__(self, queries: pa.Table, n: int, digits: int):
        group = queries.column(2).to_numpy() % GROUPS
        self.none, self.of = queries.slice(0, 0), {g: Probes(queries.filter(pa.array(group == g)), n, digits) for g in np.unique(group).tolist()}

    @property
    def held(self) -> bool:
        return any(p.held for p in self.of.values())

    def meet(self, batch: pa.RecordBatch) -> None:
        group = batch.column(2).to_numpy() % GROUPS
        for g in np.unique(group).tolist():
            if g in self.of:
                self.of[g].meet(batch if (group == g).all() else batch.filter(pa.array(group == g)))

    def found(self, names: list[str], key: pa.DataType | None = None) -> pa.Table:
        tables = [p.found(names, key) for p in self.of.values() if p.held]
        return pa.concat_tables(tables) if tables else Probes(self.none, 1, 0).found(names, key)


class Sums(Best):
    """The candidates of queries, weights (query, term, w), among the rows (key, words) met so far, by sums of w times a term's impact."""

    NONE = -np.inf

    def __init__(self, weights: pa.Table, n: int, digits: int):
        weights = weights.combine_chunks()
        coded = [pa.compute.dictionary_encode(weights.column(k).combine_chunks()) for k in (0, 1)]
        self.ids, self.terms = coded[0].dictionary, coded[1].dictionary
        query, self.term = (c.indices.to_numpy() for c in coded)
        order = np.argsort(self.term, kind="stable")
        self.term, self.query, self.w = self.term[order], query[order], weights.column(2).to_numpy()[order]
        self.n, self.scale, self.least = n, 10.0**digits, np.full(len(self.ids), self.NONE)
        self.keys, self.held, self.count = [], [], 0

    def _shown(self, score: np.ndarray) -> np.ndarray:
        return score

    def meet(self, batch: pa.RecordBatch, impact) -> None:
        for at in range(0, batch.num_rows if len(self.ids) else 0, AT_ONCE // 2):
            self._add(batch.slice(at, AT_ONCE // 2), impact)

    def _add(self, part: pa.RecordBatch, impact) -> None:
        size = np.array(part.column(1).value_lengths().fill_null(0), np.int64)
        of = pa.compute.index_in(part.column(1).flatten(), value_set=self.terms).fill_null(-1).to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(size)), size)
        # a column for each asked term that stands in these texts
        have = np.unique(of[of >= 0])
        if not len(have):
            return
        column = np.searchsorted(have, of[of >= 0])
        tf = np.bincount(row[of >= 0] * len(have) + column, minlength=len(size) * len(have)).reshape(len(size), len(have))
        gives = np.where(tf > 0, impact(tf, size[:, None]), 0.0)
        low, high = np.searchsorted(self.term, have), np.searchsorted(self.term, have, "right")
        many = high - low
        at = np.arange(many.sum()) + np.repeat(low - (np.cumsum(many) - many), many)
        weight, asks = np.zeros((len(have), len(self.ids))), np.zeros((len(have), len(self.ids)), np.float32)
        weight[np.repeat(np.arange(len(have)), many), self.query[at]] = self.w[at]
        asks[np.repeat(np.arange(len(have)), many), self.query[at]] = 1
        score = (gives @ weight).T
        score[((tf > 0).astype(np.float32) @ asks).T == 0] = -np.inf
        i, j = np.nonzero((score > -np.inf) & (score * self.scale >= (self.least - 0.5 - 2 * NEAR * self.scale)[:, None]))
        if not len(i):
            return
        used, at = np.unique(j, return_inverse=True)
        base = sum(len(k) for k in self.keys)
        self.keys.append(part.column(0).take(pa.array(used)))
        self.held.append((i, base + at, score[i, j]))
        self.count += len(i)
        if self.count > 4 * self.n * len(self.ids) + SPARE or len(self.held) == 1:
            self._prune()
