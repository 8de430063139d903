"""Merkle manifest of a dataset: roots, a proof for each row, and the check of a proof.

A row's leaf hashes its columns, a null as `-`, else byte count, `:` and value. Leaves of a group ascend
by key (then by leaf); every ARITY neighbouring nodes become their parent until one is left, the group's
subroot; subroots, ordered by group with null first, become the root in the same way.

A partition holds a forest: the nodes whose run of siblings is not yet whole, by (tree, level, index).
Forests add up: their union, in which each whole run gives way to its parent as often as it can. That
is associative, and since the number of leaves of each tree is known the last run of a level, which may
be short, is known to be whole as well. A tree that has come down to one node becomes a leaf of the tree
over the groups, so that one sum of all forests ends in the root.

Scale: text is hashed in one map. Digests are dealt by ranges of (group, key, leaf) and packed into
blocks of BLOCK leaves; a block's forest is at most two edges of ARITY - 1 nodes a level. Forests are
summed FAN at a time, as by treeReduce, each round a written table, so that a lost executor costs a task
and the runs completed on the way stay on the cluster. A block then asks for the runs above its edges and gives
its rows' proofs. One task sees a row for each partition (the count of groups begun), none sees more.

Defined results: any column may be null, the group and the key included (null first); equal rows are
leaves of their own; an empty table gives no rows; a group of one leaf is its own subroot, one group's
subroot is the root; other columns take no part.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.blocks import join_parts, split_parts
from millrace.llm.core import dropped, lower_az, stored

ARITY = 8
#: Leaves of a block, forests summed by one task, rows given at once.
BLOCK, FAN, GIVEN = 65_536, 16, 4_096
#: The tree over the groups' subroots; group number k has tree k.
TOP = -1

Node = tuple[int, int, int]  # tree, level, index
Run = tuple[int, int, int]  # tree, level, index of the parent


def digest(*columns: Column) -> Column:
    """Lowercase hex of the SHA-256 of the columns, a null as `-`, else UTF-8 byte count, `:`, value."""
    said = [F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")) for c in columns]
    return F.sha2(F.concat(*(F.coalesce(x, F.lit("-")) for x in said)), 256)


def parent(children: list[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def width(leaves: int, level: int) -> int:
    """Nodes of a level of a tree."""
    return -(-leaves // ARITY**level)


def settle(nodes: dict[Node, str], leaves: dict[int, int]) -> dict[Run, list[str]]:
    """Replaces each whole run of a forest by its parent until none is left; gives the runs."""
    runs: dict[Run, list[str]] = {}
    todo = {(t, lv, i // ARITY) for t, lv, i in nodes}
    while todo:
        t, lv, r = todo.pop()
        many = width(leaves[t], lv)
        if many == 1:
            if t != TOP and (t, lv, 0) in nodes:
                nodes[TOP, 0, t] = nodes.pop((t, lv, 0))
                todo.add((TOP, 0, t // ARITY))
            continue
        named = [(t, lv, i) for i in range(r * ARITY, min(many, (r + 1) * ARITY))]
        if all(n in nodes for n in named):
            runs[t, lv, r] = [nodes.pop(n) for n in named]
            nodes[t, lv + 1, r] = parent(runs[t, lv, r])
            todo.add((t, lv + 1, r // ARITY))
    return runs


def above(node: Node, leaves: dict[int, int]) -> Iterator[tuple[Run, int]]:
    """The runs from a node up to the root, and its or its ancestor's place in each."""
    t, lv, i = node
    while True:
        if width(leaves[t], lv) == 1:
            if t == TOP:
                return
            t, lv, i = TOP, 0, t
        else:
            yield (t, lv, i // ARITY), i % ARITY
            lv, i = lv + 1, i // ARITY


def packed_blocks(leaves: DataFrame) -> DataFrame:
    """Sorted (g, k, leaf, found) -> (part, seq, data, n_groups, edges: the first and the last group with their leaves here)."""
    shape = "part int, seq int, data binary, n_groups long, edges array<struct<g: string, n: long>>"
    edges = pa.list_(pa.struct([("g", pa.string()), ("n", pa.int64())]))

    def block(seq: int, rows: pa.Table) -> pa.RecordBatch:
        groups = rows.column("g").combine_chunks()
        ends = pa.compute.run_end_encode(groups)
        names, counts = ends.values.to_pylist(), np.diff(ends.run_ends.to_numpy(), prepend=0).tolist()
        of = list(zip(names, counts, strict=True))
        key = rows.column("k")
        found = rows.column("found")
        data = join_parts([json.dumps(of).encode(), key.fill_null(0).to_numpy().astype("<i8").tobytes(), np.packbits(key.is_null().to_numpy()).tobytes(), b"".join(rows.column("leaf").to_pylist()), np.packbits(found.is_valid().to_numpy()).tobytes(), b"".join(found.drop_null().to_pylist())])
        edge = [{"g": g, "n": n} for g, n in (of[:1] if len(of) == 1 else [of[0], of[-1]])]
        return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([seq], pa.int32()), pa.array([data], pa.binary()), pa.array([len(of)], pa.int64()), pa.array([edge], edges)], names=["part", "seq", "data", "n_groups", "edges"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = seq = 0
        for batch in batches:
            while batch.num_rows:
                some = batch.slice(0, BLOCK - n)
                batch = batch.slice(some.num_rows)
                held.append(some)
                n += some.num_rows
                if n == BLOCK:
                    yield block(seq, pa.Table.from_batches(held))
                    held, n, seq = [], 0, seq + 1
        if held:
            yield block(seq, pa.Table.from_batches(held))

    return leaves.select("g", "k", "leaf", "found").mapInArrow(work, shape)


class Block:
    """The leaves of a block, and where they stand: number of the first group, its leaves before, leaves of the first and last."""

    def __init__(self, data: bytes, number: int, before: int, first: int, last: int, trees: int):
        of, key, nulls, leaf, seen, found = split_parts(data)
        self.groups = json.loads(of)
        self.key = np.frombuffer(key, "<i8")
        n = len(self.key)
        self.no_key = np.unpackbits(np.frombuffer(nulls, np.uint8), count=n).astype(bool)
        hexed = leaf.hex()
        self.leaf = [hexed[i : i + 64] for i in range(0, len(hexed), 64)]
        hexed = found.hex()
        others = iter([hexed[i : i + 64] for i in range(0, len(hexed), 64)])
        self.found = [next(others) if s else x for s, x in zip(np.unpackbits(np.frombuffer(seen, np.uint8), count=n), self.leaf, strict=True)]
        self.count = {TOP: trees}
        self.node: list[Node] = []
        for k, (_, many) in enumerate(self.groups):
            start = before if k == 0 else 0
            self.count[number + k] = first if k == 0 else last if k == len(self.groups) - 1 else many
            self.node += [(number + k, 0, start + i) for i in range(many)]

    def forest(self) -> tuple[dict[Node, str], dict[Run, list[str]]]:
        nodes = dict(zip(self.node, self.leaf, strict=True))
        return nodes, settle(nodes, self.count)


def forest_bytes(nodes: dict[Node, str], leaves: dict[int, int]) -> bytes:
    held = {t: leaves[t] for t in {TOP, *(n[0] for n in nodes)}}
    return json.dumps([list(held.items()), [[*n, h] for n, h in nodes.items()]]).encode()


def from_forest_bytes(data: bytes) -> tuple[dict[Node, str], dict[int, int]]:
    held, nodes = json.loads(data)
    return {(t, lv, i): h for t, lv, i, h in nodes}, dict(map(tuple, held))


def places(blocks: DataFrame) -> DataFrame:
    """(part, seq, number, before, first, last, trees) of each block; see Block."""
    edge = blocks.select("part", "seq", "n_groups", F.posexplode("edges").alias("e", "x")).select("part", "seq", "n_groups", "e", "x.g", "x.n")
    same = Window.partitionBy("g")
    edge = edge.withColumn("all", F.sum("n").over(same)).withColumn("upto", F.sum("n").over(same.orderBy("part", "seq")) - F.col("n"))
    one = edge.groupBy("part", "seq").agg(F.max("n_groups").alias("n_groups"), F.min_by("upto", "e").alias("before"), F.min_by("all", "e").alias("first"), F.max_by("all", "e").alias("last"))
    one = one.withColumn("begun", F.col("n_groups") - (F.col("before") > 0).cast("long"))
    # one row for each partition
    parts = one.groupBy("part").agg(F.sum("begun").alias("here"))
    whole = Window.orderBy("part")
    parts = parts.select(F.col("part").alias("p"), (F.sum("here").over(whole) - F.col("here")).alias("earlier"), F.sum("here").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("trees"))
    within = F.sum("begun").over(Window.partitionBy("part").orderBy("seq")) - F.col("begun")
    number = F.col("earlier") + F.col("within") - (F.col("before") > 0).cast("long")
    return one.withColumn("within", within).join(parts, F.col("part") == F.col("p")).select("part", "seq", number.alias("number"), "before", "first", "last", "trees")


_PLACE = ["data", "number", "before", "first", "last", "trees"]
_RUN = "tree long, level int, run long"


def forests(blocks: DataFrame) -> DataFrame:
    """Placed blocks -> (part, seq, nodes, asks: the runs above its edges)."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for part, seq, *place in f[["part", "seq", *_PLACE]].itertuples(index=False):
                b = Block(*place)
                nodes, _ = b.forest()
                asks = sorted({run for n in nodes for run, _ in above(n, b.count)})
                yield pd.DataFrame({"part": [part], "seq": [seq], "nodes": [forest_bytes(nodes, b.count)], "asks": [[dict(zip(("tree", "level", "run"), a, strict=True)) for a in asks]]})

    return blocks.mapInPandas(work, "part int, seq int, nodes binary, asks array<struct<tree: long, level: int, run: long>>")


def summed(rows: DataFrame, group: Column) -> DataFrame:
    """Sums the forests (part, nodes) of a group: one row with its part and nodes, and one for each run completed."""

    def work(f: pd.DataFrame) -> pd.DataFrame:
        nodes: dict[Node, str] = {}
        leaves: dict[int, int] = {}
        for data in f["nodes"]:
            n, c = from_forest_bytes(data)
            nodes.update(n)
            leaves.update(c)
        runs = settle(nodes, leaves)
        made = [(int(f["to"].iloc[0]), forest_bytes(nodes, leaves), None, None, None, None)]
        made += [(None, None, *run, "".join(children)) for run, children in runs.items()]
        return pd.DataFrame(made, columns=["part", "nodes", "tree", "level", "run", "children"]).astype({"part": "Int32", "tree": "Int64", "level": "Int32", "run": "Int64"})

    return rows.select(group.alias("to"), "nodes").groupBy("to").applyInPandas(work, f"part int, nodes binary, {_RUN}, children string")


def completed(forest: DataFrame) -> list[DataFrame]:
    """The runs (tree, level, run, children) that sums of forests complete, a table for each round."""
    last = forest.agg(F.max("part"), F.max("seq")).first()
    if last[0] is None:
        return []
    parts, several = last[0] + 1, last[1] > 0
    out = []
    rows = forest.select("part", "nodes")
    while parts > 1 or several:
        fan = 1 if several else FAN
        done = stored(summed(rows, F.floor(F.col("part") / fan).cast("int")), "forests")
        out.append(done)
        rows = done.where("nodes is not null").select("part", "nodes")
        parts, several = -(-parts // fan), False
    return out


def proved(blocks: DataFrame, shape: str) -> DataFrame:
    """Placed blocks with the runs above their edges (got) -> a row for each leaf."""

    def given(b: Block, runs: dict[Run, list[str]], root: str, at: int) -> pa.RecordBatch:
        siblings: dict[Node, tuple[list[str], list[str]]] = {}

        def path(node: Node) -> tuple[list[str], list[str]]:
            before, after = [], []
            for run, i in above(node, b.count):
                children = runs[run]
                before.append("".join(children[:i]))
                after.append("".join(children[i + 1 :]))
            return before, after

        before, after, size, subroot = [], [], [], []
        some = slice(at, at + GIVEN)
        for t, _, i in b.node[some]:
            upper = (t, 1, i // ARITY) if b.count[t] > 1 else (TOP, 0, t)
            if upper not in siblings:
                siblings[upper] = path(upper)
            x, y = siblings[upper]
            if b.count[t] > 1:
                children = runs[t, 0, i // ARITY]
                before.append("".join(children[: i % ARITY]))
                after.append("".join(children[i % ARITY + 1 :]))
            before += x
            after += y
            size.append(len(x) + (b.count[t] > 1))
            subroot.append(b.subroot[t])
        proof = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], names=["before", "after"]))
        n = len(size)
        groups = b.name[some]
        return pa.RecordBatch.from_arrays([pa.array(b.key[some], mask=b.no_key[some]), pa.array(groups, pa.string()), pa.array(b.leaf[some]), pa.array(b.found[some]), pa.array(subroot, pa.string()), pa.array([root] * n, pa.string()), proof], names=["k", "g", "leaf", "found", "subroot", "root", "proof"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(*(row[c] for c in _PLACE))
                nodes, runs = b.forest()
                runs |= {(r["tree"], r["level"], r["run"]): [r["children"][i : i + 64] for i in range(0, len(r["children"]), 64)] for r in row["got"] or []}
                top = lambda t: (t, next(lv for lv in range(64) if width(b.count[t], lv) == 1) - 1, 0)  # noqa: B023, E731
                held = {t: parent(runs[top(t)]) if b.count[t] > 1 else None for t in b.count}
                b.subroot = {}
                b.name = []
                for (t, _, _), x in zip(b.node, b.leaf, strict=True):
                    b.subroot.setdefault(t, held[t] or x)
                for g, many in b.groups:
                    b.name += [g] * many
                root = held[TOP] or b.subroot[0]
                for at in range(0, len(b.node), GIVEN):
                    yield given(b, runs, root, at)

    return blocks.mapInArrow(work, shape)


def manifest(docs: DataFrame, columns: list[str], key: str = "doc_id", group: str = "lang", found: Column | None = None) -> DataFrame:
    """(k, g, leaf, found, subroot, root, proof array<struct<before, after>>) of every row of docs.

    found is a digest that each row is to be checked by, the leaf itself where it is null. proof has, level by
    level via the subroot to the root, the siblings before and after, joined.
    """
    leaf = digest(*(F.col(c) for c in columns))
    other = F.lit(None).cast("string") if found is None else found
    rows = stored(docs.select(F.col(group).cast("string").alias("g"), F.col(key).cast("long").alias("k"), F.unhex(leaf).alias("leaf"), F.unhex(other).alias("found")), "leaves")
    order = ["g", "k", "leaf"]
    # equal rows are dealt by their place in the table
    dealt = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*order, "salt").sortWithinPartitions(*order)
    blocks = stored(packed_blocks(dealt), "leaf-blocks")
    dropped(rows)
    at = stored(places(blocks), "places")
    placed = blocks.select("part", "seq", "data").join(at, ["part", "seq"])
    forest = stored(forests(placed), "forests")
    rounds = completed(forest)
    got = placed.withColumn("got", F.lit(None).cast("array<struct<tree: long, level: int, run: long, children: string>>"))
    if rounds:
        runs = rounds[0]
        for r in rounds[1:]:
            runs = runs.unionByName(r)
        runs = runs.where("run is not null").select("tree", "level", "run", "children")
        asks = forest.select("part", "seq", F.explode("asks").alias("a")).select("part", "seq", "a.*")
        answers = asks.join(runs, ["tree", "level", "run"]).groupBy("part", "seq").agg(F.collect_list(F.struct("tree", "level", "run", "children")).alias("got"))
        got = placed.join(answers, ["part", "seq"], "left")
    return proved(got.select(*_PLACE, "got"), "k long, g string, leaf string, found string, subroot string, root string, proof array<struct<before: string, after: string>>")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def checked(docs: DataFrame, tampered: Callable[[Column], Column]) -> DataFrame:
    """The manifest of documents, checked against texts that `tampered` has changed where 3 divides the id's CRC-32."""
    changed = [tampered(F.col(c)) if c == "text" else F.col(c) for c in COLUMNS]
    hit = F.crc32(F.col("doc_id").cast("long").cast("string")) % 3 == 0
    m = manifest(docs, COLUMNS, found=F.when(hit, digest(*changed)))
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["before"], s["after"])), "")
    out = m.select(F.col("k").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.col("found"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(spark.read.parquet(f"{sf_dir}/documents.parquet"), lower_az)


#: Levels that the SQL spells out: trees of up to ARITY ** LEVELS leaves.
LEVELS = 6


def merkle_sql() -> str:
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    said = lambda text: " || ".join(field(text if c == "text" else c) for c in COLUMNS)
    crc = "xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT), lambda a, x: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda b, i: xor(b >> 1, 3988292384 * (b & 1)), xor(a, x)), 4294967295::BIGINT), 4294967295)"
    az = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = f"""WITH d AS (SELECT doc_id, lang, sha256({said("text")}) AS leaf, CASE WHEN {crc} % 3 = 0 THEN sha256({said(az)}) END AS other FROM documents),
q0 AS (SELECT doc_id, leaf, lang AS lang_, NULL AS subroot, lang AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h, '' AS proof, coalesce(other, leaf) AS fold FROM d)"""
    # a node stands for itself once its tree has one
    step = """,
c{n} AS (SELECT g, i, h, count(*) OVER (PARTITION BY g) AS many FROM (SELECT DISTINCT g, i, h FROM {rows})),
s{n} AS (SELECT g, i, many, coalesce(string_agg(h, '') OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, coalesce(string_agg(h, '') OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a, h FROM c{n}),
{made} AS (SELECT p.doc_id, p.leaf, p.lang_, p.subroot, s.g, s.i // 8 AS i, CASE WHEN many = 1 THEN s.h ELSE sha256(b || s.h || a) END AS h, proof || b || a AS proof, CASE WHEN many = 1 THEN fold ELSE sha256(b || fold || a) END AS fold FROM {rows} p JOIN s{n} s ON p.g IS NOT DISTINCT FROM s.g AND p.i = s.i)"""
    rows = "q0"
    for n in range(1, LEVELS + 1):
        out += step.format(n=n, rows=rows, made=f"q{n}")
        rows = f"q{n}"
    out += f",\nk AS (SELECT lang_, row_number() OVER (ORDER BY lang_ NULLS FIRST) - 1 AS no FROM (SELECT DISTINCT lang_ FROM {rows})),\nr0 AS (SELECT doc_id, leaf, r.lang_, h AS subroot, 'all' AS g, no AS i, h, proof, fold FROM {rows} r JOIN k ON r.lang_ IS NOT DISTINCT FROM k.lang_)"
    rows = "r0"
    for n in range(LEVELS + 1, LEVELS + 3):
        out += step.format(n=n, rows=rows, made=f"r{n}")
        rows = f"r{n}"
    return out + f"\nSELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = h AS verified FROM {rows}"
