"""Near-duplicates by chosen paths: a set similarity join over shingles of words.

Each of several independent trees deals the documents out by one minwise token of their shingle sets; a node with many
documents is dealt out again by one or two further tokens, 1 / similarity in expectation, so that a pair at the
threshold keeps its chance from level to level. Nodes that are small are compared exhaustively by sketches; a large node
that takes most of the node above it, or is still large after many levels, holds documents that are mostly similar, and
is taken as a whole. What is similar in a sketch joins one candidate group. Within a group the full shingle sets are
compared until every pair is either confirmed, refuted, or known to be connected; groups too large for one task are
compared block by block.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tarn.llm.common import bound_batches, free_name, written
from tarn.llm.components import components

WORDS = 5
#: Minwise tokens of a sketch: the trees' own, one each, and those that nodes below a tree's root choose among, so many at least.
TOKENS, CHOICE = 64, 24
#: Chance that a pair at the threshold meets in a node of some tree, if all nodes are large down to the last level; and that its sketches don't tell.
RECALL, MISSED = 0.95, 5e-8
#: Documents of a node that are compared exhaustively, and levels at most.
LEAF, LEVELS = 1024, 8
#: Part of the node above, in percent, from which on a large node is taken as a whole.
DENSE = 75
#: Shingles that one task compares at most, and sets times shingles: the steps it takes where nothing is connected.
TASK_SHINGLES, TASK_STEPS = 4_000_000, 10_000_000_000
#: Members whose texts tell what a group's boilerplate is, about, and how often a large group is divided by it.
SAMPLE, DIVISIONS = 64, 3

_random = np.random.default_rng(20_240_901)
_BYTE = _random.integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)
_ORDER = _random.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _random.integers(0, 1 << 64, TOKENS, dtype=np.uint64, endpoint=False)
_MULTIPLY = _random.integers(0, 1 << 63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def tree_recall(percent: int, levels: int) -> float:
    """The chance that one tree keeps a pair with this similarity together for so many levels below its root.

    The root's token agrees with the chance of the similarity t. A node chooses one token or, for 1 / t of them on average,
    two, and each agrees with chance t: the pair has one common node below each on average, and whether any is left after
    some levels follows from the chances one level further down.
    """
    t = percent / 100
    two, lost = 1 / t - 1, 0.0
    for _ in range(levels):
        one = 1 - t + t * lost
        lost = (1 - two) * one + two * one * one
    return t * (1 - lost)


def trees_for(recall: float, percent: int, levels: int) -> int:
    """Independent trees so that a pair at the threshold meets in one of them with the chance ``recall``."""
    if not 50 <= percent <= 100 or not 0 < recall < 1:
        raise ValueError("percent is from 50 to 100, and recall between 0 and 1")
    found = tree_recall(percent, levels)
    trees = 1 if found >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - found))
    if trees > TOKENS - CHOICE:
        raise ValueError(f"a recall of {recall} takes {trees} trees; a sketch has tokens for {TOKENS - CHOICE}")
    return trees


def agreeing(percent: int) -> int:
    """Tokens of two sketches that have to agree; of pairs at the threshold fewer do with the chance MISSED at most."""
    t, below, k = percent / 100, 0.0, 0
    while (below := below + math.comb(TOKENS, k) * t**k * (1 - t) ** (TOKENS - k)) <= MISSED:
        k += 1
    return k


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse, at least ``n`` of each."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a UTF-8 text: five words each, or all words if there are fewer.

    Words are runs of anything but ASCII white space, with A-Z in lower case. Without words the set is empty.
    """
    raw = np.frombuffer((text or b"").lower(), dtype=np.uint8)
    turns = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[raw], [True])).view(np.int8)))
    starts, ends = turns[::2], turns[1::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    power, inverse = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * power[: len(raw)], out=sums[1:])
    words = _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    n = min(WORDS, len(words))
    last = len(words) - n + 1
    joined = np.full(last, n, dtype=np.uint64)
    for k in range(n):
        joined += words[k : k + last] * _ORDER[k]
    return np.unique(_mix(joined))


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of TOKENS hash functions over a nonempty set, as 32-bit numbers."""
    least = np.full(TOKENS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(shingles), 4096):
        np.minimum(least, ((shingles[at : at + 4096, None] ^ _XOR) * _MULTIPLY).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def sketches(docs: DataFrame, id_col: str, text_col: str, trees: int) -> DataFrame:
    """id, n_shingles, key (digest of the set; null if it is empty), nodes (one for each tree), sketch (16 bits a token)."""
    bound_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([slim.schema["id"], T.StructField("n_shingles", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("nodes", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])
    arrow = to_arrow_schema(schema)
    tree = np.arange(trees, dtype=np.uint64) << np.uint64(32)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: tuple[list, ...] = ([], [], [], [])
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                own = shingle_set(text)
                if len(own):
                    least = minwise(own)
                    nodes = _mix(least[:trees].astype(np.uint64) + tree).view(np.int64)
                    row = len(own), hashlib.blake2b(own.tobytes(), digest_size=16).digest(), nodes, least.astype("<u2").tobytes()
                else:
                    row = 0, None, None, None
                for c, x in zip(columns, row, strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, arrow[i + 1].type) for i, c in enumerate(columns))], schema=arrow)

    return slim.mapInArrow(sketch, schema)


def runs(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[tuple[tuple, list[list]]]:
    """Groups of consecutive rows that agree in the first ``keys`` columns: their values, and the other columns as lists."""
    now, held = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            if row[:keys] != now:
                if held:
                    yield now, [list(c) for c in zip(*held, strict=True)]
                now, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield now, [list(c) for c in zip(*held, strict=True)]


def _grouped(df: DataFrame, keys: list[str], work: Callable[[tuple, list[list]], Iterator[tuple]], schema: str) -> DataFrame:
    """work(values of keys, other columns) for every group of ``df``, whose groups all fit a task."""
    names = [f.split()[0] for f in schema.split(", ")]
    target = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for values, columns in runs(batches, len(keys)):
            rows.extend(work(values, columns))
            if len(rows) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, arrow[i].type) for i, c in enumerate(zip(*rows, strict=True))], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, arrow[i].type) for i, c in enumerate(zip(*rows, strict=True))], names=names)

    ordered = df.select(*keys, *[c for c in df.columns if c not in keys])
    return ordered.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, target)


def _stars(labels: np.ndarray, names: list) -> Iterator[tuple]:
    """(member, representative) for groups of equal labels with more than one member."""
    order = np.argsort(labels, kind="stable")
    cuts = np.flatnonzero(np.diff(labels[order])) + 1
    for own in np.split(order, cuts):
        first = names[own[0]]
        yield from ((names[i], first) for i in own[1:].tolist())


def similar_sketches(agree: int, _: tuple, columns: list[list]) -> Iterator[tuple]:
    """Compares a node's documents exhaustively by their sketches; links those of a group to one of them."""
    keys, sketch = columns
    tokens = np.frombuffer(b"".join(sketch), dtype="<u2").reshape(len(keys), TOKENS)
    labels = np.arange(len(keys))
    for i in range(len(keys) - 1):
        near = np.flatnonzero((tokens[i + 1 :] == tokens[i]).sum(axis=1) >= agree) + i + 1
        if len(near):
            merged = np.unique(labels[near])
            labels[np.isin(labels, merged)] = labels[i]
    return _stars(labels, keys)


def confirm(sets: list[np.ndarray], labels: np.ndarray, percent: int) -> np.ndarray:
    """Labels after linking all pairs of sets whose similarity is ``percent`` of a hundred or more.

    Pairs with equal labels are known to be connected. The sets most like all the others come first, so that a group
    around one of them is connected early and most pairs need no comparison.
    """
    n = len(sets)
    if n < 2 or (labels == labels[0]).all():
        return labels
    sizes = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    offsets = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    common = np.bincount(flat)
    typical = np.add.reduceat(common[flat], offsets) / sizes
    marked = np.zeros(len(common), dtype=np.int32)
    for p in np.argsort(-typical, kind="stable").tolist():
        others = np.flatnonzero((labels != labels[p]) & (np.minimum(sizes, sizes[p]) * 100 >= np.maximum(sizes, sizes[p]) * percent))
        if not len(others):
            continue
        own = flat[offsets[p] : offsets[p] + sizes[p]]
        marked[own] = 1
        if 4 * sizes[others].sum() < len(flat):
            shared = np.array([marked[flat[offsets[o] : offsets[o] + sizes[o]]].sum() for o in others.tolist()])
        else:
            shared = np.add.reduceat(marked[flat], offsets)[others]
        marked[own] = 0
        linked = others[100 * shared >= percent * (sizes[others] + sizes[p] - shared)]
        if len(linked):
            labels[np.isin(labels, np.unique(labels[linked]))] = labels[p]
            if (labels == labels[0]).all():
                break
    return labels


def _confirm_group(percent: int):
    """Work on a group's (key, text, label): links of keys. A label is null, or known from an earlier round."""

    def work(_: tuple, columns: list[list]) -> Iterator[tuple]:
        keys, texts, known = columns
        first: dict = {}
        labels = np.array([i if k is None else first.setdefault(k, i) for i, k in enumerate(known)])
        return _stars(confirm([shingle_set(t) for t in texts], labels, percent), keys)

    return work


def candidate_links(classes: DataFrame, percent: int, leaf: int = LEAF, levels: int = LEVELS) -> DataFrame:
    """Links (a, b) of sets that may be similar, from the trees: one for each of a set's ``nodes``. ``classes``: key, nodes, sketch of distinct sets; a written table."""
    trees = F.size("nodes")
    nodes = classes.select("key", F.explode("nodes").alias("node"), F.lit(None).cast("long").alias("above"))
    small, whole = [], []
    for level in range(levels + 1):
        # Written, so that the join reads two plain tables and Spark can split the partition of a very large node.
        sizes = written(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
        nodes = written(nodes.join(sizes, "node"), "nodes")
        small.append(nodes.where(F.col("n") <= leaf).select("node", "key"))
        large = nodes.where(F.col("n") > leaf).select("node", "key", "n", "above")
        if large.isEmpty():
            break
        # Sets most of which agree in a further token, or in one at each level: candidates of one another, whatever their number.
        dense = F.coalesce(100 * F.col("n") >= DENSE * F.col("above"), F.lit(False)) | F.lit(level == levels)
        taken = large.where(dense)
        whole.append(taken.join(written(taken.groupBy("node").agg(F.min("key").alias("least")), "least"), "node").select(F.col("key").alias("a"), F.col("least").alias("b")))
        large = large.where(~dense)
        if level == levels:
            break
        # The node's own number chooses: one token, and as many nodes two as it takes. Members of a node choose alike.
        token = lambda salt: trees + F.pmod(F.xxhash64("node", F.lit(salt)), TOKENS - trees).cast("int")
        both = F.pmod(F.xxhash64("node", F.lit(2)), F.lit(percent)) < 100 - percent
        chosen = F.when(both, F.array_distinct(F.array(token(0), token(1)))).otherwise(F.array(token(0)))
        nodes = (
            large.join(classes.select("key", "sketch", "nodes"), "key")
            .withColumn("token", F.explode(chosen))
            .select("key", F.xxhash64("node", "token", F.substring(F.col("sketch"), 2 * F.col("token") + 1, F.lit(2))).alias("node"), F.col("n").alias("above"))
        )
    for_sketches = small[0]
    for more in small[1:]:
        for_sketches = for_sketches.unionByName(more)
    links = _grouped(for_sketches.join(classes.select("key", "sketch"), "key").select("node", "key", "sketch"), ["node"], partial(similar_sketches, agreeing(percent)), "a binary, b binary")
    for more in whole:
        links = links.unionByName(more)
    return links


def confirmed_links(members: DataFrame, percent: int, task_shingles: int = TASK_SHINGLES, depth: int = 0) -> DataFrame:
    """Links (a, b) that connect the truly similar sets of each group. ``members``: group, key, n_shingles, text, label; a written table.

    A group that isn't too large is compared in one task; sets with one ``label`` are known to be connected. A larger group is dealt into blocks first, each compared on its own together with a few members that all blocks get: this
    connects most of what belongs together, over as many tasks as there are blocks. What is still apart is divided by what
    its texts have in common, see ``_divided``, and each division is confirmed like a group, some levels deep. Sets that
    can't be told apart so, and those of the last level, are compared in pairs of blocks.
    """
    # Grouped sides are written, here and below: Spark can then split the partition of a group with very many members.
    weights = written(members.groupBy("group").agg(F.sum("n_shingles").alias("weight"), F.count(F.lit(1)).alias("n")), "weights")
    sized = members.join(weights, "group").withColumn("blocks", _blocks(F.col("weight"), F.col("n"), task_shingles))
    work = _confirm_group(percent)
    links = _grouped(sized.where(F.col("blocks") == 1).select("group", "key", "text", "label"), ["group"], work, "a binary, b binary")
    large = sized.where(F.col("blocks") > 1)
    if large.isEmpty():
        return links
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    shared = F.pmod(F.xxhash64("key", F.lit(7)), F.col("n")) < 8
    dealt = large.withColumn("block", F.explode(F.when(shared, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(block))))
    first = written(_grouped(dealt.select("group", "block", "key", "text", "label"), ["group", "block"], work, "a binary, b binary"), "first")
    links = links.unionByName(first)

    before = large.where("label is not null").select(F.col("key").alias("a"), F.col("label").alias("b"))
    labels = components(first.unionByName(before)).select(F.col("node").alias("key"), F.col("component").alias("label"))
    known = large.drop("label").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    open_ = written(_still_apart(known), "open")
    if open_.isEmpty():
        return links
    if depth == DIVISIONS:
        return links.unionByName(_pairs_of_blocks(open_, work, task_shingles))
    divided, alike = _divided(open_, percent)
    deeper = confirmed_links(divided, percent, task_shingles, depth + 1)
    return links.unionByName(deeper).unionByName(_pairs_of_blocks(alike, work, task_shingles))


def _blocks(weight: Column, n: Column, task_shingles: int) -> Column:
    """1 where one task compares ``n`` sets of so many shingles; else into how many blocks they go, two of which one task compares."""
    steps = weight.cast("double") * n
    one = (weight <= task_shingles) & (steps <= TASK_STEPS)
    return F.when(one, 1).otherwise(F.greatest(F.ceil(2 * weight / F.lit(task_shingles)), F.ceil(F.sqrt(4 * steps / F.lit(float(TASK_STEPS)))))).cast("int")


def _still_apart(known: DataFrame) -> DataFrame:
    """The rows of groups that have more than one label."""
    spread = known.groupBy("group").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return known.join(written(spread.select("group"), "apart"), "group", "left_semi").select("group", "key", "n_shingles", "text", "label")


def _pairs_of_blocks(rows: DataFrame, work: Callable, task_shingles: int) -> DataFrame:
    """Links of each group's members: those outside the largest label's with everything, in pairs of blocks; within that label all is known."""
    parts = written(rows.groupBy("group", "label").agg(F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("part_weight")), "parts")
    largest = parts.groupBy("group").agg(F.max(F.struct("members", "label", "part_weight")).alias("main"), F.sum("part_weight").alias("all"), F.sum("members").alias("n"))
    open_ = rows.join(written(largest.where(F.col("all") > F.col("main.part_weight")), "largest"), "group")
    n_main = _blocks(F.col("main.part_weight"), F.col("main.members"), task_shingles)
    n_rest = _blocks(F.col("all") - F.col("main.part_weight"), F.col("n") - F.col("main.members"), task_shingles)
    in_main = F.col("label") == F.col("main.label")
    own = F.pmod(F.xxhash64("key", F.lit(11)), F.when(in_main, n_main).otherwise(n_rest)).cast("int")
    pair = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    with_main = F.transform(F.sequence(F.lit(0), n_main - 1), lambda i: pair(-1 - i, F.col("own")))
    with_rest = F.transform(F.sequence(F.lit(0), n_rest - 1), lambda j: pair(F.least(j, F.col("own")), F.greatest(j, F.col("own"))))
    for_main = F.transform(F.sequence(F.lit(0), n_rest - 1), lambda j: pair(-1 - F.col("own"), j))
    spread = open_.withColumn("own", own).withColumn("block", F.explode(F.when(in_main, for_main).otherwise(F.concat(with_main, with_rest))))
    return _grouped(spread.select("group", "block.i", "block.j", "key", "text", "label"), ["group", "i", "j"], work, "a binary, b binary")


def _divided(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Divides groups without parting similar sets: (members of the divisions, members that only blocks can compare).

    Take any set of shingles as a group's boilerplate; here what more than half of some of its members have. Sets that share
    a shingle outside of it go into one division. Two that share none have at most the smaller one's boilerplate in common,
    and then a similarity t needs t * size of boilerplate in both, and 2t / (1 + t) * size in one: such sets of a group that
    has one of the latter are left to the blocks. Pages of one template whose own words differ, however many, so need no
    comparison at all.
    """
    boiled = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    sample = rows.join(written(boiled, "counts"), "group").where(F.pmod(F.xxhash64("key", F.lit(13)), F.col("n")) < SAMPLE)
    common = written(_grouped(sample.select("group", "text"), ["group"], _boilerplate, "group binary, boilerplate binary"), "boilerplate")
    schema = T.StructType.fromDDL("group binary, key binary, label binary, n_shingles long, shared long, rare array<long>")
    arrow = to_arrow_schema(schema)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, rare = [], []
            for text, boilerplate in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                own = shingle_set(text)
                in_both = np.isin(own, np.frombuffer(boilerplate or b"", dtype=np.uint64), assume_unique=True)
                shared.append(int(in_both.sum()))
                rare.append(own[~in_both].view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(shared, pa.int64()), pa.array(rare, arrow[5].type)], schema=arrow)

    pieces = written(rows.join(common, "group", "left").select("group", "key", "label", "n_shingles", "text", "boilerplate").mapInArrow(split, schema), "split")
    tokens = pieces.select("group", "key", F.explode("rare").alias("shingle"))
    nodes = written(tokens.groupBy("group", "shingle").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "shingles")
    stars = tokens.join(nodes, ["group", "shingle"]).where("key <> least").select(F.col("key").alias("a"), F.col("least").alias("b")).distinct()
    division = components(stars).select(F.col("node").alias("key"), F.col("component").alias("division"))
    placed = rows.join(division, "key").select(F.col("division").alias("group"), "key", "n_shingles", "text", "label")
    heavy = F.col("shared") * (100 + percent) >= 2 * percent * F.col("n_shingles")
    with_heavy = written(pieces.where(heavy).select("group").distinct(), "heavy")
    alike = pieces.where(100 * F.col("shared") >= percent * F.col("n_shingles")).join(with_heavy, "group", "left_semi").select("key")
    return written(_still_apart(placed), "divided"), written(_still_apart(rows.join(alike, "key", "left_semi")), "alike")


def _boilerplate(values: tuple, columns: list[list]) -> Iterator[tuple]:
    """The shingles that more than half of a group's texts have, sorted, as bytes."""
    found, counts = np.unique(np.concatenate([shingle_set(t) for t in columns[0]]), return_counts=True)
    yield values[0], found[2 * counts > len(columns[0])].tobytes()


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF, task_shingles: int = TASK_SHINGLES, recall: float = RECALL) -> DataFrame:
    """Each row's id, n_shingles, component_id and kept.

    Rows are linked if 100 * intersection >= percent * union for their sets of shingles; rows with equal sets always
    are. component_id is the smallest id that can be reached through links, the row's own included; kept tells whether
    it is the row's own. An empty set (null or empty text, white space) is linked with nothing. Rows that repeat are
    linked and kept alike. Null ids are larger than any other: a component has one only if all its ids are null, and its
    rows are kept. An empty table gives no rows. Further columns of the input play no part. Of pairs at the threshold at
    least ``recall`` are found where every node is large down to the last level; pairs that are more alike, or in corpora
    whose trees have fewer levels, are found more often. percent is from 50 to 100. A very long text counts with all its shingles; a task holds the text and eight bytes for each of its characters and shingles while it hashes them.
    """
    rows = written(sketches(docs, id_col, text_col, trees_for(recall, percent, LEVELS)), "sketches")
    sets = rows.where("key is not null")
    classes = written(sets.groupBy("key").agg(F.min(F.struct(F.col("id").isNull(), "id", "n_shingles", "nodes", "sketch")).alias("one")).select("key", "one.id", "one.n_shingles", "one.nodes", "one.sketch"), "classes")
    groups = components(candidate_links(classes, percent, leaf)).select(F.col("node").alias("key"), F.col("component").alias("group"))
    grouped = classes.join(groups, "key").select("id", "key", "group", "n_shingles")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    members = _own_texts(texts.join(grouped, texts["id"].eqNullSafe(grouped["id"])).select("group", "key", "n_shingles", "text")).withColumn("label", F.lit(None).cast("binary"))
    parts = components(confirmed_links(members, percent, task_shingles))
    placed = rows.join(parts.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = written(placed.where("component is not null").groupBy("component").agg(F.min("id").alias("component_id")), "least")
    found = placed.join(least, "component", "left").withColumn("component_id", F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _own_texts(rows: DataFrame) -> DataFrame:
    """One row for each key: of those found by id, which may repeat, one whose text has that set."""
    schema = rows.schema
    arrow = to_arrow_schema(schema)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(1).to_pylist(), batch.column(3).to_pylist()
            same = [hashlib.blake2b(shingle_set(t).tobytes(), digest_size=16).digest() == k for k, t in zip(keys, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(same)) for c in batch.columns], schema=arrow)

    return written(rows.mapInArrow(check, schema).dropDuplicates(["key"]), "members")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that another one of their component stands for. Ids name documents here: they don't repeat.

    Rows are treated as in ``near_duplicates``: null and empty texts stay, of ties the smallest id. All columns stay.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col)
    name = free_name(docs.columns, "_gone")
    gone = written(found.where("not kept").select(F.col(id_col).alias(name)).distinct(), "gone")
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")


def op3_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Near-duplicates among all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, CAST(len(w) - 3 AS BIGINT)), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s
  FROM d),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 75 * (na.n_shingles + nb.n_shingles - i)),
r(doc_id, to_id) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.to_id = l.a)
SELECT n.doc_id, n_shingles, c.component_id, n.doc_id = c.component_id AS kept
FROM n JOIN (SELECT doc_id, min(to_id) AS component_id FROM r GROUP BY 1) c USING (doc_id)
"""
