"""Near-duplicate documents by MinHash with tensored banding, every link confirmed on whole shingle sets.

A document's set holds its distinct ``width``-word shingles.  Two small collections of ``HALVES``
half-signatures are computed, each half of two minhashes.  A table key is a pair (half i of the first
collection, half j of the second), so 2 x 10 halves (40 minhashes) serve 100 tables, where plain
banding of the same width would compute 400.  At the threshold similarity of 0.8 a pair of
documents meets in no table with probability 7e-5, at 0.9 with 1e-7.

Nothing emits all pairs of a group:

* equal sets are folded to one node before any key is made;
* the buckets of a tenth of the tables link their members to the least one (a star), and each different
  pair is tested once; in the buckets of the other tables only one member of each group found so far is
  linked, which costs next to nothing where a bucket holds one group;
* pairs that cannot be near (fewer than 16 of 40 minhashes agree; a pair at 0.8 gets there with
  probability 1 - 1e-8) go before texts are read;
* the rest is tested on the whole sets, rebuilt from the texts, leader by leader as a stream;
* groups of likely partners whose nodes then carry more than one component are tested to the end,
  as pairs of small blocks of nodes, of which only links that join components come out; nodes of a large group's most
  frequent component meet the others alone.

A node is a set, not an id: rows that share an id but hold different sets are different nodes, rows without an id have
nodes like all others, and minhashes and text of a node come from one row, the first of the set by id and digest of the text.

Defined results: a null or wordless text has 0 shingles and stays alone.  Equal sets are linked
whatever their texts.  Repeated rows of a document are all returned.  A component is named by its
least id, so components of different texts under one least id have one name.  A row with a null id links
texts like any other; its own ``component_id`` and ``kept`` are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorgrid.llm.common import id_and_text, map_batches, text_buffer
from sensorgrid.llm.words import WordHasher, mixed
from sensorgrid.session import stored

HALVES = 10
MINHASHES = 4 * HALVES
#: The tables and the number below are chosen for this similarity; pairs at a lower one would be lost.
LEAST_PERCENT = 80
#: Of 40 minhashes so many must agree before texts are compared.
LEAST_EQUAL = 16
#: Members that one task tests against a leader; a larger star is split.
STAR_ROWS = 256
#: Nodes of a block, on average, where texts are compared and where minhashes are.
TEXT_BLOCK, SIGNATURE_BLOCK = 192, 4096
#: Links that a task joins at a time.
FOREST_LINKS = 1 << 19
#: Tables of which each half serves one, and the others.
FIRST_TABLES = np.arange(HALVES) * (HALVES + 1)
OTHER_TABLES = np.setdiff1d(np.arange(HALVES * HALVES), FIRST_TABLES)

_SEEDS = mixed(np.arange(1, 2 * MINHASHES + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
_MASKS, _FACTORS = _SEEDS[:MINHASHES], _SEEDS[MINHASHES:] | np.uint64(1)


class Shingler:
    """Sorted distinct shingle hashes of texts."""

    def __init__(self, width: int):
        self.width, self.hasher = width, WordHasher()

    def sets(self, column: pa.Array) -> list[np.ndarray]:
        data, offsets = text_buffer(column)
        words, _, text = self.hasher.words(data, offsets)
        n = len(offsets) - 1
        bounds = np.searchsorted(text, np.arange(n + 1))
        whole, size = words, len(words)
        if size >= self.width:
            joined = np.zeros(size - self.width + 1, np.uint64)
            for k in range(self.width):
                joined = mixed(joined * np.uint64(0xD6E8FEB86659FD93) + whole[k:k + len(joined)])
        out = []
        for i in range(n):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= self.width:
                out.append(np.unique(joined[a:b - self.width + 1]))
            elif b > a:
                short = np.zeros(1, np.uint64)
                for k in range(a, b):
                    short = mixed(short * np.uint64(0xD6E8FEB86659FD93) + whole[k:k + 1])
                out.append(short ^ np.uint64(b - a))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """32-bit minhashes, one row for each (nonempty) set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), MINHASHES), np.uint32)
    for k in range(MINHASHES):
        out[:, k] = mixed(np.minimum.reduceat((flat ^ _MASKS[k]) * _FACTORS[k], starts)).astype(np.uint32)
    return out


def table_keys(signatures: np.ndarray) -> np.ndarray:
    """48-bit keys of the HALVES x HALVES tables for each row of minhashes."""
    s = signatures.astype(np.uint64).reshape(len(signatures), 2, HALVES, 2)
    halves = mixed((s[..., 0] << np.uint64(32)) | s[..., 1])
    table = np.arange(1, HALVES * HALVES + 1, dtype=np.uint64).reshape(1, HALVES, HALVES)
    keys = mixed(halves[:, 0, :, None] + mixed(halves[:, 1, None, :] + table))
    return (keys >> np.uint64(16)).astype(np.int64).reshape(len(signatures), -1)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """``(doc_id, digest, n_shingles, set_a, set_b, minhashes)`` of ``(doc_id, text, digest)``.

    The set hashes and minhashes of an empty set are null.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            sets = shingler.sets(batch.column(1))
            full = [s for s in sets if len(s)]
            rows = minhashes(full) if full else np.zeros((0, MINHASHES), np.uint32)
            at = iter(range(len(full)))
            index = [next(at) if len(s) else None for s in sets]
            a = [int(s.sum(dtype=np.uint64).astype(np.int64)) if len(s) else None for s in sets]
            b = [int(mixed(s ^ np.uint64(len(s))).sum(dtype=np.uint64).astype(np.int64)) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                pa.array([None if i is None else rows[i].tobytes() for i in index], pa.binary())],
                names=["doc_id", "digest", "n_shingles", "set_a", "set_b", "minhashes"])

    return map_batches(docs, sign, "doc_id bigint, digest binary, n_shingles bigint, set_a bigint, set_b bigint, minhashes binary")


def keyed(nodes: DataFrame, tables: np.ndarray) -> DataFrame:
    """``(key, node)`` for each of ``tables`` and every node."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, MINHASHES)
                keys = table_keys(rows)[:, tables]
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), keys.shape[1]))],
                    names=["key", "node"])

    return map_batches(nodes.select("node", "minhashes"), spread, "key bigint, node bigint")


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of which enough minhashes agree."""

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(-1, MINHASHES) for k in (2, 3))
                keep = pa.array((a == b).sum(axis=1) >= LEAST_EQUAL)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    sides = nodes.select("node", "minhashes")
    both = (
        pairs.join(sides.withColumnsRenamed({"node": "a", "minhashes": "sig_a"}), "a")
        .join(sides.withColumnsRenamed({"node": "b", "minhashes": "sig_b"}), "b").select("a", "b", "sig_a", "sig_b")
    )
    return map_batches(both, agree, "a bigint, b bigint")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs with 100 x intersection >= percent x union, on the whole sets of ``texts`` (node, text)."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, leader, own = Shingler(width), None, np.zeros(0, np.uint64)
        for batch in batches:
            sets, left, right = shingler.sets(batch.column(3)), [], []
            for a, kind, b, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), sets):
                if kind == 0:
                    leader, own = a, members
                elif leader == a and len(own):
                    at = np.minimum(np.searchsorted(own, members), len(own) - 1)
                    common = int(np.count_nonzero(own[at] == members))
                    if common and 100 * common >= percent * (len(own) + len(members) - common):
                        left.append(a)
                        right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    stars = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(STAR_ROWS)).cast("int").alias("parts"))
    members = pairs.join(stars, "a").select(
        F.col("b").alias("node"), "a", F.expr("pmod(xxhash64(b), parts)").cast("int").alias("part"), F.lit(1).alias("kind"))
    leaders = stars.select(
        F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"))
    rows = leaders.unionAll(members).join(texts, "node").select("a", "part", "kind", F.col("node").alias("b"), "text")
    wide = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(wide, "a", "part").sortWithinPartitions("a", "part", "kind", "b")
    return map_batches(ordered.select("a", "kind", "b", "text"), test, "a bigint, b bigint")


def bucket_members(keys: DataFrame) -> DataFrame:
    """``(key, node, n, least)`` in buckets of two or more nodes, of which ``least`` is the first."""
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).filter("n > 1")
    return keys.join(sizes, "key").select("key", "node", "n", "least")


def member_stars(members: DataFrame) -> DataFrame:
    """``stars`` of the rows of ``bucket_members``, which know their least node."""
    return members.filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()


def stars(members: DataFrame) -> DataFrame:
    """Different pairs ``(a, b)`` of a bucket's least node and each other one."""
    leaders = members.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("last")).filter("a < last")
    return members.join(leaders, "key").filter("node <> a").select("a", F.col("node").alias("b")).distinct()


def labelled(rows: DataFrame, components_: DataFrame) -> DataFrame:
    """``rows`` with the component of their node as ``label``; a node without one is its own."""
    return rows.join(components_, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")


def blocked(named: DataFrame, sizes: DataFrame, payload: DataFrame, column: str, block: int) -> DataFrame:
    """Rows ``(grp, i, j, side, node, label, column)``, each pair (i, j) of blocks of a group in one task and in a row.

    ``named`` has ``(grp, node, label)``, ``sizes`` the groups wanted with their number ``n`` of nodes and the most
    frequent label ``main`` with its number ``n_main``.  In a group of more than one block the nodes of ``main`` form
    blocks of their own, which meet the other blocks only.  A node is sent to as many pieces of work as it meets blocks.
    """
    split, rest = F.col("n") > block, F.col("n") - F.col("n_main")
    blocks = sizes.select(
        "grp", F.when(split, F.col("main")).alias("main"),
        F.ceil(F.when(split, rest).otherwise(F.col("n")) / F.lit(block)).cast("int").alias("blocks"),
        F.ceil(F.when(split, F.col("n_main")).otherwise(F.lit(0)) / F.lit(block)).cast("int").alias("main_blocks"))
    cells = (
        named.join(blocks, "grp").withColumn("of_main", F.coalesce(F.col("label") == F.col("main"), F.lit(False)))
        .withColumn("own", F.expr("IF(of_main, blocks + pmod(xxhash64(node), main_blocks), pmod(xxhash64(node), blocks))").cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, IF(of_main, blocks, blocks + main_blocks) - 1)")))
        .select("grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "label")
    )
    wide = int(named.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        cells.join(payload, "node").repartition(wide, "grp", "i", "j").sortWithinPartitions("grp", "i", "j", "side", "node")
        .select("grp", "i", "j", "side", "node", "label", column)
    )


def open_sizes(named: DataFrame) -> DataFrame:
    """``(grp, n, main, n_main)`` of the groups of more than two nodes that carry more than one label."""
    return (
        named.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("n_label"))
        .groupBy("grp").agg(F.count(F.lit(1)).alias("labels"), F.sum("n_label").alias("n"),
                            F.max_by("label", "n_label").alias("main"), F.max("n_label").alias("n_main"))
        .filter("labels > 1 AND n > 2").select("grp", "n", "main", "n_main")
    )


def tested_blocks(rows: DataFrame, values, links) -> DataFrame:
    """Pairs ``(a, b)`` that ``links`` finds in each piece of work; ``values`` reads a batch's last column."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, here, met = values(), None, []
        for batch in batches:
            cell = [batch.column(k).to_pylist() for k in range(6)]
            for group, i, j, side, node, label, value in zip(*cell, read(batch.column(6))):
                if here != (group, i, j):
                    yield pairs_batch(links(met))
                    here, met = (group, i, j), []
                met.append((side, node, label, value))
        yield pairs_batch(links(met))

    return map_batches(rows, test, "a bigint, b bigint")


def pairs_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])


def facing(rows: list[tuple]) -> Iterator[tuple[int, slice]]:
    """Each row with the rows it has to meet: those of the other side, or the later ones if there is one side."""
    if len(rows) > 1:
        left = sum(r[0] == 0 for r in rows)
        within = left == len(rows)
        for k in range(len(rows) - 1 if within else left):
            yield k, slice(k + 1 if within else left, len(rows))


def confirmed_in_groups(groups: DataFrame, labels: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between nodes of one group of likely partners that no link has joined so far.

    A group whose nodes carry one label is settled.  The others are cut into blocks, and each pair of
    blocks is one small piece of work that counts the intersections of all its sets at once.
    """
    named = stored(labelled(groups.withColumnRenamed("component", "grp"), labels).select("grp", "node", "label"), "named")
    rows = blocked(named, open_sizes(named), texts, "text", TEXT_BLOCK)
    return tested_blocks(rows, lambda: Shingler(width).sets, lambda met: block_links(met, percent))


def likely_in_buckets(members: DataFrame, groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """Likely partners in one bucket that its star left in different groups, because its ends met by chance."""
    named = labelled(members.filter("n > 2"), groups).select(F.col("key").alias("grp"), "node", "label")

    def signs(column: pa.Array) -> Iterator[np.ndarray]:
        return (np.frombuffer(v, np.uint32) for v in column.to_pylist())

    def agreeing(rows: list[tuple]) -> list[tuple[int, int]]:
        found: list[tuple[int, int]] = []
        if len(rows) > 1:
            signed, labels = np.stack([r[3] for r in rows]), np.array([r[2] for r in rows], np.int64)
            nodes_ = [r[1] for r in rows]
            for k, others in facing(rows):
                open_ = np.flatnonzero(labels[others] != labels[k]) + others.start
                near = open_[(signed[open_] == signed[k]).sum(axis=1) >= LEAST_EQUAL]
                found += [(min(nodes_[k], nodes_[x]), max(nodes_[k], nodes_[x])) for x in joined_labels(labels, k, near)]
        return found

    rows = blocked(named, open_sizes(named), nodes.select("node", "minhashes"), "minhashes", SIGNATURE_BLOCK)
    return tested_blocks(rows, lambda: signs, agreeing).distinct()


def joined_labels(labels: np.ndarray, k: int, others: np.ndarray) -> list[int]:
    """One of ``others`` for each label that differs from that of ``k``; these labels become that of ``k``.

    More links between the same labels would join nothing, so a piece of work gives fewer links than it has labels.
    """
    found, first = np.unique(labels[others], return_index=True)
    first = first[found != labels[k]]
    if len(first):
        labels[np.isin(labels, found)] = labels[k]
    return others[first].tolist()


def block_links(rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links among rows ``(side, node, label, set)`` of different labels, as many as join them."""
    found: list[tuple[int, int]] = []
    labels = np.array([r[2] for r in rows], np.int64)
    if len(rows) > 1 and labels.min() < labels.max():
        nodes, sizes = np.array([r[1] for r in rows], np.int64), np.array([len(r[3]) for r in rows])
        terms, flat = np.unique(np.concatenate([r[3] for r in rows]), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        for k, others in facing(rows):
            if (labels[others] != labels[k]).any():
                mark = np.zeros(len(terms), np.int64)
                mark[flat[starts[k]:starts[k + 1]]] = 1
                common = np.add.reduceat(mark[flat[starts[others.start]:]], starts[others.start:-1] - starts[others.start])
                link = (labels[others] != labels[k]) & (100 * common >= percent * (sizes[k] + sizes[others] - common))
                found += [(int(nodes[k]), int(nodes[x])) for x in joined_labels(labels, k, np.flatnonzero(link) + others.start)]
    return found


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links ``a[k], b[k]``, ascending, and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        x, y = root[left], root[right]
        if (x == y).all():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def forests(links: DataFrame, most: int = FOREST_LINKS) -> DataFrame:
    """``(node, root)`` of the links that a task reads, about ``most`` of them at a time.

    A root is the least node that these links join a node to.  It has a row of its own, so the rows join what the links join.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= most:
                yield forest(held)
                held, count = [], 0
        yield forest(held)

    return map_batches(links.select("a", "b"), join, "node bigint, root bigint")


def forest(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    a, b = (np.concatenate([np.zeros(0, np.int64), *[h.column(k).to_numpy(zero_copy_only=False) for h in held]]) for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in roots(a, b)], names=["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the links; a component is named by its least node.

    Each task joins the links that it reads to trees of one level (``forests``).  Where all trees that hold a node have one root, that
    is its component.  Otherwise labels take the least label of their neighbours, and then the least one that a row of their own label
    or the node that the label names has found.  So whole groups move at once, however far the link that joins them is from their
    least node.  Each round is written to the shared folder.
    """
    trees = stored(forests(links), "trees")
    found = stored(trees.groupBy("node").agg(F.min("root").alias("component"), F.max("root").alias("last")), "labels")
    labels = found.select("node", "component")
    if found.filter("component < last").isEmpty():
        return labels
    # Each node has a row with itself, by which its own label takes part.
    both = stored(
        trees.filter("node <> root").select(F.col("node").alias("a"), F.explode(F.array("node", "root")).alias("b")).unionAll(
            trees.select(F.col("root").alias("a"), F.col("node").alias("b"))).distinct(), "links")
    while True:
        step = stored(
            both.join(labels.withColumnsRenamed({"node": "b"}), "b").groupBy(F.col("a").alias("node"))
            .agg(F.min(F.when(F.col("a") == F.col("b"), F.col("component"))).alias("was"), F.min("component").alias("component")), "labels")
        target = (
            step.select(F.explode(F.array("node", "was")).alias("named"), "component")
            .groupBy("named").agg(F.min("component").alias("next")).withColumnRenamed("named", "component")
        )
        after = stored(step.join(target, "component").select(
            "node", "was", F.least("component", "next").alias("component")), "labels")
        if after.filter("component <> was").isEmpty():
            return after.select("node", "component")
        labels = after.select("node", "component")


def joined_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` of the links behind ``labels`` and of further ``links``, searched among the components they join alone."""
    ends = links.select("a", "b")
    for end in ("a", "b"):
        names = labels.withColumnsRenamed({"node": end, "component": "name"})
        ends = ends.join(names, end, "left").withColumn(end, F.coalesce("name", end)).drop("name")
    top = components(ends.filter("a <> b"))
    fresh = (
        links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti")
        .select("node", F.col("node").alias("component"))
    )
    names = top.select(F.col("component").alias("name"), F.col("node").alias("component"))
    return stored(labels.unionAll(fresh).join(names, "component", "left").select(
        "node", F.coalesce("name", "component").alias("component")), "labels")


def text_digest(text_col: str = "text") -> Column:
    """Tells the texts under one id apart; a null text counts as the empty one."""
    return F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")))


#: Tells rows apart as ``doc_id`` and ``digest`` do, without nulls; rows with an id come first.
ROW = ["nameless", "row_id", "digest"]


def row_key(doc_id: Column) -> list[Column]:
    """The first two columns of ``ROW``."""
    return [doc_id.isNull().alias("nameless"), F.coalesce(doc_id, F.lit(0)).alias("row_id")]


def linked_sets(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """All rows with their set, and ``(set_a, set_b, nameless, row_id, digest, component)`` for every set.

    The columns of ``ROW`` are those of the set's first row.  The component is the number of a node.
    """
    if percent < LEAST_PERCENT:
        raise ValueError(f"percent must be {LEAST_PERCENT} or more: the tables would miss pairs under it")
    rows = id_and_text(docs, id_col, text_col).withColumn("digest", text_digest())
    signed = stored(signatures(rows, width), "signatures")
    # Numbers are given as the table is written, and hold from then on.
    sets = stored(
        signed.filter(F.col("set_a").isNotNull()).select("set_a", "set_b", *row_key(F.col("doc_id")), "digest", "minhashes")
        .groupBy("set_a", "set_b").agg(F.min(F.struct(*ROW, "minhashes")).alias("first"))
        .select("set_a", "set_b", "first.*", F.monotonically_increasing_id().alias("node")), "sets")
    nodes = sets.select("node", "minhashes")

    first = stored(bucket_members(keyed(nodes, FIRST_TABLES)), "members")
    near = stored(likely(stored(member_stars(first), "stars"), nodes), "pairs")
    groups = components(near)
    others = stored(bucket_members(keyed(nodes, OTHER_TABLES)), "members")
    ends = labelled(others, groups).groupBy("key", "label").agg(F.min("node").alias("node"))
    more = stored(likely(stored(stars(ends), "stars"), nodes), "pairs")
    if not more.isEmpty():
        near = stored(near.unionAll(more), "pairs")
        groups = joined_components(groups, more)
    members = first.unionAll(others)
    strays = stored(likely_in_buckets(members, groups, nodes), "pairs")
    if not strays.isEmpty():
        near = stored(near.unionAll(strays), "pairs")
        groups = joined_components(groups, strays)

    # Rows of one key hold one text.
    wanted = sets.join(groups.select("node"), "node").select("node", *ROW)
    texts = stored(rows.select(*row_key(F.col("doc_id")), "digest", "text").join(wanted, ROW).groupBy("node").agg(F.min("text").alias("text")), "texts")
    links = stored(confirmed(near, texts, width, percent), "links")
    labels = components(links)
    more = stored(confirmed_in_groups(groups, labels, texts, width, percent), "links")
    if not more.isEmpty():
        labels = joined_components(labels, more)
    named = sets.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return signed, named.select("set_a", "set_b", *ROW, "component")


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs``; see the module for the rules."""
    signed, sets = linked_sets(docs, width, percent, id_col, text_col)
    sets = stored(sets, "components")
    names = sets.groupBy("component").agg(F.min(F.when(~F.col("nameless"), F.col("row_id"))).alias("name"))
    named = sets.join(names, "component").select("set_a", "set_b", F.col("name").alias("component"))
    known, alone = signed.filter(F.col("set_a").isNotNull()), signed.filter(F.col("set_a").isNull())
    out = known.join(named, ["set_a", "set_b"], "left").select("doc_id", "n_shingles", "component").unionAll(
        alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component")))
    component = F.when(F.col("doc_id").isNotNull(), F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def without_near_copies(docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id",
                        text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component, the first by id and digest of the text, with all its columns.

    A row with an id comes before those without.  Of wordless texts one row stays for each id and text, and all with a null id stay.
    """
    signed, sets = linked_sets(docs, width, percent, id_col, text_col)
    firsts = sets.groupBy("component").agg(F.min(F.struct(*ROW)).alias("first")).select("first.*")
    alone = signed.filter(F.col("doc_id").isNotNull() & F.col("set_a").isNull()).select(*row_key(F.col("doc_id")), "digest")
    # The rows' own columns stay inside a struct, so that none of them can clash with the key.
    known = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_key(F.col(f"`{id_col}`").cast("bigint")),
                        text_digest(text_col).alias("digest"))
    kept = known.join(firsts.unionAll(alone), ROW, "left_semi").dropDuplicates(ROW).select("row.*")
    wordless = signed.filter(F.col("doc_id").isNull() & F.col("set_a").isNull()).select("digest").distinct()
    return kept.unionAll(known.filter("nameless").join(wordless, "digest", "left_semi").select("row.*"))
