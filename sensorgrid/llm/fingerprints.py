"""Document fingerprints: Merkle trees over paragraphs and sections.

A text is cut into lines, and a line of more than ``LINE`` characters into groups of sentences; these
paragraphs are the leaves.  A section ends after a leaf whose digest says so (one in ``SECTION``), or after
``LONGEST`` leaves, so that an inserted or deleted paragraph changes its own section and not the cuts of
the later ones.  A node's digest of 16 bytes is the hash of its children's, up to one root: roots test equality, and walking
down from differing nodes finds the edited paragraphs.

A fingerprint is the tree as text: the whole root, then for each section the first ``SHOWN`` digits of its digest and of its
leaves', which keeps fingerprints short.  Two roots differ wherever two texts do; two different nodes under them look equal with a
chance of 2^-32.  The likeness of two fingerprints is the share of leaves they have in common (Dice, counting copies).

Defined results: a null text counts as the empty one, whose tree has no leaves; two empty texts have
likeness 1, an empty and another text 0.  In the order of the documents rows with a null id come last, and
rows with one id are ordered by their text.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import accumulate

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorgrid.llm.common import id_and_text, map_batches

LINE, GROUP, LONGEST_LEAF = 64, 48, 256
SECTION, LONGEST = 4, 16
_SENTENCE = re.compile(r"[^.!?]*[.!?]*\s*")
LEAST_ID = -(1 << 63)


def paragraphs(text: str) -> list[tuple[int, int]]:
    """Start and end of each leaf; together they cover the text."""
    out: list[tuple[int, int]] = []
    at = 0
    for line in text.split("\n"):
        end = min(at + len(line) + 1, len(text))
        if end - at <= LINE:
            if end > at:
                out.append((at, end))
        else:
            start = at
            for sentence in _SENTENCE.finditer(text, at, end):
                while sentence.end() - start > LONGEST_LEAF:
                    out.append((start, start + LONGEST_LEAF))
                    start += LONGEST_LEAF
                if sentence.end() - start >= GROUP:
                    out.append((start, sentence.end()))
                    start = sentence.end()
            if start < end:
                out.append((start, end))
        at = end
    return out


#: Digits of a section or leaf that a fingerprint shows.
SHOWN = 8


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def tree(text: str) -> list[tuple[bytes, list[bytes]]]:
    """Sections: ``(digest, digests of the leaves)``."""
    sections: list[tuple[bytes, list[bytes]]] = []
    leaves: list[bytes] = []
    for start, end in paragraphs(text):
        leaf = digest(text[start:end].encode())
        leaves.append(leaf)
        if leaf[-1] % SECTION == 0 or len(leaves) == LONGEST:
            sections.append((digest(b"".join(leaves)), leaves))
            leaves = []
    if leaves:
        sections.append((digest(b"".join(leaves)), leaves))
    return sections


def fingerprint(text: str) -> str:
    sections = tree(text)
    root = digest(b"".join(name for name, _ in sections))
    shown = ("".join(leaf.hex()[:SHOWN] for leaf in leaves) for _, leaves in sections)
    return root.hex() + "".join(f"/{name.hex()[:SHOWN]}:{body}" for (name, _), body in zip(sections, shown))


def leaves_of(print_: str) -> list[str]:
    """Leaf digests of a fingerprint, in order."""
    return [leaf for _, leaves in sections_of(print_) for leaf in leaves]


def likeness(a: str, b: str) -> float:
    """Share of common leaves; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    x, y = Counter(leaves_of(a)), Counter(leaves_of(b))
    both = x.total() + y.total()
    return 2 * (x & y).total() / both if both else 1.0


def sections_of(print_: str) -> list[tuple[str, list[str]]]:
    """Sections of a fingerprint as ``tree`` gives them, with the digits shown."""
    parts = (s.split(":") for s in print_.split("/")[1:])
    return [(name, [body[k:k + SHOWN] for k in range(0, len(body), SHOWN)]) for name, body in parts]


def first_edit(a: str, b: str) -> int | None:
    """Number of the first leaf in which two trees differ, found from the roots down; None for equal trees.

    Equal sections are passed over by their digests alone.
    """
    if a[:32] == b[:32]:
        return None
    x, y, passed = sections_of(a), sections_of(b), 0
    for (name, leaves), (other, others) in zip(x, y):
        if name != other or leaves != others:
            return passed + next((k for k, (p, q) in enumerate(zip(leaves, others)) if p != q), min(len(leaves), len(others)))
        passed += len(leaves)
    return passed


def leaf_edits(a: str, b: str) -> tuple[list[int], list[int], list[tuple[int, int]]]:
    """``(removed, new, moved)``: numbers of leaves of ``a``, of ``b``, and of both for a leaf that changed its place.

    Equal sections are passed over; inside the others the leaves are compared in order, each copy for itself.
    """
    x, y = sections_of(a), sections_of(b)
    starts = [[0, *accumulate(len(leaves) for _, leaves in side)] for side in (x, y)]
    gone: dict[str, list[int]] = {}
    added: list[tuple[int, str]] = []
    for kind, i, i2, j, j2 in SequenceMatcher(None, [n for n, _ in x], [n for n, _ in y], autojunk=False).get_opcodes():
        if kind != "equal":
            old, fresh = ([leaf for _, leaves in side for leaf in leaves] for side in (x[i:i2], y[j:j2]))
            for same, p, p2, q, q2 in SequenceMatcher(None, old, fresh, autojunk=False).get_opcodes():
                if same != "equal":
                    for k in range(p, p2):
                        gone.setdefault(old[k], []).append(starts[0][i] + k)
                    added += [(starts[1][j] + k, fresh[k]) for k in range(q, q2)]
    moved = [(gone[leaf].pop(0), at) for at, leaf in added if gone.get(leaf)]
    to = {at for _, at in moved}
    return sorted(k for left in gone.values() for k in left), [at for at, _ in added if at not in to], moved


def edited_leaves(a: str, b: str) -> list[int]:
    """Numbers of the leaves of ``b`` that are new or moved; ``leaf_edits`` has the removed ones of ``a`` too."""
    _, new, moved = leaf_edits(a, b)
    return sorted(new + [at for _, at in moved])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_chars, fingerprint)`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(list(map(fingerprint, texts)), pa.string())],
                names=["doc_id", "n_chars", "fingerprint"])

    return map_batches(id_and_text(docs, id_col, text_col), run, "doc_id bigint, n_chars bigint, fingerprint string")


def with_next_text(rows: DataFrame) -> DataFrame:
    """Rows of ``(doc_id, text)`` dealt so that a task meets each document right before its next one.

    Ids are cut into ranges at approximate quantiles.  Each range also gets the greatest document of the range
    below it, marked as follower; the lowest range gets the greatest of all.  The cut points, one for
    each of a set number of ranges, are all that the driver sees, and texts are moved once.
    """
    spark = rows.sparkSession
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce("doc_id", F.lit(LEAST_ID))
    ids = rows.select(key.cast("double").alias("place"), key.alias("sort_id"))
    cuts = sorted(set(ids.approxQuantile("place", [k / (2 * wide) for k in range(1, 2 * wide)], 0.2 / wide)))
    bucketizer = Bucketizer(splits=[-float("inf"), *(cuts or [0.0]), float("inf")], inputCol="place", outputCol="range")
    tops = [(int(r["range"]), r["top"]) for r in bucketizer.transform(ids).groupBy("range").agg(F.max("sort_id").alias("top")).collect()]
    tops.sort()
    above = {top: tops[(k + 1) % len(tops)][0] for k, (_, top) in enumerate(tops)}
    # The greatest of all, whose range above is the first one, follows the least.
    followers = spark.createDataFrame([(top, float(r)) for top, r in above.items()], "sort_id bigint, extra double")
    placed = bucketizer.transform(rows.withColumn("sort_id", key).withColumn("place", key.cast("double")))
    own = F.struct(F.col("range"), F.lit(0).alias("follower"))
    extra = F.struct(F.col("extra").alias("range"), F.lit(1).alias("follower"))
    dealt = (
        placed.join(F.broadcast(followers), "sort_id", "left")
        .withColumn("at", F.explode(F.when(F.col("extra").isNull(), F.array(own)).otherwise(F.array(own, extra))))
        .select("doc_id", "sort_id", "text", F.col("at.range").cast("int").alias("range"), F.col("at.follower").alias("follower"))
    )
    return dealt.repartition(wide, "range").sortWithinPartitions("range", "follower", F.desc("sort_id"), "text").select(
        "range", "follower", "doc_id", "text")


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many, or all, of the first ones of the next text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def edit_likeness(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, how near they and the next document's are, and where the edit begins.

    ``first_edit`` is the number of the first leaf that the edit changed, null where it changed nothing; ``new_leaves`` counts
    the leaves that the edited text has and the document has not.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "first_edit", "new_leaves"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # range, id, text and fingerprint of a document that waits for its next one
        for batch in batches:
            out: list[tuple] = []
            for place, follower, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if last is None or last[0] != place:
                    if not follower:
                        last = (place, doc_id, text, fingerprint(text))
                    continue
                own = fingerprint(text)
                changed = edited(last[2], text)
                new = fingerprint(changed)
                out.append((last[1], len(last[2]), hashlib.sha256(changed.encode()).hexdigest(), last[3], new,
                            likeness(last[3], new), likeness(last[3], own), first_edit(last[3], new),
                            (Counter(leaves_of(new)) - Counter(leaves_of(last[3]))).total()))
                last = None if follower else (place, doc_id, text, own)
            columns = zip(*out) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    return map_batches(with_next_text(id_and_text(docs, id_col, text_col)), run,
                       "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                       "near_edited double, near_next double, first_edit bigint, new_leaves bigint")
