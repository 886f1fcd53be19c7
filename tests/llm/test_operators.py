"""The numbered operators against brute force, and their defined results on odd rows."""

import hashlib
import math
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sensorgrid.llm import byte_bpe, fingerprints, near_dedup, packing, pii, quality, quotation, token_counts, topk, toxicity

COLUMNS = "doc_id bigint, text string, score double, node string, key string, n_tokens string"
TEXTS = [
    (1, "The cat sat on the mat and the dog lay by the door."), (2, "the cat sat on the mat and the dog lay by the door."),
    (2, "the cat sat on the mat and the dog lay by the door."), (3, None), (4, ""), (None, "No id here, write to a.b@c.org"),
    (5, "  double  spaces \n and\tlines\r\n  "), (6, "don't we'll I'M '' 's<|endoftext|> x<|endoftext|>"), (7, "ein Wörter-Test ½ 日本語 🎉🎉"),
    (8, "one"), (9, "ONE"), (10, "+1 (555) 123-4567, 4111 1111 1111 1111, 10.0.0.256, 10.0.0.25, GB82 WEST 1234 5698 7654 32"),
    (11, "x" * 70_000 + " " + "word " * 30_000), (12, "\x1c\x85   z"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 1.0, "a", None, "b") for i, t in TEXTS], COLUMNS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def by_text(rows):
    return sorted(rows, key=repr)


def test_token_counts(odd, none, tokenizer):
    want = by_text((i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in TEXTS)
    got = token_counts.token_counts(odd).collect()
    assert by_text((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert token_counts.token_counts(none).count() == 0


def test_byte_bpe(odd, none):
    import tiktoken
    ranks = byte_bpe.load_ranks(byte_bpe.RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {t or "": library.encode_ordinary(t or "") for _, t in TEXTS}
    encoded = byte_bpe.encode(odd)
    assert by_text((r.doc_id, list(r.ids)) for r in encoded.collect()) == by_text((i, want[t or ""]) for i, t in TEXTS)
    assert by_text((r.doc_id, bytes(r.data)) for r in byte_bpe.decode(encoded).collect()) == by_text((i, (t or "").encode()) for i, t in TEXTS)
    sha = lambda s: hashlib.sha256(s).hexdigest()
    got = byte_bpe.round_trip_digests(odd).collect()
    assert by_text((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == by_text(
        (i, len(want[t or ""]), sha(" ".join(map(str, want[t or ""])).encode()), sha((t or "").encode())) for i, t in TEXTS)
    assert byte_bpe.encode(none).count() == 0


def test_lower_rank_in_between():
    """A new pair of lower rank goes before the rest of its word, as the library does it."""
    import tiktoken
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"abcd": 257, b"ab": 258, b"cd": 259, b"xabcd": 260, b"xab": 300, b"abx": 299}
    library = tiktoken.Encoding("tiny", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    replay = byte_bpe.MergeReplay()
    replay.ranks, replay.tokens, replay.single = ranks, {v: k for k, v in ranks.items()}, list(range(256))
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdx"), rng.integers(1, 24))) for _ in range(3000)]
    assert [list(x) for x in replay.encode([w.encode() for w in words])] == [library.encode_ordinary(w) for w in words]


def test_packing(odd, none, tokenizer):
    pieces = packing.pack_documents(odd, length=64).toPandas()
    ids = {t or "": [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for _, t in TEXTS}
    want = [(i, at, len(x[at:at + 64]), zlib.crc32(np.array(x[at:at + 64], "<u4").tobytes()), len(x))
            for i, t in TEXTS for x in [ids[t or ""]] for at in range(0, len(x), 64)]
    rows = [(None if pd.isna(r[0]) else int(r[0]), *map(int, r[1:])) for r in pieces.iloc[:, :5].itertuples(index=False)]
    assert by_text(rows) == by_text(want)
    for _, pack in pieces.sort_values("offset").groupby("sequence_id"):
        assert pack.offset.tolist() == [0, *pack.length.cumsum().tolist()[:-1]] and pack.length.sum() <= 64
    assert pieces.sequence_id.nunique() == pieces.sequence_id.max() + 1
    assert packing.pack_documents(none).count() == 0
    with_ids = packing.piece_ids(odd, length=64).filter("doc_id = 1").collect()
    assert [x for r in sorted(with_ids, key=lambda r: r.start) for x in r.ids] == ids[TEXTS[0][1]]


def test_patterns_hold_every_piece():
    rng = np.random.default_rng(5)
    histogram = {int(k): int(v) for k, v in zip(rng.choice(np.arange(1, 129), 60, replace=False), rng.integers(1, 4000, 60))} | {1: 1_000_000}
    packs = packing.patterns(histogram, 128)
    held = {}
    for count, content in packs:
        assert sum(size * copies for size, copies in content) <= 128
        for size, copies in content:
            held[size] = held.get(size, 0) + count * copies
    assert held == histogram
    assert sum(k * v for k, v in histogram.items()) / (128 * sum(c for c, _ in packs)) > 0.95


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k:k + width]) for k in range(len(words) - width + 1))


def brute_components(rows, width):
    sets = {i: shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, sf, width):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    chain = []
    for k in range(60):  # a drifting chain of near copies: neighbours are linked, ends are not
        base = [w if rng.random() > 0.03 else f"v{rng.integers(1_000_000)}" for w in base]
        chain.append((10_000 + k, " ".join(base)))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] + chain
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = near_dedup.near_duplicates(df, width=width).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, width)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_blocks_give_links_that_join():
    """A piece of work joins the same components as all its links, with fewer links than labels."""
    rng = np.random.default_rng(3)
    base = rng.choice(1 << 40, 60, replace=False).astype(np.uint64)
    for _ in range(40):
        n = int(rng.integers(2, 40))
        sets = [np.unique(np.where(rng.random(60) < 0.1, rng.integers(1, 1 << 40, 60).astype(np.uint64), base)) for _ in range(n)]
        labels = rng.integers(0, n, n)
        rows = [(int(k >= n // 2), k, int(labels[k]), sets[k]) for k in range(n)]

        def groups(pairs):
            of = {k: int(labels[k]) for k in range(n)}
            for a, b in pairs:
                x, y = of[a], of[b]
                of = {k: x if v == y else v for k, v in of.items()}
            return {frozenset(k for k in of if of[k] == v) for v in of.values()}

        near = [(a, b) for a in range(n // 2) for b in range(n // 2, n)
                if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))]
        got = near_dedup.block_links(rows, 80)
        assert groups(got) == groups(near)
        assert len(got) < len(set(labels.tolist())) or not got


def test_near_duplicates_odd_rows(odd, none):
    got = by_text(tuple(r) for r in near_dedup.near_duplicates(odd, width=2).collect())
    assert len(got) == len(TEXTS) and got.count((2, 12, 1, False)) == 2
    assert (3, 0, 3, True) in got and (4, 0, 4, True) in got and (9, 1, 8, False) in got
    assert [r[2:] for r in got if r[0] is None] == [(None, None)]
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_duplicates_of_rows_that_share_an_id(spark):
    a, b = (" ".join(f"{letter}{k}" for k in range(60)) for letter in "ab")
    # Id 4 is the least of two sets; id 5 holds copies of both and is folded with neither.
    rows = [(4, a), (5, a + " end"), (4, b), (5, b + " end"), (3, "c " + b), (6, a)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), width=2).collect()
    assert sorted(tuple(r) for r in got) == [
        (3, 60, 3, True), (4, 59, 3, False), (4, 59, 4, True), (5, 60, 3, False), (5, 60, 4, False), (6, 59, 4, False)]


def test_near_duplicates_refuses_what_its_tables_would_miss(none):
    with pytest.raises(ValueError, match="percent"):
        near_dedup.near_duplicates(none, percent=79)


def test_edit_likeness(spark, odd, none):
    rows = [(r.doc_id, r.text or "") for r in odd.dropDuplicates(["doc_id"]).collect()]
    rows.sort(key=lambda r: -1e9 if r[0] is None else r[0], reverse=True)
    want = {}
    for k, (i, t) in enumerate(rows):
        half = len(t) // 2
        want[i] = (len(t), hashlib.sha256((t[:len(t) - half] + rows[(k + 1) % len(rows)][1][:half]).encode()).hexdigest())
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = fingerprints.edit_likeness(df).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    nexts = {i: rows[(k + 1) % len(rows)][1] for k, (i, _) in enumerate(rows)}
    texts = dict(rows)

    def shares(a, b):
        from collections import Counter
        x, y = (Counter(t[p:q] for p, q in fingerprints.paragraphs(t)) for t in (a, b))
        return 1.0 if not x + y else 2 * (x & y).total() / (x.total() + y.total()), (y - x).total()

    for r in got:
        own = texts[r.doc_id]
        changed = own[:len(own) - len(own) // 2] + nexts[r.doc_id][:len(own) // 2]
        assert (r.near_edited, r.new_leaves) == (pytest.approx(shares(own, changed)[0]), shares(own, changed)[1])
        assert r.near_next == pytest.approx(shares(own, nexts[r.doc_id])[0]) and (r.first_edit is None) == (own == changed)
    prints = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(odd).collect()}
    assert prints[3] == prints[4] and len(set(prints.values())) == len(prints) - 1
    assert fingerprints.edit_likeness(none).count() == 0
    alone = fingerprints.edit_likeness(df.limit(1)).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


def test_fingerprint_locates_an_edit():
    lines = [f"Line number {k} holds some words of its own." for k in range(200)]
    a = fingerprints.fingerprint("\n".join(lines))
    lines[77] = "Another line."
    b = fingerprints.fingerprint("\n".join(lines))
    assert fingerprints.edited_leaves(a, b) == [77] and fingerprints.likeness(a, b) == pytest.approx(199 / 200)
    assert fingerprints.edited_leaves(a, a) == [] and fingerprints.likeness(a, a) == 1


def test_roots_are_made_of_child_digests():
    """The root is the hash of its sections', a section of its leaves'; first edits are found from the root down."""
    def h(data):
        return hashlib.blake2b(data, digest_size=16).digest()

    text = "\n".join(f"Line {k} of a text." for k in range(90)) + "\nLine 3 of a text.\n"
    sections = fingerprints.tree(text)
    leaves = [h(text[a:b].encode()) for a, b in fingerprints.paragraphs(text)]
    assert [leaf for _, body in sections for leaf in body] == leaves and len(sections) > 5
    assert all(name == h(b"".join(body)) for name, body in sections)
    own = fingerprints.fingerprint(text)
    assert own[:32] == h(b"".join(name for name, _ in sections)).hex() and fingerprints.leaves_of(own) == [x.hex()[:8] for x in leaves]
    assert fingerprints.first_edit(own, own) is None
    for k in (0, 17, 89):
        other = fingerprints.fingerprint(text.replace(f"Line {k} of", f"Line {k} off", 1))
        assert fingerprints.first_edit(own, other) == k
    assert fingerprints.first_edit(own, fingerprints.fingerprint(text + "more")) == 91
    assert fingerprints.first_edit(fingerprints.fingerprint(""), own) == 0


@pytest.mark.parametrize("after, want", [
    ("AC", ([1], [], [])), ("AAC", ([1], [1], [])), ("BAC", ([], [], [(0, 1)])), ("ABCB", ([], [3], [])), ("", ([0, 1, 2], [], []))])
def test_leaf_edits(after, want):
    a, b = (fingerprints.fingerprint("".join(f"Paragraph {x}\n" for x in text)) for text in ("ABC", after))
    removed, new, moved = fingerprints.leaf_edits(a, b)
    if moved:  # A before B or B after A
        assert moved in ([(0, 1)], [(1, 0)]) and (removed, new) == ([], [])
        assert fingerprints.edited_leaves(a, b) == [moved[0][1]]
    else:
        assert (removed, new, moved) == want


def test_personal_data(odd, none):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    rng = np.random.default_rng(4)
    parts = ["a", "b1", "@", ".", "-", " ", "1", "25", "255", "256", "4111 1111 1111 1111", "+1", "(", ".com", "%", "0", "\n", "é", "1.2.3.4"]
    for _ in range(3000):
        text = "".join(rng.choice(parts, rng.integers(1, 18)))
        want = []
        for kind, pattern in patterns.items():
            for m in re.finditer(pattern, text):
                digits = re.sub("[^0-9]", "", m.group())
                if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                        "card": 16 <= len(digits) <= 19 and pii.luhn(digits or "0"), "phone": 8 <= len(digits) <= 15}[kind]:
                    want.append((kind, *m.span()))
        assert [s for s in pii.spans(text) if s[0] != "iban"] == want, text
    found = {r.doc_id: r for r in pii.span_digests(pii.find_spans(odd)).collect()}
    assert (found[10].n_phone, found[10].n_card, found[10].n_ip, found[10].n_email) == (1, 1, 1, 0)
    assert found[None].n_email == 1 and found[10].spans.split(",")[-1].startswith("iban:")
    assert found[3].spans == "" and found[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = pii.without_personal_data(odd)
    assert clean.schema == odd.schema and clean.filter("text LIKE '%[CARD]%' AND text LIKE '%[PHONE]%'").count() == 1
    assert pii.without_personal_data(none).count() == 0 and pii.find_spans(none).count() == 0


def test_scores_follow_nearby_words(spark):
    """Words for and against a kind move the score of a base span, and decide whether an added span counts."""
    iban = "GB82 WEST 1234 5698 7654 32"
    texts = {0: f"x {iban}", 1: f"bank account {iban}", 2: f"an example {iban}", 3: f"an example of a bank account {iban}",
             4: "mail me: a@b.org", 5: "a test a@b.org", 6: "a@b.org", 7: "test mail a@b.org"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: (r.spans.split(":")[0], r.scores) for r in pii.span_digests(pii.find_spans(docs)).collect()}
    assert got == {0: ("iban", "0.80"), 1: ("iban", "0.95"), 2: ("", ""), 3: ("iban", "0.80"),
                   4: ("email", "0.95"), 5: ("email", "0.65"), 6: ("email", "0.80"), 7: ("email", "0.80")}
    clean = {r.doc_id: r.text for r in pii.without_personal_data(docs).collect()}
    assert clean[1] == "bank account [IBAN]" and clean[2] == texts[2] and clean[5] == "a test [EMAIL]"


def test_ip_addresses_in_long_runs():
    """Time grows with the length alone, and whole groups of digits decide as the pattern does."""
    import time
    base = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    rng = np.random.default_rng(8)
    for _ in range(2000):
        text = "".join(rng.choice(list("0123.. -x5"), rng.integers(1, 40)))
        want = [m.span() for m in base.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
        assert [s[1:] for s in pii.numbers(text) if s[0] == "ip"] == want, text
    started = time.perf_counter()
    for n in (1_000_000, 2_000_000):
        assert pii.spans("1.1-1.1-1.1-" + "1" * n) == []
    assert time.perf_counter() - started < 20


def test_top_products_of_very_large_components(spark):
    """Products beyond 64 bits are cut; a vector whose scaled components are beyond the doubles takes no part."""
    rows = [(0, [1e307, 1.0]), (50, [1.0, 2.0]), (1, [1e304, -1e304]), (2, [-1e304, 1e304]), (3, [3.0, -1.0]), (100, [1e304, 1e304])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for r in topk.top_products(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    whole = {i: [int(256 * x) for x in v] for i, v in rows if i}
    cut = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    want = {q: sorted((-cut(sum(a * b for a, b in zip(whole[q], v))), i) for i, v in whole.items() if i != q) for q in (50, 100)}
    assert {q: sorted(v) for q, v in got.items()} == want


def test_top_products(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(0, 0.2, 12).tolist()) for k in range(700)] + [(700 + k, [0.5] * 12) for k in range(300)]
    extra = [(2000, None), (2050, [float("nan")] * 12), (2100, [None] * 12), (None, [0.1] * 12), (50, rows[50][1]), (3000, [0.3, 0.4])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + extra], "vec_id bigint, embedding array<double>, score string")
    got = {}
    for r in topk.top_products(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    whole = np.floor(256 * np.array([v for _, v in rows])).astype(int)
    want = {q: [(int(i), -s) for s, i in sorted((-int(p), i) for i, p in enumerate(whole @ whole[q]) if i != q)[:5]] for q in range(0, 1000, 50)}
    assert got == want
    assert topk.top_products(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def check_top_products(spark, rows, k=5):
    """The rows of the search against brute force over whole numbers of any length."""
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for r in topk.top_products(df, F.col("vec_id") % 50 == 0, k=k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and None not in v]
    want = {}
    for q, a in whole:
        for i, b in whole:
            if q % 50 == 0 and i != q and len(a) == len(b):
                score = max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b))))
                best = want.setdefault(q, {})
                best[i] = max(score, best.get(i, score))
    assert got == {q: sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k] for q, best in want.items()}


def test_queries_are_not_broadcast(spark):
    """Blocks of queries for all parts are shuffled: they grow with the square of the table, and Spark sees those for one part alone."""
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(k, rng.normal(0, 0.2, 8).tolist()) for k in range(3000)], "vec_id bigint, embedding array<double>")
    found = topk.top_products(df, F.col("vec_id") % 50 == 0)
    assert len(found.collect()) == 300
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "Generate explode" in plan
    assert "Broadcast" not in plan and "Join" not in plan


def test_top_products_over_many_parts_and_blocks(spark, monkeypatch):
    """Results do not follow from how vectors are dealt: ids with several vectors, several lengths, ties, numbers of any length."""
    for name, value in (("CHUNK", 16), ("BLOCK", 4), ("PART_BYTES", 2000), ("BLOCK_VALUES", 30)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(10)
    rows = [(int(i), rng.normal(0, 0.3, n).tolist()) for n, ids in ((6, range(0, 600, 2)), (9, range(0, 300, 3))) for i in ids]
    rows += [(50 * int(i), rng.normal(0, 0.3, 6).tolist()) for i in rng.integers(0, 4, 40)] + [(7, v) for _, v in rows[:60]]
    rows += [(i, [0.25] * 6) for i in range(700, 760)] + rows[:20] + [(None, [0.1] * 6), (50, None), (100, [None] * 6)]
    check_top_products(spark, rows)
    check_top_products(spark, rows, k=1)
    check_top_products(spark, [(i, (rng.normal(size=3) * 10.0 ** (i % 5 * 3)).tolist()) for i in range(250)])


def test_top_products_of_empty_and_far_vectors(spark):
    """Vectors without components have the product 0; products under 64 bits are equal once cut, so the smaller id counts."""
    check_top_products(spark, [(0, []), (1, []), (50, []), (2, [1.0])])
    check_top_products(spark, [(300, [-1e15, 1.0])] + [(200 - i, [1e15 + i * 1e9, 1.0]) for i in range(1, 150)])


@pytest.mark.parametrize("module, label, better", [(toxicity, "toxic", 0.9), (quality, "quality", 0.9)])
def test_classifiers(spark, module, label, better):
    rng = np.random.default_rng(6)
    mark = {"toxic": ("scum", "fine"), "quality": ("word", "***")}[label]
    rows = [(k, " ".join(rng.choice(["ab", "cd", "ef", "gh", mark[0] if k % 3 else mark[1]], 30))) for k in range(600)]
    docs = spark.createDataFrame([*rows, (None, "ab"), (9001, None), (9002, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k, _ in rows] + [(None, 1), (5, None)], f"doc_id bigint, {label} int")
    model = module.train(docs, labels, label_col=label)
    got = module.score_documents(docs, model).collect()
    assert len(got) == 603 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= module.THRESHOLD) for r in got)
    for r in got:
        if r.doc_id is None:
            assert r.held_out is None
        else:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % module.FOLDS == module.HELD_OUT)
    held = [(r.score >= 0.5) == (r.doc_id % 3 > 0) for r in got if r.held_out and r.doc_id < 600]
    assert np.mean(held) >= better
    again = module.score_documents(docs, module.train(docs, labels, label_col=label)).collect()
    assert {r.doc_id: r.score for r in got} == {r.doc_id: r.score for r in again}
    nothing = module.train(docs.limit(0), labels.limit(0), label_col=label)
    assert module.score_documents(docs.limit(0), nothing).count() == 0 and module.score_documents(docs, nothing).count() == 603


CHAT = [
    (1, 0, "user", "Hello all.\nSecond line.\n\nA new paragraph."), (1, 1, "assistant", "> Hello all.\n> second   LINE.\nYes."),
    (1, 2, "user", ">> a new paragraph.\n> Yes.\nNo."), (1, 3, "user", "> unknown words\nAlone."), (1, 4, "user", None),
    (1, 5, "user", "Yes."), (1, 6, "user", "> yes.\nWhich?"), (1, 6, "user", "> yes.\nWhich?"), (2, 0, "user", "> Yes."),
    (None, 1, "user", "> Yes."), (1, None, "user", "Yes."), (3, 0, "user", ""),
]


def test_pairs_of_terms_decide_toxicity(spark):
    """Labels that no linear rule of the words can give: the machine learns which words go together."""
    rng = np.random.default_rng(12)
    rows, labels = [], []
    for k in range(1600):
        toxic = int(rng.random() < 0.5)
        first = rng.random() < (0.6 if toxic else 0.35)
        insult, group = ("vile", "zorgs" if toxic else "mooks") if first else ("crass", "mooks" if toxic else "zorgs")
        rows.append((k, " ".join(rng.permutation([insult, group, *rng.choice(["ab", "cd", "ef", "gh", "ij"], 8)]))))
        labels.append((k, toxic))
    docs, marks = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    machine = toxicity.train(docs, marks)
    want = dict(labels)
    held = [r for r in toxicity.score_documents(docs, machine).collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 400 and sum((r.score >= 0.5) == want[r.doc_id] for r in held) / len(held) > 0.97
    # One of the four pairs of words is wrong under any linear rule.
    combos = {}
    for i, t in rows:
        combos.setdefault(("vile" in t, "zorgs" in t), []).append(want[i])
    assert all(len(set(v)) == 1 for v in combos.values()) and min(map(len, combos.values())) / len(rows) > 0.15
    # The batch's scores are those of a plain sum over pairs, text by text.
    words = toxicity.hasher()
    import pyarrow as pa
    batch = machine.scores(words, pa.array([t for _, t in rows[:60]]))
    for (_, t), score in zip(rows[:60], batch):
        _, terms = machine.features(words, pa.array([t]))
        at = sorted(set(np.asarray(terms).tolist()))
        z = machine.bias + sum(machine.weights[i] for i in at)
        z += sum(float(machine.factors[i] @ machine.factors[j]) for n, i in enumerate(at) for j in at[n + 1:])
        assert score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_components_in_two_steps(spark):
    """Long paths in any order of ids, stars and repeated links, found at once or after further links, against union-find."""
    rng = np.random.default_rng(21)
    order = rng.permutation(300).tolist()
    links = list(zip(order[:150], order[1:150])) + [(1000, k) for k in range(1001, 1020)] + [(5000, 5001), (5000, 5001)]
    further = list(zip(order[150:-1], order[151:])) + [(order[149], order[150]), (1019, order[299]), (5001, 5000), (7000, 7001)]

    def brute(pairs):
        name = {x: x for pair in pairs for x in pair}
        changed = True
        while changed:
            changed = False
            for a, b in pairs:
                least = min(name[a], name[b])
                changed |= name[a] != least or name[b] != least
                name[a] = name[b] = least
        return name

    frame = lambda rows: spark.createDataFrame(rows, "a bigint, b bigint")
    found = lambda df: sorted(map(tuple, df.select("node", "component").collect()))
    labels = near_dedup.components(frame(links))
    assert found(labels) == sorted(brute(links).items())
    assert found(near_dedup.joined_components(labels, frame(further))) == sorted(brute(links + further).items())
    assert found(near_dedup.joined_components(labels, frame([]))) == sorted(brute(links).items())
    assert found(near_dedup.joined_components(near_dedup.components(frame([])), frame(links))) == sorted(brute(links).items())


def test_forests_join_what_their_links_join(spark):
    """Trees of tasks, of few links at a time or of all, have one level and join the same nodes as the links."""
    rng = np.random.default_rng(22)
    order = rng.permutation(120)
    a, b = np.concatenate([order[:-1], [500, 500, 501]]), np.concatenate([order[1:], [501, 501, 501]])
    nodes, least = near_dedup.roots(a, b)
    assert nodes.tolist() == [*range(120), 500, 501] and least.tolist() == [0] * 120 + [500, 500]
    assert [x.tolist() for x in near_dedup.roots(a[:0], b[:0])] == [[], []]
    links = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a bigint, b bigint").coalesce(1)
    for most in (7, 1000):
        rows = [(r.node, r.root) for r in near_dedup.forests(links, most).collect()]
        assert all(root <= node and (root, root) in rows for node, root in rows)
        again, least = near_dedup.roots(*np.array(rows).T)
        assert again.tolist() == nodes.tolist() and set(least.tolist()) == {0, 500}


def test_quotation(spark):
    df = spark.createDataFrame([(*r, "x") for r in CHAT], "conv_id bigint, turn bigint, role string, text string, hash string")
    got = quotation.reply_ordered(df)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct", plan)
    rows = got.collect()
    assert len(rows) == len(CHAT)
    seen = {(r.conv_id, r.turn): (r.body, r.max_level, r.n_linked > 0, r.reply_to, r.thread, r.depth) for r in rows}
    assert seen[1, 0] == (CHAT[0][3], 0, False, None, 0, 0)
    assert seen[1, 1] == ("Yes.", 1, True, 0, 0, 1)
    assert seen[1, 2] == ("No.", 2, True, 1, 0, 2)
    assert seen[1, 3] == ("Alone.", 1, False, None, 3, 0)
    assert seen[1, 4] == (None, 0, False, None, 4, 0)
    assert seen[1, 6] == ("Which?", 1, True, 5, 5, 1)
    assert seen[2, 0][1:] == (1, False, None, 0, 0) and seen[None, 1][2:] == (False, None, None, 0)
    assert quotation.reply_ordered(df.limit(0)).count() == 0


def test_quotation_blocks(spark):
    """The latest earlier origin over many blocks of turns, against brute force."""
    rng = np.random.default_rng(8)
    turns = sorted(rng.choice(20_000, 600, replace=False).tolist())
    rows = [(7, t, "user", f"> say {rng.integers(3)}\nok" if rng.random() < 0.4 else f"say {rng.integers(3)}") for t in turns]
    got = {r.turn: r.reply_to for r in quotation.reply_ordered(
        spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    for _, turn, _, text in rows:
        if text.startswith(">"):
            said = text.split("\n")[0][2:]
            assert got[turn] == max((t for _, t, _, x in rows if t < turn and x == said), default=None)


