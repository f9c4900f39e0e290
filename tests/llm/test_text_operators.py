"""Line dedup, Jaccard join, suffix array, decontamination and quality rules against brute force, and edge cases."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import decontamination, line_dedup, ngram_join, quality, registry, suffixes
from tidemark.llm.components import components
from tidemark.llm.hashing import shingle_sets, word_hashes

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, m int, key string, lines string, n long"  # the last four clash with inner names


def table(spark, texts):
    return spark.createDataFrame([(i, t, 1, "k", "l", 2) for i, t in enumerate(texts)], SCHEMA).repartition(3)


def low(text):
    return (text or "").encode().lower().decode()


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", low(text))


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_query_against_sql(spark, same_rows, name):
    same_rows(registry.QUERIES[name](spark, DATA), registry.ORACLE_SQL[name])


def test_edge_rows_against_sql(spark, same_rows, tmp_path):
    """Nulls, empty and long texts, ties and repeated rows, for all operators that SQL can express."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 5))) for _ in range(40)]
    long = " ".join(rng.choices(vocabulary, k=5_000))
    line = " ".join(rng.choices(vocabulary, k=12))
    texts = [None, "", " ", "\n\n", "one", "a b c d", line, line + "\n" + line, line[:-1], line.upper(), line + "!", long, long[:5000] + " x", "x " * 300, "Ünï\tcode\r\nTEXT \x0b y", line]
    texts += [" ".join(rng.choices(vocabulary, k=60)) + " " + long[:900] for _ in range(4)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    bench = spark.createDataFrame([(7, line), (70, line), (8, None), (9, ""), (10, "a b c"), (11, long[100:700])], "item_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for name in registry.ORACLE_SQL:
        same_rows(registry.QUERIES[name](spark, str(tmp_path)), registry.ORACLE_SQL[name], folder=tmp_path)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert line_dedup.dedup_lines(none).count() == 0
    assert ngram_join.jaccard_components(none).count() == 0
    assert suffixes.repeated_passages(none).count() == 0
    assert decontamination.contamination(none, bench).count() == 0
    assert quality.judge(none).count() == 0
    docs = table(spark, ["a b c", None])
    assert {r.contaminated for r in decontamination.contamination(docs, bench).collect()} == {False}


def test_rows_without_ids(spark):
    """Every row is a document of its own, also without an id or with one that another row has."""
    line = "the same long line of this text " * 12
    rows = [(None, line), (1, line), (2, line), (None, None), (3, None)]
    docs = spark.createDataFrame([(i, t, 1, "k", "l", 2) for i, t in rows], SCHEMA)
    bench = spark.createDataFrame([(None, line), (5, line)], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in line_dedup.dedup_lines(docs).collect()) == [(0, 0), (0, 1), (1, 0), (2, 1), (3, 0)]
    assert sorted(r.doc_id or 0 for r in line_dedup.filter_documents(docs).collect()) == [0, 1, 3]
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in ngram_join.jaccard_components(docs).collect()) == [(0, 0), (0, 1), (1, 1), (2, 1), (3, 3)]
    assert sorted(r.doc_id or 0 for r in ngram_join.filter_documents(docs).collect()) == [0, 1, 3]
    assert sorted(r.doc_id or 0 for r in suffixes.repeated_passages(docs).collect()) == [0, 1, 2]
    assert suffixes.drop_copies(docs).count() == 5
    assert sorted((r.doc_id or 0, r.n_items) for r in decontamination.contamination(docs, bench).collect()) == [(0, 0), (0, 1), (1, 1), (2, 1), (3, 0)]
    assert decontamination.filter_documents(docs, bench).count() == 2
    assert quality.judge(docs).count() == 5


def test_rows_that_share_an_id(spark):
    """Other texts under one id are other documents; the columns that pass through stay with their rows."""
    one, two = " ".join(f"w{i}" for i in range(80)), " ".join(f"v{i}" for i in range(80))
    rows = [(7, one + "\nx"), (7, two + "\ny\nz"), (9, one + "\nx"), (9, "short"), (7, one + "\nx")]
    docs = spark.createDataFrame([(i, t, n, "k", "l", 2) for n, (i, t) in enumerate(rows)], SCHEMA).repartition(2)
    bench = spark.createDataFrame([(5, two)], "item_id long, text string")
    lines = sorted((r.doc_id, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(docs).collect())
    assert lines == [(7, 2, 0), (7, 2, 2), (7, 3, 0), (9, 1, 0), (9, 2, 2)]
    kept = {r.m: r.text for r in line_dedup.filter_documents(docs).collect()}
    assert kept.keys() in ({0, 1, 3}, {4, 1, 3}) and all(t == rows[n][1] for n, t in kept.items())
    assert sorted((r.doc_id, r.component_id, r.n_shingles) for r in ngram_join.jaccard_components(docs).collect()) == [(7, 7, 77), (7, 7, 77), (7, 7, 78), (9, 7, 77), (9, 9, 1)]
    assert {r.m for r in ngram_join.filter_documents(docs).collect()} in ({0, 1, 3}, {4, 1, 3})
    assert sorted((r.doc_id, r.n_words) for r in suffixes.repeated_passages(docs).collect()) == [(7, 81), (7, 81), (9, 81)]
    assert {r.m: len(r.text) for r in suffixes.drop_copies(docs).collect()}[1] == len(rows[1][1])
    assert sorted((r.doc_id, r.n_items, r.n_near) for r in decontamination.contamination(docs, bench).collect()) == [(7, 0, 0), (7, 0, 0), (7, 1, 1), (9, 0, 0), (9, 0, 0)]
    assert {r.m for r in decontamination.filter_documents(docs, bench).collect()} == {0, 2, 3, 4}


def test_the_other_side_of_each_switch(spark, same_rows, monkeypatch):
    """Nothing broadcast, every key hot, small blocks: the same rows."""
    from tidemark.llm import common, copies

    for module, name, value in (
        (copies, "BROADCAST_IDS", -1), (line_dedup, "BROADCAST_BYTES", -1), (suffixes, "BROADCAST_BYTES", -1), (decontamination, "BROADCAST_TERMS", -1), (decontamination, "BROADCAST_ALIGNMENTS", -1),
        (common, "HOT_ROWS", 1), (line_dedup, "BLOCK_VARIANTS", 5_000), (suffixes, "RANGE", 200), (suffixes, "STEP", 50), (ngram_join, "SMALL", 3), (ngram_join, "HELD", 500), (ngram_join, "WIDE", 4), (common, "SLICE_CHARS", 20_000),
    ):
        monkeypatch.setattr(module, name, value)
    for name in registry.ORACLE_SQL:
        same_rows(registry.QUERIES[name](spark, DATA), registry.ORACLE_SQL[name])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\n\x0béÉZ漢", max_size=30), max_size=6))
def test_word_hashes(texts):
    hashes, ends = word_hashes(pa.array(texts, pa.string()))
    flat = [w for t in texts for w in words(t)]
    assert len(hashes) == len(flat)
    assert ends.tolist() == np.cumsum([len(words(t)) for t in texts]).tolist()
    seen = dict(zip(hashes.tolist(), flat, strict=True))
    assert [seen[h] for h in hashes.tolist()] == flat and len(seen) == len(set(flat))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=30).map(" ".join), max_size=5))
def test_shingle_sets(texts):
    values, ends = shingle_sets(*word_hashes(pa.array(texts, pa.string())))
    assert np.diff(ends, prepend=0).tolist() == [len(shingles(t)) for t in texts]


def similar_pair(common, left, right, rng):
    """Two sets at or above the threshold."""
    if 100 * common < 75 * (common + left + right):
        left, right = min(left, common // 7), min(right, common // 7)
    draw = sorted({rng.getrandbits(64) for _ in range(common + left + right)})
    rng.shuffle(draw)
    return np.sort(np.array(draw[: common + left], np.uint64)), np.sort(np.array(draw[:common] + draw[common + left :], np.uint64))


@settings(max_examples=400, deadline=None)
@given(st.integers(1, 400), st.integers(0, 400), st.integers(0, 400), st.randoms(use_true_random=False))
def test_similar_sets_share_a_signature(common, left, right, rng):
    """PartEnum loses no pair: similar sets have a signature in common, in as many parts as each needs."""
    a, b = similar_pair(common, left, right, rng)
    both = len(np.intersect1d(a, b))
    if 100 * both < 75 * (len(a) + len(b) - both):
        return
    row, part, sig, needs = ngram_join.signatures(np.concatenate((a, b)), np.array([len(a), len(a) + len(b)]))
    p = int(np.floor(np.log2(max(len(a), len(b))))) & 1
    one, two = row == p, row == 2 + p
    shared = set(sig[one].tolist()) & set(sig[two].tolist())
    assert len({x for x, s in zip(part[one].tolist(), sig[one].tolist(), strict=True) if s in shared}) >= max(1, needs[p], needs[2 + p])
    # Also if others have some of them, so that frequent ones are left out.
    df = np.array([1 + (s in shared) * (1 + s % 97) + (s % 3 == 0) * (s % 50) for s in sig.tolist()])
    keep = ngram_join.chosen(row, part, sig, df, needs)
    assert set(sig[keep][row[keep] == p].tolist()) & set(sig[keep][row[keep] == 2 + p].tolist())


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 300), st.integers(0, 60), st.integers(0, 60), st.randoms(use_true_random=False))
def test_sketches_do_not_part_similar_sets(common, left, right, rng):
    a, b = similar_pair(common, left, right, rng)
    x, y = ngram_join.sketches(np.concatenate((a, b)), np.array([len(a), len(a) + len(b)]))
    assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def brute_components(texts):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def test_copies_near_the_threshold(spark):
    """A large group whose members are about as similar as the threshold, passages that many share, copies of copies."""
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(60)]
    base = rng.choices(vocabulary, k=120)
    texts = []
    for _ in range(150):
        copy = list(base)
        for _ in range(rng.choice((0, 1, 2, 3, 4, 5, 6, 8))):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        texts.append(" ".join(copy[: rng.choice((120, 120, 110, 95))]))
    passage = rng.choices(vocabulary, k=60)
    texts += [" ".join(passage + rng.choices(vocabulary, k=rng.randint(5, 60))) for _ in range(60)]
    chain = list(base)
    for _ in range(40):
        chain[rng.randrange(len(chain))] = rng.choice(vocabulary)
        texts.append(" ".join(chain))
    texts += [None, "", "same words", "same words", "Same  WORDS", "a b c d", "a b c d e"] + texts[:5]
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in ngram_join.jaccard_components(table(spark, texts)).collect()}
    parts, sizes = brute_components(texts)
    assert got == {i: (parts[i], sizes[i]) for i in range(len(texts))}


def test_many_texts_just_below_the_threshold(spark):
    """20,000 texts at a similarity of 0.70 to 0.74 round one passage: no links, and pairs in proportion to the texts."""
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(104)]  # 100 shingles
    texts = [" ".join(passage + [f"u{i}x{k}" for k in range(rng.randint(18, 21))]) for i in range(20_000)]  # J = 100 / (100 + 36 to 42)
    made = []
    original = ngram_join._verified

    def counted(docs, pairs, *more):
        made.append(pairs.count())
        return original(docs, pairs, *more)

    ngram_join._verified = counted
    try:
        rows = ngram_join.jaccard_components(table(spark, texts)).where("component_id <> doc_id").count()
    finally:
        ngram_join._verified = original
    assert rows == 0 and sum(made) < 30 * len(texts)


def test_pairs_of_much_shared_text_stay_in_their_group(spark):
    """Texts of chapters that many others have too, similar to few: pairs as many as the square of a group do not become rows."""
    rng = random.Random(11)
    chapters = [" ".join(f"c{k}x{i}" for i in range(20)) for k in range(60)]
    texts = [" ".join(rng.sample(chapters, 6)) for _ in range(900)]
    texts += [f"{t} end{i}" for i, t in enumerate(texts[:100])]  # each similar to one of them
    made = []
    original = ngram_join._verified

    def counted(docs, pairs, *more):
        made.append(pairs.count())
        return original(docs, pairs, *more)

    ngram_join._verified = counted
    try:
        got = {r.doc_id: (r.component_id, r.n_shingles) for r in ngram_join.jaccard_components(table(spark, texts)).collect()}
    finally:
        ngram_join._verified = original
    parts, sizes = brute_components(texts)
    assert got == {i: (parts[i], sizes[i]) for i in range(len(texts))}
    assert sum(made[1:]) < len(texts)


def test_only_pairs_whose_sketches_meet_bring_their_sets(spark, monkeypatch):
    """Texts that share signatures and yet too little, also in the first comparison: their sets are not moved."""
    from pyspark.sql import functions as F

    rng = random.Random(13)
    chapters = [" ".join(f"c{k}x{i}" for i in range(20)) for k in range(60)]
    texts = [" ".join(rng.sample(chapters, 6)) for _ in range(600)]
    texts += [f"{t} end{i}" for i, t in enumerate(texts[:100])]
    asked, moved = [], []
    original = ngram_join.join_counted

    def counted(rows, groups, on):
        if "x" in groups.columns:
            sketches = groups.where(F.octet_length("x") != ngram_join.SKETCH // 8).isEmpty()
            (asked if sketches else moved).append(rows.count())
        return original(rows, groups, on)

    monkeypatch.setattr(ngram_join, "join_counted", counted)
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in ngram_join.jaccard_components(table(spark, texts)).collect()}
    parts, sizes = brute_components(texts)
    assert got == {i: (parts[i], sizes[i]) for i in range(len(texts))}
    assert sum(asked) > len(texts) and 100 <= sum(moved) < len(texts) // 2, (asked, moved)


def rows_made(df, kind):
    """How many rows the nodes of a kind made in the plan of df, which runs here."""
    df.collect()
    nodes, total = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            nodes.append(node.executedPlan())
        elif "QueryStage" in name:
            nodes.append(node.plan())
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
        if name.startswith(kind):
            total += node.metrics().apply("pythonNumRowsReceived").value()
    return total


def test_pairs_of_many_blocks_become_rows_once(spark, tmp_path):
    """Near copies share signatures in very many blocks; each pair of the stars is one row, not one for each block."""
    from pyspark.sql import functions as F

    rng = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(1_000):
        copy = list(base)
        copy[rng.randrange(len(copy))] = f"u{rng.randrange(10**9)}"
        texts.append(" ".join(copy))
    blocks, heaps = 60, 8
    ngram_join._members(table(spark, texts), blocks).withColumn("c", F.col("doc_id")).repartition(50, "doc_id").write.parquet(f"{tmp_path}/members")
    members = spark.read.parquet(*map(str, tmp_path.glob("members/*.parquet")))
    stars = ngram_join._stars(members, "many", blocks, alone=True)
    made = rows_made(stars, "FlatMapGroupsInArrow")
    pairs = [tuple(r) for r in stars.collect()]
    assert len(pairs) == len(set(pairs)) >= len(texts) - 1
    assert made <= len(pairs) + blocks * heaps


def test_asking_takes_little_memory():
    """What an owner asks is made in a small multiple of its keys, of which it holds a bounded number."""
    import tracemalloc

    rng = np.random.default_rng(3)
    n, docs = ngram_join.HELD, 4_000
    x = {"docs": np.arange(docs), "m": np.full(docs, 200), "c": np.zeros(0, np.int64), "needs": np.zeros(2 * docs, np.int64)}
    x |= {"who": np.sort(rng.integers(0, docs, n)).astype(np.uint16), "part": rng.integers(0, 300, n).astype(np.uint32), "keys": rng.integers(0, 2**64, n, dtype=np.uint64)}
    tracemalloc.start()
    rows = ngram_join._asks(0, x, 12)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows.num_rows == 13 and peak < 60_000_000


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(5, 5)]
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute_lines(texts, least=20):
    found = [(i, j, line_dedup.normal_form(x.encode())) for i, t in enumerate(texts) if t is not None for j, x in enumerate(t.split("\n"))]
    found = [x for x in found if x[2]]
    gone = defaultdict(set)
    for n, (i, j, form) in enumerate(found):
        if any(form == f or min(len(form), len(f)) >= least and abs(len(form) - len(f)) <= 1 and distance(form, f) <= 1 for _, _, f in found[:n]):
            gone[i].add(j)
    return gone


def test_lines_against_brute_force(spark):
    rng = random.Random(4)
    pool = ["".join(rng.choices("abé ", k=rng.randint(15, 40))) for _ in range(25)]
    texts = []
    for _ in range(40):
        lines = []
        for x in rng.choices(pool, k=4):
            at = rng.randrange(len(x))
            lines.append(rng.choice((x, x.upper(), x[:at] + rng.choice("abx漢") + x[at + 1 :], x[:at] + x[at + 1 :], x[:at] + "q" + x[at:], "short")))
        texts.append("\n".join(lines))
    texts += [None, "", "\n", texts[0], "z" * 5000 + "\n" + "z" * 5001 + "\n" + "z" * 5003]
    gone = brute_lines(texts)
    rows = {r.doc_id: r for r in line_dedup.dedup_lines(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        expected = None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone[i])
        assert (rows[i].text, rows[i].n_removed) == (expected, len(gone[i]))
    kept = line_dedup.filter_documents(table(spark, texts))
    assert kept.columns == table(spark, texts).columns
    whole = {i for i, t in enumerate(texts) if not gone[i] or rows[i].text.strip()}
    assert {r.doc_id for r in kept.collect()} == whole


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab", min_size=3, max_size=12), st.text(alphabet="ab", min_size=3, max_size=12))
def test_close_forms_share_a_half_and_a_variant(a, b):
    if a != b and distance(a, b) <= 1:
        assert line_dedup.half_keys(a) & line_dedup.half_keys(b)
        assert set(line_dedup.variants(a).tolist()) & set(line_dedup.variants(b).tolist())


def test_passages_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(30)]
    shared = [rng.choices(vocabulary, k=n) for n in (49, 50, 51, 80, 200)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60)) + rng.choice(shared) + rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(60)]
    texts += [None, "", "q " * 200, " ".join(shared[4]), " ".join(shared[1])] + [" ".join(shared[3])] * 3
    seen = defaultdict(int)
    for t in texts:
        w = words(t)
        for i in range(len(w) - 49):
            seen[tuple(w[i : i + 50])] += 1
    expected = {}
    for i, t in enumerate(texts):
        w = words(t)
        hit = {p for s in range(len(w) - 49) if seen[tuple(w[s : s + 50])] > 1 for p in range(s, s + 50)}
        if hit:
            expected[i] = hit
    docs = table(spark, texts)
    got = defaultdict(set)
    for r in suffixes.repeated_passages(docs).collect():
        assert r.n_words == r.stop - r.start >= 50
        got[r.doc_id] |= set(range(r.start, r.stop))
    assert got == expected
    left = {r.doc_id: r.text for r in suffixes.drop_copies(docs).collect()}
    assert len(left) == len(texts) and left[60] is None
    for passage in shared[1:]:  # one copy of each passage stays
        assert any(" ".join(passage) in (t or "") for t in left.values())


def test_decontamination_against_brute_force(spark):
    rng = random.Random(6)
    vocabulary = ["the", "of", "a", *(f"t{i}" for i in range(25)), "é", "9"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice((3, 9, 10, 11, 30))))) for i in range(20)] + [(20, None), (21, "!!"), (3, "the of")]
    texts = []
    for _ in range(60):
        w = rng.choices(vocabulary, k=40)
        item = rng.choice(items[:20])[1].split()
        cut = rng.randint(0, len(item))
        w[10:10] = item[cut:] if rng.random() < 0.5 else item
        texts.append(rng.choice((" ", ", ", "\n")).join(w).upper())
    texts += [None, "", "!?"]
    pattern = re.compile("[0-9a-z\x80-\U0010ffff]+")
    windows = defaultdict(set)
    for k, t in items:
        w = pattern.findall(low(t))
        for s in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows[tuple(w[s : s + min(10, len(w))])].add(k)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = {r.doc_id: r for r in decontamination.contamination(table(spark, texts), bench).collect()}
    for i, t in enumerate(texts):
        w, hit, found = pattern.findall(low(t)), set(), set()
        for n in range(1, 11):
            for s in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[s : s + n])):
                    found |= ids
                    hit |= set(range(s, s + n))
        assert (rows[i].n_words, rows[i].n_hit, rows[i].n_items, rows[i].contaminated) == (len(w), len(hit), len(found), bool(hit))
    clean = decontamination.filter_documents(table(spark, texts), bench)
    assert {r.doc_id for r in clean.collect()} == {i for i in rows if not rows[i].contaminated}


def test_near_matches(spark):
    bench = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    docs = table(spark, ["blue x red y green", "red " + "x " * 50 + "green blue", None])
    assert [tuple(r) for r in decontamination.near_matches(docs, bench).collect()] == [(0, 1)]


def test_near_matches_with_absent_terms(spark):
    """A word that the documents lack is not among an item's rarest, nor does an item match by fewer terms than it needs."""
    bench = spark.createDataFrame([(1, "red green blue zyx"), (2, "red zyx"), (3, "zyx"), (4, "red")], "item_id long, text string")
    docs = table(spark, ["blue x red y green", "red " + "x " * 50 + "green blue", None])
    assert sorted(map(tuple, decontamination.near_matches(docs, bench).collect())) == [(0, 1), (0, 4), (1, 4)]


def test_near_matches_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"t{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice((1, 2, 3, 12))))) for i in range(15)] + [(3, "t1 t2 zz"), (15, None)]
    texts = [" ".join(rng.choices(vocabulary[: rng.choice((20, 60))], k=rng.randint(0, 120))) for _ in range(50)] + [None, ""]
    counts = defaultdict(int)
    for t in texts:
        for w in (t or "").split():
            counts[w] += 1
    expected = set()
    for k, t in items:
        terms = set((t or "").split())
        chosen = set(sorted((w for w in terms if counts[w]), key=lambda w: (counts[w], w))[:3])
        for i, text in enumerate(texts):
            w = (text or "").split()
            if terms and any(len(chosen & set(w[s : s + 30])) >= min(3, len(terms)) for s in range(len(w))):
                expected.add((i, k))
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), table(spark, texts)
    assert set(map(tuple, decontamination.near_matches(docs, bench).collect())) == expected
    found = {r.doc_id: r.n_near for r in decontamination.contamination(docs, bench).collect()}
    assert found == {i: len({k for d, k in expected if d == i}) for i in range(len(texts))}


def test_short_lines_repeat_exactly(spark):
    long = "a line that has more than twenty characters"
    docs = table(spark, [f"Read more\n\n{long}", f"read  more\nRead mores\n\n{long}s", "}\n}\nRead more", None])
    texts = lambda **k: {r.doc_id: r.text for r in line_dedup.dedup_lines(docs, **k).collect()}
    assert texts() == {0: f"Read more\n\n{long}", 1: "Read mores\n", 2: "}", 3: None}
    assert texts(exact_chars=5) == {0: f"Read more\n\n{long}", 1: "Read mores\n", 2: "}\n}", 3: None}
    assert texts(exact_chars=20) == {0: f"Read more\n\n{long}", 1: "read  more\nRead mores\n", 2: "}\n}\nRead more", 3: None}


def test_lines_of_white_space_only(spark):
    docs = table(spark, ["a line", "a line\n \t\n\r", "a line\n", " \n"])
    assert {r.doc_id: r.text for r in line_dedup.filter_documents(docs).collect()} == {0: "a line", 3: " \n"}


def test_a_document_of_a_million_lines(spark):
    import time

    text = "the line that comes again and again\n" * 1_000_000 + "end"
    docs = spark.createDataFrame([(1, text), (2, "end")], "doc_id long, text string")
    began = time.perf_counter()
    assert sorted(tuple(r) for r in line_dedup.dedup_lines(docs).collect()) == [(1, 1_000_001, 999_999, "the line that comes again and again\nend"), (2, 1, 1, "")]
    assert time.perf_counter() - began < 120


def test_cascade(spark):
    good = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i % 7)}" for i in range(60))
    texts = [good, good.upper(), " ".join(w + "###" for w in good.split()), "few words", None, "", "\n".join(["the same line again"] * 12)]
    docs = table(spark, texts)
    rows = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert [rows[i].kept for i in range(len(texts))] == [True, False, False, False, False, False, False]
    assert rows[3].rejected_by == rows[4].rejected_by == "base"
    assert [r.doc_id for r in quality.filter_documents(docs).collect()] == [0]
    assert quality.filter_documents(docs).columns == docs.columns
    # What the first rule rejects does not count for the others.
    rejected = {("slow", "fast"): 90, ("slow",): 5, ("fast",): 10, ("third",): 4, (): 100}
    assert quality.ordered({"slow": 1.0, "fast": 0.5, "third": 0.4, "never": 0.1}, rejected) == ["fast", "third", "slow", "never"]
    seconds, rejected = quality.measure(docs)
    assert set(seconds) == {n for n, _ in quality.RULES} and all(x > 0 for x in seconds.values()) and sum(rejected.values()) == len(texts)
    assert rejected == {k: n for k, n in rejected.items() if set(k) <= set(seconds)}


def test_the_sample_is_few_files(spark, monkeypatch):
    """However many shuffle partitions there are, and however little is put together again."""
    few, written, real = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}, [], quality.materialize
    monkeypatch.setattr(quality, "materialize", lambda df, name: written.append(real(df, name)) or written[-1])
    before = {k: spark.conf.get(k) for k in few}
    try:
        for k, v in few.items():
            spark.conf.set(k, v)
        _, rejected = quality.measure(table(spark, [f"some words of the text {i}" for i in range(300)]))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(written[0].inputFiles()) <= quality.SAMPLE_FILES and sum(rejected.values()) == written[0].count() == 300


def test_rules_on_a_very_long_text(spark):
    rng = random.Random(9)
    text = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(200_000))
    rows = {r.doc_id: r for r in quality.judge(table(spark, [text, text + " #" * 10])).collect()}
    assert (rows[0].n_words, rows[0].word_chars, rows[0].n_repeat_words, rows[0].kept) == (200_000, 1_200_000, 0, True)
    assert (rows[1].n_symbols, rows[1].n_repeat_words) == (10, 10)
