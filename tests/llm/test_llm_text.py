"""Deduplication, joins and packing against brute force, on the sample and on small awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from dataclasses import replace

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tallyhouse.llm import partenum, seed_extend, suffix_array
from tallyhouse.llm.exact_dedup import exact_dedup
from tallyhouse.llm.mixing import find_exponent, mix, source_totals, with_dimension
from tallyhouse.llm.packing import Letters, UNUSUAL, encoder, pack, piece_lengths, token_ids, write_buckets
from tallyhouse.llm.partenum import difference, similar_components
from tallyhouse.llm.queries import CHECKS, QUERIES
from pyspark.sql import functions as F

WORD = re.compile(r"[^ \t-\r]+")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
#: nulls in every column, empty and blank texts, a very long one, ties, repeated rows, clashing names
AWKWARD = [
    (1, "a b  c", "s", 3, "z"), (2, "abc", None, 3, "z"), (3, "ab c", "s", None, None), (4, None, "s", 0, "z"), (5, "", "t", 0, "z"), (6, " \t\n", "t", 0, "z"),
    (None, "null id", "s", 7, "z"), (None, None, None, None, None), (7, LONG, "s", 1, "z"), (8, LONG + " end", "s", 1, "z"), (9, "x y", "t", 3, "z"), (9, "x y", "t", 3, "z"), (10, "x\ny", "t", 3, "z")]
SCHEMA = "doc_id bigint, text string, source string, n_chars bigint, kept string, _rank int, anchors string, tokens string, score string, text_sha256 string, bucket string, key string, spans string"


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(*r, 1, "a", "t", "s", "h", "b", "k", "p") for r in AWKWARD], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", list(CHECKS))
def test_query_matches_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = con.execute(CHECKS[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, small).select(columns).collect()
    assert Counter(map(tuple, got)) == Counter(want.fetchall())


# exact deduplication
def test_exact_awkward(awkward, none):
    got = exact_dedup(awkward).collect()
    assert len(got) == len(AWKWARD) and exact_dedup(none).count() == 0
    kept = [(r.doc_id, r.group_size) for r in got if r.kept]
    # a b  c (most code points) of three; the blank text of the four empty ones; one of the repeated rows and its tie
    assert Counter(kept) == Counter([(1, 3), (6, 4), (None, 1), (7, 1), (8, 1), (9, 3)])
    assert {r.keep_id for r in got if r.doc_id in (2, 3)} == {1}
    assert got[0]["anchors"] == "a"


def test_exact_heavy_hitters(spark):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot text")).otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text")).repartition(9)
    got = exact_dedup(many)
    hot = got.where("group_size > 1").collect()
    assert len(hot) == 1000 and {r.keep_id for r in hot} == {0} and sum(r.kept for r in hot) == 1 and got.where("kept").count() == 2001


# packing
PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_packing_round_trip(docs, texts):
    pieces = defaultdict(list)
    got = pack(docs, PATH).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    for r in got:
        assert r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0 and r.length == len(r.ids) // 4 == 1 << r.bucket
        pieces[r.doc_id].append((r.start, bytes(r.ids), r.doc_tokens))
    t = encoder(PATH)[0]
    for doc_id, text in texts:
        want = t.encode(text or "", add_special_tokens=False).ids + [1]
        rows = sorted(pieces.pop(doc_id))
        assert np.frombuffer(b"".join(ids for _, ids, _ in rows), "<u4").tolist() == want
        at = 0
        for start, ids, n in rows:
            assert (start, n) == (at, len(want))
            at += len(ids) // 4
    assert not pieces


def test_packing_texts_out_of_the_ordinary(awkward, none, tmp_path):
    t = encoder(PATH)[0]
    for text in ("a <|endoftext|> b", "日本 語 x  y", "it's  we'll \n\n x\xa0 1²", " lead", "\x85x", LONG + " 日"):
        assert np.frombuffer(token_ids(PATH, text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids + [1]
    assert sum(piece_lengths(5000)) == 5000 and piece_lengths(1) == [1] and piece_lengths(2048) == [2048]
    got = pack(awkward, PATH)
    assert got.where("doc_id in (4, 5)").select("length").collect() == [(1,), (1,)] and got.where("doc_id = 9").count() % 2 == 0
    assert pack(none, PATH).count() == 0
    write_buckets(got, str(tmp_path / "buckets"))
    assert {p.name for p in (tmp_path / "buckets").glob("bucket=*")} == {f"bucket={r.bucket}" for r in got.select("bucket").distinct().collect()}


def test_packing_spells_each_character_once(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder.cache_clear()
    t, _, words = encoder(path)
    text = "".join(chr(c) for c in range(256) if UNUSUAL.search(chr(c)) is None)
    for x in (text, text[::-1], " ".join(text), " aé ñoñ" * 50):
        assert token_ids(path, x)[:-4] == np.asarray(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes()
    letters = next(c.cell_contents for c in words.encode.__closure__ if isinstance(c.cell_contents, Letters))
    monkeypatch.setattr(letters, "spell", None)  # every character is known, so no new word asks the tokenizer how it is spelled
    assert words.encode(" ñaé") == t.encode(" ñaé", add_special_tokens=False).ids
    encoder.cache_clear()


def test_packing_query_digest(spark, small, texts):
    t, first = encoder(PATH)[0], dict(texts)
    for r in QUERIES["op2_packing"](spark, small).limit(50).collect():
        ids = (t.encode(first[r.doc_id] or "", add_special_tokens=False).ids + [1])[r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


# substring deduplication
def words_left(rows, threshold=20):
    first, out = set(), []
    for i, text in sorted(rows, key=lambda r: r[0]):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for p in range(len(words) - threshold + 1):
            window = tuple(words[p:p + threshold])
            if window in first:
                gone[p:p + threshold] = [True] * threshold
            first.add(window)
        out.append((i, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return Counter(out)


def bytes_left(rows, threshold=200):
    raw = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[p:p + threshold] for _, b in raw for p in range(len(b) - threshold + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - threshold + 1):
            if count[b[p:p + threshold]] > 1:
                gone[p:p + threshold] = True
        out.append((i, len(b), int(gone.sum()), np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return Counter(out)


def periodic(seed, letters, sizes, rare):
    """Few letters and long runs: repeats within a text, overlapping ones, periods."""
    r = random.Random(seed)
    return [(i, "".join(r.choice(letters) if r.random() < rare else letters[0] for _ in range(r.choice(sizes)))) for i in range(60)] + [(900, None), (901, "")]


def test_words_match_brute_force(spark, docs, texts):
    rows = periodic(3, ["a ", "b ", "é "], [5, 19, 20, 21, 60, 200], 0.05)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    seen = lambda d, rule=seed_extend.RULE: Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in seed_extend.deduplicate(d, rule).collect())
    assert seen(docs) == words_left(texts)
    assert seen(frame) == words_left(rows) == seen(frame, replace(seed_extend.RULE, chunk=300))


def test_bytes_match_brute_force(spark, docs, texts):
    rows = periodic(4, "abé", [5, 199, 200, 201, 600], 0.01) + [(902, "xy" * 300)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    seen = lambda d, rule=suffix_array.RULE, shard=1 << 18: Counter((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in suffix_array.deduplicate(d, rule, shard).collect())
    assert seen(docs) == bytes_left(texts)
    assert seen(frame) == bytes_left(rows) == seen(frame, replace(suffix_array.RULE, chunk=700), 1000)


def test_common_anchor_is_parted(spark, monkeypatch):
    from tallyhouse.llm import anchors
    monkeypatch.setattr(anchors, "COMMON", 1)
    rows = periodic(5, ["a ", "b ", "c "], [40, 90], 0.3)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    rule = replace(seed_extend.RULE, chunk=200)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in seed_extend.deduplicate(frame, rule).collect()) == words_left(rows)


def test_substrings_awkward(awkward, none):
    words = {r.doc_id: r for r in seed_extend.deduplicate(awkward).collect() if r.doc_id}
    assert (words[7].n_removed, words[8].n_removed, words[8].kept) == (0, 30_000 - 0, "end") and words[4].n_words == 0
    raw = {r.doc_id: r for r in suffix_array.deduplicate(awkward).collect() if r.doc_id}
    assert raw[7].n_removed == len(LONG) and bytes(raw[8].kept) == b" end" and raw[8].spans == [0, len(LONG)]
    for d in (seed_extend, suffix_array):
        assert d.deduplicate(awkward).count() == len(AWKWARD) and d.deduplicate(none).count() == 0


@pytest.mark.parametrize("buckets", [0, 1024])
def test_induced_sort(monkeypatch, buckets):
    """A bucket and a suffix at a time; with letters that occur once, and long runs of one letter."""
    monkeypatch.setattr(suffix_array, "BUCKETS", buckets)
    r = random.Random(1)
    for _ in range(300):
        s = [r.choice([1, 2, 3][:r.choice([1, 2, 3])]) + 5 for _ in range(r.choice([0, 1, 5, 40, 200]))]
        ends = sorted(r.sample(range(len(s) + 1), r.choice([0, 0, 1, 2, 4]) if len(s) > 4 else 0), reverse=True)
        marks = [k for k in range(1, len(ends) + 1)]
        r.shuffle(marks)
        for e, k in zip(ends, marks):
            s.insert(e, k)
        s.append(0)
        # letters below ``single`` occur once each
        s = [x if x < 5 else x - 5 + len(ends) for x in s]
        sa = suffix_array.induced_sort(np.array(s), 4 + len(ends), len(ends) + 1).tolist()
        assert sa == sorted(range(len(s)), key=lambda i: s[i:])
        shared = suffix_array.common_prefixes(np.array(s), np.array(sa)).tolist()
        assert shared[sa[0]] == 0
        for a, b in zip(sa, sa[1:]):
            n = shared[b]
            assert s[a:a + n] == s[b:b + n] and s[a + n:a + n + 1] != s[b + n:b + n + 1]


# n-gram Jaccard join
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def linked(rows):
    sets = {}
    for i, text in rows:
        w = re.findall(rb"[^ \t-\r]+", (text or "").encode().translate(LOWER))
        sets[i] = frozenset(tuple(w[p:p + 5]) for p in range(max(1, len(w) - 4))) if w else frozenset()
    root, held = {i: i for i in sets}, defaultdict(list)

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i in sorted(sets):
        common = Counter(j for g in sets[i] for j in held[g])
        for g in sets[i]:
            held[g].append(i)
        for j, n in common.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(seed, groups=10, members=12):
    r, rows = random.Random(seed), []
    for _ in range(groups):
        base = [r.choice("ABcdefgh") + str(r.randrange(50)) for _ in range(r.choice([3, 6, 12, 30, 80, 200]))]
        for _ in range(members):
            b = base[:]
            for _ in range(r.randrange(0, max(2, len(b) // 12))):
                b[r.randrange(len(b))] = str(r.random())
            rows.append((len(rows), " ".join(b)))
    return rows + [(500, None), (501, ""), (502, " \n"), (503, "x"), (504, "X")]


def test_join_matches_brute_force(spark, docs, texts):
    seen = lambda d: {r.doc_id: (r.n_shingles, r.component_id) for r in similar_components(d).collect()}
    assert seen(docs) == linked(texts)
    rows = near_copies(2)
    assert seen(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)) == linked(rows)


def test_group_of_near_sets_is_joined_by_a_tree():
    """A group's members, all alike and each in a component of its own: a pair less than members, not all pairs; and all pairs without ``tree``."""
    m = 60
    rng = np.random.default_rng(1)
    sketch = rng.integers(0, 1 << 62, partenum.SKETCH)
    columns = {"sig": [7] * m, "i": [0] * m, "j": [0] * m, "block": [0] * m, "key": list(range(m)), "root": list(range(m)), "n": [200] * m,
               "sketch": [[int(sketch[0]) ^ (1 << k % 50), *map(int, sketch[1:])] for k in range(m)]}
    batch = pa.RecordBatch.from_pydict(columns, schema=pa.schema([(c, pa.list_(pa.int64()) if c == "sketch" else pa.int32() if c in "ij" or c == "block" else pa.int64()) for c in columns]))
    rows = lambda **k: [tuple(r.values()) for b in partenum._across(80, iter([batch]), **k) for r in b.to_pylist()]
    assert len(rows()) == m * (m - 1) // 2
    tree = rows(tree=True)
    assert len(tree) == m - 1
    joined = {0}
    for _ in range(m):
        joined |= {x for pair in tree if joined & set(pair) for x in pair}
    assert joined == set(range(m))


def test_groups_tell_whether_their_tree_leaves_pairs_out():
    """Three alike: the tree has two of three pairs; two alike, and four of which two pairs are alike: it has them all, so no later round needs these groups."""
    rng = np.random.default_rng(3)
    one, other = (rng.integers(0, 1 << 62, partenum.SKETCH).tolist() for _ in "ab")
    groups = [(5, 1, one), (5, 2, one), (5, 3, one), (6, 1, one), (6, 2, one), (7, 1, one), (7, 2, one), (7, 8, other), (7, 9, other)]
    of = lambda f, t=pa.int64(): pa.array([f(*g) for g in groups], t)
    zero = of(lambda *_: 0, pa.int32())
    columns = {"sig": of(lambda g, k, s: g), "i": zero, "j": zero, "block": zero, "key": of(lambda g, k, s: k), "root": of(lambda g, k, s: k),
               "n": of(lambda *_: 200), "sketch": of(lambda g, k, s: s, pa.list_(pa.int64()))}
    batch = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    names = ("sig", "hub", "key", "rest")
    got = [tuple(r.values()) for b in partenum._across(80, iter([batch]), True, names) for r in b.to_pylist()]
    assert got == [(5, 1, 2, True), (5, 1, 3, True), (6, 1, 2, False), (7, 1, 2, False), (7, 8, 9, False)]


def test_join_makes_one_set_of_a_node_and_none_of_another_text(spark):
    """Copies under other ids are not read for a link; another text with the id and hash that a set is looked up by is not taken for it."""
    a, b, alien = (" ".join(f"w{i + s}" for i in range(200)) for s in (0, 2, 900))
    texts = [(1, 11, a), (2, 12, b), (1, 11, alien), *((n, 11, a) for n in range(50, 60))]
    rows = spark.createDataFrame([(i, t, k) for i, k, t in texts], "doc_id bigint, text string, text_key bigint")
    ka, kb = (int(partenum.keys_of(*partenum.sets_of([t.encode()]))[0]) for t in (a, b))
    nodes = spark.createDataFrame([(ka, (False, 1, 11)), (kb, (False, 2, 12))], "key bigint, head struct<none: boolean, id: bigint, text: bigint>")
    made = partenum._sets
    seen = spark.sparkContext.accumulator(0)

    def counted(words, batches):
        for batch in made(words, batches):
            seen.add(batch.num_rows)
            yield batch

    partenum._sets = counted
    try:
        links = partenum._links(spark.createDataFrame([(ka, kb)], "hub bigint, key bigint"), rows, nodes, 5, 80).collect()
    finally:
        partenum._sets = made
    assert [(r.hub, r.key) for r in links] == [(ka, kb)] and seen.value == 2


def test_join_awkward(awkward, none):
    got = Counter((r.doc_id, r.component_id) for r in similar_components(awkward).collect())
    assert got[(8, 7)] == 1 and got[(10, 9)] == 1 and got[(9, 9)] == 2 and got[(4, 4)] == 1 and sum(got.values()) == len(AWKWARD)
    assert similar_components(none).count() == 0
    for a in range(1, 60):
        for b in range(a, 60):
            for both in range(a + 1):
                if 100 * both >= 80 * (a + b - both):
                    assert a + b - 2 * both <= difference(a, b, 80)


# mixing
def test_mixing_uses_every_document_and_keeps_its_limits(spark, docs):
    many = docs.unionByName(docs.where("source = 'src0'").withColumn("doc_id", F.col("doc_id") + 10_000)).withColumn("source", F.when(F.col("doc_id") % 2 == 0, "big").otherwise(F.col("source")))
    got = mix(many, repeats=2.0)
    assert got.select("doc_id").distinct().count() == many.count()
    uses = got.groupBy("source").agg(F.sum("tokens").alias("t")).join(got.where("block = 0").groupBy("source").agg(F.sum("tokens").alias("all")), "source").collect()
    assert max(r.t / r["all"] for r in uses) < 2.1
    # places follow hashes: in the last, partial block they end near 1, where the budget does
    places = got.groupBy("source").agg(F.min("place").alias("a"), F.max("place").alias("z"), F.avg("place").alias("m")).collect()
    assert all(0 <= r.a <= r.z < 2 for r in places) and all(0.4 < r.m < 0.6 for r in places if r.source == "big")


def test_mixing_meets_entropy_and_budget(spark):
    rows = [(i, "w " * 10, "a" if i % 10 else "b") for i in range(2000)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(6)
    totals = source_totals(d.select(F.size(F.split(F.trim("text"), " ")).cast("bigint").alias("tokens"), F.col("source").alias("_source")))
    e = find_exponent(totals, entropy=0.9)
    p = np.array([0.9, 0.1]) ** e
    p /= p.sum()
    assert abs(-(p * np.log(p)).sum() / np.log(2) - 0.9) < 1e-6
    got = mix(d, entropy=0.9, budget=10_000).groupBy("source").agg(F.sum("tokens").alias("t")).collect()
    assert {r.source: r.t for r in got} == {"a": pytest.approx(p[0] * 10_000, abs=10), "b": pytest.approx(p[1] * 10_000, abs=10)}


def test_mixing_awkward(spark, awkward, none):
    got = mix(awkward, repeats=2.0)
    assert got.where("block = 0").count() == len(AWKWARD) and mix(none, repeats=2.0).count() == 0
    empty = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id bigint, text string, source string")
    assert sorted((r.doc_id, r.block) for r in mix(empty, entropy=0.9).collect()) == [(1, 0), (2, 0)]
    wide = spark.range(50).select((F.col("id") % 9).alias("k"), "id")
    dim = spark.range(9).select(F.col("id").alias("k"), F.lit(1 / 9).alias("share"), (F.col("id") * 2).alias("v"))
    for most in (3, 8, 100):  # shuffled, part broadcast, broadcast
        assert sorted((r.id, r.v) for r in with_dimension(wide, dim, "k", 9, most).collect()) == [(i, i % 9 * 2) for i in range(50)]


def test_digests(spark, small):
    r = QUERIES["op8_seed_extend"](spark, small).where("n_words = n_removed").first()
    assert r is None or r.kept_sha256 == hashlib.sha256(b"").hexdigest()
    got = QUERIES["op10_suffix_array"](spark, small)
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}
