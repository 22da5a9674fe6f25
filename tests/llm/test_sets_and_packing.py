"""Jaccard join, token store, packing, sharding against brute-force versions."""

import functools
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from noteloom.llm import extendible, jaccard_join, packing
from noteloom.llm.components import connected, join_hot
from noteloom.llm.extendible import shard_documents, write_shards
from noteloom.llm.queries import BYTE_BPE, ORACLES, QUERIES, WORD_BPE
from noteloom.llm.token_store import PerfectHash, Shard, read_store, write_store
from noteloom.llm.tokenids import encoder

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


@functools.cache
def library(path):
    return Tokenizer.from_file(path)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    """Of rows (doc_id, text), in their order: (n_shingles, component_id, n_links)."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))
    links = [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                parent[root(i)] = root(j)
                links[i] += 1
                links[j] += 1
    least = {}
    for i, (key, _) in enumerate(rows):
        least[root(i)] = min((k for k in (key, least.get(root(i))) if k is not None), default=None)
    return [(len(sets[i]), least[root(i)], links[i]) for i in range(len(rows))]


def joined(documents, *names):
    return [tuple(r) for r in jaccard_join.near_duplicates(documents).select("doc_id", "n_shingles", "component_id", "n_links", *names).collect()]


def test_near_duplicates(spark, docs, corpus, no_docs):
    rows = [(r[0], r[1]) for r in corpus]
    assert sorted(joined(docs)) == sorted((key, *x) for (key, _), x in zip(rows, brute_components(rows)))
    assert joined(no_docs) == []


def test_near_duplicates_with_null_and_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (5, a + " more"), (None, a), (None, b), (None, b + " more"), (3, c), (3, None), (4, ""), (None, ""), (3, "x y"), (9, "x y"), (7, c + " z")] + [(8, b.upper())] * 3
    got = joined(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(got) == Counter((key, *x) for (key, _), x in zip(rows, brute_components(rows)))
    classes = joined(spark.createDataFrame([(None, a), (None, b), (None, a), (None, None)], "doc_id long, text string"), "class_id")
    assert len({x[-1] for x in classes}) == 3 and all(x[2] is None for x in classes)


def test_groups_cut_into_chunks_lose_no_link(spark, docs, corpus):
    table = jaccard_join.set_table(docs)
    weights = table.where("n > 0").groupBy("set_id").agg(F.count("*").alias("weight"))
    whole = jaccard_join.set_components(docs, table, weights)
    parted = jaccard_join.set_components(docs, table, weights, group_shingles=300)
    assert {tuple(sorted(x)) for x in _groups(whole)} == {tuple(sorted(x)) for x in _groups(parted)} and whole.count()
    links = [{r["set_id"]: r["links"] for r in x.collect() if r["links"]} for x in (whole, parted)]
    assert links[0] and links[0] == links[1]


def _groups(found):
    out = defaultdict(set)
    for r in found.collect():
        out[r["component"]] |= {r["set_id"], r["component"]}
    return out.values()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), min_size=1, max_size=25), min_size=1, max_size=12))
def test_link_group(lists):
    sets = [np.array(sorted(set(x)), np.uint64) for x in lists]
    size = np.array([len(x) + len(x) % 3 for x in sets])  # some shingles that no other set holds
    got, links = jaccard_join.link_group(sets, size, np.arange(len(sets)) + 1)
    least = [0] * len(sets)
    parent = list(range(len(sets)))
    root = lambda i: i if parent[i] == i else root(parent[i])
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if 100 * both >= 75 * (size[i] + size[j] - both):
                parent[root(i)] = root(j)
                least[i] += j + 1
                least[j] += i + 1
    assert links.tolist() == least
    for i in range(len(sets)):
        for j in range(i):
            assert (got[i] == got[j]) == (root(i) == root(j))


def test_components_of_a_path_and_hot_keys(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100 == got[100]
    rows = spark.range(3000).select((F.when(F.col("id") < 2000, 1).otherwise(F.col("id"))).alias("k"))
    assert join_hot(rows, spark.createDataFrame([(1, "x"), (2500, "y")], "k long, v string"), "k").groupBy("v").count().where("v is not null").collect().__len__() == 2


@pytest.mark.parametrize(("path", "spaces"), [(WORD_BPE, False), (BYTE_BPE, True)])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from([*"ab's 1_.Éßÿ÷\n\t\xa0\u0301\u3000Σ!<|>", "  ", "<|endoftext|>", "don't"]), max_size=25).map("".join), min_size=1, max_size=5))
def test_pieces_give_the_tokenizers_ids(path, spaces, texts):
    ids, at = encoder(path, spaces).encode(pa.array(texts))
    want = library(path).encode_batch(texts, add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [w.ids for w in want]


def test_token_store(spark, docs, corpus, no_docs):
    folder, manifest = write_store(docs, WORD_BPE, end_id=1, shard_ids=20_000)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in read_store(docs, folder, manifest).collect()}
    t, at, want = Tokenizer.from_file(WORD_BPE), 0, {}
    for key, text, *_ in sorted(corpus):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        want[key] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert got == want
    unknown = spark.createDataFrame([(10**9,), (-5,)], "doc_id long")
    assert read_store(unknown, folder, manifest).count() == 0
    shard = Shard(folder, manifest.orderBy("first_key").first()["shard"])
    assert [len(shard.locate(np.array([key]))[0]) for key in (0, 10**12)] == [1, 0]
    empty, none = write_store(no_docs, WORD_BPE, end_id=1)
    assert read_store(docs, empty, none).count() == 0


def test_token_store_with_repeated_and_null_keys(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "c d e"), (2, "c"), (None, "d"), (None, "d e"), (3, None)] + [(4, "x " * (i % 7)) for i in range(500)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for limit in (1 << 20, 300):  # in the second store key 4 goes on through several shards
        folder, manifest = write_store(table, WORD_BPE, end_id=1, shard_ids=limit)
        got = sorted(map(tuple, read_store(table, folder, manifest).select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
        assert [x[0] for x in got] == np.cumsum([0] + [x[2] for x in got])[:-1].tolist()
        keys = [-1 if x[1] is None else x[1] for x in got]
        assert keys == sorted(keys)
        ids = [(key, library(WORD_BPE).encode(text or "", add_special_tokens=False).ids + [1]) for key, text in rows]
        assert Counter(x[1:] for x in got) == Counter((key, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for key, x in ids)


def test_ids_beyond_16_bits_are_stored_wide(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "")], "doc_id long, text string")
    folder, manifest = write_store(rows, WORD_BPE, end_id=70_000)
    want = [library(WORD_BPE).encode("a b", add_special_tokens=False).ids + [70_000], [70_000]]
    got = [r["ids_crc32"] for r in read_store(rows, folder, manifest).orderBy("doc_id").collect()]
    assert got == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in want]


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(-(2**63), 2**63 - 1), max_size=300))
def test_perfect_hash_is_minimal(keys):
    keys = np.array(sorted(keys), np.int64)
    assert sorted(PerfectHash.build(keys).find(keys).tolist()) == list(range(len(keys)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_plan_is_an_exact_cover_near_the_bound(lengths):
    plan = packing.plan_sequences(Counter(lengths), 64)
    used = Counter()
    for pattern, times in plan:
        assert sum(pattern) <= 64 and times > 0
        for x in pattern:
            used[x] += times
    assert used == Counter(lengths)
    plain = packing.best_fit(Counter(x for x in lengths if x < 64), 64)
    assert sum(t for _, t in plan) <= sum(t for _, t in plain) + lengths.count(64)


def least(lengths, capacity):
    """The optimum by exhaustive search: each item, longest first, into every different open room."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for room in sorted(set(r for r in rooms if r >= lengths[i])):
            rest = list(rooms)
            rest[rest.index(room)] -= lengths[i]
            place(i + 1, rest)
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best[0] if lengths else 0


@given(st.lists(st.integers(4, 49), max_size=9))
@settings(max_examples=300, deadline=None)
def test_reduction_keeps_the_optimum(lengths):
    fixed, left = packing.reduce_instance(Counter(lengths), 50)
    rest = [x for x, n in left.items() for _ in range(n)]
    assert Counter(x for p, t in fixed for x in p * t) + Counter(rest) == Counter(lengths)
    assert sum(t for _, t in fixed) + least(rest, 50) == least(lengths, 50)


def test_an_instance_that_wrong_dominance_spoils():
    assert sum(t for _, t in packing.plan_sequences({7: 2, 9: 1, 16: 1}, 50)) == 1


def test_reduction_fixes_only_optimal_sets():
    assert packing.reduce_instance({60: 2, 40: 3, 30: 1}, 100) == ([((60, 40), 2), ((40, 30), 1)], {})
    fixed, kept = packing.reduce_instance({50: 4}, 100)
    assert fixed == [((50, 50), 2)] and not kept


def check_packed(rows, corpus, capacity):
    t = Tokenizer.from_file(BYTE_BPE)
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    for key, text, *_ in corpus:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        pieces = sorted(by[key], key=lambda r: r["piece"])
        assert [r["start"] for r in pieces] == np.append(0, np.cumsum([r["length"] for r in pieces]))[:-1].tolist() and sum(r["length"] for r in pieces) == len(ids)
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in pieces)
        assert len(pieces) == -(-len(ids) // capacity) and all(r["length"] == capacity for r in pieces[1:])
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing(spark, docs, corpus, no_docs, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_RANK_TASK", 3)  # so that ranks are salted
    rows = packing.pack_documents(docs, BYTE_BPE, 0, 512).collect()
    n = check_packed(rows, corpus, 512)
    lengths = Counter(r["length"] for r in rows)
    plain = packing.best_fit({k: v for k, v in lengths.items() if k < 512}, 512)
    assert n <= sum(t for _, t in plain) + lengths[512]
    assert packing.pack_documents(no_docs, BYTE_BPE).count() == 0


def test_extendible_hashing(spark, docs, corpus, no_docs):
    rows = shard_documents(docs, 60_000).collect()
    assert len(rows) == len(corpus)
    shards = defaultdict(int)
    for r in rows:
        shards[r["depth"], r["prefix"], r["part"]] += r["n_bytes"]
    for r in rows:
        assert r["shard_bytes"] == shards[r["depth"], r["prefix"], r["part"]]
    long = max(len((t or "").encode()) for _, t, *_ in corpus)
    assert all(n <= max(60_000, long) for n in shards.values())
    assert shard_documents(no_docs, 1000).count() == 0
    same = spark.createDataFrame([(1, "x" * 100)] * 50 + [(2, "y")], "doc_id long, text string")
    cut = defaultdict(int)
    for r in shard_documents(same, 1000).collect():
        cut[r["depth"], r["prefix"], r["part"]] += r["n_bytes"]
    assert sum(cut.values()) == 5001 and all(n <= 1000 for n in cut.values())


def test_directory_in_groups_and_as_a_join(spark, docs, corpus, monkeypatch):
    want = sorted(map(tuple, shard_documents(docs, 2000).collect()), key=repr)
    sizes = {k: len((t or "").encode()) for k, t, *_ in corpus}
    leaves = defaultdict(int)
    address = {k: int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16) for k in sizes}

    def grow(prefix, depth, keys):  # the definition, one bucket at a time
        n = sum(sizes[k] for k in keys)
        if n <= 2000 or depth == 60:
            leaves[depth, prefix] = n
            return
        for bit in (0, 1):
            half = [k for k in keys if address[k] >> (59 - depth) & 1 == bit]
            if half:
                grow(2 * prefix + bit, depth + 1, half)

    grow(0, 0, list(sizes))
    assert {(x[2], x[3]) for x in want} == set(leaves)
    monkeypatch.setattr(extendible, "GROUP_BITS", 3)
    monkeypatch.setattr(extendible, "SENT", 5)
    assert sorted(map(tuple, shard_documents(docs, 2000).collect()), key=repr) == want


def test_shards_hold_every_row_once(spark, tmp_path):
    rows = [(None, "n" * 30, 1)] * 3 + [(1, "x" * 100, 2)] * 50 + [(1, None, 3), (2, "y", 4), (2, "z" * 3000, 5)]
    back = write_shards(spark.createDataFrame(rows, "doc_id long, text string, part long"), 1000, str(tmp_path / "shards")).collect()
    assert Counter(tuple(r["row"]) for r in back) == Counter(rows)
    shards = defaultdict(list)
    for r in back:
        shards[r["depth"], r["prefix"], r["part"]].append(len(r["row"]["text"] or ""))
    assert all(sum(x) <= 1000 or sum(n > 0 for n in x) == 1 for x in shards.values())
    assert len(list((tmp_path / "shards").rglob("part=*"))) == len(shards)


def test_registered_queries(spark, sf_dir):
    import corpus_pipeline

    numbers = sorted(int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES)
    assert numbers == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "duplicates", "packing"]
