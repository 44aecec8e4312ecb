"""Each operator's query against brute force on the small tables, and each operator on odd,
clashing and empty input."""

import base64
import hashlib
import json
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trailweave.llm import chat, components, exact_dedup, media, mixing, near_dedup, packing, quality, queries, token_codes, tokens, toxicity, warc, words

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def library_ids(path, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    return [e.ids for e in library.encode_batch(list(texts), add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(want, key=str)


# Tokens


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(list("aBé\u0301 \n\t\x1c\x85\xa0\u1680\u2003\u2014\u3000'!1²$ß日ж.,\x00HS(×") + ["H\u0331", "é,", "×,", "'S", "(it's)", "<|ENDOFTEXT|>", "  ", " a", " word", "\n", "'s", "I'll", "<|endoftext|>", "<|"]), max_size=20).map("".join), max_size=4))
def test_cached_ids_equal_the_library(texts):
    for path, kind in ((WORD, "word"), (BYTE, "byte")):
        assert [x.tolist() for x in tokens.encoder(path, kind).encode_all(texts)] == library_ids(path, texts)


def test_strings_of_added_tokens():
    assert tokens.encoder(WORD, "word").encode_all(["a <|endoftext|> b"])[0].tolist() == library_ids(WORD, ["a <|endoftext|> b"])[0] == [320, 49407, 321]
    assert 50256 in tokens.encoder(BYTE, "byte").encode_all(["a <|endoftext|> b"])[0].tolist()


def test_small_tables_change_nothing(documents):
    texts = [t for _, t in documents[:60]] + ["x" * 300 + " y" * 50]
    for path, kind in ((WORD, "word"), (BYTE, "byte")):
        small, got = tokens.Encoder(path, kind, chunks=300), []
        for k in range(0, len(texts), 3):
            got += [x.tolist() for x in small.encode_all(texts[k : k + 3])]
        assert got == library_ids(path, texts) and small.n < 300 + 3000


@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=1500))
@settings(max_examples=40, deadline=None)
def test_codes_round_trip(ids):
    ids = np.array(ids, np.uint32)
    codes = token_codes.Codes(pa.BufferReader(token_codes.encode_codes(ids, [None, 7], np.array([0, 0, len(ids)]))))
    assert (codes.ids(0, len(ids)) == ids).all() and codes.doc_ids == [None, 7]
    for place in {0, len(ids) // 2, len(ids) - 1}:
        assert codes[place] == ids[place] and (codes.ids(place, len(ids)) == ids[place:]).all() and (codes.ids(place // 2, place) == ids[place // 2 : place]).all()
    for most in (7, 700, 10**6):
        parts = list(codes.documents(most))
        assert np.concatenate([x for _, x in parts]).tolist() == ids.tolist() and {d for d, _ in parts} <= {0, 1}


def test_a_range_reads_its_own_bytes_only():
    ids = np.arange(200_000, dtype=np.uint32) * 3
    data = token_codes.encode_codes(ids, [1], np.array([0, len(ids)]))
    read = []

    class Counting:
        def read_at(self, size, at):
            read.append(size)
            return data[at : at + size]

    codes = token_codes.Codes(Counting())
    read.clear()
    assert codes.ids(150_000, 150_010).tolist() == ids[150_000:150_010].tolist() and sum(read) < 400


def test_op1(spark, sf, documents):
    start = 0
    got = {r.doc_id: r for r in token_codes.op1(spark, sf).collect()}
    assert len(got) == len(documents)
    for (doc, _), ids in zip(documents, library_ids(WORD, [t for _, t in documents])):
        ids = [*ids, 1]
        assert tuple(got[doc]) == (doc, start, len(ids), crc(ids))
        start += len(ids)


def test_token_files_of_odd_rows(spark, odd, clashing, empty):
    for docs in (clashing,):
        manifest = token_codes.write_token_files(docs, WORD, tokens_per_file=500)
        rows = sorted(token_codes.read_token_files(manifest).collect(), key=lambda r: r.start)
        assert len(rows) == odd.count() and manifest.count() > 1
        assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
        known = [r.doc_id for r in rows if r.doc_id is not None]
        assert known == sorted(known) and rows[0].doc_id is None
    assert token_codes.read_token_files(token_codes.write_token_files(empty, WORD)).count() == 0


def test_token_files_of_many_tasks_make_few_parquet_files(spark):
    docs = spark.createDataFrame([(i, f"document {i}") for i in range(400)], "doc_id long, text string")
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "24")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        manifest = token_codes.write_token_files(docs, WORD, tokens_per_file=40)
        read = token_codes.read_token_files(manifest)
        rows, cores = sorted(read.collect()), spark.sparkContext.defaultParallelism
        assert manifest.count() > 24 and manifest.select("part").distinct().count() > 4 * cores
        assert len(manifest.inputFiles()) <= cores and read.rdd.getNumPartitions() <= cores
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ends = [r.start + r.n_tokens for r in rows]
    assert [r.doc_id for r in rows] == list(range(400)) and [r.start for r in rows] == [0, *ends[:-1]]
    assert [r.ids_crc32 for r in rows] == [crc([*ids, 1]) for ids in library_ids(WORD, [f"document {i}" for i in range(400)])]


# Packing


def check_packing(rows, want):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length, r.sequence_length))
    assert set(pieces) == set(want)
    for doc, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want[doc]) and r.ids_crc32 == crc(want[doc][at : at + r.length])
            at += r.length
        assert at == len(want[doc])
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length, size in sorted(parts):
            assert offset == at
            at += length
        assert at == size <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0


def test_op10(spark, sf, documents):
    check_packing(packing.op10(spark, sf).collect(), {d: [*ids, 1] for (d, _), ids in zip(documents, library_ids(BYTE, [t for _, t in documents]))})


@given(st.lists(st.integers(1, 5000), max_size=40), st.booleans())
@settings(max_examples=80, deadline=None)
def test_pack_keeps_every_token(lengths, last):
    done, left = packing.pack([(i, 0, n) for i, n in enumerate(lengths)], last)
    spans = defaultdict(list)
    for length, doc, start in [p for s in done for p in s] + left:
        spans[doc].append((start, length))
    for i, n in enumerate(lengths):
        at = 0
        for start, length in sorted(spans[i]):
            assert start == at and length > 0
            at += length
        assert at == n
    assert all(sum(p[0] for p in s) & (sum(p[0] for p in s) - 1) == 0 for s in done)
    assert not (last and left)


def test_packing_of_odd_rows(spark, odd, clashing, empty):
    for docs in (clashing,):
        rows = packing.pack_documents(docs, BYTE, window_tokens=3000, with_ids=True).collect()
        assert Counter(r.doc_id for r in rows if r.start == 0) == Counter(r[0] for r in odd.collect())
        assert all(len(r.ids) == 4 * r.length for r in rows)
    assert packing.pack_documents(empty, BYTE).count() == 0


def test_step_groups_are_balanced():
    groups = packing.step_groups([[(2048, i, 0)] for i in range(64)], 16 * 2048)
    assert sorted(Counter(groups).values()) == [16, 16, 16, 16]


# Exact dedup


def brute_groups(rows, least=False):
    """doc_id, keep_id, group_size, kept, text_sha256 of (doc_id, text) rows; null ids are smallest."""
    order = lambda i: (i is not None, i or 0)
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = Counter()
    for t, ids in groups.items():
        keep = (min if least else max)(ids, key=order)
        rest = list(ids)
        rest.remove(keep)
        digest = hashlib.sha256(t.encode()).hexdigest()
        out.update([(keep, keep, len(ids), True, digest), *((i, keep, len(ids), False, digest) for i in rest)])
    return out


def test_exact_groups_of_odd_rows(odd, clashing, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(None, "twice without an id")] * 2
    more = odd.unionByName(odd.sparkSession.createDataFrame([(None, "twice without an id", None, None, None)] * 2, odd.schema))
    assert Counter(map(tuple, exact_dedup.exact_groups(more).collect())) == brute_groups(rows)
    assert Counter(map(tuple, exact_dedup.exact_groups(more, keep="min").collect())) == brute_groups(rows, True)
    assert Counter(map(tuple, exact_dedup.exact_groups(clashing).collect())) == brute_groups(rows[:-2])
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.colliding(odd).count() == 0


def test_chunks_are_lossless(odd):
    c = odd.select(F.concat_ws("", exact_dedup.chunks(F.coalesce("text", F.lit("")))).alias("a"), F.coalesce("text", F.lit("")).alias("b"))
    assert c.where("a <> b").count() == 0


def test_recipes_of_many_tasks_make_few_files(spark, odd):
    many = odd.repartition(40)
    own = exact_dedup.recipes(many)
    assert own.count() == odd.count() and len(own.inputFiles()) <= spark.sparkContext.defaultParallelism
    assert own.select("row").distinct().count() == odd.count()


def test_exact_stage(spark, odd, sf):
    rows = exact_dedup.stage(spark, odd, sf).collect()
    assert len(rows) == len({r.text or "" for r in odd.collect()}) and Counter(r.text or "" for r in rows).most_common(1)[0][1] == 1


# Mixing


def test_mixing_of_odd_rows(odd, clashing, empty):
    for docs in (clashing,):
        rows = mixing.mix(docs, fraction=1.0, max_epochs=2).collect()
        assert rows and all(0 < r.taken <= r.n_tokens for r in rows)
        by = defaultdict(list)
        for r in rows:
            by[r.domain, r.lang, r.source].append(r)
        for own in by.values():
            at = 0
            for r in sorted(own, key=lambda r: r.start):
                assert r.start == at
                at += r.n_tokens
    assert mixing.mix(empty).count() == 0


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("web", "en", "a", 10), ("web", "en", "b", 1000), ("web", "de", "c", 1000), ("books", "en", "d", 1000)], "domain string, lang string, source string, tokens long")
    got = {r.source: r.budget for r in mixing.leaf_budgets(leaves, 0.3, 1).collect()}
    total = 0.3 * 3010
    web = total * 0.5 / 0.8
    assert got["a"] == 10 and abs(got["b"] - (web / 2 - 10)) <= 1 and abs(got["c"] - web / 2) <= 1 and abs(got["d"] - total * 0.3 / 0.8) <= 1


# Near dedup


def word_shingles(text):
    words = text.lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)) if words)


def brute_classes(rows):
    sets = [(i, word_shingles(t or "")) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x == y or len(x & y) >= 0.8 * len(x | y):
                parent[find(a)] = find(b)
    members = defaultdict(list)
    for k in range(len(sets)):
        members[find(k)].append(k)
    out = []
    for own in members.values():
        ids = [sets[k][0] for k in own if sets[k][0] is not None]
        out += [(sets[k][0], min(ids, default=None), len(own)) for k in own]
    return Counter(out)


def test_op3(spark, sf, documents):
    got = Counter((r.doc_id, r.class_id, r.class_size) for r in near_dedup.op3(spark, sf).collect())
    assert got == brute_classes(documents)


def test_near_groups_of_odd_rows(odd, clashing, empty):
    want = brute_classes([(r.doc_id, r.text) for r in odd.collect()])
    kept = [r for r in near_dedup.near_groups(odd).collect() if r.kept]
    assert len(kept) == sum(round(n / size) for (_, _, size), n in Counter({(0, c, s): n for (c, s), n in Counter((r[1], r[2]) for r in want.elements()).items()}).items()) and all(r.doc_id == r.class_id for r in kept)
    for docs in (clashing,):
        assert Counter((r.doc_id, r.class_id, r.class_size) for r in near_dedup.near_groups(docs).collect()) == want
    assert near_dedup.near_groups(empty).count() == 0


def test_fingerprints_of_many_tasks_make_few_files(spark, odd):
    prints, _ = near_dedup.links(odd.repartition(40))
    assert prints.count() == odd.count() == prints.select("row").distinct().count()
    assert len(prints.inputFiles()) <= spark.sparkContext.defaultParallelism


def test_dense_cluster_and_split_buckets(spark):
    import random

    rnd = random.Random(4)
    base = [f"w{rnd.randrange(5000)}" for _ in range(300)]
    rows = []
    for i in range(60):
        own = list(base)
        own[rnd.randrange(300)] = f"new{i}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, " ".join(f"u{i}x{rnd.randrange(10**6)}" for _ in range(80))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for cap, size in ((16, 1 << 24), (8192, 4000)):  # crowded prefixes; sets too large for a task
        prints, labels = near_dedup.links(docs, cap, size)
        got = near_dedup._named(prints, labels).collect()
        sizes = Counter(r.class_id for r in got)
        assert sizes[0] == 60 and len(sizes) == 31 and sum(r.kept for r in got) == 31


def test_nodes_of_a_crowded_prefix_meet_in_a_bucket(spark):
    rng = np.random.default_rng(5)
    halves = rng.integers(-(1 << 62), 1 << 62, (160, 2))
    halves[:70] = halves[0]  # a crowd that no depth can part
    nodes = spark.createDataFrame([(f"{i:04}".encode(), int(a), int(b), 9) for i, (a, b) in enumerate(halves)], "key binary, s0 long, s1 long, size int")
    held = defaultdict(set)
    for r in near_dedup.buckets(nodes, [(2, 1, 1), (5, 3, 3)], 16).collect():
        held[r.level, r.trie, r.prefix, r.salt].add(bytes(r.key))
    met = {(a, b) for own in held.values() for a in own for b in own if a < b}
    keys = [f"{i:04}".encode() for i in range(160)]
    assert {(keys[a], keys[b]) for b in range(70) for a in range(b)} <= met
    codes = {(r.trie, bytes(r.key)): r.prefix for r in near_dedup.forest(nodes, 3, 3, 5).collect()}
    want = {(a, b) for a in keys for b in keys if a < b and any(codes[t, a] == codes[t, b] for t in range(3))}
    assert want <= met  # every prefix of four is crowded at the first level, so all go on
    assert max(map(len, held.values())) < 2 * 16 + 8  # two blocks of 8, dealt by hash


def test_pairs_within_one_template_are_found(spark):
    import random

    rnd = random.Random(6)
    template = [f"t{k}" for k in range(150)]
    rows, pairs = [], []
    for i in range(400):
        own = [f"o{i}x{k}" for k in range(70)]
        other = list(own)
        for k in range(rnd.randrange(1, 9)):
            other[-1 - k] = f"z{i}x{k}"
        one, two = " ".join(own[:35] + template + own[35:]), " ".join(other[:35] + template + other[35:])
        a, b = word_shingles(one), word_shingles(two)
        rows += [(2 * i, one), (2 * i + 1, two)]
        if len(a & b) >= 0.8 * len(a | b):
            pairs.append(i)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert len(pairs) > 300 and len(word_shingles(rows[0][1]) & word_shingles(rows[2][1])) < 0.8 * len(word_shingles(rows[0][1]) | word_shingles(rows[2][1]))
    for cap in (24, 8192):  # prefixes split at every level, and none
        prints, labels = near_dedup.links(docs, cap)
        classes = {r.doc_id: r.class_id for r in near_dedup._named(prints, labels).collect()}
        assert sum(classes[2 * i] == classes[2 * i + 1] for i in pairs) >= 0.95 * len(pairs)
        assert all(c // 2 == d // 2 for d, c in classes.items())


@given(st.lists(st.lists(st.sampled_from(["A", "bé", " ", "\n", "\t", "\x1c", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000", "\u2014", "日", "\U0001f600"]), max_size=12).map("".join), max_size=5))
@settings(max_examples=200, deadline=None)
def test_words_are_those_of_split(texts):
    found, bounds = words.hashes(pa.array(texts, pa.string()))
    lists = [t.split() for t in texts]
    assert np.diff(bounds).tolist() == [len(x) for x in lists]
    name = {}
    for h, w in zip(found.tolist(), [w for x in lists for w in x]):
        assert name.setdefault(w, h) == h
    assert len(set(name.values())) == len(name)


def test_a_node_without_a_star_is_in_the_second_pass(spark, monkeypatch):
    import random

    import xxhash

    differ, rows = 22, None
    for seed in range(2000):
        rnd = random.Random(seed)
        base = [f"w{rnd.randrange(10**6)}" for _ in range(100)]
        changed = [" ".join(base[:30] + ["new"] + base[31:]), " ".join(base[:30] + ["new"] + base[31:50] + ["b"] + base[51:70] + ["c"] + base[71:])]
        texts = [" ".join(base[:-1] + [f"end{i}"]) for i in range(12)] + changed
        sets = [near_dedup.shingles(t) for t in texts]
        keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        bits = np.array([near_dedup.signature(s) for s in sets]).view(np.uint64)
        apart = np.bitwise_count(bits[:, None] ^ bits[None]).sum(axis=2, dtype=int)
        lead = min(range(14), key=keys.__getitem__)
        # The leader takes all but the last, whose only near one is the last but one.
        if lead < 12 and apart[lead, :13].max() <= differ and apart[13, :12].min() > differ >= apart[13, 12]:
            rows = list(enumerate(texts))
            break
    assert len(brute_classes(rows)) == 14 and set(n for _, _, n in brute_classes(rows)) == {14}
    monkeypatch.setattr(near_dedup, "plan", lambda nodes: [(0, 1, 1)])  # all in one bucket
    prints, labels = near_dedup.links(spark.createDataFrame(rows, "doc_id long, text string"), cuts=(differ, differ))
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in near_dedup._named(prints, labels).collect()) == brute_classes(rows)


def test_plan_meets_the_recall():
    for n in (10, 10**6, 10**10):
        for depth, tries, short_tries in near_dedup.plan(n):
            for p, count in ((0.1611, tries), (0.1875, short_tries)):
                assert 1 - (1 - (1 - p) ** depth) ** count >= near_dedup.RECALL
    assert max(near_dedup.CUTS) < 40


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r.node: r.label for r in components.components(edges).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# Media


def test_op4(spark, sf, documents):
    rows = {r.doc_id: r for r in media.op4(spark, sf).collect()}
    assert len(rows) == len(documents)
    for doc, text in documents:
        raw = text.encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        r, whole = rows[doc], media.to_wav(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(whole), hashlib.sha256(whole).hexdigest(), media.feature_of(payload))


def test_media_of_odd_rows(odd, clashing, empty):
    want = Counter((r.doc_id, hashlib.sha256(media.payload_of(r.text)[0]).hexdigest()) for r in odd.collect())
    for docs in (clashing,):
        assert Counter((r.doc_id, r.payload_sha256) for r in media.read_media(media.store_media(docs, pack_bytes=4096)).collect()) == want
    assert media.read_media(media.store_media(empty)).count() == 0


@given(st.binary(max_size=60_000), st.binary(min_size=1, max_size=50))
@settings(max_examples=30, deadline=None)
def test_cuts(data, more):
    ends = media.cuts(data)
    assert ends[-1] == len(data) and all(b - a <= media.MOST for a, b in zip([0, *ends], ends))
    assert media.from_wav(media.to_wav(data)) == data


def test_cuts_follow_the_content():
    data = np.random.default_rng(1).integers(0, 256, 200_000, dtype=np.uint8).tobytes()
    whole = {data[a:b] for a, b in zip([0, *media.cuts(data)], media.cuts(data))}
    moved = b"inserted" + data
    again = {moved[a:b] for a, b in zip([0, *media.cuts(moved)], media.cuts(moved))}
    assert len(whole & again) > 0.8 * len(whole)


# WARC


def test_op6(spark, sf):
    pages = duckdb.sql(f"SELECT page_id, coalesce(html, '') FROM '{sf}/pages.parquet' ORDER BY 1").fetchall()
    first, want = {}, set()
    for page, html in pages:
        data = html.encode()
        head = first.setdefault(data, page)
        want.add((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if head == page else "revisit", None if head == page else head))
    assert {tuple(r) for r in warc.op6(spark, sf).collect()} == want


def test_archives_of_odd_pages(spark):
    rows = [(1, "http://a/é", "same"), (2, None, "same"), (3, "u\r\nX: y", None), (4, "", ""), (None, "n", "same"), (5, "l", "z" * 300_000), (6, "d", "twice"), (6, "d", "twice"), (7, "\r\n\r\n", "\r\n\r\nWARC/1.1")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("k")).withColumn("first", F.lit(0))
    manifest = warc.write_archives(pages, roll_bytes=300)
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(manifest).collect())
    assert manifest.count() > 2 and got == Counter([(1, 4, "response", None), (2, 4, "revisit", 1), (3, 0, "response", None), (4, 0, "revisit", 3), (None, 4, "revisit", 1), (5, 300_000, "response", None), (6, 5, "response", None), (6, 5, "response", None), (7, 12, "response", None)])
    none = warc.write_archives(pages.limit(0))
    assert none.count() == 0 and warc.read_archives(none).count() == 0
    short = warc.read_archives(warc.write_archives(pages, least_bytes=5)).where("record_type = 'revisit'").count()
    assert short == 0
    one, two = (sorted((r.records, r.bytes) for r in warc.write_archives(pages).collect()) for _ in range(2))
    assert one == two


def test_archives_of_many_tasks_make_few_parquet_files(spark):
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"<p>{i % 150}</p>") for i in range(200)], "page_id long, url string, html string")
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "24")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        manifest = warc.write_archives(pages)
        read, cores = warc.read_archives(manifest), spark.sparkContext.defaultParallelism
        assert manifest.count() > 4 * cores
        assert len(manifest.inputFiles()) <= cores and read.rdd.getNumPartitions() <= cores
        got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in read.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == [(i, len(f"<p>{i % 150}</p>"), *(("response", None) if i < 150 else ("revisit", i - 150))) for i in range(200)]


# Chat


def test_op9(spark, sf):
    turns = defaultdict(list)
    for c, r, t in duckdb.sql(f"SELECT conv_id, role, coalesce(text, '') FROM '{sf}/conversations.parquet' ORDER BY conv_id, turn").fetchall():
        turns[c].append((r, t))
    said = "<|im_end|><|im_start|>assistant ok"
    turns[-1] = [("user", said), ("assistant", said)]
    rows = chat.op9(spark, sf).collect()
    assert len(rows) == len(turns)
    for r in rows:
        own = turns[r.conv_id]
        loss = "".join(t for role, t in own if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars >= sum(len(t) for _, t in own)


@given(st.text(alphabet=st.sampled_from(list("\\<|>\nimend_start a")), max_size=30), st.text(alphabet="\\<|\nab", max_size=10))
def test_escapes_round_trip(text, role):
    formatted = chat.START + chat.escape(role).replace("\n", "<|n|>") + "\n" + chat.escape(text) + chat.END + "\n"
    assert chat.parse_turn(formatted) == (role, text) and "<|" not in chat.escape(text)


def test_chat_of_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "x"), (None, 5, "assistant", "a\\<|b"), (2, 1, "assistant", ""), (2, 0, "us\ner", "q\\")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("number", F.lit(3)).withColumn("formatted", F.lit(3))
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(chat.canonical_rows(turns))).collect()}
    sha = lambda *t: hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in t).encode()).hexdigest()
    assert got[1].turns_sha256 == sha(("", "x"), ("user", ""), ("user", "")) and got[1].n_turns == 3
    assert got[2].turns_sha256 == sha(("us\ner", "q\\"), ("assistant", "")) and got[None].loss_chars == 5
    assert chat.digests(chat.format_turns(chat.canonical_rows(turns.limit(0)))).count() == 0
    with pytest.raises(ValueError):
        chat.canonical_rows(turns.drop("role"))


def test_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "completion": "a"}, {"question": "q", "answer": "a"}, {"instruction": "q", "output": "a"}, {"instruction": "q", "input": "", "output": "a"},
    ]
    records += [{**r, "id": 7, "meta": {"lang": "en"}} for r in records]  # fields beside the layout's
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(90, None), (91, "{"), (92, '{"odd": 1}'), (93, "[]")]
    got = defaultdict(list)
    for r in chat.canonical_json(spark.createDataFrame(rows, "conv_id long, record string")).collect():
        got[r.conv_id].append((r.role, r.text))
    assert all(got[i] == [("user", "q"), ("assistant", "a")] for i in range(len(records)))
    assert all(got[i] == [(None, None)] for i in (90, 91, 92, 93))


# Classifiers


@pytest.mark.parametrize("operator, label, n, held", [(quality.op5, "quality", 3, 1), (toxicity.op8, "toxic", 5, 0)])
def test_held_out_accuracy(spark, operator, label, n, held):
    sf = "/root/testdata/sf0.01"
    rows = operator(spark, sf).collect()
    truth = dict(duckdb.sql(f"SELECT doc_id, {label} FROM '{sf}/labels.parquet'").fetchall())
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == held) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    right = [r.predicted == truth[r.doc_id] for r in rows if r.held_out and r.doc_id in truth]
    assert sum(right) / len(right) >= 0.9


@pytest.mark.parametrize("operator", [quality.classify, toxicity.classify])
def test_scores_of_odd_rows(operator, odd, clashing, empty, labels):
    for docs in (clashing,):
        rows = operator(docs, labels).collect()
        assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd.collect()) and all(0 <= r.score <= 1 for r in rows)
    assert operator(empty, labels).count() == 0
    assert {r.score for r in operator(odd, labels.limit(0)).collect()} == {0.5}


def test_factorisation_identity():
    index, value, starts = quality.inputs(["some words here, some more", "OTHER words!"])
    rng = np.random.default_rng(0)
    model = quality.Machine(0.1, rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, quality.RANK)))
    ends = [*starts[1:], len(index)]
    for got, a, b in zip(model.margins(index, value, starts)[0], starts, ends):
        i, x = index[a:b], value[a:b]
        pairs = sum(model.v[i[p]] @ model.v[i[k]] * x[p] * x[k] for p in range(len(i)) for k in range(p))
        assert np.isclose(got, 0.1 + model.w[i] @ x + pairs)


def test_kernel_tolerates_insertions():
    k = toxicity.kernel(["stupid", "stu.pid", "s-tupid", "garden"], ["stupid"])[:, 0]
    assert np.isclose(k[0], 1) and k[1] > 0.5 and k[2] > 0.4 and k[3] < 0.1
    assert "idiot" in toxicity.words_of("you i d i o t there")


def test_tables_in_any_layout(spark):
    """The query's way in: the schema of a table, with columns beside the layout's, chooses."""
    frames = [
        spark.createDataFrame([(1, "q", "a", 5)], "conv_id long, prompt string, completion string, extra int"),
        spark.createDataFrame([(1, "q", "", "a")], "conv_id long, instruction string, input string, output string"),
        spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])], "conv_id long, conversations array<struct<`from`:string,value:string>>"),
        spark.createDataFrame([(1, [("user", "q", 1), ("assistant", "a", 2)], "x")], "conv_id long, messages array<struct<role:string,content:string,n:int>>, note string"),
        spark.createDataFrame([(1, 1, "assistant", "a", 0), (1, 0, "user", "q", 0)], "conv_id long, turn long, role string, text string, other int"),
    ]
    for df in frames:
        got = sorted((r.conv_id, r.turn, r.role, r.text) for r in chat.canonical_rows(df).collect())
        assert got == [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
        assert chat.digests(chat.format_turns(chat.canonical_rows(df))).collect()[0].n_turns == 2
    empty = spark.createDataFrame([(1, None, None), (2, None, "a")], "conv_id long, prompt string, completion string")
    assert [tuple(r) for r in chat.canonical_rows(empty).collect()] == [(2, 0, "assistant", "a")]


def test_folded_scores_are_the_kernel_sum():
    """A word's score by its own subsequences equals the sum over landmarks of coefficient and
    kernel, computed by a plain loop over all triples of places."""

    def features(word):
        word, out = f"^{word}$", Counter()
        for i in range(len(word)):
            for j in range(i + 1, len(word)):
                for k in range(j + 1, min(len(word), i + 6)):
                    out[word[i] + word[j] + word[k]] += toxicity.DECAY ** (k - i - 2)
        norm = sum(v * v for v in out.values()) ** 0.5
        return {f: v / norm for f, v in out.items()}

    marks, words_ = ["stupid", "moron", "a", "gardenia", "s.t.u.p.i.d"], ["stupid", "stu-pid", "aaaaaaaaaaaa", "x" * 90, "mo_ron", "a"]
    alpha = np.array([1.5, -0.25, 0.5, 2.0, -1.0])
    feature, weight, owner = toxicity.subsequences(marks)
    model = toxicity.Model(np.bincount(feature, weights=weight * alpha[owner], minlength=toxicity.DIM), 0.25, np.ones(4), 0.0)
    for word, score in zip(words_, model.word_scores(words_)):
        own = features(word)
        want = 0.25 + sum(a * sum(own.get(f, 0) * v for f, v in features(m).items()) for a, m in zip(alpha, marks))
        assert abs(score - want) < 1e-3  # hashed features may meet


def test_very_long_words_take_linear_time():
    import time

    model = toxicity.Model(np.ones(toxicity.DIM, np.float32), 0.0, np.ones(4), 0.0)
    text = " ".join("".join(chr(97 + (i * j) % 26) for j in range(120)) + str(i) for i in range(1, 3001))
    start = time.process_time()
    model.margins([text])
    assert time.process_time() - start < 6
