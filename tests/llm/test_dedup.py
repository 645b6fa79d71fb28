"""Suffix-array, exact and SimHash deduplication against brute force."""

import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from chronolith.llm import exact_dedup, simhash, suffix_dedup
from chronolith.llm.common import connected_components

DOCS = "doc_id long, text string, fp string, salt int, lang string"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 5, None) for i, t in rows], DOCS).repartition(3)


def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(w)
        spans = [m.span() for m in re.finditer(rb"\x01+", bytes(gone))]
        out[i] = (len(b), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


def made_texts(seed=5, n=90):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(r.randint(20, 80)) for _ in range(8)]
    pick = lambda: r.choice([lambda: text(r.randint(1, 60)), lambda: r.choice(passages), lambda: r.choice(passages)[r.randint(0, 60) :]])()
    rows = [(d, " ".join(pick() for _ in range(r.randint(0, 5)))) for d in range(n)]
    return rows + [(200, "a" * 400), (202, None), (203, ""), (204, rows[3][1]), (205, "x" * 99), (206, "x" * 99)]


def test_suffix_dedup_is_exact(spark):
    rows = made_texts(n=60)
    found = suffix_dedup.suffix_dedup(frame(spark, rows)).collect()
    got = {x.doc_id: (x.n_bytes, [(s.start, s.stop) for s in x.spans], bytes(x.kept)) for x in found}
    assert got == brute_repeats(rows)


def test_large_groups_are_split_exactly(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(26)
    rows = [(d, f"{text(9)} {passage} {text(9)}") for d in range(24)]
    found = suffix_dedup.suffix_dedup(frame(spark, rows), most=14).collect()
    got = {x.doc_id: (x.n_bytes, [(s.start, s.stop) for s in x.spans], bytes(x.kept)) for x in found}
    assert got == brute_repeats(rows)


def keyed(spark, rows, **more):
    """Spans by id and text, of the operator and by brute force, where the order among rows of one id is that of the text's hash."""
    df = frame(spark, rows).selectExpr("*", "xxhash64(coalesce(text, '')) AS key")
    keys = {(r.doc_id, r.text): r.key for r in df.collect()}
    found = sorted(((x.doc_id is not None, x.doc_id or 0), x.n_bytes, bytes(x.kept)) for x in suffix_dedup.suffix_dedup(df, **more).collect())
    order = sorted({(i is not None, i or 0, keys[i, t], t) for i, t in rows}, key=lambda x: x[:3])
    want = brute_repeats([(k, x[3]) for k, x in enumerate(order)])
    place = {(x[0], x[1], x[3]): k for k, x in enumerate(order)}
    told = [((i is not None, i or 0), *(want[place[i is not None, i or 0, t]][j] for j in (0, 2))) for i, t in rows]
    return found, sorted(told)


def test_different_texts_of_one_id_or_none(spark):
    r = random.Random(12)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    p, q = text(48), text(40)
    rows = [(None, f"{p} {p} end"), (None, text(140)), (5, f"{q} {text(90)}"), (5, f"{text(30)} {q}"), (5, q), (5, q), (None, None), (7, f"{p} x {q}")]
    found, want = keyed(spark, rows)
    assert found == want


@pytest.mark.parametrize(("bits", "most"), [(0, None), (3, None), (1, 3)])
def test_colliding_hashes_of_contexts_change_no_result(spark, bits, most):
    """All anchors of a string have the same context hash, or one of a few, inside a batch and across them."""
    rows = made_texts(n=60)
    found, want = keyed(spark, rows, bits=bits, most=most)
    assert found == want


def test_suffix_sorter_orders_suffixes_and_finds_collisions():
    r = random.Random(1)
    texts = [bytes(r.choice(b"ab") for _ in range(r.randint(1, 60))) for _ in range(80)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    base, room = np.r_[0, ends[:-1]], np.array([len(t) for t in texts])
    group = np.sort(np.array([r.randint(0, 3) for _ in texts]))
    sorter = suffix_dedup.SuffixSorter(data, suffix_dedup.PrefixHashes(data, suffix_dedup.BASES[0]), base, room, 1)
    order = sorter.order(group)
    assert [group[i] for i in order] == sorted(group)
    for g in range(4):
        own = [i for i in order if group[i] == g]
        assert own == sorted(own, key=lambda i: (texts[i], i))
    a, b = order[:-1], order[1:]
    n = sorter.common(a, b)
    assert sorter.verified(a, b, n) and not sorter.verified(a, b, np.minimum(room[a], room[b]) + 0 * n) or (n == np.minimum(room[a], room[b])).all()


def test_suffix_dedup_of_repeated_rows_nulls_and_empty_table(spark):
    t = " ".join(f"word{i}" for i in range(60))
    got = suffix_dedup.suffix_dedup(frame(spark, [(1, t), (1, t), (None, "y" + t)])).collect()
    removed = sorted((x.doc_id is not None, x.doc_id, sum(s.stop - s.start for s in x.spans)) for x in got)
    assert removed == [(False, None, 0), (True, 1, len(t)), (True, 1, len(t))]
    assert suffix_dedup.suffix_dedup(frame(spark, [])).count() == 0


def test_exact_dedup(spark):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (5, "b"), (None, "c"), (None, "c"), (7, "A")]
    got = sorted((x.doc_id or -1, x.keep_id or -1, x.group_size, x.kept) for x in exact_dedup.exact_dedup(frame(spark, rows)).collect())
    assert [g for g in got if g[0] in (1, 2, 3, 4, 7)] == [(1, 2, 2, False), (2, 2, 2, True), (3, 4, 2, False), (4, 4, 2, True), (7, 7, 1, True)]
    assert [g[3] for g in got if g[0] == 5] == [False, True] and [g[3] for g in got if g[0] == -1] == [False, True]
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def test_colliding_fingerprints_change_no_result(spark):
    rows = [(i, f"text {i % 7}") for i in range(40)]
    fine = exact_dedup.exact_dedup(frame(spark, rows))
    worse = exact_dedup.exact_dedup(frame(spark, rows), fingerprint="cast(length({}) AS long)")
    assert sorted(map(tuple, fine.collect())) == sorted(map(tuple, worse.collect()))
    kept = exact_dedup.keep_one_of_copies(frame(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(33, 40)) and kept.columns == ["doc_id", "text", "fp", "salt", "lang"]


@pytest.mark.parametrize("broadcast", [0, 1 << 20])
def test_copies_by_broadcast_and_by_exchange(spark, broadcast):
    rows = [(i, f"text {i % 7}") for i in range(40)] + [(None, "text 3"), (39, "text 4"), (39, "text 4"), (50, "alone"), (50, "alone too"), (None, "nulls"), (None, "nulls")]
    got = sorted((x.doc_id if x.doc_id is not None else -1, x.keep_id if x.keep_id is not None else -1, x.group_size, x.kept, x.text_sha256) for x in exact_dedup.exact_dedup(frame(spark, rows), broadcast_prints=broadcast).collect())
    want = []
    for i, t in rows:
        own = [-1 if j is None else j for j, u in rows if u == t]
        i = -1 if i is None else i
        want.append((i, max(own), len(own), False, hashlib.sha256(t.encode()).hexdigest()))
    for t in {t for _, t in rows}:  # one row of the largest id stays
        sha = hashlib.sha256(t.encode()).hexdigest()
        k = max(k for k, w in enumerate(want) if w[4] == sha and w[0] == w[1])
        want[k] = (*want[k][:3], True, sha)
    assert got == sorted(want)
    kept = exact_dedup.keep_one_of_copies(frame(spark, rows), broadcast)
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == sorted((w[0] if w[0] else -1, t) for (_, t), w in zip(rows, want, strict=True) if w[3])


def test_ties_of_other_columns_have_one_answer(spark):
    df = spark.createDataFrame([(1, "t", "b", [2]), (1, "t", "a", [3]), (1, "t", None, None), (0, "t", "0", None)], "doc_id long, text string, sha string, row array<int>")
    for parts in (1, 3):
        assert [tuple(r) for r in exact_dedup.keep_one_of_copies(df.repartition(parts)).collect()] == [(1, "t", "a", [3])]


def test_many_batches_build_a_filter_in_little_more_than_linear_time():
    def seconds(n):
        r = np.random.default_rng(1)
        batches = [pa.RecordBatch.from_arrays([pa.array(r.integers(-(1 << 62), 1 << 62, 10_000))], ["fp"]) for _ in range(n)]
        began = time.time()
        assert sum(len(b) for b in exact_dedup._filters(12, 1 << 20)(iter(batches))) > 0
        return time.time() - began

    seconds(10)
    assert seconds(200) < 4 * seconds(100) + 1


def test_quotient_filters_merge_without_loss():
    r = np.random.default_rng(3)
    a, b = (r.integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2) for _ in range(2))
    b[:50] = a[:50]
    one, two = exact_dedup.QuotientFilter.of(a), exact_dedup.QuotientFilter.of(b)
    whole = exact_dedup.QuotientFilter.of(np.r_[a, b])
    both = one.merged(two)
    assert (both.fingerprints == whole.fingerprints).all() and (both.counts == whole.counts).all()
    parts = [exact_dedup.QuotientFilter.from_block(k, 6, *rest) for k, *rest in whole.blocks(6)]
    assert np.concatenate([p.counts for p in parts]).tolist() == whole.counts.tolist()
    assert np.concatenate([p.fingerprints for p in parts]).tolist() == whole.fingerprints.tolist()


def slow_fingerprint(text):
    words = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", None, "One", "A b", "A b c", "É É É É x y z x y z\x0b\x1c q", " \t\n", "a b c d e f g h" * 20])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def brute_components(ids, fps):
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    low = ids.copy()
    while True:
        new = np.array([low[near[i]].min() for i in range(len(ids))])
        if (new == low).all():
            return low
        low = new


@pytest.mark.parametrize("cap", [1024, 8])
def test_links_of_a_dense_ball(cap, monkeypatch):
    monkeypatch.setattr(simhash, "ALL_PAIRS", cap)
    r = random.Random(2)
    centres = [r.getrandbits(64) for _ in range(3)]
    fps = sorted({c ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 4))) for c in centres for _ in range(70)})
    fps = np.array(fps, np.uint64)
    ids = np.arange(len(fps))
    keys = simhash.PIVOTS.keys(fps)
    pairs = []
    for k in range(keys.shape[1]):
        for v in np.unique(keys[:, k]):
            at = np.flatnonzero(keys[:, k] == v)
            if len(at) > 1:
                pairs += list(simhash._all_links(fps, at))
    assert simhash._roots(len(fps), iter(pairs)).tolist() == brute_components(ids, fps).tolist()


def test_simhash_components(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(10, base), (11, base + " more"), (12, base.upper()), (13, "other words stand here"), (14, None), (15, " "), (14, None)]
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in simhash.simhash_components(frame(spark, rows)).collect()}
    ids = np.array(sorted(got))
    fps = np.array([int(got[i][0], 16) for i in ids], np.uint64)
    assert [got[i][1] for i in ids] == brute_components(ids, fps).tolist()
    assert got[14] == got[15] == ("0" * 16, 14)
    assert all(int(got[i][0], 16) == slow_fingerprint(t) for i, t in rows)
    assert simhash.simhash_components(frame(spark, [])).count() == 0
    assert {r.doc_id for r in simhash.keep_one_of_component(frame(spark, rows)).collect()} == {c for _, c in got.values()}


def test_fingerprints_of_rows_without_an_id_link_their_neighbours(spark, monkeypatch):
    values = {"a": 0, "b": 3, "c": 15, "d": 255}  # a and b, b and c, two bits apart; c and d four
    monkeypatch.setattr(simhash, "simhash_fingerprints", lambda docs, *_: docs.selectExpr("doc_id", "CASE text " + " ".join(f"WHEN '{k}' THEN {v}L" for k, v in values.items()) + " END AS fp"))
    rows = [(1, "a"), (None, "b"), (2, "c"), (None, "d")]
    got = sorted((x.fingerprint, x.component_id) for x in simhash.simhash_components(frame(spark, rows)).collect())
    assert [c for _, c in got] == [1, 1, 1, None]


@pytest.mark.parametrize("max_bits", [0, 2, 6])
def test_keys_of_any_radius_bring_all_near_fingerprints_together(max_bits):
    r = random.Random(max_bits)
    table = simhash.pivots(max_bits)
    assert sum(b - a for a, b in table.blocks) == 64 and len(table.blocks) == max_bits + simhash.KEPT
    for _ in range(60):
        x = r.getrandbits(64)
        y = x ^ sum(1 << k for k in r.sample(range(64), max_bits))
        keys = table.keys(np.array([x, y], np.uint64))
        assert (keys[0] == keys[1]).any()
    fps = np.sort(np.array([r.getrandbits(64) for _ in range(5)] + [x ^ (1 << k) for k in range(8)] + [x], np.uint64))
    for turn in (0, 5, 63):
        u, v = table.led(fps, turn)
        assert (np.bitwise_count(fps[u] ^ fps[v]) <= max_bits).all() and len(u) < 2 * len(fps)
        assert max_bits < 2 or simhash._roots(len(fps), iter([(u, v)])).tolist() == brute_components(np.arange(len(fps)), fps).tolist()


def spoiled(r, words, changes):
    own = list(words)
    for k in r.sample(range(len(own)), changes):
        own[k] = "zz" + own[k]
    return " ".join(own)


def test_near_copies_are_verified_by_their_shingles(spark):
    r = random.Random(15)
    rows, groups = [], []
    for g in range(12):
        words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(250)]
        own = [" ".join(words), *(spoiled(r, words, r.randint(1, 3)) for _ in range(6)), spoiled(r, words, 60)]
        rows += [(100 * g + k, t) for k, t in enumerate(own)]
        groups.append(own)
    rows += [(5000, None), (5001, ""), (None, rows[0][1] + " more"), (4999, rows[0][1])]
    kept = simhash.keep_one_of_near_copies(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "fp", "salt", "lang"]
    got = [(x.doc_id, x.text) for x in kept.collect()]
    ids = {i for i, _ in got}
    assert {100 * g for g in range(12)} <= ids and 5000 in ids and 5001 not in ids and None in ids
    assert all(100 * g + 7 in ids for g in range(12))  # too many changes
    sets = {i: simhash.shingle_set(t) for i, t in rows if i is not None}
    gone = [i for i, _ in rows if i is not None and i not in ids and i < 5000]
    near = [i for g in range(12) for i in range(100 * g + 1, 100 * g + 7) if any(simhash.similarity(sets[i], sets[j]) >= 0.8 and (simhash.fingerprint(dict(rows)[i]) ^ simhash.fingerprint(dict(rows)[j])).bit_count() <= 6 for j in range(100 * g, i))]
    assert len(set(near) - set(gone)) <= 0.05 * len(near) and 4999 in gone and len(near) > 20
    assert simhash.keep_one_of_near_copies(frame(spark, [])).count() == 0


def test_no_link_of_near_copies_is_left_out(spark):
    """Very many copies of one text, copies of copies, and one word in all texts, against all pairs."""
    r = random.Random(23)
    texts = []
    for _ in range(3):
        words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(250)]
        texts += [spoiled(r, words, r.randint(0, 5)) for _ in range(60)]
        for _ in range(40):
            words = spoiled(r, words, 3).split(" ")
            texts.append(" ".join(words))
    r.shuffle(texts)
    ids, sets = np.arange(len(texts)), [simhash.shingle_set(t) for t in texts]
    fps = np.array([simhash.fingerprint(t) for t in texts], np.uint64)
    apart = np.bitwise_count(fps[:, None] ^ fps[None, :])
    near = apart <= simhash.MAX_BITS
    for a, b in np.argwhere(~near & (apart <= simhash.NEAR_BITS)):
        near[a, b] = simhash.similarity(sets[a], sets[b]) >= simhash.SIMILARITY
    low = ids.copy()
    while (new := np.array([low[near[k]].min() for k in ids])).tolist() != low.tolist():
        low = new
    kept = simhash.keep_one_of_near_copies(frame(spark, [(int(i), t) for i, t in zip(ids, texts, strict=True)]))
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(low.tolist()))


def test_sets_that_alike_share_a_first_shingle():
    r = np.random.default_rng(3)
    for _ in range(300):
        n = int(r.integers(1, 60))
        a = np.unique(r.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.r_[a[r.random(len(a)) < 0.9], r.integers(0, 1 << 62, n // 9).astype(np.uint64)])
        frequent = np.sort(np.r_[a[::3], r.integers(0, 1 << 62, 4).astype(np.uint64)])
        x, y = (set(simhash.first_shingles(s, frequent, 0.8).tolist()) for s in (a, b))
        assert simhash.similarity(a, b) < 0.8 or x & y
    assert len(simhash.first_shingles(np.zeros(0, np.uint64), frequent, 0.8)) == 0


def test_connected_components(spark):
    r = random.Random(4)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(25)] + [(i, i + 1) for i in range(100, 110)] + [(7, None), (5, 5)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    low = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(100):
        for u, v in edges:
            if v is not None and u != v:
                low[u] = low[v] = min(low[u], low[v])
    assert got == low


def test_sha_of_kept_bytes(spark, small):
    from chronolith.llm import queries

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: (n, sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest()) for i, (n, s, k) in brute_repeats(rows).items()}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op1_suffix_dedup(spark, small).collect()}
    assert got == want
