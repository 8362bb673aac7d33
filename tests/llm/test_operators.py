"""Operators against brute force, and on nulls, empties, ties, repeats and clashing columns."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fieldtrust.llm import components, decontamination, lm, quality, repeats, resharding, simhash, sp_encoding, surrogates, token_counts, vectors

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
DOCS = "doc_id long, text string"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = [prose(i, 60 + 5 * i) for i in range(12)]
    out = [(i, t) for i, t in enumerate(base)]
    out += [(20, base[3]), (21, base[3]), (22, base[4] + " tail"), (23, "head " + base[5][:200] + " mid " + base[6][:150]), (24, ""), (25, None), (26, "one"), (27, "two words"), (27, "two words"), (None, base[1]), (28, prose(99, 9000)), (29, "naïve Ünïcode " * 8), (30, " \t\n ")]
    return out


def fold_mod(i, k):
    return -1 if i is None else zlib.crc32(str(i).encode()) % k


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (7, 7), (4, 5), (2, 1), (None, 3)] + [(100 + i, 101 + i) for i in range(50)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8} | {100 + i: 100 for i in range(51)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprint_by_definition():
    def plain(text):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split()
        sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for t in ("", "One", "two Words", prose(1, 50), "a b c\x0bd\te " * 9, "É X Y Z"):
        assert simhash.fingerprint(t) == plain(t)


def test_simhash_links_all_pairs(spark):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    fps = set(seeds)
    for s in seeds:
        for _ in range(15):
            x = s
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps |= {seeds[0] ^ a ^ b for a in (1 << i for i in range(12)) for b in (1 << i for i in range(12))}  # a dense block
    fps = sorted(fps)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                root[max(find(a), find(b))] = min(find(a), find(b))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {r.node: r.component for r in components.connected_components(simhash.links(df)).collect()}
    groups = lambda f: Counter(frozenset(v) for v in by(f).values())

    def by(f):
        out = {}
        for x in fps:
            out.setdefault(f(x), set()).add(x)
        return out

    assert groups(find) == groups(lambda x: got.get(signed(x), signed(x)))
    # slices that many share are cut into tiles along the first pivot's distance
    tiles = {r.node: r.component for r in components.connected_components(simhash.links(df, most=16)).collect()}
    assert tiles == got


def test_pivot_pairs_are_all_near_pairs():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**64, 300, dtype=np.uint64)
    y = np.concatenate([x[:200] ^ np.uint64(5), x[200:] ^ np.uint64(7), x[:50]])
    p, q = simhash.by_first_coordinate(x), simhash.by_first_coordinate(y)
    got = {(int(p[i]), int(q[j])) for a, b in simhash.pivot_pairs(p, q) for i, j in zip(a, b, strict=True)}
    assert got == {(int(a), int(b)) for a in x for b in y if bin(int(a) ^ int(b)).count("1") <= 2} and len(got) == 250


def test_simhash_rows(spark, texts):
    rows = simhash.near_duplicates(spark.createDataFrame(texts, DOCS)).collect()
    assert len(rows) == len(texts)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[20].component_id == by[21].component_id == 3
    assert by[24].fingerprint == by[25].fingerprint == by[30].fingerprint == "0" * 16
    assert by[24].component_id == 24
    assert next(r for r in rows if r.doc_id is None).component_id == 1
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_flow_moves_fewest_bytes():
    import itertools

    blocks = [(0, 1, 3, 30), (0, 2, 2, 80), (1, 1, 1, 5), (1, 2, 3, 300)]
    plan = resharding.solve_transfers(blocks, 3)
    held = Counter()
    for old, size_class, a, b, j in plan:
        held[j] += b - a
    assert sorted(held.values()) == [3, 3, 3]
    mean = {(o, c): size / n for o, c, n, size in blocks}
    cost = sum(mean[o, c] * (b - a) for o, c, a, b, j in plan if j != o)
    units = [(o, mean[o, c]) for o, c, n, _ in blocks for _ in range(n)]
    best = min(sum(m for (o, m), j in zip(units, to, strict=True) if o != j) for to in set(itertools.product(range(3), repeat=9)) if Counter(to) == {0: 3, 1: 3, 2: 3})
    assert math.isclose(cost, best)


def test_resharding_rows(spark, texts, tmp_path):
    docs = spark.createDataFrame(texts, DOCS)
    rows = resharding.reshard(docs, old_shards=3, new_shards=5).collect()
    assert len(rows) == len(texts)
    n = Counter(r.shard for r in rows)
    assert max(n.values()) - min(n[j] for j in range(5)) <= 1
    for j in n:
        assert sorted(r.slot for r in rows if r.shard == j) == list(range(n[j]))
    assert {(r.doc_id, r["size"], r.text_crc32) for r in rows} == {(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts}
    assert resharding.reshard(spark.createDataFrame([], DOCS)).count() == 0
    unique = docs.where("doc_id < 12")
    placed = resharding.reshard(unique, 3, 5)
    resharding.rewrite_affected(unique, placed, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("doc_id IS NOT NULL").count() >= placed.where("moved").count()


def test_token_counts(spark, texts):
    pieces = token_counts.vocabulary()
    auto, have, longest = token_counts.LongestMatch(pieces), set(pieces), max(map(len, pieces))
    rng = random.Random(3)
    words = ["▁" + "".join(rng.choice("etaoinshr xyzqé漢😀▁-12") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    assert [auto.count(w) for w in words] == [token_counts.greedy_count(w, have, longest) for w in words]
    tiny = ["a", "ab", "abcd", "c", "bcx", "dd"]  # needs links that pop several pieces, and texts that no piece covers
    small = token_counts.LongestMatch(tiny)
    for k in range(3000):
        w = "".join(rng.choice("abcdx") for _ in range(rng.randint(0, 9)))
        assert small.count(w) == token_counts.greedy_count(w, set(tiny), 4), w
    lost = token_counts.LongestMatch(["ab", "abxd"])
    assert lost.count("abxe") == 3 and lost.count("abxabx") == 4 and lost.count("") == 0
    assert token_counts.token_counts(spark.createDataFrame([], DOCS)).count() == 0
    clash = spark.createDataFrame([(1, "ab cd", 9)], "doc_id long, text string, n_words int")
    assert token_counts.token_counts(clash).first().n_words == 2
    rows = token_counts.token_counts(spark.createDataFrame(texts, DOCS)).collect()
    want = Counter((i, len((t or "").split()), sum(token_counts.greedy_count("▁" + w, have, longest) for w in (t or "").split())) for i, t in texts)
    assert Counter((r.doc_id, r.n_words, r.n_tokens) for r in rows) == want


def test_encoding(spark, texts):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=sp_encoding.MODEL)
    more = [*texts, (40, "  two  spaces "), (41, "▁mark ▁▁"), (42, "漢字 😀 <s> </s> <0x0A> <unk>\n\r\t"), (43, "aaaaaaaaaaaa bbbbbbbbb"), (44, "\x00 x")]
    rows = sp_encoding.encode(spark.createDataFrame(more, DOCS)).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == Counter((i, tuple(sp.encode(t or ""))) for i, t in more)
    assert all(r.round_trip for r in rows if r.doc_id != 44)
    alone = sp_encoding.encode(spark.createDataFrame(more, DOCS), verify=False).collect()
    theirs = {i: sp.encode(t or "") for i, t in more}
    assert {r.parity for r in alone} == {None}
    assert all(r.parity == (list(a.ids) == theirs[r.doc_id]) for r in rows for a in alone if r.doc_id == a.doc_id and r.doc_id is not None and r.doc_id != 27)
    assert [r.doc_id for r in rows if not r.parity] in ([], [44])
    back = sp_encoding.decode(spark.createDataFrame([(r.doc_id, r.ids) for r in rows if r.doc_id in (0, 29, 42)], "doc_id long, ids array<int>"))
    assert {r.doc_id: r.text for r in back.collect()} == {i: t for i, t in more if i in (0, 29, 42)}
    assert sp_encoding.encode(spark.createDataFrame([], DOCS)).count() == 0


def test_rebuilt_pipeline_alone_gives_the_runtimes_ids(spark):
    """All texts of a table, whole, with the runtime switched off in the operator."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=sp_encoding.MODEL)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: list(r.ids) for r in sp_encoding.encode(docs, verify=False).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = dict(zip(texts, sp.encode(list(texts.values()), num_threads=4), strict=True))
    assert {i for i in want if got[i] != want[i]} == set() and len(got) == len(want)


def _message(number, payload):
    def varint(n):
        out = b""
        while True:
            out += bytes([n & 0x7F | (0x80 if n > 0x7F else 0)])
            n >>= 7
            if not n:
                return out

    return varint(number << 3 | 2) + varint(len(payload)) + payload if isinstance(payload, bytes) else varint(number << 3) + varint(payload)


def test_unigram_model_is_rebuilt():
    import struct

    from sentencepiece import SentencePieceProcessor

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁", -3.0, 1), ("a", -4.0, 1), ("b", -4.5, 1), ("ab", -5.0, 1), ("▁ab", -6.0, 1), ("ba", -5.5, 1), ("▁a", -5.2, 1)]
    body = b"".join(_message(1, _message(1, p.encode()) + b"\x15" + struct.pack("<f", s) + _message(3, k)) for p, s, k in pieces)
    raw = body + _message(2, _message(3, 1)) + _message(3, _message(1, b"identity") + _message(3, 1) + _message(4, 1) + _message(5, 1))
    model = sp_encoding.parse_model(raw)
    assert model.kind == sp_encoding.UNIGRAM and model.pieces[6][0] == "ab"
    sp, tok = SentencePieceProcessor(model_proto=raw), sp_encoding.build(model)
    for t in ("abba", " ab  ba ", "b", "aab bab", "ab"):
        assert tok.encode(t, add_special_tokens=False).ids == sp.encode(t), t


def test_quality_learns_from_positives(spark):
    good = [(i, prose(i, 80).capitalize() + ".") for i in range(300)]
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in prose(i, 40).split())) for i in range(100)]
    docs = spark.createDataFrame([*good, *bad, (5000, None), (5001, ""), (None, "x")], DOCS)
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good[:200]] + [(i, 0, 0) for i, _ in bad[:60]] + [(None, 1, 0), (7000, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.scored(docs, quality.train(docs, labels)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert held and all(fold_mod(r.doc_id, 5) == 0 for r in held)
    right = [r.predicted == int(r.doc_id < 1000) for r in held if r.doc_id < 5000]
    assert sum(right) / len(right) > 0.95
    none = quality.scored(docs, quality.train(docs, labels.where("false")))
    assert {r.score for r in none.select("score").collect()} == {0.5}


def test_prior_and_risk_of_the_output_layer(spark):
    rng = np.random.default_rng(7)
    good, bad = (lambda n: rng.normal(1.5, 1, (n, 6))), (lambda n: rng.normal(-1.5, 1, (n, 6)))
    p, u = good(3000), np.vstack([good(2100), bad(900)])
    prior = quality.estimate_prior(p, u)
    assert abs(prior - 0.7) < 0.06
    model = quality.fit(p, u, prior, steps=60)
    hidden = model.hide(u).astype(np.float32)
    table = spark.createDataFrame([(hidden[:1000].tobytes(),), (hidden[1000:].tobytes(),)], "h binary").repartition(2)
    new = quality.refine(table, p, model, ridge=0.01)

    def risk(m):  # by definition, with the logistic loss
        f = lambda x: m.hide(x) @ m.out + m.out_bias
        plus, minus = (lambda x: np.logaddexp(0, -f(x)).mean()), (lambda x: np.logaddexp(0, f(x)).mean())
        return prior * plus(p) + minus(u) - prior * minus(p)

    held = 0.01 / 2 * (((new.out - model.out) ** 2).sum() + (new.out_bias - model.out_bias) ** 2)
    assert risk(new) + held < risk(model) and not np.allclose(new.out, model.out)
    for _ in range(50):  # no near output layer is better
        other = quality.replace(new, out=new.out + rng.normal(0, 0.02, len(new.out)), out_bias=new.out_bias + rng.normal(0, 0.02))
        held_too = 0.01 / 2 * (((other.out - model.out) ** 2).sum() + (other.out_bias - model.out_bias) ** 2)
        assert risk(other) + held_too > risk(new) + held - 1e-4


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(i % 7, prose(i % 9, 30), 5, "x") for i in range(60)] + [(None, None, 5, "y"), (1, "", 6, "z")], "doc_id long, text string, score int, predicted string")
    labels = spark.createDataFrame([(i, 1) for i in range(7)] * 2, "doc_id long, quality int")
    model = quality.train(docs.select("doc_id", "text"), labels)
    rows = quality.scored(docs, model).collect()  # columns of these names are replaced
    assert len(rows) == 62 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    assert len({r.score for r in rows if not r.text}) == 1
    assert quality.train(docs.where("false").select("doc_id", "text"), labels) is None
    assert quality.scored(docs.where("false"), model).count() == 0


def test_vectors_by_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    vs = [(i, (base[i % 60] + rng.normal(size=16) * 0.12 * (i >= 60)).astype(np.float32).tolist(), i % 3 if i < 170 else 1) for i in range(300)]
    vs += [(300 + i, vs[4][1], vs[4][2]) for i in range(5)] + [(400, (np.array(vs[4][1]) * 2).tolist(), vs[4][2])]
    odd = [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, [1.0] * 15 + [None], 1), (504, vs[4][1], None), (505, vs[4][1][:8], vs[4][2]), (506, [], 1)]
    rows = vectors.near_duplicates(spark.createDataFrame([*vs, *odd], "vec_id long, embedding array<float>, label int"), tile=40).collect()
    e = np.array([v for _, v, _ in vs], np.float32).astype(float)
    ids, lab = np.array([i for i, _, _ in vs]), np.array([k for *_, k in vs])
    c = e @ e.T / np.outer(np.linalg.norm(e, axis=1), np.linalg.norm(e, axis=1))
    near = (c >= 0.93) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(near, False)
    comp = ids.copy()
    while True:
        new = np.array([min([comp[i], *comp[near[i]]]) for i in range(len(ids))])
        if (new == comp).all():
            break
        comp = new
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rows}
    assert near.sum() > 400
    assert got == {int(i): (int(near[k].sum()), int(comp[k]), bool(i == comp[k])) for k, i in enumerate(ids)} | {i: (0, i, True) for i, *_ in odd}
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_one_id_with_several_vectors(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    near = [0.99, 0.05, 0.0]
    kinds = "vec_id long, embedding array<double>, label int"
    rows = vectors.near_duplicates(spark.createDataFrame([(1, a, 1), (1, b, 1), (2, a, 1), (3, near, 1), (4, b, 2)], kinds)).collect()
    assert Counter(tuple(r) for r in rows) == Counter({(1, 2, 1, True): 1, (1, 0, 1, True): 1, (2, 2, 1, False): 1, (3, 2, 1, False): 1, (4, 0, 4, True): 1})


def test_a_narrow_label_is_dealt_to_tiles(spark):
    rng = np.random.default_rng(6)
    vs = np.array([1.0, 0, 0, 0]) + np.concatenate([np.zeros((400, 1)), rng.normal(size=(400, 3)) * 1e-7], axis=1)
    kinds = "vec_id long, embedding array<double>, label int"
    rows = vectors.near_duplicates(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vs)], kinds), tile=50).collect()
    assert {(r.n_links, r.component_id) for r in rows} == {(399, 0)} and len(rows) == 400


def plain_repeats(rows, k=50):
    docs = [(2**63 - 1 if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in docs:
        for p in range(len(b) - k + 1):
            first[b[p : p + k]] = min(i, first.get(b[p : p + k], i))
    out = Counter()
    for (i, b), (doc_id, _) in zip(docs, rows, strict=True):
        gone = [False] * len(b)
        for p in range(len(b) - k + 1):
            if first[b[p : p + k]] < i:
                gone[p : p + k] = [True] * k
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out[doc_id, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_repeats_by_brute_force(spark, texts, monkeypatch):
    rng = random.Random(8)
    shared = [prose(200 + i, 14) for i in range(6)]
    more = [(100 + i, " ".join(rng.choice([*shared, prose(300 + i, 9), shared[0][:55], "é" * 40, "ab" * 45]) for _ in range(5))) for i in range(60)]
    rows = [*texts, *more, (90, "x" * 300), (91, "x" * 120), (92, shared[1][3:60] + "\x00\x00" + shared[2])]
    rng.shuffle(rows)
    got = repeats.remove_repeats(spark.createDataFrame(rows, DOCS).repartition(3), texts=True).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == plain_repeats(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert repeats.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_runs_visit_only_ranges_with_keys():
    from fieldtrust.llm import chunks

    keys = np.sort(np.random.default_rng(1).integers(0, 2**64, 500, dtype=np.uint64))
    for ranges in (1, 7, 3000, 2**31):
        runs = chunks.runs(keys, ranges)
        assert [a for _, a, _ in runs] == [0, *(b for *_, b in runs[:-1])] and runs[-1][2] == 500 and len(runs) <= min(500, ranges)
        assert all(r < ranges and (chunks.range_of(keys[a:b], ranges) == r).all() for r, a, b in runs)
    assert chunks.runs(keys[:0], 5) == []


def test_interval_tree():
    strings = [b"banana", b"bananb", b"bandit", b"can", b"cane"]
    m = np.zeros((5, 6), np.uint8)
    for i, s in enumerate(strings):
        m[i, : len(s)] = list(s)
    order, lcp = repeats.sorted_suffixes(m, np.array([len(s) for s in strings]))
    assert [strings[i] for i in order] == sorted(strings) and lcp.tolist() == [0, 5, 3, 0, 3]
    assert sorted(map(tuple, repeats.lcp_intervals(lcp, 1).tolist())) == [(0, 2, 5, 3), (0, 3, 3, 0), (3, 5, 3, 0)]


def test_lm_by_brute_force(spark, texts):
    learned: list = []
    rows = lm.scores(spark.createDataFrame(texts, DOCS), learned).collect()
    toks = {}
    count, pairs, n = Counter(), Counter(), 0
    for k, (i, t) in enumerate(texts):
        w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in (t or "").split()] + [""]
        toks[k] = w
        if fold_mod(i, 7) != 2:
            count.update(w)
            pairs.update(zip(["", *w[:-1]], w, strict=True))
            n += len(w)
    v = len(count)
    want = Counter((i, fold_mod(i, 7) == 2, len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 6)) for (i, _), w in zip(texts, toks.values(), strict=True))
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    lam = learned[0]
    assert lam.shape == (lm.BUCKETS, 3) and np.allclose(lam.sum(axis=1), 1)

    def by_hand(w):
        total = 0.0
        for before, x in zip(["", *w[:-1]], w, strict=True):
            c = count[before]
            a, b, u = lam[min(math.ceil(math.log2(c + 1)), lm.BUCKETS - 1)]
            total += math.log10(a * (pairs[before, x] / max(c, 1)) + b * count[x] / n + u / (v + 1))
        return round(total, 6)

    assert Counter((r.doc_id, round(r.score, 6)) for r in rows) == Counter((i, by_hand(w)) for (i, _), w in zip(texts, toks.values(), strict=True))
    assert lm.scores(spark.createDataFrame([], DOCS)).count() == 0
    one = lm.scores(spark.createDataFrame([(1, "")], DOCS)).collect()
    assert len(one) == 1 and math.isfinite(one[0].score)


def test_em_weights_sum_to_one_and_rise():
    cell = lambda b, f2, f1: (b * 4096 + f2 + 1024) * 4096 + f1 + 1024
    w = lm.learn_weights([(cell(3, -6, -30), 90), (cell(3, lm.NONE, -30), 10), (cell(5, lm.NONE, -20), 50)], 1e-4)
    assert np.allclose(w.sum(axis=1), 1) and w[3, 0] > 0.8 and w[5, 0] < 0.01 and w[0, 0] == 0


def test_decontamination(spark, texts):
    bench = [(1, prose(500, 40)), (2, prose(501, 14)), (3, "too short"), (4, None), (5, prose(502, 25))]
    w = bench[0][1].split()
    swapped = " ".join(x if k % 7 else "changed" for k, x in enumerate(w))
    rows = [*texts, (50, "start " + bench[0][1] + " end"), (51, swapped), (52, bench[1][1].upper().replace(" ", "!! ")), (53, " ".join(w[:9])), (54, "too short"), (55, " ".join(w[10:26]))]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, k1 int, new int")
    bm = spark.createDataFrame(bench, "item_id long, text string")
    flags = decontamination.flagged(docs.select("doc_id", "text"), bm).collect()
    assert len(flags) == len(rows) and {r.doc_id for r in flags if r.contaminated} == {50, 51, 52, 54, 55}
    left = decontamination.decontaminate(docs, bm)
    assert left.columns == docs.columns and left.count() == len(rows) - 5
    assert decontamination.decontaminate(docs, bm.where("false")).count() == len(rows)
    assert decontamination.flagged(docs.where("false").select("doc_id", "text"), bm).count() == 0


def test_short_items_and_repeated_items(spark):
    bench = [(1, "Who wrote The Silent River?"), (1, "Who wrote The Silent River?"), (2, "who wrote the silent river"), (3, "Yes."), (3, "another text of the third"), (4, "")]
    rows = [(1, "Say: who WROTE the silent river, then?"), (2, "who wrote the loud river"), (3, "yes"), (4, "yes indeed"), (5, "now another text of the third item"), (6, ""), (7, None)]
    got = decontamination.flagged(spark.createDataFrame(rows, DOCS), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {r.doc_id: (r.item_ids, r.best_matched) for r in got if r.contaminated} == {1: ("1,2", 5), 2: ("1,2", 4), 3: ("3", 1), 5: ("3", 5)}


@pytest.mark.parametrize("n", range(5, 21))
def test_items_of_every_length_with_any_tokens_changed(spark, n):
    """Every choice of as many changed tokens as may differ is found, one more is not; also where the text ends within the item."""
    item = [f"w{i}" for i in range(n)]
    run = min(n, 13)
    misses = run - -(-4 * run // 5)
    rows, want = [(1, "a b c " + " ".join(item[: n - misses])), (2, " ".join(item[misses:]) + " z")], {1, 2}
    for k in (misses, misses + 1):
        for c in itertools.combinations(range(n), k):
            rows.append((len(rows) + 1, "x y " + " ".join("other" if i in c else t for i, t in enumerate(item)) + " z"))
            if any(sum(i in range(s, s + run) for i in c) <= misses for s in range(n - run + 1)):
                want.add(rows[-1][0])
    got = decontamination.flagged(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert {r.doc_id for r in got if r.contaminated} == want


def test_seeds_against_a_search_without_seeds(spark):
    """Passages of 13 tokens with up to two substitutions, laid at every place: what the masks find of all that verify."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    bench = [(i, [rng.choice(words) for _ in range(40)]) for i in range(20)]
    rows = []
    for k in range(400):
        item = rng.choice(bench)[1]
        at = rng.randrange(len(item) - 12)
        part = item[at : at + 13]
        for _ in range(k % 3):
            part[rng.randrange(13)] = rng.choice(words)
        rows.append((k, " ".join([rng.choice(words) for _ in range(rng.randrange(30))] + part + [rng.choice(words) for _ in range(9)])))

    def overlaps(t, item):
        for shift in range(-len(item) + 1, len(t)):
            same = [0 <= i + shift < len(t) and t[i + shift] == x for i, x in enumerate(item)]
            if any(sum(same[s : s + 13]) >= 11 for s in range(len(item) - 12)):
                return True
        return False

    want = {k for k, t in rows if any(overlaps(t.split(), b) for _, b in bench)}
    docs, bm = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, " ".join(b)) for i, b in bench], "item_id long, text string")
    got = {r.doc_id for r in decontamination.flagged(docs, bm).collect() if r.contaminated}
    assert got == want and len(want) > 390


def luhn(s):
    return sum(d if k % 2 == 0 else (2 * d - 9 * (d > 4)) for k, d in enumerate(map(int, reversed(s)))) % 10 == 0


def test_surrogates(spark):
    rows = [
        (1, "write to Anna.Lee@mail.example.org or anna.lee@mail.example.org now, ip 10.2.3.44.", 0),
        (2, "call +1 (437) 555-0689 or 1-437-555-0689, card 4111 1111 1111 1111 and 4111111111111111", 0),
        (3, "order 1234567890123456 has no check digit; version 1.2.3; 12.5%", 0),
        (4, 'token = "ffc3105535f423f352535e4ac53b5fefe076ac6d" TOKEN = "FFC3105535F423F352535E4AC53B5FEFE076AC6D"', 0),
        (5, "Mrs. Jane Smith met Mr. Smith and Herr Karl Braun; госпожа Анна Петрова", 0),
        (6, "ssn 123-45-6789 iban DE89 3704 0044 0532 0130 00", 0),
        (7, None, 0), (8, "", 0), (9, "plain words only", 0), (9, "plain words only", 0), (None, "mail x.y@z.example.com", 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, new int")
    out = surrogates.surrogates(docs, "a key").collect()
    assert len(out) == len(rows)
    t = {r.doc_id: r.text for r in out}
    n = {r.doc_id: r.n_replaced for r in out}
    a, b = t[1].split()[2], t[1].split()[4]
    assert a.lower() == b and a[0].isupper() and "@" in b and b.endswith(".org") and "anna" not in b and "10.2.3.44" not in t[1] and n[1] == 3
    assert "4111" not in t[2] and "555-0689" not in t[2]
    spaced, joined = t[2].split(" card ")[1].split(" and ")
    assert spaced.replace(" ", "") == joined and luhn(joined) and joined[0] == "4"
    assert t[3] == rows[2][1] and t[7] is None and t[8] == "" and t[9] == rows[8][1] and n[3] == n[8] == 0
    low, up = t[4].split('"')[1], t[4].split('"')[3]
    assert low.upper() == up and len(low) == 40 and low != rows[3][1].split('"')[1]
    jane, smith = t[5].split()[1:3]
    assert t[5].split()[5] == smith and jane[-1] == "a" and "Smith" not in t[5] and any("а" <= c <= "я" for c in t[5].split()[-1])
    bban = t[6].split("iban ")[1].replace(" ", "")
    assert bban[:2] == "DE" and int("".join(str(int(c, 36)) for c in bban[4:] + bban[:4])) % 97 == 1 and "123-45" not in t[6]
    again = {r.doc_id: r.text for r in surrogates.surrogates(docs, "a key").collect()}
    other = {r.doc_id: r.text for r in surrogates.surrogates(docs, key="another").collect()}
    assert again == t and other[4] != t[4]
    assert surrogates.surrogates(docs.where("false"), "a key").count() == 0


def test_surrogates_keep_coreference(spark):
    rows = [
        (1, "John Smith wrote. Mr. John Smith replied, JOHN SMITH agreed; Smith left with Dr. Jane Roe, not Smithers."),
        (2, "Mrs. Jane Roe called 437-555-0689, 1-437-555-0689 and +1 (437) 555-0689; Dr ANNA LEE did not."),
        (3, "John Smith is named here without a form of address; and so is Jane."),
        (4, "Dr. Kim Park"),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    t = {r.doc_id: r.text for r in surrogates.surrogates(docs, "a key").collect()}
    given, family = t[1].split()[:2]
    assert f"{given} {family} wrote. Mr. {given} {family} replied, {given.upper()} {family.upper()} agreed; {family} left with Dr. " in t[1] and t[1].endswith("not Smithers.")
    assert "Smith " not in t[1] and "Jane" not in t[1]
    jane = t[1].split("Dr. ")[1].split(",")[0]
    assert t[2].startswith(f"Mrs. {jane} called ") and jane.split()[0].endswith("a")  # the gender of Dr. Jane is that of Mrs. Jane
    a, b, c = (x for x in t[2].split(" called ")[1].split(";")[0].replace(" and ", ", ").split(", "))
    digits = lambda x: "".join(ch for ch in x if ch.isdigit())
    assert digits(b) == digits(c) == "1" + digits(a) and digits(a) != "4375550689" and c[:4] == "+1 (" and b[:2] == "1-"
    loud = t[2].split("Dr ")[1].split(" did")[0]
    assert loud == loud.upper() and "ANNA" not in loud and t[3] == rows[2][1] and "Kim" not in t[4]
    with pytest.raises(TypeError):
        surrogates.surrogates(docs)


def test_surrogates_stay_distinct(spark):
    # ten-digit numbers of one shape: more than enough of them to meet by chance in the small room of four-letter hosts
    ents = spark.range(4000).select(F.lit("ssn").alias("kind"), F.format_string("%09d", F.col("id") * 211).alias("norm"))
    short = spark.range(150).select(F.lit("card").alias("kind"), F.format_string("4%03d", F.col("id")).alias("norm"))
    rows = surrogates.assign(ents.unionAll(short.limit(30)), "a key").collect()
    for kind in ("ssn", "card"):
        mine = [r for r in rows if r.kind == kind]
        assert len({r.surrogate for r in mine}) == len(mine) and not {r.surrogate for r in mine} & {r.norm for r in mine}
