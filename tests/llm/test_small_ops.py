import hashlib
import struct
import zlib

import public_tokenizers
import pytest
from fixtures import AWKWARD, documents, empty
from pyspark.sql import functions as F
from tessera.llm import _common, exact_dedup, mixing, packing, token_counts

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_exact_dedup(spark):
    texts = [*AWKWARD, *["copy of one"] * 300, None, "One"]
    got = {r.doc_id: r for r in exact_dedup.exact_duplicates(documents(spark, texts), salts=3).collect()}
    groups = {}
    for k, t in enumerate(texts):
        groups.setdefault((t or "").translate(FOLD), []).append(k)
    assert len(got) == len(texts)
    for t, ids in groups.items():
        for k in ids:
            assert (got[k].keep_id, got[k].group_size, got[k].kept) == (max(ids), len(ids), k == max(ids))
            assert got[k].text_sha256 == hashlib.sha256(t.encode()).hexdigest()
    kept = exact_dedup.drop_exact_duplicates(documents(spark, texts))
    assert kept.columns == documents(spark, texts).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(max(v) for v in groups.values())
    assert exact_dedup.exact_duplicates(empty(spark)).count() == 0


def test_exact_dedup_keeps_one_row_of_a_repeated_id_and_text(spark):
    rows = [(1, "a"), (1, "A"), (1, "b"), (2, "b"), (None, "c"), (None, "C"), (None, "d"), (3, "d"), (3, "d"), (3, "e")]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, _n long")
    kept = sorted((str(r.doc_id), r.text.lower()) for r in exact_dedup.drop_exact_duplicates(docs).collect())
    assert kept == [("1", "a"), ("2", "b"), ("3", "d"), ("3", "e"), ("None", "c")]


def test_exact_dedup_plan_has_no_python(spark, sf):
    plan = exact_dedup.op3_exact_dedup(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_packing_is_a_whole_round_trip(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    texts = [*AWKWARD, "É İstanbul ÉÀ, ñÑ. ß ẞ ĳĲ ǅ e\u0301 E\u0301, ﬁ 'S it'S a\u00adb x\u200by Ω̈ \x85a\u2028b", *[f"repeat {k} " * (k % 97) for k in range(400)], "longer than a window " * 4000]
    rows = packing.pack_documents(documents(spark, texts), per_shard=200).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for k, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(by_doc[k], key=lambda r: r.start):
            part = ids[r.start : r.start + r.length]
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW
    used = sum(r.length for r in rows)
    assert len(by_seq) <= used / packing.WINDOW + 3
    assert packing.pack_documents(empty(spark)).count() == 0


def test_ids_of_every_latin_letter_and_what_joins_it():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    ids_of = packing.encoder(packing.TOKENIZER)
    letters = [chr(c) for c in range(0x250) if chr(c).isalpha()]
    runs = [*letters, *(x + y for x in letters for y in (".", ",", "..", ",.", "a.", "\u0307", "\u0307.", "A", "I,", "\u0301a."))]
    runs += [y + x for x in letters for y in ("a", "I", "\u0130", "'", ".", "\u01c5")] + [y + x + z for x in letters for y in ("n", "\u0130") for z in (".", ",", "t,")]
    runs += ["\u0130.", "\u0130. x", "x \u0130, \u0130STANBUL. i\u0307.", "\u1e9e.", "\u212a.", "\u03a3.", "\u0390."]
    for run in runs:
        want = tok.encode(run, add_special_tokens=False).ids
        assert ids_of.text(run) == struct.pack(f"<{len(want)}I", *want), run


LARGE = [(None, "one two"), (9007199254740993, "three"), (9007199254740995, "four five six"), (None, None), (-(2**63), "x"), (2**63 - 1, "y z")]


def test_ids_beyond_doubles_beside_null(spark):
    docs = spark.createDataFrame([(i, t, "s") for i, t in LARGE], "doc_id long, text string, source string").repartition(1)
    want = sorted(str(i) for i, _ in LARGE)
    assert sorted(str(r.doc_id) for r in packing.pack_documents(docs).collect()) == want
    assert sorted(str(r.doc_id) for r in mixing.mix_copies(docs).collect()) == want
    out = sorted((str(r.doc_id), str(r.text)) for r in mixing.mixed(docs, weights=(1,)).collect())
    assert out == sorted((str(i), str(t)) for i, t in LARGE)  # each at rate 1


def test_one_id_on_many_rows_is_spread(spark):
    docs = spark.range(40_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("w "), F.when(F.col("id") % 4 == 0, F.lit("v ")).otherwise(F.lit(""))).alias("text"), F.when(F.col("id") % 8 < 3, F.lit("a")).otherwise(F.lit("b")).alias("source"))
    groups = packing.pack_documents(docs).groupBy(F.shiftright("sequence_id", 32).alias("g")).count().collect()
    assert len(groups) == 10 and max(r["count"] for r in groups) < 5_000
    rows = mixing.mix_copies(docs)
    of = {r.source: r for r in rows.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("copies") * F.col("size")).alias("words"), F.first("target").alias("target"), F.max("copies").alias("most")).collect()}
    assert (of["a"].n, of["b"].n) == (15_000, 25_000) and all(abs(r.words - r.target) <= 2 and r.most <= 3 for r in of.values())
    words = {r.source: r.n for r in mixing.mixed(docs).groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()}
    assert words == {s: r.words for s, r in of.items()}


@pytest.mark.parametrize("most_bytes", [0, 16 << 20])
def test_targets_of_many_sources(spark, monkeypatch, most_bytes):
    monkeypatch.setattr(_common, "BROADCAST_BYTES", most_bytes)
    sizes = spark.range(9_000).select(F.when(F.col("id") % 3000 > 0, F.concat(F.lit("s"), (F.col("id") % 3000).cast("string"))).alias("source"), (F.col("id") % 3000 % 71 * F.when(F.col("id") % 7 == 0, 40).otherwise(1)).cast("long").alias("size"))
    got = {r.source: r for r in mixing.source_targets(sizes).collect()}
    size = {}
    for r in sizes.collect():
        size[r.source] = size.get(r.source, 0) + r["size"]
    assert {s: r.source_size for s, r in got.items()} == size
    want = plain_targets(size)
    assert all(abs(got[s].target - want[s]) < 1e-6 * max(1, want[s]) for s in size)
    docs = sizes.where("source IS NULL OR source < 's2'").select(F.monotonically_increasing_id().alias("doc_id"), F.repeat(F.lit("w "), F.col("size").cast("int")).alias("text"), "source")
    rows = mixing.mix_copies(docs, per_shard=50).collect()
    taken = {}
    for r in rows:
        taken.setdefault(r.source, [r.target, 0, 0])
        taken[r.source][1] += r.copies * r.size
        taken[r.source][2] = max(taken[r.source][2], r.size)
    assert len(rows) == docs.count() and all(abs(t - n) <= most for t, n, most in taken.values())


def plain_targets(size, weights=(5, 2, 1)):
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, active, target = sum(size.values()), set(size), {}
    while active:
        share = left / sum(weight[s] for s in active)
        over = {s for s in active if share * weight[s] > 3 * size[s]}
        if not over:
            return target | {s: share * weight[s] for s in active}
        target |= {s: 3 * size[s] for s in over}
        left -= sum(target[s] for s in over)
        active -= over
    return target


def test_best_fit_matches_a_plain_search():
    import random

    rng = random.Random(5)
    for _ in range(30):
        lengths = sorted((rng.randint(1, 64) for _ in range(200)), reverse=True)
        which, offset = packing.best_fit_decreasing(lengths, 64)
        left, fills = [], []
        for n in lengths:
            fit = [(c, k) for k, c in enumerate(left) if c >= n]
            if fit:
                tight = min(c for c, _ in fit)
                fills.append(tight)
                k = next(k for c, k in fit if c == tight)
                left[k] -= n
            else:
                fills.append(64)
                left.append(64 - n)
        assert [64 - o for o in offset.tolist()] == fills
        assert max(which.tolist()) + 1 == len(left)


def test_token_counts(spark):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))
    got = {r.doc_id: r for r in token_counts.token_counts(documents(spark, AWKWARD), batch_bytes=50, long_chars=40).collect()}
    for k, t in enumerate(AWKWARD):
        n = len(model.encode(t or ""))
        assert (got[k].n_tokens, got[k].n_bytes, got[k].over_limit) == (n, len((t or "").encode()), n > 4096)
    assert token_counts.token_counts(empty(spark)).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_token_counts_of_a_json_tokenizer(spark, name):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(name))
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(documents(spark, AWKWARD), tokenizer=name).collect()}
    assert got == {k: len(tok.encode(t or "", add_special_tokens=False).ids) for k, t in enumerate(AWKWARD)}


def test_mixing(spark):
    texts = [("w " * (7 * k % 53)).strip() for k in range(1200)] + [None, ""]
    sources = ["b" if k % 3 else "a" if k % 2 else None for k in range(len(texts))]
    docs = documents(spark, texts, sources)
    rows = mixing.mix_copies(docs, per_shard=100).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    size = {}
    for t, s in zip(texts, sources, strict=True):
        size[s] = size.get(s, 0) + len((t or "").split())
    total, target = sum(size.values()), {}
    weight = {"a": 5, "b": 2, None: 1}
    left, active = total, set(size)
    while active:
        share = left / sum(weight[s] for s in active)
        over = {s for s in active if share * weight[s] > 3 * size[s]}
        if not over:
            target |= {s: share * weight[s] for s in active}
            break
        target |= {s: 3 * size[s] for s in over}
        left -= sum(target[s] for s in over)
        active -= over
    taken = {}
    for r in rows:
        assert 0 <= r.copies <= 3 and r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
    for s in size:
        assert abs(taken[s] - target[s]) <= 53
    again = {r.doc_id: r.copies for r in mixing.mix_copies(docs.repartition(5), per_shard=100).collect()}
    assert again == {r.doc_id: r.copies for r in rows}
    out = mixing.mixed(docs, per_shard=100)
    assert out.columns == docs.columns
    assert out.count() == sum(again.values())
    assert mixing.mix_copies(empty(spark)).count() == 0


def test_pivot_keeps_expected_words():
    ids, sizes, probs = list(range(500)), [1 + k % 17 for k in range(500)], [0.3] * 500
    before = sum(n * p for n, p in zip(sizes, probs, strict=True))
    mean = [0.0] * 500
    for seed in range(300):
        p, held = mixing.pivot(ids, sizes, probs, seed)
        assert abs(sum(n * x for n, x in zip(sizes, p, strict=True)) - before) < 1e-6
        assert all(x in (0.0, 1.0) for k, x in enumerate(p) if k != held)
        mean = [m + x / 300 for m, x in zip(mean, p, strict=True)]
    assert abs(sum(mean) / 500 - 0.3) < 0.02 and max(abs(m - 0.3) for m in mean) < 0.13


def test_pivot_against_exact_fractions():
    """The same pairings and random numbers, in exact arithmetic: the smaller of what one can give and the other take moves."""
    import random
    from fractions import Fraction

    rng = random.Random(9)
    for seed in range(20):
        n = rng.randrange(1, 60)
        sizes = [rng.choice([0, 1, 2, 5, 17]) for _ in range(n)]
        probs = [Fraction(rng.randrange(0, 17), 16) for _ in range(n)]
        got, held = mixing.pivot(list(range(n)), sizes, [float(x) for x in probs], seed)
        p, open_ = list(probs), None
        for k in range(n):
            if p[k] in (0, 1):
                continue
            if sizes[k] == 0:
                p[k] = Fraction(int(mixing._chance(seed, k, "") < p[k]))
                continue
            if open_ is None:
                open_ = k
                continue
            i, m, w = open_, sizes[open_], sizes[k]
            up, down = min(m * (1 - p[i]), w * p[k]), min(m * p[i], w * (1 - p[k]))
            move = up if mixing._chance(seed, i, k) * float(up + down) < float(down) else -down
            p[i], p[k] = p[i] + move / m, p[k] - move / w
            open_ = i if 0 < p[i] < 1 else k if 0 < p[k] < 1 else None
        assert held == (-1 if open_ is None else open_)
        assert all(abs(x - float(y)) < 1e-9 for x, y in zip(got, p, strict=True))
