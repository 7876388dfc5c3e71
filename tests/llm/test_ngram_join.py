import random

import pytest
from fixtures import AWKWARD, documents, empty
from pyspark.sql import functions as F
from tessera.llm import _common, ngram_join

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(texts, words, percent):
    sets = []
    for t in texts:
        w = (t or "").translate(FOLD).encode().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return [(k, len(s), find(k)) for k, s in enumerate(sets)]


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)]
    passage = [rng.choice(vocab) for _ in range(60)]
    out = list(AWKWARD)
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([2, 3, 9, 11, 40, 120, 300]))]
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 2, 8])):
            near = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                near[rng.randrange(len(near))] = rng.choice(vocab)
            out.append(" ".join(near if rng.random() < 0.7 else [*near, *passage]).upper())
    hub = [rng.choice(vocab) for _ in range(200)]
    for _ in range(60):
        near = list(hub)
        for _ in range(rng.randrange(9)):
            near[rng.randrange(200)] = f"x{rng.random()}"
        out.append(" ".join(near))
    rng.shuffle(out)
    return out


def test_against_all_pairs(spark):
    for seed, words, percent in ((1, 3, 90), (2, 5, 80), (3, 2, 70)):
        texts = corpus(seed)
        got = sorted(tuple(r) for r in ngram_join.jaccard_components(documents(spark, texts), words, percent).collect())
        assert got == brute(texts, words, percent)


def test_second_round_links_what_stars_miss(spark):
    # a chain in which each text links with the next only
    base = [f"c{k}" for k in range(400)]
    texts = [" ".join(base[k : k + 300]) for k in range(0, 100, 10)]
    got = [tuple(r) for r in ngram_join.jaccard_components(documents(spark, texts), 3, 90).collect()]
    assert sorted(got) == brute(texts, 3, 90)


def test_repeated_rows_and_empty(spark):
    docs = documents(spark, ["a b c d e f g h i j", "a b c d e f g h i j", None, "z"])
    twice = docs.union(docs)
    assert sorted(tuple(r) for r in ngram_join.jaccard_components(twice, 3, 90).collect()) == [(0, 8, 0)] * 2 + [(1, 8, 0)] * 2 + [(2, 0, 2)] * 2 + [(3, 1, 3)] * 2
    assert ngram_join.jaccard_components(empty(spark)).count() == 0
    kept = ngram_join.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]


def by_document(rows, words, percent):
    """(doc_id, n_shingles, component_id) of rows (doc_id or null, text): texts of one doc_id are one node."""
    of = [c for _, _, c in brute([t for _, t in rows], words, percent)]
    ns = [n for _, n, _ in brute([t for _, t in rows], words, percent)]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    first = {}
    for k, (doc, _) in enumerate(rows):
        top[find(k)] = find(of[k])
        if doc is not None:
            top[find(k)] = find(first.setdefault(doc, k))
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(k)] = min(doc, least.get(find(k), doc))
    return sorted(((d, n, least.get(find(k))) for k, ((d, _), n) in enumerate(zip(rows, ns, strict=True))), key=str)


def run(spark, rows, words, percent, **options):
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, rep long")
    return sorted((tuple(r) for r in ngram_join.jaccard_components(docs, words, percent, **options).collect()), key=str)


def test_one_id_on_different_texts(spark):
    text = lambda x: " ".join(f"{x}{k}" for k in range(200))
    a, b = text("a"), text("b")
    rows = [(0, b), (1, b), (1, a), (2, f"{a} more"), (2, None), (9007199254740993, f"{b} x"), (None, f"{a} y"), (None, "alone at last here"), (None, "alone at last here"), (7, None), (7, ""), (8, "alone at last here")]
    assert run(spark, rows, 3, 90) == by_document(rows, 3, 90)
    rng = random.Random(5)
    texts = corpus(5)[:90]
    rows = [(rng.choice([None, *range(40)]), t) for t in texts]
    assert run(spark, rows, 3, 80) == by_document(rows, 3, 80)
    docs = spark.createDataFrame([(d, t, 1) for d, t in [(0, b), (1, a), (1, a), (1, f"{a} z {b}"), (2, f"{a} more"), (None, "q"), (None, "q")]], "doc_id long, text string, rep long")
    assert sorted((str(r.doc_id), r.text) for r in ngram_join.drop_near_duplicates(docs).collect()) == sorted([("0", b), ("1", a), ("1", f"{a} z {b}"), ("None", "q")])


def test_above_the_size_that_is_broadcast_and_with_equal_short_digests(spark, monkeypatch):
    monkeypatch.setattr(_common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(_common, "LEAST_HEAVY", 3)
    texts = corpus(4)
    rows = [(k // 2 if k % 10 == 1 else k, t) for k, t in enumerate(texts)]
    assert run(spark, rows, 3, 80, digest_bits=6) == by_document(rows, 3, 80)


def test_pages_of_one_template_make_no_pairs(spark):
    """Pages that share 300 words and have 65 or more of their own do not link; none is an index row where they share an n-gram."""
    template = [f"t{k}" for k in range(300)]
    texts = [" ".join([*template, *(f"o{d}x{k}" for k in range(45 + d % 25))]) for d in range(400)]
    seen = {}
    monitored = ngram_join.round_two

    def watched(placed, percent):
        seen["index"] = placed.where(ngram_join._is_index(percent, F.col("n"), F.col("pos"))).count()
        pairs = monitored(placed, percent)
        seen["pairs"] = pairs.count()
        return pairs

    ngram_join.round_two = watched
    try:
        got = run(spark, list(enumerate(texts)), 5, 80)
    finally:
        ngram_join.round_two = monitored
    assert got == by_document(list(enumerate(texts)), 5, 80) and len({c for _, _, c in got}) == 400
    assert seen["index"] < 400 and seen["pairs"] < 400


@pytest.mark.parametrize("words", [1, 2, 3, 5])
def test_exact_sets(words):
    rng = random.Random(words)
    for _ in range(200):
        one, two = ([str(rng.randrange(rng.choice([2, 9, 4000]))).encode() for _ in range(rng.choice([1, 2, 4, 30, 300]))] for _ in range(2))
        two = one[: rng.randrange(len(one))] + two if rng.random() < 0.5 else two
        sets = [{tuple(x[k : k + words]) for k in range(max(1, len(x) - words + 1))} for x in (one, two)]
        a, b = ngram_join.exact_sets(one, two, words)
        assert (len(a), len(b), len({*a.tolist()} & {*b.tolist()})) == (len(sets[0]), len(sets[1]), len(sets[0] & sets[1]))
