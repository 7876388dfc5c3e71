import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from fixtures import AWKWARD, documents
from pyspark.sql import functions as F
from tessera.llm import line_quality, mixing, packing
from test_ngram_join import FOLD, brute


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    own = lambda n: " ".join(word() for _ in range(n))
    texts = [t for t in AWKWARD if t is None or len(t) < 9000]
    for _ in range(40):
        base = own(rng.randrange(15, 80)).split()
        texts += [" ".join(base)] * rng.choice([1, 1, 2, 3])
        near = list(base)
        near[3] = "edited"
        texts.append(" ".join(near).upper())
    texts += [f"{own(30)}\nShared footer line\n{own(4)}" for _ in range(30)] + [f"Shared footer line\n{own(9)}" for _ in range(3)]
    return texts


def test_stages_against_plain_steps(spark):
    texts = corpus()
    docs = documents(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    one = corpus_pipeline.quality_rules(spark, docs, "").cache()
    want = {}
    for k, t in enumerate(texts):
        n, *_, repeat = line_quality.base_counts(t or "")
        if n >= 10 and 100 * repeat <= 20 * n:
            want[k] = t
    assert ids(one) == sorted(want) and one.columns == docs.columns

    two = corpus_pipeline.exact_dedup_stage(spark, one, "").cache()
    cleaned = {r.doc_id: r.text for r in one.collect()}
    last = {}
    for k in sorted(cleaned):
        last[cleaned[k].translate(FOLD)] = k
    assert ids(two) == sorted(last.values())

    three = corpus_pipeline.near_dedup_stage(spark, two, "").cache()
    order = sorted(last.values())
    kept = [order[k] for k, _, c in brute([cleaned[k] for k in order], 5, 80) if k == c]
    assert ids(three) == kept and len(kept) < len(order)

    four = corpus_pipeline.mixing_stage(spark, three, "").cache()
    copies = {r.doc_id: r.copies for r in mixing.mix_copies(three).collect()}
    assert ids(four) == sorted(k for k, n in copies.items() for _ in range(n)) and four.columns == docs.columns

    five = corpus_pipeline.packing_stage(spark, four, "")
    rows = five.groupBy("doc_id", "start").agg(F.count("*").alias("n"), F.first("ids_crc32").alias("crc"), F.first("length").alias("length")).collect()
    encode = packing.encoder(packing.TOKENIZER).text
    for r in rows:
        part = np.frombuffer(encode(cleaned[r.doc_id]), "<u4").tolist() + [packing.END_ID]
        assert r.n == copies[r.doc_id] and r.crc == zlib.crc32(np.array(part[r.start : r.start + r.length], "<u4").tobytes())


def test_run_gives_all_pieces(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert rows.columns == [c.split()[0] for c in packing.PACKED.split(", ")]
    assert rows.count() > 50
    assert rows.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).where(f"n <> end OR n > {packing.WINDOW}").count() == 0


def test_names():
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "ngram_jaccard_join", "mixing", "packing"]
    assert public_tokenizers.path(packing.TOKENIZER)
