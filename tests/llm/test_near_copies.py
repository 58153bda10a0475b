"""The near copies of the pipeline come from fingerprints linked through BK-trees; the exact search only adds to them."""

import random

from tidemark.llm import simhash_dedup


def documents():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    base = [rng.choices(words, k=1500) for _ in range(6)]
    texts = [" ".join(b) for b in base] + [" ".join([*b[:700], "edited", *b[701:]]) for b in base[:3]]
    far = base[5][:]
    for at in range(100, 1500, 130):  # similarity still above 0.8
        far[at] = "other"
    return [(i, t) for i, t in enumerate([*texts, " ".join(far), texts[0], ""])] + [(20, None)]


def test_fingerprints_link_near_copies_and_the_exact_search_adds_the_rest(spark, monkeypatch):
    docs = spark.createDataFrame(documents(), "doc_id long, text string")
    whole = {r["doc_id"] for r in simhash_dedup.drop_near_duplicates(docs).collect()}
    assert whole == {0, 1, 2, 3, 4, 5, 11}
    # Without a shared shingle nothing but the trees can find a copy.
    real = simhash_dedup._shared_shingles
    monkeypatch.setattr(simhash_dedup, "_shared_shingles", lambda units, similarity: real(units, similarity).where("false"))
    alone = {r["doc_id"] for r in simhash_dedup.drop_near_duplicates(docs).collect()}
    assert whole <= alone and not alone & {6, 7, 8, 10}
