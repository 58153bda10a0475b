"""Operators on whole tables against brute force, and the pipeline's stages."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import decontamination, license_scans, links, secret_scans, simhash_dedup, suffix_dedup, toxicity, url_filters

DOCS = "doc_id long, text string, lang string, source string, n_chars long, print string, id long, bucket long"


def docs_of(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, 2) for i, t in pairs], DOCS)


# URL filters.

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("org", "/fr/", "allow"), ("org", "/f", "block"), ("org", "/f", "block")]
URLS = [None, "", "no scheme", "http://a.net", "http://a.net/", "HTTP://EXAMPLE.NET/en/x?y#z", "http://sub.Example.net/en", "http://notexample.net/en/", "x://org/fr/?u=http://b.net/", "x://my.org/fr", "x://my.org?u=http://b.net/x", "x:///net/", "x://borg/fr/"]


def judge(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


@pytest.mark.parametrize("broadcast", [8 << 20, 0])
def test_url_rules(spark, broadcast):
    pages = spark.createDataFrame([(i, u, "h", "key") for i, u in enumerate(URLS * 2)], "page_id long, url string, html string, key string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r.page_id: r[2:] for r in url_filters.judge_urls(pages, rules, broadcast_bytes=broadcast).collect()}
    assert got == {i: judge(u) for i, u in enumerate(URLS * 2)}
    none = url_filters.judge_urls(pages, rules.limit(0)).where("verdict <> 'allow' or rule is not null")
    assert none.count() == 0 and url_filters.judge_urls(pages.limit(0), rules).count() == 0


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    other = spark.range(3000, 9000).select(F.concat(F.lit("k"), "id").alias("key"))
    n = 3000 * url_filters.BITS_PER_KEY // 512
    blocks = url_filters.blocked_filter(keys, n)
    passed = lambda df: df.withColumn("block", url_filters._block(F.col("key"), n)).join(blocks, "block").where(url_filters._may_hold(F.col("key"))).count()
    assert passed(keys) == 3000 and passed(other) < 300


# SimHash.


def reference_print(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components_equal_brute_force(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choices("Alpha beta gamma delta eps zeta eta theta".split(), k=rng.randint(1, 60))) for _ in range(30)]
    texts = [None, "", "  ", "one", "one two", "É ß"] + base + [b + " x" for b in base] + base[:5] + ["w " * 400 + str(i) for i in range(40)]
    pairs = [(i + 3, t) for i, t in enumerate(texts)] + [(None, "one")]
    got = simhash_dedup.simhash_components(docs_of(spark, pairs)).collect()
    prints = [reference_print(t) for _, t in pairs]
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(pairs)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(pairs):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    want = [(i, f"{prints[k]:016x}", least.get(find(k))) for k, (i, _) in enumerate(pairs)]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert simhash_dedup.simhash_components(docs_of(spark, pairs).limit(0)).count() == 0


def test_bk_search_finds_every_pair():
    rng = np.random.default_rng(1)
    points = rng.integers(-(2**62), 2**62, (4, 2))[rng.integers(0, 4, 600)]
    for _ in range(8):
        points = points ^ ((np.int64(1) << rng.integers(0, 63, (600, 2))) * rng.integers(0, 2, (600, 2)))
    tree = np.sort(rng.integers(0, 5, 600))
    got = {(int(i), int(j), int(d)) for a in simhash_dedup.bk_search(points, tree, 4) for i, j, d in zip(*a, strict=True)}
    d = np.bitwise_count((points[:, None] ^ points[None]).view(np.uint64)).sum(axis=2)
    assert got == {(i, j, int(d[i, j])) for i in range(600) for j in range(i) if tree[i] == tree[j] and d[i, j] <= 4}


@pytest.mark.parametrize("prints", [[3, 12, 15], [7, 56, 448, 3 | 8, 0], list(range(0, 256, 5))])
def test_near_links_connect_what_only_a_hub_connects(spark, prints):
    near = {a: {b for b in prints if (a ^ b).bit_count() <= 2} for a in prints}
    expected = {}
    for start in prints:
        reached, edge = {start}, [start]
        while edge:
            edge = [b for a in edge for b in near[a] - reached]
            reached |= set(edge)
        expected[start] = min(reached)
    rows = spark.createDataFrame([(p, [p]) for p in prints], "id long, fingerprint array<long>")
    found = links.components(simhash_dedup.near_links(rows, simhash_dedup.exact_masks(2), 2)).collect()
    assert {p: p for p in prints} | {r["node"]: r["root"] for r in found} == expected


def test_exact_masks_meet_within_the_radius():
    rng, masks = random.Random(6), simhash_dedup.exact_masks(2)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        assert any(x & (m[0] % (1 << 64)) == y & (m[0] % (1 << 64)) for m in masks)


def test_components_of_chains_stars_and_empty(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.root for r in links.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 160)}, 200: 200, 201: 200}
    assert links.components(spark.createDataFrame([], "a long, b long")).count() == 0


def varied(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = "changed" + str(rng.randrange(10**6))
    return " ".join(words)


def test_near_copies_drop_to_one_and_clean_texts_stay(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    alone = [" ".join(rng.choices(vocabulary, k=rng.randint(20, 300))) for _ in range(60)]
    source = [rng.choices(vocabulary, k=200) for _ in range(15)]
    copies = [varied(rng, s, rng.randint(0, 2)) for s in source for _ in range(6)]
    pairs = list(enumerate(alone + copies)) + [(0, alone[0]), (900, None), (901, ""), (None, "lonely text of no id")]
    got = simhash_dedup.drop_near_duplicates(docs_of(spark, pairs)).collect()
    ids = [r.doc_id for r in got]
    assert len(ids) == len(set(ids)) and set(range(60)) <= set(ids) and None in ids and 900 in ids and 901 not in ids
    assert sorted(i for i in ids if i is not None and 60 <= i < 150) == [60 + 6 * k for k in range(15)]
    assert got[0].asDict().keys() == {c.split()[0] for c in DOCS.split(", ")}


def test_large_shards_are_dealt_and_stay_linked(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "SHARD_MEMBERS", 20)
    rng = random.Random(8)
    source = [f"w{i}" for i in range(400)]
    got = simhash_dedup.drop_near_duplicates(docs_of(spark, [(i, varied(rng, source, 2)) for i in range(150)])).collect()
    assert [r.doc_id for r in got] == [0]


# Suffix dedup.


def brute_kept(pairs, similarity=0.8):
    """Ids that stay: the smallest of each component of the pairs of that Jaccard similarity of five-word shingles."""
    sets = []
    for _, text in pairs:
        words = text.lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    root = list(range(len(pairs)))
    for i in range(len(pairs)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9 and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    least = {}
    for r, (i, _) in zip(root, pairs, strict=True):
        least[r] = min(i, least.get(r, i))
    return sorted(least.values())


def kept(spark, pairs):
    return sorted(r["doc_id"] for r in simhash_dedup.drop_near_duplicates(docs_of(spark, pairs)).collect())


def test_near_copies_are_those_of_the_contract(spark):
    rng = random.Random(17)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts = []
    for size in [8, 9, 10, 12, 44, 104, 204]:  # words; 4 shingles fewer
        for grown in (0.24, 0.25, 0.26):  # similarity 0.8 is a quarter more shingles
            source = rng.choices(vocabulary, k=size)
            texts += [" ".join(source), " ".join(source + rng.choices(vocabulary, k=max(1, round(grown * (size - 4)))))]
    texts += [varied(rng, source, n) for n in range(1, 9) for source in [rng.choices(vocabulary, k=150)] for _ in range(4)]
    pairs = list(enumerate(texts))
    rng.shuffle(pairs)
    assert kept(spark, pairs) == brute_kept(pairs)


def test_true_copy_behind_nearer_candidates_is_found(spark):
    """Many texts share most two-word shingles with a text, and only a later one is its copy by five-word shingles."""
    rng, texts = random.Random(29), []
    for g in range(5):
        words = [f"g{g}w{i}" for i in range(160)]
        for k in range(30):  # six words changed far apart: 30 of 156 five-word shingles
            texts.append(" ".join(f"c{k}x{i}" if i % 25 == k % 25 and i > 4 else w for i, w in enumerate(words)))
        texts += [" ".join(words + [f"more{i}" for i in range(35)]), " ".join(words)]
    pairs = [(1000 - i, t) for i, t in enumerate(texts)]
    assert kept(spark, pairs) == brute_kept(pairs)


def test_small_groups_in_crowded_buckets_are_found(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "SHARD_MEMBERS", 7)
    rng = random.Random(23)
    template, texts = rng.choices("abcdefghij", k=120), []
    for i in range(60):  # every tenth word differs between pairs; a pair's two differ in the last word
        first = [f"p{i}x{k}" if k % 10 == 5 else w for k, w in enumerate(template)]
        texts += [" ".join(first), " ".join(first[:-1] + ["end" + str(i)])]
        texts.append(" ".join(template[:60] + [f"q{i}x{k}" for k in range(60)]))
    pairs = list(enumerate(texts))
    rng.shuffle(pairs)
    assert kept(spark, pairs) == brute_kept(pairs)


def brute_suffixes(pairs):
    first = {}
    for i, t in pairs:
        raw = (t or "").encode()
        for p in range(len(raw) - 49):
            s = raw[p : p + 50]
            first[s] = min(first.get(s, 10**9), 10**9 if i is None else i)
    out = []
    for i, t in pairs:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - 49):
            if first[raw[p : p + 50]] < (10**9 if i is None else i):
                gone[p : p + 50] = [True] * 50
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("chunk,unit,many,slice,near", [(2 << 20, 32 << 20, 4, 1 << 20, 6), (1500, 4000, 1, 40, 2), (1500, 1, 2, 1, 1), (1500, 9000, 32, 100, 1)])
def test_suffix_dedup_equals_brute_force(spark, chunk, unit, many, slice, near):
    settings = suffix_dedup.Settings(chunk, unit, many, slice, near)
    rng = random.Random(9)
    passage = ["".join(rng.choices("abcdefgh é", k=rng.randint(40, 300))) for _ in range(12)]
    cut = lambda p: p[rng.randint(0, len(p) // 2) : rng.randint(len(p) // 2, len(p))]
    mix = lambda: "".join(cut(rng.choice(passage)) + "".join(rng.choices("xyz", k=rng.randint(0, 20))) for _ in range(5))
    texts = [None, "", "a" * 49, "a" * 50, "a" * 120, "b\x00" * 60, *passage, *(mix() for _ in range(90)), *passage[:4]]
    pairs = [(rng.randint(0, 150), t) for t in texts] + [(None, passage[0]), (None, passage[0]), (5, passage[1]), (5, passage[1])]
    got = suffix_dedup.suffix_dedup(docs_of(spark, pairs), settings).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_suffixes(pairs)
    assert suffix_dedup.suffix_dedup(docs_of(spark, pairs).limit(0), settings).count() == 0


@pytest.mark.parametrize("unit", [32 << 20, 1])
def test_suffix_dedup_keeps_texts_whose_rolling_hashes_collide(spark, unit):
    """Two texts around one phrase with the same 48 bits of a rolling hash of all 75 bytes, and no 50 bytes in common."""
    texts = ["nsqakgnijlzsrzbuyjxkdmjnzhrptqyzthdmrgtosdjozkwkkcfjtjekdchkrqrjqolubgfdssc", "nsqakgnijlzsrzbuyjxkdzduuhrptqyzthdmrgtosdjozkwkkclidzekdchkrqrjqolubgfdssc"]
    for near in (1, 2, 6, 8):
        settings = suffix_dedup.Settings(chunk_bytes=60 if unit == 1 else 1 << 19, unit_bytes=unit, near_bytes=near)
        got = suffix_dedup.suffix_dedup(docs_of(spark, [(1, texts[0]), (2, texts[1]), (3, texts[0] + "!")]), settings).collect()
        assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 0, 3: 75}


def test_digests_tell_strings_apart():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 256, (4000, 75), dtype=np.uint8)
    one_off = rows.copy()
    one_off[np.arange(4000), rng.integers(0, 75, 4000)] ^= 1
    both = suffix_dedup.digest(np.concatenate([rows, one_off]))
    assert len(np.unique(both[0])) == len(np.unique(both[1])) == 8000
    bits = np.unpackbits((both[:, :4000] ^ both[:, 4000:]).copy().view(np.uint8)).mean()
    assert 0.49 < bits < 0.51
    assert (suffix_dedup.digest(rows) == both[:, :4000]).all()


def test_suffix_dedup_of_texts_longer_than_a_piece(spark):
    """Matches across the borders between the pieces in which a long text is hashed."""
    rng = random.Random(13)
    body = "".join(rng.choices("abcdefghij", k=suffix_dedup.PIECE + 30_000))
    at = suffix_dedup.PIECE - 64
    pairs = [(1, body), (2, "".join(rng.choices("klmno", k=5000)) + body[at - 200 : at + 300] + "z"), (3, "é" + body[at + 20 : at + 120]), (4, body[:70] + "".join(rng.choices("pqrs", k=suffix_dedup.PIECE)) + body[-80:])]
    assert sorted(str(tuple(r)) for r in suffix_dedup.suffix_dedup(docs_of(spark, pairs)).collect()) == brute_suffixes(pairs)


def test_suffix_dedup_without_any_match(spark):
    pairs = [(i, "".join(random.Random(i).choices("abcdefghijklmnop", k=300))) for i in range(5)] + [(9, "short")]
    assert sorted(str(tuple(r)) for r in suffix_dedup.suffix_dedup(docs_of(spark, pairs)).collect()) == brute_suffixes(pairs)
    exact = [(1, pairs[0][1]), (2, pairs[0][1])]
    assert sorted(str(tuple(r)) for r in suffix_dedup.suffix_dedup(docs_of(spark, exact)).collect()) == brute_suffixes(exact)


# Licences and decontamination.


def test_license_scan_finds_notices_and_nothing_else(spark):
    templates = spark.createDataFrame(license_scans.TEMPLATES + [("short", "too few words")], "license string, template string")
    long = license_scans.TEMPLATES[5][1]
    filler = " ".join(f"word{i}" for i in range(500))
    pairs = [(0, None), (1, ""), (2, filler), (3, f"{filler} licensed under the gnu general public license, VERSION 3 {filler}"), (4, f"{filler} {long} {filler}"), (4, long), (5, long.replace("publish", "print")), (6, " ".join(long.split()[:30])), (7, f"{filler} has Too few, words in {filler}"), (8, "few words too")]
    got = {(r.doc_id, r.license): round(r.containment, 3) for r in license_scans.scan_licenses(docs_of(spark, pairs), templates, block=2).collect()}
    assert got.pop((5, "MIT")) < 1
    assert got == {(3, "GPL-3.0"): 1.0, (4, "MIT"): 1.0, (7, "short"): 1.0}
    assert license_scans.scan_licenses(docs_of(spark, pairs), templates.limit(0)).count() == 0


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(10)
    vocabulary = [f"wörd{i}" for i in range(400)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(1, 60)))) for k in range(60)] + [(60, None), (61, "..."), (3, "again an item with the same id")]
    texts = [None, ""]
    for _ in range(80):
        words = rng.choices(vocabulary, k=rng.randint(0, 300))
        item = (rng.choice(items)[1] or "").split()
        for k in range(len(item)):
            if rng.random() < 0.03:
                item[k] = "other"
        texts.append(" ".join(words[:50]) + "; " + " ".join(item).upper() + "! " + " ".join(words[50:]))
    pairs = list(enumerate(texts)) + [(1, texts[5])]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    split = lambda t: re.findall("[a-z0-9\u0080-\U0010ffff]+", (t or "").lower())
    grams = lambda w, n: {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}
    want = []
    for i, t in pairs:
        for k, x in items:
            own = split(x)
            n = min(5, len(own))
            if own:
                a = grams(own, n)
                both = len(a & grams(split(t), n))
                if both >= 0.8 * len(a):
                    want.append((i, k, both, len(a)))
    for block in (7, 50_000):
        got = decontamination.find_leaks(docs_of(spark, pairs), benchmark, block_items=block).collect()
        assert sorted(tuple(r)[:4] for r in got) == sorted(want) and want
    stay = [r.doc_id for r in decontamination.drop_leaked(docs_of(spark, list(enumerate(texts))), benchmark).collect()]
    assert sorted(stay) == sorted(set(range(len(texts))) - {w[0] for w in want if w[0] != 1})


# Toxicity and the pipeline.


def test_toxicity_learns_and_scores(spark):
    rng = random.Random(11)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnr"]
    texts, toxic = [], []
    for i in range(400):
        words = rng.choices(vocabulary, k=rng.randint(30, 120))
        toxic.append(int(i % 4 == 0))
        for _ in range(3 * toxic[-1]):
            words[rng.randrange(len(words))] = rng.choice(["idiot", "moron"])
        texts.append(" ".join(words))
    docs = docs_of(spark, [*enumerate(texts), (1000, None), (1001, "")])
    labels = spark.createDataFrame([(i, t, 0) for i, t in enumerate(toxic) if i % 5] + [(7, None, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.learn_toxicity(docs, labels)
    score = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    assert all(0 <= s <= 1 for s in score.values()) and len(score) == 402 and score[1000] == score[1001] < 0.5
    held = [i for i in range(400) if i % 5 == 0]
    assert np.mean([(score[i] >= 0.5) == toxic[i] for i in held]) > 0.95
    assert {r.doc_id for r in toxicity.drop_toxic(docs, model).collect()} == {i for i, s in score.items() if s < 0.5}
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_toxicity_equals_a_plain_computation(spark):
    """Counts, ratios, the optimum of the penalised loss and the scores against numpy and sets of n-grams."""
    from tidemark.llm.byte_windows import gram_hash, prefix_sums

    rng = random.Random(14)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnr"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 40)) + ["Idiot É"] * (i % 3 == 0)) for i in range(120)]
    toxic = [int(i % 3 == 0) for i in range(120)]

    def grams(text):
        raw = b" " + text.lower().encode() + b" "
        return {int(gram_hash(prefix_sums(np.frombuffer(raw[i : i + k], np.uint8)), k)[0] >> np.uint64(64 - toxicity.BITS)) for k in toxicity.ORDERS for i in range(len(raw) - k + 1)}

    sets = [grams(t) for t in texts]
    counts = {f: [sum(f in s and t == y for s, t in zip(sets, toxic, strict=True)) for y in (0, 1)] for f in set().union(*sets)}
    rows = spark.createDataFrame(list(zip(texts, toxic, strict=True)), "text string, toxic int")
    assert {r.feature: [r.clean, r.toxic] for r in toxicity.feature_counts(rows).collect()} == counts
    n_toxic, n_clean = sum(toxic), 120 - sum(toxic)
    ratio = {f: np.log((t + 1) / (n_toxic + 2) / ((c + 1) / (n_clean + 2))) for f, (c, t) in counts.items()}
    told = {r.feature: r.scale for r in toxicity.informative(toxicity.feature_counts(rows), n_clean, n_toxic, 1000, 2.0).collect()}
    assert told == pytest.approx({f: r for f, r in ratio.items() if abs(r) >= 2 * np.sqrt(1 / (counts[f][0] + 1) + 1 / (counts[f][1] + 1))})

    docs = docs_of(spark, list(enumerate(texts)))
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    model = toxicity.learn_toxicity(docs, labels, min_z=2.0, steps=300, l2=0.01, toxic_share=0.3)
    names = sorted(told)
    x = np.array([[told[f] * (f in s) for f in names] for s in sets])
    w = np.array([model.weight[f] / told[f] for f in names])
    z = x @ w + model.bias
    weight = np.where(toxic, 0.3 / n_toxic, 0.7 / n_clean)
    slope = (weight * (1 / (1 + np.exp(-z)) - toxic)) @ np.column_stack([x, np.ones(120)]) + 0.01 * np.append(w, 0)
    assert np.abs(slope).max() < 1e-3
    score = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    assert score == pytest.approx({i: 1 / (1 + np.exp(-v)) for i, v in enumerate(z)}, abs=1e-4)
    repeated = docs.unionByName(docs).where("doc_id < 7")
    assert toxicity.training_rows(repeated, labels.unionByName(labels), 5).count() <= 5


def test_very_long_texts(spark):
    """One text of some megabytes with something to find at its end, through every operator that reads texts whole."""
    from tidemark.llm import bpe_coding, chat_formatting, media_columns
    from tidemark.llm.queries import vocabulary_path

    rng = random.Random(15)
    vocabulary = [f"w{i}" for i in range(5000)]
    item, notice = " ".join(f"item{i}" for i in range(20)), license_scans.TEMPLATES[0][1]
    text = " ".join(rng.choices(vocabulary, k=400_000)) + f" {item} {notice}"
    docs = docs_of(spark, [(1, text), (2, "short"), (3, text + " more")])
    leaks = decontamination.find_leaks(docs, spark.createDataFrame([(9, item)], "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in leaks.collect()) == [(1, 9), (3, 9)]
    templates = spark.createDataFrame(license_scans.TEMPLATES[:1], "license string, template string")
    assert sorted(r.doc_id for r in license_scans.scan_licenses(docs, templates).collect()) == [1, 3]
    assert sorted(r.doc_id for r in simhash_dedup.drop_near_duplicates(docs).collect()) == [1, 2]
    assert {r.doc_id: r.n_removed > len(text) - 1 for r in suffix_dedup.suffix_dedup(docs).collect()} == {1: False, 2: False, 3: True}
    model = toxicity.Toxicity(np.zeros(1 << toxicity.BITS), -1.0)
    assert {round(r.score, 6) for r in toxicity.score_toxicity(docs, model).collect()} == {round(1 / (1 + np.exp(1.0)), 6)}
    assert {r.doc_id: r.n_bytes for r in media_columns.media_columns(docs).collect()} == {1: len(text), 2: 5, 3: len(text) + 5}
    assert {r.doc_id: r.n_tokens > 400_000 for r in bpe_coding.bpe_digests(docs, vocabulary_path()).collect()} == {1: True, 2: False, 3: True}
    events = chat_formatting.messages_as_events(spark.createDataFrame([(1, 0, "assistant", text)], "conv_id long, turn long, role string, text string"))
    assert chat_formatting.chat_digests(chat_formatting.format_chats(events)).first().loss_chars == len(text)
    pages = spark.createDataFrame([(1, "http://a.example.net/en/" + "x" * 1_000_000)], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert url_filters.judge_urls(pages, rules).first().verdict == "allow"


def test_near_links_of_dense_points_equal_brute_force(spark):
    """Two thousand fingerprints that differ in two bytes only, where every shard is crowded."""
    rng = random.Random(16)
    prints = sorted({rng.getrandbits(8) << 8 | rng.choice([0, 1, 3, 7, 15, 31, 63, 127]) << 40 for _ in range(3000)})
    near = lambda p: {p ^ (1 << i) ^ (1 << j) for i in (*range(8, 16), *range(40, 48)) for j in (*range(8, 16), *range(40, 48))} | {p ^ (1 << i) for i in (*range(8, 16), *range(40, 48))}
    known, root = set(prints), {}
    for p in prints:
        if p not in root:
            edge, root[p] = [p], p
            while edge:
                for q in near(edge.pop()) & known:
                    if q not in root:
                        root[q] = p
                        edge.append(q)
    rows = spark.createDataFrame([(p, [p]) for p in prints], "id long, fingerprint array<long>")
    found = links.components(simhash_dedup.near_links(rows, simhash_dedup.exact_masks(2), 2)).collect()
    assert {p: p for p in prints} | {r["node"]: r["root"] for r in found} == root


def test_near_copies_beside_clashing_names_and_empty_tables(spark):
    docs = docs_of(spark, [(1, "a b c d e f g"), (2, "A  b c d e f g")]).withColumn("text_hash", F.lit("kept")).withColumn("Token", F.lit(1))
    got = simhash_dedup.drop_near_duplicates(docs).collect()
    assert [(r.doc_id, r.text_hash, r.Token) for r in got] == [(1, "kept", 1)]
    assert simhash_dedup.drop_near_duplicates(docs.limit(0)).count() == 0


def test_pipeline_stages_keep_columns_and_clean_documents(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(12)
    vocabulary = [f"{a}{b}{c}{d}" for a in "bdfgk" for b in "aeiou" for c in "lmnr" for d in "aeiou"]
    text = lambda: " ".join(rng.choices(vocabulary, k=150))
    item = " ".join(rng.choices(vocabulary, k=30))
    clean = [text() for _ in range(300)]
    toxic = [t.replace(t.split()[5], "idiot").replace(t.split()[70], "moron") for t in (text() for _ in range(150))]
    every = clean + toxic + [clean[0], clean[1] + " end", text() + " " + item, text() + " token = 0123456789abcdef0123456789abcdef"]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(every)], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(300 <= i < 450)) for i in range(450)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stay = set(range(300))
    wanted = [stay | {450, 451, 452, 453}, stay | {452, 453}, stay | {453}, stay | {453}]
    for (name, stage), ids in zip(pipeline.STAGES[:-1], wanted, strict=True):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in schema.split(", ")], name
        assert {r.doc_id for r in docs.select("doc_id").collect()} == ids, name
    assert "0123456789abcdef" not in docs.where("doc_id = 453").first().text
    assert pipeline.run(spark, str(tmp_path)).count() == 301


def test_pipeline_of_odd_rows_and_empty_tables(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long, token string"
    odd = [(1, None), (2, ""), (None, "no id at all here"), (4, "token = 0123456789abcdef"), (4, "token = 0123456789abcdef"), (5, "some words of a text")]
    for name, rows in (("odd", odd), ("none", [])):
        spark.createDataFrame([(i, t, None, None, None, "x") for i, t in rows], schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"{tmp_path}/odd")
    got = sorted(((r.doc_id, r.text, r.token) for r in docs.collect()), key=str)
    assert got == sorted([(1, None, "x"), (None, "no id at all here", "x"), (4, "[assign secret removed]", "x"), (5, "some words of a text", "x")], key=str)
    assert pipeline.run(spark, f"{tmp_path}/odd").count() == 4 and pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_filtering_stages_keep_columns_that_arrow_lacks(spark):
    frame = docs_of(spark, [(1, "plain words"), (2, None), (3, "token=hunter2hunter2")]).withColumn("kept_for", F.expr("make_interval(0, 1, 0, cast(doc_id as int))"))
    clean = secret_scans.redact_secrets(frame)
    assert clean.columns == frame.columns
    assert {r.doc_id: r.text for r in clean.select("doc_id", "text").collect()} == {1: "plain words", 2: None, 3: "[assign secret removed]"}
    model = toxicity.Toxicity(np.zeros(1 << toxicity.BITS), -1.0)
    assert toxicity.drop_toxic(frame, model).where("kept_for is not null").count() == 3
    benchmark = spark.createDataFrame([(1, "plain words")], "item_id long, text string")
    assert [r.doc_id for r in decontamination.drop_leaked(frame, benchmark).select("doc_id").orderBy("doc_id").collect()] == [2, 3]
