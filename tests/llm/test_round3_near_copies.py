"""Near copies in crowds: no partner of a code is left out."""

import random

import numpy as np
import pyarrow as pa

from tomolake.llm import simhash


def test_codes_meet_every_member_of_a_crowd():
    """Not only the nearest by fingerprint, which may be less alike than another."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 8).astype(np.uint64)
    codes = np.tile(base, (simhash.CROWD + 89, 1))
    codes[:, 0] ^= np.arange(len(codes)).astype(np.uint64)
    labels = np.where(np.arange(len(codes)) < len(codes) - 1, 0, len(codes) - 1)
    met = {(int(a), int(b)) for x in simhash._nearest(np.zeros(len(codes), np.int64), codes, labels, 93) for a, b in zip(x[0], x[1], strict=True)}
    assert met == {(len(codes) - 1, b) for b in range(len(codes) - 1)}


def test_sets_are_compared_in_the_task():
    """Of codes with more partners than pairs are made of, all partners are compared."""
    sets = [list(range(10)), list(range(3, 13)), [*range(9), 50], list(range(100, 110)), [*range(100, 109), 7], []]
    code = np.zeros(8, np.uint64).tobytes()
    rows = pa.table({"shard": [1] * 6 + [2], "node": [10, 11, 12, 13, 14, 15, 16], "code": [code] * 7, "label": [10, 11, 12, 13, 14, 15, 16], "over": [True, True, False, False, True, True, True], "set": pa.array([*sets, [1]], pa.list_(pa.int64()))})
    marked = {tuple(r.values()) for x in simhash._open_nodes(93)(iter(rows.drop_columns(["set"]).to_batches(2))) for r in x.to_pylist()}
    assert marked == {(1, n, n in (10, 11, 14, 15)) for n in range(10, 16)}
    links = {tuple(r.values()) for x in simhash._compared(93, 0.8)(iter(rows.to_batches(4))) for r in x.to_pylist()}
    assert links == {(10, 12), (14, 13)}


def test_crowd_as_by_brute_force(spark):
    """Components of a crowd of copies about as alike as the similarity, with one neighbour a code, are those of all pairs
    that share a band."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(900)]
    base = [rng.choice(words) for _ in range(150)]
    texts = []
    for k in range(300):
        copy = list(base)
        for _ in range(1 + k % 14):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(" ".join(copy))
    codes = simhash.long_fingerprints([t.encode() for t in texts])
    sets = [set(simhash.shingle_hashes(t.encode(), 5)) for t in texts]
    bands, sure, wide = codes.view(np.uint16), simhash.radius_of(0.8, -simhash.SURE), simhash.radius_of(0.8, simhash.WIDER)
    ends = ([], [])
    for a in range(len(texts)):
        d = simhash.distances(codes, codes[a : a + 1])
        for b in np.flatnonzero((bands == bands[a]).any(1) & (d <= wide)).tolist():
            if d[b] <= sure or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                ends[0].append(a)
                ends[1].append(b)
    wanted = simhash.local_labels(len(texts), np.array(ends[0]), np.array(ends[1]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["label"] for r in simhash.similar_classes(docs, neighbours=1).collect()}
    assert 1 < len(set(wanted.tolist())) < 250
    assert len({(w, found[k]) for k, w in enumerate(wanted.tolist())}) == len(set(wanted.tolist())) == len(set(found.values()))


def _shuffled(spark) -> int:
    """Bytes that all stages so far have written for shuffles."""
    context = spark.sparkContext
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_codes_are_shuffled_once_and_texts_that_stay_are_not(spark, tmp_path):
    """All bands of the codes take one shuffle, and of the texts only those that may go are sent."""
    rng = random.Random(7)
    texts = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(150)) for _ in range(1500)]
    docs = [(k, t) for k, t in enumerate(texts)] + [(2000 + k, texts[k] + " more") for k in range(0, 1500, 30)]
    spark.createDataFrame([*docs, docs[3], docs[3]], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    bands = simhash.LONG_WORDS * 64 // simhash.BAND_BITS
    of_codes, of_texts = len(docs) * bands * (8 * simhash.LONG_WORDS + 8), sum(len(t) for _, t in docs)
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on large tables
    try:
        before = _shuffled(spark)
        kept = simhash.drop_similar(spark.read.parquet(f"{tmp_path}/docs")).collect()
        took = _shuffled(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert sorted((r["doc_id"], r["text"]) for r in kept) == docs[:1500]
    assert took < 1.4 * of_codes + 0.4 * of_texts, (took / of_codes, took / of_texts)


def test_partners_of_a_code_cut_short_come_with_its_shard():
    """So that they are compared in the shard's task without all codes being dealt again; a pair comes once."""
    rng = np.random.default_rng(4)
    codes = np.tile(rng.integers(0, 1 << 63, 8).astype(np.uint64), (12, 1))
    for k in range(12):  # any two differ in 40 bits at least, within the wide radius and not the sure one
        codes[k, 1 + k // 2] ^= np.uint64(((1 << 40) - 1) << (20 * (k % 2)))
    codes[11, 7] ^= np.uint64((1 << 20) - 1)  # now too far from most
    near = {(a, b) for a in range(12) for b in range(12) if a != b and simhash.distances(codes[a : a + 1], codes[b : b + 1])[0] <= 93}
    partners = np.bincount([a for a, _ in near], minlength=12)
    assert partners.min() < partners.max()
    rows = pa.table({"shard": [5] * 12, "node": range(100, 112), "code": pa.array([c.tobytes() for c in codes], pa.binary()), "known": [0] * 12})
    whole = [r for x in simhash._shard_pairs(20, 93, 11)(iter(rows.to_batches())) for r in x.to_pylist()]
    assert sorted((r["u"] - 100, r["v"] - 100) for r in whole) == sorted((a, b) for a, b in near if a < b) and all(r["cut"] is None for r in whole)
    found = [r for x in simhash._shard_pairs(20, 93, int(partners.max()) - 1)(iter(rows.to_batches())) for r in x.to_pylist()]
    over = set(np.flatnonzero(partners == partners.max()).tolist())
    assert {r["u"] - 100 for r in found if r["cut"] == 5 and r["v"] == r["u"]} == over
    assert {r["u"] - 100 for r in found if r["cut"] == 5} == over | {b for a, b in near if a in over}
