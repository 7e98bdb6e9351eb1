"""Packing, filter audit and fill-in-middle: libraries, plain rules, SQL and awkward tables."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tomolake.llm import audit, fim, packing, queries
from tomolake.llm.common import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, row long, bin long, shard long, n long, h string, part string, A boolean, marked string, prefix string, `left` long, state int"
TEXTS = [
    (1, "The quick brown fox jumps. " * 40 + "\n", "en"), (2, "The quick brown fox jumps. " * 40 + "\n", "en"), (3, None, None), (4, "", "en"), (5, " \t\n\x0b ", ""),
    (None, "no id", "en"), (None, None, "de"), (7, "zwei Zeilen\nohne Ende", "de"), (7, "zwei Zeilen\nohne Ende", "de"), (8, "word$ " * 30_000, "en"),
    (9, "<P> a marker", "en"), (10, "\x01\x02d\x02e\x01\n\x02\x02\n\x01", "en"), (11, "ABC DEF\n\n\nGHI" * 50, "fr"), (12, "x" * 50_000, None), (13, "Straße ΣΑΣ İ ² ½ don't ICH'LL <|endoftext|> 漢字 é é \x85\xa0\x1c ok", "de"),
    (14, "\r\n\r\none\rtwo\n", "fr"), (15, "$0 \\1 $1 a\\", "fr"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(*r, *[None] * 11) for r in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 1), (2, 1, 1), (7, 0, 1), (None, 1, 1), (4, None, None), (8, 1, 0)], "doc_id long, quality int, toxic int")


def in_duck(sql, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t.toArrow())
    out = con.execute(sql)
    names = [c[0] for c in out.description]
    order = [names.index(c) for c in sorted(names)]
    return Counter(tuple(r[k] for k in order) for r in out.fetchall())


def rows_of(df):
    return Counter(tuple(r) for r in df.select(sorted(df.columns)).collect())


# ---- packing


def check_packing(rows, capacity):
    """Every sequence is filled without gaps up to the capacity at most; the number of sequences."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(by)


def expected_pieces(texts, capacity=4096):
    library, out = Tokenizer.from_file(TOKENIZER), []
    for doc_id, text in texts:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        out += [(doc_id, p, a, len(ids[a : a + capacity]), zlib.crc32(ids[a : a + capacity].tobytes())) for p, a in enumerate(range(0, len(ids), capacity))]
    return Counter(out)


def pieces_in(rows):
    return Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)


def test_packs_all_documents(spark, sf):
    docs = table(spark, sf, "documents")
    rows = queries.op11_grouping_genetic(spark, sf).collect()
    assert pieces_in(rows) == expected_pieces([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert check_packing(rows, 4096) <= packing.lower_bound(np.array([r["length"] for r in rows]), 4096) + 1


@pytest.mark.parametrize("capacity", [4096, 7])
def test_packs_awkward_documents(awkward, empty, capacity):
    rows = packing.pack(awkward, TOKENIZER, capacity=capacity, shard_pieces=500, meet=3, opened=4).collect()
    assert pieces_in(rows) == expected_pieces([r[:2] for r in TEXTS], capacity)
    check_packing(rows, capacity)
    assert packing.pack(empty, TOKENIZER).count() == 0


def test_levels_leave_no_loose_ends(spark):
    """Many small shards over several levels need hardly more sequences than one bound for all."""
    rng = np.random.default_rng(3)
    lengths = np.clip(rng.lognormal(3, 1, 3000), 1, 200).astype(int)
    rows = spark.createDataFrame([(k, 0, int(x)) for k, x in enumerate(lengths)], "row long, piece int, length long")
    found = packing.place_pieces(rows, capacity=256, shard_pieces=40, meet=5, opened=8).collect()
    assert Counter((r["row"], r["length"]) for r in found) == Counter(enumerate(lengths.tolist()))
    assert check_packing(found, 256) <= packing.lower_bound(lengths, 256) * 1.01


def triplets(n, capacity, seed):
    rng = np.random.default_rng(seed)
    a = rng.integers(int(0.38 * capacity), int(0.47 * capacity), n)
    b = [rng.integers(capacity // 4 + 1, capacity - x - capacity // 4) for x in a]
    return [int(x) for t in zip(a, b, strict=True) for x in (t[0], t[1], capacity - t[0] - t[1])]


def test_islands_beat_best_fit(spark):
    """Three pieces fill each sequence exactly; best fit in falling order needs a sixth more, breeding far less."""
    sizes = triplets(40, 4096, 1)
    rows = spark.createDataFrame([(k, 0, x) for k, x in enumerate(sizes)], "row long, piece int, length long")
    found = packing.place_pieces(rows).collect()
    best = packing.first_packing(-np.sort(-np.array(sizes)), 4096).max() + 1
    assert Counter(r["length"] for r in found) == Counter(sizes)
    bred = check_packing(found, 4096)
    assert 40 <= bred <= 42 < best
    alone = check_packing(packing.place_pieces(rows, islands=1, epochs=1, children=20).collect(), 4096)
    assert bred <= alone <= best


@pytest.mark.parametrize("seed", range(8))
def test_children_are_packings(seed):
    rng = np.random.default_rng(seed)
    sizes = -np.sort(-rng.integers(1, 65, 60))
    a, order = packing.first_packing(sizes, 64), rng.permutation(60)
    b = np.empty(60, np.int64)
    b[order] = packing.best_fit(sizes[order].tolist(), 64, [])
    for child in (packing.crossed(a, b, sizes, 64, rng), packing.mutated(a, sizes, 64, rng)):
        fill = np.bincount(child, sizes)
        assert len(child) == 60 and fill.sum() == sizes.sum() and fill.max() <= 64 and fill.min() > 0
    # Whole well-filled bins of the other parent are in the child.
    child = packing.crossed(a, b, sizes, 64, np.random.default_rng(seed))
    bins = {frozenset(np.flatnonzero(child == k)) for k in set(child)}
    assert bins & {frozenset(np.flatnonzero(b == k)) for k in set(b)}


def test_lower_bound_by_search():
    def least(sizes, capacity):
        for n in range(1, len(sizes) + 1):
            for places in itertools.product(range(n), repeat=len(sizes)):
                fill = [0] * n
                for s, p in zip(sizes, places, strict=True):
                    fill[p] += s
                if max(fill) <= capacity:
                    return n
        return 0

    rng = np.random.default_rng(0)
    exact = 0
    for _ in range(60):
        sizes = rng.integers(1, 11, rng.integers(1, 6))
        n, bound = least(sizes.tolist(), 10), packing.lower_bound(sizes, 10)
        assert bound <= n
        exact += bound == n
    assert exact > 50


def test_best_fit_by_search():
    rng = np.random.default_rng(4)
    for _ in range(50):
        sizes, free = rng.integers(1, 33, 40).tolist(), []
        for s, b in zip(sizes, packing.best_fit(sizes, 32, []), strict=True):
            fits = [f for f in free if f >= s]
            if b == len(free):
                assert not fits
                free.append(32)
            else:
                assert free[b] == min(fits)
            free[b] -= s


def test_word_encoder_as_the_library():
    encoder, library = packing.encoder_of(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    assert encoder.words is not None
    alphabet = [*"aAzZéÉßſıİ' \t\n\x0b\x0c\r\x1c\x1f\x85\xa0_²½9٣—…€‐Σς漢x̣<|>", "'ll", "'S", "<|endoftext|>", "</w>", "the", "ing"]
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(alphabet, n)) for n in rng.integers(0, 40, 2000)] + [t or "" for _, t, _ in TEXTS] + ["".join(map(chr, range(0x180))), "a" * 3000]
    for t in texts:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t[:80])


def test_word_encoder_merges_chunks_of_many_texts_at_once(monkeypatch):
    """Texts encoded together, plain ones or not, have the library's ids; their distinct chunks are merged once, in one call."""
    encoder, library = packing.WordEncoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    taken, merge = [], encoder.words.encode_to_numpy
    monkeypatch.setattr(encoder.words, "encode_to_numpy", lambda text, **k: taken.append(text) or merge(text, **k))
    texts = ["", " ", "one-two  don't\xa0one-two", "漢字 one-two", "\x1cOne-Two\x85", "<|endoftext|> one-two", "don't\n" * 500, "²½9 ÉCOLE " + "x" * 3000, ""]
    found = [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode_all(texts)]
    assert found == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(taken) == 1 and taken[0].count("twoZ") == 2 and taken[0].count("donZ") == 1
    assert encoder.encode_all([]) == [] and encoder.encode_all(["", ""]) == [b"", b""]


def test_pieces_of_texts_longer_than_a_slice(spark):
    """Batches are encoded in slices of about TOGETHER bytes; texts at and over the cut are whole."""
    half = "ab " * (packing.TOGETHER // 6)
    texts = [(1, "first"), (2, half), (3, None), (4, half), (5, half * 3), (6, ""), (7, "last")]
    rows = packing.pieces_of(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), TOKENIZER).collect()
    assert pieces_in(rows) == expected_pieces(texts)


# ---- filter audit


def audit_by_rows(docs, labels):
    """Applies the filters of each order one by one to lists of rows."""
    good, toxic = ({i for i, *m in labels if m[k] == 1 and i is not None} for k in (0, 1))
    rows, first = [], {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    for doc_id, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": doc_id is not None and doc_id > first[text],
        }
        rows.append((lang or "", fails, doc_id in good, doc_id in toxic))
    out, removed = {}, Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                failing = [r for r in own if r[1][f]]
                left = [r for r in left if not r[1][f]]
                removed[part, f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), len(failing) - len(gone), sum(sum(r[1].values()) == 1 for r in failing), sum(r[2] for r in gone), sum(r[3] for r in gone),
                ]
    return {k: (*v, removed[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_by_rows(awkward, empty, labels):
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COUNTS) for r in audit.audit(awkward, labels).collect()}
    assert found == audit_by_rows(TEXTS, [tuple(r) for r in labels.collect()])
    assert audit.audit(empty, labels).count() == 0
    unlabelled = audit.audit(awkward, labels.limit(0))
    assert unlabelled.count() == len(found) and unlabelled.where("good_lost + toxic_lost > 0").count() == 0


def test_audit_as_sql(spark, sf, awkward, labels):
    for docs, marks in ((table(spark, sf, "documents"), table(spark, sf, "labels")), (awkward, labels)):
        found = audit.audit(docs, marks)
        assert rows_of(found) == in_duck(queries.OP12_SQL, documents=docs.select("doc_id", "text", "lang"), labels=marks)


@pytest.mark.parametrize("largest", [1, 10_000])
def test_repeats_of_large_and_small_groups(spark, largest):
    ids = [None, 5, 5, 3, 8, 1, 2, 2, None, 9]
    rows = spark.createDataFrame([(i, bytearray(h)) for i, h in zip(ids, [b"a", b"a", b"a", b"a", b"a", b"b", b"b", b"b", b"c", b"d"], strict=True)], "doc_id long, h binary")
    found = Counter((r["doc_id"], r["E"]) for r in audit.with_repeats(rows, "E", largest).collect())
    assert found == Counter([(None, False), (5, True), (5, True), (3, False), (8, True), (1, False), (2, True), (2, True), (None, False), (9, False)])


def test_audit_of_other_filters(spark):
    """Two filters, no losses: four edges, two orders."""
    rows = spark.createDataFrame([("p", True, False), ("p", True, True), ("p", False, False), ("q", False, True)], "part string, X boolean, Y boolean")
    found = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["shapley"]) for r in audit.by_order(audit.edges(rows, ["X", "Y"], []), ["X", "Y"], []).collect()}
    assert found == {
        ("p", "XY", 1): (1, 2, 0, 1, 3), ("p", "XY", 2): (1, 0, 1, 0, 1), ("p", "YX", 1): (2, 1, 0, 0, 1), ("p", "YX", 2): (1, 1, 1, 1, 3),
        ("q", "XY", 1): (1, 0, 0, 0, 0), ("q", "XY", 2): (0, 1, 0, 1, 2), ("q", "YX", 1): (0, 1, 0, 1, 2), ("q", "YX", 2): (0, 0, 0, 0, 0),
    }


# ---- fill-in-middle


def filled(doc_id, text, seed=7, rate=100, spm=50):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in range(0, 32, 8))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, None)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(units), "plain", None, None, None, text
    if h4 % 100 < spm:
        return len(units), "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("form", [fim.Form(), fim.Form(seed=1, rate=60, spm=20)])
def test_fill_in_middle_by_rule(spark, sf, awkward, form):
    docs = table(spark, sf, "documents").select("doc_id", "text").unionByName(awkward.select("doc_id", "text"))
    # The same texts under many ids meet many cuts.
    docs = docs.unionByName(awkward.selectExpr("explode(sequence(1000, 1040)) AS doc_id", "text"))
    found = Counter(tuple(r) for r in fim.transform(docs, form).collect())
    assert found == Counter((i, t or "", *filled(i, t or "", form.seed, form.rate, form.spm)) for i, t in docs.collect())


def test_outputs_restore_their_texts(spark, sf, awkward, empty):
    docs = table(spark, sf, "documents").select("doc_id", "text").unionByName(awkward.select("doc_id", "text"))
    rows = fim.transform(docs)
    back = rows.select("text", fim.restored(rows["output"], rows["kind"]).alias("back")).collect()
    assert all(r["text"] == r["back"] for r in back) and fim.digests(empty).count() == 0
    plan = fim.digests(table(spark, sf, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Project" in plan and not any(x in plan for x in ("Python", "Arrow", "Exchange"))


def test_fill_in_middle_as_sql(spark, sf, awkward):
    for docs in (table(spark, sf, "documents"), awkward):
        assert rows_of(fim.digests(docs)) == in_duck(queries.OP13_SQL, documents=docs.select("doc_id", "text"))


def test_other_units_and_markers(spark):
    docs = spark.createDataFrame([(k, "One. Two! Three? tail <s") for k in range(30)], "doc_id long, text string")
    form = fim.Form("<p>", "<s>", "<m>")
    rows = fim.transform(docs, form, units=r"[^.!?]*[.!?]|[^.!?]+")
    assert {r["n"] for r in rows.collect()} == {4}
    assert {r[0] for r in rows.select(fim.restored(rows["output"], rows["kind"], form)).collect()} == {"One. Two! Three? tail <s"}
    for wrong in (("<P>", "<P>", "<M>"), ("<P>", "<P>x", "<M>"), ("<P<", "<S>", "<M>"), ("<P>", "[S]", "<M>")):
        with pytest.raises(ValueError):
            fim.Form(*wrong)
