"""Personal data: pattern spans, and terms that disclose them as corpus co-occurrence shows."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomolake.llm.common import cut, map_batches
from tomolake.llm.simhash import shingle_hashes

KINDS = ("email", "ip", "card", "phone", "term")
#: Part of an entity's information that a term must reveal: 1 - log(df(t) / co) / log(N / df(e)).
DISCLOSURE = 0.9
#: Rows in which both must occur; rows that are near copies of each other count once.
SUPPORT = 3
#: Part of the entity's rows that must hold the term.
COVERAGE = 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Starting inside a run of digits never matches what starting at its head did not; so both ends are possessive.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT, _DIGITS = re.compile("[0-9]"), re.compile("[^0-9]")
_TERM = re.compile(r"[^\W\d_]{2,}")
#: Letters from which on any word is a term; a shorter one is if it begins with a capital or a letter without case.
LONG = 4
#: Characters on either side of a base span that do not tell rows apart, words in a shingle of the rest, and least
#: hashes of shingles that a row is known by: near copies agree in one of these pairs, other rows hardly ever.
NEAR, SHINGLE, PAIRS = 40, 3, 6
_MIX = np.random.RandomState(17).randint(1, 1 << 62, 2 * PAIRS).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ outward so that long runs of other characters cost nothing."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            last = host.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, in order; offsets are code points."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = _DIGITS.sub("", m[0])
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGITS.sub("", m[0])) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _hash(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def entities_of(text: str, spans: list[tuple[int, int, int]]) -> list[int]:
    """Hashes of the different protected values."""
    return sorted({_hash(f"{KINDS[k]}:{text[a:b].lower() if k < 2 else _DIGITS.sub('', text[a:b])}") for a, k, b in spans})


def sketch_of(text: str, spans: list[tuple[int, int, int]]) -> list[int]:
    """What the row is known by: least hashes of shingles away from its spans, in pairs; of the text, if none is."""
    rest, at = [], 0
    for a, _, b in spans:
        rest.append(text[at : max(at, a - NEAR)])
        at = max(at, b + NEAR)
    hashes = shingle_hashes("\n".join([*rest, text[at:]]).encode("utf-8", "surrogatepass"), SHINGLE) or [_hash(text)]
    x = np.array(hashes, np.uint64 if hashes[0] >= 0 else np.int64).astype(np.uint64)
    least = [int((y ^ (y >> np.uint64(29))).min()) for y in (x * m for m in _MIX)]
    return [_hash(f"{p}:{least[2 * p]}:{least[2 * p + 1]}") for p in range(PAIRS)]


def is_term(word: str) -> bool:
    return len(word) >= LONG or not word[0].islower()


def _outside(text: str, spans: list[tuple[int, int, int]]) -> Iterator[re.Match]:
    """Terms that touch no base span."""
    at, n = 0, len(spans)
    reach = 0
    for m in _TERM.finditer(text):
        if not is_term(m[0]):
            continue
        while at < n and spans[at][0] < m.end():
            reach = max(reach, spans[at][2])
            at += 1
        if reach <= m.start():
            yield m


def term_spans(text: str, spans: list[tuple[int, int, int]], terms: set[str]) -> list[tuple[int, int, int]]:
    """spans, and where the text has one of the terms outside of them."""
    return sorted(spans + [(m.start(), 4, m.end()) for m in _outside(text, spans) if m[0].lower() in terms])


def scan(docs: DataFrame) -> DataFrame:
    """row (a hash of doc_id and text), doc_id, counts, base spans and entities; text and sketch where there are any."""
    source = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    source = source.withColumn("row", F.xxhash64("doc_id", "text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        spans = [base_spans(t) for t in texts]
        counts = [pa.array([sum(s[1] == k for s in own) for own in spans], pa.int64()) for k in range(4)]
        held = [entities_of(t, own) for t, own in zip(texts, spans, strict=True)]
        cols = [
            batch.column(2), batch.column(0), *counts,
            pa.array([spelled(own) for own in spans]),
            pa.array(held, pa.list_(pa.int64())),
            pa.array([sketch_of(t, own) if own else None for t, own in zip(texts, spans, strict=True)], pa.list_(pa.int64())),
            pa.array([t if own else None for t, own in zip(texts, spans, strict=True)], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(cols, ["row", "doc_id", *(f"n_{k}" for k in KINDS[:4]), "base", "entities", "sketch", "text"])

    kind = source.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS[:4])
    return map_batches(source, run, f"row long, doc_id {kind}, {counts}, base string, entities array<long>, sketch array<long>, text string")


def term_rows(docs: DataFrame) -> DataFrame:
    """term, n: in how many texts of a batch a term occurs; the sums over all batches are document frequencies."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: dict[str, int] = {}
        for text in batch.column(0).to_pylist():
            for t in {w.lower() for w in set(_TERM.findall(text or ""))}:  # in any case
                counts[t] = counts.get(t, 0) + 1
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    return map_batches(docs.select(F.col("text").cast("string").alias("text")), run, "term string, n long", 4096)


def _told_apart(at: DataFrame, rounds: int = 2) -> DataFrame:
    """row, e, place, n of at(row, e, n, sketch): rows of an entity that agree in a part of their sketches share a place.

    Each round gives a row the least place among the rows that it agrees with; a second reaches those that agree with
    others of a group of copies only.
    """
    parts = cut(at.select("row", "e", F.posexplode("sketch").alias("k", "s")))
    places = at.select("row", "e", F.col("row").alias("place"))
    for _ in range(rounds):
        known = parts.join(places, ["row", "e"])
        least = known.groupBy("e", "k", "s").agg(F.min("place").alias("least"))
        places = known.join(least, ["e", "k", "s"]).groupBy("row", "e").agg(F.min("least").alias("place"))
    return at.select("row", "e", "n").join(places, ["row", "e"])


def disclosing_terms(docs: DataFrame, scanned: DataFrame, threshold: float = DISCLOSURE, support: int = SUPPORT, coverage: float = COVERAGE) -> DataFrame:
    """row, terms: the terms of each row that disclose an entity of the same row.

    Over all rows, N of them, repeats included: df(e) and df(t) count rows with an entity and a term, co those with
    both. A term reveals the part PMI(e, t) / IC(e) = 1 - log(df(t) / co) / log(N / df(e)) of the entity's
    information. It discloses e if that is at least threshold, if both meet in support rows that are not near copies
    of each other, and in the part coverage of e's rows. Only entities with so many rows go further than the first
    count.
    """
    held = scanned.where("size(entities) > 0")
    times = held.groupBy("row").agg(F.count("*").alias("n"), F.first("entities").alias("entities"), F.first("sketch").alias("sketch"))
    at = times.select("row", "n", "sketch", F.explode("entities").alias("e"))
    often = at.groupBy("e").agg(F.count("*").alias("rows")).where(F.col("rows") >= support)
    at = cut(_told_apart(cut(at.join(often.select("e"), "e", "left_semi"))))
    known = at.groupBy("e").agg(F.count_distinct("place").alias("places"), F.sum("n").alias("df_e"))
    known = cut(known.where(F.col("places") >= support).select("e", "df_e"))
    at = at.join(known.select("e"), "e", "left_semi")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [sorted({m[0].lower() for m in _outside(t, base_spans(t))}) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.string()))], ["row", "terms"])

    texts = held.select("row", "text").join(at.select("row").distinct(), "row", "left_semi").dropDuplicates(["row"])
    pairs = at.join(map_batches(texts, run, "row long, terms array<string>"), "row").select("row", "e", "place", "n", F.explode("terms").alias("term"))
    met = pairs.groupBy("e", "term", "place").agg(F.sum("n").alias("n")).groupBy("e", "term")
    met = cut(met.agg(F.sum("n").alias("co"), F.count("*").alias("places")).where(F.col("places") >= support).join(known, "e").where(F.col("co") >= coverage * F.col("df_e")))
    frequency = term_rows(docs).join(met.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df_t"))
    total = docs.agg(F.count("*").alias("total"))
    ratio = 1 - F.ln(F.greatest(F.col("df_t"), F.col("co")) / F.col("co")) / F.ln(F.col("total") / F.col("df_e"))
    found = met.join(frequency, "term").crossJoin(total).where((F.col("total") > F.col("df_e")) & (ratio >= threshold)).select("e", "term")
    return pairs.select("row", "e", "term").join(found, ["e", "term"], "left_semi").groupBy("row").agg(F.collect_set("term").alias("terms"))


def find(docs: DataFrame, threshold: float = DISCLOSURE, support: int = SUPPORT, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row of docs(doc_id, text).

    Null texts count as empty and have no spans; equal rows get equal results, and each counts in all frequencies;
    other columns are ignored; an empty table gives no rows.
    """
    scanned = cut(scan(docs))
    terms = disclosing_terms(docs, scanned, threshold, support, coverage).withColumnRenamed("row", "row_")
    joined = scanned.drop("entities", "sketch").join(terms, F.col("row") == F.col("row_"), "left").drop("row_", "row")
    names = [f"n_{k}" for k in KINDS[:4]]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, text, terms = (batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("base", "text", "terms"))
        spans = [spelled(term_spans(t, base_spans(t), set(own))) if own else b for b, t, own in zip(base, text, terms, strict=True)]
        digest = [hashlib.sha256(b.encode()).hexdigest() for b in base]
        keep = [batch.column(batch.schema.get_field_index(k)) for k in ("doc_id", *names)]
        return pa.RecordBatch.from_arrays([*keep, pa.array(digest), pa.array(spans)], ["doc_id", *names, "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(joined, run, f"doc_id {kind}, {', '.join(f'{n} long' for n in names)}, base_sha256 string, spans string", 8192)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each span as its kind in brackets; spans that overlap become one, of the first's kind."""
    out, last = [], 0
    for a, k, b in spans:
        if a >= last:
            out += [text[last:a], f"[{KINDS[k].upper()}]"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def sanitise(docs: DataFrame, threshold: float = DISCLOSURE, support: int = SUPPORT, coverage: float = COVERAGE) -> DataFrame:
    """docs with personal data in text replaced by its kind, in the same columns; null texts stay null.

    A column n_chars, if there is one, is made to follow.
    """
    scanned = cut(scan(docs))
    terms = disclosing_terms(docs, scanned, threshold, support, coverage).toDF("_pii_row", "_pii_terms")
    row = F.xxhash64("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")))
    joined = docs.withColumn("_pii_key", row).join(terms, F.col("_pii_key") == F.col("_pii_row"), "left").drop("_pii_key", "_pii_row")
    names, at = docs.columns, docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, terms = batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()
        clean = [None if t is None else redacted(t, term_spans(t, base_spans(t), set(own or ()))) for t, own in zip(texts, terms, strict=True)]
        cols = [pa.array(clean, pa.string()) if k == at else batch.column(k) for k in range(len(names))]
        return pa.RecordBatch.from_arrays(cols, names)

    out = map_batches(joined, run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
