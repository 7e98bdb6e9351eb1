"""Toxicity by compression distance: zstandard dictionaries trained on toxic and on ordinary text.

Overlapping windows of running text are compressed with either dictionary; what counts is by how many bytes toxic
text explains a window better. Both dictionaries hold, in the same places, what zstandard's trainer takes from windows
of ordinary text, less the byte sequences that are typical of toxic texts, so that plain prose compresses alike; the
toxic one ends in segments of toxic texts, chosen by cover of those sequences. What is typical is found within groups of
texts that compress well with each other's dictionaries, so that a small language's markers are not lost among the
texts of a large one. Word starts are told from the same letters inside words. Differences of length are calibrated on
labelled documents kept out, a part at a time, of those that the dictionaries came from.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomolake.llm.common import cut, fold, hash_bounds, id_hash, map_batches, raw_texts

#: Learn from labelled documents whose id hash modulo FOLDS is not HELD.
FOLDS, HELD = 5, 0
#: Labelled documents of each label that are learnt from at most, those of the smallest hashes.
SAMPLE = 3000
#: Bytes of a window, and from one window's start to the next.
WINDOW, STRIDE = 128, 64
#: Bytes at the start of a word that are told from others.
STEM = 6
#: Bytes of the ordinary dictionary, bytes of toxic segments in the other at most, and of a segment.
ORDINARY, TOXIC, SEGMENT = 400_000, 16_000, 24
#: Bytes of the sequences that segments are chosen for; toxic texts of a group that hold one at least; its log odds, and
#: those times the texts, at least; bytes that a piece of ordinary text between two of them is kept with.
GRAMS, RARE, TYPICAL, MARKED, LEAST_PIECE = (6,), 4, 1.5, 15.0, 12
#: Groups of texts at most, texts they are found from, texts there must be, bytes of a group's dictionary, and how many
#: times as much groups that are one may take with each other's.
GROUPS, SEEN, GROUPED, GROUP_BYTES, ALIKE = 12, 600, 60, 65_536, 1.12
LEVEL = 7
#: Parts of the learnt texts that are held back in turn for calibration.
PARTS = 3
#: Windows that the trainer sees at most, evenly spaced.
TRAINED = 400_000
#: Differences that are told apart, and the part of ordinary windows that stay under the mark.
LEAST, MOST, UNMARKED = -4, 12, 0.99

FEATURES = 8


def marked(text: bytes) -> bytes:
    """The text, A-Z lower-cased but for the first STEM bytes of each word, where a-z are upper-cased: what words begin
    with is told from the same letters elsewhere in words."""
    a = np.frombuffer(text.lower(), np.uint8).copy()
    word = ~((a == 32) | ((a >= 9) & (a <= 13)))
    begins = word & ~np.concatenate(([False], word[:-1])) if len(a) else word
    head = begins.copy()
    for _ in range(STEM - 1):
        begins = np.concatenate(([False], begins[:-1])) & word
        head |= begins
    a[head & (a >= 97) & (a <= 122)] -= 32
    return a.tobytes()


def windows_of(text: bytes) -> Iterator[bytes]:
    """Windows of a marked text that overlap by half; a short rest stands in the last."""
    for a in range(0, max(1, len(text) - STRIDE) if text else 0, STRIDE):
        yield text[a : a + WINDOW]


def _packer(content: bytes, level: int = 0) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=level or LEVEL)
    return zstandard.ZstdCompressor(level=level or LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)


def _log_odds(a: np.ndarray, na: int, b: np.ndarray, nb: int) -> np.ndarray:
    return np.log((a + 0.5) / (na + 1)) - np.log((b + 0.5) / (nb + 1))


@dataclass
class Detector:
    """Two dictionaries, the log odds of each difference of lengths, the mark, and a logistic model of a text's windows."""

    dictionaries: tuple[bytes, bytes]
    odds: np.ndarray = field(default_factory=lambda: np.zeros(MOST - LEAST + 1))
    mark: int = MOST
    mean: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(FEATURES))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES + 1))

    def __post_init__(self):
        self._packers: list = []

    def __getstate__(self):
        return self.__dict__ | {"_packers": []}

    def differences(self, text: bytes) -> np.ndarray:
        """Bytes that each window takes more with the ordinary dictionary than with the toxic one."""
        if not self._packers:
            self._packers = [_packer(d) for d in self.dictionaries]
        ordinary, toxic = (p.compress for p in self._packers)
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows_of(marked(text))], np.int64)

    def features(self, differences: np.ndarray) -> np.ndarray:
        """Of a text's windows: the largest difference and the mean of three, those over the mark, the largest odds
        and the sums of three and of eight, what speaks for toxic text by length, and the mean difference."""
        if not len(differences):
            return np.zeros(FEATURES)
        x = np.clip(differences, LEAST, MOST)
        top, odds = np.sort(x)[::-1], self.odds[x - LEAST]
        best = np.sort(np.maximum(odds, 0))[::-1]
        over = np.maximum(odds - 0.5, 0).sum() / len(x) ** 0.5
        return np.array([top[0], top[:3].mean(), x[x > self.mark].sum() / len(x), best[0], best[:3].sum(), best[:8].sum(), over, x.mean()])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        x = np.array([self.features(self.differences(t)) for t in texts]).reshape(len(texts), FEATURES)
        z = np.column_stack((np.ones(len(x)), (x - self.mean) / self.scale)) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _grams(text: bytes, size: int) -> np.ndarray:
    """A number for the size bytes from each place on."""
    a = np.frombuffer(text, np.uint8).astype(np.uint64)
    out = np.zeros(max(0, len(a) - size + 1), np.uint64)
    for k in range(size if len(out) else 0):
        out = (out << np.uint64(8)) | a[k : k + len(out)]
    return out


def _document_counts(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    held = [np.unique(_grams(t, size)) for t in texts]
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)


def _spread(texts: list[bytes], size: int) -> bytes:
    """About size bytes of windows, evenly spaced over the texts."""
    held = [w for t in texts for w in windows_of(t)]
    return b"".join(held[:: max(1, len(held) * WINDOW // size)])[:size]


def _costs(texts: list[bytes], contents: list[bytes]) -> np.ndarray:
    """Compressed bytes a byte of each text (a row) with each dictionary."""
    packers = [_packer(c, 1) for c in contents]
    return np.array([[len(p.compress(t)) / (len(t) + 1) for p in packers] for t in texts]).reshape(len(texts), len(packers))


def groups(texts: list[bytes]) -> np.ndarray:
    """A group number for each text: those that compress well with each other's dictionaries, such as a language's, share one.

    GROUPS dictionaries start from one text each and are made anew from the texts that take least with them; two whose
    texts take at most ALIKE times as much with the other are one group. Fewer than GROUPED texts are one group.
    """
    if len(texts) < GROUPED:
        return np.zeros(len(texts), np.int64)
    few = [texts[i] for i in np.unique(np.linspace(0, len(texts) - 1, SEEN).astype(int))]
    contents = [few[i] for i in np.linspace(0, len(few) - 1, GROUPS).astype(int)]
    for _ in range(4):
        own = _costs(few, contents).argmin(1)
        contents = [_spread([t for t, o in zip(few, own, strict=True) if o == g], GROUP_BYTES) for g in np.unique(own)]
    costs = _costs(few, contents)
    own = costs.argmin(1)
    mean = np.array([costs[own == g].mean(0) if (own == g).any() else np.full(len(contents), np.inf) for g in range(len(contents))])
    least = mean.diagonal()
    merged = np.arange(len(contents))
    for a, b in zip(*np.nonzero((mean <= ALIKE * least[:, None]) & np.isfinite(mean)), strict=True):
        merged[merged == merged[b]] = merged[a]
    return merged[_costs(texts, contents).argmin(1)]


def _typical(ordinary: list[bytes], toxic: list[bytes], size: int, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences of size bytes that are typical of the toxic texts of some group, and their weights. group numbers the
    ordinary texts' groups, then the toxic ones'."""
    found, weights = [np.zeros(0, np.uint64)], [np.zeros(0)]
    for g in np.unique(group):
        plain = [t for t, o in zip(ordinary, group[: len(ordinary)], strict=True) if o == g]
        rude = [t for t, o in zip(toxic, group[len(ordinary) :], strict=True) if o == g]
        keys, n = _document_counts(rude, size)
        others, m = _document_counts(plain, size)
        at = np.minimum(np.searchsorted(others, keys), max(len(others) - 1, 0))
        in_plain = np.where(others[at] == keys, m[at], 0) if len(others) else np.zeros(len(keys))
        odds = _log_odds(n, len(rude), in_plain, len(plain))
        typical = (n >= RARE) & (odds > TYPICAL) & (odds * n > MARKED)
        found.append(keys[typical])
        weights.append((odds * np.sqrt(n))[typical])
    keys, at = np.unique(np.concatenate(found), return_inverse=True)
    best = np.zeros(len(keys))
    np.maximum.at(best, at, np.concatenate(weights))
    return keys, best


def _without(text: bytes, keys: np.ndarray, size: int) -> list[bytes]:
    """What a text holds outside the sequences keys."""
    grams = _grams(text, size)
    if not len(keys) or not len(grams):
        return [text]
    hit = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, grams), len(keys) - 1)] == grams)
    if not len(hit):
        return [text]
    inside = np.zeros(len(text), bool)
    for k in range(size):
        inside[hit + k] = True
    cuts = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=1, append=1))
    return [text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True) if b - a >= LEAST_PIECE]


def segments(toxic: list[bytes], found: list[tuple[np.ndarray, np.ndarray]]) -> bytes:
    """Segments of the toxic texts, the best nearest to the end: each the one whose byte sequences, of those that no
    earlier segment holds, speak most for toxic text. found: sequences of each size of GRAMS and their weights."""
    text = b"\n".join(toxic)
    places, which, weight = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    ends = places
    for size, (keys, own) in zip(GRAMS, found, strict=True):
        grams = _grams(text, size)
        if len(keys) and len(grams):
            at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == grams)
            places, which, ends = np.concatenate((places, hit)), np.concatenate((which, at[hit] + len(weight))), np.concatenate((ends, hit + size))
            weight = np.concatenate((weight, own))
    order = np.argsort(places, kind="stable")
    places, which, ends, out = places[order], which[order], ends[order], b""
    while len(out) < TOXIC:
        held = weight[which] > 0
        places, which, ends = places[held], which[held], ends[held]
        if not len(places):
            break
        total = np.concatenate(([0.0], np.cumsum(weight[which])))
        stop = np.searchsorted(places, places + SEGMENT - max(GRAMS) + 1)
        best = int((total[stop] - total[:-1]).argmax())
        own = slice(best, stop[best])
        out = text[places[best] : ends[own].max()] + out
        weight[which[own]] = 0
    return out


def dictionaries(ordinary: list[bytes], toxic: list[bytes]) -> tuple[bytes, bytes]:
    """Contents of the ordinary and of the toxic dictionary, equal but for the place of the toxic segments."""
    ordinary, toxic = [marked(t) for t in ordinary], [marked(t) for t in toxic]
    group = groups(ordinary + toxic)
    found = [_typical(ordinary, toxic, size, group) for size in GRAMS]
    own = segments(toxic, found)
    pieces = ordinary
    for size, (keys, _) in zip(GRAMS, found, strict=True):
        pieces = [p for t in pieces for p in _without(t, keys, size)]
    samples = [w for p in pieces for w in windows_of(p)]
    samples = samples[:: max(1, -(-len(samples) // TRAINED))]
    try:
        content = zstandard.train_dictionary(ORDINARY, samples).as_bytes()
    except zstandard.ZstdError:  # too few windows to choose from: all of them
        content = b"".join(samples)[-ORDINARY:]
    shared, other = content[len(own) :], content[: len(own)]
    return shared + other, shared + own


def fit(texts: list[bytes], labels: np.ndarray) -> Detector:
    """Dictionaries from all texts, calibrated by those that hold each of PARTS parts of the texts back; without both
    labels in every part, a score of the labels' mean."""
    part = np.zeros(len(texts), np.int64)
    for y in (0, 1):
        of = np.flatnonzero(labels == y)
        part[of] = np.arange(len(of)) % PARTS
    pick = lambda use, y: [texts[i] for i in np.flatnonzero(use & (labels == y))]
    n = [(labels == y).sum() for y in (0, 1)]
    if min(n) < PARTS:
        detector = Detector((b"", b""))
        share = (labels.sum() + 0.5) / (len(labels) + 2)
        detector.weights[0] = np.log(share / (1 - share))
        return detector
    found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
    for k in range(PARTS):
        held_back = Detector(dictionaries(pick(part != k, 0), pick(part != k, 1)))
        for i in np.flatnonzero(part == k):
            found[i] = held_back.differences(texts[i])
    detector = Detector(dictionaries(pick(part >= 0, 0), pick(part >= 0, 1)))
    seen = np.zeros((2, MOST - LEAST + 1))
    for y, x in zip(labels, found, strict=True):
        seen[y, np.unique(np.clip(x, LEAST, MOST)) - LEAST] += 1
    detector.odds = _log_odds(seen[1], n[1], seen[0], n[0])
    plain = np.concatenate([x for y, x in zip(labels, found, strict=True) if not y])
    detector.mark = int(np.quantile(plain, UNMARKED)) if len(plain) else MOST
    x, y = np.array([detector.features(d) for d in found]), labels
    detector.mean, detector.scale = x.mean(0), x.std(0) + 1e-9
    design = np.column_stack((np.ones(len(x)), (x - detector.mean) / detector.scale))
    w = np.zeros(FEATURES + 1)
    for _ in range(50):  # Newton steps of logistic regression with a unit ridge
        p = 1 / (1 + np.exp(-np.clip(design @ w, -50, 50)))
        ridge = np.r_[0.0, np.ones(FEATURES)]
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag(ridge + 1e-9), design.T @ (y - p) - ridge * w)
        w += step
        if abs(step).max() < 1e-8:
            break
    detector.weights = w
    return detector


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """toxic, text, r of at most sample training documents per label, those of the smallest hashes.

    A count of each label gives the bound under which its hashes should leave a few more ids than sample (all ids,
    where there are not many more); only those ids, so few, are ranked and sent to the texts.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != HELD)).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    known = cut(known.withColumn("h", id_hash("doc_id")))
    bounds = hash_bounds(known.groupBy("toxic").count(), sample).select(F.col("toxic").alias("y"), "bound")
    near = known.join(F.broadcast(bounds), F.col("toxic") == F.col("y")).where(F.col("h") < F.col("bound"))
    rank = F.row_number().over(Window.partitionBy("toxic").orderBy("h", "doc_id"))
    ids = near.withColumn("r", rank).where(F.col("r") <= sample).select("doc_id", "toxic", "h")
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    again = F.row_number().over(Window.partitionBy("toxic").orderBy("h", "doc_id", F.xxhash64("text")))
    return texts.withColumn("r", again).where(F.col("r") <= sample).select("toxic", "text", "r")


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Detector:
    """A detector fitted on the bounded sample, which one task takes; only the detector comes to the driver."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["r", "toxic"])
        return pd.DataFrame({"model": [pickle.dumps(fit([t.encode() for t in rows["text"]], rows["toxic"].to_numpy(np.int64)))]})

    rows = cut(sampled(docs, labels, sample)).withColumn("all", F.lit(0)).groupBy("all").applyInPandas(one, "model binary").collect()
    return pickle.loads(rows[0]["model"]) if rows else fit([], np.zeros(0, np.int64))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs(doc_id, text).

    Only the text enters a score; null and empty texts get the score of no evidence. Labels other than 0 and 1, null
    ids and texts are not learnt from; with no usable labels every score is 0.25 (one half of a toxic document seen
    among two). Repeated ids are scored each; other columns are ignored; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, sample))
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(raw_texts(batch.column(1))))], ["doc_id", "score"])

    found = map_batches(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double")
    return found.select("doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
