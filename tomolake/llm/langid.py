"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomolake.llm.common import cut, fold, hash_bounds, id_hash, map_batches

UNDETERMINED = "und"
ORDER = 5
#: Documents of each language that a model is fitted on at most, those of the smallest hashes; a quarter of them
#: calibrate the rejection.
SAMPLE = 400
#: Part of the calibration documents whose excess stays within reach; what lies beyond is rejected.
WITHIN = 0.99
#: Characters from which on an excess weighs no more by length: the spread of long texts is that of their kinds.
SPAN = 200
#: Nats a character above its language that a long text may always be.
SLACK = 0.6
#: Languages up to which a hash has a value for each.
DENSE = 16
#: Letters whose evidence the score counts at most.
EVIDENCE = 40
#: Texts that are scored together; their different words are scored once.
TEXTS = 512
#: Learn from documents whose id hash modulo FOLDS is not HELD.
FOLDS, HELD = 3, 1

_STEP = np.uint64(0x9E3779B97F4A7C15)
_EDGE = 1


def letters_of(word: str) -> str:
    """The word's letters (Unicode category L); numerals, signs and combining marks tell nothing here and go."""
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


class Grams:
    """Characters of words between edge marks, and the hashes of the n-grams (n up to ORDER) ending at each."""

    def __init__(self, words: list[str], order: int = ORDER):
        sizes = np.array([len(w) + 2 for w in words], np.int64)
        starts = np.cumsum(sizes) - sizes
        points = np.full(int(sizes.sum()), _EDGE, np.uint64)
        inner = np.ones(len(points), bool)
        inner[starts] = inner[starts + sizes - 1] = False
        points[inner] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.word, self.starts = np.repeat(np.arange(len(words)), sizes), starts
        self.at = np.arange(len(points)) - starts[self.word] if len(words) else np.zeros(0, np.int64)
        single = (points + np.uint64(1)) * _STEP
        single ^= single >> np.uint64(29)
        self.keys = [np.zeros(len(points), np.uint64), single]
        for n in range(2, order + 1):  # an n-gram is an (n - 1)-gram with one more character before it
            longer = np.zeros(len(points), np.uint64)
            if len(points) >= n:
                longer[n - 1 :] = (self.keys[n - 1][n - 1 :] * _STEP + np.uint64(n)) ^ single[: len(points) - n + 1]
            self.keys.append(longer)

    def context(self, n: int, i: np.ndarray) -> np.ndarray:
        """Hash of the n - 1 characters before position i."""
        return self.keys[n - 1][i - 1] if n > 1 else np.zeros(len(i), np.uint64)


def fit(texts: list[str], order: int = ORDER) -> list[tuple[np.ndarray, ...]]:
    """For n = 1 .. order: sorted n-gram hashes and their discounted parts, sorted context hashes and their shares.

    The top order counts occurrences; lower ones count the different characters that precede an n-gram, except for
    n-grams that begin a word, which nothing precedes: those count occurrences. D = n1 / (n1 + 2 n2) per order.
    """
    counts = Counter(w for t in texts for w in map(letters_of, t.lower().split()) if w)
    grams = Grams(list(counts), order)
    weight = np.array(list(counts.values()), np.float64)[grams.word] if counts else np.zeros(0)
    out, wider = [], None
    for n in range(order, 0, -1):
        fits = (grams.at >= n - 1) & (grams.at > 0)
        if wider is None:
            at, w = np.flatnonzero(fits), weight[fits]
        else:
            first = np.flatnonzero(fits & (grams.at == n - 1))
            at, w = np.concatenate((wider, first)), np.concatenate((np.ones(len(wider)), weight[first]))
        keys, where, inverse = np.unique(grams.keys[n][at], return_index=True, return_inverse=True)
        c = np.bincount(inverse, w, len(keys))
        held = np.flatnonzero(fits)
        wider = held[np.unique(grams.keys[n][held], return_index=True)[1]]
        contexts, group = np.unique(grams.context(n, at[where]), return_inverse=True)
        total, kinds = np.bincount(group, c, len(contexts)), np.bincount(group, minlength=len(contexts))
        once, twice = (c == 1).sum(), (c == 2).sum()
        d = once / (once + 2 * twice) if once and twice else 0.5
        out.append((keys, np.maximum(c - d, 0) / total[group], contexts, np.minimum(d * kinds, total) / total))
    return out[::-1]


class Lookup:
    """Values of hashes under each language over one sorted array of hashes.

    For few languages each hash has a row of all their values. For more, as most hashes are known to few languages, it
    has only those languages' values, so that the size follows the sum of the languages' models.
    """

    def __init__(self, fitted: list[tuple[np.ndarray, np.ndarray]], missing: float, dense: int = DENSE):
        held = np.concatenate([np.zeros(0, np.uint64), *(keys for keys, _ in fitted)])
        self.keys, where = np.unique(held, return_inverse=True)
        self.missing, self.count, self.table = missing, len(fitted), None
        language = np.repeat(np.arange(len(fitted), dtype=np.int16), [len(keys) for keys, _ in fitted])
        values = np.concatenate([np.zeros(0), *(own for _, own in fitted)]).astype(np.float32)
        if self.count <= dense:
            self.table = np.full((len(self.keys) + 1, self.count), missing, np.float32)  # the last row: no such hash
            self.table[where, language] = values
        else:
            order = np.argsort(where, kind="stable")
            self.languages, self.values = language[order], values[order]
            self.sizes = np.bincount(where, minlength=len(self.keys)).astype(np.int32)
            self.starts = np.cumsum(self.sizes) - self.sizes

    def rows(self, wanted: np.ndarray) -> np.ndarray:
        """wanted, language: the values, `missing` where a language does not know the hash."""
        if not len(self.keys):
            return np.full((len(wanted), self.count), self.missing, np.float32)
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == wanted
        if self.table is not None:
            return self.table[np.where(known, at, len(self.keys))]
        out, hit = np.full((len(wanted), self.count), self.missing, np.float32), np.flatnonzero(known)
        first, n = self.starts[at[hit]], self.sizes[at[hit]]
        flat = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out.ravel()[np.repeat(hit * self.count, n) + self.languages[flat]] = self.values[flat]
        return out


@dataclass
class Models:
    """All languages' models over joint sorted hash arrays: for each order the n-grams' parts and the contexts' shares."""

    languages: list[str]
    orders: list[tuple[Lookup, Lookup]]
    uniform: float
    level: np.ndarray | None = None
    reach: np.ndarray | None = None

    @classmethod
    def join(cls, fitted: dict[str, list[tuple[np.ndarray, ...]]], dense: int = DENSE) -> Models:
        languages, n = sorted(fitted), len(next(iter(fitted.values()), []))
        orders = [tuple(Lookup([fitted[x][k][c : c + 2] for x in languages], missing, dense) for c, missing in ((0, 0.0), (2, 1.0))) for k in range(n)]
        return cls(languages, orders, 1 / (len(orders[0][0].keys) + 1) if orders else 1.0)

    def nats(self, words: list[str]) -> np.ndarray:
        """Negative log probability of each word, its end included, under each language."""
        if not words:
            return np.zeros((0, len(self.languages)))
        grams = Grams(words, len(self.orders))
        i = np.flatnonzero(grams.at > 0)
        p = np.full((len(i), len(self.languages)), self.uniform, np.float32)
        for n, (parts, shares) in enumerate(self.orders, 1):
            deep = np.flatnonzero(grams.at[i] >= n - 1)
            j = i[deep]
            p[deep] = parts.rows(grams.keys[n][j]) + shares.rows(grams.context(n, j)) * p[deep]
        first = grams.starts - np.arange(len(words))
        return np.add.reduceat(-np.log(p.astype(np.float64)), first, axis=0)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character under each language and number of characters (a word's end is one)."""
        seen: dict[str, int] = {}
        docs = [np.array([seen.setdefault(w, len(seen)) for w in (t or "").lower().split()], np.int64) for t in texts]
        letters = [letters_of(w) for w in seen]
        nats = self.nats(letters)
        size = np.array([len(w) + 1 if w else 0 for w in letters], np.int64)
        nats[size == 0] = 0
        total = np.array([nats[d].sum(0) for d in docs]).reshape(len(docs), len(self.languages))
        n = np.array([size[d].sum() for d in docs], np.int64)
        return total / np.maximum(n, 1)[:, None], n

    def excess(self, best: np.ndarray, entropy: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Nats a character above the language's level, over a spread that falls with length to that of SPAN characters."""
        return (entropy - self.level[best]) * np.sqrt(n * SPAN / (n + SPAN))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language of the lowest cross-entropy (ties to the first by name), score and whether it is rejected.

        The score is the language's share of the likelihoods over at most EVIDENCE characters, lowered in
        proportion where the text is less like the language than the calibration documents allow.
        """
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        entropy, n = self.entropies(texts)
        best = entropy.argmin(1)
        low = entropy[np.arange(len(texts)), best]
        share = 1 / np.exp(-(entropy - low[:, None]) * np.minimum(n, EVIDENCE)[:, None]).sum(1)
        over = self.excess(best, low, n) / self.reach[best]
        blank = n == 0
        names = [UNDETERMINED if b else self.languages[k] for b, k in zip(blank, best, strict=True)]
        return names, np.where(blank, 0.0, share / np.maximum(over, 1.0)), blank | (over > 1)


def sampled(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """lang, text, held of at most sample training documents per language, about those of the smallest hashes.

    A first count gives each language the bound under which its hashes should leave a few more than sample rows (all
    rows, where there are not many more); only those are ranked, so no language's rows meet in one task.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", FOLDS) != HELD))
    rows = rows.select(F.col("doc_id").alias("i"), F.col("lang").alias("l"), id_hash("doc_id").alias("h"), F.col("text").cast("string").alias("text"))
    bounds = hash_bounds(rows.groupBy("l").count(), sample).select(F.col("l").alias("b"), "bound")
    near = rows.join(F.broadcast(bounds), F.col("l") == F.col("b")).where(F.col("h") < F.col("bound"))
    rank = F.row_number().over(Window.partitionBy("l").orderBy("h", "i", F.xxhash64("text")))
    return near.withColumn("r", rank).where(F.col("r") <= sample).select(F.col("l").alias("lang"), "text", (F.col("r") % 4 == 0).alias("held"))


def learn(docs: DataFrame, sample: int = SAMPLE) -> Models:
    """Models of the languages in docs(doc_id, text, lang), fitted per language in tasks on a bounded sample."""
    chosen = cut(sampled(docs, sample))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        fitted = fit(rows["text"].tolist())
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "arrays": [[a.tobytes() for order in fitted for a in order]]})

    rows = chosen.where("not held").groupBy("lang").applyInPandas(one, "lang string, arrays array<binary>").collect()
    kinds = (np.uint64, np.float64) * 2
    models = Models.join({r["lang"]: [tuple(np.frombuffer(r["arrays"][4 * n + k], kinds[k]) for k in range(4)) for n in range(ORDER)] for r in rows})
    count = len(models.languages)
    if count:
        shared = chosen.sparkSession.sparkContext.broadcast(models)

        def calibrate(batch: pa.RecordBatch) -> pa.RecordBatch:
            entropy, n = shared.value.entropies(batch.column(1).to_pylist())
            best = entropy.argmin(1)
            right = [shared.value.languages[k] == x for k, x in zip(best, batch.column(0).to_pylist(), strict=True)]
            cols = [pa.array(best), pa.array(entropy[np.arange(len(best)), best]), pa.array(n), pa.array(right, pa.bool_())]
            return pa.RecordBatch.from_arrays(cols, ["lang", "entropy", "n", "right"])

        found = map_batches(chosen.where("held").select("lang", "text"), calibrate, "lang long, entropy double, n long, right boolean")
        seen = pd.DataFrame([r.asDict() for r in found.collect()], columns=["lang", "entropy", "n", "right"])
        seen = seen[(seen["n"] > 0) & seen["right"].astype(bool)]  # others are mislabelled, or tell nothing of their language
        models.level, models.reach = np.full(count, np.inf), np.full(count, SLACK * np.sqrt(SPAN))
        for k, own in seen.groupby("lang"):
            models.level[k] = own["entropy"].median()
        if len(seen):  # one reach for all languages: few calibration documents each would leave it to outliers
            over = models.excess(seen["lang"].to_numpy(), seen["entropy"].to_numpy(), seen["n"].to_numpy())
            models.reach[:] = max(np.quantile(over, WITHIN, method="lower"), models.reach[0])
        models.level[np.isinf(models.level)] = np.log(1 / models.uniform)  # nothing to calibrate by: reject nothing
    return models


def _predicted(docs: DataFrame, models: Models, keep: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(models)
    at = keep.index("text") if "text" in keep else len(keep)  # the text goes to Python once
    source = docs.select(*[F.col(c) for c in keep], *([] if "text" in keep else [F.col("text").cast("string")]))
    names = [f"_keep{k}" for k in range(len(keep))]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score, rejected = shared.value.predict(batch.column(at).to_pylist())
        cols = [*(batch.column(k) for k in range(len(keep))), pa.array(lang), pa.array(score), pa.array(rejected)]
        return pa.RecordBatch.from_arrays(cols, [*names, "lang_pred", "score", "rejected"])

    kinds = ", ".join(f"{n} {source.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True))
    return map_batches(source, run, f"{kinds}, lang_pred string, score double, rejected boolean", TEXTS)


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row of docs(doc_id, text, lang).

    Null texts and texts without a letter are `und`, score 0, and rejected, as is all where no row can be learnt
    from; whole texts count, whatever their length; a null id hashes as the empty text; repeated rows get equal
    results; other columns are ignored.
    """
    found = _predicted(docs, learn(docs, sample), ["doc_id"]).withColumnRenamed("_keep0", "doc_id")
    return found.select("doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), "lang_pred", "score", "rejected")


def drop_rejected(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs whose language is not rejected, in the same columns and as they were."""
    found = _predicted(docs, learn(docs, sample), docs.columns).where("not rejected")
    return found.select(*[F.col(f"_keep{k}").alias(c) for k, c in enumerate(docs.columns)])
