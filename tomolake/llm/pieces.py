"""SentencePiece BPE encoding and decoding by vectorised merge rounds over flat numpy arrays."""

from __future__ import annotations

import codecs
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tomolake.llm.common import BATCH_BYTES, map_batches

SPACE = "▁"
codecs.register_error("each_byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))  # as the library marks bad bytes
_NEVER = np.int32(2**31 - 1)


class PieceModel:
    """The tables of a BPE model file: symbols of characters, and rank and result of each pair that merges.

    The library reads the file and normalises text; merging and decoding are done here.
    """

    def __init__(self, path: str):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        known = {p: i for i, p in enumerate(names) if not special[i]}
        if any(SPACE in p.lstrip(SPACE) for p in known):
            raise ValueError("a piece spans words")
        for c in sorted({c for p in known for c in p}):  # characters that are only parts of pieces are symbols too
            known.setdefault(c, len(known) + n)
        self.symbols = max(known.values()) + 1
        self.symbol_of = np.full(0x110000, -1, np.int32)
        for p, i in known.items():
            if len(p) == 1:
                self.symbol_of[ord(p)] = i
        scores = np.array([sp.get_score(i) for i in range(n)])
        distinct, rank = np.unique(-scores, return_inverse=True)
        shared = np.bincount(rank, [not s for s in special]) > 1
        pairs = [(known[p[:k]] * self.symbols + known[p[k:]], i) for p, i in known.items() if i < n for k in range(1, len(p)) if p[:k] in known and p[k:] in known]
        keys, made = np.array(pairs, np.int64).reshape(-1, 2).T
        order = np.argsort(keys)
        self.keys, self.made = keys[order], made[order].astype(np.int32)
        self.ranks, self.shared = rank[self.made].astype(np.int32), shared
        self.n = n
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.unknown = sp.unk_id()
        self.fallback = all(sp.is_byte(int(i)) for i in self.byte_ids)
        out = [b"" if sp.is_control(i) else b" \xe2\x81\x87 " if sp.is_unknown(i) else bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        self.out_bytes = np.frombuffer(b"".join(out), np.uint8)
        self.out_sizes = np.array([len(x) for x in out])
        self.out_starts = np.cumsum(self.out_sizes) - self.out_sizes
        self.leads = np.array([p.startswith(SPACE) for p in names])
        self.control = np.array([sp.is_control(i) for i in range(n)])
        line = "" if self.symbol_of[10] >= 0 else "\n"  # a line end that merges with nothing may part words
        self.units = re.compile(f"{SPACE}+[^{SPACE}{line}]*|[^{SPACE}{line}]+" + (f"|{line}" if line else ""))

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (the lowest merges first) and the symbol it makes."""
        key = left.astype(np.int64) * self.symbols + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], _NEVER), np.where(hit, self.made[at], -1)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all words, one after another, and how many each word has.

        Each round finds every word's lowest pair rank, merges all its leftmost non-overlapping occurrences at once
        and compacts the arrays; words without a pair left are set aside. Pieces that share a score could go before
        the other occurrences once made, so of such a rank a round merges only the leftmost pair.
        """
        sizes = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym = self.symbol_of[points]
        sym = np.where(sym < 0, -1 - points.astype(np.int32), sym)  # unknown characters keep their code point
        word = np.repeat(np.arange(len(words)), sizes)
        done_sym, done_word = [], []

        def ranks_at(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            j = np.minimum(i + 1, len(sym) - 1)
            r, m = self.pair_ranks(sym[i], sym[j])
            inside = (word[i] == word[j]) & (j > i)
            return np.where(inside, r, _NEVER), m

        rank, made = ranks_at(np.arange(len(sym))) if len(sym) else (np.zeros(0, np.int32),) * 2
        while len(sym):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            lengths = np.diff(np.append(starts, len(sym)))
            least = np.minimum.reduceat(rank, starts)
            if (over := least == _NEVER).any():
                away = np.repeat(over, lengths)
                done_sym.append(sym[away])
                done_word.append(word[away])
                stay = ~away
                sym, word, rank, made = sym[stay], word[stay], rank[stay], made[stay]
                starts, lengths, least = None, lengths[~over], least[~over]
                if not len(sym):
                    break
            low = np.repeat(least, lengths)
            chosen = np.flatnonzero(rank == low)
            run = np.concatenate(([True], np.diff(chosen) > 1))  # neighbouring pairs overlap: take every other one
            step = np.arange(len(chosen))
            chosen = chosen[(step - np.maximum.accumulate(np.where(run, step, 0))) % 2 == 0]
            if (tied := self.shared[low[chosen]]).any():
                first = np.concatenate(([True], word[chosen[1:]] != word[chosen[:-1]]))
                chosen = chosen[first | ~tied]
            sym[chosen] = made[chosen]
            keep = np.ones(len(sym), bool)
            keep[chosen + 1] = False
            sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
            now = chosen - np.arange(len(chosen))
            touched = np.unique(np.concatenate((now, np.maximum(now - 1, 0))))
            rank[touched], made[touched] = ranks_at(touched)
        if not done_sym:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return self._with_bytes(sym[order], word[order], len(words))

    def _with_bytes(self, sym: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols without a piece become the ids of their UTF-8 bytes, or the unknown id."""
        odd = np.flatnonzero((sym < 0) | (sym >= self.n))
        if len(odd):
            back = {int(s): chr(c) for c, s in zip(np.flatnonzero(self.symbol_of >= self.n), self.symbol_of[self.symbol_of >= self.n], strict=True)}
            own = [(chr(-1 - s) if s < 0 else back[s]).encode("utf-8", "surrogatepass") for s in sym[odd].tolist()]
            sizes = np.ones(len(sym), np.int64)
            if self.fallback:
                sizes[odd] = [len(x) for x in own]
            at = np.cumsum(sizes) - sizes
            out = np.repeat(sym, sizes)
            if self.fallback:
                fill = np.repeat(at[odd], sizes[odd]) + np.concatenate([np.arange(len(x)) for x in own])
                out[fill] = self.byte_ids[np.frombuffer(b"".join(own), np.uint8)]
            else:
                out[at[odd]] = self.unknown
            sym, word = out, np.repeat(word, sizes)
        return sym, np.bincount(word, minlength=n)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Per text the numbers of its distinct words in order; then all words' ids, their sizes and starts."""
        seen: dict[str, int] = {}
        texts_words = []
        for text in self.library.normalize(texts) if texts else []:
            texts_words.append(np.array([seen.setdefault(u, len(seen)) for u in self.units.findall(text)], np.int64))
        ids, sizes = self.merge(list(seen))
        return texts_words, ids, sizes, np.cumsum(sizes) - sizes

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 text of ids: pieces with spaces restored, bytes joined, the space before the first piece dropped."""
        if not len(ids):
            return b""
        sizes = self.out_sizes[ids]
        ends = np.cumsum(sizes)
        text = self.out_bytes[np.repeat(self.out_starts[ids] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes()
        shown = np.flatnonzero(~self.control[ids[:64]])
        if len(shown) and self.leads[ids[shown[0]]]:
            text = text[1:]
        try:
            text.decode()
        except UnicodeDecodeError:
            text = text.decode("utf-8", "each_byte").encode()
        return text


def gather(words: np.ndarray, ids: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """ids of a sequence of words."""
    n = sizes[words]
    ends = np.cumsum(n)
    return ids[np.repeat(starts[words] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


@lru_cache(1)
def model_of(path: str) -> PieceModel:
    return PieceModel(path)


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", outputs: tuple[str, ...] = ("ids",)) -> DataFrame:
    """doc_id and the outputs asked for, of every row of docs(doc_id, text): ids (array<int>), n_tokens, ids_sha256
    (of the decimal ids, comma-joined), decoded (text), decoded_sha256.

    Null texts count as empty and have no ids; texts of any length are encoded whole; repeated ids give a row each;
    other columns are ignored.
    """
    kinds = {"ids": "array<int>", "n_tokens": "long", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = model_of(path)
        texts = [x or "" for x in batch.column(1).to_pylist()]
        words, ids, sizes, starts = model.encode(texts)
        cols: dict[str, list] = {k: [] for k in outputs}
        spelled = None
        if "ids_sha256" in outputs:
            digits = [b"%d" % i for i in range(model.n)]
            flat, ends = [digits[i] for i in ids.tolist()], (starts + sizes).tolist()
            spelled = [b",".join(flat[a:b]) for a, b in zip(starts.tolist(), ends, strict=True)]
        for own in words:
            doc = gather(own, ids, sizes, starts)
            if "ids" in cols:
                cols["ids"].append(doc)
            if "n_tokens" in cols:
                cols["n_tokens"].append(len(doc))
            if spelled is not None:
                cols["ids_sha256"].append(hashlib.sha256(b",".join([spelled[w] for w in own.tolist()])).hexdigest())
            if "decoded" in cols or "decoded_sha256" in cols:
                text = model.decode(doc)
                if "decoded" in cols:
                    cols["decoded"].append(text.decode())
                if "decoded_sha256" in cols:
                    cols["decoded_sha256"].append(hashlib.sha256(text).hexdigest())
        types = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}
        arrays = [batch.column(0)] + [pa.array(cols[k], types.get(k, pa.string())) for k in outputs]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", *outputs])

    source = docs.selectExpr(f"`{key}` AS doc_id", "CAST(text AS string) AS text")
    kind = source.schema["doc_id"].dataType.simpleString()
    return map_batches(source, run, ", ".join([f"doc_id {kind}", *(f"{k} {kinds[k]}" for k in outputs)]), 2048, BATCH_BYTES)
