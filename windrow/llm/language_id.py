"""Language ID by segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for each piece of the vocabulary, learnt from piece counts of labelled texts. The
likelihood of a word is the sum over all ways to cut it into pieces, by a forward algorithm; a text's is the product
over its words. Words are runs of letters, lower-cased, with the vocabulary's word mark in front. Pieces never span
words, so the sum over a text's segmentations factors into its words, and each distinct word is scored once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm.common import fold, packed, table, unpacked

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
LETTERS = re.compile(r"[^\W\d_]+")
#: Places of all words that the forward algorithm works through at once, with the last ones carried over to the next.
SLICE = 40
#: After so many places the forward sums are scaled to a largest one of 1, the factor kept as a logarithm.
RESCALE = 4
#: Probability of a letter that is no piece, in each language.
UNKNOWN = 1e-6
#: Added to each piece's count.
SMOOTHING = 0.05
#: Distinct words whose counts a task holds at once, and numbers (words x languages) whose likelihoods it holds; beyond
#: that the store is emptied, results stay.
HELD_WORDS = 200_000
HELD_NUMBERS = 1_600_000
#: Numbers (words x languages) that the forward algorithm works on at once.
BLOCK_NUMBERS = 80_000
#: Bits of a slot's number in the table of the trie's edges.
SLOT_BITS = 20
#: Words whose lists a task holds at once.
RUN_WORDS = 100_000
#: The model has vocabulary x languages numbers; more languages than this are refused.
MAX_LANGUAGES = 400
UNDETERMINED = "und"


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


@dataclass
class Model:
    """languages, sorted; log_prior by language; pieces to rows of `probability` (pieces x languages).

    The unknown piece's row is put after them.
    """

    languages: list[str]
    log_prior: np.ndarray
    pieces: dict[str, int]
    probability: np.ndarray

    def __post_init__(self) -> None:
        """A trie of the pieces as one table of (node, letter) to child, found by hash slot, and each node's piece."""
        self.unknown = len(self.pieces)
        if len(self.probability) == self.unknown:
            self.probability = np.vstack([self.probability, np.full((1, len(self.languages)), UNKNOWN)])
        children: dict[int, int] = {}
        rows = [-1]
        for piece, row in self.pieces.items():
            node = 0
            for letter in piece:
                node = children.setdefault(node << 21 | ord(letter), len(rows))
                if node == len(rows):
                    rows.append(-1)
            rows[node] = row
        self._row = np.array(rows)
        self._longest = max(map(len, self.pieces), default=1)
        self._keys = np.array(sorted(children), np.int64)
        self._child = np.array([children[k] for k in self._keys.tolist()], np.int64)
        self._slots = np.full(1 << SLOT_BITS, -1, np.int32)
        self._slots[self._slot(self._keys)] = np.arange(len(self._keys))

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)

    def _step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Children of the nodes by the letters, -1 where there is none."""
        keys = node << 21 | letter
        at = self._slots[self._slot(keys)]
        out = np.full(len(keys), -1, np.int64)
        if not len(self._keys):
            return out
        same = (at >= 0) & (self._keys[at] == keys)
        out[same] = self._child[at[same]]
        other = np.flatnonzero((at >= 0) & ~same)  # another key has the slot
        found = np.minimum(np.searchsorted(self._keys, keys[other]), len(self._keys) - 1)
        hit = self._keys[found] == keys[other]
        out[other[hit]] = self._child[found[hit]]
        return out

    def _edges(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(end, start, text, row) of every piece at every place, by end. A letter that is no piece itself is unknown."""
        letters = np.frombuffer("".join(t + "\0" for t in texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, texts), np.int64)
        text_of = np.repeat(np.arange(len(texts)), sizes)
        start = np.arange(len(text_of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        first = np.arange(len(text_of)) + text_of  # place in letters, with a zero after each text
        node = self._step(np.zeros(len(first), np.int64), letters[first])
        row = np.where(node >= 0, self._row[node], -1)
        found = [(start + 1, start, text_of, np.where(row >= 0, row, self.unknown))]
        length = 1
        live = node >= 0
        while live.any():
            node, first, start, text_of = node[live], first[live], start[live], text_of[live]
            node = self._step(node, letters[first + length])
            length += 1
            live = node >= 0
            ends = live & (self._row[node] >= 0)
            found.append((start[ends] + length, start[ends], text_of[ends], self._row[node[ends]]))
        end, start, text_of, row = (np.concatenate([f[i] for f in found]) for i in range(4))
        order = np.argsort(end, kind="stable")
        return end[order], start[order], text_of[order], row[order]

    def likelihoods(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word in each language (words x languages): the forward algorithm over all words.

        A letter that no piece covers alone counts as an unknown piece, so every word has a segmentation.
        """
        out = np.zeros((len(words), len(self.languages)))
        if not words:
            return out
        order = np.argsort([-len(w) for w in words], kind="stable")  # longest first: those that go on come before those at their end
        texts = [MARK + words[i] for i in order]
        sizes = np.fromiter(map(len, texts), np.int64)
        ring = self._longest + 1
        alpha = np.zeros((ring, len(texts), len(self.languages)))
        alpha[0] = 1.0
        scale = np.zeros(alpha.shape[1:])
        for done in range(0, int(sizes[0]), SLICE):
            back = max(0, done - self._longest + 1)
            live = texts[: np.searchsorted(-sizes, -done)]
            end_of, start_of, text_of, row_of = self._edges([t[back : done + SLICE] for t in live])
            end_of, start_of = end_of + back, start_of + back
            ends = np.arange(done + 1, min(done + SLICE, int(sizes[0])) + 1)
            cuts = np.searchsorted(end_of, np.append(ends, ends[-1] + 1))
            for k, end in enumerate(ends.tolist()):
                part = slice(cuts[k], cuts[k + 1])
                n, on = np.searchsorted(-sizes, -end, "right"), np.searchsorted(-sizes, -end)
                gain = alpha[start_of[part] % ring, text_of[part]] * self.probability[row_of[part]]
                now = alpha[end % ring]
                for c in range(gain.shape[1]):
                    now[:n, c] = np.bincount(text_of[part], gain[:, c], n)
                out[order[on:n]] = np.log(now[on:n]) + scale[on:n]
                if on and end % RESCALE == 0:
                    top = alpha[:, :on].max(axis=0)
                    alpha[:, :on] /= top
                    scale[:on] += np.log(top)
        return out


def _vocabulary(proto: bytes) -> tuple[sentencepiece.SentencePieceProcessor, dict[int, str]]:
    """The processor, and its pieces by id without control, unknown and byte pieces."""
    sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
    real = {i: sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    return sp, real


def piece_counts(labelled: DataFrame, proto: bytes) -> DataFrame:
    """(lang, piece, n) over all rows of (text, lang): counts of pieces, and at piece -1 of texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sp, _ = _vocabulary(proto)
        held: dict[str, Counter] = {}
        sums: dict[str, np.ndarray] = {}

        def flush() -> None:
            for lang, words in held.items():
                total = sums.setdefault(lang, np.zeros(sp.get_piece_size() + 1, np.int64))
                names = list(words)
                for i in range(0, len(names), 20_000):
                    block = names[i : i + 20_000]
                    ids = sp.encode(block, num_threads=1)
                    weight = np.repeat([words[w] for w in block], [len(x) for x in ids])
                    total[:-1] += np.bincount([x for one in ids for x in one], weight, sp.get_piece_size()).astype(np.int64)
                words.clear()

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                sums.setdefault(lang, np.zeros(sp.get_piece_size() + 1, np.int64))[-1] += 1
                held.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, held.values())) > HELD_WORDS:
                flush()
        flush()
        for lang, total in sums.items():
            seen = np.flatnonzero(total)
            yield pd.DataFrame({"lang": pd.Series([lang] * len(seen), dtype=object), "piece": np.where(seen == sp.get_piece_size(), -1, seen), "n": total[seen]})

    rows = labelled.select("text", "lang").mapInPandas(count, "lang string, piece long, n long")
    return rows.groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, vocabulary: str = VOCABULARY) -> Model | None:
    """The model of all rows of (text, lang) with neither null; None if there are none."""
    with open(vocabulary, "rb") as f:  # on the driver; tasks get the bytes
        proto = f.read()
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    languages = sorted(r["lang"] for r in known.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if not languages:
        return None
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to tell apart")
    rows = piece_counts(known, proto).toPandas()  # languages x vocabulary at most
    _, real = _vocabulary(proto)
    at = {lang: i for i, lang in enumerate(languages)}
    docs = np.zeros(len(languages))
    grid = np.zeros((max(real) + 1, len(languages)))
    for lang, piece, n in rows.itertuples(index=False):
        if piece < 0:
            docs[at[lang]] += n
        elif piece in real:
            grid[piece, at[lang]] += n
    ids = sorted(real)
    grid = grid[ids] + SMOOTHING
    return Model(languages, np.log(docs / docs.sum()), {real[i]: k for k, i in enumerate(ids)}, grid / grid.sum(axis=0))


def _with_guess(docs: DataFrame, model: Model | None, text_col: str) -> DataFrame:
    """(callers_columns, guess) for each row of docs, guess being struct(lang_pred, score)."""
    if model is None:
        return docs.select(packed(docs), F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score")).alias("guess"))
    parts = (model.languages, model.log_prior, model.pieces, model.probability)

    @F.pandas_udf("lang_pred string, score double")
    def guess(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Model(*parts)
        known: dict[str, int] = {}
        n = len(own.languages)
        store = np.zeros((HELD_NUMBERS // n, n))
        step = max(1, BLOCK_NUMBERS // n)
        for batch in texts:
            names: list[str] = []
            scores: list[float] = []
            for found in _runs(map(words_of, batch)):
                fresh = list({w for ws in found for w in ws} - known.keys())
                if len(known) + len(fresh) > len(store):
                    known = {}
                    fresh = list({w for ws in found for w in ws})
                    store = store if len(fresh) <= len(store) else np.zeros((len(fresh), n))
                for i in range(0, len(fresh), step):
                    block = fresh[i : i + step]
                    store[len(known) : len(known) + len(block)] = own.likelihoods(block)
                    known.update(zip(block, range(len(known), len(known) + len(block)), strict=True))
                for ws in found:
                    if not ws:
                        names.append(UNDETERMINED)
                        scores.append(0.0)
                        continue
                    total = own.log_prior + store[[known[w] for w in ws]].sum(axis=0)
                    best = int(total.argmax())
                    names.append(own.languages[best])
                    scores.append(float(1 / np.exp(total - total[best]).sum()))
            yield pd.DataFrame({"lang_pred": pd.Series(names, dtype=object), "score": scores})

    return docs.select(packed(docs), guess.asNondeterministic()(F.col(text_col)).alias("guess"))  # or else a filter would work it out again


def _runs(texts: Iterator[list[str]]) -> Iterator[list[list[str]]]:
    """Texts' words in runs of about RUN_WORDS, so that few word lists are held at once."""
    part: list[list[str]] = []
    n = 0
    for words in texts:
        part.append(words)
        n += len(words)
        if n >= RUN_WORDS:
            yield part
            part, n = [], 0
    if part:
        yield part


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score: the likeliest language (ties: the first in order) and its posterior probability.

    Null texts and texts without a letter get `und` and 0, as do all texts where there was nothing to learn from.
    Columns of docs that bear one of the two names are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    return _with_guess(docs, model, text_col).select(*unpacked(docs.columns), "guess.*")


HELD_OUT = 1
FOLDS = 3


def held_out(df: DataFrame) -> DataFrame:
    """df with held_out: the row's fold is the held-out one. Rows with a null doc_id are not, and train nothing."""
    return df.withColumn("held_out", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)))


def train(docs: DataFrame, vocabulary: str = VOCABULARY) -> Model | None:
    """The model of the rows of (doc_id, text, lang) outside the held-out fold."""
    return fit(docs.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT).select("text", "lang"), vocabulary)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(held_out(docs.select("doc_id", "text")), train(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def keep(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """The rows of docs whose language is determined with a posterior of at least `least`, with their own columns."""
    found = _with_guess(docs, model, "text")
    return found.where((F.col("guess.lang_pred") != UNDETERMINED) & (F.col("guess.score") >= least)).select(*unpacked(docs.columns))
