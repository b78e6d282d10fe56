"""Language identification by a linear-chain conditional random field over words.

Each word gets affix, character n-gram and lexicon features (hashed into `DIM` slots);
transitions between the labels of neighbouring words are learned. Forward-backward gives
every word its posterior over languages, so code-switched text is labelled word by word;
a document gets the language with the largest share of the posterior mass of its words.

Fitting uses a bounded sample of labelled rows: the `TRAIN_DOCS` rows first in the order of
a hash of their id, and of each text `TRAIN_PIECES` pieces of `PIECE_WORDS` words that lie evenly
over the whole of it. Labels of documents are taken for their words; pieces of different
documents are joined in part of the training sequences, so that the transitions see switches.
Prediction covers every word of every whole text; a sequence is a line. Lines of over `PIECE`
words are run in parts that overlap by `OVERLAP` words on either side, whose posteriors come
from the part in which they lie further inside.

Defined cases: `und` with score 0 where the text is null or has no letter, or where no
labelled row exists; ties go to the smaller language; texts of any length are taken whole;
repeated rows are each labelled; an empty table gives an empty result; other columns are kept,
whatever their names, but lang_pred, lang_score and lang_segments are replaced.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.common import GOLDEN, as_bytes, chunks, extended, map_batches, mixed, read, with_columns

TRAIN_DOCS, TRAIN_PIECES, PIECE_WORDS = 2_000, 5, 20
DIM, PIECE, OVERLAP, ROUNDS = 1 << 16, 256, 32, 20
CACHE_WORDS, TEXT_BYTES = 150_000, 1 << 20
#: Documents below this score are rejected by the pipeline.
KEEP_SCORE = 0.5
LETTERLESS = re.compile(r"[^\w\n]+|[\d_]+")


def slots(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(slot, word) pairs: of the word itself, of its 2- and 3-grams with the word's ends marked
    (so affixes of one and two letters are among them), and of its first and last three letters."""
    bare = LETTERLESS.sub("", "\n".join(words)).split("\n")
    codes = np.frombuffer("".join([f"^{w}$" for w in bare]).encode("utf-32-le", "surrogatepass"), np.uint32)
    last, start = codes == 36, codes == 94
    owner = np.cumsum(start) - 1
    full = np.fromiter(map(bool, bare), bool, len(bare))[owner]
    c = codes.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        two = (c[:-1] * GOLDEN + c[1:]) * GOLDEN
        three = (two[:-1] + c[2:]) * GOLDEN
        four = (three[:-1] + c[3:]) * GOLDEN
        offset = np.arange(len(c)) - np.flatnonzero(start)[owner]
        power = np.cumprod(np.full(int(offset.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
        whole = np.add.reduceat(c * power[offset], np.flatnonzero(start))
    inner2 = ~last[:-1] & full[:-1]
    inner3 = inner2[:-1] & ~last[1:-1]
    inner4 = inner3[:-1] & ~last[2:-1] & (start[:-3] | last[3:])
    kept = [np.flatnonzero(x) for x in (inner2, inner3, inner4)]
    there = np.flatnonzero(np.fromiter(map(bool, bare), bool, len(bare)))
    with np.errstate(over="ignore"):
        flat = np.concatenate([two[kept[0]] + np.uint64(2), three[kept[1]] + np.uint64(3), four[kept[2]] + np.uint64(4), whole[there]])
    return (mixed(flat) >> np.uint64(64 - 16)).astype(np.int64), np.concatenate([owner[k] for k in kept] + [there])


def scored(weights: np.ndarray, words: list[str]) -> np.ndarray:
    """Emission scores (words x labels); a word without letters has none."""
    if not words:
        return np.zeros((0, weights.shape[1]), np.float32)
    flat, owner = slots(words)
    return np.stack([np.bincount(owner, weights[flat, y], len(words)) for y in range(weights.shape[1])], axis=1)


def forward_backward(emission: np.ndarray, starts: np.ndarray, sizes: np.ndarray, trans: np.ndarray, init: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Posteriors of all words, expected transitions and log-likelihood's normaliser.

    emission: flat (words x labels) scores; sequences are emission[start : start + size].
    """
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    top = emission.max(axis=1, keepdims=True) if len(emission) else emission
    e, a, first = np.exp(emission - top), np.exp(trans), np.exp(init)
    alpha, beta, norm = np.empty_like(e), np.ones_like(e), np.empty(len(e), e.dtype)
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")
    for t in range(longest):
        at = starts[: active[t]] + t
        x = (alpha[at - 1] @ a if t else first) * e[at]
        norm[at] = s = x.sum(axis=1)
        alpha[at] = x / s[:, None]
    edges = np.zeros_like(a)
    for t in range(longest - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        ahead = e[at + 1] * beta[at + 1] / norm[at + 1][:, None]
        beta[at] = ahead @ a.T
        edges += alpha[at].T @ ahead * a
    gamma = alpha * beta
    return gamma / gamma.sum(axis=1, keepdims=True), edges, float(np.log(norm).sum() + top.sum())


def train(rows: list[tuple[str, str]], seed: int = 7) -> dict | None:
    """Fit the field to (language, text) rows by gradient ascent with per-weight steps (Adagrad)."""
    rows = sorted({(lang, text) for lang, text in rows if text and any(map(str.isalpha, text))})
    labels = sorted({lang for lang, _ in rows})
    if not labels:
        return None
    rng, pieces = np.random.default_rng(seed), []
    for lang, text in rows:
        words = text.lower().split()
        pieces += [(labels.index(lang), words[i : i + PIECE_WORDS]) for i in range(0, len(words), PIECE_WORDS)]
    pieces = [pieces[i] for i in rng.permutation(len(pieces))]
    vocabulary: dict[str, int] = {}
    words = np.array([vocabulary.setdefault(w, len(vocabulary)) for _, p in pieces for w in p], np.int64)
    gold = np.array([y for y, p in pieces for _ in p], np.int64)
    sizes = np.array([len(p) for _, p in pieces], np.int64)
    # one sequence of two pieces (often of two languages) for every two sequences of one piece
    grouped = [int(x) for n in range(0, len(sizes), 4) for x in ([sizes[n : n + 2].sum()] + list(sizes[n + 2 : n + 4]))]
    sizes = np.array([x for x in grouped if x], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    flat, owner = slots(list(vocabulary))
    n = len(labels)
    weights, trans, init = np.zeros((DIM, n)), np.zeros((n, n)), np.zeros(n)
    inner = np.ones(len(words), bool)
    inner[starts] = False
    true_edges = np.zeros((n, n))
    np.add.at(true_edges, (gold[np.flatnonzero(inner) - 1], gold[inner]), 1)
    true_word = np.zeros((len(vocabulary), n))
    np.add.at(true_word, (words, gold), 1)
    past = [np.full(x.shape, 1e-6) for x in (weights, trans, init)]
    for _ in range(ROUNDS):
        word_scores = np.stack([np.bincount(owner, weights[flat, y], len(vocabulary)) for y in range(n)], axis=1)
        gamma, edges, _ = forward_backward(word_scores[words], starts, sizes, trans, init)
        word_gap = true_word - np.stack([np.bincount(words, gamma[:, y], len(vocabulary)) for y in range(n)], axis=1)
        g_weights = np.stack([np.bincount(flat, word_gap[owner, y], DIM) for y in range(n)], axis=1) - 0.05 * weights
        first = np.zeros(n)
        np.add.at(first, gold[starts], 1)
        for x, g, p in zip((weights, trans, init), (g_weights, true_edges - edges - 0.1 * trans, first - gamma[starts].sum(axis=0)), past, strict=True):
            p += g * g
            x += 0.3 * g / np.sqrt(p)
    return {"labels": labels, "weights": weights.astype(np.float32), "trans": trans, "init": init}


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """The bounded sample: TRAIN_DOCS rows, first by a hash of the id, each with pieces from all over its text."""
    picked = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("h"), F.col(lang_col).cast("string").alias("l"), F.col(text_col).alias("t"))
    last = [r[0] for r in picked.select("h").orderBy("h").limit(TRAIN_DOCS).collect()][-1:]  # the texts of the picked rows alone are read then
    if not last:
        return []
    words = F.filter(F.split("t", r"\s+"), lambda w: w != "")
    room = F.size("w") - PIECE_WORDS
    spread = F.transform(F.sequence(F.lit(0), F.lit(TRAIN_PIECES - 1)), lambda i: F.array_join(F.slice("w", F.floor(i * room / (TRAIN_PIECES - 1)).cast("int") + 1, PIECE_WORDS), " "))
    whole = F.size("w") <= TRAIN_PIECES * PIECE_WORDS
    rows = picked.where(F.col("h") <= last[0]).withColumn("w", words).select("h", "l", F.when(whole, F.array_join("w", " ")).otherwise(F.array_join(spread, " ")).alias("t"))
    return [(r["l"], r["t"]) for r in rows.orderBy("h", "l", "t").limit(TRAIN_DOCS).collect()]


def parts_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sequences that lie one after another: the parts' bounds with their overlaps, and without."""
    ends = np.cumsum(sizes)
    counts = -(-sizes // PIECE)
    line = np.repeat(np.arange(len(sizes)), counts)
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    first = (ends - sizes)[line] + place * PIECE
    last = np.minimum(first + PIECE, ends[line])
    return np.maximum(first - OVERLAP, (ends - sizes)[line]), np.minimum(last + OVERLAP, ends[line]), first, last


class Labeller:
    """Posteriors for texts; emission scores of words are kept for a bounded number of words."""

    def __init__(self, model: dict):
        self.model, self.places, self.rows, self.count = model, {}, np.zeros((CACHE_WORDS * 2, len(model["labels"])), np.float32), 0
        self.letters = np.zeros(CACHE_WORDS * 2, bool)

    def lookup(self, words: list[str]) -> np.ndarray:
        get = self.places.get
        at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = list(dict.fromkeys(words[i] for i in missing))
            if self.count + len(new) > CACHE_WORDS:
                self.places.clear()
                self.count = 0
                new = list(dict.fromkeys(words))
                if len(new) > len(self.rows):
                    self.rows, self.letters = np.zeros((len(new), self.rows.shape[1]), np.float32), np.zeros(len(new), bool)
                missing = np.arange(len(words))
            end = self.count + len(new)
            if end > len(self.rows):
                self.rows, self.letters = np.resize(self.rows, (end, self.rows.shape[1])), np.resize(self.letters, end)
            self.rows[self.count : end] = scored(self.model["weights"], new)
            self.letters[self.count : end] = [any(map(str.isalpha, w)) for w in new]
            self.places.update(zip(new, range(self.count, end), strict=True))
            self.count = end
            at[missing] = np.fromiter((self.places[words[i]] for i in missing), np.int64, len(missing))
        return at

    def label(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Posteriors of all words of all texts, whether a word has a letter, and each word's text."""
        words: list[str] = []
        sizes, owner = [], []
        for text in texts:
            before = len(words)
            for line in text.lower().split("\n"):
                if line := line.split():
                    words += line
                    sizes.append(len(line))
            owner.append(len(words) - before)
        at = self.lookup(words)
        low, high, first, last = parts_of(np.array(sizes, np.int64))
        n = high - low
        starts = np.cumsum(n) - n
        # the words of all parts, part after part, and which of them are the part's own
        run = np.arange(n.sum()) - np.repeat(starts - low, n)
        own = (run >= np.repeat(first, n)) & (run < np.repeat(last, n))
        gamma, _, _ = forward_backward(self.rows[at[run]].astype(np.float64), starts, n, self.model["trans"], self.model["init"])
        return gamma[own], self.letters[at], np.repeat(np.arange(len(texts)), owner)


#: The labeller of the model last used in this Python worker, so that tasks share its words.
_LABELLER: list = [None, None]


def labeller_of(token: str, model: dict) -> Labeller:
    if _LABELLER[0] != token:
        _LABELLER[:] = [token, Labeller(model)]
    return _LABELLER[1]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict | None:
    return train(sample(docs, id_col, text_col, lang_col))


def identify(docs: DataFrame, model: dict | None, text_col: str = "text", segments: bool = False, keep_score: float | None = None) -> DataFrame:
    """docs with lang_pred and lang_score; segments adds lang_segments, the runs of equally labelled words.

    keep_score: leave out documents that are `und` or score less, with the columns of docs only."""
    extra = [("lang_pred", T.StringType()), ("lang_score", T.DoubleType())]
    run = T.StructType([T.StructField("lang", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    extra += [("lang_segments", T.ArrayType(run))] if segments else []
    shared, token = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def work(batches):
        labeller = labeller_of(token, shared.value) if shared.value else None
        names = np.array(shared.value["labels"]) if shared.value else None
        for batch in chunks(batches, text_col, TEXT_BYTES):
            texts = [(t or b"").decode("utf-8", "replace") for t in as_bytes(batch.column(text_col))]
            n = len(texts)
            pred, score, runs = np.full(n, "und", object), np.zeros(n), [[] for _ in texts]
            if labeller:
                gamma, letters, owner = labeller.label(texts)
                k = gamma.shape[1]
                mass = np.stack([np.bincount(owner[letters], gamma[letters, y], n) for y in range(k)], axis=1)
                total = mass.sum(axis=1)
                known = total > 0
                best = mass.argmax(axis=1)
                pred[known] = names[best[known]]
                score[known] = np.clip(mass[known, best[known]] / total[known], 0, 1)
                if segments:
                    y = gamma.argmax(axis=1)
                    first = np.searchsorted(owner, np.arange(n))
                    cut = np.flatnonzero(np.concatenate(([True], (y[1:] != y[:-1]) | (owner[1:] != owner[:-1])))) if len(y) else []
                    for s, e in zip(cut, [*cut[1:], len(y)], strict=True):
                        runs[owner[s]].append({"lang": names[y[s]], "start": int(s - first[owner[s]]), "end": int(e - first[owner[s]])})
            if keep_score is not None:
                yield batch.filter(pa.array((pred != "und") & (score >= keep_score)))
                continue
            new = {"lang_pred": pa.array(pred, pa.string()), "lang_score": pa.array(score, pa.float64())}
            if segments:
                new["lang_segments"] = pa.array(runs, pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
            yield with_columns(batch, new)

    return map_batches(docs, work, docs.schema if keep_score is not None else extended(docs, extra))


def held_out(id_col: str, folds: int) -> F.Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", held_out("doc_id", 5))
    model = fit(docs.where("not held_out"))
    return identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
