"""Language identification by unigram piece models, marginalised over segmentations.

The pieces are those of a fixed public vocabulary (piece_bpe_32k.model), in lower case, letters only, with the mark of a word's
start. A language is a probability for each piece; a word's probability is the sum, over all ways to cut it into pieces, of
the product of theirs, by the forward algorithm; a text's is the product over its words. Piece probabilities are learned by
expectation maximisation with the forward and backward sums, on a sample of at most SAMPLE labelled documents of each
language (those with the smallest hash of their key; rows whose hash is far above where the sample must end are left out
before they are ranked, so a language isn't ranked in one task), and of those documents' words the VOCABULARY commonest of up
to LONG letters, so that what reaches the driver is bounded. Everything else reads every text whole.

Words are runs of letters in lower case, of any length: those of up to LONG letters are summed many at a time, longer ones one
by one with a sliding window of the longest piece, and rescaled on the way; the sums are the same. The score is the posterior
probability of the predicted language under equal priors.

A background model of single letters, with their frequencies in all labelled words, stands for what is no learned language:
keep_known rejects a text that it explains better than each of them.

Defined results: a null text, or one without a letter, is "und" with score 0; so is everything when nothing is labelled; rows
without a key are scored, not learned from; repeated rows each get a row; an empty table gives an empty result; further
columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Documents, and their distinct words, that a language is learned from; letters from which a word is long; words summed together.
SAMPLE, VOCABULARY, LONG, TOGETHER = 400, 60_000, 32, 20_000
ROUNDS = 4
#: Of a letter that no piece covers, and the least of a piece.
UNKNOWN, FLOOR = 1e-7, 1e-8
START = "▁"
WORD = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def pieces(path: str | None = None) -> list[str]:
    import public_tokenizers
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    found = {p.id_to_piece(i).lower() for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))}
    return sorted(x for x in found if (x.lstrip(START).isalpha() or x == START) and x.rfind(START) <= 0)


class Lattice:
    """Which pieces lie where in words."""

    def __init__(self, vocabulary: list[str]):
        codes = [self._codes([x], len(x))[0] for x in vocabulary]
        hashes = np.array([self._hash(c) for c in codes], np.uint64)
        order = np.argsort(hashes)
        self.keys, self.ids, self.size = hashes[order], order.astype(np.int32), len(vocabulary)
        self.longest = max(map(len, vocabulary), default=1)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.keys >> np.uint64(44)] = True

    @staticmethod
    def _codes(words: list[str], width: int) -> np.ndarray:
        return np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(len(words), width).astype(np.uint64)

    @staticmethod
    def _hash(codes: np.ndarray) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for c in codes:
            h = h * _BASE + c
        return Lattice._mix(h)[0]

    @staticmethod
    def _mix(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(31))

    def arcs(self, words: list[str]) -> tuple[list[tuple[int, int, np.ndarray, np.ndarray]], np.ndarray]:
        """Arcs (start, end, the words that have it, its piece; size for an unknown letter), by end; the words' lengths."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        width = int(lengths.max(initial=1))
        codes = self._codes(words, width)
        found = []
        for start in range(width):
            h = np.zeros(len(words), np.uint64)
            for end in range(start + 1, min(start + self.longest, width) + 1):
                h = h * _BASE + codes[:, end - 1]
                mixed = self._mix(h)
                at = np.flatnonzero(self.maybe[mixed >> np.uint64(44)] & (lengths >= end))
                if len(at):
                    place = np.minimum(np.searchsorted(self.keys, mixed[at]), len(self.keys) - 1)
                    real = self.keys[place] == mixed[at]
                    at, ids = at[real], self.ids[place[real]]
                else:
                    ids = np.zeros(0, np.int32)
                if end == start + 1:  # every letter can stand alone
                    rest = np.setdiff1d(np.flatnonzero(lengths >= end), at, assume_unique=True)
                    at, ids = np.concatenate([at, rest]), np.concatenate([ids, np.full(len(rest), self.size, np.int32)])
                if len(at):
                    found.append((start, end, at, ids))
        return sorted(found, key=lambda a: a[1]), lengths

    def long(self, word: str, p: np.ndarray) -> np.ndarray:
        """The logarithm of a word's probability in each language, for a word of any length."""
        codes = self._codes([word], len(word))[0]
        n = len(codes)
        h, ends, starts, ids = np.zeros(n, np.uint64), [], [], []
        for size in range(1, min(self.longest, n) + 1):  # hashes of the pieces of this size from each place
            h = h[: n - size + 1] * _BASE + codes[size - 1 :]
            mixed = self._mix(h)
            at = np.flatnonzero(self.maybe[mixed >> np.uint64(44)])
            place = np.minimum(np.searchsorted(self.keys, mixed[at]), len(self.keys) - 1)
            real = self.keys[place] == mixed[at]
            at, own = at[real], self.ids[place[real]]
            if size == 1:
                rest = np.setdiff1d(np.arange(n), at, assume_unique=True)
                at, own = np.concatenate([at, rest]), np.concatenate([own, np.full(len(rest), self.size, np.int32)])
            starts.append(at)
            ends.append(at + size)
            ids.append(own)
        end, start, piece = np.concatenate(ends), np.concatenate(starts), np.concatenate(ids)
        order = np.argsort(end, kind="stable")
        start, piece = start[order].tolist(), piece[order]
        first = np.searchsorted(end[order], np.arange(n + 2)).tolist()
        shares = p[piece]
        log, window = np.zeros(p.shape[1]), {0: np.ones(p.shape[1])}
        for at in range(1, n + 1):
            total = np.zeros(p.shape[1])
            for k in range(first[at], first[at + 1]):
                total += window[start[k]] * shares[k]
            window[at] = total
            window.pop(at - self.longest, None)
            if (total < 1e-100).any():
                scale = np.maximum(np.max(list(window.values()), axis=0), 1e-300)
                for x in window:
                    window[x] = window[x] / scale
                log += np.log(scale)
        return log + np.log(np.maximum(window[n], 1e-300))


def forward(arcs: list, lengths: np.ndarray, p: np.ndarray) -> np.ndarray:
    """alpha[position, word, language]; p: probabilities by piece and language."""
    alpha = np.zeros((int(lengths.max(initial=1)) + 1, len(lengths), p.shape[1]))
    alpha[0] = 1
    for start, end, at, ids in arcs:
        alpha[end, at] += alpha[start, at] * p[ids]
    return alpha


def learn(lattice: Lattice, counts: dict[str, int]) -> np.ndarray:
    """A language's piece probabilities, the unknown letter's last, from its words' counts."""
    p = np.full((lattice.size + 1, 1), 1 / max(lattice.size, 1))
    p[-1] = UNKNOWN
    if not counts:
        return p
    words = sorted(w for w in counts if len(w) <= LONG)
    weight = np.array([counts[w] for w in words], float)
    arcs, lengths = lattice.arcs(words)
    for _ in range(ROUNDS):
        alpha = forward(arcs, lengths, p)
        beta = np.zeros_like(alpha)
        beta[lengths, np.arange(len(words))] = 1
        total = alpha[lengths, np.arange(len(words)), 0]
        seen = np.zeros(lattice.size + 1)
        for start, end, at, ids in reversed(sorted(arcs, key=lambda a: a[0])):
            out = p[ids] * beta[end, at]
            beta[start, at] += out
            np.add.at(seen, ids, (alpha[start, at] * out)[:, 0] / total[at] * weight[at])
        p[:-1, 0] = np.maximum(seen[:-1] / max(seen[:-1].sum(), 1e-300), FLOOR)
    return p


def letters(lattice: Lattice, vocabulary: list[str], counts: dict[str, int]) -> np.ndarray:
    """The background: probabilities of single letters and the start mark alone, from words' counts."""
    p = np.full((lattice.size + 1, 1), 1e-300)
    p[-1] = UNKNOWN
    seen: dict[str, int] = {}
    for w, n in counts.items():
        for c in w:
            seen[c] = seen.get(c, 0) + n
    total = max(sum(seen.values()), 1)
    for i, x in enumerate(vocabulary):
        if len(x) == 1:
            p[i] = max(seen.get(x, 0) / total, FLOOR)
    return p


def words_of(text: str) -> list[str]:
    """The words, each with the start mark."""
    found = (w if w.isalpha() else "".join(c for c in w if c.isalpha()) for w in WORD.findall(text.lower()))
    return [START + w for w in found if w]


class Model:
    """Languages, and the pieces' probabilities in each; the background is the last column."""

    def __init__(self, langs: list[str], vocabulary: list[str], p: np.ndarray):
        self.langs, self.lattice, self.p = langs, Lattice(vocabulary), p

    def logs(self, words: list[str]) -> np.ndarray:
        """The logarithm of each word's probability in each language and the background."""
        out = np.zeros((len(words), self.p.shape[1]))
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        at = 0
        while at < len(order) and len(words[order[at]]) <= LONG:  # words of about one length together, in bounded memory
            own = [i for i in order[at : at + TOGETHER] if len(words[i]) <= LONG]
            arcs, lengths = self.lattice.arcs([words[i] for i in own])
            out[own] = np.log(np.maximum(forward(arcs, lengths, self.p)[lengths, np.arange(len(own))], 1e-300))
            at += len(own)
        for i in order[at:]:
            out[i] = self.lattice.long(words[i], self.p)
        return out

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Of each text the language, its posterior probability, and whether the language explains it no worse than the background."""
        index: dict[str, int] = {}
        place = index.setdefault
        ids = [[place(w, len(index)) for w in words_of(t)] if t else [] for t in texts]
        if not index or not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        logs = self.logs(list(index))
        langs, scores, known = [], np.zeros(len(texts)), np.zeros(len(texts), bool)
        for k, own in enumerate(ids):
            if not own:
                langs.append("und")
                continue
            *total, background = logs[own].sum(axis=0)
            total = np.array(total)
            best = int(total.argmax())
            scores[k], known[k] = 1 / np.exp(total - total[best]).sum(), total[best] >= background
            langs.append(self.langs[best])
        return langs, scores, known


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, vocabulary: str | None = None) -> Model:
    """From the labelled rows that aren't held out; no more than sample documents a language reach the count of words, and VOCABULARY words a language the driver."""
    known = docs.select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(text).alias("text")).filter(F.col("lang").isNotNull() & F.col("k").isNotNull() & ~held_out("k"))
    known = known.withColumn("h", F.pmod(F.xxhash64("k"), F.lit(1 << 30)))
    ends = {r["lang"]: min(1 << 30, (4 * sample << 30) // r["n"] + 1) for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # as many as the model has columns
    end = F.create_map(*[F.lit(x) for pair in ends.items() for x in pair])[F.col("lang")] if ends else F.lit(0)
    order = F.row_number().over(Window.partitionBy("lang").orderBy("h", "k"))
    keys = known.filter(F.col("h") < end).select("k", "lang", "h").withColumn("n", order).filter(F.col("n") <= sample).select("k", "lang").distinct()
    chosen = known.join(F.broadcast(keys), ["k", "lang"])  # at most sample keys a language

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import Counter

        for df in batches:
            found = Counter((x, w) for x, t in zip(df["lang"], df["text"], strict=True) if t for w in words_of(t) if len(w) <= LONG)
            yield pd.DataFrame([(x, w, n) for (x, w), n in found.items()], columns=["lang", "word", "n"])

    words = chosen.select("lang", "text").mapInPandas(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rows = words.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).filter(F.col("at") <= VOCABULARY).collect()
    by: dict[str, dict[str, int]] = {}
    for r in rows:
        by.setdefault(r["lang"], {})[r["word"]] = r["n"]
    langs, names = sorted(by), pieces(vocabulary)
    lattice = Lattice(names)
    pooled: dict[str, int] = {}
    for counts in by.values():
        for w, n in counts.items():
            pooled[w] = pooled.get(w, 0) + n
    return Model(langs, names, np.concatenate([*(learn(lattice, by[x]) for x in langs), letters(lattice, names, pooled)], axis=1))


def held_out(key: str):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with __lang, __score and __known, from the text alone."""
    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.p, model.lattice))  # the vocabulary times the languages

    @F.pandas_udf(StructType([StructField("lang", StringType()), StructField("score", DoubleType()), StructField("known", BooleanType())]))
    def run(texts: pd.Series) -> pd.DataFrame:
        m = Model.__new__(Model)
        m.langs, m.p, m.lattice = shared.value
        langs, scores, known = m.score([t if isinstance(t, str) else None for t in texts])
        return pd.DataFrame({"lang": langs, "score": scores, "known": known})

    return docs.withColumn("__p", run(F.col(text))).withColumns({f"__{x}": F.col(f"__p.{x}") for x in ("lang", "score", "known")}).drop("__p")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    df = predict(docs.select("doc_id", "text"), fit(docs))
    return df.select("doc_id", held_out("doc_id").alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text a learned language explains no worse than the background; all rows if no language can be learned."""
    model = fit(docs)
    if not model.langs:
        return docs
    return predict(docs, model).filter(F.col("__known")).drop("__lang", "__score", "__known")
