"""Language identification by unigrams of vocabulary pieces, summed over all segmentations.

Every language has a probability for each piece of a fixed public vocabulary (all its pieces, lower-cased).  The
probability of a word is the sum over all ways to cut it into pieces, by a forward pass over the whole word; a text's
score is the sum of the logarithms over its words.  Piece probabilities are learned by expectation maximisation (forward
and backward) on the word counts of a bounded sample, language by language on the executors: each language's texts are
drawn by a hash with the chance that makes ``SAMPLE_DOCS`` of them expected, and of those the ``SAMPLE_WORDS`` most frequent
words are taken.  Everything else covers whole texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinfold.llm._words import IntTable, WordMemo, bounded_batches, chunks, ship, text_slices
from twinfold.session import fits_broadcast

SAMPLE_DOCS = 400
SAMPLE_WORDS = 20_000
UNKNOWN = 1e-7
PRIOR = 0.02
ROUNDS = 4
#: Longer words (the mark of a word's start included) go alone and rescaled: their probability is below any double.
SHORT = 32
#: Characters of short words that are worked on at once.
BATCH_CHARS = 60_000
#: Languages whose document counts are broadcast (about 30 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 100_000
_BASE = np.uint64(0x100000001B3 * 2654435761 & 0xFFFFFFFFFFFFFFFF | 1)


class Lattice:
    """The pieces in a batch of words as edges between their character boundaries."""

    def __init__(self, lens: np.ndarray, start: np.ndarray, size: np.ndarray, piece: np.ndarray, place: np.ndarray):
        self.first = np.cumsum(lens + 1) - lens - 1
        self.last = self.first + lens
        self.nodes = int(lens.sum()) + len(lens)
        end, stop = start + size, place + size
        order = np.lexsort((end, stop))
        self.start, self.end, self.piece = start[order], end[order], piece[order]
        self.steps = int(lens.max(initial=0))
        self.bounds = np.searchsorted(stop[order], np.arange(1, self.steps + 2)).tolist()
        # edges that end in one node lie side by side; every node but a first has one, as single characters always count
        new = np.flatnonzero(np.diff(self.end, prepend=-1))
        self.into, self.runs = self.end[new], new
        self.cuts = np.searchsorted(new, self.bounds).tolist()

    def forward(self, prob: np.ndarray) -> np.ndarray:
        """``[node, language]``: the probability of all segmentations up to each boundary."""
        a = np.zeros((self.nodes, prob.shape[1]))
        a[self.first] = 1
        for i in range(self.steps):
            lo, hi = self.bounds[i], self.bounds[i + 1]
            x, y = self.cuts[i], self.cuts[i + 1]
            a[self.into[x:y]] = np.add.reduceat(a[self.start[lo:hi]] * prob[self.piece[lo:hi]], self.runs[x:y] - lo, axis=0)
        return a

    def backward(self, p: np.ndarray) -> np.ndarray:
        """``[node]``: the probability of all segmentations from each boundary on, for one language."""
        b = np.zeros(self.nodes)
        b[self.last] = 1
        for i in range(self.steps - 1, -1, -1):
            lo, hi = self.bounds[i], self.bounds[i + 1]
            np.add.at(b, self.start[lo:hi], p[self.piece[lo:hi]] * b[self.end[lo:hi]])
        return b


class Pieces:
    """The pieces of a SentencePiece vocabulary, found in many words at once."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        plain = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.pieces = sorted({p.lower() for p in plain})
        self.unknown = len(self.pieces)
        self.none = self.unknown + 1
        self.longest = max(map(len, self.pieces))
        index = {p: k for k, p in enumerate(self.pieces)}
        heads = sorted({p[:n] for p in self.pieces for n in range(1, len(p))} | set(index))
        longer = {p[:n] for p in self.pieces for n in range(1, len(p))}
        keys = np.array([self._hash(p) for p in heads], np.uint64)
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces share a hash")
        #: Of each start of a piece: twice its number (``none`` if it is no piece itself), and one more if a longer piece starts so.
        self.table = IntTable(keys, np.array([2 * index.get(p, self.none) + (p in longer) for p in heads], np.int64))

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def edges(self, text: str, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(character, length, piece)`` of every piece in ``text``, where ``left`` characters follow in the same word
        from each character on; a single character that is no piece is ``unknown``."""
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        at, h = np.arange(len(chars)), np.zeros(len(chars), np.uint64)
        out = []
        for n in range(1, self.longest + 1):
            inside = left[at] >= n
            at, h = at[inside], h[inside]
            if not len(at):
                break
            h = h * _BASE + chars[at + (n - 1)]
            found = self.table.find(h)
            piece = np.where(found < 0, self.none, found >> 1)
            if n == 1:
                piece[piece == self.none] = self.unknown
            some = np.flatnonzero(piece != self.none)
            out.append((at[some], np.full(len(some), n), piece[some]))
            more = (found >= 0) & (found & 1 == 1)
            at, h = at[more], h[more]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def lattice(self, words: Sequence[str]) -> Lattice:
        lens = np.fromiter(map(len, words), np.int64, len(words))
        owner = np.repeat(np.arange(len(words)), lens)
        place = np.arange(len(owner)) - (np.cumsum(lens) - lens)[owner]
        at, size, piece = self.edges("".join(words), lens[owner] - place)
        return Lattice(lens, at + owner[at], size, piece, place[at])

    def log_probabilities(self, words: Sequence[str], prob: np.ndarray) -> np.ndarray:
        """``[word, language]``: the logarithm of each word's probability."""
        out = np.zeros((len(words), prob.shape[1]))
        sizes = [len(w) for w in words]
        order = np.argsort(sizes, kind="stable")
        short = order[: int(np.searchsorted(np.array(sizes)[order], SHORT, "right"))]
        for lo, hi in chunks([sizes[k] + 1 for k in short], BATCH_CHARS):
            some = short[lo:hi]
            grid = self.lattice([words[k] for k in some])
            out[some] = np.log(grid.forward(prob)[grid.last])
        for k in order[len(short) :].tolist():
            out[k] = self._long(words[k], prob)
        return out

    def _long(self, word: str, prob: np.ndarray) -> np.ndarray:
        """The same for one word of any length: only the positions that a piece can still reach are held."""
        reach, total = self.longest, len(word)
        held = np.zeros((reach + 1, prob.shape[1]))  # of the next positions, divided by exp(scale)
        held[0] = 1
        scale = np.zeros(prob.shape[1])
        for begin in range(0, total, 4096):
            part = word[begin : begin + 4096 + reach]
            at, size, piece = self.edges(part, len(part) - np.arange(len(part)))
            order = np.argsort(at, kind="stable")
            at, size, p = at[order], size[order], prob[piece[order]]
            cuts = np.searchsorted(at, np.arange(min(4096, total - begin) + 1)).tolist()
            for s, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                held[size[lo:hi]] += held[0] * p[lo:hi]
                held[:-1] = held[1:]
                held[-1] = 0
                if s % 8 == 7:
                    most = held.max(0)
                    held /= most
                    scale += np.log(most)
        return scale + np.log(held[0])

    def expected(self, words: Sequence[str], counts: np.ndarray) -> ExpectedCounts:
        return ExpectedCounts(self, words, counts)


class ExpectedCounts:
    """Expected piece counts of the words of one language; their lattices are built once."""

    def __init__(self, own: Pieces, words: Sequence[str], counts: np.ndarray):
        self.size = own.none + 1
        short = sorted((k for k, w in enumerate(words) if len(w) <= SHORT), key=lambda k: len(words[k]))
        self.short = []
        for lo, hi in chunks([len(words[k]) + 1 for k in short], BATCH_CHARS):
            some = short[lo:hi]
            grid = own.lattice([words[k] for k in some])
            self.short.append((grid, np.repeat(counts[some], [len(words[k]) + 1 for k in some]), np.repeat(grid.last, [len(words[k]) + 1 for k in some])))
        self.long = []
        for k, w in enumerate(words):
            if len(w) > SHORT:
                at, size, piece = own.edges(w, len(w) - np.arange(len(w)))
                order = np.lexsort((size, at))
                self.long.append((len(w), at[order], at[order] + size[order], piece[order], counts[k]))

    def __call__(self, p: np.ndarray) -> np.ndarray:
        total = np.zeros(self.size)
        for grid, count, last in self.short:
            a, b = grid.forward(p[:, None])[:, 0], grid.backward(p)
            weight = count / np.maximum(a[last], 1e-300)
            total += np.bincount(grid.piece, a[grid.start] * p[grid.piece] * b[grid.end] * weight[grid.start], self.size)
        log_p = np.log(np.maximum(p, 1e-300))
        for n, start, end, piece, count in self.long:
            a, b = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
            a[0] = b[n] = 0.0
            by_end = np.argsort(end, kind="stable")
            cuts = np.searchsorted(end[by_end], np.arange(n + 2)).tolist()
            for i in range(1, n + 1):
                e = by_end[cuts[i] : cuts[i + 1]]
                a[i] = np.logaddexp.reduce(a[start[e]] + log_p[piece[e]])
            cuts = np.searchsorted(start, np.arange(n + 1)).tolist()
            for i in range(n - 1, -1, -1):
                e = slice(cuts[i], cuts[i + 1])
                b[i] = np.logaddexp.reduce(b[end[e]] + log_p[piece[e]])
            total += count * np.bincount(piece, np.exp(a[start] + log_p[piece] + b[end] - a[n]), self.size)
        return total


_PIECES: dict[bytes, Pieces] = {}


def pieces(model: bytes) -> Pieces:
    """One vocabulary a Python worker."""
    if model not in _PIECES:
        _PIECES.clear()
        _PIECES[model] = Pieces(model)
    return _PIECES[model]


def words_of(text: str | None) -> list[str]:
    """The words of a text, for learning and prediction alike."""
    return (text or "").lower().split()


def marked(word: str) -> str:
    return "▁" + word


def has_letter(word: str) -> bool:
    return word.isalpha() or any(map(str.isalpha, word))


def learn(counts: dict[str, int], own: Pieces, rounds: int = ROUNDS) -> np.ndarray:
    """The probability of every piece (then of an unknown character, then 0) from one language's word counts."""
    p = np.zeros(own.none + 1)
    p[: own.unknown] = 1 / own.unknown
    p[own.unknown] = UNKNOWN
    words = sorted(counts)
    if words:
        expected = own.expected([marked(w) for w in words], np.array([counts[w] for w in words], float))
        for _ in range(rounds):
            c = expected(p)[: own.unknown] + PRIOR
            p[: own.unknown] = c / c.sum()
    return p


class Scorer:
    """Scores whole texts under every language; of languages that score alike the first in order is named."""

    def __init__(self, langs: list[str], prob: np.ndarray, own: Pieces):
        self.langs, self.prob, self.own = langs, prob, own
        self.width = len(langs) + 1
        self.memo = WordMemo(self.fill, min(100_000, max(20_000, 40_000_000 // (8 * self.width))))

    def fill(self, words: Sequence[str]) -> list[bytes]:
        """For each word the logarithm of its probability by language, and 1 if it has a letter; else all are 0."""
        out = np.zeros((len(words), self.width))
        some = [k for k, w in enumerate(words) if has_letter(w)]
        out[some, :-1] = self.own.log_probabilities([marked(words[k]) for k in some], self.prob)
        out[some, -1] = 1
        data, step = out.tobytes(), 8 * self.width
        return [data[k : k + step] for k in range(0, len(data), step)]

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], list[float]]:
        """Language and posterior probability of every whole text; ``und`` and 0 where it has no letter."""
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        labels, scores = [], []
        for a, b in chunks([len(t or "") for t in texts], 1_000_000):
            words = [words_of(t) for t in texts[a:b]]
            of = self.memo.look_up(words)
            for ws in words:
                total = np.frombuffer(b"".join([of[w] for w in ws])).reshape(-1, self.width).sum(0)
                if total[-1] == 0:
                    labels.append("und")
                    scores.append(0.0)
                    continue
                best = int(np.argmax(total[:-1]))
                labels.append(self.langs[best])
                scores.append(float(1 / np.exp(np.maximum(total[:-1] - total[best], -700)).sum()))
        return labels, scores


def sample_words(labelled: DataFrame, docs: int = SAMPLE_DOCS, words: int = SAMPLE_WORDS) -> DataFrame:
    """``(lang, word, n)`` of a bounded sample of ``labelled(text, lang)``.

    A language of n rows gives each of its distinct texts the chance ``docs / n`` by a hash of the text, so about
    ``docs`` are expected and no row has to be ranked; copies count once.  Counts of languages are broadcast if few.
    """
    named = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    sizes = named.groupBy("lang").agg(F.count("*").alias("rows"))
    if fits_broadcast(sizes, BROADCAST_ROWS):
        sizes = F.broadcast(sizes)
    digest = F.xxhash64("text")
    chance = F.pmod(digest, F.lit(1 << 30)) < F.lit(docs * (1 << 30)) / F.col("rows")
    texts = named.join(sizes, "lang").where(chance).select("lang", "text", digest.alias("digest"), F.length("text").alias("size")).dropDuplicates(["lang", "digest", "size"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, slice_ in text_slices(batch, 1):
                found = Counter((lang, w) for lang, t in zip(batch.column(0).slice(a, b - a).to_pylist(), slice_, strict=True) for w in words_of(t))
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])

    found = texts.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # Spark keeps each partition's first before the shuffle by language
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    return found.withColumn("_turn", F.row_number().over(best)).where(F.col("_turn") <= words).drop("_turn")


def fit(labelled: DataFrame, model) -> tuple[list[str], np.ndarray]:
    """Languages in order and ``[piece, language]`` probabilities; each language is learned by a task of its own."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        p = learn(dict(zip(rows["word"], rows["n"], strict=True)), pieces(model.value))
        return pd.DataFrame({"lang": [key[0]], "p": [p.tobytes()]})

    learned = sample_words(labelled).groupBy("lang").applyInPandas(one, "lang string, p binary").collect()  # a row a language
    learned = sorted((r["lang"], np.frombuffer(bytes(r["p"]))) for r in learned) if learned else []
    return [lang for lang, _ in learned], np.stack([p for _, p in learned], 1) if learned else np.zeros((1, 0))


def in_fold(doc_id: Column) -> Column:
    """True for held-out documents: crc32 of the id as text leaves 1 of 3; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def predict_languages(docs: DataFrame, labelled: DataFrame, model_file: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_lang`` and ``_score`` learned from ``labelled(text, lang)``; all columns stay.

    Words of any length are scored whole.  Of languages with the same score the first by name is taken.
    """
    spark = bounded_batches(docs.sparkSession)
    model = ship(spark, model_file)
    learned = spark.sparkContext.broadcast(fit(labelled, model))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*learned.value, pieces(model.value))
        for batch in batches:
            for a, b, texts in text_slices(batch, at):
                labels, scores = scorer.predict(texts)
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "_lang", "_score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("_lang", T.StringType()), T.StructField("_score", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def _labelled(docs: DataFrame) -> DataFrame:
    return docs.where(~in_fold(F.col("doc_id").cast("long"))).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))


def language_digests(docs: DataFrame, model_file: str) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row of ``docs(doc_id, text, lang)``.

    Learns from rows with a text and a language whose fold is not held out.  Null texts and texts without a letter are
    ``und`` with score 0; so is every row if there is nothing to learn from.  Of languages that score alike the first by
    name is given.  Words and texts of any length are scored whole.  Repeated rows give repeated results, other columns
    are not read; an empty table gives no rows.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = predict_languages(narrow, _labelled(docs), model_file)
    return out.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


def keep_identified(docs: DataFrame, model_file: str, least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose text has a language at ``least`` that probable; columns stay as they are.

    Null texts and texts without a letter go; repeated rows are judged alike; columns of ``docs`` may have any name.
    """
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # no name of docs can clash with the new columns
    out = predict_languages(plain, _labelled(docs), model_file, f"c{docs.columns.index('text')}")
    return out.where((F.col("_lang") != "und") & (F.col("_score") >= least)).select(*plain.columns).toDF(*docs.columns)
