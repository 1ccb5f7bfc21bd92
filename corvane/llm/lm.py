"""Language-model scores: marginal likelihood of a text over all subword segmentations.

A text is its words (maximal runs outside {0x20, 0x09-0x0D}, A-Z lower-cased) and an end. Each word, behind a word mark, is
a lattice of the pieces of an existing public vocabulary; characters outside it go by byte pieces, and a word seen in
training is one more piece of its own lattice. The vocabulary's own scores start the piece probabilities and
expectation-maximisation over all training words refines them. A word's probability is the sum over all its segmentations, by
a forward recursion in log space; a text's is the product over its words and the end.

The weights: with N training tokens, a word seen c times has weight (c - D) / N as a piece of its own, and D / N of each
of the V distinct words is left to spelling, D being n1 / (n1 + 2 n2) for n1 and n2 words seen once and twice (absolute
discounting). As each distinct word leaves the same D to spelling, expectation-maximisation counts each distinct word once.
Piece probabilities and the word end, which closes a spelled word, sum to 1, so all texts together have probability 1 at most.

Word counts go over all training texts. Documents are dealt into buckets; each bucket asks for each of its distinct words
once, so a frequent word reaches a reducer once per bucket and never once per occurrence, and at most GROUPED buckets of a
word meet in one row.

Defined cases: null text is empty and has the end alone; null ids are in neither fold (not learned from, not held out);
without training texts the pieces keep the vocabulary's scores and no token is known; repeated rows are scored each;
an empty table gives an empty table; other columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise, small_batches, tidied
from .words import hash_words, hashed_texts, inverse, mix, powers, text_pieces

MARK = "▁"
EM_ROUNDS = 3
ALPHA = 0.05
BUCKET_BYTES = 16 << 20
#: Words that a task sums over at once.
AT_ONCE = 1 << 17
#: Buckets that ask for a word in one row.
GROUPED = 4096
LEADING_BITS = 20
_BASE = 0x9E6C63D0876A9A47 | 1
_LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 256))


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece file, control pieces left out; byte pieces are `<0xNN>`."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size()) if not m.is_control(i) and not m.is_unknown(i)]


#: Words of more characters are summed one at a time, all places of a piece length at once.
LONG_WORD = 512


class Lattice:
    """Pieces with probabilities, and the sums over all segmentations of many words at a time."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.texts = [p for p, _ in vocabulary]
        scores = np.array([s for _, s in vocabulary], float)
        # A negative score is a merge rank here: rank r starts with weight 1 / (r + 1); byte pieces start low.
        weight = 1 / (1 + np.abs(scores))
        self.bytes = np.full(256, -1)
        plain: list[int] = []
        for i, p in enumerate(self.texts):
            b = _byte_of(p)
            if b is None:
                plain.append(i)
            else:
                self.bytes[b] = i
                weight[i] = 1e-6
        if (self.bytes < 0).any():
            missing = np.flatnonzero(self.bytes < 0)
            self.bytes[missing] = len(self.texts) + np.arange(len(missing))
            self.texts += [f"<0x{b:02X}>" for b in missing]
            weight = np.r_[weight, np.full(len(missing), 1e-6)]
        self.longest = max((len(self.texts[i]) for i in plain), default=0)
        hashes = np.array([_hash_text(self.texts[i]) for i in plain], np.uint64)
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], np.array(plain, np.int64)[order]
        # The leading bits of a hash tell where its keys begin; most runs of characters are no piece and have none.
        lead, at, run = np.unique(self.keys >> np.uint64(64 - LEADING_BITS), return_index=True, return_counts=True)
        self.begins = np.full(1 << LEADING_BITS, -1, np.int32)
        self.begins[lead] = at
        self.deepest = int(run.max()) if len(run) else 0
        self.set_weights(weight, weight.sum() / 4)

    def set_weights(self, weight: np.ndarray, end: float) -> None:
        """Weights of the pieces and of the word end; their probabilities sum to 1."""
        total = weight.sum() + end
        self.log_p = np.log(weight / total)
        self.log_end = math.log(end / total)

    def _edges(self, codes: np.ndarray) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For each end position of equally long words (rows of code points): (start, rows, piece)."""
        n, length = codes.shape
        p = powers(_BASE, length + 1)
        sums = np.zeros((length + 1, n), np.uint64)
        np.cumsum((mix(codes.T) * p[:length, None]), axis=0, out=sums[1:])
        back = powers(inverse(_BASE), length + 1)
        out = []
        for j in range(1, length + 1):
            here = []
            for i in range(max(0, j - self.longest), j):
                h = mix((sums[j] - sums[i]) * back[i])
                begins = self.begins.take((h >> np.uint64(64 - LEADING_BITS)).view(np.int64))
                rows = np.flatnonzero(begins >= 0)
                if not len(rows):
                    continue
                at, h = begins[rows], h[rows]
                for _ in range(self.deepest - 1):
                    at = np.where(self.keys.take(at) < h, np.minimum(at + 1, len(self.keys) - 1), at)
                piece = self.keys.take(at) == h
                if piece.any():
                    here.append((i, rows[piece], self.ids.take(at[piece])))
            out.append(here)
        return out

    def _fallback(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
        """Log probability of each character by its byte pieces; the number of each character, and the pieces of each number."""
        distinct, at = np.unique(codes, return_inverse=True)
        parts = [[int(self.bytes[b]) for b in chr(c).encode("utf-8", "replace")] for c in distinct.tolist()]
        return np.array([sum(self.log_p[x] for x in xs) for xs in parts])[at].reshape(codes.shape), at.reshape(codes.shape), parts

    def _forward(self, codes: np.ndarray, edges: list, spelled: np.ndarray) -> np.ndarray:
        n, length = codes.shape
        alpha = np.full((length + 1, n), -np.inf)
        alpha[0] = 0
        for j in range(1, length + 1):
            alpha[j] = alpha[j - 1] + spelled[:, j - 1]
            for i, rows, piece in edges[j - 1]:
                alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + self.log_p[piece])
        return alpha

    def _long_edges(self, codes: np.ndarray) -> tuple[list[int], np.ndarray, list[int]]:
        """The pieces of one long word by where they end: their starts, ids, and for each end the first of them. All places of a length at once."""
        length = len(codes)
        p, back = powers(_BASE, length + 1), powers(inverse(_BASE), length + 1)
        sums = np.zeros(length + 1, np.uint64)
        np.cumsum(mix(codes) * p[:length], out=sums[1:])
        starts, ends, pieces = [], [], []
        for n in range(1, min(self.longest, length) + 1):
            h = mix((sums[n:] - sums[:-n]) * back[: length - n + 1])
            begins = self.begins.take((h >> np.uint64(64 - LEADING_BITS)).view(np.int64))
            rows = np.flatnonzero(begins >= 0)
            at, h = begins[rows], h[rows]
            for _ in range(self.deepest - 1):
                at = np.where(self.keys.take(at) < h, np.minimum(at + 1, len(self.keys) - 1), at)
            piece = self.keys.take(at) == h
            starts.append(rows[piece])
            ends.append(rows[piece] + n)
            pieces.append(self.ids.take(at[piece]))
        start, end, piece = (np.concatenate(x) for x in (starts, ends, pieces))
        order = np.lexsort((start, end))
        return start[order].tolist(), piece[order], np.searchsorted(end[order], np.arange(1, length + 2)).tolist()

    def _long_forward(self, spelled: list[float], starts: list[int], log_p: list[float], first: list[int]) -> list[float]:
        alpha = [0.0]
        for j, by_bytes in enumerate(spelled):
            x = alpha[j] + by_bytes
            for e in range(first[j], first[j + 1]):
                x = _log_sum(x, alpha[starts[e]] + log_p[e])
            alpha.append(x)
        return alpha

    def _long_expected(self, codes: np.ndarray, count: float, out: np.ndarray) -> None:
        """Adds the expected uses of each piece in one long word."""
        spelled, at, parts = self._fallback(codes[None, :])
        starts, pieces, first = self._long_edges(codes)
        said, log_p = spelled[0].tolist(), self.log_p[pieces].tolist()
        alpha = self._long_forward(said, starts, log_p, first)
        length = len(codes)
        beta = [-math.inf] * length + [math.log(count) - alpha[length]]
        uses, by_bytes = np.zeros(len(pieces)), np.zeros(length)
        for j in range(length, 0, -1):
            spelt = beta[j] + said[j - 1]
            beta[j - 1] = _log_sum(beta[j - 1], spelt)
            by_bytes[j - 1] = math.exp(alpha[j - 1] + spelt)
            for e in range(first[j - 1], first[j]):
                i, through = starts[e], beta[j] + log_p[e]
                uses[e] = math.exp(alpha[i] + through)
                beta[i] = _log_sum(beta[i], through)
        out += np.bincount(pieces, uses, len(out))
        for xs, n in zip(parts, np.bincount(at[0], by_bytes, len(parts)).tolist(), strict=True):
            for x in xs:
                out[x] += n

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """Natural log of each word's marginal probability: all its segmentations, and the word end."""
        out = np.zeros(len(words))
        for rows, codes in _by_length(words):
            if codes.shape[1] > LONG_WORD:
                for row, word in zip(rows.tolist(), codes, strict=True):
                    starts, pieces, first = self._long_edges(word)
                    out[row] = self._long_forward(self._fallback(word[None, :])[0][0].tolist(), starts, self.log_p[pieces].tolist(), first)[-1] + self.log_end
                continue
            spelled, _, _ = self._fallback(codes)
            out[rows] = self._forward(codes, self._edges(codes), spelled)[-1] + self.log_end
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in all segmentations of the words, times their counts."""
        out = np.zeros(len(self.texts))
        for rows, codes in _by_length(words):
            if codes.shape[1] > LONG_WORD:
                for row, word in zip(rows.tolist(), codes, strict=True):
                    self._long_expected(word, float(counts[row]), out)
                continue
            spelled, at, parts = self._fallback(codes)
            edges = self._edges(codes)
            alpha = self._forward(codes, edges, spelled)
            beta = np.full_like(alpha, -np.inf)
            length = codes.shape[1]
            beta[length] = np.log(counts[rows]) - alpha[length]
            used, uses = [], []
            by_char = np.zeros(len(parts))
            for j in range(length, 0, -1):
                by_bytes = beta[j] + spelled[:, j - 1]
                beta[j - 1] = np.logaddexp(beta[j - 1], by_bytes)
                by_char += np.bincount(at[:, j - 1], np.exp(alpha[j - 1] + by_bytes), len(parts))
                for i, r, piece in edges[j - 1]:
                    through = beta[j, r] + self.log_p[piece]
                    used.append(piece)
                    uses.append(np.exp(alpha[i, r] + through))
                    beta[i, r] = np.logaddexp(beta[i, r], through)
            if used:
                out += np.bincount(np.concatenate(used), np.concatenate(uses), len(out))
            for xs, n in zip(parts, by_char.tolist(), strict=True):
                for x in xs:
                    out[x] += n
        return out


def _log_sum(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def _byte_of(piece: str) -> int | None:
    return int(piece[3:5], 16) if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">") else None


def _hash_text(text: str) -> int:
    codes = np.array([ord(c) for c in text], np.uint64)
    return int(mix(np.array([(mix(codes) * powers(_BASE, len(codes))).sum(dtype=np.uint64)]))[0])


def _by_length(words: list[str], block: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and code points (behind the mark) of equally long words, in blocks of bounded size."""
    lengths = np.array([len(w) for w in words])
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        length = int(lengths[order[at]])
        to = min(int(np.searchsorted(lengths[order], length, "right")), at + max(1, block // (length + 1)))
        rows = order[at:to]
        codes = np.frombuffer("".join(MARK + words[i] for i in rows).encode("utf-32-le"), np.uint32).reshape(len(rows), length + 1)
        yield rows, codes.astype(np.uint64)
        at = to


_ROW = "bucket int, word string, c bigint"
#: Classes of unseen words in class_score.
BINS = 24


def bucketed(docs: DataFrame, id_col: str, text_col: str, learn) -> tuple[DataFrame, int]:
    """(bucket, id, learn, text) with about BUCKET_BYTES of text a bucket."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0
    n = max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(size / BUCKET_BYTES))
    chosen = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.coalesce(learn, F.lit(False)).alias("learn"), text.alias("text"))
    return chosen.select(F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int").alias("bucket"), "id", "learn", "text"), n


def _bucket_words(key: tuple, got: pa.Table) -> pa.Table:
    """The distinct words of a bucket with their counts in its training texts."""
    learn = got.column("learn").combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
    hashes, counts, words = [], [], []
    for lo, hi, data, offsets in text_pieces(got.column("text")):
        h, starts, ends = hash_words(data, True, offsets[1:-1])
        per_doc = np.diff(np.searchsorted(starts, offsets))
        distinct, first, at = np.unique(h, return_index=True, return_inverse=True)
        hashes.append(distinct)
        counts.append(np.bincount(at, np.repeat(learn[lo:hi], per_doc), len(distinct)).astype(np.int64))
        raw = data.tobytes().translate(_LOWER)
        words += [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    if not words:
        return pa.table({"bucket": pa.array([], pa.int32()), "word": pa.array([], pa.string()), "c": pa.array([], pa.int64())})
    _, first, at = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    c = np.bincount(at, np.concatenate(counts), len(first)).astype(np.int64)
    return pa.table({"bucket": pa.array(np.full(len(first), key[0].as_py()), pa.int32()), "word": pa.array([words[i] for i in first], pa.binary()).cast(pa.string()), "c": pa.array(c)})


def word_hashes(words: pa.Array) -> np.ndarray:
    """The hash of each word of a string array, as in texts."""
    out = []
    for _, _, data, offsets in text_pieces(words):
        h, _, _ = hash_words(data, True, offsets[1:-1])
        out.append(h)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _lattice(sent) -> Lattice:
    vocabulary, weights = sent.value
    lattice = Lattice(vocabulary)
    if weights is not None:
        lattice.set_weights(*weights)
    return lattice


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about AT_ONCE: words are summed over by their length, many of one length at a time."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= AT_ONCE:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def fit_weights(words: DataFrame, vocabulary: list[tuple[str, float]], rounds: int = EM_ROUNDS) -> tuple[np.ndarray, float] | None:
    """Weights of the pieces and of the word end after expectation-maximisation over all distinct training words. words: word, c."""
    spark = words.sparkSession
    weights = None
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((vocabulary, weights))

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            lattice, total, seen = None, None, 0
            for b in _gathered(batches):
                lattice = lattice or _lattice(sent)
                got = lattice.expected(b.column(0).to_pylist(), np.ones(b.num_rows))
                total, seen = got if total is None else total + got, seen + b.num_rows
            if total is not None:
                used = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[used, -1], pa.int64()), pa.array(np.r_[total[used], float(seen)])], names=["piece", "n"])

        sums = words.where("c > 0").select("word").mapInArrow(tidied(expect), "piece bigint, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        if not sums:
            return None
        weight, end = np.full(len(Lattice(vocabulary).texts), ALPHA), 0.0
        for r in sums:
            if r["piece"] < 0:
                end = r["n"]
            else:
                weight[r["piece"]] += r["n"]
        weights = (weight, end)
    return weights


def with_log_p(words: DataFrame, vocabulary: list[tuple[str, float]], weights: tuple[np.ndarray, float] | None) -> DataFrame:
    """Adds h (the word's hash), lattice (log10 of its marginal probability over all segmentations) and chars. words: word, c."""
    sent = words.sparkSession.sparkContext.broadcast((vocabulary, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = None
        for b in _gathered(batches):
            lattice = lattice or _lattice(sent)
            said = b.column(0).to_pylist()
            p = lattice.log_probabilities(said) / math.log(10)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(word_hashes(b.column(0)).view(np.int64)), pa.array(p), pa.array([len(w) for w in said], pa.int64())], names=["word", "c", "h", "lattice", "chars"])

    return words.select("word", "c").mapInArrow(tidied(run), "word string, c bigint, h bigint, lattice double, chars bigint")


def likelihood_bin():
    """Class of a word by its lattice log10 probability per character (a quarter each, from 0 down)."""
    return F.least(F.lit(BINS - 1), F.floor(-4 * F.col("lattice") / (F.col("chars") + 1))).cast("int")


def discount(once: int, twice: int) -> float:
    """What each distinct word's count leaves to spelling; 0.9 at most, 0.5 where nothing tells."""
    return min(0.9, once / (once + 2 * twice)) if once else 0.5


def score_documents(docs: DataFrame, vocabulary_path: str, learn, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, n_known, train_tokens, base_score, score, class_score.

    learn: a boolean column, true for training documents. `score` is the log10 probability of the text: the sum over its
    words of log10((c - D) / N + D * V / N * L) (without the first part for unseen words), with L the word's lattice
    probability, and log10 of the end's share of N. In `class_score`, as in the base, a word never seen in training counts as
    its class instead of itself, here one of BINS by lattice likelihood per character; the classes share what spelling
    leaves to unseen words like words seen once.
    """
    small_batches(docs.sparkSession)
    vocabulary = read_vocabulary(vocabulary_path)
    dealt, n = bucketed(docs, id_col, text_col, learn)
    asked = dealt.groupBy("bucket").applyInArrow(_bucket_words, _ROW)
    by_group = asked.groupBy("word", F.floor(F.col("bucket") / GROUPED).alias("g")).agg(F.sum("c").alias("c"), F.collect_list("bucket").alias("buckets"))
    grouped = materialise(by_group.select("word", "c", "buckets"), "asked-words")
    words = grouped.groupBy("word").agg(F.sum("c").alias("c")) if n > GROUPED else grouped.select("word", "c")
    weights = fit_weights(words, vocabulary)
    scored = materialise(with_log_p(words, vocabulary, weights), "word-scores")
    seen = F.col("c") > 0
    s = scored.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(seen).alias("v"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice"), F.coalesce(F.sum(F.when(seen, F.pow(F.lit(10.0), "lattice"))), F.lit(0.0)).alias("known_mass")).first()
    ends = dealt.where("learn").count()
    once = {r["bin"]: r["n"] for r in scored.where("c = 1").groupBy(likelihood_bin().alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total, types, d = s["n"] + ends, s["v"], discount(s["once"], s["twice"])
    # Without training words, spelling has one token's share.
    spelled, whole = (d * types, total) if types else (1.0, total + 1)
    left = max(1e-9, 1 - s["known_mass"])
    share = [math.log10(left * (once.get(b, 0) + 1 / BINS) / (sum(once.values()) + 1)) for b in range(BINS)]
    room = math.log10(spelled / whole)
    known = F.log10((F.col("c") - F.lit(d) + F.lit(spelled) * F.pow(F.lit(10.0), "lattice")) / F.lit(float(whole)))
    classed = F.lit(room) + F.element_at(F.array(*[F.lit(x) for x in share]), likelihood_bin() + 1)
    values = scored.select("word", "h", "c", F.when(seen, known).otherwise(F.lit(room) + F.col("lattice")).alias("s"), F.when(seen, known).otherwise(classed).alias("k"))
    answers = grouped.select("word", "buckets").join(values, "word").select(F.explode("buckets").alias("bucket"), "h", "c", "s", "k")
    end_s = math.log10(max(ends, 0.5) / whole)
    norm = math.log10(total + types + (1 if ends else 0) + 1)
    end_base = math.log10(ends + 1) - norm

    def score(key: tuple, left_: pa.Table, right: pa.Table) -> pa.Table:
        h = right.column("h").to_numpy().view(np.uint64)
        by = np.argsort(h)
        h, c, s_, k_ = h[by], *(right.column(x).to_numpy()[by] for x in ("c", "s", "k"))
        logs = np.log10(c + 1.0) - norm
        cols: tuple[list, ...] = ([], [], [], [], [])
        for _, _, words_, offsets in hashed_texts(left_.column("text"), lower=True):
            at = np.searchsorted(h, words_)
            sizes = np.diff(offsets)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            cols[0].append(sizes + 1)
            cols[1].append(np.bincount(doc, c[at] > 0, len(sizes)).astype(np.int64) + (ends > 0))
            for i, (values_, end) in enumerate(((logs, end_base), (s_, end_s), (k_, end_s)), 2):
                cols[i].append(np.bincount(doc, values_[at], len(sizes)) + end)
        joined = [np.concatenate(x) if x else np.zeros(0) for x in cols]
        return pa.table({"id": left_.column("id"), "n_tokens": pa.array(joined[0].astype(np.int64)), "n_known": pa.array(joined[1].astype(np.int64)), "base_score": pa.array(joined[2]), "score": pa.array(joined[3]), "class_score": pa.array(joined[4])})

    result = dealt.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(score, "id bigint, n_tokens bigint, n_known bigint, base_score double, score double, class_score double")
    return result.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score", "class_score")
