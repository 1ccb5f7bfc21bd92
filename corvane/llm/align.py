"""Alignment of two tokenizers on the same texts: groups of tokens between common ends, overlaps, and how usual each overlap is.

A block is a run of whole texts in one task. Its texts are cut before single spaces behind a word, where both
tokenizers always cut; each distinct piece is encoded once by either; A keeps the tokens of pieces and shares those of their
letters. DuckDB then works on the block's interval tables: an
ASOF join finds the first A token that a B token touches, a second one the last, a range over these gives all overlaps;
running sums of common ends number the groups. Counts of id pairs leave the block as partial sums, which Spark merges;
each block asks for the pairs it holds, and the answers meet its documents again by block.

Defined cases: null and empty texts, and texts that either tokenizer does not give back byte for byte, have no tokens: zeros
and empty groups; null ids and rows that repeat are rows of their own and count each; equal counts are ties, all best; an empty table
gives an empty result; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import materialise, small_batches, tidied, uncollected
from .tokens import Encoder

#: Bytes of texts that a block gathers before it is aligned; a longer text is a block of its own.
BLOCK_BYTES = 5 << 20
#: Words and parts of words whose tokens A keeps, about 250 bytes each, beside those of a block.
CACHE_WORDS = 200_000
#: Before such a space both tokenizers cut: it follows no white space of any kind.
CUT = re.compile(r"(?<=\S)(?= )")
UNSAFE = re.compile(r"^\s|\s ")
#: The same white space where Arrow looks for it.
WHITE = r"[\s\x{0b}\pZ\x{85}\x{1c}-\x{1f}]"
#: Where it begins, a piece is a space and its key.
BLOCK = "kind int, block bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs array<bigint>, times array<bigint>"
DOCUMENT, PARTIAL = 0, 1
B_IDS = 1 << 20


def pieces(text: str) -> list[str]:
    """The text behind a space in parts that are encoded by themselves, each without the space it begins with."""
    if UNSAFE.search(text) is None:
        return text.split(" ")
    return [p[1:] for p in CUT.split(" " + text)]


def byte_level_bytes() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable bytes are themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers with the bytes of each id."""

    def __init__(self, a_path: str, b_path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece

        with open(a_path, encoding="utf-8") as f:
            self.coder = Encoder(f.read())
        self.coder.most = CACHE_WORDS
        self.a = self.coder.tokenizer
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        to_byte = byte_level_bytes()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        n = self.b.get_piece_size()
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        self.space = [self.b.piece_to_id("▁")]  # an empty text has no tokens, but an empty piece is a space
        self.b_opens = np.array([x.startswith(b" ") for x in self.b_bytes])
        self.a_spelt, self.b_spelt = (pa.array(xs, pa.large_binary()) for xs in (self.a_bytes, self.b_bytes))
        self.a_len, self.b_len = (np.array([len(x) for x in xs], np.int64) for xs in (self.a_bytes, self.b_bytes))

    def _kept(self, keys: list[str]) -> Tokens:
        """A's tokens of pieces without white space, of which the encoder keeps those it met, and their parts."""
        found = self.coder.words_ids(keys)
        counts = np.fromiter(map(len, found), np.int64, len(found)) // self.coder.id_bytes
        return Tokens(np.frombuffer(b"".join(found), self.coder.code).astype(np.int64), np.r_[0, np.cumsum(counts)])

    def _together(self, keys: list[str]) -> Tokens | None:
        """B's tokens: pieces without white space go as one text, which is cut at the tokens that open with a space; nothing if those are not as many."""
        ids = np.array(self.b.encode(" ".join(keys)), np.int64)
        starts = np.flatnonzero(self.b_opens[ids])
        return Tokens(ids, np.r_[starts, len(ids)]) if len(starts) == len(keys) and starts[0] == 0 else None

    def _each_a(self, keys: list[str]) -> Tokens:
        return Tokens.of([e.ids for e in self.a.encode_batch_fast([" " + k for k in keys], add_special_tokens=False)])

    def _each_b(self, keys: list[str]) -> Tokens:
        return Tokens.of([ids if k else self.space for k, ids in zip(keys, self.b.encode(keys, num_threads=1), strict=True)])

    def encode(self, keys: list[str], plain: int) -> tuple[Tokens, Tokens, np.ndarray]:
        """The tokens of A and B of each piece, of which the first `plain` have no white space, and whether both give the piece back."""
        odd = [keys[at : at + 512] for at in range(plain, len(keys), 512)]
        a = Tokens.joined([self._kept(keys[:plain]), *map(self._each_a, odd)])
        b = Tokens.joined([*[self._together(some) or self._each_b(some) for at in range(0, plain, 512) for some in [keys[at : min(at + 512, plain)]]], *map(self._each_b, odd)])
        said = [(" " + k).encode() for k in keys]
        sizes = np.fromiter(map(len, said), np.int64, len(said))
        joined = b"".join(said)
        whole = np.ones(len(keys), bool)
        for tokens, length, spelt in ((a, self.a_len, self.a_spelt), (b, self.b_len, self.b_spelt)):
            same = tokens.sums(length[tokens.ids]) == sizes
            back = memoryview(spelt.take(pa.array(tokens.ids)).buffers()[2] or b"").cast("B")[: int(length[tokens.ids].sum())]  # Arrow says signed bytes
            if not same.all() or back != joined:
                ends = np.r_[0, np.cumsum(length[tokens.ids])][tokens.ends].tolist()
                whole &= np.array([w == back[x:y] for w, (x, y) in zip(said, pairwise(ends), strict=True)], bool)
        return a, b, whole


class Tokens:
    """The ids of consecutive pieces; `ends` are their places, from 0 on."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray):
        self.ids, self.ends = ids, ends

    @classmethod
    def of(cls, lists: list) -> Tokens:
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        return cls(np.fromiter(chain.from_iterable(lists), np.int64, int(counts.sum())), np.r_[0, np.cumsum(counts)])

    @classmethod
    def joined(cls, parts: list[Tokens]) -> Tokens:
        before = np.cumsum([0, *[len(t.ids) for t in parts]])
        return cls(np.concatenate([np.zeros(0, np.int64), *[t.ids for t in parts]]), np.concatenate([*[t.ends[:-1] + n for t, n in zip(parts, before, strict=False)], before[-1:]]))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ends)

    def sums(self, of: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0, np.cumsum(of)][self.ends])

    def only(self, kept: np.ndarray) -> Tokens:
        counts = self.counts
        return Tokens(self.ids[np.repeat(kept, counts)], np.r_[0, np.cumsum(counts[kept])])

    def intervals(self, length: np.ndarray) -> pa.Table:
        """(seq, piece, s, e, id): the tokens as byte intervals of all pieces in a row."""
        e = np.cumsum(length[self.ids])
        columns = {"seq": np.arange(len(self.ids)), "piece": np.repeat(np.arange(len(self.ends) - 1), self.counts), "s": e - length[self.ids], "e": e, "id": self.ids}
        return pa.table({c: x.astype(np.int32) for c, x in columns.items()})  # a block is far below two billion bytes


_pairs: dict[tuple[str, str], Pair] = {}


def tokenizer_pair(a_path: str, b_path: str) -> Pair:
    if (a_path, b_path) not in _pairs:
        _pairs.clear()
        _pairs[a_path, b_path] = Pair(a_path, b_path)
    return _pairs[a_path, b_path]


#: Ends that both have; the groups between them; overlaps of tokens, from the first to the last that is touched.
ALIGN = f"""
    CREATE TEMP TABLE ends AS SELECT a.e FROM a JOIN b ON a.e = b.e;
    CREATE TEMP TABLE ga AS SELECT a.seq, coalesce(sum((ends.e IS NOT NULL)::INT) OVER (ORDER BY a.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS g FROM a LEFT JOIN ends ON a.e = ends.e;
    CREATE TEMP TABLE gb AS SELECT b.seq, coalesce(sum((ends.e IS NOT NULL)::INT) OVER (ORDER BY b.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS g FROM b LEFT JOIN ends ON b.e = ends.e;
    CREATE TEMP TABLE touched AS
        SELECT f.piece, f.id, f.first, l.seq AS last FROM (SELECT b.*, a.seq AS first FROM b ASOF JOIN a ON b.s >= a.s) f ASOF JOIN a l ON f.e - 1 >= l.s;
    CREATE TEMP TABLE links AS
        SELECT t.piece, a.id::BIGINT * {B_IDS} + t.id AS pair, count(*) AS n FROM (SELECT piece, id, unnest(range(first, last + 1)) AS seq FROM touched) t JOIN a ON a.seq = t.seq GROUP BY ALL"""


def strings(values: pa.Array) -> list[str]:
    """Arrow's strings at once; `to_pylist` makes a scalar of each before."""
    return values.to_numpy(zero_copy_only=False).tolist()


def distinct_pieces(texts: list[str | None]) -> tuple[list[str], int, np.ndarray, np.ndarray]:
    """The distinct pieces, first those without white space, and their number; the text and the piece of each occurrence, in order."""
    given = pa.array(texts, pa.large_string())
    held = np.array([bool(t) for t in texts], bool)
    unsafe = pc.match_substring_regex(given, rf"^{WHITE}|{WHITE} ").fill_null(False).to_numpy(zero_copy_only=False)
    easy, odd = np.flatnonzero(held & ~unsafe), np.flatnonzero(held & unsafe).tolist()
    lists = pc.split_pattern(given.take(pa.array(easy)), " ")
    parts = [pieces(texts[i]) for i in odd]
    rows = np.repeat(np.array([*easy, *odd], np.int64), np.r_[np.diff(lists.offsets.to_numpy()), np.fromiter(map(len, parts), np.int64, len(parts))].astype(np.int64))
    coded = pa.chunked_array([lists.flatten(), pa.array(chain.from_iterable(parts), pa.large_string())], pa.large_string()).combine_chunks().dictionary_encode()
    keys, index = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    spaced = pc.match_substring_regex(keys, rf"^$|{WHITE}").to_numpy(zero_copy_only=False).astype(bool)
    order = np.argsort(spaced, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    piece = place[index]
    if odd:
        by_text = np.argsort(rows, kind="stable")
        rows, piece = rows[by_text], piece[by_text]
    return strings(keys.take(pa.array(order))), int((~spaced).sum()), rows, piece


def numbers(db, name: str, n: int) -> np.ndarray:
    found = db.sql(f"SELECT seq, g FROM {name}").fetchnumpy()
    out = np.zeros(n, np.int64)
    out[found["seq"]] = found["g"]
    return out


def joined(values: pa.Array, ends: np.ndarray, by: str) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values), by)


def written_groups(a: Tokens, b: Tokens, g_a: np.ndarray, g_b: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """`a1,a2|b1;a3|b2,b3` of each piece from the group of each token, and its number of groups."""
    firsts = [np.r_[np.flatnonzero(np.diff(g, prepend=-1)), len(g)] for g in (g_a, g_b)]
    each = pc.binary_join_element_wise(*[joined(pa.array(t.ids).cast(pa.string()), first, ",") for t, first in zip((a, b), firsts, strict=True)], "|")
    ends = np.searchsorted(firsts[0][:-1], a.ends)
    return joined(each, ends, ";"), np.diff(ends)


def aligned_block(db, pair: Pair, texts: list[str | None]) -> tuple[list[dict], np.ndarray, np.ndarray]:
    """For each text its counts, groups and linked pairs; for the block each pair with the number of texts that hold it."""
    keys, plain, row, piece = distinct_pieces(texts)
    a, b, whole = pair.encode(keys, plain)
    # Of a text that is not given back, no piece is left.
    kept = ~np.isin(row, row[~whole[piece]])
    row, piece = row[kept], piece[kept]
    good = np.flatnonzero(whole)
    place = np.full(len(keys), -1)
    place[good] = np.arange(len(good))
    a, b = a.only(whole), b.only(whole)
    for name, tokens, length in (("a", a, pair.a_len), ("b", b, pair.b_len)):
        db.register(f"{name}_in", tokens.intervals(length))
        db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM {name}_in")
        db.unregister(f"{name}_in")
    for statement in ALIGN.split(";\n"):
        db.execute(statement.replace("CREATE TEMP", "CREATE OR REPLACE TEMP"))
    groups, n_groups = written_groups(a, b, numbers(db, "ga", len(a.ids)), numbers(db, "gb", len(b.ids)))
    for name in ("ends", "ga", "gb", "touched", "a", "b"):
        db.execute(f"DROP TABLE {name}")
    n, flat = len(texts), place[piece]
    # How often each document holds each piece, and so each pair.
    cells, often = np.unique(row * max(1, len(good)) + flat, return_counts=True)
    db.register("held_in", pa.table({"doc": cells // max(1, len(good)), "piece": cells % max(1, len(good)), "often": often}))
    linked = db.sql("SELECT doc, pair, sum(often * n)::BIGINT AS times FROM held_in JOIN links USING (piece) GROUP BY doc, pair ORDER BY doc, pair").to_arrow_table()
    db.unregister("held_in")
    doc, pairs, times = (linked[c].to_numpy() for c in ("doc", "pair", "times"))
    at, ends = np.searchsorted(doc, np.arange(n + 1)), np.searchsorted(row, np.arange(n + 1))
    sums = lambda per_piece: np.bincount(row, per_piece[flat], n).astype(np.int64)
    columns = {"n_a": sums(a.counts), "n_b": sums(b.counts), "n_groups": sums(n_groups)}
    n_links = np.bincount(doc, times, n).astype(np.int64)
    shown = strings(groups)
    rows = [
        {**{c: int(v[i]) for c, v in columns.items()}, "n_links": int(n_links[i]), "groups": ";".join(map(shown.__getitem__, flat[ends[i] : ends[i + 1]].tolist())), "pairs": pairs[at[i] : at[i + 1]], "times": times[at[i] : at[i + 1]]}
        for i in range(n)
    ]
    return rows, *np.unique(pairs, return_counts=True)


def aligned_blocks(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", groups_as: Callable[[str], str] = str) -> DataFrame:
    """A row for each document and one for each block's pair counts, as BLOCK says; `groups_as` gives what is kept of a document's groups."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    names = [x.split()[0] for x in BLOCK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb
        from pyspark import TaskContext

        db = duckdb.connect(config={"threads": 1})
        db.execute("SET memory_limit = '200MB'; SET preserve_insertion_order = false")
        pair = tokenizer_pair(a_path, b_path)
        block = TaskContext.get().partitionId() << 32

        def flush(ids: list, texts: list) -> Iterator[pa.RecordBatch]:
            with uncollected():
                found, pairs, docs_ = aligned_block(db, pair, texts)
            out = [{"kind": DOCUMENT, "block": block, "doc_id": i, **r, "groups": groups_as(r["groups"]) if r["n_a"] else ""} for i, r in zip(ids, found, strict=True)]
            out.append({"kind": PARTIAL, "block": block, "pairs": pairs, "times": docs_})
            types = [pa.int32(), *[pa.int64()] * 6, pa.string(), *[pa.list_(pa.int64())] * 2]
            for at in range(0, len(out), 1000):
                yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in out[at : at + 1000]], t) for c, t in zip(names, types, strict=True)], names=names)
            pa.default_memory_pool().release_unused()

        ids, texts, size = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if size and size + len(t or "") > BLOCK_BYTES:
                    yield from flush(ids, texts)
                    block, ids, texts, size = block + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t or "") + 64
        if ids:
            yield from flush(ids, texts)

    return rows.mapInArrow(tidied(run), BLOCK)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(block, pair, count, best): for each block's pairs, the number of documents in all blocks that hold them, and whether it is the highest of the A id."""
    partial = blocks.where(F.col("kind") == PARTIAL).select("block", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("block", F.col("p.pairs").alias("pair"), F.col("p.times").alias("docs"))
    counts = partial.groupBy("pair").agg(F.sum("docs").alias("count")).withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy(F.call_function("shiftright", "pair", F.lit(B_IDS.bit_length() - 1)))))
    return partial.select("block", "pair").join(counts, "pair")


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", groups_as: Callable[[str], str] = str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (`a1,a2|b1;a3|b2,b3`, or what `groups_as` makes of it)."""
    blocks = materialise(aligned_blocks(docs, a_path, b_path, id_col, text_col, groups_as), "aligned")
    counts = pair_counts(blocks)
    plain = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    out = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string"

    def settle(found: pa.Table, known: pa.Table) -> pa.Table:
        order = np.argsort(known["pair"].to_numpy())
        pair, count, best = known["pair"].to_numpy()[order], known["count"].to_numpy()[order], known["best"].to_numpy()[order]
        lists, times = found["pairs"].combine_chunks(), found["times"].combine_chunks().flatten().to_numpy()
        at = np.searchsorted(pair, lists.flatten().to_numpy())
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        ends = np.searchsorted(row, np.arange(len(lists) + 1))
        total = lambda x: np.diff(np.r_[0, np.cumsum(x)][ends])
        return pa.table({**{c: found[c] for c in plain}, "n_best": total(times * best[at]), "count_sum": total(times * count[at]), "groups": found["groups"]})

    each = blocks.where(F.col("kind") == DOCUMENT).select("block", *plain, "groups", "pairs", "times")
    return each.groupBy("block").cogroup(counts.withColumnRenamed("block", "asked").groupBy("asked")).applyInArrow(settle, out)
