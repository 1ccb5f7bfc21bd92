"""Token-id output: raw id shards with a minimal perfect hash index over document keys.

Layout of a folder: `shard-N.bin` holds the ids of whole documents, each ended by the end id, as little-endian uint16
(uint32 for vocabularies over 65536); shards are in ascending id order. `index-N.npz` holds, for the keys hashed to it, a
minimal perfect hash (levels of collision-free bits, after Limasset et al. 2017) and in its order each key's stored
fingerprint, shard, token offset and token count, so a key is found in constant time and a foreign key is refused.

A key is (document id, ordinal): rows that share an id are numbered 0, 1, ... in order of their text. Every file is
written under a task's own name and then renamed, so lost or repeated tasks leave whole files only.

Defined cases: null text is empty and has the end id alone; null ids come first, as one id; repeated rows are stored once
each; an empty table gives an empty folder and result; other columns are not stored.
"""

from __future__ import annotations

import array
import io
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .store import materialise, small_batches, tidied, uncollected
from .words import mix

SEGMENT_CHARS, GROUP_CHARS = 1 << 18, 1 << 22
#: Words and parts of words whose ids a worker keeps, about 250 bytes each; those not met among as many as half of them go first.
CACHE_WORDS = 2_000_000
KEYS_PER_INDEX = 100_000
#: White space before a space: there, cutting before the space could change the ids.
UNSAFE = re.compile(r"\s ")
#: The same where Arrow looks for it, and a text that begins with a space.
CLOSE = r"^ |[\s\x{0b}\pZ\x{85}\x{1c}-\x{1f}] "
#: Letters, signs behind them, and perhaps a further line with its signs: a byte-level pre-tokenizer always cuts between letters and
#: signs and on both sides of a single line feed within other characters.
PARTS = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([!-/:-@\[-`{-~]*\n(?=.)|[!-/:-@\[-`{-~]+)(?:(?<=\n)([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([!-/:-@\[-`{-~]+)?)?")
#: An added token of letters and signs or of more than one line, which such a cut could divide.
DIVIDED = re.compile(r"[^\W\d_]+[!-/:-@\[-`{-~]+|(?s:.*\n.*)")
SHARD_TYPE = "doc_id bigint, ordinal bigint, shard int, offset bigint, n_tokens bigint"


class Encoder:
    """Ids of whole texts as bytes.

    Words are encoded once and kept: before a single space that follows no white space, a byte-level pre-tokenizer always
    cuts, so a text's ids are those of its first word and of each further word with its space. It also cuts between letters and
    the signs behind them, so a new word with signs is made of parts that other words share. Other texts go to the tokenizer as
    they are.
    """

    def __init__(self, tokenizer_json: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.code = "I" if self.wide else "H"
        self.cuts = '"type":"ByteLevel"' in tokenizer_json.replace(" ", "") and '"normalizer":null' in tokenizer_json.replace(" ", "").replace("\n", "") and '"add_prefix_space":false' in tokenizer_json.replace(" ", "")
        self.parts = self.cuts and not any(t.lstrip or t.rstrip or DIVIDED.fullmatch(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.most = CACHE_WORDS
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.opens[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True  # tokens that begin with a space

    @property
    def id_bytes(self) -> int:
        return 4 if self.wide else 2

    def _batch(self, texts: list[str]) -> list[bytes]:
        return [array.array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _spaced(self, words: list[str]) -> list[bytes]:
        """The ids of each word behind a space. Words without white space at their ends are encoded as one text and cut at the tokens that begin with a space."""
        out: dict[str, bytes] = {}
        plain = [w for w in words if w and not w[0].isspace() and not w[-1].isspace()]
        for at in range(0, len(plain), 4096):
            some = plain[at : at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, np.uint32 if self.wide else np.uint16)
            starts = np.flatnonzero(self.opens[ids]) * self.id_bytes
            if len(starts) == len(some) and starts[0] == 0:
                body = ids.tobytes()
                edges = [*starts.tolist(), len(body)]
                out.update((w, body[a:b]) for w, a, b in zip(some, edges, edges[1:], strict=False))
        rest = [w for w in words if w not in out]
        out.update(zip(rest, self._batch([" " + w for w in rest]), strict=True))
        return [out[w] for w in words]

    def _encoded(self, keys: list[str]) -> None:
        """Encode and keep new keys; one that begins with a space is what follows the space, any other a word behind a space."""
        inner = [k for k in keys if k[:1] == " "]
        spaced = [k for k in keys if k[:1] != " "] if inner else keys
        self.words.update(zip(spaced, self._spaced(spaced), strict=True))
        self.words.update(zip(inner, self._batch([k[1:] for k in inner]), strict=True))

    def _missing(self, keys: Iterable[str]) -> list[str]:
        """Those of distinct keys that are not kept; older ones are kept anew."""
        get, older, words, out = self.words.get, self.older.get, self.words, []
        for k in keys:
            if get(k) is None:
                ids = older(k)
                if ids is None:
                    out.append(k)
                else:
                    words[k] = ids
        return out

    def words_ids(self, words: list[str]) -> list[bytes]:
        """The ids of each of distinct words behind a space. Of new words, letters and the signs behind them are encoded apart, once for all words that have them."""
        if len(self.words) > self.most // 2:
            self.older, self.words = self.words, {}
        ids = list(map(self.words.get, words))
        parts, keys = {}, []
        for w in self._missing([w for w, x in zip(words, ids, strict=True) if x is None]):
            m = PARTS.fullmatch(w) if self.parts and not w.isalpha() else None
            if m is None:
                keys.append(w)
            else:
                parts[w] = [m[1], *[" " + x for x in m.group(2, 3, 4) if x]]
        self._encoded(self._missing(dict.fromkeys(chain(keys, *parts.values()))))
        get = self.words.__getitem__
        for w, of in parts.items():
            self.words[w] = b"".join(map(get, of))
        return [get(w) if x is None else x for w, x in zip(words, ids, strict=True)]

    def _coded(self, words: pa.Array) -> tuple[list[bytes], np.ndarray]:
        """The ids of the distinct words behind a space, and the place of each word among them."""
        coded = words.dictionary_encode()
        return self.words_ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), coded.indices.to_numpy()

    def _segments(self, text: str) -> Iterator[list[str]]:
        at = 0
        while at < len(text):
            to = text.find(" ", at + SEGMENT_CHARS) if len(text) - at > SEGMENT_CHARS else -1
            to = len(text) if to < 0 else to
            yield (text[at:to] if at == 0 else text[at + 1 : to]).split(" ") if to - at > 1 or at == 0 else [""]
            at = to

    def encode_group(self, texts: pa.Array, end: bytes = b"") -> tuple[memoryview, np.ndarray]:
        """The ids of all of a bounded group of texts, each with `end` behind it, and the bytes before each text and behind the last.

        Arrow cuts the texts and finds the distinct words, whose ids are then laid out in the order of the words.
        """
        given = texts.cast(pa.large_string()).fill_null("")
        whole = pc.match_substring_regex(given, CLOSE) if self.cuts else pa.array([True] * len(given), pa.bool_())
        lists = pc.split_pattern(pc.if_else(whole, "", given), " ")
        starts = lists.offsets.to_numpy()
        words = lists.flatten()
        # The first word is behind no space; a text that is not cut is its own first word.
        heads = pc.if_else(whole, given, words.take(pa.array(starts[:-1]))).to_pylist()
        behind = np.ones(len(words), bool)
        behind[starts[:-1]] = False
        found, at = self._coded(words.filter(pa.array(behind)))
        place = np.empty(len(words), np.int64)
        place[behind] = at
        place[~behind] = np.arange(len(found), len(found) + len(heads))
        values = pa.array([*found, *self._batch(heads), end], pa.large_binary())
        out = values.take(pa.array(np.insert(place, starts[1:], len(values) - 1)))
        ends = np.frombuffer(out.buffers()[1], np.int64)[: len(out) + 1]
        return memoryview(out.buffers()[2] or b""), ends[starts + np.arange(len(starts))]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each of a bounded group of texts."""
        body, at = self.encode_group(pa.array(texts, pa.large_string()))
        return [bytes(body[a:b]) for a, b in pairwise(at.tolist())]

    def encode(self, text: str) -> Iterator[bytes]:
        """The ids of one text of any length, segment by segment."""
        if not text:
            return
        if not self.cuts or text[0] == " " or UNSAFE.search(text) is not None:
            yield self._batch([text])[0]
            return
        first = True
        for words in self._segments(text):
            if first:
                yield self._batch([words[0]])[0]
                words, first = words[1:], False
            found, at = self._coded(pa.array(words, pa.large_string()))
            yield b"".join(map(found.__getitem__, at.tolist()))


_encoders: dict[int, Encoder] = {}


def encoder(tokenizer_json: str) -> Encoder:
    """One per worker process and vocabulary."""
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(tokenizer_json)
    return _encoders[key]


def put_file(uri: str, write: Callable[[pa.NativeFile], None]) -> None:
    """Write under a name of this attempt, then rename."""
    files, path = fs.FileSystem.from_uri(uri)
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(own) as out:
        write(out)
    files.move(own, path)


def key_hashes(ids: np.ndarray, valid: np.ndarray, ordinals: np.ndarray) -> np.ndarray:
    """64-bit keys: a bijection of the id for each ordinal."""
    with np.errstate(over="ignore"):
        return mix(np.where(valid, ids, 0).astype(np.int64).view(np.uint64) ^ mix(ordinals.astype(np.uint64) * np.uint64(2) + (~valid).astype(np.uint64)))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: at each level, keys alone on their bit are placed; the rest go on."""

    LEVELS, LOAD = 40, 2

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.ranks, base = [], 0
        for bits in levels:
            self.ranks.append(base + np.cumsum(bits) - bits)
            base += int(bits.sum())
        self.base = base

    @staticmethod
    def _slot(keys: np.ndarray, level: int, n: int) -> np.ndarray:
        return (mix(keys ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(n)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys) and len(levels) < cls.LEVELS:
            n = max(8, cls.LOAD * len(keys))
            slot = cls._slot(keys, len(levels), n)
            alone = np.bincount(slot, minlength=n) == 1
            levels.append(alone)
            keys = keys[~alone[slot]]
        return cls(levels, np.sort(keys))

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            slot = self._slot(keys[open_], level, len(bits))
            hit = bits[slot]
            out[open_[hit]] = ranks[slot[hit]]
            open_ = open_[~hit]
        if len(open_) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            hit = self.rest[at] == keys[open_]
            out[open_[hit]] = self.base + at[hit]
        return out


def _written(enc: Encoder, texts: pa.Array, end: bytes, out: pa.NativeFile) -> Iterator[int]:
    """Write the ids of each text and the end id; yields their numbers. Texts go in groups; a longer one goes alone, in segments."""
    sizes = pc.utf8_length(texts).to_pylist()
    at = 0
    while at < len(sizes):
        to, chars = at, 0
        while to < len(sizes) and chars + sizes[to] <= GROUP_CHARS:
            chars += sizes[to]
            to += 1
        if to == at:
            n = 0
            for part in enc.encode(texts[at].as_py()):
                out.write(part)
                n += len(part)
            out.write(end)
            yield n // enc.id_bytes + 1
            at += 1
            continue
        with uncollected():
            body, ends = enc.encode_group(texts.slice(at, to - at), end)
        out.write(body)
        yield from (np.diff(ends) // enc.id_bytes).tolist()
        at = to


def write_token_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", cache_words: int = CACHE_WORDS) -> DataFrame:
    """Write all documents and their index; returns the documents' keys with shard, offset in the shard and token count."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(sent.value)
        enc.most = cache_words
        shard = TaskContext.get().partitionId()
        end = array.array(enc.code, [end_id]).tobytes()
        meta: list[tuple[list, list, list, list]] = []

        def write(out: pa.NativeFile) -> None:
            offset, last, ordinal = 0, object(), 0
            for b in batches:
                ids = b.column(0).to_pylist()
                ordinals, offsets, sizes = [], [], []
                for doc, n in zip(ids, _written(enc, b.column(1), end, out), strict=True):
                    ordinal = ordinal + 1 if doc == last else 0
                    last = doc
                    ordinals.append(ordinal)
                    offsets.append(offset)
                    sizes.append(n)
                    offset += n
                meta.append((ids, ordinals, offsets, sizes))

        put_file(f"{folder}/shard-{shard:06d}.bin", write)
        for ids, ordinals, offsets, sizes in meta:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ordinals, pa.int64()), pa.array([shard] * len(ids), pa.int32()), pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64())], names=["doc_id", "ordinal", "shard", "offset", "n_tokens"])

    keys = materialise(ordered.mapInArrow(tidied(run), SHARD_TYPE), "token-keys")
    write_index(keys, folder)
    return keys


def index_count(spark: SparkSession, n_keys: int) -> int:
    return max(1, -(-n_keys // KEYS_PER_INDEX))


def _file_of(key: np.ndarray, files: int) -> np.ndarray:
    return ((key >> np.uint64(40)) % np.uint64(files)).astype(np.int64)


def _key_arrays(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = b.column("doc_id")
    return ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False), b.column("ordinal").to_numpy(zero_copy_only=False)


def with_index_file(keys: DataFrame, files: int) -> DataFrame:
    """Adds the number of the index file that holds each key."""
    names = keys.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_file_of(key_hashes(*_key_arrays(b)), files), pa.int64())], names=[*names, "__file"])

    return keys.mapInArrow(tidied(run), T.StructType([*keys.schema.fields, T.StructField("__file", T.LongType())]))


def write_index(keys: DataFrame, folder: str) -> int:
    files = index_count(keys.sparkSession, keys.count())

    def build(key: tuple, got: pa.Table) -> pa.Table:
        b = got.combine_chunks().to_batches()[0]
        hashes = key_hashes(*_key_arrays(b))
        mph = PerfectHash.build(hashes)
        at = mph.lookup(hashes)
        order = np.argsort(at, kind="stable")
        body = {f"bits{i}": np.packbits(x) for i, x in enumerate(mph.levels)} | {"sizes": np.array([len(x) for x in mph.levels]), "rest": mph.rest, "fingerprint": mix(hashes)[order]}
        body |= {c: b.column(c).to_numpy(zero_copy_only=False)[order] for c in ("shard", "offset", "n_tokens")}
        packed = io.BytesIO()
        np.savez(packed, **body)
        put_file(f"{folder}/index-{key[0].as_py():06d}.npz", lambda out: out.write(packed.getvalue()))
        return pa.table({"file": pa.array([key[0].as_py()], pa.int64()), "n_keys": pa.array([b.num_rows], pa.int64())})

    materialise(with_index_file(keys, files).groupBy("__file").applyInArrow(build, "file bigint, n_keys bigint"), "token-index")
    return files


def load_index(folder: str, file: int) -> tuple[PerfectHash, dict[str, np.ndarray]]:
    files, path = fs.FileSystem.from_uri(f"{folder}/index-{file:06d}.npz")
    with files.open_input_stream(path) as f:
        z = np.load(io.BytesIO(f.read()))
    levels = [np.unpackbits(z[f"bits{i}"], count=int(n)).astype(bool) for i, n in enumerate(z["sizes"])]
    return PerfectHash(levels, z["rest"]), {c: z[c] for c in ("fingerprint", "shard", "offset", "n_tokens")}


def find(index: tuple[PerfectHash, dict[str, np.ndarray]], hashes: np.ndarray) -> np.ndarray:
    """Positions of the keys in an index file; -1 where the stored fingerprint says the key is not there."""
    mph, stored = index
    at = mph.lookup(hashes)
    if not len(stored["fingerprint"]):
        return np.full(len(hashes), -1)
    return np.where((at >= 0) & (stored["fingerprint"][at] == mix(hashes)), at, -1)


def locate(keys: DataFrame, folder: str, files: int) -> DataFrame:
    """(doc_id, ordinal, shard, offset, n_tokens) of the keys that the index holds."""

    def run(key: tuple, got: pa.Table) -> pa.Table:
        index = load_index(folder, key[0].as_py())
        b = got.combine_chunks().to_batches()[0]
        at = find(index, key_hashes(*_key_arrays(b)))
        b, at = b.filter(pa.array(at >= 0)), at[at >= 0]
        return pa.table({"doc_id": b.column("doc_id"), "ordinal": b.column("ordinal"), **{c: pa.array(index[1][c][at]) for c in ("shard", "offset", "n_tokens")}})

    return with_index_file(keys.select("doc_id", "ordinal"), files).groupBy("__file").applyInArrow(run, SHARD_TYPE)


def read_payloads(located: DataFrame, folder: str, wide: bool, schema: str, digest: Callable[[np.ndarray], tuple]) -> DataFrame:
    """For each located document its key, shard, offset, token count and digest(ids), read from the shard files."""
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, f = None, None
        width = 4 if wide else 2
        for b in batches:
            got = []
            for s, offset, n in zip(*(b.column(c).to_pylist() for c in ("shard", "offset", "n_tokens")), strict=True):
                if s != shard:
                    files, path = fs.FileSystem.from_uri(f"{folder}/shard-{s:06d}.bin")
                    shard, f = s, files.open_input_file(path)
                got.append(digest(np.frombuffer(f.read_at(n * width, offset * width), "<u4" if wide else "<u2")))
            columns = list(zip(*got, strict=True)) if got else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c) if got else pa.array([], pa.int64()) for c in columns]], names=[*b.schema.names, *names])

    ordered = located.repartition("shard").sortWithinPartitions("shard", "offset")
    return ordered.mapInArrow(tidied(run), f"{SHARD_TYPE}, {schema}")


def shard_starts(keys: DataFrame) -> DataFrame:
    """(shard, base): tokens in all shards before each; one row per shard."""
    totals = keys.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    return totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))


def ids_crc32(ids: np.ndarray) -> tuple[int]:
    return (zlib.crc32(ids.astype("<u4").tobytes()),)


def write_and_digest(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Write `docs`, then look every key up in the index and read its ids: doc_id, start, n_tokens, ids_crc32."""
    written = write_token_shards(docs, folder, tokenizer_path, end_id, cache_words=cache_words)
    spark = docs.sparkSession
    asked = docs.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.count(F.lit(1)).alias("n")).select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("ordinal"))
    with open(tokenizer_path, encoding="utf-8") as f:
        wide = Encoder(f.read()).wide
    found = locate(asked, folder, index_count(spark, written.count()))
    read = read_payloads(found, folder, wide, "ids_crc32 bigint", ids_crc32)
    return read.join(F.broadcast(shard_starts(written)), "shard").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
