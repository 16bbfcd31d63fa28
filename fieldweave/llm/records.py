"""Token ids as length-delimited binary records, with an offset index beside them.

A record is, little-endian: the payload's length (8 bytes), the masked CRC-32 of
those 8 bytes, the payload, the masked CRC-32 of the payload. A payload is one
byte that says whether the document has an id, one byte for the width of a token
id (2 if all of the record's ids fit into 16 bits, else 4), the document's id (8
bytes), then the token ids in that width. `<name>.idx` holds the offset of every record
as unsigned 64-bit integers, so that a shuffled read can seek.

Documents are range-partitioned by id, so files in order of (part, seq) hold
ascending ids. Each try of a task writes under a name of its own and reports the
files only at its end; readers open what the stored manifest lists, so a lost
executor or a second try leaves at most unlisted files.

Null texts count as empty; a null id is stored as such and comes first. Rows
with the same id keep a record each, ordered by a hash of the text; rows that are
tied in that too have the same text. Texts of any length are one record. Other
columns are not read, whatever their names. An empty table gives an empty
manifest.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TwoAges, shared_dir, written

_MASK = 0xA282EAD8
_HEAD = struct.Struct("<QI")
_ID = struct.Struct("<BBq")
#: Letters, then perhaps ASCII punctuation: the vocabulary cuts between them.
_WORD = re.compile(r"([a-zßà-öø-ÿ]+)([!-/:-@\[-`{-~]*)")

# How a vocabulary file says that it may be applied word by word.
_FORM = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
]


# How pyarrow calls the stores that Spark has other names for.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfs": "abfss", "wasb": "abfss", "wasbs": "abfss"}


def address(uri: str) -> str:
    """A URI as Spark writes it in pyarrow's words; `dbfs:/x` is the mounted folder /dbfs/x."""
    scheme, found, rest = uri.partition(":")
    if scheme == "dbfs":
        return "file:///dbfs/" + rest.lstrip("/")
    return _SCHEMES.get(scheme, scheme) + found + rest


def store_of(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI, and the path in it."""
    return pafs.FileSystem.from_uri(address(uri))


class DamagedRecord(ValueError):
    """A length or a checksum does not fit its bytes."""


def masked_crc(data: bytes) -> int:
    """CRC-32, turned by 15 bits and shifted, so that a checksum of checksums stays useful."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked_crc(length)) + payload + struct.pack("<I", masked_crc(payload))


def packed(key: int | None, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    return _ID.pack(key is not None, width, key or 0) + ids.astype(f"<u{width}").tobytes()


def unpacked(body: bytes) -> tuple[int | None, np.ndarray]:
    """The document's id and the token ids as unsigned 32-bit integers."""
    known, width, key = _ID.unpack_from(body)
    if width not in (2, 4):
        raise DamagedRecord(f"ids of {width} bytes")
    return (key if known else None), np.frombuffer(body, dtype=f"<u{width}", offset=_ID.size).astype("<u4")


def unframed(read, limit: int = 1 << 40) -> Iterator[bytes]:
    """Payloads from `read(n)`, a file's method; checks every length and checksum."""
    while head := read(_HEAD.size):
        if len(head) < _HEAD.size:
            raise DamagedRecord("a record ends inside its head")
        n, crc = _HEAD.unpack(head)
        if masked_crc(head[:8]) != crc or n > limit:
            raise DamagedRecord("a record's length does not fit its checksum")
        body = read(n + 4)
        if len(body) < n + 4 or masked_crc(body[:n]) != int.from_bytes(body[n:], "little"):
            raise DamagedRecord("a record's payload does not fit its checksum")
        yield body[:n]


class WordEncoder:
    """Encodes whole texts with the tokenizers library, each distinct word once.

    A vocabulary of the form that `_FORM` names lowers capitals, splits at white
    space and between letters and punctuation, and marks word ends; so a text's
    ids are its words' ids in a row, and the library's model alone encodes a word
    of plain letters. Texts are split and their words told apart by Arrow, many
    texts at a time. ASCII capitals are lowered first; a text in which a special
    token's opening occurs is left as it is. At most `max_words` words are held.
    With a vocabulary of any other form the library encodes every text as a whole.
    """

    def __init__(self, path: str, max_words: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.held = TwoAges(max_words)
        self.stops: dict[str, bytes] = {}
        self.packed = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        self.by_words = (
            [form["normalizer"], form["pre_tokenizer"]] == _FORM
            and form["model"]["type"] == "BPE"
            and form["model"]["end_of_word_suffix"] == "</w>"
            and not any(form["model"].get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges"))
            and not form["truncation"]
            and not form["padding"]
            and all("<|" in x["content"] for x in form["added_tokens"])
        )
        #: How the vocabulary writes each byte of a word's letters.
        written_as = [chr(b) for b in range(256)]
        for c in map(chr, range(0xDF, 0x100) if self.by_words else ()):
            if _WORD.fullmatch(c):
                for b, x in zip(c.encode(), self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0], strict=True):
                    written_as[b] = x
        self.bytes_as = "".join(written_as)

    def _direct(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _letters(self, word: str) -> bytes:
        if not word.isascii():
            word, _ = codecs.charmap_decode(word.encode(), "strict", self.bytes_as)
        return b"".join([self.packed[x.id] for x in self.model.tokenize(word)])

    def _learn(self, held: dict[str, bytes], words: set[str]) -> None:
        other, stops = [], self.stops
        for w in words:
            if w.isascii() and w.isalpha() and w.islower():
                if w not in held:
                    held[w] = self._letters(w)
                continue
            m = _WORD.fullmatch(w)
            if not m:
                other.append(w)
                continue
            stem, stop = m.groups()
            if not stop:
                if w not in held:
                    held[w] = self._letters(w)
                continue
            after = stops.get(stop)
            if after is None:
                if len(stops) > 10_000:
                    stops.clear()
                after = stops[stop] = self._direct([stop])[0]
            # The word without its stop is likely to come by itself as well.
            ids = held.get(stem)
            if ids is None:
                ids = held[stem] = self._letters(stem)
            held[w] = ids + after
        if other:
            held.update(zip(other, self._direct(other)))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text (UTF-8) as little-endian unsigned 32-bit integers."""
        if not self.by_words:
            return [np.frombuffer(x, dtype="<u4") for x in self._direct([t.decode() for t in texts])]
        lowered = pa.array([t if b"<|" in t else t.lower() for t in texts], pa.large_binary()).cast(pa.large_string())
        split = pc.ascii_split_whitespace(lowered)
        at = split.offsets.to_numpy()
        coded = split.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
        # Texts that begin or end with white space, or have nothing else, give empty words.
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        held = self.held.fill(set(words), self._learn)
        found = [held[w] for w in words]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        flat, begins = np.frombuffer(b"".join(found), dtype="<u4"), np.cumsum(sizes) - sizes
        code = coded.indices.to_numpy()
        n = sizes[code]
        ends = np.concatenate(([0], np.cumsum(n)))
        ids = flat[np.repeat(begins[code] - ends[:-1], n) + np.arange(ends[-1])]
        cuts = ends[at - at[0]].tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """This worker's encoder for a vocabulary file; it stays between tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _groups(batch: pa.RecordBatch, column: int, most: int = 4_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of rows with at most `most` bytes of text, or one row: (first row, texts)."""
    texts, size, first = [], 0, 0
    for i, t in enumerate(batch.column(column).cast(pa.large_binary())):
        t = t.as_py() or b""
        if texts and size + len(t) > most:
            yield first, texts
            texts, size, first = [], 0, i
        texts.append(t)
        size += len(t)
    if texts:
        yield first, texts


def write_records(
    docs: DataFrame,
    vocabulary: str,
    folder: str | None = None,
    end_id: int = 1,
    file_mb: int = 16,
    parts: int | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Writes the records and gives the stored manifest: part, seq, path, n_records, n_ids, start.

    `start` is the number of ids in all files before. `folder` is a URI that
    every executor can write to; it defaults to one under the shared folder.
    """
    spark = docs.sparkSession
    folder = (folder or f"{shared_dir(spark).rstrip('/')}/records-{uuid.uuid4().hex}").rstrip("/")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("tie")
    )
    ranged = ranged.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_encoder(vocabulary), np.array([end_id], dtype="<u4")
        context = TaskContext.get()
        part, own = context.partitionId(), f"{context.partitionId():06d}-{uuid.uuid4().hex}"
        store, root = store_of(folder)
        store.create_dir(root, recursive=True)
        done: list[tuple] = []
        out, offsets, at, ids = None, [], 0, 0

        def close() -> None:
            nonlocal out
            out.close()
            name = f"{own}-{len(done):04d}"
            with store.open_output_stream(f"{root}/{name}.idx") as f:
                f.write(np.array(offsets, dtype="<u8").tobytes())
            done.append((part, len(done), f"{folder}/{name}.rec", len(offsets), ids))
            out = None

        for b in batches:
            keys = b.column(0).to_pylist()
            for first, texts in _groups(b, 1):
                for key, found in zip(keys[first:], encoder.encode(texts)):
                    if out is None:
                        out = store.open_output_stream(f"{root}/{own}-{len(done):04d}.rec")
                        offsets, at, ids = [], 0, 0
                    frame = framed(packed(key, np.concatenate((found, end))))
                    out.write(frame)
                    offsets.append(at)
                    at += len(frame)
                    ids += len(found) + 1
                    if at >= file_mb << 20:
                        close()
        if out is not None:
            close()
        names = ["part", "seq", "path", "n_records", "n_ids"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        columns = zip(*done) if done else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=names)

    manifest = written(spark, ranged.select("doc_id", "text").mapInArrow(run, "part long, seq long, path string, n_records long, n_ids long"), "manifest")
    # One row per part first, then within parts: no task holds more than that.
    by_part = manifest.groupBy("part").agg(F.sum("n_ids").alias("in_part"))
    before = by_part.select("part", (F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).alias("part_start"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    return manifest.join(before, "part").withColumn("start", F.col("part_start") + inside).drop("part_start")


def read_records(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every record, checked; `ids` as little-endian bytes."""
    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for b in batches:
            for path, n_records, start in zip(*(b.column(i).to_pylist() for i in range(3))):
                store, where = store_of(path)
                rows, seen, held = [], 0, 0
                with store.open_input_stream(where) as f:
                    for body in unframed(f.read):
                        key, ids = unpacked(body)
                        rows.append((key, start, len(ids), ids.tobytes()))
                        start, seen, held = start + len(ids), seen + 1, held + ids.nbytes
                        if held > 4_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                            rows, held = [], 0
                if seen != n_records:
                    raise DamagedRecord(f"{path} has {seen} records, not {n_records}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return manifest.select("path", "n_records", "start").repartition(n, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def shuffled(path: str, seed: int, n: int | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
    """Records of one file in a random order by its index, or the first `n` of that order."""
    store, where = store_of(path)
    with store.open_input_stream(where.removesuffix(".rec") + ".idx") as f:
        offsets = np.frombuffer(f.read(), dtype="<u8")
    order = np.random.default_rng(seed).permutation(len(offsets))[:n]
    with store.open_input_file(where) as f:
        for at in offsets[order].tolist():
            f.seek(at)
            body = next(unframed(f.read))
            yield unpacked(body)


def ids_crc32(ids: str = "ids"):
    """The unsigned CRC-32 of the ids' bytes, as Spark has it."""
    return F.crc32(F.col(ids))
