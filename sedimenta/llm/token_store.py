"""Token ids as binary shards with a minimal perfect hash index.

``write`` puts documents in ascending id order (ranges of ids, sorted), encodes
them and writes one shard a range:

    payload  the ids of all documents, each ``width`` bytes, little-endian
    table    per document: key (8 bytes, signed; 0 for a null id), ids (8 bytes, unsigned)
    trailer  8 bytes "SEDTOK02", then little-endian unsigned: width (4 bytes),
             documents (8), ids (8), documents of null id, which are the last (8)

The index is cut into buckets by a hash of the key.  A bucket's minimal perfect
hash is a cascade of bit arrays: a key whose hash is alone at a level has its
bit set there and others go on to the next level; the number of set bits in
front of it is its slot, and slots hold a 32-bit fingerprint, shard, offset, ids,
row and rows of the key.  ``Reader.get`` so reads one bucket and one piece of
payload, whatever the number of documents, and tells absent keys apart but for
one in 2**32.  ``read`` takes every document's shard, offset and length from the
index too: the shards' keys are dealt to the buckets, found there by slot and
fingerprint (a key that is not is an error), and payloads are read at the
offsets found.  Null ids have no key; the manifest says where they begin.

Shards and buckets are written under other names first and then moved, and a
retried task writes the same bytes; what a lost task left under such a name is
deleted when its job has ended.  Workers reach files through Arrow's file
systems; Hadoop resolves the path on the driver first, so that a path without a
scheme, or of a view, is the same store for all.

Defined results: a null or empty text has no ids but the end id; a very long
text is encoded in blocks but is one document; null ids come last; rows that
share an id are in the order of a hash of their texts, may fill several shards,
and the index names the first and their number; an empty table has no shards
and no rows; other columns are not read.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm.pieces import REMEMBERED, PieceIds
from sedimenta.llm.shared import new_path
from sedimenta.llm.wordhash import U64, mix

VOCABULARY = "byte_bpe_50k.json"
MAGIC = b"SEDTOK02"
HEAD = struct.Struct("<8sIQQQ")
END_ID = 0
#: Bytes of text that a shard has about, where there are more than the session's shuffle partitions hold.
SHARD_BYTES = 256 << 20
#: Bytes of payload that a reader fetches at a time.
WINDOW_BYTES = 4 << 20
#: Keys that an index bucket has about.
BUCKET_KEYS = 100_000
SLOT = np.dtype([("print", "<u4"), ("shard", "<u4"), ("at", "<u8"), ("ids", "<u8"), ("row", "<u8"), ("rows", "<u8")])


def _fs(uri: str):
    from pyarrow import fs

    scheme, _, rest = uri.partition("://")
    if not rest:
        raise ValueError(f"a path of a store has a scheme: {uri}")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + "://" + rest)


def resolved(spark: SparkSession, uri: str) -> str:
    """The folder as Hadoop resolves it, with its scheme; it is made if it is not there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path)
    found = store.resolvePath(path).toString()
    return "file://" + found[5:] if found.startswith("file:/") and not found.startswith("file://") else found


def put(uri: str, chunks: Iterator[bytes]) -> int:
    """Write a file under a temporary name and move it to its own; returns its bytes."""
    store, path = _fs(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part, n = f"{path}.{uuid.uuid4().hex}.part", 0
    with store.open_output_stream(part) as f:
        for c in chunks:
            f.write(c)
            n += len(c)
    store.move(part, path)
    return n


def fetch(uri: str, at: int = 0, n: int | None = None) -> bytes:
    store, path = _fs(uri)
    with store.open_input_file(path) as f:
        f.seek(at)
        return f.read() if n is None else f.read(n)


class Encoder:
    """Whole texts to ids by the tokenizers library, with an end id after each text."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.width = 2 if max(vocabulary.values(), default=0) < 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for t, i in vocabulary.items():
            self.bytes_of[i] = len(t)  # one character of a token stands for one byte
        special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.encode = PieceIds(self._pieces, self.kind, special, END_ID, remembered).encode

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.kind) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, raw: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece: those that begin with one space and end in a visible ASCII character in rows, cut by their tokens' bytes."""
        out: list = [None] * len(raw)
        rows, alone = [], []
        for i, x in enumerate(raw):
            (rows if len(x) > 1 and x[0] == 32 and 32 < x[1] < 127 and 32 < x[-1] < 127 else alone).append(i)
        for i, ids in zip(alone, self._ids([raw[i].decode() for i in alone])):
            out[i] = ids
        for a in range(0, len(rows), 512):
            some = rows[a : a + 512]
            ids = self._ids([b"".join([raw[i] for i in some]).decode()])[0]
            ends = np.cumsum(self.bytes_of[ids])
            cut = np.searchsorted(ends, np.cumsum([len(raw[i]) for i in some])) + 1
            for i, part in zip(some, np.split(ids, cut[:-1])):
                out[i] = part
        return out


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary."""
    return Encoder(path)


# the index


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: levels of bits, ranks by counting."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # packed bits
        self.before, n = [], 0
        for b in levels:
            count = np.bitwise_count(b).astype(np.int64)
            self.before.append(n + np.concatenate([[0], np.cumsum(count)]))
            n = int(self.before[-1][-1])

    @staticmethod
    def _place(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        return (mix(keys + U64(0x9E3779B97F4A7C15 * (level + 1) & 2**64 - 1)) % U64(bits)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            bits = -(-max(64, 2 * len(keys)) // 8) * 8
            at = cls._place(keys, len(levels), bits)
            count = np.bincount(at, minlength=bits)
            alone = count[at] == 1
            mark = np.zeros(bits, np.uint8)
            mark[at[alone]] = 1
            levels.append(np.packbits(mark, bitorder="little"))
            keys = keys[~alone]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where no level has it."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for i, (bits, before) in enumerate(zip(self.levels, self.before)):
            if not len(open_):
                break
            at = self._place(keys[open_], i, 8 * len(bits))
            byte, shift = at >> 3, (at & 7).astype(np.uint8)
            hit = (bits[byte] >> shift) & 1 == 1
            b, s = byte[hit], shift[hit]
            out[open_[hit]] = before[b] + np.bitwise_count(bits[b] & ((np.uint8(1) << s) - np.uint8(1)))
            open_ = open_[~hit]
        return out


def build_bucket(keys: np.ndarray, slots: np.ndarray) -> bytes:
    """A bucket's file: number of levels and their bytes, the levels, the slots."""
    h = PerfectHash.build(keys)
    at = h.slots(keys)
    table = np.zeros(len(keys), SLOT)
    table[at] = slots
    table["print"][at] = fingerprint(keys)
    head = np.array([len(h.levels), *map(len, h.levels)], "<u8").tobytes()
    return head + b"".join(b.tobytes() for b in h.levels) + table.tobytes()


def open_bucket(raw: bytes) -> tuple[PerfectHash, np.ndarray]:
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    sizes = np.frombuffer(raw, "<u8", n, 8).astype(np.int64)
    at, levels = 8 * (n + 1), []
    for s in sizes.tolist():
        levels.append(np.frombuffer(raw, np.uint8, s, at))
        at += s
    return PerfectHash(levels), np.frombuffer(raw, SLOT, -1, at)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ U64(0x6A09E667F3BCC909)) >> U64(32)).astype(np.uint32)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (((mix(keys ^ U64(0xBB67AE8584CAA73B)) >> U64(32)) * U64(buckets)) >> U64(32)).astype(np.int32)


# writing

NULLS = -1  # the bucket of entries that have no key
ENTRY = "bucket int, key long, shard long, at long, ids long, row long, rows long, documents long, total long"


def _write_shard(batches: Iterator[pa.RecordBatch], uri: str, vocabulary: str, buckets: int) -> Iterator[pa.RecordBatch]:
    """Write one task's documents, which come in order; yields the index entries and the shard's totals."""
    from pyspark import TaskContext

    e, shard = encoder(vocabulary), TaskContext.get().partitionId()
    keys, counts, nulls = [], [], 0

    def payload() -> Iterator[bytes]:
        nonlocal nulls
        for batch in batches:
            ids = batch.column(0)
            for out, n in e.encode(batch.column(1)):
                counts.append(n)
                yield out.tobytes()
            nulls += ids.null_count
            keys.append(np.array(ids.fill_null(0).to_numpy(zero_copy_only=False), np.int64))

    store, path = _fs(f"{uri}/shard-{shard:06d}.tok")
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as f:
        for c in payload():
            f.write(c)
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        n = np.concatenate(counts).astype(np.int64) if counts else np.zeros(0, np.int64)
        f.write(np.stack([key.view(U64), n.view(U64)], 1).astype("<u8").tobytes())
        f.write(HEAD.pack(MAGIC, e.width, len(key), int(n.sum()), nulls))
    if not len(key):
        store.delete_file(part)
        return
    store.move(part, path)
    at = np.concatenate([[0], np.cumsum(n)])[:-1]
    named = len(key) - nulls
    new = np.concatenate([[True], key[1:] != key[:-1]])
    new[named:] = False
    if nulls:
        new[named] = True
    first = np.flatnonzero(new)
    bucket = np.where(first < named, bucket_of(key[first].view(U64), buckets), NULLS)
    columns = [bucket, key[first], np.full(len(first), shard), at[first], n[first], first, np.diff(first, append=len(key)), np.full(len(first), len(key)), np.full(len(first), int(n.sum()))]
    names = [c.split(" ")[0] for c in ENTRY.split(", ")]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if m == "bucket" else pa.int64()) for m, c in zip(names, columns)], names)


def write(docs: DataFrame, uri: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> dict:
    """Write shards, index and manifest under ``uri``; returns the manifest.

    ``shards`` defaults to the number of shuffle partitions, or more where
    they would hold over SHARD_BYTES of text.
    """
    spark = docs.sparkSession
    uri = resolved(spark, uri)
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    total = d.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    buckets = max(1, -(-total["n"] // BUCKET_KEYS))
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total["bytes"] or 0) // SHARD_BYTES))
    entries_at = new_path(spark, "entries")
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()]
    (
        d.repartitionByRange(shards, *order)
        .sortWithinPartitions(*order)
        .mapInArrow(lambda it: _write_shard(it, uri, vocabulary, buckets), ENTRY)
        .write.parquet(entries_at)
    )
    entries = spark.read.parquet(entries_at)

    def index(t: pa.Table) -> pa.Table:
        t = t.sort_by([("key", "ascending"), ("shard", "ascending")])
        key = t.column("key").to_numpy()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))  # a key's rows may go on in the next shards
        slots = np.zeros(len(first), SLOT)
        for name in ("shard", "at", "ids", "row"):
            slots[name] = t.column(name).to_numpy()[first]
        slots["rows"] = np.add.reduceat(t.column("rows").to_numpy(), first)
        b = t.column("bucket")[0].as_py()
        n = put(f"{uri}/index-{b:06d}.mph", iter([build_bucket(key[first].view(U64), slots)]))
        return pa.table({"bucket": pa.array([b], pa.int32()), "bytes": pa.array([n], pa.int64())})

    entries.where(F.col("bucket") != NULLS).groupBy("bucket").applyInArrow(index, "bucket int, bytes long").agg(F.sum("bytes")).collect()
    # one row a shard
    per_shard = entries.groupBy("shard").agg(F.first("documents").alias("documents"), F.first("total").alias("ids")).orderBy("shard").collect()
    nulls = entries.where(F.col("bucket") == NULLS).select("shard", "at", "row", "rows").orderBy("shard").collect()
    starts = np.concatenate([[0], np.cumsum([r["ids"] for r in per_shard])]).astype(int).tolist()
    manifest = {
        "buckets": buckets,
        "shards": [{"shard": r["shard"], "documents": r["documents"], "ids": r["ids"], "start": s} for r, s in zip(per_shard, starts)],
        "nulls": [r.asDict() for r in nulls],
    }
    put(f"{uri}/manifest.json", iter([json.dumps(manifest).encode()]))
    store, path = _fs(uri)
    from pyarrow import fs

    for f in store.get_file_info(fs.FileSelector(path)):
        if f.path.endswith(".part"):
            store.delete_file(f.path)
    return manifest


# reading


class Shard:
    """One shard's file: its trailer, table and payload."""

    def __init__(self, uri: str, shard: int):
        store, path = _fs(f"{uri}/shard-{shard:06d}.tok")
        self.file = store.open_input_file(path)
        self.file.seek(self.file.size() - HEAD.size)
        magic, self.width, self.documents, self.total, self.nulls = HEAD.unpack(self.file.read(HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.held, self.begin = b"", 0

    def table(self, row: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and numbers of ids of some documents."""
        self.file.seek(self.width * self.total + 16 * row)
        t = np.frombuffer(self.file.read(16 * rows), "<u8").reshape(-1, 2)
        return t[:, 0].copy().view(np.int64), t[:, 1].astype(np.int64)

    def payload(self, at: int, n: int) -> np.ndarray:
        """``n`` ids from the ``at``-th on; reads ahead, since they are mostly asked for in order."""
        a, size = at * self.width, n * self.width
        if a < self.begin or a + size > self.begin + len(self.held):
            self.file.seek(a)
            self.held, self.begin = self.file.read(min(max(size, WINDOW_BYTES), self.width * self.total - a)), a
        return np.frombuffer(self.held, f"<u{self.width}", n, a - self.begin)

    def close(self) -> None:
        self.file.close()


def _keys(batches: Iterator[pa.RecordBatch], uri: str, buckets: int) -> Iterator[pa.RecordBatch]:
    """bucket, key, shard and rows of every key of the shards named."""
    for batch in batches:
        for shard in batch.column(0).to_pylist():
            f = Shard(uri, shard)
            key = f.table(0, f.documents - f.nulls)[0]
            f.close()
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket_of(key[first].view(U64), buckets)), pa.array(key[first]), pa.array(np.full(len(first), shard, np.int64)), pa.array(np.diff(first, append=len(key)))],
                ["bucket", "key", "shard", "rows"],
            )


def _look_up(t: pa.Table, uri: str) -> pa.Table:
    """Where the index says that the keys of one bucket stand; ``ids`` is -1 for rows that the table tells the length of."""
    h, slots = open_bucket(fetch(f"{uri}/index-{t.column('bucket')[0].as_py():06d}.mph"))
    key, shard = t.column("key").to_numpy(), t.column("shard").to_numpy()
    at = h.slots(key.view(U64))
    if (at < 0).any() or (slots["print"][at] != fingerprint(key.view(U64))).any():
        raise ValueError("a shard has a key that the index does not have")
    s = slots[at]
    here = s["shard"] == shard  # in the key's other shards its rows begin the shard
    rows = t.column("rows").to_numpy()
    return pa.table(
        {
            "key": key,
            "shard": shard,
            "at": np.where(here, s["at"], 0).astype(np.int64),
            "ids": np.where(here & (s["rows"] == 1), s["ids"].astype(np.int64), -1),
            "row": np.where(here, s["row"], 0).astype(np.int64),
            "rows": rows,
        }
    )


def read(spark: SparkSession, uri: str, digest_only: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids (or, with ``digest_only``, ids_crc32 of the ids as 4-byte numbers) of every document."""
    uri = resolved(spark, uri)
    manifest = json.loads(fetch(f"{uri}/manifest.json"))
    starts = {s["shard"]: s["start"] for s in manifest["shards"]}
    buckets, shards = manifest["buckets"], max(1, len(starts))
    last = "ids_crc32 long" if digest_only else "ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64() if digest_only else pa.list_(pa.int32()))

        def batch(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["doc_id", "start", "n_tokens", last.split(" ")[0]])

        f, now, out, held = None, None, [], 0
        for b in batches:
            for key, shard, at, ids, row, rows in zip(*(c.to_pylist() for c in b.columns)):
                if shard != now:
                    if f:
                        f.close()
                    f, now = Shard(uri, shard), shard
                for n in [ids] if ids >= 0 else f.table(row, rows)[1].tolist():
                    x = f.payload(at, n)
                    out.append((key, starts[shard] + at, n, zlib.crc32(x.astype("<u4").tobytes()) if digest_only else x.astype(np.int32)))
                    at += n
                    held += n
                    if held > 1 << 20:
                        yield batch(out)
                        out, held = [], 0
        if out:
            yield batch(out)
        if f:
            f.close()

    listed = spark.createDataFrame([(s,) for s in starts] or [(0,)], "shard long").where(F.lit(bool(starts))).repartition(shards, "shard")
    found = (
        listed.mapInArrow(lambda it: _keys(it, uri, buckets), "bucket int, key long, shard long, rows long")
        .groupBy("bucket")
        .applyInArrow(lambda t: _look_up(t, uri), "key long, shard long, at long, ids long, row long, rows long")
    )
    if manifest["nulls"]:  # one row a shard at most
        nulls = [(None, r["shard"], r["at"], -1, r["row"], r["rows"]) for r in manifest["nulls"]]
        found = found.union(spark.createDataFrame(nulls, found.schema))
    return found.repartition(shards, "shard").sortWithinPartitions("shard", "at", "row").mapInArrow(run, f"doc_id long, start long, n_tokens long, {last}")


class Reader:
    """Constant-time access to one document's ids by its key."""

    def __init__(self, uri: str):
        self.uri, self.manifest = uri, json.loads(fetch(f"{uri}/manifest.json"))
        self.bucket = lru_cache(64)(lambda b: open_bucket(fetch(f"{uri}/index-{b:06d}.mph")))

    def get(self, key: int | None) -> np.ndarray | None:
        """Ids of the (first) document of that key, None if there is none."""
        if key is None:
            if not self.manifest["nulls"]:
                return None
            first = self.manifest["nulls"][0]
            f = Shard(self.uri, first["shard"])
            at, n = first["at"], int(f.table(first["row"], 1)[1][0])
        else:
            if not any(s["documents"] for s in self.manifest["shards"]):
                return None
            k = np.array([key], np.int64).view(U64)
            b = int(bucket_of(k, self.manifest["buckets"])[0])
            try:
                h, slots = self.bucket(b)
            except FileNotFoundError:  # no key fell there
                return None
            slot = int(h.slots(k)[0])
            if slot < 0 or slots[slot]["print"] != fingerprint(k)[0]:
                return None
            s = slots[slot]
            f, at, n = Shard(self.uri, int(s["shard"])), int(s["at"]), int(s["ids"])
        out = f.payload(at, n)
        f.close()
        return out


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    uri = new_path(spark, "tokens")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), uri, public_tokenizers.path(VOCABULARY))
    return read(spark, uri, digest_only=True)
