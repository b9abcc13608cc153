"""Token ids in flat unsigned integer files, with 64-bit document offsets.

Texts are ranged and sorted by document id and encoded there; where the corpus
is to stay shuffled, texts are encoded where they are read, each copy once, and
their ids are ranged and sorted by a hash.  Each range becomes one shard of
three files: ``N.ids`` (little-endian unsigned integers,
as narrow as the vocabulary allows: 16 or 32 bits), ``N.idx`` (unsigned 64-bit
offsets of its documents in ids of the shard, one more than documents) and
``N.doc`` (64-bit document ids); where documents have no id, ``N.nil`` lists
their places.  A shard's base, the ids before it in the whole corpus, is a
prefix sum over the shards' totals.  Readers map the files into memory.

Files grow batch by batch under a temporary name and are renamed when whole,
so a shard never is in memory, and a task that is lost or run twice leaves one
whole shard.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import drop_table, each, lean, materialize, scratch_path, text_of

END_ID = 2
#: Bytes of text encoded at once; a longer text is a batch of its own.
BATCH_BYTES = 2_000_000
#: Bytes of distinct pieces that a task remembers, about; beyond that it starts anew.
MEMORY = 64_000_000
#: What a piece costs besides its letters.
PIECE = 110
#: Bytes of text or ids in a shard, about.
SHARD_BYTES = 256_000_000
#: Ids that a reader handles at once; a longer document is handled alone.
READ_IDS = 2_000_000
SEED = 23
#: Pieces without apostrophes and of Latin letters, digits and marks only; and their parts.
PLAIN = re.compile("[!-&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
PARTS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
PROBE_PARTS = ["abc", "Abc,d", "12", "x9!!", "\u00c9t\u00e9.", "a$$$", "--", "u.34@mail7.example.com", "_a_1", "\u00dcber-\u00df", "(a)[b]{c}", "#&*/\\\"<>^`|~"]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of whole texts, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    Where the tokenizer's pre-tokenizer never joins what white space parts,
    texts are split at spaces and line ends and each distinct piece is encoded
    once; where it parts letters, digits and marks too, plain pieces (Latin
    letters, digits, marks, no apostrophe) are put together from those, each
    of which goes straight to the library's model.  Both are tried out on
    samples when the tokenizer is opened; a tokenizer that differs on any gets
    whole texts.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.width = np.dtype("<u2" if self.library.get_vocab_size(with_added_tokens=True) <= 2**16 else "<u4")
        self.letters, self.by_part = _byte_letters(), True
        self._forget()
        probe = ["ab cd", "ab  cd\nef", " ab, c.d 12 ", "don't  stop\n\n", "\u00e9 \u00fc\tx", "<|endoftext|> a"]
        self.by_piece = all(self.whole(t) == [i for p in t.replace("\n", " ").split(" ") for i in self.whole(p)] for t in probe)
        self.by_part = self.by_piece and all(self.whole(t) == self._plain(t) for t in PROBE_PARTS)
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.starts, self.sizes, self.held = array("I"), array("q"), array("q"), 0

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _plain(self, piece: str) -> list[int]:
        parts = PARTS.findall(piece.lower())
        if len(parts) == 1 and parts[0] == piece:
            return [t.id for t in self.library.model.tokenize(piece if piece.isascii() else "".join(self.letters[b] for b in piece.encode()))]
        out: list[int] = []
        for p in parts:
            i = self.at(p)
            out += self.flat[self.starts[i] : self.starts[i] + self.sizes[i]]
        return out

    def at(self, piece: str) -> int:
        """Number of a piece among those remembered."""
        i = self.index.get(piece)
        if i is None:
            ids = self._plain(piece) if self.by_part and PLAIN.fullmatch(piece) and "<|" not in piece else self.whole(piece)
            i = self.index[piece] = len(self.starts)
            self.starts.append(len(self.flat))
            self.sizes.append(len(ids))
            self.flat.extend(ids)
            self.held += PIECE + len(piece) + 4 * len(ids)
        return i

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the number of each text."""
        if not self.by_piece:
            each = [np.asarray(e.ids, dtype=np.uint32) for e in self.library.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([*each, np.zeros(0, np.uint32)]), np.array([len(e) for e in each], dtype=np.int64)
        pieces = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " "), " ")
        counts = pc.list_value_length(pieces).to_numpy().astype(np.int64)
        coded = pc.list_flatten(pieces).dictionary_encode()
        del pieces
        words = coded.dictionary.to_pylist()
        if self.held > MEMORY:
            self._forget()
        nr = np.fromiter(map(self.at, words), dtype=np.int64, count=len(words))
        at = nr[coded.indices.to_numpy()]
        n = np.array(self.sizes, dtype=np.int64)[at]
        starts = np.array(self.starts, dtype=np.int64)[at]
        total = np.cumsum(n)
        out = np.array(self.flat, dtype=np.uint32)[np.repeat(starts - (total - n), n) + np.arange(int(total[-1]) if len(total) else 0)]
        edges = np.concatenate([[0], total])
        ends = np.cumsum(counts)
        return out, edges[ends] - edges[ends - counts]


def _byte_letters() -> list[str]:
    """The letter that a byte-level vocabulary writes for each byte: itself if it prints, else the next from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def _files(uri: str):
    """File system and path of a URI or plain path; local, HDFS or an object store."""
    from pyarrow import fs

    if "://" not in uri:
        uri = uri[5:] if uri.startswith("file:") else uri
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


class _Out:
    """A file that grows under a temporary name until it is whole."""

    def __init__(self, uri: str) -> None:
        self.store, self.path = _files(uri)
        self.store.create_dir(os.path.dirname(self.path), recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}"
        self.to = self.store.open_output_stream(self.part, compression=None)

    def write(self, data: np.ndarray) -> None:
        if data.size:
            self.to.write(memoryview(np.ascontiguousarray(data)).cast("B"))

    def close(self) -> None:
        self.to.close()
        self.store.move(self.part, self.path)


class _In:
    """The numbers of a file: mapped into memory where the file is local, else read as they are asked for."""

    def __init__(self, uri: str, kind: str) -> None:
        from pyarrow import fs

        store, path = _files(uri)
        self.kind, self.file, self.all = np.dtype(kind), None, None
        if isinstance(store, fs.LocalFileSystem):
            self.all = np.memmap(path, dtype=kind, mode="r") if os.path.getsize(path) else np.zeros(0, kind)
        else:
            self.file = store.open_input_file(path)

    def __getitem__(self, at: slice) -> np.ndarray:
        if self.all is not None:
            return self.all[at]
        return np.frombuffer(self.file.read_at((at.stop - at.start) * self.kind.itemsize, at.start * self.kind.itemsize), dtype=self.kind)


def _map(uri: str, kind: str) -> np.ndarray:
    """The numbers of a local file, mapped into memory."""
    return _In(uri, kind).all


CODED = "doc_id long, h long, n long, n_ids long, width int, ids binary"


def _encoder(tokenizer: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of doc_id, h, n, text with ids instead of the text: whole documents with their end ids, ``width`` bytes an id."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        lean()
        enc = None
        for batch in batches:
            t = batch.column(3)
            ends, a = np.cumsum(pc.binary_length(t).to_numpy(zero_copy_only=False)), 0
            while a < len(t):
                enc = enc or Encoder(tokenizer)
                z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BATCH_BYTES, side="right")))
                flat, n = enc.texts(t.slice(a, z - a))
                ids = np.insert(flat.astype(enc.width), np.cumsum(n), end_id)
                edges = np.concatenate([[0], np.cumsum((n + 1) * enc.width.itemsize)])
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), z - a, [None, pa.py_buffer(edges.astype("<i8").tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, z - a) for i in range(3)), pa.array(n + 1, pa.int64()), pa.array(np.full(z - a, enc.width.itemsize), pa.int32()), data.cast(pa.binary())], ["doc_id", "h", "n", "n_ids", "width", "ids"])
                a = z
        del enc
        lean()

    return encode


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int = END_ID, shards: int | None = None,
                 id_col: str = "doc_id", text_col: str = "text", shuffled: bool = False, seed: int = SEED) -> DataFrame:
    """Write the files below ``out``; returns their table: shard, base, n_docs, n_ids, n_null, width, path.

    Ascending ids; null ids stand first; rows of one id stand by a hash of
    their texts.  With ``shuffled`` documents stand by a hash of ``seed``, id, text and
    the number of the copy instead, so that copies of a document are dealt over
    the files.  Null and empty texts are the end id alone.  Long texts are
    encoded whole.  An empty table gives no files.  Other columns are not read.
    The table has a row per shard and comes from the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    h = F.xxhash64("text").alias("h")
    encode = _encoder(tokenizer, end_id)
    # few large shards: what a task has learnt of its words serves more text
    least = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 2)
    if shuffled:  # copies are counted before they are moved, and encoded once
        rows = rows.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("n")).select("doc_id", h, "n", "text")
        coded = materialize(rows.mapInArrow(encode, CODED), "coded")
        size, by = F.col("n") * F.col("n_ids") * F.col("width"), ["at", "doc_id", "h"]
        rows = each(coded, "n", "nr")
        rows = rows.withColumn("at", F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "h", "nr"))
    else:
        coded = rows = rows.select("doc_id", h, F.lit(1).cast("long").alias("n"), "text")
        size, by = F.octet_length("text"), ["doc_id", "h"]
    parts = shards or max(least, -(-int(coded.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]) // SHARD_BYTES))
    ordered = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lean()
        shard = TaskContext.get().partitionId()
        path = f"{out}/{shard:06d}"
        files: dict[str, _Out] = {}
        n_docs = n_ids = width = 0
        nil = []
        for b in batches:
            if not len(b):
                continue
            b = b.select(["doc_id", "width", "ids"])
            if not files:
                files = {k: _Out(f"{path}.{k}") for k in ("ids", "idx", "doc")}
                files["idx"].write(np.zeros(1, "<u8"))
                width = b.column(1)[0].as_py()
            data = b.column(2)
            edges = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(b) + 1].astype(np.int64)
            if edges[-1] > edges[0]:
                files["ids"].write(np.frombuffer(data.buffers()[2], np.uint8)[edges[0] : edges[-1]])
            ends = n_ids + (edges[1:] - edges[0]) // width
            files["idx"].write(ends.astype("<u8"))
            d = b.column(0)
            files["doc"].write(d.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
            if d.null_count:
                nil.append(n_docs + np.flatnonzero(d.is_null().to_numpy(zero_copy_only=False)))
            n_docs, n_ids = n_docs + len(b), int(ends[-1])
        if files:
            if nil:
                files["nil"] = _Out(f"{path}.nil")
                files["nil"].write(np.concatenate(nil).astype("<u8"))
            for f in files.values():
                f.close()
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64()),
                "n_null": pa.array([sum(map(len, nil))], pa.int64()), "width": pa.array([width], pa.int32()), "path": [path]})
        lean()

    made = ordered.select("doc_id", "width", "ids") if shuffled else ordered.select("doc_id", "h", "n", "text")
    made = made.mapInArrow(write if shuffled else lambda batches: write(encode(batches)), "shard int, n_docs long, n_ids long, n_null long, width int, path string")
    table, base = [], 0
    for r in sorted(made.collect()):  # a row per shard
        table.append((r.shard, base, r.n_docs, r.n_ids, r.n_null, r.width, r.path))
        base += r.n_ids
    drop_table(coded)
    return spark.createDataFrame(table, "shard int, base long, n_docs long, n_ids long, n_null long, width int, path string")


def read_tokens(table: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, idx, doc = (_In(f"{r['path']}.{k}", t) for k, t in (("ids", f"<u{r['width']}"), ("idx", "<u8"), ("doc", "<i8")))
                nil = _In(r["path"] + ".nil", "<u8")[0 : r["n_null"]] if r["n_null"] else np.zeros(0, "<u8")
                a = 0
                while a < r["n_docs"]:
                    edges = np.asarray(idx[a : min(a + 10_000, r["n_docs"]) + 1]).astype(np.int64)
                    z = a + max(1, int(np.searchsorted(edges, edges[0] + READ_IDS, side="right")) - 1)
                    edges = edges[: z - a + 1]
                    here = ids[int(edges[0]) : int(edges[-1])]
                    crc = [zlib.crc32(here[i - edges[0] : j - edges[0]].astype("<u4").tobytes()) for i, j in zip(edges[:-1], edges[1:], strict=True)]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(np.asarray(doc[a:z]), pa.int64(), mask=np.isin(np.arange(a, z), nil)),
                        "start": pa.array(edges[:-1] + r["base"], pa.int64()), "n_tokens": pa.array(np.diff(edges), pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64())})
                    a = z

    spark: SparkSession = table.sparkSession
    spread = table.repartition(max(1, spark.sparkContext.defaultParallelism), "shard")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_binary(docs: DataFrame, tokenizer: str | None = None, out: str | None = None, **kw) -> DataFrame:
    """Write the token files of ``docs`` (below the shared folder, unless ``out`` names another) and read them back."""
    out = out or scratch_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, out, tokenizer or tokenizer_path(), **kw))
