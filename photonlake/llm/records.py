"""Token IDs as length-delimited binary records with masked checksums and a separate offset index.

A record file is a run of frames, each

    length of the payload    8 bytes, little-endian
    masked CRC-32C of those  4 bytes
    payload                  doc_id 8 bytes, flags 4, number of ids 4, the ids, zeros up to a multiple of 4
    masked CRC-32C of it     4 bytes

Ids take 2 bytes each where the vocabulary allows it, else 4 (flags, bit 0); bit 1 of the flags marks a null doc_id.
Beside each record file stands an index of 16 bytes a record: the frame's offset and its number of ids. A reader
that wants shuffled records seeks by it; a whole read needs it only to check its counts.
"""

from __future__ import annotations

import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHES, AtomicFile, Workspace, filesystem, mapped

#: Fixed values of CRC-32C (reflected polynomial) and of its mask in record files.
POLYNOMIAL = 0x82F63B78
MASK = 0xA282EAD8

WIDE, NULL_ID = 1, 2
CHUNK = 256  # words of 4 bytes
HEAD = np.dtype([("length", "<u8"), ("crc", "<u4"), ("doc_id", "<i8"), ("flags", "<u4"), ("n", "<u4")])


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1)
    return table


def _word_tables() -> np.ndarray:
    """tables[k][b]: what byte k of a word, of value b, adds to the checksum once the word is passed."""
    one = _byte_table()
    tables = [one]
    for _ in range(3):
        tables.append(one[tables[-1] & 255] ^ (tables[-1] >> 8))
    return np.stack(tables[::-1])


_TABLES = _word_tables()


def _pass(state: np.ndarray, words: np.ndarray) -> np.ndarray:
    x = state ^ words
    return _TABLES[0][x & 255] ^ _TABLES[1][(x >> 8) & 255] ^ _TABLES[2][(x >> 16) & 255] ^ _TABLES[3][x >> 24]


def _chunk_shift() -> np.ndarray:
    """Tables for moving a state past a chunk of zeros, a byte of the state each."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(CHUNK):
        bits = _pass(bits, np.uint32(0))
    out = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for b in range(256):
            out[k][b] = np.bitwise_xor.reduce(bits[[8 * k + j for j in range(8) if b >> j & 1]], initial=np.uint32(0))
    return out


_SHIFT = _chunk_shift()


def masked_crc32c(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The masked CRC-32C of each run of 4-byte words, computed over many runs at a time.

    A run is a first piece shorter than a chunk and then whole chunks. Chunks are independent until their states
    are put together, so all of them advance a word at a time side by side.
    """
    state = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    rest, n_chunks = lengths % CHUNK, lengths // CHUNK
    order = np.argsort(-rest, kind="stable")
    by_rest = np.sort(rest)
    for j in range(int(rest.max(initial=0))):
        now = order[: len(rest) - np.searchsorted(by_rest, j, side="right")]
        state[now] = _pass(state[now], words[starts[now] + j])
    if total := int(n_chunks.sum()):
        owner = np.repeat(np.arange(len(starts)), n_chunks)
        nth = np.arange(total) - np.repeat(np.cumsum(n_chunks) - n_chunks, n_chunks)
        first = starts[owner] + rest[owner] + nth * CHUNK
        raw = np.zeros(total, np.uint32)
        for j in range(CHUNK):
            raw = _pass(raw, words[first + j])
        for k in range(int(n_chunks.max())):
            here = nth == k
            s = state[owner[here]]
            moved = _SHIFT[0][s & 255] ^ _SHIFT[1][(s >> 8) & 255] ^ _SHIFT[2][(s >> 16) & 255] ^ _SHIFT[3][s >> 24]
            state[owner[here]] = moved ^ raw[here]
    crc = ~state
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK)


def frames(doc_ids: list, ids: list[np.ndarray], wide: bool) -> tuple[bytes, np.ndarray]:
    """The frames of some records, and the offset of each."""
    kind, per_word = (np.dtype("<u4"), 1) if wide else (np.dtype("<u2"), 2)
    n = np.array([len(x) for x in ids], np.int64)
    body = -(-n // per_word)
    total = 3 + 4 + body + 1  # words: length and checksum, head, ids, checksum
    starts = np.cumsum(total) - total
    words = np.zeros(int(total.sum()), "<u4")
    length = 16 + 4 * body
    words[starts], words[starts + 1] = length & 0xFFFFFFFF, length >> 32
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8").view("<u8")
    words[starts + 3], words[starts + 4] = keys & 0xFFFFFFFF, keys >> np.uint64(32)
    words[starts + 5] = [WIDE * wide | NULL_ID * (d is None) for d in doc_ids]
    words[starts + 6] = n
    flat = words.view(kind)
    for s, x in zip((starts + 7) * per_word, ids):
        flat[s : s + len(x)] = x
    words[starts + 2] = masked_crc32c(words, starts, np.full(len(starts), 2))
    words[starts + total - 1] = masked_crc32c(words, starts + 3, total - 4)
    return words.tobytes(), starts * 4


def read_frames(stream, chunk_bytes: int = 1 << 22) -> Iterator[list[tuple]]:
    """Lists of (doc_id, ids) from a record file, read in pieces; damage raises. A long record is gathered once."""
    held, wanted = bytearray(), chunk_bytes
    while True:
        while len(held) < wanted and (piece := stream.read(max(chunk_bytes, wanted - len(held)))):
            held += piece
        at, found = 0, []
        while len(held) - at >= 12:
            length = int.from_bytes(held[at : at + 8], "little")
            if length % 4 or length < 16:
                raise ValueError("a frame has an impossible length")
            if len(held) - at < 16 + length:
                break
            found.append((at // 4, length // 4))
            at += 16 + length
        if not found:
            if held and len(held) >= wanted:
                wanted = 16 + int.from_bytes(held[:8], "little")
                if len(held) < wanted:
                    continue
            if held:
                raise ValueError("the file ends inside a frame")
            return
        words = np.frombuffer(bytes(held[:at]), "<u4")
        del held[:at]
        wanted = chunk_bytes
        starts, lengths = np.array([x for x, _ in found]), np.array([x for _, x in found])
        good = (masked_crc32c(words, starts, np.full(len(starts), 2)) == words[starts + 2]) & (masked_crc32c(words, starts + 3, lengths) == words[starts + 3 + lengths])
        if not good.all():
            raise ValueError("a frame's checksum is wrong")
        out = []
        for s, size in found:
            key = int(words[s + 3 : s + 5].view("<i8")[0])
            flags, n = int(words[s + 5]), int(words[s + 6])
            own = words[s + 7 : s + 3 + size]
            out.append((None if flags & NULL_ID else key, own[:n] if flags & WIDE else own.view("<u2")[:n]))
        yield out


#: Words whose ids a worker keeps at least.
CACHED_WORDS = 500_000


class Pieces:
    """Ids, as bytes, of what stands between two spaces, each with the space before it.

    A byte-level BPE is cut before a space that other than white space follows, and where white space begins. So a text
    is cut at its spaces, and its ids are those of its pieces in turn, unless a space has white space before it and white
    space or the end after it; such runs are cut elsewhere, and those texts are encoded as they are.

    Of the words met, the last `most` to twice as many are kept: once `most` are there they become the older half, out of
    which words that come again are taken over. A word takes some 250 bytes. Both halves are plain dicts, so that taking
    them from a set of words goes over the words alone.
    """

    LONGEST = 64
    RUNS = re.compile(r"\s (?!\S)")
    #: Words of Latin letters, with signs behind them or not: by the tokenizer's own pattern two pieces at most. An
    #: apostrophe has patterns of its own.
    LETTERS = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.now: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.signs: dict[str, bytes] = {"": b""}
        self.most = CACHED_WORDS
        self.tokenizer = Tokenizer.from_file(path)
        if type(self.tokenizer.model).__name__ != "BPE" or self.tokenizer.normalizer is not None or "ByteLevel" not in repr(self.tokenizer.pre_tokenizer):
            raise ValueError(f"{path} is no byte-level BPE, whose texts may be cut at spaces")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.kind = np.dtype("<u4") if self.wide else np.dtype("<u2")
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        own = re.sub(r"\s", "", repr(self.tokenizer.pre_tokenizer))
        self.model = self.tokenizer.model if own.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in own else None
        self.bytes = _byte_letters()

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def lettered(self, word: str) -> bytes:
        """The ids of a word of letters with a space before it, which the pattern leaves whole."""
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(self.bytes)
        ids = [t.id for t in self.model.tokenize(self.bytes[32] + letters)]
        return struct.pack("<%d%s" % (len(ids), "I" if self.wide else "H"), *ids)

    def words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words with a space before each."""
        if not self.model:
            return self.together(words)
        out, others = {}, []
        for w in words:
            m = self.LETTERS.fullmatch(w)
            if not m:
                others.append(w)
                continue
            stem, signs = m.groups()
            own = out.get(stem) or self.now.get(stem)
            if own is None:
                out[stem] = own = self.lettered(stem)
            if signs and signs not in self.signs:
                if len(self.signs) > 10_000:
                    self.signs = {"": b""}
                self.signs[signs] = self.whole([signs])[0]
            out[w] = own + self.signs[signs]
        out.update(self.together(others))
        return out

    def together(self, words: list[str], together: int = 2000) -> dict[str, bytes]:
        """The same, many words to a text; a token with that space begins each word."""
        out, alone, plain = {}, [], []
        for w in words:
            (plain if w and not w[0].isspace() and not w[-1].isspace() else alone).append(w)
        parts = [plain[k : k + together] for k in range(0, len(plain), together)]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([" " + " ".join(p) for p in parts], add_special_tokens=False)):
            ids = np.array(e.ids, self.kind)
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) != len(part):
                alone += part
                continue
            data, at = ids.tobytes(), [*(starts * ids.itemsize).tolist(), ids.nbytes]
            out.update((w, data[a:z]) for w, a, z in zip(part, at, at[1:]))
        out.update(zip(alone, self.whole([" " + w for w in alone])))
        return out

    def clear(self) -> None:
        self.now, self.older = {}, {}

    def encode(self, texts: list[str], end: int) -> list[np.ndarray]:
        if len(self.now) > self.most:
            self.now, self.older = {}, self.now
        cut = [None if self.RUNS.search(t) or any(s in t for s in self.special) else t.split(" ") for t in texts]
        heads = self.whole([t if c is None else c.pop(0) for t, c in zip(texts, cut)])
        own = set().union(*filter(None, cut)).difference(self.now)
        self.now.update((w, self.older[w]) for w in own if w in self.older)
        new = list(own.difference(self.now))
        self.now.update(self.words(new))
        tail, ids = np.array([end], self.kind).tobytes(), self.now.__getitem__
        out = [np.frombuffer(b"".join((head, *map(ids, c or ()), tail)), self.kind) for head, c in zip(heads, cut)]
        for x in new:
            if len(x) > self.LONGEST:
                del self.now[x]
        return out


def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte: its own where it is printable, else one from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


_PIECES: dict[str, Pieces] = {}


def pieces(path: str, most: int = CACHED_WORDS) -> Pieces:
    """A worker process loads each tokenizer once; most: the words that it keeps at least."""
    if path not in _PIECES:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _PIECES[path] = Pieces(path)
        CACHES[path] = _PIECES[path]
    _PIECES[path].most = most
    return _PIECES[path]


#: The most text of a file, but for hot ranges that sampling misses.
FILE_BYTES = 128 << 20
#: Texts that are encoded and framed together.
GROUP_BYTES = 1 << 21


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
        t = t.as_py() or ""
        ids.append(d)
        texts.append(t)
        size += len(t)
        if size >= GROUP_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def write_records(documents: DataFrame, root: str, tokenizer_path: str, end: int = 0, n_files: int | None = None, cached_words: int = CACHED_WORDS) -> DataFrame:
    """Writes the encoded texts under root in ascending doc_id order and returns the manifest, a row for each file.

    Files follow each other in doc_id order, null doc_ids first; equal doc_ids stand in order of a hash of the text, and
    so may reach over several files. There are as many files as shuffle partitions, or more where these would hold over
    FILE_BYTES of text. A task writes one file under a passing name and renames it, so a task that runs again leaves the
    same file.
    """
    spark = documents.sparkSession
    if not n_files:
        size = documents.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        n_files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, out, index, n_ids = TaskContext.get().partitionId(), None, [], 0
        tok = pieces(tokenizer_path, cached_words)
        for batch in batches:
            for doc_ids, texts in _groups(batch):
                out = out or AtomicFile(f"{root}/part-{number:06d}.rec")
                ids = tok.encode(texts, end)
                data, offsets = frames(doc_ids, ids, tok.wide)
                lengths = np.array([len(x) for x in ids], "<i8")
                index.append(np.column_stack([offsets + out.size, lengths]).astype("<i8"))
                n_ids += int(lengths.sum())
                out.write(data)
        if out:
            beside = AtomicFile(f"{root}/part-{number:06d}.idx")
            beside.write(np.concatenate(index).tobytes())
            beside.commit()
            out.commit()
            yield pa.RecordBatch.from_pydict({"file_no": [number], "records": [sum(map(len, index))], "ids": [n_ids], "bytes": [out.size]})

    order = [F.col("doc_id").asc_nulls_first(), F.col("mark"), F.col("row")]
    marked = documents.select("doc_id", "text", F.xxhash64("text").alias("mark"), F.monotonically_increasing_id().alias("row"))
    rows = marked.repartitionByRange(n_files, *order).sortWithinPartitions(*order).select("doc_id", "text")
    mapped(rows, write, "file_no long, records long, ids long, bytes long", tokenizer_path).write.mode("overwrite").parquet(f"{root}/manifest")
    return spark.read.schema("file_no long, records long, ids long, bytes long").parquet(f"{root}/manifest")


def read_records(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each record, from the files; tasks take a file each.

    The manifest, a row for each file, is read on the driver for the files' first positions.
    """
    files, before = [], 0
    for r in sorted(spark.read.parquet(f"{root}/manifest").collect(), key=lambda r: r.file_no):
        files.append((r.file_no, before, r.records, r.ids))
        before += r.ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                start, seen = f["start"], 0
                where, path = filesystem(f"{root}/part-{f['file_no']:06d}.rec")
                with where.open_input_stream(path, compression=None) as stream:
                    for found in read_frames(stream):
                        n = np.array([len(x) for _, x in found], np.int64)
                        yield pa.RecordBatch.from_pydict(
                            {
                                "doc_id": pa.array([d for d, _ in found], pa.int64()), "start": start + np.cumsum(n) - n, "n_tokens": n,
                                "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for _, x in found], pa.int64()),
                            }
                        )
                        start, seen = start + int(n.sum()), seen + len(found)
                if (seen, start - f["start"]) != (f["records"], f["ids"]):
                    raise ValueError(f"file {f['file_no']} has other records than its manifest says")

    listed = spark.createDataFrame(files, "file_no long, start long, records long, ids long")
    return mapped(listed.repartitionByRange(max(1, len(files)), "file_no"), read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_shuffled(root: str, file_no: int, wanted: list[int]) -> Iterator[tuple]:
    """(doc_id, ids) of the wanted records of a file, in the order asked for, by way of its index."""
    where, path = filesystem(f"{root}/part-{file_no:06d}.idx")
    with where.open_input_file(path) as f:
        index = np.frombuffer(f.read(), "<i8").reshape(-1, 2)
    where, path = filesystem(f"{root}/part-{file_no:06d}.rec")
    with where.open_input_file(path) as f:
        for k in wanted:
            f.seek(int(index[k, 0]))
            length = int.from_bytes(f.read(8), "little")
            f.seek(int(index[k, 0]))
            for found in read_frames(io.BytesIO(f.read(16 + length))):
                yield from found


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def token_records(documents: DataFrame, root: str | None = None, tokenizer_path: str | None = None, cached_words: int = CACHED_WORDS) -> DataFrame:
    """Writes all documents as records and gives doc_id, start, n_tokens and ids_crc32 as read back.

    Null and empty text is one record of the end id alone; a very long text is one record; repeated rows are records of
    their own; a null doc_id comes first; an empty table gives no rows; further columns are ignored. The tokenizer has
    to be a byte-level BPE; others raise.
    """
    spark = documents.sparkSession
    root = root or Workspace(spark, "records").root
    write_records(documents, root, tokenizer_path or tokenizer_file(), cached_words=cached_words)
    return read_records(spark, root)


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_token_records": op8_token_records}
ORACLE_SQL: dict[str, str] = {}
