r"""Token-id files with random access: directly addressable codes.

An id is split into chunks, lowest bits first, one chunk a level; level 0 has a chunk for each token, the next
one a chunk for each token that goes on, and so forth. A level but the last has a bitmap that tells which
of its tokens go on, and a directory with the number of set bits before each block of 512, so the place of
token i's next chunk is rank(i): any token is read with a few bytes from each level, and no block is decoded.
The widths of the levels are those that make the file smallest (a dynamic program over the number of ids of
each bit length).

File (little-endian): MAGIC, u32 length of a JSON header, the header, then the sections it places:
chunks, bitmap and directory of each level, and the documents' ids, null flags and first tokens.

Defined cases: null text counts as empty and is its end id alone; documents are in ascending doc_id order,
null ids first, equal ids by text; an empty table gives no file and no row; extra columns are ignored; a
very long text is kept whole, and a file then grows beyond tokens_per_file. A task that is run again writes
the same files anew.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.llm.common import new_path
from affinis.llm.tokens import default_tokenizer, encoder

MAGIC = b"DACTOK01"
BLOCK = 512
TOKENS_PER_FILE = 1 << 22


def pack(values: np.ndarray, width: int) -> bytes:
    """Values of width bits, highest bit first, one after the other."""
    kind, bits = (">u2", 16) if width <= 16 else (">u4", 32)
    step = 1 << 16  # a multiple of 8, so each slice ends on a whole byte
    return b"".join(
        np.packbits(np.unpackbits(values[k : k + step].astype(kind).view(np.uint8)).reshape(-1, bits)[:, bits - width :]).tobytes()
        for k in range(0, len(values), step)
    )


def unpack(data: np.ndarray, first: int, count: int, width: int) -> np.ndarray:
    """count values from the one numbered first."""
    kind, bits = (">u2", 16) if width <= 16 else (">u4", 32)
    out, step = np.empty(count, np.uint32), 1 << 16
    for k in range(0, count, step):
        n = min(step, count - k)
        bit = (first + k) * width
        raw = np.unpackbits(data[bit // 8 : (bit + n * width + 7) // 8])[bit % 8 : bit % 8 + n * width].reshape(n, width)
        wide = np.zeros((n, bits), np.uint8)
        wide[:, bits - width :] = raw
        out[k : k + n] = np.packbits(wide).view(kind)
    return out


def level_widths(ids: np.ndarray) -> list[int]:
    """The widths that need the fewest bits: cheapest[b] is the cost of what lies above the lowest b bits."""
    longest = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    beyond = [len(ids), *(int((ids >> np.uint32(b)).astype(bool).sum()) for b in range(1, longest)), 0]
    cheapest: list[tuple[float, list[int]]] = [(0.0, [])] * (longest + 1)
    for b in range(longest - 1, -1, -1):
        cheapest[b] = min(
            (beyond[b] * (w + (b + w < longest) * (1 + 32 / BLOCK)) + cheapest[b + w][0], [w, *cheapest[b + w][1]]) for w in range(1, longest - b + 1)
        )
    return cheapest[0][1]


def encode_file(ids: np.ndarray, doc_ids: list, starts: list[int]) -> bytes:
    sections: list[bytes] = []
    header: dict = {"n_tokens": len(ids), "n_docs": len(doc_ids), "levels": []}

    def put(data: bytes) -> list[int]:
        at = sum(map(len, sections))
        sections.append(data)
        return [at, len(data)]

    rest = ids.astype(np.uint32)
    widths = level_widths(rest)
    for k, w in enumerate(widths):
        level = {"width": w, "count": len(rest), "chunks": put(pack(rest & np.uint32((1 << w) - 1), w))}
        if k + 1 < len(widths):
            on = (rest >> np.uint32(w)) != 0
            ones = np.add.reduceat(on, np.arange(0, len(on), BLOCK)) if len(on) else np.zeros(0, int)
            level["bitmap"] = put(np.packbits(on).tobytes())
            level["ranks"] = put(np.concatenate(([0], np.cumsum(ones))).astype("<u4").tobytes())
            rest = rest[on] >> np.uint32(w)
        header["levels"].append(level)
    header["doc_ids"] = put(np.array([d or 0 for d in doc_ids], "<i8").tobytes())
    header["doc_null"] = put(np.array([d is None for d in doc_ids], np.uint8).tobytes())
    header["doc_starts"] = put(np.array([*starts, len(ids)], "<u8").tobytes())
    head = json.dumps(header, sort_keys=True).encode()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *sections])


class TokenFile:
    """Reads a file's bytes: token(i), tokens(first, count), documents()."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        n = int.from_bytes(data[8:12], "little")
        self.header = json.loads(data[12 : 12 + n])
        self._data = np.frombuffer(data, np.uint8)[12 + n :]
        self._levels = []
        for level in self.header["levels"]:
            part = {k: self._section(level[k]) for k in ("chunks", "bitmap", "ranks") if k in level}
            self._levels.append((level["width"], part["chunks"], part.get("bitmap"), part["ranks"].view("<u4") if "ranks" in part else None))
        self.n_tokens = self.header["n_tokens"]
        null = self._section(self.header["doc_null"])
        self.doc_ids = [None if z else int(d) for d, z in zip(self._section(self.header["doc_ids"]).view("<i8"), null, strict=True)]
        self.doc_starts = self._section(self.header["doc_starts"]).view("<u8").astype(np.int64)

    def _section(self, place: list[int]) -> np.ndarray:
        return np.array(self._data[place[0] : place[0] + place[1]])

    @staticmethod
    def _rank(bitmap: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Set bits before bit i."""
        block = i // BLOCK
        return int(ranks[block]) + int(np.unpackbits(bitmap[block * BLOCK // 8 : i // 8 + 1])[: i - block * BLOCK].sum())

    def token(self, i: int) -> int:
        value, shift = 0, 0
        for width, chunks, bitmap, ranks in self._levels:
            value |= int(unpack(chunks, i, 1, width)[0]) << shift
            if bitmap is None or not bitmap[i // 8] >> (7 - i % 8) & 1:
                break
            i, shift = self._rank(bitmap, ranks, i), shift + width
        return value

    def tokens(self, first: int, count: int) -> np.ndarray:
        return self._read(0, first, count)

    def _read(self, k: int, first: int, count: int) -> np.ndarray:
        width, chunks, bitmap, ranks = self._levels[k]
        out = unpack(chunks, first, count, width)
        if bitmap is not None and count:
            on = np.unpackbits(bitmap[first // 8 : (first + count + 7) // 8])[first % 8 : first % 8 + count].astype(bool)
            if n := int(on.sum()):
                out[on] |= self._read(k + 1, self._rank(bitmap, ranks, first), n) << np.uint32(width)
        return out

    def documents(self):
        """(doc_id, first token in the file, ids) of each document."""
        ids = self.tokens(0, self.n_tokens)
        for k, doc_id in enumerate(self.doc_ids):
            a, b = int(self.doc_starts[k]), int(self.doc_starts[k + 1])
            yield doc_id, a, ids[a:b]


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write(documents: DataFrame, folder: str, *, tokenizer: str | None = None, end_id: int = 2, partitions: int | None = None, tokens_per_file: int = TOKENS_PER_FILE) -> DataFrame:
    """Writes documents' ids to files in the folder, a URI that all executors see; one row for each file, with its first token's number.

    One shuffle, of the texts, to ranges of doc_id; each range is then tokenized and written by its task. What the driver
    gathers is a row of numbers for each file.
    """
    spark = documents.sparkSession
    path = tokenizer or default_tokenizer()
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        encode, task = encoder(path), TaskContext.get()
        part, serial = task.partitionId(), 0
        ids: list[np.ndarray] = []
        docs: list = []
        starts: list[int] = []
        total = 0

        def flush():
            data = encode_file(np.concatenate(ids), docs, starts)
            name = f"part-{part:06d}-{serial:05d}.dac"
            with store.open_output_stream(f"{base}/.{name}.{task.taskAttemptId()}") as out:
                out.write(data)
            store.move(f"{base}/.{name}.{task.taskAttemptId()}", f"{base}/{name}")
            return pa.RecordBatch.from_pylist([{"part": part, "serial": serial, "name": name, "n_tokens": total, "n_docs": len(docs), "n_bytes": len(data)}], schema=out_schema)

        out_schema = pa.schema([("part", pa.int64()), ("serial", pa.int64()), ("name", pa.string()), ("n_tokens", pa.int64()), ("n_docs", pa.int64()), ("n_bytes", pa.int64())])
        for batch in (whole.slice(k, 512) for whole in batches for k in range(0, whole.num_rows, 512)):
            keys = batch.column("doc_id").to_pylist()
            some, bounds = encode.ids(batch.column("text"), end_id)
            at = 0
            while at < len(keys):  # the documents up to the one that fills the file
                upto = min(len(keys), int(np.searchsorted(bounds, bounds[at] + tokens_per_file - total)))
                upto = max(upto, at + 1)
                docs += keys[at:upto]
                starts += (bounds[at:upto] - bounds[at] + total).tolist()
                ids.append(some[bounds[at] : bounds[upto]])
                total += int(bounds[upto] - bounds[at])
                at = upto
                if total >= tokens_per_file:
                    yield flush()
                    serial, total, ids, docs, starts = serial + 1, 0, [], [], []
        if docs:
            yield flush()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    files = sorted(rows.mapInArrow(run, "part long, serial long, name string, n_tokens long, n_docs long, n_bytes long").collect(), key=lambda r: (r["part"], r["serial"]))
    first, placed = 0, []
    for r in files:
        placed.append((r["name"], r["n_docs"], r["n_tokens"], r["n_bytes"], first))
        first += r["n_tokens"]
    return spark.createDataFrame(placed, "name string, n_docs long, n_tokens long, n_bytes long, first_token long")


def read(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """doc_id, start, ids (little-endian unsigned 32-bit) of each document in the files that write() returned."""

    def run(batches):
        store, base = _open(folder)
        for batch in batches:
            for name, first in zip(batch.column("name").to_pylist(), batch.column("first_token").to_pylist(), strict=True):
                with store.open_input_stream(f"{base}/{name}") as source:
                    file = TokenFile(source.read())
                found = list(file.documents())
                for k in range(0, len(found), 4096):
                    some = found[k : k + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([d for d, _, _ in some], pa.int64()), pa.array([first + a for _, a, _ in some], pa.int64()), pa.array([i.astype("<u4").tobytes() for _, _, i in some], pa.binary())],
                        ["doc_id", "start", "ids"],
                    )

    n = max(1, files.count())
    return files.repartition(min(n, 4096)).select("name", "first_token").mapInArrow(run, "doc_id long, start long, ids binary")


def crc_of(ids: DataFrame) -> DataFrame:
    return ids.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def round_trip(documents: DataFrame, **how) -> DataFrame:
    """Writes the files to a new folder under the shared one, then reads them back: doc_id, start, n_tokens, ids_crc32."""
    spark = documents.sparkSession
    folder = new_path(spark, "tokens")
    return crc_of(read(spark, folder, write(documents, folder, **how)))


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
