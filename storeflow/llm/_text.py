"""Vectorised word tables over Arrow string columns, and the map helpers the text operators share.

Texts are handled as UTF-8 bytes. A word class is a 256-entry table of word bytes; bytes of 0x80 and above are
always word bytes, so multi-byte characters never split. A-Z fold to a-z. A word's hash is 64 bits of a random
polynomial over its bytes (fixed tables, so every task and every run agrees), computed for a whole slice of texts at
once with cumulative sums. Such polynomials modulo 2**64 collide on long self-similar words whatever their tables, so
words over LONG bytes are hashed by BLAKE2b instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

U64 = np.uint64
#: Bytes of text whose word tables are built together.
SLICE_BYTES = 2 << 20
#: Bytes of an Arrow batch.
BATCH_BYTES = 8 << 20
#: Words of more bytes than this get a cryptographic hash.
LONG = 64
_CHUNK = 1 << 20
_RADIX = 0x9E3779B97F4A7C15 | 1
_RADIX_INV = pow(_RADIX, -1, 1 << 64)


def _word_bytes(separator: Callable[[int], bool]) -> np.ndarray:
    return np.array([b >= 0x80 or not separator(b) for b in range(256)])


#: Words are runs of anything but white space (0x20, 0x09-0x0D).
SPACED = _word_bytes(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)
#: Words are runs of digits, letters and non-ASCII characters; A-Z count as letters since they fold first.
ALNUM = _word_bytes(lambda b: not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A))

#: A-Z to a-z, all other bytes as they are.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20

_VALUES = np.random.Generator(np.random.PCG64(20240117)).integers(0, 1 << 64, 256, dtype=U64, endpoint=False)
_VALUES[0x41:0x5B] = _VALUES[0x61:0x7B]
_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, _CHUNK + 4096)
        with np.errstate(over="ignore"):
            for k, r in enumerate((_RADIX, _RADIX_INV)):
                steps = np.full(size, r, U64)
                steps[0] = 1
                _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U64(27))
        x = x * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def word_spans(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document number, first byte, bytes) of every word, in order, of the texts data[offsets[i]:offsets[i+1]]."""
    base, end = int(offsets[0]), int(offsets[-1])
    hashes, at, sizes = [], [], []
    lo = base
    while lo < end:
        hi = min(end, lo + _CHUNK)
        while hi < end and word[data[hi - 1]] and word[data[hi]]:  # never cut inside a word
            more = min(end, hi + 4096)
            stop = np.flatnonzero(~word[data[hi:more]])
            hi = hi + int(stop[0]) if len(stop) else more
        b = data[lo:hi]
        m = word[b]
        head = np.zeros(hi - lo + 1, bool)
        inside = offsets[(offsets >= lo) & (offsets < hi)] - lo
        head[inside] = True
        head[0] = head[-1] = True
        first = m.copy()
        first[1:] &= ~m[:-1] | head[1:-1]
        last = m.copy()
        last[:-1] &= ~m[1:] | head[1:-1]
        s, e = np.flatnonzero(first), np.flatnonzero(last)
        power, inverse = _powers(hi - lo)
        with np.errstate(over="ignore"):
            x = _VALUES[b] * power[: hi - lo]
            c = np.cumsum(x, dtype=U64)
            made = mix((c[e] - c[s] + x[s]) * inverse[s] + (e - s + 1).astype(U64))
        for i in np.flatnonzero(e - s >= LONG):
            made[i] = int.from_bytes(hashlib.blake2b(FOLD[b[s[i] : e[i] + 1]].tobytes(), digest_size=8).digest(), "little")
        hashes.append(made)
        at.append(s + lo)
        sizes.append(e - s + 1)
        lo = hi
    if not hashes:
        return np.zeros(0, U64), *(np.zeros(0, np.int64) for _ in range(3))
    starts = np.concatenate(at)
    return np.concatenate(hashes), np.searchsorted(offsets, starts, side="right") - 1, starts, np.concatenate(sizes)


def word_table(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document number) of every word, in order."""
    return word_spans(data, offsets, word)[:2]


def hash_words(words: list[str], word: np.ndarray) -> np.ndarray:
    """Hashes of single words given as strings."""
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return word_table(data, np.array([0, len(data)], np.int64), word)[0]


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    return (np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)), offsets


def slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes of text (or of a binary column) each; one long text is a range of its own."""
    offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False))])
    i, n = 0, len(col)
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1), i + 8192)
        yield i, j
        i = j


def starts_of(doc: np.ndarray, n: int) -> np.ndarray:
    """Where each document's words begin in a word table; n + 1 bounds."""
    return np.searchsorted(doc, np.arange(n + 1))


def small_batches(df: DataFrame) -> DataFrame:
    """df, after lowering its session's bytes an Arrow batch to BATCH_BYTES: texts are long, and a batch is held by JVM and Python at once."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    held = conf.get(key)
    if not held.rstrip("b").isdigit() or int(held.rstrip("b")) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with underscores added until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def map_text(df: DataFrame, text: str, carry: dict[str, str], fields: list[tuple[str, str]], fn) -> DataFrame:
    """One row per row of df: the carried columns (output name -> input name), then `fields` as fn makes them.

    fn(strings) gets a slice of the text column and returns one array or list per field.
    """
    from pyspark.sql import functions as F

    picked = small_batches(df).select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry.values())], F.col(f"`{text}`").cast("string").alias("t"))
    kinds = [picked.schema[i].dataType for i in range(len(carry))]
    schema = T.StructType(
        [T.StructField(n, k) for n, k in zip(carry, kinds, strict=True)]
        + [T.StructField(n, T._parse_datatype_string(k)) for n, k in fields]
    )
    width, names = len(carry), list(carry) + [n for n, _ in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in schema.fields[width:]]
        for batch in batches:
            for i, j in slices(batch.column(width)):
                part = batch.slice(i, j - i)
                made = [pa.array(v, t) if not isinstance(v, pa.Array) else v.cast(t) for v, t in zip(fn(part.column(width)), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:width], *made], names=names)

    return picked.mapInArrow(run, schema)


def filter_text(df: DataFrame, text: str, keep) -> DataFrame:
    """The rows of df, all columns as they are, for which keep(strings) is true."""
    place = small_batches(df).columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column(place)):
                part = batch.slice(i, j - i)
                yield part.filter(pa.array(np.asarray(keep(part.column(place)), bool)))

    return df.mapInArrow(run, df.schema)


def shared_dir(spark, prefix: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; a single machine may leave it unset."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if root is None:
        found = sc._jsc.sc().getCheckpointDir()
        if found.isDefined():
            root = found.get()
        elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{root.rstrip('/')}/{prefix}-{uuid.uuid4().hex}"


def drop_folder(spark, path: str) -> None:
    """Deletes a folder of shared_dir."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession, "checkpoints"))
    return df.checkpoint()
