"""Best-fit packing: sum-of-squares packing of tokenised documents into sequences.

A document's ids and a closing id are cut into pieces of at most `capacity`; only longer documents are cut. Pieces are
dealt into groups of a bounded number by a hash of the document and its place in its task, so repeated rows spread, and
each group is packed by itself: a piece goes where the sum, over residual gaps, of the squared number of open bins with
that gap becomes smallest. A new bin is opened only when no open one has room (any-fit), as the aim is the fewest
sequences. Large pieces go first, so the many small ones close what gaps remain; a group ends with a few bins that are
not full, against thousands that are.

Only lengths reach the packer (about 40 bytes a piece); ids stay with the task that read the text.

Defined results: a null or empty text is the closing id alone (length 1); rows that repeat a doc_id are packed each by
itself; an empty table packs into nothing.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import cut, slices, small_batches

#: Bytes of words and their ids that one process remembers, in two generations.
CACHE_BYTES = 32 << 20
_ENTRY_BYTES = 192  # a dict slot and the heads of a string and a bytes object
FIELDS = "doc_id {k}, piece int, start long, length long, ids_crc32 long"


def _latin1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordEncoder:
    """Ids of whole texts for a lower-casing word BPE, word by word.

    White space never enters a token of this vocabulary, so the text splits at blanks and line ends without changing
    any id, and a stop or comma between a letter and a blank is a word of its own. Texts of Latin-1 are lowered whole.
    Letter runs go straight to the BPE model; anything else goes through the whole tokenizer.

    Words are remembered across tasks in two generations of CACHE_BYTES / 2 each: a full young one replaces the old
    one, and a word found in the old one moves to the young one, so frequent words stay and rare ones leave.
    """

    _PLAIN = re.compile(r"[a-zà-öø-ÿ]+")
    _MARKED = re.compile(r"([a-zà-öø-ÿ]+)([!#$%&*+,.:;?]+)")
    _STOP = re.compile(r"([.,])(?<=[a-zà-öø-ÿ][.,])(?= |$)")

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.half, self.young, self.old, self.held = cache_bytes // 2, {"": b""}, {}, 0
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in plain]
        self.shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}  # byte-level BPE's printable bytes

    def _made(self, word: str) -> bytes:
        if self._PLAIN.fullmatch(word):
            ids = [t.id for t in self.model.tokenize(word if word.isascii() else "".join(map(self.shown.__getitem__, word.encode())))]
        elif m := self._MARKED.fullmatch(word):
            return self._word(m[1]) + self._word(m[2])
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        found = self.young.get(word)
        if found is None:
            found = self.old.get(word)
            if found is None:
                found = self._made(word)
            self.held += _ENTRY_BYTES + len(word) + len(found)
            if self.held > self.half:
                self.young, self.old, self.held = {"": b""}, self.young, 0
            self.young[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        text = text.replace("\n", " ")
        if _latin1(text):
            text = self._STOP.sub(r" \1", text.lower())
        out = list(map(self.young.get, words := text.split(" ")))
        for i in [i for i, found in enumerate(out) if found is None]:
            out[i] = self._word(words[i])
        return b"".join(out)


_ENCODERS: dict[str, WordEncoder] = {}


def pieces(docs: DataFrame, path: str, *, doc_id="doc_id", text="text", capacity=4096, closing=1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    picked = small_batches(docs).select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("t"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    tail, width = np.array([closing], "<u4").tobytes(), 4 * capacity

    def run(batches):
        encoder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, WordEncoder(path))
        for batch in batches:
            for i, j in slices(batch.column(1), 4 << 20):
                part = batch.slice(i, j - i)
                which, number, size, crc = [], [], [], []
                for row, t in enumerate(part.column(1).to_pylist()):
                    ids = (encoder.encode(t) if t else b"") + tail
                    for k in range(0, len(ids), width):
                        which.append(row)
                        number.append(k // width)
                        size.append(min(width, len(ids) - k) // 4)
                        crc.append(zlib.crc32(ids[k : k + width]))
                number = np.array(number, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(which, pa.int64())), pa.array(number.astype(np.int32)), pa.array(number * capacity), pa.array(size, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return picked.mapInArrow(run, FIELDS.format(k=kind))


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each piece, taken in the given order.

    Moving a bin from gap g to g - s changes the sum of squares by 2 (N[g-s] - N[g]) + 2, and closing one by 1 - 2 N[g].
    Among equal sums the tightest gap wins; a bin is opened where none has room.
    """
    count = np.zeros(capacity + 1, np.int64)  # count[0] stays 0: full bins are closed
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, bins = np.zeros(len(sizes), np.int64), 0
    for i, s in enumerate(sizes.tolist()):
        at = count[s:]
        delta = 2 * (count[: capacity + 1 - s] - at) + 2
        delta[0] = 1 - 2 * at[0]
        delta[at == 0] = np.iinfo(np.int64).max
        k = int(np.argmin(delta))
        if at[k]:
            g = s + k
            b = open_bins[g].pop()
            count[g] -= 1
        else:
            g, b, bins = capacity, bins, bins + 1
        out[i] = b
        if g > s:
            open_bins[g - s].append(b)
            count[g - s] += 1
    return out


def _packed(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Large pieces first, then by id: gaps left by large pieces are filled by the small ones."""
    pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
    size = pdf["length"].to_numpy()
    b = sum_of_squares(size, capacity)
    order = np.argsort(b, kind="stable")
    start = np.searchsorted(b[order], np.arange(b.max() + 1))
    c = np.cumsum(size[order]) - size[order]
    offset = np.empty(len(b), np.int64)
    offset[order] = c - c[start[b[order]]]
    return pdf.assign(bin=b, offset=offset)


def pack(docs: DataFrame, path: str, *, doc_id="doc_id", text="text", capacity=4096, closing=1, group_rows=40_000) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    groups = max(1, -(-docs.count() // group_rows))
    made = cut(pieces(docs, path, doc_id=doc_id, text=text, capacity=capacity, closing=closing))
    full = made.where(F.col("length") == capacity)
    rest = made.where(F.col("length") < capacity)
    kind = made.schema["doc_id"].dataType.simpleString()
    schema = FIELDS.format(k=kind) + ", bin long, offset long, grp long"

    def first(key, pdf):
        return _packed(pdf.drop(columns="grp"), capacity).assign(grp=key[0])

    dealt = rest.withColumn("grp", F.pmod(F.xxhash64("doc_id", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    once = dealt.groupBy("grp").applyInPandas(first, schema)
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = full.select(*cols, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    packed = once.select(*cols, (F.shiftleft("grp", 32) + F.col("bin")).alias("sequence_id"), "offset")
    return whole.unionByName(packed)
