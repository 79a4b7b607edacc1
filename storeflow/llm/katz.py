"""Language-model scores: a Katz backoff bigram model, learnt from a corpus and applied to it.

Tokens are words in lower case (A-Z only), then one end token a document. With c the counts in the documents that teach,

    p(w | v) = d(c(vw)) * c(vw) / c(v)   where vw was seen,   a(v) * p(w)   else
    a(v)     = (1 - sum of p(w | v) over seen vw) / (1 - sum of p(w) over the same w)
    p(w)     = d1(c(w)) * c(w) / N       where w was seen,    what is left over   for all unseen words together

d and d1 are Good-Turing ratios for counts up to K, from the counts of counts of all bigrams and of all words; a ratio
that is not between 0 and 1, or lacks a count of counts, is 1. Where nothing is discounted (in a context, or among
all words) its counts are divided by one more than their sum, so that mass for the unseen is left. Hence every
p(. | v) sums to one over the known words, the end and one unknown word. A document begins after an end; after an
unknown word, p(w | v) is p(w).

Tables, each stored in a shared folder: chunks (about TOKENS tokens each, as numbers of the chunk's own word list),
replies (numbers and counts of these words, by hash of the word), bigrams (merged counts and where they occur, by hash of
the first word). The first two are deleted when the third is written. A chunk sends each of its words and bigrams once. A context of more than SPLIT tokens is split by the
second word; its two sums are then added over its parts, broadcast if they are at most `hot_rows`, joined by part else.
Nothing is pruned: counts cover every document that teaches, and grow with it.

Words are known by 64-bit hashes (see `_text`): among n different words, n * n / 2**65 pairs are taken as one word.

Defined results: a null text is empty and holds the end alone; repeated rows are documents of their own, each teaching
and scored; where nothing teaches, every token is unknown and scores 0; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import SPACED, U64, buffers, drop_folder, mix, shared_dir, slices, small_batches, word_table

K = 5
TOKENS = 1_500_000
#: Words or bigrams, as sent by chunks, that meet in one part.
ENTRIES = 750_000
SPLIT = 1 << 20
END, UNKNOWN = 0, -1


def pack(a: np.ndarray) -> bytes:
    """Bytes of an array: all lowest bytes first, then the next ones, and so on, as small numbers have many zeros there."""
    raw = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True) if raw else b""


def unpack(blob, kind) -> np.ndarray:
    blob = blob.as_buffer().to_pybytes() if isinstance(blob, pa.Scalar) else blob
    if not blob:
        return np.zeros(0, kind)
    raw = np.frombuffer(pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def steps(a: np.ndarray) -> np.ndarray:
    """Differences; `np.cumsum` undoes them."""
    return np.diff(a, prepend=a.dtype.type(0))


def steps_within(a: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Differences that begin anew with every run of `group`."""
    out = steps(a)
    heads = np.flatnonzero(steps(group)) if len(a) else []
    out[heads] = a[heads]
    out[:1] = a[:1]
    return out


def undo_within(x: np.ndarray, group: np.ndarray) -> np.ndarray:
    heads = np.unique(np.concatenate([[0], np.flatnonzero(steps(group))])).astype(int)
    total = np.cumsum(x)
    return total - np.repeat(total[heads] - x[heads], np.diff(heads, append=len(x))) if len(x) else x


def ratios(n: list[int]) -> np.ndarray:
    """Discount ratios by count, 0 to K, then 1 for all above; n[r] is the number of things seen r times, r up to K + 1."""
    d = np.ones(K + 2)
    if n[1] and n[K + 1]:
        common = (K + 1) * n[K + 1] / n[1]
        for r in range(1, K + 1):
            if n[r] and n[r + 1] and common < 1:
                x = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
                d[r] = x if 0 < x < 1 else 1.0
    return d


class Unigrams:
    """p(w) by count."""

    def __init__(self, total: int, counts_of_counts: list[int]):
        self.d = ratios(counts_of_counts)
        lost = sum((1 - self.d[r]) * r * counts_of_counts[r] for r in range(1, K + 1))
        self.below = float(total) if lost > 0 else total + 1.0
        self.left = (lost if lost > 0 else 1.0) / self.below

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.d[np.minimum(c, K + 1)] * c / self.below, self.left)


def part_of(v: np.ndarray, w: np.ndarray, cv: np.ndarray, split: int, parts: int) -> np.ndarray:
    """Parts of bigrams: by the first word, and by the second too where the first has more than `split` tokens."""
    ways = (cv + split - 1) // split
    salt = np.where(ways > 1, (mix(w.astype(U64)) % np.maximum(ways, 1).astype(U64)).astype(np.int64), 0)
    return salted(v, salt, parts)


def salted(v: np.ndarray, salt: np.ndarray, parts: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(mix(v.astype(U64) + U64(1)) + salt.astype(U64)) % U64(parts)).astype(np.int64)


def word_part(h: np.ndarray, parts: int) -> np.ndarray:
    """Parts of words: ranges of the upper half of the hash, so that sorted words are sorted by part."""
    return ((h >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)


def _by_part(part: np.ndarray):
    """(part, places in it, ascending) for each part that occurs."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    found, starts = np.unique(part[order], return_index=True)
    for p, i, j in zip(found.tolist(), starts, [*starts[1:], len(order)], strict=True):
        yield p, order[i:j]


def _chunk_rows(tokens: int):
    def run(batches):
        from pyspark import TaskContext

        task, made, held = TaskContext.get().partitionId() << 24, 0, []

        def flush():
            h = np.concatenate([x[0] for x in held])
            sizes, teach = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            docs = pa.concat_arrays([x[3] for x in held])
            vocab, local = np.unique(h, return_inverse=True)
            counts = np.bincount(local[np.repeat(teach, sizes)], minlength=len(vocab))
            row = [task + made, pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs), pack(sizes.astype(np.int32)), pack(teach), pack(local.astype(np.int32))]
            row += [len(vocab), int(teach.sum()), int(counts.sum()) + int(teach.sum()), len(h) + len(docs)]
            words = [pack(vocab), pack(counts)]
            held.clear()
            kinds = [pa.int64(), row[1].type, *[pa.binary()] * 3, *[pa.int64()] * 4]
            both = [x if isinstance(x, pa.Array) else pa.array([x], t) for x, t in zip(row, kinds, strict=True)]
            both = [pa.concat_arrays([x, x if n == "chunk" else pa.nulls(1, x.type)]) for n, x in zip(_CHUNK, both, strict=False)]
            both += [pa.array([None, x], pa.binary()) for x in words]
            return pa.RecordBatch.from_arrays([*both, pa.array(["text", "words"])], names=_CHUNK)

        for b in batches:
            for i, j in slices(b.column(2)):
                part = b.slice(i, j - i)
                h, doc = word_table(*buffers(part.column(2)), SPACED)
                held.append((h, np.bincount(doc, minlength=j - i), part.column(1).to_numpy(zero_copy_only=False).astype(bool), part.column(0)))
                if sum(len(x[0]) for x in held) >= tokens:
                    yield flush()
                    made += 1
        if held:
            yield flush()

    return run


#: Of each chunk two rows are stored apart: its text, and its list of words, which only the replies need.
_CHUNK = ["chunk", "docs", "sizes", "teach", "words", "n_types", "n_docs", "n_teach", "n_tokens", "vocab", "counts", "kind"]


def _ask_words(parts: int):
    def run(batches):
        for b in batches:
            for chunk, vocab, counts in zip(*(b.column(i) for i in range(3)), strict=True):
                h, c = unpack(vocab, U64), unpack(counts, np.int64)
                got = [(p, pack(h[at]), pack(c[at])) for p, at in _by_part(word_part(h, parts))]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, *_ in got], pa.int64()), pa.array([chunk.as_py()] * len(got), pa.int64()), pa.array([x for _, x, _ in got], pa.binary()), pa.array([x for *_, x in got], pa.binary())], names=["part", "chunk", "h", "c"])

    return run


def _number_words():
    """Numbers and counts for a part's words, and, in a row without a chunk, its counts of counts."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        hs, cs = [unpack(x, U64) for x in table.column("h")], [unpack(x, np.int64) for x in table.column("c")]
        words, at = np.unique(np.concatenate(hs), return_inverse=True)
        c = np.bincount(at, weights=np.concatenate(cs), minlength=len(words)).astype(np.int64)
        ids = np.where(c > 0, np.arange(len(words)) + (part << 32) + 1, UNKNOWN)  # in the order of the hashes
        ends = np.cumsum([len(h) for h in hs])[:-1]
        rows = [(k, part, pack(ids[i]), pack(c[i]), None) for k, i in zip(table.column("chunk").to_pylist(), np.split(at, ends), strict=True)]
        n = np.bincount(np.minimum(c, K + 2), minlength=K + 3).tolist()
        rows.append((None, part, None, None, [*n[: K + 2], sum(n[1:])]))
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        return pa.table([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["chunk", "part", "ids", "c", "n"])

    return run


_ASK = ["part", "chunk", "v", "w", "cv", "cw", "n", "times", "doc", "mult", "docs", "facts"]


def _ask_bigrams(parts: int, split: int, n_docs: int, total: int, types: int, one: Unigrams, doc_kind):
    """Of one chunk and its replies: one row for every part that gets bigrams, and one with what is known of its documents."""
    import pyarrow.compute as pc

    def run(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        col = {n: chunk.column(n)[0] for n in chunk.column_names}
        key, sizes, teach = col["chunk"].as_py(), unpack(col["sizes"], np.int32).astype(np.int64), unpack(col["teach"], bool)
        local = unpack(col["words"], np.int32)
        order = np.argsort(replies.column("part").to_numpy())  # words are sorted by part, and so are their numbers
        found = [np.concatenate([*[unpack(replies.column(x)[int(i)], np.int64) for i in order], [y, z]]) for x, y, z in (("ids", END, UNKNOWN), ("c", n_docs, 0))]
        ids, counts = found  # of the chunk's words, then of the end and of all unknown words
        n = len(ids) - 2
        where = np.where(ids[:n] == UNKNOWN, n + 1, np.arange(n)).astype(np.int32)

        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1)
        token = np.full(len(doc), n, np.int32)
        inner = np.ones(len(doc), bool)
        inner[np.cumsum(sizes + 1) - 1] = False
        token[inner] = where[local]
        before = np.concatenate([token[:0] if not len(token) else np.array([n], np.int32), token[:-1]])  # the end of one document begins the next
        m = len(sizes)
        base = np.log10((counts + 0.5) / (total + 0.5 * (types + 1)))
        alone = counts[before] == 0
        own = np.bincount(doc[alone], weights=np.log10(one.p(counts[token[alone]])), minlength=m)
        facts = [sizes + 1, np.bincount(doc[counts[token] > 0], minlength=m), np.bincount(doc, weights=base[token], minlength=m), own, teach]

        ask = ~alone
        pair, entry = np.unique(before[ask].astype(np.int64) * (n + 2) + token[ask], return_inverse=True)
        seen = np.bincount(entry[np.repeat(teach, sizes + 1)[ask]], minlength=len(pair))
        places, mult = np.unique(entry * m + doc[ask], return_counts=True)
        times = np.bincount(places // m, minlength=len(pair))
        first = np.cumsum(times) - times
        place_doc = places % m
        v, w = pair // (n + 2), pair % (n + 2)
        rows = []
        for p, e in _by_part(part_of(ids[v], ids[w], counts[v], split, parts)):
            t = times[e]
            o = np.repeat(first[e] - (np.cumsum(t) - t), t) + np.arange(t.sum())
            first_word, second = ids[v[e]], ids[w[e]]
            rows.append((p, key, *(pack(x) for x in (steps(first_word), steps_within(second, first_word), counts[v[e]], counts[w[e]], seen[e], t.astype(np.int32), place_doc[o].astype(np.int32), mult[o].astype(np.int32))), None))
        rows.append((int(salted(np.array([key]), np.zeros(1, np.int64), parts)[0]), key, *[None] * 8, pack(np.stack([x.astype(float) for x in facts]))))
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 8, pa.binary()]
        made = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        docs = pa.concat_arrays([pa.nulls(len(rows) - 1, doc_kind), pc.cast(chunk.column("docs").combine_chunks(), doc_kind)])
        return pa.table([*made[:10], docs, made[10]], names=_ASK)

    return run


_MERGED = ["part", "v", "v_at", "c", "cv", "cw", "n", "chunk", "entry", "times", "doc", "mult", "docs", "facts"]


def _merge(doc_kind):
    """A part's bigrams with their counts over all chunks, as one row; rows about documents pass."""

    def run(table: pa.Table) -> pa.Table:
        about = table.filter(pa.compute.is_valid(table.column("facts")))
        asked = table.filter(pa.compute.is_null(table.column("facts")))
        part = table.column("part")[0].as_py()
        names = {n: pa.binary() for n in ("v", "v_at", "c", "cv", "cw")} | {"n": pa.list_(pa.int64()), "chunk": pa.list_(pa.int64())} | {n: pa.list_(pa.binary()) for n in ("entry", "times", "doc", "mult")}
        rows = []
        if asked.num_rows:
            get = lambda n: [unpack(x, np.int64) for x in asked.column(n)]
            vs = [np.cumsum(x) for x in get("v")]
            ends = np.cumsum([len(x) for x in vs])[:-1]
            v, v_at = np.unique(np.concatenate(vs), return_inverse=True)
            w, w_at = np.unique(np.concatenate([undo_within(x, y) for x, y in zip(get("w"), vs, strict=True)]), return_inverse=True)
            key, first, at = np.unique(v_at * len(w) + w_at, return_index=True, return_inverse=True)
            c = np.bincount(at, weights=np.concatenate(get("n")), minlength=len(key)).astype(np.int64)
            cv, cw = np.concatenate(get("cv"))[first], np.concatenate(get("cw"))[first]
            n = np.bincount(np.minimum(c, K + 2), minlength=K + 3).tolist()[: K + 2]
            blobs = {x: asked.column(x).to_pylist() for x in ("times", "doc", "mult")}
            rows.append([pack(v), pack(steps((key // len(w)).astype(np.int32))), pack(c), pack(cv), pack(cw), n, asked.column("chunk").to_pylist(), [pack(steps(x.astype(np.int32))) for x in np.split(at, ends)], blobs["times"], blobs["doc"], blobs["mult"]])
        one = [pa.array([r[i] for r in rows], k) for i, k in enumerate(names.values())]
        mine = pa.table([pa.array([part] * len(rows), pa.int64()), *one, pa.nulls(len(rows), doc_kind), pa.nulls(len(rows), pa.binary())], names=_MERGED)
        k = about.num_rows
        passed = [about.column("part"), *[pa.nulls(k, t) for t in list(names.values())[:6]], pa.array([[x] for x in about.column("chunk").to_pylist()], pa.list_(pa.int64())), *[pa.nulls(k, pa.list_(pa.binary()))] * 4, about.column("docs"), about.column("facts")]
        return pa.concat_tables([mine, pa.table(passed, names=_MERGED)])

    return run


def _sums(row: dict, d: np.ndarray, one: Unigrams):
    """(contexts, context of each bigram, counts, token counts of contexts, count taken away, lower mass seen) of a part."""
    v, at, c = unpack(row["v"], np.int64), np.cumsum(unpack(row["v_at"], np.int32)), unpack(row["c"], np.int64)
    cw, cv = unpack(row["cw"], np.int64), np.zeros(len(v), np.int64)
    cv[at] = unpack(row["cv"], np.int64)
    lost = np.bincount(at, weights=(1 - d[np.minimum(c, K + 1)]) * c, minlength=len(v))
    low = np.bincount(at, weights=np.where(c > 0, one.p(cw), 0.0), minlength=len(v))
    return v, at, c, cw, cv, lost, low


def _hot(d: np.ndarray, one: Unigrams, split: int):
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                v, _, _, _, cv, lost, low = _sums(row, d, one)
                i = np.flatnonzero(cv > split)
                yield pa.RecordBatch.from_arrays([pa.array(x[i]) for x in (v, cv, lost, low)], names=["v", "cv", "lost", "low"])

    return run


def _score_parts(d: np.ndarray, one: Unigrams, split: int, sent):
    """Sums of log10 p by document for every part; sent: the sums of split contexts, if they don't come with the row."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                if row["v"] is None:
                    yield pa.RecordBatch.from_arrays([pa.array([row["chunk"][0]], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([None], pa.binary())], names=["chunk", "part", "doc", "sum"])
                    continue
                v, at, c, cw, cv, lost, low = _sums(row, d, one)
                hv, h_lost, h_low = sent.value if sent is not None else [np.array(x) for x in zip(*[(h["v"], h["lost"], h["low"]) for h in sorted(row["hot"] or [], key=lambda h: h["v"])], strict=True)] or [np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]
                i = np.flatnonzero(cv > split)
                if len(i):
                    k = np.searchsorted(hv, v[i])
                    lost[i], low[i] = h_lost[k], h_low[k]
                below = np.where(lost > 0, cv, cv + 1.0)
                backoff = np.where(lost > 0, lost, 1.0) / below / (1 - low)
                p = np.where(c > 0, d[np.minimum(c, K + 1)] * c / below[at], backoff[at] * one.p(cw))
                logs = np.log10(p)
                out = []
                for entry, times, doc, mult in zip(row["entry"], row["times"], row["doc"], row["mult"], strict=True):
                    x = np.repeat(logs[np.cumsum(unpack(entry, np.int32))], unpack(times, np.int32)) * unpack(mult, np.int32)
                    docs, k = np.unique(unpack(doc, np.int32), return_inverse=True)
                    out.append((pack(docs), pack(np.bincount(k, weights=x))))
                yield pa.RecordBatch.from_arrays([pa.array(row["chunk"], pa.int64()), pa.array([row["part"]] * len(out), pa.int64()), pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], names=["chunk", "part", "doc", "sum"])

    return run


def score(docs: DataFrame, teach: Column, *, doc_id="doc_id", text="text", tokens=TOKENS, entries=ENTRIES, split=SPLIT, hot_rows=1 << 20) -> DataFrame:
    """One row per document: doc_id, teach, n_tokens, n_known, train_tokens, base_score, score (log10; of the text and its end).

    teach: which documents are learnt from. To score others by the model, add them to docs with a false teach.
    """
    spark = docs.sparkSession
    root = shared_dir(spark, "katz")
    picked = small_batches(docs).select(F.col(f"`{doc_id}`").alias("k"), F.coalesce(teach.cast("boolean"), F.lit(False)).alias("teach"), F.col(f"`{text}`").cast("string").alias("t"))
    kind = picked.schema[0].dataType
    doc_list = T.ArrayType(kind)
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_list = to_arrow_type(doc_list)
    long, blob = T.LongType(), T.BinaryType()
    schema = lambda names, own: T.StructType([T.StructField(n, own.get(n, blob)) for n in names])

    numbers = {n: long for n in ("chunk", "n_types", "n_docs", "n_teach", "n_tokens")}
    rows = schema(_CHUNK, numbers | {"docs": doc_list, "kind": T.StringType()})
    picked.mapInArrow(_chunk_rows(tokens), rows).write.partitionBy("kind").parquet(f"{root}/chunks")
    of_kind = lambda kind: spark.read.schema(rows).parquet(f"{root}/chunks").where(F.col("kind") == kind)
    chunks = of_kind("text")
    asked, n_docs, total, n_tokens = (x or 0 for x in chunks.agg(F.sum("n_types"), F.sum("n_docs"), F.sum("n_teach"), F.sum("n_tokens")).first())
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    word_parts, parts = max(least, -(-asked // entries)), max(least, -(-n_tokens // entries))

    requests = of_kind("words").select("chunk", "vocab", "counts").mapInArrow(_ask_words(word_parts), "part long, chunk long, h binary, c binary")
    requests.groupBy("part").applyInArrow(_number_words(), "chunk long, part long, ids binary, c binary, n array<long>").write.parquet(f"{root}/replies")
    replies = spark.read.parquet(f"{root}/replies")
    drop_folder(spark, f"{root}/chunks/kind=words")
    chunks = of_kind("text")
    counted = replies.where("chunk is null").select(*[F.sum(F.col("n")[r]) for r in range(K + 3)]).first()
    n1 = [x or 0 for x in counted]
    types = n1.pop() + (n_docs > 0)
    if 0 < n_docs <= K + 1:  # the end is a word too
        n1[n_docs] += 1
    one = Unigrams(total, n1)

    ask = _ask_bigrams(parts, split, n_docs, total, types, one, arrow_list)
    by_chunk = chunks.select("chunk", "docs", "sizes", "teach", "words").groupBy("chunk").cogroup(replies.where("chunk is not null").select("chunk", "part", "ids", "c").groupBy("chunk"))
    asked_pairs = by_chunk.applyInArrow(ask, schema(_ASK, {"part": long, "chunk": long, "docs": doc_list}))
    merged_kinds = {"part": long, "n": T.ArrayType(long), "chunk": T.ArrayType(long), "docs": doc_list} | {n: T.ArrayType(blob) for n in ("entry", "times", "doc", "mult")}
    asked_pairs.groupBy("part").applyInArrow(_merge(arrow_list), schema(_MERGED, merged_kinds)).write.parquet(f"{root}/bigrams")
    bigrams = spark.read.parquet(f"{root}/bigrams")
    for done in ("chunks", "replies"):  # nothing below reads them
        drop_folder(spark, f"{root}/{done}")
    n2 = [x or 0 for x in bigrams.select(*[F.sum(F.col("n")[r]) for r in range(K + 2)]).first()]
    d = ratios(n2)

    pieces = bigrams.where("v is not null").select("v", "v_at", "c", "cv", "cw")
    pieces.mapInArrow(_hot(d, one, split), "v long, cv long, lost double, low double").groupBy("v", "cv").agg(F.sum("lost").alias("lost"), F.sum("low").alias("low")).write.parquet(f"{root}/split")
    hot = spark.read.parquet(f"{root}/split")
    rows, sent = bigrams.drop("docs", "facts"), None
    if hot.count() <= hot_rows:
        got = hot.orderBy("v").toArrow()
        sent = spark.sparkContext.broadcast([got.column(n).to_numpy() for n in ("v", "lost", "low")])
    else:

        def spread(batches):
            for b in batches:
                v, cv = b.column(0).to_numpy(), b.column(1).to_numpy()
                ways = (cv + split - 1) // split
                at = np.repeat(np.arange(len(v)), ways)
                part = salted(v[at], np.arange(len(at)) - np.repeat(np.cumsum(ways) - ways, ways), parts)
                yield pa.RecordBatch.from_arrays([pa.array(part), *[b.column(i).take(pa.array(at)) for i in (0, 2, 3)]], names=["part", "v", "lost", "low"])

        by_part = hot.mapInArrow(spread, "part long, v long, lost double, low double").groupBy("part").agg(F.collect_set(F.struct("v", "lost", "low")).alias("hot"))
        rows = rows.join(by_part, "part", "left")
    sums = rows.where("v is not null").mapInArrow(_score_parts(d, one, split, sent), "chunk long, part long, doc binary, sum binary")
    about = bigrams.where("v is null").select(F.col("chunk")[0].alias("chunk"), "docs", "facts")

    def gather(about: pa.Table, sums: pa.Table) -> pa.Table:
        facts = unpack(about.column("facts")[0], float).reshape(5, -1)
        whole = facts[3].copy()
        for i in np.argsort(sums.column("part").to_numpy()):
            whole[unpack(sums.column("doc")[int(i)], np.int32)] += unpack(sums.column("sum")[int(i)], float)
        keys = about.column("docs").combine_chunks().flatten()
        return pa.table([keys, pa.array(facts[4] > 0), pa.array(facts[0].astype(np.int64)), pa.array(facts[1].astype(np.int64)), pa.array(np.full(len(whole), total, np.int64)), pa.array(facts[2]), pa.array(whole)], names=_OUT)

    out = T.StructType([T.StructField(n, k) for n, k in zip(_OUT, [kind, T.BooleanType(), long, long, long, T.DoubleType(), T.DoubleType()], strict=True)])
    return about.groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInArrow(gather, out).withColumnRenamed("k", doc_id)


_OUT = ["k", "teach", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
