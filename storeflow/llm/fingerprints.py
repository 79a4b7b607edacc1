"""Document fingerprints: SimHash, with DataFrame and SQL functions only.

Terms are runs of `k` words (the whole sequence where a text has fewer); each occurrence votes, so a term's weight is
its frequency. A term's 64-bit hash votes on 64 signed bits; a bit of the fingerprint is set when more than half of the
votes are for it. Votes are summed as 32 packed counters of two 31-bit lanes, one vote for two bits per addition.

`near_pairs` finds all pairs within a Hamming radius by permuted block tables: the 64 bits are cut into blocks, and two
fingerprints within radius r agree on all but r of them; each choice of agreeing blocks is a table whose key they
share. Equal fingerprints are one entry of a table, and a pair is reported by the first table that finds it.
`near_counts` uses the same tables to search for some fingerprints among all.

Defined results: null and empty texts have no terms and fingerprint 0; rows that repeat are fingerprinted each by
itself, ordered by doc_id and text; a null doc_id comes before all others; a single document is its own next.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._text import cut

LANES = 32
_BOTH = 0x0000000100000001


def word_hashes(text: Column) -> Column:
    """Hashes of a text's words, which white space (0x20, 0x09-0x0D) separates."""
    words = F.filter(F.split(F.regexp_replace(text, "[\\t-\\r]", " "), " ", -1), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def terms(hashed: Column, k: int) -> Column:
    """Hashes of the runs of k words, each occurrence by itself; takes a column, as every run looks into it."""
    n = F.size(hashed)
    run = lambda i: F.xxhash64(*[F.get(hashed, i + j) for j in range(k)])  # noqa: E731  places past the end are null and don't count
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), run))


def votes(term: Column) -> list[Column]:
    """Packed sums: lane j counts the terms with bit j set, and those with bit j + 32."""
    return [F.sum(F.shiftrightunsigned(term, j).bitwiseAND(F.lit(_BOTH))).alias(f"v{j}") for j in range(LANES)]


def decided(total: str = "terms") -> Column:
    """The fingerprint from the sums v0..v31 and the number of terms."""
    out = F.lit(0).cast("bigint")
    for j in range(LANES):
        v, n = F.coalesce(F.col(f"v{j}"), F.lit(0)), F.col(total)
        low = F.when(2 * v.bitwiseAND(F.lit(0xFFFFFFFF)) > n, F.lit(1 << j)).otherwise(F.lit(0))
        high = F.when(2 * F.shiftrightunsigned(v, 32) > n, F.shiftleft(F.lit(1).cast("bigint"), j + 32)).otherwise(F.lit(0))
        out = out.bitwiseOR(low.cast("bigint")).bitwiseOR(high.cast("bigint"))
    return out


def likeness(a: Column, b: Column) -> Column:
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / 64.0


def hexed(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def simhash(texts: DataFrame, keys: list[str], text: str, k: int = 3) -> DataFrame:
    """keys and `fingerprint`, for distinct keys. Sums meet by the keys, after adding up in each task."""
    h = texts.select(*keys, word_hashes(F.coalesce(F.col(text), F.lit(""))).alias("hashed"))
    e = h.select(*keys, F.explode_outer(terms(F.col("hashed"), k)).alias("term"))
    return e.groupBy(*keys).agg(*votes(F.col("term")), F.count("term").alias("terms")).select(*keys, decided().alias("fingerprint"))


def longs(values: list[int]) -> Column:
    """One array literal, however long: the optimizer folds it."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def placed(k: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are below k: first among every s-th of them, then among the s that follow."""
    if not bounds:
        return F.lit(0)
    s = max(1, round(len(bounds) ** 0.5))
    outer = F.size(F.filter(longs(bounds[::s]), lambda x: x < k))
    inner = F.slice(longs(bounds), F.greatest(outer - 1, F.lit(0)) * s + 1, F.lit(s))
    return F.when(outer == 0, F.lit(0)).otherwise((outer - 1) * s + F.size(F.filter(inner, lambda x: x < k)))


def in_order(docs: DataFrame, doc_id: str, text: str, buckets: int) -> DataFrame:
    """bucket, rn, id, text and halo: buckets of consecutive ids, in which a row's next is at hand.

    Bucket bounds are quantiles of the ids. Each bucket also gets the first rows of the bucket after it (of the first
    bucket, after the last) as halo.
    """
    low = F.lit(-(2**63))
    d = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    d = d.withColumn("k", F.coalesce(F.col("id").cast("bigint"), low))
    at = sorted({int(x) for x in d.select("k").approxQuantile("k", [i / buckets for i in range(1, buckets)], 0.25 / buckets)}) if buckets > 1 else []
    d = d.withColumn("b", placed(F.col("k"), at))
    firsts = sorted((r.b, r.k) for r in d.groupBy("b").agg(F.min("k").alias("k")).collect()) or [(0, 0)]  # one row a bucket
    first, before = [0] * (len(at) + 1), [0] * (len(at) + 1)  # buckets without rows are never asked for
    for i, (b, k) in enumerate(firsts):
        first[b], before[b] = k, firsts[i - 1][0]
    halo = F.when(F.element_at(longs(first), F.col("b") + 1) == F.col("k"), F.element_at(longs(before), F.col("b") + 1).cast("int"))
    rows = d.withColumn("place", F.explode(F.when(halo.isNotNull(), F.array(F.struct(F.col("b").alias("bucket"), F.lit(False).alias("halo")), F.struct(halo.alias("bucket"), F.lit(True).alias("halo")))).otherwise(F.array(F.struct(F.col("b").alias("bucket"), F.lit(False).alias("halo"))))))
    rows = rows.select("place.bucket", "place.halo", "k", "id", F.col("t").alias("text"))
    w = Window.partitionBy("bucket").orderBy("halo", "k", "text")
    return rows.withColumn("rn", F.row_number().over(w)).withColumn("next", F.lead("text").over(w))


def fingerprint_edits(docs: DataFrame, *, doc_id="doc_id", text="text", k=3, buckets: int | None = None, radius=3, every=50) -> DataFrame:
    """Fingerprints of every text, of its edited text, and likenesses to the edited and the next text.

    The edited text replaces the last floor(n / 4) code points by the first as many of the next document, by doc_id.
    One shuffle carries the texts; terms and sums stay in the partition they are in. `n_near` is, for the documents
    whose id `every` divides, how many other documents have a fingerprint within `radius`; else it is null.
    """
    spark = docs.sparkSession
    if buckets is None:
        size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")))).first()[0] or 0
        buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), size >> 27)
    rows = in_order(docs, doc_id, text, buckets)
    n = F.char_length("text")
    tail = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - tail).cast("int")), F.substring(F.col("next"), F.lit(1), tail))
    rows = rows.withColumn("n_chars", n.cast("bigint")).withColumn("edited", F.when(~F.col("halo"), edited))
    rows = rows.withColumn("edited_sha256", F.when(~F.col("halo"), F.sha2(F.col("edited"), 256)))
    keys = ["bucket", "rn", "halo", "id", "n_chars", "edited_sha256"]
    both = rows.select(*keys, F.explode(F.when(F.col("halo"), F.array(F.struct(F.lit(False).alias("e"), F.col("text").alias("t")))).otherwise(F.array(F.struct(F.lit(False).alias("e"), F.col("text").alias("t")), F.struct(F.lit(True).alias("e"), F.col("edited").alias("t"))))).alias("x"))
    fp = simhash(both.select(*keys, "x.e", F.col("x.t").alias("t")), [*keys, "e"], "t", k)
    one = fp.groupBy(*keys).agg(F.max(F.when(~F.col("e"), F.col("fingerprint"))).alias("own"), F.max(F.when(F.col("e"), F.col("fingerprint"))).alias("other"))
    after = F.lead("own").over(Window.partitionBy("bucket").orderBy("rn"))
    out = cut(one.withColumn("after", after).where(~F.col("halo")).drop("bucket", "rn", "halo"))
    asked = F.coalesce(F.col("id").cast("bigint") % every == 0, F.lit(False))
    near = near_counts(out.where(asked).select("own"), out.select("own"), fingerprint="own", radius=radius)
    found = out.where(asked).join(near, "own", "left").withColumn("n_near", F.col("n") - 1)
    out = out.where(~asked).withColumn("n_near", F.lit(None).cast("bigint")).unionByName(found.drop("n"))
    return out.select(
        F.col("id").alias(doc_id), "n_chars", "edited_sha256", hexed(F.col("own")).alias("fingerprint"), hexed(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("after")).alias("near_next"), "n_near",
    )


def block_keys(fp: Column, radius: int, blocks: int) -> list[tuple[Column, int]]:
    """(key, mask) of each table: the bits of one choice of blocks - radius blocks."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(blocks)]
    out = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum(masks[i] for i in chosen)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        out.append((fp.bitwiseAND(F.lit(signed).cast("bigint")), mask))
    return out


def near_pairs(fingerprints: DataFrame, *, fingerprint="fingerprint", radius=3, blocks=6) -> DataFrame:
    """(a, b, distance) for all pairs of distinct fingerprints (bigint) within the radius, a < b."""
    if not 0 <= radius < blocks <= 64:
        raise ValueError("need 0 <= radius < blocks <= 64")
    f = fingerprints.select(F.col(fingerprint).alias("f")).where(F.col("f").isNotNull()).distinct()
    tables = block_keys(F.col("f"), radius, blocks)
    rows = f.select("f", F.posexplode(F.array(*[key for key, _ in tables])).alias("tab", "key"))
    a, b = rows.select(F.col("f").alias("a"), "tab", "key"), rows.select(F.col("f").alias("b"), "tab", "key")
    hit = a.join(b, ["tab", "key"]).where("a < b").withColumn("distance", F.bit_count(F.col("a").bitwiseXOR(F.col("b")))).where(F.col("distance") <= radius)
    diff = F.col("a").bitwiseXOR(F.col("b"))
    first = F.coalesce(*[F.when(key == 0, F.lit(i)) for i, (key, _) in enumerate(block_keys(diff, radius, blocks))])
    return hit.where(F.col("tab") == first).select("a", "b", "distance")


def near_counts(queries: DataFrame, fingerprints: DataFrame, *, fingerprint="fingerprint", radius=3, blocks=6) -> DataFrame:
    """(fingerprint, n) of each distinct query: how many rows of `fingerprints` (bigint, not null) lie within the radius."""
    keys = lambda c: F.posexplode(F.array(*[key for key, _ in block_keys(F.col(c), radius, blocks)])).alias("tab", "key")
    q = queries.select(F.col(fingerprint).alias("q")).distinct().select("q", keys("q"))
    f = fingerprints.groupBy(F.col(fingerprint).alias("f")).agg(F.count(F.lit(1)).alias("c")).select("f", "c", keys("f"))
    diff = F.col("q").bitwiseXOR(F.col("f"))
    first = F.coalesce(*[F.when(key == 0, F.lit(i)) for i, (key, _) in enumerate(block_keys(diff, radius, blocks))])
    hit = f.join(q, ["tab", "key"]).where((F.bit_count(diff) <= radius) & (F.col("tab") == first))
    return hit.groupBy(F.col("q").alias(fingerprint)).agg(F.sum("c").alias("n"))
