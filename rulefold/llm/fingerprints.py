"""Document fingerprints from closed syncmers, by DataFrame functions alone.

A text of any length and script is read as one kind of symbols: its words, cut at white space and after every PIECE
characters, and each character of scripts without blanks. Each run of K symbols is a k-mer; it is a closed syncmer if the
smallest hash of its inner runs of S symbols is at its first or last place. That depends on the k-mer alone, not on its
surroundings, so equal passages are anchored alike wherever they stand (anchors() gives all of them with their places).
A fingerprint is the smallest of a text's distinct syncmer hashes, SIZE or one of SHARE, whichever is more (32 bits each,
as hexadecimal digits in ascending order), so it grows with the text. The likeness of two is the share of the smallest
hashes of their union that both hold, as many as both fingerprints know: an estimate of the Jaccard similarity of the
syncmer sets, exact for texts of fewer than SIZE syncmers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 5
S = 2
SIZE = 64
SHARE = 16
PIECE = 6
BUCKET = 4_000_000
MOST_BUCKETS = 50_000
_NONE = "cast(array() as array<bigint>)"
_UNSPACED = r"\u3040-\u30FF\u3400-\u9FFF\uAC00-\uD7AF"


def symbols(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"[{_UNSPACED}]|[^\s{_UNSPACED}]{{1,{PIECE}}}"), F.lit(0))


def _hashed(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with arrays {name}_s (hashes of the inner runs of S symbols) for each text."""
    made = df.withColumn(f"{name}_h", F.transform(symbols(F.col(text)), lambda x: F.xxhash64(x)))
    n = F.size(f"{name}_h")
    inner = F.transform(
        F.sequence(F.lit(0), n - S),
        lambda i: F.xxhash64(*(F.get(F.col(f"{name}_h"), i + j) for j in range(S))),
    )
    return made.withColumn(f"{name}_s", F.when(n >= S, inner).otherwise(F.expr(_NONE)))


def _kmer(s: Column, i: Column) -> tuple[Column, Column]:
    """Whether the k-mer at place i is a closed syncmer, and its 32-bit hash."""
    runs = [F.get(s, i + j) for j in range(K - S + 1)]
    least = F.least(*runs)
    return (runs[0] == least) | (runs[-1] == least), F.shiftrightunsigned(F.xxhash64(*runs), 32)


def with_sketch(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the fingerprint of a text column as an ascending array `out`: empty for an empty text, one hash of the
    whole text where that has fewer than K symbols."""
    made = _hashed(df, text, out)
    s = F.col(f"{out}_s")

    def taken(i: Column) -> Column:
        closed, value = _kmer(s, i)
        return F.when(closed, value)

    places = F.sequence(F.lit(0), F.size(s) - (K - S + 1))
    found = F.when(F.size(s) >= K - S + 1, F.transform(places, taken)).otherwise(F.expr(_NONE))
    whole = F.when(F.length(text) > 0, F.array(F.shiftrightunsigned(F.xxhash64(text), 32))).otherwise(F.expr(_NONE))
    made = made.withColumn(f"{out}_k", F.array_distinct(F.array_compact(found)))
    some = F.slice(F.sort_array(F.col(f"{out}_k")), F.lit(1), F.greatest(F.lit(SIZE), F.ceil(F.size(f"{out}_k") / SHARE).cast("int")))
    return made.withColumn(out, F.when(F.size(f"{out}_k") > 0, some).otherwise(whole)).drop(f"{out}_h", f"{out}_s", f"{out}_k")


def written(sketch: str) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: str, b: str) -> Column:
    """0 to 1; two empty fingerprints are alike."""
    known = F.least(*(F.when(F.size(x) >= SIZE, F.size(x)).otherwise(F.lit(2**31 - 1)) for x in (a, b)))  # fewer are all there are
    union = F.slice(F.sort_array(F.array_union(a, b)), F.lit(1), known)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / F.greatest(F.size(union), F.lit(1)))


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the string column fingerprint (a column of that name is replaced). A null text counts as empty, whose
    fingerprint is empty; equal texts have equal fingerprints; an empty table gives an empty one."""
    made = docs.drop("fingerprint").withColumn("__text", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    return with_sketch(made, "__text", "__sketch").withColumn("fingerprint", written("__sketch")).drop("__text", "__sketch")


def anchors(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row a closed syncmer: doc_id, position (symbol index), hash. For matching passages by place: two texts share
    a passage where the same hashes appear at a constant difference of positions."""
    made = docs.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    made = _hashed(made, "__text", "__a")
    s = F.col("__a_s")

    def found(i: Column) -> Column:
        closed, value = _kmer(s, i)
        return F.when(closed, F.struct(i.alias("position"), value.alias("hash")))

    places = F.sequence(F.lit(0), F.size(s) - (K - S + 1))
    rows = made.filter(F.size(s) >= K - S + 1).select("doc_id", F.explode(F.array_compact(F.transform(places, found))).alias("x"))
    return rows.select("doc_id", "x.position", "x.hash")


def _ordered_buckets(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows with bucket: ranges of `place`, ascending, of about BUCKET bytes of text each."""
    volume, n = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    buckets = max(1, min(volume // BUCKET + 1, n, MOST_BUCKETS))
    shares = [i / buckets for i in range(1, buckets)]
    bounds = rows.agg(F.percentile_approx("place", shares, 10 * buckets).alias("b")).first()["b"] if shares else []
    bounds = sorted(set(bounds or []))
    if not bounds:
        return rows.withColumn("bucket", F.lit(0)), 1
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    # binary search: the number of bounds at or below the place
    found = F.aggregate(
        F.array(*map(F.lit, steps)), F.lit(0),
        lambda low, step: F.when(F.get(table, low + step - 1) <= F.col("place"), low + step).otherwise(low),
    )
    return rows.withColumn("bucket", found), len(bounds) + 1


def compare_edited(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprints of each text and of an edited copy: its last third (code points, rounded down) replaced by the
    first as many, or all, of the next document in descending order of doc_id (after the last: the first).

    One row a document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. A null
    text is empty, null keys come last, rows of equal keys are ordered by text; an empty table gives an empty one.

    The order is dealt into ranges; the first document of each range also goes to the range before it, so texts are
    shuffled once and no task sees more than its range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows, _ = _ordered_buckets(rows.withColumn("place", F.coalesce("doc_id", F.lit(-(2**63)))))
    tops = sorted((r["bucket"], r["top"]) for r in rows.groupBy("bucket").agg(F.max("place").alias("top")).collect())
    onward = [(tops[i][1], tops[(i + 1) % len(tops)][0]) for i in range(len(tops))] or [(0, -1)]
    onward = spark.createDataFrame(onward, "top bigint, target int")  # MOST_BUCKETS rows at most
    rows = rows.join(F.broadcast(onward), rows["place"] == onward["top"], "left")
    own = F.struct(F.col("bucket"), F.lit(False).alias("extra"))
    again = F.struct(F.col("target").alias("bucket"), F.lit(True).alias("extra"))
    dealt = F.explode(F.when(F.col("target").isNull(), F.array(own)).otherwise(F.array(own, again))).alias("to")
    rows = rows.select("doc_id", "place", "text", dealt).select("doc_id", "place", "text", "to.bucket", "to.extra")
    rows = with_sketch(rows.repartition("bucket"), "text", "sketch")
    order = Window.partitionBy("bucket").orderBy(F.col("extra"), F.col("place").desc(), F.col("text"))
    rows = rows.withColumn("next", F.lead(F.struct("text", "sketch")).over(order)).filter(~F.col("extra"))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next.text"), F.lit(1), cut))
    rows = rows.select("doc_id", n.cast("bigint").alias("n_chars"), "sketch", F.col("next.sketch").alias("other"), edited.alias("edited"))
    rows = with_sketch(rows, "edited", "changed")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written("sketch").alias("fingerprint"), written("changed").alias("edited_fingerprint"),
        likeness("sketch", "changed").alias("near_edited"), likeness("sketch", "other").alias("near_next"),
    )
