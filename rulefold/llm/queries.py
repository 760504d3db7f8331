"""The queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

import hashlib
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulefold.llm import centroids, decontaminate, fingerprints, jaccard, language, licenses, lm, packing, periodic, repeats, sharding, simhash, token_files
from rulefold.session import shared_folder, stored

#: Production shards of the sharding query.
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, SHARDS)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP5_SQL = r"""
with item_words as (
    select cast(item_id as varchar) item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
windows as (
    select distinct item, least(10, len(w)) n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') win
    from (select item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) i from item_words where len(w) > 0)),
doc_words as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
lengths as (select distinct n from windows),
places as (
    select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') win
    from (select doc_id, n, w, unnest(generate_series(1, len(w) - n + 1)) i from doc_words, lengths where len(w) >= n)),
hits as (select doc_id, p.n, i, item from places p join windows using (win)),
covered as (select doc_id, count(distinct k) n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) k from hits) group by doc_id),
named as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) ids from (select distinct doc_id, item from hits) group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
    sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from doc_words d left join covered using (doc_id) left join named using (doc_id)
"""


def bucket(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.select("doc_id", "text", "lang", F.coalesce(bucket(4) == 2, F.lit(False)).alias("held_out"))
    model = language.fit(docs.filter(~F.col("held_out")))
    return language.identify(docs.select("doc_id", "text", "held_out"), model).drop("text")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read(spark, path)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm.score(docs, bucket(5) != 1)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), *scored.columns[2:])


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs, licenses.fit(docs))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.cut(table(spark, sf_dir, "documents").select("doc_id", "text"), passages=repeats.PASSAGE_WORDS).drop("text")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centres = centroids.cluster(table(spark, sf_dir, "embeddings"))
    rows = stored(rows, "clusters")
    own = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # one a cluster
    total = sum(int(r.s) for r in own)
    facts = [(r.cluster, int(r.s), total, hashlib.sha256(",".join(map(str, centres[r.cluster].tolist())).encode()).hexdigest()) for r in own]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _op11_sql() -> str:
    """The rounds one after another; sums and distances in whole numbers."""
    far = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    nearest = "select rid, arg_min(n, (d, n)) n, min(d) d from (select v.rid, c.n, {far} d from v, c{r} c) group by rid"
    ctes = [
        """v as materialized (select row_number() over () rid, vec_id, list_transform(embedding, lambda e: cast(floor(1024 * cast(e as double)) as bigint)) x
from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = 64)""",
        "c0 as materialized (select row_number() over (order by sha256('3:' || cast(vec_id as varchar))) - 1 n, x from v order by sha256('3:' || cast(vec_id as varchar)) limit 8)",
    ]
    for r in range(centroids.ROUNDS):
        ctes += [
            f"a{r} as materialized ({nearest.format(far=far, r=r)})",
            f"""m{r} as (select n, list(cast(if(s % k < 0, (s - (s % k + k)) // k, (s - s % k) // k) as bigint) order by i) x
from (select n, i, sum(e) s, count(*) k from (select n, unnest(x) e, generate_subscripts(x, 1) i from a{r} join v using (rid)) group by n, i) group by n)""",
            f"c{r + 1} as materialized (select c.n, coalesce(m.x, c.x) x from c{r} c left join m{r} m on c.n = m.n)",
        ]
    ctes.append(f"a as materialized ({nearest.format(far=far, r=centroids.ROUNDS)})")
    return f"""with {", ".join(ctes)}
select v.vec_id, cast(a.n as integer) as cluster, cast(d as bigint) distance, cast(sum(d) over (partition by a.n) as bigint) cluster_inertia,
    cast(sum(d) over () as bigint) inertia, sha256(array_to_string(c.x, ',')) centroid_sha256
from a join v using (rid) join c{centroids.ROUNDS} c on c.n = a.n"""


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Every tenth document (by a hash of its id) repeats words from some word on, with a period that fits three times or more."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.withColumn("__words", F.when(h % 10 == 0, words)).withColumn("__g", F.floor(h / 10))
    n = F.size("__words")
    a = F.expr("__g % size(__words)")
    p = 1 + F.floor((n - F.col("__a")) / (3 + F.col("__g") % 8))
    rows = rows.withColumn("__a", F.when(n > 0, a)).withColumn("__p", p)
    place = lambda i: F.when(i < F.col("__a"), i).otherwise(F.col("__a") + (i - F.col("__a")) % F.col("__p")).cast("int")
    planted = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("__words", place(i))), " ")
    return rows.withColumn("text", F.when(n > 0, planted).otherwise(F.col("text"))).drop("__words", "__g", "__a", "__p")


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.collapsed(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    # the first of the runs with the greatest length / period, compared without division
    more = lambda a, b: F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.concat_ws("", F.transform(line, lambda x: F.concat(x, F.lit("\n"))))
    rows = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.aggregate("runs", none, more).alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * best.length div best.period")
    return rows.select("doc_id", "n_runs", "best.*", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_lm_score": op2_lm_score,
    "op3_token_files": op3_token_files,
    "op4_repeats": op4_repeats,
    "op5_decontaminate": op5_decontaminate,
    "op6_fingerprints": op6_fingerprints,
    "op7_language": op7_language,
    "op8_licenses": op8_licenses,
    "op9_packing": op9_packing,
    "op10_sharding": op10_sharding,
    "op11_centroids": op11_centroids,
    "op12_simhash": op12_simhash,
    "op13_periodic": op13_periodic,
}
ORACLE: dict[str, str] = {"op5_decontaminate": OP5_SQL, "op11_centroids": _op11_sql()}
