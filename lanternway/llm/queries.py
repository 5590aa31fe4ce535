"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternway.llm import byte_merge, exact_dedup, language_id, packing, pii, repeats, resampling, secret_scan, simhash, token_files, vector_codes, vector_search, word_bpe
from lanternway.llm.common import table
from lanternway.llm.digest import counted, joined, sha256


def op1_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = word_bpe.encode(table(spark, sf_dir, "documents"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha256(ids).alias("ids_sha256"), sha256(F.col("decoded")).alias("decoded_sha256"))


def op2_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.search(table(spark, sf_dir, "embeddings"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut_documents(table(spark, sf_dir, "documents"))
    digests = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(digests)


def op4_simhash_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return found.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    return spans_digest(found, {"assign": "n_assign", "access": "n_access", "hex": "n_hex"})


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.ExactDedup(table(spark, sf_dir, "documents")).assignments()


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_tokens(table(spark, sf_dir, "documents"))
    return token_files.read_tokens(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    return spans_digest(found, {k: f"n_{k}" for k in pii.BASE_KINDS})


def op11_partial_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = vector_codes.learn(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    coded = vector_codes.with_total(vector_codes.encode(rows, books), "label", "error", "label_error")
    return coded.select("vec_id", vector_codes.hexed(F.col("code")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op12_byte_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_merge.encode(table(spark, sf_dir, "documents"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha256(ids).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def spans_digest(found: DataFrame, counts: dict[str, str]) -> DataFrame:
    base: Column = F.col("base")
    numbers = [counted(base, kind).alias(name) for kind, name in counts.items()]
    return found.select("doc_id", *numbers, sha256(joined(base)).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bpe_transducer, op2_vector_search, op3_best_fit_packing, op4_simhash_cover, op5_language_id, op6_suffix_array, op7_secret_scan, op8_exact_dedup, op9_token_files, op10_pii_crf, op11_partial_distance, op12_byte_merge, op13_importance_resampling)
}



def codes_sql(rounds: int = 4) -> str:
    """Product codes with all distances, as joins on (part, position)."""
    steps = ["""v as (select vec_id, label, (i - 1) // (n // 4) as part, (i - 1) % (n // 4) as pos, cast(floor(1024 * x) as bigint) as x
  from (select vec_id, label, len(embedding) as n, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)))""",
        "c0 as (select part, pos, x, entry from v join (select vec_id, row_number() over (order by vec_id) - 1 as entry from (select distinct vec_id from v) order by vec_id limit 256) using (vec_id))"]
    for r in range(rounds + 1):
        steps.append(f"""a{r} as materialized (select vec_id, part, arg_min(entry, {{'d': d, 'e': entry}}) as entry, min(d) as d
  from (select vec_id, part, entry, sum((v.x - c.x) * (v.x - c.x)) as d from v join c{r} c using (part, pos) group by all) group by all)""")
        if r < rounds:
            steps.append(f"""c{r + 1} as materialized (select part, pos, entry, coalesce(m, x) as x from c{r}
  left join (select part, pos, entry, cast(floor(sum(x) / count(*)) as bigint) as m from v join a{r} using (vec_id, part) group by all) using (part, pos, entry))""")
    return "with " + ",\n".join(steps) + f""",
coded as (select vec_id, any_value(label) as label, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' order by part) as code, cast(sum(d) as bigint) as error
  from a{rounds} join (select vec_id, label from embeddings) using (vec_id) group by vec_id)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
  (select sha256(string_agg(cast(x as varchar), ',' order by part, entry, pos)) from c{rounds}) as codebooks_sha256 from coded"""


def resampling_sql() -> str:
    """Gains by CRC-32 from its table of 256 steps, for each different word once."""
    low = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    split = f"list_filter(regexp_split_to_array({low}, '{resampling.BETWEEN}'), lambda w: w <> '')"
    return f"""with recursive steps as (select range as i, range as c, 0 as k from range(256)
  union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from steps where k < 8),
crc as (select list(c order by i) as l from steps where k = 8),
d as (select doc_id, {split} as words from documents), b as (select {split} as words from benchmark),
dw as (select doc_id, unnest(words) as w from d), bw as (select unnest(words) as w from b),
hashed as (select w, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(w))), lambda x: cast(concat('0x', substr(hex(w), 2 * x + 1, 2)) as bigint))),
  lambda a, x: xor(a >> 8, l[(xor(a, x) & 255) + 1]))) % 10000 as bucket from (select w from dw union select w from bw) cross join crc),
s as (select bucket, count(*) as s from dw join hashed using (w) group by bucket), t as (select bucket, count(*) as t from bw join hashed using (w) group by bucket),
gain as (select bucket, cast(floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select coalesce(sum(s), 0) from s) + 10000)::double / ((coalesce(s, 0) + 1)::double * ((select coalesce(sum(t), 0) from t) + 10000)::double))) as bigint) as gain
  from (select range as bucket from range(10000)) left join s using (bucket) left join t using (bucket)),
weighed as (select doc_id, cast(sum(gain) as bigint) as weight from dw join hashed using (w) join gain using (bucket) group by doc_id),
scored as (select doc_id, cast(len(words) as bigint) as n_features, coalesce(weight, 0) as weight,
  coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast(concat('0x', substr(sha256(concat('2024:', doc_id)), 1, 8)) as bigint) + 0.5::double) / 4294967296))) as bigint) as score from d left join weighed using (doc_id)),
placed as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as place, count(*) over (partition by n_features >= 20) as able from scored)
select doc_id, n_features, weight, score, case when n_features >= 20 and place <= able * 10 // 100 then place end as rank from placed"""


ORACLE: dict[str, str] = {
    "op8_exact_dedup": """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))""",
    "op11_partial_distance": codes_sql(),
    "op13_importance_resampling": resampling_sql(),
}
