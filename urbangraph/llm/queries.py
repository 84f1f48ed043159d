"""The numbered operators over the synthetic tables, each with production parameters on its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbangraph.llm.oracles import OP11_SQL, OP12_SQL, OP13_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", *columns)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from urbangraph.llm import media

    return media.digests(media.load(media.store(documents(spark, sf_dir))), "tensor")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from urbangraph.llm import bpe

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(bpe.round_trip(documents(spark, sf_dir), path))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from urbangraph.llm import quality

    return quality.quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from urbangraph.llm import mixing

    return mixing.mix(documents(spark, sf_dir, "source")).drop("copies_taken")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from urbangraph.llm import toxicity

    return toxicity.toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from urbangraph.llm import token_counts

    counts = token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from urbangraph.llm import jaccard

    return jaccard.join(documents(spark, sf_dir))


def op8_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from urbangraph.llm import sstable

    files = sstable.write(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return sstable.digests(sstable.read(files))


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from urbangraph.llm import suffix

    return suffix.dedup(documents(spark, sf_dir), keep_text=False)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from urbangraph.llm import pii

    return pii.spans(documents(spark, sf_dir))


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from urbangraph.llm import chat
    from urbangraph.llm.arrays import saved

    control = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    every = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(saved(chat.conversations(chat.chains(every), keep=("conv_id",)), "conversations"))


def op12_annulus(spark: SparkSession, sf_dir: str) -> DataFrame:
    from urbangraph.llm import clustering

    return clustering.with_inertia(*clustering.cluster(table(spark, sf_dir, "embeddings")))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from urbangraph.llm import resampling

    return resampling.resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")).drop("n_words")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_media": op1_media,
    "op2_bpe": op2_bpe,
    "op3_quality": op3_quality,
    "op4_mixing": op4_mixing,
    "op5_toxicity": op5_toxicity,
    "op6_token_counts": op6_token_counts,
    "op7_jaccard": op7_jaccard,
    "op8_sstable": op8_sstable,
    "op9_suffix": op9_suffix,
    "op10_pii": op10_pii,
    "op11_chat": op11_chat,
    "op12_annulus": op12_annulus,
    "op13_resampling": op13_resampling,
    "pipeline": pipeline,
}

#: Weight classes of sources, offsets from digests and the order within buckets are those of mixing.py.
OP4_SQL = r"""
with sizes as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size from documents),
by_source as (select source, count(*) as docs, cast(sum(size) as bigint) as source_size from sizes group by source),
placed as (select *, case (row_number() over (order by source asc nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight,
  row_number() over (order by source asc nulls last) as place, source_size * 2.0::double as cap, sum(docs) over () as all_docs, sum(source_size) over () as words from by_source),
levels as (select *, (words * 1.5::double - coalesce(sum(cap) over (order by cap / weight, place rows between unbounded preceding and 1 preceding), 0.0::double))
  / sum(weight) over (order by cap / weight, place rows between current row and unbounded following) as level from placed),
found as (select level from levels where level * weight <= cap order by cap / weight, place limit 1),
targets as (select source, docs, source_size, least(cap, coalesce((select level from found) * weight, cap)) as target,
  ceil(docs / greatest(500.0::double, all_docs / 4096.0::double)) as parts from levels),
dealt as (select doc_id, s.source, size, source_size, target, case when source_size > 0 then target / source_size else 0.0::double end as copies,
  floor(('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null')), 1, 8))::bigint / 4294967296.0::double * parts) as bucket,
  ('0x' || substr(md5('7|' || coalesce(s.source, 'null')), 1, 8))::bigint / 4294967296.0::double as first
  from sizes s join targets t on s.source is not distinct from t.source),
numbered as (select *, row_number() over (partition by source order by bucket, size, doc_id asc nulls last) as k from dealt)
select doc_id, size, source_size, target, cast((floor(k * copies + first) - floor((k - 1) * copies + first)) * size as bigint) as taken from numbered
"""

ORACLES = {"op4_mixing": OP4_SQL, "op11_chat": OP11_SQL, "op12_annulus": OP12_SQL, "op13_resampling": OP13_SQL}
