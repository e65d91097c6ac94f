"""The registered queries of the training-data operators, each over its whole table, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, exact_dedup, fingerprint, language_id, line_dedup, mixing, near_dedup, packing, periodic_runs, quality, substring_dedup, token_count, url_filter
from .common import fold, read_table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return token_count.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), max_tokens=2048)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = language_id.train(docs, fold(F.col("doc_id")) != 2)
    found = language_id.identify(docs, model)
    return found.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_duplicates(read_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_spread_lines(read_table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_removed", F.length(text).cast("long").alias("n_chars_left"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), tokens=2048)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(read_table(spark, sf_dir, "documents"), words=2, percent=80)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "block_score")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels")
    model = quality.train(docs, labels, fold(F.col("doc_id")) != 2)
    out = quality.score(docs, model, threshold=0.7)
    return out.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_pred").alias("predicted"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "passes")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint.edited(fingerprint.with_next(read_table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = periodic_runs.collapse_runs(periodic_runs.with_planted_runs(docs))
    best = periodic_runs.strongest(F.col("runs"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return out.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read_table(spark, sf_dir, "conversations")
    return conversation_repair.repair(conversation_repair.damaged(conversations), everyone=conversations)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_language_id, op3_exact_dedup, op4_line_dedup, op5_best_fit_packing, op6_minhash_near_dedup, op7_url_filter, op8_quality, op9_source_mixing, op10_fingerprints,
        op11_substring_dedup, op12_periodic_runs, op13_conversation_repair,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op3_exact_dedup": f"""
        with t as (select doc_id, {_LOWER} as norm from documents)
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
               doc_id = max(doc_id) over w as kept, sha256(norm) as text_sha256
        from t window w as (partition by norm)
    """,
    "op4_line_dedup": """
        with t as (select doc_id, source, text, string_split(text, chr(10)) as parts from documents),
        l as (select source, unnest(parts) as line from t),
        spread as (select line from l where trim(line) <> '' group by line having count(distinct coalesce(source, chr(0))) >= 5),
        e as (select doc_id, unnest(parts) as line, generate_subscripts(parts, 1) as pos from t),
        k as (select e.*, (s.line is not null) as gone from e left join spread s using (line)),
        a as (select doc_id, count(*) as n_lines, count(*) filter (gone) as n_removed,
                     coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') as kept from k group by doc_id)
        select t.doc_id, coalesce(a.n_lines, 0) as n_lines, coalesce(a.n_removed, 0) as n_removed,
               cast(length(coalesce(a.kept, '')) as bigint) as n_chars_left, sha256(coalesce(a.kept, '')) as text_sha256
        from t left join a using (doc_id)
    """,
    "op11_substring_dedup": r"""
        with t as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
        p as (select doc_id, w, unnest(range(1, len(w) - 11)) as i from t where len(w) >= 13),
        g as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as win from p),
        m as (select win, min(doc_id) as least from g group by win),
        b as (select distinct g.doc_id, g.i from g join m using (win) where g.doc_id > m.least),
        c as (select distinct doc_id, i + k as pos from b, (select unnest(range(0, 13)) as k) s),
        e as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as pos from t),
        a as (select doc_id, count(*) filter (c.pos is not null) as n_removed, coalesce(string_agg(word, ' ' order by pos) filter (c.pos is null), '') as kept
              from e left join c using (doc_id, pos) group by doc_id)
        select t.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
        from t left join a using (doc_id)
    """,
    "op9_source_mixing": r"""
        with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
                          md5('9|' || coalesce(cast(doc_id as varchar), '')) as h from documents),
        s as (select source, sum(size)::double as n, row_number() over (order by source is null, source) - 1 as k from d group by source),
        w as (select source, n, case k % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight, 3.0::double * n as cap from s),
        r as (select *, row_number() over (order by cap / weight, source is null, source) as i from w),
        v as (select *, (sum(n) over () - coalesce(sum(cap) over (order by i rows between unbounded preceding and 1 preceding), 0))
                     / (sum(weight) over () - coalesce(sum(weight) over (order by i rows between unbounded preceding and 1 preceding), 0)) as level from r),
        f as (select arg_min(level, i) as level from v where cap > level * weight),
        g as (select source, n, least(cap, coalesce((select f.level from f) * weight, cap)) as target from v),
        c as (select d.*, g.n, g.target, case when g.n > 0 then cast(floor(g.target / g.n) as integer) else 0 end as whole,
                     coalesce(sum(size) over (partition by d.source order by h, doc_id rows between unbounded preceding and 1 preceding), 0) as before
              from d join g on d.source is not distinct from g.source),
        p as (select *, whole + cast(n > 0 and whole < 3 and before + size / 2.0 <= target - whole * n as integer) as passes from c)
        select doc_id, size, cast(n as bigint) as source_size, target, cast(size * passes as bigint) as taken, source, passes from p
    """,
}
