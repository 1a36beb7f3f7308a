"""The jobs as named queries: each runs twice over the whole tables into a new folder, and returns the output read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import feature_screening, track_quality
from voxtrail import adapters as A
from voxtrail.session import shared_folder

MAX_GAP = 3


def job1_track_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of all events; the second run finds nothing new."""
    folder = f"{shared_folder(spark)}/job1-{uuid.uuid4().hex}"
    for _ in range(2):
        out = track_quality.run(spark, f"{sf_dir}/events.parquet", f"{folder}/out", f"{folder}/checkpoint", MAX_GAP)
    return out


def job2_feature_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements of all labelled documents against their labels; the second run replaces what the first wrote."""
    folder = f"{shared_folder(spark)}/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        out = feature_screening.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", f"{folder}/out")
    return out


QUERIES = {f.__name__: f for f in (job1_track_quality, job2_feature_screening)}
_COUNT = "len(regexp_extract_all(text, '{}'))"
_SHARE = "floor(" + _COUNT + " * 1000 / greatest(length(text), 1)::double)::bigint"
_SPACES = _COUNT.format(r"[\x20\x09-\x0D]")
_WORDS = _COUNT.format(r"[^\x20\x09-\x0D]+")
ORACLE = {
    "job1_track_quality": A.oracle("det")
    + f""", c as (
        select movie, t, count(*) as n_cells, sum((color_id < 0)::int)::bigint as n_dim, sum(goes_on)::bigint as n_bridge from (
            select movie, t, color_id, coalesce((lead(t) over (partition by movie, cell_id order by t) = t + 1)::int, 0) as goes_on from det) group by all
    ), s as (
        select movie, t, color_id <> lag(color_id) over w as switch, t - lag(t) over w as gap from det where color_id >= 0 window w as (partition by movie, cell_id order by t)
    ), n as (
        select movie, t, count(*) as n_transitions, sum(switch::int)::bigint as n_switches, sum((switch and gap > 1)::int)::bigint as n_at_gap from s where gap <= {MAX_GAP + 1} group by all
    )
    select c.movie, c.t, c.n_cells, c.n_dim, case when f.t is null then 0 else c.n_bridge end as n_bridge, case when f.t is not null then c.n_bridge / c.n_cells::double end as continuity,
        coalesce(n_transitions, 0) as n_transitions, coalesce(n_switches, 0) as n_switches, coalesce(n_at_gap, 0) as n_at_gap, n_switches / n_transitions::double as switch_rate
    from c left join n using (movie, t) left join c f on f.movie = c.movie and f.t = c.t + 1""",
    "job2_feature_screening": f"""
    with d as (select doc_id, nullif(lang, '') as lang, coalesce(text, '') as text from documents),
    m as (
        select doc_id, lang, length(text) as characters, {_WORDS} as words, {_COUNT.format(chr(92) + "n")} as lines, {_SHARE.format("[0-9]")} as digits, {_SHARE.format("[A-Z]")} as capitals,
            {_SHARE.format(r"[!-/:-@\[-`{-~]")} as marks, {_SHARE.format(r"[\x20\x09-\x0D]")} as spaces, floor((length(text) - {_SPACES}) * 100 / greatest({_WORDS}, 1)::double)::bigint as word_length from d
    ), r as (
        select lang, l.label, l.mark = 1 as positive, m.* exclude (doc_id, lang) from m
        join (select doc_id, unnest(['quality', 'toxic']) as label, unnest([quality, toxic]) as mark from labels) l using (doc_id) where l.mark is not null
    ), v as (
        unpivot r on characters, words, lines, digits, capitals, marks, spaces, word_length into name feature value value
    ), k as (
        select *, rank() over w + (count(*) over (partition by label, lang, feature, value) - 1) / 2.0::double as avg_rank from v window w as (partition by label, lang, feature order by value)
    ), a as (
        select label, lang, feature, count(*) as n, sum(positive::int)::bigint as n_positive, sum(avg_rank) filter (positive) as r,
            quantile_cont(value, 0.5) filter (positive) as median_positive, quantile_cont(value, 0.5) filter (not positive) as median_negative from k group by all
    )
    select feature, n, n_positive, case when n_positive > 0 and n_positive < n then (r - n_positive * (n_positive + 1) / 2.0::double) / (n_positive * (n - n_positive)) end as auc, median_positive::double as median_positive,
        median_negative::double as median_negative, label, lang from a""",
}
