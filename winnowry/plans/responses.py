"""Queries of model responses and of the latest outputs, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from winnowry.operators import responses
from winnowry.plans.queries import query

LISTED = lambda c: f"coalesce(array_to_string(({c})::varchar[], '|'), '')"
KNOWN = lambda c, values, rest: f"case when coalesce(j->>'{c}', '') = '' then j->>'{c}' when j->>'{c}' in ({', '.join(repr(v) for v in values)}) then j->>'{c}' else '{rest}' end"
READ = r""", raw as (select event_id, [response, nullif(regexp_extract(response, '(?s)```(?:json)?\s*(.*?)\s*```', 1), ''), nullif(regexp_extract(response, '(?s)\{.*\}'), '')] as tried from {view}), ok as (select event_id, list_filter(list_transform(tried, lambda t: case when starts_with(ltrim(t), '{{') then try_cast(t as json) end), lambda x: x is not null)[1] as j from raw)"""
EVALUATIONS = READ.replace("{view}", "fx_replies").replace("{{", "{") + f""", r as (select event_id, j, coalesce((j->>'relevant')::boolean, false) as relevant, coalesce(nullif(j->>'rejection_reason', ''), j->>'reason', 'No reason provided') as told from ok),
e as (select event_id, relevant, case when j is null then 'Failed to parse response' when relevant and told = 'No reason provided' then 'Content is relevant' else told end as reason, case when j is null then 'json_parse_error' when not relevant then told end as rejection_reason, case when relevant then {KNOWN('study_type', responses.STUDY_TYPES, 'other')} end as study_type, case when relevant then j->>'population' end as population, case when relevant then j->>'sample_size' end as sample_size, case when relevant then j->>'time_window' end as time_window, case when relevant then coalesce(nullif(j->>'extracted_claim', ''), j->>'most_surprising_finding') end as extracted_claim,
 case when relevant then {LISTED("j->'must_include_numbers'")} else '' end as numbers, case when relevant then {KNOWN('suggested_archetype', responses.ARCHETYPES, 'STUDY_STAT')} end as suggested_archetype, case when relevant then greatest(0, least(100, trunc((j->>'virality_score')::double)::int)) end as virality_score_, (j->>'virality_score') is not null as scored, case when relevant and j->>'confidence' is not null then greatest(0, least(1, (j->>'confidence')::double)) end as confidence, case when relevant then {LISTED("j->'why_it_will_work'")} else '' end as why from r) """


@query("p35_parse_response", EVALUATIONS + "select * exclude (virality_score_, scored), case when scored then virality_score_ end as virality_score from e", ("fx_replies",))
def _(spark, d, replies):
    e = responses.evaluations(replies).select("event_id", "evaluation.*")
    return e.select("event_id", "relevant", "reason", "rejection_reason", "study_type", "population", "sample_size", "time_window", "extracted_claim", F.array_join("must_include_numbers", "|").alias("numbers"), "suggested_archetype", "virality_score", "confidence", F.array_join("why_it_will_work", "|").alias("why"))


@query("g22_required_fields", EVALUATIONS + "select event_id, (numbers <> '')::int + coalesce(length(population) > 3, false)::int + coalesce(length(time_window) > 3, false)::int + coalesce(sample_size <> '', false)::int >= 2 as enough from e", ("fx_replies",))
def _(spark, d, replies):
    return responses.evaluations(replies).select("event_id", responses.enough_evidence().alias("enough"))


@query("g24_evaluated", EVALUATIONS + "select event_id, virality_score_ as score, row_number() over (order by virality_score_ desc, event_id)::int as place from e where relevant and scored and virality_score_ >= 40 order by 2 desc, 1 limit 100", ("fx_replies",))
def _(spark, d, replies):
    """The hundred best, in order."""
    best = responses.promising(responses.evaluations(replies), order=("event_id",)).limit(100)
    return best.select("event_id", F.col("evaluation.virality_score").alias("score"), F.row_number().over(Window.orderBy(F.desc("evaluation.virality_score"), "event_id")).alias("place"))


TALES = READ.replace("{view}", "fx_tales").replace("{{", "{") + f""", f as (select event_id, j, case when j is null then 'unreadable' when j->>'hook' is null then 'missing:hook' when j->>'primitive' not in ({', '.join(repr(v) for v in responses.CATEGORIES)}) then 'primitive:' || (j->>'primitive') when j->>'tone' not in ({', '.join(repr(v) for v in responses.TONES)}) then 'tone:' || (j->>'tone') when j->>'emotional_hook' not in ({', '.join(repr(v) for v in responses.HOOKS)}) then 'emotional_hook:' || (j->>'emotional_hook') when j->>'support_level' not in ({', '.join(repr(v) for v in responses.SUPPORT)}) then 'support_level:' || (j->>'support_level') when (j->>'standalone_clarity')::int not between 0 and 10 then 'standalone_clarity:' || (j->>'standalone_clarity') end as fault from ok) """


@query("p37_spine_responses", TALES + "select event_id, fault, case when fault is null then (j->>'standalone_clarity')::int end as clarity, case when fault is null then j->>'primitive' end as category from f", ("fx_tales",))
def _(spark, d, tales):
    """Accepted narratives and the table of rejects, together."""
    accepted, rejected = responses.narratives(tales)
    return accepted.select("event_id", F.lit(None).cast("string").alias("fault"), F.col("spine.standalone_clarity").alias("clarity"), F.col("spine.primitive").alias("category")).unionByName(rejected.select("event_id", "fault"), allowMissingColumns=True)


@query("j05_latest_outputs", ", f as (select output_id, count(*) as n, string_agg(concat_ws(':', feedback_id, coalesce(likes, -1), coalesce(shares, -1)), ',' order by recorded_at, feedback_id) as told from fx_feedback group by 1) select o.output_id, o.run_id, o.created_at, i.source_name, i.url, i.title, coalesce(f.n, 0) as n_feedback, coalesce(f.told, '') as feedback from fx_outputs o left join fx_items i using (item_id) left join f on f.output_id = o.output_id", ("fx_items", "fx_outputs", "fx_feedback"))
def _(spark, d, items, outputs, feedback):
    """Every output with its source and feedback."""
    found = responses.latest_outputs(outputs, items, feedback)
    told = F.array_join(F.transform("feedback", lambda f: F.concat_ws(":", f["feedback_id"].cast("string"), F.coalesce(f["likes"], F.lit(-1)).cast("string"), F.coalesce(f["shares"], F.lit(-1)).cast("string"))), ",")
    return found.select("output_id", "run_id", "created_at", F.col("source.name").alias("source_name"), "source.url", "source.title", F.size("feedback").cast("long").alias("n_feedback"), told.alias("feedback"))
