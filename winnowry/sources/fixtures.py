"""Item, candidate, response, output and feedback views over the given tables, as SQL that Spark and DuckDB share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

ITEMS = """
select k as item_id, k as pos,
 concat('https://', case when k%5=0 then 'WWW.' else 'www.' end, 's', cast(c%9 as string), '.example.org/a/', cast(k - k%4 as string), case when k%3=0 then '/' else '' end) as url,
 concat('Source ', cast(c%9 as string)) as source_name,
 case when k%11=0 then null else ts end as published_at,
 case cast(c%4 as int) when 0 then 'paper' when 1 then 'press_release' when 2 then 'policy' else 'news' end as content_type,
 case cast(tpl as int)
  when 0 then concat('Study finds ', cast(1+v%90 as string), '% lower risk compared to a control group over ', cast(1+v%11 as string), ' weeks')
  when 1 then concat('Drink tea daily to reduce pain in the knee within ', cast(1+v%30 as string), ' days')
  when 2 then 'Regular exercise is good for your health'
  when 3 then concat('FDA warning: product now classified as group ', cast(1+v%3 as string))
  when 4 then concat('Infant cortisol fell ', cast(1+v%60 as string), '% after ', cast(1+v%9 as string), ' months')
  when 5 then concat('Biological age reversed by ', cast(1+v%20 as string), ' years in a trial')
  when 6 then 'Board approves strategic framework for stakeholders'
  when 7 then 'Trial shows no significant difference'
  when 8 then concat('Brain volume shrinks ', cast(1+v%9 as string), '.5% per decade!')
  when 9 then concat('Eating walnut and salmon cuts inflammation by ', cast(1+v%40 as string), '%')
  when 10 then 'Tickets available for the documentary screening'
  else concat('Sleep ', cast(4+v%6 as string), ' hours: 3.5-fold higher stress, n=', cast(100+v%900 as string), ' adults aged 50-70') end as title,
 repeat(concat('Adults were followed for ', cast(1+v%15 as string), ' years. '), cast(5+v%60 as int)) as body_text
from (select o_orderkey k, o_custkey c, o_orderdate ts, cast(floor(o_totalprice) as bigint) v, (o_orderkey*7 + o_custkey) % 12 tpl from orders)
"""
CANDIDATES = """
select cast(l_orderkey % 50 as bigint) as run_id, cast((l_orderkey*10 + l_linenumber)*1000000 + l_partkey as bigint) as pos,
 case cast(l_partkey % 7 as int) when 0 then 'SIMPLE_HABIT' when 1 then 'WARNING_RISK' when 2 then 'NEWS_POLICY' when 3 then 'COUNTERINTUITIVE' else 'STUDY_STAT' end as archetype,
 cast(l_quantity as int) as score, cast(l_suppkey % 4 + 7 as int) as clarity
from lineitem
"""
RESPONSES = """
select event_id, case when event_id % 10 = 0 then concat('```json {"relevant": true, "virality_score": ', cast(cast(floor(value) as bigint) as string), '} ```')
 when event_id % 10 = 1 then 'not json'
 else concat('{"relevant": ', case when event_id%3=0 then 'false' else 'true' end, ', "virality_score": ', cast(cast(floor(value) as bigint) as string), ', "suggested_archetype": "', case when event_id%4=0 then 'OTHER' else 'IF_THEN' end, '"}') end as response
from events
"""
OUTPUTS = """
select cast(l_orderkey*10 + l_linenumber as bigint) as output_id, l_orderkey as item_id, concat('run_', cast(l_suppkey % 20 as string)) as run_id, l_shipdate as created_at, l_returnflag as status_code, cast(l_quantity as int) as virality_score
from lineitem
"""
FEEDBACK = """
select event_id as feedback_id, cast((event_id % 100)*10 + event_id % 7 as bigint) as output_id, cast(floor(value) as bigint) as likes, case when event_id%2=0 then user_id else null end as shares, ts as recorded_at
from events
"""
SPINES = f"""
select item_id, pos, item_id % 7 <> 0 as relevant, title as hook, source_name, url, cast(5 + item_id % 6 as int) as clarity,
 case cast(item_id % 9 as int) when 0 then 'STUDY_SHOCK_COMPARISON' when 1 then 'SIMPLE_HACK_PAIN_RELIEF' when 2 then 'FOOD_SYMPTOM_BENEFIT' when 3 then 'PARENT_CHILD_BIO' when 4 then 'AUTHORITY_CLASSIFICATION' when 5 then 'CULTURE_CONTROVERSY' when 6 then 'TIME_REVERSAL' when 7 then 'BODY_PART_SPECIFIC' else 'NONE' end as category,
 case when item_id % 3 = 0 then null else 'walk daily' end as action, case when item_id % 2 = 0 then '12%' else '' end as number, case when item_id % 4 = 0 then 'adults aged 50' else '' end as population,
 case when item_id % 5 = 0 then 'short' else 'people can act on it today' end as why, case when item_id % 8 = 0 then 'none' else 'surprise' end as emotional_hook, case when item_id % 6 = 0 then 'over 8 weeks' else '' end as time_window
from ({ITEMS}) i
"""
EXPORTS = f"""
select item_id, pos, concat('run_', cast(item_id % 5 as string)) as run_id, title, source_name, url, published_at, content_type, hook, category, why, emotional_hook, clarity,
 case cast(item_id % 3 as int) when 0 then 'A' when 1 then 'B' else 'C' end as credibility_tier, upper(title) as image_headline, concat(title, ' Source: ', source_name) as caption,
 cast(item_id % 101 as int) as likeness, cast(item_id * 7 % 101 as int) as category_score, cast(cast(item_id % 997 as decimal(12, 3)) / 8 as decimal(12, 3)) as final_score,
 case when item_id % 3 = 0 then null else 'walk daily' end as action, case when item_id % 4 = 1 then null else 'less pain' end as outcome, case when item_id % 2 = 0 then '12%|3' else '' end as numbers_text,
 case when item_id % 6 = 0 then 'over 8 weeks' else null end as time_window, case when item_id % 4 = 0 then 'adults aged 50' else null end as who, case when item_id % 5 = 0 then null else 'lower cortisol' end as mechanism,
 case cast(item_id % 5 as int) when 0 then 'shock' when 1 then 'awe' when 2 then 'concern' when 3 then 'warmth' else 'humor' end as tone, case cast(item_id % 4 as int) when 0 then 'strong' when 1 then 'moderate' when 2 then 'emerging' else 'preliminary' end as support_level,
 case when item_id % 7 = 0 then null else 'a knee, close' end as image_suggestion, 'number first|two lines' as layout_text, case when item_id % 9 = 0 then '' else 'LOWER|RISK' end as highlight_text,
 case when item_id % 8 = 0 then null else 'STUDY_STAT' end as archetype, item_id % 7 <> 0 as relevant, case when item_id % 7 = 0 then 'off topic' else null end as relevance_reason, case when item_id % 10 = 0 then null else cast(item_id % 100 as int) end as virality_score, cast(case when item_id % 10 = 0 then null else cast(item_id % 1000 as decimal(12, 3)) / 1000 end as decimal(12, 3)) as confidence,
 case when item_id % 3 = 0 then '' when item_id % 3 = 1 then null else title end as finding, case when item_id % 9 = 0 then null else concat('claim ', cast(item_id as string)) end as claim, case when item_id % 11 = 0 then '' else 'short|telling' end as reasons_text, case when item_id % 4 = 2 then null else 'RCT' end as study_type
from (select item_id, pos, title, source_name, url, published_at, content_type, title as hook, case cast(item_id % 3 as int) when 0 then 'STUDY_SHOCK_COMPARISON' when 1 then 'FOOD_SYMPTOM_BENEFIT' else 'NONE' end as category, case when item_id % 5 = 0 then 'short' else 'people can act on it today' end as why, case when item_id % 8 = 0 then 'none' else 'surprise' end as emotional_hook, cast(5 + item_id % 6 as int) as clarity from ({ITEMS}) i) e
"""
REPLIES = """
select event_id, case when event_id % 17 = 0 then 'no json at all' when event_id % 19 = 0 then '{"relevant": true, "virality' else concat(case cast(event_id % 5 as int) when 0 then '```json ' when 1 then 'Here it is: ' else '' end,
 '{"relevant": ', case when event_id % 3 = 0 then 'false' else 'true' end, ', "rejection_reason": ', case when event_id % 6 = 0 then '"off topic"' else 'null' end, case when event_id % 4 = 0 then ', "reason": "because"' else '' end,
 ', "study_type": "', case when event_id % 7 = 0 then 'guess' else 'RCT' end, '", "population": ', case when event_id % 5 = 0 then 'null' when event_id % 5 = 1 then '"all"' else '"adults over 50"' end, ', "sample_size": "', case when event_id % 4 = 1 then '' else cast(event_id % 900 as string) end,
 '", "time_window": ', case when event_id % 3 = 1 then '"8 weeks"' else 'null' end, ', "most_surprising_finding": "finding ', cast(event_id as string), '", "extracted_claim": ', case when event_id % 2 = 0 then '""' else '"the claim"' end,
 ', "must_include_numbers": [', case when event_id % 4 = 3 then '' else '"12%", "3 years"' end, '], "suggested_archetype": "', case when event_id % 8 = 0 then 'OTHER' else 'IF_THEN' end, '", "virality_score": ', case when event_id % 9 = 0 then 'null' when event_id % 9 = 1 then '"55"' when event_id % 9 = 2 then '140' when event_id % 9 = 3 then '-3' else cast(cast(floor(value) as bigint) as string) end,
 ', "confidence": ', case when event_id % 10 = 0 then '1.5' when event_id % 10 = 1 then 'null' else '0.25' end, case when event_id % 11 = 0 then '' else ', "why_it_will_work": ["short", "telling"]' end, '}', case cast(event_id % 5 as int) when 0 then ' ``` and so on' when 1 then ' hope it helps' else '' end) end as response
from events
"""
TALES = """
select event_id, case when event_id % 23 = 0 then '{"relevant": tr' else concat('{"relevant": true, "primitive": "', case when event_id % 7 = 0 then 'OTHER' else 'TIME_REVERSAL' end, '", "hook": ', case when event_id % 13 = 0 then 'null' else '"a hook"' end, ', "numbers": ["12%"], "mechanism_clause": "m", "why_it_matters": "w", "standalone_clarity": ', cast(event_id % 13 as string),
 ', "tone": "', case when event_id % 5 = 0 then 'anger' else 'awe' end, '", "emotional_hook": "', case when event_id % 11 = 0 then 'joy' else 'hope' end, '", "support_level": "', case when event_id % 9 = 0 then 'weak' else 'strong' end, '"}') end as response
from events
"""
VIEWS = {"fx_replies": (REPLIES, "events"), "fx_tales": (TALES, "events"), "fx_export": (EXPORTS, "orders"), "fx_spine": (SPINES, "orders"), "fx_items": (ITEMS, "orders"), "fx_candidates": (CANDIDATES, "lineitem"), "fx_responses": (RESPONSES, "events"), "fx_outputs": (OUTPUTS, "lineitem"), "fx_feedback": (FEEDBACK, "events")}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over its table, as a DataFrame."""
    sql, table = VIEWS[name]
    held = f"{table}_{uuid.uuid4().hex}"
    spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(held)
    return spark.sql(sql.replace(f"from {table}", f"from {held}"))


def ctes(*names: str) -> str:
    return "with " + ", ".join(f"{n} as ({VIEWS[n][0]})" for n in names) + " "
