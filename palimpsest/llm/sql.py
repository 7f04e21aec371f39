"""The SQL that checks the queries it can express."""

_TURNS = r"""
with once as (
  select uid, any_value(session_id) as session_id, any_value(sample_id) as sample_id, any_value(role) as role,
    any_value(message_index) as pos_no, any_value(timestamp) as ts, any_value(text_content) as text
  from memory_units where session_id is not null group by uid),
told as (
  select o.uid, o.session_id, o.pos_no, nullif(o.ts, 0) as ts, coalesce(not regexp_matches(o.text, '[^\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]'), true) as blank,
    case when lower(trim(o.role)) in ('user', 'human') or lower(trim(o.role)) = lower(trim(s.user_name)) then 'user'
      when lower(trim(o.role)) in ('assistant', 'ai', 'bot', 'model') or lower(trim(o.role)) = lower(trim(s.agent_name)) then 'assistant'
      when lower(trim(o.role)) = 'system' then 'system' end as role
  from once o left join chat_samples s using (sample_id)),
sound as (
  select session_id, count(pos_no) > 0 as placed from told group by session_id
  having count(role) = count(*) and ((count(pos_no) = 0 and count(ts) = count(*)) or (count(pos_no) = count(*) and count(distinct pos_no) = count(*) and min(pos_no) = 0 and max(pos_no) = count(*) - 1))),
turns as (
  select t.session_id, t.uid, t.role, row_number() over (partition by t.session_id order by case when placed then pos_no else ts end, t.uid) as turn_no
  from told t join sound using (session_id) where not blank),
ends as (
  select session_id from turns where role <> 'system' group by session_id having arg_min(role, turn_no) = 'user' and arg_max(role, turn_no) = 'assistant')
"""

_ALIKE = r"""
with recursive words as (
  select fact_id, unnest(list_distinct(regexp_extract_all(lower(any_value(coalesce(content, '')) || ' ' || any_value(coalesce(array_to_string(retrieval_keys, ' '), ''))), '[\p{L}\p{N}]+'))) as word
  from episodic_facts group by fact_id),
sizes as (select fact_id, count(*) as n from words group by fact_id),
shared as (
  select a.fact_id as fact_id_a, b.fact_id as fact_id_b, count(*) as common
  from words a join words b on a.word = b.word and a.fact_id < b.fact_id group by 1, 2),
pairs as (
  select fact_id_a, fact_id_b from shared join sizes a on a.fact_id = fact_id_a join sizes b on b.fact_id = fact_id_b
  where common * 10 >= 6 * (a.n + b.n - common))
"""

ORACLES = {
    "p1_found": _ALIKE + "select * from pairs",
    "p3_found": _TURNS + "select session_id, cast(turn_no as int) as turn_no, uid from turns join ends using (session_id)",
    "p3_turns": _TURNS + "select session_id, cast(turn_no as int) as turn_no, uid, role from turns join ends using (session_id)",
    "p4_found": """
select distinct u.uid from memory_units u join chat_samples s using (sample_id) join orchestrator_configs c using (config_id)
where length(u.text_content) > c.chunk_size""",
    "p7_round_trip": "select doc_id, coalesce(text, '') as text from documents",
}
