"""DuckDB statements that answer the registered queries on their own.

Each is composed from named views below; ``_sql(final, *views)`` puts the views a
statement needs in a WITH clause.
"""

VIEWS = {
    "problems_docs": """
        select doc_id as id, lang as difficulty, source as tags, text as input from documents""",
    "problems_parts": """
        select p_partkey as id, p_type as difficulty, p_brand as tags, p_name as input from part""",
    "solutions_docs": """
        select doc_id as id,
          cast(generate_subscripts(string_split(text, chr(10)), 1) - 1 as integer) as sol_idx,
          unnest(string_split(text, chr(10))) as solution
        from documents""",
    "generations_conv": """
        select conv_id as task_id, turn as gen_idx,
          case when role = 'assistant' and turn % 3 = 0
               then '```python' || chr(10) || text || chr(10) || '```' || chr(10) || 'then' || chr(10)
                    || '```python' || chr(10) || 'import sys' || chr(10) || 'from os import *' || chr(10) || '```'
               when role = 'assistant'
               then 'Answer:' || chr(10) || '```python' || chr(10) || '  ' || text || chr(10) || chr(10) || '```'
               else text end as generated_text
        from conversations""",
    "parsed_conv": """
        select task_id, gen_idx,
          array_to_string(list_transform(
            regexp_extract_all(generated_text, '(?s)```python(.*?)```', 1),
            lambda b: regexp_replace(b, '^\\s+|\\s+$', '', 'g')), chr(10)) as code
        from generations_conv""",
    "line_tests": """
        select l_orderkey, l_linenumber, l_partkey as partkey, l_suppkey as suppkey,
          l_quantity as quantity, l_returnflag as flag,
          cast(row_number() over (partition by l_orderkey
            order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) - 1 as integer) as test_idx
        from lineitem""",
    "runs": """
        select o_custkey as task_id, o_orderkey as gen_idx,
          case o_orderstatus when 'P' then 'no_context' when 'O' then 'full_problem'
            else 'only_solutions' end as context_type,
          coalesce(test_idx, 0) as test_idx,
          case when l_orderkey is null then -2 when quantity > 10 then 1 when quantity > 5 then 0
            when quantity > 2 then -1 else -3 end as verdict
        from orders left join line_tests on l_orderkey = o_orderkey""",
    "verdicts": "select task_id, gen_idx, test_idx, verdict from runs",
    "event_verdicts": """
        select user_id as task_id, event_id as gen_idx, 0 as test_idx,
          case event_type when 'purchase' then 1 when 'view' then 0 when 'click' then -1
            when 'error' then -3 else -2 end as verdict
        from events""",
    "gens": """
        select task_id, gen_idx, min(verdict) > 0 as correct,
          count(*) filter (where verdict = 1) as hits, cast(count(*) as integer) as n_tests
        from verdicts group by all""",
    "totals": """
        select task_id, count(*) as n, count(*) filter (where correct) as c,
          cast(sum(hits) as bigint) as hits, max(n_tests) as max_tests
        from gens group by all""",
    "event_totals": """
        select task_id, count(*) as n, count(*) filter (where verdict > 0) as c
        from event_verdicts group by all""",
    "ks": "select unnest([1, 10, 100]) as k",
    "run_totals": """
        select context_type, task_id, count(*) as n, count(*) filter (where ok) as c,
          sum(hits) as hits, max(len) as len
        from (select context_type, task_id, gen_idx, min(verdict) > 0 as ok,
                count(*) filter (where verdict = 1) as hits, count(*) as len
              from runs group by all)
        group by all""",
    "run_scores": """
        select c_mktsegment as grp, context_type, task_id, c / n as pass_at_1,
          hits / (n * len) as normalized_sum
        from run_totals join customer on c_custkey = task_id""",
    "attempts": """
        select o_custkey as task_id, o_orderkey as gen_idx, test_idx, variant, attempt,
          case when variant = 2 then 0
               when attempt = 1 then case flag when 'R' then 0 when 'A' then 1 else 2 end
               when attempt = 2 then suppkey % 2 else partkey % 2 end as exit_code,
          attempt = 1 and l_linenumber = 7 as timed_out,
          attempt = 1 and partkey % 97 = 0 as launch_error,
          (partkey + attempt) % 4 = suppkey % 4 as same
        from orders join line_tests on l_orderkey = o_orderkey
        cross join (select unnest([1, 2, 3]) as attempt) cross join (select unnest([1, 2]) as variant)
        where variant = 1 or o_orderkey % 10 <> 3""",
    "statuses": """
        select task_id, gen_idx, variant, test_idx,
          case when bool_or(timed_out) then 'timeout'
               when bool_or(launch_error) then 'runtime_error'
               when min(attempt) filter (where exit_code = 0) is not null
               then case when arg_min(same, attempt) filter (where exit_code = 0)
                         then 'passed' else 'false' end
               else 'returncode:' || arg_max(exit_code, attempt) end as status
        from attempts group by task_id, gen_idx, variant, test_idx""",
    "resolved": """
        select s.task_id, s.gen_idx, s.test_idx, s.variant, s.status
        from statuses s join (
          select task_id, gen_idx,
            case when bool_and(status = 'returncode:1') filter (where variant = 1) and bool_or(variant = 2)
              then 2 else 1 end as v
          from statuses group by all) w
        on s.task_id = w.task_id and s.gen_idx = w.gen_idx and s.variant = w.v""",
    "task_tests": "select task_id, max(test_idx) + 1 as n_tests from verdicts group by task_id",
    "pairs": """
        select l_orderkey, l_linenumber, l_partkey, l_suppkey,
          p || chr(10) || s as expected,
          case l_linenumber
            when 1 then p || chr(10) || s
            when 2 then p || chr(10) || s || chr(10)
            when 3 then s || chr(10) || p
            when 4 then '  ' || p || ' ' || chr(10) || chr(10) || s || ' '
            when 5 then p || '.0' || chr(10) || s || '.0'
            when 6 then p || '.0000001' || chr(10) || s
            else cast(l_partkey + 1 as string) || chr(10) || s end as actual
        from (select *, cast(l_partkey as string) as p, cast(l_suppkey as string) as s from lineitem)""",
    # Both sides as token lists, lists of lines, and so on; no tier looks at raw text again.
    "cut": """
        select *,
          trim(actual, ' ' || chr(10)) as a, trim(expected, ' ' || chr(10)) as e,
          list_filter(regexp_split_to_array(actual, '\\s+'), lambda t: t <> '') as a_tokens,
          list_filter(regexp_split_to_array(expected, '\\s+'), lambda t: t <> '') as e_tokens,
          list_filter(list_transform(string_split(actual, chr(10)), lambda x: trim(x)), lambda x: x <> '') as a_lines,
          list_filter(list_transform(string_split(expected, chr(10)), lambda x: trim(x)), lambda x: x <> '') as e_lines
        from pairs""",
    "tiers": """
        select l_orderkey, l_linenumber, l_partkey, l_suppkey, expected, actual,
          a = e as exact,
          regexp_full_match(actual, '[0-9]*') and len(actual) = len(e_lines)
            and list_bool_and(list_transform(list_zip(string_split(actual, ''), e_lines),
              lambda z: abs(try_cast(z[1] as double) - try_cast(z[2] as double))
                   <= 1e-8 + 1e-5 * abs(try_cast(z[2] as double)))) as digits_close,
          list_sort(list_distinct(list_transform(a_tokens, lambda t: list_sort(list_distinct(string_split(t, ''))))))
            = list_sort(list_distinct(list_transform(e_lines,
                lambda x: list_sort(list_distinct(string_split(x, ' ')))))) as charset,
          regexp_full_match(array_to_string(a_tokens, ''), '[0-9]*')
            and list_sort(list_distinct(list_transform(a_tokens, lambda t: list_sort(list_distinct(
                  list_transform(string_split(t, ''), lambda d: try_cast(d as double)))))))
            = list_sort(list_distinct(list_transform(e_lines, lambda x: list_sort(list_distinct(
                  list_transform(string_split(x, ' '), lambda d: round(try_cast(d as double), 3)))))))
            as charset_rounded,
          a_lines = e_lines as lines,
          len(a_tokens) = len(e_tokens)
            and list_bool_and(list_transform(list_zip(a_tokens, e_tokens),
              lambda z: abs(cast(z[1] as double) - cast(z[2] as double))
                   <= 1e-8 + 1e-5 * abs(cast(z[2] as double)))) as numeric_close,
          list_sort(list_distinct(a_lines)) = list_sort(list_distinct(e_lines)) as unordered,
          list_sort(list_distinct(list_transform(a_lines, lambda x: round(cast(x as double), 3))))
            = list_sort(list_distinct(list_transform(e_lines, lambda x: round(cast(x as double), 3)))) as rounded
        from cut""",
    "samples": """
        select o_orderkey as id, o_orderstatus as st, test_idx,
          cast(partkey as string) as p, cast(suppkey as string) as s
        from orders join line_tests on l_orderkey = o_orderkey""",
    "documents_json": """
        select id, case when id % 50 = 0 then '{"inputs": [' else
          '{"inputs":[' || string_agg(case st when 'F' then '[{"' || s || '":' || p || '}]'
              when 'O' then '["' || p || '","' || s || '"]' else '"' || p || '\\n' || s || '"' end, ',' order by test_idx)
          || '],"outputs":[' || string_agg(case st when 'F' then '{"' || p || '":' || s || '}'
              when 'O' then '["' || s || '"]' else '"' || s || '"' end, ',' order by test_idx)
          || case st when 'F' then '],"fn_name":"solve"}' else ']}' end end as input_output
        from samples group by id, st""",
    "cases": """
        select id, test_idx, case st when 'F' then 'call_based' else 'standard_input' end as test_type,
          case st when 'F' then 'solve' end as fn_name, st, p, s,
          case st when 'F' then '[{"' || s || '":' || p || '}]'
              when 'O' then '["' || p || '","' || s || '"]' else '"' || p || '\\n' || s || '"' end as input,
          case st when 'F' then '{"' || p || '":' || s || '}'
              when 'O' then '["' || s || '"]' else '"' || s || '"' end as expected
        from samples where id % 50 <> 0""",
}

# Experiment designs: problems view, group column, fixed filter, least group size.
DESIGNS = {
    "parts": ("problems_parts", "tags", "difficulty = 'MEDIUM'", 6),
    "docs": ("problems_docs", "tags", "difficulty = 'en'", 6),
    "by_lang": ("problems_docs", "difficulty", "tags = 'src1'", 5),
}
for _name, (_view, _group, _fixed, _least) in DESIGNS.items():
    VIEWS[f"members_{_name}"] = f"select id, {_group} as grp, input from {_view} where {_fixed}"
    VIEWS[f"groups_{_name}"] = f"""
        select grp, count(id) as n_problems from members_{_name} group by grp
        having count(id) >= {_least}"""
    VIEWS[f"targets_{_name}"] = f"""
        select grp, id as target_id, target_pos, n_problems, n_problems < 5 as short
        from (select grp, id, cast(row_number() over (partition by grp order by md5('42:' || id), id) - 1
                as integer) as target_pos from members_{_name})
        join groups_{_name} using (grp) where target_pos < 5"""
    VIEWS[f"contexts_{_name}"] = f"""
        select * from (
          select grp, target_id, target_pos, id as context_id,
            cast(row_number() over (partition by grp, target_id
              order by md5('42:' || target_id || ':' || id), id) - 1 as integer) as context_pos
          from targets_{_name} join members_{_name} using (grp) where id <> target_id)
        where context_pos < 4"""

_FIRST = "select id, arg_min(solution, sol_idx) as solution from solutions_docs group by id"
VIEWS["firsts"] = _FIRST
VIEWS["context_rows"] = """
    select c.grp, c.target_id, c.target_pos, c.context_id, c.context_pos, d.input, f.solution
    from contexts_docs c join problems_docs d on d.id = c.context_id join firsts f on f.id = c.context_id"""
VIEWS["tasks"] = """
    select t.grp, t.target_id, t.target_pos,
      'Solve this task with a Python program.' || chr(10) || 'Task:' || chr(10) || d.input || chr(10)
        || 'Program:' || chr(10) as task
    from targets_docs t join problems_docs d on d.id = t.target_id"""


def _needed(text: str, seen: list[str]) -> list[str]:
    """Views a statement uses, each after the views it uses itself."""
    import re

    for name in VIEWS:
        if name not in seen and re.search(rf"\b(from|join)\s+{name}\b", text):
            _needed(VIEWS[name], seen)
            seen.append(name)
    return seen


def _sql(final: str) -> str:
    views = _needed(final, [])
    head = ",\n".join(f"{v} as ({VIEWS[v]})" for v in views)
    return f"with {head}\n{final}" if views else final


_PRODUCT = """
    case when n - c < k then 1.0
         else 1.0 - coalesce(list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1.0 - k / i)), 1.0) end"""


def _pass_columns(*ks: int) -> str:
    """pass@k as columns, null for more generations than the task has."""
    import re

    return ", ".join(
        f"case when n >= {k} then round({re.sub(r'\bk\b', str(k), _PRODUCT)}, 9) end as pass_at_{k}" for k in ks
    )


def _detail(totals: str) -> str:
    return f"""
        select task_id, n, c, k, round({_PRODUCT}, 9) as pass_at_k from {totals} join ks
        on k <= (select min(n) from {totals})"""


def _requests(n: int, batch: int) -> str:
    asked = n // batch * batch
    return f"""
        select run_index, context_type, grp, target_id, target_pos, total_runs,
          cast(g as integer) as gen_idx, {n - asked} as n_left_out, cast(g // {batch} as integer) as batch
        from ({_grid("parts")}), range({asked}) r(g)"""


def _grid(design: str, where: str = "true") -> str:
    return f"""
        select * from (
          select row_number() over (order by t, grp, target_pos) - 1 as run_index, context_type, grp,
            target_id, target_pos, count(*) over () as total_runs
          from targets_{design},
            (values (0, 'no_context'), (1, 'full_problem'), (2, 'only_solutions')) x(t, context_type))
        where {where}"""


def _tier(column: str) -> str:
    return f"""
        select l_orderkey, l_linenumber, l_partkey, l_suppkey, expected, actual,
          coalesce({column}, false) as matched from tiers"""


_ROUND_RUN = "grp, context_type, task_id, round(pass_at_1, 9) as pass_at_1, round(normalized_sum, 9) as normalized_sum"


def _delta(scores_view: str = "run_scores") -> str:
    mean = "avg({s}) filter (where context_type = '{t}')"
    names = ("no_context", "full_problem", "only_solutions")
    scores = ("pass_at_1", "normalized_sum")
    columns = [
        f"round({mean.format(s=s, t=t)}, 9) as {t}_{s}" for t in names for s in scores
    ] + [
        f"round({mean.format(s=s, t=t)} - {mean.format(s=s, t='no_context')}, 9) as delta_{t}_{s}"
        for t in names[1:]
        for s in scores
    ]
    return f"select grp, {', '.join(columns)} from {scores_view} group by grp"


def _manifest_json() -> str:
    return """
        select grp, '{"input_ids":[' || string_agg(cast(target_id as string), ',' order by target_pos)
          || '],"context_ids":{' || string_agg('"' || target_id || '":[' || ids || ']', ',' order by target_pos)
          || '}}' as document
        from (select grp, target_id, target_pos,
                string_agg(cast(context_id as string), ',' order by context_pos) as ids
              from contexts_parts group by all)
        group by grp"""


_VERDICT_CODES = """
    select task_id, gen_idx, test_idx, case status when 'passed' then 1 when 'false' then 0
      when 'timeout' then -1 else -3 end as verdict
    from resolved join orders on o_orderkey = gen_idx where o_orderpriority <> '5-LOW'
    union all
    select o_custkey, o_orderkey, 0, -2 from orders where o_orderpriority = '5-LOW'
    union all
    select o_custkey, o_orderkey, cast(i as integer), -1
    from orders join (select task_id, unnest(range(n_tests)) as i from task_tests) x on x.task_id = o_custkey
    where o_orderpriority <> '5-LOW' and o_orderkey not in (select l_orderkey from lineitem)"""
VIEWS["coded"] = _VERDICT_CODES

VIEWS["treatments"] = "select unnest(['no_context', 'full_problem', 'only_solutions']) as context_type"
VIEWS["treated"] = """
    select task_id, gen_idx, test_idx, context_type,
      case when timed_out then -1 when launch_error or exit_code <> 0 then -3
        when context_type = 'only_solutions' then 0
        when same or (context_type = 'full_problem' and gen_idx % 3 <> 0) then 1 else 0 end as verdict
    from attempts cross join treatments where variant = 1 and attempt = 1"""
VIEWS["treated_codes"] = """
    select t.* from treated t join orders on o_orderkey = gen_idx where o_orderpriority <> '5-LOW'
    union all
    select o_custkey, o_orderkey, 0, context_type, -2 from orders cross join treatments
    where o_orderpriority = '5-LOW'
    union all
    select o_custkey, o_orderkey, cast(unnest(range(coalesce(n, 1))) as integer), context_type, -1
    from orders cross join treatments
    left join (select task_id, max(test_idx) + 1 as n from attempts group by task_id) on task_id = o_custkey
    where o_orderpriority <> '5-LOW' and o_orderkey not in (select l_orderkey from lineitem)"""
VIEWS["treated_scores"] = """
    select grp, context_type, task_id, count(*) filter (where ok) / count(*) as pass_at_1,
      sum(hits) / (count(*) * max(len)) as normalized_sum
    from (select if(gen_idx % 2 = 0, 'even', 'odd') as grp, context_type, task_id, gen_idx,
            min(verdict) > 0 as ok, count(*) filter (where verdict = 1) as hits, count(*) as len
          from treated_codes group by all)
    group by all"""

VIEWS["run_sums"] = """
    select grp, context_type, task_id, count(*) as n, count(*) filter (where ok) as c,
      sum(hits) / (count(*) * max(len)) as total
    from (select if(gen_idx % 2 = 0, 'even', 'odd') as grp, context_type, task_id, gen_idx,
            min(verdict) > 0 as ok, count(*) filter (where verdict = 1) as hits, count(*) as len
          from treated_codes group by all)
    group by all"""
VIEWS["two_ks"] = "select unnest([1, 2]) as k"
VIEWS["programs"] = """
    select o_orderkey as id, o_orderstatus as st, g as gen_idx, g = 0 or o_orderkey % 7 <> 3 as compiled
    from orders cross join range(2) x(g)"""
VIEWS["program_tests"] = """
    select p.*, test_idx, count(*) over (partition by id, gen_idx) as n_tests,
      if(id % 50 <> 0 and (gen_idx = 0 or partkey % 3 <> 0), 1, 0) as verdict
    from programs p join line_tests on l_orderkey = id where compiled"""

_STAGES = ("view", "click", "signup", "error", "purchase")


def _stage_seconds(stage: str) -> str:
    of = f"filter (where event_type = '{stage}')"
    return f"(epoch_us(max(ts) {of}) - epoch_us(min(ts) {of})) / 1e6 as {stage}_seconds,"


_PROMPTS = {
    "no_context": "select grp, target_id, target_pos, task as prompt from tasks",
    "full_problem": """
        select t.grp, t.target_id, t.target_pos,
          'Topic: ' || t.grp || '. Solved tasks come first.' || chr(10)
          || string_agg('Task ' || i || ':' || chr(10) || input || chr(10) || 'Program ' || i || ':' || chr(10)
               || solution || chr(10), '' order by i) || any_value(task) as prompt
        from tasks t join (select *, row_number() over (partition by grp, target_id order by context_pos) - 1 as i
                           from context_rows) c on c.grp = t.grp and c.target_id = t.target_id
        group by t.grp, t.target_id, t.target_pos""",
    "only_solutions": """
        select t.grp, t.target_id, t.target_pos,
          'Topic: ' || t.grp || '. Programs for similar tasks come first.' || chr(10)
          || string_agg('Program ' || i || ':' || chr(10) || solution || chr(10), '' order by i)
          || any_value(task) as prompt
        from tasks t join (
          select grp, target_id, solution, row_number() over (partition by grp, target_id order by first_pos) - 1 as i
          from (select grp, target_id, solution, min(context_pos) as first_pos from context_rows group by all)) c
        on c.grp = t.grp and c.target_id = t.target_id
        group by t.grp, t.target_id, t.target_pos""",
}

ORACLES = {
    "scan_problems": "select * from problems_docs",
    "scan_arrow_ipc": "select * from part",
    "scan_arrow_filtered": "select * from part where p_partkey between 20 and 60",
    "scan_solutions": "select * from solutions_docs",
    "scan_tests": "select id, test_idx, input, expected from cases",
    "scan_tests_one_id": "select id, test_idx, input, expected from cases where id = 1",
    "raw_samples": "select id, input_output from documents_json",
    "read_generations": "select * from generations_conv",
    "load_generation_last_wins": """
        select conv_id as task_id, turn as gen_idx, text as code from conversations c
        where (role = 'assistant') = (select bool_or(role = 'assistant') from conversations d
                                      where d.conv_id = c.conv_id)""",
    "manifest_export": _manifest_json(),
    "manifest_roundtrip": "select * from contexts_by_lang",
    "manifest_files_nested": "select * from contexts_parts",
    "manifest_files_flat": "select * from contexts_by_lang",
    "manifest_document_nested": "select * from contexts_parts",
    "manifest_document_flat": "select * from contexts_by_lang",
    "generation_files": """
        select task_id, row_number() over (partition by task_id order by gen_idx) - 1 as gen_idx, generated_text
        from generations_conv""",
    "parsed_files": """
        select task_id, cast(row_number() over (partition by task_id order by gen_idx) - 1 as integer) as gen_idx, code
        from parsed_conv""",
    "metrics_files": f"""
        select task_id, {_pass_columns(1, 10, 100)}, round(passed / n, 9) as total,
          cast(row_number() over (partition by task_id order by gen_idx) - 1 as integer) as gen_pos,
          '[' || verdict || ']' as verdicts
        from event_verdicts join event_totals using (task_id)
        join (select task_id, count(*) filter (where verdict = 1) as passed from event_verdicts group by all) using (task_id)""",
    "parsed_export": "select * from parsed_conv",
    "metrics_roundtrip": f"""
        select task_id, {_pass_columns(1, 10, 100)}, max_tests as n_tests,
          round(hits / (n * max_tests), 9) as total from totals""",
    "run_log": f"""
        select {_ROUND_RUN}, task_id || '_' || context_type || '_' || grp as run_name,
          {", ".join(f"{stage}_seconds" for stage in _STAGES)}, total_seconds
        from run_scores left join (
          select user_id,
            {" ".join(map(_stage_seconds, _STAGES))}
            (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as total_seconds
          from events group by user_id) on user_id = task_id""",
    "run_log_again": f"""
        select {", ".join("s." + c.strip() for c in ("grp", "context_type", "task_id"))},
          round(pass_at_1, 9) as pass_at_1, round(normalized_sum, 9) as normalized_sum,
          s.task_id || '_' || s.context_type || '_' || s.grp as run_name,
          {", ".join(f"{stage}_seconds" for stage in _STAGES)}, total_seconds, run_index
        from run_scores s
        left join (
          select user_id, ['no_context', 'full_problem', 'only_solutions'][event_id % 3 + 1] as context_type,
            {" ".join(map(_stage_seconds, _STAGES))}
            (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as total_seconds
          from events group by all) e on e.user_id = s.task_id and e.context_type = s.context_type
        join (
          select row_number() over (order by t, c_mktsegment, c_custkey) - 1 as run_index, context_type, c_custkey
          from customer, (values (0, 'no_context'), (1, 'full_problem'), (2, 'only_solutions')) x(t, context_type)) g
        on g.c_custkey = s.task_id and g.context_type = s.context_type""",
    "scores_from_store": """
        select context_type, task_id, n, c, cast(hits as bigint) as hits, cast(len as integer) as max_tests,
          round(hits / (n * len), 9) as total
        from run_totals""",
    "quarantined_samples": """
        select id, cast(null as integer) as test_idx, '{"inputs": [' as input_output, 'bad_json' as reason
        from (select distinct id from samples) where id % 50 = 0
        union all
        select id, test_idx, '{"inputs":[7],"outputs":' || expected || '}', 'not_text'
        from cases where id % 10 = 1 and st <> 'F' and test_idx = 0""",
    "staged_tests": """
        select id, test_idx, test_type,
          case st when 'F' then input else p || chr(10) || s end as input,
          case st when 'F' then expected else s end as expected
        from cases where not (id % 10 = 1 and st <> 'F' and test_idx = 0)""",
    "filter_difficulty": "select * from problems_parts where difficulty = 'MEDIUM'",
    "lookup_input": """
        select p_partkey as id, input, d.id is not null as found
        from part left join problems_docs d on d.id = p_partkey""",
    "context_members": """
        select c.*, input from contexts_docs c join problems_docs d on d.id = c.context_id""",
    "eligible_problems": """
        select p.* from problems_parts p where difficulty = 'MEDIUM'
        and tags in (select grp from groups_parts)""",
    "context_pairs": "select * from context_rows",
    "pairing_report": """
        select coalesce(g.task_id, d.id) as task_id, coalesce(g.n, 0) as n_generations,
          coalesce(d.n, 0) as n_samples,
          case when d.n is null then 'no_sample' when g.n is null then 'no_generation'
            else 'paired' end as status
        from (select task_id, count(*) as n from generations_conv group by all) g
        full join (select id, count(*) as n from problems_docs group by all) d on d.id = g.task_id""",
    "eligible_groups": "select * from groups_parts",
    "eligible_groups_by_difficulty": "select * from groups_by_lang",
    "n_eligible_tags": "select count(distinct grp) as n_tags from groups_parts",
    "distinct_inputs": "select distinct input from problems_docs",
    "first_solution": "select id, solution from solutions_docs where sol_idx = 0",
    "task_totals": "select * from totals",
    "preview_head": """
        select p.* from problems_parts p where difficulty = 'MEDIUM'
        and tags in (select grp from groups_parts) order by id limit 5""",
    "sample_targets": "select * from targets_parts",
    "sample_targets_merged": "select * from targets_parts",
    "n_tags_sketch": "select count(*) as n_tags from groups_parts",
    "sample_targets_by_difficulty": "select * from targets_by_lang",
    "sample_contexts": "select * from contexts_parts",
    "sample_contexts_cross": """
        with doc as (select doc_id as id, source as grp, doc_id in (select doc_id from labels) as test
                     from documents where lang = 'en'),
        size as (select grp from doc where test group by grp having count(*) >= 6),
        target as (select grp, id as target_id, cast(pos - 1 as integer) as target_pos from (
            select grp, id, row_number() over (partition by grp order by md5('42:' || id), id) as pos
            from doc where test) join size using (grp) where pos <= 5)
        select grp, target_id, target_pos, id as context_id, cast(pos - 1 as integer) as context_pos
        from (select grp, target_id, target_pos, id, row_number() over (partition by grp, target_id
                order by md5('42:' || target_id || ':' || id), id) as pos
              from target join doc using (grp) where not test and id <> target_id)
        where pos <= 4""",
    "explicit_manifest": """
        select 'order-' || l_orderkey as grp, t.partkey as target_id, 0 as target_pos,
          c.test_idx - 1 as context_pos, c.partkey as context_id
        from (select * from line_tests where test_idx = 0) t
        left join (select * from line_tests where test_idx > 0) c using (l_orderkey)""",
    "context_cosine": """
        with v as (select vec_id as id, label as grp, cast(embedding as double[]) as x from embeddings),
        sized as (select grp from v group by grp having count(*) >= 6),
        target as (select grp, id as target_id, x as tx, cast(pos - 1 as integer) as target_pos from (
            select grp, id, x, row_number() over (partition by grp order by md5('42:' || id), id) as pos from v)
            join sized using (grp) where pos <= 5),
        scored as (select grp, target_id, target_pos, id as context_id,
            round(list_inner_product(x, tx) / sqrt(list_inner_product(x, x) * list_inner_product(tx, tx)), 6) as cosine
            from target join v using (grp) where id <> target_id)
        select grp, target_id, target_pos, context_id, cosine, cast(pos - 1 as integer) as context_pos
        from (select *, row_number() over (partition by grp, target_id order by cosine desc, context_id) as pos
              from scored) where pos <= 4""",
    **{f"prompts_{name}": text for name, text in _PROMPTS.items()},
    "prompts_by_run": " union all ".join(
        f"select *, '{name}' as context_type from ({text})" for name, text in _PROMPTS.items()
    ),
    "run_grid": _grid("parts", "run_index between 0 and 75"),
    "run_grid_by_difficulty": _grid("by_lang", "run_index >= 0 and run_index < 45"),
    "generation_requests": _requests(60, 25),
    "extract_code": "select * from parsed_conv",
    "code_line_types": """
        select task_id, case when line like '%import *%' then 2
            when line like 'from %' or line like 'import %' then 1 else 0 end as line_type,
          count(*) as n_lines
        from (select task_id, unnest(string_split(code, chr(10))) as line from parsed_conv) group by all""",
    "test_cases": "select id, test_idx, test_type, fn_name, input, expected from cases",
    "unreadable_samples": """
        select id, input_output, 'bad_json' as reason from documents_json where not json_valid(input_output)""",
    "normalise_io": """
        select id, test_idx, test_type,
          case st when 'F' then input else p || chr(10) || s end as input,
          case st when 'F' then expected else s end as expected,
          case st when 'F' then s || '=' || p end as input_map,
          case st when 'F' then p || '=' || s end as expected_map
        from cases""",
    "resolve_attempts": "select * from statuses",
    "variant_fallback": "select * from resolved",
    "broadcast_verdict": """
        select v.task_id, v.gen_idx, cast(x.i as integer) as test_idx, v.verdict
        from (select task_id, gen_idx, max(verdict) as verdict from verdicts group by all
              having count(*) = 1 and max(verdict) <> -2) v
        join (select task_id, unnest(range(n_tests)) as i from task_tests) x on x.task_id = v.task_id
        union all
        select task_id, gen_idx, test_idx, verdict from verdicts where gen_idx in (
          select gen_idx from verdicts group by gen_idx having count(*) > 1 or max(verdict) = -2)""",
    "verdict_codes": "select * from coded",
    "scores_from_attempts": """
        select task_id, count(*) as n, count(*) filter (where ok) as c,
          round(sum(hits) / (count(*) * max(len)), 9) as total,
          round(count(*) filter (where ok) / count(*), 9) as pass_at_1
        from (select task_id, gen_idx, min(verdict) > 0 as ok, count(*) filter (where verdict = 1) as hits,
                max(test_idx) + 1 as len from coded group by all)
        group by task_id""",
    "experiment_end_to_end": _delta("treated_scores"),
    "experiment_pass_at_k": f"""
        select grp, context_type, k, round(avg(v), 9) as pass_at_k
        from (select grp, context_type, n, k, {_PRODUCT} as v from run_sums cross join two_ks)
        group by grp, context_type, k having k <= min(n)""",
    "experiment_detail": """
        select grp, context_type, task_id, n, c, 1 as k, round(c / n, 9) as pass_at_k, round(total, 9) as total
        from run_sums""",
    "judged_problems": """
        select id as task_id, gen_idx, test_idx, verdict from program_tests where st <> 'F'
        union all
        select id, gen_idx, cast(unnest(range(if(id % 50 = 0, 1, n_tests))) as integer), verdict
        from program_tests where st = 'F' and test_idx = 0
        union all
        select id, gen_idx, 0, -2 from programs where not compiled
        union all
        select id, gen_idx, 0, -1 from programs where compiled and id not in (select l_orderkey from lineitem)""",
    "compare_exact": _tier("exact"),
    "compare_digits_close": _tier("digits_close"),
    "compare_charset": _tier("charset"),
    "compare_charset_rounded": _tier("charset_rounded"),
    "compare_lines": _tier("lines"),
    "compare_numeric": _tier("numeric_close"),
    "compare_unordered": _tier("unordered"),
    "compare_rounded": _tier("rounded"),
    "compare_first_tier": """
        select l_orderkey, l_linenumber, l_partkey, l_suppkey, expected, actual,
          case when exact then 'exact' when digits_close then 'digits_close' when charset then 'charset'
            when charset_rounded then 'charset_rounded' end as effective_tier,
          case when exact then 'exact' when lines then 'lines' when numeric_close then 'numeric' end as strict_tier,
          case when exact then 'exact' when lines then 'lines' when numeric_close then 'numeric'
            when unordered then 'unordered' when rounded then 'rounded' end as intent_tier
        from tiers""",
    "compare_call": """
        select l_orderkey, l_linenumber, l_partkey, l_suppkey,
          case l_linenumber when 1 then '[' || p || ', ' || s || ']' when 2 then '[' || p || '.0,' || s || 'e0]'
            when 3 then '[' || p || ',' || s || ']' when 4 then '{"b": [' || s || ', null], "a": ' || p || '}'
            when 5 then s when 6 then '"' || s || ' ' || p || '"' else '[' || p || ',' || s || ']' end as actual,
          case when l_linenumber in (1, 2) then '[' || p || ',' || s || ']'
            when l_linenumber = 3 then '[[' || p || ',' || s || '],"x"]'
            when l_linenumber = 4 then '{"a":' || p || ',"b":[' || s || ',null]}'
            when l_linenumber = 5 then '[' || p || ']' when l_linenumber = 6 then '"' || p || ' ' || s || '"'
            else '["' || p || '",' || s || ']' end as expected,
          case when l_linenumber <= 4 then true when l_linenumber <= 6 then l_partkey = l_suppkey
            else false end as matched
        from (select *, cast(l_partkey as string) as p, cast(l_suppkey as string) as s from lineitem)""",
    "generation_correct": "select * from gens",
    "explode_results": "select * from verdicts",
    "results_by_generation": """
        select task_id, gen_idx, '[' || string_agg(cast(verdict as string), ',' order by test_idx) || ']' as verdicts
        from verdicts group by all""",
    "pass_at_k_detail": _detail("event_totals"),
    "pass_at_k_detail_orders": _detail("totals"),
    "pass_at_k": f"""
        select k, round(avg(v), 9) as pass_at_k
        from (select k, n, {_PRODUCT} as v from event_totals cross join ks)
        group by k having k <= min(n)""",
    "tests_passed_by_position": """
        select task_id, test_idx, count(*) filter (where verdict = 1) as n_passed from verdicts group by all""",
    "normalized_sum": """
        select task_id, n, max_tests, hits, round(hits / (n * max_tests), 9) as total from totals""",
    "live_scores": """
        select task_id, n, c, round(c / n, 9) as pass_at_1, round(hits / (n * max_tests), 9) as normalized_sum
        from totals""",
    "verdict_histogram": """
        select verdict, count(*) as n_tests, case verdict when 1 then 'passed' when 0 then 'false'
          when -1 then 'timeout' when -2 then 'compile_error' else 'runtime_error' end as status
        from verdicts group by verdict""",
    "run_results": f"select {_ROUND_RUN} from run_scores",
    "context_delta": _delta(),
    "stage_durations": """
        select user_id as run_id, coalesce(event_type, 'total') as stage,
          (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as seconds
        from events group by grouping sets ((user_id, event_type), (user_id))""",
}
ORACLES["context_cosine_index"] = ORACLES["context_cosine"]
ORACLES = {name: _sql(text) if not text.lstrip().startswith("with") else text for name, text in ORACLES.items()}
