"""DuckDB statements for the queries that SQL can express."""

from evalweave.llm import quality, warc

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]"


def _line_fails(line: str) -> str:
    symbols = f"length({line}) - length(regexp_replace({line}, '{quality.SYMBOL_CLASS}', '', 'g'))"
    rules = [
        f"not regexp_matches({line}, '^{_SPACE}*{_WORD}+({_SPACE}+{_WORD}+){{{quality.MIN_LINE_WORDS - 1}}}')",
        f"({symbols}) * {quality.CHARACTERS_PER_SYMBOL} > length({line})",
        f"not regexp_matches({line}, '[.!?:;…。！？][\"'')\\]”’»]*({_SPACE}|$)')",
        rf"(not regexp_matches({line}, '\p{{Ll}}') and regexp_matches({line}, '\p{{Lu}}{{2}}'))",
        *[f"contains(lower({line}), '{phrase}')" for phrase in quality.PHRASES],
    ]
    return "(" + " or ".join(rules) + ")"


def _judged(documents: str) -> str:
    """CTEs from ``documents`` to ``verdicts``, one row per row of the table."""
    return f"""
    numbered as (
        select row_number() over () as n, coalesce(text, '') as txt, * from {documents}
    ),
    words as (
        select n, list_filter(string_split_regex(txt, '{_SPACE}+'), lambda x: x <> '') as w from numbered
    ),
    spots as (
        select n, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as k
        from (select n, w, unnest(range(1, len(w) - 1)) as i from words)
    ),
    twice as (
        select n, i from (select n, i, count(*) over (partition by n, k) as times from spots) where times > 1
    ),
    covered as (
        select n, count(distinct spot) as repeated
        from (select n, unnest([i, i + 1, i + 2]) as spot from twice) group by n
    ),
    lines as (
        select n, list_filter(string_split(txt, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) as l from numbered
    ),
    cleaned as (
        select n, l, list_filter(l, lambda x: not {_line_fails('x')}) as good from lines
    ),
    counted as (
        select d.*,
            cast(len(w) as bigint) as n_words,
            cast(coalesce(length(array_to_string(w, '')), 0) as bigint) as word_chars,
            cast(length(txt) - length(regexp_replace(txt, '{quality.SYMBOL_CLASS}', '', 'g')) as bigint) as n_symbols,
            cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines,
            cast(coalesce(repeated, 0) as bigint) as n_repeat_words,
            cast(len(l) as bigint) as n_lines,
            cast(len(l) - len(good) as bigint) as n_removed_lines,
            coalesce(array_to_string(good, chr(10)), '') as clean_text,
            coalesce(array_to_string(l, chr(10)), '') as line_text
        from numbered d join words using (n) join cleaned using (n) left join covered using (n)
    ),
    based as (
        select *, n_words < {quality.MIN_WORDS}
            or 100 * n_repeat_words > {quality.MAX_REPEATED_PERCENT} * n_words as base_failed
        from counted
    ),
    verdicts as (
        select *, not base_failed
            and 100 * length(clean_text) >= {quality.MIN_KEPT_PERCENT} * length(line_text) as kept
        from based
    )"""


OP5 = f"""
with {_judged('documents')}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_removed_lines,
    base_failed, kept
from verdicts
"""



def _canonical(url: str) -> str:
    """``warc.canonical_url`` as a CTE body: ``url`` of each row of a table, renewed."""
    origin = "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*"
    return f"""
    select * exclude (plain, head, rest),
        regexp_replace(regexp_replace(head, '^(http://[^:]*):80$', '\\1'), '^(https://[^:]*):443$', '\\1')
        || regexp_replace(regexp_replace(rest, '\\?.*$', ''), '/+$', '')
        || coalesce(nullif('?' || array_to_string(list_sort(list_filter(
               string_split(regexp_extract(rest, '\\?(.*)$', 1), '&'),
               lambda x: x <> '' and not regexp_matches(x, '^({warc.TRACKING})='))), '&'), '?'), '') as url
    from (select *, lower(regexp_extract(plain, '{origin}')) as head, regexp_replace(plain, '{origin}', '') as rest
          from (select * exclude (url), regexp_replace(url, '#.*$', '') as plain from {url}))"""


OP9 = f"""
with visited as (
    select page_id * 2 + 1 as revisit_id, page_id * 10 + (page_id % 7 - 1) * 5000 + 5 as moment,
        case when page_id % 9 = 4 then '"other"' else 'W/"' || md5(coalesce(html, '')) || '"' end as etag,
        regexp_extract(url, '^([a-z]+://)', 1) || upper(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))
            || regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) || '#again' as url
    from pages
),
fetched as (
    select page_id * 2 as response_id, page_id * 10 as moment, md5(coalesce(html, '')) as body,
        cast(strlen(html) as varchar) as bytes, url
    from pages
),
visits as ({_canonical("visited")}),
responses as (
    select url, moment, max(response_id) as response_id, arg_max(body, (response_id, body)) as body,
        arg_max(bytes, (response_id, body)) as bytes
    from ({_canonical("fetched")}) where url is not null and moment is not null group by url, moment
),
matched as (
    select v.revisit_id, v.url, v.moment, v.etag, r.response_id, r.body, r.bytes,
        case when r.response_id is null then '{warc.NO_RESPONSE}'
            when regexp_replace(v.etag, '^W/', '') = '"' || r.body || '"' then '{warc.RESOLVED}'
            else '{warc.MISMATCH}' end as status
    from visits v asof left join responses r on v.url = r.url and v.moment > r.moment
)
select revisit_id, url, response_id, status,
    case when status = 'resolved' then body end as digest,
    case when status = 'resolved' then etag end as etag,
    case when status = 'resolved' then cast(moment as varchar) end as date,
    case when status = 'resolved' then 'text/html' end as content_type,
    case when status = 'resolved' then bytes end as content_length
from matched
"""

ORACLES = {"op5_quality_rules": OP5, "op9_warc_revisits": OP9}
