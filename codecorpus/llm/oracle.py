"""Answers in SQL for the operators' queries, where SQL can express them."""

from html.entities import html5

OP5 = r"""
with d as (
    select row_number() over () as r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from documents
), i as (
    select cast(item_id as varchar) as item,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from benchmark where item_id is not null
), windows as (
    select distinct item, least(len(w), 13) as n, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') as words
    from i, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as t(s) where len(w) > 0
), sizes as (select distinct n from windows
), places as (
    select r, s, n, array_to_string(w[s:s + n - 1], ' ') as words
    from d, sizes, unnest(range(1, len(w) - n + 2)) as t(s)
), hits as (select r, s, n, item from places join windows using (n, words)
), hit_words as (select r, count(distinct p) as n_hit from hits, unnest(range(s, s + n)) as t(p) group by r
), hit_items as (
    select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from hits group by r
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit_words using (r) left join hit_items using (r)
"""



def _digest(text: str) -> str:
    """sha1 in base 32: five bits of every ten hexadecimal digits in turn."""
    digit = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((cast('0x' || substr(sha1({0}), 1 + 10 * g, 10) as bigint) >> (35 - 5 * i)) & 31) + 1, 1)"
    group = f"array_to_string(list_transform(range(0, 8), lambda i: {digit.format(text)}), '')"
    return f"'sha1:' || array_to_string(list_transform(range(0, 4), lambda g: {group}), '')"


def _record_id(kind: str, *parts: str) -> str:
    digits = f"md5(concat_ws(chr(10), '{kind}', {', '.join(parts)}))"
    groups = [f"substr({digits}, {a}, {n})" for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    return f"concat('<urn:uuid:', {groups[0]}, '-', {groups[1]}, '-3', {groups[2]}, '-8', {groups[3]}, '-', {groups[4]}, '>')"


_TAGS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul"
_HIDDEN = "|".join(rf"<{x}[\s>].*?</{x}\s*>" for x in ("script", "style", "noscript", "template", "title"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# The names of HTML, from Python's table of them; those without a semicolon also begin a longer word.
_NAMES = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in html5.items())
_SHORT = "|".join(sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k)))
OP2 = rf"""
with names as (select * from (values {_NAMES}) as t(name, value)
), p as (select page_id, url, coalesce(html, '') as payload from pages
), d as (select *, {_digest("payload")} as source_digest from p
), r as (select *, {_record_id("response", "cast(page_id as varchar)", "url", "source_digest")} as refers_to from d
), c as (
    select *, {_record_id("conversion", "refers_to")} as conversion, {_record_id("metadata", "refers_to")} as metadata,
        regexp_replace(regexp_replace(regexp_replace(regexp_replace(
            regexp_replace(payload, '(?is)<!--.*?-->|{_HIDDEN}', ' ', 'g'), '(?is)<head[\s>].*?</head\s*>', ' ', 'g'),
            '[ \t\r\n\f]+', ' ', 'g'), '(?i)</?(?:{_TAGS})(?:\s[^>]*)?/?>', chr(10), 'g'), '<[a-zA-Z/!?][^>]*>', '', 'g') as raw
    from r
), numbered as (select row_number() over () as row, * from c
), parts as (
    select row, i, x, regexp_extract(x, '^#(?:[0-9]+|[xX][0-9a-fA-F]+);?') as digits, regexp_extract(x, '^[A-Za-z][A-Za-z0-9]*;') as long,
        regexp_extract(x, '^(?:{_SHORT})') as short
    from (select row, generate_subscripts(string_split(raw, '&'), 1) as i, unnest(string_split(raw, '&')) as x from numbered)
), decoded_parts as (
    select row, i, case when i = 1 then x
        when digits <> '' then chr(cast(if(lower(digits[2]) = 'x', '0' || rtrim(digits[2:], ';'), rtrim(digits[2:], ';')) as integer)) || substr(x, length(digits) + 1)
        when l.value is not null then l.value || substr(x, length(long) + 1)
        when s.value is not null then s.value || substr(x, length(short) + 1)
        else '&' || x end as text
    from parts left join names as l on l.name = long left join names as s on s.name = short
), joined as (select row, replace(string_agg(text, '' order by i), chr(160), ' ') as decoded from decoded_parts group by row
), t as (select * from numbered join joined using (row)
), m as (
    select page_id, 'conversion' as warc_type, conversion as warc_id, refers_to, url, source_digest, 'text/plain; charset=utf-8' as content_type,
        trim(regexp_replace(regexp_replace(decoded, ' *\n[ \n]*', chr(10), 'g'), ' +', ' ', 'g'), ' ' || chr(10)) as block
    from t
    union all
    select page_id, 'metadata', metadata, refers_to, url, source_digest, 'application/warc-fields',
        array_to_string(['http-status: 200', 'http-Content-Type: text/html; charset=utf-8', 'http-Content-Length: ' || strlen(payload),
            'payload-digest: ' || source_digest, 'payload-length: ' || strlen(payload),
            'title: ' || trim(regexp_extract(payload, '(?is)<title[^>]*>([^<]*)</title', 1)),
            'language: ' || trim(regexp_extract(payload, '(?i)<html[^>]*\slang="([^"]*)"', 1)),
            'links: ' || len(regexp_extract_all(payload, '(?i)<a\s[^>]*href=')), 'conversion: ' || conversion], chr(13) || chr(10)) || chr(13) || chr(10)
    from c
)
select page_id, warc_type, warc_id, refers_to, url as target_uri, '2024-01-01T00:00:00Z' as date, content_type,
       {_digest("block")} as block_digest, source_digest, strlen(block) as block_bytes, md5(block) as block_md5
from m
"""

OP12 = r"""
with d as (
    select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u,
           sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h
    from documents
), e as (
    select doc_id, t, u, cast(len(u) as bigint) as n, cast('0x' || substr(h, 1, 8) as bigint) % (len(u) + 1) as one,
           cast('0x' || substr(h, 9, 8) as bigint) % (len(u) + 1) as two, cast('0x' || substr(h, 17, 8) as bigint) % 100 as three,
           cast('0x' || substr(h, 25, 8) as bigint) % 100 as four
    from d
), f as (
    select doc_id, t, n, array_to_string(u[1:least(one, two)], '') as p, array_to_string(u[least(one, two) + 1:greatest(one, two)], '') as m,
           array_to_string(u[greatest(one, two) + 1:], '') as s,
           case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or three >= 100 then 'plain'
                when four < 50 then 'spm' else 'psm' end as form
    from e
)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then concat('<P>', p, '<S>', s, '<M>', m) else concat('<S>', s, '<P>', p, '<M>', m) end) as output_sha256,
       sha256(t) as restored_sha256
from f
"""

ORACLES: dict[str, str] = {
    "op2_warc_derivatives": OP2,
    "op5_benchmark_decontamination": OP5,
    "op12_fill_in_middle": OP12,
}
