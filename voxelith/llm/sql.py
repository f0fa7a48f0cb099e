"""DuckDB SQL that gives the rows of the queries that SQL can express.

op2, op4, op7 and op9 need a tokenizer or a trained model, op8 XXH64, and op10 Spark's hash of
several values; they are tested against brute force, as are op1, op5 and op6 too."""

OP1 = r"""
with base as (
  select doc_id, coalesce(text, '') as t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) as l
  from documents),
wins as (
  select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
  from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from base where len(w) > 2)),
reps as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as c from wins) where c > 1),
rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from reps) group by doc_id),
m as (
  select base.doc_id, t, w, cast(len(w) as bigint) as n_words,
    cast(length(regexp_replace(t, '[ \t-\r]', '', 'g')) as bigint) as word_chars,
    cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines,
    cast(coalesce(rep.n, 0) as bigint) as n_repeat_words
  from base left join rep on rep.doc_id = base.doc_id),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 10 * n_symbols > n_words
    or 3 * (length(t) - length(replace(t, '!', ''))) > n_words
    or not (word_chars between 2 * n_words and 20 * n_words)
    or 2 * (length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g'))) > length(t)
    or 5 * len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) > n_words
    or 2 * n_dup_lines > len(string_split(t, chr(10)))) as kept
from f
"""

OP3 = r"""
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
s as (select page_id, octet_length(b) as n, sha1(b) as h from p),
bits as (select page_id, n, h, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(strpos('0123456789abcdef', substr(h, i, 1)) - 1), 4, '0')), '') as b from s),
d as (select page_id, n, h, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  cast(1 + 16 * cast(substr(b, 5 * i + 1, 1) as int) + 8 * cast(substr(b, 5 * i + 2, 1) as int) + 4 * cast(substr(b, 5 * i + 3, 1) as int)
  + 2 * cast(substr(b, 5 * i + 4, 1) as int) + cast(substr(b, 5 * i + 5, 1) as int) as bigint), 1)), '') as digest from bits),
f as (select h, min(page_id) as first_id from d group by h)
select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id <> first_id then first_id end as refers_to
from d join f using (h)
"""

OP6 = r"""
with pages as (select doc_id, source, text, string_split(text, chr(10)) as l from documents),
total as (select source, count(*) as n from pages group by source),
each as (select doc_id, source, unnest(list_distinct(list_transform(l, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))))) as line from pages),
bad as (
  select each.source, line from each join total on total.source is not distinct from each.source where line <> ''
  group by each.source, line, total.n having count(*) >= 3 and count(*) > cast('0.08' as double) * total.n),
lists as (select source, list(line) as lines from bad group by source)
select doc_id, p.source, cast(coalesce(len(l), 0) as bigint) as n_lines,
  cast(coalesce(len(list_filter(l, lambda x: list_contains(lines, trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))))), 0) as bigint) as n_dropped,
  case when lines is null then text else array_to_string(list_filter(l, lambda x: not list_contains(lines, trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))), chr(10)) end as text
from pages p left join lists on lists.source is not distinct from p.source
"""

ORACLE_SQL: dict[str, str] = {"op1_quality_rules": OP1, "op3_warc": OP3, "op6_line_dedup": OP6}
