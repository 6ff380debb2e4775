"""DuckDB counterparts of the training-data queries that SQL can express."""

from __future__ import annotations

from keystride.llm.license_join import PHRASES, TEMPLATES, THRESHOLD
from keystride.llm.projection_dedup import THRESHOLD as COSINE

_LOWERED = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# -- op2 ----------------------------------------------------------------------------------------

def _entropy(t: str) -> str:
    p = f"[pow(x, {t}) for x in l]"
    return f"(ln(list_sum({p})) - list_sum([x * ln(x) for x in {p}]) / list_sum({p}))"


def _repeats(t: str) -> str:
    return f"(list_max([pow(x, {t}) / x for x in l]) / list_sum([pow(x, {t}) for x in l]))"


def mixing(entropy: float, repetition: float, blocks: int) -> str:
    """Both bisections as recursion; budget is the corpus."""
    return f"""
with recursive d as (
  select doc_id, source, case when source is null then 'n' else 's' || source end as k,
    coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0) as n_tokens, coalesce(md5(text), '') as salt
  from documents),
src as (select k, sum(n_tokens)::bigint as tokens from d group by k),
tot as (select coalesce(sum(tokens), 0)::bigint as b from src),
shares as (select k, tokens, tokens / greatest(b, 1)::double as share from src, tot),
s as (select list(share order by k) as l, count(*) as n from shares where share > 0),
e(lo, hi, i) as (
  select 0.0::double, 1.0::double, 0
  union all
  select case when h >= goal then mid else lo end, case when h >= goal then hi else mid end, i + 1
  from (select lo, hi, i, mid, {_entropy('mid')} as h, {entropy} * ln(n) - 1e-9 as goal
        from (select lo, hi, i, (lo + hi) / 2 as mid from e where i < 50), s)),
t1 as (select case when n < 2 or {_entropy('1.0')} >= {entropy} * ln(n) - 1e-9 then 1.0::double else lo end as t
       from e, s where i = 50),
r(lo, hi, i) as (
  select t, 1.0::double, 0 from t1
  union all
  select case when m <= {repetition} + 1e-9 then lo else mid end, case when m <= {repetition} + 1e-9 then mid else hi end, i + 1
  from (select lo, hi, i, mid, {_repeats('mid')} as m
        from (select lo, hi, i, (lo + hi) / 2 as mid from r where i < 50), s)),
tau as (select round(case when n < 2 or {_repeats('t')} <= {repetition} + 1e-9 then t else hi end, 6) as t
        from r, s, t1 where i = 50),
p as (select k, tokens, case when share > 0 then pow(share, t) else 0.0 end as p from shares, tau),
n as (select k, tokens, p / (select sum(p) from p) as w from p),
w as (select k, tokens, case when w > 0 then round(round(w / pow(10, floor(log10(w))), 11) * pow(10, floor(log10(w))) * b::double)::bigint
        else 0 end as goal from n, tot),
g as (select k, tokens, goal, case when tokens > 0 then goal // tokens else 1 end as passes,
        case when tokens > 0 then goal % tokens else 0 end as rest from w),
reads as (
  select doc_id, source, k, n_tokens, tokens, goal, passes, rest, salt,
    unnest(range(0, passes + case when rest > 0 then 1 else 0 end)) as pass
  from d join g using (k)),
keyed as (select *, md5('mix:' || pass || ':' || coalesce(doc_id::varchar, '') || ':' || salt) as order_key from reads),
placed as (
  select *, (sum(n_tokens) over (partition by k, pass order by order_key range between unbounded preceding and current row)
    - sum(n_tokens) over (partition by k, pass, order_key))::bigint as before
  from keyed)
select doc_id, source, pass::bigint as pass,
  (case when goal > 0 then least({blocks} * (pass * tokens + before) // goal, {blocks - 1}) else 0 end)::bigint as block,
  (pass * tokens + before)::bigint as source_offset, order_key, n_tokens::bigint as n_tokens
from placed where pass < passes or before < rest
"""


# -- op4 ----------------------------------------------------------------------------------------

def url_filter(rules, domains) -> str:
    rule_rows = ", ".join(f"({_quoted(v)}, {_quoted(h)}, {_quoted(p)})" for v, h, p in rules)
    domain_rows = ", ".join(f"({_quoted(d)})" for d in domains)
    return f"""
with rules(v, h, p) as (values {rule_rows}), listed(d) as (values {domain_rows}),
parts as (
  select page_id,
    coalesce({_LOWERED.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path, row_number() over () as n
  from pages),
fits as (
  select n, v, h || p as rule, row_number() over (partition by n order by length(h || p) desc, h || p, v desc) as rn
  from parts join rules on (host = h or host like '%.' || h) and starts_with(path, p)),
dom as (
  select n, d, row_number() over (partition by n order by length(d) desc, d) as rn
  from parts join listed on host = d or host like '%.' || d)
select page_id, host, path, rule, coalesce(v, case when d is not null then 'block' else 'allow' end) as verdict, d as domain
from parts left join (select * from fits where rn = 1) using (n) left join (select * from dom where rn = 1) using (n)
"""


# -- op5 ----------------------------------------------------------------------------------------

def license_join() -> str:
    templates = ", ".join(f"({_quoted(t)}, {_quoted(label)})" for t, label in TEMPLATES)
    places = " || ".join(
        "[i - 1 for i in range(1, len(w) + 1) if "
        + " and ".join(f"w[i + {k}] = {_quoted(word)}" for k, word in enumerate(phrase.split(" "))) + "]"
        for phrase, _ in PHRASES)
    labels = ", ".join(
        "case when len([i for i in range(1, len(w) + 1) if "
        + " and ".join(f"w[i + {k}] = {_quoted(word)}" for k, word in enumerate(phrase.split(" "))) + f"]) > 0 then {_quoted(label)} end"
        for phrase, label in PHRASES)
    return f"""
with t(text, label) as (values {templates}),
tt as (select label, list_distinct(tw) as tw, len(tw) + len(tw) // 2 as width
  from (select label, regexp_extract_all({_LOWERED.format('text')}, '{_WORD}') as tw from t)),
vocabulary as (select list(distinct word) as v from (select unnest(tw) as word from tt)),
d as (select row_number() over () as n, doc_id, text,
        coalesce(regexp_extract_all({_LOWERED.format('text')}, '{_WORD}'), []) as w from documents),
starts as (select n, w, unnest([i for i in range(1, len(w) + 1) if list_contains(v, w[i])]) as s from d, vocabulary),
blocks as (select n, s, label, width, len(tw) as size, list_intersect(list_distinct(w[s:s + width - 1]), tw) as m
  from starts, tt where list_contains(tw, w[s])),
hits as (select n, s, label, width, size, m, len(m) / size as c from blocks where len(m) >= greatest(ceil(size * {THRESHOLD} - 1e-9), 1)),
found as (select n, list(distinct label) as more, max(c) as most from hits a
  where not exists (select 1 from hits b where b.n = a.n and abs(b.s - a.s) < a.width and (b.c > a.c or (b.c = a.c and b.size > a.size))
    and len(list_intersect(a.m, b.m)) = len(a.m)) group by n),
p as (select n, doc_id, len(w) as n_words, {places} as starts, list_distinct([x for x in [{labels}] if x is not null]) as base from d)
select doc_id, n_words::bigint as n_words, len(starts)::bigint as n_base, list_min(starts)::bigint as first_word,
  list_max(starts)::bigint as last_word, array_to_string(list_sort(base), ',') as base_labels,
  array_to_string(list_sort(list_distinct(base || coalesce(more, []))), ',') as labels,
  case when len(starts) > 0 then 1.0::double else coalesce(most, 0)::double end as score
from p left join found using (n)
"""


# -- op6 ----------------------------------------------------------------------------------------

def projection_dedup() -> str:
    """All pairs of a label, and what links reach."""
    return f"""
with recursive v as (select row_number() over () as n, vec_id, label, embedding::double[] as e from embeddings),
usable as (select n, label, [coalesce(x, 0.0) for x in e] as e from v where len(e) > 0
  and len([x for x in e if x is null or not isfinite(x)]) = 0 and len([x for x in e if x <> 0]) > 0),
links as (select a.n, b.n as m from usable a join usable b on a.label = b.label and a.n <> b.n
  where case when len(a.e) = len(b.e) then list_cosine_similarity(a.e, b.e) end >= {COSINE}),
reach(n, m) as (select n, n from v union select reach.n, links.m from reach join links on links.n = reach.m),
class as (select reach.n, min(v.vec_id) as component_id from reach join v on v.n = reach.m group by reach.n),
counted as (select n, count(*) as n_links from links group by n)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, coalesce(vec_id = component_id, component_id is null) as kept
from v join class using (n) left join counted using (n)
"""


# -- op12 ---------------------------------------------------------------------------------------

def exact_dedup() -> str:
    return r"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
  row_number() over (partition by t order by doc_id nulls last) = 1 as kept, sha256(t) as text_sha256
from d
"""


# -- op13 ---------------------------------------------------------------------------------------

def _crc32(number: str) -> str:
    """CRC-32 of a number's decimal text, bit by bit."""
    bits = f"flatten([[ascii(ch)::bigint, -1, -1, -1, -1, -1, -1, -1] for ch in string_split({number}::varchar, '')])"
    step = "xor(x, greatest(e, 0))"
    return (f"(4294967295 - list_reduce(list_prepend(4294967295::bigint, {bits}), "
            f"lambda x, e: xor({step} >> 1, 3988292384 * ({step} & 1))))")


def prefix_trie() -> str:
    return rf"""
with turns as (
  select conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as dg,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as words
  from conversations where conv_id is not null),
placed as (
  select conv_id, dg, words, row_number() over (partition by conv_id order by turn nulls first,
    substr(dg, 1, 1) >= '8' desc, substr(dg, 1, 16), substr(dg, 17, 1) >= '8' desc, substr(dg, 17, 16)) as pos from turns),
sizes as (select conv_id, max(pos) as n from placed group by conv_id),
convs as (
  select c.conv_id, c.conv_id - c.conv_id % 20 as lender, {_crc32('c.conv_id')} % 4 as h, coalesce(l.n, 0) as has
  from sizes c left join sizes l on l.conv_id = c.conv_id - c.conv_id % 20),
rebuilt as (
  select c.conv_id, p.pos, dg, words from convs c join placed p on p.conv_id = c.lender and p.pos <= least(h, has)
  union all
  select c.conv_id, p.pos - h + least(h, has), dg, words from convs c join placed p on p.conv_id = c.conv_id and p.pos > h),
seqs as (
  select conv_id, coalesce(list(dg order by pos) filter (where dg is not null), []) as s,
    coalesce(list(words order by pos) filter (where dg is not null), []) as w
  from convs left join rebuilt using (conv_id) group by conv_id),
deep as (select conv_id, s, w, unnest(range(0, len(s) + 1)) as depth from seqs),
members as (
  select conv_id, depth, sha256(array_to_string(s[1:depth], '')) as k, sha256(array_to_string(s[1:depth - 1], '')) as pk,
    case when depth > 0 then w[depth] else 0 end as words, len(s) = depth as is_end from deep),
nodes as (
  select depth, k, any_value(pk) as pk, min(conv_id) as conv_id, count(*) as n_convs, max(words) as words,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where is_end), '')) as ends_sha256
  from members group by depth, k),
kids as (select depth - 1 as depth, pk as k, count(*) as n_children from nodes where depth > 0 group by 1, 2),
full_nodes as (select n.*, coalesce(n_children, 0) as n_children from nodes n left join kids using (depth, k)),
sums as (
  select m.depth, m.k, sum(case when n.n_children = 0 then 1 else 0 end)::bigint as n_leaves,
    sum((n.n_convs - 1) * n.words)::bigint as saved_tokens
  from full_nodes n join members m on m.conv_id = n.conv_id and m.depth <= n.depth group by 1, 2)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
from full_nodes n join sums using (depth, k) left join nodes p on p.depth = n.depth - 1 and p.k = n.pk
"""


def build(entropy, repetition, blocks, rules, domains) -> dict[str, str]:
    return {
        "op2_mixing": mixing(entropy, repetition, blocks),
        "op4_url_filter": url_filter(rules, domains),
        "op5_license_join": license_join(),
        "op6_projection_dedup": projection_dedup(),
        "op12_exact_dedup": exact_dedup(),
        "op13_prefix_trie": prefix_trie(),
    }
