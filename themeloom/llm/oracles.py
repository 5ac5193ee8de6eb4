"""SQL for the queries that DuckDB can state."""

from __future__ import annotations

from themeloom.llm.chat import END, SPLIT, START
from themeloom.llm.licenses import INNER_MARKS, RULES, SENTENCES

ORACLES: dict[str, str] = {}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_COMPONENT = """
    reach as (
        select doc_id, doc_id as root from {nodes}
        union
        select l.b, r.root from reach r join links l on l.a = r.doc_id
    )"""

ORACLES["op5_ngram_jaccard_join"] = f"""
with recursive words as (
    select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') as w from documents
), grams as (
    select distinct doc_id, unnest(case
        when len(w) = 0 then []
        when len(w) < 3 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as g
    from words
), sizes as (
    select doc_id, count(*) as n from grams group by 1
), pairs as (
    select x.doc_id as a, y.doc_id as b, count(*) as c
    from grams x join grams y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2
), links as (
    select a, b from pairs join sizes s on s.doc_id = a join sizes t on t.doc_id = b
    where 100 * c >= 90 * (s.n + t.n - c)
), {_COMPONENT.format(nodes="words")}
select r.doc_id, coalesce(any_value(s.n), 0) as n_shingles, min(r.root) as component_id
from reach r left join sizes s on s.doc_id = r.doc_id group by 1
"""

ORACLES["op6_mixing"] = f"""
with sized as (
    select doc_id, source, len({_WORDS}) as size,
        (('0x' || substr(md5('mix/' || doc_id), 1, 13))::bigint::double + 0.5::double) / 4503599627370496::double as u
    from documents
), sources as (
    select source, sum(size)::bigint as s, [5, 2, 1][((row_number() over (order by source nulls last)) - 1) % 3 + 1] as w
    from sized group by source
), stops as (
    select *, sum(2 * s) over o as given, sum(w) over o as gone, lead(2 * s / w) over (order by 2 * s / w, source) as following
    from sources window o as (order by 2 * s / w, source rows unbounded preceding)
), budget as (
    select sum(s)::double * 150 / 100 as b, sum(w) as shares from sources
), choice as (
    select given, gone, b, shares from (
        select 0 as given, 0 as gone, (select min(2 * s / w) from sources) as following
        union all select given, gone, following from stops
    ), budget
    where shares > gone and (b - given) / (shares - gone) <= following
    order by given limit 1
), targets as (
    select source, s, case when (b - given) * w / (shares - gone) > 2 * s then (2 * s)::double
        else (b - given::double) * w / (shares - gone)::double end as target
    from sources, choice
), counted as (
    select source, size, count(*) as n, any_value(s) as s, any_value(target) as target
    from (select z.source, size, s, target from sized z join targets t on z.source is not distinct from t.source where size > 0) group by 1, 2
), tried as (
    select *, (target - 2 * coalesce(sum(size * n) over (partition by source order by size desc rows between unbounded preceding and 1 preceding), 0))
        / sum(size * n * sqrt(size)) over (partition by source order by size desc rows between current row and unbounded following) as factor
    from counted
), factors as (
    select source, max_by(factor, size) as factor from tried where factor * sqrt(size) <= 2 * (1 + 1e-9) group by 1
), expected as (
    select c.source, size, case when f.factor * sqrt(size) >= 2 * (1 - 1e-9) then 2e0 else f.factor * sqrt(size) end as copies
    from counted c join factors f on c.source is not distinct from f.source
), ranked as (
    select z.*, t.s, t.target, coalesce(floor(e.copies), 0) as whole, coalesce(e.copies - floor(e.copies), 0) as rest,
        sum(z.size * coalesce(floor(e.copies), 0)) over (partition by z.source) as certain
    from sized z join targets t on z.source is not distinct from t.source
    left join expected e on e.source is not distinct from z.source and e.size = z.size
), ordered as (
    select *, u * (1 - rest) / (u * (1 - rest) + (1 - u) * rest) as rank from ranked
), summed as (
    select *, coalesce(sum(case when size > 0 and rest > 0 then size else 0 end) over (
        partition by source order by rank, doc_id rows between unbounded preceding and 1 preceding), 0) as before
    from ordered
)
select doc_id, size, s as source_size, target,
    (size * (whole + case when rest > 0 and before + size / 2 <= target - certain then 1 else 0 end))::bigint as taken
from summed
"""

ORACLES["op9_quality_rules"] = f"""
with docs as (
    select row_number() over () as rid, doc_id, source, coalesce(text, '') as text, {_WORDS} as w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines
    from documents
), places as (
    select rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
    from (select rid, w, unnest(range(1, len(w) - 1)) as i from docs)
), twice as (
    select rid, i from places qualify count(*) over (partition by rid, g) >= 2
), repeats as (
    select rid, count(distinct i + k) as n from twice, (select unnest([0, 1, 2]) as k) group by 1
), lines as (
    select rid, source, text, len(p) as n,
        translate({_LOWER.format("array_to_string(p, ' ')")}, '123456789', '000000000') as line
    from (
        select rid, source, text, regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+') as p
        from (select rid, source, text, unnest(lines) as l from docs)
    )
), often as (
    select source, line from lines group by 1, 2
    having count(distinct text) > 100 or count(distinct text) > 10 and 100 * count(distinct text) > (
        select count(distinct d.text) from docs d where d.source is not distinct from lines.source)
), cut as (
    select rid, sum(n) as n from lines l join often o on o.line = l.line and o.source is not distinct from l.source group by 1
), figures as (
    select d.rid, doc_id, len(w)::bigint as n_words,
        coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
        (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
        coalesce(r.n, 0) as n_repeat_words, len(w) - coalesce(c.n, 0) as left_words
    from docs d left join repeats r on r.rid = d.rid left join cut c on c.rid = d.rid
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and left_words >= 20 and 100 * left_words >= 20 * n_words as kept
from figures
"""

ORACLES["op3_near_vectors"] = f"""
with recursive vectors as (
    select vec_id as doc_id, label, embedding::double[] as e,
        label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
            and len(list_filter(embedding, lambda x: x <> 0)) > 0 as sound
    from embeddings
), links as (
    select x.doc_id as a, y.doc_id as b from vectors x join vectors y
    on x.label = y.label and x.doc_id <> y.doc_id and x.sound and y.sound
    where list_cosine_similarity(x.e, y.e) >= 0.93
), {_COMPONENT.format(nodes="vectors")}, numbers as (
    select a, count(*) as n from links group by 1
)
select r.doc_id as vec_id, coalesce(any_value(n), 0) as n_links, min(root) as component_id, min(root) = r.doc_id as kept
from reach r left join numbers on a = r.doc_id group by r.doc_id
"""


def _license_sql() -> str:
    """The same fixed sentences and rules, with SQL's own functions."""
    quoted = lambda value: "'" + value.replace("'", "''") + "'"
    names = " ".join(f"when regexp_full_match(s, {quoted(pattern)}) then '{name}'" for name, pattern in SENTENCES)
    steps, found, left = [], [], "' ' || array_to_string(ids, '  ') || ' '"
    for k, (name, needed) in enumerate(RULES):
        part = "' " + "  ".join(needed) + " '"
        steps.append(f"r{k} as (select *, {left} as left{k}, {left} like '%' || {part} || '%' as hit{k} from {f'r{k - 1}' if k else 'named'})")
        found.append(f"case when hit{k} then '{name}' end")
        left = f"replace(left{k}, {part}, '  ')"
    text = "coalesce(text, '')"
    for mark in INNER_MARKS:
        text = f"regexp_replace({text}, {quoted(mark)}, '\\1\\2', 'g')"
    return f"""
with cut as (
    select doc_id, regexp_split_to_array(regexp_replace({text}, '([.!?;:])[ \\t\\r]+', '\\1\n', 'g'), '\\n+') as said
    from documents
), plain as (
    select doc_id, list_transform(said, lambda s:
        regexp_replace(regexp_replace(lower(s), '[^a-z0-9.+-]+', ' ', 'g'), '^[ .-]+|[ .-]+$', '', 'g')) as said from cut
), named as (
    select doc_id, list_filter(list_transform(said, lambda s: case {names} end), lambda x: x is not null) as ids from plain
), {", ".join(steps)}, ended as (
    select doc_id, ids, list_filter([{", ".join(found)}], lambda x: x is not null) as every, {left} as rest from r{len(RULES) - 1}
), distincts as (
    select *, list_filter(every, lambda x, i: list_position(every, x) = i) as licenses from ended
)
select doc_id, array_to_string(ids, ' ') as sentences, array_to_string(licenses, ' ') as licenses,
    trim(regexp_replace(rest, ' +', ' ', 'g')) as unmatched,
    case when len(licenses) > 1 then 'several' when len(licenses) = 1 then 'known' when len(ids) > 0 then 'partial' else 'none' end as verdict
from distincts
"""


ORACLES["op7_license_scan"] = _license_sql()

_ESCAPED = "length({0}) + length({0}) - length(replace({0}, chr(92), ''))" + "".join(
    f" + (length({{0}}) - length(replace({{0}}, '{c}', ''))) // {len(c)}" for c in (START, SPLIT, END)
)
ORACLES["op8_chat_format"] = f"""
with turns as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', chr(92) || '### Assistant: </turn> ok'
    union all select -7, 1, 'assistant', chr(92) || '### Assistant: </turn> ok'
)
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, md5(text))) as turns_sha256,
    coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn nulls first, role, md5(text)) filter (role = 'assistant'), '')) as loss_sha256,
    sum({len(START) + len(SPLIT) + len(END)} + {_ESCAPED.format("role")} + {_ESCAPED.format("text")})::bigint as formatted_chars
from turns group by conv_id
"""

# Windows are compared as texts of 13 words: a word holds no space.
ORACLES["op11_repeated_passages"] = f"""
with words as (
    select doc_id, {_WORDS} as w from documents
), windows as (
    select doc_id, i, array_to_string(w[i:i + 12], ' ') as g from words, unnest(range(1, len(w) - 11)) as r(i)
), firsts as (
    select g, min(doc_id) as first from windows group by g
), gone as (
    select distinct doc_id, unnest(range(i, i + 13)) as place from windows join firsts using (g) where doc_id > first
), places as (
    select doc_id, list(place) as gone from gone group by doc_id
)
select doc_id, len(w) as n_words, coalesce(len(gone), 0) as n_removed,
    sha256(coalesce(array_to_string(list_transform(
        list_filter(range(1, len(w) + 1), lambda k: not list_contains(coalesce(gone, []), k)), lambda k: w[k]), ' '), '')) as kept_sha256
from words left join places using (doc_id)
"""

ORACLES["op12_source_divergence"] = f"""
with docs as (
    select coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(
        {_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w,
        row_number() over () as rid from documents
), tokens as (
    select lang, source, rid, unnest(w) as term from docs
), kept as (
    select lang, term, count(*)::hugeint as total from tokens group by 1, 2 having count(distinct rid) >= 3
), langs as (
    select lang, count(*) as v, sum(total)::hugeint as n from kept group by 1
), found as (
    select lang, source, term, count(*)::hugeint as c from tokens semi join kept using (lang, term) group by 1, 2, 3
), sums as (
    select lang, source, sum(c)::hugeint as n from found group by 1, 2
), sources as (
    select distinct lang, source from docs
), shares as (
    select lang, s.source, k.term, coalesce(f.c, 0) as c,
        1 + (1000000000 * (coalesce(f.c, 0) + 1)) // (coalesce(u.n, 0) + l.v) as p
    from sources s join kept k using (lang) join langs l using (lang)
    left join found f on f.lang = s.lang and f.source = s.source and f.term = k.term
    left join sums u on u.lang = s.lang and u.source = s.source
), base as (
    select lang, term, 1 + (1000000000 * (total + 1)) // (n + v) as q from kept join langs using (lang)
), pairs as (
    select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
    from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3
), parts as (
    select s.lang, s.source, 'pair' as part, t.source as item, coalesce(p.value, 0) as value
    from sources s join sources t on s.lang = t.lang and s.source <> t.source
    left join pairs p on p.lang = s.lang and p.source = s.source and p.item = t.source
    union all
    select lang, source, 'term', term, ((p - q) * (p - q)) // q from shares join base using (lang, term) where c > 0 and p > q
), ranked as (
    select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from parts
)
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= 200
"""

ORACLES["op13_filter_audit"] = f"""
with judged as (
    select d.doc_id, coalesce(source, '') as part, coalesce(text, '') as t, {_WORDS} as w,
        coalesce(l.good, 0) as good, coalesce(l.toxic, 0) as toxic
    from documents d left join (
        select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by 1) l using (doc_id)
), failed as (
    select part, good, toxic, [
        len(w) < 50,
        100 * len(list_distinct(w)) < 65 * len(w),
        100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
        regexp_matches(t, '[#$%&*|]'),
        coalesce(doc_id > min(doc_id) over (partition by t), false)] as f
    from judged
), cases as (
    select part, f, count(*) as n, sum(good) as good, sum(toxic) as toxic from failed group by part, f
), letters as (
    select unnest([1, 2, 3, 4, 5]) as i
), orders as (
    select [a.i, b.i, c.i, d.i, e.i] as o from letters a, letters b, letters c, letters d, letters e
    where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), steps as (
    select array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') as filter_order, s.i as step, o[s.i] as i, o[1:s.i - 1] as before
    from orders, letters s
), told as (
    select part, filter_order, step, i, n, good, toxic, f[i] as fails, len(list_filter(before, lambda k: f[k])) > 0 as gone,
        len(list_filter(f, lambda x: x)) = 1 as alone
    from cases, steps
), audited as (
    select part, filter_order, step, i,
        sum(n) filter (not gone and not fails) as kept, sum(n) filter (fails and not gone) as removed,
        sum(n) filter (fails and gone) as redundant, sum(n) filter (fails and alone) as unique_fails,
        sum(good) filter (fails and not gone) as good_lost, sum(toxic) filter (fails and not gone) as toxic_lost
    from told group by 1, 2, 3, 4
)
select part, filter_order, step::int as step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed,
    coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails,
    coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
    sum(coalesce(removed, 0)) over (partition by part, i)::bigint as shapley
from audited
"""
