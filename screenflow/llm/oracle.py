"""DuckDB SQL for the queries that SQL can express.

Length buckets (a dynamic programme), suffix arrays over bytes, block rules,
randomness tests and SimHash (no such hash in DuckDB) have none; they are tested
against brute force and fixtures.
"""

from __future__ import annotations

from screenflow.llm.mixing import LARGEST_MEAN, VALUES

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def window(size: int) -> str:
    """The words from a place on, joined by spaces."""
    return " || ' ' || ".join(["word", *(f"lead(word, {k}) over o" for k in range(1, size))])


TOP_K = """
with usable as (
    select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
    from embeddings
    where vec_id is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
    select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
    from usable q join usable c on q.vec_id <> c.vec_id and len(q.v) = len(c.v)
    where q.vec_id % 50 = 0),
ranked as (
    select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""


def fences(name: str, keys: str) -> str:
    """CTE ``keys, metric, docs, fence`` of the sketches merged to ``keys``."""
    group = f"{keys}, metric" if keys else "metric"
    at = lambda q: f"min(case when below * 100 >= docs * {q} then bucket end)"
    slack = "case metric when 'symbols' then 30 when 'capitals' then 100 when 'dup_lines' then 350 else 50 end"
    return f"""{name}_merged as (select {group}, bucket, sum(n) as n from sketch group by all),
{name}_ranked as (
    select *, sum(n) over (partition by {group} order by bucket) as below, sum(n) over (partition by {group}) as docs
    from {name}_merged),
{name}_found as (
    select {group}, docs, {at(10)} as l, {at(50)} as m, {at(90)} as h
    from {name}_ranked group by all),
{name} as (
    select {group}, docs, greatest({top('m')} + 6 * ({top('m')} - {top('l')}), {top('h')}) + {slack} as fence from {name}_found)"""


def top(b: str) -> str:
    """The largest value of a sketch bucket."""
    return f"(case when {b} < 32 then {b} else (({b} - 32) % 16 + 17) * (1 << cast(({b} - 32) // 16 + 1 as bigint)) - 1 end)"


def share(part: str, whole: str, times: int = 1000) -> str:
    return f"case when {whole} > 0 then {part} * {times} // {whole} else 0 end"


QUALITY = rf"""
with split as (
    select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as t, {WORDS} as w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
    from documents),
each as (select doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as word from split where len(w) > 0),
windows as (select doc_id, i, {window(5)} as s from each window o as (partition by doc_id order by i) qualify lead(word, 4) over o is not null),
twice as (select doc_id, i from (select *, count(*) over (partition by doc_id, s) as n from windows) where n > 1),
covered as (select doc_id, count(distinct i + k) as n from twice cross join range(5) r(k) group by doc_id),
base as (
    select s.doc_id, lang, source, len(w) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols, length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) as n_capitals,
        len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words
    from split s left join covered c on s.doc_id = c.doc_id),
metrics as (
    select doc_id, lang, source, 'symbols' as metric, {share('n_symbols', 'word_chars')} as v from base
    union all select doc_id, lang, source, 'capitals', {share('n_capitals', 'word_chars')} from base
    union all select doc_id, lang, source, 'dup_lines', {share('n_dup_lines', 'n_lines')} from base
    union all select doc_id, lang, source, 'word_length', {share('word_chars', 'n_words', 10)} from base),
bucketed as (
    select lang, source, metric,
        case when v < 32 then v else 32 + (length(bin(v)) - 6) * 16 + v // (1 << cast(length(bin(v)) - 5 as bigint)) - 16 end as bucket
    from metrics),
sketch as (select lang, source, metric, bucket, count(*) as n from bucketed group by all),
{fences('own', 'lang, source')},
{fences('language', 'lang')},
{fences('everything', '')},
limits as (
    select o.lang, o.source, o.metric,
        (o.fence * o.docs + (l.fence * l.docs + e.fence * 100) // (l.docs + 100) * 100) // (o.docs + 100) as fence
    from own o join language l on o.lang = l.lang and o.metric = l.metric join everything e on o.metric = e.metric),
broken as (
    select m.doc_id, bool_or(m.v > t.fence) as above
    from metrics m join limits t on m.lang = t.lang and m.source = t.source and m.metric = t.metric group by m.doc_id),
judged as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from base)
select j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not above as kept
from judged j join broken b on j.doc_id = b.doc_id
"""

HOST = r"regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '\.+$', '')"
SEGMENT = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1)"
URL_LISTS = f"""
with captures as (
    select page_id, url, cast(date '2024-01-01' + cast(page_id * 37 % 366 as int) as date) as fetched_on, {HOST} as host, {SEGMENT} as segment from pages),
named as (
    select 'hosts' as list, host as key, 4 as every from captures where host <> ''
    union select 'domains', array_to_string(string_split(host, '.')[-2:], '.'), 3 from captures where host <> ''
    union select 'paths', concat_ws('/', host, segment), 5 from captures where host <> ''),
hashed as (select list, key, every, cast('0x' || substr(md5(concat_ws(':', list, key)), 1, 7) as bigint) as h from named),
listed as (select *, cast(floor(h / 8 % 200) as int) as first, cast(floor(h / 1600 % 90 + 1) as int) as off from hashed where h % every = 0),
entries as (
    select key, list, date '2024-01-01' + first as dated, 1 as added from listed
    union all select key, list, date '2024-01-01' + (first + off), 0 from listed
    union all select key, list, date '2024-01-01' + (first + off + 30), case when h % 2 = 0 then 1 else 0 end from listed),
daily as (select key, list, dated, max(added) as added from entries group by all),
spans as (select *, lead(dated) over (partition by key, list order by dated) as until from daily),
labels_of as (select page_id, string_split(host, '.') as parts from captures where host <> ''),
asked as (
    select page_id, unnest(list_transform(range(1, greatest(len(parts), 2)), lambda i: array_to_string(parts[i:], '.'))) as key from labels_of
    union select page_id, concat_ws('/', host, segment) from captures where host <> '' and segment <> ''),
hits as (
    select c.page_id, array_to_string(list_sort(list(distinct s.list)), ',') as lists
    from captures c join asked a on c.page_id = a.page_id join spans s on a.key = s.key
    where s.added = 1 and s.dated <= c.fetched_on and (s.until is null or c.fetched_on < s.until) group by c.page_id)
select c.page_id, c.url, c.fetched_on, coalesce(h.lists, '') as lists, h.lists is not null as blocked
from captures c left join hits h on c.page_id = h.page_id
"""

MIXING = f"""
with sizes as (select coalesce(source, '') as src, cast(sum(coalesce(length(text), 0) + 1) as double) as size from documents group by 1),
rates as (select src, sqrt(size) * ((select sum(size) from sizes) / (select sum(sqrt(size)) from sizes)) / size as rate from sizes),
means as (select src, greatest(cast(ceil(rate / {LARGEST_MEAN}) as int), 1) as parts, rate from rates),
terms as (
    select src, parts, k, exp(-rate / parts + k * ln(rate / parts) - lgamma(k + 1)) as p from means cross join range({VALUES + 1}) r(k)),
summed as (select src, parts, k, sum(p) over (partition by src order by k) as p from terms),
cumulative as (select src, parts, list(p order by k) as sums from summed group by src, parts),
draws as (
    select d.doc_id, d.source, d.text, c.sums, unnest(range(1, c.parts + 1)) as part
    from documents d join cumulative c on coalesce(d.source, '') = c.src),
drawn as (
    select doc_id, any_value(source) as source, any_value(text) as text,
        sum(len(list_filter(sums, lambda p: p <= cast('0x' || substr(md5(concat_ws(':', coalesce(cast(doc_id as varchar), ''), '1', part)), 1, 13) as bigint)
            / 4503599627370496.0))) as times
    from draws group by doc_id),
copies as (select doc_id, source, text, unnest(range(1, cast(times as bigint) + 1)) as copy from drawn)
select doc_id, source, cast(copy as int) as copy, md5(concat_ws(':', coalesce(cast(doc_id as varchar), ''), '1', 'copy', copy)) as order_key, text
from copies
"""

NEAR_DEDUP = r"""
with words as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
    from documents),
shingles as (
    select distinct doc_id, unnest(case when len(w) = 1 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as s
    from words where len(w) > 0),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (
    select a.doc_id as a, b.doc_id as b, count(*) as n from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (
    select a, b from common c join sizes x on c.a = x.doc_id join sizes y on c.b = y.doc_id where 100 * c.n >= 80 * (x.n + y.n - c.n)),
reached as (
    with recursive r(a, b) as (
        select doc_id, doc_id from words union select r.a, l.b from r join links l on r.b = l.a)
    select a, min(b) as least from r group by a)
select w.doc_id, coalesce(s.n, 0) as n_shingles, r.least as component_id, w.doc_id = r.least as kept
from words w join reached r on w.doc_id = r.a left join sizes s on w.doc_id = s.doc_id
"""

PASSAGES = f"""
with split as (select doc_id, {WORDS} as w from documents),
each as (select doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as word from split where len(w) > 0),
windows as (select doc_id, i, {window(13)} as s from each window o as (partition by doc_id order by i) qualify lead(word, 12) over o is not null),
first as (select s, min(doc_id) as holder from windows group by s having count(distinct doc_id) > 1),
gone as (
    select distinct w.doc_id, w.i + k as at from windows w join first f on w.s = f.s and f.holder < w.doc_id cross join range(13) r(k)),
kept as (
    select e.doc_id, count(*) as n, string_agg(word, ' ' order by e.i) as text
    from each e left join gone g on e.doc_id = g.doc_id and e.i = g.at where g.at is null group by e.doc_id)
select s.doc_id, len(w) as n_words, len(w) - coalesce(k.n, 0) as n_removed, sha256(coalesce(k.text, '')) as kept_sha256
from split s left join kept k on s.doc_id = k.doc_id
"""


def clustering(rounds: int = 3) -> str:
    """CTEs ``c0`` .. of the centroids and ``a0`` .. of each vector's nearest one."""
    steps = [
        """kept as materialized (
    select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v
    from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64)""",
        """c0 as materialized (
    select row_number() over (order by sha256('1:' || cast(vec_id as varchar)), v) - 1 as c, v as w from kept qualify c < 16)""",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} as materialized (
    select r, vec_id, v, min(struct_pack(d := d, c := c)) as near
    from (select r, vec_id, v, c, cast(list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as bigint) as d from kept, c{i})
    group by r, vec_id, v)""")
        if i < rounds:
            steps.append(f"""c{i + 1} as materialized (
    select o.c, coalesce(m.w, o.w) as w
    from c{i} o left join (
        select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as w
        from (select near.c as c, i, cast(sum(v[i]) as bigint) as s, count(*) as n from a{i}, range(1, 65) g(i) group by all) group by c) m on o.c = m.c)""")
    return "with " + ",\n".join(steps)


CLUSTERS = f"""
{clustering()}
select vec_id, cast(near.c as int) as cluster, near.d as distance,
    cast(sum(near.d) over (partition by near.c) as bigint) as cluster_inertia, cast(sum(near.d) over () as bigint) as inertia,
    sha256(array_to_string(w, ',')) as centroid_sha256
from a3 join c3 on near.c = c3.c
"""

#: CRC-32 of a word: the reflected polynomial 0xEDB88320, a table of 256 entries, then byte by byte.
IMPORTANCE = r"""
with steps as (
    select list(list_reduce(range(8), lambda a, k: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, b) order by b) as t from range(256) r(b)),
texts as (
    select 'd' as side, doc_id, text from documents union all select 'b', null, text from benchmark),
split as (
    select side, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from texts),
counts as (select side, doc_id, word, count(*) as n from (select side, doc_id, unnest(w) as word from split) group by all),
bytes as (
    select word, list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda x: cast('0x' || x as bigint)) as b
    from (select distinct word from counts)),
hashed as (
    select word, xor(list_reduce(b, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295::bigint), 4294967295) % 10000 as bucket
    from bytes, steps),
filled as (
    select bucket, coalesce(sum(n) filter (side = 'd'), 0) as s, coalesce(sum(n) filter (side = 'b'), 0) as t
    from counts join hashed using (word) group by bucket),
size as (select sum(s) as s, sum(t) as t from filled),
gains as (
    select bucket, cast(floor(1000 * ln(cast((f.t + 1) * (size.s + 10000) as double) / cast((f.s + 1) * (size.t + 10000) as double))) as bigint) as gain
    from filled f, size),
weights as (
    select doc_id, cast(sum(n * gain) as bigint) as weight from counts join hashed using (word) join gains using (bucket) where side = 'd' group by doc_id),
scored as (
    select s.doc_id, cast(len(w) as bigint) as n_features, coalesce(weight, 0) as weight,
        coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || cast(s.doc_id as varchar)), 1, 8) as bigint) + 0.5::double) / 4294967296))) as bigint) as score
    from split s left join weights on s.doc_id = weights.doc_id where side = 'd'),
ranked as (
    select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as place, count(*) over (partition by n_features >= 20) as n from scored)
select doc_id, n_features, weight, score, case when n_features >= 20 and place <= 10 * n // 100 then place end as rank
from ranked
"""

ORACLE = {
    "op1_bit_sliced_top_k": TOP_K,
    "op2_quality_rules": QUALITY,
    "op3_url_list_join": URL_LISTS,
    "op6_poisson_mixing": MIXING,
    "op9_minmax_near_dedup": NEAR_DEDUP,
    "op10_phrase_automata": PASSAGES,
    "op12_simplex_clusters": CLUSTERS,
    "op13_importance_resampling": IMPORTANCE,
}
