"""The same results in plain SQL for DuckDB, written without the library's operators."""

from __future__ import annotations

from screenflow.lexicon import MENTAL_HEALTH, TAG_WORDS
from screenflow.spec import CLASSIFY, SCREEN, StageSpec
from workloads import models as m
from workloads import views as v

BROAD, STRICT, PROB = "is_mental_health_broad", "is_mental_health", "prob_true"
T_SCREEN, T_CLASSIFY = SCREEN.truth_col, CLASSIFY.truth_col
BLANKS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"


NOT_WORD = r"[^\p{L}\p{N}]+"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(ctes)


VIDEOS = v.cte("videos", "documents", v.VIDEOS)
REPLIES = v.cte("replies", "conversations", v.REPLIES)
RECORDS = v.cte("records", "benchmark", v.BENCHMARK)


def truth_cte(columns: dict[str, str] = v.TRUTH, name: str = "truth") -> str:
    clean = dict(columns)
    for c in (T_SCREEN, T_CLASSIFY):
        clean[c] = f"upper({strip(clean[c])})"
    clean["use"] = f"lower({strip(clean['use'])})"
    return v.cte(name, "labels", clean)


TRUTH = truth_cte()
LOOKUP = (
    f"lookup as (select url, max_by({T_SCREEN}, ord) as ground_truth "
    "from truth where use = 'test' group by url)"
)

ROW_TEXT = "concat_ws(chr(10), {})".format(
    ", ".join(
        f"case when {strip(c)} <> '' then concat('{c}: ', {c}) end"
        for c in ("description", "transcript", "suggested_words")
    )
)


# --- signal scores ----------------------------------------------------------


def words_found(field: str, words: tuple[str, ...]) -> str:
    items = ", ".join(lit(w) for w in words)
    return (
        f"list_intersect(list_distinct(regexp_split_to_array(lower(coalesce({field}, '')), "
        f"'{NOT_WORD}')), [{items}])"
    )


def scores(words: tuple[str, ...], at: float, name: str, stage: str) -> str:
    """CTE with the label, probability and rationale of a one-signal lexicon."""
    passes = "n >= {0}" if stage == "screen" else "n >= {0} or (silent and fields >= 2)"
    return f"""{name}_found as (
        select *, {words_found('description', words)} as d, {words_found('transcript', words)} as t,
            {words_found('suggested_words', words)} as s,
            coalesce(transcript, '') = '' as silent
        from videos),
    {name}_terms as (
        select *, list_sort(list_distinct(list_concat(list_concat(d, t), s))) as terms,
            cast(len(d) > 0 as int) + cast(len(t) > 0 as int) + cast(len(s) > 0 as int) as fields,
            2.0 * len(d) + len(t) + len(s) as evidence
        from {name}_found),
    {name}_counted as (select *, len(terms) as n from {name}_terms),
    {name} as (
        select url, scrape_status, ord,
            case when {passes.format(at)} then 'TRUE' else 'FALSE' end as label,
            round(1.0 / (1.0 + exp({at - 0.5} - evidence)), 9) as prob_true,
            case when n > 0 then concat('signals: ', array_to_string(terms, ', ')) end as rationale
        from {name}_counted)"""


S_SCREEN = scores(m.INSULT_WORDS, m.SCREEN_AT, "screened", "screen")
S_CLASSIFY = scores(m.INSULT_WORDS, m.CLASSIFY_AT, "strict", "classify")
F_SCREEN = scores(m.FEW_WORDS, m.SCREEN_AT, "few_screened", "screen")
F_CLASSIFY = scores(m.FEW_WORDS, m.CLASSIFY_AT, "few_strict", "classify")

PREDICTIONS = """predictions as (
    select url,
        case when scrape_status = 'error' then 'SKIPPED' else label end as label,
        case when scrape_status = 'error' then null else prob_true end as prob_true,
        case when scrape_status = 'error' then null else rationale end as rationale
    from screened)"""
PREDICTED = with_(VIDEOS, S_SCREEN, PREDICTIONS)


def both_stages(name: str, screened: str, strict: str, suffix: str) -> str:
    failed = "a.scrape_status is not distinct from 'error'"
    return f"""{name} as (
        select a.url,
            case when {failed} then 'SKIPPED' else a.label end as {BROAD}_{suffix},
            case when {failed} then 'SKIPPED' when a.label = 'TRUE' then b.label end
                as {STRICT}_{suffix},
            case when {failed} then null when a.label = 'TRUE' then b.prob_true
                else a.prob_true end as {PROB}_{suffix},
            case when {failed} then null when a.label = 'TRUE' then b.rationale end
                as {STRICT}_{suffix}_rationale
        from {screened} a join {strict} b on a.url = b.url)"""


CASCADE = with_(
    VIDEOS, S_SCREEN, S_CLASSIFY, both_stages("full_wide", "screened", "strict", "full")
)
COUNTS = f"""{with_(VIDEOS, S_SCREEN, PREDICTIONS, TRUTH, LOOKUP)},
    joined as (select p.*, l.ground_truth from predictions p join lookup l on p.url = l.url),
    counts as (
        select cast(count(*) filter (label = 'TRUE' and ground_truth = 'TRUE') as bigint) as tp,
            cast(count(*) filter (label = 'FALSE' and ground_truth = 'FALSE') as bigint) as tn,
            cast(count(*) filter (label = 'TRUE' and ground_truth = 'FALSE') as bigint) as fp,
            cast(count(*) filter (label = 'FALSE' and ground_truth = 'TRUE') as bigint) as fn,
            cast(count(*) filter (label in ('TRUE', 'FALSE')) as bigint) as total,
            cast(count(*) filter (label not in ('TRUE', 'FALSE')) as bigint) as left_out
        from joined)"""
METRICS = """round((tp + tn) / nullif(total, 0), 9) as accuracy,
    round(tp / nullif(tp + fp, 0), 9) as precision, round(tp / nullif(tp + fn, 0), 9) as recall"""
DETAIL = """detail as (select url, label as predicted, ground_truth, rationale
    from joined where label in ('TRUE', 'FALSE'))"""


def notices() -> str:
    cols = ("description", "transcript", "suggested_words")
    parts = []
    for c in cols:
        line = (
            "concat(' ', array_to_string(regexp_split_to_array(lower(coalesce("
            f"{c}, '')), '{NOT_WORD}'), ' '), ' ')"
        )
        for p in (*m.NOTICE_PHRASES, "copyright"):
            parts.append((c, p, f"contains({line}, {lit(f' {p} ')})"))
    any_field = {
        p: " or ".join(test for _, q, test in parts if q == p) for p in (*m.NOTICE_PHRASES, "copyright")
    }
    against = " + ".join(f"cast(({test}) as int)" for test in any_field.values())
    per_field = " + ".join(
        f"{2.0 if c == 'description' else 1.0} * cast({test} as int)" for c, _, test in parts
    )
    return f"""{with_(VIDEOS, S_SCREEN)},
        negative as (select url, 0.5 * ({against}) as against, 0.5 * ({per_field}) as minus
            from videos),
        weighed as (select c.url, cast(c.n as double) as support, cast(n.against as double) as against,
                c.evidence - n.minus as net, c.terms, c.n
            from screened_counted c join negative n on c.url = n.url)
        select url, support, against,
            case when support >= 1 and support >= against then 'TRUE' else 'FALSE' end as label,
            round(1.0 / (1.0 + exp(0.5 - net)), 9) as prob_true,
            case when n > 0 then concat('signals: ', array_to_string(terms, ', ')) end as rationale
        from weighed"""


# --- lexicons: found(url, field, term, signal, screen, classify, weight) and facts(url, silent, n_tags) -----


def stage_rules(stage: str, at: float, lone: str = "false") -> str:
    """Labels of a stage; ``lone`` may use the number of condition tags and of hits."""
    decided = "support >= {0} and support >= against" if stage == "screen" else (
        f"(support - against >= {{0}} or (silent and agreeing >= 2 and support > against)) and not ({lone})")
    return f"""select f.url, '{stage}' as stage, case when {decided.format(at)} then 'TRUE' else 'FALSE' end as label,
            round(1.0 / (1.0 + exp(least({at - 0.5} - evidence, 700.0))), 9) as prob_true,
            case when len(hits) > 0 then concat('signals: ', array_to_string(hits, ', ')) end as rationale
        from (
            select x.url, any_value(silent) as silent, any_value(n_tags) as n_tags,
                coalesce(sum(weight * {stage} * case when field = 'description' then 2.0 else 1.0 end) filter (field <> '#'), 0.0) as evidence,
                count(distinct field) filter (field <> '#' and {stage} = 1) as agreeing,
                coalesce(list_sort(list_distinct(list(term) filter (field <> '#' and {stage} = 1))), []) as hits,
                count(distinct term) filter (field = '#' and signal = 'named_condition' and not contains(term, ' ')) as conditions
            from facts x left join found o on x.url = o.url group by x.url) f
        join (
            select x.url, coalesce(sum(weight) filter ({stage} = 1), 0.0) as support, coalesce(sum(weight) filter ({stage} = -1), 0.0) as against
            from facts x left join (select distinct url, term, signal, screen, classify, weight from found where field <> '#') o on x.url = o.url
            group by x.url) s on f.url = s.url"""


def both_rules(screen_at: float, classify_at: float, lone: str = "false") -> str:
    return f"{stage_rules('screen', screen_at)} union all {stage_rules('classify', classify_at, lone)}"


FIELD_TEXTS = "(values ('description'), ('transcript'), ('suggested_words')) n(field)"
FIELD_LOW = "lower(coalesce(case field when 'description' then description when 'transcript' then transcript else suggested_words end, ''))"
LYRICS = "(contains({0}, '♪') or contains({0}, '♫') or contains({0}, '(singing)') or contains({0}, '(music)'))"
SILENCE = f"coalesce({strip('transcript')}, '') = '' or {LYRICS.format('lower(transcript)')}"

TAGS = f"""tagged as (select {", ".join(f"{e} as {c}" for c, e in v.TAGGED.items())} from documents),
    tags as (select url, unnest(regexp_extract_all(lower(coalesce(description, '')), '#([\\p{{L}}\\p{{N}}_]+)', 1)) as tag from tagged),
    known as (select distinct word from (values {", ".join(f"({lit(w)})" for w in sorted({*TAG_WORDS, *(x for t in MENTAL_HEALTH.terms() for x in t.split(" "))}))}) k(word)),
    ways as (
        with recursive way(tag, reached, parts) as (
            select distinct tag, cast(0 as bigint), cast([] as varchar[]) from tags
            union all
            select w.tag, w.reached + length(k.word), list_append(w.parts, k.word)
            from way w join known k on substr(w.tag, w.reached + 1, length(k.word)) = k.word and w.reached < length(w.tag))
        select tag, parts from way where reached = length(tag) and len(parts) > 1),
    broken as (
        select tag, parts from ways
        qualify row_number() over (partition by tag order by len(parts), list_transform(list_reverse(parts), lambda p: -length(p))) = 1)"""

DEFAULT_TERMS = ", ".join(
    f"({lit(s.name)}, {lit(t)}, {s.screen}, {s.classify}, cast({s.weight} as double))" for s in MENTAL_HEALTH.signals for t in s.terms
)
DEFAULT_RULES = f"""with {TAGS},
    lexicon as (select * from (values {DEFAULT_TERMS}) l(signal, term, screen, classify, weight)),
    cut as (
        select url, field, {FIELD_LOW} as low from tagged cross join {FIELD_TEXTS}),
    texts as (
        select url, field, concat(' ', array_to_string(regexp_split_to_array(low, '{NOT_WORD}'), ' '), ' ') as line
        from cut where not (field = 'transcript' and {LYRICS.format('low')})
        union all select url, 'description', concat(' ', array_to_string(parts, ' '), ' ') from tags join broken using (tag)
        union all select url, '#', concat(' ', unnest(parts), ' ') from tags join broken using (tag)
        union all select url, '#', concat(' ', tag, ' ') from tags),
    found as (select distinct url, field, l.* from texts join lexicon l on contains(line, concat(' ', term, ' '))),
    facts as (
        select url, {SILENCE} as silent, (select count(*) from tags where tags.url = t.url) as n_tags from tagged t)
    {both_rules(1.0, 2.0, 'n_tags >= 5 and conditions = 1 and len(hits) = 1')}"""


def corpus_runs(table: str, n: int) -> str:
    run = " || ' ' || ".join(["word", *(f"lead(word, {k}) over o" for k in range(1, n))])
    return f"""select {run} as term from (
            select r, unnest(range(len(w))) as i, unnest(w) as word
            from (select row_number() over () as r, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{NOT_WORD}'), lambda x: x <> '') as w from {table}))
        {"window o as (partition by r order by i) qualify term is not null" if n > 1 else ""}"""


LARGE_LEXICON = f"""{with_(VIDEOS)},
    lexicon as (
        select term, {", ".join(f"{e} as {c}" for c, e in v.CORPUS_TERMS.items())}
        from (select distinct term from (
            ({corpus_runs('documents', 1)}) union all ({corpus_runs('conversations', 2)}) union all ({corpus_runs('benchmark', 3)})))
        where length(term) > 2),
    cut as (select url, field, {FIELD_LOW} as low from videos cross join {FIELD_TEXTS}),
    words as (
        select url, field, unnest(range(len(w))) as i, unnest(w) as word
        from (select url, field, regexp_split_to_array(low, '{NOT_WORD}') as w from cut where not (field = 'transcript' and {LYRICS.format('low')}))),
    runs as (
        select url, field, unnest([word, word || ' ' || lead(word, 1) over o, word || ' ' || lead(word, 1) over o || ' ' || lead(word, 2) over o]) as run
        from words window o as (partition by url, field order by i)),
    found as (select distinct url, field, l.* from runs join lexicon l on run = term),
    facts as (select url, {SILENCE} as silent, 0 as n_tags from videos)
    {both_rules(m.SCREEN_AT, m.CLASSIFY_AT)}"""


# --- prompts ----------------------------------------------------------------

TRAIN = f"""{with_(VIDEOS, TRUTH)},
    train as (
        select t.ord, {ROW_TEXT} as text, t.{T_SCREEN}, t.{T_CLASSIFY},
            case when t.rationale <> 'n/a' then t.rationale end as rationale
        from truth t join videos v on t.url = v.url where t.use = 'train')"""


def example(stage: StageSpec) -> str:
    body = (
        "concat(chr(10), chr(10), 'Video metadata:', chr(10), text, chr(10), 'Label: ', "
        f"{stage.truth_col}"
    )
    if stage.examples_with_rationale:
        body += (
            f", case when coalesce({strip('rationale')}, '') <> '' "
            "then concat(chr(10), 'Rationale: ', rationale) else '' end"
        )
    return body + ")"


def block(stage: StageSpec) -> str:
    return f"""block as (
        select 1 as part, ord, {example(stage)} as piece from train where text <> ''
        union all select 0, null, concat('Examples:', chr(10)) from train where text <> '' having count(*) > 0
        union all select 2, null, chr(10) from train where text <> '' having count(*) > 0)"""


def pieces(stage: StageSpec, request: str) -> str:
    before, after = stage.template.split("{examples}")
    return f"""{TRAIN}, {block(stage)}
        select 1 as slot, part, ord, piece from block
        union all select 0, 3, null, {lit(before)}
        union all select 1, 3, null, {lit(after + request)}"""


def prompt_sizes() -> str:
    parts = []
    for stage in (SCREEN, CLASSIFY):
        fixed = len(stage.template) - len("{examples}")
        parts.append(
            f"select {lit(stage.name)} as stage, substr(md5({lit(stage.template)}), 1, 8) as prompt_hash, "
            f"cast(sum(length({example(stage)})) + {fixed + len('Examples:') + 2} as bigint) as n_chars, "
            "count(*) as n_examples from train where text <> ''"
        )
    return f"{TRAIN} {' union all '.join(parts)}"


SCREEN_PROMPT = SCREEN.template.replace("{examples}", "")
TOKENS = f"""{with_(VIDEOS)},
    sized as (select url,
        cast(({len(SCREEN_PROMPT) + len("Video metadata:") + 1} + length({ROW_TEXT})) // 4 as bigint)
            as tokens
    from videos)"""


# --- replies and benchmark --------------------------------------------------


def label_of(x: str, labels: tuple[str, ...] = ("TRUE", "FALSE")) -> str:
    t = f"upper({strip(f'coalesce({x}, chr(0))')})"
    names = [lit(name.upper()) for name in labels]
    places = ", ".join(
        f"{{'at': strpos(concat(' ', {t}), concat(' ', {name})), 'place': {i}, 'name': {name}}}"
        for i, name in enumerate(names)
    )
    return (
        f"case when {t} in ({', '.join(names)}) then {t} "
        f"else coalesce(list_sort(list_filter([{places}], lambda p: p.at > 0))[1].name, 'UNKNOWN') end"
    )


IS_JSON = "(json_valid(raw) and json_type(case when json_valid(raw) then raw end) = 'OBJECT')"
JSON = "case when json_valid(raw) then raw end"
JSON_LABEL = label_of(f"json_extract_string({JSON}, '$.label')")
JSON_REASON = f"nullif({strip(f'''json_extract_string({JSON}, '$.rationale')''')}, '')"
LINE_LABEL = label_of(f"string_split({strip('raw')}, chr(10))[1]")
LINE_REASON = strip(f"string_split({strip('raw')}, chr(10))[2]")

POST = r"""trim(coalesce(
    nullif(regexp_extract(query, '(?s)Consider this post:\s*["''](.+?)["''](?:\s+Question:|\s*$)', 1), ''),
    nullif(regexp_extract(query, '(?s)Consider this post:\s*(.+?)\s*Question:', 1), ''),
    query), concat(' ', chr(9), chr(10), chr(13)))"""
POST_LABEL = """case when lower(response) like 'yes%' then 'TRUE'
    when lower(response) like 'no%' then 'FALSE' end"""
REASONING = rf"""case when {POST_LABEL} is null then ''
    else trim(regexp_extract(response, '(?s)[Rr]easoning:\s*(.+)', 1),
        concat(' ', chr(9), chr(10), chr(13))) end"""
CONVERTED = f"""{with_(RECORDS)},
    posts as (select *, {POST} as post, {POST_LABEL} as label, {REASONING} as reason from records),
    converted as (select task, concat('imhi:', task, ':', idx, ':', substr(md5(post), 1, 8)) as url,
        post as description, '' as transcript, '' as suggested_words,
        label as {T_CLASSIFY}, reason as rationale, 'test' as use
    from posts where label is not null)"""

WITH_DONE = f"""{with_(VIDEOS, TRUTH)},
    known as (select v.*, t.{T_SCREEN} as done_label from videos v left join truth t on v.url = t.url),
    marked as (select *, case when done_label is null and scrape_status = 'error' then 'SKIPPED'
        else done_label end as label from known)"""

RUNS = ", ".join(
    scores(words, at, f"run_{name}_{at:g}", "classify")
    for name, words in (("full", m.INSULT_WORDS), ("few", m.FEW_WORDS))
    for at in (1.0, 2.0, 3.0)
)
RUN_ROWS = " union all ".join(
    f"select {lit(model)} as model, 'at {at:g}' as prompt_hash, url, label from run_{name}_{at:g}"
    for name, model in (("full", m.FULL.model), ("few", m.FEW.model))
    for at in (1.0, 2.0, 3.0)
)

NO_VALUE = ["", "n/a"]


def loaded(c: str) -> str:
    return f"case when {c} not in ({', '.join(lit(x) for x in NO_VALUE)}) then {c} end as {c}"


# --- evaluation with uncertainty ------------------------------------------------


def ratio(over: str, under: str) -> str:
    return f"({over}) / nullif(cast({under} as double), 0)"


CURVE = f"""{with_(VIDEOS, S_SCREEN, PREDICTIONS, TRUTH, LOOKUP)},
    scored as (
        select floor(prob_true * 100) as bin, ground_truth = 'TRUE' as yes
        from predictions p join lookup l on p.url = l.url where label in ('TRUE', 'FALSE')),
    cuts as (
        select c.bin, cast(count(*) filter (yes and s.bin >= c.bin) as bigint) as tp, cast(count(*) filter (not yes and s.bin >= c.bin) as bigint) as fp,
            cast(count(*) filter (yes and s.bin < c.bin) as bigint) as fn, cast(count(*) filter (not yes and s.bin < c.bin) as bigint) as tn
        from (select distinct bin from scored) c, scored s group by c.bin),
    pairs as (
        select avg(case when a.bin > b.bin then 1.0 when a.bin = b.bin then 0.5 else 0.0 end) as roc_area
        from scored a, scored b where a.yes and not b.yes),
    means as (select avg({ratio('tp', 'tp + fp')}) as pr_area from scored s join cuts c on s.bin = c.bin where yes)
    select round(bin / 100.0, 9) as threshold, tp, fp, fn, tn, round({ratio('tp', 'tp + fp')}, 9) as precision,
        round({ratio('tp', 'tp + fn')}, 9) as recall, round(roc_area, 9) as roc_area, round(pr_area, 9) as pr_area
    from cuts, pairs, means"""

TWO_RUNS = f"""{with_(VIDEOS, S_SCREEN, F_SCREEN, TRUTH, LOOKUP)},
    detail as (
        select p.url, run, label as predicted, ground_truth
        from (select url, 'full' as run, label from screened union all select url, 'few', label from few_screened) p
        join lookup l on p.url = l.url),
    chances as (
        select k, floor(sum(share) over (order by k) * 4294967296) as cut
        from (select k, exp(-1.0) / cast(factorial(cast(k as int)) as double) as share from range(13) r(k))),
    draws as (
        select url, cast(r as int) as replicate,
            cast('0x' || substr(md5(concat('7:', url, ':', cast(r // 4 as varchar))), cast(r % 4 as int) * 8 + 1, 8) as bigint) as number
        from (select distinct url from detail), range(100) g(r)),
    drawn as (
        select url, replicate, (select count(*) from chances where cut <= number) as w from draws
        union all select distinct url, -1, 1 from detail),
    counted as (
        select replicate, run, sum(w) filter (predicted = 'TRUE' and ground_truth = 'TRUE') as tp, sum(w) filter (predicted = 'FALSE' and ground_truth = 'FALSE') as tn,
            sum(w) filter (predicted = 'TRUE' and ground_truth = 'FALSE') as fp, sum(w) filter (predicted = 'FALSE' and ground_truth = 'TRUE') as fn
        from detail join drawn using (url) group by all),
    filled as (select replicate, run, coalesce(tp, 0) as tp, coalesce(tn, 0) as tn, coalesce(fp, 0) as fp, coalesce(fn, 0) as fn from counted),
    metrics as (
        select replicate, run, 'accuracy' as metric, {ratio('tp + tn', 'tp + tn + fp + fn')} as value from filled
        union all select replicate, run, 'precision', {ratio('tp', 'tp + fp')} from filled
        union all select replicate, run, 'recall', {ratio('tp', 'tp + fn')} from filled)"""


def enclosed(source: str, keys: str) -> str:
    return f"""select {keys}, round(max(value) filter (replicate = -1), 9) as estimate,
            round(list_sort(list(value) filter (replicate >= 0 and value is not null))[cast(floor((1 - 0.95) / 2 * (count(value) - 1)) as int) + 1], 9) as low,
            round(list_sort(list(value) filter (replicate >= 0 and value is not null))[cast(count(value) - 1 - floor((1 - 0.95) / 2 * (count(value) - 1)) as int)], 9) as high,
            count(value) - 1 as n_replicates
        from {source} group by {keys}"""


ALPHA = f"""{with_(VIDEOS, S_SCREEN, F_SCREEN, scores(m.INSULT_WORDS, 2.0, "twice", "screen"))},
    given as (
        select url, label from screened union all select url, label from few_screened
        union all select url, label from twice where ord % 5 <> 0),
    units as (select url, count(*) as m from given group by url having count(*) > 1),
    labels as (select row_number() over () as r, url, label from given),
    pairs as (
        select a.label as x, b.label as y, 1.0::double / (u.m - 1) as w
        from labels a join labels b on a.url = b.url and a.r <> b.r join units u on u.url = a.url),
    sizes as (select x, sum(w) as n from pairs group by x),
    total as (select sum(n) as n, sum(n * n) as squares from sizes),
    shares as (
        select n, (select coalesce(sum(w), 0) from pairs where x <> y) / n as observed, (n * n - squares) / (n * (n - 1)) as expected from total)
    select round(n, 9) as n_values, round(observed, 9) as observed, round(expected, 9) as expected,
        round(1 - observed / nullif(expected, 0), 9) as alpha from shares"""


ORACLE = {
    "threshold_curve": CURVE,
    "run_intervals": f"{TWO_RUNS} {enclosed('metrics', 'run, metric')}",
    "run_difference": f"""{TWO_RUNS},
        apart as (
            select replicate, metric, max(value) filter (run = 'full') - max(value) filter (run = 'few') as value from metrics group by all),
        shares as (
            select metric, round(avg(case when value > 0 then 1.0 when value = 0 then 0.5 when value < 0 then 0.0 end), 9) as share_above
            from apart where replicate >= 0 group by metric),
        rights as (
            select url, bool_or(predicted = ground_truth) filter (run = 'few') as a, bool_or(predicted = ground_truth) filter (run = 'full') as b
            from detail group by url),
        alone as (select count(*) filter (a and not b) as only_first, count(*) filter (b and not a) as only_second from rights)
        select e.*, share_above, only_first, only_second
        from ({enclosed('apart', 'metric')}) e join shares using (metric), alone""",
    "agreement_alpha": ALPHA,
    "sample_run": f"""{CASCADE},
        slice as (select url from videos where scrape_status is distinct from 'error' order by ord limit 20)
        select url, {BROAD}_full, {STRICT}_full, {STRICT}_full_rationale from full_wide where url in (select url from slice)""",
    "benchmark_conversion": f"""{CONVERTED},
        balance as (
            select coalesce(task, 'ALL') as task, count(*) as n_rows, count(*) filter ({T_CLASSIFY} = 'TRUE') as n_true,
                count(*) filter ({T_CLASSIFY} = 'FALSE') as n_false,
                round(count(*) filter ({T_CLASSIFY} = 'TRUE') / count(*), 9) as share_true
            from converted group by rollup (task))
        select *, case when n_rows = (select count(*) from converted) then n_rows end as n_written from balance""",
    "truth_report": f"""{with_(truth_cte(v.TRUTH_WITH_ISSUES), truth_cte(name="fine"))},
        trained as (select * from fine where use = 'train'),
        issues as (
            select 'missing_label' as "check", cast(null as varchar) as value from truth where {T_SCREEN} is null
            union all select 'invalid_label', {T_SCREEN} from truth where {T_SCREEN} not in ('TRUE', 'FALSE')
            union all select 'invalid_use', use from truth
                where {T_SCREEN} is not null and (use is null or use not in ('train', 'test')))
        select 'issues' as "table", "check", value, count(*) as n from issues group by all
        union all select 'columns', 'missing_column', unnest(['{T_SCREEN}', 'use']), 0
        union all select 'train only', 'no_test_rows', null, 0 where not exists (select 1 from trained where use = 'test')
        union all select 'empty', unnest(['no_rows', 'no_test_rows']), null, 0""",
    "changed_rows": f"""{with_(v.cte("videos", "documents", v.CHANGED), S_SCREEN, PREDICTIONS)}
        select p.url, label, prob_true, case when v.ord % 4 = 0 and v.ord % 3 <> 2 then 'second' else 'first' end as run_id
        from predictions p join videos v on p.url = v.url""",
    "stream_progress": f"""{CASCADE},
        rows as (
            select ord % 3 as epoch, {BROAD}_full as broad, {STRICT}_full as strict
            from full_wide w join videos v on w.url = v.url)
        select 'arrived' as stage, epoch, count(*) as n_rows, cast(0 as bigint) as n_failed from rows group by epoch
        union all select 'screen', epoch, count(broad), 0 from rows group by epoch
        union all select 'classify', epoch, count(strict), 0 from rows group by epoch""",
    "signal_rules": DEFAULT_RULES,
    "table_rules": DEFAULT_RULES,
    "hashtag_parts": f"""with {TAGS}
        select url, tag, coalesce(array_to_string(parts, ' '), '') as parts, cast(coalesce(len(parts), 0) as int) as n_parts
        from tags left join broken using (tag)""",
    "large_lexicon": LARGE_LEXICON,
    "committed_batches": f"""{PREDICTED}
        select p.*, 'first' as run_id, cast(ord % 3 as bigint) as batch_id
        from predictions p join videos v on p.url = v.url where ord % 3 < 2""",
    "attempts": f"""{with_(VIDEOS)},
        sized as (select url, length({ROW_TEXT}) as n from videos where scrape_status is distinct from 'error')
        select url, cast(case when n % 8 = 0 then 2 else 1 end as bigint) as tries,
            concat('failed on ', n, ' characters') as last_error, case when n % 8 <> 0 then 'TRUE' end as label
        from sized where n % 4 = 0""",
    "resume_buckets": f"""{with_(VIDEOS, TRUTH)}
        select url, {ROW_TEXT} as text from videos where url not in (select url from truth)""",
    "scan_videos": f"""{with_(VIDEOS)}
        select url, description, transcript, suggested_words, scrape_status from videos""",
    "ground_truth_load": f"""{with_(VIDEOS, TRUTH)}
        select t.url, t.{T_SCREEN}, t.{T_CLASSIFY}, t.use, {loaded('rationale').replace('as rationale', '') } as rationale,
            t.ord, {', '.join(loaded(c) for c in ('description', 'transcript', 'suggested_words'))}
        from truth t join videos v on t.url = v.url""",
    "checkpoint_roundtrip": f"""{PREDICTED}
        select *, 'screen' as stage, 'first' as run_id from predictions""",
    "benchmark_scan": f"""{with_(RECORDS)}
        select task, idx, query, response from records where task in ('DR', 'loneliness')""",
    "sample_slice": f"""{with_(VIDEOS)}
        select * from videos where scrape_status is distinct from 'error' order by ord limit 20""",
    "result_listing": f"""{CASCADE}
        select url, {BROAD}_full, {STRICT}_full, {STRICT}_full_rationale from full_wide""",
    "experiment_row": f"""{COUNTS}
        select 'screen' as stage, 'insult words' as model, 'signals' as backend, tp, tn, fp, fn, total,
            {METRICS}, (select count(*) from truth where use = 'train') as n_examples,
            substr(md5({lit(SCREEN.template)}), 1, 8) as prompt_hash,
            cast(4 as bigint) as concurrency,
            substr(md5({lit(SCREEN_PROMPT)}), 1, 8) as assembled_hash
        from counts""",
    "with_result_columns": f"""{with_(VIDEOS)}
        select url, description, transcript, suggested_words, scrape_status,
            cast(null as varchar) as {BROAD}_full, cast(null as double) as {PROB}_full,
            cast(null as varchar) as {BROAD}_full_rationale from videos""",
    "skip_failed": f"{WITH_DONE} select url, label from marked",
    "exclude_failed": f"""{with_(VIDEOS)} select url, scrape_status from videos
        where scrape_status is null or scrape_status <> 'error'""",
    "row_filter": f"""{with_(VIDEOS)} select url, suggested_words from videos
        where scrape_status = 'ok'""",
    "pending_counts": f"""{WITH_DONE},
        n as (select count(*) filter (label is null and scrape_status = 'ok') as pending,
            count(*) as total from marked)
        select pending, total - pending as done, total from n""",
    "row_text": f"{with_(VIDEOS)} select url, {ROW_TEXT} as text from videos",
    "ground_truth_issues": f"""{with_(truth_cte(v.TRUTH_WITH_ISSUES))},
        issues as (
            select 'missing_label' as "check", cast(null as varchar) as value
                from truth where {T_SCREEN} is null
            union all select 'invalid_label', {T_SCREEN} from truth
                where {T_SCREEN} not in ('TRUE', 'FALSE')
            union all select 'invalid_use', use from truth
                where {T_SCREEN} is not null and (use is null or use not in ('train', 'test')))
        select "check", value, count(*) as n from issues group by all""",
    "train_test_counts": f"""{with_(TRUTH)}
        select use, {T_CLASSIFY} as label, count(*) as n from truth group by all""",
    "fewshot_block": f"{TRAIN}, {block(CLASSIFY)} select part, ord, piece from block",
    "system_prompt": pieces(
        SCREEN, "\n\nAlso provide a one-sentence rationale explaining your decision."
    ),
    "prompt_hash": prompt_sizes(),
    "chat_messages": f"""{with_(VIDEOS)}
        select url, cast(0 as bigint) as turn, 'system' as role, {lit(SCREEN_PROMPT)} as content
            from videos
        union all select url, 1, 'user', concat('Video metadata:', chr(10), {ROW_TEXT}) from videos""",
    "token_estimate": f"""{TOKENS}
        select count(*) as n_rows, max(tokens) as max_tokens,
            round(quantile_cont(tokens, 0.5), 9) as p50_tokens,
            round(quantile_cont(tokens, 0.95), 9) as p95_tokens,
            cast(count(*) filter (tokens > 4096) as bigint) as over_limit from sized""",
    "oversize_rows": f"""{TOKENS}
        select url, tokens, 'TOO_LONG' as label from sized where tokens + 11 > 4096""",
    "score_pluggable": f"""{with_(VIDEOS, S_SCREEN)}
        , tokens as (select url, cast(({len("Video metadata:") + 1} + length({ROW_TEXT})) // 4 as bigint) + 11 > 4096 as too_long
            from videos)
        select c.url,
            case when c.scrape_status = 'error' then 'SKIPPED' when k.too_long then 'TOO_LONG'
                when n > 0 then 'TRUE' else 'FALSE' end as label,
            case when c.scrape_status = 'error' or k.too_long then null
                else round(n / (n + 1.0), 9) end as prob_true
        from screened_counted c join tokens k on c.url = k.url""",
    "signal_counts": notices(),
    "screen": f"{with_(VIDEOS, S_SCREEN)} select url, label, prob_true, rationale from screened",
    "classify": f"{with_(VIDEOS, S_CLASSIFY)} select url, label, prob_true, rationale from strict",
    "cascade": f"{CASCADE} select * from full_wide",
    "two_pass": f"{CASCADE} select * from full_wide",
    "prob_true": """select doc_id, case doc_id % 4 when 1 then round(exp(-(doc_id % 10) / 10.0), 9)
        when 2 then round(exp(-0.5), 9) end as prob_true from documents""",
    "parse_other_labels": f"""{with_(REPLIES)}
        select conv_id, turn, {label_of('raw', m.OTHER_LABELS)} as label from replies""",
    "copied_keys": f"""with videos as (
            select {', '.join(f'{e} as {c}' for c, e in v.VIDEOS.items())} from documents
            union all select {', '.join(f'{e} as {c}' for c, e in v.COPIES.items())} from documents),
        {S_SCREEN}, {PREDICTIONS} select url, label from predictions""",
    "incremental_two_pass": f"{CASCADE} select * from full_wide",
    "evaluate_run": f"""{with_(VIDEOS, S_SCREEN, TRUTH, LOOKUP)},
        joined as (select s.label, l.ground_truth from screened s join lookup l on s.url = l.url),
        counts as (select count(*) filter (label = 'TRUE' and ground_truth = 'TRUE') as tp,
                count(*) filter (label = 'FALSE' and ground_truth = 'FALSE') as tn,
                count(*) filter (label = 'TRUE' and ground_truth = 'FALSE') as fp,
                count(*) filter (label = 'FALSE' and ground_truth = 'TRUE') as fn, count(*) as total from joined)
        select tp, tn, fp, fn, total, {METRICS}, true as timed from counts""",
    "benchmark_file": f"""{CONVERTED} select {', '.join(loaded(c) for c in
            ('url', 'description', 'transcript', 'suggested_words', T_CLASSIFY, 'rationale', 'use'))}
        from converted""",
    "parse_label": f"{with_(REPLIES)} select conv_id, turn, {label_of('raw')} as label from replies",
    "parse_json_reply": f"""{with_(REPLIES)}
        select conv_id, turn, case when {IS_JSON} then {JSON_LABEL} end as label,
            case when {IS_JSON} then {JSON_REASON} end as rationale from replies""",
    "parse_line_reply": f"""{with_(REPLIES)}
        select conv_id, turn, {LINE_LABEL} as label, {LINE_REASON} as rationale from replies""",
    "parse_reply": f"""{with_(REPLIES)}
        select conv_id, turn, case when {IS_JSON} then {JSON_LABEL} else {LINE_LABEL} end as label,
            case when {IS_JSON} then {JSON_REASON} else {LINE_REASON} end as rationale from replies""",
    "resume_pending": f"""{with_(VIDEOS)} select url, {ROW_TEXT} as text from videos
        where ord not in (select doc_id from labels)""",
    "batch_plan": """with numbered as (
            select doc_id, (row_number() over (order by doc_id) - 1) // 200 as batch_id from documents)
        select cast(batch_id as bigint) as batch_id, count(*) as n_rows,
            min(doc_id) as first_ord, max(doc_id) as last_ord from numbered group by 1""",
    "batch_progress": """with numbered as (
            select doc_id, (row_number() over (order by doc_id) - 1) // 200 as batch_id from documents),
        sizes as (select cast(batch_id as bigint) as batch_id, count(*) as n_rows
            from numbered group by 1),
        running as (select *, cast(sum(n_rows) over (order by batch_id) as bigint) as done from sizes)
        select 'first' as run_id, batch_id, n_rows, done,
            round(done * 100.0 / (select count(*) from documents), 9) as percent from running""",
    "incremental_screen": f"{PREDICTED} select * from predictions",
    "label_summary": f"""{PREDICTED} select label, count(*) as n from predictions
        where label <> 'SKIPPED' group by label""",
    "eval_set": f"""{with_(TRUTH)} select url, {T_SCREEN}, {T_CLASSIFY}, use,
        cast(null as varchar) as {BROAD}_few, cast(null as double) as {PROB}_few
        from truth where use = 'test'""",
    "truth_lookup": f"""{with_(TRUTH, truth_cte(v.LATER_TRUTH, 'later'))},
        copies as (select * from truth union all select * from later)
        select url, max_by({T_SCREEN}, ord) as ground_truth from copies group by url""",
    "confusion_counts": f"{COUNTS} select * from counts",
    "eval_metrics": f"{COUNTS} select {METRICS} from counts",
    "confusion_matrix": f"""{COUNTS}
        select label as predicted,
            count(*) filter (ground_truth = 'FALSE') as actual_false,
            count(*) filter (ground_truth = 'TRUE') as actual_true
        from joined where label in ('TRUE', 'FALSE') group by label""",
    "mismatches": f"{COUNTS}, {DETAIL} select * from detail where predicted <> ground_truth",
    "eval_detail": f"{COUNTS}, {DETAIL} select * from detail",
    "run_comparison": f"""{with_(VIDEOS, TRUTH)}, {RUNS},
        lookup as (select url, max_by({T_CLASSIFY}, ord) as ground_truth
            from truth where use = 'test' group by url),
        predicted as ({RUN_ROWS}),
        judged as (select p.model, p.prompt_hash,
                count(*) filter (label = ground_truth) / count(*) as accuracy,
                count(*) filter (label = 'TRUE' and ground_truth = 'TRUE')
                    / nullif(count(*) filter (ground_truth = 'TRUE'), 0) as recall
            from predicted p join lookup l on p.url = l.url group by all),
        ranked as (select *, row_number() over (partition by model
                order by accuracy desc, recall desc, prompt_hash desc) as place,
                count(*) over (partition by model) as n_runs
            from judged)
        select 'classify' as stage, model, n_runs, round(accuracy, 9) as best_accuracy,
            prompt_hash as best_prompt, round(recall, 9) as best_recall
        from ranked where place = 1""",
    "model_comparison": f"""{CASCADE}, {F_SCREEN}, {F_CLASSIFY},
            {both_stages('few_wide', 'few_screened', 'few_strict', 'few')},
        pairs as (select a.url, a.{BROAD}_full, a.{STRICT}_full, a.{PROB}_full,
                b.{BROAD}_few, b.{STRICT}_few, b.{PROB}_few,
                list_filter([a.{STRICT}_full, b.{STRICT}_few], lambda x: x is not null) as labels
            from full_wide a join few_wide b on a.url = b.url)
        select * exclude (labels), cast(len(labels) as bigint) as n_models,
            cast(len(list_filter(labels, lambda x: x = 'TRUE')) as bigint) as n_true,
            len(list_distinct(labels)) <= 1 as agree
        from pairs""",
    "labels_joined_back": f"""{PREDICTED}
        select url, label as {BROAD}_full, prob_true as {PROB}_full from predictions
        union all select url, label, prob_true from predictions""",
    "extract_post": f"{with_(RECORDS)} select task, idx, {POST} as post from records",
    "extract_label": f"{with_(RECORDS)} select task, idx, {POST_LABEL} as label from records",
    "extract_reasoning": f"{with_(RECORDS)} select task, idx, {REASONING} as rationale from records",
    "benchmark_key": f"""{with_(RECORDS)}, posts as (select *, {POST} as post from records)
        select concat('imhi:', task, ':', idx, ':', substr(md5(post), 1, 8)) as url from posts""",
    "capped_tasks": f"""{with_(RECORDS)}, numbered as (
            select *, row_number() over (partition by task order by idx) as place from records)
        select task, idx, query, response from numbered where place <= 5""",
    "label_balance": f"""{CONVERTED}
        select coalesce(task, 'ALL') as task, count(*) as n_rows,
            count(*) filter ({T_CLASSIFY} = 'TRUE') as n_true,
            count(*) filter ({T_CLASSIFY} = 'FALSE') as n_false,
            round(count(*) filter ({T_CLASSIFY} = 'TRUE') / count(*), 9) as share_true
        from converted group by rollup (task)""",
    "benchmark_eval": f"{CONVERTED} select * exclude (task) from converted",
}
