"""DuckDB queries that the registered Spark queries are checked against.

Written separately from the Spark side; only the fixed values (word lists,
suffix tables, model list, weights, limits) are shared.  Queries that SQL cannot express, or
only far too slowly on whole texts, have no entry.
"""

from textfacts import constants as C
from textfacts.functions.stemming import IRREGULAR, STEP2, STEP3, STEP4
from textfacts.operators.factuality import GAZETTEER
from textfacts.plans.views import FAMILY_NAMES, GIVEN_NAMES, PLACES

ORACLES: dict[str, str] = {}


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(quoted(v) for v in row) + ")" for row in rows)


# --- shared pieces ---------------------------------------------------------

WS = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WORD = r"[^\p{L}\p{N}_]"
MONTH = "(" + "|".join(C.MONTHS) + ")[a-z]*"
D = r"\p{Nd}"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{WS}+'), lambda x: x <> '')"


def tokens(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '[^a-z0-9]+'), lambda x: x <> '')"


def joined(words_sql: str) -> str:
    return f"array_to_string({words_sql}, ' ')"


def doubled(text: str) -> str:
    """Every separator twice, so that neighbouring whole-word matches do not share one."""
    return rf"regexp_replace(' ' || {text} || ' ', '({NOT_WORD})', '\1\1', 'g')"


def date_lists(text: str, year: str = "any", full: bool = False) -> str:
    years = (
        f"regexp_extract_all({text}, '{D}{{4}}')"
        if year == "any"
        else f"regexp_extract_all({doubled(text)}, '{NOT_WORD}({D}{{4}}){NOT_WORD}', 1)"
    )
    parts = [
        f"regexp_extract_all({text}, '{D}{{1,2}}[/-]{D}{{1,2}}[/-]{D}{{2,4}}')",
        years,
        f"regexp_extract_all({text}, '(?i){MONTH}{WS}+{D}{{1,2}},?{WS}+{D}{{4}}', {0 if full else 1})",
    ]
    if full:
        parts.append(f"regexp_extract_all({text}, '(?i){D}{{1,2}}{WS}+{MONTH}{WS}+{D}{{4}}')")
    return f"list_distinct(list_concat({', '.join(parts)}))"


def listed(array: str) -> str:
    return f"coalesce(array_to_string(list_sort({array}), '|'), '')"


VOCAB = [(cat, t.lower()) for cat, ts in C.VOCABULARY.items() for t in ts]
VOCAB_CTE = f"vocab(category, term) as (values {values(VOCAB)})"


def terms(text: str) -> str:
    """Correlated list of vocabulary terms inside a text."""
    array = "[" + ", ".join(quoted(t) for _, t in VOCAB) + "]"
    return f"list_distinct(list_filter({array}, lambda v: contains(lower({text}), v)))"


RAW = f"""raw as (
  select text as article, {joined('w[1:(3 * n) // 5]')} as summary,
    case when length(text) % 50 <> 0 then {joined('w[1:2 + n % 3]')} end as headline,
    lang as category, strftime(date '2020-01-01' + cast((n * 7) % 365 as int), '%Y-%m-%d') as date
  from (select *, len(w) as n from (select *, {words('text')} as w from documents)))"""


def row_key(*columns: str) -> str:
    parts = [f"coalesce(length({c})::varchar || ':' || {c}, '-')" for c in columns]
    return f"sha256({' || '.join(parts)})"


CURATED = f"""{RAW}, counted as (
  select distinct *, len({words('summary')}) as summary_word_count, len({words('article')}) as article_word_count
  from raw where article is not null and summary is not null and headline is not null),
curated as (
  select *, {row_key('article', 'summary', 'headline', 'category', 'date')} as row_key from counted
  where summary_word_count between 50 and 250 and article_word_count >= 100 and length(headline) >= 10)"""


def split_cte(source: str, order: str) -> str:
    return f"""placed as (select *, row_number() over (order by {order}) - 1 as p, count(*) over () as n from {source}),
sized as (select *, cast(floor(0.9::double * n) as bigint) as a, cast(floor(0.05::double * n) as bigint) as b from placed),
labelled as (select *, case when p < a then 'train' when p < a + b then 'val' else 'test' end as split,
  (p < least(a, 1000)) or (p >= a and p < a + least(b, 200)) or (p >= a + b and p < a + b + 200) as small from sized)"""


SPLIT = f"{CURATED}, " + split_cte("curated", "date nulls last, row_key")



def picked(terms, key: str) -> str:
    return "[" + ", ".join(quoted(t) for t in terms) + f"][({key}) % {len(terms)} + 1]"


def note(a: str, b: str, t: str) -> str:
    """A sentence with dates and terms told by three numbers."""
    return f"""('Dated ' || (({a}) % 28 + 1) || '/' || (({a}) % 12 + 1) || '/' || (({a}) % 30 + 1990)
  || ' and ' || {picked(C.MONTHS, b)} || ' ' || (({b}) % 27 + 1) || ', ' || (({b}) % 40 + 1980)
  || ' and ' || (({b}) % 26 + 1) || ' ' || {picked(C.MONTHS, f"({b}) + 1")} || ' ' || (({b}) % 50 + 1970)
  || ', ' || {picked(C.VOCABULARY["titles"], t)} || ' of ' || {picked(C.VOCABULARY["political"], f"({t}) + 3")}
  || ' in ' || {picked(C.VOCABULARY["admin"], t)} || ' gave ' || {picked(C.VOCABULARY["numbers"], t)} || '.')"""


K = "doc_id"
NOTED = f"noted as (select doc_id, coalesce(text, '') || ' ' || {note(K, K, K)} as text from documents)"
PAIRS = f"""worded as (select *, len(w) as n, len(v) as m from (
  select d.doc_id, d.lang, d.text as body, {words('d.text')} as w, {words("coalesce(o.text, '')")} as v
  from documents d left join documents o on o.doc_id = d.doc_id + 1)),
sized as (select *, (2 * n + 4) // 5 as k, (2 * m + 4) // 5 as l, body || ' ' || {note(K, K, K)} as source from worded),
picks as (
  select doc_id, lang, n, source, {joined('w[1:(3 * n + 4) // 5]')} as reference, s.system, s.picked, s.note
  from sized, lateral (select unnest([
    {{'system': 'lead', 'picked': {joined('w[1:k]')},
      'note': case when doc_id % 4 <> 0 then ' ' || {note(K, K, K)} else '' end}},
    {{'system': 'middle', 'picked': {joined('w[(3 * n) // 10 + 1:(3 * n) // 10 + k]')}, 'note': ' ' || {note(K, K + ' + 1', K)}}},
    {{'system': 'tail', 'picked': {joined('w[n - k + 1:n]')},
      'note': ' ' || case when doc_id % 3 = 0 then upper({note(K, K, K)}) else {note(K + ' + 1', K, K + ' + 1')} end}},
    {{'system': 'borrowed', 'picked': {joined('v[1:l]')}, 'note': ' ' || {note(K + ' + 2', K + ' + 28', K + ' + 2')}}}]) as s)),
pairs as (
  select * exclude (picked, note), picked || note as candidate,
    case when length(picked) = 0 then 'empty article' when length(reference) = 0 then 'empty reference' end as error
  from picks)"""

SIMILARITY = """alike as (
  select a.vec_id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as similarity
  from embeddings a left join embeddings b on b.vec_id = a.vec_id + 1)"""

ALIKE = """shifts(system, shift) as (values ('lead', 1), ('middle', 2), ('tail', 3), ('borrowed', 4)),
alike as (
  select a.vec_id as doc_id, system, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as similarity
  from embeddings a, shifts join embeddings b on b.vec_id = a.vec_id + shift)"""


# --- scans and curation ----------------------------------------------------

ORACLES["scan_articles_csv"] = f"""with {RAW}
select md5(article) as article_md5, md5(summary) as summary_md5, headline, category, date from raw"""

ORACLES["scan_articles_csv_split"] = ORACLES["scan_articles_csv"]

ORACLES["scan_capped"] = "select * from documents order by doc_id limit 200"

ORACLES["write_splits"] = f"""with {SPLIT}
select split, count(*) as n_rows, count(*) filter (small) as n_small, min(date) as first_date, max(date) as last_date
from labelled group by split"""

ORACLES["write_once"] = f"""with {SPLIT}
select split, count(*) as n_rows, count(*) filter (small) as n_small, true as made_once from labelled group by split"""

ORACLES["read_split"] = f"with {SPLIT} select row_key, date, small from labelled where split = 'val'"

ORACLES["curate_filter_funnel"] = f"""with {RAW}, d as (select distinct * from raw),
f0 as (select * from d where article is not null and summary is not null and headline is not null),
f1 as (select * from f0 where len({words('summary')}) between 50 and 250),
f2 as (select * from f1 where len({words('article')}) >= 100),
f3 as (select * from f2 where length(headline) >= 10)
select 0 as step_no, 'read' as step, count(*) as n_rows from raw
union all select 1, 'deduplicated', count(*) from d
union all select 2, 'complete', count(*) from f0
union all select 3, 'summary_length', count(*) from f1
union all select 4, 'article_length', count(*) from f2
union all select 5, 'headline_length', count(*) from f3"""

ORACLES["curate_exact_dedup"] = "select distinct text, lang from documents"

ORACLES["curate_articles"] = f"""with {CURATED}
select row_key, headline, category, date, summary_word_count::int as summary_word_count,
  article_word_count::int as article_word_count from curated"""

ORACLES["curate_day_statistics"] = f"""with {CURATED}
select count(*) as n, round(avg(article_word_count), 6) as avg_article_words, round(stddev_pop(article_word_count), 4) as std_article_words,
  round(avg(summary_word_count), 6) as avg_summary_words,
  true as headlines_agree, true as categories_agree, true as median_agrees from curated"""

ORACLES["epoch_batch_rows"] = """with n as (select count(*) as n from documents),
places as (select unnest(range(n)) as place, n from n)
select e::int as epoch, place // 64 as batch, count(*) as n_rows, count(*) as n_documents, min(place) as first_place, max(place) as last_place
from places, (values (0), (1)) epochs(e) group by all"""

ORACLES["curate_date_cap"] = f"""with {CURATED}
select row_key, date from curated order by date nulls last, row_key limit {C.TEST_ROWS}"""

ORACLES["curate_split_positional"] = f"with {SPLIT} select row_key, date, split, small from labelled"

ORACLES["split_orders_by_date"] = f"""with dated as (
  select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as order_date from orders),
{split_cte('dated', 'order_date, md5(o_orderkey::varchar)')}
select o_orderkey, order_date, split, small from labelled"""

STATS = f"""{CURATED}, stats as (select count(*) as n_articles, avg(article_word_count) as avg_article_words,
  avg(summary_word_count) as avg_summary_words, count(distinct category) as n_categories from curated)"""

ORACLES["curate_corpus_stats"] = f"""with {STATS}
select n_articles, avg_article_words, avg_summary_words, avg_article_words / avg_summary_words as compression_ratio,
  n_categories from stats"""

ORACLES["curate_target_check"] = f"""with {STATS}, rows as (
  select 'n_articles' as metric, n_articles::double as actual, 317498.0::double as target, 0.0::double as tolerance from stats
  union all select 'avg_article_words', avg_article_words, 334.21, 10.0 from stats
  union all select 'avg_summary_words', avg_summary_words, 95.45, 5.0 from stats
  union all select 'compression_ratio', avg_article_words / avg_summary_words, 3.5, 0.2 from stats)
select *, case when tolerance = 0 then actual = target else abs(actual - target) < tolerance end as matches from rows"""

ORACLES["sample_seeded"] = f"""select o_orderkey, o_custkey from orders
order by md5('{C.SAMPLE_SEED}:' || o_orderkey) limit {C.TRAIN_SAMPLE_ROWS}"""

ORACLES["epoch_shuffle_key"] = f"""select doc_id, md5('{C.SAMPLE_SEED}:' || e || ':' || doc_id) as order_key, e::int as epoch
from documents, (values (0), (1)) t(e)"""

# --- text ------------------------------------------------------------------

ORACLES["word_counts"] = f"select doc_id, len({words('text')})::int as n_words from documents"

ORACLES["truncate_preview"] = """select doc_id, substring(text, 1, 200) || '...' as preview,
  md5(substring(text, 1, 3000)) as article_cut_md5, md5(substring(text, 1, 2000)) as source_cut_md5,
  md5(substring(text, 1, 1000)) as summary_cut_md5 from documents"""

ORACLES["slug_names"] = """select p_partkey,
  replace(replace(lower(p_type || '/' || replace(p_name, ' ', '-')), '/', '_'), '-', '_') as slug from part"""

MODELS_CTE = f"models(model_name, model_id) as (values {values(C.MODELS.items())})"

ORACLES["model_flags"] = f"""with {MODELS_CTE}
select doc_id, model_name, lower(model_id) like '%led%' as long_context,
  (length(text) + case when lower(model_id) like '%t5%' then 11 else 0 end)::int as n_prompt_chars
from documents, models"""

ORACLES["dates_posthoc"] = f"with {NOTED} select doc_id, {listed(date_lists('text'))} as dates from noted"
ORACLES["dates_training"] = f"with {NOTED} select doc_id, {listed(date_lists('text', year='word'))} as dates from noted"
ORACLES["dates_full"] = f"with {NOTED} select doc_id, {listed(date_lists('text', full=True))} as dates from noted"

ORACLES["vocab_terms_substring"] = f"""with {VOCAB_CTE}
select doc_id, coalesce(string_agg(term, '|' order by term), '') as terms
from documents left join (select distinct term from vocab) v on contains(lower(text), term) group by doc_id"""

ORACLES["vocab_terms_word"] = f"""with {VOCAB_CTE}
select doc_id, coalesce(string_agg(term, '|' order by term), '') as terms
from documents left join (select distinct term from vocab) v
  on contains(lower(text), term)
  and regexp_matches(lower(text), '(^|{NOT_WORD})' || regexp_escape(term) || '($|{NOT_WORD})')
group by doc_id"""

ORACLES["vocab_by_category"] = f"""with {VOCAB_CTE}, hits as (
  select category, term, count(doc_id) as n from vocab left join documents on contains(lower(text), term)
  group by category, term)
select category, count(*) as n_terms, count(*) filter (n > 0) as n_terms_found, sum(n)::bigint as n_mentions
from hits group by category"""


def gazetteer_list(text: str, kind: str) -> str:
    ordered = sorted({t.lower() for t in GAZETTEER[kind]}, key=lambda t: (-len(t), t))
    alternatives = "|".join(t.replace(" ", "  ") for t in ordered)
    found = f"regexp_extract_all({doubled(text)}, '(?i){NOT_WORD}({alternatives}){NOT_WORD}', 1)"
    return f"list_transform({found}, lambda m: {{'type': '{kind}', 'text': replace(m, '  ', ' ')}})"


def mentions(text: str) -> str:
    dates = date_lists(text, year="word", full=True)
    parts = [gazetteer_list(text, kind) for kind in GAZETTEER]
    parts.append(f"list_transform({dates}, lambda m: {{'type': 'DATE', 'text': m}})")
    return f"list_concat({', '.join(parts)})"


ORACLES["entity_mentions"] = f"""with {NOTED} select doc_id, m.type as type, m.text as mention, count(*) as n
from (select doc_id, unnest({mentions('text')}) as m from noted) group by all"""

def report(key: str) -> str:
    """The same sentences as the view's."""

    def pick(values, step: int) -> str:
        return picked(values, f"{key} + {step}")

    titles, admin = C.VOCABULARY["titles"], C.VOCABULARY["admin"]
    return f"""('Yesterday ' || {pick(titles, 0)} || ' ' || {pick(GIVEN_NAMES, 0)} || ' ' || {pick(FAMILY_NAMES, 1)} || ' met the '
  || {pick(C.VOCABULARY["political"], 2)} || ' near ' || {pick(PLACES, 0)} || ' ' || {pick(admin, 1)} || '. '
  || {pick(admin, 3)} || ' ' || {pick(PLACES, 4)} || ' told a ' || {pick(titles, 5)} || ' and ' || lower({pick(titles, 7)})
  || ' ' || {pick(GIVEN_NAMES, 3)} || '.')"""


def longest_first(terms) -> str:
    return "|".join(sorted((t.lower() for t in terms), key=lambda t: (-len(t), t)))


_CAPITALISED = "[A-Z][A-Za-z]*"
_TITLES, _PLACE_WORDS = (f"(?i:{longest_first(C.VOCABULARY[k])})" for k in ("titles", "admin"))
PERSONS = f"regexp_extract_all(text, '{NOT_WORD}({_TITLES}(?:[ \\t]+{_CAPITALISED})+)', 1)"
PLACE_NAMES = (
    f"regexp_extract_all(text, '{NOT_WORD}((?:{_CAPITALISED}[ \\t]+)+{_PLACE_WORDS}|{_PLACE_WORDS}(?:[ \\t]+{_CAPITALISED})+){NOT_WORD}', 1)"
)
ORACLES["entity_names"] = f"""with reported as (select doc_id, concat_ws(' ', text, {report(K)}) as text from documents), found as (
  select doc_id, 'PERSON' as type, unnest({PERSONS}) as mention from reported
  union all select doc_id, 'GPE', unnest({PLACE_NAMES}) from reported
  union all select doc_id, 'ORG', m.text from (select doc_id, unnest({gazetteer_list('text', 'ORG')}) as m from reported))
select doc_id, type, mention, count(*) as n from found group by all"""

ORACLES["rouge_token_counts"] = f"""select doc_id, len({tokens('text')})::int as n_tokens,
  md5(coalesce(array_to_string({tokens('text')}, ' '), '')) as tokens_md5 from documents"""

# --- factuality ------------------------------------------------------------

ORACLES["temporal_consistency"] = f"""with {PAIRS}, found as (
  select doc_id, system, {date_lists('candidate')} as s, {date_lists('source')} as r from pairs)
select doc_id, system, case when len(s) = 0 then 1.0::double else len(list_intersect(s, r))::double / len(s) end as temporal
from found"""

ORACLES["hallucinated_dates"] = f"""with {PAIRS}, found as (
  select doc_id, system, {date_lists('candidate', year='word')} as s, {date_lists('source', year='word')} as r from pairs)
select doc_id, system,
  case when len(s) = 0 then 0.0::double else len(list_filter(s, lambda d: not list_contains(r, d)))::double / len(s) end as temporal_loss
from found"""

LOSS = f"""{PAIRS}, found as (select doc_id, system, n, {terms('candidate')} as s, {terms('source')} as r,
  {date_lists('candidate', year='word')} as sd, {date_lists('source', year='word')} as rd from pairs),
loss as (select doc_id, system, n,
  1.0::double - case when len(r) = 0 then 1.0::double else len(list_intersect(r, s))::double / len(r) end as entity,
  case when len(sd) = 0 then 0.0::double else len(list_filter(sd, lambda d: not list_contains(rd, d)))::double / len(sd) end as temporal
  from found)"""

ORACLES["vocab_preservation"] = f"""with {LOSS}
select doc_id, system, entity as entity_loss, 1 - entity as preservation from loss"""

ENTITY = f"""{PAIRS}, found as (select doc_id, system, {mentions('candidate')} as s, {mentions('source')} as r,
  {date_lists('candidate')} as sd, {date_lists('source')} as rd from pairs),
credit as (select doc_id, system, sd, rd, list_transform(s, lambda m:
  case when list_contains(r, m) then 1.0
    when len(list_filter(r, lambda x: x.type = m.type and contains(lower(x.text), lower(m.text)))) > 0 then 0.5
    else 0.0 end::double) as c from found),
scored as (select doc_id, system,
  case when len(c) = 0 then 1.0::double else least(list_sum(c) / len(c), 1.0) end as entity,
  case when len(sd) = 0 then 1.0::double else len(list_intersect(sd, rd))::double / len(sd) end as temporal from credit)"""

ORACLES["entity_consistency"] = f"with {ENTITY} select doc_id, system, round(entity, 9) as entity from scored"

ORACLES["semantic_cosine"] = f"""with {SIMILARITY}
select vec_id, round(similarity, 6) as similarity, round(coalesce(1 - similarity, 0), 6) as semantic_loss from alike"""

ORACLES["semantic_flag"] = f"""with {SIMILARITY}
select similarity >= 0.5 as agrees, count(*) as n_pairs from alike group by 1"""

for name, places in (("factuality_overall", 6), ("factuality_shown", 3)):
    ORACLES[name] = f"""with {ENTITY}, {ALIKE}
select doc_id, system, round(entity, {places}) as entity, round(temporal, {places}) as temporal,
  round(similarity, {places}) as semantic,
  round(0.4::double * entity + 0.3::double * temporal + 0.3::double * similarity, {places}) as overall
from scored left join alike using (doc_id, system)"""

LOSS_ROWS = f"""{LOSS}, {ALIKE}, parts as (
  select doc_id, system, case when n > 0 then ((2 * n + 4) // 5)::double / n else 0.0::double end as ce, entity, temporal,
    1 - similarity as semantic from loss left join alike using (doc_id, system))"""

STAGES = ", ".join(
    f"({quoted(s)}, " + ", ".join(f"{w[c]}::double" for c in ("ce", "entity", "temporal", "semantic")) + ")"
    for s, w in C.STAGE_WEIGHTS.items()
)

ORACLES["stage_weighted_loss"] = f"""with {LOSS_ROWS}, stages(stage, a, b, c, d) as (values {STAGES})
select doc_id, system, stage, round(a * ce + b * entity + c * temporal + d * coalesce(semantic, 0.0::double), 6) as total from parts, stages"""

ORACLES["system_factuality"] = f"""with {LOSS}, t as (
  select doc_id, system, case when len(s) = 0 then 1.0::double else len(list_intersect(s, r))::double / len(s) end as temporal
  from (select doc_id, system, {date_lists('candidate')} as s, {date_lists('source')} as r from pairs))
select system, count(*) as n_pairs, round(avg(t.temporal), 6) as temporal, round(avg(1 - loss.temporal), 6) as date_truth,
  round(avg(1 - entity), 6) as preservation
from loss join t using (doc_id, system) group by system"""

ORACLES["semantic_coverage"] = f"""with {LOSS_ROWS}
select system, count(*) as n_pairs, count(semantic) as n_compared, round(avg(semantic), 6) as semantic_loss from parts group by system"""

ORACLES["system_delta"] = f"""with {LOSS_ROWS}, m as (
  select 'entity_preservation' as metric, system, avg(1 - entity) * 100 as v from parts group by system
  union all select 'temporal_consistency', system, avg(1 - temporal) * 100 from parts group by system
  union all select 'semantic_fidelity', system, avg(1 - semantic) * 100 from parts group by system)
select b.metric, round(b.v, 6) as baseline, round(p.v, 6) as proposed, round(p.v - b.v, 6) as points
from m b join m p using (metric) where b.system = 'tail' and p.system = 'lead'"""

# --- ROUGE and reports -----------------------------------------------------


def bigrams(array: str) -> str:
    return f"list_transform(range(1, len({array})), lambda i: {array}[i] || ' ' || {array}[i + 1])"


def rouge_cte(name: str, keys: str, source: str, grams) -> str:
    """F-measure per pair from counted n-grams of ``source``'s reference and candidate."""
    return f"""{name}_t as (select {keys}, {tokens('reference')} as rt, {tokens('candidate')} as ct from {source}),
{name}_r as (select {keys}, g, count(*) as n from (select {keys}, unnest({grams('rt')}) as g from {name}_t) group by all),
{name}_c as (select {keys}, g, count(*) as n from (select {keys}, unnest({grams('ct')}) as g from {name}_t) group by all),
{name}_o as (select {keys}, sum(least(r.n, c.n))::double as o from {name}_r r join {name}_c c using ({keys}, g) group by {keys}),
{name}_p as (select {keys}, coalesce(o, 0) / greatest(len({grams('ct')}), 1) as p,
  coalesce(o, 0) / greatest(len({grams('rt')}), 1) as r from {name}_t left join {name}_o using ({keys})),
{name} as (select {keys}, case when p + r > 0 then 2 * p * r / (p + r) else 0.0::double end as {name} from {name}_p)"""


def same(array: str) -> str:
    return array


GOOD = "good as (select * from pairs where error is null)"
ROUGE1 = f'{GOOD}, {rouge_cte("rouge1", "doc_id, system", "good", same)}'
ROUGE2 = rouge_cte("rouge2", "doc_id, system", "good", bigrams)



WORD_BITS = 62
ONES = (1 << WORD_BITS) - 1


def lcs_cte(name: str, keys: str, source: str) -> str:
    """F-measure from the longest common subsequence of tokens, by Hyyro's recurrence on bits.

    A candidate is a row of bits, 62 to a number; each token of the reference, in order, has the bits of its
    places in the candidate.  Bits that end as zero are the subsequence.
    """
    total = "(x[1] + (x[1] & x[2]) + done[1])"
    step = f"""list_reduce(list_transform(range(1, len(v) + 1), lambda b: [v[b], m[b]]),
    lambda done, x: list_concat([{total} >> {WORD_BITS}], done[2:], [({total} & {ONES}) | (x[1] & ~x[2])]), [0::bigint])[2:]"""
    return f"""{name}_t as (select {keys}, {tokens('reference')} as rt, {tokens('candidate')} as ct from {source}),
{name}_r as (select {keys}, unnest(rt) as g, unnest(range(1, len(rt) + 1)) as i from {name}_t),
{name}_b as (select {keys}, len(ct) as size, unnest(ct) as g, unnest(range(len(ct))) as j from {name}_t),
{name}_w as (select {keys}, size, g, j // {WORD_BITS} as b, sum(1::bigint << (j % {WORD_BITS})::int)::bigint as bits
  from {name}_b group by all),
{name}_g as (select {keys}, g, map_from_entries(list({{'k': b, 'v': bits}})) as found, max(size) as size from {name}_w group by {keys}, g),
{name}_c as (select {keys}, g, list_transform(range((size - 1) // {WORD_BITS} + 1), lambda k: coalesce(found[k], 0)::bigint) as mask
  from {name}_g),
{name}_m as (select {keys}, list(mask order by i) as masks from {name}_r join {name}_c using ({keys}, g) group by {keys}),
{name}_v as (select {keys}, list_reduce(masks, lambda v, m: {step},
  list_transform(masks[1], lambda k: {ONES}::bigint)) as v from {name}_m),
{name}_l as (select {keys}, list_sum(list_transform(v, lambda k: bit_count({ONES} & ~k)))::bigint as o from {name}_v),
{name}_p as (select {keys}, coalesce(o, 0)::double / greatest(len(ct), 1) as p, coalesce(o, 0)::double / greatest(len(rt), 1) as r
  from {name}_t left join {name}_l using ({keys})),
{name} as (select {keys}, case when p + r > 0 then 2 * p * r / (p + r) else 0.0::double end as {name} from {name}_p)"""


def stems_cte(texts: str) -> str:
    """``stems(g, stem)``: the stemmer's steps over the distinct tokens of the lists ``texts`` selects as ``w``.

    ``k`` has a V for each vowel and a c for each consonant of ``w``.
    """

    def kinds(w: str) -> str:
        x = f"regexp_replace(regexp_replace({w}, '[aeiou]', 'V', 'g'), '[^Vy]', 'c', 'g')"
        x = f"regexp_replace({x}, '^y', 'c')"
        for _ in range(3):
            x = f"regexp_replace(regexp_replace({x}, 'Vy', 'Vc', 'g'), 'cy', 'cV', 'g')"
        return x

    def cut(n: int, of: str = "w") -> str:
        return f"left({of}, length(w) - {n})"

    def measure(k: str) -> str:
        return f"((length({k}) - length(replace({k}, 'Vc', ''))) // 2)"

    def ends(end: str) -> str:
        return f"ends_with(w, '{end}')"

    def short(w: str, k: str) -> str:
        return f"(case when length({w}) = 2 then {k} = 'Vc' else length({w}) > 2 and right({k}, 3) = 'cVc' and right({w}, 1) not in ('w', 'x', 'y') end)"

    def mended(n: int) -> str:
        w, k = cut(n), cut(n, "k")
        return f"""case when regexp_matches({w}, '(at|bl|iz)$') then {w} || 'e'
    when length({w}) > 1 and right({w}, 1) = left(right({w}, 2), 1) and right({k}, 1) = 'c'
      then case when right({w}, 1) in ('l', 's', 'z') then {w} else {cut(n + 1)} end
    when {measure(k)} = 1 and {short(w, k)} then {w} || 'e' else {w} end"""

    def swapped(pairs) -> str:
        rules = [
            f"when {ends(end)} then case when {measure(cut(len(end), 'k'))} > 0 then {cut(len(end))} || '{new}' else w end"
            for end, new in pairs
        ]
        return " ".join(rules)

    def dropped(end: str) -> str:
        extra = f" and regexp_matches({cut(3)}, '[st]$')" if end == "ion" else ""
        return f"when {ends(end)} then case when {measure(cut(len(end), 'k'))} > 1{extra} then {cut(len(end))} else w end"

    steps = [
        f"case when {ends('sses')} then {cut(2)} when {ends('ies')} then case when length(w) = 4 then {cut(1)} else {cut(2)} end "
        f"when {ends('s')} and not {ends('ss')} then {cut(1)} else w end",
        f"case when {ends('ied')} then case when length(w) = 4 then {cut(1)} else {cut(2)} end "
        f"when {ends('eed')} then case when {measure(cut(3, 'k'))} > 0 then {cut(1)} else w end "
        f"when {ends('ed')} and contains({cut(2, 'k')}, 'V') then {mended(2)} "
        f"when {ends('ing')} and contains({cut(3, 'k')}, 'V') then {mended(3)} else w end",
        f"case when {ends('y')} and length(w) > 2 and left(right(k, 2), 1) = 'c' then {cut(1)} || 'i' else w end",
        f"case when {ends('alli')} and {measure(cut(4, 'k'))} > 0 then {cut(2)} else w end",
        f"case when {ends('logi')} then case when {measure(cut(3, 'k'))} > 0 then {cut(1)} else w end {swapped(STEP2)} else w end",
        f"case {swapped(STEP3)} else w end",
        f"case {' '.join(dropped(end) for end in sorted(STEP4, key=len, reverse=True))} else w end",
        f"case when {ends('e')} and ({measure(cut(1, 'k'))} > 1 or ({measure(cut(1, 'k'))} = 1 and not {short(cut(1), cut(1, 'k'))})) "
        f"then {cut(1)} else w end",
        f"case when {ends('ll')} and {measure(cut(1, 'k'))} > 1 then {cut(1)} else w end",
    ]
    irregular = " ".join(f"when {quoted(a)} then {quoted(b)}" for a, b in IRREGULAR.items())
    out = [f"stem0 as (select distinct g, g as w from (select unnest(w) as g from ({texts})) where length(g) > 3)"]
    for i, step in enumerate(steps):
        # a step's marks are a column, so that its rules do not spell them out again and again
        out.append(f"stem{i + 1} as (select g, {step} as w from (select g, w, {kinds('w')} as k from stem{i}))")
    out.append(f"stems as (select g, case g {irregular} else w end as stem from stem{len(steps)})")
    return ", ".join(out)


def stemmed_cte(keys: str, source: str, extra: str = "") -> str:
    """``stemmed``: the rows of ``source`` with stems for the words of reference and candidate."""

    def side(name: str) -> str:
        return f"""{name}_s as (select {keys}, string_agg(coalesce(stem, g), ' ' order by i) as {name} from (
  select {keys}, unnest(t) as g, unnest(range(len(t))) as i from (select {keys}, {tokens(name)} as t from {source}))
  left join stems using (g) group by {keys})"""

    both = f"select {tokens('reference')} as w from {source} union all select {tokens('candidate')} from {source}"
    return f"""{stems_cte(both)}, {side('reference')}, {side('candidate')},
stemmed as (select {keys}{extra}, coalesce(r.reference, '') as reference, coalesce(c.candidate, '') as candidate
  from {source} left join reference_s r using ({keys}) left join candidate_s c using ({keys}))"""


ORACLES["rouge_stemmed"] = f"""with {PAIRS}, {GOOD}, {stemmed_cte("doc_id, system", "good")},
{rouge_cte("rouge1", "doc_id, system", "stemmed", same)}, {rouge_cte("rouge2", "doc_id, system", "stemmed", bigrams)},
{lcs_cte("rougel", "doc_id, system", "stemmed")}
select doc_id, system, round(rouge1, 9) as rouge1, round(rouge2, 9) as rouge2, round(rougel, 9) as "rougeL"
from pairs left join rouge1 using (doc_id, system) left join rouge2 using (doc_id, system) left join rougel using (doc_id, system)"""
ORACLES["rougeL"] = f"""with {PAIRS}, {GOOD}, {lcs_cte("rougel", "doc_id, system", "good")}
select doc_id, system, round(rougel, 9) as "rougeL" from pairs left join rougel using (doc_id, system)"""
ORACLES["rouge1"] = f"""with {PAIRS}, {ROUGE1}
select doc_id, system, round(rouge1, 9) as rouge1 from pairs left join rouge1 using (doc_id, system)"""
ORACLES["rouge2"] = f"""with {PAIRS}, {GOOD}, {ROUGE2}
select doc_id, system, round(rouge2, 9) as rouge2 from pairs left join rouge2 using (doc_id, system)"""

SCORED = f"""{PAIRS}, {ROUGE1}, {ROUGE2}, scored as (
  select p.doc_id, p.lang, p.system, p.n, p.error, rouge1, rouge2 from pairs p left join rouge1 using (doc_id, system)
  left join rouge2 using (doc_id, system))"""

MEANS = """avg(rouge1) * 100 as rouge1_mean, stddev_pop(rouge1) * 100 as rouge1_std,
  avg(rouge2) * 100 as rouge2_mean, stddev_pop(rouge2) * 100 as rouge2_std"""

ORACLES["system_scores"] = f"""with {SCORED}, m as (select system, {MEANS} from scored group by system)
select system, round(rouge1_mean, 6) as rouge1_mean, round(rouge1_std, 6) as rouge1_std,
  round(rouge2_mean, 6) as rouge2_mean, round(rouge2_std, 6) as rouge2_std from m"""

BOARD = f"""{SCORED}, board as (
  select row_number() over (order by rouge2_mean desc, model_name) as rank, * from (
    select system as model_name, {MEANS}, count(*) as total_samples,
      count(*) filter (error is null) as successful_samples, count(*) filter (error is not null) as failed_samples,
      count(*) filter (error is null)::double / count(*) * 100 as success_rate,
      round(sum(n)::double / 3600, 2) as time_hours
    from scored group by system))"""

BOARD_SELECT = """rank::int as rank, model_name, round(rouge1_mean, 6) as rouge1_mean, round(rouge2_mean, 6) as rouge2_mean,
  round(rouge1_std, 6) as rouge1_std, round(rouge2_std, 6) as rouge2_std, total_samples, successful_samples,
  failed_samples, round(success_rate, 6) as success_rate, round(time_hours, 6) as time_hours"""

ORACLES["leaderboard"] = f"""with {BOARD} select {BOARD_SELECT},
  case rank when 1 then 'GOLD' when 2 then 'SILVER' when 3 then 'BRONZE' else '' end as tier,
  contains(model_name, 'middle') as selected from board"""

ORACLES["leaderboard_stats"] = f"""with {BOARD}
select count(*) as n_models, count(*) filter (success_rate = 100) as n_full_success,
  sum(successful_samples)::bigint as n_successful, sum(failed_samples)::bigint as n_failed,
  round(avg(rouge2_mean), 6) as avg_rouge2, round(sum(time_hours), 6) as total_hours from board"""

ORACLES["best_system"] = f"""with {BOARD}
select model_name, round(rouge1_mean, 6) as rouge1_mean, round(rouge2_mean, 6) as rouge2_mean,
  round(rouge2_std, 6) as rouge2_std from board where rank = 1"""

ORACLES["named_system"] = f"""with {BOARD}
select rank::int as rank, model_name, round(rouge2_mean, 6) as rouge2_mean, round(success_rate, 6) as success_rate
from board where contains(model_name, 'mid')"""

ORACLES["write_leaderboard"] = f"""with {BOARD}
select f as file, rank::int as rank, model_name, round(rouge2_mean, 6) as rouge2_mean
from board, (values ('csv'), ('json'), ('short_csv')) t(f)"""

ORACLES["domain_shift_drop"] = f"""with {SCORED}, m as (
  select lang = 'en' as home, system, avg(rouge2) as rouge2 from scored group by all)
select a.system, round(a.rouge2, 6) as ours, round(b.rouge2, 6) as published,
  round((a.rouge2 - b.rouge2) / b.rouge2 * 100, 6) as change_percent
from m a join m b using (system) where not a.home and b.home"""

# --- model inputs ----------------------------------------------------------

ORACLES["multidoc_concat"] = f"""with r as (
  select *, row_number() over (partition by source order by doc_id) as p from documents)
select source, count(text)::int as n_documents,
  'summarize: ' || string_agg(text, E'\\n\\n[DOCUMENT]\\n\\n' order by p) as document
from r where p <= {C.MAX_DOCUMENTS_PER_EVENT} group by source"""

VOCABULARY = f"""top as (select token, count(*) as n from (select unnest({words('lower(text)')}) as token from documents)
  group by token order by n desc, token limit 5000),
vocabulary as (select *, (3 + row_number() over (order by n desc, token))::int as token_id from top)"""

ORACLES["vocab_build"] = f"with {VOCABULARY} select token, n, token_id from vocabulary"

LEAD = f"""(select doc_id, text, {words('text')} as w from documents)"""
LEAD_SQL = joined("w[1:least(greatest(len(w) // 3, 40), 150)]")

ORACLES["lead_k_summaries"] = f"select doc_id, coalesce({LEAD_SQL}, '') as summary from {LEAD}"


def encoded(name: str, text: str, limit: int, pad: str) -> str:
    """Ids of the first ``limit`` words, padded; ``ids`` and the number kept."""
    return f"""{name}_w as (select doc_id, list_slice({words(f'lower({text})')}, 1, {limit}) as w from texts),
{name}_i as (select doc_id, p, coalesce(token_id, 3) as id
  from (select doc_id, unnest(w) as token, unnest(range(1, len(w) + 1)) as p from {name}_w) left join vocabulary using (token)),
{name}_l as (select doc_id, list(id order by p) as ids from {name}_i group by doc_id),
{name} as (select w.doc_id, len(w.w) as kept,
  list_concat(coalesce(ids, []::int[]), list_transform(range({limit} - len(w.w)), lambda x: {pad}::int)) as ids
  from {name}_w w left join {name}_l using (doc_id))"""


ORACLES["encode_pad_mask"] = f"""with {VOCABULARY},
texts as (select doc_id, substring(text, 1, 3000) as article, coalesce({LEAD_SQL}, '') as summary from {LEAD}),
{encoded('inputs', 'article', 1024, '1')}, {encoded('targets', 'summary', 128, '-100')}
select doc_id, array_to_string(i.ids, ' ') as input_ids,
  array_to_string(list_transform(range(1024), lambda x: case when x < i.kept then 1 else 0 end), ' ') as attention_mask,
  array_to_string(t.ids, ' ') as labels
from inputs i join targets t using (doc_id)"""

ORACLES["encode_staged"] = f"""with {VOCABULARY},
texts as (select doc_id, text as article, coalesce({LEAD_SQL}, '') as summary from {LEAD}),
{encoded('inputs', 'article', 1024, '1')}, {encoded('targets', 'summary', 256, '1')}
select doc_id, md5(article) as source_md5, list_sum(i.ids)::bigint as input_sum, i.kept::bigint as n_attended,
  list_sum(t.ids)::bigint as label_sum, 256::int as n_labels
from inputs i join targets t using (doc_id) join texts using (doc_id)"""

# the ids themselves have no twin; what they spell must be the text, and tests hold them against another encoder
ORACLES["encode_subword_ids"] = "select doc_id, md5(text) as spelled_md5 from documents"

ORACLES["encode_joined_ids"] = f"""with {VOCABULARY}, placed as (
  select doc_id, unnest(w) as token, unnest(range(len(w))) as p from (select doc_id, {words('lower(text)')} as w from documents)),
ids as (select doc_id, string_agg(coalesce(token_id, 3)::varchar, ' ' order by p) as ids
  from placed left join vocabulary using (token) group by doc_id)
select doc_id, case when text is not null then md5(coalesce(ids, '')) end as ids_md5 from documents left join ids using (doc_id)"""

LENGTHS = f"""{MODELS_CTE}, l as (select doc_id, model_name, lower(model_id) like '%led%' as led,
  least(len({words('text')}), case when lower(model_id) like '%led%' then 16384 else 1024 end) as input_length
  from documents, models),
lengths as (select doc_id, model_name, input_length, case when not led then input_length
  when input_length <= 512 then 512 else (input_length // 512 + 1) * 512 end as padded_length from l)"""

ORACLES["input_lengths"] = f"""with {LENGTHS}
select doc_id, model_name, input_length::bigint as input_length, padded_length::bigint as padded_length from lengths"""

ORACLES["padding_overhead"] = f"""with {LENGTHS}, m as (
  select model_name, avg(input_length) as a, avg(padded_length) as b from lengths group by model_name)
select model_name, round(a, 6) as avg_input_length, round(b, 6) as avg_padded_length,
  round(case when a > 0 then (b - a) / a * 100 else 0 end, 6) as padding_overhead_percent from m"""

ORACLES["batch_padding"] = f"""with {LENGTHS}, plain as (
  select model_name, sum(input_length)::bigint as tokens, (max(input_length) * count(*))::bigint as padded
  from lengths group by model_name, doc_id // 32),
in_order as (select model_name, sum(tokens)::bigint as tokens, sum(padded)::bigint as padded_in_order, count(*) as batches_in_order
  from plain group by model_name),
rooms as (select model_name, greatest(ceil(input_length / 64.0), 1)::bigint * 64 as room, count(*) as n from lengths group by all),
alike as (select model_name, sum(n * room)::bigint as padded_by_length,
  sum(ceil(n / greatest(32768 // room, 1)::double))::bigint as batches_by_length from rooms group by model_name)
select *, round((padded_in_order::double / tokens - 1) * 100, 6) as overhead_in_order,
  round((padded_by_length::double / tokens - 1) * 100, 6) as overhead_by_length
from in_order join alike using (model_name)"""

# --- evaluation runs -------------------------------------------------------

FINISHED = """finished as (select doc_id, 'LED-ArXiv' as model_name from labels
  union all select doc_id, 'BART-Base' from labels where quality = 1
  union all select doc_id, 'T5-Base' from labels where toxic = 1)"""

ORACLES["eval_grid_pending"] = f"""with {MODELS_CTE}, {FINISHED}
select model_name, doc_id from documents, models
where not exists (select 1 from finished f where f.doc_id = documents.doc_id and f.model_name = models.model_name)"""

ORACLES["eval_merge_results"] = f"""with {MODELS_CTE}, {FINISHED}
select model_name, 'earlier' as origin, count(*) as n_rows from finished group by all
union all
select model_name, 'new', count(*) from documents, models
where not exists (select 1 from finished f where f.doc_id = documents.doc_id and f.model_name = models.model_name)
group by all"""

SAMPLES = f"""samples as (select doc_id as sample_id, lang, text as article,
  case when length(text) % 50 <> 0 then {joined('w[greatest(len(w) - 6, 1):len(w)]')} end as summary
  from (select *, {words('text')} as w from documents))"""
STATUS = """case when coalesce(length(article), 0) = 0 then 'empty article'
  when coalesce(length(summary), 0) = 0 then 'empty reference' end"""

SUCCESS = """count(*) as total_samples, count(*) filter (error is null) as successful_samples,
  count(*) filter (error is not null) as failed_samples,
  round(count(*) filter (error is null)::double / count(*) * 100, 6) as success_rate"""

ORACLES["eval_success_rates"] = f"""with {MODELS_CTE}, {SAMPLES}, s as (select {STATUS} as error from samples)
select model_name, {SUCCESS} from s, models group by model_name"""

ORACLES["missing_models"] = f"""with {MODELS_CTE}, {FINISHED}
select model_name, model_id from models where model_name not in (select model_name from finished)"""

ORACLES["eval_generate"] = f"""with {SAMPLES}, s as (select *, {STATUS} as problem, {words('article')} as w from samples),
g as (select *, coalesce(problem, case when sample_id % 10 = 3 then 'model not loaded: LookupError: unknown'
  when len(w) < 30 then 'ValueError: text too short' end) as error from s)
select sample_id, case when error is null then 'ok' else 'failed' end as status, error,
  case when error is null then md5({joined('w[1:30]')}) end as summary_md5 from g"""

PROMPTED = f"""{MODELS_CTE}, {SAMPLES}, prompted as (
  select m.model_name, m.model_id, sample_id, lang, {STATUS} as error, summary as reference,
    {words("case when lower(m.model_id) like '%t5%' then 'summarize: ' || article else article end")} as w
  from samples, models m),
good as (select model_name, sample_id, reference, {LEAD_SQL} as candidate from prompted where error is null)"""

RUN = f"""{PROMPTED},
{rouge_cte('rouge1', 'model_name, sample_id', 'good', same)},
{rouge_cte('rouge2', 'model_name, sample_id', 'good', bigrams)}, {lcs_cte('rougel', 'model_name, sample_id', 'good')}"""

ORACLES["eval_resume"] = f"""with {RUN}, j as (
  select p.model_name, p.error, rouge1, rouge2, rougel from prompted p left join rouge1 using (model_name, sample_id)
  left join rouge2 using (model_name, sample_id) left join rougel using (model_name, sample_id))
select model_name, {SUCCESS}, round(avg(rouge1) * 100, 6) as rouge1_mean, round(stddev_pop(rouge1) * 100, 6) as rouge1_std,
  round(avg(rouge2) * 100, 6) as rouge2_mean, round(stddev_pop(rouge2) * 100, 6) as rouge2_std,
  round(avg(rougel) * 100, 6) as "rougeL_mean", round(stddev_pop(rougel) * 100, 6) as "rougeL_std",
  count(*) as n_stored, 2::bigint as n_runs from j group by model_name"""

RUN_KEYS = "model_name, sample_id"
LIMIT = "case when lower(model_id) like '%led%' then 16384 else 1024 end"

ORACLES["eval_published"] = ORACLES["eval_resume"]

ORACLES["eval_stemmed"] = f"""with {PROMPTED}, {stemmed_cte(RUN_KEYS, "good")},
{rouge_cte("rouge1", RUN_KEYS, "stemmed", same)}, {rouge_cte("rouge2", RUN_KEYS, "stemmed", bigrams)},
{lcs_cte("rougel", RUN_KEYS, "stemmed")}, j as (
  select p.model_name, p.model_id, p.error, rouge1, rouge2, rougel, least(len(w), {LIMIT}) as size,
    case when lower(model_id) not like '%led%' then size when size <= 512 then 512 else (size // 512 + 1) * 512 end as padded
  from prompted p left join rouge1 using ({RUN_KEYS}) left join rouge2 using ({RUN_KEYS}) left join rougel using ({RUN_KEYS})),
m as (select model_name, model_id, count(*) as total_samples, count(*) filter (error is null) as successful_samples,
  count(*) filter (error is not null) as failed_samples, avg(size) filter (error is null) as a, avg(padded) filter (error is null) as b,
  round(avg(rouge1) * 100, 2) as rouge1_mean, round(stddev_pop(rouge1) * 100, 2) as rouge1_std,
  round(avg(rouge2) * 100, 2) as rouge2_mean, round(stddev_pop(rouge2) * 100, 2) as rouge2_std,
  round(avg(rougel) * 100, 2) as "rougeL_mean", round(stddev_pop(rougel) * 100, 2) as "rougeL_std" from j group by all)
select * exclude (a, b), round(successful_samples::double / total_samples * 100, 2) as success_rate,
  null::double as evaluation_time_seconds, null::double as time_per_sample, round(a, 0) as avg_input_length,
  round(b, 0) as avg_padded_length, round((b - a) / a * 100, 1) as padding_overhead_percent from m"""

ORACLES["eval_events"] = f"""with {SAMPLES}, r as (
  select *, lang || '-' || (sample_id % 50) as event, row_number() over (partition by lang, sample_id % 50 order by sample_id) as p
  from samples),
joined as (select event as sample_id, string_agg(article, E'\\n\\n[DOCUMENT]\\n\\n' order by p) filter (p <= 5) as article,
  min(summary) filter (p = 1) as summary from r group by event),
checked as (select *, {STATUS} as error, 'summarize: ' || article as prompted from joined),
made as (select *, {words('prompted')} as w from checked),
good as (select sample_id, summary as reference, {LEAD_SQL} as candidate from made where error is null),
{rouge_cte('rouge1', 'sample_id', 'good', same)}
select m.sample_id, case when error is null then 'ok' else 'failed' end as status,
  substring(prompted, 1, 200) || '...' as article_preview, least(len(w), 1024)::bigint as input_length,
  least(len(w), 1024)::bigint as padded_length, md5(g.candidate) as summary_md5, round(rouge1, 6) as rouge1
from made m left join good g using (sample_id) left join rouge1 using (sample_id)"""

ORACLES["eval_times"] = f"""with {SAMPLES}, s as (select {STATUS} as error, {words('article')} as w from samples)
select 'T5-Base' as model_name, false as timed, null::boolean as took_time, true as dated,
  count(*) filter (error is null) as successful_samples from s
union all select 'BART-Base', true, true, true, count(*) filter (error is null and len(w) >= 30) from s"""

ORACLES["eval_score_files"] = f"""with {RUN}
select model_name, 'found' as state, count(*) as total_samples, count(*) filter (error is null) as successful_samples,
  sum(least(len(w), case when lower(model_id) like '%led%' then 16384 else 1024 end)) filter (error is null)::double
    / count(*) filter (error is null) as avg_input_length
from prompted where model_name <> 'mT5-Base' group by model_name
union all
select 'mT5-Base', 'missing', null, null, null"""

ORACLES["eval_run_summary"] = f"""with {RUN}, c as (
  select model_name, count(*) filter (error is null) as n from prompted where model_name <> 'mT5-Base' group by model_name)
select 9::int as num_models_evaluated, 1::int as num_models_failed, (select count(*)::int from samples) as test_samples,
  (select string_agg(model_name || ':' || n, '|' order by model_name) from c) as results, 'mT5-Base' as failed_models"""

# --- loss logs and checkpoints ---------------------------------------------

LOG = """log as (select *, case when computed then 0.4 * ce + 0.2 * entity + 0.2 * temporal + 0.2 * semantic else ce end as total
from (select *, case when computed then (user_id % 10)::double / 10 else 0 end as entity,
    case when computed then (user_id % 4)::double / 4 else 0 end as temporal,
    case when computed then (event_id % 7)::double / 7 else 0 end as semantic
  from (select *, case when event_type = 'view' then 'warmup' else event_type end as stage, day(ts)::int as epoch,
    event_id as batch_idx, ends_with(event_id::varchar, '0') and event_type <> 'view' and user_id % 50 <> 0 as computed,
    value as ce from events)))"""


def epoch_means(part: str) -> str:
    columns = ["round(avg(ce), 6) as ce_mean"]
    columns += [f"round(avg({part.format(c=c)}), 6) as {c}_mean" for c in ("entity", "temporal", "semantic", "total")]
    return f"with {LOG} select stage, epoch, {', '.join(columns)} from log group by stage, epoch"


ORACLES["loss_epoch_means"] = epoch_means("{c}")
ORACLES["loss_epoch_means_computed"] = epoch_means("case when computed then {c} end")

ORACLES["loss_due_batches"] = f"""with {LOG}
select stage, count(*) filter (batch_idx % 10 = 0 and stage <> 'warmup') as n_due, count(*) as n_batches,
  count(*) filter ((batch_idx % 10 = 0 and stage <> 'warmup') <> computed) as n_disagree from log group by stage"""

ORACLES["loss_history"] = f"""with {LOG}
select stage, count(*) as n_batches, round(avg(total), 6) as total_mean from log group by stage"""

ORACLES["latest_checkpoint"] = """select user_id, 'run/checkpoint-' || max(event_id) as path, max(event_id) as step
from events group by user_id"""
