"""The queries that apply the training-data operators to whole tables, and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.llm import cotraining, lm_score, pii, quality_rules, resampling, spelling, toxicity
from ledgerfold.llm.common import id_bucket
from ledgerfold.llm.decontaminate import find_leaks
from ledgerfold.llm.html_extract import extract_main_text
from ledgerfold.llm.line_dedup import dedup_lines
from ledgerfold.llm.mixing import mix_sources
from ledgerfold.llm.quality_rules import judge_quality
from ledgerfold.llm.superminhash import near_duplicates
from ledgerfold.llm.url_filter import filter_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: host, path, verdict
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in URL_RULES)
    rules = spark.sql(f"select * from values {rows} as rules(host, path, verdict)")
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = r"""
with p as (
  select page_id,
    coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') path
  from pages),
r(rhost, rpath, verdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f as (
  select page_id, host, path, (select {'n': length(rhost || rpath), 'h': length(rhost), 'rule': rhost || rpath, 'verdict': verdict} from r
    where (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
    order by length(rhost || rpath) desc, length(rhost) desc limit 1) w
  from p)
select page_id, host, path, w.rule as rule, coalesce(w.verdict, 'allow') as verdict from f
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP8_SQL = r"""
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) pos from documents),
k as (select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
r as (select key, max(doc_id) keeper from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
d as (select k.*, r.key is not null and k.doc_id <> r.keeper as gone from k left join r on k.key = r.key)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from d group by doc_id
"""


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))



def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, percent=85)


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))


OP9_SQL = """
with s as (select source, sum(length(coalesce(text, '')))::double as size from documents group by source),
w as (select source, size, pow(size, 0.7) as weight from s),
t as (select sum(weight) filter (size > 0) as all_weight, sum(size) as all_size from w),
r as (select source, case when size > 0 and all_weight > 0 then weight / all_weight * 1.0 * all_size / size else 0.0 end as rate from w, t),
k as (select source, rate, unnest(generate_series(0, ceil(rate + 12 * sqrt(rate) + 30)::int)) as k from r),
m as (select source, k, case when rate > 0 then exp(sum(case when k = 0 then -rate else ln(rate) - ln(k) end) over (partition by source order by k rows unbounded preceding))
  when k = 0 then 1.0 else 0.0 end as mass from k),
c as (select source, k, sum(mass) over (partition by source order by k rows unbounded preceding) as cdf from m),
u as (select *, (('0x' || substr(md5('17:draw:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u from documents),
n as (select u.doc_id, u.source, u.lang, u.text, (select count(*) from c where c.source is not distinct from u.source and c.cdf < u.u)::int as n_copies from u)
select doc_id, source, lang, text, n_copies, copy_no, md5('17:place:' || coalesce(doc_id::varchar, '') || ':' || copy_no) as shuffle_key
from (select *, unnest(generate_series(1, n_copies))::int as copy_no from n where n_copies > 0)
"""


#: A text is called toxic from this score on.
TOXIC_FROM = 0.3


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.train(toxicity.training_rows(documents), toxicity.training_rows(labels))
    scored = toxicity.score_toxicity(documents, model, keep_text=False)
    return scored.select("doc_id", (id_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm_score.score_texts(documents, lm_score.training_rows(documents))
    return scored.select("doc_id", (id_bucket(F.col("doc_id"), 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of :func:`op4_lm_score` that SQL can give, from the same operator without vectors."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm_score.score_texts(documents, lm_score.training_rows(documents), shortlist=0)
    return scored.select("doc_id", (id_bucket(F.col("doc_id"), 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), table(spark, sf_dir, "labels"))


def _op3_sql() -> str:
    """The rules as DuckDB SQL, written out from the measures and their cutoffs."""
    share, level = quality_rules.RISK / len(quality_rules.MEASURES), quality_rules.ERROR / len(quality_rules.MEASURES)
    value = {m: re.sub(r"try_divide\((-?\w+), (\w+)\)", r"(\1::double / nullif(\2, 0))", v) for m, (v, _) in quality_rules.MEASURES.items()}
    steps = " union all ".join(f"select stratum, quality, '{m}' as measure, {len(c)} as cutoffs, len(list_filter({c}, lambda c: {value[m]} > c)) as step from h" for m, (_, c) in quality_rules.MEASURES.items())
    chosen = ", ".join(f"max(case when measure = '{m}' then {c}[level] end) as {m}" for m, (_, c) in quality_rules.MEASURES.items())
    failed = ", ".join(f"case when {value[m]} > c.{m} then '{m}' end" for m in quality_rules.MEASURES)
    return rf"""
with w as (select doc_id, lang, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
u as (select doc_id, unnest(ws) as a, generate_subscripts(ws, 1) as i from w),
v as (select *, lead(a) over (partition by doc_id order by i) as b, lead(a, 2) over (partition by doc_id order by i) as c from u),
r as (select doc_id, i, (c is not null and count(*) over (partition by doc_id, a, b, c) > 1)::int as twice from v),
n as (select doc_id, sum(hit)::bigint as n_repeat_words from (select doc_id, max(twice) over (partition by doc_id order by i rows between 2 preceding and current row) as hit from r) group by 1),
m0 as (select w.doc_id, lang as stratum, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls, coalesce(n_repeat_words, 0)::bigint as n_repeat_words from w left join n on w.doc_id = n.doc_id),
m as (select * exclude (ls), (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, len(ls)::bigint as n_text_lines, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m0),
k as (select doc_id, min(quality) as quality from labels where quality in (0, 1) group by 1),
hold as (select m.*, quality from m join k on m.doc_id = k.doc_id),
h as (select * from hold where not base_failed),
st as ({steps}),
l as (select stratum, measure, cutoffs, step, quality, unnest(generate_series(1, cutoffs)) as level from st),
g as (select stratum, measure, level, count(*) filter (quality = 1) as n, count(*) filter (quality = 1 and level > cutoffs - step) as k, count(*) filter (quality = 0 and level > cutoffs - step) as caught from l group by all),
p as (select *, case when k > n * {share} then 1.0 else list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({share}) + (n - i) * ln(1 - {share})))) end as p_value from g),
f as (select *, max((p_value > {level} / (select greatest(1, count(*)) from (select distinct stratum from hold)))::int) over (partition by stratum, measure order by level rows unbounded preceding) as failed from p),
b as (select stratum, measure, arg_max(level, {{'c': caught, 'l': -level}}) as level from f where failed = 0 and caught > 0 group by all),
c as (select stratum, {chosen} from b group by 1)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed = '' as kept, failed from (
  select m.*, case when base_failed then 'base' else array_to_string(list_filter([{failed}], lambda x: x is not null), ',') end as failed from m left join c on m.stratum is not distinct from c.stratum)
"""


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learn = id_bucket(F.col("doc_id"), 4) != 2
    model = cotraining.train(documents.filter(learn), labels.filter(learn))
    scored = cotraining.classify(documents.select("doc_id", "text", "source", "lang"), model)
    return scored.select("doc_id", (id_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "content_score", "meta_score", "score", (F.col("score") >= cotraining.KEEP_FROM).alias("kept"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and ``base_sha256`` are of the strict forms; ``spans`` has them and what context adds, which ``n_added`` counts."""
    found = pii.find_identifiers(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    strict = F.filter("spans", lambda s: s["strict"])
    of = F.transform(strict, lambda s: s["kind"])
    counts = [(F.size(strict) - F.size(F.array_remove(of, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    digest = F.sha2(pii.span_list(strict).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, pii.span_list(F.col("spans")).alias("spans"), (F.size("spans") - F.size(strict)).cast("long").alias("n_added"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, target = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text")
    return resampling.resample(documents, target, keep_text=False).select("doc_id", "n_features", "weight", "score", "rank")


def _crc32_sql(text: str, table: str = "crc_table") -> str:
    """DuckDB SQL: the CRC-32 of a text's UTF-8 bytes, which DuckDB lacks; needs the list of :data:`CRC_TABLE` in scope."""
    code = f"hex(encode({text}))"
    digits = f"list_transform(range(0, length({code}) // 2), lambda i: ('0x' || substr({code}, 2 * i + 1, 2))::bigint)"
    return f"xor(list_reduce({digits}, lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295::bigint)"


#: One row with the 256 remainders of the polynomial 0xEDB88320.
CRC_TABLE = "crc as (select list_transform(range(256), lambda v: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end, v::bigint)) as crc_table)"

OP12_SQL = rf"""
with recursive {CRC_TABLE},
r as (select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) as run from documents),
c as (select id, run, count(*) as n from r where length(run) >= 7 group by 1, 2),
h as (select run, n, {_crc32_sql("id || ':' || run")} as h from c, crc),
d as (select case when h % 31 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from h),
w as (select word, sum(n)::bigint as n from d where length(word) >= 7 group by 1 having sum(n) >= 2),
x as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select *, unnest(range(1, length(word) + 1)) as i from w)),
p as (select a.word, b.word as near, b.n as near_n from x a join x b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select a.word, b.word, b.n from x a join w b on a.rest = b.word
  union select b.word, a.word, a.n from x a join w b on a.rest = b.word),
g as (select word, count(*) as n_near, arg_min(near, {{'n': -near_n, 'w': near}}) as form, max(near_n) as form_n from p group by 1),
j as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when g.form_n >= 10 * w.n then g.form end as form, case when g.form_n >= 10 * w.n then g.form_n end as form_n from w left join g on w.word = g.word),
t(word, root) as (select word, form from j where form is not null union select t.word, j.form from t join j on t.root = j.word where j.form is not null),
e as (select t.word, t.root from t join j on t.root = j.word where j.form is null)
select j.word, j.form, coalesce(e.root, j.word) as root, j.n, j.n_near, j.form_n from j left join e on j.word = e.word
"""

OP13_SQL = rf"""
with {CRC_TABLE},
t as (select 's' as side, doc_id, text from documents union all select 't', null, text from benchmark),
w as (select side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from t),
f as (select side, doc_id, unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) as feature from w),
v as (select feature, {_crc32_sql("feature")} % 10000 as bucket from (select distinct feature from f), crc),
b as (select f.side, f.doc_id, v.bucket from f join v on f.feature = v.feature),
c as (select bucket, count(*) filter (side = 's') as s, count(*) filter (side = 't') as t from b group by 1),
a as (select sum(s) as s_all, sum(t) as t_all from c),
g as (select bucket, floor(1000 * ln((t + 1)::double * (s_all + 10000) / ((s + 1)::double * (t_all + 10000))))::bigint as gain from c, a),
m as (select doc_id, count(*) as n_features, floor(sum(gain) / count(*)::double)::bigint as weight from b join g on b.bucket = g.bucket where side = 's' group by 1),
k as (select w.doc_id, len(ws) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
  ('0x' || substr(sha256('7:' || coalesce(w.doc_id::varchar, '')), 1, 8))::bigint as h from w left join m on w.doc_id = m.doc_id where side = 's'),
z as (select *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::double)))::bigint as score from k),
o as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id) as place, 25 * count(*) filter (n_words >= 20) over () // 100 as drawn from z)
select doc_id, n_features::bigint as n_features, weight, score, case when n_words >= 20 and place <= drawn then place end as rank from o
"""


LM_BASE_SQL = rf"""
with {CRC_TABLE},
d as (select doc_id, {_crc32_sql("coalesce(doc_id::varchar, '')")} % 10 = 0 as held_out, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents, crc),
t as (select doc_id, held_out, unnest(ws) as w from d union all select doc_id, held_out, '' from d),
c as (select w, count(*) as c from t where not held_out group by 1),
a as (select sum(c) as n, count(*) as v from c)
select doc_id, held_out, count(*) as n_tokens, count(c) as n_known, any_value(n)::bigint as train_tokens, round(sum(log10((coalesce(c, 0) + 0.1) / (n + 0.1 * (v + 1)))), 3) as base_score
from t left join c on t.w = c.w, a group by doc_id, held_out
"""


QUERIES = {
    "lm_base_scores": lm_base_scores,
    "op1_toxicity": op1_toxicity,
    "op2_html_extract": op2_html_extract,
    "op3_quality_rules": op3_quality_rules,
    "op4_lm_score": op4_lm_score,
    "op5_decontamination": op5_decontamination,
    "op6_near_dedup": op6_near_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_line_dedup": op8_line_dedup,
    "op9_source_mix": op9_source_mix,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_pii": op11_pii,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_importance_resampling": op13_importance_resampling,
}
ORACLES = {"op3_quality_rules": _op3_sql(), "op7_url_filter": OP7_SQL, "op8_line_dedup": OP8_SQL, "op9_source_mix": OP9_SQL, "op12_spelling_variants": OP12_SQL, "lm_base_scores": LM_BASE_SQL, "op13_importance_resampling": OP13_SQL}
