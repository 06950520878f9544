"""The registered queries of the operators in this package, and their SQL where there is any."""

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from runlens.llm import (
    bottom_k,
    bpe,
    language_id,
    line_dedup,
    line_frequency,
    mixing,
    ngram_join,
    quality_gam,
    secrets,
    spelling,
    substring,
    whitening,
    wrappers,
)

QUERIES = {}
ORACLES = {}
TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_wrappers")
def _(spark, sf_dir):
    return wrappers.extract(table(spark, sf_dir, "pages"))


@query("op2_kneser_ney_language_id")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = language_id.held_out("doc_id", 3, 1)
    tool = language_id.train(docs.where(~out & F.col("doc_id").isNotNull()))
    found = language_id.identify(docs, tool)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "entropy", "accepted")


@query("op3_byte_bpe")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return bpe.digest(docs, public_tokenizers.path(TOKENIZER))


MIX_SQL = r"""
with d as (select doc_id, source,
        cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size
    from documents),
s as (select source, cast(sum(size) as bigint) as source_size,
        row_number() over (order by source asc nulls last) as i from d group by source),
w as (select *, case (i - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight,
        3 * source_size as cap from s),
o as (select *, cast(sum(cap) over before_it - cap as hugeint) as caps_before,
        cast(sum(weight) over after_it as hugeint) as weight_left,
        cast(sum(source_size) over () as hugeint) as total
    from w window before_it as (order by cap::double / weight, i rows unbounded preceding),
        after_it as (order by cap::double / weight, i rows between current row and unbounded following)),
l as (select total - caps_before as rest, weight_left as over from o
    where cap::hugeint * weight_left >= weight * (total - caps_before)
    order by cap::double / weight, i limit 1),
t as (select source, source_size,
        case when cap::hugeint * over <= weight * rest then cap::double
            else cast(weight * rest as double) / cast(over as double) end as target
    from w, l),
p as (select d.doc_id, d.size, t.source_size, t.target,
        row_number() over (partition by d.source order by d.size, d.doc_id nulls first) as k,
        case when t.source_size > 0
            then cast(floor(t.target / t.source_size * 16777216) as bigint) else 0 end as step,
        ('0x' || substr(md5('mix:' || coalesce(d.source, '')), 1, 6))::bigint as shift
    from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
    size * (((k * step + shift) >> 24) - (((k - 1) * step + shift) >> 24)) as taken from p
"""


@query("op4_mixing", MIX_SQL)
def _(spark, sf_dir):
    plan = mixing.planned(table(spark, sf_dir, "documents"))
    taken = plan["size"] * plan["copies"]
    return plan.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


# A set's pairs are counted by shared shingles; components are closed over their links.
JOIN_SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
    from documents),
s as (select distinct doc_id, md5(array_to_string(w[i:i + 4], ' ')) as h
    from d, unnest(range(1, greatest(len(w) - 3, 2))) t(i) where len(w) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k
    from s a join s b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b
    where 100 * k >= 80 * (x.n + y.n - k)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id, doc_id as other from n union select r.doc_id, e.b from r join e on e.a = r.other),
c as (select doc_id, min(other) as component_id from r group by doc_id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(component_id, d.doc_id) as component_id
from d left join n using (doc_id) left join c using (doc_id)
"""


@query("op5_ngram_jaccard_join", JOIN_SQL)
def _(spark, sf_dir):
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_bottom_k")
def _(spark, sf_dir):
    return bottom_k.compare_with_edited(table(spark, sf_dir, "documents"))


@query("op7_additive_quality")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = language_id.held_out("doc_id", 5, 0)
    model = quality_gam.train(docs, table(spark, sf_dir, "labels").where(~out))
    found = quality_gam.scored(docs, model)
    predicted = (F.col("score") >= 0.3).cast("int").alias("predicted")
    return found.select("doc_id", out.alias("held_out"), "score", predicted)


LINES_SQL = r"""
with d as (select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''),
        '[^\x20\x09-\x0D]+') as w from documents),
k as (select doc_id, i, md5(array_to_string(w[i:i + 4], ' ')) as h
    from d, unnest(range(1, len(w) - 3)) t(i) where len(w) >= 5),
twice as (select doc_id, i from (select *, count(*) over (partition by doc_id, h) as n from k) where n > 1),
again as (select doc_id, count(distinct i + j) as n_repeat_words
    from twice, unnest(range(5)) t(j) group by doc_id),
lines as (select doc_id, source, md5(text) as m, unnest(string_split(text, chr(10))) as line from d),
real as (select *, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as norm
    from lines where regexp_matches(line, '[^\x20\x09-\x0D]')),
dup as (select doc_id, count(*) - count(distinct line) as n_dup_lines from real group by doc_id),
hosts as (select source, count(distinct md5(text)) as host_docs from d group by source),
often as (select r.source, norm from (select source, norm, count(distinct m) as n from real group by 1, 2) r
    join hosts h on r.source is not distinct from h.source
    where n > 10 and n > host_docs * 0.01),
gone as (select doc_id, sum(len(r.norm)) as removed from real r
    join often o on r.source is not distinct from o.source and r.norm = o.norm group by doc_id),
b as (select d.doc_id, cast(len(w) as bigint) as n_words,
        cast(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
        cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
        cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines,
        cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
        cast(len(w) - coalesce(removed, 0) as bigint) as left_words
    from d left join again using (doc_id) left join dup using (doc_id) left join gone using (doc_id))
select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
    not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and left_words >= n_words * 0.3 as kept
from b
"""


@query("op8_line_frequency", LINES_SQL)
def _(spark, sf_dir):
    return line_frequency.verdicts(table(spark, sf_dir, "documents"))


@query("op9_secret_guess_cost")
def _(spark, sf_dir):
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


SUBSTRING_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
k as (select doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) as h
    from d, unnest(range(1, len(w) - 18)) t(i) where len(w) >= 20),
late as (select doc_id, i from (select *, min(doc_id) over (partition by h) as least,
        row_number() over (partition by h, doc_id order by i) as n from k)
    where doc_id > least or n > 1),
gone as (select distinct doc_id, i + j as i from late, unnest(range(20)) t(j)),
x as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from d),
t as (select x.doc_id, count(gone.i) as n_removed,
        string_agg(word, ' ' order by x.i) filter (where gone.i is null) as kept
    from x left join gone on gone.doc_id = x.doc_id and gone.i = x.i group by x.doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed,
    sha256(coalesce(kept, '')) as kept_sha256
from d left join t using (doc_id)
"""


@query("op10_difference_cover", SUBSTRING_SQL)
def _(spark, sf_dir):
    return substring.deduplicated(table(spark, sf_dir, "documents"), digest=True)


DEDUP_SQL = r"""
with d as (select row_number() over () as row, doc_id, string_split(coalesce(text, ''), chr(10)) as l
    from documents),
x as (select row, doc_id, unnest(l) as line, generate_subscripts(l, 1) as i from d),
k as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from x),
f as (select key, max(doc_id) as keeper from k where length(key) >= 40
    group by key having count(distinct doc_id) >= 5),
m as (select k.*, keeper is not null and doc_id is distinct from keeper as gone
    from k left join f on k.key = f.key)
select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from m group by row
"""


@query("op11_line_dedup", DEDUP_SQL)
def _(spark, sf_dir):
    return line_dedup.deduplicated(table(spark, sf_dir, "documents"), digest=True)


@query("op12_qd_whitening")
def _(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.components(vectors, whitening.train(vectors))


@query("op13_spelling_variants")
def _(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def _(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
