"""The operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._encode import public_path
from ._session import table


def op1_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).drop("set_print")


def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ._session import scratch_path
    from .tokencounts import Rollup, history

    tokenizers = {"byte_bpe_50k": (public_path("byte_bpe_50k.json"), True), "word_bpe_49k": (public_path("word_bpe_49k.json"), False)}
    batches = history(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), tokenizers)
    rollup = Rollup(spark, scratch_path(spark, "rollup"))
    for name in reversed(batches):  # out of order
        rollup.commit(name, batches[name])
    rollup.fold()
    for name in batches:  # a job that runs again adds nothing
        rollup.commit(name, batches[name])
    return rollup.totals()


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kneser import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wavelet import token_files

    return token_files(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"), end_id=0)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"), end_id=2)


def op6_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op7_cosine_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embdedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "text")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license import scan

    return scan(files(spark, sf_dir))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode

    return encode(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"), public_tokenizers.PATTERN, keep_ids=False)


def op10_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op11_longest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign

    shards = assign(table(spark, sf_dir, "documents")).withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))
    return shards.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op12_deletion_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import variants

    return variants(table(spark, sf_dir, "documents"))


def op13_radix_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_hyperminhash, op2_token_rollup, op3_kneser_ney, op4_token_files, op5_packing, op6_additive_quantisation,
        op7_cosine_cells, op8_license_scan, op9_bpe, op10_suffix_arrays,
        op11_longest_first, op12_deletion_keys, op13_radix_tries,
    )
}


def _license_sql() -> str:
    from .license import FILE_NAMES, LEAST, TEXTS

    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in TEXTS.items())
    return f"""
with templates(template, body) as (values {values}),
bags as (select template, term, count(*) as tf from (select template, unnest(string_split_regex(lower(body), '[^a-z0-9]+')) as term from templates) where term <> '' group by all),
idfs as (select term, ln((1 + (select count(*) from templates))::double / (1 + count(distinct template))) + 1 as idf from bags group by term),
lengths as (select template, sqrt(sum((tf * idf) ** 2)) as length from bags join idfs using (term) group by template),
entries as (select template, term, idf, tf * idf / length as w from bags join idfs using (term) join lengths using (template)),
rare as (select ln(1 + count(*)) + 1 as idf0 from templates),
split as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') as l from documents),
lines as (select doc_id, len(l) as n_lines, generate_subscripts(l, 1) as pos, unnest(l) as line from split),
sentences as (select doc_id, pos, generate_subscripts(s, 1) as part, len(s) as parts, unnest(s) as sentence from (select doc_id, pos, string_split_regex(line, '[.!?;:]\\s+') as s from lines)),
terms as (select doc_id, pos, part, term, idf from (select doc_id, pos, part, unnest(string_split_regex(lower(sentence), '[^a-z0-9]+')) as term from sentences) left join idfs using (term) where term <> ''),
liked as (select doc_id, pos from terms group by doc_id, pos having count(idf) > 0 and sum(coalesce(idf ** 2, 0)) >= (count(*) - count(idf)) * (select idf0 ** 2 from rare)),
runs as (select doc_id, min(pos) as pos, count(*) as span from (select doc_id, pos, pos - row_number() over (partition by doc_id order by pos) as run from liked) group by doc_id, run having count(*) > 1),
units as (select doc_id, pos, 1 as span, 0 as part from lines union select doc_id, pos, 1, part from sentences where parts > 1 union select doc_id, pos, span, 0 from runs union select distinct doc_id, 1, n_lines, 0 from lines),
tf as (select u.doc_id, u.pos, u.span, u.part, term, any_value(idf) as idf, count(*) as tf from units u join terms t on t.doc_id = u.doc_id and t.pos between u.pos and u.pos + u.span - 1 and u.part in (0, t.part) group by all),
norms as (select doc_id, pos, span, part, sqrt(sum((tf * coalesce(idf, idf0)) ** 2)) as length from tf, rare group by all),
scores as (select doc_id, pos, span, part, template, round(sum(tf * entries.idf * w) / any_value(length), 6) as score from tf join entries using (term) join norms using (doc_id, pos, span, part) group by doc_id, pos, span, part, template),
good as (select doc_id, pos, span, string_split(template, '#')[1] as template, score from scores where score >= {LEAST}),
own as (select g.doc_id, min({{'s': -score, 't': template, 'span': -span}}) as best, greatest(count(distinct case when span = 1 then pos end), -min({{'s': -score, 't': template, 'span': -span}}).span) * 2 > any_value(n_lines) as mostly from good g join (select distinct doc_id, n_lines from lines) using (doc_id) group by g.doc_id),
files as (select d.doc_id, concat_ws('/', source, lang, d.doc_id || '.txt') as path, best.t as own_license, -best.s as own_score, mostly from documents d left join own using (doc_id)),
grants as (select regexp_replace(path, '/?[^/]*$', '') as dir, min({{'s': -own_score, 't': own_license}}) as best from files where own_license is not null and (mostly or regexp_matches(path, {quoted(FILE_NAMES)})) group by 1),
wanting as (select doc_id, depth, array_to_string(string_split(path, '/')[1:depth], '/') as dir from (select doc_id, path, unnest(range(0, len(string_split(path, '/')))) as depth from files where own_license is null)),
inherited as (select doc_id, max_by(best.t, depth) as granted, max_by(dir, depth) as dir from wanting join grants using (dir) group by doc_id)
select doc_id, path, own_license, own_score, coalesce(own_license, granted) as license, case when own_license is not null then 'own' else dir end as license_from
from files left join inherited using (doc_id)
"""


def _spelling_sql() -> str:
    from .spelling import DAMAGED, FORM, LETTERS, TIMES

    step = "case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end"
    return f"""
with recursive crcs as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i::bigint, list_transform(range(8), lambda k: k::bigint)), lambda c, k: {step})) as crc),
texts as (select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) as run from documents),
runs as (select id, run, count(*) as n from texts where length(run) >= {LETTERS} group by all),
bytes as (select id, run, n, hex(encode(id || ':' || run)) as h from runs),
hashed as (select id, run, n, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, len(h) // 2 + 1), lambda i: ('0x' || substr(h, (2 * i - 1)::int, 2))::bigint)), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) as hash from bytes, crcs),
damaged as (select case when hash % {DAMAGED} = 0 then substr(run, 1, (hash % length(run))::int) || substr(run, (hash % length(run))::int + 2) else run end as word, n from hashed),
words as (select word, sum(n)::bigint as n from damaged where length(word) >= {LETTERS} group by word having sum(n) >= {TIMES}),
places as (select word, n, unnest(range(1, length(word) + 1)) as place from words),
shorter as (select word, n, place, substr(word, 1, place::int - 1) || substr(word, place::int + 1) as rest from places),
links as (
  select a.word, b.word as other, b.n as other_n from shorter a join shorter b using (rest, place) where a.word <> b.word
  union select a.word, b.word, b.n from shorter a join words b on a.rest = b.word
  union select b.word, a.word, a.n from shorter a join words b on a.rest = b.word),
near as (select word, count(*) as n_near, min({{'n': -other_n, 'word': other}}) as best from links group by word),
formed as (select word, n, coalesce(n_near, 0) as n_near, case when -best.n >= {FORM} * n then best.word end as form, case when -best.n >= {FORM} * n then -best.n end as form_n from words left join near using (word)),
paths as (select word, word as root, 0 as steps from formed union all select paths.word, form, steps + 1 from paths join formed on formed.word = paths.root where form is not null)
select word, form, (select max_by(root, steps) from paths p where p.word = formed.word) as root, n, n_near, form_n from formed
"""


def _divergence_sql() -> str:
    from .divergence import LEAST, TOP

    share = "(1 + 1000000000::hugeint * (coalesce({c}, 0) + 2) // (coalesce({n}, 0) + 2 * v))"
    gap = "((p - q) * (p - q) // (p + q))"
    rank = "row_number() over (partition by lang, source order by value desc, item)"
    return f"""
with docs as (select coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text, row_number() over () as row from documents),
found as (select lang, source, row, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
kept as (select lang, term from found group by lang, term having count(distinct row) >= {LEAST}),
sizes as (select lang, count(*) as v from kept group by lang),
counts as (select lang, source, term, count(*) as c from found join kept using (lang, term) group by all),
totals as (select lang, source, sum(c) as n from counts group by all),
everywhere as (select lang, term, sum(c) as c from counts group by all),
langs as (select lang, sum(c) as n from everywhere group by all),
groups as (select distinct lang, source from docs),
shares as (select g.lang, g.source, k.term, coalesce(c, 0) as c, {share.format(c="c", n="n")} as p from groups g join kept k using (lang) join sizes using (lang) left join counts using (lang, source, term) left join totals using (lang, source)),
of_lang as (select lang, term, {share.format(c="c", n="n")} as q from everywhere join langs using (lang) join sizes using (lang)),
sums as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value from shares a join shares b using (lang, term) group by all),
pairs as (select a.lang, a.source, b.source as item, coalesce(value, 0)::bigint as value from groups a join groups b using (lang) left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source where a.source <> b.source),
terms as (select lang, source, term as item, {gap}::bigint as value from shares join of_lang using (lang, term) where c > 0 and p > q)
select lang, source, 'pair' as part, item, value, ({rank})::int as rank from pairs
union all select * from (select lang, source, 'term' as part, item, value, ({rank})::int as rank from terms) where rank <= {TOP}
"""


ORACLE_SQL: dict[str, str] = {"op8_license_scan": _license_sql(), "op12_deletion_keys": _spelling_sql(), "op13_radix_tries": _divergence_sql()}
