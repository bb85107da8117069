"""The queries opN_<name> and their SQL: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import chat_format, collocations, html_extract, importance, language_id, media_columns, near_dedup, ngram_join, packing, quality_rules, secret_scan, sentencepiece_bpe, toxicity
from marlstone.llm.common import scratch, spread, table

#: The setting that names the folder of the durable ledger of secret scans; unset, each run has one of its own.
LEDGER = "spark.marlstone.secretLedger"
#: The vocabulary file among the installed public tokenizers; read by the driver only.
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return html_extract.extract(pages, html_extract.train(spark)).withColumn("n_chars", F.length("text").cast("long"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a folder in ``LEDGER``, only what its ledger lacks is scanned, and is appended there."""
    docs = table(spark, sf_dir, "documents")
    folder = spark.conf.get(LEDGER, None)
    with scratch() as keep:
        ledger = secret_scan.record(docs, folder) if folder else secret_scan.scan(docs)
        matches = keep(secret_scan.found_in(ledger, history=docs if folder else None))
    found = secret_scan.attach(docs, matches)
    spans = F.col("spans")
    count = lambda rank: F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")
    base = F.filter(spans, lambda s: s["rank"] < 3)
    return found.select(
        F.col("path").alias("doc_id"),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secret_scan.render(base), 256).alias("base_sha256"),
        secret_scan.render(spans).alias("spans"),
    )


def op3_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    m = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    # a document without an id is in no fold
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(toxicity.FOLDS)) == 0, F.lit(False))
    scored = toxicity.score(docs, m)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return chat_format.digest(chat_format.format_turns(turns.unionByName(own))).withColumnRenamed("conv", "conv_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality_rules.rate(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")), ["doc_id"])
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicate(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.round_trip(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), PIECE_MODEL)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns.store_texts(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).drop("tile")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    evidence = language_id.page_evidence(table(spark, sf_dir, "pages"))
    found = language_id.identify(docs, evidence=evidence, keep=["doc_id", "lang", "source"])
    told = [F.col(f"__{c}").alias(c) for c in ("declared", "suffix", "host", "language", "posterior", "kept")]
    return found.select("doc_id", F.col("lang").alias("label"), "source", *told)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(spread(table(spark, sf_dir, "documents").select("text", "lang")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return importance.resample(docs, table(spark, sf_dir, "benchmark").select("text"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extract,
        op2_secret_scan,
        op3_length_packing,
        op4_toxicity,
        op5_chat_format,
        op6_quality_rules,
        op7_near_dedup,
        op8_sentencepiece,
        op9_media_columns,
        op10_language_id,
        op11_collocations,
        op12_importance_resampling,
        op13_ngram_join,
    )
}

_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_RULES_SQL = (
    ("assign", _ASSIGN, f"length(regexp_extract(m, '{_ASSIGN.replace(chr(39), chr(39) * 2)}', 2)) >= 12"),
    ("access", "AKIA[A-Z0-9]+", "length(m) >= 18"),
    ("hex", "[0-9a-f]+", "length(m) >= 16"),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "true"),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "true"),
)


def _spans_sql() -> str:
    out = []
    for rank, (kind, pattern, ok) in enumerate(_RULES_SQL):
        p = pattern.replace("'", "''")
        out.append(
            f"""select doc_id, {rank} as rank, '{kind}' as kind, m, ends - length(m) as s, ends as e from (
              select doc_id, m, sum(length(g) + length(m)) over (partition by rid order by i) as ends from (
                select rid, doc_id, unnest(regexp_extract_all(t, '{p}')) as m, unnest(string_split_regex(t, '{p}')[1:len(regexp_extract_all(t, '{p}'))]) as g,
                       unnest(range(len(regexp_extract_all(t, '{p}')))) as i from d)) where {ok}"""
        )
    return " union all ".join(out)


_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases of one to three words by language, their cuts, and what longer phrases cover.
_COLLOCATIONS_SQL = rf"""
with p as (select lang, list_filter(string_split_regex(x, '[\x20\t]+'), lambda w: w <> '') as w from (
       select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_SMALL}'), '[.,;:!?\x0A-\x0D]')) as x from documents)),
g as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from p, (values (1), (2), (3)) as v(k) where len(w) >= k)),
f as materialized (select lang, k, phrase, count(*) as a from g group by all),
size as (select lang, cast(sum(a) as bigint) as n from f where k = 1 group by lang),
c as (select lang, k, phrase, string_split(phrase, ' ') as w, a from f where k > 1 and a >= 10),
above as (select lang, array_to_string(w[i:i + 1], ' ') as phrase, max(a) as f from c, (values (1), (2)) as v(i) where k = 3 group by all),
open as (select c.* from c left join above on c.lang = above.lang and c.phrase = above.phrase where above.f is null or 100 * above.f < 50 * c.a),
cut as (select open.*, j from open, (values (1), (2)) as v(j) where j < k),
s as (select cut.lang, cut.phrase, cut.a, j, l.a as l, r.a as r, (1000000::hugeint * cut.a * cut.a) // (l.a::hugeint * r.a) as score
      from cut join f l on l.lang = cut.lang and l.phrase = array_to_string(w[:j], ' ') join f r on r.lang = cut.lang and r.phrase = array_to_string(w[j + 1:], ' ')),
best as (select *, row_number() over (partition by lang, phrase order by score, j) as place from s),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best where place = 1)
select lang, rank, phrase, a, l, r, n, cast(score as bigint) as score from ranked join size using (lang) where rank <= 2000"""

#: The CRC-32 of every distinct feature, from the table of its polynomial.
_IMPORTANCE_SQL = rf"""
with recursive tab0 as (select i, i as c, 0 as step from range(256) r(i) union all
       select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, step + 1 from tab0 where step < 8),
tab as (select list(c order by i) as t from tab0 where step = 8),
d as (select row_number() over () as rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_SMALL}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w from documents),
b as (select list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_SMALL}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w from benchmark),
df as (select rid, f, count(*) as k from (select rid, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from d) group by all),
bf as (select f, count(*) as k from (select unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from b) group by all),
every as (select distinct f from (select f from df union all select f from bf)),
crc as materialized (select f, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, octet_length(encode(f)) + 1), lambda i: cast('0x' || substr(hex(encode(f)), 2 * i - 1, 2) as bigint))),
        lambda c, y: xor(tab.t[(xor(c, y) & 255) + 1], c >> 8)), 4294967295) % 10000 as bucket from every, tab),
s as (select bucket, sum(k) as s from df join crc using (f) group by 1), t as (select bucket, sum(k) as t from bf join crc using (f) group by 1),
whole as (select (select coalesce(sum(s), 0) from s) as big, (select coalesce(sum(t), 0) from t) as aim),
gain as (select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * (big + 10000) / ((coalesce(s, 0) + 1)::double * (aim + 10000)))) as g from s full join t using (bucket), whole),
m as (select rid, sum(k) as n, floor(sum(k * g) / sum(k)) as weight from df join crc using (f) join gain using (bucket) group by rid),
x as (select doc_id, len(w) as words, cast(coalesce(n, 0) as bigint) as n_features, cast(coalesce(weight, 0) as bigint) as weight,
      cast('0x' || substr(sha256('7:' || doc_id), 1, 8) as bigint) as h from d left join m using (rid)),
y as (select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296))) as bigint) as score from x),
z as (select *, row_number() over (partition by words >= 20 order by score desc, doc_id) as place, count(*) filter (words >= 20) over () as many from y)
select doc_id, n_features, weight, score, case when words >= 20 and place <= 25 * many // 100 then place end as rank from z"""

#: Documents that share a shingle are counted; exact copies are one set.
_JOIN_SQL = rf"""
with recursive d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_SMALL}'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
g as (select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as grams from d),
size as (select doc_id, len(grams) as n from g),
copy as (select doc_id, min(doc_id) over (partition by list_sort(grams)) as first, len(grams) as n, grams from g where len(grams) > 0),
p as (select first as id, n, unnest(grams) as gram from copy where doc_id = first),
shared as (select a.id as a, b.id as b, a.n as na, b.n as nb, count(*) as k from p a join p b on a.gram = b.gram and a.id < b.id group by all),
link as (select a, b from shared where 100 * k >= 85 * (na + nb - k)),
edge as (select a, b from link union select b, a from link),
reach(id, other) as (select distinct first, first from copy union select r.id, edge.b from reach r join edge on edge.a = r.other),
comp as (select id, min(other) as component from reach group by id)
select size.doc_id, cast(size.n as bigint) as n_shingles, coalesce(component, size.doc_id) as component_id
from size left join copy on size.doc_id = copy.doc_id left join comp on comp.id = copy.first"""

SQL = {
    "op2_secret_scan": f"""
    with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents), s as ({_spans_sql()})
    select d.doc_id, count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access, count(*) filter (rank = 2) as n_hex,
           sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, rank, e) filter (rank < 3), '')) as base_sha256,
           coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, rank, e) filter (rank is not null), '') as spans
    from d left join s on d.doc_id = s.doc_id group by d.doc_id""",
    "op5_chat_format": r"""
    with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
               union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
    f as (select *, 7 + case role when 'user' then 7 + 8 when 'assistant' then 6 + 7 when 'system' then 6 + 7
                        else 13 + length(role) + length(regexp_replace(role, '[^\\<\[]', '', 'g')) end
                    + length(text) + length(regexp_replace(text, '[^\\<\[]', '', 'g')) as chars from c)
    select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
           cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
           sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
           cast(sum(chars) as bigint) as formatted_chars
    from f group by conv_id""",
    "op11_collocations": _COLLOCATIONS_SQL,
    "op12_importance_resampling": _IMPORTANCE_SQL,
    "op13_ngram_join": _JOIN_SQL,
}
