"""Queries for text functions, vocabularies and TF-IDF."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.functions.numeric import rounded
from marlstone.operators import grams
from marlstone.operators import vocabulary as voc
from marlstone.plans.registry import query
from marlstone.sources.tables import read, spread


def docs(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", *columns)


@query("select doc_id, md5(lower(text)) as low, contains(text, 'License') as lic, starts_with(text, 'The') as the, ends_with(text, '.') as dot, split_part(source, 'src', 2) as tail, length(text) as n from documents")
def t01_basic_tests(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return docs(spark, d, "text", "source").select(
        "doc_id", F.md5(F.lower("text").cast("binary")).alias("low"), c("text").contains("License").alias("lic"), c("text").startswith("The").alias("the"),
        c("text").endswith(".").alias("dot"), F.split_part("source", F.lit("src"), F.lit(2)).alias("tail"), F.length("text").cast("long").alias("n"),
    )


@query("select p_partkey, cast(p_size as bigint) * (p_size + 7) as area from part")
def t06_product_of_parts(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "part").select("p_partkey", F.concat_ws("x", "p_size", F.col("p_size") + 7).alias("r"))
    pieces = F.transform(F.split("r", "x"), lambda v: v.cast("long"))
    return t.select("p_partkey", F.aggregate(pieces, F.lit(1).cast("long"), lambda a, v: a * v).alias("area"))


@query("select p_partkey, cast(p_size % 5 as int) as major, cast(p_size % 7 as int) as minor, (p_size % 5) + (p_size % 7) / 100.0::double as number from part")
def t07_version_parts(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "part").select("p_partkey", F.concat_ws(".", F.col("p_size") % 5, F.col("p_size") % 7).alias("v"))
    a, b = tx.version_parts("v", 2)
    return t.select("p_partkey", a.alias("major"), b.alias("minor"), (a + b / 100.0).alias("number"))


@query("select doc_id, replace(source, 'src', '') as n, regexp_replace(source, '^src', '') as m, lang || '-' || source as key from documents")
def t08_replace_concat(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d, "source", "lang").select("doc_id", F.replace("source", F.lit("src"), F.lit("")).alias("n"), F.regexp_replace("source", "^src", "").alias("m"), F.concat_ws("-", "lang", "source").alias("key"))


@query("""select doc_id, cast((length(text) - length(replace(text, '!!', ''))) // 2 as int) as bangs, len(regexp_extract_all(text, '\\p{Lu}')) as upper, round(len(regexp_extract_all(text, '\\p{Lu}')) / length(text), 6) as share from documents""".replace("\\\\", "\\"))
def t12_counts(spark: SparkSession, d: str) -> DataFrame:
    upper = F.regexp_count("text", F.lit(r"\p{Lu}"))
    return docs(spark, d, "text").select("doc_id", tx.count_of("text", "!!").alias("bangs"), upper.cast("long").alias("upper"), rounded(F.try_divide(upper, F.length("text")), 6).alias("share"))


@query("""with t as (select doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') as w from documents)
select doc_id, cast(len(w) as int) as words, cast(len(list_distinct(w)) as int) as unique_words, round(len(list_distinct(w)) / len(w), 6) as unique_share, round(list_sum(list_transform(w, lambda x: length(x))) / len(w), 6) as mean_word from t""".replace("\\\\", "\\"))
def t14_word_statistics(spark: SparkSession, d: str) -> DataFrame:
    s = tx.statistics("text")
    return docs(spark, d, "text").select("doc_id", s["words"].alias("words"), s["unique_words"].alias("unique_words"), rounded(s["unique_share"], 6).alias("unique_share"), rounded(s["mean_word"], 6).alias("mean_word"))


def _faces_sql(faces: tuple[str, ...]) -> str:
    sign = lambda f: "'" + f.replace("'", "''") + "'"
    return "cast(" + " + ".join(f"(length(html) - length(replace(html, {sign(f)}, ''))) // {len(f)}" for f in faces) + " as int)"


@query(f"select page_id, {_faces_sql(tx.SMILIES)} as happy, {_faces_sql(tx.SAD_FACES)} as sad from pages")
def t15_emoticons(spark: SparkSession, d: str) -> DataFrame:
    """Faces in raw pages; those that hold one another count for each, by design."""
    t = read(spark, d, "pages")
    total = lambda faces: functools.reduce(operator.add, [tx.count_of("html", f) for f in faces])
    return t.select("page_id", total(tx.SMILIES).alias("happy"), total(tx.SAD_FACES).alias("sad"))


@query("""select doc_id, cast(length(text) - length(translate(text, '!"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~', '')) as int) as punctuation from documents""".replace("\\\\", "\\"))
def t16_punctuation(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d, "text").select("doc_id", tx.statistics("text")["punctuation"].alias("punctuation"))


@query(r"""with t as (select doc_id, list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as w from documents)
select doc_id, cast(len(list_filter(w, lambda x: lower(x) in ('the', 'of', 'and', 'la', 'de', 'der', 'die'))) as int) as stop_words,
cast(len(list_filter(w, lambda x: regexp_matches(x, '^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$'))) as int) as upper_words, cast(len(list_filter(w, lambda x: regexp_matches(x, '^\p{Lu}\p{Ll}*[^\pL]*$'))) as int) as title_words from t""")
def t16_word_kinds(spark: SparkSession, d: str) -> DataFrame:
    s = tx.statistics("text")
    stop = F.size(F.filter(tx.words(F.lower("text")), lambda v: v.isin("the", "of", "and", "la", "de", "der", "die")))
    return docs(spark, d, "text").select("doc_id", stop.alias("stop_words"), s["upper_words"].alias("upper_words"), s["title_words"].alias("title_words"))


@query("select doc_id, round(len(list_distinct(string_split(text, ''))) / length(text), 6) as diversity from documents")
def t18_diversity(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d, "text").select("doc_id", rounded(F.size(F.array_distinct(F.array_remove(F.split("text", ""), ""))) / F.length("text"), 6).alias("diversity"))


@query("select page_id, split_part(url, '/', 3) as host, split_part(url, '/', 4) as piece from pages")
def t19_url_pieces(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", tx.url_piece("url", 2).alias("host"), tx.url_piece("url", 3).alias("piece"))


@query("""with t as (select 'p' || page_id as id, url as x from pages union all select 'd' || doc_id, text from documents)
select id, md5(regexp_replace(regexp_replace(regexp_replace(x, '(https?://|www\\.)\\S+', ' ', 'g'), '@\\w+', ' ', 'g'), '#\\w+', ' ', 'g')) as h from t""".replace("\\\\", "\\"))
def t20_remove_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of pages, and mentions and tags in documents."""
    t = read(spark, d, "pages").select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("url").alias("x"))
    t = t.unionByName(docs(spark, d, "text").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").alias("x")))
    out = F.regexp_replace("x", tx.URL, " ")
    return t.select("id", F.md5(F.regexp_replace(F.regexp_replace(out, tx.MENTION, " "), tx.HASHTAG, " ").cast("binary")).alias("h"))


@query("select doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as h from documents".replace("\\\\", "\\"))
def t26_squeeze_blanks(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d, "text").select("doc_id", F.md5(tx.squeeze_blanks("text").cast("binary")).alias("h"))


@query("""with t as (select doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') as w from documents)
select doc_id, md5(array_to_string(list_filter(w, lambda x: x not in ('the', 'of', 'and', 'la', 'de', 'der', 'die')), ' ')) as h from t""".replace("\\\\", "\\"))
def t27_stop_words(spark: SparkSession, d: str) -> DataFrame:
    stop = ("the", "of", "and", "la", "de", "der", "die")
    kept = F.filter(tx.words(F.lower("text")), lambda v: ~v.isin(*stop))
    return docs(spark, d, "text").select("doc_id", F.md5(F.array_join(kept, " ").cast("binary")).alias("h"))


def _clean_sql() -> str:
    twice = lambda x, p: "regexp_replace(regexp_replace({0}, '{1}', '\\1 \\2', 'g'), '{1}', '\\1 \\2', 'g')".format(x, p)
    x = r"regexp_replace(text, '(?i)(https?://|www\.)\S+', ' ', 'g')"
    x = rf"regexp_replace(regexp_replace({x}, '@\w+', ' ', 'g'), '#\w+', ' ', 'g')"
    x = twice(x, r"(^|[^\pL\pN\pM_])(?:RT|rt|FAV|fav|VIA|via)([^\pL\pN\pM_]|$)")
    signs = tx.PUNCTUATION.replace("'", "''")
    x = twice(f"lower(translate({x}, '{signs}', ''))", r"(^|[^\pL\pN])\pL([^\pL\pN]|$)")
    return f"array_to_string(list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '' and not regexp_matches(w, '^\\d+$') and w not in ('the', 'of')), ' ')"


@query(f"select doc_id, {_clean_sql()} as clean from documents")
def t29_cleaning_chain(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d, "text").select("doc_id", tx.clean("text", ("the", "of")).alias("clean"))


def _rewrite_sql(x: str) -> str:
    for old, new in tx.CONTRACTIONS:
        x = "replace({}, '{}', '{}')".format(x, old.replace("'", "''"), new)
    return x


@query(f"select page_id, md5({_rewrite_sql('html')}) as h from pages")
def t30_contractions(spark: SparkSession, d: str) -> DataFrame:
    """Raw pages have the apostrophes."""
    return read(spark, d, "pages").select("page_id", F.md5(tx.rewrite("html").cast("binary")).alias("h"))


@query(r"""select doc_id, md5(regexp_replace(regexp_replace(text, '(\d)[kK]([^\pL\pN_]|$)', '\1000\2', 'g'), '(\d)(\p{L})', '\1 \2', 'g')) as h from documents where not regexp_matches(text, '\d,\d')""".replace("\\\\", "\\"))
def t36_numbers(spark: SparkSession, d: str) -> DataFrame:
    t = docs(spark, d, "text").where(~F.col("text").rlike(r"\d,\d"))
    return t.select("doc_id", F.md5(tx.space_numbers("text").cast("binary")).alias("h"))


_WORDS = r"list_filter(string_split_regex(lower(text), '[^\pL]+'), lambda x: x <> '')"
_LETTERS = r"[^\p{L}]+"


@query("select doc_id, md5(strip_accents(lower(text))) as h from documents")
def t38_strip_accents(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d, "text").select("doc_id", F.md5(tx.strip_accents(F.lower("text")).cast("binary")).alias("h"))


@query("select doc_id, md5(replace(replace(replace(replace(replace(replace(text, '’', chr(39)), '‘', chr(39)), '“', chr(34)), '”', chr(34)), '–', '-'), '…', '...')) as h from documents")
def t38_plain_punctuation(spark: SparkSession, d: str) -> DataFrame:
    table = {"’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "…": "..."}
    return docs(spark, d, "text").select("doc_id", F.md5(tx.plain_punctuation("text", table).cast("binary")).alias("h"))


@query(f"with w as (select doc_id, unnest({_WORDS}) as word from documents) select word, count(*) as n, count(distinct doc_id) as df from w group by word")
def t48_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return voc.vocabulary(voc.tokens(docs(spark, d, "text"), "doc_id", F.split(F.lower("text"), _LETTERS)), "doc_id")


@query(f"""with w as (select doc_id, unnest({_WORDS}) as word from documents),
b as (select distinct unnest({_WORDS}) as word from benchmark), v as (select word, count(*) as n from w group by 1)
select round(avg((b.word is not null)::int), 6) as types, round(cast(sum(n) filter (b.word is not null) as double) / sum(n), 6) as tokens from v left join b using (word)""")
def t49_coverage(spark: SparkSession, d: str) -> DataFrame:
    split = lambda t: voc.tokens(t, t.columns[0], F.split(F.lower("text"), _LETTERS))
    v = voc.vocabulary(split(docs(spark, d, "text")), "doc_id")
    known = split(read(spark, d, "benchmark").select("item_id", "text")).select("word").distinct()
    found = voc.coverage(v, known)
    return found.select(rounded("types", 6).alias("types"), rounded("tokens", 6).alias("tokens"))


def _tfidf_sql(grams: str, least: int) -> str:
    return f"""with w as (select doc_id, unnest({grams}) as word from (select doc_id, {_WORDS} as w from documents)), n as (select count(distinct doc_id) as n from w),
    tf as (select doc_id, word, count(*) as k from w group by all), df as (select word, count(*) as df from tf group by 1),
    x as (select doc_id, word, (1 + ln(k)) * (ln((1 + n) / (1.0 + df)) + 1) as v from tf join df using (word), n where df >= {least})
    select doc_id, word, round(v / sqrt(sum(v * v) over (partition by doc_id)), 6) as tfidf from x"""


def _grams_sql(n: int) -> str:
    return f"list_transform(range(1, greatest(1, len(w) - {n} + 2)), lambda i: array_to_string(w[i:i + {n - 1}], ' '))"


@query(_tfidf_sql("list_concat(" + ", ".join(_grams_sql(n) for n in (1, 2, 3, 4)) + ")", 5))
def t46_tfidf(spark: SparkSession, d: str) -> DataFrame:
    """Grams of one to four words in five documents at least."""
    w = F.array_remove(F.split(F.lower("text"), _LETTERS), "")
    t = grams.tfidf(spread(docs(spark, d, "text")), "doc_id", w, 1, 4, least_df=5)
    return t.select("doc_id", "word", rounded("tfidf", 6).alias("tfidf"))


@query(_tfidf_sql("flatten(list_transform(w, lambda x: list_transform(range(1, length(x) + 1), lambda i: substr(' ' || x || ' ', i, 3))))", 5))
def t47_character_tfidf(spark: SparkSession, d: str) -> DataFrame:
    """Grams of three characters inside the bounds of words, in five documents at least."""
    w = F.array_remove(F.split(F.lower("text"), _LETTERS), "")
    t = grams.tfidf(spread(docs(spark, d, "text")), "doc_id", w, least_df=5, letters=3)
    return t.select("doc_id", "word", rounded("tfidf", 6).alias("tfidf"))


@query(f"""with w as (select {_WORDS} as w from documents), g as (select unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as gram from w)
select gram, count(*) as n from g group by gram""")
def t47_ngrams(spark: SparkSession, d: str) -> DataFrame:
    w = F.array_remove(F.split(F.lower("text"), _LETTERS), "")
    return grams.counts(spread(docs(spark, d, "text")), w, 1, 2)


@query(f"""with t as (select doc_id, {_WORDS} as w from documents), w as (select doc_id, unnest(w) as word, unnest(range(len(w))) as i from t),
v as (select word, row_number() over (order by count(*) desc, word) as id from w group by word), s as (select doc_id, list(id order by i) as ids from w join v using (word) group by 1)
select doc_id, array_to_string(list_concat(list_transform(range(greatest(0, 60 - len(ids))), lambda x: 0), ids[greatest(1, len(ids) - 59):]), ' ') as padded from s""")
def t51_sequences(spark: SparkSession, d: str) -> DataFrame:
    t = spread(docs(spark, d, "text"))
    return voc.sequences(t, "doc_id", F.split(F.lower("text"), _LETTERS), 60).select("doc_id", F.array_join("padded", " ").alias("padded"))


@query("""select doc_id, regexp_matches(text, '\\b(?:\\d{1,3}\\.){3}\\d{1,3}\\b') as ip, len(regexp_extract_all(text, '\\b\\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\\d|3[01])\\b')) as dates from documents""".replace("\\\\", "\\"))
def t54_pattern_search(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d, "text").select("doc_id", F.col("text").rlike(tx.IPV4).alias("ip"), F.regexp_count("text", F.lit(tx.ISO_DATE)).cast("long").alias("dates"))


@query("select p_partkey, regexp_replace(p_name, '(\\w+) (\\w+)', '\\2 \\1') as swapped from part".replace("\\\\", "\\"))
def t55_backreference(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", F.regexp_replace("p_name", r"^(.*?)(\w+) (\w+)", "$1$3 $2").alias("swapped"))


@query("select o_custkey, cast(len(string_split(string_agg(o_orderstatus, ','), ',')) as int) as n from orders group by 1")
def t60_list_size(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list("o_orderstatus"), ",").alias("x"))
    return t.select("o_custkey", F.size(F.split("x", ",")).alias("n"))


