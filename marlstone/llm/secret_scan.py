"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every historical version of every path is addressed by the SHA-256 of its
content. A *ledger* says which (blob, rule version) pairs have been scanned and
what was found there. A scan reads only pairs that the ledger lacks, and the
findings of a blob are joined back to all paths that hold it. ``record`` keeps
the ledger in a folder: each call scans and appends what is new there.

Spans have code points (start, end) and bytes (head, tail). Offsets are prefix
sums by doubling, so a text with n matches costs n log n.

Defined results: a null content counts as the empty text; a null path stays one
path; repeated rows and ties give one finding list each, equal for equal
contents; texts of any length and number of matches are scanned whole; an empty
table gives an empty table; columns besides path and content are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import exists, materialize, scratch, text_of

SPANS = "array<struct<start:int,rank:int,end:int,head:int,tail:int>>"
LEDGER = f"blob binary, rule_version string, spans {SPANS}"
BROADCAST_ROWS, BROADCAST_SPANS = 100_000, 400_000


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` of which ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int
    least: int
    version: str


# The base rules, in the order in which ties are listed, then those added.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, "base-1"),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, "base-1"),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, "base-1"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, "keys-1"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 1, "keys-1"),
)
VERSIONS = tuple(dict.fromkeys(r.version for r in RULES))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for a row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def scanned(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """The array of ``join`` over each beginning of ``values``: for far = 1, 2, 4, ... each value is joined with the one ``far`` places before it."""

    def step(v: Column, k: Column) -> Column:
        far = F.pow(F.lit(2), k).cast("int")
        return let(far, lambda f: F.transform(v, lambda x, i: F.when(i >= f, join(F.get(v, i - f), x)).otherwise(x)))

    def loop(v: Column) -> Column:
        # the number of binary digits of size - 1
        steps = F.sequence(F.lit(0), F.length(F.bin(F.size(v) - 1)) - 1)
        return F.when(F.size(v) > 1, F.aggregate(steps, v, step)).otherwise(v)

    return let(values, loop)


def rule_matches(text: Column, rule: Rule) -> Column:
    """chars and bytes of each match and of the gap before it, and whether it counts.

    The pieces between matches and the matches themselves alternate.
    """
    found = F.transform(
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)),
        lambda m: F.struct(F.length(m).alias("n"), F.octet_length(m).alias("b"), (F.length(F.regexp_extract(m, rule.pattern, rule.group)) >= rule.least).alias("ok")),
    )
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda g: F.struct(F.length(g).alias("n"), F.octet_length(g).alias("b")))
    steps = F.zip_with(found, gaps, lambda m, g: F.struct(m["n"].alias("n"), m["b"].alias("b"), (m["n"] + g["n"]).alias("step_n"), (m["b"] + g["b"]).alias("step_b"), m["ok"].alias("ok")))
    steps = F.filter(steps, lambda x: x["n"].isNotNull())  # the piece behind the last match
    return F.when(text.rlike(rule.pattern), steps).otherwise(F.array().cast("array<struct<n:int,b:int,step_n:int,step_b:int,ok:boolean>>"))


def all_spans(text: Column, missing: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans of every rule whose version is among ``missing``, by start, then by rule."""
    nothing = F.array().cast("array<struct<n:int,b:int,step_n:int,step_b:int,ok:boolean>>")
    parts = F.array(*[F.when(F.array_contains(missing, r.version), rule_matches(text, r)).otherwise(nothing) for r in rules])
    add = lambda x, y: F.struct((x["n"] + y["n"]).alias("n"), (x["b"] + y["b"]).alias("b"))

    def spans(part: Column, rank: Column) -> Column:
        ends = scanned(F.transform(part, lambda x: F.struct(x["step_n"].alias("n"), x["step_b"].alias("b"))), add)
        made = F.zip_with(
            part,
            ends,
            lambda x, e: F.struct((e["n"] - x["n"]).alias("start"), rank.alias("rank"), e["n"].alias("end"), (e["b"] - x["b"]).alias("head"), e["b"].alias("tail"), x["ok"].alias("ok")),
        )
        return F.transform(F.filter(made, lambda x: x["ok"]), lambda x: x.dropFields("ok"))

    return F.array_sort(F.flatten(F.transform(parts, spans))).cast(SPANS)


def blob_of(content: str) -> Column:
    """The address of a content: its SHA-256."""
    return F.unhex(F.sha2(F.encode(text_of(content), "UTF-8"), 256))


def address(history: DataFrame, path: str, content: str) -> DataFrame:
    """(path, blob) of every historical version."""
    return history.select(F.col(path).alias("path"), blob_of(content).alias("blob"))


def unseen_rows(history: DataFrame, content: str, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """The ledger rows that this history adds: blob, rule_version, spans.

    Equal contents meet in one row before the shuffle (partial aggregation), so a
    blob that a third of all paths hold costs no more than any other. With a
    ``ledger``, addresses are joined first: contents are fetched for the pairs only
    that it does not hold.
    """
    every = F.array(*[F.lit(v) for v in dict.fromkeys(r.version for r in rules)])
    rows = history.select(blob_of(content).alias("blob"), text_of(content).alias("content"))
    if ledger is None:
        unseen = rows.groupBy("blob").agg(F.first("content").alias("content")).withColumn("missing", every)
    else:
        seen = ledger.groupBy("blob").agg(F.collect_set("rule_version").alias("seen"))  # as many as rule versions
        known = rows.select("blob").distinct().join(seen, "blob", "left")
        fresh = known.select("blob", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))).alias("missing")).where(F.size("missing") > 0)
        fresh = materialize(fresh, "secret-unseen")
        few = F.broadcast(fresh) if fresh.count() <= BROADCAST_ROWS else fresh  # its rows were just counted
        unseen = rows.join(few, "blob").groupBy("blob").agg(F.first("content").alias("content"), F.first("missing").alias("missing"))
    found = unseen.select("blob", "missing", all_spans(F.col("content"), F.col("missing"), rules).alias("spans"))
    of = F.array(*[F.lit(r.version) for r in rules])
    rows = found.select("blob", F.explode("missing").alias("rule_version"), "spans")
    return rows.select("blob", "rule_version", F.filter("spans", lambda s: F.element_at(of, s["rank"] + 1) == F.col("rule_version")).alias("spans"))


def scan(history: DataFrame, path: str = "doc_id", content: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """What this history adds to ``ledger``, as a written table."""
    return materialize(unseen_rows(history, content, ledger, rules), "secret-ledger")


def record(history: DataFrame, folder: str, content: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger kept in ``folder`` (Parquet, any store), after the unseen pairs of this history were scanned and appended.

    One writer at a time: two at once would scan, and append, the same pairs.
    """
    spark = history.sparkSession
    known = spark.read.schema(LEDGER).parquet(folder) if exists(spark, folder) else None
    unseen_rows(history, content, known, rules).write.mode("append").parquet(folder)
    return spark.read.schema(LEDGER).parquet(folder)


def found_in(ledger: DataFrame, rules: tuple[Rule, ...] = RULES, history: DataFrame | None = None, content: str = "text") -> DataFrame:
    """(blob, spans) of the blobs in which the rules found something, as a written table with one row for each blob.

    With a ``history``, only of the blobs that it holds, joined by their addresses. A join with it is a join of two plain shuffles, of which the side with a hot
    blob can be split by adaptive execution.
    """
    known = ledger.where((F.size("spans") > 0) & F.col("rule_version").isin([r.version for r in rules]))
    if history is not None:
        known = known.join(history.select(blob_of(content).alias("blob")).distinct(), "blob", "left_semi")
    # pairs that two writers recorded count once; as many rows as rule versions remain
    rows = known.groupBy("blob", "rule_version").agg(F.first("spans").alias("spans")).groupBy("blob").agg(F.collect_list("spans").alias("spans"))
    return materialize(rows.select("blob", F.array_sort(F.flatten("spans")).alias("spans")), "secret-findings")


def light(found: DataFrame) -> DataFrame:
    """The findings marked for broadcast if their counted rows and spans are few, else as they are, for a shuffle join."""
    size = found.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("spans")), F.lit(0)).alias("spans")).first()
    return F.broadcast(found) if size["rows"] <= BROADCAST_ROWS and size["spans"] <= BROADCAST_SPANS else found


def attach(history: DataFrame, found: DataFrame, path: str = "doc_id", content: str = "text") -> DataFrame:
    """One row (path, spans) for every row of ``history``; spans are empty where nothing was found."""
    joined = address(history, path, content).join(light(found), "blob", "left")
    return joined.select("path", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def findings(history: DataFrame, ledger: DataFrame, path: str = "doc_id", content: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The findings of a ledger, joined back to every row (path, spans) of ``history``."""
    return attach(history, found_in(ledger, rules), path, content)


def render(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask(text: Column, spans: Column, by: str = "[SECRET]") -> Column:
    """The text with each maximal run of overlapping spans replaced by ``by``.

    A span begins a run if it begins behind all spans before it; the pieces
    between runs are cut out by their bytes, which needs no walk from the start.
    """

    def pieces(data: Column, reached: Column) -> Column:
        cuts = F.transform(spans, lambda s, i: F.struct(F.coalesce(F.get(reached, i - 1), F.lit(0)).alias("from"), s["head"].alias("to")))
        runs = F.filter(cuts, lambda c: c["to"] >= c["from"])
        texts = F.transform(runs, lambda c: F.substring(data, c["from"] + 1, c["to"] - c["from"]).cast("string"))
        rest = F.substring(data, F.element_at(reached, -1) + 1, F.length(data)).cast("string")
        return F.concat(F.array_join(texts, by), F.lit(by), rest)

    tails = scanned(F.transform(spans, lambda s: s["tail"]), F.greatest)
    return F.when(F.size(spans) > 0, let(text.cast("binary"), lambda data: let(tails, lambda reached: pieces(data, reached)))).otherwise(text)


def masked(docs: DataFrame, content: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every secret masked; all rows and columns stay.

    Reads and writes through the ledger: only blobs with findings are joined
    back, the others keep their text. A null text stays null.
    """
    with scratch() as keep:
        table = keep(found_in(scan(docs, content=content, rules=rules), rules))
    found = light(table).select(F.col("blob").alias("__blob"), F.col("spans").alias("__spans"))
    names = [f"__c{i}" for i in range(len(docs.columns))]
    body = names[docs.columns.index(content)]
    rows = docs.toDF(*names).withColumn("__key", F.unhex(F.sha2(F.encode(text_of(body), "UTF-8"), 256)))
    out = rows.join(found, F.col("__key") == F.col("__blob"), "left")
    spans = F.coalesce("__spans", F.array().cast(SPANS))
    return out.withColumn(body, F.when(F.col(body).isNotNull(), mask(F.col(body), spans))).select(*names).toDF(*docs.columns)
