"""Secret scans by a trigram inverted index (DataFrame functions only).

Each rule's regex gives a Boolean query of trigrams that a matching text must hold. The index keeps postings (trigram,
document) for the trigrams that some query names; postings are intersected per clause, and only documents that satisfy a
clause are verified with the rule's regex. Rules without mandatory trigrams (runs of hex digits) scan every text.

NULL and empty texts have no spans. Repeated rows, and rows with a NULL id, share postings by id, which can only add
candidates; every row is verified on its own text and keeps its own result. Extra columns are ignored by :func:`scan` and
kept by :func:`redacted`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import along, ascii_lower, let
from .trigrams import trigram_query


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    value_group: int = 0
    least: int = 0  # code points that the value group has at least; shorter matches are dropped after matching


#: Base kinds first, in the order that breaks ties between spans of one start.
RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("pypi", r"pypi-[A-Za-z0-9_-]{16,}"),
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9._-]{20,}"),
)
BASE = ("assign", "access", "hex")
MASK = "[REDACTED]"


def _clauses(spark, rules: tuple[Rule, ...]) -> DataFrame:
    """(trigram, rule, clause, size): as many rows as the rule list has trigrams."""
    rows = [(g, r.kind, n, len(c)) for r in rules for n, c in enumerate(trigram_query(r.regex)) for g in sorted(c)]
    return spark.createDataFrame(rows, "trigram string, rule string, clause int, size int")


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(trigram, doc_id) of every trigram that a rule's query names and the lower-cased text holds."""
    wanted = sorted({g for r in rules for c in trigram_query(r.regex) for g in c})
    low = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    held = let(low, lambda t: F.array_compact(F.array(*[F.when(F.contains(t, F.lit(g)), F.lit(g)) for g in wanted])))
    return docs.select("doc_id", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(__cand_id, __cand_rules): the rules whose query a document satisfies, by intersecting postings."""
    clauses = _clauses(docs.sparkSession, rules)
    hits = postings(docs, rules).join(F.broadcast(clauses), "trigram").groupBy("doc_id", "rule", "clause", "size").agg(F.collect_set("trigram").alias("g"))
    return hits.filter(F.size("g") == F.col("size")).groupBy(F.col("doc_id").alias("__cand_id")).agg(F.collect_set("rule").alias("__cand_rules"))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Leftmost matches of one rule that do not overlap: structs of start, order, end in code points."""
    rx = F.lit(rule.regex)
    all_of = F.struct(
        F.regexp_extract_all(text, rx, F.lit(0)).alias("m"),
        F.regexp_extract_all(text, rx, F.lit(rule.value_group)).alias("v"),
        F.split(text, rule.regex, -1).alias("between"),
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def step(b: Column):
        def add(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(b["between"][i])
            end = start + F.length(b["m"][i])
            one = F.array(F.struct(start.alias("start"), F.lit(order).alias("kind"), end.alias("end")))
            good = F.length(b["v"][i]) >= rule.least
            return F.struct(end.alias("at"), F.when(good, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

        return add

    def walk(b: Column) -> Column:
        return along(F.size(b["m"]), "struct<start:int,kind:int,end:int>", step(b))

    return F.when(F.rlike(text, rx), let(all_of, walk)).otherwise(none)


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with ``__spans``: all spans, sorted by start and then by the rules' order."""
    rows = docs.join(candidates(docs, rules), F.col("doc_id").eqNullSafe(F.col("__cand_id")), "left")
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = []
    for n, rule in enumerate(rules):
        spans = _spans(text, rule, n)
        if trigram_query(rule.regex):
            spans = F.when(F.array_contains("__cand_rules", rule.kind), spans).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))
        parts.append(spans)
    return rows.withColumn("__spans", F.array_sort(F.concat(*parts))).select(*docs.columns, "__spans")


def _listed(spans: Column, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: counts of the base kinds, the digest of their spans, and all spans."""
    base = [n for n, r in enumerate(rules) if r.kind in BASE]
    rows = find(docs.select("doc_id", "text"), rules)
    count = lambda n: F.size(F.filter("__spans", lambda s: s["kind"] == n)).cast("long")
    of_base = F.filter("__spans", lambda s: s["kind"].isin(base))
    return rows.select("doc_id", *[count(n).alias(f"n_{rules[n].kind}") for n in base], F.sha2(_listed(of_base, rules), 256).alias("base_sha256"), _listed(F.col("__spans"), rules).alias("spans"))


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = MASK) -> DataFrame:
    """docs with every span of ``text`` replaced by ``mask``; spans that overlap share one mask. n_chars follows the text."""
    text = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    masked = F.aggregate("__spans", zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    rows = find(docs, rules).withColumn("text", F.when(F.size("__spans") > 0, masked).otherwise(text))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.size("__spans") > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)
