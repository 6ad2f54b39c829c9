import hashlib
import re

from corpus import documents, frame, result

from verdure.llm import secrets
from verdure.llm.trigrams import can_match, trigram_query


def brute(text):
    spans = []
    for n, r in enumerate(secrets.RULES):
        for m in re.finditer(r.regex, text or ""):
            if len(m.group(r.value_group)) >= r.least:
                spans.append((m.start(), n, m.end()))
    spans.sort()
    show = lambda some: ",".join(f"{secrets.RULES[k].kind}:{s}:{e}" for s, k, e in some)
    return {
        **{f"n_{k}": sum(secrets.RULES[x[1]].kind == k for x in spans) for k in secrets.BASE},
        "base_sha256": hashlib.sha256(show([x for x in spans if secrets.RULES[x[1]].kind in secrets.BASE]).encode()).hexdigest(),
        "spans": show(spans),
    }


def test_scan_equals_brute_force(spark):
    got = result(secrets.scan(frame(spark)))
    want = sorted(({"doc_id": r[0], **brute(r[1])} for r in documents()), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, str(r)))
    assert got == want
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[11]["n_assign"] == 2 and by_id[11]["n_access"] == 1 and by_id[11]["n_hex"] == 1
    assert "secret:" not in by_id[12]["spans"] and "github:" in by_id[12]["spans"]


def test_redaction_masks_spans_and_keeps_columns(spark):
    docs = frame(spark)
    got = {r["doc_id"]: r for r in result(secrets.redacted(docs))}
    assert secrets.redacted(docs).columns == docs.columns
    assert got[11]["text"] == '[REDACTED] [REDACTED]" [REDACTED]' and got[11]["n_chars"] == 33
    assert got[4]["text"] is None and got[15]["text"].startswith("z0 z1")


def test_trigram_queries():
    assert trigram_query(r"[0-9a-f]{24,}") == []
    assert frozenset({"aki", "kia"}) in trigram_query(r"AKIA[A-Z0-9]{16,}")
    assign = trigram_query(secrets.RULES[0].regex)
    assert frozenset({"tok", "oke", "ken"}) in assign and frozenset({"api", "pi_", "i_k", "_ke", "key"}) in assign
    assert can_match("my PassWord here", assign) and not can_match("nothing of the kind", assign)


def test_empty_table(spark):
    assert secrets.scan(frame(spark, [])).count() == 0


def test_no_python_in_the_plan(spark):
    plan = secrets.scan(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_many_matches_in_one_text(spark):
    text = " ".join(f"token={i:08x}" for i in range(4000)) + " " + "f" * 30
    got = result(secrets.scan(frame(spark, [(1, text, "en", "a", 0), (2, text[:2000], "en", "a", 0)])))
    assert got == [{"doc_id": 1, **brute(text)}, {"doc_id": 2, **brute(text[:2000])}] and got[0]["n_assign"] == 4000
