"""The evidence gate against plain loops over the same claims, references and papers."""

import collections
import re

from scholia_spark.functions import patterns
from scholia_spark.operators import evidence as E
from scholia_spark.plans import evidence as P


def numbers(text):
    return set(re.findall(patterns.EVIDENCE_NUMBER, text))


def value(token):
    return float(token.rstrip("%"))


def same(token, pool):
    forms = lambda v: {f"{v:.5e}", f"{(v / 100 if v > 1 else v * 100):.5e}"}
    v, places = value(token), len(token.rstrip("%").partition(".")[2])
    return any(forms(v) & forms(value(p)) or abs(value(p) - v) <= 0.5 * 10**-places + 1e-9 for p in pool)


def squeeze(text):
    return " ".join((text or "").split())


def key(paper):
    return re.sub(r"^(.+)v\d+$", r"\1", re.sub("^arxiv:", "", paper.strip().lower()))


def plain_gate(items, refs, sources, blocks):
    by_id = {s["paper_id"]: s for s in sources}
    by_key = {}
    for p in sorted(by_id, reverse=True):
        by_key[key(p)] = by_id[p]
    at = {(b["paper_id"], b["anchor"]): (b["anchor_type"], squeeze(b["block_text"])) for b in blocks}

    def judge(r):
        if r["malformed"]:
            return "malformed_ref", set()
        paper = (r["paper_id"] or "").strip()
        s = paper and (by_id.get(paper) or by_key.get(key(paper)))
        if not s:
            return "unknown_paper", set()
        scope = r["scope"] if r["scope"] == "figure" else "abstract" if s["scope"] == "abstract" else r["scope"] or "fulltext"
        anchor, quote = (r["anchor"] or "").strip(), squeeze(r["quote"])
        kind, block = at.get((s["paper_id"], anchor), (None, ""))
        if scope == "abstract":
            if anchor:
                return "anchor_on_abstract", set()
        elif not anchor:
            return ("figure_anchor_required" if scope == "figure" else "anchor_missing"), set()
        elif kind is None:
            return "anchor_not_found", set()
        elif scope == "figure" and kind != "figure":
            return "anchor_type_mismatch", set()
        if scope != "figure":
            for code, bad in (("missing_quote", not quote), ("quote_too_short", len(quote) < 20), ("quote_not_verbatim", quote not in s["text"]), ("quote_outside_anchor", scope == "fulltext" and quote not in block)):
                if bad:
                    return code, set()
        return None, numbers(quote) | (numbers(s["text"]) if scope == "figure" else set())

    of = collections.defaultdict(list)
    for r in refs:
        of[r["item_id"]].append((r["side"], *judge(r)))
    out = {}
    for i in items:
        statement, got = squeeze(i["statement"]), of[i["item_id"]]
        if not statement:
            out[i["item_id"]] = (0, 0, [], "empty_statement", False)
            continue
        sides = collections.Counter(side for side, code, _ in got if code is None)
        pool = set().union(*[n for side, code, n in got if code is None and side == "supporting"])
        reason = "no_supporting" if not sides["supporting"] else None if all(same(t, pool) for t in numbers(statement)) else "number_not_grounded"
        out[i["item_id"]] = (sides["supporting"], sides["conflicting"], sorted(c for _, c, _ in got if c), reason, reason is None)
    return out


def check(spark, items, refs, sources, blocks):
    gated = E.evidence_gate(items, E.judge_refs(refs, sources, blocks))
    got = {r["item_id"]: tuple(r)[1:] for r in gated.collect()}
    want = plain_gate(*[[r.asDict() for r in df.collect()] for df in (items, refs, sources, blocks)])
    assert got == want
    return gated, want


def test_gate_on_documents(spark, sf_dir):
    gated, want = check(spark, *P._gate_inputs(spark, sf_dir))
    codes = collections.Counter(c for w in want.values() for c in [*w[2], *([w[3]] if w[3] else [])])
    assert set(codes) == {*E.REF_CODES, *E.CLAIM_CODES}
    assert {r["code"]: r["n"] for r in E.rejection_counts(gated).collect()} == codes


def test_numbers_of_claims(spark):
    text = squeeze("Our model CASP14 reaches 95.34 % here and a share of 0.25 over 1,200 samples, that is 12.0% more than the 2020 run.")
    claims = ["it has 95.3", "a quarter, 25%", "gains of 12%", "0.12 more", "20 runs", "in 14 cases", "of 1,200 samples", "none at all", "it has 95.4", "2020.4", "0.2534"]
    items = spark.createDataFrame(list(enumerate(claims)), "item_id long, statement string")
    refs = spark.createDataFrame([(i, "supporting", 0, "arXiv:P1v3", text, None, "abstract", False) for i in range(len(claims))], "item_id long, side string, ref_no int, paper_id string, quote string, anchor string, scope string, malformed boolean")
    sources = spark.createDataFrame([("p1", "abstract", text)], "paper_id string, scope string, text string")
    blocks = spark.createDataFrame([], "paper_id string, anchor string, anchor_type string, block_text string")
    _, want = check(spark, items, refs, sources, blocks)
    assert [w[4] for w in want.values()] == [True, True, True, True, False, False, True, True, False, False, False]
