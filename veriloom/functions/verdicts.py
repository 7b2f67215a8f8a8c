"""Column functions that derive wording, classes and checks from verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veriloom.functions import text as T

# The sentences and reasons that reports carry, and how claims name their witness.
DIFFERS, ALONE = ("The report says ", ". The source only says ", "."), ("The report says ", ". No held source says this.")
FORECAST = "forecast — projections are not evidence"
NOTHING_RETRIEVED = "no sources retrieved; verdict is model self-report"
NOTHING_CITED = "no URLs cited in response"
NOT_RETRIEVED = "claimed sources not present in retrieval"
# Fixed value: a claim's attribution, by a name of two or three words.
WITNESS = r"[Aa]ccording to ([A-Z][a-z]+(?: [A-Z][a-z]+){1,2})|([A-Z][a-z]+(?: [A-Z][a-z]+){1,2}) (?:of|said|told|argued|noted|stated)"

C = Column | str


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _filled(x: C) -> Column:
    return F.nullif(F.btrim(F.coalesce(_c(x), F.lit(""))), F.lit(""))


def stakes(verdict: C, report_says: C, source_says: C) -> Column:
    """One sentence on what is at stake; "" for verdicts that hold and where a half that is needed is empty."""
    v, r, s = _c(verdict), _filled(report_says), _filled(source_says)
    differs = F.concat(F.lit(DIFFERS[0]), r, F.lit(DIFFERS[1]), s, F.lit(DIFFERS[2]))
    alone = F.concat(F.lit(ALONE[0]), r, F.lit(ALONE[1]))
    return F.coalesce(F.when(v.isin("partial", "overstated", "contradicted"), differs).when(v.isin("absent", "unsupported"), alone), F.lit(""))


def cross_checked(verdict: C, horizon: C, cited: C, retrieved: C, reason: C | None = None) -> Column:
    """A struct (verdict, original, reason, matched) of a verdict held against what was retrieved.

    A forecast can't be verified. Nor can a verdict without anything retrieved, without anything cited,
    or whose citations are not among what was retrieved; addresses are compared normalised. Verdicts
    that are unverifiable, errors or already downgraded stay as they are.
    """
    v, why = _c(verdict), _filled(reason if reason is not None else F.lit(""))
    none = F.array().cast("array<string>")
    seen = F.transform(F.coalesce(_c(retrieved), none), lambda u: T.normalize_url(u))
    matched = F.size(F.filter(F.coalesce(_c(cited), none), lambda u: F.array_contains(seen, T.normalize_url(u))))
    future = (F.coalesce(_c(horizon), F.lit("")) == "future") & (v != "error")
    kept = v.isin("unverifiable", "error") | why.isNotNull()
    fault = (
        F.when(future, FORECAST).when(kept, F.coalesce(why, F.lit(""))).when(F.size(seen) == 0, NOTHING_RETRIEVED)
        .when(F.size(F.coalesce(_c(cited), none)) == 0, NOTHING_CITED).when(matched == 0, NOT_RETRIEVED).otherwise("")
    )
    down = future | (~kept & (fault != ""))
    return F.struct(F.when(down, "unverifiable").otherwise(v).alias("verdict"), F.when(down & (v != "unverifiable"), v).alias("original"), fault.alias("reason"), F.when(~kept & ~future, matched).otherwise(0).alias("matched"))


def intended(verdict: C, claim: C, source_says: C) -> Column:
    """What the source says where the claim goes beyond it, else the claim."""
    return F.when(_c(verdict).isin("partial", "overstated"), F.coalesce(_filled(source_says), _c(claim))).otherwise(_c(claim))


def page_class(route: C, claim: C, stability: C, failed: C, verdict: C) -> Column:
    """The class under which a report lists a claim, first match."""
    v = _c(verdict)
    return (
        F.when(T.is_opinion(route, claim), "opinion").when(F.coalesce(_c(stability), F.lit("")) == "contested", "contested").when(F.coalesce(_c(failed), F.lit(False)), "schema-fail")
        .when(v == "faithful", "holds").when(v.isin("contradicted", "overstated", "unverifiable"), v).when(v == "partial", "generalised").otherwise("unsupported")
    )


def named_witness(text: C) -> Column:
    """The last name of whom a claim attributes itself to; "" for nobody."""
    name = F.concat(F.regexp_extract(_c(text), WITNESS, 1), F.regexp_extract(_c(text), WITNESS, 2))  # of the leftmost match, which has one of them
    return F.coalesce(F.element_at(F.split(name, " "), -1), F.lit(""))


def route_or(own: C, other: C) -> Column:
    """A route, or the other one where it is blank."""
    return F.coalesce(_filled(own), _c(other))


def cited_ids(cites: C) -> Column:
    """Document ids between commas, spaces and tabs."""
    return F.filter(F.split(_c(cites), r"[, \t]+"), lambda x: x != "")


def cited_bases(cites: C) -> Column:
    """The passage bases that cited ids stand for: papers by name, text files by stem; report files are left out."""
    ids = F.filter(cited_ids(cites), lambda x: ~x.rlike(r"^report.*\.txt$"))
    return F.transform(ids, lambda x: F.regexp_replace(F.regexp_replace(x, "^paper:", "papers/"), r"\.txt$", ""))


def hit_rate(read: C, created: C) -> Column:
    """What was read over all that was read or created; 0 for nothing."""
    return F.coalesce(F.try_divide(_c(read), _c(read) + _c(created)), F.lit(0.0))
