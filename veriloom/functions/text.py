"""Column functions on texts, ids and verdicts. All stay in the JVM.

a docstring says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veriloom.functions.vocab import NOT_SUPPORTED, SUPPORTED, WORST_FIRST

C = Column | str


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokenize(text: C) -> Column:
    """B1: runs of ASCII letters and digits of the lower-cased text; accented letters split words."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit("([a-z0-9]+)"), 1)


def run_tokens(text: C, digits: bool = True) -> Column:
    """Words of Unicode letters (and digits) and apostrophes, apostrophes trimmed, empty ones left out."""
    inside = r"([\p{L}\p{Nd}']+)" if digits else r"([\p{L}']+)"
    return F.filter(F.transform(F.regexp_extract_all(F.lower(_c(text)), F.lit(inside), 1), lambda w: F.btrim(w, F.lit("'"))), lambda w: w != "")


def content_words(text: C, stop: tuple[str, ...] = ()) -> Column:
    """Words of [a-z0-9$%] longer than two that are not on the stop list; repeats are kept."""
    words = F.regexp_extract_all(F.lower(_c(text)), F.lit("([a-z0-9$%]+)"), 1)
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*stop) if stop else F.length(w) > 2)


def truncate_words(text: C, n: int) -> Column:
    """The first n words, followed by an ellipsis if more were there."""
    words = F.filter(F.split(_c(text), r"\s+"), lambda w: w != "")
    return F.when(F.size(words) > n, F.concat(F.array_join(F.slice(words, 1, n), " "), F.lit("…"))).otherwise(F.array_join(words, " "))


def truncate_chars(text: C, n: int) -> Column:
    """At most n characters on one line, the last an ellipsis if any were cut."""
    flat = F.replace(_c(text), F.lit("\n"), F.lit(" "))
    return F.when(F.char_length(flat) > n, F.concat(F.substring(flat, 1, n - 1), F.lit("…"))).otherwise(flat)


def norm_quote(text: C) -> Column:
    """Trimmed, lower case, curly quotes and long dashes plain, white space single."""
    folded = F.translate(F.lower(_c(text)), "’‘“”—–", "''\"\"--")
    return F.btrim(F.regexp_replace(folded, r"[\t\n\f\r ]+", " "))


def visible_text(context: C, text: C) -> Column:
    """The context, a blank line and the text; the text alone where there is no context."""
    c = _c(context)
    return F.when(F.coalesce(c, F.lit("")) != "", F.concat(c, F.lit("\n\n"), _c(text))).otherwise(_c(text))


def quote_in(quote: C, context: C, text: C) -> Column:
    """Whether a non-empty quote stands, normalised, in what is visible of a passage."""
    q = norm_quote(quote)
    return F.coalesce((q != "") & F.contains(norm_quote(visible_text(context, text)), q), F.lit(False))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, though lambdas inside refer to it again and again."""
    return F.transform(F.array(value), use)[0]


def shingles(words: Column, n: int) -> Column:
    """All runs of n words, joined by spaces; none if there are fewer words."""
    none = F.array().cast("array<string>")
    return bound(words, lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(none))


def verbatim_run(text: C, refs: Column, n: int) -> Column:
    """The first run of n words of a text that stands in a row in any of the texts ``refs``; "" if none."""
    ref_runs = F.flatten(F.transform(F.coalesce(refs, F.array().cast("array<string>")), lambda r: shingles(run_tokens(F.coalesce(r, F.lit(""))), n)))
    first = bound(ref_runs, lambda runs: F.try_element_at(F.filter(shingles(run_tokens(text), n), lambda s: F.array_contains(runs, s)), F.lit(1)))
    return F.coalesce(first, F.lit(""))


def syllables(word: C) -> Column:
    """Groups of vowels, one less for a final e if that leaves any, at least one."""
    w = F.lower(_c(word))
    groups = F.regexp_count(w, F.lit("[aeiouy]+"))
    return F.greatest(F.lit(1), groups - F.when(w.endswith("e") & (groups > 1), 1).otherwise(0))


def plain_bad_word(text: C, allowed: Column) -> Column:
    """The first word that is reader or would, or of four or more syllables and not among ``allowed``; "" if none."""
    first = bound(allowed, lambda known: F.try_element_at(F.filter(run_tokens(text, digits=False), lambda w: w.isin("reader", "would") | ((syllables(w) >= 4) & ~F.array_contains(known, w))), F.lit(1)))
    return F.coalesce(first, F.lit(""))


def contrast_word(text: C) -> Column:
    """The first of not, only, just, instead, but, or rather than; "" if none."""
    return F.coalesce(F.regexp_extract(F.lower(_c(text)), r"(?<![\p{L}'])(not|only|just|instead|but|rather than)(?![\p{L}'])", 1), F.lit(""))


def ground_verdict(verdict: C, n_verified: C) -> Column:
    """A verdict holds with a verified quote; without any, contradicted is absent and claims of support are unsupported."""
    v = _c(verdict)
    return F.when(_c(n_verified) >= 1, v).when(v == "contradicted", "absent").when(v.isin("faithful", "partial", "overstated"), "unsupported").otherwise(v)


def normalize_url(url: C) -> Column:
    """Lower-case host with port, and path without trailing slashes; scheme, query and fragment dropped."""
    u = _c(url)
    return F.concat(F.lower(F.regexp_extract(u, r"^[^:/?#]+://([^/?#]*)", 1)), F.regexp_replace(F.regexp_extract(u, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), "/+$", ""))


def passage_base(pid: C) -> Column:
    """A passage id up to its first #."""
    return F.substring_index(_c(pid), "#", 1)


def excerpt_page(pid: C) -> Column:
    """The page of a report excerpt's passage id; null for other ids."""
    return F.regexp_extract(_c(pid), r"^[^#]+#p(\d+)#\d+$", 1).try_cast("int")


def page_of_path(path: C) -> Column:
    """The number after a leading p in a path's first key, else 0."""
    return F.coalesce(F.regexp_extract(_c(path), r"^p(\d+)(?:=|/|$)", 1).try_cast("int"), F.lit(0))


def path_labels(path: C) -> Column:
    """The labels of a path ``key=Label/key=Label``, in order; a part without = is its own label."""
    parts = F.filter(F.split(_c(path), "/"), lambda p: p != "")
    return F.transform(parts, lambda p: F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise(p))


def claim_query(text: C, path: C) -> Column:
    """What a claim is searched with: its text and the labels of its path."""
    return F.btrim(F.concat_ws(" ", _c(text), F.array_join(F.coalesce(path_labels(path), F.array().cast("array<string>")), " ")))


def canonical(pid: C, reports: C | None = None) -> Column:
    """Struct (doc, locator, ok) of the document a passage id belongs to and the place within; ok is false, and both are "", for any other id.

    ``reports``, a map from file stem to file, names the files of reports; any other is its stem with ``.pdf``.
    """
    p = _c(pid)
    base, frag = passage_base(p), F.regexp_extract(p, "^[^#]*#(?s:(.*))$", 1)
    att = F.regexp_extract(base, r"^submission-[^.]*\.(.+)$", 1)
    whole = F.regexp_extract(base, r"^submission-([+-]?\d+)(?:\.|$)", 1).try_cast("long")
    number = F.regexp_extract(att, r"^([+-]?\d+)$", 1).try_cast("long")
    submission = F.when(whole.isNull() | ((att != "") & number.isNull()), None).when(att == "", F.format_string("submission:%d", whole)).otherwise(F.format_string("submission:%d/attachment-%d", whole, number))
    qon = r"^qon-(.+)-(\d{4}-\d{2}-\d{2})$"
    file = F.concat(base, F.lit(".pdf"))
    if reports is not None:
        file = F.coalesce(F.try_element_at(_c(reports), base), file)
    doc = (
        F.when((base == "") | (frag == ""), None)
        .when(base.startswith("submission-"), submission)
        .when(base.startswith("qon-"), F.when(base.rlike(qon), F.concat(F.lit("qon:"), F.regexp_extract(base, qon, 1), F.lit("/"), F.regexp_extract(base, qon, 2))))
        .when(base.startswith("leaderboards/"), F.concat(base, F.lit(".txt")))
        .when(F.contains(frag, F.lit("#")), file)
        .when(F.contains(base, F.lit("/")) & frag.startswith("t"), F.concat(F.lit("hearing:"), base))
    )
    at = F.when(doc.startswith("hearing:"), F.concat(F.lit("line "), F.substring(frag, 2, 1 << 20))).otherwise(F.concat(F.lit("p."), F.regexp_replace(F.substring_index(frag, "#", 1), "^p", "")))
    return F.struct(F.coalesce(doc, F.lit("")).alias("doc"), F.when(doc.isNotNull(), at).otherwise("").alias("locator"), doc.isNotNull().alias("ok"))


def canonical_doc(pid: C) -> Column:
    """The document a passage id belongs to, "" if to none."""
    return canonical(pid)["doc"]


def canonical_verdict(verdict: C) -> Column:
    """A verdict under the name that chains use for it."""
    return F.when(_c(verdict) == "uncorroborated", "absent").otherwise(_c(verdict))


def single_source_verdict(verdict: C, single: C) -> Column:
    """Where a corpus has a single source, what is absent elsewhere is uncorroborated."""
    return F.when(_c(single) & (_c(verdict) == "absent"), "uncorroborated").otherwise(_c(verdict))


def id_prefix(claim: C) -> Column:
    """The leading run of an id that is no digit."""
    return F.regexp_extract(_c(claim), r"^([^0-9]*)", 1)


def id_number(claim: C) -> Column:
    """The first run of digits of an id as a number, -1 without any."""
    return F.coalesce(F.regexp_extract(_c(claim), r"^[^0-9]*([0-9]+)", 1).try_cast("decimal(38,0)").cast("long"), F.lit(-1))


def id_suffix(claim: C) -> Column:
    """What follows the first run of digits, or the whole id without any."""
    c = _c(claim)
    return F.when(c.rlike("[0-9]"), F.regexp_extract(c, r"^[^0-9]*[0-9]+(.*)$", 1)).otherwise(c)


def natural_key(text: C, width: int = 20) -> Column:
    """A text that sorts naturally: each run of up to ``width`` digits padded with zeros."""
    parts = F.regexp_extract_all(_c(text), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, r"^0+(?=\d)", ""), width, "0")).otherwise(p)), "")


def spread_ratio(spread: C) -> Column:
    """``k/N`` as a number, 0 for anything else or N of 0."""
    s = _c(spread)
    k, n = F.regexp_extract(s, r"^(\d+)/(\d+)$", 1).try_cast("double"), F.regexp_extract(s, r"^(\d+)/(\d+)$", 2).try_cast("double")
    return F.coalesce(F.try_divide(k, n), F.lit(0.0))


def audit_parts(text: C) -> Column:
    """``faith=X sub=Y ev=Z`` as a map."""
    return F.str_to_map(_c(text), F.lit(" "), F.lit("="))


def verdict_side(verdict: C) -> Column:
    """Supported, not-supported, or the verdict itself for any other."""
    v = _c(verdict)
    return F.when(v.isin(*SUPPORTED), "supported").when(v.isin(*NOT_SUPPORTED), "not-supported").otherwise(v)


def worst_rank(verdict: C) -> Column:
    """The place of a verdict in the order from worst to best; unknown ones come last."""
    v = _c(verdict)
    return reduce(lambda acc, iv: F.when(v == iv[1], iv[0]).otherwise(acc), reversed(list(enumerate(WORST_FIRST))), F.lit(len(WORST_FIRST)))


def clean_verdict(raw: C) -> Column:
    """A verdict without the dirt of its spelling: case, white space, hyphens and closing marks; null if empty."""
    letters = F.regexp_replace(F.lower(_c(raw)), "[^a-z]", "")
    v = F.when(letters.startswith("partial"), "partial").when(letters.startswith("contradict"), "contradicted").when(letters.startswith("notpresent"), "absent").otherwise(letters)
    return F.nullif(v, F.lit(""))


def has_number_or_place(text: C) -> Column:
    """Any ASCII digit, or a word but the first that, without what is no ASCII letter at its ends, begins with a capital and has a small letter."""
    words = F.split(F.regexp_replace(_c(text), r"^\s+", ""), r"\s+")
    place = F.exists(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda w: F.regexp_replace(w, "^[^A-Za-z]+|[^A-Za-z]+$", "").rlike("^[A-Z].*[a-z]"))
    return F.coalesce(_c(text).rlike("[0-9]") | place, F.lit(False))


def schema_failed(reason: C) -> Column:
    """A reason that is blank or holds a tag."""
    return F.coalesce((F.btrim(_c(reason)) == "") | _c(reason).rlike(r"</?[A-Za-z][^>]*>"), F.lit(True))


def is_opinion(route: C, claim: C) -> Column:
    """An evaluative route, or an id of the form R and a digit."""
    return F.coalesce(F.lower(F.btrim(_c(route))) == "evaluative", F.lit(False)) | F.coalesce(_c(claim).rlike("^[Rr][0-9]"), F.lit(False))


def markdown_cell(text: C) -> Column:
    """A text fit for a table cell: pipes escaped, newlines as spaces."""
    return F.replace(F.replace(_c(text), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def iso_date(raw: C) -> Column:
    """A date written as 2024-05-31, 31/05/2024, 20240531 or 31 May 2024; null for anything else."""
    r = F.btrim(_c(raw))
    return (
        F.when(r.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(r, "yyyy-MM-dd")).when(r.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(r, "d/M/yyyy"))
        .when(r.rlike(r"^\d{8}$"), F.try_to_date(r, "yyyyMMdd")).when(r.rlike(r"^\d{1,2} [A-Za-z]+ \d{4}$"), F.coalesce(F.try_to_date(r, "d MMMM yyyy"), F.try_to_date(r, "d MMM yyyy")))
    )


def unit_vector(vec: C) -> Column:
    """A vector over its length; a zero vector stays as it is."""
    v = _c(vec)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return bound(norm, lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))


def dot(a: C, b: C) -> Column:
    """The inner product of two vectors of one length."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cache_key(model: C, text: C) -> Column:
    """The key of a stored embedding: SHA-256 of model, a zero character and the text."""
    return F.sha2(F.concat(_c(model), F.lit("\0"), _c(text)), 256)
