"""Noise in text from scanned pages repaired into continuous paragraphs (problem 6).

1. Word pairs are counted over all texts, scanned or not; the lexicon is their sum.
2. Lines that are no part of the paragraph are page marks by shape, and running heads: titles in
   capitals, titles led or followed by a page number, numbered titles, and titles that recur over
   the pages of their document, also when misread.
3. The other lines are joined. A word broken across lines is the form, with or without the hyphen,
   that the lexicon knows best.
4. Words that the lexicon does not know meet it in a symmetric index: both sides, with letters
   that scanners confuse folded together, are joined on themselves, on each form with one letter
   deleted, and on each form with two (readings) or one (right forms) of the other confusion pairs
   replaced. A weighted edit distance ranks the candidates: up to three confusion pairs, or one
   other edit. The word pairs with the neighbours on both sides pick the repair. Where the letters
   alone prove little, in numbers, in words of one or two letters and for an edit that is no
   confusion, a repair must form known pairs with both neighbours, and a number must be rarer than
   it after the word before.

The commonest words, at most ``COMMON``, are sent to all tasks to keep known words out of the
shuffle; every other word is looked up by join, so that bound changes no result.

Defined cases: null and empty texts give nothing; a text of one line keeps it unless it is a page
mark or head; a hyphen at the end of the last line joins nothing; unknown words without a candidate
stay as they are, as do words that differ from known ones in accents alone; equal candidates tie to the more frequent, then the smaller; repeated deliveries
are one record, the last to come holding; extra columns are ignored.
"""

from __future__ import annotations

import re
import string
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.llm.lookalike import PLAIN, by_table
from veriloom.llm.records import one_per_record
from veriloom.sources.tables import checkpointed

# Pairs that scanners confuse, right form and reading.
CONFUSIONS = [
    ("o", "0"), ("l", "1"), ("i", "1"), ("i", "l"), ("l", "i"), ("s", "5"), ("b", "8"), ("b", "6"), ("g", "9"), ("z", "2"), ("e", "c"), ("c", "e"),
    ("t", "f"), ("f", "t"), ("g", "q"), ("q", "g"), ("a", "@"), ("h", "b"), ("b", "h"), ("n", "u"), ("u", "n"), ("v", "y"), ("y", "v"), ("a", "o"), ("o", "a"),
    ("i", "j"), ("i", "!"), ("l", "!"), ("l", "|"), ("i", "|"), ("e", "o"), ("o", "e"), ("s", "$"), ("t", "r"), ("r", "t"),
    ("m", "rn"), ("rn", "m"), ("n", "ri"), ("ri", "n"), ("u", "ii"), ("ii", "u"), ("d", "cl"), ("cl", "d"), ("h", "li"), ("li", "h"), ("w", "vv"), ("vv", "w"),
    ("m", "nn"), ("nn", "m"), ("m", "in"), ("in", "m"), ("m", "ni"), ("ni", "m"), ("k", "lc"), ("lc", "k"), ("fi", "fl"), ("fl", "fi"), ("u", "li"), ("n", "ii"),
]
#: The cost of a confusion pair and of any other edit, and the reach: up to three confusions, or one other edit.
CHEAP, EDIT, REACH = 0.3, 0.85, 0.9
#: A title is a running head if it recurs unmarked on so many pages of its document, or is marked as one on any.
HEAD_PAGES = 4
#: Tasks over which the lines with one head are spread.
SALTS = 32
#: Times in unscanned text that make a word known; how much more frequent a repair must be; commonest words sent to tasks.
KNOWN, RATIO, COMMON = 2, 3, 50_000
#: The longest line that may be a page mark.
MARK_MOST = 40
HYPHENS = "-‐‑¬­"
IGNORABLE = "­​‌‍⁠﻿"
#: What stands between words, and the same for texts of plain letters. Letters one by one are one look in a table, ranges are not.
NO_WORD, NO_PLAIN_WORD = r"[^\p{L}\p{N}@!|$'’-]+", f"[^{string.ascii_lowercase}{string.digits}@!|$'-]+"
#: A word, and the same for small plain letters.
TOKEN, PLAIN_TOKEN = (re.compile(rf"[@!|$]?{x}+(?:[{y}@!|$](?:(?<=[{y}])[@!|$])?{x}+)*") for x, y in ((r"[^\W_]", "-'’"), ("[a-z0-9]", "-'")))
#: Common signs beyond ASCII that are in no word; and any character that the tables may change.
SIGNS, SUSPECT = re.compile("[\u00ad\u00ac\u2010\u2011\u2013\u2014\u2018\u201c\u201d\u2022\u2026]"), re.compile(f"[^{PLAIN}]")
_DECO = r"[\s\[\](){}<>|–—\-~*]*"
ROMAN = r"(?=[ivxlcdm])m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
PAGE_MARK = re.compile(rf"^{_DECO}(?:p(?:age|\.)?\s*)?(?:[0-9][0-9lOI]{{0,3}}|{ROMAN})(?:\s+of\s+[0-9][0-9lOI]{{0,3}})?{_DECO}$", re.I)
PAGE_WORD = re.compile(rf"^{_DECO}(?:page|paqe|pago)\s+[0-9lOI]{{1,4}}(?:\s+of\s+[0-9lOI]{{1,4}})?{_DECO}$", re.I)
NUMBERED = re.compile(r"^\W*(?:[0-9]{1,4}\s+)?[^\W\d][\w@]*\s+[0-9]{1,4}\s*:\s+\S", re.U)
NO_TITLE_END, NO_LETTER = ".,;:?!" + HYPHENS, re.compile(r"[^\w@]")
SPACED_NUMBER, BARRED_NUMBER = re.compile(r"^\s*[0-9]{1,4}\s{2,}\S"), re.compile(r"\s\|\s+[0-9]{1,4}\s*$")
LAST_PART = re.compile(r"[^\W_][\w@'’-]*$")
EDGE_NUMBER = re.compile(r"^\s*[0-9]{1,4}(?=[\s|])\W*|\W*(?<=[\s|])[0-9]{1,4}\s*$")


_FOLDED = str.maketrans("0@o1!|ij5$869cqfbvu2r", "eaelllllsshhgegthynzt")


def fold(word: str) -> str:
    """A word with the single letters that scanners confuse made one."""
    return word.translate(_FOLDED)


def _put(word: str, by: dict[str, list[str]], times: int) -> set[str]:
    """The word and each form of it with up to ``times`` separate runs of letters replaced as ``by`` says."""
    out, open_ = {word}, [("", 0, times)]
    while open_:
        done, i, left = open_.pop()
        for j in range(i, len(word)):
            for k in (1, 2):
                for to in by.get(word[j : j + k], ()) if j + k <= len(word) else ():
                    form = done + word[i:j] + to
                    out.add(form + word[j + k :])
                    if left > 1:
                        open_.append((form, j + k, left - 1))
    return out


@lru_cache(maxsize=1)
def _unfolded() -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    """The confusion pairs that folding leaves apart: readings to right forms, and the reverse."""
    back: dict[str, list[str]] = {}
    forth: dict[str, list[str]] = {}
    for right, read in CONFUSIONS:
        if fold(right) != fold(read):
            back.setdefault(read, []).append(right)
            forth.setdefault(right, []).append(read)
    return back, forth


def confusion_keys(word: str, read: bool) -> set[str]:
    """The folded forms under which a reading and a right form within ``REACH`` meet.

    Of the up to three confusion pairs between them that folding leaves apart, two are put right in
    the reading and one is made in the right form. For the one other edit, each form with one letter
    deleted is a key of both.
    """
    back, forth = _unfolded()
    keys = {fold(x) for x in (_put(word, back, 2) if read else _put(word, forth, 1))}
    return keys | {"-" + word[:i] + word[i + 1 :] for i in range(len(word))} | {"-" + word}


def clean_page(text: str) -> str:
    """A page's text in the one form of look-alike characters, lines and soft hyphens at line ends kept."""
    if text.isascii() or not SUSPECT.search(text):
        return text
    return "\n".join(line if line.isascii() or not SUSPECT.search(line) else by_table(line) + ("\u00ad" if line.rstrip().endswith("\u00ad") and "\n" in text else "") for line in text.split("\n"))


@lru_cache(maxsize=1)
def _confusions() -> dict[str, list[str]]:
    by: dict[str, list[str]] = {}
    for right, read in CONFUSIONS:
        by.setdefault(read, []).append(right)
    return by


def distance(read: str, right: str, limit: float = REACH) -> float:
    """The weighted edit distance of a reading from a right form; beyond ``limit`` any greater number."""
    if abs(len(read) - len(right)) > 3:
        return limit + 1
    by = _confusions()
    n, m = len(read), len(right)
    rows = [[0.0] * (m + 1) for _ in range(n + 1)]
    for j in range(m + 1):
        rows[0][j] = j * EDIT
    for i in range(1, n + 1):
        row, a = rows[i], read[i - 1]
        row[0] = i * EDIT
        subs = [(1, r) for r in by.get(a, ())] + ([(2, r) for r in by.get(read[i - 2 : i], ())] if i > 1 else [])
        for j in range(1, m + 1):
            best = rows[i - 1][j - 1] if a == right[j - 1] else min(rows[i - 1][j - 1], rows[i - 1][j], row[j - 1]) + EDIT
            for k, r in subs:
                if j >= len(r) and right.startswith(r, j - len(r)):
                    best = min(best, rows[i - k][j - len(r)] + CHEAP)
            row[j] = best
    return rows[n][m]


def head_key(line: str) -> str | None:
    """The key of a line that may be a running head: its letters folded, numbers at the ends left out."""
    line = line.strip()
    # What ends as a sentence or broken word, or begins small, is none, with or without numbers.
    if not line or line[-1] in NO_TITLE_END or line[0].islower() and line[0] != "l":
        return None
    bare = (EDGE_NUMBER.sub("", line) if line[0] in string.digits or line[-1] in string.digits else line).strip(" \t|–—-[]")
    if not bare or bare[-1] in NO_TITLE_END or not (bare[0].isupper() or bare[0].isdigit() or bare[0] == "l") or len(bare.split(None, 1)) < 2:
        return None
    return fold(NO_LETTER.sub("", bare.lower())) or None


def marked(line: str) -> bool:
    """Whether a line has the look of a running head: capitals throughout, or a page number at an end of a title."""
    letters = sum(map(str.isalpha, line))
    if letters >= 6 and (line.isupper() or sum(map(str.isupper, line)) >= 0.9 * letters):
        return True
    return bool(SPACED_NUMBER.match(line) or "|" in line and BARRED_NUMBER.search(line))


def nearly(a: str, b: str, region: int = 3) -> bool:
    """Whether two keys are equal but for one region of a few letters, as a misreading leaves."""
    n = min(len(a), len(b))
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return max(len(a), len(b)) - i - j <= region


def halves(key: str, region: int = 3) -> list[str]:
    """Parts of a key of which two keys that are :func:`nearly` equal share one, named by length and end."""
    out = []
    for most in range(len(key), len(key) + region + 1):
        n = max(1, (most - region + 1) // 2)
        out += [f"{most}<{key[:n]}", f"{most}>{key[-n:]}"]
    return out


def noise_lines(text: str, heads: set[int]) -> list[bool]:
    """For each line of a text, whether it is no part of the paragraph; ``heads`` are the numbers of its running heads."""
    out = []
    for no, line in enumerate(text.split("\n")):
        if not line.strip():
            out.append(False)
        elif len(line) <= MARK_MOST and (PAGE_MARK.match(line) or PAGE_WORD.match(line)):
            out.append(True)
        else:
            key = head_key(line)
            out.append(no in heads or key is not None and (marked(line) or bool(NUMBERED.match(line))))
    return out


def joined_paragraph(text: str, noise: list[bool]) -> tuple[str, list[tuple[int, str, str]]]:
    """The paragraph with its lines joined, and the broken words: (place, first part, second part).

    At the place of a broken word the text holds both parts with a soft hyphen between them.
    """
    out, broken = "", []
    for line, bad in zip(text.split("\n"), noise):
        line = line.strip()
        if bad or not line:
            continue
        if out and out[-1] in HYPHENS and len(out) > 1 and out[-2].isalnum() and line[0].isalnum():
            before = out[:-1].rstrip()
            a = LAST_PART.search(before, before.rfind(" ") + 1)
            b = TOKEN.match(line) or re.match(r"\w+", line)
            if a and b:
                broken.append((a.start(), a[0], b[0]))
                out = out[:-1] + "­" + line
                continue
        out = f"{out} {line}" if out else line
    return out, broken


def words_beside(text: str, known: frozenset[str]) -> Iterator[tuple[int, int, str, str, str]]:
    """The words of a text that are not known: start, end, word, the word before and the one after."""
    # Places are looked up for these alone, as most words are known.
    flat = text if text.isascii() else SIGNS.sub(" ", text)
    plain = flat.isascii()
    pattern, flat = (PLAIN_TOKEN, flat.lower()) if plain else (TOKEN, flat)
    words = pattern.findall(flat)
    if not plain:
        words = list(map(str.lower, words))
    found, at = pattern.finditer(flat), 0
    for i, w in enumerate(words):
        if w not in known:
            s, e = next(islice(found, i - at, None)).span()
            at = i + 1
            yield s, e, w, words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else ""


def pair_counts(texts: DataFrame) -> DataFrame:
    """Neighbouring words counted over all texts (text, scanned): w1, w2, n, clean."""
    # Split rather than matched, which costs half; words that begin with a digit sort before letters and fall out.
    bare = F.when(reduce(Column.__or__, (F.col("text").contains(c) for c in IGNORABLE)), F.translate("text", IGNORABLE, "")).otherwise(F.col("text"))
    words = F.when(F.octet_length("text") == F.length("text"), F.split(F.lower("text"), NO_PLAIN_WORD)).otherwise(F.split(F.lower(bare), NO_WORD))
    rows = texts.where("text is not null").select((~F.col("scanned")).cast("int").alias("c"), words.alias("w"))
    pairs = rows.select("c", F.explode(F.arrays_zip(F.col("w").alias("w1"), F.slice("w", 2, F.size("w")).alias("w2"))).alias("p")).where("p.w1 >= 'a'")
    return pairs.select("c", "p.w1", F.when(F.col("p.w2") >= "a", F.col("p.w2")).otherwise("").alias("w2")).groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("clean"))


def running_heads(scans: DataFrame) -> DataFrame:
    """The lines of each page that hold a running head of its document, also when misread: rec, heads.

    Lines meet the heads of their document by join, on the folded key and, for keys of ten letters
    or more, on the parts that a nearly equal key shares; no document's heads are gathered anywhere.
    """
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [
                (rec, doc, no, k, marked(line))
                for rec, doc, text in zip(b["rec"], b["doc"], map(clean_page, b["text"]))
                for no, line in enumerate(text.split("\n"))
                if line.strip() and (k := head_key(line)) is not None
            ]
            yield pd.DataFrame(rows, columns=["rec", "doc", "line", "key", "marked"])

    lines = checkpointed(scans.where("doc is not null").select("rec", "doc", "text").mapInPandas(find, "rec string, doc string, line int, key string, marked boolean"))
    # Pages are counted, not lines, as a title may stand twice on one page.
    often = checkpointed(lines.groupBy("doc", "key", "rec").agg(F.max("marked").alias("m")).groupBy("doc", "key").agg(F.count(F.lit(1)).alias("n"), F.max("m").alias("m")).where(f"n >= {HEAD_PAGES} or m").select("doc", "key"))
    salt = F.pmod(F.xxhash64("rec"), F.lit(SALTS)).cast("int").alias("salt")
    spread = often.select("doc", "key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("known"))
    met = lines.select("rec", "doc", "line", "key", salt).join(spread, ["doc", "key", "salt"], "left")

    def parted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*x, p) for x in b.itertuples(index=False, name=None) if len(x[-1]) >= 10 for p in halves(x[-1])]
            yield pd.DataFrame(rows, columns=[*b.columns, "part"])

    # Misread keys, each once for a document, however many lines have it. Parts and keys go as hashes,
    # a fraction as large; the keys come back by join, and are compared whole.
    other = met.where("known is null and length(key) >= 10").select("doc", "key").distinct()
    part, name = F.xxhash64("doc", "part").alias("part"), F.xxhash64("doc", "key").alias("name")
    near = (
        other.mapInPandas(parted, "doc string, key string, part string").select(part, name)
        .join(often.select("doc", F.col("key").alias("head")).mapInPandas(parted, "doc string, head string, part string").select(part, "doc", "head"), "part")
        .select("name", "doc", "head").distinct()
    )
    close = other.select("doc", "key", name).join(near, ["name", "doc"]).select("doc", "key", "head")

    def checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[nearly(x, y) for x, y in zip(b["key"], b["head"])]][["doc", "key"]]

    misread = close.mapInPandas(checked, "doc string, key string").distinct()
    found = met.where("known").select("rec", "line").unionByName(met.where("known is null").join(misread, ["doc", "key"], "left_semi").select("rec", "line"))
    return found.groupBy("rec").agg(F.collect_set("line").alias("heads"))


PARTS = "rec string, kind string, pos int, a string, b string, prev string, next string"


def page_parts(scans: DataFrame, heads: DataFrame, common: frozenset[str]) -> DataFrame:
    """Noise lines, broken words and uncommon words of each page of scans (rec, doc, text)."""
    shared = scans.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            rows: list[tuple] = []
            for rec, text, hs in zip(batch["rec"], map(clean_page, batch["text"]), batch["heads"]):
                noise = noise_lines(text, set(map(int, hs)) if hs is not None else set())
                rows.extend((rec, "line", i, None, None, None, None) for i, bad in enumerate(noise) if bad)
                para, broken = joined_paragraph(text, noise)
                rows.extend((rec, "joined", at, a.lower(), b.lower(), None, None) for at, a, b in broken)
                skip = {at + len(a) for at, a, _ in broken}
                rows.extend((rec, "word", s, w, None, prev, next_) for s, e, w, prev, next_ in words_beside(para, known) if e not in skip and s - 1 not in skip)
            yield pd.DataFrame(rows, columns=["rec", "kind", "pos", "a", "b", "prev", "next"])

    return scans.join(heads, "rec", "left").select("rec", "text", "heads").mapInPandas(run, PARTS)


def bare(word: str) -> str:
    """A word without its accents."""
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def candidates(unknown: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Repairs of unknown words (w, n) from known ones (c, n): w, c, cost, n; by a join on the keys of both.

    Keys go as hashes, half as large: two that share one by chance are told apart by the distance.
    """
    def keyed(name: str, read: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = [(k, w, n) for w, n in zip(b[name], b["n"]) for k in confusion_keys(w, read)]
                yield pd.DataFrame(rows, columns=["key", name, "n"])
        return run

    left = unknown.select("w", "n").mapInPandas(keyed("w", True), "key string, w string, n long").select(F.xxhash64("key").alias("key"), "w", F.col("n").alias("nw"))
    right = lexicon.select("c", "n").mapInPandas(keyed("c", False), "key string, c string, n long").select(F.xxhash64("key").alias("key"), "c", "n")
    met = left.join(right, "key").where(F.col("n") >= RATIO * F.col("nw")).select("w", "c", "n").distinct()

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            # Words that differ in accents alone are different words, not readings of each other.
            yield b.assign(cost=[distance(w, c) if bare(w) != bare(c) else REACH + 1 for w, c in zip(b["w"], b["c"])])

    return met.mapInPandas(weigh, "w string, c string, n long, cost double").where(F.col("cost") <= REACH)


def repairs(texts: DataFrame, scans: DataFrame) -> DataFrame:
    """All findings: rec, noise (line, joined, word), pos, item, read.

    ``texts`` (rec, ord, text, scanned) are all texts for the counts, ``scans`` (rec, ord, doc, text)
    the pages to repair.
    """
    pairs = checkpointed(pair_counts(texts))
    lexicon = checkpointed(pairs.groupBy(F.col("w1").alias("c")).agg(F.sum("n").alias("n"), F.sum("clean").alias("clean")))
    good = lexicon.where(F.col("clean") >= KNOWN)
    common = frozenset(r["c"] for r in good.orderBy(F.desc("n"), "c").limit(COMMON).select("c").collect())
    pages = one_per_record(scans).join(scans.select("rec", "doc").distinct(), "rec") if "doc" in scans.columns else one_per_record(scans).withColumn("doc", F.lit(None).cast("string"))
    pages = pages.persist()  # read for heads and for parts
    parts = checkpointed(page_parts(pages, running_heads(pages), common))
    pages.unpersist()
    lines = parts.where("kind = 'line'").select("rec", F.lit("line").alias("noise"), "pos", F.col("pos").cast("string").alias("item"), F.lit(None).cast("string").alias("read"))
    # Broken words: the form known best; if none is, the plain join, which may itself need repair.
    broken = parts.where("kind = 'joined'").select("rec", "pos", F.concat("a", "b").alias("plain"), F.concat_ws("-", "a", "b").alias("own"))
    forms = broken.select(F.explode(F.array("plain", "own")).alias("c")).distinct().join(lexicon, "c").select("c", F.struct((F.col("clean") >= KNOWN).alias("known"), F.col("n").alias("n")).alias("f"))
    chosen = (
        broken.join(forms.select(F.col("c").alias("plain"), F.col("f").alias("fp")), "plain", "left").join(forms.select(F.col("c").alias("own"), F.col("f").alias("fo")), "own", "left")
        .select("rec", "pos", F.when(F.col("fo").isNotNull() & (F.col("fp").isNull() | (F.col("fo") > F.col("fp"))), F.col("own")).otherwise(F.col("plain")).alias("w"))
    )
    words = parts.where("kind = 'word'").select("rec", "pos", F.col("a").alias("w"), "prev", "next")
    asked = words.select("w").unionByName(chosen.select("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    unknown = asked.join(good.select(F.col("c").alias("w")), "w", "left_anti")
    cands = checkpointed(candidates(unknown, good))
    # Numbers, short words and edits that are no confusion prove little by their letters alone.
    faint = F.col("w").rlike("^[0-9]+$") | (F.length("w") < 3) | (F.abs(F.col("cost") - EDIT) < 1e-6)
    cands = cands.withColumn("faint", faint)
    listed = cands.groupBy("w").agg(F.array_sort(F.collect_list(F.struct("cost", (-F.col("n")).alias("less"), "c", "faint"))).alias("cs"))
    met = words.join(listed, "w")
    alone = (F.size("cs") == 1) & ~F.col("cs")[0]["faint"]
    clear = met.where(alone).select("rec", "pos", "w", F.col("cs")[0]["c"].alias("item"))
    open_ = met.where(~alone).select("rec", "pos", "w", "prev", "next", F.explode("cs").alias("x")).select("rec", "pos", "w", "prev", "next", "x.c", "x.cost", (-F.col("x.less")).alias("n"), "x.faint")
    seen = pairs.select("w1", "w2", F.col("n").alias("k"))
    # After a word, a number and the end of a text are counted as the empty word.
    no_word = seen.where("w2 = ''").select(F.col("w1").alias("prev"), F.col("k").alias("k0"))
    both = (
        open_.join(seen.select(F.col("w1").alias("prev"), F.col("w2").alias("c"), F.col("k").alias("k1")), ["prev", "c"], "left")
        .join(seen.select(F.col("w1").alias("c"), F.col("w2").alias("next"), F.col("k").alias("k2")), ["c", "next"], "left")
        .join(no_word, "prev", "left")
        .where(~F.col("faint") | (F.col("k1") > 0) & (F.col("k2") > 0) & (F.col("next") >= "a") & (~F.col("w").rlike("^[0-9]+$") | (F.col("k1") > F.coalesce("k0", F.lit(0)))))
        .withColumn("score", F.round(F.log1p(F.coalesce("k1", F.lit(0))) + F.log1p(F.coalesce("k2", F.lit(0))) + 0.25 * F.log("n") - 8 * F.col("cost"), 9))
    )
    picked = both.groupBy("rec", "pos", "w").agg(F.min_by("c", F.struct(-F.col("score"), "c")).alias("item"))
    best = listed.select("w", F.get(F.filter("cs", lambda x: ~x["faint"]), F.lit(0))["c"].alias("fixed"))
    joined = chosen.join(best, "w", "left").select("rec", F.lit("joined").alias("noise"), "pos", F.coalesce("fixed", "w").alias("item"), F.col("w").alias("read"))
    fixed = clear.unionByName(picked).select("rec", F.lit("word").alias("noise"), "pos", "item", F.col("w").alias("read"))
    return lines.unionByName(joined).unionByName(fixed)


def _case(read: str, item: str) -> str:
    return item.upper() if read.isupper() and len(read) > 1 else item[:1].upper() + item[1:] if read[:1].isupper() else item


def paragraphs(texts: DataFrame, scans: DataFrame) -> DataFrame:
    """The repaired paragraph of each page: rec, paragraph."""
    found = checkpointed(repairs(texts, scans))
    by = found.groupBy("rec").agg(F.collect_list(F.struct("noise", "pos", "item")).alias("fixes"))
    pages = one_per_record(scans)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, fixes in zip(map(clean_page, b["text"]), b["fixes"]):
                fixes = list(fixes) if fixes is not None else []
                bad = {f["pos"] for f in fixes if f["noise"] == "line"}
                para, broken = joined_paragraph(text, [i in bad for i in range(text.count("\n") + 1)])
                ends = {at: at + len(a) + 1 + len(c) for at, a, c in broken}
                edits = sorted(((f["pos"], f["noise"], f["item"]) for f in fixes if f["noise"] != "line"), reverse=True)
                for at, noise, item in edits:
                    if noise == "joined" and at in ends:
                        stop = ends[at]
                    else:
                        m = TOKEN.match(para, at)
                        stop = m.end() if m else at
                    para = para[:at] + _case(para[at:stop].replace("­", ""), item) + para[stop:]
                out.append(para)
            yield pd.DataFrame({"rec": b["rec"], "paragraph": out})

    return pages.join(by, "rec", "left").select("rec", "text", "fixes").mapInPandas(run, "rec string, paragraph string")


def doc_of(rec: Column) -> Column:
    """The document that a record's page belongs to: the name up to its first #."""
    return F.substring_index(rec, "#", 1)
