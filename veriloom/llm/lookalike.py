"""Visually identical text with different characters brought to one form (problem 2).

1. A text is suspect if it holds a character that may be an ignorable, foreign white space, a wide or
   narrow form, a ligature, a combining mark or a look-alike letter, which is any but the plain Latin
   ones. Other texts only have their white space made single spaces.
2. The vocabulary is counted over all plain tokens of all texts.
3. Suspect tokens and vocabulary are routed by a coarse key, the number of visible letters and the
   first two of them, a suspect token by every reading of these. Each shard holds a bounded number
   of words in a trie, which a weighted edit automaton walks for each suspect token: ignorables and
   look-alikes cost nothing, the second reading of a letter that looks like two a little, all else
   more than the limit, since case, accents and digits differ. The cheapest, then most frequent
   spelling is canonical; a token that meets none is normalised by table. For letters with one reading
   both ways agree; those with two, as a stroke that is I or l, are decided by the vocabulary alone.
4. Tokens are put back in their places.

Case, accents, digits and words differ; so 0 and O, or 1 and l, are never made one.

Defined cases: null texts are no records; an empty text, or one of nothing but ignorables and white
space, comes out empty; runs of white space are one space and none is left at the ends; equal
spellings tie to the smaller string; repeated deliveries are one record, the last to come holding;
empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.llm.records import one_per_record
from veriloom.operators.skew import heavy_join
from veriloom.sources.tables import checkpointed

# Letters of other scripts that look like a Latin letter in common typefaces.
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Ӏ": "I", "Ѵ": "V",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ԁ": "d", "һ": "h",
    "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v", "ү": "y",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "ο": "o", "ν": "v", "α": "a", "ι": "i", "ρ": "p", "ϲ": "c", "ϳ": "j", "υ": "u", "κ": "k", "χ": "x", "γ": "y", "τ": "t", "η": "n",
    # Armenian and others
    "օ": "o", "ս": "u", "հ": "h", "ց": "g", "ո": "n", "Օ": "O", "Ս": "U", "ɑ": "a", "ɡ": "g", "ı": "i",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮖ": "I",
    "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N",
    "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # Small capitals that look like the small letter
    "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s", "ᴜ": "u",
    # Hyphens
    "‐": "-", "‑": "-",
}
# Letters that also look like a second Latin letter.
SECOND = {"Ӏ": "l", "ӏ": "I", "І": "l", "Ι": "l", "Ꮖ": "l", "ꓲ": "l", "Ⅰ": "l", "ⅼ": "I", "υ": "v", "γ": "v", "ո": "u"}
# White space, as the inside of a character class; and ignorables besides category Cf.
SPACES = "\t\n\x0b\x0c\r\x1c-\x20\x85\xa0  -     　"
IGNORED = "͏ᅟᅠ឴឵ㅤﾠ"
# Characters that are never suspect, as the inside of a character class; all others go to the tables.
PLAIN = r"\x20-\x7e\t\n\r\u00a1-\u00ac\u00ae-\u0130\u0132-\u024f\u2012-\u2027\u2030-\u205e\u20a0-\u20bf"
#: What the automaton allows: a look-alike is free, a second letter costs SECOND_COST, more than LIMIT is no match.
SECOND_COST, LIMIT = 0.25, 0.5
#: Words of one trie, and members of a class that meet in one task.
TRIE_WORDS, CLASS_ROWS = 20_000, 10_000


def _styled(n: int, c: str, tag: str) -> bool:
    """Whether a character is a mathematical form, or a Roman numeral, of one Latin letter or digit."""
    plain = unicodedata.normalize("NFKC", c)
    return len(plain) == 1 and plain.isascii() and (tag == "<font>" or 0x2160 <= n < 0x2180)


@cache
def tables() -> dict[str, str]:
    """The mapping of single characters.

    Built by rule from the Unicode data: wide, narrow, mathematical and no-break forms, Latin
    ligatures, canonical singletons, format characters and controls, beside the fixed look-alikes.
    """
    space = re.compile(f"[{SPACES}]")
    to: dict[str, str] = dict(LOOKALIKES)
    for n in range(sys.maxunicode + 1):
        c = chr(n)
        if 0xD800 <= n < 0xE000 or space.match(c):
            continue
        cat = unicodedata.category(c)
        if cat == "Cf" or cat == "Cc" or c in IGNORED or 0xFE00 <= n < 0xFE10 or 0xE0100 <= n < 0xE01F0:
            to[c] = ""
        elif c not in to and (d := unicodedata.decomposition(c)):
            tag = d.split()[0]
            if tag in ("<wide>", "<narrow>", "<noBreak>") or 0xFB00 <= n < 0xFB07 or _styled(n, c, tag):
                to[c] = unicodedata.normalize("NFKC", c)
            elif tag[0] != "<" and len(d.split()) == 1:
                to[c] = unicodedata.normalize("NFC", c)
    return to


@cache
def translation() -> dict[int, str]:
    """The tables in the form that strings are translated with."""
    return str.maketrans(tables())


def by_table(token: str) -> str:
    """A token with each character replaced by the tables, composed anew."""
    to = translation()
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", token.translate(to)).translate(to))


def key_of(word: str) -> str:
    """The coarse key of a plain word: its length and its first two letters."""
    return f"{len(word)}:{word[:2]}"


def keys_of(token: str) -> set[str]:
    """The coarse keys of a suspect token, for every reading of its letters within the limit."""
    live = {(0, "", 0.0)}
    for options in units(token):
        live = {(n + len(s), (head + s)[:2], cost + w) for n, head, cost in live for s, w in options if cost + w <= LIMIT}
    return {f"{n}:{head}" for n, head, _ in live}


def units(token: str) -> list[list[tuple[str, float]]]:
    """The spellings, with costs, of each visible unit of a token; ignorables leave none."""
    to = tables()
    out: list[list[tuple[str, float]]] = []
    composed = unicodedata.normalize("NFC", "".join(c for c in token if to.get(c, c)))
    for c in composed:
        if unicodedata.combining(c) and out:  # a mark on a look-alike: compose with its spelling
            out[-1] = [(unicodedata.normalize("NFC", s + c), w) for s, w in out[-1]]
            continue
        first = unicodedata.normalize("NFC", "".join(to.get(x, x) for x in unicodedata.normalize("NFD", to.get(c, c))))
        out.append([(first, 0.0), *([(SECOND[c], SECOND_COST)] if c in SECOND else [])])
    return out


class Trie:
    """A trie of spellings with their frequencies, walked by the automaton."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, n: int) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = node.get("", 0) + n

    def match(self, token: str) -> tuple[float, int, str] | None:
        """The cheapest, then most frequent, then smallest spelling of a token within the limit: (cost, -n, spelling)."""
        live = [(self.root, "", 0.0)]
        for options in units(token):
            nxt = []
            for node, word, cost in live:
                for s, w in options:
                    at: dict | None = node
                    for c in s:
                        at = at.get(c) if at is not None else None
                    if at is not None and cost + w <= LIMIT:
                        nxt.append((at, word + s, cost + w))
            live = nxt
        ends = [(cost, -node[""], word) for node, word, cost in live if "" in node]
        return min(ends) if ends else None


def is_suspect(text: Column) -> Column:
    """Whether a text holds a suspect character. Texts of single bytes are told by their length; of
    others only what is left without their ASCII runs meets the character class."""
    rest = F.regexp_replace(text, r"[\x20-\x7e\n]++", "")
    return F.when(F.octet_length(text) == F.char_length(text), text.rlike(r"[\x00-\x08\x0e-\x1b\x7f]")).otherwise(rest.rlike(f"[^{PLAIN}]"))


def tokens(text: Column) -> Column:
    """The tokens of a text between white space; empty ones, at its ends, are left to the caller."""
    return F.split(text, f"[{SPACES}]+")


def squeezed(text: Column) -> Column:
    """A text with white space of any kind as single spaces, none at its ends."""
    return F.btrim(F.regexp_replace(text, f"[{SPACES}]+", " "))


def digest(col: str) -> list[Column]:
    """Two hashes, 128 bits in all, that stand for a text in joins."""
    return [F.xxhash64(col), F.xxhash64(F.lit(7), col)]


def spellings(texts: DataFrame) -> DataFrame:
    """(token, n, spelling) of every suspect token of the texts; the vocabulary is counted over all of them."""
    # Cut from its lineage, so that the filters below aren't pushed under the count and all tokens aren't counted twice.
    words = checkpointed(texts.select(F.explode(tokens(F.col("text"))).alias("token")).where("token <> ''").groupBy("token").agg(F.count(F.lit(1)).alias("n")))

    def with_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(t, n, k) for t, n in zip(b["token"], b["n"]) for k in keys_of(t)], columns=["token", "n", "key"])

    odd = words.where(is_suspect(F.col("token")))
    keyed = odd.mapInPandas(with_keys, "token string, n long, key string")
    plain = words.where(~is_suspect(F.col("token"))).select("token", "n", F.concat_ws(":", F.char_length("token"), F.substring("token", 1, 2)).alias("key"))
    wanted = plain.join(keyed.select("key").distinct(), "key", "left_semi").select("key", "token", "n", F.lit(False).alias("odd"))
    shards = wanted.unionByName(keyed.select("key", "token", "n", F.lit(True).alias("odd"))).repartition("key").sortWithinPartitions("key", F.desc("odd"))

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie, n_words, asked, own, key = Trie(), 0, [], 0, None

        def walked() -> pd.DataFrame:
            return pd.DataFrame([(t, *m) for t in asked if (m := trie.match(t)) is not None], columns=["token", "cost", "less", "spelling"])

        for b in batches:
            for k, token, n, is_odd in b.itertuples(index=False, name=None):
                if k != key and n_words >= TRIE_WORDS:
                    yield walked()
                    trie, n_words, asked = Trie(), 0, []
                if k != key:
                    key, own = k, len(asked)
                if is_odd:
                    asked.append(token)
                    continue
                if n_words >= 2 * TRIE_WORDS:  # more words of one key than a trie holds: its tokens walk the next one too
                    yield walked()
                    trie, n_words, asked, own = Trie(), 0, asked[own:], 0
                trie.add(token, n)
                n_words += 1
        if asked:
            yield walked()

    def tabled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"token": b["token"], "n": b["n"], "table": [by_table(t) for t in b["token"]]})

    best = shards.mapInPandas(spell, "token string, cost double, less long, spelling string").groupBy("token").agg(F.min(F.struct("cost", "less", "spelling"))["spelling"].alias("spelling"))
    rest = odd.select("token", "n").mapInPandas(tabled, "token string, n long, table string")
    return checkpointed(rest.join(best, "token", "left").select("token", "n", F.coalesce("spelling", "table").alias("spelling")))


def rebuilt(texts: DataFrame) -> DataFrame:
    """(t1, t2, canonical) of every different suspect text, by its digest."""
    t1, t2 = digest("text")
    odd = texts.where(is_suspect(F.col("text"))).select(t1.alias("t1"), t2.alias("t2"), "text").dropDuplicates(["t1", "t2"])
    # Only suspect tokens leave their text; it is put together again where it is, from a map of their places.
    placed = odd.select("t1", "t2", F.posexplode(tokens(F.col("text"))).alias("pos", "token")).where(is_suspect(F.col("token")))
    # In text of another script its common words are suspect tokens too, and hot.
    fixes = heavy_join(placed, spellings(texts), ["token"], "n", F.xxhash64("t1", "pos")).groupBy("t1", "t2").agg(F.map_from_entries(F.collect_list(F.struct("pos", "spelling"))).alias("fix"))
    put = F.transform(tokens(F.col("text")), lambda x, i: F.coalesce(F.try_element_at("fix", i), x))
    return odd.join(fixes, ["t1", "t2"], "left").select("t1", "t2", F.array_join(F.filter(put, lambda x: x != ""), " ").alias("canonical"))


def canonical(texts: DataFrame) -> DataFrame:
    """For each record of ``texts`` (rec, ord, text): rec, text, canonical."""
    recs = one_per_record(texts)
    t1, t2 = digest("text")
    usual = recs.where(~is_suspect(F.col("text"))).select("rec", "text", squeezed(F.col("text")).alias("canonical"))
    odd = recs.where(is_suspect(F.col("text"))).withColumns({"t1": t1, "t2": t2})
    return usual.unionByName(odd.join(rebuilt(texts.where("text is not null")), ["t1", "t2"], "left").select("rec", "text", F.coalesce("canonical", F.lit("")).alias("canonical")))


def digests(texts: DataFrame) -> DataFrame:
    """For each record of ``texts``: rec, the digest of its text (t1, t2) and that of its canonical form (c1, c2).

    Plain texts are digested where they are read, so only suspect ones are ever shuffled.
    """
    known = texts.where("rec is not null and text is not null")
    t1, t2 = digest("text")
    plain = ~is_suspect(F.col("text"))
    # Through a one-element array, so that the white space of a text is squeezed once and not for each hash.
    flat = F.when(plain, F.transform(F.array(squeezed(F.col("text"))), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b")))[0])
    keyed = known.select("rec", "ord", t1.alias("t1"), t2.alias("t2"), flat.alias("c")).select("rec", "ord", "t1", "t2", F.col("c.a").alias("c1"), F.col("c.b").alias("c2"))
    recs = keyed.groupBy("rec").agg(F.max(F.struct("ord", "t1", "t2", "c1", "c2")).alias("x")).select("rec", "x.t1", "x.t2", "x.c1", "x.c2")
    odd = recs.where("c1 is null").select("rec", "t1", "t2").join(rebuilt(known), ["t1", "t2"], "left").withColumn("canonical", F.coalesce("canonical", F.lit("")))
    c1, c2 = digest("canonical")
    return recs.where("c1 is not null").unionByName(odd.select("rec", "t1", "t2", c1.alias("c1"), c2.alias("c2")))


def equal_looking_classes(texts: DataFrame) -> DataFrame:
    """The classes of records that look the same but differ: rec, class_id, variant, n_variants, n_members.

    A class has at least two different texts; class_id is its smallest record, variant the smallest
    record with the same characters.
    """
    keyed = digests(texts)
    variants = keyed.groupBy("c1", "c2", "t1", "t2").agg(F.min("rec").alias("variant"), F.count(F.lit(1)).alias("n"))
    classes = variants.groupBy("c1", "c2").agg(F.min("variant").alias("class_id"), F.count(F.lit(1)).alias("n_variants"), F.sum("n").alias("n_members")).where("n_variants > 1")
    return keyed.join(variants.drop("n").join(classes, ["c1", "c2"]), ["c1", "c2", "t1", "t2"]).select("rec", "class_id", "variant", "n_variants", "n_members")


def equal_looking_pairs(texts: DataFrame) -> DataFrame:
    """Pairs (rec_a, rec_b) of records with one canonical form whose texts differ; rec_a < rec_b.

    The members of a class of more than ``CLASS_ROWS`` are spread over as many tasks as it has such
    parts, each of which meets all of them.
    """
    keyed = digests(texts)
    mixed = keyed.groupBy("c1", "c2").agg(F.min(F.struct("t1", "t2")).alias("x"), F.max(F.struct("t1", "t2")).alias("y"), F.count(F.lit(1)).alias("n")).where("x <> y")
    rows = keyed.join(mixed.select("c1", "c2", F.ceil(F.col("n") / CLASS_ROWS).cast("int").alias("parts")), ["c1", "c2"])
    a = rows.select("c1", "c2", F.pmod(F.xxhash64("rec"), F.col("parts")).cast("int").alias("part"), F.col("rec").alias("rec_a"), F.col("t1").alias("a1"), F.col("t2").alias("a2"))
    b = rows.select("c1", "c2", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("rec").alias("rec_b"), F.col("t1").alias("b1"), F.col("t2").alias("b2"))
    return a.join(b, ["c1", "c2", "part"]).where("rec_a < rec_b and (a1 <> b1 or a2 <> b2)").select("rec_a", "rec_b")
