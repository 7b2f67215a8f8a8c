"""Missing or wrong document language labels (problem 10).

A sparse multinomial logistic regression on TF-IDF character n-grams is trained by
follow-the-regularised-leader with an elastic net, then calibrated by a temperature. Training uses
a bounded sample of labelled rows (``per_language`` distinct texts of each, whole); later
fits leave out sentences that the one before gives another language, since labels may be wrong and
texts mixed.
Document frequencies are counted over all documents. Every sentence of every document is then
classed, and neighbouring sentences of one language are joined into segments.

Defined cases: null, empty and blank texts have no segment and language ``und`` with confidence 0;
a label in no known spelling names no language; speaker labels, table rows and names or titles in
brackets are no sentences; a text without a full sentence is classed as one stretch but counts
as no full sentence; repeated rows come out alike; equal scores go to the first language in
alphabetical order; rows without a doc_id have no result; without any labelled row the result is empty; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Codes and names of languages as labels spell them.
SPELLINGS = {
    "en": "en eng english", "de": "de deu ger german deutsch", "fr": "fr fra fre french français", "es": "es spa spanish español castilian",
    "it": "it ita italian italiano", "nl": "nl nld dut dutch nederlands", "pt": "pt por portuguese português",
    "da": "da dan danish", "sv": "sv swe swedish", "no": "no nor norwegian", "fi": "fi fin finnish", "pl": "pl pol polish", "cs": "cs ces cze czech",
    "ro": "ro ron rum romanian", "hu": "hu hun hungarian", "tr": "tr tur turkish", "ca": "ca cat catalan", "id": "id ind indonesian",
}
BITS = 16
DIM = 1 << BITS
#: Orders of the n-grams, from one on.
ORDERS = (1, 2, 3)
#: Distinct labelled texts of each language in the training sample, at most, and passes over it.
PER_LANGUAGE, EPOCHS = 400, 3
#: Follow-the-regularised-leader: step, smoothing, and the two penalties of the elastic net.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-3
#: Examples of one step.
BATCH = 16
#: The least confidence, and the least words, of a sentence that counts as one of its language.
SURE, MIN_WORDS = 0.6, 4

TABLE_ROW = re.compile(r"^[ \t]*\|.*$", re.M)
SPEAKER = re.compile(r"(?m)^[ \t]*(?:\w[\w.'-]*[ \t]+){0,4}[A-Z][\w'-]+:(?=\s)")
BRACKETED = re.compile(r"\([^()]{0,200}\)|\[[^\[\]]{0,200}\]")
SENTENCE = re.compile(r"\S(?:[^.!?\n]++|[.!?](?![\s\"”»“’')\]]|$)|\n(?!\s*\n))*+(?:[.!?…]+[\"”»“’')\]]*(?=\s|$))?")
#: Words long enough to hold an endless repetition, and the repetition.
LONG, REPEATED = re.compile(r"\S{10,}"), re.compile(r"(\S{1,4}?)\1{9,}")
WORD = re.compile(r"[^\W\d_]+")
ENDED = re.compile(r"[.!?…][\"”»“’')\]]*\s*$")


def label_code(label: Column) -> Column:
    """The two-letter code that a label names, null if none."""
    head = F.regexp_extract(F.lower(F.btrim(label)), r"^(\p{L}+)", 1)
    names = {s: code for code, all_ in SPELLINGS.items() for s in all_.split()}
    return F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[head]


def _blank(m: re.Match) -> str:
    return m[0] if m[0].isspace() else "\n".join(" " * len(x) for x in m[0].split("\n"))


def _calm(m: re.Match) -> str:
    if len(set(m[0])) > len(m[0]) - 6:  # ten letters or more of at most four kinds leave no more than six kinds less than letters
        return m[0]
    # Of a row of full stops the first stays: it ends the sentence.
    return REPEATED.sub(lambda r: ("." if r[0][0] == "." else " ") + " " * (len(r[0]) - 1), m[0])


def blanked(text: str) -> str:
    """The text with table rows, speaker labels, bracketed notes and endless repetitions blanked out, places unchanged."""
    if "|" in text:
        text = TABLE_ROW.sub(_blank, text)
    if ":" in text:
        text = SPEAKER.sub(_blank, text)
    if "(" in text or "[" in text:
        text = BRACKETED.sub(_blank, text)
    return LONG.sub(_calm, text)


def sentences(clean: str) -> list[tuple[int, int, bool]]:
    """(start, end, is a full sentence) of each stretch of a blanked text that has letters."""
    out = []
    for m in SENTENCE.finditer(clean):
        words = len(WORD.findall(m[0]))
        if words:
            out.append((m.start(), m.end(), words >= MIN_WORDS and ENDED.search(m[0]) is not None))
    return out


@cache
def _letters() -> np.ndarray:
    """For each character of the basic plane, its lower-case letter, or a space if it is none; one more for all others."""
    table = np.full(1 << 16, 32, np.uint32)
    for n in range(1 << 16):
        if not 0xD800 <= n < 0xE000 and (c := chr(n)).isalpha():
            table[n] = ord(c.lower()[0])
    return np.r_[table, np.uint32(32)]


def _codes(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all parts, lower case, all else as single spaces, each part between spaces; and where each part ends."""
    raw = np.frombuffer("".join(f" {p} " for p in parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _letters()[np.minimum(raw, 1 << 16)]
    space = codes == 32
    ends = np.cumsum([len(p) + 2 for p in parts])
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep[np.r_[0, ends[:-1]]] = True  # each part keeps its own first space
    return codes[keep], np.cumsum(keep)[ends - 1]


def _hashed(codes: np.ndarray) -> Iterator[np.ndarray]:
    """The hashed n-grams from each place, for each order in turn."""
    h = np.full(len(codes), 0x811C9DC5, np.uint32)
    for n in ORDERS:
        h = (h[: len(codes) - n + 1] * np.uint32(0x01000193)) ^ codes[n - 1 :]
        yield (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def part_ids(parts: list[str]) -> list[np.ndarray]:
    """The hashed n-grams of each part, with repeats."""
    out = []
    for p in parts:
        codes, _ = _codes([p])
        out.append(np.concatenate(list(_hashed(codes))))
    return out


def scores(parts: list[str], weights: np.ndarray) -> np.ndarray:
    """The score of each part for each language; ``weights`` holds the IDF already, its last row the biases.

    Parts are scored together up to ``AT_ONCE`` characters, longer ones in pieces of that size.
    """
    sums, n = np.zeros((len(parts), weights.shape[1])), np.zeros(len(parts))

    def add(held: list[str], owner: list[int]) -> None:
        codes, ends = _codes(held)
        starts = np.r_[0, ends[:-1]]
        own = np.array(owner)
        for order, ids in zip(ORDERS, _hashed(codes)):
            stops = np.maximum(ends - order + 1, starts)
            # Sums from each part's start to its last whole n-gram; those across two parts fall between.
            cuts = np.minimum(np.stack([starts, stops], axis=1).ravel(), len(ids) - 1) if len(ids) else np.zeros(0, int)
            if not len(cuts):
                continue
            got = np.add.reduceat(weights[ids], cuts, axis=0)[::2]
            if stops[-1] >= len(ids) and starts[-1] < len(ids):  # the last part runs to the end
                got[-1] = weights[ids[starts[-1] :]].sum(axis=0)
            counts = np.maximum(stops - starts, 0)
            got[counts == 0] = 0
            np.add.at(sums, own, got)
            np.add.at(n, own, counts)

    held, owner, size = [], [], 0
    for i, p in enumerate(parts):
        for j in range(0, max(1, len(p)), AT_ONCE):
            held.append(p[j : j + AT_ONCE])
            owner.append(i)
            size += len(held[-1])
            if size >= AT_ONCE:
                add(held, owner)
                held, owner, size = [], [], 0
    if held:
        add(held, owner)
    return weights[-1] + sums / np.maximum(n, 1)[:, None]


def softmax(s: np.ndarray, temperature: float) -> np.ndarray:
    """Probabilities of scores at a temperature."""
    e = np.exp((s - s.max(axis=1, keepdims=True)) / temperature)
    return e / e.sum(axis=1, keepdims=True)


def ftrl(examples: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (features and a bias, by class) fitted by follow-the-regularised-leader, ``BATCH`` examples at a step."""
    z, n = np.zeros((DIM + 1, k)), np.zeros((DIM + 1, k))
    weights = lambda z, n: np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        order = rng.permutation(len(examples))
        for lo in range(0, len(order), BATCH):
            part = order[lo : lo + BATCH]
            u, at = np.unique(np.concatenate([examples[i][0] for i in part]), return_inverse=True)
            size = [len(examples[i][0]) for i in part]
            x = np.zeros((len(part), len(u)))
            x[np.repeat(np.arange(len(part)), size), at] = np.concatenate([examples[i][1] for i in part])
            zu, nu = z[u], n[u]
            w = weights(zu, nu)
            p = softmax(x @ w, 1.0)
            p[np.arange(len(part)), y[part]] -= 1.0
            g = x.T @ p
            # Each example's own square counts, as if it had come alone.
            more = (x * x).T @ (p * p)
            z[u] = zu + g - (np.sqrt(nu + more) - np.sqrt(nu)) / ALPHA * w
            n[u] = nu + more
    return weights(z, n)


def train(sample: pd.DataFrame, idf: np.ndarray) -> tuple[list[str], np.ndarray, float]:
    """(languages, weights with the IDF in them, temperature) from a sample of labelled texts (text, code)."""
    langs = sorted(sample["code"].unique())
    number = {c: i for i, c in enumerate(langs)}
    parts, y, doc = [], [], []
    for no, (text, code) in enumerate(zip(sample["text"], sample["code"])):
        clean = blanked(text)
        for a, b, full in sentences(clean):
            if full:
                parts.append(clean[a:b])
                y.append(number[code])
                doc.append(no)
    if not parts:
        return langs, np.zeros((DIM + 1, len(langs))), 1.0
    y_ = np.array(y)
    examples = []
    for ids in part_ids(parts):
        u, c = np.unique(ids, return_counts=True)
        # Scaled up so that steps move; undone in the returned weights.
        examples.append((np.r_[u, DIM], np.r_[c / c.sum() * idf[u] * SCALE, 1.0]))
    held = np.arange(len(parts)) % 5 == 0

    def rows(w: np.ndarray) -> np.ndarray:
        return np.array([x @ w[i] for i, x in examples])

    keep = ~held
    # Labels may be wrong and texts mixed: a sentence that a fit over all gives another language is left out of the next.
    wrong = np.zeros(len(parts), bool)
    for epochs in (1, 1, EPOCHS):
        w = ftrl([e for e, k in zip(examples, keep & ~wrong) if k], y_[keep & ~wrong], len(langs), epochs)
        wrong = rows(w).argmax(axis=1) != y_
    # Calibrated on held-out sentences of documents whose label most of their sentences bear out.
    doc_ = np.array(doc)
    test = held & (np.bincount(doc_, wrong) < 0.5 * np.bincount(doc_))[doc_]
    s, best = rows(w)[test], (np.inf, 1.0)
    for t in np.geomspace(0.1, 4.0, 25):
        q = softmax(s, t)[np.arange(test.sum()), y_[test]] if test.any() else np.ones(1)
        best = min(best, (float(-np.log(np.maximum(q, 1e-12)).mean()), float(t)))
    out = w.copy()
    out[:-1] *= (idf * SCALE)[:, None]
    return langs, out, best[1]


#: Characters whose n-grams are counted, and scored, at a time.
PIECE, AT_ONCE = 1 << 20, 1 << 16
SCALE = 4.0


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[int, np.ndarray]:
    """The number of documents, and the IDF of each hashed n-gram, counted over all of them.

    Each task adds up a vector of fixed length; the sums, at most as many as hash values, come to
    the driver.
    """
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(DIM, np.int64), 0
        for b in batches:
            for t in b["text"]:
                n += 1
                seen = np.zeros(DIM, bool)
                clean = blanked(t)
                for i in range(0, len(clean), PIECE):  # in pieces, so that no text is too long
                    for ids in _hashed(_codes([clean[i : i + PIECE + max(ORDERS)]])[0]):
                        seen[ids] = True
                total += seen
        at = np.flatnonzero(total)
        yield pd.DataFrame({"id": np.r_[at, DIM].astype(np.int32), "df": np.r_[total[at], n]})

    got = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).mapInPandas(count, "id int, df long").groupBy("id").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(DIM + 1, np.int64)
    df[got["id"]] = got["df"]
    n = int(df[-1])
    return n, np.log((1 + n) / (1 + df[:-1])) + 1.0


def drawn(rows: DataFrame, key: str, most: int) -> pd.DataFrame:
    """At most ``most`` distinct texts of each value of ``key`` in rows (text, key): those of the least hashes.

    Only hashes are sorted; just the drawn texts, each once, come to the driver.
    """
    from pyspark.sql.window import Window as W

    hashed = rows.select("text", key, F.xxhash64("text").alias("h"))
    least = hashed.select(key, "h").distinct().withColumn("at", F.row_number().over(W.partitionBy(key).orderBy("h"))).where(F.col("at") <= most).select(key, "h")
    texts = hashed.join(F.broadcast(least), [key, "h"]).groupBy(key, "h").agg(F.min("text").alias("text"))
    return texts.select("text", key).toPandas().sort_values([key, "text"], kind="stable", ignore_index=True)


def fitted(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray, float]:
    """A model trained on at most ``per_language`` distinct labelled texts of each language."""
    labelled = docs.select("text", label_code(F.col("lang")).alias("code")).where("code is not null and length(trim(text)) > 0")
    sample = drawn(labelled, "code", per_language)
    if sample.empty:
        return [], np.zeros((DIM + 1, 0)), 1.0
    _, idf = document_frequencies(docs)
    return train(sample, idf)


def classed_sentences(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Every stretch of every document: doc_id, no, start, stop, full, lang, confidence."""
    langs, weights, temperature = fitted(docs, per_language)
    shared = docs.sparkSession.sparkContext.broadcast((langs, weights.astype(np.float32), temperature))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        langs, weights, temperature = shared.value
        cols = ["doc_id", "no", "start", "stop", "full", "lang", "confidence"]
        for b in batches:
            keys, spans, parts = [], [], []
            for key, text in zip(b["doc_id"], b["text"]):
                clean = blanked(text)
                for i, (s, e, full) in enumerate(sentences(clean)):
                    keys.append((key, i, s, e, full))
                    parts.append(clean[s:e])
            if not parts or not langs:
                continue
            p = softmax(scores(parts, weights), temperature)
            top = p.argmax(axis=1)
            out = pd.DataFrame(keys, columns=cols[:5])
            yield out.assign(lang=[langs[i] for i in top], confidence=p[np.arange(len(top)), top])

    return docs.where((F.length(F.trim("text")) > 0) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, no int, start int, stop int, full boolean, lang string, confidence double")


def unnamed_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, lang) of each language with a full sentence in a document whose label does not name it."""
    sure = classed_sentences(docs).where(F.col("full") & (F.col("confidence") >= SURE)).groupBy("doc_id", "lang").agg(F.count(F.lit(1)).alias("n"))
    labels = docs.select(F.col("doc_id").cast("long").alias("doc_id"), label_code(F.col("lang")).alias("code")).where("code is not null").distinct()
    return sure.join(labels, (sure["doc_id"] == labels["doc_id"]) & (sure["lang"] == labels["code"]), "left_anti").select("doc_id", "lang")


def segments(docs: DataFrame) -> DataFrame:
    """Stretches of one language within each document: doc_id, seg, start, stop, lang, confidence."""
    from pyspark.sql.window import Window as W

    by = W.partitionBy("doc_id").orderBy("no")
    turned = classed_sentences(docs).withColumn("new", F.coalesce((F.lag("lang").over(by) != F.col("lang")).cast("int"), F.lit(0)))
    numbered = turned.withColumn("seg", F.sum("new").over(by))
    size = F.col("stop") - F.col("start")
    return numbered.groupBy("doc_id", "seg", "lang").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.round(F.sum(size * F.col("confidence")) / F.sum(size), 4).alias("confidence"))


def document_languages(docs: DataFrame) -> DataFrame:
    """One language with a confidence for every document: doc_id, lang, confidence."""
    size = F.col("stop") - F.col("start")
    weight = classed_sentences(docs).groupBy("doc_id", "lang").agg(F.sum(size * F.col("confidence")).alias("w"), F.sum(size).alias("n"))
    best = weight.groupBy("doc_id").agg(F.max_by("lang", F.struct("w", "lang")).alias("lang"), (F.max("w") / F.sum("n")).alias("confidence"))
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return ids.join(best, "doc_id", "left").select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), F.round(F.coalesce("confidence", F.lit(0.0)), 4).alias("confidence"))
