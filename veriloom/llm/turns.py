"""Speech transcripts into clean speaker turns (problem 5).

1. Each fragment's tokens are tagged as speaker, timestamp, annotation, filler or speech by a hidden
   Markov model over token shapes, decoded by Viterbi. Its parameters are trained on all fragments
   by ``ROUNDS`` passes of Viterbi training: each decodes with the last parameters and counts anew, and
   only the counts, of fixed number, leave the tasks.
2. The label that opens a text, else the speaker field, is matched with the roster. A surname of
   several people goes, within its session, to the one whose role is given or who is named outright.
3. Turns are found in two levels, so a session of any length is never one task: fragments in blocks
   of ``BLOCK`` places, then one summary row per block, from which the person speaking on and the
   number of turns before are carried into each block.

Defined cases: null texts and texts without spoken words belong to no turn and end none; fragments
before anybody is named are left out; repeated deliveries (same id) are one fragment, the last to
come holding; ids that are not of a hearing are ignored; an empty roster or table gives no turns;
two fragments at one place tie by the greater passage number, a null one
being the least; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from veriloom.sources.tables import checkpointed

# Filler words and phrases, honorifics and names of the chair.
FILLERS = frozenset("um uh er erm ah mm hmm mhm uhm eh".split())
PHRASES = {("you", "know"), ("i", "mean")}
HONORIFICS = frozenset("mr mrs ms miss mx dr prof professor sir dame senator hon".split())
CHAIR = frozenset("chair chairman chairwoman chairperson".split())
#: Places in one block, and people a roster may hold, since it is sent to all tasks.
BLOCK, ROSTER_MOST = 1000, 100_000
ROUNDS = 2
#: Tokens decoded at a time, padding included; a longer text is decoded alone.
CELLS = 1 << 17

TIME = r"[<\[(]?(?:\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?|\d{1,4}m\d{1,2}s)[>\])]?(?:\s*-->)?"
SPLIT = re.compile(rf"(?P<word>[^\W\d_](?:[\w'’-]*[^\W_])?)|(?P<time>{TIME})|(?P<note>\[[^\[\]\n]+\]|<[^<>\n]+>|\*[^*\n]{{1,80}}\*|\*(?=\S)[^*\n]{{81,}}(?<=\S)\*|[♪♫]+)|(?P<paren>\([^()\n]+\))|(?P<number>[^\W_](?:[\w'’-]*[^\W_])?)|(?P<colon>:)|(?P<punct>[^\s\w])")
STATES = ("NAME", "COLON", "TIME", "NOTE", "FILL", "SPEECH")
OBS = ("time", "note", "paren", "filler", "phrase", "name", "initial", "word", "colon", "punct")
S, O = len(STATES), len(OBS)  # noqa: E741
_O = {o: i for i, o in enumerate(OBS)}


WORD = _O["word"]
SPECIAL = FILLERS | HONORIFICS | CHAIR | {"the"}
AFTER_THE = re.compile(r"\s+chair", re.I)


def first_model() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, transition, emission) counts that training starts from; a zero is never allowed."""
    start = np.array([2, 0, 2, 1, 1, 6], float)
    move = np.array([[6, 4, 0, 0, 0, 0], [0, 0, 0.5, 0.5, 1, 8], [2, 0, 0, 1, 1, 6], [1, 0, 1, 0, 1, 6], [0.2, 0, 0.3, 0.3, 4, 6], [0, 0, 0.2, 0.3, 1, 30]], float)
    emit = np.zeros((S, O))
    for state, seen in {"NAME": {"name": 20, "initial": 4, "paren": 2, "punct": 3}, "COLON": {"colon": 1}, "TIME": {"time": 1}, "NOTE": {"note": 8, "paren": 4},
                        "FILL": {"filler": 10, "phrase": 8, "punct": 8}, "SPEECH": {"word": 60, "name": 1, "initial": 2, "punct": 10, "colon": 0.1, "paren": 0.1, "time": 0.001, "note": 0.001}}.items():
        for o, n in seen.items():
            emit[STATES.index(state), _O[o]] = n
    return start, move, emit


def tokens(text: str, names: frozenset[str]) -> tuple[list[tuple[int, int]], list[int]]:
    """The places and the observed shapes of a text's tokens."""
    at, obs, prev = [], [], ""
    special = names | SPECIAL
    for m in SPLIT.finditer(text):
        kind, w = m.lastgroup, ""
        if kind == "word":
            w = m[0].lower()
            o = WORD
            if w in special:
                o = _O["filler"] if w in FILLERS else _O["name"] if w != "the" or AFTER_THE.match(text, m.end()) else WORD
            elif len(w) == 1 and m[0].isupper():
                o = _O["initial"]
            if (prev, w) in PHRASES:
                obs[-1] = o = _O["phrase"]
        else:
            o = _O.get(kind, WORD)
        at.append(m.span())
        obs.append(o)
        prev = w
    return at, obs


def decode(seqs: list[list[int]], model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """The likeliest states of each sequence, many sequences of like length at a time."""
    with np.errstate(divide="ignore"):
        start, move, emit = (np.log(m / m.sum(axis=-1, keepdims=True)) for m in model)
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(seqs)
    order = sorted((i for i, s in enumerate(seqs) if s), key=lambda i: len(seqs[i]))
    lo = 0
    while lo < len(order):
        # Sorted by length, so the last of a part is its widest.
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * len(seqs[order[hi]]) <= CELLS:
            hi += 1
        part, lo = order[lo:hi], hi
        n = np.array([len(seqs[i]) for i in part])
        width = int(n.max())
        x = np.zeros((len(part), width), np.int64)
        for r, i in enumerate(part):
            x[r, : n[r]] = seqs[i]
        score = start + emit[:, x[:, 0]].T
        back = np.zeros((width, len(part), S), np.int8)
        for t in range(1, width):
            both = score[:, :, None] + move
            back[t] = both.argmax(axis=1)
            new = both.max(axis=1) + emit[:, x[:, t]].T
            new = np.where(np.isneginf(new.max(axis=1))[:, None], both.max(axis=1) - 50, new)
            score = np.where((t < n)[:, None], new, score)
        # A name without its colon at the end is speech.
        score[:, 0] = -np.inf
        state = score.argmax(axis=1)
        path = np.zeros((len(part), width), np.int64)
        rows = np.arange(len(part))
        for t in range(width - 1, -1, -1):
            path[:, t] = np.where(t < n, state, 0)
            if t:
                state = np.where(t < n, back[t, rows, state], state)
        for r, i in enumerate(part):
            out[i] = path[r, : n[r]]
    return out


def trained(texts: DataFrame, names: frozenset[str], rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The model after ``rounds`` passes of Viterbi training over all texts (column text)."""
    model = first_model()
    for _ in range(rounds):
        now = model

        def count(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            start, move, emit = (np.zeros_like(m) for m in now)
            for b in batches:
                seqs = [tokens(t, names)[1] for t in b["text"]]
                paths = [(y, x) for y, x in zip(decode(seqs, now), seqs) if len(y)]
                if paths:
                    y = np.concatenate([p for p, _ in paths])
                    last = np.cumsum([len(p) for p, _ in paths]) - 1
                    first = np.r_[0, last[:-1] + 1]
                    start += np.bincount(y[first], minlength=S)
                    inner = np.ones(len(y), bool)
                    inner[last] = False
                    move += np.bincount(y[:-1][inner[:-1]] * S + y[1:][inner[:-1]], minlength=S * S).reshape(S, S)
                    emit += np.bincount(y * O + np.concatenate([x for _, x in paths]), minlength=S * O).reshape(S, O)
            flat = np.concatenate([start, move.ravel(), emit.ravel()])
            yield pd.DataFrame({"i": np.arange(len(flat)), "n": flat})

        got = texts.mapInPandas(count, "i int, n double").groupBy("i").agg(F.sum("n").alias("n")).toPandas().sort_values("i")["n"].to_numpy()
        first = first_model()
        if len(got):
            a, b, c = got[:S], got[S : S + S * S].reshape(S, S), got[S + S * S :].reshape(S, O)
            # The first counts stay as a prior, so what they forbid stays forbidden.
            model = (np.where(first[0] > 0, a + first[0], 0), np.where(first[1] > 0, b + first[1], 0), np.where(first[2] > 0, c + first[2], 0))
    return model


class Roster:
    """The people who may be named, and what a label says of them."""

    def __init__(self, people: list[tuple[str, str, str, str, str, str]]) -> None:
        self.by: dict[str, list[tuple[str, str, str, str, str]]] = {}
        self.chairs = [p[0] for p in people if (p[4] or "").lower() == "chair"]
        words = set()
        for pid, hon, given, surname, role, org in people:
            key = (surname or "").lower().split()[-1:] or [""]
            self.by.setdefault(key[0], []).append((pid, (hon or "").lower(), (given or "").lower(), (role or "").lower(), (org or "").lower()))
            words.update((given or "").lower().split(), (surname or "").lower().split())
        self.words = frozenset(words)

    def named(self, label: str | None) -> list[str]:
        """The people whom a label may name; none if it names nobody."""
        if not label:
            return []
        org = re.search(r"\(([^()]*)\)", label)
        bare = re.sub(r"\([^()]*\)", " ", label).strip(" \t:>-—–")
        words = re.findall(r"[^\W\d_][\w'’-]*", bare)
        low = [w.lower() for w in words]
        if any(w in CHAIR for w in low) and not any(w in self.by for w in low):
            return self.chairs if len(self.chairs) == 1 else []
        if not low:
            return []
        hon = [w for w in low if w in HONORIFICS]
        rest = [w for w in low if w not in HONORIFICS]
        if not rest:
            return []
        comma = bare.find(",")
        first = re.findall(r"[^\W\d_][\w'’-]*", bare[:comma])[-1:] if comma > 0 else []
        surname = first[0].lower() if first and first[0].lower() in self.by else rest[-1]
        people = self.by.get(surname, [])
        given = [w for w in rest if w != surname]
        fits = []
        for pid, h, g, _, o in people:
            if given and not all(w == g or w in g.split() or (len(w) == 1 and g.startswith(w)) for w in given):
                continue
            if org and o and org[1].strip().lower() != o:
                continue
            fits.append((pid, bool(hon) and hon[0].rstrip(".") == h))
        if len(fits) > 1 and any(x for _, x in fits):
            fits = [f for f in fits if f[1]]
        return [pid for pid, _ in fits]


def roster_of(speakers: DataFrame) -> Roster:
    """The roster from (person_id, honorific, given_name, surname, role_name, organisation); its size is checked."""
    rows = speakers.select("person_id", "honorific", "given_name", "surname", "role_name", "organisation").where("person_id is not null").distinct().limit(ROSTER_MOST + 1).collect()
    if len(rows) > ROSTER_MOST:
        raise ValueError(f"the roster holds more than {ROSTER_MOST} people")
    return Roster([tuple(r) for r in sorted(rows, key=lambda r: r["person_id"])])


def _speech(text: str, at: list[tuple[int, int]], path: np.ndarray, obs: list[int]) -> tuple[str | None, str, bool]:
    """(label, clean speech, has spoken words) of a tagged text."""
    label, said, words, end = None, [], False, 0
    colon = next((i for i, s in enumerate(path) if STATES[s] == "COLON"), None)
    opened = colon is not None and all(STATES[s] in ("NAME", "COLON", "TIME", "NOTE", "FILL") for s in path[:colon])
    if opened:
        names = [i for i in range(colon) if STATES[path[i]] == "NAME"]
        if names:
            label = text[at[names[0]][0] : at[colon][0]]
    prev, filling, closed = "", False, ""
    for i, s in enumerate(path):
        t = text[at[i][0] : at[i][1]]
        if STATES[s] != "SPEECH":
            filling = filling or STATES[s] in ("FILL", "NOTE")
            continue
        if obs[i] in (_O["punct"], _O["colon"]):
            if filling:  # marks that belong to a filler
                closed = t if t in ".?!" else ""
            elif said:
                said.append(t if text[at[i][0] - 1 : at[i][0]].strip() else f" {t}")
            continue
        filling, closed = False, ""
        words = True
        if t.lower() == prev:  # a stutter
            continue
        prev = t.lower()
        said.append(f" {t}" if said and (text[at[i][0] - 1 : at[i][0]].isspace() or at[i - 1][1] < at[i][0] or STATES[path[i - 1]] != "SPEECH") else t)
    clean = "".join(said).strip()
    return label, clean + (closed if clean and clean[-1].isalnum() else ""), words


def fragments(passages: DataFrame, roster: Roster) -> DataFrame:
    """Tagged hearing fragments: session_key, t, ord, people (whom the label may name), role, said, speech."""
    rows = passages.select(
        F.regexp_extract("id", r"^(.+?)#t(\d+)$", 1).alias("session_key"), F.regexp_extract("id", r"^(.+?)#t(\d+)$", 2).try_cast("long").alias("t"),
        F.coalesce(F.col("passage_no").cast("long"), F.lit(-1)).alias("ord"), "speaker", F.lower("role_text").alias("role"), "text",
    ).where("t is not null and text is not null")
    model = trained(rows.select("text"), roster.words)
    shared = passages.sparkSession.sparkContext.broadcast((roster, model))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, model = shared.value
        for b in batches:
            toks = [tokens(t, who.words) for t in b["text"]]
            paths = decode([o for _, o in toks], model)
            people, said, speech = [], [], []
            for text, field, (at, obs), path in zip(b["text"], b["speaker"], toks, paths):
                label, clean, words = _speech(text, at, path, obs)
                people.append(who.named(label) if label else who.named(field))
                said.append(clean)
                speech.append(words)
            yield b[["session_key", "t", "ord", "role"]].assign(people=people, said=said, speech=speech)

    return rows.mapInPandas(run, "session_key string, t long, ord long, role string, people array<string>, said string, speech boolean")


def _resolved(frags: DataFrame, speakers: DataFrame) -> DataFrame:
    """One person or none for each fragment with speech: session_key, t, person."""
    # Small beside the texts, and read several times: cut here, so that fragments are tagged once.
    one = checkpointed(frags.where("speech").groupBy("session_key", "t").agg(F.max_by(F.struct("people", "role"), "ord").alias("x")).select("session_key", "t", "x.people", "x.role"))
    sure = one.where("size(people) = 1").groupBy("session_key", F.col("people")[0].alias("person")).agg(F.count(F.lit(1)).alias("n"))
    roles = speakers.select(F.col("person_id").alias("person"), F.lower("role_name").alias("of")).distinct()
    several = one.where("size(people) > 1").select("session_key", "t", "role", F.explode("people").alias("person"))
    scored = several.join(sure, ["session_key", "person"], "left").join(F.broadcast(roles), "person", "left")
    fits = F.when(F.col("role") == F.col("of"), 1).when((F.col("role") == "member") & (F.col("of") == "questioner"), 1).otherwise(0)
    best = scored.groupBy("session_key", "t").agg(F.min_by("person", F.struct((F.coalesce("n", F.lit(0)) == 0), -fits, -F.coalesce("n", F.lit(0)), "person")).alias("best"))
    return one.join(best, ["session_key", "t"], "left").select("session_key", "t", F.when(F.size("people") == 1, F.col("people")[0]).otherwise(F.col("best")).alias("person"))


def spoken(frags: DataFrame, speakers: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every fragment with speech and its turn: session_key, t, turn, person_id."""
    rows = _resolved(frags, speakers).withColumn("block", F.floor(F.col("t") / block))
    inside = W.partitionBy("session_key", "block").orderBy("t")
    before = W.partitionBy("session_key").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = rows.where("person is not null").groupBy("session_key", "block").agg(F.max_by("person", "t").alias("final"))
    blocks = rows.select("session_key", "block").distinct().join(carried, ["session_key", "block"], "left").select("session_key", "block", F.last("final", ignorenulls=True).over(before).alias("carry"))
    filled = rows.join(blocks, ["session_key", "block"]).select("session_key", "block", "t", "carry", F.coalesce(F.last("person", ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0)), "carry").alias("person_id")).where("person_id is not null")
    flagged = filled.select("session_key", "block", "t", "person_id", (~F.col("person_id").eqNullSafe(F.lag("person_id").over(inside))).cast("int").alias("differs"), F.row_number().over(inside).alias("k"), "carry")
    flagged = flagged.select("session_key", "block", "t", "person_id", F.when(F.col("k") == 1, (~F.col("person_id").eqNullSafe(F.col("carry"))).cast("int")).otherwise(F.col("differs")).alias("new"))
    starts = flagged.groupBy("session_key", "block").agg(F.sum("new").alias("m")).select("session_key", "block", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("offset"))
    return flagged.join(starts, ["session_key", "block"]).select("session_key", "t", (F.col("offset") + F.sum("new").over(inside.rowsBetween(W.unboundedPreceding, 0))).alias("turn"), "person_id")


def turns(frags: DataFrame, speakers: DataFrame) -> DataFrame:
    """Turns: session_key, turn, first_t, last_t, person_id."""
    return spoken(frags, speakers).groupBy("session_key", "turn", "person_id").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def turn_texts(frags: DataFrame, speakers: DataFrame) -> DataFrame:
    """Clean fragments of turns in order: session_key, turn, t, person_id, role, speech."""
    said = frags.where("speech").groupBy("session_key", "t").agg(F.max_by("said", "ord").alias("speech"))
    roles: Column = F.lower("role_name").alias("role")
    return spoken(frags, speakers).join(said, ["session_key", "t"]).join(F.broadcast(speakers.select("person_id", roles).distinct()), "person_id", "left")
