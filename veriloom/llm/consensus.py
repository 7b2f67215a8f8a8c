"""Consensus from several annotators' labels (problem 4), by a competence-and-spamming mixture.

Each label is either truthful, with the annotator's competence theta, or drawn from the annotator's
own guess distribution xi. Expectation-maximisation over all labels yields the posterior of every
item's label, theta (the reliability) and xi. An iteration is two equi-joins and grouped sums with
partial aggregation; a hot item's or annotator's labels are never gathered in one task. Only the small
table of parameters is cut from its lineage, by a reliable checkpoint, once an iteration.

Defined cases: null items, annotators and labels are ignored, as are labels in no known spelling;
repeated rows count once; of an annotator's labels of an item the latest holds, ties in time going
to the greater row id; an item with one label gets that label; ties between labels go to the one
with more votes, then to the order of ``labels``; an empty table gives an empty result; extra
columns are ignored.

Judge runs and brief rows become votes in :func:`judge_votes`; a vote known only to be one of
several labels counts for each by its share.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.sources.tables import checkpointed

# The verdicts of the judge, and the stems their spellings begin with.
VERDICTS = ("faithful", "partial", "overstated", "absent", "contradicted")
STEMS = {"faith": "faithful", "partial": "partial", "overstat": "overstated", "absent": "absent", "notpresent": "absent", "uncorroborated": "absent", "contradict": "contradicted"}
#: Pseudo-counts of competence (right, wrong) and of each guess; iterations at most; the change that ends them.
PRIOR_RIGHT, PRIOR_WRONG, PRIOR_GUESS = 2.0, 1.0, 0.5
ROUNDS, SETTLED = 25, 1e-3
#: Parameters that are all broadcast at most; labels of one item beyond which its posterior is broadcast, if they are also more than one
#: in HEAVY of all labels, so that there are fewer than HEAVY such items. An annotator with more than one in HEAVY is heavy.
PARAMS_MOST, HOT_ROWS, HEAVY = 20_000, 50_000, 10_000


def verdict_of(raw: Column) -> Column:
    """The verdict that a spelling means, null if none: case, marks and white space are ignored."""
    letters = F.regexp_replace(F.lower(raw), r"[^\p{L}]", "")
    return F.coalesce(*(F.when(letters.startswith(s), F.lit(v)) for s, v in STEMS.items()))


def latest_labels(rows: DataFrame) -> DataFrame:
    """The label that holds of each (item, annotator) among rows (item, annotator, label, at, row_id)."""
    known = rows.where("item is not null and annotator is not null and annotator <> '' and label is not null")
    return known.groupBy("item", "annotator").agg(F.max_by("label", F.struct("at", "row_id")).alias("label"))


def spread_of(raw: Column) -> Column:
    """A spread ``k/N`` as struct (k, n); null if it is none."""
    k, n = (F.regexp_extract(raw, r"^\s*(\d{1,9})\s*/\s*(\d{1,9})\s*$", i).try_cast("long") for i in (1, 2))
    return F.when((k <= n) & (n > 0), F.struct(k.alias("k"), n.alias("n")))


def judge_votes(records: DataFrame, brief: DataFrame) -> DataFrame:
    """Every vote of the judge, once: (item, annotator, label, n, alike), ``n`` votes of which ``alike`` is the sum of squared shares.

    records (item, annotator, verdict, spread, samples, at, row_id): each sample of each record is a
    vote; a record without samples gives k votes to its verdict and N-k open ones to any other; one
    without a spread gives one. brief (item, faith, spread, dissent) pools the same records, so it adds no
    second vote: it tells which labels the open votes have, and gives the votes (annotator ``brief``)
    by which its N exceeds the records'. Of these votes, faith gets what its k lacks, each label of
    dissent not seen yet gets one, and the rest is shared evenly among dissent, or all other labels
    if none is named.
    """
    what = F.struct("item", "annotator", "verdict", "spread", "samples")
    unnamed = F.when(F.col("row_id").isNull(), F.xxhash64("item", "annotator", "verdict", "at"))
    once = records.where("item is not null and annotator is not null and annotator <> ''").groupBy("row_id", unnamed.alias("unnamed")).agg(F.max_by(what, F.struct("at", "verdict", "spread", "samples")).alias("x")).select("x.*")
    samples = F.coalesce(F.filter(F.transform("samples", verdict_of), lambda v: v.isNotNull()), F.array().cast("array<string>"))
    kn = F.coalesce(spread_of(F.col("spread")), F.struct(F.lit(1).cast("long").alias("k"), F.lit(1).cast("long").alias("n")))
    sampled = F.transform(samples, lambda v: F.struct(v.alias("label"), F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("open")))
    told = F.array(F.struct(verdict_of(F.col("verdict")).alias("label"), kn["k"].alias("n"), (kn["n"] - kn["k"]).alias("open")))
    votes = checkpointed(once.select("item", "annotator", F.explode(F.when(F.size(samples) > 0, sampled).otherwise(told)).alias("v")).select("item", "annotator", "v.*").where("label is not null").groupBy("item", "annotator", "label").agg(F.sum("n").alias("n"), F.sum("open").alias("open")))

    of = F.array(*(F.lit(v) for v in VERDICTS))
    split = F.array_distinct(F.filter(F.transform(F.split(F.coalesce("dissent", F.lit("")), "[,;/|]"), verdict_of), lambda v: v.isNotNull()))
    rows = brief.where("item is not null").select("item", F.struct(verdict_of(F.col("faith")).alias("faith"), spread_of(F.col("spread")).alias("kn"), split.alias("dissent")).alias("b"))
    briefs = rows.where("b.faith is not null").groupBy("item").agg(F.max("b").alias("b"))
    facts = votes.groupBy("item").agg(*(F.sum(F.when(F.col("label") == v, F.col("n")).otherwise(0)).alias(v) for v in VERDICTS), F.sum("open").alias("open"))
    both = facts.join(briefs, "item", "full").select("item", F.transform(F.array(*VERDICTS), lambda x: F.coalesce(x, F.lit(0))).alias("seen"), F.coalesce("open", F.lit(0)).alias("open"), "b.faith", "b.kn", F.array_except("b.dissent", F.array("b.faith")).alias("dissent"))
    at = lambda v: F.col("seen")[F.array_position(of, v).cast("int") - 1]
    known = F.aggregate("seen", F.lit(0).cast("long"), lambda a, x: a + x)
    unseen = lambda names: F.filter(names, lambda v: at(v) == 0)
    both = both.withColumn("n", F.when(F.col("kn").isNotNull(), F.col("kn.n")).otherwise(known + F.size(unseen(F.concat(F.array("faith"), "dissent")))))
    both = both.select("*", F.coalesce(F.greatest(F.col("n") - known - F.col("open"), F.lit(0)), F.lit(0)).alias("more")).withColumn("loose", F.col("open") + F.col("more")).where("loose > 0")
    lacks = F.when(F.col("faith").isNull(), 0).otherwise(F.least("loose", F.greatest(F.coalesce("kn.k", F.lit(1)) - at(F.col("faith")), F.lit(0))))
    both = both.withColumn("lacks", lacks).withColumn("names", F.when(F.size("dissent") > 0, F.col("dissent")).otherwise(F.filter(of, lambda v: ~v.eqNullSafe(F.col("faith")))))
    both = both.withColumn("new", F.when(F.size("dissent") > 0, unseen(F.col("names"))).otherwise(F.array().cast("array<string>")))
    both = both.withColumn("each", F.when(F.size("new") > 0, F.least(F.lit(1.0), (F.col("loose") - F.col("lacks")) / F.size("new"))).otherwise(0.0))
    even = (F.col("loose") - F.col("lacks") - F.col("each") * F.size("new")) / F.size("names")
    share = lambda v: (F.when(v.eqNullSafe(F.col("faith")), F.col("lacks")).otherwise(0) + F.when(F.array_contains("new", v), F.col("each")).otherwise(0) + F.when(F.array_contains("names", v), even).otherwise(0)) / F.col("loose")
    shares = both.select("item", "more", F.transform(of, lambda v: F.struct(v.alias("label"), share(v).alias("share"))).alias("shares"))

    free = F.filter("shares", lambda x: x["label"] != F.col("but"))
    whole = F.aggregate(free, F.lit(0.0), lambda a, x: a + x["share"])
    fair = F.transform(free, lambda x: F.struct(x["label"].alias("label"), F.when(whole > 1e-9, x["share"] / whole).otherwise(1 / F.size(free)).alias("share")))
    opened = votes.where("open > 0").select("item", "annotator", F.col("label").alias("but"), F.col("open").alias("u")).join(shares, "item").select("item", "annotator", "u", F.explode(fair).alias("x"))
    added = shares.where("more > 0").select("item", F.lit("brief").alias("annotator"), F.col("more").alias("u"), F.explode("shares").alias("x"))
    loose = opened.unionByName(added).where("x.share > 1e-9").select("item", "annotator", "x.label", (F.col("u") * F.col("x.share")).alias("n"), (F.col("u") * F.col("x.share") * F.col("x.share")).alias("alike"))
    return votes.select("item", "annotator", "label", F.col("n").cast("double").alias("n"), F.col("n").cast("double").alias("alike")).where("n > 0").unionByName(loose).groupBy("item", "annotator", "label").agg(F.sum("n").alias("n"), F.sum("alike").alias("alike"))


def _keyed(labels: DataFrame, name: str, key: str, *sums: Column) -> tuple[int, DataFrame]:
    """(seed, rows): one row for each ``name`` with the number ``key`` in its place, a hash by a seed for which no two names share one."""
    for seed in range(64):
        rows = checkpointed(labels.groupBy(F.xxhash64(F.lit(seed), name).alias(key)).agg(F.min(name).alias(name), (F.min(name) != F.max(name)).alias("clash"), F.count(F.lit(1)).alias("rows"), *sums))
        if rows.where("clash").isEmpty():
            return seed, rows.drop("clash")
    raise ValueError(f"no seed tells all values of {name} apart")


def fit(labels: DataFrame, classes: tuple[str, ...] = VERDICTS, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(items, annotators) of labels (item, annotator, label), each row one label, or n labels as of :func:`judge_votes`.

    items: item, label, votes, n_labels, confidence, agreement. annotators: annotator, n_labels,
    reliability, guesses (a map from label to its share when guessing). Labels not in ``classes`` are ignored.

    Items and annotators go as numbers (i, a), labels as their place in ``classes``, and a row holds the values of all classes.
    The labels are kept by item, to meet posteriors, and by annotator, to meet parameters, so a round shuffles sums alone.
    """
    spark, each = labels.sparkSession, range(len(classes))
    one = F.lit(1).cast("long")
    labels = labels if "n" in labels.columns else labels.select("item", "annotator", "label", one.alias("n"), one.alias("alike"))
    place = (F.array_position(F.array(*(F.lit(c) for c in classes)), F.col("label")) - 1).cast("int")
    labels = checkpointed(labels.select("item", "annotator", place.alias("l"), "n", "alike").where("l >= 0"))
    of_class = lambda j, x: F.sum(F.when(F.col("l") == j, x))
    total = lambda x: sum((F.coalesce(F.col(f"{x}{j}"), F.lit(0)) for j in each[1:]), F.coalesce(F.col(f"{x}0"), F.lit(0)))
    by_item, items = _keyed(labels, "item", "i", F.sum("alike").alias("own"), *(of_class(j, F.col("n")).alias(f"v{j}") for j in each))
    by_name, people = _keyed(labels, "annotator", "a", *(of_class(j, F.col("n")).alias(f"n{j}") for j in each))
    n_rows, n_people = people.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count(F.lit(1))).first()
    # An annotator may have labelled most items: then the parameters are broadcast, as are all if they are few.
    few = n_people * len(classes) <= PARAMS_MOST
    people = people.withColumn("heavy", F.lit(True) if few else F.col("rows") * HEAVY > n_rows)
    # And an item may have most labels: then its posterior is broadcast.
    hot = items.where(F.col("rows") > max(HOT_ROWS, n_rows / HEAVY)).select("i", F.lit(True).alias("hot"))
    any_hot, any_heavy = not hot.isEmpty(), few or not people.where("heavy").isEmpty()

    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = labels.select(F.xxhash64(F.lit(by_item), "item").alias("i"), F.xxhash64(F.lit(by_name), "annotator").alias("a"), "l", F.col("n").cast("double").alias("n"))
    rows = rows.join(F.broadcast(hot), "i", "left") if any_hot else rows.withColumn("hot", F.lit(None).cast("boolean"))
    some = F.broadcast(people.where("heavy").select("a", F.lit(True).alias("heavy")))
    rows = rows.withColumn("heavy", F.lit(True)) if few else rows.join(some, "a", "left") if any_heavy else rows.withColumn("heavy", F.lit(None).cast("boolean"))
    kept = [rows.where("hot is null").select("i", "a", "l", "n", "heavy").repartition(n_parts, "i").sortWithinPartitions("i").persist()]
    cold, crowd, light = kept[0], None, None
    if any_hot:
        crowd = rows.where("hot").select("i", "a", "l", "n", "heavy").repartition(n_parts, "a", "i").persist()
        kept.append(crowd)
    if not few:
        light = rows.where("heavy is null").select("i", "a", "l", "n").repartition(n_parts, "a").sortWithinPartitions("a").persist()
        kept.append(light)
    for x in kept:
        x.count()

    # The expressions of a round are made once: making them takes longer than a round of few rows.
    pick = lambda x: F.expr(f"n * element_at(array({', '.join(f'{x}{j}' for j in each)}), l + 1)")
    plus = lambda x: " + ".join(f"{x}{j}" for j in each)
    weights = ["a", "heavy", *(f"log1p(theta / ((1 - theta) * xi{j})) as w{j}" for j in each)]
    score, scores = ["i", "l", pick("w").alias("s")], [F.expr(f"sum(if(l = {j}, s, 0D)) as s{j}") for j in each]
    grown = ["i", *(f"exp(s{j} - greatest({', '.join(f's{x}' for x in each)})) as e{j}" for j in each)]
    normed = ["i", *(f"e{j} / ({plus('e')}) as p{j}" for j in each)]
    shared, shares = ["a", "l", pick("p").alias("m")], [F.expr(f"sum(if(l = {j}, m, 0D)) as m{j}") for j in each]
    counts = [f"n{j}" for j in each]
    competent = ["a", "heavy", "old", *counts, *(f"m{j} * old / (old + (1 - old) * xi{j}) as c{j}" for j in each)]
    fitted = ["a", "heavy", "old", *counts, f"({plus('c')} + {PRIOR_RIGHT}D) / ({plus('n')} + {PRIOR_RIGHT + PRIOR_WRONG}D) as theta"]
    fitted += [f"(n{j} - c{j} + {PRIOR_GUESS}D) / ({plus('n')} - ({plus('c')}) + {len(classes) * PRIOR_GUESS}D) as xi{j}" for j in each]
    last = ["a", "heavy", "theta as old", *counts, *(f"xi{j}" for j in each)]
    apart = [x.where("heavy").drop("heavy") for x in (cold, crowd) if x is not None] if any_heavy else []

    def posterior(state: DataFrame) -> DataFrame:
        """The posterior of every item (i, p0, ..): a label's weight for its own class, over what a guess would give it anyway."""
        known = state.selectExpr(*weights)
        scored = [light.join(known.where("not heavy"), "a").select(*score)] if light is not None else []
        if apart:
            heavy = F.broadcast(known.where("heavy"))
            scored += [x.join(heavy, "a").select(*score) for x in apart]
        # Classes that nobody chose have score 0 each.
        return reduce(DataFrame.unionByName, scored).groupBy("i").agg(*scores).selectExpr(*grown).selectExpr(*normed)

    def truthful(p: DataFrame) -> DataFrame:
        """The sums of n times the posterior of every annotator's labels: a, m0, .."""
        met = cold.join(p, "i").select(*shared)
        if any_hot:
            met = met.unionByName(crowd.join(F.broadcast(p.join(F.broadcast(hot), "i", "left_semi")), "i").select(*shared))
        return met.groupBy("a").agg(*shares)

    # At first the vote share stands for the posterior and for competence.
    prev = people.selectExpr("a", "heavy", "1D as old", *(f"coalesce(n{j}, 0) * 1D as n{j}" for j in each), *(f"0D as xi{j}" for j in each))
    p = items.selectExpr("i", *(f"coalesce(v{j}, 0) / ({' + '.join(f'coalesce(v{x}, 0)' for x in each)}) as p{j}" for j in each))
    for at in range(rounds):
        state = checkpointed(truthful(p).join(prev, "a").selectExpr(*competent).selectExpr(*fitted))
        p = posterior(state)
        moved = state.agg(F.max(F.abs(F.col("theta") - F.col("old")))).first()[0]
        # Shuffles and checkpoints of rounds past are removed once the driver has collected its garbage; else they stay, and its heap fills.
        spark.sparkContext._jvm.System.gc()
        if moved is None or at and moved < SETTLED:
            break
        prev = state.selectExpr(*last)
    p = checkpointed(p)
    for x in kept:
        x.unpersist()
    ranked = F.array(*(F.when(F.col(f"v{j}").isNotNull(), F.struct(F.round(F.col(f"p{j}"), 9).alias("near"), F.col(f"v{j}").alias("n"), F.lit(-j).alias("less"), F.col(f"p{j}").alias("p"), F.lit(c).alias("label"))) for j, c in enumerate(classes)))
    squares = sum((F.coalesce(F.col(f"v{j}") * F.col(f"v{j}"), F.lit(0)) for j in each[1:]), F.coalesce(F.col("v0") * F.col("v0"), F.lit(0)))
    voted = items.join(p, "i").select("item", F.array_max(ranked).alias("x"), total("v").alias("n_labels"), (squares - F.col("own")).alias("alike"))
    agreed = F.when(F.col("n_labels") > 1, F.round(F.col("alike") / (F.col("n_labels") * (F.col("n_labels") - 1)), 6))
    out = voted.select("item", F.col("x.label").alias("label"), F.col("x.n").alias("votes"), "n_labels", F.round("x.p", 6).alias("confidence"), agreed.alias("agreement"))
    guesses = F.filter(F.array(*(F.when(F.col(f"n{j}").isNotNull(), F.struct(F.lit(c).alias("label"), F.round(F.col(f"xi{j}"), 6).alias("share"))) for j, c in sorted(enumerate(classes), key=lambda x: x[1]))), lambda x: x.isNotNull())
    known = state.select("a", "theta", *(f"xi{j}" for j in each))
    annotators = people.join(known, "a").select("annotator", F.round("theta", 6).alias("reliability"), F.map_from_entries(guesses).alias("guesses"), total("n").alias("n_labels"))
    return out, annotators
