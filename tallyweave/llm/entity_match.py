"""Entries of two sources that record the same movement, matched without a shared key and without labels.

Candidates come from equi-joins on several partial keys, never from a cross product: equal amounts within linked accounts,
shared reference numbers, shared names with close amounts, and the name fragments of collective entries. Each candidate
pair is a vector of similarities; a mixture of two regularised Gaussians (matched, unmatched) is fitted to all vectors by
expectation-maximisation. Transitivity is enforced in every E-step: an entry of one source stands for one movement, so
pairs that share an entry compete and their posteriors cannot add up to more than one. Posteriors are the confidences.
"""

from __future__ import annotations

import itertools
import math
import unicodedata
import warnings
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.session import BROADCAST_ROWS, checkpointed

#: Days by which the later source may run ahead of the earlier one, and lag behind it.
AHEAD, LAG = 3, 14
#: Most rounds of expectation-maximisation, and the change of share and means below which the fit has settled. A fit that has not
#: settled by then is used as it is, with a warning.
ROUNDS, SETTLED = 12, 0.002
#: Added to every variance, in squared units of the similarities.
RIDGE = 0.02
#: Pairs of the pooled distribution that each component is mixed with, so that features seldom seen say little.
PRIOR = 5.0
#: Greatest share of the amount that may be kept back as a fee, and cents by which an amount may be off.
FEE, CENTS = 0.035, 10
#: A word of the memos is a set phrase, no name, if at least this share of rows has it and parties rarely do.
COMMON = 0.0005
FEATURES = ("amount", "name", "gap", "gap_ref", "ref", "unit", "link", "kind")
#: Sums of a collective entry's parts that a narrow window of days follows; a window with more is left for the widest, which has no bound.
SUMS = 200_000


def _accents() -> tuple[str, str]:
    """Latin letters with marks and their base letters, by Unicode's decompositions."""
    extra = {"Ø": "O", "Ł": "L", "Đ": "D", "Ħ": "H", "Ŧ": "T", "Æ": "A", "Œ": "O", "ß": "S", "ẞ": "S", "ı": "I"}
    pairs = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]}
    pairs = {a: b for a, b in pairs.items() if "A" <= b <= "Z"} | extra
    return "".join(pairs), "".join(pairs.values())


def _plain(text: Column) -> Column:
    """Upper case without accents, null as empty."""
    return F.regexp_replace(F.translate(F.upper(F.coalesce(text, F.lit(""))), *_accents()), r"\p{M}", "")


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.regexp_replace(text, r"['’]", ""), r"[^A-Z]+"), lambda w: w != ""))


def _numbers(text: Column) -> Column:
    """Reference numbers of four digits or more, joined where blanks or hyphens part them, without leading zeros."""
    joined = F.regexp_replace(text, r"(?<=\d)[ -](?=\d)", "")
    found = F.regexp_extract_all(joined, F.lit(r"(?<![\d.])0*([1-9]\d{3,11})(?![\d.])"), F.lit(1))
    return F.array_distinct(found)


def entries(df: DataFrame, place: str) -> DataFrame:
    """The latest delivery of each entry with its plain texts, words, numbers and unit.

    Columns: id, place (account or ledger), day, amount, kind, who (words of the party), said (words of the memo), refs,
    unit, parts (name fragments of a collective entry). Of deliveries with equal loaded_at the greatest row counts.
    Entries without id, date or amount can't be placed and are left out.
    """
    cols = ["loaded_at", place, "date", "amount", "memo", "kind", "party"]
    last = df.filter("entry_id is not null and date is not null and amount is not null").groupBy("entry_id").agg(F.max(F.struct(*cols)).alias("r")).select(F.col("entry_id").alias("id"), "r.*")
    memo, party = _plain(F.col("memo")), _plain(F.col("party"))
    unit = r"(?:^|[^\w-])([NSEW]-\d{1,4}|\d{1,3}[A-Z]|\d{3})(?=$|[^\w-])"
    in_party = F.regexp_extract(party, r"\(\s*(?:UNIT\s*)?([\w-]+)\s*\)", 1)
    parts = F.regexp_extract(memo, r"(?:^|\s)([A-Z]{2,}(?:/[A-Z]{2,})+)\s*$", 1)
    return last.select(
        "id",
        F.nullif(F.btrim(F.col(place)), F.lit("")).alias("place"),
        F.unix_date("date").alias("day"),
        "amount",
        F.lower("kind").alias("kind"),
        _words(F.regexp_replace(party, r"\([^)]*\)", " ")).alias("who"),
        _words(F.regexp_replace(memo, r"\S*\d\S*", " ")).alias("said"),
        _numbers(memo).alias("refs"),
        F.coalesce(F.nullif(in_party, F.lit("")), F.nullif(F.regexp_extract(memo, unit, 1), F.lit(""))).alias("unit"),
        F.when(parts != "", F.split(parts, "/")).alias("parts"),
    )


def set_phrases(one: DataFrame, other: DataFrame) -> list[str]:
    """Words that memos use as set phrases: those of at least COMMON of a source's rows which parties have a fifth as often at most.

    At most words per memo / COMMON words pass the first test, so the list that the driver gets is bounded.
    """
    rows = one.select("who", "said").union(other.select("who", "said"))
    n = rows.count()
    said = rows.select(F.explode("said").alias("w")).groupBy("w").agg(F.count("*").alias("said"))
    who = rows.select(F.explode("who").alias("w")).groupBy("w").agg(F.count("*").alias("who"))
    frequent = said.filter((F.col("said") >= max(3, math.ceil(COMMON * n))) & (F.length("w") > 1))  # single letters are initials
    return sorted(r.w for r in frequent.join(who, "w", "left").filter(F.coalesce("who", F.lit(0)) * 5 <= F.col("said")).select("w").collect())


def with_names(df: DataFrame, phrases: list[str]) -> DataFrame:
    """Adds `names` (words of party and memo but set phrases), `keys` (first five letters, and sorted letters, of those of four
    and more), `ends` (their first two letters, and their first with their last letter) and `words` (those of five and more)."""
    names = F.array_except(F.array_union("who", "said"), F.array(*(F.lit(w) for w in phrases)) if phrases else F.array().cast("array<string>"))
    long = F.filter("names", lambda w: F.length(w) >= 4)
    letters = F.transform(long, lambda w: F.concat(F.lit("~"), F.array_join(F.array_sort(F.split(w, "(?!^)")), "")))
    ends = F.array_union(F.transform(long, lambda w: F.substring(w, 1, 2)), F.transform(long, lambda w: F.concat(F.substring(w, 1, 1), F.lit("."), F.right(w, F.lit(1)))))
    df = df.withColumn("names", names).withColumns({"ends": F.array_distinct(ends), "words": F.filter("names", lambda w: F.length(w) >= 5)})
    return df.withColumn("keys", F.array_distinct(F.array_union(F.transform(long, lambda w: F.substring(w, 1, 5)), letters)))


def _likeness(a: Column, b: Column) -> Column:
    """Likeness of two words: equal 1, one beginning with the other 0.95 (initials, cut words), five common first letters 0.9,
    the same letters with two swapped 0.9, else by edits in the whole words or in their first six letters."""
    sort = lambda w: F.array_sort(F.split(w, "(?!^)"))
    count = F.levenshtein(a, b)
    head = F.least(F.length(a), F.length(b), F.lit(6))
    heads = F.lit(0.95) * (F.lit(1.0) - F.levenshtein(F.substring(a, F.lit(1), head), F.substring(b, F.lit(1), head)) / head)
    edits = F.greatest(F.lit(1.0) - count / F.greatest(F.length(a), F.length(b)), F.when(head >= 5, heads))
    return (
        F.when(a == b, 1.0)
        .when(a.startswith(b) | b.startswith(a), 0.95)
        .when((F.length(a) >= 5) & (F.length(b) >= 5) & (F.substring(a, 1, 5) == F.substring(b, 1, 5)), F.greatest(F.lit(0.9), edits))
        .when((F.length(a) == F.length(b)) & (count == 2) & (sort(a) == sort(b)), F.greatest(F.lit(0.9), edits))
        .otherwise(edits)
    )


def name_likeness(a: Column, b: Column, collective: Column) -> Column:
    """Mean over the words of the shorter list of the best likeness in the other (of a collective entry, whose words name
    several parties: the best); null where a list is empty."""
    swap = F.size(a) > F.size(b)
    small, big = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    best = F.transform(small, lambda x: F.array_max(F.transform(big, lambda y: _likeness(x, y))))
    mean = F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(small)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.when(collective, F.array_max(best)).otherwise(mean))


def _near() -> Column:
    gap = F.col("a.day") - F.col("b.day")
    return (gap >= -AHEAD) & (gap <= LAG)


def _bucketed(df: DataFrame, spread: bool) -> DataFrame:
    """Adds `bucket` of AHEAD + LAG + 1 days; spread: one row for each bucket in which a partner of the other source may stand."""
    width = AHEAD + LAG + 1
    if not spread:
        return df.withColumn("bucket", F.floor(F.col("day") / width))
    low, high = F.floor((F.col("day") - AHEAD) / width), F.floor((F.col("day") + LAG) / width)
    return df.withColumn("bucket", F.explode(F.array_distinct(F.array(low, high))))


def _pairs(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """(id_a, id_b) of rows that agree in `on` and the bucket and are near in time. Days are nearer than the bucket is wide."""
    x, y = _bucketed(a, False).alias("a"), _bucketed(b, True).alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*on, "bucket"]]
    cond = same[0]
    for s in same[1:]:
        cond &= s
    return x.join(y, cond & _near()).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))


def links(a: DataFrame, b: DataFrame) -> DataFrame:
    """(place_a, place_b): accounts and ledgers that belong together.

    Evidence is counted over all pairs that share amount, days and either a name or a reference number; places are linked
    if a tenth of the evidence of the one with less of it supports the link, twice at least.
    """
    ka, kb = (x.filter("place is not null").select("id", "day", "amount", F.explode(F.array_union("words", F.transform("refs", lambda r: F.concat(F.lit("#"), r)))).alias("k")) for x in (a, b))
    pairs = _pairs(ka, kb, ["amount", "k"]).distinct()
    counts = pairs.join(a.select(F.col("id").alias("id_a"), F.col("place").alias("place_a")), "id_a").join(b.select(F.col("id").alias("id_b"), F.col("place").alias("place_b")), "id_b").groupBy("place_a", "place_b").agg(F.count("*").alias("n"))
    wa, wb = Window.partitionBy("place_a"), Window.partitionBy("place_b")
    strong = counts.withColumn("least", F.least(F.sum("n").over(wa), F.sum("n").over(wb))).filter((F.col("n") >= 2) & (F.col("n") * 10 >= F.col("least")))
    return strong.select("place_a", "place_b")


def _digits(amount: Column) -> Column:
    """The sign and the sorted digits of an amount: equal for swapped digits."""
    return F.concat(F.signum(amount).cast("int").cast("string"), F.lit(":"), F.array_join(F.array_sort(F.split(F.abs(amount).cast("string"), "(?!^)")), ""))


def _band(amount: Column) -> Column:
    """Number of the band of amounts, each FEE wide; near amounts lie in the same or neighbouring bands."""
    return F.floor(F.log(F.greatest(F.abs(amount), F.lit(1)).cast("double")) / math.log1p(2 * FEE)) * 2 + (F.col("amount") < 0).cast("int")


def _signs() -> Column:
    """What tells an entry apart from others of its amount: name keys and numbers."""
    return F.array_union("keys", F.transform("refs", lambda r: F.concat(F.lit("#"), r)))


def _keyed(df: DataFrame, spread: bool) -> DataFrame:
    """(id, day, place, key): a row for each partial key of an entry, as a hash of the key's kind and values.

    Kinds: the amount, its sorted digits, reference numbers, word ends with the band of the amount, the unit with the band.
    `spread` repeats bands for their neighbours. Hashes of equal keys are equal; of unequal ones hardly ever, and then a
    pair more is looked at.
    """
    band = _band(F.col("amount"))
    bands = F.array(*(band + k for k in ((-2, 0, 2) if spread else (0,))))
    one = lambda kind, v: F.array(F.xxhash64(F.lit(kind), v))
    ends = F.flatten(F.transform("ends", lambda e: F.transform(bands, lambda d: F.xxhash64(F.lit("end"), e, d))))
    unit = F.when(F.col("unit").isNotNull(), F.transform(bands, lambda d: F.xxhash64(F.lit("unit"), F.col("unit"), d))).otherwise(F.array().cast("array<bigint>"))
    refs = F.transform("refs", lambda r: F.xxhash64(F.lit("ref"), r))
    every = F.concat(one("amount", F.col("amount")), one("digits", _digits(F.col("amount"))), refs, ends, unit)
    return df.filter("place is not null").select("id", "day", "place", F.explode(F.array_distinct(every)).alias("key"))


def _counted(df: DataFrame) -> DataFrame:
    """`df` with a broadcast hint if its rows, counted, are at most BROADCAST_ROWS."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def candidates(a: DataFrame, b: DataFrame, linked: DataFrame) -> DataFrame:
    """(id_a, id_b), distinct: pairs of linked places that agree in one of the partial keys.

    All kinds of keys meet in one join. Where an entry's place is missing or linked to none, amounts meet through names
    and numbers alone; such entries are few, so the join may broadcast them if they are counted to be.
    """
    # The other source's entries, seen from the linked places.
    seen = b.join(linked, b.place == linked.place_b).drop("place").withColumnRenamed("place_a", "place")
    lost_a = a.join(linked.select(F.col("place_a").alias("place")), "place", "left_anti")
    lost_b = b.join(linked.select(F.col("place_b").alias("place")), "place", "left_anti")
    told = lambda df: df.select("id", "day", "amount", F.explode(_signs()).alias("key"))
    found = _pairs(_keyed(a, False), _keyed(seen, True), ["place", "key"])
    found = found.union(_pairs(_counted(told(lost_a)), told(b), ["amount", "key"]))
    return found.union(_pairs(told(a), _counted(told(lost_b)), ["amount", "key"])).distinct()


def collective(a: DataFrame, b: DataFrame, linked: DataFrame) -> DataFrame:
    """(id_a, id_b, uses): parts of entries that record several of the other source's at once; `uses` members of class id_b.

    A collective entry names its parts by fragments; for each, entries of linked places (any place where the account is
    null) whose name begins so are looked up, and one per fragment is chosen so that the amounts add up exactly; of
    several choices that with the fewest days between counts. Entries whose parts don't add up give no rows. A class of
    `b` may serve as many fragments as it has members (column n).
    """
    many = a.filter("parts is not null").select("id", "day", "amount", "place", F.posexplode("parts").alias("part", "piece"))
    many = many.withColumn("k", F.substring("piece", 1, 3))
    # Fragments of two letters meet names by two, longer ones by three.
    heads = F.array_distinct(F.array(F.substring("w", 1, 2), F.substring("w", 1, 3)))
    names = b.select("id", "day", "amount", "place", F.col("n").alias("members"), F.explode("names").alias("w")).filter(F.length("w") >= 2).withColumn("k", F.explode(heads))
    seen = names.join(linked, names.place == linked.place_b).drop("place", "place_b").withColumnRenamed("place_a", "place")
    begins = F.col("b.w").startswith(F.col("a.piece")) | (F.levenshtein(F.substring(F.col("b.w"), F.lit(1), F.length("a.piece")), F.col("a.piece")) <= 1)

    def look(x: DataFrame, y: DataFrame, on: list[str]) -> DataFrame:
        x, y = _bucketed(x, False).alias("a"), _bucketed(y, True).alias("b")
        cond = begins & _near() & (F.col("a.bucket") == F.col("b.bucket")) & (F.abs("b.amount") <= F.abs("a.amount"))
        for c in on:
            cond &= F.col(f"a.{c}") == F.col(f"b.{c}")
        gap = (F.col("a.day") - F.col("b.day")).alias("gap")
        return x.join(y, cond).select("a.id", F.col("a.amount").alias("total"), "a.part", F.col("b.id").alias("id_b"), F.col("b.amount").alias("amount"), gap, "b.members")

    found = look(many, seen, ["place", "k"]).union(look(many.filter("place is null"), names, ["k"])).distinct()
    sizes = a.filter("parts is not null").select("id", F.size("parts").alias("n"))
    # Entries of which a fragment has no candidate can't add up; they need no search.
    whole = found.groupBy("id").agg(F.count_distinct("part").alias("have")).join(sizes, "id").filter("have = n").select("id", "n")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(*(pdf[c].tolist() for c in ("part", "id_b", "amount", "gap", "members"))))
        uses = Counter(add_up(int(pdf["total"].iloc[0]), int(pdf["n"].iloc[0]), rows))
        return pd.DataFrame({"id_a": [int(pdf["id"].iloc[0])] * len(uses), "id_b": list(uses), "uses": list(uses.values())}, dtype="int64")

    # Sums take far more time than their few bytes tell, so they are spread over as many tasks as shuffles have, not coalesced.
    tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.join(whole, "id").repartition(tasks, "id").groupBy("id").applyInPandas(solve, "id_a long, id_b long, uses long")


def add_up(total: int, n: int, rows: list[tuple[int, int, int, int, int]]) -> tuple[int, ...]:
    """One candidate for each of `n` fragments so that the amounts add up to `total`, of several choices that with the fewest days
    (then the least ids); none if there is no choice. `rows` are (fragment, id, amount, days between, members).

    Narrow windows of days are tried first. A window in which more than SUMS sums would have to be followed is left for
    the widest, which follows them all. Candidates that several fragments could use are told apart in what is followed, as
    a sum may be reachable only by a choice that leaves their members free.
    """
    wanted = Counter(i for _, i in {(part, i) for part, i, *_ in rows})
    for days in (1, 3, 7, LAG):
        sums: dict[tuple, tuple] = {(0, ()): (0, ())}
        for part in range(n):
            some = [(i, v, abs(g - 1), m) for k, i, v, g, m in rows if k == part and abs(g) <= days]
            grown: dict[tuple, tuple] = {}
            for (s, shared), (cost, ids) in sums.items():
                for i, v, far, m in some:
                    if abs(s + v) <= abs(total) and ids.count(i) < m:
                        state = (s + v, tuple(sorted((*shared, i))) if wanted[i] > 1 else shared)
                        option = (cost + far, (*ids, i))
                        if state not in grown or option < grown[state]:
                            grown[state] = option
                if len(grown) > SUMS and days < LAG:
                    grown = {}
                    break
            sums = grown
        whole = [option for (s, _), option in sums.items() if s == total]
        if whole:
            return min(whole)[1]
    return ()


def vectors(pairs: DataFrame, a: DataFrame, b: DataFrame, linked: DataFrame) -> DataFrame:
    """`pairs` (id_a, id_b, summed, uses) with the members of both classes and a similarity per feature; null where a side lacks what it takes."""
    cols = ("n", "day", "amount", "kind", "names", "refs", "unit", "place")
    x = pairs
    for side, df in (("a", a), ("b", b)):
        x = x.join(df.select(F.col("id").alias(f"id_{side}"), *(F.col(c).alias(f"{c}_{side}") for c in cols)), f"id_{side}")
    x = x.join(linked.withColumn("is_linked", F.lit(1.0)), ["place_a", "place_b"], "left")
    off = F.abs(F.col("amount_a") - F.col("amount_b"))
    short = (F.col("amount_b") - F.col("amount_a")) / F.greatest(F.abs("amount_b"), F.lit(1))
    gap = F.col("day_a") - F.col("day_b")
    amount = (
        F.when(F.col("summed") | (off == 0), 1.0)
        .when(F.signum("amount_a") != F.signum("amount_b"), 0.0)
        .when(off <= CENTS, 0.8)
        .when(_digits(F.col("amount_a")) == _digits(F.col("amount_b")), 0.75)
        .when(short.between(0, FEE), 0.7)
        .otherwise(0.0)
    )
    have = lambda c: F.size(f"{c}_a").cast("boolean") & F.size(f"{c}_b").cast("boolean")
    return x.select(
        "id_a",
        "id_b",
        "summed",
        "uses",
        "n_a",
        "n_b",
        gap.alias("days"),
        amount.alias("amount"),
        F.round(name_likeness(F.col("names_a"), F.col("names_b"), F.col("summed")), 3).alias("name"),
        # Numbered papers such as cheques take their own time: the days between entries that share a number are a feature apart.
        F.when(~(have("refs") & F.arrays_overlap("refs_a", "refs_b")), gap / 10.0).alias("gap"),
        F.when(have("refs") & F.arrays_overlap("refs_a", "refs_b"), gap / 10.0).alias("gap_ref"),
        F.when(have("refs"), F.arrays_overlap("refs_a", "refs_b").cast("double")).alias("ref"),
        F.when(F.col("unit_a").isNotNull() & F.col("unit_b").isNotNull(), (F.col("unit_a") == F.col("unit_b")).cast("double")).alias("unit"),
        F.when(F.col("place_a").isNotNull() & F.col("place_b").isNotNull(), F.coalesce("is_linked", F.lit(0.0))).alias("link"),
        F.when(F.col("kind_a").isNotNull() & F.col("kind_b").isNotNull(), (F.col("kind_a") == F.col("kind_b")).cast("double")).alias("kind"),
    )


@dataclass
class Mixture:
    """Two Gaussians with diagonal covariances: for each feature (mean, variance) of matched and unmatched, and the share matched."""

    share: float
    matched: dict[str, tuple[float, float]]
    unmatched: dict[str, tuple[float, float]]

    def distance(self, other: Mixture) -> float:
        """Greatest change of the share and of any mean."""
        means = [abs(x[f][0] - y[f][0]) for x, y in ((self.matched, other.matched), (self.unmatched, other.unmatched)) for f in FEATURES]
        return max(abs(self.share - other.share), *means)

    def log_odds(self) -> Column:
        """Log of matched against unmatched density times shares; a missing feature says nothing.

        The parameters are one literal array beside the array of features, so that each round runs the same compiled code.
        """
        terms = [(0.0, 1.0, 0.0, 1.0, math.log(self.share / (1 - self.share)))]
        for f in FEATURES:
            (m, v), (n, w) = self.matched[f], self.unmatched[f]
            terms.append((m, 0.5 / v, n, 0.5 / w, 0.5 * math.log(w / v)))
        names = ("m", "v", "n", "w", "c")
        parameters = F.array(*(F.struct(*(F.lit(float(x)).alias(k) for k, x in zip(names, t))) for t in terms))
        vector = F.array(F.lit(0.0), *(F.col(f) for f in FEATURES))
        each = F.zip_with(vector, parameters, lambda x, p: F.coalesce((x - p["n"]) * (x - p["n"]) * p["w"] - (x - p["m"]) * (x - p["m"]) * p["v"] + p["c"], F.lit(0.0)))
        total = F.aggregate(each, F.lit(0.0), lambda s, x: s + x)
        return F.greatest(F.least(total, F.lit(40.0)), F.lit(-40.0))


def _wants() -> Column:
    """Members of the class id_b that a pair can take: one for each of the class id_a, or those that a collective entry needs."""
    return F.when(F.col("summed"), F.col("uses")).otherwise(F.col("n_a"))


def _rivals(entry: str, members: str, wants: Column) -> Column:
    """Odds of all pairs of a class, rivals only as far as they want more members than the pair leaves them.

    A class of one member is always contended for. Rivals below even odds want none.
    """
    w = Window.partitionBy(entry)
    total = F.sum("odds").over(w)
    strong = F.when(F.col("odds") >= 1, wants).otherwise(0)
    free, others = F.col(members) - wants, F.sum(strong).over(w) - strong
    share = F.when(others > free, (others - free) / others).otherwise(0.0)
    return F.when((free <= 0) | (share == 1), total).otherwise(F.col("odds") + (total - F.col("odds")) * share)


def posteriors(x: DataFrame, log_odds: Column) -> DataFrame:
    """Adds `p`. Pairs that share an entry compete: the odds of one are against no match and all its rivals.

    A collective entry's own parts don't compete for it, nor do pairs for whom a class has members enough.
    """
    odds = x.withColumn("odds", F.exp(log_odds))
    rivals_a = F.when(F.col("summed"), F.col("odds")).otherwise(_rivals("id_a", "n_a", F.col("n_b")))
    rivals = odds.withColumn("rivals_b", _rivals("id_b", "n_b", _wants()))
    return rivals.withColumn("p", F.col("odds") / (1 + F.greatest(rivals_a, F.col("rivals_b")))).drop("odds", "rivals_b")


def fit(x: DataFrame, rounds: int = ROUNDS) -> Mixture:
    """The mixture fitted to all of `x` by expectation-maximisation; each round brings one row of sums to the driver."""
    seed = F.coalesce(F.col("amount") >= 0.7, F.lit(False)) & (F.coalesce(F.col("name"), F.lit(0.0)) >= 0.85) & F.col("days").between(-1, 7) | F.coalesce(F.col("ref") == 1, F.lit(False)) & (F.col("amount") == 1)
    mixture = None
    for _ in range(rounds):
        p = x.withColumn("p", F.when(seed, 0.95).otherwise(0.05)) if mixture is None else posteriors(x, mixture.log_odds())
        q = 1 - F.col("p")
        sums = [F.sum("p").alias("p"), F.count("*").alias("n")]
        for f in FEATURES:
            v = F.col(f)
            for tag, w in (("p", F.col("p")), ("q", q)):
                w, x0 = F.when(v.isNotNull(), w).otherwise(0.0), F.coalesce(v, F.lit(0.0))
                sums += [F.sum(w).alias(f"{tag}_{f}_0"), F.sum(w * x0).alias(f"{tag}_{f}_1"), F.sum(w * x0 * x0).alias(f"{tag}_{f}_2")]
        r = p.agg(*sums).first()
        if not r.n:
            return Mixture(0.5, {f: (0.0, 1.0) for f in FEATURES}, {f: (0.0, 1.0) for f in FEATURES})

        def moments(tag: str, r=r) -> dict[str, tuple[float, float]]:
            out = {}
            for f in FEATURES:
                own, pool = ([sum(r[f"{t}_{f}_{k}"] for t in tags) for k in range(3)] for tags in ((tag,), ("p", "q")))
                weight = PRIOR / max(pool[0], 1e-9)
                n, first, second = (x + weight * y for x, y in zip(own, pool))
                mean = first / max(n, 1e-9)
                out[f] = (mean, max(second / max(n, 1e-9) - mean * mean, 0.0) + RIDGE)
            return out

        before, mixture = mixture, Mixture(min(max(r.p / r.n, 1e-4), 1 - 1e-4), moments("p"), moments("q"))
        if before is not None and before.distance(mixture) < SETTLED:
            break
    else:
        warnings.warn(f"the mixture has not settled in {rounds} rounds", stacklevel=2)
    return mixture


def assign(x: DataFrame, mixture: Mixture, least: float = 0.5) -> DataFrame:
    """(round, id_a, id_b, summed, k, confidence): pairs of classes of posterior `least` and more and how many members each takes;
    each member once (collective entries: each part once).

    In each round every class serves its pairs from the best on while members last, after which the members chosen no longer
    compete and what is left of both classes does, until a round chooses nothing. Each takes a member at least, so the rounds
    end. Ties go to the fewer days, then to the smaller ids.
    """
    rest, chosen = x, None
    better = [F.col("p").desc(), F.abs(F.col("days") - 1), "id_a", "id_b"]
    before = lambda wants, *keys: F.coalesce(F.sum(wants).over(Window.partitionBy(*keys).orderBy(*better).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    for nth in itertools.count():
        ranked = posteriors(rest, mixture.log_odds()).filter(F.col("p") >= least)
        ranked = ranked.withColumn("left_b", F.col("n_b") - before(_wants(), "id_b"))
        ranked = ranked.withColumn("left_a", F.col("n_a") - before(F.col("n_b"), "id_a", "summed"))
        k = F.least(_wants(), "left_b", F.when(~F.col("summed"), F.col("left_a"))).alias("k")
        best = checkpointed(ranked.select(F.lit(nth).alias("round"), "id_a", "id_b", "summed", k, "p").filter("k > 0"))
        chosen = best if chosen is None else chosen.union(best)
        if best.isEmpty():
            break
        if nth % 8 == 7:  # chains free a pair a round; the plan must not grow with them
            chosen = checkpointed(chosen)
        took_a = chosen.filter("not summed").groupBy("id_a").agg(F.sum("k").alias("took_a"))
        took_b = chosen.groupBy("id_b").agg(F.sum("k").alias("took_b"))
        parts = chosen.filter("summed").groupBy("id_a", "id_b").agg(F.sum("k").alias("took"))
        left = lambda n, took: (F.col(n) - F.coalesce(took, F.lit(0))).alias(n)
        rest = x.join(took_b, "id_b", "left").join(took_a, "id_a", "left").join(parts, ["id_a", "id_b"], "left")
        rest = rest.withColumns({"n_a": left("n_a", F.col("took_a")), "n_b": left("n_b", F.col("took_b")), "uses": left("uses", F.col("took"))})
        rest = rest.filter("n_a > 0 and n_b > 0 and (not summed or uses > 0)").select(*x.columns)
    return chosen.withColumnRenamed("p", "confidence")


def classes(df: DataFrame) -> DataFrame:
    """Adds `rep` and `nth`: entries that agree in all evidence are one class, named by its least id and numbered by id.

    Members of a class can't be told apart, so classes are matched instead of entries: a table in which a third of all
    rows agree makes no more pairs than its classes do. Classes are told by 128 bits of a hash. A collective entry is a class
    of its own, as each needs other parts. `n` is the number of members.
    """
    evidence = ["place", "day", "amount", "kind", F.array_sort("names"), F.array_sort("refs"), "unit", F.when(F.col("parts").isNotNull(), F.col("id"))]
    keyed = df.withColumns({f"_h{k}": F.xxhash64(F.lit(k), *evidence) for k in (1, 2)})
    w = Window.partitionBy("_h1", "_h2").orderBy("id")
    n = F.count("*").over(Window.partitionBy("_h1", "_h2"))
    return keyed.withColumns({"nth": F.row_number().over(w), "rep": F.first("id").over(w), "n": n}).drop("_h1", "_h2")


def members(chosen: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(id_a, id_b, confidence) of the members that the pairs of classes in `chosen` take; `a` and `b` have rep, nth and id.

    The pairs of a class take its members by number, one pair after the other. A collective entry is the one member of its class.
    """
    before = lambda *keys: F.coalesce(F.sum("k").over(Window.partitionBy(*keys).orderBy("round", "id_a", "id_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = chosen.withColumns({"from_a": F.when(F.col("summed"), 0).otherwise(before("id_a", "summed")), "from_b": before("id_b")})
    x = x.select(F.col("id_a").alias("rep_a"), F.col("id_b").alias("rep_b"), "summed", "from_a", "from_b", "confidence", F.explode(F.sequence(F.lit(1).cast("bigint"), "k")).alias("i"))
    x = x.withColumns({"nth_a": F.when(F.col("summed"), 1).otherwise(F.col("from_a") + F.col("i")), "nth_b": F.col("from_b") + F.col("i")})
    for side, df in (("a", a), ("b", b)):
        x = x.join(df.select(F.col("rep").alias(f"rep_{side}"), F.col("nth").cast("bigint").alias(f"nth_{side}"), F.col("id").alias(f"id_{side}")), [f"rep_{side}", f"nth_{side}"])
    return x.select("id_a", "id_b", "confidence")


def match(bank: DataFrame, book: DataFrame) -> DataFrame:
    """(id_a, id_b, confidence): the bank's and the ledger's entries that record the same movement.

    Null parties, memos, kinds and places are missing evidence, not disagreement. Repeated deliveries count once. Of
    entries that agree in all evidence the n-th of one source pairs with the n-th of the other; those beyond go on to the
    next best class. Empty tables give an empty result.
    """
    a, b = checkpointed(entries(bank, "account")), checkpointed(entries(book, "ledger_name"))
    phrases = set_phrases(a, b)
    a, b = (checkpointed(classes(with_names(x, phrases))) for x in (a, b))
    all_a, all_b = (x.select("rep", "nth", "id") for x in (a, b))
    a, b = (x.filter("nth = 1").drop("rep", "nth") for x in (a, b))
    linked = _counted(checkpointed(links(a, b)))
    sums = collective(a, b, linked).select("id_a", "id_b", F.lit(True).alias("summed"), "uses")
    single = candidates(a.filter("parts is null"), b, linked)
    pairs = single.select("id_a", "id_b", F.lit(False).alias("summed"), F.lit(1).cast("bigint").alias("uses")).union(sums)
    x = checkpointed(vectors(pairs, a, b, linked))
    return members(assign(x, fit(x)), all_a, all_b)
