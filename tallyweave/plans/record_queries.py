"""Queries of the reference's own operators on the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import dates, decimals, hashing, money, text
from tallyweave.operators import findings as found
from tallyweave.operators import evidence, ledger, logs, manifest, markup, merkle, registry
from tallyweave.session import shared_folder, spread, table
from tallyweave.sinks import reports
from tallyweave.sources import delimited, files
from tallyweave.streaming import journal

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        key = name or run.__name__
        QUERIES[key] = run
        if sql is not None:
            ORACLE[key] = sql
        return run

    return add


# Sources as the operators see them. Repeated deliveries of an entry differ in loaded_at only.

_BANK = "bank AS (SELECT DISTINCT entry_id AS id, account AS place, date, amount, memo, kind, party FROM bank_entry)"
_BOOK = "book AS (SELECT DISTINCT entry_id AS id, ledger_name AS place, date, amount, memo, kind, party FROM book_entry)"
_INGEST = "tx AS (SELECT DISTINCT ingest_id AS id, source, ledger_code, date, amount, memo, kind, party FROM ingest)"
_FINDINGS = """f AS (SELECT 'doc' || l_orderkey AS source, 'BR-' || (l_suppkey % 40) AS rule,
  CASE l_returnflag WHEN 'A' THEN 'fatal' WHEN 'R' THEN 'warning' ELSE 'information' END AS severity, l_linestatus AS message, 'line/' || l_linenumber AS location, l_linenumber AS line FROM lineitem)"""
_KEY = """coalesce(CAST(date AS VARCHAR), '') || '|' || lpad(coalesce(CAST(amount AS VARCHAR), ''), 16, '0') || '|' ||
  trim(regexp_replace(lower(coalesce(memo, '')), '[ \\t\\r\\n]+', ' ', 'g')) || '|' || trim(regexp_replace(lower(coalesce(party, '')), '[ \\t\\r\\n]+', ' ', 'g'))"""


def _bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "bank_entry").select(F.col("entry_id").alias("id"), F.col("account").alias("place"), "date", "amount", "memo", "kind", "party").distinct()


def _book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "book_entry").select(F.col("entry_id").alias("id"), F.col("ledger_name").alias("place"), "date", "amount", "memo", "kind", "party").distinct()


def _ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "ingest").select(F.col("ingest_id").alias("id"), "source", "ledger_code", "date", "amount", "memo", "kind", "party").distinct()


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.when(F.col("l_returnflag") == "A", "fatal").when(F.col("l_returnflag") == "R", "warning").otherwise("information")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("doc"), F.col("l_orderkey")).alias("source"), F.concat(F.lit("BR-"), F.col("l_suppkey") % 40).alias("rule"), severity.alias("severity"),
        F.col("l_linestatus").alias("message"), F.concat(F.lit("line/"), F.col("l_linenumber")).alias("location"), F.col("l_linenumber").alias("line"),
    )


# --- Transactions ---------------------------------------------------------------------------------------------------


@query(f"""WITH {_INGEST}, s AS (SELECT CAST(coalesce(sum(amount) FILTER (source = 'bank'), 0) AS BIGINT) AS bank, CAST(coalesce(sum(amount) FILTER (source = 'quickbooks'), 0) AS BIGINT) AS book,
  CAST(coalesce(sum(amount) FILTER (source = 'rent_roll'), 0) AS BIGINT) AS rentroll FROM tx)
  SELECT *, greatest(bank, book, rentroll) - least(bank, book, rentroll) AS gap, greatest(bank, book, rentroll) = least(bank, book, rentroll) AS ties_out FROM s""")  # fmt: skip
def three_way_tieout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.tie_out_rows(_ingest(spark, sf_dir), {"bank": "bank", "book": "quickbooks", "rentroll": "rent_roll"})


_PARTIES = f"WITH {_INGEST}, p AS (SELECT coalesce(nullif(trim(party), ''), 'unknown') AS party, CAST(coalesce(sum(amount), 0) AS BIGINT) AS balance FROM tx GROUP BY 1)"


@query(f"{_PARTIES} SELECT * FROM p")
def party_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.party_balances(_ingest(spark, sf_dir))


@query(f"{_PARTIES} SELECT * FROM p WHERE balance < -100000 AND party NOT IN (SELECT coalesce(nullif(trim(party), ''), 'unknown') FROM ingest WHERE kind = 'nsf')")
def negative_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = _ingest(spark, sf_dir)
    control = ledger.party_balances(tx.filter("kind = 'nsf'"))
    return ledger.negative_balances(ledger.party_balances(tx), 100_000, control)


@query(f"""WITH {_BANK}, {_BOOK}, n AS (SELECT *, row_number() OVER (PARTITION BY amount ORDER BY {_KEY}, id) AS nth FROM bank),
  o AS (SELECT amount, count(*) AS c FROM book GROUP BY 1) SELECT id, amount FROM n LEFT JOIN o USING (amount) WHERE nth > coalesce(c, 0)""")
def residue_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.residue(_bank(spark, sf_dir), _book(spark, sf_dir)).select("id", "amount")


@query(f"""WITH {_BANK}, {_BOOK}, a AS (SELECT id, amount, date, row_number() OVER (PARTITION BY amount, date ORDER BY {_KEY}, id) AS n FROM bank),
  b AS (SELECT id, amount, date, row_number() OVER (PARTITION BY amount, date ORDER BY {_KEY}, id) AS n FROM book)
  SELECT a.id AS id_a, b.id AS id_b, CAST(1 AS DOUBLE) AS confidence FROM a JOIN b USING (amount, date, n)""")
def match_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.match_exact(_bank(spark, sf_dir), _book(spark, sf_dir))


@query(f"""WITH {_BANK}, {_BOOK} SELECT a.id AS id_a, b.id AS id_b, CAST(abs(a.date - b.date) AS INTEGER) AS gap FROM bank a JOIN book b ON a.amount = b.amount AND abs(a.date - b.date) <= 3""")
def match_window_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.window_pairs(_bank(spark, sf_dir), _book(spark, sf_dir), 3).select("id_a", "id_b", F.col("gap").cast("int").alias("gap"))


# SQL of the greedy choice: the pairs of a key in order, taken one by one while both ends are free. Of splits: all pairs, then all triples.

_SIMILAR = "CASE WHEN len(x) + len(y) = 0 THEN 1e0 ELSE CAST(len(list_intersect(x, y)) AS DOUBLE) / len(list_distinct(list_concat(x, y))) END"
_WORD_SET = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^a-z0-9]+'), lambda w: w <> ''))"
_BOUNCED = "coalesce({0}.kind = 'nsf' OR regexp_matches(lower({0}.memo), '\\bnsf\\b|returned|bounced|insufficient|reversal'), false)"


def _greedy(n: str, a: str, b: str, days: int, sign: str = "", also: str = "true") -> str:
    """CTEs `n`_q (the pairs) to `n` (id_a, id_b, gap, score): the greedy choice among rows of `a` and `b` of equal (or with a sign opposite) amounts."""
    return f"""{n}_q AS (SELECT key, id_a, id_b, gap, {_SIMILAR} AS score FROM (SELECT a.amount AS key, a.id AS id_a, b.id AS id_b, abs(a.date - b.date) AS gap, {_WORD_SET.format("a.memo")} AS x, {_WORD_SET.format("b.memo")} AS y
    FROM {a} a JOIN {b} b ON a.amount = {sign}b.amount AND abs(a.date - b.date) <= {days} AND {also})),
  {n}_p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY gap, score DESC, id_a, id_b) AS r FROM {n}_q),
  {n}_g AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS ua, CAST([] AS BIGINT[]) AS ub, false AS took FROM {n}_p UNION ALL
    SELECT key, r, CASE WHEN free THEN list_append(ua, id_a) ELSE ua END, CASE WHEN free THEN list_append(ub, id_b) ELSE ub END, free FROM (
      SELECT p.key, p.r, ua, ub, id_a, id_b, NOT list_contains(ua, id_a) AND NOT list_contains(ub, id_b) AS free FROM {n}_g g JOIN {n}_p p ON p.key = g.key AND p.r = g.r + 1)),
  {n} AS (SELECT id_a, id_b, gap, score FROM {n}_p SEMI JOIN (SELECT key, r FROM {n}_g WHERE took) USING (key, r))"""


def _splits(n: str, single: str, parts: str, days: int) -> str:
    """CTEs up to `n` (id, part_ids): rows of `single` that two or three of at most 24 smaller rows of `parts` add up to; `n`_n counts these."""
    return f"""{n}_c AS (SELECT s.id, s.amount, p.id AS part, p.amount AS pa FROM {single} s JOIN {parts} p ON sign(s.amount) = sign(p.amount) AND abs(p.amount) < abs(s.amount) AND abs(s.date - p.date) <= {days}),
  {n}_n AS (SELECT id, count(*) AS candidates FROM {n}_c GROUP BY 1), {n}_f AS (SELECT {n}_c.* FROM {n}_c SEMI JOIN (SELECT id FROM {n}_n WHERE candidates BETWEEN 2 AND 24) USING (id)),
  {n}_w AS (SELECT a.id, [a.part, b.part] AS part_ids FROM {n}_f a JOIN {n}_f b ON a.id = b.id AND a.part < b.part AND a.pa + b.pa = a.amount UNION ALL
    SELECT a.id, [a.part, b.part, c.part] FROM {n}_f a JOIN {n}_f b ON a.id = b.id AND a.part < b.part JOIN {n}_f c ON c.id = b.id AND b.part < c.part AND a.pa + b.pa + c.pa = a.amount),
  {n}_o AS (SELECT * FROM {n}_w QUALIFY row_number() OVER (PARTITION BY id ORDER BY len(part_ids), part_ids) = 1),
  {n} AS (SELECT id, part_ids FROM (SELECT id, part_ids, min(id) OVER (PARTITION BY part) AS first FROM (SELECT id, part_ids, unnest(part_ids) AS part FROM {n}_o)) GROUP BY ALL HAVING bool_and(first = id))"""


@query(f"""WITH RECURSIVE {_BANK}, {_BOOK}, {_greedy("m", "bank", "book", 3)} SELECT id_a, id_b, 5e-1 * (1 - gap / 4e0) + 5e-1 * score AS confidence FROM m""")
def match_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.match_window(_bank(spark, sf_dir), _book(spark, sf_dir), 3)


@query(f"""WITH RECURSIVE {_BANK}, {_BOOK}, {_greedy("m", "bank", "book", 14, "-", f"({_BOUNCED.format('a')} OR {_BOUNCED.format('b')})")} SELECT id_a, id_b, least(95e-2, 5e-1 * (1 - gap / 15e0) + 5e-1 * score) AS confidence FROM m""")
def match_reversals(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = (F.col("kind") == "nsf") | F.lower("memo").rlike(text.RETURNED)
    return ledger.match_reversals(_bank(spark, sf_dir), _book(spark, sf_dir), returned, 14)


_RESIDUES = f"""na AS (SELECT *, row_number() OVER (PARTITION BY amount ORDER BY {_KEY}, id) AS nth FROM bank), nb AS (SELECT *, row_number() OVER (PARTITION BY amount ORDER BY {_KEY}, id) AS nth FROM book),
  ca AS (SELECT amount, count(*) AS c FROM bank GROUP BY 1), cb AS (SELECT amount, count(*) AS c FROM book GROUP BY 1),
  ra AS (SELECT * FROM na LEFT JOIN cb USING (amount) WHERE nth > coalesce(c, 0)), rb AS (SELECT * FROM nb LEFT JOIN ca USING (amount) WHERE nth > coalesce(c, 0))"""


@query(f"""WITH {_BANK}, {_BOOK}, {_RESIDUES}, {_splits("s", "ra", "rb", 2)} SELECT id, array_to_string(part_ids, ',') AS part_ids, 99e-2 AS confidence FROM s""")
def match_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank, book = _bank(spark, sf_dir), _book(spark, sf_dir)
    # Of the rest that no single entry equals. Parts may be any party's, as a batch names several; the sides' places share no key.
    found = ledger.match_splits(ledger.residue(bank, book).drop("place"), ledger.residue(book, bank).drop("place"), 2, 3, 24)
    return found.withColumn("part_ids", F.array_join(F.col("part_ids").cast("array<string>"), ","))


_RANKED = "SELECT id, amount, date, row_number() OVER (PARTITION BY amount, date ORDER BY {key}, id) AS n FROM {side}"
_PASSES = f"""ex AS (SELECT a.id AS id_a, b.id AS id_b FROM ({_RANKED.format(key=_KEY, side="bank")}) a JOIN ({_RANKED.format(key=_KEY, side="book")}) b USING (amount, date, n)),
  a1 AS (SELECT * FROM bank ANTI JOIN (SELECT id_a AS id FROM ex) USING (id)), b1 AS (SELECT * FROM book ANTI JOIN (SELECT id_b AS id FROM ex) USING (id)), {_greedy("wi", "a1", "b1", 3)},
  a2 AS (SELECT * FROM a1 ANTI JOIN (SELECT id_a AS id FROM wi) USING (id)), b2 AS (SELECT * FROM b1 ANTI JOIN (SELECT id_b AS id FROM wi) USING (id)), {_greedy("re", "a2", "b2", 3, "-", f"({_BOUNCED.format('a')} OR {_BOUNCED.format('b')})")},
  a3 AS (SELECT * FROM a2 ANTI JOIN (SELECT id_a AS id FROM re) USING (id)), b3 AS (SELECT * FROM b2 ANTI JOIN (SELECT id_b AS id FROM re) USING (id)), {_splits("s1", "a3", "b3", 3)},
  a4 AS (SELECT * FROM a3 ANTI JOIN s1 USING (id)), b4 AS (SELECT * FROM b3 ANTI JOIN (SELECT unnest(part_ids) AS id FROM s1) USING (id)), {_splits("s2", "b4", "a4", 3)},
  a5 AS (SELECT * FROM a4 ANTI JOIN (SELECT unnest(part_ids) AS id FROM s2) USING (id)), b5 AS (SELECT * FROM b4 ANTI JOIN s2 USING (id))"""


@query(f"""WITH RECURSIVE {_BANK}, {_BOOK}, {_PASSES}
  SELECT 'a' AS side, id_a AS id, 'exact' AS bucket FROM ex UNION ALL SELECT 'b', id_b, 'exact' FROM ex UNION ALL SELECT 'a', id_a, 'window' FROM wi UNION ALL SELECT 'b', id_b, 'window' FROM wi
  UNION ALL SELECT 'a', id_a, 'reversal' FROM re UNION ALL SELECT 'b', id_b, 'reversal' FROM re UNION ALL SELECT 'a', id, 'split' FROM s1 UNION ALL SELECT 'b', unnest(part_ids), 'split' FROM s1
  UNION ALL SELECT 'b', id, 'split' FROM s2 UNION ALL SELECT 'a', unnest(part_ids), 'split' FROM s2
  UNION ALL SELECT 'a', id, CASE WHEN candidates > 24 THEN 'declined' ELSE 'unmatched' END FROM a5 LEFT JOIN s1_n USING (id) UNION ALL SELECT 'b', id, CASE WHEN candidates > 24 THEN 'declined' ELSE 'unmatched' END FROM b5 LEFT JOIN s2_n USING (id)""")
def match_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of either side with the bucket it ends in; `declined` has unmatched rows with too many candidates for a split to be searched."""
    returned = (F.col("kind") == "nsf") | F.lower("memo").rlike(text.RETURNED)
    out = ledger.match_all(_bank(spark, sf_dir), _book(spark, sf_dir), returned)
    m, s = out["matched"], out["splits"]
    single = F.when(F.col("single_side") == "a", "a").otherwise("b")
    parts = F.when(F.col("single_side") == "a", "b").otherwise("a")
    bucket = F.when(F.col("candidates").isNotNull(), "declined").otherwise("unmatched").alias("bucket")
    rest = lambda side: out[f"unmatched_{side}"].join(out[f"declined_{side}"], "id", "left").select(F.lit(side).alias("side"), "id", bucket)
    rows = [
        m.select(F.lit("a").alias("side"), F.col("id_a").alias("id"), F.col("kind").alias("bucket")), m.select(F.lit("b").alias("side"), F.col("id_b").alias("id"), F.col("kind").alias("bucket")),
        s.select(single.alias("side"), "id", F.lit("split").alias("bucket")), s.select(parts.alias("side"), F.explode("part_ids").alias("id"), F.lit("split").alias("bucket")),
        rest("a"), rest("b"),
    ]
    union = rows[0]
    for r in rows[1:]:
        union = union.unionByName(r)
    return union


_WORDS = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH {_BANK}, n AS (SELECT DISTINCT party AS name, {_WORDS.format("party")} AS w FROM book_entry WHERE party IS NOT NULL), m AS (SELECT id, {_WORDS.format("coalesce(memo, '')")} AS w FROM bank),
  h AS (SELECT m.id, n.name, row_number() OVER (PARTITION BY m.id ORDER BY len(n.w) - len(replace(n.w, ' ', '')) DESC, len(n.name) DESC, n.name) AS r
    FROM m JOIN n ON n.w <> '' AND contains(' ' || m.w || ' ', ' ' || n.w || ' '))
  SELECT bank.id, h.name FROM bank LEFT JOIN h ON h.id = bank.id AND h.r = 1""")  # fmt: skip
def memo_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "book_entry").filter("party is not null").select(F.col("party").alias("name")).distinct()
    return ledger.attribute(_bank(spark, sf_dir), names)


@query(f"""WITH {_BOOK}, need AS (SELECT id, party, date, amount, memo, trim(regexp_replace(lower(coalesce(party, '')), '[ \\t\\r\\n]+', ' ', 'g')) AS p0, {_KEY} AS k FROM book WHERE kind = 'deposit' AND amount > 0),
  n AS (SELECT *, CASE WHEN p0 = '' THEN 'unknown' ELSE p0 END AS p FROM need),
  own AS (SELECT coalesce(nullif(trim(regexp_replace(lower(coalesce(party, '')), '[ \\t\\r\\n]+', ' ', 'g')), ''), 'unknown') AS p, sum(-amount) AS cents FROM book WHERE amount < 0 GROUP BY 1),
  x AS (SELECT n.*, coalesce(cents, 0) AS cents, coalesce(sum(amount) OVER (PARTITION BY p ORDER BY k, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n LEFT JOIN own USING (p)),
  y AS (SELECT *, greatest(0, least(amount, cents - before)) AS from_own FROM x), z AS (SELECT *, amount - from_own AS short FROM y),
  d AS (SELECT id, greatest(0, least(short, 500000000 - coalesce(sum(short) OVER (ORDER BY k, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS from_pool FROM z WHERE short > 0)
  SELECT z.id, CAST(from_own AS BIGINT) AS from_own, CAST(coalesce(from_pool, 0) AS BIGINT) AS from_pool, CAST(short - coalesce(from_pool, 0) AS BIGINT) AS uncovered FROM z LEFT JOIN d USING (id)""")  # fmt: skip
def sequential_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = _book(spark, sf_dir)
    needs = book.filter("kind = 'deposit' and amount > 0").select("id", "party", "date", "amount", "memo")
    own = book.filter("amount < 0").select("party", (-F.col("amount")).alias("cents"))
    return ledger.allocate(needs, own, 500_000_000).select("id", "from_own", "from_pool", F.col("uncovered").cast("bigint").alias("uncovered"))


@query("""WITH m AS (SELECT o_custkey AS key, strftime(date_trunc('month', o_orderdate), '%Y-%m') AS period, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS flow FROM orders GROUP BY ALL),
  e AS (SELECT key, period, CAST(sum(flow) OVER w AS BIGINT) AS ending, CAST(sum(flow) OVER w AS BIGINT) - flow + CASE WHEN flow % 7 = 0 THEN 1 ELSE 0 END AS opening FROM m WINDOW w AS (PARTITION BY key ORDER BY period))
  SELECT key, period, opening, ending, opening - lag(ending) OVER (PARTITION BY key ORDER BY period) AS gap FROM e""")  # fmt: skip
def continuity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key"), F.date_format("o_orderdate", "yyyy-MM").alias("period")).agg(F.sum(cents).alias("flow"))
    ending = F.sum("flow").over(Window.partitionBy("key").orderBy("period"))
    off = F.when(F.col("flow") % 7 == 0, 1).otherwise(0)
    return ledger.continuity(m.select("key", "period", (ending - F.col("flow") + off).alias("opening"), ending.alias("ending")))


@query(f"""WITH {_INGEST} SELECT kind, count(*) AS count, CAST(sum(abs(amount)) AS BIGINT) AS impact, CAST(grouping(kind) AS BIGINT) AS level FROM tx GROUP BY ROLLUP (kind)""")
def kind_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found.roll_up(_ingest(spark, sf_dir), "kind", "amount")


@query(f"""WITH {_BANK}, b AS (SELECT place, CAST(sum(amount) FILTER (amount > 0) AS BIGINT) AS money_in, CAST(sum(-amount) FILTER (amount < 0) AS BIGINT) AS money_out FROM bank GROUP BY 1)
  SELECT place, balance, cents, CASE WHEN cents < 0 THEN '-' ELSE '' END || '$' || format('{{:,}}', abs(cents) // 100) || '.' || lpad(CAST(abs(cents) % 100 AS VARCHAR), 2, '0') AS shown
  FROM (SELECT place, 'money_in' AS balance, money_in AS cents FROM b UNION ALL SELECT place, 'money_out', money_out FROM b)""")  # fmt: skip
def balances_unpivoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bank(spark, sf_dir).groupBy("place").agg(F.sum(F.when(F.col("amount") > 0, F.col("amount"))).alias("money_in"), F.sum(F.when(F.col("amount") < 0, -F.col("amount"))).alias("money_out"))
    return reports.balances_long(b, ["place"], ["money_in", "money_out"])


@query(f"""WITH {_BANK}, {_BOOK}, e AS (SELECT id, amount FROM bank WHERE kind = 'nsf')
  SELECT 'nsf' AS type, e.amount, CAST(k.date AS VARCHAR) AS record_date, k.amount AS record_amount, k.memo AS record_memo, CASE WHEN k.amount > 0 THEN 'in' WHEN k.amount < 0 THEN 'out' ELSE '' END AS direction
  FROM e LEFT JOIN book k ON k.amount = -e.amount""")  # fmt: skip
def exceptions_outer_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank, book = _bank(spark, sf_dir), _book(spark, sf_dir)
    # Records are packed by amount first, so an amount with many exceptions carries one list.
    records = book.groupBy((-F.col("amount")).alias("amount")).agg(F.collect_list(F.struct("date", "amount", "memo", "party")).alias("records"))
    e = bank.filter("kind = 'nsf'").join(records, "amount", "left").select(F.lit("nsf").alias("type"), F.lit("warning").alias("severity"), "amount", F.lit("returned").alias("label"), "records")
    return reports.exceptions_long(e).select("type", "amount", F.col("record_date").cast("string").alias("record_date"), "record_amount", "record_memo", "direction")


@query(f"""WITH {_BANK} SELECT id, place, date, amount, coalesce(memo, '') AS memo, coalesce(party, '') AS party FROM (SELECT id, place, CAST(date AS VARCHAR) AS date, amount,
  trim(coalesce(memo, '')) AS memo, trim(coalesce(party, '')) AS party FROM bank WHERE amount IS NOT NULL AND date IS NOT NULL)""")
def ofx_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bank entry written as an OFX block with unclosed tags and read again."""
    plain = lambda c: F.btrim(F.coalesce(c, F.lit("")))
    cents = F.abs("amount")
    shown = F.concat(F.when(F.col("amount") < 0, "-").otherwise(""), F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    block = F.concat(F.lit("<STMTTRN>\n<TRNTYPE>OTHER\n<DTPOSTED>"), F.date_format("date", "yyyyMMdd"), F.lit("120000\n<TRNAMT>"), shown, F.lit("\n<NAME>"), plain(F.col("party")), F.lit("\n<MEMO>"), plain(F.col("memo")), F.lit("\n</STMTTRN>"))
    texts = _bank(spark, sf_dir).filter("amount is not null and date is not null").select("id", "place", block.alias("value"))
    b = F.col("block")
    x = delimited.ofx_blocks(texts, "value")
    return x.select(
        "id", "place", dates.parse_date(F.substring(delimited.ofx_value(b, "DTPOSTED"), 1, 8)).cast("string").alias("date"), money.parse_cents(delimited.ofx_value(b, "TRNAMT")).alias("amount"),
        F.coalesce(delimited.ofx_value(b, "MEMO"), F.lit("")).alias("memo"), F.coalesce(delimited.ofx_value(b, "NAME"), F.lit("")).alias("party"),
    )


def _diagnosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest rows as cells of their files, dates and amounts as text."""
    x = table(spark, sf_dir, "ingest").select("file_id", "ingest_id", "date", "amount", "memo", "kind").distinct()
    shown = F.concat(F.when(F.col("amount") < 0, "-").otherwise(""), F.floor(F.abs("amount") / 100).cast("string"), F.lit("."), F.lpad((F.abs("amount") % 100).cast("string"), 2, "0"))
    cells = x.select("file_id", "ingest_id", F.col("date").alias("Posting Date"), shown.alias("Amt"), F.col("memo").alias("Description"), F.col("kind").alias("Transaction Type"))
    return delimited.normalized(cells, "bank", keep=("file_id", "ingest_id"))


_CELLS = """c AS (SELECT DISTINCT file_id, ingest_id, date AS written, trim(date) AS s, amount, memo, kind FROM ingest),
  e AS (SELECT *, CASE WHEN day IS NULL THEN 'date' WHEN amount IS NULL THEN 'amount' END AS error FROM (SELECT *, CAST({day} AS DATE) AS day FROM c))"""


# --- Scalars --------------------------------------------------------------------------------------------------------


@query(f"""WITH {_BANK} SELECT id, CASE WHEN amount < 0 THEN '-' ELSE '' END || '$' || format('{{:,}}', abs(amount) // 100) || '.' || lpad(CAST(abs(amount) % 100 AS VARCHAR), 2, '0') AS shown, amount AS parsed FROM bank""")
def money_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _bank(spark, sf_dir).withColumn("shown", money.format_cents(F.col("amount")))
    # Signs stand behind the currency in the grammar.
    return x.select("id", "shown", money.parse_cents(F.regexp_replace("shown", r"^-\$", r"\$-")).alias("parsed"))


_DAY = """CASE WHEN regexp_full_match(s, '\\d{4}-\\d{2}-\\d{2}') THEN try_strptime(s, '%Y-%m-%d') WHEN regexp_full_match(s, '\\d{1,2}/\\d{1,2}/\\d{4}') THEN try_strptime(s, '%m/%d/%Y')
  WHEN regexp_full_match(s, '\\d{1,2}/\\d{1,2}/\\d{2}') THEN try_strptime(regexp_replace(s, '/(\\d\\d)$', '/20\\1'), '%m/%d/%Y') WHEN regexp_full_match(s, '\\d{8}') THEN try_strptime(s, '%Y%m%d')
  WHEN regexp_full_match(s, '[A-Za-z]{3} +\\d{1,2},? +\\d{4}') THEN try_strptime(s, '%b %d, %Y') WHEN regexp_full_match(s, '[A-Za-z]{4,9} +\\d{1,2},? +\\d{4}') THEN try_strptime(s, '%B %d, %Y')
  WHEN regexp_full_match(s, '\\d{1,2}-[A-Za-z]{3}-\\d{4}') THEN try_strptime(s, '%d-%b-%Y') WHEN regexp_full_match(s, '\\d{1,2}-[A-Za-z]{3}-\\d{2}') THEN try_strptime(regexp_replace(s, '-(\\d\\d)$', '-20\\1'), '%d-%b-%Y') END"""


@query(f"""WITH t AS (SELECT ingest_id AS id, trim(date) AS s FROM ingest) SELECT id, CAST(CAST({_DAY} AS DATE) AS VARCHAR) AS day, count(*) AS rows FROM t GROUP BY ALL""")
def day_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "ingest").select(F.col("ingest_id").alias("id"), dates.parse_date(F.col("date")).cast("string").alias("day"))
    return x.groupBy("id", "day").agg(F.count("*").alias("rows"))


_CELLS = _CELLS.format(day=_DAY)


@query(f"""WITH {_CELLS}, n AS (SELECT *, row_number() OVER (PARTITION BY file_id, error IS NULL ORDER BY ingest_id) AS nth FROM e)
  SELECT file_id, ingest_id, error IS NULL AS ok, CASE error WHEN 'date' THEN 'no readable date' WHEN 'amount' THEN 'no readable amount, or not exactly one of a pair' END AS message, CAST(day AS VARCHAR) AS day, amount FROM n WHERE error IS NOT NULL OR nth <= 3""")
def diagnosis_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every failed row of each file with its message, and the file's first three good ones."""
    x = delimited.diagnosis_sample(_diagnosed(spark, sf_dir), "file_id", "ingest_id", 3)
    return x.select("file_id", "ingest_id", "ok", "message", F.col("date").cast("string").alias("day"), "amount")


@query(f"WITH {_CELLS} SELECT file_id, count(*) AS rows, count(*) FILTER (error IS NULL) AS good, count(*) FILTER (error = 'date') AS bad_date, count(*) FILTER (error = 'amount') AS bad_amount, CAST(0 AS BIGINT) AS bad_party FROM e GROUP BY 1")
def diagnosis_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delimited.diagnosis_by_file(_diagnosed(spark, sf_dir), "file_id")


# Written for themselves, not taken from the operator's constants.
_KIND = """WHEN regexp_matches(m, '(^|\\W)nsf($|\\W)|returned|bounced|insufficient|revers(al|e)') THEN 'nsf' WHEN regexp_matches(m, '(^|\\W)fee($|\\W)|service charge|svc chg|charge($|\\W)') THEN 'fee'
  WHEN contains(m, 'transfer') OR contains(m, 'xfer') OR regexp_matches(m, 'ach (in|out)') THEN 'transfer' WHEN regexp_matches(m, '(^|\\W)check($|\\W)|chk ?#|ck#|draw|disbursement|payee') THEN 'check'
  WHEN contains(m, 'deposit') OR contains(m, 'rent') OR regexp_matches(m, '(payment received|received from)') THEN 'deposit' WHEN regexp_matches(m, 'adjust|correction|void') THEN 'adjustment'"""


@query(f"""WITH {_BANK}, t AS (SELECT id, amount, lower(coalesce(memo, '')) AS m, lower(trim(coalesce(kind, ''))) AS k, lower(trim(coalesce(kind, '')) || ' ' || coalesce(memo, '')) AS km FROM bank)
  SELECT id, CASE {_KIND} WHEN amount > 0 THEN 'deposit' WHEN amount < 0 THEN 'check' ELSE 'other' END AS classified,
  CASE WHEN regexp_matches(m, '(^|\\W)nsf($|\\W)|returned|bounced|insufficient|reversal') THEN 'nsf' WHEN k <> '' THEN k ELSE CASE {_KIND} WHEN amount > 0 THEN 'deposit' WHEN amount < 0 THEN 'check' ELSE 'other' END END AS coerced FROM t""")
def kind_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _bank(spark, sf_dir)
    return x.select("id", text.classify_kind(F.col("memo"), F.col("amount")).alias("classified"), text.coerce_kind(F.col("kind"), F.col("memo"), F.col("amount")).alias("coerced"))


@query(f"""WITH {_BOOK} SELECT id, coalesce(nullif(lower(trim(regexp_replace(party, '[ \\t\\r\\n]+', ' ', 'g'))), ''), 'unknown') AS party_key,
  CAST(len(list_filter(regexp_split_to_array(lower(coalesce(party, '')), '[^a-z0-9]+'), lambda w: w <> '')) AS INTEGER) AS words FROM book""")
def party_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _book(spark, sf_dir)
    return x.select("id", text.party_key(F.col("party")).alias("party_key"), F.size(text.name_tokens(F.col("party"))).cast("int").alias("words"))


_SET = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^a-z0-9]+'), lambda w: w <> ''))"


@query(f"""WITH {_BANK}, {_BOOK}, p AS (SELECT a.id AS id_a, b.id AS id_b, {_SET.format("a.memo")} AS x, {_SET.format("b.memo")} AS y FROM bank a JOIN book b ON a.amount = b.amount AND a.date = b.date)
  SELECT id_a, id_b, CASE WHEN len(x) + len(y) = 0 THEN 1.0 ELSE round(len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))), 9) END::DOUBLE AS similarity FROM p""")
def memo_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _bank(spark, sf_dir).select(F.col("id").alias("id_a"), "amount", "date", F.col("memo").alias("x"))
    b = _book(spark, sf_dir).select(F.col("id").alias("id_b"), "amount", "date", F.col("memo").alias("y"))
    return a.join(b, ["amount", "date"]).select("id_a", "id_b", F.round(text.memo_similarity(F.col("x"), F.col("y")), 9).alias("similarity"))


@query("""SELECT l_orderkey, l_linenumber, CAST(round(v, 2) AS VARCHAR) AS half_up, CAST(floor(v * 100 + 0.5) AS BIGINT) AS xpath_cents, CAST(floor(-v * 100 + 0.5) AS BIGINT) AS xpath_cents_negative,
  CAST(CASE WHEN instr(s, '.') > 0 THEN len(s) - instr(s, '.') ELSE 0 END AS INTEGER) AS places
  FROM (SELECT l_orderkey, l_linenumber, CAST(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT) AS DECIMAL(28,8)) / CAST(10000 AS DECIMAL(10,0)) AS v0,
    CAST(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT) AS DECIMAL(28,4)) * CAST(0.0001 AS DECIMAL(5,4)) AS v, CAST(CAST(round(l_extendedprice * 100) AS BIGINT) // 100 AS VARCHAR) || '.' || CAST(l_linenumber AS VARCHAR) AS s FROM lineitem)""")  # fmt: skip
def decimal_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents, share = F.round(F.col("l_extendedprice") * 100).cast("bigint"), F.round(F.col("l_discount") * 100).cast("bigint")
    v = ((cents * share).cast("decimal(28,4)") * F.lit("0.0001").cast("decimal(5,4)")).cast("decimal(28,8)")
    s = F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.col("l_linenumber").cast("string"))
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", v.alias("v"), s.alias("s"))
    return x.select(
        "l_orderkey", "l_linenumber", decimals.half_up(F.col("v")).cast("decimal(28,2)").cast("string").alias("half_up"), decimals.xpath_round(F.col("v") * 100).cast("bigint").alias("xpath_cents"),
        decimals.xpath_round(-F.col("v") * 100).cast("bigint").alias("xpath_cents_negative"), decimals.decimal_places(F.col("s")).cast("int").alias("places"),
    )


@query("""SELECT DISTINCT source_path AS path, source_path = 'inbox/batch-00' OR starts_with(source_path, 'inbox/batch-00/') AS under_short, source_path = 'inbox/batch-000' OR starts_with(source_path, 'inbox/batch-000/') AS under_long,
  regexp_matches(source_path, '^(?:/|\\\\|[A-Za-z]:)|(?:^|[/\\\\])\\.\\.(?:[/\\\\]|$)') AS unsafe FROM finding_report""")  # fmt: skip
def path_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "finding_report").select(F.col("source_path").alias("path")).distinct()
    under = lambda p: text.under_prefix(F.col("path"), F.lit(p))
    return x.select("path", under("inbox/batch-00").alias("under_short"), under("inbox/batch-000/").alias("under_long"), text.unsafe_path(F.col("path")).alias("unsafe"))


@query()
def keccak_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keccak-256 of every document's bytes, bound to its path."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), hashing.keccak256(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))
    return d.select("doc_id", F.lower(F.hex("digest")).alias("content_hash"), F.lower(F.hex(hashing.path_leaf(F.col("path"), F.col("digest")))).alias("leaf"))


# --- Manifests ------------------------------------------------------------------------------------------------------

_OLD = "o AS (SELECT source || '/' || doc_id AS path, sha256(coalesce(text, '')) AS content_hash FROM documents WHERE doc_type <> 'session')"
_NEW = "n AS (SELECT source || '/' || doc_id AS path, sha256(CASE WHEN lang = 'fr' THEN upper(coalesce(text, '')) ELSE coalesce(text, '') END) AS content_hash FROM documents WHERE source <> 'desk-notes')"
_CHANGE = f"""{_OLD}, {_NEW}, c AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.content_hash = n.content_hash THEN 'unchanged' ELSE 'changed' END AS change,
  o.content_hash AS old_hash, n.content_hash AS new_hash FROM o FULL JOIN n ON o.path = n.path)"""


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of the documents: without session logs; and without one source, French texts rewritten in capitals."""
    docs = table(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    plain = F.coalesce("text", F.lit(""))
    old = manifest.build(docs.filter("doc_type != 'session'"), F.sha2(plain.cast("binary"), 256))
    new = manifest.build(docs.filter("source != 'desk-notes'"), F.sha2(F.when(F.col("lang") == "fr", F.upper(plain)).otherwise(plain).cast("binary"), 256))
    return old, new


@query(f"WITH {_OLD} SELECT path, content_hash, sha256(encode(path) || '\\x00'::BLOB || unhex(content_hash)) AS leaf FROM o")
def manifest_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir)[0]


@query(f"WITH {_CHANGE} SELECT * FROM c")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.compare(*_versions(spark, sf_dir))


@query(f"WITH {_CHANGE} SELECT CASE change WHEN 'unchanged' THEN 'ok' WHEN 'changed' THEN 'changed' WHEN 'removed' THEN 'missing' ELSE 'unexpected' END AS status, count(*) AS files FROM c GROUP BY 1")
def manifest_verify_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verify(*_versions(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("files"))


def _hinted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.lower("lang").alias("license"), F.when(F.col("ledger_code").isNotNull(), F.col("source")).alias("source"))


_HINTED = "h AS (SELECT source || '/' || doc_id AS path, lower(lang) AS license, CASE WHEN ledger_code IS NOT NULL THEN source END AS source FROM documents)"


@query(f"""WITH {_HINTED}, x AS (SELECT coalesce(license, '{manifest.NO_LICENSE}') AS license, coalesce(source, '{manifest.NO_SOURCE}') AS source FROM h)
  SELECT 'license' AS hint, license AS value, count(*) AS files FROM x GROUP BY ALL UNION ALL SELECT 'source', source, count(*) FROM x GROUP BY ALL UNION ALL SELECT 'all', '*', count(*) FROM x""")
def hint_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.histograms(_hinted(spark, sf_dir))


_POLICY = {"allow_licenses": ["en", "de"], "deny_licenses": ["fr"], "deny_sources": ["desk-notes"], "require_license": True}
_BROKEN = f"""{_HINTED}, v AS (SELECT path, 'requireLicense' AS rule, '{manifest.NO_LICENSE}' AS value FROM h WHERE license IS NULL UNION ALL
  SELECT path, 'allowLicenses', coalesce(license, '{manifest.NO_LICENSE}') FROM h WHERE license IS NULL OR license NOT IN ('en', 'de') UNION ALL
  SELECT path, 'denyLicenses', license FROM h WHERE license IN ('fr') UNION ALL SELECT path, 'denySources', source FROM h WHERE source IN ('desk-notes'))"""


@query(f"WITH {_BROKEN} SELECT * FROM v")
def policy_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.policy_violations(_hinted(spark, sf_dir), **_POLICY)


@query(f"WITH {_BROKEN} SELECT CASE WHEN (SELECT count(*) FROM v) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict, (SELECT count(*) FROM h) AS files, (SELECT count(*) FROM v) AS violations")
def policy_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    hinted = _hinted(spark, sf_dir)
    return manifest.verdict(hinted, manifest.policy_violations(hinted, **_POLICY))


@query(f"""WITH {_CHANGE} SELECT path, 'noAdded' AS rule, 'ADDED' AS change FROM c WHERE change = 'added' UNION ALL
  SELECT path, 'frozenPaths', upper(change) FROM c WHERE change IN ('changed', 'removed') AND starts_with(path, 'desk-notes/') UNION ALL
  SELECT path, 'allowChangePaths', 'CHANGED' FROM c WHERE change = 'changed' AND NOT (starts_with(path, 'journal-east/') OR starts_with(path, 'lint-review/'))""")
def drift_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = manifest.compare(*_versions(spark, sf_dir))
    return manifest.drift_violations(changes, no_added=True, allow_change=["journal-east", "lint-review"], frozen=["desk-notes/"])


@query(f"""WITH {_BROKEN}, {_CHANGE}, x AS (SELECT 'license' AS hint, coalesce(license, '{manifest.NO_LICENSE}') AS value FROM h UNION ALL SELECT 'source', coalesce(source, '{manifest.NO_SOURCE}') FROM h UNION ALL SELECT 'all', '*' FROM h),
  a AS (SELECT '{{"hint":"' || hint || '","value":' || CAST(to_json(value) AS VARCHAR) || ',"files":' || count(*) || '}}' AS t FROM x GROUP BY hint, value),
  b AS (SELECT '{{"status":"' || CASE change WHEN 'unchanged' THEN 'ok' WHEN 'changed' THEN 'changed' WHEN 'removed' THEN 'missing' ELSE 'unexpected' END || '","files":' || count(*) || '}}' AS t FROM c GROUP BY change)
  SELECT '{{"kind":"dataset-evidence","hints":[' || (SELECT string_agg(t, ',' ORDER BY t) FROM a) || '],"verified":[' || (SELECT string_agg(t, ',' ORDER BY t) FROM b) || '],"policy":[{{"verdict":"' || CASE WHEN (SELECT count(*) FROM v) = 0 THEN 'PASS' ELSE 'FAIL' END
    || '","files":' || (SELECT count(*) FROM h) || ',"violations":' || (SELECT count(*) FROM v) || '}}]}}' AS document""")
def dataset_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document of a dataset's evidence: its hints, its files against its manifest, and the policy's verdict."""
    hinted = _hinted(spark, sf_dir)
    verdict = manifest.verdict(hinted, manifest.policy_violations(hinted, **_POLICY)).select("verdict", "files", "violations")
    return reports.packet({"hints": manifest.histograms(hinted).select("hint", "value", "files"), "verified": manifest_verify_counts(spark, sf_dir).select("status", "files"), "policy": verdict}, "dataset-evidence")


@query(f"WITH {_OLD}, {_HINTED} SELECT h.path FROM h ANTI JOIN o USING (path)")
def unknown_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.unknown_hints(_versions(spark, sf_dir)[0], _hinted(spark, sf_dir)).select("path")


# --- Trees ----------------------------------------------------------------------------------------------------------


def _digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("digest"))


@query()
def merkle_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.sorted_root(_digests(spark, sf_dir))


@query()
def merkle_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root that every leaf's own proof leads to, with the number of leaves: one row if all agree."""
    p = merkle.sorted_proofs(_digests(spark, sf_dir))
    return p.groupBy(F.lower(F.hex(merkle.fold_proof("digest", "proof"))).alias("root")).agg(F.count("*").alias("leaves"))


@query()
def log_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head of each user's event log."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unhex(F.sha2(F.concat_ws("|", "event_id", "event_type", "props").cast("binary"), 256)).alias("leaf"))
    return merkle.log_heads(e, "user_id", "event_id", "leaf")


@query("SELECT user_id, count(*) // 2 AS first, count(*) AS second, true AS holds FROM events GROUP BY 1")
def log_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each user's log of half its size is a prefix of the whole, by consistency proof."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unhex(F.sha2(F.concat_ws("|", "event_id", "event_type", "props").cast("binary"), 256)).alias("leaf"))
    return merkle.log_prefixes(e, "user_id", "event_id", "leaf", lambda n: n // 2)


_LEVELS = """t AS (SELECT {g}0 AS level, pos, {leaf} AS node, n FROM leaves UNION ALL
    SELECT {g}level + 1, pos // 2, {pair}, (n + 1) // 2 FROM t WHERE n > 1 GROUP BY {g}level, pos // 2, n)"""
_SORTED = "leaves AS (SELECT unhex(h) AS d, row_number() OVER (ORDER BY h) - 1 AS pos, count(*) OVER () AS n FROM (SELECT sha256(coalesce(text, '')) AS h FROM documents)), " + _LEVELS.format(
    g="", leaf="unhex(sha256('\\x00'::BLOB || d))", pair="unhex(sha256('\\x01'::BLOB || least(min_by(node, pos), max_by(node, pos)) || greatest(min_by(node, pos), max_by(node, pos))))"
)
_LOGS = "leaves AS (SELECT user_id, unhex(sha256(event_id || '|' || event_type || '|' || props)) AS d, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events), " + _LEVELS.format(
    g="user_id, ", leaf="unhex(sha256('\\x00'::BLOB || d))", pair="CASE WHEN count(*) = 2 THEN unhex(sha256('\\x01'::BLOB || min_by(node, pos) || max_by(node, pos))) ELSE min_by(node, pos) END"
)


@query(f"WITH RECURSIVE {_SORTED} SELECT lower(hex(node)) AS root FROM t WHERE n = 1")
def merkle_root_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.sorted_root(_digests(spark, sf_dir), "sha256")


@query(f"WITH RECURSIVE {_SORTED} SELECT lower(hex(node)) AS root, (SELECT count(*) FROM leaves) AS leaves FROM t WHERE n = 1")
def merkle_proofs_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root that every leaf's own proof leads to, with the number of leaves: one row if all agree."""
    p = merkle.sorted_proofs(_digests(spark, sf_dir), "sha256")
    return p.groupBy(F.lower(F.hex(merkle.proof_folder("sha256")("digest", "proof"))).alias("root")).agg(F.count("*").alias("leaves"))


@query(f"WITH RECURSIVE {_LOGS} SELECT user_id, (SELECT count(*) FROM leaves l WHERE l.user_id = t.user_id) AS size, lower(hex(node)) AS root FROM t WHERE n = 1")
def log_heads_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unhex(F.sha2(F.concat_ws("|", "event_id", "event_type", "props").cast("binary"), 256)).alias("leaf"))
    return merkle.log_heads(e, "user_id", "event_id", "leaf", "sha256")


# --- Registry -------------------------------------------------------------------------------------------------------

_RECORDS = """r AS (SELECT '0x' || sha256(coalesce(text, '')) AS content_hash, '0x' || left(sha256(source), 40) AS contributor, doc_type <> 'session' AS author_bound, CAST(epoch(created_at) AS BIGINT) AS timestamp,
  CAST(epoch(created_at) AS BIGINT) // 3600 AS block_number, CASE WHEN ledger_code IS NULL THEN NULL ELSE '0x' || sha256(ledger_code) END AS parent, doc_id AS index FROM documents)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.unix_seconds(F.col("created_at").cast("timestamp"))
    hexed = lambda c: F.concat(F.lit("0x"), F.sha2(c.cast("binary"), 256))
    return table(spark, sf_dir, "documents").select(
        hexed(F.coalesce("text", F.lit(""))).alias("content_hash"), F.substring(hexed(F.col("source")), 1, 42).alias("contributor"), (F.col("doc_type") != "session").alias("author_bound"),
        seconds.alias("timestamp"), F.floor(seconds / 3600).cast("bigint").alias("block_number"), hexed(F.col("ledger_code")).alias("parent"), F.col("doc_id").alias("index"),
    )


@query(f"WITH {_RECORDS} SELECT content_hash, index, contributor FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY block_number, index) AS n FROM r) WHERE n = 1")
def registry_first_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.first_writers(_records(spark, sf_dir), "content_hash", "block_number", "index").select("content_hash", "index", "contributor")


@query(f"WITH {_RECORDS} SELECT index, contributor, block_number FROM r WHERE contributor = '0x' || left(sha256('desk-notes'), 40) AND author_bound ORDER BY index LIMIT 50 OFFSET 10")
def registry_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib

    who = "0X" + hashlib.sha256(b"desk-notes").hexdigest()[:40].upper()
    return registry.page(_records(spark, sf_dir), who, True, 10, 50).select("index", "contributor", "block_number")


@query(f"WITH {_RECORDS} SELECT contributor, index, n - 1 AS nth FROM (SELECT *, row_number() OVER (PARTITION BY contributor ORDER BY index) AS n FROM r) WHERE n BETWEEN 4 AND 8")
def registry_contributor_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.contributor_page(_records(spark, sf_dir), 3, 5).select("contributor", "index", F.col("nth").cast("bigint").alias("nth"))


@query(f"""WITH {_RECORDS} SELECT contributor, count(*) AS total, count(*) FILTER (author_bound) AS author_bound, count(*) FILTER (NOT author_bound) AS anchor_only, count(*) FILTER (parent IS NULL) AS lineage_roots,
  count(*) FILTER (parent IS NOT NULL) AS revisions, min(block_number) AS first_block, arg_min(timestamp, (block_number, index)) AS first_timestamp, max(block_number) AS last_block, arg_max(timestamp, (block_number, -index)) AS last_timestamp FROM r GROUP BY 1""")  # fmt: skip
def registry_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.scores(_records(spark, sf_dir))


_POINTS = f"WITH {_RECORDS}, p AS (SELECT contributor, count(*) AS points FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY index) AS n FROM r WHERE author_bound) WHERE n = 1 GROUP BY 1)"


@query(f"{_POINTS} SELECT * FROM p")
def registry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.points(_records(spark, sf_dir))


@query(f"{_POINTS} SELECT * FROM p WHERE points >= 40")
def points_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.at_least(_records(spark, sf_dir), 40)


_HEX = "'0x' || lpad(to_hex(o_orderkey + 1), 64, '0')"


@query(f"""WITH RECURSIVE e AS (SELECT lower({_HEX}) AS content_hash, lag(lower({_HEX})) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS last FROM orders),
  walk AS (SELECT content_hash AS start, 0 AS depth, content_hash, parent FROM e WHERE last = 1 UNION ALL SELECT w.start, w.depth + 1, e.content_hash, e.parent FROM walk w JOIN e ON e.content_hash = w.parent WHERE w.depth < 15)
  SELECT start, CAST(depth AS INTEGER) AS depth, content_hash, depth = 15 AND parent IS NOT NULL AS capped FROM walk""")  # fmt: skip
def lineage_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders from the last back with a ceiling of 16, beyond which walks are marked as capped; lineage_full has all."""
    return registry.lineage(*_lineage(spark, sf_dir), 16).select("start", "depth", "content_hash", "capped")


def _lineage(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    hashed = F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(F.col("o_orderkey") + 1), 64, "0")))
    e = table(spark, sf_dir, "orders").withColumn("content_hash", hashed).withColumn("parent", F.lag("content_hash").over(w)).withColumn("next", F.lead("o_orderkey").over(w))
    starts = e.filter("next is null").select(F.col("content_hash").alias("start"))
    return e.select("content_hash", "parent", F.col("o_orderkey").alias("index")), starts


@query(f"""WITH RECURSIVE e AS (SELECT lower({_HEX}) AS content_hash, lag(lower({_HEX})) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS last FROM orders),
  walk AS (SELECT content_hash AS start, 0 AS depth, content_hash, parent FROM e WHERE last = 1 UNION ALL SELECT w.start, w.depth + 1, e.content_hash, e.parent FROM walk w JOIN e ON e.content_hash = w.parent WHERE w.depth < 255)
  SELECT start, CAST(depth AS INTEGER) AS depth, content_hash, depth = 255 AND parent IS NOT NULL AS capped FROM walk""")
def lineage_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders from the last back, to the operator's own ceiling of 256."""
    return registry.lineage(*_lineage(spark, sf_dir)).select("start", "depth", "content_hash", "capped")


# --- Logs -----------------------------------------------------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query("""WITH n AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) - 1 AS pos FROM n WHERE event_type <> 'error')
  SELECT user_id, CAST(min(pos) AS INTEGER) AS index, min(seq) AS seq FROM k WHERE seq <> pos GROUP BY 1""")
def sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first missing number in each user's log once errors are taken out."""
    from pyspark.sql import Window

    n = _events(spark, sf_dir).withColumn("seq", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("bigint"))
    return logs.first_gaps(n.filter("event_type != 'error'"), "user_id", "seq")


_SESSION = """s AS (SELECT CASE WHEN value < 1 THEN -1 ELSE event_id END AS seq, CAST(event_id AS VARCHAR) AS ts, CASE WHEN value > 95 THEN '' ELSE 'user' || user_id END AS actor,
  CASE event_type WHEN 'click' THEN 'prompt' WHEN 'view' THEN 'completion' WHEN 'purchase' THEN 'tool_call' WHEN 'error' THEN 'tool_result' ELSE 'unknown' END AS type,
  CASE WHEN event_type = 'view' THEN NULL ELSE props END AS payload, CASE WHEN event_type = 'view' THEN sha256(props) WHEN value > 60 THEN sha256(CAST(event_id AS VARCHAR)) END AS payload_hash, event_type = 'view' AND value > 20 AS redacted, event_id FROM events)"""


def _session(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    view = F.col("event_type") == "view"
    kind = F.when(F.col("event_type") == "click", "prompt").when(view, "completion").when(F.col("event_type") == "purchase", "tool_call").when(F.col("event_type") == "error", "tool_result").otherwise("unknown")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return e.select(
        F.when(F.col("value") < 1, -1).otherwise(F.col("event_id")).cast("bigint").alias("seq"), F.col("event_id").cast("string").alias("ts"),
        F.when(F.col("value") > 95, "").otherwise(F.concat(F.lit("user"), F.col("user_id"))).alias("actor"), kind.alias("type"), F.when(~view, F.col("props")).alias("payload"),
        F.when(view, sha(F.col("props"))).when(F.col("value") > 60, sha(F.col("event_id").cast("string"))).alias("payload_hash"), (view & (F.col("value") > 20)).alias("redacted"), "event_id",
    )


@query(f"""WITH {_SESSION} SELECT event_id, CASE WHEN seq < 0 THEN 'EVENT_BAD_SEQ' WHEN actor = '' THEN 'EVENT_BAD_ACTOR' WHEN type = 'unknown' THEN 'EVENT_BAD_TYPE' WHEN payload IS NULL AND payload_hash IS NULL THEN 'EVENT_MISSING_PAYLOAD'
  WHEN redacted AND payload IS NOT NULL THEN 'EVENT_REDACTED_WITH_PAYLOAD' WHEN NOT redacted AND payload IS NULL THEN 'EVENT_UNFLAGGED_REDACTION' WHEN payload IS NOT NULL AND payload_hash IS NOT NULL AND sha256(payload) <> payload_hash THEN 'EVENT_PAYLOAD_HASH_MISMATCH' END AS reason FROM s""")  # fmt: skip
def event_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.validated(_session(spark, sf_dir)).select("event_id", "reason")


@query(f"WITH {_SESSION} SELECT event_id, CAST(NULL AS VARCHAR) AS payload, coalesce(payload_hash, sha256(payload)) AS payload_hash, true AS redacted FROM s")
def event_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.redacted(_session(spark, sf_dir)).select("event_id", "payload", "payload_hash", "redacted")


_COVERAGE = """c AS (SELECT CAST(o_orderkey AS VARCHAR) AS oid, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position FROM orders),
  l AS (SELECT CAST(l_orderkey AS VARCHAR) AS oid, CASE WHEN l_returnflag = 'R' THEN 3 WHEN l_linestatus = 'O' AND l_tax < 0.02 THEN 0 WHEN l_linestatus = 'F' AND l_tax > 0.06 THEN 1 ELSE 2 END AS rank FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01'),
  b AS (SELECT oid, min(rank) AS rank, count(*) AS claims FROM l GROUP BY 1),
  v AS (SELECT oid, position, CASE coalesce(rank, 4) WHEN 0 THEN 'covered-verified' WHEN 1 THEN 'covered-oid-only' WHEN 2 THEN 'claim-root-mismatch' WHEN 3 THEN 'claim-unverified-packet' ELSE 'uncovered' END AS status, coalesce(claims, 0) AS claims FROM c LEFT JOIN b USING (oid))"""


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    numbered = merkle.numbered(o.select("o_orderdate", "o_orderkey"), "o_orderdate", "o_orderkey")
    commits = numbered.select(F.col("o_orderkey").cast("string").alias("oid"), F.col("pos").alias("position"))
    root = F.when((F.col("l_linestatus") == "O") & (F.col("l_tax") < 0.02), True).when((F.col("l_linestatus") == "F") & (F.col("l_tax") > 0.06), None).otherwise(False)
    claims = table(spark, sf_dir, "lineitem").filter("l_shipdate < timestamp_ntz'1999-01-01'").select(F.col("l_orderkey").cast("string").alias("oid"), (F.col("l_returnflag") != "R").alias("packet_verified"), root.alias("root_verified"))
    return logs.coverage(commits, claims)


@query(f"WITH {_COVERAGE} SELECT * FROM v")
def coverage_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _covered(spark, sf_dir)


@query(f"WITH {_COVERAGE} SELECT oid, 'require-since' AS rule, status FROM v WHERE position >= (SELECT position FROM v WHERE oid = '100') AND status NOT IN ('covered-verified', 'covered-oid-only')")
def coverage_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.coverage_failures(_covered(spark, sf_dir), since="100")


@query(f"""WITH {_COVERAGE}, t AS (SELECT count(*) AS commits, count(*) FILTER (status = 'covered-verified') AS covered_verified, count(*) FILTER (status = 'covered-oid-only') AS covered_oid_only, count(*) FILTER (status = 'claim-root-mismatch') AS claim_root_mismatch,
  count(*) FILTER (status = 'claim-unverified-packet') AS claim_unverified_packet, count(*) FILTER (status = 'uncovered') AS uncovered FROM v) SELECT *, CASE WHEN commits = 0 THEN 100 ELSE (covered_verified + covered_oid_only) * 100 // commits END AS percent FROM t""")  # fmt: skip
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.coverage_summary(_covered(spark, sf_dir))


_REVOKED = """v AS (SELECT '0x' || left(sha256('u' || user_id), 40) AS vendor, date_trunc('second', ts) AS revoked_at, event_type || value AS reason FROM events WHERE event_type = 'error' AND value > 40),
  s AS (SELECT event_id, CASE WHEN value > 90 THEN '(unrecoverable)' ELSE '0x' || left(sha256('u' || user_id), 40) END AS subject, ts AS as_of FROM events WHERE event_type = 'purchase')"""


@query(f"""WITH {_REVOKED}, g AS (SELECT s.event_id, strftime(min(v.revoked_at) FILTER (v.revoked_at <= s.as_of), '%Y-%m-%d %H:%M:%S') AS governing_at, count(DISTINCT (v.revoked_at, v.reason)) FILTER (v.revoked_at > s.as_of) AS later FROM s LEFT JOIN v ON v.vendor = s.subject GROUP BY 1)
  SELECT s.event_id, CASE WHEN governing_at IS NOT NULL THEN 'REVOKED' WHEN subject = '(unrecoverable)' THEN 'UNEVALUABLE' ELSE 'OK' END AS status, governing_at, CAST(later AS INTEGER) AS later FROM s JOIN g USING (event_id)""")  # fmt: skip
def asof_revocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    key = F.concat(F.lit("0x"), F.substring(F.sha2(F.concat(F.lit("u"), F.col("user_id")).cast("binary"), 256), 1, 40))
    revocations = e.filter("event_type = 'error' and value > 40").select(key.alias("vendor"), F.date_trunc("second", "ts").cast("timestamp").alias("revoked_at"), F.concat("event_type", "value").alias("reason"))
    subjects = e.filter("event_type = 'purchase'").select("event_id", F.when(F.col("value") > 90, "(unrecoverable)").otherwise(key).alias("subject"), F.col("ts").cast("timestamp").alias("as_of"))
    return logs.revoked_as_of(subjects, revocations).select("event_id", "status", F.date_format("governing_at", "yyyy-MM-dd HH:mm:ss").alias("governing_at"), F.col("later").cast("int").alias("later"))


@query("""SELECT p.event_id, c.event_id AS right_event_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts""")
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's last click before it."""
    e = _events(spark, sf_dir).select("user_id", "ts", "event_id", "event_type")
    return logs.as_of(e.filter("event_type = 'purchase'"), e.filter("event_type = 'click'"), "user_id", "ts", "ts").select("event_id", "right_event_id")


@query("""WITH j AS (SELECT coalesce(account, 'none') AS journal, kind, row_number() OVER (PARTITION BY coalesce(account, 'none') ORDER BY CAST(loaded_at AS TIMESTAMP), '{' || concat_ws(',', '"entry_id":' || entry_id, '"amount":' || amount, '"kind":"' || kind || '"') || '}') - 1 AS seq FROM bank_entry)
  SELECT journal, CAST(max(seq) AS INTEGER) AS broken_at, 'entry_hash' AS reason FROM j WHERE kind = 'nsf' GROUP BY 1""")
def journal_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chained journals of every account's entries with one entry's body edited in each account with a returned item: the first break of each."""
    entries = _chained(spark, sf_dir)
    bad = entries.filter(F.col("body").contains('"nsf"')).groupBy("journal").agg(F.max("seq").alias("seq")).withColumn("_edit", F.lit(True))
    forged = entries.join(bad, ["journal", "seq"], "left").withColumn("body", F.when(F.col("_edit"), F.lit('{"amount":0}')).otherwise(F.col("body"))).drop("_edit")
    return logs.chain_breaks(forged)


def _chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A journal per account by a stream over the bank's entries; an account's entries of one run are one chain."""
    folder = f"{shared_folder(spark)}/journal-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, sf_dir, "bank_entry").schema).parquet(_stream_path(sf_dir, "bank_entry"))
    body = F.to_json(F.struct("entry_id", "amount", "kind"))
    return journal.run_to_folder(journal.chain(stream.select(F.coalesce("account", F.lit("none")).alias("account"), F.col("loaded_at").cast("string").alias("at"), body.alias("body")), "account", "at", "body"), folder)


def _stream_path(sf_dir: str, name: str) -> str:
    """A folder or a pattern that fits the one file: streams read folders."""
    from pathlib import Path

    return f"{sf_dir}/{name}.parquet" if Path(f"{sf_dir}/{name}.parquet").is_dir() else f"{sf_dir}/{name}.parquet*"


@query("SELECT entry_id, min(amount) AS amount FROM bank_entry GROUP BY 1")
def stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries of bank entries without repeats, as a stream; the watermark spans all of a run's input."""
    folder = f"{shared_folder(spark)}/dedup-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, sf_dir, "bank_entry").schema).parquet(_stream_path(sf_dir, "bank_entry")).withColumn("at", F.col("loaded_at").cast("timestamp"))
    once = journal.deduplicated(stream.select("entry_id", "amount", "at"), ["entry_id"], "at", "3650 days")
    return journal.run_to_folder(once.select("entry_id", "amount"), folder)


# --- Findings -------------------------------------------------------------------------------------------------------

_BY_SOURCE = f"""{_FINDINGS}, s AS (SELECT 'doc' || o_orderkey AS source, CASE WHEN o_orderstatus = 'P' THEN 'unreadable' END AS error FROM orders),
  c AS (SELECT source, count(*) FILTER (severity = 'fatal') AS fatal, count(*) FILTER (severity = 'warning') AS warning, count(*) AS violations FROM f GROUP BY 1),
  b AS (SELECT s.source, error, coalesce(fatal, 0) AS fatal, coalesce(warning, 0) AS warning, coalesce(violations, 0) AS violations, error IS NULL AND coalesce(fatal, 0) = 0 AS valid FROM s LEFT JOIN c USING (source))"""


def _by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "orders").select(F.concat(F.lit("doc"), F.col("o_orderkey")).alias("source"), F.when(F.col("o_orderstatus") == "P", "unreadable").alias("error"))
    return found.by_source(_findings(spark, sf_dir), sources)


@query(f"WITH {_BY_SOURCE} SELECT * FROM b")
def findings_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_source(spark, sf_dir)


@query(f"""WITH {_BY_SOURCE} SELECT count(*) AS file_count, count(*) FILTER (NOT valid) AS failed_file_count, CAST(sum(fatal) AS BIGINT) AS fatal_count, CAST(sum(warning) AS BIGINT) AS warning_count, CAST(sum(violations) AS BIGINT) AS violations_count,
  CASE WHEN sum(fatal) > 0 THEN 'fatal' WHEN bool_or(error IS NOT NULL) THEN 'unreadable' ELSE 'ok' END AS verdict FROM b""")  # fmt: skip
def batch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found.batch(_by_source(spark, sf_dir))


_RANK = "CASE severity WHEN 'fatal' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END"
_FREQUENCY = f"{_FINDINGS}, q AS (SELECT rule, count(DISTINCT source) AS files, count(*) AS hits, CASE min({_RANK}) WHEN 0 THEN 'fatal' WHEN 1 THEN 'warning' ELSE 'information' END AS severity FROM f GROUP BY 1)"


@query(f"WITH {_FREQUENCY} SELECT * FROM q")
def rule_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found.rule_frequency(_findings(spark, sf_dir))


@query(f"WITH {_FREQUENCY} SELECT * FROM q ORDER BY files DESC, {_RANK}, CAST(substr(rule, 4) AS INTEGER) LIMIT 10")
def top_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found.top_rules(_findings(spark, sf_dir), 10)


@query(f"""WITH {_FINDINGS}, n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_RANK}, CAST(substr(rule, 4) AS INTEGER), location, message) AS nth, greatest(count(*) OVER (PARTITION BY source) - 2, 0) AS more FROM f)
  SELECT source, CAST(nth AS INTEGER) AS nth, rule, severity, location, more FROM n WHERE nth <= 2""")
def first_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found.first_findings(_findings(spark, sf_dir), 2).select("source", "nth", "rule", "severity", "location", "more")


_BASE = f"{_FINDINGS}, now AS (SELECT source, rule, severity FROM f WHERE message = 'O' OR severity = 'warning'), was AS (SELECT source, rule, severity FROM f WHERE message = 'F' OR severity = 'fatal')"
_MULTI = f"""{_BASE}, a AS (SELECT source, rule, severity, count(*) AS n FROM now GROUP BY ALL), b AS (SELECT source, rule, severity, count(*) AS n FROM was GROUP BY ALL),
  d AS (SELECT coalesce(a.source, b.source) AS source, coalesce(a.rule, b.rule) AS rule, coalesce(a.severity, b.severity) AS severity, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) AS added, greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0) AS removed,
    least(coalesce(a.n, 0), coalesce(b.n, 0)) AS kept FROM a FULL JOIN b ON a.source = b.source AND a.rule = b.rule AND a.severity = b.severity)"""


def _versions_of_findings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = _findings(spark, sf_dir)
    return f.filter("message = 'O' or severity = 'warning'"), f.filter("message = 'F' or severity = 'fatal'")


@query(f"WITH {_MULTI} SELECT * FROM d")
def baseline_multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found.multiset_difference(*_versions_of_findings(spark, sf_dir), ["source", "rule", "severity"])


@query(f"WITH {_MULTI} SELECT CAST(sum(added) AS BIGINT) AS added, CAST(sum(removed) AS BIGINT) AS removed, CAST(sum(kept) AS BIGINT) AS kept, CAST(sum(added) FILTER (severity = 'fatal') AS BIGINT) AS new_fatal, sum(added) FILTER (severity = 'fatal') > 0 AS regressed FROM d")
def baseline_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found.regression(*_versions_of_findings(spark, sf_dir), ["source", "rule", "severity"])


@query(f"WITH {_BASE} SELECT * FROM (SELECT source, rule, severity FROM now EXCEPT ALL SELECT source, rule, severity FROM was)")
def findings_except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _versions_of_findings(spark, sf_dir)
    return a.select("source", "rule", "severity").exceptAll(b.select("source", "rule", "severity"))


@query(f"WITH {_BASE}, x AS (SELECT DISTINCT source, rule, true AS a FROM now), y AS (SELECT DISTINCT source, rule, true AS b FROM was) SELECT rule, count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND b IS NULL) AS ours_only, count(*) FILTER (a IS NULL AND b) AS theirs_only FROM x FULL JOIN y USING (source, rule) GROUP BY 1")
def checker_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found.agreement(*_versions_of_findings(spark, sf_dir))


@query("SELECT p_partkey, p_type FROM part WHERE p_type NOT IN (SELECT p_type FROM part WHERE p_size > 45 AND p_type IS NOT NULL GROUP BY 1 HAVING count(*) > 45)")
def codelist_absence(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    codes = part.filter("p_size > 45").groupBy(F.col("p_type").alias("code")).count().filter("count > 45")
    return found.outside_list(part, "p_type", codes).select("p_partkey", "p_type")


@query(f"WITH {_FINDINGS} SELECT source, rule, location, CASE rule WHEN 'BR-7' THEN 'fatal' WHEN 'BR-9' THEN 'information' ELSE severity END AS severity, CASE rule WHEN 'BR-7' THEN 'sec. 7' END AS citation FROM f")
def severity_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = spark.createDataFrame([("BR-7", "fatal", "sec. 7"), ("BR-9", "information", None)], "rule string, severity string, citation string")
    return found.regraded(_findings(spark, sf_dir), policy).select("source", "rule", "location", "severity", "citation")


@query(f"""WITH {_FINDINGS} SELECT source, '::' || CASE severity WHEN 'fatal' THEN 'error' WHEN 'warning' THEN 'warning' ELSE 'notice' END || ' file=' || source || ',line=' || line || ',title=' || rule || '::' || message AS line_text FROM f""")
def report_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.annotations(_findings(spark, sf_dir))


_ORDERED = f"{_FINDINGS}, n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_RANK}, CAST(substr(rule, 4) AS INTEGER), location, message) AS nth FROM f)"


@query(f"""WITH {_ORDERED}, i AS (SELECT source, string_agg('{{"ruleId":"' || rule || '","level":"' || CASE severity WHEN 'fatal' THEN 'error' WHEN 'warning' THEN 'warning' ELSE 'note' END || '","message":{{"text":"' || message
    || '"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || source || '"}},"region":{{"startLine":' || line || '}}}},"logicalLocations":[{{"name":"' || location || '","kind":"member"}}]}}],"partialFingerprints":{{"finding/v1":"'
    || left(sha256(rule || chr(10) || location), 16) || '"}}}}', ',' ORDER BY nth) AS results FROM n GROUP BY 1),
  u AS (SELECT source, string_agg('{{"id":"' || rule || '"}}', ',' ORDER BY nth) AS rules FROM (SELECT source, rule, min(nth) AS nth FROM n GROUP BY 1, 2) GROUP BY 1)
  SELECT source, '{{"version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"ledger-check","rules":[' || rules || ']}}}},"results":[' || results || ']}}]}}' AS document FROM i JOIN u USING (source)""")
def report_sarif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sarif(_findings(spark, sf_dir), "ledger-check")


@query(f"""WITH {_ORDERED}, i AS (SELECT source, count(*) AS c, string_agg('<testcase name="' || rule || '"><failure message="' || message || '" type="' || severity || '"/></testcase>', '' ORDER BY nth) AS cases FROM n GROUP BY 1)
  SELECT source, '<testsuite name="' || source || '" tests="' || greatest(coalesce(c, 0), 1) || '" failures="' || coalesce(c, 0) || '">' || coalesce(cases, '<testcase name="all rules"/>') || '</testsuite>' AS document
  FROM (SELECT 'doc' || o_orderkey AS source FROM orders) LEFT JOIN i USING (source)""")
def report_junit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.junit(_findings(spark, sf_dir), table(spark, sf_dir, "orders").select(F.concat(F.lit("doc"), F.col("o_orderkey")).alias("source")))


@query(f"WITH {_FINDINGS} SELECT 'conformance' AS label, CASE min({_RANK}) WHEN 0 THEN 'failing' WHEN 1 THEN 'warnings' WHEN 2 THEN 'notes' ELSE 'passing' END AS message, CASE min({_RANK}) WHEN 0 THEN 'red' WHEN 1 THEN 'yellow' WHEN 2 THEN 'blue' ELSE 'brightgreen' END AS color FROM f")
def report_badge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.badge(_findings(spark, sf_dir))


# --- Markup ---------------------------------------------------------------------------------------------------------


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An XML invoice for every order with lines: header, lines and stated totals."""
    esc = lambda tag, c: F.concat(F.lit(f"<cbc:{tag}>"), c.cast("string"), F.lit(f"</cbc:{tag}>"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    shown = lambda c: F.concat(F.floor(c / 100).cast("string"), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0"))
    line = F.concat(F.lit("<cac:InvoiceLine>"), esc("ID", F.col("l_linenumber")), esc("InvoicedQuantity", F.col("l_quantity").cast("int")), esc("LineExtensionAmount", shown(cents)), F.lit("</cac:InvoiceLine>"))
    # Spread by the join's key beforehand: parsing takes far more time than the documents' bytes tell.
    lines = spread(table(spark, sf_dir, "lineitem"), "l_orderkey").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("x")))), lambda s: s["x"]), "").alias("lines"), F.sum(cents).alias("net"))
    o = spread(table(spark, sf_dir, "orders"), "o_orderkey").join(lines.hint("shuffle_hash"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    head = F.concat(F.lit('<?xml version="1.0"?><Invoice xmlns="urn:i" xmlns:cac="urn:a" xmlns:cbc="urn:b">'), esc("ID", F.col("o_orderkey")), esc("IssueDate", F.date_format("o_orderdate", "yyyy-MM-dd")))
    total = F.concat(F.lit("<cac:LegalMonetaryTotal>"), esc("LineExtensionAmount", shown(F.coalesce("net", F.lit(0)))), F.lit("</cac:LegalMonetaryTotal>"))
    return o.select("o_orderkey", F.concat(head, total, F.coalesce("lines", F.lit("")), F.lit("</Invoice>")).alias("content"))


_SHOWN = "CAST(c // 100 AS VARCHAR) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0')"


@query(f"""WITH l AS (SELECT l_orderkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS c, count(*) AS n FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS issue_date, coalesce(c, 0) AS c, coalesce(n, 0) AS n FROM orders LEFT JOIN l ON l_orderkey = o_orderkey)
  SELECT o_orderkey, 'ubl' AS syntax, issue_date, {_SHOWN} AS net_total, CAST(n AS INTEGER) AS lines, c AS line_cents FROM o""")
def invoice_from_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = markup.invoices(_documents(spark, sf_dir), "o_orderkey", "content")
    cents = F.aggregate("lines", F.lit(0).cast("bigint"), lambda a, e: a + money.parse_cents(e["net"]))
    return x.select("o_orderkey", "syntax", "issue_date", "net_total", F.size("lines").cast("int").alias("lines"), cents.alias("line_cents"))


@query("SELECT path, CAST(count(*) AS BIGINT) AS elements FROM (SELECT unnest(['/Invoice', '/Invoice/ID', '/Invoice/IssueDate', '/Invoice/LegalMonetaryTotal', '/Invoice/LegalMonetaryTotal/LineExtensionAmount']) AS path FROM orders UNION ALL SELECT unnest(['/Invoice/InvoiceLine', '/Invoice/InvoiceLine/ID', '/Invoice/InvoiceLine/InvoicedQuantity', '/Invoice/InvoiceLine/LineExtensionAmount']) FROM lineitem SEMI JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1")
def element_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.element_table(_documents(spark, sf_dir), "o_orderkey", "content").groupBy("path").agg(F.count("*").alias("elements"))


@query("""WITH o AS (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) SELECT o_orderkey, 'lines' AS rule FROM o WHERE n = 0 UNION ALL SELECT o_orderkey, 'few' FROM o WHERE n > 5
  UNION ALL SELECT o_orderkey, 'quantity' FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE NOT CAST(l_quantity AS INTEGER) < 45""")
def path_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("lines", "fatal", "/Invoice", "exists(cac:InvoiceLine)"), ("few", "warning", "/Invoice", "count(cac:InvoiceLine) <= 5"), ("quantity", "warning", "cac:InvoiceLine", "not(cbc:InvoicedQuantity >= 45)"), ("id", "fatal", "cac:InvoiceLine | /Invoice", "cbc:ID and not(cbc:ID = '')")]
    return markup.evaluate(_documents(spark, sf_dir), "o_orderkey", "content", rules).select("o_orderkey", "rule")


@query("""SELECT o_orderkey, severity, count(*) AS findings FROM (SELECT o_orderkey, 'fatal' AS severity FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey
  UNION ALL SELECT o_orderkey, 'warning' FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber > 1) GROUP BY 1, 2""")
def path_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed tests by document and severity: of decimal places, of ancestors and of existence."""
    rules = [("lines", "fatal", "/Invoice", "exists(cac:InvoiceLine)"), ("places", "fatal", "cbc:LineExtensionAmount", "string-length(substring-after(., '.')) <= 2"), ("inside", "warning", "cac:InvoiceLine/cbc:ID", "exists(ancestor::ubl:Invoice/cbc:ID) and . <= 1")]
    return markup.severity_counts(markup.evaluate(_documents(spark, sf_dir), "o_orderkey", "content", rules), "o_orderkey")


@query("""SELECT o_orderkey, 'cac:LegalMonetaryTotal/cbc:PayableAmount' AS path, 1 AS line FROM orders UNION ALL SELECT o_orderkey, '/Invoice/cac:InvoiceLine/cbc:Note', 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(*) = 1""")
def insertion_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where absent members would have to be put: a note only where the document has one line."""
    return markup.insertion_points(_documents(spark, sf_dir), "o_orderkey", "content", ["cac:LegalMonetaryTotal/cbc:PayableAmount", "/Invoice/cac:InvoiceLine/cbc:Note", "cbc:BuyerReference", "/Invoice/cbc:ID"])


@query("""SELECT e.l_orderkey AS o_orderkey, count(DISTINCT l_returnflag) AS categories, bool_or(l_returnflag = 'R') AS has_r FROM lineitem e SEMI JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def category_flattening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of each order's nested lines, flattened and tested within the row."""
    line = F.struct(F.col("l_returnflag").alias("category"), F.lit("VAT").alias("scheme"))
    nested = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"))
    x = nested.join(table(spark, sf_dir, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return x.select("o_orderkey", F.size(markup.distinct_values("lines", "category")).cast("bigint").alias("categories"), markup.has_value("lines", "category", "R").alias("has_r"))


@query(f"""WITH {_BANK}, {_BOOK} SELECT pos, side, id FROM (SELECT row_number() OVER (ORDER BY id) - 1 AS pos, 'a' AS side, id FROM bank UNION ALL SELECT row_number() OVER (ORDER BY id) - 1, 'b', id FROM book)""")
def interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides' entries numbered for taking turns; order by position and side gives the sequence."""
    number = lambda df, side: merkle.numbered(df.select("id"), "id").select("pos", F.lit(side).alias("side"), "id")
    return number(_bank(spark, sf_dir), "a").unionByName(number(_book(spark, sf_dir), "b"))


@query("""WITH t AS (SELECT ingest_id AS id, upper(regexp_replace(left(sha256(party), 18), '[^0-9a-z]', '', 'g')) AS s FROM ingest WHERE party IS NOT NULL),
  d AS (SELECT DISTINCT id, s, substr(s, 5) || left(s, 4) AS r FROM t) SELECT id, s AS text, CAST(CAST(list_aggregate(list_transform(string_split(r, ''), lambda c: CASE WHEN c >= '0' AND c <= '9' THEN c ELSE CAST(ord(c) - 55 AS VARCHAR) END), 'string_agg', '') AS HUGEINT) % 97 = 1 AS BOOLEAN) AS holds FROM d""")
def check_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modulus-97 check of account-like texts."""
    s = F.upper(F.substring(F.sha2(F.col("party").cast("binary"), 256), 1, 18))
    return table(spark, sf_dir, "ingest").filter("party is not null").select(F.col("ingest_id").alias("id"), s.alias("text")).distinct().withColumn("holds", text.mod97_holds(F.col("text")))


_TOTALS = """s AS (SELECT CAST(coalesce(sum(amount) FILTER (source = 'bank'), 0) AS BIGINT) AS bank, CAST(coalesce(sum(amount) FILTER (source = 'quickbooks'), 0) AS BIGINT) AS book, CAST(coalesce(sum(amount) FILTER (source = 'rent_roll'), 0) AS BIGINT) AS rentroll FROM tx)"""


@query(f"""{_PARTIES}, {_TOTALS}, k AS (SELECT kind, count(*) AS c, CAST(coalesce(sum(abs(amount)), 0) AS BIGINT) AS impact, grouping(kind) AS level FROM tx GROUP BY ROLLUP (kind)),
  t AS (SELECT '{{"bank":' || bank || ',"book":' || book || ',"rentroll":' || rentroll || ',"gap":' || greatest(bank, book, rentroll) - least(bank, book, rentroll) || ',"ties_out":' || (greatest(bank, book, rentroll) = least(bank, book, rentroll)) || '}}' AS x FROM s),
  y AS (SELECT '{{' || coalesce('"kind":"' || kind || '",', '') || '"count":' || c || ',"impact":' || impact || ',"level":' || level || '}}' AS x FROM k), z AS (SELECT '{{"party":' || CAST(to_json(party) AS VARCHAR) || ',"balance":' || balance || '}}' AS x FROM p WHERE balance < -10000000)
  SELECT '{{"kind":"reconciliation","totals":[' || (SELECT x FROM t) || '],"kinds":[' || (SELECT string_agg(x, ',' ORDER BY x) FROM y) || '],"negative":[' || coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM z), '') || ']}}' AS document""")
def packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document of totals, roll-up and negative balances."""
    tx = _ingest(spark, sf_dir)
    parts = {"totals": three_way_tieout(spark, sf_dir), "kinds": found.roll_up(tx, "kind", "amount"), "negative": ledger.negative_balances(ledger.party_balances(tx), 10_000_000)}
    return reports.packet(parts, "reconciliation")


@query("""WITH e AS (SELECT coalesce(ledger_code, 'none') AS session, doc_id, 0 AS part, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS ts, 'completion' AS type, CASE WHEN doc_type = 'session' THEN text ELSE coalesce(text, '') END AS payload FROM documents
  UNION ALL SELECT coalesce(ledger_code, 'none'), doc_id, 1, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S'), 'tool_call', '{"name":"session","type":"tool_use"}' FROM documents WHERE doc_type = 'session')
  SELECT session, row_number() OVER (PARTITION BY session ORDER BY doc_id, part) - 1 AS seq, ts, 'assistant' AS actor, type, payload FROM e WHERE payload IS NOT NULL""")
def transcript_flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript lines made of the documents (a text, or blocks of text and tool calls) flattened to events."""
    d = table(spark, sf_dir, "documents")
    blocks = F.array(F.to_json(F.struct(F.lit("text").alias("type"), "text")), F.to_json(F.struct(F.lit("tool_use").alias("type"), F.col("doc_type").alias("name"))))
    content = F.when(F.col("doc_type") == "session", F.concat(F.lit("["), F.array_join(blocks, ","), F.lit("]"))).otherwise(F.to_json(F.array(F.coalesce("text", F.lit("")))).substr(F.lit(2), F.length(F.to_json(F.array(F.coalesce("text", F.lit(""))))) - 2))
    line = F.concat(F.lit('{"ts":"'), F.col("created_at").cast("string"), F.lit('","role":"assistant","content":'), content, F.lit("}"))
    return files.transcript_events(d.select(F.coalesce("ledger_code", F.lit("none")).alias("session"), "doc_id", line.alias("line")), "session", "doc_id", "line")



# --- Evidence -------------------------------------------------------------------------------------------------------

# What is wrong with the event of each remainder by 16; 0 and 15 are sound, a full one and a redacted one.
_FAULTS = (
    None, "EVENT_NOT_OBJECT", "EVENT_UNKNOWN_FIELD", "EVENT_BAD_SEQ", "EVENT_BAD_TS", "EVENT_BAD_ACTOR", "EVENT_BAD_TYPE", "EVENT_BAD_PAYLOAD", "EVENT_BAD_PAYLOAD_HASH",
    "EVENT_BAD_REDACTED_FLAG", "EVENT_MISSING_PAYLOAD", "EVENT_REDACTED_WITH_PAYLOAD", "EVENT_UNFLAGGED_REDACTION", "EVENT_PAYLOAD_HASH_MISMATCH", "EVENT_BAD_META", None,
)


def _event_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as JSON text, one kind of fault for each remainder of its number."""
    e = table(spark, sf_dir, "events")
    k, props = F.col("event_id") % 16, F.col("props")
    commitment = F.concat(F.lit("0x"), F.sha2(props.cast("binary"), 256))
    quoted = lambda c: F.substring(F.to_json(F.array(c)), 2, 1 << 30).substr(F.lit(1), F.length(F.to_json(F.array(c))) - 2)
    member = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    members = F.array_compact(F.array(
        member("seq", F.when(k == 3, "-1").otherwise(F.col("event_id").cast("string"))), F.when(k != 4, member("ts", quoted(F.col("ts").cast("string")))), member("actor", F.when(k == 5, '""').otherwise(F.lit('"u"'))),
        member("type", F.when(k == 6, '"shout"').otherwise(F.lit('"note"'))), F.when(k == 7, member("payload", F.lit("7"))).when(~k.isin(10, 12, 15), member("payload", quoted(props))),
        F.when(k == 8, member("payloadHash", F.lit('"0x12"'))).when(k == 13, member("payloadHash", F.concat(F.lit('"0x'), F.sha2(F.lit(b"other"), 256), F.lit('"')))).when(k.isin(12, 15), member("payloadHash", quoted(commitment))),
        F.when(k == 9, member("redacted", F.lit('"yes"'))).when(k.isin(11, 15), member("redacted", F.lit("true"))), F.when(k == 2, member("extra", F.lit("1"))),
        F.when(k == 14, member("meta", F.concat(F.repeat(F.lit("["), 40), F.repeat(F.lit("]"), 40)))).otherwise(member("meta", F.lit('{"b":1,"a":[true,null]}'))),
    ))
    return e.select("event_id", F.when(k == 1, "[1]").otherwise(F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))).alias("text"))


@query("SELECT event_id, CASE event_id % 16 " + " ".join(f"WHEN {k} THEN '{r}'" for k, r in enumerate(_FAULTS) if r) + """ END AS reason, CASE WHEN event_id % 16 IN (0, 15) THEN '0x' || sha256('["test/v1:leaf",' || event_id || ',"' || strftime(ts, '%Y-%m-%d %H:%M:%S')
  || CASE WHEN date_part('microsecond', ts) % 1000000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(date_part('microsecond', ts) % 1000000 AS VARCHAR), 6, '0'), '0') END || '","u","note","0x' || sha256(props) || '","{\\"a\\":[true,null],\\"b\\":1}"]') END AS leaf FROM events""")
def events_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reason for which each event is refused, and the leaf of the sound ones."""
    x = evidence.strict_events(_event_texts(spark, sf_dir), "text", "sha256")
    return x.select("event_id", "reason", evidence.strict_leaf("test/v1:leaf", "sha256").alias("leaf"))


@query("""WITH c AS (SELECT doc_id, left(sha256(coalesce(text, '')), 40) AS commit, '0x' || sha256(source) AS root FROM documents WHERE doc_id % 7 NOT IN (4, 5))
  SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'no-expected-facts' WHEN doc_id % 5 = 1 THEN 'oid-mismatch' WHEN doc_id % 5 = 2 THEN 'root-mismatch' ELSE 'ok' END AS verdict FROM c""")
def claim_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commit claims found among notes (some withheld, some not canonical), checked against expected facts (some missing, some other)."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id") % 7
    oid = F.substring(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), 1, 40)
    root = F.concat(F.lit("0x"), F.sha2(F.col("source").cast("binary"), 256))
    told = F.concat(F.lit('{"commit":"'), oid, F.lit('","gitRoot":"'), root, F.lit('","kind":"claim@1"'), F.when(k == 1, ',"scope":"src/a"').otherwise(""), F.lit("}"))
    events = d.select("doc_id", F.lit("note").alias("type"), F.when(k == 4, F.concat(F.lit(" "), told)).when(k != 5, told).alias("payload"))
    m = F.col("doc_id") % 5
    facts = d.filter(m != 0).select("doc_id", F.when(m == 1, F.lit("0" * 40)).otherwise(oid).alias("oid"), F.when(m == 2, F.lit("0x" + "0" * 64)).otherwise(root).alias("root"))
    return evidence.claim_verdicts(evidence.claims(events, "claim@1"), facts, "doc_id")


@query(f"""WITH {_BANK} SELECT id, row_number() OVER (ORDER BY CASE kind WHEN 'nsf' THEN 1 WHEN 'fee' THEN 2 WHEN 'check' THEN 3 ELSE 4 END, coalesce(kind, ''), amount NULLS FIRST, CASE WHEN coalesce(CAST(date AS VARCHAR), memo, party) IS NULL THEN '' ELSE {_KEY} END) - 1 AS pos FROM (SELECT DISTINCT ON (amount, date) * FROM bank WHERE amount IS NOT NULL ORDER BY amount, date, id)""")
def exceptions_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry of each amount and day as an exception, numbered in the total order."""
    one = _bank(spark, sf_dir).filter("amount is not null").groupBy("amount", "date").agg(F.min_by(F.struct("id", "memo", "kind", "party"), "id").alias("r")).select("amount", "date", "r.*")
    severity = F.when(F.col("kind") == "nsf", "error").when(F.col("kind") == "fee", "warning").when(F.col("kind") == "check", "info").otherwise("other")
    return evidence.ordered_exceptions(one.select("id", severity.alias("severity"), F.coalesce("kind", F.lit("")).alias("type"), "amount", "date", "memo", "party")).select("id", "pos")


@query(f"WITH {_FINDINGS} SELECT source, count(*) FILTER (severity IN ('fatal', 'warning')) AS crossing, count(*) FILTER (severity IN ('fatal', 'warning')) > 0 AS fails FROM f GROUP BY 1")
def severity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.gate(_findings(spark, sf_dir), "warning")


@query(f"""WITH {_FINDINGS}, n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_RANK}, CAST(substr(rule, 4) AS INTEGER), location, message) AS nth FROM f)
  SELECT source, string_agg(upper(severity) || ' ' || rule || ' ' || location || ': ' || message, chr(10) ORDER BY nth) FILTER (nth <= 3) || CASE WHEN count(*) > 3 THEN chr(10) || (count(*) - 3) || ' more' ELSE '' END AS document FROM n GROUP BY 1""")
def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.text_summaries(_findings(spark, sf_dir), 3)


@query(f"""WITH {_BY_SOURCE}, w AS (SELECT *, row_number() OVER (ORDER BY source) AS nth FROM b WHERE NOT valid)
  SELECT (SELECT count(*) || ' files, ' || count(*) FILTER (NOT valid) || ' failed' FROM b) || chr(10) || (SELECT string_agg('FAILED ' || source || ': ' || coalesce(error, fatal || ' fatal'), chr(10) ORDER BY 'FAILED ' || source || ': ' || coalesce(error, fatal || ' fatal')) FROM w WHERE nth <= 5)
    || (SELECT CASE WHEN count(*) > 5 THEN chr(10) || (count(*) - 5) || ' more' ELSE '' END FROM w) AS document""")
def report_batch_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.batch_summary(_by_source(spark, sf_dir), 5)


@query(f"""WITH {_ORDERED} SELECT source, '<!DOCTYPE html><html><head><meta charset="utf-8"><title>' || source || '</title></head><body><table><tr><th>Severity</th><th>Rule</th><th>Location</th><th>Message</th></tr>'
  || string_agg('<tr><td>' || severity || '</td><td>' || rule || '</td><td>' || location || '</td><td>' || message || '</td></tr>', '' ORDER BY nth) || '</table></body></html>' AS document FROM n GROUP BY 1""")
def report_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.render(_findings(spark, sf_dir), "html")


@query(f"""WITH {_OLD}, l AS (SELECT path, content_hash, lower(sha256(encode(path) || '\x00'::BLOB || unhex(content_hash))) AS leaf, row_number() OVER (ORDER BY path) - 1 AS pos, count(*) OVER () AS n FROM o)
  SELECT pos, CASE pos WHEN 0 THEN '{{"files":[' ELSE ',' END || '{{"relPath":"' || path || '","contentHash":"' || content_hash || '","leaf":"' || leaf || '"}}' || CASE pos WHEN n - 1 THEN ']}}' ELSE '' END AS line FROM l""")
def manifest_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest as lines of one JSON document."""
    return reports.manifest_lines(_versions(spark, sf_dir)[0])


@query(f"""WITH {_RECORDS} SELECT index, '{{"contentHash":"' || content_hash || '","contributor":"' || contributor || '","authorBound":' || author_bound || ',"timestamp":' || timestamp || ',"blockNumber":' || block_number || coalesce(',"parent":"' || parent || '"', '') || ',"index":' || index || '}}' AS document FROM r""")
def registry_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.json_rows(_records(spark, sf_dir))


@query("""WITH b AS (SELECT o_custkey % 500 AS batch, sha256(CAST(o_orderkey % 20000 AS VARCHAR)) AS h FROM orders WHERE o_orderkey % 3 = 0)
  SELECT batch, count(*) AS hashes FROM b WHERE batch IN (SELECT batch FROM b GROUP BY 1 HAVING count(*) = count(DISTINCT h)) AND batch NOT IN (SELECT x.batch FROM b x JOIN b y ON x.h = y.h AND x.batch <> y.batch) GROUP BY 1""")
def batches_minted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of hashes that can be credited as a whole, where no two batches that are sound share a hash."""
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0")
    b = o.select((F.col("o_custkey") % 500).alias("batch"), F.sha2((F.col("o_orderkey") % 20000).cast("string").cast("binary"), 256).alias("content_hash"))
    shared = b.distinct().groupBy("content_hash").count().filter("count > 1").select("content_hash")
    return evidence.minted(b, shared).groupBy("batch").agg(F.count("*").alias("hashes"))


@query(f"""WITH {_OLD} SELECT path, strlen(coalesce(text, '')) AS size, content_hash AS digest FROM o JOIN (SELECT source || '/' || doc_id AS path, text FROM documents) USING (path)""")
def chunked_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into chunks of 1,000 characters, digested chunk by chunk."""
    d = table(spark, sf_dir, "documents").filter("doc_type != 'session'").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("t"))
    k = F.explode(F.sequence(F.lit(0), F.floor(F.length("t") / 1000).cast("int")))
    chunks = d.select("path", "t", k.alias("k")).select("path", "k", F.col("t").substr(F.col("k") * 1000 + 1, F.lit(1000)).cast("binary").alias("bytes"))
    return files.chunk_digests(chunks, "path", "k", "bytes")
