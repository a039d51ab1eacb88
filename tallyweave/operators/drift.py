"""Feeds whose columns drift between files: a catalogue of column lifespans, the change log and one consistent table.

The keys of a file's records are exploded into footer metadata: one row per (file, key) with counts by JSON type and by
what the values look like. What a key means is decided per feed from the alias table and, for names that table lacks,
from the values. `lag` over a feed's periods then yields islands of equal (presence, name, type) for each field; their
starts and endings are the changes. Raw records are read once; everything after the catalogue works on rows per key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.dates import parse_date, safe_date
from tallyweave.functions.text import KIND_NAMES
from tallyweave.session import checkpointed, small_side

# Words that name a kind of movement of money.
KIND_WORDS = (
    "deposit", "dep", "check", "chk", "cheque", "transfer", "xfer", "trf", "fee", "srvchg", "charge", "nsf", "returned", "return", "reversal",
    "adjustment", "adj", "other", "payment", "withdrawal", "credit", "debit",
)
FIELDS = ("date", "party", "kind")
#: JSON types with a value.
TYPES = ("array", "boolean", "number", "object", "string")

_DAY_TEXT = (
    r"(?i)^\s*(?:\d{4}-\d{1,2}-\d{1,2}(?:[t ].*)?|(?:19|20)\d{6}|\d{1,2}[/.]\d{1,2}[/.](?:\d{4}|\d{2})|[a-z]{3,9}\.? \d{1,2},? \d{4}"
    r"|\d{1,2}[- ][a-z]{3,9}\.?[- ](?:\d{4}|\d{2}))\s*$"
)
_DAY_NUMBER = r"^(?:(?:19|20)\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])|\d{10}|\d{13})$"
_DAY_NESTED = r'(?<![\w."])(?:19|20)\d{2}(?![\w."])'
_NAME = r"^[\p{L}\p{M}'’.&,\- ]*\p{L}{2,}[\p{M}.,]*[ ,]+[&\p{L}][\p{L}\p{M}'’.&,\- ]*(?:\([^)]*\))?$"


def folded(key: Column) -> Column:
    """A key trimmed (white space and no-break spaces) and in lower case."""
    return F.lower(F.btrim(key, F.lit(" \t\n\x0b\f\r\u00a0")))


def known_names(aliases: DataFrame) -> DataFrame:
    """(name, known): the field of each known name, folded; of a name with several fields the least. A fixed table of a few dozen rows."""
    return aliases.select(folded(F.col("alias")).alias("name"), F.col("logical_field").alias("known")).groupBy("name").agg(F.min("known").alias("known"))


def _json_type(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | (kind == "VOID"), F.lit(None))
        .when(kind == "STRING", "string")
        .when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind == "BOOLEAN", "boolean")
        .otherwise("number")
    )


def footer(records: DataFrame) -> DataFrame:
    """(file_id, row_no, name, json_type, text): one row per key of each distinct record.

    Payloads that are no JSON object and keys of blanks give no rows. json_type is 'string', 'number', 'object', 'array', 'boolean', or null
    for a null value.
    """
    rows = records.select("file_id", "row_no", "payload").distinct()
    pairs = rows.select("file_id", "row_no", F.explode(F.from_json("payload", "map<string,variant>")).alias("key", "value"))
    json_type = _json_type(F.col("value"))
    return pairs.filter(folded(F.col("key")) != "").select("file_id", "row_no", folded(F.col("key")).alias("name"), json_type.alias("json_type"), F.try_variant_get("value", "$", "string").alias("text"))


def catalogue(records: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Footer metadata: one row per (file_id, name) with the rows that have the key, its types and what its values look like.

    Columns: n_rows, n_string, n_number, n_object, n_array, n_boolean, known (its field by the alias table); as_date, as_kind,
    as_party (values that look so), low and high (least and greatest text, to tell constants) of names without one. What
    values of known names look like decides nothing and is not asked. The alias table is fixed, a few dozen rows.
    """
    x = footer(records)
    x = x.withColumn("known", F.lit(None).cast("string")) if aliases is None else x.join(F.broadcast(known_names(aliases)), "name", "left")
    text, kind = F.when(F.col("known").isNull(), F.col("text")), F.col("json_type")
    word = F.lower(F.btrim(text))
    inner = F.lower(text)
    kind_inside = r'"(?:' + "|".join(KIND_WORDS) + r')"'
    nested = kind.isin("object", "array")
    looks_date = (
        F.when(kind == "string", text.rlike(_DAY_TEXT)).when(kind == "number", text.rlike(_DAY_NUMBER)).when(nested, text.rlike(_DAY_NESTED) & ~text.rlike('"[^"]*"\\s*[,\\]]|:\\s*"'))
    )
    looks_kind = F.when(kind == "string", word.isin(*KIND_WORDS)).when(kind == "number", text.rlike(r"^\d{1,2}$")).when(nested, inner.rlike(kind_inside))
    looks_party = (
        F.when(kind == "string", text.rlike(_NAME))
        .when(kind == "number", text.rlike(r"^\d{5,7}$"))
        .when(nested, text.rlike(r'"[^"]*\p{L}{2,}[^"]*"\s*[,\]}]') & ~inner.rlike(kind_inside) & text.rlike(r'(?i)"[a-z_]*name"\s*:|^\s*\[\s*"[^"]*"\s*,\s*"|"[^"]*\p{L}{2,}[ ,]+\p{L}[^"]*"'))
    )
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    # Asked in turn, so that a value that looks like a date is not asked for the others.
    looks = F.when(looks_date, F.when(looks_kind, "dk").otherwise("d")).when(looks_kind, "k").when(looks_party, "p")
    x = x.withColumn("looks", F.when(F.col("known").isNull(), looks))
    return x.groupBy("file_id", "name").agg(
        F.count("*").alias("n_rows"),
        *(yes(kind == t).alias(f"n_{t}") for t in TYPES),
        *(yes(F.col("looks").contains(c)).alias(f"as_{f}") for c, f in (("d", "date"), ("k", "kind"), ("p", "party"))),
        F.min(text).alias("low"),
        F.max(text).alias("high"),
        F.first("known").alias("known"),
    )


def deliveries(files: DataFrame) -> DataFrame:
    """(file_id, feed_id, period_no): the delivery that counts for each period, that with the greatest received_at (then file_id)."""
    feeds = files.filter((F.col("row_table") == "feed_record") & F.col("feed_id").isNotNull() & F.col("period_no").isNotNull())
    return feeds.groupBy("feed_id", "period_no").agg(F.max(F.struct("received_at", "file_id")).alias("last")).select(F.col("last.file_id").alias("file_id"), "feed_id", "period_no")


def meanings(cat: DataFrame, aliases: DataFrame) -> DataFrame:
    """(feed_id, name, field): what each key of a feed means; `cat` is the catalogue with feed_id.

    A known alias means its field. An unknown name means the field that most of its values in the feed look like (a party:
    nine tenths of them): texts and nested values first, numbers only where the feed has no others. A name constant within every file that has
    several rows (a stamp), or one whose values mostly look like none of the fields, has no meaning.
    """
    known = known_names(aliases)
    shaped = F.col("n_string") + F.col("n_object") + F.col("n_array")
    per_feed = cat.groupBy("feed_id", "name").agg(
        F.sum(shaped).alias("shaped"),
        F.sum("n_number").alias("numbers"),
        *(F.sum(f"as_{f}").alias(f"as_{f}") for f in FIELDS),
        *(F.sum(F.when(F.col("n_number") == 0, F.col(f"as_{f}")).otherwise(0)).alias(f"pure_{f}") for f in FIELDS),
        F.sum(F.when(F.col("n_number") == 0, shaped).otherwise(0)).alias("pure"),
        F.bool_or((F.col("low") != F.col("high")) & (F.col("n_rows") > 1)).alias("varies"),
        F.max("n_rows").alias("longest"),
    )
    # Numbers look like little; where enough other values stand in files without numbers, those decide.
    use = lambda f: F.when(F.col("pure") >= 3, F.col(f"pure_{f}")).otherwise(F.col(f"as_{f}"))
    total = F.when(F.col("pure") >= 3, F.col("pure")).otherwise(F.col("shaped") + F.col("numbers"))
    best = F.greatest(*(use(f) for f in FIELDS))
    # Free texts often look like names; those of a party nearly always do.
    guess = F.when(best * 2 > total, F.when(best == use("kind"), "kind").when(best == use("date"), "date").when(best * 10 > total * 9, "party"))
    # A stamp such as the day of export is the same in all rows of a file; kinds and parties may be so by chance.
    stamp = (guess == "date") & ~F.coalesce(F.col("varies"), F.lit(False)) & (F.col("longest") > 2)
    x = per_feed.join(F.broadcast(known), "name", "left")  # the alias table is fixed, a few dozen rows
    return x.select("feed_id", "name", F.coalesce("known", F.when(~F.coalesce(stamp, F.lit(False)), guess)).alias("field")).filter(F.col("field").isNotNull())


def described(records: DataFrame, files: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(deliveries, catalogue with feed_id and period_no, meanings) of the deliveries that count. The catalogue, a row per key of
    a file, is read several times and written once."""
    last = deliveries(files)
    cat = checkpointed(catalogue(records.join(last.select("file_id"), "file_id", "left_semi"), aliases).join(last, "file_id"))
    return last, cat, meanings(cat, aliases).filter(F.col("field").isin(*FIELDS))


def lifespans(records: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row per (feed_id, period_no, file_id, field) with `present`, `name`, `json_type` and the previous file's, by lag.

    `name` is the key most rows use (ties: the least), `json_type` that of most non-null values (ties: the least name).
    """
    last, cat, mean = described(records, files, aliases)
    used = cat.join(mean, ["feed_id", "name"])
    per = used.groupBy("file_id", "field").agg(
        F.min(F.struct((-F.col("n_rows")).alias("n"), "name")).alias("top"),
        *(F.sum(f"n_{t}").alias(t) for t in TYPES),
    )
    most = F.greatest(*(F.col(t) for t in TYPES))
    json_type = F.coalesce(*(F.when((F.col(t) == most) & (most > 0), t) for t in TYPES))
    per = per.select("file_id", "field", F.col("top.name").alias("name"), json_type.alias("json_type"))
    grid = last.select("*", F.explode(F.array(*(F.lit(f) for f in FIELDS))).alias("field"))
    x = grid.join(per, ["file_id", "field"], "left").withColumn("present", F.col("name").isNotNull())
    w = Window.partitionBy("feed_id", "field").orderBy("period_no")
    before = {f"before_{c}": F.lag(c).over(w) for c in ("present", "name", "json_type")}
    return x.withColumns(before)


def changes(spans: DataFrame) -> DataFrame:
    """(file_id, field, change) from lifespans: the starts and endings of islands of presence, name and type. Distinct by construction."""
    here, there = F.col("present"), F.col("before_present")
    kept = here & there
    change = F.array(
        F.when(here & ~there, "added"),
        F.when(~here & there, "removed"),
        F.when(kept & (F.col("name") != F.col("before_name")), "renamed"),
        F.when(kept & (F.col("json_type") != F.col("before_json_type")), "retyped"),
    )
    return spans.filter(there.isNotNull()).select("file_id", "field", F.explode(F.array_compact(change)).alias("change"))


def islands(spans: DataFrame) -> DataFrame:
    """Lifespans of columns: (feed_id, field, name, json_type, first_period, last_period, files), one per island of equal name and type."""
    w = Window.partitionBy("feed_id", "field").orderBy("period_no")
    same = F.col("present").eqNullSafe(F.col("before_present")) & F.col("name").eqNullSafe(F.col("before_name")) & F.col("json_type").eqNullSafe(F.col("before_json_type"))
    x = spans.withColumn("island", F.sum(F.when(same, 0).otherwise(1)).over(w)).filter("present")
    return x.groupBy("feed_id", "field", "island").agg(
        F.first("name").alias("name"), F.first("json_type").alias("json_type"), F.min("period_no").alias("first_period"), F.max("period_no").alias("last_period"), F.count("*").alias("files")
    ).drop("island")


def unified(records: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """(feed_id, period_no, file_id, row_no, date, party, kind): one table with constant columns, text as read.

    Of several keys of one field in a row, the least non-null counts. A field the row lacks is null, as are all fields of a
    payload that is no JSON object.
    """
    return _picked(records, files, aliases).select("feed_id", "period_no", "file_id", "row_no", *(F.col(f)["text"].alias(f) for f in FIELDS))


def _picked(records: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """unified() with a struct of text and JSON type per field and whether the payload is an object.

    A feed's few names go with its files as one map, so that records are read in place, not exploded, and only what is
    picked is shuffled.
    """
    last, _, mean = described(records, files, aliases)
    names = mean.groupBy("feed_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "field")))).alias("names"))
    x = records.select("file_id", "row_no", "payload").join(small_side(last.join(names, "feed_id", "left")), "file_id")
    cells = F.map_entries(F.from_json("payload", "map<string,variant>"))
    meant = F.transform(cells, lambda e: F.struct(F.try_element_at("names", folded(e["key"])).alias("field"), F.try_variant_get(e["value"], "$", "string").alias("text"), _json_type(e["value"]).alias("json_type")))
    x = x.withColumn("cells", F.filter(meant, lambda c: c["field"].isNotNull() & c["json_type"].isNotNull()))
    least = lambda f: F.array_min(F.transform(F.filter("cells", lambda c: c["field"] == f), lambda c: F.struct(c["text"].alias("text"), c["json_type"].alias("json_type"))))
    return x.groupBy("feed_id", "period_no", "file_id", "row_no").agg(F.bool_or(F.col("cells").isNotNull()).alias("readable"), *(F.min(least(f)).alias(f) for f in FIELDS))


def _day(text: Column) -> Column:
    """The day of a text: the forms of parse_date(), ISO days before a time of day, days before months parted by dots or blanks."""
    s = F.regexp_replace(F.btrim(text), r"^(\d{4}-\d{2}-\d{2})[Tt ].*$", "$1")
    dots = r"^(\d{1,2})\.(\d{1,2})\.(\d{4}|\d{2})$"
    part = lambda k: F.regexp_extract(s, dots, k).try_cast("int")
    dotted = safe_date(F.when(part(3) < 100, part(3) + 2000).otherwise(part(3)), part(2), part(1))
    return F.when(s.rlike(dots), dotted).otherwise(parse_date(F.regexp_replace(s, r"^(\d{1,2}) ([A-Za-z]{3,9})\.? (\d{2,4})$", "$1-$2-$3")))


def _number_day(text: Column) -> Column:
    """The day of a number: yyyymmdd, or an epoch of ten digits (seconds) or thirteen (milliseconds)."""
    whole, day = F.length(text), text.try_cast("bigint")
    since = lambda n: F.date_from_unix_date(F.floor(day / n).cast("int"))
    return F.when(whole == 8, safe_date(F.floor(day / 10_000).cast("int"), F.floor(day / 100).cast("int") % 100, (day % 100).cast("int"))).when(whole == 10, since(86_400)).when(whole == 13, since(86_400_000))


def _members(*paths: str) -> Callable[[Column], Column]:
    return lambda text: safe_date(*(F.get_json_object(text, p).try_cast("int") for p in paths))


def _said(value: Column) -> Column:
    return F.nullif(F.btrim(value), F.lit(""))


def _kind(value: Column) -> Column:
    """A kind's own name for its other names, else the text in lower case."""
    name = F.lower(_said(value))
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in KIND_NAMES.items() for x in kv)), name), name)


#: For each field and JSON type the cast to the field's one type: what it reads, and the cast of the value's text (objects and
#: arrays are JSON). Pairs not listed here have no cast, and their values fail.
CASTS: dict[tuple[str, str], tuple[str, Callable[[Column], Column]]] = {
    ("date", "string"): ("day text", _day),
    ("date", "number"): ("yyyymmdd or epoch", _number_day),
    ("date", "object"): ("members y, m, d", _members("$.y", "$.m", "$.d")),
    ("date", "array"): ("items year, month, day", _members("$[0]", "$[1]", "$[2]")),
    ("party", "string"): ("text", _said),
    ("party", "number"): ("number as text", _said),
    ("party", "object"): ("member name", lambda t: _said(F.get_json_object(t, "$.name"))),
    ("party", "array"): ("items joined", lambda t: _said(F.array_join(F.from_json(t, "array<string>"), " "))),
    ("kind", "string"): ("name", _kind),
    ("kind", "number"): ("code", _said),
    ("kind", "object"): ("member label", lambda t: _kind(F.get_json_object(t, "$.label"))),
    ("kind", "array"): ("first item", lambda t: _kind(F.get_json_object(t, "$[0]"))),
}


def casts(aliases: DataFrame) -> DataFrame:
    """(name, field, json_type, reads): the casts generated for each known name, one row per JSON type its field can be read from."""
    spark = aliases.sparkSession
    listed = spark.createDataFrame([(f, t, reads) for (f, t), (reads, _) in CASTS.items()], "field string, json_type string, reads string")
    return known_names(aliases).withColumnRenamed("known", "field").join(F.broadcast(listed), "field").select("name", "field", "json_type", "reads")


def typed(records: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """unified() with one type a column: date as a date, party as text, kind as a kind's name; and readable, failed.

    Each value is cast by its field and JSON type (CASTS). A kind given as a code is named by the records that give code and
    label together, of several labels the one given most often (ties: the least); a code never labelled stays a code.
    `failed` names the fields that have a value which no cast can read; such a field is null. `json_types` has what was cast.
    """
    x = checkpointed(_picked(records, files, aliases))  # a row a record, of three short values, read twice
    pair = F.col("kind")["text"]
    labels = x.filter(F.col("kind")["json_type"] == "object").select(F.get_json_object(pair, "$.code").alias("code"), _kind(F.get_json_object(pair, "$.label")).alias("label")).dropna()
    labels = labels.groupBy("code", "label").count().groupBy("code").agg(F.min(F.struct(-F.col("count"), "label")).alias("best")).select("code", F.col("best.label").alias("label"))

    def cast(f: str) -> Column:
        text, kind = F.col(f)["text"], F.col(f)["json_type"]
        mine = {t: run for (field, t), (_, run) in CASTS.items() if field == f}
        # As higher-order functions casts part the generated code, which in one method would be too long for the JVM to compile.
        apart = lambda run: F.get(F.transform(F.array(text), run), F.lit(0))
        return F.coalesce(*(F.when(kind == t, apart(run)) for t, run in mine.items()))

    y = x.select("feed_id", "period_no", "file_id", "row_no", "readable", *(F.col(f)["json_type"].alias(f"{f}_type") for f in FIELDS), *(cast(f).alias(f) for f in FIELDS))
    y = y.join(small_side(labels), (y.kind_type == "number") & (y.kind == labels.code), "left").withColumn("kind", F.coalesce("label", "kind")).drop("code", "label")
    wrong = F.array_compact(F.array(*(F.when(F.col(f).isNull() & F.col(f"{f}_type").isNotNull(), f) for f in FIELDS)))
    return y.select("feed_id", "period_no", "file_id", "row_no", "readable", *FIELDS, wrong.alias("failed"), F.struct(*(F.col(f"{f}_type").alias(f) for f in FIELDS)).alias("json_types"))


def cast_report(table: DataFrame) -> DataFrame:
    """(file_id, field, json_type, rows, failed) of typed(): how many values of each type were cast in a file, and how many could not be."""
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.col("json_types")[f].alias("json_type"), F.array_contains("failed", f).alias("bad")) for f in FIELDS))
    x = table.select("file_id", F.explode(each).alias("c")).filter("c.json_type is not null")
    return x.groupBy("file_id", F.col("c.field").alias("field"), F.col("c.json_type").alias("json_type")).agg(F.count("*").alias("rows"), F.count_if("c.bad").alias("failed"))
