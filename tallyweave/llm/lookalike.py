"""One form for texts that look the same but differ in their characters.

DuckDB runs inside Arrow partitions: embedded SQL drops invisible characters by a regular expression, maps width forms,
blanks and look-alikes by `translate`, and composes accents by `nfc_normalize`. Letter case, missing accents, raised
digits, longer dashes, line breaks and the number of blanks stay as they are.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.session import checkpointed

# Characters drawn like a Latin letter or a hyphen, by what they are drawn like.
DRAWN_LIKE = {
    "A": "ΑАᎪꓮ", "B": "ΒВᏴꓐ", "C": "ϹСᏟꓚⅭ", "D": "ᎠꓓⅮ", "E": "ΕЕᎬꓰ", "F": "ϜꓝԲ", "G": "ԌᏀꓖ", "H": "ΗНᎻꓧ", "I": "ΙІӀⅠ", "J": "ͿЈᎫꓙ",
    "K": "ΚКᏦꓗ", "L": "ᏞꓡⅬ", "M": "ΜМᎷꓟⅯ", "N": "Νꓠ", "O": "ΟОՕꓳ", "P": "ΡРᏢꓑ", "Q": "Ԛ", "R": "ᎡꓣᏒ", "S": "ЅՏᏚꓢ", "T": "ΤТᎢꓔ",
    "U": "Սꓴ", "V": "ѴᏙꓦⅤ", "W": "ԜᏔꓪ", "X": "ΧХꓫⅩ", "Y": "ΥҮꓬ", "Z": "ΖᏃꓜ",
    "a": "а", "c": "ϲсⅽ", "d": "ԁⅾ", "e": "е", "g": "ց", "h": "һհ", "i": "іⅰ", "j": "ϳј", "l": "ӏⅼ", "m": "ⅿ", "n": "ո", "o": "οоօ",
    "p": "р", "q": "ԛ", "s": "ѕ", "u": "ս", "v": "ѵⅴ", "w": "ԝ", "x": "хⅹ", "y": "уү", "z": "ᴢ",
    "-": "‐‑˗⁃﹣－",
}
# Blanks of other widths, and classes of characters without any look.
BLANKS = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
INVISIBLE = (
    r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}"
    r"\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}\x{1BCA0}-\x{1BCA3}\x{1D173}-\x{1D17A}\x{E0000}-\x{E0FFF}]"
)


@lru_cache(maxsize=1)
def mapping() -> dict[str, str]:
    """Every mapped character and its form: width forms by Unicode's wide and narrow decompositions, blanks, look-alikes,
    and composed letters whose base is a look-alike."""
    out = {c: latin for latin, drawn in DRAWN_LIKE.items() for c in drawn}
    for code in [*range(0xFF00, 0xFFF0)]:
        kind, _, form = unicodedata.decomposition(chr(code)).partition(" ")
        if kind in ("<wide>", "<narrow>"):
            out.setdefault(chr(code), chr(int(form, 16)))
    out |= dict.fromkeys(BLANKS, " ")
    for code in [*range(0x370, 0x590), *range(0x1F00, 0x2000)]:
        whole = unicodedata.normalize("NFD", chr(code))
        if len(whole) > 1 and whole[0] in out:
            form = unicodedata.normalize("NFC", out[whole[0]] + whole[1:])
            if len(form) == 1:
                out.setdefault(chr(code), form)
    return out


def form_sql(text: str) -> str:
    """DuckDB expression: the one form of the text expression."""
    pairs = mapping()
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    steps = f"regexp_replace({text}, '{INVISIBLE}', '', 'g')"
    steps = f"translate({steps}, {quote(''.join(pairs))}, {quote(''.join(pairs.values()))})"
    return f"nfc_normalize({steps})"


def one_form(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, form, form_key, text_key): the form of each text, and 128-bit keys of form and text.

    form is null for a null text; form_key is null also where the form has no visible character. One row per row.
    """
    kind = df.schema[key].dataType.simpleString()
    sql = f"""
        SELECT k, form, CASE WHEN regexp_matches(form, '[^\\s\\x{{85}}\\x{{2028}}\\x{{2029}}]') THEN md5(form) END AS form_key, md5(t) AS text_key
        FROM (SELECT k, t, {form_sql("t")} AS form FROM batch)
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        db = duckdb.connect(config={"threads": 1, "memory_limit": "700MB", "preserve_insertion_order": True})
        for batch in batches:
            db.register("batch", pa.Table.from_arrays([batch.column(0), batch.column(1)], names=["k", "t"]))
            yield from db.sql(sql).to_arrow_table().rename_columns([key, "form", "form_key", "text_key"]).to_batches()
            db.unregister("batch")
        db.close()

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, form string, form_key string, text_key string")


def same_look(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_a, doc_b): rows whose texts look the same but are not equal in code points, smaller key first.

    Forms are compared by class: copies of one text make one class, classes of one form are paired, and only pairs of
    classes are expanded to rows, so copies never meet each other. Keys are 128 bits of a digest.
    """
    rows = checkpointed(one_form(df, key, text).filter("form_key is not null").select(F.col(key).alias("id"), F.unhex("form_key").alias("form"), F.unhex("text_key").alias("own")).distinct())
    classes = rows.groupBy("form", "own").agg(F.count("*").alias("n"))
    mixed = classes.groupBy("form").agg(F.min("own").alias("low"), F.max("own").alias("high")).filter("low != high").select("form")
    few = classes.join(mixed, "form", "left_semi").select("form", "own")
    pairs = few.alias("x").join(few.alias("y"), (F.col("x.form") == F.col("y.form")) & (F.col("x.own") < F.col("y.own"))).select("x.form", F.col("x.own").alias("a"), F.col("y.own").alias("b"))
    first = pairs.join(rows.select("form", F.col("own").alias("a"), F.col("id").alias("id_a")), ["form", "a"])
    both = first.join(rows.select("form", F.col("own").alias("b"), F.col("id").alias("id_b")), ["form", "b"])
    return both.filter("id_a != id_b").select(F.least("id_a", "id_b").alias("doc_a"), F.greatest("id_a", "id_b").alias("doc_b")).distinct()


def look_classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, look_id, text_id, spellings): one row for each row whose text has a visible character; copies are not expanded into pairs.

    `look_id` is the least key of the rows that look the same, `text_id` that of the rows equal in code points, `spellings`
    the number of different texts of the look. Rows that differ in text_id and agree in look_id are the pairs of
    same_look(). Classes are counted before rows meet them, so a look that a third of all rows has joins one row per text.
    """
    rows = checkpointed(one_form(df, key, text).filter("form_key is not null").select(F.col(key).alias("id"), F.unhex("form_key").alias("form"), F.unhex("text_key").alias("own")))
    texts = rows.groupBy("form", "own").agg(F.min("id").alias("text_id"))
    looks = texts.groupBy("form").agg(F.min("text_id").alias("look_id"), F.count("*").alias("spellings"))
    named = texts.join(looks, "form").select("form", "own", "text_id", "look_id", "spellings")
    return rows.join(named, ["form", "own"]).select(F.col("id").alias(key), "look_id", "text_id", "spellings")
