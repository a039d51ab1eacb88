"""Delimited records as raw text → valid transactions and, apart, each failed record with its reasons.

Blocks of records of one file are parsed in bulk by Arrow's CSV reader and checked column by column. A block that fails
anywhere is bisected until its parts pass or are small; records of the smallest failing blocks are diagnosed one by one
by a strict reader. The bulk path accepts nothing that the strict reader would refuse: quoting is checked against the
strict grammar by one regular expression over the block before Arrow reads it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date
from functools import lru_cache
from io import BytesIO

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallyweave.functions.dates import MONTH_NAMES
from tallyweave.session import small_side

# Header names by what they hold.
DATE_NAMES = ("date", "posting date")
AMOUNT_NAMES = ("amount",)
AMOUNT_PAIRS = (("debit", "credit"), ("withdrawal amt", "deposit amt"), ("charge", "payment"))  # money out, money in
MEMO_NAMES = ("memo", "description", "details")
KIND_NAMES = ("type",)
PARTY_NAMES = ("name", "tenant")

#: Failing blocks of at most so many records are read one by one.
LEAF = 16

_SPACE = " \t\r\n\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
_MONTH = "(?:" + "|".join(f"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in MONTH_NAMES) + ")"
_NUMBER = r"(?:(?:\d+|\d{1,3}(?:,\d{3})+)(?:\.\d{0,2})?|\.\d{1,2})"
_AMOUNT = rf"\$?[+-]?{_NUMBER}"
AMOUNT = rf"^(?:\({_AMOUNT}\)|{_AMOUNT})$"
DATE = rf"^(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}/\d{{1,2}}/(?:\d{{4}}|\d{{2}})|\d{{8}}|(?i:{_MONTH}) +\d{{1,2}}, *\d{{4}}|\d{{1,2}}-(?i:{_MONTH})-(?:\d{{4}}|\d{{2}}))$"
_AMOUNT_RE, _DATE_RE = re.compile(AMOUNT, re.ASCII), re.compile(DATE, re.ASCII)

SCHEMA = "file_id long, line_no int, txn_date date, amount long, memo string, kind string, party string, reasons array<string>"


@lru_cache(maxsize=100_000)
def parse_day(text: str) -> date | None:
    """The day in `text` (already trimmed), null unless a real one in an accepted form."""
    if not _DATE_RE.match(text):
        return None
    numbers = [int(x) for x in re.findall(r"\d+", text)]
    word = re.search(r"[A-Za-z]+", text)
    if word:
        month = next(k for k, m in enumerate(MONTH_NAMES, 1) if m.startswith(word[0][:3].lower()))
        day, year = numbers
    elif "/" in text:
        month, day, year = numbers
    elif "-" in text:
        year, month, day = numbers
    else:
        year, month, day = int(text[:4]), int(text[4:6]), int(text[6:])
    short = len(re.findall(r"\d+", text)[-1]) == 2 and ("/" in text or word)
    try:
        return date(year + 2000 if short else year, month, day)
    except ValueError:
        return None


def parse_cents(text: str) -> int | None:
    """Signed cents of `text` (already trimmed), null unless a valid amount. Parentheses turn the sign."""
    if not _AMOUNT_RE.match(text):
        return None
    digits = re.sub(r"[^0-9.]", "", text)
    whole, _, part = digits.partition(".")
    cents = int(whole or 0) * 100 + int(part.ljust(2, "0") or 0)
    return -cents if ("-" in text) != text.startswith("(") else cents


def split_record(text: str, delim: str) -> list[str] | None:
    """The fields of one record by the strict grammar, null if its quoting is wrong."""
    fields, at, n = [], 0, len(text)
    while True:
        if text.startswith('"', at):
            part, at = [], at + 1
            while True:
                end = text.find('"', at)
                if end < 0:
                    return None
                part.append(text[at:end])
                at = end + 1
                if not text.startswith('"', at):
                    break
                part.append('"')
                at += 1
            if at < n and text[at] != delim:
                return None
            fields.append("".join(part))
        else:
            end = text.find(delim, at)
            end = n if end < 0 else end
            if '"' in text[at:end]:
                return None
            fields.append(text[at:end])
            at = end
        if at >= n:
            return fields
        at += 1


class Layout:
    """Where a header's fields stand."""

    def __init__(self, header: str, delim: str) -> None:
        names = [x.strip(_SPACE).lower() for x in split_record(header, delim) or header.split(delim)]
        find = lambda wanted: next((names.index(x) for x in wanted if x in names), None)
        self.width, self.delim = len(names), delim
        self.day, self.memo, self.kind, self.party = find(DATE_NAMES), find(MEMO_NAMES), find(KIND_NAMES), find(PARTY_NAMES)
        #: (position, sign) of each amount field.
        self.amounts = [(names.index(x), 1) for x in AMOUNT_NAMES if x in names]
        for out, into in AMOUNT_PAIRS:
            self.amounts += [(names.index(x), sign) for x, sign in ((out, -1), (into, 1)) if x in names]
        d = re.escape(delim)
        one = rf'(?:"(?:[^"]|"")*"|[^"{d}\r\n]*)'
        self.strict = rf"^{one}(?:{d}{one}){{{self.width - 1}}}$"

    def diagnose(self, text: str) -> tuple:
        """(day, cents, memo, kind, party, reasons) of one record by the strict reader."""
        fields = split_record(text, self.delim)
        if fields is None:
            return None, None, None, None, None, ["quoting"]
        if len(fields) != self.width:
            return None, None, None, None, None, ["column_count"]
        get = lambda k: None if k is None else fields[k].strip(_SPACE)
        day = None if self.day is None else parse_day(get(self.day))
        filled = [(get(k), sign) for k, sign in self.amounts if get(k)]
        cents = parse_cents(filled[0][0]) if len(filled) == 1 else None
        reasons = ["date"] * (day is None) + ["amount"] * (cents is None)
        signed = None if cents is None else cents * filled[0][1]
        if signed is not None and abs(signed) >= 1 << 63:  # a valid amount beyond a long keeps no number
            signed = None
        return day, signed, get(self.memo), get(self.kind), get(self.party), reasons

    def bulk(self, texts: pa.Array) -> list[tuple] | None:
        """What diagnose() gives for each of `texts`, by columns; null if any record may be wrong or needs a closer look."""
        if not pc.all(pc.match_substring_regex(texts, self.strict)).as_py():
            return None
        try:
            grid = pacsv.read_csv(
                BytesIO("\n".join(texts.to_pylist()).encode()),
                pacsv.ReadOptions(column_names=[str(k) for k in range(self.width)], use_threads=False, block_size=1 << 30),
                pacsv.ParseOptions(delimiter=self.delim, newlines_in_values=True, ignore_empty_lines=False),
                pacsv.ConvertOptions(column_types={str(k): pa.string() for k in range(self.width)}, strings_can_be_null=False),
            )
        except pa.ArrowException:
            return None
        if grid.num_rows != len(texts) or self.day is None or not self.amounts:
            return None
        column = lambda k: pc.utf8_trim(grid.column(k), _SPACE)
        days = [parse_day(x) for x in column(self.day).to_pylist()]
        if None in days:
            return None
        amounts = [(column(k), sign) for k, sign in self.amounts]
        filled = [pc.not_equal(c, "") for c, _ in amounts]
        count = pc.cast(filled[0], pa.int8())
        for f in filled[1:]:
            count = pc.add(count, pc.cast(f, pa.int8()))
        if not pc.all(pc.equal(count, 1)).as_py():
            return None
        value = pc.binary_join_element_wise(*(c for c, _ in amounts), "")
        if not pc.all(pc.match_substring_regex(value, AMOUNT)).as_py() or pc.max(pc.utf8_length(value)).as_py() > 18:
            return None
        plain = pc.replace_substring_regex(value, r"[^0-9.]", "")
        parts = pc.cast(pc.if_else(pc.starts_with(plain, "."), pc.binary_join_element_wise("0", plain, ""), plain), pa.decimal128(24, 2))
        cents = pc.cast(pc.multiply(parts, pa.scalar(100, pa.decimal128(3, 0))), pa.int64())
        minus = pc.xor(pc.match_substring(value, "-"), pc.starts_with(value, "("))
        sign = pc.if_else(filled[0], amounts[0][1], 1)
        for f, (_, s) in zip(filled[1:], amounts[1:]):
            sign = pc.if_else(f, s, sign)
        cents = pc.multiply(cents, pc.multiply(pc.if_else(minus, -1, 1), sign))
        text = lambda k: [None] * len(texts) if k is None else column(k).to_pylist()
        return list(zip(days, cents.to_pylist(), text(self.memo), text(self.kind), text(self.party), ([] for _ in range(len(texts)))))

    def read(self, texts: pa.Array) -> list[tuple]:
        """diagnose() for each of `texts`: in bulk where a block passes, bisecting it where not."""
        if len(texts) > LEAF and (rows := self.bulk(texts)) is not None:
            return rows
        if len(texts) <= LEAF:
            return [self.diagnose(t) for t in texts.to_pylist()]
        half = len(texts) // 2
        return self.read(texts.slice(0, half)) + self.read(texts.slice(half))


def parse_records(records: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, line_no, txn_date, amount, memo, kind, party, reasons) of every record; `reasons` is empty for a valid one.

    Records that are null or white space only are ignored. A file's header and delimiter are those of its latest register
    row; records of files without any are left out, as nothing says how to read them. Repeated records give repeated rows.
    """
    heads = files.filter("header_line is not null and delim is not null").groupBy("file_id").agg(F.max_by(F.struct("header_line", "delim"), F.struct("received_at", "header_line", "delim")).alias("h"))
    heads = heads.select("file_id", "h.header_line", "h.delim")
    rows = records.select("file_id", "line_no", "raw_text").filter("raw_text is not null").join(small_side(heads), "file_id")
    types = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layouts: dict[tuple[str, str], Layout] = {}
        for batch in batches:
            blank = pc.equal(pc.utf8_trim(batch.column("raw_text"), _SPACE), "")
            batch = batch.filter(pc.invert(blank))
            if not batch.num_rows:
                continue
            batch = batch.take(pc.sort_indices(batch, [("file_id", "ascending"), ("line_no", "ascending")]))
            ids, texts = batch.column("file_id").to_pylist(), batch.column("raw_text").cast(pa.string())
            out, start = [], 0
            for k in range(1, len(ids) + 1):
                if k == len(ids) or ids[k] != ids[start]:
                    key = (batch.column("header_line")[start].as_py(), batch.column("delim")[start].as_py())
                    layout = layouts.setdefault(key, Layout(*key)) if key not in layouts else layouts[key]
                    out += layout.read(texts.slice(start, k - start))
                    start = k
            arrays = [batch.column("file_id").cast(pa.int64()), batch.column("line_no").cast(pa.int32())]
            arrays += [pa.array(c, types.field(j + 2).type) for j, c in enumerate(zip(*out))]
            yield pa.RecordBatch.from_arrays(arrays, schema=types)

    return rows.mapInArrow(parse, SCHEMA)


def failed(parsed: DataFrame) -> DataFrame:
    """(file_id, line_no, reason), distinct."""
    return parsed.select("file_id", "line_no", F.explode("reasons").alias("reason")).distinct()


def valid(parsed: DataFrame) -> DataFrame:
    """The valid transactions, each record once."""
    return parsed.filter(F.size("reasons") == 0).drop("reasons").distinct()
