"""XML documents → element tables, nested invoices and structural checks by a restricted path language.

Documents are parsed once, hardened: no document type declarations, bounded size, depth and number of elements. The
element table (one row per element, with parent and path) makes structural tests relational; tests that need a tree are
compiled on the driver and evaluated per document in Arrow batches, contexts once for all tests that share them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Ceilings on a document.
MOST_BYTES, MOST_DEPTH, MOST_ELEMENTS = 64 << 20, 256, 2_000_000


@dataclass(slots=True)
class Element:
    """One element; `children` and `attributes` in document order, `name` without namespace."""

    number: int
    parent: int
    name: str
    space: str
    depth: int
    line: int
    attributes: dict[str, str]
    text: list[str]
    children: list[int]


class Refused(ValueError):
    """The document is malformed or beyond a ceiling."""


def parse(data: bytes | str) -> list[Element]:
    """The elements of a document in order; Refused for malformed ones, declarations of types or entities, and beyond the ceilings."""
    raw = data.encode("utf-8", "surrogatepass") if isinstance(data, str) else data
    if len(raw) > MOST_BYTES:
        raise Refused("too many bytes")
    out: list[Element] = []
    stack: list[int] = []
    parser = expat.ParserCreate(namespace_separator="}")
    parser.buffer_text = True

    def start(name: str, attributes: dict[str, str]) -> None:
        if len(stack) >= MOST_DEPTH or len(out) >= MOST_ELEMENTS:
            raise Refused("too deep" if len(stack) >= MOST_DEPTH else "too many elements")
        space, _, local = name.rpartition("}")
        e = Element(len(out), stack[-1] if stack else -1, local, space, len(stack), parser.CurrentLineNumber, {k.rpartition("}")[2]: v for k, v in attributes.items()}, [], [])
        if stack:
            out[stack[-1]].children.append(e.number)
        out.append(e)
        stack.append(e.number)

    def chars(text: str) -> None:
        if stack:
            out[stack[-1]].text.append(text)

    def forbid(*_: Any) -> None:
        raise Refused("a document type is declared")

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, lambda _: stack.pop(), chars
    parser.StartDoctypeDeclHandler = forbid
    try:
        parser.Parse(raw, True)
    except expat.ExpatError as e:
        raise Refused(f"malformed: {e}") from e
    return out


def element_table(documents: DataFrame, key: str, content: str) -> DataFrame:
    """(key, number, parent, name, namespace, path, depth, line, text, attributes, error): one row per element.

    `path` is made of names from the root. A document that is refused gives one row with its error only; a null one none.
    """
    kind = documents.schema[key].dataType.simpleString()
    ddl = f"`{key}` {kind}, number int, parent int, name string, namespace string, path string, depth int, line int, text string, attributes map<string,string>, error string"
    types = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if data is None:
                    continue
                try:
                    elements, paths, rows = parse(data), [], []
                    for e in elements:
                        paths.append((paths[e.parent] if e.parent >= 0 else "") + "/" + e.name)
                        rows.append((k, e.number, None if e.parent < 0 else e.parent, e.name, e.space, paths[-1], e.depth, e.line, "".join(e.text), list(e.attributes.items()), None))
                except Refused as e:
                    rows = [(k, *[None] * 9, str(e))]
                for at in range(0, len(rows), 50_000):  # a document may have millions of elements
                    part = list(zip(*rows[at : at + 50_000]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(part, types)], schema=types)

    return documents.select(key, content).mapInArrow(run, ddl)


# Invoices: the parts that reconciliation and roll-ups read, in both syntaxes.

INVOICE = (
    "syntax string, id string, issue_date string, type_code string, currency string, seller string, buyer string, net_total string, tax_total string, gross_total string, payable string, "
    "lines array<struct<id:string,name:string,quantity:string,unit:string,net:string,price:string,category:string,rate:string>>, "
    "breakdown array<struct<category:string,rate:string,taxable:string,tax:string>>, "
    "adjustments array<struct<charge:boolean,amount:string,category:string,rate:string>>, error string"
)


class Tree:
    """Look-ups of one document by names."""

    def __init__(self, elements: list[Element]) -> None:
        self.elements = elements

    def every(self, at: Element, path: str) -> list[Element]:
        here = [at]
        for name in path.split("/"):
            here = [self.elements[c] for e in here for c in e.children if self.elements[c].name == name]
        return here

    def text(self, at: Element, *paths: str) -> str | None:
        """Trimmed text of the first element that any path finds; null if none is there, empty if it is blank."""
        for path in paths:
            for e in self.every(at, path):
                return "".join(e.text).strip()
        return None

    def one(self, at: Element, path: str) -> Element | None:
        return next(iter(self.every(at, path)), None)


def _ubl(t: Tree, root: Element) -> dict:
    credit = root.name == "CreditNote"
    text, total = t.text, t.one(root, "LegalMonetaryTotal") or root
    party = lambda side: text(root, f"{side}/Party/PartyLegalEntity/RegistrationName", f"{side}/Party/PartyName/Name")
    return {
        "syntax": "ubl", "id": text(root, "ID"), "issue_date": text(root, "IssueDate"), "type_code": text(root, "InvoiceTypeCode", "CreditNoteTypeCode"), "currency": text(root, "DocumentCurrencyCode"),
        "seller": party("AccountingSupplierParty"), "buyer": party("AccountingCustomerParty"),
        "net_total": text(total, "LineExtensionAmount"), "tax_total": text(root, "TaxTotal/TaxAmount"), "gross_total": text(total, "TaxInclusiveAmount"), "payable": text(total, "PayableAmount"),
        "lines": [
            {
                "id": text(e, "ID"), "name": text(e, "Item/Name"), "quantity": text(e, "CreditedQuantity" if credit else "InvoicedQuantity"),
                "unit": next((q.attributes.get("unitCode") for q in t.every(e, "CreditedQuantity" if credit else "InvoicedQuantity")), None),
                "net": text(e, "LineExtensionAmount"), "price": text(e, "Price/PriceAmount"), "category": text(e, "Item/ClassifiedTaxCategory/ID"), "rate": text(e, "Item/ClassifiedTaxCategory/Percent"),
            }
            for e in t.every(root, "CreditNoteLine" if credit else "InvoiceLine")
        ],
        "breakdown": [{"category": text(e, "TaxCategory/ID"), "rate": text(e, "TaxCategory/Percent"), "taxable": text(e, "TaxableAmount"), "tax": text(e, "TaxAmount")} for e in t.every(root, "TaxTotal/TaxSubtotal")],
        "adjustments": [{"charge": {"true": True, "false": False}.get(text(e, "ChargeIndicator") or ""), "amount": text(e, "Amount"), "category": text(e, "TaxCategory/ID"), "rate": text(e, "TaxCategory/Percent")} for e in t.every(root, "AllowanceCharge")],
    }


def _cii(t: Tree, root: Element) -> dict:
    text = t.text
    trade = t.one(root, "SupplyChainTradeTransaction") or root
    agreed, settled = t.one(trade, "ApplicableHeaderTradeAgreement") or root, t.one(trade, "ApplicableHeaderTradeSettlement") or root
    total = t.one(settled, "SpecifiedTradeSettlementHeaderMonetarySummation") or root
    day = text(root, "ExchangedDocument/IssueDateTime/DateTimeString")
    return {
        "syntax": "cii", "id": text(root, "ExchangedDocument/ID"), "issue_date": f"{day[:4]}-{day[4:6]}-{day[6:8]}" if day and re.fullmatch(r"\d{8}", day) else day,
        "type_code": text(root, "ExchangedDocument/TypeCode"), "currency": text(settled, "InvoiceCurrencyCode"), "seller": text(agreed, "SellerTradeParty/Name"), "buyer": text(agreed, "BuyerTradeParty/Name"),
        "net_total": text(total, "LineTotalAmount"), "tax_total": text(total, "TaxTotalAmount"), "gross_total": text(total, "GrandTotalAmount"), "payable": text(total, "DuePayableAmount"),
        "lines": [
            {
                "id": text(e, "AssociatedDocumentLineDocument/LineID"), "name": text(e, "SpecifiedTradeProduct/Name"), "quantity": text(e, "SpecifiedLineTradeDelivery/BilledQuantity"),
                "unit": next((q.attributes.get("unitCode") for q in t.every(e, "SpecifiedLineTradeDelivery/BilledQuantity")), None),
                "net": text(e, "SpecifiedLineTradeSettlement/SpecifiedTradeSettlementLineMonetarySummation/LineTotalAmount"), "price": text(e, "SpecifiedLineTradeAgreement/NetPriceProductTradePrice/ChargeAmount"),
                "category": text(e, "SpecifiedLineTradeSettlement/ApplicableTradeTax/CategoryCode"), "rate": text(e, "SpecifiedLineTradeSettlement/ApplicableTradeTax/RateApplicablePercent"),
            }
            for e in t.every(trade, "IncludedSupplyChainTradeLineItem")
        ],
        "breakdown": [{"category": text(e, "CategoryCode"), "rate": text(e, "RateApplicablePercent"), "taxable": text(e, "BasisAmount"), "tax": text(e, "CalculatedAmount")} for e in t.every(settled, "ApplicableTradeTax")],
        "adjustments": [{"charge": {"true": True, "false": False}.get(text(e, "ChargeIndicator/Indicator") or ""), "amount": text(e, "ActualAmount"), "category": text(e, "CategoryTradeTax/CategoryCode"), "rate": text(e, "CategoryTradeTax/RateApplicablePercent")} for e in t.every(settled, "SpecifiedTradeAllowanceCharge")],
    }


#: Root names of the syntaxes.
ROOTS = {"Invoice": _ubl, "CreditNote": _ubl, "CrossIndustryInvoice": _cii}


def invoices(documents: DataFrame, key: str, content: str) -> DataFrame:
    """(key, the columns of INVOICE): one row per document; amounts as raw text.

    Refused documents and other roots have an error and nothing else; null content gives the error 'missing'.
    """
    kind = documents.schema[key].dataType.simpleString()
    ddl = f"`{key}` {kind}, {INVOICE}"
    types = to_arrow_schema(StructType.fromDDL(ddl))

    def read(data: Any) -> dict:
        if data is None:
            return {"error": "missing"}
        try:
            elements = parse(data)
            build = ROOTS.get(elements[0].name)
            return build(Tree(elements), elements[0]) if build else {"error": f"root {elements[0].name} is not supported"}
        except Refused as e:
            return {"error": str(e)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [read(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(types.field(0).type), *(pa.array([r.get(f.name) for r in rows], f.type) for f in list(types)[1:])], schema=types)

    return documents.select(key, content).mapInArrow(run, ddl)


def distinct_values(items: str, member: str) -> Column:
    """Distinct non-null values of a member of an array of structs."""
    return F.array_compact(F.array_distinct(F.transform(items, lambda e: e[member])))


def has_value(items: str, member: str, value: str) -> Column:
    """Whether any struct of an array has the value; false for null and empty arrays."""
    return F.coalesce(F.exists(items, lambda e: F.coalesce(e[member] == value, F.lit(False))), F.lit(False))


def every_adjustment(document: str, lines: str, member: str) -> Column:
    """Adjustments of the document and of all its lines in one array."""
    none = F.slice(F.col(document), 1, 0)
    return F.concat(F.coalesce(F.col(document), none), F.coalesce(F.flatten(F.transform(lines, lambda e: e[member])), none))


def embedded_xml(data: bytes) -> bytes | None:
    """The first embedded XML file of a PDF container: a stream marked as an embedded file, inflated where needed; null if none."""
    import zlib

    for m in re.finditer(rb"obj\s*<<(?P<dict>(?:[^>]|>(?!>))*?(?:<<.*?>>)?(?:[^>]|>(?!>))*?)>>\s*stream\r?\n", data, re.S):
        head = m["dict"]
        if b"/EmbeddedFile" not in head:
            continue
        end = data.find(b"endstream", m.end())
        body = data[m.end() : end if end >= 0 else None]
        if b"FlateDecode" in head:
            try:
                body = zlib.decompressobj().decompress(body, MOST_BYTES)
            except zlib.error:
                continue
        if body.lstrip()[:1] == b"<":
            return body.strip()
    return None


# The restricted path language: steps by child, parent `..`, `ancestor::x`, attribute `@x`, descent `//` and the root `/`.


def parse_path(path: str) -> tuple[bool, tuple[tuple[str, str], ...]]:
    """(from the root?, steps as (axis, name)); prefixes of names are dropped. ValueError for anything else."""
    rest, steps = path.strip(), []
    rooted = rest.startswith("/") and not rest.startswith("//")
    rest = rest[1:] if rooted else rest
    for part in re.split(r"(//|/)", rest):
        if part in ("", "/"):
            continue
        if part == "//":
            steps.append(("descend", "*"))
        elif part == "..":
            steps.append(("parent", ""))
        elif part == ".":
            steps.append(("self", ""))
        elif m := re.fullmatch(r"ancestor::(?:[\w.-]+:)?([\w.-]+|\*)", part):
            steps.append(("ancestor", m[1]))
        elif m := re.fullmatch(r"(@?)(?:[\w.-]+:)?([\w.-]+|\*)", part):
            steps.append(("attribute" if m[1] else "child", m[2]))
        else:
            raise ValueError(f"not a path of the restricted language: {path}")
    return rooted, tuple(steps)


class Document:
    """A parsed document with an index of its elements by name, shared by all tests."""

    def __init__(self, elements: list[Element]) -> None:
        self.elements = elements
        self.named: dict[str, list[Element]] = {}
        for e in elements:
            self.named.setdefault(e.name, []).append(e)

    def value(self, node: Element | str) -> str:
        if isinstance(node, str):
            return node
        return "".join(node.text) + "".join(self.value(self.elements[c]) for c in node.children)

    def select(self, at: Element, path: tuple[bool, tuple[tuple[str, str], ...]]) -> list[Element | str]:
        """Nodes that a path finds from `at`: elements, or texts for attributes."""
        rooted, steps = path
        here: list[Any] = [at]
        first = rooted
        for axis, name in steps:
            fits = lambda e, name=name: name in ("*", e.name)
            if first:
                here, first = [e for e in self.elements[:1] if fits(e)], False
            elif axis == "child":
                here = [self.elements[c] for e in here for c in e.children if fits(self.elements[c])]
            elif axis == "parent":
                here = list({e.parent: self.elements[e.parent] for e in here if e.parent >= 0}.values())
            elif axis == "ancestor":
                above: dict[int, Element] = {}
                for e in here:
                    while e.parent >= 0:
                        e = self.elements[e.parent]
                        if fits(e):
                            above[e.number] = e
                here = [above[k] for k in sorted(above)]
            elif axis == "attribute":
                here = [v for e in here for k, v in e.attributes.items() if name in ("*", k)]
            elif axis == "descend":
                seen: dict[int, Element] = {}
                stack = list(here)
                while stack:
                    e = stack.pop()
                    seen[e.number] = e
                    stack += [self.elements[c] for c in e.children]
                here = [seen[k] for k in sorted(seen)]
        return here

    def insertion_line(self, path: str) -> int | None:
        """Line of the deepest element of `path` that the document has: where the absent rest would have to be put.

        Paths are of child steps, relative to the root or rooted. Null where the whole path is there, nothing below the
        root is, a step fits several children (which one is meant is unknown), or the path has other steps.
        """
        rooted, steps = parse_path(path)
        if not steps or any(axis != "child" for axis, _ in steps):
            return None
        names = [n for _, n in steps]
        at = self.elements[0]
        if rooted and names.pop(0) != at.name:
            return None
        found = 0
        for name in names:
            fits = [self.elements[c] for c in at.children if self.elements[c].name == name]
            if len(fits) > 1:
                return None
            if not fits:
                return at.line if found else None
            at, found = fits[0], found + 1
        return None

    def contexts(self, context: str) -> list[Element]:
        """Elements that a rule context fits: alternatives parted by `|`, rooted or by trailing names, found by their last name."""
        out: dict[int, Element] = {}
        for branch in context.split("|"):
            rooted, steps = parse_path(branch)
            names = [n for axis, n in steps if axis == "child"]
            for e in self.elements if names[-1] == "*" else self.named.get(names[-1], []):
                chain, at = [], e
                while True:
                    chain.append(at.name)
                    if at.parent < 0:
                        break
                    at = self.elements[at.parent]
                chain.reverse()
                tail = chain[-len(names) :]
                if len(tail) == len(names) and all(n in ("*", c) for n, c in zip(names, tail)) and (not rooted or len(chain) == len(names)):
                    out[e.number] = e
        return [out[k] for k in sorted(out)]


_COMPARE = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
_TEST = re.compile(
    r"(?P<open>\()|(?P<close>\))|(?P<op><=|>=|!=|=|<|>)|(?P<word>\b(?:and|or)\b)|(?P<call>(?:not|count|exists|string-length|normalize-space|substring-after|number|true|false)\s*\()|(?P<comma>,)|(?P<number>\d+(?:\.\d+)?)|(?P<text>'[^']*'|\"[^\"]*\")|(?P<path>(?:\.\.|[\w.:@*/-])+)|(?P<minus>-)|(?P<space>\s+)"
)


class Test:
    """A compiled test: a boolean expression over paths with not, count, exists, comparisons, and, or.

    Comparisons of node sets are existential: `a != 'x'` holds if any node differs.
    """

    def __init__(self, test: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(test):
            m = _TEST.match(test, at)
            if not m:
                raise ValueError(f"not a test of the restricted language: {test}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup or "", m[0]))
            at = m.end()
        self.at = 0
        self.tree = self._or()
        if self.at != len(self.tokens):
            raise ValueError(f"not a test of the restricted language: {test}")

    def _peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("", "")

    def _take(self, kind: str) -> str:
        if self._peek()[0] != kind:
            raise ValueError(f"{kind} expected")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def _or(self) -> tuple:
        left = self._and()
        while self._peek() == ("word", "or"):
            self.at += 1
            left = ("or", left, self._and())
        return left

    def _and(self) -> tuple:
        left = self._compare()
        while self._peek() == ("word", "and"):
            self.at += 1
            left = ("and", left, self._compare())
        return left

    def _compare(self) -> tuple:
        left = self._term()
        if self._peek()[0] == "op":
            op = self._take("op")
            return ("compare", op, left, self._term())
        return left

    def _term(self) -> tuple:
        kind, text = self._peek()
        if kind == "open":
            self.at += 1
            inner = self._or()
            self._take("close")
            return inner
        if kind == "call":
            self.at += 1
            name = text[:-1].strip()
            args = [] if self._peek()[0] == "close" else [self._or()]
            while self._peek()[0] == "comma":
                self._take("comma")
                args.append(self._or())
            if len(args) != {"true": 0, "false": 0, "substring-after": 2}.get(name, 1):
                raise ValueError(f"{name} has another number of arguments")
            self._take("close")
            return ("call", name, *args)
        if kind == "number":
            return ("value", float(self._take("number")))
        if kind == "text":
            return ("value", self._take("text")[1:-1])
        return ("path", parse_path(self._take("path")))

    def holds(self, doc: Document, at: Element) -> bool:
        """Whether the test holds at a context element."""
        return self._true(self._value(self.tree, doc, at))

    @staticmethod
    def _true(v: Any) -> bool:
        return v == v and v != 0 if isinstance(v, float) else bool(v)

    def _value(self, node: tuple, doc: Document, at: Element) -> Any:
        kind = node[0]
        if kind == "value":
            return node[1]
        if kind == "path":
            return doc.select(at, node[1])
        if kind in ("and", "or"):
            left = self._true(self._value(node[1], doc, at))
            return left and self._true(self._value(node[2], doc, at)) if kind == "and" else left or self._true(self._value(node[2], doc, at))
        if kind == "call":
            name, value = node[1], self._value(node[2], doc, at) if len(node) > 2 else None
            if name in ("true", "false"):
                return name == "true"
            if name == "not":
                return not self._true(value)
            if name == "exists":
                return bool(value)
            if name == "count":
                return float(len(value))
            text = self._text(value, doc)
            if name == "substring-after":
                return text.partition(self._text(self._value(node[3], doc, at), doc))[2]
            if name == "normalize-space":
                return " ".join(text.split())
            return float(len(text)) if name == "string-length" else self._number(text)
        _, op, a, b = node
        left, right = self._value(a, doc, at), self._value(b, doc, at)
        lefts, rights = ([doc.value(x) for x in v] if isinstance(v, list) else [v] for v in (left, right))
        return any(self._holds(op, x, y) for x in lefts for y in rights)

    def _holds(self, op: str, x: Any, y: Any) -> bool:
        if op in ("<", "<=", ">", ">=") or isinstance(x, float) or isinstance(y, float):
            x, y = self._number(x), self._number(y)
        return bool(_COMPARE[op](x, y))

    def _text(self, v: Any, doc: Document) -> str:
        if isinstance(v, list):
            return doc.value(v[0]) if v else ""
        return str(v)

    @staticmethod
    def _number(v: Any) -> float:
        if isinstance(v, (bool, float)):
            return float(v)
        s = str(v).strip()
        return float(s) if re.fullmatch(r"-?(?:\d+\.?\d*|\.\d+)", s) else float("nan")


def evaluate(documents: DataFrame, key: str, content: str, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    """(key, rule, severity, path, line): one row per context element at which a test fails.

    `rules` are (id, severity, context, test); a rule that doesn't compile is an error of the caller. Contexts are looked
    up once per document and shared. Documents that are refused give one row with the rule 'unreadable'.
    """
    compiled: dict[str, list[tuple[str, str, Test]]] = {}
    for rule, severity, context, test in rules:
        compiled.setdefault(context, []).append((rule, severity, Test(test)))
    kind = documents.schema[key].dataType.simpleString()
    ddl = f"`{key}` {kind}, rule string, severity string, path string, line int"
    types = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if data is None:
                    continue
                try:
                    doc = Document(parse(data))
                except Refused:
                    rows.append((k, "unreadable", "fatal", None, None))
                    continue
                for context, tests in compiled.items():
                    for e in doc.contexts(context):
                        for rule, severity, test in tests:
                            if not test.holds(doc, e):
                                names, at = [], e
                                while True:
                                    names.append(at.name)
                                    if at.parent < 0:
                                        break
                                    at = doc.elements[at.parent]
                                rows.append((k, rule, severity, "/" + "/".join(reversed(names)), e.line))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), types)] if rows else [pa.array([], f.type) for f in types], schema=types)

    return documents.select(key, content).mapInArrow(run, ddl)


def severity_counts(violations: DataFrame, key: str) -> DataFrame:
    """(key, severity, findings) over the result of evaluate()."""
    return violations.groupBy(key, "severity").agg(F.count("*").alias("findings"))


def insertion_points(documents: DataFrame, key: str, content: str, paths: list[str]) -> DataFrame:
    """(key, path, line): for each of `paths` that a document lacks the line of the deepest element it has of it, where there is one.

    Documents that are refused or null give no rows.
    """
    kind = documents.schema[key].dataType.simpleString()
    ddl = f"`{key}` {kind}, path string, line int"
    types = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    doc = Document(parse(data)) if data is not None else None
                except Refused:
                    doc = None
                rows += [(k, p, line) for p in paths if doc is not None and (line := doc.insertion_line(p)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(types)], schema=types)

    return documents.select(key, content).mapInArrow(run, ddl)


def schematron_asserts(text: str) -> list[tuple[str, str, str, str]]:
    """(id, severity, context, test) of the asserts of a Schematron file."""
    elements = parse(text)
    out = []
    for e in elements:
        if e.name == "assert":
            context = elements[e.parent].attributes.get("context", "")
            out.append((e.attributes.get("id", ""), e.attributes.get("flag", "fatal"), context, e.attributes.get("test", "")))
    return out


def shape(test: str) -> str:
    """Class of an assert's test: absence, count, existence, comparison or other, by its outermost form."""
    t = " ".join(test.split())
    if re.match(r"^not\s*\(", t):
        return "absence"
    if re.match(r"^count\s*\(", t):
        return "count"
    if re.match(r"^(?:exists\s*\(.*\)|[\w.:@*/-]+)$", t):
        return "existence"
    return "comparison" if re.search(r"[<>=]", t) else "other"


def shapes(rules: DataFrame) -> DataFrame:
    """(shape, rules, percent) of a rule table with the column test: counts and shares of all. The classes are those of shape()."""
    t = F.btrim(F.regexp_replace("test", r"\s+", " "))
    by = F.when(t.rlike(r"^not\s*\("), "absence").when(t.rlike(r"^count\s*\("), "count").when(t.rlike(r"^(?:exists\s*\(.*\)|[\w.:@*/-]+)$"), "existence")
    by = by.when(t.rlike("[<>=]"), "comparison").otherwise("other")
    x = rules.groupBy(by.alias("shape")).agg(F.count("*").alias("rules"))
    total = F.sum("rules").over(Window.partitionBy(F.lit(1)))  # five rows at most
    return x.withColumn("percent", F.round(F.col("rules") * 100.0 / total, 2))
