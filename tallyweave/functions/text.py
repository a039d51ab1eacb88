"""Keys, tokens and predicates on names, memos, paths and rule ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a memo or type says, in the order in which it is asked.
KIND_PATTERNS = (
    ("nsf", r"\bnsf\b|returned|bounced|insufficient|reversal|reverse"),
    ("fee", r"\bfee\b|service charge|svc chg|charge\b"),
    ("transfer", r"transfer|xfer|ach out|ach in"),
    ("check", r"\bcheck\b|chk #|chk#|ck#|draw|disbursement|payee"),
    ("deposit", r"deposit|rent|payment received|received from"),
    ("adjustment", r"adjust|correction|void"),
)
# Words of a returned item, which override an explicit kind.
RETURNED = r"\bnsf\b|returned|bounced|insufficient|reversal"
# Kinds and their other names.
KIND_NAMES = {
    "deposit": "deposit", "check": "check", "transfer": "transfer", "fee": "fee", "nsf": "nsf", "adjustment": "adjustment", "other": "other",
    "dep": "deposit", "chk": "check", "cheque": "check", "payment": "deposit", "service charge": "fee", "xfer": "transfer", "returned": "nsf",
    "bounce": "nsf", "adj": "adjustment",
}


def squeeze(text: Column) -> Column:
    """White space collapsed to single blanks and trimmed (normalize-space)."""
    return F.btrim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def party_key(party: Column) -> Column:
    """Trimmed, lower case, white space collapsed; null and blank become 'unknown'."""
    return F.coalesce(F.nullif(F.lower(squeeze(party)), F.lit("")), F.lit("unknown"))


def name_tokens(text: Column) -> Column:
    """Lower-case alphanumeric words in order; an empty array for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def memo_similarity(a: Column, b: Column) -> Column:
    """Share of common words among all; 1 if both are blank, 0 if one is."""
    x, y = F.array_distinct(name_tokens(a)), F.array_distinct(name_tokens(b))
    both = F.size(F.array_union(x, y))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / both)


def classify_kind(text: Column, cents: Column) -> Column:
    """Kind of the first pattern that fits; else by sign: money in is a deposit, money out a check, none other."""
    said = F.lower(F.coalesce(text, F.lit("")))
    out = F.when(said.rlike(KIND_PATTERNS[0][1]), KIND_PATTERNS[0][0])
    for kind, pattern in KIND_PATTERNS[1:]:
        out = out.when(said.rlike(pattern), kind)
    return out.when(cents > 0, "deposit").when(cents < 0, "check").otherwise("other")


def coerce_kind(raw: Column, text: Column, cents: Column) -> Column:
    """Kind from an explicit name, else from name and text; a text that says returned overrides both."""
    names = F.create_map(*(F.lit(x) for kv in KIND_NAMES.items() for x in kv))
    name, said = F.lower(F.btrim(F.coalesce(raw, F.lit("")))), F.coalesce(text, F.lit(""))
    known = F.when(name != "", F.try_element_at(names, name))
    return F.when(F.lower(said).rlike(RETURNED), "nsf").otherwise(F.coalesce(known, classify_kind(F.concat_ws(" ", raw, said), cents)))


def record_key(date: Column, cents: Column, memo: Column, party: Column) -> Column:
    """Canonical sort key of a record. Amounts are padded as texts, so negative ones don't sort by value; equality is what counts."""
    return F.concat_ws("|", F.coalesce(date.cast("string"), F.lit("")), F.lpad(F.coalesce(cents.cast("string"), F.lit("")), 16, "0"), F.lower(squeeze(F.coalesce(memo, F.lit("")))), F.lower(squeeze(F.coalesce(party, F.lit("")))))


def natural_key(text: Column) -> Column:
    """Sort key in which runs of digits compare by value: each is padded to twelve digits."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d+|\D+)"), F.lit(1))
    padded = F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.lpad(r, 12, "0")).otherwise(r))
    return F.array_join(padded, "")


def under_prefix(path: Column, prefix: Column) -> Column:
    """True where `path` is `prefix` or lies in that folder; `a/bc` is not under `a/b`."""
    p = F.regexp_replace(prefix, "/+$", "")
    return (path == p) | path.startswith(F.concat(p, F.lit("/")))


def posix_path(path: Column) -> Column:
    """Path with forward slashes and without a leading `./`."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(?:\./)+", "")


def unsafe_path(path: Column) -> Column:
    """True for absolute paths, drive letters and paths that climb."""
    return path.rlike(r"^(?:/|\\|[A-Za-z]:)|(?:^|[/\\])\.\.(?:[/\\]|$)")


def local_name(qualified: Column) -> Column:
    """Name without `{namespace}` or prefix."""
    return F.regexp_replace(qualified, r"^(?:\{[^}]*\}|[^:]*:)", "")


def mod97_holds(account: Column) -> Column:
    """Modulus-97 check of an account text: the first four characters moved to the end, letters counted from 10.

    Any character above `@` counts as its code less 55, small letters too; blanks are dropped. Null for null, false for
    texts under five characters or with other signs.
    """
    s = F.regexp_replace(account, " ", "")
    turned = F.concat(F.substring(s, 5, 1 << 30), F.substring(s, 1, 4))
    value = lambda ch: F.when(ch.rlike("^[0-9]$"), ch.try_cast("int")).otherwise(F.ascii(ch) - 55)
    step = lambda acc, ch: (acc * F.when(value(ch) > 99, 1000).when(value(ch) > 9, 100).otherwise(10) + value(ch)) % 97
    rest = F.aggregate(F.filter(F.split(turned, "(?!^)"), lambda ch: ch != ""), F.lit(0), step)
    return F.when(account.isNotNull(), (F.length(s) > 4) & s.rlike("^[0-9A-Za-z]+$") & (rest == 1))


def count_noun(n: Column, noun: str) -> Column:
    """`1 file`, `2 files`."""
    return F.concat(n.cast("string"), F.when(n == 1, f" {noun}").otherwise(f" {noun}s"))


def state_code(raw: Column) -> Column:
    """Two capital letters of a state code; null for other texts."""
    s = F.upper(F.regexp_replace(raw, "[^A-Za-z]", ""))
    return F.when(F.length(s) == 2, s)


def phrase_at(words: Column, phrase: Column) -> Column:
    """True where the array `phrase` stands in the array `words` as a run; an empty phrase stands nowhere."""
    n = F.size(phrase)
    places = F.when((n > 0) & (F.size(words) >= n), F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.exists(places, lambda i: F.slice(words, i, n) == phrase)
