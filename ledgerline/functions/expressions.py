"""Column expressions: rounding as the source database does it, normal forms for comparison, names and verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(19,4)"
WIDE = "decimal(38,4)"


def round3(x: Column, d: int, flag: Column | int = 0) -> Column:
    """Three-argument ROUND on a decimal: flag 0 rounds half away from zero, any other flag truncates towards zero.
    Null if x or flag is null."""
    scale = F.lit(10**d).cast("decimal(38,0)") if d >= 0 else None
    cut = F.signum(x).cast("decimal(1,0)") * F.floor(F.abs(x) * scale) / scale if scale is not None else F.signum(x).cast("decimal(1,0)") * F.floor(F.abs(x) / F.lit(10**-d)) * F.lit(10**-d)
    flag = F.lit(flag) if isinstance(flag, int) else flag
    return F.when(flag == 0, F.round(x, d).cast(WIDE)).when(flag != 0, cut.cast(WIDE))


def cast_int(x: Column, money: bool = False) -> Column:
    """CAST(x AS INT): money rounds half away from zero, other numbers are cut towards zero."""
    return (F.round(x, 0) if money else x).cast("int")


def isnull(x: Column, other: Column) -> Column:
    return F.coalesce(x, other)


def iif(test: Column, then: Column, other: Column) -> Column:
    """IIF: an unknown test counts as false."""
    return F.when(test, then).otherwise(other)


def flip_sign(test: Column, x: Column) -> Column:
    """-x where test holds, else x."""
    return x * iif(test, F.lit(-1), F.lit(1))


def left(x: Column, n: int) -> Column:
    return F.substring(x, 1, n)


def sql_len(x: Column) -> Column:
    """LEN: trailing blanks don't count."""
    return F.length(F.rtrim(x))


def is_valid_ymd(x: Column) -> Column:
    """Whether a text is a business date: eight digits that name a day. False for null."""
    return F.coalesce(F.length(x) == 8, F.lit(False)) & x.rlike("^[0-9]{8}$") & F.try_to_timestamp(x, F.lit("yyyyMMdd")).isNotNull()


def in_list(x: Column, csv: Column | str, sep: str = ",") -> Column:
    """Membership of x in a delimited list. Null where x or the list is null, as in SQL; negate it for NOT IN."""
    csv = F.lit(csv) if isinstance(csv, str) else csv
    return F.when(x.isNotNull(), F.array_contains(F.split(csv, f"\\Q{sep}\\E"), x))


def normalize_value(x: Column, kind: str, numeric: str = "scale3") -> Column:
    """The text that a value is compared by: booleans as true and false, timestamps to the second, numbers with three
    decimals ("scale3") or as they are written ("text"). Null stays null."""
    if kind == "boolean":
        return x.cast("string")
    if kind.startswith(("timestamp", "date")):
        return F.date_format(x, "yyyy-MM-dd HH:mm:ss")
    number = x.try_cast("decimal(38,3)")
    if kind == "string":
        return F.when(number.isNotNull() & F.lit(numeric == "scale3"), number.cast("string")).otherwise(x)
    return number.cast("string") if numeric == "scale3" else x.cast("string")


def values_equal(a: Column, b: Column) -> Column:
    """Whether two normal forms are equal, ignoring case; null equals null only."""
    return F.lower(a).eqNullSafe(F.lower(b))


def normalize_quote(x: Column) -> Column:
    """A quotation without white space and the marks * ` | _ ~."""
    return F.regexp_replace(x, r"[\s*`|_~]+", "")


def normalize_heading(x: Column) -> Column:
    """A heading without leading # signs and numbering and without a colon at its end."""
    bare = F.regexp_replace(F.trim(x), r"^#+\s*", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"^\d+(?:\.\d+)*[.)]?\s+", ""), r"\s*:\s*$", ""))


def mentions(text: Column, value: Column) -> Column:
    """Whether a text names a value: in quotes or backquotes, or as a whole word by ASCII word boundaries."""
    quoted = F.contains(text, F.concat(F.lit("'"), value, F.lit("'"))) | F.contains(text, F.concat(F.lit('"'), value, F.lit('"'))) | F.contains(text, F.concat(F.lit("`"), value, F.lit("`")))
    literal = F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q"))  # an end of quoting inside of it is put in by hand
    pattern = F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), literal, F.lit(r"\E(?![A-Za-z0-9_])"))
    return quoted | (F.contains(text, value) & F.regexp_like(text, pattern))


def text_hash(x: Column) -> Column:
    """SHA-256 of a text; empty and null texts give the empty text."""
    return F.when(F.coalesce(F.length(x), F.lit(0)) == 0, F.lit("")).otherwise(F.sha2(x, 256))


def split_code_values(x: Column) -> Column:
    """The values of a cell that lists codes: split at commas, trimmed, taken out of matching quotes, empty ones left out."""
    parts = F.transform(F.split(x, ","), lambda v: F.regexp_replace(F.trim(v), r"^(['\"`])(.*)\1$", "$2"))
    return F.filter(parts, lambda v: v != "")


def normalized_score(*axes: Column) -> Column:
    """Five axes of 0 to 10 as 0 to 100, halves to even."""
    total = sum(axes[1:], axes[0])
    return F.bround(total.cast("decimal(10,2)") * 100 / (10 * len(axes)), 0).cast("int")


#: Object type codes and names, by kind.
OBJECT_KINDS = {
    "Procedure": ("p", "pc", "sql_stored_procedure", "clr_stored_procedure", "procedure"),
    "Function": ("fn", "if", "tf", "fs", "ft", "sql_scalar_function", "sql_inline_table_valued_function", "sql_table_valued_function", "function"),
    "Table": ("u", "user_table", "table"),
    "View": ("v", "view"),
    "Trigger": ("tr", "sql_trigger", "trigger"),
    "Synonym": ("sn", "synonym"),
}


def classify_object_type(x: Column) -> Column:
    """The kind of an object type, ignoring case and blanks around it; Unknown for others and null."""
    name, out = F.lower(F.trim(x)), F
    for kind, names in OBJECT_KINDS.items():
        out = out.when(name.isin(*names), kind)
    return out.otherwise("Unknown")


def canonical_key(db: Column, schema: Column, name: Column, kind: Column) -> Column:
    """database.schema.name.type with % and . escaped, lower-cased in all but the type; null parts are empty."""
    part = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("%"), F.lit("%25")), F.lit("."), F.lit("%2E"))
    return F.concat_ws(".", F.lower(part(db)), F.lower(part(schema)), F.lower(part(name)), part(kind))


def base_name(x: Column) -> Column:
    """The last part of a dotted name, without brackets and quotes."""
    return F.regexp_replace(F.element_at(F.split(x, r"\."), -1), r'[\[\]"]', "")


#: HTTP statuses after which a call is worth repeating.
TRANSIENT_STATUS = (408, 409, 425, 429, 500, 502, 503, 504, 529)


def retry_verdict(kind: Column, status: Column, attempt: Column | None = None, most: int = 3) -> Column:
    """What a failed call means: cancelled, exhausted (a transient failure of the last attempt), transient, or fatal."""
    transient = kind.isin("timeout", "network") | status.isin(*TRANSIENT_STATUS)
    last = attempt >= most if attempt is not None else F.lit(False)
    return F.when(kind == "cancelled", "cancelled").when(transient & last, "exhausted").when(transient, "transient").otherwise("fatal")
