"""Scalar expressions. A value that can't be read is null, never a default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType


def first_count(fields: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """(value, name) of the first field, in order, that holds a whole number of at least 0."""
    whole = [(n, F.try_to_number(F.regexp_extract(c, r"^\s*([0-9]{1,18})\s*$", 1), F.lit("9" * 18)).cast("long")) for n, c in fields]
    return F.coalesce(*[v for _, v in whole]), F.coalesce(*[F.when(v.isNotNull(), F.lit(n)) for n, v in whole])


def published(epoch: Column, day: Column) -> tuple[Column, Column]:
    """(time, source): seconds since 1970 before a day written yyyymmdd."""
    t = F.when(epoch > 0, F.timestamp_seconds(epoch))
    at = F.when(F.rlike(day, F.lit("^[0-9]{8}$")), F.try_to_timestamp(day, F.lit("yyyyMMdd")))
    return F.coalesce(t, at), F.when(t.isNotNull(), "timestamp").when(at.isNotNull(), "upload_date")


def iso8601_seconds(s: Column) -> Column:
    """Seconds of a duration like P1DT2H3M4S; null if it is none."""
    part = lambda unit, head: F.coalesce(F.nullif(F.regexp_extract(s, rf"{head}([0-9]+){unit}", 1), F.lit("")).try_cast("long"), F.lit(0))
    whole = F.rlike(s, F.lit(r"^P(?=.)([0-9]+D)?(T(?=.)([0-9]+H)?([0-9]+M)?([0-9]+S)?)?$"))
    return F.when(whole, part("D", "P") * 86400 + part("H", "T") * 3600 + part("M", "T(?:[0-9]+H)?") * 60 + part("S", "T(?:[0-9]+H)?(?:[0-9]+M)?"))


def best_by(items: Column, key) -> Column:
    """The element with the largest key; of equal ones the first. Elements without a key don't count."""
    ranked = F.transform(items, lambda x, i: F.struct(key(x).alias("k"), (-i).alias("i"), x.alias("x")))
    return F.array_max(F.filter(ranked, lambda r: r["k"].isNotNull()))["x"]


def orientation(w: Column, h: Column) -> Column:
    r = h / F.nullif(w, F.lit(0))
    return F.when(h == 0, None).when(r > 1.1, "vertical").when(r < 0.9, "horizontal").when(r.isNotNull(), "square")


def aspect(w: Column, h: Column) -> Column:
    """w:h in lowest terms; the divisor by Euclid's steps, of which whole numbers below 10^8 take 40 at most."""
    pair = F.struct(w.cast("long").alias("a"), h.cast("long").alias("b"))
    step = lambda p, _: F.when(p["b"] == 0, p).otherwise(F.struct(p["b"].alias("a"), (p["a"] % F.nullif(p["b"], F.lit(0))).alias("b")))
    g = F.aggregate(F.sequence(F.lit(1), F.lit(40)), pair, step)["a"]
    return F.when((w > 0) & (h > 0), F.concat_ws(":", (w / g).cast("int").cast("string"), (h / g).cast("int").cast("string")))


def rescale(v: Column, w: Column, h: Column, canvas_w: float, canvas_h: float) -> tuple[Column, Column]:
    """(value on the canvas, reason): lengths of another aspect are refused."""
    off = F.abs(w / h - canvas_w / canvas_h) > 0.01
    return F.when(~off, v * canvas_w / w), F.when(off, "other aspect")


def script_share(text: Column, inside: str, letters: str = r"\p{L}") -> Column:
    """Share of the letters that a character class holds; null without letters."""
    n = F.length(F.regexp_replace(text, f"[^{letters}]", ""))
    return F.length(F.regexp_replace(text, f"[^{inside}]", "")) / F.nullif(n, F.lit(0))


def quote_pair(text: Column, pairs: dict[str, str]) -> Column:
    """The opening and closing mark of a text that has both."""
    t = F.trim(text)
    a, b = F.left(t, F.lit(1)), F.right(t, F.lit(1))
    out = F.lit(None).cast("string")
    for x, y in pairs.items():
        out = F.when((F.length(t) >= 2) & (a == x) & (b == y), x + y).otherwise(out)
    return out


def first_rule(text: Column, rules: list[tuple[str, str]], otherwise: str | None) -> Column:
    """The name of the first rule whose pattern the text holds."""
    out = F.lit(otherwise)
    for name, pattern in reversed(rules):
        out = F.when(F.rlike(text, F.lit(pattern)), name).otherwise(out)
    return out


#: Messages that ask for a login, and, if none of those, messages of a blocked request.
LOGIN = [
    r"[Ss]ign in to confirm",
    r"login required",
    r"[Ll]ogin is required",
    r"requires? (?:a )?log(?:ged)?[ -]?in",
    r"use --cookies",
    r"--cookies-from-browser",
    r"This content isn't available.*log",
    r"rate-limit reached or login required",
    r"age[- ]restricted|confirm your age",
]
BLOCKED = [
    r"Tunnel connection failed:\s*40[37]",
    r"ProxyError",
    r"blocked by (?:the )?(?:network|egress) policy",
    r"HTTP Error 403",
    r"\b403\b.*Forbidden",
    r"Forbidden.*\b403\b",
    r"HTTP Error 451",
]


def error_class(message: Column) -> Column:
    """login_required, blocked or error, without the colours that a terminal's message has; null for no message."""
    plain = F.regexp_replace(message, "\x1b\\[[0-9;]*m", "")
    return F.when(message.isNotNull(), first_rule(plain, [("login_required", p) for p in LOGIN] + [("blocked", p) for p in BLOCKED], "error"))


#: Where systems keep home folders and temporary files.
HOMES = ("/home/", "/Users/")
TEMPORARY = ("/tmp/", "/var/folders/", "/var/tmp/")


def scrub(text: Column) -> Column:
    """Home folders, those of Windows too, as ~, and temporary files as <tmp>; a path counts where it begins, not inside an address or a longer path."""
    begins, name, rest = r"(?<![\p{Alnum}_:/.])", r"[^/\\\s'\"]+", r"[^\s'\")]*"
    for home in HOMES:
        text = F.regexp_replace(text, begins + home + name, "~")
    text = F.regexp_replace(text, begins + "/root(?=/)", "~")
    text = F.regexp_replace(text, r"(?<![\p{Alnum}_])[A-Za-z]:\\+Users\\+" + name, "~")
    for folder in TEMPORARY:
        text = F.regexp_replace(text, begins + "(?:/private)?" + folder + rest, "<tmp>")
    return text


def scrub_nested(value: Column, kind: DataType) -> Column:
    """scrub in every text of a struct, array or map of the given type; keys stay."""
    if isinstance(kind, StringType):
        return scrub(value)
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*[scrub_nested(value[f.name], f.dataType).alias(f.name) for f in kind]))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: scrub_nested(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, x: scrub_nested(x, kind.valueType))
    return value


def rgb(hex_: Column) -> list[Column]:
    """Three ints of #RRGGBB; null if it is none."""
    ok = F.rlike(hex_, F.lit("^#[0-9A-Fa-f]{6}$"))
    return [F.when(ok, F.conv(F.substring(hex_, 2 + 2 * k, 2), 16, 10).cast("int")) for k in range(3)]


def color_distance(a: Column, b: Column) -> Column:
    return F.sqrt(sum((x - y) * (x - y) for x, y in zip(rgb(a), rgb(b), strict=True)).cast("double"))


def within(value: Column, low: Column, high: Column) -> Column:
    """Null if any of the three isn't measured."""
    return F.when(value.isNotNull() & low.isNotNull() & high.isNotNull(), value.between(low, high))


def digest(*columns: str) -> Column:
    """SHA-256 of the columns as JSON, in the order of their names."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def short_id(*columns: str, prefix: str = "c", n: int = 12) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws(":", *columns), 256), 1, n))


def normal_handle(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "^@+", ""), "[^0-9a-z_.]", "")


def recency(published_at: Column, checked_at: Column, days: float = 30.0) -> tuple[Column, Column, Column]:
    """(age in days, label, score): the score falls to 0 at three times `days`; a date in the future has age 0; none is unknown."""
    age = F.when(published_at.isNotNull(), F.greatest((F.unix_micros(checked_at) - F.unix_micros(published_at)) / 86.4e9, F.lit(0.0)))
    label = F.when(age.isNull(), "unknown").when(age <= days, "recent").otherwise("old")
    return age, label, F.when(age.isNotNull(), F.greatest(F.lit(0.0), 1 - age / (3 * days)))
