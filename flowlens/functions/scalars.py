"""Column functions: ratios, texts, times, digests, scores."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b != 0, b))


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def weighted_score(p: Column, a: Column, supervised: float, anomaly: float) -> Column:
    if supervised <= 0 or anomaly <= 0 or abs(supervised + anomaly - 1) > 1e-9:
        raise ValueError("weights are positive and sum to 1")
    return p * supervised + a * anomaly


def casefold_trim(x: Column) -> Column:
    """Trimmed and lower-cased; a few letters such as the sharp s stay, unlike under full case folding."""
    return F.lower(F.trim(x))


def parse_utc(text: Column) -> Column:
    """ISO-8601 text that names its zone, as a timestamp; null for anything else."""
    return F.when(text.rlike(r"(?:[zZ]|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(text))


def epoch_micros(seconds: Column, fraction: Column, units: int) -> Column:
    """Microseconds of a second and its fraction in units a second; null where the fraction isn't less than one second."""
    return F.when((fraction >= 0) & (fraction < units), seconds * 1_000_000 + F.floor(fraction * F.lit(1_000_000) / units)).cast("long")


def packed_address(text: Column) -> Column:
    """The bytes of an IPv4 or IPv6 address as text in hexadecimal, so that their order is that of the bytes; null for anything else."""
    v4 = F.array_join(F.transform(F.split(text, r"\."), lambda x: F.lpad(F.hex(x.try_cast("int")), 2, "0")), "")
    groups = lambda part: F.filter(F.split(part, ":"), lambda x: x != "")
    wide = lambda g: F.transform(g, lambda x: F.lpad(F.upper(x), 4, "0"))
    # a double colon stands for as many zero groups as are missing
    left, right = groups(F.split_part(text, F.lit("::"), F.lit(1))), groups(F.split_part(text, F.lit("::"), F.lit(2)))
    v6 = F.array_join(F.concat(wide(left), F.array_repeat(F.lit("0000"), F.lit(8) - F.size(left) - F.size(right)), wide(right)), "")
    return F.when(text.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), v4).when(text.rlike(r"^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$"), v6)


def sha256_of(*columns: Column) -> Column:
    """Digest of the key-sorted compact JSON of columns, which have names."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def fingerprint(values: Sequence[Column]) -> Column:
    """Digest of a vector of doubles, of which any two that differ have different texts; -0.0 counts as 0."""
    return F.sha2(F.concat_ws(",", *[F.coalesce((v.cast("double") + F.lit(0.0)).cast("string"), F.lit("null")) for v in values]), 256)


def near_fingerprint(values: Sequence[Column], tolerance: float) -> Column:
    return F.sha2(F.concat_ws(",", *[F.bround(v / tolerance).cast("long").cast("string") for v in values]), 256)


def interpolate(x: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Piecewise linear through knots of rising x, 0 below and 1 above; a single knot gives 0, 0.5 or 1."""
    if len(knots) == 1:
        return F.when(x < knots[0][0], 0.0).when(x > knots[0][0], 1.0).otherwise(0.5)
    out = F.when(x < knots[0][0], F.lit(0.0)).when(x > knots[-1][0], F.lit(1.0))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:], strict=False):
        out = out.when(x < x1, F.lit(y0) + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return out.otherwise(F.lit(knots[-1][1]))


def has_token(text: Column, tokens: Sequence[str]) -> Column:
    if not tokens:
        return F.lit(False)
    # one pass over the text, put in lower case once
    return F.lower(text).rlike("|".join(re.escape(t.lower()) for t in tokens))


def json_depth(text: Column) -> Column:
    """How deep brackets nest outside strings."""
    bare = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', "")
    steps = F.transform(F.regexp_extract_all(bare, F.lit(r"[\[\]{}]"), F.lit(0)), lambda c: F.when(c.isin("[", "{"), 1).otherwise(-1))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(steps, start, lambda s, d: F.struct((s["now"] + d).alias("now"), F.greatest(s["most"], s["now"] + d).alias("most")), lambda s: s["most"])


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """The version-5 UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def normalize_ip(text: Column) -> Column:
    """Compressed lower-case address of version 4 or 6; null for invalid text."""
    v4 = text.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$")
    low = F.lower(text)
    halves = F.split(low, "::")
    parts = lambda x: F.when(F.length(x) > 0, F.split(x, ":")).otherwise(F.array().cast("array<string>"))
    head, tail = parts(F.get(halves, 0)), parts(F.coalesce(F.get(halves, 1), F.lit("")))
    missing = 8 - F.size(head) - F.size(tail)
    fits = F.when(F.size(halves) == 2, missing >= 1).otherwise((F.size(halves) == 1) & (missing == 0))
    groups = F.concat(head, F.when(missing > 0, F.array_repeat(F.lit("0"), missing)).otherwise(F.array().cast("array<string>")), tail)
    good = fits & F.forall(F.concat(head, tail), lambda g: g.rlike("^[0-9a-f]{1,4}$"))
    short = F.array_join(F.transform(groups, lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":")
    # the first of the longest runs of at least two zero groups; an address that has its double colon has no second one
    pattern = lambda n: F.concat(F.lit("^(.*?)(?:^|:)0(?::0){"), (n - 1).cast("string"), F.lit("}(?:$|:)(.*)$"))
    out = F.aggregate(F.sequence(F.lit(8), F.lit(2), F.lit(-1)), short, lambda x, n: F.when(x.contains("::"), x).otherwise(F.regexp_replace(x, pattern(n), F.lit("$1::$2"))))
    return F.when(v4, text).when(good, out)
