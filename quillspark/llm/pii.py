"""PII: format-preserving Feistel pseudonyms.

Mail addresses, IPv4 addresses, dates, social security numbers, phone and card numbers are found by pattern and validated (octets,
calendar, number plan, Luhn); what is valid is permuted with a key inside the set of valid values of its own format, so that
the result has the same shape, equal values stay equal in all documents, and different ones stay different.

* Numbers: a value is its rank among the valid ones, ``rank = l * b + r`` with l < a and r < b, and ``ROUNDS`` keyed rounds add
  digests of one half to the other, modulo a or b. ``a * b`` is just the number of valid values, so the rounds permute them.
  Card numbers keep their first digit and get the check digit that belongs to the new ones; phone numbers keep their
  country code; dates run from 1900 to 2099.
* Mail addresses: the local part is cut in two and its letters and digits are shifted, each within its class, by
  digests of the other half and of the domain. Other characters and the domain stay.

Only built-in functions are used. Null stays null, the empty text empty; what fails its validation stays as it is (a
number that only looks like a card number is no card number). Repeated rows give equal results. Extra columns stay. An empty
table gives no rows. ``KEY`` is public: a key of one's own is handed in, or set as ``CONF`` in the session for the query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, read

ROUNDS, KEY, CONF = 10, "quillspark", "spark.quillspark.pii.key"
KINDS = ("email", "ip", "date", "ssn", "phone", "card")

SHAPES = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+(?<=\.[A-Za-z]{2,24})",
    "ip": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
    "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "phone": r"(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}",
    "card": r"[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}",
}
#: What may not stand before and behind.
AROUND = {
    "email": (r"(?<![A-Za-z0-9._%+-])", ""),
    "ip": (r"(?<![0-9.])", r"(?!\.?[0-9])"),
    "date": (r"(?<![0-9/-])", r"(?![0-9/-])"),
    "ssn": (r"(?<![0-9-])", r"(?![0-9-])"),
    "phone": (r"(?<![0-9+])", r"(?![0-9])"),
    "card": (r"(?<![0-9])", r"(?![0-9])"),
}
ANY = "|".join(f"{AROUND[k][0]}(?:{SHAPES[k]}){AROUND[k][1]}" for k in KINDS)


def _long(x) -> "F.Column":
    return x.cast("long") if hasattr(x, "cast") else F.lit(x).cast("long")


def _digest(key: str, *parts: "F.Column") -> "F.Column":
    return F.sha2(F.concat_ws("|", F.lit(key), *parts), 256)


def permute(rank: "F.Column", a: "F.Column", b: "F.Column", kind: str, key: str) -> "F.Column":
    """A keyed permutation of the numbers under ``a * b``."""
    text = lambda c: c.cast("string")
    add = lambda half, other, i, m: (half + _long(F.conv(F.substring(_digest(key, F.lit(kind), text(a), text(b), text(i), text(other)), 1, 15), 16, 10)) % m) % m
    # ranks over 2^53 would lose digits in a division of doubles
    start = F.struct(((rank - rank % b).cast("decimal(38,0)") / b.cast("decimal(38,0)")).cast("long").alias("l"), (rank % b).alias("r"))
    step = lambda s, i: F.when(i % 2 == 0, F.struct(add(s["l"], s["r"], i, a).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), add(s["r"], s["l"], i, b).alias("r")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * b + s["r"])


def _digits(s: "F.Column") -> "F.Column":
    return F.regexp_replace(s, "[^0-9]", "")


def _fill(shape: "F.Column", digits: "F.Column") -> "F.Column":
    """``shape`` with its digits replaced, in order, by ``digits``."""
    start = F.struct(F.lit(1).alias("i"), F.lit("").alias("out"))
    step = lambda s, c: F.when(c.rlike("[0-9]"), F.struct((s["i"] + 1).alias("i"), F.concat(s["out"], F.substring(digits, s["i"], F.lit(1))).alias("out"))).otherwise(F.struct(s["i"].alias("i"), F.concat(s["out"], c).alias("out")))
    return F.aggregate(F.split(shape, ""), start, step, lambda s: s["out"])


def _luhn(digits: "F.Column") -> "F.Column":
    """The Luhn sum modulo 10; the last digit counts once."""
    twice = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(twice(c.cast("int"))))
    return F.aggregate(each, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))) % 10


def _card(s: "F.Column", key: str) -> "F.Column":
    d = _digits(s)
    n = F.length(d)
    inner = F.substring(d, F.lit(2), n - 2)
    size = n - 2
    low, high = F.floor(size / 2).cast("int"), F.ceil(size / 2).cast("int")
    ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
    new = F.concat(F.substring(d, 1, 1), F.lpad(permute(_long(inner), ten(low), ten(high), "card", key).cast("string"), size, F.lit("0")))
    return F.when(_luhn(d) == 0, _fill(s, F.concat(new, ((10 - _luhn(F.concat(new, F.lit("0")))) % 10).cast("string")))).otherwise(s)


def _phone(s: "F.Column", key: str) -> "F.Column":
    d = _digits(s)
    part = lambda k, n: _long(F.substring(d, F.length(d) - (k - 1), F.lit(n)))
    plan = (part(10, 3) - 200) * 8_000_000 + (part(7, 3) - 200) * 10_000 + part(4, 4)
    p = permute(plan, _long(80_000), _long(80_000), "phone", key)
    whole = lambda x, m: ((x - x % m) / m).cast("long")
    american = F.concat(F.substring(d, F.lit(1), F.length(d) - 10), (whole(p, 8_000_000) + 200).cast("string"), (whole(p % 8_000_000, 10_000) + 200).cast("string"), F.lpad((p % 10_000).cast("string"), 4, "0"))
    last = F.lpad(permute(part(6, 6), _long(1000), _long(1000), "line", key).cast("string"), 6, "0")
    other = F.concat(F.substring(d, F.lit(1), F.length(d) - 6), last)
    is_plan = s.rlike(r"^(?:\+?1[ .-]?)?\(?[2-9][0-9]{2}\)?[ .-]?[2-9][0-9]{2}[ .-]?[0-9]{4}$")
    return F.when(is_plan, _fill(s, american)).when(F.length(d).between(7, 15), _fill(s, other)).otherwise(s)


def _ip(s: "F.Column", key: str) -> "F.Column":
    o = F.transform(F.split(s, r"\."), lambda x: x.cast("long"))
    rank = F.aggregate(o, F.lit(0).cast("long"), lambda acc, x: acc * 256 + x)
    p = permute(rank, _long(65536), _long(65536), "ip", key)
    new = F.array_join(F.transform(F.array(*(F.lit(k) for k in (24, 16, 8, 0))), lambda k: F.call_function("shiftright", p, k).bitwiseAND(F.lit(255).cast("long")).cast("string")), ".")
    return F.when(F.forall(o, lambda x: x <= 255), new).otherwise(s)


def _ssn(s: "F.Column", key: str) -> "F.Column":
    o = F.transform(F.split(s, "-"), lambda x: x.cast("long"))
    area, group, serial = (F.get(o, F.lit(k)) for k in range(3))
    good = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    b = _long(99 * 9999)
    p = permute((area - F.when(area > 666, 2).otherwise(1)) * b + (group - 1) * 9999 + serial - 1, _long(898), b, "ssn", key)
    rest = p % b
    new_area = ((p - rest) / b).cast("long") + 1
    new_area = new_area + F.when(new_area >= 666, 1).otherwise(0)
    pad = lambda x, n: F.lpad(x.cast("long").cast("string"), n, "0")
    return F.when(good, F.concat_ws("-", pad(new_area, 3), pad((rest - rest % 9999) / 9999 + 1, 2), pad(rest % 9999 + 1, 4))).otherwise(s)


def _date(s: "F.Column", key: str) -> "F.Column":
    first = F.to_date(F.lit("1900-01-01"))
    out = s
    for shape, form in ((r"^[0-9]{4}-", "yyyy-MM-dd"), (r"^[0-9]{2}/[0-9]{2}/", "dd/MM/yyyy")):
        rank = _long(F.datediff(F.try_to_date(s, form), first))
        new = F.date_format(F.date_add(first, permute(rank, _long(17), _long(4297), "date", key).cast("int")), form)
        out = F.when(s.rlike(shape), F.when(rank.between(0, 73048), new).otherwise(s)).otherwise(out)
    return out


def _email(s: "F.Column", key: str) -> "F.Column":
    at = F.instr(s, "@")
    local, domain = F.substring(s, F.lit(1), at - 1), F.substring(s, at, F.length(s))
    cut = F.floor((F.length(local) + 1) / 2).cast("int")
    classes = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")

    def shifted(half, other, i):
        h = _digest(key, F.lit("mail"), i.cast("string"), F.lower(domain), F.length(half).cast("string"), other)

        def char(c, k):
            by = F.conv(F.substring(h, (k % 30) * 2 + 1, F.lit(4)), 16, 10).cast("int")
            out = c
            for chars in classes:
                place = F.instr(F.lit(chars), c) - 1
                out = F.when(place >= 0, F.substring(F.lit(chars), (place + by) % len(chars) + 1, F.lit(1))).otherwise(out)
            return out

        return F.array_join(F.transform(F.split(half, ""), char), "")

    start = F.struct(F.substring(local, F.lit(1), cut).alias("l"), F.substring(local, cut + 1, F.length(local)).alias("r"))
    step = lambda a, i: F.when(i % 2 == 0, F.struct(shifted(a["l"], a["r"], i).alias("l"), a["r"].alias("r"))).otherwise(F.struct(a["l"].alias("l"), shifted(a["r"], a["l"], i).alias("r")))
    return F.concat(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda a: F.concat(a["l"], a["r"])), domain)


def kind_of(s: "F.Column") -> "F.Column":
    out = F.lit("card")
    for k in reversed(KINDS[:-1]):
        out = F.when(s.rlike(f"^(?:{SHAPES[k]})$"), F.lit(k)).otherwise(out)
    return out


def pseudonym(s: "F.Column", key: str = KEY) -> "F.Column":
    makers = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}
    kind, out = kind_of(s), s
    for k in KINDS:
        out = F.when(kind == k, makers[k](s, key)).otherwise(out)
    return out


def pseudonymised(docs: DataFrame, key: str = KEY, text: str = "text", changes: str = "changes") -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and ``changes``: array<struct<kind, old, new>> of what was replaced."""
    found, pieces, changes = free_name(docs, "found"), free_name(docs, "pieces"), free_name(docs, changes)
    out = docs.withColumn(found, F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1)))
    out = out.withColumn(found, F.transform(found, lambda s: F.struct(kind_of(s).alias("kind"), s.alias("old"), pseudonym(s, key).alias("new"))))
    out = out.withColumn(pieces, F.when(F.size(found) > 0, F.split(text, ANY, -1)))
    joined = F.concat(F.array_join(F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, f: F.concat(p, f["new"])), ""), F.element_at(pieces, -1))
    out = out.withColumn(text, F.when(F.size(found) > 0, joined).otherwise(F.col(text)))
    return out.withColumn(changes, F.filter(found, lambda f: f["old"] != f["new"])).drop(pieces, *([found] if found != changes else []))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pseudonymised(read(spark, sf_dir, "documents").select("doc_id", "text"), spark.conf.get(CONF, KEY))
    count = lambda k: F.coalesce(F.size(F.filter("changes", lambda c: c["kind"] == k)), F.lit(0)).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", "text", *map(count, KINDS))
