"""Secret scans: fixed patterns, and Markov models of random strings and of ordinary identifiers.

Base spans come from three patterns (assignments of passwords and tokens, access keys, long hexadecimal runs). The method
looks at every run of ``[A-Za-z0-9+/_-]`` (with up to two ``=`` behind) of ``LEAST`` characters or more, as far as no base span
covers it, and adds up, over its pairs of neighbouring characters, the log-likelihood ratio of two first-order Markov
models; a run whose mean ratio is above ``CUT`` + ``SHORT`` / length is a secret. The models are trained from labelled samples: random strings (base64, base62 and
hexadecimal of digests, label 1) and identifiers put together from ordinary words (label 0). Training counts
pairs with DataFrame operations; what comes to the driver is the table of ``len(ALPHABET)`` squared ratios.

Only built-in functions run over documents. Places are found without a function that gives them: a text is split at its
matches, and a match starts where the pieces and matches before it end. All places are code points, end exclusive.

Null and empty texts have no spans. Overlapping matches of one kind can't occur; spans of different kinds may overlap and
are all reported; model spans are the parts of a run that no base span covers. Repeated rows are scanned each, and an empty
table gives no rows. A caller's columns stay; ``prefix`` keeps the new ones apart.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, read

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
LEAST, CUT, SHORT, SAMPLES, STRETCH = 16, 0.25, 6.0, 4000, 128

#: kind -> pattern, least length, group whose length counts; in the order that the contract lists kinds.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?"""
VALUE = r"[A-Za-z0-9+/_.=-]+"
BASE = {"assign": ASSIGN + VALUE, "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
MODEL = rf"[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}"

WORDS = (
    "account action active address agent alert archive array async batch binary block buffer build button cache call cancel channel check class "
    "client close code color column commit config connect content context control copy count create current cursor data date default delete "
    "detail device dialog display document domain download driver element email enable entry error event export factory failure feature field file "
    "filter folder format function gateway global group handler header height history host image import index input instance internal item "
    "job key label language layout length level library limit line link list load local location lock logger login main manager map master "
    "matrix member memory menu message method metric mode model module monitor name network next node notify number object offset open option "
    "order output owner page panel parent parser path payment pending person phone picture pixel plugin point policy pool port position prefix "
    "process product profile project property provider proxy public query queue random range rate reader record region register remote report "
    "request reset resource response result return role root route row rule sample scale schedule schema scope screen script search section select "
    "sender sequence server service session setting shape shared simple size socket sort source stack start state status storage stream string "
    "style submit summary support switch symbol system table target task template test text theme thread time title token tool total trace "
    "transfer tree trigger type update upload user utility value vector version video view visible widget width window worker writer zone"
).split()


def samples(spark: SparkSession, n: int = SAMPLES, seed: str = "train") -> DataFrame:
    """(s, label): n random strings and n identifiers (some are numbers, or one repeated character as in rules), from digests of a counter."""
    h = lambda k: F.sha2(F.concat(F.lit(f"{seed}:{k}:"), F.col("id").cast("string")), 256)
    digest = F.unhex(h("r"))
    b64 = F.base64(digest)
    random = F.when(F.col("id") % 3 == 0, F.regexp_replace(b64, "=+$", "")).when(F.col("id") % 3 == 1, F.substring(F.regexp_replace(b64, "[+/=]", ""), 1, 32)).otherwise(F.substring(h("x"), 1, 40))
    word = lambda k: F.element_at(F.array(*map(F.lit, WORDS)), (F.conv(F.substring(h("w"), 4 * k + 1, 4), 16, 10).cast("int") % len(WORDS) + 1).cast("int"))
    w = [word(k) for k in range(4)]
    number = (F.conv(F.substring(h("n"), 1, 3), 16, 10).cast("int") % 100).cast("string")
    style, number = F.col("id") % 7, F.when(F.col("id") % 4 < 2, number).otherwise(F.lit(""))
    snake, camel = F.concat_ws("_", *w[:3]), F.concat(w[0], *map(F.initcap, w[1:4]))
    name = (
        F.when(style == 0, F.concat_ws("_", snake, number)).when(style == 1, F.concat(camel, number)).when(style == 2, F.concat_ws("-", *w, number))
        .when(style == 3, F.concat(F.upper(snake), F.lit("_"), number)).when(style == 4, F.concat_ws("/", w[0], w[1], F.concat(w[2], number), w[3])).when(style == 5, F.translate(F.substring(h("d"), 1, 18), "abcdef", "012345"))
        .otherwise(F.repeat(F.substring(F.lit(ALPHABET), (F.col("id") / 7 % len(ALPHABET)).cast("int") + 1, 1), F.lit(16)))
    )
    ids = spark.range(n)
    return ids.select(random.alias("s"), F.lit(1).alias("label")).union(ids.select(name.alias("s"), F.lit(0).alias("label")))


def train(labelled: DataFrame) -> list[float]:
    """Log ratios of pair probabilities, by 67 * first + second character of ``ALPHABET``; add-one smoothing."""
    size = len(ALPHABET)
    place = lambda i: F.instr(F.lit(ALPHABET), F.substring(F.col("s"), i, F.lit(1))) - 1
    pairs = labelled.where("length(s) > 1").select("label", "s", F.explode(F.sequence(F.lit(1), F.length("s") - 1)).alias("i"))
    pairs = pairs.select("label", place(F.col("i")).alias("a"), place(F.col("i") + 1).alias("b")).where("a >= 0 and b >= 0")
    counts = [[[1] * size for _ in range(size)] for _ in (0, 1)]
    for r in pairs.groupBy("label", "a", "b").count().collect():  # 2 * 67 * 67 rows at most
        counts[r["label"]][r["a"]][r["b"]] += r["count"]
    return [math.log(counts[1][a][b] / sum(counts[1][a])) - math.log(counts[0][a][b] / sum(counts[0][a])) for a in range(size) for b in range(size)]


@functools.cache
def _trained(n: int, seed: str) -> tuple[float, ...]:
    return tuple(train(samples(SparkSession.active(), n, seed)))


def mean_ratio(s: "F.Column", table: list[float]) -> "F.Column":
    """The mean log-likelihood ratio of the pairs of a string of two or more characters of ``ALPHABET``."""
    size, ratios = len(ALPHABET), F.lit(list(table))
    codes = F.transform(F.split(s, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    both = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: F.when((a > 0) & (b > 0), F.element_at(ratios, (a - 1) * size + b)).otherwise(F.lit(0.0)))
    return F.aggregate(both, F.lit(0.0), lambda acc, x: acc + x) / (F.length(s) - 1)


SPANS = "array<struct<start:bigint,end:bigint,s:string>>"


def matches(text: "F.Column", pattern: str) -> "F.Column":
    """array<struct<start, end, s>> of the leftmost non-overlapping matches of ``pattern``, which never matches ''.

    Places are summed up over the pieces and matches before, within stretches of ``STRETCH`` matches and then over these, so
    that a text of many matches takes time in proportion."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    pieces = F.split(text, pattern, -1)
    both = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.struct(F.length(p).cast("long").alias("p"), m.alias("m")))

    def step(acc, x):
        begin = acc["at"] + x["p"]
        end = begin + F.length(x["m"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(begin.alias("start"), end.alias("end"), x["m"].alias("s"))).alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPANS).alias("out"))
    starts = F.sequence(F.lit(1), F.greatest(F.size(both), F.lit(1)), F.lit(STRETCH))
    stretches = F.transform(starts, lambda i: F.aggregate(F.slice(both, i, F.lit(STRETCH)), zero, step))
    shift = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    shifts = F.aggregate(stretches, shift, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])
    moved = F.zip_with(stretches, shifts, lambda x, at: F.transform(x["out"], lambda y: F.struct((y["start"] + at).alias("start"), (y["end"] + at).alias("end"), y["s"].alias("s"))))
    return F.when(text.rlike(pattern), F.flatten(moved)).otherwise(F.array().cast(SPANS))


def secret(s: "F.Column", table: list[float]) -> "F.Column":
    """Whether a string of ``LEAST`` characters or more is a secret: a short one needs a higher mean ratio."""
    return mean_ratio(s, table) > F.lit(CUT) + F.lit(SHORT) / F.length(s)


def _outside(run: "F.Column", spans: "F.Column") -> "F.Column":
    """The parts of ``run`` that no span covers. After the i-th end of the spans nothing is open if it isn't behind the start that follows."""
    near = F.filter(spans, lambda y: (y["start"] < run["end"]) & (run["start"] < y["end"]))
    starts = F.concat(F.array_sort(F.transform(near, lambda y: F.greatest(y["start"], run["start"]))), F.array(run["end"]))
    ends = F.concat(F.array(run["start"]), F.array_sort(F.transform(near, lambda y: F.least(y["end"], run["end"]))))
    parts = F.filter(F.zip_with(ends, starts, lambda a, b: F.struct(a.alias("start"), b.alias("end"))), lambda p: p["end"] - p["start"] >= LEAST)
    cut = lambda p: F.substring(run["s"], (p["start"] - run["start"] + 1).cast("int"), (p["end"] - p["start"]).cast("int"))
    return F.transform(parts, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), cut(p).alias("s")))


def scan(docs: DataFrame, table: list[float] | None = None, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with ``assign``, ``access``, ``hex``, ``model`` (behind ``prefix``, for callers who have such columns): arrays of
    spans (start, end, s). ``table``: what ``train`` gives; else that of ``samples``."""
    table = list(table or _trained(SAMPLES, "train"))
    name = {k: f"{prefix}{k}" for k in KINDS}
    t = F.coalesce(F.col(text), F.lit(""))
    long = lambda x: F.length(F.regexp_extract(x["s"], f"^(?:{ASSIGN})({VALUE})$", 1)) >= 6
    runs = free_name(docs, "runs_")
    out = docs.withColumns({name["assign"]: F.filter(matches(t, BASE["assign"]), long), name["access"]: matches(t, BASE["access"]), name["hex"]: matches(t, BASE["hex"]), runs: matches(t, MODEL)})
    base = F.concat(*(name[k] for k in KINDS[:3]))
    parts = F.flatten(F.transform(runs, lambda x: _outside(x, base)))
    return out.withColumn(name["model"], F.when(F.size(runs) == 0, F.array().cast(SPANS)).otherwise(F.filter(parts, lambda x: secret(x["s"], table)))).drop(runs)


KINDS = ("assign", "access", "hex", "model")


def listed(*kinds: str) -> "F.Column":
    """kind:start:end of all spans by start, then kind as listed, comma-joined."""

    def tagged(kind: str) -> "F.Column":
        return F.transform(kind, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("i"), x["end"].alias("end"), F.lit(kind).alias("kind")))

    rows = F.array_sort(F.concat(*map(tagged, kinds)))
    return F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda k: F.size(k).cast("long")
    return rows.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(listed(*KINDS[:3]), 256).alias("base_sha256"), listed(*KINDS).alias("spans"))
