"""Line and string operators as column expressions. Patterns carry ``(?U)`` so that classes and ``\\b`` follow Unicode."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicon as lex

BREAKS = r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"
#: White space by Unicode and the separators that text files know, spelled out: looked up faster than a property.
WHITE = r"[\t-\r\x1c- \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SPACES = WHITE + "+"
MARKER = "[BLOCK: "
#: Texts with markdown, blocks, or white space besides spaces and line feeds are normalised line by line, others as a whole.
UNPLAIN = r"\*\*|# |\[BLOCK: |[\t\u000b-\r\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Grave, acute, tilde, hook above, dot below; circumflex, breve, horn.
MARKS = "\u0300\u0301\u0303\u0309\u0323\u0302\u0306\u031b"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_of(a: Column, f: Callable[..., Column], kind: str = "string") -> Column:
    """The first of ``f(element)`` or ``f(element, place)`` that isn't null; elements behind it aren't looked at."""
    none = F.lit(None).cast(kind)
    if f.__code__.co_argcount == 1:
        return F.aggregate(a, none, lambda acc, x: F.when(acc.isNotNull(), acc).otherwise(f(x)))
    placed = F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.aggregate(placed, none, lambda acc, p: F.when(acc.isNotNull(), acc).otherwise(f(p["x"], p["i"])))


def staged(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with further columns that the optimizer computes once, here: they come out of a generator, so that a filter on
    them isn't pushed below it in the form of their expressions, nor these copied into what is built on them."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def split_lines(text: Column) -> Column:
    """TX-1."""
    return F.split(text, BREAKS)


def collapse(s: Column) -> Column:
    """White space runs to one space, none at the ends (TX-3)."""
    return F.trim(F.regexp_replace(s, SPACES, " "))


def strip(s: Column) -> Column:
    return F.regexp_replace(s, f"^{WHITE}+|{WHITE}+$", "")


def words(s: Column) -> Column:
    """Words between white space; none for blank text."""
    return F.filter(F.split(collapse(s), " "), lambda w: w != "")


def dashes(s: Column) -> Column:
    return F.translate(s, "–—", "--")


def corrected(s: Column) -> Column:
    """Dictionary corrections in order, also inside words (TX-4), then the two whole words in any case (TX-5)."""
    s = reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), lex.CORRECTIONS.items(), s)
    whole = lambda x: F.regexp_replace(F.regexp_replace(x, r"(?iuU)\bNgay\b", "Ngày"), r"(?iuU)\bthang\b", "tháng")
    return let(s, lambda x: F.when(let(F.lower(x), lambda low: contains_any(low, ("ngay", "thang"))), whole(x)).otherwise(x))


def is_noise(s: Column) -> Column:
    """TX-6."""
    return let(F.lower(s), lambda low: _may_be_noise(low) & _is_noise(low))


def _may_be_noise(low: Column) -> Column:
    return contains_any(low, ("trang", "page", "admin", "logo", "watermark", "scanned"))


def _is_noise(low: Column) -> Column:
    return low.rlike(r"(?U)\b(admin|scanned by|watermark|logo)\b") | low.rlike(r"(?U)\b(page|trang)\b\s*\d+")


def unmarked(s: Column) -> Column:
    """struct(s, bold, heading): a line without its markdown (TX-2)."""
    heading = s.startswith("# ")
    body = F.when(heading, strip(F.substring(s, F.lit(3), F.length(s)))).otherwise(s)

    def bold(b: Column) -> Column:
        framed, inner = b.startswith("**") & b.endswith("**"), b.contains("**")
        cut = F.when(framed, strip(F.substring(b, F.lit(3), F.greatest(F.length(b) - 4, F.lit(0))))).when(inner, strip(F.replace(b, F.lit("**"), F.lit("")))).otherwise(b)
        return F.struct(cut.alias("s"), (framed | inner).alias("bold"), heading.alias("heading"))

    return let(body, bold)


def normal_line(s: Column) -> Column:
    """TX-7 for one line without markdown: '' where the line is noise."""
    return let(corrected(F.regexp_replace(dashes(s), SPACES, " ")), lambda x: F.when(is_noise(x), F.lit("")).otherwise(F.trim(x)))


def _plain_lines(text: Column) -> Column:
    """array<string> of what normal lines are in a text without ``UNPLAIN`` characters: replacements of a line don't see its neighbours."""
    spaced = let(dashes(text), lambda x: F.when(x.contains("  "), F.regexp_replace(x, " +", " ")).otherwise(x))

    def lines(x: Column) -> Column:
        each = F.transform(F.split(x, "\n"), lambda l: F.trim(l))  # noqa: PLW0108
        return F.when(_may_be_noise(F.lower(x)), F.filter(each, lambda l: (l != "") & ~is_noise(l))).otherwise(F.filter(each, lambda l: l != ""))

    return let(corrected(spaced), lines)


def normal_texts(text: Column) -> Column:
    """array<string>: ``s`` of ``normal_lines``."""
    return let(F.coalesce(text, F.lit("")), lambda t: F.when(t.rlike(UNPLAIN), F.transform(_marked_lines(t), lambda x: x["s"])).otherwise(_plain_lines(t)))


def normal_lines(text: Column) -> Column:
    """array<struct(s, bold, heading)> of the lines that survive (TX-7); block markers pass as they are."""
    none = F.lit(False)
    plain = lambda t: F.transform(_plain_lines(t), lambda s: F.struct(s.alias("s"), none.alias("bold"), none.alias("heading")))
    return let(F.coalesce(text, F.lit("")), lambda t: F.when(t.rlike(UNPLAIN), _marked_lines(t)).otherwise(plain(t)))


def _marked_lines(text: Column) -> Column:
    marker = lambda l: F.struct(l.alias("s"), F.lit(False).alias("bold"), F.lit(False).alias("heading"))
    line = lambda l: let(unmarked(l), lambda u: F.struct(normal_line(u["s"]).alias("s"), u["bold"].alias("bold"), u["heading"].alias("heading")))
    each = F.transform(split_lines(text), lambda l: F.when(l.startswith(MARKER), marker(l)).otherwise(line(l)))
    return F.filter(each, lambda x: x["s"] != "")


def two_of(s: Column, patterns: tuple[str, str, str]) -> Column:
    """At least two of three match; the third is only looked for after one of the others."""
    a, b, c = (s.rlike(f"(?U){p}") for p in patterns)
    return F.when(a, b | c).otherwise(b & c)


def is_motto(s: Column) -> Column:
    """TX-8."""
    return let(F.upper(s), lambda up: contains_any(up, lex.MOTTOES) | two_of(up, lex.MOTTO_STATE) | two_of(up, lex.MOTTO_AIMS))


def contains_any(s: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [s.contains(p) for p in parts])


def starts_any(s: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [s.startswith(p) for p in parts])


def has_letter(s: Column) -> Column:
    return s.rlike(r"\p{L}")


def all_caps(s: Column) -> Column:
    """TX-9: has letters, and each equals its upper case."""
    return let(F.regexp_replace(s, r"[^\p{L}]", ""), lambda x: (x != "") & (F.upper(x) == x))


def all_upper(s: Column) -> Column:
    """TX-9: has letters, and all are upper-case letters."""
    return has_letter(s) & ~s.rlike(r"[\p{L}&&[^\p{Lu}]]")


def caps_line(s: Column) -> Column:
    """TX-9: equals its upper case and has a letter."""
    return (F.upper(s) == s) & has_letter(s)


def is_upper(s: Column) -> Column:
    """Some cased letter, and none of lower case."""
    return s.rlike(r"\p{Lu}") & ~s.rlike(r"[\p{Ll}\p{Lt}]")


def title_case(s: Column) -> Column:
    """TX-10."""
    return F.forall(words(s), lambda w: ~w.rlike(r"^\p{L}") | w.rlike(r"^\p{Lu}"))


def proper_name(s: Column) -> Column:
    """TX-11."""
    good = lambda w: w.rlike(r"^\p{Lu}") & ~F.substring(w, F.lit(2), F.length(w)).rlike(r"[\p{L}&&[^\p{Ll}]]") & ~w.rlike(r"(?U)\d")
    return let(words(s), lambda w: F.size(w).between(2, 6) & F.forall(w, good))


def capitalized(s: Column) -> Column:
    return F.array_join(F.transform(words(s), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))), " ")


def merged(parts: Column) -> Column:
    """TX-12: lines put together, a hyphen at the end of one gone."""
    glue = lambda acc, x: F.when(x == "", acc).when(acc.isNull(), x).when(acc.endswith("-"), F.concat(F.substring(acc, F.lit(1), F.length(acc) - 1), x)).otherwise(F.concat(acc, F.lit(" "), x))
    return collapse(F.coalesce(F.aggregate(F.transform(parts, strip), F.lit(None).cast("string"), glue), F.lit("")))


EDGE = " -–—:;,.\"“”’'"


def sentence_case(text: Column) -> Column:
    """TX-13."""
    return let(text, _sentence_case)


def _sentence_case(text: Column) -> Column:
    edge = "[" + "".join("\\" + c if c in "-\"'." else c for c in EDGE) + "]+"
    bare = F.regexp_replace(collapse(text), f"^{edge}|{edge}$", "")
    low = let(F.lower(bare), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x))))
    names = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)\b([A-ZĐ]{2,4})\b"), F.lit(1)))
    return strip(F.aggregate(names, low, lambda acc, a: F.regexp_replace(acc, F.concat(F.lit(r"(?U)\b"), F.lower(a), F.lit(r"\b")), a)))


def header_block(lines: Column, most: int = 4) -> Column:
    """TX-14: the all-caps lines at the beginning."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("stop"))
    step = lambda a, l: F.when(a["stop"] | ~all_caps(l), F.struct(a["out"].alias("out"), F.lit(True).alias("stop"))).otherwise(F.struct(F.array_append(a["out"], strip(l)).alias("out"), F.lit(False).alias("stop")))
    return F.aggregate(F.slice(lines, 1, most), start, step, lambda a: a["out"])


def is_issuer_line(line: Column) -> Column:
    """TX-15."""
    test = lambda s: all_caps(s) & ~is_motto(s) & ~s.rlike(r"(?U)^\d") & ~contains_any(F.upper(s), lex.ISSUER_DATES) & ~s.rlike(r"(?U)\d+/\d") & ~contains_any(F.upper(s), lex.ISSUER_TYPES)
    return let(strip(line), test)


def is_dense(text: Column, least: float = 0.05) -> Column:
    """TX-16: 50 characters besides white space, and enough of them letters or digits."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, "")
    return let(bare, lambda b: (F.length(b) >= 50) & (F.length(F.regexp_replace(b, r"[^\p{L}\p{N}]", "")) / F.length(b) >= least))


def abbreviation(s: Column) -> Column:
    """TX-17."""
    return F.upper(F.regexp_replace(F.translate(F.coalesce(s, F.lit("")), "Đđ", "Dd"), r"[^\p{L}]", ""))


def markdown(line: Column, bold: Column, upper: Column) -> Column:
    """TX-19: a line tagged by the style sets it is in."""

    def tag(s: Column) -> Column:
        b, u = F.coalesce(F.array_contains(bold, s), F.lit(False)), F.coalesce(F.array_contains(upper, s), F.lit(False))
        return F.when(b & u, F.concat(F.lit("# **"), line, F.lit("**"))).when(b, F.concat(F.lit("**"), line, F.lit("**"))).when(u & (F.length(line) < 100), F.concat(F.lit("# "), line)).otherwise(line)

    return let(collapse(line), tag)


def hyperlink(path: Column) -> Column:
    """TX-22."""
    return F.concat(F.lit('=HYPERLINK("'), path, F.lit('", "Xem")'))


def parent_folder(path: Column) -> Column:
    """TX-23: the name of the folder a file lies in, '' at the top."""
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit(""))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def truthy(*columns: Column) -> Column:
    """The first that is neither null nor '' (RO-17)."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def _compositions() -> list[str]:
    """Letter, mark and the one letter that both make, for all letters of Vietnamese; letters with one mark first."""
    out, letters = [], "aeiouyAEIOUY"
    for _ in range(2):
        made = [(x + m, unicodedata.normalize("NFC", x + m)) for x in letters for m in MARKS]
        made = [(x, y) for x, y in made if len(y) == 1]
        out += [x + y for x, y in made]
        letters = [y for _, y in made]
    return out


def composed(s: Column) -> Column:
    """TX-18 for Vietnamese letters, without Python: marks that stand behind their letter become one with it."""

    def step(x: Column, made: list[str]) -> Column:
        """Only the pairs that are there are replaced; those of one step don't meet."""
        whole = F.create_map(*(F.lit(v) for p in made for v in (p[:2], p[2])))
        there = F.array_distinct(F.regexp_extract_all(x, F.lit("[" + "".join({p[0] for p in made}) + f"][{MARKS}]"), F.lit(0)))
        return F.aggregate(there, x, lambda acc, p: F.coalesce(F.replace(acc, p, F.try_element_at(whole, p)), acc))

    first = [p for p in _compositions() if p[0].isascii()]
    second = [p for p in _compositions() if not p[0].isascii()]
    twice = lambda x: let(step(x, first), lambda y: F.when(y.rlike(f"[{MARKS}]"), step(y, second)).otherwise(y))
    return let(s, lambda x: F.when(x.rlike(f"[{MARKS}]"), twice(x)).otherwise(x))


def nfc(s: Column) -> Column:
    """TX-18: canonical composition. Spark has no function for it; best done once, where texts come in."""

    @F.pandas_udf("string")
    def composed(x: pd.Series) -> pd.Series:
        return x.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")

    return composed(s)
