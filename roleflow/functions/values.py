"""Dates, scores and pay as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_CUE = r"(?i)(?:deadline|apply by|closing date|closes on|applications? close)\s*:?\s*(?:is\s+|on\s+)?"
# Forms of dates, in the order in which they are tried.
DATE_FORMS = (
    (r"\d{4}-\d{2}-\d{2}", "yyyy-MM-dd"),
    (r"\d{1,2} [A-Za-z]{3,9} \d{4}", "d MMMM yyyy"),
    (r"\d{1,2} [A-Za-z]{3} \d{4}", "d MMM yyyy"),
    (r"[A-Za-z]{3,9} \d{1,2}, \d{4}", "MMMM d, yyyy"),
    (r"[A-Za-z]{3} \d{1,2}, \d{4}", "MMM d, yyyy"),
    (r"\d{2}/\d{2}/\d{4}", "dd/MM/yyyy"),
)


def strict_date(text: Column) -> Column:
    """The date of an ISO text; anything else, impossible days too, is null."""
    t = F.trim(text)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd"))


def deadline_of(text: Column) -> Column:
    """The date after a deadline cue, in the first form that parses."""
    found = [F.try_to_date(F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), f"{DATE_CUE}({p})", 1), F.lit("")), f) for p, f in DATE_FORMS]
    return F.coalesce(*found)


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def days_since(ts: Column, as_of: Column) -> Column:
    """Whole days between two instants."""
    return F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(ts)) / 86400).cast("long")


def score_of(value: Column, penalty: Column | None = None) -> Column:
    """An integer of 0 to 100, less a penalty down to 0; null for anything else."""
    n = value.cast("string").try_cast("int")
    kept = F.when(n.between(0, 100), n)
    return kept if penalty is None else F.when(kept.isNotNull(), F.greatest(F.lit(0), kept - F.coalesce(penalty, F.lit(0))))


def is_past(deadline: Column, as_of: Column) -> Column:
    """Whether the day has gone by; the day itself is still open."""
    return F.coalesce(deadline < as_of, F.lit(False))


def relative_day(day: Column, as_of: Column) -> Column:
    n = F.datediff(day, as_of)
    return F.when(n == 0, "today").when(n == 1, "tomorrow").when(n == -1, "yesterday").when(n > 0, F.format_string("in %d days", n)).when(n < 0, F.format_string("%d days ago", -n))


PAY_CUE = r"(?i)(?:salary|compensation|pay(?: range)?|remuneration|stipend)"
AMOUNT = r"(?:[$€£]|usd|eur|gbp|chf)\s?(\d{1,3}(?:[,.]\d{3})+|\d{4,7}|\d{1,3}(?:\.\d)?k)"


def pay(text: Column) -> Column:
    """Struct ``(low, high, text)`` of monthly pay: the first figures near a pay cue that are plausible; above 20,000 they are yearly."""
    t = F.coalesce(text, F.lit(""))
    near = F.regexp_extract_all(t, F.lit(rf"{PAY_CUE}[\s\S]{{0,350}}"), F.lit(0))
    near = F.filter(near, lambda x: ~x.rlike(r"(?i)\b(?:budget|portfolio|revenue|fund(?:ing)? of|grants? of)\b"))
    first = F.try_element_at(F.filter(near, lambda x: x.rlike(rf"(?i){AMOUNT}")), F.lit(1))
    figures = F.regexp_extract_all(F.coalesce(first, F.lit("")), F.lit(rf"(?i){AMOUNT}"), F.lit(1))

    def number(x: Column) -> Column:
        thousand = F.lower(x).endswith("k")
        plain = F.regexp_replace(F.lower(x), "k$", "")
        n = F.when(thousand, plain.cast("double") * 1000).otherwise(F.regexp_replace(plain, "[,.]", "").cast("double"))
        return F.when(n > 20000, F.round(n / 12, 0)).otherwise(n)

    numbers = F.filter(F.transform(F.slice(figures, 1, 2), number), lambda n: n >= 300)
    low, high = F.array_min(numbers), F.array_max(numbers)
    return F.struct(low.alias("low"), high.alias("high"), F.when(low.isNotNull(), F.concat_ws("–", F.format_number(low, 0), F.when(high > low, F.format_number(high, 0)))).alias("text"))


# Forms of pay in the order in which they are tried, and the fewest that a yearly figure comes to.
MONEY = r"[€$£][\d,]+(?:\.\d+)?"
PAY_FORMS = (
    rf"[Cc]ompensation[:\s]+({MONEY})\s*[-–]\s*([€$£]?[\d,]+(?:\.\d+)?)",
    rf"OTE[^:]*:\s*({MONEY})\s*[-–]\s*([€$£]?[\d,]+(?:\.\d+)?)",
    rf"(?i)(?:base pay|salary|pay)\s+range[^€$£]*({MONEY})\s*[-–]\s*([€$£]?[\d,]+(?:\.\d+)?)",
)
PAY_DINARS = r"[Cc]ompensation[:\s]+([\d,]+(?:\.\d+)?)\s*[-–]\s*([\d,]+(?:\.\d+)?)\s*(Serbian dinars|GEL|dinars)"
PAY_GEL = r"(GEL)([\d,]+)\s*[-–]\s*(?:GEL)?([\d,]+)"
PAY_SINGLE = rf"(?:[Ss]alary|[Cc]ompensation)[:\s]+({MONEY})"
YEARLY = 20000


def monthly_pay(text: Column) -> Column:
    """Pay as a text a month by the first form that fits, else empty; above YEARLY the figures are a year's."""
    t = F.coalesce(text, F.lit(""))
    number = lambda c: F.regexp_replace(c, "[€$£,]", "").try_cast("double")
    shown = lambda c: F.format_number(c, 0)

    def monthly(low: Column, high: Column | None) -> Column:
        sign, a = F.regexp_extract(low, "[€$£]", 0), number(low)
        year = F.when(a > YEARLY, 12.0).otherwise(1.0)
        head = F.concat(sign, shown(a / year))
        return F.concat(head, F.lit("/mo")) if high is None else F.concat(head, F.lit("-"), sign, shown(number(high) / year), F.lit("/mo"))

    part = lambda p, i: F.regexp_extract(t, p, i)
    out = F.when(F.lit(False), "")
    for form in PAY_FORMS:
        out = out.when(t.rlike(form), monthly(part(form, 1), part(form, 2)))
    coin = F.when(part(PAY_DINARS, 3).contains("GEL"), "GEL").otherwise("RSD")
    out = out.when(t.rlike(PAY_DINARS), F.concat(coin, F.lit(" "), shown(number(part(PAY_DINARS, 1))), F.lit("-"), shown(number(part(PAY_DINARS, 2))), F.lit("/mo")))
    out = out.when(t.rlike(PAY_GEL), F.concat(F.lit("GEL "), shown(number(part(PAY_GEL, 2))), F.lit("-"), shown(number(part(PAY_GEL, 3))), F.lit("/mo")))
    out = out.when(t.rlike(PAY_SINGLE), monthly(part(PAY_SINGLE, 1), None))
    return F.coalesce(out, F.lit(""))


def summary(given: Column, description: Column, snippet: Column, most: int = 300, fallback: int = 200) -> Column:
    """What a digest shows of a posting: its own summary, else the head of its text on one line, cut at a word."""
    cut = lambda c, n: F.when(F.length(c) <= n, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, n), " [^ ]*$", ""), F.lit("…")))
    body = F.coalesce(F.nullif(description, F.lit("")), snippet, F.lit(""))
    line = F.trim(F.regexp_replace(body, r"\s+", " "))
    return F.when(F.length(given) > 0, cut(F.trim(given), most)).otherwise(cut(line, fallback))
