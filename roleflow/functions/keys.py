"""Keys under which postings, links and employers meet: exact, normalised, by segment, by body and by requisition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roleflow.functions.naming import let

# Words and forms of titles that do not change which role is meant.
LEVELS = ("senior", "sr", "snr", "junior", "jr", "jnr", "lead", "principal")
ABBREVIATIONS = {
    "ceo": "chief executive officer",
    "cfo": "chief financial officer",
    "coo": "chief operating officer",
    "cto": "chief technology officer",
    "cmo": "chief marketing officer",
    "cpo": "chief product officer",
    "cio": "chief information officer",
    "ciso": "chief information security officer",
    "vp": "vice president",
    "svp": "senior vice president",
    "evp": "executive vice president",
    "hr": "human resources",
    "comms": "communications",
    "ops": "operations",
    "mgr": "manager",
    "exec": "executive",
}
MODE_SUFFIX = r"(?i)(?:\s*\((?:remote|hybrid|on[\s-]?site|onsite|wfh|hq)\b[^)]*\)\s*)+$"
NOISE = (
    r"(?i)\s*\((?:\s*\d[\d\s,]*\s*(?:openings?|positions?|roles?|vacancies|posts?)?\s*|"
    r"[^)]*\b(?:openings?|positions?|vacancies|closed|reopened|re-opened|filled|on hold|urgent|multiple)\b[^)]*)\)"
)
REQUISITION_TAG = r"#\s*[A-Za-z0-9-]*\d[A-Za-z0-9-]*"
MODES = ("remote", "hybrid", "onsite", "on site", "global", "worldwide", "flexible")
REGIONS = (
    "africa", "asia", "americas", "north america", "south america", "latin america", "central america", "europe", "oceania",
    "middle east", "east africa", "west africa", "southern africa", "sub saharan africa", "sub-saharan africa", "south asia",
    "southeast asia", "central asia", "apac", "emea", "mena", "lac",
)
SEGMENT = r"\s*(?:,|\||·|\s[–—-]\s)\s*"
TRACKING = ("ref", "src", "source", "fbclid", "gclid", "mc_cid", "mc_eid", "gh_src")
BODY_LEAST = 1000
SEGMENT_LEAST = 3


def _spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def key16(*parts: Column) -> Column:
    return F.substring(F.md5(F.lower(F.concat_ws("|", *parts))), 1, 16)


def bare_title(title: Column) -> Column:
    return _spaced(F.regexp_replace(F.coalesce(title, F.lit("")), MODE_SUFFIX, ""))


def exact_key(org: Column, title: Column) -> Column:
    return key16(org, bare_title(title))


def sibling_key(key: Column, fingerprint: Column) -> Column:
    """Key of a role that shares employer and title with another but has a body of its own."""
    return F.substring(F.md5(F.concat_ws("|", key, fingerprint)), 1, 16)


def strip_places(title: Column, places: tuple[str, ...] = ()) -> Column:
    """The title without trailing segments that name a place or a work mode; it is never emptied."""
    known = F.array(*[F.lit(x) for x in sorted({*MODES, *REGIONS, *(p.lower() for p in places)})])

    def named(parts: Column) -> Column:
        # The last segment that is none of them ends the title.
        last = F.array_max(F.transform(parts, lambda p, i: F.when(~F.array_contains(known, F.lower(F.trim(p))), i + 1).otherwise(F.lit(1))))
        return F.array_join(F.filter(F.slice(parts, 1, F.greatest(last, F.lit(1))), lambda p: F.trim(p) != ""), ", ")

    return let(F.split(F.coalesce(title, F.lit("")), SEGMENT), named)


def singular(word: Column) -> Column:
    n = F.length(word)
    return (
        F.when((n > 4) & word.endswith("ies"), F.concat(F.substr(word, F.lit(1), n - 3), F.lit("y")))
        .when((n > 4) & word.rlike("(ches|shes|sses|xes|zes)$"), F.substr(word, F.lit(1), n - 2))
        .when((n > 3) & word.endswith("s") & ~word.rlike("(ss|us|is)$"), F.substr(word, F.lit(1), n - 1))
        .otherwise(word)
    )


def _in_full(text: Column) -> Column:
    for short, full in ABBREVIATIONS.items():
        text = F.regexp_replace(text, rf"(?U)\b{short}\b", full)
    return text


def core_title(title: Column) -> Column:
    t = F.lower(bare_title(title))
    t = F.regexp_replace(F.regexp_replace(t, NOISE, " "), REQUISITION_TAG, " ")
    t = let(t, lambda x: F.when(x.rlike(rf"(?U)\b(?:{'|'.join(ABBREVIATIONS)})\b"), _in_full(x)).otherwise(x))
    t = F.regexp_replace(F.replace(t, F.lit("&"), F.lit(" and ")), r"(?U)[^\w\s]|_", " ")
    return _spaced(t)


def strong_title(title: Column, places: tuple[str, ...] = ()) -> Column:
    """The title without place, level, plural and punctuation; a title of level words alone keeps them."""

    def folded(core: Column, bare: Column) -> Column:
        return F.when(bare == "", core).otherwise(F.array_join(F.transform(F.split(bare, " "), singular), " "))

    def bare(core: Column) -> Column:
        return _spaced(F.regexp_replace(core, rf"(?U)\b(?:{'|'.join(LEVELS)})\b", " "))

    return let(core_title(strip_places(title, places)), lambda core: let(bare(core), lambda b: folded(core, b)))


def normalized_key(org: Column, title: Column, places: tuple[str, ...] = ()) -> Column:
    return key16(org, strong_title(title, places))


def segment_keys(org: Column, title: Column, strong: Column | None = None) -> Column:
    """Keys of the segments of three words or more that are not the whole title, each once; ``strong`` is the strong title where it is known."""
    parts = F.split(F.coalesce(title, F.lit("")), SEGMENT)

    def of(full: Column) -> Column:
        kept = F.filter(F.transform(parts, lambda p: strong_title(p)), lambda p: (p != full) & (F.size(F.split(p, " ")) >= SEGMENT_LEAST))
        return F.array_distinct(F.transform(kept, lambda p: key16(org, p)))

    # A title of one segment has none that is not the whole.
    return F.when(F.size(parts) > 1, let(strong_title(title) if strong is None else strong, of)).otherwise(F.array().cast("array<string>"))


def body_text(description: Column) -> Column:
    t = F.regexp_replace(F.coalesce(description, F.lit("")), r"<[^>]+>", " ")
    return _spaced(F.regexp_replace(F.lower(t), r"(?U)[^\w\s]", " "))


def body_fingerprint(description: Column) -> Column:
    """Hash of a normalised description; null where it is too short to stand for a role."""
    return let(body_text(description), lambda t: F.when(F.length(t) >= BODY_LEAST, F.substring(F.md5(t), 1, 16)))


def apply_url(url: Column) -> Column:
    """A link without fragment, tracking parameters and trailing slash, scheme and host in lower case."""
    whole = r"^(?:([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"

    def tail(query: Column) -> Column:
        kept = F.filter(
            F.split(F.regexp_replace(query, r"(?i)utm_[a-z]+=[^&]*", ""), "&"),
            lambda p: (p != "") & ~F.lower(F.element_at(F.split(p, "="), 1)).isin(*TRACKING) & ~F.lower(p).startswith("utm_"),
        )
        return let(F.array_join(kept, "&"), lambda t: F.when(t != "", F.concat(F.lit("?"), t)).otherwise(F.lit("")))

    def joined(part: Column) -> Column:
        site = F.when(part[0] != "", F.concat(F.lower(part[0]), F.lit("://"), F.lower(part[1]))).otherwise(F.lit(""))
        return F.concat(site, F.regexp_replace(part[2], "/+$", ""), F.when(part[3] != "", tail(part[3])).otherwise(F.lit("")))

    return let(F.trim(F.coalesce(url, F.lit(""))), lambda u: let(F.array(*[F.regexp_extract(u, whole, i) for i in range(1, 5)]), joined))


# Where vendors' links carry the id of a requisition, in the order in which they are tried.
REQUISITIONS = (
    ("greenhouse", r"greenhouse\.io/(?:[^/?#]+/)*jobs/(\d+)"),
    ("greenhouse", r"[?&]gh_jid=(\d+)"),
    ("lever", r"lever\.co/[^/?#]+/([0-9a-f-]{36})"),
    ("ashby", r"ashbyhq\.com/[^/?#]+/([0-9a-f-]{36})"),
    ("smartrecruiters", r"smartrecruiters\.com/[^/?#]+/(\d{6,})"),
    ("workable", r"workable\.com/(?:[^/?#]+/)?j/([A-Za-z0-9]+)"),
    ("workday", r"myworkdayjobs\.com/.*_([A-Z]{0,4}-?\d{3,}(?:-\d+)?)"),
    ("uuid", r"([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})"),
)


def requisition_key(url: Column) -> Column:
    """``vendor:id`` by the first pattern that the link holds, else null."""
    found = [(v, F.regexp_extract(F.coalesce(url, F.lit("")), p, 1)) for v, p in REQUISITIONS]
    return F.coalesce(*[F.when(x != "", F.concat(F.lit(f"{v}:"), F.lower(x))) for v, x in found])


# Accented letters with the plain ones they fold to, and words of a name that do not tell employers apart.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿāăąćčďđēėęěğīįıłńňōőřśšşťūůűųźżž"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyyaaaccddeeeegiiilnnoorssstuuuuzzz"
NAME_STOPWORDS = ("the", "of", "and", "for", "a", "an")
NAME_SUFFIXES = ("inc", "llc", "ltd", "limited", "gmbh", "corp", "corporation", "co", "company", "foundation", "plc", "ag", "sa", "bv")


def lookup_name(name: Column) -> Column:
    return F.lower(_spaced(name))


def name_tokens(name: Column) -> Column:
    """Words of an employer's name without accents, punctuation, stopwords, trailing digits and legal forms."""
    t = F.translate(F.lower(F.coalesce(name, F.lit(""))), ACCENTED, PLAIN)
    t = F.regexp_replace(F.replace(t, F.lit("&"), F.lit(" and ")), r"[^a-z0-9]+", " ")
    words = F.filter(F.split(F.trim(t), " "), lambda w: (w != "") & ~w.isin(*NAME_STOPWORDS))
    # Legal forms and numbers count only at the end.
    last = F.array_max(F.transform(words, lambda w, i: F.when(~w.isin(*NAME_SUFFIXES) & ~w.rlike("^[0-9]+$"), i + 1).otherwise(F.lit(1))))
    return F.slice(words, 1, F.coalesce(last, F.lit(1)))


def name_readings(name: Column) -> Column:
    """The names' words with and without what stands in brackets."""
    inner = F.regexp_extract(F.coalesce(name, F.lit("")), r"\(([^)]*)\)", 1)
    outer = F.regexp_replace(F.coalesce(name, F.lit("")), r"\([^)]*\)", " ")
    return F.filter(F.array_distinct(F.array(name_tokens(name), name_tokens(outer), name_tokens(inner))), lambda r: F.size(r) > 0)


def acronym(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda w: F.substring(w, 1, 1)), "")


def triage_key(org: Column, title: Column, places: Column, deadline: Column) -> Column:
    where = F.array_join(F.array_sort(F.transform(F.coalesce(places, F.array().cast("array<string>")), F.lower)), "|")
    return F.concat_ws("::", F.lower(org), F.lower(title), where, F.coalesce(deadline.cast("string"), F.lit("")))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
