"""Text quality as column expressions: page junk, consent banners, blacklists, and a verdict for a description.

All take and return columns, so they stay inside the generated code of a scan; null text behaves as empty text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from roleflow.functions.naming import let

# Phrases and limits that decide what counts as page junk.
COOKIE_BANNER = (
    r"we use cookies|we value your privacy|we care about your privacy|"
    r"this (?:web)?site (?:uses|makes use of) cookies|accept all cookies|"
    r"by clicking [\"“]?accept|cookies (?:and other identifiers|to enhance)"
)
COOKIE_WORD = r"\bcookies?\b|\bconsent\b|\bgdpr\b"
COOKIE_HEAD, COOKIE_GAP, COOKIE_REST = 1500, 700, 500
ERROR_PAGE = (
    r"\b(?:404 not found|page not found|error 404|http error|access denied|forbidden|cannot be displayed|"
    r"the page you (?:are looking for|requested) (?:cannot be found|does not exist|no longer exists)|"
    r"this (?:job|position|vacancy|posting) (?:is no longer|has been|is not) (?:available|filled|open|active)|"
    r"job not found|no longer accepting applications|"
    r"this opportunity (?:is no longer available|has (?:closed|expired)))\b"
)
ERROR_HEAD, ERROR_MOST = 600, 1200
NAVIGATION = (
    r"\b(?:home|about(?: us)?|contact(?: us)?|menu|login|log in|sign in|sign up|register|careers|"
    r"terms of (?:use|service)|skip to (?:main )?content|toggle navigation|subscribe|newsletter|follow us|"
    r"who we are|what we do|our impact|get involved|news cent(?:re|er))\b"
)
NAVIGATION_MOST, NAVIGATION_SHORT, NAVIGATION_LONG = 600, 6, 4
SCRIPT = (
    r"jQuery\s*\(|addEventListener\s*\(|<!\[CDATA\[|document\.(?:getElementById|querySelector|cookie|write)|"
    r"window\.(?:addEventListener|location|onload)|\.classList\.(?:add|remove|toggle|contains)|"
    r"\btypeof\s+\w+\s*[!=]=|function\s*\w*\s*\([^)]*\)\s*\{"
)
SCRIPT_LEAST = 3
MARKETING = (
    "featured insights",
    "from the news desk",
    "latest news",
    "tap to unmute",
    r"\bsubscribers\b",
    r"full story|watch .{0,40}\bstory\b",
    "funding partners",
    "our impact stories",
    "newsletter sign",
    "apply for funding",
    "grants? range (?:between|from)",
    r"we(?:'re| are) funding\b",
)
POSTING = (
    r"responsibilit|qualificat|requirement|you will|we(?:'re| are) looking|what you(?:'ll| will)|the role|reports? to|"
    r"how to apply|application deadline|apply (?:now|here|for this|by|via|online)|minimum .{0,20}years|"
    r"job description|key duties|role purpose"
)
TEST_POSTING = (
    r"\bdo not apply\b|\btest job\b|\btest posting\b|\btest vacancy\b|\bthis is a test\b|"
    r"\bdummy (?:job|posting|vacancy)\b|\bignore this\b|\bplease ignore\b|\bsample (?:job|posting)\b"
)
OFFERING = (
    r"\b(?:program|programme|programs|programmes|course|courses|accelerator|incubator|incubation|bootcamp|boot camp|"
    r"fellowship|fellowships|scholarship|scholarships|grant|grants|funding round|cohort|curriculum|syllabus|summit|"
    r"conference|webinar|workshop|hackathon|directory|talent pool|talent directory|newsletter)\b"
)
ROLE_NOUN = (
    r"\b(?:manager|managers|officer|officers|lead|leader|leads|director|head|chief|president|principal|partner|founder|"
    r"associate|assistant|coordinator|specialist|analyst|adviser|advisor|consultant|engineer|developer|designer|"
    r"architect|scientist|researcher|strategist|writer|editor|producer|recruiter|counsel|controller|administrator|"
    r"executive|supervisor|representative|secretary|treasurer|steward|liaison|ambassador|expert|owner|chargé|chargee|"
    r"responsable|gestionnaire|intern|internship|apprentice|trainee|volunteer|vp|svp|evp|cto|ceo|coo|cfo|cpo|cmo)\b"
)
DESCRIPTION_LEAST = 100

# What a lower-cased text must contain for a pattern above to match: plain searches that spare most texts the pattern.
# Of NAVIGATION also how many different labels a stem gives.
NAVIGATION_STEMS = {
    "home": 1, "about": 2, "contact": 2, "menu": 1, "login": 1, "log in": 1, "sign in": 1, "sign up": 1, "register": 1, "careers": 1, "terms of use": 1, "terms of service": 1, "skip to content": 1,
    "skip to main content": 1, "toggle navigation": 1, "subscribe": 1, "newsletter": 1, "follow us": 1, "who we are": 1, "what we do": 1, "our impact": 1, "get involved": 1, "news cent": 2,
}
SCRIPT_STEMS = ("jquery", "addeventlistener", "<![cdata[", "document.", "window.", ".classlist.", "typeof", "function")
MARKETING_STEMS = ("featured insights", "from the news desk", "latest news", "tap to unmute", "subscribers", "story", "funding partners", "our impact stories", "newsletter sign", "apply for funding", "grant", "funding")
COOKIE_STEMS = ("cookies", "your privacy", "by clicking")


def _filled(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(_filled(text), r"^\s+|\s+$", "")


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(_filled(text), F.lit(f"(?i){pattern}"))


def keyword_pattern(words: Sequence[str]) -> str:
    """One alternation of whole keywords, longest first; a keyword that ends in a word character may have a plural."""
    parts = []
    for word in sorted((w for w in words if w), key=len, reverse=True):
        body = "".join(c if c.isalnum() or c in "_ " else f"\\{c}" for c in word)
        head = r"\b" if word[0].isalnum() or word[0] == "_" else r"(?<!\w)"
        tail = r"(?:es|s)?\b" if word[-1].isalnum() or word[-1] == "_" else r"(?!\w)"
        parts.append(head + body + tail)
    return "(?i)(?:" + "|".join(parts) + ")" if parts else r"(?!x)x"


def blacklist_term(title: Column, words: Sequence[str], stems: Sequence[str] = ()) -> Column:
    """The first stem that the lower-cased title contains, else the keyword it holds, else null."""
    low = F.lower(_filled(title))
    hit = F.nullif(F.regexp_extract(low, keyword_pattern(words), 0), F.lit(""))
    return F.coalesce(*[F.when(low.contains(s), F.lit(s)) for s in stems], hit)


def not_a_vacancy_reason(title: Column, description: Column) -> Column:
    t = _stripped(title)
    offering = t.rlike(f"(?i){OFFERING}") & ~t.rlike(f"(?i){ROLE_NOUN}") & (count_of(description, POSTING) <= 1)
    return (
        F.when(t == "", F.lit(None).cast("string"))
        .when(t.rlike(f"(?i){TEST_POSTING}"), F.lit("test posting, not a real job"))
        .when(offering, F.lit("a program or grant to apply to, not a job"))
    )


def contains_any(text: Column, phrases: Sequence[str]) -> Column:
    low = F.lower(_filled(text))
    out = F.lit(False)
    for p in phrases:
        out = out | low.contains(p)
    return out


def content_junk_reason(text: Column) -> Column:
    head = F.lower(F.substring(_filled(text), 1, 500))
    return (
        F.when(_filled(text) == "", F.lit(None).cast("string"))
        .when(head.contains("recaptcha") & (F.length(text) < 300), "recaptcha_only")
        .when(contains_any(head, ("every.org", "donate to a fund", "make a donation")), "donation_widget")
        .when(contains_any(head, ("404 not found", "page not found", "error 404", "access denied", "cannot be displayed")), "error_page")
        .when(F.length(_stripped(text)) < 50, "navigation_snippet")
    )


def has_enough_content(text: Column, snippet: Column, url: Column, least: int = 50) -> Column:
    return (F.length(_stripped(text)) >= least) | (F.length(_stripped(snippet)) >= least) | (_stripped(url) != "")


def is_unjudgeable_board_text(text: Column, provenance: Column, from_board: Column, least: int = 400) -> Column:
    """Rows of a board that hold only a summary, or less than ``least`` characters."""
    return from_board & ((F.coalesce(provenance, F.lit("")) == "summary") | (F.length(_filled(text)) < least))


def is_error_page(text: Column) -> Column:
    return _short_error(_filled(text), F.length(_stripped(text)))


def _short_error(text: Column, n: Column) -> Column:
    return (n <= ERROR_MOST) & F.substring(text, 1, ERROR_HEAD).rlike(f"(?i){ERROR_PAGE}")


def is_navigation_junk(text: Column) -> Column:
    return let(_stripped(text), lambda t: _navigation(t, F.lower(t)))


def _navigation(t: Column, low: Column) -> Column:
    labels = F.regexp_extract_all(t, F.lit(f"(?i){NAVIGATION}"), F.lit(0))
    possible = sum((F.when(low.contains(s), n).otherwise(0) for s, n in NAVIGATION_STEMS.items()), F.lit(0))
    long = (possible >= NAVIGATION_LONG) & (F.size(F.array_distinct(F.transform(labels, F.lower))) >= NAVIGATION_LONG) & ~t.rlike(f"(?i){POSTING}")
    return F.when(F.length(t) <= NAVIGATION_MOST, F.size(labels) >= NAVIGATION_SHORT).otherwise(long)


def is_script_junk(text: Column) -> Column:
    return let(_filled(text), lambda t: _script(t, F.lower(t)))


def _script(t: Column, low: Column) -> Column:
    return _holds(low, SCRIPT_STEMS) & (count_of(t, SCRIPT) >= SCRIPT_LEAST)


def is_marketing_page(text: Column) -> Column:
    return let(_filled(text), lambda t: _marketing(t, F.lower(t)))


def _marketing(t: Column, low: Column) -> Column:
    signals = sum((F.when(low.contains(s), t.rlike(f"(?i){m}").cast("int")).otherwise(0) for s, m in zip(MARKETING_STEMS, MARKETING, strict=True)), F.lit(0))
    return (signals >= 2) & (count_of(t, POSTING) <= 1)


def _holds(low: Column, stems: Sequence[str]) -> Column:
    out = low.contains(stems[0])
    for s in stems[1:]:
        out = out | low.contains(s)
    return out


def _banner_end(text: Column) -> Column:
    """Where a consent banner at the top ends, in characters; null without one.

    The banner opens within the head of the text, with little before it, and goes on as long as another consent word ends
    within the gap; it ends with the paragraph or else the line if that is near. The words and what stands between them
    give their places, and one fold over these numbers follows the banner, so the work is linear in the text.
    """
    head = F.substring(text, 1, COOKIE_HEAD)
    opening = F.regexp_instr(head, F.lit(f"(?i){COOKIE_BANNER}"))
    before = F.length(_stripped(F.substr(text, F.lit(1), F.greatest(opening - 1, F.lit(0)))))
    first = opening - 1 + F.length(F.regexp_extract(head, f"(?i){COOKIE_BANNER}", 0))
    word = f"(?i){COOKIE_WORD}"
    sizes = F.arrays_zip(
        F.transform(F.split(text, word, -1), F.length).alias("gap"), F.transform(F.regexp_extract_all(text, F.lit(word), F.lit(0)), F.length).alias("word")
    )
    # ``at`` is where the last word looked at ends, ``upto`` where the banner ends so far.
    start = F.struct(F.lit(0).alias("at"), first.alias("upto"), F.lit(True).alias("on"))

    def follow(a: Column, x: Column) -> Column:
        begin, end = a["at"] + x["gap"], a["at"] + x["gap"] + F.coalesce(x["word"], F.lit(0))
        later = x["word"].isNotNull() & (begin >= a["upto"])
        near = later & a["on"] & (end <= a["upto"] + COOKIE_GAP)
        return F.struct(end.alias("at"), F.when(near, end).otherwise(a["upto"]).alias("upto"), (a["on"] & (near | ~later)).alias("on"))

    end = F.aggregate(sizes, start, follow, lambda a: a["upto"])
    return F.when((opening > 0) & (before < COOKIE_REST), let(end, lambda e: _to_break(text, e)))


def _to_break(text: Column, end: Column) -> Column:
    """``end`` moved to the paragraph's end, or else the line's, if that is less than 300 characters away."""
    near = F.substr(text, end + 1, F.lit(301))
    paragraph, line = F.locate("\n\n", near), F.locate("\n", near)
    return F.when((paragraph > 0) & (paragraph <= 300), end + paragraph - 1).when((line > 0) & (line <= 300), end + line - 1).otherwise(end)


def _rest(text: Column, end: Column) -> Column:
    return _stripped(F.substr(text, end + 1, F.length(text)))


def is_cookie_boilerplate(text: Column) -> Column:
    """Whether a consent banner at the top leaves too little after it."""
    return let(_filled(text), lambda t: let(_banner_end(t), lambda end: end.isNotNull() & (F.length(_rest(t, end)) < COOKIE_REST)))


def _without_banner(text: Column, end: Column) -> Column:
    def trailing(tail: Column) -> Column:
        return F.when(tail > 0, F.regexp_replace(F.substr(text, F.lit(1), F.greatest(tail - 1, F.lit(0))), r"\s+$", "")).otherwise(text)

    bannered = let(F.lower(text), lambda low: _holds(low, COOKIE_STEMS))
    return F.when(end.isNotNull(), _rest(text, end)).when(bannered, let(F.regexp_instr(text, F.lit(f"(?i){COOKIE_BANNER}")), trailing)).otherwise(text)


def strip_cookie_boilerplate(text: Column) -> Column:
    """The text without a consent banner at its top, or else at its end."""
    return let(_filled(text), lambda t: let(_banner_end(t), lambda end: _without_banner(t, end)))


def is_boilerplate_junk(text: Column) -> Column:
    return is_cookie_boilerplate(text) | is_error_page(text) | is_navigation_junk(text) | is_script_junk(text) | is_marketing_page(text)


# The entities that are decoded without a parser.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def html_to_text(html: Column) -> Column:
    """Markup to lines of text: scripts and styles go, blocks break lines, list items get a dash."""
    t = F.regexp_replace(_filled(html), r"(?is)<script\b.*?</script\s*>", " ")
    t = F.regexp_replace(t, r"(?is)<style\b.*?</style\s*>", " ")
    t = F.regexp_replace(t, r"(?i)<\s*/?\s*(?:br|p|div|h[1-6]|ul|ol)(?:\s[^>]*)?\s*/?\s*>", "\n")
    t = F.regexp_replace(t, r"(?i)<\s*li\b[^>]*>", "\n- ")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for entity, sign in ENTITIES.items():
        t = F.replace(t, F.lit(entity), F.lit(sign))
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r" ?\n ?", "\n")
    return _stripped(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def html_to_line(html: Column) -> Column:
    return _stripped(F.regexp_replace(html_to_text(html), r"\s+", " "))


def snippet(text: Column, most: int = 400) -> Column:
    """The first ``most`` characters, cut at a word."""
    cut = F.regexp_replace(F.substring(_filled(text), 1, most), r"\s+\S*$", "")
    return F.when(F.length(_filled(text)) <= most, _filled(text)).otherwise(cut)


def clean_description(text: Column) -> Column:
    """Struct ``(text, verdict)``: the usable description, or null and why it was rejected; checks go in a fixed order."""
    tagged = _filled(text).contains("<") & _filled(text).rlike(r"(?i)<\s*/?\s*(?:br|p|div|li|ul|ol|h[1-6]|span|strong|em|b|i)\b[^>]*>")

    def judged(t: Column, low: Column, end: Column, bare: Column) -> Column:
        # ``t`` has no white space at its ends.
        verdict = (
            F.when(t == "", "empty")
            .when(end.isNotNull() & (F.length(bare) < COOKIE_REST), "cookie_wall")
            .when(_short_error(t, F.length(t)), "error_page")
            .when(_navigation(t, low) | _script(t, low), "nav_junk")
            .when(_marketing(t, low), "marketing_page")
            .when(F.length(bare) < DESCRIPTION_LEAST, "too_short")
            .otherwise("ok")
        )
        return let(verdict, lambda v: F.struct(F.when(v == "ok", bare).alias("text"), v.alias("verdict")))

    plain = F.when(tagged, html_to_text(text)).otherwise(_stripped(text))
    return let(plain, lambda t: let(_banner_end(t), lambda end: let(_without_banner(t, end), lambda bare: let(F.lower(t), lambda low: judged(t, low, end, bare)))))


def classify_quality(title: Column, text: Column, words: Sequence[str], stems: Sequence[str] = ()) -> Column:
    return (
        F.when(blacklist_term(title, words, stems).isNotNull(), "wrong_role")
        .when(content_junk_reason(text).isNotNull(), "not_a_job")
        .when(_stripped(text) == "", "no_description")
        .otherwise("ready")
    )


def gate_reason(title: Column, text: Column, snippet_: Column, url: Column, words: Sequence[str], stems: Sequence[str] = ()) -> Column:
    """Why a fetched posting is not stored, in a fixed order; null if it is."""
    junk = clean_description(text)["verdict"].isin("cookie_wall", "error_page", "nav_junk", "marketing_page")
    # A snippet or link alone is enough, and then the text needs no verdict.
    aside = has_enough_content(F.lit(""), snippet_, url)
    judged = let(junk, lambda j: F.when(j, "junk").when(F.length(_stripped(text)) < 50, "thin"))
    return F.when(_stripped(title) == "", "empty_title").when(blacklist_term(title, words, stems).isNotNull(), "blacklist").when(~aside, judged)


def mask_secrets(text: Column) -> Column:
    """Credentials in log lines and links replaced by a mark."""
    t = F.regexp_replace(_filled(text), r"(?i)\b(bearer|token|api[_-]?key|password|secret)(\s*[:=]\s*|\s+)\S+", "$1$2***")
    return F.regexp_replace(t, r"(?i)(://[^/\s:@]+:)[^@\s]+@", "$1***@")


def escape_html(text: Column) -> Column:
    t = _filled(text)
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        t = F.replace(t, F.lit(sign), F.lit(entity))
    return t


def safe_link(url: Column) -> Column:
    """The link if its scheme is allowed, else an empty one."""
    return F.when(_filled(url).rlike(r"(?i)^(https?://|mailto:)"), url).otherwise(F.lit(""))
