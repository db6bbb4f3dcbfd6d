"""What a scraped listing is: pages and titles that are no postings, employers named in a listing, links that lead to boards and postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roleflow.functions import text as T

# Parts of links and texts that tell a posting from the rest of a site.
NON_JOB_PATH = r"/(?:about|team|contact|privacy|terms|faq|donate|press|media|board)(?:/|$)"
NON_JOB_FRAGMENT = r"#(?:partners|advisory-board|board|team|staff|leadership|about|contact|donate|footer|header|nav|menu|main)"
PEOPLE_PATH = r"/(?:about|team|people|leadership|staff|our-people|who-we-are|meet-the-team|management)(?:/|$)"
CAREERS_PATH = r"/(?:careers?|jobs?|vacancies|vacancy|positions?|opportunities|join(?:-us)?|work-with-us|work-for-us)(?:/|$)"
CAREERS_HEADING = r"(?im)^#{1,6}\s+(?:careers?|vacanc(?:y|ies)|jobs|open positions|current openings)\b"
JOINED = r"\b(?:[A-Z][a-z]+\s+){1,3}joined\s+\w+\s+in\s+\d{4}\b"
OPENERS = r"^(?:The|This|Our|Each|Every|All|As|At|In|On)\b"
HOLDER = r"^[A-Z][a-z]+(?:\s+[A-Z][a-z.'-]+){1,3}\s+is\s+(?:the|an?|our)\s+[A-Z][a-z]+"
CAREER = r"\b(?:[A-Z][a-z]+|she|he|they)\s+ha(?:s|ve)\s+(?:worked|led|joined|served|held|spent|overseen|managed|founded)\b"
JOB_WORDS = (
    "manager", "director", "head", "lead", "officer", "coordinator", "analyst", "associate", "specialist", "engineer", "developer", "designer",
    "advisor", "consultant", "researcher", "assistant", "vice president", "vp", "chief", "senior", "junior", "intern", "partner", "recruiter",
    "administrator", "strategist", "program", "programme", "project", "product", "operations",
)
NOT_TITLES = (
    "about us", "our team", "benefits", "culture", "values", "how to apply", "submit", "sign up", "log in", "cookie", "privacy", "terms", "home", "menu",
    "search", "filter", "all jobs", "all positions", "clear", "reset", "partners", "advisory board", "our leadership", "our people", "partner with us",
    "read more about", "recent posts", "get funding", "donate to", "our funds back", "product tours", "product tagging", "enroll now", "talent directory",
    "general applications",
)
PICTURES = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2190}-\x{21FF}\x{2300}-\x{23FF}\x{2B00}-\x{2BFF}\x{FE00}-\x{FE0F}]"
ORG_IN_TITLE = r"\bat\s+([A-Z][A-Za-z0-9 &.,\-]+)"
ORG_IN_SNIPPET = r"^\*{0,2}([A-Z][A-Za-z0-9 &.,\-]+?)\*{0,2}\s*[|\-]"
ROLE_FIRST = ("Manager", "Director", "Associate", "Coordinator", "Consultant", "Advisor", "Grants", "Officer", "Specialist", "Analyst", "Lead")
CITY_FIRST = r"(?i)^(?:San Francisco|New York|Los Angeles|Washington|London|Berlin|Chicago|Boston|Houston|Seattle)"
PRICE = r"USD\s*\d|EUR\s*\d|\$\d"
#: Vendor, pattern of its boards' links with the employer, boards of an employer, pattern of its postings' links.
BOARDS = (
    ("greenhouse", r"(?:job-boards|boards)\.greenhouse\.io/([a-z0-9_-]+)", ("https://job-boards.greenhouse.io/{}", "https://boards.greenhouse.io/{}"), r"greenhouse\.io/[^/]+/jobs/\d+"),
    ("lever", r"jobs\.lever\.co/([a-z0-9_-]+)", ("https://jobs.lever.co/{}",), r"jobs\.lever\.co/[^/]+/[0-9a-f-]{8,}"),
    ("ashby", r"jobs\.ashbyhq\.com/([a-z0-9_-]+)", ("https://jobs.ashbyhq.com/{}",), r"jobs\.ashbyhq\.com/[^/]+/[0-9a-f-]{8,}"),
    ("workable", r"apply\.workable\.com/([a-z0-9_-]+)", ("https://apply.workable.com/{}/", "https://{}.workable.com"), r"workable\.com/[^/]+/j/[a-z0-9]+"),
    ("workable", r"([a-z0-9_-]+)\.workable\.com", ("https://apply.workable.com/{}/", "https://{}.workable.com"), r"workable\.com/[^/]+/j/[a-z0-9]+"),
)


def _path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def non_job_url(url: Column) -> Column:
    """Whether a link leads to a page about a site, by its path or its fragment."""
    fragment = F.regexp_extract(F.coalesce(url, F.lit("")), "(#.*)$", 1)
    return _path(url).rlike(f"(?i){NON_JOB_PATH}") | fragment.rlike(f"(?i){NON_JOB_FRAGMENT}")


def people_page(url: Column) -> Column:
    """Whether a page presents people; a careers part anywhere in the path wins."""
    return _path(url).rlike(f"(?i){PEOPLE_PATH}") & ~_path(url).rlike(f"(?i){CAREERS_PATH}")


def bio_snippet(snippet: Column) -> Column:
    """Whether a text opens like a person's biography."""
    head = F.substring(F.coalesce(snippet, F.lit("")), 1, 200)
    return head.rlike(JOINED) | (head.rlike(HOLDER) & ~head.rlike(OPENERS)) | head.rlike(CAREER)


def title_like(text: Column) -> Column:
    """Whether a text reads as the title of a role: short, with a word for a role, and none of a site's own phrases."""
    t = F.trim(F.coalesce(text, F.lit("")))
    low = F.lower(t)
    words = F.split(t, r"\s+")
    named = low.rlike(rf"\b(?:{'|'.join(JOB_WORDS)})s?\b")
    plural = F.trim(F.regexp_replace(t, r"\([^)]+\)\s*", "")).rlike("^[A-Z][a-z]+s$")
    site = low.rlike(rf"\b(?:{'|'.join(NOT_TITLES)})\b")
    return named & ~(t.rlike(PICTURES) | t.endswith("?") | (F.size(words) > 8) | low.contains("http") | low.contains("www.") | plural | site)


def non_job_listing(markdown: Column) -> Column:
    """Marketing prose without a careers heading is no list of postings."""
    return T.is_marketing_page(markdown) & ~F.coalesce(markdown, F.lit("")).rlike(CAREERS_HEADING)


def listed_org(snippet: Column, title: Column, board: Column) -> Column:
    """The employer that a listing names: after "at" in its title, else at the head of its snippet; else the board stands for it."""

    def good(name: Column) -> Column:
        first = F.regexp_replace(F.element_at(F.split(name, r"\s+"), 1), ",+$", "")
        clean = ~name.rlike(r"\d") & ~name.rlike(PRICE) & ~name.rlike(CITY_FIRST) & ~first.isin(*ROLE_FIRST)
        return F.when((F.length(name) > 3) & (F.length(name) < 60) & clean, name)

    in_title = F.regexp_replace(F.trim(F.regexp_extract(F.coalesce(title, F.lit("")), ORG_IN_TITLE, 1)), "[.,]+$", "")
    in_snippet = F.trim(F.regexp_extract(F.coalesce(snippet, F.lit("")), ORG_IN_SNIPPET, 1))
    return F.coalesce(good(in_title), good(in_snippet), F.concat(F.lit("[via "), board, F.lit("]")))


def extracted_jobs(pages: DataFrame, url_filter: str | None = None) -> DataFrame:
    """Postings in the extraction results of pages ``org, base_url, data`` (JSON): each title once a page, in order.

    Links become absolute; links that the filter or the rules of :func:`non_job_url` reject, biographies, and entries without a link on
    a page that presents people are left out.
    """
    schema = "jobs array<struct<title:string,url:string,location:string,department:string,snippet:string>>"
    rows = pages.select("org", "base_url", F.posexplode(F.from_json("data", schema)["jobs"]).alias("at", "j")).select("org", "base_url", "at", "j.*")
    rows = rows.withColumn("title", F.trim("title")).where(title_like(F.col("title")))
    first = rows.groupBy("org", "base_url", "title").agg(F.min_by(F.struct("url", "location", "department", "snippet"), "at").alias("j")).select("org", "base_url", "title", "j.*")
    site = F.regexp_extract("base_url", "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace("base_url", r"[?#].*$", ""), r"(?<=[^/])/[^/]*$", "/")
    raw = F.nullif(F.trim("url"), F.lit(""))
    url = F.when(raw.startswith("http"), raw).when(raw.startswith("/"), F.concat(site, raw)).otherwise(F.concat(folder, raw))
    found = first.withColumn("url", url).withColumn("snippet", F.trim(F.coalesce("snippet", F.lit(""))))
    if url_filter:
        found = found.where(F.col("url").isNull() | F.col("url").rlike(url_filter))
    found = found.where(~F.coalesce(non_job_url(F.col("url")), F.lit(False)) & ~bio_snippet(F.col("snippet")) & (F.col("url").isNotNull() | ~people_page(F.col("base_url"))))
    key = F.substring(F.md5(F.coalesce("url", F.concat_ws(":", "org", "title"))), 1, 12)
    return found.select("org", "title", "url", F.trim("location").alias("location"), F.trim("department").alias("department"), "snippet", key.alias("external_id"))


def workday_detail(url: Column) -> Column:
    """The detail address of a tenant's posting page; null for any other link."""
    u = F.coalesce(url, F.lit(""))
    site = r"^([a-z]+)://([A-Za-z0-9-]+)(\.(?i:wd\d+\.myworkdayjobs\.com))(?:/[a-z]{2}-[A-Z]{2})?/([^/?#]+)/([^?#]+)"
    part = [F.regexp_extract(u, site, i) for i in range(1, 6)]
    rest = F.regexp_replace(part[4], "/+$", "")
    made = F.concat(part[0], F.lit("://"), part[1], part[2], F.lit("/wday/cxs/"), F.lower(part[1]), F.lit("/"), part[3], F.lit("/"), rest)
    return F.when((part[1] != "") & (rest != ""), made)


def linkedin_id(url: Column) -> Column:
    """The number of a posting in its link's path or in the query."""
    u = F.coalesce(url, F.lit(""))
    return F.coalesce(F.nullif(F.regexp_extract(u, r"/jobs/view/(?:[^/?#]*-)?(\d{6,})", 1), F.lit("")), F.nullif(F.regexp_extract(u, r"[?&]currentJobId=(\d{6,})", 1), F.lit("")))


def boards_in_links(links: DataFrame) -> DataFrame:
    """Boards that the links ``page_id, link`` of a page lead to: ``page_id, vendor, slug, board_url``, each once."""
    found = [F.struct(F.lit(v).alias("vendor"), F.lower(F.regexp_extract("link", f"(?i){p}", 1)).alias("slug"), F.array(*[F.lit(b) for b in boards]).alias("boards")) for v, p, boards, _ in BOARDS]
    rows = links.select("page_id", F.explode(F.array(*found)).alias("x")).select("page_id", "x.*").where("slug <> ''")
    return rows.select("page_id", "vendor", "slug", F.explode("boards").alias("b")).select("page_id", "vendor", "slug", F.replace("b", F.lit("{}"), F.col("slug")).alias("board_url")).distinct()


def postings_in_links(links: DataFrame, most: int) -> DataFrame:
    """The first ``most`` links of a page ``page_id, at, link`` to postings of each vendor: ``page_id, vendor, link``."""
    from pyspark.sql import Window as W

    kinds = {v: p for v, _, _, p in BOARDS}
    found = F.array(*[F.when(F.col("link").rlike(f"(?i){p}"), F.lit(v)) for v, p in kinds.items()])
    rows = links.select("page_id", "at", "link", F.explode(found).alias("vendor")).where("vendor is not null")
    once = rows.groupBy("page_id", "vendor", "link").agg(F.min("at").alias("at"))
    return once.withColumn("_r", F.row_number().over(W.partitionBy("page_id", "vendor").orderBy("at", "link"))).where(F.col("_r") <= most).drop("_r", "at")
