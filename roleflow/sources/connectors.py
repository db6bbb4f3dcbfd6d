"""Landed payloads of job vendors and boards as one table of postings.

A connector reads files that were fetched before and names the payload's schema, so nothing is inferred and a
malformed record goes to ``_corrupt``. Every connector returns ``POSTING`` columns; rows without a title are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roleflow.functions import text as T
from roleflow.functions import values as D
from roleflow.functions.naming import let

POSTING = ("external_id", "org", "title", "url", "location", "department", "snippet", "description", "compensation", "deadline")
Connector = Callable[[SparkSession, str, str], DataFrame]
REGISTRY: dict[str, Connector] = {}


def connector(name: str):
    def put(f: Connector) -> Connector:
        REGISTRY[name] = f
        return f

    return put


def _shape(rows: DataFrame, org: str | Column, **columns: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    body = columns.get("description", none)
    made = {c: none for c in POSTING} | {"snippet": T.snippet(F.regexp_replace(F.coalesce(body, F.lit("")), r"\s+", " ")), "deadline": D.deadline_of(body)} | columns
    made["org"] = F.lit(org) if isinstance(org, str) else org
    made["compensation"] = F.coalesce(made["compensation"], D.pay(body)["text"])
    out = rows.select(*[made[c].alias(c) for c in POSTING])
    return out.where(F.trim(F.coalesce("title", F.lit(""))) != "")


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def _joined(*parts: Column) -> Column:
    return F.nullif(F.concat_ws(", ", *[F.nullif(F.trim(p), F.lit("")) for p in parts]), F.lit(""))


@connector("greenhouse")
def greenhouse(spark, path, org):
    rows = _json(spark, path, "jobs array<struct<id:bigint,title:string,absolute_url:string,location:struct<name:string>,departments:array<struct<name:string>>,content:string>>")
    j = rows.select(F.explode("jobs").alias("j")).select("j.*")
    return _shape(j, org, external_id=F.col("id").cast("string"), title=F.col("title"), url=F.col("absolute_url"), location=F.col("location.name"), department=F.get("departments", F.lit(0))["name"], description=T.html_to_text(T.html_to_text(F.col("content"))))


@connector("lever")
def lever(spark, path, org):
    j = _json(spark, path, "id string, text string, hostedUrl string, categories struct<location:string,team:string,department:string>, descriptionPlain string, description string, lists array<struct<text:string,content:string>>, additionalPlain string")
    lists = F.transform(F.coalesce("lists", F.array().cast("array<struct<text:string,content:string>>")), lambda x: F.concat_ws("\n", x["text"], T.html_to_text(x["content"])))
    body = F.concat_ws("\n\n", F.coalesce("descriptionPlain", T.html_to_text(F.col("description"))), F.nullif(F.array_join(lists, "\n\n"), F.lit("")), F.nullif("additionalPlain", F.lit("")))
    return _shape(j, org, external_id=F.col("id"), title=F.col("text"), url=F.col("hostedUrl"), location=F.col("categories.location"), department=F.coalesce("categories.department", "categories.team"), description=body)


@connector("ashby")
def ashby(spark, path, org):
    rows = _json(spark, path, "jobs array<struct<title:string,jobUrl:string,location:string,department:string,team:string,descriptionPlain:string,descriptionHtml:string,compensation:struct<compensationTierSummary:string>>>")
    j = rows.select(F.explode("jobs").alias("j")).select("j.*")
    body = F.coalesce(F.nullif("descriptionPlain", F.lit("")), T.html_to_text(F.col("descriptionHtml")))
    return _shape(j, org, external_id=F.substring(F.md5("jobUrl"), 1, 12), title=F.col("title"), url=F.col("jobUrl"), location=F.col("location"), department=F.coalesce("department", "team"), description=body, compensation=F.col("compensation.compensationTierSummary"))


@connector("smartrecruiters")
def smartrecruiters(spark, path, org):
    rows = _json(spark, path, "offset int, totalFound int, content array<struct<id:string,name:string,company:struct<identifier:string,name:string>,location:struct<city:string,region:string,country:string,remote:boolean,hybrid:boolean,fullLocation:string>,department:struct<label:string>>>")
    j = rows.select(F.explode("content").alias("j")).select("j.*")
    mode = F.when(F.col("location.remote"), "remote").when(F.col("location.hybrid"), "hybrid")
    place = F.coalesce("location.fullLocation", _joined(F.col("location.city"), F.col("location.region"), F.upper("location.country")))
    url = F.concat(F.lit("https://jobs.smartrecruiters.com/"), F.col("company.identifier"), F.lit("/"), F.col("id"))
    return _shape(j, org, external_id=F.col("id"), title=F.col("name"), url=url, location=F.concat_ws(", ", place, mode), department=F.col("department.label"))


@connector("recruitee")
def recruitee(spark, path, org):
    rows = _json(spark, path, "offers array<struct<id:bigint,title:string,careers_url:string,location:string,department:string,description:string,requirements:string>>")
    j = rows.select(F.explode("offers").alias("j")).select("j.*")
    body = F.concat_ws("\n\n", *[F.nullif(T.html_to_text(F.col(c)), F.lit("")) for c in ("description", "requirements")])
    return _shape(j, org, external_id=F.col("id").cast("string"), title=F.col("title"), url=F.col("careers_url"), location=F.col("location"), department=F.col("department"), description=body)


@connector("workable")
def workable(spark, path, org):
    rows = _json(spark, path, "jobs array<struct<shortcode:string,title:string,url:string,city:string,country:string,department:string,description:string,telecommuting:boolean>>")
    j = rows.select(F.explode("jobs").alias("j")).select("j.*")
    place = F.concat_ws(", ", _joined(F.col("city"), F.col("country")), F.when(F.col("telecommuting"), "remote"))
    return _shape(j, org, external_id=F.col("shortcode"), title=F.col("title"), url=F.col("url"), location=place, department=F.col("department"), description=T.html_to_text(F.col("description")))


@connector("pinpoint")
def pinpoint(spark, path, org):
    rows = _json(spark, path, "data array<struct<id:string,title:string,url:string,compensation:string,compensation_visible:boolean,deadline_at:string,workplace_type_text:string,description:string,location:struct<name:string,city:string>,job:struct<department:struct<name:string>>>>")
    j = rows.select(F.explode("data").alias("j")).select("j.*")
    place = F.concat_ws(", ", F.nullif("workplace_type_text", F.lit("")), F.coalesce("location.name", "location.city"))
    return _shape(j, org, external_id=F.col("id"), title=F.col("title"), url=F.col("url"), location=place, department=F.col("job.department.name"), description=T.html_to_text(F.col("description")), compensation=F.when(F.col("compensation_visible"), F.col("compensation")), deadline=D.strict_date(F.substring("deadline_at", 1, 10)))


@connector("adp")
def adp(spark, path, org):
    money = "struct<amountValue:double,currencyCode:string>"
    rows = _json(spark, path, f"jobRequisitions array<struct<itemID:string,requisitionTitle:string,postDate:string,payGradeRange:struct<minimumRate:{money},maximumRate:{money}>,requisitionLocations:array<struct<nameCode:struct<shortName:string>>>>>")
    j = rows.select(F.explode("jobRequisitions").alias("j")).select("j.*")
    low, high = F.col("payGradeRange.minimumRate"), F.col("payGradeRange.maximumRate")
    pay = F.when(low.isNotNull() | high.isNotNull(), F.concat_ws(" ", F.concat_ws("–", F.format_number(low["amountValue"], 0), F.format_number(high["amountValue"], 0)), F.coalesce(low["currencyCode"], high["currencyCode"])))
    return _shape(j, org, external_id=F.col("itemID"), title=F.col("requisitionTitle"), location=F.get("requisitionLocations", F.lit(0))["nameCode"]["shortName"], compensation=pay)


@connector("oracle_hcm")
def oracle_hcm(spark, path, org):
    rows = _json(spark, path, "items array<struct<TotalJobsCount:int,requisitionList:array<struct<Id:string,Title:string,PostedDate:string,PostingEndDate:string,PrimaryLocation:string,WorkplaceType:string,ShortDescriptionStr:string>>>>")
    j = rows.select(F.explode("items").alias("i")).select(F.explode("i.requisitionList").alias("j")).select("j.*").dropDuplicates(["Id"])
    return _shape(j, org, external_id=F.col("Id"), title=F.col("Title"), location=F.concat_ws(", ", "PrimaryLocation", "WorkplaceType"), description=T.html_to_text(F.col("ShortDescriptionStr")), deadline=D.strict_date(F.substring("PostingEndDate", 1, 10)))


def with_details(postings: DataFrame, details: DataFrame) -> DataFrame:
    """Postings with the description of ``details(external_id, description)``; one without a detail keeps its own."""
    d = details.select("external_id", F.col("description").alias("_full"))
    joined = postings.join(d, "external_id", "left")
    return joined.select(*[F.coalesce("_full", "description").alias(c) if c == "description" else F.col(c) for c in POSTING])


@connector("rss")
def rss(spark, path, org):
    """Items of an RSS feed; the description is escaped markup."""
    schema = "title string, link string, guid string, description string, pubDate string, category string"
    j = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    return _shape(j, org, external_id=F.coalesce("guid", F.substring(F.md5("link"), 1, 12)), title=F.col("title"), url=F.col("link"), department=F.col("category"), description=T.html_to_text(F.col("description")))


@connector("search_index")
def search_index(spark, path, org):
    """Pages of a search index: each hit once, organisation and places from its tags."""
    schema = "nbHits bigint, hits array<struct<objectID:string,title:string,company_name:string,url:string,tags_city:array<string>,tags_country:array<string>,closes_at:bigint,description:string>>"
    j = _json(spark, path, schema).select(F.explode("hits").alias("j")).select("j.*").dropDuplicates(["objectID"])
    places = F.when(F.size("tags_city") > 0, F.col("tags_city")).otherwise(F.col("tags_country"))
    return _shape(j, F.coalesce("company_name", F.lit(org)), external_id=F.col("objectID"), title=F.col("title"), url=F.col("url"), location=F.array_join(places, "; "), description=T.html_to_text(F.col("description")), deadline=F.to_date(F.timestamp_seconds("closes_at")))


def incomplete_runs(spark: SparkSession, path: str) -> DataFrame:
    """Hits seen against hits that the index advertised: ``advertised, observed, complete``."""
    rows = _json(spark, path, "nbHits bigint, hits array<struct<objectID:string>>")
    spread = rows.select("nbHits", F.explode_outer("hits.objectID").alias("hit"))
    seen = spread.agg(F.max("nbHits").alias("advertised"), F.count_distinct("hit").alias("observed"))
    return seen.withColumn("complete", F.col("observed") >= F.col("advertised"))


@connector("hiring_thread")
def hiring_thread(spark, path, org):
    """Top-level comments of the newest monthly thread: the first line holds employer, title and places between bars."""
    rows = _json(spark, path, "story bigint, story_created bigint, id bigint, parent bigint, text string")
    newest = rows.agg(F.max_by("story", "story_created").alias("story")).first()["story"]
    j = rows.where((F.col("story") == F.lit(newest)) & (F.col("parent") == F.col("story"))).withColumn("body", T.html_to_text(F.col("text")))
    parts = F.transform(F.split(F.element_at(F.split("body", "\n"), 1), r"\s*\|\s*"), lambda p: F.trim(p))
    j = j.withColumn("parts", parts).where((F.size("parts") >= 2) & ~F.col("body").rlike(r"(?i)^\s*seeking work"))
    j = j.where((F.length(F.get("parts", F.lit(0))) <= 80) & F.length(F.get("parts", F.lit(1))).between(4, 200))
    mode = F.try_element_at(F.filter("parts", lambda p: p.rlike(r"(?i)\b(remote|onsite|on-site|hybrid)\b")), F.lit(1))
    return _shape(j, F.get("parts", F.lit(0)), external_id=F.col("id").cast("string"), title=F.get("parts", F.lit(1)), location=mode, description=F.col("body"))


@connector("html_cards")
def html_cards(spark, path, org):
    """Links of listing pages that look like postings, each link once."""
    pages = spark.read.text(path, wholetext=True)
    links = F.regexp_extract_all("value", F.lit(r"""(?is)<a\s[^>]*href=["']([^"'#]+)["'][^>]*>.*?</a>"""), F.lit(0))
    j = pages.select(F.explode(links).alias("a"))
    j = j.select(F.regexp_extract("a", r"""(?is)href=["']([^"'#]+)["']""", 1).alias("url"), T.html_to_line(F.col("a")).alias("title"))
    j = j.where(F.col("url").rlike(r"(?i)/(?:jobs?|careers?|vacanc|positions?|openings?)/[^/?]+") & F.length("title").between(4, 200)).dropDuplicates(["url"])
    return _shape(j, org, external_id=F.substring(F.md5("url"), 1, 12), title=F.col("title"), url=F.col("url"))


def posting_pages(pages: DataFrame) -> DataFrame:
    """Descriptions in pages ``url, html``: structured data first, then the main container; ``url, description, how``."""
    data = F.regexp_extract("html", r"""(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>""", 1)
    structured = T.html_to_text(F.get_json_object(data, "$.description"))
    main = T.html_to_text(F.regexp_extract("html", r"(?is)<(?:article|main)\b[^>]*>(.*?)</(?:article|main)>", 1))
    tried = let(structured, lambda s: F.when(F.length(s) > 0, F.struct(s.alias("text"), F.lit("json-ld").alias("how"))))
    inside = let(main, lambda m: F.when(F.length(m) > 0, F.struct(m.alias("text"), F.lit("container").alias("how"))))
    page = F.struct(T.html_to_text(F.col("html")).alias("text"), F.lit("page").alias("how"))
    found = pages.select("url", F.coalesce(tried, inside, page).alias("x"))
    return found.select("url", F.col("x.text").alias("description"), "x.how")


def links_of(pages: DataFrame) -> DataFrame:
    """Links of pages ``page_id, html`` without fragment, each once a page; redirect parameters are unwrapped."""
    raw = F.explode(F.regexp_extract_all("html", F.lit(r"""(?i)href=["']([^"'#\s]+)["']"""), F.lit(1)))
    rows = pages.select("page_id", raw.alias("link"))
    inner = F.regexp_extract("link", r"[?&](?:url|u|redirect|href|link)=(https?[^&]+)", 1)
    return rows.select("page_id", F.when(inner != "", F.try_url_decode(inner)).otherwise(F.col("link")).alias("link")).distinct()


# Vendors by the host of their links, with where the employer's name stands.
VENDORS = (
    ("greenhouse", r"(?:boards|job-boards)(?:\.eu)?\.greenhouse\.io/([A-Za-z0-9_-]+)"),
    ("lever", r"jobs(?:\.eu)?\.lever\.co/([A-Za-z0-9_-]+)"),
    ("ashby", r"jobs\.ashbyhq\.com/([A-Za-z0-9_.%-]+)"),
    ("smartrecruiters", r"(?:jobs|careers)\.smartrecruiters\.com/([A-Za-z0-9_-]+)"),
    ("recruitee", r"([a-z0-9-]+)\.recruitee\.com"),
    ("workable", r"apply\.workable\.com/([A-Za-z0-9_-]+)"),
    ("bamboohr", r"([a-z0-9-]+)\.bamboohr\.com"),
    ("pinpoint", r"([a-z0-9-]+)\.pinpointhq\.com"),
    ("teamtailor", r"([a-z0-9-]+)\.teamtailor\.com"),
    ("workday", r"([a-z0-9-]+)\.(?:wd\d+\.)?myworkdayjobs\.com"),
)


def vendors_of(links: DataFrame) -> DataFrame:
    """Vendor and employer name in each of ``link``, each pair once."""
    found = F.array(*[F.struct(F.lit(v).alias("vendor"), F.lower(F.regexp_extract("link", f"(?i){p}", 1)).alias("slug")) for v, p in VENDORS])
    return links.select(F.explode(found).alias("x")).select("x.*").where("slug <> ''").distinct()


def contacts_csv(spark: SparkSession, path: str) -> DataFrame:
    """Contacts of a CSV with a name column; rows without a name are left out, an unknown status is planned."""
    rows = spark.read.option("header", True).csv(path)
    for c in ("group", "status"):
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("string"))
    known = F.col("status").isin("planned", "contacted", "replied", "met", "declined")
    return rows.where(F.trim(F.coalesce("name", F.lit(""))) != "").withColumn("status", F.when(known, F.col("status")).otherwise("planned"))


def markdown_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Reports in Markdown files: slug from the file's name, title from the first heading of its head, kind from its folders."""
    rows = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("path"))
    head = F.array_join(F.slice(F.split("value", "\n"), 1, 40), "\n")
    kind = F.regexp_extract("path", r"(?i)/(research|grant|company|sector)s?/(?:[^/]+/)*[^/]+$", 1)
    stem = F.regexp_replace(F.regexp_extract("path", "([^/]+)$", 1), r"\.[^.]+$", "")
    return rows.select(stem.alias("slug"), F.regexp_extract(head, r"(?m)^#\s+(.+?)\s*$", 1).alias("title"), F.when(kind != "", F.lower(kind)).otherwise("other").alias("kind"), F.col("value").alias("body"))


def model_results(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """One result a file, fenced or with words around: the outermost braces, parsed by ``schema``; what does not parse has a null result."""
    rows = spark.read.text(folder, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return rows.select("path", F.from_json(F.regexp_extract("value", r"(?s)\{.*\}", 0), schema).alias("result"))


def markdown_jobs(pages: DataFrame) -> DataFrame:
    """Postings that Markdown pages ``url, text`` link to: ``url, title, external_id``.

    Images, links that a page repeats three times or more, links that are no postings and titles that only count a department go.
    """
    links = F.regexp_extract_all("text", F.lit(r"(?<!!)\[([^\]\[]{4,200})\]\((https?://[^)\s]+)\)"), F.lit(0))
    rows = pages.select(F.col("url").alias("page"), F.explode(links).alias("l"))
    rows = rows.select("page", T.html_to_line(F.regexp_extract("l", r"^\[(.*)\]\(", 1)).alias("title"), F.regexp_extract("l", r"\((https?://[^)]+)\)$", 1).alias("url"))
    again = rows.groupBy("page", "url").agg(F.count(F.lit(1)).alias("n"), F.min("title").alias("title")).where("n < 3")
    posting = F.col("url").rlike(r"(?i)/(?:jobs?|careers?|vacanc|positions?|openings?|o)/[^/?]+") & ~F.col("url").rlike(r"(?i)/(?:login|privacy|terms|blog|news|about)(?:/|$)")
    kept = again.where(posting & ~F.col("title").rlike(r"^[^()]*\(\d+\)\s*$"))
    return kept.select("page", "url", "title", F.substring(F.md5("url"), 1, 12).alias("external_id"))


def fits_role(text: Column, org: Column, title: Column, least: float = 0.5) -> Column:
    """Struct ``(ok, reason)``: a fetched text is of this role if it names the employer, or enough words of the title."""
    low = F.lower(F.coalesce(text, F.lit("")))
    name = F.trim(F.regexp_replace(F.lower(org), r"(?i)[,.]?\s*\b(?:inc|llc|ltd|gmbh|foundation|corp)\b\.?$", ""))
    words = F.array_distinct(F.filter(F.split(F.lower(title), r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) >= 3) & ~w.isin("the", "and", "for", "with")))
    found = F.filter(words, lambda w: low.contains(w))
    share = F.try_divide(F.size(found).cast("double"), F.size(words).cast("double"))
    named = (name != "") & low.contains(name)
    return F.struct((named | F.coalesce(share >= least, F.lit(False))).alias("ok"), F.when(named, "org").when(share >= least, "title").otherwise("neither").alias("reason"))
