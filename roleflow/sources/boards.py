"""Landed payloads of further vendors and boards, each with its own schema; see :mod:`roleflow.sources.connectors`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roleflow.functions import text as T
from roleflow.functions import values as D
from roleflow.sources.connectors import _joined, _json, _shape, connector


def _short_key(*parts: Column) -> Column:
    return F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12)


def _text(name: str) -> Column:
    """A field without surrounding space; empty counts as missing."""
    return F.nullif(F.trim(F.col(name)), F.lit(""))


def _remote(place: Column, remote: Column) -> Column:
    """A place with its work mode before it."""
    return F.when(remote, F.concat_ws(", ", F.lit("Remote"), F.nullif(F.trim(place), F.lit("")))).otherwise(F.nullif(F.trim(place), F.lit("")))


def _noted(body: Column, *notes: tuple[str, Column]) -> Column:
    """A description with labelled notes in a last line; notes without a value are left out."""
    line = F.concat_ws(" | ", *[F.when(F.length(v) > 0, F.concat(F.lit(f"{label}: "), v)) for label, v in notes])
    return F.concat_ws("\n\n", F.nullif(body, F.lit("")), F.nullif(line, F.lit("")))


def _each(rows: DataFrame, array: str) -> DataFrame:
    return rows.select(F.explode(array).alias("j")).select("j.*")


def _of_employer(rows: DataFrame, name: Column) -> DataFrame:
    """Board rows that name their employer; others are left out."""
    return rows.withColumn("_org", F.nullif(F.trim(name), F.lit(""))).where("_org is not null")


@connector("workday")
def workday(spark, path, org):
    """List pages of a tenant; the last part of a path is the requisition."""
    j = _each(_json(spark, path, "total int, jobPostings array<struct<title:string,externalPath:string,locationsText:string>>"), "jobPostings").dropDuplicates(["externalPath"])
    return _shape(j, org, external_id=F.element_at(F.split("externalPath", "/"), -1), title=F.col("title"), url=F.col("externalPath"), location=F.col("locationsText"))


@connector("bamboohr")
def bamboohr(spark, path, org):
    j = _each(_json(spark, path, "result array<struct<id:string,jobOpeningName:string,location:struct<city:string,state:string>,isRemote:boolean,departmentLabel:string>>"), "result")
    place = _joined(F.col("location.city"), F.col("location.state"))
    return _shape(j, org, external_id=F.col("id"), title=F.col("jobOpeningName"), location=_remote(place, F.col("isRemote")), department=_text("departmentLabel"))


@connector("amazon")
def amazon(spark, path, org):
    """Pages of several searches: each posting once, by its id."""
    schema = "hits int, jobs array<struct<title:string,id_icims:string,id:string,job_path:string,description:string,description_short:string,location:string,job_category:string>>"
    j = _each(_json(spark, path, schema), "jobs")
    key = F.coalesce(_text("id_icims"), _text("id"), _short_key(F.lit(org), F.col("title")))
    j = j.withColumn("_key", key).groupBy("_key").agg(F.min_by(F.struct(*j.columns), "title").alias("j")).select("_key", "j.*")
    url = F.when(F.length("job_path") > 0, F.concat(F.lit("https://www.amazon.jobs"), F.col("job_path")))
    return _shape(j, org, external_id=F.col("_key"), title=F.trim("title"), url=url, location=_text("location"), department=_text("job_category"), description=_text("description"), snippet=_text("description_short"))


@connector("apple")
def apple(spark, path, org):
    schema = "totalRecords int, searchResults array<struct<postingTitle:string,positionId:string,jobSummary:string,team:struct<teamName:string>,locations:array<struct<name:string,city:string>>>>"
    j = _each(_json(spark, path, schema), "searchResults")
    places = F.transform(F.slice("locations", 1, 3), lambda x: F.coalesce(F.nullif(x["name"], F.lit("")), x["city"], F.lit("")))
    url = F.when(F.length("positionId") > 0, F.concat(F.lit("https://jobs.apple.com/en-us/details/"), F.col("positionId")))
    return _shape(j, org, external_id=F.coalesce(_text("positionId"), _short_key(F.lit(org), F.col("postingTitle"))), title=F.trim("postingTitle"), url=url, location=F.array_join(places, ", "), department=F.col("team.teamName"), description=_text("jobSummary"))


@connector("successfactors")
def successfactors(spark, path, org):
    """Rows of a result table in landed pages: the link holds the title, a cell of its own the place."""
    pages = spark.read.text(path, wholetext=True)
    row = F.explode(F.regexp_extract_all("value", F.lit(r"(?is)<tr[^>]*class=[\"'][^\"']*data-row[^>]*>.*?</tr>"), F.lit(0)))
    j = pages.select(row.alias("r"))
    link = F.regexp_extract("r", r"(?is)<a[^>]*class=[\"'][^\"']*jobTitle-link[^>]*href=[\"']([^\"'#]+)[\"']", 1)
    title = T.html_to_line(F.regexp_extract("r", r"(?is)(<a[^>]*jobTitle-link.*?</a>)", 1))
    place = T.html_to_line(F.regexp_extract("r", r"(?is)(<span[^>]*jobLocation.*?</span>)", 1))
    j = j.select(link.alias("url"), title.alias("title"), place.alias("location")).where("url <> ''").dropDuplicates(["url"])
    return _shape(j, org, external_id=F.coalesce(F.nullif(F.regexp_extract("url", r"/(\d+)/?$", 1), F.lit("")), _short_key(F.col("url"))), title=F.col("title"), url=F.col("url"), location=F.nullif("location", F.lit("")))


@connector("arbeitnow")
def arbeitnow(spark, path, org):
    schema = "data array<struct<slug:string,company_name:string,title:string,description:string,remote:boolean,url:string,tags:array<string>,job_types:array<string>,location:string,visa_sponsorship:boolean>>"
    j = _of_employer(_each(_json(spark, path, schema), "data"), F.col("company_name"))
    body = _noted(T.html_to_text(F.col("description")), ("Visa sponsorship", F.when(F.col("visa_sponsorship"), "yes")), ("Tags", F.array_join("tags", ", ")), ("Type", F.array_join("job_types", ", ")))
    return _shape(j, F.col("_org"), external_id=F.coalesce(_text("slug"), _short_key(F.col("_org"), F.col("title"))), title=F.trim("title"), url=F.col("url"), location=_remote(F.col("location"), F.col("remote")), description=body)


@connector("remotive")
def remotive(spark, path, org):
    """Every posting is remote; where candidates must be narrows it. Pages of several categories repeat postings."""
    schema = "jobs array<struct<id:bigint,url:string,title:string,company_name:string,category:string,job_type:string,candidate_required_location:string,salary:string,description:string>>"
    j = _of_employer(_each(_json(spark, path, schema), "jobs").dropDuplicates(["id"]), F.col("company_name"))
    wanted = F.col("candidate_required_location")
    body = _noted(T.html_to_text(F.col("description")), ("Candidate location", wanted), ("Category", F.col("category")), ("Type", F.col("job_type")))
    return _shape(j, F.col("_org"), external_id=F.col("id").cast("string"), title=F.trim("title"), url=F.col("url"), location=_remote(wanted, F.lit(True)), department=_text("category"), description=body, compensation=_text("salary"))


@connector("reliefweb")
def reliefweb(spark, path, org):
    """Items of a feed whose description begins with labelled lines; the employer stands in one of them."""
    j = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, guid string, description string").load(path)
    j = j.withColumn("_body", T.html_to_text(F.col("description")))
    field = lambda name: F.nullif(F.trim(F.regexp_extract("_body", rf"(?im)^\s*{name}\s*:\s*(.+)$", 1)), F.lit(""))
    j = _of_employer(j, F.coalesce(field("Organi[sz]ation"), F.lit(org)))
    closing = F.coalesce(D.strict_date(F.substring(field("Closing date"), 1, 10)), F.try_to_date(field("Closing date"), "d MMM yyyy"))
    return _shape(j, F.col("_org"), external_id=F.coalesce(_text("guid"), _short_key(F.col("link"))), title=F.trim("title"), url=F.col("link"), location=F.concat_ws(", ", field("City"), field("Country")), description=F.col("_body"), deadline=closing)


@connector("idealist")
def idealist(spark, path, org):
    """Search hits with zones for remote roles and a salary in parts."""
    schema = (
        "hits array<struct<objectID:string,name:string,orgName:string,url:struct<en:string>,locationType:string,remoteZone:string,country:string,city:string,functions:array<string>,"
        "keywords:array<string>,description:string,professionalLevel:string,salaryMinimum:double,salaryMaximum:double,salaryCurrency:string,salaryPeriod:string>>"
    )
    j = _of_employer(_each(_json(spark, path, schema), "hits").dropDuplicates(["objectID"]), F.col("orgName"))
    place = F.when(F.col("locationType") == "REMOTE", F.concat_ws(", ", F.lit("Remote"), F.coalesce(F.nullif("remoteZone", F.lit("WORLD")), F.lit("worldwide")), "country")).otherwise(_joined(F.col("city"), F.col("country")))
    pay = F.concat_ws("–", *[F.when(F.col(c) > 0, F.format_number(c, 0)) for c in ("salaryMinimum", "salaryMaximum")])
    pay = F.when(F.length(pay) > 0, F.concat(F.coalesce("salaryCurrency", F.lit("USD")), F.lit(" "), pay, F.lit("/"), F.lower(F.coalesce("salaryPeriod", F.lit("YEAR")))))
    body = _noted(T.html_to_text(F.col("description")), ("Level", F.col("professionalLevel")), ("Keywords", F.array_join("keywords", ", ")))
    url = F.concat(F.lit("https://www.idealist.org"), F.col("url.en"))
    return _shape(j, F.col("_org"), external_id=F.coalesce(_text("objectID"), _short_key(F.col("_org"), F.col("name"))), title=F.trim("name"), url=url, location=place, department=F.array_join("functions", ", "), description=body, compensation=pay)


@connector("tagged_index")
def tagged_index(spark, path, org):
    """Search hits with nested employers and tags of several kinds; the salary counts only where it is said to be given."""
    tag = "array<struct<name:string>>"
    schema = (
        f"nbHits bigint, hits array<struct<objectID:string,title:string,slug:string,org:struct<name:string>,url_external:string,locations:{tag},tags_area:{tag},tags_skill:{tag},"
        f"tags_experience:{tag},description:string,has_salary:boolean,salary_text:string,closes_at:string>>"
    )
    j = _of_employer(_each(_json(spark, path, schema), "hits").dropDuplicates(["objectID"]), F.col("org.name"))
    names = lambda c: F.array_join(F.transform(c, lambda x: F.trim(x["name"])), ", ")
    body = _noted(T.html_to_text(F.col("description")), ("Skills", names("tags_skill")), ("Experience", names("tags_experience")))
    return _shape(j, F.col("_org"), external_id=F.coalesce(_text("objectID"), _short_key(F.col("_org"), F.col("title"))), title=F.trim("title"), url=F.coalesce(_text("url_external"), F.col("slug")), location=names("locations"), department=names("tags_area"), description=body, compensation=F.when(F.col("has_salary"), _text("salary_text")), deadline=D.strict_date(F.substring("closes_at", 1, 10)))


@connector("fastforward")
def fastforward(spark, path, org):
    """Pages of a board with pay in cents, shown only where it is public."""
    schema = (
        "results struct<count:int,jobs:array<struct<id:bigint,title:string,slug:string,url:string,organization:struct<name:string>,locations:array<struct<name:string>>,work_mode:string,"
        "compensation_amount_min_cents:bigint,compensation_amount_max_cents:bigint,compensation_currency:string,compensation_period:string,compensation_public:boolean>>>"
    )
    j = _each(_json(spark, path, schema).select("results.jobs"), "jobs").dropDuplicates(["id"])
    j = _of_employer(j, F.col("organization.name"))
    amount = lambda c: F.format_number(F.col(c) / 100, 0)
    pay = F.when(
        F.col("compensation_public") & (F.col("compensation_amount_min_cents") > 0) & (F.col("compensation_amount_max_cents") > 0),
        F.concat(F.coalesce("compensation_currency", F.lit("USD")), F.lit(" "), amount("compensation_amount_min_cents"), F.lit("–"), amount("compensation_amount_max_cents"), F.coalesce(F.concat(F.lit("/"), F.nullif("compensation_period", F.lit(""))), F.lit(""))),
    )
    place = _remote(F.array_join(F.transform("locations", lambda x: x["name"]), "; "), F.col("work_mode") == "remote")
    return _shape(j, F.col("_org"), external_id=F.col("id").cast("string"), title=F.trim(F.regexp_replace("title", r"\s{2,}Featured$", "")), url=_text("url"), location=place, compensation=pay)


@connector("wordpress_jobs")
def wordpress_jobs(spark, path, org):
    """Posts of a site's own job type: titles are escaped, the employer comes with the detail page."""
    j = _json(spark, path, "id bigint, link string, title struct<rendered:string>, detail struct<employer:string,location:string,salary:string,deadline:string,description:string,apply_url:string,expired:boolean>")
    j = j.where("not coalesce(detail.expired, false)")
    title = T.html_to_line(F.col("title.rendered"))
    return _shape(j, F.coalesce(F.nullif("detail.employer", F.lit("")), F.lit(org)), external_id=F.col("id").cast("string"), title=title, url=F.coalesce(F.nullif("detail.apply_url", F.lit("")), F.col("link")), location=F.col("detail.location"), description=T.html_to_text(F.col("detail.description")), compensation=F.col("detail.salary"), deadline=D.strict_date(F.substring("detail.deadline", 1, 10)))


@connector("curated_list")
def curated_list(spark, path, org):
    """A list that editors keep: expired entries go, notes on hours stand with the description."""
    j = _each(_json(spark, path, "jobs array<struct<title:string,org:string,url:string,location:string,seniority:string,cause_areas:array<string>,part_time:boolean,project_based:boolean,deadline:string,expired:boolean>>"), "jobs")
    j = _of_employer(j.where("not coalesce(expired, false)"), F.col("org")).where("coalesce(trim(url), '') <> ''")
    body = _noted(F.lit(""), ("Seniority", F.col("seniority")), ("Part-time", F.when(F.col("part_time"), "yes")), ("Project-based", F.when(F.col("project_based"), "yes")))
    return _shape(j, F.col("_org"), external_id=_short_key(F.col("url")), title=F.trim("title"), url=F.trim("url"), location=_text("location"), department=F.array_join("cause_areas", ", "), snippet=body, deadline=D.strict_date(F.substring("deadline", 1, 10)))


@connector("opportunity_rows")
def opportunity_rows(spark, path, org):
    """Rows of a shared base: only those that are jobs; the employer is the first named, places are free text or a filter's."""
    schema = (
        "id string, title string, applicationLink string, opportunityTypes array<string>, organizations array<struct<name:string,link:string>>, organization array<string>, location string, "
        "locationFilter array<string>, causeAreas array<string>, salaryOriginal string, salary double, applicationDeadline string, description string"
    )
    j = _json(spark, path, schema)
    j = j.where(F.exists("opportunityTypes", lambda t: F.lower(t).contains("job")) & (F.length(F.trim("applicationLink")) > 0))
    first = lambda c, f=lambda x: x: F.try_element_at(F.filter(F.transform(c, lambda x: F.trim(f(x))), lambda x: x != ""), F.lit(1))
    j = _of_employer(j, F.coalesce(first("organizations", lambda x: x["name"]), first("organization")))
    place = F.coalesce(_text("location"), F.nullif(F.array_join(F.filter(F.transform("locationFilter", lambda x: F.trim(x)), lambda x: x != ""), ", "), F.lit("")))
    pay = F.coalesce(_text("salaryOriginal"), F.when(F.col("salary") > 0, F.format_number("salary", 0)))
    return _shape(j, F.col("_org"), external_id=F.coalesce(_text("id"), _short_key(F.col("applicationLink"))), title=F.trim("title"), url=F.trim("applicationLink"), location=place, department=F.array_join("causeAreas", ", "), description=T.html_to_text(F.col("description")), compensation=pay, deadline=D.strict_date(F.substring("applicationDeadline", 1, 10)))


def sitemap_links(spark: SparkSession, path: str) -> DataFrame:
    """``url, reason`` of a host's sitemap: its links, or the reason why it has none: an index of other sitemaps is no empty site."""
    urls = spark.read.format("xml").option("rowTag", "url").schema("loc string").load(path)
    inner = spark.read.format("xml").option("rowTag", "sitemap").schema("loc string").load(path)
    links = urls.select(F.trim("loc").alias("url"), F.lit(None).cast("string").alias("reason")).where("url <> ''").distinct()
    return links.unionByName(inner.limit(1).select(F.lit(None).cast("string").alias("url"), F.lit("sitemap_index").alias("reason")))


def marked_postings(pages: DataFrame, org: str) -> DataFrame:
    """Postings of detail pages ``url, html`` by their marked-up title and blocks of description; pages without a title go."""
    plain = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " ")
    title = T.html_to_line(F.regexp_extract("html", r"""(?is)itemprop="title"[^>]*>\s*(.*?)\s*<""", 1))
    blocks = F.regexp_extract_all(plain, F.lit(r"""(?is)<(?:span|div|p)\b[^>]*itemprop="description"[^>]*>(.*?)</(?:span|div)>"""), F.lit(1))
    body = F.array_join(F.filter(F.transform(blocks, lambda b: T.html_to_text(b)), lambda b: b != ""), "\n\n")
    place = T.html_to_line(F.regexp_extract("html", r"""(?is)itemprop="(?:jobLocation|addressLocality)"[^>]*>(.*?)</""", 1))
    rows = pages.select("url", title.alias("t"), place.alias("w"), F.nullif(body, F.lit("")).alias("b"))
    key = F.coalesce(F.nullif(F.regexp_extract("url", r"/(\d+)/?(?:[?#].*)?$", 1), F.lit("")), _short_key(F.col("url")))
    return _shape(rows, org, external_id=key, title=F.col("t"), url=F.col("url"), location=F.nullif("w", F.lit("")), description=F.col("b"))


def with_fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first source's postings, and for employers of which it has none those of the second."""
    return first.unionByName(second.join(first.select("org").distinct(), "org", "left_anti").select(*first.columns))
