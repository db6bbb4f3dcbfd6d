"""Queries of connectors: rows of the given tables are landed as vendors' payloads in the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roleflow.plans.bindings import Registry
from roleflow.session import cut, ensure_checkpoint_dir, table
from roleflow.sources import boards  # noqa: F401  registers its connectors
from roleflow.sources import connectors as C
from roleflow.sources import landed as L

REGISTRY = Registry()
q = REGISTRY.add

#: Postings of a payload.
EACH = 50
NAMES = ("greenhouse", "lever", "ashby", "recruitee", "workable", "smartrecruiters", "oracle_hcm")
#: What stands around a vendor's list.
AROUND = {
    "greenhouse": ('{"jobs":[', "]}"), "lever": ("[", "]"), "ashby": ('{"jobs":[', "]}"), "recruitee": ('{"offers":[', "]}"), "workable": ('{"jobs":[', "]}"),
    "smartrecruiters": ('{"offset":0,"content":[', "]}"), "oracle_hcm": ('{"items":[{"requisitionList":[', "]}]}"),
}
#: A posting of each vendor: key, title, place and department come from the row.
ITEM = {
    "greenhouse": '{{"id":{k},"{title}":"{n}","absolute_url":"https://g.example/{k}","location":{place},"departments":[{{"name":"{s}"}}]}}',
    "lever": '{{"id":"{k}","{title_l}":"{n}","hostedUrl":"https://l.example/{k}","categories":{{"location":"{w}","team":"{s}"}},"descriptionPlain":"Text of {n}"}}',
    "ashby": '{{"{title}":"{n}","jobUrl":"https://a.example/{k}","location":"{w}","team":"{s}","descriptionPlain":"","descriptionHtml":"<p>Text of <b>{n}</b></p>"}}',
    "recruitee": '{{"id":{k},"{title}":"{n}","careers_url":"https://r.example/{k}","location":"{w}","department":"{s}"}}',
    "workable": '{{"shortcode":"W{k}","{title}":"{n}","url":"https://w.example/{k}","city":"{w}","department":"{s}"}}',
    "smartrecruiters": '{{"id":"{k}","{title_s}":"{n}","company":{{"identifier":"acme"}},"location":{{"fullLocation":"{w}"}},"department":{{"label":"{s}"}}}}',
    "oracle_hcm": '{{"Id":"{k}","{title_o}":"{n}","PrimaryLocation":"{w}"}}',
}


def _filled(template: str, drift: bool) -> Column:
    """The template with the row's values; with ``drift`` some places have another type and some titles another name."""
    key, bent = F.col("k").cast("string"), F.lit(drift) & (F.col("k") % 7 == 0)
    lost = F.lit(drift) & (F.col("k") % 11 == 0)
    named = lambda name: F.when(lost, "renamed").otherwise(name)
    place = F.when(bent, F.concat(F.lit('"'), "w", F.lit('"'))).otherwise(F.concat(F.lit('{"name":"'), "w", F.lit('"}')))
    values = {"k": key, "n": F.col("n"), "s": F.col("s"), "w": F.col("w"), "place": place, "title": named("title"), "title_l": named("text"), "title_s": named("name"), "title_o": named("Title")}
    parts = template.replace("{{", "\x01").replace("}}", "\x02").split("{")
    out = [F.lit(parts[0])]
    for part in parts[1:]:
        name, _, rest = part.partition("}")
        out += [values[name], F.lit(rest)]
    return F.translate(F.concat(*out), "\x01\x02", "{}")


#: Further vendors: what stands around the list, and a posting.
MORE = {
    "pinpoint": ('{"data":[', "]}", '{{"id":"{k}","title":"{n}","url":"https://p.example/{k}","compensation":"Pay {k}","compensation_visible":true,"workplace_type_text":"Hybrid","location":{{"name":"{w}"}},"job":{{"department":{{"name":"{s}"}}}}}}'),
    "adp": ('{"jobRequisitions":[', "]}", '{{"itemID":"{k}","requisitionTitle":"{n}","payGradeRange":{{"minimumRate":{{"amountValue":10,"currencyCode":"USD"}},"maximumRate":{{"amountValue":20}}}},"requisitionLocations":[{{"nameCode":{{"shortName":"{w}"}}}}]}}'),
    "workday": ('{"total":9,"jobPostings":[', "]}", '{{"title":"{n}","externalPath":"/job/{w}/R-{k}","locationsText":"{w}"}}'),
    "bamboohr": ('{"result":[', "]}", '{{"id":"{k}","jobOpeningName":"{n}","location":{{"city":"{w}","state":"ST"}},"isRemote":true,"departmentLabel":"{s}"}}'),
    "amazon": ('{"hits":9,"jobs":[', "]}", '{{"title":"{n}","id_icims":"{k}","job_path":"/en/jobs/{k}","location":"{w}","job_category":"{s}"}}'),
    "apple": ('{"searchResults":[', "]}", '{{"postingTitle":"{n}","positionId":"{k}","team":{{"teamName":"{s}"}},"locations":[{{"name":"{w}"}},{{"city":"X"}}]}}'),
    "idealist": ('{"hits":[', "]}", '{{"objectID":"{k}","name":"{n}","orgName":"Org {s}","url":{{"en":"/j/{k}"}},"locationType":"REMOTE","remoteZone":"WORLD","country":"NO","functions":["A","B"],"salaryMinimum":1000,"salaryMaximum":2000,"salaryCurrency":"EUR","salaryPeriod":"MONTH"}}'),
    "tagged_index": ('{"hits":[', "]}", '{{"objectID":"{k}","title":"{n}","org":{{"name":"Org {s}"}},"url_external":"https://t.example/{k}","locations":[{{"name":"{w}"}}],"tags_area":[{{"name":"{s}"}}],"has_salary":false,"salary_text":"x"}}'),
    "fastforward": ('{"results":{"count":9,"jobs":[', "]}}", '{{"id":{k},"title":"{n}  Featured","url":"https://f.example/{k}","organization":{{"name":"Org {s}"}},"locations":[{{"name":"{w}"}}],"work_mode":"remote","compensation_amount_min_cents":100000,"compensation_amount_max_cents":200000,"compensation_public":true,"compensation_period":"month"}}'),
    "search_index": ('{"nbHits":9,"hits":[', "]}", '{{"objectID":"{k}","title":"{n}","company_name":"Org {s}","url":"https://s.example/{k}","tags_city":["{w}"],"tags_country":["NO"]}}'),
    "wordpress_jobs": ("[", "]", '{{"id":{k},"link":"https://wp.example/{k}","title":{{"rendered":"{n}"}},"detail":{{"employer":"Org {s}","location":"{w}","salary":"5"}}}}'),
}


def _payloads(spark, sf: str, drift: bool, names=NAMES, around=AROUND, item=ITEM) -> DataFrame:
    """``source, day, value``: the employers of the table as postings, so many a payload; with ``drift`` some payloads are broken."""
    rows = table(spark, sf, "customer").selectExpr("c_custkey AS k", "c_name AS n", "c_mktsegment AS s", "concat('City ', c_nationkey) AS w", f"c_custkey DIV {EACH} AS p")
    kind = lambda m: {n: F.lit(m[n]) for n in names}

    def of(values: dict[str, Column]) -> Column:
        out = F.lit(None).cast("string")
        for i, name in enumerate(names):
            out = F.when(F.col("p") % len(names) == i, values[name]).otherwise(out)
        return out

    items = rows.select("p", "k", of({n: _filled(item[n], drift) for n in names}).alias("item"))
    lists = items.groupBy("p").agg(F.array_sort(F.collect_list(F.struct("k", "item"))).alias("items"))
    value = F.concat(of(kind({n: around[n][0] for n in names})), F.array_join(F.transform("items", lambda x: x["item"]), ","), of(kind({n: around[n][1] for n in names})))
    if drift:
        value = F.when(F.col("p") % 13 == 5, F.substring(value, 1, 40)).when(F.col("p") % 13 == 6, '{"status":503}').when(F.col("p") % 13 == 8, '{"other":[]}').otherwise(value)
    day = F.date_add(F.lit("2026-01-01").cast("date"), (F.col("p") % 3).cast("int"))
    return lists.select(of(kind({n: n for n in names})).alias("source"), day.alias("day"), value.alias("value"))


def _land(spark, sf: str, drift: bool, **kinds) -> str:
    folder = f"{ensure_checkpoint_dir(spark)}/landed-{uuid.uuid4().hex}"
    _payloads(spark, sf, drift, **kinds).write.option("maxRecordsPerFile", 1).partitionBy("source", "day").text(folder)
    return folder


_SOURCES = f"""p AS (SELECT c_custkey AS k, c_name AS n, c_mktsegment AS s, concat('City ', c_nationkey) AS w, c_custkey // {EACH} AS p,
  ['{"', '".join(NAMES)}'][CAST((c_custkey // {EACH}) % {len(NAMES)} AS INT) + 1] AS source FROM customer)"""
_ROW = """source, CASE source WHEN 'workable' THEN 'W' || k WHEN 'ashby' THEN substring(md5('https://a.example/' || k), 1, 12) ELSE CAST(k AS VARCHAR) END AS external_id, n AS title,
  CASE source WHEN 'smartrecruiters' THEN {smart} WHEN 'oracle_hcm' THEN NULL ELSE 'https://' || source[1:1] || '.example/' || k END AS url,
  {place} AS location, CASE WHEN source <> 'oracle_hcm' THEN s END AS department, CASE WHEN source IN ('lever', 'ashby') THEN {text} END AS description"""


@q(
    f"""WITH {_SOURCES} SELECT {_ROW.format(smart='NULL', place="CASE WHEN NOT (source = 'greenhouse' AND k % 7 = 0) THEN w END", text="'Text of ' || n")}
FROM p WHERE k % 11 <> 0 AND p.p % 13 NOT IN (5, 6, 8)"""
)
def landed_postings(spark, sf):
    """Through the data source: payloads as VARIANT, of which some are broken, and fields of which some have drifted."""
    return cut(L.postings(L.landed(spark, _land(spark, sf, drift=True))).drop("org"))


@q(
    f"""WITH {_SOURCES} SELECT source, DATE '2026-01-01' + CAST(p % 3 AS INT) AS day, count(DISTINCT p) AS files, count(DISTINCT p) FILTER (WHERE p % 13 IN (5, 6, 8)) AS failed,
count(DISTINCT p) FILTER (WHERE p % 13 = 6) AS refused FROM p GROUP BY ALL"""
)
def landed_failures(spark, sf):
    payloads = L.landed(spark, _land(spark, sf, drift=True))
    refused = payloads.groupBy("source", "day").agg(F.count_if(F.col("reason") == "http_503").alias("refused"))
    return cut(L.failures(payloads).join(refused, ["source", "day"]).select("source", "day", "files", "failed", "refused"))


@q(f"WITH {_SOURCES} SELECT {_ROW.format(smart="'https://jobs.smartrecruiters.com/acme/' || k", place='w', text="'Text of ' || n")} FROM p")
def vendor_postings(spark, sf):
    """Through the vendors' own connectors."""
    folder, out = _land(spark, sf, drift=False), None
    there = {r["source"] for r in spark.read.text(folder, wholetext=True).select("source").distinct().collect()}
    for name in NAMES:
        if name in there:
            part = C.REGISTRY[name](spark, f"{folder}/source={name}", "Acme").select(F.lit(name).alias("source"), "external_id", "title", "url", "location", "department", F.nullif("description", F.lit("")).alias("description"))
            out = part if out is None else out.unionByName(part)
    return cut(out)


_ORG = "CASE WHEN source IN ('idealist', 'tagged_index', 'fastforward', 'search_index', 'wordpress_jobs') THEN 'Org ' || s ELSE 'Acme' END"


@q(
    f"""WITH p AS (SELECT c_custkey AS k, c_name AS n, c_mktsegment AS s, concat('City ', c_nationkey) AS w, ['{"', '".join(MORE)}'][CAST((c_custkey // {EACH}) % {len(MORE)} AS INT) + 1] AS source FROM customer)
SELECT source, {_ORG} AS org, CASE source WHEN 'workday' THEN 'R-' || k ELSE CAST(k AS VARCHAR) END AS external_id, n AS title,
CASE source WHEN 'pinpoint' THEN 'https://p.example/' || k WHEN 'workday' THEN '/job/' || w || '/R-' || k WHEN 'amazon' THEN 'https://www.amazon.jobs/en/jobs/' || k WHEN 'apple' THEN 'https://jobs.apple.com/en-us/details/' || k WHEN 'idealist' THEN 'https://www.idealist.org/j/' || k
  WHEN 'tagged_index' THEN 'https://t.example/' || k WHEN 'fastforward' THEN 'https://f.example/' || k WHEN 'search_index' THEN 'https://s.example/' || k WHEN 'wordpress_jobs' THEN 'https://wp.example/' || k END AS url,
CASE source WHEN 'pinpoint' THEN 'Hybrid, ' || w WHEN 'bamboohr' THEN 'Remote, ' || w || ', ST' WHEN 'apple' THEN w || ', X' WHEN 'idealist' THEN 'Remote, worldwide, NO' WHEN 'fastforward' THEN 'Remote, ' || w ELSE w END AS location,
CASE WHEN source IN ('pinpoint', 'bamboohr', 'amazon', 'apple', 'tagged_index') THEN s WHEN source = 'idealist' THEN 'A, B' END AS department,
CASE source WHEN 'pinpoint' THEN 'Pay ' || k WHEN 'adp' THEN '10–20 USD' WHEN 'idealist' THEN 'EUR 1,000–2,000/month' WHEN 'fastforward' THEN 'USD 1,000–2,000/month' WHEN 'wordpress_jobs' THEN '5' END AS compensation FROM p"""
)
def board_postings(spark, sf):
    """Through the connectors of further vendors and boards."""
    kinds = {"names": tuple(MORE), "around": {n: v[:2] for n, v in MORE.items()}, "item": {n: v[2] for n, v in MORE.items()}}
    folder, out = _land(spark, sf, drift=False, **kinds), None
    there = {r["source"] for r in spark.read.text(folder, wholetext=True).select("source").distinct().collect()}
    for name in MORE:
        if name in there:
            part = C.REGISTRY[name](spark, f"{folder}/source={name}", "Acme").select(F.lit(name).alias("source"), "org", "external_id", "title", "url", "location", "department", "compensation")
            out = part if out is None else out.unionByName(part)
    return cut(out)
