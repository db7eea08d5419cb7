"""Captured API responses: selection (S3) and schema-free JSON harvest.

Captured table: ``rid bigint, url string, status int, headers map<string,string>, body string``.

S2 walks every JSON document to depth 5 with five unrolled explode steps over
VARIANT values (no recursion, no Python): each level is a narrow generator over
the previous one, and every object node is tested with the reference's rule:

* url = first truthy of ``url``, ``link``, ``href``; title = first truthy of
  ``title``, ``name``, ``heading``;
* a row is emitted when both are strings, the url starts with ``http`` and the
  title is longer than 5 characters;
* body = ``snippet`` when that key exists, else ``description``, else "".

Nodes are ordered by their position path (pre-order).  VARIANT keeps object keys
sorted, so siblings of an object come in key order rather than insertion order
(stated difference); a JSON null snippet gives "" (the reference writes "None").
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsprism.functions.text import any_phrase
from newsprism.functions.urls import log_domain
from newsprism.plans.articles import first_paragraph, page_title
from newsprism.sources.tables import read_table

# Url fragments that mark an API response, and the walk depth.
API_PATTERNS = ["/search", "/complete/search", "suggest", "/api/", "/_next/data", "/v1/search", "/graphql"]
MAX_DEPTH = 5
MIN_TITLE_CHARS = 5


def is_api_response(url: Column, status: Column, headers: Column) -> Column:
    """S3: status 200, content-type with ``json`` or ``javascript``, url with an API pattern."""
    ctype = F.coalesce(F.try_element_at(headers, F.lit("content-type")), F.lit(""))
    return (status == 200) & (F.contains(ctype, F.lit("json")) | F.contains(ctype, F.lit("javascript"))) & any_phrase(url, API_PATTERNS)


def _vtype(x: Column) -> Column:
    return F.schema_of_variant(x)


def _truthy(x: Column, t: Column | None = None) -> Column:
    t = _vtype(x) if t is None else t
    return (F.when(x.isNull(), F.lit(False))
            .when(t == "VOID", F.lit(False))
            .when(t == "STRING", F.length(F.try_variant_get(x, "$", "string")) > 0)
            .when(t == "BOOLEAN", F.try_variant_get(x, "$", "boolean"))
            .when(t.startswith("ARRAY"), F.size(F.try_variant_get(x, "$", "array<variant>")) > 0)
            .when(t.startswith("OBJECT"), t != "OBJECT<>")
            .otherwise(F.coalesce(F.try_variant_get(x, "$", "double") != 0, F.lit(False))))


def _field(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def _as_text(x: Column) -> Column:
    return F.when(x.isNull() | (_vtype(x) == "VOID"), F.lit("")).otherwise(
        F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x)))


def _is_node(x: Column) -> Column:
    return _vtype(x).startswith("OBJECT") | _vtype(x).startswith("ARRAY")


def _children(v: Column) -> Column:
    """Children of an object (values in key order) or of an array, as array<variant>."""
    return F.coalesce(F.map_values(F.try_variant_get(v, "$", "map<string,variant>")),
                      F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def walk(docs: DataFrame) -> DataFrame:
    """All object/array nodes to depth 5: ``rid, path array<int>, v variant``.

    One generator per level over the previous level only: finished nodes pass
    through, pending ones expand into themselves plus their container children,
    so the plan is a straight chain (the documents are read once).
    """
    node = "struct<path:array<int>,v:variant,done:boolean>"
    cur = docs.select("rid", F.struct(F.array().cast("array<int>").alias("path"), F.col("v"),
                                      F.lit(False).alias("done")).cast(node).alias("n")).filter(_is_node(F.col("n.v")))
    for _ in range(MAX_DEPTH):
        n = F.col("n")
        kids = F.transform(_children(n["v"]), lambda c, i: F.struct(
            F.concat(n["path"], F.array(i.cast("int"))).alias("path"), c.alias("v"), F.lit(False).alias("done")))
        kids = F.filter(kids, lambda k: _is_node(k["v"]))
        step = F.when(n["done"], F.array(n)).otherwise(
            F.concat(F.array(n.withField("done", F.lit(True))), kids.cast(f"array<{node}>")))
        cur = cur.select("rid", F.explode(step).alias("n"))
    return cur.select("rid", F.col("n.path").alias("path"), F.col("n.v").alias("v"))


def harvest(captured: DataFrame, as_of: Column, select_api: bool = True) -> DataFrame:
    """S2 (after S3): article rows found anywhere in the captured JSON documents."""
    if select_api:
        captured = captured.filter(is_api_response(F.col("url"), F.col("status"), F.col("headers")))
    docs = captured.select("rid", F.try_parse_json("body").alias("v")).filter(F.col("v").isNotNull())
    nodes = walk(docs).filter(_vtype(F.col("v")).startswith("OBJECT"))
    # staged so that every candidate field and its type are computed once per node
    keys = ["url", "link", "href", "title", "name", "heading"]
    nodes = nodes.select("rid", "path", *[_field(F.col("v"), k).alias(f"_{k}") for k in keys + ["snippet", "description"]])
    nodes = nodes.select("*", *[_vtype(F.col(f"_{k}")).alias(f"_t_{k}") for k in keys])
    nodes = nodes.select("rid", "path", "_snippet", "_description", *[c for k in keys for c in (f"_{k}", f"_t_{k}")],
                         *[_truthy(F.col(f"_{k}"), F.col(f"_t_{k}")).alias(f"_ok_{k}") for k in keys])

    def first(ks):
        val = F.coalesce(*[F.when(F.col(f"_ok_{k}"), F.col(f"_{k}")) for k in ks])
        typ = F.coalesce(*[F.when(F.col(f"_ok_{k}"), F.col(f"_t_{k}")) for k in ks])
        return F.when(typ == "STRING", F.try_variant_get(val, "$", "string"))
    snip, desc = F.col("_snippet"), F.col("_description")
    body = F.when(snip.isNotNull(), _as_text(snip)).when(desc.isNotNull(), _as_text(desc)).otherwise(F.lit(""))
    rows = nodes.select("rid", "path", first(["url", "link", "href"]).alias("url"),
                        first(["title", "name", "heading"]).alias("title"), body.alias("body"))
    rows = rows.filter(F.col("url").startswith("http") & (F.length("title") > MIN_TITLE_CHARS))
    return rows.select(
        "rid", "path", "url", "title", log_domain(F.col("url")).alias("source"), as_of.alias("date"), "body",
        F.lit(1).alias("page"), F.lit(0).alias("position"), F.lit(0).alias("overall_position"),
        F.lit("").alias("article_text"), F.lit("api_interception").alias("source_type"))


# --- captured responses built by Spark from ``pages`` -----------------------------

def pages_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four payload shapes per page id (flat, array, deep, blocked by a numeric url),
    four request kinds and a few non-JSON or non-200 captures."""
    p = read_table(spark, sf_dir, "pages")
    pid = F.col("page_id")
    shape = F.pmod(pid, F.lit(4))
    title = page_title(F.col("html"))
    para = first_paragraph(F.col("html"))
    url = F.col("url")
    flat = F.to_json(F.struct(url.alias("url"), title.alias("title"), para.alias("snippet")))
    item = "struct<link:string,name:string,description:string,href:string,title:string>"
    arr = F.to_json(F.struct(F.array(
        F.struct(url.alias("link"), title.alias("name"), para.alias("description"),
                 F.lit(None).cast("string").alias("href"), F.lit(None).cast("string").alias("title")).cast(item),
        F.struct(F.lit(None).cast("string").alias("link"), F.lit(None).cast("string").alias("name"),
                 F.lit(None).cast("string").alias("description"), F.lit("javascript:void(0)").alias("href"),
                 title.alias("title")).cast(item)).alias("results")))
    e = F.struct(url.alias("url"), title.alias("title"), F.struct(url.alias("url"), title.alias("title")).alias("f"))
    deep = F.to_json(F.struct(F.struct(F.struct(F.struct(F.struct(e.alias("e")).alias("d")).alias("c")).alias("b"))
                              .alias("a")))
    numeric = F.to_json(F.struct(F.struct(F.array(F.struct(pid.alias("url"), url.alias("link"), title.alias("title")))
                                          .alias("items"), F.lit("short").alias("title")).alias("data")))
    body = (F.when(shape == 0, flat).when(shape == 1, arr).when(shape == 2, deep).otherwise(numeric))
    lang = F.regexp_extract(url, r"^[a-z]+://[^/]+/([a-z]{2})/", 1)
    req = (F.when(shape == 0, F.concat(F.lit("https://www.google.com/complete/search?q="), lang))
           .when(shape == 1, F.concat(F.lit("https://news.example.com/API/v2/items?page="), pid.cast("string")))
           .when(shape == 2, F.concat(F.lit("https://www.example.com/_next/data/"), pid.cast("string"), F.lit(".json")))
           .otherwise(F.lit("https://cdn.example.com/static/app.js")))
    ctype = (F.when(F.pmod(pid, F.lit(5)) == 0, F.lit("text/html; charset=utf-8"))
             .when(F.pmod(pid, F.lit(5)) == 1, F.lit("application/javascript"))
             .otherwise(F.lit("application/json")))
    status = F.when(F.pmod(pid, F.lit(7)) == 0, F.lit(404)).otherwise(F.lit(200))
    return p.select(pid.alias("rid"), req.alias("url"), status.alias("status"),
                    F.create_map(F.lit("content-type"), ctype).alias("headers"), body.alias("body"))
