"""The queries over the driver's tables and their SQL.

Documents and pages stand for files, region > nation > customer > order for the tree of
owners, line items for references to parts and suppliers, benchmark passages for
claims that need evidence, and events for the log of an inventory.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.functions import text as tx
from gneiss.functions.ids import stable_id
from gneiss.operators import changes, classify, coverage, documents, evidence, graph, parse, resolve, rollup
from gneiss.plans import bundle, scan, validation
from gneiss.storage import materialize, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    importlib.import_module("gneiss.catalogue_files")  # adds its own
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLES)


# --- views -----------------------------------------------------------------

MAX_BYTES = 8000
LANGUAGES = ["markdown", "python", "go"]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files; the language gives the extension."""
    ext = F.when(F.col("lang") == "en", "md").when(F.col("lang") == "de", "py").when(F.col("lang") == "fr", "rs").otherwise("dat")
    path = F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit("."), ext)
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", path.alias("path"), F.col("text").alias("content"), F.octet_length("text").cast("long").alias("size"))


FILES_SQL = """files AS (
  SELECT doc_id, source, lang, text AS content, CAST(strlen(text) AS BIGINT) AS size,
         source || '/doc_' || doc_id || '.' || CASE lang WHEN 'en' THEN 'md' WHEN 'de' THEN 'py' WHEN 'fr' THEN 'rs' ELSE 'dat' END AS path
  FROM documents
), classified AS (
  SELECT *, CASE WHEN size > 8000 THEN 'excluded' WHEN contains(content, chr(0)) THEN 'excluded'
                 WHEN lang NOT IN ('en', 'de', 'fr') THEN 'unresolved' WHEN lang = 'fr' THEN 'excluded' ELSE 'included' END AS disposition,
         CASE WHEN size > 8000 THEN 'too_large' WHEN contains(content, chr(0)) THEN 'binary'
              WHEN lang NOT IN ('en', 'de') THEN 'unsupported' END AS reason,
         CASE WHEN size > 8000 OR contains(content, chr(0)) THEN NULL WHEN lang = 'en' THEN 'markdown' WHEN lang = 'de' THEN 'python' WHEN lang = 'fr' THEN 'rust' END AS language
  FROM files
)"""


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.disposition(files(spark, sf_dir), MAX_BYTES, LANGUAGES)


def owner_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions own nations, nations customers, customers orders."""
    name = lambda kind, key: F.concat(F.lit(kind + ":"), F.col(key).cast("string"))
    none = F.lit(None).cast("string")
    region = table(spark, sf_dir, "region").select(name("region", "r_regionkey").alias("id"), F.lit("region").alias("kind"), none.alias("owner_id"))
    nation = table(spark, sf_dir, "nation").select(name("nation", "n_nationkey"), F.lit("nation"), name("region", "n_regionkey"))
    customer = table(spark, sf_dir, "customer").select(name("customer", "c_custkey"), F.lit("customer"), name("nation", "c_nationkey"))
    order = table(spark, sf_dir, "orders").select(name("order", "o_orderkey"), F.lit("order"), name("customer", "o_custkey"))
    return region.union(nation).union(customer).union(order)


NODES_SQL = """nodes AS (
  SELECT 'region:' || r_regionkey AS id, 'region' AS kind, CAST(NULL AS VARCHAR) AS owner_id FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation', 'region:' || n_regionkey FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'customer', 'nation:' || c_nationkey FROM customer
  UNION ALL SELECT 'order:' || o_orderkey, 'order', 'customer:' || o_custkey FROM orders
)"""


# --- files, coverage, identity ----------------------------------------------


@query(f"""WITH {FILES_SQL}
SELECT source, count(*) FILTER (disposition = 'included') AS included, count(*) FILTER (disposition = 'excluded') AS excluded,
       count(*) FILTER (disposition = 'unresolved') AS unresolved,
       round(CASE WHEN count(*) FILTER (disposition IN ('included', 'unresolved')) = 0 THEN 1.0
             ELSE count(*) FILTER (disposition = 'included') / count(*) FILTER (disposition IN ('included', 'unresolved')) END, 6) AS ratio
FROM classified GROUP BY source""")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by disposition and the ratio of each source."""
    return coverage.coverage_counts(classified(spark, sf_dir), "source")


@query(f"WITH {FILES_SQL} SELECT path, size, disposition, reason, language FROM classified")
def file_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select("path", "size", "disposition", "reason", "language")


@query("SELECT lang, count(*) AS n_files, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes FROM documents GROUP BY lang")
def language_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("n_bytes"))


@query(f"WITH {FILES_SQL} SELECT path, sha256(content) AS content_hash FROM files")
def content_hash_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("path", F.sha2("content", 256).alias("content_hash"))


def _frame_sql(x: str) -> str:
    bytes_ = " || ".join(f"lpad(hex((strlen({x}) >> {8 * i}) & 255), 2, '0')" for i in range(8))
    return f"unhex({bytes_}) || encode({x})"


@query(f"""WITH {FILES_SQL}
SELECT path, 'entity:' || substr(sha256({_frame_sql("'file'")} || {_frame_sql("path")}), 1, 24) AS entity_id,
       'cov:' || substr(sha256({_frame_sql("'file'")} || {_frame_sql("path")} || {_frame_sql("lang")}), 1, 24) AS item_id
FROM files""")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("path", stable_id("entity", F.lit("file"), F.col("path")).alias("entity_id"), stable_id("cov", F.lit("file"), F.col("path"), F.col("lang")).alias("item_id"))


@query("""WITH cut AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
SELECT doc_id, line, start_byte, CAST(start_byte + strlen(content) AS BIGINT) AS end_byte FROM (
  SELECT doc_id, CAST(line AS BIGINT) AS line, content,
         CAST(coalesce(sum(strlen(content) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_byte
  FROM cut)""")
def line_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.lines(table(spark, sf_dir, "documents"), "doc_id", "text").drop("content")


@query(r"""WITH t AS (SELECT page_id, string_split(regexp_replace(html, '<h1>([^<]*)</h1>', chr(10) || '# \1' || chr(10), 'g'), chr(10)) AS l FROM pages),
lines AS (SELECT page_id, unnest(l) AS c, generate_subscripts(l, 1) AS line FROM t),
found AS (SELECT page_id, CAST(line AS BIGINT) AS line, regexp_extract(ltrim(c), '^(#{1,6})[ \t]', 1) AS marks, ltrim(c) AS c FROM lines)
SELECT page_id, line, CAST(length(marks) AS INTEGER) AS level, trim(regexp_replace(trim(substr(c, length(marks) + 1)), '#+$', '')) AS title FROM found
WHERE marks <> '' AND trim(regexp_replace(trim(substr(c, length(marks) + 1)), '#+$', '')) <> ''""")
def heading_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of pages whose titles are written as Markdown."""
    text = F.regexp_replace("html", "<h1>([^<]*)</h1>", "\n# $1\n")
    return evidence.headings(table(spark, sf_dir, "pages").select("page_id", text.alias("text")), "page_id", "text").select("page_id", "line", "level", "title")


@query(r"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '<a href="([^"]*)">', '[](\1)', 'g'), '\]\(\s*<?([^)\s>]+)', 1)) AS specifier FROM pages)
SELECT page_id, specifier, count(*) AS n FROM t GROUP BY ALL""")
def href_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages whose anchors are written as Markdown."""
    text = F.regexp_replace("html", '<a href="([^"]*)">', "[]($1)")
    found = documents.links(table(spark, sf_dir, "pages").select("page_id", text.alias("text")), "page_id", "text")
    return found.groupBy("page_id", F.col("target").alias("specifier")).agg(F.count(F.lit(1)).alias("n"))


def _hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("specifier"))


PATH_SQL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '/+$', ''), '\\.html$', '')"


@query(f"""WITH k AS (SELECT page_id, {PATH_SQL} AS key FROM pages)
SELECT key, count(*) AS n_candidates, CASE WHEN count(DISTINCT page_id) = 1 THEN 'resolved' ELSE 'ambiguous' END AS status,
       CASE WHEN count(DISTINCT page_id) = 1 THEN min(page_id) END AS target FROM k GROUP BY key""")
def url_path_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", tx.reference_key(F.col("url")).alias("key"))
    return resolve.resolve_by_key(pages.select("key").distinct(), pages, ["key"], "page_id").select("key", "n_candidates", "status", "target")


@query(f"""WITH known AS (SELECT DISTINCT {PATH_SQL} AS key FROM pages),
links AS (SELECT page_id, regexp_replace(unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)), '/+$', '') AS key FROM pages)
SELECT page_id, count(*) AS n_broken FROM links WHERE key NOT IN (SELECT key FROM known) GROUP BY page_id""")
def broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "pages").select(tx.reference_key(F.col("url")).alias("key"))
    links = _hrefs(spark, sf_dir).select("page_id", F.regexp_replace("specifier", "/+$", "").alias("key"))
    return resolve.without(links, known, ["key"]).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_broken"))


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host,
  list_filter(string_split(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '/'), lambda x: x <> '' AND x <> '.') AS parts FROM pages),
f AS (SELECT page_id, host, list_reduce(list_prepend(['/'], list_transform(parts, lambda x: [x])),
  lambda a, x: CASE WHEN a[1] = '!' THEN a WHEN x[1] = '..' THEN CASE WHEN len(a) = 1 THEN ['!'] ELSE a[:-2] END ELSE list_concat(a, x) END) AS folded FROM p)
SELECT page_id, host, CASE WHEN folded[1] = '/' THEN array_to_string(folded[2:], '/') END AS path FROM f""")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", tx.url_host(url).alias("host"), tx.fold_dots(tx.url_path(url)).alias("path"))


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '://([^?#]*)', 1) AS path FROM pages)
SELECT page_id, path, len(list_filter(string_split(path, '/'), lambda x: starts_with(x, '.') AND x NOT IN ('.', '..'))) > 0 AS hidden,
       string_split(path, '/')[1] IN ('.git', 'target', 'node_modules') AS internal FROM p""")
def hidden_internal_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^?#]*)", 1).alias("path"))
    return pages.select("page_id", "path", classify.is_hidden(F.col("path")).alias("hidden"), classify.is_internal(F.col("path")).alias("internal"))


@query(f"WITH k AS (SELECT page_id, lower({PATH_SQL}) AS portable FROM pages) SELECT portable, count(DISTINCT page_id) AS n_names FROM k GROUP BY portable HAVING count(DISTINCT page_id) > 1")
def portable_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", tx.reference_key(F.col("url")).alias("path"))
    return evidence.collisions(pages, tx.portable_id(F.col("path")), "page_id")


# --- keys and references -----------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.repeated(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


_LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {", ".join(_LINE_ORDER)}) = 1""")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.first_per_key(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], _LINE_ORDER).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


DANGLING = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("orders", "o_orderkey", "lineitem", "l_orderkey"), ("customer", "c_custkey", "orders", "o_custkey"), ("part", "p_partkey", "lineitem", "l_partkey")]


@query(" UNION ALL ".join(f"SELECT '{a}.{x}' AS rule, count(DISTINCT {x}) AS violations FROM {a} WHERE {x} NOT IN (SELECT {y} FROM {b})" for a, x, b, y in DANGLING))
def dangling_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for a, x, b, y in DANGLING:
        one = resolve.dangling(table(spark, sf_dir, a), x, table(spark, sf_dir, b), y, f"{a}.{x}")
        out = one if out is None else out.unionByName(one)
    return out


_NAME = ["p_name", "p_brand", "p_type"]


def _named_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items that refer to their part by name, brand and type."""
    part = table(spark, sf_dir, "part").select("p_partkey", *_NAME)
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    refs = line.join(part, line["l_partkey"] == part["p_partkey"]).select("l_orderkey", "l_linenumber", *_NAME)
    return resolve.resolve_by_key(refs, part, _NAME, "p_partkey")


REFS_SQL = """known AS (SELECT p_name, p_brand, p_type, count(DISTINCT p_partkey) AS n_candidates, min(p_partkey) AS target FROM part GROUP BY ALL),
refs AS (SELECT l_orderkey, l_linenumber, n_candidates, CASE WHEN n_candidates = 1 THEN 'resolved' ELSE 'ambiguous' END AS status,
                CASE WHEN n_candidates = 1 THEN target END AS target, p_brand
         FROM lineitem JOIN part ON l_partkey = p_partkey JOIN known USING (p_name, p_brand, p_type))"""


@query("""WITH known AS (SELECT p_name, p_brand, p_type, count(DISTINCT p_partkey) AS n_candidates, min(p_partkey) AS target FROM part GROUP BY ALL)
SELECT p_name, p_brand, p_type, n_candidates, CASE WHEN n_candidates = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN n_candidates = 1 THEN target END AS target FROM known""")
def resolve_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", *_NAME)
    return resolve.resolve_by_key(part.select(*_NAME).distinct(), part, _NAME, "p_partkey").select(*_NAME, "n_candidates", "status", "target")


PASSAGES_SQL = "passages AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


@query(f"""WITH {PASSAGES_SQL}, n AS (SELECT item_id, count(doc_id) AS n_documents FROM benchmark LEFT JOIN passages USING (item_id) GROUP BY item_id)
SELECT item_id, n_documents, CASE n_documents WHEN 0 THEN 'unresolved' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM n""")
def resolution_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id")
    out = resolve.resolve_by_key(items, _contained(spark, sf_dir), ["item_id"], "doc_id")
    return out.select("item_id", F.col("n_candidates").alias("n_documents"), "status")


def _contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, doc_id) of documents that hold a whole passage anywhere."""
    return resolve.containing(table(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "benchmark"), "item_id")


@query(f"""WITH {REFS_SQL} SELECT p_brand, count(*) AS total, count(*) FILTER (status = 'resolved') AS resolved, CAST(0 AS BIGINT) AS external,
 count(*) FILTER (status = 'ambiguous') AS ambiguous, CAST(0 AS BIGINT) AS unresolved FROM refs GROUP BY p_brand""")
def semantic_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.semantic_coverage(_named_refs(spark, sf_dir), "p_brand")


@query(f"WITH {REFS_SQL} SELECT l_orderkey, l_linenumber, target, count(*) AS n FROM refs WHERE status = 'resolved' GROUP BY ALL")
def resolved_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolved_edges(_named_refs(spark, sf_dir)).groupBy("l_orderkey", "l_linenumber", "target").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, coalesce('nation:' || c_nationkey, 'customer:' || o_custkey) AS target FROM orders
LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) ON o_custkey = c_custkey""")
def retarget_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("target"))
    moves = table(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("k"), F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")).alias("new_target"))
    return resolve.retarget(edges, moves, ["k"]).select("o_orderkey", "target")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def anti_remove_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return resolve.without(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), failed, ["o_orderkey"])


@query("""WITH bad AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_discount >= 0.1)
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'excluded' WHEN l_orderkey IS NOT NULL THEN 'unresolved' ELSE 'included' END AS disposition,
       CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN l_orderkey IS NOT NULL THEN 'discount' END AS reason
FROM orders LEFT JOIN bad ON o_orderkey = l_orderkey""")
def coverage_downgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = F.col("o_orderstatus") == "P"
    items = table(spark, sf_dir, "orders").select("o_orderkey", F.when(pending, "excluded").otherwise("included").alias("disposition"), F.when(pending, "pending").alias("reason"))
    failed = table(spark, sf_dir, "lineitem").where("l_discount >= 0.1").select(F.col("l_orderkey").alias("o_orderkey"))
    return coverage.downgrade(items, failed, "o_orderkey", "discount")


# --- ownership and graphs ----------------------------------------------------

CHAIN_SQL = f"""{NODES_SQL}, chain AS (
  SELECT id, id AS ancestor_id, CAST(0 AS BIGINT) AS depth FROM nodes
  UNION ALL SELECT c.id, n.owner_id, c.depth + 1 FROM chain c JOIN nodes n ON c.ancestor_id = n.id WHERE n.owner_id IS NOT NULL
)"""


@query(f"WITH RECURSIVE {CHAIN_SQL} SELECT id, ancestor_id, depth FROM chain")
def owner_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.owner_chain(owner_nodes(spark, sf_dir))


@query(f"WITH RECURSIVE {CHAIN_SQL} SELECT id, arg_max(ancestor_id, depth) AS root_id, max(depth) AS depth FROM chain GROUP BY id")
def root_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.roots(owner_nodes(spark, sf_dir))


TRADE_SQL = "trade AS (SELECT DISTINCT c_nationkey AS source, s_nationkey AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that buy from nations."""
    line, orders, customer, supplier = (table(spark, sf_dir, x) for x in ("lineitem", "orders", "customer", "supplier"))
    out = line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return out.select(F.col("c_nationkey").alias("source"), F.col("s_nationkey").alias("target"), "l_orderkey", "l_linenumber")


@query(f"""WITH RECURSIVE {TRADE_SQL}, far AS (SELECT source, target FROM trade UNION SELECT f.source, t.target FROM far f JOIN trade t ON f.target = t.source),
cyclic AS (SELECT source AS n FROM far WHERE source = target),
behind AS (SELECT n FROM cyclic UNION SELECT target FROM far WHERE source IN (SELECT n FROM cyclic)),
before AS (SELECT n FROM cyclic UNION SELECT source FROM far WHERE target IN (SELECT n FROM cyclic))
SELECT (SELECT count(*) FROM (SELECT n FROM behind INTERSECT SELECT n FROM before)) AS n_in_cycles, (SELECT count(*) FROM trade) AS n_edges""")
def owner_cycle_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations on cycles of trade, or between cycles."""
    edges = materialize(trade(spark, sf_dir).select("source", "target").distinct(), "trade")
    return graph.in_cycles(edges).agg(F.count(F.lit(1)).alias("n_in_cycles")).join(edges.agg(F.count(F.lit(1)).alias("n_edges")), F.lit(True))


@query("""WITH RECURSIVE nodes AS (SELECT c_custkey AS id, (c_custkey * c_custkey + 7) % (SELECT count(*) FROM customer) AS owner_id FROM customer),
chain AS (SELECT id, owner_id AS place FROM nodes WHERE owner_id IN (SELECT id FROM nodes) UNION SELECT c.id, n.owner_id FROM chain c JOIN nodes n ON c.place = n.id WHERE n.owner_id IN (SELECT id FROM nodes))
SELECT id AS node FROM chain WHERE id = place""")
def owner_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers on cycles, where each is owned by another by a rule that makes chains of many lengths."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    n = customer.agg(F.count(F.lit(1)).alias("n"))
    nodes = customer.join(F.broadcast(n), F.lit(True)).select("id", ((F.col("id") * F.col("id") + 7) % F.col("n")).alias("owner_id"))
    return graph.owner_cycles(nodes)


@query(f"WITH {NODES_SQL} SELECT owner_id AS source, id AS target, 'rel:' || substr(sha256({_frame_sql(chr(39) + 'contains' + chr(39))} || {_frame_sql('owner_id')} || {_frame_sql('id')}), 1, 24) AS edge_id FROM nodes WHERE owner_id IS NOT NULL")
def contains_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = owner_nodes(spark, sf_dir).where("owner_id IS NOT NULL")
    return nodes.select(F.col("owner_id").alias("source"), F.col("id").alias("target"), stable_id("rel", F.lit("contains"), F.col("owner_id"), F.col("id")).alias("edge_id"))


@query("""SELECT n_name AS source_concept, p_brand AS target_concept, l_returnflag AS kind, count(DISTINCT l_orderkey * 8 + l_linenumber) AS n_edges,
 min(l_orderkey * 8 + l_linenumber) AS first_edge, max(l_orderkey * 8 + l_linenumber) AS last_edge
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def concept_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, orders, customer, nation, part = (table(spark, sf_dir, x) for x in ("lineitem", "orders", "customer", "nation", "part"))
    edges = line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rollup.concept_edges(edges.select(F.col("n_name").alias("source_concept"), F.col("p_brand").alias("target_concept"), F.col("l_returnflag").alias("kind"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("edge_id")))


@query("SELECT o_orderkey, coalesce(min(p_brand), 'none') AS concept FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN part ON l_partkey = p_partkey AND p_size >= 25 GROUP BY o_orderkey")
def min_concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, line = table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    claims = orders.join(line, orders["o_orderkey"] == line["l_orderkey"], "left").select("o_orderkey", F.col("l_partkey").alias("k"))
    concepts = table(spark, sf_dir, "part").where("p_size >= 25").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("concept"))
    return rollup.smallest_concept(claims, concepts, "o_orderkey", "k", "none")


@query(r"SELECT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host, 'external/module-' || substr(sha256(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), 1, 24) AS concept, count(*) AS n FROM pages GROUP BY ALL")
def external_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").groupBy(tx.url_host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))
    return pages.select("host", F.concat(F.lit("external/module-"), F.substring(F.sha2("host", 256), 1, 24)).alias("concept"), "n")


@query("SELECT lang, source, doc_id // 1024 AS part, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS entity_ids FROM documents GROUP BY ALL")
def entities_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each file in parts: a list has at most 1024 different ids."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",")
    return table(spark, sf_dir, "documents").groupBy("lang", "source", F.floor(F.col("doc_id") / 1024).alias("part")).agg(ids.alias("entity_ids"))


# --- snapshots ----------------------------------------------------------------


def _state(spark: SparkSession, sf_dir: str, first: int, last: int) -> DataFrame:
    """Customers with orders in some years, and a digest of what they ordered."""
    orders = table(spark, sf_dir, "orders").where(F.year("o_orderdate").between(first, last))
    return orders.groupBy("o_custkey").agg(F.concat_ws("/", F.count(F.lit(1)).cast("string"), F.min("o_orderpriority"), F.max("o_orderpriority")).alias("digest"))


STATE_SQL = """old AS (SELECT o_custkey, count(*) || '/' || min(o_orderpriority) || '/' || max(o_orderpriority) AS digest FROM orders WHERE year(o_orderdate) BETWEEN 1992 AND 1995 GROUP BY o_custkey),
new AS (SELECT o_custkey, count(*) || '/' || min(o_orderpriority) || '/' || max(o_orderpriority) AS digest FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1999 GROUP BY o_custkey),
changes AS (SELECT o_custkey, CASE WHEN old.digest IS NULL THEN 'added' WHEN new.digest IS NULL THEN 'removed' WHEN old.digest = new.digest THEN 'unchanged' ELSE 'modified' END AS status FROM old FULL JOIN new USING (o_custkey))"""


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.compute_changes(_state(spark, sf_dir, 1992, 1995), _state(spark, sf_dir, 1996, 1999), "o_custkey", "digest")


@query(f"WITH {STATE_SQL} SELECT o_custkey, status FROM changes")
def change_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir)


@query(f"WITH {STATE_SQL} SELECT o_orderkey, o_custkey FROM orders WHERE year(o_orderdate) BETWEEN 1992 AND 1995 AND o_custkey IN (SELECT o_custkey FROM changes WHERE status IN ('modified', 'removed'))")
def invalidated_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = table(spark, sf_dir, "orders").where(F.year("o_orderdate").between(1992, 1995)).select("o_orderkey", "o_custkey")
    return changes.invalidated(entities, _changes(spark, sf_dir), "o_custkey").select("o_orderkey", "o_custkey")


@query("""WITH e AS (SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'), a AS (SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O')
SELECT o_custkey, o_orderpriority, 'missing' AS side, count(*) AS n FROM (SELECT * FROM e EXCEPT ALL SELECT * FROM a) GROUP BY ALL
UNION ALL SELECT o_custkey, o_orderpriority, 'unexpected', count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM e) GROUP BY ALL""")
def projection_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    side = lambda x: orders.where(F.col("o_orderstatus") == x).select("o_custkey", "o_orderpriority")
    return changes.bag_difference(side("F"), side("O")).groupBy("o_custkey", "o_orderpriority", "side").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, count(*) AS n_rows, NOT bool_or(n_chars > 15000) AS same FROM documents GROUP BY source")
def snapshot_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose documents have the same digest in a second snapshot, dealt in another way, where the longest texts lack their last character."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    edited = docs.withColumn("text", F.when(F.col("n_chars") > 15000, F.expr("substr(text, 1, length(text) - 1)")).otherwise(F.col("text")))
    columns = ["doc_id", "text", "lang"]
    part = lambda n: edited.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == n)
    dealt = part(0).unionByName(part(1))
    a, b = changes.digest(docs, columns, by=["source"]), changes.digest(dealt, columns, by=["source"])
    return a.join(b.select("source", F.col("fingerprint").alias("other")), "source").select("source", "n_rows", (F.col("fingerprint") == F.col("other")).alias("same"))


@query("""WITH h AS (SELECT sha256(coalesce(CAST(doc_id AS VARCHAR), chr(0)) || chr(31) || coalesce(lang, chr(0)) || chr(31) || coalesce(source, chr(0))) AS h FROM documents),
p AS (SELECT CAST('0x' || substr(h, 1, 8) AS BIGINT) % 4096 AS b, sha256(string_agg(h, '' ORDER BY h)) AS d, count(*) AS n FROM h GROUP BY b)
SELECT sha256(string_agg(d, '' ORDER BY b)) AS fingerprint, CAST(sum(n) AS BIGINT) AS n_rows FROM p""")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.digest(table(spark, sf_dir, "documents"), ["doc_id", "lang", "source"])


# --- validation, closure, bounds -----------------------------------------------


@query("""WITH i AS (
 SELECT 'duplicate-id' AS code, 'error' AS severity, 'lineitem' AS subject, count(*) AS n FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
 UNION ALL SELECT 'order-without-lines', 'warning', 'orders', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
 UNION ALL SELECT 'missing-customer', 'error', 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
 UNION ALL SELECT 'bad-discount', 'error', 'lineitem', count(*) FROM lineitem WHERE l_discount NOT BETWEEN 0 AND 1
 UNION ALL SELECT 'negative-balance', 'warning', 'customer', count(*) FROM customer WHERE c_acctbal < 0)
SELECT CASE severity WHEN 'error' THEN 0 ELSE 1 END AS rank, code, severity, subject, n FROM i WHERE n > 0""")
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, orders, customer = (table(spark, sf_dir, x) for x in ("lineitem", "orders", "customer"))

    def issue(code: str, severity: str, subject: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(subject).alias("subject"), "n")

    found = (
        issue("duplicate-id", "error", "lineitem", evidence.repeated(line, ["l_orderkey", "l_linenumber"]))
        .unionByName(issue("order-without-lines", "warning", "orders", orders.join(line, orders["o_orderkey"] == line["l_orderkey"], "left_anti")))
        .unionByName(issue("missing-customer", "error", "orders", orders.join(customer, orders["o_custkey"] == customer["c_custkey"], "left_anti")))
        .unionByName(issue("bad-discount", "error", "lineitem", line.where("NOT l_discount BETWEEN 0 AND 1")))
        .unionByName(issue("negative-balance", "warning", "customer", customer.where("c_acctbal < 0")))
    )
    return found.where("n > 0").select(F.when(F.col("severity") == "error", 0).otherwise(1).alias("rank"), "code", "severity", "subject", "n").orderBy("rank", "code")


@query(f"""WITH {NODES_SQL} SELECT id, kind FROM nodes WHERE kind IN ('region', 'nation')
UNION ALL SELECT 'customer:' || c_custkey, 'customer' FROM customer WHERE c_acctbal >= 1000
UNION ALL SELECT 'order:' || o_orderkey, 'order' FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal >= 1000""")
def owner_closed_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    poor = table(spark, sf_dir, "customer").where("c_acctbal < 1000").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"))
    nodes = owner_nodes(spark, sf_dir)
    return graph.owner_closed(nodes, nodes.join(poor, "id", "left_anti")).select("id", "kind")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT user_id AS a, 1000000 + CAST(json_extract(props, '$.k') AS BIGINT) AS b FROM events),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
far AS (SELECT a AS node, b AS other FROM both_ways UNION SELECT f.node, e.b FROM far f JOIN both_ways e ON f.other = e.a)
SELECT node, least(node, min(other)) AS root FROM far GROUP BY node""")
def concept_connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and the keys of their events, joined into components."""
    e = table(spark, sf_dir, "events")
    return graph.components(e.select(F.col("user_id").alias("a"), (F.get_json_object("props", "$.k").cast("long") + 1000000).alias("b")).distinct())


@query("SELECT p_brand, count(DISTINCT p_type) AS n_groups FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) > 1")
def disjoint_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.overlapping(table(spark, sf_dir, "part"), "p_type", "p_brand")


@query("""SELECT c.n_regionkey AS source_group, s.n_regionkey AS target_group, count(*) AS support
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation c ON c_nationkey = c.n_nationkey JOIN nation s ON s_nationkey = s.n_nationkey WHERE c.n_regionkey <> s.n_regionkey GROUP BY ALL""")
def direction_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("group"))
    return graph.directed_support(trade(spark, sf_dir).select("source", "target"), groups)


@query("SELECT doc_id, source, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 64")
def bounded_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.top_k(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), [F.desc("n_chars"), "doc_id"], 64)


@query("""WITH c AS (SELECT source, doc_id, least(strlen(text), 8192) AS cut FROM documents),
b AS (SELECT source, doc_id, cut, coalesce(sum(cut) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT source, doc_id, CAST(least(cut, 65536 - before) AS BIGINT) AS taken, CAST(before + least(cut, 65536 - before) AS BIGINT) AS used FROM b WHERE before < 65536""")
def excerpt_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length("text").alias("size"))
    return rollup.within_budget(docs, ["source"], ["doc_id"], "size", 8192, 65536).select("source", "doc_id", "taken", "used")


@query(f"WITH {PASSAGES_SQL} SELECT item_id, 'claim:' || substr(sha256({_frame_sql(chr(39) + 'passage' + chr(39))} || {_frame_sql('CAST(item_id AS VARCHAR)')}), 1, 24) AS claim_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS evidence_ids FROM passages GROUP BY item_id")
def claim_evidence_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array_join(F.transform(F.array_sort(F.collect_set("doc_id")), lambda x: x.cast("string")), ",")
    out = _contained(spark, sf_dir).groupBy("item_id").agg(ids.alias("evidence_ids"))
    return out.select("item_id", stable_id("claim", F.lit("passage"), F.col("item_id").cast("string")).alias("claim_id"), "evidence_ids")


@query("""SELECT doc_id, locale, CASE locale WHEN 'en' THEN '`' || source || '/' || doc_id || '` is declared as a ' || lang || '.' ELSE '`' || source || '/' || doc_id || '` は ' || lang || ' として宣言されています。' END AS text
FROM documents, (VALUES ('en'), ('ja')) l(locale)""")
def claim_text_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    subject = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    claims = table(spark, sf_dir, "documents").select("doc_id", F.lit("declaration").alias("fact"), subject.alias("subject"), F.col("lang").alias("kind"), F.lit(None).cast("string").alias("text"))
    return claims.select("doc_id", F.explode(F.array(*[F.struct(F.lit(x).alias("locale"), bundle.claim_text(x).alias("text")) for x in ("en", "ja")])).alias("c")).select("doc_id", "c.locale", "c.text")


# --- events ---------------------------------------------------------------------


@query("""SELECT event_id, binding_id FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS)
 OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS binding_id FROM events WHERE event_type IN ('click', 'signup')) WHERE event_type = 'click'""")
def visible_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last binding (signup) of the same user before each reference (click)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "signup"))
    last = F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w)
    return e.select("event_id", "event_type", last.alias("binding_id")).where("event_type = 'click'").select("event_id", "binding_id")


@query("""SELECT user_id, arg_min(event_type, (ts, event_id)) AS decision, min(event_id) AS first_id
FROM events WHERE event_type IN ('error', 'purchase') GROUP BY user_id""")
def scope_shadowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first decisive event of each user shadows later ones."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "purchase"))
    return e.groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("decision"), F.min("event_id").alias("first_id"))


@query("""SELECT user_id, event_type, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n, CAST(arg_min(event_id, (ts, event_id)) > arg_max(event_id, (ts, event_id)) AS BOOLEAN) AS inverted FROM events GROUP BY ALL""")
def usage_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_time = F.struct("ts", "event_id")
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("n"), (F.min_by("event_id", by_time) > F.max_by("event_id", by_time)).alias("inverted"))


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k long")["k"])
    return e.groupBy("k", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""WITH t AS (SELECT role, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT role, count(*) AS n, count(*) FILTER (turn <> coalesce(before + 1, 0)) AS n_gaps FROM t GROUP BY role""")
def turn_order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    t = table(spark, sf_dir, "conversations").withColumn("_before", before)
    return t.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("turn") != F.coalesce(F.col("_before") + 1, F.lit(0))).alias("n_gaps"))


@query("""SELECT doc_id, md5(replace(replace(replace(replace(replace(replace(replace(text, '\\', '\\\\'), '[', '\\['), ']', '\\]'), '<', '&lt;'), '>', '&gt;'), '`', '\\`'), '|', '\\|')) AS escaped_md5,
 CAST(greatest(1, length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END) AS BIGINT) AS n_lines FROM documents""".replace("\\\\", "\\"))
def text_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.escape_markdown(t)).alias("escaped_md5"), tx.line_count(t).alias("n_lines"))


@query("""WITH h AS (SELECT source, sha256(coalesce(CAST(doc_id AS VARCHAR), chr(0)) || chr(31) || coalesce(text, chr(0))) AS h FROM documents),
p AS (SELECT source, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 64 AS b, sha256(string_agg(h, '' ORDER BY h)) AS d, count(*) AS n FROM h GROUP BY source, b)
SELECT source, sha256(string_agg(d, '' ORDER BY b)) AS tree, CAST(sum(n) AS BIGINT) AS n_files FROM p GROUP BY source""")
def bundle_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's files and contents as one digest."""
    found = changes.digest(table(spark, sf_dir, "documents"), ["doc_id", "text"], 64, ["source"])
    return found.select("source", F.col("fingerprint").alias("tree"), F.col("n_rows").alias("n_files"))


# --- parsed source -------------------------------------------------------------


@query("""SELECT 'symbol' AS fact, 'function' AS kind, 'f_' || doc_id AS name, 'm_' || doc_id || '.f_' || doc_id AS qualified_name, CAST(4 AS BIGINT) AS start_line FROM documents
UNION ALL SELECT 'symbol', 'class', 'C_' || lang, 'm_' || doc_id || '.C_' || lang, 7 FROM documents WHERE lang IS NOT NULL
UNION ALL SELECT 'symbol', 'method', 'm', 'm_' || doc_id || '.C_' || lang || '.m', 8 FROM documents WHERE lang IS NOT NULL
UNION ALL SELECT 'import', 'member', 'helper', 'pkg.' || source, 1 FROM documents""")
def python_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations and imports of one small Python file for each document."""
    return parse.parse_files(_python_files(spark, sf_dir)).where("fact IN ('symbol', 'import')").select("fact", "kind", "name", "qualified_name", "start_line")


def _python_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function with a shadowing parameter, and where the language is known a class whose method calls an import, then a comprehension."""
    body = F.concat(
        F.lit("from pkg."), "source", F.lit(" import helper\n\n\ndef f_"), F.col("doc_id").cast("string"), F.lit("(helper):\n    return helper()\n\n"),
        F.coalesce(F.concat(F.lit("class C_"), "lang", F.lit(":\n    def m(self):\n        return helper([helper() for x in self])\n")), F.lit("")),
    )
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("m_"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), body.cast("binary").alias("content"), F.lit("python").alias("language"), "source", "doc_id")


@query("""WITH r AS (SELECT doc_id, source, 'rebound' AS reason, CAST(5 AS BIGINT) AS line FROM documents
UNION ALL SELECT doc_id, source, 'external', 9 FROM documents WHERE lang IS NOT NULL UNION ALL SELECT doc_id, source, 'comprehension', 9 FROM documents WHERE lang IS NOT NULL)
SELECT source, CASE reason WHEN 'external' THEN 'external' ELSE 'unresolved' END AS status, CASE reason WHEN 'external' THEN NULL ELSE reason END AS reason, count(*) AS n FROM r GROUP BY ALL""")
def python_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the calls in these files resolve: to an outside import, not past a parameter, never in a comprehension."""
    files = _python_files(spark, sf_dir).withColumn("size", F.octet_length("content").cast("long")).withColumn("content_hash", F.sha2("content", 256))
    ir = scan.build(classify.disposition(files.drop("language"), languages=["python"]))
    source = files.select("path", "source")
    return ir.references.where("kind = 'call'").join(source, "path").groupBy("source", "status", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH n AS (SELECT doc_id, lang FROM documents)
SELECT 'evidence-hash-differs' AS code, 'error' AS severity, count(*) AS n FROM n WHERE lang = 'de' HAVING count(*) > 0
UNION ALL SELECT 'duplicate-claim', 'error', count(*) FROM n WHERE lang = 'en' HAVING count(*) > 0
UNION ALL SELECT 'self-owner', 'error', count(*) FROM n WHERE lang = 'es' HAVING count(*) > 0
UNION ALL SELECT 'owner-cycle', 'error', count(*) FROM n WHERE lang = 'es' HAVING count(*) > 0""")
def relation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues by code of the files of ``python_symbols``, after three kinds of damage: hashes, claims and owners of files of one language each."""
    files = _python_files(spark, sf_dir)
    lang = table(spark, sf_dir, "documents").select("doc_id", "lang").join(files.select("doc_id", "path"), "doc_id").select("path", "lang")
    ir = scan.build(classify.disposition(files.drop("language").withColumn("size", F.octet_length("content").cast("long")).withColumn("content_hash", F.sha2("content", 256)), languages=["python"]))
    marked = lambda t: t.join(lang, "path", "left")
    of_function = F.col("qualified_name").rlike("^m_[0-9]+[.]f_[0-9]+$")
    ir.evidence = marked(ir.evidence).withColumn("content_hash", F.when((F.col("lang") == "de") & F.col("symbol").rlike("[.]f_[0-9]+$"), "changed").otherwise(F.col("content_hash"))).drop("lang")
    twice = marked(ir.claims).where((F.col("lang") == "en") & F.col("subject").rlike("[.]f_[0-9]+$")).drop("lang")
    ir.claims = ir.claims.unionByName(twice.select(*ir.claims.columns))
    ir.entities = marked(ir.entities).withColumn("owner_id", F.when((F.col("lang") == "es") & of_function, F.col("id")).otherwise(F.col("owner_id"))).drop("lang")
    return validation.validate(ir).groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"))
