"""The registered queries over the test tables, each beside its SQL oracle.

The test tables hold no shelf readings, so the operators, which take any
columns, are applied to what the tables have: tags are rendered from part and
lineitem, rails are the lines of an order, photos are customers, and so on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagwright.functions import geometry, money, names
from tagwright.operators import brands, dedupe, referee, report, score, shelves
from tagwright.streaming.ingest import sessions, tumbling

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


R2 = "round(CAST({} AS DECIMAL(28,9)), 2)::DOUBLE"
R1 = "round(CAST({} AS DECIMAL(28,9)), 1)::DOUBLE"

# --- summaries ------------------------------------------------------------------


@query(f"""SELECT c_mktsegment, count(DISTINCT c_custkey) AS photos, count(*) AS n_rows, count(o_totalprice) AS priced,
  count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS needs_review, {R2.format('quantile_cont(o_totalprice, 0.5)')} AS median_price,
  array_to_string(list_sort(list_distinct(list(o_orderpriority))), '; ') AS currency
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""")
def index_by_segment(spark, d):
    both = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return report.price_index(both, ["c_mktsegment"], "c_custkey", "o_totalprice", F.col("o_orderstatus") == "F", "o_orderpriority")


@query("""SELECT CAST(count(*) AS BIGINT) AS jobs, count(l.doc_id) AS answered, count(*) - count(l.doc_id) AS pending,
  CAST(round_even(count(l.doc_id) * 100.0 / count(*), 0) AS INTEGER)::VARCHAR || '%' AS done
  FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""")
def status_line(spark, d):
    jobs = t(spark, d, "documents").select(F.col("doc_id").alias("job_id"))
    found = t(spark, d, "labels").select(F.col("doc_id").alias("job_id"), F.lit(True).alias("valid")).distinct()
    return report.status(jobs, found)


@query("""SELECT c_nationkey::VARCHAR AS photo, count(*) AS bands, array_to_string(list(c_custkey::VARCHAR ORDER BY c_custkey), ',') AS jobs
  FROM customer WHERE c_acctbal < 5000 GROUP BY 1""")
def work_list(spark, d):
    jobs = t(spark, d, "customer").filter("c_acctbal < 5000").select(
        F.col("c_nationkey").cast("string").alias("photo"), F.lit("").alias("photo_sha256"), F.col("c_custkey").alias("band_index"), F.col("c_custkey").cast("string").alias("job_id"))
    return report.work_list(jobs).select("photo", "bands", F.array_join("jobs", ",").alias("jobs"))


@query("""SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3""")
def most_common(spark, d):
    return report.most_common(t(spark, d, "customer"), "c_mktsegment", 3)


@query("""SELECT sum(l_quantity) AS l_quantity, sum(l_linenumber)::BIGINT AS l_linenumber, (sum(l_quantity) * 15.0 + sum(l_linenumber) * 3.0) / 1e6 AS cost FROM lineitem""")
def usage_cost(spark, d):
    return report.cost(t(spark, d, "lineitem"), {"l_quantity": 15.0, "l_linenumber": 3.0})


@query("""SELECT c_nationkey::VARCHAR AS photo, '# ' || c_nationkey || chr(10) || chr(10) || 'read' || chr(10) || chr(10) ||
  string_agg('## ' || c_name || chr(10) || chr(10) || 'job: ' || c_custkey || chr(10) || chr(10), chr(10) || chr(10) ORDER BY c_custkey) AS brief FROM customer GROUP BY c_nationkey""")
def briefs(spark, d):
    jobs = t(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("photo"), F.col("c_custkey").alias("band_index"), F.col("c_custkey").cast("string").alias("job_id"), F.col("c_name").alias("band_label"), F.lit("").alias("ocr_digest"))
    return report.briefs(jobs, "read")


@query(r"""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped FROM pages""")
def html_escape(spark, d):
    return t(spark, d, "pages").select("page_id", report.escape_html(F.col("html")).alias("escaped"))


# --- money ------------------------------------------------------------------------


def _priced(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(12,2)").alias("p"))


@query("""SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DOUBLE) AS parsed FROM lineitem""")
def parse_price_roundtrip(spark, d):
    p = F.format_number("p", 2)
    continental = F.translate(p, ",.", ".,")
    shown = F.element_at(F.array(p, continental, F.replace(continental, F.lit("."), F.lit(" ")), F.concat(F.replace(p, F.lit(","), F.lit("'")), F.lit(" lei"))), (F.pmod("l_orderkey", F.lit(4)) + 1).cast("int"))
    return _priced(spark, d).select("l_orderkey", "l_linenumber", money.parse_price(shown).alias("parsed"))


@query("""SELECT l_orderkey, l_linenumber, CASE l_orderkey % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'mismatch_x100' WHEN 2 THEN 'mismatch'
  WHEN 3 THEN 'ok_no_separator' WHEN 4 THEN 'unverified' ELSE 'text_only' END AS price_check FROM lineitem""")
def price_check(spark, d):
    k, p = F.pmod("l_orderkey", F.lit(6)), F.col("p").cast("double")
    text = F.when(k == 3, F.replace(F.col("p").cast("string"), F.lit("."), F.lit(""))).when(k == 4, "sold out").otherwise(F.col("p").cast("string"))
    price = F.when(k == 1, p * 100).when(k == 2, p + 1).when(k != 5, p)
    read = _priced(spark, d).select("l_orderkey", "l_linenumber", price.alias("price"), text.alias("text")).withColumn("reading", money.parse_price(F.col("text")))
    return read.select("l_orderkey", "l_linenumber", money.check_price(F.col("price"), F.col("text"), F.col("reading")).alias("price_check"))


@query(f"""WITH x AS (SELECT p_partkey, p_retailprice AS price, (ARRAY[750.0, 1500.0, 0.0, 330.0])[1 + p_size % 4] AS v FROM part)
  SELECT p_partkey, {R2.format('price * 1000.0 / nullif(v, 0)')} AS per_litre, CASE WHEN v = 0 THEN 'unverified' WHEN p_partkey % 3 = 0 THEN 'ok'
  WHEN p_partkey % 3 = 1 THEN 'mismatch_volume' ELSE 'mismatch' END AS unit_check, CASE WHEN p_partkey % 2 = 0 THEN 20.0 END AS discount FROM x""")
def unit_price_check(spark, d):
    v = F.element_at(F.array(*map(F.lit, (750.0, 1500.0, 0.0, 330.0))), F.col("p_size") % 4 + 1)
    litre = money.price_per_litre(F.col("p_retailprice"), v)
    k = F.col("p_partkey") % 3
    shown = F.concat(F.format_string("%.2f", litre * F.when(k == 0, 1.0).when(k == 1, 2.0).otherwise(4.0)), F.lit(" RON / L"))
    original = F.when(F.col("p_partkey") % 2 == 0, F.col("p_retailprice") / 0.8).otherwise(F.col("p_retailprice"))
    return t(spark, d, "part").select("p_partkey", litre.alias("per_litre"), money.check_unit_price(litre, shown).alias("unit_check"), money.discount_pct(F.col("p_retailprice"), original).alias("discount"))


@query("""SELECT p_partkey, (ARRAY[750.0, 500.0, 1500.0, 330.0])[1 + p_size % 4] AS volume_ml, CASE WHEN p_size % 5 = 0 THEN 'NV' WHEN p_size % 5 < 4 THEN (1950 + p_size)::VARCHAR END AS vintage,
  CASE p_size % 4 WHEN 0 THEN 'RON' WHEN 1 THEN 'EUR' WHEN 2 THEN 'PLN' END AS currency FROM part""")
def tag_texts(spark, d):
    s = F.col("p_size")
    size = F.element_at(F.array(*map(F.lit, ("0,75 L 1 L = 53,32 Lei", "500 ml", "1.5 litri (1 litru = 24.52)", "33 cl"))), s % 4 + 1)
    year = F.when(s % 5 == 0, " n.v. ").when(s % 5 < 4, F.concat(F.lit("rosu "), (1950 + s).cast("string"), F.lit(" sec"))).otherwise("fara an 1849")
    cash = F.element_at(F.array(*map(F.lit, ("pret 12 LEI", "€ 12 lei", "cena zloty", "gratis"))), s % 4 + 1)
    return t(spark, d, "part").select("p_partkey", money.normalize_volume(F.lit(None).cast("double"), size).alias("volume_ml"), money.normalize_vintage(F.lit(None).cast("string"), year).alias("vintage"), money.detect_currency(F.lit(None).cast("string"), cash).alias("currency"))


@query(f"""SELECT p_partkey, CASE WHEN p_size < 10 THEN {R1.format('p_size * 1000.0')} WHEN p_size < 100 THEN {R1.format('p_size * 10.0')} END AS volume_ml FROM part""")
def volume_repair(spark, d):
    return t(spark, d, "part").select("p_partkey", money.normalize_volume(F.col("p_size").cast("double")).alias("volume_ml"))


@query("""SELECT page_id, CASE WHEN contains(html, '€') THEN 'EUR' WHEN contains(html, '$') THEN 'USD' END AS sign FROM pages""")
def currency_signs(spark, d):
    text = F.when(F.col("html").contains("€"), "€").when(F.col("html").contains("$"), "$")
    return t(spark, d, "pages").select("page_id", money.detect_currency(text).alias("sign"))


@query("""SELECT l_orderkey, l_linenumber, concat_ws('; ', CASE WHEN l_returnflag = 'R' THEN 'low pairing confidence' WHEN l_returnflag = 'A' THEN 'unconfirmed pairing' END,
  CASE WHEN l_linenumber = 7 THEN 'no price' END, CASE WHEN l_linestatus = 'F' THEN 'price mismatch' END, CASE WHEN l_quantity > 45 THEN 'per-litre mismatch_volume' END,
  CASE WHEN l_quantity < 10 THEN 'name too generic' END, CASE WHEN l_discount = 0 THEN 'no currency' END, CASE WHEN l_tax = 0 THEN 'no volume' END,
  CASE WHEN l_extendedprice < 3 OR l_extendedprice > 3000 THEN 'implausible price per litre' END) AS reasons FROM lineitem""")
def review_reasons(spark, d):
    c = F.col
    reasons = money.review_reasons(
        F.when(c("l_returnflag") == "R", "low").when(c("l_returnflag") == "A", "medium").otherwise("high"), F.when(c("l_linenumber") != 7, c("l_extendedprice")),
        F.when(c("l_linestatus") == "F", "mismatch").otherwise("ok"), F.when(c("l_quantity") > 45, "mismatch_volume").otherwise("ok"),
        F.when(c("l_quantity") < 10, " Vin ").otherwise("castel"), F.when(c("l_discount") != 0, "RON"), c("l_tax"), c("l_extendedprice"),
    )
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(reasons, "; ").alias("reasons"))


# --- rails of prices ---------------------------------------------------------------


def _rail(spark, d):
    rail = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda x: x["l_quantity"]).alias("rail"))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").join(rail, "l_orderkey")


@query("""WITH r AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity) AS rail FROM lineitem GROUP BY 1),
  x AS (SELECT l.*, rail, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_linenumber END AS i, l_quantity + (l_linenumber % 2) AS p FROM lineitem l JOIN r USING (l_orderkey))
  SELECT l_orderkey, l_linenumber, CASE WHEN i BETWEEN 1 AND len(rail) THEN CASE WHEN rail[i] = p THEN 'ok' WHEN list_contains(rail, p) THEN 'index_mismatch' ELSE 'disagrees' END
  WHEN list_contains(rail, p) THEN 'ok_unindexed' ELSE 'not_on_rail' END AS verdict, CASE WHEN i BETWEEN 1 AND len(rail) THEN rail[i] END AS claimed FROM x""")
def rail_referee(spark, d):
    i = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber"))
    check = referee.referee(F.col("l_quantity") + F.col("l_linenumber") % 2, F.col("rail"), i)
    return _rail(spark, d).withColumn("c", check).select("l_orderkey", "l_linenumber", "c.verdict", "c.claimed")


@query("""SELECT a.l_orderkey, a.l_linenumber, coalesce(array_to_string(list(b.l_quantity::INTEGER ORDER BY b.l_linenumber, b.l_quantity) FILTER (WHERE b.l_quantity <> a.l_quantity AND
  (abs(b.l_quantity - a.l_quantity * 2.0) <= greatest(0.01, 0.01 * a.l_quantity * 2.0) OR abs(b.l_quantity - a.l_quantity * 3.0) <= greatest(0.01, 0.01 * a.l_quantity * 3.0)
   OR abs(b.l_quantity - a.l_quantity * (1.0::DOUBLE / 3)) <= greatest(0.01, 0.01 * a.l_quantity / 3) OR abs(b.l_quantity - a.l_quantity * 0.5) <= greatest(0.01, 0.01 * a.l_quantity * 0.5))), ','), '') AS tiers
  FROM (SELECT *, row_number() OVER () AS rid FROM lineitem) a JOIN lineitem b ON a.l_orderkey = b.l_orderkey GROUP BY a.rid, a.l_orderkey, a.l_linenumber, a.l_quantity""")
def multibuy_siblings(spark, d):
    tiers = F.array_join(F.transform(referee.multibuy_siblings(F.col("l_quantity"), F.col("rail")), lambda v: v.cast("int").cast("string")), ",")
    return _rail(spark, d).select("l_orderkey", "l_linenumber", tiers.alias("tiers"))


@query("""WITH v(l) AS (VALUES (0.75::DOUBLE), (1.5), (2.0), (3.0), (5.0)) SELECT a.l_orderkey, a.l_linenumber, coalesce(array_to_string(list(b.l_quantity::INTEGER ORDER BY b.l_linenumber, b.l_quantity) FILTER (WHERE b.l_quantity <> a.l_quantity AND
  EXISTS (SELECT 1 FROM v WHERE abs(b.l_quantity - a.l_quantity / l) <= greatest(0.02, 0.005 * b.l_quantity) OR abs(a.l_quantity - b.l_quantity / l) <= greatest(0.02, 0.005 * a.l_quantity))), ','), '') AS per_litre
  FROM (SELECT *, row_number() OVER () AS rid FROM lineitem) a JOIN lineitem b ON a.l_orderkey = b.l_orderkey GROUP BY a.rid, a.l_orderkey, a.l_linenumber, a.l_quantity""")
def per_litre_siblings(spark, d):
    own = F.array_join(F.transform(referee.per_litre_siblings(F.col("l_quantity"), F.col("rail")), lambda v: v.cast("int").cast("string")), ",")
    return _rail(spark, d).select("l_orderkey", "l_linenumber", own.alias("per_litre"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'leading_digit' ELSE 'disagrees' END AS verdict FROM part""")
def tag_reconcile(spark, d):
    unit = F.col("p_size") + 10.5
    true = F.round(unit * 0.75, 2)
    k = F.col("p_partkey") % 3
    price = F.when(k == 0, true).when(k == 1, F.concat(F.lit("9"), F.format_string("%.2f", true)).cast("double")).otherwise(true * 1.5)
    text = F.concat(F.lit("VIN ROSU 0.75L 1 L = "), F.replace(F.format_string("%.2f", unit), F.lit("."), F.lit(",")), F.lit(" Lei"))
    return t(spark, d, "part").select("p_partkey", referee.reconcile(price, text)["verdict"].alias("verdict"))


@query("""SELECT p_partkey, p_retailprice / 200 > 0 AND p_retailprice / 200 < 10 AND NOT p_size * 40 > 1000 AS dropped FROM part""")
def dropped_digit(spark, d):
    return t(spark, d, "part").select("p_partkey", referee.dropped_digit(F.col("p_retailprice") / 200, F.col("p_size") * 40.0).alias("dropped"))


# --- identity and de-duplication ------------------------------------------------------


@query("""WITH k AS (SELECT doc_id, lower(trim(source)) || '|' || trim(regexp_replace(regexp_replace(translate(lower(coalesce(text, '')), 'ăâîșțáéíóúüöäàèìòù', 'aaistaeiouuoaaeiou'), '[^\\pL\\pN\\pM_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) || '||' AS key, n_chars FROM documents),
  r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n_chars DESC, doc_id) AS place, dense_rank() OVER (ORDER BY encode(key)) AS n,
        list_sort(list_distinct(list(n_chars) OVER (PARTITION BY key))) AS prices FROM k)
  SELECT doc_id, key, CASE WHEN place = 1 THEN 'W' || lpad(n::VARCHAR, 5, '0') ELSE 'W' || lpad(n::VARCHAR, 5, '0') || 'd' || (place - 1) END AS row_id,
  CASE WHEN place > 1 THEN 'W' || lpad(n::VARCHAR, 5, '0') END AS duplicate_of, CASE WHEN place = 1 AND len(prices) > 1 THEN array_to_string(prices, ',') END AS conflict FROM r""")
def dedupe_documents(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "n_chars", names.dedupe_key(F.col("source"), F.col("text"), F.lit(None).cast("string"), F.lit(None).cast("double")).alias("key"))
    out = dedupe.deduplicate(docs, F.col("key"), [F.col("n_chars").desc()], F.col("doc_id"), "n_chars")
    return out.select("doc_id", "key", "row_id", "duplicate_of", F.array_join(F.transform("price_conflict", lambda x: x.cast("string")), ",").alias("conflict"))


@query("""SELECT l_partkey, count(DISTINCT l_discount) AS n_prices, array_to_string(list_transform(list_sort(list_distinct(list(l_discount))), lambda x: CAST(round(x * 100) AS INTEGER)), ',') AS prices
  FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_discount) > 1""")
def price_conflicts(spark, d):
    own = t(spark, d, "lineitem").groupBy("l_partkey").agg(F.array_sort(F.collect_set("l_discount")).alias("p"))
    return own.filter(F.size("p") > 1).select("l_partkey", F.size("p").cast("long").alias("n_prices"), F.array_join(F.transform("p", lambda x: F.round(x * 100).cast("int").cast("string")), ",").alias("prices"))


@query("""SELECT p_partkey, substr(sha256('v1|' || p_name || '|' || p_size || '|' || printf('%.4f,%.4f,%.4f,%.4f', p_size / 100.0, 0.1, p_size / 50.0, 0.5) || '|' || (p_size % 7)), 1, 16) AS job_id,
  substr(sha256(p_name || '||' || p_brand || '||' || p_size), 1, 40) AS cache_key FROM part""")
def work_item_ids(spark, d):
    s = F.col("p_size")
    box = [s / 100.0, F.lit(0.1), s / 50.0, F.lit(0.5)]
    return t(spark, d, "part").select("p_partkey", names.job_id("v1", F.col("p_name"), s, box, s % 7).alias("job_id"), names.cache_key(F.col("p_name"), F.col("p_brand"), s).alias("cache_key"))


@query("""WITH x AS (SELECT page_id, regexp_extract(url, '://([^/]+)/', 1) AS host, split_part(regexp_extract(url, '://[^/]+/([^?#]*)', 1), '/', 1) AS lang, page_id % 5 AS k FROM pages)
  SELECT page_id, CASE WHEN k = 0 THEN 'Given' WHEN lang = 'en' THEN 'English Shop' WHEN k = 1 THEN 'Main Street' WHEN k = 2 THEN 'Corner ATAC' ELSE 'Unknown' END AS store,
  CASE WHEN k = 0 THEN 'cli' WHEN lang = 'en' THEN 'folder-map' WHEN k = 1 THEN 'folder' WHEN k = 2 THEN 'photo' ELSE 'none' END AS source FROM x""")
def store_resolve(spark, d):
    lang = F.split(F.regexp_extract("url", "://[^/]+/([^?#]*)", 1), "/")[0]
    k = F.col("page_id") % 5
    folders = F.array(F.lit("photos"), F.when(k == 1, "main_street").otherwise("2026-06-14"), F.when(lang == "en", "EN").otherwise("raw"))
    got = names.resolve_store(folders, F.when(k == 0, "Given"), F.create_map(F.lit("en"), F.lit("English Shop")), F.when(k == 2, "corner ATAC"))
    return t(spark, d, "pages").withColumn("s", got).select("page_id", "s.store", "s.source")


@query("""SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9_\\-]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, CASE WHEN contains(url, '/') THEN regexp_extract(url, '^(.*?)/+[^/]*/*$', 1) ELSE '.' END AS folder FROM pages""")
def slugs_and_folders(spark, d):
    return t(spark, d, "pages").select("page_id", names.slug(F.col("url")).alias("slug"), names.folder_of(F.col("url")).alias("folder"))


# --- brands: benchmark items as catalogue, documents as names ---------------------------



def _sql_tokens(text: str) -> str:
    """Brand tokens of a text, in order, in SQL."""
    stop = ", ".join(f"'{w}'" for w in names.STOP_WORDS)
    bare = rf"upper(strip_accents(replace(regexp_replace(coalesce({text}, ''), '\([^)]*\)', ' ', 'g'), 'ß', 'ss')))"
    return rf"list_filter(regexp_extract_all({bare}, '[A-Z0-9]+'), lambda w: length(w) >= 2 AND NOT regexp_matches(w, '^[0-9]+[A-Z]*$') AND NOT list_contains([{stop}], w))"


_SQL_BRANDS = f"""WITH c AS (SELECT item_id AS row, list_distinct({_sql_tokens('text')}) AS k FROM benchmark),
  p AS (SELECT row, len(k) AS key_size, unnest(k) AS token FROM c), i AS (SELECT token, count(*) AS df, ln((SELECT count(*) FROM c WHERE len(k) > 0)::DOUBLE / count(*)) AS idf FROM p GROUP BY 1),
  w AS (SELECT DISTINCT doc_id, token FROM (SELECT doc_id, unnest({_sql_tokens('text')}) AS token FROM documents) WHERE length(token) >= 3)"""


def _index(spark, d):
    return brands.catalogue(t(spark, d, "benchmark").select(F.col("item_id").alias("row"), "text", F.lit("").alias("label")), [F.col("text")])


@query(f"""{_SQL_BRANDS} SELECT token, df, round(idf, 9) AS idf FROM i""")
def token_idf(spark, d):
    return brands.token_idf(_index(spark, d)).select("token", "df", F.round("idf", 9).alias("idf"))


@query(f"""{_SQL_BRANDS},
  s AS (SELECT doc_id, row, key_size, sum(idf) AS score FROM w JOIN p USING (token) JOIN i USING (token) WHERE idf >= 3.0 GROUP BY ALL),
  r AS (SELECT *, max(score) OVER (PARTITION BY doc_id) AS best FROM s), u AS (SELECT *, score >= best - 1e-9 AS tied FROM r),
  m AS (SELECT *, sum(tied::INT) OVER (PARTITION BY doc_id) AS ties, coalesce(max(CASE WHEN NOT tied THEN score END) OVER (PARTITION BY doc_id), 0) AS runner FROM u),
  f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY key_size, row) AS place FROM m WHERE tied)
  SELECT doc_id, row, round(best, 6) AS score, best >= 4.0 AND (ties > 1 OR best - runner >= 1.0) AS matched FROM f WHERE place = 1""")
def brand_match(spark, d):
    named = t(spark, d, "documents").select("doc_id", names.brand_tokens(F.col("text")).alias("tokens"))
    got = brands.match(named, "doc_id", "tokens", brands.postings(_index(spark, d), "row"))
    return got.select("doc_id", "row", F.round("score", 6).alias("score"), "matched")


@query(f"""{_SQL_BRANDS},
  q AS (SELECT DISTINCT token FROM p), grown AS (SELECT word, q.token FROM (SELECT DISTINCT token AS word FROM w WHERE length(token) >= 4) JOIN q ON starts_with(q.token, word) AND q.token <> word),
  e AS (SELECT doc_id, token, 1.0::DOUBLE AS w FROM w UNION ALL SELECT doc_id, grown.token, 0.6 FROM w JOIN grown ON w.token = grown.word),
  g AS (SELECT doc_id, token, max(w) AS w FROM e GROUP BY ALL),
  s AS (SELECT doc_id, row, sum(idf * w) AS score, coalesce(list(token ORDER BY idf DESC, token) FILTER (WHERE w = 1.0), [])[1:4] AS shared FROM g JOIN p USING (token) JOIN i USING (token) GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, row) AS place FROM s) SELECT doc_id, row, round(score, 6) AS score, array_to_string(shared, ' ') AS shared, place FROM r WHERE place <= 3""")
def brand_candidates(spark, d):
    named = t(spark, d, "documents").select("doc_id", names.brand_tokens(F.col("text")).alias("tokens"))
    index = _index(spark, d)
    post = brands.postings(index, "row").withColumn("idf", F.col("idf"))
    got = brands.candidates(named, "doc_id", "tokens", post, ["row"], index.select("row"), 40)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "row"))
    got = got.select("doc_id", "row", F.round("score", 6).alias("score"), F.array_join("shared", " ").alias("shared"))
    return got.withColumn("place", place).filter("place <= 3")


# --- joins --------------------------------------------------------------------------


@query("""SELECT doc_id AS job_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def pending_jobs(spark, d):
    from tagwright.sources.ingest import pending

    jobs = t(spark, d, "documents").select(F.col("doc_id").alias("job_id"))
    return pending(jobs, t(spark, d, "labels").select(F.col("doc_id").alias("job_id"), (F.col("quality") == 1).alias("valid")))


@query("""WITH x AS (SELECT c_custkey AS id, c_nationkey AS g, (c_acctbal + 1000) / 11000 AS x0, (c_acctbal + 1000) / 11000 + 0.2 AS x1, (c_custkey * 37 % 1000) / 1000.0::DOUBLE AS cy FROM customer),
  m AS (SELECT a.g, a.id, b.id AS above, row_number() OVER (PARTITION BY a.id ORDER BY b.cy DESC, b.id) AS k FROM x a JOIN x b ON a.g = b.g AND a.id <> b.id AND b.cy < a.cy
        AND least(a.x1, b.x1) - greatest(a.x0, b.x0) >= 0.15 * (a.x1 - a.x0))
  SELECT x.id, m.above AS above_id FROM x LEFT JOIN m ON x.id = m.id AND m.k = 1""")
def nearest_above(spark, d):
    x0 = (F.col("c_acctbal") + 1000) / 11000
    cy = (F.col("c_custkey") * 37 % 1000) / 1000.0
    boxes = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("g"), x0.alias("x0"), (x0 + 0.2).alias("x1"), cy.alias("y1"), cy.alias("cy"))
    return shelves.nearest_above(boxes, "g", "id").select("id", "above_id")


@query("""WITH b AS (SELECT s_suppkey, s_nationkey AS k, s_acctbal - 1500 AS x0, s_acctbal + 1500 AS x1 FROM supplier)
  SELECT c_custkey, s_suppkey FROM customer JOIN b ON c_nationkey = k AND c_acctbal BETWEEN x0 AND x1""")
def point_in_box(spark, d):
    boxes = t(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"), (F.col("s_acctbal") - 1500).alias("x0"), (F.col("s_acctbal") + 1500).alias("x1"), F.lit(0).alias("y0"), F.lit(1).alias("y1"))
    points = t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k"), "c_acctbal", F.lit(0.5).alias("y"))
    return shelves.points_in_boxes(points, boxes, "k", "c_acctbal", "y").select("c_custkey", "s_suppkey")


@query("""WITH e AS (SELECT user_id, epoch_us(ts) / 1000000 AS lo, epoch_us(ts) / 1000000 + 20000 AS hi FROM events), u AS (SELECT DISTINCT user_id FROM events),
  s AS (SELECT * FROM e UNION ALL SELECT user_id, 1.7e9::DOUBLE, 1.7e9::DOUBLE FROM u UNION ALL SELECT user_id, 1.9e9::DOUBLE, 1.9e9::DOUBLE FROM u),
  w AS (SELECT user_id, lo, max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM s WHERE hi >= 1.7e9 AND lo <= 1.9e9)
  SELECT user_id, greatest(b, 1.7e9) AS gap_lo, lo AS gap_hi FROM w WHERE lo - greatest(b, 1.7e9) >= 40000""")
def coverage_gaps(spark, d):
    lo = F.unix_micros(F.col("ts").cast("timestamp")) / 1000000
    spans = t(spark, d, "events").select("user_id", lo.alias("lo"), (lo + 20000).alias("hi"))
    return shelves.coverage_gaps(spans, "user_id", "lo", "hi", 40000.0, 1.7e9, 1.9e9)


@query("""SELECT count(*)::BIGINT AS truths, count(*)::BIGINT AS found, count(*)::BIGINT AS name_checked, count(CASE WHEN o_orderkey % 20 = 0 THEN 1 END) AS name_correct,
  count(CASE WHEN o_orderkey % 30 = 0 THEN 1 END) AS volume_correct FROM orders""")
def verify_greedy(spark, d):
    every = t(spark, d, "orders").select(F.col("o_orderkey").alias("truth_no"), F.round("o_totalprice", 2).alias("price"))
    truth = every.withColumn("name_contains", F.lit("Castel ")).withColumn("volume_ml", F.lit(750.0))
    rows = every.select((F.col("truth_no") + 1).alias("row_no"), "price", F.when(F.col("truth_no") % 30 == 0, 750.4).otherwise(1500.0).alias("volume_ml"), F.when(F.col("truth_no") % 20 == 0, "CAȘTEL HUNIADE castel ").otherwise("x").alias("text"))
    return score.report(score.verify(truth, rows))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def props_json(spark, d):
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


def _answers(spark, d):
    """An answer document per part: whole, wrapped, cut off, without a key, or with a word outside its list."""
    null = lambda kind: F.lit(None).cast(kind)
    k = F.col("p_partkey") % 5
    wine = F.struct(
        F.col("p_name").alias("wine_name"), null("string").alias("producer"), F.lit("recolta 2019").alias("vintage"), F.when(k == 4, "blue").otherwise("red").alias("wine_type"), F.lit("dry").alias("sweetness"),
        F.array(F.lit("Merlot"), F.lit("Cabernet")).alias("grape_varieties"), null("string").alias("region"), null("string").alias("country"), F.lit("0.75").alias("volume_ml"), null("double").alias("abv_percent"),
        (F.col("p_size") + 0.5).alias("price"), null("string").alias("currency"), F.concat((F.col("p_size") + 0.5).cast("string"), F.lit("0 lei")).alias("price_text"), F.lit("shelf").alias("price_kind"),
        null("double").alias("original_price"), null("string").alias("unit_price_text"), null("string").alias("promo_text"), null("string").alias("raw_tag_text"), null("string").alias("raw_label_text"),
        F.lit(2).alias("ocr_price_index"), F.lit("price_tag").alias("name_source"), F.lit("high").alias("pairing_confidence"), null("string").alias("pairing_note"),
        F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(0.5).alias("x1"), F.lit(1.0).alias("y1")).alias("bottle_bbox"), null("string").alias("tag_bbox"),
    )
    whole = F.to_json(F.struct(F.array(wine).alias("wines"), F.array().cast("array<string>").alias("unreadable_tags"), F.lit(False).alias("non_wine_present"), F.lit("").alias("notes")), {"ignoreNullFields": "false"})
    raw = F.when(k == 1, F.concat(F.lit('{"result":'), whole, F.lit("}"))).when(k == 2, F.substring(whole, 1, 50)).when(k == 3, F.regexp_replace(whole, ',"notes":""', "")).otherwise(whole)
    from tagwright.sources.ingest import parse_answers

    return parse_answers(t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("job_id"), raw.alias("raw")))


@query("""SELECT p_partkey::VARCHAR AS job_id, p_partkey % 5 < 2 AS valid FROM part""")
def answer_validation(spark, d):
    return _answers(spark, d).select("job_id", "valid")


@query(f"""SELECT p_partkey::VARCHAR AS job_id, p_name AS wine_name, '2019' AS vintage, 'RON' AS currency, 750.0::DOUBLE AS volume_ml, {R2.format('(p_size + 0.5) * 1000.0 / 750')} AS price_per_litre,
  'Merlot; Cabernet' AS grape_varieties, 'ok' AS price_check, CASE WHEN p_partkey % 3 = 0 THEN 'ok' ELSE 'index_mismatch' END AS ocr_price_check, '0.2000,0.0000,0.4000,1.0000' AS bottle_bbox FROM part WHERE p_partkey % 5 < 2""")
def row_assembly(spark, d):
    price = F.col("p_size") + 0.5
    rail = F.when(F.col("p_partkey") % 3 == 0, F.array(price + 1, price)).otherwise(F.array(price, price + 1))
    jobs = t(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("job_id"), F.lit("a/b.jpg").alias("photo"), F.lit("s").alias("photo_sha256"), F.lit(None).cast("string").alias("photo_taken_at"), F.array(F.lit(1000), F.lit(500)).alias("photo_size"),
        F.lit("Shop").alias("store"), F.lit("folder").alias("store_source"), F.lit("shelf 1").alias("band_label"), F.array(*map(F.lit, (0.2, 0.0, 0.6, 1.0))).alias("crop_box"), rail.alias("ocr_prices"),
    )
    rows, _ = report.assemble(jobs, _answers(spark, d), "m", "now")
    return rows.select("job_id", "wine_name", "vintage", "currency", "volume_ml", "price_per_litre", "grape_varieties", "price_check", "ocr_price_check", "bottle_bbox")


@query(f"""WITH l AS (SELECT l_returnflag AS folder, l_orderkey, l_extendedprice FROM lineitem WHERE l_linenumber > 1), u AS (SELECT DISTINCT o_orderstatus AS folder FROM orders)
  SELECT folder, count(DISTINCT l_orderkey) AS photos, count(l_orderkey) AS n_rows, {R2.format('quantile_cont(l_extendedprice, 0.5)')} AS median_price, CASE WHEN count(l_orderkey) > 0 THEN 'RON' ELSE '' END AS currency
  FROM l FULL JOIN u USING (folder) GROUP BY folder""")
def folder_mirror(spark, d):
    rows = t(spark, d, "lineitem").select(
        F.concat("l_returnflag", F.lit("/"), F.col("l_orderkey").cast("string")).alias("photo"), F.col("l_extendedprice").alias("price"), F.lit("RON").alias("currency"), F.lit("").alias("needs_review"), F.when(F.col("l_linenumber") == 1, "W1").alias("duplicate_of"))
    unmatched = t(spark, d, "orders").select(F.concat("o_orderstatus", F.lit("/"), F.col("o_orderkey").cast("string")).alias("photo"))
    return report.folder_index(rows, unmatched).select("folder", "photos", "n_rows", "median_price", "currency")


@query("""SELECT key, arg_max(brand, o) AS brand, arg_max(confidence, o) AS confidence FROM (SELECT o_custkey::VARCHAR AS key, o_orderkey AS o,
  (ARRAY['A | B', 'C | D', NULL])[1 + o_orderkey % 3] AS brand, CASE WHEN o_orderkey % 3 < 2 THEN 'medium' ELSE 'low' END AS confidence FROM orders) GROUP BY key HAVING max(o) % 3 < 2""")
def reviewed_verdicts(spark, d):
    from tagwright.sources.ingest import verdicts

    o = t(spark, d, "orders")
    picks = o.select(F.lit("f").alias("file"), F.col("o_orderkey").alias("ordinal"), F.col("o_custkey").cast("string").alias("key"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("choice"), F.lit(None).cast("string").alias("confidence"))
    batches = o.select(F.lit("f").alias("file"), F.col("o_custkey").cast("string").alias("key"), F.array(F.lit("A | B"), F.lit("C | D")).alias("candidates")).distinct()
    return verdicts(batches, picks).filter("brand IS NOT NULL")


# --- tiles and boxes -------------------------------------------------------------------


@query("""WITH x AS (SELECT p_partkey, p_size * 211 AS len FROM part), n AS (SELECT *, CASE WHEN len <= 2576 THEN 1 ELSE (SELECT min(g) FROM range(2, 26) r(g) WHERE len / (g - (g - 1) * 0.14::DOUBLE) <= 2576) END AS n FROM x),
  s AS (SELECT *, len / (n - (n - 1) * 0.14::DOUBLE) AS span FROM n), g AS (SELECT *, unnest(range(0, n)) AS i FROM s)
  SELECT p_partkey, i::INTEGER AS tile, CASE WHEN n = 1 THEN 0 ELSE trunc(i * ((len - span) / (n - 1)))::INTEGER END AS lo, CASE WHEN n = 1 THEN len ELSE trunc(least(len, i * ((len - span) / (n - 1)) + span))::INTEGER END AS hi FROM g""")
def tile_spans(spark, d):
    cut = geometry.spans(F.col("p_size") * 211, F.lit(geometry.MAX_EDGE))
    return t(spark, d, "part").select("p_partkey", F.posexplode(cut).alias("tile", "s")).select("p_partkey", "tile", "s.lo", "s.hi")


@query("""SELECT p_partkey, floor(least(CASE WHEN p_size % 2 = 0 THEN 4784.0 ELSE 1600.0 END, p_size * 100 * least(1.0::DOUBLE, e / greatest(p_size * 100, 1500)) * (1500 * least(1.0::DOUBLE, e / greatest(p_size * 100, 1500))) / 750))::INTEGER AS tokens
  FROM (SELECT *, CASE WHEN p_size % 2 = 0 THEN 2576 ELSE 1568 END AS e FROM part)""")
def image_tokens(spark, d):
    edge = F.when(F.col("p_size") % 2 == 0, 2576).otherwise(1568)
    return t(spark, d, "part").select("p_partkey", geometry.image_tokens(F.col("p_size") * 100, F.lit(1500), edge).alias("tokens"))


@query("""SELECT p_partkey, printf('%.4f,%.4f,%.4f,%.4f', p_size / 100.0, 0.25, p_size / 80.0, 0.75) AS bbox, CASE WHEN least(p_size / 80.0, 0.6) > greatest(p_size / 100.0, 0.3)
  THEN round((least(p_size / 80.0, 0.6) - greatest(p_size / 100.0, 0.3)) / least(p_size / 80.0 - p_size / 100.0, 0.3), 6) ELSE 0 END AS overlap FROM part""")
def boxes(spark, d):
    s = F.col("p_size")
    box = F.struct((s / 100.0).alias("x0"), F.lit(0.25).alias("y0"), (s / 80.0).alias("x1"), F.lit(0.75).alias("y1"))
    return t(spark, d, "part").select("p_partkey", geometry.format_bbox(box).alias("bbox"), F.round(geometry.x_overlap(s / 100.0, s / 80.0, F.lit(0.3), F.lit(0.6)), 6).alias("overlap"))


# --- extensions: rollup, windows, approximate counts ---------------------------------------


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def price_rollup(spark, d):
    return t(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2""")
def tumbling_counts(spark, d):
    e = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return tumbling(e).withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn("total", F.round("total", 6))


@query("""WITH e AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE, TRUE) AS fresh FROM events),
  s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark, d):
    e = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    got = sessions(e)
    return got.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})
