"""Queries over the driver's tables and their SQL.

Where the tables hold no packages, the queries apply the passes' algebra to what they do hold; their docstrings say analogue.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trimlake.functions import markup
from trimlake.functions.detect import detect_column, detect_sql, family_column
from trimlake.operators import relational as R
from trimlake.plans.function_cases import TEXT_CASES, text_query, text_sql
from trimlake.plans.optimize import batch_totals, bytes_saved, format_bytes, optimize_documents, pass_totals
from trimlake.plans.package_cases import CASES, package_query, package_sql
from trimlake.session import shared_folder, ship
from trimlake.sources.files import put_files, repack, scan_files, unpack, write_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _host():
    return F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)


HOST = "regexp_extract(url, '^[a-z]+://([^/]+)', 1)"
STRIPPED = """SELECT page_id, url, html, regexp_replace(html, '<!--.*?-->', '', 'gs') AS new FROM pages"""
SIZES = f"""SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS original_size, CASE WHEN contains(new, '<html') AND strlen(new) < strlen(html) THEN CAST(strlen(new) AS BIGINT) ELSE CAST(strlen(html) AS BIGINT) END AS optimized_size FROM ({STRIPPED})"""


def _strip_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url and both sizes; the stripped text itself goes no further."""
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", "html").withColumn("new", markup.strip_html_comments(F.col("html")))
    size = pages.select("page_id", "url", F.octet_length("html").cast("long").alias("original_size"), F.octet_length("new").cast("long").alias("new_size"), F.contains("new", F.lit("<html")).alias("valid"))
    better = F.col("valid") & (F.col("new_size") < F.col("original_size"))
    return size.select("page_id", "url", "original_size", F.when(better, F.col("new_size")).otherwise(F.col("original_size")).alias("optimized_size"))


@query(f"SELECT page_id, original_size, optimized_size, optimized_size < original_size AS success FROM ({SIZES})")
def html_strip(spark, sf_dir):
    """Comment stripping: a candidate counts if it still is a page and is strictly smaller."""
    return _strip_pages(spark, sf_dir).select("page_id", "original_size", "optimized_size", (F.col("optimized_size") < F.col("original_size")).alias("success"))


@query(f"SELECT {HOST} AS host, count(*) AS pages, CAST(sum(original_size) AS BIGINT) AS original_size, CAST(sum(original_size - optimized_size) AS BIGINT) AS saved FROM ({SIZES}) GROUP BY 1")
def html_report(spark, sf_dir):
    """Bytes by host."""
    rows = _strip_pages(spark, sf_dir).withColumn("host", _host())
    return rows.groupBy("host").agg(F.count("*").alias("pages"), F.sum("original_size").alias("original_size"), F.sum(bytes_saved(F.col("original_size"), F.col("optimized_size"))).alias("saved"))


@query(
    f"SELECT CAST(page_id AS VARCHAR) AS id, 'pages' AS source_table, {detect_sql('html', 'url')} AS format FROM pages "
    f"UNION ALL SELECT CAST(doc_id AS VARCHAR), 'documents', {detect_sql('text', 'source')} FROM documents"
)
def detect_format(spark, sf_dir):
    """The detection rules as one column expression over two tables."""
    pages = _read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("id"), F.lit("pages").alias("source_table"), detect_column(F.col("html").cast("binary"), F.col("url")).alias("format"))
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit("documents").alias("source_table"), detect_column(F.col("text").cast("binary"), F.col("source")).alias("format"))
    return pages.unionByName(docs)


@query(
    f"SELECT CAST(page_id AS VARCHAR) AS id, CASE f WHEN 'HTML' THEN 'html' WHEN 'SVG' THEN 'image' WHEN 'FODT' THEN 'fodt' ELSE 'unknown' END AS family, f IN ('SVG', 'PNG', 'JPEG', 'WEBP') AS is_image FROM (SELECT page_id, {detect_sql('html', 'url')} AS f FROM pages)"
)
def format_families(spark, sf_dir):
    """Family predicates from the format dimension."""
    name = detect_column(F.col("html").cast("binary"), F.col("url"))
    family = family_column(F.col("name"))
    return _read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("id"), name.alias("name")).select("id", family.alias("family"), (family == "image").alias("is_image"))


@query("SELECT sha256(text) AS digest, CAST(strlen(text) AS BIGINT) AS size, min(doc_id) AS canonical, count(*) AS copies, CAST(strlen(text) * (count(*) - 1) AS BIGINT) AS bytes_saved FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def exact_dedup(spark, sf_dir):
    """Media deduplication's algebra over a corpus: groups of equal content."""
    return R.duplicate_groups(_read(spark, sf_dir, "documents"), "text", "doc_id").where("copies > 1")


@query("SELECT d.doc_id AS duplicate, c.canonical, CAST(strlen(d.text) AS BIGINT) AS size FROM documents d JOIN (SELECT text, min(doc_id) AS canonical FROM documents GROUP BY text) c ON d.text = c.text WHERE d.doc_id <> c.canonical")
def dedup_map(spark, sf_dir):
    """Each duplicate with the row that stays."""
    return R.duplicate_map(_read(spark, sf_dir, "documents"), "text", "doc_id").select("duplicate", "canonical", "size")


@query("""SELECT source, sha256(text) AS digest, min(doc_id) AS canonical, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY source, text HAVING count(*) > 1""")
def dedup_within(spark, sf_dir):
    """The same inside each source, as inside each package."""
    return R.duplicate_groups(_read(spark, sf_dir, "documents"), "text", "doc_id", ["source"]).where("copies > 1").select("source", "digest", "canonical", "copies")


@query("""
    WITH c AS (
        SELECT doc_id, 0 AS rank, text AS body, TRUE AS valid FROM documents
        UNION ALL SELECT doc_id, 1, array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: list_position(string_split(text, chr(10)), x) = i), chr(10)), strlen(text) > 0 FROM documents)
    SELECT doc_id, CAST(strlen(body) AS BIGINT) AS size, rank FROM c WHERE valid QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY strlen(body), rank) = 1""")
def candidate_best(spark, sf_dir):
    """Candidate selection: the text as it is, or without repeated lines; smallest valid, first of equals."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    lines = F.concat_ws("\n", F.array_distinct(F.split("text", "\n")))
    tries = docs.select("doc_id", F.explode(F.array(
        F.struct(F.lit(0).alias("rank"), F.octet_length("text").cast("long").alias("size"), F.lit(True).alias("valid")),
        F.struct(F.lit(1).alias("rank"), F.octet_length(lines).cast("long").alias("size"), (F.octet_length("text") > 0).alias("valid")),
    )).alias("c")).select("doc_id", "c.*")
    return R.best_candidate(tries, ["doc_id"], "size", "rank", "valid", ["size", "rank"])


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def orphans(spark, sf_dir):
    """Analogue of orphan pruning: documents that no label refers to."""
    return R.orphans(_read(spark, sf_dir, "documents").select("doc_id", "lang"), _read(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def referenced(spark, sf_dir):
    """Analogue of numbering pruning's semi join: documents that a label refers to."""
    return R.referenced(_read(spark, sf_dir, "documents").select("doc_id", "lang"), _read(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT line, CAST(dense_rank() OVER (ORDER BY line) - 1 AS BIGINT) AS new_id FROM (SELECT DISTINCT unnest(string_split(text, chr(10))) AS line FROM documents)")
def shared_strings(spark, sf_dir):
    """Analogue of the shared-string table: distinct lines, numbered without gaps."""
    lines = _read(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return R.renumbered(lines, "line")


@query("""
    WITH c AS (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2), s AS (SELECT *, sum(n) OVER (PARTITION BY source) AS total, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS r FROM c)
    SELECT source, lang, CAST(n AS BIGINT) AS n, CAST(total AS BIGINT) AS total FROM s WHERE r = 1 AND n >= 10 AND n >= total * 0.5""")
def dominant_value(spark, sf_dir):
    """Analogue of the dominant run language: top language of a source, at least ten rows and half of them."""
    return R.dominant_value(_read(spark, sf_dir, "documents"), "source", "lang", 10, 0.5)


PAGE_LANG = "regexp_extract(html, '<html[^>]*lang=\"([^\"]*)\"', 1)"


@query(f"SELECT host, min(lang) AS lang, count(*) AS n FROM (SELECT {HOST} AS host, {PAGE_LANG} AS lang FROM pages) GROUP BY host HAVING count(*) >= 2 AND count(DISTINCT lang) = 1")
def unanimous_default(spark, sf_dir):
    """Analogue of content-type defaults: hosts whose pages agree on a language."""
    pages = _read(spark, sf_dir, "pages").select(_host().alias("host"), F.regexp_extract("html", '<html[^>]*lang="([^"]*)"', 1).alias("lang"))
    return R.unanimous_value(pages, "host", "lang")


@query("""
    WITH e AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM e)
    SELECT user_id, run, event_type, count(*) AS n_rows FROM r GROUP BY 1, 2, 3""")
def islands(spark, sf_dir):
    """Analogue of run merging: neighbouring events of a user with one type."""
    return R.islands(_read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("""
    WITH RECURSIVE e AS (SELECT conv_id, turn AS src, turn + 1 AS dst FROM conversations UNION ALL SELECT conv_id, turn, 0 FROM conversations WHERE turn % 2 = 0),
    r(conv_id, node) AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) FROM conversations UNION SELECT e.conv_id, e.dst FROM r JOIN e ON r.conv_id = e.conv_id AND r.node = e.src)
    SELECT conv_id, node FROM r""")
def reachable(spark, sf_dir):
    """Analogue of style and object closure: turns that lead on to the next, with edges back to the first, so there are cycles."""
    turns = _read(spark, sf_dir, "conversations")
    on = turns.select("conv_id", F.col("turn").alias("src"), (F.col("turn") + 1).alias("dst"))
    back = turns.where(F.col("turn") % 2 == 0).select("conv_id", F.col("turn").alias("src"), F.lit(0).cast("long").alias("dst"))
    roots = turns.select("conv_id", F.lit(0).cast("long").alias("node"))
    return R.reachable(on.unionByName(back), roots, ["conv_id"])


@query(f"SELECT dst AS host, min(src) AS page_id FROM (SELECT page_id AS src, {HOST} AS dst FROM pages) GROUP BY dst HAVING count(*) = 1")
def used_once(spark, sf_dir):
    """Analogue of object inlining: hosts that one page has."""
    edges = _read(spark, sf_dir, "pages").select(F.col("page_id").alias("src"), _host().alias("dst"))
    return R.used_once(edges).select(F.col("dst").alias("host"), F.col("src").alias("page_id"))


@query("SELECT l_orderkey, l_linenumber, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS position FROM lineitem")
def grid_positions(spark, sf_dir):
    """Analogue of a cell's place in the table grid: the sum of the spans before it."""
    rows = R.positions(_read(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], F.col("l_quantity").cast("long"))
    return rows.select("l_orderkey", "l_linenumber", "position")


@query(f"SELECT {HOST} AS host, {PAGE_LANG} AS lang, CAST(grouping({HOST}, {PAGE_LANG}) AS BIGINT) AS level, count(*) AS n_rows, CAST(sum(strlen(html)) AS BIGINT) AS sum_size FROM pages GROUP BY ROLLUP ({HOST}, {PAGE_LANG})")
def report_rollup(spark, sf_dir):
    """The report rolled up over two levels."""
    pages = _read(spark, sf_dir, "pages").select(_host().alias("host"), F.regexp_extract("html", '<html[^>]*lang="([^"]*)"', 1).alias("lang"), F.octet_length("html").alias("size"))
    return R.rolled_up(pages, ["host", "lang"], ["size"])


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def first_of_equals(spark, sf_dir):
    """Analogue of fonts named twice: the first row of each text."""
    return R.first_of_equals(_read(spark, sf_dir, "documents").where("text IS NOT NULL"), "text", "doc_id")


TRIMMED = "regexp_replace(regexp_replace(CAST(CAST(value AS DECIMAL(12,4)) AS VARCHAR), '(\\.[0-9]*[1-9])0+$', '\\1'), '\\.0+$', '')"


@query(f"SELECT event_id, CASE WHEN {TRIMMED} = '-0' THEN '0' ELSE {TRIMMED} END AS short FROM events")
def numeric_trim(spark, sf_dir):
    """Numbers without trailing zeros."""
    return _read(spark, sf_dir, "events").select("event_id", markup.trim_number(F.col("value").cast("decimal(12,4)").cast("string")).alias("short"))


@query("""
    WITH s AS (SELECT page_id, unnest(regexp_extract_all(html, '<style>(.*?)</style>', 1, 's')) AS css FROM pages)
    SELECT page_id, css, regexp_replace(regexp_replace(regexp_replace(css, '/\\*.*?(\\*/|\\z)', '', 'gs'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), '(^|[{}:;]) ', '\\1', 'g') AS short FROM s""")
def css_min(spark, sf_dir):
    """Style sheets of pages."""
    rows = _read(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("(?s)<style>(.*?)</style>"), 1)).alias("css"))
    return rows.select("page_id", "css", markup.minify_css(F.col("css")).alias("short"))


@query("SELECT page_id, regexp_replace(html, '<!--.*?(-->|\\z)', '', 'gs') AS stripped FROM pages")
def xml_comments(spark, sf_dir):
    """The markup rule for comments: an unclosed one takes the rest."""
    return _read(spark, sf_dir, "pages").select("page_id", markup.strip_xml_comments(F.col("html")).alias("stripped"))


@query("SELECT page_id, CAST(strlen(html) AS BIGINT) AS n_bytes, contains(html, '<html') OR contains(html, '<!doctype') OR contains(html, '<!DOCTYPE') AS valid FROM pages")
def validate_html(spark, sf_dir):
    """The structure check of pages."""
    html = F.col("html")
    return _read(spark, sf_dir, "pages").select("page_id", F.octet_length(html).cast("long").alias("n_bytes"), (F.contains(html, F.lit("<html")) | F.contains(html, F.lit("<!doctype")) | F.contains(html, F.lit("<!DOCTYPE"))).alias("valid"))


@query("SELECT doc_id, to_base64(encode(text)) AS coded, text AS decoded FROM documents")
def base64_round_trip(spark, sf_dir):
    """Base64 there and back."""
    rows = _read(spark, sf_dir, "documents").select("doc_id", F.base64(F.col("text").cast("binary")).alias("coded"))
    rows = rows.select("doc_id", F.regexp_replace("coded", "\r\n", "").alias("coded"))
    return rows.select("doc_id", "coded", F.unbase64("coded").cast("string").alias("decoded"))


@query()
def checksums(spark, sf_dir):
    """CRC-32 of texts; SQL has no such function here."""
    return _read(spark, sf_dir, "documents").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc32"))


@query("SELECT doc_id, TRUE AS balanced FROM documents WHERE NOT contains(text, '<') UNION ALL SELECT doc_id, FALSE FROM documents WHERE contains(text, '<')")
def well_formed(spark, sf_dir):
    """Tag balance of texts, as an Arrow function: texts without tags are balanced; here a lone angle bracket never is."""
    ship(spark)
    return _read(spark, sf_dir, "documents").select("doc_id", markup.well_formed(F.col("text")).alias("balanced"))


@query("SELECT page_id, FALSE AS balanced FROM pages")
def pages_balanced(spark, sf_dir):
    """No page of the tables is balanced markup (unclosed breaks), so passes that ask for it leave pages alone."""
    ship(spark)
    return _read(spark, sf_dir, "pages").select("page_id", markup.well_formed(F.col("html")).alias("balanced"))


def _page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return pages.select(F.col("page_id").cast("string").alias("doc_id"), F.col("url").alias("path"), F.lit("page.html").alias("hint"), F.col("html").cast("binary").alias("content"))


@query(f"SELECT CAST(page_id AS VARCHAR) AS doc_id, 'HTML' AS format, optimized_size < original_size AS success, original_size, optimized_size FROM ({SIZES})")
def engine_pages(spark, sf_dir):
    """The whole engine, file by file, over pages."""
    return optimize_documents(_page_files(spark, sf_dir)).select("doc_id", "format", "success", "original_size", "optimized_size")


@query(f"SELECT 'HTML' AS format, count(*) AS files, CAST(sum(CASE WHEN optimized_size < original_size THEN 1 ELSE 0 END) AS BIGINT) AS optimized, CAST(sum(original_size) AS BIGINT) AS original_size, CAST(sum(optimized_size) AS BIGINT) AS optimized_size FROM ({SIZES})")
def engine_totals(spark, sf_dir):
    """Totals by format."""
    return batch_totals(optimize_documents(_page_files(spark, sf_dir)))


@query(f"""
    WITH s AS (SELECT CAST(strlen(html) - strlen(new) AS BIGINT) AS saved FROM ({STRIPPED})), r AS (SELECT count(*) AS documents, CAST(sum(saved) AS BIGINT) AS raw_saved FROM s WHERE saved > 0)
    SELECT 'HTML' AS format, 'HTML Minification' AS pass, raw_saved, documents FROM r UNION ALL SELECT 'HTML', NULL, raw_saved, documents FROM r UNION ALL SELECT NULL, NULL, raw_saved, documents FROM r""")
def engine_passes(spark, sf_dir):
    """Raw savings by pass, rolled up."""
    return pass_totals(optimize_documents(_page_files(spark, sf_dir)))


_N = "CAST(strlen(html) AS BIGINT)"
_TENTHS, _HUNDREDTHS = f"(({_N} * 20 + 1024) // 2048)", f"(({_N} * 200 + 1048576) // 2097152)"


@query(f"""
    SELECT page_id, CASE WHEN {_N} < 1024 THEN {_N} || ' B' WHEN {_N} < 1048576 THEN {_TENTHS} // 10 || '.' || {_TENTHS} % 10 || ' KB'
    ELSE {_HUNDREDTHS} // 100 || '.' || lpad(CAST({_HUNDREDTHS} % 100 AS VARCHAR), 2, '0') || ' MB' END AS shown FROM pages""")
def report_sizes(spark, sf_dir):
    """Sizes for people, halves rounded up."""
    return _read(spark, sf_dir, "pages").select("page_id", format_bytes(F.octet_length("html").cast("long")).alias("shown"))


@query(f"SELECT CAST(page_id AS VARCHAR) || '.slim.html' AS name, optimized_size AS length FROM ({SIZES}) WHERE optimized_size < original_size")
def files_in_and_out(spark, sf_dir):
    """Scan, engine and sink: pages as files in a folder, optimised beside their inputs, and the outputs' names and lengths as found there."""
    folder = shared_folder(spark)
    pages = _read(spark, sf_dir, "pages").select(F.concat(F.lit(f"{folder}/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content"))
    R.saved_table(put_files(pages))
    R.saved_table(write_files(optimize_documents(scan_files(spark, folder))))
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.slim.*").load(folder)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


@query("""
    WITH p AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, 0 AS ord, 'mimetype' AS name, CAST(1 AS BIGINT) AS size FROM p
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 1, 'a.txt', CAST(strlen(split_part(t, chr(10), 1)) AS BIGINT) FROM p
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 2, 'b' || doc_id || '.txt', CAST(strlen(t) AS BIGINT) FROM p""")
def parts_round_trip(spark, sf_dir):
    """Parts nested into packages, packages unnested into parts, in the order in which a package holds them."""
    text = F.coalesce("text", F.lit(""))
    part = lambda n, name, data: F.struct(F.lit(n).alias("ord"), name.alias("name"), data.cast("binary").alias("data"))
    name = F.concat(F.lit("b"), F.col("doc_id").cast("string"), F.lit(".txt"))
    parts = F.array(part(0, name, text), part(1, F.lit("a.txt"), F.split_part(text, F.lit("\n"), F.lit(1))), part(2, F.lit("mimetype"), F.lit("m")))
    rows = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.explode(parts).alias("p")).select("doc_id", "p.*", F.lit(0).cast("long").alias("attributes"), F.lit(False).alias("stored"), F.lit("ok").alias("status"))
    return unpack(repack(rows)).select("doc_id", "ord", "name", "size")


for _name in CASES:
    QUERIES[_name], SQL[_name] = package_query(_name), package_sql(_name)
for _name in TEXT_CASES:
    QUERIES[_name], SQL[_name] = text_query(_name), text_sql(_name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
