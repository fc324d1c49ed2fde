"""Catalogue of the named queries and their SQL.

The tables hold prose and web pages, so documents stand for source files, their
literals for symbols, lines for scopes, HTML comments for comments, and links for
imports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispan.functions import diagnostics, naming, spans
from lexispan.operators import labels as label_ops
from lexispan.operators import pattern, references, resolve, rewrite
from lexispan.plans import language_queries, structure_queries

#: Registered queries and SQL by name.
_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return _QUERIES | language_queries.queries() | structure_queries.queries()


def oracle_sql() -> dict[str, str]:
    return _SQL | language_queries.oracle_sql() | structure_queries.oracle_sql()


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("file_path"), "lang", "source", F.col("text").alias("content"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entity_id"), F.explode(F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("source:"), "source"))).alias("label"))
    marks = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("entity_id"), F.explode(F.array(F.concat(F.lit("quality:"), F.col("quality").cast("string")), F.concat(F.lit("toxic:"), F.col("toxic").cast("string")))).alias("label"))
    return d.unionByName(marks).where("label IS NOT NULL")


_LABEL_CTE = """
l AS (SELECT doc_id AS entity_id, 'lang:' || lang AS label FROM documents UNION ALL SELECT doc_id, 'source:' || source FROM documents
  UNION ALL SELECT doc_id, 'quality:' || quality FROM labels UNION ALL SELECT doc_id, 'toxic:' || toxic FROM labels)"""


@_query(f"""WITH {_LABEL_CTE}, e AS (SELECT entity_id FROM l WHERE label IN ('lang:en', 'quality:1') GROUP BY 1 HAVING count(DISTINCT label) = 2)
SELECT d.doc_id, d.source, octet_length(encode(d.text))::BIGINT AS n_bytes FROM documents d JOIN e ON d.doc_id = e.entity_id""")
def label_and_query(spark, sf_dir):
    """Documents with both labels."""
    hit = label_ops.all_labels(_labels(spark, sf_dir), ["lang:en", "quality:1"])
    d = _table(spark, sf_dir, "documents").select("doc_id", "source", F.octet_length("text").cast("bigint").alias("n_bytes"))
    return d.join(hit.withColumnRenamed("entity_id", "doc_id"), "doc_id")


@_query(f"WITH {_LABEL_CTE} SELECT label, count(*) AS n_entities FROM l WHERE label IS NOT NULL GROUP BY 1")
def label_list_counts(spark, sf_dir):
    return label_ops.label_counts(_labels(spark, sf_dir))


@_query(f"""WITH {_LABEL_CTE}, w AS (SELECT unnest(['lang:en', 'source:src1', 'lang:zz']) AS label)
SELECT w.label, count(l.entity_id) AS n_entities FROM w LEFT JOIN l ON w.label = l.label GROUP BY 1""")
def label_count_independent(spark, sf_dir):
    return label_ops.requested_counts(_labels(spark, sf_dir), ["lang:en", "source:src1", "lang:zz"])


_PATHS = [(-1, "main.rs"), (-2, "a/b.py"), (-3, "x.H"), (-4, "lib.hpp"), (-5, "src/App.tsx"), (-6, ".rs"), (-7, "noext"), (-8, "a.b/c"), (-9, "m.cjs")]


@_query(
    "WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path FROM pages UNION ALL SELECT * FROM (VALUES "
    + ", ".join(f"({i}, '{p}')" for i, p in _PATHS)
    + ")), x AS (SELECT *, regexp_extract(string_split(path, '/')[-1], '^.+\\.([^.]*)$', 1) AS ext FROM p) SELECT page_id, path, CASE ext "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in naming.EXTENSIONS.items())
    + " END AS language FROM x"
)
def language_detect(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("path"))
    some = spark.createDataFrame(_PATHS, "page_id bigint, path string")
    return pages.unionByName(some).withColumn("language", naming.detect_language("path"))


_LINES = """
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS line_no FROM documents WHERE text IS NOT NULL),
li AS (SELECT doc_id, line_no, octet_length(encode(line))::BIGINT AS n_bytes,
  coalesce(sum(octet_length(encode(line)) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_start, line FROM ln)"""


@_query(f"WITH {_LINES} SELECT doc_id, line_no, byte_start, n_bytes FROM li")
def line_index(spark, sf_dir):
    return spans.line_index(_files(spark, sf_dir)).withColumnRenamed("file_path", "doc_id")


@_query(f"""WITH {_LINES}, o AS (SELECT doc_id, k, (octet_length(encode(text)) // k)::BIGINT AS at FROM documents, (VALUES (2), (3), (7)) v(k) WHERE text IS NOT NULL)
SELECT o.doc_id, o.k, o.at, li.line_no, o.at - li.byte_start AS col FROM o ASOF JOIN li ON o.doc_id = li.doc_id AND o.at >= li.byte_start""")
def offset_to_line(spark, sf_dir):
    f = _files(spark, sf_dir)
    at = f.select("file_path", F.explode(F.array(*map(F.lit, (2, 3, 7)))).alias("k"), "content").select("file_path", "k", F.floor(F.octet_length("content") / F.col("k")).cast("bigint").alias("at"))
    return spans.offset_to_line(at, spans.line_index(f), "at").withColumnRenamed("file_path", "doc_id")


@_query("""WITH s AS (SELECT doc_id, encode(text) AS b, octet_length(encode(text)) AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, (n // 4)::BIGINT AS byte_start, (n // 2)::BIGINT AS byte_end, sha256(b[(n // 4) + 1:(n // 2)]) AS chunk_sha256 FROM s""")
def byte_slice_chunk(spark, sf_dir):
    n = F.octet_length("content")
    f = _files(spark, sf_dir).select(F.col("file_path").alias("doc_id"), "content", F.floor(n / 4).cast("bigint").alias("byte_start"), F.floor(n / 2).cast("bigint").alias("byte_end"))
    return f.select("doc_id", "byte_start", "byte_end", F.sha2(spans.slice_bytes("content", "byte_start", "byte_end"), 256).alias("chunk_sha256"))


_BOUNDARY = "(substr(hex(b[{0} + 1:{0} + 1]), 1, 1) NOT IN ('8', '9', 'A', 'B'))"


@_query(f"""WITH s AS (SELECT doc_id, encode(text) AS b, octet_length(encode(text)) AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, (n // 3)::BIGINT AS byte_start, (n // 2)::BIGINT AS byte_end, {_BOUNDARY.format("(n // 3)")} AND {_BOUNDARY.format("(n // 2)")} AS is_valid FROM s""")
def utf8_boundary_check(spark, sf_dir):
    n = F.octet_length("content")
    f = _files(spark, sf_dir).select(F.col("file_path").alias("doc_id"), "content", F.floor(n / 3).cast("bigint").alias("byte_start"), F.floor(n / 2).cast("bigint").alias("byte_end"))
    return f.select("doc_id", "byte_start", "byte_end", spans.utf8_ok("content", "byte_start", "byte_end").alias("is_valid"))


def _find_sql(name: str, needle: str, table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    n = len(needle.encode())
    return f"""
{name}_p AS (SELECT {key}, unnest(string_split({text}, '{needle}')) AS piece, generate_subscripts(string_split({text}, '{needle}'), 1) AS k, len(string_split({text}, '{needle}')) AS parts FROM {table} WHERE {text} IS NOT NULL),
{name} AS (SELECT {key}, (k - 1)::BIGINT AS nth, byte_end - {n} AS byte_start, byte_end FROM (SELECT {key}, k, parts,
  (sum(octet_length(encode(piece)) + {n}) OVER (PARTITION BY {key} ORDER BY k))::BIGINT AS byte_end FROM {name}_p) WHERE k < parts)"""


@_query(f"WITH {_find_sql('m', 'tion')} SELECT doc_id, nth, byte_start, byte_end FROM m")
def literal_find_positions(spark, sf_dir):
    return spans.literal_positions(_files(spark, sf_dir), "tion").withColumnRenamed("file_path", "doc_id")


@_query("""SELECT doc_id, (len(string_split(text, 'tion')) - 1)::BIGINT AS n_edits, sha256(text) AS before_sha256, sha256(replace(text, 'tion', 'TION!é')) AS after_sha256
FROM documents WHERE contains(text, 'tion')""")
def literal_replace_hashes(spark, sf_dir):
    f = _files(spark, sf_dir)
    found = spans.literal_positions(f, "tion").select("file_path", "byte_start", "byte_end", F.lit("TION!é").alias("content"))
    return rewrite.rewritten(found, f).select(F.col("file_path").alias("doc_id"), "n_edits", "before_sha256", "after_sha256")


def _pages(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "pages").where("html IS NOT NULL").select(F.col("page_id").alias("file_path"), F.col("html").alias("content"))


def _comments(pages: DataFrame) -> DataFrame:
    """(file_path, byte_start, byte_end) of HTML comments, from running sums over the text between them and the comments."""
    p = r"(?s)<!--.*?-->"
    both = F.arrays_zip(F.split("content", p, -1).alias("gap"), F.regexp_extract_all("content", F.lit(p), F.lit(0)).alias("node"))
    rows = pages.where(F.contains("content", F.lit("<!--"))).select("file_path", F.posexplode(both).alias("k", "x")).select("file_path", "k", F.octet_length("x.gap").cast("bigint").alias("g"), F.octet_length("x.node").cast("bigint").alias("n"))
    end = F.sum(F.col("g") + F.coalesce("n", F.lit(0))).over(Window.partitionBy("file_path").orderBy("k"))
    return rows.withColumn("byte_end", end.cast("bigint")).where("n IS NOT NULL").select("file_path", (F.col("byte_end") - F.col("n")).alias("byte_start"), "byte_end")


@_query(f"""WITH {_find_sql("m", "an", "pages", "page_id", "html")},
c AS (SELECT page_id, unnest(regexp_split_to_array(html, '(?s)<!--.*?-->')) AS gap, generate_subscripts(regexp_split_to_array(html, '(?s)<!--.*?-->'), 1) AS k FROM pages WHERE html IS NOT NULL),
d AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<!--.*?-->')) AS node, generate_subscripts(regexp_extract_all(html, '(?s)<!--.*?-->'), 1) AS k FROM pages WHERE html IS NOT NULL),
n AS (SELECT c.page_id, octet_length(encode(d.node)) AS n, sum(octet_length(encode(c.gap)) + coalesce(octet_length(encode(d.node)), 0)) OVER (PARTITION BY c.page_id ORDER BY c.k) AS byte_end, d.node FROM c LEFT JOIN d ON c.page_id = d.page_id AND c.k = d.k)
SELECT page_id, nth, byte_start FROM m WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.node IS NOT NULL AND n.page_id = m.page_id AND n.byte_end - n.n <= m.byte_start AND m.byte_start < n.byte_end)""")
def find_outside_comments(spark, sf_dir):
    p = _pages(spark, sf_dir)
    return pattern.outside_nodes(spans.literal_positions(p, "an"), _comments(p)).select(F.col("file_path").alias("page_id"), "nth", "byte_start")


@_query(f"""WITH {_find_sql("a", "ere")}, {_find_sql("b", "ren")}, u AS (SELECT doc_id, 0::BIGINT AS ordinal, byte_start, byte_end FROM a UNION ALL SELECT doc_id, 1, byte_start, byte_end FROM b)
SELECT doc_id, ordinal, byte_start, byte_end, coalesce(max(byte_end) OVER (PARTITION BY doc_id ORDER BY byte_start, byte_end, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > byte_start, false) AS overlaps FROM u""")
def span_overlap_check(spark, sf_dir):
    f = _files(spark, sf_dir)
    both = [spans.literal_positions(f, w).select("file_path", F.lit(k).cast("bigint").alias("ordinal"), "byte_start", "byte_end") for k, w in enumerate(("ere", "ren"))]
    return rewrite.overlaps(both[0].unionByName(both[1])).withColumnRenamed("file_path", "doc_id")


@_query("""SELECT doc_id, sha256(replace(replace(text, 'qu', 'QÜ'), 'tion', '')) AS after_sha256 FROM documents WHERE contains(text, 'qu') OR contains(text, 'tion')""")
def span_batch_rewrite(spark, sf_dir):
    f = _files(spark, sf_dir)
    both = [spans.literal_positions(f, w).select("file_path", "byte_start", "byte_end", F.lit(new).alias("content")) for w, new in (("qu", "QÜ"), ("tion", ""))]
    return rewrite.rewritten(both[0].unionByName(both[1]), f).select(F.col("file_path").alias("doc_id"), "after_sha256")


@_query("""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, l[1] AS first, array_to_string(l[1:3], chr(10)) AS upto FROM s), y AS (SELECT doc_id, octet_length(encode(first)) AS a, octet_length(encode(upto)) AS b, substr(upto, length(first) + 1) AS old FROM x),
z AS (SELECT *, CASE WHEN old = '' THEN 0 ELSE length(old) - length(replace(old, chr(10), '')) + CASE WHEN old LIKE '%' || chr(10) THEN 0 ELSE 1 END END AS n FROM y)
SELECT doc_id, a::BIGINT AS byte_start, b::BIGINT AS byte_end, 1::BIGINT AS line_start, (1 + greatest(n - 1, 0))::BIGINT AS line_end, n::BIGINT AS lines_removed, 2::BIGINT AS lines_added, (b - a)::BIGINT AS bytes_removed, 9::BIGINT AS bytes_added FROM z""")
def patch_preview_stats(spark, sf_dir):
    f = _files(spark, sf_dir)
    at = lambda n: F.octet_length(F.substring_index("content", "\n", n)).cast("bigint")
    edits = f.select("file_path", at(1).alias("byte_start"), at(3).alias("byte_end"), F.lit("new\ntext\n").alias("content"))
    return rewrite.preview(edits, f).withColumnRenamed("file_path", "doc_id")


@_query(f"""WITH s AS (SELECT doc_id, encode(text) AS b, octet_length(encode(text)) AS n FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, doc_id % 500 AS batch_no, {_BOUNDARY.format("(n // 3)")} AS is_valid FROM s) SELECT *, bool_and(is_valid) OVER (PARTITION BY batch_no) AS applied FROM g""")
def batch_verdict(spark, sf_dir):
    g = _files(spark, sf_dir).select(F.col("file_path").alias("doc_id"), (F.col("file_path") % 500).alias("batch_no"), spans.at_boundary("content", F.floor(F.octet_length("content") / 3)).alias("is_valid"))
    return rewrite.verdict(g)


def _links(spark, sf_dir) -> DataFrame:
    """(file_path, ordinal, target) of the links of each page."""
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return _table(spark, sf_dir, "pages").select(F.col("page_id").alias("file_path"), F.posexplode(found).alias("ordinal", "target")).withColumn("ordinal", F.col("ordinal").cast("bigint"))


_LINKS = """
k AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1)::BIGINT - 1 AS ordinal FROM pages),
mo AS (SELECT target AS module, min(page_id) AS target_page FROM k WHERE ordinal = 0 GROUP BY 1)"""


def _modules(links: DataFrame) -> DataFrame:
    """A page is the module that its first link names; of several pages the first."""
    return links.where("ordinal = 0").groupBy(F.col("target").alias("module_path")).agg(F.min("file_path").alias("file_path"))


@_query(f"WITH {_LINKS} SELECT page_id, ordinal, target, string_split(target, '/')[-1] AS name, len(string_split(target, '/'))::BIGINT AS depth FROM k")
def import_facts(spark, sf_dir):
    return _links(spark, sf_dir).select(F.col("file_path").alias("page_id"), "ordinal", "target", F.substring_index("target", "/", -1).alias("name"), F.size(F.split("target", "/", -1)).cast("bigint").alias("depth"))


@_query(f"WITH {_LINKS} SELECT k.page_id, k.ordinal, k.target, mo.target_page FROM k LEFT JOIN mo ON k.target = mo.module")
def import_resolution(spark, sf_dir):
    k = _links(spark, sf_dir)
    m = _modules(k)
    imports = k.select("file_path", "ordinal", F.array("target").alias("path"))
    met = resolve.import_targets(imports, m)
    return met.select(F.col("file_path").alias("page_id"), "ordinal", F.element_at("path", 1).alias("target"), F.col("target_file").alias("target_page"))


@_query(f"""WITH {_LINKS}, i AS (SELECT k.*, mo.target_page, ordinal % 2 = 1 AS is_glob FROM k JOIN mo ON k.target = mo.module),
s AS (SELECT page_id, lower(target) AS name, min(ordinal) AS ordinal FROM k WHERE ordinal < 3 GROUP BY 1, 2), h AS (SELECT page_id, arg_min(name, ordinal) AS name FROM s GROUP BY 1),
p AS (SELECT DISTINCT page_id, lower(target) AS identifier FROM k WHERE ordinal >= 2),
c AS (SELECT p.*, s.page_id AS found_page, s.name, 0 AS priority, 0 AS o FROM p JOIN s ON p.page_id = s.page_id AND p.identifier = s.name
  UNION ALL SELECT p.*, i.target_page, coalesce(s.name, h.name), 1, i.ordinal FROM p JOIN i ON p.page_id = i.page_id AND NOT i.is_glob AND lower(i.target) = p.identifier LEFT JOIN s ON s.page_id = i.target_page AND s.name = p.identifier JOIN h ON h.page_id = i.target_page
  UNION ALL SELECT p.*, i.target_page, s.name, 2, i.ordinal FROM p JOIN i ON p.page_id = i.page_id AND i.is_glob JOIN s ON s.page_id = i.target_page AND s.name = p.identifier)
SELECT page_id, identifier, found_page, name, priority FROM c QUALIFY row_number() OVER (PARTITION BY page_id, identifier ORDER BY priority, o) = 1""")
def resolve_precedence(spark, sf_dir):
    k = _links(spark, sf_dir)
    m = _modules(k)
    symbols = k.where("ordinal < 3").groupBy("file_path", F.lower("target").alias("name")).agg(F.min("ordinal").alias("ordinal")).withColumn("kind", F.lit("link"))
    imports = resolve.import_targets(k.select("file_path", "ordinal", F.array("target").alias("path"), F.array(F.lower("target")).alias("imported_names"), (F.col("ordinal") % 2 == 1).alias("is_glob")), m)
    probes = k.where("ordinal >= 2").select(F.col("file_path").alias("current_file"), F.lower("target").alias("identifier"))
    return resolve.across_files(probes, symbols, imports).select(F.col("current_file").alias("page_id"), "identifier", F.col("file_path").alias("found_page"), "name", "priority")


@_query("""SELECT string_split(text, chr(10))[1] AS name, count(*) AS n_symbols, count(DISTINCT doc_id) AS n_files FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def symbol_ambiguity(spark, sf_dir):
    return resolve.ambiguous(_files(spark, sf_dir).select("file_path", F.substring_index("content", "\n", 1).alias("name")))


_SITE = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://', '')"


@_query(f"""WITH p AS (SELECT page_id, {_SITE} AS path FROM pages) SELECT page_id, path, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/', 1) END AS parent FROM p""")
def module_parent(spark, sf_dir):
    site = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^https?://", "")
    return _table(spark, sf_dir, "pages").select("page_id", site.alias("path")).withColumn("parent", naming.parent_module("path", "/"))


@_query(f"""WITH p AS (SELECT DISTINCT {_SITE} AS path FROM pages), h AS (SELECT DISTINCT regexp_extract(path, '^(.*)/', 1) AS prefix FROM p UNION SELECT DISTINCT string_split(path, '/')[1] FROM p)
SELECT DISTINCT h.prefix, p.path FROM h JOIN p ON h.prefix = p.path OR starts_with(p.path, h.prefix || '/') OR starts_with(h.prefix, p.path || '/')""")
def module_prefix_match(spark, sf_dir):
    site = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^https?://", "")
    p = _table(spark, sf_dir, "pages").select(site.alias("path")).distinct()
    h = p.select(F.regexp_extract("path", "^(.*)/", 1).alias("prefix")).union(p.select(F.substring_index("path", "/", 1))).distinct()
    return resolve.prefix_related(h, p, "prefix", "path", "/")


@_query(f"""WITH {_LINKS}, r AS (SELECT DISTINCT m.target AS module, e.target AS name FROM k m JOIN k e ON m.page_id = e.page_id WHERE m.ordinal = 0 AND e.ordinal IN (1, 2))
SELECT page_id, ordinal, target FROM k a WHERE EXISTS (SELECT 1 FROM r JOIN k f ON f.page_id = a.page_id AND f.ordinal = 0 AND r.module = f.target WHERE r.name = a.target)""")
def reexport_semijoin(spark, sf_dir):
    k = _links(spark, sf_dir)
    own = k.where("ordinal = 0").select("file_path", F.col("target").alias("module_path"))
    passed = references.reexported(k.join(own, "file_path").select("module_path", F.array("target").alias("imported_names"), F.col("ordinal").isin(1, 2).alias("is_reexport")))
    asked = k.join(own, "file_path").withColumnRenamed("target", "name")
    return asked.join(passed, ["module_path", "name"], "left_semi").select(F.col("file_path").alias("page_id"), "ordinal", F.col("name").alias("target"))


@_query(f"""WITH {_LINES}, {_find_sql("m", "the")}, s AS (SELECT doc_id, byte_start AS a, byte_start + n_bytes AS b, byte_start + octet_length(encode(string_split(line, 'ing')[1])) AS decl FROM li WHERE contains(line, 'ing'))
SELECT doc_id, byte_start FROM m WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = m.doc_id AND m.byte_start >= s.a AND m.byte_start < s.b AND m.byte_start >= s.decl)""")
def shadow_antijoin(spark, sf_dir):
    """A line is a scope that declares the name where 'ing' first stands in it."""
    f = _files(spark, sf_dir)
    found = spans.literal_positions(f, "the").select("file_path", F.lit("the").alias("name"), "byte_start", "byte_end")
    li = spans.line_index(f).withColumn("byte_end", F.col("byte_start") + F.col("n_bytes")).withColumnRenamed("line_no", "scope_id")
    ing = spans.literal_positions(f, "ing").select("file_path", F.col("byte_start").alias("at"))
    declared = spans.offset_to_line(ing, li.withColumnRenamed("scope_id", "line_no"), "at").groupBy("file_path", F.col("line_no").alias("scope_id")).agg(F.min("at").alias("declaration_pos")).withColumn("name", F.lit("the"))
    return references.not_shadowed(found, li.drop("n_bytes"), declared).select(F.col("file_path").alias("doc_id"), "byte_start")


@_query(f"WITH {_find_sql('m', 'tion')} SELECT doc_id, count(*) AS n_refs, string_agg(byte_start::VARCHAR, ',' ORDER BY byte_start DESC) AS starts FROM m GROUP BY 1")
def refs_grouped_desc(spark, sf_dir):
    found = references.by_file_descending(spans.literal_positions(_files(spark, sf_dir), "tion"))
    return found.select(F.col("file_path").alias("doc_id"), "n_refs", F.array_join(F.col("starts").cast("array<string>"), ",").alias("starts"))


@_query("""WITH f AS (SELECT source, row_number() OVER (ORDER BY source) AS from_id FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL))
SELECT f.from_id, d.doc_id AS to_id, 'defines' AS type FROM documents d JOIN f ON d.source = f.source""")
def defines_edges(spark, sf_dir):
    from lexispan.sources.facts import defines

    d = _table(spark, sf_dir, "documents").select(F.col("source").alias("file_path"), F.col("doc_id").alias("entity_id")).where("file_path IS NOT NULL")
    return defines(d)


@_query("""WITH m AS (SELECT doc_id, sha256(text) AS hash, octet_length(encode(text))::BIGINT AS size FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN text || '.' ELSE text END AS content FROM documents WHERE doc_id % 7 <> 0)
SELECT m.doc_id, m.size, CASE WHEN c.doc_id IS NULL THEN 'missing' WHEN sha256(c.content) <> m.hash THEN 'mismatch' ELSE 'ok' END AS status FROM m LEFT JOIN c ON m.doc_id = c.doc_id""")
def backup_verify(spark, sf_dir):
    from lexispan.sources.backup import verified

    f = _files(spark, sf_dir)
    manifest = f.select(F.col("file_path").alias("original_path"), spans.sha256("content").alias("hash"), F.octet_length("content").cast("bigint").alias("size"))
    copies = f.where("file_path % 7 <> 0").select(F.col("file_path").alias("original_path"), F.when(F.col("file_path") % 11 == 0, F.concat("content", F.lit("."))).otherwise(F.col("content")).alias("content"))
    return verified(manifest, copies).select(F.col("original_path").alias("doc_id"), "size", "status")


_RUSTC = "error[E0277]: the bound of {w} is not satisfied\n  --> src/{w}.rs:{n}:5\n   |\nhelp: consider {w}\n  = note: required by that\nwarning: unused {w}\n  --> src/lib.rs:2:9\nerror: aborting"
_GCC = "{w}.c:{n}:5: error: no ';' before '{w}'\n{w}.c: In function\n{w}.c:9:1: warning: unused: {w}"


@_query(f"""WITH t AS (SELECT doc_id, {language_queries.FIRST_WORDS_SQL} AS w, length(text)::BIGINT AS n FROM (SELECT doc_id, coalesce(min(text), '') AS text FROM documents GROUP BY 1))
SELECT 'rustc ' || doc_id AS run_id, 'error' AS level, 'src/' || w || '.rs' AS file, n AS line, 5::BIGINT AS "column", 'the bound of ' || w || ' is not satisfied' AS message, 'E0277' AS code, 'consider ' || w || chr(10) || 'required by that' AS note, 'https://doc.rust-lang.org/error-index.html#E0277' AS remediation FROM t
UNION ALL SELECT 'rustc ' || doc_id, 'warning', 'src/lib.rs', 2, 9, 'unused ' || w, NULL, NULL, NULL FROM t
UNION ALL SELECT 'gcc ' || doc_id, 'error', w || '.c', n, 5, 'error: no '';'' before ' || chr(39) || w || chr(39), NULL, NULL, NULL FROM t UNION ALL SELECT 'gcc ' || doc_id, 'warning', w || '.c', 9, 1, 'warning: unused: ' || w, NULL, NULL, NULL FROM t""")
def diagnostics_parse(spark, sf_dir):
    """What two compilers say of each document's words and length, as rows."""
    d = language_queries.texts(spark, sf_dir).select("doc_id", language_queries.first_words().alias("w"), F.length("text").cast("string").alias("n"))
    said = lambda text: F.replace(F.replace(F.lit(text), F.lit("{w}"), F.col("w")), F.lit("{n}"), F.col("n"))
    runs = lambda tool, text: d.select(F.concat(F.lit(f"{tool} "), F.col("doc_id").cast("string")).alias("run_id"), F.concat("w", F.lit(".c")).alias("file"), said(text).alias("output"))
    rows = diagnostics.rustc(runs("rustc", _RUSTC)).unionByName(diagnostics.gcc(runs("gcc", _GCC)))
    return rows.withColumn("remediation", naming.remediation("code")).drop("nth")
