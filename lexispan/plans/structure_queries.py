"""Named queries over the structure of pages and texts: trees, innermost nodes, bound references, indexed finds, composed edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispan.functions import spans
from lexispan.operators import binding, labels, nesting, resolve, script
from lexispan.sources import facts, grams, suffixes
from lexispan.sources.scratch import scratch_path, written

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _nodes(pages: DataFrame) -> DataFrame:
    """The tree of the pages, made once however often a query reads it."""
    return written(nesting.tree(nesting.html_marks(pages)), "tree")


def _pages(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").where("html IS NOT NULL").select(F.col("page_id").alias("file_path"), F.col("html").alias("content"))


_P = "'" + nesting.MARKUP.replace("'", "''") + "'"
_VOID = ", ".join(f"'{v}'" for v in nesting.VOID)
_UPTO = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
#: Marks of pages, and the tree that they make.
_TREE = f"""
tg AS (SELECT page_id, unnest(regexp_split_to_array(html, {_P})) AS gap, generate_subscripts(regexp_split_to_array(html, {_P}), 1) AS k FROM pages WHERE html IS NOT NULL),
tn AS (SELECT page_id, unnest(regexp_extract_all(html, {_P})) AS node, generate_subscripts(regexp_extract_all(html, {_P}), 1) AS k FROM pages WHERE html IS NOT NULL),
tt AS (SELECT tg.page_id, node, octet_length(encode(node))::BIGINT AS own, (sum(octet_length(encode(gap)) + coalesce(octet_length(encode(node)), 0)) OVER (PARTITION BY tg.page_id ORDER BY tg.k))::BIGINT AS byte_end
  FROM tg LEFT JOIN tn ON tg.page_id = tn.page_id AND tg.k = tn.k),
tm AS (SELECT page_id, byte_end - own AS byte_start, byte_end, node, CASE WHEN node LIKE '<!--%' THEN '!--' WHEN node LIKE '<!%' THEN '!' ELSE lower(regexp_extract(node, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) END AS name FROM tt WHERE node IS NOT NULL),
m AS (SELECT *, (CASE WHEN node LIKE '</%' THEN CASE WHEN name IN ({_VOID}) THEN 0 ELSE -1 END WHEN name IN ('!--', '!', 'script', 'style', {_VOID}) OR node LIKE '%/>' THEN 0 ELSE 1 END)::BIGINT AS mark FROM tm),
ta AS (SELECT *, sum(mark) OVER (PARTITION BY page_id, name ORDER BY byte_start) AS s, -sum(mark) OVER (PARTITION BY page_id, name ORDER BY byte_start DESC) AS r FROM m),
tb AS (SELECT *, least(0, coalesce(min(s) OVER (PARTITION BY page_id, name ORDER BY byte_start {_UPTO}), 0)) AS low, least(0, coalesce(min(r) OVER (PARTITION BY page_id, name ORDER BY byte_start DESC {_UPTO}), 0)) AS high FROM ta),
tc AS (SELECT page_id, byte_start, byte_end, name, mark, CASE WHEN (mark < 0 AND s < low) OR (mark > 0 AND r < high) THEN 0 ELSE mark END AS paired FROM tb),
td AS (SELECT *, sum(paired) OVER (PARTITION BY page_id ORDER BY byte_start) + CASE WHEN paired < 0 THEN 1 ELSE 0 END AS level FROM tc),
te AS (SELECT *, lead(name) OVER w AS next_name, lag(name) OVER w AS last_name, lead(byte_end) OVER w AS next_end FROM td WINDOW w AS (PARTITION BY page_id, level, paired = 0 ORDER BY byte_start)),
tf AS (SELECT *, CASE WHEN (paired > 0 AND next_name = name) OR (paired < 0 AND last_name = name) THEN paired ELSE 0 END AS kept FROM te),
tl AS (SELECT *, sum(kept) OVER (PARTITION BY page_id ORDER BY byte_start) AS here FROM tf),
n AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY byte_start) - 1 AS node_id, name, (here + CASE WHEN kept = 0 THEN 1 ELSE 0 END)::BIGINT AS depth, byte_start, CASE WHEN kept > 0 THEN next_end ELSE byte_end END AS byte_end, kept > 0 OR mark = 0 AS is_closed
  FROM tl WHERE kept > 0 OR (kept = 0 AND mark >= 0)),
tree AS (SELECT n.*, p.node_id AS parent_id FROM n LEFT JOIN n p ON p.page_id = n.page_id AND p.depth = n.depth - 1 AND p.byte_start < n.byte_start AND n.byte_start < p.byte_end)"""


@_query(f"WITH {_TREE} SELECT page_id, node_id, parent_id, name, depth, byte_start, byte_end, is_closed FROM tree")
def html_tree(spark, sf_dir):
    """Elements of each page with their parents, malformed pages included."""
    return nesting.tree(nesting.html_marks(_pages(spark, sf_dir))).withColumnRenamed("file_path", "page_id")


def _found(word: str) -> str:
    return f"""
q AS (SELECT page_id, unnest(string_split(html, '{word}')) AS piece, generate_subscripts(string_split(html, '{word}'), 1) AS k, len(string_split(html, '{word}')) AS parts FROM pages WHERE html IS NOT NULL),
f AS (SELECT page_id, (k - 1)::BIGINT AS nth, fin - {len(word)} AS byte_start FROM (SELECT page_id, k, parts, (sum(octet_length(encode(piece)) + {len(word)}) OVER (PARTITION BY page_id ORDER BY k))::BIGINT AS fin FROM q) WHERE k < parts)"""


@_query(f"""WITH {_TREE}, {_found("an")} SELECT f.page_id, f.nth, f.byte_start, max_by(tree.name, tree.depth) AS name, max_by(tree.node_id, tree.depth) AS node_id, max(tree.depth) AS depth
FROM f LEFT JOIN tree ON tree.page_id = f.page_id AND tree.byte_start <= f.byte_start AND f.byte_start < tree.byte_end GROUP BY ALL""")
def html_deepest_node(spark, sf_dir):
    """The innermost element around each match of a literal."""
    pages = _pages(spark, sf_dir)
    nodes = _nodes(pages)
    found = nesting.innermost(spans.literal_positions(pages, "an").select("file_path", "nth", "byte_start"), nodes, ["file_path"])
    return found.join(nodes.select("file_path", "node_id", "name", "depth"), ["file_path", "node_id"], "left").withColumnRenamed("file_path", "page_id")


@_query(f"""WITH {_TREE}, {_found("ad")} SELECT page_id, nth, byte_start FROM f WHERE NOT EXISTS (SELECT 1 FROM tree WHERE tree.page_id = f.page_id AND tree.name IN ('!--', 'script', 'style') AND tree.byte_start <= f.byte_start AND f.byte_start < tree.byte_end)""")
def html_find_outside_kinds(spark, sf_dir):
    """Matches whose innermost node is no comment, script or style."""
    from lexispan.operators.pattern import outside_kinds

    pages = _pages(spark, sf_dir)
    nodes = _nodes(pages).withColumnRenamed("name", "kind")
    found = spans.literal_positions(pages, "ad").select("file_path", "nth", "byte_start")
    return outside_kinds(found, nodes, ["!--", "script", "style"]).withColumnRenamed("file_path", "page_id")


#: Links as identifiers and, for what holds their list item, as declarations; the first three and the sections as symbols; links to other pages' first links as imports.
_SECTIONS = ("nav", "article", "footer", "div")
_LINKED = f"""
l AS (SELECT m.page_id, m.byte_start, tree.byte_end, tree.parent_id, lower(regexp_extract(m.node, 'href="([^"]*)"', 1)) AS name, regexp_extract(m.node, 'href="([^"]*)"', 1) AS target,
  row_number() OVER (PARTITION BY m.page_id ORDER BY m.byte_start) - 1 AS ordinal FROM m JOIN tree ON m.page_id = tree.page_id AND m.byte_start = tree.byte_start WHERE m.name = 'a' AND contains(m.node, 'href="')),
mo AS (SELECT target AS module, min(page_id) AS target_page FROM l WHERE ordinal = 0 GROUP BY 1),
i AS (SELECT l.page_id, l.name, l.ordinal, mo.target_page, l.ordinal % 2 = 1 AS is_glob FROM l JOIN mo ON l.target = mo.module),
y AS (SELECT page_id, name, byte_start, byte_end, ordinal FROM l WHERE ordinal < 3 UNION ALL SELECT page_id, name, byte_start, byte_end, 1000 + node_id FROM tree WHERE is_closed AND name IN ({", ".join(f"'{s}'" for s in _SECTIONS)})),
s AS (SELECT page_id, name, arg_min(byte_start, ordinal) AS byte_start, min(ordinal) AS ordinal FROM y GROUP BY 1, 2), h AS (SELECT page_id, arg_min(name, ordinal) AS name FROM s GROUP BY 1),
d AS (SELECT l.page_id, l.name, g.byte_end AS upto, l.byte_end AS pos FROM l JOIN tree p ON p.page_id = l.page_id AND p.node_id = l.parent_id JOIN tree g ON g.page_id = p.page_id AND g.node_id = p.parent_id),
lo AS (SELECT l.page_id, l.name, l.byte_start, max(d.pos) AS local_pos FROM l LEFT JOIN d ON d.page_id = l.page_id AND d.name = l.name AND d.pos <= l.byte_start AND l.byte_start < d.upto GROUP BY 1, 2, 3),
p AS (SELECT DISTINCT page_id, name AS identifier FROM lo WHERE local_pos IS NULL),
c AS (SELECT p.*, s.page_id AS target_page, s.name AS target_name, 'file' AS origin, 0 AS priority, 0 AS o FROM p JOIN s ON p.page_id = s.page_id AND p.identifier = s.name
  UNION ALL SELECT p.*, i.target_page, coalesce(s.name, h.name), 'import', 1, i.ordinal FROM p JOIN i ON p.page_id = i.page_id AND NOT i.is_glob AND i.name = p.identifier LEFT JOIN s ON s.page_id = i.target_page AND s.name = p.identifier JOIN h ON h.page_id = i.target_page
  UNION ALL SELECT p.*, i.target_page, s.name, 'glob', 2, i.ordinal FROM p JOIN i ON p.page_id = i.page_id AND i.is_glob JOIN s ON s.page_id = i.target_page AND s.name = p.identifier),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY page_id, identifier ORDER BY priority, o) = 1),
bound AS (SELECT lo.page_id, lo.name, lo.byte_start, lo.local_pos, CASE WHEN lo.local_pos IS NOT NULL THEN 'local' ELSE coalesce(b.origin, 'unbound') END AS origin, b.target_page, b.target_name, s.byte_start AS target_start
  FROM lo LEFT JOIN b ON lo.local_pos IS NULL AND b.page_id = lo.page_id AND b.identifier = lo.name LEFT JOIN s ON s.page_id = b.target_page AND s.name = b.target_name)"""


def _bound(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    pages = _pages(spark, sf_dir)
    nodes = _nodes(pages)
    tags = nesting.pieces(pages, nesting.MARKUP).where(F.col("node").rlike("^<[aA][^A-Za-z0-9]") & F.contains("node", F.lit('href="')))
    target = F.regexp_extract("node", 'href="([^"]*)"', 1)
    links = tags.join(nodes.where("name = 'a'").select("file_path", "byte_start", F.col("byte_end").alias("_end"), "parent_id"), ["file_path", "byte_start"])
    links = links.select("file_path", "byte_start", F.col("_end").alias("byte_end"), "parent_id", target.alias("target"), F.lower(target).alias("name"), (F.row_number().over(Window.partitionBy("file_path").orderBy("byte_start")) - 1).cast("bigint").alias("ordinal"))
    links = written(links, "links")
    sections = nodes.where(F.col("is_closed") & F.col("name").isin(*_SECTIONS)).select("file_path", "name", "byte_start", "byte_end", (F.col("node_id") + 1000).alias("ordinal"))
    symbols = links.where("ordinal < 3").select("file_path", "name", "byte_start", "byte_end", "ordinal").unionByName(sections).withColumn("kind", F.lit("function"))
    modules = links.where("ordinal = 0").groupBy(F.col("target").alias("module_path")).agg(F.min("file_path").alias("file_path"))
    imports = resolve.import_targets(links.select("file_path", "ordinal", F.array("target").alias("path"), F.array("name").alias("imported_names"), (F.col("ordinal") % 2 == 1).alias("is_glob")), modules)
    up = nodes.select("file_path", F.col("node_id").alias("parent_id"), F.col("parent_id").alias("scope_id"))
    declared = links.join(up, ["file_path", "parent_id"]).where("scope_id IS NOT NULL").select("file_path", "scope_id", "name", F.col("byte_end").alias("declaration_pos"))
    scopes = nodes.select("file_path", F.col("node_id").alias("scope_id"), "byte_start", "byte_end")
    names = links.select("file_path", "name", "byte_start", "byte_end", F.lit("identifier").alias("node_kind"), F.lit("call").alias("parent_kind"), F.lit(False).alias("is_qualified"), F.lit(None).cast("string").alias("qualified_text"))
    return binding.bind(names, scopes, declared, symbols, imports, modules), symbols


@_query(f"WITH {_TREE}, {_LINKED} SELECT page_id, name, byte_start, local_pos, origin, target_page, target_name, target_start FROM bound")
def link_references(spark, sf_dir):
    """Every link of every page bound: to an earlier one around it, to a symbol of its page, or through a link to another page."""
    bound, _ = _bound(spark, sf_dir)
    return bound.select(F.col("file_path").alias("page_id"), "name", "byte_start", "local_pos", "origin", F.col("target_file").alias("target_page"), "target_name", "target_start")


@_query(f"""WITH {_TREE}, {_LINKED}, e AS (SELECT bound.page_id, bound.byte_start, target_page, target_name, target_start, max_by(y.name, y.byte_start) AS caller, max(y.byte_start) AS caller_start
  FROM bound LEFT JOIN y ON y.page_id = bound.page_id AND y.byte_start <= bound.byte_start AND bound.byte_start < y.byte_end WHERE target_page IS NOT NULL GROUP BY ALL)
SELECT page_id, caller, caller_start, target_page, target_name AS callee, target_start AS callee_start, count(*) AS n_calls FROM e GROUP BY ALL""")
def link_calls(spark, sf_dir):
    """Which section or link of a page leads to which symbol, how often."""
    bound, symbols = _bound(spark, sf_dir)
    return binding.calls(bound, symbols).withColumnRenamed("file_path", "page_id").withColumnRenamed("target_file", "target_page")


_NEEDLE = "token = "


@_query(f"""WITH q AS (SELECT doc_id, unnest(string_split(text, '{_NEEDLE}')) AS piece, generate_subscripts(string_split(text, '{_NEEDLE}'), 1) AS k, len(string_split(text, '{_NEEDLE}')) AS parts FROM documents WHERE text IS NOT NULL)
SELECT doc_id, (k - 1)::BIGINT AS nth, fin - {len(_NEEDLE)} AS byte_start, fin AS byte_end FROM (SELECT doc_id, k, parts, (sum(octet_length(encode(piece)) + {len(_NEEDLE)}) OVER (PARTITION BY doc_id ORDER BY k))::BIGINT AS fin FROM q) WHERE k < parts""")
def gram_find(spark, sf_dir):
    """A literal found through a gram index of all documents: blocks that lack one of its grams are not read."""
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL").select(F.col("doc_id").alias("file_path"), F.col("text").alias("content"))
    path = scratch_path(spark, "grams", sweep=True)
    grams.build(files, path)
    return grams.find(spark, path, _NEEDLE).withColumnRenamed("file_path", "doc_id")


#: Steps as characters of the text that each finds: put before, put for a stretch across the end of what was put, taken out, put inside what is new.
@_query("""WITH a AS (SELECT doc_id, text, '<<<ü>>>' || text AS t FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, text, left(t, 5) || 'nové' || substr(t, 10) AS t FROM a), c AS (SELECT doc_id, text, CASE WHEN length(t) > 40 THEN left(t, 20) || substr(t, 31) ELSE t END AS t FROM b),
d AS (SELECT doc_id, text, left(t, 6) || '··' || substr(t, 8) AS t FROM c) SELECT doc_id, sha256(text) AS before_sha256, sha256(t) AS after_sha256 FROM d""")
def composed_edits(spark, sf_dir):
    """Four steps, each over what the last one left, composed and applied in one pass over the texts."""
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL").select(F.col("doc_id").alias("file_path"), F.col("text").alias("content"))
    size = lambda n: F.octet_length(F.left("content", F.lit(n))).cast("bigint")  # noqa: E731  bytes of the first characters
    chars = F.length("content")
    head, new = len("<<<ü>>>".encode()), "nové"
    # after the second step: five characters of the head, the new word, and the text from its third character on
    begin = len("<<<ü>".encode()) + len(new.encode())
    long = F.greatest(chars - 2, F.lit(0)) + 9 > 40
    step = lambda n, a, b, text, on=None: F.when(F.lit(True) if on is None else on, F.struct(F.lit(n).alias("step"), a.cast("bigint").alias("byte_start"), b.cast("bigint").alias("byte_end"), F.lit(text).alias("content")))
    steps = F.array_compact(F.array(
        step(0, F.lit(0), F.lit(0), "<<<ü>>>"), step(1, F.lit(len("<<<ü>".encode())), head + size(2), new),
        step(2, begin + size(13) - size(2), begin + size(23) - size(2), "", long), step(3, F.lit(len("<<<ü>n".encode())), F.lit(len("<<<ü>no".encode())), "··"),
    ))
    done = script.scripted(files.select("file_path", F.inline(steps)), files)
    return done.select(F.col("file_path").alias("doc_id"), "before_sha256", "after_sha256")


_HOST = "regexp_extract(url, '^https?://([^/?#]*)', 1)"


def _host_index(spark, sf_dir) -> str:
    path = scratch_path(spark, "hosts", sweep=True)
    suffixes.build(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.regexp_extract("url", "^https?://([^/?#]*)", 1).alias("host")), path, "host", ".")
    return path


@_query(f"SELECT page_id, {_HOST} AS host FROM pages WHERE {_HOST} = 'example.org' OR {_HOST} LIKE '%.example.org'")
def host_suffix(spark, sf_dir):
    """Pages of all hosts under one, a range of the index by reversed names."""
    return suffixes.by_suffix(spark, _host_index(spark, sf_dir), "example.org", ".")


@_query(f"""WITH h AS (SELECT page_id, {_HOST} AS host FROM pages), a AS (SELECT DISTINCT regexp_extract(host, '[^.]*\\.[^.]*\\.[^.]*$') AS suffix FROM h)
SELECT h.page_id, h.host, a.suffix FROM h JOIN a ON h.host = a.suffix OR ends_with(h.host, '.' || a.suffix) WHERE a.suffix <> ''""")
def host_suffixes(spark, sf_dir):
    """Pages under each host of three parts, all looked up at once."""
    path = _host_index(spark, sf_dir)
    asked = spark.read.parquet(path).select(F.regexp_extract("host", r"[^.]*\.[^.]*\.[^.]*$", 0).alias("suffix")).where("suffix <> ''")
    return suffixes.by_suffixes(spark, path, asked, ".")


@_query("""WITH l AS (SELECT doc_id AS entity_id, 'lang:' || lang AS label FROM documents UNION ALL SELECT doc_id, 'source:' || source FROM documents)
SELECT entity_id FROM l WHERE label IN ('lang:fr', 'source:src1') GROUP BY 1 HAVING count(DISTINCT label) = 2""")
def label_store_query(spark, sf_dir):
    """Entities with two labels from stored labels: folders of other labels are not read."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = d.select(F.col("doc_id").alias("entity_id"), F.explode(F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("source:"), "source"))).alias("label")).where("label IS NOT NULL")
    path = scratch_path(spark, "labels", sweep=True)
    facts.save({"entity_labels": rows}, path)
    return labels.all_labels(facts.load(spark, path, "entity_labels"), ["lang:fr", "source:src1"])
